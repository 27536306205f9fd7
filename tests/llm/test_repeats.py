"""Longest previous factors, and whole passes against counts of all windows."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from broadsheet.llm import repeats

SCHEMA = "doc_id long, text string, block long, kind string, part int, bits binary, anchors int"


def docs(spark, rows):
    """Documents with columns whose names clash with the operator's own."""
    return spark.createDataFrame([(i, t, 1, "k", 2, b"3", 4) for i, t in rows], SCHEMA)


def plain(texts, length):
    """(bytes, removed, spans, what is left) of each text."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    return [(len(b), *repeats.removed(b, np.array([count[b[i : i + length]] > 1 for i in range(len(b) - length + 1)], bool), length)) for b in raw]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=40).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=5), st.sampled_from([3, 7, 8, 9, 16, 20]), st.randoms())
def test_longest_previous_factors(texts, length, random):
    """Against all earlier windows, whatever order the places give them."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum([0, *map(len, texts)])[:-1]
    windows = np.array([s + i for s, t in zip(starts, texts, strict=True) for i in range(len(t) - length + 1)], np.int64)
    if not len(windows):
        return
    place = list(range(len(windows)))
    random.shuffle(place)
    best, source = repeats.longest_previous_factors(data, windows, np.array(place), length)
    strings = [data[w : w + length].tobytes() for w in windows]
    shared = lambda a, b: next((k for k in range(length) if a[k] != b[k]), length)
    for i, own in enumerate(strings):
        earlier = {j: shared(own, strings[j]) for j in range(len(strings)) if place[j] < place[i]}
        assert best[i] == max(earlier.values(), default=0)
        if best[i]:
            assert earlier[int(source[i])] == best[i]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=120, unique=True))
def test_smaller_neighbours(places):
    before, after = repeats.smaller_neighbours(np.array(places))
    for i, p in enumerate(places):
        assert before[i] == max((j for j in range(i) if places[j] < p), default=-1)
        assert after[i] == min((j for j in range(i + 1, len(places)) if places[j] < p), default=-1)


def test_smaller_neighbours_of_a_bad_order():
    """A long rise and then a fall to the start, over and over: no step at a time."""
    n = 200_000
    places = np.concatenate([np.concatenate((np.arange(1, 1000) + 1000 * k, [-k])) for k in range(n // 1000)])
    before, _ = repeats.smaller_neighbours(places)
    assert before[999] == before[1999] == -1 and before[1000] == 999 and before[1998] == 1997


@pytest.fixture(scope="module")
def crowd():
    """A passage in a third of the documents, between texts of their own; exact copies; runs that go on in themselves."""
    r = np.random.default_rng(6)
    noise = lambda n: bytes(r.integers(97, 123, n, dtype=np.uint8)).decode()
    passage, rows = noise(700), []
    for i in range(240):
        rows.append(noise(int(r.integers(50, 600))) + (passage[int(r.integers(0, 200)) :] if i % 3 == 0 else "") + noise(int(r.integers(0, 300))))
    copy = noise(900)
    return [*rows, copy, copy, copy + "x", "ab" * 800, "ab" * 900, "", None, "short", noise(40) + "ab" * 300, "é" * 500, "日本語" * 200]


@pytest.mark.parametrize("crowd_size, block", [(2048, 1 << 20), (1, 20_000), (5, 6_000), (10**9, 3_000)])
def test_a_passage_in_a_third_of_the_documents(spark, crowd, crowd_size, block):
    got = {r["doc_id"]: r for r in repeats.remove_repeats(docs(spark, list(enumerate(crowd))), crowd=crowd_size, block_bytes=block, with_kept=True).collect()}
    for i, (n, gone, spans, left) in enumerate(plain(crowd, 200)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == (n, gone, spans, left) and r["kept_sha256"] == hashlib.sha256(left).hexdigest()


@pytest.mark.parametrize("crowd_size, block", [(2048, 1 << 20), (1, 20_000), (6, 5_000)])
def test_each_string_stays_once(spark, crowd, crowd_size, block):
    got = repeats.remove_repeats(docs(spark, list(enumerate(crowd[:-4]))), crowd=crowd_size, block_bytes=block, keep_first=True, with_kept=True).collect()
    raw = {i: (t or "").encode() for i, t in enumerate(crowd[:-4])}
    before = {b[i : i + 200] for b in raw.values() for i in range(len(b) - 199)}
    # What stays of a text stands in one piece wherever nothing was cut out of it.
    after = Counter(b[i : i + 200] for r in got for b in [bytes(r["kept"])] for i in range(len(b) - 199))
    assert max(n for s, n in after.items() if s in before) == 1
    noise = [r for r in got if r["doc_id"] % 3 and r["doc_id"] < 240]
    assert all(bytes(r["kept"]) == raw[r["doc_id"]] for r in noise)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "x" * 250), (3, "x" * 100), (4, "y" * 199), (5, "y" * 199), (6, "z" * 200), (6, "z" * 200)]
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"]) for r in repeats.remove_repeats(docs(spark, rows)).collect())
    assert got == [(0, 250, 250, 1), (1, 0, 0, 0), (2, 0, 0, 0), (3, 100, 0, 0), (4, 199, 0, 0), (5, 199, 0, 0), (6, 200, 200, 1), (6, 200, 200, 1)]
    assert repeats.remove_repeats(docs(spark, [])).collect() == []

"""Both models against plain versions, and the two ways by which blocks reach the trie."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from broadsheet.llm import lm_scores, lookups

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, block long, part int, found binary, flag boolean, kind string"


def docs(spark, rows):
    """Documents with columns whose names clash with the operator's own."""
    return spark.createDataFrame([(i, t, 1, 2, b"3", True, "k") for i, t in rows], SCHEMA)


def trained(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2


class PlainPPM:
    """Escape method C with exclusion, context by context, in dictionaries."""

    def __init__(self, texts, depth):
        self.depth, self.seen = depth, defaultdict(Counter)
        for text in texts:
            symbols = [256] * depth + list(text) + [256]
            for i in range(depth, len(symbols)):
                for k in range(depth + 1):
                    self.seen[tuple(symbols[i - k : i])][symbols[i]] += 1

    def share(self, before, symbol):
        p, excluded = 1.0, set()
        for k in range(self.depth, -1, -1):
            seen = self.seen.get(tuple(before[len(before) - k :]), {})
            left = {s: n for s, n in seen.items() if s not in excluded}
            escape = 0 if len(seen) == 257 else len(left)
            if symbol in left:
                return p * left[symbol] / (sum(left.values()) + escape)
            if left:
                p *= len(left) / (sum(left.values()) + escape)
            excluded |= set(seen)
        return p / (257 - len(excluded))

    def log(self, text):
        symbols = [256] * self.depth + list(text) + [256]
        return sum(math.log10(self.share(symbols[i - self.depth : i], symbols[i])) for i in range(self.depth, len(symbols)))


@pytest.fixture(scope="module")
def small(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").where("doc_id < 120")
    return df, {r["doc_id"]: r["text"] for r in df.collect()}


@pytest.mark.parametrize("depth, broadcast", [(4, 10**6), (4, 0), (2, 0)])
def test_scores_match_plain_models(spark, small, depth, broadcast):
    """The trie at every executor, and left in its parts."""
    df, texts = small
    count = Counter()
    for i, t in texts.items():
        if trained(i):
            count.update([*t.encode().lower().split(), b" "])
    n, v = sum(count.values()), len(count)
    ppm = PlainPPM([t.encode() for i, t in texts.items() if trained(i)], depth)
    got = lm_scores.lm_scores(df, depth=depth, block_bytes=60_000, broadcast_grams=broadcast).collect()
    assert len(got) == len(texts)
    for r in got:
        words = [*texts[r["doc_id"]].encode().lower().split(), b" "]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(count[w] > 0 for w in words), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words))
        assert r["held_out"] == (not trained(r["doc_id"])) and r["score"] == pytest.approx(ppm.log(texts[r["doc_id"]].encode()))


def test_trie_adds_up_to_one():
    r = np.random.default_rng(4)
    texts = [bytes(r.integers(0, 6, 300, dtype=np.uint8)), bytes(range(256)) * 2]
    trie = lm_scores.Trie(*lm_scores.count_grams(texts, 3), 3)
    for context in [(0, 1, 2), (5, 5, 5), (9, 0, 1), (200, 201, 202), (256, 256, 256), (77, 256, 1)]:
        base = (context[2] << 27) | (context[1] << 18) | (context[0] << 9)
        assert (10.0 ** trie.logs(np.arange(base, base + 257).astype(np.uint64))).sum() == pytest.approx(1)


def test_every_context_is_kept():
    """What is gathered grows with the texts: no context is pruned and no byte is merged with others."""
    r = np.random.default_rng(9)
    sizes = [len(lm_scores.count_grams([bytes(r.integers(0, 256, n, dtype=np.uint8))], 4)[0]) for n in (1000, 10_000, 100_000)]
    assert sizes == [1001, 10_001, 100_001]


def test_long_texts_are_scored_in_slices(monkeypatch):
    texts = [b"abc" * 700, b"", b"x", b"the quick brown fox " * 90]
    trie = lm_scores.Trie(*lm_scores.count_grams(texts[:3], 4), 4)
    whole, counted = lm_scores.text_logs(texts, 4, trie.logs), lm_scores.count_grams(texts, 4)
    monkeypatch.setattr(lm_scores, "AT_ONCE", 100)
    assert np.allclose(lm_scores.text_logs(texts, 4, trie.logs), whole) and all(np.array_equal(a, b) for a, b in zip(lm_scores.count_grams(texts, 4), counted, strict=True))
    assert whole == pytest.approx([PlainPPM(texts[:3], 4).log(t) for t in texts])


def test_keys_that_share_their_first_bits_are_told_apart():
    known = lookups.added_up(np.array([7, 7, 7, 9], np.uint64), np.array([3, 1, 3, 0], np.uint32), np.array([1, 5, 2, 4]))
    assert lookups.totals_of(known, np.array([7, 7, 7, 8, 9, 10], np.uint64), np.array([1, 3, 2, 0, 0, 0], np.uint32)).tolist() == [5, 3, 0, 0, 4, 0]


def test_totals_round_trip():
    for x in ([], [0, 5, 2**32 - 1], [2**40, 1]):
        assert lookups.unpack_totals(lookups.pack_totals(np.array(x, np.int64)), len(x)).tolist() == x


def test_ranges_follow_the_keys_and_not_the_blocks():
    assert lookups.ranges_for(10, 8) == (8, 1) and lookups.ranges_for(10, 6400) == (64, 100) and lookups.ranges_for(10**9, 100_000) == (1000, 100)
    high = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    found = lookups.range_of(high, 64)
    assert (np.diff(found) >= 0).all() and found.min() == 0 and found.max() == 63


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_odd_rows(spark, broadcast):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b a"), (4, "a b a"), (None, "no id"), (5, "é 日本 \x00" * 3), (6, "a " * 50_000)]
    got = lm_scores.lm_scores(docs(spark, rows), broadcast_grams=broadcast).collect()
    ppm = PlainPPM([(t or "").encode() for i, t in rows if trained(i)], 4)
    assert sorted((r["doc_id"] or 0, r["n_tokens"], round(r["score"], 4)) for r in got) == sorted((i or 0, len((t or "").split()) + 1, round(ppm.log((t or "").encode()), 4)) for i, t in rows)
    assert lm_scores.lm_scores(docs(spark, []), broadcast_grams=broadcast).collect() == []
    alone = lm_scores.lm_scores(docs(spark, [(i, "ab") for i in range(30) if not trained(i)]), broadcast_grams=broadcast).collect()
    assert alone and all(r["base_score"] == 0 and r["n_known"] == 0 and r["score"] == pytest.approx(3 * math.log10(1 / 257)) for r in alone)


def test_the_word_model_alone(spark, monkeypatch):
    """The same base columns as with the byte model, and no string counted for them."""
    rows = [(i, t) for i, t in enumerate(["Ab cd ab", "", None, "x " * 3000, "é\x0bÉ e\tEF", *(f"w{k} ab w{k % 5}" for k in range(40))])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = lm_scores.lm_scores(df, block_bytes=500).drop("score")
    monkeypatch.setattr(lm_scores, "count_grams", None)
    alone = lm_scores.word_scores(df, block_bytes=500)
    assert alone.schema == whole.schema
    key = lambda r: r["doc_id"]
    assert sorted(alone.collect(), key=key) == sorted(whole.collect(), key=key)

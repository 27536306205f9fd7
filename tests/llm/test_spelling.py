"""Variants against every pair of words compared in plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest

from broadsheet.llm import spelling as S

SCHEMA = "doc_id long, text string, word string, n long, key string, lo int, hi int, points int, longer int, form string"


def docs(spark, rows):
    """Documents with columns whose names clash with the operator's own."""
    return spark.createDataFrame([(*r, "x", 1, "k", 2, 3, 4, 5, "f") for r in rows], SCHEMA)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(rows, every=31):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if every and h % every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near_to = {w: [x for x in words if near(w, x)] for w in words}
    forms = {}
    for w, others in near_to.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= 10 * words[w] else None

    def root(w):
        while forms[w] is not None:
            w = forms[w]
        return w

    return {w: (forms[w], root(w), n, len(near_to[w]), words[forms[w]] if forms[w] else None) for w, n in words.items()}


def found(df):
    got = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got}
    assert len(out) == len(got)
    return out


def typo(rng, w):
    k = rng.randrange(len(w) + 1)
    c = rng.choice("abcéÿßzÀ")
    return rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]])


def made(seed):
    rng = random.Random(seed)
    base = ["abcabcab", "aaaaaaa", "aaaaaaaa", "straßenbahn", "répétition", "Example", "EXAMPLES", "examplesx", "prefixed", "prefixes", "prefixing"]
    base += ["".join(rng.choices("abcd", k=rng.randint(7, 10))) for _ in range(120)]
    rows = []
    for i in range(250):
        words = [rng.choices(base, weights=[1 / (k + 1) ** 1.3 for k in range(len(base))])[0] for _ in range(40)]
        rows.append((i, rng.choice([" ", "\n", "-", "1", "é "]).join(typo(rng, typo(rng, w)) if rng.random() < 0.05 else typo(rng, w) if rng.random() < 0.15 else w for w in words)))
    return [*rows, (3, rows[3][1]), (None, "Example example ÿÿÿÿÿÿÿ ÿÿÿÿÿÿÿ"), (400, None), (401, ""), (402, "日本語 ÀÉÎÕÜàé ÀÉÎÕÜàé × ÷"), (403, "example " * 30_000)]


@pytest.mark.parametrize("crowd", [64, 2, 0])
def test_equals_all_pairs(spark, crowd):
    """With segments left whole, cut where more than two words share them, and cut as far as they go."""
    rows = made(7)
    want = plain(rows)
    got = found(S.spelling_variants(docs(spark, rows), crowd=crowd, broadcast_segments=10**6 if crowd else 0))
    assert got == want
    assert sum(f is not None for f, *_ in want.values()) > 30 and any(r != f and f for f, r, *_ in want.values())


def test_chains_of_forms_reach_their_end(spark):
    chain = [("abcdefgh", 10**4), ("abcdefgx", 10**3), ("abcdefyx", 100), ("abcdzfyx", 10), ("abcdzfyw", 1)]
    links = spark.createDataFrame([(b, a) for (a, _), (b, _) in zip(chain, chain[1:], strict=False)], "word string, form string")
    assert {r["word"]: r["root"] for r in S.roots(links).collect()} == {w: "abcdefgh" for w, _ in chain[1:]}
    assert S.roots(links.limit(0)).collect() == []


def test_each_pair_once(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("ab", k=rng.randint(7, 9))) for _ in range(300)})
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    for crowd in (1000, 3):
        got = [tuple(sorted((r["a"], r["b"]))) for r in S.near_pairs(df, crowd).collect()]
        assert len(got) == len(set(got))
        assert set(got) == {(a, b) for k, a in enumerate(words) for b in words[k + 1 :] if near(a, b)}


def test_empty_tables(spark):
    assert S.spelling_variants(docs(spark, [])).collect() == []
    assert S.spelling_variants(docs(spark, [(1, None), (2, "short words only")])).collect() == []


def test_tasks_send_on_what_they_hold(spark, monkeypatch):
    monkeypatch.setattr(S, "HELD_WORDS", 3)
    monkeypatch.setattr(S, "LONG_TEXT", 10)
    rows = made(9)
    assert found(S.spelling_variants(docs(spark, rows).coalesce(1))) == plain(rows)

"""The audit against every order applied filter by filter in plain Python."""

import hashlib
import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from broadsheet.llm import filter_audit as A

SCHEMA = "doc_id long, source string, text string, part string, mask int, digest string, first_id long, salt int, quality int, toxic int, cells int"


def docs(spark, rows):
    """Documents with columns whose names clash with the operator's own."""
    return spark.createDataFrame([(*r, "x", 1, "d", 2, 3, 1, 1, 4) for r in rows], SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def plain(rows, marks):
    good, toxic = ({i for i, *m in marks if i is not None and m[k] == 1} for k in (0, 1))
    firsts = defaultdict(list)
    for i, _, t in rows:
        if i is not None:
            firsts[t or ""].append(i)
    parts = defaultdict(list)
    for i, source, text in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and min(firsts[t]) < i}
        parts[source or ""].append(({k for k, v in bad.items() if v}, i in good, i in toxic))
    out = {}
    for part, members in parts.items():
        shapley = defaultdict(int)
        for order in itertools.permutations("ABCDE"):
            left = members
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[0]]
                left = [m for m in left if f not in m[0]]
                shapley[f] += len(gone)
                redundant = sum(f in m[0] for m in members) - len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(m[0] == {f} for m in members), sum(m[1] for m in gone), sum(m[2] for m in gone)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def found(got):
    rows = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in got}
    assert len(rows) == len(got)
    return rows


WORDS = [f"w{k}" for k in range(90)]


def made(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(150):
        text = " ".join(rng.choices(WORDS[: rng.choice([20, 90])], k=rng.choice([10, 60, 200])))
        text = text.upper() if rng.random() < 0.2 else text
        rows.append((i, rng.choice([None, "", "a", "b", "c"]), text + rng.choice(["", "", " #", "\x0b&"])))
    return [*rows, *((1000 + k, s, rows[k % 7][2]) for k, s in enumerate("abcabc" * 5)), (5, "a", rows[5][2]), (None, "a", rows[5][2]), (2000, "a", None), (2001, "z", ""), (2001, "z", "")]


def test_equals_every_order_applied(spark):
    rows = made(1)
    marks = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 150, 3)] + [(6, 0, 1), (6, 1, 0), (None, 1, 1), (9, None, None)]
    want = plain(rows, marks)
    for broadcast in (A.BROADCAST_GROUPS, 0):
        got = A.filter_audit(docs(spark, rows), labels(spark, marks), broadcast_groups=broadcast)
        assert found(got.collect()) == want
    assert len(want) == 600 * 5


def test_empty_table_and_no_labels(spark):
    assert A.filter_audit(docs(spark, []), labels(spark, [])).collect() == []
    got = found(A.filter_audit(docs(spark, [(1, None, None)]), labels(spark, [])).collect())
    assert len(got) == 600 and got["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)


def test_very_long_texts_in_chunks():
    text = (b"alpha beta " * 1000 + b"gamma\x0b") * 3 + b"x" * 5000
    for chunk in (7, 64, 4096, 10**9):
        assert A.word_numbers(text, chunk) == (len(text.split()), len(set(text.split())))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 6])
def test_adjacent_swaps_visit_every_order_once(n):
    order, seen = list(range(n)), {tuple(range(n))}
    for i in A.adjacent_swaps(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert len(seen) == len(list(itertools.permutations(range(n))))


def test_shapley_adds_up_to_what_any_order_removes():
    cells = np.random.default_rng(3).integers(0, 50, (4, 32, 3))
    orders, out = A.audit(cells)
    failing = cells[:, 1:, 0].sum(axis=1)
    assert len(set(orders)) == 120 and (out["shapley"].sum(axis=2) == 120 * failing[:, None]).all()
    assert (out["removed"].sum(axis=2) == failing[:, None]).all() and (out["kept"][:, :, -1] == cells[:, 0, :1]).all()


def test_digests_are_of_the_text(spark):
    row = A.judged(docs(spark, [(1, "s", "é a")])).first()
    assert bytes(row["digest"]) == hashlib.sha256("é a".encode()).digest()


def test_hot_text_and_part_in_salts(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("hot").alias("source"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    got = found(A.filter_audit(df, labels(spark, []), broadcast_groups=0).collect())
    assert got["hot", "EABCD", 1][1] == 666

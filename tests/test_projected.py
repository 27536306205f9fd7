"""Bucketed candidates against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from broadsheet.operators import vectors as V


@pytest.fixture(scope="module")
def vectors(spark):
    """Groups of vectors at cosines around 0.90 and 0.98, of two models and two lengths, over five days."""
    rng, rows = np.random.default_rng(3), []
    for width, model in ((64, "a"), (64, "b"), (24, "b")):
        base = rng.standard_normal((150, width))
        base /= np.linalg.norm(base, axis=1)[:, None]
        for _ in range(500):
            v, n = base[rng.integers(150)], rng.standard_normal(width)
            n -= n @ v * v
            c = rng.choice([0.95, 0.97, 0.99, 0.995])
            w = c * v + math.sqrt(1 - c * c) * n / np.linalg.norm(n)
            rows.append((len(rows), model, w.astype(np.float32).tolist(), int(rng.integers(0, 5))))
    rows += [(len(rows), "a", [0.0] * 64, 0), (len(rows) + 1, "a", [], 0)]
    df = spark.createDataFrame(rows, "item_id long, model string, embedding array<float>, day int")
    return df.withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(day)")).drop("day").cache()


def pairs(df):
    got = [(r["a"], r["b"], r["similarity"]) for r in df.collect()]
    assert len(got) == len({(a, b) for a, b, _ in got})
    return {(a, b): s for a, b, s in got}


@pytest.mark.parametrize(("threshold", "bits"), [(0.90, 6), (0.98, 6), (0.98, 10)])
def test_recall_is_kept_and_each_pair_is_exact(vectors, threshold, bits):
    exact = pairs(V.similar_pairs(vectors, threshold))
    got = pairs(V.projected_pairs(vectors, threshold, bits=bits))
    assert len(exact) > 300 and all(exact[k] == s for k, s in got.items())
    assert len(got) >= 0.97 * len(exact)
    near = [k for k, s in exact.items() if s < threshold + 0.01]
    assert len(near) > 20 and sum(k in got for k in near) >= 0.9 * len(near)


def test_fewer_pairs_are_multiplied():
    """Tables times the share of pairs that a cell holds: below one from a few bits on."""
    for cosine, bits in ((0.90, 6), (0.90, 12), (0.98, 6), (0.98, 12)):
        assert V.planes_needed(cosine, bits, 0.98) / 2**bits < 0.2


def test_few_vectors_are_compared_whole(vectors):
    assert pairs(V.projected_pairs(vectors, 0.95)) == pairs(V.similar_pairs(vectors, 0.95))
    assert V.projected_pairs(vectors.limit(0), 0.95).collect() == []


def test_only_pairs_with_new_items(vectors):
    fresh = vectors.where("item_id % 7 = 0").select("item_id")
    new = {r["item_id"] for r in fresh.collect()}
    got = pairs(V.projected_pairs(vectors, 0.95, fresh=fresh, bits=4))
    whole = {k for k in pairs(V.projected_pairs(vectors, 0.95, bits=4)) if set(k) & new}
    assert set(got) == whole and whole

"""Rates against a plain nonnegative least squares solver, and the tokens that targets are about."""

import numpy as np
import public_tokenizers
import pytest

from broadsheet.llm import mixing
from broadsheet.llm.packing import pack, piece_tokens

JSON, RANKS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
MEDIUM = "/root/testdata/sf0.01"


def plain_rates(q, tokens, targets, weight=1e8):
    """Lawson and Hanson's nonnegative least squares on sum of t (r - 1)^2 + weight * squared misses; shares of the tokens."""
    t = tokens / tokens.sum()
    a = np.concatenate((np.sqrt(weight) * (q * t[:, None]).T, np.diag(np.sqrt(t))))
    b = np.concatenate((np.sqrt(weight) * targets, np.sqrt(t)))
    r, free = np.zeros(len(t)), np.zeros(len(t), bool)
    while (~free).any() and (slope := a.T @ (b - a @ r))[~free].max() > 1e-7:
        free[np.flatnonzero(~free)[np.argmax(slope[~free])]] = True
        while True:
            best = np.zeros(len(t))
            best[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if (best[free] > 0).all():
                break
            bad = free & (best <= 0)
            r = r + (r[bad] / (r[bad] - best[bad])).min() * (best - r)
            free &= r > 1e-12
        r = best
    return r


@pytest.mark.parametrize("weights", [(0.85, 0.1, 0.05), (0.96, 0.03, 0.01), (0.5, 0.45, 0.05)])
def test_rates_match_plain_nnls(spark, weights):
    """All three clip rates at 0."""
    r = np.random.default_rng(5)
    low = np.where(r.random(60) < 0.25, r.uniform(0.5, 1, 60), r.uniform(0.0, 0.03, 60))
    toxic = (1 - low) * np.where(r.random(60) < 0.2, r.uniform(0.4, 1, 60), r.uniform(0.0, 0.05, 60))
    q, tokens = np.stack((1 - low - toxic, toxic, low), 1), r.integers(20, 90, 60)
    members = spark.createDataFrame([(i, int(n), p) for i, (n, p) in enumerate(zip(tokens, q.tolist(), strict=True))], "doc_id long, tokens long, q array<double>")
    steps, got, targets = mixing.fit_rates(members, np.array(weights))
    found = mixing.rates(q, steps)
    want = plain_rates(q, tokens, np.array(weights))
    assert (want < 1e-9).any()
    assert np.allclose(got / targets.sum(), weights, atol=1e-4) and np.allclose((found * tokens) @ q, got)
    assert np.abs(found - want).max() < 0.01


def test_the_pipelines_targets_are_met(spark):
    """Also with a share of 0 for a domain that every document belongs to a little."""
    import corpus_pipeline

    d, y = (spark.read.parquet(f"{MEDIUM}/{x}.parquet") for x in ("documents", "labels"))
    kept = corpus_pipeline.quality(spark, d, MEDIUM)
    members, _ = mixing.membership(kept, y, "doc_id", "text", 2.0, piece_tokens(JSON, RANKS), d)
    steps, got, targets = mixing.fit_rates(members, np.array([corpus_pipeline.MIXTURE[k] for k in mixing.DOMAINS]))
    assert np.abs(got - targets).max() < 1e-3 * targets.sum()
    rows = members.toPandas()
    rate = mixing.rates(np.stack(rows.q), steps)
    clean = rows.doc_id.isin([r["doc_id"] for r in y.where("quality = 1 and toxic = 0").collect()])
    assert (rate[clean] >= 0.5).mean() > 0.98 and rate.max() < 3


def test_tokens_are_those_that_are_packed(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    y = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    members, _ = mixing.membership(d, y, "doc_id", "text", 2.0, piece_tokens(JSON, RANKS))
    packed = pack(d, JSON, RANKS).groupBy("doc_id").sum("length").collect()
    assert {r["doc_id"]: r["tokens"] for r in members.collect()} == {r[0]: r[1] for r in packed}


def test_odd_rows(spark):
    schema = "doc_id long, text string, tokens long, q int, rate int, bins int, x int"
    rows = [(i, t, 1, 2, 3, 4, 5) for i, t in [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "c"), (4, "word " * 60_000)]]
    labels = spark.createDataFrame([(3, 1, None), (4, None, 1), (9, 0, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = mixing.mix(spark.createDataFrame(rows, schema), labels, {"clean": 0.8, "toxic": 0.1, "low": 0.1}).collect()
    assert sorted((r["doc_id"] or 0, r["tokens"]) for r in got) == [(0, 1), (1, 0), (2, 0), (3, 2), (3, 2), (4, 60_000)]
    assert all(abs(r["p_clean"] + r["p_toxic"] + r["p_low"] - 1) < 1e-9 and r["rate"] >= 0 for r in got)
    empty = spark.createDataFrame([], schema)
    assert mixing.mix(empty, labels, {"clean": 0.8, "toxic": 0.1, "low": 0.1}).collect() == []
    drawn = mixing.drawn(spark.createDataFrame(rows, schema), labels, {"clean": 0.8, "toxic": 0.1, "low": 0.1})
    copies = {i: sum(r["copies"] for r in got if r["doc_id"] == i) for i in (None, 1, 2, 3, 4)}
    assert drawn.columns == schema.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert {i: sum(r["doc_id"] == i for r in drawn.collect()) for i in copies} == copies

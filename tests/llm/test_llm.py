import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from broadsheet.llm import html_text, lm_scores, mixing, packing, quality, repeats, repetition, simhash, token_counts
from broadsheet.llm.components import components
from broadsheet.llm.exact_dedup import exact_dedup
from broadsheet.llm.oracles import ORACLES
from broadsheet.llm.queries import QUERIES

from ..oracle import assert_same, connect

SMALL = "/root/testdata/sf0.001"
JSON, RANKS, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))
SCHEMA = "doc_id long, text string, digest string, rank int, bucket int"


def docs(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "d", 7, 1) for i, t in rows], SCHEMA)


LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor " * 4000
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "A b\nc"), (5, "a B C d e"), (5, "a B C d e"), (6, "Abc"), (7, "a b c"), (8, LONG), (9, LONG + " x"), (10, "éß 日本 <|endoftext|> '  x"), (None, "no id")]


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet"), dict(connect(SMALL).sql("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    assert_same(QUERIES[name](spark, SMALL), connect(SMALL), ORACLES[name])


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


#: Names of the operators' own columns.
CLASHES = "fp key component_id salt x y block flag bins digest rank bucket body n_points n sha contents choice bits rep part piece length sequence_id score held_out n_tokens n_bytes kept".split()


def clashing(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(7).alias(c) for c in CLASHES))


def fields(got, *names):
    return sorted(((r["doc_id"] if r["doc_id"] is not None else -1, *(r[n] for n in names)) for r in got), key=str)


def test_odd_rows_simhash(spark):
    got = simhash.simhash_groups(clashing(spark, ODD)).collect()
    want = []
    for i, t in ODD:
        f = plain_fingerprint(t or "")
        same = [j for j, u in ODD if j is not None and (plain_fingerprint(u or "") ^ f).bit_count() <= 4]
        want.append((i if i is not None else -1, f"{f:016x}", min(same, default=None)))
    assert fields(got, "fingerprint", "component_id") == sorted(want, key=str)
    assert simhash.simhash_groups(clashing(spark, [])).collect() == []


def test_links_through_rows_without_ids(spark, monkeypatch):
    """Two texts four bits apart from a third that only a row without an id has; and a component without any id."""
    monkeypatch.setattr(simhash, "fingerprints", lambda texts, width: np.array([int(t) if t else 0 for t in texts], np.uint64))
    rows = [(5, "15"), (None, "255"), (9, "4095"), (None, str(2**60 - 1)), (7, str((2**20 - 1) << 20))]
    for agree in (2, 3, 4):
        monkeypatch.setattr(simhash, "agreeing", lambda n, radius, agree=agree: agree)
        got = {r["fingerprint"]: r["component_id"] for r in simhash.simhash_groups(docs(spark, rows)).collect()}
        assert got == {f"{15:016x}": 5, f"{255:016x}": 5, f"{4095:016x}": 5, f"{2**60 - 1:016x}": None, f"{(2**20 - 1) << 20:016x}": 7}


def test_components_reach_rows_within_salts(spark, small, monkeypatch):
    """What a broadcast gives, a salted join gives too."""
    df, texts = small
    want = [(r["doc_id"], r["component_id"]) for r in simhash.simhash_groups(df).collect()]
    near = [(r["doc_id"], r["component_id"]) for r in simhash.near_groups(df).collect()]
    monkeypatch.setattr(simhash, "BROADCAST_LABELS", -1)
    assert sorted((r["doc_id"], r["component_id"]) for r in simhash.simhash_groups(df).collect()) == sorted(want)
    assert sorted((r["doc_id"], r["component_id"]) for r in simhash.near_groups(df).collect()) == sorted(near)


def test_shards_stay_small():
    assert [simhash.agreeing(n) for n in (10, 60 * 10**6, 10**9, 10**10, 10**12)] == [2, 2, 3, 4, 4]


def test_odd_rows_near(spark):
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(clashing(spark, ODD)).collect() if r["doc_id"] is not None}
    # Texts without words, and those whose lower-cased words are the same shingle.
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 4, 8: 8, 9: 8, 10: 10}
    assert simhash.near_groups(clashing(spark, [])).collect() == []


def test_odd_rows_repetition(spark):
    got = repetition.repetition_rules(clashing(spark, ODD)).collect()
    words = lambda t: (t or "").encode().split()
    assert fields(got, "n_words", "word_chars") == sorted(((i if i is not None else -1, len(words(t)), sum(len(w.decode()) for w in words(t))) for i, t in ODD), key=str)
    assert all(r["base_failed"] and not r["kept"] for r in got)
    assert repetition.repetition_rules(clashing(spark, [])).collect() == []


def test_odd_rows_packing(spark):
    got = packing.pack(clashing(spark, ODD), JSON, RANKS).collect()
    exact = packing._exact(JSON)
    want = Counter()
    for i, t in ODD:
        want[i] += len(exact.encode(t or "", add_special_tokens=False).ids) + 1
    total = Counter()
    for r in got:
        total[r["doc_id"]] += r["length"]
    assert total == want and Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter(i for i, _ in ODD)
    assert packing.pack(clashing(spark, []), JSON, RANKS).collect() == []


@pytest.mark.parametrize("groups", [10**6, 0])
def test_odd_rows_exact(spark, groups):
    """Groups sent to all tasks, and met within salts."""
    got = exact_dedup(clashing(spark, ODD), broadcast_groups=groups).collect()
    want = [(-1, None, 1, True), (1, 3, 3, False), (2, 3, 3, False), (3, 3, 3, True), (4, 4, 2, True), *[(5, 5, 2, True)] * 2, (6, 4, 2, False), (7, 7, 1, True), (8, 8, 1, True), (9, 9, 1, True), (10, 10, 1, True)]
    assert fields(got, "keep_id", "group_size", "kept") == sorted(want, key=str)
    assert exact_dedup(clashing(spark, []), broadcast_groups=groups).collect() == []


def test_odd_rows_quality(spark):
    y = labels(spark, [(4, 1, 0), (6, 0, None), (7, None, 1), (8, 0, 1), (None, 1, 1), (99, 1, 0)])
    got = quality.quality_scores(clashing(spark, ODD), y).collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["doc_id"] or -1)] == sorted((i for i, _ in ODD), key=lambda i: i or -1)
    assert all(r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1 and len({r["score"] for r in got if r["doc_id"] == 5}) == 1
    assert {r["score"] for r in quality.quality_scores(clashing(spark, ODD), labels(spark)).collect()} == {0.5}
    assert quality.quality_scores(clashing(spark, []), y).collect() == []
    kept = quality.keep_quality(clashing(spark, ODD), y)
    assert kept.columns == ["doc_id", "text", *CLASHES] and fields(kept.collect()) == sorted([(r["doc_id"] if r["doc_id"] is not None else -1,) for r in got if r["predicted"]], key=str)


def test_odd_rows_tokens(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    got = token_counts.token_counts(clashing(spark, ODD), WORDS).collect()
    assert fields(got, "n_bytes", "n_tokens", "over_limit") == sorted(((i if i is not None else -1, len((x or "").encode()), n, n > 2048) for i, x in ODD for n in [len(t.encode(x or "", add_special_tokens=False).ids)]), key=str)
    assert token_counts.token_counts(clashing(spark, []), WORDS).collect() == []


# --- exact dedup ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("digest, broadcast", [(None, 10), (lambda c: F.substring(F.sha2(c, 256), 1, 1), 0)])
def test_exact_dedup(spark, small, digest, broadcast):
    df, texts = small
    options = {"broadcast_keys": broadcast} | ({"digest": digest} if digest else {})
    got = {r["doc_id"]: r for r in exact_dedup(df, **options).collect()}
    body = {i: t.translate(dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))) for i, t in texts.items()}
    groups = {}
    for i, b in body.items():
        groups.setdefault(b, []).append(i)
    for own in groups.values():
        keep = min(own, key=lambda i: (-len(texts[i]), i))
        for i in own:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (keep, len(own), i == keep)
            assert got[i]["text_sha256"] == hashlib.sha256(body[i].encode()).hexdigest()


# --- SimHash -------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    import xxhash

    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_matches_brute_force(spark, small):
    df, texts = small
    got = {r["doc_id"]: r for r in simhash.simhash_groups(df).collect()}
    fp = {i: plain_fingerprint(t) for i, t in texts.items()}
    up = {i: i for i in texts}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 4 and find(a) != find(b):
                low, high = sorted((find(a), find(b)))
                up[high] = low
    assert all(got[i]["fingerprint"] == f"{fp[i]:016x}" and got[i]["component_id"] == find(i) for i in ids)


def test_shards_lose_no_link(spark):
    """A dense ball of fingerprints and random ones, against all pairs."""
    r = np.random.default_rng(3)
    centre = int(r.integers(0, 2**63))
    near = {centre ^ sum(1 << int(b) for b in r.choice(64, k, replace=False)) for k in (1, 2, 3, 4, 5, 6, 8) for _ in range(40)}
    values = sorted(near | {int(x) for x in r.integers(0, 2**63, 300)})
    tree, links = simhash.BKTree(4), set()
    for k, v in enumerate(values):
        links |= {(t, k) for t in tree.add(v)}
    roots = [tree.find(k) for k in range(len(values))]
    for a in range(len(values)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= 4:
                assert roots[a] == roots[b]
    assert all((values[a] ^ values[b]).bit_count() <= 4 for a, b in links)
    for a in values[:60]:
        for b in values[:60]:
            if (a ^ b).bit_count() <= 4:
                keys = [{(i, (x >> s1 & (1 << w1) - 1), (x >> s2 & (1 << w2) - 1)) for i, ((s1, w1), (s2, w2)) in enumerate(__import__("itertools").combinations(simhash.block_bounds(6), 2))} for x in (a, b)]
                assert keys[0] & keys[1]


def test_near_groups_catch_near_copies(spark):
    """Copies with a share of their words changed, against clean texts that share a passage."""
    r = np.random.default_rng(8)
    word = lambda: bytes(r.integers(97, 123, int(r.integers(2, 9)), dtype=np.uint8)).decode()
    texts, near, passage = {}, [], [word() for _ in range(30)]
    for k in range(120):
        words = [word() for _ in range(int(r.integers(80, 600)))]
        texts[10 * k] = " ".join(words + passage)
        changed = list(words + passage)
        for i in r.choice(len(changed), max(1, len(changed) // 100), replace=False):
            changed[i] = word()
        texts[10 * k + 1] = " ".join(changed)
        sets = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in (texts[10 * k].split(), changed)]
        near.append((10 * k, len(sets[0] & sets[1]) / len(sets[0] | sets[1])))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs(spark, sorted(texts.items()))).collect()}
    sure = [i for i, j in near if j >= 0.85]
    assert len(sure) > 80 and np.mean([got[i + 1] == i for i in sure]) >= 0.95
    assert all(got[i] == i for i, _ in near)


def test_near_groups_hold_to_the_exact_similarity(spark):
    """Pairs a little over 0.8 are linked and pairs a little under it are not; a line said many times counts once."""
    r = np.random.default_rng(21)
    word = lambda: bytes(r.integers(97, 123, int(r.integers(4, 9)), dtype=np.uint8)).decode()
    texts, similar = {}, {}
    for k in range(300):
        words = [word() for _ in range(int(r.integers(9, 14) if k % 5 == 0 else r.integers(40, 500)))]
        # Words changed at the end, so that the similarity is (n - d) / (n + d) of n shingles.
        n, want = len(words) - 4, r.uniform(0.8, 0.85) if k % 2 else r.uniform(0.74, 0.8)
        d = max(1, round(n * (1 - want) / (1 + want)))
        changed = words[: len(words) - d] + [word() for _ in range(d)]
        texts[10 * k], texts[10 * k + 1] = " ".join(words), " ".join(changed)
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words, changed))
        similar[10 * k] = len(a & b) / len(a | b)
    line = " ".join(word() for _ in range(6))
    for k in (5000, 5001):
        texts[k] = " ".join([line] * 300 + [word() for _ in range(30)])
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs(spark, sorted(texts.items()))).collect()}
    over = [i for i, j in similar.items() if j >= 0.8]
    assert min(len(over), 300 - len(over)) > 100
    assert np.mean([got[i + 1] == i for i in over]) >= 0.99
    assert all(got[i + 1] == i + 1 for i in similar if i not in over) and got[5001] == 5001


def test_alike_is_exact_in_tiles():
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 62, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate((base[r.random(60) < 0.93], r.integers(0, 1 << 62, int(r.integers(1, 6))).astype(np.uint64)))) for _ in range(60)]
    near = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))

    def groups(links):
        label = list(range(len(sets)))
        for a, b in links:
            label = [label[a] if x == label[b] else x for x in label]
        return label

    for cut in (0, 25):
        want = [(a, b) for b in range(len(sets)) for a in range(b) if (not cut or a < cut <= b) and near(sets[a], sets[b])]
        same = lambda x: [[u == v for v in x] for u in x]
        got = simhash.alike(sets, 0.8, cut)
        assert set(got) <= set(want) and same(groups(got)) == same(groups(want))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7), (200, 300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == got[102] == got[100] == 100 and got[300] == 200


# --- repetition ----------------------------------------------------------------------------------------


def test_repetition_base_columns(spark, small):
    df, texts = small
    for r in repetition.repetition_rules(df).collect():
        text = texts[r["doc_id"]]
        words = text.encode().split()
        lines = text.split("\n")
        with_word = [x for x in lines if x.strip(" \t\x0b\x0c\r")]
        threes = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        marked = {j for i in range(len(words) - 2) if threes[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        want = (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(with_word) - len(set(with_word)), len(marked))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(words) < 50 or 100 * len(marked) > 50 * len(words))
        assert not (r["kept"] and r["base_failed"])


def plain_shares(text):
    """By sets of positions: the largest share of word characters in duplicated 5- to 10-grams, and that in equal lines."""
    words = text.encode().split()
    size = [len(w.decode()) for w in words]
    worst = 0.0
    for n in range(5, 11):
        seen = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        inside = {k for i in range(len(words) - n + 1) if seen[tuple(words[i : i + n])] > 1 for k in range(i, i + n)}
        worst = max(worst, sum(size[k] for k in inside) / max(1, sum(size)))
    lines = [x for x in text.split("\n") if x.encode().split()]
    return worst, sum(len(w.decode()) for x in lines if lines.count(x) > 1 for w in x.encode().split()) / max(1, sum(size))


def test_repetition_shares(spark, small):
    df, texts = small
    r = np.random.default_rng(3)
    made = {10**6 + k: "\n".join(" ".join(f"wört{x}" for x in r.integers(0, 4, int(r.integers(1, 9)))) for _ in range(int(r.integers(1, 12)))) for k in range(60)}
    both = df.select("doc_id", "text").unionByName(spark.createDataFrame(sorted(made.items()), "doc_id long, text string"))
    repeated = 0
    for row in repetition.repetition_rules(both).collect():
        n, line = plain_shares((texts | made)[row["doc_id"]])
        assert row["ngram_share"] == pytest.approx(n) and row["line_share"] == pytest.approx(line)
        repeated += n > 0 and line > 0
    assert repeated >= 5


def test_repetition_verdicts():
    rules = repetition.Rules()
    clean = b" ".join(b"word%d" % i for i in range(300))
    loop = b" ".join(b"word%d" % i for i in range(120)) + b" " + b" ".join(b"alpha bravo charlie delta echo foxtrot golf hotel india juliett k%d" % (i % 2) for i in range(8))
    assert repetition.measure(clean, rules)[6] and not repetition.measure(loop, rules)[6]


# --- packing -------------------------------------------------------------------------------------------


def test_packing(spark, small):
    df, texts = small
    got = packing.pack(df, JSON, RANKS).collect()
    exact = packing._exact(JSON)
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, text in texts.items():
        ids = np.array([*exact.encode(text, add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["start"] for r in pieces] == np.cumsum([0, *(r["length"] for r in pieces)])[:-1].tolist() and sum(r["length"] for r in pieces) == len(ids)
        assert len(pieces) == 1 or all(r["length"] == 2048 for r in pieces[1:])
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in pieces)
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist() and sum(r["length"] for r in own) <= 2048
    total = sum(r["length"] for r in got)
    assert len(by_sequence) <= math.ceil(total / 2048) * 1.01 + 1


def test_encoders_agree():
    r = np.random.default_rng(5)
    exact, fast = packing._exact(JSON), packing._fast(RANKS)
    for _ in range(400):
        text = "".join(map(chr, r.choice([*range(9, 14), *range(32, 127), *range(0xA0, 0x300)], int(r.integers(0, 40)))))
        if "<|" not in text:
            assert exact.encode(text, add_special_tokens=False).ids == fast.encode_ordinary(text)


@pytest.mark.parametrize("rule", ["residual_norm", "dot_product"])
def test_capacities_hold(rule):
    limits = packing.Limits(tokens=100, documents=3, attention=5000, rule=rule)
    histogram = {60: 5, 40: 9, 20: 30, 3: 50, 1: 10}
    plan = packing.best_fit(histogram, limits)
    held = {}
    for length, runs in plan.runs.items():
        ends = [r[0] for r in runs[1:]] + [histogram[length]]
        for (rank, first, offset), end in zip(runs, ends, strict=True):
            for k in range(end - rank):
                held.setdefault(first + k, []).append((offset, length))
    assert sum(map(len, held.values())) == sum(histogram.values())
    for own in held.values():
        own.sort()
        assert sum(x for _, x in own) <= 100 and len(own) <= 3 and sum(x * x for _, x in own) <= 5000
        assert [o for o, _ in own] == np.cumsum([0, *(x for _, x in own)])[:-1].tolist()


# --- repeats -------------------------------------------------------------------------------------------


def brute(texts, length):
    count = Counter(b[i : i + length] for b in texts.values() for i in range(len(b) - length + 1))
    return {i: np.array([count[b[k : k + length]] > 1 for k in range(len(b) - length + 1)], bool) for i, b in texts.items()}


@pytest.mark.parametrize("length, gram, crowd, block", [(200, 64, 2048, 100_000), (40, 16, 1, 20_000)])
def test_repeats_match_brute_force(spark, small, length, gram, crowd, block):
    df, texts = small
    raw = {i: t.encode() for i, t in texts.items()}
    starts = brute(raw, length)
    for r in repeats.remove_repeats(df, length=length, gram=gram, crowd=crowd, block_bytes=block, with_kept=True).collect():
        gone, spans, left = repeats.removed(raw[r["doc_id"]], starts[r["doc_id"]], length)
        assert (r["n_removed"], r["n_spans"], bytes(r["kept"])) == (gone, spans, left) and r["kept_sha256"] == hashlib.sha256(left).hexdigest()


def test_keeping_first_leaves_each_string_once(spark, small):
    df, texts = small
    kept = [bytes(r["kept"]) for r in repeats.remove_repeats(df, block_bytes=50_000, keep_first=True, with_kept=True).collect()]
    before = {b[i : i + 200] for b in (t.encode() for t in texts.values()) for i in range(len(b) - 199)}
    after = Counter(b[i : i + 200] for b in kept for i in range(len(b) - 199))
    assert max(v for k, v in after.items() if k in before) == 1


def test_runs_across_slices_of_a_long_text(monkeypatch):
    monkeypatch.setattr(repeats, "_SLICE", 1000)
    data = bytes(np.random.default_rng(1).integers(97, 123, 4000, dtype=np.uint8))
    _, place, first, last = repeats.anchors(data, 200, 64)
    assert (last - first + 1).sum() == 3801 and (place >= first).all() and (place + 64 <= last + 200).all()


# --- quality, mixing -----------------------------------------------------------------------------------


def test_quality_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    y = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.quality_scores(d, y).where("held_out").join(y, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.97


def test_mixing_meets_targets(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    y = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    want = {"clean": 0.85, "toxic": 0.09, "low": 0.06}
    got = mixing.mix(d, y, want).toPandas()
    total = got.tokens.sum()
    for k, share in want.items():
        assert abs((got.rate * got.tokens * got[f"p_{k}"]).sum() / total - share) < 1e-3
    assert (got.rate >= 0).all() and (abs(got.copies - got.rate) < 1).all()
    rows = mixing.drawn(d, y, want)
    assert rows.columns == d.columns
    assert Counter(r["doc_id"] for r in rows.collect()) == Counter({i: c for i, c in zip(got.doc_id.tolist(), got.copies.tolist(), strict=True) if c})


def test_rates_meet_targets_near_the_edge(spark, caplog):
    """Most rates of low documents are clipped at zero before these targets are met; others can't be met at all."""
    r = np.random.default_rng(11)
    low = np.where(r.random(3000) < 0.2, r.uniform(0.5, 1, 3000), r.uniform(0.001, 0.03, 3000))
    toxic = (1 - low) * np.where(r.random(3000) < 0.1, r.uniform(0.3, 1, 3000), r.uniform(0.0, 0.05, 3000))
    q = np.stack((1 - low - toxic, toxic, low), 1)
    members = spark.createDataFrame([(i, int(r.integers(20, 900)), p) for i, p in enumerate(q.tolist())], "doc_id long, tokens long, q array<double>")
    steps, got, targets = mixing.fit_rates(members, np.array([0.945, 0.05, 0.005]))
    tokens = np.array([row["tokens"] for row in members.orderBy("doc_id").collect()])
    assert np.abs(got - targets).max() < 1e-4 * targets.sum() and not caplog.records
    assert np.allclose((mixing.rates(q, steps) * tokens) @ q, got)
    _, got, targets = mixing.fit_rates(members, np.array([0.5, 0.4999, 0.0001]))
    assert "out of reach" in caplog.text and abs(got.sum() / targets.sum() - 1) < 0.01


def test_a_toxic_word_is_not_diluted_by_others(spark):
    """Of two words with the same 14 low bits, one tells of toxic texts and the other of clean ones."""
    seen, pair = {}, None
    for n in range(100000):
        w = f"w{n}"
        other = seen.setdefault(zlib.crc32(w.encode()) & (1 << 14) - 1, w)
        if other != w:
            pair = other, w
            break
    rows = [(i, f"some text number n{i} with {pair[i % 2]} in it") for i in range(400)]
    got = mixing.mix(docs(spark, rows), labels(spark, [(i, 1 if i % 3 else 0, i % 2) for i in range(300)]), {"clean": 0.6, "toxic": 0.2, "low": 0.2}).toPandas()
    share = got.p_toxic / (got.p_toxic + got.p_clean)
    assert share[got.doc_id % 2 == 1].min() > 0.8 and share[got.doc_id % 2 == 0].max() < 0.2


def test_word_bins_round_trip():
    r = np.random.default_rng(2)
    for n in (0, 1, 5, 800):
        words = [bytes(r.integers(97, 123, 6, dtype=np.uint8)) for _ in range(n)]
        assert mixing.bins_of(mixing.word_bins(words)).tolist() == sorted({zlib.crc32(w) & mixing.BINS - 1 for w in words})


# --- HTML ----------------------------------------------------------------------------------------------

PAGE = """<html><head><title>T</title></head><body class="has-sidebar"><header><h1>Site</h1></header><nav>menu</nav><main><article><header class="entry-header"><h1>Title &amp; more</h1></header>
<p>One <b>two<p>three</b> four &nbsp; five<ul><li>a<li>b</ul><div class="share-bar">share</div><section id="comments"><article class="comment">hi</article></section><form>f</form>
<table><tr><td>1<td>2</table><span class="ad">buy</span> tail<script>if(a<b)</script></article></main><aside>x</aside><footer>f"""


def test_html_blocks():
    assert html_text.main_text(html_text.read_page(PAGE)) == "Title & more\nOne two\nthree four five\na\nb\n1\n2\ntail"
    named = '<body><div class="top">x</div><div id="content"><h2>H</h2><p>words</p><ins class="adsbygoogle">buy</ins></div><div class="side-bar sidebar">y</div>'
    assert html_text.main_text(html_text.read_page(named)) == "H\nwords"
    for odd in ("", "<", "<p", "<!-- x", "</p></p>", "<div" * 50, "<b>" * 3000 + "x", "a < b & c", "<script>never closed"):
        html_text.read_page(odd)


def test_site_templates(spark):
    page = lambda i, host: (i, f"https://{host}/{i}", f"<body><div><p>welcome to the site</p></div><div><p>text {i} of it</p></div></body>")
    rows = [page(i, "a.example") for i in range(20)] + [page(i, "b.example") for i in range(20, 24)] + [(90 + i, "https://c.example/x", "<p>copied page</p>") for i in range(30)]
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "text 3 of it" and got[21] == "welcome to the site\ntext 21 of it" and got[95] == "copied page"


def test_templates_of_several_layouts(spark):
    """Three layouts of a host, each on a third of its pages, and a promotion on a tenth of them."""
    promo = lambda i: "<div><p>buy now</p></div>" if i % 10 == 0 else ""
    rows = [(i, f"https://a.example/{i}", f"<body><div><p>layout {i % 3}</p></div>{promo(i)}<div><p>text {i} of it</p></div></body>") for i in range(150)]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: f"text {i} of it" for i in range(150)}


def test_pages_of_the_small_table(spark):
    assert QUERIES["op8_html_extraction"](spark, SMALL).where("n_chars = 0 or n_chars <> length(text)").count() == 0


# --- tokens --------------------------------------------------------------------------------------------


def test_token_counts(spark, small):
    df, texts = small
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    for r in token_counts.token_counts(df, WORDS).collect():
        n = len(t.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(texts[r["doc_id"]].encode()), n > 2048)


def test_pieces_of_long_texts_count_alike():
    text = "Some words, don't 123 <|endoftext|> éé 日本 x\n" * 200
    assert "".join(token_counts.safe_pieces(text, 50)) == text
    assert token_counts.lengths([text, "", text], WORDS, 300, 50) == token_counts.lengths([text, "", text], WORDS)


def test_tokens_are_those_of_the_words():
    """Marks, white space of all kinds, letters that lower-case to several, and special strings beside spaces and line ends."""
    from tokenizers import Tokenizer

    t, r = Tokenizer.from_file(WORDS), random.Random(5)
    signs = [" ", "\n", " \n ", "\t", "\r", "\v", "\x85", "\u00a0", "\u2028", "\u3000", "\u0301", "\u0338", "\u1161", "\u1100", "'", "'s", "'LL", "a", "É", "e\u0301", "ΑΣ", "İ", "ß", "7", "½", "##", "<|endoftext|>", "<|", "|>", "한국", "字", "\U0001f600", "\u200d", "\0", "word" * 30]
    texts = ["".join(r.choices(signs, k=r.randint(0, 60))) for _ in range(3000)]
    assert token_counts._drops_blanks(WORDS) and not token_counts._drops_blanks(JSON)
    for path, exact in ((WORDS, t), (JSON, Tokenizer.from_file(JSON))):
        assert token_counts.lengths(texts, path, 500) == [len(x) for x in exact.encode_batch_fast(texts, add_special_tokens=False)]


def test_each_word_is_encoded_once(monkeypatch):
    calls, real = [], token_counts._tokenizer(WORDS)

    class Counted:
        def encode_batch_fast(self, some, **more):
            calls.extend(some)
            return real.encode_batch_fast(some, **more)

    monkeypatch.setattr(token_counts, "_tokenizer", lambda path: Counted())
    text, words = "Zwölfmal dieselben quorbige Wörter\n" * 3000, ("Zwölfmal", "dieselben", "quorbige", "Wörter")
    assert token_counts.lengths([text, text], WORDS) == [3000 * sum(len(real.encode(w).ids) for w in words)] * 2
    assert len(calls) <= len(words)

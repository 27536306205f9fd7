"""Language-model scores: prediction by partial matching, beside an add-one word model.

PPM: a trie of byte contexts of up to `depth` bytes, over all 256 bytes and a text's bounds, pretrained on all
training texts.  A context's distribution is escape method C with exclusion: a symbol seen in it takes
n / (T + D), an unseen one the escape D / (T + D) times what the next shorter context gives it among the
symbols not seen in the longer one.  No context is pruned, so the trie grows with the corpus.  Counts are
added up in each map task and then by context.  A trie of up to `broadcast_grams` strings goes to every
executor; a larger one stays where it was counted, and blocks of documents ask there for the strings they hold.

Word model: exact counts of all words, added up in each map task and then by word (a 96-bit hash of it).
A block asks once for each of its distinct words.

Tables are kept in ranges of their keys and looked up by `lookups`: tables are copied to several tasks, so
that the ranges grow with what is known, not with how many blocks ask.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import block_rows, blocks, texts_of, with_text
from .common import arrow_map, new_table, shuffle_width, split_by, written
from .lookups import ROW, added_up, first_ones, gathered, lookups, pack_totals, range_of, ranges_for, route, rows_of, sum_codes, totals_of, unpack_totals
from .quality import held_out

#: The token that ends a text; no word holds a space.
END = b" "
#: A byte's symbol is the byte; one more stands for a text's bounds.  Each takes BITS bits of a string's code.
BOUND, SYMBOLS, BITS = 256, 257, 9
_LOW = np.uint64((1 << BITS) - 1)
_ONE = np.uint64(BITS)
#: Places whose codes are held at once.
AT_ONCE = 1 << 21
#: Up to so many strings (with their shorter contexts about 50 bytes each) the trie goes to every executor.
BROADCAST_GRAMS = 2_000_000


# --- words ------------------------------------------------------------------------------------------


def word_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of each word's XXH3 as a uint64 and a uint32."""
    from xxhash import xxh3_128_digest

    flat = np.frombuffer(b"".join(map(xxh3_128_digest, words)), "<u8").reshape(-1, 2)
    return flat[:, 0].copy(), flat[:, 1].astype(np.uint32)


# --- prediction by partial matching -------------------------------------------------------------------


def gram_slices(texts: list[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(codes, texts, lengths): codes of some places and how many of them belong to which text, in order.

    A code holds the bytes before a place, the nearest one highest, and its own symbol lowest; so the first bits of a
    code are its shorter contexts.  Before a text stand bounds, and one ends it.  A long text comes in several slices.
    """
    lengths = np.array([len(t) for t in texts], np.int64) + 1
    ends = np.cumsum(lengths + depth)
    starts = ends - lengths
    flat = np.full(int(ends[-1]) if len(ends) else 0, BOUND, np.uint16)
    for text, start in zip(texts, starts.tolist(), strict=True):
        flat[start : start + len(text)] = np.frombuffer(text, np.uint8)
    for a in range(depth, len(flat), AT_ONCE):
        b = min(a + AT_ONCE, len(flat))
        wide = flat[a - depth : b].astype(np.uint64)
        code = wide[depth:].copy()
        for k in range(1, depth + 1):
            code |= wide[depth - k : len(wide) - k] << np.uint64(BITS * (depth + 1 - k))
        first, last = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
        own = np.arange(first, last)
        low, high = np.maximum(starts[own], a) - a, np.minimum(ends[own], b) - a
        inside = np.zeros(b - a + 1, np.int8)
        np.add.at(inside, low, 1)
        np.add.at(inside, high, -1)
        yield code[np.cumsum(inside[:-1]) > 0], own, high - low


def count_grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.unique(code, return_counts=True) for code, _, _ in gram_slices(texts, depth)]
    return sum_codes([p[0] for p in parts], [p[1] for p in parts])


class Level:
    """Strings of one context length and their contexts: total T, kinds D, and what the context's symbols count in the
    next shorter context."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray) -> None:
        self.grams, self.counts = grams, counts
        first = first_ones(grams >> _ONE)
        self.contexts = grams[first] >> _ONE
        self.total = np.add.reduceat(counts, first) if len(first) else counts
        self.kinds = np.diff(np.append(first, len(grams)))
        self.shorter = np.zeros(len(first), np.int64)
        self.first = first

    def below(self, lower: Level) -> None:
        n = find(lower.grams, self.grams >> _ONE >> _ONE << _ONE | self.grams & _LOW)
        self.shorter = np.add.reduceat(lower.counts[n], self.first) if len(self.first) else self.shorter


def find(ordered: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted value stands in ordered, or -1."""
    if not len(ordered):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(ordered, wanted), len(ordered) - 1)
    return np.where(ordered[at] == wanted, at, -1)


class Trie:
    """Log10 probabilities of symbols after their contexts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, depth: int, base: list[Level] | None = None) -> None:
        """From the sorted codes of the longest strings.  With `base`, the levels of its lengths come from there."""
        self.depth = depth
        least = len(base) if base else 0
        levels = {depth: Level(grams, counts.astype(np.int64))}
        for j in range(depth - 1, least - 1, -1):
            above = levels[j + 1]
            levels[j] = Level(*sum_codes([above.grams >> np.uint64(2 * BITS) << _ONE | above.grams & _LOW, np.zeros(0, np.uint64)], [above.counts, np.zeros(0, np.int64)]))
        self.levels = [*(base or []), *(levels[j] for j in range(least, depth + 1))]
        for j in range(max(1, least), depth + 1):
            self.levels[j].below(self.levels[j - 1])

    def logs(self, wanted: np.ndarray) -> np.ndarray:
        """For codes of the longest strings."""
        out = np.zeros(len(wanted))
        left, scale = np.arange(len(wanted)), np.ones(len(wanted))
        cut_total, cut_kinds = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
        for j in range(self.depth, -1, -1):
            level = self.levels[j]
            own = wanted[left]
            context = own >> np.uint64(BITS * (self.depth + 1 - j))
            at = find(level.contexts, context)
            seen = find(level.grams, context << _ONE | own & _LOW)
            known = at >= 0
            kinds = np.where(known, level.kinds[at] if len(level.kinds) else 0, 0)
            # What the longer context has seen is excluded here.
            total = np.where(known, level.total[at] if len(level.total) else 0, 0) - cut_total
            fresh = kinds - cut_kinds
            # Where every symbol has been seen, nothing is left to escape to.
            whole = np.maximum(total + np.where(kinds == SYMBOLS, 0, fresh), 1)
            hit = seen >= 0
            out[left[hit]] = np.log10(scale[hit] * level.counts[seen[hit]] / whole[hit])
            scale = np.where(fresh > 0, scale * fresh / whole, scale)[~hit]
            cut_total = np.where(known, level.shorter[at] if len(level.shorter) else 0, 0)[~hit]
            cut_kinds, left = kinds[~hit], left[~hit]
        out[left] = np.log10(scale / np.maximum(SYMBOLS - cut_kinds, 1))
        return out


def text_logs(texts: list[bytes], depth: int, logs: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Each text's log10 probability."""
    out = np.zeros(len(texts))
    for code, own, n in gram_slices(texts, depth):
        found, at = np.unique(code, return_inverse=True)
        ends = np.concatenate(([0.0], np.cumsum(logs(found)[at.reshape(-1)])))[np.concatenate(([0], np.cumsum(n)))]
        out[own] += np.diff(ends)
    return out


def part_of(grams: np.ndarray, depth: int, parts: int) -> np.ndarray:
    """By the two symbols before: all contexts of two symbols and more are in one part."""
    near = grams >> np.uint64(BITS * (depth - 1))
    return ((near * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def build_words(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return added_up(*(np.concatenate([np.zeros(0, t), *(np.frombuffer(r[j], t) for r in rows)]) for j, t in enumerate((np.uint64, np.uint32, np.int64))))


def answer_words(known, block: int, a: bytes, b: bytes) -> bytes:
    return pack_totals(totals_of(known, np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint32)))


# --- the operator -------------------------------------------------------------------------------------


def distinct_words(lists: list[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of the lists and END, their keys in order, and which word each of these is."""
    words = list(dict.fromkeys(w for own in lists for w in own)) + [END]
    high, low = word_keys(words)
    order = np.lexsort((low, high))
    return words, high[order], low[order], order


def _survey(width: int, depth: int | None):
    """What each block asks for (kind ask), and what a task's training texts count: words and, with a depth, strings by range."""

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(kind: str, found: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int32(), *[pa.binary()] * 3)
            return pa.RecordBatch.from_arrays([pa.array([x[j] for x in [(kind, *r) for r in found]], k) for j, k in enumerate(kinds)], names=["kind", "block", "part", "a", "b", "c"])

        words: list[tuple] = [(np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64))]
        codes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for batch in batches:
            for number, _, ends, flags, body in block_rows(batch):
                texts = texts_of(ends, body)
                lists = [t.lower().split() for t in texts]
                distinct, high, low, order = distinct_words(lists)
                yield rows("ask", [(number, None, high.tobytes(), low.tobytes(), None)])
                taught: Counter = Counter()
                for own, flag in zip(lists, flags, strict=True):
                    if flag:
                        taught.update(own)
                taught[END] = sum(flags)
                times = np.fromiter(map(taught.__getitem__, distinct), np.int64, len(distinct))[order]
                words.append((high[times > 0], low[times > 0], times[times > 0]))
                if depth is not None:
                    grams = count_grams([t for t, flag in zip(texts, flags, strict=True) if flag], depth)
                    codes.append(grams[0])
                    counts.append(grams[1])
                if sum(len(w[0]) for w in words[1:]) > len(words[0][0]) + (1 << 20):
                    words = [added_up(*(np.concatenate(c) for c in zip(*words, strict=True)))]
                if sum(map(len, codes[1:])) > len(codes[0]) + (1 << 20):
                    merged = sum_codes(codes, counts)
                    codes, counts = [merged[0]], [merged[1]]
        high, low, times = added_up(*(np.concatenate(c) for c in zip(*words, strict=True)))
        yield rows("word", [(None, p, high[own].tobytes(), low[own].tobytes(), times[own].tobytes()) for p, own in split_by(range_of(high, width))])
        if depth is None:
            return
        code, times = sum_codes(codes, counts)
        yield rows("gram", [(None, p, code[own].tobytes(), times[own].tobytes(), None) for p, own in split_by(part_of(code, depth, width))])

    return survey


def _sums(words: bool):
    """One row for each part, with what tasks counted added up."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(part: int, held: list[tuple]) -> pa.RecordBatch:
            if words:
                found = build_words(held)
                tokens = int(found[2].sum())
            else:
                found = (*sum_codes([np.frombuffer(r[0], np.uint64) for r in held], [np.frombuffer(r[1], np.int64) for r in held]), None)
                tokens = 0
            columns = [pa.array([part], pa.int32()), *(pa.array([None if x is None else x.tobytes()], pa.binary()) for x in found), pa.array([tokens], pa.int64()), pa.array([len(found[0])], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "a", "b", "c", "tokens", "keys"])

        at, held = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                part, a, b, c = (batch.column(j)[k].as_py() for j in range(4))
                if part != at and held:
                    yield done(at, held)
                    held = []
                at = part
                held.append((a, b, c))
        if held:
            yield done(at, held)

    return add


def lm_scores(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2, depth: int = 4, block_bytes: int = 4 << 20, broadcast_grams: int = BROADCAST_GRAMS
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of df.

    Both models learn from all rows outside the held-out fold.  A null or empty text is its end alone.
    Without a training row all counts are 0 (base_score is then 0 a token, as V and N are 0) and the byte
    model is uniform.  Repeated rows each teach and are each scored; an empty table gives an empty result;
    other columns are ignored.  Ids are taken as 64-bit integers.  A text over `block_bytes` is a block's last, and
    is scored in slices.  `depth` is at most 6.
    """
    return _scored(df, id_col, text_col, folds, fold, depth, block_bytes, broadcast_grams)


def word_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2, block_bytes: int = 4 << 20) -> DataFrame:
    """lm_scores without `score`: the word model alone, so no strings are counted, stored or asked for."""
    return _scored(df, id_col, text_col, folds, fold, None, block_bytes, 0)


def _scored(df: DataFrame, id_col: str, text_col: str, folds: int, fold: int, depth: int | None, block_bytes: int, broadcast_grams: int) -> DataFrame:
    spark = df.sparkSession
    width = shuffle_width(spark)
    packed = blocks(with_text(df, id_col, text_col, lambda i: ~held_out(i, folds, fold)), block_bytes, width)
    path = new_table(spark, "survey")
    surveyed = arrow_map(packed, _survey(width, depth), "kind string, block long, part int, a binary, b binary, c binary")
    surveyed.write.partitionBy("kind").option("compression", "zstd").parquet(path)
    found = spark.read.schema(surveyed.schema).parquet(path)
    summed = "part int, a binary, b binary, c binary, tokens long, keys long"

    def sums(kind: str) -> DataFrame:
        rows = found.where(F.col("kind") == kind).select("part", "a", "b", "c")
        return written(arrow_map(rows.repartition(width, "part").sortWithinPartitions("part"), _sums(kind == "word"), summed))

    words = sums("word")
    known = words.agg(F.sum("tokens").alias("n"), F.sum("keys").alias("v")).first()
    n, v = known["n"] or 0, known["v"] or 0
    ranges, salts = ranges_for(v, width)

    def rerange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words' sums by the lookups' ranges."""
        for batch in batches:
            for k in range(batch.num_rows):
                own = build_words([tuple(batch.column(j)[k].as_py() for j in range(3))])
                yield rows_of([(p, 0, False, None, *(x[at].tobytes() for x in own)) for p, at in split_by(range_of(own[0], ranges))])

    asked = route(found.where("kind = 'ask'"), ranges, salts)
    answers = written(lookups(arrow_map(words.select("a", "b", "c"), rerange, ROW), asked, salts, build_words, answer_words))
    joined = packed.join(gathered(answers, "words"), "block")

    trie, n_grams, parts = None, 0, 0
    if depth is not None:
        grams = sums("gram")
        n_grams = grams.agg(F.sum("keys").alias("n")).first()["n"] or 0
        parts, gram_salts = ranges_for(n_grams, width)
    if depth is None:
        pass
    elif n_grams <= broadcast_grams:
        rows = grams.select("a", "b").collect()
        codes, counts = sum_codes([np.frombuffer(r["a"], np.uint64) for r in rows], [np.frombuffer(r["b"], np.int64) for r in rows])
        trie = spark.sparkContext.broadcast(Trie(codes, counts, depth))
        joined = joined.withColumn("strings", F.lit(None).cast("array<struct<part:int,found:binary>>"))
    else:
        joined = joined.join(gathered(written(_far_logs(packed, grams, depth, parts, gram_salts)), "strings"), "block")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = math.log10(n + v + 1)
        for batch in batches:
            for k, (_, ids, ends, _, body) in enumerate(block_rows(batch)):
                texts = texts_of(ends, body)
                lists = [t.lower().split() for t in texts]
                distinct, high, _, order = distinct_words(lists)
                totals = np.empty(len(order), np.int64)
                given = {x["part"]: x["found"] for x in batch.column("words")[k].as_py()}
                for p, own in split_by(range_of(high, ranges)):
                    totals[order[own]] = unpack_totals(given[p], len(own))
                index = dict(zip(distinct, range(len(distinct)), strict=True))
                size = np.array([len(own) for own in lists], np.int64)
                at = np.fromiter((index[w] for own in lists for w in own), np.int64, int(size.sum()))
                places = np.concatenate(([0], np.cumsum(size)))
                logs, seen = np.log10(totals + 1.0), (totals > 0).astype(np.int64)
                sums_of = lambda x, at=at, places=places: np.diff(np.concatenate(([0], np.cumsum(x[at])))[places]) + x[-1]
                if depth is None:
                    pass
                elif trie is None:
                    mine = distinct_grams(texts, depth)
                    far = np.empty(len(mine))
                    given = {x["part"]: x["found"] for x in batch.column("strings")[k].as_py()}
                    for p, own in split_by(part_of(mine, depth, parts)):
                        far[own] = np.frombuffer(given[p])
                    look = lambda q, mine=mine, far=far: far[np.searchsorted(mine, q)]
                else:
                    look = trie.value.logs
                columns = [
                    pa.array(ids, pa.int64()),
                    pa.array(size + 1, pa.int64()),
                    pa.array(sums_of(seen), pa.int64()),
                    pa.array(sums_of(logs) - (size + 1) * whole, pa.float64()),
                ]
                if depth is not None:
                    columns.append(pa.array(text_logs(texts, depth, look), pa.float64()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_known", "base_score", *scores])

    scores = [] if depth is None else ["score"]
    scored = arrow_map(joined, score, ", ".join(["doc_id long, n_tokens long, n_known long, base_score double", *(f"{x} double" for x in scores)]))
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", *scores)


def distinct_grams(texts: list[bytes], depth: int) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(code) for code, _, _ in gram_slices(texts, depth))]))


def _far_logs(packed: DataFrame, grams: DataFrame, depth: int, parts: int, salts: int) -> DataFrame:
    """Logs of each block's strings, from a trie that stays in its parts.  Contexts of up to one symbol, at most
    SYMBOLS squared counts, go to every task."""
    spark = packed.sparkSession

    def shortest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                code, times = np.frombuffer(batch.column(0)[k].as_py(), np.uint64), np.frombuffer(batch.column(1)[k].as_py(), np.int64)
                near = sum_codes([code >> np.uint64(BITS * depth) << _ONE | code & _LOW, np.zeros(0, np.uint64)], [times, np.zeros(0, np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(near[0].astype(np.int64)), pa.array(near[1])], names=["code", "n"])

    pairs = arrow_map(grams.select("a", "b"), shortest, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()
    one = Level(np.array([r["code"] for r in pairs], np.uint64), np.array([r["n"] for r in pairs], np.int64))
    none = Level(*sum_codes([one.grams & _LOW, np.zeros(0, np.uint64)], [one.counts, np.zeros(0, np.int64)]))
    one.below(none)
    base = spark.sparkContext.broadcast([none, one])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                code, times = np.frombuffer(batch.column(0)[k].as_py(), np.uint64), np.frombuffer(batch.column(1)[k].as_py(), np.int64)
                yield rows_of([(p, 0, False, None, code[own].tobytes(), times[own].tobytes(), None) for p, own in split_by(part_of(code, depth, parts))])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, _, ends, _, body in block_rows(batch):
                mine = distinct_grams(texts_of(ends, body), depth)
                yield rows_of([(p, number % salts, True, number, mine[own].tobytes(), None, None) for p, own in split_by(part_of(mine, depth, parts))])

    def build(rows: list[tuple]) -> Trie:
        return Trie(*sum_codes([np.zeros(0, np.uint64), *(np.frombuffer(r[0], np.uint64) for r in rows)], [np.zeros(0, np.int64), *(np.frombuffer(r[1], np.int64) for r in rows)]), depth, base.value)

    return lookups(arrow_map(grams.select("a", "b"), deal, ROW), arrow_map(packed, ask, ROW), salts, build, lambda trie, block, a, b: trie.logs(np.frombuffer(a, np.uint64)).tobytes())

"""Spelling variants: words one edit apart, each with the commonest of its neighbours as its form.

Of two words one edit apart, one half at least is untouched.  So each word is indexed by its two halves, cut by
its length, and probed with what a word of its own length, or one a letter shorter, would have there: the same
head, or the tail moved by the difference in length.  Where too many words share a segment, what is left of them
is halved again, as often as it takes; the edit then lies in a quarter, an eighth.  Each pair has one place of
its first difference, and counts in the one segment that leaves exactly this place open.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, byte_texts, slices, written

#: Segments with more indexed words than this are cut again.
CROWD = 64
#: Different words that a task adds up before it sends their counts on.
HELD_WORDS = 1 << 18
#: Up to so many crowded segments are broadcast (about 100 bytes each); beyond it they are joined.
BROADCAST_SEGMENTS = 300_000
#: Matches of longer texts are taken one at a time.
LONG_TEXT = 1 << 20


def noisy_words(texts: list[bytes], ids: list[str], least_points: int, every: int) -> Iterator[tuple[str, int]]:
    """(word, count) of each text: runs of letters with A-Z in lower case.  A run whose CRC-32, with the id before it, is
    a multiple of `every` loses the letter at that number modulo its length; every = 0 leaves all as they are."""
    run = re.compile(rf"[a-zÀ-ÿ]{{{least_points},}}")
    for text, key in zip(texts, ids, strict=True):
        lowered = text.lower().decode()  # bytes.lower() changes A-Z alone
        found = run.findall(lowered) if len(lowered) < LONG_TEXT else (m.group() for m in run.finditer(lowered))
        start = zlib.crc32(f"{key}:".encode())
        for word, n in Counter(found).items():
            if every and (h := zlib.crc32(word.encode(), start)) % every == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
                if len(word) < least_points:
                    continue
            yield word, n


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_points: int = 7, least_n: int = 2, every: int = 31) -> DataFrame:
    """(word, n) of all rows: words of at least least_points letters that occur least_n times or more.

    Tasks add up before words travel, and send on what they hold whenever it is many."""
    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = df.select(empty(id_col).alias("doc_id"), empty(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in slices(batches, 256):
            for word, n in noisy_words(byte_texts(batch.column("text")), batch.column("doc_id").to_pylist(), least_points, every):
                held[word] += n
                if len(held) >= HELD_WORDS:
                    yield flush()
        yield flush()

    return arrow_map(rows, count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def _cut(rows: DataFrame) -> DataFrame:
    """Each row twice: its open letters [lo, hi) of the indexed word halved, one half open and the other in the key.

    longer is 1 where the row probes for words a letter shorter; its own open letters end one later."""
    middle = F.col("lo") + F.floor((F.col("hi") - F.col("lo")) / 2).cast("int")
    halves = F.array(F.struct(middle.alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), middle.alias("hi")))
    cut = rows.withColumn("half", F.explode(halves)).select("word", "n", "longer", "points", F.col("half.lo").alias("lo"), F.col("half.hi").alias("hi"))
    end = F.col("hi") + F.col("longer")
    head, tail = F.substring("word", F.lit(1), F.col("lo")), F.substring("word", end + 1, F.lit(1 << 30))
    key = F.concat_ws("|", F.col("points").cast("string"), F.col("lo").cast("string"), F.col("hi").cast("string"), head, tail)
    return cut.select("*", key.alias("key"), F.substring("word", F.col("lo") + 1, end - F.col("lo")).alias("open"))


def near_pairs(words: DataFrame, crowd: int = CROWD, broadcast_segments: int = BROADCAST_SEGMENTS) -> DataFrame:
    """(a, a_n, b, b_n): every two words with one inserted, deleted or replaced letter between them, once.

    words: (word, n), each word once.  Work is at most `crowd` comparisons a probe (where one open letter is left, as
    many as there are letters), however many words share a segment.
    """
    points = F.length("word")
    index = words.select("word", "n", F.lit(0).alias("longer"), points.alias("points"), F.lit(0).alias("lo"), points.alias("hi"))
    shorter = words.select("word", "n", F.lit(1).alias("longer"), (points - 1).alias("points"), F.lit(0).alias("lo"), (points - 1).alias("hi"))
    probes, out = index.unionByName(shorter), None
    while True:
        index, probes = written(_cut(index)), written(_cut(probes))
        crowded = written(index.where("hi - lo > 1").groupBy("key").count().where(F.col("count") > crowd).select("key"))
        n = crowded.count()
        told = F.broadcast(crowded) if n <= broadcast_segments else crowded
        found = _verified(index.join(told, "key", "left_anti"), probes.join(told, "key", "left_anti")) if n else _verified(index, probes)
        out = found if out is None else out.unionByName(found)
        if not n:
            return out
        rest = ["word", "n", "longer", "points", "lo", "hi"]
        index, probes = index.join(told, "key", "left_semi").select(rest), probes.join(told, "key", "left_semi").select(rest)


def _verified(index: DataFrame, probes: DataFrame) -> DataFrame:
    """Pairs that share a segment and have one edit in the open letters; those whose first difference lies behind the
    open letters came by the other half."""
    i, p = index.alias("i"), probes.alias("p")
    once = (F.col("p.longer") == 1) | (F.col("i.word") < F.col("p.word"))
    here = (F.col("i.hi") == F.col("i.points")) | ~F.col("p.open").startswith(F.col("i.open"))
    one = F.levenshtein(F.col("i.open"), F.col("p.open"), 1) == 1
    both = i.join(p, (F.col("i.key") == F.col("p.key")) & once & here & one)
    return both.select(F.col("i.word").alias("a"), F.col("i.n").alias("a_n"), F.col("p.word").alias("b"), F.col("p.n").alias("b_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms followed to the last.  Each round doubles the steps; a form is commoner
    than its word, so there are no circles."""
    links = written(forms.select("word", F.col("form").alias("root")))
    while True:
        after = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = written(links.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if links.where("moved").isEmpty():
            return links.select("word", "root")
        links = links.select("word", "root")


def spelling_variants(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_points: int = 7, least_n: int = 2, times: int = 10, every: int = 31, crowd: int = CROWD, broadcast_segments: int = BROADCAST_SEGMENTS
) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row for every word of at least least_points letters and least_n occurrences.

    Letters are A-Z, a-z and U+00C0 to U+00FF; only A-Z are lower-cased.  A word's form is the commonest word one edit
    away (ties: the smallest in code-point order) if it occurs at least `times` as often.  Null texts have no words and a
    null id counts as an empty one; repeated rows count again; texts of any length; an empty table gives an empty result;
    other columns are ignored.
    """
    words = written(word_counts(df, id_col, text_col, least_points, least_n, every))
    pairs = near_pairs(words, crowd, broadcast_segments)
    side: Column = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("m"))))
    best = F.min(F.struct((-F.col("m")).alias("minus"), "near")).alias("best")
    near = pairs.select(side.alias("x")).select("x.*").groupBy("word").agg(F.count("*").alias("n_near"), best)
    common = -F.col("best.minus") >= times * F.col("n")
    told = words.join(near, "word", "left").select(
        "word", F.when(common, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(common, -F.col("best.minus")).alias("form_n")
    )
    told = written(told)
    ends = roots(told.where("form is not null"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""An inverted index of items: postings (a word, an item) stored in ranges of words, and a dictionary that says how many
items each word has.  A search reads the row groups of its own words and no text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import ship
from ..sources.archive import Archive, Commit, Table

#: Ids of a search's rarest word that are broadcast to the postings of the others (about 64 MB); beyond it ids meet by a
#: shuffle.
BROADCAST_IDS = 2_000_000
#: Bytes of text whose words a task gathers before they travel, and ids that a word's run has at most, so that runs of frequent
#: words fill no range alone.
RUN_BYTES, RUN_IDS = 16 << 20, 64
#: Segments of postings beyond which an update compacts.
MOST_SEGMENTS = 8

POSTINGS, TERMS = "postings", "terms"


def _summed(terms: DataFrame) -> DataFrame:
    return terms.groupBy("token").agg(F.sum("items").alias("items"))


#: The index's tables in an archive.
INDEX_TABLES = {
    POSTINGS: Table("token string, id long", "id", ("token", "id"), row_group=4 << 20),
    TERMS: Table("token string, items long", "token", ("token",), _summed, row_group=1 << 20),
}


def postings(items: DataFrame) -> DataFrame:
    """(token, id), each pair once, of items' titles and texts."""
    words = F.array_union(T.tokens(F.col("title")), T.tokens(F.col("content_text")))
    return items.select("id", F.explode(words).alias("token")).select("token", "id")


def runs(items: DataFrame) -> DataFrame:
    """The postings() of items as (token, id): a row for up to RUN_IDS items of a task that have the word, with the list of
    their ids, so that a word travels and is sorted once for each run instead of once for each item."""
    ship(items.sparkSession)
    spaced = F.concat(T.spaced(F.col("title")), F.lit(" "), T.spaced(F.col("content_text")))
    return items.select(F.col("id").cast("long").alias("id"), spaced.alias("words")).mapInArrow(_runs, "token string, id array<long>")


def _runs(batches: Iterator) -> Iterator:
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            held.append(batch.slice(at, 256))
            size += held[-1].nbytes
            if size >= RUN_BYTES:
                yield _gathered(held)
                held, size = [], 0
    if held:
        yield _gathered(held)


def _gathered(batches: list):
    """A batch of the runs of some texts, whose ids keep the order in which they came."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pa.Table.from_batches(batches).combine_chunks()
    split = pc.split_pattern(texts["words"].combine_chunks(), " ")
    found = pc.list_flatten(split).dictionary_encode()
    words = pa.array([T.plain(w) for w in found.dictionary.to_pylist()], pa.string()).dictionary_encode()
    # A word's number above, a text's below: each pair once, by words.  (numpy.unique takes 20 times as long as this sort.)
    pairs = words.indices.to_numpy()[found.indices.to_numpy()].astype(np.int64) << 32 | pc.list_parent_indices(split).to_numpy()
    pairs.sort()
    pairs = pairs[np.diff(pairs, prepend=-1) != 0]
    codes, at = pairs >> 32, np.arange(len(pairs))
    first = np.maximum.accumulate(np.where(np.diff(codes, prepend=-1) != 0, at, 0))
    starts = at[(at - first) % RUN_IDS == 0]
    ids = texts["id"].combine_chunks().take(pa.array(pairs & 0xFFFFFFFF))
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(at)), pa.int32()), ids)
    out = pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(codes[starts])), lists], names=["token", "id"])
    return out.filter(pc.not_equal(out["token"], ""))


def found_ids(index: DataFrame, terms: list[str]) -> DataFrame:
    """Ids of items that have every term as a word, the last one as the start of a word.

    The conditions on token reach the scan.  One aggregation by id; each posting adds its terms' bits.
    """
    if not terms:
        return index.select("id").limit(0)
    hits = [F.col("token") == t for t in terms[:-1]] + [F.col("token").startswith(terms[-1])]
    any_hit, bits = hits[0], F.lit(0).cast("long")
    for k, hit in enumerate(hits):
        any_hit = any_hit | hit
        bits = bits.bitwiseOR(F.when(hit, F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return index.where(any_hit).groupBy("id").agg(F.bit_or(bits).alias("bits")).where(F.col("bits") == (1 << len(hits)) - 1).select("id")


def updated(index: DataFrame, changed: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """The index after `changed` items (new ones, and those whose title or text is another) and the deletion of the ids
    in `gone`.  Only postings of touched ids leave and only touched texts are read."""
    touched = changed.select("id")
    if gone is not None:
        touched = touched.unionByName(gone.select("id"))
    return index.join(touched, "id", "left_anti").select("token", "id").unionByName(postings(changed))


@dataclass(frozen=True)
class StoredIndex:
    """Postings and dictionary in an archive, alone or beside the items they are of."""

    archive: Archive
    version: int | None = None

    @staticmethod
    def at(spark: SparkSession, path: str) -> StoredIndex:
        """An archive of nothing but an index."""
        return StoredIndex(Archive(spark, path, INDEX_TABLES))

    def fill(self, commit: Commit, added: DataFrame | None = None, changed: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """Adds to a commit what items that are new, items whose title or text is another, and the deletion of the ids in
        `gone` do to the index.

        Old postings of touched ids are hidden by tombstones, whatever words they had.  The dictionary isn't told of
        deletions, so its counts are upper bounds."""
        for touched in (changed, gone):
            if touched is not None:
                commit.delete(POSTINGS, touched.select("id"))
        for items in (added, changed):
            if items is not None:
                with commit.staged(runs(items)) as (found, ranges):
                    n = commit.add(POSTINGS, found, runs="id", ranges=ranges)
                if n:
                    fresh = self.archive.spark.read.parquet(f"{self.archive.path}/{commit.tables[POSTINGS]['segments'][-1]['path']}")
                    commit.add(TERMS, fresh.groupBy("token").agg(F.count("*").alias("items")))

    def update(self, added: DataFrame | None = None, changed: DataFrame | None = None, gone: DataFrame | None = None) -> int:
        """fill() in a commit of its own, and compaction once there are many segments."""
        commit = self.archive.begin()
        self.fill(commit, added, changed, gone)
        version = commit.done()
        return self.compact() or version

    def compact(self, most: int = MOST_SEGMENTS) -> int | None:
        """Joins segments of like size where there are over `most`; the version that came of it, if any."""
        done = None
        for name in (POSTINGS, TERMS):
            while len(self.archive.manifest()["tables"].get(name, {"segments": []})["segments"]) > most and self.archive.compact(name):
                done = self.archive.version()
        return done

    def postings(self) -> DataFrame:
        return self.archive.read(POSTINGS, self.version)

    def counts(self, terms: list[str]) -> list[int]:
        """Postings of each term, at most: from the dictionary, the last term as the start of words."""
        hits = [F.col("token") == t for t in terms[:-1]] + [F.col("token").startswith(terms[-1])]
        any_hit = hits[0]
        for hit in hits[1:]:
            any_hit = any_hit | hit
        sums = [F.coalesce(F.sum(F.when(hit, F.col("items"))), F.lit(0)).cast("long") for hit in hits]
        return list(self.archive.read(TERMS, self.version).where(any_hit).agg(*(s.alias(f"c{k}") for k, s in enumerate(sums))).first())

    def ids(self, terms: list[str], broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
        """Ids of items that have every term as a word, the last one as the start of a word.

        The rarest term's ids go to the postings of the others, which then neither shuffle nor sort, as long as the
        dictionary says that they are few; else one aggregation by id."""
        if not terms:
            return self.postings().select("id").limit(0)
        counts = self.counts(terms)
        rarest = counts.index(min(counts))
        if len(terms) > 1 and counts[rarest] > broadcast_ids:
            return found_ids(self.postings(), terms)
        whole = self.postings()

        def of(k: int) -> DataFrame:
            """Each posting once; a start of words may have several in one item."""
            last = k == len(terms) - 1
            ids = whole.where(F.col("token").startswith(terms[k]) if last else F.col("token") == terms[k]).select("id")
            return ids.distinct() if last else ids

        out = of(rarest)
        for k in sorted((k for k in range(len(terms)) if k != rarest), key=counts.__getitem__):
            out = of(k).join(F.broadcast(out), "id", "left_semi")
        return out

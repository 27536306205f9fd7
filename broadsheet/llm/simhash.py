"""SimHash near-duplicates linked through sharded BK-trees.

Fingerprints that differ in at most 4 of 64 bits agree in at least two of six blocks of bits, so a shard
for each value of each of the 15 pairs of blocks (20 to 22 bits) brings every linked pair together in some
shard: no link is lost.  Of more fingerprints more blocks are asked to agree, three of seven or four of eight, so
that shards stay small and the work grows with the input.  A shard's tree keys children by their integer Hamming
distance to the parent; a query follows only edges within the radius of its own distance.  Trees go to the tasks by
shard key and not as one broadcast: they hold the fingerprints of all documents.  A shard returns a spanning forest of its
links, never all its pairs, and a query skips subtrees that already belong to its own component, so a
large group of near copies costs a few visits a member.

`simhash_groups` links 64-bit fingerprints within a radius, all of them.  `near_groups` is for a stated
similarity of texts: fingerprints of 256 bits only propose, with a radius well beyond what the similarity
brings about, and what they propose is decided by the texts' shingles.  Shards are found by probing, for at
such radii no two fingerprints need share a block.  Bits whose sums lie near zero are those that differ
between near copies; a text stands in the shards of each 24-bit band that its likeliest flips of such bits
lead to.  Groups of proposed links are then compared in full, text by text, in tiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, by_bucket, byte_texts, shuffle_width, slices, split_by, written
from .components import components

SEED = 42
#: Shingles whose bits are counted at once: 64 bytes each.
AT_ONCE = 1 << 16


def shingle_hashes(text: bytes, width: int = 4) -> list[int]:
    """XXH64 of each run of `width` words of the lower-cased text, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) <= width:
        return [xxh64_intdigest(joined, SEED)]
    return [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)]


def fingerprints(texts: list[bytes], width: int = 4) -> np.ndarray:
    """A bit is 1 if set in over half of a text's hashes; no words: zero."""
    out = np.zeros(len(texts), np.uint64)
    for k, text in enumerate(texts):
        hashes = np.array(shingle_hashes(text, width), np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), AT_ONCE):
            ones += np.unpackbits(hashes[at : at + AT_ONCE], axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]
    return out


class BKTree:
    """A BK-tree over distinct integers that also keeps the components of the links found."""

    def __init__(self, radius: int) -> None:
        self.radius = radius
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        self.parent: list[int] = []
        #: A node of the one component that the whole subtree belongs to, or -1.
        self.whole: list[int] = []

    def find(self, k: int) -> int:
        up = self.parent
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    def add(self, value: int) -> list[int]:
        """Inserts value; returns nodes within the radius, one for each component that it joins."""
        k, radius, find = len(self.values), self.radius, self.find
        self.values.append(value)
        self.children.append({})
        self.parent.append(k)
        self.whole.append(k)
        if not k:
            return []
        linked, stack = [], [0]
        while stack:
            t = stack.pop()
            own = find(k)
            if self.whole[t] >= 0 and find(self.whole[t]) == own:
                continue
            d = (self.values[t] ^ value).bit_count()
            if d <= radius and find(t) != own:
                self.parent[own] = find(t)
                linked.append(t)
            stack += [c for e, c in self.children[t].items() if d - radius <= e <= d + radius]
        t = 0
        while True:
            if self.whole[t] >= 0 and find(self.whole[t]) != find(k):
                self.whole[t] = -1
            d = (self.values[t] ^ value).bit_count()
            if d not in self.children[t]:
                self.children[t][d] = k
                return linked
            t = self.children[t][d]


def block_bounds(blocks: int) -> list[tuple[int, int]]:
    """(shift, bits) of each of the blocks that 64 bits are cut into."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


#: Fingerprints that a shard holds at most on average, were they random.
SHARD = 32


def agreeing(n: int, radius: int = 4) -> int:
    """How many blocks fingerprints must agree in to share a shard, so that n of them make small shards."""
    return next((m for m in (2, 3) if n <= SHARD << 64 * m // (radius + m)), 4)


def shard_keys(fp: Column, radius: int = 4, agree: int = 2) -> Column:
    """An array of (choice of blocks, bits in them): with radius + agree blocks, fingerprints within the radius share one."""
    pick = lambda at: F.shiftrightunsigned(fp, at[0]).bitwiseAND(F.lit((1 << at[1]) - 1))
    keys = []
    for i, chosen in enumerate(combinations(block_bounds(radius + agree), agree)):
        bits = pick(chosen[0])
        for at in chosen[1:]:
            bits = F.shiftleft(bits, at[1]).bitwiseOR(pick(at))
        keys.append(F.struct(F.lit(i).alias("choice"), bits.alias("bits")))
    return F.array(*keys)


def _links(radius: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard; a shard may span batches."""
        at, tree, held = None, None, []
        for batch in batches:
            a, b = [], []
            choice, bits, fp = (batch.column(c).to_pylist() for c in ("choice", "bits", "fp"))
            for shard, own in zip(zip(choice, bits, strict=True), fp, strict=True):
                if shard != at:
                    at, tree, held = shard, BKTree(radius), []
                for t in tree.add(own & 0xFFFFFFFFFFFFFFFF):
                    a.append(held[t])
                    b.append(own)
                held.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return link


#: Up to so many keys that several rows or links have are broadcast with their components (about 40 bytes each); beyond it
#: rows meet them within salts, with the same result.
BROADCAST_LABELS = 1_000_000
SALTS = 16


def _labelled(marked: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """marked with component_id: that of its key in labels (key, component_id), else its own id.  A key that a third of
    all rows have is spread over tasks."""
    labels = written(labels.withColumn("labelled", F.lit(True)))
    if labels.count() <= BROADCAST_LABELS:
        found = marked.join(F.broadcast(labels), key, "left")
    else:
        copies = labels.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = marked.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(copies, [key, "salt"], "left")
    return found.withColumn("component_id", F.when(F.col("labelled"), F.col("component_id")).otherwise(F.col("doc_id")))


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of df.

    component_id is the smallest id reachable over links of at most `radius` differing bits.  Texts without
    words, null ones included, have fingerprint zero and are linked like any other.  Rows with equal
    fingerprints always share a component; a null id gets its fingerprint's, links like any other, and is never a
    component's id, which is null where no row has one.  Very long texts are hashed as a whole, a stretch at a time.
    An empty table gives an empty result; other columns are ignored.  Ids are taken as 64-bit integers.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = fingerprints(byte_texts(batch.column("text")), width)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    marked = written(arrow_map(rows, hashed, "doc_id long, fp long"))
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")))
    choices = shard_keys(F.col("fp"), radius, agreeing(distinct.count(), radius))
    shards = distinct.select("fp", F.explode(choices).alias("k")).select("k.choice", "k.bits", "fp")
    dealt = shards.repartition("choice", "bits").sortWithinPartitions("choice", "bits", "fp")
    # The fingerprints are the nodes; what a component is called follows from its rows' ids.
    found = written(components(arrow_map(dealt, _links(radius), "a long, b long")).withColumnRenamed("node", "fp"))
    named = found.join(distinct, "fp").groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = found.join(named, "component").select("fp", "component_id", F.lit(True).alias("linked"))
    labels = distinct.join(linked, "fp", "left").where("linked or rows > 1").select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("rep")).alias("component_id"))
    return _labelled(marked, labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- a stated similarity ------------------------------------------------------------------------------

#: 64-bit words of a wide fingerprint, bits of a band, bands and probes of each that are looked up, and how many of a
#: band's least certain bits may be flipped, at most how many at once.
WIDE, BAND, BANDS, PROBES, WEAK, FLIPS = 4, 24, 10, 16, 8, 4
#: Sets of so many shingles or fewer, whose bits tell little, also find each other without fail by their smallest hashes.
FEW = 8
#: Texts of a proposed group that are compared with each other or with as many others in one go.
TILE = 256


def wide_radius(similarity: float) -> int:
    """Differing bits that texts of this Jaccard similarity have on average, and 4.5 standard deviations more."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(64 * WIDE * share + 4.5 * math.sqrt(64 * WIDE * share * (1 - share)))


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Its different shingle hashes in order."""
    return np.unique(np.array(shingle_hashes(text, width), np.uint64))


def wide_sums(sets: list[np.ndarray]) -> np.ndarray:
    """For each set of hashes and bit: hashes with the bit less those without it."""
    out = np.zeros((len(sets), 64 * WIDE), np.int64)
    for k, hashes in enumerate(sets):
        for at in range(0, len(hashes), 1 << 12):
            part = hashes[at : at + (1 << 12)]
            bits = []
            for word in range(WIDE):
                x = part + np.uint64(0x9E3779B97F4A7C15 * word % 2**64)
                for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
                x ^= x >> np.uint64(31)
                bits.append(np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            out[k] += 2 * np.concatenate(bits, axis=1).sum(0, dtype=np.int64) - len(part)
    return out


def probes(sums: np.ndarray) -> np.ndarray:
    """The shards each text stands in: for each band its own bits and the likeliest flips of them."""
    flips = [c for n in range(FLIPS + 1) for c in combinations(range(WEAK), n)]
    chosen = np.zeros((len(flips), WEAK))
    for k, c in enumerate(flips):
        chosen[k, list(c)] = 1
    out = []
    for band in range(BANDS):
        own = sums[:, band * BAND : (band + 1) * BAND]
        base = ((own > 0) << np.arange(BAND)).sum(1)
        weak = np.argsort(np.abs(own), axis=1, kind="stable")[:, :WEAK]
        cost = np.take_along_axis(np.abs(own), weak, 1) @ chosen.T
        best = np.argsort(cost, axis=1, kind="stable")[:, :PROBES]
        masks = ((1 << weak).astype(np.float64) @ chosen.T).astype(np.int64)
        out.append((base[:, None] ^ np.take_along_axis(masks, best, 1)) | band << BAND)
    return np.concatenate(out, axis=1).astype(np.int32)


def smallest(hashes: np.ndarray, similarity: float) -> np.ndarray:
    """Shards that a small set stands in besides: two sets of at least the similarity share one of the smallest
    hashes, as many as may be missing from the other, and one."""
    n = len(hashes)
    if not 0 < similarity * n <= FEW + 1e-9:
        return np.zeros(0, np.int32)
    most = n - math.ceil(similarity * n - 1e-9) + 1
    return np.unique(hashes[:most] & np.uint64((1 << BAND) - 1)).astype(np.int32) | np.int32(BANDS << BAND)


def alike(sets: list[np.ndarray], similarity: float, cut: int = 0) -> list[tuple[int, int]]:
    """Links (a forest of them) between sets of a Jaccard similarity of at least `similarity`; of all pairs, or if
    cut is given of those on either side of it.  Sets are not empty."""
    numbers = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1)
    sizes = np.array([len(x) for x in sets])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    own = np.zeros(numbers.max() + 1, np.uint8)
    label = np.arange(len(sets))
    found = []
    for k in range(max(cut, 1), len(sets)):
        before = cut or k
        if (label[:before] == label[k]).all():
            continue
        own[:] = 0
        own[numbers[starts[k] : ends[k]]] = 1
        shared = np.add.reduceat(own[numbers[: ends[before - 1]]], starts[:before], dtype=np.int64)
        for t in np.flatnonzero(shared >= similarity * (sizes[:before] + sizes[k] - shared) - 1e-9).tolist():
            if label[t] != label[k]:
                label[label == label[t]] = label[k]
                found.append((t, k))
    return found


def _verify(similarity: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by tile (bucket, one, other)."""
        for (_, one, other), rows in by_tile(batches):
            rows.sort(key=lambda r: (r[1] != one, r[0]))
            cut = sum(r[1] == one for r in rows) if one != other else 0
            if len(rows) < 2 or (one != other and cut in (0, len(rows))):
                continue
            links = alike([np.frombuffer(r[2], np.uint64) for r in rows], similarity, cut)
            yield pa.RecordBatch.from_arrays([pa.array([rows[k][0] for k in side], pa.int64()) for side in (list(zip(*links, strict=True)) or [(), ()])], names=["a", "b"])

    return verify


def by_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    at, held = None, []
    for batch in batches:
        for *tile, rep, chunk, hashes in zip(*(batch.column(c).to_pylist() for c in ("group", "one", "other", "rep", "chunk", "hashes")), strict=True):
            if tile != at and held:
                yield tuple(at), held
                held = []
            at = tile
            held.append((rep, chunk, hashes))
    if held:
        yield tuple(at), held


def _deal(route: int):
    """Texts with their shards by the shard's first `route` bits after the band's number.  A text's probes of a band
    share most of those bits, so its fingerprint travels a few times a band and not once for each shard."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards = np.asarray(batch.column("shards").flatten(), np.int32)
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(batch.column("shards"))))
            fps = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint8).reshape(-1, 8 * WIDE)
            reps = np.asarray(batch.column("rep"))
            rows = []
            for bucket, own in split_by(shards >> (BAND - route)):
                texts, at = np.unique(owner[own], return_inverse=True)
                rows.append((bucket, shards[own].tobytes(), at.astype(np.int32).tobytes(), fps[texts].tobytes(), reps[texts].tobytes()))
            kinds = (pa.int32(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names=["bucket", "shards", "owners", "fps", "reps"])

    return deal


def _link_shards(radius: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_bucket(batches, ["shards", "owners", "fps", "reps"]):
            reps = [np.frombuffer(r[3], np.int64) for r in rows]
            before = np.cumsum([0, *map(len, reps)])
            shards = np.concatenate([np.frombuffer(r[0], np.int32) for r in rows])
            owners = np.concatenate([np.frombuffer(r[1], np.int32) + n for r, n in zip(rows, before.tolist(), strict=False)])
            fps = np.concatenate([np.frombuffer(r[2], np.uint8) for r in rows]).reshape(-1, 8 * WIDE)
            reps = np.concatenate(reps)
            # By shard, then id: which order a tree grows in doesn't depend on how rows arrived.
            order = np.lexsort((reps[owners], shards))
            cuts = np.flatnonzero(np.diff(shards[order], prepend=-1, append=-1))
            many = np.diff(cuts) > 1
            a, b = [], []
            for first, end in zip(cuts[:-1][many].tolist(), cuts[1:][many].tolist(), strict=True):
                tree, own = BKTree(radius), owners[order[first:end]]
                ids = reps[own].tolist()
                for k, fp in zip(ids, fps[own], strict=True):
                    for t in tree.add(int.from_bytes(fp.tobytes(), "little")):
                        a.append(ids[t])
                        b.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return link


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, fingerprint (64 hex digits), component_id for every row of df.

    Links texts whose sets of shingles of `width` lower-cased words have the stated Jaccard similarity or more;
    component_id is the smallest id reachable.  Every link is checked on the whole sets.  Links are looked for
    where the wide fingerprints propose one, and within all of a group so proposed.  Odd rows have the results
    that simhash_groups gives them.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [shingle_set(t, width) for t in byte_texts(part.column("text"))]
            sums = wide_sums(sets)
            fps = np.packbits(sums > 0, axis=1, bitorder="little")
            shards = [np.concatenate((own, smallest(x, similarity))) for own, x in zip(probes(sums), sets, strict=True)]
            columns = [part.column("doc_id"), pa.array([_digest(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in fps], pa.binary()), pa.array(shards, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "fp", "shards"])

    marked = written(arrow_map(rows, hashed, "doc_id long, key binary, fp binary, shards array<int>"))
    grouped = marked.groupBy("key").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("fp", "shards"), "doc_id").alias("x"), F.count("*").alias("rows"))
    distinct = written(grouped.select("key", "rep", "x.fp", "x.shards", "rows"))
    tasks = shuffle_width(df.sparkSession)
    route = min(BAND, max(4, tasks.bit_length()))
    packed = arrow_map(distinct.where("rep is not null"), _deal(route), "bucket int, shards binary, owners binary, fps binary, reps binary")
    proposed = arrow_map(packed.repartition(tasks, "bucket").sortWithinPartitions("bucket"), _link_shards(wide_radius(similarity)), "a long, b long")
    edges = _checked(rows, distinct, components(proposed), width, similarity)
    found = components(edges)
    labels = distinct.join(found.withColumnRenamed("node", "rep"), "rep", "left").where("component is not null or rows > 1").select("key", F.coalesce("component", "rep").alias("component_id"))
    return _labelled(marked.select("doc_id", "key", "fp"), labels, "key").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


#: Up to so many texts that stand in proposed groups are looked up by a broadcast of their ids; beyond it texts are
#: shuffled by id instead, with the same result.
BROADCAST_IDS = 500_000


def _digest(hashes: np.ndarray) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(hashes.tobytes(), SEED)


def _checked(rows: DataFrame, distinct: DataFrame, groups: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links (a, b) of at least the similarity between the texts of each group (node, component): all that are needed
    to connect them.  A group of many texts is cut into chunks, and each pair of chunks is a tile of its own."""
    groups = written(groups.withColumnRenamed("node", "rep").withColumnRenamed("component", "group"))
    chunks = groups.groupBy("group").agg(F.ceil(F.count("*") / TILE).cast("int").alias("chunks"))
    wanted = written(groups.join(chunks, "group").join(distinct.select("rep", "key"), "rep").select(F.col("rep").alias("doc_id"), "key", "group", "chunks"))
    few = wanted.count() <= BROADCAST_IDS
    texts = rows.join(F.broadcast(wanted) if few else wanted, "doc_id")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [shingle_set(t, width) for t in byte_texts(part.column("text"))]
            # An id may stand for several texts.
            own = pa.array([len(x) > 0 and _digest(x) == key for x, key in zip(sets, part.column("key").to_pylist(), strict=True)], pa.bool_())
            columns = [*(part.column(c) for c in ("group", "chunks", "doc_id")), pa.array([x.tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["group", "chunks", "rep", "hashes"]).filter(own)

    sets = arrow_map(texts, sets_of, "group long, chunks int, rep long, hashes binary").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    others = sets.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiles = others.select("group", F.least("chunk", "with").alias("one"), F.greatest("chunk", "with").alias("other"), "rep", "chunk", "hashes")
    dealt = tiles.repartition("group", "one", "other").sortWithinPartitions("group", "one", "other")
    return arrow_map(dealt, _verify(similarity), "a long, b long")

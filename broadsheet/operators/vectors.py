"""Vectors: similarity, semantic search, near-duplicate pairs within a time window, and their clusters."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship, written

#: Vectors in a tile: two tiles and their products take a few MB.
TILE = 1024
#: A cell of tile pairs is so many tiles wide and high; more where a bucket would have over MOST_CELLS cells a side, so that a
#: tile is copied at most about twice MOST_CELLS times, however many tiles there are.
GRID = 4
MOST_CELLS = 16


def dot(a: Column, b: Column) -> Column:
    """In double precision; vectors of unlike lengths have 0."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x)).otherwise(F.lit(0.0))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(v: Column) -> Column:
    """Divided by the length; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: (x / n).cast("float"))).otherwise(v)


def encode_blob(v: list[float]) -> bytes:
    return np.asarray(v, "<f4").tobytes()


def decode_blob(blob: bytes) -> list[float]:
    """Little-endian 32-bit floats; bytes after the last whole one are dropped."""
    return np.frombuffer(blob[: len(blob) // 4 * 4], "<f4").tolist()


def semantic_search(vectors: DataFrame, query: list[float], model: str, floor: float = 0.55, limit: int | None = None) -> DataFrame:
    """(item_id, similarity) of this model's vectors from the floor on, best first.  The query travels as a literal.  The
    floor is held to before similarities are rounded for show."""
    like = F.array(*(F.lit(float(x)) for x in query))
    scored = vectors.where(F.col("model") == model).select("item_id", dot(F.col("embedding"), like).alias("similarity")).where(F.col("similarity") >= floor)
    best = scored.orderBy(F.desc("similarity"), "item_id").limit(limit) if limit else scored
    return best.select("item_id", F.round("similarity", 6).alias("similarity"))


def similar_pairs(vectors: DataFrame, threshold: float, window_hours: int = 72, fresh: DataFrame | None = None, turn: str | None = None) -> DataFrame:
    """(a, b, similarity) with a < b of one model whose times lie within the window; with `fresh` (item_id), only pairs
    with at least one of those.

    With `turn`, a column of whole numbers, a new vector is a child of known ones and of new ones with a larger (turn, id), and a
    pair of tiles gives each child's best partner in it alone (the smallest id of equals): (a, b, similarity) with a the child.

    Time is cut into buckets as wide as the window, so partners stand in one bucket or in neighbours.  Buckets
    are cut into tiles of about TILE vectors, new and other ones apart.  Pairs of tiles are laid out as a grid, cut into cells
    of GRID by GRID tiles or, in a crowded bucket, into MOST_CELLS by MOST_CELLS: each tile goes once to every cell of
    its row and of its column (within a bucket, of the grid's upper half), and a cell's pairs are multiplied one after the
    other in numpy.  So a crowded bucket's work is even over many tasks, what is shuffled grows with the vectors and not with
    their square, a task holds two tiles of a pair at a time, and only pairs at or over the threshold leave it.
    """
    ship(vectors.sparkSession)
    hours = F.unix_seconds(F.col("ts").cast("timestamp")) / 3600
    rows = vectors.where(F.size("embedding") > 0).select("item_id", "model", "embedding", F.col("ts"), F.floor(hours / window_hours).alias("bucket"), (F.col(turn) if turn else F.lit(0)).cast("long").alias("turn"))
    if fresh is not None:
        rows = rows.join(fresh.select("item_id", F.lit(True).alias("new")), "item_id", "left").withColumn("new", F.coalesce("new", F.lit(False)))
    else:
        rows = rows.withColumn("new", F.lit(True))
    sizes = rows.groupBy("model", "bucket").agg(F.ceil(F.count_if("new") / TILE).cast("int").alias("fresh"), F.ceil(F.count_if(~F.col("new")) / TILE).cast("int").alias("known"))
    sizes = sizes.withColumn("cells", F.least(F.ceil((F.col("fresh") + F.col("known")) / GRID), F.lit(MOST_CELLS)).cast("int"))
    number = F.xxhash64("item_id")
    cut = rows.join(sizes, ["model", "bucket"]).withColumn("tile", F.when(F.col("new"), F.pmod(number, F.col("fresh"))).otherwise(F.col("fresh") + F.pmod(number, F.col("known"))).cast("int"))
    row = F.struct("item_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), "embedding", "new", "turn")
    tiles = written(cut.groupBy("model", "bucket", "tile").agg(F.collect_list(row).alias("rows"), F.max("new").alias("news"), F.pmod("tile", F.max("cells")).alias("cell")))
    # How many cells of the other side a tile meets, in its own bucket and in the next.
    cells = written(sizes.select("model", "bucket", "cells"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = tiles.select("model", "bucket", F.col("tile").alias("tile_a"), F.col("cell").alias("cell_a"), F.col("rows").alias("a"), F.col("news").alias("news_a"), F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)).alias("other"))
    left = left.join(cells.select("model", F.col("bucket").alias("other"), "cells"), ["model", "other"]).withColumn("cell_b", spread("cells")).drop("cells")
    # Within a bucket each pair of cells is met once.
    upper = (F.col("bucket") < F.col("other")) | (F.col("cell_a") <= F.col("cell_b"))
    left = left.where(upper)
    mine = cells.select("model", "bucket", "cells")
    # A right tile goes to the rows of its own bucket's grid and of the grid with the bucket before.
    own = tiles.join(mine, ["model", "bucket"]).select("model", "bucket", F.col("bucket").alias("other"), F.col("tile").alias("tile_b"), F.col("cell").alias("cell_b"), F.col("rows").alias("b"), F.col("news").alias("news_b"), spread("cells").alias("cell_a"))
    before = mine.select("model", "bucket", "cells", (F.col("bucket") + 1).alias("other"))
    earlier = tiles.select("model", F.col("bucket").alias("other"), F.col("tile").alias("tile_b"), F.col("cell").alias("cell_b"), F.col("rows").alias("b"), F.col("news").alias("news_b")).join(before, ["model", "other"])
    earlier = earlier.select("model", "bucket", "other", "tile_b", "cell_b", "b", "news_b", spread("cells").alias("cell_a"))
    right = own.unionByName(earlier).where(upper)
    pairs = left.join(right.hint("shuffle_merge"), ["model", "bucket", "other", "cell_a", "cell_b"])
    pairs = pairs.where(((F.col("bucket") < F.col("other")) | (F.col("cell_a") < F.col("cell_b")) | (F.col("tile_a") <= F.col("tile_b"))) & (F.col("news_a") | F.col("news_b")))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                same = batch.column("bucket")[k].as_py() == batch.column("other")[k].as_py() and batch.column("tile_a")[k].as_py() == batch.column("tile_b")[k].as_py()
                sides = []
                for side in ("a", "b"):
                    held = batch.column(side)[k].values
                    sizes = held.field("embedding").value_lengths()
                    sides.append((np.asarray(held.field("item_id")), np.asarray(held.field("at")), held.field("embedding"), np.asarray(sizes), np.asarray(held.field("new").to_numpy(zero_copy_only=False)), np.asarray(held.field("turn"))))
                (ids_a, at_a, va, na, new_a, turn_a), (ids_b, at_b, vb, nb, new_b, turn_b) = sides
                for width in np.intersect1d(na[na > 0], nb[nb > 0]):
                    ia, ib = np.flatnonzero(na == width), np.flatnonzero(nb == width)
                    ia, ib = ia[np.argsort(ids_a[ia], kind="stable")], ib[np.argsort(ids_b[ib], kind="stable")]
                    x, y = (np.asarray(v.take(pa.array(i)).flatten(), np.float64).reshape(-1, width) for v, i in ((va, ia), (vb, ib)))
                    near = x @ y.T
                    hit = (near >= threshold) & (np.abs(at_a[ia][:, None] - at_b[ib][None, :]) <= window_hours * 3600)
                    hit &= new_a[ia][:, None] | new_b[ib][None, :]
                    if same:
                        hit &= ids_a[ia][:, None] < ids_b[ib][None, :]
                    if turn:
                        near = np.where(hit, np.round(near, 6), -np.inf)
                        before = (turn_a[ia][:, None] < turn_b[ib][None, :]) | (turn_a[ia][:, None] == turn_b[ib][None, :]) & (ids_a[ia][:, None] < ids_b[ib][None, :])
                        down = new_a[ia][:, None] & (~new_b[ib][None, :] | before)
                        # Ids ascend, so the first of equals is the smallest.
                        for score, child, parent in ((np.where(down, near, -np.inf), ids_a[ia], ids_b[ib]), (np.where(down, -np.inf, near).T, ids_b[ib], ids_a[ia])):
                            first = score.argmax(1)
                            top = score[np.arange(len(child)), first]
                            own = np.flatnonzero(top > -np.inf)
                            yield pa.RecordBatch.from_arrays([pa.array(child[own]), pa.array(parent[first[own]]), pa.array(top[own])], names=["a", "b", "similarity"])
                        continue
                    i, j = np.nonzero(hit)
                    p, q = ids_a[ia][i], ids_b[ib][j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(np.round(near[i, j], 6))], names=["a", "b", "similarity"])

    return pairs.select("bucket", "other", "tile_a", "tile_b", "a", "b").mapInArrow(multiply, "a long, b long, similarity double")


def planes_needed(cosine: float, bits: int, recall: float) -> int:
    """Tables of `bits` random planes in which two vectors of this cosine share a cell at least once, with the given chance."""
    together = (1 - math.acos(min(1.0, max(-1.0, cosine))) / math.pi) ** bits
    return 1 if together >= recall else math.ceil(math.log(1 - recall) / math.log1p(-together))


def projected_pairs(vectors: DataFrame, threshold: float, window_hours: int = 72, fresh: DataFrame | None = None, recall: float = 0.98, bits: int | None = None, seed: int = 7) -> DataFrame:
    """similar_pairs by buckets: of the pairs at or over the threshold a share of `recall` at least can be expected (those
    at the threshold itself; likelier the more alike they are), and each is exact.

    A vector's cell in a table is on which sides of `bits` random planes it lies.  Only vectors of one cell of one of the
    tables are multiplied, in the same even tiles.  bits is chosen so that a cell of the most crowded window holds
    about a tile; with 0 bits, as for few vectors, or where so many tables are needed that cells save nothing, all
    are compared (exact).  Vectors of other lengths have planes, and cells, of their own.
    """
    ship(vectors.sparkSession)
    if bits is None:
        hours = F.unix_seconds(F.col("ts").cast("timestamp")) / 3600
        most = vectors.groupBy("model", F.floor(hours / window_hours)).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
        bits = max(0, min(24, math.ceil(math.log2(max(1, most) / TILE))))
    tables = planes_needed(threshold, bits, recall)
    if bits == 0 or tables >= 1 << bits:
        return similar_pairs(vectors, threshold, window_hours, fresh)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            sizes = np.asarray(pc.fill_null(lists.value_lengths(), 0))
            cells = np.zeros((batch.num_rows, tables), np.int64)
            for width in np.unique(sizes[sizes > 0]):
                at = np.flatnonzero(sizes == width)
                planes = np.random.default_rng([seed, int(width)]).standard_normal((int(width), tables * bits))
                sides = np.asarray(lists.take(pa.array(at)).flatten(), np.float64).reshape(-1, width) @ planes > 0
                cells[at] = sides.reshape(len(at), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("model"), batch.column("ts"), lists, pa.array(list(cells), pa.list_(pa.int64()))], names=["item_id", "model", "ts", "embedding", "cells"])

    kinds = dict(vectors.dtypes)
    placed = vectors.select("item_id", "model", "ts", "embedding").mapInArrow(place, f"item_id {kinds['item_id']}, model {kinds['model']}, ts {kinds['ts']}, embedding array<float>, cells array<long>")
    each = placed.select("item_id", "model", "ts", "embedding", F.posexplode("cells").alias("table", "cell"))
    keyed = each.withColumn("model", F.concat_ws("|", "model", F.col("table").cast("string"), F.col("cell").cast("string")))
    return similar_pairs(keyed.select("item_id", "model", "ts", "embedding"), threshold, window_hours, fresh).distinct()


def recent(vectors: DataFrame, model: str, as_of: str, window_hours: int = 72) -> DataFrame:
    """What a new vector may be a duplicate of: this model's vectors of items from `window_hours` before as_of on, however
    late they came in or lie in the future."""
    since = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {int(window_hours)} hours")
    return vectors.where((F.col("model") == model) & (F.col("ts") >= since))


def joined_clusters(items: DataFrame, vectors: DataFrame, fresh: DataFrame, model: str, as_of: str, threshold: float, window_hours: int = 72) -> DataFrame:
    """items with the new ones (fresh: item_id) put into clusters, and no more than that done again.

    New items come newest first, ties by larger id.  Each is compared with the recent vectors of known items and of new
    ones before it, joins the cluster of its best match (the smallest id of equals), or founds one headed by it.
    An item without a cluster that a new one joins becomes its head.
    """
    if threshold >= 1:
        return items
    held = recent(vectors, model, as_of, window_hours)
    fresh = fresh.join(held.select("item_id"), "item_id", "left_semi")
    turned = held.withColumn("turn", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("ts", F.lit(as_of).cast("timestamp_ntz"))
    edges = similar_pairs(turned, threshold, window_hours, fresh, "turn").select(F.col("a").alias("child"), F.col("b").alias("parent"), "similarity")
    best = edges.groupBy("child").agg(F.max(F.struct("similarity", (-F.col("parent")).alias("minus")))["minus"].alias("minus")).select("child", (-F.col("minus")).alias("parent"))
    roots = rooted(best)
    # A known item stands for the cluster it is in.
    heads = roots.join(items.select(F.col("id").alias("root"), "cluster_id"), "root").select("item_id", F.coalesce("cluster_id", "root").alias("head"))
    moved = heads.unionByName(heads.select(F.col("head").alias("item_id"), "head").distinct())
    moved = moved.groupBy("item_id").agg(F.min("head").alias("head")).withColumnRenamed("item_id", "id")
    return items.join(moved, "id", "left").withColumn("cluster_id", F.coalesce("head", "cluster_id")).select(items.columns)


def rooted(up: DataFrame) -> DataFrame:
    """(item_id, root) for each child of a forest (child, parent), by pointer jumping: as many rounds as the depth's
    logarithm, each written."""
    up = written(up.select("child", "parent"))
    while True:
        step = up.select(F.col("child").alias("parent"), F.col("parent").alias("grand"))
        jumped = written(up.join(step, "parent", "left").select("child", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved")))
        up = jumped.select("child", "parent")
        if jumped.where("moved").isEmpty():
            return up.select(F.col("child").alias("item_id"), F.col("parent").alias("root"))


def cluster_forest(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """(item_id, cluster_id): each item joins the best of its partners that came before it, and so that one's head.

    Items come newest first, ties by larger id.  An item's parent is its most similar earlier partner (the
    smallest id of equals); a cluster is a tree of parents and its head the root.  Items without a partner are
    not returned.
    """
    order = F.struct("ts", "item_id")
    at = vectors.select("item_id", order.alias("at"))
    both = pairs.join(at.select(F.col("item_id").alias("a"), F.col("at").alias("at_a")), "a").join(at.select(F.col("item_id").alias("b"), F.col("at").alias("at_b")), "b")
    later_a = F.col("at_a") < F.col("at_b")
    edges = both.select(F.when(later_a, F.col("a")).otherwise(F.col("b")).alias("child"), F.when(later_a, F.col("b")).otherwise(F.col("a")).alias("parent"), "similarity")
    best = edges.groupBy("child").agg(F.max(F.struct("similarity", (-F.col("parent")).alias("minus")))["minus"].alias("minus")).select("child", (-F.col("minus")).alias("parent"))
    up = rooted(best)
    heads = up.select(F.col("root").alias("item_id"), F.col("root").alias("cluster_id")).distinct()
    return up.select("item_id", F.col("root").alias("cluster_id")).unionByName(heads)

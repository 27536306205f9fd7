"""Best-fit packing of documents into token sequences, as a vector bin-packing problem.

A piece asks for three things of a sequence: tokens, one document slot, and attention cost (the square of
its length).  Which sequence takes it is decided by what would be left (`residual_norm`) or by how well
the piece matches what is free (`dot_product`), under every capacity.

Demands depend on a piece's length alone, so pieces of one length are interchangeable: the whole decision
is made over the histogram of lengths, which has at most `capacity` rows whatever the input, and
sequences in the same state are handled together.  Each decision becomes a run "the pieces of length L
ranked r .. r + n go to the sequences s .. s + n at this offset".  A piece's rank within its length is its
rank within its map task plus what earlier tasks hold, so no length is ever gathered in one place.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, byte_texts, single_threaded, slices, written

#: Lead bytes from here on start characters above U+02FF.
_HIGH = bytes(range(0xCC, 0x100))
#: The faster library fails on about a million characters of white space in a row.
BLANK_RUN = 1 << 18


@lru_cache(maxsize=2)
def _exact(json_path: str):
    """The library that defines the ids."""
    single_threaded()
    from tokenizers import Tokenizer

    return Tokenizer.from_file(json_path)


@lru_cache(maxsize=2)
def _fast(rank_path: str):
    """A faster library with the same vocabulary."""
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(rank_path, "rb"))}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _long_blank(text: str) -> bool:
    return len(text) >= BLANK_RUN and any(m.end() - m.start() >= BLANK_RUN for m in re.finditer(r"\s+", text))


def readable(text: bytes) -> str:
    """Bytes that are no UTF-8 become U+FFFD, as Spark shows them."""
    return text.decode("utf-8", "replace")


def encode(text: str, json_path: str, rank_path: str | None = None) -> list[int]:
    """The ids that the JSON file's library gives.

    The rank file holds the same vocabulary and merges in a library about four times as fast.  It serves
    texts of characters up to U+02FF without the start of a special string; there the two libraries' character
    classes are the same.  All other texts, and those with very long runs of white space, go to the first library,
    which is loaded once one comes.
    """
    if rank_path is not None and "<|" not in text and not _long_blank(text):
        raw = text.encode()
        if len(raw.translate(None, _HIGH)) == len(raw):
            return _fast(rank_path).encode_ordinary(text)
    return _exact(json_path).encode(text, add_special_tokens=False).ids


def piece_tokens(json_path: str, rank_path: str | None = None):
    """A function that says how many tokens pack() makes of a text's bytes, the end included."""
    return lambda text: len(encode(readable(text), json_path, rank_path)) + 1


def pieces_of(ids: np.ndarray, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces: one if it fits, else `capacity` long each but the first, which takes the rest."""
    n = len(ids)
    first = n if n <= capacity else n % capacity or capacity
    yield 0, first
    for start in range(first, n, capacity):
        yield start, capacity


@dataclass(frozen=True)
class Limits:
    """A sequence's capacities; None leaves that one open.  weights: of tokens, documents and attention cost, each
    taken as a share of its capacity."""

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None
    rule: str = "residual_norm"
    weights: tuple[float, float, float] = (1.0, 1e-6, 1e-6)

    def capacity(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.int64)


@dataclass
class Plan:
    """By length: first rank, first sequence and offset of each run; ranks run on within a run."""

    runs: dict[int, list[tuple[int, int, int]]] = field(default_factory=dict)
    sequences: int = 0


def best_fit(histogram: dict[int, int], limits: Limits) -> Plan:
    """Best-fit decreasing over (length, how many); see the module's text."""
    cap = limits.capacity()
    weights = np.array(limits.weights) / cap
    plan = Plan()
    states = np.zeros((64, 3), np.int64)
    numbers: dict[tuple[int, ...], int] = {}
    counts = np.zeros(64, np.int64)
    bins: list[list[list[int]]] = []

    def put(state: np.ndarray, first: int, n: int) -> None:
        nonlocal states, counts
        k = numbers.setdefault(tuple(state.tolist()), len(numbers))
        if k == len(bins):
            if k == len(states):
                states, counts = np.concatenate((states, np.zeros_like(states))), np.concatenate((counts, np.zeros_like(counts)))
            states[k] = state
            bins.append([])
        bins[k].append([first, n])
        counts[k] += n

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        need = np.array([length, 1, length * length], np.int64)
        if (need > cap).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        runs = plan.runs.setdefault(length, [])
        most = int((cap // need).min())
        while left:
            used = len(numbers)
            fits = np.flatnonzero((counts[:used] > 0) & (states[:used] >= need).all(1))
            if not len(fits):
                n = -(-left // most)
                put(cap.copy(), plan.sequences, n)
                plan.sequences += n
                continue
            free = states[fits]
            score = (((free - need) * weights) ** 2).sum(1) if limits.rule == "residual_norm" else -((free * weights) * (need * weights)).sum(1)
            k = int(fits[np.argmin(score)])
            spans = bins[k]
            while left and spans:
                first, n = spans[-1]
                take = min(n, left)
                if take == n:
                    spans.pop()
                else:
                    spans[-1] = [first + take, n - take]
                counts[k] -= take
                runs.append((rank, first, int(cap[0] - states[k][0])))
                put(states[k] - need, first, take)
                rank += take
                left -= take
    return plan


def pack(df: DataFrame, json_path: str, rank_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, limits: Limits = Limits()) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids and then end_id, so null and empty texts are one piece of one token.  Only
    documents over the token capacity are cut, however long, and bytes that are no UTF-8 are read as U+FFFD.  Repeated rows are each packed, and which of equally long
    pieces goes where follows from how rows stand in their partitions.  An empty table gives an empty result; other
    columns are ignored.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    capacity = limits.tokens

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ranks = TaskContext.get().partitionId(), {}
        for batch in slices(batches):
            out = []
            for k, text in enumerate(byte_texts(batch.column("text"))):
                ids = np.array([*encode(readable(text), json_path, rank_path), end_id], "<u4")
                for piece, (start, length) in enumerate(pieces_of(ids, capacity)):
                    rank = ranks.get(length, 0)
                    ranks[length] = rank + 1
                    out.append((k, piece, start, length, zlib.crc32(ids[start : start + length].tobytes()), part, rank))
            at, piece, start, length, crc, parts, rank = zip(*out, strict=True) if out else [()] * 7
            ids_of = batch.column("doc_id").take(pa.array(at, pa.int32()))
            columns = [ids_of, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array(parts, pa.int32()), pa.array(rank, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    cuts = written(arrow_map(rows, cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long"))
    held = cuts.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    # At most `capacity` rows.
    plan = best_fit({r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}, limits)
    # A run ends with its length or with the sequences of one state, so they are about as many as lengths and states.
    tables = df.sparkSession.sparkContext.broadcast({length: tuple(np.array(x, np.int64) for x in zip(*runs, strict=True)) for length, runs in plan.runs.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length):
                own = np.flatnonzero(length == x)
                first, start, at = tables.value[int(x)]
                run = np.searchsorted(first, rank[own], "right") - 1
                sequence[own], offset[own] = start[run] + rank[own] - first[run], at[run]
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cuts.join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("earlier")).alias("rank"))
    return arrow_map(ranked, place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

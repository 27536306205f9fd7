"""Token counts: batch encoding of different words inside Arrow functions that return lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, single_threaded, slices

#: One call of the library gets about so many bytes: long and short texts then take alike long a call,
#: and what a call holds in memory doesn't depend on how many long texts stand together.
CALL_BYTES = 1 << 20
#: Longer texts are cut at safe boundaries, so no call sees an unbounded text.
PIECE_BYTES = 1 << 18

#: A cut stands before a white-space run that lies between two ASCII letters or digits.  A pre-token holds
#: no white space, and neither normalisation nor a special token's string reaches across such a run,
#: so the parts' tokens are the text's tokens.
SAFE = re.compile(r"(?<=[0-9A-Za-z])[ \n](?=[0-9A-Za-z])")

#: Pre-tokens that hold no white space and look at none beside them.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: A word's tokens are kept for later texts; so many words of up to so many characters are, about 100 MB a worker.
KEPT_WORDS, KEPT_CHARS = 500_000, 64


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    single_threaded()
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def _known(path: str) -> dict[str, int]:
    """Tokens of the words that a worker has met."""
    return {"": 0}


def safe_pieces(text: str, most: int = PIECE_BYTES) -> list[str]:
    """The text cut at the first safe boundary after every `most` characters; their concatenation is the text.

    A text without such a boundary stays whole: an unsafe cut could change its tokens.
    """
    if len(text) <= most:
        return [text]
    out, at = [], 0
    while len(text) - at > most:
        cut = SAFE.search(text, at + most)
        if not cut:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


@lru_cache(maxsize=4)
def _drops_blanks(path: str) -> bool:
    """Whether a vocabulary's file says that its tokens are those of the words between spaces and line ends: normalisers
    that change characters alone, pre-tokens that hold no white space, and no special string with white space or that takes
    the white space around it."""
    import json

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    normal, cut = file.get("normalizer") or {}, file.get("pre_tokenizer") or {}
    steps = [s for s in normal.get("normalizers", [normal]) if s]
    plain = all(s["type"] in ("NFC", "NFD", "Lowercase") or s["type"] == "Replace" and s["pattern"] == {"Regex": "\\s+"} and s["content"] == " " for s in steps)
    first = (cut.get("pretokenizers") or [cut])[0]
    words = first.get("type") == "Split" and first["behavior"] == "Removed" and first["invert"] and first["pattern"] == {"Regex": WORDS}
    rest = all(s["type"] == "ByteLevel" and not s["add_prefix_space"] and not s["use_regex"] for s in (cut.get("pretokenizers") or [])[1:])
    special = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and not re.search(r"\s", t["content"]) for t in file.get("added_tokens", []))
    return plain and words and rest and special and not file.get("post_processor") and not file["model"].get("dropout")


def lengths(texts: list[str], path: str, call_bytes: int = CALL_BYTES, piece_bytes: int = PIECE_BYTES) -> list[int]:
    """Tokens of each text, without added special tokens; calls are balanced by size.

    The library gives a text the tokens of its words, one after the other: spaces and line ends are in no token and no
    special string, each pre-token lies between two of them, neither composes with a mark, and letters are lower-cased
    one by one.  So each different word is encoded once, and a text's tokens are the sum of its words'.  This holds for
    tokenizers that drop white space, as the vocabulary of words does, and is checked when a vocabulary is loaded; others
    get their texts whole.
    """
    encoder, counts, known = _tokenizer(path), [0] * len(texts), _known(path)
    by_words = _drops_blanks(path)
    held, size = [], 0

    def flush() -> None:
        nonlocal size
        fresh = list(set().union(*(parts for _, parts in held)).difference(known))
        for a in range(0, len(fresh), 4096):
            some = fresh[a : a + 4096]
            known.update(zip(some, map(len, encoder.encode_batch_fast(some, add_special_tokens=False)), strict=True))
        for k, parts in held:
            counts[k] += sum(map(known.__getitem__, parts))
        if len(known) > KEPT_WORDS:
            known.clear()
            known[""] = 0
        else:
            for word in fresh:
                if len(word) > KEPT_CHARS:
                    del known[word]
        held.clear()
        size = 0

    for k, text in enumerate(texts):
        for piece in safe_pieces(text, piece_bytes):
            held.append((k, piece.replace("\n", " ").split(" ") if by_words else [piece]))
            size += len(piece.encode())
            if size >= call_bytes:
                flush()
    if held:
        flush()
    return counts


def token_counts(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row.

    A null text counts as empty (0 tokens).  Special strings within a text are handled as the library's
    default does.  Repeated rows are each counted; an empty table gives an empty result; other columns
    are ignored.  No shuffle: rows stay in the partitions of the scan.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text")
            n_bytes = pa.compute.binary_length(texts).cast(pa.int64())
            n_tokens = pa.array(lengths(texts.to_pylist(), tokenizer_path), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n_bytes, n_tokens], names=["doc_id", "n_bytes", "n_tokens"])

    kind = dict(rows.dtypes)["doc_id"]
    counted = arrow_map(rows, count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))

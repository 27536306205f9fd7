"""FNV-1a, 64 bits: a stable identity for what has none."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the published algorithm.
OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(data: bytes) -> int:
    out = OFFSET
    for byte in data:
        out = (out ^ byte) * PRIME & 0xFFFFFFFFFFFFFFFF
    return out


def fnv1a_hex(text: Column) -> Column:
    """16 hex digits for each text; null stays null.  64-bit products overflow a long, so this one is an Arrow UDF."""

    @F.pandas_udf("string")
    def hashed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else f"{fnv1a(t.encode()):016x}")

    return hashed(text)


def stable_guid(guid: Column, url: Column, title: Column, published: Column, text: Column) -> Column:
    """The source's guid, else the url, else a hash of title, date and the text's first 200 characters."""
    parts = [F.coalesce(x, F.lit("")) for x in (title, published, F.left(text, F.lit(200)))]
    return F.coalesce(
        F.nullif(F.trim(guid), F.lit("")), url, F.concat(F.lit("item:"), fnv1a_hex(F.concat(parts[0], F.lit("\u0001"), parts[1], F.lit("\u0001"), parts[2])))
    )

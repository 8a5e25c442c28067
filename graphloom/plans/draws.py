"""Draws that any engine with md5 can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a draw, 13 hexadecimal digits.
BITS = 52


def drawn(*parts: Column | str, seed: int) -> Column:
    """A number from 0 to 2^52 - 1, from the md5 of the parts and the seed joined by colons."""
    joined = F.concat_ws(":", *((F.col(p) if isinstance(p, str) else p).cast("string") for p in parts), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("long")


def drawn_sql(*parts: str, seed: int) -> str:
    """The same in DuckDB."""
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)}, '{seed}')), 1, 13) AS BIGINT)"

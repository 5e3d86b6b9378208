"""Repeatable pseudo-random order from row keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .columns import col

HEX_DIGITS = 13  # 52 bits: every value is exact as a double


def key_text(keys: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(col(k).cast("string"), F.lit("\\N")) for k in keys])


def hash_order(keys: Sequence[str], seed: int = 42) -> Column:
    """52-bit integer from md5 of the key columns and a seed."""
    digest = F.md5(F.concat_ws("|", key_text(keys), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("long")

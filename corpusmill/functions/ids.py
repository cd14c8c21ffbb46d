"""Stable identifiers: prefix plus the first 24 hex digits of a hash over NUL-joined parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(prefix: str, *parts: Column | str) -> Column:
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    joined = F.concat_ws("\u0000", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(joined, 256), 1, 24))

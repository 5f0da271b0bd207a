"""Record ids that come out the same however often a plan is recomputed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def id_part(part: Column) -> Column:
    """A part of an id with its length in front, NULL as ``-``.

    So parts that hold a separator, are empty or are missing never read alike.
    """
    text = part.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def stable_id(prefix: str, *parts: Column) -> Column:
    """Prefix and the first 48 hex digits of the SHA-256 of the parts (ids are at most 60 characters long)."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *map(id_part, parts)), 256), 1, 48))


def digest_part(record_id: Column) -> Column:
    """One record's share of an order-free digest: the first eight hex digits of its MD5 as a number."""
    return F.conv(F.substring(F.md5(record_id.cast("string")), 1, 8), 16, 10).cast("decimal(20,0)")

"""Canonical JSON and content digests."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON text with sorted keys, so that equal content has equal text."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def content_hash(fields: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(fields), 256)

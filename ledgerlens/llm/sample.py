"""Bounded samples of labelled rows, for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 30


def fold(doc_id: Column, parts: int) -> Column:
    """The remainder of the CRC-32 of the id's text; a null id falls in no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def per_class(rows: DataFrame, label: str, most: int | dict, *key: str) -> DataFrame:
    """About `most` rows of each label at most (or of those it names), chosen by a hash of `key`.

    The share taken of each label follows from its count, so the choice covers the whole table,
    does not depend on partitions, and takes everything where a label has fewer rows. Labels
    are expected to be few: one share for each is collected.
    """
    counts = rows.groupBy(label).count().collect()
    slot = F.pmod(F.xxhash64(*[F.col(k) for k in key], F.lit("sample")), F.lit(SLOTS))
    limit = F.lit(0)
    for r in counts:
        if r[label] is not None:
            bound = most.get(r[label], 0) if isinstance(most, dict) else most
            share = min(SLOTS, int(SLOTS * bound / r["count"]))
            limit = F.when(F.col(label) == F.lit(r[label]), F.lit(share)).otherwise(limit)
    return rows.filter(slot < limit)


def labelled(documents: DataFrame, chosen: DataFrame, columns: list[str]) -> DataFrame:
    """The texts of chosen (doc_id, label) rows.

    `chosen` is bounded by the sample's size, so it goes to the documents, which stay in place.
    """
    return documents.select(*columns).join(F.broadcast(chosen), "doc_id")

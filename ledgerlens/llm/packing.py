"""Conflict-constrained best-fit packing of documents into fixed-size training sequences.

Lengths are in characters. A document longer than a sequence is cut into pieces: whole sequences,
each a bin of its own, and a rest. Rests and short documents are placed longest first. Bins are
ordered by residual space and carry two bitmaps, of the sources and of the duplicate clusters they
hold. The search starts at the tightest bin with room and goes on to its successors until one holds
neither the document's source nor its cluster; without any, a new bin opens. So no sequence
holds two documents of one source or two copies of one text.

Documents are dealt to shards of about `shard_rows` pieces by row, not by key: a hot source or a
group of thousands of copies spreads over all shards. Each shard packs on its own, the price is one
partly filled set of bins for a shard.

Defined results: a null or empty text takes no room: one row without bin (bin null, length 0). A null
source never conflicts, nor does a null cluster. Repeated rows are packed like any others. Ties
in length go by id and place; of bins with equal residual the oldest comes first. Extra columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import near_dup
from ledgerlens.session import durable

PIECES = "piece long, start long, length long, bin string, bin_start long"


class Bins:
    """Open bins by residual, oldest first; each with the bitmaps of what it holds."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []  # (residual, number)
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def place(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset in it) for a piece; `source` and `cluster` are single bits, or 0."""
        at = bisect_left(self.order, (length, -1))
        while at < len(self.order):
            residual, number = self.order[at]
            if not (self.sources[number] & source or self.clusters[number] & cluster):
                del self.order[at]
                break
            at += 1
        else:
            residual, number = self.capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
        self.sources[number] |= source
        self.clusters[number] |= cluster
        if residual > length:
            insort(self.order, (residual - length, number))
        return number, self.capacity - residual


def pack_shard(rows: pd.DataFrame, capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset for each of a shard's rows (length, source, cluster), longest first."""
    bins = Bins(capacity)

    def bits(values) -> list[int]:
        """One bit for each value that occurs twice or more; others cannot conflict."""
        codes, _ = pd.factorize(values)  # missing: -1
        often = np.bincount(codes[codes >= 0], minlength=1) > 1
        place = np.cumsum(often) - 1
        return [1 << int(place[c]) if c >= 0 and often[c] else 0 for c in codes]

    found = [
        bins.place(n, s, c)
        for n, s, c in zip(rows["length"].tolist(), bits(rows["source"]), bits(rows["cluster"]))
    ]
    return [b for b, _ in found], [at for _, at in found]


def clustered(documents: DataFrame) -> DataFrame:
    """(doc_id, source, text, cluster) of every row: near copies are one cluster, whatever their source.

    Equal texts always are one, also without an id or without words, which near_dup does not link.
    """
    own = documents.select("doc_id", "source", "text", F.xxhash64("text").alias("key"))
    near = near_dup.near_duplicates(documents.select("doc_id", "text"))
    near = near.filter("doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id")
    near = near.agg(F.xxhash64(F.min("component_id")).alias("component"))
    # By text, so that a row without an id finds the cluster of its copies.
    of_text = own.select("doc_id", "key").join(near, "doc_id").groupBy("key").agg(F.min("component").alias("component"))
    cluster = F.coalesce("component", "key").alias("cluster")
    return own.join(of_text, "key", "left").select("doc_id", "source", "text", cluster)


def pack(
    documents: DataFrame,
    capacity: int = 8192,
    shard_rows: int = 4096,
    cluster: Column | None = None,
) -> DataFrame:
    """(doc_id, piece, start, length, bin, bin_start) of every piece of every document row.

    `documents` has doc_id, source and text. `cluster` names a row's duplicate cluster; by default
    rows with equal texts are one.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select(
        "doc_id",
        F.xxhash64("source").alias("source_key"),
        F.col("source").isNull().alias("no_source"),
        (F.xxhash64("text") if cluster is None else cluster).alias("cluster"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"),
    )
    if cluster is not None:
        # Clusters come by joins, whose rows have no fixed order: numbered as written, without texts.
        rows = durable(rows, "lengths")
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    shards = max(1, -(-rows.count() // shard_rows))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    schema = f"doc_id {kind}, {PIECES}"

    def packed(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "row"], kind="stable", ignore_index=True)
        whole = (group["n"] // capacity).to_numpy()
        rest = (group["n"] - whole * capacity).to_numpy()
        out = []
        owner = np.repeat(np.arange(len(group)), whole)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(whole) - whole, whole)
        out.append(pd.DataFrame({
            "at": owner, "piece": piece, "start": piece * capacity, "length": capacity,
            "bin": [f"{key[0]}-{k}-{p}" for k, p in zip(group["row"].to_numpy()[owner], piece)],
            "bin_start": 0,
        }))
        at = np.flatnonzero(rest > 0)
        at = at[np.argsort(-rest[at], kind="stable")]
        part = group.iloc[at]
        numbers, starts = pack_shard(pd.DataFrame({
            "length": rest[at],
            "source": part["source_key"].astype("Int64").mask(part["no_source"]).array,
            "cluster": part["cluster"].array,
        }), capacity)
        out.append(pd.DataFrame({
            "at": at, "piece": whole[at], "start": whole[at] * capacity, "length": rest[at],
            "bin": [f"{key[0]}-{b}" for b in numbers], "bin_start": starts,
        }))
        at = np.flatnonzero(group["n"] == 0)
        out.append(pd.DataFrame({
            "at": at, "piece": 0, "start": 0, "length": 0, "bin": None, "bin_start": 0,
        }))
        done = pd.concat([x for x in out if len(x)], ignore_index=True)
        done["doc_id"] = group["doc_id"].array.take(done["at"].to_numpy())
        return done[["doc_id", "piece", "start", "length", "bin", "bin_start"]]

    return rows.groupBy("shard").applyInPandas(packed, schema)


def sequences(pieces: DataFrame, documents: DataFrame, separator: str = "") -> DataFrame:
    """(bin, text): the packed sequences themselves; ids must be unique here."""
    part = pieces.filter("bin IS NOT NULL").join(documents.select("doc_id", "text"), "doc_id")
    part = part.withColumn("part", F.expr("substring(text, int(start + 1), int(length))"))
    held = F.sort_array(F.collect_list(F.struct("bin_start", "part")))
    joined = F.array_join(F.transform(held, lambda x: x["part"]), separator)
    return part.groupBy("bin").agg(joined.alias("text"))

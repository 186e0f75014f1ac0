"""Document fingerprints: bottom-k sketches of word-shingle hashes.

The fingerprint of a text is the k smallest of its distinct 64-bit shingle hashes. Fingerprints of
parts merge into that of the whole by keeping the k smallest of their union. Two fingerprints
estimate resemblance (the share of their union's k smallest that both hold), containment and the
number of distinct shingles (from where the k-th hash lies in the range of hashes; exact below k).

DataFrame functions only. Words are maximal runs of anything but white space, compared in lower case.
A text with fewer words than a shingle is one shingle of them all; one without words has none.

Defined results: a null text counts as empty. Two empty fingerprints resemble each other fully, an
empty and a filled one not at all. Equal texts have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import durable

K, WORDS = 128, 5
SPACE = r"[\x20\x09-\x0D]+"
RANGE = float(1 << 64)


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """The k smallest distinct shingle hashes of a text, ascending."""
    held = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE, -1), lambda w: w != "")
    hashed = F.transform(held, lambda w: F.xxhash64(w))
    return F.transform(F.array(hashed), lambda h: _bottom(_shingles(h, words), k))[0]


def _shingles(h: Column, words: int) -> Column:
    """Hashes of runs of word hashes. `h` must be a lambda's variable, so that it is made once."""
    starts = F.sequence(F.lit(1), F.size(h) - (words - 1))
    runs = F.transform(starts, lambda i: F.xxhash64(*[F.element_at(h, i + j) for j in range(words)]))
    short = F.when(F.size(h) > 0, F.array(F.xxhash64(F.array_join(h, " ")))).otherwise(
        F.array().cast("array<bigint>")
    )
    return F.when(F.size(h) >= words, runs).otherwise(short)


def _bottom(hashes: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(first: Column, second: Column, k: int = K) -> Column:
    """The fingerprint of two parts together."""
    return F.slice(F.sort_array(F.array_union(first, second)), 1, k)


def resemblance(first: Column, second: Column, k: int = K) -> Column:
    """Estimate of intersection by union, 0 to 1."""
    union = merge(first, second, k)
    both = F.size(F.array_intersect(F.array_intersect(union, first), second))
    return F.when(F.size(union) == 0, 1.0).otherwise(both / F.size(union))


def distinct_count(fingerprint: Column, k: int = K) -> Column:
    """Estimate of the number of distinct shingles; exact below k."""
    share = (F.get(fingerprint, F.lit(k - 1)) / F.lit(RANGE)) + 0.5
    return F.when(F.size(fingerprint) < k, F.size(fingerprint).cast("double")).otherwise((k - 1) / share)


def containment(part: Column, whole: Column, k: int = K) -> Column:
    """Estimate of the share of `part`'s shingles that `whole` holds, 0 to 1."""
    both = resemblance(part, whole, k) * distinct_count(merge(part, whole, k), k)
    own = distinct_count(part, k)
    return F.when(own == 0, 1.0).otherwise(F.least(F.lit(1.0), both / own))


def as_text(fingerprint: Column) -> Column:
    """A fingerprint as a string: 16 hexadecimal digits for each hash, in order."""
    return F.array_join(F.transform(fingerprint, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def next_ids(documents: DataFrame) -> DataFrame:
    """(doc_id, next_id): for each id the next larger one, for the largest the smallest.

    Only ids are moved: they are dealt out in ranges, each range is sorted by itself, and its last
    id takes the first of the range after it.
    """
    ids = documents.select("doc_id").dropna().distinct()
    dealt = durable(
        ids.repartitionByRange(F.col("doc_id")).select("doc_id", F.spark_partition_id().alias("range")),
        "ids",
    )
    ranges = dealt.groupBy("range").agg(F.min("doc_id").alias("first"))
    # One row for each range.
    order = Window.partitionBy(F.lit(0)).orderBy("first")
    whole = Window.partitionBy(F.lit(0))
    after = F.coalesce(F.lead("first").over(order), F.min("first").over(whole))
    ranges = ranges.select("range", after.alias("after"))
    inside = Window.partitionBy("range").orderBy("doc_id")
    found = dealt.withColumn("next_id", F.lead("doc_id").over(inside))
    return found.join(ranges, "range").select(
        "doc_id", F.coalesce("next_id", "after").alias("next_id")
    )


def with_neighbours(documents: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """(doc_id, text, edited, fingerprint, next_fingerprint) of every row of (doc_id, text).

    `edited` is the text whose last floor(n / 2) characters gave way to as many of the first
    characters of the document with the next larger id (to all, if it has fewer). A text moves
    once, by its id; what its predecessor needs of it, a head and the fingerprint, moves once more.
    Rows that repeat an id share the next larger id; of several rows with that id the one with the
    smallest head serves. A row with a null id has no next document: nothing replaces its last half
    and the next fingerprint is empty.
    """
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    named = docs.filter("doc_id IS NOT NULL")
    size = named.groupBy("doc_id").agg(F.max(F.length("text")).alias("n"))
    needs = next_ids(documents).join(size, "doc_id").select(
        F.col("next_id").alias("doc_id"), F.col("doc_id").alias("of"), F.expr("n div 2").alias("most")
    )
    sent = named.join(needs, "doc_id").select(
        F.col("of").alias("doc_id"),
        F.substr("text", F.lit(1), F.col("most").cast("int")).alias("head"),
        sketch(F.col("text"), k, words).alias("next_fingerprint"),
    )
    # Dealt out first, so that the rows are sorted once for the minimum and for the join.
    sent = sent.repartition("doc_id").groupBy("doc_id").agg(
        F.min(F.struct("head", "next_fingerprint")).alias("next")
    )
    rows = named.join(sent, "doc_id").select("doc_id", "text", "next.head", "next.next_fingerprint")
    alone = docs.filter("doc_id IS NULL").select(
        "doc_id",
        "text",
        F.lit("").alias("head"),
        F.array().cast("array<bigint>").alias("next_fingerprint"),
    )
    half = F.expr("int(length(text) div 2)")
    edited = F.concat(
        F.substr("text", F.lit(1), F.length("text") - half), F.substr("head", F.lit(1), half)
    )
    return rows.union(alone).select(
        "doc_id",
        "text",
        edited.alias("edited"),
        sketch(F.col("text"), k, words).alias("fingerprint"),
        "next_fingerprint",
    )

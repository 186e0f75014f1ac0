"""Line dedup by site-relative frequency: lines on too large a share of a host's pages go.

For every host, the pages that contain a line are counted (a page counts once, however often it
repeats the line) and divided by the host's pages. A line above the boilerplate ratio, and on at
least `least_pages` pages, is boilerplate of that host and leaves all its pages. Lines are
compared without white space at their ends and are known by 64-bit hash within their host; blank
lines stay, as they hold nothing.

No host is exempt for being small. Where the ratio comes to fewer than `few` pages, one pair of
copies would pass it, so there the bar is `few` pages, or all pages of a host that has fewer: with
the defaults all of 2 or 3 pages, 3 of 10 (30 %), 3 of 29, and from 30 pages on the ratio itself. A
lone page repeats nothing and keeps its lines; two copies that are all of a host lose theirs.
`least_pages` is a floor for hosts of any size: above 2 it exempts small hosts again.

DataFrame functions only. Only (host, line hash) pairs are shuffled, summed on the map side first.
A host's boilerplate is one array of hashes: its length is at most the mean number of lines on a
page divided by the ratio, however large the host, so no group grows with the data. The pages
meet these arrays by host: below Spark's own broadcast limit they come to the pages, beyond it
adaptive execution splits hot hosts.

Defined results: a null host is no site, its pages keep all lines. A null text stays null, an empty
one empty. Repeated rows are pages of their own. A page whose lines all go keeps an empty text.
Other columns, whatever their names, are handed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import durable

def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hash(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(" \t\r\x0b\x0c")))


def _blank(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(" \t\r\x0b\x0c"))) == 0


def boilerplate(
    pages: DataFrame, host: str, text: str, ratio: float = 0.1, least_pages: int = 2, few: int = 3
) -> DataFrame:
    """(host, lines): the hashes of each host's boilerplate lines, hosts without any left out."""
    page = pages.select(F.col(host).alias("host"), F.col(text).alias("text")).filter("host IS NOT NULL")
    totals = page.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    held = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: ~_blank(x)), _hash))
    counts = (
        page.select("host", F.explode(held).alias("line"))
        .groupBy("host", "line").agg(F.count(F.lit(1)).alias("on"))
        .filter(F.col("on") >= least_pages)
    )
    bar = (F.col("on") > ratio * F.col("pages")) & (F.col("on") >= F.least("pages", F.lit(few)))
    common = counts.join(totals, "host").filter(bar)
    return common.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def drop_boilerplate(
    pages: DataFrame, host: str, text: str, ratio: float = 0.1, least_pages: int = 2, few: int = 3
) -> DataFrame:
    """(row, text, dropped): each page's row as a struct, its remaining text, lines dropped."""
    rows = pages.select(F.struct("*").alias("row"), F.col(host).alias("host"), F.col(text).alias("text"))
    # Written first: a small table is then known to be small and goes to the pages, and a large
    # one is joined by a plain shuffle, whose hot hosts can be split.
    found = durable(boilerplate(pages, host, text, ratio, least_pages, few), "boilerplate")
    joined = rows.join(found, "host", "left")
    parts = _lines(F.col("text"))
    # array_except and array_intersect look hashes up in a set, once for a page.
    hit = F.array_intersect(F.transform(parts, _hash), F.col("lines"))
    kept = F.filter(parts, lambda x: _blank(x) | ~F.array_contains(F.col("hit"), _hash(x)))
    out = joined.withColumn("hit", F.coalesce(hit, F.array().cast("array<bigint>")))
    clean = F.when(F.size("hit") > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))
    return out.select(
        "row",
        clean.alias("text"),
        F.when(F.size("hit") > 0, F.size(parts) - F.size(kept)).otherwise(0).cast("long").alias("dropped"),
    )


def cleaned(documents: DataFrame, ratio: float = 0.1, least_pages: int = 2, few: int = 3) -> DataFrame:
    """`documents` with boilerplate lines of each source gone and `n_chars` counted anew."""
    done = drop_boilerplate(documents, "source", "text", ratio, least_pages, few)
    columns = []
    for name in documents.columns:
        old = F.col("row").getField(name)
        if name == "text":
            columns.append(F.col("text"))
        elif name == "n_chars":
            kind = documents.schema["n_chars"].dataType
            changed = F.col("dropped") > 0
            columns.append(F.when(changed, F.length("text").cast(kind)).otherwise(old).alias(name))
        else:
            columns.append(old.alias(name))
    return done.select(*columns)

"""All-string CSV reading with a quarantine for rows that belong to other sheets."""

from __future__ import annotations

import csv
import io
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.session import durable
from ledgerlens.ship import ship
from ledgerlens.sources.quoting import PIECES, SUMMARY, stitched, summaries
from ledgerlens.sources.tables import begin, release, shown, switch, write_version

BAD = "_rejected_line"
FILE = "_source_file"
MOST_BATCHES = 64  # tables that a landed view is made of

CSV_OPTIONS = {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}

_FIRST = Window.unboundedPreceding


class Landed(NamedTuple):
    kept: DataFrame
    rejected: DataFrame


def _marked(parsed: DataFrame, names: list[str], *keep: str) -> DataFrame:
    """All rows: empty fields as NULL, and the text of a line that does not fit beside them."""
    # Always true. Spark refuses queries that touch nothing but the marker, such as a count of
    # the rejected lines, so every query is made to look at the first column too.
    parsed = parsed.filter(F.length(F.concat_ws("", F.col(f"`{names[0]}`"), F.col(BAD))) >= 0)
    return parsed.select(*[F.nullif(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names], BAD, *keep)


def split(marked: DataFrame) -> Landed:
    """Rows with as many fields as the header, and the text of all others."""
    return Landed(
        marked.filter(F.col(BAD).isNull()).drop(BAD),
        marked.filter(F.col(BAD).isNotNull()).select(F.col(BAD).alias("line")),
    )


def _blank(value: Column) -> Column:
    return F.length(F.btrim(value, F.lit(" \t\r"))) == 0


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Physical lines with file, split and a number that rises within a split.

    Line feeds end lines; a carriage return before one stays, as it may belong to a field. Byte-order
    marks at the beginning of lines go.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    return read.select(
        F.when(F.startswith("value", F.lit("\ufeff")), F.expr("substring(value, 2)")).otherwise(F.col("value")).alias("value"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )


def _pin_splits(spark: SparkSession) -> None:
    """Make every scan of a path cut it into the same splits, however many executors there are.

    Left to itself, Spark cuts small inputs by the cores at hand, which may change between scans.
    """
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(spark.sparkContext.defaultParallelism))


def _after(state: Column, constant: Column, swaps: Column) -> Column:
    """The state behind a run of lines: of its last constant line if any, then the swaps since."""
    since = F.coalesce(swaps - constant["swaps"], swaps)
    return F.coalesce(constant["to"], state) != (since % 2 == 1)


def _split_states(lines: DataFrame) -> DataFrame:
    """One row for each split: how it begins and ends, and where the record began that it begins in.

    (file, block, open, left_open, later, start, heads, head): whether a quoted field is open before and
    behind it, the next split of the file, the split of the open record, whether the file's header
    begins here, and that header, if it ends here too. The state before a split follows from the
    last constant one and the parity of the swaps since.
    """
    found = lines.select("value", "file", "block").mapInArrow(summaries, SUMMARY)
    ordered = Window.partitionBy("file").orderBy("block")
    so_far, earlier = ordered.rowsBetween(_FIRST, 0), ordered.rowsBetween(_FIRST, -1)
    found = found.withColumn("odd", (F.col("from_text") & ~F.col("from_field")).cast("int"))
    found = found.withColumns(
        {
            "swaps": F.sum("odd").over(so_far),
            "constant": F.col("from_text") == F.col("from_field"),
            "to": F.col("from_text"),
        }
    )
    constant = F.when(F.col("constant"), F.struct(F.col("to"), F.col("swaps")))

    def state(window, swaps: Column) -> Column:
        return _after(F.lit(False), F.last(constant, ignorenulls=True).over(window), swaps)

    found = found.withColumns(
        {
            "open": state(earlier, F.coalesce(F.sum("odd").over(earlier), F.lit(0))),
            "left_open": state(so_far, F.col("swaps")),
            "later": F.lead("block").over(ordered),
            "heads": F.col("filled") & ~F.coalesce(F.max("filled").over(earlier), F.lit(False)),
        }
    )
    opened = F.when(F.col("left_open") & (F.col("begins") | ~F.col("open")), F.col("block"))
    start = F.when(F.col("open"), F.last(opened, ignorenulls=True).over(earlier))
    kept = found.select("file", "block", "open", "left_open", "later", start.alias("start"), "heads", "head")
    return durable(kept, "states")


def _ended(value: Column) -> Column:
    """A record without the carriage return of its line end."""
    return F.when(F.endswith(value, F.lit("\r")), F.expr("left(value, length(value) - 1)")).otherwise(value)


def _stitched(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of one or several lines, and headers that are known: (value) of each.

    A record is put together where its split is read. Only pieces of records on the edge of two
    splits are brought together, once, in the shared folder.
    """
    ship(lines.sparkSession)
    states = _split_states(lines)
    if not states.filter("later IS NULL AND left_open").isEmpty():
        raise ValueError("a quoted field is never closed")

    def pieces(own: DataFrame) -> DataFrame:
        # One row for each split, and the lines have to stay in the order read.
        known = F.broadcast(own.select("file", "block", "open", "start", "heads"))
        placed = lines.join(known, ["file", "block"])
        return placed.select("value", "file", "block", "open", "start", "heads").mapInArrow(stitched, PIECES)

    records = pieces(states).filter("start IS NULL").select("value", "file", "heads")
    edges = states.filter("open OR left_open")
    if not edges.isEmpty():
        in_order = F.sort_array(F.collect_list(F.struct("block", "value")))
        joined = pieces(edges).filter("start IS NOT NULL").groupBy("file", "start").agg(
            F.array_join(F.transform(in_order, lambda p: p["value"]), "\n").alias("value"),
            F.max("heads").alias("heads"),
        )
        records = records.unionByName(durable(joined.select("value", "file", "heads"), "joined"))
    return records, states.filter("heads").select(F.col("head").alias("value"))


def _single(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same where every line is a record."""
    filled = lines.filter(~_blank(F.col("value")))
    # Numbers alone are kept in place while they are grouped; texts would have all lines sorted.
    low = filled.groupBy("file", "block").agg(F.min("at").alias("at"))
    heads = durable(low.groupBy("file").agg(F.min_by("at", "block").alias("at")), "heads")
    marked = lines.join(heads.select("at", F.lit(True).alias("heads")), "at", "left")
    records = marked.select("value", "file", F.coalesce("heads", F.lit(False)).alias("heads"))
    # Any file's header will do, as all must agree.
    one = heads.agg(F.min("file")).first()[0]
    first = filled.filter(F.col("file") == one) if one is not None else filled.limit(0)
    first = first.agg(F.min(F.struct("block", "at", "value")).alias("first"))
    return records, first.select("first.value").dropna()


def _records(spark: SparkSession, path: str | list[str], line_breaks: bool) -> tuple[DataFrame, list[str]]:
    """CSV records (`value`, its file, whether it heads that file), and the fields of one header.

    Each split of a file is scanned by itself, twice: for how it begins, and for its records.
    """
    _pin_splits(spark)
    lines = _lines(spark, path)
    records, heads = _stitched(lines) if line_breaks else _single(lines)
    found = heads.select(_ended(F.col("value")).alias("value")).agg(
        F.min("value").alias("value"), F.count(F.lit(1)).alias("files")
    ).first()
    records = records.select(_ended(F.col("value")).alias("value"), F.col("file").alias(FILE), "heads")
    if found["value"] is None and found["files"]:  # headers that end in another split
        found = records.filter("heads").agg(F.min("value").alias("value")).first()
    if found["value"] is None:
        return records, []
    return records, next(csv.reader(io.StringIO(found["value"], newline="")))


def _parse(records: DataFrame, names: list[str], *keep: str) -> DataFrame:
    """One text record per row into its fields and the marker; a blank record is a misfit."""
    parsed = F.from_csv(
        "value", F.lit(", ".join(f"`{n}` string" for n in [*names, BAD])), CSV_OPTIONS
    )
    # As a generator the record is parsed once, not once more for each filter above it.
    blank = F.when(_blank(F.col("value")), F.col("value")).alias("_blank_line")
    rows = records.select(*keep, blank, F.inline(F.array(parsed)))
    return rows.withColumn(BAD, F.coalesce("_blank_line", BAD)).drop("_blank_line")


def _without_headers(parsed: DataFrame, names: list[str]) -> DataFrame:
    """Drop the first record of each file, which must be the agreed header."""
    same = F.array(*[F.col(f"`{n}`") for n in names]) == F.array(*[F.lit(n) for n in names])
    wrong = F.raise_error(F.lit("CSV header does not conform to the first file's"))
    drop = F.when(~F.col("heads"), F.lit(False)).when(same, F.lit(True)).otherwise(wrong)
    return parsed.filter(~drop.cast("boolean")).drop("heads")


def _read(
    spark: SparkSession, path: str | list[str], line_breaks: bool, names: list[str] | None = None
) -> DataFrame:
    """`read_marked_csv` with the file of each row; `names` are the fields agreed on before."""
    try:
        records, found = _records(spark, path, line_breaks is not False)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no input at {path}; deliver the order-line CSV first") from e
        raise
    except ValueError as e:
        raise ValueError(f"{path}: {e}") from e
    names = names or found
    if not names:
        raise ValueError(f"{path} is empty: no header row")
    parsed = _without_headers(_parse(records, names, "heads", FILE), names)
    return _marked(parsed, names, FILE)


def read_marked_csv(
    spark: SparkSession, path: str | list[str], line_breaks: bool = True
) -> DataFrame:
    """Read a delivery of CSV files with a header row, every field as text, misfits marked.

    Files are read in splits, however large. The first record of a file that is not blank is its
    header. `line_breaks=False` promises that no field holds a line break and saves the scan for
    records of several lines; on such a delivery both give the same rows. Blank lines are misfits.
    """
    return _read(spark, path, line_breaks).drop(FILE)


def read_raw_csv(
    spark: SparkSession, path: str | list[str], line_breaks: bool = True
) -> Landed:
    """`read_marked_csv`, split into rows to keep and lines to set aside."""
    return split(read_marked_csv(spark, path, line_breaks))


# -- landing by manifest

MANIFEST = (
    "file string, size bigint, modified timestamp, batch string, batch_files bigint,"
    " kept bigint, rejected bigint"
)


def delivered(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, size, modified) of the files of a delivery; their contents are not read."""
    try:
        found = spark.read.format("binaryFile").load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no input at {path}; deliver the order-line CSV first") from e
        raise
    return found.select(
        F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")
    )


def _manifest_of(version: str) -> str:
    """The manifest written beside a landed version."""
    return "__v".join((version.rpartition("__v")[0] + "_manifest", version.rpartition("__v")[2]))


def _landed_view(spark: SparkSession, manifest: str, columns: str) -> str:
    """The text of a view on all live files of a manifest's batches.

    A batch whose files are all live is read as it is, others without the files that went or
    changed since.
    """
    rows = spark.table(manifest).groupBy("batch").agg(
        F.count(F.lit(1)).alias("live"), F.max("batch_files").alias("files")
    )
    parts = []
    for r in sorted(rows.collect()):  # a row for each batch
        part = f"SELECT {columns} FROM {r['batch']}"
        if r["live"] < r["files"]:
            part += f" WHERE {FILE} IN (SELECT file FROM {manifest} WHERE batch = '{r['batch']}')"
        parts.append(part)
    return " UNION ALL ".join(parts)


def land_raw_csv(
    spark: SparkSession, path: str | list[str], table: str, line_breaks: bool = True
) -> tuple[int, int]:
    """Bring a delivery's files into `<table>_landed`, each parsed once; returns rows kept, set aside.

    A manifest tells which files, by name, size and time of change, are landed already and in which
    batch. Only others are parsed, into a batch of their own; a file that changed counts by its new
    rows, one that is no longer delivered does not count. So landing a delivery again parses
    nothing, and one file more costs one file. After MOST_BATCHES batches the landed rows
    are copied into one.

    `table` and `<table>_rejected` are views on the two partitions of `<table>_landed`, itself a view
    on the batches, so one statement switches both, after the whole text has parsed. A delivery
    that fails changes nothing; one that was overtaken by another raises Superseded.
    """
    landed = f"{table}_landed"
    load = begin(spark, landed)
    files = delivered(spark, path)
    if load.base:
        known = spark.table(_manifest_of(load.base))
    else:
        known = spark.createDataFrame([], MANIFEST)
    same = ["file", "size", "modified"]
    live = known.join(files, same, "left_semi")
    # File names come to the driver, as they do for any read.
    new = [r["file"] for r in files.join(known, same, "left_anti").select("file").collect()]
    if new or live.count() < known.count():
        _land_batch(spark, load, live, files, new, line_breaks)
    columns = [c for c in spark.table(landed).columns if c not in (BAD, FILE, "is_rejected")]
    names, source = ", ".join(f"`{n}`" for n in columns), f"FROM {landed} WHERE"
    spark.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT {names} {source} NOT is_rejected")
    spark.sql(
        f"CREATE OR REPLACE VIEW {table}_rejected AS SELECT {BAD} AS line {source} is_rejected"
    )
    counts = spark.table(_manifest_of(shown(spark, landed))).agg(F.sum("kept"), F.sum("rejected")).first()
    return counts[0] or 0, counts[1] or 0


def _land_batch(spark, load, live: DataFrame, files: DataFrame, new: list[str], line_breaks: bool) -> None:
    """Write new files as a batch and the manifest beside it, and let the landed view show them."""
    kept_files, names, rows = live.select("file"), None, None
    if not kept_files.isEmpty():
        names = [c for c in spark.table(load.table).columns if c not in (BAD, FILE, "is_rejected")]
    if new:
        rows = _read(spark, new, line_breaks, names).withColumn("is_rejected", F.col(BAD).isNotNull())
    batches = live.select("batch").distinct()
    if batches.count() + bool(new) > MOST_BATCHES:
        old = spark.table(load.table).join(kept_files.withColumnRenamed("file", FILE), FILE, "left_semi")
        rows = old.unionByName(rows) if new else old
        new, live = [*new, *(r["file"] for r in kept_files.collect())], live.limit(0)
    if rows is None and names is None:
        raise ValueError("a delivery without files")
    if rows is not None:
        write_version(rows, load, by="is_rejected")
        counts = spark.table(load.version).groupBy(F.col(FILE).alias("file")).agg(
            F.count_if(~F.col("is_rejected")).alias("kept"), F.count_if("is_rejected").alias("rejected")
        )
        fresh = files.join(spark.createDataFrame([(f,) for f in new], "file string"), "file", "left_semi")
        fresh = fresh.join(counts, "file", "left").select(
            "file", "size", "modified", F.lit(load.version).alias("batch"),
            F.lit(len(new)).cast("bigint").alias("batch_files"),
            F.coalesce("kept", F.lit(0)).cast("bigint").alias("kept"),
            F.coalesce("rejected", F.lit(0)).cast("bigint").alias("rejected"),
        )
        live = live.unionByName(fresh)
        columns = spark.table(load.version).columns
    else:
        columns = spark.table(load.table).columns
    manifest = _manifest_of(load.version)
    live.coalesce(1).writeTo(manifest).using("parquet").create()
    view = _landed_view(spark, manifest, ", ".join(f"`{c}`" for c in columns))
    keep = [manifest, *(r["batch"] for r in spark.table(manifest).select("batch").distinct().collect())]
    if load.base:
        keep.append(_manifest_of(load.base))
        keep += [r["batch"] for r in spark.table(_manifest_of(load.base)).select("batch").distinct().collect()]
    switch(spark, load, select=view, keep=keep)
    if rows is not None:
        release(spark, load)


def mark_lines(lines: DataFrame, names: list[str]) -> DataFrame:
    """A frame whose column `value` holds one CSV record per row, without header, misfits marked."""
    return _marked(_parse(lines, names), names)


def parse_lines(lines: DataFrame, names: list[str]) -> Landed:
    """The same, split into rows to keep and lines to set aside."""
    return split(mark_lines(lines, names))

import csv
import datetime as dt
import io
import random

import pytest
from feed import BASE, HEADER, good_lines, text, write
from ledgerlens.sources.contract import RETAIL_CONTRACT, to_staging
from ledgerlens.sources.landing import land_raw_csv, parse_lines, read_raw_csv
from pyspark.errors import AnalysisException, DateTimeException, NumberFormatException


def test_foreign_rows_are_set_aside_whole(spark, tmp_path):
    path = write(tmp_path, text({}, {}))
    kept, rejected = read_raw_csv(spark, path)
    assert kept.columns == HEADER  # byte-order mark stripped
    assert kept.count() == 2 and rejected.count() == 5
    assert {r.line for r in rejected.collect()} == {
        "Person,Region", "Anna,West", "", "Returned,Order ID", "Yes,US-2016-1",
    }
    assert kept.first()["Product Name"] == 'Shelf, 36" wide'


@pytest.mark.parametrize("line_breaks", [None, True, False])
def test_reading_few_columns_still_notices_ragged_rows(spark, tmp_path, line_breaks):
    path = write(tmp_path, text({}, {}))
    kept, rejected = read_raw_csv(spark, path, line_breaks)
    assert [r["Postal Code"] for r in kept.select("Postal Code").collect()] == ["04240", "04240"]
    assert kept.count() == 2 and rejected.count() == 5


def test_line_breaks_inside_a_field(spark, tmp_path):
    content = text({"Product Name": "two\nlines"}, {})
    path = write(tmp_path, content)
    kept, rejected = read_raw_csv(spark, path)
    assert kept.count() == 2 and rejected.count() == 5
    assert kept.filter("`Row ID` = '1'").first()["Product Name"] == "two\nlines"
    torn, halves = read_raw_csv(spark, path, line_breaks=False)
    assert torn.count() == 1 and halves.count() == 7  # torn rows are set aside, never guessed


def test_too_many_fields_and_empty_last_field(spark, tmp_path):
    row = ",".join(["x"] * 22)
    path = write(tmp_path, text({"Profit": ""}, tail=row + "\r\n"))
    kept, rejected = read_raw_csv(spark, path)
    assert kept.count() == 1 and kept.first()["Profit"] is None
    assert rejected.first().line == row


@pytest.fixture
def small_splits(spark):
    """Files cut into splits of a few lines."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    for k in keys:
        spark.conf.set(k, "700")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_broken_records_across_splits(small_splits, tmp_path):
    """Records of many lines, with quotes and blank lines inside, cut anywhere by the splits."""
    spark = small_splits
    rng = random.Random(3)
    pieces = ["a, b", 'say ""hi""', "", "x" * 40, "two  spaces", '""']
    for name in ("a.csv", "b.csv"):
        changes = []
        for _ in range(60):
            breaks = rng.choice([0, 0, 1, 3, 30])
            note = "\n".join(rng.choice(pieces) for _ in range(breaks + 1)).replace('""', '"')
            changes.append({"Product Name": "n" + note + "n", "City": rng.choice(["A\nB", "C"])})
        write(tmp_path, text(*changes), name)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    got = read_raw_csv(spark, str(tmp_path))
    whole_files = spark.read.options(header=True, multiLine=True, escape='"').csv(str(tmp_path))
    want = whole_files.filter("Profit is not null")
    assert got.kept.count() == 120 and got.rejected.count() == 10
    key = ["Row ID", "Product Name", "City"]
    assert got.kept.orderBy(key).collect() == want.orderBy(key).collect()


def test_a_quote_never_closed(spark, tmp_path):
    path = write(tmp_path, text({}, tail='"open\n' + "more\n" * 400))
    with pytest.raises(ValueError, match="never closed"):
        read_raw_csv(spark, path)


def test_headers_must_agree_with_line_breaks_too(spark, tmp_path):
    write(tmp_path, text({"City": "A\nB"}), "a.csv")
    write(tmp_path, text({}).replace("Row ID,Order ID", "Order ID,Row ID"), "b.csv")
    with pytest.raises(Exception, match="CSV header does not conform"):
        read_raw_csv(spark, str(tmp_path)).kept.collect()


def test_landing_parses_once_and_serves_two_views(spark, tmp_path):
    for content, counts in ((text({}, {}), (2, 5)), (text({}), (1, 5))):  # the second replaces
        path = write(tmp_path, content)
        assert land_raw_csv(spark, path, "raw.landing_test") == counts
        kept, rejected = read_raw_csv(spark, path)
        assert spark.table("raw.landing_test").collect() == kept.collect()
        assert spark.table("raw.landing_test_rejected").collect() == rejected.collect()
    plan = spark.table("raw.landing_test")._jdf.queryExecution().executedPlan().toString()
    assert "is_rejected" in plan.split("PartitionFilters: ")[1].split("]")[0]


def test_files_must_agree_on_the_header(spark, tmp_path):
    write(tmp_path, text({}), "a.csv")
    write(tmp_path, text({}).replace("Row ID,Order ID", "Order ID,Row ID"), "b.csv")
    kept, _ = read_raw_csv(spark, str(tmp_path), line_breaks=False)
    with pytest.raises(Exception, match="CSV header does not conform"):
        kept.collect()


def test_columns_are_found_by_name(spark, tmp_path):
    swapped = ["Profit", *HEADER[:-1]]
    line = ",".join(["1.5", *["" if h in ("Product Name",) else BASE[h] for h in HEADER[:-1]]])
    path = write(tmp_path, ",".join(swapped) + "\n" + line + "\n")
    row = to_staging(read_raw_csv(spark, path).kept, RETAIL_CONTRACT).first()
    assert (row.profit, row.row_id, row.discount) == (1.5, 1, 0.0)


def test_missing_and_empty_input(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="deliver"):
        read_raw_csv(spark, str(tmp_path / "absent.csv"))
    with pytest.raises(ValueError, match="empty"):
        read_raw_csv(spark, write(tmp_path, "", "empty.csv", "utf-8"))


def test_parse_lines_like_files(spark, tmp_path):
    path = write(tmp_path, text(*good_lines()), encoding="utf-8")
    lines = spark.read.text(path).filter("value not like 'Row ID%'")
    kept, rejected = parse_lines(lines, HEADER)
    from_file = read_raw_csv(spark, path)
    assert kept.collect() == from_file.kept.collect()
    assert rejected.collect() == from_file.rejected.collect()
    assert (kept.count(), rejected.count()) == (8, 5)


def test_staging_types_and_us_dates(spark, tmp_path):
    path = write(tmp_path, text({"Order Date": "11/8/2016", "Ship Date": "01/08/2017"}))
    staged = to_staging(read_raw_csv(spark, path).kept, RETAIL_CONTRACT)
    assert [(n, t) for n, t in staged.dtypes] == [(n, t) for _, n, t in RETAIL_CONTRACT]
    row = staged.first()
    assert row.order_date == dt.date(2016, 11, 8) and row.ship_date == dt.date(2017, 1, 8)
    assert row.postal_code == "04240" and row.sales == 261.96


@pytest.mark.parametrize(
    "change, error",
    [
        ({"Order Date": "13/40/2016"}, DateTimeException),
        ({"Quantity": "two"}, NumberFormatException),
    ],
)
def test_a_bad_value_fails_the_load(spark, tmp_path, change, error):
    raw = read_raw_csv(spark, write(tmp_path, text(change))).kept
    with pytest.raises(error):
        to_staging(raw, RETAIL_CONTRACT).collect()


def test_a_missing_column_fails_the_load(spark):
    with pytest.raises(AnalysisException):
        to_staging(spark.range(1), RETAIL_CONTRACT)


def reference_rows(content):
    """What the standard reader makes of a file: rows of the header's width, all other records."""
    rows = list(csv.reader(io.StringIO(content.removeprefix("\ufeff"), newline="")))
    rows = rows[next(i for i, r in enumerate(rows) if "".join(r).strip()) :]
    header, rest = rows[0], rows[1:]
    kept = [[v or None for v in r] for r in rest if len(r) == len(header)]
    return header, kept, len(rest) - len(kept)


INCHES = 'a,b,c\r\n1,5" pipe,x\r\n2,6" pipe,y\r\n3,plain,z\r\n4,7" "x" pipe,w\r\n'


@pytest.mark.parametrize("line_breaks", [True, False, None])
def test_inch_marks_are_text(spark, tmp_path, line_breaks):
    path = write(tmp_path, INCHES)
    got = read_raw_csv(spark, path, line_breaks)
    header, kept, n = reference_rows(INCHES)
    assert got.kept.columns == header and got.rejected.count() == n == 0
    assert sorted(map(tuple, got.kept.collect())) == sorted(map(tuple, kept))


def test_carriage_returns_in_fields_stay_and_blank_first_lines_go(spark, tmp_path):
    content = "\r\n  \r\na,b\r\n1,\"x\r\ny\"\r\n\r\n2,\"\"\"q\"\"\nz\"\r\n3\r\n"
    path = write(tmp_path, content)
    got = read_raw_csv(spark, path)
    assert sorted(map(tuple, got.kept.collect())) == [("1", "x\r\ny"), ("2", '"q"\nz')]
    assert sorted(r.line for r in got.rejected.collect()) == ["", "", "  ", "3"]


def test_a_long_closed_field_is_data(spark, tmp_path):
    long = "line, of text\n" * 400_000
    path = write(tmp_path, f'a,b\n1,"{long}"\n2,x\n')
    kept, rejected = read_raw_csv(spark, path)
    assert rejected.count() == 0
    assert {(r.a, len(r.b)) for r in kept.collect()} == {("1", len(long)), ("2", 1)}


def test_one_scan_of_the_text_in_the_final_plan(spark, tmp_path):
    kept, _ = read_raw_csv(spark, write(tmp_path, text({"City": "A\nB"})))
    assert kept._jdf.queryExecution().executedPlan().toString().count("FileScan text") <= 3


@pytest.mark.parametrize("seed", range(4))
def test_random_quotes_like_the_standard_reader(small_splits, tmp_path, seed):
    """Quotes anywhere, records of many lines, splits anywhere."""
    rng = random.Random(seed)
    fields = ['5"', 'a"b"', '"q"', '"x\ny"', '"x\r\ny,\n"', '"a""b"', '""', "", "p", " ", '"\n\n"', '""""',
              '"say ""hi"",\nno"', '"' + "long\n" * 60 + '"']
    lines = [",".join(rng.choice(fields) for _ in range(rng.choice([3, 3, 3, 2, 4]))) for _ in range(150)]
    content = "a,b,c\n" + "\n".join(lines) + "\n"
    header, kept, n = reference_rows(content)
    got = read_raw_csv(small_splits, write(tmp_path, content, encoding="utf-8"))
    assert got.rejected.count() == n
    key = lambda r: tuple(v or "" for v in r)
    assert sorted(map(key, got.kept.collect())) == sorted(map(key, kept))


def test_records_across_batches_of_lines(small_splits, tmp_path):
    """Records that go on in the next batch of a worker, and in the next split."""
    spark, key = small_splits, "spark.sql.execution.arrow.maxRecordsPerBatch"
    rng = random.Random(9)
    fields = ['"x\ny"', '"a""b"', '""', "p", '5"', '"' + "long\n" * 200 + '"', '"' + '""' * 40 + '\n"']
    content = "\n \n\"a\n1\",b,c\n" + "".join(",".join(rng.choice(fields) for _ in range(3)) + "\n" for _ in range(60))
    path = write(tmp_path, content, encoding="utf-8")
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        got = read_raw_csv(spark, path)
        found = sorted(tuple(v or "" for v in r) for r in got.kept.collect())
    finally:
        spark.conf.set(key, before)
    want = list(csv.reader(io.StringIO(content.lstrip(), newline="")))
    assert got.kept.columns == want[0] == ["a\n1", "b", "c"]
    assert found == sorted(map(tuple, want[1:]))


def test_lines_of_broken_records_are_not_moved(spark, tmp_path):
    """Neither joined with numbers of lines nor dealt out anew: records are made where they are read."""
    got = read_raw_csv(spark, write(tmp_path, text({"City": "A\nB"})))
    plan = got.kept._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" not in plan and "Exchange hashpartitioning" not in plan

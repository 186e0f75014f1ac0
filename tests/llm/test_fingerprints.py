import hashlib
import re

from odd import documents, strange
from pyspark.sql import functions as F

from ledgerlens.llm import fingerprints as fp
from ledgerlens.llm import queries

FOLDER = "/root/testdata/sf0.01"


def sets(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text.lower()) if x]
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)]
    return {r for r in runs if r}


def jaccard(a, b):
    a, b = sets(a), sets(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(docs):
    out = {}
    for k, (i, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        half = len(text) // 2
        out[i] = (text[: len(text) - half] + after[:half], after)
    return out


def test_registered_query_against_plain_sets(spark):
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect())
    want = edited(docs)
    rows = {r["doc_id"]: r for r in queries.op5_fingerprints(spark, FOLDER).collect()}
    assert len(rows) == len(docs)
    off, prints = [], {}
    for i, text in docs:
        r = rows[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(want[i][0].encode()).hexdigest()
        off.append(abs(r["near_edited"] - jaccard(text, want[i][0])))
        off.append(abs(r["near_next"] - jaccard(text, want[i][1])))
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        if len(sets(text)) < fp.K:
            assert r["n_shingles"] == len(sets(text))
        else:
            assert abs(r["n_shingles"] / len(sets(text)) - 1) < 0.5
    assert sum(off) / len(off) < 0.02 and max(off) < 0.2


def test_parts_merge_into_the_whole(spark):
    words = [f"w{k}" for k in range(900)]
    one, two = " ".join(words[:500]), " ".join(words[400:])
    df = spark.createDataFrame([(one, two)], "a string, b string")
    a, b = fp.sketch(F.col("a")), fp.sketch(F.col("b"))
    row = df.select(
        fp.merge(a, b).alias("m"), a.alias("a"), b.alias("b"),
        fp.containment(a, b).alias("c"), fp.containment(a, a).alias("own"),
        fp.distinct_count(fp.merge(a, b)).alias("n"), fp.resemblance(a, b).alias("r"),
    ).first()
    assert row["m"] == sorted({*row["a"], *row["b"]})[: fp.K] and row["a"] == sorted(row["a"])
    assert row["own"] == 1.0 and abs(row["c"] - 96 / 496) < 0.12
    assert abs(row["n"] - 896) < 250 and abs(row["r"] - 96 / 896) < 0.1


def test_strange_rows(spark):
    rows = fp.with_neighbours(strange(spark)).collect()
    assert len(rows) == 10
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] == by[3]["fingerprint"] == []
    assert by[5]["fingerprint"] == by[6]["fingerprint"] != []
    assert by[5]["next_fingerprint"] == by[6]["fingerprint"]
    assert by[9]["next_fingerprint"] == []  # the first text is null
    assert by[6]["edited"] == "same text tw" + by[7]["text"][:11]
    assert by[None]["edited"] == "a row with" and by[None]["next_fingerprint"] == []
    assert fp.with_neighbours(strange(spark).limit(0)).collect() == []
    alone = fp.with_neighbours(documents(spark, [(4, "one two", "en", "a")])).collect()
    assert alone[0]["edited"] == "one one"


def test_no_python_on_the_plan(spark):
    plan = queries.op5_fingerprints(spark, FOLDER)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))

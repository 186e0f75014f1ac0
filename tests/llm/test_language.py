import zlib

from odd import documents, strange

from ledgerlens.llm import language, queries

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_digest(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.op1_language_id(spark, FOLDER).collect()
    assert {r["doc_id"] for r in rows} == set(docs) and len(rows) == len(docs)
    out = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    right = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in out]
    assert sum(right) >= 0.98 * len(right)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["rejected"] for r in rows) < 0.05 * len(rows)


def taught(spark):
    rows = [(k, f"the cat and the dog {k} with them", "en", "a") for k in range(20)]
    rows += [(k, f"der hund und die katze {k} mit ihnen", "de", "a") for k in range(20, 40)]
    rows += [(50, "xx", None, "a"), (51, None, "en", "a"), (52, "12", "de", "a")]
    return documents(spark, rows)


def test_strange_rows(spark):
    model = language.fit(taught(spark))
    rows = language.predict(strange(spark), model).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 10
    for i in (1, 2, 3, 8):
        assert (by[i]["lang_pred"], by[i]["score"], by[i]["rejected"]) == ("und", 0.0, True)
    assert all(r["lang_pred"] in ("en", "de") for r in rows if r["doc_id"] not in (1, 2, 3, 8))
    assert language.predict(strange(spark).limit(0), model).collect() == []


def test_unlike_texts_are_rejected(spark):
    model = language.fit(taught(spark))
    docs = documents(spark, [(1, "the dog and the cat", "en", "a"), (2, "qxqx zzyq wqkj", "en", "a"), (3, "你好", "en", "a")])
    by = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    assert by[1]["lang_pred"] == "en"
    assert by[2]["rejected"] and by[3]["rejected"] and by[3]["lang_pred"] in ("en", "de")


def test_same_text_same_answer_wherever_it_stands():
    s = language.Settings()
    texts = ["abc def", "é" * 40, None, "x1y2", "", "abc def"] * 30 + ["ab " * 200000, "abc def"]
    got = {}
    for first, counts, lettered in language.counted(texts, s):
        for k in range(len(counts)):
            key = (counts[k].tobytes(), bool(lettered[k]))
            assert got.setdefault(texts[first + k], key) == key


def test_nothing_to_learn_from(spark):
    model = language.fit(taught(spark).limit(0))
    assert {r["lang_pred"] for r in language.predict(strange(spark), model).collect()} == {"und"}

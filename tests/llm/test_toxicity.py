import zlib

import numpy as np
import pyarrow as pa
from odd import documents, strange

from ledgerlens.llm import queries, toxicity

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_digest(spark):
    rows = {r["doc_id"]: r for r in queries.op8_toxicity(spark, FOLDER).collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert set(rows) == set(docs)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").collect()
    kept = [r for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    right = [rows[r["doc_id"]]["predicted"] == r["toxic"] for r in kept]
    assert sum(right) >= 0.9 * len(kept)  # the sample has some thirty toxic documents here
    clean = [r for r in kept if not r["toxic"]]
    assert sum(rows[r["doc_id"]]["predicted"] for r in clean) <= 0.02 * len(clean)
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert r["predicted"] == (r["score"] >= 0.7)
        for s in r["spans"]:
            assert 0 <= s["start"] < s["end"] <= len(docs[i])


def taught():
    rng = np.random.default_rng(3)
    pool = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(150)]
    plain = [" ".join(rng.choice(pool, 12)) + " é." for _ in range(120)]
    bad = [f"{t[:30]} glorpish{k % 7} {t[30:]}" for k, t in enumerate(plain[60:])]
    return pa.array(plain[:60] + bad), np.array([0] * 60 + [1] * 60)


def test_spans_name_the_offending_words():
    model = toxicity.train(*taught(), toxicity.Settings())
    texts = ["é é abcd glorpish5 efgh. abcd glorpishly", "nothing here", None, ""]
    scores, spans = model.scores_and_spans(pa.array(texts))
    assert [texts[0][a:b] for a, b in spans[0]] == ["glorpish5", "glorpishly"]
    assert spans[1:] == [[], [], []]
    assert scores[0] > 0.7 > 0.3 > scores[1] and scores[2] == scores[3]


def test_marginals_equal_a_sum_over_all_taggings():
    rng = np.random.default_rng(1)
    emitted, moves = rng.normal(size=9), rng.normal(size=(2, 2))
    place = np.array([0, 1, 2, 3, 0, 0, 1, 2, 3])
    forward, backward = toxicity._messages(emitted, None, place, moves)
    got = toxicity._sigmoid(forward + backward)
    for a, b in ((0, 4), (4, 5), (5, 9)):
        total, hits = 0.0, np.zeros(b - a)
        for code in range(1 << (b - a)):
            tags = [(code >> k) & 1 for k in range(b - a)]
            s = sum(emitted[a + k] for k, t in enumerate(tags) if t)
            s += sum(moves[x, y] for x, y in zip(tags, tags[1:]))
            total += np.exp(s)
            hits += np.exp(s) * np.array(tags)
        assert np.allclose(got[a:b], hits / total)


def test_strange_rows(spark):
    texts, labels = taught()
    docs = documents(spark, [(k, t, "en", "a") for k, t in enumerate(texts.to_pylist())])
    given = [(k, int(x)) for k, x in enumerate(labels)] + [(0, None), (None, 1), (999, 1)]
    model = toxicity.fit(docs, spark.createDataFrame(given, "doc_id long, label int"))
    rows = toxicity.score(strange(spark), model).collect()
    by = {r["doc_id"]: r["score"] for r in rows}
    assert len(rows) == 10 and by[1] == by[2] == by[3] and by[5] == by[6]
    kept = toxicity.accepted(strange(spark), model, 2.0)
    assert kept.schema == strange(spark).schema and kept.count() == 10
    assert toxicity.accepted(docs, model, 0.7).count() == 60
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_one_kind_of_label_only():
    m = toxicity.train(pa.array(["a", "b"]), np.array([0, 0]), toxicity.Settings())
    assert (m.scores(pa.array(["a", None])) < 1e-9).all()
    m = toxicity.train(pa.array([], type=pa.string()), np.zeros(0), toxicity.Settings())
    assert (m.scores(pa.array(["a", None])) < 1e-9).all()

import random
import re

import numpy as np
import pyarrow as pa
from odd import documents, strange
from pyspark.sql import functions as F

from ledgerlens.llm import pieces, queries

FOLDER = "/root/testdata/sf0.01"


def small(rng):
    names = list({"".join(rng.choice("▁ab.") for _ in range(rng.randint(1, 3))) for _ in range(7)})
    scored = [(n, i, -float(rng.randint(1, 9))) for i, n in enumerate(names)]
    text = [n.replace("▁", " ").encode() for n in names] + [bytes([b]) for b in range(256)]
    return pieces.Vocabulary.of(scored, text, [len(names) + b for b in range(256)]), scored


def all_paths(v, scored, text):
    """(score, ids) of every segmentation of the whole text, without any parts."""
    found = {n: (i, s) for n, i, s in scored}
    text = " " + text

    def go(at):
        if at == len(text):
            yield 0.0, ()
            return
        steps = []
        for to in range(at + 1, min(len(text), at + 3) + 1):
            piece = text[at:to]
            if "▁" not in piece and piece.replace(" ", "▁") in found:
                i, s = found[piece.replace(" ", "▁")]
                steps.append((to, (i,), s))
        if not steps or steps[0][0] != at + 1:
            ids = tuple(v.byte_ids[b] for b in text[at].encode())
            steps.append((at + 1, ids, len(ids) * v.byte_score))
        for to, ids, s in steps:
            for score, rest in go(to):
                yield s + score, ids + rest

    return sorted(go(0), key=lambda p: -p[0])


def test_n_best_equals_all_segmentations():
    rng = random.Random(8)
    for _ in range(250):
        v, scored = small(rng)
        text = "".join(rng.choice(" abc▁\n.é") for _ in range(rng.randint(1, 6)))
        ids, score, others = v.segment(text, 5)
        every = all_paths(v, scored, text)
        assert [score, *(s for s, _ in others)] == [s for s, _ in every[:5]]
        seen = {tuple(ids)}
        assert (score, tuple(ids)) in every and v.decode(ids) == text
        for s, changes in others:
            own = list(ids)
            for first, dropped, new in sorted(changes, reverse=True):
                own[first : first + dropped] = new
            assert (s, tuple(own)) in every and tuple(own) not in seen and v.decode(own) == text
            seen.add(tuple(own))


def test_parts_side_by_side_equal_parts_one_by_one():
    """The batched forward pass against the plain one: ids, best score and second best, bit for bit."""
    rng = random.Random(21)
    for v in (pieces.Vocabulary.read(), *(small(rng)[0] for _ in range(10))):
        own = [n.replace("▁", " ") for n in rng.sample(sorted(v.found), min(len(v.found), 300))]
        text = ["".join(rng.choice([*own, "é", "日", "\U0001f600", "\t", "a", "7"]) for _ in range(rng.randint(1, 9)))
                for _ in range(300)]
        text += ["x" * 70, "日本" * 40, "▁", " " * 200, "b" * 64]
        data = np.frombuffer("".join(text).encode(), dtype=np.uint8)
        end = np.cumsum([len(t.encode()) for t in text])
        start = end - [len(t.encode()) for t in text]
        ids, counts, scores, losses = v._each_solved(data, pieces._sums(data), start, end)
        cuts = np.cumsum(counts) - counts
        for k, t in enumerate(text):
            want_ids, want, loss = v._solve(t)
            assert ids[cuts[k] : cuts[k] + counts[k]].tobytes() == want_ids, t
            assert (scores[k], losses[k]) == (want, loss), t


def test_cuts_never_lie_inside_a_piece():
    """No piece of the vocabulary, as it is spelled, holds a place where a text would be cut."""
    v = pieces.Vocabulary.read()
    for name, hit in v.found.items():
        if hit is not None:
            data = np.frombuffer(name.replace("▁", " ").encode(), dtype=np.uint8)
            assert len(v.cuts(data, np.array([0, len(data)]))) == 2, name


def test_registered_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.op6_sentencepiece_nbest(spark, FOLDER).collect()
    assert {r["doc_id"] for r in rows} == set(docs) and all(r["restored"] for r in rows)
    v = pieces.Vocabulary.read()
    for r in rows:
        scores = [r["score"], *r["next_scores"]]
        assert scores == sorted(scores, reverse=True) and len(scores) <= 4
    for r in rows[:5]:  # the best score, by a plain pass over the whole text
        text = (" " + docs[r["doc_id"]])[:400].rsplit(" ", 1)[0]
        best = [0.0] + [-1e18] * len(text)
        for i in range(len(text)):
            single = False
            for j in range(i + 1, min(len(text), i + 16) + 1):
                hit = v.found.get(text[i:j].replace(" ", "▁"))
                if hit:
                    single = single or j == i + 1
                    best[j] = max(best[j], best[i] + hit[1])
            if not single:
                best[i + 1] = max(best[i + 1], best[i] + len(text[i].encode()) * v.byte_score)
        assert abs(v.segment(text[1:], 2)[1] - best[-1]) < 1e-6


def test_strange_rows(spark):
    v = pieces.Vocabulary.read()
    docs = strange(spark)
    rows = pieces.decode(pieces.encode(docs, v), v).collect()
    assert len(rows) == 10
    for r in rows:
        assert r["decoded"] == r["text"]
    assert pieces.restored(pieces.encode(docs, v), v, ["doc_id"]).filter("restored").count() == 10
    other = pieces.encode(docs, v).withColumn("text", F.concat("text", F.lit("x")))
    assert pieces.restored(other, v, ["doc_id"]).filter("restored").count() == 1  # the null text
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["ids"] is None and by[2]["ids"] == [] and by[2]["alternatives"] == []
    assert pieces.encode(docs.limit(0), v).collect() == []


def test_texts_without_spaces_and_ties():
    v = pieces.Vocabulary.read()
    for text in ("a" * 3000, "日本語" * 300, "▁" * 5, "a▁b", " \n  x  ", "\U0010ffff"):
        ids, score, others = v.segment(text, 4)
        assert v.decode(ids) == text
        assert [s for s, _ in others] == sorted((s for s, _ in others), reverse=True)
    assert re.fullmatch(r"(?s).*", text)


def test_clashing_columns(spark):
    v = pieces.Vocabulary.read()
    docs = documents(spark, [(1, "some words here", "en", "a")]).withColumn("ids", F.lit("x"))
    assert pieces.encode(docs, v).columns == ["doc_id", "text", "ids", "score", "alternatives"]


def test_wide_rows_go_to_workers_in_small_batches(spark):
    """Ids are as wide as texts, so a batch of many rows would take a worker's memory."""
    v = pieces.Vocabulary.read()
    docs = spark.range(0, 400, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 3000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["size", "n"])

    found = pieces.encode(docs, v).mapInArrow(sizes, "size long, n long").collect()
    assert sum(r["n"] for r in found) == 400
    assert max(r["size"] for r in found) < 8 << 20

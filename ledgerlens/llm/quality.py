"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-Proximal.

Words are runs of letters and digits, or runs of punctuation. The features of a document are its
words, pairs of neighbours and words repeated after one other word, hashed into `2**bits` slots;
each counts by its share of the document's words. A pair or triple that repeats its first word
is written with a back-reference for the repeat ("same as one before"), so that repetition is
one feature and not a different one for every word.

Training takes a sample of labelled rows that is bounded per class, in `shards` groups, each of
which runs the follow-the-regularised-leader updates over its rows; the model is the mean of the
shards' weights. Scores are sparse dot products, made batch by batch beside the scan.

Defined results: a null or empty text has no features and gets the score of the bias. Rows with a
null label, or whose id has no label, teach nothing; a document with several label rows teaches
each of them. Every document row gets a row, repeats and null ids included. Without any labelled
row every score is 0.5. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import sample
from ledgerlens.llm.text import SPLIT, chunks, mix, word_hashes

SAME_AS_PREVIOUS = np.uint64(0xA24BAED4963EE407)
SAME_AS_BEFORE_LAST = np.uint64(0x9FB21C651E98DF25)


@dataclass(frozen=True)
class Settings:
    bits: int = 18  # slots of the hashed features
    most_per_class: int = 4000  # bound of the training sample, for each label
    shards: int = 4
    epochs: int = 4
    alpha: float = 0.5  # FTRL learning rate
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    scale: float = 20.0  # of a word's share of its document


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # one for each slot, the bias last
    settings: Settings

    def scores(self, column: pa.Array) -> np.ndarray:
        owner, slot, value = features(column, self.settings)
        z = np.bincount(owner, weights=self.weights[slot] * value, minlength=len(column))
        return 1 / (1 + np.exp(-np.clip(z + self.weights[-1], -35, 35)))


def features(column: pa.Array, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, slot, value) triples of a text column, with repeats."""
    doc, word = word_hashes(column, SPLIT)
    if not len(doc):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(0)
    shift = np.uint64(64 - settings.bits)
    one = doc[1:] == doc[:-1]
    pair = np.where(word[1:] == word[:-1], SAME_AS_PREVIOUS, mix(word[:-1] * np.uint64(3) + word[1:]))
    again = (doc[2:] == doc[:-2]) & (word[2:] == word[:-2])
    repeat = np.full(int(again.sum()), SAME_AS_BEFORE_LAST, dtype=np.uint64)
    owner = np.concatenate([doc, doc[1:][one], doc[2:][again]])
    slot = (np.concatenate([word, pair[one], repeat]) >> shift).astype(np.int64)
    share = settings.scale / np.bincount(doc, minlength=len(column)).clip(1)
    return owner, slot, share[owner]


def _shard_weights(texts: pd.Series, labels: np.ndarray, s: Settings) -> np.ndarray:
    """The weights after `epochs` passes of FTRL-Proximal over one shard."""
    size = (1 << s.bits) + 1
    owner, slot, value = features(pa.array(texts, type=pa.large_string()), s)
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(len(texts) + 1))
    rows = []
    for k in range(len(texts)):
        at = order[cuts[k] : cuts[k + 1]]
        slots, place = np.unique(slot[at], return_inverse=True)
        values = np.bincount(place, weights=value[at], minlength=len(slots))
        rows.append((np.append(slots, size - 1), np.append(values, 1.0)))
    z, n = np.zeros(size), np.zeros(size)
    rng = np.random.default_rng(7)

    def current(i):
        zi = z[i]
        w = -(zi - np.sign(zi) * s.l1) / ((s.beta + np.sqrt(n[i])) / s.alpha + s.l2)
        return np.where(np.abs(zi) <= s.l1, 0.0, w)

    for _ in range(s.epochs):
        for k in rng.permutation(len(rows)):
            i, x = rows[k]
            w = current(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - labels[k]) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / s.alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return current(np.arange(size))


def fit(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from `documents(doc_id, text)` and `labels(doc_id, label)`.

    Restrict `labels` to the rows that may be learnt from. The weights that reach the driver
    are `shards` vectors of fixed length.
    """
    known = labels.select("doc_id", F.col("label").cast("int")).dropna()
    chosen = sample.per_class(known, "label", settings.most_per_class, "doc_id")
    rows = sample.labelled(documents, chosen, ["doc_id", "text"])
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(settings.shards)))

    def train(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "label"], kind="stable")
        w = _shard_weights(group["text"], group["label"].to_numpy(dtype=float), settings)
        return pd.DataFrame({"rows": [len(group)], "weights": [w.astype(np.float32).tobytes()]})

    parts = rows.groupBy("shard").applyInPandas(train, "rows long, weights binary").collect()
    total = np.zeros((1 << settings.bits) + 1)
    for p in parts:
        total += np.frombuffer(p["weights"], dtype=np.float32) * p["rows"]
    return Model((total / max(1, sum(p["rows"] for p in parts))).astype(np.float32), settings)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of `documents(doc_id, text)`."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sent.value.scores(batch.column(1)))],
                    names=["doc_id", "score"],
                )

    return documents.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, score double")


def accepted(documents: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of `documents`, all columns as they are, whose text scores `least` or more."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                column = batch.column(batch.schema.get_field_index("text"))
                yield batch.filter(pa.array(sent.value.scores(column) >= least))

    return documents.mapInArrow(passing, documents.schema)

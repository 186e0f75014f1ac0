"""Language identification by nearest centroid over TF-IDF character n-grams.

A text's letters, in lower case and with everything else turned into single spaces, give n-grams of
2 to 3 characters, hashed into `2**bits` slots, weighted by inverse document frequency and
normalised. Each language has several centroids, found by spherical k-means over a bounded sample
of its documents, so that one language may look several ways. A text goes to the language of the
centroid with the largest cosine. It is rejected when its cosine distance to that centroid is
larger than nearly all of the distances that the centroid's own documents have.

Defined results: a null text or one without a letter is `und` with score 0 and rejected. A text with
letters that meets no centroid at all goes to the language with most sampled documents, score 0,
rejected. Rows with a null language teach nothing, rows repeating a document teach each time.
Without any row to learn from every text is `und`. Every row gets a row, null ids included. Ties
go to the language first in order. Extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import sample
from ledgerlens.llm.text import BASE, chunks, mix

UNKNOWN = "und"
GROUP_CHARS = 1 << 18  # characters whose counts are held at once
GROUP_ROWS = 64


@dataclass(frozen=True)
class Settings:
    bits: int = 13  # slots of the hashed n-grams
    sizes: tuple[int, ...] = (2, 3)
    most_per_language: int = 1000  # bound of the training sample
    centroids: int = 4  # of each language
    rounds: int = 12  # of k-means
    tolerated: float = 0.995  # share of a centroid's documents within its radius
    slack: float = 1.25  # times that radius


@dataclass(frozen=True)
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    radius: np.ndarray
    idf: np.ndarray
    common: str  # the language with most sampled documents
    settings: Settings

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, cosine to its nearest centroid, rejected) of each text."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        rejected = np.ones(len(texts), dtype=bool)
        for first, counts, lettered in counted(texts, self.settings):
            if not self.languages:
                continue
            vectors = normalised(counts * self.idf)
            near = vectors @ self.centroids.T
            best = near.argmax(axis=1)
            for k in np.flatnonzero(lettered):
                score = float(near[k, best[k]])
                names[first + k] = self.languages[best[k]] if score > 0 else self.common
                scores[first + k] = min(1.0, max(0.0, score))
                rejected[first + k] = score <= 0 or 1 - score > self.radius[best[k]]
        return names, scores, rejected


@cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter(
        (unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), dtype=bool, count=0x110000
    )


def normalised(rows: np.ndarray) -> np.ndarray:
    size = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(size > 0, size, 1)


def counted(texts: list[str | None], s: Settings) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, counts by slot, whether a text has letters), group by group."""
    at = 0
    while at < len(texts):
        to, chars = at, 0
        while to < len(texts) and to - at < GROUP_ROWS and (chars < GROUP_CHARS or to == at):
            chars += len(texts[to] or "")
            to += 1
        yield (at, *_count(texts[at:to], s))
        at = to


def _count(texts: list[str | None], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    width = 1 << s.bits
    counts = np.zeros(len(texts) * width, dtype=np.float32)
    lettered = np.zeros(len(texts), dtype=bool)
    pieces = [(k, text[a : a + GROUP_CHARS]) for k, text in enumerate(texts) if text
              for a in range(0, len(text), GROUP_CHARS)]
    held: list[tuple[int, str]] = []
    size = 0
    for n, (k, piece) in enumerate(pieces):
        held.append((k, piece))
        size += len(piece)
        if size >= GROUP_CHARS or n == len(pieces) - 1:
            _add(held, counts, lettered, width, s)
            held, size = [], 0
    return counts.reshape(len(texts), width), lettered


def _add(held, counts, lettered, width: int, s: Settings) -> None:
    lower = [" " + piece.lower() + " " for _, piece in held]
    code = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat([k for k, _ in held], [len(x) for x in lower])
    letter = letters()[code]
    lettered |= np.bincount(owner, weights=letter, minlength=len(lettered)) > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of the characters after a letter
    keep[np.cumsum([0, *(len(x) for x in lower[:-1])])] = True
    code = np.where(letter, code, 32)[keep].astype(np.uint64)
    owner = owner[keep]
    for n in s.sizes:
        if len(code) < n:
            continue
        h = np.zeros(len(code) - n + 1, dtype=np.uint64)
        for k in range(n):
            h = h * np.uint64(BASE) + code[k : len(code) - n + 1 + k]
        whole = owner[n - 1 :] == owner[: len(owner) - n + 1]
        slot = (mix(h + np.uint64(n)) >> np.uint64(64 - s.bits)).astype(np.int64)
        at = owner[: len(slot)][whole] * width + slot[whole]
        counts += np.bincount(at, minlength=len(counts)).astype(np.float32)


def _clusters(vectors: np.ndarray, s: Settings) -> np.ndarray:
    """Centroids by spherical k-means; the first is any row, the next ones those farthest away."""
    chosen = [0]
    near = vectors @ vectors[0]
    while len(chosen) < min(s.centroids, len(vectors)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, vectors @ vectors[chosen[-1]])
    centres = vectors[chosen]
    for _ in range(s.rounds):
        own = (vectors @ centres.T).argmax(axis=1)
        centres = np.stack(
            [vectors[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))]
        )
        centres = normalised(centres)
    return centres


def fit(documents: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from `documents(doc_id, text, lang)`; pass only rows that may be learnt from.

    The sample is bounded for each language. Document frequencies are summed over the sample's
    tasks, k-means runs beside the rows of one language; vectors of fixed length reach the driver.
    """
    s = settings
    width = 1 << s.bits
    known = documents.select("doc_id", "text", F.col("lang").cast("string")).filter("lang IS NOT NULL AND text IS NOT NULL")
    rows = sample.per_class(known, "lang", s.most_per_language, "doc_id")

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(width), 0
        for part in batches:
            for _, counts, _ in counted(part["text"].tolist(), s):
                total += (counts > 0).sum(axis=0)
                n += len(counts)
        yield pd.DataFrame({"n": [n], "held": [total.tolist()]})

    slots = F.posexplode("held").alias("slot", "held")
    found = rows.select("text").mapInPandas(frequencies, "n long, held array<double>")
    sums = found.select("n", slots).groupBy("slot").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))
    table = sums.toPandas().sort_values("slot")
    if not len(table):
        return Model([], np.zeros((0, width)), np.zeros(0), np.ones(width), UNKNOWN, s)
    idf = (np.log((1 + table["n"].to_numpy()) / (1 + table["held"].to_numpy())) + 1).astype(np.float32)

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "text"], kind="stable")
        vectors = [normalised(c * idf)[has] for _, c, has in counted(group["text"].tolist(), s)]
        vectors = np.concatenate(vectors)
        if not len(vectors):
            return pd.DataFrame({"lang": [], "rows": [], "radius": [], "centre": []})
        centres = _clusters(vectors, s)
        near = vectors @ centres.T
        own = near.argmax(axis=1)
        out = []
        for c, centre in enumerate(centres):
            far = 1 - near[own == c, c]
            if len(far):
                radius = float(np.quantile(far, s.tolerated)) * s.slack
                out.append((group["lang"].iloc[0], len(far), radius, centre.astype(np.float32).tobytes()))
        return pd.DataFrame(out, columns=["lang", "rows", "radius", "centre"])

    schema = "lang string, rows long, radius double, centre binary"
    found = rows.groupBy("lang").applyInPandas(cluster, schema).toPandas()
    found = found.sort_values(["lang", "centre"], kind="stable")
    if not len(found):
        return Model([], np.zeros((0, width)), np.zeros(0), idf, UNKNOWN, s)
    centres = np.stack([np.frombuffer(c, dtype=np.float32) for c in found["centre"]])
    common = found.groupby("lang")["rows"].sum().idxmax()
    return Model(found["lang"].tolist(), centres, found["radius"].to_numpy(), idf, common, s)


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row of `documents(doc_id, text)`."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                names, scores, rejected = sent.value.predict(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(names), pa.array(scores), pa.array(rejected)],
                    names=["doc_id", "lang_pred", "score", "rejected"],
                )

    schema = f"doc_id {kind}, lang_pred string, score double, rejected boolean"
    return documents.select("doc_id", "text").mapInArrow(predicted, schema)

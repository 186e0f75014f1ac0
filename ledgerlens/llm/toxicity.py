"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

The labels name documents, the field needs labelled tokens. They are derived from the training
sample: a word, or a word beginning, that occurs in several toxic documents and in next to no
clean one marks its tokens as toxic there (near copies among the sample count once, so that one
copied document does not make its own words suspicious). The field then learns to tag tokens from
hashed features of the word, its beginnings and endings and its neighbours, so that it also tags
words it has not seen. A sequence is a sentence, cut at `longest` tokens.

Tags are "toxic" and "other". With two tags a forward or backward message is one number, the
log-odds of the tag, so the recursions run over all sentences of a batch side by side. The
marginal log-odds of a token is the sum of both messages. A document's score is a logistic
function of its largest marginal and of its expected number of toxic tokens, calibrated on the
same sample. Training keeps every sentence with a marked token and thins the others (`clean_sentences`,
`least_clean`), which raises the odds of "toxic" by one over the share kept. Spans are runs of tokens
whose marginal, corrected by that share, is at least one half, as character offsets.

Defined results: a null or empty text, or one without words, gets the score of an empty document
and no spans. Rows without a label teach nothing, several label rows of a document each teach.
Every row gets a row, repeats and null ids included. Without labelled rows of both kinds every
score is the share of toxic rows seen (0 without any). Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import sample
from ledgerlens.llm.text import SPLIT, Tokens, chunks, mix, strings, tokens

STOPS = np.zeros(256, dtype=bool)
STOPS[[10, 13, 33, 46, 63]] = True  # line ends and . ! ? part sentences
BEGINNINGS, ENDINGS = (3, 4, 5, 6), (3, 4)  # bytes
FLOOR = 0.01  # added to the expected number of toxic tokens before its logarithm


@dataclass(frozen=True)
class Settings:
    bits: int = 18  # slots of the hashed features
    most_toxic: int = 3000  # bounds of the training sample
    most_clean: int = 9_000
    longest: int = 64  # tokens of a sequence
    clean_sentences: float = 3.0  # unmarked sentences kept for each marked one, about
    least_clean: float = 0.01  # of the unmarked sentences are kept in any case
    support: int = 3  # toxic documents that a marker occurs in, at least
    purity: float = 0.97  # share of toxic documents among those with the marker, both kinds even
    chance: float = 0.01  # markers expected by mere chance among all words looked at
    epochs: int = 8
    least_steps: int = 600  # a small sample is read more often
    rate: float = 0.3
    decay: float = 1e-4


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of "toxic" against "other", one for each slot
    moves: np.ndarray  # log-scores of going from tag to tag; rows: from
    calibration: np.ndarray  # bias, largest marginal, expected number
    settings: Settings
    kept: float = 1.0  # share of unmarked sentences that training kept

    def marginals(self, t: Tokens) -> np.ndarray:
        """Log-odds of "toxic" for each word of a piece."""
        sequence, place = _sequences(t, self.settings.longest)
        emitted = np.zeros(len(t.doc), dtype=np.float64)
        for slots in _features(t, sequence, self.settings.bits):
            emitted += self.weights[slots]
        forward, backward = _messages(emitted, sequence, place, self.moves)
        return forward + backward

    def summarise(self, column: pa.Array, spans: list | None = None) -> np.ndarray:
        """(largest marginal log-odds, expected toxic tokens) by document; adds byte `spans`."""
        largest, expected = np.full(len(column), -20.0), np.zeros(len(column))
        even = -math.log(self.kept)  # the log-odds that mean one half in unthinned text
        for t in _words(column):
            odds = self.marginals(t)
            np.maximum.at(largest, t.doc, odds)
            expected += np.bincount(t.doc, weights=_sigmoid(odds), minlength=len(column))
            if spans is not None:
                for k in np.flatnonzero(odds >= even):
                    own, joined = spans[t.doc[k]], k > 0 and odds[k - 1] >= even and t.joined[k]
                    end = int(t.base + t.end[k])
                    if joined:
                        own[-1] = (own[-1][0], end)
                    else:
                        own.append((int(t.base + t.start[k]), end))
        return np.stack([largest, expected], axis=1)

    def scores(self, column: pa.Array) -> np.ndarray:
        return _sigmoid(_calibrated(self.summarise(column)) @ self.calibration)

    def scores_and_spans(self, column: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """Scores, and the character ranges of the toxic spans of each document."""
        spans: list[list[tuple[int, int]]] = [[] for _ in range(len(column))]
        scores = _sigmoid(_calibrated(self.summarise(column, spans)) @ self.calibration)
        data, offsets = strings(column)
        for row, own in enumerate(spans):
            if own:
                first = offsets[row]
                heads = (data[first : own[-1][1]] & 0xC0) != 0x80
                chars = np.concatenate([[0], np.cumsum(heads)])
                spans[row] = [(int(chars[a - first]), int(chars[b - first])) for a, b in own]
        return scores, spans


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _calibrated(summary: np.ndarray) -> np.ndarray:
    largest, expected = summary[:, 0].clip(-20, 20) / 5, np.log(FLOOR + summary[:, 1])
    return np.stack([np.ones(len(summary)), largest, expected], axis=1)


def _words(column: pa.Array) -> Iterator[Tokens]:
    """The words of a column, piece by piece, without punctuation.

    `joined` tells which words follow another one of their document with only white space between.
    """
    data, offsets = strings(column)
    for t in tokens(data, offsets, SPLIT):
        word = t.kind == 1
        order = np.flatnonzero(word)
        for name in ("doc", "hash", "kind", "start", "end"):
            setattr(t, name, getattr(t, name)[word])
        if len(t.doc):
            t.joined = np.concatenate([[False], (np.diff(order) == 1) & (t.doc[1:] == t.doc[:-1])])
            yield t


def _sequences(t: Tokens, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence of each word, counted from 0, and its place there."""
    stops = np.concatenate([[0], np.cumsum(STOPS[t.low])])
    new = np.ones(len(t.doc), dtype=bool)
    new[1:] = (t.doc[1:] != t.doc[:-1]) | (stops[t.start[1:]] > stops[t.end[:-1]])
    number = np.arange(len(t.doc))
    place = number - np.maximum.accumulate(np.where(new, number, 0))
    new |= place % longest == 0
    place = place % longest
    return np.cumsum(new) - 1, place


def _features(t: Tokens, sequence: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Slots of one kind of feature at a time, for all words; slot 0 stands for "none"."""
    shift = np.uint64(64 - bits)

    def slots(x, kind, real=None):
        found = (mix(x ^ np.uint64(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> shift).astype(np.int64)
        return found if real is None else np.where(real, found, 0)

    yield np.ones(len(t.doc), dtype=np.int64)  # the bias
    yield slots(t.hash, 1)
    size = t.end - t.start
    for kind, x, real in _parts(t, size):
        yield slots(x, kind, real)
    same = sequence[1:] == sequence[:-1]
    for kind, x, real in (
        (30, np.concatenate([[np.uint64(0)], t.hash[:-1]]), np.concatenate([[False], same])),
        (31, np.concatenate([t.hash[1:], [np.uint64(0)]]), np.concatenate([same, [False]])),
    ):
        yield slots(x, kind, real)


def _parts(t: Tokens, size: np.ndarray):
    for k in BEGINNINGS:
        yield 10 + k, t.part(t.start, np.minimum(t.start + k, t.end)), size > k
    for k in ENDINGS:
        yield 20 + k, t.part(np.maximum(t.end - k, t.start), t.end), size > k


def _messages(emitted, sequence, place, moves) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds messages: forward with the word's own emission, backward without it."""
    (oo, ot), (to, tt) = moves
    forward, backward = emitted.copy(), np.zeros_like(emitted)
    order = np.argsort(place, kind="stable")
    cuts = np.searchsorted(place[order], np.arange(place.max(initial=0) + 2))
    for k in range(1, len(cuts) - 1):
        at = order[cuts[k] : cuts[k + 1]]
        f = forward[at - 1]
        forward[at] += np.logaddexp(f + tt, ot) - np.logaddexp(f + to, oo)
    for k in range(len(cuts) - 2, 0, -1):
        at = order[cuts[k] : cuts[k + 1]]
        b = backward[at] + emitted[at]
        backward[at - 1] = np.logaddexp(b + tt, to) - np.logaddexp(b + ot, oo)
    return forward, backward


def _thinned(docs: list[np.ndarray]) -> np.ndarray:
    """Which documents do not share one of four minimal word-triple hashes with an earlier one."""
    seen: set[tuple[int, int]] = set()
    keep = np.zeros(len(docs), dtype=bool)
    for k, h in enumerate(docs):
        triple = mix(mix(h[:-2] * np.uint64(3) + h[1:-1]) * np.uint64(5) + h[2:]) if len(h) > 2 else h
        if not len(triple):
            continue
        marks = {(i, int(mix(triple ^ np.uint64(i + 1)).min())) for i in range(4)}
        keep[k] = not marks & seen
        seen |= marks
    return keep


def _document_words(column: pa.Array) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """For each piece: the document of each mark, the marks: words and their beginnings."""
    for t in _words(column):
        size = t.end - t.start
        parts = [(x[real], t.doc[real]) for kind, x, real in _parts(t, size) if 13 < kind < 20]
        yield np.concatenate([t.doc, *(d for _, d in parts)]), [t.hash, *(x for x, _ in parts)]


def _counts(column: pa.Array, keep: np.ndarray, among: np.ndarray | None = None):
    """(marks, documents with each): over the kept documents, of all marks or those in `among`."""
    total = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    for doc, marks in _document_words(column):
        mark = np.concatenate(marks)
        at = keep[doc]
        if among is not None:
            place = np.searchsorted(among, mark).clip(max=max(0, len(among) - 1))
            at &= (among[place] == mark) if len(among) else False
        mark, doc = mark[at], doc[at].astype(np.uint64)
        # A document counts once for a mark; (mark, document) goes by its hash. A document that
        # is longer than a piece counts once for each.
        _, first = np.unique(mix(mark + doc * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
        own, count = np.unique(mark[first], return_counts=True)
        held, place = np.unique(np.concatenate([total[0], own]), return_inverse=True)
        both = np.bincount(place, weights=np.concatenate([total[1], count]), minlength=len(held))
        total = held, both.astype(np.int64)
    return total


def _spread(column: pa.Array) -> np.ndarray:
    """Which documents are not near copies of an earlier one."""
    words: list[list[np.ndarray]] = [[] for _ in range(len(column))]
    for t in _words(column):
        rows = np.unique(t.doc)
        for row, own in zip(rows, np.split(t.hash, np.searchsorted(t.doc, rows)[1:])):
            words[row].append(own)
    return _thinned([np.concatenate(w) if w else np.zeros(0, dtype=np.uint64) for w in words])


def _markers(column: pa.Array, labels: np.ndarray, s: Settings) -> np.ndarray:
    """Hashes of words and word beginnings that mark toxic documents.

    A mark must be purely toxic, and more often so than chance explains: so many words are looked
    at that some occur in a few toxic documents only, without meaning anything.
    """
    toxic, clean = (column.filter(pa.array(labels == k)) for k in (1, 0))
    spread = _spread(toxic)
    marks, bad = _counts(toxic, spread)
    looked_at = max(1, len(marks))
    marks, bad = marks[bad >= s.support], bad[bad >= s.support]
    held, count = _counts(clean, np.ones(len(clean), dtype=bool), marks)
    good = np.zeros(len(marks), dtype=np.int64)
    good[np.searchsorted(marks, held)] = count
    share = spread.sum() / max(1, spread.sum() + len(clean))
    odds = share / max(1e-9, 1 - share)
    pure = bad >= s.purity * (bad + good * odds)
    orders = np.array([math.lgamma(b + g + 1) - math.lgamma(b + 1) - math.lgamma(g + 1) for b, g in zip(bad, good)])
    surprise = -bad * np.log(share) - orders if share > 0 else np.zeros(len(bad))
    return marks[pure & (surprise >= np.log(looked_at / s.chance))]


def train(column: pa.Array, labels: np.ndarray, s: Settings) -> Model:
    """Learn from texts and their 0/1 labels: one bounded sample."""
    labels = np.asarray(labels, dtype=np.int64)
    rng = np.random.default_rng(7)
    weights, moves = np.zeros(1 << s.bits), np.array([[2.0, -2.0], [0.5, -0.5]])
    gw, gm = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)
    weights[1] = -3.0
    share = labels.mean() if len(labels) else 0.0
    if not 0 < share < 1:
        flat = Model(weights, moves, np.array([35.0 * (2 * share - 1), 0, 0]), s)
        return flat
    marks = _markers(column, labels, s)
    batches, unmarked, held = [], 0, 0
    for t in _words(column):
        size = t.end - t.start
        hit = np.isin(t.hash, marks)
        for kind, x, real in _parts(t, size):
            if 13 < kind < 20:
                hit |= real & np.isin(x, marks)
        hit &= labels[t.doc] == 1
        sequence, place = _sequences(t, s.longest)
        marked = np.bincount(sequence, weights=hit) > 0
        chosen = marked | (rng.random(len(marked)) < max(s.least_clean, s.clean_sentences * marked.mean()))
        unmarked += int((~marked).sum())
        held += int((chosen & ~marked).sum())
        at = chosen[sequence]
        slots = np.stack([f[at] for f in _features(t, sequence, s.bits)], axis=1)
        batches.append((slots, hit[at].astype(float), sequence[at], place[at]))
    steps = []
    for slots, hit, sequence, place in batches:
        cuts = np.flatnonzero(np.diff(sequence, prepend=-1))
        for a in range(0, len(cuts), 256):
            end = cuts[a + 256] if a + 256 < len(cuts) else len(sequence)
            steps.append((slots[cuts[a] : end], hit[cuts[a] : end], place[cuts[a] : end]))
    for _ in range(max(s.epochs, -(-s.least_steps // max(1, len(steps))))):
        for k in rng.permutation(len(steps)):
            slots, hit, place = steps[k]
            emitted = weights[slots].sum(axis=1)
            forward, backward = _messages(emitted, None, place, moves)
            p = _sigmoid(forward + backward)
            error = p - hit
            g = np.zeros_like(weights)
            np.add.at(g, slots.ravel(), np.repeat(error, slots.shape[1]))
            g[0] = 0
            touched = np.flatnonzero(g)
            g = g[touched] + s.decay * weights[touched]
            gw[touched] += g * g
            weights[touched] -= s.rate * g / np.sqrt(gw[touched])
            g = _move_errors(forward, backward, emitted, hit, place, moves)
            gm += g * g
            moves -= 0.1 * s.rate * g / np.sqrt(gm)
    weights[0] = 0
    model = Model(weights.astype(np.float32), moves, np.zeros(3), s)
    x = _calibrated(model.summarise(column))
    kept = max(held, 1) / max(unmarked, 1)
    return Model(model.weights, moves, _logistic(x, labels.astype(float)), s, min(1.0, kept))


def _move_errors(forward, backward, emitted, hit, place, moves) -> np.ndarray:
    """Expected less observed transitions."""
    at = np.flatnonzero(place > 0)
    f, b = forward[at - 1], backward[at] + emitted[at]
    score = np.stack([moves[0, 0] + 0 * f, moves[0, 1] + b, moves[1, 0] + f, moves[1, 1] + f + b], axis=1)
    score = np.exp(score - score.max(axis=1, keepdims=True))
    expected = (score / score.sum(axis=1, keepdims=True)).sum(axis=0).reshape(2, 2)
    seen = np.bincount((2 * hit[at - 1] + hit[at]).astype(int), minlength=4).reshape(2, 2)
    return expected - seen


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) + ridge * w)
    return w


def fit(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from `documents(doc_id, text)` and `labels(doc_id, label)`.

    Restrict `labels` to the rows that may be learnt from. One task reads the bounded sample; one
    vector of fixed length reaches the driver.
    """
    known = labels.select("doc_id", F.col("label").cast("int")).dropna()
    bounds = {0: settings.most_clean, 1: settings.most_toxic}
    chosen = sample.per_class(known, "label", bounds, "doc_id")
    rows = sample.labelled(documents, chosen, ["doc_id", "text"])

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "label"], kind="stable")
        labels, column = group["label"].to_numpy(), pa.array(group["text"], type=pa.large_string())
        del group  # the sample is held once
        m = train(column, labels, settings)
        flat = [np.asarray(a, dtype=np.float64).tobytes() for a in (m.weights, m.moves, m.calibration)]
        return pd.DataFrame([[*flat, m.kept]], columns=["weights", "moves", "calibration", "kept"])

    schema = "weights binary, moves binary, calibration binary, kept double"
    found = rows.groupBy(F.lit(0).alias("one")).applyInPandas(learn, schema).collect()
    if not found:
        return train(pa.array([], type=pa.large_string()), np.zeros(0), settings)
    w, m, c = (np.frombuffer(found[0][k]).copy() for k in ("weights", "moves", "calibration"))
    return Model(w.astype(np.float32), m.reshape(2, 2), c, settings, found[0]["kept"])


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, spans) of every row of `documents(doc_id, text)`.

    `spans` lists (start, end) character offsets of offending passages, in order.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    sent = documents.sparkSession.sparkContext.broadcast(model)
    ranges = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                m, text = sent.value, batch.column(1)
                scores, found = m.scores_and_spans(text)
                found = [[{"start": a, "end": b} for a, b in own] for own in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(scores), pa.array(found, type=ranges)],
                    names=["doc_id", "score", "spans"],
                )

    schema = f"doc_id {kind}, score double, spans array<struct<start: bigint, end: bigint>>"
    return documents.select("doc_id", "text").mapInArrow(scored, schema)


def accepted(documents: DataFrame, model: Model, most: float) -> DataFrame:
    """The rows of `documents`, all columns as they are, whose text scores below `most`."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                column = batch.column(batch.schema.get_field_index("text"))
                yield batch.filter(pa.array(sent.value.scores(column) < most))

    return documents.mapInArrow(passing, documents.schema)

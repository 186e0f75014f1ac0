"""Tokens of a whole Arrow batch at once: byte classes, rolling hashes and offsets in numpy.

The text column of a batch is one run of UTF-8 bytes. A token is a maximal run of bytes of one
class inside one document. Its 64-bit hash comes from prefix sums of a polynomial over the bytes,
so no Python object is made per word. Work is done in pieces of `PIECE` bytes, cut between tokens,
so memory depends on neither the batch nor the length of a document (a single token longer than
a piece is taken whole).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


VALUES = mix(np.arange(1, 257, dtype=np.uint64))  # a random word for each byte
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# Bytes between words, as in the pattern [^\x20\x09-\x0D]+, and everything else.
SPACED = np.ones(256, dtype=np.uint8)
SPACED[[32, 9, 10, 11, 12, 13]] = 0
# Letters, digits and all bytes beyond ASCII are one class, punctuation is another.
SPLIT = np.full(256, 2, dtype=np.uint8)
SPLIT[[*range(0, 33), 127]] = 0
SPLIT[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", BASE), ("down", INVERSE)):
                steps = np.full(n, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up, self.down


POWERS = _Powers()


@dataclass
class Tokens:
    """Tokens in order: the document's number in the batch, hash, class and byte offsets.

    Offsets count from the start of the piece; `low` holds the piece's bytes in lower case,
    `sums` the prefix sums of the polynomial, `base` the piece's place in the batch's bytes.
    """

    doc: np.ndarray
    hash: np.ndarray
    kind: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    sums: np.ndarray
    base: int
    joined: np.ndarray | None = None

    def part(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges inside the piece."""
        return mix((self.sums[end] - self.sums[start]) * POWERS.to(0)[1][start])


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    held = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def tokens(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> Iterator[Tokens]:
    """The tokens of a batch, piece by piece; every document's tokens come in order."""
    size, at = len(data), 0
    while at < size:
        to = min(size, at + PIECE)
        if to < size:
            to = _cut(data, offsets, classes, at, to)
        yield _piece(data[at:to], offsets, classes, at)
        at = to


def _cut(data, offsets, classes, at: int, to: int) -> int:
    """The last place at or before `to` that no token spans, or else the first one after it."""
    first = offsets[np.searchsorted(offsets, to, side="right") - 1]
    if first > at:
        return int(first)
    gap = np.flatnonzero(classes[data[at + 1 : to]] != classes[data[at : to - 1]])
    if len(gap):
        return at + 1 + int(gap[-1])
    while to < len(data) and classes[data[to]] == classes[data[to - 1]] and to not in offsets:
        run = classes[data[to : to + PIECE]] != classes[data[to - 1]]
        to += int(run.argmax()) if run.any() else len(run)
    return to


def _piece(data, offsets, classes, at: int) -> Tokens:
    size = len(data)
    up, _ = POWERS.to(size + 1)
    low, kind = LOWER[data], classes[data]
    edge = np.ones(size + 1, dtype=bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets[(offsets > at) & (offsets < at + size)] - at] = True
    cuts = np.flatnonzero(edge)
    start, end = cuts[:-1], cuts[1:]
    real = kind[start] > 0
    start, end = start[real], end[real]
    sums = np.zeros(size + 1, dtype=np.uint64)
    np.cumsum(VALUES[low] * up[:size], dtype=np.uint64, out=sums[1:])
    # The documents that the piece touches, each as often as it has tokens here.
    rows = np.searchsorted(offsets, at, side="right") - 1, np.searchsorted(offsets, at + size)
    bounds = np.searchsorted(start, offsets[rows[0] : rows[1] + 1] - at)
    out = Tokens(
        doc=np.repeat(np.arange(*rows), np.diff(bounds)),
        hash=start, kind=kind[start], start=start, end=end, low=low, sums=sums, base=at,
    )
    out.hash = out.part(start, end)
    return out


def word_hashes(column: pa.Array, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document number, token hash) of all tokens of a text column."""
    found = [(t.doc, t.hash) for t in tokens(*strings(column), classes)]
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate([d for d, _ in found]), np.concatenate([h for _, h in found])


def chunks(batch: pa.RecordBatch, text: str, size: int = 2 * PIECE) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about `size` bytes of text, one row at least."""
    _, offsets = strings(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        to = max(at + 1, min(to, batch.num_rows))
        yield batch.slice(at, to - at)
        at = to


def shingles(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(document number, shingle hash) of all runs of `words` words, repeats included.

    A document with fewer words gives one shingle of all of them, one without words gives none.
    """
    doc, word = word_hashes(column, SPACED)
    if not len(doc):
        return doc, word
    rows = len(column)
    count = np.bincount(doc, minlength=rows)
    first = np.cumsum(count) - count
    per = np.where(count >= words, count - words + 1, (count > 0).astype(count.dtype))
    owner = np.repeat(np.arange(rows), per)
    at = first[owner] + np.arange(len(owner)) - (np.cumsum(per) - per)[owner]
    left = np.minimum(count[owner], words)
    total = np.full(len(owner), 0x632BE59BD9B4E019, dtype=np.uint64)
    padded = np.concatenate([word, np.zeros(words, dtype=np.uint64)])
    for k in range(words):
        total = np.where(left > k, mix(total * np.uint64(BASE) + padded[at + k]), total)
    return owner, total


def and_end(batches: Iterator) -> Iterator:
    """The batches, and None behind the last one."""
    yield from batches
    yield None

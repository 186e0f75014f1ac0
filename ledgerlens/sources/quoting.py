"""Records of several lines, found and put together where a split of a file is read.

A line leads from one state to another: in a quoted field or not, at its beginning and its end. It ends in
the same state whatever came before, or keeps the state, or swaps it. So does a run of lines, and a whole
split: `summaries` gives one row for each. Once it is known how each split begins, `stitched` puts
records together inside the splits, line by line in the order read; only the pieces of records that lie
on the edge of two splits are left to be joined.

Both take Arrow batches of lines in the order of the file and hold no more than a batch and an open record.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Where the quotes of a line leave a reader: in text, inside a quoted field, just behind a quote
# that may have closed one, at the beginning of a record.
TEXT, QUOTED, CLOSED, BEGINNING = 0, 1, 2, 3
ROUNDS = 32  # quotes of a line that are followed for all lines at once

SUMMARY = "file string, block bigint, from_text boolean, from_field boolean, begins boolean, filled boolean, head string"
PIECES = "value string, file string, block bigint, start bigint, heads boolean"


def _ends_quoted(data: np.ndarray, offsets: np.ndarray, start: int) -> np.ndarray:
    """Whether a quoted field is open at the end of each line that begins in state `start`.

    A quote opens a field only at the field's beginning, and closes it unless a second one follows.
    Any other quote is text.
    """
    rows = len(offsets) - 1
    state = np.full(rows, start, dtype=np.int8)
    quotes = np.flatnonzero(data == 34)
    if not len(quotes):
        return state == QUOTED
    line = np.searchsorted(offsets, quotes, side="right") - 1
    before = data[quotes - 1]
    first = quotes == offsets[line]
    behind = first | (before == 34)  # no text since the quote before, or since the beginning
    comma = ~first & (before == 44)
    count = np.bincount(line, minlength=rows)
    place = np.cumsum(count) - count
    for k in range(min(ROUNDS, int(count.max()))):
        own = np.flatnonzero(count > k)
        at, now = place[own] + k, state[own]
        opens = comma[at] | (behind[at] & ((now == CLOSED) | (now == BEGINNING)))
        state[own] = np.where(now == QUOTED, CLOSED, np.where(opens, QUOTED, TEXT))
    for i in np.flatnonzero(count > ROUNDS).tolist():
        now, a, b = int(state[i]), int(place[i]) + ROUNDS, int(place[i] + count[i])
        for after, opened in zip(behind[a:b].tolist(), comma[a:b].tolist()):
            if now == QUOTED:
                now = CLOSED
            else:
                now = QUOTED if opened or (after and now in (CLOSED, BEGINNING)) else TEXT
        state[i] = now
    return state == QUOTED


def _states(from_text: np.ndarray, from_field: np.ndarray, start: bool) -> np.ndarray:
    """Whether a quoted field is open before each line, and behind the last one."""
    rows = len(from_text)
    constant, swap = from_text == from_field, from_text & ~from_field
    swaps = np.concatenate([[0], np.cumsum(swap)])  # before each line
    last = np.concatenate([[-1], np.maximum.accumulate(np.where(constant, np.arange(rows), -1))])
    known = last >= 0
    base = np.where(known, from_text[last], start)
    since = swaps - np.where(known, swaps[last], 0)
    return base ^ (since % 2 == 1)


@dataclass
class _Run:
    """Lines of one split that came in one batch."""

    file: str
    block: int
    first: int  # line in the batch
    data: np.ndarray
    offsets: np.ndarray
    from_text: np.ndarray
    from_field: np.ndarray

    def text(self, a: int, b: int) -> bytes:
        """The lines a to b as they stand in the file."""
        cuts = self.offsets[a + 1 : b] - self.offsets[a]
        return np.insert(self.data[self.offsets[a] : self.offsets[b]], cuts, 10).tobytes()

    def filled(self) -> int | None:
        """The first line that is not blank."""
        dark = ~np.isin(self.data, (32, 9, 13))
        if not dark.any():
            return None
        return int(np.searchsorted(self.offsets, dark.argmax(), side="right")) - 1


def _runs(batch: pa.RecordBatch) -> Iterator[_Run]:
    """The lines of a batch, split by split; columns value, file, block come first."""
    rows = batch.num_rows
    if not rows:
        return
    value = batch.column(0).cast(pa.large_string())
    offsets = np.frombuffer(value.buffers()[1], dtype=np.int64)[value.offset : value.offset + rows + 1]
    held = value.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held else np.zeros(0, dtype=np.uint8)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    from_text, from_field = _ends_quoted(data, offsets, BEGINNING), _ends_quoted(data, offsets, QUOTED)
    file, block = batch.column(1), batch.column(2).to_numpy()
    other = pc.not_equal(file.slice(1), file.slice(0, rows - 1)).to_numpy(zero_copy_only=False)
    edges = np.flatnonzero(other | (block[1:] != block[:-1])) + 1
    bounds = [0, *edges.tolist(), rows]
    for a, b in zip(bounds, bounds[1:]):
        cut = offsets[a : b + 1]
        yield _Run(
            file[a].as_py(), int(block[a]), a, data[cut[0] : cut[-1]], cut - cut[0],
            from_text[a:b], from_field[a:b],
        )


@dataclass
class _Summary:
    """What is known of a split so far, however it begins."""

    file: str
    block: int
    from_text: bool = False
    from_field: bool = True
    begins: bool = False  # whether a record begins in it that begins in a field
    head: list[bytes] | None = None  # the lines of its first record that is not blank
    ended: bool = False

    def add(self, run: _Run) -> None:
        text = _states(run.from_text, run.from_field, self.from_text)
        other = _states(run.from_text, run.from_field, self.from_field)
        self.begins = self.begins or not other[:-1].all()
        rows, at = len(run.from_text), 0
        if self.head is None:
            found = run.filled()
            if found is not None:
                self.head, at = [], found
        if self.head is not None and not self.ended:
            begin = np.flatnonzero(~text[at:rows]) + at
            begin = begin[begin > at] if not self.head else begin
            to = int(begin[0]) if len(begin) else rows
            if to > at:
                self.head.append(run.text(at, to))
            self.ended = len(begin) > 0
        self.from_text, self.from_field = bool(text[-1]), bool(other[-1])

    def row(self) -> tuple:
        whole = self.head is not None and (self.ended or not self.from_text)
        head = b"\n".join(self.head) if whole else None
        return self.file, self.block, self.from_text, self.from_field, self.begins, self.head is not None, head


def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of SUMMARY for each split, from lines (value, file, block)."""
    names = [c.split()[0] for c in SUMMARY.split(", ")]
    types = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_(), pa.binary()]

    def told(now: _Summary) -> pa.RecordBatch:
        *columns, head = [pa.array([v], type=t) for v, t in zip(now.row(), types)]
        return pa.RecordBatch.from_arrays([*columns, head.view(pa.string())], names=names)

    now = None
    for batch in batches:
        for run in _runs(batch):
            if now is not None and (now.file, now.block) != (run.file, run.block):
                yield told(now)
                now = None
            now = now or _Summary(run.file, run.block)
            now.add(run)
    if now is not None:
        yield told(now)


@dataclass
class _Open:
    """The record of a split that goes on, and how the split stands."""

    file: str
    block: int
    state: bool  # in a quoted field
    start: int | None  # the split where the open record began, None if in this one
    heads: bool  # whether the first record that is not blank heads the file
    begun: bool  # whether there is an open record, or a piece of one
    is_head: bool = False
    parts: list[bytes] = field(default_factory=list)


def stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PIECES from lines (value, file, block, open, start, heads): records, and pieces of records.

    A record that lies in one split has no start; a piece has the split where its record began.
    """

    def made(file: str, block: int, values: pa.Array, start, heads: np.ndarray) -> pa.RecordBatch:
        n = len(values)
        return pa.RecordBatch.from_arrays(
            [
                values,
                pa.repeat(pa.scalar(file, type=pa.string()), n),
                pa.array(np.full(n, block, dtype=np.int64)),
                pa.array([start] * n, type=pa.int64()) if start is not None else pa.nulls(n, pa.int64()),
                pa.array(heads),
            ],
            names=["value", "file", "block", "start", "heads"],
        )

    def closed(now: _Open, start) -> pa.RecordBatch:
        value = pa.array([b"\n".join(now.parts)], type=pa.binary()).view(pa.string())
        out = made(now.file, now.block, value, start, np.array([now.is_head]))
        now.parts, now.begun, now.is_head, now.start = [], False, False, None
        return out

    def ended(now: _Open) -> Iterator[pa.RecordBatch]:
        if now.begun:
            goes_on = now.block if now.state else None
            yield closed(now, goes_on if now.start is None else now.start)

    now = None
    for batch in batches:
        for run in _runs(batch):
            if now is None or (now.file, now.block) != (run.file, run.block):
                if now is not None:
                    yield from ended(now)
                opened = batch.column(3)[run.first].as_py()
                now = _Open(
                    run.file, run.block, opened, batch.column(4)[run.first].as_py() if opened else None,
                    batch.column(5)[run.first].as_py(), opened,
                )
            states = _states(run.from_text, run.from_field, now.state)
            rows = len(run.from_text)
            begin = np.flatnonzero(~states[:rows])
            first = int(begin[0]) if len(begin) else rows
            if now.begun:
                if first:
                    now.parts.append(run.text(0, first))
                if first < rows:
                    yield closed(now, now.start)
            now.state = bool(states[-1])
            if first == rows:
                continue
            # Records that begin here: whole ones, and the last one if it goes on.
            head = run.filled() if now.heads else None
            heads = begin == (-1 if head is None else head)
            now.heads = now.heads and head is None
            if now.state:
                last = int(begin[-1])
                now.parts, now.begun, now.is_head = [run.text(last, rows)], True, bool(heads[-1])
                begin, heads, rows = begin[:-1], heads[:-1], last
            if len(begin):
                a, b = run.offsets[first], run.offsets[rows]
                goes_on = np.flatnonzero(states[first:rows]) + first
                data = np.insert(run.data[a:b], run.offsets[goes_on] - a, 10) if len(goes_on) else run.data[a:b]
                more = np.searchsorted(goes_on, begin)
                ends = np.concatenate([run.offsets[begin] - a + more, [len(data)]]).astype(np.int64)
                values = pa.LargeStringArray.from_buffers(
                    len(begin), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))
                ).cast(pa.string())
                yield made(run.file, run.block, values, None, heads)
    if now is not None:
        yield from ended(now)

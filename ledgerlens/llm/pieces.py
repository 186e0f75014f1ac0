"""Encoding with a SentencePiece vocabulary: the N best segmentations of whole texts, and decoding.

The lattice of a text has an edge for every vocabulary piece that occurs at a place. A forward
Viterbi pass finds the best score of reaching each place. These scores are then exact heuristics
of a backward A* search from the end: partial paths are expanded in the order of their best
complete score, so complete paths come out best first.

No piece holds a space after another character (checked when the vocabulary is read), so the lattice
falls apart before every run of spaces; likewise at line ends and before punctuation. Each part,
about a word, is solved by itself; the N best of a text are combined from the parts with the smallest
loss: a part outside the N - 1 smallest cannot be among them. Parts are cut from texts of `CHUNK`
bytes at once and known by 64-bit hash. The forward pass runs over all distinct parts of these
side by side, place by place; only parts of more than `LONG` bytes and the parts that give a text its
alternatives are handled one by one.

Characters without a piece become byte pieces, so decoding gives back any text, code point by code
point. The vocabulary comes from an installed file that is only read. It is used as it is, with one
space put before a text, as its own encoder does.

Defined results: a null text stays null, without segmentations; an empty one has one, of no pieces.
Segmentations with equal scores come in the fixed order of the search.
Repeated rows and null ids are rows like any others, extra columns are ignored.
"""

from __future__ import annotations

import heapq
import string
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, StringType, StructType

from ledgerlens.llm.text import POWERS, VALUES, chunks, mix, strings
from ledgerlens.session import size_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_BYTE = 10.0  # a byte piece scores this much below the worst ordinary piece
CHUNK = 1 << 19  # bytes of text whose parts are solved at once
LONG = 64  # bytes of a part that is solved by itself
REMEMBERED = 1 << 14  # parts of at most 40 characters whose alternatives are kept


@dataclass
class Cuts:
    """Between which neighbouring characters no piece of a vocabulary lies, in terms of bytes.

    Parts begin before runs of spaces, at line ends, and before punctuation that follows a
    letter, as far as no piece has such neighbours. Letters are those of ASCII and of U+00C0 to U+00FF.
    """

    spaces: bool
    lines: bool
    marks: np.ndarray  # by byte
    letters: np.ndarray  # by byte; from 256 on, by the last byte of a letter that begins with 195

    @classmethod
    def of(cls, pairs: set[tuple[str, str]]) -> Cuts:
        marks, letters = np.zeros(256, dtype=bool), np.zeros(512, dtype=bool)
        letters[[k if k < 128 else 256 + k - 64 for k in (*range(128), *range(192, 256)) if chr(k).isalpha()]] = True
        spaces = not any(b == SPACE != a for a, b in pairs)
        lines = spaces and not any("\n" in pair for pair in pairs)
        if lines:
            signs = set(string.punctuation) - {b for a, b in pairs if a.isalpha()}
            marks[[ord(c) for c in signs]] = True
        return cls(spaces, lines, marks, letters)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The first byte of every part, and the end; no part goes from one text into the next."""
        size = len(data)
        edge = np.zeros(size + 1, dtype=bool)
        edge[offsets] = True
        edge[size] = True
        if size:
            own = np.flatnonzero(data[:-2] == 0xE2)  # a text's own sign for spaces is a part by itself
            own = own[(data[own + 1] == 0x96) & (data[own + 2] == 0x81)]
            edge[own] = edge[own + 3] = True
            before, after = data[:-1], data[1:]
            if self.spaces:
                edge[1:-1] |= (after == 32) & (before != 32)
            if self.lines:
                edge[1:-1] |= (after == 10) | (before == 10)
                at = np.flatnonzero(self.marks[after]) + 1
                wide = (at >= 2) & (data[at - 2] == 0xC3)
                edge[at[self.letters[data[at - 1] + 256 * wide]]] = True
        return np.flatnonzero(edge)


def _forward(edges) -> list[float]:
    """The best score of reaching each place."""
    score = [0.0] + [-np.inf] * len(edges)
    for i, own in enumerate(edges):
        at = score[i]
        for j, _, s in own:
            if at + s > score[j]:
                score[j] = at + s
    return score


def _search(edges, score: list[float]) -> Iterator[tuple[float, tuple[int, ...]]]:
    """(score, ids) of complete paths, best first, by A* from the end.

    The forward scores are exact, so every expansion lies on a path that is as good as its cost
    says. Of equal costs the one nearest to the beginning goes first, so ties do not pile up.
    """
    ending: list[list] = [[] for _ in range(len(edges) + 1)]
    for i, own in enumerate(edges):
        for j, ids, s in own:
            ending[j].append((i, ids, s))
    number = 0
    # (-best complete score, place, number, score from here on, (ids, rest of the path))
    heap: list = [(-score[-1], len(edges), 0, 0.0, None)]
    while heap:
        _, at, _, tail, path = heapq.heappop(heap)
        if at == 0:
            ids: list[int] = []
            while path is not None:
                ids.extend(path[0])
                path = path[1]
            yield tail, tuple(ids)
            continue
        for i, own, s in ending[at]:
            number += 1
            heapq.heappush(heap, (-(score[i] + s + tail), i, number, s + tail, (own, path)))


@dataclass
class Vocabulary:
    """Pieces with scores; `found` also holds None for every proper beginning of a piece."""

    text: list[bytes]  # what each id decodes to
    found: dict[str, tuple[int, float] | None]
    byte_ids: list[int]
    byte_score: float
    cuts: Cuts
    # Made and kept by each worker for itself.
    grown: dict | None = None
    longest: int = 1
    hashed: list | None = None
    others: dict = field(default_factory=dict)

    @classmethod
    def read(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        byte_ids, ordinary, text = [0] * 256, [], []
        for i, name in enumerate(names):
            if model.is_byte(i):
                byte_ids[int(name[3:5], 16)] = i
                text.append(bytes([int(name[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                text.append(b"")
            else:
                ordinary.append((name, i, model.get_score(i)))
                text.append(name.replace(SPACE, " ").encode())
        # Pieces that the model's makers put in by hand have no score of their own (-1e9).
        worst = min(s for _, _, s in ordinary if s > -1e8)
        return cls.of([(name, i, max(s, worst)) for name, i, s in ordinary], text, byte_ids)

    @classmethod
    def of(cls, ordinary: list[tuple[str, int, float]], text: list[bytes], byte_ids: list[int]):
        found: dict[str, tuple[int, float] | None] = {}
        for name, _, _ in ordinary:
            for k in range(1, len(name)):
                found.setdefault(name[:k], None)
        for name, i, s in ordinary:
            found[name] = (i, float(s))
        cuts = Cuts.of({pair for name, _, _ in ordinary for pair in zip(name, name[1:])})
        worst = min((s for _, _, s in ordinary), default=0.0) - UNKNOWN_BYTE
        return cls(text, found, byte_ids, float(worst), cuts)

    # -- one part

    def edges(self, part: str) -> list[list[tuple[int, tuple[int, ...], float]]]:
        """For each place the edges that begin there: (end, ids, score)."""
        out = []
        found, size = self.found, len(part)
        for i in range(size):
            own = []
            for j in range(i + 1, size + 1):
                piece = part[i:j]
                if piece not in found:
                    break
                hit = found[piece]
                if hit is not None:
                    own.append((j, (hit[0],), hit[1]))
            if not own or own[0][0] != i + 1:  # no piece for the character itself
                own.append(self._as_bytes(part, i))
            out.append(own)
        return out

    def _solve(self, part: str) -> tuple[bytes, float, float]:
        """The forward pass, keeping the two best scores of each place and the best way there."""
        if part == SPACE:
            ids, score = self._own_space()
            return np.array(ids, dtype=np.int32).tobytes(), score, np.inf
        text, trie = part.replace(" ", SPACE), self.trie
        size = len(text)
        best, second = [0.0] + [-np.inf] * size, [-np.inf] * (size + 1)
        back: list = [None] * (size + 1)
        for i in range(size):
            at, next_at, children, j, single = best[i], second[i], trie, i, False
            for char in text[i:] if size - i <= self.longest else text[i : i + self.longest]:
                node = children.get(char)
                if node is None:
                    break
                j += 1
                ids, score, children = node
                if ids is not None:
                    single = single or j == i + 1
                    t = at + score
                    if t > best[j]:
                        second[j] = max(best[j], next_at + score)
                        best[j], back[j] = t, (i, ids)
                    elif t > second[j]:
                        second[j] = t
            if not single:
                j, ids, score = self._as_bytes(text, i)
                t = at + score
                if t > best[j]:
                    second[j] = max(best[j], next_at + score)
                    best[j], back[j] = t, (i, np.array(ids, dtype=np.int32).tobytes())
                elif t > second[j]:
                    second[j] = t
        ids, at = [], size
        while at:
            at, own = back[at]
            ids.append(own)
        return b"".join(ids[::-1]), best[size], best[size] - second[size]

    @property
    def trie(self) -> dict:
        """Pieces letter by letter: character -> (ids as bytes, score, next characters)."""
        if self.grown is None:
            root: dict = {}
            for name, hit in self.found.items():
                if hit is not None:
                    node = root
                    for char in name[:-1]:
                        node = node.setdefault(char, [None, 0.0, {}])[2]
                    last = node.setdefault(name[-1], [None, 0.0, {}])
                    last[0], last[1] = np.array([hit[0]], dtype=np.int32).tobytes(), hit[1]
            self.grown, self.longest = root, max(map(len, self.found), default=1)
        return self.grown

    def _as_bytes(self, text: str, i: int) -> tuple[int, tuple[int, ...], float]:
        ids = tuple(self.byte_ids[b] for b in text[i].replace(SPACE, " ").encode())
        return i + 1, ids, len(ids) * self.byte_score

    def _losses(self, part: str, n: int) -> list[tuple[float, bool, tuple[int, ...]]]:
        """(loss against the best, whether it is the best, ids) of a part's n best segmentations.

        The parts with the smallest losses are common words, so their lists are remembered.
        """
        kept = self.others.get((part, n))
        if kept is None:
            own, score, _ = self._solve(part)
            kept = [
                (score - s, np.array(ids, dtype=np.int32).tobytes() == own, ids)
                for s, ids in islice(self.n_best(part), n)
            ]
            if len(part) <= 40:
                if len(self.others) >= REMEMBERED:
                    self.others = {}
                self.others[part, n] = kept
        return kept

    def _own_space(self) -> tuple[tuple[int, ...], float]:
        """A text's own sign for spaces is no space, so it is written as bytes."""
        ids = tuple(self.byte_ids[b] for b in SPACE.encode())
        return ids, len(ids) * self.byte_score

    def n_best(self, part: str) -> Iterator[tuple[float, tuple[int, ...]]]:
        """(score, ids) of a part's segmentations, best first."""
        if part == SPACE:
            ids, score = self._own_space()
            yield score, ids
            return
        edges = self.edges(part.replace(" ", SPACE))
        yield from _search(edges, _forward(edges))

    # -- many parts

    @property
    def by_size(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Beginnings of pieces of 1, 2, ... bytes: (sorted hashes, ids, scores, whether a piece goes on).

        The id is -1 where the beginning is no piece itself.
        """
        if self.hashed is None:
            sizes: list[dict[bytes, list]] = []
            for name, hit in self.found.items():
                if hit is not None:
                    spelt = name.replace(SPACE, " ").encode()
                    sizes += [{} for _ in range(len(spelt) - len(sizes))]
                    for k in range(1, len(spelt)):
                        sizes[k - 1].setdefault(spelt[:k], [-1, 0.0, False])[2] = True
                    sizes[len(spelt) - 1].setdefault(spelt, [-1, 0.0, False])[:2] = hit
            self.hashed = []
            for size, own in enumerate(sizes, 1):
                data = np.frombuffer(b"".join(own), dtype=np.uint8)
                start = np.arange(len(own)) * size
                hashes = _ranges(data, _sums(data), start, start + size)
                order = np.argsort(hashes)
                columns = [np.array([x[k] for x in own.values()])[order] for k in range(3)]
                self.hashed.append((hashes[order], *columns))
        return self.hashed

    def _edges_of(self, data, sums, place, room) -> tuple[np.ndarray, ...]:
        """(number, size, id, score) of all edges that begin at the given places of the data.

        `room` is how many bytes are left of a place's part; an edge of bytes has id -1.
        """
        lead = data[place]
        width = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
        begins = np.flatnonzero((lead & 0xC0) != 0x80)
        alone = np.zeros(len(place), dtype=bool)  # whether the character is a piece
        found, at = [], begins
        for size, (hashes, ids, scores, more) in enumerate(self.by_size, 1):
            at = at[room[at] >= size]
            if not len(at):
                break
            key = _ranges(data, sums, place[at], place[at] + size)
            k = np.minimum(np.searchsorted(hashes, key), len(hashes) - 1)
            known = hashes[k] == key
            at, k = at[known], k[known]
            piece = ids[k] >= 0
            hit, own = at[piece], k[piece]
            alone[hit] |= width[hit] == size
            found.append((hit, np.full(len(hit), size), ids[own], scores[own]))
            at = at[more[k]]
        at = begins[~alone[begins]]
        found.append((at, width[at].astype(np.int64), np.full(len(at), -1), width[at] * self.byte_score))
        return tuple(map(np.concatenate, zip(*found)))

    def _solved(self, data, sums, start, end) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all parts, how many are of each, best score, loss of the second best) of byte ranges.

        As `_solve`, for all parts at once: edges are taken by the offset they begin at, so every
        round extends the best and second best scores of each part by the edges of one place.
        """
        length = end - start
        first = np.cumsum(length) - length  # of a part's places
        part = np.repeat(np.arange(len(start)), length)
        offset = np.arange(int(length.sum())) - first[part]
        place = start[part] + offset
        at, size, ids, scores = self._edges_of(data, sums, place, length[part] - offset)
        order = np.argsort(offset[at].astype(np.uint8), kind="stable")  # at most LONG
        at, size, ids, scores = at[order], size[order], ids[order], scores[order]
        source = at + part[at]  # a part has one node more than places
        target = source + size
        nodes = len(place) + len(start)
        best, second = np.full(nodes, -np.inf), np.full(nodes, -np.inf)
        best[first + np.arange(len(start))] = 0
        back = np.zeros(nodes, dtype=np.int64)  # the edge by which a node is reached best
        rounds = np.searchsorted(offset[at], np.arange(int(length.max(initial=0)) + 1))
        for a, b in zip(rounds[:-1].tolist(), rounds[1:].tolist()):
            i, j, s = source[a:b], target[a:b], scores[a:b]
            reached, before = best[i] + s, best[j]
            better = reached > before
            second[j] = np.where(
                better, np.maximum(before, second[i] + s), np.maximum(second[j], reached)
            )
            best[j] = np.where(better, reached, before)
            back[j[better]] = a + np.flatnonzero(better)
        last = first + np.arange(len(start)) + length
        # Each place holds the id of the chosen edge that begins there, if one does.
        told = np.full(len(place), -1, dtype=np.int32)
        byte_ids = np.array(self.byte_ids, dtype=np.int32)
        now = last[length > 0]
        own = np.flatnonzero(length > 0)
        while len(now):
            edge = back[now]
            now = source[edge]
            begin = now - own
            spelt = ids[edge] >= 0
            told[begin[spelt]] = ids[edge][spelt]
            for k in range(4):
                more = begin[~spelt & (size[edge] > k)] + k
                told[more] = byte_ids[data[place[more]]]
            left = begin > first[own]
            now, own = now[left], own[left]
        counts = np.bincount(part[told >= 0], minlength=len(start))
        return told[told >= 0], counts, best[last], best[last] - second[last]

    def _each_solved(self, data, sums, start, end) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """`_solved` for parts of any length."""
        short = end - start <= LONG
        ids, counts, score, loss = self._solved(data, sums, start[short], end[short])
        if short.all():
            return ids, counts, score, loss
        order = np.concatenate([np.flatnonzero(short), np.flatnonzero(~short)])
        long = [
            self._solve(data[a:b].tobytes().decode())
            for a, b in zip(start[~short].tolist(), end[~short].tolist())
        ]
        counts = np.concatenate([counts, [len(k[0]) // 4 for k in long]])
        score = np.concatenate([score, [k[1] for k in long]])
        loss = np.concatenate([loss, [k[2] for k in long]])
        ids = np.concatenate([ids, *[np.frombuffer(k[0], dtype=np.int32) for k in long]])
        # Back to the order of the parts.
        place = np.argsort(order)
        firsts = (np.cumsum(counts) - counts)[place]
        counts = counts[place]
        ends = np.cumsum(counts)
        gathered = ids[np.repeat(firsts - (ends - counts), counts) + np.arange(int(counts.sum()))]
        return gathered, counts, score[place], loss[place]

    # -- texts

    def segments(self, texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list]]:
        """(ids of all texts, offsets of theirs, scores of the best, alternatives): the n - 1 next best.

        An alternative is its score and its changes: (first piece, pieces replaced, ids instead).
        """
        data, offsets = _spaced(texts)
        rows = len(texts)
        cuts = self.cuts(data, offsets)
        start, end = cuts[:-1], cuts[1:]
        sums = _sums(data)
        _, place, part = np.unique(_ranges(data, sums, start, end), return_index=True, return_inverse=True)
        held, size, score, loss = self._each_solved(data, sums, start[place], end[place])
        # The ids of every part, in one run: those of the distinct parts, gathered.
        first = (np.cumsum(size) - size)[part]
        size, score, loss = size[part], score[part], loss[part]
        ends = np.cumsum(size)
        ids = held[np.repeat(first - (ends - size), size) + np.arange(int(size.sum()))]
        # The parts of each text.
        bounds = np.searchsorted(start, offsets)
        piece = np.concatenate([[0], ends])
        scores = np.zeros(rows)
        filled = np.flatnonzero(np.diff(bounds))
        if len(filled):
            scores[filled] = np.add.reduceat(score, bounds[filled])
        others: list[list] = [[] for _ in range(rows)]
        if n > 1:
            for row in filled.tolist():
                a, b = int(bounds[row]), int(bounds[row + 1])
                few = a + _least(loss[a:b], n - 1)
                changed = [
                    (int(piece[k] - piece[a]), int(size[k]), self._losses(data[start[k] : end[k]].tobytes().decode(), n))
                    for k in few.tolist()
                ]
                others[row] = [(float(scores[row]) - lost, c) for lost, c in _combined(changed, n)]
        return ids, piece[bounds], scores, others

    def segment(self, text: str, n: int) -> tuple[np.ndarray, float, list[tuple[float, list]]]:
        """The ids of the best segmentation of one text, its score, alternatives."""
        ids, _, scores, others = self.segments(pa.array([text]), n)
        return ids, float(scores[0]), others[0]

    def decode(self, ids) -> str:
        """The text of a segmentation."""
        return b"".join(map(self.text.__getitem__, ids))[1:].decode()


def _spaced(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts with a space before each that is not empty, and their offsets."""
    data, offsets = strings(texts)
    filled = np.flatnonzero(np.diff(offsets))
    return np.insert(data, offsets[filled], 32), offsets + np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])


def _sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over the bytes."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(VALUES[data] * POWERS.to(len(data) + 1)[0][: len(data)], dtype=np.uint64, out=sums[1:])
    return sums


def _ranges(data: np.ndarray, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges."""
    return mix((sums[end] - sums[start]) * POWERS.to(len(data) + 1)[1][start])


def _least(loss: np.ndarray, n: int) -> np.ndarray:
    """Where the n smallest finite losses are, in order of place."""
    if len(loss) > n:
        bar = np.partition(loss, n - 1)[n - 1]
        few = np.concatenate([np.flatnonzero(loss < bar), np.flatnonzero(loss == bar)])[:n]
    else:
        few = np.arange(len(loss))
    return np.sort(few[np.isfinite(loss[few])])


def _combined(changed: list[tuple[int, int, list]], n: int) -> list[tuple[float, list]]:
    """(loss, changes) of the n - 1 best ways of replacing some parts' segmentations."""
    found: list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]] = [(0.0, [])]
    for first, count, losses in changed:
        others = [(lost, [] if same else [(first, count, ids)]) for lost, same, ids in losses]
        both = [(a + b, x + y) for a, x in found for b, y in others]
        found = sorted(both, key=lambda t: (t[0], t[1]))[:n]
    return [(lost, changes) for lost, changes in found if changes][: n - 1]


@dataclass
class Spelling:
    """All pieces' bytes in one run, to spell whole columns of ids at once."""

    run: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, text: list[bytes]) -> Spelling:
        size = np.array([len(t) for t in text], dtype=np.int64)
        return cls(np.frombuffer(b"".join(text), dtype=np.uint8), np.cumsum(size) - size, size)

    def texts(self, ids: pa.ListArray) -> pa.Array:
        """The text of each list of ids, without the space put before it; null for null."""
        offsets = ids.offsets.to_numpy().astype(np.int64)
        flat = ids.values.to_numpy()[offsets[0] : offsets[-1]]
        size = self.size[flat]
        ends = np.cumsum(size)
        place = np.repeat(self.start[flat] - (ends - size), size) + np.arange(int(size.sum()))
        out = self.run[place]
        row_ends = np.concatenate([[0], ends])[offsets - offsets[0]]
        filled = np.flatnonzero(np.diff(row_ends))
        out = np.delete(out, row_ends[:-1][filled])
        taken = np.concatenate([[0], np.cumsum(np.diff(row_ends) > 0)])
        bounds = pa.py_buffer((row_ends - taken).astype(np.int64))
        valid = ids.is_valid().to_numpy(zero_copy_only=False)
        mask = pa.py_buffer(np.packbits(valid, bitorder="little"))
        held = pa.LargeStringArray.from_buffers(len(ids), bounds, pa.py_buffer(out), mask)
        return held.cast(pa.string())


CHANGE = pa.struct([("first", pa.int32()), ("dropped", pa.int32()), ("ids", pa.list_(pa.int32()))])
ALTERNATIVE = pa.struct([("score", pa.float64()), ("changes", pa.list_(CHANGE))])
ENCODED = (
    "ids array<int>, score double,"
    " alternatives array<struct<score: double,"
    " changes: array<struct<first: int, dropped: int, ids: array<int>>>>>"
)


def encode(documents: DataFrame, vocabulary: Vocabulary, n: int = 4) -> DataFrame:
    """(doc_id, text, ids, score, alternatives) of every row of `documents(doc_id, text)`."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    size_batches(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        for whole in batches:
            for batch in chunks(whole, "text", CHUNK):
                texts = batch.column(1)
                ids, offsets, scores, found = v.segments(texts, n)
                valid = texts.is_valid().to_numpy(zero_copy_only=False)
                others = [
                    [
                        {"score": s, "changes": [dict(zip(("first", "dropped", "ids"), c)) for c in x]}
                        for s, x in own
                    ]
                    for own in found
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        texts,
                        pa.ListArray.from_arrays(
                            pa.array(offsets, type=pa.int32()), pa.array(ids), mask=pa.array(~valid)
                        ),
                        pa.array(scores, mask=~valid),
                        pa.array(
                            [own if held else None for own, held in zip(others, valid)],
                            type=pa.list_(ALTERNATIVE),
                        ),
                    ],
                    names=["doc_id", "text", "ids", "score", "alternatives"],
                )

    return documents.select("doc_id", "text").mapInArrow(encoded, f"doc_id {kind}, text string, {ENCODED}")


def _spelled(batch: pa.RecordBatch, spelling: Spelling, table: list[bytes]) -> tuple[pa.Array, pa.Array]:
    """(text of the best, whether the alternatives give the same text), from ids, alternatives."""
    ids = batch.column(batch.schema.get_field_index("ids"))
    others = batch.column(batch.schema.get_field_index("alternatives")).to_pylist()
    flat, offsets, agree = ids.values.to_numpy(), ids.offsets.to_numpy(), []

    def joined(own) -> bytes:
        return b"".join(map(table.__getitem__, own))

    for first, more in zip(offsets.tolist(), others):
        agree.append(None if more is None else all(
            joined(flat[first + c["first"] : first + c["first"] + c["dropped"]].tolist())
            == joined(c["ids"])
            for m in more for c in m["changes"]
        ))
    return spelling.texts(ids), pa.array(agree, type=pa.bool_())


def _each_spelled(encoded: DataFrame, vocabulary: Vocabulary, keep: list[str], schema, finish) -> DataFrame:
    """The kept columns of `encoded`, and what `finish` makes of each batch and its spelling."""
    size_batches(encoded.sparkSession)
    sent = encoded.sparkSession.sparkContext.broadcast(vocabulary.text)

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling = Spelling.of(sent.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                own = [batch.column(batch.schema.get_field_index(k)) for k in keep]
                more = finish(batch, *_spelled(batch, spelling, sent.value))
                yield pa.RecordBatch.from_arrays([*own, *more.values()], names=[*keep, *more])

    return encoded.mapInArrow(spelled, schema)


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """`encoded` with `decoded`, the text that the ids spell."""
    schema = StructType([*encoded.schema.fields]).add("decoded", StringType())
    return _each_spelled(
        encoded, vocabulary, encoded.columns, schema, lambda batch, text, agree: {"decoded": text}
    )


def restored(encoded: DataFrame, vocabulary: Vocabulary, keep: list[str]) -> DataFrame:
    """The `keep` columns of `encoded` and `restored`: whether every segmentation spells the text.

    Texts and ids go to the workers and do not come back.
    """
    fields = [encoded.schema[k] for k in keep]

    def finish(batch: pa.RecordBatch, text: pa.Array, agree: pa.Array) -> dict[str, pa.Array]:
        told = batch.column(batch.schema.get_field_index("text")).cast(pa.string())
        missing = pc.and_(pc.is_null(told), pc.is_null(text))
        same = pc.and_(pc.fill_null(pc.equal(told, text), False), pc.fill_null(agree, False))
        return {"restored": pc.or_(missing, same)}

    schema = StructType(fields).add("restored", BooleanType())
    return _each_spelled(encoded, vocabulary, keep, schema, finish)

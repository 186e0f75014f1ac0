"""Near-duplicate documents by a chosen-path similarity join on shingle sets.

1. Every document is read once: the number of its distinct shingles, a key of the whole set, a
   sketch of `coordinates` minwise values and its places in `trees` independent random trees.
   In a tree a node picks coordinates by a hash of its path, `1 / threshold` of them on average; a
   document goes on to the child named by the picked coordinate and its value there. Two sets of
   similarity s share s / threshold children on average, so similar sets stay together and others
   part quickly.
2. Documents with equal sets are one class from here on.
3. Nodes of up to `node_rows` classes are compared exhaustively by their sketches. In a larger one
   every member is compared with a centre, the member of smallest id. What is connected by then, in
   whichever nodes and trees, is a family so far, and only members of different families need to be
   compared. A large node of one family is settled. Where up to `node_rows` members are not of the
   node's largest family, these are compared with all others, in blocks. Any other large node branches
   on, `deeper` levels at a time, and its children are treated in the same way. A node that still is
   large, with as many strangers, at the last level holds sets that agree in that many coordinates, and
   is handed on whole. Nothing is dropped. A task hands on what connects its similar pairs, never the
   pairs themselves. Connected classes are a family.
4. Links are confirmed on full sets inside families, as sparse intersections counted exactly. Small
   families are done in one piece. In a large one all members are first compared with a central
   member; those linked to it need no comparison with each other, as only components are asked
   for. The others are compared with everybody, in blocks dealt out over the cluster.
5. Confirmed links are joined into components.

A pair at the threshold is missed if it parts in all trees and no other links connect it: about one in
a thousand up to the first level, which is all that most pairs need. Pairs that meet in crowded nodes of
many families only, all the way down, part more often: some 0.4 % at level 5, 1.3 % at 7, 3 % at 9 and
6 % at 11 (a test measures it), unless such nodes branch `again` and again independently. Pairs above
the threshold are missed much more rarely.

Defined results: null and empty texts, and texts without words, have no shingles and link with
nothing. A text with fewer words than a shingle is one shingle of all its words. Rows repeating
an id are one document: their sets count as linked. A row with a null id counts as a copy or
link of nothing named: it gets the component of its set's class, if that has any id. Extra columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.graph import components, connecting
from ledgerlens.llm.text import BASE, and_end, chunks, mix, shingles
from ledgerlens.session import durable


@dataclass(frozen=True)
class Settings:
    words: int = 5  # of a shingle
    percent: int = 80  # least similarity
    coordinates: int = 128  # of a sketch
    trees: int = 20
    first_level: int = 3  # nodes above this level are not looked at
    deeper: int = 2  # levels that a large node branches at once
    again: int = 1  # independent branchings of a large node
    last_level: int = 11
    node_rows: int = 256  # largest node that is compared exhaustively
    margin: float = 0.12  # below the threshold, for similarities estimated from sketches
    block_rows: int = 128  # sets of a family that are compared in one piece
    pairs: int = 1 << 18  # similar pairs that a task holds at once


LEVEL_SEEDS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(BASE))


def linked(shared, first, second, percent: int):
    """Whether 100 * intersection >= percent * union, in whole numbers."""
    return 100 * shared >= percent * (first + second - shared)


# -- 1: one reading of the documents


def _distinct(owner: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each owner, in order; owners come in order."""
    shingle = shingle.copy()
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(owner)]):
        shingle[a:b].sort()
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])
    return owner[new], shingle[new]


def _sketches(owner, shingle, rows: int, coordinates: int) -> np.ndarray:
    """Minwise values, 16 bits each; rows without shingles hold zeros."""
    out = np.zeros((rows, coordinates), dtype=np.uint16)
    if not len(owner):
        return out
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    held = owner[first]
    factors = mix(np.arange(1, coordinates + 1, dtype=np.uint64)) | np.uint64(1)
    for k, factor in enumerate(factors):
        least = np.minimum.reduceat((shingle * factor) >> np.uint64(20), first)
        out[held, k] = mix(least) >> np.uint64(48)
    return out


def _gap(seed: np.ndarray, step: int, chances: np.ndarray) -> np.ndarray:
    """How many coordinates are passed over before the next one that is picked."""
    salt = np.uint64((step + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
    drawn = mix(seed + salt) >> np.uint64(32)
    return len(chances) - np.searchsorted(chances, drawn, side="right")


def _branch(
    row: np.ndarray, path: np.ndarray, sketch: np.ndarray, level: int, levels: int, s: Settings
) -> tuple[np.ndarray, np.ndarray]:
    """(row, path) of all nodes `levels` below, from (row, path) at `level`.

    A node picks every coordinate with the same chance, by draws that follow from its path alone; the
    draws are the gaps between picked ones.
    """
    rate = 100 / (s.percent * s.coordinates)
    # The chance, as a number of 32 bits, of passing over at least g coordinates, smallest first.
    chances = np.array([int((1 << 32) * (1 - rate) ** g) for g in range(s.coordinates, 0, -1)], dtype=np.uint64)
    for k in range(level, level + levels):
        rows, paths = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
        seed = mix(path ^ LEVEL_SEEDS[k])
        at = _gap(seed, 0, chances)
        step, who = 0, np.flatnonzero(at < s.coordinates)
        while len(who):
            value = sketch[row[who], at[who]].astype(np.uint64)
            rows.append(row[who])
            paths.append(mix(mix(seed[who] ^ at[who].astype(np.uint64)) + value * np.uint64(BASE)))
            step += 1
            at[who] += 1 + _gap(seed[who], step, chances)
            who = who[at[who] < s.coordinates]
        row, path = np.concatenate(rows), np.concatenate(paths)
    return row, path


def _first_nodes(held: np.ndarray, sketch: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(row, path) of the nodes at the first level that is looked at, in all trees."""
    seeds = mix(np.arange(1, s.trees + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))
    return _branch(np.repeat(held, s.trees), np.tile(seeds, len(held)), sketch, 0, s.first_level, s)


def _next_nodes(path: np.ndarray, sketch: np.ndarray, level: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(row, path) of the nodes below crowded ones, a path and a sketch for each row."""
    salts = mix(np.arange(1, s.again + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))
    every = np.tile(np.arange(len(path)), s.again)
    return _branch(every, mix(path[every] ^ np.repeat(salts, len(path))), sketch, level, s.deeper, s)


def _binary(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    width = values.shape[1] * values.itemsize
    held = pa.py_buffer(np.ascontiguousarray(values))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(values), [None, held]).cast(pa.binary())


def _read(batch: pa.RecordBatch, s: Settings) -> pa.RecordBatch:
    rows = batch.num_rows
    owner, shingle = _distinct(*shingles(batch.column(1), s.words))
    size = np.bincount(owner, minlength=rows)
    first, second = np.zeros(rows, dtype=np.uint64), np.zeros(rows, dtype=np.uint64)
    at = np.flatnonzero(size)
    if len(at):
        start = np.flatnonzero(np.diff(owner, prepend=-1))
        first[at] = np.add.reduceat(mix(shingle), start)
        second[at] = np.add.reduceat(mix(shingle ^ np.uint64(BASE)), start)
    sketch = _sketches(owner, shingle, rows, s.coordinates)
    row, path = _first_nodes(at, sketch, s)
    order = np.argsort(row, kind="stable")
    cuts = np.searchsorted(row[order], np.arange(rows + 1))
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0),
            pa.array(size, type=pa.int64()),
            pa.array(first.view(np.int64)),
            pa.array(second.view(np.int64)),
            _binary(sketch),
            _binary(sketch.astype(np.uint8)),
            pa.ListArray.from_arrays(
                pa.array(cuts, type=pa.int32()), pa.array(path[order].view(np.int64))
            ),
        ],
        names=["doc_id", "size", "first", "second", "sketch", "marks", "paths"],
    )


def _documents_read(documents: DataFrame, s: Settings) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                yield _read(batch, s)

    schema = (
        "doc_id long, size long, first long, second long,"
        " sketch binary, marks binary, paths array<long>"
    )
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(read, schema)


# -- 3: nodes and families


def _similar(marks: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    out = np.empty(len(a), dtype=bool)
    for k in range(0, len(a), 1 << 15):
        same = marks[a[k : k + (1 << 15)]] == marks[b[k : k + (1 << 15)]]
        out[k : k + (1 << 15)] = same.mean(axis=1) >= least
    return out


def _compare_nodes(nodes: DataFrame, s: Settings) -> DataFrame:
    """(u, v) connecting families with similar members in a node, from (path, id, family, marks)."""
    least = s.percent / 100 - s.margin

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, held, count = None, [], 0
        for part in and_end(batches):
            rows = part if rest is None else pd.concat([rest, part], ignore_index=True)
            if part is None:
                rows = rest
            if rows is None or not len(rows):
                continue
            path = rows["path"].to_numpy()
            whole = len(rows) if part is None else int(np.searchsorted(path, path[-1], side="left"))
            rest = rows.iloc[whole:].reset_index(drop=True)
            if not whole:
                continue
            path, family = path[:whole], rows["family"].to_numpy()[:whole]
            marks = np.frombuffer(b"".join(rows["marks"].iloc[:whole]), dtype=np.uint8)
            marks = marks.reshape(whole, s.coordinates)
            at = np.arange(whole)
            lag = 0
            while len(at):
                lag += 1
                at = at[at + lag < whole]
                at = at[path[at] == path[at + lag]]
                apart = at[family[at] != family[at + lag]]
                near = apart[_similar(marks, apart, apart + lag, least)]
                held.append((family[near], family[near + lag]))
                count += len(near)
                if count > s.pairs:
                    found = connecting(*map(np.concatenate, zip(*held)))
                    yield found
                    # What is already connected stays, so that later pairs do not repeat it.
                    held, count = [], 0
        if count:
            yield connecting(*map(np.concatenate, zip(*held)))

    return nodes.mapInPandas(compare, "u long, v long")


def _starred(large: DataFrame, s: Settings) -> DataFrame:
    """(u, v) from the members of large nodes that are similar to the node's centre, to the centre."""
    least = s.percent / 100 - s.margin

    def star(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            sketch, core = (
                np.frombuffer(b"".join(part[k]), dtype=np.uint8).reshape(len(part), s.coordinates)
                for k in ("marks", "core")
            )
            near = (sketch == core).mean(axis=1) >= least
            ends = part.loc[near, ["id", "centre"]].drop_duplicates()
            yield ends.rename(columns={"id": "u", "centre": "v"})

    chosen = large.select("id", "centre", "marks", "core").filter("id <> centre")
    return chosen.mapInPandas(star, "u long, v long")


def _branched(large: DataFrame, level: int, s: Settings) -> DataFrame:
    """The next nodes (path, id, family) of the members of large nodes (path, id, family, sketch)."""

    def branch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for at in range(0, len(part), 4096):
                rows = part.iloc[at : at + 4096]
                sketch = np.frombuffer(b"".join(rows["sketch"]), dtype=np.uint16)
                sketch = sketch.reshape(len(rows), s.coordinates)
                row, path = _next_nodes(rows["path"].to_numpy().view(np.uint64), sketch, level, s)
                ids, family = rows["id"].to_numpy()[row], rows["family"].to_numpy()[row]
                yield pd.DataFrame({"path": path.view(np.int64), "id": ids, "family": family})

    chosen = large.select("path", "id", "family", "sketch")
    return chosen.mapInPandas(branch, "path long, id long, family long")


def _families(classes: DataFrame, s: Settings) -> DataFrame:
    """(id, family) of classes that may have links; from (id, sketch, marks, paths)."""
    mixed = F.min("family") != F.max("family")

    def compared(rows: DataFrame) -> DataFrame:
        """What connects families in nodes (path, id, family)."""
        ready = rows.select("path", "id", "family").join(classes.select("id", "marks"), "id")
        ready = ready.select("path", "id", "family", "marks").repartition("path")
        return durable(_compare_nodes(ready.sortWithinPartitions("path", "id"), s), "similar")

    def opened(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The members of small and of large nodes that hold more than one family."""
        sizes = rows.groupBy("path").agg(
            F.count(F.lit(1)).alias("members"), F.min("family").alias("centre"), mixed.alias("mixed")
        )
        # Written first: few nodes are shared, and a join with a table can split hot nodes.
        open_nodes = durable(sizes.filter("mixed").drop("mixed"), "open")
        shared = durable(rows.join(open_nodes, "path"), "nodes")
        few = F.col("members") <= s.node_rows
        return shared.filter(few), shared.filter(~few)

    def strangers(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of large nodes: those with few strangers as blocks that hold all of them, and the others."""
        own = rows.groupBy("path", "family").agg(F.count(F.lit(1)).alias("n"))
        most = own.groupBy("path").agg(
            F.sum("n").alias("members"), F.max("n").alias("n"), F.max(F.struct("n", "family")).alias("top")
        )
        most = most.select("path", "members", (F.col("members") - F.col("n")).alias("odd"), "top.family")
        most = durable(most.filter("odd > 0").withColumnRenamed("family", "top"), "mixed")
        told = rows.select("path", "id", "family").join(most, "path")
        few = F.col("odd") <= s.node_rows
        blocks = F.ceil(F.col("members") / s.node_rows).cast("long")
        every = F.sequence(F.lit(0).cast("long"), blocks - 1)
        mine = F.array(F.pmod(F.xxhash64("id"), blocks))
        met = F.when(F.col("family") == F.col("top"), mine).otherwise(every)
        direct = told.filter(few).select("path", "id", "family", F.explode(met).alias("block"))
        direct = direct.select(F.xxhash64("path", "block").alias("path"), "id", "family")
        return direct, told.filter(~few).select("path", "id", "family")

    def named(found: DataFrame) -> DataFrame:
        return found.select(F.col("node").alias("id"), F.col("component").alias("family"))

    rows = classes.select(F.explode("paths").alias("path"), "id").withColumn("family", F.col("id"))
    small, large = opened(rows)
    edges = compared(small)
    if large.isEmpty():
        return named(components(edges))
    cores = classes.select(F.col("id").alias("centre"), F.col("marks").alias("core"))
    stars = _starred(large.join(classes.select("id", "marks"), "id").join(cores, "centre"), s)
    families = durable(named(components(edges.union(durable(stars.distinct(), "stars")))), "so_far")

    large = large.select("path", "id").join(families, "id", "left")
    large = durable(large.select("path", "id", F.coalesce("family", "id").alias("family")), "named")
    direct, going = strangers(large)
    between, level = [compared(direct)], s.first_level
    while not going.isEmpty():
        if level >= s.last_level:
            least = going.groupBy("path").agg(F.min("family").alias("v"))
            between.append(going.join(least, "path").select(F.col("family").alias("u"), "v"))
            break
        rows = durable(_branched(going.join(classes.select("id", "sketch"), "id"), level, s), "deeper")
        level += s.deeper
        small, large = opened(rows)
        direct, going = strangers(large)
        between += [compared(small), compared(direct)]
    # What connects families so far; their own members follow.
    joined = between[0]
    for e in between[1:]:
        joined = joined.union(e)
    joined = durable(named(components(joined)), "joined")
    others = joined.select(F.col("id").alias("family"), F.col("family").alias("whole"))
    moved = families.join(others, "family", "left").select("id", F.coalesce("whole", "family").alias("family"))
    return moved.union(joined.join(families.select("id"), "id", "left_anti"))


# -- 4: links confirmed on full sets


def _sets(documents: DataFrame, families: DataFrame, s: Settings) -> DataFrame:
    """(id, family, members, items) with the whole shingle set of each class in a family."""
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), "text")
    # One plan at every size: the texts move once, by id.
    rows = texts.join(families.hint("merge"), "id")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                owner, shingle = _distinct(*shingles(batch.column(1), s.words))
                cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
                items = pa.LargeListArray.from_arrays(
                    pa.array(cuts, type=pa.int64()), pa.array(shingle.view(np.int64))
                ).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), batch.column(3), items],
                    names=["id", "family", "members", "items"],
                )

    ordered = rows.select("id", "text", "family", "members").distinct()  # repeated rows: once
    return ordered.mapInArrow(build, "id long, family long, members long, items array<long>")


def _links(ids, items: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int):
    """Linked pairs between the sets of `left` and `right` (positions), counted exactly."""
    size = np.array([len(x) for x in items])
    owner = np.repeat(np.arange(len(items)), size)
    _, column, often = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    held = often[column] > 1  # an item of one set only meets nothing
    owner, column = owner[held], (np.cumsum(often > 1) - 1)[column[held]]
    width = max(1, min(1 << 13, int(column.max(initial=-1)) + 1))
    shared = np.zeros((len(left), len(right)), dtype=np.float32)
    place = np.full((2, len(items)), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for first in range(0, int(column.max(initial=-1)) + 1, width):
        a, b = np.searchsorted(column, [first, first + width])
        who, what = owner[a:b], column[a:b] - first
        rows = []
        for side, n in ((0, len(left)), (1, len(right))):
            m = np.zeros((n, width), dtype=np.float32)
            at = place[side, who]
            m[at[at >= 0], what[at >= 0]] = 1
            rows.append(m)
        shared += rows[0] @ rows[1].T
    hit = linked(shared.astype(np.int64), size[left][:, None], size[right][None, :], percent)
    hit &= (size[left] > 0)[:, None] & (ids[left][:, None] != ids[right][None, :])
    x, y = np.nonzero(hit)
    return ids[left][x], ids[right][y]


def _confirm(sets: DataFrame, s: Settings) -> DataFrame:
    """(u, v) that connect what is linked; sets: (id, family, members, items), written before."""
    schema = "u long, v long"

    def within(group: pd.DataFrame) -> pd.DataFrame:
        every = np.arange(len(group))
        items = [np.asarray(x, dtype=np.int64) for x in group["items"]]
        return connecting(*_links(group["id"].to_numpy(), items, every, every, s.percent))

    def between(group: pd.DataFrame) -> pd.DataFrame:
        left = np.flatnonzero(group["left"].to_numpy())
        right = np.flatnonzero(~group["left"].to_numpy())
        if not len(left):
            return pd.DataFrame({"u": [], "v": []}, dtype="int64")
        if not len(right):  # a block with itself
            right = left
        items = [np.asarray(x, dtype=np.int64) for x in group["items"]]
        return connecting(*_links(group["id"].to_numpy(), items, left, right, s.percent))

    small = sets.filter(F.col("members") <= s.block_rows)
    links = small.groupBy("family").applyInPandas(within, schema)
    large = sets.filter(F.col("members") > s.block_rows)
    if large.isEmpty():
        return links

    # Compare everybody with a central member of the family.
    centre = _centres(large)
    size = F.size("items")
    shared = F.size(F.array_intersect("items", "core"))
    near = durable(
        large.join(centre, "family").select(
            "id", "family", "centre", linked(shared, size, F.size("core"), s.percent).alias("near")
        ),
        "near",
    )
    star = near.filter("near AND id <> centre")
    star = star.select(F.col("id").alias("u"), F.col("centre").alias("v"))

    # Compare those that are not linked to it with everybody, block by block.
    parts = near.groupBy("family").agg(
        F.count_if("near").alias("n_near"), F.count_if(~F.col("near")).alias("n_far")
    )
    parts = parts.filter("n_far > 0").select(
        "family",
        *[F.ceil(F.col(f"n_{k}") / s.block_rows).cast("long").alias(f"b_{k}") for k in ("near", "far")],
    )
    rows = large.join(near.select("id", "near"), "id").join(parts, "family")
    far_block = F.pmod(F.xxhash64("id"), F.col("b_far"))
    near_block = F.pmod(F.xxhash64("id"), F.greatest("b_near", F.lit(1)))

    def pair(i: Column, j: Column, left: bool) -> Column:
        return F.struct(i.alias("i"), j.alias("j"), F.lit(left).alias("left"))

    # A far block i meets near blocks as (i, j), far blocks j >= i as (i, b_near + j).
    zero, b_near, b_far = F.lit(0).cast("long"), F.col("b_near"), F.col("b_far")
    all_far = F.sequence(zero, b_far - 1)
    to_near = F.when(
        b_near > 0, F.transform(F.sequence(zero, b_near - 1), lambda j: pair(far_block, j, True))
    ).otherwise(F.array().cast("array<struct<i: bigint, j: bigint, left: boolean>>"))
    as_left = F.transform(
        F.sequence(far_block, b_far - 1), lambda j: pair(far_block, b_near + j, True)
    )
    as_right = F.transform(
        F.filter(all_far, lambda i: i < far_block), lambda i: pair(i, b_near + far_block, False)
    )
    from_near = F.transform(all_far, lambda i: pair(i, near_block, False))
    meets = F.when(F.col("near"), from_near).otherwise(F.concat(to_near, as_left, as_right))
    dealt = rows.select("family", "id", "items", F.explode(meets).alias("m")).select(
        "family", "id", "items", "m.i", "m.j", "m.left"
    )
    crossed = dealt.groupBy("family", "i", "j").applyInPandas(between, schema)
    return links.union(star).union(crossed)


def _centres(large: DataFrame) -> DataFrame:
    """(family, centre, core): the member of each family that holds most of its common items.

    A few items of each set, chosen by hash alike in all sets, stand for it.
    """
    few = F.slice(F.array_sort("items"), 1, 24)
    marks = large.select("family", "id", F.explode(few).alias("item"))
    common = marks.groupBy("family", "item").agg(F.count(F.lit(1)).alias("held"))
    worth = marks.join(common, ["family", "item"]).groupBy("family", "id").agg(F.sum("held").alias("worth"))
    best = worth.groupBy("family").agg(F.max_by("id", F.struct("worth", -F.col("id"))).alias("centre"))
    core = large.select(F.col("id").alias("centre"), F.col("items").alias("core"))
    return best.join(core.dropDuplicates(["centre"]), "centre").select("family", "centre", "core")


# -- the operator


def near_duplicates(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of `documents(doc_id, text)`."""
    s = settings
    read = durable(_documents_read(documents, s), "read")
    key = ["size", "first", "second"]
    filled = read.filter("size > 0 AND doc_id IS NOT NULL")
    classes = durable(
        read.filter("size > 0").groupBy(*key).agg(F.min("doc_id").alias("id")), "classes"
    )
    # An id with several texts is one document: its classes are linked.
    twice = filled.select("doc_id", *key).distinct().groupBy("doc_id").count().filter("count > 1")
    same = (
        filled.join(twice.select("doc_id"), "doc_id", "left_semi").join(classes, key)
        .select(F.col("doc_id").alias("u"), F.col("id").alias("v"))
    )
    heads = filled.dropDuplicates([*key, "doc_id"]).join(
        classes.select(*key, F.col("id").alias("doc_id")), [*key, "doc_id"], "left_semi"
    )
    heads = durable(heads.select(F.col("doc_id").alias("id"), "sketch", "marks", "paths"), "heads")
    families = durable(_families(heads, s), "families")
    members = families.groupBy("family").agg(F.count(F.lit(1)).alias("members"))
    sets = durable(_sets(documents, families.join(members, "family"), s), "sets")
    links = _confirm(sets, s).union(same)
    found = components(links).select(F.col("node").alias("id"), "component")
    named = classes.join(found, "id", "left").select(
        *key, F.coalesce("component", "id").alias("component")
    )
    out = read.select("doc_id", *key).join(named, key, "left")
    component = F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        F.col("size").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
    )


def first_of_each(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of `documents` without those that a smaller id stands for.

    Rows with a null id stay, rows that repeat an id stay or go together.
    """
    found = near_duplicates(documents, settings).filter("NOT kept AND doc_id IS NOT NULL")
    return documents.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(
        *documents.columns
    )

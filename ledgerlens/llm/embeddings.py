"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

1. Rotations are learnt on a bounded sample (iterative quantisation: alternately the signs of the
   rotated vectors and the rotation that fits them best) after centring and principal components,
   so that the 64 bits of a code are balanced and near vectors differ in few of them. How many codes
   are needed, each with a rotation of its own, is measured there: pairs at the threshold are made
   from the sample's vectors, and codes are added until `least_recall` of these pairs meet. Vectors
   with a strong common direction, whose differences are large once it is taken away, get more codes.
2. Equal vectors of one label are one class from here on.
3. A code is cut into parts, one table each. Parts have 16 bits, or more where a label has more than
   2^15 classes, so that buckets do not grow with a label. Two classes meet in a table if their parts
   differ in at most one bit: each class goes to the buckets of its part with one bit blanked out.
   Buckets are kept within labels. A pair is missed only if all parts of all codes differ in two or
   more bits.
4. Every pair that meets is reranked with the original vectors, in double precision, once: at the
   first table where it meets. Buckets of more than `block_rows` classes are dealt out as pairs of
   blocks, so that no task holds an unbounded bucket and no pair is left out. Tasks hand on
   sums of links by class and what connects their linked pairs, never the pairs.
5. Linked classes are joined into components.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, vectors
with a null label or id, link with nothing: no links, their own component, kept (a null id: component
null, not kept). Vectors of different length are never linked. Rows that repeat an id are vectors of
their own and link like any others. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.graph import components, connecting
from ledgerlens.llm.sample import SLOTS
from ledgerlens.llm.text import and_end, mix
from ledgerlens.session import durable

BITS = 64  # of a code
LEAST_PART = 16  # bits of a table's part


@dataclass(frozen=True)
class Settings:
    cosine: float = 0.98
    sample_rows: int = 20_000  # bound of the sample that the rotation is learnt on
    rounds: int = 50  # of iterative quantisation
    least_recall: float = 0.98  # of pairs at the threshold, measured on the sample
    most_codes: int = 16  # where that recall is not reached
    block_rows: int = 256  # classes of a bucket that are compared in one piece
    pairs: int = 1 << 18  # pairs compared at once


@dataclass(frozen=True)
class Quantiser:
    """A mean, and for each code a projection to 64 values whose signs are its bits."""

    mean: np.ndarray
    axes: list[np.ndarray]

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """The codes of unit vectors, a row for each."""
        centred = vectors - self.mean
        bits = [np.packbits(centred @ a >= 0, axis=1, bitorder="little").view(np.uint64) for a in self.axes]
        return np.concatenate(bits, axis=1)


def rotation(vectors: np.ndarray, rounds: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection to 64 values) from unit vectors, by iterative quantisation from a random start."""
    rng = np.random.default_rng(seed)
    size = vectors.shape[1]
    mean = vectors.mean(axis=0) if len(vectors) else np.zeros(size)
    centred = vectors - mean
    _, axes = np.linalg.eigh(centred.T @ centred + 1e-9 * np.eye(size))
    axes = axes[:, ::-1][:, :BITS]
    if size < BITS:  # more bits than components: random directions beside them
        axes = np.hstack([axes, rng.normal(size=(size, BITS - size))])
    projected = centred @ axes
    turn, _ = np.linalg.qr(rng.normal(size=(BITS, BITS)))
    for _ in range(rounds if len(vectors) else 0):
        code = np.where(projected @ turn >= 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(projected.T @ code)
        turn = u @ v
    return mean, axes @ turn


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def parts(codes: np.ndarray, bits: int) -> np.ndarray:
    """The tables' parts of each row of codes; what is left of a code over is not used."""
    each = BITS // bits
    shifts = np.arange(each, dtype=np.uint64) * np.uint64(bits)
    cut = (codes[:, :, None] >> shifts) & np.uint64((1 << bits) - 1)
    return cut.reshape(len(codes), -1)


def meet(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In which tables the parts of x and y differ in at most one bit."""
    return np.bitwise_count(x ^ y) <= 1


def at_threshold(vectors: np.ndarray, cosine: float) -> np.ndarray:
    """For each unit vector another one at this cosine, in a random direction."""
    rng = np.random.default_rng(11)
    away = rng.normal(size=vectors.shape)
    away -= (away * vectors).sum(axis=1, keepdims=True) * vectors
    length = np.sqrt((away * away).sum(axis=1, keepdims=True))
    return cosine * vectors + np.sqrt(1 - cosine**2) * away / np.where(length > 0, length, 1)


def quantiser(vectors: np.ndarray, bits: int, s: Settings) -> Quantiser:
    """Learnt from unit vectors, with as many codes as pairs at the threshold need to meet.

    Recall is measured on every fourth vector, which the rotations have not seen.
    """
    kept = np.arange(len(vectors)) % 4 == 3
    seen, held = vectors[~kept], vectors[kept]
    mean, axes = rotation(seen, s.rounds)
    found = Quantiser(mean, [axes])
    others = at_threshold(held, s.cosine)
    met = np.zeros(len(held), dtype=bool)
    while len(held):
        last = Quantiser(mean, found.axes[-1:])
        met |= meet(parts(last.codes(held), bits), parts(last.codes(others), bits)).any(axis=1)
        if met.mean() >= s.least_recall or len(found.axes) >= s.most_codes:
            break
        found.axes.append(rotation(seen, s.rounds, seed=7 + len(found.axes))[1])
    return found


def fit(vectors: DataFrame, bits: int, s: Settings) -> dict[int, Quantiser]:
    """A quantiser for each vector length, from (cid, v): one task for a bounded sample."""
    share = min(SLOTS, int(SLOTS * s.sample_rows / max(1, vectors.count())))
    chosen = vectors.filter(F.pmod(F.xxhash64("v"), F.lit(SLOTS)) < share)

    def learn(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows = np.stack(sorted(group["v"].tolist(), key=lambda v: v.tobytes())).astype(np.float64)
        q = quantiser(unit(rows), bits, s)
        told = (key[0], q.mean.tobytes(), np.stack(q.axes).tobytes())
        return pd.DataFrame([told], columns=["n", "mean", "axes"])

    found = chosen.groupBy(F.size("v")).applyInPandas(learn, "n int, mean binary, axes binary")
    return {
        r["n"]: Quantiser(np.frombuffer(r["mean"]), list(np.frombuffer(r["axes"]).reshape(-1, r["n"], BITS)))
        for r in found.collect()
    }


def _part_bits(classes: DataFrame) -> int:
    """Bits of a part: buckets of a table outnumber the classes of the largest label."""
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    return min(BITS, max(LEAST_PART, int(most).bit_length() + 1))


def _coded(classes: DataFrame, models: dict, bits: int) -> DataFrame:
    """(cid, codes, keys): the buckets of each class, in order of table and blanked bit."""
    sent = classes.sparkSession.sparkContext.broadcast(models)
    place = np.arange(bits, dtype=np.uint64)
    blank = ~(np.uint64(1) << place)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for size, part in whole.groupby(whole["v"].map(len)):
                model = sent.value.get(size)
                if model is None:  # a length that the sample does not have
                    mean, axes = rotation(np.zeros((0, size)), 0)
                    model = Quantiser(mean, [axes])
                found = model.codes(unit(np.stack(part["v"].tolist()).astype(np.float64)))
                home = mix(part["home"].to_numpy().view(np.uint64) + np.uint64(size))
                keys = []
                for t, own in enumerate(parts(found, bits).T):
                    masked = mix(own[:, None] & blank[None, :])
                    named = masked ^ mix(np.uint64(t * bits) + place)
                    keys.append(mix(home[:, None] ^ mix(named)))
                keys = np.concatenate(keys, axis=1).view(np.int64)
                yield pd.DataFrame({
                    "cid": part["cid"].to_numpy(), "codes": [x.tobytes() for x in found], "keys": list(keys)
                })

    rows = classes.select("cid", F.xxhash64("label").alias("home"), "v")
    return rows.mapInPandas(code, "cid long, codes binary, keys array<long>")


def _first_meeting(x: np.ndarray, y: np.ndarray, place: np.ndarray, bits: int) -> np.ndarray:
    """Whether rows of parts x and y first meet at `place` (table, blanked bit)."""
    differ = np.bitwise_count(x ^ y)
    table = place // bits
    earlier = np.arange(x.shape[1])[None, :] < table[:, None]
    here = ~((differ <= 1) & earlier).any(axis=1)
    own = np.take_along_axis(differ, table[:, None], axis=1)[:, 0]
    return here & ((own != 0) | (place % bits == 0))


def _compared(buckets: DataFrame, bits: int, s: Settings) -> DataFrame:
    """Rows (what, a, b): links of a class (0, cid, number), connections (1, cid, cid)."""

    def flush(held: list) -> pd.DataFrame:
        u, v, nu, nv = map(np.concatenate, zip(*held))
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        number = np.zeros(len(ids), dtype=np.int64)
        np.add.at(number, at, np.concatenate([nv, nu]))
        joined = connecting(u, v)
        return pd.DataFrame({
            "what": np.concatenate([np.zeros(len(ids)), np.ones(len(joined))]).astype(np.int32),
            "a": np.concatenate([ids, joined["u"].to_numpy()]),
            "b": np.concatenate([number, joined["v"].to_numpy()]),
        })

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count, rest = [], 0, None
        for part in and_end(batches):
            if part is None:
                if rest is None or not len(rest):
                    continue
                rows, whole = rest, len(rest)
            else:
                rows = part
                if rest is not None and len(rest):
                    rows = pd.concat([rest, part], ignore_index=True)
                key = rows[["bucket", "i", "j"]].to_numpy()
                change = np.flatnonzero((key[1:] != key[:-1]).any(axis=1))
                whole = int(change[-1]) + 1 if len(change) else 0
            rest = rows.iloc[whole:].reset_index(drop=True)
            if not whole:
                continue
            rows = rows.iloc[:whole]
            bucket, first, second = (rows[k].to_numpy() for k in ("bucket", "i", "j"))
            place, told = rows["place"].to_numpy(), rows["codes"].tolist()
            # Vectors of a bucket are of one length, but those of a batch need not be.
            width = max(map(len, told))
            own = np.frombuffer(b"".join(c.ljust(width, b"\0") for c in told), dtype=np.uint64)
            code = parts(own.reshape(whole, -1), bits)
            cid, copies, block = (rows[k].to_numpy() for k in ("cid", "copies", "block"))
            vectors = rows["v"].tolist()
            at = np.arange(whole)
            lag = 0
            while len(at):
                lag += 1
                at = at[at + lag < whole]
                to = at + lag
                same = (bucket[at] == bucket[to]) & (first[at] == first[to])
                at = at[same & (second[at] == second[to])]
                to = at + lag
                both = (block[at] != block[to]) | (first[at] == second[at])
                both &= _first_meeting(code[at], code[to], place[at], bits)
                near = at[both]
                for k in range(0, len(near), 1 << 13):
                    x = near[k : k + (1 << 13)]
                    a, b = (np.stack([vectors[i] for i in z]).astype(float) for z in (x, x + lag))
                    hit = x[(unit(a) * unit(b)).sum(axis=1) >= s.cosine]
                    if len(hit):
                        held.append((cid[hit], cid[hit + lag], copies[hit], copies[hit + lag]))
                        count += len(hit)
                if count > s.pairs:
                    yield flush(held)
                    held, count = [], 0
        if count:
            yield flush(held)

    return buckets.mapInPandas(compare, "what int, a long, b long")


def near_duplicates(embeddings: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, label, embedding)."""
    s = settings
    rows = embeddings.select(
        F.col("vec_id").cast("long"), "label", F.col("embedding").alias("v")
    )
    infinite = F.lit(float("inf"))
    real = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    some = F.exists("v", lambda x: x != 0)
    usable = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
        & (F.size("v") > 0) & real & some
    )
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    classes = (
        rows.filter("usable").groupBy("label", "v")
        .agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .withColumn("cid", F.monotonically_increasing_id())
    )
    classes = durable(classes, "classes")
    bits = _part_bits(classes)
    coded = durable(_coded(classes, fit(classes.select("cid", "v"), bits, s), bits), "codes")

    keys = coded.select("cid", "codes", F.posexplode("keys").alias("place", "bucket"))
    sizes = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    shared = keys.join(sizes, "bucket")
    blocks = F.ceil(F.col("members") / s.block_rows).cast("long")
    shared = shared.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cid"), "blocks"))
    # Block b of a bucket meets every other block, and itself, once.
    mates = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda k: F.struct(F.least(k, "block").alias("i"), F.greatest(k, "block").alias("j")),
    )
    dealt = shared.select("cid", "codes", "place", "bucket", "block", F.explode(mates).alias("m"))
    dealt = dealt.select("cid", "codes", "place", "bucket", "block", "m.i", "m.j")
    dealt = dealt.join(classes.select("cid", "v", "copies"), "cid")
    ready = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "cid")
    found = durable(_compared(ready, bits, s), "compared")

    links = found.filter("what = 0").groupBy(F.col("a").alias("cid")).agg(F.sum("b").alias("others"))
    graph = components(found.filter("what = 1").select(F.col("a").alias("u"), F.col("b").alias("v")))
    graph = graph.select(F.col("node").alias("cid"), "component")
    named = (
        classes.join(links, "cid", "left").join(graph, "cid", "left")
        .withColumn("component", F.coalesce("component", "cid"))
    )
    named = durable(named.select("label", "v", "first", "copies", "others", "component"), "named")
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    named = named.join(least, "component").select(
        "label", "v", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"), "least"
    )
    joined = rows.filter("usable").join(named, ["label", "v"]).select("vec_id", "links", "least")
    alone = rows.filter(~F.col("usable")).select(
        "vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("least")
    )
    return joined.union(alone).select(
        "vec_id",
        F.col("links").alias("n_links"),
        F.col("least").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("least"), F.lit(False)).alias("kept"),
    )

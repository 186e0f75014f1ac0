"""Term use of sources against their language: hash-consed segment trees over term ids.

1. Every document is read once: occurrences of each term, and whether the document holds it. Sums by
   (language, source, term) are made before the shuffle. A language keeps the terms that enough of its
   documents hold and numbers them by their order.
2. The probability of a term in a group of documents is a whole number, smoothed and scaled, so all
   arithmetic is exact.
3. Sources of a language are compared in pairs, by the sum over all kept terms of the difference of
   their probabilities. The counts of a source are the leaves of a segment tree over term ids. Trees are
   cut into segments of `segment` ids, dealt out over the cluster, where nodes are hash-consed: equal
   subtrees, wherever they lie and whichever source they belong to, are one node. Two trees are
   walked at the same time from their roots down; a pair of nodes that has been met is not walked
   again but counted, so each distinct pair of nodes of two sources is priced once, however often it
   occurs. Long runs of terms that neither source uses are one node pair.
4. The terms that a source uses more than its language come from the same counts, ranked by their
   difference.

Sources meet in blocks of `block` sources, so no task holds more than two blocks of sources of one
segment, whatever their number or size. The number of rows of part `pair` grows with the square
of a language's sources, as is asked for; their work grows with distinct nodes.

Defined results: a null text, language or source is the empty string, which is a language or source like
any other. A group without terms takes part with counts of zero. Without kept terms, pairs have
value 0 and there are no terms. Repeated rows are documents of their own. Ties in value go by
UTF-8 order of the item. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.text import chunks
from ledgerlens.session import durable

NOT_LETTERS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Settings:
    least_documents: int = 30  # of a language that hold a kept term
    most_terms: int = 50  # ranks of part `term`
    smooth: int = 5
    segment: int = 1 << 12  # term ids of a tree segment; a power of two
    block: int = 64  # sources that are compared in one piece with as many others


SCALE = 1_000_000_000


# -- 1: counts


def _counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, source, term, n, docs) of a batch of (lang, source, text)."""
    # Rows of one (lang, source) are one group.
    langs, sources = (batch.column(k).dictionary_encode() for k in (0, 1))
    width = max(1, len(sources.dictionary))
    group = langs.indices.to_numpy().astype(np.int64) * width + sources.indices.to_numpy()
    lists = pc.split_pattern_regex(pc.ascii_lower(batch.column(2)), NOT_LETTERS)
    flat = lists.flatten()
    owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    real = pc.not_equal(flat, "")
    owner = owner[real.to_numpy(zero_copy_only=False)]
    terms = flat.filter(real).dictionary_encode()
    code, many = terms.indices.to_numpy().astype(np.int64), max(1, len(terms.dictionary))
    held, often = np.unique(owner * many + code, return_counts=True)
    key, place = np.unique(group[held // many] * many + held % many, return_inverse=True)
    n, docs = np.zeros(len(key), dtype=np.int64), np.bincount(place, minlength=len(key))
    np.add.at(n, place, often)
    return pa.RecordBatch.from_arrays(
        [
            langs.dictionary.take(pa.array(key // many // width)),
            sources.dictionary.take(pa.array(key // many % width)),
            terms.dictionary.take(pa.array(key % many)),
            pa.array(n),
            pa.array(docs.astype(np.int64)),
        ],
        names=["lang", "source", "term", "n", "docs"],
    )


def term_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                yield _counts(batch)

    rows = documents.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# -- 2: probabilities

# 1 + floor(SCALE * (n + smooth) / total) in whole numbers; total is N + smooth * V.
SCALED = f"1 + ({SCALE} * CAST(n + {{smooth}} AS DECIMAL(20, 0))) div CAST(total AS DECIMAL(20, 0))"


def _scaled(n: np.ndarray, total: np.ndarray, s: Settings) -> np.ndarray:
    """The same for arrays, by long division: no step leaves 64 bits while total is below 9e15."""
    rest, whole = n + s.smooth, np.zeros(len(n), dtype=np.int64)
    whole, rest = rest // total, rest % total
    for _ in range(3):  # SCALE is 1000 ** 3
        rest = rest * 1000
        whole, rest = whole * 1000 + rest // total, rest % total
    return 1 + whole


# -- 3: trees


def _consed(leaves: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(counts of the leaf nodes, children of the nodes of each level from the leaves up, roots).

    `leaves` has a row for each tree and a power of two of columns. Nodes of a level are numbered
    over all trees, equal subtrees alike.
    """
    counts, ids = np.unique(leaves, return_inverse=True)
    ids = ids.reshape(leaves.shape)
    levels = []
    while ids.shape[1] > 1:
        pair = ids[:, 0::2] * (int(ids.max(initial=0)) + 1) + ids[:, 1::2]
        node, at = np.unique(pair, return_inverse=True)
        width = int(ids.max(initial=0)) + 1
        levels.append(np.stack([node // width, node % width], axis=1))
        ids = at.reshape(pair.shape)
    return counts, levels, ids[:, 0]


def _walked(
    first: int, others: np.ndarray, totals: np.ndarray, tree: tuple[np.ndarray, list, np.ndarray], s: Settings
) -> np.ndarray:
    """The divergence of one source's tree from those of others, inside a segment."""
    counts, levels, roots = tree
    of = np.arange(len(others))
    a, b = np.full(len(others), roots[first]), roots[others]
    often = np.ones(len(others), dtype=np.int64)
    for children in [*levels[::-1], None]:
        # Equal nodes under equal totals are priced alike: they differ by nothing.
        differs = (a != b) | (totals[others[of]] != totals[first])
        of, a, b, often = of[differs], a[differs], b[differs], often[differs]
        if children is None:
            break
        of, often = np.concatenate([of, of]), np.concatenate([often, often])
        a = np.concatenate([children[a, 0], children[a, 1]])
        b = np.concatenate([children[b, 0], children[b, 1]])
        # Met before: one node pair, with the number of its places.
        width = max(int(a.max(initial=0)), int(b.max(initial=0))) + 1
        key, at = np.unique((of * width + a) * width + b, return_inverse=True)
        summed = np.zeros(len(key), dtype=np.int64)
        np.add.at(summed, at, often)
        of, a, b, often = key // width // width, key // width % width, key % width, summed
    out = np.zeros(len(others), dtype=np.int64)
    if len(of):
        real = (counts[a] >= 0) & (counts[b] >= 0)  # both are terms, not what fills the segment up
        of, a, b, often = of[real], a[real], b[real], often[real]
        mine = _scaled(counts[a], np.full(len(of), totals[first]), s)
        np.add.at(out, of, often * np.abs(mine - _scaled(counts[b], totals[others[of]], s)))
    return out


def _segment_divergence(group: pd.DataFrame, s: Settings) -> pd.DataFrame:
    """(lang, source, item, value) for the pairs of a segment's sources.

    `group` has a row (source, total, of, place, n, width) for every count and, with place null, for
    every source; `of` tells blocks apart.
    """
    sources = group[group["place"].isna()].sort_values(["of", "source"], ignore_index=True)
    number = pd.Series(np.arange(len(sources)), index=pd.MultiIndex.from_frame(sources[["of", "source"]]))
    held = group[group["place"].notna()]
    width = int(group["width"].iloc[0])
    leaves = np.full((len(sources), 1 << max(0, width - 1).bit_length()), -1, dtype=np.int64)
    leaves[:, :width] = 0
    row = number.loc[pd.MultiIndex.from_frame(held[["of", "source"]])].to_numpy() if len(held) else []
    leaves[row, held["place"].astype("int64").to_numpy()] = held["n"].astype("int64").to_numpy()
    tree, totals = _consed(leaves), sources["total"].to_numpy()
    of, names = sources["of"].to_numpy(), sources["source"].tolist()
    one_block = group["i"].iloc[0] == group["j"].iloc[0]
    pairs, values = [], [np.zeros(0, dtype=np.int64)]
    for first in range(len(sources)):
        others = np.arange(first + 1, len(sources))
        others = others if one_block else others[of[others] != of[first]]
        pairs += [(names[first], names[k]) for k in others.tolist()]
        values.append(_walked(first, others, totals, tree, s))
    return pd.DataFrame({
        "lang": pd.Series([group["lang"].iloc[0]] * len(pairs), dtype=object),
        "source": pd.Series([a for a, _ in pairs], dtype=object),
        "item": pd.Series([b for _, b in pairs], dtype=object),
        "value": np.concatenate(values),
    })


def _pairs(kept: DataFrame, groups: DataFrame, segments: DataFrame, s: Settings) -> DataFrame:
    """(lang, source, item, value) of each two sources of a language, once.

    kept: (lang, source, n, segment, place); groups: (lang, source, total, own, blocks);
    segments: (lang, segment, width).
    """
    schema = "lang string, source string, item string, value long"
    every = groups.join(segments, "lang").withColumns(
        {"place": F.lit(None).cast("long"), "n": F.lit(None).cast("long")}
    )
    counts = kept.join(groups, ["lang", "source"]).join(segments, ["lang", "segment"])
    columns = ["lang", "segment", "width", "source", "total", "own", "blocks", "place", "n"]
    rows = every.select(columns).unionByName(counts.select(columns))
    # Blocks i <= j meet once: a row goes to all pairs that hold its own block.
    mine = F.col("own")
    met = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda k: F.struct(F.least(mine, k).alias("i"), F.greatest(mine, k).alias("j")),
    )
    dealt = rows.select("*", F.inline(met)).withColumnRenamed("own", "of")
    done = dealt.groupBy("lang", "segment", "i", "j").applyInPandas(
        lambda group: _segment_divergence(group, s), schema
    )
    return done.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


# -- the operator


def audit(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(lang, source, part, item, value, rank) over `documents(lang, source, text)`."""
    s = settings
    counts = durable(term_counts(documents), "terms")
    named = documents.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")])
    groups = named.distinct()

    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    terms = terms.filter(F.col("docs") >= s.least_documents)
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_all"))
    # Terms are dealt to segments by hash and numbered inside them, so no task sorts a language.
    many = F.ceil(2 * F.col("v") / s.segment).cast("long")
    terms = terms.join(langs, "lang").withColumn("segment", F.pmod(F.xxhash64("term"), many))
    terms = terms.repartition("lang", "segment")  # not by language alone, as the join may leave it
    inside = Window.partitionBy("lang", "segment").orderBy("term")
    terms = terms.withColumn("place", (F.row_number().over(inside) - 1).cast("long"))
    terms = durable(
        terms.select(
            "lang", "term", "segment", "place", "lang_n",
            (F.col("lang_all") + s.smooth * F.col("v")).alias("lang_total"), "v",
        ),
        "kept",
    )
    kept = durable(counts.drop("docs").join(terms, ["lang", "term"]), "counts")

    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("held"))
    sizes = terms.groupBy("lang").agg(F.max("v").alias("v"))
    blocks = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / s.block).cast("long").alias("blocks"))
    groups = durable(
        groups.join(sums, ["lang", "source"], "left").join(sizes, "lang", "left").join(blocks, "lang").select(
            "lang",
            "source",
            (F.coalesce("held", F.lit(0)) + s.smooth * F.coalesce("v", F.lit(0))).alias("total"),
            F.pmod(F.xxhash64("source"), F.col("blocks")).alias("own"),
            "blocks",
        ),
        "groups",
    )
    segments = terms.groupBy("lang", "segment").agg((F.max("place") + 1).alias("width"))
    pairs = durable(_pairs(kept.select("lang", "source", "n", "segment", "place"), groups, segments, s), "pairs")

    # Every two sources of a language in both directions, also where no term is kept.
    other = groups.select("lang", F.col("source").alias("item"))
    every = groups.select("lang", "source").join(other, "lang").filter("source <> item")
    both = pairs.union(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    priced = every.join(both, ["lang", "source", "item"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value")
    )

    scaled = F.expr(SCALED.format(smooth=s.smooth))
    used = kept.join(groups.select("lang", "source", "total"), ["lang", "source"]).withColumn("p", scaled)
    used = used.withColumns({"n": F.col("lang_n"), "total": F.col("lang_total")}).withColumn("q", scaled)
    used = used.filter("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).alias("rank")
    ranked = priced.select("*", rank)
    return ranked.union(used.select("*", rank).filter(F.col("rank") <= s.most_terms))

"""Spelling variants: words one edit apart, found by asymmetric q-chunks, and the form each stands for.

A word contributes disjoint chunks, the other word its grams at all places where such a chunk can come
to lie. One inserted, deleted or replaced character touches one of a word's two halves; the other
half is preserved, in its place before the edit and at most one place off behind it. A half by
itself is shared by thousands of words, so the half that holds the edit is cut once more in the same
way: of its two pieces one is preserved as well. A key is therefore a word's length, the number of the
piece that is left out, and all that surrounds it. Words join on keys:

* of two words of equal length both lack the same piece (a replaced character);
* the shorter of two words offers grams as if a character of the left-out piece were missing, so what
  lies behind moves by one (an inserted or deleted character).

Joined pairs are verified by their edit distance. A word gives 4 keys as the longer one and 4 as the
shorter one, whatever its length, and a key is shared by words that differ in one piece only.

A word's form is its near word of largest count, if that is at least `ratio` times its own; ties go to the
smallest in code-point order. Counts grow by `ratio` with every step, so chains of forms end; roots
are found by pointer doubling, in as many rounds as the logarithm of the longest chain.

DataFrame functions only. Counts are summed before the shuffle, the joins are on 64-bit keys that
adaptive execution splits where they are hot, and nothing is gathered by word but counts and minima.

Defined results: null texts have no runs and null words do not count; a null id is written as an empty
one by the caller. Words shorter than `SHORTEST` characters have no four pieces and are near
nothing. Repeated rows of `words` are summed. An empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import durable

LETTERS = "A-Za-zÀ-ÿ"
SHORTEST = 4


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def runs(documents: DataFrame, least: int = 1) -> DataFrame:
    """(doc_id, run): the maximal runs of at least `least` letters in `documents(doc_id, text)`."""
    pattern = F.lit(f"[{LETTERS}]{{{least},}}")
    found = F.regexp_extract_all("text", pattern, F.lit(0))
    return documents.select("doc_id", F.explode(found).alias("run")).withColumn(
        "run", ascii_lower(F.col("run"))
    )


def counted(words: DataFrame, least_length: int = 7, least: int = 2) -> DataFrame:
    """(word, n) of the words with enough characters and occurrences, from rows of `words(word)`."""
    long_enough = words.select("word").filter(F.length("word") >= least_length)
    return long_enough.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def _keys(missing: int) -> list[Column]:
    """What surrounds each of the four pieces of a word that lacks `missing` characters of one."""
    size = F.length("word") + missing
    half = F.floor(size / 2)
    cuts = [F.lit(0), F.floor(half / 2), half, half + F.floor((size - half) / 2), size]
    out = []
    for piece in range(4):
        start, end = cuts[piece], cuts[piece + 1] - missing
        head = F.substr("word", F.lit(1), start.cast("int"))
        tail = F.substr("word", (end + 1).cast("int"))
        out.append(F.xxhash64(F.lit(piece), size, head, tail))
    return out


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every pair of words one edit apart once, from distinct `words(word, n)`."""
    words = words.filter(F.length("word") >= SHORTEST)
    whole = words.select(
        F.col("word").alias("a"), F.col("n").alias("a_n"), F.explode(F.array(*_keys(0))).alias("key")
    )
    offers = F.array(
        *[F.struct(key.alias("key"), F.lit(d == 1).alias("shorter")) for d in (0, 1) for key in _keys(d)]
    )
    grams = words.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.inline(offers))
    pairs = whole.join(grams, "key").filter(F.col("shorter") | (F.col("a") < F.col("b")))
    near = pairs.filter(F.levenshtein("a", "b", 1) == 1)
    # A deleted character of a run that crosses a cut is found on both sides of it.
    return near.select("a", "a_n", "b", "b_n").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every row of `forms(word, form)`."""
    state = durable(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = durable(
            state.join(further, "root", "left").select(
                "word", F.coalesce("further", "root").alias("root"), F.isnotnull("further").alias("moved")
            ),
            "roots",
        )
        state = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return state


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of `words(word, n)`."""
    words = words.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"))
    words = durable(words, "words")
    pairs = near_pairs(words)
    both = F.array(
        F.struct(F.col("a").alias("word"), (-F.col("b_n")).alias("less"), F.col("b").alias("near")),
        F.struct(F.col("b").alias("word"), (-F.col("a_n")).alias("less"), F.col("a").alias("near")),
    )
    best = (
        pairs.select(F.inline(both))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct("less", "near")).alias("best"))
    )
    most = -F.col("best.less")
    is_form = most >= ratio * F.col("n")
    found = words.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"),
        F.when(is_form, most).alias("form_n"),
    )
    found = durable(found, "forms_of_words")
    roots = _roots(found.filter("form IS NOT NULL"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )

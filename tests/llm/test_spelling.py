import random
from collections import Counter

from odd import strange

from ledgerlens.llm import spelling


def near(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced character makes b of a."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def brute(counts: dict[str, int], ratio: int) -> dict[str, tuple]:
    form = {}
    many = {}
    for w, n in counts.items():
        others = [v for v in counts if near(w, v)]
        many[w] = len(others)
        best = min(others, key=lambda v: (-counts[v], v.encode()), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, many[w], counts[form[w]] if form[w] else None)
    return out


def found(spark, counts, ratio=10):
    rows = spark.createDataFrame(sorted(counts.items()), "word string, n long")
    got = spelling.variants(rows, ratio).collect()
    assert len(got) == len({r["word"] for r in got})
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got}


def test_near_words_and_forms_equal_brute_force(spark):
    rng = random.Random(11)
    # Few letters, so that runs of equal ones cross the cuts between the pieces.
    counts = {}
    for size in (4, 5, 6, 7, 8, 9, 12):
        for _ in range(60):
            counts["".join(rng.choice("aaabé") for _ in range(size))] = rng.choice([1, 2, 2, 10, 20, 100, 300])
    word = "thewholeword"
    for k in range(len(word)):
        counts[word[:k] + "x" + word[k + 1 :]] = 10 ** (k % 3 + 1)
        counts[word[:k] + word[k:].replace(word[k], "", 1)] = 3
    counts[word] = 1000
    want = brute(counts, 10)
    assert found(spark, counts) == want
    assert any(form and want[form][0] for form, *_ in want.values())  # a chain of two steps


def test_many_words_on_one_piece(spark):
    """A third of all words share their longest pieces with each other."""
    counts = {f"commonbeginning{chr(97 + i)}{chr(97 + j)}": i + 1 for i in range(26) for j in range(26)}
    assert found(spark, counts, 2) == brute(counts, 2)


def test_runs_keep_other_letters_and_join_with_nothing_short(spark):
    text = "Straße ÀÉX×Y a1b ÿÿ ABCdefg\U0001f600hij"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = sorted(r["run"] for r in spelling.runs(rows).collect())
    # Only A-Z are lowered; the multiplication sign lies inside the range of letters.
    assert got == sorted(["straße", "ÀÉx×y", "a", "b", "ÿÿ", "abcdefg", "hij"])
    assert sorted(r["run"] for r in spelling.runs(rows, 6).collect()) == ["abcdefg", "straße"]
    assert found(spark, {"abc": 5, "abd": 50}) == {
        "abc": (None, "abc", 5, 0, None), "abd": (None, "abd", 50, 0, None)
    }


def test_strange_rows(spark):
    docs = strange(spark)
    words = spelling.counted(spelling.runs(docs, 4).withColumnRenamed("run", "word"), 4, 2)
    expected = Counter()
    for r in docs.select("text").collect():
        expected.update(w for w in "".join(c if c.isalpha() else " " for c in (r["text"] or "")).lower().split())
    got = {r["word"]: r["n"] for r in spelling.variants(words).collect()}
    assert got == {w: n for w, n in expected.items() if len(w) >= 4 and n >= 2}
    empty = spark.createDataFrame([], "word string, n long, form string")
    assert spelling.variants(empty).collect() == []
    twice = spark.createDataFrame([("wordy", 2, "x"), ("wordy", 3, "x"), (None, 9, "x")], empty.schema)
    assert [tuple(r) for r in spelling.variants(twice).collect()] == [("wordy", None, "wordy", 5, 0, None)]

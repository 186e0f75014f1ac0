import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from odd import documents, strange

from ledgerlens.llm import divergence
from ledgerlens.llm.divergence import Settings


def brute(rows, s: Settings) -> list[tuple]:
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        terms = ["".join(c.lower() if c.isascii() else c for c in t) for t in terms]
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= s.least_documents)
        sources = sorted(g[1] for g in groups if g[0] == lang)

        def scaled(own: Counter) -> dict[str, int]:
            total = sum(own[t] for t in kept) + s.smooth * len(kept)
            return {t: 1 + 10**9 * (own[t] + s.smooth) // total for t in kept}

        q = scaled(sum((counts[lang, x] for x in sources), Counter()))
        p = {x: scaled(counts[lang, x]) for x in sources}
        for x in sources:
            pairs = [(-sum(abs(p[x][t] - p[y][t]) for t in kept), y.encode(), y) for y in sources if y != x]
            out += [(lang, x, "pair", y, -v, k + 1) for k, (v, _, y) in enumerate(sorted(pairs))]
            over = [(q[t] - p[x][t], t.encode(), t) for t in kept if counts[lang, x][t] and p[x][t] > q[t]]
            out += [(lang, x, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(sorted(over)[: s.most_terms])]
    return sorted(out)


def audited(docs, s: Settings) -> list[tuple]:
    return sorted(tuple(r) for r in divergence.audit(docs, s).collect())


@pytest.mark.parametrize("s", [
    Settings(least_documents=3),
    Settings(least_documents=1, most_terms=4, segment=4, block=2),  # many segments and blocks
    Settings(least_documents=10_000),  # no term is kept
], ids=["few terms", "small pieces", "none kept"])
def test_random_documents_equal_brute_force(spark, s):
    rng = random.Random(13)
    words = ["und", "THE", "straße", "Ñu", "x1y", "rare", *[f"w{chr(97 + k)}" for k in range(26)]]
    rows = []
    for k in range(250):
        lang, source = rng.choice(["de", "de", "en", None]), rng.choice(["a", "a", "a", "b", "c", "é", "d", None])
        many = rng.choice([0, 1, 5, 30])
        own = words[:6] if source == "a" else words
        text = None if k % 17 == 0 else " ".join(rng.choice(own) for _ in range(many))
        rows.append((k, text, lang, source))
    rows += rows[:9]
    rows += [(999, "und " * 5000, "de", "a"), (998, "", "fr", "lonely"), (997, None, "de", "silent")]
    got = audited(documents(spark, rows), s)
    assert got == brute([r[1:] for r in rows], s)


def test_equal_node_pairs_are_priced_once():
    """Two trees of many leaves with few distinct subtrees have few distinct nodes."""
    rng = np.random.default_rng(5)
    leaves = np.zeros((3, 4096), dtype=np.int64)
    leaves[0, 7], leaves[1, ::2] = 9, 4
    leaves[2] = rng.integers(0, 3, 4096)
    counts, levels, roots = divergence._consed(leaves)
    assert len(levels) == 12 and len(set(roots.tolist())) == 3
    first_two = divergence._consed(leaves[:2])[1]
    assert sum(len(level) for level in first_two) == 3 * 11 + 2  # instead of 2 * 4095
    totals = leaves.sum(axis=1) + 5 * 4096
    s = Settings()
    got = divergence._walked(0, np.array([1, 2]), totals, (counts, levels, roots), s)
    p = [divergence._scaled(row, np.full(4096, t), s) for row, t in zip(leaves, totals)]
    assert got.tolist() == [int(np.abs(p[0] - p[k]).sum()) for k in (1, 2)]


def test_probabilities_of_large_counts_are_exact(spark):
    rng = random.Random(1)
    rows = [(n, n + rng.randrange(1, 10**e)) for e in (1, 6, 12, 15) for n in [rng.randrange(10**e) for _ in range(200)]]
    want = [1 + 10**9 * (n + 5) // total for n, total in rows if total > n + 5]
    rows = [(n, t) for n, t in rows if t > n + 5]
    n, total = (np.array(x, dtype=np.int64) for x in zip(*rows))
    assert divergence._scaled(n, total, Settings()).tolist() == want
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, n long, total long")
    got = frame.selectExpr("k", divergence.SCALED.format(smooth=5) + " AS p").collect()
    assert [r["p"] for r in sorted(got)] == want


def test_strange_rows(spark):
    docs = strange(spark)
    s = Settings(least_documents=1)
    assert audited(docs, s) == brute([(r["text"], r["lang"], r["source"]) for r in docs.collect()], s)
    assert audited(docs.limit(0), s) == []

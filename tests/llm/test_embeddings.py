import math

import numpy as np
from pyspark.sql import types as T

from ledgerlens.llm import embeddings as em
from ledgerlens.llm import queries

FOLDER = "/root/testdata/sf0.01"
SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()),
    *[T.StructField(n, T.StringType()) for n in ("v", "cid", "first", "copies", "bucket", "usable")],
])


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 6) for r in rows], SCHEMA)


def usable(v, label, i):
    return (i is not None and label is not None and v is not None and len(v) > 0
            and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v))


def brute(rows):
    """(vec_id, links, component) of each row."""
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], la) for i, v, la in rows]
    good = [k for k, (i, v, la) in enumerate(rows) if usable(v, la, i)]
    links, parent = dict.fromkeys(range(len(rows)), 0), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for group in {(rows[k][2], len(rows[k][1])) for k in good}:
        own = [k for k in good if (rows[k][2], len(rows[k][1])) == group]
        m = np.array([rows[k][1] for k in own], dtype=np.float64)
        m /= np.sqrt((m * m).sum(axis=1, keepdims=True))
        for x, y in zip(*np.nonzero(np.triu(m @ m.T >= 0.98, 1))):
            a, b = own[x], own[y]
            links[a] += 1
            links[b] += 1
            parent[find(a)] = find(b)
    least = {}
    for k in good:
        r = find(k)
        least[r] = min(least.get(r, rows[k][0]), rows[k][0])
    return [(rows[k][0], links[k], least[find(k)] if k in set(good) else rows[k][0]) for k in range(len(rows))]


def got(df):
    rows = df.collect()
    for r in rows:
        assert r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"])
    return sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in rows)


def plain(rows):
    return sorted((str(i), n, str(c)) for i, n, c in rows)


def test_registered_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    want, found = plain(brute([tuple(r) for r in rows])), got(queries.op10_embedding_dedup(spark, FOLDER))
    assert sum(n for _, n, _ in found) >= 0.97 * sum(n for _, n, _ in want)
    assert sum(a != b for a, b in zip(want, found)) <= 0.01 * len(want)


def families(rng, count, members, near):
    rows = []
    for f in range(count):
        base = rng.normal(size=64)
        for _ in range(members):
            rows.append((len(rows) + 1000 * f, (base + near * rng.normal(size=64)).tolist(), f % 3))
    return rows


def test_recall_and_exactness_on_families(spark):
    rng = np.random.default_rng(9)
    for near, settings in ((0.1, em.Settings()), (0.05, em.Settings(block_rows=5, pairs=50))):
        rows = families(rng, 6, 40, near)
        rows += [(9000 + k, v, la) for k, (_, v, la) in enumerate(rows[:20])]
        want, found = brute(rows), em.near_duplicates(frame(spark, rows), settings).collect()
        links = {r["vec_id"]: r["n_links"] for r in found}
        assert all(links[i] <= n for i, n, _ in want)  # each link counted once, none invented
        assert sum(links.values()) >= 0.97 * sum(n for _, n, _ in want)


def test_strange_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [nan, 1.0], 1),
        (6, [inf, 1.0], 1), (7, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (8, [1.0, 1.0], 1),
        (8, [1.0, 1.0], 1), (9, [2.0, 2.0], 1), (10, [1.0, 1.0, 0.0], 1), (11, [1.0, 1.0], 2),
        (12, [-0.0, 3.0], 4), (13, [0.0, 3.0], 4), (8, [0.0, 1.0], 5), (14, [0.0, 1.0], 5),
    ]
    assert got(em.near_duplicates(frame(spark, rows))) == plain(brute(rows))
    assert em.near_duplicates(frame(spark, rows).limit(0)).collect() == []


def common(rng, count, direction, size):
    """Unit vectors whose mean has the norm `direction`."""
    rest = em.unit(rng.normal(size=(count, size))) * np.sqrt(1 - direction**2)
    axis = np.zeros(size)
    axis[0] = direction
    rest[:, 0] = 0
    return em.unit(axis + rest)


def test_codes_are_added_until_pairs_at_the_threshold_meet():
    for size in (16, 64, 384):
        for direction, bits in ((0.0, 16), (0.9, 16), (0.9, 21)):
            rng = np.random.default_rng(size)
            x = common(rng, 1500, direction, size)
            s = em.Settings(rounds=10)
            q = em.quantiser(x, bits, s)
            fresh = common(rng, 1500, direction, size)  # not those it was learnt on
            y = em.at_threshold(fresh, s.cosine)
            assert np.allclose((fresh * y).sum(axis=1), s.cosine)
            met = em.meet(em.parts(q.codes(fresh), bits), em.parts(q.codes(y), bits)).any(axis=1)
            assert met.mean() >= 0.95, (size, direction, bits, len(q.axes))
            assert (len(q.axes) > 1) == (direction > 0)


def test_recall_under_a_strong_common_direction(spark):
    rng = np.random.default_rng(2)
    rows = []
    for f, base in enumerate(common(rng, 60, 0.9, 64)):
        for other in em.at_threshold(np.repeat(base[None], 5, axis=0), 0.992) if f % 2 else [base]:
            rows.append((len(rows), (base if f % 4 == 3 else other).tolist(), f % 2))
        rows.append((len(rows), em.unit(base + 0.012 * rng.normal(size=(1, 64)))[0].tolist(), f % 2))
    rows += [(5000 + k, v.tolist(), k % 2) for k, v in enumerate(common(rng, 400, 0.9, 64))]
    want, found = brute(rows), em.near_duplicates(frame(spark, rows)).collect()
    links = {r["vec_id"]: r["n_links"] for r in found}
    assert all(links[i] <= n for i, n, _ in want)
    assert sum(links.values()) >= 0.95 * sum(n for _, n, _ in want) > 0


def test_parts_grow_with_the_largest_label(spark):
    rows = spark.range(70_000).selectExpr("id", "IF(id < 40000, 1, id) AS label")
    assert em._part_bits(rows) == 17 and em._part_bits(rows.limit(0)) == 16
    assert em._part_bits(rows.filter("id < 100")) == 16


def test_a_pair_counts_at_its_first_meeting_only():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 1 << 16, (200, 8), dtype=np.uint64)
    y = x ^ (rng.integers(0, 4, x.shape, dtype=np.uint64) & rng.integers(0, 4, x.shape, dtype=np.uint64))
    meets = em.meet(x, y)
    times = np.zeros(200, dtype=int)
    for table in range(8):
        for bit in range(16):
            mask = np.uint64(0xFFFF ^ (1 << bit))
            shares = (x[:, table] & mask) == (y[:, table] & mask)
            times += shares & em._first_meeting(x, y, np.full(200, table * 16 + bit), 16)
    assert (times == meets.any(axis=1)).all()

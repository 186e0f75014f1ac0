import random

from odd import documents, strange

from ledgerlens.llm import lines, queries

FOLDER = "/root/testdata/sf0.01"


def brute(rows, ratio=0.1, least=2, few=3):
    held, pages = {}, {}
    for _, text, _, host in rows:
        if host is not None:
            pages[host] = pages.get(host, 0) + 1
            for x in {x.strip(" \t\r\x0b\x0c") for x in (text or "").split("\n")} - {""}:
                held[host, x] = held.get((host, x), 0) + 1
    out = []
    for _, text, _, host in rows:
        if text is None:
            out.append(None)
            continue
        kept = [x for x in text.split("\n")
                if not (held.get((host, x.strip(" \t\r\x0b\x0c")), 0) >= max(least, min(pages.get(host, 0), few))
                        and held[host, x.strip(" \t\r\x0b\x0c")] > ratio * pages[host])]
        out.append("\n".join(kept))
    return out


def test_random_pages_equal_brute_force(spark):
    rng = random.Random(4)
    texts = ["foot", " foot\t", "head", "", "x", "rare one", "é", "foot foot"]
    rows = [
        (k, "\n".join(rng.choice(texts) for _ in range(rng.randint(0, 5))) if k % 9 else None, "en",
         rng.choice(["a", "a", "a", "b", None]))
        for k in range(300)
    ]
    rows += rows[:5]
    docs = documents(spark, rows)
    for ratio, least in ((0.3, 2), (0.5, 5), (0.05, 10)):
        done = lines.drop_boilerplate(docs, "source", "text", ratio, least)
        got = sorted((r["row"]["doc_id"], str(r["text"])) for r in done.collect())
        want = sorted((r[0], str(t)) for r, t in zip(rows, brute(rows, ratio, least)))
        assert got == want


def test_registered_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs]
    want = dict(zip((r[0] for r in rows), brute(rows)))
    got = {r["doc_id"]: r["text"] for r in queries.op7_line_dedup(spark, FOLDER).collect()}
    assert got == want


def test_small_hosts_lose_what_all_or_three_of_their_pages_hold(spark):
    rows = [(1, "menu\none", "en", "lone"), (2, "menu\ntwo", "en", "pair"), (3, "menu\nthree", "en", "pair")]
    rows += [(10 + k, f"menu\nown {k}" if k < 3 else f"own {k}\ntwice" if k < 5 else f"own {k}", "en", "ten") for k in range(10)]
    got = {r["row"]["doc_id"]: r["text"] for r in lines.drop_boilerplate(documents(spark, rows), "source", "text").collect()}
    assert got == dict(zip((r[0] for r in rows), brute(rows)))
    assert (got[1], got[2], got[10], got[13]) == ("menu\none", "two", "own 0", "own 3\ntwice")


def test_strange_rows_and_other_columns(spark):
    docs = strange(spark)
    done = lines.cleaned(docs)
    assert done.schema.simpleString() == docs.schema.simpleString()
    assert sorted(map(str, done.collect())) == sorted(map(str, docs.collect()))
    assert lines.cleaned(docs.limit(0)).collect() == []
    many = documents(spark, [(k, f"menu\nown {k}", "en", "a") for k in range(30)])
    for r in lines.cleaned(many).collect():
        assert r["text"] == f"own {r['doc_id']}" and r["n_chars"] == len(r["text"]) and r["hit"] == "x"


def test_small_hosts_lose_their_boilerplate(spark):
    # (pages of the host, pages with the line, whether it goes)
    cases = [(1, 1, False), (2, 1, False), (2, 2, True), (3, 2, False), (3, 3, True), (9, 9, True),
             (10, 2, False), (10, 3, True), (12, 3, True), (29, 3, True), (30, 3, False), (30, 4, True),
             (50, 5, False), (50, 6, True), (100, 10, False), (100, 11, True)]
    rows = [
        (1000 * c + k, f"menu\nown {k}" if k < on else f"own {k}", "en", f"host {c}")
        for c, (pages, on, _) in enumerate(cases) for k in range(pages)
    ]
    left = {r["doc_id"]: r["text"] for r in lines.cleaned(documents(spark, rows)).collect()}
    for c, (pages, on, goes) in enumerate(cases):
        held = sum("menu" in left[1000 * c + k] for k in range(pages))
        assert held == (0 if goes else on), (pages, on)
        assert all(f"own {k}" in left[1000 * c + k] for k in range(pages))


def test_no_python_on_the_plan(spark):
    plan = queries.op7_line_dedup(spark, FOLDER)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))

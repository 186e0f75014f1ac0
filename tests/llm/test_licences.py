import random

import pytest
from odd import documents, strange

from ledgerlens.llm import licences
from ledgerlens.llm.licences import BASE, TEXTS, Template

FILL = ["the", "license", "gnu", "general", "mit", "cc", "by", "apache", "public", "Zürich", "2", "cc-by", "MIT\nLicense"]


def plain(text: str) -> list[str]:
    return list(licences.words_of(text or ""))


def places(text: str, phrases) -> list[tuple[int, str]]:
    words = plain(text)
    out = []
    for t in phrases:
        own = list(t.words)
        out += [(k, t.label) for k in range(len(words)) if words[k : k + len(own)] == own]
    return sorted(out)


def scanned(docs, **more):
    return {r["doc_id"]: r for r in licences.scan(docs, **more).collect()}


def test_every_place_of_every_phrase_is_found(spark):
    rng = random.Random(3)
    rows = [
        (k, " ".join(rng.choice(FILL) for _ in range(rng.choice([0, 1, 3, 40, 400]))), "en", "a") for k in range(200)
    ]
    rows.append((200, "x " * 700_000 + "GNU General-Public (License) " + "y " * 700_000 + "CC BY", "en", "a"))
    rows.append((201, "mit", "en", "a"))  # a phrase does not go on in the next text
    rows.append((202, "license", "en", "a"))
    got = scanned(documents(spark, rows), templates=BASE)
    for k, text, _, _ in rows:
        assert [(p["start"], p["label"]) for p in got[k]["places"]] == places(text, BASE), k
        assert got[k]["n_words"] == len(plain(text))
    assert got[200]["places"][0]["start"] == 700_000


def test_phrases_are_found_in_a_file_full_of_rarer_words(spark):
    others = " ".join(w for t in TEXTS for w in t.words)
    rows = [(1, f"{others} cc by {others}", "en", "a")] + [(k, "cc by " * 50, "en", "a") for k in range(2, 40)]
    got = scanned(documents(spark, rows))
    assert {"cc-by", "gpl", "apache"} <= {p["label"] for p in got[1]["places"]}
    assert len(got[2]["places"]) == 50


NOTICE = next(t for t in TEXTS if t.label == "mit-notice")


def test_notices_may_be_edited_but_not_in_their_key_phrases(spark):
    words = list(NOTICE.words)
    cut = {
        1: words,
        2: ["intro"] * 9 + words[:10] + ["very"] + words[10:],  # one word more
        3: [w if w != "person" else "body" for w in words],  # one word replaced
        4: words[:5] + ["not"] + words[6:],  # "free not charge": a key phrase is broken
        5: words[::-1],
        6: words[:8],  # the key phrases alone, with too few votes
    }
    got = scanned(documents(spark, [(k, " ".join(v), "en", "a") for k, v in cut.items()]))
    label = {k: {p["label"] for p in r["places"]} for k, r in got.items()}
    assert [("mit-notice" in label[k]) for k in sorted(cut)] == [True, True, True, False, False, False]
    share = {k: max((p["share"] for p in got[k]["places"]), default=0) for k in cut}
    assert share[1] == 1 and share[3] == 1 - 1 / len(words) and 0 < share[2] < 1


def test_rare_words_follow_the_corpus(spark):
    docs = documents(spark, [(k, "alpha beta alpha", "en", "a") for k in range(5)] + [(9, "beta gamma", "en", "a")])
    found = licences.document_frequencies(docs, ["alpha", "beta", "gamma", "delta"])
    assert found == {"alpha": 5, "beta": 6, "gamma": 1, "delta": 0}
    index = licences.Index((Template("x", "alpha beta gamma"),), found, licences.Settings())
    assert index.place.tolist() == [2]  # of gamma


def test_a_key_phrase_must_be_part_of_its_template():
    with pytest.raises(ValueError):
        _ = Template("x", "one two", ("three",)).mandatory


def test_strange_rows(spark):
    docs = strange(spark)
    got = sorted((r["doc_id"] or 0, r["n_words"], len(r["places"])) for r in licences.scan(docs).collect())
    want = sorted((r["doc_id"] or 0, len(plain(r["text"])), 0) for r in docs.collect())
    assert got == want
    assert licences.scan(docs.limit(0)).collect() == []

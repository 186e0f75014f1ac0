import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.llm import chat, queries

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, context string, reply string, of long"


def rows(spark, turns):
    return spark.createDataFrame([(*t, "x", "y", 5) for t in turns], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(turns):
    by = defaultdict(list)
    for c, n, role, text in turns:
        by[c].append((n is not None, n or 0, role or "", text or ""))
    out = {}
    for c, own in by.items():
        own.sort()
        said = "".join(t for _, _, r, t in own if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in own)
        out[c] = (len(own), sha(whole), len(said), sha(said))
    return out


def digest(df):
    return {
        r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"])
        for r in df.collect()
    }


def test_registered_query(spark):
    turns = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    told = "</s>[INST] ok [/INST]"
    turns += [(-7, 0, "user", told), (-7, 1, "assistant", told)]
    assert digest(queries.op2_chat_formatting(spark, FOLDER)) == expected(turns)


NASTY = st.text(alphabet="<>|[]/\\elbsturnxdINSTYé\n ", max_size=14) | st.sampled_from(
    ["<|end|>", "<|turn|>", "<|text|>", "\\l", "\\\\e", "<", "[", "</s>", "<<SYS>>", "[/INST]", "<|", "<\n"]
)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["user", "assistant", "<|end|>", None]),
                          st.one_of(st.none(), NASTY)), max_size=12))
def test_control_strings_come_back(spark, turns):
    turns = [(c, k, r, t) for k, (c, r, t) in enumerate(turns)]
    done = chat.formatted(rows(spark, turns))
    assert digest(chat.digests(done)) == expected(turns)


def test_examples_hold_all_that_comes_before(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "<|end|>"), (1, 2, "assistant", "a<"),
             (1, 3, "user", "u2"), (1, 4, "assistant", ""), (2, 0, "user", "alone")]
    done = chat.formatted(rows(spark, turns))
    whole = {r["conv_id"]: r["text"] for r in done.collect()}
    found = chat.with_contexts(chat.examples(done), done).orderBy("conv_id", "example").collect()
    assert [(r["conv_id"], r["example"]) for r in found] == [(1, 0), (1, 1)]
    for r in found:
        assert whole[r["conv_id"]].startswith(r["context"] + r["reply"] + chat.CLOSE)
        assert r["context"].endswith(chat.OPEN + "assistant" + chat.HEAD)
    assert found[0]["reply"] == "a\\l" and found[1]["reply"] == ""


def test_contexts_are_all_that_comes_before_each_reply(spark):
    """Their number, lengths and digest, against the formatted text itself."""
    turns = [(1, k, r, t) for k, (r, t) in enumerate([
        ("user", "é<|end|>"), ("assistant", "[INST]"), ("assistant", ""), ("user", "x"), ("assistant", "\\l")])]
    turns += [(2, 0, "user", "no reply")]
    done = chat.formatted(rows(spark, turns))
    whole = {r["conv_id"]: r["text"] for r in done.collect()}
    told = {r["conv_id"]: r for r in chat.digests(done).collect()}
    head, starts = chat.OPEN + "assistant" + chat.HEAD, []
    for k, part in enumerate(whole[1].split(chat.CLOSE)):
        if part.startswith(head):
            starts.append(len(chat.CLOSE.join(whole[1].split(chat.CLOSE)[:k]) + chat.CLOSE * (k > 0)) + len(head))
    r = told[1]
    assert (r["n_examples"], r["context_chars"]) == (3, sum(starts))
    assert r["contexts_sha256"] == sha(",".join(map(str, starts)))
    assert (told[2]["n_examples"], told[2]["context_chars"], told[2]["contexts_sha256"]) == (0, 0, sha(""))


def test_examples_carry_their_contexts(spark):
    turns = [(c, k, r, t) for c in (None, 1, 2) for k, (r, t) in enumerate([
        ("user", f"é{c}<|end|>"), ("assistant", "[INST]"), ("user", ""), ("assistant", "\\l<")])]
    done = chat.formatted(rows(spark, turns))
    whole = {r["conv_id"]: r["text"] for r in done.collect()}
    found = chat.examples(done).collect()
    assert len(found) == 6
    for r in found:
        parts, head = whole[r["conv_id"]].split(chat.CLOSE), chat.OPEN + "assistant" + chat.HEAD
        k = 2 * r["example"] + 1
        assert r["context"] == "".join(p + chat.CLOSE for p in parts[:k]) + head
        assert head + r["reply"] == parts[k]


def test_digests_are_read_from_written_examples(spark, monkeypatch):
    done = chat.formatted(rows(spark, [(1, 0, "user", "q"), (1, 1, "assistant", "abc")]))
    own = chat.examples
    monkeypatch.setattr(chat, "examples", lambda c: own(c).withColumn("context", F.lit("four")))
    told = chat.digests(done).first()
    assert (told["context_chars"], told["loss_sha256"]) == (4, sha("abc"))


def test_strange_rows(spark):
    turns = [(None, 1, "assistant", "x"), (None, 0, None, None), (3, None, "user", "q"), (3, 0, "assistant", "p"),
             (4, 1, "assistant", "r"), (4, 1, "assistant", "r"), (5, 0, "assistant", "long " * 50000)]
    assert digest(chat.digests(chat.formatted(rows(spark, turns)))) == expected(turns)
    assert chat.digests(chat.formatted(rows(spark, turns).limit(0))).collect() == []


def test_no_python_on_the_plan(spark):
    plan = chat.digests(chat.formatted(rows(spark, [(1, 1, "user", "x")]).filter(F.col("turn") > 0)))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert not any(x in text for x in ("Python", "Pandas", "Arrow"))

"""Chat formatting: every assistant turn becomes an example of its own.

`formatted` writes each conversation once, turns marked by a template. Control strings inside
roles and texts are escaped reversibly, so a text can neither end its turn nor open another.
`examples` then explodes it: one row for each assistant turn, whose context is all that is written
before the reply and whose only trainable part is the reply. Its places are found by lengths (`spans`)
and moved as lengths; a context becomes a string only in the row that is handed on, so all contexts
of a conversation, which take the square of its text, are never held or shuffled together.

DataFrame functions only. A conversation's turns are brought together, because its text is one value.

Defined results: a null role or text is empty; a null conversation id is a conversation of its own. Turns
are ordered by turn, null first, ties by role and text; repeated rows are turns of their own.
Without assistant turns a conversation has no example. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, HEAD, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
# What an escape stands for. A backslash is escaped first, so each backslash of escaped text
# belongs to one of these and plain replacement, in this order backwards, undoes them.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))
# Where "<" and "[" could begin a control string, of this template or of another common one, or
# could do so together with what follows the text.
ANGLE = r"<(?=[|<]|/?s>|/?SYS|\z)"
SQUARE = r"\[(?=/?INST|\z)"


def escape(text: Column) -> Column:
    """`text` without any control string; undone by `unescape`."""
    plain = F.replace(text, F.lit("\\"), F.lit("\\e"))
    plain = F.regexp_replace(plain, ANGLE, r"\\l")
    return F.regexp_replace(plain, SQUARE, r"\\b")


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, text) from rows of (conv_id, turn, role, text): the conversation, written once."""
    turn = F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    held = turns.select("conv_id", turn.alias("t")).groupBy("conv_id")
    rows = held.agg(F.sort_array(F.collect_list("t")).alias("turns"))
    written = F.transform(
        "turns",
        lambda t: F.concat(
            F.lit(OPEN), escape(t["role"]), F.lit(HEAD), escape(t["text"]), F.lit(CLOSE)
        ),
    )
    return rows.select("conv_id", F.array_join(written, "").alias("text"))


def parsed(text: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    parts = F.split(text, r"<\|end\|>", -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    heads = F.transform(parts, lambda p: F.split(F.substr(p, F.lit(len(OPEN) + 1)), r"<\|text\|>", 2))
    return F.transform(
        heads, lambda h: F.struct(unescape(h[0]).alias("role"), unescape(h[1]).alias("text"))
    )


def spans(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, context_chars, reply) for each assistant turn of formatted conversations.

    The context is the first `context_chars` characters of the conversation's text.
    """
    parts = F.split("text", r"<\|end\|>", -1)
    turns = conversations.select("conv_id", F.posexplode(parts).alias("place", "part"))
    inside = Window.partitionBy("conv_id").orderBy("place")
    size = (F.length("part") + len(CLOSE)).cast("long")
    start = F.coalesce(F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    head = OPEN + "assistant" + HEAD
    own = turns.withColumn("start", start).filter(F.startswith("part", F.lit(head)))
    return own.select(
        "conv_id",
        (F.row_number().over(inside) - 1).cast("long").alias("example"),
        (F.col("start") + len(head)).alias("context_chars"),
        F.substr("part", F.lit(len(head) + 1)).alias("reply"),
    )


def with_contexts(found: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv_id, example, context_chars, context, reply): spans with their contexts as strings."""
    text = conversations.select(F.col("conv_id").alias("of"), F.col("text").alias("whole"))
    joined = found.join(text, F.col("conv_id").eqNullSafe(F.col("of")))
    context = F.substr("whole", F.lit(1), F.col("context_chars").cast("int"))
    return joined.select("conv_id", "example", "context_chars", context.alias("context"), "reply")


def examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, context_chars, context, reply) for each assistant turn of formatted conversations.

    The context holds all preceding turns and the head of the reply, as text. The loss mask covers
    `reply`, still escaped, and nothing else.
    """
    return with_contexts(spans(conversations), conversations)


def digests(conversations: DataFrame) -> DataFrame:
    """What the formatted conversations say, read back: turns from the text, loss and contexts from examples.

    Every example is written out, context and reply, and its loss is what stands behind the context. A
    context is a beginning of the conversation's text, so the lengths of all contexts, in order, say what
    each of them holds: `n_examples`, their sum, and the digest of the list.
    """
    turns = parsed(F.col("text"))
    whole = conversations.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(
            F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""),
            256,
        ).alias("turns_sha256"),
        F.length("text").cast("long").alias("formatted_chars"),
    )
    size = F.length("context")
    told = examples(conversations).withColumn("written", F.concat("context", "reply")).select(
        "conv_id", "example",
        F.substr("written", size + 1).alias("reply"), size.cast("long").alias("context_chars"),
    )
    held = F.sort_array(F.collect_list(F.struct("example", "reply", "context_chars")))
    loss = told.groupBy("conv_id").agg(held.alias("held"))
    said = F.array_join(F.transform("held", lambda r: unescape(r["reply"])), "")
    contexts = F.array_join(F.transform("held", lambda r: r["context_chars"].cast("string")), ",")
    total = F.aggregate("held", F.lit(0).cast("long"), lambda n, r: n + r["context_chars"])
    loss = loss.withColumn("said", said).select(
        F.col("conv_id").alias("of"),
        F.length("said").cast("long").alias("loss_chars"),
        F.sha2("said", 256).alias("loss_sha256"),
        F.size("held").cast("long").alias("n_examples"),
        total.alias("context_chars"),
        F.sha2(contexts, 256).alias("contexts_sha256"),
    )
    joined = whole.join(loss, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    return joined.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.coalesce("loss_chars", F.lit(0).cast("long")).alias("loss_chars"),
        F.coalesce("loss_sha256", F.sha2(F.lit(""), 256)).alias("loss_sha256"),
        "formatted_chars",
        F.coalesce("n_examples", F.lit(0).cast("long")).alias("n_examples"),
        F.coalesce("context_chars", F.lit(0).cast("long")).alias("context_chars"),
        F.coalesce("contexts_sha256", F.sha2(F.lit(""), 256)).alias("contexts_sha256"),
    )

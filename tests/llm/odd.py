"""Awkward document rows that every operator has to take."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators use themselves.
        *[T.StructField(n, T.StringType()) for n in (
            "score", "row", "text2", "host", "lines", "hit", "kept", "id", "family", "shard", "label",
            "bin", "spans", "dropped", "cluster", "n", "held_out",
        )],
    ]
)
LONG = "the long text of one document goes on " * 8000


def documents(spark, rows):
    """Rows of (doc_id, text, lang, source); the other columns hold a marker."""
    own = [(i, t, la, s, None if t is None else len(t), *["x"] * 17) for i, t, la, s in rows]
    return spark.createDataFrame(own, SCHEMA)


def strange(spark):
    return documents(
        spark,
        [
            (1, None, "en", "a"),
            (2, "", "en", "a"),
            (3, " \n\t ", None, None),
            (None, "a row without an id", "en", "a"),
            (5, "same text twice in here", "en", None),
            (5, "same text twice in here", "en", None),
            (6, "same text twice in here", None, "b"),
            (7, LONG, "en", "b"),
            (8, "1234 5678 !!!", "de", "b"),
            (9, "Ünï \U0001f600 ▁ \\ <s> [INST] é", "fr", "c"),
        ],
    )

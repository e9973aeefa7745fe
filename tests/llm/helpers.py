"""Small fixtures with the awkward cases: nulls, empty and long texts, ties, repeated rows and ids,
columns named like an operator's own."""

import random

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
CLASHING = ["score", "n_tokens", "kept", "text_sha256", "row", "fp", "part", "rest", "label", "n_words", "group",
            "_dedup_row", "_simhash_row", "_fertility_group", "keep_id", "words", "held_out", "word", "spans"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in CLASHING)])


def prose(seed, n=120):
    r = random.Random(seed)
    parts = ["the", "an", "re", "tion", "ing", "er", "ou", "st", "bl", "ö", "é", "lo"]
    words = ["".join(r.choices(parts, k=r.randint(1, 3))) for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(words))


def texts():
    a, b = prose(1), prose(2)
    return [(1, a), (2, a.upper()), (3, a), (3, a), (4, b), (5, b + " Extra."), (6, None), (7, ""), (8, " \t\n "),
            (9, "one"), (10, "Two words"), (11, "Ünï cödé 中文 😀 don't 12½ x²\x85y"), (None, "no id here"), (None, None),
            (12, prose(3, 30000)), (13, "x" * 50_000), (14, "\\ <s> </s> [INST] <|endoftext|> \0 end"),
            (15, "mail a.b@c.example.com or +1 (555) 123-4567, host 10.0.0.255, card 4111 1111 1111 1111"),
            (16, "\n".join(["same line here"] * 40)), (17, a.replace("the", "the ", 1))]


def edge_docs(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, None if i == 9 else "en", "s", len(t or ""), *["clash"] * len(CLASHING))
                                  for i, t in rows], SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")

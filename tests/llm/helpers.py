"""Fixtures shared by the tests of the text-preparation operators."""

import hashlib
import random
import re

import public_tokenizers
from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"
CHECK = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType())])
#: Names the operators use inside or return.
CLASH = ["host", "fp", "words", "line", "key", "lo", "hi", "score", "kept", "n_lines", "kept_text", "lost_keys",
         "component_id", "fingerprint", "held_out", "predicted", "ids", "samples", "item_id", "n_words", "root", "shard",
         "lost_id", "n_dropped", "kept_sha256", "n_removed", "run_doc", "run_print", "own_print", "runs", "kept_id",
         "kept_print", "n_rows", "first", "print", "c0", "c1", "d", "dotted.name", "quoted `name`"]


def table(spark, rows):
    """documents of (doc_id, text, lang, source)."""
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], SCHEMA)


def prose(seed, n):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(400)]
    return " ".join(r.choice(vocab) for _ in range(n))


def edge_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    a = prose(1, 120)
    return [(1, None, "en", "s"), (2, "", "en", "s"), (3, " \t\n\x0b\x0c\r ", None, None), (4, a, None, "s"),
            (5, a, "en", None), (6, a, "en", "s"), (6, a, "en", "s"), (None, a, "en", "s"), (None, None, None, None),
            (7, "1234 !!! ...", "de", "s"), (8, "\n".join([a, a, "x"]), "en", "s"), (9, prose(2, 60_000), "en", "s"),
            (10, "one", "en", "s"), (11, "Ünïcode line sep 😀 \u0000 nul", "fr", "t"), (12, "z" * 50_000, "en", "t")]


def with_clashes(df):
    from pyspark.sql import functions as F
    return (df.withColumns({c: F.lit(f"own {c}") for c in CLASH})
            .withColumn("nested", F.struct(F.lit(1).alias("a b.c"), F.array(F.struct(F.lit("x").alias("d-e"))).alias("`"))))


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tokenizer(name):
    return public_tokenizers.path(name)


def auc(labels, scores):
    pairs = sorted(zip(scores, labels))
    rank, total, i = {}, 0.0, 0
    while i < len(pairs):
        j = i
        while j < len(pairs) and pairs[j][0] == pairs[i][0]:
            j += 1
        rank[pairs[i][0]] = (i + j + 1) / 2
        i = j
    pos = sum(labels)
    total = sum(rank[s] for s, y in pairs if y)
    return (total - pos * (pos + 1) / 2) / (pos * (len(pairs) - pos))

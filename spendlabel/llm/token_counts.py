"""Token counts from pre-token frequencies, without token ids of documents.

A text is cut at [\\x20\\x09-\\x0D]; no token of the supported tokenizers reaches over such
a cut (their pre-tokenizer drops white space and their special strings hold none; both
are checked when the file is loaded). Per document the distinct pre-tokens are counted,
each distinct pre-token is encoded once per task into a table of piece counts, and the
document's frequencies are joined to that table and summed. Only counts are kept: no
document is ever encoded as a whole, and no id list outlives its pre-token.

The join runs inside the task: as a shuffle join it would move one row per document and
distinct pre-token (about 85 million rows for 0.85 GB of text), more than the texts.
The table is bounded (``TABLE_ROWS``); when full it starts anew, which costs time only.

Edge cases. Null or empty text: 0 bytes, 0 tokens. Null id, repeated rows, ties: one row
per input row. Empty table: empty result. Extra columns are ignored. Special strings
inside a text count as the library's default treats them (one special token).
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, ship

LIMIT = 2048
TABLE_ROWS = 400_000
#: Longer pre-tokens are counted but not kept in the table.
LONG = 64
_CUT = re.compile(r"[^\x20\x09-\x0D]+")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if any(_CUT.fullmatch(t["content"]) is None or t["lstrip"] or t["rstrip"] or t["single_word"]
           for t in spec["added_tokens"]):
        raise ValueError("special strings of this tokenizer reach over white space")
    tok = Tokenizer.from_str(json.dumps(spec | {"truncation": None, "padding": None}))
    a, b = "Ab1,", "c's"
    for gap in " \t\n\x0b\x0c\r":
        whole = tok.encode(a + gap + b, add_special_tokens=False).ids
        if whole != tok.encode(a, add_special_tokens=False).ids + tok.encode(b, add_special_tokens=False).ids:
            raise ValueError("tokens of this tokenizer reach over white space")
    return tok


class PieceTable(dict):
    """Pre-token -> number of pieces, filled on first sight."""

    def __init__(self, path: str):
        super().__init__()
        self.encode = _tokenizer(path).encode

    def __missing__(self, pre_token: str) -> int:
        n = len(self.encode(pre_token, add_special_tokens=False).ids)
        if len(pre_token) <= LONG:
            if len(self) >= TABLE_ROWS:
                self.clear()
            self[pre_token] = n
        return n


@lru_cache(maxsize=2)
def _table(path: str) -> PieceTable:
    return PieceTable(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, n_pretokens, n_distinct, over_limit), one row per document."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(path)
        for b in batches:
            out: list[tuple[int, int, int]] = []
            for text in column(b, "text").to_pylist():
                freq = Counter(_CUT.findall(text or ""))
                out.append((sum(n * table[p] for p, n in freq.items()), freq.total(), len(freq)))
            tokens, pre, distinct = (pa.array(x, pa.int64()) for x in (zip(*out) if out else ((), (), ())))
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id"), column(b, "n_bytes"), tokens, pre, distinct],
                ["doc_id", "n_bytes", "n_tokens", "n_pretokens", "n_distinct"])

    rows = docs.select(F.col("doc_id").cast("long"), "text",
                       F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return (rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, n_pretokens long, n_distinct long")
            .withColumn("over_limit", F.col("n_tokens") > limit))

"""Token counts: map-side two-tier lookup.

Texts are cut into pre-tokens (an optional space and a run of other
characters, or white space).  Such a cut is coarser than the tokenizer's own
split and never divides one of its pre-tokens, so the counts of the parts add
up to the count of the text.  Tier one is a broadcast table of the lengths of
frequent pre-tokens; its size is a parameter.  Tier two is a cache in each
Python worker that encodes every other pre-token once.  No pre-token is
shuffled: only each task's few most frequent ones are, to choose tier one.

Nulls count as empty texts (0 tokens); texts of any length are counted whole;
repeated rows each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import worker_memo

#: Unicode white space as the tokenizer's expression sees it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRE_TOKEN = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
PRE_TOKEN_ASCII = re.compile("(?: ?[^\t-\r ]+)|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")

FREQUENT = 32_768        # entries of the broadcast table
FREQUENT_PER_TASK = 4_096
MEMO = 300_000           # pre-tokens that a worker remembers


def pre_tokens(text: str) -> list[str]:
    return (PRE_TOKEN_ASCII if text.isascii() else PRE_TOKEN).findall(text)


def _tokenizer(json_text: str):
    from tokenizers import Tokenizer
    return worker_memo("token_counts", ("tokenizer", hash(json_text)), lambda: Tokenizer.from_str(json_text))


def _specials(tok) -> list[str]:
    return sorted((t.content for t in tok.get_added_tokens_decoder().values()), key=len, reverse=True)


class _Lengths(dict):
    """Pre-token -> number of tokens; encodes what it doesn't know."""

    def __init__(self, tok, frequent):
        super().__init__(frequent)
        self.tok, self.frequent = tok, frequent

    def __missing__(self, piece):
        if len(self) >= MEMO + len(self.frequent):
            self.clear()
            self.update(self.frequent)
        n = self[piece] = len(self.tok.encode(piece, add_special_tokens=False).ids)
        return n


def text_tokens(text: str | None, lengths, special) -> int:
    """Tokens of one text.  Special strings cut it first, as the library does."""
    if not text:
        return 0
    parts = special.split(text) if special is not None else [text]
    n = len(parts) - 1
    for part in parts:
        n += sum(map(lengths.__getitem__, pre_tokens(part)))
    return n


def frequent_pre_tokens(docs: DataFrame, text: str = "text", size: int = FREQUENT,
                        per_task: int = FREQUENT_PER_TASK) -> list[str]:
    """The pre-tokens that lead in the tasks' own counts over all texts; at
    most ``per_task`` rows of a task are shuffled and ``size`` collected."""
    def count(batches):
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    seen.update(pre_tokens(t))
            if len(seen) > MEMO:
                seen = Counter(dict(seen.most_common(MEMO // 2)))
        top = seen.most_common(per_task)
        if top:
            yield pa.record_batch({"piece": pa.array([p for p, _ in top], pa.string()),
                                   "n": pa.array([n for _, n in top], pa.int64())})

    rows = (docs.select(F.col(text).alias("text")).mapInArrow(count, "piece string, n long")
            .groupBy("piece").agg(F.sum("n").alias("n"))
            .orderBy(F.col("n").desc(), "piece").limit(size).collect())
    return [r.piece for r in rows]


def count_tokens(docs: DataFrame, tokenizer_json: str, text: str = "text", keep: tuple = ("doc_id",),
                 limit: int = 512) -> DataFrame:
    """``keep`` columns, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every
    row.  ``tokenizer_json`` is the content of a byte-level BPE tokenizer file."""
    from tokenizers import Tokenizer

    sc = docs.sparkSession.sparkContext
    tok = Tokenizer.from_str(tokenizer_json)
    common = frequent_pre_tokens(docs, text)
    table = {p: len(e.ids) for p, e in zip(common, tok.encode_batch(common, add_special_tokens=False))}
    shared = sc.broadcast((tokenizer_json, table))
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in keep]
                          + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def count(batches):
        json_text, frequent = shared.value
        tok = _tokenizer(json_text)
        lengths = worker_memo("token_counts", ("lengths", hash(json_text)), lambda: _Lengths(tok, frequent))
        specials = _specials(tok)
        special = re.compile("|".join(map(re.escape, specials))) if specials else None
        for b in batches:
            texts = b.column(b.num_columns - 1)
            n = [text_tokens(t, lengths, special) for t in texts.to_pylist()]
            size = pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], size, pa.array(n, pa.int64())],
                                             names=[*keep, "n_bytes", "n_tokens"])

    out = docs.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(count, schema)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)

"""Column-level text functions.

All of them are built-in Spark expressions except NFKC normalisation, which
Spark lacks and which runs as an Arrow-batched ``pandas_udf``.

Token rule (G2): lower-case, then maximal runs of letters and digits
(``[\\p{L}\\p{N}]+``); the English stop list is removed by default.
"""

from __future__ import annotations

import string
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.stopwords import ENGLISH_STOP_WORDS

TOKEN_PATTERN = r"([\p{L}\p{N}]+)"


def _char_class(codepoints) -> str:
    """Regex class of the given code points, consecutive ones as ranges;
    ``\\x{..}`` escapes read the same in Java regex and in RE2 (DuckDB)."""
    runs: list[list[int]] = []
    for c in sorted(codepoints):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}"
                         for a, b in runs) + "]"


# Python's ``string.punctuation`` (the 32 ASCII punctuation characters).
PUNCT_CLASS = _char_class(sorted(ord(c) for c in string.punctuation))
# Exactly the characters Python's ``str.split()`` / ``\s`` treat as space.
WHITESPACE_CLASS = _char_class(c for c in range(0x110000) if chr(c).isspace())
NON_SPACE_RUN = "(" + WHITESPACE_CLASS[:1] + "^" + WHITESPACE_CLASS[1:] + "+)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC normalisation; null stays null."""
    return s.map(lambda v: unicodedata.normalize("NFKC", v) if isinstance(v, str) else None)


def clean_question(c, normalize: bool = True) -> Column:
    """G1: null -> ""; NFKC; ASCII punctuation -> space; space runs -> one; strip.

    NFKC comes first so full-width punctuation is mapped to ASCII and removed.
    """
    x = F.coalesce(_col(c).cast("string"), F.lit(""))
    if normalize:
        x = nfkc(x)
    x = F.regexp_replace(x, PUNCT_CLASS, " ")
    x = F.regexp_replace(x, WHITESPACE_CLASS + "+", " ")
    return F.trim(x)


def tokens(c, stop_words=ENGLISH_STOP_WORDS, stem: bool = False) -> Column:
    """Index-time terms of a text column as ``array<string>``.

    Null text gives an empty array.  ``stop_words=None`` keeps every token;
    ``stem=True`` applies Porter stemming after the stop list (off by default).
    """
    arr = F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))),
                               F.lit(TOKEN_PATTERN), 1)
    if stop_words:
        stops = list(stop_words)
        arr = F.filter(arr, lambda t: ~t.isin(stops))
    if stem:
        from quarry.functions.stem import stem_tokens
        arr = stem_tokens(arr)
    return arr


def split_words(c) -> Column:
    """``text.split()``: runs of non-space characters (Python's notion of
    space); null -> empty array.  ``split`` + ``array_remove`` is several
    times faster in the JVM than extracting the runs with a regex."""
    return F.array_remove(F.split(F.coalesce(_col(c), F.lit("")), WHITESPACE_CLASS + "+"), "")


def count_words(c) -> Column:
    """``len(text.split())``; null or empty text -> 0."""
    return F.size(split_words(c))


def count_tokens(c, tokenizer=None) -> Column:
    """Number of tokens of a text column.

    ``tokenizer`` is an optional callable ``str -> list`` (a sub-word model);
    it runs in an Arrow-batched pandas UDF.  Default: the G2 term rule
    without a stop list.
    """
    if tokenizer is None:
        return F.size(tokens(c, stop_words=None))

    @F.pandas_udf(T.LongType())
    def _count(s: pd.Series) -> pd.Series:
        return s.map(lambda v: len(tokenizer(v)) if isinstance(v, str) else 0)

    return _count(_col(c))


def detokenize(c, sep: str = " ") -> Column:
    """Tokens back to a string."""
    return F.array_join(_col(c), sep)


def char_length(c) -> Column:
    """String length in characters."""
    return F.char_length(_col(c))

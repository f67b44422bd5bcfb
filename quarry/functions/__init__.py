"""Column-level text functions."""

from quarry.functions.stopwords import ENGLISH_STOP_WORDS
from quarry.functions.text import (
    PUNCT_CLASS,
    TOKEN_PATTERN,
    WHITESPACE_CLASS,
    char_length,
    clean_question,
    count_tokens,
    count_words,
    detokenize,
    nfkc,
    tokens,
)

__all__ = [
    "ENGLISH_STOP_WORDS", "PUNCT_CLASS", "TOKEN_PATTERN", "WHITESPACE_CLASS",
    "char_length", "clean_question", "count_tokens", "count_words",
    "detokenize", "nfkc", "tokens",
]

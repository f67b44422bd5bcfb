"""Thesaurus input ``(lemma, sense_id, gloss, members array<string>)``.

The reference consults an external lexical database that is not available
offline, so the thesaurus is an input table.  ``load_thesaurus`` reads one
from Parquet or JSON lines; ``FIXTURE`` is a small literal table over words
that RAKE returns often on the driver's ``documents`` and ``benchmark``
tables, built to exercise every rule of the sense choice:
two senses with different overlap (``de``, ``la``), an overlap tie
(``re``: equal glosses, the larger sense id wins), a member equal to its
keyword in another case (``De``, ``La``, ``Re``, ``Ha``), members with ``_``,
senses with more than two members, and keywords with no sense (all others).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("lemma", T.StringType()),
    T.StructField("sense_id", T.StringType()),
    T.StructField("gloss", T.StringType()),
    T.StructField("members", T.ArrayType(T.StringType())),
])

# The test thesaurus (our own fixture).
FIXTURE = [
    ("de", "de.n.01", "la des en le et du", ["de", "of", "from_the", "off"]),
    ("de", "de.n.02", "der die und das zu", ["De", "von", "aus", "ab"]),
    ("la", "la.n.01", "the and of is", ["the_article", "La", "lanthanum"]),
    ("la", "la.n.02", "de des et le", ["la_note", "sixth_note", "lah"]),
    ("der", "der.n.01", "die und das ist", ["the", "article", "determiner"]),
    ("re", "re.n.01", "the of and", ["ray", "Re", "rhenium"]),
    ("re", "re.n.02", "the of and", ["re_note", "second_note", "ray"]),
    ("en", "en.n.01", "la le et des", ["en_space", "nut", "nut_space"]),
    ("und", "und.n.01", "der die das", ["and", "plus", "und"]),
    ("ha", "ha.n.01", "the and", ["hectare", "Ha"]),
]


def fixture(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIXTURE, SCHEMA)


def load_thesaurus(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(SCHEMA).format(fmt).load(path)


def fixture_sql() -> str:
    """The fixture as a DuckDB ``VALUES`` list."""
    def q(s):
        return "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({q(a)}, {q(b)}, {q(c)}, [{', '.join(q(m) for m in d)}])"
                     for a, b, c, d in FIXTURE)
    return f"(VALUES {rows}) AS t(lemma, sense_id, gloss, members)"

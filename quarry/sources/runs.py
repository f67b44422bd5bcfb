"""Ranked runs in TREC format (``qid Q0 docno rank score tag``).

One folder per system name; Spark writes it as text shards.  ``reuse``
reads a saved run instead of recomputing it (the reference's
``save_mode="reuse"``); the folder name carries a hash of ``params``, which
must name everything the run depends on: topics, index build, parameters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import path_exists


def run_path(base: str, name: str, params: str = "") -> str:
    tag = hashlib.sha1(params.encode()).hexdigest()[:10] if params else ""
    return f"{base.rstrip('/')}/{name}" + (f"-{tag}" if tag else "")


def save_run(run: DataFrame, path: str, tag: str, mode: str = "overwrite") -> None:
    """One line per row; score printed with full double precision.  A null
    value, or an id or tag that is empty or holds white space, would shift the
    columns and is an error."""
    def word(c):
        c = c.cast("string")
        return F.when(c.rlike(r"^\S+$"), c).otherwise(F.raise_error(F.concat(
            F.lit("not a word of a run file: "), F.coalesce(c, F.lit("null")))))

    line = F.concat_ws(" ", word(F.col("qid")), F.lit("Q0"), word(F.col("docno")),
                       word(F.col("rank")), word(F.col("score")), word(F.lit(tag)))
    run.select(line.alias("value")).write.mode(mode).text(path)


def read_run(spark: SparkSession, path: str, qid_type: str = "string",
             docno_type: str = "string") -> DataFrame:
    """Parse a TREC run: ``(qid, docno, rank, score, name)``."""
    p = F.split(F.col("value"), " ")
    return (spark.read.text(path).filter(F.length(F.trim("value")) > 0)
            .select(p[0].cast(qid_type).alias("qid"), p[2].cast(docno_type).alias("docno"),
                    p[3].cast("int").alias("rank"), p[4].cast("double").alias("score"),
                    p[5].alias("name")))


def reuse(spark: SparkSession, path: str, compute: Callable[[], DataFrame], tag: str,
          qid_type: str = "string", docno_type: str = "string") -> DataFrame:
    """The saved run at ``path`` if present, else compute, save, and read
    it back (the written table also cuts the lineage)."""
    if not path_exists(spark, path + "/_SUCCESS"):
        save_run(compute(), path, tag)
    return read_run(spark, path, qid_type, docno_type)

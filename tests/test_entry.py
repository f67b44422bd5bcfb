import re

import __spark_entry__ as E

from conftest import SF_SMALL


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 0
    assert {"qid", "p_1", "ap"} <= set(df.columns)


def test_every_query_has_sql_or_is_known(spark):
    qs, sqls = E.queries(), E.oracle_sql()
    own = {name for name in qs if not re.match(r"op\d+_|pipeline$", name)}
    assert own <= set(sqls) <= set(qs)   # every query of the library proper has an oracle
    assert len(qs) >= 60


def test_some_queries_run_on_smallest(spark):
    for name in ("corpus_load", "bm25", "rake_keywords", "dense_topk", "length_histogram"):
        assert E.queries()[name](spark, SF_SMALL).count() >= 0

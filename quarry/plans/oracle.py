"""DuckDB SQL fragments for the oracle side of ``oracle_sql()``.

They restate each operator's definition in plain SQL over the driver's
views (``documents``, ``benchmark``, ``embeddings``, ``conversations``).
Every float literal is written as ``DOUBLE`` so DuckDB does not switch to
decimal arithmetic; regex classes come from the same constants as the Spark
side.
"""

from __future__ import annotations

from quarry.functions.stopwords import ENGLISH_STOP_WORDS
from quarry.functions.text import (NON_SPACE_RUN, PUNCT_CLASS, TOKEN_PATTERN,
                                   WHITESPACE_CLASS)


def lit_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def dbl(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


STOP_LIST = "[" + ", ".join(lit_str(w) for w in ENGLISH_STOP_WORDS) + "]"


def tokens(expr: str, stop: bool = True) -> str:
    base = f"regexp_extract_all(lower(coalesce({expr}, '')), {lit_str(TOKEN_PATTERN)}, 1)"
    if stop:
        return f"list_filter({base}, lambda t: NOT list_contains({STOP_LIST}, t))"
    return base


def clean(expr: str) -> str:
    """G1 without NFKC (the driver's text is already NFKC-normal)."""
    x = f"coalesce(CAST({expr} AS VARCHAR), '')"
    x = f"regexp_replace({x}, {lit_str(PUNCT_CLASS)}, ' ', 'g')"
    x = f"regexp_replace({x}, {lit_str(WHITESPACE_CLASS + '+')}, ' ', 'g')"
    return f"trim({x})"


def count_words(expr: str) -> str:
    return f"len(regexp_extract_all(coalesce({expr}, ''), {lit_str(NON_SPACE_RUN)}, 1))"


def corpus_cte() -> str:
    return "corpus AS (SELECT doc_id AS docno, text FROM documents)"


def topics_cte() -> str:
    return f"topics AS (SELECT item_id AS qid, {clean('text')} AS query FROM benchmark)"


def index_ctes(docs: str = "corpus", text: str = "text", stop: bool = True,
               prefix: str = "") -> str:
    """tok / post / lex / stats CTEs for a single-field index of ``docs``."""
    p = prefix
    return f"""
{p}tok AS (SELECT docno, {tokens(text, stop)} AS toks FROM {docs}),
{p}post AS (
  SELECT docno, term, count(*) AS tf, any_value(dl) AS dl
  FROM (SELECT docno, CAST(len(toks) AS INTEGER) AS dl, unnest(toks) AS term FROM {p}tok)
  GROUP BY docno, term),
{p}lex AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM {p}post GROUP BY term),
{p}stats AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(len(toks)) AS DOUBLE) AS tokens,
               CAST(sum(len(toks)) AS DOUBLE) / count(*) AS avgdl FROM {p}tok)"""


def query_terms_cte(name: str, topics: str, query: str = "query", stop: bool = True) -> str:
    return f"""{name} AS (
  SELECT qid, term, CAST(count(*) AS DOUBLE) AS weight
  FROM (SELECT qid, unnest({tokens(query, stop)}) AS term FROM {topics})
  GROUP BY qid, term)"""


def idf(model: str, n: str = "n", df: str = "df") -> str:
    if model in ("BM25", "BM25F"):
        return f"log2(({n} - CAST({df} AS DOUBLE) + {dbl(0.5)}) / (CAST({df} AS DOUBLE) + {dbl(0.5)}))"
    return f"log2({n} / CAST({df} AS DOUBLE) + {dbl(1.0)})"


def tfn(model: str, k1: float = 1.2, b: float = 0.75, avgdl: str = "avgdl") -> str:
    norm = f"(({dbl(1.0 - b)} + {dbl(b)} * CAST(dl AS DOUBLE) / {avgdl}) * {dbl(k1)})"
    if model == "BM25":
        return f"(CAST(tf AS DOUBLE) * {dbl(k1 + 1.0)} / (CAST(tf AS DOUBLE) + {norm}))"
    return f"({dbl(k1)} * CAST(tf AS DOUBLE) / (CAST(tf AS DOUBLE) + {norm}))"


def retrieve_ctes(name: str, qterms: str, model: str, k: int, prefix: str = "") -> str:
    """Scored and ranked run ``name(qid, docno, score, rank)``."""
    p = prefix
    return f"""
{name}_w AS (SELECT qid, term, weight * {idf(model)} AS w
             FROM {qterms} JOIN {p}lex USING (term) CROSS JOIN {p}stats),
{name}_s AS (SELECT qid, docno, round(sum(w * {tfn(model)}), 6) AS score
             FROM {name}_w JOIN {p}post USING (term) CROSS JOIN {p}stats
             GROUP BY qid, docno),
{name} AS (SELECT * FROM (
    SELECT qid, docno, score,
           CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docno) AS INTEGER) AS rank
    FROM {name}_s) WHERE rank <= {k})"""


def qrels_cte(name: str = "qrels") -> str:
    return f"""{name} AS (
  SELECT DISTINCT b.item_id AS qid, d.doc_id AS docno, 0 AS iteration, 1 AS relevance
  FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""


def metrics_ctes(run: str, qrels: str = "qrels", group: str = "", topics: str = "topics",
                 out: str = "m") -> str:
    """Per-topic metrics ``out(<group>, qid, p_1 ... ap)`` (topics with hits)."""
    g = f"{group}, " if group else ""
    return f"""
{out}_q AS (SELECT qid, docno, max(relevance) AS relevance FROM {qrels}
            WHERE qid IN (SELECT qid FROM {topics}) GROUP BY qid, docno),
{out}_i AS (SELECT qid, count(*) AS num_rel,
              sum(CASE WHEN pos <= 5 THEN relevance / log2(pos + {dbl(1.0)}) ELSE {dbl(0.0)} END) AS idcg_5,
              sum(CASE WHEN pos <= 10 THEN relevance / log2(pos + {dbl(1.0)}) ELSE {dbl(0.0)} END) AS idcg_10
            FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY relevance DESC, docno) AS pos
                  FROM {out}_q WHERE relevance > 0) GROUP BY qid),
{out}_h AS (SELECT {g}r.qid, r.docno, r.rank, j.relevance,
              row_number() OVER (PARTITION BY {g}r.qid ORDER BY r.rank) AS hit_no
            FROM {run} r JOIN {out}_q j ON r.qid = j.qid AND r.docno = j.docno
            WHERE j.relevance > 0),
{out}_a AS (SELECT {g}qid,
              sum(CASE WHEN rank <= 1 THEN 1 ELSE 0 END) AS hits_1,
              sum(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) AS hits_5,
              sum(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) AS hits_10,
              sum(CASE WHEN rank <= 5 THEN relevance / log2(rank + {dbl(1.0)}) ELSE {dbl(0.0)} END) AS dcg_5,
              sum(CASE WHEN rank <= 10 THEN relevance / log2(rank + {dbl(1.0)}) ELSE {dbl(0.0)} END) AS dcg_10,
              sum(hit_no / rank) AS ap_sum
            FROM {out}_h GROUP BY {g}qid)"""


def metric_select(src: str = "a", ideal: str = "i") -> str:
    return f"""
  round(coalesce(hits_1, 0) / {dbl(1.0)}, 6) AS p_1,
  round(coalesce(hits_5, 0) / {dbl(5.0)}, 6) AS p_5,
  round(coalesce(hits_10, 0) / {dbl(10.0)}, 6) AS p_10,
  round(coalesce(hits_5, 0) / num_rel, 6) AS r_5,
  round(coalesce(hits_10, 0) / num_rel, 6) AS r_10,
  round(coalesce(dcg_5, {dbl(0.0)}) / idcg_5, 6) AS ndcg_5,
  round(coalesce(dcg_10, {dbl(0.0)}) / idcg_10, 6) AS ndcg_10,
  round(coalesce(ap_sum, {dbl(0.0)}) / num_rel, 6) AS ap"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes)


def splits_cte() -> str:
    return """splits AS (
  SELECT CAST(((doc_id % 3) + 3) % 3 AS INTEGER) AS src_ord, doc_id AS pos,
         CAST(min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS VARCHAR) AS para_id,
         coalesce(text, '') AS context, coalesce(text, '') AS raw_ocr,
         coalesce(source, '') AS publication_date
  FROM documents)"""


def test_records_cte() -> str:
    return qrels_cte("tq") + """,
test_records AS (
  SELECT CAST(tq.qid AS VARCHAR) AS query_id, CAST(tq.docno AS VARCHAR) AS para_id,
         b.text AS question, split_part(b.text, '.', 1) AS answer, b.text AS org_answer
  FROM tq JOIN benchmark b ON b.item_id = tq.qid)"""


def topic_order(col: str) -> str:
    return (f"CASE WHEN regexp_full_match({col}, '[0-9]+') THEN CAST({col} AS DECIMAL(38,0)) END "
            f"ASC NULLS LAST, {col} ASC")


def lengths_cte() -> str:
    return f"""lens AS (SELECT doc_id AS docno, {count_words('text')} AS n_words,
                 len({tokens('text', False)}) AS n_tokens FROM documents)"""


def binned_cte(col: str, bins: int, name: str = "h") -> str:
    return f"""{name}_r AS (SELECT CAST(min({col}) AS DOUBLE) AS mn, CAST(max({col}) AS DOUBLE) AS mx FROM lens),
{name}_b AS (SELECT CAST(CASE WHEN mx - mn > 0 THEN least(floor((CAST({col} AS DOUBLE) - mn) * {dbl(bins)} / (mx - mn)), {bins - 1})
                        ELSE 0 END AS INTEGER) AS bin
          FROM lens CROSS JOIN {name}_r WHERE {col} IS NOT NULL),
{name}_c AS (SELECT bin, count(*) AS count FROM {name}_b GROUP BY bin),
{name} AS (SELECT g.bin,
           round(mn + g.bin * (mx - mn) / {dbl(bins)}, 6) AS lo,
           round(mn + (g.bin + 1) * (mx - mn) / {dbl(bins)}, 6) AS hi,
           coalesce(c.count, 0) AS count
         FROM (SELECT CAST(unnest(range(0, {bins})) AS INTEGER) AS bin) g CROSS JOIN {name}_r
         LEFT JOIN {name}_c c ON c.bin = g.bin)"""


def rake_ctes(src: str, prefix: str = "rk", max_keywords: int = 3) -> str:
    """``{prefix}(docno, kw_rank, keyword)`` over ``src(docno, text)``."""
    from quarry.operators.keywords import RAKE_TOKEN
    p = prefix
    return f"""
{p}_l AS (SELECT docno, regexp_extract_all(lower(coalesce(text, '')), {lit_str(RAKE_TOKEN)}, 1) AS toks FROM {src}),
{p}_t AS (SELECT docno, generate_subscripts(toks, 1) - 1 AS pos, unnest(toks) AS tok FROM {p}_l),
{p}_b AS (SELECT docno, pos, tok,
            (NOT regexp_full_match(tok, '[\\p{{L}}\\p{{N}}]+') OR list_contains({STOP_LIST}, tok)) AS brk FROM {p}_t),
{p}_p AS (SELECT docno, pos, tok, brk,
            sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY docno ORDER BY pos
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS phrase FROM {p}_b),
{p}_w AS (SELECT docno, pos, tok, phrase, count(*) OVER (PARTITION BY docno, phrase) AS plen
          FROM {p}_p WHERE NOT brk),
{p}_s AS (SELECT *, sum(plen) OVER (PARTITION BY docno, tok) / count(*) OVER (PARTITION BY docno, tok) AS wscore
          FROM {p}_w),
{p}_ph AS (SELECT docno, phrase, round(sum(wscore), 6) AS score, min(pos) AS first_pos,
             string_agg(tok, ' ' ORDER BY pos) AS ptext, list(tok ORDER BY pos) AS words
           FROM {p}_s GROUP BY docno, phrase),
{p}_r AS (SELECT *, row_number() OVER (PARTITION BY docno ORDER BY score DESC, ptext DESC, first_pos) AS prank
          FROM {p}_ph),
{p}_x AS (SELECT docno, prank, generate_subscripts(words, 1) - 1 AS widx, unnest(words) AS keyword FROM {p}_r),
{p}_f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY docno, keyword ORDER BY prank, widx) AS rr
                         FROM {p}_x) WHERE rr = 1),
{p} AS (SELECT docno, kw_rank, keyword FROM (
          SELECT docno, keyword, CAST(row_number() OVER (PARTITION BY docno ORDER BY prank, widx) AS INTEGER) AS kw_rank
          FROM {p}_f) WHERE kw_rank <= {max_keywords})"""


def thesaurus_ctes(src: str, kw: str, prefix: str = "th", max_synonyms: int = 2) -> str:
    """``{prefix}(docno, kw_rank, keyword, synonyms)`` and
    ``{prefix}_e(docno, expansion)`` for every row of ``src``."""
    from quarry.operators.keywords import RAKE_TOKEN
    from quarry.sources.thesaurus import fixture_sql
    p = prefix
    return f"""
{p}_t AS (SELECT lower(lemma) AS lemma, sense_id, gloss, members FROM {fixture_sql()}),
{p}_c AS (SELECT docno, list_distinct(regexp_extract_all(coalesce(text, ''), {lit_str(RAKE_TOKEN)}, 1)) AS ctx FROM {src}),
{p}_s AS (SELECT k.docno, k.kw_rank, k.keyword, t.sense_id, t.members,
            len(list_intersect(string_split_regex(trim(t.gloss), {lit_str(WHITESPACE_CLASS + '+')}), c.ctx)) AS overlap
          FROM {kw} k JOIN {p}_t t ON lower(k.keyword) = t.lemma JOIN {p}_c c ON c.docno = k.docno),
{p}_b AS (SELECT docno, kw_rank, list_transform(list_filter(members, lambda m: lower(m) <> lower(keyword)),
                                                 lambda m: replace(m, '_', ' ')) AS cand
          FROM (SELECT *, row_number() OVER (PARTITION BY docno, kw_rank ORDER BY overlap DESC, sense_id DESC) AS r
                FROM {p}_s) WHERE r = 1),
{p}_d AS (SELECT docno, kw_rank,
            list_filter(cand, lambda x, i: NOT list_contains(cand[1:i - 1], x))[1:{max_synonyms}] AS synonyms
          FROM {p}_b),
{p} AS (SELECT k.docno, k.kw_rank, k.keyword, coalesce(d.synonyms, []) AS synonyms
        FROM {kw} k LEFT JOIN {p}_d d ON d.docno = k.docno AND d.kw_rank = k.kw_rank),
{p}_e AS (SELECT s.docno, coalesce(e.expansion, '') AS expansion FROM {src} s LEFT JOIN (
            SELECT docno, string_agg(array_to_string(list_concat([keyword], synonyms), ' '), ' ' ORDER BY kw_rank) AS expansion
            FROM {p} GROUP BY docno) e ON e.docno = s.docno)"""


def fielded_index_ctes(fields: list[tuple[str, str]], prefix: str = "f") -> str:
    """Fielded index CTEs; ``fields`` = [(source CTE, text column)] in field order."""
    p = prefix
    parts = " UNION ALL ".join(
        f"SELECT docno, {i} AS field, {tokens(col)} AS toks FROM {src}" for i, (src, col) in enumerate(fields))
    return f"""
{p}_tok AS ({parts}),
{p}_post AS (
  SELECT docno, field, term, count(*) AS tf, any_value(dl) AS dl
  FROM (SELECT docno, field, CAST(len(toks) AS INTEGER) AS dl, unnest(toks) AS term FROM {p}_tok)
  GROUP BY docno, field, term),
{p}_lex AS (SELECT term, count(DISTINCT docno) AS df FROM {p}_post GROUP BY term),
{p}_n AS (SELECT CAST(count(DISTINCT docno) AS DOUBLE) AS n FROM {p}_tok),
{p}_fs AS (SELECT field, CAST(sum(len(toks)) AS DOUBLE) / (SELECT n FROM {p}_n) AS avgdl FROM {p}_tok GROUP BY field)"""


def bm25f_ctes(name: str, qterms: str, weights, k: int, prefix: str = "f",
               k1: float = 1.2, b: float = 0.75) -> str:
    p = prefix
    wf = "CASE field " + " ".join(f"WHEN {i} THEN {dbl(w)}" for i, w in enumerate(weights)) + " END"
    return f"""
{name}_w AS (SELECT qid, term, weight * {idf('BM25F')} AS w
             FROM {qterms} JOIN {p}_lex USING (term) CROSS JOIN {p}_n),
{name}_t AS (SELECT qid, docno, term, t, w FROM (
               SELECT qid, docno, term,
                      sum({wf} * (CAST(tf AS DOUBLE) / ({dbl(1.0 - b)} + {dbl(b)} * CAST(dl AS DOUBLE) / avgdl))) AS t,
                      any_value(w) AS w
               FROM {name}_w JOIN {p}_post USING (term) JOIN {p}_fs USING (field)
               GROUP BY qid, docno, term) WHERE t > 0),
{name}_s AS (SELECT qid, docno, round(sum(w * t / ({dbl(k1)} + t)), 6) AS score FROM {name}_t GROUP BY qid, docno),
{name} AS (SELECT * FROM (
    SELECT qid, docno, score,
           CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docno) AS INTEGER) AS rank
    FROM {name}_s) WHERE rank <= {k})"""


def rm3_ctes(name: str, run: str, qterms: str, fb_docs: int = 3, fb_terms: int = 10,
             fb_lambda: float = 0.6, prefix: str = "") -> str:
    """``{name}(qid, term, weight)``: RM3 query model from ``run``."""
    p = prefix
    return f"""
{name}_fb AS (SELECT qid, docno,
                CASE WHEN tot > 0 THEN score / tot ELSE {dbl(1.0)} / cnt END AS dw
              FROM (SELECT qid, docno, score, sum(score) OVER (PARTITION BY qid) AS tot,
                           count(*) OVER (PARTITION BY qid) AS cnt
                    FROM {run} WHERE rank <= {fb_docs})),
{name}_p AS (SELECT qid, term, round(sum(CAST(tf AS DOUBLE) / dl * dw), 6) AS p
             FROM {name}_fb JOIN {p}post USING (docno) GROUP BY qid, term),
{name}_pt AS (SELECT qid, term, p / sum(p) OVER (PARTITION BY qid) AS p FROM (
                SELECT *, row_number() OVER (PARTITION BY qid ORDER BY p DESC, term) AS r FROM {name}_p)
              WHERE r <= {fb_terms}),
{name}_q AS (SELECT qid, term, weight / sum(weight) OVER (PARTITION BY qid) AS q FROM {qterms}),
{name} AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.term, b.term) AS term,
             round({dbl(fb_lambda)} * coalesce(a.q, {dbl(0.0)}) + {dbl(1.0 - fb_lambda)} * coalesce(b.p, {dbl(0.0)}), 9) AS weight
           FROM {name}_q a FULL OUTER JOIN {name}_pt b ON a.qid = b.qid AND a.term = b.term
           WHERE round({dbl(fb_lambda)} * coalesce(a.q, {dbl(0.0)}) + {dbl(1.0 - fb_lambda)} * coalesce(b.p, {dbl(0.0)}), 9) <> 0)"""


def hashed_vectors_ctes(name: str, ids: str, id_col: str, terms: str, tf: str, dims: int = 64) -> str:
    """``name(id, vec)`` of the hashed encoder over ``lex`` and ``stats``."""
    hexed = lambda a, n: f"CAST('0x' || substr(md5(term), {a}, {n}) AS INTEGER)"      # noqa: E731
    return f"""
{name}_w AS (SELECT {id_col}, {hexed(1, 4)} % {dims} AS dim,
               sum(CAST({tf} AS DOUBLE) * log2(n / CAST(df AS DOUBLE) + {dbl(1.0)})
                   * CASE WHEN {hexed(5, 1)} % 2 = 0 THEN {dbl(1.0)} ELSE {dbl(-1.0)} END) AS x
             FROM {terms} JOIN lex USING (term) CROSS JOIN stats GROUP BY ALL),
{name}_n AS (SELECT {id_col}, sqrt(sum(x * x)) AS norm FROM {name}_w GROUP BY {id_col}),
{name} AS (SELECT {id_col}, list(round(coalesce(x / nullif(norm, 0), {dbl(0.0)}), 6) + {dbl(0.0)} ORDER BY dim) AS vec
           FROM (SELECT {id_col} FROM {ids}) CROSS JOIN (SELECT range AS dim FROM range({dims}))
           LEFT JOIN {name}_n USING ({id_col}) LEFT JOIN {name}_w USING ({id_col}, dim) GROUP BY {id_col})"""


def dense_topk_ctes(name: str, docs: str, queries: str, k: int) -> str:
    """``name(qid, docno, score, rank)`` by exhaustive dot product."""
    return f"""
{name}_s AS (SELECT q.qid, d.docno,
               round(list_sum(list_transform(list_zip(q.vec, d.vec),
                     lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 6) AS score
             FROM {queries} q CROSS JOIN {docs} d),
{name} AS (SELECT * FROM (SELECT qid, docno, score,
             CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docno) AS INTEGER) AS rank FROM {name}_s)
           WHERE rank <= {k})"""


def label_metrics_ctes(run: str, doc_labels: str, query_labels: str, out: str = "lm") -> str:
    return f"""
{out}_i AS (SELECT q.qid, c.num_rel,
              (SELECT sum(1.0 / log2(i + {dbl(1.0)})) FROM range(1, least(5, c.num_rel) + 1) t(i)) AS idcg_5,
              (SELECT sum(1.0 / log2(i + {dbl(1.0)})) FROM range(1, least(10, c.num_rel) + 1) t(i)) AS idcg_10
            FROM {query_labels} q JOIN (SELECT label, count(*) AS num_rel FROM {doc_labels} GROUP BY label) c
              ON c.label = q.label),
{out}_h AS (SELECT r.qid, r.rank, 1 AS relevance,
              row_number() OVER (PARTITION BY r.qid ORDER BY r.rank) AS hit_no
            FROM {run} r JOIN {query_labels} q ON q.qid = r.qid JOIN {doc_labels} d ON d.docno = r.docno
            WHERE d.label = q.label),
{out}_a AS (SELECT qid,
              sum(CASE WHEN rank <= 1 THEN 1 ELSE 0 END) AS hits_1,
              sum(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) AS hits_5,
              sum(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) AS hits_10,
              sum(CASE WHEN rank <= 5 THEN relevance / log2(rank + {dbl(1.0)}) ELSE {dbl(0.0)} END) AS dcg_5,
              sum(CASE WHEN rank <= 10 THEN relevance / log2(rank + {dbl(1.0)}) ELSE {dbl(0.0)} END) AS dcg_10,
              sum(hit_no / rank) AS ap_sum
            FROM {out}_h GROUP BY qid)"""


def questions_cte() -> str:
    return ("questions AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS qid, "
            "text AS query FROM conversations WHERE role = 'user')")


def passages_ctes(run_text: str, name: str = "passages", length: int = 256, stride: int = 128) -> str:
    """``name(qid, docno, rank, passage_no, text)`` from ``run_text(qid, docno, rank, text)``."""
    return f"""
{name}_w AS (SELECT qid, docno, rank, regexp_extract_all(coalesce(text, ''), {lit_str(NON_SPACE_RUN)}, 1) AS toks
             FROM {run_text}),
{name}_s AS (SELECT qid, docno, rank, toks, generate_subscripts(starts, 1) - 1 AS passage_no, unnest(starts) AS st
             FROM (SELECT *, range(0, greatest(len(toks) - {length - stride} - 1, 0) + 1, {stride}) AS starts
                   FROM {name}_w)),
{name} AS (SELECT qid, docno, rank, CAST(passage_no AS INTEGER) AS passage_no,
             array_to_string(toks[st + 1 : st + {length}], ' ') AS text FROM {name}_s)"""


def coverage_ctes(src: str, topics: str, keys: str, name: str = "cov", query: str = "query") -> str:
    """``name(<keys>, text, score)``: idf-weighted query-term coverage."""
    return f"""
{name}_q AS (SELECT DISTINCT qid, unnest({tokens(query)}) AS term FROM {topics}),
{name}_w AS (SELECT qid, term, log2(n / CAST(df AS DOUBLE) + {dbl(1.0)}) AS idf
             FROM {name}_q JOIN lex USING (term) CROSS JOIN stats),
{name}_t AS (SELECT qid, sum(idf) AS total FROM {name}_w GROUP BY qid),
{name}_p AS (SELECT DISTINCT {keys}, unnest({tokens('text')}) AS term FROM {src}),
{name}_f AS (SELECT {', '.join('p.' + k for k in keys.split(', '))}, sum(w.idf) AS found
             FROM {name}_p p JOIN {name}_w w ON w.qid = p.qid AND w.term = p.term GROUP BY ALL),
{name} AS (SELECT s.*, round(coalesce(f.found / t.total, {dbl(0.0)}), 6) AS score
           FROM {src} s LEFT JOIN {name}_f f USING ({keys}) LEFT JOIN {name}_t t USING (qid))"""


def max_passage_ctes(scored: str, name: str = "mp") -> str:
    return f"""
{name}_b AS (SELECT qid, docno, score, text FROM (
              SELECT *, row_number() OVER (PARTITION BY qid, docno ORDER BY score DESC, passage_no) AS r
              FROM {scored}) WHERE r = 1),
{name} AS (SELECT qid, docno, score, text,
             CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docno) AS INTEGER) AS rank FROM {name}_b)"""


def context_cte(ranked: str, name: str = "ctx", n: int = 3) -> str:
    return f"""{name} AS (
  SELECT qid, string_agg('CONTEXT NUMBER: ' || rank || chr(10) || 'DOCUMENT ID: ' || rank || chr(10)
                         || CAST(docno AS VARCHAR) || chr(10) || chr(10) || coalesce(text, '') || chr(10) || chr(10),
                         '' ORDER BY rank) AS context
  FROM {ranked} WHERE rank <= {n} GROUP BY qid)"""


def metrics_table_sql(runs: list[tuple[str, str]], qrels: str = "qrels", topics: str = "topics",
                      cols=("p_1", "p_5", "p_10", "r_5", "r_10", "ndcg_5", "ndcg_10", "map"),
                      map_name: str = "map") -> tuple[str, str]:
    """(CTEs, final SELECT) of the mean metric table over named runs.
    ``runs`` = [(name SQL expression, run CTE)]."""
    union = " UNION ALL ".join(f"SELECT {n} AS name, qid, docno, rank FROM {r}" for n, r in runs)
    ctes = (f"allruns AS ({union}),\n" + metrics_ctes("allruns", qrels, "name", topics).strip() + f""",
mper AS (SELECT a.name, a.qid, {metric_select()} FROM m_a a JOIN m_i i USING (qid)),
mnj AS (SELECT count(DISTINCT qid) AS n FROM m_q WHERE relevance > 0)""")
    src = {c: ("ap" if c == map_name else c) for c in cols}
    sel = ", ".join(f"round(coalesce(sum(mper.{src[c]}), {dbl(0.0)}) / max(mnj.n), 6) AS {c}" for c in cols)
    final = (f" SELECT nm.name, {sel} FROM (SELECT DISTINCT name FROM allruns) nm"
             f" LEFT JOIN mper USING (name) CROSS JOIN mnj GROUP BY nm.name")
    return ctes, final

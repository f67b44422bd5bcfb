"""DuckDB SQL of the operators that SQL can express."""

TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON len(q.x) = len(c.x) AND c.vec_id IS DISTINCT FROM q.vec_id
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scored)
WHERE rank <= 5
"""


# a word: a run of anything but ASCII white space
WORD = r"'[^\x20\x09-\x0D]+'"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# marks that are escaped in a text: after "[" or "<", backslashes that stand there already, then one of these
CONTROL = r"'[\[<]\\*(?:/?TURN[:\]]|PART:|/?INST\]|<SYS>>|</SYS>>|/?s>|\|)'"

CHAT = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  -- a turn is [TURN:role]text[/TURN]; every control string in the text has one more character
  SELECT *, 14 + length(role) + length(text) + len(regexp_extract_all(text, {CONTROL})) AS chars FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

JACCARD = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {WORD}) AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1)) + 1)) AS i FROM d)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
  JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, nx.n, ny.n
  HAVING 100 * count(*) >= 85 * (nx.n + ny.n - count(*))
), reach AS (
  SELECT a, b FROM links
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least_of AS (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(l.b, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_of l USING (doc_id)
"""

MIXING = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {WORD})) AS BIGINT) AS size,
         coalesce('s' || source, 't') AS s, coalesce(CAST(doc_id AS VARCHAR), '') AS k
  FROM documents
), u AS (
  SELECT *, CAST(CAST('0x' || substr(md5('mix-1|' || k), 1, 13) AS BIGINT) AS DOUBLE) / CAST(4503599627370496 AS DOUBLE) AS u FROM d
), box AS (
  SELECT *, CAST(floor(u * CAST(64 AS DOUBLE)) AS INTEGER) AS bucket,
         CASE WHEN u < 0.5 THEN size ELSE -size END AS slope,
         CASE WHEN u < 0.5 THEN level ELSE 512 - level END AS class
  FROM (SELECT *, CASE WHEN size = 0 THEN 0
               ELSE CAST(floor(ln(CAST(size AS DOUBLE)) / ln(CAST(2 AS DOUBLE)) * CAST(4 AS DOUBLE)) AS INTEGER) + 1 END AS level FROM u)
), src AS (
  SELECT s, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size) AS DOUBLE) * CAST(3 AS DOUBLE) AS cap FROM box GROUP BY s
), weighed AS (
  SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY s) - 1) % 3 AS INTEGER) + 1] AS DOUBLE) AS weight FROM src
), levels AS (
  SELECT *, cap / weight AS o,
         (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER b, CAST(0 AS DOUBLE)))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER b, CAST(0 AS DOUBLE))) AS level
  FROM weighed WINDOW b AS (ORDER BY cap / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goals AS (
  SELECT s, source_size, least(cap, (SELECT arg_min(level, o) FROM levels WHERE level * weight <= cap) * weight) AS target FROM levels
), ranked AS (
  SELECT box.*, goals.source_size, goals.target,
         CAST(row_number() OVER (PARTITION BY box.s ORDER BY class, bucket, slope, u, k) AS DOUBLE) AS rank,
         CASE WHEN goals.source_size > 0 THEN goals.target / CAST(goals.source_size AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS rate,
         CAST(CAST('0x' || substr(md5('mix-1|offset|' || box.s), 1, 13) AS BIGINT) AS DOUBLE) / CAST(4503599627370496 AS DOUBLE) AS shift
  FROM box JOIN goals USING (s)
)
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM (
  SELECT *, CAST(floor(rank * rate + shift) - floor((rank - CAST(1 AS DOUBLE)) * rate + shift) AS BIGINT) AS copies FROM ranked)
"""

REPEATS = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) AS ws FROM documents
), starts AS (
  SELECT r, i FROM (SELECT r, i, array_to_string(ws[i:i + 34], ' ') AS s FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d))
  QUALIFY count(*) OVER (PARTITION BY s) > 1
), words AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
covered AS (
  SELECT r, i, w, count(starts.i) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) > 0 AS gone
  FROM words LEFT JOIN starts USING (r, i)
), kept AS (
  SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (NOT gone) AS text FROM covered GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

NEAR_VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), u AS (
  SELECT vec_id, list_transform(x, lambda c: c / sqrt(list_sum(list_transform(x, lambda e: e * e)))) AS x
  FROM v WHERE len(list_filter(x, lambda c: c <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_inner_product(a.x, b.x) >= CAST(0.95 AS DOUBLE)
), reach AS (
  SELECT a, b FROM links
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least_of AS (SELECT a AS vec_id, min(b) AS b FROM reach GROUP BY a),
many AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, least(e.vec_id, coalesce(b, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN least_of USING (vec_id) LEFT JOIN many USING (vec_id)
"""


def _merkle(levels: int = 7) -> str:
    """Trees of up to 16 ** ``levels`` leaves a source, and as many sources.
    A level hashes runs of 16 nodes where a tree has more than one."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"            # noqa: E731
    # CRC-32 by bits: a step of 256 shifts, any other value is a byte that comes in
    crc = f"""list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
      lambda c: list_prepend(CAST(ord(c) AS BIGINT), [{', '.join(['CAST(256 AS BIGINT)'] * 8)}])))),
      lambda a, s: CASE WHEN s < 256 THEN xor(a, s) WHEN a % 2 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END)"""
    ctes = [f"""leaves AS (
  SELECT doc_id, source, {leaf('text')} AS leaf,
         CASE WHEN xor({crc}, CAST(4294967295 AS BIGINT)) % 5 = 0
              THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS other FROM documents
), at0 AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves
), t0 AS (SELECT source, pos, leaf AS h FROM at0)"""]

    def grow(name, group):
        for i in range(levels):
            ctes.append(f"""{name}{i + 1} AS (
  SELECT {group}, pos // 16 AS pos,
         CASE WHEN any_value(many) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h
  FROM (SELECT *, count(*) OVER (PARTITION BY {group}) AS many FROM {name}{i}) GROUP BY {group}, pos // 16)""")

    def runs(name, group):
        # of each node: those of its run before it and after it, none in a tree that has ended
        for i in range(levels):
            ctes.append(f"""{name}s{i} AS (
  SELECT {group}, pos, CASE WHEN many = 1 THEN NULL ELSE coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS b{name}{i},
         CASE WHEN many = 1 THEN NULL ELSE coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS a{name}{i}
  FROM (SELECT *, count(*) OVER (PARTITION BY {group}) AS many FROM {name}{i}) WINDOW w AS (PARTITION BY {group}, pos // 16 ORDER BY pos))""")

    grow("t", "source")
    ctes.append(f"""roots AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS spos FROM t{levels}),
r0 AS (SELECT 0 AS g, spos AS pos, subroot AS h FROM roots)""")
    grow("r", "g")
    runs("t", "source")
    runs("r", "g")
    joins = " ".join(
        [f"JOIN ts{i} ON ts{i}.source IS NOT DISTINCT FROM a.source AND ts{i}.pos = a.pos // {16 ** i}" for i in range(levels)]
        + ["JOIN roots ON roots.source IS NOT DISTINCT FROM a.source"]
        + [f"JOIN rs{i} ON rs{i}.pos = roots.spos // {16 ** i}" for i in range(levels)])
    steps = [f"{n}{i}" for n in "tr" for i in range(levels)]
    proof = " || ".join(f"coalesce(b{x} || a{x}, '')" for x in steps)
    ctes.append(f"""paths AS (
  SELECT doc_id, leaf, subroot, (SELECT h FROM r{levels}) AS root, sha256({proof}) AS proof_sha256, coalesce(other, leaf) AS f0,
         {', '.join(f'b{x}, a{x}' for x in steps)} FROM at0 a {joins})""")
    for i, x in enumerate(steps):
        ctes.append(f"f{i + 1} AS (SELECT * REPLACE (CASE WHEN b{x} IS NULL THEN f0 ELSE sha256(b{x} || f0 || a{x}) END AS f0) "
                    f"FROM {'paths' if i == 0 else f'f{i}'})")
    return ("WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, leaf, subroot, root, proof_sha256, f0 AS folded_root, f0 = root AS verified FROM f{len(steps)}""")


SQL = {
    "op3_chat_format": CHAT,
    "op4_jaccard_join": JACCARD,
    "op6_mixing": MIXING,
    "op7_substring_dedup": REPEATS,
    "op8_embedding_dedup": NEAR_VECTORS,
    "op11_topk_search": TOPK,
    "op12_merkle": _merkle(5),
}

"""DuckDB SQL with the rows of the registered queries, written independently of the plans."""

from __future__ import annotations

from larkspur.functions.text import STOPWORDS
from larkspur.operators.classify import ANCHORS, PATTERNS
from larkspur.operators.evaluate import UNIMPORTANT
from larkspur.operators.fusion import GATED, TYPE_WEIGHTS
from larkspur.plans.queries import QUERY, QUESTIONS, VIEW_WEIGHTS
from larkspur.sources.files import EXTENSIONS


def strings(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def classes(x: str) -> str:
    c = f"regexp_replace(regexp_replace({x}, '[^\\x00-\\x7F]', 'bb', 'g'), '[aeiou]', 'V', 'g')"
    c = f"regexp_replace(regexp_replace({c}, '[^Vy]', 'C', 'g'), '^y', 'C')"
    for _ in range(3):
        c = f"replace(replace({c}, 'Cy', 'CV'), 'Vy', 'VC')"
    return c


WORDS = f"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{Nd}}]+'), lambda w: octet_length(encode(w)) >= 2 AND w NOT IN ({strings(STOPWORDS)}))"


def stems(texts: str) -> str:
    """CTEs from texts (kind, id, text) to words (kind, id, w) and stems (w, stem)."""
    short = "regexp_matches(c, '^C*V+C+V*$') AND c LIKE '%CVC' AND right(b, 1) NOT IN ('w', 'x', 'y')"
    double = "length(b) >= 2 AND right(b, 1) = left(right(b, 2), 1) AND regexp_matches(right(b, 1), '[a-z0-9]') AND c LIKE '%C'"
    return f"""texts AS ({texts}),
        words AS (SELECT kind, id, unnest({WORDS}) AS w FROM texts),
        s1 AS (SELECT DISTINCT w, CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN left(w, length(w) - 2) WHEN w LIKE '%ss' THEN w WHEN w LIKE '%s' THEN left(w, length(w) - 1) ELSE w END AS a FROM words),
        s2 AS (SELECT *, CASE WHEN a LIKE '%eed' THEN NULL WHEN a LIKE '%ed' THEN left(a, length(a) - 2) WHEN a LIKE '%ing' THEN left(a, length(a) - 3) END AS e FROM s1),
        s3 AS (SELECT *, CASE WHEN regexp_matches(e, '[aeiou]|.y') THEN e END AS b FROM s2),
        s4 AS (SELECT *, {classes('b')} AS c, CASE WHEN a LIKE '%eed' THEN {classes("left(a, length(a) - 3)")} END AS k FROM s3),
        stems AS (SELECT w, CASE WHEN octet_length(encode(w)) <= 2 THEN w
            WHEN a LIKE '%eed' THEN CASE WHEN contains(k, 'VC') THEN left(a, length(a) - 1) ELSE a END
            WHEN b IS NULL THEN a
            WHEN b LIKE '%at' OR b LIKE '%bl' OR b LIKE '%iz' THEN b || 'e'
            WHEN {double} AND right(b, 1) NOT IN ('l', 's', 'z') THEN left(b, length(b) - 1)
            WHEN {short} THEN b || 'e' ELSE b END AS stem FROM s4)"""


DOCS = "SELECT 'd' AS kind, doc_id AS id, text FROM documents"
ONE = f"{DOCS} UNION ALL SELECT 'q', 0, '{QUERY}'"
PASSAGES = f"{DOCS} UNION ALL SELECT 'q', item_id, text FROM benchmark"
BOTH = f"{DOCS} UNION ALL SELECT 'q', item_id, b.text FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id"


def terms(texts: str) -> str:
    return stems(texts) + ", terms AS (SELECT kind, id, stem AS term, count(*) AS n FROM words JOIN stems USING (w) GROUP BY ALL)"


def bm25(texts: str, limit: int, where: str = "TRUE") -> str:
    """CTEs down to lexical (query_id, drawer_id, score, rank)."""
    return f"""{terms(texts)},
        post AS (SELECT id AS drawer_id, term, n / sum(n) OVER (PARTITION BY id) AS tf FROM terms WHERE kind = 'd'),
        df AS (SELECT term, count(*) AS df FROM post GROUP BY term), total AS (SELECT count(DISTINCT drawer_id) AS total FROM post),
        scores AS (SELECT q.id AS query_id, p.drawer_id, sum(q.n * greatest(ln((total - df + 0.5) / (df + 0.5)), 0) * tf * 2.5 / (tf + 1.5)) AS score
            FROM terms q JOIN post p USING (term) JOIN df USING (term), total WHERE q.kind = 'q' AND {where} GROUP BY ALL),
        lexical AS (SELECT query_id, drawer_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, drawer_id))::INT AS rank FROM scores QUALIFY rank <= {limit})"""


def near(limit: int, queries: str = "SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0", where: str = "TRUE") -> str:
    """CTEs down to dense (query_id, drawer_id, score, rank)."""
    return f"""asked AS ({queries}),
        cosines AS (SELECT q.vec_id AS query_id, v.vec_id AS drawer_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM asked q, embeddings v WHERE {where}),
        dense AS (SELECT query_id, drawer_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, drawer_id))::INT AS rank FROM cosines QUALIFY rank <= {limit})"""


def fused(weight: str, limit: int, extra: str = "") -> str:
    """CTE fused (query_id, [weight,] drawer_id, score, rank) of lexical and dense lists."""
    by = "query_id, weight" if extra else "query_id"
    return f"""both_lists AS (SELECT query_id, drawer_id, {weight} AS weight, a.rank AS x, b.rank AS y FROM lexical a FULL JOIN dense b USING (query_id, drawer_id) {extra}),
        sums AS (SELECT query_id, weight, drawer_id, coalesce(weight / (60 + x), 0) + coalesce((1 - weight) / (60 + y), 0) AS score FROM both_lists),
        fused AS (SELECT {by}, drawer_id, score, (row_number() OVER (PARTITION BY {by} ORDER BY round(score, 12) DESC, drawer_id))::INT AS rank FROM sums QUALIFY rank <= {limit})"""


LISTS = f"{bm25(BOTH, 40)}, {near(40, 'SELECT e.vec_id, e.embedding FROM embeddings e JOIN benchmark b ON b.item_id = e.vec_id')}"
HASHED = "SELECT doc_id AS drawer_id, text AS content, source AS wing, lang AS room, sha256(concat(coalesce(text, ''), chr(0), source, chr(0), 'facts')) AS content_hash FROM documents"
STORED = f"items AS ({HASHED}), stored AS (SELECT *, 'facts' AS hall, wing AS source_file, 'file' AS source_type FROM items QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY drawer_id) = 1)"
BANDED = f"{STORED}, banded AS (SELECT * REPLACE (room || '-' || (length(content) // 1500) AS room) FROM stored)"
TUNNELS = f"""WITH {BANDED} SELECT room, string_agg(DISTINCT wing, ',' ORDER BY wing) AS wings, count(DISTINCT drawer_id) AS drawers FROM banded
    GROUP BY room HAVING count(DISTINCT wing) > 1"""

SAID = """said AS (SELECT o_orderkey AS seq, 'customer_' || o_custkey AS subject, 'order_status' AS predicate, lower(o_orderstatus) AS object, strftime(o_orderdate, '%Y-%m-%d') AS valid_from,
        lead(strftime(o_orderdate, '%Y-%m-%d')) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to, ' Customer ' || o_custkey AS subject_said, o_orderstatus AS object_said FROM orders),
    triples AS (SELECT subject, predicate, object, valid_from, valid_to, 1.0::DOUBLE AS confidence, seq FROM said
        QUALIFY NOT coalesce(bool_or(valid_to IS NULL) OVER (PARTITION BY subject, predicate, object ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE)),
    entities AS (SELECT lower(replace(trim(name), ' ', '_')) AS entity_id, arg_min(name, 2 * seq + side) AS name FROM (SELECT seq, 0 AS side, subject_said AS name FROM said UNION ALL SELECT seq, 1, object_said FROM said) GROUP BY 1)"""
ASKED = "asked AS (SELECT * FROM (VALUES ('Customer 1', NULL), ('customer_4', '2024-01-01'), ('CUSTOMER 7', '1995-06-17'), ('F', '1996-01-01')) t(asked, as_of))"
HOLDS = "(as_of IS NULL OR ((valid_from IS NULL OR valid_from <= as_of) AND (valid_to IS NULL OR valid_to >= as_of)))"


def about(own: str, other: str, direction: str) -> str:
    names = {own: "asked", other: "e.name"}
    return f"""SELECT asked, '{direction}' AS direction, {names['subject']} AS subject_name, predicate, {names['object']} AS object_name, valid_from, valid_to, valid_to IS NULL AS current
        FROM triples t JOIN asked a ON t.{own} = lower(replace(trim(asked), ' ', '_')) JOIN entities e ON e.entity_id = t.{other} WHERE {HOLDS}"""


OUT, IN = about("subject", "object", "outgoing"), about("object", "subject", "incoming")
ACTS = """acts AS (SELECT event_id AS seq, 'user_' || user_id AS subject, 'did' AS predicate, lower(event_type) AS object FROM events)"""
WINGS = "wing_table AS (SELECT wing, 'project' AS type, max(room) AS keywords FROM stored GROUP BY wing)"


def summary(where: str = "TRUE") -> str:
    return f"""WITH {BANDED}, {WINGS},
        counts AS (SELECT * FROM (SELECT wing, room, count(*) AS n FROM banded GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY wing ORDER BY n DESC, room) <= 5),
        best AS (SELECT wing, string_agg(room || '(' || n || ')', ' | ' ORDER BY n DESC, room) AS rooms FROM counts GROUP BY wing),
        a AS (SELECT string_agg(upper(wing) || '(' || type || ') | ' || keywords || coalesce(chr(10) || '  ROOMS: ' || rooms, ''), chr(10) ORDER BY wing) AS x FROM wing_table LEFT JOIN best USING (wing) WHERE {where}),
        newest AS (SELECT * FROM banded ORDER BY drawer_id DESC LIMIT 5),
        b AS (SELECT string_agg('  ' || wing || '/' || room || ' [' || hall || '] ' || source_file, chr(10) ORDER BY drawer_id DESC) AS y FROM newest)
        SELECT '## L1 — CRITICAL FACTS' || chr(10) || x || chr(10) || 'RECENT:' || chr(10) || y AS text FROM a, b"""


def chosen(types: dict, key: str) -> str:
    return "CASE " + key + "".join(f" WHEN {i} THEN {w}" for i, w in enumerate(types.values())) + " END"


TURNS = "turns AS (SELECT conv_id, turn, role AS speaker, text AS content FROM conversations)"
VIEW = """views AS (
        SELECT conv_id, 'L0' AS hall, string_agg(speaker || ': ' || content, chr(10) ORDER BY turn) AS content FROM turns GROUP BY conv_id UNION ALL
        SELECT conv_id, 'L1', string_agg(content, chr(10) ORDER BY turn) FROM turns WHERE lower(speaker) IN ('user', 'human') GROUP BY conv_id UNION ALL
        SELECT conv_id, 'L2', string_agg(content, chr(10) ORDER BY turn) FROM (SELECT * FROM turns WHERE lower(speaker) IN ('user', 'human') QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3) GROUP BY conv_id)"""
CHUNKS = """chunked AS (SELECT conv_id AS session, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS chunk, turn, role || ': ' || text || CASE WHEN turn % 2 = 1 THEN ' [image: a picture]' ELSE '' END AS line FROM conversations),
    chunks AS (SELECT session, chunk, string_agg(line, chr(10) ORDER BY turn) AS content, string_agg('D:' || turn, ',' ORDER BY turn) AS source_file FROM chunked GROUP BY ALL HAVING octet_length(encode(string_agg(line, chr(10) ORDER BY turn))) >= 5)"""
VIEWS_OF = "(drawer_id // 3)::VARCHAR"
MERGE = f"{near(1 << 30)}, weighted AS (SELECT query_id, {VIEWS_OF} AS source_file, CASE drawer_id % 3 WHEN 0 THEN {VIEW_WEIGHTS['L0']} WHEN 1 THEN {VIEW_WEIGHTS['L1']} ELSE {VIEW_WEIGHTS['L2']} END * score AS s FROM dense)"


def sessions(function: str, having: str = "") -> str:
    return f"merged AS (SELECT query_id, source_file, {function}(s) AS score FROM weighted GROUP BY ALL {having}), sessions AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, source_file))::INT AS rank FROM merged QUALIFY rank <= 10)"


SHARES = ", ".join(f"round(100 * avg(CASE WHEN first <= {k} THEN 1.0 ELSE 0.0 END), 6) AS r{k}" for k in (1, 5, 10))
ANSWER = f"""contains(lower(d.text), lower(b.text)) OR coalesce(len(list_filter(w, lambda x: contains(lower(d.text), x))) / nullif(len(w), 0) >= 0.6, FALSE)"""
ANSWER_WORDS = f"""list_filter(regexp_split_to_array(lower(text), '[ ,.;:!?"'']+'), lambda x: octet_length(encode(x)) > 2 AND x NOT IN ({strings(UNIMPORTANT)}))"""
OWN = "source = 'src' || (query_id % 20)"
FIRST_OTHER = f"WITH {near(11)}, firsts AS (SELECT * FROM dense WHERE drawer_id <> query_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) = 1), found AS (SELECT p.label AS predicted, a.label AS actual FROM firsts f JOIN embeddings p ON p.vec_id = f.drawer_id JOIN embeddings a ON a.vec_id = f.query_id)"
TYPES = "CASE " + " ".join("WHEN regexp_matches(trim(query), '" + p.replace("'", "''") + f"') THEN '{t}'" for p, t in PATTERNS) + " ELSE 'single-session-user' END"
UNITS = "CASE " + " ".join(f"WHEN n < {1024 ** (k + 1)} THEN printf('%.1f {u}B', n / {1024 ** k}::DOUBLE)" for k, u in enumerate("KMGTP", 1)) + " END"
EXT = "regexp_extract(path, '(\\.[^./]*)$', 1)"

SQL = {
    "term_frequencies": f"WITH {terms(DOCS)} SELECT term, id AS drawer_id, round(n / sum(n) OVER (PARTITION BY id), 9) AS tf FROM terms",
    "vocabulary": f"WITH {stems(DOCS)} SELECT w AS word, stem FROM stems",
    "corpus_statistics": f"WITH {terms(DOCS)}, s AS (SELECT id, sum(n) AS n FROM terms GROUP BY id) SELECT count(*) AS total_docs, round(avg(n), 9) AS avg_doc_len FROM s",
    "stored_drawers": f"WITH {STORED} SELECT drawer_id, content_hash, wing, room, hall, source_type FROM stored",
    "added_drawers": f"WITH items AS ({HASHED}) SELECT min(drawer_id) AS drawer_id, content_hash FROM items GROUP BY content_hash HAVING count(*) FILTER (drawer_id % 2 = 0) = 0",
    "listed_drawers": f"WITH {STORED} SELECT drawer_id, wing, room FROM stored WHERE wing = 'src3' AND room = 'en'",
    "drawer_count": f"WITH {STORED} SELECT count(*) AS drawers FROM stored",
    "wing_names": "SELECT source AS name, min(doc_id) AS id FROM documents GROUP BY 1",
    "room_names": "SELECT lang AS name, source AS wing, min(doc_id) AS id FROM documents GROUP BY 1, 2",
    "detected_rooms": f"""WITH {terms(DOCS)}, t AS (SELECT id, term, n FROM terms QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, term) <= 2),
        r AS (SELECT id, string_agg(term, '-' ORDER BY n DESC, term) AS room FROM t GROUP BY id) SELECT doc_id AS drawer_id, coalesce(room, 'general') AS room FROM documents LEFT JOIN r ON r.id = doc_id""",
    "status": f"""WITH {STORED}, {SAID} SELECT (SELECT count(DISTINCT wing) FROM stored) AS wings, (SELECT count(*) FROM (SELECT DISTINCT wing, room FROM stored)) AS rooms, (SELECT count(*) FROM stored) AS drawers,
        (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM triples) AS triples""",
    "wing_breakdown": f"""WITH {STORED}, w AS (SELECT DISTINCT wing FROM stored UNION ALL SELECT 'empty')
        SELECT w.wing, count(s.drawer_id) AS drawers, count(e.vec_id) AS embedded FROM w LEFT JOIN stored s ON s.wing = w.wing LEFT JOIN embeddings e ON e.vec_id = s.drawer_id GROUP BY 1""",
    "tunnels": TUNNELS,
    "tunnels_between": TUNNELS + " AND bool_or(wing = 'src1') AND bool_or(wing = 'src2')",
    "pending_embeddings": f"WITH {STORED} SELECT drawer_id FROM stored WHERE drawer_id NOT IN (SELECT vec_id FROM embeddings)",
    "embedded_count": f"WITH {STORED} SELECT count(*) AS embedded FROM stored WHERE drawer_id IN (SELECT vec_id FROM embeddings)",
    "bm25_single": f"WITH {bm25(ONE, 10)} SELECT query_id::BIGINT AS query_id, drawer_id, round(score, 9) AS score, rank FROM lexical",
    "bm25_passages": f"WITH {bm25(PASSAGES, 10)} SELECT query_id, drawer_id, round(score, 9) AS score, rank FROM lexical",
    "bm25_wing": f"WITH {bm25(ONE, 5, where='''p.drawer_id IN (SELECT doc_id FROM documents WHERE source = 'src4' AND lang = 'en')''')} SELECT query_id::BIGINT AS query_id, drawer_id, round(score, 9) AS score, rank FROM lexical",
    "bm25_scope": f"WITH {bm25(PASSAGES, 5, where='''p.drawer_id IN (SELECT doc_id FROM documents WHERE source IN ('src1', 'src7'))''')} SELECT query_id, drawer_id, round(score, 9) AS score, rank FROM lexical",
    "bm25_by_wing": f"""WITH {terms(PASSAGES)}, post AS (SELECT source, id AS drawer_id, term, n / sum(n) OVER (PARTITION BY id) AS tf FROM terms JOIN documents ON doc_id = id WHERE kind = 'd'),
        df AS (SELECT source, term, count(*) AS df FROM post GROUP BY ALL), total AS (SELECT source, count(DISTINCT drawer_id) AS total FROM post GROUP BY 1),
        scores AS (SELECT q.id AS query_id, p.drawer_id, sum(q.n * greatest(ln((total - df + 0.5) / (df + 0.5)), 0) * tf * 2.5 / (tf + 1.5)) AS score
            FROM terms q JOIN post p ON p.term = q.term AND p.source = 'src' || (q.id % 20) JOIN df ON df.term = p.term AND df.source = p.source JOIN total ON total.source = p.source WHERE q.kind = 'q' GROUP BY ALL)
        SELECT query_id, drawer_id, round(score, 9) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY round(scores.score, 12) DESC, drawer_id))::INT AS rank FROM scores QUALIFY rank <= 10""",
    "vector_search": f"WITH {near(10)} SELECT query_id, drawer_id, round(score, 9) AS score, rank FROM dense",
    "vector_search_wing": f"WITH {near(5, where='v.label < 3')} SELECT query_id, drawer_id, round(score, 9) AS score, rank FROM dense",
    "label_means": "WITH x AS (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT label, i::INT AS i, round(avg(x), 9) AS x FROM x GROUP BY 1, 2",
    "hybrid": f"WITH {LISTS}, {fused('0.5', 10)} SELECT query_id, drawer_id, round(score, 9) AS score, rank FROM fused",
    "hybrid_auto": f"WITH {LISTS}, {fused(chosen(TYPE_WEIGHTS, 'query_id % 6'), 10)} SELECT query_id, drawer_id, round(score, 9) AS score, rank FROM fused",
    "hybrid_sweep": f"WITH {LISTS}, {fused('u', 10, ', (SELECT unnest([0.4, 0.5, 0.6, 0.7])::DOUBLE AS u)')} SELECT query_id, weight, drawer_id, round(score, 9) AS score, rank FROM fused",
    "hybrid_recency": f"""WITH {LISTS}, {fused('0.5', 10)},
        r AS (SELECT query_id, drawer_id, score + coalesce(0.5 * (drawer_id - min(drawer_id) OVER w) / nullif(max(drawer_id) OVER w - min(drawer_id) OVER w, 0), 0) AS score FROM fused WINDOW w AS (PARTITION BY query_id))
        SELECT query_id, drawer_id, round(score, 9) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, drawer_id))::INT AS rank FROM r""",
    "multiview": f"""WITH {near(60)}, c AS (SELECT query_id, drawer_id, {VIEWS_OF} AS source_file, score FROM dense QUALIFY row_number() OVER (PARTITION BY query_id, source_file ORDER BY rank) = 1)
        SELECT query_id, drawer_id, source_file, round(score, 9) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY round(c.score, 12) DESC, drawer_id))::INT AS rank FROM c QUALIFY rank <= 5""",
    "merged_views_sum": f"WITH {MERGE}, {sessions('sum')} SELECT query_id, source_file, round(score, 9) AS score, rank FROM sessions",
    "merged_views_max": f"WITH {MERGE}, {sessions('max', 'HAVING max(s) > 0')} SELECT query_id, source_file, round(score, 9) AS score, rank FROM sessions",
    "blended_views": f"""WITH {MERGE}, {sessions('max', 'HAVING max(s) > 0')},
        l AS (SELECT query_id, ((drawer_id + 1) // 4)::VARCHAR AS source_file, min(rank) AS r FROM dense WHERE rank <= 30 GROUP BY ALL),
        b AS (SELECT query_id, source_file, 0.7 * coalesce(score, 0) + coalesce(0.3 / (60 + r), 0) AS score FROM sessions FULL JOIN l USING (query_id, source_file))
        SELECT query_id, source_file, round(score, 9) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY round(b.score, 12) DESC, source_file))::INT AS rank FROM b QUALIFY rank <= 10""",
    "question_types": f"""WITH q AS (SELECT unnest(range({len(QUESTIONS)})) AS query_id, unnest([{strings(QUESTIONS)}]) AS query UNION ALL SELECT conv_id * 1000 + turn + 1000, text FROM conversations WHERE role = 'user') SELECT query_id, {TYPES} AS type FROM q""",
    "anchor_types": """WITH x AS (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE vec_id % 2 = 0), m AS (SELECT label, i, avg(x) AS x FROM x GROUP BY ALL),
        means AS (SELECT label::VARCHAR AS type, list(x ORDER BY i) AS v FROM m GROUP BY 1)
        SELECT vec_id AS query_id, type FROM embeddings, means WHERE vec_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], v), 12) DESC, type) = 1""",
    "graph_entities": f"WITH {SAID} SELECT entity_id, name, 'unknown' AS type, '{{}}' AS properties FROM entities",
    "graph_triples": f"WITH {SAID} SELECT subject, predicate, object, valid_from, valid_to, confidence FROM triples",
    "graph_outgoing": f"WITH {SAID}, {ASKED} {OUT}",
    "graph_incoming": f"WITH {SAID}, {ASKED} {IN}",
    "graph_both": f"WITH {SAID}, {ASKED} {OUT} UNION ALL {IN}",
    "graph_as_of_all": f"""WITH {SAID}, asked AS (SELECT DISTINCT 'Customer ' || o_custkey AS asked, strftime(o_orderdate, '%Y-%m-%d') AS as_of FROM orders), found AS ({OUT})
        SELECT asked, count(*) AS n, count(*) FILTER (current) AS current FROM found GROUP BY 1""",
    "graph_timeline": f"""WITH {SAID} SELECT s.name AS subject_name, predicate, o.name AS object_name, valid_from, valid_to, valid_to IS NULL AS current FROM triples t JOIN entities s ON s.entity_id = t.subject JOIN entities o ON o.entity_id = t.object
        WHERE 'customer_10' IN (t.subject, t.object)""",
    "graph_stats": f"WITH {SAID}, c AS (SELECT count(*) AS triples, count(*) FILTER (valid_to IS NULL) AS current FROM triples) SELECT (SELECT count(*) FROM entities) AS entities, triples, current, triples - current AS expired FROM c",
    "graph_invalidated": f"""WITH {SAID}, ends AS (SELECT DISTINCT subject, predicate, object FROM said WHERE seq % 3 = 0),
        t AS (SELECT CASE WHEN t.valid_to IS NULL AND e.subject IS NOT NULL THEN '2030-01-01' ELSE t.valid_to END AS valid_to FROM triples t LEFT JOIN ends e USING (subject, predicate, object)) SELECT valid_to, count(*) AS n FROM t GROUP BY 1""",
    "graph_contradictions": f"WITH {ACTS} SELECT subject, predicate, string_agg(DISTINCT object, ',' ORDER BY object) AS objects FROM acts GROUP BY ALL HAVING count(DISTINCT object) > 1",
    "graph_conflicts": f"WITH {ACTS}, t AS (SELECT DISTINCT subject, predicate, object FROM acts) SELECT a.seq, a.subject, a.predicate, a.object, t.object AS other FROM acts a JOIN t ON a.subject = t.subject AND a.object <> t.object",
    "summary": summary(),
    "wake_up": "SELECT '## L0 — IDENTITY' || chr(10) || 'an engine' || chr(10) || chr(10) || text AS text FROM (" + summary("wing = 'src2'") + ")",
    "session_views": f"WITH {TURNS}, {VIEW} SELECT * FROM views WHERE content <> ''",
    "session_chunks": f"WITH {CHUNKS} SELECT * FROM chunks",
    "wanted_files": f"""WITH f AS (SELECT '/a.b/file' || doc_id || ['.md', '.PY', '.exe', '', '.tar.gz', '.json'][doc_id % 6 + 1] AS path, n_chars * 1000 AS size FROM documents)
        SELECT path, size FROM f WHERE size BETWEEN 1 AND 10485760 AND lower({EXT}) IN ('', {strings(EXTENSIONS)})""",
    "mining": f"""WITH {STORED}, f AS (SELECT CASE WHEN doc_id % 2 = 0 THEN source ELSE '/docs/' || doc_id || '.md' END AS path, text FROM documents),
        new AS (SELECT DISTINCT path, coalesce(text, '') AS text FROM f EXCEPT SELECT DISTINCT source, coalesce(text, '') FROM documents)
        SELECT (SELECT count(*) FROM f) AS processed, (SELECT count(*) FROM new) AS created, (SELECT count(*) FROM f) - (SELECT count(*) FROM new) AS duplicates""",
    "index_build": f"WITH {terms(DOCS)} SELECT count(*) AS postings, count(DISTINCT term) AS terms, count(DISTINCT id) AS documents FROM terms",
    "transcripts": """
        WITH w AS (SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User: ' WHEN 'assistant' THEN 'AI: ' ELSE '' END || text, chr(10) ORDER BY turn) AS whole FROM conversations GROUP BY 1),
        p AS (SELECT conv_id, string_split(whole, chr(10)) AS p FROM w),
        l AS (SELECT conv_id, unnest(range(len(p))) AS line, trim(unnest(p)) AS t FROM p),
        s AS (SELECT *, CASE WHEN regexp_matches(t, '^(Human|User):') THEN 'human' WHEN regexp_matches(t, '^(Assistant|AI):') THEN 'assistant' END AS speaker, trim(regexp_replace(t, '^(Human:|User:|Assistant:|AI:)', '')) AS text FROM l),
        n AS (SELECT *, count(speaker) OVER (PARTITION BY conv_id ORDER BY line) - 1 AS turn FROM s)
        SELECT conv_id || '.txt' AS path, turn, max(speaker) AS speaker, string_agg(text, chr(10) ORDER BY line) AS content FROM n WHERE turn >= 0 AND (speaker IS NOT NULL OR t <> '') GROUP BY conv_id, turn""",
    "message_lines": "SELECT conv_id || '.jsonl' AS path, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role AS speaker, trim(text) AS content FROM conversations WHERE role <> '' AND text <> ''",
    "message_tree": "SELECT conv_id || '.json' AS path, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role AS speaker, text AS content FROM conversations WHERE role <> '' AND text <> ''",
    "team_messages": "SELECT conv_id || '.json' AS path, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, CASE WHEN role <> 'assistant' AND role <> '' THEN role ELSE 'unknown' END AS speaker, text AS content, turn::VARCHAR AS ts FROM conversations WHERE text <> ''",
    "got_drawers": "SELECT doc_id AS drawer_id, source AS wing, lang AS room FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)",
    "ann_sizes": "SELECT len(embedding)::INT AS dim, count(*) AS size FROM embeddings WHERE len(embedding) > 0 GROUP BY 1",
    "ann_recall": "SELECT count(*) AS queries, TRUE AS reached FROM embeddings WHERE vec_id % 50 = 0",
    "reranked": f"""WITH {bm25(PASSAGES, 10)}, r AS (SELECT query_id, drawer_id, score, rank, {chosen({t: t in GATED for t in TYPE_WEIGHTS}, 'query_id % 6')} AND count(*) OVER (PARTITION BY query_id) > 1 AS gate, (length(left(text, 100)) - length(replace(left(text, 100), 'e', '')))::DOUBLE AS e FROM lexical JOIN documents ON doc_id = drawer_id)
        SELECT query_id, drawer_id, round(CASE WHEN gate THEN e ELSE score END, 9) AS score, CASE WHEN gate THEN (row_number() OVER (PARTITION BY query_id ORDER BY e DESC, drawer_id))::INT ELSE rank END AS rank FROM r""",
    "expanded_queries": "WITH x AS (SELECT vec_id AS query_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE vec_id % 50 = 0) SELECT query_id, i::INT AS i, round(((x + 1) / 2)::FLOAT::DOUBLE, 5) AS x FROM x",
    "coded_vectors": "SELECT vec_id AS drawer_id, 4 + 4 * len(embedding)::INT AS bytes, TRUE AS same FROM embeddings",
    "prepared_anchors": "SELECT type, round(avg(length(p)), 6) AS length, round(avg(len(list_filter(string_split(p, ' '), lambda x: x <> ''))), 6) AS words FROM (VALUES " + ", ".join(f"({strings([t, p])})" for t, some in ANCHORS.items() for p in some) + ") AS v(type, p) GROUP BY 1",
    "put_entities": f"""WITH {SAID}, n AS (SELECT DISTINCT 'customer_' || (o_custkey * 2) AS entity_id, 'Customer ' || (o_custkey * 2) AS name FROM orders)
        SELECT entity_id, name, 'buyer' AS type, '{{}}' AS properties FROM n UNION ALL SELECT entity_id, name, 'unknown', '{{}}' FROM entities WHERE entity_id NOT IN (SELECT entity_id FROM n)""",
    "normal_answers": "SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'a b' WHEN 1 THEN item_id::VARCHAR ELSE 'the answer ' || item_id END AS answer FROM benchmark",
    "first_bytes": "SELECT doc_id, list_max(list_filter(list_transform(range(370, 1501), lambda k: octet_length(encode(left(text, k)))), lambda x: x <= 1500))::INT AS bytes, TRUE AS begins FROM documents",
    "listed_sessions": "SELECT doc_id, trim(source) || '|' || trim(lang) AS sessions FROM documents",
    "whole_sessions": f"WITH {TURNS}, {VIEW} SELECT conv_id, content FROM views WHERE hall = 'L0' AND content <> ''",
    "rendered_results": f"""WITH {bm25(PASSAGES, 10)},
        r AS (SELECT query_id, rank, score, source, lang, CASE WHEN octet_length(encode(text)) > 200 THEN left(text, list_max(list_filter(range(50, 201), lambda k: octet_length(encode(left(text, k))) <= 200))) || '...' ELSE text END AS snippet FROM lexical JOIN documents ON doc_id = drawer_id)
        SELECT query_id, rank, printf('[%d] %s / %s  (score: %.3f)', rank, source, lang, score) || chr(10) || '    Source: ' || regexp_extract(source, '[^/]*$') || chr(10) || '    ' || translate(snippet, chr(10), ' ') AS line FROM r""",
    "session_order": "SELECT DISTINCT 'session_' || conv_id AS name, conv_id::INT AS number FROM conversations",
    "expected_by_class": f"{FIRST_OTHER}, c AS (SELECT predicted, actual, count(*) AS n FROM found GROUP BY ALL) SELECT sum(round(n * (predicted / 7.0))) AS expected, sum(n)::BIGINT AS n FROM c",
    "sizes": f"WITH d AS (SELECT doc_id, n_chars * n_chars AS n FROM documents) SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' ELSE {UNITS} END AS size FROM d",
    "recall_by_answer": f"""WITH {bm25(PASSAGES, 10)}, a AS (SELECT item_id, text, {ANSWER_WORDS} AS w FROM benchmark),
        f AS (SELECT b.item_id, min(CASE WHEN {ANSWER} THEN l.rank END) AS first FROM a b LEFT JOIN lexical l ON l.query_id = b.item_id LEFT JOIN documents d ON d.doc_id = l.drawer_id GROUP BY 1) SELECT count(*) AS n, {SHARES} FROM f""",
    "recall_by_source": f"""WITH {bm25(PASSAGES, 10)}, f AS (SELECT b.item_id % 3 AS type, b.item_id AS query_id, min(CASE WHEN d.source = 'src' || (b.item_id % 20) THEN l.rank END) AS first FROM benchmark b LEFT JOIN lexical l ON l.query_id = b.item_id LEFT JOIN documents d ON d.doc_id = l.drawer_id GROUP BY 1, 2)
        SELECT type, count(*) AS n, {SHARES} FROM f GROUP BY type""",
    "recall_scoped": f"""WITH {bm25(PASSAGES, 10)}, s AS (SELECT query_id, source, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM lexical JOIN documents ON doc_id = drawer_id WHERE (substr(source, 4)::BIGINT - query_id % 20 + 20) % 20 < 10),
        f AS (SELECT b.item_id, min(CASE WHEN {OWN} THEN rank END) AS first FROM benchmark b LEFT JOIN s ON s.query_id = b.item_id GROUP BY 1) SELECT count(*) AS n, {SHARES} FROM f""",
    "confusion": f"{FIRST_OTHER} SELECT predicted, actual, count(*) AS n FROM found GROUP BY ALL",
    "accuracy": f"{FIRST_OTHER} SELECT round(avg((predicted = actual)::INT), 6) AS accuracy, count(*) AS n FROM found",
    "best_weights": f"""WITH {LISTS}, {fused('u', 10, ', (SELECT unnest([0.4, 0.5, 0.6, 0.7])::DOUBLE AS u)')},
        f AS (SELECT query_id, weight, min(CASE WHEN {OWN} THEN rank END) AS first FROM fused JOIN documents ON doc_id = drawer_id GROUP BY ALL),
        r AS (SELECT query_id % 4 AS kind, weight, avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END) AS r5 FROM f GROUP BY ALL)
        SELECT kind, weight, round(r.r5, 9) AS r5 FROM r QUALIFY row_number() OVER (PARTITION BY kind ORDER BY r.r5 DESC, weight) = 1""",
    "hits_by_size": """WITH c AS (SELECT conv_id, count(*) AS context_size, bool_or(contains(text, 'the')) AS hit FROM conversations GROUP BY 1)
        SELECT context_size, count(*) AS n, count(*) FILTER (hit) AS hits, round(100 * count(*) FILTER (hit) / count(*), 6) AS percent FROM c GROUP BY ROLLUP (context_size)""",
    "lenient_and_strict": f"""WITH {near(10)}, e AS (SELECT query_id, p AS position, (query_id + p * 7) % 40 AS s FROM (SELECT vec_id AS query_id, unnest(range(5)) AS p FROM embeddings WHERE vec_id % 50 = 0))
        SELECT query_id, (min(rank) FILTER (EXISTS (SELECT 1 FROM e WHERE e.query_id = dense.query_id AND e.s = drawer_id % 40)))::INT AS first, (min(rank) FILTER (drawer_id % 40 = (query_id + 28) % 40))::INT AS first_latest FROM dense GROUP BY 1""",
    "evidence_hits": f"WITH {CHUNKS} SELECT session, chunk, len(list_intersect(string_split(source_file, ','), ['D:1', 'D:5'])) > 0 AS hit FROM chunks",
}

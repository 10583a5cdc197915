"""The registered queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import bpe, chat, ctw, divergence, forest, kneser_ney, langid, license_scan, mixing, vafile
from larkspur.llm.common import remainder
from larkspur.session import ship


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of base phrases, labels and granted freedom of each document."""
    found = license_scan.scan(read(spark, sf_dir, "documents"))
    word = F.col("places.word")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(word).alias("first_word"), F.array_max(word).alias("last_word"),
        "base_labels", "labels", "score", F.array_join("expressions", "; ").alias("expressions"),
    )


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of what they decode to."""
    return bpe.encode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every 20th vector with all others."""
    return vafile.search(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of each document; what is held out isn't learned from."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder("doc_id", 4) == 2
    model = langid.fit(documents, F.coalesce(~held_out, F.lit(True)))
    found = langid.predict(documents.select("doc_id", "text"), model).withColumn("doc_id", F.col("row.doc_id"))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of each document: 5-grams of words, similarity 0.8 or more."""
    return forest.join(read(spark, sf_dir, "documents"))


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of each document under a model of the documents labelled good, and the verdict for its language."""
    trusted = read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return kneser_ney.classify(read(spark, sf_dir, "documents"), trusted)


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and context-tree scores of each document; what is held out isn't learned from."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder("doc_id", 7) == 2, F.lit(False))
    out = ctw.score(documents, ~held_out)
    return out.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what is read back from each formatted conversation."""
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("seq"), "role", "text")
    control = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("seq"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    events = turns.unionByName(control).withColumns({"kind": F.lit("message"), "message": F.monotonically_increasing_id()})
    out = chat.render(chat.fold_events(events))
    out = out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("mask")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of sources takes."""
    out = mixing.mixed(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


#: Labelled documents that references are estimated from, at most.
TRUSTED = 20_000


def labelled_good(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """The rows of documents that labels calls good, of TRUSTED ids at most: those of the least digests. So the ids can
    go to all tasks, and the texts stay where they are."""
    good = read(spark, sf_dir, "labels").filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("good")).distinct()
    good = good.orderBy(F.md5(F.col("good").cast("string").cast("binary")), "good").limit(TRUSTED)
    return docs.join(F.broadcast(good), F.col("doc_id") == F.col("good"), "left_semi")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and verdict of each document, the references estimated from documents labelled good."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = divergence.measured(documents, labelled_good(spark, sf_dir, documents))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_byte_bpe, op3_exact_top_k, op4_language_id, op5_ngram_join, op6_kneser_ney, op7_lm_score, op8_chat_format, op9_mix, op10_quality_rules)}

SPACES = "[\\x20\\x09-\\x0D]+"


def js_sql(counts: str, total: str, shares: str) -> str:
    """divergence.js_distance in SQL."""
    p, q = f"(({counts})[i] / ({total}))", f"({shares})[i]"
    m = f"(({p} + {q}) / 2)"
    term = f"CASE WHEN {p} > 0 THEN {p} * log2({p} / {m}) ELSE 0 END / 2 + CASE WHEN {q} > 0 THEN {q} * log2({q} / {m}) ELSE 0 END / 2"
    return f"CASE WHEN {total} > 0 THEN sqrt(greatest(list_sum(list_transform(range(1, len({shares}) + 1), lambda i: {term})), 0)) END"


CLASSES = ["chars - word_chars", "upper", "digits", "symbols", "ascii - symbols", "word_chars - upper - digits - ascii"]
ESCAPED = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')"

SQL = {
    "op5_ngram_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACES}'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 10 * c >= 8 * (a.n + b.n - c)),
        r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.node),
        k AS (SELECT x, count(*) AS n FROM l GROUP BY x)
        SELECT node AS doc_id, min(root) AS class_id, coalesce(any_value(k.n), 0)::BIGINT AS n_links FROM r LEFT JOIN k ON k.x = node GROUP BY node""",
    "op10_quality_rules": f"""
        WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, regexp_replace(coalesce(text, ''), '{SPACES}', '', 'g') AS dense FROM documents),
        v AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM d WHERE len(w) >= 5),
        twice AS (SELECT doc_id, i FROM v QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
        c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) AS r(k) GROUP BY doc_id),
        f AS (SELECT d.doc_id, lang, w, length(t) AS chars, len(w) AS n_words, length(dense) AS word_chars, length(regexp_replace(dense, '[^#*$%&|<>]+', '', 'g')) AS symbols,
                length(regexp_replace(dense, '[^A-Z]+', '', 'g')) AS upper, length(regexp_replace(dense, '[^0-9]+', '', 'g')) AS digits, length(regexp_replace(dense, '[^!-/:-@\\[-`{{-~]+', '', 'g')) AS ascii,
                list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, coalesce(c.n, 0) AS n_repeat_words FROM d LEFT JOIN c ON c.doc_id = d.doc_id),
        k AS (SELECT *, [{', '.join(CLASSES)}] AS class_counts, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
        good AS (SELECT * FROM k WHERE doc_id IN (SELECT doc_id FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT {TRUSTED})),
        sums AS (SELECT lang, count(*) AS docs, [{', '.join(f'sum(class_counts[{i}])' for i in range(1, 7))}] AS s FROM good GROUP BY lang),
        every AS (SELECT [{', '.join(f'sum(s[{i}])' for i in range(1, 7))}] AS s, sum(docs) AS docs FROM sums),
        words AS (SELECT lang, x AS word, count(*) AS n FROM (SELECT lang, lower(unnest(w)) AS x FROM good) GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank, sum(n) OVER (PARTITION BY lang) AS total FROM words),
        top AS (SELECT lang, list(word ORDER BY rank) AS listed, list_append(list(n / total ORDER BY rank), 1 - sum(n) / any_value(total)) AS shares FROM ranked WHERE rank <= {divergence.RANKS} GROUP BY lang),
        refs AS (SELECT s.lang, list_transform(s.s, lambda x: x / list_sum(s.s)) AS classes, listed, shares FROM sums s LEFT JOIN top t ON t.lang IS NOT DISTINCT FROM s.lang WHERE docs >= {divergence.LEAST}),
        h AS (SELECT k.*, listed, shares, CASE WHEN r.classes IS NOT NULL THEN r.classes WHEN (SELECT docs FROM every) >= {divergence.LEAST} THEN (SELECT list_transform(s, lambda x: x / list_sum(s)) FROM every) ELSE [{', '.join(f'{x!r}::DOUBLE' for x in divergence.CLASSES)}] END AS classes,
                list_transform(listed, lambda c: len(list_filter(w, lambda x: lower(x) = c))) AS hits FROM k LEFT JOIN refs r ON r.lang IS NOT DISTINCT FROM k.lang),
        j AS (SELECT *, CASE WHEN chars >= {divergence.CLASS_CHARS} THEN {js_sql('class_counts', 'chars', 'classes')} END AS class_js,
                CASE WHEN listed IS NOT NULL AND n_words >= {divergence.COMMON_WORDS} THEN {js_sql('list_append(hits, n_words - list_sum(hits)::BIGINT)', 'n_words', 'shares')} / {js_sql('list_append(list_transform(hits, lambda x: 0), 1)', '1', 'shares')} END AS common_js FROM h)
        SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, symbols::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
            NOT base_failed AND coalesce(class_js, 0) <= {divergence.CLASS_DISTANCE} AND coalesce(common_js, 0) <= {divergence.COMMON_SHARE} AS kept FROM j""",
    "op3_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 20""",
    "op8_chat_format": f"""
        WITH a AS (
            SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
        g AS (
            SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
                coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
                sum(length({ESCAPED.format("replace(role, chr(10), '')")}) + 5 * (length(role) - length(replace(role, chr(10), ''))) + length({ESCAPED.format('text')}) + 8)::BIGINT AS formatted_chars
            FROM a GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g""",
    "op9_mix": """
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, length(coalesce(text, '')) AS chars FROM documents),
        k AS (
            SELECT *, -ln((('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT + 0.5) / 281474976710656.0::DOUBLE)
                * (1 + abs(chars / greatest(size, 1) - 7) / 7) AS draw, coalesce(doc_id::VARCHAR, 'null') AS key FROM d),
        s AS (
            SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS weight
            FROM d GROUP BY source),
        l AS (
            SELECT *, 3 * source_size AS cap, 3 * source_size / weight AS a,
                (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
        t AS (
            SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT arg_min(level, a) FROM l WHERE level <= a), 0) * weight) AS target FROM l),
        b AS (
            SELECT k.*, t.source_size, t.target, coalesce(floor(t.target / nullif(t.source_size, 0)), 0)::BIGINT AS epochs,
                sum(size) OVER (PARTITION BY k.source ORDER BY draw, key, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
            FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
            (size * (epochs + CASE WHEN before + size / 2 <= target - epochs * source_size AND size > 0 THEN 1 ELSE 0 END))::BIGINT AS taken FROM b""",
}

"""Registered queries over the driver's tables.

documents are drawers (wing: source, room: lang), embeddings are their vectors, orders and events are facts,
conversations are sessions, and passages of benchmark are questions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions import text
from larkspur.operators import ann, classify, evaluate, fusion, graph, lexical, store, vector
from larkspur.plans import layers
from larkspur.session import ship
from larkspur.sources import conversations, files
from larkspur.sources.shared import saved, spread

ROUND = 9
QUERY = "the attion ereding on anblewh thonre thstinnt ereding"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as items of a store."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("drawer_id"), F.col("text").alias("content"), F.col("source").alias("wing"), F.col("lang").alias("room"), F.lit("facts").alias("hall"), F.col("source").alias("source_file"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items for work on their texts."""
    return spread(items(spark, sf_dir), "drawer_id")


def banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored drawers, their rooms split by length, so that some rooms are in one wing only."""
    room = F.concat_ws("-", "room", F.floor(F.length("content") / 1500).cast("string"))
    return store.drawers(items(spark, sf_dir)).withColumn("room", room)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("drawer_id"), F.col("embedding").alias("vector"), "label")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).filter("drawer_id % 50 = 0").select(F.col("drawer_id").alias("query_id"), F.col("vector").alias("query_vector"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def one_query(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.col("id").alias("query_id"), F.lit(QUERY).alias("query"))


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.postings(texts(spark, sf_dir), corpus=True)


_indexes: dict[tuple[str, str], lexical.Index] = {}


def stored_index(spark: SparkSession, sf_dir: str) -> lexical.Index:
    """The index of all documents, built once an application and read by all lexical queries."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        _indexes[key] = lexical.stored(index(spark, sf_dir))
    return _indexes[key]


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, ROUND) for c in columns})


def term_frequencies(spark, sf_dir):
    return rounded(index(spark, sf_dir), "tf")


def vocabulary(spark, sf_dir):
    words = texts(spark, sf_dir).select(F.explode(text.words(F.col("content"))).alias("word")).distinct()
    return text.stemmed(words, "word", "stem")


def index_build(spark, sf_dir):
    """The stored index of all documents, made anew: its size."""
    made = lexical.stored(index(spark, sf_dir))
    return made.postings.agg(F.count("*").alias("postings"), F.countDistinct("term").alias("terms")).withColumn("documents", F.lit(made.total))


def corpus_statistics(spark, sf_dir):
    return rounded(lexical.statistics(texts(spark, sf_dir)), "avg_doc_len")


def stored_drawers(spark, sf_dir):
    return store.drawers(items(spark, sf_dir)).select("drawer_id", "content_hash", "wing", "room", "hall", "source_type")


def added_drawers(spark, sf_dir):
    every = items(spark, sf_dir)
    return store.add_drawers(store.drawers(every.filter("drawer_id % 2 = 0")), every).select("drawer_id", "content_hash")


def listed_drawers(spark, sf_dir):
    return store.list_drawers(store.drawers(items(spark, sf_dir)), "src3", "en").select("drawer_id", "wing", "room")


def drawer_count(spark, sf_dir):
    return store.drawers(items(spark, sf_dir)).agg(F.count("*").alias("drawers"))


def wing_names(spark, sf_dir):
    names = items(spark, sf_dir).select(F.col("drawer_id").alias("id"), F.col("wing").alias("name"))
    return store.add_names(names.limit(0).select("name"), names, ["name"])


def room_names(spark, sf_dir):
    names = items(spark, sf_dir).select(F.col("drawer_id").alias("id"), F.col("room").alias("name"), "wing")
    return store.add_names(names.limit(0).select("name", "wing"), names, ["name", "wing"])


def detected_rooms(spark, sf_dir):
    return store.detect_rooms(texts(spark, sf_dir), "drawer_id", "content")


def status(spark, sf_dir):
    t, e = facts(spark, sf_dir)
    return store.status(store.drawers(items(spark, sf_dir)), t, e)


def wing_breakdown(spark, sf_dir):
    stored = store.drawers(items(spark, sf_dir))
    wings = stored.select("wing").distinct().unionByName(spark.range(1).select(F.lit("empty").alias("wing")))
    return store.wing_breakdown(wings, stored, vectors(spark, sf_dir))


def tunnels(spark, sf_dir):
    return store.tunnels(banded(spark, sf_dir)).withColumn("wings", F.array_join("wings", ","))


def tunnels_between(spark, sf_dir):
    return store.tunnels(banded(spark, sf_dir), "src1", "src2").withColumn("wings", F.array_join("wings", ","))


def pending_embeddings(spark, sf_dir):
    return store.pending(store.drawers(items(spark, sf_dir)), vectors(spark, sf_dir)).select("drawer_id")


def embedded_count(spark, sf_dir):
    return store.drawers(items(spark, sf_dir)).join(vectors(spark, sf_dir), "drawer_id", "left_semi").agg(F.count("*").alias("embedded"))


def bm25_single(spark, sf_dir):
    return rounded(lexical.bm25(stored_index(spark, sf_dir), one_query(spark), 10), "score")


def bm25_passages(spark, sf_dir):
    return rounded(lexical.bm25(stored_index(spark, sf_dir), passages(spark, sf_dir), 10), "score")


def bm25_wing(spark, sf_dir):
    narrowed = lexical.scope(items(spark, sf_dir), "src4", "en")
    return rounded(lexical.bm25(stored_index(spark, sf_dir), one_query(spark), 5, narrowed), "score")


def bm25_scope(spark, sf_dir):
    narrowed = lexical.scope(items(spark, sf_dir), sessions=["src1", "src7"])
    return rounded(lexical.bm25(stored_index(spark, sf_dir), passages(spark, sf_dir), 5, narrowed), "score")


def bm25_by_wing(spark, sf_dir):
    """All passages, each within one wing that is a store of its own."""
    own = passages(spark, sf_dir).withColumn("wing", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")))
    return rounded(lexical.bm25_by(lexical.postings_by(texts(spark, sf_dir), "wing"), own, "wing", 10), "score")


def vector_search(spark, sf_dir):
    return rounded(vector.search(vectors(spark, sf_dir), vector_queries(spark, sf_dir), 10), "score")


def vector_search_wing(spark, sf_dir):
    return rounded(vector.search(vectors(spark, sf_dir), vector_queries(spark, sf_dir), 5, vectors(spark, sf_dir).filter("label < 3")), "score")


def label_means(spark, sf_dir):
    means = vector.mean_vectors(vectors(spark, sf_dir), "label")
    return means.select("label", F.posexplode("vector").alias("i", "x")).select("label", "i", F.round("x", ROUND).alias("x"))


def both_queries(spark, sf_dir):
    v = vectors(spark, sf_dir).select(F.col("drawer_id").alias("query_id"), F.col("vector").alias("query_vector"))
    return passages(spark, sf_dir).join(v, "query_id")


def hybrid(spark, sf_dir):
    return rounded(fusion.hybrid(stored_index(spark, sf_dir), vectors(spark, sf_dir), both_queries(spark, sf_dir), 10, 0.5), "score")


def hybrid_auto(spark, sf_dir):
    weight = fusion.type_weight(F.element_at(F.array(*map(F.lit, fusion.TYPE_WEIGHTS)), (F.col("query_id") % 6 + 1).cast("int")))
    return rounded(fusion.hybrid(stored_index(spark, sf_dir), vectors(spark, sf_dir), both_queries(spark, sf_dir), 10, weight), "score")


def hybrid_sweep(spark, sf_dir):
    q = both_queries(spark, sf_dir)
    a, b = lexical.bm25(stored_index(spark, sf_dir), q, 40), vector.search(vectors(spark, sf_dir), q, 40)
    return rounded(fusion.sweep(a, b, [0.4, 0.5, 0.6, 0.7], 10), "score")


def hybrid_recency(spark, sf_dir):
    return rounded(fusion.recency(fusion.hybrid(stored_index(spark, sf_dir), vectors(spark, sf_dir), both_queries(spark, sf_dir), 10), 0.5), "score")


def views_of_vectors(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return v.select("drawer_id", "vector", F.floor(F.col("drawer_id") / 3).cast("string").alias("source_file"), F.concat(F.lit("L"), (F.col("drawer_id") % 3).cast("string")).alias("hall"))


def multiview(spark, sf_dir):
    v = views_of_vectors(spark, sf_dir)
    return rounded(fusion.multiview(v, v, vector_queries(spark, sf_dir), 5).select("query_id", "drawer_id", "source_file", "score", "rank"), "score")


VIEW_WEIGHTS = {"L0": 0.2, "L1": 0.5, "L2": 0.3}


def merged_views_sum(spark, sf_dir):
    return rounded(fusion.session_search(views_of_vectors(spark, sf_dir), vector_queries(spark, sf_dir), VIEW_WEIGHTS, "sum", 10), "score")


def merged_views_max(spark, sf_dir):
    return rounded(fusion.session_search(views_of_vectors(spark, sf_dir), vector_queries(spark, sf_dir), VIEW_WEIGHTS, "max", 10), "score")


def blended_views(spark, sf_dir):
    sessions = fusion.session_search(views_of_vectors(spark, sf_dir), vector_queries(spark, sf_dir), VIEW_WEIGHTS, "max", 10)
    ranks = vector.search(vectors(spark, sf_dir), vector_queries(spark, sf_dir), 30).select("query_id", ((F.col("drawer_id") + 1) / 4).cast("int").cast("string").alias("source_file"), "rank")
    return rounded(fusion.blended(sessions, ranks, 0.3, 10), "score")


QUESTIONS = (
    "Can you remind me what we said?", "please suggest a book", "What are some good places", "Which trip was first?", "how many days did it take", "  How many cats do I own",
    "Where did I park", "", "what would you do after lunch", "can you recommend a hotel before June", "our earlier talk", "you told me so", "latest score", "how many weeks", "When was it",
)


def question_types(spark, sf_dir):
    q = spark.range(1).select(F.posexplode(F.array(*map(F.lit, QUESTIONS))).alias("query_id", "query"))
    turns = read(spark, sf_dir, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn") + 1000).alias("query_id"), F.col("text").alias("query"))
    return q.select(F.col("query_id").cast("long"), "query").unionByName(turns).select("query_id", classify.question_type(F.col("query")).alias("type"))


def anchor_types(spark, sf_dir):
    v = vectors(spark, sf_dir)
    means = classify.anchor_means(v.filter("drawer_id % 2 = 0").select(F.col("label").cast("string").alias("type"), "vector"))
    asked = v.filter("drawer_id % 2 = 1").select(F.col("drawer_id").alias("query_id"), F.col("vector").alias("query_vector"))
    return classify.nearest_anchor(asked, means)


def said(spark, sf_dir):
    """Facts of orders: a customer's order status, held until the customer's next order."""
    o = read(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    until = F.lead(day).over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return o.select(F.col("o_orderkey").alias("seq"), F.concat(F.lit(" Customer "), F.col("o_custkey").cast("string")).alias("subject"), F.lit("Order Status").alias("predicate"), F.col("o_orderstatus").alias("object"), day.alias("valid_from"), F.coalesce(until, F.lit("")).alias("valid_to"))


def facts(spark, sf_dir):
    s = said(spark, sf_dir)
    none = graph.normal_facts(s.limit(0))
    return graph.new_triples(none, s), graph.named_entities(s)


def graph_entities(spark, sf_dir):
    return facts(spark, sf_dir)[1]


def graph_triples(spark, sf_dir):
    return facts(spark, sf_dir)[0].drop("triple_id")


def asked(spark):
    return spark.sql("select * from values ('Customer 1', cast(null as string)), ('customer_4', '2024-01-01'), ('CUSTOMER 7', '1995-06-17'), ('F', '1996-01-01') as t(name, as_of)")


def graph_outgoing(spark, sf_dir):
    t, e = facts(spark, sf_dir)
    return graph.about(t, e, asked(spark), "outgoing")


def graph_incoming(spark, sf_dir):
    t, e = facts(spark, sf_dir)
    return graph.about(t, e, asked(spark), "incoming")


def graph_both(spark, sf_dir):
    t, e = facts(spark, sf_dir)
    return graph.about(t, e, asked(spark))


def graph_as_of_all(spark, sf_dir):
    """What held of every customer on the day of each of its orders: an interval join."""
    t, e = facts(spark, sf_dir)
    o = read(spark, sf_dir, "orders").select(F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("name"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("as_of")).distinct()
    return graph.about(t, e, o, "outgoing").groupBy("asked").agg(F.count("*").alias("n"), F.sum(F.col("current").cast("long")).alias("current"))


def graph_timeline(spark, sf_dir):
    t, e = facts(spark, sf_dir)
    return graph.timeline(t, e, "customer 10")


def graph_stats(spark, sf_dir):
    t, e = facts(spark, sf_dir)
    return graph.stats(t, e)


def graph_invalidated(spark, sf_dir):
    t, _ = facts(spark, sf_dir)
    ends = said(spark, sf_dir).filter("seq % 3 = 0").select("subject", "predicate", "object", F.lit("2030-01-01").alias("ended"))
    return graph.invalidated(t, ends).groupBy("valid_to").agg(F.count("*").alias("n"))


def acts(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("subject"), F.lit("did").alias("predicate"), F.col("event_type").alias("object"), F.date_format("ts", "yyyy-MM-dd").alias("valid_from"), F.lit("").alias("valid_to"))


def graph_contradictions(spark, sf_dir):
    a = acts(spark, sf_dir)
    t = graph.new_triples(graph.normal_facts(a.limit(0)), a)
    return graph.contradictions(t).withColumn("objects", F.array_join("objects", ","))


def graph_conflicts(spark, sf_dir):
    a = acts(spark, sf_dir)
    t = graph.new_triples(graph.normal_facts(a.limit(0)), a)
    return graph.conflicts(t, a)


def wing_table(spark, sf_dir):
    return store.drawers(items(spark, sf_dir)).groupBy("wing").agg(F.max("room").alias("keywords")).select("wing", F.lit("project").alias("type"), "keywords")


def summary(spark, sf_dir):
    return layers.summary(wing_table(spark, sf_dir), banded(spark, sf_dir))


def wake_up(spark, sf_dir):
    return layers.wake_up(wing_table(spark, sf_dir), banded(spark, sf_dir), "## L0 — IDENTITY\nan engine", "src2")


def session_views(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("speaker"), F.col("text").alias("content"))
    return conversations.views(turns)


def session_chunks(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    rows = c.select(F.col("conv_id").alias("session"), F.col("turn").alias("position"), F.concat_ws(":", F.lit("D").cast("string"), "turn").alias("id"), F.col("role").alias("speaker"), "text", F.when(F.col("turn") % 2 == 1, "a picture").alias("caption"), F.lit(None).cast("string").alias("query"))
    return conversations.chunks(rows, 3)


def transcripts(spark, sf_dir):
    """Conversations as plain transcripts, parsed back."""
    c = read(spark, sf_dir, "conversations")
    line = F.concat(F.when(F.col("role") == "user", "User: ").when(F.col("role") == "assistant", "AI: ").otherwise(""), F.col("text"))
    whole = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    return conversations.parse(whole.select(F.concat(F.col("conv_id").cast("string"), F.lit(".txt")).alias("path"), F.array_join(F.transform("l", lambda x: x.line), "\n").alias("content"))).select("path", "turn", "speaker", "content")


def message_lines(spark, sf_dir):
    """Conversations as JSON lines, parsed back."""
    c = read(spark, sf_dir, "conversations")
    line = F.to_json(F.struct("role", F.col("text").alias("content")))
    whole = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    return conversations.parse(whole.select(F.concat(F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("path"), F.array_join(F.transform("l", lambda x: x.line), "\n").alias("content"))).select("path", "turn", "speaker", "content")


def message_tree(spark, sf_dir):
    """Conversations as trees of message nodes, parsed back."""
    c = read(spark, sf_dir, "conversations")
    node = F.struct(F.struct(F.struct("role").alias("author"), F.struct(F.array("text").alias("parts")).alias("content"), F.col("turn").cast("double").alias("create_time")).alias("message"))
    whole = c.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("n"), F.col("turn").cast("string")), node))).alias("mapping"))
    return conversations.parse(whole.select(F.concat(F.col("conv_id").cast("string"), F.lit(".json")).alias("path"), F.to_json(F.struct("mapping")).alias("content"))).select("path", "turn", "speaker", "content")


def team_messages(spark, sf_dir):
    """Conversations as lists of a team's messages, parsed back; assistants have no name there."""
    c = read(spark, sf_dir, "conversations")
    message = F.struct("turn", F.struct(F.when(F.col("role") != "assistant", F.col("role")).alias("user"), "text", F.col("turn").cast("string").alias("ts")).alias("m"))
    whole = c.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(message)), lambda x: x.m).alias("messages"))
    return conversations.parse(whole.select(F.concat(F.col("conv_id").cast("string"), F.lit(".json")).alias("path"), F.to_json(F.struct("messages")).alias("content"))).select("path", "turn", "speaker", "content", "ts")


def got_drawers(spark, sf_dir):
    ids = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("drawer_id"))
    return store.got(items(spark, sf_dir), ids).select("drawer_id", "wing", "room")


def ann_index(spark, sf_dir):
    return ann.build(vectors(spark, sf_dir), 4)


def ann_sizes(spark, sf_dir):
    return ann.size(ann_index(spark, sf_dir))


def ann_recall(spark, sf_dir):
    """Whether the graph search over four shards, or more of a large table, finds 0.9 of the ten nearest, over all queries."""
    found = ann.search(ann_index(spark, sf_dir), vector_queries(spark, sf_dir), 10).select("query_id", "drawer_id", F.lit(1).alias("hit"))
    both = vector.search(vectors(spark, sf_dir), vector_queries(spark, sf_dir), 10).join(found, ["query_id", "drawer_id"], "left")
    return both.agg(F.countDistinct("query_id").alias("queries"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("reached"))


def letters(query: str, texts: list[str]) -> list[float]:
    """Stands for a model's scores: the letters e among a text's first hundred."""
    return [float(t[:100].count("e")) for t in texts]


def reranked(spark, sf_dir):
    """The passages' results re-scored where the question's type is worth it."""
    types = F.element_at(F.array(*map(F.lit, fusion.TYPE_WEIGHTS)), (F.col("query_id") % 6 + 1).cast("int"))
    results = passage_results(spark, sf_dir).join(passages(spark, sf_dir), "query_id").select("query_id", "query", "drawer_id", "content", "score", "rank")
    return rounded(fusion.reranked(results, letters, 10, fusion.gated(types)), "score").select("query_id", "drawer_id", "score", "rank")


def expanded_queries(spark, sf_dir):
    """Query vectors moved halfway to a generated answer's, here all ones."""
    q = vector_queries(spark, sf_dir).select("query_id", F.lit("").alias("query"), "query_vector")
    ones = lambda texts: [[1.0] * 64 for _ in texts]
    return fusion.expanded(q, str, ones).select("query_id", F.posexplode("query_vector").alias("i", "x")).select("query_id", "i", F.round(F.col("x").cast("double"), 5).alias("x"))


def coded_vectors(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumn("blob", vector.coded(F.col("vector")))
    return v.select("drawer_id", F.octet_length("blob").alias("bytes"), (vector.coded(F.col("blob"), True) == F.col("vector")).alias("same"))


def prepared_anchors(spark, sf_dir):
    """The anchors' means under an embedder that gives a phrase's length and number of words."""
    means = classify.prepared(spark, lambda phrases: [[float(len(p)), float(len(p.split()))] for p in phrases])
    return means.select("type", F.round(F.col("vector")[0], 6).alias("length"), F.round(F.col("vector")[1], 6).alias("words"))


def put_entities(spark, sf_dir):
    """The entities of the facts, then those of the orders' priorities put over them by id."""
    new = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("Customer "), (F.col("o_custkey") * 2).cast("string")).alias("name"), F.lit("buyer").alias("type"), F.lit(None).cast("string").alias("properties"))
    return graph.put_entities(graph_entities(spark, sf_dir), new)


def normal_answers(spark, sf_dir):
    t = read(spark, sf_dir, "benchmark").select("item_id", F.when(F.col("item_id") % 3 == 0, F.to_json(F.array(F.lit(" A"), F.lit("b ")))).when(F.col("item_id") % 3 == 1, F.col("item_id").cast("string")).otherwise(F.concat(F.lit('" The Answer '), F.col("item_id").cast("string"), F.lit(' "'))).alias("a"))
    return t.select("item_id", evaluate.normal_answer(F.parse_json("a")).alias("answer"))


def first_bytes(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.octet_length(text.first_bytes(F.col("text"))).alias("bytes"), F.col("text").startswith(text.first_bytes(F.col("text"))).alias("begins"))


def listed_sessions(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", text.session_ids(F.concat(F.lit(" ,"), F.col("source"), F.lit(" , "), F.col("lang"), F.lit(",,  "))).alias("s"))
    return d.select("doc_id", F.array_join("s", "|").alias("sessions"))


def whole_sessions(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("speaker"), F.col("text").alias("content"))
    return conversations.whole_sessions(turns)


def rendered_results(spark, sf_dir):
    return lexical.rendered(passage_results(spark, sf_dir))


def session_order(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select(F.explode(F.array(F.concat(F.lit("session_"), F.col("conv_id").cast("string")), F.concat(F.lit("session_"), F.col("conv_id").cast("string"), F.lit("_date_time")))).alias("name")).distinct()
    return c.select("name", conversations.session_number(F.col("name")).alias("number")).filter("number is not null")


def expected_by_class(spark, sf_dir):
    """Expected hits if each predicted class of a nearest neighbour had a rate of a seventh of its number."""
    counts = confusion(spark, sf_dir)
    rates = counts.select("predicted", "actual", (F.col("predicted") / 7.0).alias("rate"))
    return evaluate.expected_by_class(counts, rates)


def wanted_files(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*map(F.lit, [".md", ".PY", ".exe", "", ".tar.gz", ".json"])), (F.col("doc_id") % 6 + 1).cast("int"))
    rows = d.select(F.concat(F.lit("/a.b/file"), F.col("doc_id").cast("string"), ext).alias("path"), (F.col("n_chars") * 1000).alias("size"))
    return rows.filter(files.wanted(F.col("path"), F.col("size")))


def mining(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("path"), F.concat(F.lit("/docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("own"), F.col("text").alias("content"), "doc_id")
    # Every second document is a file that the store holds already, under its source's path; the others are new.
    d = d.select(F.when(F.col("doc_id") % 2 == 0, F.col("path")).otherwise(F.col("own")).alias("path"), "content")
    new = files.mined(d, "docs", store.drawers(items(spark, sf_dir)))
    return files.mining_report(d, new)


def sizes(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", text.human_bytes(F.col("n_chars") * F.col("n_chars")).alias("size"))


def passage_results(spark, sf_dir):
    ranked = saved(lexical.bm25(stored_index(spark, sf_dir), passages(spark, sf_dir), 10), "ranked")
    return lexical.hydrated(ranked, items(spark, sf_dir), ranked.count() <= lexical.BROADCAST_TERMS)


def recall_by_answer(spark, sf_dir):
    q = passages(spark, sf_dir)
    results = passage_results(spark, sf_dir).join(q, "query_id")
    return evaluate.recall(q, evaluate.first_hits(results, evaluate.contains_answer(F.col("content"), F.col("query"))))


def recall_by_source(spark, sf_dir):
    q = passages(spark, sf_dir).withColumn("type", F.col("query_id") % 3)
    hit = F.col("source_file") == F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string"))
    return evaluate.recall(q, evaluate.first_hits(passage_results(spark, sf_dir), hit), ["type"])


def recall_scoped(spark, sf_dir):
    q = passages(spark, sf_dir)
    haystack = q.select("query_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("src"), ((F.col("query_id") + i) % 20).cast("string")))).alias("source_file"))
    hit = F.col("source_file") == F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string"))
    return evaluate.recall(q, evaluate.first_hits(evaluate.scoped(passage_results(spark, sf_dir), haystack), hit))


def label_results(spark, sf_dir):
    v = vectors(spark, sf_dir).select("drawer_id", F.col("label").alias("found"))
    q = vectors(spark, sf_dir).select(F.col("drawer_id").alias("query_id"), "label")
    return vector.search(vectors(spark, sf_dir), vector_queries(spark, sf_dir), 11).filter("drawer_id <> query_id").join(v, "drawer_id").join(q, "query_id")


def confusion(spark, sf_dir):
    first = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    return evaluate.confusion(label_results(spark, sf_dir).withColumn("n", first).filter("n = 1").select(F.col("found").alias("predicted"), F.col("label").alias("actual")))


def accuracy(spark, sf_dir):
    first = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    return evaluate.accuracy(label_results(spark, sf_dir).withColumn("n", first).filter("n = 1").select(F.col("found").alias("predicted"), F.col("label").alias("actual")))


def best_weights(spark, sf_dir):
    """The best fusion weight by language of the first passage's letter, of hits in the passage's own source."""
    swept = hybrid_sweep(spark, sf_dir).join(items(spark, sf_dir).select("drawer_id", "source_file"), "drawer_id")
    hit = F.col("source_file") == F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string"))
    firsts = swept.groupBy("query_id", "weight").agg(F.min(F.when(hit, F.col("rank"))).alias("first"))
    rates = firsts.groupBy((F.col("query_id") % 4).alias("kind"), "weight").agg(F.avg(F.coalesce((F.col("first") <= 5).cast("double"), F.lit(0.0))).alias("r5"))
    return rounded(evaluate.best_weights(rates, "kind"), "r5")


def hits_by_size(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("context_size"), F.max(F.col("text").contains("the")).alias("hit"))
    return evaluate.by_size(c)


def lenient_and_strict(spark, sf_dir):
    results = vector.search(vectors(spark, sf_dir), vector_queries(spark, sf_dir), 10).withColumn("source_file", (F.col("drawer_id") % 40).cast("string"))
    evidence = vector_queries(spark, sf_dir).select("query_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("position")).withColumn("source_file", ((F.col("query_id") + F.col("position") * 7) % 40).cast("string"))
    return evaluate.lenient_and_strict(results, evidence)


def evidence_hits(spark, sf_dir):
    chunks = session_chunks(spark, sf_dir)
    return chunks.select("session", "chunk", evaluate.evidence_hit(F.col("source_file"), F.array(F.lit("D:1"), F.lit("D:5"))).alias("hit"))


NAMES = """term_frequencies vocabulary corpus_statistics stored_drawers added_drawers listed_drawers drawer_count wing_names room_names detected_rooms
status wing_breakdown tunnels tunnels_between pending_embeddings embedded_count bm25_single bm25_passages bm25_wing bm25_scope vector_search vector_search_wing
label_means hybrid hybrid_auto hybrid_sweep hybrid_recency multiview merged_views_sum merged_views_max blended_views question_types anchor_types graph_entities
graph_triples graph_outgoing graph_incoming graph_both graph_as_of_all graph_timeline graph_stats graph_invalidated graph_contradictions graph_conflicts summary
wake_up session_views session_chunks transcripts message_lines wanted_files mining sizes recall_by_answer recall_by_source recall_scoped confusion accuracy
bm25_by_wing best_weights hits_by_size lenient_and_strict evidence_hits index_build message_tree team_messages got_drawers ann_sizes ann_recall reranked expanded_queries coded_vectors
prepared_anchors put_entities normal_answers first_bytes listed_sessions whole_sessions rendered_results session_order expected_by_class""".split()
QUERIES = {name: globals()[name] for name in NAMES}

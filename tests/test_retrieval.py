import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions import text
from larkspur.operators import ann, classify, evaluate, fusion, lexical, store, vector

DRAWERS = [(1, "We decided to use OAuth for authentication and login flows", "a", "x"), (2, "The database migration needs PostgreSQL", "b", "y"), (3, "The frontend uses React components", "a", "y")]


@pytest.fixture(scope="module")
def stored(spark):
    return store.drawers(spark.createDataFrame(DRAWERS, "drawer_id long, content string, wing string, room string").withColumn("source_file", F.concat(F.lit("s"), F.col("drawer_id").cast("string")))).cache()


def asked(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")


def ids(df):
    return [r.drawer_id for r in df.orderBy("query_id", "rank").collect()]


def test_lexical(spark, stored):
    index = lexical.postings(stored)
    assert ids(lexical.bm25(index, asked(spark, "authentication OAuth login"))) == [1]
    assert ids(lexical.bm25(index, asked(spark, "database migration"), filtered=lexical.scope(stored, "a"))) == []
    assert ids(lexical.bm25(index, asked(spark, "", "quantum physics"))) == []
    line = lexical.rendered(lexical.hydrated(lexical.bm25(index, asked(spark, "database")), stored)).first().line
    assert line.startswith("[1] b / y  (score: ") and "Source: s2" in line


def test_terms_of_all_documents_score_zero_but_are_found(spark):
    docs = spark.createDataFrame([(i, "alpha beta") for i in (1, 2, 3)], "drawer_id long, content string")
    found = lexical.bm25(lexical.postings(docs), asked(spark, "alpha beta")).collect()
    assert [(r.drawer_id, r.score) for r in sorted(found)] == [(1, 0.0), (2, 0.0), (3, 0.0)]


def test_lexical_against_plain_python(spark):
    rng = random.Random(5)
    words = ["apple", "berri", "cherri", "date", "elder", "fig", "grape"]
    docs = {i: [rng.choice(words) for _ in range(rng.randint(1, 9))] for i in range(40)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "drawer_id long, content string")
    query = ["apple", "fig", "fig"]
    tf = {i: {t: n / len(w) for t, n in Counter(w).items()} for i, w in docs.items()}
    idf = {t: max(0, math.log((40 - n + 0.5) / (n + 0.5))) for t in words for n in [sum(t in w for w in docs.values())]}
    scores = {i: sum(idf[t] * 2.5 * f[t] / (f[t] + 1.5) for t in query if t in f) for i, f in tf.items() if set(query) & set(f)}
    got = {r.drawer_id: r.score for r in lexical.bm25(lexical.postings(df), asked(spark, " ".join(query)), 50).collect()}
    assert got == pytest.approx(scores)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "drawer_id long, vector array<float>")


def vector_query(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "query_id long, query_vector array<float>")


def test_vectors(spark):
    v = vectors(spark, [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 1.0]), (4, None), (5, [1.0]), (6, [0.0, 0.0, 0.0])])
    assert ids(vector.search(v, vector_query(spark, [0.1, 0.9, 0.0]), 2)) == [2, 1]
    assert ids(vector.search(v, vector_query(spark, []), 2)) == []
    both = spark.sql("select array(1f,0f) a, array(0f,1f) b, array(-1f,0f) c, array(1f) d").select(*(F.round(vector.cosine(F.col("a"), F.col(x)), 6) for x in "abcd")).first()
    assert list(both) == [1, 0, -1, 0]
    assert vector.decode(vector.encode([1.5, -2.0])) == [1.5, -2.0] and vector.encode([]) is None and vector.decode(b"") is None
    with pytest.raises(ValueError):
        vector.decode(b"\0\0\0\2abcd")
    means = vector.mean_vectors(spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("b", [1.0]), ("b", [1.0, 2.0])], "k string, vector array<float>"), "k")
    assert {r.k: r.vector for r in means.collect()} == {"a": [2.0, 3.0], "b": None}


def test_many_queries_meet_all_vectors(spark, monkeypatch):
    """Blocks of queries find what one matrix finds, and sessions are merged alike by tasks and by pairs."""
    rng = np.random.default_rng(2)
    v = vectors(spark, [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(90, 5)))] + [(99, [1.0, 0.0])])
    q = vector_query(spark, *[x.tolist() for x in rng.normal(size=(9, 5))], [])
    views = v.withColumns({"source_file": F.floor(F.col("drawer_id") / 4).cast("string"), "hall": F.concat(F.lit("L"), (F.col("drawer_id") % 4).cast("string"))})
    weights = {"L0": 0.2, "L1": 0.5, "L2": 0.3}
    scored = vector.search(v, q, 200).join(views.select("drawer_id", "source_file", "hall"), "drawer_id")
    rows = lambda df: sorted((r.query_id, r["rank"], r.source_file if "source_file" in df.columns else r.drawer_id, round(r.score, 6)) for r in df.collect())
    want = rows(vector.search(v, q, 7)), *(rows(fusion.merged_views(scored, weights, mode, 6)) for mode in ("max", "sum"))
    assert tuple(rows(fusion.session_search(views, q, weights, mode, 6)) for mode in ("max", "sum")) == want[1:]
    monkeypatch.setattr(vector, "QUERY_BLOCK", 4)
    assert (rows(vector.search(v, q, 7)), *(rows(fusion.session_search(views, q, weights, mode, 6)) for mode in ("max", "sum"))) == want


def test_stored_index_gives_the_same(spark, monkeypatch):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["running", "runs", "apples", "apple", "trying", "the", "sky"]) for _ in range(rng.randint(0, 6)))) for i in range(50)], "drawer_id long, content string")
    q = asked(spark, "run apples", "sky sky", "", "none")
    rows = lambda index: sorted((r.query_id, r["rank"], r.drawer_id, round(r.score, 9)) for r in lexical.bm25(index, q, 10).collect())
    want = rows(lexical.postings(docs))
    index = lexical.stored(lexical.postings(docs, corpus=True))
    assert rows(index) == want and len(want) > 10
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", 0)
    assert rows(index) == want


def test_types_beyond_a_thousand(spark):
    means = spark.range(1500).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("type"), F.array(F.cos(F.col("id") / 1000), F.sin(F.col("id") / 1000)).cast("array<float>").alias("vector"))
    q = vector_query(spark, [math.cos(1.4), math.sin(1.4)], [math.cos(0.2), math.sin(0.2)])
    assert {r.query_id: r.type for r in classify.nearest_anchor(q, means).collect()} == {0: "t1400", 1: "t200"}


def test_codec_column(spark):
    v = vectors(spark, [(1, [1.5, 2.0]), (2, None)])
    back = v.select("drawer_id", vector.coded(vector.coded(F.col("vector")), True).alias("v")).collect()
    assert {r.drawer_id: r.v for r in back} == {1: [1.5, 2.0], 2: None}


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, drawer_id long, score double, rank int")


def test_fusion(spark):
    a, b = ranked(spark, [(0, 1, 9.0, 1), (0, 2, 8.0, 2)]), ranked(spark, [(0, 2, 0.9, 1), (0, 3, 0.8, 2)])
    got = {r.drawer_id: r.score for r in fusion.fused(a, b, 0.7, 10).collect()}
    assert got == pytest.approx({1: 0.7 / 61, 2: 0.7 / 62 + 0.3 / 61, 3: 0.3 / 62})
    assert ids(fusion.fused(a, b, 7.0, 1)) == [1]


def test_recency(spark):
    lst = ranked(spark, [(0, 100, 1.0, 1), (0, 200, 1.0, 2), (0, 50, 1.0, 3)])
    assert ids(fusion.recency(lst, 0.5)) == [200, 100, 50]
    assert {r.score for r in fusion.recency(lst, 0).collect()} == {1.0}


def test_views(spark):
    pool = spark.createDataFrame([(0, 1, 0.2, "A"), (0, 2, 0.9, "A"), (0, 3, 0.5, "B"), (0, 4, 0.1, "")], "query_id long, drawer_id long, score double, source_file string").withColumn("rank", F.lit(0))
    assert ids(fusion.collapsed(pool, 5)) == [2, 3, 4]
    scored = spark.createDataFrame([(0, "A", "L0", 0.5), (0, "A", "L1", -0.5), (0, "B", "L0", -0.9), (0, "C", "L9", 0.9)], "query_id long, source_file string, hall string, score double")
    weights = {"L0": 0.2, "L1": 0.5, "L2": 0.3}
    best = fusion.merged_views(scored, weights, "max", 5).collect()
    assert [(r.source_file, round(r.score, 6)) for r in best] == [("A", 0.1)]
    assert {r.source_file: round(r.score, 6) for r in fusion.merged_views(scored, weights, "sum", 5).collect()} == {"A": -0.15, "B": -0.18, "C": 0.0}


def test_rerank_and_expansion(spark):
    rows = spark.createDataFrame([(0, "q", 1, "x", 3.0, 1), (0, "q", 2, "xx", 2.0, 2), (1, "bad", 3, "x", 3.0, 1), (1, "bad", 4, "xx", 2.0, 2)], "query_id long, query string, drawer_id long, content string, score double, rank long")

    def scorer(query, docs):
        if query == "bad":
            raise OSError
        return [float(len(d)) for d in docs]

    got = {(r.query_id, r.rank): r.drawer_id for r in fusion.reranked(rows, scorer).collect()}
    assert got == {(0, 1): 2, (0, 2): 1, (1, 1): 3, (1, 2): 4}
    q = spark.createDataFrame([(0, "a", [1.0, 1.0])], "query_id long, query string, query_vector array<float>")
    assert fusion.expanded(q, lambda x: x, lambda x: [[3.0, 1.0]]).first().query_vector == [2.0, 1.0]


def test_graph_index_recall(spark, tmp_path):
    rng = np.random.default_rng(1)
    data, queries = rng.normal(size=(1000, 64)), rng.normal(size=(50, 64))
    v, q = vectors(spark, [(i, x.tolist()) for i, x in enumerate(data)]), vector_query(spark, *[x.tolist() for x in queries])
    index = ann.load_or_build(spark, str(tmp_path / "ann"), v)
    assert ann.size(index).first()["size"] == 1000
    got, want = ({} for _ in range(2))
    for out, df in ((got, ann.search(index, q, 10)), (want, vector.search(v, q, 10))):
        for r in df.collect():
            out.setdefault(r.query_id, set()).add(r.drawer_id)
    assert sum(len(got[k] & want[k]) for k in want) / 500 >= 0.9
    assert [r.bytes > 1000 * 64 * 4 for r in ann.listing(spark, {"one": str(tmp_path / "ann")}).collect()] == [True]
    shards = ann.search(ann.build(v, 4), q, 10).collect()
    assert sum(r.drawer_id in want[r.query_id] for r in shards) / 500 >= 0.9
    g = ann.Graph(64).fill(range(200), data[:200])
    again = ann.Graph(64).fill(range(200), data[:200]).fill([3], -data[3:4])
    assert 3 not in [i for i, _ in again.search(data[3], 5)] and again.search(-data[3], 1)[0][0] == 3
    back = ann.Graph.load(64, g.ids, g.vectors, g.dump())
    assert back.search(queries[0], 5) == g.search(queries[0], 5)


LABELS = {
    "Can you remind me what we discussed?": "single-session-assistant", "please suggest a book": "single-session-preference", "Which trip was first?": "temporal-reasoning",
    "how many weeks did it take": "temporal-reasoning", "  How many cats do I own": "multi-session", "Where did I park": "single-session-user", "": "single-session-user",
}


def test_question_types(spark):
    df = asked(spark, *LABELS)
    assert {r.query: r.t for r in df.select("query", classify.question_type(F.col("query")).alias("t")).collect()} == LABELS


def test_anchors(spark):
    means = classify.anchor_means(spark.createDataFrame([(t, [1.0 if i == j else 0.0 for j in range(8)]) for i, t in enumerate(classify.ANCHORS)], "type string, vector array<float>"))
    q = vector_query(spark, [0.0, 0.9, 0.1, 0.0, 0.0, 0.0, 0.0, 0.0], [], [1.0])
    assert {r.query_id: r.type for r in classify.nearest_anchor(q, means).collect()} == {0: list(classify.ANCHORS)[1], 1: classify.USER, 2: classify.USER}


def test_answers(spark):
    rows = [("My dog is called Rex.", "rex", True), ("alpha beta", "alpha beta gamma", True), ("alpha", "alpha beta gamma", False), ("x", "", True), ("x", "the of", False)]
    df = spark.createDataFrame(rows, "c string, a string, w boolean")
    assert all(r.w == r.g for r in df.select("w", evaluate.contains_answer(F.col("c"), F.col("a")).alias("g")).collect())


def test_evaluation(spark):
    counts = spark.createDataFrame([("a", "a", 3), ("b", "a", 1)], "predicted string, actual string, n long")
    rates = spark.createDataFrame([("a", "a", 0.5), ("b", "a", 1.0)], "predicted string, actual string, rate double")
    row = evaluate.expected_by_class(counts, rates).first()
    assert (row.expected, row.n) == (3.0, 4)
    sizes = {r.context_size: (r.n, r.hits, r.percent) for r in evaluate.by_size(spark.createDataFrame([(1, True), (1, False), (2, True)], "context_size int, hit boolean")).collect()}
    assert sizes == {1: (2, 1, 50.0), 2: (1, 1, 100.0), None: (3, 2, pytest.approx(66.666667))}


def test_text_module_keeps_the_word_list_whole():
    assert len(text.STOPWORDS) == len(set(text.STOPWORDS)) == 96


def test_stores_of_their_own(spark):
    """Documents of several stores: N and df count within each."""
    rows = [(i, "abc"[i % 3], " ".join(w for k, w in enumerate(("apple", "fig", "plum", "date", "kiwi")) if (i * 7 + k) % (k + 2) == 0)) for i in range(60)]
    docs = spark.createDataFrame(rows, "drawer_id long, store string, content string")
    q = spark.createDataFrame([(0, "apple figs", "a"), (1, "plum kiwi plum", "b"), (2, "date", "c"), (3, "date", "none")], "query_id long, query string, store string")
    shape = lambda df: sorted((r.query_id, r["rank"], r.drawer_id, round(r.score, 9)) for r in df.collect())
    want = []
    for s in "abc":
        want += shape(lexical.bm25(lexical.postings(docs.filter(F.col("store") == s)), q.filter(F.col("store") == s), 4))
    assert shape(lexical.bm25_by(lexical.postings_by(docs, "store"), q, "store", 4)) == sorted(want) and len(want) > 8


def test_results_are_hydrated_without_moving_other_contents(spark, stored):
    found = spark.createDataFrame([(0, 1, 2.0, 1), (0, 9, 1.0, 2), (1, 1, 0.5, 1)], "query_id long, drawer_id long, score double, rank int")
    rows = lambda df: sorted((r.query_id, r["rank"], r.content, r.wing) for r in df.collect())
    assert rows(lexical.hydrated(found, stored, True)) == rows(lexical.hydrated(found, stored)) == [(0, 1, DRAWERS[0][1], "a"), (0, 2, None, None), (1, 1, DRAWERS[0][1], "a")]
    assert "BroadcastHashJoin [drawer_id" in lexical.hydrated(found, stored, True)._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("cells", [1, 12, 1000])
def test_scores_are_computed_in_bounded_steps(spark, monkeypatch, cells):
    """The steps' size doesn't decide, and no step scores more than its bound."""
    rng = np.random.default_rng(8)
    v = vectors(spark, [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(40, 3)).round(1))] + [(99, [1.0])])
    q = vector_query(spark, *[x.tolist() for x in rng.normal(size=(4, 3))])
    views = v.withColumns({"source_file": F.floor(F.col("drawer_id") / 4).cast("string"), "hall": F.concat(F.lit("L"), (F.col("drawer_id") % 4).cast("string"))})
    rows = lambda df: sorted((r.query_id, r["rank"], r[1], round(r.score, 9)) for r in df.collect())
    both = lambda: [rows(vector.search(v, q, 7)), *(rows(fusion.session_search(views, q, {"L0": 0.2, "L1": 0.5}, m, 6)) for m in ("max", "sum"))]
    want = both()
    whole = vector.cosines

    def bounded(queries, some):
        assert len(queries) * len(some) <= max(cells, len(queries))
        return whole(queries, some)

    monkeypatch.setattr(vector, "CELLS", cells)
    monkeypatch.setattr(vector, "cosines", bounded)
    assert both() == want
    monkeypatch.setattr(vector, "QUERY_BLOCK", 2)
    assert both() == want


def test_recall_holds_in_larger_graphs(spark, monkeypatch):
    """A beam of one width finds too few in a larger graph; and a graph's size is bounded, whatever number of shards is asked for."""
    rng = np.random.default_rng(4)
    data, queries = rng.normal(size=(4000, 64)), rng.normal(size=(40, 64))
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    monkeypatch.setattr(ann, "BEAM_BUILD", 60)  # spares time
    g = ann.Graph(64).fill(range(4000), data)
    share = lambda beam: sum(len({i for i, _ in g.search(q, 10, beam)} & set(np.argsort(-(unit @ q), kind="stable")[:10].tolist())) for q in queries) / 400
    assert share(64) < 0.95 <= share(None)
    monkeypatch.setattr(ann, "SHARD", 100)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    v, q = vectors(spark, [(i, x.tolist()) for i, x in enumerate(data[:450])]), vector_query(spark, *[x.tolist() for x in queries[:8]])
    index = ann.build(v, 4)
    assert index.count() == 5 and ann.size(index).first()["size"] == 450
    found = ann.search(index, q, 10)
    want = {(r.query_id, r.drawer_id) for r in vector.search(v, q, 10).collect()}
    assert len({(r.query_id, r.drawer_id) for r in found.collect()} & want) >= 0.9 * len(want)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsIn") == 1


def test_pairs_are_dealt_by_document(spark, monkeypatch):
    """Tasks of few pairs find the same, and pairs of queries and documents don't move before each task's best are known."""
    docs = spark.createDataFrame([(i, " ".join(w for k, w in enumerate(("apple", "fig", "plum", "date")) if (i + k) % (k + 2) == 0)) for i in range(80)], "drawer_id long, content string")
    index, q = lexical.stored(lexical.postings(docs, corpus=True)), asked(spark, "apple fig", "plum date plum", "fig")
    rows = lambda df: sorted((r.query_id, r["rank"], r.drawer_id, round(r.score, 9)) for r in df.collect())
    want, narrowed = rows(lexical.bm25(index, q, 5)), docs.filter("drawer_id % 3 = 0")
    fewer = rows(lexical.bm25(lexical.postings(docs), q, 5, narrowed))
    monkeypatch.setattr(lexical, "PAIRS", 20)
    found = lexical.bm25(index, q, 5)
    assert rows(found) == want == rows(lexical.bm25(lexical.postings(docs), q, 5)) and rows(lexical.bm25(index, q, 5, narrowed)) == fewer
    plan = lexical.bm25(index, q, 5)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" in plan and not [x for x in plan.splitlines() if "hashpartitioning(query_id" in x and "drawer_id" in x]
    assert "REPARTITION_BY_NUM" in plan

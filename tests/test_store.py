import json

import pytest
from pyspark.sql import functions as F

from larkspur import config, models
from larkspur.memory import Memory, tools
from larkspur.operators import graph, store
from larkspur.plans import layers
from larkspur.sources import conversations, files

ITEM = "drawer_id long, content string, wing string, room string, hall string, source_file string"


def test_contents_are_kept_once(spark):
    rows = [(1, "a", "w", "r", "facts", "s"), (2, "a", "v", "q", "facts", "s"), (3, "a", "w", "r", "facts", "t"), (4, "a", "w", "r", "advice", "s"), (5, None, "w", "r", None, None)]
    kept = store.drawers(spark.createDataFrame(rows, ITEM))
    assert sorted(r.drawer_id for r in kept.collect()) == [1, 3, 4, 5]
    more = spark.createDataFrame([(9, "a", "w", "r", "facts", "s"), (10, "b", "w", "r", "facts", "s")], ITEM)
    assert [r.drawer_id for r in store.add_drawers(kept, more).collect()] == [10]
    views = spark.createDataFrame([(1, "w", "r", "s", "all", "own", "")], "drawer_id long, wing string, room string, source_file string, L0 string, L1 string, L2 string")
    assert sorted((r.drawer_id, r.hall) for r in store.add_variants(kept, views, ["L0", "L1", "L2"]).collect()) == [(3, "L0"), (4, "L1")]


def test_rooms_and_tunnels(spark):
    docs = spark.createDataFrame([(1, "auth auth login login token"), (2, "the of"), (3, None)], "id long, t string")
    assert {r.id: r.room for r in store.detect_rooms(docs, "id", "t").collect()} == {1: "auth-login", 2: "general", 3: "general"}
    kept = spark.createDataFrame([(1, "w", "r"), (2, "v", "r"), (3, "w", "q"), (4, "w", "r")], "drawer_id long, wing string, room string")
    assert [(r.room, r.wings, r.drawers) for r in store.tunnels(kept).collect()] == [("r", ["v", "w"], 3)]
    assert store.tunnels(kept, "w", "none").count() == 0


FACT = "seq long, subject string, predicate string, object string, valid_from string, valid_to string"


def facts(spark, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], FACT)
    return graph.new_triples(graph.normal_facts(df.limit(0)), df), graph.named_entities(df)


def ask(spark, triples, entities, name, as_of=None, direction="both"):
    return graph.about(triples, entities, spark.createDataFrame([(name, as_of)], "name string, as_of string"), direction).collect()


def test_graph(spark):
    t, e = facts(spark, ("Kai", "works on", "Orion", "2025-06-01", ""), ("kai", "works on", "ORION", "2025-07-01", ""), ("Kai", "recommended", "Clerk", "2026-01-15", ""), ("Kai", "knows", "Kai", "", ""))
    assert t.count() == 3 and {r.name for r in e.collect()} == {"Kai", "Orion", "Clerk"}
    assert len(ask(spark, t, e, "KAI")) == 4  # the loop shows twice
    closed = graph.invalidated(t, spark.createDataFrame([("Kai", "works on", "Orion", "2026-03-01")], "subject string, predicate string, object string, ended string"))
    assert [r.object_name for r in ask(spark, closed, e, "Kai", "2026-04-01", "outgoing")] == ["Clerk", "Kai"] or len(ask(spark, closed, e, "Kai", "2026-04-01", "outgoing")) == 2
    assert {r.object_name for r in ask(spark, closed, e, "Kai", "2026-03-01", "outgoing")} == {"Orion", "Clerk", "Kai"}
    assert [r.predicate for r in graph.timeline(t, e, "kai").collect()] == ["works_on", "recommended", "knows"]
    assert list(graph.stats(closed, e).first()) == [3, 3, 2, 1]
    new = spark.createDataFrame([(0, "Kai", "works on", "Nova", "", ""), (1, "Kai", "recommended", "Clerk", "", "")], FACT)
    assert [r.other for r in graph.conflicts(t, new).collect()] == ["orion"]
    assert {(r.entity, r.hops) for r in graph.reach(t, spark.createDataFrame([("orion",)], "entity_id string"), 2).collect()} == {("orion", 0), ("kai", 1), ("clerk", 2)}


def turns(spark, path, content):
    return [(r.speaker, r.content) for r in conversations.parse(spark.createDataFrame([(path, content)], "path string, content string")).orderBy("turn").collect()]


def test_formats(spark):
    lines = "\n".join(['{"role": "user", "content": "Hi"}', "no json", "", '{"role": "assistant", "content": [{"text": "a"}, {"type": "x"}, {"text": "b"}]}', '{"role": "", "content": "x"}', '{"role": "user", "content": 5}'])
    assert turns(spark, "c.jsonl", lines) == [("user", "Hi"), ("assistant", "a b")]
    node = lambda role, parts, t: {"message": {"author": {"role": role}, "content": {"parts": parts}, "create_time": t}}
    tree = {"mapping": {"z": node("user", ["He", 3, "y"], 1), "a": node("assistant", ["Yo"], 2), "n": {"message": None}, "m": {"message": {"content": {"parts": ["x"]}}}}}
    assert turns(spark, "c.json", json.dumps(tree)) == [("user", "Hey"), ("assistant", "Yo")]
    team = {"messages": [{"user": "u", "text": "a", "ts": "1"}, {"text": "b"}, {"user": "v"}]}
    assert turns(spark, "c.json", json.dumps(team)) == [("u", "a"), ("unknown", "b")]
    plain = "noise\nHuman: hello\n  more\n\nAI: hi\nUser: bye\nhuman: lower"
    assert turns(spark, "c.txt", plain) == [("human", "hello\nmore"), ("assistant", "hi"), ("human", "bye\nhuman: lower")]


def test_views_and_chunks(spark):
    rows = [(1, i, s, c) for i, (s, c) in enumerate([("Human", "q1"), ("assistant", "a1"), ("user", "q2"), ("user", "q3"), ("user", "q4"), ("assistant", "a2")])]
    views = {r.hall: r.content for r in conversations.views(spark.createDataFrame(rows, "conv_id long, turn int, speaker string, content string")).collect()}
    assert views["L1"] == "q1\nq2\nq3\nq4" and views["L2"] == "q1\nq2\nq3" and views["L0"].startswith("Human: q1\nassistant: a1")
    df = spark.createDataFrame([("one two three",), ("",)], "t string").select(conversations.packed_words(F.col("t"), 7).alias("p"))
    assert [r.p for r in df.collect()] == [["one two", "three"], []]
    names = spark.createDataFrame([("session_12",), ("session_1_date_time",)], "n string").select(conversations.session_number(F.col("n")).alias("x"))
    assert [r.x for r in names.collect()] == [12, None]


def test_files(spark, tmp_path):
    for name, content in (("a.md", "some words here"), ("b.exe", "binary binary"), ("c", "no extension at all"), ("d.txt", "short"), ("sub/e.md", "some words here")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(content)
    found = files.read_files(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["a.md", "c", "e.md"]


def test_layers(spark, tmp_path):
    (tmp_path / "id.txt").write_text("  I am an engine.\n")
    identity = layers.identity(str(tmp_path / "id.txt"))
    wings = spark.createDataFrame([("myapp", "project", "k"), ("empty", None, None)], "wing string, type string, keywords string")
    kept = spark.createDataFrame([(1, "myapp", "auth", "facts", "s.md")], "drawer_id long, wing string, room string, hall string, source_file string")
    text = layers.wake_up(wings, kept, identity).first()[0]
    assert text == "## L0 — IDENTITY\nI am an engine.\n\n## L1 — CRITICAL FACTS\nEMPTY(general)\nMYAPP(project) | k\n  ROOMS: auth(1)\nRECENT:\n  myapp/auth [facts] s.md"
    assert layers.identity(str(tmp_path / "none")) == ""


def test_models():
    calls = []

    def send(url, body, key):
        calls.append(body["input"])
        if "poison" in body["input"]:
            raise ValueError
        return {"data": [{"index": i, "embedding": [float(len(t))]} for i, t in reversed(list(enumerate(body["input"])))]}

    e = models.Embedder("u", "m", send=send, sleep=lambda s: None)
    assert e(["a", "bb"]) == [[1.0], [2.0]]
    with pytest.raises(ValueError):
        e(["a", "poison"])
    assert models.Reranker("u", "m", send=lambda *a: {"results": [{"index": 1, "relevance_score": 0.5}]})("q", ["a", "b"]) == [0.0, 0.5]
    assert models.HashEmbedder(8)(["", "word word"])[0] == [0.0] * 8
    c = config.load({"LARKSPUR_EMBEDDINGS_API_KEY": "k", "LARKSPUR_RERANK_URL": "u", "HOME": "/h"})
    assert c.rerank == ("u", "", "k") and not c.enabled(c.rerank) and c.identity == "/h/.larkspur/identity.txt"


def test_memory(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "store"), models.HashEmbedder(64))
    rows = [("OAuth login was chosen", "app", "auth"), ("Database migration to PostgreSQL", "app", "data"), ("OAuth login was chosen", "other", "auth")]
    assert m.add(spark.createDataFrame(rows, "content string, wing string, room string")) == 2
    assert m.reindex() == 2 and m.reindex() == 0
    for mode in ("bm25", "vector", "hybrid"):
        assert m.search("oauth login", mode).first().room == "auth"
    assert m.search("oauth login", "vector", hnsw=True).first().room == "auth"
    assert m.search("oauth login", "vector", views=True, recency=0.1).count() == 2
    with pytest.raises(ValueError):
        m.search("x", wing="none")
    m.add_fact("Kai", "works on", "Orion", "2025-06-01")
    assert m.add_fact("Kai", "works on", "Nova").first().other == "orion"
    m.end_fact("Kai", "works on", "Orion", "2025-07-01")
    assert list(m.fact_stats().first()) == [3, 2, 1, 1]
    t = tools(m)
    assert "auth" in t["search"]({"query": "oauth", "wing": "none"}) and t["add_drawer"]({"content": "new fact", "wing": "w"}) == "added"
    assert "Kai" in t["kg_query"]({"entity": "Kai"}) and "drawers=3" in t["status"]({}) and "CRITICAL FACTS" in t["wake_up"]({})


def test_blank_queries_and_lookups(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "store"), models.HashEmbedder(16))
    m.add(spark.createDataFrame([("alpha beta", "w", "r")], "content string, wing string, room string"))
    m.reindex()
    for mode in ("bm25", "vector", "hybrid"):
        assert m.search("  ", mode).count() == 0
    one = m.search("alpha", "bm25").first().drawer_id
    assert m.drawer(one).first().content == "alpha beta" and m.drawer(one + 1).count() == 0
    assert "content=alpha beta" in tools(m)["get_drawer"]({"id": one})


def test_a_failed_write_leaves_no_trace(spark, tmp_path, monkeypatch):
    """Drawers whose postings fail don't count; the next run adds both."""
    m = Memory(spark, str(tmp_path / "store"))
    items = spark.createDataFrame([("alpha beta", "w", "r"), ("gamma", "w", "r")], "content string, wing string, room string")
    whole = m.tables.write
    monkeypatch.setattr(m.tables, "write", lambda name, *a: 1 / 0 if name == "postings" else whole(name, *a))
    with pytest.raises(ZeroDivisionError):
        m.add(items)
    assert m.status().first().drawers == 0 and m.tables.read("postings").count() == 0
    monkeypatch.undo()
    assert m.add(items) == 2 and m.add(items) == 0 and m.search("gamma", "bm25").count() == 1


def test_appends_write_what_is_new(spark, tmp_path, monkeypatch):
    from larkspur.sources import tables

    t = tables.Tables(spark, str(tmp_path / "t"))
    row = lambda i: spark.createDataFrame([("a", i, 0.5)], tables.SCHEMAS["postings"])
    t.append("postings", row(1))
    first = t.state()[1]["postings"]
    t.append("postings", row(2), "term")
    assert t.state()[1]["postings"][:1] == first and sorted(r.drawer_id for r in t.read("postings").collect()) == [1, 2]
    since, _ = t.state()
    t.append("postings", row(3))
    with pytest.raises(RuntimeError):
        t.commit(since, {"postings": []})
    monkeypatch.setattr(tables, "MOST_PARTS", 2)
    t.append("postings", row(4))
    assert len(t.state()[1]["postings"]) == 1 and t.read("postings").count() == 4


def test_benchmark(spark, tmp_path):
    from larkspur import benchmark

    took = benchmark.run(spark, 60, 8, 3, str(tmp_path / "b"))
    assert set(took) == {"insert", "index", "bm25", "scan", "graph_build", "graph", "hybrid"}


def test_question_sets(spark, tmp_path):
    """From the JSON files of the three sets to recall."""
    from larkspur.plans import harness

    told = lambda *lines: [{"role": r, "content": c} for r, c in lines]
    haystack = {"s1": told(("user", "my parrot is called Zaphod")), "s2": told(("user", "tea harbour lights"), ("assistant", "noted")), "s3": told(("user", "we walked up the glacier"))}
    question = lambda i, kind, q, a, ids: {"question_id": i, "question_type": kind, "question": q, "answer": a, "haystack_sessions": [haystack[x] for x in ("s1", "s2", "s3")], "haystack_session_ids": ["s1", "s2", "s3"], "answer_session_ids": ids}
    rows = [question("q1", "a", "what is the parrot called", "Zaphod", ["s1"]), question("q2", "a", "glacier walked", ["the", "glacier"], ["s2"]), question("q3", "b", "unheard matters", 7, ["s3"])]
    (tmp_path / "sessions.json").write_text(json.dumps(rows))
    for scoped in (False, True):
        got = {(r.measure, r.type): (r.n, round(r.r1, 2), round(r.r10, 2)) for r in harness.sessions(files.read_sessions(spark, str(tmp_path / "sessions.json")), scoped).collect()}
        assert got == {("text", "a"): (2, 100.0, 100.0), ("text", "b"): (1, 0, 0), ("text", None): (3, 66.67, 66.67), ("session", "a"): (2, 50.0, 50.0), ("session", "b"): (1, 0, 0), ("session", None): (3, 33.33, 33.33)}

    said = lambda k, *texts: [{"speaker": "Ann", "dia_id": f"D{k}:{i}", "text": t} for i, t in enumerate(texts)]
    talk = {"session_1": said(1, "violin lessons", "rainy Monday", "other things"), "session_2": said(2, "new bicycle", "sore knees", "more"), "session_1_date_time": "May"}
    qa = [{"question": "violin", "answer": 1, "evidence": ["D1:0"], "category": 1}, {"question": "bicycle knees", "answer": "x", "evidence": ["D1:1"], "category": 5}]
    (tmp_path / "talk.json").write_text(json.dumps([{"sample_id": "t", "qa": qa, "conversation": talk}]))
    got = {r.category: (r.n, r.r1) for r in harness.dialogues(files.read_dialogues(spark, str(tmp_path / "talk.json")), 1).collect()}
    assert got == {1: (1, 100.0), 5: (1, 0.0), None: (2, 50.0)}

    talks = [{"id": f"c{i}", "containsEvidence": i < 2, "messages": [{"speaker": "u", "text": t}]} for i, t in enumerate(["blue kayak", "green kayak", "soup recipe", "train times"])]
    (tmp_path / "cases.json").write_text(json.dumps([{"evidenceItems": [{"question": q, "answer": "x", "category": "c"} for q in ("blue", "green", "soup")], "conversations": talks, "contextSize": 4}]))
    got = {r.context_size: (r.n, r.hits, r.strict_hits) for r in harness.evidence_cases(files.read_evidence_cases(spark, str(tmp_path / "cases.json"))).collect()}
    assert got == {4: (3, 2, 1), None: (3, 2, 1)}


def test_stream(spark, tmp_path):
    from larkspur.streaming import ingest

    source = tmp_path / "in"
    spark.createDataFrame([("streamed words", "w", "r"), ("streamed words", "w", "r")], "content string, wing string, room string").write.json(str(source))
    m = Memory(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema("content string, wing string, room string").json(str(source))
    ingest.into(stream, m, str(tmp_path / "cp")).awaitTermination(120)
    assert m.status().first().drawers == 1


def test_files_of_one_path_are_taken_in_one_by_one(spark):
    """Each new file has the room of its own content, whatever other files share its path, and pairs aren't made."""
    from larkspur.sources import files

    rows = [("a.md", "auth auth login login"), ("a.md", "disk disk cache cache"), ("a.md", "disk disk cache cache"), ("b.md", "auth auth login login"), ("a.md", "old"), ("c.md", None)]
    stored = store.drawers(spark.createDataFrame([(1, "old", "w", "r", "facts", "a.md")], ITEM))
    new = files.mined(spark.createDataFrame(rows, "path string, content string"), "docs", stored)
    assert sorted((r.source_file, r.room) for r in new.collect()) == [("a.md", "auth-login"), ("a.md", "cache-disk"), ("b.md", "auth-login"), ("c.md", "general")]
    assert files.mining_report(spark.createDataFrame(rows, "path string, content string"), new).first().asDict() == {"processed": 6, "created": 4, "duplicates": 2}

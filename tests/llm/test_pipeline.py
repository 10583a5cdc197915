"""The pipeline against plain Python, stage by stage; the queries' SQL."""

import glob
import hashlib
import math
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from larkspur.llm import queries
from larkspur.llm.shingles import shingle_set

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    want = con.execute(queries.SQL[name])
    columns = sorted(c[0] for c in want.description)
    place = {c[0]: i for i, c in enumerate(want.description)}
    plain = lambda x: float(f"{x:.8g}") if isinstance(x, float) and math.isfinite(x) else x
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr) == sorted((tuple(plain(r[place[c]]) for c in columns) for r in want.fetchall()), key=repr)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    figures = {r.doc_id: r.kept for r in queries.op10_quality_rules(spark, SF).collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        docs = stage(spark, docs, SF).cache()
        after = docs.collect()
        ids = Counter(r.doc_id for r in after)
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if k == 0:
            assert set(ids) == {i for i, kept in figures.items() if kept}
        elif k == 1:
            assert set(ids) <= {r.doc_id for r in before} and len(ids) >= 0.95 * len(before)
        elif k == 2:
            sets = {r.doc_id: set(shingle_set(r.text).tolist()) for r in before}
            near = lambda a, b: sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
            root = {i: i for i in sets}
            for a in sorted(sets):
                for b in sorted(sets):
                    if a < b and near(a, b):
                        x, y = sorted((root[a], root[b]))
                        root = {i: x if r == y else r for i, r in root.items()}
            assert ids == Counter(set(root.values()))
        elif k == 3:
            words = sum(len(r.text.split()) for r in before)
            assert max(ids.values()) <= 3 and set(ids) <= {r.doc_id for r in before}
            assert abs(sum(len(r.text.split()) for r in after) - words) <= 0.35 * words
        else:
            text = {r.doc_id: r.text for r in before}
            assert ids == Counter(r.doc_id for r in before)
            assert all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() and r.n_tokens == len(r.ids) for r in after)


ODD = [(1, None, None, None), (2, "", "en", "s"), (3, " \n\t ", None, "s"), (4, "word " * 30_000, "en", None), (5, "½ ① ²", "en", "s"), (None, "a b c d e f g h i j k l", "xx", "t")]
ODD += [(6, "the house of the old man is near the river and the bridge to that town is in a field", "en", "s")] * 2 + [(6, "another text of the same key that is told apart from the one before it in the table", "en", "s")]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_with_odd_rows(spark, name, stage):
    """Nulls, empty and long texts, ties, repeated rows, clashing names, and no rows at all."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    df = df.withColumns({"row": F.lit(1), "size": F.lit("x"), "key": F.lit(2), "hash": F.lit(3), "t": F.lit(0), "n_chars": F.length("text").cast("long")})
    out = stage(spark, df, SF)
    assert stage(spark, df.limit(0), SF).count() == 0
    got = Counter((r.doc_id, r.text) for r in out.collect()) if name != "byte_bpe" else Counter(r.doc_id for r in out.collect())
    every = Counter((r[0], r[1]) for r in ODD)
    if name == "byte_bpe":
        assert got == Counter(r[0] for r in ODD)
        return
    assert out.columns == df.columns
    if name == "near_duplicates":
        assert got == Counter(set(every))
    elif name == "mix":
        assert all(t and t.strip() for _, t in got) and all(n <= 3 * every[k] for k, n in got.items())
    else:
        assert all(n == every[k] for k, n in got.items()) and not {1, 2, 3} & {k for k, _ in got}
    if name == "language_id":
        assert 5 not in {k for k, _ in got}


def test_entry_has_all():
    assert {f"op{n}_" for n in range(1, 11)} == {q.split("_")[0] + "_" for q in queries.QUERIES} and "pipeline" in entry.queries()

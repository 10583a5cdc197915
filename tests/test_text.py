import pytest
from pyspark.sql import functions as F

from larkspur.functions import text

STEMS = {
    "cats": "cat", "ponies": "poni", "ties": "ti", "caresses": "caress", "caress": "caress", "feed": "feed", "agreed": "agree", "bled": "bled", "motoring": "motor", "sing": "sing",
    "plastered": "plaster", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "conflated": "conflate",
    "troubled": "trouble", "sized": "size", "is": "is", "a": "a", "running": "run", "happily": "happily", "trying": "try", "crying": "cry",
}


def test_stems(spark):
    df = spark.createDataFrame([(w,) for w in STEMS], "word string")
    assert {r.word: r.stem for r in text.stemmed(df, "word", "stem").collect()} == STEMS


@pytest.mark.parametrize("given,wanted", [("The quick brown FOX jumps over the lazy dog", "quick brown fox jumps lazy dog"), ("", ""), ("the a of", ""), ("x é 1", "é"), (None, "")])
def test_words(spark, given, wanted):
    df = spark.createDataFrame([(given,)], "t string")
    assert df.select(text.words(F.col("t"))).first()[0] == wanted.split()


def test_frequencies_are_relative(spark):
    df = spark.createDataFrame([(1, "hello hello world"), (2, None)], "id int, t string")
    got = {r.term: r.tf for r in text.term_frequencies(df, "id", "t").collect()}
    assert got == pytest.approx({"hello": 2 / 3, "world": 1 / 3})


def test_scalars(spark):
    row = spark.sql("select 1023L a, 1024L b, 565504L c, ' x, ,y' s, 'aé' t").select(*(text.human_bytes(F.col(c)) for c in "abc"), text.session_ids(F.col("s")), text.first_bytes(F.col("t"), 2)).first()
    assert list(row) == ["1023 B", "1.0 KB", "552.2 KB", ["x", "y"], "a"]


def test_stems_in_python_are_those_of_the_column(spark):
    odd = ["yed", "aéed", "yying", "sses", "ies", "beed", "ed", "ing", "eds", "yyed", "22ed", "éed", "abled", "buzzed", "tryed", "syzygyed", "boxed", "rowing", "𝒳𝒳ing", "aeyed", "agreed"]
    words = spark.createDataFrame([(w,) for w in [*odd, *STEMS]], "word string")
    words = words.unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.explode(text.words(F.col("text"))).alias("word")).distinct())
    assert [r for r in text.stemmed(words, "word", "stem").collect() if text.plain_stem(r.word) != r.stem] == []


@pytest.mark.parametrize("step", [1, 5, 1000])
def test_terms_of_a_corpus(spark, monkeypatch, step):
    """Rows of one key, also of a null one, are one document; of distinct keys nothing is shuffled."""
    monkeypatch.setattr(text, "STEP_WORDS", step)
    rows = [(1, "runs running sky", "a"), (2, None, "a"), (3, "cats", "b"), (3, "cat dogs dogs", "c"), (None, "sky", "d"), (None, "sky fly", "d"), (4, "", "a"), (5, "the of", "a"), (6, "b2 a1 a1 c3 b2", None)]
    df = spark.createDataFrame(rows, "id long, t string, place string")
    got = sorted((r.id or 0, r.place or "", r.term, r.n, r.total) for r in text.document_terms(df, "id", "t", ("place",)).collect())
    both = [(3, p, t, n, 4) for p in "bc" for t, n in (("cat", 2), ("dog", 2))]
    unkeyed = 2 * [(0, "d", "fly", 1, 3), (0, "d", "sky", 2, 3)]
    assert got == sorted([(1, "a", "run", 2, 3), (1, "a", "sky", 1, 3), *both, *unkeyed, (6, "", "a1", 2, 5), (6, "", "b2", 2, 5), (6, "", "c3", 1, 5)])
    best = sorted((r.id or 0, r.term, r.n) for r in text.document_terms(df, "id", "t", best=2).collect())
    assert best == [(0, "fly", 1), (0, "sky", 2), (1, "run", 2), (1, "sky", 1), (3, "cat", 2), (3, "dog", 2), (6, "a1", 2), (6, "b2", 2)]
    plan = text.document_terms(df.filter("id <> 3"), "id", "t")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan

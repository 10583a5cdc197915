"""Operators against plain Python, other libraries, or held-out rows; and their odd inputs."""

import base64
import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from larkspur.llm import bpe, chat, common, components, ctw, divergence, forest, kneser_ney, langid, license_scan, mixing, queries, sharded, shingles, vafile
from larkspur.llm.shingles import shingle_set
from larkspur.sources import shared

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None, None, None), (2, "", "en", "s"), (3, " \n\t ", None, "s"), (4, "word " * 30_000, "en", None), (5, "a b", "en", "s"), (5, "a b", "en", "s"), (None, "x y z", "xx", "t")]


@pytest.fixture(scope="module")
def docs(spark):
    return queries.read(spark, SF, "documents").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names operators use themselves."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return df.withColumns({"row": F.lit(1), "size": F.lit("x"), "key": F.lit(2), "words": F.lit(3), "t": F.lit(0), "n_chars": F.length("text").cast("long")})


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_license_places(spark, docs, texts):
    got = {r.doc_id: r for r in queries.op1_license_scan(spark, SF).collect()}
    for k, t in texts.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        places = [(i, x) for p, x in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        r = got[k]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(places), ",".join(sorted({x for _, x in places})))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


@pytest.mark.parametrize("text,want", [
    ("Used UNDER the-MIT license", ("mit", [(1, "mit")])), ("Used by the MIT license", ("", [])), ("CC by NC", ("cc-by-nc", [(0, "cc-by-nc")])),
    ("under the mit license\x00under the MIT License", ("mit", [(0, "mit"), (4, "mit")])), ("x apache license, version 2.0", ("apache-2", [(1, "apache-2")])),
])
def test_licence_phrases_of_the_contract(text, want):
    r = license_scan.scan_text(text, license_scan.automaton())
    assert (r["base_labels"], r["places"]) == want
    assert ("mit" in r["labels"].split(",")) == ("mit" in text.lower())  # the shorter notice stays a label of the method


@pytest.mark.parametrize("text,rpn", [
    ("MIT OR Apache-2.0 AND GPL-2.0-only", "MIT Apache-2.0 GPL-2.0-only and or"), ("(MIT OR Apache-2.0) AND ISC", "MIT Apache-2.0 or ISC and"),
    ("GPL-2.0-only WITH Classpath-exception-2.0 OR MIT */", "GPL-2.0-only Classpath-exception-2.0 with MIT or"), ("MIT OR", "MIT"), ("((", ""), ("(MIT AND (ISC", "MIT ISC and"), ("", ""), ("AND MIT", ""),
])
def test_license_expressions(text, rpn):
    assert license_scan.to_rpn(text) == rpn.split()


def test_license_evaluation():
    assert license_scan.evaluate(license_scan.to_rpn("GPL-3.0-or-later OR MIT")) == (1.0, {"gpl-3", "mit"})
    assert license_scan.evaluate(license_scan.to_rpn("GPL-3.0+ AND MIT")) == (0.4, {"gpl-3", "mit"})
    r = license_scan.scan_text("SPDX-License-Identifier: MPL-2.0", license_scan.automaton())
    assert (r["labels"], r["base_labels"], r["expressions"]) == ("mpl-2", "", ["MPL-2.0"])


def brute_force_licence(text):
    """Labels and score by searching words and by recursive descent."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    labels, grants = set(), []
    for phrase, label in {**license_scan.NOTICES, **license_scan.BASE}.items():
        p = phrase.split()
        if any(words[i : i + len(p)] == p for i in range(len(words))):
            labels.add(label)
            grants.append(license_scan.FREEDOM.get(label, license_scan.UNKNOWN))

    def expression(tokens, level=0):
        """or, and, with by falling looseness; each joins what binds tighter."""
        if level == 3:
            if tokens[0] == "(":
                tokens.pop(0)
                out = expression(tokens)
                tokens.pop(0)
                return out
            name = re.sub(r"(-only|-or-later|\+)$", "", tokens.pop(0).lower())
            label = license_scan.IDENTIFIERS.get(name, name)
            return license_scan.FREEDOM.get(label, license_scan.UNKNOWN), {label}
        a, found = expression(tokens, level + 1)
        while tokens and tokens[0].lower() == ("or", "and", "with")[level]:
            tokens.pop(0)
            b, more = expression(tokens, level + 1)
            a, found = ((max(a, b), found | more), (min(a, b), found | more), (max(a, license_scan.EXCEPTION), found))[level]
        return a, found

    for line in re.findall(r"(?i)spdx-license-identifier\s*:[ \t]*([^\r\n]*)", text):
        tokens = re.findall(r"[()]|[^\s()]+", line)
        if tokens:
            grant, found = expression(tokens)
            labels |= found
            grants.append(grant)
    return ",".join(sorted(labels)), min(grants, default=0.0)


def test_licence_labels_and_score_against_brute_force(texts):
    rng = np.random.default_rng(11)
    names = ["MIT", "Apache-2.0", "GPL-3.0-or-later", "LicenseRef-own", "BSD-3-Clause", "Foo-1.0+", "CC0-1.0"]

    def grown(depth):
        if depth == 0 or rng.random() < 0.3:
            return str(rng.choice(names))
        a, b = grown(depth - 1), grown(depth - 1)
        out = f"{a} {rng.choice(['OR', 'AND', 'or', 'and'])} {b}" if rng.random() < 0.8 else f"{rng.choice(names)} WITH Some-exception"
        return f"({out})" if rng.random() < 0.5 else out

    phrases = [*license_scan.NOTICES, *license_scan.BASE, "plain words", "the mit", "license version"]
    made = [" ".join(str(x) for x in rng.choice(phrases, 3)) + "".join(f"\n# SPDX-License-Identifier: {grown(3)}\n" for _ in range(rng.integers(0, 3))) for _ in range(300)]
    phrases = license_scan.automaton()
    for t in [*made, *texts.values()]:
        r = license_scan.scan_text(t, phrases)
        assert (r["labels"], r["score"]) == brute_force_licence(t), t[:200]


def test_bpe_equals_the_library(spark, texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    c = bpe.coder(bpe.serialise_model(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))), public_tokenizers.PATTERN)
    strange = ["", "a" * 3000, "　\x85\x1c x\x1f\n\n y", "  ​ é 👩‍👩‍👧 ﻿<unk><|endoftext|>", "x\x00y", " 's 'll don't I'M \t\r\n 12 ½ ٣", "▁ "]
    for t in strange:
        assert c.encode([t])[0] == library.encode_ordinary(t) and c.decode(c.encode([t])[0]) == t.encode()
    for r in queries.op2_byte_bpe(spark, SF).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_top_k_with_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(vafile, "BLOCK", 64)  # several blocks, several query blocks, several salts
    monkeypatch.setattr(vafile, "QUERIES", 8)
    monkeypatch.setattr(vafile, "ANSWERS", 3)
    rng = np.random.default_rng(3)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(0, 0.3, (300, 8)))]
    rows += [(i + 300, rows[i][1]) for i in range(40)]  # ties
    rows += [(1000, None), (1020, [float("nan")] * 8), (1040, [1.0, None] * 4), (1060, [0.5] * 3), (1080, [1e30] * 8), (None, [0.1] * 8), (1100, []), (1101, []), (1121, [1.0, 2.0]), (1120, [1e6, 1.0]), (1122, [1e6, 2.0]), (1123, [2e6, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("x"))
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in vafile.search(df, F.col("id") % 20 == 0).collect()}
    fit = {k: [math.floor(64 * x) for x in v] for k, v in rows if k is not None and v is not None and None not in v and all(map(math.isfinite, v))}
    long = lambda x: max(1 - (1 << 63), min((1 << 63) - 1, x))
    want = {}
    for q in fit:
        if q % 20 == 0:
            best = sorted((-long(sum(a * b for a, b in zip(fit[q], v))), k) for k, v in fit.items() if k != q and len(v) == len(fit[q]))[:20]
            want |= {(q, i): (k, -s) for i, (s, k) in enumerate(best, 1)}
    assert got == want
    assert vafile.search(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_repeated_queries_ask_once(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [3.0, 2.0]), (1, [3.0, 2.0]), (2, [1.0, 5.0])], "vec_id long, embedding array<float>")
    got = sorted((r["rank"], r.vec_id, r.score) for r in vafile.search(df, F.col("id") == 0).collect())
    assert got == [(1, 2, 64 * 64 * 5), (2, 1, 64 * 64 * 2), (3, 1, 64 * 64 * 2)]


def test_language_of_held_out_rows(spark, texts):
    rows = queries.op4_language_id(spark, SF).collect()
    truth = {r.doc_id: r.lang for r in queries.read(spark, SF, "documents").collect()}
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {k for k in truth if zlib.crc32(str(k).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.97
    assert np.mean([r.rejected for r in rows]) <= 0.05 and all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_texts(odd, none):
    model = langid.train(["the of and to", "der die und das"] * 10, ["en", "de"] * 10)
    got = [(r.row.doc_id, r.lang_pred, r.rejected) for r in langid.predict(odd, model).collect()]
    assert [x for x in got if x[0] in (1, 2, 3)] == [(i, "und", True) for i in (1, 2, 3)] and len(got) == len(ODD)
    assert langid.fit(none, F.lit(True)) is None and langid.predict(odd, None).filter("lang_pred <> 'und'").count() == 0


def test_only_letters_tell_a_language():
    model = langid.train(["the of and to", "der die und das"] * 10, ["en", "de"] * 10)
    assert np.isnan(model.scores(["²", "½ ① ²", "", "__ 12 ٣", "\u0301"])).all() and not np.isnan(model.scores(["a", "²é½"])).any()
    assert langid.features(["a² b"])[0].tolist() == langid.features(["A, b"])[0].tolist()


def test_pieces_don_t_change_logits(monkeypatch):
    model = langid.train(["the of and to", "der die und das"] * 10, ["en", "de"] * 10)
    texts = ["the and of " * 50, "", "x", "der das 12 und " * 40, "²"]
    want = model.scores(texts)
    monkeypatch.setattr(langid, "PIECE", 7)
    assert np.allclose(model.scores(texts), want, equal_nan=True, atol=1e-5)
    assert np.allclose(want[0], model.scores([texts[0]])[0], atol=1e-5)


def test_sample_is_bounded_and_by_language(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(langid, "train", lambda texts, labels: seen.update(texts=texts, labels=labels))
    monkeypatch.setattr(langid, "SAMPLE", 12)
    monkeypatch.setattr(langid, "EACH", 10)
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 500)
    rows = [(i, f"text number {i}", "en") for i in range(200)] + [(1000, "seltener text", "de"), (1001, "texte rare", "fr"), (1002, "x" * 501, "es")] + [(7, "text number 7", "en")] * 30
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert {"de", "fr", "en"} == set(seen["labels"]) and len(seen["labels"]) == 11 == len(set(seen["texts"])) and sum(map(len, seen["texts"])) <= 500  # the row that is too long has a place, too


def near_rows():
    base = [f"w{i}" for i in range(120)]
    rows = [(1000 + i, " ".join(base)) for i in range(40)]  # copies
    for i in range(60):  # near copies, all different
        words = list(base)
        words[(7 * i) % 120] = f"x{i}"
        rows.append((2000 + i, " ".join(words)))
    rows += [(3000 + i, " ".join(f"y{i}_{j}" for j in range(50)) + " " + " ".join(base[:20])) for i in range(30)]  # a passage
    return rows + [(1, None), (2, ""), (3, "a b"), (4, "A b"), (5, "a c"), (6, "a b c d e"), (6, "a b c d e"), (None, "a b")]


def test_join_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK", 16)  # so that groups are cut
    rows = near_rows()
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in forest.join(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id is not None)
    sets = [(k if k is not None else math.inf, set(shingle_set(t or "").tolist())) for k, t in rows]
    linked = [[b for b in range(len(sets)) if a != b and sets[a][1] and len(sets[a][1] & sets[b][1]) >= 0.8 * len(sets[a][1] | sets[b][1])] for a in range(len(sets))]
    root = list(range(len(sets)))
    for _ in sets:
        root = [min([root[a], *(root[b] for b in linked[a])]) for a in range(len(sets))]
    least = {}
    for a, (k, _) in enumerate(sets):
        least[root[a]] = min(k, least.get(root[a], k))
    assert got == sorted((k, least[root[a]], len(linked[a])) for a, (k, _) in enumerate(sets) if k < math.inf)
    assert forest.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_join_finds_all_links_of_a_large_group(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):  # all different, most pairs just above the threshold
        words = [f"w{k}" for k in range(380)]
        for k in rng.choice(76, 4, replace=False):
            words[5 * k + 2] = f"x{i}_{k}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: (r.class_id, r.n_links) for r in forest.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [shingle_set(t) for _, t in rows]
    i, j = np.triu_indices(len(sets), 1)
    both = forest.intersections(sets, i, j)
    size = np.array([len(x) for x in sets])
    ok = 10 * both >= 8 * (size[i] + size[j] - both)
    links = np.bincount(i[ok], minlength=400) + np.bincount(j[ok], minlength=400)
    assert got == {k: (0, n) for k, n in enumerate(links.tolist())}


def test_texts_of_one_key_are_told_apart(spark):
    base = [f"w{i}" for i in range(60)]
    a, b = " ".join(base), " ".join(f"v{i}" for i in range(60))
    rows = [(1, a), (1, b), (2, a + " more"), (3, b), (None, "only null keys " * 9), (None, "only null keys " * 9), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"component": F.lit("x"), "key": F.lit(0), "hash": F.lit(1), "one": F.lit(2)})
    got = sorted(map(str, ((r.doc_id, r.class_id, r.n_links) for r in forest.join(df).collect())))
    assert got == sorted(map(str, [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (None, None, 1), (None, None, 1), (None, None, 0)]))
    kept = forest.firsts(df)
    assert kept.columns == df.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, [(1, a), (1, b), (None, "only null keys " * 9), (None, None)]))
    repeated = spark.createDataFrame([(0, a), (1, a), (1, b), (1, b)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in forest.firsts(repeated).collect()) == [(0, a), (1, b)]


def test_nodes_meet_over_partitions(spark):
    """The nodes of a trie cut into many parts have the sizes of plain prefix counts."""
    rng = np.random.default_rng(4)
    rows = [(i, bytes(rng.integers(0, 2, 2 * forest.TREES * forest.DEEPEST, np.uint8)), int(rng.integers(1, 4)), int(rng.integers(1, 9))) for i in range(300)]
    classes = spark.createDataFrame([(i, bytearray(x), c, g) for i, x, c, g in rows], "rep long, labels binary, copies long, grams long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        trie = forest.tries(classes).withColumn("short", F.col("rep") < 9)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for depth in (1, 3):
        got = sorted((r.tree, bytes(r.prefix), r.rep, r.size, r.mass, r.bulk, r.short) for r in forest._met(trie, depth).select("tree", "prefix", "rep", F.col("size").alias("size"), "mass", "bulk", "short").collect())
        width, want = 2 * forest.DEEPEST, []
        for t in range(forest.TREES):
            nodes = {}
            for row in rows:
                nodes.setdefault(row[1][width * t :][: 2 * depth], []).append(row)
            for p, some in nodes.items():
                if len(some) > 1 and any(r[0] < 9 for r in some):
                    want += [(t, p, r[0], len(some), sum(x[2] for x in some), 8 * sum(x[3] for x in some), r[0] < 9) for r in some]
        assert got == sorted(want)


def test_join_of_odd_rows(odd, none):
    got = forest.join(odd).collect()
    assert len(got) == len(ODD) and sorted(r.n_links for r in got) == [0, 0, 0, 0, 0, 1, 1]
    assert forest.firsts(odd).columns == odd.columns and forest.firsts(odd).count() == len(ODD) - 1
    assert forest.join(none).count() == 0 and forest.firsts(none).count() == 0


def test_recall_of_links(spark):
    """Links of all documents against all pairs of sets."""
    docs = queries.read(spark, SF, "documents")
    got = {r.doc_id: r.n_links for r in forest.join(docs).collect()}
    sets = [(r.doc_id, shingle_set(r.text or "")) for r in docs.collect()]
    sets = [(k, x) for k, x in sets if len(x)]
    i, j = np.triu_indices(len(sets), 1)
    both = forest.intersections([x for _, x in sets], i, j)
    size = np.array([len(x) for _, x in sets])
    ok = 10 * both >= 8 * (size[i] + size[j] - both)
    links = np.bincount(i[ok], minlength=len(sets)) + np.bincount(j[ok], minlength=len(sets))
    assert {k: got[k] for k, _ in sets} == {k: int(n) for (k, _), n in zip(sets, links)}


def test_long_unrelated_texts_do_not_meet():
    """The labels of unlike texts agree as seldom as 16 bits do by chance, however long the texts are."""
    rng = np.random.default_rng(5)
    labels = np.array([forest.signature(rng.integers(0, 1 << 63, 20_000).astype(np.uint64)) for _ in range(40)])
    i, j = np.triu_indices(40, 1)
    assert (labels[i] == labels[j]).mean() < 2e-4


@pytest.mark.parametrize(("level", "tree", "strip"), [(3, 6, 4_000_000), (2, 1, 5000), (1, 0, 700), (5, 3, 4_000_000)])
def test_candidates_against_all_values(monkeypatch, level, tree, strip):
    """The pairs first met in a tree, as told by comparing all values of all pairs, for much less work than that."""
    rng = np.random.default_rng(6)
    monkeypatch.setattr(forest, "STRIP", strip)
    n, longest, least = 900, max(3, level), 0.45
    base = rng.integers(0, 1 << 16, (forest.TREES, forest.DEEPEST))
    s = np.where(rng.random((n, *base.shape)) < 0.72, base, rng.integers(0, 1 << 16, (n, *base.shape))).astype(">u2")
    block, short = rng.integers(0, 2, n), rng.random(n) < 0.5
    for a, b in ((0, 1), (1, 1)):
        one = {"depth": [level] * n, "tree": [tree] * n, "a": [a] * n, "b": [b] * n, "block": block, "short": short, "labels": [x.tobytes() for x in s]}
        table = pa.table(one)
        began = time.process_time()
        got = {(int(x), int(y)) for i, j in forest._candidates(table, longest, least) for x, y in zip(i, j)}
        took, began = time.process_time() - began, time.process_time()
        want = set()
        for x in np.flatnonzero(block == a):
            same = s[x].astype(np.uint16) == s[block == b].astype(np.uint16)
            first = same[..., :level].all(-1)
            ok = (same.mean((-1, -2)) >= least) & first[:, tree] & ~first[:, :tree].any(-1) & (short[x] | short[block == b])
            if level < longest:
                ok &= ~same[..., : level + 1].all(-1).any(-1)
            want |= {(int(x), int(y)) for y in np.flatnonzero(block == b)[ok] if a != b or x < y}
        assert got == want and want
        assert strip < 4_000_000 or took < 0.5 * (time.process_time() - began)


def test_no_sigma_compares_all_candidates(spark):
    rows = near_rows()[30:110]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(forest.join(df, sigma=None).collect()) == sorted(forest.join(df).collect())


def test_workers_get_bounded_batches(spark, monkeypatch):
    """However many rows: Spark's own bound is 10,000 rows or 64 MB."""
    monkeypatch.setattr(common, "BATCH_BYTES", 50_000)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    most = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches)
    texts = spark.range(0, 400, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("word "), 200), F.col("id").cast("string")).alias("text"))
    with common.small_batches(spark):
        assert max(r.n for r in texts.mapInArrow(most, "n long").collect()) < 100
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
    assert forest.join(texts).count() == 400 and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_a_worker_forgets_other_operators_words():
    """A worker that has encoded keeps no pre-tokens while it compares texts, and the other way round."""
    model = bpe.serialise_model(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    common.remembers("bpe", bpe._CODERS.clear)
    bpe.coder(model, public_tokenizers.PATTERN).learn({"some", " words"})
    signed = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array(["some words here"])], names=["key", "hash", "t"])
    assert len(list(forest._sign(iter([signed])))) == 1 and not bpe._CODERS and shingles._known
    list(forest._needed(3, 0.0)(iter([])))
    assert not shingles._known


def test_prefixes_shorten_until_the_recall():
    depth = forest.shortened(0.8, 0.99)
    assert forest.expected_recall(depth) >= 0.99 > forest.expected_recall(depth + 1)
    assert forest.shortened(0.99, 0.99) == forest.DEEPEST


def test_intersections_by_matrix():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 30).astype(np.uint64)) for _ in range(12)]
    i, j = np.triu_indices(12, 1)
    assert forest.intersections(sets, i, j).tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, 40), (41, 50), (60, 60)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 41: 40, 50: 40} or got == {**{i: 0 for i in range(31)}, 40: 40, 41: 40, 50: 40}


def test_mixed_contexts_come_back():
    x = np.random.default_rng(0).integers(0, 1 << 32, 1000).astype(np.uint64)
    assert (ctw.unmix32(ctw.mix32(x)) == x).all() and len(np.unique(ctw.mix32(x) >> np.uint64(27))) == 32


def test_pieces_of_a_long_text_are_its_grams(monkeypatch):
    texts = [b"abra cadabra abra", b"", b" x" * 40]
    want = [np.concatenate(x) for x in zip(*ctw.gram_ids(texts))]
    monkeypatch.setattr(ctw, "PIECE", 5)
    got = [np.concatenate(x) for x in zip(*ctw.gram_ids(texts))]
    assert (want[0] == got[0]).all() and (want[1] == got[1]).all() and len(want[0]) == 17 + 1 + 1 + 80 + 1


@pytest.mark.parametrize("hot,shards", [(1 << 19, 1), (1, 8)])
def test_context_tree_against_definition(spark, monkeypatch, hot, shards):
    monkeypatch.setattr(ctw, "HOT_GRAMS", hot)
    monkeypatch.setattr(ctw, "HOT_WORDS", 2 if hot == 1 else 1 << 17)
    monkeypatch.setattr(sharded, "LEAST_SHARDS", shards)
    learned, other = ["abra cadabra abra cadabra ab", "the cab"], "abra cab dab"
    rows = [(0, learned[0], True), (1, learned[1], True), (2, other, False)]
    got = {r.k: r.score for r in ctw.score(spark.createDataFrame(rows, "k long, t string, l boolean").repartition(2), F.col("l"), "k", "t").collect()}

    data = [b"\0" * 8 + t.encode() + b"\0" for t in learned]
    every = data + [b"\0" * 8 + other.encode() + b"\0"]
    places = [(d, p) for d in data for p in range(8, len(d))]
    longer_by = lambda c: 8 if len(c) == 4 and c[3:] in b" \t\n" else 0 if len(c) >= 4 else len(c) + 1

    def decisions(context, prefix):
        """(zeros, ones) after a context, of the bytes whose upper bits are the prefix."""
        found = [d[p] for d, p in places if d[p - len(context) : p] == context]
        bits = [x >> (7 - len(prefix)) & 1 for x in found if not prefix or format(x, "08b").startswith(prefix)]
        return bits.count(0), bits.count(1)

    def own(context, prefix):
        a, b = decisions(context, prefix)
        return math.exp(math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1)) / math.pi

    def mixed(context, prefix):
        depth = longer_by(context)
        if not depth:
            return own(context, prefix)
        longer = {d[p - depth : p] for d, p in places if d[p - len(context) : p] == context}
        return 0.5 * own(context, prefix) + 0.5 * math.prod(mixed(x, prefix) for x in longer)

    def likely(context, prefix, bit, path):
        a, b = decisions(context, prefix)
        p = ((a, b)[bit] + 0.5) / (a + b + 1)
        depth = longer_by(context)
        if not depth:
            return p
        w = 0.5 * own(context, prefix) / mixed(context, prefix)
        return w * p + (1 - w) * likely(path[-depth:], prefix, bit, path)

    for k, d in enumerate(every):
        want = 0.0
        for p in range(8, len(d)):
            bits = format(d[p], "08b")
            want += sum(math.log10(likely(b"", bits[:j], int(bits[j]), d[p - 8 : p])) for j in range(8))
        assert got[k] == pytest.approx(want, rel=1e-5)


def test_bytes_after_a_context_sum_to_one(spark):
    """All bytes are among the texts, so their probabilities after one context are in the table."""
    text = "ab cd "
    rows = [(0, text * 3, True)] + [(x + 1, text + chr(x), False) for x in range(1, 128) if not 65 <= x <= 90] + [(0, text, False)]
    df = spark.createDataFrame(rows, "key long, t string, learn boolean")
    table = ctw.fit(sharded.count(df, ctw.gram_ids, 0, every=True), 0).first()
    ids, values = sharded.unpack_sorted(table.ids), sharded.unpack(table["values"], np.float32)
    context = list(ctw.gram_ids([text.encode()]))[0][0][-1] >> np.uint64(8)
    seen = sum(10.0 ** values[ids >> np.uint64(8) == context].astype(float))
    assert 0.9 < seen <= 1 + 1e-6  # bytes above 127 and A-Z are not among the texts


def test_scores(spark, texts):
    got = {r.doc_id: r for r in queries.op7_lm_score(spark, SF).collect()}
    words = {k: [*WORD.findall(low(t)), None] for k, t in texts.items()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in texts}
    c = Counter(w for k in texts if not held[k] for w in words[k])
    n = sum(c.values())
    for k, w in words.items():
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + len(c) + 1)) for x in w), rel=1e-9)
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out) * 1.25


def test_scores_of_odd_texts(odd, none):
    rows = ctw.score(odd, F.lit(True)).collect()
    assert len(rows) == len(ODD) and {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1} and all(math.isfinite(r.score) for r in rows)
    assert ctw.score(none, F.lit(True)).count() == 0
    untrained = ctw.score(odd.filter("doc_id = 5"), F.lit(False)).first()
    assert untrained.train_tokens == 0 and untrained.bits_per_byte == pytest.approx(8)


def test_shards_don_t_change_scores(odd, monkeypatch):
    rounded = lambda: sorted((str(r.doc_id), round(r.score, 3), round(r.base_score, 6), r.n_tokens, r.n_known) for r in ctw.score(odd, F.lit(True)).collect())
    want = rounded()
    monkeypatch.setattr(ctw, "HOT_GRAMS", 1)
    monkeypatch.setattr(ctw, "HOT_WORDS", 1)
    monkeypatch.setattr(sharded, "LEAST_SHARDS", 4)
    monkeypatch.setattr(sharded, "CHUNK", 5)
    assert rounded() == want


def plain_kneser_ney(learned):
    """Probability of a word after another by the textbook, with dictionaries; None: unknown."""
    pairs = Counter(p for t in learned for p in zip(["<", *t], [*t, ">"]))
    contexts, follow = Counter(), Counter(w for _, w in pairs)
    for (v, _), n in pairs.items():
        contexts[v] += n

    def off(counts):
        n = [0, *(sum(c == k for c in counts) for k in (1, 2, 3, 4))]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        d = [0.0, *(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) if n[k] and n[k + 1] else k / 2 for k in (1, 2, 3))]
        return lambda c: d[min(c, 3)]

    d1, d2 = off(follow.values()), off(pairs.values())
    total = sum(follow.values())
    unknown = sum(map(d1, follow.values())) / total / (len(follow) + 1)

    def one(w):
        return unknown + ((follow[w] - d1(follow[w])) / total if w in follow else 0)

    def two(v, w):
        if v not in contexts:
            return one(w)
        weight = sum(d2(n) for (a, _), n in pairs.items() if a == v) / contexts[v]
        n = pairs.get((v, w), 0)
        return max(n - d2(n), 0) / contexts[v] + weight * one(w)

    return two, [*follow]


@pytest.mark.parametrize("hot,shards", [(1 << 17, 1), (1, 8)])
def test_kneser_ney_against_plain_python(spark, monkeypatch, hot, shards):
    monkeypatch.setattr(sharded, "HOT", hot)
    monkeypatch.setattr(sharded, "LEAST_SHARDS", shards)
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, rng.integers(0, 30)) if x < 60) for _ in range(60)]
    rows = [(i, t, i % 3 > 0) for i, t in enumerate(texts)] + [(100, "never SEEN words W1", False), (101, None, False), (101, None, False), (None, "w1 w2", False), (None, "w2 w1", False)]
    df = spark.createDataFrame(rows, "key long, t string, learn boolean").repartition(3).cache()
    model = kneser_ney.fit(df, sharded.shard_bits(df) if shards > 1 else 0)
    got = Counter((r.head.key, r.n_words, round(r.logp, 4)) for r in kneser_ney.scored(df, F.struct("key"), model).collect())
    two, words = plain_kneser_ney([low(t).split() for _, t, x in rows if x])
    for v in ("<", "w1", "w2", "none"):
        assert sum(two(v, w) for w in [*words, None]) == pytest.approx(1)
    logp = lambda t: sum(math.log10(two(v, w)) for v, w in zip(["<", *t], [*t, ">"]))
    assert got == Counter((k, len(low(t).split()) + 1, round(logp(low(t).split()), 4)) for k, t, _ in rows)


def test_quality_classifier(spark, docs):
    rows = queries.op6_kneser_ney(spark, SF).collect()
    labels = {r.doc_id: r.quality for r in queries.read(spark, SF, "labels").collect()}
    assert len(rows) == docs.count()
    assert np.mean([r.kept for r in rows if labels.get(r.doc_id) == 1]) > 0.9
    assert np.mean([r.kept for r in rows if labels.get(r.doc_id) == 0]) < 0.4


def test_senseless_order_scores_worse(spark):
    """Known words in another order are less likely."""
    rng = np.random.default_rng(6)

    def walk(n):
        at = [int(rng.integers(40))]
        for _ in range(n):
            at.append((at[-1] * 7 + int(rng.integers(3))) % 40)
        return [f"w{x}" for x in at]

    rows = [(i, " ".join(walk(80)), i % 2 == 0) for i in range(60)]
    mixed = [(-1 - k, " ".join(rng.permutation(t.split())), False) for k, t, x in rows if not x]
    df = spark.createDataFrame(rows + mixed, "key long, t string, learn boolean")
    got = {r.head.key: r.logp for r in kneser_ney.scored(df, F.struct("key"), kneser_ney.fit(df, 0)).collect()}
    assert all(got[k] > 0.7 * got[-1 - k] for k, _, x in rows if not x)


def test_zero_bytes_and_shuffled_shards(spark):
    rows = [(1, "a\x00b \x00"), (2, "\x00"), (2, "\x00"), (3, "b a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_tokens, round(r.base_score, 6), math.isfinite(r.score)) for r in ctw.score(df, F.lit(True)).collect())
    assert [x[:2] for x in got] == [(1, 3), (2, 2), (2, 2), (3, 3)] and got[1] == got[2] and all(x[3] for x in got)


def test_listed_ids_are_found():
    rng = np.random.default_rng(1)
    ids = np.unique(np.concatenate([rng.integers(0, 1 << 63, 5000).astype(np.uint64), np.arange(300, dtype=np.uint64), np.arange(300, dtype=np.uint64) << np.uint64(56)]))
    table = sharded.Listed(ids, np.arange(len(ids), dtype=float))
    asked = np.concatenate([ids, ids + np.uint64(1), rng.integers(0, 1 << 63, 5000).astype(np.uint64), [np.uint64(2**64 - 1)]])
    hit, slot = table.find(asked)
    assert (hit == np.isin(asked, ids)).all() and (ids[table.values[slot[hit]].astype(int)] == asked[hit]).all()
    assert not sharded.Listed(ids[:0], np.empty(0)).find(asked)[0].any()


def test_packed_arrays():
    rng = np.random.default_rng(0)
    for a in (np.empty(0, np.uint64), np.sort(rng.integers(0, 1 << 63, 1000).astype(np.uint64)), np.array([np.uint64(2**64 - 1)])):
        assert (sharded.unpack_sorted(sharded.pack_sorted(a)) == a).all() and (sharded.unpack(sharded.pack(a), np.uint64) == a).all()


def test_training_is_bounded(spark, monkeypatch):
    """Beyond TRAINED characters an even share of the trusted rows is learned from; copies are drawn one by one."""
    learned = []
    whole = kneser_ney.fit
    monkeypatch.setattr(kneser_ney, "fit", lambda rows, bits: learned.append(rows.filter("learn").agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]) or whole(rows, bits))
    df = spark.createDataFrame([(i % 40, f"some words of number {i % 7}", "en") for i in range(4000)], "doc_id long, text string, lang string")
    good = spark.range(40).toDF("doc_id")
    for bound in (10_000_000, 20_000):
        monkeypatch.setattr(kneser_ney, "TRAINED", bound)
        assert kneser_ney.classify(df, good).filter("kept").count() == 4000
    assert learned[0] > 50_000 and 12_000 < learned[1] < 28_000


def test_all_trusted_texts_are_trained_on(spark, monkeypatch):
    """160 million characters; a fifth is held out."""

    class Seen(Exception):
        pass

    def fit(rows, bits):
        raise Seen(rows.filter("learn").count())

    monkeypatch.setattr(kneser_ney, "fit", fit)
    df = spark.range(4000, numPartitions=8).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 8000).alias("text"), F.lit("en").alias("lang"))
    with pytest.raises(Seen) as seen:
        kneser_ney.classify(df, df.select("doc_id"))
    assert seen.value.args[0] == df.filter(F.pmod(F.xxhash64("doc_id"), F.lit(kneser_ney.FOLDS)) != 0).count()


def test_tables_of_the_fit_are_deleted(spark):
    df = spark.createDataFrame([("a b c", True)], "t string, learn boolean")
    pairs = kneser_ney.saved(df, "pairs")
    kneser_ney.discarded(pairs, kneser_ney.saved(df.limit(0), "none"))
    path = spark._jvm.org.apache.hadoop.fs.Path(spark.conf.get("spark.checkpoint.dir"))
    names = [x.getPath().getName() for x in path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, "*/*"))]
    model = kneser_ney.fit(df, 0)
    after = [x.getPath().getName() for x in path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, "*/*"))]
    assert [x.split("-")[0] for x in after if x not in names] == ["kneser"] and model.table.count() == 1


def test_shuffles_of_a_saved_table_are_deleted(spark):
    """At once, while the plan is still held; the setting is as before."""
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split()
    before, was = {x for x in files() if "shuffle_" in x}, spark.conf.get(shared.CLEANUP)
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    table = common.saved(df, "sevens")
    for _ in range(50):
        if not (left := {x for x in files() if "shuffle_" in x} - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(shared.CLEANUP) == was
    assert table.count() == 7 and df.count() == 7


def test_quality_classifier_of_odd_tables(odd, none):
    trusted = odd.select("doc_id")
    assert kneser_ney.classify(odd, trusted).count() == len(ODD)
    assert kneser_ney.classify(odd, trusted.limit(0)).filter("not kept").count() == 0
    assert kneser_ney.classify(none, trusted).count() == 0


EVENTS = "conv_id int, seq int, kind string, message string, role string, text string"


def test_events_are_folded(spark):
    log = [(1, 1, "message", "m1", "user", "hi"), (1, 2, "delta", "m2", "assistant", "Hel"), (1, 3, "delta", "m2", None, "lo"), (1, 4, "regenerate", "m2", None, None), (1, 5, "delta", "m2", None, "Yo"), (1, 6, "delta", "m2", None, "!"),
           (1, 7, "edit", "m1", None, "hey"), (1, 8, "message", "m3", "user", "bye"), (1, 9, "delete", "m3", None, None), (2, 1, None, "m1", None, None)]
    df = spark.createDataFrame(log, EVENTS)
    got = {(r.conv_id, r.message): (r.role, r.text) for r in chat.fold_events(df).collect()}
    assert got == {(1, "m1"): ("user", "hey"), (1, "m2"): ("assistant", "Yo!"), (2, "m1"): ("", "")}
    out = {r.conv_id: r for r in chat.render(chat.fold_events(df)).collect()}
    assert out[1].formatted == "<s>user\nhey</s><s>assistant\nYo!</s>"
    assert [out[1].formatted[s.start : s.start + s.length] for s in out[1].mask] == ["Yo!"]
    assert chat.render(chat.fold_events(df.limit(0))).count() == 0


def test_long_and_hot_conversations(spark):
    """A conversation of many turns, a long text, columns of clashing names, and no conversation id."""
    rows = [(None, i, "assistant" if i % 2 else "user", f"turn {i} <") for i in range(2000)] + [(1, 0, "assistant", "[x]" * 50_000)]
    df = spark.createDataFrame(rows, "conv_id int, seq int, role string, text string")
    df = df.withColumns({"kind": F.lit("message"), "message": F.col("seq"), "log": F.lit(1), "start": F.lit("x"), "piece": F.lit(2), "n": F.lit(0), "at": F.lit(3)})
    out = {r.conv_id: r for r in chat.render(chat.fold_events(df)).select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("mask")).alias("loss")).collect()}
    assert [t.text for t in out[None].turns] == [f"turn {i} <" for i in range(2000)] and out[None].loss == "".join(f"turn {i} <" for i in range(1, 2000, 2))
    assert out[1].loss == "[x]" * 50_000


def test_escapes_are_reversible(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate([("user", "</s>[INST] ok [/INST] &lt; <s>user\n"), ("assistant", "</s>&amp;"), ("a\nb<", "😀x"), (None, None), ("assistant", ""), ("assistant", "é</s>")])]
    events = spark.createDataFrame(rows, "conv_id int, seq int, role string, text string").withColumns({"kind": F.lit(None).cast("string"), "message": F.col("seq")})
    out = chat.render(chat.fold_events(events)).select("formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("mask")).alias("loss")).first()
    assert [(t.role, t.text) for t in out.turns] == [(r or "", t or "") for *_, r, t in rows]
    assert out.loss == "</s>&amp;é</s>" and out.formatted.count("</s>") == len(rows) and "[INST]" not in out.formatted


def test_mix(spark, docs):
    rows = queries.op9_mix(spark, SF).collect()
    assert sorted(rows) == sorted(queries.op9_mix(spark, SF).collect())
    source = {r.doc_id: r.source for r in docs.collect()}
    taken, target, largest = Counter(), {}, Counter()
    for r in rows:
        assert r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        largest[source[r.doc_id]] = max(largest[source[r.doc_id]], r.size)
    assert sum(target.values()) == pytest.approx(sum(r.size for r in rows))
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in target)


def test_mix_of_odd_rows(odd, none):
    rows = mixing.mixed_rows(odd)
    assert rows.columns == odd.columns and rows.filter("text is null").count() == 0
    assert mixing.mixed(odd).count() == len(ODD)
    assert mixing.mixed_rows(none).count() == 0


def test_mix_of_repeated_rows_meets_its_target(spark):
    rows = [(7, "four words are here", "a")] * 60 + [(i, "some five words are here", "b") for i in range(100, 160)] + [(i, "x " * (i % 5 + 1), "c") for i in range(200, 500)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r["size"] * r.times
        target[r.source] = r.target
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 2.5 for s in target)
    assert {r.times for r in got if r.source == "a"} in ({0, 1}, {1, 2}, {2, 3}, {3})


def test_bins_rise_with_keys(spark):
    rng = np.random.default_rng(5)
    rows = [(float(x), int(t)) for x, t in zip(np.round(rng.exponential(1, 500), 1), rng.integers(-(1 << 63), 1 << 63, 500, np.int64))]
    out = spark.createDataFrame(rows, "at double, tie long").select("at", "tie", mixing.bin_of(F.col("at"), F.col("tie"), [0.1, 0.5, 2.0], 64).alias("bin")).orderBy("at", "tie").collect()
    assert [r.bin for r in out] == sorted(r.bin for r in out) and len({r.bin for r in out}) > 20


def test_targets_fill_up(spark):
    rows = [("a", 10), ("b", 100), ("c", 1000), (None, 50), ("e", 0)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    weights = dict(zip(["a", "b", "c", "e", None], [5, 2, 1, 5, 2]))
    want, open_ = {}, dict(rows)
    while True:
        left = 1160 - sum(want.values())
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > 3 * open_[s]]
        if not full:
            break
        want |= {s: 3.0 * open_.pop(s) for s in full}
    assert got == pytest.approx({**want, **share})


def test_quality_figures(spark, texts):
    rows = queries.op10_quality_rules(spark, SF).collect()
    for r in rows:
        t = texts[r.doc_id]
        words = WORD.findall(t)
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        twice = Counter(windows)
        covered = {j for i, x in enumerate(windows) if twice[x] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words)) and not (r.base_failed and r.kept)
    labels = {r.doc_id: r.quality for r in queries.read(spark, SF, "labels").collect()}
    assert np.mean([r.kept for r in rows if labels.get(r.doc_id) == 1]) > 0.9 and np.mean([r.kept for r in rows if labels.get(r.doc_id) == 0]) < 0.1


def test_js_distance(spark):
    p, q = np.array([6, 3, 1, 0]) / 10, np.array([0.5, 0.2, 0.0, 0.3])
    m = (p + q) / 2
    half = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a)
    want = math.sqrt((half(p) + half(q)) / 2)
    array = lambda *x: F.array(*map(F.lit, x))
    row = spark.range(1).select(divergence.js_distance(array(6, 3, 1, 0), F.lit(10), array(*map(float, q))).alias("a"), divergence.js_distance(array(0, 0), F.lit(0), array(0.5, 0.5)).alias("b")).first()
    assert row.a == pytest.approx(want) and row.b is None


def test_quality_of_odd_rows(odd, none):
    rows = divergence.measured(odd).collect()
    assert len(rows) == len(ODD) and all(r.base_failed for r in rows)
    assert divergence.kept_rows(odd).columns == odd.columns and divergence.kept_rows(none).count() == 0


COMMON = {"en": "the of and to a in is that", "de": "der die und in den von zu das"}


def prose(lang, seed, listed=True):
    rng = np.random.default_rng(seed)
    common, shares = COMMON[lang].split(), np.array([0.055, 0.03, 0.024, 0.018, 0.015, 0.012, 0.01, 0.008])
    rest = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{lang}bla" for i in range(600)]
    words = rng.choice([*common, *rest], 300, p=[*shares, *[(1 - shares.sum()) / 600] * 600]) if listed else rng.choice(rest, 300)
    return " ".join(words) + "."


def test_texts_without_common_words_are_rejected(spark):
    rows = [(100 * k + i, prose(lang, 100 * k + i), lang) for k, lang in enumerate(COMMON) for i in range(60)]
    trusted = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = {r.lang: r for r in divergence.references(trusted).collect() if not r.every}
    assert {lang: " ".join(r.listed[:3]) for lang, r in known.items()} == {"en": "the of and", "de": "der die und"}
    assert all(sum(r.shares) == pytest.approx(1) and sum(r.classes) == pytest.approx(1) for r in known.values())
    new = [(1, prose("en", 7001), "en"), (2, prose("en", 7002, False), "en"), (3, prose("en", 7003), "de"), (4, prose("en", 7004, False), "xx"), (5, prose("de", 7005), "de")]
    got = {r.id: r for r in divergence.measured(spark.createDataFrame(new, "doc_id long, text string, lang string"), trusted).select(F.col("row.doc_id").alias("id"), "class_js", "common_js", "kept").collect()}
    assert {i: r.kept for i, r in got.items()} == {1: True, 2: False, 3: False, 4: True, 5: True}
    assert got[2].common_js == pytest.approx(1) and got[4].common_js is None and all(r.class_js <= 0.2 for r in got.values())


def test_references_follow_the_language(spark):
    """Prose without spaces is judged by its own language's classes."""
    text = "这是一个没有空格的句子它很长" * 12
    rows = [(i, " ".join(text[j : j + 40] for j in range(i % 5, 160, 14)), "zh") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.kept for r in divergence.measured(df, df).select("class_js", "kept", "base_failed").filter("not base_failed").collect()} <= {True}
    few = divergence.references(df.limit(5))
    assert few.count() == 0 and divergence.measured(df, df.limit(5)).count() == 40


def test_odd_rows_of_text_operators(odd, none):
    assert license_scan.scan(odd).count() == len(ODD) and license_scan.scan(none).count() == 0
    args = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    got = bpe.encode(odd, *args).collect()
    assert sorted(bytes(r.decoded) for r in got) == sorted((t or "").encode() for _, t, *_ in ODD)
    assert bpe.encode(none, *args).count() == 0

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm.line_dedup import cut, dedup_lines, without
from quillstone.llm.queries import op9_line_dedup
from quillstone.llm.top_k import Searched, block_top_k, exact_top_k, quantise, segment_statistics


def plain_top_k(queries, vectors, k):
    out = {}
    for q, x in queries.items():
        scores = sorted(((-int(np.dot(x, y)), i) for i, y in vectors.items() if i != q))[:k]
        out[q] = [(i, -s) for s, i in scores]
    return out


@pytest.mark.parametrize("segments", [1, 2, 3, 8])
def test_bounds_hold(segments):
    rng = np.random.default_rng(segments)
    a, b = rng.integers(-50, 50, (30, 21)), rng.integers(-50, 50, (40, 21))
    assert (segment_statistics(a, segments) @ segment_statistics(b, segments).T + 1e-6 >= a @ b.T).all()


@pytest.mark.parametrize("scale", [1, 1 << 30])
def test_blocks(scale):
    rng = np.random.default_rng(7)
    centres = rng.integers(-20, 20, (6, 16))
    x = (centres[rng.integers(0, 6, 300)] + rng.integers(-2, 3, (300, 16))) * scale
    ids = rng.permutation(1000)[:300]
    row, place, score = block_top_k(x[:20], ids[:20], x, ids, 5, (1, 2, 4), step=32)
    got = {}
    for r, p, s in zip(row, place, score):
        got.setdefault(int(ids[r]), []).append((-int(s), int(ids[p])))
    vectors = dict(zip(ids.tolist(), x.astype(object)))
    wanted = plain_top_k({i: vectors[i] for i in ids[:20].tolist()}, vectors, 5)
    assert {q: [(i, -s) for s, i in sorted(v)] for q, v in got.items()} == wanted


def test_bounds_save_products():
    """Vectors of few shapes: the statistics rule out nearly all pairs. Unlike ones in all directions: only the finest level does."""
    rng = np.random.default_rng(11)
    shapes = np.repeat(rng.integers(-60, 60, (50, 8)), 8, axis=1)
    for x, most in ((shapes[rng.integers(0, 50, 3000)] + rng.integers(-4, 5, (3000, 64)), 0.1), (rng.integers(-30, 31, (3000, 64)), 0.9)):
        searched, ids = Searched(), np.arange(3000)
        row, place, score = block_top_k(x[::60], ids[::60], x, ids, 20, (1, 4, 16, 32), searched=searched)
        scores = x[::60] @ x.T
        scores[np.arange(50), ids[::60]] = -(10**9)
        wanted = np.sort(scores, 1)[:, -20:]
        assert all(sorted(score[row == r].tolist()) == wanted[r].tolist() for r in range(50))
        assert searched.pairs == 50 * 2999 and searched.products < most * searched.pairs


def test_finite_vectors_beyond_the_range_are_an_error(spark):
    df = spark.createDataFrame([(20, [1e18, 1.0]), (1, [1.0, 2.0])], "id long, e array<double>").withColumn("vector", quantise(F.col("e")))
    with pytest.raises(Exception, match="too large"):
        exact_top_k(df, df.where("id = 20")).collect()


@pytest.mark.parametrize("block", [8192, 7])
def test_search(spark, block):
    rng = np.random.default_rng(3)
    vectors = {k: rng.integers(-3, 4, 6).tolist() for k in range(60)}  # many ties
    rows = [(k, v, 1) for k, v in vectors.items()] + [(5, vectors[5], 2), (100, None, 1), (101, [1, None, 0, 0, 0, 0], 1), (None, [1] * 6, 1), (102, [1, 2], 1)]
    df = spark.createDataFrame(rows, "id long, vector array<long>, rank int")
    found = exact_top_k(df, df.where("id % 20 = 0"), k=9, query_block=block, candidate_block=block)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    assert got == plain_top_k({k: v for k, v in vectors.items() if k % 20 == 0}, vectors, 9)
    assert exact_top_k(df, df.limit(0)).count() == 0 and exact_top_k(df.limit(0), df).count() == 0


def test_quantise(spark):
    df = spark.createDataFrame([([0.5, -0.01],), ([float("nan")],), ([float("inf")],), ([None],), (None,), ([],)], "v array<float>")
    assert [r[0] for r in df.select(quantise(F.col("v"))).collect()] == [[32, -1], None, None, None, None, []]


def test_cut_and_without():
    text = "One two. Three four!\n\nFive  six\nseven"
    assert [text[a:b] for a, b in cut(text)] == ["One two.", "Three four!", "Five  six", "seven"]
    assert without(text, {1, 3}) == ("One two. Five  six\n", [(0, 9), (22, 32)], [(9, 20), (32, 37)])
    assert without(None, {0}) == ("", [], []) and cut("") == [] and cut("\n") == [] and without("\n", set())[0] == "\n"


def test_lines(spark):
    shared = "this sentence stands in many of the texts"
    rows = [
        (2, f"Start here. {shared}. Own end of two"), (1, f"{shared.upper()}.\nshort one\n{shared}."), (3, "short one"), (4, None), (5, ""), (None, shared + "."),
        (2, "another text that has the same id as two"), (9, "another text that has the same id as two"), (7, "é " * 50_000), (8, "é " * 50_000),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"gone": F.lit(1), "unit": F.lit("x"), "first": F.lit(0)})
    got = {(r["doc_id"], len(r["text"])): r for r in dedup_lines(df).collect()}
    texts = sorted((str(k[0]), r["text"][:40]) for k, r in got.items())
    assert ("2", "Start here. Own end of two") in texts and ("1", f"{shared.upper()}.\nshort one\n"[:40]) in texts and ("3", "short one") in texts and ("None", "") in texts
    assert ("9", "") in texts and ("8", "") in texts and ("4", "") in texts
    two = next(r for k, r in got.items() if k[0] == 2 and "Start" in r["text"])
    assert two["copies_of"] == [1] and [(s["start"], s["end"]) for s in two["removed_spans"]] == [(12, 54)]
    assert dedup_lines(df.limit(0)).count() == 0


def plain_units(text):
    """Units as (start, end), by looking at one character after the other."""
    units, start, k = [], None, 0
    while k <= len(text):
        ends = k == len(text) or text[k] == "\n"
        ends |= k > 0 and not ends and text[k].isspace() and text[k - 1] in ".!?…"
        if ends:
            if start is not None:
                units.append((start, k))
            start = None
            line = k < len(text) and text[k] == "\n"
            while k < len(text) and (text[k] == "\n" if line else text[k].isspace() and text[k] != "\n"):
                k += 1
            if k == len(text):
                break
            if text[k] == "\n":
                continue
        if start is None:
            start = k
        k += 1
    return units


@pytest.mark.parametrize(("least", "common"), [(5, 1000), (1, 3)])
def test_lines_against_brute_force(spark, sf_dir, monkeypatch, least, common):
    monkeypatch.setattr("quillstone.llm.line_dedup.LEAST_COMMON", common)
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = {r["doc_id"]: r["text"] or "" for r in source.collect()}
    seen, wanted = set(), {}
    for doc_id in sorted(docs):
        text, gone = docs[doc_id], []
        for a, b in plain_units(text):
            words = tuple(text[a:b].lower().split())
            if len(words) >= least:
                if words in seen:
                    gone.append((a, b))
                seen.add(words)
        wanted[doc_id] = gone
    assert sum(map(bool, wanted.values())) > 5
    found = op9_line_dedup(spark, sf_dir) if least == 5 else dedup_lines(source, least_words=1)
    for r in found.collect():
        removed = [tuple(x.values()) for x in json.loads(r["removed_spans"])] if least == 5 else [tuple(x) for x in r["removed_spans"]]
        assert removed == wanted.pop(r["doc_id"]) and r["n_removed"] == len(removed)
    assert not wanted

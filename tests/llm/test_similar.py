import random

import corpus_pipeline
import pytest

from quillstone.llm import similar
from quillstone.llm.similar import similar_documents

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def _set(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1 if words else 0))}


def components_by_pairs(texts):
    """By brute force over all pairs."""
    sets, label = {i: _set(x) for i, x in texts.items()}, {}
    for i in sorted(sets):
        near = {label[j] for j in label if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
        label[i] = min([i, *near])
        label |= {j: label[i] for j in label if label[j] in near}
    return label


def _corpus():
    """Random texts with edited copies on both sides of 0.8, copies of copies, and a large group round one passage."""
    draw, texts = random.Random(7), []
    for k in range(40):
        base = [f"w{draw.randrange(5000)}" for _ in range(200)]
        texts.append(base)
        for edits in (1, 3, 4, 5, 6, 9):
            near = list(texts[-1] if k % 3 == 0 else base)
            for at in draw.sample(range(200), edits):
                near[at] = f"W{draw.randrange(5000)}"
            texts.append(near)
    passage = [f"p{k}" for k in range(150)]
    texts += [passage + [f"q{draw.randrange(9000)}" for _ in range(draw.randrange(10, 60))] for _ in range(40)]
    draw.shuffle(texts)
    return {k: " ".join(x) for k, x in enumerate(texts)}


def test_near_dedup_stage_is_jaccard_of_five_words(spark):
    texts = _corpus()
    docs = spark.createDataFrame([(k, x, "en", "s", len(x)) for k, x in texts.items()], KIND)
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "").collect()}
    wanted = components_by_pairs(texts)
    assert 40 < len(set(wanted.values())) < len(texts) and kept == set(wanted.values())
    assert {r["doc_id"]: r["component_id"] for r in similar_documents(docs).collect()} == wanted


@pytest.mark.parametrize("first, part", [(8, 2048), (4, 6)])
def test_large_clumps_lose_no_link(first, part, spark, monkeypatch):
    """Clumps of many parts, chains of copies that the head does not reach among them."""
    monkeypatch.setattr(similar, "FIRST_TEXTS", first)
    monkeypatch.setattr(similar, "PART_TEXTS", part)
    draw, texts = random.Random(3), list(_corpus().values())
    chain = [f"c{k}" for k in range(200)]
    for _ in range(60):
        chain = list(chain)
        for at in draw.sample(range(200), 4):
            chain[at] = f"d{draw.randrange(9000)}"
        texts.append(" ".join(chain))
    draw.shuffle(texts)
    wanted = components_by_pairs(dict(enumerate(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert {r["doc_id"]: r["component_id"] for r in similar_documents(docs).collect()} == wanted


def test_similar_documents_edges(spark):
    rows = [(3, None), (2, ""), (5, "one two"), (4, "One  TWO"), (None, "one two"), (6, "one two three"), (6, "one two three"), (7, "a b c d e")]
    found = similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in found.collect())
    assert got == [(0, 4), (2, 2), (3, 2), (4, 4), (5, 4), (6, 6), (6, 6), (7, 7)]
    assert similar_documents(found.limit(0).selectExpr("doc_id", "'' AS text")).count() == 0

import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillstone.llm.language import _grams, _points, _slices, learn_languages, predict_language
from quillstone.llm.queries import op3_toxicity, op4_language_id
from quillstone.llm.toxicity import ToxicityModel, fold, learn_toxicity, phrases_with, toxicity_scores


@pytest.mark.parametrize(("text", "folded"), [("STUPID", "stupid"), ("1d10t", "idiot"), ("ｍｏｒｏｎ", "moron"), ("ѕсum", "scum"), ("l0s3r", "loser"), ("tr@sh", "trash"), ("mo​ron", "moron"), ("wow!", "wow!"), ("$5", "$s"), (None, "")])
def test_fold(text, folded):
    assert fold(text) == folded


def test_scores(spark):
    model = ToxicityModel({"trash": 4.0, "idiot": 4.0}, ("trash can",))
    texts = ["you 1DIOT", "the trash can", "trash can and trash", "idiotic", "", None, "idiot " + "word " * 5000, "trashy idiots", "idiot, idiot"]
    df = spark.createDataFrame([(k, t, 0.5) for k, t in enumerate(texts)], "doc_id long, text string, toxicity double")
    rows = {r["doc_id"]: r for r in toxicity_scores(df, model).collect()}
    assert [rows[k]["toxic_hits"] for k in range(9)] == [1, 0, 1, 0, 0, 0, 1, 0, 2]
    assert rows[1]["toxicity"] == rows[3]["toxicity"] == rows[4]["toxicity"] == rows[5]["toxicity"] < rows[6]["toxicity"] < rows[0]["toxicity"] < rows[8]["toxicity"] < 1
    assert toxicity_scores(df.limit(0), model).count() == 0


def test_learning_without_labels(spark):
    docs, labels = spark.createDataFrame([(1, "a"), (None, "b")], "doc_id long, text string"), spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = learn_toxicity(docs, labels)
    assert model.weights == {} and model.exceptions == ()
    assert [r["toxicity"] < 0.5 for r in toxicity_scores(docs, model).collect()] == [True, True]


def test_learned_terms_and_exceptions(spark):
    """A word of toxic texts enters, and a phrase that is harmless in spite of it; labels decide, no word is given."""
    rng, rows = random.Random(5), []
    for k in range(400):
        words = rng.choices([f"w{j}" for j in range(60)], k=12)
        words[rng.randrange(12)] = {0: "glarb", 1: "reef glarb"}.get(k % 4, "w0")
        rows.append((k, " ".join(words), int(k % 4 == 0)))
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = learn_toxicity(docs, labels)
    assert set(model.weights) == {"glarb"} and "reef glarb" in model.exceptions
    odd = spark.createDataFrame([("gl4rb",), ("the reef glarb",), ("glarb " + "x " * 100,), ("x " * 300_000,)], "text string").withColumns({"toxic_match": F.lit(1), "Toxicity": F.lit(1)})
    found = toxicity_scores(odd, model)
    assert found.columns == ["text", "toxic_match", "toxicity", "toxic_hits"]
    assert [r["toxicity"] >= 0.5 for r in found.collect()] == [True, False, True, False]
    assert phrases_with("a glarb, glarb b  glarb c", {"glarb"}) == {"a glarb", "glarb b", "glarb c"}


def test_scores_against_a_plain_matcher(spark, sf_dir):
    """Every document of the table, by a search for each term and phrase in turn."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = learn_toxicity(docs, labels.where(~held))
    model = ToxicityModel({**model.weights, "e": 0.5, "de": 1.5}, (*model.exceptions, "de la", "e de"), model.slope, model.offset)

    def spans(text, term):
        at = text.find(term)
        while at >= 0:
            if not (at and text[at - 1].isalnum()) and not text[at + len(term) : at + len(term) + 1].isalnum():
                yield at, at + len(term)
            at = text.find(term, at + 1)

    got = {r["doc_id"]: r for r in toxicity_scores(docs, model).collect()}
    for r in docs.collect():
        text = fold(r["text"])
        safe = [s for e in model.exceptions for s in spans(text, e)]
        hits = [w for t, w in model.weights.items() for a, b in spans(text, t) if not any(c <= a and b <= d for c, d in safe)]
        raw = sum(hits) / (1 + math.log1p((text.count(" ") + text.count("\n") + 1) / 200))
        assert got[r["doc_id"]]["toxic_hits"] == len(hits)
        assert got[r["doc_id"]]["toxicity"] == pytest.approx(1 / (1 + math.exp(-(model.slope * raw + model.offset))))


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = op3_toxicity(spark, folder).join(labels, "doc_id").where("held_out").toPandas()
    assert (found["predicted"] == found["toxic"]).mean() > 0.94 and found["score"].between(0, 1).all()
    assert found[found["toxic"] == 0]["predicted"].mean() < 0.02


def test_language_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = op4_language_id(spark, folder).join(docs, "doc_id").where("held_out").toPandas()
    assert (found["lang_pred"] == found["lang"]).mean() > 0.97 and found["score"].between(0, 1).all()


def test_language_edges(spark):
    rows = [("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("x", None), (None, "en"), ("", "fr")]
    model = learn_languages(spark.createDataFrame(rows, "text string, lang string"))
    df = spark.createDataFrame([("THE DOG",), (None,), ("",), ("12 !? 3",), ("le chien " * 100_000,), ("中文",), ("𝒶𝒷",)], "text string").withColumn("lang_pred", F.lit(1))
    got = [(r["lang_pred"], r["lang_score"]) for r in predict_language(df, model).collect()]
    assert [g[0] for g in got[:5]] == ["en", "und", "und", "und", "fr"] and got[1][1] == 0 and all(0 <= s <= 1 for _, s in got)
    assert got[5][0] in ("en", "fr") and predict_language(df.limit(0), model).count() == 0
    none = learn_languages(spark.createDataFrame([], "text string, lang string"))
    assert predict_language(df, none).first()["lang_pred"] == "und"


def _bucket(gram):
    key = len(gram)
    for c in gram:
        key = (key * 0x100000001B3 % 2**64) ^ ord(c)
    return (key * 0x9E3779B97F4A7C15 % 2**64) >> 49


def _plain_grams(text):
    low = "".join(c if c.isalpha() else " " for c in f" {(text or '').lower()} ")
    one = [c for c in low if c != " "]
    two = [low[k : k + 2] for k in range(len(low) - 1) if low[k : k + 2] != "  "]
    three = [low[k : k + 3] for k in range(len(low) - 2) if low[k + 1] != " "]
    return Counter(map(_bucket, one + two + three)), bool(one)


def test_language_query_against_naive_bayes(spark, sf_dir):
    """A plain multinomial naive Bayes over the same rows gives the same languages and posteriors on the whole table."""
    docs = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    counts, shares = {}, Counter()
    for d in docs:
        if d["lang"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 4 != 2:
            shares[d["lang"]] += 1
            counts.setdefault(d["lang"], Counter()).update(_plain_grams(d["text"])[0])
    totals = {k: sum(c.values()) + 0.5 * 2**15 for k, c in counts.items()}
    got = {r["doc_id"]: r for r in op4_language_id(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d in docs:
        grams, letters = _plain_grams(d["text"])
        logs = {k: math.log(shares[k] / shares.total()) + sum(n * math.log((counts[k][g] + 0.5) / totals[k]) for g, n in grams.items()) for k in counts}
        best = max(sorted(logs), key=logs.get)
        row = got[d["doc_id"]]
        assert row["lang_pred"] == (best if letters else "und")
        assert row["score"] == pytest.approx(1 / sum(math.exp(x - logs[best]) for x in logs.values()) if letters else 0.0, abs=0.02)


@pytest.mark.parametrize("most", [3, 7, 1 << 21])
def test_no_gram_is_lost_between_slices(monkeypatch, most):
    texts = ["an odd text, in words", None, "x", "", "to be or not to be", "né à Ävik"]
    found = Counter()
    for some in _slices([_points(t) for t in texts], (1, 2, 3), most):
        for owner, bucket in _grams(*some, (1, 2, 3), 15):
            found.update(zip(owner.tolist(), bucket.tolist()))
    assert found == Counter({(k, b): n for k, t in enumerate(texts) for b, n in _plain_grams(t)[0].items()})


def test_languages_clash_ties_and_repeats(spark):
    rows = [("aa bb", "x"), ("aa bb", "y")]  # alike: a tie, which goes to the first name
    model = learn_languages(spark.createDataFrame(rows, "text string, lang string"))
    df = spark.createDataFrame([("aa", 1, 2, 3), ("aa", 1, 2, 3)], "text string, lang_found int, Lang_Score int, score int")
    found = predict_language(df, model)
    assert found.columns == ["text", "lang_found", "score", "lang_pred", "lang_score"]
    assert [tuple(r) for r in found.collect()] == [("aa", 1, 3, "x", 0.5)] * 2
    with pytest.raises(ValueError, match="languages"):
        learn_languages(spark.createDataFrame(rows, "text string, lang string"), max_langs=1)


def test_language_of_symbols_beyond_the_first_plane(spark):
    """Emoji, musical signs and digits there are no letters; letters there are, beside them too."""
    rows = [("the cat and the dog", "en"), ("le chat et le chien", "fr")]
    model = learn_languages(spark.createDataFrame(rows, "text string, lang string"))
    texts = ["\U0001f600 \U0001f600", "\U0001d7ce\U0001d7cf", "\U0001d11e", "\U0010ffff", "\U0001d4b6\U0001d4b7", "\U0001f600the\U0001f600dog\U0001f600", "the dog"]
    got = predict_language(spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, text string"), model)
    found = {r["k"]: (r["lang_pred"], r["lang_score"]) for r in got.collect()}
    assert all(found[k] == ("und", 0.0) for k in range(4)) and found[4][0] in ("en", "fr") and found[5][0] == "en"

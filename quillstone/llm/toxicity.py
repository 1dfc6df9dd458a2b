"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, maps look-alike letters and digits to plain letters, so that disguised spellings meet the
lexicon. Matches count at word bounds only and not inside an exception phrase. The sum of their weights, normalised
by the length of the text in words, goes through a logistic curve. Weights, exception phrases and curve come from labelled
rows alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Container, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import few, fresh_name, save

# Characters that look like Latin letters, and the letters they stand for.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t",
    "у": "y", "х": "x", "ѕ": "s", "і": "i", "ї": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b",
    "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ℓ": "l",
}
# Digits and signs that stand for letters; signs do so only between two letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l"}

#: Full-width forms, by rule.
_WIDE = {0xFEE0 + k: chr(k) for k in range(0x21, 0x7F)}
_FOLD = str.maketrans({**HOMOGLYPHS, **DIGITS}) | {k: DIGITS.get(v.lower(), v.lower()) for k, v in _WIDE.items()}
_ODD = re.compile("[0-9ıɑɡͰ-ԯ℀-↏＀-￯​-‍­]")
_HIDDEN = re.compile("[​-‍­]")
_SIGN = re.compile(r"(?<=[^\W_])[@$!|](?=[^\W\d_])")
_SIGNS = re.compile(r"[@$!|]")
_WORD = re.compile(r"[^\W_]+")
#: Standard normal quantile of the 95 % intervals.
_Z = 1.96


def fold(text: str | None) -> str:
    """Lower case, look-alikes and digits as letters, zero-width characters and soft hyphens left out."""
    text = (text or "").lower()
    if _ODD.search(text):
        text = _HIDDEN.sub("", text).translate(_FOLD)
    if _SIGNS.search(text):
        text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    return text


@dataclass(frozen=True)
class ToxicityModel:
    """Lexicon weights by folded term, exception phrases, and the logistic curve over the normalised sum."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    slope: float = 1.5
    offset: float = -4.0

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(term, (len(term), weight))
        for phrase in map(fold, self.exceptions):
            found.add_word(phrase, (len(phrase), 0.0))
        found.make_automaton()
        return found


def _matches(text: str, found: ahocorasick.Automaton) -> list[float]:
    """Weights of the matches of a folded text outside exceptions."""
    hits, harmless = [], []
    for last, (size, weight) in found.iter(text):
        first = last + 1 - size
        if (first and text[first - 1].isalnum()) or text[last + 1 : last + 2].isalnum():
            continue
        (hits if weight else harmless).append((first, last, weight))
    if harmless:
        hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b, _ in harmless)]
    return [h[2] for h in hits]


def normalised(weight: float, words: int) -> float:
    """A sum of weights set against the length: 200 words halve nothing, ever longer texts need ever more."""
    return weight / (1 + math.log1p(words / 200))


def _raw(texts: pd.Series, found: ahocorasick.Automaton, floors: tuple[float, ...] = (0.0,)) -> pd.DataFrame:
    """Normalised sums over the matches that weigh each of `floors` or more, and the number of matches."""
    rows = []
    for text in texts:
        folded = fold(text)
        weights = _matches(folded, found) if len(found) else []
        words = folded.count(" ") + folded.count("\n") + 1
        rows.append(([normalised(sum(w for w in weights if w >= f), words) for f in floors], len(weights)))
    return pd.DataFrame({"raw": [r[0] for r in rows], "hits": [r[1] for r in rows]})


def toxicity_scores(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """`docs` with `toxicity` (0 to 1) and `toxic_hits` (matches); columns of these names are replaced.

    Null and empty texts have no match and get the score of such texts. Whole texts are read, rows are independent:
    repeated rows get equal scores and an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the lexicon's size

    @F.pandas_udf("raw array<double>, hits long")
    def match(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        found = shared.value.automaton()
        for texts in batches:
            yield _raw(texts, found)

    name = fresh_name(docs, "toxic_match")
    curve = 1 / (1 + F.exp(-(F.lit(model.slope) * F.col(f"{name}.raw")[0] + F.lit(model.offset))))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("toxicity", "toxic_hits")]
    scored = docs.select(*kept, match(F.col(text_col)).alias(name))
    return scored.withColumns({"toxicity": curve, "toxic_hits": F.col(f"{name}.hits")}).drop(name)


def _curve(sums: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton's method, lightly regularised."""
    x, w = np.stack([sums, np.ones_like(sums)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (counts * (labels - p)) - 1e-2 * w
        hess = (x * (counts * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def _interval(share: Column, n: Column, side: int) -> Column:
    """Lower (side -1) or upper (1) end of the 95 % interval of a share among n (Wilson's)."""
    spread = _Z * F.sqrt(share * (1 - share) / n + F.lit(_Z * _Z / 4) / (n * n))
    return (share + F.lit(_Z * _Z / 2) / n + side * spread) / (1 + F.lit(_Z * _Z) / n)


def _weigh(count: DataFrame, bad: int, good: int, least_docs: int, false_terms: float) -> dict[str, float]:
    """Terms and weights from counts of toxic and other texts (term, b, g)."""
    count = count.where(F.col("b") + F.col("g") >= least_docs)
    n, rate = F.col("b") + F.col("g"), (bad + 1) / (bad + good + 2)
    share = F.col("b") / n
    low = _interval(share, n, -1)
    weight = F.ln(low / (1 - low)) - F.lit(math.log(rate / (1 - rate)))
    surprise = n * (share * F.ln(share / rate) + F.when(share < 1, (1 - share) * F.ln((1 - share) / (1 - rate))).otherwise(0.0))
    heavy = count.where("b > 0").select("term", weight.alias("weight"), surprise.alias("surprise"))
    enough = math.log(max(count.count(), 1) / false_terms)
    heavy = heavy.where((F.col("weight") >= FLOORS[0]) & (F.col("surprise") >= enough))
    return {r["term"]: r["weight"] for r in heavy.orderBy(F.desc("weight"), "term").collect()}


def phrases_with(folded: str, terms: Container[str]) -> set[str]:
    """Pairs of neighbouring words, a blank between them, of which one is a term at least."""
    found, before = set(), None
    for word in _WORD.finditer(folded):
        if before and word.start() - before.end() == 1 and folded[before.end()] == " " and (before[0] in terms or word[0] in terms):
            found.add(folded[before.start() : word.end()])
        before = word
    return found


def _exceptions(rows: DataFrame, weights: dict[str, float]) -> tuple[str, ...]:
    """Phrases of the labelled `rows` that hold a term and whose texts are mostly not toxic: the 95 % interval of their
    share of toxic texts ends below one half."""
    terms = rows.sparkSession.sparkContext.broadcast(frozenset(weights))

    @F.pandas_udf("array<string>")
    def phrases(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: list(phrases_with(fold(text), terms.value)))

    count = rows.select("label", F.explode(phrases("text")).alias("phrase")).groupBy("phrase")
    count = count.agg(F.avg("label").alias("share"), F.count(F.lit(1)).alias("n"))
    harmless = count.where(_interval(F.col("share"), F.col("n"), 1) < 0.5)
    return tuple(r["phrase"] for r in harmless.select("phrase").orderBy("phrase").collect())


#: Least weights of terms that are tried on the rows put aside.
FLOORS = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5)


def learn_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = 60_000,
    least_docs: int = 3,
    false_terms: float = 1.0,
) -> ToxicityModel:
    """A model from the `docs` that `labels` give a label of 0 or 1 (others are ignored).

    Of the labels a hash chooses about `max_rows` at most, before they meet the texts; so few ids are broadcast, and
    only the chosen texts are kept for the passes that follow. A term is a word of a folded text, in `least_docs`
    texts at least. Its weight is the log odds of a text that holds it being toxic, at the lower end of their 95 %
    interval (Wilson's), over those of any text. Terms enter whose share of toxic texts is so unlikely to be chance
    that `false_terms` of all terms are expected to enter by it (by Chernoff's bound); `max_rows` bounds how many there
    can be. Exceptions are pairs of words with a term whose texts are mostly not toxic. A quarter of the rows is put aside:
    on them, and with terms and exceptions from the others, the least weight and the logistic curve are fitted. Then all
    rows give terms and exceptions. Without usable labels the lexicon is empty and no text is toxic. Whole texts are read,
    however long; null ids meet none; repeated labels count as often as they are there.
    """
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1))
    total = chosen.count()
    if total > max_rows:
        share = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
        chosen = chosen.where(share < max_rows / total)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.pmod(F.xxhash64(text_col), F.lit(4)) == 0).alias("aside"))
    rows = save(texts.join(few(chosen), "id").select("text", "label", "aside"), "labelled")

    @F.pandas_udf("array<string>")
    def terms(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: list(set(_WORD.findall(fold(text)))))

    size = {(r["label"], r["aside"]): r["count"] for r in rows.groupBy("label", "aside").count().collect()}
    bad, good = size.get((1, False), 0), size.get((0, False), 0)
    if not (bad and good and size.get((1, True)) and size.get((0, True))):
        return ToxicityModel({})
    with_term = rows.select("label", "aside", F.explode(terms("text")).alias("term")).groupBy("term")
    sums = {"b": F.sum("label"), "g": F.sum(1 - F.col("label"))}
    aside = F.col("aside")
    sums |= {"fit_b": F.sum(F.when(~aside, F.col("label")).otherwise(0)), "fit_g": F.sum(F.when(~aside, 1 - F.col("label")).otherwise(0))}
    count = save(with_term.agg(*(c.alias(n) for n, c in sums.items())).where(F.col("b") + F.col("g") >= least_docs), "terms")
    fitted = _weigh(count.select("term", F.col("fit_b").alias("b"), F.col("fit_g").alias("g")), bad, good, least_docs, false_terms)
    found = rows.sparkSession.sparkContext.broadcast(ToxicityModel(fitted, _exceptions(rows.where(~aside), fitted)))

    @F.pandas_udf("array<double>")
    def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = found.value.automaton()
        for texts in batches:
            yield _raw(texts, automaton, FLOORS)["raw"]

    tried = rows.where("aside").select("label", F.posexplode(raw("text")).alias("floor", "raw"))
    steps = tried.withColumn("raw", F.round("raw", 2)).groupBy("floor", "raw", "label").count().toPandas()
    best = (math.inf, FLOORS[0], 1.0, 0.0)
    for k in range(len(FLOORS) - 1, -1, -1):
        x, y, n = (steps[steps["floor"] == k][c].to_numpy(float) for c in ("raw", "label", "count"))
        slope, offset = _curve(x, y, n)
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        loss = -float((n * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())
        best = min(best, (loss, FLOORS[k], slope, offset), key=lambda b: b[0])
    _, floor, slope, offset = best
    bad, good = bad + size[(1, True)], good + size[(0, True)]
    weights = {t: w for t, w in _weigh(count, bad, good, least_docs, false_terms).items() if w >= floor}
    return ToxicityModel(weights, _exceptions(rows, weights), slope, offset)

"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import fresh_name

#: Gathered numbers (characters by languages) of one step, so that very long texts and many languages need bounded memory.
_STEP = 1 << 21
#: Texts that are scored together.
_TOGETHER = 256
_LETTER = np.array([chr(k).isalpha() for k in range(0x110000)])


def _points(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text between two blanks, all that are no letters as blanks."""
    points = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le", "surrogatepass"), "<u4").copy()
    points[~_LETTER[points]] = 32
    return points


def _slices(texts: list[np.ndarray], orders: tuple[int, ...], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Points of texts in slices of about `most`: points, the text of each, and whether an n-gram may begin there.

    A text that goes on in the next slice is continued by as many points as the longest n-gram needs, in which none begins.
    """
    more, parts, size = max(orders) - 1, [], 0
    for k, points in enumerate(texts):
        for at in range(0, len(points), most):
            part = points[at : at + most + more]
            parts.append((k, part, min(most, len(part))))
            size += len(part)
            if size >= most:
                yield _joined(parts)
                parts, size = [], 0
    if parts:
        yield _joined(parts)


def _joined(parts: list[tuple[int, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = [len(p) for _, p, _ in parts]
    owner = np.repeat(np.array([k for k, _, _ in parts]), lengths)
    begins = np.concatenate([np.arange(len(p)) < n for _, p, n in parts])
    return np.concatenate([p for _, p, _ in parts]), owner, begins


def _grams(points: np.ndarray, owner: np.ndarray, begins: np.ndarray, orders: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the texts and buckets of all n-grams inside one text: a sparse matrix by row and column.

    Grams whose second point is a blank are left out, and of two points or less those that begin and end in one.
    """
    wide = points.astype(np.uint64)
    for n in orders:
        last = len(points) - n + 1
        if last <= 0:
            continue
        key = np.full(last, n, np.uint64)
        for k in range(n):
            key = key * np.uint64(0x100000001B3) ^ wide[k : last + k]
        key = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
        good = begins[:last] & (owner[:last] == owner[n - 1 :])
        good &= ~((points[:last] == 32) & (points[n - 1 :] == 32)) if n <= 2 else points[1 : last + 1] != 32
        yield owner[:last][good], key[good].astype(np.int64)


@dataclass(frozen=True)
class LanguageModel:
    """`log_prob`: bucket by language; `prior`: log share of each language."""

    langs: tuple[str, ...]
    log_prob: np.ndarray
    prior: np.ndarray
    orders: tuple[int, ...]
    bits: int

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Languages and posteriors of a batch: the sparse matrix of its n-grams times the log-probabilities."""
        points = [_points(t) for t in texts]
        known = np.array([bool(self.langs) and bool((p != 32).any()) for p in points])
        total = np.tile(self.prior, (len(texts), 1))
        for some in _slices(points, self.orders, max(1 << 10, _STEP // max(1, len(self.langs)))) if known.any() else ():
            for owner, bucket in _grams(*some, self.orders, self.bits):
                if len(owner):
                    starts = np.flatnonzero(np.diff(owner, prepend=-1))
                    total[owner[starts]] += np.add.reduceat(self.log_prob[bucket], starts, axis=0, dtype=np.float64)
        if not known.any():
            return ["und"] * len(texts), [0.0] * len(texts)
        best = total.argmax(1)
        score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        langs = [self.langs[k] if ok else "und" for k, ok in zip(best.tolist(), known.tolist())]
        return langs, np.where(known, score, 0.0).tolist()


def predict_language(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """`docs` with `lang_pred` and `lang_score` (the posterior, 0 to 1); columns of these names are replaced.

    Texts that are null or have no letter are ``und`` with score 0. Ties go to the first language in order of its
    name. Repeated rows get equal results; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits rows by the number of languages

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        parts = [shared.value.score(texts.iloc[k : k + _TOGETHER].tolist()) for k in range(0, len(texts), _TOGETHER)]
        return pd.DataFrame({"lang": [x for p in parts for x in p[0]], "score": [x for p in parts for x in p[1]]})

    name = fresh_name(docs, "lang_found")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "lang_score")]
    found = docs.select(*kept, predict(F.col(text_col)).alias(name))
    return found.withColumns({"lang_pred": F.col(f"{name}.lang"), "lang_score": F.col(f"{name}.score")}).drop(name)


def learn_languages(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    orders: tuple[int, ...] = (1, 2, 3),
    bits: int = 15,
    max_rows: int = 20_000,
    smoothing: float = 0.5,
    max_langs: int = 512,
) -> LanguageModel:
    """A model from rows with a language (null ones are ignored), about `max_rows` at most, chosen by a hash.

    Tasks count n-grams by language and bucket; what reaches the driver is the matrix of 2**bits counts a language. More
    than `max_langs` languages among those rows are an error, as the matrix would no longer be small. Null and empty texts
    count for the share of their language only; repeated rows count as often as they are there.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang IS NOT NULL")
    total = rows.count()
    if total > max_rows:
        share = F.pmod(F.xxhash64("text", "lang"), F.lit(1_000_003)) / F.lit(1_000_003.0)
        rows = rows.where(share < max_rows / total)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for k in range(0, len(langs), _TOGETHER):
                own = langs[k : k + _TOGETHER]
                for lang in own:
                    docs[lang] = docs.get(lang, 0) + 1
                    sums.setdefault(lang, np.zeros(1 << bits, np.int64))
                points = [_points(t) for t in batch.column(0).slice(k, _TOGETHER).to_pylist()]
                for some in _slices(points, orders, _STEP):
                    for owner, bucket in _grams(*some, orders, bits):
                        ends = np.searchsorted(owner, np.arange(len(own) + 1))
                        for j in np.unique(owner).tolist():
                            np.add.at(sums[own[j]], bucket[ends[j] : ends[j + 1]], 1)
        for lang, into in sums.items():
            seen = np.flatnonzero(into)
            bucket, value = np.append(seen, -1), np.append(into[seen], docs[lang])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(bucket)), pa.array(bucket), pa.array(value)], ["lang", "bucket", "n"]
            )

    met = len(rows.select("lang").distinct().limit(max_langs + 1).collect())
    if met > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    parts = rows.mapInArrow(count, "lang string, bucket long, n long")
    sums = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = tuple(sorted(sums["lang"].unique()))
    counts = np.zeros((1 << bits, len(langs)))
    shares = np.zeros(len(langs))
    for k, lang in enumerate(langs):
        own = sums[sums["lang"] == lang]
        grams = own[own["bucket"] >= 0]
        counts[grams["bucket"], k] = grams["n"]
        shares[k] = own["n"][own["bucket"] < 0].sum()
    log_prob = np.log(counts + smoothing) - np.log((counts + smoothing).sum(0)) if langs else counts
    prior = np.log(shares / shares.sum()) if langs else shares
    return LanguageModel(langs, log_prob.astype(np.float32), prior, orders, bits)

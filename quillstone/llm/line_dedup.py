"""Substring deduplication by hashing lines and sentences.

A text is cut at line breaks and after sentence ends. Units are normalised and hashed, digests are grouped over the
whole corpus, and of each digest the occurrence in the document of the least rank stays. The others are removed, and
the spans that stay are given by their offsets in the original text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import BROADCAST_ROWS, save

#: Places of a digest from which it is common. Common digests are broadcast, so that their places stay where they are; there
#: are `BROADCAST_ROWS` of them at most, as each then has one in so many of all places that share a digest.
LEAST_COMMON = 1000
_END = re.compile(r"\n+|(?<=[.!?…])[^\S\n]+")


def cut(text: str | None) -> list[tuple[int, int]]:
    """Spans of the units of a text, in characters; what parts them belongs to none."""
    spans, at = [], 0
    for gap in _END.finditer(text or ""):
        if gap.start() > at:
            spans.append((at, gap.start()))
        at = gap.end()
    if at < len(text or ""):
        spans.append((at, len(text)))
    return spans


def unit_digests(text: str | None, least_words: int) -> tuple[list[tuple[int, bytes]], list[tuple[int, bytes]]]:
    """Units of `least_words` or more as (number, MD5 of the lower-cased words): first ones, and repeats in the text."""
    first, again, seen = [], [], set()
    for k, (a, b) in enumerate(cut(text)):
        words = text[a:b].lower().split()
        if len(words) >= least_words:
            digest = hashlib.md5(" ".join(words).encode("utf-8", "surrogatepass")).digest()
            (again if digest in seen else first).append((k, digest))
            seen.add(digest)
    return first, again


def without(text: str | None, gone: set[int]) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]]]:
    """The text without some units and what follows them up to the next; spans that stay, and that go."""
    text = text or ""
    units = cut(text)
    starts = [a for a, _ in units] + [len(text)]
    stay, go, at = [], [], 0
    for k in sorted(gone):
        if k < len(units):
            a, b = starts[k], starts[k + 1]
            if a > at:
                stay.append((at, a))
            go.append((a, units[k][1]))
            at = b
    if at < len(text):
        stay.append((at, len(text)))
    return "".join(text[a:b] for a, b in stay), stay, go


_SPANS = "array<struct<start:int,end:int>>"


def _as_spans(rows: list[list[tuple[int, int]]]) -> pa.ListArray:
    flat = np.array([s for r in rows for s in r], np.int32).reshape(-1, 2)
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 5) -> DataFrame:
    """One row per row of `docs`: id, text (cleaned), kept_spans, removed_spans, copies_of (ids), n_removed.

    Spans are character offsets in the original text. A unit of fewer than `least_words` words always stays (with 1 every
    repeated unit goes, one-word lines of clean texts too), and so does the first occurrence in a document unless a document with a smaller id has the unit; `copies_of` are the ids
    of the documents where removed units stay. Null texts count as empty; null ids come last; rows that repeat an id
    don't remove each other's units. Other columns are not looked at.
    """

    @F.arrow_udf("struct<again:array<int>,units:array<struct<unit:int,hi:bigint,lo:bigint>>>")
    def units(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            again, ks, digests, sizes = [], [], [], [0]
            for text in texts:
                first, rest = unit_digests(text.as_py(), least_words)
                again.append([k for k, _ in rest])
                ks += [k for k, _ in first]
                digests += [d for _, d in first]
                sizes.append(len(ks))
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            inner = pa.StructArray.from_arrays(
                [pa.array(ks, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["unit", "hi", "lo"]
            )
            found = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), inner)
            yield pa.StructArray.from_arrays([pa.array(again, pa.list_(pa.int32())), found], ["again", "units"])

    @F.arrow_udf(f"struct<text:string,kept:{_SPANS},removed:{_SPANS}>")
    def clean(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, gone in batches:
            rows = [without(t.as_py(), set(g.as_py() or ())) for t, g in zip(texts, gone)]
            columns = [pa.array([r[0] for r in rows], pa.string()), _as_spans([r[1] for r in rows]), _as_spans([r[2] for r in rows])]
            yield pa.StructArray.from_arrays(columns, ["text", "kept", "removed"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    cuts = save(rows.select("id", "version", units("text").alias("u")).select("id", "version", "u.*"), "units")
    places = cuts.select("id", "version", F.inline("units"))
    groups = places.groupBy("hi", "lo").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = save(groups.where("n > 1"), "groups")
    shares = groups.agg(F.sum("n")).first()[0] or 0
    common = groups.where(F.col("n") >= max(LEAST_COMMON, shares / BROADCAST_ROWS)).drop("n")
    rare = groups.where(F.col("n") < max(LEAST_COMMON, shares / BROADCAST_ROWS)).drop("n")
    marked = places.join(F.broadcast(common), ["hi", "lo"], "left_anti").join(rare, ["hi", "lo"])
    copies = places.join(F.broadcast(common), ["hi", "lo"]).unionByName(marked).where(~F.col("id").eqNullSafe(F.col("first")))
    repeats = cuts.select("id", "version", F.explode("again").alias("unit"), F.lit(None).cast("bigint").alias("first"))
    gone = copies.select("id", "version", "unit", "first").union(repeats).groupBy("id", "version")
    gone = gone.agg(F.collect_set("unit").alias("gone"), F.array_sort(F.collect_set("first")).alias("copies_of"))
    gone = gone.select(F.col("id").alias("gone_id"), F.col("version").alias("gone_version"), "gone", "copies_of")
    same = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("version") == F.col("gone_version"))
    done = rows.join(gone, same, "left").withColumn("c", clean("text", "gone"))
    return done.select(
        F.col("id").alias(id_col),
        F.col("c.text").alias("text"),
        F.col("c.kept").alias("kept_spans"),
        F.col("c.removed").alias("removed_spans"),
        F.coalesce("copies_of", F.array().cast("array<bigint>")).alias("copies_of"),
        F.size("c.removed").alias("n_removed"),
    )

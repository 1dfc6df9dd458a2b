"""Near-duplicates at a Jaccard similarity of word shingles: SimHash tries find the candidates, whole sets decide.

A text is the set of its word shingles, and its fingerprint 256 bits of SimHash over that set. The trie walk of
`near_dedup` runs from 32 places of the fingerprint, with a budget that grows with the depth, and joins candidates into
clumps. Inside a clump pairs whose fingerprints are near are compared as whole sets, unless links join them already: first
in small parts, to each of which the clump's head is added, so that a large group of copies becomes one component without
all its pairs; then texts that are not linked to the head with all others of their clump.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import few, save
from quillstone.llm.components import connected_components
from quillstone.llm.near_dedup import Tries, bit_counts, hamming_links, shingle_hashes, whole_groups

#: 64-bit words of a fingerprint.
WORDS = 4
_TIMES, _PLUS = (np.random.default_rng(42).integers(0, 1 << 63, (2, WORDS), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def _allowed(steps: tuple[tuple[int, int], ...]) -> tuple[int, ...]:
    """Bits that may differ by depth, from steps (up to this depth, so many)."""
    return tuple(next(most for depth, most in steps if d <= depth) for d in range(65))


#: At a similarity of 0.8 some 15 % of the bits differ: 39 of 256, and over 62 in one pair of twenty thousand. By simulation of
#: independent bits one trie or another leads to 98.5 % of pairs at exactly 0.8, 99.8 % at 0.85 and all at 0.9.
TRIES = Tries(tuple(range(0, 256, 8)), _allowed(((8, 0), (15, 1), (22, 2), (27, 4), (32, 6), (40, 9), (48, 12), (64, 17))), 62)
#: Texts that a part of a clump has about: one that is compared with itself and the head, and one of a pair of parts.
FIRST_TEXTS, PART_TEXTS = 128, 2048
#: Characters of text that a part has about.
PART_CHARACTERS = 1 << 25


def shingle_set(text: str | None, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, A-Z lower-cased; of all its words if it has fewer."""
    found = list(shingle_hashes(text, shingle, seed))
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)


def set_fingerprint(shingles: np.ndarray) -> list[int]:
    """SimHash of a set as (signed) words; where just half of the hashes have a bit, it is that of the least shingle."""
    if not len(shingles):
        return [0] * WORDS
    hashes = shingles[:, None] * _TIMES + _PLUS
    hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(32)
    first = np.unpackbits(hashes[0].view(np.uint8), bitorder="little").reshape(WORDS, 64)
    return np.packbits(bit_counts(hashes) * 2 + first > len(shingles), bitorder="little").view("<i8").tolist()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets; two empty ones are alike."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) or len(b) else 1.0


def set_links(sets: list[np.ndarray], words: np.ndarray, mid: int, least: float, budget: int) -> tuple[list[int], list[int]]:
    """What links at `least` or more connect, as stars (i, centre), between the first `mid` sets and the others, or between all
    if mid is their number.

    Only pairs within `budget` bits are compared, and not those that links found so far connect. The centre of a star is its
    first set.
    """
    up = list(range(len(sets)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    size = np.array([len(x) for x in sets])
    for i in range(mid):
        start = i + 1 if mid == len(sets) else mid
        near = np.bitwise_count(words[start:] ^ words[i]).sum(1) <= budget
        near &= np.minimum(size[start:], size[i]) >= least * np.maximum(size[start:], size[i]) - 1e-9
        for j in (np.flatnonzero(near) + start).tolist():
            a, b = root(i), root(j)
            if a != b and jaccard(sets[i], sets[j]) >= least:
                up[max(a, b)] = min(a, b)
    leaves = [k for k in range(len(sets)) if root(k) != k]
    return leaves, [root(k) for k in leaves]


def _compare(least: float, shingle: int, budget: int):
    """mapInArrow function: texts of pairs of parts of clumps (clump, lo, hi, side, key, words, text) to links (src, dst)."""

    def links(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        by = ("clump", "lo", "hi")
        order = np.lexsort((rows["key"], rows["side"], *(rows[k] for k in reversed(by))))
        key, side, text = (rows[k][order] for k in ("key", "side", "text"))
        words = np.stack([rows[f"w{k}"][order].view(np.uint64) for k in range(WORDS)], 1)
        moved = np.logical_or.reduce([np.diff(rows[k][order], prepend=rows[k][order][:1] - 1) != 0 for k in by])
        starts = np.flatnonzero(moved)
        own = (rows["lo"] == rows["hi"])[order]
        src, dst = [], []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]):
            sets = [shingle_set(x, shingle) for x in text[a:b]]
            mid = b - a if own[a] else int((side[a:b] == 0).sum())
            if 0 < mid and b - a > 1:
                i, j = set_links(sets, words[a:b], mid, least, budget)
                src += [a + x for x in i]
                dst += [a + x for x in j]
        pairs = [pa.array(key[np.array(x, np.int64)]) for x in (src, dst)]
        return pa.RecordBatch.from_arrays(pairs, ["src", "dst"])

    return whole_groups(links, ("clump", "lo", "hi"))


def _parts(texts: int) -> Column:
    """Parts of some `texts` texts that the texts of a group make."""
    return F.ceil(F.greatest(F.count(F.lit(1)) / texts, F.sum(F.length("text")) / PART_CHARACTERS)).cast("int")


def _verified(clumps: DataFrame, texts: DataFrame, least: float, shingle: int) -> DataFrame:
    """Links between the texts of each clump (key, clump); `texts` has key, words and text.

    The head of a clump is its least key. Of texts linked to it no pair need be compared any more.
    """
    names = ["clump", "lo", "hi", "side", "key", *(f"w{k}" for k in range(WORDS)), "text"]
    one = F.lit(1)

    def compared(dealt: DataFrame) -> DataFrame:
        dealt = dealt.select(*names).repartition("clump", "lo", "hi").sortWithinPartitions("clump", "lo", "hi")
        return dealt.mapInArrow(_compare(least, shingle, TRIES.budget), "src long, dst long")

    members = save(texts.join(few(clumps), "key"), "members")
    heads = members.groupBy("clump").agg(F.min("key").alias("head"), _parts(FIRST_TEXTS).alias("parts"))
    large = save(heads.where("parts > 1"), "large")
    dealt = members.join(few(large), "clump", "left").withColumn("parts", F.coalesce("parts", one))
    is_head = F.coalesce(F.col("key") == F.col("head"), F.lit(False))
    part = F.pmod(F.xxhash64("key", F.lit(7)), F.col("parts")).cast("int")
    dealt = dealt.withColumn("lo", F.explode(F.when(is_head, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(part))))
    first = save(compared(dealt.withColumns({"hi": F.col("lo"), "side": F.when(is_head, -1).otherwise(0)})), "first")
    if large.isEmpty():
        return first
    home = first.join(few(large.select(F.col("head").alias("dst"))), "dst", "left_semi").select(F.col("src").alias("key"))
    inside = members.join(few(large.select("clump", "head")), "clump").join(home.withColumn("home", F.lit(True)), "key", "left")
    inside = save(inside.withColumn("home", F.coalesce("home", F.col("key") == F.col("head"))), "inside")
    away = inside.where(~F.col("home")).groupBy("clump").agg(_parts(PART_TEXTS).alias("away"))
    sizes = save(away.join(inside.where("home").groupBy("clump").agg(_parts(PART_TEXTS).alias("near")), "clump"), "sizes")
    # Parts of texts away from the head come first and meet all parts; those of the others meet only them.
    dealt, salt = inside.join(few(sizes), "clump"), F.xxhash64("key", F.lit(11))
    part = F.when(F.col("home"), F.col("away") + F.pmod(salt, F.col("near"))).otherwise(F.pmod(salt, F.col("away"))).cast("int")
    beside = F.when(F.col("home"), F.col("away")).otherwise(F.col("away") + F.col("near"))
    dealt = dealt.withColumns({"part": part, "other": F.explode(F.sequence(F.lit(0), beside - 1))})
    meet = {"lo": F.least("part", "other"), "hi": F.greatest("part", "other"), "side": (F.col("part") > F.col("other")).cast("int")}
    return first.union(compared(dealt.withColumns(meet)))


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, shingle: int = 5
) -> DataFrame:
    """One row per row of `docs`: the id and `component_id`, the smallest id reachable over links.

    Two texts are linked if their sets of word shingles have a Jaccard similarity of `least` or more, which is computed
    for the pairs of a clump that are within the budget of `TRIES` and not in one component yet. That budget is made
    for 0.8: a lower `least` would lose links. Null and empty texts are alike; texts with fewer words than a shingle
    are one shingle. Repeated rows stay, with equal results; a null id is never the smallest unless there is no other.
    An empty table gives an empty result; other columns are not looked at.
    """
    names = [f"w{k}" for k in range(WORDS)]

    @F.pandas_udf(", ".join(f"{n} long" for n in names))
    def prints_of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([set_fingerprint(shingle_set(x, shingle)) for x in texts], columns=names, dtype=np.int64)

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    prints = save(rows.select("id", "key", prints_of("text").alias("w")).select("id", "key", "w.*"), "fingerprints")
    distinct = save(prints.groupBy("key").agg(F.min("id").alias("first"), *(F.first(n).alias(n) for n in names)), "distinct")
    clumps = connected_components(hamming_links(distinct.select("key", *names), TRIES, tuple(names)))
    labels = None
    if clumps is not None:
        clumps = save(clumps.select(F.col("node").alias("key"), F.col("label").alias("clump")), "clumps")
        texts = rows.select("key", "text").join(few(clumps.select("key")), "key", "left_semi").dropDuplicates(["key"])
        found = _verified(clumps, texts.join(distinct.select("key", *names), "key"), least, shingle)
        labels = connected_components(found)
    if labels is None:
        owner = distinct.select("key", F.col("first").alias("component_id"))
    else:
        named = distinct.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
        owner = named.join(named.groupBy("label").agg(F.min("first").alias("component_id")), "label").select("key", "component_id")
    return prints.join(owner, "key").select(F.col("id").alias(id_col), "component_id")

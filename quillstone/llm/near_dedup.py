"""SimHash near-duplicates by a binary trie self-join.

Distinct fingerprints are the leaves of binary tries. Pairs of nodes of a trie are walked down together, one bit at a
time, adding up the bits in which their paths differ, and a pair is pruned as soon as the sum exceeds the budget for its
depth. Two fingerprints within a budget differ in at most half of it in one of their halves; so there are two tries, each
with another half first and half of the budget in it. Spark deals out pairs of shallow nodes, with the bits in which they
differ already; the walk goes on from there to single leaves inside a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import few, save
from quillstone.llm.components import connected_components

#: Hashes per step of the bit count, so that a very long text needs bounded memory.
_STEP = 1 << 18
#: The lowest bit of each byte, and the shifts that bring the others there.
_LOWEST, _SHIFTS = np.uint64(0x0101010101010101), np.arange(8, dtype=np.uint64)[:, None, None]


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of a text, A-Z lower-cased, repeats included, some at a time; of all words if there are fewer."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return
    data = b" ".join(words)
    size = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(starts), _STEP):
        yield np.array([digest(data[a:b], seed) for a, b in zip(starts[k : k + _STEP], ends[k : k + _STEP])], dtype="<u8")


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many rows of `hashes` (words of 64 bits) have each bit, by word and with the lowest bit first.

    Bits of one place in all bytes of a word are summed at once, for up to 255 rows, which a byte holds.
    """
    width = hashes.shape[1]
    counts = np.zeros((width, 8, 8), np.int64)
    for k in range(0, len(hashes), 16 * 255):
        bits = (hashes[k : k + 16 * 255] >> _SHIFTS) & _LOWEST
        sums = np.add.reduceat(bits, np.arange(0, bits.shape[1], 255), axis=1)
        counts += sums.view(np.uint8).reshape(8, -1, width, 8).sum(1, dtype=np.int64).transpose(1, 2, 0)
    return counts.reshape(width, 64)


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a text, A-Z lower-cased; 0 if it has no word or is null."""
    ones, count = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, shingle, seed):
        ones += bit_counts(hashes[:, None])[0]
        count += len(hashes)
    return int(np.packbits(ones * 2 > count, bitorder="little").view("<u8")[0])


def simhash(text: Column, shingle: int = 4, seed: int = 42) -> Column:
    """`fingerprint` of a text column as a (signed) long."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x, shingle, seed) for x in texts], np.uint64).view(np.int64))

    return prints(text)


@dataclass(frozen=True)
class Tries:
    """Tries over fingerprints of one or more 64-bit words, taken as a ring of bits.

    The path of a trie is the 64 bits from one of `offsets` on. `allowed[d]` bits may differ in the first d of a path,
    and `budget` bits in the whole fingerprints.
    """

    offsets: tuple[int, ...]
    allowed: tuple[int, ...]
    budget: int

    @staticmethod
    def halves(budget: int) -> Tries:
        """Two tries over one word, which together meet every pair within `budget` bits."""
        return Tries((0, 32), (budget // 2,) * 33 + (budget,) * 32, budget)

    def path(self, words: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Paths of rows of `words` (uint64), each in the trie of its kind."""
        at = np.array(self.offsets)[kinds]
        rows, n, by = np.arange(len(words)), words.shape[1], (at % 64).astype(np.uint64)
        first, second = words[rows, at // 64], words[rows, (at // 64 + 1) % n]
        return np.where(by == 0, first, (first << by) | (second >> ((np.uint64(64) - by) & np.uint64(63))))

    def prefix(self, words: list[Column], bits: int) -> list[Column]:
        """For each trie, the first `bits` of the path, as a long."""
        found = []
        for offset in self.offsets:
            first, second, by = words[offset // 64], words[(offset // 64 + 1) % len(words)], offset % 64
            path = F.shiftleft(first, by).bitwiseOR(F.shiftrightunsigned(second, 64 - by)) if by else first
            found.append(F.shiftrightunsigned(path, 64 - bits) if bits else F.lit(0).cast("long"))
        return found


@dataclass
class Walked:
    """What a walk has done: node pairs met and pruned by the budget; of those met, left out as one component; leaf pairs compared."""

    met: int = 0
    pruned: int = 0
    joined: int = 0
    compared: int = 0


class _Forest:
    """Labels of leaves. Links between different labels join them; only those of a spanning forest are kept."""

    def __init__(self, n: int):
        self.labels = np.arange(n, dtype=np.int32)
        self.runs = self.labels  # equal for leaves in a row that have one label

    def add(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Join the leaves i with the leaves j; the links that did so."""
        kept = []
        while True:
            a, b = self.labels[i], self.labels[j]
            new = a != b
            if not new.any():
                break
            i, j, a, b = i[new], j[new], a[new], b[new]
            high, first = np.unique(np.maximum(a, b), return_index=True)
            kept.append((i[first], j[first]))
            up = np.arange(len(self.labels), dtype=np.int32)
            up[high] = np.minimum(a, b)[first]
            while (up[up] != up).any():
                up = up[up]
            self.labels = up[self.labels]
        if kept:
            self.runs = np.cumsum(np.diff(self.labels, prepend=self.labels[:1]) != 0, dtype=np.int32)
        return tuple(np.concatenate(x) for x in zip(*kept)) if kept else (i[:0], j[:0])

    def one(self, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
        """Whether all leaves of both nodes have the same label."""
        uniform = (self.runs[a0] == self.runs[a1 - 1]) & (self.runs[b0] == self.runs[b1 - 1])
        return uniform & (self.labels[a0] == self.labels[b0])


def trie_links(
    path: np.ndarray, words: np.ndarray, groups: np.ndarray, skip: int, tries: Tries, chunk: int = 1 << 16, walked: Walked | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (i, j) between rows of `words` within the budget, thinned to a spanning forest.

    `path` holds the paths, sorted inside each node. A row of `groups` is a pair of nodes at depth `skip`, (a0, a1, b0, b1,
    bits in which they differ); a node with itself has a0 == b0. Node pairs of one component are not walked.
    """
    walked = walked if walked is not None else Walked()
    allowed, forest = tries.allowed, _Forest(len(path))
    todo = [(skip, [np.ascontiguousarray(x) for x in np.asarray(groups, np.int32).reshape(-1, 5).T])]
    zeros: dict[int, np.ndarray] = {}
    found: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0
    while todo:
        depth, nodes = todo.pop()
        if len(nodes[0]) > chunk:
            todo += [(depth, [x[k : k + chunk] for x in nodes]) for k in range(0, len(nodes[0]), chunk)]
            continue
        done = forest.one(*nodes[:4])
        walked.met += len(done)
        walked.joined += int(done.sum())
        a0, a1, b0, b1, diff = (x[~done] for x in nodes)
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            i, j = a0[leaf], b0[leaf]
            walked.compared += len(i)
            near = (i != j) & (np.bitwise_count(words[i] ^ words[j]).sum(1) <= tries.budget)
            found.append((i[near], j[near]))
            count += int(near.sum())
            if count >= max(1024, len(path) >> 4):
                yield forest.add(*(np.concatenate(x) for x in zip(*found)))
                found, count = [], 0
            a0, a1, b0, b1, diff = (x[~leaf] for x in (a0, a1, b0, b1, diff))
        if not len(a0):
            continue
        if depth < 64:
            if depth not in zeros:
                bit = (path >> np.uint64(63 - depth)) & np.uint64(1)
                zeros[depth] = np.concatenate(([0], np.cumsum(bit == 0))).astype(np.int32)
            z = zeros[depth]
            am, bm, step = a0 + z[a1] - z[a0], b0 + z[b1] - z[b0], 1
        else:  # the paths are used up: nodes of equal ones are halved
            am, bm, step = (a0 + a1 + 1) // 2, (b0 + b1 + 1) // 2, 0
        other = a0 != b0
        children = [(a0, am, bm, b1, diff + step, None), (am, a1, b0, bm, diff + step, other)]
        children += [(a0, am, b0, bm, diff, None), (am, a1, bm, b1, diff, None)]  # like ends last: they are walked first
        parts = []
        for *ends, d, only in children:
            keep = (ends[0] < ends[1]) & (ends[2] < ends[3])
            keep &= True if only is None else only
            over = keep & (d > allowed[min(depth + 1, 64)])
            walked.pruned += int(over.sum())
            keep &= ~over
            parts.append([x[keep] for x in (*ends, d)])
        todo.append((depth + 1, [np.concatenate(x) for x in zip(*parts)]))
    if count:
        yield forest.add(*(np.concatenate(x) for x in zip(*found)))


def _walk(tries: Tries, skip: int):
    """mapInArrow function: rows (lo, hi, side, key, words...) with the pairs of cells (lo, hi) together, to links (src, dst)."""

    def links(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        names = sorted(k for k in rows if k.startswith("w"))
        words = np.stack([rows[k].view(np.uint64) for k in names], 1)
        path = tries.path(words, rows["lo"] >> 44)
        order = np.lexsort((path, rows["side"], rows["hi"], rows["lo"]))
        lo, hi, side, key = (rows[k][order] for k in ("lo", "hi", "side", "key"))
        path, words = path[order], words[order]
        starts = np.flatnonzero((np.diff(lo, prepend=lo[:1] - 1) != 0) | (np.diff(hi, prepend=hi[:1] - 1) != 0))
        ends = np.append(starts[1:], len(lo))
        own = lo[starts] == hi[starts]
        sides = np.concatenate(([0], np.cumsum(side)))
        mids = np.where(own, ends, ends - (sides[ends] - sides[starts]))
        cell = (1 << 44) - 1
        apart = np.bitwise_count(((lo[starts] & cell) ^ (hi[starts] & cell)) >> 20).astype(np.int64)
        groups = np.stack([starts, mids, np.where(own, starts, mids), ends, apart], 1)
        groups = groups[(groups[:, 0] < groups[:, 1]) & (groups[:, 2] < groups[:, 3])]
        forest = _Forest(len(path))
        for i, j in trie_links(path, words, groups, skip, tries):
            forest.add(i, j)
        leaf = np.flatnonzero(forest.labels != np.arange(len(path)))  # stars shrink in fewer rounds than chains do
        return pa.RecordBatch.from_arrays([pa.array(key[leaf]), pa.array(key[forest.labels[leaf]])], ["src", "dst"])

    return whole_groups(links, ("lo", "hi"))


def whole_groups(of, by: tuple[str, ...]):
    """A mapInArrow function that calls `of` with rows (arrays by column) of whole groups, which stand together in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[dict[str, np.ndarray]] = []
        for batch in batches:
            rows = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in batch.schema.names}
            before = {k: kept[-1][k][-1:] if kept else rows[k][:1] for k in by}
            moved = np.zeros(batch.num_rows, bool)
            for k in by:
                moved |= np.diff(rows[k], prepend=before[k]) != 0
            last = int(np.flatnonzero(moved)[-1]) if moved.any() else -1
            if last >= 0:  # all before the last group that has begun is whole
                kept.append({k: v[:last] for k, v in rows.items()})
                whole = {k: np.concatenate([x[k] for x in kept]) for k in rows}
                if len(whole[by[0]]):
                    yield of(whole)
                kept = []
            if batch.num_rows:
                kept.append({k: v[max(last, 0) :] for k, v in rows.items()})
        if kept:
            yield of({k: np.concatenate([x[k] for x in kept]) for k in kept[0]})

    return run


def hamming_links(prints: DataFrame, tries: Tries, words: tuple[str, ...] = ("fp",), node: int = 1 << 15, hot: int = 1 << 15) -> DataFrame:
    """Distinct fingerprints `prints` (key long, words long) to links (src, dst) of keys that the tries lead to.

    What a task links leaves it as stars, a link a leaf: the components are those of all links. The count of fingerprints
    gives the depth from which tasks walk, so that a node there has about `node` leaves, and each leaf goes to every node
    pair that the budget allows at that depth. A node with more than `hot` leaves is split into parts by a salt, and
    each pair of parts is walked by itself. Nulls are no fingerprints and must be left out.
    """
    count = prints.count()
    skip = min(max(3, int(np.ceil(np.log2(max(count, 1) / node)))), 24)
    masks = [sum(1 << b for b in bits) for e in range(tries.allowed[skip] + 1) for bits in combinations(range(skip), e)]
    prefixes = tries.prefix([F.col(w) for w in words], skip)
    kinds = F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("kind"), p.alias("prefix")) for k, p in enumerate(prefixes))))
    leaves = prints.select(F.col("key"), *(F.col(w).alias(f"w{k}") for k, w in enumerate(words)), kinds.alias("x"))
    leaves = leaves.select("*", "x.*").drop("x")
    crowded = save(leaves.groupBy("kind", "prefix").count().where(F.col("count") > hot), "crowded")
    met = leaves.withColumn("mask", F.explode(F.array(*(F.lit(m).cast("long") for m in masks))))
    met = met.withColumn("neighbour", F.col("prefix").bitwiseXOR(F.col("mask"))).drop("mask")
    if crowded.isEmpty():
        met = met.withColumns({"part": F.lit(0).cast("long"), "other": F.lit(0).cast("long")})
    else:
        parts = crowded.select("kind", "prefix", F.ceil(F.col("count") / hot).alias("parts"))
        theirs = parts.select("kind", F.col("prefix").alias("neighbour"), F.col("parts").alias("beside"))
        one = F.lit(1).cast("long")
        met = met.join(few(parts), ["kind", "prefix"], "left").join(few(theirs), ["kind", "neighbour"], "left")
        met = met.withColumn("part", F.pmod(F.xxhash64("key"), F.coalesce("parts", one)))
        met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("beside", one) - 1)))
    cell = F.shiftleft("prefix", 20).bitwiseOR(F.col("part"))
    opposite = F.shiftleft("neighbour", 20).bitwiseOR(F.col("other"))
    met = met.withColumns({"cell": cell, "opposite": opposite})
    kind = F.shiftleft("kind", 44)
    dealt = met.select(
        kind.bitwiseOR(F.least("cell", "opposite")).alias("lo"),
        kind.bitwiseOR(F.greatest("cell", "opposite")).alias("hi"),
        (F.col("cell") > F.col("opposite")).cast("int").alias("side"),
        "key",
        *(f"w{k}" for k in range(len(words))),
    )
    dealt = dealt.repartition("lo", "hi").sortWithinPartitions("lo", "hi")
    return dealt.mapInArrow(_walk(tries, skip), "src long, dst long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 4, shingle: int = 4, seed: int = 42
) -> DataFrame:
    """One row per row of `docs`: the id, `fingerprint` (16 hex digits) and `component_id`.

    `component_id` is the smallest id reachable over links of at most `budget` differing bits. Null and empty texts
    have fingerprint zero and link like any other; texts with fewer words than a shingle are one shingle. Repeated
    rows stay, with equal results; a null id is never the smallest unless there is no other. An empty table gives
    an empty result, and other columns are not looked at.
    """
    prints = save(docs.select(F.col(id_col).alias("id"), simhash(F.col(text_col), shingle, seed).alias("fp")), "fingerprints")
    distinct = save(prints.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    labels = connected_components(hamming_links(distinct.select("fp", F.col("fp").alias("key")), Tries.halves(budget)))
    if labels is None:
        owner = distinct.select("fp", F.col("first").alias("component_id"))
    else:
        named = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
            "label", F.coalesce("label", "fp")
        )
        least = named.groupBy("label").agg(F.min("first").alias("component_id"))
        owner = named.join(least, "label").select("fp", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(owner, "fp").select(F.col("id").alias(id_col), digits, "component_id")

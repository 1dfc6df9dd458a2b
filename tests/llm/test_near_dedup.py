import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillstone.llm.components import connected_components
from quillstone.llm.near_dedup import Tries, Walked, fingerprint, hamming_links, near_duplicates, simhash, trie_links
from quillstone.llm.queries import op1_simhash_near_dedup


def plain_fingerprint(text, n=4):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split() if w]
    grams = [b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, budget):
    label = {p: p for p in prints}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ordered = sorted(prints)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if (a ^ b).bit_count() <= budget:
                label[root(a)] = root(b)
    return {p: root(p) for p in prints}


TEXTS = ["", None, "  \n", "one", "A b C", "a b c", "to be or not to be", "To BE or not to be", "É été Ünder\tthe\x0btrée", "x " * 5000, "a\xa0b c d e"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert fingerprint(text) == plain_fingerprint(text)


def test_steps_of_a_long_text(monkeypatch):
    text = " ".join(random.Random(1).choices("abcdefgh", k=500))
    whole = fingerprint(text)
    monkeypatch.setattr("quillstone.llm.near_dedup._STEP", 7)
    assert fingerprint(text) == whole == plain_fingerprint(text)


def test_fingerprint_column_agrees_with_spark_hash(spark):
    df = spark.createDataFrame([("one two three four",)], "t string")
    row = df.select(simhash(F.col("t")), F.xxhash64("t")).first()
    assert row[0] == row[1]  # one shingle: the fingerprint is its hash


def _planted(seed, groups=30, copies=20, most=7):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, groups, dtype=np.uint64)
    near = [c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, most), replace=False))) for c in centres for _ in range(copies)]
    return np.unique(np.array([*centres, *near], np.uint64))


def _sorted(values, tries, kind):
    path = tries.path(values[:, None], np.full(len(values), kind))
    order = np.argsort(path)
    return path[order], values[order]


@pytest.mark.parametrize("seed", range(4))
def test_tries_find_every_link(seed):
    """The links of both tries, thinned as they are, have the components of all pairs within the budget."""
    values, tries = _planted(seed), Tries.halves(4)
    n, links = len(values), set()
    for kind in range(2):
        path, own = _sorted(values, tries, kind)
        walked = Walked()
        for i, j in trie_links(path, own[:, None], np.array([(0, n, 0, n, 0)]), 0, tries, chunk=50, walked=walked):
            links |= {(int(a), int(b)) for a, b in zip(own[i], own[j])}
        assert walked.pruned > walked.compared  # most of what the walk meets is decided by the budget
    assert all(0 < (a ^ b).bit_count() <= 4 for a, b in links)
    wanted = plain_components(values.tolist(), 4)
    assert len({frozenset((wanted[a], wanted[b])) for a, b in links if wanted[a] != wanted[b]}) == 0
    up = {v: v for v in values.tolist()}
    for a, b in links:
        old, new = up[a], up[b]
        up = {k: new if v == old else v for k, v in up.items()}
    assert len(set(up.values())) == len(set(wanted.values()))


def test_the_walk_compares_few_of_the_pairs():
    """On unlike fingerprints nearly all pairs are ruled out by bits added up along the way."""
    rng, tries, walked, n = np.random.default_rng(9), Tries.halves(4), Walked(), 20_000
    path, own = _sorted(np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)), tries, 0)
    assert not list(trie_links(path, own[:, None], np.array([(0, len(own), 0, len(own), 0)]), 0, tries, walked=walked))
    assert walked.compared < 0.005 * n * n / 2 and walked.pruned > 2 * walked.compared


def test_a_large_group_of_copies_is_not_compared_pair_by_pair():
    rng, tries, walked = np.random.default_rng(4), Tries.halves(4), Walked()
    bits = np.array([(1 << a) | (1 << b) for a, b in combinations(range(64), 2)], np.uint64)
    values = np.uint64(rng.integers(0, 2**63)) ^ bits  # any two differ in four bits at most
    path, own = _sorted(values, tries, 1)
    links = list(trie_links(path, own[:, None], np.array([(0, len(own), 0, len(own), 0)]), 0, tries, chunk=256, walked=walked))
    assert walked.compared < len(values) ** 2 / 8 and sum(len(i) for i, _ in links) >= len(values) // 2


def test_equal_paths_are_halved():
    """Fingerprints of two words with one path: leaves are told apart by their other word."""
    words = np.array([[7, k] for k in (0, 1, 3, 1 << 40, 2**50 - 1)], np.uint64)
    tries = Tries((0,), (0,) * 65, 2)
    links = [(int(a), int(b)) for i, j in trie_links(words[:, 0], words, np.array([(0, 5, 0, 5, 0)]), 0, tries) for a, b in zip(i, j)]
    joined = {frozenset(x) for x in links}
    assert len(links) == 3 and all(4 not in x for x in joined) and {x for y in joined for x in y} == {0, 1, 2, 3}


def test_paths_of_a_ring():
    tries = Tries((0, 8, 64, 120), (64,) * 65, 128)
    words = np.array([[0x0123456789ABCDEF, 0xFEDCBA9876543210]] * 4, np.uint64)
    assert [hex(x) for x in tries.path(words, np.arange(4)).tolist()] == ["0x123456789abcdef", "0x23456789abcdeffe", "0xfedcba9876543210", "0x100123456789abcd"]


@pytest.mark.parametrize(("node", "hot"), [(1 << 15, 1 << 15), (4, 1 << 15), (1 << 15, 5), (16, 7)])
def test_links_connect_what_is_near(spark, node, hot):
    """Whatever the depth from which tasks walk, and with crowded nodes split into parts."""
    rng = random.Random(node + hot)
    prints = {rng.getrandbits(64) for _ in range(150)} | {0, 2**64 - 1}
    prints |= {p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for p in list(prints)[:80] for _ in range(3)}
    signed = [(p - 2**64 if p >> 63 else p,) * 2 for p in prints]
    links = hamming_links(spark.createDataFrame(signed, "fp long, key long"), Tries.halves(4), node=node, hot=hot)
    label = {r["node"] % 2**64: r["label"] % 2**64 for r in connected_components(links).collect()}
    wanted = plain_components(prints, 4)
    groups = lambda m: {frozenset(p for p in prints if m.get(p, p) == x) for x in {m.get(p, p) for p in prints}}
    assert groups(label) == groups(wanted)


def test_whole_query_against_brute_force(spark, sf_dir):
    """Fingerprints by the plain rule, components over all pairs."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {i: plain_fingerprint(t) for i, t in docs.items()}
    group = plain_components(set(prints.values()), 4)
    least = {}
    for i in sorted(prints):
        least.setdefault(group[prints[i]], i)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op1_simhash_near_dedup(spark, sf_dir).collect()}
    assert got == {i: (f"{p:016x}", least[group[p]]) for i, p in prints.items()}


def test_components_of_chains_loops_and_hubs(spark):
    rows = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1100)] + [(5000, 5000), (None, 3)]
    label = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(rows, "src long, dst long")).collect()}
    assert len({label[k] for k in range(201)}) == 1 and len({label[k] for k in range(1000, 1100)}) == 1 and label[0] != label[1000]
    assert connected_components(spark.createDataFrame([], "src long, dst long")) is None


def test_near_duplicates(spark):
    base = " ".join(random.Random(3).choices([f"w{k}" for k in range(400)], k=300))
    docs = [(7, base), (3, base), (9, base + " tail"), (4, ""), (None, None), (1, "quite another text with words"), (1, "quite another text with words"), (2, "few")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"fp": F.lit(1), "component_id": F.lit("x"), "id": F.lit(2)})
    got = sorted(((r["doc_id"], r["component_id"]) for r in near_duplicates(df).collect()), key=str)
    prints = {fingerprint(base), fingerprint(base + " tail")}
    tail = 3 if len(prints) == 1 or (prints.pop() ^ prints.pop()).bit_count() <= 4 else 9
    assert got == sorted([(7, 3), (3, 3), (9, tail), (4, 4), (None, 4), (1, 1), (1, 1), (2, 2)], key=str)
    assert near_duplicates(df.limit(0)).count() == 0

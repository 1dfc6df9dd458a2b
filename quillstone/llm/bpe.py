"""BPE encoding by speculation and verification, and decoding.

A greedy longest match proposes the tokens of each new word. Byte pair encoding would give the same tokens if and only
if it keeps every adjacent pair of them apart, which one vectorised test decides for all pairs of a batch: both tokens
are taken apart again at the boundary, the later merge first, and at no step may a merge across it have come sooner.
Only words with a failing pair are merged exactly.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as the tokenizer sees it; str.split() parts at some control characters besides.
_BLANK = re.compile("[\t-\r \x85\xa0  -     　]+")
_CONTROL = re.compile("[\x1c-\x1f]")
#: A rank above all merges.
_NEVER = 1 << 40
#: Texts that are encoded together.
_TOGETHER = 256


def pieces_of(text: str | None) -> list[str]:
    """The parts of a text between white space; no token reaches over one."""
    text = text or ""
    return [x for x in _BLANK.split(text) if x] if _CONTROL.search(text) else text.split()


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 itself, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordBpe:
    """BPE of words that end in a suffix: NFC, lower case, white space dropped, byte-level letters.

    `config` is the text of a tokenizer file. Other normalisers, splits or models than these are refused.
    """

    #: Pieces, and words, that a worker remembers at most after a batch: some 250 bytes each.
    remembered = 400_000

    def __init__(self, config: str):
        given = json.loads(config)
        model, split = given["model"], given["pre_tokenizer"]["pretokenizers"]
        kinds = [x["type"] for x in given["normalizer"]["normalizers"]]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        if kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in split] != ["Split", "ByteLevel"] or not plain:
            raise ValueError("only lower-cased, byte-level BPE of words with a suffix is supported")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        self.added = {x["content"]: x["id"] for x in given["added_tokens"]}
        self.marks = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self.words = regex.compile(split[0]["pattern"]["Regex"])
        self.letters = dict(enumerate(byte_letters()))
        self.known: dict[str, bytes] = {}  # words met so far
        self.spelt = {v: k for k, v in [*self.vocab.items(), *self.added.items()]}
        self.longest = max(map(len, self.vocab))
        size = max(self.vocab.values()) + 1
        self.left, self.right = np.full(size, -1), np.full(size, -1)
        self.born = np.full(size, -1)  # the merge that makes a token; letters have none
        self.rank_of: dict[int, int] = {}  # by left * size + right
        self.made: list[int] = []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            a, b, made = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank_of.setdefault(a * size + b, rank)
            self.made.append(made)
            if self.born[made] < 0:
                self.left[made], self.right[made], self.born[made] = a, b, rank
        keys = np.array(list(self.rank_of))
        order = np.argsort(keys)
        self.keys, self.size = keys[order], size
        self.key_rank = np.array(list(self.rank_of.values()))[order]

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, or a number above all."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], _NEVER)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE of the joined strings of two tokens keeps them apart, for arrays of pairs."""
        a, b = a.copy(), b.copy()
        good = np.ones(len(a), bool)
        until = np.full(len(a), _NEVER)  # merges across the boundary must not come before this one
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            good[live] = self._rank(x, y) >= until[live]
            undo_left = self.born[x] > self.born[y]  # at equal ranks the left one was made first
            last = np.maximum(self.born[x], self.born[y])
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left | (last < 0), y, self.left[y])
            # Where the right token was made by the same merge, the one across stands to its left and comes first.
            until[live] = np.where(undo_left, last, last + 1)
            live = live[good[live] & (last >= 0)]
        return good

    def _greedy(self, word: str) -> list[int] | None:
        """Longest matches from left to right; the last one holds the suffix."""
        vocab, n, at, out = self.vocab, len(word), 0, []
        while at < n:
            end = vocab.get(word[at:] + self.suffix) if n - at <= self.longest else None
            if end is not None:
                out.append(end)
                return out
            for to in range(min(n - 1, at + self.longest), at, -1):
                token = vocab.get(word[at:to])
                if token is not None:
                    out.append(token)
                    at = to
                    break
            else:
                return None
        return out

    def exact(self, word: str) -> list[int]:
        """Merges of the least rank first, the leftmost of equal ones. Only pairs next to a merge change."""
        size, rank_of = self.size, self.rank_of
        ids = [self.vocab[c] for c in word[:-1]] + [self.vocab[word[-1] + self.suffix]]
        ranks = [rank_of.get(a * size + b, _NEVER) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == _NEVER:
                break
            k = ranks.index(least)
            made = ids[k] = self.made[least]
            del ids[k + 1], ranks[k]
            if k:
                ranks[k - 1] = rank_of.get(ids[k - 1] * size + made, _NEVER)
            if k < len(ranks):
                ranks[k] = rank_of.get(made * size + ids[k + 1], _NEVER)
        return ids

    def spelling(self, word: str) -> str:
        """A word in byte-level letters."""
        if word.isascii() and word.isprintable():
            return word
        return word.encode("utf-8", "replace").decode("latin-1").translate(self.letters)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Tokens of normalised words."""
        if not words:
            return []
        words = list(map(self.spelling, words))
        guess = [self._greedy(w) for w in words]
        sizes = np.array([len(g) if g else 0 for g in guess])
        flat = np.fromiter((t for g in guess for t in g or ()), np.int64, sizes.sum())
        owner = np.repeat(np.arange(len(words)), sizes)
        near = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[near] * self.size + flat[near + 1], return_inverse=True)
        wrong = owner[near][~self.apart(pairs // self.size, pairs % self.size)[back]]
        for k in [*np.unique(wrong).tolist(), *(i for i, g in enumerate(guess) if g is None)]:
            guess[k] = self.exact(words[k])
        return guess

    def spell(self, ids: np.ndarray) -> str:
        """The spellings of tokens, joined by blanks; ids that are no token are left out."""
        try:
            return " ".join(map(self.spelt.__getitem__, ids.tolist()))
        except KeyError:
            return " ".join(self.spelt[i] for i in ids.tolist() if i in self.spelt)

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Tokens of parts of texts between white space, as little-endian unsigned 32-bit integers."""
        parts: list[list[str | int]] = []
        fresh: set[str] = set()
        known = self.known
        for piece in pieces:
            own: list[str | int] = []
            runs = self.marks.split(piece) if self.marks and self.marks.search(piece) else (piece,)
            for run in runs:
                if run in self.added:
                    own.append(self.added[run])
                elif run:
                    if run.isascii():
                        run = run.lower()
                    else:
                        run = unicodedata.normalize("NFC", run)
                        run = "".join(map(str.lower, run)) if "Σ" in run else run.lower()
                    if run.isalpha():
                        words = [run]
                    elif run[-1] in ".,;:" and run[:-1].isalpha():
                        words = [run[:-1], run[-1]]
                    else:
                        words = self.words.findall(run)
                    for word in words:
                        own.append(word)
                        if word not in known:
                            fresh.add(word)
            parts.append(own)
        names = list(fresh)
        for word, ids in zip(names, self.encode_words(names)):
            known[word] = np.array(ids, "<u4").tobytes()
        out = [b"".join(known[x] if isinstance(x, str) else x.to_bytes(4, "little") for x in own) for own in parts]
        if len(known) > self.remembered:
            known.clear()
        return out


def encode_texts(
    texts: list[str | None], encode: Callable[[list[str]], list[bytes]], memory: dict[str, bytes], most: int = WordBpe.remembered
) -> list[bytes]:
    """Tokens of texts as bytes. `encode` sees each new part of a text once; above `most` parts `memory` is trimmed to
    those in use."""
    split = [pieces_of(t) for t in texts]
    fresh = list({p for own in split for p in own if p not in memory})
    memory.update(zip(fresh, encode(fresh)))
    out = [b"".join(map(memory.__getitem__, own)) for own in split]
    if len(memory) > most:
        kept = {p: memory[p] for own in split for p in own}
        memory.clear()
        memory.update(kept)
    return out


#: Per worker: tokenizers and what they remember, by the digest of the tokenizer file.
_LOADED: dict[tuple[str, int], Any] = {}


def _loaded(kind: str, config: str, make: Callable[[str], Any]) -> tuple[Any, dict[str, bytes]]:
    key = (kind, hash(config))
    if key not in _LOADED:
        _LOADED[key] = (make(config), {})
    return _LOADED[key]


def _config(spark: SparkSession, path: str) -> Any:
    with open(path, encoding="utf-8") as file:  # a file on the driver; its text goes to the executors
        return spark.sparkContext.broadcast(file.read())


def as_lists(parts: Iterable[bytes]) -> pa.ListArray:
    parts = list(parts)
    offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def encode(spark: SparkSession, text: Column, path: str) -> Column:
    """Token ids (array<int>) of whole texts with the tokenizer file at `path`, without special tokens added.

    Null and empty texts, and those of white space alone, have no ids. Special tokens spelt out in a text become
    their ids.
    """
    config = _config(spark, path)

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe, memory = _loaded("own", config.value, WordBpe)
        for texts in batches:
            out: list[bytes] = []
            for k in range(0, len(texts), _TOGETHER):
                out += encode_texts(texts.slice(k, _TOGETHER).to_pylist(), bpe.encode_pieces, memory)
            yield as_lists(out)

    return ids(text)


def decode(spark: SparkSession, ids: Column, path: str) -> Column:
    """The text of token ids: the tokens' spellings joined by blanks; unknown ids are left out, null gives ''."""
    config = _config(spark, path)

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe, _ = _loaded("own", config.value, WordBpe)
        for lists in batches:
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
            yield pa.array([bpe.spell(flat[a:b]) for a, b in zip([0, *ends], ends)], pa.string())

    return texts(ids)


def tokenise(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """`docs` without the text column, with `ids` and the `decoded` text in place of any such columns.

    The ids are those of `encode`, and the text is decoded from them as by `decode`, in one pass in which a task holds
    some hundred texts' tokens at a time. Repeated rows get equal results; an empty table stays empty.
    """
    config = _config(docs.sparkSession, path)
    rest = docs.drop(text_col, "ids", "decoded")
    kind = T.StructType([*rest.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, memory = _loaded("own", config.value, WordBpe)
        for batch in batches:
            for k in range(0, batch.num_rows, _TOGETHER):
                part = batch.slice(k, _TOGETHER)
                own = encode_texts(part.column(0).to_pylist(), bpe.encode_pieces, memory)
                texts = pa.array([bpe.spell(np.frombuffer(x, "<u4")) for x in own], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], as_lists(own), texts], kind.names)

    return docs.select(F.col(text_col).alias("text"), *(F.col(f"`{c}`") for c in rest.columns)).mapInArrow(run, kind)

"""Token ids in binary files of independent zstandard frames.

A file holds one frame for each document, in order, with its ids as little-endian unsigned integers of `width` bytes;
then a skippable frame with the width, a byte for each document that tells whether it has an id, and the ids; then a seek table in the seekable zstandard format: a
skippable frame with the compressed size, the plain size and a checksum (the low half of the plain data's XXH64) of
each frame before it. A reader takes the table from the end of the file and decompresses only the frames it wants.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.bpe import WordBpe, _config, _loaded, as_lists, pieces_of
from quillstone.llm.common import save, shared_folder

# Fixed values of the seekable zstandard format: magic numbers of skippable frames and of the table's footer.
_SKIPPABLE, _TABLE, _FOOTER = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_ENTRY, _END = struct.Struct("<III"), struct.Struct("<IBI")
_CHECKSUMS = 0x80
#: Bytes of text that are encoded together; one text more at most.
_TOGETHER = 8 << 20


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class TokenWriter:
    """Writes documents, given in order, to one file; the file appears under its name when it is whole."""

    def __init__(self, path: str, width: int = 4, level: int = 3):
        self.files, self.path = _open(path)
        self.width, self.dtype = width, {2: "<u2", 4: "<u4"}[width]
        self.press = zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.ids, self.entries, self.tokens = [], [], 0
        self.files.create_dir(os.path.dirname(self.path), recursive=True)
        self.out = self.files.open_output_stream(self.path + ".part")

    def _frame(self, frame: bytes, plain: bytes) -> None:
        self.out.write(frame)
        self.entries.append(_ENTRY.pack(len(frame), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        plain = ids.astype(self.dtype).tobytes()
        self._frame(self.press.compress(plain), plain)
        self.ids.append(doc_id)
        self.tokens += len(ids)

    def close(self) -> None:
        known = np.array([i is not None for i in self.ids], np.uint8).tobytes()
        index = struct.pack("<B", self.width) + known + np.array([i or 0 for i in self.ids], "<i8").tobytes()
        self._frame(struct.pack("<II", _SKIPPABLE, len(index)) + index, b"")
        table = b"".join(self.entries) + _END.pack(len(self.entries), _CHECKSUMS, _FOOTER)
        self.out.write(struct.pack("<II", _TABLE, len(table)) + table)
        self.out.close()
        self.files.move(self.path + ".part", self.path)


class TokenReader:
    """Reads a file of `TokenWriter`: `ids` are the document ids, `tokens(k)` the token ids of the k-th document."""

    def __init__(self, path: str):
        files, path = _open(path)
        self.file = files.open_input_file(path)
        size = self.file.size()
        count, _, magic = _END.unpack(self.file.read_at(_END.size, size - _END.size))
        if magic != _FOOTER:
            raise ValueError(f"{path} has no seek table")
        table = self.file.read_at(count * _ENTRY.size, size - _END.size - count * _ENTRY.size)
        self.entries = np.frombuffer(table, "<u4").reshape(-1, 3).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.entries[:, 0])))
        index = self.file.read_at(int(self.entries[-1, 0]), int(self.starts[-2]))[8:]
        self.width = index[0]
        known, ids = index[1:count], np.frombuffer(index[count:], "<i8").tolist()  # count has the index frame too
        self.ids = [i if there else None for i, there in zip(ids, known)]
        self.counts = self.entries[:-1, 1] // self.width
        self.unpress = zstandard.ZstdDecompressor()

    def tokens(self, k: int) -> np.ndarray:
        packed, size, checksum = map(int, self.entries[k])
        plain = self.unpress.decompress(self.file.read_at(packed, int(self.starts[k])), max_output_size=size) if size else b""
        if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != checksum:
            raise ValueError(f"checksum of document {k} differs")
        return np.frombuffer(plain, {2: "<u2", 4: "<u4"}[self.width])

    def close(self) -> None:
        self.file.close()


class LibraryBpe(WordBpe):
    """The same cutting into words, each encoded once by the BPE model of the tokenizers library.

    A test holds this against the library's own encoding of whole texts; `encode_batch` on single words gives the same
    and takes a third longer.
    """

    remembered = 800_000  # the library takes longer for a word than it costs to remember more of them

    def __init__(self, config: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__(config)
        self.model = Tokenizer.from_str(config).model
        self.cut = regex.compile(f"{self.words.pattern}|\n")
        # A line break ends a part of a text; with one before it, an added token is no word.
        self.marked = {"\n": b"", **{f"\n{mark}": k.to_bytes(4, "little") for mark, k in self.added.items()}}

    def encode_words(self, words: list[str]) -> list[list[int]]:
        return [[token.id for token in self.model.tokenize(word)] for word in map(self.spelling, words)]

    def _words(self, lines: str) -> list[str]:
        """Normalised words, added tokens and line breaks of parts of texts that are lines."""
        words: list[str] = []
        for run in self.marks.split(lines) if self.marks else (lines,):
            if run in self.added:
                words.append(f"\n{run}")
            else:
                run = run if run.isascii() else unicodedata.normalize("NFC", run).replace("Σ", "σ")
                words += self.cut.findall(run.lower())
        return words

    def encode_column(self, texts: pa.Array) -> pa.ListArray:
        """Tokens of texts, as `encode_texts` gives them: each part of a text between white space is cut into words once,
        each word looked up once."""
        texts = texts.fill_null("")
        if pc.any(pc.match_substring_regex(texts, "[\x1c-\x1f]")).as_py():
            split = pa.array(map(pieces_of, texts.to_pylist()), pa.list_(pa.string()))
        else:
            split = pc.utf8_split_whitespace(texts)  # parts may be empty and have no tokens then
        at = split.flatten().dictionary_encode()
        lines = "\n".join([*at.dictionary.to_numpy(zero_copy_only=False), ""])
        words = pa.array(self._words(lines), pa.string()).dictionary_encode()
        names = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.known.update(self.marked)
        own = list(map(self.known.get, names))
        fresh = [k for k, ids in enumerate(own) if ids is None]
        for k, ids in zip(fresh, self.encode_words([names[k] for k in fresh])):
            own[k] = self.known[names[k]] = np.array(ids, "<u4").tobytes()
        if len(self.known) > self.remembered:
            self.known = dict(zip(names, own))
        tokens = as_lists(own).take(words.indices)
        ends = np.flatnonzero(words.indices.to_numpy() == words.dictionary.index("\n").as_py())
        parts = pa.ListArray.from_arrays(np.append(0, tokens.offsets.to_numpy()[ends]).astype(np.int32), tokens.values)
        found = parts.take(at.indices)
        offsets = split.offsets.to_numpy()
        return pa.ListArray.from_arrays(found.offsets.to_numpy()[offsets - offsets[0]], found.values)


def _together(texts: pa.Array) -> Iterator[slice]:
    """Rows that are encoded together."""
    size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = sorted({0, *(np.flatnonzero(np.diff(size // _TOGETHER)) + 1).tolist(), len(size)})
    yield from map(slice, cuts, cuts[1:])


def write_token_files(
    docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2
) -> DataFrame:
    """Encode whole texts with the tokenizers library and write them in ascending order of id.

    Rows are dealt out by ranges of the id, and each task writes one file to `folder` (by default in the shared
    folder). Words are encoded once and remembered, since no token of the supported tokenizers reaches over one; a task
    encodes some megabytes of text together, and very long texts whole. `end_id` ends each document. The result is the
    manifest, a saved table with a row a file: part, path, docs, tokens, start (ids in all files before). A task that
    runs again writes a file of another name, and only the one that counts is in the manifest. Null ids come first,
    ties are ordered by text; null texts count as empty; an empty table gives an empty manifest.
    """
    config = _config(docs.sparkSession, tokenizer)
    folder = folder or f"{shared_folder(docs.sparkSession)}/tokens"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, _ = _loaded("library", config.value, LibraryBpe)
        part, writer = TaskContext.get().partitionId(), None
        for batch in batches:
            for rows in _together(batch.column(1)):
                if writer is None:
                    name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.ids.zst"
                    writer = TokenWriter(name, width=2 if max(*bpe.spelt, end_id) < 1 << 16 else 4)
                found = bpe.encode_column(batch.column(1)[rows])
                ends = found.offsets.to_numpy()[1:]
                tokens = np.insert(found.values.to_numpy().astype(writer.dtype), ends, end_id)
                ends = ends + np.arange(1, len(ends) + 1)
                for doc_id, a, b in zip(batch.column(0)[rows].to_pylist(), [0, *ends.tolist()], ends.tolist()):
                    writer.add(doc_id, tokens[a:b])
        if writer is not None:
            writer.close()
            row = [[part], [name], [len(writer.ids)], [writer.tokens]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in row], ["part", "path", "docs", "tokens"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    files = save(ordered.mapInArrow(write, "part long, path string, docs long, tokens long"), "files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return save(files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Documents of the files of a manifest: doc_id, start (ids of all documents before), n_tokens, tokens.

    `tokens` are the ids as little-endian unsigned 32-bit integers. Checksums are verified; a task reads a file at a
    time and yields batches of bounded size.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = TokenReader(path)
                starts = start + np.concatenate(([0], np.cumsum(reader.counts)))
                for k in range(0, len(reader.ids), 512):
                    span = range(k, min(k + 512, len(reader.ids)))
                    tokens = [reader.tokens(j).astype("<u4").tobytes() for j in span]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(reader.ids[span.start : span.stop], pa.int64()),
                            pa.array(starts[span.start : span.stop]),
                            pa.array(reader.counts[span.start : span.stop]),
                            pa.array(tokens, pa.binary()),
                        ],
                        ["doc_id", "start", "n_tokens", "tokens"],
                    )
                reader.close()

    files = manifest.select("part", "path", "start")
    dealt = files.repartitionByRange(max(1, files.count()), "part").select("path", "start")
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, tokens binary")

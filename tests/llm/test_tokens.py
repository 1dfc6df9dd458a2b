import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillstone.llm import token_files
from quillstone.llm.bpe import WordBpe, decode, encode, encode_texts, pieces_of, tokenise
from quillstone.llm.queries import op7_bpe, op10_token_files
from quillstone.llm.token_files import LibraryBpe, TokenReader, TokenWriter, read_token_files, write_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = WordBpe(open(PATH, encoding="utf-8").read())
SOLID = "aAbßéÉΣςσİ'`\"<|endoftext|>$12²½Ⅷ\x1c\x1f\x85 ́ñ中文😀ͅǅ\x00​\t\n.,ﬁ"


WORDS = LibraryBpe(open(PATH, encoding="utf-8").read())


def same(texts):
    """The operator's own merging, and the library on words, give what the library gives for whole texts."""
    for encode in (OWN.encode_pieces, WORDS.encode_pieces):
        found = [np.frombuffer(x, "<u4").tolist() for x in encode_texts(texts, encode, {})]
        assert found == [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(SOLID), max_size=30))
def test_any_text(text):
    same([text])


def test_edges_and_words():
    same(["", None, "  ", "<|endoftext|>x<|startoftext|>", "don't WE'LL I'm", "a</w>b", "ΑΣ ΑΣΑ", "aaaaaaaaaaaaaaaaaaaaaaaa", "z" * 3000])
    rng = random.Random(5)
    same([" ".join("".join(rng.choices("etaoinshrdlu", k=rng.randrange(1, 14))) for _ in range(50)) for _ in range(200)])


def test_pairs_are_apart_exactly_if_merging_keeps_them():
    rng = np.random.default_rng(2)
    plain = [t for s, t in OWN.vocab.items() if s.isascii() and s.isalpha()]
    a, b = rng.choice(plain, 4000), rng.choice(plain, 4000)
    wanted = [OWN.exact(OWN.spelt[x] + OWN.spelt[y] + "q")[:2] == [x, y] or None for x, y in zip(a.tolist(), b.tolist())]
    got = OWN.apart(a, b)
    # A following letter may change the right token, so that only a clear case counts.
    assert all(g for g, w in zip(got, wanted) if w)


def test_other_tokenizers_are_refused():
    with pytest.raises((ValueError, KeyError)):
        WordBpe(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())


def test_columns(spark):
    texts = ["Hello, wörld!", None, "", " ", "x" * 200_000]
    df = spark.createDataFrame([(k, t, "old") for k, t in enumerate(texts)], "doc_id long, text string, ids string")
    wanted = [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in texts]
    spelt = [LIBRARY.decode(i, skip_special_tokens=False) for i in wanted]
    for found in (tokenise(df, PATH), df.withColumn("ids", encode(spark, F.col("text"), PATH)).withColumn("decoded", decode(spark, F.col("ids"), PATH))):
        rows = found.orderBy("doc_id").collect()
        assert [r["ids"] for r in rows] == wanted and [r["decoded"] for r in rows] == spelt
    odd = spark.createDataFrame([([-1, 560, 10**9],), (None,), ([],)], "ids array<int>")
    assert [r[0] for r in odd.select(decode(spark, F.col("ids"), PATH)).collect()] == ["ha", "", ""]
    assert tokenise(df.limit(0), PATH).count() == 0


@pytest.fixture(scope="module")
def library_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    return [(r["doc_id"], LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs]


def test_bpe_query(spark, sf_dir, library_rows):
    got = {r["doc_id"]: r for r in op7_bpe(spark, sf_dir).collect()}
    for doc_id, ids in library_rows:
        row = got.pop(doc_id)
        assert row["n_tokens"] == len(ids) and row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert not got


def test_token_file_query(spark, sf_dir, library_rows):
    got, start = {r["doc_id"]: r for r in op10_token_files(spark, sf_dir).collect()}, 0
    for doc_id, ids in library_rows:
        row, ids = got.pop(doc_id), [*ids, 2]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not got


@pytest.mark.parametrize("width", [2, 4])
def test_files_are_read_one_document_at_a_time(tmp_path, width):
    rng = np.random.default_rng(1)
    docs = [(None, np.array([], int)), (-(2**63), np.array([], int)), (5, rng.integers(0, 60_000, 10_000)), (-7, np.array([1])), (5, np.array([2, 2]))]
    writer = TokenWriter(f"file://{tmp_path}/x.zst", width)
    for doc_id, ids in docs:
        writer.add(doc_id, ids)
    writer.close()
    reader = TokenReader(f"{tmp_path}/x.zst")
    assert reader.ids == [None, -(2**63), 5, -7, 5] and [reader.tokens(k).tolist() for k in (4, 2, 0, 3)] == [docs[k][1].tolist() for k in (4, 2, 0, 3)]
    reader.close()
    data = bytearray((tmp_path / "x.zst").read_bytes())
    import zstandard

    whole = b"".join(zstandard.ZstdDecompressor().decompress(data[a:b], max_output_size=1 << 20) for a, b in zip(reader.starts[:-2], reader.starts[1:-1]) if b - a)
    assert len(whole) == width * 10_003
    data[int(reader.starts[2]) + 20] ^= 255
    (tmp_path / "bad.zst").write_bytes(data)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        TokenReader(f"{tmp_path}/bad.zst").tokens(2)


def test_token_file_edges(spark):
    rows = [(3, "b"), (None, "null id"), (3, "a"), (-1, None), (3, "a"), (9, "x y " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("x"))
    manifest = write_token_files(df, PATH)
    got = [(r["doc_id"], r["start"], r["n_tokens"]) for r in read_token_files(manifest).orderBy("start").collect()]
    assert [g[0] for g in got] == [None, -1, 3, 3, 3, 9] and [g[1] for g in got] == np.cumsum([0, *(g[2] for g in got[:-1])]).tolist()
    assert read_token_files(write_token_files(df.limit(0), PATH)).count() == 0


def test_a_batch_without_new_words():
    memory = {}
    once = encode_texts(["Well known words"], OWN.encode_pieces, memory)
    memory.clear()
    assert encode_texts(["Well known words"], OWN.encode_pieces, memory) == once and OWN.encode_words([]) == []


def test_a_column_is_encoded_as_the_library_does_its_texts():
    marked = ["<|endoftext|>x<|startoftext|>y", "<|ENDOFTEXT|> <|endoftext|", "e<|endoftext|>\u0301", "\n<|endoftext|>\n"]
    texts = ["", None, "  ", " \ta\r\n b\u2028c\x85d\u3000", "don't WE'LL I'm", "a</w>b", "ΑΣ ΑΣΑ Σ", "e\u0301İ ﬁ", *marked, "z" * 3000]
    for given in (texts, [*texts, "a\x1cb \x1f c"], [None], ["", " "], []):
        wanted = [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in given]
        column = pa.array(["cut off", *given], pa.string())[1:]
        assert WORDS.encode_column(column).to_pylist() == wanted and WORDS.encode_column(column).to_pylist() == wanted


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(SOLID), max_size=30), max_size=5))
def test_any_column(texts):
    wanted = [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert WORDS.encode_column(pa.array(texts, pa.string())).to_pylist() == wanted


def test_white_space_parts_a_column_as_it_does_a_text():
    texts = [f"a{chr(c)}b" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not 0x1C <= c < 0x20]
    parts = pc.list_value_length(pc.utf8_split_whitespace(pa.array(texts))).to_pylist()
    assert [n > 1 for n in parts] == [len(pieces_of(t)) > 1 for t in texts]


def test_words_meet_the_library_once_in_a_column():
    bpe, seen = LibraryBpe(open(PATH, encoding="utf-8").read()), []
    encode, bpe.remembered = bpe.encode_words, 0
    bpe.encode_words = lambda words: seen.extend(words) or encode(words)
    texts = pa.array([f"Plain WORDS, {k % 7}" for k in range(2000)])
    assert len(set(map(str, bpe.encode_column(texts)))) == 7
    assert sorted(seen) == sorted(["plain", "words", ",", *"0123456"])  # parts of 256 texts would meet them eight times
    bpe.encode_column(pa.array(["other"]))
    assert "other" in bpe.known and "plain" not in bpe.known  # no more is remembered than the last column's words


def test_texts_encoded_together_are_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "_TOGETHER", 10)
    texts = pa.array(["", "x" * 35, None, "abc", "é" * 4, "d", "", "x" * 9, "y" * 9])
    rows = [range(len(texts))[part] for part in token_files._together(texts)]
    assert [k for part in rows for k in part] == list(range(len(texts))) and all(rows)
    assert all(sum(len((texts[k].as_py() or "").encode()) for k in part[1:]) < 10 for part in rows)
    assert list(token_files._together(texts[:0])) == []

import pytest
from pyspark.sql import functions as F

from quillstone.llm.exact_dedup import exact_duplicates, keep_first, retain, sha256

ROWS = [(1, "a"), (2, "a"), (2, "a"), (None, None), (5, ""), (6, "A"), (7, "a "), (None, "only"), (8, "é" * 50_000), (9, "é" * 50_000), (10, "ab"), (11, "ba"), (12, "ab")]


def plain(rows):
    best, size = {}, {}
    for doc_id, text in rows:
        key = text or ""
        best[key] = max((best.get(key), doc_id), key=lambda x: (x is not None, x or 0))
        size[key] = size.get(key, 0) + 1
    return sorted(((i, best[t or ""], size[t or ""]) for i, t in rows), key=str)


@pytest.mark.parametrize("digest", [sha256, lambda c: F.unhex(F.lpad(F.hex(F.length(c) % 3), 4, "0"))], ids=["sha256", "weak digest"])
def test_groups(spark, digest):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"file": F.lit("x"), "row": F.lit(0), "digest": F.lit(1)})
    found = exact_duplicates(df, digest=digest).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in found), key=str) == plain(ROWS)
    texts = {t or "" for _, t in ROWS}
    assert sum(r["kept"] for r in found) == len(texts)


def test_kept_rows_keep_their_columns(spark):
    df = spark.createDataFrame([(i, t, "s", 1, 2) for i, t in ROWS], "doc_id long, text string, file string, placed_file int, Placed_Row int")
    kept = keep_first(df)
    assert kept.columns == df.columns and [tuple(r)[2:] for r in kept.collect()] == [("s", 1, 2)] * len({t or "" for _, t in ROWS})
    assert keep_first(df.limit(0)).count() == 0 and exact_duplicates(df.limit(0)).count() == 0


def test_state_goes_on_where_it_ended(spark, tmp_path):
    kind, feed = "digest string, id long, file string, row long", str(tmp_path / "feed")
    spark.createDataFrame([("d", 1, "f", 0), ("e", 2, "f", 1)], kind).write.parquet(feed)
    read = lambda: spark.readStream.schema(kind).parquet(feed)
    retain(read(), f"file://{tmp_path}")
    spark.createDataFrame([("d", 9, "g", 0), ("d", 3, "g", 1)], kind).write.mode("append").parquet(feed)
    got = {r["digest"]: (r["keep"]["id"], r["keep"]["file"], r["copies"]) for r in retain(read(), f"file://{tmp_path}").collect()}
    assert got == {"d": (9, "g", 3), "e": (2, "f", 1)}

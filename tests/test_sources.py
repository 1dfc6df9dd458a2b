from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillstone.functions import convert
from quillstone.functions import fields as ff
from quillstone.plans import entities as e
from quillstone.sources.csv import Mapper, import_rows, path_parts, read_csv, watch_mapper
from quillstone.sources.tables import get_entity, read_entities, read_layout, write_entities, write_layout
from quillstone.operators import layout
from quillstone.operators.paging import NotFound, get
from quillstone.streaming.change_log import change_counts, compact_stream, compacted, read_log

WATCHES = '''id,name,price,brand,model,ref,mvmt,casem,bracem,yop,cond,sex,size,condition
7,"Tide
No. 3","$6,150",Quell,Ebb,Q-3,,,,2011,Unworn,Unisex,39 mm,
8,"Slate ""II""",Price on request,Marrow,Slate,M2,Quartz,Steel,,1977 (Approximation),Good,,24 x 31 mm,
x,Broken,1,B,,,,,,,,,,
3,,1,B,,,,,,,,,,
4,Odd,1,B,,,,,,1800,Mint,,wide,
5,Short,1
'''


def test_watch_list(spark, tmp_path):
    (tmp_path / "w.csv").write_text(WATCHES)
    done = import_rows(read_csv(spark, str(tmp_path / "w.csv")), watch_mapper())
    rows = {r["id"]: r.asDict(True) for r in done.rows.collect()}
    assert rows[7]["name"] == "Tide\nNo. 3" and rows[7]["price"] == {"value": 6150.0, "display": "$6,150"} and rows[7]["size"] == {"width": 39.0, "height": None}
    assert rows[8]["name"] == 'Slate "II"' and rows[8]["price"]["value"] is None and rows[8]["yearOfProduction"] == {"year": 1977, "approximate": True}
    assert rows[8]["size"] == {"width": 24.0, "height": 31.0} and rows[8]["material"]["case"] == "Steel"
    errors = {r["row"]: (r["column"], r["reason"]) for r in done.errors.collect()}
    assert errors == {3: ("id", "invalid int: x"), 4: ("name", "required value is missing"), 5: ("yop", "year out of range: 1800"), 6: ("", "malformed record")}
    assert done.counts().first() == (6, 2, 4)


def test_empty_cells_and_errors_of_custom_transformers(spark):
    rows = spark.createDataFrame([(" ", "2"), ("", "odd")], "a string, b string")
    even = ff.custom(lambda c: c.try_cast("int"), lambda c: F.when(~c.rlike("^[0-9]+$"), F.concat(F.lit("not a count: "), c)))
    made = import_rows(rows, Mapper("t").map("a", "a", ff.trim(ff.default("none"))).map("b", "b", even))
    assert [r[1:] for r in made.rows.collect()] == [("none", 2)]
    assert [(r["column"], r["reason"]) for r in made.errors.collect()] == [("b", "not a count: odd")]


def test_get_of_a_row_that_is_not_there(spark, sf_dir):
    with pytest.raises(NotFound):
        get(e.orders(spark, sf_dir), e.ORDERS, "nothing")


def test_paths_and_arrays(spark):
    assert path_parts("items[0].id") == ["items", 0, "id"]
    rows = spark.createDataFrame([("1", "x", "")], "a string, b string, c string")
    made = import_rows(rows, Mapper("t").map("a", "items[0].id", ff.to_int()).map("b", "items[1].id", ff.default(7, ff.custom(lambda c: F.length(c)))).map("c", "d", ff.default("none")))
    assert made.rows.drop("row").first().asDict(True) == {"items": [{"id": 1}, {"id": 1}], "d": "none"}


@pytest.mark.parametrize(
    ("text", "expected"),
    [("1714564800000", datetime(2024, 5, 1, 12)), ("2024-05-01T14:00:00+02:00", datetime(2024, 5, 1, 12)), ("2024-05", datetime(2024, 5, 1)), ("2024-05-01", datetime(2024, 5, 1)), ("soon", None), ("", None)],
)
def test_times(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(convert.to_time(F.col("t"))).first()[0] == expected


def test_conversions(spark):
    df = spark.createDataFrame([(" 1.5e2 ",), ("x",), ("",), ("T",), ("9007199254740993",), ("{6BA7B810-9DAD-11D1-80B4-00C04FD430C8}",)], "t string")
    t = F.col("t")
    assert [r[0] for r in df.select(convert.to_number(t)).collect()] == [150.0, None, None, None, 9007199254740993.0, None]
    assert [r[0] for r in df.select(convert.to_bool(t)).collect()] == [True, None, None, True, True, None]
    assert df.select(convert.parse_number(t)["whole"]).collect()[4][0] == 9007199254740993
    assert df.select(convert.to_uuid(t)).collect()[5][0] == "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    assert df.select(convert.base32_encode(F.lit(b"\x00\xff"))).first()[0] == "ad9q"
    assert df.select(convert.base32_decode(F.lit("ad9q"))).first()[0] == bytearray(b"\x00\xff")
    assert df.select(convert.base32_decode(F.lit("A0"))).first()[0] is None


def test_layouts():
    assert ff.layout_pattern("2006-01-02T15:04:05Z07:00") == "yyyy-MM-dd'T'HH:mm:ssXXX" and ff.layout_pattern("02/01/06") == "dd/MM/yy"


def test_tables_read_only_their_folder(spark, sf_dir, tmp_path):
    df, path = e.orders(spark, sf_dir), str(tmp_path / "entities")
    write_entities(df, e.ORDERS, path)
    write_entities(e.customers(spark, sf_dir), e.CUSTOMER, path)
    back = read_entities(spark, e.ORDERS, path)
    assert back.count() == df.count() and all(f"schema_id={e.ORDERS.id}" in f for f in back.inputFiles())
    one = df.first()["row_id"]
    assert get_entity(back, one).count() == 1
    eav = layout.to_eav(df, e.ORDERS).unionByName(layout.to_eav(e.customers(spark, sf_dir), e.CUSTOMER))
    write_layout(eav, str(tmp_path / "eav"))
    orders_only = read_layout(spark, str(tmp_path / "eav"), e.ORDERS.id)
    assert "PartitionFilters: [isnotnull(schema_id" in orders_only._jdf.queryExecution().toString() and orders_only.count() == 7 * df.count()


def test_filters_reach_the_scan(spark, sf_dir):
    from quillstone.operators.conditions import parse
    from quillstone.operators.filters import filter_entities

    found = filter_entities(e.orders(spark, sf_dir), e.ORDERS, parse({"a": "totalprice", "v": "gte:200000"})).select("row_id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_totalprice,200000" in plan and "o_orderpriority" not in plan


def test_change_log_stream(spark, tmp_path):
    log = str(tmp_path / "log")
    kind = "schema_id smallint, row_id string, flushed_at bigint, changed_at bigint, deleted_at bigint"
    spark.createDataFrame([(1, "a", 0, 1, None), (1, "a", 0, 3, None), (1, "b", 0, 2, None)], kind).write.mode("append").parquet(log)
    compact_stream(read_log(spark, log), str(tmp_path / "out")).awaitTermination()
    spark.createDataFrame([(1, "a", 0, 4, 4)], kind).write.mode("append").parquet(log)
    compact_stream(read_log(spark, log), str(tmp_path / "out")).awaitTermination()
    got = {tuple(r) for r in compacted(spark, str(tmp_path / "out")).collect()}
    assert got == {(1, "a", 0, 4, 4), (1, "b", 0, 2, None)}
    assert change_counts(spark.read.schema(kind).parquet(log)).collect()[0]["changes"] == 4

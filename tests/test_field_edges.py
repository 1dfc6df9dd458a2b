from pyspark.sql import functions as F

from quillstone.functions.fields import to_price, to_year


def _applied(spark, transformer, texts):
    field = transformer(F.col("c"))
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    return [(r["v"], r["e"]) for r in df.select(field.value.alias("v"), field.error.alias("e")).collect()]


def test_a_currency_sign_alone_is_no_price_and_no_error(spark):
    assert _applied(spark, to_price(), ["$", "€ ", "$1,200", "Price on request", "$x"]) == [
        (None, None), (None, None), (1200.0, None), (None, None), (None, "invalid price: $x"),
    ]


def test_years_of_many_digits_are_out_of_range(spark):
    found = _applied(spark, to_year(), ["2020", "99999999999", "9" * 40, "1800 (approx)", "unknown", "n/a"])
    assert [v for v, _ in found] == [2020, None, None, None, None, None]
    assert [bool(e) for _, e in found] == [False, True, True, True, False, False]

"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import fresh_name

#: Rows that the table of sources has at most to be broadcast (a name, a weight and a list of thresholds each).
BROADCAST_SOURCES = 10_000


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from the first 52 bits of the MD5 of seed and key; the same key gives the same number."""
    digest = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.coalesce(key.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))


def poisson_thresholds(rate: Column) -> Column:
    """The distribution function of a Poisson variable at 0, 1, ..., far into its tail, as an array.

    Terms are summed from their logarithms, so that large rates don't underflow. A rate of 0 gives [1].
    """
    most = (rate + 12 * F.sqrt(rate) + 24).cast("int")
    start = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("cdf"))

    def step(state: Column, k: Column) -> Column:
        log = state["log"] + F.ln(rate) - F.ln(k.cast("double"))
        total = state["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(state["cdf"], F.array(total)).alias("cdf"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), most), start, step)["cdf"]).otherwise(F.array(F.lit(1.0)))


def source_rates(
    docs: DataFrame, weights: DataFrame | None, source_col: str = "source", epochs: float = 1.0, by_length: str | None = None
) -> DataFrame:
    """Per source: name, weight share, size, `rate` (mean copies of each row) and `cdf`.

    `weights` has columns source and weight; sources without a row weigh nothing, and None weighs all alike. A size
    is the number of rows or, with `by_length`, of characters in that column. The rate is the target share times
    `epochs` times the whole size over the source's size; a source of size 0 keeps its rows as they are.
    """
    size = F.sum(F.coalesce(F.length(by_length), F.lit(0))) if by_length else F.count(F.lit(1))
    sizes = docs.groupBy(F.col(source_col).alias("name")).agg(size.cast("double").alias("size"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.lit(1.0))
    else:
        given = weights.groupBy(F.col("source").alias("given")).agg(F.sum("weight").cast("double").alias("weight"))
        weighed = sizes.join(given, F.col("name").eqNullSafe(F.col("given")), "left").drop("given")
        weighed = weighed.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))
    totals = weighed.agg(F.sum("weight").alias("weights"), F.sum("size").alias("sizes"))
    share = F.coalesce(F.try_divide("weight", "weights"), F.lit(0.0))
    rate = F.when(F.col("size") > 0, share * F.lit(float(epochs)) * F.col("sizes") / F.col("size")).otherwise(1.0)
    rates = weighed.join(F.broadcast(totals), how="cross").withColumn("share", share).withColumn("rate", rate)  # one row
    return rates.select("name", "share", "size", "rate", poisson_thresholds(F.col("rate")).alias("cdf"))


def mix_sources(
    docs: DataFrame,
    weights: DataFrame | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    epochs: float = 1.0,
    seed: int = 42,
    by_length: str | None = None,
) -> DataFrame:
    """Each row of `docs` as often as a Poisson variable with its source's rate says, shuffled globally.

    The variable is drawn by inverting its distribution at a hash of seed and id, so a rerun gives the same rows.
    Columns of `docs` stay, with `copy` (from 0) added in place of any such column. Null sources are one source,
    null ids one id; rows that repeat an id are drawn alike. Texts are not looked at unless `by_length` is set. An
    empty table stays empty. The order of the result is that of a hash of the row and its copy number.
    """
    names = {k: fresh_name(docs, f"mix_{k}") for k in ("source", "cdf", "n", "order")}
    rates = source_rates(docs, weights, source_col, epochs, by_length)
    rates = rates.select(F.col("name").alias(names["source"]), F.col("cdf").alias(names["cdf"]))
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    drawn = docs.drop("copy").join(rates, F.col(source_col).eqNullSafe(F.col(names["source"])))
    copies = F.size(F.filter(names["cdf"], lambda c: c <= uniform(F.col(id_col), seed)))
    drawn = drawn.withColumn(names["n"], copies).where(F.col(names["n"]) > 0).drop(names["cdf"], names["source"])
    copied = drawn.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(names["n"]) - 1))).drop(names["n"])
    # All columns count, so that rows of one id, or of none, don't meet in one task unless they are alike.
    content = [F.col(f"`{c}`") for c, kind in copied.dtypes if "map<" not in kind and kind != "variant"]
    placed = copied.withColumn(names["order"], F.xxhash64(F.lit(seed), *content))
    return placed.repartition(names["order"]).sortWithinPartitions(names["order"]).drop(names["order"])

"""A cube as running totals: spans of any length from two rows a key.

One row a (cell, month): the running sum and count before the month, and those after
each of its days that has values.  The total up to a date is then one equi-join on
(cell, month) and a look at no more than 31 entries of the row it finds, whatever the
span; a span's mean is the difference of two such totals, a baseline's mean that of two to six a
baseline year.  Every cell has a row for each month from its
first to the cube's last, so that a month without values is found too.

The table is bucketed by (cell, month): a link shuffles its keys to the buckets, the cube
stays where it is.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geolink.functions.dates import leap_days, month_day
from geolink.operators.extract import KEY
from geolink.session import shared_dir

#: Rows of a bucket, about, and buckets at most.
BUCKET_ROWS, MOST_BUCKETS = 2_000_000, 4_096


def _month(d: Column) -> Column:
    return F.year(d) * 12 + F.month(d) - 1


@dataclass(frozen=True)
class CumulativeCube:
    """The daily cube it was made of, the table of running totals, its last month."""

    cube: DataFrame
    table: str
    last: int

    def totals(self, keys: DataFrame, names: dict[str, str]) -> DataFrame:
        """``keys`` (ix, iy, on) with the running sum and count up to the date ``on``, under the ``names`` of total and n."""
        spark = keys.sparkSession
        on = keys.withColumn("month", F.least(_month(F.col("on")), F.lit(self.last)))
        # no hint and no size decides: the bucketed side is merged where it lies
        found = on.hint("merge").join(spark.table(self.table), ["ix", "iy", "month"], "left")
        upto = F.filter("days", lambda d: d["date"] <= F.col("on"))
        at = F.when(F.size(upto) > 0, F.element_at(upto, -1)).otherwise(F.struct(F.lit(None).cast("date").alias("date"), F.col("total").alias("total"), F.col("n").alias("n")))
        found = found.select(*keys.columns, at.alias("at"))
        return found.select(*keys.columns, F.coalesce("at.total", F.lit(0.0)).alias(names["total"]), F.coalesce("at.n", F.lit(0)).alias(names["n"]))

    def span_means(self, keys: DataFrame, span: int, out: str = "linked") -> DataFrame:
        """(link_date, ix, iy, out) of distinct keys that have a value in the span."""
        ends = keys.select(*KEY, F.explode(F.array(F.struct(F.col("link_date").alias("on"), F.lit(1).alias("sign")), F.struct(F.date_sub("link_date", span + 1).alias("on"), F.lit(-1).alias("sign")))).alias("e"))
        both = self.totals(ends.select(*KEY, "e.on", "e.sign"), {"total": "sum_", "n": "n_"})
        sums = both.groupBy(*KEY).agg(F.sum(F.col("sign") * F.col("sum_")).alias("s"), F.sum(F.col("sign") * F.col("n_")).alias("n"))
        return sums.where("n > 0").select(*KEY, (F.col("s") / F.col("n")).alias(out))

    def baseline_means(self, keys: DataFrame, first: int, last: int, span: int, out: str = "baseline") -> DataFrame:
        """(link_date, ix, iy, out) over the baseline years' anniversaries of the span's days; 29 February meets leap years only.

        In each year those days are one stretch or, over New Year, two; a 29 February inside one
        that the span doesn't hold is taken out.  Keys of the same days are answered together.
        """
        end, start = F.col("link_date"), F.date_sub("link_date", span)
        leap = leap_days(end) != leap_days(F.date_sub(start, 1))
        a, b = (F.lit("01-01"), F.lit("12-31")) if span >= 365 else (month_day(start), month_day(end))
        sets = ["a", "b", "leap", "ix", "iy"]
        named = keys.select(*KEY, a.alias("a"), b.alias("b"), leap.alias("leap"))
        each = named.select(*sets).distinct().withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last))))
        day = lambda md: F.substring(md, 4, 2).cast("int")
        month = lambda md: F.make_date("year", F.substring(md, 1, 2).cast("int"), F.lit(1))
        before = lambda md: F.struct(F.date_add(month(md), day(md) - 2).alias("on"), F.lit(-1).alias("sign"))
        upto = lambda md: F.struct(F.least(F.date_add(month(md), day(md) - 1), F.last_day(month(md))).alias("on"), F.lit(1).alias("sign"))
        one, a, b = F.col("a") <= F.col("b"), F.col("a"), F.col("b")
        stretches = F.when(one, F.array(before(a), upto(b))).otherwise(F.array(before(a), upto(F.lit("12-31")), before(F.lit("01-01")), upto(b)))
        feb = F.lit("02-29")
        inside = F.when(one, (a <= feb) & (feb <= b)).otherwise((a <= feb) | (feb <= b))
        extra = ~F.col("leap") & inside & (F.dayofyear(F.make_date("year", F.lit(12), F.lit(31))) == 366)
        at = lambda d, sign: F.struct(F.make_date("year", F.lit(2), F.lit(d)).alias("on"), F.lit(sign).alias("sign"))
        ends = F.when(extra, F.concat(stretches, F.array(at(28, 1), F.struct(F.date_add(month(feb), 28).alias("on"), F.lit(-1).alias("sign"))))).otherwise(stretches)
        both = self.totals(each.select(*sets, F.explode(ends).alias("e")).select(*sets, "e.on", "e.sign"), {"total": "sum_", "n": "n_"})
        sums = both.groupBy(*sets).agg(F.sum(F.col("sign") * F.col("sum_")).alias("s"), F.sum(F.col("sign") * F.col("n_")).alias("n")).where("n > 0")
        return named.join(sums, sets).select(*KEY, (F.col("s") / F.col("n")).alias(out))


def accumulate(cube: DataFrame, name: str | None = None) -> CumulativeCube:
    """Write the running totals of a daily cube as a bucketed table (in the shared folder) and return a handle to it."""
    spark: SparkSession = cube.sparkSession
    name = name or f"cumulative_{uuid.uuid4().hex}"
    daily = cube.groupBy("ix", "iy", "obs_date").agg(F.sum("value").alias("v"), F.count("value").alias("k")).where("k > 0")
    months = daily.groupBy("ix", "iy", _month(F.col("obs_date")).alias("month")).agg(F.sum("v").alias("v"), F.sum("k").alias("k"), F.array_sort(F.collect_list(F.struct("obs_date", "v", "k"))).alias("own"))
    last = cube.agg(F.max(_month(F.col("obs_date"))).alias("m")).first()["m"]
    # a cell's months, not its days, are what one window holds
    row = W.partitionBy("ix", "iy").orderBy("month")
    before = row.rowsBetween(W.unboundedPreceding, -1)
    run = months.select("ix", "iy", "month", "own", F.coalesce(F.sum("v").over(before), F.lit(0.0)).alias("total"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("n"), F.col("v"), F.col("k"), F.lead("month").over(row).alias("next"))
    step = lambda a, d: F.struct(
        F.concat(a["days"], F.array(F.struct(d["obs_date"].alias("date"), (a["total"] + d["v"]).alias("total"), (a["n"] + d["k"]).alias("n")))).alias("days"), (a["total"] + d["v"]).alias("total"), (a["n"] + d["k"]).alias("n")
    )
    none = F.array().cast("array<struct<date:date,total:double,n:bigint>>")
    days = F.aggregate("own", F.struct(none.alias("days"), F.col("total").alias("total"), F.col("n").alias("n")), step, lambda a: a["days"])
    own = run.select("ix", "iy", "month", "total", "n", days.alias("days"), "v", "k", "next")
    gap = own.where(F.coalesce("next", F.lit((last or 0) + 1)) > F.col("month") + 1)
    gap = gap.select("ix", "iy", F.explode(F.sequence(F.col("month") + 1, F.coalesce("next", F.lit((last or 0) + 1)) - 1)).alias("month"), (F.col("total") + F.col("v")).alias("total"), (F.col("n") + F.col("k")).alias("n"), none.alias("days"))
    every = own.select("ix", "iy", "month", "total", "n", "days").unionByName(gap)
    written = f"{shared_dir(spark)}/{name}-rows"
    every.write.parquet(written)
    rows = spark.read.parquet(written)
    buckets = max(1, min(MOST_BUCKETS, rows.count() // BUCKET_ROWS + int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # dealt out as the buckets are, so each is one file
    rows.repartition(buckets, "ix", "iy", "month").write.bucketBy(buckets, "ix", "iy", "month").sortBy("ix", "iy", "month").option("path", f"{shared_dir(spark)}/{name}").mode("overwrite").saveAsTable(name)
    return CumulativeCube(cube, name, last or 0)

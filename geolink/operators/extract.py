"""Linking observations to a cube: which cells, which dates, then means over time and space.

Values belong to (date, cell), not to observations: the distinct (link date, cell)
keys of all observations are formed first, each gets its means once, and one
equi-join brings them home.  No observation id is needed, so null and repeated ids
and any number of rows a cell and date in the cube leave the row count as it is.
The caller's columns travel as one struct, so their names meet none of these.

* Cells are arithmetic; a span is a RANGE frame over one cell's history, so a key
  costs one row however long the span is.
* A baseline meets a climatology: sums and counts per (day of the year, cell).
* Places of several cells are runs of columns (``operators.cover``).  Means over time are summed
  up along each (date, row of cells), and a run's sum is the difference of two of
  those sums: two rows a run are shuffled, not one a cell.

Unmatched observations keep their row with NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geolink.functions.dates import leap_days, month_day, span_dates, span_start

KEY = ["link_date", "ix", "iy"]


def point_link(obs: DataFrame, cube: DataFrame, cell: Column, date: Column, out: str = "linked") -> DataFrame:
    """One left join to a cube that holds one row a cell and date: the value of the containing cell on the exact date."""
    right = cube.select(F.col("obs_date").alias("_d"), F.col("ix").alias("_ix"), F.col("iy").alias("_iy"), F.col("value").alias(out))
    keyed = obs.withColumn("_cell", cell).withColumn("_date", date)
    joined = keyed.join(right, (F.col("_date") == F.col("_d")) & (F.col("_cell.ix") == F.col("_ix")) & (F.col("_cell.iy") == F.col("_iy")), "left")
    return joined.drop("_cell", "_date", "_d", "_ix", "_iy")


def _order(date: Column, grain: str) -> Column:
    return F.unix_date(date) if grain == "day" else F.year(date) * 12 + F.month(date)


def span_means(keys: DataFrame, cube: DataFrame, span: int = 0, grain: str = "day", out: str = "linked") -> DataFrame:
    """(link_date, ix, iy, out) of distinct keys that have a value: the mean of all rows in the span, missing values skipped."""
    rows = cube.select("obs_date", "ix", "iy", "value")
    if span == 0:
        hit = rows.withColumnRenamed("obs_date", "link_date").join(keys, KEY)
        return hit.groupBy(*KEY).agg(F.avg("value").alias(out))
    near = rows.join(keys.select("ix", "iy").distinct(), ["ix", "iy"], "left_semi")
    daily = near.groupBy("obs_date", "ix", "iy").agg(F.sum("value").alias("total"), F.count("value").alias("n"))
    events = daily.withColumn("key", F.lit(False)).unionByName(
        keys.select(F.col("link_date").alias("obs_date"), "ix", "iy", F.lit(None).cast("double").alias("total"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("key"))
    )
    frame = W.partitionBy("ix", "iy").orderBy(_order(F.col("obs_date"), grain)).rangeBetween(-span, 0)
    over = events.withColumn(out, F.try_divide(F.sum("total").over(frame), F.sum("n").over(frame)))
    return over.where(F.col("key") & F.col(out).isNotNull()).select(F.col("obs_date").alias("link_date"), "ix", "iy", out)


def climatology(cube: DataFrame, first: int, last: int, grain: str = "day") -> DataFrame:
    """(md, ix, iy, total, n): sums over the baseline years for each day (or month) of the year and cell."""
    key = F.col("md") if grain == "day" else F.substring("md", 1, 2).alias("md")
    rows = cube.where(F.col("year").between(first, last))
    return rows.groupBy(key, "ix", "iy").agg(F.sum("value").alias("total"), F.count("value").alias("n"))


def baseline_means(keys: DataFrame, cube: DataFrame, first: int, last: int, span: int = 0, grain: str = "day", out: str = "baseline") -> DataFrame:
    """(link_date, ix, iy, out) over all baseline years' anniversaries of the span's days (months).

    29 February meets leap years only.  Keys whose spans hold the same days of the
    year are answered together, so a span is written out once for each day of the
    year and cell, not for each date.
    """
    of = (lambda d: month_day(d)) if grain == "day" else (lambda d: F.date_format(d, "MM"))
    clim = climatology(cube, first, last, grain)
    start, end = span_start(F.col("link_date"), span, grain), F.col("link_date")
    if span == 0:
        return keys.withColumn("md", of(end)).join(clim, ["md", "ix", "iy"]).select(*KEY, F.try_divide("total", "n").alias(out))
    # equal first and last day and the same answer on 29 February make equal sets of days
    leap = leap_days(end) != leap_days(F.date_sub(start, 1))
    sets = ["a", "b", "leap", "ix", "iy"]
    named = keys.select(*KEY, of(start).alias("a"), of(end).alias("b"), leap.alias("leap"))
    days = named.groupBy(*sets).agg(F.min("link_date").alias("d")).select(*sets, F.explode(F.array_distinct(F.transform(span_dates(F.col("d"), span, grain), of))).alias("md"))
    means = days.join(clim, ["md", "ix", "iy"]).groupBy(*sets).agg(F.try_divide(F.sum("total"), F.sum("n")).alias(out))
    return named.join(means, sets).select(*KEY, out)


def wrapped(obs: DataFrame, names: list[str], **columns: Column) -> DataFrame:
    """The caller's row as the struct ``row``, beside further columns; columns called like a result go."""
    kept = obs.drop(*names)
    return obs.select((F.struct(*[kept[f"`{c}`"] for c in kept.columns]) if kept.columns else F.lit(None)).alias("row"), *[c.alias(k) for k, c in columns.items()])


def _means(keys: DataFrame, measures: list) -> DataFrame:
    """Keys with one column a measure, where any has a value."""
    parts = [f(keys) for _, f in measures]
    means = parts[0]
    for more in parts[1:]:
        means = means.join(more, KEY, "full")
    return means


def link_cells(at: DataFrame, measures: list) -> DataFrame:
    """Rows (``row``, ``date``, ``cell``) as the caller's columns and one for each of ``measures``, (name, function of distinct keys to their means)."""
    names = [name for name, _ in measures]
    # an outer explode of one: conditions on a cell stop there instead of copying its formula
    at = at.select("row", "date", F.explode_outer(F.array("cell")).alias("cell")).select("row", "date", F.col("cell.ix").alias("x"), F.col("cell.iy").alias("y"))
    keys = at.select(F.col("date").alias("link_date"), F.col("x").alias("ix"), F.col("y").alias("iy")).where("link_date is not null and ix is not null").distinct()
    means = _means(keys, measures)
    home = (F.col("date") == F.col("link_date")) & (F.col("x") == F.col("ix")) & (F.col("y") == F.col("iy"))
    return at.join(means, home, "left").select("row.*", *names)


#: Columns of cells that are asked for together where a run touches one of them.
TILE = 32


def link_runs(at: DataFrame, runs: DataFrame, place: list[str], measures: list) -> DataFrame:
    """As ``link_cells``, for rows (``row``, ``date``, ``place``) whose places cover ``runs`` (place, iy, i0, i1, own).

    Means over time are averaged over the cells of each distinct date and place; the
    own cell counts where a place has no other.
    """
    names = [name for name, _ in measures]
    # dealt first: a partial aggregate would hold all pairs of a split, and few of them repeat in it
    pairs = at.select("date", *place).where("date is not null").repartition("date", *place).distinct()
    rows = pairs.join(runs, place)
    tiles = rows.select("date", "iy", "i0", "i1", F.explode(F.sequence(F.floor(F.col("i0") / TILE), F.floor(F.col("i1") / TILE))).alias("tile"))
    tiles = tiles.groupBy("date", "iy", "tile").agg(F.min(F.greatest("i0", F.col("tile") * TILE)).alias("lo"), F.max(F.least("i1", F.col("tile") * TILE + TILE - 1)).alias("hi"))
    keys = tiles.select(F.col("date").alias("link_date"), F.explode(F.sequence(F.col("lo").cast("int"), F.col("hi").cast("int"))).alias("ix"), "iy")
    means = _means(keys, measures)
    ends = F.array(F.struct((F.col("i0") - 1).alias("ix"), F.lit(-1).alias("sign")), F.struct(F.col("i1").alias("ix"), F.lit(1).alias("sign")))
    ends = rows.select("date", *place, "own", "iy", F.explode(ends).alias("end")).select("date", *place, "own", "iy", "end.ix", "end.sign")
    spots = ends.select(F.col("date").alias("link_date"), "ix", "iy").distinct()
    both = means.withColumn("spot", F.lit(False)).unionByName(spots.withColumn("spot", F.lit(True)), allowMissingColumns=True)
    along = W.partitionBy("link_date", "iy").orderBy("ix", "spot").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = [x for n in names for x in (F.coalesce(F.sum(n).over(along), F.lit(0.0)).alias(f"{n}_sum"), F.count(n).over(along).alias(f"{n}_n"))]
    sums = both.select(F.col("link_date").alias("date"), "iy", "ix", "spot", *sums).where("spot").drop("spot")
    own = lambda c, is_own: F.sum(F.when(F.col("own") == is_own, F.col("sign") * F.col(c)))
    wide = ends.join(sums, ["date", "iy", "ix"]).repartition("date", *place).groupBy("date", *place).agg(
        F.bool_or(~F.col("own")).alias("other"), *[own(f"{n}_{part}", is_own).alias(f"{n}_{part}_{is_own}") for n in names for part in ("sum", "n") for is_own in (False, True)]
    )
    mean = lambda n, is_own: F.try_divide(F.when(F.col(f"{n}_n_{is_own}") > 0, F.col(f"{n}_sum_{is_own}")), F.col(f"{n}_n_{is_own}"))
    wide = wide.select(*[F.col(k).alias(f"_{k}") for k in ("date", *place)], *[F.when(F.col("other"), mean(n, False)).otherwise(mean(n, True)).alias(n) for n in names])
    home = [F.col(k) == F.col(f"_{k}") for k in ("date", *place)]
    return at.join(wide, home, "left").select("row.*", *names)


def deviation(df: DataFrame) -> DataFrame:
    return df.withColumn("deviation", F.col("linked") - F.col("baseline"))


def span_window(cube: DataFrame, span: int, out: str = "mean") -> DataFrame:
    """Trailing mean per cell and date over a calendar RANGE of days: for dense cubes linked many times."""
    frame = W.partitionBy("ix", "iy").orderBy(F.unix_date("obs_date")).rangeBetween(-span, 0)
    return cube.withColumn(out, F.avg("value").over(frame))

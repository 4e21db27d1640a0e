"""Operator 1: mix sources to target weights (native DataFrame operations only).

Every document gets an Efraimidis-Spirakis key ``-ln(u) / quality``; sorted by
that key within its source, documents are taken until the source's token budget
is used up.  Complete epochs (every document once) come before the fractional
selection.

No sort of a whole source: quantile sketches cut the keys into buckets, sums per
bucket give the one in which a source's budget ends, and that bucket is cut again
until it holds few rows, which alone are ordered.  Keys come from id and text, so
missing and repeated ids spread like others; rows that agree in both are told apart
by a number, which cuts even a group of copies that makes up a source.

Defined results
    null text           size 0
    null source         a source of its own, after all others
    null id             an ordinary id (hashed as the empty string, with the text)
    ties, repeated rows equal rows get equal keys; which of them is taken makes no difference
    empty table         no rows
    size-0 documents    ``taken`` 0; they cost nothing and follow their key
    a source of size 0  target 0
    extra columns       carried along untouched; the operator's own columns start with ``_mix_``
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geolink.llm.common import Scratch, keeping, small, table, text_or_empty, unit_hash, word_count

#: Characters that lower a document's quality weight.
SYMBOLS = "#*$%&|<>!"
WEIGHTS = (5, 2, 1)
#: Most rows that are ordered by one task, and buckets that a round cuts a source's open interval into.
BUCKET_ROWS, CUTS = 2_000, 256


def quality_weight(text: Column) -> Column:
    """Quality in thousandths, 50 to 1000: each percent of symbols costs 50."""
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.when(F.length(text) == 0, F.lit(50)).otherwise(
        F.greatest(F.lit(50), F.lit(1000) - F.floor(F.lit(5000) * symbols / F.length(text)))
    ).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), cap: int = 2) -> DataFrame:
    """Token target per source from (source, source_size): ``share`` of all tokens, split by weight.

    ``weights`` repeat over the sources in code point order (null last).  A target
    stops at ``cap`` times its source's size and the excess is shared again by
    weight until none is above: the sources that stop are those with the smallest
    size per weight, so one ordered pass finds the level.  One row per source:
    sources are assumed to number far fewer than documents.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(cycle, (F.row_number().over(order) - 1) % len(weights) + 1).cast("long"))
    level = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = level.rowsBetween(W.unboundedPreceding, -1)
    after = level.rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy()
    # shared: tokens left for this source and all later ones, if every earlier one stopped at its cap
    measured = (
        ranked.withColumn("total", F.sum("source_size").over(whole))
        .withColumn("capped", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap)
        .withColumn("weight_left", F.sum("weight").over(after))
        .withColumn("place", F.row_number().over(level))
    )
    left = F.lit(share[0]) * F.col("total") - F.lit(share[1]) * F.col("capped")
    fits = left * F.col("weight") <= F.lit(share[1] * cap) * F.col("source_size") * F.col("weight_left")
    found = measured.withColumn("left", left).withColumn("fits", fits)
    # the first source that fits sets the level for itself and all after it
    first = F.min(F.when(F.col("fits"), F.struct("place", "left", "weight_left"))).over(whole)
    at = F.max(F.col("fits")).over(level.rowsBetween(W.unboundedPreceding, 0))
    found = found.withColumn("first", first).withColumn("open", at)
    target = F.when(F.col("open"), F.col("first.left") * F.col("weight") / (F.lit(share[1]) * F.col("first.weight_left"))).otherwise(
        F.lit(cap) * F.col("source_size")
    )
    return found.select("source", "source_size", "weight", target.cast("double").alias("target"))


@keeping
def mix(docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Take each document 0, 1 or 2 times so that sources come near their targets.

    Returns one row per input row: ``doc_id, source, size, source_size, target,
    copies, taken`` and the columns named in ``keep``.
    """
    text = text_or_empty(text_col)
    key_of = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text.cast("binary")), F.lit(f":{seed}"))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"),
        quality_weight(text).alias("_mix_quality"), unit_hash(key_of).alias("_mix_unit"), *keep,
    )
    # the number tells copies apart: written once, it stays
    rows = scratch.keep(rows.withColumn("_mix_number", F.xxhash64(F.monotonically_increasing_id(), "_mix_unit")), "rows")
    rows = rows.withColumn("_mix_key", -F.log("_mix_unit") * 1000 / F.col("_mix_quality")).withColumn("_mix_tie", F.col("_mix_number").cast("double"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = scratch.keep(targets(sizes), "targets")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(1).cast("long")
    goal = goal.select(F.col("source").alias("_mix_source"), "source_size", "target", epochs.alias("epochs")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    ends = open_interval(rows.select("source", "size", "_mix_key", "_mix_tie"), goal.select("_mix_source", "rest"), scratch)
    placed = rows.join(small(goal.join(ends.drop("rest"), F.col("_mix_source").eqNullSafe(F.col("_end_source"))).drop("_end_source")), F.col("source").eqNullSafe(F.col("_mix_source")))

    at = F.struct("_mix_key", "_mix_tie")
    inside = (at > F.col("low")) & (at <= F.col("high"))
    ordered = W.partitionBy("_mix_source").orderBy("_mix_key", "doc_id", "size", "_mix_tie").rowsBetween(W.unboundedPreceding, -1)
    last = placed.where(inside).withColumn("_mix_at", F.col("before") + F.coalesce(F.sum("size").over(ordered), F.lit(0)))
    last = last.withColumn("_mix_take", (2 * F.col("_mix_at") + F.col("size") <= 2 * F.col("rest")).cast("long"))
    others = placed.where(~inside).withColumn("_mix_take", (at <= F.col("low")).cast("long"))
    both = last.drop("_mix_at").unionByName(others).withColumn("copies", F.least(F.col("epochs") + F.col("_mix_take"), F.lit(2)))
    return both.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), *keep)


def open_interval(rows: DataFrame, goal: DataFrame, scratch: Scratch) -> DataFrame:
    """Per source (``_end_source, low, high, before``): the interval of (key, tie) in which its budget ends.

    ``before``: tokens up to ``low``.  Each round cuts every interval of more than
    ``BUCKET_ROWS`` rows at sketched quantiles of the key or, once it holds a single
    key, of the tie.  One row a source.
    """
    edge = lambda x: F.struct(F.lit(x).alias("_mix_key"), F.lit(x).alias("_mix_tie"))
    infinite = float("inf")
    ends = goal.select(F.col("_mix_source").alias("_end_source"), "rest", edge(-infinite).alias("low"), edge(infinite).alias("high"), F.lit(0).cast("long").alias("before"))
    at, step = F.struct("_mix_key", "_mix_tie"), 0
    same = F.col("source").eqNullSafe(F.col("_end_source"))
    while True:
        step += 1
        ends = scratch.keep(ends, f"ends-{step}")
        inside = rows.join(small(ends), same).where((at > F.col("low")) & (at <= F.col("high")))
        cuts = inside.groupBy("_end_source").agg(
            F.count(F.lit(1)).alias("n"), F.min("_mix_key").alias("k0"), F.max("_mix_key").alias("k1"),
            *[F.array_distinct(F.percentile_approx(c, [i / CUTS for i in range(1, CUTS)], 20 * CUTS)).alias(q) for c, q in (("_mix_key", "keys"), ("_mix_tie", "ties"))],
        )
        cuts = scratch.keep(cuts.where(F.col("n") > BUCKET_ROWS), f"cuts-{step}").withColumnRenamed("_end_source", "_cut_source")
        if not cuts.limit(1).count():
            return ends
        # below and above each quantile, so that the rows of one frequent key end up alone
        by_key = F.flatten(F.transform("keys", lambda x: F.array(*[F.struct(x.alias("_mix_key"), F.lit(e).alias("_mix_tie")) for e in (-infinite, infinite)])))
        by_tie = F.transform("ties", lambda x: F.struct(F.col("k0").alias("_mix_key"), x.alias("_mix_tie")))
        cuts = cuts.select("_cut_source", F.when(F.col("k0") < F.col("k1"), by_key).otherwise(by_tie).alias("cuts"))
        cut = inside.join(small(cuts), F.col("_end_source").eqNullSafe(F.col("_cut_source")))
        # the bucket's upper edge is its name: the smallest cut not below the row
        upper = F.coalesce(F.array_min(F.filter("cuts", lambda x: x >= at)), F.col("high"))
        sums = cut.groupBy("_cut_source", upper.alias("upper")).agg(F.sum("size").alias("tokens"), F.min("low").alias("low"), F.min("before").alias("before"), F.min("rest").alias("rest"))
        order = W.partitionBy("_cut_source").orderBy("upper")
        sums = sums.withColumn("until", F.col("before") + F.coalesce(F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        sums = sums.withColumn("under", F.coalesce(F.lag("upper").over(order), F.col("low")))
        found = sums.where(F.col("until") <= F.col("rest")).groupBy("_cut_source").agg(F.max(F.struct("upper", "under", "until")).alias("x"))
        moved = ends.join(small(found), F.col("_end_source").eqNullSafe(F.col("_cut_source")), "left")
        ends = moved.select("_end_source", "rest", F.coalesce("x.under", "low").alias("low"), F.coalesce("x.upper", "high").alias("high"), F.coalesce("x.until", "before").alias("before"))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"), Scratch(spark, "op1"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM documents
), r AS (
  SELECT doc_id, source, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    CASE WHEN t = '' THEN 50 ELSE greatest(50, 1000 - floor(5000 * (length(t) - length(translate(t, '#*$%&|<>!', ''))) / length(t))) END::BIGINT AS quality,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(t) || ':0'), 1, 13))::BIGINT + 1) / (power(2, 52) + 1) AS unit
  FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM r GROUP BY source
), m AS (
  SELECT *, sum(source_size) OVER () AS total,
    2 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left,
    row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS place
  FROM s
), lev AS (
  SELECT (3 * total - 2 * capped)::BIGINT AS left_over, weight_left::BIGINT AS weight_left, place FROM m
  WHERE (3 * total - 2 * capped) * weight <= 4 * source_size * weight_left ORDER BY place LIMIT 1
), g AS (
  SELECT m.source, m.source_size,
    CASE WHEN m.place >= (SELECT place FROM lev) THEN ((SELECT left_over FROM lev) * m.weight)::DOUBLE / (2 * (SELECT weight_left FROM lev))
      ELSE (2 * m.source_size)::DOUBLE END AS target
  FROM m
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 1 END::BIGINT AS epochs FROM g
), k AS (
  SELECT r.doc_id, r.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
    coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY -ln(unit) * 1000 / quality, r.doc_id, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM r JOIN e ON r.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target,
  (size * least(2, epochs + CASE WHEN 2 * before + size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM k
"""

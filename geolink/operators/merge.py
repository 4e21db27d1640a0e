"""Merges and small aggregates that have rules of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def left_merge(x: DataFrame, y: DataFrame, x_key: str, y_key: str, x_order: str, y_order: str) -> DataFrame:
    """Only the first x row of a key gets values, from the last y row of that key; NULL keys match each other.

    Same-named columns of x are replaced.  Both sides reduce to one row per key by
    partial aggregation; the join carries x's unique order, so no key is hot.
    """
    cols = [c for c in y.columns if c not in (y_key, y_order)]
    last = y.groupBy(F.col(y_key).alias("_yk")).agg(F.max_by(F.struct(*cols), F.col(y_order)).alias("_v"))
    first = x.groupBy(F.col(x_key).alias("_xk")).agg(F.min(x_order).alias("_first"))
    chosen = first.join(last, F.col("_xk").eqNullSafe(F.col("_yk"))).select("_first", "_v")
    kept = x.select(*[c for c in x.columns if c not in cols])
    joined = kept.join(chosen, F.col(x_order) == F.col("_first"), "left")
    return joined.select(*[c for c in kept.columns], *[F.col(f"_v.{c}").alias(c) for c in cols])


def psum(*columns: Column) -> Column:
    """Row sum that skips NULLs; NULL if all are NULL."""
    some = F.coalesce(*columns).isNotNull()
    total = F.lit(0)
    for c in columns:
        total = total + F.coalesce(c, F.lit(0))
    return F.when(some, total)


def all_true(condition: Column) -> Column:
    """Aggregate: every row meets the condition (a NULL does not)."""
    return F.bool_and(F.coalesce(condition, F.lit(False)))

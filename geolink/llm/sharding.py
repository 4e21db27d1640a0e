"""Operator 2: rendezvous (highest-random-weight) sharding (native DataFrame operations only).

A record's shard is the one with the highest score ``-weight / ln(u)``, where
``u`` hashes record key and shard number.  A further shard can only win records
for itself, so growing from n to n + 1 shards moves about 1 / (n + 1) of them and
none between old shards.  The law is ``key``: id and shard count alone decide.

Slots number a shard's records without gaps, in the order of a hash of id and text.
Each shard is cut into ranges of that hash whose counts give offsets, so no task
numbers a whole shard; a range that many copies of one record fill is cut by record
and, within a record, by a number that tells its copies apart.

Defined results
    null text      size 1 (no bytes), CRC-32 of the empty string, 0
    null id        an ordinary key; all null ids share a shard
    repeated rows  share a shard, each with its own slot; they take consecutive slots, in any order
    empty table    no rows
    extra columns  those named in ``keep`` are carried along
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geolink.llm.common import Scratch, keeping, small, table, text_or_empty

SHARDS = 16
#: Rows numbered by one task at once, about.
SLOT_ROWS = 2_000


def shard_of(key: Column, shards: int, weights: tuple[float, ...] | None = None) -> Column:
    """The winning shard among ``shards`` (weights 1 each unless given; weight 0 takes nothing)."""
    weights = weights or (1.0,) * shards
    scores = []
    for s in range(shards):
        digest = F.md5(F.concat(key, F.lit(f":{s}")).cast("binary"))
        unit = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 1) / F.lit(float(2**52 + 1))
        scores.append(F.struct((F.lit(float(weights[s])) / -F.log(unit)).alias("score"), F.lit(s).alias("shard")))
    best = scores[0] if shards == 1 else F.greatest(*scores)
    return best["shard"].cast("int")


@keeping
def assign(docs: DataFrame, scratch: Scratch, *, shards: int = SHARDS, weights: tuple[float, ...] | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Shard every row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard`` and ``keep``.

    ``weights`` has one weight per shard and, last, that of the shard to come.
    """
    text = text_or_empty(text_col)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_of(key, shards, weights and weights[:shards]).alias("shard"), shard_of(key, shards + 1, weights).alias("grown_shard"),
        F.md5(F.concat(key, F.lit(":"), F.md5(text.cast("binary"))).cast("binary")).alias("_place"), *keep,
    )
    rows = scratch.keep(rows.withColumn("_number", F.xxhash64(F.monotonically_increasing_id())), "rows")
    ranges = max(1, rows.count() // (shards * SLOT_ROWS))
    part = F.floor(F.conv(F.substring("_place", 1, 8), 16, 10).cast("long") * ranges / F.lit(float(1 << 32))).cast("long")
    rows = rows.withColumn("_range", part)
    full = rows.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * SLOT_ROWS)
    full = small(scratch.keep(full.select(F.col("shard").alias("_shard"), F.col("_range").alias("_at"), F.ceil(F.col("n") / SLOT_ROWS).alias("_cuts")), "full"))
    rows = rows.join(full, (F.col("shard") == F.col("_shard")) & (F.col("_range") == F.col("_at")), "left").drop("_shard", "_at")
    hot = F.col("_cuts").isNotNull()
    # range, then record and number within a full range
    sub = F.struct("_range", F.when(hot, F.col("_place")).otherwise("").alias("place"), F.when(hot, F.pmod("_number", F.col("_cuts"))).otherwise(F.lit(0)).alias("cut"))
    rows = rows.withColumn("_sub", sub)
    counts = rows.groupBy("shard", "_sub").agg(F.count(F.lit(1)).alias("n"))
    running = W.partitionBy("shard").orderBy("_sub").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(F.col("shard").alias("_shard"), F.col("_sub").alias("_at"), F.coalesce(F.sum("n").over(running), F.lit(0)).alias("_offset"))
    offsets = small(scratch.keep(offsets, "offsets"))
    numbered = rows.withColumn("_nth", F.row_number().over(W.partitionBy("shard", "_sub").orderBy("_place", "_number")))
    out = numbered.join(offsets, (F.col("shard") == F.col("_shard")) & (F.col("_sub") == F.col("_at")))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("_offset") + F.col("_nth") - 1).cast("long").alias("slot"), "grown_shard", *keep,
    )


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents over shards 0 to 15 under the law ``key``."""
    return assign(table(spark, sf_dir, "documents"), Scratch(spark, "op2"))


def _crc_of_nibble(c: int) -> int:
    for _ in range(4):
        c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
    return c


_NIBBLES = [_crc_of_nibble(i) for i in range(16)]

def _step(c: str, z: str) -> str:
    return f"xor({_NIBBLES}[xor({c} % 16, {z}) + 1], {c} // 16)"


#: CRC-32 goes by half bytes, the low one first.
SQL = r"""
WITH s AS (SELECT range::INTEGER AS shard FROM range(17)),
r AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), h AS (
  SELECT rid, shard, 1.0::DOUBLE / -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || shard), 1, 13))::BIGINT + 1) / (power(2, 52) + 1)) AS score FROM r CROSS JOIN s
), w AS (
  SELECT rid, max_by(shard, {'s': score, 'n': shard}) FILTER (shard < 16) AS shard, max_by(shard, {'s': score, 'n': shard}) AS grown_shard FROM h GROUP BY rid
), b AS (
  SELECT rid, hex(encode(t)) AS x FROM r
), c AS (
  SELECT rid, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(x, '..'), lambda z: ('0x' || z)::BIGINT)), lambda c, z: HIGH)) AS text_crc32 FROM b
)
SELECT doc_id, strlen(t)::BIGINT + 1 AS size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(t))) - 1 AS slot, grown_shard
FROM r JOIN w USING (rid) JOIN c USING (rid)
""".replace("HIGH", _step(_step("c", "z % 16"), "z // 16"))

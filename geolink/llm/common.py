"""Shared helpers: word expressions, tables in the shared folder, size-checked broadcasts."""

from __future__ import annotations

import ctypes
import functools
import inspect
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geolink.session import shared_dir

#: White space that ends a word, as characters and as a Java/RE2 class body.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"\x20\x09-\x0D"
#: A side of a join is broadcast up to this many rows; beyond it Spark shuffles.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def word_list(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, as an array (empty for a blank text)."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE_CLASS}]+"))


def word_count(text: Column) -> Column:
    return F.size(word_list(text)).cast("long")


class Scratch:
    """Tables written to the shared folder to cut lineage; an executor's loss costs no recomputation.

    ``keep`` writes and rereads a DataFrame, ``drop`` deletes one that nothing
    reads any more.  What is left when the session ends stays for the folder's
    owner to expire, as checkpoints do.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        df.write.mode("overwrite").options(**options).parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def carried(df: DataFrame, keep: tuple[str, ...], results: tuple[str, ...]) -> list[Column]:
    """The caller's columns as one struct ``_kept``, so that their names meet no helper's; a result's name is refused."""
    taken = {r.lower() for r in results}
    if clash := [k for k in keep if k.lower() in taken]:
        raise ValueError(f"kept columns have names of results: {', '.join(clash)}; rename them first")
    return [F.struct(*[F.col(f"`{k}`") for k in keep]).alias("_kept")] if keep else []


def keeping(f):
    """For operators with ``keep``: kept columns go under names of their own and get theirs back at the end.

    So a caller's column meets no helper's name; one called like a result is refused.
    """
    default = inspect.signature(f).parameters["keep"].default

    @functools.wraps(f)
    def run(df: DataFrame, *args, keep: tuple[str, ...] = default, **options):
        if not keep:
            return f(df, *args, keep=(), **options)
        own = {f"_keep{i}": name for i, name in enumerate(keep)}
        out = f(df.withColumns({k: df[f"`{name}`"] for k, name in own.items()}), *args, keep=tuple(own), **options)
        results = {c.lower() for c in out.columns if c not in own}
        if clash := [name for name in keep if name.lower() in results]:
            raise ValueError(f"kept columns have names of results: {', '.join(clash)}; rename them first")
        return out.withColumnsRenamed(own)

    return run


#: Bytes of an Arrow batch on its way to a worker, and Spark's own bound.
BATCH_BYTES, _SPARKS = 8 << 20, "67108864b"


def bounded_batches(spark: SparkSession) -> None:
    """From now on rows go to the session's workers in Arrow batches of ``BATCH_BYTES``, unless it has a bound of its own.

    Spark's is 64 MB; executor and worker hold a few batches a task at once.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, _SPARKS) == _SPARKS:
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Return to the system what this process has freed; numpy's and Arrow's allocators hold on to it.

    Spark keeps a worker for later stages, which would carry the largest arrays of all stages before them.
    """
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def lean(f):
    """For functions of batches, of a group or of two: what they have freed is given back when they end."""

    def batched(batches):
        yield from f(batches)
        give_back()

    def single(group):
        out = f(group)
        give_back()
        return out

    def double(left, right):
        out = f(left, right)
        give_back()
        return out

    if inspect.isgeneratorfunction(f):
        return batched
    return single if len(inspect.signature(f).parameters) == 1 else double


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark for broadcast if the table, counted now, is within the bound; else leave the join to AQE.

    Meant for tables that are already written (cheap to count).
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Bits of a sieve: 4 MB, whatever it holds.
SIEVE_BITS = 1 << 25


def _sieved(big: DataFrame, key: str, wanted: DataFrame, wanted_key: str, how: str):
    """``big`` joined with the filter of the wanted keys, and whether a row's bit is set."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(SIEVE_BITS)) + 1
    at = wanted.select(place(F.col(wanted_key)).alias("_p"))
    bits = at.groupBy(F.bitmap_bucket_number("_p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_bits"))
    rows = big.withColumn("_p", place(F.col(key))).withColumn("_at", F.bitmap_bit_position("_p"))
    rows = rows.join(F.broadcast(bits), F.bitmap_bucket_number("_p") == F.col("_bucket"), how)
    byte = F.conv(F.hex(F.substr("_bits", (F.floor(F.col("_at") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return rows, F.pmod(F.floor(byte / F.pow(F.lit(2), F.col("_at") % 8)), F.lit(2)) == 1


def sieve(big: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """Rows of ``big`` whose key may be among ``wanted``'s: a one-hash Bloom filter of fixed size.

    The filter is broadcast as 32,768-bit rows, so a big side loses most of its
    unwanted rows before a shuffle join decides exactly.  With more keys than bits
    it passes everything, which costs the shuffle and no row.
    """
    rows, hit = _sieved(big, key, wanted, wanted_key, "inner")
    return rows.where(hit).select(*big.columns)


def sieve_marked(big: DataFrame, key: str, wanted: DataFrame, wanted_key: str, name: str) -> DataFrame:
    """All rows of ``big`` with the column ``name``: whether the key may be among ``wanted``'s."""
    rows, hit = _sieved(big, key, wanted, wanted_key, "left")
    return rows.select(*big.columns, F.coalesce(hit, F.lit(False)).alias(name))


def text_bytes(df: DataFrame, col: str) -> int:
    """UTF-8 bytes of a text column, to size hash buckets by."""
    return int(df.agg(F.sum(F.octet_length(col))).first()[0] or 0)


def unit_hash(key: Column) -> Column:
    """A uniform number in (0, 1) from the md5 of a string: any engine can repeat it."""
    digits = F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long")
    return (digits + F.lit(1)) / F.lit(float(2**52 + 1))

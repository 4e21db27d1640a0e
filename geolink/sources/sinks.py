"""Results and cubes to files."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolink.functions.text import clean_tags
from geolink.session import shared_dir


def write_result(df: DataFrame, path: str, tags: dict[str, str] | None = None) -> None:
    """Parquet with metadata tags (those of plain words) beside it, as one JSON line."""
    df.write.mode("overwrite").parquet(path)
    if tags:
        spark = df.sparkSession
        spark.createDataFrame([(tags,)], "tags map<string,string>").select(clean_tags(F.col("tags")).alias("tags")).coalesce(1).write.mode("overwrite").json(f"{path}.tags")


@contextlib.contextmanager
def temporary_cube(df: DataFrame, folder: str | None = None):
    """Write a cube for the time of a block, then delete it; yields the reread cube."""
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/cube-{uuid.uuid4().hex}"
    df.write.parquet(path)
    try:
        yield spark.read.parquet(path)
    finally:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

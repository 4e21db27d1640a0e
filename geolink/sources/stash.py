"""Stash: a persistent index from request hashes to materialised files, one per service.

The index is a Parquet log: storing appends one file with an entry, deleting one
with tombstones, and nothing is rewritten.  So a crash loses at most the entry being
written and two writers lose none.  ``live`` reads the log as the entries that stand;
``compact`` puts them into one file.

Of several callers that want one request, one makes it: ``materialise`` takes a claim, a
file that only one can create, and renews it while it works; the others wait for the
entry.  A claim that nobody renews is taken over after its lease.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import threading
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, path string, seq long, entry string, dead boolean"


def request_key(request: dict, service: str) -> str:
    """Hash of a request and its service; the target file's name is not part of it."""
    fields = {k: v for k, v in request.items() if k != "target"} | {"service": service}
    return hashlib.sha256(json.dumps(fields, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def key_column(fields: dict[str, Column]) -> Column:
    """The same hash for request fields held in string columns."""
    return F.sha2(F.to_json(F.struct(*[fields[name].cast("string").alias(name) for name in sorted(fields)])), 256)


def live(log: DataFrame) -> DataFrame:
    """(key, path, seq, entry): the log's entries without a tombstone."""
    last = log.groupBy("entry").agg(F.min("key").alias("key"), F.min("path").alias("path"), F.min("seq").alias("seq"), F.bool_or("dead").alias("dead"))
    return last.where(~F.col("dead")).select("key", "path", "seq", "entry")


def first_entries(index: DataFrame) -> DataFrame:
    """The entry that each key is restored from: its oldest."""
    return index.groupBy("key").agg(F.min_by("path", F.struct("seq", "path")).alias("path"))


def restore_all(index: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (with ``key``) and the ``path`` each is restored from, NULL where nothing is stored."""
    return requests.join(first_entries(index), "key", "left")


def clean_index(index: DataFrame, files: DataFrame) -> DataFrame:
    """The entries whose ``path`` is among the files that exist."""
    return index.join(files.select("path"), "path", "left_semi").select(*index.columns)


def pop_last(index: DataFrame, n: int = 1) -> DataFrame:
    """The index without the keys of its last ``n`` entries (duplicates of a key all go)."""
    last = index.orderBy(F.desc("seq")).limit(n).select("key").distinct()
    return index.join(last, "key", "left_anti")


class Stash:
    def __init__(self, spark: SparkSession, root: str, service: str):
        self.spark, self.service, self.folder = spark, service, f"{root.rstrip('/')}/{service}"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def get(self) -> DataFrame:
        """The live index; empty if there is none."""
        where = f"{self.folder}/index"
        return live(self.spark.read.schema(SCHEMA).parquet(where) if self.exists(where) else self.spark.createDataFrame([], SCHEMA))

    def _append(self, rows: list[tuple]) -> None:
        if rows:
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.folder}/index")

    def _remove(self, entries: list) -> None:
        self._append([(e["key"], e["path"], e["seq"], e["entry"], True) for e in entries])

    def store(self, path: str, request: dict) -> str:
        """Append an entry; an earlier one with the same key stays first."""
        key = request_key(request, self.service)
        self._append([(key, path, time.time_ns(), uuid.uuid4().hex, False)])
        return key

    def restore(self, request: dict) -> str | None:
        """The first entry's path, or None; an entry whose file is gone is removed."""
        hit = self.get().where(F.col("key") == request_key(request, self.service)).orderBy("seq", "entry").first()
        if hit is None:
            return None
        if not self.exists(hit["path"]):
            self._remove([hit])
            return None
        return hit["path"]

    def pop(self, n: int = 1) -> None:
        """Delete the files of the last ``n`` entries and all entries with their keys."""
        index = self.get()
        last = index.orderBy(F.desc("seq"), F.desc("entry")).limit(n).collect()
        for e in last:
            fs, p = self._fs(e["path"])
            fs.delete(p, True)
        self._remove(index.where(F.col("key").isin(*{e["key"] for e in last})).collect() if last else [])

    def clean(self) -> None:
        """Drop entries whose file is gone."""
        self._remove([e for e in self.get().collect() if not self.exists(e["path"])])

    def destroy(self) -> None:
        fs, p = self._fs(self.folder)
        fs.delete(p, True)

    def compact(self) -> None:
        """One file with the entries that stand takes the place of the log's files.

        What others append meanwhile is not among the files that go.  Files of entries
        go before those with tombstones: a crash between leaves entries twice, which is
        harmless, and none that was dead.
        """
        where = f"{self.folder}/index"
        if not self.exists(where):
            return
        fs, p = self._fs(where)
        old = [str(s.getPath().toString()) for s in fs.listStatus(p) if s.getPath().getName().startswith("part-")]
        log = self.spark.read.schema(SCHEMA).parquet(*old)
        dead = {r.f for r in log.where("dead").select(F.input_file_name().alias("f")).distinct().collect()}
        live(log).withColumn("dead", F.lit(False)).select(*[c.split(" ")[0] for c in SCHEMA.split(", ")]).coalesce(1).write.mode("append").parquet(where)
        names = {d.rsplit("/", 1)[1] for d in dead}
        for path in sorted(old, key=lambda o: o.rsplit("/", 1)[1] in names):
            fs.delete(self._fs(path)[1], False)

    def _claim(self, key: str, lease: float) -> str | None:
        """The path of a claim that is now ours, or None while another's holds."""
        path = f"{self.folder}/claims/{key}"
        fs, p = self._fs(path)
        with contextlib.suppress(Py4JJavaError):
            fs.create(p, False).close()
            return path
        with contextlib.suppress(Py4JJavaError):  # it may go while we look
            if time.time() - fs.getFileStatus(p).getModificationTime() / 1000 > lease:
                # only one caller's rename of the old claim succeeds
                gone = f"{path}-{uuid.uuid4().hex}"
                if fs.rename(p, self._fs(gone)[1]):
                    fs.delete(self._fs(gone)[1], False)
        return None

    @contextlib.contextmanager
    def _renewed(self, path: str, lease: float):
        """Keep a claim fresh for the time of a block, then give it back."""
        fs, p = self._fs(path)
        over = threading.Event()

        def renew():
            while not over.wait(lease / 4):
                with contextlib.suppress(Py4JJavaError):
                    fs.setTimes(p, int(time.time() * 1000), -1)

        beat = threading.Thread(target=renew, daemon=True)
        beat.start()
        try:
            yield
        finally:
            over.set()
            beat.join()
            fs.delete(p, False)

    def materialise(self, df: DataFrame, request: dict, cache: bool = True, lease: float = 600.0, wait: float = 0.5) -> DataFrame:
        """Reuse the stored result of an equal request, or write ``df`` once and store it.

        A caller waits (looking every ``wait`` seconds) while another one's claim to the
        same request is younger than ``lease`` seconds.
        """
        key = request_key(request, self.service)
        if not cache:
            path = f"{self.folder}/data/{key}-{uuid.uuid4().hex}"
            df.write.parquet(path)
            return self.spark.read.parquet(path)
        while True:
            if path := self.restore(request):
                return self.spark.read.parquet(path)
            if claim := self._claim(key, lease):
                break
            time.sleep(wait)
        with self._renewed(claim, lease):
            path = self.restore(request)  # stored between our look and our claim
            if path is None:
                path = f"{self.folder}/data/{key}-{uuid.uuid4().hex}"
                df.write.parquet(path)
                self.store(path, request)
        return self.spark.read.parquet(path)

"""Operator 3: substring dedup by counted Rabin-Karp window hashes.

Every window of ``length`` consecutive words of one document is hashed; Spark
deals the hashes to buckets and each bucket finds the smallest document id per
hash.  A window that also starts in a document with a smaller id is repeated;
overlapping repeated windows merge into maximal removal intervals.

Windows count as equal when their Rabin-Karp hashes over a field of 61 bits and a
second, unrelated hash of 32 bits agree.  Of n different windows n * n / 2**94 pairs
agree by chance: of the 10**13 on 100 TB 0.005 pairs are expected; no kind of text
makes the field's hashes collide.

A task first counts what it holds: of equal windows only the smallest document's
travel on, the others are already known to repeat.  So however often a window
occurs, a bucket gets it once per flush of a task.

The repeated windows are written; only texts that pass a filter of their documents' ids
are shuffled to them (the filter has a fixed size: beyond some 10**8 such documents it
passes all).

Defined results
    null or blank text  no words, nothing removed, hash of the empty text
    fewer words than a window  nothing removed
    null id             compares with nothing: never removed, removes nothing
    ties, repeated rows rows with one id are one document, so they don't remove each other; they must hold one text
    very long texts     windows of whole texts; memory follows the chunk and flush sizes
    empty table         no rows
    extra columns       those named in ``keep`` are carried along
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolink.llm import hashblocks
from geolink.llm.common import Scratch, keeping, sieve_marked, table, text_bytes
from geolink.llm.textkernel import chunks, joined, mix, window_checks, window_hashes, word_hashes, words

LENGTH = 50
#: Windows a task gathers before it deals them out, and text bytes (about 6 a window) per bucket.
FLUSH, BUCKET_BYTES = 1 << 19, 4 << 20


#: Buckets of hashes for each part of documents that repeats come home to.
PER_PART = 8


def _least(h: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """For each window, by hash and check, whether an equal one belongs to a smaller document."""
    order = np.lexsort((c, h))
    h, c, d = h[order], c[order], d[order]
    cut = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
    least = np.repeat(np.minimum.reduceat(d, cut), np.diff(np.r_[cut, len(h)]))
    out = np.empty(len(h), dtype=bool)
    out[order] = d > least
    return out


def _home(d: np.ndarray, p: np.ndarray, parts: int):
    """Rows (part, body): repeats packed by the part of their documents."""
    key = mix(d.astype(np.uint64)) % np.uint64(parts)
    order = np.argsort(key, kind="stable")
    for part, lo, hi in hashblocks.runs(key[order].astype(np.int64)):
        at = order[lo:hi]
        yield part, hashblocks.pack_places(d[at], p[at])


def _deal(held: list, buckets: int, parts: int):
    """Rows (bucket, part, body): packed windows for the buckets, and repeats known already (part set)."""
    h, c, d, p = (np.concatenate(x) for x in zip(*held, strict=True))
    repeated = _least(h, c, d)
    on, off = np.flatnonzero(~repeated), np.flatnonzero(repeated)
    out = [(b, None, hashblocks.pack(h[on[at]], d[on[at]], p[on[at]], c[on[at]], buckets)) for b, at in hashblocks.by_bucket(h[on], buckets)]
    out += [(part % buckets, part, body) for part, body in _home(d[off], p[off], parts)]
    bucket, part, body = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(part, pa.int64()), pa.array(body, pa.binary())], names=["bucket", "part", "body"])


def repeated_windows(docs: DataFrame, *, id_col: str, text_col: str, length: int = LENGTH, buckets: int | None = None) -> DataFrame:
    """(doc_id, starts): packed first-word positions of windows that also start in a smaller document."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    buckets = buckets or max(hashblocks.SHORT, -(-text_bytes(docs, "text") // BUCKET_BYTES))
    parts = -(-buckets // PER_PART)

    def windows(batches):
        held, n = [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in chunks(batch.column("text")):
                w = words(data, offsets)
                own = word_hashes(w)
                h, c = window_hashes(own, length), window_checks(own, length)
                text = w.text_of[: len(h)]
                at = np.arange(len(h))
                inside = at + length <= w.first[text + 1]
                if not inside.any():
                    continue
                text, at = text[inside], at[inside]
                held.append((h[inside], c[inside], ids[lo:hi][text], (at - w.first[text]).astype(np.int32)))
                n += len(at)
                if n >= FLUSH:
                    yield _deal(held, buckets, parts)
                    held, n = [], 0
        if held:
            yield _deal(held, buckets, parts)

    def count(group: pa.Table) -> pa.Table:
        known = group.filter(pa.compute.is_valid(group["part"]))
        blocks = [hashblocks.unpack(x, checks=True, buckets=buckets) for x in group.filter(pa.compute.is_null(group["part"]))["body"].to_pylist()]
        part, body = known["part"].to_pylist(), known["body"].to_pylist()
        if blocks:
            h, d, p, c = (np.concatenate(x) for x in zip(*blocks, strict=True))
            repeated = _least(h, c, d)
            for k, x in _home(d[repeated], p[repeated], parts):
                part.append(k)
                body.append(x)
        return pa.table({"part": pa.array(part, pa.int64()), "body": pa.array(body, pa.binary())})

    def gather(group: pa.Table) -> pa.Table:
        d, p = (np.concatenate(x) for x in zip(*map(hashblocks.unpack_places, group["body"].to_pylist()), strict=True))
        order = np.lexsort((p, d))
        rows = [(doc, p[order[lo:hi]].tobytes()) for doc, lo, hi in hashblocks.runs(d[order])]
        return pa.table({"doc_id": pa.array([x for x, _ in rows], pa.int64()), "starts": pa.array([x for _, x in rows], pa.binary())})

    dealt = docs.mapInArrow(windows, "bucket long, part long, body binary")
    counted = dealt.groupBy("bucket").applyInArrow(count, "part long, body binary")
    return counted.groupBy("part").applyInArrow(gather, "doc_id long, starts binary")


@keeping
def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, texts: bool = True, buckets: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Remove repeated windows: ``doc_id, n_words, n_removed, kept_sha256`` and ``keep``.

    With ``texts`` also the kept ``text`` (words joined by one space) and ``spans``,
    the maximal removal intervals as word positions (start, end exclusive).
    """
    found = repeated_windows(docs, id_col=id_col, text_col=text_col, length=length, buckets=buckets)
    found = Scratch(docs.sparkSession, "substrings").keep(found.select(F.col("doc_id").alias("_sub_id"), F.col("starts").alias("_sub_starts")), "found")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_sub_text"), *keep)
    # texts in which nothing repeats stay where they are; the others meet their windows
    marked = sieve_marked(rows, "doc_id", found, "_sub_id", "_sub_may")
    met = marked.where("_sub_may").drop("_sub_may").join(found, F.col("doc_id") == F.col("_sub_id"), "left").drop("_sub_id")
    rows = marked.where("not _sub_may").drop("_sub_may").withColumn("_sub_starts", F.lit(None).cast("binary")).unionByName(met)
    fields = [f for f in rows.schema.fields if not f.name.startswith("_sub_")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n_words long, n_removed long, kept_sha256 string", *(["text string, spans array<struct<start:int,end:int>>"] if texts else [])])

    def cut(batches):
        for batch in batches:
            starts = batch.column("_sub_starts")
            for lo, hi, data, offsets in chunks(batch.column("_sub_text")):
                w = words(data, offsets)
                cover = np.zeros(len(w.starts) + 1, dtype=np.int32)
                for i, packed in enumerate(starts[lo:hi].to_pylist()):
                    if packed:
                        at = np.frombuffer(packed, "<i4").astype(np.int64)
                        at = np.unique(at[at + length <= w.counts[i]]) + w.first[i]
                        cover[at] += 1
                        cover[at + length] -= 1
                gone = np.cumsum(cover[:-1]) > 0
                body, ends = joined(w, ~gone)
                raw = body.tobytes()
                total = np.r_[0, np.cumsum(gone)]
                kept = [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                part = batch.slice(lo, hi - lo)
                made = [pa.array(w.counts, pa.int64()), pa.array(np.diff(total[w.first]), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
                names = ["n_words", "n_removed", "kept_sha256"]
                if texts:
                    spans = []
                    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
                        edge = np.diff(np.r_[0, gone[a:b].astype(np.int8), 0])
                        spans.append([{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)])
                    made += [pa.array([x.decode() for x in kept], pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
                    names += ["text", "spans"]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), *made], names=[*(f.name for f in fields), *names])

    return rows.mapInArrow(cut, schema)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), texts=False)


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), w AS (
  SELECT rid, doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS g
  FROM (SELECT rid, doc_id, ws, unnest(range(1, greatest(1, len(ws) - 48))) AS i FROM d WHERE doc_id IS NOT NULL)
), m AS (
  SELECT rid, i, doc_id > min(doc_id) OVER (PARTITION BY g) AS bad FROM w
), c AS (
  SELECT rid, list(DISTINCT p) AS gone FROM (SELECT rid, unnest(range(i, i + 50)) AS p FROM m WHERE bad) GROUP BY rid
), k AS (
  SELECT d.rid, array_to_string(list(a ORDER BY d.p), ' ') AS kept
  FROM (SELECT rid, unnest(ws) AS a, generate_subscripts(ws, 1) AS p FROM d) AS d
  LEFT JOIN (SELECT rid, unnest(gone) AS p FROM c) AS x ON d.rid = x.rid AND d.p = x.p
  WHERE x.rid IS NULL GROUP BY d.rid
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN c USING (rid) LEFT JOIN k USING (rid)
"""

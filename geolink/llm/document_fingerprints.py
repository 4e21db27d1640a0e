"""Operator 13: document fingerprints from improbable byte windows in chained Bloom filters.

1.  Every window of ``WINDOW`` bytes has an entropy (in 1000ths of the largest).  One pass over
    all documents counts windows by entropy; the rarer an entropy, the better its rank.  Nearly
    uniform windows (``WEAK``) rank last.  The 1,001 counts are all that reaches the driver.
2.  In every run of ``WINDOW`` consecutive windows the best rank, the leftmost of equals, is
    named once; windows named ``POPULAR`` times or more are the document's features (the most
    named ones where none is named so often).  Texts under ``SHORT`` bytes add all their windows of ``TINY`` bytes.
3.  Features, each once, set ``PROBES`` bits in a Bloom filter of ``BITS`` bits; after ``FULL``
    features the next filter of the chain begins.  The fingerprint is the chain in hexadecimal.
4.  Two chains are alike by their bits' overlap, normalised from what chance gives (and
    ``CUT`` of the way on) to the smaller filter's bits: each filter of the shorter
    chain takes its best partner, and filters count by their bits.

Entropies are exact sums of integers, so a document's fingerprint depends on its text and the table of ranks alone.
Documents go by ranges of (id, hash of text) and are streamed in that order, a document
ahead, so neither windows over all rows nor a join is needed for neighbours.  The first and the last row
of each range are written with their texts and completed from one another.

Defined results
    null text        an empty text
    empty text       an empty fingerprint, alike (1.0) to itself only
    null id          comes first, before the smallest id
    equal ids        in the order of a hash of the text; repeated rows follow each other
    one document     is its own next
    equal texts      equal fingerprints, likeness 1.0
    empty table      no rows
    extra columns    those named in ``keep`` are carried along; names of results are refused
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolink.llm.common import Scratch, carried, table, text_or_empty

WINDOW, POPULAR, STEPS, WEAK = 16, 4, 1_000, 100
SHORT, TINY = 64, 4
BITS, PROBES, FULL, CUT = 2_048, 5, 160, 0.3
#: Bytes of text worked on at once (a longer text alone), positions whose entropies are computed at once.
SLICE, BLOCK = 2 << 20, 1 << 17
RESULTS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")

#: c * log2(c) as integers, and its steps.
_SCALE = 1 << 20
_LOGS = np.array([0] + [round(c * np.log2(c) * _SCALE) for c in range(1, WINDOW + 1)], np.int64)
_STEP = np.diff(_LOGS)
_MOST = int(_LOGS[WINDOW])


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_WEIGHTS = _mixed(np.arange(1, WINDOW + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def entropies(data: np.ndarray) -> np.ndarray:
    """The entropy of the window at every position that has one, 0 to ``STEPS``."""
    out = np.zeros(max(0, len(data) - WINDOW + 1), np.int16)
    for a in range(0, len(out), BLOCK):
        part = data[a : a + BLOCK + WINDOW - 1]
        ahead, behind = np.zeros(len(part), np.uint8), np.zeros(len(part), np.uint8)
        for d in range(1, WINDOW):
            same = (part[d:] == part[:-d]).view(np.uint8)
            ahead[:-d] += same
            behind[d:] += same
        # a window's sum changes by the byte that comes in and by the one that goes out
        come, go = _STEP[behind], _STEP[ahead]
        sums = np.cumsum(np.concatenate([[come[:WINDOW].sum()], come[WINDOW:] - go[: len(part) - WINDOW]]))
        out[a : a + len(sums)] = (_MOST - sums) * STEPS // _MOST
    return out


def entropy_counts(docs: DataFrame, text_col: str = "text") -> list[int]:
    """How many windows of all documents have each entropy."""

    def run(batches):
        count = np.zeros(STEPS + 1, np.int64)
        for batch in batches:
            for data, lengths in _slices(t.encode() for t in batch.column("text").to_pylist()):
                inside = _inside(lengths)[: max(0, len(data) - WINDOW + 1)]
                count += np.bincount(entropies(data)[inside], minlength=STEPS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(STEPS + 1, dtype=np.int32)), pa.array(count)], names=["at", "n"])

    parts = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(run, "at int, n bigint")
    counts = [0] * (STEPS + 1)
    for r in parts.groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect():
        counts[r["at"]] = int(r["n"])
    return counts


def entropy_ranks(counts: list[int]) -> np.ndarray:
    """The rank of each entropy: rare ones first, weak ones last."""
    order = sorted(range(STEPS + 1), key=lambda e: (e < WEAK, counts[e], e))
    ranks = np.empty(STEPS + 1, np.int64)
    ranks[order] = np.arange(STEPS + 1)
    return ranks


def _slices(texts):
    """Texts joined to about ``SLICE`` bytes: (bytes, lengths)."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > SLICE:
            yield np.frombuffer(b"".join(held), np.uint8), np.array([len(h) for h in held])
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), np.array([len(h) for h in held])


def _inside(lengths: np.ndarray) -> np.ndarray:
    """Whether the window at each byte ends in the byte's own text."""
    ends = np.repeat(np.cumsum(lengths), lengths)
    return np.arange(len(ends)) + WINDOW <= ends


def features(data: np.ndarray, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every text's features, in their order."""
    begins, which = np.cumsum(lengths) - lengths, np.repeat(np.arange(len(lengths)), lengths)
    windows = np.maximum(lengths - WINDOW + 1, 0)
    chosen = np.zeros(0, np.int64)
    if windows.any():
        inside, none = _inside(lengths), np.int64(1) << 62
        key = np.full(len(data) + WINDOW - 1, none)
        at = np.nonzero(inside)[0]
        key[at] = ranks[entropies(data)[at]] << 40 | at
        step = 1
        while step < WINDOW:  # a power of two
            key = np.minimum(key[:-step], key[step:])
            step *= 2
        # one run starts at every window that has as many behind it, and one at the first of fewer
        place = np.arange(len(data)) - begins[which]
        runs = inside & (place <= np.maximum(windows - WINDOW, 0)[which])
        named = np.bincount(key[runs] & ((1 << 40) - 1), minlength=len(data))
        full = np.nonzero(lengths)[0]
        most = np.zeros(len(lengths), np.int64)
        most[full] = np.maximum.reduceat(named, begins[full])
        chosen = np.nonzero(inside & (named > 0) & (named >= np.minimum(most, POPULAR)[which]))[0]
    bytes_of = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[chosen] if len(chosen) else np.zeros((0, WINDOW), np.uint8)
    hashes = (bytes_of.astype(np.uint64) * _WEIGHTS).sum(axis=1, dtype=np.uint64)
    short, tiny = [], []
    for i in np.nonzero((lengths > 0) & (lengths < SHORT))[0]:
        own = data[begins[i] : begins[i] + lengths[i]].astype(np.uint64)
        sums = (np.lib.stride_tricks.sliding_window_view(own, min(TINY, len(own))) * _WEIGHTS[: len(own)][:TINY]).sum(axis=1, dtype=np.uint64)
        short.append(np.full(len(sums), i))
        tiny.append(sums + np.uint64(min(TINY, len(own))))
    texts, hashes = np.concatenate([which[chosen], *short]), np.concatenate([hashes, *tiny])
    order = np.argsort(texts, kind="stable")
    return texts[order], _mixed(hashes)[order]


def chains(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """The filters of every text, an array (filters, BITS / 8) of bytes each."""
    out = []
    for data, lengths in _slices(texts):
        text, hashes = features(data, lengths, ranks)
        # each feature once, where it comes first
        first = np.sort(np.unique(np.rec.fromarrays([text, hashes]), return_index=True)[1]) if len(text) else np.zeros(0, np.int64)
        text, hashes = text[first], hashes[first]
        n = np.bincount(text, minlength=len(lengths))
        filters = -(-n // FULL)
        base = np.cumsum(filters) - filters
        nth = np.arange(len(text)) - (np.cumsum(n) - n)[text]
        bits = np.zeros((int(filters.sum()), BITS), bool)
        for p in range(PROBES):
            bits[base[text] + nth // FULL, (hashes >> np.uint64(11 * p)) & np.uint64(BITS - 1)] = True
        packed = np.packbits(bits, axis=1)
        out += [packed[b : b + f] for b, f in zip(base, filters, strict=True)]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: how far the bits of two chains overlap beyond chance."""
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if (len(a), a.tobytes()) > (len(b), b.tobytes()):
        a, b = b, a
    y = np.unpackbits(b, axis=1).astype(np.float32)
    ny, total, weight = y.sum(axis=1), 0.0, 0.0
    for at in range(0, len(a), 512):
        x = np.unpackbits(a[at : at + 512], axis=1).astype(np.float32)
        nx = x.sum(axis=1)
        most, chance = np.minimum(nx[:, None], ny), nx[:, None] * ny / BITS
        low = chance + CUT * (most - chance)
        score = np.where(most > low, (x @ y.T - low) / np.maximum(most - low, 1e-9), 0.0)
        total += float((np.clip(score, 0, 1).max(axis=1) * nx).sum())
        weight += float(nx.sum())
    return total / weight


def _edited(text: str, after: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


_DONE = "n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_TYPES = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]


def _other(a: bytes, b: bytes) -> bytes:
    """``b`` told by where it differs from ``a``, as far as both go; the same gives ``b`` back."""
    n = min(len(a), len(b))
    return (np.frombuffer(a[:n], np.uint8) ^ np.frombuffer(b[:n], np.uint8)).tobytes() + b[n:]


def _row(text: str, edited: bytes, own: np.ndarray, new: np.ndarray, after: np.ndarray) -> tuple:
    return len(text), hashlib.sha256(edited).hexdigest(), own.tobytes(), _other(own.tobytes(), new.tobytes()), likeness(own, new), likeness(own, after)


def _by_bytes(texts: list[str]):
    """Bounds of slices of about ``SLICE`` bytes."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > SLICE:
            yield a, i
            a, size = i, 0
        size += len(t)
    yield a, len(texts)


def fingerprint(docs: DataFrame, scratch: Scratch, *, ranks: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Fingerprints of every text and of its edited form: ``RESULTS`` and ``keep``.

    Pass the ``ranks`` of a corpus to compare fingerprints across tables; otherwise
    they come from these documents.
    """
    ranks = entropy_ranks(entropy_counts(docs, text_col)) if ranks is None else ranks
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), *carried(docs, keep, RESULTS))
    fields = [f for f in rows.schema.fields if f.name != "text"]
    names, head = [f.name for f in fields], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    rows = rows.withColumns({"_hash": F.xxhash64("text"), "_salt": F.xxhash64(F.monotonically_increasing_id())})
    order = ["doc_id", "_hash", "_salt"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_hash", "_salt")

    def made(kept: list[tuple], results: list[tuple], tail: list[tuple], kinds) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in kept], t) for i, t in enumerate(kinds)]
        columns += [pa.array([r[i] for r in results], t) for i, t in enumerate(_TYPES)]
        columns += [pa.array([t[0] for t in tail], pa.int32()), pa.array([t[1] for t in tail], pa.string()), pa.array([t[2] for t in tail], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=[*names, *(f.split(" ")[0] for f in _DONE.split(", ")), "part", "kind", "text"])

    def stream(batches):
        part, last, kinds = TaskContext.get().partitionId(), None, None
        for batch in batches:
            kinds = kinds or [batch.schema.field(n).type for n in names]
            texts, kept = batch.column("text").to_pylist(), list(zip(*(batch.column(n).to_pylist() for n in names), strict=True))
            for a, b in _by_bytes(texts) if texts else ():
                chain = chains([t.encode() for t in texts[a:b]], ranks)
                items = list(zip(kept[a:b], texts[a:b], chain, strict=True))
                if last is None:
                    yield made([items[0][0]], [(None,) * 6], [(part, "first", items[0][1])], kinds)
                else:
                    items.insert(0, last)
                last = items.pop()
                if not items:
                    continue
                nexts = [*items[1:], last]
                edited = [_edited(i[1], n[1]).encode() for i, n in zip(items, nexts, strict=True)]
                results = [_row(i[1], e, i[2], new, n[2]) for i, e, new, n in zip(items, edited, chains(edited, ranks), nexts, strict=True)]
                yield made([i[0] for i in items], results, [(part, "done", None)] * len(items), kinds)
        if last is not None:
            yield made([last[0]], [(None,) * 6], [(part, "last", last[1])], kinds)

    def complete(batches):
        for batch in batches:
            kinds = [batch.schema.field(n).type for n in names]
            kept = list(zip(*(batch.column(n).to_pylist() for n in names), strict=True))
            for k, text, after in zip(kept, batch.column("text").to_pylist(), batch.column("after").to_pylist(), strict=True):
                edited = _edited(text, after).encode()
                own, new, follow = (chains([x], ranks)[0] for x in (text.encode(), edited, after.encode()))
                yield made([k], [_row(text, edited, own, new, follow)], [(0, "done", None)], kinds)

    whole = f"{head}, {_DONE}, part int, kind string, text string"
    # packed bytes, not text, and of the edited form only what differs: chains are most of what is written here
    written = scratch.keep(ordered.mapInArrow(stream, whole), "rows", compression="zstd")
    # one number for each range that holds rows
    parts = sorted(r.part for r in written.where("kind = 'last'").select("part").collect())
    follows = dict(zip(parts, parts[1:] + parts[:1], strict=True))
    lasts = written.where("kind = 'last'").select(*names, "text", "part")
    if follows:
        lasts = lasts.withColumn("part", F.create_map(*[F.lit(x) for pair in follows.items() for x in pair])[F.col("part")])
    firsts = written.where("kind = 'first'").select("part", F.col("text").alias("after"))
    ends = lasts.join(firsts, "part").select(*names, "text", "after").mapInArrow(complete, whole)
    out = written.where("kind = 'done'").unionByName(ends)

    def restored(batches):
        for batch in batches:
            own, new = (batch.column(c).to_pylist() for c in ("fingerprint", "edited_fingerprint"))
            made = {"fingerprint": pa.array([a.hex() for a in own], pa.string()), "edited_fingerprint": pa.array([_other(a, b).hex() for a, b in zip(own, new, strict=True)], pa.string())}
            yield pa.RecordBatch.from_arrays([made.get(f.name, batch.column(f.name)) for f in batch.schema], names=batch.schema.names)

    final = f"{head}, {_DONE.replace('binary', 'string')}"
    return out.drop("part", "kind", "text").mapInArrow(restored, final).select(*RESULTS, *(["_kept.*"] if keep else []))


def op13_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """All documents and their edited forms."""
    return fingerprint(table(spark, sf_dir, "documents"), Scratch(spark, "op13"))

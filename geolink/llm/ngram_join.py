"""Operator 4: exact n-gram Jaccard join by set-relation skipping.

A document's set holds the hashes of its distinct word n-grams.  Equal sets form
one class, so only class representatives are joined:

1.  Screening.  With sets ordered by hash, two sets at or over the threshold
    share a quarter of either among their lower halves.  Lower halves are dealt to
    buckets of hashes; classes without that many shared hashes have no partner.
2.  Index.  The survivors' grams are ordered by document frequency, then hash.
    Each survivor enters the index lists of its prefix: the grams of which any
    partner must share one.
3.  Answers of a pivot.  Every member of an index list is compared with the
    list's first set.  Lists of one group of near copies share their first set,
    so this is about one comparison a set; the differences of sets that are highly
    similar to the pivot (``SIMILAR``) are kept.
4.  Skipping.  Members that a pivot already connects need no comparison.  For the
    others a list is cut into blocks by size and position and blocks whose bound
    stays under the required overlap are skipped.  The overlap of what is left
    follows from both sets' differences to the pivot, without reading a set; where
    the pivot is not similar to both, the two sets are compared.
5.  Many pairs.  Where a block leaves more pairs than members, only the members are
    written, once for each pivot.  The sets of a pivot's members are compared in cells
    of a bounded number of rows, which return as many links as connect their labels.
    Larger lists and pivots are first compared within cells of random members: that
    connects most near copies, and only what it leaves apart is compared throughout.

Sets are compared as 64-bit gram hashes (Rabin-Karp over a field of 61 bits, which
no kind of text makes collide): of two sets of n grams, n * n / 2**61 pairs of
different grams look equal by chance, and each moves an overlap by one.

A class goes to one bucket per shared hash only unless the task that read it knows
already that the hash is shared; then one mark stands for all of the task's classes.
Document frequencies are summed over blocks of sets.  So a gram that a third of all
documents hold is one entry for each task or block, and documents of one text, or of
none, are dealt out evenly.

Defined results
    null or blank text    empty set, ``n_shingles`` 0, linked with nothing
    fewer words than n    the whole word sequence is the one gram
    null id               set size only; ``component_id`` null
    equal sets, repeated rows  one class; rows with one id should hold one text
    ties                  integer arithmetic decides the threshold, equality links
    very long texts       whole; a set lives in one row
    empty table           no rows
    extra columns         ignored
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolink.llm import hashblocks
from geolink.llm.common import Scratch, give_back, lean, sieve, small, table, text_bytes
from geolink.llm.components import components
from geolink.llm.textkernel import chunks, mix, run_hashes, window_hashes, word_hashes, words

N = 5
#: Threshold as a fraction: links need OVER * intersection >= UNDER * union.
OVER, UNDER = 100, 75
FLUSH, BUCKET_BYTES = 1 << 20, 12 << 20
#: Members that are compared with one copy of a pivot, and entries in a block of an index list.
PIVOT_ROWS, BLOCK_ROWS = 256, 256
#: Grams that sets are compared by at once.
COLUMNS = 4096
#: Differences to a pivot are kept from this share of the larger set in common; class that stands for several.
SIMILAR, MANY = 0.6, np.iinfo(np.int64).min
_LOW = np.uint64(0xFFFFFFFF)


def gram_sets(column: pa.Array, n: int = N):
    """Yield (row, sorted distinct gram hashes) for every text of a column."""
    for lo, _, data, offsets in chunks(column):
        w = words(data, offsets)
        h = word_hashes(w, lower=True)
        grams = window_hashes(h, n)
        whole = run_hashes(h, w.first)
        for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
            if b - a >= n:
                own = np.sort(grams[a : b - n + 1])
                own = own[np.r_[True, own[1:] != own[:-1]]]
            else:
                own = whole[i : i + 1] if b > a else grams[:0]
            yield lo + i, own


def signature(grams: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that equal sets share."""
    with np.errstate(over="ignore"):
        one = int(mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))
        two = int(mix(grams + np.uint64(0x1234567)).sum(dtype=np.uint64))
    one, two = (x - (1 << 64) if x >> 63 else x for x in (one, two))
    return max(one, int(MANY) + 1), two


def _low_buckets(hashes: np.ndarray, buckets: int):
    return hashblocks.by_bucket((hashes & _LOW) << np.uint64(32), buckets)


def linked(overlap, n_a, n_b):
    """OVER * overlap >= UNDER * union, for numbers, arrays or columns."""
    return overlap * (OVER + UNDER) >= (n_a + n_b) * UNDER


def _least(n: int) -> int:
    """The smallest overlap that a partner of a set of n grams can have with it."""
    return -(-n * UNDER // OVER)


def screen(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """A row per document (doc_id, n, s1, s2) and rows (s1, shared): hashes a class shares in a bucket."""

    names = ["bucket", "doc_id", "n", "s1", "s2", "body"]

    def rows(bucket, n, s1, body, doc_id=None, s2=None):
        none = pa.nulls(len(bucket), pa.int64())
        columns = [pa.array(bucket, pa.int64()), none if doc_id is None else doc_id, none if n is None else pa.array(n, pa.int64()), none if s1 is None else pa.array(s1, pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, none if s2 is None else pa.array(s2, pa.int64()), pa.nulls(len(bucket), pa.binary()) if body is None else pa.array(body, pa.binary())], names=names)

    def read(batches):
        held, size, seen, dealt = [], 0, set(), 0

        def flush():
            h, s = np.concatenate([x for x, _ in held]), np.repeat(np.array([one for _, one in held], np.int64), [len(x) for x, _ in held])
            held.clear()
            order = np.argsort(h, kind="stable")
            h, s = h[order], s[order]
            del order
            first = np.r_[True, h[1:] != h[:-1]]
            same = np.diff(np.r_[np.flatnonzero(first), len(h)])
            several = np.repeat(same > 1, same)
            known, count = np.unique(s[several], return_counts=True)
            yield rows(known % buckets, count, known, None)
            h, s = h[first], np.where(several[first], MANY, s[first])
            order = np.argsort(s, kind="stable")  # runs of one class pack best
            h, s = h[order], s[order]
            packed = [(b, hashblocks.pack(h[at], s[at])) for b, at in _low_buckets(h, buckets)]
            del h, s, first, same, several, order
            yield rows([b for b, _ in packed], None, None, [x for _, x in packed])
            give_back()

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            ns, ones, twos = [], [], []
            for row, grams in gram_sets(batch.column("text"), n):
                one, two = signature(grams)
                ns.append(len(grams))
                ones.append(one)
                twos.append(two)
                if len(grams) and ids[row] is not None and one not in seen:
                    seen.add(one)
                    half = grams[: (len(grams) + 1) // 2]
                    held.append((half.copy(), one))
                    size += len(half)
                    if size >= FLUSH:
                        yield from flush()
                        held, size, seen = [], 0, set()
            yield rows((dealt + np.arange(len(ns))) % buckets, ns, ones, None, batch.column("doc_id"), twos)
            dealt += len(ns)
        if held:
            yield from flush()

    def share(group: pa.Table) -> pa.Table:
        told = group.filter(pa.compute.is_null(group["body"]))
        blocks = [hashblocks.unpack(x, places=False) for x in group.filter(pa.compute.is_valid(group["body"]))["body"].to_pylist()]
        classes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if blocks:
            h, c = (np.concatenate(x) for x in zip(*blocks, strict=True))
            order = np.lexsort((c, h))
            h, c = h[order], c[order]
            first = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])]
            h, c = h[first], c[first]
            same = h[1:] == h[:-1]
            shared = (np.r_[same, False] | np.r_[False, same]) & (c != MANY)
            classes, counts = np.unique(c[shared], return_counts=True)
        none = pa.nulls(len(classes), pa.int64())
        known = pa.compute.is_null(told["s2"])
        blank = pa.scalar(None, pa.int64())
        old = {"doc_id": told["doc_id"], "n": pa.compute.if_else(known, blank, told["n"]), "s1": told["s1"], "s2": told["s2"], "shared": pa.compute.if_else(known, told["n"], blank)}
        new = {"doc_id": none, "n": none, "s1": pa.array(classes, pa.int64()), "s2": none, "shared": pa.array(counts, pa.int64())}
        return pa.table({k: pa.concat_arrays([v.combine_chunks(), new[k]]) for k, v in old.items()})

    dealt = docs.mapInArrow(lean(read), "bucket long, doc_id long, n long, s1 long, s2 long, body binary")
    return dealt.groupBy("bucket").applyInArrow(lean(share), "doc_id long, n long, s1 long, s2 long, shared long")


def survivor_sets(docs: DataFrame, survivors: DataFrame, n: int) -> DataFrame:
    """(rep, n, grams): sorted 64-bit gram hashes of each surviving class's representative."""

    def read(batches):
        done = set()
        for batch in batches:
            reps, ones = batch.column("rep").to_pylist(), batch.column("s1").to_pylist()
            out = []
            for row, grams in gram_sets(batch.column("text"), n):
                if reps[row] not in done and signature(grams)[0] == ones[row]:
                    done.add(reps[row])
                    out.append((reps[row], len(grams), grams.astype("<u8").tobytes()))
            if out:
                rep, size, grams = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(size, pa.int64()), pa.array(grams, pa.binary())], names=["rep", "n", "grams"])

    return sieve(docs, "doc_id", survivors, "rep").join(survivors, F.col("doc_id") == F.col("rep")).select("rep", "s1", "text").mapInArrow(lean(read), "rep long, n long, grams binary")


def _grams(column) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u8") for x in column]


def frequencies(sets: DataFrame, buckets: int) -> DataFrame:
    """(block, parts): for each block of sets, its distinct grams' frequency classes, bucket by bucket in hash order."""

    def deal(group: pa.Table) -> pa.Table:
        h, n = np.unique(np.concatenate(_grams(group["grams"])), return_counts=True)
        out = [(b, h[at].tobytes() + n[at].astype("<u4").tobytes()) for b, at in hashblocks.by_bucket(h, buckets)]
        return pa.table({"bucket": pa.array([b for b, _ in out], pa.int64()), "block": pa.repeat(group["block"][0], len(out)), "body": pa.array([x for _, x in out], pa.binary())})

    def count(group: pa.Table) -> pa.Table:
        bodies = group["body"].to_pylist()
        sizes = [len(x) // 12 for x in bodies]
        h = np.concatenate([np.frombuffer(x[: 8 * n], "<u8") for x, n in zip(bodies, sizes, strict=True)])
        c = np.concatenate([np.frombuffer(x[8 * n :], "<u4") for x, n in zip(bodies, sizes, strict=True)])
        _, where = np.unique(h, return_inverse=True)
        df = np.bincount(where, weights=c)
        level = np.minimum(255, np.floor(8 * np.log2(df))).astype(np.uint8)[where]
        ends = np.cumsum(sizes)
        parts = [level[b - n : b].tobytes() for b, n in zip(ends.tolist(), sizes, strict=True)]
        return pa.table({"block": group["block"], "bucket": group["bucket"], "levels": pa.array(parts, pa.binary())})

    counted = sets.groupBy("block").applyInArrow(lean(deal), "bucket long, block long, body binary").groupBy("bucket").applyInArrow(lean(count), "block long, bucket long, levels binary")
    return counted.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "levels"))).alias("parts"))


def postings(sets: DataFrame, levels: DataFrame) -> DataFrame:
    """Index entries (gram, rep, n, pos): prefix grams that occur in more than one set."""

    def read(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left):
            grams = _grams(left["grams"])
            distinct = np.unique(np.concatenate(grams))
            every = np.frombuffer(b"".join(p["levels"] for p in right["parts"][0].as_py()), np.uint8)
            for rep, h in zip(left["rep"].to_pylist(), grams, strict=True):
                level = every[np.searchsorted(distinct, h)]
                order = np.lexsort((h, level))[: len(h) - _least(len(h)) + 1]
                pos = np.flatnonzero(level[order] > 0)
                out.append((h[order[pos]].view(np.int64), np.full(len(pos), rep, np.int64), np.full(len(pos), len(h), np.int64), pos.astype(np.int64)))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table([pa.array(x, pa.int64()) for x in columns], names=["gram", "rep", "n", "pos"])

    return sets.groupBy("block").cogroup(levels.groupBy("block")).applyInArrow(lean(read), "gram long, rep long, n long, pos long")


def pivot_answers(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(pivot, rep, n_pivot, n, overlap, minus, plus): each pair's overlap and its differences, if it is similar."""
    pairs = scratch.keep(pairs, "pairs")
    counts = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / PIVOT_ROWS).alias("salts")).withColumnRenamed("pivot", "_pivot")
    salted = pairs.join(counts, F.col("pivot") == F.col("_pivot")).select("pivot", "rep", F.pmod(F.xxhash64("rep"), F.col("salts")).alias("salt"))
    salted = scratch.keep(salted, "salted")
    member = sets.select(F.col("rep").alias("_rep"), "n", "grams")
    members = salted.join(member, F.col("rep") == F.col("_rep")).select("pivot", "salt", "rep", "n", "grams")
    copies = salted.select(F.col("pivot").alias("p"), F.col("salt").alias("s")).distinct()
    pivots = copies.join(sets.select(F.col("rep").alias("q"), F.col("n").alias("m"), F.col("grams").alias("own")), F.col("p") == F.col("q")).select("p", "s", "m", "own")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        cols: dict[str, list] = {k: [] for k in ("pivot", "rep", "n_pivot", "n", "overlap", "minus", "plus")}
        if len(right) and len(left):
            pivot, n_pivot = right["p"][0].as_py(), right["m"][0].as_py()
            own = np.frombuffer(right["own"][0].as_buffer(), "<u8")
            for rep, n, grams in zip(left["rep"].to_pylist(), left["n"].to_pylist(), left["grams"], strict=True):
                h = np.frombuffer(grams.as_buffer(), "<u8")
                at = np.minimum(np.searchsorted(own, h), len(own) - 1)
                hit = own[at] == h
                there = np.zeros(len(own), dtype=bool)
                there[at[hit]] = True
                overlap = int(hit.sum())
                near = overlap >= SIMILAR * max(n, n_pivot)
                for k, v in zip(cols, (pivot, rep, n_pivot, n, overlap, own[~there].tobytes() if near else None, h[~hit].tobytes() if near else None), strict=True):
                    cols[k].append(v)
        return pa.table({k: pa.array(v, pa.binary() if k in ("minus", "plus") else pa.int64()) for k, v in cols.items()})

    return members.groupBy("pivot", "salt").cogroup(pivots.groupBy("p", "s")).applyInArrow(
        compare, "pivot long, rep long, n_pivot long, n long, overlap long, minus binary, plus binary"
    )


def dealt_to_cells(rows: DataFrame, key: str, whole: bool, scratch: Scratch, name: str) -> tuple[DataFrame, bool]:
    """(rows with ``least``, the smallest rep of their group, ``is_major`` and ``cell``; whether all pairs of a group meet).

    Groups of one label are left out.  A row goes to one cell of about ``BLOCK_ROWS`` or, if the ``whole`` group is
    asked for, to those of a grid: blocks of the largest label against blocks of the others, and these among themselves.
    """
    by_label = rows.groupBy(key, "label").agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("first"))
    groups = by_label.groupBy(F.col(key).alias("_key")).agg(
        F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("total"), F.min("first").alias("least"), F.count(F.lit(1)).alias("labels")
    )
    blocks = {"blocks": F.col("total"), "rows": F.col("top.c"), "cols": F.col("total") - F.col("top.c")}
    groups = groups.where("labels > 1").select("_key", "least", F.col("top.label").alias("major"), *[F.ceil(c / BLOCK_ROWS).alias(k) for k, c in blocks.items()])
    groups = scratch.keep(groups, name)
    dealt = rows.join(groups, F.col(key) == F.col("_key")).withColumn("is_major", F.col("label") == F.col("major"))
    if not whole:
        at = F.pmod(F.xxhash64("rep"), F.col("blocks"))
        cell = F.struct(F.lit(1).alias("kind"), at.alias("i"), at.alias("j"))
        return dealt.withColumn("cell", cell).select(*rows.columns, "least", "is_major", "cell"), not groups.where("blocks > 1").limit(1).count()
    own = F.when(F.col("is_major"), F.pmod(F.xxhash64("rep"), F.col("rows"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("cols")))
    cells = F.when(F.col("is_major"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("cols") - 1), lambda j: F.struct(F.lit(0).alias("kind"), F.col("own").alias("i"), j.alias("j")))).otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1), lambda i: F.struct(F.lit(0).alias("kind"), i.alias("i"), F.col("own").alias("j"))),
            F.transform(F.sequence(F.lit(0).cast("long"), F.col("cols") - 1), lambda j: F.struct(F.lit(1).alias("kind"), F.least(j, "own").alias("i"), F.greatest(j, "own").alias("j"))),
        )
    )
    return dealt.withColumn("own", own).withColumn("cell", F.explode(cells)).select(*rows.columns, "least", "is_major", "cell"), True


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    labels = labels.select(F.col("node").alias("_node"), "component")
    return rows.join(labels, F.col("rep") == F.col("_node"), "left").select(*rows.columns, F.coalesce("component", "rep").alias("label"))


def open_pairs(index: DataFrame, labels: DataFrame, whole: bool, scratch: Scratch, name: str) -> tuple[DataFrame, bool]:
    """(rows (a, b, pivot), whether lists were whole): pairs of one cell of an index list whose labels differ and that the size
    and position bounds allow or, where these are more than their members, the members alone, in ``a``."""
    entries = scratch.keep(_labelled(index, labels), f"{name}-entries")
    placed, met = dealt_to_cells(entries, "gram", whole, scratch, f"{name}-lists")
    placed = placed.select("gram", "cell", F.col("least").alias("pivot"), "rep", "n", "pos", "label", "is_major")
    placed = placed.repartition("gram", "cell").sortWithinPartitions("gram", "cell", "n", "pos")

    def skip(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            key = np.stack([t["gram"].to_numpy(), *(pa.compute.struct_field(t["cell"].combine_chunks(), k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("kind", "i", "j"))])
            cut = np.r_[0, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1]
            whole = t.slice(0, int(cut[-1]))
            rest = t.slice(int(cut[-1])).combine_chunks()
            yield from pairs_of(whole, key, cut)
        if rest is not None and len(rest):
            key = np.stack([np.zeros(len(rest), np.int64), pa.compute.struct_field(rest["cell"].combine_chunks(), "kind").to_numpy(zero_copy_only=False).astype(np.int64)])
            yield from pairs_of(rest, key, np.array([0, len(rest)]))

    def pairs_of(t, key, cut):
        if not len(t):
            return
        rep, n, pos, label, pivot, major = (t[k].to_numpy() for k in ("rep", "n", "pos", "label", "pivot", "is_major"))
        out = []
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if hi - lo < 2:
                continue
            kind = key[1, lo]
            r, s, p, l, m = rep[lo:hi], n[lo:hi], pos[lo:hi], label[lo:hi], major[lo:hi]
            pairs = []
            # blocks of one size, by position; sizes rise, so partners of a block are a range of blocks
            sizes, start = np.unique(s, return_index=True)
            stop = np.r_[start[1:], len(s)]
            for x in range(len(sizes)):
                for y in range(x, np.searchsorted(sizes * UNDER, sizes[x] * OVER, side="right")):
                    need = -(-(sizes[x] + sizes[y]) * UNDER // (OVER + UNDER))
                    # past these positions too little of either set is left to reach the overlap
                    a = start[x] + np.searchsorted(p[start[x] : stop[x]], sizes[x] - need, side="right")
                    b = start[y] + np.searchsorted(p[start[y] : stop[y]], sizes[y] - need, side="right")
                    i, j = np.arange(start[x], a), np.arange(start[y], b)
                    if not len(i) or not len(j):
                        continue
                    ok = l[i][:, None] != l[j][None, :]
                    ok &= (m[i][:, None] != m[j][None, :]) if kind == 0 else True
                    i, j = (k[w] for k, w in zip((i, j), np.nonzero(ok), strict=True))
                    if len(i):
                        pairs.append((np.minimum(r[i], r[j]), np.maximum(r[i], r[j])))
            if pairs:
                a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
                on = (a != pivot[lo]) & (b != pivot[lo]) & (a != b)  # pairs with the pivot are answered already
                if not on.any():
                    continue
                a, b = np.unique(np.stack([a[on], b[on]]), axis=1)
                members = np.unique(np.r_[a, b])
                many = len(a) > len(members)
                a, b = (members, np.full(len(members), MANY)) if many else (a, b)
                out.append((a, b, np.full(len(a), pivot[lo])))
        if out:
            a, b, c = np.unique(np.stack([np.concatenate(x) for x in zip(*out, strict=True)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=b == MANY), pa.array(c)], names=["a", "b", "pivot"])

    return scratch.keep(placed.mapInArrow(lean(skip), "a long, b long, pivot long"), name), met


def linked_in_cells(members: DataFrame, sets: DataFrame, whole: bool, scratch: Scratch, name: str) -> tuple[DataFrame, bool]:
    """(links (a, b), whether groups were whole): of the members (pivot, rep, label) of a pivot, as many as connect the labels of a cell."""
    placed, met = dealt_to_cells(members, "pivot", whole, scratch, f"{name}-groups")
    own = sets.select(F.col("rep").alias("_rep"), "n", "grams")
    placed = placed.join(own, F.col("rep") == F.col("_rep")).select("pivot", "cell", "rep", "label", "n", "grams")

    def overlaps(grams):
        which = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        _, at, count = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
        several = count > 1
        at, which = (np.cumsum(several) - 1)[at[several[at]]], which[several[at]]
        order = np.argsort(at, kind="stable")
        at, which = at[order], which[order]
        out = np.zeros((len(grams), len(grams)), np.int64)
        for lo in range(0, int(several.sum()), COLUMNS):
            a, b = np.searchsorted(at, (lo, lo + COLUMNS))
            has = np.zeros((len(grams), COLUMNS), np.float32)
            has[which[a:b], at[a:b] - lo] = 1
            out += (has @ has.T).astype(np.int64)
        return out

    def compare(group: pa.Table) -> pa.Table:
        rep, n = group["rep"].to_numpy(), group["n"].to_numpy()
        names, label = np.unique(group["label"].to_numpy(), return_inverse=True)
        on = linked(overlaps(_grams(group["grams"])), n[:, None], n[None, :]) & (label[:, None] < label[None, :])
        i, j = np.nonzero(on)
        _, one = np.unique(label[i] * len(names) + label[j], return_index=True)
        root, kept = list(range(len(names))), []

        def top(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for k in one.tolist():
            x, y = top(label[i[k]]), top(label[j[k]])
            if x != y:
                root[x] = y
                kept.append(k)
        a, b = rep[i[kept]], rep[j[kept]]
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return placed.groupBy("pivot", "cell").applyInArrow(compare, "a long, b long"), met


def open_links(index: DataFrame, answers: DataFrame, sets: DataFrame, labels: DataFrame, whole: bool, scratch: Scratch, name: str) -> tuple[DataFrame, bool]:
    """(links (a, b) that connect labels, whether nothing was left): few pairs from their pivot, the members of many in cells."""
    rows, lists = open_pairs(index, labels, whole, scratch, name)
    pairs = rows.where("b is not null").groupBy("a", "b").agg(F.min("pivot").alias("pivot"))
    members = scratch.keep(_labelled(rows.where("b is null").select("pivot", F.col("a").alias("rep")).distinct(), labels), f"{name}-members")
    links, groups = linked_in_cells(members, sets, whole, scratch, name)
    links = scratch.keep(derived_answers(pairs, answers, sets).union(links).distinct(), f"{name}-links")
    for part in ("-entries", "-lists", "", "-members", "-groups"):
        scratch.drop(f"{name}{part}")
    return links, lists and groups


def derived_answers(pairs: DataFrame, answers: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) among open pairs: from both sets' differences to their pivot, or from the sets where it isn't similar to both."""
    one = answers.select(F.col("pivot").alias("_p1"), F.col("rep").alias("_r1"), "n_pivot", F.col("n").alias("n_a"), F.col("minus").alias("minus_a"), F.col("plus").alias("plus_a"))
    two = answers.select(F.col("pivot").alias("_p2"), F.col("rep").alias("_r2"), F.col("n").alias("n_b"), F.col("minus").alias("minus_b"), F.col("plus").alias("plus_b"))
    rows = pairs.join(one, (F.col("pivot") == F.col("_p1")) & (F.col("a") == F.col("_r1"))).join(two, (F.col("pivot") == F.col("_p2")) & (F.col("b") == F.col("_r2")))
    similar = F.col("minus_a").isNotNull() & F.col("minus_b").isNotNull()

    def derive(batches):
        for batch in batches:
            a, b = [], []
            get = [batch.column(k) for k in ("minus_a", "minus_b", "plus_a", "plus_b")]
            n_pivot, n_a, n_b, left, right = (batch.column(k).to_pylist() for k in ("n_pivot", "n_a", "n_b", "a", "b"))
            for row in range(batch.num_rows):
                minus_a, minus_b, plus_a, plus_b = (np.frombuffer(g[row].as_buffer(), "<u8") for g in get)
                both = len(minus_a) + len(minus_b) - len(np.intersect1d(minus_a, minus_b, assume_unique=True))
                overlap = n_pivot[row] - both + len(np.intersect1d(plus_a, plus_b, assume_unique=True))
                if linked(overlap, n_a[row], n_b[row]):
                    a.append(left[row])
                    b.append(right[row])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def compare(batches):
        for batch in batches:
            keep = []
            for row, (x, y) in enumerate(zip(_grams(batch.column("grams_a")), _grams(batch.column("grams_b")), strict=True)):
                if linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)):
                    keep.append(row)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    far = rows.where(~similar).select("a", "b")
    for side in "ab":
        far = far.join(sets.select(F.col("rep").alias(f"_{side}"), F.col("grams").alias(f"grams_{side}")), F.col(side) == F.col(f"_{side}")).drop(f"_{side}")
    return rows.where(similar).mapInArrow(lean(derive), "a long, b long").union(far.mapInArrow(lean(compare), "a long, b long"))


def join(docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", n: int = N) -> tuple[DataFrame, DataFrame]:
    """(documents, links): a row per document (doc_id, n_shingles, representative, component_id), and
    spanning links (a, b) between class representatives: enough of them to connect each component, not all of them."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = text_bytes(docs, "text")
    buckets = max(32, -(-size // BUCKET_BYTES))
    seen = scratch.keep(screen(docs, n, buckets), "screen")
    sets_of = seen.where("s2 is not null").select("doc_id", "n", "s1", "s2")
    classes = scratch.keep(sets_of.where("doc_id is not null and n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep")), "classes")
    shared = seen.where("shared is not null").groupBy(F.col("s1").alias("_s1")).agg(F.sum("shared").alias("shared"))
    survivors = classes.join(shared, F.col("s1") == F.col("_s1")).where(F.col("shared") * 4 >= F.col("n")).select("rep", "s1")
    sets = scratch.keep(survivor_sets(docs.where("doc_id is not null"), scratch.keep(survivors, "survivors"), n), "sets")
    gram_bytes = int(sets.agg(F.sum(F.col("n"))).first()[0] or 0) * 8
    sets = sets.withColumn("block", F.pmod(F.xxhash64("rep"), F.lit(max(32, -(-gram_bytes // BUCKET_BYTES)))))
    index = scratch.keep(postings(sets, frequencies(sets, max(32, -(-gram_bytes // BUCKET_BYTES)))), "index")

    first = index.groupBy(F.col("gram").alias("_gram")).agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    first = scratch.keep(first, "first")
    stars = index.join(first, F.col("gram") == F.col("_gram")).where("rep <> pivot").select("pivot", "rep").distinct()
    answers = scratch.keep(pivot_answers(stars, sets, scratch), "answers")
    near = answers.where(linked(F.col("overlap"), F.col("n_pivot"), F.col("n"))).select(F.col("pivot").alias("a"), F.col("rep").alias("b"))
    links, done, whole = near, False, False
    while not done:
        name = "rest" if whole else "open"
        far, done = open_links(index, answers, sets, components(links, scratch, f"{name}-near"), whole, scratch, name)
        links, whole = links.union(far), True
    links = scratch.keep(links.distinct(), "links")
    joined = components(links, scratch, "all")
    for name in ("sets", "survivors", "index", "first", "pairs", "salted", "answers", "open-links", "rest-links"):
        scratch.drop(name)

    member = classes.join(joined, F.col("rep") == F.col("node"), "left").select(
        F.col("n").alias("_n"), F.col("s1").alias("_s1"), F.col("s2").alias("_s2"), "rep", F.coalesce("component", "rep").alias("component")
    )
    member = small(scratch.keep(member, "member"))
    out = sets_of.join(member, (F.col("n") == F.col("_n")) & (F.col("s1") == F.col("_s1")) & (F.col("s2") == F.col("_s2")), "left")
    here = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.col("rep"), F.col("doc_id")))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), here.alias("representative"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce(F.col("component"), F.col("doc_id"))).alias("component_id"),
    ), links


def op4_ngram_join(spark, sf_dir: str) -> DataFrame:
    out, _ = join(table(spark, sf_dir, "documents"), Scratch(spark, "op4"))
    return out.select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), w AS (
  SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), e AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * c >= 75 * (na.n + nb.n - c)
), r AS (
  SELECT doc_id AS id, doc_id AS c FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) m ON m.id = d.doc_id
"""

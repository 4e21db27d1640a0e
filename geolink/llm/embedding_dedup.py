"""Operator 10: embedding near-dedup on a robust-pruned flat graph.

1.  Equal vectors form one node with a multiplicity.
2.  Spherical k-means on a bounded sample (``SAMPLE`` rows by id hash) gives
    cluster shards; every node joins several of its nearest, so shards overlap.
    A pair is only found in a shard that both its nodes join, so the number
    (``overlap``) grows with the number of shards.  A shard beyond ``MOST`` nodes
    is split again in the same way, by a bounded sample of its own.
3.  Each shard builds a robust-pruned graph (``flat_graph``) by inserting its nodes,
    whose candidates a greedy search finds; a node's lists from its shards unite.
4.  Every node is searched for from the shard's medoids and its own list, greedily,
    and expands through whatever lies in range.  Hits count once verified in double
    precision; shards return counts and local roots, never pairs.
5.  Groups of near copies so large that the sample shows them get a pivot.  Nodes
    within half the threshold's angle of it are all linked with each other (angles
    obey the triangle inequality), which is counted, not compared.  Other nodes
    near such a pivot are compared with its group exactly, block by block.
6.  Clusters of a sample that lie in range of each other aren't split apart.  A
    shard that is one such group of near copies, too small for a pivot but beyond
    ``MOST``, is compared exactly, block by block: nearly all its pairs are links.

``recall`` audits the links against brute force for the rows whose id is
divisible by 100.

Defined results
    null, zero, null or non-finite components  n_links 0, a component of its own
    another length than most vectors have      likewise
    null id             n_links 0, component null, kept false
    equal vectors, repeated rows  linked like any others; ``kept`` holds for every row with the smallest id
    ties at the threshold  cosine >= threshold in double precision links
    empty table         no rows
    extra columns       ignored
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolink.llm.common import Scratch, small, table
from geolink.llm.components import components
from geolink.llm.flat_graph import build, padded, range_search

THRESHOLD = 0.95
#: Rows of the sample of the table; wanted nodes in a shard; nodes beyond which it is split (four times as
#: many: the parts and the shards that a node joins are reckoned from the wanted size); rows in an exact block.
SAMPLE, SHARD, MOST, BLOCK = 8_192, 500, 2_000, 1_000
#: Rows of the sample of a shard that is split, rows placed at a time, how often shards are split at most.
PART_SAMPLE, PLACED, LEVELS = 4_096, 8_192, 4
#: Sample rows in range of each other that make a pivot; safety margin of angles.
PIVOT_ROWS, MARGIN = 3, 1e-6


def _unit(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_clusters(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Unit centroids by spherical k-means, seeded with evenly spaced rows."""
    centre = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[a : a + 1024] @ centre.T).argmax(axis=1) for a in range(0, len(x), 1024)])
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), centre)
    return centre


def overlap(k: int) -> int:
    """Shards that each node joins, of ``k``: enough that near pairs share one, however many shards there are."""
    return min(k, max(3, math.ceil(math.log2(k) / 2)))


def find_pivots(x: np.ndarray, threshold: float) -> np.ndarray:
    """Centres of the sample's large near-copy groups, more than twice the threshold's angle apart."""
    count = np.concatenate([((x[a : a + 1024] @ x.T) >= threshold).sum(axis=1) for a in range(0, len(x), 1024)])
    pivots = np.zeros((0, x.shape[1]))
    apart = math.cos(2 * math.acos(threshold) + MARGIN)
    for i in np.argsort(-count, kind="stable"):
        if count[i] < PIVOT_ROWS + 1:
            break
        if len(pivots) and (pivots @ x[i]).max() > threshold:
            continue
        mean = x[(x @ x[i]) >= threshold].mean(axis=0)
        mean /= np.linalg.norm(mean)
        if not len(pivots) or (pivots @ mean).max() < apart:
            pivots = np.vstack([pivots, mean])
    return pivots


def cluster_parts(x: np.ndarray, centre: np.ndarray, threshold: float) -> np.ndarray:
    """The part each cluster belongs to: clusters of which half the sample rows reach another's rows are one part."""
    own, k = (x @ centre.T).argmax(axis=1), len(centre)
    reach = np.zeros((k, k))
    for a in range(0, len(x), 1024):
        i, j = np.nonzero(x[a : a + 1024] @ x.T >= threshold)
        key = np.unique((a + i) * k + own[j])
        np.add.at(reach, (own[key // k], key % k), 1)
    together = (reach >= 2) & (reach >= np.bincount(own, minlength=k)[:, None] / 2)
    i, j = np.nonzero(together)
    return np.unique(_roots(np.arange(k), i, j), return_inverse=True)[1]


def _roots(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest id each node reaches through the pairs (i, j)."""
    label = ids.copy()
    while len(i):
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        if (new == label).all():
            break
        label = new
    return label


def counted_here(shards: list[list[int]], i: np.ndarray, j: np.ndarray, here: int) -> np.ndarray:
    """Of pairs found here those whose smallest shared shard this is: there, and only there, a pair counts."""
    at = np.full((len(shards), max(map(len, shards), default=1)), -1, dtype=np.int64)
    for r, row in enumerate(shards):
        at[r, : len(row)] = row
    out = np.zeros(len(i), dtype=bool)
    for a in range(0, len(i), 1 << 16):
        one, two = at[i[a : a + (1 << 16)]], at[j[a : a + (1 << 16)]]
        shared = (one >= 0) & (one[:, :, None] == two[:, None, :]).any(axis=2)
        out[a : a + (1 << 16)] = np.where(shared, one, here).min(axis=1) == here
    return out


def _answer(ids: np.ndarray, mult: np.ndarray, i: np.ndarray, j: np.ndarray, counted: np.ndarray) -> pa.Table:
    """Links that count and roots of a shard's nodes, from its pairs (i, j), each once."""
    links = np.zeros(len(ids), dtype=np.int64)
    np.add.at(links, i[counted], mult[j[counted]])
    np.add.at(links, j[counted], mult[i[counted]])
    return pa.table({"id": pa.array(ids, pa.int64()), "links": pa.array(links, pa.int64()), "root": pa.array(_roots(ids, i, j), pa.int64())})


def _matrix(t: pa.Table, k: str = "x") -> np.ndarray:
    return np.frombuffer(b"".join(t[k].to_pylist()), np.float64).reshape(len(t), -1)


def split_shards(placed: DataFrame, homes: DataFrame, joins: int, threshold: float, scratch: Scratch) -> DataFrame:
    """``id, shards`` (similarity, shard) after splitting each shard beyond ``MOST`` nodes by a sample of its own.

    A node keeps the ``joins`` nearest of all the shards and parts that it could join.
    """
    within, most = 2 * SHARD, MOST

    def fit(group: pa.Table) -> pa.Table:
        x, shard = _matrix(group), group["shard"][0].as_py()
        k = min(-(-group["size"][0].as_py() * joins // within), len(x) // 4)
        centre = fit_clusters(x, k) if k > 1 else x[:1]
        part = cluster_parts(x, centre, threshold)
        return pa.table({"shard": pa.array([shard] * len(centre), pa.int64()), "centre": pa.array([c.tobytes() for c in centre], pa.binary()), "part": pa.array(part, pa.int64()), "parts": pa.array([part.max() + 1] * len(centre), pa.int64())})

    def deal(rows: pa.Table, centres: pa.Table) -> pa.Table:
        none = np.zeros(0)
        ids, near, to = none, none, none
        if len(rows) and len(centres):
            s, part = _matrix(rows) @ _matrix(centres, "centre").T, centres["part"].to_numpy()
            order = np.argsort(part, kind="stable")
            s = np.maximum.reduceat(s[:, order], np.flatnonzero(np.diff(part[order], prepend=-1)), axis=1)
            take = min(joins, s.shape[1])
            top = np.argpartition(-s, take - 1, axis=1)[:, :take]
            ids, near = np.repeat(rows["id"].to_numpy(), take), np.take_along_axis(s, top, axis=1).ravel()
            to = ((rows["shard"][0].as_py() + 1) * 4096 + top).ravel()
        return pa.table({"id": pa.array(ids, pa.int64()), "near": pa.array(near, pa.float64()), "to": pa.array(to, pa.int64())})

    for level in range(LEVELS):
        joined = homes.select("id", F.explode("shards").alias("home")).select("id", "home.near", "home.shard")
        sizes = scratch.keep(joined.groupBy("shard").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > most), f"large{level}")
        if sizes.isEmpty():
            break
        large = joined.join(small(sizes), "shard").join(placed.select("id", "x"), "id")
        drawn = F.pmod(F.xxhash64("id", F.lit(level)), F.lit(1 << 30)) < F.lit(float(PART_SAMPLE << 30)) / F.col("size")
        fits = scratch.keep(large.where(drawn).select("shard", "size", "x").groupBy("shard").applyInArrow(fit, "shard long, centre binary, part long, parts long"), f"fits{level}").where("parts > 1")
        cut = fits.groupBy("shard").agg(F.first("parts").alias("parts")).join(sizes, "shard")
        if cut.isEmpty():
            break
        salts = F.ceil(F.col("size") / PLACED)
        rows = large.join(small(cut.select("shard")), "shard").select("shard", F.pmod(F.xxhash64("id"), salts).alias("salt"), "id", "x")
        centres = fits.join(sizes, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), "centre", "part")
        dealt = rows.groupBy("shard", "salt").cogroup(centres.groupBy("shard", "salt")).applyInArrow(deal, "id long, near double, to long")
        stay = joined.join(small(cut.select("shard")), "shard", "left_anti").select("id", "near", F.col("shard").alias("to"))
        every = stay.unionByName(dealt).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("near", F.col("to").alias("shard"))), asc=False).alias("shards"))
        homes = scratch.keep(every.select("id", F.slice("shards", 1, joins).alias("shards")), f"homes{level}")
    return homes


def near_duplicates(vectors: DataFrame, scratch: Scratch, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    # scaled before squaring, so that no finite vector over- or underflows
    most = F.array_max(F.transform("v", F.abs))
    sound = rows.where("vec_id is not null and v is not null").where(F.size("v") > 0).where(~bad).where(most > 0)
    sound = sound.withColumn("v", F.transform("v", lambda e: e / most))
    length = sound.groupBy(F.size("v").alias("k")).count().orderBy(F.desc("count"), "k").limit(1).collect()
    if not length:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    nodes = scratch.keep(sound.where(F.size("v") == length[0]["k"]).groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("mult")), "nodes")
    total = nodes.count()
    sample = _unit(nodes.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()["v"])
    most_centres = len(sample) // 4 or 1
    # of twice SHARD nodes on average, whatever the overlap
    wanted = -(-total * overlap(-(-total // SHARD)) // (2 * SHARD))
    centres = fit_clusters(sample, max(1, min(wanted, most_centres)))
    joins, first = overlap(max(wanted, 1)), min(overlap(max(wanted, 1)), len(centres))
    pivots = find_pivots(sample, threshold)
    half, wide = math.acos(threshold) / 2 - MARGIN, 1.5 * math.acos(threshold) + MARGIN

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch.column("v"))
            core = np.full(len(x), -1)
            near: list[list[int]] = [[] for _ in range(len(x))]
            if len(pivots):
                s = x @ pivots.T
                best = s.argmax(axis=1)
                core = np.where(s.max(axis=1) >= math.cos(half), best, -1)
                for i, k in zip(*np.nonzero((s >= math.cos(wide)) & (core < 0)[:, None]), strict=True):
                    near[i].append(int(k))
            s = x @ centres.T
            nearest = np.argpartition(-s, first - 1, axis=1)[:, :first]
            homes = pa.StructArray.from_arrays([np.take_along_axis(s, nearest, axis=1).ravel(), nearest.ravel()], names=["near", "shard"])
            homes = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * first, pa.int32()), homes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("mult"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(core, pa.int64()), pa.array(near, pa.list_(pa.int64())), homes],
                names=["id", "mult", "x", "core", "near", "shards"],
            )

    placed = scratch.keep(nodes.mapInArrow(place, "id long, mult long, x binary, core long, near array<long>, shards array<struct<near:double,shard:long>>"), "placed")
    core = small(scratch.keep(placed.where("core >= 0").groupBy(F.col("core").alias("_core")).agg(F.sum("mult").alias("core_mult"), F.min("id").alias("core_root"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("core_blocks")), "core"))
    in_core = placed.where("core >= 0").join(core, F.col("core") == F.col("_core"))
    in_core = in_core.select("id", (F.col("core_mult") - F.col("mult")).alias("links"), F.col("core_root").alias("root"))

    # shards of the other nodes
    homes = split_shards(placed, placed.where("core < 0").select("id", "shards"), joins, threshold, scratch)
    loose = placed.where("core < 0").select("id", "mult", "x").join(homes.select("id", F.col("shards.shard").alias("shards")), "id")
    loose = loose.select("id", "mult", "x", "shards", F.explode("shards").alias("shard"))
    sizes = small(scratch.keep(loose.groupBy(F.col("shard").alias("_shard")).agg(F.count(F.lit(1)).alias("size")), "sizes"))
    loose = loose.join(sizes, F.col("shard") == F.col("_shard")).drop("_shard")
    members = scratch.keep(loose.where(F.col("size") <= MOST).drop("size"), "members")

    def graph_of(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        ids = group["id"].to_numpy()
        lists = build(_matrix(group).astype(np.float32), np.random.default_rng(len(ids)))
        return pa.table({"id": pa.array(ids, pa.int64()), "near": pa.array([ids[a[a >= 0]] for a in lists], pa.list_(pa.int64()))})

    graph = members.select("shard", "id", "x").groupBy("shard").applyInArrow(graph_of, "id long, near array<long>")
    union = graph.groupBy(F.col("id").alias("_id")).agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))

    def search(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        ids, mult, shard = group["id"].to_numpy(), group["mult"].to_numpy(), group["shard"][0].as_py()
        # the united lists, as far as they lead to nodes of this shard
        length = [len(a or ()) for a in group["near"].to_pylist()]
        to = np.array([t for a in group["near"].to_pylist() for t in a or ()], dtype=np.int64)
        at = np.minimum(np.searchsorted(ids, to), len(ids) - 1)
        here = ids[at] == to
        lists = padded(np.repeat(np.arange(len(ids)), length)[here], at[here], len(ids), -1)
        i, j = range_search(_matrix(group), lists, threshold)
        return _answer(ids, mult, i, j, counted_here(group["shards"].to_pylist(), i, j, shard))

    searched = members.join(union, F.col("id") == F.col("_id")).drop("_id").groupBy("shard").applyInArrow(search, "id long, links long, root long")

    # exact block comparisons: large groups of near copies without a pivot, and nodes near a pivot's group
    blocks = F.ceil(F.col("size") / BLOCK)
    large = loose.where(F.col("size") > MOST).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    large = large.select("id", "mult", "x", "shards", F.col("shard").alias("key"), F.lit(False).alias("core"), F.col("own"), F.explode(cells).alias("cell"))
    beside = placed.select("id", "mult", "x", F.explode("near").alias("key")).join(core, F.col("key") == F.col("_core"))
    beside_blocks = small(scratch.keep(beside.groupBy(F.col("key").alias("_key")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")), "beside"))
    one = beside.join(beside_blocks, F.col("key") == F.col("_key")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    one = one.select("id", "mult", "x", F.array().cast("array<bigint>").alias("shards"), (-1 - F.col("key")).alias("key"), F.lit(False).alias("core"), "own",
        F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("core_blocks") - 1), lambda i: F.struct(i.alias("i"), F.col("own").alias("j")))).alias("cell"))
    two = placed.where("core >= 0").select("id", "mult", "x", F.col("core").alias("key")).join(beside_blocks, F.col("key") == F.col("_key")).join(core, F.col("key") == F.col("_core"))
    two = two.withColumn("own", F.pmod(F.xxhash64("id"), F.col("core_blocks"))).select("id", "mult", "x", F.array().cast("array<bigint>").alias("shards"), (-1 - F.col("key")).alias("key"), F.lit(True).alias("core"), "own",
        F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.struct(F.col("own").alias("i"), j.alias("j")))).alias("cell"))

    def exact(group: pa.Table) -> pa.Table:
        ids, mult, own, key = group["id"].to_numpy(), group["mult"].to_numpy(), group["own"].to_numpy(), group["key"][0].as_py()
        x, is_core = _matrix(group), group["core"].to_numpy(zero_copy_only=False)
        i, j = (pa.compute.struct_field(group["cell"].combine_chunks(), k)[0].as_py() for k in ("i", "j"))
        found = (x @ x.T) >= threshold
        if key < 0:
            found &= is_core[:, None] != is_core[None, :]
        elif i != j:
            found &= own[:, None] != own[None, :]
        p, q = np.nonzero(np.triu(found, 1))
        return _answer(ids, mult, p, q, counted_here(group["shards"].to_pylist(), p, q, key) if key >= 0 else np.ones(len(p), dtype=bool))

    compared = large.unionByName(one).unionByName(two).groupBy("key", "cell").applyInArrow(exact, "id long, links long, root long")

    answers = scratch.keep(in_core.unionByName(searched).unionByName(compared), "answers")
    joined = components(answers.select(F.col("id").alias("a"), F.col("root").alias("b")), scratch)
    links = answers.groupBy("id").agg(F.sum("links").alias("links"))
    result = nodes.join(links.withColumnRenamed("id", "_a"), F.col("id") == F.col("_a"), "left").join(joined, F.col("id") == F.col("node"), "left")
    result = scratch.keep(result.select("v", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links"), F.coalesce("component", "id").alias("component")), "result")
    for name in ("nodes", "placed", "core", "sizes", "members", "beside", "answers", *(f"{kind}{level}" for kind in ("large", "fits", "homes") for level in range(LEVELS))):
        scratch.drop(name)
    scaled = F.when(F.col("v").isNotNull() & (F.size("v") > 0) & ~bad & (most > 0), F.transform("v", lambda e: e / most))
    out = rows.withColumn("w", scaled).join(result.withColumnRenamed("v", "_v"), F.col("w") == F.col("_v"), "left")
    own = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select(
        "vec_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        own.alias("component_id"), F.coalesce(own == F.col("vec_id"), F.lit(False)).alias("kept"),
    )


def recall(vectors: DataFrame, found: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, every: int = 100) -> float:
    """Share of true links that ``found`` counts, for the rows whose id is divisible by ``every``.

    Brute force: blocks of queries meet blocks of rows, none of them through the driver.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where("id is not null and v is not null").where(~F.exists("v", lambda e: e.isNull() | F.isnan(e))).where(F.exists("v", lambda e: e != 0))
    asked, to = -(-rows.where(F.col("id") % every == 0).count() // 1_000) or 1, -(-rows.count() // 20_000) or 1
    every_block = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = rows.where(F.col("id") % every == 0).select("id", "v", F.pmod(F.xxhash64("id"), F.lit(asked)).cast("int").alias("q"), every_block(to).alias("r"))
    against = rows.select("v", every_block(asked).alias("q"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(to)).cast("int").alias("r"))

    def count(some: pa.Table, block: pa.Table) -> pa.Table:
        hits = (_unit(some["v"]) @ _unit(block["v"]).T >= threshold).sum(axis=1) if len(some) and len(block) else np.zeros(len(some), np.int64)
        return pa.table({"id": some["id"].cast(pa.int64()), "hits": pa.array(hits, pa.int64())})

    true = queries.groupBy("q", "r").cogroup(against.groupBy("q", "r")).applyInArrow(count, "id long, hits long").groupBy("id").agg((F.sum("hits") - 1).alias("hits"))
    both = true.join(found, F.col("id") == F.col("vec_id")).agg(F.sum("hits").alias("t"), F.sum(F.least("hits", "n_links")).alias("f")).first()
    return both["f"] / both["t"] if both["t"] else 1.0


def op10_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), Scratch(spark, "op10"))


def op10_near_copies(spark, sf_dir: str) -> DataFrame:
    """The embeddings, each with a scaled and a perturbed copy: cosines from 0.94 to 1, so links are found and missed."""
    rows = table(spark, sf_dir, "embeddings")
    id_ = F.col("vec_id")
    swing = lambda i: 1 + (F.lit(0.1) + F.lit(0.05) * (id_ % 10)) * (((id_ * 7 + i.cast("long") * 13) % 11 - 5) / F.lit(5.0))
    one = F.transform("embedding", lambda e: e.cast("double"))
    copies = F.array(one, F.transform(one, lambda e: e * 1.5), F.transform(one, lambda e, i: e * swing(i)))
    each = rows.select("vec_id", F.posexplode(copies).alias("k", "embedding")).select((id_ * 3 + F.col("k")).alias("vec_id"), "embedding")
    return near_duplicates(each, Scratch(spark, "op10-copies"))


SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), u AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE list_dot_product(e, e) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95
), r AS (
  SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id
)
SELECT vec_id, coalesce(k.n, 0)::BIGINT AS n_links, m.c AS component_id, m.c = vec_id AS kept
FROM embeddings LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) k ON k.a = vec_id JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) m ON m.id = vec_id
"""
#: The same over the table with its copies.
COPIES_SQL = SQL.replace("WITH RECURSIVE v AS (", """WITH RECURSIVE copies AS (
  SELECT vec_id * 3 AS vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS embedding FROM embeddings UNION ALL
  SELECT vec_id * 3 + 1, list_transform(embedding, lambda x: x::DOUBLE * 1.5::DOUBLE) FROM embeddings UNION ALL
  SELECT vec_id * 3 + 2, list_transform(embedding, lambda x, i: x::DOUBLE * (1 + (0.1::DOUBLE + 0.05::DOUBLE * (vec_id % 10)) * (((vec_id * 7 + (i - 1) * 13) % 11 - 5) / 5.0::DOUBLE))) FROM embeddings
), v AS (""").replace("FROM embeddings\n  WHERE", "FROM copies\n  WHERE").replace("AS c FROM embeddings UNION", "AS c FROM copies UNION").replace("FROM embeddings LEFT JOIN", "FROM copies LEFT JOIN")

"""Substring, n-gram, line and embedding dedup against brute force and on edge cases."""

import hashlib
import re
import subprocess
import sys
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from geolink.llm import embedding_dedup, flat_graph, hashblocks, line_dedup, ngram_join, substring_dedup
from geolink.llm.common import Scratch
from geolink.llm.components import components
from geolink.llm.queries import QUERIES

DOCS = "doc_id long, text string, extra string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(n, seed):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list("abcdefg"), 6)) for _ in range(n)]


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x") if len(r) == 2 else r for r in rows], DOCS)


def brute_substring(rows, length=50):
    first = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - length + 1):
            g = tuple(w[i : i + length])
            if d is not None:
                first[g] = min(first.get(g, d), d)
    out = []
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - length + 1):
            if d is not None and first[tuple(w[i : i + length])] < d:
                gone |= set(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("flush", [1 << 19, 300])
def test_substring_against_brute_force(spark, monkeypatch, flush):
    monkeypatch.setattr(substring_dedup, "FLUSH", flush)
    a, b, c = words(120, 1), words(70, 2), words(60, 3)
    rows = [(5, " ".join(a)), (3, " ".join(c + a[10:80] + b)), (9, "\n".join(a[:49])), (7, " ".join(b[:55] + c[:20] + a[:60])), (8, " ".join(a)), (2, None), (1, " \n "), (4, " ".join(["x"] * 200)), (6, " ".join(["x"] * 90 + c)),
            (None, " ".join(a)), (8, " ".join(a)), (10, "Ünï\tcödé " + " ".join(b))]
    got = substring_dedup.remove_repeats(docs(spark, rows).repartition(3), buckets=7, keep=("extra",)).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=str) == brute_substring(rows)
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256


def test_packed_hashes_lose_nothing():
    rng = np.random.default_rng(2)
    for buckets in (5, 256, 1000):
        h, d = rng.integers(0, 1 << 64, 5000, dtype=np.uint64), np.sort(rng.integers(-9, 1 << 40, 5000))
        h[1::2] = h[::2] ^ (rng.integers(0, 256, 2500, dtype=np.uint64) << np.uint64(56))  # pairs that differ in the top byte alone
        p, c = np.arange(5000, dtype=np.int32), rng.integers(0, 1 << 16, 5000).astype(np.uint16)
        for _, at in hashblocks.by_bucket(h, buckets):
            h2, d2, p2, c2 = hashblocks.unpack(hashblocks.pack(h[at], d[at], p[at], c[at], buckets), checks=True, buckets=buckets)
            assert (d2 == d[at]).all() and (p2 == p[at]).all() and (c2 == c[at]).all()
            assert len(np.unique(h2)) == len(np.unique(h[at])) and (np.unique(h2, return_inverse=True)[1][np.argsort(h[at])[:1]] >= 0).all()


def test_substring_empty(spark):
    assert substring_dedup.remove_repeats(docs(spark, [])).count() == 0


def thue_morse(n, swap=False):
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


def test_structured_words_do_not_collide(spark):
    """Words that any polynomial modulo a power of two takes for equal, alone and as sequences of words."""
    pairs = [(thue_morse(n), thue_morse(n, True)) for n in (1024, 2048, 4096)]
    rows = []
    for k, (x, y) in enumerate(pairs):
        rows += [(10 * k + 1, " ".join([x] * 60)), (10 * k + 2, " ".join([y] * 60)), (10 * k + 3, " ".join([x] * 60 + ["tail"]))]
    rows += [(100, " ".join(thue_morse(1024))), (101, " ".join(thue_morse(1024, True)))]
    got = substring_dedup.remove_repeats(docs(spark, rows), buckets=5).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=str) == brute_substring(rows)
    out, _ = ngram_join.join(docs(spark, rows), Scratch(spark, "t"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == brute_ngram(rows)


def brute_ngram(rows, n=5):
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[d] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else (frozenset([tuple(w)]) if w else frozenset())
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def near_copies():
    rng = np.random.default_rng(4)
    rows, base = [], words(100, 5)
    for k in range(120):  # one group with chains around the threshold
        w = list(base)
        for i in rng.integers(0, 100, rng.integers(0, 6)):
            w[i] = f"n{k}x{i}"
        rows.append((k + 10, " ".join(w)))
    for g in range(15):
        own = words(40, 100 + g)
        for k in range(4):
            w = list(own)
            for i in rng.integers(0, 40, k):
                w[i] = f"m{k}"
            rows.append((1000 + 10 * g + k, " ".join(w)))
    exact = words(4 * 4 + 4, 77)
    return rows + [(1, "Short text"), (2, "short TEXT"), (3, None), (4, ""), (5, "a b c d e"), (6, "a b c d f"), (7, " ".join(exact)), (8, " ".join(exact[:-4]))]


def test_ngram_against_brute_force(spark):
    rows = near_copies()
    out, links = ngram_join.join(docs(spark, rows).repartition(3), Scratch(spark, "t"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()}
    assert got == brute_ngram(rows)
    assert links.count() > 0


def test_ngram_blocks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 3)
    monkeypatch.setattr(ngram_join, "PIVOT_ROWS", 5)
    monkeypatch.setattr(ngram_join, "FLUSH", 500)
    rows = near_copies()
    out, _ = ngram_join.join(docs(spark, rows).repartition(3), Scratch(spark, "t"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == brute_ngram(rows)


def test_ngram_pivots_that_are_not_similar(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SIMILAR", 2.0)
    rows = near_copies()
    out, _ = ngram_join.join(docs(spark, rows).repartition(3), Scratch(spark, "t"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == brute_ngram(rows)


class Counted(Scratch):
    """Rows of every table that is kept."""

    def __init__(self, spark, name):
        super().__init__(spark, name)
        self.rows = {}

    def keep(self, df, name, **options):
        out = super().keep(df, name, **options)
        self.rows[name] = out.count()
        return out


def one_template(apart, count=160):
    """Texts that each lack a few words of one template: pairs share about three quarters of their grams, some of them rare ones."""
    rng, base = np.random.default_rng(8), words(100, 5)
    out = [(k + 10, " ".join(np.delete(base, rng.choice(100, apart, replace=False)))) for k in range(count)]
    return [(1, " ".join(base)), *out]


@pytest.mark.parametrize("block", [256, 16])
def test_ngram_rows_of_a_large_group_do_not_grow_with_its_square(spark, monkeypatch, block):
    """Before, one row a pair of index list members that no pivot connects."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)
    rows, scratch = one_template(4), Counted(spark, "t")
    out, links = ngram_join.join(docs(spark, rows).repartition(3), scratch)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == brute_ngram(rows)
    assert scratch.rows["open"] <= 6 * len(rows)
    assert links.count() < 4 * len(rows)


def test_blank_and_common_texts_are_dealt_out(spark):
    many = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, "one licence line that very many documents hold").otherwise(F.concat(F.lit("the same five words here "), "id")).alias("text"))
    buckets = 37
    seen = ngram_join.screen(many, 5, buckets)
    per = [r["count"] for r in seen.where("s2 is not null").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per) == 60_000 and max(per) < 4 * 60_000 / len(per)
    out, _ = ngram_join.join(many, Scratch(spark, "t"))
    got = out.groupBy("n_shingles").agg(F.count_distinct("component_id").alias("c"), F.count(F.lit(1)).alias("n")).orderBy("n_shingles").collect()
    assert [(r.n_shingles, r.c, r.n) for r in got] == [(0, 20_000, 20_000), (2, 20_000, 20_000), (4, 1, 20_000)]


SCREENING = """
import re, sys
sys.path.insert(0, sys.argv[1])
import numpy as np, pyarrow as pa
from geolink.llm import ngram_join

def held():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

class Docs:
    def mapInArrow(self, f, schema):
        self.task = f
        return self
    def groupBy(self, *keys):
        return self
    def applyInArrow(self, f, schema):
        return self

rng = np.random.default_rng(1)
names = ["doc_id", "text"]
def batches():
    for k in range(3):
        texts = [" ".join(map(str, rng.integers(0, 1 << 40, 400).tolist())) for _ in range(2000)]
        yield pa.RecordBatch.from_arrays([pa.array(range(2000 * k, 2000 * k + 2000), pa.int64()), pa.array(texts)], names=names)

for _ in batches():
    pass
del _
docs = Docs()
ngram_join.screen(docs, 5, 32)
first = held()
for _ in docs.task(batches()):
    pass
del _
print(first, held())
"""


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_screening_gives_its_memory_back():
    """What a task has freed doesn't stay with its worker, which later stages share."""
    root = str(Path(__file__).resolve().parents[2])
    first, last = map(float, subprocess.run([sys.executable, "-c", SCREENING, root], capture_output=True, text=True, check=True, timeout=120).stdout.split())
    assert last - first < 10, (first, last)  # it was 28 MB more, and is 53 less


def test_ngram_edges(spark):
    text = " ".join(words(30, 9))
    out, _ = ngram_join.join(docs(spark, [(2, text), (2, text), (1, text.upper()), (None, text), (3, None)]), Scratch(spark, "t"))
    got = sorted([(r.doc_id, r.n_shingles, r.component_id) for r in out.collect()], key=str)
    assert got == sorted([(2, 26, 1), (2, 26, 1), (1, 26, 1), (None, 26, None), (3, 0, 3)], key=str)
    assert ngram_join.join(docs(spark, []), Scratch(spark, "t"))[0].count() == 0


def test_threshold_is_exact():
    assert ngram_join.linked(75, 100, 75) and not ngram_join.linked(74, 100, 74) and ngram_join.linked(6, 7, 7)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def brute_lines(rows, run=3, words=50):
    first, lines = {}, []

    def runs(all_, solid):
        for size in [*range(1, run if words else 1), run]:
            for s in range(len(solid) - size + 1):
                body = tuple(all_[i] for i in solid[s : s + size])
                if size == run or sum(len(WORD.findall(l)) for l in body) >= words:
                    yield s, body

    for d, t in rows:
        all_ = (t or "").split("\n")
        solid = [i for i, l in enumerate(all_) if WORD.search(l)]
        lines.append((all_, solid))
        for s, body in runs(all_, solid):
            if d is not None:
                first[body] = min(first.get(body, (d, s)), (d, s))
    out = []
    for (d, _), (all_, solid) in zip(rows, lines, strict=True):
        gone = set()
        for s, body in runs(all_, solid):
            if d is not None and first[body] < (d, s):
                gone |= set(solid[s : s + len(body)])
        out.append((d, len(solid), len(gone), "\n".join(l for i, l in enumerate(all_) if i not in gone)))
    return sorted(out, key=str)


def test_lines_of_few_kinds_against_brute_force(spark):
    """Many documents of three kinds of line: fingerprints repeat in every surrounding there is."""
    rng = np.random.default_rng(6)
    kinds = ["x", "y", "z z", "", " ".join(words(50, 41)), " ".join(words(27, 42)), " ".join(words(30, 43))]
    rows = [(i, "\n".join(kinds[k] for k in rng.integers(0, len(kinds), rng.integers(0, 14)))) for i in range(150)]
    for words_ in (50, None):
        got = line_dedup.remove_lines(docs(spark, rows), Scratch(spark, "t"), words=words_).collect()
        assert sorted([(r.doc_id, r.n_lines, r.n_removed, r.text) for r in got], key=str) == brute_lines(rows, words=words_)


@pytest.mark.parametrize("gram,window", [(2, 2), (1, 3), (3, 2)])
def test_lines_against_brute_force(spark, gram, window):
    a = [f"line number {i}" for i in range(20)]
    rows = [(1, "\n".join(a[:8])), (2, "\n".join(["head"] + a[2:7] + ["", "tail"])), (3, "\n".join(a[5:8] + a[:3] + a[5:8])), (4, "a\na\na\na\na\na"), (5, None), (6, ""), (7, "\n\n"),
            (None, "\n".join(a[:8])), (2, "\n".join(["head"] + a[2:7] + ["", "tail"])), (8, "\n".join(a[:8])), (9, "one\ntwo")]
    got = line_dedup.remove_lines(docs(spark, rows), Scratch(spark, "t"), gram=gram, window=window, keep=("extra",)).collect()
    assert sorted([(r.doc_id, r.n_lines, r.n_removed, r.text) for r in got], key=str) == brute_lines(rows, gram + window - 1)


def test_long_passages_go_from_one_or_two_lines(spark):
    long, half, other = " ".join(words(60, 31)), " ".join(words(30, 32)), " ".join(words(30, 33))
    rows = [(1, f"head\n{long}\ntail"), (2, long), (3, f"{half}\n{other}\nend"), (4, f"start\n\n{half}\n\n{other}"), (5, half), (6, "short\nend"), (7, f"end\n{long}\ntail"), (2, long), (None, long), (8, f"{long}\n{long}")]
    got = line_dedup.remove_lines(docs(spark, rows), Scratch(spark, "t")).collect()
    want = [(1, 3, 0, rows[0][1]), (2, 1, 1, ""), (3, 3, 0, rows[2][1]), (4, 3, 2, "start\n\n"), (5, 1, 0, half), (6, 2, 0, "short\nend"), (7, 3, 2, "end"), (2, 1, 1, ""), (None, 1, 0, long), (8, 2, 2, "")]
    assert sorted([(r.doc_id, r.n_lines, r.n_removed, r.text) for r in got], key=str) == sorted(want, key=str)
    assert all(r.n_removed == 0 for r in line_dedup.remove_lines(docs(spark, rows), Scratch(spark, "t"), words=None).collect())


def test_lines_empty(spark):
    assert line_dedup.remove_lines(docs(spark, []), Scratch(spark, "t")).count() == 0


def brute_vectors(rows, threshold=0.95):
    ok = [(i, v) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.array([np.array(v, dtype=np.float32).astype(float) for _, v in ok])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T >= threshold
    ids = [i for i, _ in ok]
    label = np.array(ids)
    while True:
        new = np.array([label[s[k]].min() for k in range(len(ids))])
        if (new == label).all():
            break
        label = new
    return {i: (int(s[k].sum()) - 1, int(label[k])) for k, i in enumerate(ids)}


def vectors(n=600, groups=((200, 0.05), (30, 0.1), (5, 0.1))):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(n)]
    for k, (size, noise) in enumerate(groups):
        centre = rng.normal(size=8)
        centre /= np.linalg.norm(centre)
        for j in range(size):
            rows.append((10_000 * (k + 1) + j, (centre + noise * rng.normal(size=8) / np.sqrt(8)).tolist()))
    rows += [(5, None), (500_001, rows[3][1])]
    return [r for r in rows if r[0] != 5] + [(5, None), (6_000_001, [0.0] * 8), (6_000_002, [1.0, None] + [0.0] * 6), (6_000_003, [float("nan")] * 8), (6_000_004, [float("inf")] * 8), (6_000_005, [1.0]), (6_000_006, [])]


@pytest.mark.parametrize("most,pivot", [(2000, 3), (60, 10_000), (2000, 10_000), (60, 3)])
def test_vectors_against_brute_force(spark, monkeypatch, most, pivot):
    monkeypatch.setattr(embedding_dedup, "MOST", most)
    monkeypatch.setattr(embedding_dedup, "PIVOT_ROWS", pivot)
    monkeypatch.setattr(embedding_dedup, "SHARD", 100)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 50)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df, Scratch(spark, "t")).collect()}
    want = brute_vectors(rows)
    assert len(got) == len({i for i, _ in rows})
    assert all(got[i] == (0, i, True) for i in got if i not in want)
    assert all(got[i][2] == (got[i][1] == i) for i in got)
    links, found = sum(w[0] for w in want.values()), sum(min(got[i][0], w[0]) for i, w in want.items())
    assert found >= 0.95 * links and all(got[i][0] <= w[0] for i, w in want.items())
    assert sum(got[i][1] != w[1] for i, w in want.items()) <= 0.01 * len(want)


def test_vectors_recall_holds_with_many_shards(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD", 10)
    rng = np.random.default_rng(11)
    x, g = rng.normal(size=(2, 1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g -= (g * x).sum(axis=1, keepdims=True) * x
    g /= np.linalg.norm(g, axis=1, keepdims=True)
    rows = [(2 * i + k, v.tolist()) for i in range(1500) for k, v in enumerate((x[i], 0.953 * x[i] + np.sqrt(1 - 0.953**2) * g[i]))]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), Scratch(spark, "t")).collect()
    assert all(r.n_links <= 1 for r in got) and sum(r.n_links for r in got) >= 0.98 * len(rows)


def test_vectors_recall_and_edges(spark, sf):
    df = spark.createDataFrame([(100, [1.0, 0.0]), (200, [1.0, 0.01]), (200, [1.0, 0.01]), (None, [1.0, 0.0]), (300, [0.0, 1.0])], "vec_id long, embedding array<float>")
    found = embedding_dedup.near_duplicates(df, Scratch(spark, "t"))
    got = sorted([(r.vec_id, r.n_links, r.component_id, r.kept) for r in found.collect()], key=str)
    assert got == sorted([(100, 2, 100, True), (200, 2, 100, False), (200, 2, 100, False), (None, 0, None, False), (300, 0, 300, True)], key=str)
    assert embedding_dedup.recall(df.dropDuplicates(["vec_id"]), found) == 1.0
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicates(none, Scratch(spark, "t")).count() == 0


def test_vectors_recall_holds_when_shards_split(spark, monkeypatch):
    for name, value in (("SHARD", 40), ("MOST", 150), ("SAMPLE", 40)):
        monkeypatch.setattr(embedding_dedup, name, value)
    rng = np.random.default_rng(12)
    x = np.repeat(rng.normal(size=(400, 16)), 2, axis=0) + 0.02 * rng.normal(size=(800, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = Scratch(spark, "t").keep(embedding_dedup.near_duplicates(df, Scratch(spark, "t")), "found")
    share, links = embedding_dedup.recall(df, found, every=4), found.agg({"n_links": "sum"}).first()[0]
    assert share >= 0.95 and 760 <= links <= 800, (share, links)


def test_queries_cover_their_tables(spark, sf):
    for name, table_ in (("op3_substring_dedup", "documents"), ("op4_ngram_join", "documents"), ("op5_line_dedup", "documents"), ("op10_embedding_dedup", "embeddings")):
        assert QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/{table_}.parquet").count()


def test_op4_on_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op4_ngram_join"](spark, sf).collect()} == brute_ngram(rows)


def test_windows_meet_in_parts(spark):
    a = words(80, 21)
    rows = [(i, " ".join(a + words(5, 300 + i))) for i in range(50)]
    got = substring_dedup.remove_repeats(docs(spark, rows).repartition(5), buckets=9).collect()
    by = defaultdict(int, {r.doc_id: r.n_removed for r in got})
    assert by[0] == 0 and all(by[i] == 80 for i in range(1, 50))


def test_graph_search_finds_isolated_and_grouped_pairs():
    rng = np.random.default_rng(4)
    x, g = rng.normal(size=(2, 500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g -= (g * x).sum(axis=1, keepdims=True) * x
    g /= np.linalg.norm(g, axis=1, keepdims=True)
    group = rng.normal(size=64) + 0.15 * rng.normal(size=(300, 64))
    every = np.vstack([x, 0.953 * x + np.sqrt(1 - 0.953**2) * g, group / np.linalg.norm(group, axis=1, keepdims=True)])
    i, j = flat_graph.range_search(every, flat_graph.build(every.astype(np.float32), np.random.default_rng(1)), 0.95)
    true = np.argwhere(np.triu(every @ every.T >= 0.95, 1))
    assert {*zip(i.tolist(), j.tolist(), strict=True)} <= {*map(tuple, true.tolist())} and len(i) >= 0.99 * len(true)
    for n in (1, 2, 33):
        assert len(flat_graph.range_search(every[:n], flat_graph.build(every[:n].astype(np.float32), rng), 0.95)[0]) == 0


def test_clusters_of_one_group_stay_together():
    rng = np.random.default_rng(6)
    x = np.vstack([np.eye(8)[0] + 0.02 * rng.normal(size=(200, 8)), rng.normal(size=(400, 8))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centre = embedding_dedup.fit_clusters(x, 40)
    part = embedding_dedup.cluster_parts(x, centre, 0.95)[(x @ centre.T).argmax(axis=1)]
    assert len(set(part[:200].tolist())) == 1 and len(set(part.tolist())) > 5

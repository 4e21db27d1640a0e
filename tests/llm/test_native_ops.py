"""Mixing, sharding and quality rules: SQL oracles, laws and edge cases."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from geolink.llm import mixing, quality_rules, sharding
from geolink.llm.common import Scratch, sieve
from geolink.llm.queries import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"
EDGE = [
    (1, "one two three", "en", "a", 13, "x"), (1, "one two three", "en", "a", 13, "x"), (2, None, "en", "a", 0, None), (3, "", None, None, 0, "x"),
    (None, "null id here", "en", "b", 12, "x"), (4, " \t\n ", "en", "b", 4, "x"), (5, "wörd " * 3000, "en", "c", 15000, "x"), (6, "| " * 60, "en", "c", 120, "x"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(name, same):
    same(QUERIES[name], ORACLE_SQL[name])


def test_mix_meets_targets(spark, sf):
    rows = QUERIES["op1_mixing"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    taken, goal, largest = Counter(), {}, Counter()
    for r in rows:
        taken[r.source] += r.taken
        goal[r.source] = r.target
        largest[r.source] = max(largest[r.source], r["size"])
        assert r.taken <= 2 * r["size"]
    assert all(abs(taken[s] - goal[s]) <= largest[s] for s in goal)
    assert sum(goal.values()) == pytest.approx(1.5 * sum(r["size"] for r in rows))


def test_mix_takes_whole_epochs_first(spark, sf):
    rows = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet"), Scratch(spark, "t"), keep=("lang",)).collect()
    by = defaultdict(set)
    for r in rows:
        by[r.source].add(r.copies)
    assert all(max(c) - min(c) <= 1 for c in by.values())


def test_quality_weight_prefers_clean_documents(spark):
    docs = spark.createDataFrame([(i, ("word " * 20) if i % 2 else ("w$#@ " * 20), "en", "a", 0, "x") for i in range(2000)] + [(9000 + i, "b " * 400, "en", "b", 0, "x") for i in range(300)], DOCS)
    out = mixing.mix(docs, Scratch(spark, "t"), keep=("text",)).where("source = 'a'").groupBy(F.col("text").startswith("word").alias("clean")).agg(F.avg("copies").alias("c"))
    got = {r.clean: r.c for r in out.collect()}
    assert got[True] >= got[False]


def test_mix_edges(spark, edge, empty):
    out = mixing.mix(edge, Scratch(spark, "t"), keep=("extra",)).collect()
    assert len(out) == len(EDGE) and all(r.taken <= 2 * r["size"] for r in out)
    assert mixing.mix(empty, Scratch(spark, "t")).count() == 0


def test_shards(spark, sf):
    rows = QUERIES["op2_sharding"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    slots = defaultdict(list)
    for r in rows:
        assert r["size"] == len((texts[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode())
        assert r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    moved = sum(r.grown_shard == 16 for r in rows)
    assert 0 < moved < len(rows) / 6


def test_weighted_shards_follow_their_weights(spark):
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    got = Counter(r.s for r in keys.select(sharding.shard_of(F.col("k"), 3, (1.0, 2.0, 0.0)).alias("s")).collect())
    assert got[2] == 0 and got[1] / got[0] == pytest.approx(2, rel=0.1)


def test_shard_edges(spark, edge, empty):
    out = sharding.assign(edge, Scratch(spark, "t"), keep=("extra",)).collect()
    assert len(out) == len(EDGE)
    assert {(r["size"], r.text_crc32) for r in out if r.doc_id in (2, 3)} == {(1, 0)}
    assert len({r.slot for r in out if r.doc_id == 1}) == 2
    assert sharding.assign(empty, Scratch(spark, "t")).count() == 0


def test_mix_with_hot_groups(spark, monkeypatch):
    """A source of which half the rows are poor, and one of which all rows but few are copies without an id."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    monkeypatch.setattr(mixing, "CUTS", 8)
    low = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, F.lit("# $ % & | < > !")).otherwise(F.concat(F.lit("some plain words "), "id")).alias("text"), F.lit("a").alias("source"))
    copies = spark.range(9_000).select(F.when(F.col("id") < 10, F.col("id")).alias("id"), F.lit("one two three four five").alias("text"), F.lit("b").alias("source"))
    out = mixing.mix(low.union(copies).withColumnRenamed("id", "doc_id"), Scratch(spark, "t"))
    got = {r.source: r for r in out.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.count(F.lit(1)).alias("n"), F.max("size").alias("size")).collect()}
    assert (got["a"].n, got["b"].n) == (20_000, 9_000) and all(abs(r.taken - r.target) <= r["size"] for r in got.values())
    counts = out.groupBy("doc_id", "source", "size", "taken").count()
    again = mixing.mix(low.union(copies).withColumnRenamed("id", "doc_id").repartition(7), Scratch(spark, "t")).groupBy("doc_id", "source", "size", "taken").count()
    assert counts.exceptAll(again).count() == 0 and again.exceptAll(counts).count() == 0


def test_slots_do_not_depend_on_files(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one, two = (sharding.assign(d, Scratch(spark, "t")) for d in (docs, docs.repartition(7)))
    assert one.exceptAll(two).count() == 0


def test_shards_with_many_slots_stay_gapless(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 10)
    docs = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    slots = defaultdict(list)
    for r in sharding.assign(docs, Scratch(spark, "t")).collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == 4000


def test_rules(spark):
    good = "This is a plain sentence that goes on for a while, as plain sentences do. " * 2
    lines = [(good.strip(), True), ("Home", False), ("a | b | c | d.", False), ("© 2020 someone.", False), ("BUY!! NOW!! GO!!", False), ("x### y### z###.", False), ("  ", False), ("« Très bien. »", True),
             ("Mehr unter www.example.org.", False), ("Ein Satz ohne Ende", False), ("She said: \"go.\"", True), ("Write to me@example.org whenever you like, as the people who live here have done for years.", True)]
    df = spark.createDataFrame(lines, "line string, want boolean")
    assert all(r.want == r.got for r in df.select("want", quality_rules.line_passes(F.col("line")).alias("got")).collect())


def test_menus_are_short_lines_in_a_row(spark):
    body = "A sentence that is long enough to stay where it is."
    df = spark.createDataFrame([(1, f"One.\nTwo.\nThree.\n{body}\nFour.\nFive.\n\n{body} Yes."), (2, f"{body}\nA.\n\nB.\nC d e.\nF g h.")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in quality_rules.clean(df).collect()}
    assert got == {1: f"{body}\nFour.\nFive.\n{body} Yes.", 2: body}


def test_rules_edges(spark, edge, empty):
    out = quality_rules.clean(edge, keep=("extra",)).collect()
    assert len(out) == len(EDGE)
    by = {r.doc_id: r for r in out}
    assert by[2].n_words == 0 and by[2].base_failed and not by[2].kept
    assert by[5].n_words == 3000 and by[5].n_repeat_words == 3000 and by[5].base_failed
    assert by[6].n_symbols == 60 and by[6].lost_words == 60
    assert quality_rules.clean(empty).count() == 0


def test_native_plans_have_no_python(spark, sf):
    for name in ("op1_mixing", "op2_sharding", "op8_quality_rules"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_sieve_keeps_wanted_rows_and_few_others(spark):
    big = spark.range(50_000).select("id", F.lit("t").alias("text"))
    wanted = spark.range(0, 50_000, 100).select(F.col("id").alias("w"))
    got = {r.id for r in sieve(big, "id", wanted, "w").collect()}
    assert set(range(0, 50_000, 100)) <= got and len(got) < 600
    assert sieve(big, "id", wanted.where("false"), "w").count() == 0

"""Centroid clustering, conversation repair and document fingerprints: brute force and edge cases."""

import hashlib
import heapq
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from geolink.llm import centroid_clustering as C
from geolink.llm import conversation_repair as R
from geolink.llm import document_fingerprints as D
from geolink.llm.common import Scratch

# --- kept columns of earlier operators

HELPERS = ("_text", "_t", "_place", "_number", "_range", "size", "Words", "_sub_text", "_html", "_id", "_keep0", "a.b")


@pytest.mark.parametrize("name", ["mix", "assign", "remove_repeats", "remove_lines", "encode", "clean", "extract"])
def test_kept_columns_of_any_name(spark, name):
    from geolink.llm import html_extraction, line_dedup, mixing, quality_rules, sentencepiece_codec, sharding, substring_dedup

    f = {
        "mix": lambda d, k: mixing.mix(d, Scratch(spark, "t"), keep=k), "assign": lambda d, k: sharding.assign(d, Scratch(spark, "t"), keep=k), "remove_repeats": lambda d, k: substring_dedup.remove_repeats(d, keep=k),
        "remove_lines": lambda d, k: line_dedup.remove_lines(d, Scratch(spark, "t"), keep=k), "encode": lambda d, k: sentencepiece_codec.encode(d, keep=k), "clean": lambda d, k: quality_rules.clean(d, keep=k),
        "extract": lambda d, k: html_extraction.extract(d, id_col="doc_id", html_col="text", keep=k),
    }[name]
    docs = spark.createDataFrame([(i, "one two three\nfour five six\nseven", "en", "a") for i in range(4)], "doc_id long, text string, lang string, source string")
    docs = docs.select("*", *[F.concat(F.lit(h), F.col("doc_id").cast("string")).alias(h) for h in HELPERS])
    results = {c.lower() for c in f(docs, ()).columns}
    names = tuple(h for h in HELPERS if h.lower() not in results)
    for r in f(docs, names).collect():
        i = r["page_id" if name == "extract" else "doc_id"]
        assert all(r[h] == f"{h}{i}" for h in names)
    taken = next(c for c in f(docs, ()).columns if c not in ("doc_id", "page_id", "text"))
    with pytest.raises(ValueError, match="names of results"):
        f(docs.withColumn(taken, F.lit(1)), (taken,))


# --- centroid clustering


def _lloyd(rows, k, rounds):
    """Plain k-means in Python integers: rows are (id, components)."""
    order = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centre = [list(x) for _, x in order[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    near = lambda x: min(range(len(centre)), key=lambda j: (far(x, centre[j]), j))
    for _ in range(rounds):
        own = [near(x) for _, x in rows]
        for j in range(len(centre)):
            if mine := [x for (_, x), o in zip(rows, own, strict=True) if o == j]:
                centre[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return [(i, near(x), far(x, centre[near(x)])) for i, x in rows], centre


@pytest.mark.parametrize("values", [range(-2, 3), range(-1000, 1000)])
def test_clusters_equal_brute_force(spark, values):
    # few values make many ties
    pick = random.Random(5)
    rows = [(i if i % 17 else None, [pick.choice(values) for _ in range(4)]) for i in range(400)]
    df = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in rows], "vec_id long, embedding array<double>").repartition(3)
    got = C.cluster(df, Scratch(spark, "t"), k=6, rounds=7, scale=1, dims=4).collect()
    want, centre = _lloyd(rows, 6, 7)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted([(r.vec_id, r.cluster, r.distance) for r in got], key=key) == sorted(want, key=key)
    for r in got:
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centre[r.cluster])).encode()).hexdigest()
        assert r.inertia == sum(w[2] for w in want) and r.cluster_inertia == sum(w[2] for w in want if w[1] == r.cluster)


def test_bounds_skip_distances(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    counted = C.cluster(vectors, Scratch(spark, "t")).agg(F.avg("n_distances"), F.max("n_distances")).first()
    assert counted[0] < 0.8 * C.CLUSTERS * (C.ROUNDS + 1)


def test_cluster_edges(spark):
    full = [0.5] * 64
    rows = [(1, full, "a"), (1, full, "b"), (2, None, "c"), (3, [1.0], "d"), (4, [float("nan"), *full[1:]], "e"), (5, [float("inf"), *full[1:]], "f"), (6, [None, *full[1:]], "g"), (None, [-0.0001] * 64, "h"), (7, [], "i")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string")
    got = C.cluster(df, Scratch(spark, "t"), keep=("x",)).collect()
    assert sorted(r.x for r in got) == ["a", "b", "h"] and all(r.distance == 0 for r in got)
    assert {r.cluster for r in got} == {0, 2}  # the equal start vectors tie
    assert C.cluster(df.limit(0), Scratch(spark, "t")).collect() == []
    with pytest.raises(ValueError, match="names of results"):
        C.cluster(df.withColumnRenamed("x", "Cluster"), Scratch(spark, "t"), keep=("Cluster",))
    with pytest.raises(Exception, match="beyond"):
        C.cluster(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>"), Scratch(spark, "t")).collect()


# --- conversation repair

BLANK = " \t\n\v\f\r"


def _cheapest(rows):
    """Least (cost, audit) and what it gives, by a search over (row, state) that knows nothing of vectors."""
    after = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, q, lines = heapq.heappop(heap)
        if i == len(rows) and q in (0, 3):
            return cost, audit, "\n".join(lines)
        if (i, q) in done:
            continue
        done.add((i, q))
        give, to = next((n, t) for n, t in (("user", after[q].get("u")), ("assistant", after[q].get("a"))) if t)
        heapq.heappush(heap, (cost + 3, audit + "I", i, to, (*lines, f"{give}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, q, lines))
            if fault in ("", "truncated"):
                more = 3 if fault else 0
                if role[:1] in after[q]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, after[q][role[:1]], (*lines, f"{role}:{text}")))
                heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, to, (*lines, f"{give}:{text}")))


def _summary(conv):
    """What the contract says of one conversation's (turn, role, text) rows."""
    value = lambda v: " " if v is None else v
    digest = lambda r: hashlib.sha256(f"{len(value(r[1]).encode())}:{value(r[1])}{value(r[2])}".encode()).digest()
    conv = sorted(conv, key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
    seen, rows = set(), []
    for _, role, text in conv:
        role, text = value(role), value(text)
        bare = text.strip(BLANK)
        rows.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""))
        seen.add((role, text))
    n = Counter(r[2] for r in rows)
    turns = [r[0] for r in conv if r[0] is not None]
    cost, audit, text = _cheapest(rows)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def _random_conversations(n, seed):
    pick, out = random.Random(seed), []
    for c in range(n):
        for _ in range(pick.choice([1, 2, 3, 5, 9, 14])):
            role = pick.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "usher"])
            text = pick.choice(["Hi.", "Yes!", "no end", " \n", "", None, "What? ", "a:b\nc.", "ñ?"])
            out.append((c if c else None, pick.choice([None, *range(6), -3]), role, text))
    return out


@pytest.mark.parametrize("block", [2, 1024])
def test_repair_equals_search(spark, block):
    rows = _random_conversations(150, 7)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    done = R.repair(df, Scratch(spark, "t"), block_rows=block)
    got = {r.conv_id: tuple(r)[1:] for r in done.summary().collect()}
    by = {}
    for c, *r in rows:
        by.setdefault(c, []).append(tuple(r))
    assert got == {c: _summary(r) for c, r in by.items()}
    text = {}
    for e in sorted(done.edits().collect(), key=lambda e: e.step):
        text.setdefault(e.conv_id, []).append(e)
    for c, edits in text.items():
        assert "".join(e.edit for e in edits) == got[c][6]
        assert hashlib.sha256("\n".join(f"{e.role}:{e.text}" for e in edits if e.edit != "D").encode()).hexdigest() == got[c][7]


def test_a_long_conversation_is_split(spark):
    pick = random.Random(3)
    rows = [(1, t, pick.choice(["user", "assistant", "tool"]), f"{pick.randrange(900)} is it{pick.choice(['.', ''])}") for t in range(6000)] + [(2, 0, "user", "Hi.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    done = R.repair(df, Scratch(spark, "t"), block_rows=100)
    got = {r.conv_id: tuple(r)[1:] for r in done.summary().collect()}
    assert got[1] == _summary([r[1:] for r in rows if r[0] == 1]) and got[2][5:7] == (3, "KI")


def test_repeated_rows_and_damage(spark):
    rows = [(1, 0, "user", "Hi.")] * 500 + [(1, 1, "assistant", "Ho.")] + [(2, 5, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in R.repair(df, Scratch(spark, "t"), block_rows=64).summary().collect()}
    assert got[1].duplicate == 499 and got[1].audit == "K" + "D" * 499 + "K" and got[1].illegal == 499 and got[1].cost == 4 * 499
    gone = next(c for c in range(1000) if __import__("zlib").crc32(f"{c}:0".encode()) % 20 == 0)
    left = R.repair(R.damage(spark.createDataFrame([(gone, 0, "user", "Hi.", 1)], "conv_id long, turn long, role string, text string, copies int")), Scratch(spark, "t"), copies_col="copies").summary().collect()
    assert [tuple(r) for r in left] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert R.repair(df.limit(0), Scratch(spark, "t")).summary().collect() == []


def test_states_are_few_and_cached():
    machine, pick = R.Automaton(), random.Random(1)
    for _ in range(300):
        machine.scan("".join(pick.choice("suaoSUAOx") for _ in range(60)), machine.end)
    assert len(machine.vectors) < 200 and len(machine.table) <= 9 * len(machine.vectors)


# --- document fingerprints


def _entropy(window):
    return -sum(n / len(window) * math.log2(n / len(window)) for n in Counter(window).values()) / math.log2(D.WINDOW) * D.STEPS


def _mix(h):
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    h = (h ^ h >> 27) * 0x94D049BB133111EB % 2**64
    return h ^ h >> 31


WEIGHTS = [_mix(i * 0x9E3779B97F4A7C15 % 2**64) | 1 for i in range(1, D.WINDOW + 1)]


def _plain(text, ranks):
    """A fingerprint window by window."""
    data, w = text.encode(), D.WINDOW
    windows = [data[i : i + w] for i in range(len(data) - w + 1)]
    exact = [int(e) for e in D.entropies(np.frombuffer(data, np.uint8))] if windows else []
    assert all(abs(_entropy(x) - e) < 1.001 for x, e in zip(windows, exact, strict=True))
    rank, named = [ranks[e] for e in exact], Counter()
    for a in range(max(1, len(windows) - w + 1)) if windows else ():
        run = range(a, min(a + w, len(windows)))
        named[min(run, key=lambda i: (rank[i], i))] += 1
    least = min(D.POPULAR, max(named.values(), default=0))
    found = [windows[i] for i in sorted(named) if named[i] >= least]
    hashes = [_mix(sum(b * k for b, k in zip(x, WEIGHTS, strict=False)) % 2**64) for x in found]
    if 0 < len(data) < D.SHORT:
        tiny = min(D.TINY, len(data))
        hashes += [_mix((sum(b * k for b, k in zip(data[i : i + tiny], WEIGHTS, strict=False)) + tiny) % 2**64) for i in range(len(data) - tiny + 1)]
    hashes = list(dict.fromkeys(hashes))
    out = b""
    for a in range(0, len(hashes), D.FULL):
        bits = 0
        for h in hashes[a : a + D.FULL]:
            for p in range(D.PROBES):
                bits |= 1 << (D.BITS - 1 - (h >> 11 * p) % D.BITS)
        out += bits.to_bytes(D.BITS // 8, "big")
    return out.hex()


def test_fingerprints_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ranks = D.entropy_ranks(D.entropy_counts(docs))
    counts = Counter()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for t in texts.values():
        counts.update(D.entropies(np.frombuffer(t.encode(), np.uint8)).tolist())
    assert [counts[e] for e in range(D.STEPS + 1)] == D.entropy_counts(docs)
    ids = sorted(texts)
    got = {r.doc_id: r for r in D.fingerprint(docs, Scratch(spark, "t")).collect()}
    assert len(got) == len(ids)
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        n = len(texts[i]) // 4
        edited = texts[i][: len(texts[i]) - n] + texts[j][:n]
        r = got[i]
        assert r.n_chars == len(texts[i]) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == _plain(texts[i], ranks) and r.edited_fingerprint == _plain(edited, ranks)
        assert 0 <= r.near_next <= 1 and r.near_edited >= (0.2 if r.n_chars > 100 else 0)
    far = [r.near_next for r in got.values()]
    assert np.median(far) == 0 and np.mean([r.near_edited for r in got.values()]) > 0.5


def test_entropies_go_on_over_blocks(monkeypatch):
    data = np.frombuffer(random.Random(2).randbytes(5000) + b"a" * 300, np.uint8)
    whole = D.entropies(data)
    monkeypatch.setattr(D, "BLOCK", 100)
    assert (D.entropies(data) == whole).all() and whole[-1] == 0


def test_fingerprint_edges(spark):
    long = " ".join(str(i * 7919) for i in range(30_000))
    rows = [(3, "", "a"), (1, None, "b"), (None, "null id comes first of all of these", "c"), (2, "x", "d"), (4, "same text, twice the same, so it is", "e"), (4, "same text, twice the same, so it is", "f"), (5, long, "g"), (6, "\x00" * 900, "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, part string").repartition(3)
    got = {r.part: r for r in D.fingerprint(df, Scratch(spark, "t"), keep=("part",)).collect()}
    assert len(got) == len(rows)
    assert got["a"].fingerprint == got["b"].fingerprint == "" and got["b"].near_next == 0 and got["a"].near_edited == 1
    assert got["e"].fingerprint == got["f"].fingerprint and 1.0 in (got["e"].near_next, got["f"].near_next)
    assert len(got["g"].fingerprint) > 4000 and got["g"].near_edited > 0.6
    wrap = "\x00" * 675 + "null id comes first of all of these"
    assert got["h"].edited_sha256 == hashlib.sha256(wrap.encode()).hexdigest()
    one = D.fingerprint(df.where("doc_id = 2"), Scratch(spark, "t")).collect()
    assert len(one) == 1 and one[0].near_next == one[0].near_edited == 1.0
    assert D.fingerprint(df.limit(0), Scratch(spark, "t")).collect() == []
    with pytest.raises(ValueError, match="names of results"):
        D.fingerprint(df.withColumnRenamed("part", "near_next"), Scratch(spark, "t"), keep=("near_next",))
    salted = D.fingerprint(df.withColumnsRenamed({"part": "_hash"}), Scratch(spark, "t"), keep=("_hash",)).collect()
    assert {r["_hash"] for r in salted} == set("abcdefgh")

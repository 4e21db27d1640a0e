"""Operator 5: line dedup by winnowing over line hashes.

A document is its sequence of lines with a word.  Grams of ``gram`` consecutive
line hashes are winnowed: each window of ``window`` grams selects its smallest
(the rightmost of equals) as a fingerprint, so any two documents that share a run
of ``gram + window - 1`` lines share a fingerprint at the same place of it.  Only
selected positions leave a document, each with the lines around it.

Positions of equal fingerprints are joined with the first of them by (document id,
line), and each match is extended line by line to the left and to the right, as far
as the windows reach that the fingerprint stands for; beyond them the next
fingerprint's match goes on.  A run of ``gram + window - 1`` lines or more that has
been there before goes.  Windows in which a position differs from the first one are
joined among themselves in the same way, each with the first position that has the
whole window, so a run is found wherever it first occurred.  Overlapping runs merge,
so longer matches are deleted whole.

With ``words`` a shorter run counts too, from so many words: every run of fewer
lines that holds them is a fingerprint beside the winnowed ones.

Lines are equal when two unrelated 64-bit hashes agree.  Keys meet only in partial
aggregations and in joins against one row per key, which AQE splits where a line is
hot.

Defined results
    null or blank text  no lines, nothing removed; a null text counts as empty
    blank lines         never compared; they stay where they are
    fewer lines than a run  nothing removed, unless ``words`` lets a shorter run count
    null id             compares with nothing and is left alone
    ties, repeated rows rows with one id are one document and don't delete each other's lines; they must hold one text
    within one document a later copy of a run goes too
    very long texts     whole
    empty table         no rows
    extra columns       those named in ``keep`` are carried along
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolink.llm.common import SPACES, SPACE_CLASS, Scratch, keeping, table, text_or_empty

GRAM, WINDOW = 2, 2
#: Words from which a run of fewer lines counts.
WORDS = 50


def _lines(df: DataFrame) -> DataFrame:
    """Add ``_lines`` (all) and ``_solid`` (index of each line with a word)."""
    df = df.withColumn("_lines", F.split("_text", "\n"))
    return df.withColumn("_solid", F.filter(F.transform("_lines", lambda l, i: F.when(F.btrim(l, F.lit(SPACES)) != "", i)), lambda i: i.isNotNull()))


def _upto(last):
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def fingerprints(rows: DataFrame, gram: int, window: int, words: int | None) -> DataFrame:
    """Selected positions: doc_id, print, at (first line), size (lines), span (lines of a window), left (nearest first), own, right, starts (of its windows)."""
    run, reach = gram + window - 1, window - 1
    solid = F.filter(F.split("_text", "\n"), lambda l: F.btrim(l, F.lit(SPACES)) != "")
    counts = F.transform("solid", lambda l: F.size(F.split(F.btrim(l, F.lit(SPACES)), f"[{SPACE_CLASS}]+"))) if words else F.lit(None).cast("array<int>")
    hashed = F.transform("solid", lambda l: F.xxhash64(l)).alias("h"), F.transform("solid", lambda l: F.xxhash64(F.lit("check"), l)).alias("c")
    rows = rows.select("doc_id", solid.alias("solid")).select("doc_id", *hashed, counts.alias("n")).where(F.size("h") >= (1 if words else run))
    grams = F.transform(_upto(F.size("h") - gram), lambda i: F.struct(F.xxhash64(F.lit(gram), F.slice("h", i + 1, gram)).alias("g"), (-i).alias("back")))
    rows = rows.select("*", grams.alias("grams"))
    minima = F.transform(_upto(F.size("h") - run), lambda s: -F.array_min(F.slice("grams", s + 1, window)).getField("back"))
    rows = rows.select("*", minima.alias("minima"))
    # the windows that a fingerprint stands for: those whose minimum it is
    windows = lambda p: F.filter(F.sequence(F.greatest(F.lit(0), p - reach), F.least(p, F.size("minima") - 1)), lambda s: F.get("minima", s) == p)
    none = F.array().cast("array<bigint>")
    before = lambda p: F.when(p > 0, F.reverse(F.slice("c", F.greatest(F.lit(1), p - reach + 1), F.least(p, F.lit(reach))))).otherwise(none) if reach else none
    place = lambda p, size, span, print_, left, right, starts: F.struct(
        print_.alias("print"), p.cast("int").alias("at"), F.lit(size).alias("size"), F.lit(span).alias("span"), left.alias("left"), F.slice("c", p + 1, size).alias("own"), right.alias("right"), starts.cast("array<int>").alias("starts")
    )
    chosen = F.transform(F.array_distinct("minima"), lambda p: place(p, gram, run, F.get("grams", p).getField("g"), before(p), F.slice("c", p + gram + 1, reach) if reach else none, windows(p)))
    # a shorter run with enough words stands for itself
    enough = lambda size: F.filter(_upto(F.size("h") - size), lambda s: F.aggregate(F.slice("n", s + 1, size), F.lit(0), lambda x, y: x + y) >= words)
    alone = lambda size: F.transform(enough(size), lambda s: place(s, size, size, F.xxhash64(F.lit(-size), F.slice("h", s + 1, size)), none, none, F.array(s)))
    short = map(alone, range(1, run if words else 1))
    return rows.select("doc_id", F.explode(F.concat(chosen, *short)).alias("p")).select("doc_id", "p.*")


def _alike(one: str, other: str):
    """How many leading elements two arrays share."""
    differ = F.zip_with(one, other, lambda x, y: ~F.coalesce(x == y, F.lit(False)))
    at = F.coalesce(F.array_position(differ, True), F.lit(0))
    return F.when(at > 0, at - 1).otherwise(F.size(differ)).cast("int")


def repeated_runs(docs: DataFrame, scratch: Scratch, *, id_col: str, text_col: str, gram: int = GRAM, window: int = WINDOW, words: int | None = WORDS) -> DataFrame:
    """(doc_id, starts): first line (counting lines with a word) and number of lines of every run that has been there before."""
    run = gram + window - 1
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("_text")).where("doc_id is not null")
    prints = scratch.keep(fingerprints(rows, gram, window, words), "prints")
    often = scratch.keep(prints.groupBy(F.col("print").alias("_print")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("_print"), "often")
    met = scratch.keep(prints.join(often, F.col("print") == F.col("_print")).drop("_print"), "met")
    scratch.drop("prints")

    # join positions with the first one and extend both ways
    first = met.groupBy(F.col("print").alias("_print")).agg(F.min(F.struct("doc_id", "at", "left", "own", "right")).alias("first"))
    pairs = met.join(first, F.col("print") == F.col("_print")).where(F.struct("doc_id", "at") > F.struct("first.doc_id", "first.at"))
    pairs = pairs.withColumn("same", F.col("own") == F.col("first.own")).withColumn("l", _alike("left", "first.left")).withColumn("r", _alike("right", "first.right"))
    pairs = pairs.withColumn("low", F.when(F.col("same"), F.col("at") - F.col("l")).otherwise(F.col("at"))).withColumn("lines", F.when(F.col("same"), F.col("l") + F.col("size") + F.col("r")).otherwise(0))
    inside = lambda s: (s >= F.col("low")) & (s + F.col("span") <= F.col("low") + F.col("lines"))
    pairs = pairs.withColumn("rest", F.filter("starts", lambda s: ~inside(s)))
    pairs = scratch.keep(pairs.select("doc_id", "print", "at", "size", "span", "left", "own", "right", "low", "lines", "rest"), "pairs")
    found = pairs.where(F.col("lines") >= F.col("span")).select("doc_id", F.col("low").alias("start"), F.col("lines").alias("size"))

    # windows that differ from the first position's: each with the first that has it
    around = F.concat(F.reverse("left"), "own", "right")
    other = pairs.where(F.size("rest") > 0).select("doc_id", "print", "span", F.explode("rest").alias("start"), "at", (F.col("at") - F.size("left")).alias("from"), around.alias("around"))
    other = other.select("doc_id", "print", "span", "start", F.expr("slice(around, start - from + 1, span)").alias("body"), (F.col("start") - F.col("at")).alias("offset"))
    other = scratch.keep(other, "other")
    key = ["print", "offset", "body"]
    leads = other.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    later = other.join(leads, [F.col(k) == F.col(f"_{k}") for k in key]).where(F.struct("doc_id", "start") > F.col("first"))
    found = found.unionByName(later.select("doc_id", "start", F.col("span").alias("size")))
    return found.groupBy("doc_id").agg(F.collect_set(F.struct("start", "size")).alias("starts"))


@keeping
def remove_lines(docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW, words: int | None = WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Delete later repeated runs: ``doc_id, text, n_lines, n_removed`` and ``keep``."""
    found = repeated_runs(docs, scratch, id_col=id_col, text_col=text_col, gram=gram, window=window, words=words).withColumnRenamed("doc_id", "_id")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("_text"), *keep)
    rows = _lines(rows.join(found, F.col("doc_id") == F.col("_id"), "left").drop("_id"))
    places = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1))))
    gone = F.transform(places, lambda p: F.get("_solid", p))
    rows = rows.withColumn("_gone", F.when(F.col("starts").isNotNull(), gone).otherwise(F.array().cast("array<int>")))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    text = F.when(F.size("_gone") == 0, F.col("_text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n"))
    return rows.select("doc_id", text.alias("text"), F.size("_solid").cast("long").alias("n_lines"), F.size("_gone").cast("long").alias("n_removed"), *keep)


def _digest(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_lines (with a word), n_removed, kept_sha256 (of the text left, UTF-8).

    A run counts from three lines, or from ``WORDS`` words.
    """
    return _digest(remove_lines(table(spark, sf_dir, "documents"), Scratch(spark, "op5")))


def op5_run_dedup(spark, sf_dir: str) -> DataFrame:
    """The same for runs of three lines alone, however many words they have."""
    return _digest(remove_lines(table(spark, sf_dir, "documents"), Scratch(spark, "op5"), words=None))


RUN_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), l AS (
  SELECT rid, doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d
), s AS (
  SELECT rid, doc_id, line, pos, row_number() OVER (PARTITION BY rid ORDER BY pos) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), w AS (
  SELECT rid, doc_id, n, line || chr(10) || lead(line) OVER o || chr(10) || lead(line, 2) OVER o AS body FROM s WINDOW o AS (PARTITION BY rid ORDER BY n)
), f AS (
  SELECT rid, doc_id, n, min({'d': doc_id, 'n': n}) OVER (PARTITION BY body) AS first FROM w WHERE body IS NOT NULL AND doc_id IS NOT NULL
), g AS (
  SELECT DISTINCT rid, unnest([n, n + 1, n + 2]) AS n FROM f WHERE {'d': doc_id, 'n': n} > first
), k AS (
  SELECT l.rid, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (g.rid IS NULL), '') AS kept, count(s.n) AS n_lines, count(g.rid) AS n_removed
  FROM l LEFT JOIN s ON l.rid = s.rid AND l.pos = s.pos LEFT JOIN g ON s.rid = g.rid AND s.n = g.n GROUP BY l.rid
)
SELECT doc_id, n_lines, n_removed, sha256(kept) AS kept_sha256 FROM d JOIN k USING (rid)
"""

SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), l AS (
  SELECT rid, doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d
), s AS (
  SELECT rid, doc_id, line, pos, row_number() OVER (PARTITION BY rid ORDER BY pos) AS n, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), w AS (
  SELECT rid, doc_id, n, 1 AS size, line AS body FROM s WHERE words >= 50
  UNION ALL
  SELECT rid, doc_id, n, 2, line || chr(10) || lead(line) OVER o FROM s WINDOW o AS (PARTITION BY rid ORDER BY n) QUALIFY words + lead(words) OVER o >= 50
  UNION ALL
  SELECT rid, doc_id, n, 3, line || chr(10) || lead(line) OVER o || chr(10) || lead(line, 2) OVER o FROM s WINDOW o AS (PARTITION BY rid ORDER BY n)
), f AS (
  SELECT rid, doc_id, n, size, min({'d': doc_id, 'n': n}) OVER (PARTITION BY size, body) AS first FROM w WHERE body IS NOT NULL AND doc_id IS NOT NULL
), g AS (
  SELECT DISTINCT rid, unnest(range(n, n + size)) AS n FROM f WHERE {'d': doc_id, 'n': n} > first
), k AS (
  SELECT l.rid, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (g.rid IS NULL), '') AS kept, count(s.n) AS n_lines, count(g.rid) AS n_removed
  FROM l LEFT JOIN s ON l.rid = s.rid AND l.pos = s.pos LEFT JOIN g ON s.rid = g.rid AND s.n = g.n GROUP BY l.rid
)
SELECT doc_id, n_lines, n_removed, sha256(kept) AS kept_sha256 FROM d JOIN k USING (rid)
"""

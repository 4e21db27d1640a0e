"""Operator 8: line-first quality rules (native DataFrame operations only).

Each line is judged on its own first, by its build and not by words of a language:

punctuation  symbols or exclamation marks in a tenth of its characters, or no
             closing punctuation at its end
navigation   three separators (a link bar), or three or more lines of at most
             three words in a row (a menu)
boilerplate  a copyright or trademark sign, an address of a page or mailbox in a
             line of at most twelve words, or a line that the document had before

Lines that fail go.  Then a document is rejected if it lost more than half of its
words that way, or if it fails the base rules: fewer than 50 words, or more than half
of the words inside three-word windows that occur twice or more.

Defined results
    null or blank text  no words, all counts 0, base_failed true
    very long texts     one row's arrays; nothing is cut off
    repeated rows       judged alike, each kept as a row
    empty table         no rows
    extra columns       those named in ``keep`` are carried along
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolink.llm.common import SPACES, SPACE_CLASS, keeping, table, text_or_empty, word_list

SYMBOLS = "#*$%&|<>"
SOLID = f"[^{SPACE_CLASS}]"
#: A sentence's last mark, with quotes and brackets that close after it.
CLOSED = r"[.!?:;…。！？؟।][\"'”’»)\]\x20\x09-\x0D]*$"
BAR = r"[|»›·•→][^|»›·•→]*[|»›·•→][^|»›·•→]*[|»›·•→]"
SIGN, ADDRESS = "[©®™]", r"https?://|www\.|[^\x20\x09-\x0D@]@[^\x20\x09-\x0D@]+\."
#: A line of more than ``MENU_WORDS`` words.
MANY = rf"(?:[^{SPACE_CLASS}]+[{SPACE_CLASS}]+){{3}}[^{SPACE_CLASS}]"
#: Most words of a menu's line and of a line that an address decides, lines that make a menu.
MENU_WORDS, ADDRESS_WORDS = 3, 12
MIN_WORDS = 50
#: Most percent of words inside repeated three-word windows, and most percent of words lost with removed lines.
MAX_REPEAT, MAX_LOST = 50, 50


def _count(line: Column, chars: str) -> Column:
    return F.length(line) - F.length(F.translate(line, chars, ""))


def _solid(line: Column) -> Column:
    return F.length(F.translate(line, SPACES, ""))


def line_passes(line: Column) -> Column:
    """True for a line with a word that breaks none of the line rules.

    Counting is dear, so it waits until a pattern has found something to count.
    """
    solid = _solid(line)
    punctuation = (line.rlike(r"[#*$%&|<>!]") & ((_count(line, SYMBOLS) * 10 > solid) | (_count(line, "!") * 10 > solid))) | ~line.rlike(CLOSED)
    boilerplate = line.rlike(SIGN) | (line.rlike(ADDRESS) & (F.size(word_list(line)) <= ADDRESS_WORDS))
    return line.rlike(SOLID) & ~punctuation & ~line.rlike(BAR) & ~boilerplate


def menu_lines(short: str, i: Column) -> Column:
    """Whether line ``i`` is one of three or more short ones in a row; ``short`` names an array of booleans."""
    at = lambda k: F.coalesce(F.get(short, i + k), F.lit(False))
    return at(0) & ((at(-2) & at(-1)) | (at(-1) & at(1)) | (at(1) & at(2)))


@keeping
def clean(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Judge every row: base counts, ``base_failed``, ``lost_words``, ``kept`` and the cleaned ``text``."""
    lines = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("_t"), *keep)
    lines = lines.withColumn("_words", word_list(F.col("_t"))).withColumn("_lines", F.filter(F.split("_t", "\n"), lambda l: l.rlike(SOLID)))
    lines = lines.withColumn("n_words", F.size("_words").cast("long")).withColumn("_short", F.transform("_lines", lambda l: ~l.rlike(MANY)))
    lines = lines.withColumn("_kept", F.array_distinct(F.filter("_lines", lambda l, i: line_passes(l) & ~menu_lines("_short", i))))
    grams = F.when(
        F.col("n_words") >= 3,
        F.transform(F.slice("_words", 1, F.size("_words") - 2), lambda w, i: F.struct(F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("i"))),
    )
    lines = lines.withColumn("_clean", F.array_join("_kept", "\n"))
    sorted_ = lines.withColumn("_grams", F.sort_array(grams))
    repeated = F.filter("_grams", lambda g, i: (g["h"] == F.get("_grams", i - 1)["h"]) | (g["h"] == F.get("_grams", i + 1)["h"]))
    covered = F.size(F.array_distinct(F.flatten(F.transform(repeated, lambda g: F.array(g["i"], g["i"] + 1, g["i"] + 2)))))
    counted = sorted_.select(
        "doc_id", "n_words", F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.when(F.col("_t").rlike("[#*$%&|<>]"), _count(F.col("_t"), SYMBOLS)).otherwise(0).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_grams").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"),
        F.when(F.size("_kept") == F.size("_lines"), 0).otherwise(F.col("n_words") - F.size(word_list(F.col("_clean")))).cast("long").alias("lost_words"), F.col("_clean").alias("text"), *keep,
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT)
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("lost_words") * 100 <= F.col("n_words") * MAX_LOST))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = clean(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), l0 AS (
  SELECT rid, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d
), l1 AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS solid
  FROM l0
), l2 AS (
  SELECT *, NOT ((length(line) - length(translate(line, '#*$%&|<>', ''))) * 10 > solid OR (length(line) - length(translate(line, '!', ''))) * 10 > solid
      OR NOT regexp_matches(line, '[.!?:;…。！？؟।]["''”’»)\]\x20\x09-\x0D]*$') OR length(line) - length(translate(line, '|»›·•→', '')) >= 3
      OR regexp_matches(line, '[©®™]') OR (w <= 12 AND regexp_matches(line, 'https?://|www\.|[^\x20\x09-\x0D@]@[^\x20\x09-\x0D@]+\.'))
      OR (w <= 3 AND ((lag(w, 2, 9) OVER o <= 3 AND lag(w, 1, 9) OVER o <= 3) OR (lag(w, 1, 9) OVER o <= 3 AND lead(w, 1, 9) OVER o <= 3) OR (lead(w, 1, 9) OVER o <= 3 AND lead(w, 2, 9) OVER o <= 3)))) AS passes,
    row_number() OVER (PARTITION BY rid, line ORDER BY pos) AS nth
  FROM l1 WHERE w > 0 WINDOW o AS (PARTITION BY rid ORDER BY pos)
), l3 AS (
  SELECT *, row_number() OVER (PARTITION BY rid, line, passes ORDER BY pos) AS nth_passing FROM l2
), l AS (
  SELECT rid, sum(CASE WHEN nth > 1 THEN 1 ELSE 0 END) AS n_dup_lines, sum(w) - sum(CASE WHEN passes AND nth_passing = 1 THEN w ELSE 0 END) AS lost_words FROM l3 GROUP BY rid
), w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), g0 AS (
  SELECT rid, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w
), g1 AS (
  SELECT rid, i, a || ' ' || lead(a) OVER o || ' ' || lead(a, 2) OVER o AS g FROM g0 WINDOW o AS (PARTITION BY rid ORDER BY i)
), g2 AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g1 WHERE g IS NOT NULL
), g AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g2 WHERE n > 1) GROUP BY rid
), c AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost_words, 0)::BIGINT AS lost_words
  FROM w LEFT JOIN l USING (rid) LEFT JOIN g USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_words <= 50 * n_words AS kept, lost_words
FROM c
"""

"""Line-first cleaning: rules for single lines, then a verdict on what they leave of a document.

A line falls if it breaks a punctuation, a navigation or a boilerplate rule. What is left is the cleaned text; a document
that loses too large a share of its words, or fails the base counts of the whole text, is rejected. Everything is an
expression over one row, so there is no shuffle. Words in repeated windows are found by sorting: window hashes cut to 33
bits are packed with their positions into longs and sorted as primitives, and only windows that meet there are compared by
their whole 64 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Characters between words, as a class of regular expressions; everything else makes words.
SPACE, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MOST_REPEATED, WINDOW = 50, 50, 3
#: A line that ends in the middle of a sentence stands if it has so many words and ends a sentence before.
LONG_LINE = 10
#: Percent of a line's words that may carry symbols, and of a document's words that may fall with its lines.
SYMBOL_WORDS, MOST_LOST = 20, 30
#: Ends of sentences, closing marks after them allowed.
ENDS = r"[.!?…。！？:;][\"'”’»)\]]*"
#: Marks that stand between the entries of a menu, and entries that make a line on their own.
SEPARATOR = r"(^|[\x20\x09-\x0D])[|>»•·/]+(\z|[\x20\x09-\x0D])"
MENU = r"(?i)^[\x20\x09-\x0D]*((home|menu|login|logout|sign in|sign up|register|search|contact|contact us|about|about us|next|previous|back|top|share|print|sitemap|help|faq|skip to content)[\x20\x09-\x0D.!?|>»•·/]*)+\z"
#: Phrases of notices that no author of the text has written.
BOILERPLATE = r"(?i)(all rights reserved|terms of (use|service)|privacy policy|uses? cookies|cookie policy|enable javascript|javascript is (disabled|required)|powered by|click here|subscribe to our|lorem ipsum|©)"


def _words(value: Column) -> Column:
    return F.filter(F.split(value, SPACE + "+"), lambda w: w != "")


def _repeated(n: Column, windows: Column) -> Column:
    """Ascending positions of the windows whose hash occurs more than once; ``windows`` must be a column of its own."""
    bits = (1 << 31) - 1
    packed = F.sort_array(F.transform(windows, lambda h, i: F.shiftleft(h, 31).bitwiseOR(i.cast("long"))))

    def met(pairs: Column, same, at) -> Column:
        """Places of neighbours that are the same."""
        equal = F.filter(F.zip_with(pairs, F.slice(pairs, F.lit(2), n), lambda a, b: F.when(same(a, b), F.array(at(a), at(b)))), lambda x: x.isNotNull())
        return F.array_distinct(F.flatten(equal))

    near = F.transform(F.array(packed), lambda s: met(s, lambda a, b: F.shiftrightunsigned(a.bitwiseXOR(b), 31) == 0, lambda a: a.bitwiseAND(F.lit(bits))))[0]
    whole = F.sort_array(F.transform(near, lambda p: F.struct(F.get(windows, p.cast("int")).alias("h"), p.alias("p"))))
    return F.sort_array(F.transform(F.array(whole), lambda s: met(s, lambda a, b: a["h"] == b["h"], lambda a: a["p"]))[0])


def _falls(line: Column, n: Column) -> Column:
    """Whether a line of ``n`` words breaks a rule."""
    ended = line.rlike(ENDS + SPACE + r"*\z") | ((n >= LONG_LINE) & line.rlike(ENDS + SPACE))
    marked = F.size(F.filter(F.split(line, SPACE + "+"), lambda w: w.rlike("[#*$%&|<>]")))
    menu = (F.regexp_count(line, F.lit(SEPARATOR)) * 4 >= n) & (F.regexp_count(line, F.lit(SEPARATOR)) >= 2) | line.rlike(MENU)
    return ~ended | (marked * 100 > n * SYMBOL_WORDS) | menu | line.rlike(BOILERPLATE)


def clean_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", most_lost: int = MOST_LOST) -> DataFrame:
    """(key, cleaned, n_words, n_lost, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row.

    ``cleaned`` is the text without the lines that fall (lines without a word stay where they are); ``n_lost`` counts the
    words of those that fall. A null text has no words, its cleaned text is null and it fails the base counts, as does an
    empty one. Long texts are read whole; a row holds some 60 bytes for each of its words while it is worked on. Repeated
    rows are judged alike, each for itself; an empty table gives no rows; a null key is kept. Other columns, whatever their
    names, are not looked at.
    """
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("line"), _words(x).alias("words")))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(text).isNull().alias("none")).withColumn("lines", lines)
    judged = F.transform("lines", lambda x: F.struct(x["line"].alias("line"), F.size(x["words"]).alias("n"), ((F.size(x["words"]) > 0) & _falls(x["line"], F.size(x["words"]))).alias("falls")))
    rows = rows.withColumns({"hashes": F.transform(F.flatten(F.transform("lines", lambda x: x["words"])), lambda w: F.xxhash64(w)), "lines": judged})
    n = F.size("hashes")
    two = F.zip_with("hashes", F.slice("hashes", F.lit(2), n), lambda a, b: F.xxhash64(a, b))
    three = F.zip_with(two, F.slice("hashes", F.lit(3), n), lambda a, b: F.xxhash64(a, b))
    rows = rows.withColumns({"n": n, "windows": F.slice(three, F.lit(1), F.greatest(n - 2, F.lit(0)))})
    rows = rows.withColumn("again", _repeated(F.col("n") + 1, F.col("windows")))
    covered = F.aggregate(F.zip_with("again", F.slice("again", F.lit(2), F.size("again")), lambda a, b: F.least(F.lit(WINDOW).cast("long"), F.coalesce(b - a, F.lit(WINDOW).cast("long")))), F.lit(0).cast("long"), lambda s, x: s + x)
    used = F.transform(F.filter("lines", lambda x: x["n"] > 0), lambda x: x["line"])
    without = lambda chars: F.length("text") - F.length(F.translate("text", chars, ""))
    counts = rows.select(
        "key", F.when(~F.col("none"), F.array_join(F.transform(F.filter("lines", lambda x: ~x["falls"]), lambda x: x["line"]), "\n")).alias("cleaned"),
        F.col("n").cast("long").alias("n_words"), F.aggregate("lines", F.lit(0).cast("long"), lambda s, x: s + F.when(x["falls"], x["n"]).otherwise(0)).alias("n_lost"),
        F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"), without(SYMBOLS).cast("long").alias("n_symbols"),
        (F.size(used) - F.size(F.array_distinct(used))).cast("long").alias("n_dup_lines"), covered.alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    counts = counts.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("n_lost") * 100 <= F.col("n_words") * most_lost))
    return counts.withColumnRenamed("key", key)


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of all ``documents``, n_lost besides; edge cases as :func:`clean_lines` states."""
    return clean_lines(table(spark, sf_dir, "documents")).drop("cleaned")


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


OP12_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () r, doc_id, coalesce(text, '') t FROM documents),
words AS (SELECT r, w FROM (SELECT r, regexp_extract_all(t, '{WORD}+') w FROM docs)),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) k FROM (
  SELECT r, i, w[i] a, w[i + 1] b, w[i + 2] c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) i FROM words))),
covered AS (SELECT r, count(DISTINCT j) n FROM (SELECT r, unnest([i, i + 1, i + 2]) j FROM windows WHERE k > 1) GROUP BY r),
lines AS (SELECT r, l, len(regexp_extract_all(l, '{WORD}+')) n FROM (SELECT r, unnest(string_split(t, chr(10))) l FROM docs)),
judged AS (SELECT r, l, n, NOT (regexp_matches(l, {_literal(ENDS + SPACE + r'*\z')}) OR (n >= {LONG_LINE} AND regexp_matches(l, {_literal(ENDS + SPACE)})))
  OR 100 * len(list_filter(regexp_extract_all(l, '{WORD}+'), lambda x: regexp_matches(x, '[#*$%&|<>]'))) > {SYMBOL_WORDS} * n
  OR (4 * len(regexp_extract_all(l, {_literal(SEPARATOR)})) >= n AND len(regexp_extract_all(l, {_literal(SEPARATOR)})) >= 2)
  OR regexp_matches(l, {_literal(MENU)}) OR regexp_matches(l, {_literal(BOILERPLATE)}) falls FROM lines WHERE n > 0),
by_line AS (SELECT r, count(*) - count(DISTINCT l) dup, sum(CASE WHEN falls THEN n ELSE 0 END) lost FROM judged GROUP BY r),
counts AS (SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(lost, 0) AS BIGINT) n_lost, CAST(length(list_aggregate(w, 'string_agg', '')) AS BIGINT) word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) n_symbols, CAST(coalesce(dup, 0) AS BIGINT) n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) n_repeat_words
  FROM docs JOIN words USING (r) LEFT JOIN covered USING (r) LEFT JOIN by_line USING (r)),
base AS (SELECT doc_id, n_words, n_lost, coalesce(word_chars, 0) word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words base_failed FROM counts)
SELECT *, NOT base_failed AND 100 * n_lost <= {MOST_LOST} * n_words kept FROM base"""

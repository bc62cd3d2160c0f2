"""Mixing sources to target weights by Pareto order sampling.

A source's target is its weighted share of ``budget`` times all words, at most ``cap`` times its own words; the excess
is reshared by weight. Every document first gets floor(target / source words) whole copies. What is still due is a
fixed-size sample with unequal probabilities (its size is counted in words): a document's inclusion probability p is
proportional to its words, such that the expected words of the sample are those due. Documents whose p would reach 1 get
one more certain copy and leave the sample; the others are ranked by [u / (1 - u)] / [p / (1 - p)] with u from a hash,
and the ranking is cut before its running sum of words would pass what is due. One more document fills the rest: of
those left the one whose size comes nearest to it.

Which sizes are certain follows from a table of the distinct sizes of each source: size s is certain if
(due - words of larger documents) * s reaches the sum of squares of the sizes up to s. Ranks are running sums over a range
partitioning by (source, rank), so a source with a third of all rows spans many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import sized, stored, table

WEIGHTS = (3, 1, 2)
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def share_targets(sizes: list[int], weights: list[float], budget: float = 1.5, cap: float = 2.0) -> list[float]:
    """Targets that share ``budget`` times all sizes by weight, none above ``cap`` times its size.

    Sources fill up in the order of cap / weight; the rest share by weight what the full ones leave.
    """
    total, tops = budget * sum(sizes), [cap * s for s in sizes]
    order = sorted(range(len(sizes)), key=lambda i: (tops[i] / weights[i], i))
    full, left = 0.0, float(sum(weights))
    out = [0.0] * len(sizes)
    for place, i in enumerate(order):
        rate = (total - full) / left
        if rate * weights[i] <= tops[i]:
            for j in order[place:]:
                out[j] = rate * weights[j]
            return out
        out[i] = tops[i]
        full += tops[i]
        left -= weights[i]
    return out


def uniform(key: Column) -> Column:
    """A number in (0, 1) from md5 of the seed and the key as text (null: none)."""
    text = F.concat(F.lit(SEED + ":"), F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` (key, size, h, rate, certain) with sure and rank: odds, then key (null last) and hash.

    Odds are random odds over inclusion odds; without a probability above 0 a document is last. Each step is a column of
    its own, so that hashes and word counts are computed once a row.
    """
    rows = rows.withColumn("u", uniform(F.col("key"))).withColumn("p", F.col("rate") * F.col("size")).withColumn("sure", _sure(F.col("size")))
    odds = F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))).otherwise(F.lit(float("inf")))
    rows = rows.withColumn("odds", odds)
    return rows.withColumn("rank", F.struct(F.col("odds").alias("q"), F.col("key").isNull().alias("bare"), "key", "h")).drop("u", "p", "odds")


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _plan(rows: DataFrame, weights: tuple, budget: float, cap: float) -> DataFrame:
    """(_source, source_size, target, whole, certain, due, rate), one row a source.

    ``certain`` is the least size that is surely in the sample (null: none), ``due`` the words that the others share and
    ``rate`` their inclusion probability a word.
    """
    spark = rows.sparkSession
    kinds = stored(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "kinds")  # distinct sizes of each source
    found = kinds.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("n")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["n"]) for r in found]
    targets = share_targets(sizes, [float(weights[i % len(weights)]) for i in range(len(found))], budget, cap) if found else []
    plan = spark.createDataFrame(
        [(r["source"], n, t, int(t // n) if n else 0, t - (t // n) * n if n else 0.0) for r, n, t in zip(found, sizes, targets, strict=True)],
        "_source string, source_size long, target double, whole int, first_due double")
    w = Window.partitionBy("source").orderBy("size")
    exact = F.col("size").cast("decimal(20,0)")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    sums = kinds.withColumn("larger", F.sum((F.col("size") * F.col("n"))).over(Window.partitionBy("source")) - F.sum(F.col("size") * F.col("n")).over(upto))
    sums = sums.withColumn("squares", F.sum((exact * exact * F.col("n")).cast("decimal(38,0)")).over(upto).cast("double"))
    due = plan.select("_source", "first_due")
    sums = sums.join(sized(due, "due"), F.col("source").eqNullSafe(F.col("_source")))
    sure = (F.col("first_due") - F.col("larger")) * F.col("size") >= F.col("squares")
    marked = sums.withColumn("sure", sure & (F.col("size") > 0) & (F.col("first_due") > 0))
    cut = marked.groupBy("_source").agg(
        F.min(F.when(F.col("sure"), F.col("size"))).alias("certain"), F.max(F.when(~F.col("sure"), F.col("squares"))).alias("rest"),
        F.coalesce(F.sum(F.when(F.col("sure"), F.col("size") * F.col("n"))), F.lit(0)).alias("given"))
    cut = cut.withColumnRenamed("_source", "_c")
    full = plan.join(cut, F.col("_source").eqNullSafe(F.col("_c")), "left").withColumn("due", F.col("first_due") - F.coalesce("given", F.lit(0)))
    return stored(full.select("_source", "source_size", "target", "whole", "certain", "due", F.when(F.col("rest") > 0, F.col("due") / F.col("rest")).otherwise(0.0).alias("rate")), "plan")


def _sure(size: Column) -> Column:
    return F.coalesce(size >= F.col("certain"), F.lit(False))


def _placed(rows: DataFrame, weights: tuple, budget: float, cap: float) -> tuple[DataFrame, DataFrame]:
    """Every row of (key, source, size, h) with its rank and whether it is certain or in its source's sample; the plan."""
    spark = rows.sparkSession
    rows = stored(rows, "sizes")
    plan = _plan(rows, weights, budget, cap)
    planned = rows.join(sized(plan, "plan"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    ranked = _ranked(planned)
    # Certain documents stand apart from the ranking and add nothing to its running sum.
    ranged = ranked.repartitionByRange(F.asc_nulls_last("source"), "sure", "rank").withColumn("_part", F.spark_partition_id())
    local = Window.partitionBy("_part", "source").orderBy("sure", "rank").rowsBetween(Window.unboundedPreceding, 0)
    summed = stored(ranged.withColumn("run", F.sum(F.when(F.col("sure"), 0).otherwise(F.col("size"))).over(local)), "ranked")
    # Words of the same source in the partitions before: one row for each partition and source that meet.
    parts = summed.groupBy("_part", "source").agg(F.max("run").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = sized(parts.select(F.col("_part").alias("_p"), F.col("source").alias("_source"), before.alias("_before")), "shift")
    placed = summed.join(shift, (F.col("_part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "_p")
    placed = placed.withColumn("upto", F.col("run") + F.col("_before"))
    within = ~F.col("sure") & (F.col("due") > 0) & (F.col("upto") <= F.col("due"))  # a full source has no sample, not even of empty texts
    # What is left of each source after its last whole document, and the document that fills it best.
    got = placed.where(within).groupBy("source").agg(F.max("upto").alias("got"))
    rest = plan.join(got, F.col("_source").eqNullSafe(F.col("source")), "left").select(F.col("_source").alias("_s"), (F.col("due") - F.coalesce("got", F.lit(0))).alias("rest"))
    off = F.abs(F.col("size") - F.col("rest"))
    open_ = placed.where(~within & ~F.col("sure") & (F.col("size") > 0)).join(sized(rest, "rest"), F.col("source").eqNullSafe(F.col("_s"))).where(off < F.col("rest"))
    fills = open_.groupBy("source").agg(F.min(F.struct(off.alias("off"), "rank", "_part", "run")).alias("f"))
    fills = fills.select(F.col("source").alias("_f"), F.col("f.rank").alias("_fill"), F.col("f._part").alias("_fp"), F.col("f.run").alias("_fr"))
    placed = placed.join(sized(fills, "fills"), F.col("source").eqNullSafe(F.col("_f")), "left").drop("_f")
    # Repeated rows share a rank: the place in the running sum tells which of them fills.
    filling = F.coalesce(F.col("rank").eqNullSafe(F.col("_fill")) & (F.col("_part") == F.col("_fp")) & (F.col("run") == F.col("_fr")), F.lit(False)) & ~F.col("sure")
    return placed.withColumn("within", within).withColumn("filling", filling), plan


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", *, weights: tuple = WEIGHTS, budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(key, source, size, source_size, target, inclusion, copies, taken) of every row.

    Sources are taken in code-point order, null last, with the weights in turn. ``inclusion`` is the probability of the
    copy beyond the source's whole ones: 1 for certain documents. A null or empty text has size 0 and takes no words;
    very long texts are certain in their source's sample. Repeated rows count each; which of them is taken does not
    show. Ties of the ranking go by key (null last), then by text hash. An empty table gives no rows. Other columns,
    whatever their names, are not looked at.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), words_of(F.col(text)).alias("size"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("h"))
    placed, _ = _placed(rows, weights, budget, cap)
    copies = F.col("whole") + (F.col("sure") | F.col("within") | F.col("filling")).cast("int")
    inclusion = F.when(F.col("sure"), 1.0).otherwise(F.col("rate") * F.col("size"))
    return placed.select(
        F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", inclusion.alias("inclusion"), copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document; edge cases as :func:`mix` states."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, text FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS n, (ARRAY[3.0, 1.0, 2.0])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS i
  FROM d GROUP BY source
), o AS (
  SELECT *, row_number() OVER (ORDER BY 2.0::DOUBLE * n / w, i) AS k FROM s
), f AS (
  SELECT *, 1.5::DOUBLE * sum(n) OVER () AS total,
         coalesce(sum(2.0::DOUBLE * n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
         sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_
  FROM o
), r AS (
  SELECT *, (total - full_) / left_ AS rate, first_value((total - full_) / left_) OVER (ORDER BY (CASE WHEN (total - full_) / left_ * w <= 2.0::DOUBLE * n THEN 0 ELSE 1 END), k) AS final,
         min(CASE WHEN (total - full_) / left_ * w <= 2.0::DOUBLE * n THEN k END) OVER () AS k0
  FROM f
), plan0 AS (
  SELECT source, n AS source_size, t AS target, CASE WHEN n > 0 THEN floor(t / n)::INTEGER ELSE 0 END AS whole, CASE WHEN n > 0 THEN t - floor(t / n) * n ELSE 0 END AS due0
  FROM (SELECT *, CASE WHEN k0 IS NULL OR k < k0 THEN 2.0::DOUBLE * n ELSE final * w END AS t FROM r)
), kinds AS (SELECT source, size, count(*) AS c FROM d GROUP BY source, size),
sums AS (
  SELECT source, size, c, (sum(size * c) OVER (PARTITION BY source) - sum(size * c) OVER u) AS larger, (sum(size::HUGEINT * size * c) OVER u)::DOUBLE AS squares
  FROM kinds WINDOW u AS (PARTITION BY source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), marked AS (
  SELECT sums.*, (due0 - larger::DOUBLE) * size >= squares AND size > 0 AND due0 > 0 AS sure FROM sums JOIN plan0 ON sums.source IS NOT DISTINCT FROM plan0.source
), cut AS (
  SELECT source, min(size) FILTER (sure) AS certain, max(squares) FILTER (NOT sure) AS rest, coalesce(sum(size * c) FILTER (sure), 0)::DOUBLE AS given FROM marked GROUP BY source
), plan AS (
  SELECT plan0.*, certain, due0 - given AS due, CASE WHEN rest > 0 THEN (due0 - given) / rest ELSE 0 END AS rate FROM plan0 JOIN cut ON plan0.source IS NOT DISTINCT FROM cut.source
), q AS (
  SELECT d.doc_id, d.size, d.text, plan.*, coalesce(size >= certain, FALSE) AS sure, rate * size AS p,
         (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source
), c AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) ELSE 'inf'::DOUBLE END, doc_id NULLS LAST, text
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM q WHERE NOT sure
), r2 AS (SELECT *, due > 0 AND upto <= due AS within, due - coalesce(max(CASE WHEN due > 0 AND upto <= due THEN upto END) OVER (PARTITION BY source), 0) AS rest FROM c),
f2 AS (
  SELECT *, CASE WHEN NOT within AND size > 0 AND abs(size - rest) < rest THEN row_number() OVER (
    PARTITION BY source, NOT within AND size > 0 AND abs(size - rest) < rest ORDER BY abs(size - rest), upto) END AS fill
  FROM r2
)
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN within OR fill = 1 THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM f2
UNION ALL SELECT doc_id, size, source_size, target, ((whole + 1) * size)::BIGINT FROM q WHERE sure
"""


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0 to 2 times); columns, whatever their names, stay as they are.

    A source's sample ends at one rank and has one more document, so the choice is a comparison of ranks and texts don't
    shuffle. Rows that share the last rank or the filling one are counted, and only as many go on as the mix takes, so
    taken words are as near to the targets as those of :func:`mix`. A null source is a source, the last; null and empty
    texts have no words and go, long texts count whole; rows without a doc_id rank after the others of equal odds. An empty
    table gives no rows.
    """
    names = docs.columns
    key, text, source = (F.col(f"d.`{c}`") for c in ("doc_id", "text", "source"))
    h = F.xxhash64(*[F.col(f"d.`{c}`") for c in sorted(names)])  # rows alike in all columns share a rank
    slim = docs.alias("d").select(key.alias("key"), source.cast("string").alias("source"), words_of(text).alias("size"), h.alias("h"))
    placed, plan = _placed(slim, WEIGHTS, 1.5, 2.0)
    last = placed.groupBy("source").agg(F.max(F.when(F.col("within"), F.col("rank"))).alias("last"), F.max(F.when(F.col("filling"), F.col("rank"))).alias("fill"))
    last = sized(last.select(F.col("source").alias("_s"), "last", "fill"), "last")
    counted = placed.where("not sure").join(last, F.col("source").eqNullSafe(F.col("_s")))
    edge = lambda c: F.count_if((F.col("within") | F.col("filling")) & F.col("rank").eqNullSafe(F.col(c)))
    cuts = counted.groupBy("_s", "last", "fill").agg(edge("last").alias("n_last"), edge("fill").alias("n_fill"))
    chosen = plan.join(cuts, F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")
    chosen = sized(chosen.select("_source", "whole", "certain", "rate", "last", "fill", "n_last", "n_fill"), "cuts")
    whole = docs.alias("d").select(F.struct(*[F.col(f"d.`{c}`") for c in names]).alias("row"), key.alias("key"), source.cast("string").alias("source"), words_of(text).alias("size"), h.alias("h"))
    ranked = _ranked(whole.join(chosen, F.col("source").eqNullSafe(F.col("_source"))))
    at_last, at_fill = (F.coalesce(F.col("rank").eqNullSafe(F.col(c)) & F.col(c).isNotNull(), F.lit(False)) for c in ("last", "fill"))
    state = F.when(F.col("sure"), F.lit(1)).when(at_last, F.lit(2)).when(at_fill, F.lit(3)).when(F.coalesce(F.col("rank") < F.col("last"), F.lit(False)), F.lit(1)).otherwise(F.lit(0))
    marked = ranked.select("row", "whole", state.alias("state"), "n_last", "n_fill")
    plain = marked.where("state < 2").select("row", (F.col("whole") + F.col("state")).alias("copies"))
    # At most two kinds of rows a source, each counted before it is shuffled.
    few = marked.where("state >= 2").groupBy("row", "whole", "state", "n_last", "n_fill").agg(F.count("*").alias("n"))
    few = few.select("row", (F.col("whole") * F.col("n") + F.when(F.col("state") == 2, F.col("n_last")).otherwise(F.col("n_fill"))).cast("int").alias("copies"))
    out = plain.unionByName(few).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select("row.*")

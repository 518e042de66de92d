"""Mixing sources to target weights by capped water-filling.

Sources get shares of a budget of words by weight.  A source never gives more
than ``max_epochs`` times its own words: sources above that are clamped, their
excess goes to the others in proportion to weight, and so on until no source is
above.  With the sources in the order of cap / weight this has a closed form:
the clamped ones are a prefix of that order.  A source's target is then made of
whole repetitions of all its documents and a fractional one: a prefix of its
documents in the order of a seeded hash that does not exceed the rest, and the
one document that best fills the gap.  The prefix sums are taken in two levels
(4096 hash buckets, then within the one bucket where the prefix ends), so a
source with a third of all rows is not one task.

Defined cases: a null text has size 0; a null source is a source of its own,
last in order; a source without words has target 0; a null doc_id is hashed
by its whole row; rows that repeat in all columns are taken equally often (the
fractional repetition takes all of them or none); no rows give no rows; other
columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import split_join, stored, with_own_names, word_count

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """source, source_size, target from rows with source and m_size: one row per
    source.  The windows below see one row per source only."""
    per = sizes.groupBy("source").agg(F.sum("m_size").alias("source_size"))
    names = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = per.withColumn("weight", F.get(cycle, ((F.row_number().over(names) - 1) % len(weights))))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = ranked.select(
        "source", "source_size", "weight", "cap",
        ((F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)).alias("level"),
    )
    clamped = F.col("cap") <= F.col("level") * F.col("weight")
    # The level of the first source that is not clamped holds for all after it;
    # of equal ratios the first has the highest level.
    final = -F.min(F.when(~clamped, F.struct((F.col("cap") / F.col("weight")).alias("r"), (-F.col("level")).alias("down")))).over(everything)["down"]
    return level.select("source", "source_size", F.when(clamped, F.col("cap")).otherwise(F.least(F.col("cap"), final * F.col("weight"))).alias("target"))


def _marked(docs: DataFrame, seed: str) -> DataFrame:
    """``docs`` with m_size, m_rank (the seeded hash of the identifier, then a
    hash of the whole row) and m_bucket (one of 4096 ranges of ranks)."""
    row = F.lpad(F.hex(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])), 16, "0")
    own = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), row))))
    return docs.select("*", word_count().alias("m_size"), F.concat(own, row).alias("m_rank")).withColumn("m_bucket", F.substring("m_rank", 1, 3))


def _plan(sized: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """One row per source: p_source, source_size, target, whole (repetitions of
    all its documents), cut (rank up to which documents are taken once more)
    and fill (rank of the document that fills the gap).  ``sized`` is a stored
    narrow table; rows of one rank count as one document."""
    targets = source_targets(sized, weights, max_epochs)
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    targets = targets.withColumnRenamed("source", "p_source").withColumn("whole", whole).withColumn("rest", F.col("target") - whole * F.col("source_size"))
    targets = stored(targets, "mix-targets")
    # One row per source and bucket, at most 4096 times the number of sources: the
    # bucket in which the prefix ends; only its documents are put in order.
    ahead = Window.partitionBy("source").orderBy("m_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = sized.groupBy("source", "m_bucket").agg(F.sum("m_size").alias("words")).withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    ends = buckets.join(targets, F.col("source").eqNullSafe(F.col("p_source"))).filter("ahead <= rest AND rest < ahead + words")
    ends = stored(ends.select("p_source", F.col("m_bucket").alias("p_bucket"), "ahead", "rest"), "mix-ends")
    inside = sized.filter("m_size > 0").join(ends, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("m_bucket") == F.col("p_bucket")))
    inside = inside.groupBy("p_source", "m_rank", "ahead", "rest").agg(F.sum("m_size").alias("words"))
    upto = F.col("ahead") + F.sum("words").over(Window.partitionBy("p_source").orderBy("m_rank"))
    taken = inside.withColumn("upto", upto).filter("upto <= rest").groupBy("p_source").agg(F.max("m_rank").alias("last"), F.max("upto").alias("upto"))
    cuts = ends.select("p_source", "p_bucket", "ahead").withColumnRenamed("p_source", "e_source").join(taken, F.col("e_source").eqNullSafe(F.col("p_source")), "left")
    # Without a document of its own bucket the prefix ends where the bucket begins.
    cuts = cuts.select("e_source", F.coalesce("last", "p_bucket").alias("e_cut"), F.coalesce("upto", "ahead").alias("e_got"))
    targets = targets.join(cuts, F.col("p_source").eqNullSafe(F.col("e_source")), "left")
    # A source without such a bucket has a rest of all its words or of none.
    targets = targets.withColumn("cut", F.coalesce("e_cut", F.when(F.col("rest") > 0, "g").otherwise("")))
    targets = stored(targets.withColumn("gap", F.col("rest") - F.coalesce("e_got", "rest")).drop("e_source", "e_cut", "e_got"), "mix-cuts")
    # The document nearest to the gap below the target fills it.
    miss = F.abs(F.col("m_size") - F.col("gap"))
    fill = sized.join(targets.select("p_source", "cut", "gap"), F.col("source").eqNullSafe(F.col("p_source"))).filter((F.col("m_rank") > F.col("cut")) & (F.col("m_size") > 0))
    fill = fill.filter(miss < F.col("gap")).groupBy("p_source").agg(F.min(F.struct(miss.alias("miss"), "m_rank"))["m_rank"].alias("fill"))
    # Where its row repeats, all of them would be taken: only if that still fits.
    fill = fill.withColumnRenamed("p_source", "f_source").join(targets.select("p_source", "gap"), F.col("f_source").eqNullSafe(F.col("p_source"))).drop("p_source")
    same = sized.join(fill, F.col("source").eqNullSafe(F.col("f_source")) & (F.col("m_rank") == F.col("fill")))
    same = same.groupBy("f_source", "fill", "gap").agg(F.sum("m_size").alias("words")).filter(F.abs(F.col("words") - F.col("gap")) < F.col("gap")).drop("words", "gap")
    out = targets.join(same, F.col("p_source").eqNullSafe(F.col("f_source")), "left")
    return stored(out.select("p_source", "source_size", "target", "whole", "cut", "fill"), "mix-plan")


def _planned(rows: DataFrame, sized: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """``rows`` with the plan of their source; a source with most of the rows is many tasks,
    however many sources there are."""
    counts = sized.groupBy(F.col("source").alias("c_source")).agg(F.count(F.lit(1)).alias("c_rows"))
    plan = _plan(sized, weights, max_epochs).join(counts, F.col("p_source").eqNullSafe(F.col("c_source"))).drop("c_source")
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    plan = stored(plan.withColumn("m_key", key("p_source")), "mix-plan-keys")
    return split_join(rows.withColumn("m_key", key("source")), plan, "m_key", "c_rows")


def _repeats() -> Column:
    extra = (F.col("m_rank") <= F.col("cut")) & (F.col("m_size") > 0)
    return F.col("whole") + extra.cast("long") + F.coalesce(F.col("m_rank") == F.col("fill"), F.lit(False)).cast("long")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target and
    repeats (how often the mix takes the document)."""
    sized = stored(_marked(docs, seed).select("doc_id", "source", "m_size", "m_rank", "m_bucket"), "mix-sizes")
    planned = _planned(sized, sized, weights, max_epochs)
    return planned.select("doc_id", "source", F.col("m_size").alias("size"), "source_size", "target", _repeats().alias("repeats"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, its
    columns unchanged.  Rows are told by their rank, which their own columns
    give; texts meet the plan of their source and are not shuffled while the
    sources are few, nor those of a large source."""
    return with_own_names(docs, lambda plain: _mix(plain, weights, max_epochs, seed))


def _mix(docs: DataFrame, weights: tuple[int, ...], max_epochs: int, seed: str) -> DataFrame:
    marked = _marked(docs, seed)
    sized = stored(marked.select("source", "m_size", "m_rank", "m_bucket"), "mix-sizes")
    planned = _planned(marked, sized, weights, max_epochs).withColumn("m_times", _repeats().cast("int"))
    return planned.filter("m_times > 0").withColumn("m_copy", F.explode(F.sequence(F.lit(1), F.col("m_times")))).select(*[F.col(f"`{c}`") for c in docs.columns])


MIX_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS rank
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size * 3.0::DOUBLE AS cap
  FROM s),
l AS (
  SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT source, source_size, CASE WHEN cap <= level * weight THEN cap
         ELSE least(cap, weight * (SELECT level FROM l WHERE NOT cap <= level * weight ORDER BY cap / weight, level DESC LIMIT 1)) END AS target
  FROM l),
p AS (
  SELECT doc_id, d.source, size, rank, source_size, target,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY rank, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead,
         CAST(CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS BIGINT) AS whole
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, target - whole * source_size AS rest, size > 0 AND ahead + size <= target - whole * source_size AS extra FROM p),
g AS (SELECT source AS g_source, rest - sum(CASE WHEN extra THEN size ELSE 0 END) AS gap FROM e GROUP BY source, rest),
f AS (
  SELECT doc_id AS f_id FROM (
    SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY abs(size - gap), rank, doc_id) AS n
    FROM e JOIN g ON source IS NOT DISTINCT FROM g_source WHERE NOT extra AND size > 0 AND abs(size - gap) < gap) WHERE n = 1)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN extra THEN 1 ELSE 0 END + CASE WHEN f_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM e LEFT JOIN f ON doc_id = f_id
"""

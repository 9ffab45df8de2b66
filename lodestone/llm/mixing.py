"""Operator 3: mixing sources to target weights along a time-varying curriculum.

DataFrame operations only. The steps:

1. Sizes and source totals are aggregated; water-filling turns weights into word targets,
   none above ``max_epochs`` times its source.
2. A source's schedule is a density over training time, linear between its start and end
   weight; integrated and scaled, it is the source's cumulative demand for words by time.
3. Each source lists its documents in a fixed pseudo-random order, epoch after epoch. The
   running count of words up to a document, by two-level prefix sums (fine buckets of the
   hash first, so that one hot source is many small windows), says which documents the
   target reaches, and the inverse of the demand curve when: the training position.
4. The rows are range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.shared import documents, written

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
#: Start and end of the schedules, as multiples of a source's mean weight, repeating.
RAMPS = ((1.0, 1.0), (1.5, 0.5), (0.5, 1.5))
#: Hash buckets of a source: at most 16 ** HEX_DIGITS.
HEX_DIGITS = 3

WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Words outside white space, without building them: each word leaves one mark."""
    return F.coalesce(F.length(F.regexp_replace(text, WORD, "\u0001")) - F.length(F.regexp_replace(text, WORD, "")), F.lit(0)).cast("bigint")


def targets(docs_sized: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight, target, ramp_from, ramp_to), one row a source.

    Sources are ranked by code point, null last. Water-filling in closed form: by rising
    size per weight, a source is capped while its cap is below its share of what the
    capped ones before it leave; the others share the rest by weight.
    """
    # the windows below run over one row a source
    sized = docs_sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("rank") - 1) % len(values) + 1)
    named = sized.withColumn("rank", rank).select("source", "rank", "source_size", pick([float(w) for w in weights]).alias("weight"), pick([a for a, _ in RAMPS]).alias("ramp_from"), pick([b for _, b in RAMPS]).alias("ramp_to"))
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rising = Window.orderBy(F.col("source_size") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    cap = F.lit(max_epochs) * F.col("source_size")
    filled = named.select(
        "*",
        F.sum("source_size").over(every).alias("total"),
        F.sum("weight").over(every).alias("all_weight"),
        F.coalesce(F.sum(cap).over(rising), F.lit(0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(rising), F.lit(0.0)).alias("weight_before"),
    )
    level = (F.col("total") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before"))
    filled = filled.withColumn("level", level).withColumn("capped", cap <= F.col("level") * F.col("weight"))
    # the level that the uncapped sources share is the first one's in this order
    shared = F.min(F.when(~F.col("capped"), F.struct(F.col("source_size") / F.col("weight"), F.col("rank"), F.col("level")))).over(every)
    target = F.when(F.col("capped"), cap.cast("double")).otherwise(F.col("weight") * shared["level"])
    return filled.select("source", "source_size", "weight", target.alias("target"), "ramp_from", "ramp_to")


def position_of(share: Column, ramp_from: Column, ramp_to: Column) -> Column:
    """Training time in [0, 1] at which a share of a source's demand is used up.

    The demand by time t is ramp_from * t + (ramp_to - ramp_from) * t^2 / 2 for ramps of
    mean 1; this is its inverse, in the form that stays stable as the ramp flattens.
    """
    root = F.sqrt(F.greatest(ramp_from * ramp_from + F.lit(2.0) * (ramp_to - ramp_from) * share, F.lit(0.0)))
    return F.least(F.when(share <= 0, F.lit(0.0)).otherwise(F.lit(2.0) * share / (ramp_from + root)), F.lit(1.0))


def plan_mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, carry: tuple[str, ...] = ()) -> DataFrame:
    """The mix of docs (doc_id, text, source): one row for each row of docs.

    Columns: doc_id, size, source_size, target, taken (words, repeats counted), copies,
    position (first use, null if unused). A document goes whole: it is taken in an epoch
    if the target reaches at least half of it, so a source's words differ from its target
    by half a document at most. No document is taken more than ``max_epochs`` times.

    Null and empty texts have size 0 and are never taken; a null source is a source of
    its own, the last; a null doc_id is ordered like any value; equal rows stay apart and
    may differ in copies by one; other columns are ignored; no rows give no rows. The
    order within a source is that of md5(doc_id), then doc_id, then size, then the columns
    of docs named in ``carry``, which the plan keeps: reruns agree.
    """
    # sizes are written once: three branches read them, and none should scan the texts again
    sized = written(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), *carry), "sizes")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    keyed = sized.withColumn("key", key).withColumn("bucket", F.substring("key", 1, HEX_DIGITS))
    buckets = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    # the windows over buckets hold at most 16 ** HEX_DIGITS rows a source
    by_bucket = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = buckets.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(by_bucket), F.lit(0)).alias("before_bucket"))
    plan = placed.alias("p").join(targets(sized, weights, max_epochs).alias("t"), F.expr("p.source <=> t.source")).select("p.source", "bucket", "before_bucket", "source_size", "target", "ramp_from", "ramp_to")
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", *carry).rowsBetween(Window.unboundedPreceding, -1)
    local = keyed.withColumn("before_here", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = local.alias("d").join(plan.alias("p"), F.expr("d.source <=> p.source AND d.bucket = p.bucket"))
    before = F.col("before_bucket") + F.col("before_here")
    # the document's middle in epoch e lies at e * source_size + before + size / 2
    reached = F.floor((F.col("target") - before - F.col("size") / 2.0) / F.col("source_size")).cast("bigint") + 1
    copies = F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(reached, F.lit(max_epochs).cast("bigint")))).otherwise(F.lit(0)).cast("bigint")
    mixed = joined.select("d.doc_id", "size", "source_size", "target", copies.alias("copies"), before.alias("before"), "ramp_from", "ramp_to", *carry)
    at = F.when(F.col("copies") > 0, position_of(F.col("before") / F.col("target"), F.col("ramp_from"), F.col("ramp_to")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "before", at.alias("position"), "ramp_from", "ramp_to", *carry)


def _uses(plan: DataFrame, *carry: str) -> DataFrame:
    used = plan.where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))
    share = (F.col("epoch") * F.col("source_size") + F.col("before")) / F.col("target")
    return used.select("doc_id", "epoch", position_of(share, F.col("ramp_from"), F.col("ramp_to")).alias("position"), *carry)


def mix_positions(plan: DataFrame) -> DataFrame:
    """One row for each use of a document: (doc_id, epoch, position), range-sorted.

    plan: of ``plan_mix``; documents that it does not take have no row; equal rows have each
    their own; a null doc_id stays null; an empty plan gives no rows.
    """
    return _uses(plan).orderBy("position", "doc_id", "epoch")


def mix_documents(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself: rows of docs with all their columns, one for each use, range-sorted by
    training position, then doc_id and epoch.

    Null and empty texts are never taken; rows with a null doc_id or source are mixed like any
    other; equal rows are mixed each by itself; other columns pass through under any names; no
    rows give no rows.
    """
    # rows are numbered in a table, so that the plan and the join see the same numbers; all of
    # a row is one struct, so that no name of its columns meets one of the plan's
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("number"))
    rows = written(packed, "rows")
    plain = rows.select("row.doc_id", "row.source", "row.text", "number")
    uses = _uses(plan_mix(plain, weights, max_epochs, ("number",)), "number").select("number", "position", "epoch")
    return rows.join(uses, "number").orderBy("position", "row.doc_id", "epoch", "number").select("row.*")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_mix(documents(spark, sf_dir))
    return plan.orderBy(F.col("position").asc_nulls_last(), "doc_id").select("doc_id", "size", "source_size", "target", "taken", "copies", "position")


#: The same plan in SQL, with one running sum a source in place of the two levels.
ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, ((rk - 1) % 3 + 1)::DOUBLE AS weight,
         CASE (rk - 1) % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END AS r0,
         CASE (rk - 1) % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 1.5::DOUBLE END AS r1,
         row_number() OVER (ORDER BY source_size / ((rk - 1) % 3 + 1), rk) AS o
  FROM src
), lev AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM weighed WINDOW b AS (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), flagged AS (
  SELECT *, 3 * source_size <= level * weight AS capped FROM lev
), tgt AS (
  SELECT *, CASE WHEN capped THEN (3 * source_size)::DOUBLE
                 ELSE weight * (SELECT arg_min(level, o) FROM flagged WHERE NOT capped) END AS target
  FROM flagged
), d AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.r0, t.r1,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(s.doc_id::VARCHAR, '')), s.doc_id, s.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN tgt t ON s.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, CASE WHEN size > 0 THEN greatest(0, least(3, floor((target - before - size / 2.0::DOUBLE) / source_size) + 1)) ELSE 0 END::BIGINT AS copies FROM d
)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies,
       CASE WHEN copies = 0 THEN NULL WHEN before / target <= 0 THEN 0.0::DOUBLE
            ELSE least(1.0::DOUBLE, 2.0 * (before / target) / (r0 + sqrt(greatest(0.0, r0 * r0 + 2.0 * (r1 - r0) * (before / target))))) END AS position
FROM c
"""

"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order, offered up to `epochs` times over.  A document's
virtual finish time is the number of its source's words up to its end, divided by the source's target.  All queues
are merged by finish time and the merged order is cut at the total budget; since each source passes its target
at time 1, the cut leaves each of them near its target.

The budget is `share` times all words.  Targets divide it by weight (weights repeat over the sources in code-point
order, NULL last); a target stops at `epochs` times its source's words and the excess goes to the others by weight.

Running sums are kept per (source, slice of the shuffle hash) and per slice of virtual time, so a source with a third
of all rows is spread over thousands of groups, and the sources' own table has one row per source.

Nulls: a NULL text has no words; NULL sources are one source; a NULL doc_id is a value of its own.  Rows equal in
doc_id, source and size are one unit and are taken together, the same number of times each.  Documents without words
take no budget.  An empty table gives an empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, carry, running_sum

WEIGHTS, SHARE, EPOCHS = (5, 2, 1), 1.5, 2
#: Slices of a source's shuffle hash (hex digits) and of a unit of virtual time.
HEX, SLICES = 3, 4096


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
            epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size); one row per source, by windows over that table.

    Sources stop at their limit in the order of limit / weight: the k-th of that order does if its limit is
    within what the budget left by those before it would give it.
    """
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights)).cast("int"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ratio = Window.orderBy(F.col("_limit") / F.col("_weight"), F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = (
        sizes.withColumn("_weight", weight)
        .withColumn("_limit", F.lit(float(epochs)) * F.col("source_size"))
        .withColumn("_budget", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("_rest", F.col("_budget") - F.coalesce(F.sum("_limit").over(before), F.lit(0.0)))
        .withColumn("_part", F.sum("_weight").over(after))
        .withColumn("_full", F.col("_limit") * F.col("_part") <= F.col("_rest") * F.col("_weight"))
    )
    open_rest = F.max(F.when(~F.col("_full"), F.col("_rest"))).over(everything)
    open_part = F.max(F.when(~F.col("_full"), F.col("_part"))).over(everything)
    target = F.when(F.col("_full"), F.col("_limit")).otherwise(F.col("_weight") * open_rest / open_part)
    return rows.select("source", "source_size", target.alias("target"), F.col("_budget").alias("budget"))


def mixed(units: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
          epochs: int = EPOCHS) -> DataFrame:
    """The mix of (doc_id, source, size, n_rows) units: source_size, target, copies and taken of each."""
    all_words = F.col("size") * F.col("n_rows")
    sizes = units.groupBy("source").agg(F.sum(all_words).alias("source_size"))
    goal = targets(sizes, weights, share, epochs).withColumnRenamed("source", "_source")
    queued = units.withColumn("_h", shuffle_key(F.col("doc_id")))
    queued = running_sum(
        queued, ["source"], F.substring("_h", 1, HEX), [F.col("_h"), F.col("doc_id"), F.col("size")],
        all_words, "_slice_words", "_before",
    ).drop("_bucket", "_slice_words")
    queued = queued.join(goal, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    offered = queued.withColumn("_epoch", F.explode(F.array(*[F.lit(e) for e in range(epochs)])))
    words = F.col("_epoch") * F.col("source_size") + F.col("_before") + all_words
    offered = offered.withColumn("_finish", F.coalesce(F.try_divide(words.cast("double"), F.col("target")), F.lit(0.0)))
    merged = running_sum(
        offered, [], F.floor(F.col("_finish") * SLICES).cast("long"),
        [F.col("_finish"), F.col("source").asc_nulls_last(), F.col("_epoch"), F.col("_h"), F.col("doc_id"), F.col("size")],
        all_words, "_all_words", "_start",
    )
    fits = F.col("_start") + all_words <= F.col("budget")
    return merged.groupBy("doc_id", "source", "size", "n_rows").agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target"),
        F.sum(F.when(fits, 1).otherwise(0)).cast("int").alias("copies"),
    ).withColumn("taken", F.col("size") * F.col("copies"))


def units_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", size_of(F.col("text")).alias("size")).groupBy("doc_id", "source", "size").agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    found = mixed(units_of(docs), weights, share, epochs)
    return found.withColumn("_each", F.explode(F.sequence(F.lit(1), F.col("n_rows")))).drop("_each", "n_rows")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                    epochs: int = EPOCHS) -> DataFrame:
    """The mix itself: each document's row as often as the mix takes it, with its own columns only.

    A document without words is kept once: it costs nothing.
    """
    found = mixed(units_of(docs), weights, share, epochs).select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"),
        F.when(F.col("size") == 0, 1).otherwise(F.col("copies")).alias("_copies"),
    ).where("_copies > 0")
    sized = carry(docs, "doc_id", "source", "text").withColumn("_words", size_of(F.col("text")))
    joined = sized.join(found, [
        F.col("doc_id").eqNullSafe(F.col("_id")), F.col("source").eqNullSafe(F.col("_source")),
        F.col("_words") == F.col("_size"),
    ])
    return joined.withColumn("_each", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


def mix_sql(documents: str = "documents") -> str:
    """DuckDB SQL for `mix` with the default parameters."""
    return f"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM {documents}
), u AS (
  SELECT doc_id, source, size, count(*) AS n_rows, md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM d GROUP BY ALL
), s AS (
  SELECT source, CAST(sum(size * n_rows) AS BIGINT) AS source_size FROM u GROUP BY source
), w AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight,
    2.0::DOUBLE * source_size AS most, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS budget FROM s
), r AS (
  SELECT *, budget - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS part FROM w
), f AS (
  SELECT *, most * part <= rest * weight AS filled FROM r
), t AS (
  SELECT source, source_size, budget, CASE WHEN filled THEN most
    ELSE weight * max(CASE WHEN NOT filled THEN rest END) OVER () / max(CASE WHEN NOT filled THEN part END) OVER () END AS target FROM f
), q AS (
  SELECT u.*, t.source_size, t.target, t.budget, coalesce(sum(u.size * n_rows) OVER (PARTITION BY u.source
    ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM u JOIN t ON u.source IS NOT DISTINCT FROM t.source
), o AS (
  SELECT *, CASE WHEN target = 0 THEN 0 ELSE CAST(epoch * source_size + before + size * n_rows AS DOUBLE) / target END AS finish
  FROM q, (SELECT unnest([0, 1]) AS epoch) e
), m AS (
  SELECT *, sum(size * n_rows) OVER (ORDER BY finish, source NULLS LAST, epoch, h, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= budget AS fits FROM o
), k AS (
  SELECT doc_id, source, size, n_rows, source_size, target, CAST(sum(CASE WHEN fits THEN 1 ELSE 0 END) AS INT) AS copies
  FROM m GROUP BY ALL
)
SELECT doc_id, source, size, source_size, target, copies, size * copies AS taken
FROM k, (SELECT unnest(generate_series(1, (SELECT coalesce(max(n_rows), 1) FROM u))) AS each) x WHERE each <= n_rows
"""

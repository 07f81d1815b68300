"""Mixing sources to target weights by systematic sampling.

Every document of a source expects target / source_size copies. The expected copies are
summed up in the order of (size, hash of the id); with one random offset a source, a
document is emitted once for each integer boundary that its stretch of the sum crosses.
Sorted by size, a source's taken words differ from its target by no more than about its
largest document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import WORD, materialise, table, with_row_id

#: No source is asked for more than this many times its size, so no document is taken more often.
MOST_COPIES = 3
WEIGHTS = (5, 2, 1)
SEED = "mix"


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], total: Column | None = None, most: float = MOST_COPIES) -> DataFrame:
    """source, source_size -> also weight and target; one row a source (null is one, last).

    Weights repeat over the sources in code point order. A target stops at most times the
    source's size; the excess goes to the others by weight until none is above. That
    fixed point has the sources capped that have the smallest room for their weight: with
    them in this order, a source is capped if the share that is left a unit of weight
    would fill it. One row a source stands in the window, not one a document.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("__total", (F.sum("source_size").over(whole) if total is None else total).cast("double"))
    w = w.withColumn("__room", F.col("source_size") * F.lit(float(most)) / F.col("weight"))
    before = Window.orderBy("__room", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("__capped", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(float(most)))
    w = w.withColumn("__rest", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    w = w.withColumn("__unit", (F.col("__total") - F.col("__capped")) / F.col("__rest"))
    # the first source that its share a unit doesn't fill settles the unit of all the following
    unit = F.min(F.when(F.col("__unit") <= F.col("__room"), F.struct("__room", F.col("source").isNull(), "source", "__unit"))).over(whole)["__unit"]
    w = w.withColumn("__unit", unit)
    full = F.col("source_size") * F.lit(float(most))
    return w.select("source", "source_size", "weight", F.when(F.col("__unit").isNull() | (F.col("__unit") > F.col("__room")), full).otherwise(F.col("__unit") * F.col("weight")).alias("target"))


def offset(source: Column, seed: str) -> Column:
    """A source's random offset in [0, 1): 16 bits, so that sums of up to 2 ** 37 stay exact."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("")))), 1, 4), 16, 10).cast("double") / F.lit(65536.0)


def mix_sources(df: DataFrame, doc_id: str, text: str, source: str, weights: tuple[float, ...] = WEIGHTS, seed: str = SEED, most: float = MOST_COPIES) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row for each row of df.

    Null source: a source of its own, last in order. Null or empty text: size 0. Null and
    repeated ids: each row counts; equal rows are interchangeable. Empty table: no rows.
    Other columns are not looked at. Reruns agree: the order is total up to equal rows.

    The sizes are counted once and written. Then rows are dealt by ranges of (source,
    size, hash), which splits a hot source over many tasks; each task numbers its own rows
    and the counts of (range, source) give the offset of each range's first row.
    """
    sized = materialise(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size")), "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, most=most)
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    ranged = sized.withColumn("key", key).repartitionByRange(F.col("source").isNull(), "source", "size", "key")
    local = Window.partitionBy("part", "source").orderBy("size", "key")
    # as written: the range bounds of one run are not those of another
    held = materialise(ranged.withColumn("part", F.spark_partition_id()), "ranges")
    firsts = held.groupBy("source", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    firsts = firsts.alias("f").join(targets.alias("t"), F.col("f.source").eqNullSafe(F.col("t.source"))).select(F.col("f.source").alias("s"), F.col("f.part").alias("p"), "first", "source_size", "target")
    ranked = held.withColumn("rank", F.row_number().over(local))
    out = ranked.join(firsts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    k, u = (F.col("rank") + F.col("first")).cast("double"), offset(F.col("source"), seed)
    copies = (F.floor(rate * k + u) - F.floor(rate * (k - 1) + u)).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(df: DataFrame, doc_id: str, text: str, source: str, **how) -> DataFrame:
    """df's rows, each as often as the mix takes it."""
    rows, row = with_row_id(df, doc_id)
    copies = mix_sources(rows, row, text, source, **how).where("copies > 0").select(F.col("doc_id").alias("__taken"), "copies")
    taken = rows.join(copies, F.col(f"`{row}`") == F.col("__taken")).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return taken.select(*(F.col(f"`{c}`") for c in df.columns))


def op5(spark, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return out.select("doc_id", "size", "source_size", "target", "taken")


#: For integer weights and a share of 100 %.
OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, CAST(CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight FROM totals
), room AS (
  SELECT *, source_size * CAST(3 AS DOUBLE) / weight AS room FROM weighted
), steps AS (
  SELECT a.source,
    (CAST((SELECT sum(source_size) FROM room) AS DOUBLE) - 3 * CAST(coalesce(sum(b.source_size), 0) AS DOUBLE))
      / ((SELECT sum(weight) FROM room) - coalesce(sum(b.weight), 0)) AS unit, a.room
  FROM room a LEFT JOIN room b ON (b.room, b.source IS NULL, coalesce(b.source, '')) < (a.room, a.source IS NULL, coalesce(a.source, ''))
  GROUP BY a.source, a.room
), unit AS (
  SELECT (SELECT unit FROM steps WHERE unit <= room ORDER BY room, source IS NULL, source LIMIT 1) AS unit
), targets AS (
  SELECT source, source_size, CASE WHEN unit IS NULL OR unit > room THEN source_size * CAST(3 AS DOUBLE) ELSE unit * weight END AS target FROM room, unit
), ranked AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    CAST(row_number() OVER (PARTITION BY s.source ORDER BY s.size, md5(coalesce(CAST(s.doc_id AS VARCHAR), ''))) AS DOUBLE) AS k,
    CAST(CAST('0x' || substr(md5('mix:' || coalesce(s.source, '')), 1, 4) AS INTEGER) AS DOUBLE) / 65536 AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST((floor(rate * k + u) - floor(rate * (k - 1) + u)) * size AS BIGINT) AS taken FROM ranked
"""

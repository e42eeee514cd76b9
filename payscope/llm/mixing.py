"""Mixing sources to target weights by systematic sampling (operator 3).

Every document of a source has the same expected number of copies, target / source size.  The
documents of a source stand in one order; the prefix sum of the expected copies is taken along it,
one random offset is added, and a document is emitted once for each integer boundary its step crosses.

*Order.* Ascending by size cell (sizes that share their leading five bits), so that each source's words
come within about one document of its target, then by hash slice, size, id and row hash.  A slice is drawn by id and
text together, so neither rows of one id (or of none) nor copies of one text gather in one; only rows that repeat in both
do.  A slice holds about ``ROWS_PER_SLICE`` rows, however many rows a source has: rows are numbered inside (source, cell,
slice) and the start of each slice comes from a running sum over the small slice table.

*Draw.* For each source, draws of an offset, uniform from the seed, and an order (the one above, or its places times a prime modulo
the source's rows, a permutation) are made, all from the one numbering; the draw whose words come nearest the target is used
(rejective systematic sampling).

Cases: null text has size 0; a null source is a source of its own, last in order; a document of size 0 may
be emitted (0 words); sources without words have target 0 and are not emitted; repeated rows count each;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from payscope.llm.common import WORD, free_name, keep, table, text_or_empty

MAX_REPEATS = 3
ROWS_PER_SLICE = 1000
#: Order of each draw: factor of the places (1: as they are).
FACTORS = [1] * 8 + [p for p in range(1000, 1200) if all(p % k for k in range(2, 35))][:24]
SEED = "mix-1"


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def size_cell(size: Column) -> Column:
    """Sizes that share the leading five bits; ascending with size."""
    shift = F.greatest(F.lit(0), F.length(F.bin(size)) - 5)
    return (shift * 16 + F.call_function("shiftright", size, shift)).cast("long")


def _hash60(*parts: Column) -> Column:
    """60 bits of MD5 of the parts joined by ':', as long (null parts read 'null')."""
    joined = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Target words of each row of (source, source_size).

    Weights 1, 2, 3 repeat along the sources by code point, null last.  The common level ``lam`` with
    sum(min(max_repeats * size, lam * weight)) = all words is where resharing the excess ends: along
    ascending max_repeats * size / weight, a source is held at its limit as long as the level that is
    left for it and the later ones reaches it.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    by_level = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, onward = by_level.rowsBetween(W.unboundedPreceding, -1), by_level.rowsBetween(0, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).partitionBy()
    t = (sources.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1)
         .withColumn("cap", max_repeats * F.col("source_size"))
         .withColumn("total", F.sum("source_size").over(everything))
         .withColumn("held", F.col("cap") / F.col("weight") <=
                     (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward))
         .withColumn("lam", F.sum(F.when(~F.col("held"), F.col("weight"))).over(everything)))
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("held"), F.col("cap"))).over(everything), F.lit(0))
    return t.select("source", "source_size", "weight",
                    F.when(F.col("held"), F.col("cap").cast("double"))
                    .otherwise(F.col("weight") * left / F.col("lam")).alias("target"))


class MixPlan:
    """Statistics of a mix: ``slices`` (source, cell -> number of slices) and ``starts`` (source, cell, slice ->
    rows before it in its source, rows of the source, expected copies, offset, factor); both are written tables."""

    def __init__(self, slices: DataFrame, starts: DataFrame):
        self.slices, self.starts = slices, starts


def _numbered(rows: DataFrame, slices: DataFrame, starts: DataFrame) -> DataFrame:
    """``rows`` (_source, _size, _id, _mark, _tie, ...) with the place of each row in its source and the columns of ``starts``."""
    rows = rows.withColumn("_cell", size_cell(F.col("_size")))
    on = rows["_source"].eqNullSafe(slices["source"]) & (rows["_cell"] == slices["cell"])
    rows = rows.join(slices, on).drop("source", "cell").withColumn(
        "_slice", F.when(F.col("n_slices") > 1, F.pmod(F.col("_mark"), F.col("n_slices"))).otherwise(F.lit(0))).drop("n_slices")
    place = W.partitionBy("_source", "_cell", "_slice").orderBy("_size", "_id", "_tie")
    rows = rows.withColumn("_place", F.row_number().over(place) - 1)
    on = rows["_source"].eqNullSafe(starts["source"]) & (rows["_cell"] == starts["cell"]) & (rows["_slice"] == starts["slice"])
    return rows.join(starts, on).drop("source", "cell", "slice").withColumn("_place", F.col("_place") + F.col("start"))


def _copies(u: Column, factor: Column) -> Column:
    """Integer boundaries that a row's step crosses at its place of the draw."""
    place = F.when(F.col("n_rows") % factor == 0, F.col("_place")).otherwise(F.pmod(F.col("_place") * factor, F.col("n_rows")))
    step = lambda place: F.floor(place * F.col("expected") + u)
    return step(place + 1) - step(place)


def plan_mix(rows: DataFrame, seed: str = SEED, max_repeats: int = MAX_REPEATS) -> MixPlan:
    """Plan a mix of ``rows`` (_source, _size, _id, _mark, _tie)."""
    cells = keep(rows.groupBy(F.col("_source").alias("source"), size_cell(F.col("_size")).alias("cell"))
                 .agg(F.count("*").alias("n"), F.sum("_size").alias("words"))
                 .withColumn("n_slices", F.ceil(F.col("n") / ROWS_PER_SLICE).cast("long")), "mix-cells")
    per_source = cells.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n_rows"))
    sources = targets(per_source.drop("n_rows"), max_repeats).join(per_source.select(F.col("source").alias("_s"), "n_rows"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    sources = keep(sources.withColumn("expected", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
                                      .otherwise(F.lit(0.0))), "mix-sources")
    slices = cells.select("source", "cell", "n_slices")
    # rows before each slice: slices that got no row need no entry
    whole = cells.where("n_slices = 1").select("source", "cell", F.lit(0).cast("long").alias("slice"), "n")
    cut = cells.where("n_slices > 1").select(F.col("source").alias("_s"), F.col("cell").alias("_c"), "n_slices")
    split = (rows.withColumn("_cell", size_cell(F.col("_size")))
             .join(cut, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_cell") == F.col("_c")))
             .groupBy(F.col("_source").alias("source"), F.col("_cell").alias("cell"),
                      F.pmod(F.col("_mark"), F.col("n_slices")).alias("slice")).agg(F.count("*").alias("n")))
    along = W.partitionBy("source").orderBy("cell", "slice")
    at = whole.unionByName(split).withColumn("start", F.sum("n").over(along) - F.col("n")).drop("n")
    s = sources.withColumnRenamed("source", "_s")
    starts = keep(at.join(s, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "mix-starts")
    draw = lambda j: _hash60(F.lit(seed), F.lit(j), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))) / F.lit(2.0 ** 60)
    place = _numbered(rows, slices, starts).withColumn("source", F.col("_source"))
    words = place.groupBy("source").agg(F.first("target").alias("target"), *[
        F.sum(F.col("_size") * _copies(draw(j), F.lit(f).cast("long"))).alias(f"w{j}") for j, f in enumerate(FACTORS)])
    best = F.least(*[F.struct(F.abs(F.col(f"w{j}") - F.col("target")).alias("off"), F.lit(j).alias("j"), draw(j).alias("u"), F.lit(f).cast("long").alias("f"))
                     for j, f in enumerate(FACTORS)])
    chosen = keep(words.select(F.col("source").alias("_s"), best["u"].alias("u"), best["f"].alias("factor")), "mix-offsets")
    starts = keep(starts.join(chosen, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "mix-plan")
    return MixPlan(slices, starts)


def _keyed(docs: DataFrame, id_col: str, source_col: str, text_col: str, *more: Column) -> DataFrame:
    return docs.select(F.col(source_col).alias("_source"), word_count(text_col).alias("_size"), F.col(id_col).alias("_id"),
                       _hash60(F.col(id_col), F.col(text_col)).alias("_mark"),
                       F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("_tie"), *more)


def sample_copies(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                  seed: str = SEED, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per document: id, size, source_size, target, expected, copies, taken (copies * size)."""
    rows = keep(_keyed(docs, id_col, source_col, text_col), "mix-sizes")
    plan = plan_mix(rows, seed, max_repeats)
    copies = _numbered(rows, plan.slices, plan.starts).withColumn("copies", _copies(F.col("u"), F.col("factor")))
    return copies.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target",
                         (F.col("copies") * F.col("_size")).alias("taken"), "expected", "copies",
                         F.col("_source").alias(source_col))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        seed: str = SEED, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is drawn, with the columns of ``docs``."""
    names = docs.columns
    plan = plan_mix(keep(_keyed(docs, id_col, source_col, text_col), "mix-sizes"), seed, max_repeats)
    whole = free_name(["_source", "_size", "_id", "_mark", "_tie"], "_row")
    rows = _keyed(docs, id_col, source_col, text_col, F.struct(*[F.col(f"`{c}`") for c in names]).alias(whole))
    drawn = _numbered(rows, plan.slices, plan.starts).withColumn("copies", _copies(F.col("u"), F.col("factor"))).where("copies > 0")
    return drawn.select(whole, F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select(
        *[F.col(whole).getField(c).alias(c) for c in names])


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_copies(table(spark, sf_dir, "documents"))


QUERIES = {"op3_mix_sources": op3_mix_sources}

_DRAW = f"CAST(concat('0x', substr(md5(concat('{SEED}:', j, ':', coalesce(concat('s', source), 'n'))), 1, 15)) AS BIGINT) / 1152921504606846976.0"
ORACLE_SQL = {"op3_mix_sources": f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST(concat('0x', substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), 'null'), ':', coalesce(text, 'null'))), 1, 15)) AS BIGINT) AS mark FROM documents),
c AS (SELECT *, greatest(0, length(bin(size)) - 5) AS sh FROM d),
cell AS (SELECT doc_id, source, size, mark, CAST(sh * 16 + (size >> CAST(sh AS INT)) AS BIGINT) AS cell FROM c),
n AS (SELECT *, CAST(ceil(count(*) OVER (PARTITION BY source, cell) / {ROWS_PER_SLICE}.0) AS BIGINT) AS k FROM cell),
sl AS (SELECT *, CASE WHEN k > 1 THEN mark % k ELSE 0 END AS slice FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY cell, slice, size, doc_id) - 1 AS place FROM sl),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_rows FROM d GROUP BY source),
s1 AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s0),
s2 AS (SELECT *, {MAX_REPEATS} * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s1),
s3 AS (SELECT *, cap / weight <= (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS held FROM s2),
s4 AS (SELECT source, source_size, n_rows, CASE WHEN held THEN CAST(cap AS DOUBLE) ELSE
          weight * (total - coalesce(sum(cap) FILTER (WHERE held) OVER (), 0)) / sum(weight) FILTER (WHERE NOT held) OVER () END AS target FROM s3),
s AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS expected FROM s4),
p AS (SELECT r.doc_id, r.size, r.place, s.* FROM r JOIN s ON r.source IS NOT DISTINCT FROM s.source),
u AS (SELECT source, j, {_DRAW} AS u, {FACTORS}[j + 1] AS f FROM s, range({len(FACTORS)}) g(j)),
q AS (SELECT p.*, u.j, u.u, CASE WHEN n_rows % f = 0 THEN place ELSE (place * f) % n_rows END AS spot FROM p JOIN u ON p.source IS NOT DISTINCT FROM u.source),
c2 AS (SELECT *, CAST(floor((spot + 1) * expected + u) - floor(spot * expected + u) AS BIGINT) AS copies FROM q),
w AS (SELECT source, j, abs(sum(size * copies) - any_value(target)) AS off FROM c2 GROUP BY source, j),
b AS (SELECT source, j FROM w QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, j) = 1),
o AS (SELECT c2.* FROM c2 JOIN b ON c2.source IS NOT DISTINCT FROM b.source AND c2.j = b.j)
SELECT doc_id, size, source_size, target, copies * size AS taken, expected, copies, source FROM o
"""}

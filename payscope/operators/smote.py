"""SMOTE: synthetic rows between neighbours of the smaller class (ML15).

*Neighbours without pairs.* Standardised rows get several sort keys.  A key interleaves the bits of four random projections, so rows
that are close in it are close in four directions.  Rows are range-partitioned by (key, hash of the id), which keeps a value that
many rows share from filling a partition, and sorted.  A task reads its sorted rows batch by batch, measures each row
against the ``reach`` rows before and after it, and keeps the ``k`` nearest.  The few candidates of all orders are merged per row.
Work is rows * orders * reach; nothing is joined with itself.

*Rows.* Each row of the smaller class gives as many synthetic rows as balance asks for (counts differ by at most one), each at a
random share of the way to one of its neighbours.  Draws come from hashes of the id, so they can be replayed.

Cases: NULL and NaN features count as the class's mean; ``id_col`` must be unique (rows without id take no part); constant features
do not matter; equal rows are neighbours at distance 0; a class of one row, or two classes of one size, give no synthetic rows; the
larger class and the original rows stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from payscope.functions import expr as X
from payscope.operators import windows as W
from payscope.session import cut_lineage

K = 5
ORDERS = 8
REACH = 64
PROJECTIONS = 4
BITS = 15


def _present(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


def standardised(df: DataFrame, features: Sequence[str], out: str = "_x") -> tuple[DataFrame, list[float]]:
    """``df`` with the standardised features as an array (missing: the mean), and the means."""
    stats = df.agg(*[x for i, c in enumerate(features) for x in (F.avg(_present(c)).alias(f"m{i}"), F.stddev_pop(_present(c)).alias(f"s{i}"))]).first()
    means = [float(stats[f"m{i}"] or 0.0) for i in range(len(features))]
    scaled = [(F.coalesce(_present(c), F.lit(means[i])) - means[i]) / float(stats[f"s{i}"] or 1.0) for i, c in enumerate(features)]
    return df.withColumn(out, F.array(*scaled)), means


def sort_keys(x: np.ndarray, orders: int, seed: int) -> list[np.ndarray]:
    """For each order the interleaved bits of random projections of the rows of ``x``; directions depend on the seed alone."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(orders):
        direction = rng.normal(size=(x.shape[1], PROJECTIONS))
        direction /= np.linalg.norm(direction, axis=0)
        # a squashed standard normal spreads about evenly over the cells
        cell = (((1 << BITS) - 1) / (1 + np.exp(-1.702 * np.clip(x @ direction, -30, 30)))).astype(np.int64)
        key = np.zeros(len(x), np.int64)
        for bit in range(BITS - 1, -1, -1):
            for j in range(PROJECTIONS):
                key = (key << 1) | ((cell[:, j] >> bit) & 1)
        out.append(key)
    return out


def nearest_in_line(x: np.ndarray, line: np.ndarray, k: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances and places of the ``k`` nearest among the ``reach`` rows before and after each row of the same ``line``."""
    n = len(x)
    dist, at = np.full((n, 2 * reach), np.inf), np.zeros((n, 2 * reach), np.int64)
    for j in range(1, min(reach, n - 1) + 1):
        d = np.where(line[:-j] == line[j:], ((x[:-j] - x[j:]) ** 2).sum(axis=1), np.inf)
        dist[:-j, j - 1], at[:-j, j - 1] = d, np.arange(j, n)
        dist[j:, reach + j - 1], at[j:, reach + j - 1] = d, np.arange(n - j)
    best = np.argpartition(dist, min(k, 2 * reach) - 1, axis=1)[:, :k]
    return np.take_along_axis(dist, best, 1), np.take_along_axis(at, best, 1)


def _matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The rows of a list column; missing numbers are NaN."""
    return np.asarray(pc.list_flatten(vectors).to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(vectors), -1)


def neighbours(df: DataFrame, id_col: str, vector: str, k: int = K, orders: int = ORDERS, reach: int = REACH, seed: int = 42,
               partitions: int | None = None) -> DataFrame:
    """(id, neighbours): up to ``k`` (dist, id), nearest first, of each row of ``df``; approximate, found in ``orders`` sort orders."""
    id_field = StructField("id", df.schema[id_col].dataType)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1)) if b.num_rows else None
            for order, key in enumerate(sort_keys(x, orders, seed) if b.num_rows else []):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), order, np.int32)), pa.array(key), b.column(0), b.column(1)], ["line", "key", "id", "x"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for b in batches:
            b = pa.Table.from_batches([b])
            t = b if before is None else pa.concat_tables([before, b])
            t = t.combine_chunks()
            before = t.slice(max(t.num_rows - reach, 0))  # measured again with the rows that follow
            if t.num_rows < 2:
                continue
            x = _matrix(t["x"].combine_chunks())
            dist, at = nearest_in_line(x, t["line"].to_numpy(), k, reach)
            found = np.isfinite(dist)
            ids = t["id"].combine_chunks()
            pairs = pa.StructArray.from_arrays([pa.array(dist[found]), ids.take(pa.array(at[found]))], ["dist", "id"])
            ends = pa.array(np.append(0, np.cumsum(found.sum(axis=1))), pa.int32())
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(ends, pairs)], ["id", "found"])

    pair = StructType([StructField("dist", DoubleType()), id_field])
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).alias("x"))
    t = rows.mapInArrow(keyed, StructType([*StructType.fromDDL("line int, key long").fields, id_field, StructField("x", ArrayType(DoubleType()))]))
    by = ["line", "key", F.xxhash64("id")]
    t = t.repartitionByRange(partitions, *by) if partitions else t.repartitionByRange(*by)
    t = t.sortWithinPartitions(*by).mapInArrow(near, StructType([id_field, StructField("found", ArrayType(pair))]))
    merged = F.array_sort(F.array_distinct(F.flatten(F.collect_list("found"))))  # at most a few times orders * k entries
    return t.groupBy("id").agg(F.slice(merged, 1, k).alias("neighbours"))


def smote(df: DataFrame, features: Sequence[str], label: str = "result_numeric", id_col: str = "transaction_id", k: int = K,
          seed: int = 42, orders: int = ORDERS, reach: int = REACH) -> DataFrame:
    """``df`` (features as double, label, id) and the synthetic rows that bring the smaller class up to the larger one:
    ``synthetic``, and for synthetic rows base_id, neighbour_id and share (their own id is NULL)."""
    counts = {r[0]: r[1] for r in df.where(F.col(label).isNotNull()).groupBy(label).count().collect()}  # a row per class
    if len(counts) > 2:
        raise ValueError(f"{label} has more than two classes")
    values = [F.col(c).cast("double").alias(c) for c in features]
    id_type = df.schema[id_col].dataType
    originals = df.select(id_col, *values, label, F.lit(False).alias("synthetic"), F.lit(None).cast(id_type).alias("base_id"),
                          F.lit(None).cast(id_type).alias("neighbour_id"), F.lit(None).cast("double").alias("share"))
    if len(counts) < 2 or len(set(counts.values())) == 1:
        return originals
    small, large = sorted(counts, key=lambda v: (counts[v], v))
    few, means = standardised(df.where((F.col(label) == small) & F.col(id_col).isNotNull()).select(id_col, *values), features)
    filled = F.array(*[F.coalesce(_present(c), F.lit(m)) for c, m in zip(features, means)])
    few = cut_lineage(few.select(F.col(id_col).alias("id"), filled.alias("v"), "_x"))
    found = neighbours(few, "id", "_x", k, orders, reach, seed)
    # place r of n rows in hash order: floor((r + 1) * wanted / n) - floor(r * wanted / n) copies
    n, wanted = few.count(), counts[large] - counts[small]
    r = W.row_index(few.withColumn("_h", F.md5(F.col("id").cast("string"))), [], ["_h"], "r", slice_col=F.substring("_h", 1, 4)).select("id", "v", "r")
    upto = lambda place: F.floor(place.cast("decimal(38,0)") * wanted / n)
    each = r.join(found, "id").where(F.size("neighbours") > 0).withColumn("copies", (upto(F.col("r")) - upto(F.col("r") - 1)).cast("int"))
    each = each.where("copies > 0").select("id", "v", "neighbours", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    draw = lambda what: X.hash_uniform("id", F.concat(F.lit(f"{what} "), F.col("copy").cast("string")), seed=seed)
    each = each.select(F.col("id").alias("base_id"), F.col("v").alias("a"), draw("share").alias("share"),
                       F.element_at("neighbours", (F.floor(draw("neighbour") * F.size("neighbours")) + 1).cast("int"))["id"].alias("neighbour_id"))
    each = each.join(few.select(F.col("id").alias("neighbour_id"), F.col("v").alias("b")), "neighbour_id")
    between = [(F.col("a")[i] + F.col("share") * (F.col("b")[i] - F.col("a")[i])).alias(c) for i, c in enumerate(features)]
    made = each.select(F.lit(None).cast(id_type).alias(id_col), *between, F.lit(small).cast(df.schema[label].dataType).alias(label),
                       F.lit(True).alias("synthetic"), "base_id", "neighbour_id", "share")
    return originals.unionByName(made)

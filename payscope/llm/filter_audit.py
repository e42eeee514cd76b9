"""Audit of how filters interact under every order of applying them (operator 13).

*Mask cells.* Each document gets one bit per filter that it fails.  Documents are counted per part and mask, with the counts of
good and toxic labels: at most 2^k cells a part for k filters, whatever the table's size.

*Enumeration.* A recursive CTE starts with an empty prefix per part and extends each prefix by every letter not yet in it,
carrying the bits applied.  Each level joins the part's cells and emits that step's counts: a cell is gone if its mask meets
the bits applied before, removed here if it then meets the new bit.  The last level holds all k! orders with their k steps.
The recursion makes 326 rows a part for five filters and reads only the cells.

*Copies.* A filter that fails later copies of a text needs the smallest id of each text: one aggregation by digest (SHA-256),
combined before its shuffle, then a join on (digest, id), so that a group of copies of any size is spread over its ids.

Cases: null and empty texts are the same text, without words; a null part is the empty string; a null id is neither a later
copy nor an earlier one, and has no labels; repeated rows count each; repeated labels of an id count once, a label holding if
any of them has it; an empty table gives an empty result; columns other than id, text and part are left out, so names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType
from pyspark.sql.window import Window as W

from payscope.llm.common import keep, table, text_or_empty

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_FOLLOWING = bytes(range(0x80, 0xC0))  # bytes that continue a UTF-8 code point
_SYMBOLS = b"#$%&*|"


def _holding(text: bytes, some: bytes) -> int:
    return len(text) - len(text.translate(None, some))


def few_words(text: bytes, words: list[bytes]) -> bool:
    return len(words) < 50


def repetitive(text: bytes, words: list[bytes]) -> bool:
    return 100 * len(set(words)) < 65 * len(words)


def shouting(text: bytes, words: list[bytes]) -> bool:
    return 100 * _holding(text, _UPPER) > 5 * (len(text) - _holding(text, _FOLLOWING))


def symbols(text: bytes, words: list[bytes]) -> bool:
    return _holding(text, _SYMBOLS) > 0


#: Conditions on a text by letter; the next letter is the filter of later copies.
CONDITIONS: dict[str, Callable[[bytes, list[bytes]], bool]] = {"A": few_words, "B": repetitive, "C": shouting, "D": symbols}
COPIES = "E"


def text_masks(docs: DataFrame, conditions: dict = CONDITIONS, id_col: str = "doc_id", text_col: str = "text",
               part_col: str = "source") -> DataFrame:
    """(id, part, digest, mask): bit i of ``mask`` says that the whole text fails the i-th condition.

    ``bytes.split`` cuts at the space and the ASCII controls tab to carriage return, no others.
    """
    tests = [(1 << i, c) for i, c in enumerate(conditions.values())]

    def mask(text: bytes) -> int:
        words = text.split()
        return sum(bit for bit, fails in tests if fails(text, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            masks, digests = [], []
            for text in b.column(2):
                text = text.as_py()
                masks.append(mask(text))
                digests.append(hashlib.sha256(text).digest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digests, b.schema.field(2).type), pa.array(masks, pa.int32())],
                                             ["id", "part", "digest", "mask"])

    columns = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                          text_or_empty(text_col).cast("binary").alias("text"))
    schema = StructType([StructField("id", columns.schema["id"].dataType), columns.schema["part"], StructField("digest", BinaryType()),
                         StructField("mask", IntegerType())])
    return columns.mapInArrow(run, schema)


def with_copies(rows: DataFrame, bit: int) -> DataFrame:
    """(id, part, mask, n): equal rows of ``rows`` together, ``bit`` added where a smaller id has the same digest."""
    rows = rows.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    known, nulls = rows.where("id IS NOT NULL"), rows.where("id IS NULL")
    first = rows.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    later = F.when(F.col("first").isNull(), F.lit(bit)).otherwise(F.lit(0))
    return (known.join(first, ["digest", "id"], "left").select("id", "part", F.col("mask").bitwiseOR(later).alias("mask"), "n")
            .unionByName(nulls.select("id", "part", "mask", "n")))


def mask_cells(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """(part, cells): for each part an array of (mask, n, good, toxic), at most one entry a mask."""
    flags = (labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
             .agg(F.max((F.col(good) == 1).cast("int")).alias("good"), F.max((F.col(toxic) == 1).cast("int")).alias("toxic")))
    known = rows.where("id IS NOT NULL").join(flags, "id", "left").select("part", "mask", "n", "good", "toxic")
    none = F.lit(None).cast("int")
    both = known.unionByName(rows.where("id IS NULL").select("part", "mask", "n", none.alias("good"), none.alias("toxic")))
    count = lambda flag: F.sum(F.col("n") * F.coalesce(F.col(flag), F.lit(0))).alias(flag)
    cells = both.groupBy("part", "mask").agg(F.sum("n").alias("n"), count("good"), count("toxic"))
    return cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))


# ``{count}`` sums a count over the cells that meet a condition on their mask ``m.mask``
_WALK = """
WITH RECURSIVE walk(part, filter_order, applied, steps) AS (
  SELECT part, '', 0, CAST(array() AS ARRAY<{step}>) FROM {{cells}}
  UNION ALL
  SELECT w.part, concat(w.filter_order, f.letter), w.applied | f.bit,
         array_append(w.steps, struct(
           CAST(length(w.filter_order) + 1 AS INT) AS step, f.letter AS letter,
           {kept} AS kept, {removed} AS removed, {redundant} AS redundant, {unique_fails} AS unique_fails,
           {good_lost} AS good_lost, {toxic_lost} AS toxic_lost))
  FROM (SELECT part, filter_order, applied, steps,
               explode(filter(array({letters}), x -> applied & x.bit = 0)) AS f FROM walk) w
  JOIN {{cells}} c ON c.part = w.part
)
SELECT part, filter_order, inline(steps) FROM walk WHERE length(filter_order) = {k}
"""
_STEP = ("STRUCT<step: INT, letter: STRING, kept: BIGINT, removed: BIGINT, redundant: BIGINT, unique_fails: BIGINT, "
         "good_lost: BIGINT, toxic_lost: BIGINT>")


def walk_sql(letters: str) -> str:
    """The recursive query over ``{cells}`` (part, cells) for filters whose bits are 1, 2, 4, ... in the order of ``letters``."""

    def count(what: str, when: str) -> str:
        return f"aggregate(filter(c.cells, m -> {when}), 0L, (s, m) -> s + m.{what})"

    gone, fails = "m.mask & w.applied <> 0", "m.mask & f.bit <> 0"
    here = f"{fails} AND m.mask & w.applied = 0"
    return _WALK.format(
        step=_STEP, k=len(letters), letters=", ".join(f"struct('{x}' AS letter, {1 << i} AS bit)" for i, x in enumerate(letters)),
        kept=count("n", "m.mask & (w.applied | f.bit) = 0"), removed=count("n", here), redundant=count("n", f"{fails} AND {gone}"),
        unique_fails=count("n", "m.mask = f.bit"), good_lost=count("good", here), toxic_lost=count("toxic", here))


def all_orders(cells: DataFrame, letters: str) -> DataFrame:
    """One row per part, order and step; the query runs here and its rows are written, as it needs more than the session's row limit."""
    conf, limit = cells.sparkSession.conf, "spark.sql.cteRecursionRowLimit"
    before = conf.get(limit)
    conf.set(limit, "-1")  # rows are 326 a part for five filters
    try:
        steps = keep(cells.sparkSession.sql(walk_sql(letters), cells=keep(cells, "mask-cells")), "filter-orders")
    finally:
        conf.set(limit, before)
    return steps.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "letter")))


def audit(docs: DataFrame, labels: DataFrame, conditions: dict = CONDITIONS, copies: str = COPIES, id_col: str = "doc_id",
          text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step, letter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    masks = keep(text_masks(docs, conditions, id_col, text_col, part_col), "text-masks")
    return all_orders(mask_cells(with_copies(masks, 1 << len(conditions)), labels, id_col), "".join(conditions) + copies)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("letter")


QUERIES = {"op13_filter_audit": op13_filter_audit}
ORACLE_SQL = {"op13_filter_audit": """
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
m AS (
  SELECT d.part, CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
      + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
      + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
      + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask,
    coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic
  FROM d LEFT JOIN labels l ON l.doc_id = d.doc_id),
cell AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT substr('ABCDE', i, 1) AS letter, 1 << (i - 1) AS bit FROM (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS i)),
walk AS (
  SELECT '' AS prefix, 0 AS applied, '' AS letter, 0 AS bit, 0 AS before
  UNION ALL
  SELECT prefix || f.letter, applied | f.bit, f.letter, f.bit, applied FROM walk JOIN f ON applied & f.bit = 0),
s AS (
  SELECT part, prefix, letter, CAST(length(prefix) AS INTEGER) AS step,
    sum(CASE WHEN mask & applied = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM walk, cell WHERE prefix <> '' GROUP BY part, prefix, letter),
o AS (SELECT s.*, f.prefix AS filter_order FROM s JOIN walk f ON length(f.prefix) = 5 AND starts_with(f.prefix, s.prefix))
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM o
"""}

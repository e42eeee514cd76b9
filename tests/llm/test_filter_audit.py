import itertools
import re

from pyspark.sql import functions as F

from payscope.llm import filter_audit as A
from tests.llm.frames import documents, empty

LABELS = [(1, 1, 0), (2, 0, 1), (5, 1, 1), (6, 1, 0), (6, None, 1), (7, 0, None), (14, 1, 0), (99, 1, 1), (None, 1, 1)]


def brute(docs, labels):
    """Every order applied document by document."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    fails = []
    for d in docs:
        t = d["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
             "D": bool(re.search(r"[#$%&*|]", t)),
             "E": d["doc_id"] is not None and any(o["doc_id"] is not None and o["doc_id"] < d["doc_id"] and (o["text"] or "") == t for o in docs)}
        fails.append((d["source"] or "", {k for k, v in f.items() if v}, d["doc_id"] in good, d["doc_id"] in toxic))
    rows, shapley = {}, {}
    for part in {f[0] for f in fails}:
        for order in map("".join, itertools.permutations("ABCDE")):
            alive = [f for f in fails if f[0] == part]
            everyone = alive
            for step, x in enumerate(order, 1):
                removed = [f for f in alive if x in f[1]]
                alive = [f for f in alive if x not in f[1]]
                failing = [f for f in everyone if x in f[1]]
                rows[part, order, step] = [len(alive), len(removed), len(failing) - len(removed), sum(f[1] == {x} for f in failing),
                                           sum(f[2] for f in removed), sum(f[3] for f in removed)]
                shapley[part, x] = shapley.get((part, x), 0) + len(removed)
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in rows.items()}


def test_equals_brute_force_on_edges(spark):
    docs = documents(spark).unionByName(spark.createDataFrame(
        [(20 + i, t, s) for i, (t, s) in enumerate([("SHOUT " * 60, "src1"), ("SHOUT " * 60, None), ("", "src0"), (None, ""), ("a # b", "src2"),
                                                    (" ".join(f"Word{i}" for i in range(60)), "src2")])], "doc_id long, text string, source string"), allowMissingColumns=True)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    got = A.audit(docs, labels).collect()
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == limit
    want = brute(docs.collect(), LABELS)
    assert len(got) == len(want)
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
            for r in got} == want
    assert all(r["letter"] == r["filter_order"][r["step"] - 1] for r in got)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(empty(spark), none).count() == 0
    got = A.audit(documents(spark).limit(3), none)
    assert got.agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_more_parts_than_the_session_row_limit(spark):
    n = 40_000
    cells = spark.range(n).select(F.format_string("p%05d", "id").alias("part"), F.array(F.struct(
        F.lit(3).alias("mask"), F.col("id").alias("n"), F.lit(0).cast("long").alias("good"), F.col("id").alias("toxic"))).alias("cells"))
    got = A.all_orders(cells, "XYZ")
    assert got.count() == n * 6 * 3
    r = got.where("part = 'p00007' AND filter_order = 'YXZ'").orderBy("step").collect()
    assert [(x["kept"], x["removed"], x["redundant"], x["toxic_lost"], x["shapley"]) for x in r] == [(0, 7, 0, 7, 21), (0, 0, 7, 0, 21), (0, 0, 0, 0, 0)]


def test_a_group_of_copies_is_spread_over_its_ids(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one text").otherwise(F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    rows = A.with_copies(A.text_masks(docs), 16)
    assert rows.where("mask & 16 <> 0").agg(F.sum("n")).first()[0] == 999

import math

from payscope.llm import mixing as M
from tests.conftest import SF01
from tests.llm.frames import documents, empty


def reshared(sizes):
    """Targets by resharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, held, total = {}, set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in held)
        open_ = [s for s in names if s not in held]
        target = {s: 3 * sizes[s] if s in held else weight[s] * left / sum(weight[x] for x in open_) for s in names}
        over = {s for s in open_ if target[s] > 3 * sizes[s]}
        if not over:
            return target
        held |= over


def check(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    want = reshared({s: sum(r["size"] for r in rs) for s, rs in by.items()})
    for s, rs in by.items():
        assert math.isclose(rs[0]["target"], want[s], rel_tol=1e-9, abs_tol=1e-9)
        assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3 for r in rs)
        largest = max(r["size"] for r in rs)
        assert abs(sum(r["taken"] for r in rs) - want[s]) <= largest
    return want


def test_targets_and_taken_words(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    rows = M.sample_copies(docs).collect()
    want = check(rows)
    for s, target in want.items():
        taken = sum(r["taken"] for r in rows if r["source"] == s)
        assert abs(taken - target) <= 0.05 * target


def test_hot_source_is_cut_into_slices(spark, monkeypatch):
    monkeypatch.setattr(M, "ROWS_PER_SLICE", 7)
    docs = spark.read.parquet(f"{SF01}/documents.parquet").selectExpr("doc_id", "text", "if(doc_id % 3 = 0, 'hot', source) source")
    rows = M.sample_copies(docs).collect()
    check(rows)
    # every integer boundary is crossed once: copies of a source are floor or ceiling of its expected copies
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        assert {r["copies"] for r in own} <= {math.floor(own[0]["expected"]), math.ceil(own[0]["expected"])}
        assert abs(sum(r["copies"] for r in own) - len(own) * own[0]["expected"]) <= 1


def test_excess_is_reshared(spark):
    docs = spark.createDataFrame([(i, "w " * n, s) for i, (n, s) in enumerate([(1, "a"), (2, "b"), (1000, "c"), (4000, "d"), (1, None)])], "doc_id long, text string, source string")
    check(M.sample_copies(docs).collect())


def test_edges(spark):
    docs = documents(spark)
    first, again = (sorted(map(str, M.sample_copies(docs).collect())) for _ in range(2))
    assert first == again and len(first) == docs.count()
    mixed = M.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == M.sample_copies(docs).agg({"copies": "sum"}).first()[0]
    assert M.sample_copies(empty(spark)).count() == 0 and M.mix(empty(spark)).count() == 0
    wordless = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")
    assert [(r["target"], r["taken"]) for r in M.sample_copies(wordless).collect()] == [(0.0, 0), (0.0, 0)]


def test_rows_of_one_id_and_copies_of_one_text_spread(spark, monkeypatch):
    """A third of the rows without id, a third with one id, a third copies of one text: no slice gathers them."""
    monkeypatch.setattr(M, "ROWS_PER_SLICE", 20)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, "same words here" if i % 3 == 2 else f"text no {i}") for i in range(3000)]
    docs = M.keep(spark.createDataFrame([(i, t, "hot") for i, t in rows], "doc_id long, text string, source string"), "t")
    plan = M.plan_mix(M.keep(M._keyed(docs, "doc_id", "source", "text"), "t"))
    placed = M._numbered(M._keyed(docs, "doc_id", "source", "text"), plan.slices, plan.starts)
    held = [r["count"] for r in placed.groupBy("_cell", "_slice").count().collect()]
    assert sum(held) == 3000 and max(held) < 60
    assert sorted(r["_place"] for r in placed.collect()) == list(range(3000))
    check(M.sample_copies(docs).collect())

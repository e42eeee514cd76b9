import numpy as np
import pytest

from payscope.llm import ann_tree as A


def truth(ids, x, query_ids, k=20):
    out = {}
    place = {i: n for n, i in enumerate(ids)}
    for q in query_ids:
        s = (x * x[place[q]]).sum(axis=1)
        out[q] = [(i, v) for v, i in sorted(((-v, i) for v, i in zip(s.tolist(), ids)))if i != q][:k]
    return out


def got_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def recall(got, want):
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got.get(q, [])}) for q in want)
    return hits / sum(map(len, want.values()))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], dtype=np.float64)
    want = truth(ids, x, [i for i in ids if i % 20 == 0])
    got = got_of(A.op2_ann_tree(spark, f"/root/testdata/{sf}"))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.9
    place = {i: n for n, i in enumerate(ids)}
    for q, near in got.items():
        assert q not in {i for i, _ in near}
        assert all(abs(s - float(x[place[q]] @ x[place[i]])) < 1e-12 for i, s in near)
        assert near == sorted(near, key=lambda t: (-t[1], t[0]))


def test_norms_differ_and_leaves_are_cut(spark):
    """Largest inner product, not nearest direction; small blocks cut stretches and queries."""
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(1500, 8)) * rng.uniform(0.1, 5, size=(1500, 1))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    want = truth(list(range(1500)), x.astype(np.float64), range(0, 1500, 20))
    assert recall(got_of(A.nearest(df, lambda i: i % 20 == 0)), want) >= 0.9
    classes = A.keep(A.classes_of(A.usable(df, "vec_id", "embedding"), 20), "t")
    asks = classes.where("cid % 20 = 0").select("cid", "v")
    index = A.build_index(classes, asks)
    whole, cut = (sorted(map(str, A.search(index, asks, 20, *b).collect())) for b in ((8192, 4096), (64, 5)))
    assert whole == cut


def test_small_table_gives_all_candidates_and_ties_by_id(spark):
    same, other = [1.0, 0.0], [0.5, 0.5]
    rows = [(20, same), (3, same), (1, same), (7, other), (40, other), (60, None), (80, [0.0, 0.0]), (100, [float("nan"), 1.0]),
            (120, [None, 1.0]), (140, [float("inf"), 1.0]), (160, [1.0, 2.0, 3.0]), (None, same), (3, same)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, cid string, v int")
    got = got_of(A.nearest(df, lambda i: i % 20 == 0))
    assert got == {20: [(1, 1.0), (3, 1.0), (7, 0.5), (40, 0.5)], 40: [(1, 0.5), (3, 0.5), (7, 0.5), (20, 0.5)]}


def test_vector_shared_by_a_third_of_the_rows(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 6)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)  # so that the equal vectors are the nearest
    x[::3] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got, want = got_of(A.nearest(df, lambda i: i % 20 == 0)), truth(list(range(900)), x.astype(np.float64), range(0, 900, 20))
    assert recall(got, want) >= 0.9
    assert [i for i, _ in got[60]] == [i for i in range(0, 66, 3) if i != 60][:20]


def test_no_rows_and_no_queries(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert A.nearest(none, lambda i: i % 20 == 0).count() == 0
    odd = spark.createDataFrame([(1, [1.0]), (3, [2.0])], "vec_id long, embedding array<float>")
    assert A.nearest(odd, lambda i: i % 20 == 0).count() == 0


def test_queue_visits_every_leaf_once_at_full_reach():
    x = np.random.default_rng(2).normal(size=(600, 5))
    tree = A.Tree.fit(x, float(np.sqrt((x * x).sum(axis=1)).max()))
    sizes = np.bincount(tree.assign(x), minlength=tree.n_leaves)
    seen = next(tree.products(x[:1]))
    assert np.allclose(seen, tree.sample @ x[0])
    assert sorted(tree.visits(seen, 1e6, 1, sizes, 1)) == list(range(tree.n_leaves))
    few = tree.visits(seen, 0.0, 5, sizes, 1)
    assert 0 < len(few) < tree.n_leaves and sum(sizes) == 600
    assert len(tree.visits(seen, 0.0, 1, sizes, 500)) > len(few)
    for node, kids in enumerate(tree.children):  # a node's sample is its children's
        if len(kids):
            assert tree.end[node] - tree.start[node] == sum(tree.end[kids] - tree.start[kids])


def test_every_length_is_searched(spark):
    """Two lengths with a tree each, one compared whole, one row alone in its length."""
    rng = np.random.default_rng(11)
    x = {i: rng.normal(size=(3, 5, 5, 8)[i % 4] if i < 2400 else 2).astype(np.float32) for i in range(2500)}
    x[2500] = np.ones(9, dtype=np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "vec_id long, embedding array<float>")
    got, want = got_of(A.nearest(df, lambda i: i % 20 == 0, one_leaf=200)), {}
    for n in (2, 3, 5, 8):
        ids = [i for i, v in x.items() if len(v) == n]
        want |= truth(ids, np.array([x[i] for i in ids], dtype=np.float64), [i for i in ids if i % 20 == 0])
    assert set(got) == set(want) and 2500 not in got
    assert recall(got, want) >= 0.9
    whole = [q for q in want if len(x[q]) == 2]
    assert len(whole) == 5 and all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in whole)


def test_few_vectors_are_compared_and_fewer_in_a_larger_table(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(400, 32))
    shares = []
    for n in (10_000, 50_000):
        x = (centres[rng.integers(0, 400, n)] + 0.35 * rng.normal(size=(n, 32))).astype(np.float32)
        df = A.keep(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), "t")
        classes = A.keep(A.classes_of(A.usable(df, "vec_id", "embedding"), 20), "t")
        index = A.build_index(classes, classes.where("cid % 500 = 0").select("cid", "v"))
        shares.append(index.compared)
        want = truth(list(range(n)), x.astype(np.float64), range(0, n, 500))
        assert recall(got_of(A.nearest(df, lambda i: i % 500 == 0)), want) >= 0.9
    assert shares[1] < 0.15 and shares[1] < shares[0]


def test_stretches():
    assert A.stretches(np.array([3, 3, 3, 9, 1, 0]), 6).tolist() == [0, 0, 1, 2, 3, 3]

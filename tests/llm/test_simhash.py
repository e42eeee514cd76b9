import random

import numpy as np
import pytest
import xxhash

from payscope.llm import simhash as S
from payscope.llm.components import connected_components
from tests.conftest import SF001
from tests.llm.frames import documents, empty


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    runs = [words[i: i + 3] for i in range(len(words) - 2)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, bits=3):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in zip(ids, fps):
        for j, b in zip(ids, fps):
            if i < j and bin(a ^ b).count("1") <= bits:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    fps = [brute_fingerprint(r["text"]) for r in rows]
    want = brute_components([r["doc_id"] for r in rows], fps)
    got = {r["doc_id"]: r for r in S.op6_simhash_groups(spark, SF001).collect()}
    for r, f in zip(rows, fps):
        assert got[r["doc_id"]]["fingerprint"] == f"{f:016x}" and got[r["doc_id"]]["component_id"] == want[r["doc_id"]]


def test_long_text_in_parts(monkeypatch):
    text = " ".join(f"w{i}" for i in range(2000))
    whole = S.fingerprint_batch([text, "a b c d"])
    monkeypatch.setattr(S, "HASHES_AT_ONCE", 97)
    assert (S.fingerprint_batch([text, "a b c d"]) == whole).all() and int(whole[0]) == brute_fingerprint(text)


def groups_of(links, fps):
    return brute_components(list(range(len(fps))), fps), links


@pytest.mark.parametrize("small,split", [(64, 20_000), (2, 20_000), (2, 10)])
def test_links_connect_what_lies_within_three_bits(spark, monkeypatch, small, split):
    """Near groups of one centre, chains, and pairs that differ by exactly 3 or 4 bits in all places."""
    monkeypatch.setattr(S, "SMALL_ROWS", small)
    monkeypatch.setattr(S, "SPLIT_ROWS", split)
    rnd = random.Random(5)
    fps = {0}
    for centre in (rnd.getrandbits(64), 0):
        for _ in range(120):
            x = centre
            for b in rnd.sample(range(64), rnd.randint(0, 4)):
                x ^= 1 << b
            fps.add(x)
    for k in (3, 4):
        for _ in range(60):
            a = rnd.getrandbits(64)
            b = a
            for p in rnd.sample(range(64), k):
                b ^= 1 << p
            fps |= {a, b}
    x = rnd.getrandbits(64)
    for i in range(0, 60, 3):
        fps.add(x)
        x ^= 7 << i
    fps = sorted(fps)
    signed = np.array(fps, dtype=np.uint64).view(np.int64)
    classes = spark.createDataFrame([(int(v),) for v in signed], "fp long")
    # the functions run in the workers with the module's own constants: compare the bucket code here
    rows = S.anchored(classes, 3).orderBy("anchor").toArrow()
    anchor, home, fp = (rows.column(k).to_numpy() for k in range(3))
    found = S._links_of_buckets(anchor, home.astype(np.int64), fp.view(np.uint64), 3)
    index = {v: i for i, v in enumerate(fps)}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in found.tolist():
        assert bin(a ^ b).count("1") <= 3
        i, j = sorted((find(index[a]), find(index[b])))
        root[j] = i
    assert {i: find(i) for i in range(len(fps))} == brute_components(list(range(len(fps))), fps)
    if (small, split) != (2, 20_000):
        linked = connected_components(S.links(classes, split_rows=split)).collect()
        got = {}
        for r in linked:
            got.setdefault(r["component"], set()).add(r["node"])
        want = {}
        for i, c in brute_components(list(range(len(fps))), fps).items():
            want.setdefault(c, set()).add(int(signed[i]))
        assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_components_of_a_chain_a_star_and_nothing(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(1000, i) for i in range(1001, 1100)]
    out = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain + star + chain + [(5, 5)], "u long, v long")).collect()}
    assert out == {i: 0 for i in range(41)} | {i: 1000 for i in range(1000, 1100)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_edges(spark):
    docs = documents(spark)
    out = S.near_duplicates(docs)
    assert out.count() == docs.count()
    rows = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in out.collect()}
    zero = [k for k in rows if k[1] == "0" * 16]
    assert {rows[k] for k in zero} == {0} and len(zero) >= 3
    kept = S.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in kept.collect()) == sorted({-1 if c is None else c for c in rows.values()})
    assert S.near_duplicates(empty(spark)).count() == 0 and S.keep_one_of_each(empty(spark)).count() == 0


def test_rows_of_a_large_anchor_are_dealt_to_many_keys(spark):
    """A third of all fingerprints at one anchor: no group over the bound is gathered, however the batches fall."""
    rnd = np.random.default_rng(3)
    fps = np.unique(rnd.integers(0, 1 << 32, 600, dtype=np.uint64) << np.uint64(32))  # equal low halves
    near = np.unique(np.r_[fps, fps[:100] ^ np.uint64(1 << 40), fps[100:200] ^ np.uint64(7 << 50)])
    signed = near.view(np.int64)
    classes = spark.createDataFrame([(int(v),) for v in signed], "fp long")
    got = {r["node"]: r["component"] for r in connected_components(S.links(classes, split_rows=50)).collect()}
    fps = near.tolist()
    want = brute_components(list(range(len(fps))), fps)
    groups, found = {}, {}
    for i, c in want.items():
        groups.setdefault(c, []).append(int(signed[i]))
    for node, c in got.items():
        found.setdefault(c, []).append(node)
    assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


@pytest.mark.parametrize("most,rows_a_batch", [(3, 1), (3, 4), (3, 50), (None, 4)])
def test_groups_come_whole_or_marked_large(most, rows_a_batch):
    keys = np.repeat(np.arange(9), [1, 3, 4, 2, 10, 1, 1, 7, 3])
    rows = [S.pa.RecordBatch.from_arrays([S.pa.array(keys[i: i + rows_a_batch]), S.pa.array(np.arange(len(keys))[i: i + rows_a_batch])], ["k", "v"])
            for i in range(0, len(keys), rows_a_batch)]
    whole, large = [], []
    for is_large, (k, v) in S._whole_groups(iter(rows), most):
        (large if is_large else whole).append((k, v))
        if not is_large:
            assert all((keys == x).sum() == (k == x).sum() for x in np.unique(k))
    assert sorted(x for _, v in whole + large for x in v.tolist()) == list(range(len(keys)))
    assert {x for k, _ in large for x in k.tolist()} == (set() if most is None else {2, 4, 7})

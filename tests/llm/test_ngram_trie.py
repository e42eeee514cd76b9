import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from payscope.llm import ngram_trie as G
from payscope.llm.common import keep
from payscope.llm.elias_fano import EliasFano, pack_arrays, unpack_arrays
from tests.conftest import SF001
from tests.llm.frames import documents, empty


def words(text):
    return (text or "").encode().lower().split() + [b"\n"]


def brute(rows):
    """{id: (n_tokens, n_known, N, base, score)} of (id, text, held_out) rows, with the model in dictionaries."""
    count, after = Counter(), defaultdict(Counter)
    for _, text, held in rows:
        if not held:
            seen, before = words(text), b"<s>"
            count.update(seen)
            for w in seen:
                after[before][w] += 1
                before = w
    n, v = sum(count.values()), len(count)
    d = G.discounts(np.array([c for a in after.values() for c in a.values()]))
    freed = {b: sum(d[min(c, 3)] for c in a.values()) / sum(a.values()) for b, a in after.items()}
    out = []
    for i, text, _ in rows:
        base = score = 0.0
        before = b"<s>"
        for w in words(text):
            p = (count[w] + 1) / (n + v + 1)
            base += math.log10(p)
            if before in after:
                c, total = after[before][w], sum(after[before].values())
                p = max(c - d[min(c, 3)], 0) / total + freed[before] * p
            score += math.log10(p)
            before = w
        out.append((i, len(words(text)), sum(count[w] > 0 for w in words(text)), n, base, score))
    return out


def compare(got, rows):
    want = brute(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[4], 6))
    got = sorted(((r[0], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want, key=key)):
        assert a[:4] == b[:4] and math.isclose(a[4], b[4], rel_tol=1e-9, abs_tol=1e-9)
        assert abs(a[5] - b[5]) <= 3e-4 * b[1] + 1e-9


def test_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"], zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    compare(G.op4_ngram_scores(spark, SF001).collect(), rows)


def test_held_out_texts_score_over_the_base(spark):
    out = G.op4_ngram_scores(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


def test_edges(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"], r["doc_id"] == 8) for r in docs.collect()]
    compare(G.score(docs, F.coalesce(F.col("doc_id") == 8, F.lit(False))).collect(), rows)
    assert G.score(empty(spark), F.lit(False)).count() == 0
    untrained = G.score(docs.where("doc_id = 8"), F.lit(True)).first()
    assert untrained["train_tokens"] == 0 and untrained["n_known"] == 0 and untrained["base_score"] == 0.0 and untrained["score"] == 0.0


def test_vocabulary_in_several_files(spark, monkeypatch):
    monkeypatch.setattr(G, "WORDS_A_FILE", 100)
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("text", F.lit(False).alias("held_out"))
    v = G.build_vocabulary(docs)
    want = Counter(w for r in docs.collect() for w in words(r["text"]))
    assert len(v.files) > 4 and v.n_words == len(want) and v.n_tokens == sum(want.values())
    own = v.open()
    ids, counts = own.find(np.array([G.word_hash(w) for w in want] + [12345], dtype="<u8"))
    assert ids[-1] == -1 and counts[:-1].tolist() == list(want.values()) and sorted(ids[:-1]) == list(range(len(want)))
    assert own.count_of(ids).tolist() == [*want.values(), 0]


def test_probabilities_of_a_context_sum_to_one():
    class Flat:
        class v:
            n_words, n_tokens, n_docs = 6, 21, 4

        @staticmethod
        def count_of(ids):
            return np.where(np.asarray(ids) >= 0, np.asarray(ids) + 1, 0)

    c, w, n = (np.array(x, dtype=np.int64) for x in ([1, 1, 1, 4, 7], [0, 2, 5, 3, 1], [1, 2, 5, 1, 4]))
    part = G.TriePart(unpack_arrays(G.TriePart.build(c, w, n, Flat)))
    every = np.arange(7)  # the words and the unknown one
    below = (np.append(np.arange(6) + 1, 0) + 1) / 28
    assert math.isclose(below.sum(), 1.0)
    for context in (1, 4, 7):
        p = 10 ** part.log10(np.full(7, context), every, np.log10(below))
        assert math.isclose(p.sum(), 1.0, rel_tol=2e-3)
    assert np.allclose(part.log10(np.full(7, 2), every, np.log10(below)), np.log10(below))


def test_pairs_survive_the_blob():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 2**32, 50, dtype=np.uint32).astype(np.int64) for _ in range(4)]
    docs = [rng.integers(0, 70_000, 90) for _ in range(2)]
    a, b = G.unpack_pairs(G.pack_pairs(columns, docs))
    assert all((x == y).all() for x, y in zip([*columns, *docs], [*a, *b]))


@pytest.mark.parametrize("n,universe", [(0, 10), (1, 1), (5, 1 << 64), (1000, 1500), (20_000, 1 << 64), (50_000, 1 << 40)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    v = np.unique(rng.integers(0, universe, n, dtype=np.uint64, endpoint=False)) if universe > 1 else np.zeros(n, np.uint64)
    e = EliasFano.from_parts(unpack_arrays(pack_arrays(EliasFano.build(v, universe).parts())))
    assert (e.access(np.arange(len(v))) == v).all()
    asked = np.concatenate([v, rng.integers(0, universe, 500, dtype=np.uint64)])
    place = {x: i for i, x in enumerate(v.tolist())}
    assert e.find(asked).tolist() == [place.get(x, -1) for x in asked.tolist()]
    if n > 1000:
        assert e.find(v[:50], 10, 20).tolist() == [i if 10 <= i < 20 else -1 for i in range(50)]
        assert sum(a.nbytes for a in e.parts()) * 8 / len(v) < 4 + math.log2(universe / len(v))


@pytest.mark.parametrize("shard_tokens", [1_000_000, 3_000])
def test_split_contexts_and_many_shards_equal_brute_force(spark, monkeypatch, shard_tokens):
    monkeypatch.setattr(G, "CONTEXT_TOKENS", 50)
    monkeypatch.setattr(G, "SHARD_TOKENS", shard_tokens)
    docs = keep(spark.read.parquet(f"{SF001}/documents.parquet").limit(60).select("doc_id", "text"), "documents")
    rows = [(r["doc_id"], r["text"], r["doc_id"] % 5 == 0) for r in docs.collect()]
    compare(G.score(docs, F.col("doc_id") % 5 == 0).collect(), rows)

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from payscope.llm import fill_middle as M
from tests.llm.frames import documents, empty


def plain(text, key, fim=90, spm=20):
    """The contract's rewriting, on code points."""
    text, n = text or "", len(text or "")
    h = [int(hashlib.sha256(f"1:{'null' if key is None else key}".encode()).hexdigest()[i: i + 8], 16) for i in (0, 8, 16, 24)]
    if not n or any(m in text for m in M.SENTINELS) or h[2] % 100 >= fim:
        return n, "plain", None, None, text
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = text[:lo], text[lo:hi], text[hi:]
    return (n, "spm", lo, hi - lo, f"<S>{c}<P>{a}<M>{b}") if h[3] % 100 < spm else (n, "psm", lo, hi - lo, f"<P>{a}<S>{c}<M>{b}")


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200_000), st.floats(0, 1), st.integers(0, 99), st.integers(0, 2 ** 32 - 1))
def test_every_container_selects_like_the_sorted_list(n, share, runs, seed):
    r = np.random.default_rng(seed)
    mask = r.random(n) < share
    for at in r.integers(0, n, runs):
        mask[at: at + int(r.integers(1, 3000))] = True
    offsets, places = np.flatnonzero(mask), M.BoundarySet(mask)
    assert len(places) == len(offsets)
    for k in r.integers(0, max(len(offsets), 1), 30) if len(offsets) else []:
        assert places.select(int(k)) == offsets[k]
    with pytest.raises(IndexError):
        places.select(len(offsets))


def test_containers_are_of_all_kinds():
    full = np.ones(M.SPAN, bool)
    assert isinstance(M.container(full), M.RunContainer)
    assert isinstance(M.container(np.arange(M.SPAN) % 2 == 0), M.BitmapContainer)
    assert isinstance(M.container(np.arange(M.SPAN) % 40 == 0), M.ArrayContainer)
    assert [type(c) for c in M.boundaries(("я" * 40_000 + "a" * 70_000).encode()).containers] == [M.BitmapContainer, M.BitmapContainer, M.RunContainer]


@settings(max_examples=100, deadline=None)
@given(st.text(), st.integers(0, 10 ** 12))
def test_rewriting_equals_the_plain_form(text, key):
    n, form, lo, mid, _, _, output = M.rewrite(text.encode(), M.draws("1", key), "character", 90, 20, [m.encode() for m in M.SENTINELS])
    assert (n, form, lo, mid, output.decode()) == plain(text, key)


def test_word_units():
    text = "  one two  three\n"
    places = M.boundaries(text.encode(), "word")
    assert [places.select(k) for k in range(len(places))] == [0, 2, 6, 11, len(text)]
    assert len(M.boundaries(b"", "word")) == 1
    with pytest.raises(ValueError):
        M.boundaries(b"", "line")


def test_edges_round_trip(spark):
    docs = documents(spark).unionByName(spark.createDataFrame(
        [(100 + i, t) for i, t in enumerate(["a<P>b", "<M>", "<P", "S>" * 9, "\\Q<S\\E", "<<S<P<M" * 5, "日本" * 70_000])], "doc_id long, text string"), allowMissingColumns=True)
    done = M.fill_middle(docs)
    got = done.withColumn("back", M.restore(F.col("output"), F.col("form"))).collect()
    want = sorted((str((r["doc_id"], *plain(r["text"], r["doc_id"]))) for r in docs.collect()))
    assert sorted(str((r["doc_id"], r["n"], r["form"], r["prefix_units"], r["middle_units"], r["output"])) for r in got) == want
    assert sorted(r["back"] for r in got) == sorted(r["text"] or "" for r in docs.collect())
    for r in got:
        if r["form"] != "plain":
            text = r["back"].encode()
            assert text[: r["middle_at"]].decode() + text[r["middle_at"]: r["suffix_at"]].decode() + text[r["suffix_at"]:].decode() == r["back"]
    assert M.fill_middle(empty(spark)).count() == 0


def test_other_units_and_sentinels_round_trip(spark):
    marks = ("[pre]", "[suf]", "[mid]")
    done = M.fill_middle(documents(spark), unit="word", seed="x", fim_percent=100, spm_percent=50, sentinels=marks)
    got = done.select(M.restore(F.col("output"), F.col("form"), marks).alias("t"), "form").collect()
    assert sorted(r["t"] for r in got) == sorted(r["text"] or "" for r in documents(spark).collect())
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from payscope.llm import packing as P
from tests.conftest import SF001
from tests.llm.frames import TEXTS, documents, empty


@pytest.fixture(scope="module")
def encoder():
    return P.WordEncoder(P.tokenizer_path())


def plain_ids(encoder, text):
    return np.array(encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, dtype="<u4").tobytes()


def check(encoder, rows, texts):
    """Exact round trip: each document's ids lie in one piece each, sequences have no gap and no padding over a power of two."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_row"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert len(by_doc) == len(texts)
    for pieces in by_doc.values():
        ids = plain_ids(encoder, texts[pieces[0]["doc_id"]]) + (1).to_bytes(4, "little")
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids) // 4
            assert r["ids_crc32"] == zlib.crc32(ids[4 * at: 4 * (at + r["length"])])
            at += r["length"]
        assert at == len(ids) // 4
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and at & (at - 1) == 0


def test_query_round_trip(spark, encoder):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    check(encoder, P.op5_pack_sequences(spark, SF001).collect(), texts)


def test_small_blocks_and_edges(spark, encoder):
    docs = documents(spark)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = P.pack(docs, P.tokenizer_path(), block_tokens=500).collect()
    assert len({r["doc_row"] for r in rows}) == docs.count()
    by_id = {}
    for r in rows:
        by_id[r["doc_id"]] = by_id.get(r["doc_id"], 0) + r["length"]
    for i, t in texts.items():
        assert by_id[i] == (len(plain_ids(encoder, t)) // 4 + 1) * sum(d["doc_id"] == i for d in docs.collect())
    assert P.pack(empty(spark), P.tokenizer_path()).count() == 0


def test_ids_are_the_tokenizers(encoder):
    odd = TEXTS + ["a\x1cb c\x85d e\xa0f g h", "don't I'VE we'll 's", "été ÉTÉ Straße ﬁ", "x1y22 3.14 !!?? ...", "<|startoftext|>word<|endoftext|>",
                   "été Å ẛ̣", "word." * 30, "W" * 200, "日本語テキスト", "a​b ﻿c", "İstanbul ǅ ß", "\r\n\v\f x"]
    got = encoder.ids(odd)
    again = encoder.ids(odd)
    for text, a, b in zip(odd, got, again):
        assert a == b == plain_ids(encoder, text), text


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(text):
    own = P.encoder(P.tokenizer_path())
    assert own.ids([text])[0] == plain_ids(own, text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=60))
def test_every_token_lies_in_one_piece(lengths):
    sequences = P.pack_lengths(lengths)
    seen = {}
    for tier, pieces in sequences:
        assert sum(n for _, _, n in pieces) == tier and tier <= 2048 and tier & (tier - 1) == 0
        for d, s, n in pieces:
            seen.setdefault(d, []).append((s, n))
    assert set(seen) == set(range(len(lengths)))
    for d, parts in seen.items():
        at = 0
        for s, n in sorted(parts):
            assert s == at
            at += n
        assert at == lengths[d]


def test_step_groups_hold_one_tier_and_balanced_cost():
    rng = np.random.default_rng(3)
    sequences = P.pack_lengths(rng.integers(1, 3000, 2000).tolist())
    groups = P.step_groups(sequences)
    tokens, tiers, cost = {}, {}, {}
    for (tier, pieces), g in zip(sequences, groups):
        tokens[g] = tokens.get(g, 0) + tier
        tiers.setdefault(g, set()).add(tier)
        cost.setdefault(tier, {}).setdefault(g, 0)
        cost[tier][g] += sum(n * n for _, _, n in pieces)
    assert max(tokens.values()) <= P.STEP_TOKENS and all(len(t) == 1 for t in tiers.values())
    top = list(cost[2048].values())
    assert max(top) <= 1.2 * min(top)

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from payscope.llm import token_counts as T
from tests.conftest import SF001
from tests.llm.frames import documents, empty

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=T.model_path())
MODEL = T.load(T.model_path())
ODD = ["<s>", "</s>", "<unk>", "<0x0A>", "▁", " ", "  ", "\n", "\t", "\r\n", "\x00", "　", "​", "é", "é", "日本", "😀", "ﬀ", "a", "The", "ing", "{\r", ");\r\n"]


def test_cut_counts_add_up_for_odd_texts():
    for a in ODD:
        for b in ODD:
            for t in (a + b, f"{a} {b}", f" {a}{b} ", f"x{a}{b}{a}x"):
                assert sum(MODEL.counts(MODEL.pretokens(t))) == len(LIBRARY.encode(t)), repr(t)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=8), st.sampled_from(ODD)), max_size=12))
def test_cut_counts_add_up(parts):
    text = "".join(parts)
    assert "".join(MODEL.pretokens(text)) == ("▁" + text.replace(" ", "▁") if text else "")
    assert sum(MODEL.counts(MODEL.pretokens(text))) == len(LIBRARY.encode(text))


@pytest.mark.parametrize("block_chars", [50, T.BLOCK_CHARS])
def test_edges_equal_the_library(spark, block_chars):
    docs = documents(spark)
    got = T.count_tokens(docs, T.model_path(), block_chars=block_chars)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens"]
    want = sorted(str((r["doc_id"], len((r["text"] or "").encode()), len(LIBRARY.encode(r["text"] or "")))) for r in docs.collect())
    assert sorted(str((r["doc_id"], r["n_bytes"], r["n_tokens"])) for r in got.collect()) == want
    assert T.count_tokens(empty(spark), T.model_path()).count() == 0


def test_own_names_do_not_clash(spark):
    docs = spark.createDataFrame([("a b", "b a b"), ("c", None)], "bucket string, block string")
    got = T.count_tokens(docs, T.model_path(), "bucket", "block")
    assert sorted((r[0], r["n_tokens"]) for r in got.collect()) == [("a b", 3), ("c", 0)]


def test_query_equals_the_library(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    got = T.op12_token_counts(spark, SF001).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(LIBRARY.encode(texts[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 4096)


def test_a_frequent_pretoken_has_one_row_a_block(spark):
    docs = spark.createDataFrame([(i, "the " * 200) for i in range(300)], "doc_id long, text string").repartition(4)
    rows = T.frequencies(docs, T.model_path(), block_chars=5000)
    blocks = rows.where("bucket IS NULL").count()
    listed = [w for r in rows.where("bucket IS NOT NULL").collect() for w in T._unpack_words(r["words"])]
    assert 0 < listed.count("▁the") == blocks <= 4 + 300 * 800 // 5000


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.text(max_size=3), max_size=30), min_size=1, max_size=8), st.integers(1, 9))
def test_block_sums_equal_plain_sums(docs, buckets):
    block, size = T.Block(), lambda w: 1 + len(w) * 1000
    for i, words in enumerate(docs):
        block.add(i, "", T.Counter(words))
    place, lists = block.lists(buckets)
    lengths, steps, times = block.frequencies(place)
    n = np.array([size(w) for _, words in lists for w in T._unpack_words(T._pack_words(words))], dtype=np.int64)
    got = T.sums(np.array(lengths, dtype=np.int64), T._unpack(steps), T._unpack(times), n)
    assert got.tolist() == [sum(map(size, words)) for words in docs]


def test_one_bucket_and_tiny_blocks(spark):
    docs = documents(spark)
    want = sorted(map(str, T.count_tokens(docs, T.model_path()).collect()))
    few = T.count_tokens(docs, T.model_path(), block_chars=10, buckets=1)
    assert sorted(map(str, few.collect())) == want


def test_models_whose_counts_do_not_add_up_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb
    m = pb.ModelProto()
    m.ParseFromString(open(T.model_path(), "rb").read())
    m.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m.model").write_bytes(m.SerializeToString())
    with pytest.raises(ValueError):
        T.PieceModel(str(tmp_path / "m.model"))

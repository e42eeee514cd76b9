"""The registered queries: contract columns, whole tables, and oracle SQL where there is some."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF001
from tests.oracle_harness import compare, duck

COLUMNS = {
    "op1": ["doc_id", "slot", "shard"],
    "op2": ["query_id", "rank", "vec_id", "score"],
    "op3": ["doc_id", "size", "source_size", "target", "taken"],
    "op4": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op5": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op6": ["doc_id", "fingerprint", "component_id"],
    "op7": ["doc_id", "held_out", "score", "predicted"],
    "op8": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op9": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op10": ["doc_id", "families", "unconfirmed", "n_unknown"],
    "op11": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
    "op12": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op13": ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"],
}
QUERIES, ORACLE = E.queries(), E.oracle_sql()
OWN = {n.split("_")[0]: n for n in QUERIES if n.startswith("op") and n[2].isdigit()}


def test_one_query_an_operator_and_the_pipeline():
    assert set(OWN) == set(COLUMNS) and "pipeline" in QUERIES


@pytest.mark.parametrize("op", sorted(set(COLUMNS) - {"op2", "op5", "op13"}))
def test_query_gives_its_columns_for_every_row(spark, op):
    df = QUERIES[OWN[op]](spark, SF001)
    assert df.columns[: len(COLUMNS[op])] == COLUMNS[op]
    source = "pages" if op == "op8" else "documents"
    assert df.count() == spark.read.parquet(f"{SF001}/{source}.parquet").count()


@pytest.mark.parametrize("name", sorted(set(OWN.values()) & set(ORACLE)))
def test_query_matches_sql(spark, name):
    r = compare(spark, duck(SF001), name, QUERIES[name], ORACLE[name], SF001)
    assert r["status"] == "ok", r

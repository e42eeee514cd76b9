import os
import subprocess
import sys

import corpus_pipeline as C
from payscope.llm import mixing, packing, quality, simhash, toxicity
from payscope.llm.common import keep
from tests.conftest import SF01, SF001
from tests.llm.frames import documents, empty


def test_stages_are_in_order():
    assert [f for _, f in C.STAGES] == [C.drop_toxic, C.drop_bad_quality, C.drop_near_duplicates, C.mix_sources, C.pack_sequences]


def test_each_stage_does_its_operators_work(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    rows = lambda df: sorted(map(str, df.collect()))
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    harmless = keep(C.drop_toxic(spark, docs, SF01), "t")
    scores = toxicity.score(docs, toxicity.fit(docs, labels))
    assert rows(harmless) == rows(docs.join(scores.where("score < 0.5"), "doc_id").select(docs.columns))
    good = keep(C.drop_bad_quality(spark, harmless, SF01), "t")
    assert rows(good) == rows(harmless.join(quality.judge(harmless).where("kept").select("doc_id"), "doc_id").select(docs.columns))
    single = keep(C.drop_near_duplicates(spark, good, SF01), "t")
    assert rows(single) == rows(good.join(simhash.near_duplicates(good).where("doc_id = component_id").select("doc_id"), "doc_id").select(docs.columns))
    mixed = keep(C.mix_sources(spark, single, SF01), "t")
    copies = {r["doc_id"]: r["copies"] for r in mixing.sample_copies(single).collect()}
    assert {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").count().withColumnRenamed("count", "n").collect()} == {k: v for k, v in copies.items() if v}
    assert all(df.columns == docs.columns for df in (harmless, good, single, mixed))
    packed = C.pack_sequences(spark, mixed, SF01)
    assert packed.select("doc_row").distinct().count() == mixed.count()
    plain = packing.pack(single, packing.tokenizer_path()).selectExpr("doc_id", "doc_tokens").distinct()
    tokens = {r["doc_id"]: r["doc_tokens"] for r in plain.collect()}
    assert packed.agg({"length": "sum"}).first()[0] == sum(tokens[i] * n for i, n in copies.items())


def test_run_gives_the_last_stages_rows(spark):
    out = C.run(spark, SF001)
    assert out.count() > 0 and "sequence_id" in out.columns


def test_stages_take_odd_rows(spark):
    for frame in (documents(spark), empty(spark)):
        docs = frame
        for name, stage in C.STAGES:
            docs = keep(stage(spark, docs, SF001), f"t-{name}")
            assert docs.columns == frame.columns or name == "pack_sequences"


def test_entry_without_the_subpackage(tmp_path):
    """A copy of the repository without the folders of this subpackage still imports and lists its other queries."""
    import shutil
    root = os.path.dirname(os.path.abspath(C.__file__))
    shutil.copytree(f"{root}/payscope", tmp_path / "payscope", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') and n[2].isdigit() for n in e.queries()), 'pipeline' in e.oracle_sql())"],
                          cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert said.returncode == 0 and said.stdout.split()[1:] == ["False", "False"], said.stderr

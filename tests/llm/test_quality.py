import re

from pyspark.sql import functions as F

from payscope.llm import quality as Q
from tests.conftest import SF001
from tests.llm.frames import documents, empty

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = [w for w in SPACE.split(text) if w]
    lines = [x for x in text.split("\n") if SPACE.sub("", x)]
    spots = {}
    for i in range(len(words) - 2):
        spots.setdefault(tuple(words[i: i + 3]), []).append(i)
    covered = {i + k for at in spots.values() if len(at) > 1 for i in at for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def stats(df):
    return {r["k"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in df.collect()}


def test_statistics_equal_brute_force(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()] + [r["text"] for r in documents(spark).collect()]
    texts += ["a b c a b c", "a a a a", "a b c x a b c y a b c", "\n\n x \n x", "😀 # 😀 |"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    assert stats(Q.with_statistics(df)) == {i: brute(t) for i, t in enumerate(texts)}


def test_base_and_verdict(spark):
    out = {r["n_words"]: r for r in Q.judge(spark.createDataFrame(
        [("clean " + " ".join(f"{chr(97 + i % 26)}word{chr(97 + i // 26)}" for i in range(60)),), ("x",), ("same words here " * 40,)], "text string")).collect()}
    assert out[61]["kept"] and not out[61]["base_failed"]
    assert out[1]["base_failed"] and out[120]["base_failed"] and not out[1]["kept"]


def test_clean_documents_are_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    seen = Q.judge(docs.select("doc_id", "text", "quality")).where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    share = {r["quality"]: r["kept"] for r in seen.collect()}
    assert share[1] > 0.999 and share[0] < 0.5


def test_order_is_rejection_per_cost(spark):
    df = spark.range(1000).withColumn("v", F.col("id"))
    slow = F.length(F.regexp_replace(F.repeat(F.col("v").cast("string"), 3000), "[0-8]", "")) < 0
    rules = [Q.Rule("slow", slow), Q.Rule("never", F.col("v") < 0), Q.Rule("often", F.col("v") < 900)]
    order = [f["name"] for f in Q.cascade_order(Q.sample_of(df), rules)]
    assert order[0] == "often"
    kept = df.where(Q.rejected_by(rules).isNull()).count()
    assert kept == df.where(Q.rejected_by(rules[::-1]).isNull()).count() == 100


def test_sample_is_bounded(spark):
    same = spark.range(20_000).select(F.lit("same").alias("text"))
    assert Q.sample_of(same, 100).count() <= 200


def test_edges(spark):
    docs = documents(spark)
    out = Q.judge(docs)
    assert out.count() == docs.count() and out.where("kept is null or base_failed is null").count() == 0
    good = Q.keep_good(docs)
    assert good.columns == docs.columns
    assert sorted(map(str, good.collect())) == sorted(map(str, docs.join(out.where("kept").select("doc_id", "text").distinct(), ["doc_id", "text"]).select(docs.columns).collect()))
    assert Q.judge(empty(spark)).count() == 0 and Q.keep_good(empty(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = Q.judge(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

import math

from pyspark.sql import functions as F

from payscope.llm import toxicity as T
from tests.llm.frames import documents, empty

SF1 = "/root/testdata/sf0.1"


def test_fold():
    assert T.fold("MОRОN  id10t​ p4thet1c 15 (2) a$$$ was!!") == "moron idiot pathetic 15 (2) a$$$ was!!"
    assert T.fold(None) == "" and T.fold(" \n ") == ""


def test_every_letter_stays_a_letter():
    assert T.fold("собака") == "cobaka" and T.fold("бык").isalpha()
    assert all(v.isalpha() for v in (T.LOOK_ALIKES | T.CAPITALS | T.SMALL_CAPITALS).values())


def plain_score(model, text):
    """The score by looking for every term at every place, without an automaton."""
    folded, kept = T.readings(text)
    starts = [i for i in range(len(folded)) if not (i and kept[i - 1].isalpha())]
    ends = lambda at, term: at + len(term) == len(folded) or not folded[at + len(term)].isalpha()
    void = [(i, i + len(p) - 1) for i in starts for p in model.exceptions if folded.startswith(p, i) and ends(i, p)]
    weights = {}
    for i in starts:
        own = [v for t, v in model.words.items() if folded.startswith(t, i) and ends(i, t)] + [v for t, v in model.stems.items() if folded.startswith(t, i)]
        if own and max(own) > 0 and not any(a <= i <= b for a, b in void):
            while i and kept[i - 1] != folded[i - 1]:
                i -= 1
            weights[i] = max([*own, weights.get(i, 0.0)])
    total, n = sum(weights.values()), len(folded.split())
    a, b, c, d = model.coefficients
    z = a * math.log1p(total) + b * math.log1p(100 * total / max(n, 20)) + c * min(len(weights), 3) + d
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_scores_equal_a_plain_search_for_every_term(spark):
    docs, labels = T.keep(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "t"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    more = [(-1, "!scum $tupid 1d10t pond scum trash can"), (-2, None), (-3, ""), (-4, "собака идіот"), (-5, "x" * 50 + " idiot " * 30)]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    model = T.fit(docs, labels.where(~T.in_fold("doc_id", 5, 0)))
    assert model.coefficients and model.words
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id < 0 or doc_id % 10 = 0").collect()}
    got = {r["doc_id"]: r["score"] for r in T.score(docs, model).collect()}
    assert set(texts) <= set(got)
    for i, text in texts.items():
        assert abs(got[i] - plain_score(model, text)) < 1e-9, i


def test_sample_is_bounded_when_an_id_repeats(spark):
    docs = spark.range(6000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    docs = T.keep(docs.unionByName(docs.where("doc_id = 7").limit(50)), "t")
    drawn = spark.createDataFrame([(7, 1), (7, 0), (3000, 1), (3001, 0), (9999, 0)], "id long, toxic int")
    rows = T._sampled(docs, drawn, "doc_id", "text").collect()
    assert sorted((r["id"], r["toxic"]) for r in rows) == [(7, 0), (7, 1), (3000, 1), (3001, 0)]
    assert rows[0]["id"] and sorted(rows) == sorted(T._sampled(docs.repartition(7), drawn, "doc_id", "text").collect())


def test_matches_respect_words_stems_and_exceptions():
    m = T.Matcher(T.Model({"trash": 3.0, "scum": 2.0}, {"lowei": 4.0}, ["trash can"]))
    assert m.matches("the trash can is full of trash.") == {25: 3.0}
    assert m.matches("trashy scumming xscum loweiling (scum)") == {22: 4.0, 33: 2.0}
    assert T.Matcher(T.Model()).matches("trash") == {}


def test_held_out_accuracy(spark):
    out = T.op7_toxicity(spark, SF1)
    assert out.count() == spark.read.parquet(f"{SF1}/documents.parquet").count() and out.where("score is null or score < 0 or score > 1").count() == 0
    seen = out.where("held_out").join(spark.read.parquet(f"{SF1}/labels.parquet"), "doc_id")
    by = {(r["toxic"], r["predicted"]): r["n"] for r in seen.groupBy("toxic", "predicted").agg(F.count("*").alias("n")).collect()}
    # a few labels are 1 on texts without any such word (repeated or decorated words only)
    assert by.get((1, 1), 0) >= 0.92 * (by.get((1, 1), 0) + by.get((1, 0), 0))
    assert by.get((0, 1), 0) <= 0.005 * (by.get((0, 1), 0) + by.get((0, 0), 0))


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs, labels = spark.read.parquet(f"{SF1}/documents.parquet").limit(1500), spark.read.parquet(f"{SF1}/labels.parquet")
    held = T.in_fold("doc_id", 5, 0)
    a = T.fit(docs, labels.where(~held))
    b = T.fit(docs, labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))).where(~held))
    assert a == b


def test_exceptions_are_learned(spark):
    rows = [(i, f"this scum said {i} things") for i in range(60)] + [(100 + i, f"pond scum grew in water {i}") for i in range(40)] + [(200 + i, f"nothing here {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") < 60).cast("int").alias("toxic"))
    model = T.fit(docs, labels, exceptions=[])
    got = {r["doc_id"]: r["score"] for r in T.score(docs, model).collect()}
    assert all(got[i] >= 0.5 for i in range(60)) and all(got[i] < 0.5 for i in got if i >= 60)


def test_edges(spark):
    docs = documents(spark)
    none = T.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in T.score(docs, none).collect()} == {0.0}
    labels = spark.createDataFrame([(1, 0), (2, 1), (None, 1), (5, None), (999, 1), (2, 1)], "doc_id long, toxic int")
    model = T.fit(docs, labels)
    out = T.score(docs, model)
    assert out.count() == docs.count() and out.where("score is null").count() == 0
    kept = T.keep_harmless(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= docs.count()
    assert T.score(empty(spark), model).count() == 0 and T.keep_harmless(empty(spark), labels).count() == 0


def test_fold_of_leading_signs_capitals_accents_and_forms():
    for text, want in {"1diot 1d10t 5tupid $tupid @sshole": "idiot idiot stupid stupid asshole", "(5tupid!!)": "(stupid!!)", "ΜΟRΟΝ ΗΟRΝ": "moron horn", "iԁiot һorn ӏoser": "idiot horn loser",
                       "ｉｄｉｏｔ 𝐢𝐝𝐢𝐨𝐭 ídiot ídiot ＄tupid": "idiot idiot idiot idiot stupid", "a$$$ 15 1960s 2nd (2)": "a$$$ 15 1960s 2nd (2)", "МОRОN ɪᴅɪᴏᴛ": "moron idiot", "가 が": "가 が"}.items():
        assert T.fold(text) == want
    a, b = T.readings("!idiot $tupid a$$$ ＠x")
    assert len(a) == len(b) and a == "iidiot stupid a$$$ ax" and b == "!idiot $tupid a$$$ @x"


def test_leading_signs_hide_no_word():
    m = T.Matcher(T.Model({"idiot": 3.0, "stupid": 2.0}, {"lowei": 4.0}, ["trash can"]))
    for text in ["idiot", "!idiot", "@idiot", "1diot", "+1diot", "(1d10t)", "Іdіоt", "ｉdiot"]:
        assert list(m.found(text)[1].values()) == [3.0], text
    assert list(m.found("$tupid !lowei1ng")[1].values()) == [2.0, 4.0]

import pytest

from payscope.llm import licences as L
from tests.llm.frames import documents, empty

PLANTED = {"MIT": "Released under the MIT License.", "CC-BY-NC": "Licensed under CC BY-NC 4.0.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
           "GPL": "This work is licensed under the GNU General Public License, version 3."}


@pytest.fixture(scope="module")
def model(spark):
    return L.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def families(model, text):
    out = []
    for tokens in model.passages(model.matcher(), text):
        family, _, near = model.classify(tokens)
        if family != L.NONE:
            out.append((family, near >= L.SIMILARITY))
    return out


def test_notices_in_documents_are_found_and_nothing_else(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r["families"] for r in L.scan(docs, model).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]] == sorted(f for f, t in PLANTED.items() if t in r["text"])


def test_every_template_is_confirmed(model):
    for f, texts in L.TEMPLATES.items():
        for t in texts:
            assert (f, True) in families(model, "some words before. " + t + " and some after"), t


def test_held_out_forms(model):
    for text, want in [("this file is licensed under the Apache License, version 2.0 (the license)", "Apache-2.0"), ("RELEASED UNDER THE MIT LICENCE", "MIT"),
                       ("The data is licensed under CC BY-NC 3.0.", "CC-BY-NC"), ("This work is licensed under the\nGNU General Public License,\nversion 2.", "GPL")]:
        assert families(model, text) == [(want, True)], text


def test_other_uses_are_not_licences(model):
    for text in ["The license plate was lost.", "He flew an Apache over the public garden.", "The foundation asked permission to copy the file.", "Free entry to the general public."]:
        assert not any(sure for _, sure in families(model, text)), text
    assert [f for f, _ in families(model, "This file is licensed under the Foo Bar Public License.")] in (["unknown"], [])


def test_notice_inside_a_long_paragraph(model):
    words = " ".join(f"plainword{chr(97 + i % 26)}" for i in range(30_000))
    assert families(model, f"{words} {PLANTED['GPL']} {words} {PLANTED['MIT']} {words}") == [("GPL", True), ("MIT", True)]


def test_edges(spark, model):
    docs = documents(spark)
    out = L.scan(docs, model).collect()
    assert len(out) == docs.count() and all(r["families"] == [] for r in out)
    assert L.scan(empty(spark), model).count() == 0
    assert L.fit(empty(spark)).families[-1] == L.NONE


def test_a_common_notice_opens_the_gate(spark):
    filler = " ".join(f"plainword{chr(97 + i % 26)}" for i in range(400)).split()
    texts = [" ".join(filler[:20 + 7 * i % 97]) + f" {t} " + " ".join(filler[:150]) for i in range(600) for t in [PLANTED["MIT"] if i % 2 else PLANTED["GPL"]]]
    docs = spark.createDataFrame([(i, f"{t} am {i} mit mit den") for i, t in enumerate(texts)], "doc_id long, text string")
    common = L.fit(docs)
    assert common.vocabulary == L.fit(empty(spark)).vocabulary
    assert all(set(common.vocabulary).intersection(L.tokens_of(t)) for ts in L.TEMPLATES.values() for t in ts)
    got = {r["doc_id"]: r["families"] for r in L.scan(docs, common).collect()}
    assert all(got[i] == (["MIT"] if i % 2 else ["GPL"]) for i in range(600))
    for tokens in L.ordinary(L.tokens_of(texts[1])):
        assert "mit" not in tokens and "license" not in tokens


def test_several_notices_on_a_line(spark, model):
    every = [t for ts in L.TEMPLATES.values() for t in ts]
    short = {"MIT": "Licensed under the MIT license.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "CC-BY": "Licensed under CC BY 4.0."}
    lines = [(" ".join(short[f] for f in fs), sorted(fs)) for fs in (["MIT", "Apache-2.0"], ["Apache-2.0", "MIT", "CC-BY"], ["CC-BY", "CC-BY"])]
    lines = [(t, sorted(set(fs))) for t, fs in lines] + [(" ".join(every), sorted(L.TEMPLATES)), (" ".join(every * 20), sorted(L.TEMPLATES))]
    lines += [(f"/*! v1 {a} see the file */ /*! v2 {b} and so on */", sorted({f, g})) for f, fs in L.TEMPLATES.items() for a in fs for g, gs in L.TEMPLATES.items() for b in gs]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(lines)], "doc_id long, text string")
    got = {r["doc_id"]: r["families"] for r in L.scan(docs, model).collect()}
    assert [got[i] for i in range(len(lines))] == [fs for _, fs in lines]


def naive_class(model, tokens):
    """The model's verdict on a passage, word by word: scores, calibrated probability, share of a template's shingles."""
    import math
    grams = {g for n in (1, 2, 3) for g in (" ".join(tokens[i: i + n]) for i in range(len(tokens) - n + 1))}
    rows = [model.features[g] for g in L.grams_of(tokens) if g in model.features]
    assert {g for g, k in model.features.items() if k in rows} <= grams
    z = [float(model.weights[-1][k] + sum(model.weights[r][k] for r in rows)) for k in range(len(model.families))]
    best = max(range(len(z)), key=lambda k: z[k])
    if model.families[best] == L.NONE:
        return L.NONE if math.exp(z[best]) / sum(map(math.exp, z)) >= L.SURE_NONE else L.UNKNOWN
    margin = z[best] - math.log(sum(math.exp(x) for k, x in enumerate(z) if k != best))
    p = 1 / (1 + math.exp(-(model.scale * margin + model.shift)))
    near = max(naive_share(tokens, L.tokens_of(t)) for t in L.TEMPLATES[model.families[best]])
    return model.families[best] if p >= 0.5 or near >= L.SIMILARITY else L.UNKNOWN


def naive_share(tokens, template):
    n = min(5, len(template))
    wanted = {tuple(template[i: i + n]) for i in range(len(template) - n + 1)}
    return len([w for w in wanted if any(tuple(tokens[i: i + n]) == w for i in range(len(tokens) - n + 1))]) / len(wanted)


def test_query_equals_brute_force(spark, model):
    """Families by every window of every text that confirms a template, verdicts of passages by plain sums."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r for r in L.op10_licence_scan(spark, "/root/testdata/sf0.01").collect()}
    rows, matcher = docs.collect(), model.matcher()
    assert len(got) == len(rows)
    for r in rows:
        sure = set()
        for tokens in model.passages(matcher, r["text"] or ""):
            assert model.classify(tokens)[0] == naive_class(model, tokens)
            for family, template in L.TEMPLATE_TOKENS:
                for i in range(len(tokens)):
                    window = tokens[i: i + L.WINDOW]
                    if window[0] in template and naive_share(window, template) >= L.SIMILARITY:
                        sure.add(family)
                        break
        assert got[r["doc_id"]]["families"] == sorted(sure)


def test_the_sample_is_of_whole_texts_and_bounded(spark):
    far = "plain word " * 20_000 + "they asked permission of the whole house"
    rows = [(i, f"He asked permission of person number x{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]} twice.") for i in range(100)] + [(100, far), (101, far), (102, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [r["passage"] for r in L.ordinary_passages(docs).collect()]
    assert len(found) == len(set(found)) and any("permission of the whole" in p for p in found)
    one, many = (L.fit(docs.repartition(n), fit_passages=10) for n in (1, 7))
    assert (one.weights == many.weights).all() and one.features == many.features
    assert L.ordinary_passages(empty(spark)).count() == 0

"""Toxicity score from a weighted lexicon matched by Aho-Corasick (operator 7).

*Fold.* Compatibility forms (NFKC) without combining accents, lower case, look-alike letters of other scripts (capitals by their own shape) to
Latin ones, invisible characters dropped, digits and signs between letters, or before a word of letters and such signs, to the letters they
stand for; white space becomes one blank.  A word after leading signs is also read without them, so "!scum" is "scum".
*Lexicon.* Terms are folded words and word beginnings.  A term's weight is its smoothed log odds of occurring in toxic against other
labelled texts; terms that are not far likelier in toxic texts (likelihood ratio above chance for that many terms) are left out.
*Exceptions.* A phrase of a term and its neighbour word that marks texts as not toxic, learned alike or given, voids the match inside it.
*Score.* A word counts the largest weight among its matches.  The sum, its ratio to the text's length and the number of matches go
through a logistic function fitted on the labelled texts, with the class shares of all labels.

``fit`` reads at most ``FIT_ROWS`` labelled ids of each class (least hash of the id first), of each one text (that of the least row hash), a
documented bound.  The lexicon takes every term that qualifies, and a term must stand in ``MIN_TEXTS`` of these texts, so it is bounded by
them; ``max_terms`` and ``max_exceptions`` of ``fit`` cut it to the likeliest ones if given.  Scoring reads whole texts, in one pass without a
shuffle.

Cases: null and empty texts have no match and get the score of such texts; without labels of both classes every score is the share of
toxic labels (0 without labels); repeated rows score alike; null labels and labels of unknown ids are left out.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from payscope.llm.common import about, keep, table

FIT_ROWS = 10_000
MIN_TEXTS = 5
MIN_WEIGHT = math.log(8)
STEM_CHARS = (4, 5, 6, 7)

#: Look-alike letters of the Cyrillic and Greek scripts and what they look like (fixed values).
LOOK_ALIKES = dict(zip("абвгдезіјкмнорсѕтухьαβγεηικνορτυχω", "abbrgeeijkmhopcstyxbabyenikvoptuxw"))
LOOK_ALIKES |= dict(zip("ԁһӏԛԝѵпиүμπσςϲϳոօսհցɡɑıɩłøđħŧ", "dhlqwvnuyunoccjnouhggaiilodht"))
#: Capitals whose look is not that of their small letter (fixed values).
CAPITALS = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧАВЕЅІЈКМНОРСТУХԌԚԜ", "abezhikmnoptyxabesijkmhopctyxgqw"))
#: Small capitals (fixed values).
SMALL_CAPITALS = dict(zip("ᴀʙᴄᴅᴇꜰɢʜɪᴊᴋʟᴍɴᴏᴘʀꜱᴛᴜᴠᴡʏᴢ", "abcdefghijklmnoprstuvwyz"))
#: Digits and signs that stand for letters inside a word (fixed values).
LEET = dict(zip("0134578@$!+€", "oieastbasite"))
#: Invisible characters (fixed values).
INVISIBLE = [0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF]
#: Harmless phrases of words that are insults elsewhere (fixed values).
EXCEPTIONS = ["trash can", "trash bin", "taking out the trash", "pond scum", "class clown", "clown fish", "idiot proof", "sore loser"]

_FOLD = {ord(k): v for k, v in (LOOK_ALIKES | SMALL_CAPITALS).items()} | dict.fromkeys(INVISIBLE)
_CAPITALS = {ord(k): v for k, v in CAPITALS.items()}
_ACCENTS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
_LEET = {ord(k): v for k, v in LEET.items()}
_INSIDE = re.compile(r"(?<=[^\W\d_])[0134578@$!+€]+(?=[^\W\d_])")
_LEADING = re.compile(r"(?<![\w@$!+€])[0134578@$!+€]+(?=[^\W\d_](?:[^\W\d_]|[0134578@$!+€])*(?!\w))")
_WORD = re.compile(r"[^\W\d_]+")


def _plain(text: str) -> str:
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKC", _ACCENTS.sub("", unicodedata.normalize("NFKD", text)))
    return text.translate(_CAPITALS).lower().translate(_FOLD)


def readings(text: str | None) -> tuple[str, str]:
    """The folded text, and the same with leading digits and signs of words as they are; both have the same length."""
    kept = " ".join(_INSIDE.sub(lambda m: m[0].translate(_LEET), _plain(text or "")).split())
    return _LEADING.sub(lambda m: m[0].translate(_LEET), kept), kept


def fold(text: str | None) -> str:
    """The folded text; a word's letters are what stands between blanks and marks."""
    return readings(text)[0]


@dataclass
class Model:
    """Weights of words, of word beginnings, exception phrases, logistic coefficients, and the share of toxic labels."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    coefficients: list[float] | None = None
    share: float = 0.0


class Matcher:
    """The lexicon and the exception phrases in one automaton."""

    def __init__(self, model: Model):
        import ahocorasick
        self.automaton, terms = ahocorasick.Automaton(), {}
        for w, v in model.words.items():
            terms.setdefault(w, [None, None, False])[0] = v
        for w, v in model.stems.items():
            terms.setdefault(w, [None, None, False])[1] = v
        for w in model.exceptions:
            terms.setdefault(w, [None, None, False])[2] = True
        for w, what in terms.items():
            self.automaton.add_word(w, (len(w), *what))
        self.any = bool(terms)
        if self.any:
            self.automaton.make_automaton()

    def matches(self, folded: str, kept: str | None = None) -> dict[int, float]:
        """Largest weight by start of the word, without words inside an exception phrase; a word may start wherever no letter of ``kept`` goes before."""
        kept = folded if kept is None else kept
        found: dict[int, float] = {}
        void: list[tuple[int, int]] = []
        if not self.any:
            return found
        n = len(folded)
        for last, (size, word, stem, phrase) in self.automaton.iter(folded):
            start = last - size + 1
            if start and kept[start - 1].isalpha():
                continue
            ends = last + 1 == n or not folded[last + 1].isalpha()
            if phrase and ends:
                void.append((start, last))
            weight = max(stem if stem is not None else 0.0, word if word is not None and ends else 0.0)
            if weight:
                found[start] = max(weight, found.get(start, 0.0))
        return {s: v for s, v in found.items() if not any(a <= s <= b for a, b in void)} if void else found


    def found(self, text: str | None) -> tuple[str, dict[int, float]]:
        """The folded text and its matches; a word after leading signs counts once, by its larger weight with or without them."""
        folded, kept = readings(text)
        if folded == kept:
            return folded, self.matches(folded)
        found: dict[int, float] = {}
        for start, weight in self.matches(folded, kept).items():
            while start and kept[start - 1] != folded[start - 1]:
                start -= 1
            found[start] = max(weight, found.get(start, 0.0))
        return folded, found


def features(total: float, hits: int, n_words: int) -> list[float]:
    """Inputs of the logistic function: weight, weight by length, hits."""
    return [math.log1p(total), math.log1p(100.0 * total / max(n_words, 20)), float(min(hits, 3))]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the last coefficient is the constant."""
    x = np.c_[x, np.ones(len(x))]
    b = np.zeros(x.shape[1])
    pull = np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (weight * (y - p)) - pull * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def _likelihood_ratio(a: Column, n: Column, b: Column, m: Column) -> Column:
    """G squared of ``a`` of ``n`` against ``b`` of ``m``."""
    share = (a + b) / (n + m)
    part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(F.lit(0.0))
    return 2 * (part(a, n * share) + part(b, m * share) + part(n - a, n * (1 - share)) + part(m - b, m * (1 - share)))


def _counted(sample: DataFrame, terms_of) -> DataFrame:
    """(term, toxic, clean): texts of each class that hold the term; counted a batch at a time before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic, clean = Counter(), Counter()
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                (toxic if label else clean).update(terms_of(text))
            terms = list(toxic.keys() | clean.keys())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()),
                                              pa.array([clean[t] for t in terms], pa.int64())], ["term", "toxic", "clean"])

    counts = sample.select("text", "toxic").mapInArrow(run, "term string, toxic long, clean long")
    return counts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _terms_of(text: str | None) -> set[str]:
    words = {w for reading in set(readings(text)) for w in _WORD.findall(reading)}
    words = {w for w in words if len(w) >= 2}
    return words | {f"^{w[:n]}" for w in words for n in STEM_CHARS if len(w) > n}


def _best(counts: DataFrame, n: int, m: int, a: str, b: str, most: int | None) -> list:
    """Terms far likelier in class ``a`` (n texts) than in class ``b`` (m texts); the ``most`` likeliest, if given."""
    counts = keep(counts, "toxicity-terms")
    floor = 2 * math.log(max(counts.count(), 1)) + 2
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    weight = F.log((x + 0.5) / (n + 1.0)) - F.log((y + 0.5) / (m + 1.0))
    good = (counts.withColumn("weight", weight).withColumn("g", _likelihood_ratio(x, F.lit(float(n)), y, F.lit(float(m))))
            .where((x >= MIN_TEXTS) & (F.col("weight") >= MIN_WEIGHT) & (F.col("g") >= floor)))
    good = good if most is None else good.orderBy(F.desc("g"), "term").limit(most)
    return sorted(good.select("term", "weight").collect())  # each in MIN_TEXTS of the fitting texts at least


def _sampled(docs: DataFrame, drawn: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, toxic): one row of ``docs`` for each row of ``drawn`` (id, toxic), that of the least row hash, however many share the id."""
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("tie")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), tie).join(drawn, "id")
    first = rows.groupBy("id", "toxic").agg(F.min("tie").alias("first"))  # combined in each task before the shuffle
    rows = rows.join(keep(first, "toxicity-first").select("id", "toxic", F.col("first").alias("tie")), ["id", "toxic", "tie"])
    return keep(rows.dropDuplicates(["id", "toxic"]).select("id", "text", "toxic"), "toxicity-sample")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        fit_rows: int = FIT_ROWS, exceptions: list[str] | None = None, max_terms: int | None = None, max_exceptions: int | None = None) -> Model:
    """Learn lexicon, exceptions and the logistic function from ``labels`` (id, label 0/1) of ``docs``."""
    known = keep(labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
                 .select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).distinct(), "toxicity-labels")
    by_class = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = by_class.get(1, 0) / max(sum(by_class.values()), 1)
    model = Model(exceptions=list(EXCEPTIONS if exceptions is None else exceptions), share=share)
    if len(by_class) < 2:
        return model
    some = [about(known.where(F.col("toxic") == c), 2 * fit_rows, by_class[c], F.xxhash64("id")) for c in (0, 1)]
    drawn = [x.orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 62)), "id").limit(fit_rows) for x in some]
    drawn = keep(drawn[0].unionByName(drawn[1]), "toxicity-drawn")
    sample = _sampled(docs, drawn, id_col, text_col)
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n, m = sizes.get(1, 0), sizes.get(0, 0)
    if not n or not m:
        return model
    for r in _best(_counted(sample, _terms_of), n, m, "toxic", "clean", max_terms):
        if r["term"].startswith("^"):
            model.stems[r["term"][1:]] = r["weight"]
        else:
            model.words[r["term"]] = r["weight"]
    bare = Matcher(Model(model.words, model.stems))

    def phrases(text: str | None) -> set[str]:
        folded, out = fold(text), set()
        for start in bare.matches(folded):
            before, after = folded[:start].split(" ")[-2:-1], folded[start:].split(" ", 2)[:2]
            word = _WORD.match(after[0])[0]
            out |= {f"{b} {word}" for b in before if b} | ({f"{word} {_WORD.match(after[1])[0]}"} if len(after) > 1 and after[0] == word and _WORD.match(after[1]) else set())
        return out

    model.exceptions += sorted(r["term"] for r in _best(_counted(sample, phrases), m, n, "clean", "toxic", max_exceptions))
    measured = _measured(sample.select("toxic", "text"), model, "toxic", "text", "total double, hits long, n_words long")
    rows = measured.groupBy("toxic", "total", "hits", "n_words").agg(F.count("*").alias("n")).collect()  # at most 2 * fit_rows
    x = np.array([features(r["total"], r["hits"], r["n_words"]) for r in rows])
    y = np.array([float(r["toxic"]) for r in rows])
    weight = np.array([r["n"] * (by_class[1] / n if r["toxic"] else by_class[0] / m) for r in rows])
    model.coefficients = _logistic(x, y, weight * (n + m) / sum(by_class.values())).tolist()
    return model


def _measured(docs: DataFrame, model: Model, id_col: str, text_col: str, _: str = "") -> DataFrame:
    """(id, total, hits, n_words) of every text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # terms that stand in MIN_TEXTS of the fitting texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for b in batches:
            rows = []
            for text in b.column(1):
                folded, found = matcher.found(text.as_py())
                rows.append((float(sum(found.values())), len(found), folded.count(" ") + bool(folded)))
            cols = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())],
                                             [id_col, "total", "hits", "n_words"])

    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), StructField("total", DoubleType()),
                         StructField("hits", LongType()), StructField("n_words", LongType())])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def score_column(model: Model) -> Column:
    """The logistic function of total, hits and n_words."""
    if model.coefficients is None:
        return F.lit(float(model.share))
    a, b, c, d = model.coefficients
    total, hits, n = F.col("total"), F.col("hits"), F.col("n_words")
    z = a * F.log1p(total) + b * F.log1p(100.0 * total / F.greatest(n, F.lit(20))) + c * F.least(hits, F.lit(3)) + d
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, hits, n_words) of every text of ``docs``."""
    return _measured(docs, model, id_col, text_col).select(id_col, score_column(model).alias("score"), "hits", "n_words")


def in_fold(id_col: str, folds: int, fold_no: int) -> Column:
    """crc32 of the id as text leaves ``fold_no`` modulo ``folds`` (null ids: false)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold_no, F.lit(False))


def keep_harmless(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with their columns; the model is fitted on all of ``labels``."""
    model = fit(docs, labels, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    a = model.coefficients

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)

        def harmless(text: str | None) -> bool:
            folded, found = matcher.found(text)
            z = float(np.dot(a, [*features(sum(found.values()), len(found), folded.count(" ") + bool(folded)), 1.0]))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) < threshold

        for b in batches:
            yield b.filter(pa.array([harmless(t.as_py()) for t in b.column(at)], pa.bool_()))

    if a is None:
        return docs if model.share < threshold else docs.limit(0)
    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = in_fold("doc_id", 5, 0)
    model = fit(docs, labels.where(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLE_SQL: dict[str, str] = {}  # Aho-Corasick and the fitted model have no SQL form; tests/llm holds held-out accuracy

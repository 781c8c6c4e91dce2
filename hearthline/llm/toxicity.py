"""Toxicity by a weighted lexicon: folded text, Aho-Corasick matching, exception phrases, a score normalised by length."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.storage import discard, materialise

#: Letters of other scripts that look like Latin ones, and digits and signs used for letters.
LOOKALIKES = dict(zip("аеорсухіјѕԁһкмтвнαεορτυικνχβ", "aeopcyxijsdhkmtbhaeoptuikvxb"))
SUBSTITUTES = dict(zip("013457@$", "oieastas"))
ACCENTS = {
    "a": "àáâãäåāăą", "c": "çćĉċč", "d": "ďđ", "e": "èéêëēĕėęě", "g": "ĝğġģ", "h": "ĥħ", "i": "ìíîïĩīĭįı", "j": "ĵ", "k": "ķ", "l": "ĺļľł",
    "n": "ñńņň", "o": "òóôõöøōŏő", "r": "ŕŗř", "s": "śŝşš", "t": "ţťŧ", "u": "ùúûüũūŭůűų", "w": "ŵ", "y": "ýÿŷ", "z": "źżž",
}
FOLD = str.maketrans({**LOOKALIKES, **SUBSTITUTES, **{c: a for a, many in ACCENTS.items() for c in many}, "ß": "ss", "­": "", "​": "", "‌": "", "‍": ""})
GAPS = re.compile(r"[\W_]+")
#: Lengths of the word beginnings that may stand in the lexicon beside whole words.
STEMS = (4, 5, 6, 7, 8)


def fold(text: str | None) -> str:
    """Lower case without accents, look-alikes and substitutes; one space between words and at both ends."""
    return f" {GAPS.sub(' ', text.lower().translate(FOLD)).strip()} " if text else "  "


def terms(folded: str) -> set[str]:
    """The distinct words (' word ') and word beginnings (' stem') of a folded text."""
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in STEMS if len(w) > n}


@dataclass(frozen=True)
class Lexicon:
    """Weighted terms, exception phrases that void the hits they cover, and the score's intercept and slopes."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (0.0, 1.0, 1.0)

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            out.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            out.add_word(phrase, (len(phrase), None))
        if len(out):
            out.make_automaton()
        return out

    @staticmethod
    def hits(automaton: ahocorasick.Automaton, folded: str) -> dict[int, tuple[int, float]]:
        """By the place of the space before a word, the end and weight of its heaviest term, without those that an exception covers."""
        found: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        if not len(automaton):
            return found
        for last, (size, weight) in automaton.iter(folded):
            start = last + 1 - size
            if weight is None:
                spared.append((start, last + 1))
            elif start not in found or weight > found[start][1]:
                found[start] = (last + 1, weight)
        for a, b in spared:
            start = a
            while 0 <= start < b:
                if start in found and found[start][0] <= b:
                    del found[start]
                start = folded.find(" ", start + 1)
        return found

    @staticmethod
    def features(total: float, words: int) -> tuple[float, float]:
        return math.log1p(total), math.log1p(100 * total / max(words, 1))

    def score(self, automaton: ahocorasick.Automaton, text: str | None) -> float:
        folded = fold(text)
        total = sum(w for _, w in self.hits(automaton, folded).values())
        a, b = self.features(total, folded.count(" ") - 1)
        z = self.curve[0] + self.curve[1] * a + self.curve[2] * b
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def _counted(rows: DataFrame, of) -> DataFrame:
    """term, toxic, clean: in how many of the rows (text, toxic) of(folded text) has the term; summed in every task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            names = list(counts[0].keys() | counts[1].keys())
            batch = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in (counts[1], counts[0]))], names=["term", "toxic", "clean"])
            counts[0].clear(), counts[1].clear()
            return batch

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                counts[label].update(of(fold(text.as_py())))
                if len(counts[0]) + len(counts[1]) > 300_000:
                    yield out()
        yield out()

    return rows.mapInArrow(run, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _fit(rows: np.ndarray, labels: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression of two features with a small ridge, by Newton's steps."""
    x = np.column_stack([np.ones(len(rows)), rows])
    w = np.zeros(3)
    ridge = np.diag([1e-6, 1e-2, 1e-2])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (labels - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def learn(rows: DataFrame, most_rows: int = 20_000) -> Lexicon:
    """A lexicon from labelled rows (id, text, toxic): a bounded sample of about most_rows of them, chosen by a hash of the id.

    A term enters if the documents that have it are toxic far more often than others: by a likelihood ratio that
    allows for the number of terms tried, and in at least four documents. Equal texts count once. Phrases of a hit and a word beside it that occur in
    three or more clean documents, and in four times as many of them as of toxic ones, are exceptions. All terms and phrases that pass are kept; the sample bounds them. The score's curve is fitted to the same sample. Without labels of both kinds the lexicon is empty, and every score is the share of toxic labels (next to 0 without labels).
    """
    rows = rows.where("toxic IS NOT NULL").select("id", F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"))
    n = rows.count()
    share = int(1_000_000 * min(1.0, most_rows / max(n, 1)))
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share).groupBy(F.md5("text").alias("of")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    sample = materialise(sample.select("text", "toxic"))
    totals = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    toxic, clean = totals["t"], totals["n"] - totals["t"]
    if not toxic or not clean:
        p = toxic / max(totals["n"], 1)
        return Lexicon({}, (), (math.log(p / (1 - p)) if 0 < p < 1 else (50.0 if p else -50.0), 0.0, 0.0))
    counted = materialise(_counted(sample, terms).where("toxic + clean >= 4"))
    tried = counted.count()
    entropy = lambda k, rest: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) * (toxic + clean) / ((F.col("toxic") + F.col("clean")) * rest))).otherwise(0.0)
    ratio = 2 * (entropy("toxic", toxic) + entropy("clean", clean))
    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    chosen = counted.withColumn("ratio", ratio).withColumn("weight", weight).where((F.col("weight") > 2.5) & (F.col("ratio") > 2 * math.log(tried + 1) + 4) & (F.col("toxic") >= 4) & (F.col("toxic") > F.col("clean")))
    weights = {r["term"]: float(r["weight"]) for r in chosen.collect()}

    def phrases(folded: str, held: list = []) -> set[str]:  # noqa: B006
        if not held:
            held.append(Lexicon(weights).automaton())
        out = set()
        for start in Lexicon.hits(held[0], folded):
            end = folded.index(" ", start + 1)
            if (before := folded.rfind(" ", 0, start)) >= 0:
                out.add(folded[before : end + 1])
            if (after := folded.find(" ", end + 1)) >= 0:
                out.add(folded[start : after + 1])
        return out

    spared = _counted(sample, phrases).where("clean >= 3 AND clean >= 4 * toxic").collect()
    bare = Lexicon(weights, tuple(sorted(r["term"] for r in spared)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = bare.automaton()
        for batch in batches:
            both = []
            for text in batch.column(0):
                folded = fold(text.as_py())
                both.append(bare.features(sum(w for _, w in bare.hits(automaton, folded).values()), folded.count(" ") - 1))
            a = np.array(both).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1]), batch.column(1)], names=["a", "b", "toxic"])

    # bounded by most_rows
    points = sample.mapInArrow(measure, "a double, b double, toxic int").toPandas().sort_values(["a", "b", "toxic"])
    discard(sample)
    discard(counted)
    return Lexicon(weights, bare.exceptions, _fit(points[["a", "b"]].to_numpy(), points["toxic"].to_numpy().astype(float)))


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) per row of docs; null and empty texts have no hits and get the score of none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            scores = [lexicon.score(automaton, text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def score_column(lexicon: Lexicon):
    """A function from a column of texts to their scores, as score() gives them."""

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        automaton = lexicon.automaton()
        return texts.map(lambda t: lexicon.score(automaton, t if isinstance(t, str) else None)).astype(float)

    return scores


def held_out(id_col: str):
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def learn_from_labels(docs: DataFrame, labels: DataFrame, **bounds) -> Lexicon:
    """learn() from documents (doc_id, text) and labels (doc_id, toxic), without the held-out rows. A document with several labels is toxic if one says so."""
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return learn(docs.select("doc_id", "text").join(known, "doc_id").select(F.col("doc_id").alias("id"), "text", "toxic"), **bounds)


def classify(docs: DataFrame, labels: DataFrame, cut: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= cut, else 0) per row of docs (doc_id, text).

    A null or empty text has the score of no hits; rows that repeat give rows that repeat; a null id is carried along and is not held out, as no label is its own. No documents give no
    rows; without labels every score is next to 0. A text's length does not matter: one pass finds all terms.
    """
    out = score(docs, learn_from_labels(docs, labels))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= cut, 1).otherwise(0).alias("predicted"))

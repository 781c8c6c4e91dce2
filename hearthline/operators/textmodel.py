"""Text as numbers: TF-IDF over a bounded vocabulary and its truncated singular value decomposition, fitted inside a fold by passes over sparse rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.operators.lineage import cut_lineage
from hearthline.operators.quality import counted_terms, tallies
from hearthline.operators.quantiles import exact_quantiles

#: The most terms of a vocabulary, the fewest documents of a term, and the components kept.
MOST_TERMS, LEAST_DOCUMENTS, COMPONENTS = 8000, 3, 60


def term_counts(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """keep, term and n: how often each word of two or more letters, and each pair of such words in a row, stands in a row's text (lower case). Null and empty texts have none."""
    return counted_terms(df, text, *keep).select(*keep, F.inline_outer("terms")).where("term IS NOT NULL")


def vocabulary(df: DataFrame, text: str, most: int = MOST_TERMS, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """term, documents and idf (ln((1 + rows) / (1 + documents)) + 1) of the ``most`` most frequent terms that ``least`` rows or more have; of equally frequent ones the first by name."""
    found = term_counts(df, text).groupBy("term").agg(F.count("*").alias("documents"), F.sum("n").alias("n")).where(F.col("documents") >= least)
    rows = df.agg(F.count("*").alias("rows"))
    top = found.orderBy(F.desc("n"), "term").limit(most).join(F.broadcast(rows))
    return top.select("term", "documents", (F.log((1 + F.col("rows")) / (1 + F.col("documents"))) + 1).alias("idf"))


def fold_vocabularies(df: DataFrame, text: str, fold: str, most: int = MOST_TERMS, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """fold, term, documents and idf: vocabulary() of the rows outside each fold, all folds from one count by term and fold (the totals less a fold's own)."""
    cells = term_counts(df, text, fold).groupBy("term", fold).agg(F.count("*").alias("documents"), F.sum("n").alias("n"))
    cells = cut_lineage(cells)  # read for the totals and for the folds' own
    folds = df.groupBy(fold).agg(F.count("*").alias("own"))  # one row per fold
    folds = folds.join(F.broadcast(df.agg(F.count("*").alias("all")))).select(F.col(fold).alias("_fold"), (F.col("all") - F.col("own")).alias("rows"))
    totals = cells.groupBy("term").agg(F.sum("documents").alias("documents"), F.sum("n").alias("n")).join(F.broadcast(folds))
    own = cells.select(F.col("term").alias("_term"), F.col(fold).alias("_own"), F.col("documents").alias("_d"), F.col("n").alias("_n"))
    left = totals.join(own, (F.col("term") == F.col("_term")) & (F.col("_fold") == F.col("_own")), "left")
    left = left.select(F.col("_fold").alias(fold), "term", "rows", (F.col("documents") - F.coalesce("_d", F.lit(0))).alias("documents"), (F.col("n") - F.coalesce("_n", F.lit(0))).alias("n")).where(F.col("documents") >= least)
    # only terms as frequent as a vocabulary's last one are put in order
    left = cut_lineage(left)
    last = exact_quantiles(left, [fold], "n", {"_least": lambda n: F.greatest(n - most + 1, F.lit(1))}).select(F.col(fold).alias("_fold"), "_least")
    left = left.join(F.broadcast(last), F.col(fold) == F.col("_fold")).where("n >= _least")
    kept = left.withColumn("_place", F.row_number().over(Window.partitionBy(fold).orderBy(F.desc("n"), "term"))).where(F.col("_place") <= most)
    return kept.select(fold, "term", "documents", (F.log((1 + F.col("rows")) / (1 + F.col("documents"))) + 1).alias("idf"))


@dataclass(frozen=True)
class TextModel:
    """The terms with their idf, and a column of loadings per component; both bounded by the vocabulary's and components' parameters."""

    terms: dict[str, int]
    idf: np.ndarray
    loadings: np.ndarray
    singular: np.ndarray

    def sparse(self, text: Column) -> Column:
        """Places (at) and weights (w) of a text's terms: counts times idf, of length 1; empty without known terms."""
        terms, idf = self.terms, self.idf

        @F.pandas_udf("at array<int>, w array<double>")
        def vectors(texts: pd.Series) -> pd.DataFrame:
            at, w = [], []
            for counted in tallies(texts):
                own = sorted((terms[t], n) for t, n in counted if t in terms)
                a = np.array([i for i, _ in own], np.int32)
                v = np.array([n for _, n in own], float) * idf[a]
                at.append(a)
                w.append(v / (np.sqrt((v * v).sum()) or 1.0))
            return pd.DataFrame({"at": at, "w": w})

        return vectors(F.coalesce(text, F.lit("")))

    def transform(self, df: DataFrame, text: str, prefix: str = "txt_") -> DataFrame:
        """df with a column per component, 0 for texts without known terms."""
        loadings = self.loadings

        @F.pandas_udf("array<double>")
        def scores(at: pd.Series, w: pd.Series) -> pd.Series:
            return pd.Series([np.asarray(x) @ loadings[np.asarray(i, int)] if len(i) else np.zeros(loadings.shape[1]) for i, x in zip(at, w)])

        out = df.withColumn("_v", self.sparse(F.col(text))).withColumn("_s", scores(F.col("_v.at"), F.col("_v.w")))
        return out.select(*df.columns, *(F.get("_s", F.lit(k)).alias(f"{prefix}{k}") for k in range(loadings.shape[1])))


def _product(vectors: DataFrame, basis: np.ndarray) -> np.ndarray:
    """M'M times basis, M being the sparse rows (at, w): summed in every task, then by term."""
    height, width = basis.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((height, width))
        for batch in batches:
            for k in range(0, batch.num_rows, 500):  # a bounded number of terms at once
                part = batch.slice(k, 500)
                lists, w = part.column(0), part.column(1).flatten().to_numpy(zero_copy_only=False)
                at, row = lists.flatten().to_numpy(zero_copy_only=False).astype(int), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                y = np.zeros((len(lists), width))
                np.add.at(y, row, w[:, None] * basis[at])
                np.add.at(total, at, w[:, None] * y[row])
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(list(total[used]), pa.list_(pa.float64()))], names=["term", "v"])

    # one row per term of the vocabulary
    rows = vectors.mapInArrow(run, "term int, v array<double>").groupBy("term").agg(*(F.sum(F.get("v", F.lit(j))).alias(f"v{j}") for j in range(width))).collect()
    out = np.zeros((height, width))
    for r in rows:
        out[r["term"]] = r[1:]
    return out


def fit_text(df: DataFrame, text: str, components: int = COMPONENTS, most: int = MOST_TERMS, least: int = LEAST_DOCUMENTS, rounds: int = 12, beyond: int = 10, close: float = 1e-7) -> TextModel:
    """TF-IDF and its largest singular vectors, from the rows of df alone.

    A random basis of components + beyond columns is multiplied by M'M, one pass over the sparse rows a round, and made orthonormal again, until the singular values settle
    (to ``close`` of the largest) or ``rounds`` are done; the small matrix in that basis then gives the vectors. Signs: the largest loading of each is positive. The driver holds the basis, of ``most``
    rows at most. Fewer terms than components give as many components as there are terms.
    """
    known = vocabulary(df, text, most, least).orderBy("term").collect()  # at most ``most``
    bare = TextModel({r["term"]: i for i, r in enumerate(known)}, np.array([r["idf"] for r in known]), np.zeros((len(known), 0)), np.zeros(0))
    keep = min(components, len(known))
    if not keep:
        return bare
    vectors = cut_lineage(df.select(bare.sparse(F.col(text)).alias("v")).select("v.*").where(F.size("at") > 0))
    basis = np.linalg.qr(np.random.default_rng(0).normal(size=(len(known), min(len(known), keep + beyond))))[0]
    before = np.zeros(keep)
    for _ in range(rounds):
        product = _product(vectors, basis)
        values, turn = np.linalg.eigh((basis.T @ product + product.T @ basis) / 2)
        singular = np.sqrt(np.maximum(values[::-1][:keep], 0))
        if np.abs(singular - before).max() <= close * singular[0]:
            break
        before = singular
        basis = np.linalg.qr(product)[0]
    loadings = (basis @ turn[:, ::-1])[:, :keep]
    loadings = loadings * np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(keep)])
    return TextModel(bare.terms, bare.idf, loadings, singular)


def text_components(df: DataFrame, text: str, fold: str, folds: int, row_id: str = "row_id", **how) -> DataFrame:
    """row_id, fold and txt_0, txt_1, ...: each row by the model of the rows outside its fold. Folds with fewer terms than components have nulls in the last ones."""
    out = None
    for k in range(folds):
        part = fit_text(df.where(f"{fold} <> {k}"), text, **how).transform(df.where(f"{fold} = {k}").select(row_id, fold, text), text).drop(text)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out

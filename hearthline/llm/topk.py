"""Exact top-k by inner product, with no-random-access aggregation over sorted lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.llm.storage import materialise

#: Steps in which a block's lists are read from end to end.
STEPS = 24


class Lists:
    """A block of vectors with one list per component, sorted by its value; ``place`` says where in each list a vector stands."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors.astype(np.float64)
        order = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.vectors, order, 0)
        self.place = np.empty_like(order)
        np.put_along_axis(self.place, order, np.arange(len(ids))[:, None], 0)

    def top(self, queries: np.ndarray, own: np.ndarray, bars: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (a row) the places in the block and the scores of its k best vectors that reach its bar, ties to the smaller id; ``own`` is the query's own place, -1 if it is in another block.

        Every list is read from its best end for the query, the upper end for a component above 0 and the lower one below, some places at a time. What is seen of a
        vector counts; for what is not, the list's last value read bounds the score from above, the list's worst value from below. The bar rises to
        the k-th best lower bound. A query is done when the upper bounds of all but a few vectors are below its bar: at once, if the
        best values of the lists together stay below it. The few are read on to the end, so that no score is looked up.
        """
        m, step = len(self.ids), max(1, -(-len(self.ids) // STEPS))
        rising, falling, bars = np.maximum(queries, 0.0).T, np.minimum(queries, 0.0).T, bars.copy()
        worst, best = self.sorted[0], self.sorted[-1]
        out: list = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        open_ = np.flatnonzero(best @ rising + worst @ falling >= bars)
        e = 0
        while len(open_):
            e = min(e + step, m)
            from_top, from_bottom = self.place >= m - e, self.place < e
            up, down = rising[:, open_], falling[:, open_]
            upper = np.where(from_top, self.vectors, self.sorted[m - e]) @ up + np.where(from_bottom, self.vectors, self.sorted[e - 1]) @ down
            column = np.flatnonzero(own[open_] >= 0)
            upper[own[open_][column], column] = -np.inf
            if m - 1 > k:
                lower = np.where(from_top, self.vectors, worst) @ up + np.where(from_bottom, self.vectors, best) @ down
                lower[own[open_][column], column] = -np.inf
                bars[open_] = np.maximum(bars[open_], np.partition(lower, m - k, axis=0)[m - k])
            may = upper >= bars[open_]
            done = (may.sum(0) <= 4 * k) | (e == m)
            for c in np.flatnonzero(done).tolist():
                j, rows = open_[c], np.flatnonzero(may[:, c] & (upper[:, c] > -np.inf))
                score = self.read_on(rows, queries[j], e, step)
                order = np.lexsort((self.ids[rows], -score))[:k]
                order = order[score[order] >= bars[j]]
                out[j] = rows[order], score[order]
            open_ = open_[~done]
        return out

    def read_on(self, rows: np.ndarray, q: np.ndarray, e: int, step: int) -> np.ndarray:
        """The scores of a few vectors: what the lists gave down to e, and what they give from there on until each vector was met in all of them."""
        met = np.where(q > 0, len(self.ids) - 1 - self.place[rows], self.place[rows])
        score, d = np.zeros(len(rows)), 0
        while d <= met.max(initial=-1):
            score += np.where((met >= d) & (met < e), self.vectors[rows], 0.0) @ q
            d, e = e, e + step
        return score


def _matrix(table: pa.Table, width: int) -> np.ndarray:
    lists = table.column("v").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    count = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(count), width), np.int64)
    inside = np.arange(width) < count[:, None]
    out[inside] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _block_search(k: int, chunk: int = 512):
    """Queries (key, id, v, n, bar) against the vectors (key, id, v, n) of one block."""

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        width = max([0, *(int(x or 0) for t in (queries, candidates) for x in t.column("n").to_pylist())])
        found: list[list] = [[], [], [], []]
        if queries.num_rows and candidates.num_rows:
            lists = Lists(candidates.column("id").to_numpy(), _matrix(candidates, width))
            keys, ids, vectors = queries.column("key").to_numpy(), queries.column("id").to_numpy(), _matrix(queries, width).astype(np.float64)
            bars = queries.column("bar").cast(pa.float64()).fill_null(-np.inf).to_numpy()
            all_keys = candidates.column("key").to_numpy()
            order = np.argsort(all_keys)
            near = order[np.minimum(np.searchsorted(all_keys, keys, sorter=order), len(order) - 1)]
            own = np.where(all_keys[near] == keys, near, -1)
            for a in range(0, len(keys), chunk):
                some = slice(a, a + chunk)
                for key, id_, (rows, scores) in zip(keys[some], ids[some], lists.top(vectors[some], own[some], bars[some], k)):
                    for column, values in zip(found, (np.full(len(rows), key), np.full(len(rows), id_), lists.ids[rows], scores.astype(np.int64))):
                        column.append(values)
        joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in found]
        return pa.table([pa.array(x, pa.int64()) for x in joined], names=["key", "query_id", "vec_id", "score"])

    return run


def quantised(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component; null if the vector or one of its components is null or not finite."""
    wide = F.transform(embedding, lambda x: x.cast("double"))
    sound = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(embedding.isNotNull() & sound, F.transform(wide, lambda x: F.floor(x * F.lit(float(scale)))))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 4096, block_queries: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k highest integer inner products with all rows but itself, ties to the smaller id; all, if there are fewer than k.

    Rows are dealt into blocks of a bounded size by a hash of a number of their own, so equal rows are spread. Each query is first searched in one block; the score of its k-th best there is its bar in all
    others, where most of the lists then need not be read, or none of them. Every other pair of a block of queries and a block of rows is one task's work and
    yields at most k rows per query. What is shuffled grows as rows * queries * (1 / block_rows + 1 / block_queries) vectors: queries that are a share of the rows make this a
    quadratic search, as any exact one without an index is.

    Rows that repeat are rows of their own: a query that occurs twice gets its k results twice, each time with the other one among the candidates. Vectors that are null or hold null or non-finite
    components take no part, nor do rows with a null id; missing last components count as 0. An empty table gives no rows. Scores are exact below 2 ** 53.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where("id IS NOT NULL AND v IS NOT NULL")
    rows = materialise(rows.withColumn("n", F.size("v")).withColumn("key", F.monotonically_increasing_id()))
    size = rows.agg(F.count("*").alias("all"), F.count_if("q").alias("q")).first()
    many, asked = max(1, -(-size["all"] // block_rows)), max(1, -(-size["q"] // block_queries))
    block = lambda salt, n: F.pmod(F.xxhash64("key", F.lit(salt)), F.lit(n)).cast("int")
    candidates = rows.select(*(F.col(c).alias(c) for c in ("key", "id", "v", "n")), block(0, many).alias("rb"))
    queries = rows.where("q").select("key", "id", "v", "n", block(2, many).alias("home"))
    out = "key long, query_id long, vec_id long, score long"
    search = _block_search(k)
    first = materialise(queries.select("key", "id", "v", "n", F.lit(None).cast("long").alias("bar"), F.col("home").alias("rb")).groupBy("rb").cogroup(candidates.groupBy("rb")).applyInArrow(search, out))
    bars = first.groupBy("key").agg(F.when(F.count("*") >= k, F.min("score")).alias("bar"))
    asking = queries.join(bars, "key", "left").select("key", "id", "v", "n", "bar", block(1, asked).alias("qb"), F.explode(F.filter(F.sequence(F.lit(0), F.lit(many - 1)), lambda b: b != F.col("home"))).alias("rb"))
    asked_of = candidates.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(asked - 1))))
    rest = asking.groupBy("qb", "rb").cogroup(asked_of.groupBy("qb", "rb")).applyInArrow(search, out)
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc("vec_id"))
    return first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB: the rows of top_k() for ids divisible by 100, k = 10, from all inner products.
ORACLE = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT r, vec_id, unnest(v)::BIGINT AS x, generate_subscripts(v, 1) AS j FROM v),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score FROM x q JOIN x c ON q.j = c.j AND q.r <> c.r WHERE q.vec_id % 100 = 0 GROUP BY q.r, q.vec_id, c.r, c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 10
"""

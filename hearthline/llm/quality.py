"""Text quality from trusted positives and unlabelled text: a non-negative positive-unlabelled risk over additive features of form.

Every text becomes shares and averages of its bytes, words and repeats. A score is a sum of piecewise linear functions of these, so the squared loss needs only sums of products
of the functions' parts: over all rows (the unlabelled text) and over the trusted positives. Both risk and its non-negative correction are functions of these sums, which one pass over the whole
corpus gathers; the fit itself is small and exact. The class prior comes from the scores of all rows: where the positives are densest among them, the ratio of both shares bounds it from above.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.storage import discard, materialise
from hearthline.llm.words import SEPARATOR, shingle_hashes, slices, word_hashes, word_spans

#: Byte classes: a byte belongs to one of these.
CLASSES = ("lower", "upper", "digit", "space", "stop", "comma", "mark", "quote", "bracket", "bar", "symbol", "control", "wide")
_CLASS = np.full(256, CLASSES.index("wide"), np.uint8)
_CLASS[:32] = _CLASS[127] = CLASSES.index("control")
for _name, _bytes in (("space", b" \t\n\r\v\f"), ("lower", bytes(range(97, 123))), ("upper", bytes(range(65, 91))), ("digit", b"0123456789"), ("stop", b"."), ("comma", b",;:"), ("mark", b"!?"), ("quote", b"'\"`-"), ("bracket", b"()[]{}<>"), ("bar", b"|/\\_"), ("symbol", b"#$%&*+=@^~")):
    _CLASS[list(_bytes)] = CLASSES.index(_name)
_SIGN = np.isin(_CLASS, [CLASSES.index(c) for c in ("mark", "bracket", "bar", "symbol", "quote")])
_PLAIN = np.isin(_CLASS, [CLASSES.index(c) for c in ("lower", "upper", "digit", "wide")])

FEATURES = (
    *(f"{c} bytes" for c in CLASSES), "doubled signs", "words", "word bytes", "words ending in signs", "words of signs", "words after their like", "repeated words", "repeated triples", "repeated fives", "words a stop", "words a line",
)
#: Knots of the piecewise linear functions, over features brought to 0..1.
KNOTS = 10
WIDTH = 1 + len(FEATURES) * (KNOTS - 1)


def _repeats(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Per row, the share of values that stand in it before."""
    n = np.bincount(row, minlength=rows)
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    again = np.zeros(len(v), bool)
    again[1:] = (v[1:] == v[:-1]) & (r[1:] == r[:-1])
    return np.bincount(r[again], minlength=rows) / np.maximum(n, 1)


def features(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """FEATURES of every row, each from 0 to 1 (shares by their square root, sizes by their logarithm); a null or empty text has zeros only."""
    out = [np.zeros((0, len(FEATURES)), np.float32)]
    for _, _, data, offsets in slices(batch, column):
        n = len(offsets) - 1
        row = np.repeat(np.arange(n), np.diff(offsets))
        size = np.maximum(np.diff(offsets), 1)
        kinds = _CLASS[data]
        shares = np.bincount(row * len(CLASSES) + kinds, minlength=n * len(CLASSES)).reshape(n, -1) / size[:, None]
        same = (data[1:] == data[:-1]) & _SIGN[data[1:]] & (row[1:] == row[:-1]) if len(data) else np.zeros(0, bool)
        doubled = np.bincount(row[1:][same], minlength=n) / size
        starts, ends, bounds = word_spans(data, offsets)
        words = np.diff(bounds)
        some = np.maximum(words, 1)
        of = np.repeat(np.arange(n), words)
        share = lambda what: np.bincount(of[what], minlength=n) / some
        sign_end = _SIGN[data[ends - 1]] if len(starts) else np.zeros(0, bool)
        plain = np.concatenate([[0], np.cumsum(_PLAIN[data])])
        bare = plain[ends] == plain[starts]
        h = word_hashes(data, starts, ends)
        like = np.zeros(len(h), bool)
        like[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
        grams = [_repeats(*shingle_hashes(h, bounds, k), n) for k in (3, 5)]
        count = lambda byte: np.bincount(row[data == byte], minlength=n)
        sized = lambda x, most: np.log1p(x) / np.log1p(most)
        columns = [
            *np.sqrt(shares).T, np.sqrt(doubled), sized(words, 1e5), sized(np.bincount(of, ends - starts, n) / some, 100), np.sqrt(share(sign_end)), np.sqrt(share(bare)), np.sqrt(share(like)),
            np.sqrt(_repeats(h, of, n)), *map(np.sqrt, grams), sized(words / (1 + count(46)), 1e4), sized(words / (1 + count(10)), 1e5),
        ]
        made = np.clip(np.column_stack(columns), 0, 1)
        made[np.diff(offsets) == 0] = 0
        out.append(made.astype(np.float32))
    return np.concatenate(out)


def parts(x: np.ndarray) -> np.ndarray:
    """1 and, per feature, the weights of its knots but the first: a feature between two knots is shared out between them."""
    at = np.clip(x.astype(np.float64), 0, 1) * (KNOTS - 1)
    hats = np.maximum(0, 1 - np.abs(at[:, :, None] - np.arange(1, KNOTS)))
    return np.concatenate([np.ones((len(x), 1)), hats.reshape(len(x), -1)], axis=1)


@dataclass(frozen=True)
class Sums:
    """Means of the parts and of their products, over all rows and over the positives, and how many rows these are."""

    n: float
    n_positive: float
    mean: np.ndarray
    products: np.ndarray
    positive_mean: np.ndarray
    positive_products: np.ndarray


def fit(sums: Sums, prior: float, ridge: float = 1e-4) -> np.ndarray:
    """Weights of least non-negative risk: prior * E+[(f - 1)^2] + max(0, E[(f + 1)^2] - prior * E+[(f + 1)^2]) + ridge * |w|^2.

    max(0, r) is the most of t * r for t from 0 to 1, and the risk with t * r in its place is convex in the weights: its least weights solve linear equations. At t = 1
    it is the unbiased risk; if r is negative there, r is 0 at the t looked for, or t is 0; r falls as t grows, so halving finds it.
    """
    g, gp, m, mp = sums.products, sums.positive_products, sums.mean, sums.positive_mean
    penalty = ridge * np.eye(len(m))

    def least(t: float) -> np.ndarray:
        return np.linalg.solve(prior * (1 - t) * gp + t * g + penalty, prior * (1 + t) * mp - t * m)

    def negative(w: np.ndarray) -> float:
        return w @ g @ w + 2 * m @ w + 1 - prior * (w @ gp @ w + 2 * mp @ w + 1)

    low, high = 0.0, 1.0
    if negative(least(high)) >= 0:
        return least(high)
    if negative(least(low)) <= 0:
        return least(low)
    for _ in range(40):
        middle = (low + high) / 2
        low, high = (middle, high) if negative(least(middle)) > 0 else (low, middle)
    return least(low)


def prior_from_scores(positive: np.ndarray, everything: np.ndarray, sure: float = 0.01) -> float:
    """A class prior from counts by score bin (ascending), of positives and of all rows.

    From the highest scores down, the share of all rows over the share of positives is the prior plus what else stands there: its least upper
    confidence bound (each share off by at most sqrt(log(4 / sure) / 2n)) names the cut, and the ratio there is the prior.
    """
    n, u = positive.sum(), everything.sum()
    if not n or not u:
        return 0.5
    p, q = np.cumsum(positive[::-1]) / n, np.cumsum(everything[::-1]) / u
    off = [np.sqrt(np.log(4 / sure) / 2 / k) for k in (n, u)]
    use = p > 0
    bound = (q[use] + off[1] + off[0]) / p[use]
    at = int(np.argmin(bound))
    return float(np.clip(q[use][at] / p[use][at], 0.01, 0.99))


BINS = 1000


def _score(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(f + 1) / 2 between 0 and 1: for the squared loss, the probability of a positive."""
    return np.clip((parts(x) @ weights + 1) / 2, 0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, len(FEATURES))


def _gather(table: DataFrame) -> Sums:
    """The sums over all rows of a table (x, positive), summed in every task and then by line of the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, WIDTH, WIDTH))
        for batch in batches:
            x, y = _matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            for k in range(0, len(x), 2000):
                p, of = parts(x[k : k + 2000]), y[k : k + 2000]
                sums[0] += p.T @ p
                sums[1] += p[of].T @ p[of]
        lines = sums.reshape(-1, WIDTH)
        used = np.flatnonzero(np.any(lines != 0, axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(list(lines[used]), pa.list_(pa.float64()))], names=["line", "v"])

    # 2 * WIDTH rows, whatever the corpus
    rows = table.select("x", "positive").mapInArrow(run, "line int, v array<double>").groupBy("line").agg(*(F.sum(F.get("v", F.lit(j))).alias(f"v{j}") for j in range(WIDTH))).collect()
    sums = np.zeros((2 * WIDTH, WIDTH))
    for r in rows:
        sums[r["line"]] = r[1:]
    whole, of = sums.reshape(2, WIDTH, WIDTH)
    n, k = whole[0, 0], of[0, 0]
    return Sums(n, k, whole[0] / max(n, 1), whole / max(n, 1), of[0] / max(k, 1), of / max(k, 1))


def _by_score(table: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BINS), np.int64)
        for batch in batches:
            x, y = _matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            at = np.minimum((_score(x, weights) * BINS).astype(int), BINS - 1)
            counts += np.stack([np.bincount(at[y], minlength=BINS), np.bincount(at, minlength=BINS)])
        yield pa.RecordBatch.from_arrays([pa.array(range(BINS), pa.int32()), *map(pa.array, counts)], names=["bin", "positive", "every"])

    out = np.zeros((2, BINS))
    for r in table.select("x", "positive").mapInArrow(run, "bin int, positive long, every long").groupBy("bin").agg(F.sum("positive"), F.sum("every")).collect():
        out[:, r[0]] = r[1:]
    return out[0], out[1]


def held_out(id_col: str):
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def learn(table: DataFrame, rounds: int = 3) -> tuple[np.ndarray, float]:
    """Weights and class prior from a table (x, positive): fits to a first prior of a half, then to the prior that the scores of the last fit show."""
    sums, prior = _gather(table), 0.5
    if not sums.n_positive:
        weights = np.zeros(WIDTH)
        weights[0] = -1.0
        return weights, 0.0
    for _ in range(rounds):
        weights = fit(sums, prior)
        prior = prior_from_scores(*_by_score(table, weights))
    return fit(sums, prior), prior


def classify(docs: DataFrame, labels: DataFrame, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score (0 to 1) and predicted (1 if score >= cut, else 0) per row of docs.

    Positives are the documents that labels (doc_id, quality) call 1, those held out aside; no label 0 is used. All texts are unlabelled text, in whole. An id
    with labels of both kinds is no positive. Null and empty texts are scored by features of nothing; rows that repeat give rows that repeat; a null id is carried along, is not held out and has no label. Without positives
    every score is 0; no documents give no rows; other columns are not read. Long texts need memory in proportion to their words.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch, "text")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "x"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_score(_matrix(batch.column(2)), weights))], names=["id", "held_out", "score"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    made = materialise(slim.mapInArrow(extract, f"id {kind}, x binary"))
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out("doc_id")).groupBy(F.col("doc_id").alias("of")).agg(F.min("quality").alias("q")).where("q > 0").select("of")
    table = materialise(made.join(known, F.col("id") == F.col("of"), "left").select("id", held_out("id").alias("held_out"), "x", F.col("of").isNotNull().alias("positive")), drop=made)
    weights, _ = learn(table)
    out = materialise(table.select("id", "held_out", "x").mapInArrow(score, f"id {kind}, held_out boolean, score double"), drop=table)
    return out.select(F.col("id").alias(id_col), "held_out", "score", F.when(F.col("score") >= cut, 1).otherwise(0).alias("predicted"))

"""Benchmark decontamination by greedy string tiling of documents and benchmark items."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.storage import free_name
from hearthline.llm.words import LOWER, SEPARATOR, shingle_hashes, slices, word_hashes, word_spans

#: Bytes after A-Z are lower-cased and ASCII punctuation made space.
PLAIN = LOWER.copy()
PLAIN[[b for b in range(33, 127) if not chr(b).isalnum()]] = 32
assert SEPARATOR[32]
#: Benchmarks up to so many words (8 bytes each) go to every task; larger ones are joined.
MOST_WORDS = 2_000_000
PRIME = (1 << 61) - 1


def tiles(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in item, place in text, length) of matches of at least ``least`` tokens, the longest first, none overlapping another in either.

    Each pass looks for the longest matches of unmarked tokens: Karp-Rabin hashes of all unmarked runs of s tokens of the
    item, rolled over those of the text, and every hit compared and extended. A match that another one cuts
    counts with what is left of it. s falls to ``least``. Of equal lengths the first in the item goes first, then the first in the text.
    """
    a, b = item.tolist(), text.tolist()
    used_a, used_b = [False] * len(a), [False] * len(b)
    out: list[tuple[int, int, int]] = []

    def runs(x: list[int], used: list[bool], s: int) -> Iterator[tuple[int, int]]:
        top, h, free = pow(1_000_003, s - 1, PRIME), 0, 0
        for i, v in enumerate(x):
            if used[i]:
                h = free = 0
                continue
            if free >= s:
                h = (h - x[i - s] * top) % PRIME
            h = (h * 1_000_003 + v) % PRIME
            free += 1
            if free >= s:
                yield h, i - s + 1

    s = max(least, min(len(a), len(b), 20))
    while len(a) >= least and len(b) >= least:
        where: dict[int, list[int]] = {}
        for h, i in runs(a, used_a, s):
            where.setdefault(h, []).append(i)
        found: dict[int, list[tuple[int, int]]] = {}
        longest = 0
        for h, j in runs(b, used_b, s) if where else ():
            for i in where.get(h, ()):
                if i and j and a[i - 1] == b[j - 1] and not used_a[i - 1] and not used_b[j - 1]:
                    continue  # part of a match found from its start
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not used_a[i + k] and not used_b[j + k]:
                    k += 1
                if k >= s:
                    found.setdefault(k, []).append((i, j))
                    longest = max(longest, k)
        if longest > 2 * s:
            s = longest
            continue
        # what is left free of a match that another one cut waits for its turn by length
        waiting = [(-k, i, j) for k, places in found.items() for i, j in places]
        heapify(waiting)
        while waiting:
            k, i, j = heappop(waiting)
            k = -k
            free = [not (x or y) for x, y in zip(used_a[i : i + k], used_b[j : j + k])]
            if all(free):
                used_a[i : i + k] = used_b[j : j + k] = [True] * k
                out.append((i, j, k))
                continue
            start = 0
            for n, f in enumerate([*free, False]):
                if not f:
                    if n - start >= s:
                        heappush(waiting, (start - n, i + start, j + start))
                    start = n + 1
        if s == least:
            break
        s = max(least, s // 2)
    return out


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = PLAIN[data]
    starts, ends, bounds = word_spans(data, offsets)
    return word_hashes(data, starts, ends), bounds


def _near(text: np.ndarray, hits: np.ndarray, reach: int) -> np.ndarray:
    """The tokens of text within reach of a hit; a stretch left out becomes a token that equals no other. A tile holds a hit, so none is lost."""
    mark = np.zeros(len(text) + 1, np.int64)
    np.add.at(mark, np.maximum(hits - reach, 0), 1)
    np.add.at(mark, np.minimum(hits + reach, len(text)), -1)
    keep = np.cumsum(mark[:-1]) > 0
    if keep.all():
        return text
    first = np.flatnonzero(~keep & np.concatenate([[True], keep[:-1]]))
    out = text.copy()
    out[first] = np.uint64(0)
    keep[first] = True
    return out[keep]


def _covered(item: np.ndarray, text: np.ndarray, hits: np.ndarray, least: int) -> int:
    return sum(k for _, _, k in tiles(item, _near(text, hits, len(item)), least))


OUT = "n_tokens int, covered int, coverage double"


class _Bench:
    """Benchmark items with an index from the hash of each run of ``least`` tokens to the items that have it."""

    def __init__(self, ids: list, tokens: list[np.ndarray], least: int, cover: float):
        self.ids, self.tokens, self.least, self.cover = ids, tokens, least, cover
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
        seeds, item = shingle_hashes(np.concatenate(tokens) if tokens else np.zeros(0, np.uint64), bounds, least)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.item = seeds[order], item[order]

    def search(self, text: np.ndarray, seeds: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
        """Items covered to the threshold, and how many of their tokens are; ``seeds`` at ``at`` are the text's runs that some item has."""
        low, high = np.searchsorted(self.seeds, seeds, "left"), np.searchsorted(self.seeds, seeds, "right")
        many = high - low
        which = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        items, place = self.item[which], np.repeat(at, many)
        for i in np.unique(items).tolist():
            hits = place[items == i]
            tokens = self.tokens[i]
            # tiles of least or more tokens that cover the threshold hold so many runs of the item
            if len(np.unique(which[items == i])) * self.least >= self.cover * len(tokens):
                n = _covered(tokens, text, hits, self.least)
                if n >= self.cover * len(tokens):
                    yield i, n


def _search(bench: "_Bench", kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, items, covered = [], [], []
            for a, b, data, offsets in slices(batch, "text"):
                words, bounds = _tokens(data, offsets)
                seeds, row = shingle_hashes(words, bounds, bench.least)
                at = np.searchsorted(bench.seeds, seeds)
                hit = np.flatnonzero(bench.seeds[np.minimum(at, len(bench.seeds) - 1)] == seeds) if len(bench.seeds) else at[:0]
                # the k-th run of a row starts at its k-th word
                per = np.maximum(np.diff(bounds) - bench.least + 1, 0)
                first = np.concatenate([[0], np.cumsum(per)])
                for r in np.unique(row[hit]).tolist():
                    own = hit[row[hit] == r]
                    for i, n in bench.search(words[bounds[r] : bounds[r + 1]], seeds[own], own - first[r]):
                        rows.append(a + r), items.append(i), covered.append(n)
            sizes = [len(bench.tokens[i]) for i in items]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array([bench.ids[i] for i in items], kind), pa.array(sizes, pa.int32()), pa.array(covered, pa.int32()), pa.array([n / m for n, m in zip(covered, sizes)], pa.float64())],
                names=["id", "item", "n_tokens", "covered", "coverage"],
            )

    return run


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in slices(batch, "text"):
            words, bounds = _tokens(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(words.view(np.int64)))], names=["id", "tokens"])


def _seeds(least: int):
    """The distinct runs of each text, and at how many places each stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch, "text"):
                words, bounds = _tokens(data, offsets)
                seeds, row = shingle_hashes(words, bounds, least)
                both, places = np.unique(np.rec.fromarrays([row, seeds], names="row,seed"), return_counts=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(both["row"])), pa.array(both["seed"].view(np.int64)), pa.array(places, pa.int64())], names=["key", "seed", "places"])

    return run


def _tile_pairs(least: int, cover: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_tokens, covered = [], []
            for text, item in zip(batch.column(2), batch.column(3)):
                t, i = (np.array(x.as_py(), np.int64).view(np.uint64) for x in (text, item))
                known = shingle_hashes(i, np.array([0, len(i)]), least)[0]
                hits = np.flatnonzero(np.isin(shingle_hashes(t, np.array([0, len(t)]), least)[0], known))
                n_tokens.append(len(i))
                covered.append(_covered(i, t, hits, least))
            keep = pa.array([n >= cover * m for n, m in zip(covered, n_tokens)], pa.bool_())
            share = pa.array([n / m for n, m in zip(covered, n_tokens)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_tokens, pa.int32()), pa.array(covered, pa.int32()), share], names=["id", "item", "n_tokens", "covered", "coverage"]).filter(keep)

    return run


def _small(benchmark: DataFrame, cover: float, least: int, item_col: str, most_words: int) -> _Bench | None:
    """The benchmark (item_col, text) with its index, if it holds no more than most_words words."""
    items = benchmark.select(F.col(item_col).alias("id"), F.col("text").cast("string").alias("text"))
    if items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] / 2 > most_words:
        return None
    table = items.mapInArrow(_tokenise, f"id {items.schema['id'].dataType.simpleString()}, tokens array<long>").where(F.size("tokens") >= least).toArrow()
    bench = _Bench(table.column("id").to_pylist(), [np.array(t, np.int64).view(np.uint64) for t in table.column("tokens").to_pylist()], least, cover)
    bench.kind = table.schema.field("id").type
    return bench


def overlaps(docs: DataFrame, benchmark: DataFrame, cover: float = 0.5, least: int = 4, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """id, item, n_tokens, covered and coverage for each document and benchmark item whose greedy tiles of at least
    ``least`` tokens cover ``cover`` or more of the item's tokens.

    Tokens are words in lower case (A-Z), parted at white space and ASCII punctuation. Tiles may stand in any order, so reordered
    passages count. A document and an item meet if they share a run of ``least`` tokens. A benchmark of up to most_words words is sent to
    every task; a larger one is joined to the documents by the hash of the run. Null or empty texts and items of fewer
    than ``least`` tokens overlap with nothing; rows that repeat give rows that repeat; a null id is carried along. An empty table on either side gives no rows; a long text is
    searched in whole, in one task.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind, item_kind = (x.schema["id"].dataType.simpleString() for x in (slim, items))
    out = f"id {kind}, item {item_kind}, {OUT}"
    if bench := _small(benchmark, cover, least, item_col, most_words):
        found = slim.mapInArrow(_search(bench, bench.kind), out)
    else:
        # keys of id and text are never null; where two rows share one, a pair more is compared
        key = F.xxhash64("id", "text").alias("key")
        tokens = lambda df, k: df.select(F.struct(key, "id").alias("id"), "text").mapInArrow(_tokenise, f"id struct<key:bigint,id:{k}>, tokens array<long>").select("id.key", "id.id", "tokens")
        seeds = lambda df: df.select(key, "text").mapInArrow(_seeds(least), "key long, seed long, places long")
        item_seeds = seeds(items).withColumnRenamed("key", "item_key")
        pairs = seeds(slim).drop("places").join(item_seeds, "seed").groupBy("key", "item_key").agg(F.sum("places").alias("hits"))
        sized = tokens(items, item_kind).where(F.size("tokens") >= least).withColumnsRenamed({"key": "item_key", "id": "item", "tokens": "item_tokens"})
        # tiles that cover the threshold hold so many runs of the item, each place of a run counted
        wanted = pairs.join(sized, "item_key").where(F.col("hits") * least >= cover * F.size("item_tokens"))
        found = wanted.join(tokens(slim, kind), "key").select("id", "item", "tokens", "item_tokens").mapInArrow(_tile_pairs(least, cover), out)
    return found.withColumnsRenamed({"id": id_col, "item": item_col})


def clean(docs: DataFrame, benchmark: DataFrame, cover: float = 0.5, least: int = 4, text_col: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """The rows of docs, whatever their ids, of which overlaps() finds no item covered. A benchmark that goes to every task filters in the pass that reads the rows; by a larger one, texts are found by digest.

    Null and empty texts stay, as do rows that repeat, all or none of them; all columns of docs are returned, whatever their names; no documents give no rows, and an empty benchmark takes none away. Long
    texts are read in whole, with memory in proportion to their words.
    """
    text, bench = F.col(text_col).cast("string"), _small(benchmark, cover, least, "text", most_words)
    if bench is None:
        key, of = F.sha2(text, 256), free_name(docs, "of")
        found = overlaps(docs.select(key.alias("key"), text.alias("text")), benchmark, cover, least, id_col="key", most_words=most_words).select(F.col("key").alias(of)).distinct()
        return docs.join(found, key == F.col(of), "left_anti")
    search = _search(bench, bench.kind)

    @F.pandas_udf("boolean")
    def covered(texts: pd.Series) -> pd.Series:
        rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string(), from_pandas=True)], names=["id", "text"])
        out = np.zeros(len(texts), bool)
        for batch in search(iter([rows])):
            out[batch.column(0).to_numpy()] = True
        return pd.Series(out)

    return docs.where(~covered(text))

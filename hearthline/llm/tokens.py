"""Token counts of byte-level byte-pair encodings: merges on a linked list, lowest rank first from a heap."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how byte-level encodings of this family part a text.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A cache of counts is emptied when it holds so many entries; it changes speed alone.
CACHED = 400_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in such vocabularies: itself if printable in Latin-1, else 256 and up in turn."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left when the lowest-ranked adjacent pair (the leftmost of equal ones) has been merged again and again."""
    n = len(symbols)
    if n < 2:
        return n
    symbols = symbols[:]
    after = [*range(1, n), -1]
    before = [*range(-1, n - 1)]
    heap = [(rank, i) for i, pair in enumerate(zip(symbols, symbols[1:])) if (rank := ranks.get(pair)) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if j < 0 or ranks.get((symbols[i], symbols[j])) != rank:
            continue  # one of the two was merged meanwhile
        symbols[i] += symbols[j]
        symbols[j] = ""
        merges += 1
        after[i] = k = after[j]
        after[j] = -1
        if k >= 0:
            before[k] = i
            if (rank := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (rank, i))
        if (h := before[i]) >= 0 and (rank := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (rank, h))
    return n - merges


class Counter:
    """Counts tokens of texts. ``vocabulary``: the path of a tokenizer file with byte-level BPE merges."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(spec["model"]["merges"])}
        self.special = [t["content"] for t in spec.get("added_tokens") or ()]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces = regex.compile(PIECES)
        self.odd_space = regex.compile(r" (?:\s|\Z)")
        self.letters = byte_letters()
        self.by_piece: dict[str, int] = {}
        self.by_run: dict[str, int] = {}

    def piece(self, piece: str) -> int:
        n = self.by_piece.get(piece)
        if n is None:
            n = merged_length([self.letters[b] for b in piece.encode()], self.ranks)
            if len(piece) <= 40:
                if len(self.by_piece) >= CACHED:
                    self.by_piece.clear()
                self.by_piece[piece] = n
        return n

    def run(self, run: str) -> int:
        n = sum(map(self.piece, self.pieces.findall(run)))
        if len(run) <= 40:
            if len(self.by_run) >= CACHED:
                self.by_run.clear()
            self.by_run[run] = n
        return n

    def plain(self, text: str) -> int:
        if not text:
            return 0
        if self.odd_space.search(text):
            return sum(map(self.piece, self.pieces.findall(text)))
        # No piece crosses a space before a non-space, so runs between such spaces count by themselves.
        runs = text.split(" ")
        known = self.by_run
        total = 0
        for i, run in enumerate(runs):
            if i:
                run = " " + run
            n = known.get(run)
            total += self.run(run) if n is None and run else n or 0
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.cut is None or not any(s in text for s in self.special):
            return self.plain(text)
        parts = self.cut.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Per row of docs: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Special strings inside a text count as their one token; none are added, and texts are neither cut nor padded. A null text is empty: 0 bytes, 0 tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or Counter(vocabulary)
            text = batch.column(1)
            for a in range(0, max(len(text), 1), 256):
                part = text.slice(a, 256)
                n = pa.array([counter.count(t.as_py()) for t in part], pa.int64())
                size = pc.fill_null(pc.binary_length(part), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 256), size, n, pc.greater(n, limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)

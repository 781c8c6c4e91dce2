"""Removal of repeated passages by recompression: Spark rounds name runs and pairs for the whole corpus, and symbols that stand alone rule windows out.

The corpus is cut into slices of some megabytes, whole documents each. In every round, each slice proposes what to replace: every maximal run of one symbol, and every
adjacent pair of a left and a right symbol outside of runs, the two parted by a hashed bit of the name. A proposal's name follows from the names of its
parts, so all slices propose the same name for the same run or pair. The proposals of all slices are grouped; one made at two or more places
gets its name, one made at a single place stays nameless. The slices then replace their symbols, and the next round follows. Equal stretches of text thus
get equal symbols everywhere but at their ends, where a neighbour outside may take part; how far the ends reach follows from the window's own symbols (a round may
cost the first and the last run, and a neighbour that would pair with a single one of these).

A window with a nameless inner symbol occurs once and is out, and symbols inside no window left take no further part. The windows left after the last round
are compared by digests of their words: two windows are the same if all of these are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.storage import discard, materialise, spread_key
from hearthline.llm.words import M1, M2, M3, SEPARATOR, U, mix, slices, word_hashes, word_spans

#: Rounds of naming.
ROUNDS = 3
#: Bytes of text in a slice; a longer document is a slice of its own. An executor holds some slices at a time, each in Python, in Arrow buffers and as a row.
SLICE = 2 << 20
#: Words whose bytes are compared at once.
COMPARED = 1 << 16


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until they hold ``most`` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def inner_windows(bounds: np.ndarray, width: int) -> np.ndarray:
    """Starts of the windows that lie within one row."""
    many = np.maximum(np.diff(bounds) - width + 1, 0)
    first = np.concatenate([[0], np.cumsum(many)])
    return np.repeat(bounds[:-1] - first[:-1], many) + np.arange(first[-1])


def distinct_words(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every word the number of its distinct word, and for these a place where it stands: by hashes, compared byte for byte."""
    _, first, local = np.unique(word_hashes(data, begins, ends), return_index=True, return_inverse=True)
    like, size = first[local], ends - begins
    if (size == size[like]).all():

        def equal(a: int) -> bool:
            b = min(a + COMPARED, len(begins))
            at = begins[a] + np.flatnonzero(~SEPARATOR[data[begins[a] : ends[b - 1]]])
            return (data[at] == data[at + np.repeat(begins[like[a:b]] - begins[a:b], size[a:b])]).all()

        if all(equal(a) for a in range(0, len(begins), COMPARED)):
            return local, first
    raw, place = data.tobytes(), {}
    local = np.array([place.setdefault(raw[s:e], len(place)) for s, e in zip(begins.tolist(), ends.tolist())], np.int64)
    return local, np.unique(local, return_index=True)[1]


def _squeeze(x: np.ndarray) -> bytes:
    """Numbers, compressed by their first bytes, second bytes and so on: rows are this small in the JVM and in its shuffle, not only in files."""
    if not len(x):
        return b""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unsqueeze(b: bytes, kind: type) -> np.ndarray:
    if not b:
        return np.zeros(0, kind)
    n, size = int.from_bytes(b[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(memoryview(b)[8:], n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def _pack(x: np.ndarray) -> bytes:
    """Rising numbers, as their steps."""
    return _squeeze(np.diff(x, prepend=0).astype(np.int32))


def _unpack(b: bytes) -> np.ndarray:
    return np.cumsum(_unsqueeze(b, np.int32), dtype=np.int64)


def _pack_names(table: np.ndarray, local: np.ndarray) -> tuple[bytes, bytes]:
    """Names table[local] as the distinct ones, those that stand most often first, and which of these stands at every place."""
    order = np.lexsort((table, -np.bincount(local, minlength=len(table))))
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    return _squeeze(np.diff(table[order], prepend=U(0))), _squeeze(rank[local])


def _unpack_names(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(_unsqueeze(row["table"], np.uint64), dtype=np.uint64), _unsqueeze(row["local"], np.int32)


def _made(s: "Symbols") -> pa.ListArray:
    """What s proposes. The lowest bit, which is set in every name, says whether it stands at two or more places."""
    return pa.ListArray.from_arrays([0, len(s.proposed)], pa.array((s.proposed ^ (~s.multi).astype(np.uint64)).view(np.int64)))


def _parse(width: int):
    """One row per slice: its documents' ids, numbers of words and digests, the names of its distinct words, which of these stands at every place, and what the first round proposes.

    A word's name is 64 bits of its digest; a document's digest is 128 bits of SHA-256 over its words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for batch in gathered(batches, SLICE):
            for a, b, data, offsets in slices(batch, "text", SLICE):
                begins, ends, bounds = word_spans(data, offsets)
                local, first = distinct_words(data, begins, ends)
                raw = data.tobytes()
                digests = np.frombuffer(b"".join(hashlib.sha256(b" ".join(raw[s:e].split())).digest()[:16] for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())), np.int64)
                table = np.frombuffer(b"".join([hashlib.blake2b(raw[s:e], digest_size=8).digest() for s, e in zip(begins[first].tolist(), ends[first].tolist())]), np.uint64) | U(1)
                s = Symbols.of_slice(table, local, np.diff(bounds), width, [])
                s.propose(0)
                row = [
                    pa.array([part << 32 | k], pa.int64()), pa.ListArray.from_arrays([0, b - a], batch.column(0).slice(a, b - a)), *(pa.array([x.tolist()], pa.list_(pa.int64())) for x in (np.diff(bounds), digests[::2], digests[1::2])),
                    *(pa.array([x], pa.binary()) for x in _pack_names(table, local)), _made(s),
                ]
                yield pa.RecordBatch.from_arrays(row, names=["slice", "ids", "n", "f1", "f2", "table", "local", "made"])
                k += 1

    return run


def _left(name: np.ndarray, r: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(name ^ (U(r + 1) * M3)) >> U(63)).astype(bool)


class Symbols:
    """The symbols of a slice that stand inside windows not ruled out: names (0: nameless), where stretches of neighbours begin, and these windows with their first words and their first and last inner symbols (0 and -1: none)."""

    def __init__(self, name: np.ndarray, bounds: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.name, self.bounds, self.at, self.low, self.high = name, bounds, at, low, high

    @staticmethod
    def of_slice(table: np.ndarray, local: np.ndarray, n: np.ndarray, width: int, out: list[int] | np.ndarray) -> "Symbols":
        """All windows of documents of n words each but those in ``out``."""
        bounds = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        starts = inner_windows(bounds, width)
        if len(out):
            starts = starts[~np.isin(np.searchsorted(bounds, starts, "right") - 1, out)]
        s = Symbols(table[local], bounds, starts, starts, starts + width - 1)
        s.narrow()
        return s

    def narrow(self) -> None:
        """Leave symbols out that are inside no window."""
        n, inner = len(self.name), self.low <= self.high
        turn = np.bincount(self.low[inner], minlength=n + 1) - np.bincount(self.high[inner] + 1, minlength=n + 1)
        held = np.cumsum(turn[:n]) > 0
        edge = np.zeros(n + 1, bool)
        edge[self.bounds] = True
        edge[1:n] |= ~held[:-1]
        to = np.append(np.cumsum(held) - 1, 0)
        self.name, self.bounds = self.name[held], np.flatnonzero(edge[:n][held])
        self.low, self.high = np.where(inner, to[self.low], 0), np.where(inner, to[self.high], -1)

    def propose(self, r: int) -> None:
        """Find what round r replaces: ``proposed`` are the distinct names of its runs and pairs, ``multi`` says which stand at two or more places."""
        name, n = self.name, len(self.name)
        edge = np.zeros(n + 1, bool)
        edge[self.bounds] = True
        meet = (name[1:] > 0) & (name[:-1] > 0) & ~edge[1:n]
        runs, self.joins, self.left = np.zeros(n + 1, bool), np.zeros(n, bool), _left(name, r)
        runs[1:n] = meet & (name[1:] == name[:-1])  # whether the symbol repeats the one before it
        single = ~(runs[:-1] | runs[1:])
        self.joins[1:] = runs[1:n] | meet & self.left[:-1] & ~self.left[1:] & single[1:] & single[:-1]
        self.keep = np.flatnonzero(~self.joins)
        count = np.diff(np.append(self.keep, n))
        self.which = np.flatnonzero(count > 1)
        at = self.keep[self.which]
        with np.errstate(over="ignore"):
            pair = mix(mix(name[at] * M2) + name[np.minimum(at + 1, n - 1)])
            run = mix(mix(name[at] * M1) + count[self.which].astype(np.uint64))
        self.made = np.where(single[at], pair, run) | U(1)
        self.proposed, self.inverse, places = np.unique(self.made, return_inverse=True, return_counts=True)
        self.multi = places > 1

    def replace(self, given: np.ndarray) -> None:
        """Replace what propose() found, by its name if that is among the ``given`` ones, and rule out windows with a nameless inner symbol."""
        named = np.zeros(len(self.proposed), bool)
        named[given] = True
        to = np.cumsum(~self.joins) - 1
        name = self.name[self.keep]
        name[self.which] = np.where(named[self.inverse], self.made, U(0))
        inner = self.low <= self.high
        low, high = self.low[inner], self.high[inner]
        # past the first run; and past the neighbour of a single first symbol if both pair, unless an equal symbol outside makes that one a run. So at the end
        left, after = self.left, np.append(to, [len(name)] * 2)
        low, high = (
            np.where(left[low] & ~left[np.minimum(low + 1, len(left) - 1)], after[low + 2], to[low] + 1),
            np.where(left[np.maximum(high - 1, 0)] & ~left[high], np.where(high > 1, to[np.maximum(high - 2, 0)], -1), to[high] - 1),
        )
        fine = low <= high
        self.low, self.high = np.zeros(len(inner), np.int64), np.full(len(inner), -1)
        place = np.flatnonzero(inner)[fine]
        self.low[place], self.high[place] = low[fine], high[fine]
        nameless = np.concatenate([[0], np.cumsum(name == 0)])
        alive = nameless[self.high + 1] == nameless[self.low]
        self.name, self.bounds, self.at, self.low, self.high = name, np.append(to, len(name))[self.bounds], self.at[alive], self.low[alive], self.high[alive]
        self.narrow()

    def row(self, slice_: int) -> pa.RecordBatch:
        binary = [pa.array([x], pa.binary()) for x in (*_pack_names(*np.unique(self.name, return_inverse=True)), *map(_pack, (self.bounds, self.at, self.low, self.high)))]
        return pa.RecordBatch.from_arrays([pa.array([slice_], pa.int64()), *binary, _made(self)], names=["slice", "table", "local", "bounds", "at", "low", "high", "made"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One slice at a time; a null list is empty."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(c).slice(i, 1) for c, n in enumerate(batch.schema.names)}
            yield {n: (x.flatten() if n == "ids" else x.flatten().to_numpy(zero_copy_only=False)) if pa.types.is_list(x.type) else x[0].as_py() for n, x in row.items()}


def _round(r: int, width: int):
    """The symbols after round r, with what round r + 1 proposes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            table, local = _unpack_names(row)
            if r:
                s = Symbols(table[local], *(_unpack(row[c]) for c in ("bounds", "at", "low", "high")))
            else:
                s = Symbols.of_slice(table, local, row["n"], width, [])
            s.propose(r)
            if not r and len(row["copies"]):
                bounds = np.concatenate([[0], np.cumsum(row["n"])])
                keep = ~np.isin(np.searchsorted(bounds, s.at, "right") - 1, row["copies"])
                s.at, s.low, s.high = s.at[keep], s.low[keep], s.high[keep]
            s.replace(row["given"].astype(np.int64))
            s.propose(r + 1)
            yield s.row(row["slice"])

    return run


def _window_rows(width: int):
    """The windows left: 96 bits of a digest of their words' names, id, first word, and whether the document has the window before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            at, bounds = _unpack(row["at"]), np.concatenate([[0], np.cumsum(row["n"])])
            table, local = _unpack_names(row)
            words = table[local].tobytes()
            hashed = [b"".join([hashlib.blake2b(words[p : p + 8 * width], digest_size=12).digest() for p in (8 * at[a : a + 100_000]).tolist()]) for a in range(0, len(at), 100_000)]
            digest = np.frombuffer(b"".join(hashed), np.dtype([("h1", "<i8"), ("h2", "<i4")]))
            doc = np.searchsorted(bounds, at, "right") - 1
            order = np.lexsort((at, digest["h2"], digest["h1"], doc))
            again = np.zeros(len(order), bool)
            again[order[1:]] = np.logical_and.reduce([x[order[1:]] == x[order[:-1]] for x in (digest["h1"], digest["h2"], doc)])
            columns = [pa.array(digest["h1"].copy()), pa.array(digest["h2"].copy()), row["ids"].take(pa.array(doc)), pa.array((at - bounds[doc]).astype(np.int32)), pa.array(again)]
            yield pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "id", "at", "again"])

    return run


def _keep(width: int):
    """Per document, what is left when the words of the listed windows go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch, "text"):
                begins, ends, bounds = word_spans(data, offsets)
                lists = batch.column(batch.schema.get_field_index("starts")).slice(a, b - a)
                count = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                at, row = lists.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(b - a), count)
                n = np.diff(bounds)
                inside = at + width <= n[row]
                first = at[inside] + bounds[row[inside]]
                turn = np.zeros(len(begins) + 1, np.int64)
                np.add.at(turn, first, 1)
                np.add.at(turn, first + width, -1)
                gone = np.cumsum(turn[:-1]) > 0
                copy = batch.column(batch.schema.get_field_index("copy")).slice(a, b - a).to_numpy(zero_copy_only=False).astype(bool) & (n >= width)
                gone |= np.repeat(copy, n)
                kept, removed = [], []
                raw = data.tobytes()
                for r in range(b - a):
                    lo, hi = bounds[r], bounds[r + 1]
                    left = lo + np.flatnonzero(~gone[lo:hi])
                    removed.append(hi - lo - len(left))
                    kept.append(" ".join([raw[s:e].decode() for s, e in zip(begins[left].tolist(), ends[left].tolist())]) if removed[-1] else b" ".join(raw[offsets[r] : offsets[r + 1]].split()).decode())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(np.array(removed, np.int64)), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept"])

    return run


def named(proposals: DataFrame) -> DataFrame:
    """From proposals (slice, at, name, multi: 1 if the slice has it at two or more places, else 0) slice and given: the places ``at`` of those whose name is proposed at two or more places of the corpus.

    A name that very many slices propose is combined before the shuffle, and its rows of the join may be split.
    """
    places = proposals.groupBy(spread_key("name"), "name").agg(F.count("*").alias("slices"), F.max("multi").alias("multi"))
    names = materialise(places.where("slices > 1 OR multi > 0").select("name"))
    return materialise(proposals.select("slice", "at", "name").join(names, "name").groupBy("slice").agg(F.collect_list("at").alias("given")), drop=names)


def repeated_windows(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """From (id, text) two tables: windows (h1, h2, id, at, again: the document has it before) that no round ruled out, and copies (id): documents whose words are those of one with a smaller id, of which no window is listed."""
    kind = docs.schema["id"].dataType.simpleString()
    parsed = materialise(docs.mapInArrow(_parse(width), f"slice long, ids array<{kind}>, n array<long>, f1 array<long>, f2 array<long>, table binary, local binary, made array<long>"), wide=True)
    rows = parsed.select("slice", F.posexplode(F.arrays_zip("ids", "n", "f1", "f2")).alias("row", "d")).select("slice", "row", F.col("d.ids").alias("id"), "d.n", "d.f1", "d.f2").where("n > 0")
    first = rows.groupBy(spread_key("f1", "f2"), "f1", "f2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").select("f1", "f2", "first")
    copied = materialise(rows.select("slice", "row", "id", "f1", "f2").join(first, ["f1", "f2"]).where("id <> first").select("slice", "row", "id"))
    columns = "slice long, table binary, local binary, bounds binary, at binary, low binary, high binary, made array<long>"
    state = parsed
    for r in range(ROUNDS):
        given = named(state.select("slice", F.posexplode("made").alias("at", "m")).selectExpr("slice", "at", "m | 1 AS name", "m & 1 AS multi"))
        if r:
            beside = state.drop("made").join(given, "slice", "left")
        else:
            beside = parsed.select("slice", "n", "table", "local").join(given, "slice", "left").join(copied.groupBy("slice").agg(F.collect_list("row").alias("copies")), "slice", "left")
        state = materialise(beside.mapInArrow(_round(r, width), columns), drop=state if r else None, wide=True)
        discard(given)
    left = parsed.select("slice", "ids", "n", "table", "local").join(state.where(F.length("at") > 0).select("slice", "at"), "slice")
    windows = materialise(left.mapInArrow(_window_rows(width), f"h1 long, h2 int, id {kind}, at int, again boolean"))
    discard(parsed)
    discard(state)
    return windows, copied


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20) -> DataFrame:
    """Per row of docs: id, n_words, n_removed and kept, the words left, joined by one space.

    Words are maximal runs of other than space and 0x09-0x0D. A window is ``width`` consecutive words of one document; every word of a
    window whose words also start earlier (in a smaller id, or earlier in the same document) is removed, as judged on the input.

    Documents of equal words (by 128 bits of their SHA-256) are found first: all but the smallest id go as a whole if they hold a window, and only that one is compared with
    others. Null, empty or short texts keep their words. A row with a null id takes no part and keeps its words.
    Rows that repeat an id are one document; where their texts differ, a removed place is removed in each. An empty table gives no rows.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    windows, copied = repeated_windows(slim.where("id IS NOT NULL"), width)
    new = windows.where("NOT again").select("h1", "h2", "id", "at")
    earliest = new.groupBy(spread_key("h1", "h2"), "h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("h1", "h2", "first")
    later = new.join(earliest, ["h1", "h2"]).where("id > first").select("id", "at").unionByName(windows.where("again").select("id", "at"))
    later = later.groupBy("id").agg(F.collect_set("at").alias("starts"))
    copies = copied.select("id", F.lit(None).cast("array<int>").alias("starts")).distinct()
    later = materialise(later.join(copied.select("id"), "id", "left_anti").unionByName(copies))
    discard(windows)
    discard(copied)
    marked = slim.join(later.withColumn("copy", F.col("starts").isNull()), "id", "left").select("id", "text", "starts", F.coalesce("copy", F.lit(False)).alias("copy"))
    out = marked.mapInArrow(_keep(width), f"id {kind}, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("id", id_col)


#: DuckDB: the rows of remove_repeats() with its defaults, the kept words as their SHA-256.
ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w)),
later AS (SELECT doc_id, i FROM v QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS j FROM later, range(20) t(k)),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM w),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n FROM x ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""

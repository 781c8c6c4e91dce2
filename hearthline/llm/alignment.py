"""Two tokenizers aligned over a corpus: token groups between common byte ends, linked pairs of ids, and how many documents hold each pair.

Documents come in blocks. Per block, every pair of ids has a compressed bitmap of the documents that hold it linked (sorted 16-bit numbers where few, one bit a document where
many) and, over the documents of that bitmap, one bit plane for each binary digit of the number of links. Blocks share no documents, so the OR of a pair's
bitmaps has the sum of their set bits: that is the pair's count. The count, and whether it is the highest of its first id, then goes back along the
postings, block by block, and the planes say how many links of each document it stands for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.storage import discard, materialise, spread_key
from hearthline.llm.tokens import byte_letters

#: A block ends at so many bytes of text or documents; the numbers of its documents have 16 bits.
BLOCK_BYTES, BLOCK_DOCS = 6 << 20, 1 << 15
#: Groups of more links than this are expanded from distinct ids and their numbers.
LARGE = 1 << 16


def _sum_runs(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]]; empty runs give 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... of sizes[i] each, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum()), dtype=np.int64) + np.repeat(starts - before, sizes)


@dataclass
class Aligned:
    """Per segment: whether both tokenizers give its bytes back, tokens, groups and links, the groups as text, and its linked pairs with their numbers."""

    good: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    text: list[str]
    bounds: np.ndarray
    pairs: np.ndarray
    times: np.ndarray


class Aligner:
    """Tokenizer A (a tokenizers file with byte-level BPE) beside B (a sentencepiece model)."""

    def __init__(self, a_file: str, b_file: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        of = {letter: bytes([i]) for i, letter in enumerate(byte_letters())}
        entries = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [b"".join(of.get(c, c.encode()) for c in e) for e in entries]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        #: Where no piece has a space after another character, and none is normalised, words part at single spaces for both.
        self.by_words = not any("▁" in p.lstrip("▁") for p in pieces)
        self.shift = max(1, (len(pieces) - 1).bit_length())
        self.a_size, self.b_size = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        self.written = [f"{i}{end}" for n, ends in ((len(entries), ",|"), (len(pieces), ",;")) for i in range(n) for end in ends]

    def _ids(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [e.ids for k in range(0, len(segments), 10_000) for e in self.a.encode_batch_fast([" " + s for s in segments[k : k + 10_000]], add_special_tokens=False)]
        return a, self.b.encode(segments, num_threads=1)

    def align(self, segments: list[str]) -> Aligned:
        ids_a, ids_b = self._ids(segments)
        raw = [b" " + s.encode() for s in segments]
        flat = lambda x: np.fromiter((i for y in x for i in y), np.int64, sum(map(len, x)))
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (ids_a, ids_b))
        a, b = flat(ids_a), flat(ids_b)
        whole, size = b"".join(raw), np.fromiter(map(len, raw), np.int64, len(raw))
        good = np.ones(len(segments), bool)
        for ids, n, table, sizes, each in ((a, n_a, self.a_bytes, self.a_size, ids_a), (b, n_b, self.b_bytes, self.b_size, ids_b)):
            same = _sum_runs(sizes[ids], np.concatenate([[0], np.cumsum(n)])) == size
            if not same.all() or b"".join(map(table.__getitem__, ids.tolist())) != whole:
                same &= np.fromiter((b"".join(map(table.__getitem__, x)) == y for x, y in zip(each, raw)), bool, len(raw))
            good &= same
        if not good.all():
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            n_a, n_b, size = n_a * good, n_b * good, size * good
        end_a, end_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        in_a, in_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
        seg_ends = np.cumsum(size)
        group_bounds = np.concatenate([[0], np.searchsorted(common, seg_ends, "right")])
        n_links = _sum_runs(in_a * in_b, group_bounds)
        seg_of_group = np.repeat(np.arange(len(segments)), np.diff(group_bounds))
        first_b, first_a = np.cumsum(in_b) - in_b, np.cumsum(in_a) - in_a
        # links of usual groups, one by one
        usual = in_a * in_b <= LARGE
        times_of_a = np.where(usual[group_a], in_b[group_a], 0)
        left = np.repeat(np.arange(len(a)), times_of_a)
        pairs = (a[left] << self.shift) | b[_runs(first_b[group_a], times_of_a)]
        seg, times = seg_of_group[group_a[left]], np.ones(len(pairs), np.int64)
        # and of large ones, from distinct ids
        for g in np.flatnonzero(~usual):
            ua, ca = np.unique(a[first_a[g] : first_a[g] + in_a[g]], return_counts=True)
            ub, cb = np.unique(b[first_b[g] : first_b[g] + in_b[g]], return_counts=True)
            pairs = np.concatenate([pairs, ((ua[:, None] << self.shift) | ub).ravel()])
            seg = np.concatenate([seg, np.full(len(ua) * len(ub), seg_of_group[g])])
            times = np.concatenate([times, (ca[:, None] * cb).ravel()])
        order = np.argsort(seg, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(seg, minlength=len(segments)))]).astype(np.int64)
        # the tokens in the order in which they are written: those of A in a group, then those of B
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + first_b[group_a]] = 2 * a + (np.arange(len(a)) == (first_a + in_a - 1)[group_a])
        codes[np.arange(len(b)) + (first_a + in_a)[group_b]] = 2 * len(self.a_bytes) + 2 * b + (np.arange(len(b)) == (first_b + in_b - 1)[group_b])
        said, at = list(map(self.written.__getitem__, codes.tolist())), np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        text = ["".join(said[x:y])[:-1] for x, y in zip(at, at[1:])]
        return Aligned(good, n_a, n_b, np.diff(group_bounds), n_links, text, bounds, pairs[order], times[order])


@lru_cache(1)
def _aligner(a_file: str, b_file: str) -> Aligner:
    return Aligner(a_file, b_file)


def _joined(x: Aligned, docs: np.ndarray, segs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, pair and number of links, from the segments (each n times) of documents."""
    sizes = x.bounds[segs + 1] - x.bounds[segs]
    at = _runs(x.bounds[segs], sizes)
    return np.repeat(docs, sizes), x.pairs[at], x.times[at] * np.repeat(n, sizes)


def align_block(aligner: Aligner, texts: list[str | None]) -> tuple[list[tuple], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per text (n_a, n_b, n_groups, n_links, digest of the groups), and the distinct (pair, text number) in order with the number of links of each.

    Texts whose words part at single spaces are aligned by their distinct words; others, and those with a word that does not give its bytes back, whole.
    """
    docs: list[tuple] = [(0, 0, 0, 0, "")] * len(texts)
    found = []
    plain = np.array([bool(t) and aligner.by_words for t in texts])
    if plain.any():
        odd = pc.match_substring_regex(pa.array([t or "" for t in texts], pa.large_string()), r"(^|[ ])([\s\x1c-\x1f\x85\p{Z}]|$)").to_numpy(zero_copy_only=False)
        plain &= ~odd
    rows = np.flatnonzero(plain)
    if len(rows):
        words = pc.split_pattern(pa.array([texts[i] for i in rows], pa.large_string()), " ")
        many = np.diff(words.offsets.to_numpy())
        coded = words.flatten().dictionary_encode()
        codes, x = coded.indices.to_numpy().astype(np.int64), aligner.align(coded.dictionary.to_pylist())
        bounds = np.concatenate([[0], np.cumsum(many)])
        fine = _sum_runs(~x.good[codes], bounds) == 0
        plain[rows[~fine]] = False
        sums = [_sum_runs(v[codes], bounds).tolist() for v in (x.n_a, x.n_b, x.n_groups, x.n_links)]
        listed = codes.tolist()
        for k in np.flatnonzero(fine).tolist():
            digest = hashlib.sha256(";".join(map(x.text.__getitem__, listed[bounds[k] : bounds[k + 1]])).encode()).hexdigest()
            docs[rows[k]] = (*(s[k] for s in sums), digest)
        keep = np.repeat(fine, many)
        of, n = np.unique(np.repeat(rows, many)[keep] * len(x.good) + codes[keep], return_counts=True)
        found.append(_joined(x, of // max(len(x.good), 1), of % max(len(x.good), 1), n))
    rest = [i for i, t in enumerate(texts) if t and not plain[i]]
    if rest:
        x = aligner.align([texts[i] for i in rest])
        for k, i in enumerate(rest):
            if x.good[k]:
                docs[i] = (int(x.n_a[k]), int(x.n_b[k]), int(x.n_groups[k]), int(x.n_links[k]), hashlib.sha256(x.text[k].encode()).hexdigest())
        found.append(_joined(x, np.array(rest), np.arange(len(rest)), np.ones(len(rest), np.int64)))
    if not found:
        return docs, (np.zeros(0, np.int64),) * 3
    doc, pair, times = (np.concatenate(c) for c in zip(*found))
    key = (pair << 16) | doc
    order = np.argsort(key, kind="stable")
    key, starts = np.unique(key[order], return_index=True)
    return docs, (key >> 16, key & 0xFFFF, np.add.reduceat(times[order], starts) if len(starts) else times)


def pack_postings(pair: np.ndarray, doc: np.ndarray, times: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Per pair, from rows in order of (pair, doc): the pair, whether its bitmap has a bit for every document, the bitmap, and the planes of the numbers of links.

    Plane k has a bit for each set document, in order: digit k of its number of links.
    """
    pairs, first, card = np.unique(pair, return_index=True, return_counts=True)
    width = (docs + 7) // 8
    dense = 2 * card > width
    row, rank = np.repeat(np.arange(len(pairs)), card), np.arange(len(pair)) - np.repeat(first, card)
    sizes = np.where(dense, width, 2 * card)
    ends = np.cumsum(sizes)
    bits = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    thin = ~dense[row]
    at = (ends - sizes)[row]
    bits[at[thin] + 2 * rank[thin]] = doc[thin] & 255
    bits[at[thin] + 2 * rank[thin] + 1] = doc[thin] >> 8
    np.bitwise_or.at(bits, (at + (doc >> 3))[~thin], (1 << (doc & 7)).astype(np.uint8)[~thin])
    most = np.maximum.reduceat(times, first) if len(first) else times
    digits = np.ceil(np.log2(most + 1)).astype(np.int64)
    line = (card + 7) // 8
    plane_ends = np.cumsum(digits * line)
    planes = np.zeros(int(plane_ends[-1]) if len(plane_ends) else 0, np.uint8)
    base = (plane_ends - digits * line)[row]
    for k in range(int(digits.max()) if len(digits) else 0):
        on = (times >> k) & 1 == 1
        np.bitwise_or.at(planes, (base + k * line[row] + (rank >> 3))[on], (1 << (rank & 7)).astype(np.uint8)[on])

    def binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(data)])

    return pairs, dense, binary(bits, ends), binary(planes, plane_ends)


def _parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a binary column without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8), offsets


def unpack_postings(dense: np.ndarray, bits: pa.Array, planes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, document and number of links of everything that pack_postings packed."""
    data, offsets = _parts(bits)
    sizes = np.diff(offsets)
    thin = np.flatnonzero(~dense)
    card = np.where(dense, 0, sizes // 2)
    at = _runs(offsets[thin], sizes[thin])
    low = data[at].reshape(-1, 2).astype(np.int64)
    row, doc = np.repeat(thin, card[thin]), low[:, 0] | low[:, 1] << 8
    full = np.flatnonzero(dense)
    if len(full):
        bit = np.flatnonzero(np.unpackbits(data[_runs(offsets[full], sizes[full])], bitorder="little"))
        start = 8 * (np.cumsum(sizes[full]) - sizes[full])
        which = np.searchsorted(start, bit, "right") - 1
        card[full] = np.bincount(which, minlength=len(full))
        row, doc = np.concatenate([row, full[which]]), np.concatenate([doc, bit - start[which]])
        order = np.argsort(row, kind="stable")
        row, doc = row[order], doc[order]
    digits, plane_at = _parts(planes)
    line = (card + 7) // 8
    count = np.diff(plane_at) // np.maximum(line, 1)
    rank = np.arange(len(row)) - np.repeat(np.cumsum(card) - card, card)
    times = np.zeros(len(row), np.int64)
    for k in range(int(count.max()) if len(count) else 0):
        on = count[row] > k
        times[on] |= ((digits[(plane_at[:-1][row] + k * line[row] + (rank >> 3))[on]] >> (rank & 7)[on]) & 1).astype(np.int64) << k
    return row, doc, times


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for k in range(len(batch)):
            t = batch.column(1)[k].as_py()
            ids.append(batch.column(0).slice(k, 1))
            texts.append(t)
            size += len(t or "")
            if size >= BLOCK_BYTES or len(texts) == BLOCK_DOCS:
                yield pa.concat_arrays(ids), texts
                ids, texts, size = [], [], 0
    if texts:
        yield pa.concat_arrays(ids), texts


DIGEST = ("n_a", "n_b", "n_groups", "n_links")


def align(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: the id, n_a and n_b (tokens), n_groups, n_links, n_best (links whose pair has the highest count of its A id, ties included), count_sum (the counts of its links summed), groups_sha256.

    A pair's count is the number of rows of docs that hold it linked, so repeated rows count as often as they stand there, and a null id is carried along. Null and empty texts, and those that one of the tokenizers does not
    give back byte for byte after a space, have no tokens: zeros and ''. An empty table gives no rows; other columns of docs are not read. A text is never cut: one longer
    than a block is a block, and needs memory in proportion to its tokens; a group of tokens with very many links is expanded by its distinct ids.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    row = f"id {kind}, {', '.join(f'{c} long' for c in DIGEST)}, groups_sha256 string"
    schema = f"block long, docs array<struct<{row.replace(' ', ':').replace(',:', ',')}>>, pair long, dense boolean, bits binary, planes binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for ids, texts in _blocks(batches):
            said, posted = align_block(_aligner(a_file, b_file), texts)
            fields = [ids, *(pa.array([s[k] for s in said], pa.int64()) for k in range(4)), pa.array([s[4] for s in said], pa.string())]
            each = pa.StructArray.from_arrays(fields, names=["id", *DIGEST, "groups_sha256"])
            head = pa.ListArray.from_arrays(pa.array([0, len(each)], pa.int32()), each)
            empty = [pa.nulls(1, t) for t in (pa.int64(), pa.bool_(), pa.binary(), pa.binary())]
            names = ["block", "docs", "pair", "dense", "bits", "planes"]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), head, *empty], names=names)
            pairs, dense, bits, planes = pack_postings(*posted, len(texts))
            for k in range(0, len(pairs), 20_000):
                cut = slice(k, k + 20_000)
                n = len(pairs[cut])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.nulls(n, head.type), pa.array(pairs[cut]), pa.array(dense[cut]), bits[cut], planes[cut]], names=names)
            block += 1

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    table = materialise(slim.mapInArrow(encode, schema))
    posted = table.where("pair IS NOT NULL")
    held = F.when(F.col("dense"), F.bitmap_count("bits")).otherwise(F.octet_length("bits") / 2).cast("long")
    shift = _shift(b_file)
    counts = materialise(posted.groupBy(spread_key("pair"), "pair").agg(F.sum(held).alias("count")).select("pair", "count"))
    # one row per id of A's vocabulary
    highest = counts.groupBy(F.shiftright("pair", shift).alias("a")).agg(F.max("count").alias("highest"))
    scores = counts.join(F.broadcast(highest), F.shiftright("pair", shift) == F.col("a")).select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    scored = posted.drop("docs").join(scores, "pair").drop("pair")
    both = scored.unionByName(table.where("pair IS NULL").select("block", "docs"), allowMissingColumns=True).select("block", "docs", "dense", "bits", "planes", "count", "best")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, each, sums = None, None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*each.flatten(), pa.array(sums[0]), pa.array(sums[1])], names=["id", *DIGEST, "groups_sha256", "n_best", "count_sum"])

        for batch in batches:
            blocks = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for x, y in zip(edges, edges[1:]):
                part = batch.slice(x, y - x)
                if part.num_rows and blocks[x] != now:  # the rows of a block begin with its documents
                    if now is not None:
                        yield out()
                    now, each = blocks[x], part.column(1).slice(0, 1).flatten()
                    sums = np.zeros((2, len(each)), np.int64)
                    part = part.slice(1)
                if part.num_rows:
                    row, doc, times = unpack_postings(part.column(2).to_numpy(zero_copy_only=False), part.column(3), part.column(4))
                    count, best = part.column(5).to_numpy()[row], part.column(6).to_numpy(zero_copy_only=False)[row]
                    np.add.at(sums[0], doc, times * best)
                    np.add.at(sums[1], doc, times * count)
        if now is not None:
            yield out()

    sorted_blocks = both.repartition("block").sortWithinPartitions("block", F.col("docs").isNull())
    out = materialise(sorted_blocks.mapInArrow(gather, f"{row}, n_best long, count_sum long"), drop=table)
    discard(counts)
    return out.select(F.col("id").alias(id_col), *DIGEST, "n_best", "count_sum", "groups_sha256")


def _shift(b_file: str) -> int:
    import sentencepiece

    return max(1, (sentencepiece.SentencePieceProcessor(model_file=b_file).get_piece_size() - 1).bit_length())

"""Packing documents into sequences of a fixed capacity by bulk-synchronous best fit.

1. Texts are tokenised where they are read; a document's ids end with a
   separator, and only documents longer than the capacity are cut.
2. Pieces are range-sorted by length, longest first, and numbered.
3. Supersteps match pieces to gaps.  Both sides are sorted by size; one sweep
   pairs every gap with the largest free piece it can hold, at most one piece a
   gap and one gap a piece.  Where many pieces want one gap, or many gaps one
   piece, rank decides.  Gaps are updated and the sweep is repeated; when no gap
   takes a piece any more, the longest free pieces open new sequences.

Since sizes are integers up to the capacity, equal sizes form runs of ranks: a
superstep works on runs (at most ``capacity`` sizes, counted in Spark), so its
state is bounded by the capacity and doesn't grow with the documents.  Each
piece then looks its place up by rank, in parallel.  Ids stay out of the ranking:
``packed_sequences`` writes them once, compressed, and joins them to the places.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import blocks, cache, hash_words, tidied, utf8
from .ranking import with_rank
from .scratch import Scratch, refuse_clash

CAPACITY = 2048
SEPARATOR = 0
BLOCK = 1 << 20
MAX_WORDS = 1_000_000
PLAN_ROWS = 1 << 20  # of the plan in one broadcast: 32 MB; a longer plan goes in several

# Words for which the tokenizer's own model can be asked directly: letters whose
# lower case and composed form are plain, then ASCII marks other than ' and <.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=-@\\[-`{-~]*)", re.ASCII)


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for k, b in enumerate(x for x in range(256) if x not in out):
        out[b] = chr(256 + k)
    return out


class WordIds:
    """Token ids of words, kept between batches and bounded in number.

    Words go by a 64-bit hash.  A direct-mapped table answers for most; the rest
    are looked up in a sorted array, and unseen words are tokenised.  A full
    store is emptied, which costs time but changes no result.
    """

    def __init__(self, path: str, slots: int = 1 << 20, limit: int = MAX_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.stand_in = str.maketrans(_byte_letters())
        self.mask, self.limit = np.uint64(slots - 1), limit
        self.clear()

    def clear(self) -> None:
        n = int(self.mask) + 1
        self.slot_hash, self.slot_word = np.zeros(n, np.uint64), np.full(n, -1, np.int32)
        self.sorted_hash, self.sorted_word = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.first, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)
        self.marks: dict[str, list[int]] = {}

    def _direct(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.stand_in))]

    def encode(self, words: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(words)
        hard = []
        for k, word in enumerate(words):
            m = _PLAIN.fullmatch(word)
            if m is None:
                hard.append(k)
                continue
            ids = self._direct(m[1].lower())
            if m[2]:
                if m[2] not in self.marks:
                    self.marks[m[2]] = self._direct(m[2])
                ids = ids + self.marks[m[2]]
            out[k] = ids
        if hard:
            for k, e in zip(hard, self.tokenizer.encode_batch([words[k] for k in hard], add_special_tokens=False)):
                out[k] = e.ids
        return out

    def lookup(self, hashes: np.ndarray, first: np.ndarray, last: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Entry numbers of words given by hash and position in ``data``."""
        if len(self.first) > self.limit:
            self.clear()
        slot = (hashes & self.mask).astype(np.int64)
        word = self.slot_word[slot]
        miss = np.flatnonzero((self.slot_hash[slot] != hashes) | (word < 0))
        if not len(miss):
            return word
        unique, where, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
        at = np.searchsorted(self.sorted_hash, unique)
        near = np.minimum(at, max(len(self.sorted_hash) - 1, 0))
        known = self.sorted_hash[near] == unique if len(self.sorted_hash) else np.zeros(len(unique), bool)
        entry = np.full(len(unique), -1, np.int32)
        entry[known] = self.sorted_word[near[known]]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            spots = miss[where[fresh]]
            ids = self.encode([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(first[spots].tolist(), last[spots].tolist())])
            sizes = np.fromiter(map(len, ids), np.int32, len(ids))
            entry[fresh] = np.arange(len(self.first), len(self.first) + len(ids), dtype=np.int32)
            self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(sizes, dtype=np.int64) - sizes])
            self.size = np.concatenate([self.size, sizes])
            self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))])
            self.sorted_hash = np.insert(self.sorted_hash, at[fresh], unique[fresh])
            self.sorted_word = np.insert(self.sorted_word, at[fresh], entry[fresh])
        word[miss] = entry[back]
        self.slot_hash[slot[miss]], self.slot_word[slot[miss]] = hashes[miss], word[miss]
        return word

    def documents(self, data: np.ndarray, offsets: np.ndarray, separator: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each ended by the separator, and their first indexes."""
        hashes, first, last, index = hash_words(data, offsets)
        word = self.lookup(hashes, first, last, data) if len(hashes) else np.zeros(0, np.int32)
        size = self.size[word].astype(np.int64) if len(word) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(size)])
        gather = np.repeat(self.first[word] - ends[:-1], size) + np.arange(ends[-1]) if len(word) else np.zeros(0, np.int64)
        rows = len(offsets) - 1
        start = ends[index] + np.arange(rows + 1)
        out = np.full(int(start[-1]), separator, np.uint32)
        place = np.arange(len(gather)) + np.repeat(np.arange(rows), np.diff(ends[index]))
        out[place] = self.flat[gather]
        return out, start


_STORES: dict[str, WordIds] = cache("packing")


def _store(path: str) -> WordIds:
    if path not in _STORES:
        _STORES[path] = WordIds(path)
    return _STORES[path]


PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"


def token_pieces(
    docs: DataFrame, tokenizer: str, keep: list[Column | str] | None = None, capacity: int = CAPACITY, separator: int = SEPARATOR, squeezed: bool = False
) -> DataFrame:
    """Columns ``keep`` of docs, a row for each piece; a null text is empty and has the separator alone.

    Every row of docs has its own pieces, whatever its doc_id.  ``keep`` may not
    have the result's names or _p_text; other columns of docs may.  ``ids`` are the piece's token ids as little-endian 32-bit integers.
    ``tokenizer`` is the path of a byte-level word vocabulary file that every
    worker can read.  With ``squeezed`` the ids come as ``packed_sequences`` keeps
    them, with the numbers of task and row, so that they needn't pass a second worker.
    """
    refuse_clash(keep, "piece", "start", "length", "ids_crc32", "ids", "_p_text", "_task", "_row")
    kept = docs.select(*(keep or ["doc_id"]), F.col("text").alias("_p_text"))
    names = kept.columns[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _store(tokenizer)
        for batch in batches:
            data, offsets = utf8(batch.column("_p_text"))
            row, piece, start, length, crc, held = [], [], [], [], [], []
            for i, j in blocks(offsets, BLOCK):
                part = data[offsets[i] : offsets[j]]
                ids, at = _ids(words, part, offsets[i : j + 1] - offsets[i], separator)
                for k in range(j - i):
                    a, b = int(at[k]), int(at[k + 1])
                    for n, s in enumerate(range(a, b, capacity)):
                        e = min(s + capacity, b)
                        row.append(i + k)
                        piece.append(n)
                        start.append(s - a)
                        length.append(e - s)
                        held.append(ids[s:e].astype("<u4").tobytes())
                        crc.append(zlib.crc32(held[-1]))
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(take) for c in range(len(names))), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array(held, pa.binary())],
                [*names, "piece", "start", "length", "ids_crc32", "ids"],
            )

    if squeezed:
        return kept.mapInArrow(tidied(lambda batches: _squeeze(run(batches)), "packing"), f"{schema}, {PIECES}, _task bigint, _row bigint")
    return kept.mapInArrow(tidied(run, "packing"), f"{schema}, {PIECES}")


def _ids(words: WordIds, data: np.ndarray, offsets: np.ndarray, separator: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``WordIds.documents``; where a special token could be spelled out, the tokenizer reads whole texts."""
    raw = data.tobytes()
    if b"<|" not in raw:
        return words.documents(data, offsets, separator)
    at = offsets.tolist()
    texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]
    ids = [[*e.ids, separator] for e in words.tokenizer.encode_batch(texts, add_special_tokens=False)]
    return np.fromiter((i for x in ids for i in x), np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in ids])])


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Placements of pieces ranked by descending length, as rows (rank, number, sequence, offset).

    A row puts ``number`` consecutive ranks into as many consecutive sequences,
    all at one offset.  ``counts`` has the pieces of each length, 1 to capacity.
    """
    free: dict[int, list[int]] = {}  # length -> [next rank, number]
    rank = 0
    for length in sorted(counts, reverse=True):
        free[length] = [rank, counts[length]]
        rank += counts[length]
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of sequences (first, number)
    out: list[tuple[int, int, int, int]] = []
    opened = 0

    def open_with(length: int, number: int) -> None:
        nonlocal opened
        out.append((free[length][0], number, opened, 0))
        _take(free, length, number)
        if capacity - length:
            gaps.setdefault(capacity - length, []).append((opened, number))
        opened += number

    for length in [x for x in free if 2 * x > capacity]:  # no two of these share a sequence
        open_with(length, free[length][1])
    while free:
        moved = _sweep(free, gaps, out, capacity)
        if moved or not free:
            continue
        longest = max(free)
        need = -(-sum(k * n for k, (_, n) in free.items()) // capacity)
        open_with(longest, min(free[longest][1], max(1, need)))
    return np.array(sorted(out), np.int64).reshape(-1, 4)


def _take(free: dict[int, list[int]], length: int, number: int) -> None:
    first, n = free[length]
    if n == number:
        del free[length]
    else:
        free[length] = [first + number, n - number]


def _sweep(free: dict[int, list[int]], gaps: dict[int, list[tuple[int, int]]], out: list, capacity: int) -> bool:
    """One superstep: every gap is matched with the largest piece below it that no smaller gap took."""
    waiting: list[list[int]] = []  # (length, number) in ascending order: a stack
    matched: list[tuple[int, int, int]] = []  # gap, length, number
    lengths = sorted(free)
    k = 0
    for gap in sorted(gaps):
        while k < len(lengths) and lengths[k] <= gap:
            waiting.append([lengths[k], free[lengths[k]][1]])
            k += 1
        left = sum(n for _, n in gaps[gap])
        while left and waiting:
            number = min(left, waiting[-1][1])
            matched.append((gap, waiting[-1][0], number))
            left -= number
            waiting[-1][1] -= number
            if not waiting[-1][1]:
                waiting.pop()
    grown: dict[int, list[tuple[int, int]]] = {}
    for gap, length, number in matched:
        while number:
            first, n = gaps[gap].pop()
            used = min(n, number)
            if used < n:
                gaps[gap].append((first + used, n - used))
            out.append((free[length][0], used, first, capacity - gap))
            _take(free, length, used)
            if gap - length:
                grown.setdefault(gap - length, []).append((first, used))
            number -= used
        if not gaps[gap]:
            del gaps[gap]
    for gap, runs in grown.items():
        gaps.setdefault(gap, []).extend(runs)
    return bool(matched)


def pack(spark: SparkSession, pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with a column length, 1 to capacity) with sequence_id and offset.

    ``order`` breaks ties between equal lengths; rows equal in all of it are
    interchangeable.  No pieces give no rows.  ``pieces`` may not have the columns
    sequence_id, offset, rank, _part or _index.
    """
    refuse_clash(pieces.columns, "sequence_id", "offset", "rank", "_part", "_index")
    scratch = Scratch(spark, "packing")
    pieces = scratch.save(pieces, "pieces")
    ranked, _ = with_rank(spark, pieces, [F.col("length").desc(), *(F.col(c) for c in order)], scratch, "ranked")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    scratch.drop("pieces")
    if counts and not 0 < min(counts) <= max(counts) <= capacity:
        raise ValueError("lengths must be 1 to the capacity")
    runs = plan(counts, capacity)
    columns = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def placed(block: np.ndarray) -> DataFrame:
        """The pieces of a block of the plan, which has consecutive ranks."""
        shared = spark.sparkContext.broadcast(block)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = shared.value
            for batch in batches:
                rank = batch.column("rank").to_numpy()
                run = rows[np.searchsorted(rows[:, 0], rank, side="right") - 1] if len(rank) else rows[:0]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in columns), pa.array(run[:, 2] + rank - run[:, 0]), pa.array(run[:, 3])], [*columns, "sequence_id", "offset"]
                )

        inside = ranked
        if len(block) < len(runs):
            inside = ranked.where((F.col("rank") >= int(block[0, 0])) & (F.col("rank") < int(block[-1, 0] + block[-1, 1])))
        return inside.select(*columns, "rank").mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")

    parts = [placed(runs[k : k + PLAN_ROWS]) for k in range(0, max(len(runs), 1), PLAN_ROWS)]
    return reduce(DataFrame.unionByName, parts)


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids as compressed byte planes, and numbers of the task and of its rows."""
    task, seen = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        small = [pa.compress(np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True) for x in batch.column("ids")]
        columns = [batch.column(c) if c != "ids" else pa.array(small, pa.binary()) for c in batch.schema.names]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(np.full(n, task, np.int64)), pa.array(np.arange(seen, seen + n, dtype=np.int64))], [*batch.schema.names, "_task", "_row"]
        )
        seen += n


def packed_sequences(spark: SparkSession, pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """The sequences of ``pack``: sequence_id, ids (little-endian 32-bit integers) and pieces.

    ``pieces`` of the result is an array of the columns of the argument other
    than ids and ids_crc32, with offset, in the order of offsets.  The argument
    is that of ``token_pieces``, squeezed or not.
    """
    scratch = Scratch(spark, "sequences")
    if "_task" not in pieces.columns:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
        pieces = pieces.mapInArrow(_squeeze, f"{schema}, _task bigint, _row bigint")
    tokens = scratch.save(pieces, "tokens")
    light = tokens.select(*dict.fromkeys(["_task", "_row", "length", *order]))
    placed = pack(spark, light, [*order, "_task", "_row"], capacity).select("_task", "_row", "sequence_id", "offset")
    names = [c for c in pieces.columns if c not in ("ids", "ids_crc32", "_task", "_row")] + ["offset"]
    found = tokens.join(placed, ["_task", "_row"]).select("sequence_id", *names, "ids")
    dealt = found.repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")
    members = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in found.select(*names).schema)

    def whole(table: pa.Table) -> pa.RecordBatch:
        sequence = table["sequence_id"].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], sequence[1:] != sequence[:-1]]))
        sizes = table["length"].to_numpy()
        ids = [
            np.frombuffer(pa.decompress(x.as_py(), 4 * int(n), "zstd", asbytes=True), np.uint8).reshape(4, -1).T.tobytes()
            for x, n in zip(table["ids"], sizes)
        ]
        cuts = [*first.tolist(), len(sequence)]
        held = pa.StructArray.from_arrays([table[c].combine_chunks() for c in names], names)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(sequence[first]),
                pa.array([b"".join(ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
                pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), held),
            ],
            ["sequence_id", "ids", "pieces"],
        )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None  # rows of the sequence that the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            sequence = table["sequence_id"].to_numpy()
            cut = int(np.searchsorted(sequence, sequence[-1]))
            if cut:
                yield whole(table.slice(0, cut))
            rest = table.slice(cut).combine_chunks()
        if rest is not None:
            yield whole(rest)

    return dealt.mapInArrow(tidied(join), f"sequence_id bigint, ids binary, pieces array<struct<{members}>>")


def placements(sequences: DataFrame) -> DataFrame:
    """A row for each piece of ``packed_sequences`` with its place and the checksum of its ids there."""
    names = [f.name for f in sequences.schema["pieces"].dataType.elementType if f.name != "offset"]
    part = lambda x: F.substring("ids", (x["offset"] * 4 + 1).cast("int"), (x["length"] * 4).cast("int"))
    rows = F.transform("pieces", lambda x: F.struct(*[x[c].alias(c) for c in names], F.crc32(part(x)).alias("ids_crc32"), F.col("sequence_id"), x["offset"].alias("offset")))
    return sequences.select(F.inline(rows))

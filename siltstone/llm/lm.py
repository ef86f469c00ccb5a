"""Interpolated modified Kneser-Ney scores of texts, of order two or three.

Counting.  Tasks sum up the words, then the n-grams of the highest order, of
their own rows and send compressed arrays to shards.  Words have ids in the order of
their shards, the most frequent of a shard first.  A shard of trigrams has whole contexts (at
most as many entries as there are words for one context); it sends on how many
distinct words come before each pair, which is the count of the order below.
Numbers of shards follow the bytes and tokens that were counted.  Counts are
exact: entries have codes into a table of the distinct counts of their shard.

Storing.  Shards are files in the shared folder: sorted word hashes and counts;
for each order a table of sorted hashes, cut to a bucket and 32 bits, with counts
(and with sums by context for trigrams); by word id the sums of its successors
and the number of its distinct predecessors.

Scoring.  Workers memory-map the files and look sorted batches of hashes up in
them.  Every text is scored whole; a token is a word (A-Z lower-cased) or the
end, and the first token follows a begin mark that is never scored.  An unseen
n-gram is taken for a seen one with probability below 2^-28.

Only counts of counts, and one row a shard, come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import blocks, hash_words, mix, tidied, utf8
from .scratch import Scratch, refuse_clash
from .sharedfiles import map_array, write_array

BLOCK = 1 << 21
HELD, HELD_WORDS = 1 << 20, 1 << 21  # distinct entries a task holds before it sends them on
RANGE_BITS = 16  # word ids of one file of word statistics
ORDER = 3
SHARD_BYTES, MOST_WORD_BITS = 1 << 27, 14  # 2^14 shards hold 2^32 words, which is the most
SHARD_TOKENS = 1 << 21
OPEN_FILES = 1 << 12
FAN_BITS = 8  # of a shard's number: so many shards' sums are added up at once
RARE = 255  # the code of all rows of a table that have none of their own
_U = np.uint64
_CODEC = pa.Codec("zstd", 1)


def pack_ints(values: np.ndarray, sorted_: bool = False) -> bytes:
    """Integers as compressed byte planes; of sorted ones the differences."""
    wide = values.astype(np.uint64)
    if sorted_ and len(wide):
        wide = np.concatenate([wide[:1], wide[1:] - wide[:-1]])
    planes = np.ascontiguousarray(wide.view(np.uint8).reshape(-1, 8).T)
    return len(wide).to_bytes(8, "little") + (_CODEC.compress(planes.tobytes(), asbytes=True) if len(wide) else b"")


def unpack_ints(blob: bytes, sorted_: bool = False) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(_CODEC.decompress(blob[8:], decompressed_size=8 * n, asbytes=True), np.uint8).reshape(8, n)
    wide = np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1)
    return np.cumsum(wide, dtype=np.uint64) if sorted_ else wide


def merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts (a column each where 2-d)."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, int)
    return k[first], np.add.reduceat(c, first, axis=0) if len(k) else c


class _Tally:
    """Counts of keys, merged whenever they get many; columns besides the key are kept from its first entry."""

    def __init__(self, most: int | None = None) -> None:
        self.most = most or HELD
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = self.merged = 0

    def add(self, keys: np.ndarray, *besides: np.ndarray) -> None:
        if besides:
            k, first, c = np.unique(keys, return_index=True, return_counts=True)
            self.parts.append((k, c, *(x[first] for x in besides)))
        else:
            self.parts.append(np.unique(keys, return_counts=True))

    def full(self) -> bool:
        """Whether there are more entries than a task may hold, merged as they are."""
        self.held = sum(len(p[0]) for p in self.parts)
        if self.held > 2 * self.merged + (self.most >> 2):
            self.collapse()
        if self.held > self.most:
            self.collapse()
        return self.held > self.most

    def collapse(self) -> None:
        if len(self.parts) > 1:
            k, c, *rest = (np.concatenate(x) for x in zip(*self.parts))
            order = np.argsort(k, kind="stable")
            k = k[order]
            first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            self.parts = [(k[first], np.add.reduceat(c[order], first), *(x[order[first]] for x in rest))]
        self.held = self.merged = sum(len(p[0]) for p in self.parts)

    def drain(self) -> tuple[np.ndarray, ...]:
        self.collapse()
        out, self.parts, self.held, self.merged = self.parts[0], [], 0, 0
        return out


_BLOBS = "shard int, keys binary, words binary, counts binary"


def _to_shards(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray, words: np.ndarray | None = None) -> pa.RecordBatch:
    """A row for each shard, ascending by key; ``words`` is a second part of the key."""
    order = np.lexsort((keys, shard))
    names, first = np.unique(shard[order], return_index=True)
    cuts = np.append(first, len(order))
    parts = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(names.astype(np.int32)),
            pa.array([pack_ints(keys[p], True) for p in parts], pa.binary()),
            pa.array([pack_ints(words[p]) if words is not None else b"" for p in parts], pa.binary()),
            pa.array([pack_ints(counts[p]) for p in parts], pa.binary()),
        ],
        ["shard", "keys", "words", "counts"],
    )


def _shard(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The upper bits of a hash."""
    return (hashes >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _bits(items: int, each: int) -> int:
    """Bits that name shards of ``each`` items."""
    return max(0, -(-items // each) - 1).bit_length()


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (first.astype(np.uint64) << _U(32)) | second.astype(np.uint64)


def _gram_hash(pair: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(pair) * _U(3) + word.astype(np.uint64))


def pack_table(hashes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The bytes of a table from sorted, distinct hashes to rows of ``values``.

    A header of five numbers; the distinct rows, the most frequent first; where
    each bucket of hashes begins; 32 bits of each hash after those that name its
    bucket; positions and row numbers of entries with rare rows; a byte for each
    entry, its row's number or RARE.
    """
    n = len(hashes)
    bits = max(0, n.bit_length() - 4)
    if values.shape[1] == 1:
        mixed = values[:, 0]
    else:  # rows that agree under a hash are equal
        with np.errstate(over="ignore"):
            mixed = mix(values.astype(np.uint64) @ np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)[: values.shape[1]])
    _, first, back, times = np.unique(mixed, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(-times, kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    codes, rows = number[back], values[first[order]]
    rare = np.flatnonzero(codes >= RARE)
    index = np.searchsorted(_shard(hashes, bits), np.arange((1 << bits) + 1)).astype(np.uint32)
    low = (hashes >> _U(32 - bits)).astype(np.uint32)
    parts = [
        np.array([n, bits, len(rare), *rows.shape], np.uint64), rows.astype(np.uint64).reshape(-1), index, low,
        rare.astype(np.uint32), codes[rare].astype(np.uint32), np.minimum(codes, RARE).astype(np.uint8),
    ]
    return np.concatenate([np.ascontiguousarray(p).view(np.uint8) for p in parts])


class Table:
    """A map of the bytes of ``pack_table``."""

    def __init__(self, raw: np.ndarray):
        n, self.bits, rare, many, columns = raw[:40].view(np.uint64).astype(int).tolist()
        cuts = np.cumsum([40, 8 * many * columns, 4 * ((1 << self.bits) + 1), 4 * n, 4 * rare, 4 * rare, n])
        part = lambda k, kind: raw[cuts[k] : cuts[k + 1]].view(kind)
        self.rows = part(0, np.uint64).astype(np.int64).reshape(many, columns)
        self.index, self.low, self.rare, self.rare_rows, self.codes = (part(k, np.uint32 if k < 5 else np.uint8) for k in range(1, 6))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of ascending hashes; zeros where there is none."""
        bucket = _shard(hashes, self.bits)
        at, end = self.index[bucket].astype(np.int64), self.index[bucket + 1].astype(np.int64)
        want = (hashes >> _U(32 - self.bits)).astype(np.uint32)
        out = np.zeros((len(hashes), self.rows.shape[1]), np.int64)
        live = np.flatnonzero(at < end)
        while len(live):
            here, wanted = self.low[at[live]], want[live]
            hit = live[here == wanted]
            if len(hit):
                code = self.codes[at[hit]].astype(np.int64)
                rare = np.flatnonzero(code == RARE)
                code[rare] = self.rare_rows[np.searchsorted(self.rare, at[hit[rare]])]
                out[hit] = self.rows[code]
            live = live[here < wanted]
            at[live] += 1
            live = live[at[live] < end[live]]
        return out


@dataclass
class Model:
    """Where the files are, and the numbers that scoring needs besides."""

    uri: str
    order: int
    word_bits: int  # of the hash that name a shard of words
    word_starts: np.ndarray  # id of each word shard's first word
    docs: int
    words: int  # distinct
    tokens: int  # words and ends in training
    word_shards: np.ndarray  # whether a shard has a file
    gram_bits: int = 0  # of the hash that name a shard of n-grams
    pairs: int = 0  # distinct
    discounts: dict = field(default_factory=dict)  # order: discounts of counts 1, 2, 3 and more
    lower_rest: float = 1.0  # weight of the uniform distribution
    gram_shards: dict = field(default_factory=dict)  # kind: whether a shard has a file
    maps: dict = field(default_factory=dict, repr=False, compare=False)

    @property
    def end(self) -> int:
        return self.words

    @property
    def begin(self) -> int:
        return self.words + 1

    @property
    def types(self) -> int:
        return self.words + (1 if self.docs else 0)

    def array(self, name: str, dtype: type, table: bool = False) -> np.ndarray | Table:
        if name not in self.maps:
            if len(self.maps) > OPEN_FILES:
                self.maps = {k: v for k, v in self.maps.items() if k == "front"}
            held = map_array(f"{self.uri}/{name}", dtype)
            self.maps[name] = Table(held) if table else held
        return self.maps[name]

    def __getstate__(self) -> dict:
        return {**self.__dict__, "maps": {}}

    @staticmethod
    def _runs(sorted_shards: np.ndarray) -> Iterator[tuple[int, int, int]]:
        first = np.flatnonzero(np.append(True, sorted_shards[1:] != sorted_shards[:-1])) if len(sorted_shards) else []
        for a, b in zip(first, [*first[1:], len(sorted_shards)]):
            yield int(sorted_shards[a]), a, b

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, -1 where unknown, and the words' training counts."""
        table = self.maps.get("front")
        if table is None:
            n = 1 << 20
            table = self.maps["front"] = (np.zeros(n, np.uint64), np.full(n, -2, np.int64), np.zeros(n, np.int64))
        slot = (hashes & _U(len(table[0]) - 1)).astype(np.int64)
        out, count = table[1][slot], table[2][slot]
        miss = np.flatnonzero((table[0][slot] != hashes) | (out == -2))
        if len(miss):
            unique, back = np.unique(hashes[miss], return_inverse=True)
            ids, counts = np.full(len(unique), -1, np.int64), np.zeros(len(unique), np.int64)
            for s, a, b in self._runs(_shard(unique, self.word_bits)):
                if self.word_shards[s]:
                    keys = self.array(f"words-{s}", np.uint64)
                    spot = np.minimum(np.searchsorted(keys, unique[a:b]), len(keys) - 1)
                    hit = np.flatnonzero(keys[spot] == unique[a:b])
                    ids[a + hit] = self.word_starts[s] + self.array(f"word-ranks-{s}", np.uint32)[spot[hit]]
                    counts[a + hit] = self.array(f"word-counts-{s}", np.uint64)[spot[hit]]
            out[miss], count[miss] = ids[back], counts[back]
            table[0][slot[miss]], table[1][slot[miss]], table[2][slot[miss]] = hashes[miss], out[miss], count[miss]
        return out, count

    def statistics(self, ids: np.ndarray) -> np.ndarray:
        """(ids x 5): successors counted once, twice, more often; their sum; predecessors.  Ids are sorted and known."""
        out = np.zeros((len(ids), 5), np.int64)
        for part, a, b in self._runs(ids >> RANGE_BITS):
            out[a:b] = self.array(f"statistics-{part}", np.uint64).reshape(-1, 5)[ids[a:b] - (part << RANGE_BITS)]
        return out

    def find(self, kind: str, shard: np.ndarray, hashes: np.ndarray, columns: int) -> np.ndarray:
        """Rows of the tables ``kind`` for hashes in shards."""
        key = (shard.astype(np.uint64) << _U(64 - self.gram_bits)) | (hashes >> _U(self.gram_bits)) if self.gram_bits else hashes
        order = np.argsort(key)
        shard, hashes = shard[order], hashes[order]
        found = np.zeros((len(order), columns), np.int64)
        for s, a, b in self._runs(shard):
            if self.gram_shards[kind][s]:
                found[a:b] = self.array(f"{kind}-{s}", np.uint8, True).find(hashes[a:b])
        out = np.empty_like(found)
        out[order] = found
        return out

    def pair_counts(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        hashed = mix(_pair(before, word))
        return self.find("pairs", _shard(hashed, self.gram_bits), hashed << _U(self.gram_bits), 1)[:, 0]

    def contexts(self, pair: np.ndarray) -> np.ndarray:
        """(pairs x 4): successors counted once, twice, more often; their sum."""
        hashed = mix(pair)
        return self.find("contexts", _shard(hashed, self.gram_bits), hashed << _U(self.gram_bits), 4)

    def gram_counts(self, pair: np.ndarray, word: np.ndarray) -> np.ndarray:
        return self.find("grams", _shard(mix(pair), self.gram_bits), _gram_hash(pair, word), 1)[:, 0]


def _tokens(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token ids of all rows, the ids before them, training counts, first indexes of rows."""
    hashes, _, _, index = hash_words(data, offsets)
    rows = len(offsets) - 1
    start = index + np.arange(rows + 1)
    ids = np.full(int(start[-1]), model.end if model.docs else -1, np.int64)
    counts = np.full(len(ids), model.docs, np.int64)
    place = np.arange(len(hashes)) + np.repeat(np.arange(rows), np.diff(index))
    if len(hashes):
        ids[place], counts[place] = model.ids(hashes)
    before = np.empty(len(ids), np.int64)
    before[1:] = ids[:-1]
    before[start[:-1]] = model.begin
    return ids, before, counts, start


def _discounts(t: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of n-grams counted 1 to 4 times."""
    if not t[0] or not t[1]:
        return 0.5, 0.5, 0.5
    y = t[0] / (t[0] + 2 * t[1])
    out = [1 - 2 * y * t[1] / t[0], 2 - 3 * y * t[2] / t[1], 3 - 4 * y * t[3] / t[2] if t[2] else 2.0]
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(out))


def _unpacked(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of all rows of a shard."""
    return np.concatenate([unpack_ints(x.as_py(), True) for x in group.column("keys")]), np.concatenate([unpack_ints(x.as_py()).astype(np.int64) for x in group.column("counts")])


def _of_counts(counts: np.ndarray) -> list[int]:
    """The numbers of counts 1 to 4, of those over 2, and of all."""
    return [*(int((counts == k).sum()) for k in (1, 2, 3, 4)), int((counts > 2).sum()), len(counts)]


def train(spark: SparkSession, docs: DataFrame, scratch: Scratch | None = None, order: int = ORDER) -> Model:
    """A model of all rows of docs (text); a null text is empty.  No rows give a uniform model.

    ``order`` is two or three.  Repeated rows count each time; other columns of
    docs are not read.
    """
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    scratch = scratch or Scratch(spark, "lm")
    uri = f"{scratch.uri}/model"
    texts = docs.select("text")
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bits = min(MOST_WORD_BITS, _bits(size, SHARD_BYTES))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, rows = _Tally(HELD_WORDS), 0
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            rows += batch.num_rows
            for i, j in blocks(offsets, BLOCK):
                tally.add(hash_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[0])
                if tally.full():
                    yield _words_out(tally)
        if tally.parts:
            yield _words_out(tally)
        none = pa.array([b""])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([rows.to_bytes(8, "little")]), none, none], ["shard", "keys", "words", "counts"])

    def _words_out(tally: _Tally) -> pa.RecordBatch:
        keys, counts = tally.drain()
        return _to_shards(keys, counts, _shard(keys, bits))

    def store_words(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        if shard < 0:
            n = sum(int.from_bytes(x.as_py(), "little") for x in group.column("keys"))
            return pa.table({"shard": pa.array([-1], pa.int32()), "distinct": pa.array([n], pa.int64()), "total": pa.array([0], pa.int64())})
        keys, counts = _unpacked(group)
        keys, counts = merge([keys], [counts])
        ranks = np.empty(len(keys), np.uint32)
        ranks[np.argsort(-counts, kind="stable")] = np.arange(len(keys), dtype=np.uint32)
        write_array(f"{uri}/words-{shard}", keys)
        write_array(f"{uri}/word-ranks-{shard}", ranks)
        write_array(f"{uri}/word-counts-{shard}", counts.astype(np.uint64))
        return pa.table({"shard": pa.array([shard], pa.int32()), "distinct": pa.array([len(keys)], pa.int64()), "total": pa.array([int(counts.sum())], pa.int64())})

    found = {
        r["shard"]: r
        for r in texts.mapInArrow(tidied(count_words), _BLOBS).groupBy("shard").applyInArrow(store_words, "shard int, distinct bigint, total bigint").collect()
    }
    rows = found.pop(-1)["distinct"] if -1 in found else 0
    sizes = np.array([found[s]["distinct"] if s in found else 0 for s in range(1 << bits)], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    model = Model(uri, order, bits, starts[:-1], rows, int(starts[-1]), sum(r["total"] for r in found.values()) + rows, sizes > 0)
    if model.words >= (1 << 32) - 2:
        raise ValueError("more than 2^32 distinct words")
    if not rows:
        return model
    model.gram_bits = gram_bits = _bits(model.tokens, SHARD_TOKENS)
    shared = spark.sparkContext.broadcast(model)
    begin = model.begin

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, j in blocks(offsets, BLOCK):
                ids, before, _, start = _tokens(shared.value, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                if order == 2:
                    tally.add(_pair(before, ids))
                else:
                    pair = _pair(_before_last(before, start, begin), before)
                    tally.add(_gram_hash(pair, ids), pair, ids.astype(np.uint32))
                if tally.full():
                    yield _grams_out(tally)
        if tally.parts:
            yield _grams_out(tally)

    def _grams_out(tally: _Tally) -> pa.RecordBatch:
        keys, counts, *gram = tally.drain()
        if gram:
            return _to_shards(gram[0], counts, _shard(mix(gram[0]), gram_bits), gram[1])
        return _pairs_out(keys, counts)

    def _pairs_out(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return _to_shards(keys, counts, _shard(mix(keys), gram_bits))

    def tallied(shard: int, counts: np.ndarray) -> pa.RecordBatch:
        """What the next step passes on as it is."""
        blob = pack_ints(np.array([shard, *_of_counts(counts)]))
        none = pa.array([b""])
        return pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), none, pa.array([blob]), none], ["shard", "keys", "words", "counts"])

    def store_grams(group: pa.Table) -> pa.Table:
        """Files of a shard of trigrams; out go its counts of counts and the pairs that its trigrams end with."""
        shard = group.column("shard")[0].as_py()
        pair, counts = _unpacked(group)
        word = np.concatenate([unpack_ints(x.as_py()) for x in group.column("words")])
        hashed = _gram_hash(pair, word)
        at = np.argsort(hashed)
        hashed = hashed[at]
        first = np.flatnonzero(np.append(True, hashed[1:] != hashed[:-1]))
        hashed, counts, pair, word = hashed[first], np.add.reduceat(counts[at], first), pair[at[first]], word[at[first]]
        starting = pair == _U((begin << 32) | begin)  # not trigrams: the counts of pairs that start a text
        real = np.flatnonzero(~starting)
        if len(real):
            write_array(f"{uri}/grams-{shard}", pack_table(hashed[real], counts[real, None]))
            context, at = mix(pair[real]), None
            at = np.argsort(context)
            context, sums = context[at], counts[real[at]]
            first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
            each = [np.add.reduceat(x.astype(np.int64), first) for x in (sums == 1, sums == 2, sums > 2, sums)]
            write_array(f"{uri}/contexts-{shard}", pack_table(context[first] << _U(gram_bits), np.stack(each, axis=1)))
        last = _pair(pair & _U(0xFFFFFFFF), word)
        keys, sums = merge([last], [np.where(starting, counts, 1)])
        return pa.Table.from_batches([_pairs_out(keys, sums), tallied(shard, counts[real])])

    def store_pairs(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        none = {"part": pa.int32(), "kind": pa.string(), "shard": pa.int32(), "ids": pa.binary(), "sums": pa.binary(), "tally": pa.list_(pa.int64())}
        if shard < 0:
            tallies = [unpack_ints(x.as_py()).astype(np.int64).tolist() for x in group.column("words")]
            columns = ([-1] * len(tallies), ["grams"] * len(tallies), [t[0] for t in tallies], [None] * len(tallies), [None] * len(tallies), [t[1:] for t in tallies])
            return pa.table({name: pa.array(x, none[name]) for name, x in zip(none, columns)})
        keys, counts = _unpacked(group)
        keys, counts = merge([keys], [counts])
        hashed = mix(keys)
        at = np.argsort(hashed)
        write_array(f"{uri}/pairs-{shard}", pack_table(hashed[at] << _U(gram_bits), counts[at, None]))
        ones, zeros = np.ones(len(keys), np.int64), np.zeros(len(keys), np.int64)
        after = np.stack([counts == 1, counts == 2, counts > 2, counts, zeros], axis=1).astype(np.int64)
        ids, sums = merge([keys >> _U(32), keys & _U(0xFFFFFFFF)], [after, np.stack([zeros, zeros, zeros, zeros, ones], axis=1)])
        part = (ids >> _U(RANGE_BITS)).astype(np.int64)
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, int)
        cuts = list(zip(first, np.append(first, len(part))[1:]))
        columns = (
            [-1, *part[first].tolist()],
            ["pairs"] * (len(first) + 1),
            [shard] * (len(first) + 1),
            [None, *(pack_ints(ids[a:b], True) for a, b in cuts)],
            [None, *(pack_ints(sums[a:b].T.reshape(-1)) for a, b in cuts)],
            [_of_counts(counts), *([None] * len(first))],
        )
        return pa.table({name: pa.array(x, none[name]) for name, x in zip(none, columns)})

    grams = texts.mapInArrow(tidied(count_grams), _BLOBS)
    if order == 3:
        grams = grams.groupBy("shard").applyInArrow(store_grams, _BLOBS)
    sums_schema = "part int, kind string, shard int, ids binary, sums binary, tally array<bigint>"
    partial = scratch.save(grams.groupBy("shard").applyInArrow(store_pairs, sums_schema), "partial")
    tallies = partial.where("part < 0").select("kind", "shard", "tally").toArrow().to_pylist()

    def summed(kind: str) -> list[int]:
        return [sum(r["tally"][k] for r in tallies if r["kind"] == kind) for k in range(6)]

    for kind in ("pairs", "grams", "contexts"):
        has = np.zeros(1 << gram_bits, bool)
        has[[r["shard"] for r in tallies if r["kind"] == ("pairs" if kind == "pairs" else "grams") and r["tally"][5]]] = True
        model.gram_shards[kind] = has
    model.pairs = summed("pairs")[5]
    model.discounts = {2: _discounts(summed("pairs")), 3: _discounts(summed("grams"))}
    top = model.words + 2

    def added(batches: Iterator[pa.RecordBatch]) -> tuple[int, int, np.ndarray]:
        """A part of the word ids, a shard of those added, and the dense sums."""
        part, shard, dense = 0, 0, None
        for batch in batches:
            for row in batch.select(["part", "shard", "ids", "sums"]).to_pylist():
                part, shard = row["part"], row["shard"]
                if dense is None:
                    dense = np.zeros((min(1 << RANGE_BITS, top - (part << RANGE_BITS)), 5), np.int64)
                dense[unpack_ints(row["ids"], True).astype(np.int64) - (part << RANGE_BITS)] += unpack_ints(row["sums"]).astype(np.int64).reshape(5, -1).T
        return part, shard, dense

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, dense = added(batches)
        ids = np.flatnonzero(dense.any(axis=1))
        columns = [part, "pairs", shard >> FAN_BITS, pack_ints(ids + (part << RANGE_BITS), True), pack_ints(dense[ids].T.reshape(-1)), None]
        kinds = [pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(columns, kinds)], ["part", "kind", "shard", "ids", "sums", "tally"])

    def store_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, _, dense = added(batches)
        write_array(f"{uri}/statistics-{part}", dense.astype(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()) for n in _of_counts(dense[:, 4])], [f"t{k}" for k in range(6)])

    sums, held, level = partial.where("part >= 0"), gram_bits, 0
    while held > FAN_BITS:  # frequent words have sums in every shard: add them up by tiers
        sums = scratch.save(sums.groupBy("part", F.shiftright("shard", FAN_BITS)).applyInArrow(combine, sums_schema), f"sums{level}")
        held, level = held - FAN_BITS, level + 1
    lower = sums.groupBy("part").applyInArrow(store_statistics, ", ".join(f"t{k} bigint" for k in range(6)))
    t = list(lower.agg(*[F.sum(f"t{k}").alias(f"t{k}") for k in range(6)]).first())
    scratch.drop("partial", *(f"sums{k}" for k in range(level)))
    model.discounts[1] = d = _discounts(t)
    model.lower_rest = (d[0] * t[0] + d[1] * t[1] + d[2] * t[4]) / model.pairs
    return model


def _before_last(before: np.ndarray, start: np.ndarray, begin: int) -> np.ndarray:
    """The ids two before each token; the begin mark where there is none."""
    out = np.empty_like(before)
    out[1:] = before[:-1]
    out[start[:-1]] = begin
    return out


def _less(counts: np.ndarray, discount: tuple[float, float, float]) -> np.ndarray:
    """Counts less their discounts; 0 stays 0."""
    return counts - np.array([0.0, *discount])[np.minimum(counts, 3)]


def _interpolated(counts: np.ndarray, sums: np.ndarray, discount: tuple[float, float, float], lower: np.ndarray) -> np.ndarray:
    """Probabilities from counts, the contexts' sums (once, twice, more often, total) and those of the order below."""
    return (_less(counts, discount) + (sums[:, :3] @ np.array(discount)) * lower) / sums[:, 3]


def score_block(m: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By row: tokens, known tokens, base score, model score."""
    ids, before, counts, start = _tokens(m, data, offsets)
    base = np.log10(counts + 1.0) - np.log10(m.tokens + m.types + 1.0)
    p = np.full(len(ids), m.lower_rest / (m.types + 1.0))
    if m.docs:
        unique, back = np.unique(np.concatenate([ids, before[start[:-1]]]), return_inverse=True)
        known = unique >= 0
        stats = np.zeros((len(unique), 5), np.int64)
        stats[known] = m.statistics(unique[known])
        p += (_less(stats[:, 4], m.discounts[1]) / m.pairs)[back[: len(ids)]]
        # A token's predecessor is the token before it, or the begin mark.
        prior = np.empty(len(ids), np.int64)
        prior[1:] = back[: len(ids) - 1]
        prior[start[:-1]] = back[len(ids) :]
        seen = np.flatnonzero(before >= 0)
        both = seen[ids[seen] >= 0]
        times = np.zeros(len(ids), np.int64)
        times[both] = m.pair_counts(before[both], ids[both])
        p[seen] = _interpolated(times[seen], stats[prior[seen]], m.discounts[2], p[seen])
        if m.order == 3:
            first = _before_last(before, start, -1)
            at = np.flatnonzero((first >= 0) & (before >= 0))
            pair = _pair(first[at], before[at])
            sums = m.contexts(pair)
            met = np.flatnonzero(sums[:, 3])
            at, pair, sums = at[met], pair[met], sums[met]
            times = np.zeros(len(at), np.int64)
            both = np.flatnonzero(ids[at] >= 0)
            times[both] = m.gram_counts(pair[both], ids[at[both]])
            p[at] = _interpolated(times, sums, m.discounts[3], p[at])
    add = lambda x: np.add.reduceat(x, start[:-1])  # noqa: E731  every row has its end
    return np.diff(start), add((counts > 0).astype(np.int64)), add(base), add(np.log10(p))


def score(spark: SparkSession, docs: DataFrame, model: Model, keep: list[Column | str] | None = None) -> DataFrame:
    """Columns ``keep`` of docs with n_tokens, n_known, base_score and score (log10); a null text is empty.

    Every row is scored by itself, whatever its doc_id.  ``keep`` may not have
    the result's names or _n_text; other columns of docs may.
    """
    refuse_clash(keep, "n_tokens", "n_known", "base_score", "score", "_n_text")
    kept = docs.select(*(keep or ["doc_id"]), F.col("text").alias("_n_text"))
    names = kept.columns[:-1]
    shared = spark.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column("_n_text"))
            parts = [score_block(m, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in blocks(offsets, BLOCK)]
            columns = [pa.array(np.concatenate(x)) for x in zip(*parts)] if parts else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(names))), *columns], [*names, "n_tokens", "n_known", "base_score", "score"])

    return kept.mapInArrow(tidied(run), f"{schema}, n_tokens bigint, n_known bigint, base_score double, score double")

"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark items are normalised to words (A-Z lower-cased; a word is a run of
ASCII letters, digits and non-ASCII characters) and cut into windows of 13
words.  The automaton holds each window as its words joined and fenced by single
spaces, so a match begins and ends at word edges.  A text is normalised the same
way with one byte table and scanned once; positions map back to words by the
spaces before them, and from words to code points of the original text.

The automaton is shared by broadcast.  Its size follows the benchmark, not the
documents, and is checked: items are dealt into blocks of at most
``max_pattern_bytes``; more than one block means one scan a block, without a shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import cache, tidied, utf8

WINDOW = 13
MAX_PATTERN_BYTES = 16 << 20

# Word bytes are digits, letters and everything from 0x80; all else separates.
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if _WORD[b] else 0x20 for b in range(256))
_LEAD = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point


def words(text: str | bytes | None) -> list[bytes]:
    """The normalised words of a text as UTF-8; null has none."""
    raw = (text or "").encode() if not isinstance(text, bytes) else text
    return raw.translate(_FOLD).split()


def windows(item: list[bytes], width: int = WINDOW) -> list[bytes]:
    """Fenced patterns: every run of ``width`` words, or all words of a shorter item."""
    if not item:
        return []
    n = max(1, len(item) - width + 1)
    return [b" " + b" ".join(item[i : i + width]) + b" " for i in range(n)]


def pattern_blocks(items: list[tuple[str, str | None]], width: int, limit: int) -> list[list[tuple[str, list[int]]]]:
    """Blocks of (pattern, positions of the items that have it); items are kept in order."""
    found: list[dict[bytes, list[int]]] = [{}]
    held = 0
    for k, (_, text) in enumerate(items):
        for pattern in dict.fromkeys(windows(words(text), width)):
            if pattern not in found[-1] and held + len(pattern) > limit and found[-1]:
                found.append({})
                held = 0
            if pattern not in found[-1]:
                held += len(pattern)
            found[-1].setdefault(pattern, []).append(k)
    return [[(p.decode("latin-1"), ids) for p, ids in block.items()] for block in found if block]


_BUILT: dict[object, ahocorasick.Automaton] = cache("decontaminate")


def _automaton(key: object, patterns: list[tuple[str, list[int]]]) -> ahocorasick.Automaton:
    """Built once in each worker."""
    if key not in _BUILT:
        _BUILT.clear()
        made = ahocorasick.Automaton()
        for pattern, ids in patterns:
            made.add_word(pattern, (len(pattern), pattern.count(" ") - 1, ids))
        made.make_automaton()
        _BUILT[key] = made
    return _BUILT[key]


def scan(raw: bytes, automaton: ahocorasick.Automaton) -> tuple[int, list[tuple[int, int]], list[int]]:
    """Words of the text, its hit word ranges (merged, half open), items found."""
    parts = raw.translate(_FOLD).split()
    if not parts:
        return 0, [], []
    text = " " + b" ".join(parts).decode("latin-1") + " "
    spans, found = [], set()
    edges: np.ndarray | None = None  # where the spaces are: a word's number is that of spaces before its own
    for end, (length, n, ids) in automaton.iter(text):
        if edges is None:
            edges = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 0x20)
        first = int(np.searchsorted(edges, end - length + 1))
        spans.append((first, first + n))
        found.update(ids)
    return len(parts), merge_ranges(spans), sorted(found)


def merge_ranges(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open ranges in order, those that meet joined."""
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def original_spans(raw: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point ranges in the original text of ranges of words."""
    data = np.frombuffer(raw, np.uint8)
    word = _WORD[data]
    first = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
    last = np.flatnonzero(word & ~np.concatenate([word[1:], [False]])) + 1
    points = np.concatenate([[0], np.cumsum(_LEAD[data])])
    return [(int(points[first[a]]), int(points[last[b - 1]])) for a, b in ranges]


SCHEMA = "n_words bigint, hit_words array<struct<first:bigint,end:bigint>>, hit_spans array<struct<first:bigint,end:bigint>>, items array<string>"
_SPAN = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def find_contamination(
    spark: SparkSession,
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str] | None = None,
    window: int = WINDOW,
    max_pattern_bytes: int = MAX_PATTERN_BYTES,
    max_items: int = 1_000_000,
) -> DataFrame:
    """Columns ``keep`` of docs with n_words, hit_words, hit_spans and items.

    ``hit_words`` are merged ranges of word numbers, ``hit_spans`` the same in
    code points of the original text, ``items`` the ids (as strings, sorted) of
    the items of which a window occurs.  Null and empty texts have no words;
    items without words match nothing; an empty benchmark hits nothing.
    Repeated items count under each of their ids.  The benchmark comes to the
    driver: more than ``max_items`` items is an error.
    """
    keep = keep or ["doc_id"]
    clash = set(keep) & {"n_words", "hit_words", "hit_spans", "items"}
    if clash:
        raise ValueError(f"keep has result columns: {clash}")
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), "text").limit(max_items + 1).collect()
    if len(rows) > max_items:
        raise ValueError(f"the benchmark has more than {max_items} items")
    items = sorted(((r["i"] if r["i"] is not None else "", r["text"]) for r in rows), key=lambda x: (x[0], x[1] or ""))
    names = [i for i, _ in items]
    blocks = pattern_blocks(items, window, max_pattern_bytes) or [[]]

    columns = [*dict.fromkeys([*keep, "text"])]
    text_of = docs.select(*columns)
    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in text_of.schema)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def pass_over(rows: DataFrame, block: list[tuple[str, list[int]]], first: bool, last: bool) -> DataFrame:
        """One scan; what earlier blocks found comes along in two columns, and the text until the last."""
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, block, names))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, patterns, ids = shared.value
            machine = _automaton(key, patterns) if patterns else None
            for batch in batches:
                data, offsets = utf8(batch.column("text"))
                count, ranges, spans, found = [], [], [], []
                for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    raw = data[a:b].tobytes()
                    n, hit, which = scan(raw, machine) if machine else (len(words(raw)), [], [])
                    items = {ids[x] for x in which}
                    if not first:
                        hit = merge_ranges([*hit, *((x["first"], x["end"]) for x in batch.column("hit_words")[k].as_py())])
                        items.update(batch.column("items")[k].as_py())
                    count.append(n)
                    ranges.append([{"first": x, "end": y} for x, y in hit])
                    spans.append([{"first": x, "end": y} for x, y in original_spans(raw, hit)] if hit and last else [])
                    found.append(sorted(items))
                out = [pa.array(count, pa.int64()), pa.array(ranges, _SPAN), pa.array(spans, _SPAN), pa.array(found, pa.list_(pa.string()))]
                own = keep if last else columns
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *out], [*own, "n_words", "hit_words", "hit_spans", "items"])

        return rows.mapInArrow(tidied(run, "decontaminate"), f"{kept if last else given}, {SCHEMA}")

    found = text_of
    for k, block in enumerate(blocks):
        found = pass_over(found, block, k == 0, k == len(blocks) - 1)
    return found


def hit_count() -> Column:
    """Hit words of a row of ``find_contamination``."""
    return F.aggregate("hit_words", F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["first"])


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """Hit words are a twentieth of all words or more."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


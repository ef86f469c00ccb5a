"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, runs of non-letters become one space, and every
character 1-, 2- and 3-gram falls into one of 2^15 buckets.  Counts by language
and bucket are summed over all training rows (each partition adds its own up
first), the smoothed log-probability matrix is broadcast, and texts are scored
in numpy: only the rows of the matrix that a text touches are gathered and added.
A long text is read in parts that carry two characters over, so memory doesn't
follow its length.

The matrix has ``buckets`` x languages numbers; more than ``MAX_LANGUAGES``
languages are refused, which bounds what is collected and broadcast.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import blocks, tidied, utf8
from .scratch import Scratch, refuse_clash

BUCKETS = 1 << 15
ALPHA = 0.1
MAX_LANGUAGES = 256
BLOCK = 1 << 20
UNDETERMINED = "und"

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def ngrams(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the rows, the row of each, in row order, and which rows have a letter."""
    rows = len(offsets) - 1
    raw = data.tobytes().replace(b"\0", b" ")
    at = offsets.tolist()
    text = "\0" + "\0".join(raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])) + "\0"
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = points == 0
    letter = _letters()[points]
    keep = letter | edge
    keep[1:] |= letter[:-1]
    row = np.cumsum(edge) - 1
    has = np.zeros(rows + 1, bool)
    has[row[letter]] = True
    c = np.where(letter, points, np.uint32(32))[keep]
    edge, row = edge[keep], row[keep]
    middle = np.flatnonzero(~edge)
    if not len(middle):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), has[:rows]
    grams = _buckets(c[middle - 1], c[middle], c[middle + 1], buckets)
    return grams, np.repeat(row[middle], 3), has[:rows]


def _buckets(a: np.ndarray, b: np.ndarray, d: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of b, of a b and of a b d, in turn."""
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    with np.errstate(over="ignore"):
        one = b * np.uint32(0x85EBCA6B) + np.uint32(0x27D4EB2F)
        two = one * np.uint32(0xC2B2AE35) ^ (a * np.uint32(0x9E3779B1) + np.uint32(1))
        three = (two * np.uint32(0x165667B1)) ^ (d * np.uint32(0x2545F491) + np.uint32(7))
        spread = lambda h: ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> shift
        grams = np.stack([spread(one), spread(two), spread(three)], axis=1).reshape(-1)
    return grams.astype(np.int64)


def _cut(raw: bytes, at: int, limit: int) -> int:
    """A place to cut at: after the last space of a part, else between code points."""
    end = min(at + limit, len(raw))
    if end == len(raw):
        return end
    space = raw.rfind(b" ", at, end) + 1
    if space > at:
        return space
    while end > at and raw[end] & 0xC0 == 0x80:
        end -= 1
    return end


def long_ngrams(raw: bytes, buckets: int = BUCKETS, limit: int = BLOCK) -> Iterator[tuple[np.ndarray, bool]]:
    """The buckets of ``ngrams`` of one text, part by part, and whether a part has a letter."""
    at, held, after_letter = 0, np.array([32], np.uint32), False
    while at < len(raw):
        end = _cut(raw, at, limit)
        text = raw[at:end].replace(b"\0", b" ").decode("utf-8", "replace").lower()
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[points]
        keep = letter.copy()
        keep[0] |= after_letter
        keep[1:] |= letter[:-1]
        after_letter = bool(letter[-1])
        c = np.concatenate([held, np.where(letter, points, np.uint32(32))[keep]])
        yield _buckets(c[:-2], c[1:-1], c[2:], buckets), bool(letter.any())
        held, at = c[-2:], end
    c = np.append(held, np.uint32(32))
    yield _buckets(c[:-2], c[1:-1], c[2:], buckets), False


def _parts(data: np.ndarray, offsets: np.ndarray, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For ranges i to j of rows, or for parts of one long row: i, j, buckets, the row of each, which rows have a letter."""
    for i, j in blocks(offsets, BLOCK):
        part = data[offsets[i] : offsets[j]]
        if j - i == 1 and len(part) > 2 * BLOCK:
            for grams, has in long_ngrams(part.tobytes(), buckets):
                yield i, j, grams, np.zeros(len(grams), np.int64), np.array([has])
        else:
            yield i, j, *ngrams(part, offsets[i : j + 1] - offsets[i], buckets)


@dataclass
class Model:
    """Languages in order, and log-probabilities (buckets x languages); log priors."""

    languages: list[str]
    matrix: np.ndarray
    prior: np.ndarray


def train(spark: SparkSession, labelled: DataFrame, buckets: int = BUCKETS, alpha: float = ALPHA) -> Model:
    """A model from the columns text and lang; rows with null lang or no letter teach nothing.

    Repeated rows count each time; other columns are not read.  The texts are
    read once: the counts, at most a row for each language and bucket, are
    written before the languages are counted.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            heard = np.zeros(batch.num_rows, bool)
            for i, j, grams, row, has in _parts(data, offsets, buckets):
                names, which = np.unique(langs[i:j].astype(str), return_inverse=True)
                flat = np.bincount(which[row] * buckets + grams, minlength=len(names) * buckets).reshape(len(names), buckets)
                heard[i:j] |= has
                for k, name in enumerate(names.tolist()):
                    total[name] = total.get(name, 0) + flat[k]
            for name, n in zip(*np.unique(langs[heard].astype(str), return_counts=True)):
                seen[str(name)] = seen.get(str(name), 0) + int(n)
        for name, sums in total.items():
            hit = np.flatnonzero(sums)
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([name] * (len(hit) + 1)),
                    "bucket": pa.array(np.append(hit, -1), pa.int32()),
                    "n": pa.array(np.append(sums[hit], seen.get(name, 0)), pa.int64()),
                }
            )

    scratch = Scratch(spark, "langid")
    rows = scratch.save(
        labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
        .select("text", "lang")
        .mapInArrow(tidied(count), "lang string, bucket int, n bigint")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n")),
        "counts",
    )
    languages = sorted(r["lang"] for r in rows.where("bucket = -1 AND n > 0").select("lang").limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not languages:
        return Model([], np.zeros((buckets, 0), np.float32), np.zeros(0))
    collected = rows.where(F.col("lang").isin(languages)).toArrow()
    scratch.close()
    number = {name: k for k, name in enumerate(languages)}
    counts = np.zeros((buckets, len(languages)))
    docs = np.zeros(len(languages))
    lang = np.array([number.get(x, -1) for x in collected.column("lang").to_pylist()])
    bucket, n = collected.column("bucket").to_numpy(), collected.column("n").to_numpy()
    use = (lang >= 0) & (bucket >= 0)
    counts[bucket[use], lang[use]] = n[use]
    use = (lang >= 0) & (bucket < 0)
    docs[lang[use]] = n[use]
    matrix = np.log(counts + alpha) - np.log(counts.sum(0) + alpha * buckets)
    return Model(languages, matrix.astype(np.float32), np.log(docs / docs.sum()))


def predict(spark: SparkSession, docs: DataFrame, model: Model, keep: list[Column | str] | None = None) -> DataFrame:
    """Columns ``keep`` of docs with lang_pred and score, the posterior probability.

    A text that is null or has no letter is ``und`` with score 0; so is every
    text where the model has no language.  Ties go to the first language.  Every
    row is scored by itself, whatever its doc_id.  ``keep`` may not have the
    result's names or _lang_text; other columns of docs may.
    """
    refuse_clash(keep, "lang_pred", "score", "_lang_text")
    kept = docs.select(*(keep or ["doc_id"]), F.col("text").alias("_lang_text"))
    names = kept.columns[:-1]
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, model))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, m = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column("_lang_text"))
            best = np.full(batch.num_rows, -1)
            sure = np.zeros(batch.num_rows)
            sums = np.tile(m.prior, (batch.num_rows, 1))
            heard = np.zeros(batch.num_rows, bool)
            for i, j, grams, row, has in _parts(data, offsets, len(m.matrix)):
                heard[i:j] |= has
                for lo in range(0, len(grams), 1 << 21):
                    r = row[lo : lo + (1 << 21)]
                    first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
                    sums[i + r[first]] += np.add.reduceat(m.matrix[grams[lo : lo + (1 << 21)]], first, axis=0, dtype=np.float64)
            if len(m.languages):
                best = np.where(heard, sums.argmax(1), -1)
                sure = np.where(heard, 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1), 0.0)
            labels = pa.array([*m.languages, UNDETERMINED]).take(pa.array(np.where(best < 0, len(m.languages), best)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(names))), labels, pa.array(sure)], [*names, "lang_pred", "score"])

    return kept.mapInArrow(tidied(score), f"{schema}, lang_pred string, score double")

"""Near-duplicates by MinHash with banding, signature checks and connected components.

1. One pass over the texts gives each document's number of distinct word
   shingles, a 128-bit hash of the set, and 128 universal-hash minima, kept as
   16 bits each: 32 longs of four minima, which are also the band keys.
2. Documents with equal sets form a class; only the class's least doc_id goes on.
3. Classes that share a band key meet in a bucket.  Each bucket links its members
   to a hub, not to each other: the member that meets most others in all bands,
   which among copies tends to be what they were copied from.
4. Candidates pass a check of their signatures, then are confirmed on the full
   sets.  Confirmed links give components.
5. Buckets that still span several components may hide links between members that
   are no hubs.  Their members' shingles are put in one order, rarest first by a
   sketch of frequencies; linked sets share one of the first few in that order (a
   prefix, whose length follows from the sizes and the similarity).  Members whose
   prefixes nobody of another component shares have no such link and leave, so that
   documents with much text in common, but little else, are no work.  Of the rest
   those outside the bucket's main component are held against all others in tiles
   of bounded size, each pair in the first band where it meets, by size and
   signature, then on their sets; tiles emit only links.  No link is lost to step 3,
   and rows don't grow with the pairs of a group.

With 32 bands of 4 a pair of similarity 0.8 meets in none with probability 5e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .kernels import blocks, distinct_by_row, hash_words, mix, row_of, shingles, tidied, utf8
from .scratch import Scratch

WIDTH = 5
PERCENT = 80
BANDS, ROWS = 32, 4
BLOCK = 1 << 21
#: Six standard errors below the threshold: a linked pair agrees less with probability 1e-9.
LEAST_AGREEMENT = 75
BROADCAST_IDS = 1_000_000

TILE, TILE_SHINGLES = 1024, 1 << 20
GATHERED = 1 << 21
SKETCH_BITS, SKETCH_CHUNK_BITS = 21, 15

_RNG = np.random.default_rng(77003)
_A = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row and their first indexes."""
    hashes, _, _, index = hash_words(data, offsets)
    return distinct_by_row(*shingles(hashes, index, width))


def signatures(values: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Minima of the hash functions x -> a x + b (rows x 128), 16 bits each; empty rows are zero."""
    out = np.zeros((len(index) - 1, BANDS * ROWS), np.uint16)
    full = np.flatnonzero(np.diff(index))
    if not len(full):
        return out
    start = index[full]
    x = (values >> np.uint64(32)).astype(np.uint32)
    # Rows in runs that fit a cache; a longer row is a run of its own.
    for lo, hi in blocks(np.append(start, len(x)), 1 << 15, 1 << 15):
        part = x[start[lo] : start[hi] if hi < len(start) else len(x)]
        at = start[lo:hi] - start[lo]
        with np.errstate(over="ignore"):
            for k in range(BANDS * ROWS):
                least = np.minimum.reduceat(part * _A[k] + _B[k], at)
                least = (least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                out[full[lo:hi], k] = (least ^ (least >> np.uint32(12))) >> np.uint32(16)
    return out


def profile(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, sig); sig is null where there are no shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, j in blocks(offsets, BLOCK):
                values, index = sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                n = np.diff(index)
                with np.errstate(over="ignore"):
                    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ np.uint64(s)), dtype=np.uint64)]) for s in (0x1234567, 0x7654321)]
                    a, b = (s[index[1:]] - s[index[:-1]] for s in sums)
                lanes = signatures(values, index).view(np.int64).reshape(-1)
                sig = pa.ListArray.from_arrays(pa.array(np.arange(0, len(lanes) + 1, BANDS, dtype=np.int32)), pa.array(lanes))
                sig = pa.compute.if_else(pa.array(n > 0), sig, pa.scalar(None, sig.type))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(n), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), sig],
                    ["doc_id", "n_shingles", "set_a", "set_b", "sig"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        tidied(run), "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, sig array<bigint>"
    )


def _agreement(a: str, b: str) -> Column:
    """Equal minima of two signatures."""
    lane = lambda x, k: F.when(F.shiftright(x, 16 * k).bitwiseAND(F.lit(0xFFFF)) == 0, 1).otherwise(0)
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0), lambda n, x: n + lane(x, 0) + lane(x, 1) + lane(x, 2) + lane(x, 3)
    )


def confirm(pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of pairs (a, b, text_a, text_b) those with 100 * shared >= percent * united, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (da, oa), (db, ob) = utf8(batch.column("text_a")), utf8(batch.column("text_b"))
            hit = np.zeros(batch.num_rows, bool)
            for i, j in blocks(oa + ob, BLOCK):
                va, ia = sets(da[oa[i] : oa[j]], oa[i : j + 1] - oa[i], width)
                vb, ib = sets(db[ob[i] : ob[j]], ob[i : j + 1] - ob[i], width)
                key = np.concatenate([(row_of(x).astype(np.uint64) << np.uint64(48)) | (v >> np.uint64(16)) for v, x in ((va, ia), (vb, ib))])
                key.sort()
                same = key[1:][key[1:] == key[:-1]]
                shared = np.bincount((same >> np.uint64(48)).astype(np.int64), minlength=j - i)
                united = np.diff(ia) + np.diff(ib) - shared
                hit[i:j] = (100 * shared >= percent * united) & (united > 0)
            keep = pa.array(hit)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(tidied(run), "a bigint, b bigint")


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of docs (doc_id, text), a row for each row.

    A text of fewer words than ``width`` has one shingle, all its words; null and
    empty texts have none and are linked with nothing.  component_id is the least
    doc_id reachable over links of ``percent`` or more; kept marks that document.
    Rows that share a doc_id count as one document.  A null doc_id is linked with
    nothing and kept, with a null component_id.
    """
    scratch = Scratch(spark, "minhash")
    prof = scratch.save(profile(docs, width), "profile")
    some = prof.where("n_shingles > 0 AND doc_id IS NOT NULL")
    key = ["set_a", "set_b", "n_shingles"]
    classes = scratch.save(some.groupBy(*key).agg(F.min("doc_id").alias("rep")), "classes")
    members = some.join(classes, key).select("doc_id", "n_shingles", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("sig")).alias("sig"))
    alone = prof.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("rep"), F.lit(None).cast("array<bigint>").alias("sig"))
    members = scratch.save(members.unionByName(alone), "members")
    scratch.drop("profile", "classes")
    sigs = members.where("sig IS NOT NULL").select(F.col("rep").alias("id"), F.col("n_shingles").alias("size"), "sig")

    bands = sigs.select("id", F.posexplode("sig").alias("band", "key"))
    buckets = bands.groupBy("band", "key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"))
    buckets = scratch.save(buckets.where("first <> last").select("band", "key", "n"), "buckets")
    met = scratch.save(bands.join(buckets, ["band", "key"]), "met")
    involved = scratch.save(met.select("id").distinct(), "involved")
    few = involved.count() <= BROADCAST_IDS
    texts = scratch.save(
        docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").join(F.broadcast(involved) if few else involved, "id", "left_semi"), "texts"
    )
    sigs = scratch.save(sigs.join(F.broadcast(involved) if few else involved, "id", "left_semi"), "sigs")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        one = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
        two = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
        return scratch.save(confirm(pairs.join(one, "a").join(two, "b"), width, percent), name)

    # Hubs: of each bucket the member that meets most others over all bands.
    meets = scratch.save(met.groupBy("id").agg(F.sum("n").alias("meets")), "meets")
    ranked = scratch.save(met.join(meets, "id").select("band", "key", "id", F.struct("meets", (-F.col("id")).alias("least")).alias("rank")), "ranked")
    hubs = scratch.save(ranked.groupBy("band", "key").agg(F.max("rank").alias("hub")), "hubs")
    tested = ranked.join(hubs, ["band", "key"]).select(F.col("id").alias("a"), (-F.col("hub.least")).alias("b")).where("a <> b").distinct()
    one = sigs.select(F.col("id").alias("a"), F.col("sig").alias("sig_a"))
    two = sigs.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"))
    near = tested.join(one, "a").join(two, "b").where(_agreement("sig_a", "sig_b") >= LEAST_AGREEMENT).select("a", "b")
    edges = confirmed(scratch.save(near, "near"), "edges")
    component = connected_components(spark, edges, scratch, "component")
    apart = _apart(scratch, met, component, sigs, texts, width, percent)
    if apart is not None:
        edges = edges.unionByName(confirmed(scratch.save(apart, "apart"), "more"))
        component = connected_components(spark, edges, scratch, "whole")
    scratch.drop("buckets", "met", "involved", "texts", "sigs", "meets", "ranked", "hubs", "near", "edges", "named", "mixed", "inside", "packed", "prefixes", "able", "apart", "more")
    labels = component.select(F.col("node").alias("rep"), "component")
    joined = members.drop("sig").join(labels, "rep", "left")
    found = F.coalesce("component", "rep")
    return joined.select(
        "doc_id", "n_shingles", found.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == found)).alias("kept")
    )


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document left of each component, the one of the least doc_id.

    The ids that go are broadcast if they are few, else joined by a shuffle.
    """
    scratch = Scratch(spark, "dropped")
    found = near_duplicates(spark, docs.select("doc_id", "text"), width, percent)
    gone = scratch.save(found.where(~F.col("kept")).select("doc_id").distinct(), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(*docs.columns)


def _packed_sets(texts: DataFrame, width: int) -> DataFrame:
    """(id, shingles) of texts (id, text): 32 bits of each shingle's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, j in blocks(offsets, BLOCK):
                values, index = sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                short = (values >> np.uint64(32)).astype(np.uint32)
                packed = [short[a:b].tobytes() for a, b in zip(index[:-1].tolist(), index[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array(packed, pa.binary())], ["id", "shingles"])

    return texts.select("id", "text").mapInArrow(tidied(run), "id bigint, shingles binary")


def _frequencies(packed: DataFrame) -> np.ndarray:
    """How often shingles occur by the upper bits of their hash, on a logarithmic scale of 8 bits."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            values = utf8(batch.column("shingles"))[0].view(np.uint32)
            for lo in range(0, len(values), GATHERED):
                sums += np.bincount(values[lo : lo + GATHERED] >> np.uint32(32 - SKETCH_BITS), minlength=len(sums))
        parts = sums.reshape(-1, 1 << SKETCH_CHUNK_BITS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([pa.compress(p.tobytes(), "zstd", asbytes=True) for p in parts], pa.binary())], ["chunk", "sums"]
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, sums = 0, np.zeros(1 << SKETCH_CHUNK_BITS, np.int64)
        for batch in batches:
            chunk = batch.column("chunk")[0].as_py()
            for blob in batch.column("sums"):
                sums += np.frombuffer(pa.decompress(blob.as_py(), sums.nbytes, "zstd", asbytes=True), np.int64)
        scale = np.minimum(255, np.ceil(8 * np.log2(sums + 1.0))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([scale.tobytes()], pa.binary())], ["chunk", "scale"])

    rows = packed.select("shingles").mapInArrow(tidied(count), "chunk int, sums binary").groupBy("chunk").applyInArrow(add, "chunk int, scale binary").collect()
    out = np.zeros((1 << SKETCH_BITS - SKETCH_CHUNK_BITS, 1 << SKETCH_CHUNK_BITS), np.uint8)
    for r in rows:
        out[r["chunk"]] = np.frombuffer(r["scale"], np.uint8)
    return out.reshape(-1)


ONCE = 8  # on the scale of _frequencies: no other shingle of that bucket


def prefixes(values: np.ndarray, index: np.ndarray, scale: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, least) of the shingles by which linked sets meet, those that occur once left out.

    Sets are in one order of shingles.  Of two linked sets the smaller, or either
    of two equal ones, has a shingle among its first n - ceil(2 p n / (100 + p)) + 1
    (``least``) that the larger has among its first n - ceil(p n / 100) + 1.
    """
    row, n = row_of(index), np.diff(index)
    frequent = scale[values >> np.uint32(32 - SKETCH_BITS)]
    order = np.lexsort((values, frequent, row))
    place = np.arange(len(values)) - index[row]
    small = n + (-(2 * percent * n) // (100 + percent)) + 1
    large = n + (-(percent * n) // 100) + 1
    held = values[order]
    again = np.append(False, (held[1:] == held[:-1]) & (row[1:] == row[:-1])) if len(held) else np.zeros(0, bool)
    take = (place < large[row]) & (frequent[order] > ONCE) & ~again
    return row[take], held[take], (place < small[row])[take]


def _postings(inside: DataFrame, scale: Broadcast, percent: int) -> DataFrame:
    """(shingle, id, comp) of the prefixes of sets (id, comp, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("shingles"))
            for i, j in blocks(offsets, BLOCK):
                index = (offsets[i : j + 1] - offsets[i]) // 4
                row, shingle, _ = prefixes(data[offsets[i] : offsets[j]].view(np.uint32), index, scale.value, percent)
                at = pa.array(row + i)
                yield pa.RecordBatch.from_arrays([pa.array(shingle.astype(np.int64)), batch.column("id").take(at), batch.column("comp").take(at)], ["shingle", "id", "comp"])

    return inside.select("id", "comp", "shingles").mapInArrow(tidied(run), "shingle bigint, id bigint, comp bigint")


def _linked(tile: pa.Table, percent: int) -> np.ndarray:
    """Pairs (a, b) of one tile that meet in no earlier band, lie in different components and share enough shingles."""
    ids, comps, chunks, size = (tile.column(c).to_numpy() for c in ("id", "comp", "chunk", "size"))
    band = tile.column("band")[0].as_py()
    lanes = pa.compute.list_flatten(tile.column("sig")).to_numpy().reshape(len(ids), BANDS)
    minima = lanes.view(np.uint16)
    sets_ = tile.column("shingles")
    held: dict[int, np.ndarray] = {}

    def shingles_of(k: int) -> np.ndarray:
        if k not in held:
            held[k] = np.sort(np.frombuffer(sets_[k].as_py(), np.uint32))
        return held[k]

    left, right = (np.flatnonzero(chunks == tile.column(c)[0].as_py()) for c in ("i", "j"))
    found = [np.zeros((0, 2), np.int64)]
    for k in left:
        may = right[(comps[right] != comps[k]) & (100 * np.minimum(size[right], size[k]) >= percent * np.maximum(size[right], size[k]))]
        may = may[(lanes[may] == lanes[k]).argmax(axis=1) == band]
        may = may[(minima[may] == minima[k]).sum(axis=1) >= LEAST_AGREEMENT]
        own = shingles_of(int(k)) if len(may) else None
        for lo, hi in blocks(np.concatenate([[0], np.cumsum(size[may])]), GATHERED, 1 << 30):
            part = may[lo:hi]
            every = np.concatenate([shingles_of(m) for m in part.tolist()])
            hit = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
            shared = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(size[part])[:-1]]))
            other = ids[part[100 * shared >= percent * (len(own) + size[part] - shared)]]
            found.append(np.stack([np.maximum(other, ids[k]), np.minimum(other, ids[k])], axis=1))
    return np.unique(np.concatenate(found), axis=0)


def _links(tiles: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of all tiles; tasks read them in turn and hold one at a time."""
    names = ["band", "key", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None  # rows of the tile that the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            key = np.stack([table.column(c).to_numpy().astype(np.int64) for c in names])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist()]
            found = [_linked(table.slice(a, b - a), percent) for a, b in zip(cuts[:-1], cuts[1:])]
            rest = table.slice(cuts[-1])
            if found:
                yield out(np.concatenate(found))
        if rest is not None:
            yield out(_linked(rest, percent))

    def out(pairs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return tiles.repartition(*names).sortWithinPartitions(*names).mapInArrow(tidied(run), "a bigint, b bigint")


def _apart(
    scratch: Scratch, met: DataFrame, component: DataFrame, sigs: DataFrame, texts: DataFrame, width: int, percent: int
) -> DataFrame | None:
    """Linked pairs (a, b) across the components of buckets; None where no bucket spans several.

    A bucket's main component is its largest.  Outsiders and main members are
    dealt by hash to chunks of about TILE rows and TILE_SHINGLES shingles; a tile
    holds a chunk of outsiders and one other chunk.
    """
    labels = component.select(F.col("node").alias("id"), "component")
    named = met.select("band", "key", "id").join(sigs.select("id", "size"), "id").join(labels, "id", "left")
    named = scratch.save(named.select("band", "key", "id", "size", F.coalesce("component", "id").alias("comp")), "named")

    def spanning(rows: DataFrame, *by: str) -> DataFrame:
        """The groups that span several components."""
        return rows.groupBy(*by).agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select(*by)

    inside = scratch.save(named.join(spanning(named, "band", "key"), ["band", "key"], "left_semi").select("id", "comp").distinct(), "inside")
    if inside.isEmpty():
        return None
    packed = scratch.save(_packed_sets(texts.join(inside.select("id"), "id", "left_semi"), width).join(inside, "id"), "packed")
    scale = scratch.spark.sparkContext.broadcast(_frequencies(packed))
    every = scratch.save(_postings(packed, scale, percent), "prefixes")
    able = scratch.save(every.join(spanning(every, "shingle"), "shingle", "left_semi").select("id").distinct(), "able")
    named = named.join(able, "id", "left_semi")
    parts = named.groupBy("band", "key", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    mixed = parts.groupBy("band", "key").agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "comp", "size")).alias("main")
    )
    chunks = lambda n, size: F.greatest(F.ceil(n / TILE), F.ceil(size / TILE_SHINGLES)).cast("int")
    mixed = scratch.save(
        mixed.where("k > 1").select(
            "band",
            "key",
            F.col("main.comp").alias("main"),
            chunks(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")).alias("outer"),
            chunks(F.col("main.n"), F.col("main.size")).alias("inner"),
        ),
        "mixed",
    )
    outsider = F.col("comp") != F.col("main")
    spread = lambda n: F.pmod(F.xxhash64("id", F.lit(5)), n).cast("int")
    dealt = named.join(mixed, ["band", "key"]).withColumn("chunk", F.when(outsider, spread(F.col("outer"))).otherwise(F.col("outer") + spread(F.col("inner"))))
    others = F.sequence(F.lit(0), F.when(outsider, F.col("outer") + F.col("inner") - 1).otherwise(F.col("outer") - 1))
    tiles = dealt.select("band", "key", "id", "comp", "size", "chunk", F.explode(others).alias("other")).select(
        "band", "key", "id", "comp", "size", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j")
    )
    return _links(tiles.join(sigs.select("id", "sig"), "id").join(packed.select("id", "shingles"), "id"), percent).distinct()

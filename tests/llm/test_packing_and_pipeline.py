"""Packing against the tokenizer itself, and every stage of the pipeline on its own input."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from siltstone.llm import packing
from siltstone.llm.scratch import Scratch

from .conftest import SF
from .test_text_operators import brute_hits, brute_lines, brute_near, key, lists

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute_pieces(rows):
    tokenizer = Tokenizer.from_file(PATH)
    out = []
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out += [(i, n, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for n, s in enumerate(range(0, len(ids), 2048))]
    return sorted(out, key=key)


def well_packed(rows):
    """Rows of (sequence_id, offset, length) fill sequences without gaps; the number of sequences."""
    held = {}
    for s, offset, length in sorted(rows):
        assert offset == held.get(s, 0)
        held[s] = offset + length
    assert not held or max(held.values()) <= 2048
    return len(held)


@pytest.mark.parametrize("which", ["odd", "documents", "none"])
def test_packing(spark, which, request):
    docs = request.getfixturevalue(which)
    pieces = packing.token_pieces(docs.withColumn("piece", F.lit(1)), PATH)
    got = packing.pack(spark, pieces, ["doc_id", "piece", "ids_crc32"]).collect()
    assert sorted((tuple(r)[:5] for r in got), key=key) == brute_pieces(lists(docs))
    used = well_packed([(r.sequence_id, r.offset, r.length) for r in got])
    least = -(-sum(r.length for r in got) // 2048)
    assert used <= max(least + 1, int(1.02 * least))


def test_packing_by_several_broadcasts(spark, documents, monkeypatch):
    pieces = Scratch(spark, "t").save(packing.token_pieces(documents, PATH), "pieces")
    whole = sorted(tuple(r) for r in packing.pack(spark, pieces.drop("ids"), ["doc_id", "piece"]).collect())
    monkeypatch.setattr(packing, "PLAN_ROWS", 40)
    assert sorted(tuple(r) for r in packing.pack(spark, pieces.drop("ids"), ["doc_id", "piece"]).collect()) == whole
    with pytest.raises(ValueError):
        packing.pack(spark, pieces.withColumn("offset", F.lit(1)), ["doc_id"])


@pytest.mark.parametrize(("which", "squeezed"), [("odd", True), ("odd", False), ("documents", True), ("none", True)])
def test_packed_sequences_hold_the_ids(spark, which, squeezed, request):
    docs = request.getfixturevalue(which)
    made = packing.packed_sequences(spark, packing.token_pieces(docs, PATH, squeezed=squeezed), ["doc_id", "piece", "ids_crc32"])
    made = Scratch(spark, "t").save(made, "sequences")
    rows, texts = made.collect(), {}
    tokenizer = Tokenizer.from_file(PATH)
    for i, t in lists(docs):
        texts.setdefault(i, []).append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert [p.offset for p in r.pieces] == np.cumsum([0, *(p.length for p in r.pieces)])[:-1].tolist()
        assert len(ids) == sum(p.length for p in r.pieces) <= 2048
        assert all(any(t[p.start : p.start + p.length] == ids[p.offset : p.offset + p.length] for t in texts[p.doc_id]) for p in r.pieces)
    got = packing.placements(made)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert sorted((tuple(r)[:5] for r in got.collect()), key=key) == brute_pieces(lists(docs))


def test_special_and_odd_words():
    texts = ["<|endoftext|> a", "<|ENDOFTEXT|>", "don't we'll İstanbul ΣΑΣ", "é ﬁ ½ a b  x", "naïve,, (x) ...", "ÀÉ÷×ß", ""]
    import pyarrow as pa

    from siltstone.llm.kernels import utf8

    store = packing.WordIds(PATH, slots=16, limit=4)
    for _ in range(3):
        data, offsets = utf8(pa.array(texts))
        ids, at = packing._ids(store, data, offsets, 0)
        expected = [[*e.ids, 0] for e in store.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == expected
        texts = [t for t in texts if "<|" not in t]


def test_plan_places_every_rank_once():
    rng = np.random.default_rng(0)
    for sizes in ([7] * 5 + [3] * 9, rng.integers(1, 50, 400).tolist(), [50] * 3, [1] * 120, []):
        counts = {int(k): int(n) for k, n in zip(*np.unique(np.array(sizes, int), return_counts=True))}
        runs = packing.plan(counts, 50)
        lengths = np.array(sorted(sizes, reverse=True), int)
        placed = [(int(s) + k, int(o), int(lengths[r + k])) for r, n, s, o in runs for k in range(n)]
        assert sorted(r + k for r, n, _, _ in runs for k in range(n)) == list(range(len(sizes)))
        ends = {}
        for s, o, n in sorted(placed):
            assert o == ends.get(s, 0)
            ends[s] = o + n
        assert not ends or max(ends.values()) <= 50
        assert len(ends) <= -(-int(lengths.sum()) // 50) * 1.1 + 1


def test_pipeline_stage_by_stage(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "pack"]
    scratch = Scratch(spark, "t")
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs, seen = documents, [documents]
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.save(stage(spark, docs, SF), name)
        seen.append(docs)
    start, good, lined, single, clean, packed = seen
    assert all(d.columns == documents.columns for d in seen[:-1])
    assert 0.7 * start.count() < good.count() < start.count()
    expected = [(i, t) for i, _, removed, t in brute_lines(lists(good)) if not removed or re.search(r"\S", t)]
    assert sorted(lists(lined)) == sorted(expected)
    assert all(r.n_chars == len(r.text) for r in lined.join(good.withColumnRenamed("text", "was"), "doc_id").where("text <> was").select("text", lined.n_chars).collect())
    kept = {i for i, _, _, keep in brute_near(lists(lined), 5) if keep}
    assert {i for i, _ in lists(single)} == kept
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {i for i, _ in lists(clean)} == {r[0] for r in brute_hits(lists(single), items) if not r[5]}
    rows = packed.collect()
    assert sorted((tuple(r)[:5] for r in rows), key=key) == brute_pieces(lists(clean))
    well_packed([(r.sequence_id, r.offset, r.length) for r in rows])


def test_run_is_the_stages_in_turn(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and corpus_pipeline.ORACLE_SQL is None


CLASHING = ["n_words", "items", "hit_words", "hit_spans", "n_lines", "n_removed", "quality_score", "top_passage", "_q_text", "_p_text", "sig", "rep", "kept", "piece", "length", "rank", "_pl_0"]


@pytest.mark.parametrize("which", ["odd", "none"])
def test_stages_on_odd_rows(spark, which, request):
    """Nulls, ties and repeated rows, with columns called like those that operators make."""
    scratch = Scratch(spark, "t")
    docs = request.getfixturevalue(which).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHING})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.save(stage(spark, docs, SF), name)
        if name != "pack":
            assert docs.columns == columns
            assert all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in docs.collect() for c in CLASHING)
    assert docs.count() >= (which == "odd")

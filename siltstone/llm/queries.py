"""The registered queries of the operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package, table
from . import decontaminate, langid, linededup, lm, media, minhash, oracles, packing, quality, secrets, sharding


def remainder(column: str, n: int) -> Column:
    """crc32 of a column as text, modulo n; -1 for null, so that rows without an id are in no held-out part."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(-1))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; the model sees text and lang of the ids that aren't held out.

    Null or letterless texts are ``und`` with score 0; rows with a null doc_id
    teach and aren't held out; every row gets a row, repeated ones alike; other
    columns are not read; no documents give no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(spark, docs.where(remainder("doc_id", 4) != 2))
    return langid.predict(spark, docs, model, ["doc_id", (remainder("doc_id", 4) == 2).alias("held_out")])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the lines of repeated three-line windows, the first of each window by (doc_id, line) staying.

    Null texts stay null with no lines; a null doc_id comes last; rows that share
    doc_id and text are one occurrence; no documents give no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(spark, docs).select("doc_id", "n_lines", "n_removed", "text")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components over two-word shingles at similarity 0.8.

    Null, empty and wordless texts are linked with nothing; a null doc_id is
    linked with nothing, kept, and has a null component_id; rows that share a
    doc_id are one node and each get a row; no documents give no rows.
    """
    return minhash.near_duplicates(spark, table(spark, sf_dir, "documents"), width=2)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside 13-word windows of benchmark items.

    Null and empty texts have no words and hit nothing; a null item_id counts as
    the empty string; repeated documents each get a row, repeated items count
    under each id; an empty benchmark hits nothing.
    """
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontaminate.find_contamination(spark, docs, items)
    n_hit = decontaminate.hit_count()
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.is_contaminated(n_hit, F.col("n_words")).alias("contaminated"),
        F.array_join(F.transform("hit_spans", lambda x: F.concat_ws(":", x["first"], x["end"])), ",").alias("hit_spans"),
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from labels of ids that aren't held out.

    Null and empty texts are scored as one empty passage; a null doc_id has no
    label and isn't held out; repeated rows each get a row, equal texts score
    alike; without labels every score is 0.5; no documents give no rows.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(spark, docs, labels.where(remainder("doc_id", 5) != 0))
    scored = quality.score(spark, docs, model, ["doc_id", (remainder("doc_id", 5) == 0).alias("held_out")])
    return scored.select(
        "doc_id",
        "held_out",
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.3).cast("int").alias("predicted"),
        "top_passage",
    )


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probabilities of all texts under a model of the ids that aren't held out.

    Null and empty texts are their end alone; rows with a null doc_id teach and
    aren't held out; repeated rows count each time and each get a row; without
    training rows every token is equally likely; no documents give no rows.
    """
    docs = table(spark, sf_dir, "documents")
    model = lm.train(spark, docs.where(remainder("doc_id", 7) != 2))
    scored = lm.score(spark, docs, model, ["doc_id", (remainder("doc_id", 7) == 2).alias("held_out")])
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score"
    )


def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 shards of documents, equal in rows, along a Hilbert curve over lang, source and size.

    A null text has no bytes, null lang or source count as empty; repeated rows
    get a slot each; no documents give no rows.
    """
    docs = table(spark, sf_dir, "documents")
    return sharding.document_shards(spark, docs, 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into sequences of 2048 tokens.

    Null and empty texts are the separator alone; null and repeated ids each have
    their own pieces; no documents give no rows.
    """
    import public_tokenizers

    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), squeezed=True)
    return packing.placements(packing.packed_sequences(spark, pieces, ["doc_id", "piece", "ids_crc32"]))


def op9_media_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as an MPEG audio stream and read back.

    Null and empty texts are 64 bytes of 0; rows are independent of ids, and equal
    texts give equal values; no documents give no rows.
    """
    stored = media.audio_from_text(table(spark, sf_dir, "documents"))
    read = media.read_audio(stored, ["doc_id", "n_bytes"])
    tail = F.expr("substring(payload, octet_length(payload) - 63, 64)")
    offsets = F.sha2(F.array_join(F.transform("seek_offsets", lambda x: x.cast("string")), ",").cast("binary"), 256)
    duration = F.concat_ws("/", "samples", "sample_rate")
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.concat_ws(
            ";",
            F.concat(F.lit("duration="), duration),
            F.concat(F.lit("frames="), F.col("frames")),
            F.concat(F.lit("bad_checks="), F.col("bad_checks")),
            F.concat(F.lit("resyncs="), F.col("resyncs")),
            F.concat(F.lit("vbr="), F.col("vbr_consistent").cast("string")),
            F.concat(F.lit("seek="), F.substring(offsets, 1, 16)),
        ).alias("feature"),
    )


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every text: three fixed patterns, and random-looking strings by Markov models.

    Null and empty texts have no spans; rows are independent of ids, repeated ones
    alike; no documents give no rows.
    """
    ratios = secrets.train(secrets.labelled_samples(spark))
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), ratios)
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("bigint")
    base = F.filter("spans", lambda x: x["kind"] < 3)
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        count(3).alias("n_markov"),
        F.sha2(secrets.joined(base).cast("binary"), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
    )


def _ready(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _ready(f) for f in (op1_language_id, op2_line_dedup, op3_minhash_near_dedup, op4_decontaminate, op5_quality, op6_kneser_ney, op7_hilbert_shards, op8_best_fit_packing, op9_media_audio, op10_secret_scan)
}

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": linededup.ORACLE_SQL,
    "op3_minhash_near_dedup": oracles.near_duplicates(2, minhash.PERCENT),
    "op4_decontaminate": oracles.contamination(decontaminate.WINDOW),
    "op7_hilbert_shards": oracles.hilbert_shards(40, sharding.BITS),
}

"""Documents to training sequences: quality, line dedup, near-dedup, decontamination, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the docs of
the next.  All but the last return the columns of documents, whatever they are
called: operators see all but doc_id and text under names of their own.  Null
texts, null and repeated ids are as the operators say; a null doc_id has no label
and is no near-duplicate.  No documents give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, linededup, minhash, packing, quality
from siltstone.llm.queries import remainder
from siltstone.llm.scratch import Scratch
from siltstone.session import ship_package, table

LEAST_QUALITY = 0.3


def _hidden(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with names that no operator uses for all columns but doc_id and text, and those names by the old ones."""
    names = {c: f"_pl_{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    return docs.withColumnsRenamed(names), names


def _shown(docs: DataFrame, names: dict[str, str], columns: list[str]) -> DataFrame:
    return docs.select(*[F.col(names.get(c, c)).alias(c) for c in columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; a fifth of the labels stays unseen for judging it."""
    ship_package(spark)
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    model = quality.train(spark, docs, labels)
    held, names = _hidden(docs)
    return _shown(quality.score(spark, held, model, held.columns).where(F.col("quality_score") >= LEAST_QUALITY), names, docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows go; so does a document of which no text is left."""
    ship_package(spark)
    held, names = _hidden(docs)
    found = linededup.dedup_lines(spark, held)
    left = found.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in names:
        changed = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
        left = left.withColumn(names["n_chars"], changed.otherwise(F.col(names["n_chars"])))
    return _shown(left, names, docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, 0.8) stays."""
    ship_package(spark)
    return minhash.drop_near_duplicates(spark, docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more are words of benchmark passages go."""
    ship_package(spark)
    held, names = _hidden(docs)
    found = decontaminate.find_contamination(spark, held, table(spark, sf_dir, "benchmark"), held.columns)
    return _shown(found.where(~decontaminate.is_contaminated(decontaminate.hit_count(), F.col("n_words"))), names, docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence, place and the checksum of the ids packed there."""
    return packing.placements(pack_documents(spark, docs))


def pack_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The training sequences of clean documents: sequence_id, ids and pieces."""
    ship_package(spark)
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), squeezed=True)
    return packing.packed_sequences(spark, pieces, ["doc_id", "piece", "ids_crc32"])


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_duplicate_stage),
    ("decontaminate", decontamination_stage),
    ("pack", packing_stage),
]

# Neither the classifier nor the tokenizer can be expressed in SQL; tests compare each stage with brute force.
ORACLE_SQL: str | None = None


def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all stages but the last leave of the documents of ``sf_dir``."""
    ship_package(spark)
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training sequences of ``sf_dir``, for a caller to write."""
    return pack_documents(spark, clean_documents(spark, sf_dir))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    return STAGES[-1][1](spark, clean_documents(spark, sf_dir), sf_dir)

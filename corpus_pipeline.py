"""Training corpus in five stages: quality, exact copies, near copies, mix, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from swellgrid.llm.common import materialize, release_scratch, scratch_tables
from swellgrid.llm.exact_dedup import drop_copies
from swellgrid.llm.mixing import mix_sources
from swellgrid.llm.near_dup import keep_one_of_each
from swellgrid.llm.packing import pack_documents
from swellgrid.llm.quality import quality_selection
from swellgrid.llm.queries import MIX_WEIGHTS, mix_levels, tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects (operator 7), with their columns.

    A null text is an empty one; rows that repeat an id are judged each by its own text; without labels of both
    kinds all stay; an empty table gives no rows.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_selection(docs, labels).where("selected").select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each normalised text (operator 5), that of the smallest id.

    A null text equals an empty one, a null id is the largest, of equal rows one stays; an empty table gives no rows.
    """
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (operator 9), that of the smallest id.

    Null, empty and wordless texts are like no other and stay, as do rows with a null id; rows that
    repeat an id stay or go together; an empty table gives no rows.
    """
    return keep_one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fill the token budgets of their domain, language and source (operator 2).

    After de-duplication one epoch is all there is: no document comes twice.  A null language or source is a value of
    its own, texts without words cost nothing, rows that repeat an id come together; an empty table gives no rows.
    """
    return mix_sources(docs, mix_levels(), MIX_WEIGHTS, max_epochs=1).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2,048 tokens (operator 6).

    A null or empty text is its end id alone; rows that repeat an id, or have none, are documents of their own; an
    empty table gives no rows.
    """
    return pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("exact copies", exact_copies),
    ("near copies", near_copies),
    ("mix", mix),
    ("packing", packing),
]

#: The quality model, the weighted samples and the token ids have no SQL form; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written, and what it needed before is deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch_tables()
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            out = materialize(out, name.replace(" ", "-"))
            release_scratch(spark, keep=[out], since=before)
        docs = out
    return docs

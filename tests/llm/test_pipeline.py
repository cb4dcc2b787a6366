"""The pipeline's stages, one after another, on the smallest tables."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from swellgrid.llm import quality
from swellgrid.llm.packing import END_ID
from swellgrid.llm.queries import DOMAINS, MIX_WEIGHTS

from . import plain

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_equal_plain_versions(spark):
    """Every stage keeps what a plain version keeps of what that one's predecessors kept, and the pieces hold all its tokens."""
    import public_tokenizers
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    columns, texts = docs.columns, {i: r["text"] or "" for i, r in rows.items()}
    noise = {r["doc_id"]: r["u"] for r in docs.select("doc_id", quality.gumbel(F.col("doc_id"), F.col("text")).alias("u")).collect()}
    sample = quality.labelled_sample(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "quality")
    domain = {source: name for name, sources in DOMAINS.items() for source in sources}

    def near(texts):
        classes, _ = plain.all_pairs_classes(texts, plain.idf_levels(texts))
        return {i for i, c in classes.items() if i == c}

    def mix(texts):
        leaves = [(i, t, domain.get(rows[i]["source"], "other"), rows[i]["lang"], rows[i]["source"]) for i, t in texts.items()]
        return plain.mixed(leaves, ["domain", "lang", "source"], MIX_WEIGHTS)

    versions = [lambda t: plain.selected(t, sample, noise), plain.first_of_equal, near, mix]
    for (name, stage), version in zip(corpus_pipeline.STAGES[:-1], versions, strict=True):
        docs = corpus_pipeline.materialize(stage(spark, docs, sf), "test")
        assert docs.columns == columns, name
        want = version(texts)
        assert sorted(r["doc_id"] for r in docs.select("doc_id").collect()) == sorted(want), name
        assert 0 < len(want) < len(texts), name
        texts = {i: texts[i] for i in want}

    packed = corpus_pipeline.run(spark, sf).toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert set(packed["doc_id"]) == set(texts)
    for i, pieces in packed.sort_values("start").groupby("doc_id"):
        ids = np.array([*tokenizer.encode(texts[i], add_special_tokens=False).ids, END_ID], "<u4")
        assert (pieces["doc_tokens"] == len(ids)).all() and pieces["length"].sum() == len(ids)
        assert (pieces["start"] == pieces["length"].cumsum() - pieces["length"]).all()
        assert [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in pieces.itertuples()] == pieces["ids_crc32"].tolist()
    for _, pieces in packed.sort_values("offset").groupby("sequence_id"):
        assert (pieces["offset"] == pieces["length"].cumsum() - pieces["length"]).all() and pieces["length"].sum() <= 2048
    used = packed.groupby("sequence_id")["length"].sum()
    padding = sum(2048 - n for n in used if n & (n - 1))
    assert padding <= 0.02 * used.sum()


def test_stages_on_an_empty_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("1 = 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_stages_with_nulls_ties_repeats_and_clashing_names(spark):
    """Each stage takes odd rows and keeps the columns; what it does with them is in its docstring."""
    sf = "/root/testdata/sf0.001"
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "en", "src0", 9), (1, text, "en", "src0", 9), (2, text, None, None, 9), (None, None, "en", "src1", None), (None, "", "en", "src1", 0), (3, "long " * 20000, "de", "src2", 1), (4, "two words", "en", "src9", 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    for clash in ("selected", "words", "flag_", "quota", "one"):
        docs = docs.withColumn(clash, docs["n_chars"])
    quality, exact, near, mix, packing = (f for _, f in corpus_pipeline.STAGES)
    kept = exact(spark, docs, sf)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "None"]
    left = near(spark, docs, sf)
    assert left.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "1", "3", "4", "None", "None"]
    mixed = mix(spark, docs, sf)
    assert mixed.columns == docs.columns and mixed.count() <= len(rows)
    assert packing(spark, docs, sf).where("start = 0").count() == len(rows)
    plain = spark.createDataFrame(rows, schema)
    assert quality(spark, plain, sf).columns == plain.columns

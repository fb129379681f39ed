"""One query for each operator, with its parameters of production, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, feistel, fm_quality, html_main, image_local, line_frequency, line_templates, merkle, mil_toxicity, mixing, packing, simhash, suffix_automaton
from .common import read
from .oracles import ORACLES  # noqa: F401


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix(read(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op3_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(read(spark, sf_dir, "pages"))


def op4_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.cut_lines(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_cut", "text")


def op5_fm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return fm_quality.score(docs, fm_quality.train(docs, read(spark, sf_dir, "labels")))


def op6_pseudonyms(spark: SparkSession, sf_dir: str, key: str = "change this key") -> DataFrame:
    return feistel.pseudonymise(read(spark, sf_dir, "documents"), key)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return mil_toxicity.score(docs, mil_toxicity.train(docs, read(spark, sf_dir, "labels")))


def op9_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image_local.copies(image_local.media_of(read(spark, sf_dir, "embeddings")))


def op10_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_frequency.rate(read(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_cut")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(read(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mined(read(spark, sf_dir, "documents"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_automaton.rate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash, op2_mixing, op3_site_style_tree, op4_line_templates, op5_fm_quality, op6_pseudonyms,
        op7_packing, op8_toxicity, op9_image_copies, op10_line_frequency, op11_merkle_manifest, op12_collocations,
        op13_decontamination, pipeline,
    )
}

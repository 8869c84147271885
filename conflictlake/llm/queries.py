"""Registered queries of the subpackage: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from conflictlake.llm import (alignment, backoff, chat, mixing, ngram_join, packing, quality, repair, sharding, token_counts, topk,
                              url_cascade, wrappers)
from conflictlake.llm.common import table


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public tokenizer file (the same on every node)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and unigram tokens of every document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), keep=["doc_id"])


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards of at most 1 MiB of text."""
    return sharding.shards(table(spark, sf_dir, "documents"), 1 << 20)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page by its host's wrapper."""
    return wrappers.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles have a Jaccard similarity of 85 % or more."""
    return ngram_join.join(table(spark, sf_dir, "documents"), 4, 85).select("doc_id", "n_shingles", "component_id")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every query vector with all other vectors."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url by the rules, through the Bloom cascade."""
    return url_cascade.judge(table(spark, sf_dir, "pages"), keep=["page_id"])


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts imitate the template, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    told = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", told), (-7, 1, "assistant", told)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.windows(turns.unionByName(own), tokenizer()))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source weights 5, 2, 1 by systematic sampling."""
    return mixing.mix(table(spark, sf_dir, "documents"), [5, 2, 1]).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and n-gram perplexity verdict of every document."""
    out = quality.judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", *quality.MEASURES, "base_failed", "kept", "lang_code", "model_words", "perplexity")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents"), tokenizer()))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations damaged, and the cheapest edits that give them a legal structure again."""
    turns = table(spark, sf_dir, "conversations")
    return repair.audit(repair.damage(turns), turns)


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a bigram automaton learnt from those that are not held out."""
    return backoff.score(table(spark, sf_dir, "documents"), order=2)


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens of two tokenizers aligned, with the corpus-wide counts of the linked ids."""
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_sharding": op2_sharding,
    "op3_html_extraction": op3_html_extraction,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_url_filters": op6_url_filters,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_mixing": op8_mixing,
    "op9_quality_rules": op9_quality_rules,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_structure_repair": op11_structure_repair,
    "op12_lm_scoring": op12_lm_scoring,
    "op13_cross_tokenizer_alignment": op13_cross_tokenizer_alignment,
}

SQL: dict[str, str] = {
    "op2_sharding": sharding.SQL,
    "op5_exact_top_k": topk.SQL,
    "op6_url_filters": url_cascade.SQL,
}

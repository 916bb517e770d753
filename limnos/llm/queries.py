"""Queries of the training-data operators over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.llm import chat, conversation_trie, decontaminate, html_extract, jaccard_join, media, mixing, near_dup, quality, ranked_search, secrets, token_counts, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that repeat benchmark items, and how closely."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    leaks = decontaminate.find_leaks(docs, items, {"doc_id": F.col("doc_id")}, F.col("text"))
    return leaks.withColumn("similarity", F.round("similarity", 9))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as tool calls with their replies, checked, ordered and serialised."""
    return chat.link_tool_calls(*chat.turns_as_calls(table(spark, sf_dir, "conversations")))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as an image in an archive, read back and described."""
    return media.media_features(table(spark, sf_dir, "documents"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from labels that are not held out."""
    return quality.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_dup.simhash_components(table(spark, sf_dir, "documents"))


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after masking, by edits of its segment tree."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's share of a mix of 150 % of the words, sources weighted 3, 1, 2 in turn."""
    mix = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract_html(table(spark, sf_dir, "pages"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, with the corpus-wide ownership of what they look like."""
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct shingles and component of every document, linked at a similarity of 0.8."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for every benchmark item."""
    index = ranked_search.index_documents(table(spark, sf_dir, "documents"))
    return ranked_search.search(index, table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_chat": op2_chat,
    "op3_media": op3_media,
    "op4_urls": op4_urls,
    "op5_quality": op5_quality,
    "op6_simhash": op6_simhash,
    "op7_tokens": op7_tokens,
    "op8_mixing": op8_mixing,
    "op9_html": op9_html,
    "op10_secrets": op10_secrets,
    "op11_trie": op11_trie,
    "op12_jaccard": op12_jaccard,
    "op13_search": op13_search,
}

ORACLE_SQL = {
    "op1_decontamination": decontaminate.LEAKS_SQL,
    "op2_chat": chat.CHAT_SQL,
    "op8_mixing": mixing.MIX_SQL.format(docs="documents") + "select doc_id, size, source_size, target, size * copies as taken, source, copies from out",
    "op11_trie": conversation_trie.TRIE_SQL,
    "op12_jaccard": jaccard_join.JACCARD_SQL,
    "op13_search": ranked_search.SEARCH_SQL,
}

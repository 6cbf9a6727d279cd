"""Registered queries of the llm operators: each applies its operator to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lureline.llm import (
    brown_lm, chat_format, decontaminate, embed_dedup, minhash_dedup, mixing, periodic_runs, secret_scan,
    substring_dedup, suffix_dedup, token_alignment, toxicity, url_filter,
)
from lureline.llm.common import crc_mod5, table

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def register(fn: Query) -> Query:
    _REGISTRY[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


@register
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat formatting of all ``conversations`` plus the planted conversation -7, read back."""
    said = "</s>[INST] ok [/INST]"
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"))
    return chat_format.conversation_digest(
        chat_format.format_conversations(given.unionByName(planted)))


#: The contract's rules: host, path, verdict.
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block"))


@register
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, then boosted trees learned from the urls that a rule decides, over all ``pages``."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict", "block_probability")


@register
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` against all ``benchmark`` windows of ten words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


@register
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text; learned from the labelled rows with crc32 remainder 1 to 4."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(crc_mod5() != 0)
    scored = toxicity.fit(docs, labels).score(docs)
    return scored.select("doc_id", (crc_mod5() == 0).alias("held_out"), "score", "predicted", "lexicon_hits")


@register
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` mixed to the weights 3, 1, 2 over the sources, 150 % of all words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@register
def op9_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all ``documents`` (five words, 0.75)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash_dedup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


@register
def op8_suffix_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all ``documents`` covered by a 200-byte string that also starts elsewhere."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = suffix_dedup.remove_repeats(docs, with_text=False)
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                       "kept_sha256")


@register
def op6_substring_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all ``documents`` covered by a window of 20 words that also starts earlier."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_earlier(docs, with_text=False).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


@register
def op2_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links (cosine of at least 0.93, equal labels) and components of all ``embeddings``."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return embed_dedup.near_vectors(vectors)


@register
def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every whole text; learned from the texts that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = brown_lm.fit(docs.filter(~brown_lm.held_out()))
    return model.score(docs).select(
        "doc_id", brown_lm.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens",
        "base_score", "score")


@register
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least 12 words in all ``documents`` (a tenth of them with planted periods)."""
    docs = periodic_runs.repeat_tails(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.digest(periodic_runs.collapse_runs(docs, with_text=False))
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                        "collapsed_sha256")


@register
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both public vocabularies aligned over all ``documents``, with the counts of the linked ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_alignment.align_documents(docs).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@register
def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all ``documents``: the rules' matches, and what the character models add."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.fit_by_rules(docs).find(docs)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in secret_scan.KINDS],
        F.sha2(secret_scan.said(base=True), 256).alias("base_sha256"), secret_scan.said().alias("spans"))

"""One query for each operator, over whole tables and with the parameters of production."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sql
from .base import REGISTRY, query, shared_folder
from .chat import conversation_digests, format_turns
from .classifier import quality_scores, remainder, train
from .decontaminate import benchmark_hits
from .jaccard import jaccard_components
from .lexical import rank_documents
from .licenses import license_labels
from .lm import held_out, lm_scores
from .mixing import mixing_plan
from .rules import quality_rules
from .simhash import simhash_components
from .spelling import spelling_variants
from .urls import judge_urls
from .warc import read_captures, write_warc

#: A score from which a text counts as good.
GOOD = 0.7


@query("op1_mixing", sql.MIXING)
def mixing(t) -> DataFrame:
    plan = mixing_plan(t("documents").select("doc_id", "text", "source"))
    return plan.select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken")
    )


@query("op2_quality_rules", sql.RULES)
def rules(t) -> DataFrame:
    return quality_rules(t("documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op3_chat_formatting", sql.CHAT)
def chat(t) -> DataFrame:
    table = t("conversations").select("conv_id", "turn", "role", "text")
    # Fixed value: a conversation whose texts look like the template's own marks.
    tricky = t.spark.sql(r"SELECT -7L AS conv_id, t AS turn, r AS role, r'\### Assistant: </turn> ok' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    return conversation_digests(format_turns(table.unionByName(tricky)))


@query("op4_license_scan", sql.LICENSES)
def licenses(t) -> DataFrame:
    return license_labels(t("documents")).drop("blocks")


def quality_model(docs: DataFrame, labels: DataFrame):
    """Learned from all labels but those of held-out documents."""
    return train(docs, labels.select("doc_id", F.col("quality").alias("label")).where(remainder(F.col("doc_id"), 4) != 2))


@query("op5_quality_classifier")
def classifier(t) -> DataFrame:
    docs = t("documents").select("doc_id", "text")
    scored = quality_scores(docs, quality_model(docs, t("labels")))
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


@query("op6_warc", sql.WARC)
def warc(t) -> DataFrame:
    path = shared_folder(t.spark, "warc")
    write_warc(t("pages").select("page_id", "url", "html"), path, least_bytes=0)
    return read_captures(t.spark, path, payloads=False).where("capture is not null").select(
        "metadata.page_id", "capture.payload_bytes", "capture.payload_digest", F.col("capture.type").alias("record_type"), "capture.refers_to"
    )


@query("op7_url_filter")
def urls(t) -> DataFrame:
    return judge_urls(t("pages"))


@query("op8_decontamination", sql.DECONTAMINATION)
def decontamination(t) -> DataFrame:
    hits = benchmark_hits(t("documents"), t("benchmark"))
    return hits.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


@query("op9_jaccard_join")
def jaccard(t) -> DataFrame:
    return jaccard_components(t("documents"))


@query("op10_lm_scoring")
def scoring(t) -> DataFrame:
    learned = ~F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    scored = lm_scores(t("documents"), learned)
    return scored.withColumn("held_out", ~learned)


@query("op11_lexical_search", sql.LEXICAL)
def lexical(t) -> DataFrame:
    return rank_documents(t("documents"), t("benchmark"), 20)


@query("op12_simhash_components")
def simhash(t) -> DataFrame:
    return simhash_components(t("documents"))


@query("op13_spelling_variants", sql.SPELLING)
def spelling(t) -> DataFrame:
    return spelling_variants(t("documents"))


@query("pipeline")
def pipeline(t) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(t.spark, t.folder)


def load() -> dict:
    return REGISTRY

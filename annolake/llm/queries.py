"""The operators as registered queries, over the whole given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
import public_tokenizers

from annolake.llm import ann, chat, decontaminate, jaccard, licenses, lm, mixing, pii, quality, repair, resample, tokens, url_filter
from annolake.llm.common import written
from annolake.session import small_table

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: How far the mix lifts small sources, languages and topics.
POWERS = {"source": 0.8, "lang": 0.8, "topic": 0.95}
CONTROL_TURNS = ((-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark, sf_dir):
    """Every page judged by the rules; where none fits, URLs that several pages have are listed."""
    pages = table(spark, sf_dir, "pages")
    rules = small_table(spark, list(RULES), url_filter.ENTRY)
    return url_filter.judge(pages.select("page_id", "url"), rules, url_filter.repeated(pages)).drop("url")


def op2_chat_format(spark, sf_dir):
    """Every conversation formatted, and read back."""
    extra = small_table(spark, list(CONTROL_TURNS), "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest(chat.format_turns(rows))


def op3_ngram_jaccard(spark, sf_dir):
    """Every document's set size and component of near duplicates."""
    return jaccard.join(table(spark, sf_dir, "documents"))


def op4_pii(spark, sf_dir):
    """Every document's personal data: counts and digest of base spans, all spans."""
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *pii.counts(F.col("base")), F.sha2(pii.told(F.col("base")), 256).alias("base_sha256"),
                        pii.told(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op5_decontamination(spark, sf_dir):
    """Every document's leaked benchmark items, with the best window."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.leaks(docs, items).drop("fp")


def op6_lm_scoring(spark, sf_dir):
    """Every document's score under the model of all documents, in ten-thousandths."""
    found = lm.score(table(spark, sf_dir, "documents"))
    return found.withColumn("log_score", F.round("log_score", 4))


def quality_labels(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))


def op7_quality_classifier(spark, sf_dir):
    """Every document's score, learnt from the labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.classify(docs, quality_labels(spark, sf_dir)).select("doc_id", "held_out", "score", "predicted")
    return written(scored, "scored", quality.TEXTS)


def op8_ann(spark, sf_dir):
    """The 20 nearest others of every vector whose id is divisible by 20."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_token_output(spark, sf_dir):
    """Every document's ids, written to blocks and read back."""
    return tokens.encode_corpus(table(spark, sf_dir, "documents"), TOKENIZER)


def op10_mixing(spark, sf_dir):
    """Every document's topic, tokens, rate, probability and whether it is sampled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    # texts are read once: what the mix needs of them is a narrow table
    return mixing.rated(written(mixing.describe(docs).drop("text"), "described"), POWERS)


def op11_license_scan(spark, sf_dir):
    """Every document's base phrases, and the labels of all notices in it."""
    return (licenses.scan(table(spark, sf_dir, "documents"))
            .withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")}))


def op12_structure_repair(spark, sf_dir):
    """Every conversation, damaged and mended: faults, least cost, edits, digest of what is left."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.report(rows, repair.damage(rows), "copies")


def op13_importance_resampling(spark, sf_dir):
    """Every document's weight towards the benchmark texts, its score, and its rank if drawn."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_chat_format, op3_ngram_jaccard, op4_pii, op5_decontamination, op6_lm_scoring,
    op7_quality_classifier, op8_ann, op9_token_output, op10_mixing,
    op11_license_scan, op12_structure_repair, op13_importance_resampling)}

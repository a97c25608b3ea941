"""The queries of this subpackage: name to (spark, sf_dir) -> DataFrame, and SQL where SQL can say it."""

from __future__ import annotations

from . import chat, decontaminate, fingerprints, language_model, line_dedup, mixture, ngram_join, quality, shards, url_rules
from ._tables import table


def op1_ngram_join(spark, sf_dir):
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


def op2_quality(spark, sf_dir):
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mixing(spark, sf_dir):
    return mixture.mix_report(table(spark, sf_dir, "documents"))


def op4_fingerprint(spark, sf_dir):
    return fingerprints.fingerprint_report(table(spark, sf_dir, "documents"))


def op5_chat_format(spark, sf_dir):
    return chat.chat_report(table(spark, sf_dir, "conversations"))


def op6_line_dedup(spark, sf_dir):
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op7_sharding(spark, sf_dir):
    return shards.shard_report(table(spark, sf_dir, "documents"))


def op8_lm_score(spark, sf_dir):
    return language_model.score_documents(table(spark, sf_dir, "documents"))


def op9_url_filter(spark, sf_dir):
    return url_rules.url_report(table(spark, sf_dir, "pages"))


def op10_decontaminate(spark, sf_dir):
    return decontaminate.leak_report(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_quality, op3_mixing, op4_fingerprint, op5_chat_format, op6_line_dedup, op7_sharding, op8_lm_score, op9_url_filter, op10_decontaminate)}
ORACLES = {"op1_ngram_join": ngram_join.ORACLE, "op3_mixing": mixture.ORACLE, "op5_chat_format": chat.ORACLE, "op6_line_dedup": line_dedup.ORACLE, "op9_url_filter": url_rules.ORACLE, "op10_decontaminate": decontaminate.ORACLE}

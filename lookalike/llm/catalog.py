"""The operators as queries on whole tables, and SQL where it can say them."""

from __future__ import annotations

from . import (
    bpe,
    classifier,
    language_model,
    mixing,
    periodic,
    quality_rules,
    records,
    repeats,
    secrets,
    simhash,
    token_counts,
    topk,
    whitening,
)
from .common import documents


def op10_simhash_groups(spark, sf_dir):
    return simhash.report(documents(spark, sf_dir))


def op1_repeated_strings(spark, sf_dir):
    return repeats.report(documents(spark, sf_dir))


def op2_secret_scan(spark, sf_dir):
    return secrets.report(documents(spark, sf_dir))


def op5_quality_rules(spark, sf_dir):
    return quality_rules.report(documents(spark, sf_dir))


def op3_mix(spark, sf_dir):
    return mixing.report(documents(spark, sf_dir))


def op4_bpe(spark, sf_dir):
    return bpe.report(documents(spark, sf_dir))


def op6_top_k(spark, sf_dir):
    return topk.report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_quality_classifier(spark, sf_dir):
    return classifier.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_token_counts(spark, sf_dir):
    return token_counts.report(documents(spark, sf_dir))


def op9_lm_score(spark, sf_dir):
    return language_model.score(documents(spark, sf_dir))


def op11_periodic_runs(spark, sf_dir):
    return periodic.report(documents(spark, sf_dir))


def op12_token_records(spark, sf_dir):
    return records.report(documents(spark, sf_dir))


def op13_whitening(spark, sf_dir):
    return whitening.report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_repeated_strings,
        op2_secret_scan,
        op3_mix,
        op4_bpe,
        op5_quality_rules,
        op6_top_k,
        op7_quality_classifier,
        op8_token_counts,
        op9_lm_score,
        op10_simhash_groups,
        op11_periodic_runs,
        op12_token_records,
        op13_whitening,
    )
}

ORACLES: dict[str, str] = {
    "op2_secret_scan": secrets.oracle(),
    "op5_quality_rules": quality_rules.oracle(),
    "op6_top_k": topk.oracle(),
}

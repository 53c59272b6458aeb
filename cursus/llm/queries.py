"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bpe, class_lm, exact_dedup, impact_index, packing, periodic, pii, quality, quality_classifier, secrets, simhash, token_counts, toxicity
from .common import documents


def op1_packing(spark, sf_dir):
    return packing.pieces_digest(packing.pack(documents(spark, sf_dir)))


def op2_simhash(spark, sf_dir):
    return simhash.near_duplicates(documents(spark, sf_dir))


def op3_pii_surrogates(spark, sf_dir):
    return pii.replace_pii(documents(spark, sf_dir).select("doc_id", "text"), pii.key_of(spark), counts=True)


def op4_token_counts(spark, sf_dir):
    return token_counts.token_counts(documents(spark, sf_dir))


def op5_class_lm(spark, sf_dir):
    return class_lm.score(documents(spark, sf_dir))


def op6_toxicity(spark, sf_dir):
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op8_bpe(spark, sf_dir):
    return bpe.digest(bpe.decode(bpe.encode(documents(spark, sf_dir))))


def op9_secret_scan(spark, sf_dir):
    return secrets.digest(secrets.secret_spans(documents(spark, sf_dir)))


def op10_quality_rules(spark, sf_dir):
    return quality.quality_report(documents(spark, sf_dir))


def op11_impact_search(spark, sf_dir):
    return impact_index.search(impact_index.build(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_quality_classifier(spark, sf_dir):
    return quality_classifier.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_periodic_runs(spark, sf_dir):
    return periodic.digest(periodic.periodic_runs(documents(spark, sf_dir), tails=True))


QUERIES = {f.__name__: f for f in (op1_packing, op2_simhash, op3_pii_surrogates, op4_token_counts, op5_class_lm, op6_toxicity, op7_exact_dedup, op8_bpe, op9_secret_scan, op10_quality_rules, op11_impact_search, op12_quality_classifier, op13_periodic_runs)}
ORACLE_SQL = {"op7_exact_dedup": exact_dedup.SQL, "op10_quality_rules": quality.SQL, "op11_impact_search": impact_index.SQL}

"""Queries opN_<name>: each operator with production parameters over its whole table."""

from __future__ import annotations

from yieldloom.llm import alignment, bpe, guess_cost, hmm, jaccard, language, pseudonyms, quality, roles, runs, simhash, sql, templates, wrappers
from yieldloom.llm.common import read

QUERIES = {}
ORACLES = {"op1_ngram_join": sql.NGRAM_JOIN, "op2_templates": sql.TEMPLATES, "op3_host_quality": sql.HOST_QUALITY}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_ngram_join(spark, folder):
    return jaccard.jaccard_groups(read(spark, folder, "documents"))


@query
def op2_templates(spark, folder):
    return templates.decontaminate(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@query
def op3_host_quality(spark, folder):
    return quality.quality_rules(read(spark, folder, "documents")).drop("host_rate")


@query
def op4_role_repair(spark, folder):
    return roles.repair_roles(read(spark, folder, "conversations"))


@query
def op5_segmentations(spark, folder):
    return language.identify(read(spark, folder, "documents"))


@query
def op6_hidden_markov(spark, folder):
    return hmm.score_texts(read(spark, folder, "documents"))


@query
def op7_guess_cost(spark, folder):
    return guess_cost.scan_secrets(read(spark, folder, "documents"))


@query
def op9_pseudonyms(spark, folder):
    return pseudonyms.pseudonym_report(read(spark, folder, "documents"))


@query
def op8_bpe(spark, folder):
    return bpe.token_digests(read(spark, folder, "documents"))


@query
def op10_wrappers(spark, folder):
    return wrappers.extract_main_text(read(spark, folder, "pages"))


@query
def op11_merge_path(spark, folder):
    """``alignment.align_tokens`` states how nulls, empty texts and repeated rows come out."""
    return alignment.align_tokens(read(spark, folder, "documents"))


@query
def op12_simhash(spark, folder):
    """``simhash.simhash_groups`` states how nulls, empty texts and repeated rows come out."""
    return simhash.simhash_groups(read(spark, folder, "documents"))


@query
def op13_periodic_runs(spark, folder):
    """``runs.run_report`` states how nulls, empty texts and repeated rows come out."""
    return runs.run_report(read(spark, folder, "documents"))

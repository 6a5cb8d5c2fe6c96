"""Queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from . import chat, decontaminate, fingerprint, html_text, language, licenses, ngram_join, pieces, secrets, toxicity
from ._spark import table


def op1_html_extraction(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_language_id(spark, sf_dir):
    return language.report(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.link(table(spark, sf_dir, "documents"), n=3, percent=90)


def op4_sentencepiece(spark, sf_dir):
    return pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces.vocabulary()).drop("text")


def op5_benchmark_decontamination(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_secret_scans(spark, sf_dir):
    return secrets.report(table(spark, sf_dir, "documents"))


def op7_document_fingerprints(spark, sf_dir):
    return fingerprint.report(table(spark, sf_dir, "documents"))


def op8_toxicity(spark, sf_dir):
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_license_scans(spark, sf_dir):
    return licenses.report(table(spark, sf_dir, "documents"))


def op10_chat_formatting(spark, sf_dir):
    return chat.report(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_language_id,
        op3_ngram_jaccard_join,
        op4_sentencepiece,
        op5_benchmark_decontamination,
        op6_secret_scans,
        op7_document_fingerprints,
        op8_toxicity,
        op9_license_scans,
        op10_chat_formatting,
    )
}
ORACLE_SQL: dict[str, str] = {"op9_license_scans": licenses.oracle(), "op10_chat_formatting": chat.ORACLE}

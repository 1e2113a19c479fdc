"""Registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_words, collocations, decontaminate, html_text, media, merkle, mixing, passages, pii, quality, secret_scan, simhash, token_files
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    docs = lambda s, d: table(s, d, "documents")
    labels = lambda s, d: table(s, d, "labels")
    return {
        "op1_simhash": lambda s, d: simhash.report(docs(s, d)),
        "op2_mixing": lambda s, d: mixing.mixture(docs(s, d), labels(s, d)),
        "op3_decontaminate": lambda s, d: decontaminate.report(docs(s, d), table(s, d, "benchmark")),
        "op4_html_text": lambda s, d: html_text.report(table(s, d, "pages")),
        "op5_quality": lambda s, d: quality.report(docs(s, d), labels(s, d)),
        "op6_media": lambda s, d: media.report(docs(s, d)),
        "op7_token_files": lambda s, d: token_files.report(docs(s, d), cache_bytes=token_files.ALONE_BYTES),
        "op8_pii": lambda s, d: pii.report(docs(s, d)),
        "op9_secrets": lambda s, d: secret_scan.report(docs(s, d)),
        "op10_passages": lambda s, d: passages.repeated_passages(docs(s, d)),
        "op11_collocations": lambda s, d: collocations.top_phrases(docs(s, d)),
        "op12_bpe_words": lambda s, d: bpe_words.report(docs(s, d)),
        "op13_merkle": lambda s, d: merkle.manifest(docs(s, d)),
        "secret_base_spans": lambda s, d: secret_scan.base_report(docs(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB statements of the operators that SQL can express."""
    return {"op10_passages": passages.SQL, "secret_base_spans": secret_scan.BASE_SQL, "op11_collocations": collocations.SQL, "op13_merkle": merkle.SQL}

"""The queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, html_extract, importance, jpeg_media, license_scan, mixing, phrases, pieces, simhash, sketches, toxicity, url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": url_filters.op1_url_filters,
    "op2_simhash": simhash.op2_simhash,
    "op3_quality": importance.op3_quality,
    "op4_licenses": license_scan.op4_licenses,
    "op5_fingerprints": sketches.op5_fingerprints,
    "op6_html": html_extract.op6_html,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_mixing": mixing.op8_mixing,
    "op9_bpe": bpe.op9_bpe,
    "op10_jpeg_media": jpeg_media.op10_jpeg_media,
    "op11_pieces": pieces.op11_pieces,
    "op12_phrases": phrases.op12_phrases,
}

SQL: dict[str, str] = {"op1_url_filters": url_filters.SQL, "op8_mixing": mixing.SQL, "op12_phrases": phrases.SQL}

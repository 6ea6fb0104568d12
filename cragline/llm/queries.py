"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cragline.llm import bpe, chat, clusters, fingerprint, language, mixing, neardup, periods, perplexity, quality, secrets, simhash, warc
from cragline.session import table


def _documents(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": _documents(secrets.op1),
    "op10_near_duplicates": _documents(neardup.op10),
    "op11_centroid_clusters": lambda spark, sf_dir: clusters.op11(table(spark, sf_dir, "embeddings")),
    "op12_periodic_runs": _documents(periods.op12),
    "op13_simhash_duplicates": _documents(simhash.op13),
    "op2_quality_classifier": lambda spark, sf_dir: perplexity.op2(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op3_warc_reassembly": lambda spark, sf_dir: warc.op3(spark, table(spark, sf_dir, "pages")),
    "op4_quality_rules": lambda spark, sf_dir: quality.op4(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op5_chat_round_trip": lambda spark, sf_dir: chat.op5(table(spark, sf_dir, "conversations")),
    "op6_language_id": _documents(language.op6),
    "op7_fingerprints": _documents(fingerprint.op7),
    "op8_byte_bpe": _documents(bpe.op8),
    "op9_source_mixing": _documents(mixing.op9),
}

ORACLES: dict[str, str] = {
    "op1_secret_scan": secrets.ORACLE,
    "op10_near_duplicates": neardup.ORACLE,
    "op11_centroid_clusters": clusters.ORACLE,
    "op12_periodic_runs": periods.ORACLE,
    "op2_quality_classifier": perplexity.ORACLE,
    "op3_warc_reassembly": warc.ORACLE,
    "op4_quality_rules": quality.ORACLE,
    "op5_chat_round_trip": chat.ORACLE,
    "op9_source_mixing": mixing.ORACLE,
}

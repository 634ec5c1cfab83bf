"""The subpackage's queries opN_<name> and their SQL, over the driver's tables with production parameters."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .oracle_sql import SQL


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where the installed public vocabulary is; a parameter of the operators."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def pii_key(spark: SparkSession) -> bytes:
    """The pseudonyms' secret: spark.kinforge.pii.key, or the published placeholder where it is unset."""
    from .feistel_pii import DEMO_KEY

    set_key = spark.conf.get("spark.kinforge.pii.key", "")
    return set_key.encode() if set_key else DEMO_KEY


def _of(module: str, function: str, tables: tuple[str, ...] = ("documents",), file: str | None = None, key: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        apply = getattr(importlib.import_module(f"{__package__}.{module}"), function)
        return apply(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables], *([vocabulary(file)] if file else []), *([pii_key(spark)] if key else []))

    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": _of("suffix_dedup", "op1_suffix"),
    "op2_phrase_dedup": _of("phrase_dedup", "op2_phrases"),
    "op3_decontaminate": _of("decontaminate", "op3_decontaminate", ("documents", "benchmark")),
    "op4_dac_tokens": _of("dac_store", "op4_dac", file="word_bpe_49k.json"),
    "op5_feistel_pii": _of("feistel_pii", "op5_pii", key=True),
    "op6_backoff_lm": _of("backoff_lm", "op6_backoff_lm"),
    "op7_bpe_transducer": _of("bpe_transducer", "op7_bpe", file="word_bpe_49k.json"),
    "op8_simhash": _of("simhash_index", "op8_simhash"),
    "op9_langid": _of("unigram_langid", "op9_langid", file="piece_bpe_32k.model"),
    "op10_hamming_topk": _of("hamming_search", "op10_search", ("embeddings",)),
}
__all__ = ["QUERIES", "SQL", "pii_key", "vocabulary"]

"""The queries of this subpackage, for ``__spark_entry__``; each module gives its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dipper.llm import bpe, collocations, jaccard, linededup, media, packing, pii, quality, substrings, tokenfiles, topk, urlfilter, vectorcodes

MODULES = (topk, urlfilter, linededup, media, bpe, quality, pii, packing, substrings, jaccard, tokenfiles, collocations, vectorcodes)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL by query, where a module has some; the URL filter's model is fitted when it's asked for."""
    return {k: v() if callable(v) else v for m in MODULES for k, v in getattr(m, "ORACLE_SQL", {}).items()}

"""Registered queries of the reference's own operators, with DuckDB SQL for those SQL can express."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import answers, evaluation, platform, retrieval

_MODULES = (retrieval, answers, evaluation, platform)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _m in _MODULES:
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES

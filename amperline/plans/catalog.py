"""Queries by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from amperline.plans import archive_plans, coupling_plans, desk_plans, feed_plans, file_plans, interval_plans, layer_plans, map_plans, market_plans, match_plans, report_plans

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**interval_plans.QUERIES, **market_plans.QUERIES, **feed_plans.QUERIES, **file_plans.QUERIES, **archive_plans.QUERIES, **map_plans.QUERIES, **report_plans.QUERIES, **match_plans.QUERIES, **layer_plans.QUERIES, **desk_plans.QUERIES, **coupling_plans.QUERIES}
ORACLE: dict[str, str] = {**interval_plans.ORACLE, **market_plans.ORACLE, **feed_plans.ORACLE, **file_plans.ORACLE, **archive_plans.ORACLE, **map_plans.ORACLE, **report_plans.ORACLE, **match_plans.ORACLE, **layer_plans.ORACLE, **desk_plans.ORACLE, **coupling_plans.ORACLE}
#: The `_all` names are of the same whole tables as the names without.
ORACLE |= {name: ORACLE[name.removesuffix("_all")] for name in QUERIES if name.endswith("_all") and name not in ORACLE}

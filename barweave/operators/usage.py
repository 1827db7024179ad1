"""Usage-event reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import exact_percentiles


def usage_totals(df: DataFrame, session: str = "session_id", user: str = "user_name") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("events"), F.countDistinct(session).alias("sessions"), F.countDistinct(user).alias("users"))


def top_events(df: DataFrame, n: int = 20, name: str = "event_name") -> DataFrame:
    """Top names; aggregation and limit need no global sort."""
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), name).limit(n)


def user_activity(df: DataFrame, user: str = "user_name", ts: str = "created_at") -> DataFrame:
    return (df.filter(F.col(user).isNotNull()).groupBy(user).agg(F.count(F.lit(1)).alias("events"), F.max(ts).alias("last_seen"))
            .orderBy(F.desc("last_seen"), user))


def feedback_counts(df: DataFrame, category: str = "category") -> DataFrame:
    return df.groupBy(category).agg(F.count(F.lit(1)).alias("count"))


def events_page(df: DataFrame, cond: Column | None, limit: int, offset: int, order: Sequence) -> DataFrame:
    d = df if cond is None else df.filter(cond)
    return d.orderBy(*order).offset(offset).limit(limit)


def api_latency(df: DataFrame, group: Sequence[str], props: str = "props", path: str = "$.k") -> DataFrame:
    """Count, mean and exact quantiles of a number kept in JSON text."""
    v = F.get_json_object(props, path).cast("double")
    d = df.select(*group, v.alias("v"))
    a = d.groupBy(*group).agg(F.count("v").alias("calls"), F.round(F.avg("v"), 6).alias("avg_value"), F.min("v").alias("min_value"), F.max("v").alias("max_value"))
    return a.join(exact_percentiles(d, group, "v", {"p50": 0.5, "p95": 0.95}), list(group), "left")

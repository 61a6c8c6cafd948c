"""Usage analytics over an event log (id, at, user_id, tool, result, error) with an explicit ``asof``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions import text as T


def rollup(events: DataFrame) -> DataFrame:
    """(day, user_id, tool, calls, errors) by local day; events without a user are left out."""
    rows = events.where("user_id is not null").withColumn("day", T.local_day(F.col("at")))
    return rows.groupBy("day", "user_id", "tool").agg(F.count("*").alias("calls"), F.sum(F.col("error").isNotNull().cast("long")).alias("errors"))


def last_days(df: DataFrame, n: int, asof: Column) -> DataFrame:
    """Rows with day > asof - n (dates)."""
    return df.where(F.col("day") > F.date_sub(asof, n))


def summary(daily: DataFrame, users: DataFrame, n: int, asof: Column) -> DataFrame:
    sums = last_days(daily, n, asof).groupBy("user_id", "tool").agg(F.sum("calls").alias("calls"), F.sum("errors").alias("errors"))
    return sums.join(users.select(F.col("id").alias("user_id"), "name"), "user_id").select("user_id", "name", "tool", "calls", "errors")


def daily_totals(daily: DataFrame, n: int, asof: Column, user: int | None = None) -> DataFrame:
    """Calls and errors of each of the last ``n`` days, zero on quiet days."""
    spine = daily.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(asof, n - 1), asof)).alias("day"))
    own = daily if user is None else daily.where(F.col("user_id") == user)
    sums = own.groupBy("day").agg(F.sum("calls").alias("calls"), F.sum("errors").alias("errors"))
    return spine.join(sums, "day", "left").select("day", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("errors", F.lit(0)).alias("errors"))


def overview(events: DataFrame, daily: DataFrame, users: DataFrame, asof_ts: Column) -> DataFrame:
    """One row: enabled users, active users of 7 days, calls of today, 7 and 30 days, searches of 7 days that found nothing."""
    today = T.local_day(asof_ts)
    part = lambda n, v: F.coalesce(F.sum(F.when(F.col("day") > F.date_sub(today, n), v)), F.lit(0))
    calls = daily.agg(
        F.count_distinct(F.when(F.col("day") > F.date_sub(today, 7), F.col("user_id"))).alias("active_7d"),
        part(1, F.col("calls")).alias("today"), part(7, F.col("calls")).alias("calls_7d"), part(30, F.col("calls")).alias("calls_30d"),
    )
    recent = F.col("at") > asof_ts - F.expr("interval 7 days")
    empty = events.agg(F.sum((recent & (F.col("tool") == "view") & (T.json_count(F.col("result"), "k") == 0)).cast("long")).alias("empty_7d"))
    enabled = users.agg(F.sum(F.col("disabled_at").isNull().cast("long")).alias("enabled"))
    return calls.crossJoin(empty).crossJoin(enabled)  # one row each


def recent(events: DataFrame, users: DataFrame, asof_ts: Column, days: int = 7, tool: str | None = None, only_empty: bool = False, limit: int = 50) -> DataFrame:
    """Newest events of the last days with their users; users that are gone leave a null name."""
    rows = events.where(F.col("at") > asof_ts - F.expr(f"interval {int(days)} days"))
    if tool:
        rows = rows.where(F.col("tool") == tool)
    if only_empty:
        rows = rows.where(T.json_count(F.col("result"), "k") == 0)
    top = rows.orderBy(F.desc("at"), F.desc("id")).limit(limit)
    return top.join(users.select(F.col("id").alias("user_id"), "name"), "user_id", "left").select("id", "at", "user_id", "name", "tool", "result", "error")


def user_tool_pivot(sums: DataFrame, tools: list[str]) -> DataFrame:
    wide = sums.groupBy("user_id").pivot("tool", tools).sum("calls").na.fill(0)
    total = sums.groupBy("user_id").agg(F.sum("calls").alias("total"), F.sum("errors").alias("errors"))
    return wide.join(total, "user_id")


def tool_stats(sums: DataFrame) -> DataFrame:
    """Per tool: calls, errors, error rate (null without calls) and width against the leading tool."""
    from pyspark.sql import Window

    by = sums.groupBy("tool").agg(F.sum("calls").alias("calls"), F.sum("errors").alias("errors"))
    lead = F.max("calls").over(Window.partitionBy(F.lit(1)))  # one row for each tool
    return by.select("tool", "calls", "errors", F.round(F.try_divide(F.col("errors"), F.col("calls")), 4).alias("error_rate"), F.round(100 * F.try_divide(F.col("calls"), lead), 1).alias("width"))


def user_rows(users: DataFrame, tokens: DataFrame, daily: DataFrame, today: Column) -> DataFrame:
    """Users with active tokens, last use and calls of 30 days: two pre-aggregations and left joins."""
    t = tokens.groupBy("user_id").agg(F.sum(F.col("revoked_at").isNull().cast("long")).alias("tokens"), F.max("last_used_at").alias("last_used"))
    d = last_days(daily, 30, today).groupBy("user_id").agg(F.sum("calls").alias("calls_30d"))
    base = users.select(F.col("id").alias("user_id"), "name")
    return base.join(t, "user_id", "left").join(d, "user_id", "left").select("user_id", "name", F.coalesce("tokens", F.lit(0)).alias("tokens"), "last_used", F.coalesce("calls_30d", F.lit(0)).alias("calls_30d"))


def live_row(events: DataFrame) -> DataFrame:
    return events.select("id", F.coalesce("name", F.lit("silinmiş kullanıcı")).alias("who"), "tool", F.get_json_object("result", "$.k").try_cast("int").alias("n"), F.col("error").isNotNull().alias("failed"))


def query_row(events: DataFrame) -> DataFrame:
    """(id, at, asked, filters, count, paths, failed): events (input and result as JSON) as rows of the query log."""
    count = F.get_json_object("result", "$.count").try_cast("long")
    return events.select("id", "at", T.asked(F.col("input"), ("query", "path", "pattern", "prefix")).alias("asked"), T.other_inputs(F.col("input")).alias("filters"), count.alias("count"), T.string_list(F.get_json_object("result", "$.paths")).alias("paths"), F.col("error").isNotNull().alias("failed"))


def purge(events: DataFrame, asof_ts: Column, days: int = 90) -> DataFrame:
    """Details that are not older than ``days``; totals are kept elsewhere."""
    return events.where(F.col("at") >= asof_ts - F.expr(f"interval {int(days)} days"))

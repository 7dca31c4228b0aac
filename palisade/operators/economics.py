"""Token usage, cost, budgets, periods and rate limits."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# USD for 1,000 prompt and completion tokens.
PRICES: tuple[tuple[str, float, float], ...] = (
    ("gpt-4o", 0.0025, 0.01),
    ("gpt-4o-mini", 0.00015, 0.0006),
    ("gpt-4.1", 0.002, 0.008),
    ("gpt-4.1-mini", 0.0004, 0.0016),
    ("gpt-4.1-nano", 0.0001, 0.0004),
    ("o3-mini", 0.0011, 0.0044),
    ("claude-opus-4-6", 0.015, 0.075),
    ("claude-sonnet-4-6", 0.003, 0.015),
    ("claude-haiku-4-5-20251001", 0.0008, 0.004),
    ("gemini-2.5-pro", 0.00125, 0.01),
)


def price_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRICES), "model string, prompt_per_1k double, completion_per_1k double")


def usage(body: Column, provider: Column) -> Column:
    """struct(prompt_tokens, completion_tokens, total_tokens), null where a field is missing or the provider reports none."""

    def number(path: str) -> Column:
        return F.get_json_object(body, path).cast("long")

    p, c, t = number("$.usage.prompt_tokens"), number("$.usage.completion_tokens"), number("$.usage.total_tokens")
    i, o = number("$.usage.input_tokens"), number("$.usage.output_tokens")

    def out(a: Column, b: Column, s: Column) -> Column:
        return F.struct(a.alias("prompt_tokens"), b.alias("completion_tokens"), s.alias("total_tokens"))

    return F.when((provider == "openai") & p.isNotNull() & c.isNotNull() & t.isNotNull(), out(p, c, t)).when((provider == "anthropic") & i.isNotNull() & o.isNotNull(), out(i, o, i + o))


def with_cost(usages: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds cost_usd; models without a price cost nothing.  Spark broadcasts the price table where its statistics show it to be small."""
    joined = usages.join(prices, "model", "left")
    cost = F.col("prompt_tokens") / 1000 * F.coalesce("prompt_per_1k", F.lit(0.0)) + F.col("completion_tokens") / 1000 * F.coalesce("completion_per_1k", F.lit(0.0))
    return joined.withColumn("cost_usd", F.coalesce(cost, F.lit(0.0))).drop("prompt_per_1k", "completion_per_1k")


# --- periods -------------------------------------------------------------------------


def period_start(ts: Column, period: Column) -> Column:
    return F.when(period == "weekly", F.date_trunc("week", ts)).when(period == "monthly", F.date_trunc("month", ts)).otherwise(F.date_trunc("day", ts))


def reset_at(ts: Column, period: Column) -> Column:
    """When the period of a time ends: next midnight, next Monday, first of next month; else a day later."""
    return (
        F.when(period == "daily", F.date_trunc("day", ts) + F.expr("INTERVAL 1 DAY"))
        .when(period == "weekly", F.date_trunc("week", ts) + F.expr("INTERVAL 7 DAYS"))
        .when(period == "monthly", F.add_months(F.date_trunc("month", ts), 1).cast("timestamp"))
        .otherwise(ts + F.expr("INTERVAL 1 DAY"))
    )


# --- budgets --------------------------------------------------------------------------


def spend_scopes(usages: DataFrame) -> DataFrame:
    """Each usage once for each scope it counts towards: API key, tenant and agent."""
    rows = F.array(*(F.struct(F.lit(s).alias("scope"), F.col(c).alias("scope_id")) for s, c in (("api_key", "api_key"), ("tenant", "tenant_id"), ("agent", "agent_id"))))
    return usages.withColumn("_s", F.explode(rows)).where("_s.scope_id is not null").select("*", "_s.scope", "_s.scope_id").drop("_s")


def budget_caps(budgets: DataFrame) -> DataFrame:
    """One budget for each (scope, id): the larger cap of repeated ones."""
    best = F.max_by(F.struct("amount_usd", "period"), "amount_usd").alias("b")
    return budgets.groupBy("scope", "scope_id").agg(best).select("scope", "scope_id", "b.*")


def spent(usages: DataFrame, budgets: DataFrame, now: Column) -> DataFrame:
    """Spend of the current period of every budget; spend without a budget is left out.

    Usage is summed by scope and id before it meets the budgets.
    """
    caps = budget_caps(budgets)
    starts = F.struct(*(period_start(now, F.lit(p)).alias(p) for p in ("daily", "weekly", "monthly")))
    sums = [F.sum(F.when(F.col("ts") >= starts[p], F.col("cost_usd"))).alias(p) for p in ("daily", "weekly", "monthly")]
    total = spend_scopes(usages).where(F.col("ts") <= now).groupBy("scope", "scope_id").agg(*sums)
    joined = caps.join(total, ["scope", "scope_id"], "left")
    of_period = F.when(F.col("period") == "weekly", F.col("weekly")).when(F.col("period") == "monthly", F.col("monthly")).otherwise(F.col("daily"))
    return joined.select("scope", "scope_id", "amount_usd", "period", F.coalesce(of_period, F.lit(0.0)).alias("spent_usd"))


def budget_status(amount: Column, spent_usd: Column) -> Column:
    """struct(remaining_usd, utilization_pct, remaining_cents); cents are cut, so under one cent reads 0."""
    remaining = F.greatest(amount - spent_usd, F.lit(0.0))
    used = F.when(amount > 0, F.least(spent_usd / amount * 100, F.lit(100.0))).otherwise(0.0)
    return F.struct(remaining.alias("remaining_usd"), used.alias("utilization_pct"), (remaining * 100).cast("long").alias("remaining_cents"))


def refresh(status: DataFrame, now: Column, order: str | None = None) -> DataFrame:
    """Budgets (with reset_at and spent_usd) whose period has ended start anew; of repeated ones the larger cap stays.

    Of equal caps the first by ``order`` stays; without it, what ends first, then what is spent least.
    """
    ties = [order] if order else ["reset_at", "spent_usd", "period"]
    w = Window.partitionBy("scope", "scope_id").orderBy(F.desc("amount_usd"), *ties)
    over = F.col("reset_at") <= now
    one = status.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return one.withColumn("spent_usd", F.when(over, 0.0).otherwise(F.col("spent_usd"))).withColumn("reset_at", F.when(over, reset_at(now, F.col("period"))).otherwise(F.col("reset_at")))


def lookup_budget(requests: DataFrame, status: DataFrame) -> DataFrame:
    """Adds budget_remaining_cents (-1: none) and budget_utilization_pct by API key, else tenant, else agent."""
    out, found = requests, []
    for scope, key in (("api_key", "api_key"), ("tenant", "tenant_id"), ("agent", "agent_id")):
        side = status.where(F.col("scope") == scope).select(F.col("scope_id").alias(f"_{scope}"), budget_status(F.col("amount_usd"), F.col("spent_usd")).alias(f"_b_{scope}"))
        out = out.join(side, out[key] == side[f"_{scope}"], "left").drop(f"_{scope}")
        found.append(f"_b_{scope}")
    first = F.coalesce(*found)
    return out.withColumn("budget_remaining_cents", F.coalesce(first["remaining_cents"], F.lit(-1).cast("long"))).withColumn("budget_utilization_pct", F.coalesce(first["utilization_pct"].cast("long"), F.lit(0).cast("long"))).drop(*found)


def running_spend(usages: DataFrame, keys: list[str], period: str) -> DataFrame:
    """Adds the spend of each key so far in the calendar period.

    Hours are summed first; a window over the sums gives what each hour begins
    with, and only the rows of one hour of a key are ordered in one task.
    """
    of_hour = [F.col(k) for k in keys] + [F.date_trunc("hour", "ts").alias("_hour")]
    sums = usages.groupBy(*of_hour).agg(F.sum("cost_usd").alias("_sum"))
    earlier = Window.partitionBy(*keys, period_start(F.col("_hour"), F.lit(period))).orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_hour").alias("_begin"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)).alias("_before"))
    rows = usages.withColumn("_hour", F.date_trunc("hour", "ts"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)), F.col("_hour").eqNullSafe(F.col("_begin")))
    w = Window.partitionBy(*keys, "_hour").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(begins, same).select(*usages.columns, (F.col("_before") + F.sum("cost_usd").over(w)).alias("running_usd"))


def rate_limit(requests: DataFrame, limits: DataFrame) -> DataFrame:
    """Minutes and scopes over their limit: (minute, scope, scope_id, n, per_minute, place of the scope).

    Requests are counted by minute and scope before they meet the limits.
    """
    scopes = ("global", "tenant", "api_key", "agent", "model")
    cols = {"global": F.lit("*"), "tenant": F.when(F.col("tenant_id") != "default", F.col("tenant_id")), "api_key": F.col("api_key"), "agent": F.col("agent_id"), "model": F.col("model")}
    rows = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(s).alias("scope"), cols[s].alias("scope_id")) for i, s in enumerate(scopes)))
    counts = requests.select(F.date_trunc("minute", "ts").alias("minute"), F.explode(rows).alias("s")).where("s.scope_id is not null").groupBy("minute", "s.place", "s.scope", "s.scope_id").agg(F.count("*").alias("n"))
    return counts.join(limits, ["scope", "scope_id"]).where(F.col("n") > F.col("per_minute"))


def _request_scopes(limits: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, minute, ts, place, scope, scope_id and per_minute for each limited scope of a request."""
    cols = {"global": F.lit("*"), "tenant": F.when(F.col("tenant_id") != "default", F.col("tenant_id")), "api_key": F.col("api_key"), "agent": F.col("agent_id"), "model": F.col("model")}
    rows = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(s).alias("scope"), c.alias("scope_id")) for i, (s, c) in enumerate(cols.items())))
    each = requests.select("request_id", "ts", F.date_trunc("minute", "ts").alias("minute"), F.explode(rows).alias("s")).where("s.scope_id is not null")
    return each.select("request_id", "ts", "minute", "s.*").join(limits.select("scope", "scope_id", "per_minute"), ["scope", "scope_id"])


def take(scopes: list, counts: dict) -> str | None:
    """Count a request under all its scopes (scope, scope_id, limit), or say which is full and count it under none."""
    for scope, scope_id, limit in scopes:
        if counts.get((scope, scope_id), 0) >= limit:
            return scope
    for scope, scope_id, _ in scopes:
        counts[scope, scope_id] = counts.get((scope, scope_id), 0) + 1
    return None


def admit(requests: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds admitted and refused_by: requests of a minute are let in one after another, under several limits at once.

    A request needs room in all its scopes (limits: scope, scope_id, per_minute)
    and takes it in all, or in none if it is refused; the first full scope is named.  Requests go
    by ts and request_id, which is unique.  Requests are counted by minute and
    scope first: a scope that cannot overflow refuses nobody and is left out, so
    only requests of crowded scopes are taken in order, minute by minute, by a
    task that holds the counts of one minute.
    """
    own = requests.columns
    each = _request_scopes(limits, requests)
    crowded = each.groupBy("minute", "scope", "scope_id", "per_minute").agg(F.count("*").alias("_n")).where("_n > per_minute").drop("_n", "per_minute")
    tight = each.join(crowded, ["minute", "scope", "scope_id"]).groupBy("minute", "ts", "request_id").agg(F.array_sort(F.collect_list(F.struct("place", "scope", "scope_id", "per_minute"))).alias("scopes"))

    def run(batches):
        minute, counts = None, {}
        for batch in batches:
            out = []
            for at, request, scopes in zip(batch["minute"], batch["request_id"], batch["scopes"], strict=True):
                if at != minute:
                    minute, counts = at, {}
                out.append((request, take([(s["scope"], s["scope_id"], s["per_minute"]) for s in scopes], counts)))
            yield pd.DataFrame(out, columns=["request_id", "refused_by"])

    kind = next(f.dataType.simpleString() for f in requests.schema if f.name == "request_id")
    decided = tight.repartition("minute").sortWithinPartitions("minute", "ts", "request_id").select("minute", "request_id", "scopes").mapInPandas(run, f"request_id {kind}, refused_by string")
    return requests.join(decided.where("refused_by is not null"), "request_id", "left").select(*own, F.col("refused_by").isNull().alias("admitted"), "refused_by")


def first_breach(breaches: DataFrame) -> DataFrame:
    """The first scope over its limit in each minute."""
    return breaches.groupBy("minute").agg(F.min_by(F.struct("scope", "scope_id", "n", "per_minute"), F.struct("place", "scope_id")).alias("b")).select("minute", "b.*")


def fallback_route(requests: DataFrame, routes: DataFrame, condition: str = "budget_exceeded") -> DataFrame:
    """The first fallback model under a condition: routes have model and fallback array<struct<condition,model>>."""
    usable = F.filter("fallback", lambda f: f["condition"] == condition)
    return requests.join(routes, "model", "left").withColumn("fallback_model", F.get(F.transform(usable, lambda f: f["model"]), F.lit(0))).drop("fallback")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)

"""Lookups that fill a request's fact row from dimension tables.

Dimensions are catalogs (models, providers, tenants, servers).  They are joined
without hints: Spark broadcasts those that its statistics show to be small and
shuffles the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions.text import data_residency


def resolve_routes(requests: DataFrame, models: DataFrame, providers: DataFrame, default_model: str, upstream: str) -> DataFrame:
    """Adds provider, base_url, actual_model, route_region, fallback and what follows from them.

    ``models``: model, provider, actual_model, region, fallback (array of models).
    ``providers``: provider, base_url.  A model without a known provider goes upstream.
    """
    asked = requests.withColumn("model", F.when(F.coalesce("model", F.lit("")).isin("", "default"), F.lit(default_model)).otherwise(F.col("model")))
    m = models.select(F.col("model").alias("_model"), F.col("provider").alias("_provider"), "actual_model", F.col("region").alias("route_region"), "fallback")
    p = providers.select(F.col("provider").alias("_p"), F.col("base_url").alias("_url"))
    joined = asked.join(m, F.col("model") == F.col("_model"), "left").join(p, F.col("_provider") == F.col("_p"), "left")
    known = F.col("_p").isNotNull()
    return joined.select(
        *asked.columns,
        F.col("_model").isNotNull().alias("model_approved"),
        F.when(known, F.col("_provider")).otherwise("upstream").alias("provider"),
        F.when(known, F.col("_url")).otherwise(upstream).alias("base_url"),
        F.when(known, F.coalesce("actual_model", "model")).otherwise(F.col("model")).alias("actual_model"),
        F.when(known, F.col("route_region")).alias("route_region"),
        F.coalesce(known & (F.size("fallback") > 0), F.lit(False)).alias("fallback_available"),
    )


def with_tenant(requests: DataFrame, tenants: DataFrame) -> DataFrame:
    """Adds a tenant's settings and whether the route is in its region."""
    out = requests.join(tenants, "tenant_id", "left")
    return out.withColumn("data_residency_compliant", data_residency(F.col("tenant_region"), F.col("route_region")))


def with_identity(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """Tenant and agent by API-key hash; unknown keys are the default tenant's."""
    out = requests.join(keys, "key_hash", "left")
    return out.withColumn("tenant_id", F.coalesce("tenant_id", F.lit("default"))).withColumn("agent_id", F.coalesce("agent_id", F.lit("anonymous")))


def with_mcp(requests: DataFrame, registry: DataFrame | None) -> DataFrame:
    """mcp_server_approved: true without a header or without the feature, else whether the server is registered."""
    if registry is None:
        return requests.withColumn("mcp_server_approved", F.lit(True))
    known = registry.select(F.col("server_id").alias("_s")).distinct()
    joined = requests.join(known, requests["mcp_server_id"] == known["_s"], "left")
    return joined.withColumn("mcp_server_approved", F.col("mcp_server_id").isNull() | F.col("_s").isNotNull()).drop("_s")


def not_allowed(tools: DataFrame, allowed: DataFrame) -> DataFrame:
    """Tool rows whose name is not on the allowlist (column tool_name in both)."""
    return tools.join(allowed.select("tool_name").distinct(), "tool_name", "left_anti")


def per_tenant(policies: DataFrame, tenants: DataFrame) -> DataFrame:
    """Policies of each tenant: the baseline (null tenant) and then its own."""
    # Both sides are catalogs; each tenant repeats the baseline as it is evaluated with it.
    base = policies.where("tenant_id is null").drop("tenant_id").join(tenants.select("tenant_id"), F.lit(True))
    return base.unionByName(policies.where("tenant_id is not null").join(tenants.select("tenant_id"), "tenant_id"))

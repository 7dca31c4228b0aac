"""Decisions written as they are made: policies read anew for each micro-batch, rows written once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palisade.plans import policy as pol
from palisade.plans import tenants
from palisade.sources import io


@dataclass(frozen=True)
class Snapshot:
    """Policies as they were read, and a version that names their text."""

    version: str
    policies: tuple[pol.Policy, ...]


class Policies:
    """The policies of a folder; a text that does not compile leaves the last good ones in force."""

    def __init__(self, spark: SparkSession, folder: str, tenant: str | None = None):
        self.spark, self.folder, self.tenant = spark, folder, tenant
        self.last = Snapshot("none", ())
        self.error: str | None = None

    def refresh(self) -> Snapshot:
        text = io.policy_text(self.spark, self.folder, self.tenant)
        version = hashlib.sha256(text.encode()).hexdigest()[:16]
        if version != self.last.version:
            try:
                found = pol.parse(text)
                pol.validate(found)
                self.last, self.error = Snapshot(version, tuple(found)), None
            except pol.PolicyError as e:
                self.error = str(e)
        return self.last


class TenantPolicies:
    """The policies of a folder, and of a folder in it for each tenant, which is judged by both.

    All texts are read in one job; those that changed are parsed, and a tenant
    whose text does not compile keeps its last good ones, while others go on.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.last: dict[str, Snapshot] = {}
        self.errors: dict[str, str] = {}
        self.compiled: tenants.Compiled | None = None

    def _texts(self) -> dict[str, str]:
        """Each tenant's own text, the folder's own under an empty name."""
        files = self.spark.read.option("pathGlobFilter", "*.cedar").option("recursiveFileLookup", "true").text(self.folder, wholetext=True).withColumn("path", F.input_file_name())
        # Policies are configuration: small texts that the driver compiles.
        inside = F.substring_index("path", f"/{self.folder.split('/')[-1]}/", -1)
        out: dict[str, str] = {"": ""}
        for r in files.select(inside.alias("inside"), "value").orderBy("inside").collect():
            tenant = r["inside"].split("/")[0] if "/" in r["inside"] else ""
            out[tenant] = out.get(tenant, "") + r["value"] + "\n"
        return out

    def refresh(self) -> dict[str, Snapshot]:
        found = self._texts()
        changed = self.compiled is None or bool(self.last.keys() - found.keys())
        for tenant, own in found.items():
            text = found[""] + own if tenant else own
            version = hashlib.sha256(text.encode()).hexdigest()[:16]
            if tenant in self.last and self.last[tenant].version == version:
                continue
            try:
                policies = pol.parse(text)
                pol.validate(policies)
                self.last[tenant], changed = Snapshot(version, tuple(policies)), True
                self.errors.pop(tenant, None)
            except pol.PolicyError as e:
                self.errors[tenant] = str(e)
                self.last.setdefault(tenant, self.last.get("", Snapshot("none", ())))
        for gone in self.last.keys() - found.keys():
            del self.last[gone]
        if changed:
            self.compiled = tenants.Compiled({(t, ""): list(x.policies) for t, x in self.last.items()})
        return self.last

    def decide(self, rows: DataFrame) -> DataFrame:
        """``rows`` (tenant_id and any facts) with decision and policy_version, by what was read last."""
        versions = self.spark.createDataFrame([(t, x.version) for t, x in self.last.items()], "_t string, _v string")
        named = tenants.evaluate(self.compiled, rows.withColumn("policy_version", F.lit(""))).drop("policy_version")
        joined = named.join(versions, F.col("tenant_id") == F.col("_t"), "left")
        return joined.withColumn("policy_version", F.coalesce("_v", F.lit(self.last[""].version))).drop("_t", "_v")


def write_once(rows: DataFrame, batch_id: int, path: str, form: str = "json") -> bool:
    """Write a micro-batch to a folder of its own, unless it is there already; says whether it wrote.

    A folder counts once its writer has left its mark of success, so a batch that
    is replayed after a crash replaces what was left half done, and one that was
    done is not written twice.
    """
    if _done(rows.sparkSession, f"{path}/batch={batch_id}"):
        return False
    rows.write.mode("overwrite").format(form).save(f"{path}/batch={batch_id}")
    return True


def _done(spark: SparkSession, folder: str) -> bool:
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def written(spark: SparkSession, path: str, schema: str, form: str = "json") -> DataFrame:
    """The rows of all batches that are done, with their batch."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/_SUCCESS")
    marks = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(root) or []
    folders = [str(m.getPath().getParent()) for m in marks]
    if not folders:
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.schema(f"{schema}, batch long").option("basePath", path).format(form).load(folders)


def audit_stream(facts: DataFrame, policies: Policies | TenantPolicies, path: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame] | None = None, on_error: str = "allow", **trigger) -> StreamingQuery:
    """Decide on streaming facts and log each row once, with the version of the policies that decided.

    Policies are read at the start of every micro-batch; those of tenants decide by
    the facts' tenant_id.  ``shape`` makes log rows
    of decided ones; without it they are the given columns, action, rule_id and
    policy_version.
    """
    own = facts.columns

    def plain(decided: DataFrame) -> DataFrame:
        d = F.col("decision")
        return decided.select(*own, d["action"].alias("decided"), d["rule_id"].alias("rule_id"), "policy_version")

    def each(batch: DataFrame, batch_id: int) -> None:
        now = policies.refresh()
        if isinstance(policies, TenantPolicies):
            decided = policies.decide(batch)
        else:
            decided = pol.evaluate(list(now.policies), batch, on_error).withColumn("policy_version", F.lit(now.version))
        write_once((shape or plain)(decided), batch_id, path)

    return facts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def enriched_stream(audit: DataFrame, enrichment: DataFrame, within: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """Audit rows (audit_id, ts) with what was found after the decision (parent_audit_id, ts, detector_snapshot).

    A left outer join of two streams: an enrichment counts that comes up to
    ``within`` after its audit row in event time; an audit row without one is
    given out once the watermark says that none can come.  State is bounded by
    that interval.
    """
    a = audit.withWatermark("ts", late)
    e = enrichment.select(F.col("parent_audit_id").alias("_parent"), F.col("ts").alias("_found_at"), "detector_snapshot").withWatermark("_found_at", late)
    meets = (F.col("audit_id") == F.col("_parent")) & (F.col("_found_at") >= F.col("ts")) & (F.col("_found_at") <= F.col("ts") + F.expr(f"INTERVAL {within}"))
    return a.join(e, meets, "leftOuter").select(*audit.columns, F.col("_found_at").alias("enriched_at"), "detector_snapshot")

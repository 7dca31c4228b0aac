"""Readers and writers: bodies, configuration, policy folders, JSON lines."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.text import MAX_BODY_BYTES
from palisade.plans.policy import Policy, PolicyError, parse

_VARIABLE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(?::-([^}]*))?\}")


def read_requests(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Request rows of a JSON folder with a column body.  A body over 10 MiB is not kept: its row has status 400, others none."""
    over = F.octet_length("body") > MAX_BODY_BYTES
    rows = spark.read.schema(schema).json(path)
    return rows.withColumns({"status": F.when(over, 400), "body": F.when(~over, F.col("body"))})


def expand(text: str, env: Mapping[str, str] | None = None) -> str:
    """``${NAME}`` and ``${NAME:-default}``; an empty value counts as unset; without either it stays."""
    env = os.environ if env is None else env
    return _VARIABLE.sub(lambda m: env.get(m[1]) or (m[2] if m[2] is not None else m[0]), text)


def load_config(text: str, env: Mapping[str, str] | None = None) -> dict:
    """Configuration from YAML text, variables expanded."""
    import yaml

    return yaml.safe_load(expand(text, env)) or {}


def config_path(explicit: str | None, env: Mapping[str, str], exists=os.path.exists) -> str:
    """The first of: the given path, the working folder's, the XDG and the home folder's."""
    if explicit:
        return explicit
    places = ["palisade.yaml"]
    if env.get("XDG_CONFIG_HOME"):
        places.append(f"{env['XDG_CONFIG_HOME']}/palisade/palisade.yaml")
    if env.get("HOME"):
        places.append(f"{env['HOME']}/.config/palisade/palisade.yaml")
    for p in places:
        if exists(p):
            return p
    raise FileNotFoundError(f"no configuration in {', '.join(places)}")


def check_secrets(values: DataFrame) -> DataFrame:
    """Problems of configured keys (columns name, provider, value): one row for each that has any."""
    v = F.col("value")
    # How keys of each vendor begin.
    prefixes = {"openai": "sk-", "anthropic": "sk-ant-", "gemini": "AIza"}
    wrong = F.lit(False)
    for provider, prefix in prefixes.items():
        wrong = wrong | ((F.col("provider") == provider) & ~v.startswith(prefix))
    problem = F.when(F.coalesce(v, F.lit("")) == "", "empty").when(v.contains("${"), "unresolved").when(v.contains("\n"), "newline").when(v != F.trim(v), "whitespace").when(wrong, "prefix")
    return values.select("name", "provider", problem.alias("problem")).where("problem is not null")


def read_policies(spark: SparkSession, folder: str, tenant: str | None = None) -> list[Policy]:
    """Policies of a folder's files in path order, then those of a tenant's own folder; none permit everything.

    Policy files are configuration: small texts that the driver compiles.
    """
    return parse(policy_text(spark, folder, tenant))


def policy_text(spark: SparkSession, folder: str, tenant: str | None = None) -> str:
    out = []
    for path in [folder, *([f"{folder}/{tenant}"] if tenant else [])]:
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
            continue
        files = spark.read.option("pathGlobFilter", "*.cedar").option("recursiveFileLookup", "false").text(path, wholetext=True).withColumn("path", F.input_file_name()) if _any(spark, path) else None
        if files is not None:
            out += [r["value"] for r in files.orderBy("path").collect()]
    return "\n".join(out)


def _any(spark: SparkSession, path: str) -> bool:
    glob = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/*.cedar")
    return len(glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(glob)) > 0


class PolicyCache:
    """Policies of tenants, read when first asked for; a reload that fails keeps the last good ones."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.held: dict[str | None, list[Policy]] = {}

    def get(self, tenant: str | None = None) -> list[Policy]:
        if tenant not in self.held:
            self.held[tenant] = self._read(tenant, [])
        return self.held[tenant]

    def reload(self, tenant: str | None = None) -> list[Policy]:
        self.held[tenant] = self._read(tenant, self.held.get(tenant, []))
        return self.held[tenant]

    def evict(self, tenant: str | None = None) -> None:
        self.held.pop(tenant, None)

    def _read(self, tenant: str | None, last: list[Policy]) -> list[Policy]:
        try:
            return read_policies(self.spark, self.folder, tenant)
        except PolicyError:
            return last


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; lines that do not parse keep their text in ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def lines(rows: DataFrame, style: str = "json") -> DataFrame:
    """Rows as text: ``json``, ``pretty``, or the column ``compact`` as it is."""
    if style == "compact":
        return rows.select(F.col("compact").alias("line"))
    row = F.struct(*(F.col(c) for c in rows.columns))
    return rows.select((F.to_json(row, {"pretty": "true"}) if style == "pretty" else F.to_json(row)).alias("line"))


def stream_to_jsonl(rows: DataFrame, path: str, checkpoint: str):
    """A streaming audit sink."""
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

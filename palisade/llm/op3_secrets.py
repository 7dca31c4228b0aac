"""Secret scans over an incremental ledger of content-addressed blobs.

Each version of a text is a blob, named by its SHA-256.  The ledger is a Parquet
folder with a row for each scan of a blob: the rule versions that ran and the
spans that they found.  ``update`` takes the distinct blobs of a table, drops
the pairs of blob and rule version that the ledger has, runs the rest and appends
the rows; findings are joined back to every path (document) that holds the blob.
Only built-in expressions run: no Python touches a row.

Copies meet before they are scanned, so a rule runs once on each unseen blob,
however many rows hold it; they are pre-aggregated before the shuffle.

A rule's matches are leftmost and non-overlapping, as its pattern gives them;
matches that fail the length test are dropped and not retried.  Spans count
characters, end exclusive.

The registered query and the pipeline's stage begin a ledger of their own in the
shared folder; callers that keep one pass its path.

Null texts count as empty.  Empty texts have no findings.  Rows with null or
repeated ids are scanned and reported like all others; an empty table gives an
empty report.  Other columns, whatever their names, are left out of reports and
kept by ``redact``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm._spark import fresh, plain_names, prepare, shared_path, table


@dataclass(frozen=True)
class Rule:
    """A pattern; ``group`` (0: the match) must have ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The patterns of the base rules are fixed values; spans are ordered by kind as listed here.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
    Rule("github", r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("slack", r"(?<![A-Za-z0-9])xox[baprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 27),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 35),
)
BASE_KINDS = ("assign", "access", "hex")

_SPANS = "array<struct<start:int,kind:int,end:int>>"
_LEDGER = "blob string, rules array<string>, spans array<struct<rule:string,start:int,end:int>>"


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """The spans of one rule.  The pieces between matches give the positions."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    before = F.transform(F.split(text, rule.pattern, -1), lambda x: F.char_length(x))
    sizes = F.arrays_zip(before.alias("gap"), F.transform(whole, lambda x: F.char_length(x)).alias("size"), F.transform(tested, lambda x: F.char_length(x)).alias("test"))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {_SPANS})").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(x["size"], F.lit(0))
        hit = F.array(F.struct(begin.alias("start"), F.lit(rank).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["test"] >= rule.least, F.concat(acc["spans"], hit)).otherwise(acc["spans"]).alias("spans"))

    return F.when(text.rlike(rule.pattern), F.aggregate(sizes, start, step, lambda acc: acc["spans"])).otherwise(F.expr(f"cast(array() as {_SPANS})"))


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger of a folder: blob, the rule versions of a scan, their spans.  A folder without one has no rows."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], _LEDGER)
    return spark.read.schema(_LEDGER).parquet(path)


def unseen(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, text, todo): distinct blobs with the rule versions that the ledger lacks."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    blobs = docs.select(blob_id(text).alias("blob"), text.alias("text")).groupBy("blob").agg(F.any_value("text").alias("text"))
    done = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("done"))
    names = F.array(*(F.lit(r.name) for r in rules))
    todo = F.when(F.col("done").isNull(), names).otherwise(F.array_except(names, "done"))
    return blobs.join(done, "blob", "left").select("blob", "text", todo.alias("todo")).where(F.size("todo") > 0)


def scan(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows, one for each blob with unseen pairs; their spans may be empty."""
    prepare(docs.sparkSession)

    def named(r: Rule) -> Column:
        spans = F.when(F.array_contains("todo", r.name), rule_spans(F.col("text"), r, 0)).otherwise(F.expr(f"cast(array() as {_SPANS})"))
        return F.transform(spans, lambda s: F.struct(F.lit(r.name).alias("rule"), s["start"].alias("start"), s["end"].alias("end")))

    return unseen(docs, ledger, rules).select("blob", F.col("todo").alias("rules"), F.concat(*(named(r) for r in rules)).alias("spans"))


def update(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger at ``path`` has not seen, append it, and return the ledger."""
    spark = docs.sparkSession
    scan(docs, open_ledger(spark, path), rules).write.mode("append").parquet(path)
    return open_ledger(spark, path)


def blob_findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans) of all blobs with findings by these rules: spans by start, then by the rules' order."""
    names = [r.name for r in rules]
    of_rules = F.filter("spans", lambda s: s["rule"].isin(names))
    kind = F.array(*(F.lit(n) for n in names))
    spans = F.transform(of_rules, lambda s: F.struct(s["start"].alias("start"), (F.array_position(kind, s["rule"]) - 1).cast("int").alias("kind"), s["end"].alias("end")))
    found = ledger.where(F.size(of_rules) > 0).select("blob", spans.alias("spans"))
    return found.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))


def findings(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, blob, spans) of every row of ``docs``, from a ledger that has seen them; rows without findings have none."""
    paths = docs.select(F.col("doc_id").cast("long").alias("doc_id"), blob_id(F.col("text").cast("string")).alias("blob"))
    return paths.join(blob_findings(ledger, rules), "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.expr(f"cast(array() as {_SPANS})")).alias("spans"))


def _joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def _of_kind(k: int):
    return lambda s: s["kind"] == k


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Counts, digest and spans of every row; the ledger at ``path`` (or a new one) is brought up to date first."""
    ledger = update(docs, path or shared_path(docs.sparkSession, "ledger"))
    base = F.filter("spans", lambda s: s["kind"] < len(BASE_KINDS))
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE_KINDS)]
    return findings(docs, ledger).select("doc_id", *counts, F.sha2(_joined(base, RULES), 256).alias("base_sha256"), _joined(F.col("spans"), RULES).alias("spans"))


@plain_names
def redact(docs: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES, path: str | None = None) -> DataFrame:
    """The documents with every found span replaced; n_chars follows where there is such a column."""
    blob, spans, key, new = fresh(docs, "blob", "spans", "key", "new")
    ledger = update(docs, path or shared_path(docs.sparkSession, "ledger"), rules)
    found = blob_findings(ledger, rules).select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    joined = docs.withColumn(key, blob_id(F.col("text").cast("string"))).join(found, F.col(key) == F.col(blob), "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    built = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.char_length("text"))))
    changed = F.col(spans).isNotNull()
    rebuilt = joined.withColumn(new, F.when(changed, built).otherwise(F.col("text")))
    size = F.when(changed, F.length(new)).otherwise(F.col("n_chars") if "n_chars" in docs.columns else F.lit(None))
    out = [F.col(new).alias(c) if c == "text" else size.cast(t).alias(c) if c == "n_chars" else F.col(c) for c, t in docs.dtypes]
    return rebuilt.select(*out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


#: Matches by DuckDB; positions from the text between them.  Its patterns have no look-behind, so the character
#: before a match is matched too and left out of the span (``g`` is the span's text or, for assign, the tested group).
SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
p AS (SELECT * FROM (VALUES
  (0, 'assign', 6, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  (1, 'access', 20, '()(AKIA[A-Z0-9]+)'),
  (2, 'hex', 24, '()([0-9a-f]+)'),
  (3, 'github', 40, '(^|[^A-Za-z0-9])(gh[pousr]_[A-Za-z0-9]{36,})'),
  (4, 'slack', 15, '(^|[^A-Za-z0-9])(xox[baprs]-[A-Za-z0-9-]{10,})'),
  (5, 'pem', 27, '()(-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----)'),
  (6, 'jwt', 35, '(^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})')) v(k, kind, least, pattern)),
m AS (SELECT r, k, kind, least, regexp_extract_all(t, pattern) AS a, regexp_extract_all(t, pattern, 2) AS g,
             regexp_split_to_array(t, pattern) AS gaps FROM d, p WHERE regexp_matches(t, pattern)),
u AS (SELECT r, k, kind, least, unnest(a) AS a, unnest(g) AS g, unnest(list_transform(gaps[1 : len(a)], lambda x: length(x))) AS gap, unnest(range(1, len(a) + 1)) AS i FROM m),
q AS (SELECT r, k, kind, least, g, CASE WHEN k = 0 THEN length(a) ELSE length(g) END AS n, sum(gap + length(a)) OVER (PARTITION BY r, k ORDER BY i) AS e FROM u),
f AS (SELECT r, k, kind, CAST(e - n AS BIGINT) AS b, CAST(e AS BIGINT) AS e FROM q WHERE length(g) >= least),
s AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
             string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, k) FILTER (k < 3) AS base,
             string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, k) AS spans FROM f GROUP BY r)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s USING (r)
"""

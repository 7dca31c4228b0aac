"""Economics, routing, audit, rollups, streams and sources."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from palisade.operators import audit, economics, rollups, routing
from palisade.sources import io
from palisade.streaming import buffer, frames


def ts(s):
    return datetime.fromisoformat(s)


@pytest.mark.parametrize(
    ("period", "at", "reset"),
    [("daily", "2024-02-28 23:59:59", "2024-02-29 00:00:00"), ("weekly", "2024-01-01 00:00:00", "2024-01-08 00:00:00"), ("weekly", "2024-01-07 12:00:00", "2024-01-08 00:00:00"), ("monthly", "2024-12-15 08:00:00", "2025-01-01 00:00:00"), ("yearly", "2024-01-01 10:00:00", "2024-01-02 10:00:00")],
)
def test_reset(spark, period, at, reset):
    df = spark.createDataFrame([(ts(at), period)], "t timestamp, p string")
    assert df.select(economics.reset_at(F.col("t"), F.col("p"))).first()[0] == ts(reset)


def test_budget_status(spark):
    df = spark.createDataFrame([(1.0, 0.995), (1.0, 3.0), (0.0, 1.0)], "a double, s double").select(economics.budget_status(F.col("a"), F.col("s")).alias("b"))
    assert [(r.b.remaining_cents, r.b.utilization_pct) for r in df.collect()] == [(0, 99.5), (0, 100.0), (0, 0.0)]


def test_budget_lookup_order(spark):
    status = spark.createDataFrame([("tenant", "t", 1.0, 0.5), ("agent", "a", 2.0, 0.0)], "scope string, scope_id string, amount_usd double, spent_usd double")
    reqs = spark.createDataFrame([("k", "t", "a"), ("k", "u", "a"), ("k", "u", "b")], "api_key string, tenant_id string, agent_id string")
    assert sorted(r.budget_remaining_cents for r in economics.lookup_budget(reqs, status).collect()) == [-1, 50, 200]


def test_refresh_keeps_the_larger_cap(spark):
    rows = [("tenant", "t", 1.0, 0.5, "daily", ts("2024-01-02 00:00:00")), ("tenant", "t", 2.0, 0.7, "daily", ts("2024-01-01 00:00:00"))]
    df = spark.createDataFrame(rows, "scope string, scope_id string, amount_usd double, spent_usd double, period string, reset_at timestamp")
    r = economics.refresh(df, F.lit("2024-01-01 12:00:00").cast("timestamp")).collect()
    assert len(r) == 1 and (r[0].amount_usd, r[0].spent_usd, r[0].reset_at) == (2.0, 0.0, ts("2024-01-02 00:00:00"))


def test_refresh_keeps_the_first_of_equal_caps(spark):
    rows = [(i, "tenant", str(i % 3), 2.0, float(i), "daily", ts("2024-01-02 00:00:00")) for i in range(60)]
    df = spark.createDataFrame(rows[::-1], "n int, scope string, scope_id string, amount_usd double, spent_usd double, period string, reset_at timestamp").repartition(4)
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    for r in (economics.refresh(df, now, "n"), economics.refresh(df.drop("n"), now)):
        assert sorted((x.scope_id, x.spent_usd) for x in r.collect()) == [("0", 0.0), ("1", 1.0), ("2", 2.0)]


def test_budget_refresh_of_ties_by_sql(spark, tmp_path):
    """Every greatest value of a user twice, a day apart: SQL on one thread keeps the first."""
    import duckdb

    from palisade import queries

    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    c.sql("SET threads = 1")
    one = "SELECT * FROM '/root/testdata/sf0.001/events.parquet'"
    c.sql(f"COPY (SELECT * FROM ({one}) UNION ALL (SELECT * REPLACE (event_id + 1000000 AS event_id, ts - INTERVAL 1 DAY AS ts) FROM ({one})) ORDER BY event_id) TO '{tmp_path}/events.parquet'")
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = sorted(c.sql(queries.SQL["budget_refresh"]).fetchall())
    got = queries.QUERIES["budget_refresh"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(a, float(b), float(x), d) for a, b, x, d in want]


def test_identity_and_fallback(spark):
    keys = spark.createDataFrame([("h", "t", "a")], "key_hash string, tenant_id string, agent_id string")
    r = routing.with_identity(spark.createDataFrame([("h",), ("x",)], "key_hash string"), keys).orderBy("key_hash").collect()
    assert [(x.tenant_id, x.agent_id) for x in r] == [("t", "a"), ("default", "anonymous")]
    routes = spark.createDataFrame([("m", [("error", "x"), ("budget_exceeded", "y")])], "model string, fallback array<struct<condition:string,model:string>>")
    assert economics.fallback_route(spark.createDataFrame([("m",)], "model string"), routes).first().fallback_model == "y"


def test_first_breach(spark):
    t = ts("2024-01-01 00:00:10")
    reqs = spark.createDataFrame([(t, "t", "k", "a", "m")] * 3, "ts timestamp, tenant_id string, api_key string, agent_id string, model string")
    limits = spark.createDataFrame([("model", "m", 2), ("tenant", "t", 1), ("global", "*", 5)], "scope string, scope_id string, per_minute int")
    r = economics.first_breach(economics.rate_limit(reqs, limits)).collect()
    assert len(r) == 1 and (r[0].scope, r[0].n) == ("tenant", 3)


def test_per_tenant_policies(spark):
    p = spark.createDataFrame([(None, "base"), ("t1", "own")], "tenant_id string, rule string")
    t = spark.createDataFrame([("t1",), ("t2",)], "tenant_id string")
    assert sorted(map(tuple, routing.per_tenant(p, t).select("tenant_id", "rule").collect())) == [("t1", "base"), ("t1", "own"), ("t2", "base")]


def test_holds_and_capacity(spark):
    h = spark.createDataFrame([("a", ts("2024-01-01 00:00:00")), ("b", ts("2024-01-01 00:00:00")), ("c", ts("2024-01-01 00:00:50"))], "hold_id string, created_at timestamp")
    d = spark.createDataFrame([("a", "rejected", ts("2024-01-01 00:00:05")), ("b", "approved", ts("2024-01-01 00:00:40"))], "hold_id string, verdict string, decided_at timestamp")
    r = audit.resolve_holds(h, d, F.lit("2024-01-01 00:01:00").cast("timestamp"))
    assert {x.hold_id: x.status for x in r.collect()} == {"a": "rejected", "b": "expired", "c": "pending"}
    assert audit.capacity(r, 1).first().full


def test_labels(spark):
    df = spark.createDataFrame([("flag", "r")], "a string, r string")
    none = F.array().cast("array<struct<detected:boolean,detector_type:string,confidence:double,findings:array<struct<pattern_name:string,category:string,confidence:double>>>>")
    found = F.array(F.struct(F.lit("email").alias("pattern"), F.lit("[E]").alias("redacted_to"), F.lit(2).alias("count"), F.lit("request").alias("location")))
    got = df.select(audit.labels(none, found, F.col("a"), F.col("r")).alias("l")).first().l
    assert [(x["label_type"], x["detector"]) for x in got] == [("pii", "email"), ("policy", "r")]


def test_anomalies_and_phases(spark):
    rows = [(ts(f"2024-01-01 {h:02d}:00:00"), "m", 100.0 if h == 20 else 1.0 + h * 0.01) for h in range(24)]
    s = spark.createDataFrame(rows, "ts timestamp, model string, v double")
    assert [r.hour.hour for r in rollups.anomalies(s, "v", ["model"]).collect()] == [20]
    long_ = rollups.phases_long(spark.createDataFrame([(1, 2.0, None)], "id int, auth_ms double, parse_ms double"), ["id"], ("auth_ms", "parse_ms"))
    assert [tuple(r) for r in long_.collect()] == [(1, "auth_ms", 2.0)]


# --- streams ------------------------------------------------------------------------


def flushes(cap, pushes):
    b = buffer.Buffer(cap)
    out = [x[2:] for i, p in enumerate(pushes) if (x := b.push(p, i))]
    return out + ([x[2:]] if (x := b.end()) else [])


def test_buffer_recurrence():
    assert flushes(100, ["ab", "c d", "e"]) == [("abc d", "boundary"), ("e", "end")]
    assert flushes(4, ["abc", "de", "f "]) == [("abcde", "cap"), ("f ", "boundary")]
    assert flushes(4, []) == [] and flushes(3, ["ééé"]) == [("ééé", "cap")]


def test_buffer_batch_capped_and_streaming_agree(spark, tmp_path):
    rows = [(s, i, w, i == 9) for s in range(5) for i, w in enumerate(["ab", "cd ", "e", "", "fgh", "i\n", "j", "k", "lm no", "p"])]
    df = spark.createDataFrame(rows, "stream_id long, seq long, chunk string, done boolean")
    key = lambda r: (r.stream_id, r.flush_seq, r.text, r.reason)
    batch = sorted(map(key, buffer.flush_groups(df).collect()))
    assert batch == sorted(map(key, buffer.flush_capped(df, 1000).collect()))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run = buffer.flush_stream(source, 1000).writeStream.format("memory").queryName("flushed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert batch == sorted(map(key, spark.table("flushed").collect()))


def test_sse_reassembly(spark):
    df = spark.createDataFrame([(1, 0, "data: {\"a\":1}\n"), (1, 1, "\ndata: [DO"), (1, 2, "NE]\n\nrest")], "id int, seq int, chunk string")
    r = frames.reassemble(df, ["id"]).orderBy("event_seq").collect()
    assert [(x.event, x.complete) for x in r] == [('data: {"a":1}', True), ("data: [DONE]", True), ("rest", False)]


def test_bedrock():
    a, b = frames.encode_bedrock("contentBlockDelta", b'{"x":1}'), frames.encode_bedrock("messageStop", b"{}")
    got, rest = frames.split_bedrock(b"\0" + a + b + b[:5])
    assert got[-1] == b and rest == b[:5]
    assert frames.parse_bedrock_message(a)["data"] == '{"x":1}' and frames.parse_bedrock_message(b)["is_done"]
    bad = frames.parse_bedrock_message(a[:-1] + bytes([a[-1] ^ 1]))
    assert bad["is_error"] and "message checksum" in bad["data"]
    assert "prelude" in frames.parse_bedrock_message(b"\0" * 20)["data"] and "short" in frames.parse_bedrock_message(b"abc")["data"]


def test_tools_of_streams(spark):
    d = '{"choices":[{"delta":{"tool_calls":[{"function":{"name":"%s"}}]}}]}'
    df = spark.createDataFrame([(1, 0, d % "b"), (1, 1, d % "a"), (1, 2, d % "b"), (1, 3, '{"content_block":{"type":"tool_use","name":"c"}}')], "id int, seq int, data string")
    assert frames.distinct_tools(df, ["id"]).first().tools == ["b", "a", "c"]


# --- sources ---------------------------------------------------------------------------


def test_config():
    env = {"A": "1", "EMPTY": ""}
    assert io.expand("${A} ${EMPTY:-x} ${NO:-y} ${NO}", env) == "1 x y ${NO}"
    assert io.load_config("k: ${A}\nl: [${NO:-2}]", env) == {"k": 1, "l": [2]}
    assert io.config_path(None, {"HOME": "/h"}, lambda p: p.startswith("/h")).startswith("/h")
    with pytest.raises(FileNotFoundError):
        io.config_path(None, {}, lambda p: False)


def test_policy_folder(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "b.cedar").write_text('@id("b")\nforbid(principal, action, resource);')
    (tmp_path / "a.cedar").write_text("permit(principal, action, resource);")
    (tmp_path / "t" / "x.cedar").write_text('@id("x")\nforbid(principal, action, resource);')
    assert [p.rule_id for p in io.read_policies(spark, str(tmp_path), "t")] == ["policy0", "b", "x"]
    assert io.read_policies(spark, str(tmp_path / "none")) == []
    cache = io.PolicyCache(spark, str(tmp_path))
    assert len(cache.get()) == 2
    (tmp_path / "b.cedar").write_text("forbid(")
    assert len(cache.reload()) == 2


def test_jsonl_and_retention(spark, tmp_path):
    path = str(tmp_path / "log")
    io.write_jsonl(spark.createDataFrame([("2024-01-01T00:00:00", 1), (None, 2)], "timestamp string, n int"), path)
    io.write_jsonl(spark.createDataFrame([("2024-01-10T00:00:00", 3)], "timestamp string, n int"), path)
    (tmp_path / "log" / "broken.json").write_text("not json\n")
    rows = io.read_jsonl(spark, path, "timestamp string, n int")
    kept, gone = audit.purge(rows, "2024-01-12 00:00:00", 5)
    assert sorted((r.n or 0) for r in kept.collect()) == [0, 2, 3] and gone.first().purged == 1


def test_secret_values(spark):
    df = spark.createDataFrame([("a", "openai", "sk-x"), ("b", "openai", "key"), ("c", "x", "${NO}"), ("d", "x", " a"), ("e", "x", "")], "name string, provider string, value string")
    assert {r.name: r.problem for r in io.check_secrets(df).collect()} == {"b": "prefix", "c": "unresolved", "d": "whitespace", "e": "empty"}


def test_admission_under_several_limits(spark):
    """Against one request after another."""
    import random

    rnd = random.Random(2)
    rows = [(i, ts(f"2024-01-01 00:0{rnd.randint(0, 3)}:{rnd.randint(0, 59):02d}"), rnd.choice(["t1", "t2", "default"]), rnd.choice("abc"), "x", rnd.choice(["m1", "m2"])) for i in range(400)]
    limits = {("global", "*"): 45, ("tenant", "t1"): 12, ("api_key", "a"): 9, ("api_key", "b"): 1000, ("model", "m2"): 20}
    df = spark.createDataFrame(rows, "request_id long, ts timestamp, tenant_id string, api_key string, agent_id string, model string").repartition(3)
    got = {r.request_id: r.refused_by for r in economics.admit(df, spark.createDataFrame([(*k, n) for k, n in limits.items()], "scope string, scope_id string, per_minute int")).collect()}
    counts, want = {}, {}
    for i, at, tenant, key, _, model in sorted(rows, key=lambda r: (r[1], r[0])):
        mine = [(s, k) for s, k in (("global", "*"), ("tenant", tenant), ("api_key", key), ("model", model)) if (s, k) in limits]
        full = next((s for s, k in mine if counts.get((at.minute, s, k), 0) >= limits[s, k]), None)
        for s, k in mine if full is None else []:
            counts[at.minute, s, k] = counts.get((at.minute, s, k), 0) + 1
        want[i] = full
    assert got == want and {"global", "tenant", "api_key", "model", None} == set(want.values())


def test_sketches_merge(spark):
    rows = spark.range(20_000).select(F.timestamp_seconds(F.col("id") * 7).alias("ts"), F.lit("a").alias("agent_id"), F.lit("m").alias("model"), (F.col("id") % 1000).cast("double").alias("total_ms"), F.lit(None).cast("double").alias("upstream_ms"))
    days = rollups.merged(rollups.sketches(rows)).orderBy("day")
    for r in days.select("sample_count", rollups.quantile("total_ms_sketch", 0.95).alias("p"), rollups.quantile("upstream_ms_sketch", 0.5).alias("none")).collect():
        assert abs(r.p - 950) < 20 and r.none is None and r.sample_count > 0
    assert days.agg(F.sum("sample_count")).first()[0] == 20_000
    assert abs(rollups.hourly(rows).agg(F.avg("total_ms_p50")).first()[0] - rollups.hourly(rows, exact=True).agg(F.avg("total_ms_p50")).first()[0]) < 25


def test_stream_audit_rows(spark):
    finding = "array<struct<pattern:string,redacted_to:string,count:int,location:string>>"
    a = spark.createDataFrame([("1", [("email", "[E]", 1, "request")], ("allow", "r"), '{"model":"m","pii_detected":false}'), ("2", [], ("flag", None), '{"pii_detected":false}')], f"request_id string, findings {finding}, enforcement struct<action:string,rule_id:string>, context_snapshot string")
    t = spark.createDataFrame([(1, 5, 4, 3, 2, 1, 0, "flag", [("ssn", "[S]", 1, "streaming_response"), ("rule", "", 1, "streaming_response_policy")], 10, 20)], f"stream_id long, bytes_received long, bytes_emitted long, frames_emitted long, flushes_boundary long, flushes_cap long, flushes_end long, verdict string, findings {finding}, first_byte_ms long, stream_duration_ms long")
    got = {r.request_id: r for r in audit.stream_audit(a, t).collect()}
    assert [f.pattern for f in got["1"].findings] == ["email", "ssn"] and got["1"].enforcement.streaming_action == "flag" and '"pii_detected":true' in got["1"].context_snapshot
    assert [f.pattern for f in got["1"].streaming.findings] == ["ssn", "rule"] and got["1"].streaming.buffer_flushes.on_boundary == 2 and got["1"].streaming.latency.first_byte_ms == 10
    assert got["2"].streaming is None and got["2"].findings == [] and got["2"].enforcement.observed and "false" in got["2"].context_snapshot


def test_large_bodies_are_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(io, "MAX_BODY_BYTES", 5)
    (tmp_path / "r.json").write_text('{"body":"12345"}\n{"body":"123456"}\n{"body":null}\n')
    assert sorted(((r.body, r.status) for r in io.read_requests(spark, str(tmp_path), "body string").collect()), key=str) == [("12345", None), (None, 400), (None, None)]

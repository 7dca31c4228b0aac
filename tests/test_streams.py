"""Holds, logs and joins on streams."""

import datetime
import json
import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from palisade.operators import audit
from palisade.streaming import audit_log, holds, live


def ts(s):
    return datetime.datetime.fromtimestamp(s, datetime.timezone.utc)


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(json.dumps(r) for r in rows))
    time.sleep(0.02)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.STATE_STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def event(scope, hold, kind, at):
    return {"scope": scope, "hold_id": hold, "kind": kind, "ts": datetime.datetime.fromtimestamp(at, datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")}


EVENT = "scope string, hold_id string, kind string, ts timestamp"


def run(frame, name, tmp_path, seconds=100, until=None):
    writer = frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c"))
    if until is None:
        q = writer.trigger(availableNow=True).start()
        q.awaitTermination(seconds)
        return
    q = writer.start()
    try:
        end = time.time() + seconds
        while time.time() < end and not until() and q.isActive:
            time.sleep(0.3)
    finally:
        q.stop()


def plain(events, most, timeout):
    """Changes by scope, in order."""
    out = defaultdict(list)
    pending = defaultdict(dict)

    def expire(scope, now):
        for due, h in sorted((d, h) for h, d in pending[scope].items() if d <= now):
            del pending[scope][h]
            out[scope].append((h, "expired", due))

    for e in sorted(events, key=lambda e: (e[3], e[2] != "create", e[1])):
        scope, h, kind, at = e
        expire(scope, at)
        if kind == "create" and h not in pending[scope]:
            if len(pending[scope]) >= most:
                out[scope].append((h, "refused", at))
            else:
                pending[scope][h] = at + timeout
                out[scope].append((h, "pending", at))
        elif kind != "create" and h in pending[scope]:
            del pending[scope][h]
            out[scope].append((h, kind, at))
    for scope in list(pending):
        expire(scope, 1 << 60)
    return {s: sorted(x) for s, x in out.items()}


def test_hold_machine_by_event_time(rocks, tmp_path):
    """Approved, rejected, expired and refused holds over micro-batches, against plain Python and the batch form."""
    rnd = random.Random(4)
    events = []
    for i in range(60):
        at = 1000 + rnd.randint(0, 300)
        events.append((rnd.choice("ab"), f"h{i}", "create", at))
        if rnd.random() < 0.7:
            events.append((events[-1][0], f"h{i}", rnd.choice(["approved", "rejected"]), at + rnd.randint(1, 45)))
    events.sort(key=lambda e: e[3])
    for k in range(4):
        put(tmp_path / "in", k, [event(*e) for e in events[k * len(events) // 4 : (k + 1) * len(events) // 4]])
    put(tmp_path / "in", "y", [event("z", "end", "create", 5000)])
    put(tmp_path / "in", "z", [event("z", "later", "create", 9000)])
    source = rocks.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    run(holds.hold_machine(source, 5, 30, event_time=True), "holds", tmp_path)
    got = defaultdict(list)
    for r in rocks.table("holds").where("scope <> 'z'").collect():
        got[r.scope].append((r.hold_id, r.status, int(r["at"].replace(tzinfo=datetime.timezone.utc).timestamp() if r["at"].tzinfo is None else r["at"].timestamp())))
    want = plain(events, 5, 30)
    assert {s: sorted(x) for s, x in got.items()} == want
    statuses = {s for x in want.values() for _, s, _ in x}
    assert statuses == {"pending", "approved", "rejected", "expired", "refused"}
    codes = {(r.status, r.client_status, r.client_error) for r in rocks.table("holds").collect()}
    assert ("refused", 503, "holds_capacity") in codes and ("expired", 503, "hold_timeout") in codes and ("approved", None, None) in codes
    # With room for all, the machine and the batch form agree.
    made = rocks.createDataFrame([(h, ts(at)) for _, h, k, at in events if k == "create"], "hold_id string, created_at timestamp")
    answered = rocks.createDataFrame([(h, k, ts(at)) for _, h, k, at in events if k != "create"], "hold_id string, verdict string, decided_at timestamp")
    batch = {r.hold_id: r.status for r in audit.resolve_holds(made, answered, F.lit("2030-01-01").cast("timestamp")).collect()}
    last = {h: s for x in plain(events, 1000, 30).values() for h, s, _ in x if s != "pending"}
    assert batch == last


def test_holds_expire_by_the_clock(rocks, tmp_path):
    put(tmp_path / "in", 0, [event(None, "a", "create", 0), event(None, "b", "create", 0), event(None, "c", "create", 1), event(None, "b", "approved", 2)])
    source = rocks.readStream.schema(EVENT).json(str(tmp_path / "in"))
    name = "clocked"
    run(holds.hold_machine(source, 2, 2), name, tmp_path, until=lambda: rocks.sql(f"select 1 from {name} where status = 'expired'").count() > 0)
    assert sorted((r.hold_id, r.status) for r in rocks.table(name).collect()) == [("a", "expired"), ("a", "pending"), ("b", "approved"), ("b", "pending"), ("c", "refused")]


RULES = '@id("{0}") @enforcement("{1}") forbid(principal, action, resource) when {{ context.model == "bad" }};\npermit(principal, action, resource);'


def test_policies_are_read_for_each_batch(spark, tmp_path):
    folder = tmp_path / "policies"
    folder.mkdir()
    schema = "n long, model string"
    policies = audit_log.Policies(spark, str(folder))

    def step(i, text):
        if text is not None:
            (folder / "p.cedar").write_text(text)
        put(tmp_path / "in", i, [{"n": i * 2, "model": "bad"}, {"n": i * 2 + 1, "model": "good"}])
        source = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        audit_log.audit_stream(source, policies, str(tmp_path / "log"), str(tmp_path / "c")).awaitTermination(60)

    step(0, RULES.format("one", "flag"))
    step(1, RULES.format("two", "block"))
    step(2, "forbid(")  # doesn't compile: the last good ones stay
    assert policies.error
    step(3, RULES.format("three", "hold"))
    rows = audit_log.written(spark, str(tmp_path / "log"), f"{schema}, decided string, rule_id string, policy_version string").orderBy("n").collect()
    assert [(r.n, r.decided, r.rule_id) for r in rows] == [(0, "flag", "one"), (1, "allow", "policy1"), (2, "block", "two"), (3, "allow", "policy1"), (4, "block", "two"), (5, "allow", "policy1"), (6, "hold", "three"), (7, "allow", "policy1")]
    versions = [rows[i].policy_version for i in (0, 2, 4, 6)]
    assert versions[1] == versions[2] and len(set(versions)) == 3 and [r.batch for r in rows] == [0, 0, 1, 1, 2, 2, 3, 3]


def test_batches_are_written_once(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.createDataFrame([(1,), (2,)], "n int")
    assert audit_log.written(spark, path, "n int").count() == 0
    assert audit_log.write_once(df, 7, path) and not audit_log.write_once(df, 7, path)
    # A batch that broke off has no mark: its rows don't count, and the replay takes their place.
    df.write.json(f"{path}/batch=8")
    (tmp_path / "log" / "batch=8" / "_SUCCESS").unlink()
    assert sorted(map(tuple, audit_log.written(spark, path, "n int").collect())) == [(1, 7), (2, 7)]
    assert audit_log.write_once(df, 8, path)
    assert sorted(map(tuple, audit_log.written(spark, path, "n int").collect())) == [(1, 7), (1, 8), (2, 7), (2, 8)]


def test_enrichment_joins_streams(spark, tmp_path):
    """Found in time, found too late, never found."""
    iso = lambda s: ts(s).strftime("%Y-%m-%dT%H:%M:%S.000Z")
    put(tmp_path / "a", 0, [{"audit_id": x, "ts": iso(t)} for x, t in (("in", 1000), ("late", 1000), ("none", 1010))])
    put(tmp_path / "e", 0, [{"parent_audit_id": "in", "ts": iso(1200), "detector_snapshot": "s"}, {"parent_audit_id": "late", "ts": iso(1000 + 700), "detector_snapshot": "s"}, {"parent_audit_id": "stray", "ts": iso(1100), "detector_snapshot": "s"}])
    for k, t in ((1, 5000), (2, 9000)):
        put(tmp_path / "a", k, [{"audit_id": f"x{k}", "ts": iso(t)}])
        put(tmp_path / "e", k, [{"parent_audit_id": "y", "ts": iso(t), "detector_snapshot": "s"}])
    a = spark.readStream.schema("audit_id string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "a"))
    e = spark.readStream.schema("parent_audit_id string, ts timestamp, detector_snapshot string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "e"))
    run(audit_log.enriched_stream(a, e), "enriched", tmp_path)
    got = {r.audit_id: r.detector_snapshot for r in spark.table("enriched").collect()}
    assert got["in"] == "s" and got["late"] is None and got["none"] is None and "x2" not in got


def test_tenants_policies_are_read_for_each_batch(spark, tmp_path):
    """A tenant's broken text leaves its last good one in force, and others go on."""
    folder = tmp_path / "rules"
    for t in ("a", "b"):
        (folder / t).mkdir(parents=True)
    base = 'permit(principal, action, resource);\n@id("base") @enforcement("flag") forbid(principal, action, resource) when { context.model == "odd" };'
    own = '@id("{0}") forbid(principal, action, resource) when {{ context.tool_count > {1} }};'
    (folder / "base.cedar").write_text(base)
    policies = audit_log.TenantPolicies(spark, str(folder))
    schema = "n long, tenant_id string, model string, tool_count long"
    seen = 0

    def step(i):
        nonlocal seen
        rows = [{"n": seen + k, "tenant_id": t, "model": m, "tool_count": 3} for k, (t, m) in enumerate([("a", "x"), ("b", "x"), ("c", "odd"), (None, "x")])]
        seen += len(rows)
        put(tmp_path / "in", i, rows)
        audit_log.audit_stream(spark.readStream.schema(schema).json(str(tmp_path / "in")), policies, str(tmp_path / "log"), str(tmp_path / "c")).awaitTermination(60)

    (folder / "a" / "p.cedar").write_text(own.format("a1", 2))
    (folder / "b" / "p.cedar").write_text(own.format("b1", 5))
    step(0)
    (folder / "a" / "p.cedar").write_text("forbid(")
    (folder / "b" / "p.cedar").write_text(own.format("b2", 1))
    step(1)
    assert set(policies.errors) == {"a"}
    rows = audit_log.written(spark, str(tmp_path / "log"), f"{schema}, decided string, rule_id string, policy_version string").orderBy("n").collect()
    assert [(r.decided, r.rule_id) for r in rows] == [("block", "a1"), ("allow", "policy0"), ("flag", "base"), ("allow", "policy0"), ("block", "a1"), ("block", "b2"), ("flag", "base"), ("allow", "policy0")]
    version = [r.policy_version for r in rows]
    assert version[0] == version[4] and version[1] != version[5] and version[2] == version[3] == version[6] == version[7]

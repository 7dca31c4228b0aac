"""Enforced streams: batch against plain Python, and streams against batch."""

import json
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from palisade.streaming import buffer, live, scan
from palisade.streaming import frames as fr

RULES = """
permit(principal, action, resource);
@id("f") @enforcement("flag") forbid(principal, action == X::Action::"llm.response", resource) when { context.pii_detected };
@id("b") @enforcement("block") forbid(principal, action == X::Action::"llm.response", resource) when { context.pii_detected && context.model == "strict" };
@id("h") @enforcement("hold") @hold_message("wait") forbid(principal, action == X::Action::"llm.response", resource) when { context.pii_detected && context.model == "slow" };
"""
WORDS = ["hello", " world", "\n", "a", "bb ", " joe@example.com ", "ünï", "", "long-run-of-letters", " x", " 4111 1111 1111 1111 ", "tail"]


def said(x):
    return json.dumps({"choices": [{"delta": {"content": x}}]})


def body(rnd, sound=True):
    parts = [said(rnd.choice(WORDS)) for _ in range(rnd.randint(0, 25))]
    for i in range(0, len(parts), 5):
        parts.insert(i, json.dumps({"choices": [{"delta": {"role": "assistant"}, "n": i}]}))
    if rnd.random() < 0.8:
        parts.append("[DONE]")
    text = "".join(f"data: {p}\n\n" for p in parts)
    return text if sound else text + "data: " + said("cut off here joe@example.com")


def chunked(rnd, text):
    out = []
    while text:
        n = rnd.randint(1, 90)
        out, text = [*out, text[:n]], text[n:]
    return out


def plain(text, cap):
    """(kind, text or data, reason) in the order of sending."""
    *events, tail = text.split("\n\n")
    held, out = "", []
    for e in events:
        data = e.removeprefix("data: ")
        if not e:
            continue
        if data == "[DONE]":
            if held:
                out.append(("text", held, "end"))
            held = ""
            out.append(("frame", data, None))
            continue
        word = json.loads(data)["choices"][0]["delta"].get("content")
        if word is None:
            out.append(("frame", data, None))
            continue
        held += word
        if word and len(held.encode()) >= cap:
            out.append(("text", held, "cap"))
            held = ""
        elif any(c in word for c in " \n\r\t"):
            out.append(("text", held, "boundary"))
            held = ""
    if tail:
        out.append(("frame", tail.removeprefix("data: "), None))
    if held:
        out.append(("text", held, "end"))
    return out


def key(r):
    return (r.stream_id, r.at, r.part)


def streams(seed, n=12):
    rnd = random.Random(seed)
    bodies = {s: body(rnd, rnd.random() < 0.8) for s in range(n)}
    return bodies, [(s, i, c) for s, b in bodies.items() for i, c in enumerate(chunked(rnd, b))]


@pytest.mark.parametrize("cap", [1, 16, 1000])
def test_batch_against_plain(spark, cap):
    bodies, rows = streams(cap)
    df = spark.createDataFrame(rows, "stream_id long, seq long, chunk string").repartition(3)
    facts = spark.createDataFrame([(s, ["", "strict", "slow"][s % 3]) for s in bodies], "stream_id long, model string")
    items = sorted(live.enforce(df, RULES, cap, facts=facts).collect(), key=key)
    for s, b in bodies.items():
        mine = [r for r in items if r.stream_id == s]
        want = plain(b, cap)
        assert [(r.kind, r.text, r.reason) if r.kind == "text" else (r.kind, r.output and r.output.removeprefix("data: ").rstrip("\n"), None) for r in mine if r.sent] == want[: sum(r.sent for r in mine)]
        hit = next((i for i, (kind, t, reason) in enumerate(want) if kind == "text" and reason != "end" and ("@example" in t or "4111" in t)), None)
        stopped = hit is not None and s % 3
        assert sum(r.sent for r in mine) == (hit if stopped else len(want))
        if stopped:
            assert mine[hit].verdict == ("block", "hold")[s % 3 - 1] and all(r.output is None for r in mine[hit + 1 :])
            assert "error" in mine[hit].output if s % 3 == 1 else mine[hit].output.endswith("data: [DONE]\n\n")
            assert s % 3 == 2 or json.loads(mine[hit].output.removeprefix("data: "))["error"]["message"] == "b"
        assert not any("joe@" in (r.output or "") for r in mine if r.kind == "text")


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.STATE_STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_stream_against_batch(rocks, tmp_path):
    """Several micro-batches; the last stream never says that it is done."""
    spark = rocks
    bodies, rows = streams(5, 6)
    bodies = {s: b for s, b in bodies.items() if b}
    bodies[6] = f"data: {said('mail joe@exa')}\n\ndata: {said('mple.com now')}\n\ndata: {said('held')}\n\ndata: [DO"
    rows += [(6, i, c) for i, c in enumerate(chunked(random.Random(1), bodies[6]))]
    last = {s: max(i for t, i, _ in rows if t == s) for s in bodies}
    done = [(s, i, c, i == last[s] and s != 6) for s, i, c in rows]
    schema = "stream_id long, seq long, chunk string, done boolean"
    df = spark.createDataFrame(done, schema)
    for k in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        part = [r for r in done if min(r[1] * 3 // (last[r[0]] + 1), 2) == k]
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("stream_id", "seq", "chunk", "done"), r))) for r in part))
        time.sleep(0.02)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = live.enforce_stream(source, RULES, 16, idle_ms=2000)
    run = out.writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        end = time.time() + 200
        while time.time() < end and run.isActive:
            overs = spark.sql("select count(*) from live where kind = 'over'").first()[0]
            if overs == len(bodies):
                break
            time.sleep(0.5)
    finally:
        run.stop()
    got = spark.table("live")
    want = live.enforce(df.drop("done"), RULES, 16)
    pick = lambda d: sorted(map(tuple, d.where("kind <> 'over'").select("stream_id", "at", "part", "kind", "text", "reason", F.to_json("findings"), "verdict", "rule_id", "sent", "output").collect()), key=str)
    assert pick(got) == pick(want)
    verdicts = {r.stream_id: r.verdict for r in got.where("kind = 'over'").collect()}
    assert verdicts == {r.stream_id: r.verdict for r in live.totals(want, df.withColumn("ts", F.current_timestamp())).collect()}


def test_capped_flushes_of_one_long_stream(spark):
    """Against the recurrence; runs without a blank are longer than the cap, and one has no end."""
    rnd = random.Random(3)
    chunks = [rnd.choice(["ab", "c", "defgh", "é", " i", "", "jkl"] if i % 900 < 300 else ["ab", "xyz", "é"]) for i in range(3000)]
    rows = [(1, i * 7, c) for i, c in enumerate(chunks)] + [(2, 0, None), (3, 5, "one"), (3, 9, "two")]
    df = spark.createDataFrame(rows, "stream_id long, seq long, chunk string").repartition(5)
    for cap in (5, 10_000):
        b, want = buffer.Buffer(cap), []
        for i, c in enumerate(chunks):
            if got := b.push(c, i * 7):
                want.append(got)
        if got := b.end():
            want.append(got)
        got = sorted((r.flush_seq, r.last_seq, r.text, r.reason) for r in buffer.flush_capped(df, cap).where("stream_id = 1").collect())
        assert got == sorted(want)
    rest = sorted(map(tuple, buffer.flush_capped(df, 64).where("stream_id <> 1").select("stream_id", "flush_seq", "last_seq", "text", "reason").collect()))
    assert rest == [(3, 0, 9, "onetwo", "end")]


@pytest.mark.parametrize("block, cap", [(1, 5), (3, 1), (3, 12), (16, 5), (16, 60), (512, 12)])
def test_capped_flushes_by_blocks(spark, block, cap):
    """Streams of many blocks, in any order of rows, some flushed by rows that end; nothing is kept in the shared folder."""
    rnd = random.Random(block * 100 + cap)
    rows, want = [], []
    for s in range(12):
        kinds = (["ab", "c", "é", "xyzxyz"], ["ab", " i", "é", "q\n"], ["a", "b", "c d", "longer chunk"])[s % 3]
        b, seq = buffer.Buffer(cap), rnd.randint(-40, 40)
        for _ in range(rnd.randint(1, 80)):
            seq += rnd.choice([1, 1, 1, 2, 30])
            ends = rnd.random() < 0.06
            chunk = "" if ends else rnd.choice(kinds)
            rows.append((s, seq, chunk, ends))
            if got := b.end() if ends else b.push(chunk, seq):
                want.append((s, *got, seq if ends else None))
        if got := b.end():
            want.append((s, *got, None))
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "stream_id long, seq long, chunk string, ends boolean").repartition(3)
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    kept = sorted(map(str, Path(shared).rglob("*")))
    flushes = buffer.flush_capped(df, cap, F.col("ends"), block)
    assert sorted(map(tuple, flushes.select("stream_id", "flush_seq", "last_seq", "text", "reason", "ended_at").collect()), key=str) == sorted(want, key=str)
    assert sorted(map(str, Path(shared).rglob("*"))) == kept


def test_capped_flushes_travel_packed(spark):
    """The chunks are shuffled once, a block a row."""
    df = spark.range(40).selectExpr("id as stream_id", "explode(sequence(0L, 99L)) as seq").withColumn("chunk", F.lit("ab"))
    flushes = buffer.flush_capped(df, 12)
    assert flushes.count() == 40 * 17
    assert "Window" not in flushes._jdf.queryExecution().optimizedPlan().toString()
    packed = df.select("stream_id", "seq", "chunk", F.lit(False).alias("over")).mapInArrow(buffer._pack(512), "stream_id long, _b long, steps array<int>, sizes array<int>, text binary")
    assert packed.count() <= 40 + spark.sparkContext.defaultParallelism * 2


def test_enforced_texts_travel_packed(spark, monkeypatch):
    """Places of events are far apart, yet a stream's texts are one block; nothing is kept in the shared folder."""
    frames = "".join(f"data: {said(w)}\n\n" for w in ["one ", "tw", "o", " three"] * 25)
    df = spark.createDataFrame([(s, i, frames[i * 50 : (i + 1) * 50]) for s in range(6) for i in range(len(frames) // 50 + 1)], "stream_id long, seq long, chunk string")
    met = []
    monkeypatch.setattr(live, "flush_capped", lambda *a: met.append(a) or buffer.flush_capped(*a))
    kept = sorted(map(str, Path(spark.sparkContext.getConf().get("spark.checkpoint.dir")).rglob("*")))
    assert live.enforce(df, RULES, 16).where("kind = 'text'").count() == 6 * 50
    assert sorted(map(str, Path(spark.sparkContext.getConf().get("spark.checkpoint.dir")).rglob("*"))) == kept
    (texts, _, _, block), = met
    rows = texts.select("stream_id", F.col("seq").cast("long"), F.coalesce("chunk", F.lit("")).alias("chunk"), "ends")
    assert rows.count() == 600
    assert rows.mapInArrow(buffer._pack(block), "stream_id long, _b long, steps array<int>, sizes array<int>, text binary").count() == 6


def test_totals(spark):
    df = spark.createDataFrame([(1, 0, f"data: {said('mail joe@example.com ')}\n\n", 0.0), (1, 1, f"data: {said('and rest')}\n\ndata: [DONE]\n\n", 1.5), (2, 0, "", 0.0)], "stream_id long, seq long, chunk string, s double").withColumn("ts", F.timestamp_millis((F.col("s") * 1000).cast("long")))
    items = live.enforce(df, RULES, 100)
    t = {r.stream_id: r for r in live.totals(items, df).collect()}
    assert (t[1].frames_emitted, t[1].flushes_boundary, t[1].flushes_end, t[1].verdict, t[1].rule_id, t[1].stream_duration_ms) == (3, 2, 0, "flag", "f", 1500)
    assert t[1].bytes_emitted == sum(len(r.output.encode()) for r in items.where("stream_id = 1").collect())
    assert [f.pattern for f in t[1].findings] == ["email", "f"] and t[2].verdict == "allow" and t[2].frames_emitted == 0


@pytest.mark.parametrize("provider", ["openai", "anthropic", "gemini"])
def test_hold_frames(spark, provider):
    text = spark.range(1).select(fr.encode_hold(provider, F.lit('wait "here"')).alias("x")).first().x
    events = spark.createDataFrame([(e,) for e in text.split("\n\n") if e], "e string")
    frames = events.select(F.explode(fr.PARSERS[provider](F.col("e"))).alias("f")).select(fr.text_delta(F.col("f.data")).alias("t"), "f.is_done").collect()
    assert frames[0].t == 'wait "here"' and frames[-1].is_done


def test_scan_uses_rule_ids(spark):
    df = spark.createDataFrame([(1, 0, "to joe@example.com", "strict")], "stream_id long, flush_seq int, text string, model string")
    assert json.loads(scan.enforce_flushes(df, RULES).first().output.removeprefix("data: "))["error"]["message"] == "b"

"""The prefix trie against plain Python and against SQL."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from palisade.llm import op11_prefix_trie as op11


def plain(rows):
    """The nodes of (conv_id, turn, role, text) rows, by dictionaries."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            turns[c].append((turn is not None, turn or 0, key, role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in turns.items()}
    whole = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        whole[c] = tuple(own.get(base, [])[:h] + t[h:])
    members = defaultdict(list)
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children = defaultdict(list)
    for t in members:
        if t:
            children[t[:-1]].append(t)

    def below(t):
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t[-1][1])) if t else 0
        leaves, saved = int(not children[t]), (len(members[t]) - 1) * n
        for x in children[t]:
            a, b = below(x)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    out = []
    for t, of in members.items():
        ends = ",".join(str(c) for c in sorted(of) if len(whole[c]) == len(t))
        out.append((min(of), len(t), min(members[t[:-1]]) if t else None, len(of), len(children[t]), *below(t), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, n, deep=6):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-30, 10 * n), n):
        for t in range(rnd.choice([0, 1, 2, 3, deep])):
            rows.append((rnd.choice([c, c, c, None]) if rnd.random() < 0.02 else c, t if rnd.random() < 0.95 else None, rnd.choice(["u", "a", "a", None]), rnd.choice(["x", "x", "one two", "three\x0bfour five", "", None])))
    rows += rnd.choices(rows, k=n // 10)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def nodes(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted((tuple(r) for r in op11.trie(op11.rebuilt(frame)).collect()), key=str)


@pytest.mark.parametrize("seed, block", [(1, 1), (2, 3), (3, 7), (4, 1 << 16), (5, 2)])
def test_against_plain_python(spark, seed, block, monkeypatch):
    monkeypatch.setattr(op11, "BLOCK", block)
    rows = made(seed, 150)
    assert nodes(spark, rows) == plain(rows)


def test_copies_span_blocks(spark, monkeypatch):
    """A third of the conversations alike, and long ones that part late."""
    monkeypatch.setattr(op11, "BLOCK", 4)
    same = [(c, t, "u", f"same {t}") for c in range(0, 400, 20) for t in range(3)]
    late = [(c, t, "u", f"late {t}" if t < 60 else f"{c % 40}") for c in range(1000, 1200, 20) for t in range(62)]
    short = [(c, 0, "u", "same 0") for c in range(2000, 2100, 20)]
    rows = same + late + short
    assert nodes(spark, rows) == plain(rows)


def test_scan_alone():
    """The stack against plain prefixes in one block."""
    import pyarrow as pa

    assert op11.shared(b"a" * 160, b"a" * 144 + b"b" * 16) == 9 and op11.shared(b"", b"a" * 16) == 0 and op11.shared(b"a" * 32, b"a" * 48) == 2
    rows = []
    block = op11._Block(0, rows)
    for c, key in enumerate(["", "a", "ab", "ab", "abc", "b"]):
        block.add(c, "".join(x * 16 for x in key).encode(), [1] * len(key))
    block.end()
    kinds = [r[0] for r in rows]
    assert kinds.count(op11._BLOCK) == 1 and sorted((r[10], r[3]) for r in rows if r[0] == op11._PIECE) == [(1, 1), (2, 0)]
    assert sorted((r[2], r[3], r[5]) for r in rows if r[0] == op11._NODE) == [(1, 1, 4), (2, 2, 3), (4, 3, 1)]
    assert pa.array([r[1] for r in rows]).null_count == 0


def test_empty_and_null(spark):
    assert nodes(spark, [(None, 1, "u", "x")]) == []
    frame = spark.createDataFrame([], SCHEMA)
    assert op11.trie(op11.rebuilt(frame)).count() == 0
    rows = [(1, None, None, None), (1, None, None, None), (21, 0, "", "")]
    assert nodes(spark, rows) == plain(rows)


def test_clashing_columns(spark):
    rows = made(9, 40)
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], f"{SCHEMA}, key string, `a.b` int, Depth int")
    assert sorted((tuple(r) for r in op11.trie(op11.rebuilt(frame)).collect()), key=str) == plain(rows)


def test_against_sql(spark, data):
    for rows in (made(7, 60), None):
        con = duckdb.connect()
        if rows:
            con.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
            con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
        else:
            con.execute(f"create view conversations as select * from '{data}/conversations.parquet'")
        want = sorted(con.execute(op11.SQL).fetchall(), key=str)
        if rows:
            assert want == plain(rows)
        else:
            assert want == sorted((tuple(r) for r in op11.query(spark, data).collect()), key=str)

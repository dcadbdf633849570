"""Conversation repair against plain search over all edits, and its streaming passes over small batches and pieces."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from campaignflow.llm import conversations
from campaignflow.llm.registry import op13_conversations

SCHEMA = "conv_id long, turn long, role string, text string, conv string, mark string, kind int, at int"
WELL_FORMED = re.compile(r"(s?(ua)+)?\Z")
BEGUN = re.compile(r"(s?(ua)*u?)\Z")
BLANKS = "\t\n\x0b\x0c\r "


def planted(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(key.encode()) % 20
        if fault == 4:
            role = "user"
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def by_search(rows):
    """Figures, audit and repaired rows of one conversation; every sequence of edits up to the best cost is tried."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(f"{len(r[2])}:{r[2]}:{r[3]}".encode()).hexdigest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        rest = text.rstrip(BLANKS)
        faults.append("blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None

    def go(i, roles, texts, cost, audit):
        nonlocal best
        if best is not None and cost > best[0] or not BEGUN.match("".join(r[:1] or "?" for r in roles)):
            return
        if i == len(rows) and WELL_FORMED.match("".join(r[:1] for r in roles)):
            if best is None or (cost, audit) < best[:2]:
                best = (cost, audit, [f"{r}:{t}" for r, t in zip(roles, texts)])
            return
        if i < len(rows):
            _, _, role, text = rows[i]
            extra = 3 * (faults[i] == "truncated")
            if faults[i] not in ("blank", "duplicate"):
                go(i + 1, [*roles, role], [*texts, text], cost + extra, audit + "K")
                for new in ("user", "assistant"):
                    go(i + 1, [*roles, new], [*texts, text], cost + extra + 3, audit + "R")
            go(i + 1, roles, texts, cost + 4, audit + "D")
        if not audit.endswith("II"):
            for new in ("user", "assistant"):
                go(i, [*roles, new], [*texts, ""], cost + 3, audit + "I")

    go(0, [], [], 0, "")
    turns = [r[1] for r in rows if r[1] is not None]
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, *best[:2], best[2])


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = ["Yes.", "No!", "and then", "", " \t", "Why? \n", "Ünï.", None, "x" * 5000 + "."]
    out = [(None, 0, "user", "Hi."), (None, None, "assistant", "Yes."), (1, None, None, None), (2, 0, "tool", "Yes."), (3, 0, "", "No!"), (4, 0, "system", "Yes.")]
    for conv in range(10, 130):
        for turn in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ["user", "assistant"][turn % 2]
            out.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice([role] * 8 + ["system", "tool"]), rng.choice(texts[:3] if rng.random() < 0.8 else texts)))
    return out + [out[10]] * 3


@pytest.fixture(scope="module")
def frame(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("conversations") / "conversations.parquet")
    spark.createDataFrame([(*r, "c", "m", 1, 2) for r in rows], SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def expected(rows):
    after = planted(rows)
    return {conv: by_search([r for r in after if r[0] == conv]) for conv in {r[0] for r in rows}}


@pytest.mark.parametrize("chunk, batch", [(1 << 16, 10000), (2, 3)])
def test_audit_is_the_cheapest_and_least(spark, rows, frame, chunk, batch, monkeypatch):
    monkeypatch.setattr(conversations, "CHUNK", chunk)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    got = {r[0]: tuple(r[1:]) for r in conversations.audited(conversations.damaged(frame), known=frame).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {c: (*w[:7], hashlib.sha256("\n".join(w[7]).encode()).hexdigest()) for c, w in expected(rows).items()}


def test_repaired_rows(spark, rows, frame):
    got = conversations.repaired(conversations.damaged(frame)).collect()
    for conv, want in expected(rows).items():
        own = sorted((r for r in got if r["conv_id"] == conv), key=lambda r: r["step"])
        assert "".join(r["edit"] for r in own) == want[6]
        assert [f"{r['role']}:{r['text']}" for r in own if r["place"] is not None] == want[7]


def test_long_conversation_streams_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(conversations, "CHUNK", 100)
    many = spark.range(5000).selectExpr("7L conv_id", "id turn", "IF(id % 2 = 0, 'user', 'assistant') role", "concat('t', id, '.') text")
    got = conversations.audited(many).collect()
    assert len(got) == 1 and got[0]["audit"] == "K" * 5000 and got[0]["cost"] == 0
    assert got[0]["repaired_sha256"] == hashlib.sha256("\n".join(f"{'assistant' if i % 2 else 'user'}:t{i}." for i in range(5000)).encode()).hexdigest()


def test_sql_and_empty_table(spark, frame, rows, tmp_path):
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.execute(conversations.ORACLE).fetchall()
    assert {tuple(r) for r in op13_conversations(spark, str(tmp_path)).collect()} == set(want)
    none = spark.createDataFrame([], SCHEMA)
    assert conversations.audited(conversations.damaged(none), known=none).count() == 0 and conversations.repaired(none).count() == 0

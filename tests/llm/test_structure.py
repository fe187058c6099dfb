"""Operator 13 against all edit sequences of short conversations, and over odd rows."""

import hashlib
import random
import re

from lodestone.llm import registry, structure

SCHEMA = "blank string, conv_id long, turn long, role string, text string, gone boolean, nth int"


def brute(rows):
    """Least (cost, audit) over all edits of (initial, must go, truncated)."""
    out = []

    def go(i, roles, cost, audit, inserted):
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            out.append((cost, audit))
        if cost > 3 * len(rows) + 2:
            return
        if inserted < 2:
            for r in "ua":
                go(i, roles + r, cost + 2, audit + "I", inserted + 1)
        if i < len(rows):
            one, bad, cut = rows[i]
            go(i + 1, roles, cost + 3, audit + "D", 0)
            if not bad:
                for r in "ua":
                    go(i + 1, roles + r, cost + 2 + cut, audit + "R", 0)
                go(i + 1, roles + one, cost + cut, audit + "K", 0)

    go(0, "", 0, "", 0)
    return min(out)


def repair(parser, rows):
    now = structure.Conversation(parser, 1, lambda *turn: None)
    for one, bad, cut in rows:
        now.add(None, one.encode(), b"", bad, False, cut)
    report = now.close()
    return report["cost"], report["audit"]


def test_least_edits():
    rng, parser = random.Random(3), structure.Parser()
    for _ in range(250):
        rows = [(rng.choice("suaxuua"), rng.random() < 0.2, rng.random() < 0.25) for _ in range(rng.randint(0, 4))]
        rows = [(o, b, c and not b) for o, b, c in rows]
        assert repair(parser, rows) == brute(rows), rows


def test_long_undecided_conversations_take_linear_time():
    parser = structure.Parser()
    cost, audit = repair(parser, [("u", False, False)] * 60_001)
    assert cost == 60_002 and audit.startswith("KIKRKR") and len(audit) == 60_002
    assert len(parser.known) < 200


def test_right_conversations_cost_nothing():
    parser = structure.Parser()
    for k in (0, 1, 5):
        for head in ([], [("s", False, False)] if k else []):
            assert repair(parser, head + [("u", False, False), ("a", False, False)] * k) == (0, "K" * (len(head) + 2 * k))


def frame(spark, rows):
    return spark.createDataFrame([("b", *r, 1) for r in rows], SCHEMA)


ODD = [
    (1, 0, "user", "hi.", False), (1, 1, "assistant", "yes.", False), (2, None, None, "x.", False), (2, None, "user", None, False), (2, 3, "user", "q?", False), (2, 3, "user", "q?", False),
    (2, 7, "assistant", "cut", False), (3, 0, "user", "gone.", True), (4, None, "", "\x0b\n", False), (None, 0, "user", "lost.", False), (5, 2, "assistant", "é" * 300_000 + "!", False), (5, 1, "user", "é. ", False),
]


def test_odd_rows_and_clashing_columns(spark):
    got = {r["conv_id"]: r for r in structure.reports(frame(spark, ODD), gone="gone").collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    assert (got[1]["cost"], got[1]["audit"], got[1]["repaired_sha256"]) == (0, "KK", hashlib.sha256(b"user:hi.\nassistant:yes.").hexdigest())
    assert (got[2]["gaps"], got[2]["blank"], got[2]["duplicate"], got[2]["truncated"]) == (3, 1, 1, 1)
    assert got[3].asDict() == {"conv_id": 3, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    assert (got[4]["blank"], got[4]["cost"], got[4]["audit"]) == (1, 3, "D")
    assert (got[5]["truncated"], got[5]["cost"], got[5]["audit"]) == (1, 1, "KK")  # a no-break space is no white space


def test_repaired_turns_give_the_digests(spark):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "user", "assistant", "system", "tool"]), rng.choice(["a.", "b?", "c", " ", f"d{t}!"]), rng.random() < 0.1) for c in range(80) for t in range(rng.randint(0, 9))]
    df = frame(spark, rows).repartition(5)
    turns = {}
    for r in structure.repaired(df, gone="gone").orderBy("conv_id", "place").collect():
        turns.setdefault(r["conv_id"], []).append(r)
    for r in structure.reports(df, gone="gone").collect():
        own = turns.get(r["conv_id"], [])
        assert re.fullmatch("(s?(ua)+)?", "".join(t["role"][0] for t in own))
        assert [t["place"] for t in own] == list(range(len(own))) and "".join(t["edit"] for t in own) == r["audit"].replace("D", "")
        assert hashlib.sha256("\n".join(f"{t['role']}:{t['text']}" for t in own).encode()).hexdigest() == r["repaired_sha256"]


def test_empty(spark):
    assert structure.reports(frame(spark, []), gone="gone").collect() == [] and structure.repaired(frame(spark, [])).collect() == []


def test_query_counts_every_conversation(spark):
    path = "/root/testdata/sf0.001"
    got = registry.QUERIES["op13_structure_repair"](spark, path)
    assert got.count() == spark.read.parquet(f"{path}/conversations.parquet").select("conv_id").distinct().count()

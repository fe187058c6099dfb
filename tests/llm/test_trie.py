"""Operator 11 against a trie built in memory, over odd conversations and tries handed on in parts."""

import hashlib
import zlib

import pytest

from lodestone.llm import registry, trie

SCHEMA = "node string, conv_id long, turn long, role string, text string, depth int"


def brute(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            said = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role, said, text))
    for own in turns.values():
        own.sort()
    members, ends = {}, {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        path = [(r, t) for *_, r, _, t in turns.get(base, [])[:h]] + [(r, t) for *_, r, _, t in turns[c][h:]]
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
        ends.setdefault(tuple(path), []).append(c)
    kids = {}
    for n in members:
        if n:
            kids.setdefault(n[:-1], []).append(n)

    def leaves(n):
        return sum(map(leaves, kids[n])) if n in kids else 1

    def saved(n):
        return (len(members[n]) - 1) * len(n[-1][1] if n else "") + sum(map(saved, kids.get(n, [])))

    return sorted(
        (min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(kids.get(n, [])), leaves(n), saved(n), hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest())
        for n in members
    )


def found(df, **more):
    out = trie.trie(df, **more).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(r) for r in out.collect())


ODD = [
    (0, 0, "user", "a"), (0, 1, "assistant", "b"), (0, 2, "user", "c"), (0, 3, "assistant", "d"), (0, 4, "user", "e"), (0, 5, "assistant", "f"),
    (3, 0, "system", None), (3, None, None, "x"), (3, None, "user", "x"), (3, 1, "user", "x" * 200_000), (4, 0, "user", ""), (4, 0, "user", ""), (4, 0, "user", "a"),
    (250, 0, "user", "no base"), (251, 0, "user", "no base"), (252, 0, "user", "no base"), (-7, 0, "user", "a"), (-150, 1, "user", "é\n"), (-199, 1, "user", "é\n"),
    (None, 0, "user", "lost"), (501, 0, "user", "a"), (502, 0, "user", "a"),
]


def test_odd_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([("n", c, t, r, x, 1) for c, t, r, x in ODD], SCHEMA)
    assert found(df) == brute(ODD)


@pytest.mark.parametrize("most", [1, 7, 100_000])
def test_many_families_and_parts(spark, most):
    rows = []
    for c in range(700):
        for t in range(c * 7 % 13):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", "same" if c % 3 == 0 or t < 3 else f"{t} {c % 5}"))
    rows.append((699, 99, "user", "end"))
    df = spark.createDataFrame([("n", c, t, r, x, 1) for c, t, r, x in rows], SCHEMA).repartition(7)
    assert found(df, most=most) == brute(rows)


def test_long_conversation_in_parts():
    out = []
    family = trie.Family(0, out.append, 50)
    for c in (0, 1):
        family.begin(c)
        for t in range(1000):
            family.turn(bytes([t % 251]) * 16, 1)
    family.end()
    family.flush()
    assert max(r[1] for r in out) > 5 and {r[6] for r in out} >= {1} and sum(r[6] for r in out if r[2] == trie.ROOT) == 2


def test_empty(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_query_against_brute_force(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = registry.QUERIES["op11_prefix_trie"](spark, path)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(tuple(r) for r in got.select(names).collect()) == brute(rows)

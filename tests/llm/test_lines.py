"""Operator 12 against a count in memory, and its filters."""

import hashlib
from collections import Counter, defaultdict

import numpy as np

from lodestone.llm import lines, registry

SCHEMA = "key string, doc_id long, text string, lines int, n_dropped int"
WHITE = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def key(line):
    return line.strip(WHITE).translate(LOWER)


def brute(rows, documents=10, least=1, keep_first=False):
    holders, first = defaultdict(set), {}
    for doc, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            if len(key(line)) >= least:
                holders[key(line)].add(doc)
                at = (doc is None, doc or 0, n)
                first[key(line)] = min(first.get(key(line), at), at)
    out = []
    for doc, text in rows:
        own = (text or "").split("\n")
        gone = {n for n, x in enumerate(own) if len(key(x)) >= least and len(holders[key(x)]) >= documents and not (keep_first and first[key(x)] == (doc is None, doc or 0, n))}
        out.append((doc, "\n".join(x for n, x in enumerate(own) if n not in gone), len(own), len(gone)))
    return Counter(out)


def found(df, **more):
    return Counter(tuple(r) for r in lines.cut_lines(df, **more).collect())


def table(spark, rows):
    return spark.createDataFrame([("k", d, t, 1, 2) for d, t in rows], SCHEMA)


ODD = (
    [(i, f"Header\n\ttext {i}\nheader \x0b\n \nfoot er{i % 3}") for i in range(12)]
    + [(5, "Header\n\ttext 5\nheader \x0b\n \nfoot er2")] * 3  # repeated rows
    + [(6, "other text of the same id\nfoot er2"), (None, "header\nx"), (None, "HEADER"), (20, None), (21, ""), (22, "\n\n"), (23, "É\né" + "x" * 300_000 + "\nheader")]
    + [(30 + i, "in nine ") for i in range(9)]
)


def test_odd_rows_and_clashing_columns(spark):
    df = table(spark, ODD)
    assert found(df) == brute(ODD)
    assert found(df, documents=2, least_chars=7) == brute(ODD, 2, 7)
    assert found(df, documents=3, keep_first=True) == brute(ODD, 3, keep_first=True)


def test_repeats_across_partitions_and_copies(spark):
    rows = [(i, f"one of {i % 40}\nalone {i}\ncommon") for i in range(900)] + [(1000 + i, "a copy\ncommon\nof a text") for i in range(500)]
    assert found(table(spark, rows).repartition(13)) == brute(rows)


def test_empty(spark):
    assert not found(table(spark, []))


def test_filters_know_what_was_seen_twice():
    rng = np.random.default_rng(5)
    hashes = rng.integers(0, 2**63, 4000).astype(np.uint64)
    a, b = lines.Seen(1024), lines.Seen(1024)
    a.add(hashes[:2000])
    a.add(hashes[1900:2100])  # 100 twice in one task
    b.add(hashes[2050:])  # 50 once in both tasks
    twice = a.twice | b.twice | (a.once & b.once)
    at, mask = lines._places(hashes, 1024)
    known = (twice[at] & mask) == mask
    assert known[1900:2000].all() and known[2050:2100].all() and known.mean() < 0.4


def test_query_against_brute_force(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((d, n, gone, hashlib.sha256(t.encode()).hexdigest()) for (d, t, n, gone), c in brute(rows).items() for _ in range(c))
    got = registry.QUERIES["op12_line_dedup"](spark, path).select("doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert sorted(tuple(r) for r in got.collect()) == want and sum(w[2] for w in want)

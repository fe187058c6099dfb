"""A prefix trie over rebuilt conversations, family by family and then as a whole (operator 11).

A family is the conversations of one base id; its base's first turns open every conversation of the family again.

1. Turns become digests where they are read; texts are not shuffled. A family's base turns and conversations come to one
   task in order, which rebuilds each conversation and builds the family's trie: one row for each node of the family, with
   counts, the smallest member and the ids that end there. A trie that grows beyond MOST_NODES is handed on in parts.
2. Only these combined rows are shuffled by node and merged: an aggregation with partial sums, so nodes that all families
   share (the root, a common first turn) arrive combined.
3. Sums over subtrees need no walk over depths. A node's leaves and saved tokens are the sums, over the families under it, of what
   each family's nodes hold: its members' share of every shared node, and what goes with the node's smallest member once. So
   shared nodes go back to the families that have them, are summed from the deepest up in one ordered pass, and
   are merged once more. Nodes of one conversation have one leaf and save nothing.
4. Ids that end at a node are hashed in order from the families' pieces, which are in order of the base ids.

A node is known by a digest chained over its turns. Nodes that a large share of rows or children have are salted.

Edge cases: null roles and texts become empty; turns with no number come first, ties go by role, then by the digest of the turn; repeated rows are
turns of their own; rows without a conversation's id belong to none and are left out; a rebuilt conversation may have no
turns; an empty table gives an empty table (no member, no root); other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Ids of a family: those that give the same base, c - c % FAMILY.
FAMILY, MOST_OPENING = 100, 5
MOST_NODES = 100_000
ROOT = bytes(16)

NODES = "base long, part int, node binary, parent binary, depth long, chars long, n_convs long, conv_id long, n_ends long, ends string"


def opening(conv: int) -> int:
    """How many of its base's turns open a conversation."""
    return zlib.crc32(str(conv).encode()) % (MOST_OPENING + 1)


class Family:
    """The trie of one family, as rows (part, node, parent, depth, chars, n_convs, conv_id, ends)."""

    def __init__(self, base: int, put, most: int = MOST_NODES):
        self.base, self.put, self.most, self.part, self.opens = base, put, most, 0, []
        self.nodes: dict[bytes, list] = {}
        self.conv = None

    def open(self, digest: bytes, chars: int) -> None:
        """One more turn of the base conversation; the first ones open others."""
        if len(self.opens) < MOST_OPENING:
            self.opens.append((digest, chars))

    def begin(self, conv: int) -> None:
        self.end()
        if len(self.nodes) > self.most:
            self.flush()
        self.conv, self.skip, self.at, self.depth = conv, opening(conv), ROOT, 0
        self._enter(ROOT, b"", 0, 0)
        for digest, chars in self.opens[: self.skip]:
            self.go(digest, chars)

    def turn(self, digest: bytes, chars: int) -> None:
        """The conversation's own next turn; its first ones are replaced by the base's."""
        if self.skip:
            self.skip -= 1
        else:
            self.go(digest, chars)

    def go(self, digest: bytes, chars: int) -> None:
        before, self.at, self.depth = self.at, hashlib.blake2b(self.at + digest, digest_size=16).digest(), self.depth + 1
        self._enter(self.at, before, self.depth, chars)
        if len(self.nodes) > 2 * self.most:
            self.flush()  # within one very long conversation: its nodes so far are not entered again

    def _enter(self, node: bytes, parent: bytes, depth: int, chars: int) -> None:
        own = self.nodes.get(node)
        if own is None:
            self.nodes[node] = own = [parent, depth, chars, 0, self.conv, []]
        own[3] += 1

    def end(self) -> None:
        if self.conv is not None:
            if self.at not in self.nodes:  # handed on already: only the end is new
                self.nodes[self.at] = [None, self.depth, 0, 0, self.conv, []]
            self.nodes[self.at][5].append(self.conv)
            self.conv = None

    def flush(self) -> None:
        for node, (parent, depth, chars, n, least, ends) in self.nodes.items():
            self.put((self.base, self.part, node, parent, depth, chars, n, least, len(ends), ",".join(map(str, ends)) if ends else None))
        self.nodes, self.part = {}, self.part + 1


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[t]) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])


def family_nodes(df: DataFrame, conv: str, turn: str, role: str, text: str, most: int = MOST_NODES) -> DataFrame:
    """The rows of every family's trie."""
    common.ship(df.sparkSession)
    who, words = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    turns = df.select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), who.alias("role"),
        F.unhex(F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, words).cast("binary"))).alias("digest"), F.length(words).cast("long").alias("chars"),
    ).where("conv_id IS NOT NULL").withColumn("base", F.expr(f"conv_id - conv_id % {FAMILY}"))
    # Cogrouped by base id: the base's turns come first, then all conversations, the base among them.
    sides = turns.withColumn("opens", F.explode(F.when(F.col("conv_id") == F.col("base"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
    rows = sides.repartition("base").sortWithinPartitions("base", F.desc("opens"), "conv_id", F.asc_nulls_first("turn"), "role", "digest")

    def run(batches: Iterator[pa.RecordBatch]):
        out: list[tuple] = []
        now = None
        for batch in batches:
            for base, opens, name, digest, chars in zip(*(batch.column(c).to_pylist() for c in ("base", "opens", "conv_id", "digest", "chars")), strict=True):
                if now is None or now.base != base:
                    if now is not None:
                        now.end()
                        now.flush()
                    now = Family(base, out.append, most)
                if opens:
                    now.open(digest, chars)
                    continue
                if now.conv != name:
                    now.begin(name)
                now.turn(digest, chars)
            yield _batch(out, NODES)
            out.clear()
        if now is not None:
            now.end()
            now.flush()
            yield _batch(out, NODES)

    return rows.select("base", "opens", "conv_id", "digest", "chars").mapInArrow(run, NODES)


def end_digests(pieces: DataFrame) -> DataFrame:
    """(node, ends_sha256): the ids that end at a node, hashed piece by piece in order."""

    def run(batches: Iterator[pa.RecordBatch]):
        node, sha, out = None, None, []
        for batch in common.slices(batches, "ends"):
            for own, ends in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                if own != node:
                    if node is not None:
                        out.append((node, sha.hexdigest()))
                    node, sha = own, hashlib.sha256(ends.encode())
                else:
                    sha.update(b"," + ends.encode())
            yield _batch(out, "node binary, ends_sha256 string")
            out.clear()
        if node is not None:
            yield _batch([(node, sha.hexdigest())], "node binary, ends_sha256 string")

    return pieces.repartition("node").sortWithinPartitions("node", "base", "part").select("node", "ends").mapInArrow(run, "node binary, ends_sha256 string")


def subtree_sums(shared: DataFrame) -> DataFrame:
    """(node, saved, leaves) of each family's shared nodes, summed over the family's subtree; rows need base, node, parent, depth, saved, leaves."""

    def run(batches: Iterator[pa.RecordBatch]):
        base, up, node, parent, saved, leaves, out = None, {}, None, None, 0, 0, []

        def close():
            if node is not None:
                out.append((node, saved, leaves))
                if parent is not None:
                    above = up.setdefault(parent, [0, 0])
                    above[0] += saved
                    above[1] += leaves

        for batch in batches:
            for b, own, its, s, n in zip(*(batch.column(c).to_pylist() for c in ("base", "node", "parent", "saved", "leaves")), strict=True):
                if (b, own) != (base, node):
                    close()
                    if b != base:
                        base, up = b, {}
                    node, parent = own, None
                    saved, leaves = up.pop(own, (0, 0))
                parent = parent if its is None else its
                saved, leaves = saved + s, leaves + n
            yield _batch(out, "node binary, saved long, leaves long")
            out.clear()
        close()
        yield _batch(out, "node binary, saved long, leaves long")

    ordered = shared.repartition("base").sortWithinPartitions("base", F.desc("depth"), "node")
    return ordered.select("base", "node", "parent", "saved", "leaves").mapInArrow(run, "node binary, saved long, leaves long")


def trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most: int = MOST_NODES) -> DataFrame:
    """One row for each node: node and parent (digests), conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    own = common.staged(family_nodes(df, conv, turn, role, text, most), "family-nodes")
    merged = own.groupBy("node").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.max("chars").alias("chars"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.count("*").alias("rows")
    )
    merged = common.staged(merged, "nodes")
    total = merged.count()
    alone = F.col("n_convs") == 1
    below = merged.where("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.sum(alone.cast("long")).alias("_alone"))
    shared = merged.where(~alone).join(below, "node", "left").select(
        "node", F.col("conv_id").alias("_least"), F.col("chars").alias("_chars"), F.when(F.coalesce("n_children", F.lit(0)) == 0, 1).otherwise(F.col("_alone")).alias("_leaves"), "rows"
    )
    # A conversation's share: its turn's code points at every shared node; the smallest member's family gives one back and has the leaves.
    first = (F.col("conv_id") == F.col("_least")) & (F.col("n_convs") > 0)
    of_family = common.spread_join(own.select("base", "node", "parent", "depth", "n_convs", "conv_id"), shared, "node", "rows", own.count(), "base").select(
        "base", "node", "parent", "depth", (F.col("n_convs") * F.col("_chars") - F.when(first, F.col("_chars")).otherwise(0)).alias("saved"), F.when(first, F.col("_leaves")).otherwise(0).cast("long").alias("leaves")
    )
    sums = subtree_sums(of_family).groupBy("node").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    ends = end_digests(own.where("n_ends > 0").select("node", "base", "part", "ends"))
    above = merged.where(~alone).join(below, "node").select(F.col("node").alias("parent"), F.col("conv_id").alias("_above"), F.col("n_children").alias("rows"))
    named = common.spread_join(merged.select("node", "parent", "conv_id", "depth", "n_convs"), above, "parent", "rows", total, "node", how="left")
    # A node without a shared parent continues its own conversation's.
    parent_conv = F.when(F.col("depth") > 0, F.coalesce("_above", "conv_id"))
    whole = named.join(below.drop("_alone"), "node", "left").join(sums, "node", "left").join(ends, "node", "left")
    return whole.select(
        "node", F.when(F.col("depth") > 0, F.col("parent")).alias("parent"), "conv_id", "depth", parent_conv.alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("node", "parent")


def oracle() -> str:
    """The same with whole prefixes as keys and every node joined to all nodes above it."""
    from .structure import CRC32

    return f"""
    WITH ids AS (SELECT DISTINCT conv_id AS c, conv_id - conv_id % {FAMILY} AS base, {CRC32.format("conv_id::VARCHAR")} % 6 AS h FROM conversations WHERE conv_id IS NOT NULL),
    turns AS (SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS said, length(coalesce(text, '')) AS chars,
              row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), said) AS k FROM conversations),
    rebuilt AS (SELECT c, k, said, chars FROM ids JOIN turns ON conv_id = base AND k <= h
                UNION ALL SELECT c, k + 10, said, chars FROM ids JOIN turns ON conv_id = c AND k > h),
    path AS (SELECT c, row_number() OVER own AS d, string_agg(said, '') OVER own AS node, chars FROM rebuilt WINDOW own AS (PARTITION BY c ORDER BY k)
             UNION ALL SELECT c, 0, '', 0 FROM ids),
    ended AS (SELECT *, d = max(d) OVER (PARTITION BY c) AS last FROM path),
    nodes AS (SELECT node, d, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
              sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE last), '')) AS ends_sha256 FROM ended GROUP BY node, d),
    up AS (SELECT u.node, u.n_convs, u.chars, p.node AS above, p.d AS above_d FROM nodes u JOIN path p ON p.c = u.conv_id AND p.d <= u.d),
    kids AS (SELECT above AS node, count(*) AS n_children FROM up JOIN nodes USING (node) WHERE above_d = nodes.d - 1 GROUP BY above),
    sums AS (SELECT above AS node, count(*) FILTER (WHERE k.node IS NULL) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens
             FROM up LEFT JOIN kids k ON k.node = up.node GROUP BY above)
    SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
    FROM nodes n LEFT JOIN up ON up.node = n.node AND up.above_d = n.d - 1 LEFT JOIN nodes p ON p.node = up.above AND n.d > 0
    LEFT JOIN kids k ON k.node = n.node JOIN sums s ON s.node = n.node
    """

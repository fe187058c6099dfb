"""Sharding along a Hilbert curve (operator 8), in DataFrame functions only.

Each metadata dimension becomes an order-preserving number and is cut at its quantiles into 2**bits steps, so that every
step holds a like share of rows. The steps' bits walk a state table of the Hilbert curve (made from a rule below) to a
curve index; rows sort by it, and runs of the sorted order are cut into shards whose counts differ by one at most.
Neighbours on the curve are neighbours in every dimension, so the files of a shard have narrow ranges in all of them.
The global position comes from positions within range partitions plus the partitions' offsets: no row passes a
single task. Rows of a group (equal texts) take the group's smallest place on the curve, so they stand together wherever their own
metadata would put them; only a cut between shards can part them, as counts differ by one at most.

Edge cases: null sizes count as 0 bytes, null categories sort first; rows repeated in full are told apart by their
place in the input; with fewer rows than shards the last shards stay empty; an empty table gives an empty table;
further columns of the input are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

LOCAL_BITS = 33  # of monotonically_increasing_id


def curve_table(dims: int) -> list[int]:
    """For state * 2**dims + corner: next state * 2**dims + rank of that corner along the curve.

    A state is an entry corner and a direction; corners are transformed into the state's frame, where the curve visits
    them in Gray-code order (Hamilton and Rau-Chaplin, compact Hilbert indices).
    """
    corners = 1 << dims

    def turn(x: int, by: int) -> int:
        by %= dims
        return (x << by | x >> (dims - by)) & (corners - 1)

    def ones(x: int) -> int:
        return ((x ^ (x + 1)) >> 1).bit_count()

    def entry(w: int) -> int:
        even = 2 * ((w - 1) // 2)
        return even ^ even >> 1 if w else 0

    def direction(w: int) -> int:
        return 0 if not w else ones(w if w & 1 else w - 1) % dims

    rank_of_gray = {w ^ w >> 1: w for w in range(corners)}
    table = []
    for state in range(corners * dims):
        at, along = divmod(state, dims)
        for corner in range(corners):
            w = rank_of_gray[turn(corner ^ at, dims - (along + 1))]
            after = (at ^ turn(entry(w), along + 1)) * dims + (along + direction(w) + 1) % dims
            table.append(after * corners + w)
    return table


def hilbert_index(steps: list[Column], bits: int) -> Column:
    """Curve index of integer coordinates of `bits` bits each, first coordinate in the lowest bit of a corner."""
    dims = len(steps)
    table = F.array(*[F.lit(x) for x in curve_table(dims)])
    corners = [
        reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.shiftright(s.cast("int"), level).bitwiseAND(1), k) for k, s in enumerate(steps)])
        for level in reversed(range(bits))
    ]
    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("index"))

    def step(acc: Column, corner: Column) -> Column:
        found = F.get(table, F.shiftleft(acc["state"], dims).bitwiseOR(corner))
        return F.struct(F.shiftright(found, dims).alias("state"), F.shiftleft(acc["index"], dims).bitwiseOR(found.bitwiseAND((1 << dims) - 1)).alias("index"))

    return F.aggregate(F.array(*corners), start, step, lambda acc: acc["index"])


def string_number(c: Column) -> Column:
    """A category; shard_table numbers those in the order of whole strings, null first."""
    return c.cast("string")


def size_number(c: Column) -> Column:
    return F.coalesce(c.cast("long"), F.lit(-1).cast("long"))


def quantised(df: DataFrame, dims: list[str], bits: int, accuracy: int = 10_000) -> list[Column]:
    """Steps 0 to 2**bits - 1 of numeric columns, cut at approximate quantiles (one aggregate row goes to the driver)."""
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    cuts = df.agg(*[F.percentile_approx(d, shares, accuracy).alias(d) for d in dims]).first()
    steps = []
    for d in dims:
        own = sorted(set(cuts[d] or []))
        steps.append(reduce(lambda a, b: a + b, [(F.col(d) > F.lit(x)).cast("int") for x in own], F.lit(0)))
    return steps


def positions(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds `position` (0-based, global, in the given total order) and `total`; written once to the shared folder.

    Range partitions are sorted on their own; a position is the place in the partition plus the sizes of the partitions before.
    """
    local = F.monotonically_increasing_id()
    placed = common.staged(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", local)
        .select("*", F.shiftright("_at", LOCAL_BITS).alias("_part"), F.col("_at").bitwiseAND((1 << LOCAL_BITS) - 1).alias("_local"))
        .drop("_at"),
        name,
    )
    counts = placed.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(  # one row for each partition, whatever the number of rows
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"), F.sum("_rows").over(W.partitionBy(F.lit(1))).alias("total")
    )
    return placed.join(F.broadcast(starts), "_part").withColumn("position", F.col("_start") + F.col("_local")).drop("_part", "_local", "_start")


def cut(position: Column, total: Column, shards: int) -> tuple[Column, Column]:
    """Shard and slot of a position: runs whose lengths differ by one at most, longer ones first."""
    small, rest = F.floor(total / shards).cast("long"), total % shards
    long_rows = rest * (small + 1)
    shard = F.when(position < long_rows, F.floor(position / (small + 1))).otherwise(rest + F.floor((position - long_rows) / F.greatest(small, F.lit(1)))).cast("int")
    return shard, position - (shard * small + F.least(shard.cast("long"), rest))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """The frame with the column's strings replaced by their places among the distinct ones, ranked by range partitions."""
    ranks = positions(df.select(F.col(name).alias("_value")).distinct(), ["_value"], "shard-categories").select("_value", F.col("position").alias("_rank"))
    return df.join(ranks, F.col(name).eqNullSafe(F.col("_value"))).withColumn(name, F.col("_rank")).drop("_value", "_rank")


def together(rows: DataFrame, group: list[str], names: list[str]) -> DataFrame:
    """Dimensions of a group's rows become those of its smallest row. Only groups that differ in them are joined; large ones are spread."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in group])
    place = F.struct(*names)
    mixed = rows.groupBy(key.alias("_group")).agg(F.min(place).alias("_least"), F.max(place).alias("_most"), F.count("*").alias("rows")).where("_least <> _most").drop("_most")
    mixed = common.staged(mixed, "shard-groups")
    joined = common.spread_join(rows.withColumn("_group", key), mixed, "_group", "rows", rows.count(), "_row", how="left")
    own = [F.when(F.col("_least").isNotNull(), F.col(f"_least.{n}")).otherwise(F.col(n)).alias(n) for n in names]
    return joined.select(*[c for c in rows.columns if c not in names], *own)


def shard_table(df: DataFrame, dims: dict[str, Column], ties: list[str], keep: list[str], shards: int = 8, bits: int = 5, group: list[str] | None = None) -> DataFrame:
    """Columns keep, curve, shard, slot: rows in the order of the Hilbert index over dims (numbers or strings), then ties.

    Rows that agree in the columns `group`, which are the first ties, stand together.
    """
    names = [f"_d{k}" for k in range(len(dims))]
    small = common.staged(
        df.select(*dict.fromkeys([*keep, *ties]), *[c.alias(n) for n, c in zip(names, dims.values(), strict=True)], F.monotonically_increasing_id().alias("_row")), "shard-keys"
    )
    for name in [n for n, kind in small.dtypes if n in names and kind == "string"]:
        small = numbered(small, name)
    if group:
        small = together(small, group, names)
    ordered = small.withColumn("curve", hilbert_index(quantised(small, names, bits), bits))
    placed = positions(ordered, ["curve", *names, *ties, "_row"], "shard-order")
    shard, slot = cut(F.col("position"), F.col("total"), shards)
    return placed.select(*keep, "curve", shard.alias("shard"), slot.alias("slot"))


def write_shards(df: DataFrame, dims: dict[str, Column], ties: list[str], path: str, shards: int = 8, bits: int = 5) -> None:
    """The frame's rows into one folder a shard, in curve order. Rows carry their own place, so repeated ones are written as often as they come."""
    rows = shard_table(df, dims, ties, df.columns, shards, bits)
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").drop("curve", "slot").write.partitionBy("shard").parquet(path)


def op8_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", (F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32")
    )
    dims = {"lang": string_number(F.col("lang")), "source": string_number(F.col("source")), "size": size_number(F.col("size"))}
    out = shard_table(rows, dims, ["text_crc32", "size", "doc_id"], ["doc_id", "size", "text_crc32"], group=["text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")

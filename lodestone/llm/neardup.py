"""Near-duplicate groups by bottom-k sketches from one hash function (operator 10).

1. A text's shingles are hashed once; the set's smallest values are its sketch. Texts with equal sets form one class,
   represented by its smallest id, so copies cost nothing further on.
2. Inverted lists of retained values: over the smallest values (SKETCH of them, see least_overlap) of each class, a value's list is counted. Two
   similar sets share most retained values, so among the rarest of them, in one global order (list length, value), they
   share at least one: each class only enters the lists of its rarest values, as many as the least overlap asks for
   (prefix filtering). Values with a list of one need no list; classes that have enough of those are done.
3. A first round tests, in the first few lists of a class, the class against the list's most central member (whose values
   have the longest lists; in a group of near copies that is the original).
   Linked classes become components. The second round tests every pair of a list that is in different components:
   directly in short lists; in long ones in blocks, members outside the list's largest component against all members,
   each pair in the first list that it shares only, with wider sketches, and with one link for two components.
4. Every pair goes through the union-sketch estimate of Jaccard similarity, with a margin of MARGIN standard deviations,
   and is then confirmed on the full shingle sets. Components of confirmed links are the groups.

No pair that shares a prefix value is skipped other than within one component, so links between components are all found;
a similar pair escapes only if its sketches overlap far less than the sets do. Values of the union's sketch are shared with
a chance of the pair's similarity at least, so at any threshold the prefix loses a pair with a chance of at most MISS; the
margin of the estimate loses one at the threshold with a chance of 3.0e-5 at 0.85 and 1.4e-5 at 0.8. Blocks with many open
pairs test the overlaps of all wide sketches at once before that; this rests on WIDE values with the same margin and loses a
pair at the threshold with a chance of 1e-5 at most. Wide sketches only ever stand in for narrow ones in lists where many pairs are left.

Edge cases: null and word-less texts have no shingles, are linked with nothing and kept; fewer words than a shingle make
one shingle of the whole sequence; rows with the same id are one document, so that what any of its texts is linked with is linked
with all of them; rows with a null id are linked with nothing, have a null component and are not kept; an empty table gives an empty table; clashing column names are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .components import components
from .lm import map_array, write_array

SKETCH, WIDE = 64, 512
#: Chance that the prefix may lose a pair at the threshold. It decides how many shared values are relied on: 40 of 64 at 0.85, 35 at 0.8.
MISS = 2.5e-6
STAR_LISTS = 3
LONG_LIST, BLOCK, COLUMNS = 40, 2048, 4096
#: A filter of ids has 16 bits for each, and no more than this altogether; beyond that it lets more rows through to the exact join.
FILTER_BITS, FILTER_PARTS = 1 << 27, 16
#: Pairs of one hub that are confirmed together: its set is sent once for about so many.
MEMBERS = 64
MARGIN = 4.5
MULTIPLIER, SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)
MEMO_WORDS = 150_000


def hasher():
    """text -> sorted distinct 64-bit hashes of its shingles of n words; remembers words."""
    import xxhash

    class Memo(dict):
        def __missing__(self, word: bytes) -> int:
            h = self[word] = xxhash.xxh3_64_intdigest(word)
            return h

    memo = Memo()

    def hashes(text: str | None, n: int = 3) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        if len(memo) > MEMO_WORDS:
            memo.clear()
        h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        width = min(n, len(h))
        x = h[: len(h) - width + 1] + np.uint64(width)
        for k in range(1, width):
            x = (x ^ (x >> SHIFT)) * MULTIPLIER + h[k : len(h) - width + 1 + k]
        x = (x ^ (x >> np.uint64(32))) * MULTIPLIER
        return np.unique(x ^ (x >> SHIFT))

    return hashes


@lru_cache
def least_overlap(threshold: float) -> tuple[int, int]:
    """(indexed values of a set, how many of them two linked sets share but for a chance of MISS).

    The overlap is at least as large as a binomial number of the indexed values with the threshold as chance. SKETCH
    values are indexed, or for low thresholds as many as let linked sets share one.
    """
    if not 0.01 <= threshold <= 1:
        raise ValueError("the threshold must be in 1 to 100 percent")
    if threshold == 1:
        return SKETCH, SKETCH
    size = SKETCH
    while (1 - threshold) ** size > MISS:
        size *= 2
    least, below = 0, 0.0
    while least < size:
        below += math.exp(math.lgamma(size + 1) - math.lgamma(least + 1) - math.lgamma(size - least + 1) + least * math.log(threshold) + (size - least) * math.log(1 - threshold))
        if below > MISS:
            break
        least += 1
    return size, least


def sketches(df: DataFrame, text: str, key: str, words: int, most: int = SKETCH) -> DataFrame:
    """key, n (shingles), set (digest of the whole set), sketch (its smallest values, as binary) for each row."""

    def make():
        import xxhash

        hashes = hasher()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [hashes(t, words) for t in batch.column(text).to_pylist()]
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(key),
                    pa.array(map(len, sets), pa.int64()),
                    pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets], pa.string()),
                    pa.array([s[:most].tobytes() for s in sets], pa.binary()),
                ],
                ["id", "n", "set", "sketch"],
            )

        return work

    return common.map_slices(df.select(F.col(key).cast("long").alias(key), text), make, "id long, n long, set string, sketch binary", text)


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    """Four bit positions of each id."""
    x = ids.astype(np.int64).view(np.uint64)
    out = np.empty((len(x), 4), np.int64)
    for k in range(4):
        x = (x ^ (x >> SHIFT)) * MULTIPLIER + np.uint64(k + 1)
        out[:, k] = ((x ^ (x >> np.uint64(32))) & np.uint64(bits - 1)).astype(np.int64)
    return out


@dataclass(frozen=True)
class IdFilter:
    """A Bloom filter in the shared folder, cut into parts of `span` 64-bit words; parts without a bit have no file."""

    folder: str
    bits: int
    span: int
    parts: tuple[int, ...]

    def loaded(self) -> np.ndarray:
        out = np.zeros(self.bits // 64, np.int64)
        for p in self.parts:
            out[p * self.span : (p + 1) * self.span] = map_array(self.folder, str(p), "i8", self.span)
        return out


def id_filter(ids: DataFrame) -> IdFilter:
    """Write the filter of the ids. Its size is bounded, tasks send the words of it that they set, and each part is merged on its own."""
    n = ids.count()
    bits = 1 << max(10, min(FILTER_BITS.bit_length() - 1, (16 * n).bit_length()))
    span = bits // 64 // FILTER_PARTS
    folder = common.fresh_path(ids.sparkSession, "id-filter")

    def words(batches):
        for b in batches:
            at = np.unique(_places(b.column("id").to_numpy(), bits))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.int64(1), at & 63))], ["word", "bit"])

    def store(key: tuple, table: pa.Table) -> pa.Table:
        part, out = key[0].as_py(), np.zeros(span, np.int64)
        out[table.column("word").to_numpy() - part * span] = table.column("bits").to_numpy()
        write_array(folder, str(part), out)
        return pa.table({"part": pa.array([part])})

    merged = ids.select("id").mapInArrow(words, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    with common.cleaned(ids.sparkSession):
        found = merged.withColumn("part", F.expr(f"word div {span}")).groupBy("part").applyInArrow(store, "part long").collect()  # FILTER_PARTS rows at most
    return IdFilter(folder, bits, span, tuple(r["part"] for r in found))


def full_sets(df: DataFrame, ids: DataFrame, text: str, words: int, most: int | None = None) -> DataFrame:
    """Staged: id and the sorted set of shingle hashes, or the `most` smallest ones, as binary, of the rows with one of the ids.

    Texts are not shuffled: a filter of the ids in the shared folder picks rows where they are read, and an exact join
    drops what it lets through besides. An id with several texts has a row for each different set.
    """
    spark = df.sparkSession
    common.ship(spark)
    chosen = id_filter(ids)
    bits = chosen.bits

    def run(batches):
        kept, hashes = None, hasher()
        for batch in batches:
            kept = chosen.loaded() if kept is None else kept
            known = pc.fill_null(batch.column("id"), 0).to_numpy()
            at = _places(known, bits)
            good = pa.array(((kept[at >> 6] >> (at & 63)) & 1).all(axis=1))
            for piece in common.slices([batch.filter(good)], text):
                yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array([hashes(t, words)[:most].tobytes() for t in piece.column(text).to_pylist()], pa.binary())], ["id", "hashes"])
        del kept, hashes
        common.trim()

    found = df.where("id IS NOT NULL").select("id", text).mapInArrow(run, "id long, hashes binary").join(ids.select("id"), "id", "left_semi").dropDuplicates(["id", "hashes"])
    out = common.staged(found, "sets")
    common.remove_path(spark, chosen.folder)
    return out


def prefix_length(n: int, threshold: float) -> int:
    """How many of the rarest indexed values of a set of n must be listed."""
    indexed, least = least_overlap(threshold)
    if n < indexed * threshold:
        return n - math.ceil(threshold * n - 1e-9) + 1
    return max(indexed - least + 1, min(n, indexed) - math.ceil(threshold * min(n, indexed) - 1e-9) + 1)


def prefix_column(m: Column, threshold: float) -> Column:
    """prefix_length for sets of which m values are indexed, as a column."""
    return F.element_at(F.array(*[F.lit(prefix_length(k, threshold)) for k in range(1, least_overlap(threshold)[0] + 1)]), m)


def values(df: DataFrame, threshold: float) -> DataFrame:
    """(id, m, value) for each of the m smallest values of each sketch."""
    indexed = least_overlap(threshold)[0]

    def run(batches):
        for b in batches:
            own = [np.frombuffer(s, np.int64)[:indexed] for s in b.column("sketch").to_pylist()]
            if own:
                size = np.array([len(x) for x in own], np.int32)
                at = pa.array(np.repeat(np.arange(len(own)), size))
                yield pa.RecordBatch.from_arrays([b.column("id").take(at), pa.array(np.repeat(size, size)), pa.array(np.concatenate(own))], ["id", "m", "value"])

    return df.select("id", "sketch").mapInArrow(run, "id long, m int, value long")


def estimate(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> tuple[float, int]:
    """Jaccard similarity from two sketches, and how many values of the union it rests on (0: it is exact)."""
    both = np.concatenate([a, b])
    both.sort()
    twice = both[1:] == both[:-1]
    if n_a <= len(a) and n_b <= len(b):
        shared = int(twice.sum())
        return shared / (len(both) - shared), 0
    # Up to the smaller of the largest values of cut sketches, both are complete: that is the union's own sketch.
    limit = min([x[-1] for x, n in ((a, n_a), (b, n_b)) if n > len(x)])
    known = int(np.searchsorted(both, limit, side="right"))
    shared = int(twice[: known - 1].sum())
    return shared / (known - shared), known - shared


def may_link(value: float, rests_on: int, threshold: float) -> bool:
    slack = MARGIN * math.sqrt(threshold * (1 - threshold) / rests_on) if rests_on else 1e-12
    return value >= threshold - slack


def estimated(pairs: DataFrame, own: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that pass the union-sketch estimate."""
    a = own.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    b = own.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))

    def run(batches):
        for batch in batches:
            x = batch.to_pydict()
            good = [
                may_link(*estimate(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64), n, m), threshold)
                for s, t, n, m in zip(x["s_a"], x["s_b"], x["n_a"], x["n_b"], strict=True)
            ]
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    sized = pairs.join(b.select("b", "n_b"), "b").join(a, "a").where(F.least("n_a", "n_b") >= F.lit(threshold) * F.greatest("n_a", "n_b") - 1e-9)
    return sized.join(b.drop("n_b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a long, b long").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, text: str, words: int, percent: int) -> DataFrame:
    """Staged: the pairs (a, b), each given once, whose whole shingle sets have 100 * intersection >= percent * union.

    A pair is tested at its hub, the end with more pairs. A hub's pairs are dealt out in blocks of about MEMBERS; its set
    goes once to each block, just before the members' sets. So neither a task nor a batch grows with a hub's pairs.
    """
    ends = common.staged(pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("pairs")), "ends")
    sets = full_sets(texts, ends, text, words)
    of = lambda c: ends.select(F.col("id").alias(c), F.col("pairs").alias(f"_{c}"))
    first = (F.col("_a") > F.col("_b")) | ((F.col("_a") == F.col("_b")) & (F.col("a") > F.col("b")))
    hub, member = F.when(first, F.col("a")).otherwise(F.col("b")), F.when(first, F.col("b")).otherwise(F.col("a"))
    placed = pairs.join(of("a"), "a").join(of("b"), "b").select(hub.alias("hub"), member.alias("member"), F.ceil(F.greatest("_a", "_b") / MEMBERS).alias("_blocks"))
    placed = placed.select("hub", "member", F.pmod(F.xxhash64("member"), F.col("_blocks")).alias("block"))
    members = placed.join(sets.withColumnRenamed("id", "member"), "member").select("hub", "block", "member", "hashes")
    hubs = placed.select("hub", "block").distinct().join(sets.withColumnRenamed("id", "hub"), "hub").select("hub", "block", F.lit(None).cast("long").alias("member"), "hashes")

    def linked(x: np.ndarray, y: np.ndarray) -> bool:
        less, more = (x, y) if len(x) < len(y) else (y, x)
        shared = int((more[np.minimum(np.searchsorted(more, less), len(more) - 1)] == less).sum())
        return 100 * shared >= percent * (len(x) + len(y) - shared)

    def run(batches):
        block, own = None, {}  # the sets of the block's hub, which come before its members (several if its id has several texts)
        for batch in common.slices(batches, "hashes"):
            found = []
            for h, b, m, s in zip(*(batch.column(c).to_pylist() for c in ("hub", "block", "member", "hashes")), strict=True):
                x = np.frombuffer(s, np.uint64)
                if block != (h, b):
                    block, own = (h, b), {}
                if m is None:
                    own[s] = x
                elif any(linked(x, y) for y in own.values()):
                    found.append((min(h, m), max(h, m)))
            found = sorted(set(found))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    rows = hubs.union(members).repartition("hub", "block").sortWithinPartitions("hub", "block", F.asc_nulls_first("member"))
    return common.staged(rows.mapInArrow(run, "a long, b long"), "confirmed", done=(ends, sets))


def in_blocks(lists: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) in different components of long lists that pass the estimate on wide sketches.

    lists: value, id, component, n, hashes (wide sketch), prefix (listed values in global order), size (of the list),
    largest (its largest component). Members outside the largest component are held against all members, block against
    block; no task sees more than two blocks. A pair counts in the first list that it shares only. Pairs whose sketches
    are whole sets are known to be linked, so one of them is enough for two components.
    """
    count = F.ceil(F.col("size") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("id"), count).cast("int")
    targets = lists.select("*", F.explode(F.sequence(F.lit(0), count - 1)).alias("q"), block.alias("t"), F.lit(False).alias("asks"))
    queries = lists.where(F.col("component") != F.col("largest")).select("*", block.alias("q"), F.explode(F.sequence(F.lit(0), count - 1)).alias("t"), F.lit(True).alias("asks"))

    def overlaps(rows: list[np.ndarray], query: np.ndarray, target: np.ndarray) -> np.ndarray:
        """How many values each query shares with each target; dense for COLUMNS values at a time."""
        flat = np.concatenate(rows)
        _, column = np.unique(flat, return_inverse=True)
        used = np.bincount(column, minlength=1) > 1
        number, pick = np.cumsum(used) - 1, used[column]
        row, column = np.repeat(np.arange(len(rows)), [len(r) for r in rows])[pick], number[column[pick]]
        out = np.zeros((len(query), len(target)), np.float32)
        for start in range(0, int(used.sum()), COLUMNS):
            own = (column >= start) & (column < start + COLUMNS)
            wide = np.zeros((len(rows), COLUMNS), np.float32)
            wide[row[own], column[own] - start] = 1
            out += wide[query] @ wide[target].T
        return out

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        value = key[0].as_py()
        asks = table.column("asks").to_numpy()
        query, target = np.flatnonzero(asks), np.flatnonzero(~asks)
        out = []
        if len(query) and len(target):
            ids, comp, n = (table.column(c).to_numpy() for c in ("id", "component", "n"))
            largest = table.column("largest")[0].as_py()
            qi, ti = query[:, None], target[None, :]
            open_ = (comp[qi] != comp[ti]) & (np.minimum(n[qi], n[ti]) >= threshold * np.maximum(n[qi], n[ti]) - 1e-9)
            open_ &= (comp[ti] == largest) | (ids[qi] < ids[ti])  # where both ask, once is enough
            if open_.any():
                before = [np.array(p[: p.index(value)], np.int64) for p in table.column("prefix").to_pylist()]
                open_ &= overlaps(before, query, target) == 0
            if open_.any():
                kept = [np.frombuffer(s, np.uint64) for s in table.column("hashes").to_pylist()]
                if open_.sum() > 2000:
                    # Overlaps of all sketches at once; a linked pair shares about this part of the smaller one at least.
                    least = threshold * np.minimum(np.minimum(n[qi], n[ti]), WIDE) - np.where(np.maximum(n[qi], n[ti]) > WIDE, MARGIN * math.sqrt(WIDE * threshold * (1 - threshold)) + 1, 1e-6)
                    open_ &= overlaps(kept, query, target) >= least
                done = set()
                for i, j in np.argwhere(open_):
                    p, q = query[i], target[j]
                    two = (comp[p], comp[q])
                    if two not in done:
                        likeness, rests_on = estimate(kept[p], kept[q], n[p], n[q])
                        if may_link(likeness, rests_on, threshold):
                            out.append((min(ids[p], ids[q]), max(ids[p], ids[q])))
                            if not rests_on:
                                done.add(two)
        return pa.table({"a": pa.array([int(o[0]) for o in out], pa.int64()), "b": pa.array([int(o[1]) for o in out], pa.int64())})

    both = targets.unionByName(queries).select("value", "q", "t", "id", "component", "n", "hashes", "prefix", "asks", "largest")
    return both.groupBy("value", "q", "t").applyInArrow(compare, "a long, b long")


def groups(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = 3, percent: int = 85) -> DataFrame:
    """(id, n_shingles, component_id) for each row."""
    spark, threshold = df.sparkSession, percent / 100
    indexed = least_overlap(threshold)[0]
    common.ship(spark)
    texts = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    rows = common.staged(sketches(texts, "text", "id", words, indexed), "sketches")
    linked = rows.where("n > 0 AND id IS NOT NULL")
    classes = linked.groupBy("set").agg(F.min("id").alias("rep"))
    own = common.staged(linked.join(classes.select("set", F.col("rep").alias("id")), ["set", "id"], "left_semi").dropDuplicates(["set"]).select("id", "n", "sketch"), "classes")
    prefix = common.staged(rarest(values(own, threshold), threshold), "prefix")
    # First round: a class against the members that its first lists pick.
    picks = prefix.groupBy("value").agg(
        F.max_by("id", F.struct("_central", F.xxhash64("id"))).alias("pick"), F.count("*").alias("size")
    ).where("size > 1")
    picks = common.staged(picks, "picks")
    near = prefix.where(F.col("_nth") <= STAR_LISTS).join(picks, "value")
    star = near.where("id <> pick").select(F.least("id", "pick").alias("a"), F.greatest("id", "pick").alias("b")).distinct()
    star = common.staged(estimated(star, own, threshold), "estimated")
    first = confirmed(star, texts, "text", words, percent)
    found = components(first)
    # Second round: pairs of a list in different components.
    member = prefix.join(picks.select("value", "size"), "value").join(found.withColumnRenamed("node", "id"), "id", "left").select("value", "id", "size", F.coalesce("component", "id").alias("component"))
    parts = member.groupBy("value", "component").agg(F.count("*").alias("_n")).groupBy("value").agg(F.count("*").alias("_parts"), F.max_by("component", F.struct("_n", "component")).alias("largest"))
    open_lists = common.staged(member.join(parts.where("_parts > 1").select("value", "largest"), "value"), "lists", done=(star, picks, found))
    short = open_lists.where(F.col("size") <= LONG_LIST).select("value", "id", "component")
    other = short.select("value", F.col("id").alias("id2"), F.col("component").alias("component2"))
    pairs = short.join(other, "value").where("id < id2 AND component <> component2").select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct()
    pairs = estimated(pairs, own, threshold)
    long = open_lists.where(F.col("size") > LONG_LIST)
    ids = common.staged(long.select("id").distinct(), "nodes")
    sets = full_sets(texts, ids, "text", words, WIDE)
    order = prefix.join(ids, "id", "left_semi").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_nth", "value"))), lambda x: x["value"]).alias("prefix"))
    wide = common.staged(sets.join(own.select("id", "n"), "id").join(order, "id"), "wide", done=(sets, ids))
    pairs = common.staged(pairs.union(in_blocks(long.join(wide, "id"), threshold)).distinct(), "estimated", done=(wide, open_lists))
    second = confirmed(pairs, texts, "text", words, percent)
    # An id with different texts links their classes: the id itself is a node beside their representatives.
    mixed = rows.where("id IS NOT NULL").groupBy("id").agg(F.min("set").alias("_a"), F.max("set").alias("_b")).where("_a <> _b").select("id")
    own_classes = linked.join(mixed, "id", "left_semi").select("id", "set").distinct().join(classes, "set").where("id <> rep")
    final = components(first.union(second).union(own_classes.select(F.least("id", "rep"), F.greatest("id", "rep"))))
    common.drop(pairs, own, prefix, first, second)
    node = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("rep"))
    named = rows.join(classes, "set", "left").withColumn("node", node).join(final, "node", "left")
    smallest = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "node"))
    return named.select("id", F.col("n").alias("n_shingles"), smallest.cast("long").alias("component_id"))


def rarest(listed: DataFrame, threshold: float) -> DataFrame:
    """(value, id, _nth, _central): the prefix of each set, those of its rarest values that more than one set has.

    Values with a list of one come first in the global order: they use up the prefix without needing a list.
    """
    several = listed.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    own = W.partitionBy("id", "m")
    ranked = listed.join(several, "value").select(
        "value", "id", "m", F.row_number().over(own.orderBy("df", "value")).alias("_nth"), F.count("*").over(own).alias("_held"), F.sum(F.log("df")).over(own).alias("_central")
    )
    return ranked.where(F.col("_nth") + F.col("m") - F.col("_held") <= prefix_column(F.col("m"), threshold)).select("value", "id", "_nth", F.col("_central").cast("float").alias("_central"))


def deduplicate(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of the frame whose id is the smallest of their group, one row of each such id, and rows with a null id.

    Of rows with the same id, the one with the smallest hash of its text stays, among those the first by all columns. Rows are
    only told apart by what they hold, never by places or partitions, which may differ when a lost executor's part is read again.
    """
    id_ = common.free("_lodestone_id", df.columns)
    of_id = groups(df, text, key, words, percent).where("id IS NOT NULL").groupBy(F.col("id").alias(id_)).agg(F.min("component_id").alias("_least"), F.count("*").alias("_rows"))
    kept = common.staged(of_id.where(F.col(id_) == F.col("_least")).select(id_, "_rows"), "kept")
    named = df.withColumn(id_, F.col(key).cast("long"))
    once = named.join(kept.where("_rows = 1"), id_, "left_semi")
    several = named.join(kept.where("_rows > 1"), id_, "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    order = F.struct(F.xxhash64(text), F.to_json(whole, {"ignoreNullFields": "false"}))  # JSON orders columns of any type
    picked = several.groupBy(id_).agg(F.min_by(whole, order).alias("_row")).select("_row.*")
    return once.drop(id_).union(picked).union(df.where(F.col(key).cast("long").isNull()))


def op10_bottom_k_dedup(spark, sf_dir: str) -> DataFrame:
    found = groups(common.documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))

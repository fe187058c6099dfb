"""Removal of lines that many documents share, by filters of once-seen and twice-seen hashes (operator 12).

1. Every task puts the hashes of its documents' lines into two Bloom filters: what the first one knows already goes into the
   second. Tasks send the filters' parts; a part is merged by taking what both sides have seen once for seen twice. So the second filter has
   every line that two documents hold, wherever they are.
2. Only lines that the second filter knows (suspected repeats) are shuffled, as digests, and counted exactly by document;
   where asked for, the first occurrence is chosen.
3. Which lines a text loses is joined to the documents by the digest of the text: copies of a text share one list. Texts
   and keys that many rows have are salted.

Both filters have FILTER_BITS bits at most (128 MB each), whatever the table's size. Beyond about 2^28 lines they let more lines through to the exact
count; results don't change. The filter's builders are as many as the cluster runs at once, so what they send grows
with the cluster, not with the number of input splits.

Edge cases: null and empty texts are one empty line; lines without a key (blank ones) always stay; rows with the same id,
null included, are one document in the count and each gives a row; equal rows are cut equally; an empty table gives an empty table; other columns are not looked at.
A single line of any length is one key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .lm import map_array, write_array

WHITE = b" \t\n\x0b\x0c\r"
FILTER_BITS, BITS_A_LINE = 1 << 30, 16
PART_WORDS = 1 << 13
KEY_BYTES = 16


def keys_of(text: str | None, least_chars: int = 1) -> list[bytes | None]:
    """The digest of each line's key; None where the key has fewer code points than asked for."""
    import xxhash

    out = []
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        key = line.strip(WHITE).lower()
        long_enough = len(key) >= least_chars and (least_chars <= 1 or len(key.decode("utf-8", "surrogatepass")) >= least_chars)
        out.append(xxhash.xxh3_128_digest(key) if long_enough else None)
    return out


def _places(digests: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Word and mask of four bits for each digest's first eight bytes."""
    at = (digests >> np.uint64(24)) & np.uint64(words - 1)
    mask = np.zeros(len(digests), np.uint64)
    for k in (0, 6, 12, 18):
        mask |= np.uint64(1) << ((digests >> np.uint64(k)) & np.uint64(63))
    return at.astype(np.int64), mask


def _hashes(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, KEY_BYTES // 8)[:, 0]


class Seen:
    """A filter of what was seen once, and one of what was seen twice."""

    def __init__(self, words: int):
        self.once, self.twice = np.zeros(words, np.uint64), np.zeros(words, np.uint64)

    def add(self, hashes: np.ndarray) -> None:
        """Hashes of several documents, each once for a document."""
        distinct, counts = np.unique(hashes, return_counts=True)
        at, mask = _places(distinct, len(self.once))
        again = (counts > 1) | ((self.once[at] & mask) == mask)
        np.bitwise_or.at(self.twice, at[again], mask[again])
        np.bitwise_or.at(self.once, at, mask)


@dataclass(frozen=True)
class TwiceSeen:
    """The merged second filter in the shared folder; parts without a bit have no file."""

    folder: str
    words: int
    span: int
    parts: tuple[int, ...]

    def loaded(self) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for p in self.parts:
            out[p * self.span : (p + 1) * self.span] = map_array(self.folder, str(p), "u8", self.span)
        return out


def twice_seen(df: DataFrame, text: str, least_chars: int) -> TwiceSeen:
    """Both filters over all rows, built by as many tasks as run at once, merged part by part."""
    spark = df.sparkSession
    lines = df.select(F.sum(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"))) + 1)).first()[0] or 1
    words = 1 << max(7, min(FILTER_BITS.bit_length() - 7, (BITS_A_LINE * lines // 64).bit_length()))
    span = min(PART_WORDS, words)
    folder = common.fresh_path(spark, "twice-seen")

    def build(batches: Iterator[pa.RecordBatch]):
        seen = Seen(words)
        for piece in common.slices(batches, text):
            own = [d for t in piece.column(text).to_pylist() for d in set(keys_of(t, least_chars)) if d]
            if own:
                seen.add(_hashes(own))
        for p in range(words // span):
            once, twice = (x[p * span : (p + 1) * span] for x in (seen.once, seen.twice))
            if once.any():
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([once.tobytes()]), pa.array([twice.tobytes()])], ["part", "once", "twice"])
        del seen
        common.trim()

    def merge(batches: Iterator[pa.RecordBatch]):
        merged: dict[int, Seen] = {}
        for batch in batches:
            for p, once, twice in zip(*(batch.column(c).to_pylist() for c in ("part", "once", "twice")), strict=True):
                known = merged.setdefault(p, Seen(span))
                once, twice = np.frombuffer(once, np.uint64), np.frombuffer(twice, np.uint64)
                known.twice |= twice | (known.once & once)
                known.once |= once
        full = [p for p, known in merged.items() if known.twice.any()]
        for p in full:
            write_array(folder, str(p), merged[p].twice)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32())], ["part"])

    built = df.select(text).coalesce(max(spark.sparkContext.defaultParallelism, 2)).mapInArrow(build, "part int, once binary, twice binary")
    with common.cleaned(spark):
        found = built.repartition("part").mapInArrow(merge, "part int").collect()  # FILTER_BITS / 64 / PART_WORDS rows at most
    return TwiceSeen(folder, words, span, tuple(sorted(r["part"] for r in found)))


def suspects(df: DataFrame, key: str, text: str, least_chars: int) -> DataFrame:
    """Staged: (id, text, key, lines) for each row and each of its keys that the twice-seen filter knows; text and key are digests."""
    spark = df.sparkSession
    common.ship(spark)
    chosen = twice_seen(df, text, least_chars)

    def run(batches: Iterator[pa.RecordBatch]):
        known = None
        for piece in common.slices(batches, text):
            known = chosen.loaded() if known is None else known
            ids, texts = piece.column(key).to_pylist(), piece.column(text).to_pylist()
            digests = [keys_of(t, least_chars) for t in texts]
            flat = [(row, n, d) for row, own in enumerate(digests) for n, d in enumerate(own) if d]
            found: dict[tuple, list[int]] = {}
            if flat:
                at, mask = _places(_hashes([d for _, _, d in flat]), chosen.words)
                for k in np.flatnonzero((known[at] & mask) == mask).tolist():
                    row, n, d = flat[k]
                    found.setdefault((row, d), []).append(n)
            whole = {row: hashlib.md5(texts[row].encode("utf-8", "surrogatepass")).hexdigest() for row in {row for row, _ in found}}
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[row] for row, _ in found], pa.int64()), pa.array([whole[row] for row, _ in found], pa.string()),
                    pa.array([d for _, d in found], pa.binary()), pa.array(list(found.values()), pa.list_(pa.int32())),
                ],
                ["id", "text", "key", "lines"],
            )
        del known
        common.trim()

    read = df.select(F.col(key).cast("long").alias(key), text)
    out = common.staged(read.mapInArrow(run, "id long, text string, key binary, lines array<int>"), "suspects")
    common.remove_path(spark, chosen.folder)
    return out


def cut_lines(df: DataFrame, key: str = "doc_id", text: str = "text", documents: int = 10, least_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(id, text, n_lines, n_dropped) for each row: its text without the lines whose keys `documents` documents or more hold.

    A line's key is the line without white space at its ends, A-Z in lower case, of least_chars code points at least. With
    keep_first the first line of the document with the smallest id keeps its place.
    """
    if documents < 2:
        raise ValueError("lines repeat from two documents on")
    suspected = suspects(df, key, text, least_chars)
    counted = suspected.groupBy("key").agg((F.count_distinct("id") + F.max(F.col("id").isNull().cast("long"))).alias("documents"))
    sizes = suspected.groupBy("key").agg(F.count("*").alias("rows"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.element_at("lines", 1).alias("line"))).alias("first"))
    often = common.staged(counted.where(F.col("documents") >= documents).join(sizes, "key"), "often")
    hits = common.spread_join(suspected, often, "key", "rows", suspected.count(), "text")
    own = ["text", "id"] if keep_first else ["text"]
    lines = F.filter("lines", lambda n: ~(F.col("first.id").eqNullSafe(F.col("id")) & (n == F.col("first.line")))) if keep_first else F.col("lines")
    once = hits.select(*own, "key", lines.alias("lines")).groupBy(*own, "key").agg(F.first("lines").alias("lines"), F.count("*").alias("rows"))
    lists = once.groupBy(*own).agg(F.flatten(F.collect_list("lines")).alias("dropped"), F.max("rows").alias("rows"))
    if keep_first:
        lists = lists.select(F.concat_ws(":", "text", F.coalesce(F.col("id").cast("string"), F.lit("-"))).alias("own"), "dropped", "rows")
    lists = common.staged(lists.withColumnRenamed("text", "own"), "lists", done=(suspected, often))

    rows = df.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    digest = F.md5(F.col("text").cast("binary"))
    rows = rows.withColumn("own", F.concat_ws(":", digest, F.coalesce(F.col("id").cast("string"), F.lit("-"))) if keep_first else digest)
    marked = common.spread_join(rows, lists, "own", "rows", rows.count(), "id", how="left").select("id", "text", "dropped")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, counts, dropped = [], [], []
            for t, gone in zip(batch.column("text").to_pylist(), batch.column("dropped").to_pylist(), strict=True):
                counts.append(t.count("\n") + 1)
                dropped.append(len(gone or ()))
                if gone:
                    gone = set(gone)
                    t = "\n".join(line for n, line in enumerate(t.split("\n")) if n not in gone)
                texts.append(t)
            return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], ["id", "text", "n_lines", "n_dropped"])

        return work

    return common.map_slices(marked, make, "id long, text string, n_lines long, n_dropped long")


def op12_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = cut_lines(common.documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def oracle() -> str:
    return """
    WITH parts AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
    lines AS (SELECT r, doc_id, unnest(range(len(parts))) AS n, unnest(parts) AS line FROM parts),
    keyed AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
    often AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::BIGINT) >= 10)
    SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(o.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE o.key IS NULL), '')) AS kept_sha256
    FROM keyed k LEFT JOIN often o ON o.key = k.key GROUP BY r
    """

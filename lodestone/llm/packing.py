"""Best-fit packing of token sequences (operator 5).

1. Each text becomes token ids plus a closing id; longer sequences are cut into pieces of the capacity. A piece gets its
   number among the pieces of its length within its task, so no shuffle is needed to rank the pieces of a length.
   The table of pieces (no ids) is written to the shared folder, which fixes these numbers.
2. The histogram of lengths, at most `capacity` rows, goes to the driver. Best-fit, longest first, runs over counts: all
   pieces of one length enter all sequences with one free space in one step. Its plan is a list of runs (length, ranks,
   sequences, offset) whose size depends on the capacity and not on the number of documents.
3. Rank within length = number within the task + pieces of that length in earlier tasks (a window over one row for each
   task and length). Each piece then takes the planned slot of its rank.

Edge cases: a null text counts as empty and is the closing id alone; texts of any length are cut, never dropped; repeated
rows and doc_ids are packed as often as they come; an empty table gives an empty table; no other columns are looked at.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
MEMO_WORDS = 400_000
#: For texts of these characters the tokenizer's normal form is the lower-case text, and white space separates words.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-įı-ž]*")


#: The matches of the tokenizer's split in such texts, lower-cased.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^\s0-9a-zß-öø-ž]+")


def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class Words:
    """Ids by the library, remembered for blank-separated words and for the matches in them.

    The tokenizer never looks across white space, and normalising leaves PLAIN lower-case words as they are; so for these
    the library's model is asked for each new match alone. Any other text goes through the whole library in one piece.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        tokenize, letters, find = self.library.model.tokenize, byte_letters(), SPLIT.findall

        class Memo(dict):
            """Forgets everything when full; long keys are not kept."""

            def keep(self, key: str, value: bytes) -> bytes:
                if len(key) <= 48:
                    if len(self) >= MEMO_WORDS:
                        self.clear()
                    self[key] = value
                return value

        class Matches(Memo):
            def __missing__(self, match: str) -> bytes:
                text = match if match.isascii() else match.encode().decode("latin-1").translate(letters)
                return self.keep(match, array("I", [t.id for t in tokenize(text)]).tobytes())

        class Whole(Memo):
            def __missing__(self, word: str) -> bytes:
                return self.keep(word, b"".join(map(matches, find(word))))

        matches = Matches().__getitem__
        self.words = Whole()

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """The unsigned 32-bit ids of each text."""
        plain, get = PLAIN.fullmatch, self.words.__getitem__
        for text in texts:
            if plain(text):
                yield b"".join(map(get, text.lower().split()))
            else:
                yield array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()


_loaded: dict[str, Words] = {}


def tokenizer(path: str | None) -> Words:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _loaded:
        _loaded[path] = Words(path)
    return _loaded[path]


def pieces(df: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, capacity: int = CAPACITY, closing: int = 0) -> DataFrame:
    """Rows of key, piece, start, length, ids_crc32, and of task (_part) and number among its pieces of that length (_nth)."""
    kind = dict(df.dtypes)[key]
    schema = f"`{key}` {kind}, piece int, start long, length int, ids_crc32 long, _part int, _nth long"

    def make():
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        own, end = tokenizer(path), np.array([closing], "<u4").tobytes()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, rows = [], []
            for i, ids in enumerate(own.ids([t or "" for t in batch.column(text).to_pylist()])):
                ids += end
                for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                    body = ids[start : start + 4 * capacity]
                    n = len(body) // 4
                    at.append(i)
                    rows.append((k, start // 4, n, zlib.crc32(body), part, seen[n]))
                    seen[n] += 1
            columns = zip(*rows, strict=True)
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                [key, "piece", "start", "length", "ids_crc32", "_part", "_nth"],
            )

        return work

    return common.map_slices(df.select(key, text), make, schema, text)


@dataclass(frozen=True)
class Plan:
    """Runs in the order of (length, rank): the pieces of `length` with ranks from `rank` on go to sequences from `sequence` on, at `offset`."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def slots(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.searchsorted(self.length, np.arange(int(self.length.max(initial=0)) + 2))
        run = np.empty(len(length), np.int64)
        for n in np.unique(length):
            own = length == n
            a, b = first[n], first[n + 1]
            run[own] = a + np.searchsorted(self.rank[a:b], rank[own], side="right") - 1
        return self.sequence[run] + rank - self.rank[run], self.offset[run]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Best-fit over a histogram of lengths, longest first."""
    free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by free space: ranges (first sequence, number)
    some = 0  # bit r: free[r] has sequences
    runs: list[tuple[int, int, int, int]] = []
    total = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            fitting = some >> length
            if fitting:
                space = length + (fitting & -fitting).bit_length() - 1
                first, number = free[space].pop()
                if not free[space]:
                    some &= ~(1 << space)
            else:
                space = capacity
                first, number = total, -(-left // (capacity // length))
                total += number
            each = space // length
            full = min(number, left // each)
            for group, held in ((full, each), (1 if full < number and left - full * each else 0, left - full * each)):
                if not group:
                    continue
                held = min(held, each)
                for k in range(held):
                    runs.append((length, rank, first, capacity - space + k * length))
                    rank += group
                left -= group * held
                rest = space - held * length
                if rest:
                    free[rest].append((first, group))
                    some |= 1 << rest
                first, number = first + group, number - group
            if number:
                free[space].append((first, number))
                some |= 1 << space
    runs.sort()
    columns = np.array(runs, np.int64).reshape(-1, 4).T
    return Plan(*columns, total)


def pack(df: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    rows = common.staged(pieces(df, text, key, path, capacity), "pieces")
    tasks = rows.groupBy("length", "_part").agg(F.count("*").alias("_rows"))
    counts = {r["length"]: r["n"] for r in tasks.groupBy("length").agg(F.sum("_rows").alias("n")).collect()}  # `capacity` rows at most
    own = plan(counts, capacity)
    earlier = W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = tasks.select("length", "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    ranked = rows.join(before, ["length", "_part"]).select(key, "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", (F.col("_before") + F.col("_nth")).alias("_rank"))
    kind = dict(df.dtypes)[key]
    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = own.slots(b.column("length").to_numpy(), b.column("_rank").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in (key, "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)],
                [key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(take, schema)


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return pack(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))

"""Interpolated modified Kneser-Ney language model (operator 3), stored as sorted hash arrays that workers map into memory.

Tokens are words (A-Z lower-cased) and an end of text. Training takes one shuffle more than the order:

1. words: counts by 64-bit hash. Each part is a range of hashes and becomes a sorted array; a word's id is its place in
   all parts. The number of tokens N and of different tokens V are sums over the parts.
2. n-grams of the model's order as tuples of ids (a text begins after a virtual start, before which is padding). Tasks count
   what they have read and send sorted, compressed blocks, one for each part. An n-gram's part follows from a hash of its
   context, so that a part sees whole contexts and stores their statistics (the total and how many followers occur once,
   twice, or more) beside the counts. Contexts that may be too frequent for a part, as the rarest of their words bounds
   them, are salted by the last word, and their statistics are sums of what parts report.
   Each part also reports, for the n-grams one word shorter, the number of different words before them.
3. each lower order down to pairs, from what the order above reports: its counts are the numbers of different words before
   (occurrences for n-grams at a text's start, which nothing precedes: padded n-grams carry them down); it reports in turn
   to the order below.
4. statistics of single ids from what pairs report, written as dense arrays by id.

Counts are held in 64 bits. N-grams are counted as exact tuples; a stored array tells them apart by 56 bits of a hash
within a part of some PART_ROWS (an unseen n-gram is taken for another with a chance of 1e-11). The files of the arrays are
in the shared folder and are moved into place when complete, so a task that runs again replaces them with equal ones.
Scoring maps the parts that it needs (a store without local paths is copied to an unlinked local file first) and looks up
the distinct n-grams of a slice of texts. Any order from two on can be asked for.

Edge cases: a null text counts as empty and is its end token; with an empty training set every token has probability
1 / (V + 1) = 1; unknown words get the share that discounting leaves for them; texts of any length are read whole;
repeated rows count and score as often as they come; an empty table gives an empty table; further columns are not looked at.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: N-grams that one part may gather on average.
PART_ROWS = 1_600_000
#: Tokens that a task gathers before it counts and emits them.
GATHERED = 2_500_000
#: Bytes of text that are scored at once.
SCORED_BYTES = 8 << 20
#: Distinct words that a task holds before it emits their counts.
HELD_WORDS = 1_000_000
M1, M2, S = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(31)
U32 = np.uint64(32)
#: Words of up to so many bytes are hashed together.
WHOLE_BYTES = 32
SEED = np.uint64(0x9E3779B97F4A7C15)
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
WHITE = np.isin(np.arange(256), [*range(9, 14), 32])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose values look random."""
    x = (x ^ (x >> S)) * M1
    x = (x ^ (x >> S)) * M2
    return x ^ (x >> S)


#: The end of a text, as a word without bytes.
END = mixed(np.array([SEED]))[0]

def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Which of equal ranges of 64-bit numbers each one is in."""
    return (((h >> U32) * np.uint64(parts)) >> U32).astype(np.int32)


def hashed(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of packed n-grams; a bijection where they take one number."""
    h = mixed(columns[0])
    for c in columns[1:]:
        h = mixed(h ^ c)
    return h


@dataclass(frozen=True)
class Packing:
    """N-grams of ids as 64-bit numbers that sort like the tuples: as many ids to a number as fit, the first number may hold fewer."""

    n_words: int

    @property
    def start(self) -> int:
        return self.n_words

    @property
    def pad(self) -> int:
        return self.n_words + 1

    @property
    def bits(self) -> int:
        return max(1, self.pad.bit_length())

    def width(self, k: int) -> int:
        return -(-k // (64 // self.bits))

    def pack(self, w: list[np.ndarray]) -> list[np.ndarray]:
        per, out = 64 // self.bits, []
        for end in reversed(range(len(w), 0, -per)):
            first, *rest = w[max(0, end - per) : end]
            x = first.astype(np.uint64)
            for y in rest:
                x = x << np.uint64(self.bits) | y.astype(np.uint64)
            out.append(x)
        return out

    def unpack(self, columns: list[np.ndarray], k: int) -> list[np.ndarray]:
        per, mask, out = 64 // self.bits, np.uint64((1 << self.bits) - 1), []
        for x in reversed(columns):
            for _ in range(min(per, k - len(out))):
                out.append((x & mask).astype(np.int64))
                x = x >> np.uint64(self.bits)
        return out[::-1]


def before(x: np.ndarray, lengths: np.ndarray, m: int, start: int, pad: int) -> np.ndarray:
    """What stands m places before each token; a text begins after `start`, before which is `pad`."""
    out = np.full(len(x), pad, np.int64)
    out[m:] = x[: max(0, len(x) - m)]
    place = np.arange(len(x)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[place < m] = pad
    out[place == m - 1] = start
    return out


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct numbers, a place of each, for each place the number's index)."""
    order = np.argsort(h)
    ranked = h[order]
    new = np.ones(len(h), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    at = np.empty(len(h), np.int64)
    at[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    return ranked[starts], order[starts], at


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens of the texts one after another, number of tokens of each).

    Words are hashed together, eight bytes of each at a time; those of more than WHOLE_BYTES one by one.
    """
    import xxhash

    encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    if not encoded:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    raw = b"\n".join([*encoded, bytes(8)]).lower()
    stops = np.cumsum([len(e) + 1 for e in encoded]) - 1
    inside = np.zeros(stops[-1] + 2, np.int8)
    inside[1:] = ~WHITE[np.frombuffer(raw, np.uint8, stops[-1] + 1)]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    eights = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    h = mixed(sizes.astype(np.uint64) + SEED)
    at = np.flatnonzero(sizes <= WHOLE_BYTES)
    for done in range(0, WHOLE_BYTES, 8):
        at = at[sizes[at] > done] if done else at
        h[at] = mixed(h[at] ^ (eights[starts[at] + done] & LOW_BYTES[np.minimum(sizes[at] - done, 8)]))
    for i in np.flatnonzero(sizes > WHOLE_BYTES).tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : starts[i] + sizes[i]])
    words = np.searchsorted(starts, stops)
    ends = words + np.arange(len(stops))
    out = np.empty(len(h) + len(stops), np.uint64)
    is_word = np.ones(len(out), bool)
    is_word[ends] = False
    out[ends], out[is_word] = END, h
    return out, np.diff(ends, prepend=-1)


def _filesystem(path: str):
    from pyarrow import fs

    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def write_array(folder: str, name: str, *arrays: np.ndarray) -> None:
    """Write arrays' bytes one after another into a file of the shared folder, complete or not at all."""
    files, base = _filesystem(folder)
    files.create_dir(base, recursive=True)
    draft = f"{base}/.{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(draft) as out:
        for x in arrays:
            out.write(memoryview(np.ascontiguousarray(x)).cast("B") if x.size else b"")
    files.move(draft, f"{base}/{name}")


def map_array(folder: str, name: str, dtype: str = "u1", rows: int | None = None) -> np.ndarray:
    """The file as an array, mapped; only the pages that are looked at are read."""
    from pyarrow import fs

    files, base = _filesystem(folder)
    path = f"{base}/{name}"
    shape = None if rows is None else (rows,)
    if isinstance(files, fs.LocalFileSystem):
        return np.asarray(np.memmap(path, dtype, "r", shape=shape))
    with files.open_input_stream(path) as source, tempfile.NamedTemporaryFile(delete=False) as out:
        while block := source.read(1 << 22):
            out.write(block)
    try:
        return np.asarray(np.memmap(out.name, dtype, "r", shape=shape))
    finally:
        os.unlink(out.name)


# ---- blocks of sorted numbers between tasks ----


def block_of(arrays: list[np.ndarray]) -> bytes:
    """Equally long arrays of 64-bit numbers, byte by byte of all numbers, compressed: what neighbours share takes no room."""
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T) for x in arrays]
    return pa.compress(b"".join(p.tobytes() for p in planes), codec="zstd", asbytes=True)


def arrays_of(table: pa.Table, count: int) -> list[np.ndarray]:
    """The arrays of all blocks of a table, one after another."""
    found = []
    for n, b in zip(table.column("rows").to_pylist(), table.column("block").to_pylist(), strict=True):
        raw = np.frombuffer(pa.decompress(b, decompressed_size=8 * n * count, codec="zstd", asbytes=True), np.uint8)
        found.append(np.ascontiguousarray(raw.reshape(count, 8, n).transpose(0, 2, 1)).view(np.uint64)[:, :, 0])
    return list(np.concatenate(found, axis=1)) if found else [np.empty(0, np.uint64)] * count


def dealt(arrays: list[np.ndarray], part: np.ndarray) -> pa.RecordBatch:
    """One row (part, rows, block) for each part that has some of the sorted numbers."""
    order = np.argsort(part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part, kind="stable")
    part = part[order]
    edges = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
    own = [order[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    columns = [pa.array(part[edges[:-1]], pa.int32()), pa.array(np.diff(edges), pa.int32()), pa.array([block_of([np.ascontiguousarray(x[o]).astype(np.uint64) for x in arrays]) for o in own], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["part", "rows", "block"])


BLOCKS = "part int, rows int, block binary"


def _sorted(columns: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct keys in order and their summed values."""
    if not len(columns[0]):
        return columns, values
    order = np.argsort(columns[0]) if len(columns) == 1 else np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.zeros(len(order), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(new)
    return [c[starts] for c in columns], [np.add.reduceat(v[order], starts) for v in values]


# ---- stored tables ----

DIRECTORY = 16  # bits of a hash that choose a bucket; 40 more are stored


def store_table(folder: str, part: int, h: np.ndarray, values: list[np.ndarray]) -> None:
    """One file: hashes in order, and for each one a code of its row of values.

    Different rows of values are few; the 255 most frequent ones have codes of one byte, others are listed by place.
    """
    order = np.argsort(h)
    h, values = h[order], [v[order].astype(np.uint64) for v in values]
    mark = values[0] if len(values) == 1 else hashed(values)
    _, first, kind, often = np.unique(mark, return_index=True, return_inverse=True, return_counts=True)
    rank = np.argsort(-often, kind="stable")
    place = np.empty(len(rank), np.int64)
    place[rank] = np.arange(len(rank))
    kind = place[kind]
    kinds = np.stack([v[first[rank]] for v in values]) if len(h) else np.empty((len(values), 0), np.uint64)
    rare = np.flatnonzero(kind >= 255)
    starts = np.searchsorted(h >> np.uint64(64 - DIRECTORY), np.arange((1 << DIRECTORY) + 2, dtype=np.uint64)).astype(np.uint32)
    head = np.array([len(h), len(values), kinds.shape[1], len(rare)], np.uint64)
    write_array(folder, str(part), head, kinds, rare.astype(np.uint64), kind[rare].astype(np.uint64), starts, (h >> np.uint64(16)).astype(np.uint32), (h >> np.uint64(8)).astype(np.uint8), np.minimum(kind, 255).astype(np.uint8))


class StoredPart:
    """A mapped file of store_table."""

    def __init__(self, folder: str, part: int):
        raw = map_array(folder, str(part))
        n, columns, kinds, rare = raw[:32].view(np.uint64).tolist()
        self.at = 32
        self.n = n

        def next_(dtype, count):
            size = np.dtype(dtype).itemsize * count
            out = raw[self.at : self.at + size].view(dtype)
            self.at += size
            return out

        self.kinds = next_(np.uint64, columns * kinds).reshape(columns, kinds)
        self.rare, self.rare_kind = next_(np.uint64, rare), next_(np.uint64, rare)
        self.starts = next_(np.uint32, (1 << DIRECTORY) + 2)
        self.middle, self.last, self.code = next_(np.uint32, n), next_(np.uint8, n), next_(np.uint8, n)

    def search(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is there) of each hash: by its first bits a bucket, in it by the next 32, of which 8 more must agree."""
        bucket = (h >> np.uint64(64 - DIRECTORY)).astype(np.int64)
        at, end = self.starts[bucket].astype(np.int64), self.starts[bucket + 1].astype(np.int64)
        if not self.n:
            return at, np.zeros(len(h), bool)
        want, last = (h >> np.uint64(16)).astype(np.uint32), (h >> np.uint64(8)).astype(np.uint8)
        step = 1 << int((end - at).max(initial=0)).bit_length()
        while step := step >> 1:
            on = at + step
            at = np.where((on <= end) & (self.middle[np.minimum(on, self.n) - 1] < want), on, at)
        there = np.zeros(len(h), bool)
        for _ in range(3):  # neighbours with the same 32 bits are next to unknown
            here = np.minimum(at, self.n - 1)
            same = (at < end) & (self.middle[here] == want)
            there = same & (self.last[here] == last)
            on = same & ~there
            if not on.any():
                break
            at = np.where(on, at + 1, at)
        return np.minimum(at, self.n - 1), there

    def values(self, at: np.ndarray, columns: slice = slice(None)) -> np.ndarray:
        """Columns x places."""
        kind = self.code[at].astype(np.int64)
        many = np.flatnonzero(kind == 255)
        if len(many):
            kind[many] = self.rare_kind[np.searchsorted(self.rare, at[many].astype(np.uint64))]
        return self.kinds[columns, kind]


#: Mapped files that a table of a worker holds open; the one that was opened first is let go for the next.
MOST_OPEN = 4096


def opened(known: dict, p: int, open_: Callable):
    """known[p], opened if it is not there; None where there is no such file."""
    if p not in known:
        while len(known) >= MOST_OPEN:
            del known[next(iter(known))]
        try:
            known[p] = open_(p)
        except FileNotFoundError:
            known[p] = None
    return known[p]


@dataclass
class Table:
    """Stored parts; they are opened where they are needed. Parts without rows may have no file: no list of parts goes to the workers."""

    folder: str
    columns: int = 1
    _open: dict[int, StoredPart | None] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def part(self, p: int) -> StoredPart | None:
        return opened(self._open, p, lambda q: StoredPart(self.folder, q))

    def groups(self, part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(part, kind="stable")
        edges = np.append(np.flatnonzero(np.diff(part[order], prepend=-1)), len(part))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            p = int(part[order[a]])
            if self.part(p) is not None:
                yield p, order[a:b]

    def find(self, h: np.ndarray, part: np.ndarray, columns: slice = slice(None)) -> np.ndarray:
        """Columns x hashes: the values, 0 where a hash is not there."""
        out = np.zeros((len(range(self.columns)[columns]), len(h)), np.int64)
        for p, own in self.groups(part):
            at, there = self.part(p).search(h[own])
            out[:, own[there]] = self.part(p).values(at[there], columns)
        return out


@dataclass
class Words(Table):
    """Words by hash; their ids are their places in all parts, of which there are as many as partitions of the texts."""

    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # the first id of each part, and the number of words
    n_texts: int = 0

    def ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count or 0) of each hash."""
        own, _, at = distinct(h)
        place, count = np.full(len(own), -1, np.int64), np.zeros(len(own), np.int64)
        for p, some in self.groups(part_of(own, len(self.first) - 1)):
            found, there = self.part(p).search(own[some])
            place[some[there]] = found[there] + self.first[p]
            count[some[there]] = self.part(p).values(found[there])[0]
        return place[at], count[at]

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of ids; of the start and the padding, the number of texts."""
        own, _, at = distinct(ids)
        count = np.full(len(own), self.n_texts, np.int64)
        known = own < self.first[-1]
        for p, some in self.groups(np.searchsorted(self.first, own[known], side="right") - 1):
            count[some] = self.part(p).values(own[some] - self.first[p])[0]
        return count[at]


#: Of a context: occurrences, and followers that occur once, twice, more often. `before`: different words before an n-gram.
STATISTICS = ("total", "once", "twice", "more")


@dataclass
class KneserNey:
    order: int
    words: Words
    packing: Packing
    parts: dict[int, int]  # of the n-grams of each order
    salted: int  # contexts of which more may occur than this are dealt out by their last word too
    id_rows: int
    n_tokens: int
    folder: str
    grams: dict[int, Table] = field(default_factory=dict)
    contexts: dict[int, Table] = field(default_factory=dict)  # of k words, beside the n-grams of k + 1 words
    discounts: dict[int, np.ndarray] = field(default_factory=dict)
    n_pairs: int = 0
    left_over: float = 1.0  # probability that the unigrams leave for the uniform distribution
    _dense: dict[int, np.ndarray] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"_dense": {}}

    @property
    def n_words(self) -> int:
        return self.packing.n_words

    def part(self, w: list[np.ndarray], often: np.ndarray) -> np.ndarray:
        """Parts of n-grams w; often: a bound on how often their contexts occur."""
        salts = (often // self.salted).astype(np.uint64)
        salt = np.where(salts > 0, mixed(w[-1].astype(np.uint64)) % (salts + np.uint64(1)), np.uint64(0))
        return part_of(mixed(hashed(self.packing.pack(w[:-1])) ^ mixed(salt)), self.parts[len(w)])

    def found(self, w: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """For n-grams w, whose words' counts are given: (distinct one of each, counts of the distinct ones, their weights as contexts)."""
        k = len(w)
        own, first, at = distinct(hashed(self.packing.pack(w)))
        counts = [c[first] for c in counts]
        part = self.part([x[first] for x in w], np.minimum.reduce(counts[:-1]))
        n = self.grams[k].find(own, part, slice(0, 1))[0]
        if k == self.order:
            return at, n, None
        # Salted contexts have their statistics beside the counts, others with the longer n-grams.
        statistics, often = np.zeros((len(STATISTICS), len(own)), np.int64), np.minimum.reduce(counts)
        whole, salted = np.flatnonzero((n > 0) & (often < self.salted)), np.flatnonzero((n > 0) & (often >= self.salted))
        statistics[:, whole] = self.contexts[k].find(own[whole], part_of(mixed(own[whole]), self.parts[k + 1]))
        statistics[:, salted] = self.grams[k].find(own[salted], part[salted], slice(1, None))
        return at, n, weights(statistics, self.discounts[k + 1])

    def unigrams(self, ids: np.ndarray) -> np.ndarray:
        """(total, share) of ids as contexts and how much of their own probability is seen: 3 x ids."""
        statistics = self.dense(ids)
        return np.concatenate([weights(statistics, self.discounts[2]), taken_off(statistics[4], self.discounts[1])[None] / self.n_pairs])

    def dense(self, ids: np.ndarray) -> np.ndarray:
        """(total, once, twice, more, before) of ids: 5 x ids."""
        own, _, at = distinct(ids)
        out = np.zeros((len(STATISTICS) + 1, len(own)), np.int64)
        edges = np.searchsorted(own, np.arange(0, self.n_words + 1 + self.id_rows, self.id_rows))
        for p in np.flatnonzero(np.diff(edges)):
            part = opened(self._dense, int(p), lambda q: map_array(f"{self.folder}/ids", str(q), "u8").reshape(len(STATISTICS) + 1, -1))
            a, b = edges[p], edges[p + 1]
            if part is not None:
                out[:, a:b] = part[:, own[a:b] - p * self.id_rows]
        return out[:, at]


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """Discounts of counts 0, 1, 2, 3 and more from the number of items that occur 1, 2, 3 and 4 times (Chen and Goodman)."""
    n1, n2, n3, n4 = counts_of_counts
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    out = [0.0]
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        out.append(min(float(k), max(0.0, k - (k + 1) * y * b / a)) if a else min(0.5, k))
    return np.array(out)


def share(statistics: np.ndarray, d: np.ndarray) -> np.ndarray:
    """What discounting leaves of contexts' totals for the order below; all of it where the total is 0."""
    total, once, twice, more = statistics[:4].astype(np.float64)
    out, used = np.ones(len(total)), total > 0
    out[used] = (d[1] * once + d[2] * twice + d[3] * more)[used] / total[used]
    return out


def weights(statistics: np.ndarray, d: np.ndarray) -> np.ndarray:
    """(total, share) of contexts."""
    return np.stack([statistics[0].astype(np.float64), share(statistics, d)])


def taken_off(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.maximum(n - d[np.minimum(n, 3)], 0)


# ---- training ----


def counted_words(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Blocks of hashes and counts, whenever the words at hand have become many."""
    none = np.empty(0, np.uint64)
    h = n = none
    for batch in common.slices(batches, "text"):
        own, often = np.unique(tokens(batch.column("text").to_pylist())[0], return_counts=True)
        (h,), (n,) = _sorted([np.concatenate([h, own])], [np.concatenate([n, often.astype(np.uint64)])])
        if len(h) > HELD_WORDS:
            yield dealt([h, n], part_of(h, parts))
            h = n = none
    if len(h):
        yield dealt([h, n], part_of(h, parts))
    common.trim()


class Reader:
    """Ids, counts and, if asked for, unigram weights of texts' tokens; each slice's distinct words are looked up once."""

    def __init__(self, words: Words, dense: Callable | None = None):
        self.words, self.of = words, dense

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
        """(ids, counts, statistics, lengths)."""
        h, lengths = tokens(texts)
        own, _, at = distinct(h)
        ids, counts = self.words.ids(own)
        statistics = None
        if self.of:
            statistics = np.zeros((3, len(own)))
            statistics[:, ids >= 0] = self.of(ids[ids >= 0])
            statistics = statistics[:, at]
        return ids[at], counts[at], statistics, lengths


def gathered(batches: Iterator[pa.RecordBatch], words: Words, arrays_for: Callable, parts_for: Callable) -> Iterator[pa.RecordBatch]:
    """Blocks of the distinct keys and counts of every GATHERED tokens.

    arrays_for(ids, counts, lengths): packed keys of tokens, and one more array that is the same for equal keys; parts_for(keys, that array).
    """
    reader, held, size = Reader(words), [], 0

    def emit():
        *columns, extra = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        order = np.argsort(columns[0]) if len(columns) == 1 else np.lexsort(columns[::-1])
        new = np.zeros(len(order), bool)
        new[:1] = True
        for c in columns:
            ranked = c[order]
            new[1:] |= ranked[1:] != ranked[:-1]
        starts = np.flatnonzero(new)
        first, n = order[starts], np.diff(np.append(starts, len(order)))
        columns = [c[first] for c in columns]
        return dealt([*columns, n.astype(np.uint64)], parts_for(columns, extra[first]))

    for batch in common.slices(batches, "text"):
        ids, counts, _, lengths = reader.read(batch.column("text").to_pylist())
        held.append(arrays_for(ids, counts, lengths))
        size += len(ids)
        if size >= GATHERED:
            yield emit()
            size = 0
    if held:
        yield emit()
    common.trim()


def _head(part: int, sums: list[int]) -> pa.RecordBatch:
    """A part's row of sums, told apart by its negative number."""
    return pa.RecordBatch.from_arrays([pa.array([-1 - part], pa.int32()), pa.array([len(sums)], pa.int32()), pa.array([np.array(sums, np.int64).tobytes()], pa.binary())], ["part", "rows", "block"])


def _heads(df: DataFrame) -> dict[int, list[int]]:
    """part: sums; one row for each part comes to the driver."""
    return {-1 - r["part"]: np.frombuffer(r["block"], np.int64).tolist() for r in df.where("part < 0").collect()}


def _totals(df: DataFrame, width: int) -> list[int]:
    """The sums of all parts' rows of sums, added up in the tasks first: a row for each task comes to the driver."""

    def run(batches):
        total = np.zeros(width, np.int64)
        for b in batches:
            for x in b.column("block").to_pylist():
                total += np.frombuffer(x, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["block"])

    rows = df.where("part < 0").select("block").mapInArrow(run, "block binary").collect()
    return np.sum([np.frombuffer(r["block"], np.int64) for r in rows], axis=0, dtype=np.int64).tolist() if rows else [0] * width


def train(df: DataFrame, text: str = "text", order: int = 2) -> KneserNey:
    """Count and store a model of all texts of the frame."""
    if order < 2:
        raise ValueError("the order must be two at least")
    spark = df.sparkSession
    common.ship(spark)
    folder = common.fresh_path(spark, "kneser-ney")
    texts = df.select(F.col(text).alias("text"))
    parts = max(1, texts.rdd.getNumPartitions())

    def store_words(key: tuple, table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        found = arrays_of(table, 2)
        (h,), (n,) = _sorted(found[:1], found[1:])
        store_table(f"{folder}/words", part, h, [n])
        ends = int(n[h == END].sum())
        return pa.Table.from_batches([_head(part, [len(h), int(n.sum()), ends])])

    counted = texts.mapInArrow(lambda b: counted_words(b, parts), BLOCKS)
    with common.cleaned(spark):
        stored = _heads(counted.groupBy("part").applyInArrow(store_words, BLOCKS))
    first = np.cumsum([0, *(stored[p][0] if p in stored else 0 for p in range(parts))])
    words = Words(f"{folder}/words", first=first, n_texts=sum(x[2] for x in stored.values()))
    packing, n_tokens = Packing(int(first[-1])), sum(x[1] for x in stored.values())
    # Every token ends one n-gram of the order; each of them reports to two shorter ones at most.
    parts_of = {k: max(1, -(-n_tokens // PART_ROWS)) for k in range(2, order + 1)}
    id_rows = -(-(packing.n_words + 1) // parts_of[2])
    model = KneserNey(order, words, packing, parts_of, max(1, PART_ROWS // 8), id_rows, n_tokens, folder)

    def keys_of(ids: np.ndarray, count: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        texts_ = words.n_texts
        often = np.minimum.reduce([before(count, lengths, m, texts_, texts_) for m in range(1, order)])
        return [*packing.pack([*(before(ids, lengths, m, packing.start, packing.pad) for m in range(order - 1, 0, -1)), ids]), (often // model.salted).astype(np.uint32)]

    def parts_for(keys: list[np.ndarray], salts: np.ndarray) -> np.ndarray:
        return model.part(packing.unpack(keys, order), salts.astype(np.int64) * model.salted)

    def store_grams(k: int):
        """Store a part of the n-grams of k words, and report to those of k - 1 words."""
        width, values = packing.width(k), 1 if k == order else len(STATISTICS) + 1

        def store(key: tuple, table: pa.Table) -> pa.Table:
            part = key[0].as_py()
            found = arrays_of(table, width + values)
            columns, values_ = _sorted(found[:width], [x.astype(np.int64) for x in found[width:]])
            del found, table
            w, n = packing.unpack(columns, k), values_[-1]
            real = w[0] != packing.pad
            store_table(f"{folder}/{k}", part, hashed(columns)[real], [values_[-1][real], *(x[real] for x in values_[:-1])])
            some = real & (n > 0)
            sums = [int(real.sum()), int(some.sum()), *(int((n[some] == c).sum()) for c in (1, 2, 3, 4))]
            # Contexts: n-grams are sorted, so those of a context are neighbours.
            context, own = [x[some] for x in w[:-1]], n[some]
            new = np.ones(len(own), bool)
            new[1:] = np.any([x[1:] != x[:-1] for x in context], axis=0)
            starts = np.flatnonzero(new)
            context = [x[starts] for x in context]
            statistics = [np.add.reduceat(x.astype(np.int64), starts) if len(starts) else own[:0] for x in (own, own == 1, own == 2, own > 2)]
            # N-grams without their first word: how many words stand before them.
            tail, (different,) = _sorted([x[n > 0] for x in packing.pack(w[1:])], [np.where(real, 1, n)[n > 0]])
            nil = np.zeros(len(different), np.int64)
            if k > 2:
                whole = np.minimum.reduce([words.counts(x) for x in context]) < model.salted if len(starts) else np.zeros(0, bool)
                h = hashed(packing.pack(context))
                store_table(f"{folder}/{k - 1}-contexts", part, h[whole], [x[whole] for x in statistics])
                sums.append(int(whole.sum()))
                split = [x[~whole] for x in packing.pack(context)]
                keys = [np.concatenate([a, b]) for a, b in zip(split, tail, strict=True)]
                sides = [np.concatenate([a[~whole], nil]) for a in statistics] + [np.concatenate([np.zeros(int((~whole).sum()), np.int64), different])]
                keys, sides = _sorted(keys, sides)
                shorter = packing.unpack(keys, k - 1)
                to = model.part(shorter, np.minimum.reduce([words.counts(x) for x in shorter[:-1]])) if len(keys[0]) else np.empty(0, np.int32)
            else:
                # The start, as a context, has the last id.
                keys = [np.concatenate([context[0], tail[0].astype(np.int64)]).astype(np.uint64)]
                sides = [np.concatenate([a, nil]) for a in statistics] + [np.concatenate([np.zeros(len(starts), np.int64), different])]
                keys, sides = _sorted(keys, sides)
                to = (keys[0].astype(np.int64) // id_rows).astype(np.int32)
            return pa.Table.from_batches([_head(part, sums), *([dealt([*keys, *(x.astype(np.uint64) for x in sides)], to)] if len(to) else [])])

        return store

    rows, last = texts.mapInArrow(lambda b: gathered(b, words, keys_of, parts_for), BLOCKS), []
    for k in range(order, 1, -1):
        reported = common.staged(rows.groupBy("part").applyInArrow(store_grams(k), BLOCKS), f"kneser-ney-{k - 1}", done=last)
        sums = _totals(reported, 7 if k > 2 else 6)
        model.grams[k] = Table(f"{folder}/{k}", 1 if k == order else len(STATISTICS) + 1)
        model.discounts[k] = discounts(sums[2:6])
        if k > 2:
            model.contexts[k - 1] = Table(f"{folder}/{k - 1}-contexts", len(STATISTICS))
        model.n_pairs = sums[1]
        rows, last = reported.where("part >= 0"), [reported]

    def store_ids(key: tuple, table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        ids, *sides = arrays_of(table, len(STATISTICS) + 2)
        dense = np.zeros((len(sides), min(id_rows, packing.n_words + 1 - part * id_rows)), np.int64)
        for x, y in zip(dense, sides, strict=True):
            np.add.at(x, ids.astype(np.int64) - part * id_rows, y.astype(np.int64))
        write_array(f"{folder}/ids", str(part), dense.astype(np.uint64))
        n = dense[-1]
        return pa.Table.from_batches([_head(part, [*(int((n == c).sum()) for c in (1, 2, 3, 4)), int((n > 2).sum())])])

    with common.cleaned(spark):
        of_words = _totals(rows.groupBy("part").applyInArrow(store_ids, BLOCKS), 5)
    common.drop(*last)
    d = model.discounts[1] = discounts(of_words[:4])
    model.left_over = float(d[1] * of_words[0] + d[2] * of_words[1] + d[3] * of_words[4]) / model.n_pairs if model.n_pairs else 1.0
    return model


# ---- scoring ----


def log_probabilities(model: KneserNey, ids: np.ndarray, count: np.ndarray, statistics: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token: log10 probability by the model and by the base formula. statistics: unigrams() of each token."""
    base = np.log10((count + 1.0) / (model.n_tokens + 1.0 * (model.n_words + 1)))
    known = ids >= 0
    # Unigrams: discounted numbers of words before and a share of the uniform distribution over all words and the unknown one.
    p = np.full(len(ids), model.left_over / (model.n_words + 1))
    if not model.n_pairs:
        return np.log10(p), base
    p += statistics[2]
    start, pad, texts = model.packing.start, model.packing.pad, model.words.n_texts
    first = np.cumsum(lengths) - lengths
    # The context of a token of a text's beginning is the start, of others the n-gram that ends one token before.
    place = np.append(0, np.where(known, np.arange(len(ids)) + 1, -1)[:-1])
    place[first] = 0
    contexts = np.concatenate([model.unigrams(np.array([start]))[:2], statistics[:2]], axis=1)
    for k in range(2, model.order + 1):
        w = [before(ids, lengths, m, start, pad) for m in range(k - 1, 0, -1)]
        own = np.flatnonzero((place >= 0) & (w[0] != pad))
        total = contexts[0][place[own]]
        p[own] *= contexts[1][place[own]]
        good = known[own] & (total > 0)
        pick, total = own[good], total[good]
        counts = [*(before(count, lengths, m, texts, texts)[pick] for m in range(k - 1, 0, -1)), count[pick]]
        at, n, contexts = model.found([*(x[pick] for x in w), ids[pick]], counts)
        p[pick] += taken_off(n[at], model.discounts[k]) / total
        ends = np.full(len(ids), -1)
        ends[pick] = np.where(n[at] > 0, at, -1)
        place = np.append(-1, ends[:-1])
    return np.log10(p), base


def score(df: DataFrame, model: KneserNey, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns keep, n_tokens, n_known, base_score, score and perplexity of each whole text."""
    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", n_tokens long, n_known long, base_score double, score double, perplexity double"

    def make():
        reader = Reader(model.words, model.unigrams if model.n_pairs else None)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, count, statistics, lengths = reader.read(batch.column(text).to_pylist())
            p, base = log_probabilities(model, ids, count, statistics, lengths)
            first = np.cumsum(lengths) - lengths
            total = np.add.reduceat(p, first)
            columns = [lengths, np.add.reduceat((count > 0).astype(np.int64), first), np.add.reduceat(base, first), total, 10 ** np.minimum(300, -total / lengths)]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *map(pa.array, columns)], [*keep, "n_tokens", "n_known", "base_score", "score", "perplexity"])

        return work

    return common.map_slices(df.select(*keep, text), make, schema, text, SCORED_BYTES)


def fold(key: Column, of: int) -> Column:
    """crc32 of the key as text, modulo; null keys count as the empty text."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % of


def op3_kneser_ney(spark, sf_dir: str, order: int = 3) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    held = fold(F.col("doc_id"), 7) == 2
    model = train(docs.where(~held), order=order)
    rows = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text"), model, keep=("doc_id", "held_out"))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")

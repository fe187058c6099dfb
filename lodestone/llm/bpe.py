"""Byte-level BPE encoding and decoding (operator 2).

A piece of text is a byte string; its bytes are mapped to Latin-1 characters so that an Aho-Corasick automaton over
the vocabulary can report every occurrence of every token in one pass. From these the encoder keeps, for each
position, the longest token that starts there. It then walks from left to right: it takes the longest token whose end
has not been ruled out and which is compatible with the token before it, tries shorter prefixes of it otherwise, and
steps back when nothing fits, marking the position as ruled out. A position is ruled out once, so the work is linear
in the piece. Two tokens are compatible if the merge procedure, run over their joined bytes, leaves the border between
them in place; that is decided by unfolding the merges of both sides along the border and is memoised. The outcome is
the sequence that the merges make, as every pair of neighbours in it is compatible.

Edge cases: a null text is taken as empty (0 tokens, digests of the empty string); there is no bound on a text's or a
piece's length; rows are independent, so repeated rows give repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Pieces longer than this are encoded without being remembered, and so many pieces are remembered at most.
MEMO_CHARS, MEMO_PIECES = 48, 600_000
#: In texts of these characters alone, the standard pattern may be matched with explicit classes by the faster `re`.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\u024f]*")
STANDARD = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
STANDARD_PLAIN = STANDARD.replace(r"[^\s\p{L}\p{N}]", r"[^\t\n\r 0-9A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]").replace(r"\p{L}", r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]").replace(r"\p{N}", "[0-9]")


class ByteBPE:
    """Encoder and decoder for a file of ranks (base64 of a token's bytes, blank, rank)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.find_plain = re.compile(STANDARD_PLAIN).findall if pattern == STANDARD else self.find
        size = max(ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.text_of = [str(i) for i in range(size)]
        self.length = [len(t) for t in self.bytes_of]
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        # The longest shorter token that starts a token, or -1.
        self.shorter = [-1] * size
        for token, rank in ranks.items():
            for n in range(len(token) - 1, 0, -1):
                if (r := ranks.get(token[:n])) is not None:
                    self.shorter[rank] = r
                    break
        self._fits: dict[int, bool] = {}
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(size)]
        self.joined: dict[tuple[int, int], int] = {}
        self._unfold()

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as f:
            pairs = (line.split() for line in f if line.strip())
            return cls({base64.b64decode(a): int(b) for a, b in pairs}, pattern)

    def _unfold(self) -> None:
        """For each token in the order of ranks, the two tokens whose merge makes it."""
        for rank, token in enumerate(self.bytes_of):
            if len(token) < 2:
                continue
            left = self.shorter[rank]
            while left != -1:
                right = self.ranks.get(token[self.length[left] :])
                if right is not None and left < rank and right < rank and self._border_stays(left, right):
                    self.joined[left, right] = rank
                    self.halves[rank] = (left, right)
                    break
                left = self.shorter[left]

    def _border_stays(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border of two tokens before both are complete."""
        joined, halves = self.joined, self.halves
        limit = 1 << 60
        while True:
            if joined.get((left, right), limit) < limit:
                return False
            # Undo the later of the two merges that touch the border; a merge across it would have had to come earlier.
            if left > right:
                limit, inner = left, halves[left][1]
                if inner != left:
                    left = inner
                    continue
                limit, inner = right + 1, halves[right][0]
                if inner == right:
                    return True
                right = inner
            else:
                limit, inner = right + 1, halves[right][0]
                if inner != right:
                    right = inner
                    continue
                limit, inner = left, halves[left][1]
                if inner == left:
                    return True
                left = inner

    def fits(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            known = self._fits[key] = self._border_stays(left, right)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n, length, shorter, fits = len(piece), self.length, self.shorter, self.fits
        longest = [-1] * n
        for end, rank in self.automaton.iter(piece.decode("latin-1")):
            longest[end - length[rank] + 1] = rank  # ends ascend: the longest comes last
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while token != -1:
                end = at + length[token]
                if alive[end] and (last == -1 or fits(last, token)):
                    out.append(token)
                    at, token = end, longest[end] if end < n else -1
                    break
                token = shorter[token]
            else:
                if last == -1:
                    raise ValueError("the vocabulary lacks a byte of this text")
                alive[at] = 0
                out.pop()
                at -= length[last]
                token = shorter[last]
        return out

    def encoder(self):
        """A function from a text to the array of its ids, which remembers short pieces."""
        memo: dict[str, bytes] = {}
        find, find_plain, encode_piece, plain = self.find, self.find_plain, self.encode_piece, PLAIN.fullmatch

        class Memo(dict):
            def __missing__(self, piece: str) -> bytes:
                ids = array("I", encode_piece(piece.encode())).tobytes()
                if len(piece) <= MEMO_CHARS:
                    if len(self) >= MEMO_PIECES:
                        self.clear()
                    self[piece] = ids
                return ids

        memo = Memo()

        def encode(text: str) -> np.ndarray:
            pieces = find_plain(text) if plain(text) else find(text)
            return np.frombuffer(b"".join(map(memo.__getitem__, pieces)), "u4")

        return encode

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_loaded: dict[tuple[str, str], ByteBPE] = {}


def tokenizer(path: str, pattern: str) -> ByteBPE:
    """Loaded once in each worker process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBPE.load(path, pattern)
    return _loaded[path, pattern]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(df: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` and `ids` (array of int): the token ids of each text. Null counts as empty."""
    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", ids array<int>"

    def make():
        where = default_vocabulary()
        to_ids = tokenizer(path or where[0], pattern or where[1]).encoder()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [to_ids(t or "").astype("i4") for t in batch.column(text).to_pylist()]
            offsets = np.cumsum([0, *map(len, ids)]).astype("i4")
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.empty(0, "i4")))
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), column], [*keep, "ids"])

        return work

    return common.map_slices(df.select(*keep, text), make, schema, text)


def decode(df: DataFrame, ids: str = "ids", path: str | None = None, pattern: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` and `bytes` (binary): the bytes that the ids stand for. Null counts as empty."""
    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", bytes binary"
    common.ship(df.sparkSession)

    def run(batches):
        where = default_vocabulary()
        own = tokenizer(path or where[0], pattern or where[1])
        for batch in batches:
            out = pa.array([own.decode(x or ()) for x in batch.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), out], [*keep, "bytes"])

    return df.select(*keep, ids).mapInArrow(run, schema)


def digests(df: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode fused in one pass, so no ids leave the worker."""

    def make():
        where = default_vocabulary()
        own = tokenizer(path or where[0], pattern or where[1])
        to_ids, text_of, sha = own.encoder(), own.text_of, hashlib.sha256

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, of_ids, of_bytes = [], [], []
            for t in batch.column(text).to_pylist():
                ids = to_ids(t or "").tolist()
                counts.append(len(ids))
                of_ids.append(sha(" ".join(map(text_of.__getitem__, ids)).encode()).hexdigest())
                of_bytes.append(sha(own.decode(ids)).hexdigest())
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

        return work

    return common.map_slices(df.select(F.col("doc_id").cast("long").alias("doc_id"), text), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", text)


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(common.documents(spark, sf_dir))

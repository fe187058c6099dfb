"""Media columns (operator 7): payload bytes as PNG images in a binary column, read back with checksum tests.

Writing: the payload becomes 8-bit grey samples, ROW bytes to a row; each row takes the filter (none, left, up) with the
smallest sum of absolute residuals; the filtered rows go through zlib into IDAT chunks. Reading: every chunk's CRC is
tested, the image data is inflated with a bound on its size, and numpy undoes the five filters (left and up over whole
runs of rows at once; average and Paeth along anti-diagonals). The feature is a cosine-transform hash: the image is
averaged down to 32 x 32, and 63 low-frequency coefficients are held against their median.

Edge cases: a null text counts as empty; an empty payload is one row of blanks; equal texts give equal bytes and
features; damaged bytes raise PngError in the codec and give null payload and features in load(); rows are independent.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ROW = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHUNK = 1 << 20
#: Rows that are filtered and deflated at once; a long payload takes no more room beside its own bytes.
BLOCK_ROWS = 1 << 14
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


class PngError(ValueError):
    pass


def padded(payload: bytes, unit: int = ROW, fill: bytes = b" ") -> bytes:
    """The payload with fill up to a positive multiple of unit."""
    short = -len(payload) % unit if payload else unit
    return payload + fill * short


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def write_png(payload: bytes, row: int = ROW, level: int = 6) -> bytes:
    """A grey 8-bit PNG whose samples are the payload, a positive multiple of row bytes."""
    if not payload or len(payload) % row:
        raise PngError("payload is no positive multiple of the row")
    x = np.frombuffer(payload, np.uint8).reshape(-1, row)
    deflate, packed = zlib.compressobj(level), []
    for a in range(0, len(x), BLOCK_ROWS):
        own = x[a : a + BLOCK_ROWS]
        left, up = own.copy(), own.copy()
        left[:, 1:] -= own[:, :-1]
        up[1:] -= own[:-1]
        if a:
            up[0] -= x[a - 1]
        tries = (own, left, up)
        kind = np.argmin([np.abs(t.view(np.int8).astype(np.int16)).sum(axis=1, dtype=np.int64) for t in tries], axis=0)
        rows = np.empty((len(own), row + 1), np.uint8)
        rows[:, 0] = kind
        rows[:, 1:] = np.choose(kind[:, None], tries)
        packed.append(deflate.compress(rows.tobytes()))
    body = b"".join([*packed, deflate.flush()])
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", row, len(x), 8, 0, 0, 0, 0))]
    parts += [_chunk(b"IDAT", body[i : i + CHUNK]) for i in range(0, len(body), CHUNK)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def chunks(data: bytes):
    """(kind, body) of each chunk; raises at a wrong signature, a cut file or a wrong CRC."""
    if data[:8] != SIGNATURE:
        raise PngError("no PNG signature")
    at = 8
    while True:
        if at + 12 > len(data):
            raise PngError("the file ends within a chunk")
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if at + 12 + n > len(data):
            raise PngError("the file ends within a chunk")
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise PngError(f"wrong CRC in {kind!r}")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + n


def read_png(data: bytes) -> np.ndarray:
    """The samples, as an array of height x width x channels."""
    head, body = None, []
    for kind, part in chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        elif kind[:1].isupper() and kind not in (b"IEND", b"PLTE"):
            raise PngError(f"unknown critical chunk {kind!r}")
    if head is None or not body:
        raise PngError("IHDR or IDAT is missing")
    width, height, depth, colour, _, _, interlace = head
    if depth != 8 or colour not in CHANNELS or interlace or not width or not height:
        raise PngError("only plain 8-bit images are read")
    per = CHANNELS[colour]
    size = height * (width * per + 1)
    inflate = zlib.decompressobj()
    try:
        raw = inflate.decompress(b"".join(body), size + 1)
    except zlib.error as e:
        raise PngError(str(e)) from e
    if len(raw) != size or not inflate.eof:
        raise PngError("the image data has a wrong size")
    rows = np.frombuffer(raw, np.uint8).reshape(height, width * per + 1)
    return unfilter(rows[:, 0], rows[:, 1:].reshape(height, width, per))


def unfilter(kinds: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Undo the filters of rows; runs of equal filters are undone together."""
    if kinds.max() > 4:
        raise PngError("unknown filter")
    out = np.array(x, np.uint8)
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(kinds)], strict=True):
        kind = kinds[a]
        if kind == 1:
            np.cumsum(out[a:b], axis=1, dtype=np.uint8, out=out[a:b])
        elif kind == 2:
            if a:
                out[a] += out[a - 1]
            np.cumsum(out[a:b], axis=0, dtype=np.uint8, out=out[a:b])
        elif kind > 2:
            _diagonals(out, a, b, kind)
    return out


def _diagonals(out: np.ndarray, a: int, b: int, kind: int) -> None:
    """Average (3) or Paeth (4) over rows a to b: all samples with equal row + column depend only on earlier diagonals."""
    width = out.shape[1]
    wide = np.zeros((b - a + 1, width + 1, out.shape[2]), np.int32)  # with a row above and a column to the left
    if a:
        wide[0, 1:] = out[a - 1]
    for d in range(b - a + width - 1):
        r = np.arange(max(0, d - width + 1), min(b - a, d + 1))
        c = d - r
        left, up, corner = wide[r + 1, c], wide[r, c + 1], wide[r, c]
        if kind == 3:
            guess = (left + up) >> 1
        else:
            p = left + up - corner
            pl, pu, pc = abs(p - left), abs(p - up), abs(p - corner)
            guess = np.where((pl <= pu) & (pl <= pc), left, np.where(pu <= pc, up, corner))
        wide[r + 1, c + 1] = (out[a + r, c] + guess) & 255
    out[a:b] = wide[1:, 1:]


def averaged(x: np.ndarray, to: int = 32) -> np.ndarray:
    """Area averages of the rows of x: to rows in place of len(x), from running sums that are read at the areas' edges."""
    n = len(x)
    sums = np.zeros((n + 1, x.shape[1]))
    np.cumsum(x, axis=0, out=sums[1:])
    edge = np.arange(to + 1) * n / to
    whole = np.minimum(edge.astype(np.int64), n - 1)
    at = sums[whole] + (edge - whole)[:, None] * x[whole]
    return np.diff(at, axis=0) * (to / n)


def shrunk(image: np.ndarray, to: int = 32, rows: int = 1 << 16) -> np.ndarray:
    """The image averaged down to `to` x `to`; `rows` of it are held as numbers at once."""
    parts = [averaged(image[a : a + rows].mean(axis=2).T, to).T for a in range(0, len(image), rows)]
    return averaged(np.concatenate(parts), to)


@functools.cache
def _cosines(n: int = 32, keep: int = 8) -> np.ndarray:
    return np.cos(np.pi / n * (np.arange(n)[None, :] + 0.5) * np.arange(keep)[:, None])


def cosine_hash(image: np.ndarray) -> str:
    """64 bits as hex: signs of the lowest cosine coefficients against their median; the constant one is left out (bit 0)."""
    low = np.round(_cosines() @ shrunk(image) @ _cosines().T, 4).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def store(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, n_bytes and media: each text's UTF-8 bytes, padded, as a PNG in a binary column."""
    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", n_bytes long, media binary"

    def make():
        def work(batch):
            raw = [(t or "").encode() for t in batch.column(text).to_pylist()]
            return pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(map(len, raw), pa.int64()), pa.array([write_png(padded(r)) for r in raw], pa.binary())],
                [*keep, "n_bytes", "media"],
            )

        return work

    return common.map_slices(df.select(*keep, text), make, schema, text)


def load(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, payload (the samples' bytes) and feature; both null where the bytes are no sound PNG or null."""
    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", payload binary, feature string"

    def make():
        def one(data):
            try:
                image = read_png(data)
                return image.tobytes(), cosine_hash(image)
            except PngError:
                return None, None

        def work(batch):
            got = [(None, None) if d is None else one(d) for d in batch.column(media).to_pylist()]
            return pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.string())],
                [*keep, "payload", "feature"],
            )

        return work

    return common.map_slices(df.select(*keep, media), make, schema, media)


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(stored: DataFrame) -> DataFrame:
    """load() of a stored table (doc_id, n_bytes, media), reduced to digests of both forms, so that no payload crosses to the JVM.

    Rows whose bytes are no sound PNG have null in place of the payload's digests and the feature.
    """
    names = [c.split()[0] for c in DIGESTS.split(", ")]

    def make():
        sha = hashlib.sha256

        def one(media):
            try:
                image = read_png(media)
            except PngError:
                return None, None, None, len(media), sha(media).hexdigest(), None
            back = image.tobytes()
            return len(back), sha(back).hexdigest(), zlib.crc32(back[-16:]), len(media), sha(media).hexdigest(), cosine_hash(image)

        def work(batch):
            columns = list(zip(*map(one, batch.column("media").to_pylist()), strict=True))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

        return work

    return common.map_slices(stored.select("doc_id", "n_bytes", "media"), make, DIGESTS, "media")


def op7_media(spark, sf_dir: str) -> DataFrame:
    """The media column is written to the shared folder as a table, then read back."""
    docs = common.documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return digests(common.staged(store(docs), "media"))

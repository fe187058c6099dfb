"""Operators 2, 5 and 7 below Spark: exact agreement with the libraries, round trips, packings."""

import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import bpe, media, packing

ALPHABET = st.lists(st.sampled_from(list("abethino \n\t\r-=!'01éßÉ日💡²\x1c\xa0s") + ["the", " in", "  ", "'s", "'ll"]), max_size=60).map("".join)


@pytest.fixture(scope="module")
def byte_bpe():
    return bpe.tokenizer(*bpe.default_vocabulary())


def test_byte_bpe_is_tiktoken(byte_bpe):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks, special_tokens={})
    encode = byte_bpe.encoder()

    @settings(max_examples=300, deadline=None)
    @given(ALPHABET)
    def same(text):
        ids = encode(text).tolist()
        assert ids == library.encode_ordinary(text)
        assert byte_bpe.decode(ids) == text.encode()

    same()
    for text in ("a" * 20_000, "ab" * 10_000, " " * 20_000, "".join(random.Random(3).choices("abcdei", k=20_000))):
        assert encode(text).tolist() == library.encode_ordinary(text)


def test_word_bpe_is_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    own = packing.tokenizer(None)

    @settings(max_examples=300, deadline=None)
    @given(ALPHABET)
    def same(text):
        assert np.frombuffer(next(own.ids([text])), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids

    same()
    for text in ("<|endoftext|> x", "İĲ ſ Σς", "é x", "WORD's 'LL"):
        assert np.frombuffer(next(own.ids([text])), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12))
def test_plan_is_best_fit_decreasing(counts):
    plan = packing.plan(counts, 30)
    length = np.array([n for n, c in counts.items() for _ in range(c)], np.int64)
    rank = np.array([r for c in counts.values() for r in range(c)], np.int64)
    if not len(length):
        assert plan.sequences == 0
        return
    sequence, offset = plan.slots(length, rank)
    for s in range(plan.sequences):
        at = 0
        for o, n in sorted(zip(offset[sequence == s], length[sequence == s], strict=True)):
            assert o == at
            at += n
        assert 0 < at <= 30
    free: list[int] = []
    for n in sorted(length.tolist(), reverse=True):
        fit = min((f for f in free if f >= n), default=None)
        if fit is None:
            free.append(30 - n)
        else:
            free[free.index(fit)] -= n
    assert plan.sequences == len(free)


def test_png_round_trip_and_checks():
    for raw in (b"", b"x", bytes(range(256)) * 9, "é".encode() * 1000):
        data = media.write_png(media.padded(raw))
        image = media.read_png(data)
        assert image.tobytes() == media.padded(raw) and len(media.cosine_hash(image)) == 16
        broken = bytearray(data)
        broken[len(data) // 2] ^= 1
        with pytest.raises(media.PngError):
            media.read_png(bytes(broken))
        with pytest.raises(media.PngError):
            media.read_png(data[:-5])
    with pytest.raises(media.PngError):
        media.write_png(b"12")


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_all_filters(channels):
    rng = np.random.default_rng(channels)
    kinds, x = rng.integers(0, 5, 30).astype(np.uint8), rng.integers(0, 256, (30, 9, channels)).astype(np.uint8)
    want = np.zeros(x.shape, int)
    for r, c, z in np.ndindex(*x.shape):
        left = want[r, c - 1, z] if c else 0
        up = want[r - 1, c, z] if r else 0
        corner = want[r - 1, c - 1, z] if r and c else 0
        p = left + up - corner
        paeth = min((abs(p - v), i, v) for i, v in enumerate((left, up, corner)))[2]
        want[r, c, z] = (int(x[r, c, z]) + (0, left, up, (left + up) // 2, paeth)[kinds[r]]) % 256
    assert (media.unfilter(kinds, x) == want).all()


def test_cosine_hash_against_plain_loops():
    rng = np.random.default_rng(5)
    for rows, row, channels in ((1, 40, 1), (3, 48, 1), (31, 7, 3), (33, 20, 1)):
        image = rng.integers(0, 256, (rows, row, channels)).astype(np.uint8)
        grey, small = image.mean(axis=2), np.zeros((32, 32))
        for i, j in np.ndindex(32, 32):
            for r, c in np.ndindex(rows, row):
                high = min((i + 1) * rows / 32, r + 1) - max(i * rows / 32, r)
                wide = min((j + 1) * row / 32, c + 1) - max(j * row / 32, c)
                if high > 0 and wide > 0:
                    small[i, j] += grey[r, c] * high * wide * 1024 / (rows * row)
        assert np.allclose(media.shrunk(image), small) and np.allclose(media.shrunk(image, rows=5), media.shrunk(image))
        wave = np.cos(np.pi / 32 * (np.arange(32)[None, :] + 0.5) * np.arange(8)[:, None])
        low = np.round([(np.outer(wave[u], wave[v]) * small).sum() for u in range(8) for v in range(8)], 4)
        middle = np.median(low[1:])
        bits = "".join("1" if k and x > middle else "0" for k, x in enumerate(low))
        assert media.cosine_hash(image) == f"{int(bits, 2):016x}"

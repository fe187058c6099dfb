"""Groups that are spread over tasks, and queries against the libraries that they must agree with."""

import hashlib
import random
import struct
import zlib
from collections import defaultdict
from itertools import groupby

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import common, hilbert, registry, warc

DATA = "/root/testdata/sf0.001"


def test_short_parameters_name_pages(spark):
    urls = ["http://a.org/x?ref=1", "http://a.org/x?ref=2", "http://a.org/x?sid=1&utm_source=q", "HTTP://www.a.org:80/x/?utm_source=z&sid=1#f"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(warc.canonical_url(F.col("u"))).collect()]
    assert len(set(got[:3])) == 3 and got[2] == got[3]


def test_a_hot_url_over_many_partitions(spark):
    rng = random.Random(11)
    rows = [(k, "hot" if k % 3 else f"u{k % 11}", rng.randrange(40), k if rng.random() < 0.3 else None) for k in range(2700)]
    df = spark.createDataFrame(rows, "id long, key string, at long, value long")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "6")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r["id"]: r["found"] for r in warc.latest_before(df, "key", ["at", "id"], "value", "found", "test").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    want, last = {}, {}
    for k, key, _, value in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        want[k] = last.get(key)
        last[key] = value if value is not None else last.get(key)
    assert got == want


def test_equal_texts_share_a_place_on_the_curve(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([None, "en", "de", "fr"]), f"s{rng.randrange(5)}", rng.choice(["copy"] * 3 + ["other", None, f"own {k}"])) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").repartition(5)
    kept = docs.select("doc_id", "lang", "source", F.crc32(F.coalesce("text", F.lit(""))).alias("crc"))
    dims = {"lang": hilbert.string_number(F.col("lang")), "source": hilbert.string_number(F.col("source"))}
    got = hilbert.shard_table(kept, dims, ["crc", "doc_id"], ["doc_id", "crc"], group=["crc"]).orderBy("shard", "slot").collect()
    assert len(got) == 900 and all(n in (112, 113) for n in np.bincount([r.shard for r in got]))
    runs = [k for k, _ in groupby(got, lambda r: r.crc)]
    assert len(runs) == len(set(runs))  # each text is one run of the order, so only a cut can part it
    assert [r.curve for r in got] == sorted(r.curve for r in got)
    for s in range(8):
        slots = [r.slot for r in got if r.shard == s]
        assert slots == list(range(len(slots)))


def test_spread_join(spark):
    rows = [("hot", k) for k in range(3000)] + [(f"k{k % 50}", k) for k in range(500)] + [(None, 1), ("none", 2)]
    many = spark.createDataFrame(rows, "key string, id long")
    sizes = defaultdict(int)
    for key, _ in rows:
        sizes[key] += 1
    one = spark.createDataFrame([(k, f"v{k}", n) for k, n in sizes.items() if k not in (None, "none")], "key string, value string, rows long")
    inner = common.spread_join(many, one, "key", "rows", len(rows), "id")
    assert sorted(map(tuple, inner.select("key", "id", "value").collect())) == sorted((k, i, f"v{k}") for k, i in rows if k not in (None, "none"))
    left = common.spread_join(many, one, "key", "rows", len(rows), "id", how="left").select("key", "id", "value").collect()
    assert len(left) == len(rows) and {r.value for r in left if r.key in (None, "none")} == {None}


def _documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


def test_byte_bpe_ids_are_the_librarys(spark):
    import base64

    import public_tokenizers as public
    import tiktoken

    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = _documents(spark)
    for r in registry.QUERIES["op2_byte_bpe"](spark, DATA).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_packed_ids_are_the_librarys(spark):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    ids = {k: [*library.encode(t, add_special_tokens=False).ids, 0] for k, t in _documents(spark).items()}
    pieces = defaultdict(list)
    for r in registry.QUERIES["op5_best_fit_packing"](spark, DATA).collect():
        pieces[r.doc_id].append(r)
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
    for k, own in pieces.items():
        assert [(p.piece, p.start) for p in sorted(own, key=lambda p: p.piece)] == [(n, 2048 * n) for n in range(len(own))]
        assert sum(p.length for p in own) == len(ids[k])
    assert pieces.keys() == ids.keys()

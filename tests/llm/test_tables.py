"""Every operator on tables with nulls, empty and long texts, ties, repeated rows, clashing columns, and on empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import bpe, common, hilbert, langid, licenses, lm, media, neardup, packing, quality, registry, warc

DATA = "/root/testdata/sf0.001"
#: documents with further columns whose names the operators use themselves
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, score double, kept boolean, piece int, component_id long, rank int, n_words long"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
TEXTS = [
    (1, "One two three four five six seven. Released under the MIT License."), (2, None), (3, ""), (4, "   \n\t "), (5, "one two"), (6, LONG), (7, LONG), (8, "x" * 50_000), (9, "123 456 !!"),
    (10, "Èa ou le la de eau ré et un en que les."), (10, "Èa ou le la de eau ré et un en que les."), (None, "a row without an id has words too"), (11, "One two"), (12, "\x1c \x85 \xa0 İ ſ 日本 💡"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if k % 2 else None, None, 1, "a", 0.5, True, 1, 1, 1, 1) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def test_bpe(odd, none):
    rows = bpe.digests(odd).collect()
    assert len(rows) == len(TEXTS)
    want = Counter(hashlib.sha256((t or "").encode()).hexdigest() for _, t in TEXTS)
    assert Counter(r.decoded_sha256 for r in rows) == want and {r.n_tokens for r in rows if r.doc_id in (2, 3)} == {0}
    back = bpe.decode(bpe.encode(odd)).collect()
    assert Counter(bytes(r.bytes) for r in back) == Counter((t or "").encode() for _, t in TEXTS)
    assert not bpe.digests(none).count() and not bpe.encode(none).count()


def test_packing(odd, none):
    rows = packing.pack(odd).collect()
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert sum(r.piece == 0 for r in rows) == len(TEXTS) and {r.length for r in rows if r.doc_id == 2} == {1}
    assert not packing.pack(none).count()


def test_language(odd, none):
    model = langid.fit_table(odd)
    clashing = odd.withColumn("lang_pred", F.lit(1))
    rows = langid.predict(clashing, model).collect()
    assert len(rows) == len(TEXTS) and all((r.lang_pred == "und") == (r.doc_id in (2, 3, 4, 9)) for r in rows) and all(0 <= r.score <= 1 for r in rows)
    empty = langid.fit_table(none)
    assert {r.lang_pred for r in langid.predict(odd, empty).collect()} == {"und"}
    assert not langid.predict(none, model).count()


def test_quality(spark, odd, none):
    ratings = spark.createDataFrame([(1, 1), (8, 0), (None, 1), (6, None)], "doc_id long, quality int")
    model = quality.fit_table(odd, ratings)
    rows = quality.judge(odd, model).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        w = words(r.text)
        lines = [x for x in (r.text or "").split("\n") if words(x)]
        assert r.n_dup_lines == sum(x in lines[:k] for k, x in enumerate(lines))
        assert r.n_words == len(w) and r.word_chars == sum(map(len, w)) and r.n_symbols == len(re.findall(r"[#*$%&|<>]", r.text or ""))
        assert not (r.base_failed and r.kept)
    assert quality.fit_table(none, ratings) is None and not quality.judge(none.select("text"), model).count()


def test_media(odd, none):
    back = media.load(media.store(odd)).collect()
    assert Counter(bytes(r.payload) for r in back) == Counter(media.padded((t or "").encode()) for _, t in TEXTS)
    broken = odd.select("doc_id", F.encode("text", "UTF-8").alias("media"))
    assert {r.payload for r in media.load(broken).collect()} == {None}
    assert not media.digests(media.store(none)).count()
    torn = media.digests(broken.selectExpr("cast(doc_id AS long) AS doc_id", "0L AS n_bytes", "coalesce(media, X'00') AS media")).collect()
    assert {(r.payload_sha256, r.feature) for r in torn} == {(None, None)}


def test_sharding(odd, none):
    dims = {"source": hilbert.string_number(F.col("source")), "size": hilbert.size_number(F.length("text"))}
    rows = hilbert.shard_table(odd, dims, ["doc_id"], ["doc_id"]).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == len(TEXTS) and max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 8
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in sizes.items())
    assert not hilbert.shard_table(none, dims, ["doc_id"], ["doc_id"]).count()


def test_written_shards(spark, odd, tmp_path):
    dims = {"source": hilbert.string_number(F.col("source")), "size": hilbert.size_number(F.length("text"))}
    hilbert.write_shards(odd, dims, ["doc_id"], str(tmp_path / "odd"))
    back = spark.read.parquet(str(tmp_path / "odd"))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter(TEXTS)
    # Files of a shard span narrow ranges in all dimensions: a box of both is in few of them.
    grid = spark.range(4096).select(F.expr("id % 64").alias("x"), F.expr("id div 64").alias("y"))
    hilbert.write_shards(grid, {c: F.col(c) for c in ("x", "y")}, ["x", "y"], str(tmp_path / "grid"), shards=16)
    of = {r.shard: r for r in spark.read.parquet(str(tmp_path / "grid")).groupBy("shard").agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("a", F.min), ("b", F.max))]).collect()}
    hit = [r for r in of.values() if r.a_x <= 9 and r.b_x >= 2 and r.a_y <= 9 and r.b_y >= 2]
    assert len(of) == 16 and len(hit) <= 2


def brute_groups(docs, n, percent):
    sets = defaultdict(set)
    for i, t in docs:
        w = words(t)
        if w:
            sets[i] |= {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))}
    of = {i: i for i, _ in docs}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                of[max(x, y)] = min(x, y)
    return {i: find(i) for i in of}


def test_near_duplicates(spark, odd, none, monkeypatch):
    want = brute_groups([(i, t) for i, t in TEXTS if i is not None], 3, 85)
    rows = neardup.groups(odd).collect()
    assert len(rows) == len(TEXTS) and all(r.component_id == want.get(r.id) for r in rows)
    assert not neardup.groups(none).count()
    kept = neardup.deduplicate(odd).collect()
    assert Counter(r.doc_id for r in kept) == Counter([i for i in set(want.values())] + [None]) and set(kept[0].asDict()) == set(odd.columns)
    # A group of near copies of one text, some of which are only linked through others, by way of the blocks for long lists.
    monkeypatch.setattr(neardup, "LONG_LIST", 3)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    base = [f"v{i}" for i in range(60)]
    rows = []
    for i in range(40):
        own = list(base)
        for j in range(i % 5):
            own[(7 * i + 11 * j) % 60] = f"z{i}_{j}"
        rows.append((i, " ".join(own)))
    want = brute_groups(rows, 3, 85)
    got = {r.id: r.component_id for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_language_model(spark, odd, none, monkeypatch):
    monkeypatch.setattr(lm, "PART_ROWS", 50)
    model = lm.train(odd.where("doc_id <> 8"))
    tokens = [(i, [*words(t), "\n"]) for i, t in TEXTS]
    train = [w for i, w in tokens if i not in (8, None)]
    uni, pair = Counter(x for w in train for x in w), Counter(p for w in train for p in zip(["<s>", *w[:-1]], w, strict=True))
    before, n, v = Counter(b for _, b in pair), sum(uni.values()), len(uni)
    counts = lambda c: lm.discounts([sum(x == k for x in c.values()) for k in (1, 2, 3, 4)])
    d1, d2 = counts(before), counts(pair)
    left = sum(d1[min(x, 3)] for x in before.values()) / len(pair)
    context = defaultdict(Counter)
    for (a, b), c in pair.items():
        context[a][b] = c

    def p(a, b):
        low = max(before[b] - d1[min(before[b], 3)], 0) / len(pair) + left / (v + 1)
        if a not in context:
            return low
        own = context[a]
        total = sum(own.values())
        return max(own[b] - d2[min(own[b], 3)], 0) / total + sum(d2[min(x, 3)] for x in own.values()) / total * low

    rows = lm.score(odd, model).collect()
    want = Counter((i, len(w), round(sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w), 3), round(sum(math.log10(p(a, b)) for a, b in zip(["<s>", *w[:-1]], w, strict=True)), 3)) for i, w in tokens)
    assert Counter((r.doc_id, r.n_tokens, round(r.base_score, 3), round(r.score, 3)) for r in rows) == want
    empty = lm.train(none)
    assert {round(r.score, 9) for r in lm.score(odd, empty).collect()} == {0.0} and not lm.score(none, model).count()


def test_licenses(spark, odd, none):
    found = {(r.doc_id, r.license, r.start_word) for r in licenses.scan(odd).collect()}
    assert found == {(1, "mit-short", 7)}
    body = "filler words before. " * 30 + licenses.TEMPLATES["mit-permission"].replace("free of charge", "without any cost") + " and words after" * 9
    near = {r.license: r.containment for r in licenses.scan(spark.createDataFrame([(1, body), (1, body)], "doc_id long, text string")).collect()}
    assert set(near) == {"mit-permission"} and 0.8 <= near["mit-permission"] < 1
    assert not licenses.scan(none).count() and not licenses.scan(odd, templates={}).count()


def test_revisits(spark):
    schema = f"record_id long, warc_type string, url string, captured string, headers {warc.HEADERS}, payload_digest string, outcome string"
    rows = [
        (1, "response", "HTTP://www.A.com:80/x/?b=2&a=1&utm_source=q#f", "2024-01-01", [("ETag", '"v"'), ("X", "1"), ("Content-Length", "9")], "d1", "?"),
        (2, "revisit", "https://a.com/x?a=1&b=2", "2024-01-02", [("etag", 'W/"v"'), ("x", "2"), ("content-length", "0")], None, "?"),
        (3, "revisit", "a.com/x?a=1&b=2", "2024-01-02", None, None, "?"), (4, "revisit", "a.com/x?a=1&b=2", "2023-01-02", [("ETag", '"v"')], None, "?"),
        (5, "revisit", None, "2024-01-02", [("ETag", '"v"')], None, "?"), (6, "revisit", "a.com/x?a=1&b=2", None, [("ETag", '"v"')], None, "?"),
        (7, "revisit", "a.com/x?a=1&b=2", "2024-01-03", [("ETag", '"w"')], None, "?"), (7, "revisit", "a.com/x?a=1&b=2", "2024-01-03", [("ETag", '"w"')], None, "?"),
    ]
    df = spark.createDataFrame(rows, schema)
    got = warc.resolve(df).collect()
    assert sorted((r.record_id, r.outcome) for r in got) == [(1, "full"), (2, "resolved"), (3, "no_validator"), (4, "no_response"), (5, "no_response"), (6, "no_response"), (7, "mismatch"), (7, "mismatch")]
    two = next(r for r in got if r.record_id == 2)
    assert two.response_id == 1 and two.payload_digest == "d1" and sorted((h["name"], h["value"]) for h in two.headers) == [("Content-Length", "9"), ("etag", 'W/"v"'), ("x", "2")]
    assert not warc.resolve(df.where("false")).count()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = c.execute(registry.ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    assert sorted(str([r[k] for k in cols]) for r in df.collect()) == sorted(str([r[names.index(k)] for k in cols]) for r in got.fetchall())


def test_digest_columns(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in registry.QUERIES["op7_media"](spark, DATA).collect():
        raw = texts[r.doc_id].encode()
        assert (r.n_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), hashlib.sha256(media.padded(raw)).hexdigest(), zlib.crc32(media.padded(raw)[-16:]))
    held = [r for r in registry.QUERIES["op6_language_crf"](spark, DATA).collect() if r.held_out]
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    rows = registry.QUERIES["op8_hilbert_shards"](spark, DATA).collect()
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, DATA)
        assert after.columns == docs.columns, name
        kept = common.staged(after, name)
    good = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    left = {r.doc_id for r in kept.collect()}
    groups = brute_groups(list(texts.items()), 5, 80)
    lost = [i for i in good if len(words(texts[i])) >= 10 and not {j for j in left if groups[j] == groups[i]}]
    assert len(lost) <= 0.02 * len(good)
    assert {r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()} == left

"""Language identification of code-switched text with a linear-chain CRF (operator 6).

Every blank-separated word that has a letter is a position. Its features: the word, its first and last letters (affixes),
letter trigrams, and for each language whether its lexicon has the word. A word's scores for the languages are the sum
of its features' weights; the transitions between the languages of neighbouring words are learned. Forward-backward gives
each word's posterior; a text's language is the one with the largest mean posterior, and that mean is the score.

Fitting: a bounded sample (`per_label` texts of each language, chosen by a hash, one window of `window` words of each) of
the labelled rows goes to the driver; half of its sequences are spliced from several languages so that switches are seen.
Prediction reads the text alone.

Edge cases: a null text, and one without a letter, gets the language `und` and the score 0; so does every text where no
labelled row exists; words and texts of any length are read whole; repeated rows get equal results; ties go to the
language that sorts first; an empty table gives an empty table; columns of the input with the names of results are replaced; a row
without an id is held out or not as the empty text would be.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, crf

FEATURES = 1 << 16
UNKNOWN = "und"
MEMO_WORDS = 200_000


@dataclass
class LanguageModel:
    crf: crf.Model
    lexicon: dict[str, list[int]]  # word: the languages whose lexicon has it


def letters_of(word: str) -> str:
    """The lower-cased word without other characters at its ends; empty if it has no letter."""
    word = word.lower()
    if word.isalpha():
        return word
    if not any(map(str.isalpha, word)):
        return ""
    a, b = 0, len(word)
    while not word[a].isalpha():
        a += 1
    while not word[b - 1].isalpha():
        b -= 1
    return word[a:b]


def _mixed(*parts) -> np.ndarray:
    """A hash of equally long columns of small numbers."""
    h = np.array([0x243F6A8885A308D3], np.uint64)
    for x in parts:
        h = (h ^ np.asarray(x, np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h = h ^ (h >> np.uint64(29))
    return h


def features(words: list[str], lexicon: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, feature id, value) of all features of all words, sorted by word; a word's trigrams weigh as the root of their number together."""
    n = np.array(list(map(len, words)))
    text = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.cumsum(n + 2) - (n + 1)  # of a word's own letters
    index = np.arange(len(words))
    found = [(index, _mixed(0, np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words])), np.ones(len(words)))]
    for side, most in ((1, 3), (2, 4)):
        for k in range(1, most + 1):
            own = index[n >= k]
            at = first[own] if side == 1 else first[own] + n[own] - k
            found.append((own, _mixed(side, k, *[text[at + j] for j in range(k)]), np.ones(len(own))))
    start = np.repeat(first - 1, n)
    at = start + np.arange(len(start)) - np.repeat(np.cumsum(n) - n, n)
    found.append((np.repeat(index, n), _mixed(3, text[at], text[at + 1], text[at + 2]), np.repeat(n**-0.5, n)))
    known = [(i, k) for i, w in enumerate(words) for k in lexicon.get(w, ())]
    if known:
        pairs = np.array(known)
        found.append((pairs[:, 0], _mixed(4, pairs[:, 1]), np.ones(len(pairs))))
    row, ids, value = (np.concatenate([f[k] for f in found]) for k in range(3))
    order = np.argsort(row, kind="stable")
    return row[order], (ids[order] % np.uint64(FEATURES)).astype(np.int64), value[order]


def word_scores(words: list[str], lexicon: dict[str, list[int]], weights: np.ndarray) -> np.ndarray:
    """Each word's score for each language."""
    parts = []
    for i in range(0, len(words), 20_000):
        row, ids, value = features(words[i : i + 20_000], lexicon)
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        parts.append(np.add.reduceat(weights[ids] * value[:, None], starts, axis=0))
    return np.concatenate(parts) if parts else np.empty((0, weights.shape[1]))


def fit(windows: list[tuple[str, list[str]]], least: int = 3, seed: int = 7) -> LanguageModel:
    """windows: (language, words). A lexicon holds the words seen at least `least` times in a language's windows."""
    rng = np.random.default_rng(seed)
    cleaned = [(lang, [w for w in map(letters_of, words) if w]) for lang, words in sorted(windows)]
    cleaned = [(lang, words) for lang, words in cleaned if words]
    labels = sorted({lang for lang, _ in cleaned})
    place = {lang: k for k, lang in enumerate(labels)}
    counts = [Counter() for _ in labels]
    for lang, words in cleaned:
        counts[place[lang]].update(words)
    lexicon: dict[str, list[int]] = {}
    for k, own in enumerate(counts):
        for word, n in own.items():
            if n >= least:
                lexicon.setdefault(word, []).append(k)
    kinds: dict[str, int] = {}
    sequences = []
    for lang, words in cleaned:
        ids = np.array([kinds.setdefault(w, len(kinds)) for w in words])
        sequences.append((ids, np.full(len(ids), place[lang])))
    row, feature, value = features(list(kinds), lexicon) if kinds else (np.empty(0, int),) * 3
    cuts = np.searchsorted(row, np.arange(len(kinds) + 1))
    rows = [(feature[a:b], value[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    mixed = []
    for _ in range(len(sequences)):
        parts = [sequences[i] for i in rng.integers(0, len(sequences), rng.integers(2, 4))]
        cuts = [(p[0][a : a + n], p[1][a : a + n]) for p in parts for a, n in [(rng.integers(0, len(p[0])), rng.integers(4, 25))]]
        mixed.append((np.concatenate([c[0] for c in cuts]), np.concatenate([c[1] for c in cuts])))
    return LanguageModel(crf.train(rows, sequences + mixed, FEATURES, labels, epochs=4, seed=seed), lexicon)


def sample(df: DataFrame, text: str, label: str, key: str, per_label: int, window: int) -> list[tuple[str, list[str]]]:
    """One window of words from at most `per_label` rows of each label, chosen by a hash of the key."""
    rows = df.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).alias("_label"), F.col(text).alias("_text"), F.xxhash64(F.lit("sample"), F.col(key)).alias("_hash"))
    counts = {r["_label"]: r["count"] for r in df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("_label")).count().collect()}
    if not counts:
        return []
    span = 1 << 30
    share = F.coalesce(*[F.when(F.col("_label") == F.lit(k), F.lit(min(span, 1 + span * 2 * per_label // n))) for k, n in sorted(counts.items())])
    near = rows.where(F.pmod("_hash", F.lit(span)) < share)  # about twice as many as needed, however large the table
    best = near.withColumn("_nth", F.row_number().over(W.partitionBy("_label").orderBy("_hash", F.xxhash64("_text")))).where(F.col("_nth") <= per_label)
    words = F.split(F.trim("_text"), r"\s+")
    start = F.pmod(F.shiftright("_hash", 30), F.greatest(F.size("_words") - window + 1, F.lit(1))).cast("int") + 1
    picked = best.withColumn("_words", words).select("_label", F.slice("_words", start, window).alias("_words"), "_hash").orderBy("_label", "_hash")
    return [(r["_label"], r["_words"]) for r in picked.collect()]  # labels x per_label x window words at most


def fit_table(df: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", per_label: int = 1500, window: int = 50) -> LanguageModel:
    return fit(sample(df, text, label, key, per_label, window))


def predict(df: DataFrame, model: LanguageModel, text: str = "text", pred: str = "lang_pred", score: str = "score", sure: str | None = None) -> DataFrame:
    """The frame with two more columns: language and score of each whole text; and, if named, how sure its words are.

    The score is the mean posterior of the text's best language; a word is as sure as its own best language, whichever it is.
    """
    df = df.drop(pred, score, *([sure] if sure else []))
    share = df.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", `{pred}` string, `{score}` double" + (f", `{sure}` double" if sure else "")

    def make():
        own = share.value
        labels, lexicon = own.crf.labels, own.lexicon
        weights, k = own.crf.weights.astype(np.float64), len(own.crf.labels)
        by_raw: dict[str, int] = {}  # row of the table, or -1 for words without letters
        by_word: dict[str, int] = {}
        table = np.empty((0, k))

        def learn(raw: set[str]) -> None:
            nonlocal table
            if len(by_raw) + len(raw) > MEMO_WORDS:
                by_raw.clear()
                by_word.clear()
                table = np.empty((0, k))
            fresh: list[str] = []
            for r in raw:
                word = letters_of(r)
                place = by_word.get(word, -1) if word else -1
                if word and place < 0:
                    place = by_word[word] = len(by_word)
                    fresh.append(word)
                by_raw[r] = place
            if fresh:
                table = np.concatenate([table, word_scores(fresh, lexicon, weights)])

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(text).to_pylist()
            split = [(t or "").split() for t in texts]
            seen: set[str] = set().union(*split)
            new = seen - by_raw.keys()
            if len(by_raw) + len(new) > MEMO_WORDS:
                new = seen  # everything is forgotten first
            learn(new)
            get = by_raw.__getitem__
            ids = [np.fromiter(map(get, words), np.int64, len(words)) for words in split]
            ids = [x[x >= 0] for x in ids]
            lengths = np.array([len(x) for x in ids], np.int64)
            some = np.flatnonzero(lengths)
            names, scores, certain = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.zeros(len(texts))
            if len(some) and k:
                p = crf.marginals(table[np.concatenate([ids[i] for i in some])], lengths[some], own.crf.trans, own.crf.start)
                first = np.cumsum(lengths[some]) - lengths[some]
                mean = np.add.reduceat(p, first, axis=0) / lengths[some][:, None]
                best = mean.argmax(axis=1)
                names[some] = np.array(labels, object)[best]
                scores[some] = np.minimum(mean[np.arange(len(some)), best], 1.0)
                if sure:
                    certain[some] = np.minimum(np.add.reduceat(p.max(axis=1), first) / lengths[some], 1.0)
            out = {pred: pa.array(names, pa.string()), score: pa.array(scores)} | ({sure: pa.array(certain)} if sure else {})
            return pa.RecordBatch.from_arrays([*batch.columns, *out.values()], [*batch.schema.names, *out])

        return work

    return common.map_slices(df, make, schema, text, common.SLICE_BYTES * 4 // max(4, len(model.crf.labels)))


def fold(key: Column, of: int) -> Column:
    """crc32 of the key as text, modulo; null keys count as the empty text."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % of


def op6_language_crf(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    held = fold(F.col("doc_id"), 4) == 2
    model = fit_table(docs.where(~held))
    return predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")

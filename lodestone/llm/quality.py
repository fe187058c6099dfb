"""Line labelling for quality (operator 9): a linear-chain CRF marks each line of a text as content or boilerplate.

Counts over the whole text come first (words, symbols, repeated lines, words inside repeated five-word windows) and
decide `base_failed`. A line with a word is a position; its features are bins of simple line statistics (symbols, capitals,
separators, repeated words, whether the line repeats an earlier one, length, ending); transitions say how content and
boilerplate follow each other. Viterbi decoding gives the best labelling, and the share of words in content lines decides
whether a text is kept.

Fitting: lines of a bounded sample of rated documents (`per_label` documents of either rating, chosen by a hash, all lines
of each up to `lines`, at evenly spread places) go to the driver. A rating holds for a whole document, so lines take it over
at first; a second round relabels the lines of bad documents which the first model finds to be content.

Edge cases: a null text has no words and fails the base test; an empty text too; blank lines are no positions; without
rated documents of both kinds the base test alone decides; lines and texts of any length are read whole; repeated rows
get equal results; an empty table gives an empty table; columns of the input with the names of results are replaced; a
rating without an id is no rating.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, crf

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS, MOST_REPEATED = 10, 20
#: Share of words in content lines from which a text is kept.
KEEP_SHARE = 0.5
LABELS = ["content", "boilerplate"]
#: Steps of a ratio that get a feature of their own.
RATIO_STEPS = np.array([0.0, 0.01, 0.03, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])
COUNT_STEPS = np.array([1, 2, 3, 5, 9, 17, 33, 65, 129, 257])
STATISTICS = ("symbols", "capitals", "digits", "separators", "marks", "repeats", "words", "mean_length", "duplicate", "ending", "opening")
FEATURES = 16 * len(STATISTICS)


def words_of(text: str) -> list[str]:
    """Matches of WORD; splitting on the same six characters is the same and faster for texts without other white space."""
    return WORD.findall(text)


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside a window that occurs at least twice; ids: one number for each different word."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        x = ids[k : k + n].astype(np.uint64) + np.uint64(1)
        mixed = (mixed ^ x) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    equal = mixed[order][1:] == mixed[order][:-1]
    if not equal.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def line_statistics(line: str, words: list[str], seen: bool) -> tuple[float, ...]:
    n = max(1, len(line))
    letters = sum(map(str.isalpha, line)) or 1
    last = line.rstrip(SPACE)[-1]
    return (
        sum(map(line.count, SYMBOLS)) / n,
        sum(map(str.isupper, line)) / letters,
        sum(map(str.isdigit, line)) / n,
        line.count("|") / len(words),
        line.count("!") / len(words),
        1 - len(set(words)) / len(words),
        len(words),
        sum(map(len, words)) / len(words),
        float(seen),
        0.0 if last.isalnum() else 1.0 if last in ".?!\"'”»" else 2.0,
        0.0 if words[0][0].isupper() else 1.0,
    )


def bins(statistics: np.ndarray) -> np.ndarray:
    """Feature ids, one for each statistic of each line."""
    out = np.empty(statistics.shape, np.int64)
    for k, name in enumerate(STATISTICS):
        x = statistics[:, k]
        if name in ("words", "mean_length"):
            step = np.searchsorted(COUNT_STEPS, x, side="right")
        elif name in ("duplicate", "ending", "opening"):
            step = x.astype(np.int64)
        else:
            step = np.searchsorted(RATIO_STEPS, x, side="left")
        out[:, k] = 16 * k + step
    return out


def lines_of(text: str) -> tuple[list[tuple[str, list[str], bool]], int]:
    """Lines with a word, their words and whether they repeat an earlier line; the number of such repeats."""
    earlier: set[str] = set()
    found = []
    repeats = 0
    for line in text.split("\n"):
        words = WORD.findall(line)
        if words:
            seen = line in earlier
            repeats += seen
            earlier.add(line)
            found.append((line, words, seen))
    return found, repeats


def sampled_bins(text: str, lines: int = 200) -> np.ndarray:
    """Binned statistics of a text's lines, or of `lines` of them that lie evenly in it."""
    found, _ = lines_of(text)
    if len(found) > lines:
        found = [found[i] for i in np.linspace(0, len(found) - 1, lines).astype(int)]
    return bins(np.array([line_statistics(*x) for x in found])) if found else np.empty((0, 0), np.int64)


def fit(documents: list[tuple[int, str]], seed: int = 7) -> crf.Model | None:
    """documents: (1 for good or 0 for bad, text). None unless both kinds occur."""
    return fit_bins([(quality, sampled_bins(text)) for quality, text in sorted(documents)], seed)


def fit_bins(documents: list[tuple[int, np.ndarray]], seed: int = 7) -> crf.Model | None:
    """fit() on the sampled_bins() of the texts, in the order of ratings and texts."""
    rows: dict[tuple[int, ...], int] = {}
    sequences, good = [], []
    for quality, ids in documents:
        if not len(ids):
            continue
        kinds = np.array([rows.setdefault(tuple(r), len(rows)) for r in ids.tolist()])
        sequences.append((kinds, np.full(len(kinds), 0 if quality else 1)))
        good.append(bool(quality))
    if all(good) or not any(good):
        return None
    kinds = [(np.array(r), np.ones(len(r))) for r in rows]
    first = crf.train(kinds, sequences, FEATURES, LABELS, seed=seed)
    table = np.stack([first.weights[r].sum(axis=0) for r, _ in kinds])
    relabelled = [(s, y if g else crf.viterbi(table[s], np.array([len(s)]), first.trans, first.start)) for (s, y), g in zip(sequences, good, strict=True)]
    return crf.train(kinds, relabelled, FEATURES, LABELS, seed=seed)


def fit_table(docs: DataFrame, ratings: DataFrame, text: str = "text", key: str = "doc_id", rating: str = "quality", per_label: int = 1500) -> crf.Model | None:
    """Fit on at most `per_label` documents of either rating. Their lines are sampled and measured where they are; the driver gets numbers only."""
    common.ship(docs.sparkSession)
    rated = ratings.where(F.col(rating).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_key"), F.col(rating).cast("int").alias("_rating"))
    counts = {r["_rating"]: r["count"] for r in rated.groupBy("_rating").count().collect()}
    if len(counts) < 2:
        return None
    span = 1 << 30
    share = F.coalesce(*[F.when(F.col("_rating") == k, F.lit(min(span, 1 + span * 2 * per_label // n))) for k, n in sorted(counts.items())])
    hashed = rated.withColumn("_hash", F.xxhash64(F.lit("rated"), F.col("_key"))).where(F.pmod("_hash", F.lit(span)) < share)
    nth = F.row_number().over(W.partitionBy("_rating").orderBy("_hash", "_key"))
    chosen = hashed.withColumn("_nth", nth).where(F.col("_nth") <= per_label).groupBy("_key").agg(F.min("_rating").alias("_rating"))
    texts = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    found = texts.join(F.broadcast(chosen), "_key").groupBy("_key").agg(F.min("_rating").alias("_rating"), F.min("_text").alias("_text"))  # chosen: 2 * per_label rows at most

    def run(batches):
        for piece in common.slices(batches, "_text"):
            made = [sampled_bins(t) for t in piece.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column("_rating"), pa.array([m.shape[1] for m in made], pa.int32()), pa.array([m.astype("<i4").tobytes() for m in made], pa.binary())], ["rating", "width", "bins"])

    rows = found.orderBy("_rating", "_text", "_key").select("_rating", "_text").mapInArrow(run, "rating int, width int, bins binary").collect()  # per_label * 2 at most, 200 lines each
    return fit_bins([(r["rating"], np.frombuffer(r["bins"], "<i4").reshape(-1, max(1, r["width"]))) for r in rows])


RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"

RESULT_NAMES = [x.split()[0] for x in RESULT.split(", ")]


def judge(df: DataFrame, model: crf.Model | None, text: str = "text", keep_share: float = KEEP_SHARE) -> DataFrame:
    """The frame with the counts, content_share and kept for each whole text."""
    df = df.drop(*RESULT_NAMES)
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", " + RESULT
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, lengths, statistics, sizes, some = [], [], [], [], []
            for i, t in enumerate(batch.column(text).to_pylist()):
                t = t or ""
                found, duplicates = lines_of(t)
                number: dict[str, int] = {}
                ids = np.fromiter((number.setdefault(w, len(number)) for _, words, _ in found for w in words), np.int64)
                n, repeats = len(ids), repeated_words(ids)
                symbols = sum(map(t.count, SYMBOLS))
                chars = len(t) - sum(map(t.count, SPACE))
                failed = n < MIN_WORDS or 100 * repeats > MOST_REPEATED * n
                rows.append([n, chars, symbols, duplicates, repeats, failed, 1.0 if n else 0.0, not failed])
                if found and model is not None:
                    some.append(i)
                    lengths.append(len(found))
                    statistics += [line_statistics(*x) for x in found]
                    sizes += [len(x[1]) for x in found]
            if some:
                scores = model.weights[bins(np.array(statistics))].sum(axis=1, dtype=np.float64)
                n = np.array(lengths)
                content = crf.viterbi(scores, n, model.trans, model.start) == 0
                size = np.array(sizes)
                first = np.cumsum(n) - n
                shares = np.add.reduceat(size * content, first) / np.add.reduceat(size, first)
                for i, share in zip(some, shares.tolist(), strict=True):
                    rows[i][6] = share
                    rows[i][7] = rows[i][7] and share >= keep_share
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*batch.schema.names, *RESULT_NAMES])

        return work

    return common.map_slices(df, make, schema, text)


def op9_line_quality(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = fit_table(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = judge(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")

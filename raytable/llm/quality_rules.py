"""Quality rules: an isolation forest over rule statistics, its threshold calibrated from labelled rows.

``rule_statistics`` counts in one pass over whole texts; nothing is shuffled. The forest is fitted on a bounded
sample of labelled rows (``SAMPLE_ROWS``, an isolation forest is defined on small subsamples), travels to the tasks as
a closure of fixed size and scores every document. The threshold comes from a histogram of scores over all labelled rows.

Defined cases: null, empty and word-less texts have zero counts and fail the base rules. Without usable labels (none,
or only one class) the threshold is infinite and the base rules alone decide. Repeated rows are scored one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_memos, id_text, numbered, once, pair_names, prepare, text_chunks, utf8

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED = (20, 100)  # more than 20 of 100 words in repeated windows fail
#: Feature and the largest value told apart; each grows with one kind of defect.
FEATURES = {"symbols_per_word": 3.0, "duplicate_lines": 1.0, "repeated_words": 1.0, "upper_share": 1.0, "marks_per_word": 3.0, "odd_word_length": 10.0}

SAMPLE_ROWS = 4096  # labelled rows the forest is fitted on, at most
TREES = 100
TREE_ROWS = 256
DEPTH = 12
BINS = 2000  # score histogram
CLEAN_LOSS = 0.005  # share of good labelled rows the threshold may reject, at most

STATISTICS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, "
              "n_marks long, n_letters long, n_lines long")


_TAIL = bytes(range(0x80, 0xC0))  # bytes after the first of a code point
_NOT_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_NOT_MARK = bytes(b for b in range(256) if b not in b"!?|")
_NOT_LETTER = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122 or b >= 0xC0))
_SPACE_OR_TAIL = b" \t\n\r\x0b\x0c" + _TAIL


def _repeated_words(flat: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Words per row that lie in a WINDOW-word window found twice or more in the row."""
    n, rows = len(flat), len(borders) - 1
    row = np.repeat(np.arange(rows), np.diff(borders))
    starts = np.arange(max(0, n - WINDOW + 1))
    starts = starts[starts + WINDOW <= borders[row[starts] + 1]] if n else starts
    if not len(starts):
        return np.zeros(rows, np.int64)
    two = pair_names(flat[:-1], flat[1:])
    four = pair_names(two[starts], two[starts + 2])
    name = pair_names(pair_names(four, flat[starts + 4]), row[starts])
    hit = starts[np.bincount(name)[name] > 1]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + WINDOW, -1)
    return np.bincount(row[np.cumsum(cover[:-1]) > 0], minlength=rows)


def count_statistics(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Rule statistics of each text; words are maximal runs without ASCII white space."""
    out = {c.split()[0]: np.zeros(len(texts), np.int64) for c in STATISTICS.split(", ")}
    for a, b in text_chunks(texts):
        words = [t.split() for t in texts[a:b]]
        flat, borders = numbered(words)
        out["n_words"][a:b] = np.diff(borders)
        out["n_repeat_words"][a:b] = _repeated_words(flat, borders)
        for i, t in enumerate(texts[a:b], a):
            out["word_chars"][i] = len(t.translate(None, _SPACE_OR_TAIL))
            out["n_symbols"][i] = len(t.translate(None, _NOT_SYMBOL))
            out["n_upper"][i] = len(t.translate(None, _NOT_UPPER))
            out["n_marks"][i] = len(t.translate(None, _NOT_MARK))
            out["n_letters"][i] = len(t.translate(None, _NOT_LETTER))
            lines = [x for x in t.split(b"\n") if x.split()]
            out["n_lines"][i] = len(lines)
            out["n_dup_lines"][i] = len(lines) - len(set(lines))
    return out


def _count(text: pa.Array) -> pa.Array:
    drop_memos()
    counts = count_statistics(utf8(text))
    return pa.StructArray.from_arrays([pa.array(v) for v in counts.values()], list(counts))


def rule_statistics(text: Column) -> Column:
    """Struct of rule statistics of a text column."""
    return once(_count, f"struct<{STATISTICS.replace(', ', ',').replace(' ', ':')}>")(text)


def base_failed(s: Column) -> Column:
    """Too short, or too much of the text lies in repeated windows."""
    most, of = MAX_REPEATED
    return (s["n_words"] < MIN_WORDS) | (of * s["n_repeat_words"] > most * s["n_words"])


def _features(s) -> np.ndarray:
    """Feature matrix, scaled to 0..1, from a mapping of statistic columns."""
    words = np.maximum(np.asarray(s["n_words"], float), 1)
    letters = np.maximum(np.asarray(s["n_letters"], float), 1)
    mean = np.asarray(s["word_chars"], float) / words
    columns = np.column_stack([
        np.asarray(s["n_symbols"], float) / words,
        np.asarray(s["n_dup_lines"], float) / np.maximum(np.asarray(s["n_lines"], float), 1),
        np.asarray(s["n_repeat_words"], float) / words,
        np.maximum(np.asarray(s["n_upper"], float) / letters - 0.1, 0),
        np.asarray(s["n_marks"], float) / words,
        np.maximum(np.abs(mean - 7) - 5, 0),
    ])
    return np.minimum(columns / np.array(list(FEATURES.values())), 1.0)


class IsolationForest:
    """Random axis-parallel splits over small subsamples; short paths mark anomalies.

    A split is drawn from the box of its node, not from the spread of the rows in it: where good documents leave a
    part of the box empty (most have no symbols at all), a document there ends in an empty leaf after a few splits.
    """

    def __init__(self, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, depth: int = DEPTH, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.size, self.depth = max(1, min(tree_rows, len(rows))), depth
        self.trees = [self._grow(rows[rng.choice(len(rows), self.size, replace=False)], rng) for _ in range(trees)]

    def _grow(self, rows: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        """Arrays by node: split feature (-1 at a leaf), split value, left child (the right one follows), path length of a leaf."""
        feature, value, left, path = [-1], [0.0], [0], [0.0]
        todo = [(0, rows, np.zeros(rows.shape[1]), np.ones(rows.shape[1]), 0)]
        while todo:
            node, part, low, high, depth = todo.pop()
            if len(part) < 2 or depth == self.depth:
                path[node] = depth + _expected(len(part))
                continue
            f = int(rng.integers(rows.shape[1]))
            v = rng.uniform(low[f], high[f])
            feature[node], value[node], left[node] = f, v, len(feature)
            upper, lower = high.copy(), low.copy()
            upper[f] = lower[f] = v
            is_low = part[:, f] <= v
            for side, box in ((part[is_low], (low, upper)), (part[~is_low], (lower, high))):
                todo.append((len(feature), side, *box, depth + 1))
                for column, empty in ((feature, -1), (value, 0.0), (left, 0), (path, 0.0)):
                    column.append(empty)
        return np.array(feature), np.array(value), np.array(left), np.array(path)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1]: near 1 for the shortest paths."""
        total, at = np.zeros(len(rows)), np.arange(len(rows))
        for feature, value, left, path in self.trees:
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                right = rows[at, np.maximum(f, 0)] > value[node]
                node = np.where(f >= 0, left[node] + right, node)
            total += path[node]
        return 2.0 ** (-total / len(self.trees) / max(_expected(self.size), 1.0))


def _expected(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _scorer(forest: IsolationForest):
    @F.arrow_udf("double")
    def anomaly(stats: pa.Array) -> pa.Array:
        names = [c.split()[0] for c in STATISTICS.split(", ")]
        return pa.array(forest.score(_features({c: stats.field(c).to_numpy(zero_copy_only=False) for c in names})))

    return anomaly


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and rule statistics of every document, from one pass over the texts; written once, as fit and verdict both read it."""
    return id_text(docs).select("doc_id", rule_statistics(F.col("text")).alias("_s")).select("doc_id", "_s.*").checkpoint(eager=True)


def fit(stats: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, clean_loss: float = CLEAN_LOSS):
    """(forest, threshold). The forest sees good labelled documents that pass the base rules, so short paths mean "unlike good ones";
    the score histogram covers all labelled documents that pass them."""
    marked = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    rows = stats.join(marked, "doc_id").filter(~base_failed_columns()).checkpoint(eager=True)
    good = rows.filter("quality > 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).toPandas()
    if not len(good):
        return None, float("inf")
    forest = IsolationForest(_features(good))
    names = [c.split()[0] for c in STATISTICS.split(", ")]
    scored = rows.select("quality", F.least(F.lit(BINS - 1), F.floor(_scorer(forest)(F.struct(*names)) * BINS)).alias("bin"))
    counts = scored.groupBy("bin").agg(F.sum(F.when(F.col("quality") > 0, 1).otherwise(0)).alias("good"), F.count(F.lit(1)).alias("n")).collect()
    return forest, _threshold(counts, clean_loss)


def base_failed_columns() -> Column:
    return base_failed({c: F.col(c) for c in ("n_words", "n_repeat_words")})


def _threshold(counts, clean_loss: float) -> float:
    """Score from which documents go: the best balanced accuracy among those that lose few good rows."""
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for r in counts:
        good[int(r["bin"])], bad[int(r["bin"])] = r["good"], r["n"] - r["good"]
    if not good.sum() or not bad.sum():
        return float("inf")
    lost = good[::-1].cumsum()[::-1] / good.sum()
    caught = bad[::-1].cumsum()[::-1] / bad.sum()
    gain = np.where(lost <= clean_loss, caught - lost, -1)
    best = np.flatnonzero(gain == gain.max())
    return float((best[0] + best[-1]) // 2) / BINS  # the middle of a gap without rows


def _anomaly(forest: IsolationForest | None, s: Column) -> Column:
    return _scorer(forest)(s) if forest else F.lit(0.0)


def _keeper(forest: IsolationForest | None, threshold: float):
    """Column function: statistics, base rules and forest in one pass, so a task needs one Python worker."""

    def keep(text: pa.Array) -> pa.Array:
        drop_memos()
        s = count_statistics(utf8(text))
        most, of = MAX_REPEATED
        ok = (s["n_words"] >= MIN_WORDS) & (of * s["n_repeat_words"] <= most * s["n_words"])
        if forest and ok.any():
            ok[ok] = forest.score(_features({c: v[ok] for c, v in s.items()})) < threshold
        return pa.array(ok)

    return once(keep, "boolean")


def keep_good(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that pass base rules and forest, with their columns as they were. Statistics are computed again in the
    filtering pass: cheaper than sending every text through a join with its verdict."""
    prepare(docs.sparkSession)
    forest, threshold = fit(statistics(docs), labels, sample_rows)
    return docs.filter(_keeper(forest, threshold)(F.col("text").cast("string")))


def report(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: base statistics and verdict."""
    prepare(docs.sparkSession)
    stats = statistics(docs)
    names = [c.split()[0] for c in STATISTICS.split(", ")]
    forest, threshold = fit(stats, labels, sample_rows)
    out = stats.withColumn("anomaly", _anomaly(forest, F.struct(*names))).withColumn("base_failed", base_failed_columns())
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & (F.col("anomaly") < threshold)).alias("kept"), "anomaly")

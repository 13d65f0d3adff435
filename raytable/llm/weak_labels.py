"""Quality classifier: a weak-label model whose posterior labels train a hashed linear scorer.

Two heads share the method, one for low quality and one for insults. Each has overlapping heuristic labellers that vote
"bad" or not for every document. Expectation-maximisation over the counts of vote patterns (at most 2**labellers rows,
whatever the corpus) estimates the prior and, for each labeller, how often it fires on bad and on other documents. The posterior
of a document's pattern is its soft label. A logistic scorer on hashed features learns them from a bounded sample
(``SAMPLE_DOCS``, dealt by vote pattern so that rare patterns are present, weighted back to the corpus) and scores every document;
it generalises to documents on which labellers are silent.

The fixed insult lists are English. For other languages two more labellers count words with learnt beginnings: those that are
much more frequent in texts labelled toxic than in the others, in a sample of at most ``LABEL_DOCS`` labelled documents, half of
each class. Without ``labels`` only the English lists vote.

Votes and scores are maps over whole texts; only pattern counts, the samples and the weights pass the driver. Defined cases:
null, empty and word-less texts are low quality with score 1 and no insult; an empty table gives no rows; when no labeller ever
fires, or all documents look alike, the posterior is the vote pattern's own and the scorer constant; repeated rows are judged
one by one; other columns take no part. Labels that are null, or of documents that are not there, teach nothing.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, named, once, prepare, text_chunks, utf8

SAMPLE_DOCS = 4000
LABEL_DOCS = 4000
#: Learnt beginnings: bytes of length, how many, toxic texts they must stand in, how much more frequent there than elsewhere.
BEGIN, BEGINNINGS, BEGIN_DOCS, BEGIN_RATIO = range(3, 10), 64, 4, 8.0
SAME_TEXT = 5  # a beginning counts at most so often in one text
BUCKETS = 1 << 16
VOTE = 3.0  # value of a learnt vote as a feature
SEEN = 4  # buckets seen in fewer sample documents have no weight
ROUNDS, EM_ROUNDS = 200, 200

_UPPER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_CLASSES = bytes(97 if 97 <= b <= 122 or b >= 0x80 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 35 if b in b"#*$%&|<>" else 46 for b in range(256))
_SAME = re.compile(rb"(.)\1+", re.DOTALL)
_EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_EDGES = _EDGE.decode() + "¡¿«»‹›„“”‚‘’…–—"
# Everyday English insults, in three overlapping lists.
INSULTS = [
    set(b"idiot moron stupid imbecile dumb fool loser clown jerk".split()),
    set(b"trash garbage scum filth worthless loser clown pathetic".split()),
    set(b"disgusting pathetic stupid worthless moron vile hateful scum idiot trash".split()),
]
_INSULT = set().union(*INSULTS)
QUALITY = ["symbols", "marks", "capitals", "same_word", "few_distinct", "same_lines", "too_short", "odd_words"]
TOXIC = ["insult_1", "insult_2", "insult_3", "insults", "learnt_share", "learnt_words"]


def _shape(word: bytes) -> bytes:
    """Run-compressed classes of characters: a letter, A capital, 0 digit, # symbol, . other mark."""
    classes = word.translate(_CLASSES)
    return _SAME.sub(rb"\1", classes)[:8] if classes.strip(b"a") else classes[:1]


class Batch:
    """Word arrays of some texts: numbers, row of each word, and per distinct word its shape and its bare lower-case form."""

    def __init__(self, texts: list[bytes]):
        rows = [t.split() for t in texts]
        self.flat, borders, self.distinct = named(rows)
        self.n = np.diff(borders)
        self.row = np.repeat(np.arange(len(texts)), self.n)
        self.shape, _, self.shapes = named([list(map(_shape, self.distinct))])  # number per distinct word, and the few shapes
        self.bare = [w.translate(_UPPER).strip(_EDGE) if w.isascii() else w.decode("utf-8", "replace").lower().strip(_EDGES).encode() for w in self.distinct]

    def rate(self, per_word: np.ndarray) -> np.ndarray:
        """Mean over the words of each row of a value per distinct word."""
        return np.bincount(self.row, per_word[self.flat], len(self.n)) / np.maximum(self.n, 1)

    def distinct_share(self) -> np.ndarray:
        pairs = np.unique(self.row * (len(self.distinct) + 1) + self.flat)
        return np.bincount(pairs // (len(self.distinct) + 1), minlength=len(self.n)) / np.maximum(self.n, 1)

    def same_as_last(self) -> np.ndarray:
        same = np.concatenate([[False], (self.flat[1:] == self.flat[:-1]) & (self.row[1:] == self.row[:-1])]) if len(self.flat) else np.zeros(0, bool)
        return np.bincount(self.row, same, len(self.n)) / np.maximum(self.n, 1)


class Lexicon(NamedTuple):
    """Learnt beginnings of insults, and the share of words from which on they count."""

    beginnings: tuple[bytes, ...] = ()
    share: float = 1.0

    def hits(self, b: Batch) -> np.ndarray:
        """Per distinct word, whether it has a learnt beginning."""
        return np.fromiter((w.startswith(self.beginnings) for w in b.bare), bool, len(b.bare)) if self.beginnings else np.zeros(len(b.bare), bool)

    def counts(self, b: Batch) -> tuple[np.ndarray, np.ndarray]:
        """Per row: words with a learnt beginning, and distinct ones."""
        live = self.hits(b)[b.flat] if len(b.flat) else np.zeros(0, bool)
        row, flat = b.row[live], b.flat[live]
        pairs = np.unique(row * (len(b.distinct) + 1) + flat)
        return np.bincount(row, minlength=len(b.n)), np.bincount(pairs // (len(b.distinct) + 1), minlength=len(b.n))

    def fires(self, b: Batch) -> list[np.ndarray]:
        words, distinct = self.counts(b)
        enough = (words > 0) & (words >= self.share * b.n)
        return [enough, enough & (distinct > 1)]


def learn(texts: list[bytes], toxic: np.ndarray, weight: np.ndarray) -> Lexicon:
    """Beginnings that tell labelled toxic texts from the others; ``weight`` is what a text stands for."""
    b = Batch(texts)
    size = [b.n[toxic].sum(), b.n[~toxic].sum()]
    if not min(size):
        return Lexicon()
    found = {}
    for k in BEGIN:
        ids: dict[bytes, int] = {}
        of = np.fromiter((ids.setdefault(w[:k], len(ids)) if len(w) >= k else -1 for w in b.bare), np.int64, len(b.bare))[b.flat]
        key, count = np.unique((b.row * (len(ids) + 1) + of)[of >= 0], return_counts=True)
        row, at = key // (len(ids) + 1), key % (len(ids) + 1)
        count, rude = np.minimum(count, SAME_TEXT), toxic[row]
        docs = np.bincount(at[rude], minlength=len(ids))
        here, there = (np.bincount(at[m], count[m], len(ids)) for m in (rude, ~rude))
        ratio = (here + 0.5) / size[0] / ((there + 0.5) / size[1])
        names = list(ids)
        for i in np.flatnonzero((docs >= BEGIN_DOCS) & (ratio >= BEGIN_RATIO)).tolist():
            found[names[i]] = here[i] * np.log(ratio[i])
    chosen: list[bytes] = []
    for w in sorted(found, key=lambda w: (-found[w], len(w), w)):
        if len(chosen) < BEGINNINGS and not any(w.startswith(c) or c.startswith(w) for c in chosen):
            chosen.append(w)
    if not chosen:
        return Lexicon()
    lexicon = Lexicon(tuple(chosen))
    share = lexicon.counts(b)[0] / np.maximum(b.n, 1)
    order = np.argsort(-share, kind="stable")
    order = order[share[order] > 0]
    right, wrong = np.cumsum(weight[order] * toxic[order]), np.cumsum(weight[order] * ~toxic[order])
    last = np.append(share[order][1:] != share[order][:-1], True)
    f1 = np.where(last, 2 * right / (right + wrong + weight[toxic].sum()), 0)
    return lexicon._replace(share=float(share[order][f1.argmax()]))


def votes(texts: list[bytes], lexicon: Lexicon = Lexicon()) -> tuple[np.ndarray, np.ndarray]:
    """Vote patterns as bit masks: (quality, toxic)."""
    b = Batch(texts)
    array = lambda f: np.fromiter(map(f, b.shapes), float, len(b.shapes))[b.shape]
    length = np.fromiter((len(w) - sum(0x80 <= c < 0xC0 for c in w) if not w.isascii() else len(w) for w in b.distinct), float, len(b.distinct))
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    repeated = np.array([1 - len(set(x)) / len(x) if x else 0.0 for x in lines])
    long_enough = b.n >= 30
    fires = [
        b.rate(array(lambda s: 35 in s)) > 0.2,
        b.rate(array(lambda s: len(s) > 1 and s[-1] in (35, 46) or s == b"#")) > 0.6,
        b.rate(array(lambda s: s[:2] in (b"A", b"A.", b"Aa") and s != b"Aa")) > 0.4,
        b.same_as_last() > 0.2,
        (b.distinct_share() < 0.3) & long_enough & (b.n < 3000),
        (repeated > 0.3),
        b.n < 3,
        (np.abs(b.rate(length) - 6.5) > 2.2) & long_enough,
    ]
    quality = sum(f.astype(np.int64) << k for k, f in enumerate(fires))
    listed = [k for k, w in enumerate(b.bare) if w in _INSULT]
    kinds = np.zeros((len(INSULTS), len(b.bare)))
    for k in listed:
        kinds[:, k] = [b.bare[k] in s for s in INSULTS]
    any_ = np.maximum.reduce(kinds) if b.bare else np.zeros(0)
    counts = [np.bincount(b.row, k[b.flat], len(b.n)) for k in [*kinds, any_]]
    rude = [c >= (2 if k == 3 else 1) for k, c in enumerate(counts)] + lexicon.fires(b)
    toxic = sum(f.astype(np.int64) << k for k, f in enumerate(rude))
    return quality, toxic


class LabelModel:
    """Two classes, labellers independent given the class; posterior probability of "bad" for every vote pattern."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, labellers: int):
        fire = (patterns[:, None] >> np.arange(labellers)) & 1
        weight = counts / counts.sum()
        bad = np.where(fire.any(1), 0.9, 0.05)  # start: whoever is accused
        for _ in range(EM_ROUNDS):
            prior = np.clip((weight * bad).sum(), 1e-4, 0.5)
            on_bad = ((weight * bad) @ fire + 1e-4) / ((weight * bad).sum() + 2e-4)
            on_other = ((weight * (1 - bad)) @ fire + 1e-6) / ((weight * (1 - bad)).sum() + 2e-6)
            on_bad = np.maximum(on_bad, on_other)  # a labeller is never better at firing on the others
            a = np.log(prior) + fire @ np.log(on_bad) + (1 - fire) @ np.log1p(-np.minimum(on_bad, 1 - 1e-6))
            c = np.log1p(-prior) + fire @ np.log(on_other) + (1 - fire) @ np.log1p(-np.minimum(on_other, 1 - 1e-6))
            new = 1 / (1 + np.exp(np.clip(c - a, -50, 50)))
            if np.abs(new - bad).max() < 1e-9:
                break
            bad = new
        self.prior, self.on_bad, self.on_other = float(prior), on_bad, on_other
        self.posterior = dict(zip(patterns.tolist(), bad.tolist(), strict=True))


def _buckets(names: list[bytes], kind: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(x, seed=kind) % BUCKETS for x in names), np.int64, len(names))


def _quality_parts(b: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of quality features: shares of word shapes, and tenths of distinct and of repeated words."""
    per_word = _buckets(b.shapes, 1)[b.shape]
    key, count = np.unique(b.row * BUCKETS + per_word[b.flat], return_counts=True) if len(b.flat) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    row = key // BUCKETS
    tenths = [(10 * np.minimum(b.distinct_share() * np.clip(b.n / 300, 1, 3), 1)).astype(int), (10 * b.same_as_last()).astype(int)]
    at = np.arange(len(b.n))
    extra = [_buckets([b"%d %d" % (k, v) for v in t], 2) for k, t in enumerate(tenths)]
    return np.concatenate([row, at, at]), np.concatenate([key % BUCKETS, *extra]), np.concatenate([count / b.n[row], np.ones(2 * len(b.n))])


def _toxic_parts(b: Batch, lexicon: Lexicon, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of words, log counts, and of the learnt votes; with weights, only of words that have one."""
    per_word = _buckets(b.bare, 3)
    flat, row = b.flat, b.row
    if weights is not None:
        live = (weights[per_word] != 0)[flat]
        flat, row = flat[live], row[live]
    key, count = np.unique(row * BUCKETS + per_word[flat], return_counts=True) if len(flat) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    learnt = [np.flatnonzero(f) for f in lexicon.fires(b)]
    names = np.repeat(_buckets([b"share", b"words"], 4), [len(x) for x in learnt])
    return np.concatenate([key // BUCKETS, *learnt]), np.concatenate([key % BUCKETS, names]), np.concatenate([np.log1p(count), np.full(len(names), VOTE)])


class LinearScorer:
    """Logistic regression on (row, bucket, value) features with soft labels; rows count by class so that rare ones weigh in."""

    def __init__(self, parts: tuple[np.ndarray, np.ndarray, np.ndarray], target: np.ndarray, weight: np.ndarray, penalty: float = 1e-3, rate: float = 0.3):
        row, bucket, value = parts
        self.weights, self.bias = np.zeros(BUCKETS), 0.0
        if not len(target):
            return
        seen = np.bincount(bucket, minlength=BUCKETS) >= min(SEEN, max(1, len(target) // 4))
        own = seen[bucket]
        row, bucket, value = row[own], bucket[own], value[own]
        names, bucket = np.unique(bucket, return_inverse=True)
        weight = weight / weight.mean()
        share = np.clip((weight * target).mean(), 0.02, 0.98)
        importance = weight * (target * 0.5 / share + (1 - target) * 0.5 / (1 - share))
        w, m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1), np.zeros(len(names) + 1)
        for t in range(1, ROUNDS + 1):  # Adam, full batch
            z = np.bincount(row, value * w[bucket], len(target)) + w[-1]
            error = importance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(target)
            g = np.append(np.bincount(bucket, value * error[row], len(names)), error.sum()) + penalty * np.append(w[:-1], 0)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) * (1 - t / (ROUNDS + 1))
        self.weights[names], self.bias = w[:-1], float(w[-1])

    def score(self, parts: tuple[np.ndarray, np.ndarray, np.ndarray], rows: int) -> np.ndarray:
        row, bucket, value = parts
        z = np.bincount(row, value * self.weights[bucket], rows) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _voter(lexicon: Lexicon):
    def run(text: pa.Array) -> pa.Array:
        texts = utf8(text)
        q, t = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for a, b in text_chunks(texts):
            q[a:b], t[a:b] = votes(texts[a:b], lexicon)
        return pa.StructArray.from_arrays([pa.array(q), pa.array(t)], ["quality", "toxic"])

    return once(run, "struct<quality:long,toxic:long>")


def _place() -> Column:
    """Place of a key in the order that samples follow."""
    return F.pmod(F.xxhash64("_k"), F.lit(1 << 30))


def _share(want: float, of: float) -> float:
    """A share of ``of`` rows that leaves ``want`` with room to spare."""
    return min(1.0, (1.2 * want + 4 * want**0.5 + 8) / of)


def _texts(slim: DataFrame, key: Column, names: list[int]) -> dict:
    """{key: text} of the rows with these keys."""
    want = slim.sparkSession.createDataFrame([(n,) for n in names], "_k long")
    rows = slim.withColumn("_k", key).join(F.broadcast(want), "_k").groupBy("_k").agg(F.min(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text")).collect()
    return {r["_k"]: bytes(r["text"]) for r in rows}


def learnt(docs: DataFrame, labels: DataFrame | None) -> Lexicon:
    """The lexicon of a sample of at most LABEL_DOCS labelled documents, half of each class if there are enough."""
    if labels is None:
        return Lexicon()
    named = labels.select(F.col("doc_id").cast("long").alias("_k"), (F.col("toxic") > 0).alias("rude")).dropna()
    total = {r["rude"]: r["count"] for r in named.groupBy("rude").count().collect()}
    rude: dict[int, bool] = {}
    for kind in (False, True):
        part = named.filter(F.col("rude") == kind).filter(_place() < int(_share(LABEL_DOCS // 2, max(total.get(kind, 1), 1)) * (1 << 30)))
        rude |= {r["_k"]: kind for r in part.select("_k", _place().alias("_p")).distinct().orderBy("_p", "_k").limit(LABEL_DOCS // 2).collect()}
    found = _texts(id_text(docs), F.col("doc_id"), list(rude)) if any(rude.values()) else {}
    by_text = {t: rude[k] for k, t in sorted(found.items(), key=lambda x: rude[x[0]])}  # copies count once, as toxic if one is
    toxic = np.fromiter(by_text.values(), bool, len(by_text))
    stands = [total.get(kind, 0) / max((toxic == kind).sum(), 1) for kind in (False, True)]
    return learn(list(by_text), toxic, np.where(toxic, stands[1], stands[0]))


def _sample(voted: DataFrame, counts: pd.DataFrame, sample_docs: int) -> tuple[list[int], np.ndarray]:
    """Keys of about sample_docs rows, a quarter of them shared evenly by the vote patterns, and how many rows each stands for."""
    kinds = counts.assign(want=np.minimum(counts["n"], np.maximum(1, sample_docs // 4 // len(counts)) + (sample_docs * 3 // 4 * counts["n"] / counts["n"].sum()).astype(int)))
    bounds = [(int(q), int(t), int(_share(w, n) * (1 << 30))) for q, t, w, n in zip(kinds["quality"], kinds["toxic"], kinds["want"], kinds["n"], strict=True)]
    near = voted.join(F.broadcast(voted.sparkSession.createDataFrame(bounds, "quality long, toxic long, _below long")), ["quality", "toxic"]).filter(_place() < F.col("_below"))
    rows = near.select("quality", "toxic", "_k", _place().alias("_p")).distinct().toPandas().sort_values(["_p", "_k"], kind="stable")
    rows = rows.merge(kinds, on=["quality", "toxic"])
    by = rows.groupby(["quality", "toxic"])
    rows = rows[by.cumcount() < rows["want"]]
    stands = rows["n"] / rows.groupby(["quality", "toxic"])["n"].transform("size")
    return rows["_k"].tolist(), stands.to_numpy(float)


def fit(docs: DataFrame, labels: DataFrame | None = None, sample_docs: int = SAMPLE_DOCS) -> tuple[DataFrame, dict]:
    """(votes of every document, {head: (label model, scorer)} and the lexicon)."""
    slim, lexicon = id_text(docs), learnt(docs, labels)
    key = F.xxhash64("doc_id", "text")
    voted = slim.select("doc_id", key.alias("_k"), _voter(lexicon)("text").alias("_v")).select("doc_id", "_k", "_v.*").checkpoint(eager=True)
    counts = voted.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most 2**14 rows
    if not int(counts["n"].sum()):
        return voted, {}
    names, stands = _sample(voted, counts, sample_docs)
    found = _texts(slim, key, names)
    texts = [found[k] for k in names]
    own = votes(texts, lexicon)
    batch, heads = Batch(texts), {"lexicon": lexicon}
    for k, (head, labellers, parts) in enumerate((("quality", QUALITY, _quality_parts), ("toxic", TOXIC if lexicon.beginnings else TOXIC[:4], lambda b: _toxic_parts(b, lexicon)))):
        by = counts.groupby(head)["n"].sum()
        model = LabelModel(by.index.to_numpy(np.int64), by.to_numpy(float), len(labellers))
        target = np.array([model.posterior[p] for p in own[k].tolist()])
        heads[head] = (model, LinearScorer(parts(batch), target, stands))
    return voted, heads


def _scorer(heads: dict):
    quality, toxic, lexicon = heads["quality"][1], heads["toxic"][1], heads["lexicon"]

    def run(text: pa.Array) -> pa.Array:
        texts = utf8(text)
        low, rude = np.ones(len(texts)), np.zeros(len(texts))
        for a, b in text_chunks(texts):
            part = Batch(texts[a:b])
            some = part.n > 0
            low[a:b] = np.where(some, quality.score(_quality_parts(part), b - a), 1.0)
            rude[a:b] = np.where(some, toxic.score(_toxic_parts(part, lexicon, toxic.weights), b - a), 0.0)
        return pa.StructArray.from_arrays([pa.array(low), pa.array(rude)], ["low_quality", "toxic"])

    return once(run, "struct<low_quality:double,toxic:double>")


def scored(docs: DataFrame, labels: DataFrame | None = None, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``docs`` with struct ``__scores`` (low_quality, toxic), probabilities by the two scorers."""
    prepare(docs.sparkSession)
    _, heads = fit(docs, labels, sample_docs)
    if not heads:
        return docs.withColumn("__scores", F.lit(None).cast("struct<low_quality:double,toxic:double>"))
    return docs.withColumn("__scores", _scorer(heads)(F.col("text").cast("string")))


def report(docs: DataFrame, labels: DataFrame | None = None, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One row per document: both scores and whether it is kept (neither is a half or more)."""
    out = scored(id_text(docs), labels, sample_docs)
    s = F.col("__scores")
    return out.select("doc_id", s["low_quality"].alias("low_quality"), s["toxic"].alias("toxic"), ((s["low_quality"] < 0.5) & (s["toxic"] < 0.5)).alias("kept"))

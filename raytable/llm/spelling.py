"""Spelling variant grouping by dynamic programming over sorted vocabulary lists.

1. Vocabulary. Runs of letters are counted per task first, then by word; the words that occur often enough stay.
2. Two sorted lists, the words and the reversed words, are range-partitioned into blocks of about ``BLOCK`` words. Words are
   distinct, so no block is hot. Only the first and last word of a block reach the driver and go out again (a row per block).
3. Routing. A word x is cut at k: a near word either begins with x[:k], then it stands in one range of the sorted list, or one edit
   lies before k, then it ends with x[k:] and stands in one range of the reversed list. k is the middle; where ranges
   there span many blocks, the k with the fewest. Blocks whose common beginning is already more than one edit away are skipped.
4. Scan. A task holds a block with its adjacent longest common prefixes (LCP) and runs over the range of each word: rows of the edit
   matrix, three cells wide around the diagonal, are kept by depth; the next word of the list goes on from row LCP; where all cells of a row exceed one
   edit, the scan jumps to the next word whose LCP is shorter than the row's depth. Many words are scanned in step as numpy arrays.
   A block with many visitors is copied to one key per ``VISITORS`` of them, visitors come in parts of bounded size.
5. Forms, then roots by pointer doubling (a form occurs ten times as often, so a chain has few links).

A pair counts in the sorted list if both words begin with x[:k], else in the reversed list: never twice. Nothing is sampled or cut off.

Defined cases: null and empty texts have no words; a null doc_id is written ``null`` where runs are thinned; repeated rows count again; a word may be of
any length (memory of a scan grows with its length); an empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, prepare, utf8

LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
DROP = 31  # one of so many (document, word) pairs loses a letter in the query's rows
BLOCK = 8192  # words of a list in one task
VISITORS = 1 << 16
CELLS = 1 << 21  # of letters of words scanned in step
HELD = 200_000  # counted words that a task holds before it passes them on
RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
VISIT = "list int, block int, salt int, word string, n long, start int"


def _count(thin: int):
    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                begun = zlib.crc32(f"{'null' if doc is None else doc}:".encode())
                for word, n in Counter(RUN.findall(text.translate(_LOWER).decode())).items():
                    if thin and not (h := zlib.crc32(word.encode(), begun)) % thin:
                        h %= len(word)
                        word = word[:h] + word[h + 1:]
                        if len(word) < LEAST_LENGTH:
                            continue
                    held[word] += n
            if len(held) > HELD:
                yield _counted(held)
                held = Counter()
        yield _counted(held)

    return run


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame, thin: int = 0) -> DataFrame:
    """word, n of all words of LEAST_LENGTH letters or more that occur LEAST_COUNT times or more; ``thin``: see DROP."""
    return id_text(docs).mapInArrow(_count(thin), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


# -- routing

def common_prefix(a, b) -> int:
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


def within_one(word: str, beginning: str, k: int) -> bool:
    """May a word that shares word[:k] and begins with ``beginning`` be one edit away?"""
    if len(beginning) <= k + 1:
        return True
    i = k + common_prefix(word[k:], beginning[k:])
    rest = beginning[i:]
    tails = (word[i + 1:], word[i:], word[i + 1:]), (rest[1:], rest[1:], rest)  # replaced, inserted, deleted
    return any(t.startswith(r) or r.startswith(t) and len(r) <= len(t) for t, r in zip(*tails))


class Blocks:
    """First and last words of the blocks of a sorted list."""

    def __init__(self, rows):
        rows = sorted((r["low"], r["high"], r["block"]) for r in rows)
        self.low, self.high, self.name = ([r[i] for r in rows] for i in range(3))
        self.common = [a[: common_prefix(a, b)] for a, b in zip(self.low, self.high)]

    def span(self, prefix: str) -> tuple[int, int]:
        """Blocks that may hold words with this prefix."""
        return bisect_left(self.high, prefix), bisect_right(self.low, prefix + "Ā")

    def visited(self, word: str, k: int) -> list[int]:
        a, b = self.span(word[:k])
        return [self.name[i] for i in range(a, b) if within_one(word, self.common[i], k)]


def _route(lists):
    def cost(word: str, k: int) -> int:
        (a, b), (c, d) = lists.value[0].span(word[:k]), lists.value[1].span(word[:k - 1:-1])
        return b - a + d - c

    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            for word in batch.column(0).to_pylist():
                k = len(word) // 2
                if cost(word, k) > 4:
                    k = min(range(1, len(word)), key=lambda j: cost(word, j))
                for side, (w, start) in enumerate(((word, k), (word[::-1], len(word) - k))):
                    for block in lists.value[side].visited(w, start):
                        for column, v in zip(out, (side, block, w, start)):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int32())], ["list", "block", "word", "start"])

    return run


# -- scanning

class SortedBlock:
    """A block of a sorted list of distinct words (Latin-1 bytes), with LCPs and the next place of a smaller LCP."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.length = np.array([len(w) for w in words] + [0])
        self.offset = np.concatenate([[0], np.cumsum(self.length[:-1])])
        self.letters = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        lcp = [0] + [common_prefix(a, b) for a, b in zip(words, words[1:])] + [-1]
        shorter, stack = [len(words)] * (len(words) + 1), []
        for i, v in enumerate(lcp):
            while stack and lcp[stack[-1]] > v:
                shorter[stack.pop()] = i
            stack.append(i)
        self.lcp, self.shorter = np.array(lcp), np.array(shorter)

    def range(self, prefix: bytes) -> tuple[int, int]:
        last = prefix.rstrip(b"\xff")
        return bisect_left(self.words, prefix), bisect_left(self.words, last[:-1] + bytes([last[-1] + 1])) if last else len(self.words)

    def near(self, words: list[bytes], starts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(index of a given word, place in the block) of all words one edit apart that share the first ``start`` letters."""
        spans = np.array([self.range(w[:s]) for w, s in zip(words, starts)]).reshape(-1, 2)
        size = np.array([len(w) for w in words])
        width = int(size.max()) + 3
        letters = np.zeros((len(words), width), np.uint8)
        for i, w in enumerate(words):
            letters[i, :len(w)] = np.frombuffer(w, np.uint8)
        rows = np.full((len(words), width, 3), 2, np.int8)  # rows[i, d]: cells d-1, d, d+1 of row d
        depth = np.array(starts)
        rows[np.arange(len(words)), depth] = (1, 0, 1)
        at, end = spans[:, 0].copy(), spans[:, 1]
        live, found = np.flatnonzero(at < end), []
        while len(live):
            m, d = at[live], depth[live]
            whole = self.length[m] == d
            if whole.any():
                q = live[whole]
                off = size[q] - d[whole]
                hit = np.abs(off) <= 1
                hit[hit] = rows[q[hit], d[whole][hit], off[hit] + 1] == 1
                found.append((q[hit], m[whole][hit]))
                at[q] += 1
                depth[q] = self.lcp[at[q]]
            q, m, d = live[~whole], m[~whole], d[~whole]
            letter = self.letters[self.offset[m] + d]
            old, new = rows[q, d], np.empty((len(q), 3), np.int8)
            apart = [(letters[q, d + b] != letter) for b in (-1, 0, 1)]
            new[:, 0] = np.minimum(old[:, 0] + apart[0], old[:, 1] + 1)
            new[:, 1] = np.minimum(np.minimum(old[:, 1] + apart[1], old[:, 2] + 1), new[:, 0] + 1)
            new[:, 2] = np.minimum(old[:, 2] + apart[2], new[:, 1] + 1)
            new[(d[:, None] + np.arange(3)) > size[q, None]] = 2  # cells d .. d+2 of the new row
            np.minimum(new, 2, out=new)
            d = d + 1
            rows[q, d], depth[q] = new, d
            dead = new.min(axis=1) > 1
            q, d, j = q[dead], d[dead], m[dead] + 1
            while (long := self.lcp[j] >= d).any():
                j[long] = self.shorter[j[long]]
            at[q], depth[q] = j, self.lcp[j]
            live = live[at[live] < end[live]]
        if not found:
            return np.zeros(0, int), np.zeros(0, int)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _scan(batches):
    """Rows sorted by (list, block, salt), words of the block first: per visitor the number of near words and the most frequent one."""
    key, members, counts, block = None, [], [], None
    waiting: list[tuple[str, int]] = []
    cells = widest = 0

    def scanned():
        back = key[0] == 1
        words = [w.encode("latin-1") for w, _ in waiting]
        starts = [s for _, s in waiting]
        best: dict[int, list] = defaultdict(lambda: [0, 0, ""])
        for i, m in zip(*(a.tolist() for a in block.near(words, starts))):
            other, word = block.words[m], words[i]
            if back:
                k = len(word) - starts[i]
                if word[-k:] == other[-k:]:
                    continue  # both begin alike: the sorted list has this pair
                other = other[::-1]
            other = other.decode("latin-1")
            b = best[i]
            b[0] += 1
            if counts[m] > b[1] or counts[m] == b[1] and other < b[2]:
                b[1:] = counts[m], other
        cols = list(zip(*(((waiting[i][0][::-1] if back else waiting[i][0]), *b) for i, b in best.items()))) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], ["word", "near", "n", "form"])

    for batch in batches:
        for lst, blk, salt, word, n, start in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if (lst, blk, salt) != key:
                if waiting:
                    yield scanned()
                key, members, counts, block, waiting, widest = (lst, blk, salt), [], [], None, [], 0
            if start < 0:
                members.append(word.encode("latin-1"))
                counts.append(n)
                continue
            if block is None:
                block = SortedBlock(members)
            widest = max(widest, len(word) + 3)
            if waiting and (len(waiting) + 1) * widest > CELLS:
                yield scanned()
                waiting, widest = [], len(word) + 3
            waiting.append((word, start))
    if waiting:
        yield scanned()


def _list(vocab: DataFrame, blocks: int, side: int) -> DataFrame:
    word = F.reverse("word") if side else F.col("word")
    rows = vocab.select(word.alias("word"), "n").repartitionByRange(blocks, "word")
    return rows.select(F.lit(side).alias("list"), F.spark_partition_id().alias("block"), "word", "n").checkpoint(eager=True)


def near_words(vocab: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, near (number of words one edit apart), n and form (the most frequent of them, the smallest of equals), for words with any.

    ``vocab``: distinct words of two letters or more, all below U+0100, and their counts.
    """
    spark = vocab.sparkSession
    blocks = max(1, -(-vocab.count() // block))
    lists = [_list(vocab, blocks, side) for side in (0, 1)]
    ends = [Blocks(x.groupBy("block").agg(F.min("word").alias("low"), F.max("word").alias("high")).collect()) for x in lists]
    visits = vocab.select("word").mapInArrow(_route(spark.sparkContext.broadcast(ends)), "list int, block int, word string, start int").checkpoint(eager=True)
    salts = visits.groupBy("list", "block").agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("salts"))  # a row per block
    visits = visits.join(salts, ["list", "block"]).withColumn("salt", F.pmod(F.xxhash64("word"), F.col("salts")).cast("int")).withColumn("n", F.lit(0).cast("long"))
    members = lists[0].unionByName(lists[1]).join(salts, ["list", "block"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("start", F.lit(-1))
    columns = [c.split()[0] for c in VISIT.split(", ")]
    tasks = max(spark.sparkContext.defaultParallelism, 2 * blocks)
    rows = members.select(columns).unionByName(visits.select(columns)).repartition(tasks, "list", "block", "salt")
    rows = rows.sortWithinPartitions("list", "block", "salt", F.col("start") >= 0, "word")
    found = rows.mapInArrow(_scan, "word string, near long, n long, form string")
    best = found.groupBy("word").agg(F.sum("near").alias("near"), F.min(F.struct((-F.col("n")).alias("n"), "form")).alias("best"))
    return best.select("word", "near", (-F.col("best.n")).alias("n"), "best.form")


def grouped(vocab: DataFrame, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``vocab`` (word, n)."""
    prepare(vocab.sparkSession)
    vocab = vocab.checkpoint(eager=True)
    near = near_words(vocab, block).withColumnRenamed("n", "form_n")
    rows = vocab.join(near, "word", "left")
    taken = F.col("form_n") >= ratio * F.col("n")
    rows = rows.select("word", F.when(taken, F.col("form")).alias("form"), "n", F.coalesce("near", F.lit(0)).alias("n_near"), F.when(taken, F.col("form_n")).alias("form_n")).checkpoint(eager=True)
    root = rows.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = root.select(F.col("word").alias("root"), F.col("root").alias("further"))
        root = root.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")).checkpoint(eager=True)
        if not root.filter("moved").take(1):
            break
    return rows.join(root.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def report(docs: DataFrame) -> DataFrame:
    prepare(docs.sparkSession)
    return grouped(vocabulary(docs, DROP))

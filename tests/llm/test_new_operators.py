"""Operators 11 to 13 against brute force, on rows that hold nulls, empty and repeated texts, ties and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from raytable.llm import mixing, prefix_trie, spelling

# -- 12 conversation prefix trie

TURNS = "conv_id long, turn long, role string, text string, depth long, conv long, pos int, size long, n int"


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], TURNS).repartition(3)


def rebuilt_plainly(rows):
    own = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    return {c: own.get(c - c % 5, [])[: zlib.crc32(str(c).encode()) % 9] + v[zlib.crc32(str(c).encode()) % 9:] for c, v in own.items()}


def plain_trie(convs):
    members = collections.defaultdict(list)
    for c, seq in sorted(convs.items()):
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    return collections.Counter((m[0], len(k), members[k[:-1]][0] if k else None, len(m), kids[k], leaves[k], saved[k],
                                hashlib.sha256(",".join(str(c) for c in m if len(convs[c]) == len(k)).encode()).hexdigest()) for k, m in members.items())


def talk(seed, convs, long=0):
    rng, rows = random.Random(seed), []
    for c in range(convs):
        for t in range(rng.randint(1, 12) if c != long else 60):
            rows.append((c, t, rng.choice(["user", "assistant"]) if t else "user", rng.choice(["a", "bé", "", "c c"]) if t else "hi"))
    rows += [(7, None, None, None), (8, 3, "user", "tie"), (8, 3, "user", "tie"), (None, 1, "user", "lost"), (10_003, 0, None, "alone"), (10_005, 0, "user", None)]
    rng.shuffle(rows)
    return rows


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("segment", [prefix_trie.SEGMENT, 3])
def test_trie_of_rebuilt_conversations(spark, segment):
    rows = talk(5, 60)
    got = prefix_trie.report(turns(spark, rows), segment)
    assert got.columns == NODE or sorted(got.columns) == sorted(NODE)
    assert collections.Counter(tuple(r) for r in got.select(NODE).collect()) == plain_trie(rebuilt_plainly(rows))


def test_trie_of_one_long_conversation_in_many_slices(spark):
    """A conversation that fills several slices, next to one that follows it nearly to its end."""
    rows = [(1, t, "user", str(t % 7)) for t in range(900)] + [(2, t, "user", str(t % 7)) for t in range(890)] + [(2, 890, "user", "else"), (3, 0, "user", "0")]
    t = prefix_trie.numbered_turns(turns(spark, rows))
    got = prefix_trie.trie(*prefix_trie.as_they_are(t), segment=100)
    convs = collections.defaultdict(list)
    for c, _, r, x in rows:
        convs[c].append((r, x))
    assert collections.Counter(tuple(r) for r in got.select(NODE).collect()) == plain_trie(convs)


def test_trie_of_nothing(spark):
    assert prefix_trie.report(turns(spark, [(1, 1, "a", "b")]).limit(0)).count() == 0


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, 5000).astype(np.uint64), rng.integers(0, 3, 5000).astype(np.uint64)
    table = prefix_trie.SlotTable(a, b)
    at = table.slots(a, b)
    assert sorted(at) == list(range(5000)) and (table.slots(a, b + np.uint64(7)) == -1).all()
    with pytest.raises(ValueError):
        prefix_trie.SlotTable(np.concatenate([a, a[:1]]), np.concatenate([b, b[:1]]))


# -- 13 mixing

MIXED = "doc_id long, text string, source string, size long, place long, shard string, target double, digest string"


def texts(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2, "x", 3.0, "y") for i, t, s in rows], MIXED).repartition(3)


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        share = {s: 2 * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in order if x not in full) for s in order}
        if not (above := {s for s in order if s not in full and share[s] > 2 * sizes[s]}):
            return share
        full |= above


def test_mix_meets_targets(spark):
    rng = random.Random(3)
    sources = [f"s{k}" for k in range(7)] + [None, "é", "", "Z"]
    rows = [(i, " ".join("w" * rng.randint(1, 200)), rng.choice(sources) if rng.random() < 0.7 else "s1") for i in range(900)]
    rows += [(None, "a\tb\x0bc\x1cd", "s2"), (5, None, "s3"), (5, "", None), (7, "x y", "tiny"), (8, "big " * 30_000, "s4"), (8, "big " * 30_000, "s4")]
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").replace("\x1c", "_").split())
    got = mixing.mix(texts(spark, rows)).collect()
    want, taken = plain_targets(sizes), collections.Counter()
    assert collections.Counter((r.doc_id, r.size, r.source) for r in got) == collections.Counter((i, len((t or "").replace("\x1c", "_").split()), s) for i, t, s in rows)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= max(1, want[s] / 100) for s in want)
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) < 30
    again = collections.Counter(tuple(r) for r in mixing.report(texts(spark, rows[::-1])).collect())
    assert again == collections.Counter(tuple(r)[:5] for r in got)


@pytest.mark.parametrize("seed", range(6))
def test_apportionment_takes_the_highest_quotients(spark, seed):
    rng = random.Random(seed)
    votes = [rng.choice([0.0, 1.0, 2.5, 7.0, 1000.0, rng.random() * 50]) for _ in range(rng.randint(1, 30))]
    total, seats = sum(votes), rng.choice([1, 3, 40, 777])
    if not total:
        return
    best = sorted((-v / (2 * j + 1), k) for k, v in enumerate(votes) for j in range(seats))[:seats]
    want = collections.Counter(k for _, k in best)
    got = mixing.apportion_sources(spark.createDataFrame(list(enumerate(votes)), "place long, target double"), seats, total).collect()
    assert {r.place: r.quota for r in got} == {k: want[k] for k in range(len(votes))}
    cells = [(g, s, rng.choice([0, 1, 2, 3, 50, 999]) + (s == 0)) for g in range(5) for s in range(rng.randint(1, 24))]
    room = collections.Counter()
    for g, _, b in cells:
        room[g] += 2 * b
    quota = {g: rng.choice([n, n // 3, 1, 0]) for g, n in room.items()}
    got = mixing.apportion_cells(spark.createDataFrame([(g, s, b, quota[g]) for g, s, b in cells], "place long, shard int, blocks long, quota long")).collect()
    for g in quota:
        best = sorted((-b / (2 * j + 1), s) for h, s, b in cells if h == g for j in range(2 * b))[: quota[g]]
        want = collections.Counter(s for _, s in best)
        assert {r.shard: r.cell_quota for r in got if r.place == g} == {s: want[s] for h, s, _ in cells if h == g}
        assert all(r.cell_quota <= 2 * r.blocks for r in got if r.place == g)


def test_mix_of_nothing(spark):
    assert mixing.report(texts(spark, [(1, "a", "b")]).limit(0)).count() == 0
    assert [tuple(r) for r in mixing.report(texts(spark, [(1, None, "b"), (2, " ", None)])).orderBy("doc_id").collect()] == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_mix_uses_no_python(spark, capsys):
    mixing.report(texts(spark, [(1, "a", "b")])).explain()
    assert "Python" not in (text := capsys.readouterr().out) and "Arrow" not in text


# -- 11 spelling variants

def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_groups(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def plain_vocabulary(rows):
    n = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def variants(seed, families=60):
    """Words in families of near ones, many with a common half, doubled letters and letters beyond ASCII."""
    rng = random.Random(seed)
    words = {}
    for _ in range(families):
        base = rng.choice(["", "entgegen", "ungsvoll", "aaaaaaa"]) + "".join(rng.choice("abéÿ×") for _ in range(rng.randint(7, 9))) + rng.choice(["", "ungsheit", "aaaaaa"])
        for _ in range(rng.randint(1, 8)):
            w = base
            for _ in range(rng.randint(0, 2)):
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abéz") + w[i:], w[:i] + rng.choice("abéz") + w[i + 1:]])
            if len(w) >= 7:
                words[w] = rng.choice([2, 3, 30, 31, 400, 5000])
    return words


@pytest.mark.parametrize("block", [spelling.BLOCK, 16])
def test_groups_of_variants(spark, block):
    n = variants(block)
    got = spelling.grouped(spark.createDataFrame(list(n.items()), "word string, n long"), block=block).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(got) == len(n) and {tuple(r) for r in got} == plain_groups(n)


@pytest.mark.parametrize("seed", range(8))
def test_scan_of_a_block_finds_all_near_words(seed):
    words = sorted(w.encode("latin-1") for w in variants(seed, 80))
    block, rng = spelling.SortedBlock(words), random.Random(seed)
    starts = [rng.randint(1, len(w) - 1) for w in words]
    got = set(zip(*(a.tolist() for a in block.near(words, starts))))
    assert got == {(i, m) for i, w in enumerate(words) for m, v in enumerate(words) if one_edit(w, v) and v[: starts[i]] == w[: starts[i]]}


def test_routing_skips_only_hopeless_beginnings():
    rng = random.Random(2)
    for _ in range(20_000):
        w = "".join(rng.choice("ab") for _ in range(rng.randint(3, 7)))
        v = "".join(rng.choice("ab") for _ in range(rng.randint(3, 7)))
        k = rng.randint(1, len(w) - 1)
        if one_edit(w, v) and v[:k] == w[:k]:
            assert all(spelling.within_one(w, v[:c], k) for c in range(len(v) + 1))


def test_spelling_report_of_documents(spark):
    rng, words = random.Random(4), list(variants(9, 25))
    rows = [(i, " ".join(rng.choice(words) if rng.random() < 0.7 else rng.choice(words[:5]).upper() for _ in range(rng.randint(0, 60)))) for i in range(150)]
    rows += [(None, "Strasse strasse abcdefgh Abcdefgh"), (3, None), (4, ""), (4, "x" * 50_000 + " " + "x" * 50_000 + " " + "x" * 50_001), (5, "Āabcdefg1abcdefg")] * 2
    got = spelling.report(texts(spark, [(i, t, "s") for i, t in rows])).select("word", "form", "root", "n", "n_near", "form_n").collect()
    want = plain_groups(plain_vocabulary(rows))
    assert len(got) == len(want) and {tuple(r) for r in got} == want and any(r.form for r in got)
    assert spelling.report(texts(spark, [(1, None, "s")])).count() == 0

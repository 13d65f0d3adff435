"""Memory of reused Python workers."""

from raytable.llm import common, decontaminate


def test_a_reused_worker_drops_what_earlier_stages_kept():
    decontaminate._searchers[b"block"] = object()
    common.release_memory()
    assert not decontaminate._searchers


def test_stages_after_packing_drop_its_tokenizer():
    from raytable.llm import jaccard, line_dedup, tokens

    for stage in (line_dedup._lines(50), jaccard._counts_pass(5, 6), jaccard._rows_pass(5, 80, type("Table", (), {"value": None})), jaccard._sets_pass(5, type("Filter", (), {"value": b""})), jaccard._difference):
        tokens._workers["path", True] = object()
        assert list(stage(iter([]))) == []
        assert not tokens._workers
    tokens._workers["path", True] = encoder = object()
    common.release_memory(keep=tokens._workers)  # packing goes on with its own
    assert tokens._workers.pop(("path", True)) is encoder


def test_index_entries_are_arrow_rows():
    import numpy as np
    import pyarrow as pa

    from raytable.llm import jaccard

    class Table:  # odd tokens are shared
        value = type("Shared", (), {"level": staticmethod(lambda tokens: (tokens & np.uint64(1)).astype(np.int8))})

    texts = ["a b c d e f g h i j k l", None, "", "a b c d e f g h i j k l", "x y", "one two three four five six seven"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    (out,) = jaccard._rows_pass(3, 50, Table)(iter([batch]))
    rows = out.to_pylist()
    assert [r["n"] for r in rows] == [10, 0, 0, 10, 1, 5] and [r["entries"] is None for r in rows] == [False, True, True, True, False, False]
    for k, tokens in jaccard.token_sets([(t or "").encode() for t in texts], 3):
        if rows[k]["entries"] is not None:
            order = sorted(tokens.tolist(), key=lambda t: (t & 1, t))[: len(tokens) + (-len(tokens) * 50) // 100 + 1]
            assert rows[k]["entries"] == [{"pos": p, "token": t - (t >> 63 << 64)} for p, t in enumerate(order) if t & 1]


def test_quality_rules_drop_what_packing_left(spark):
    import pyarrow as pa

    from raytable.llm import quality_rules, tokens

    for run in (quality_rules._count, quality_rules._keeper(None, 1.0).func):
        tokens._workers["path", True] = object()
        run(pa.array(["a b c"]))
        assert not tokens._workers

"""What round 3 found: cost of token ids and of word features, files that pile up."""

import numpy as np
import public_tokenizers
import pytest


@pytest.mark.parametrize("name,spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_words_go_to_the_tokenizer_in_runs(name, spaced):
    from raytable.llm import tokens

    encoder = tokens.Encoder(public_tokenizers.path(name), spaced)
    lead = " " * spaced
    words = [lead + w for w in ("straße", "naïvely", "été", "the", "unzusammenhängend", "a", "ñandú", "ÿ")] + [lead + "w" * k for k in range(1, 40)]
    words += [lead + f"word{chr(97 + k % 26)}{'xyz' * (k % 9)}" for k in range(1000)]
    texts = words[:30] + ["don't", "l'été", "12,5", "?!", "", "ÀB", "é́", "<|endoftext|>", lead + "µ", "x1"] + words[30:]
    want = [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    handed = []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            handed.extend(texts)
            return tokenizer.encode_batch_fast(texts, **options)

    tokenizer, encoder.tokenizer = encoder.tokenizer, Counted()
    assert encoder._encode(texts) == want
    assert len(handed) <= 10 + len(words) // tokens.RUN + 1  # every word was handed over alone
    encoder.border[:] = False  # a vocabulary without marks
    assert encoder._encode(texts) == want
    assert encoder._encode([]) == []


def test_word_features_are_made_once_per_shape(monkeypatch):
    from raytable.llm import weak_labels

    def plain(word):  # character by character
        out = bytearray()
        for b in word:
            c = 97 if 97 <= b <= 122 or b >= 0x80 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 35 if b in b"#*$%&|<>" else 46
            if not out or out[-1] != c:
                out.append(c)
        return bytes(out[:8])

    texts = [b"The THE the #x 12,5 a1b2c3d4e5f6 \xc3\xa9t\xc3\xa9! --- $$$ idiot.", b"", b" ".join(b"word%d" % k for k in range(500)), b"Idiot scum x\x00\x7f (y)"]
    b = weak_labels.Batch(texts)
    assert [b.shapes[k] for k in b.shape] == [plain(w) for w in b.distinct] == [weak_labels._shape(w) for w in b.distinct]
    assert b.distinct == list(dict.fromkeys(w for t in texts for w in t.split()))
    named = []
    monkeypatch.setattr(weak_labels, "_buckets", lambda names, kind, make=weak_labels._buckets: named.append((kind, len(names))) or make(names, kind))
    weak_labels._quality_parts(b)
    assert (1, len(set(b.shapes))) in named and len(b.shapes) < 20 < len(b.distinct)  # a hash per shape, not per word
    assert weak_labels.votes(texts)[1].tolist()[0] & 1 and weak_labels.votes(texts)[1].tolist()[3] & 2


def test_line_dedup_stores_one_table_a_level(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from raytable.llm import line_dedup

    text = "\n".join(f"w{k}" for k in range(70))
    docs = spark.createDataFrame([(1, text), (2, "x\n" + text), (3, text + "\nx"), (4, "\n".join(f"w{k}" for k in range(20)))], "doc_id long, text string")
    made = []
    monkeypatch.setattr(DataFrame, "checkpoint", lambda df, eager=True, plain=DataFrame.checkpoint: made.append(df.columns) or plain(df, eager))
    got = {r.doc_id: (r.text, r.n_windows) for r in line_dedup.report(docs, 50).collect()}
    assert got == {1: (text, 0), 2: ("x", 21), 3: ("x", 21), 4: ("\n".join(f"w{k}" for k in range(20)), 0)}
    assert sum("rank" in c for c in made) == 6
    assert len(made) == 6 + 4  # lines, levels, names of all windows, spans, doubled rows; each level took two more

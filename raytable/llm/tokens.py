"""Token ids by a tokenizers file, memoised by piece of text.

Both vocabularies split a text before they merge bytes. A cut mark goes where such a split is certain: before a space that
stands alone, between a letter and a punctuation mark other than the apostrophe (in either order), and around a line end
between a mark and a letter. A text with other runs of spaces goes to the library as a whole. Between two cuts the library
works as it would inside the text, so ids are those of ``Tokenizer.encode(text, add_special_tokens=False)`` with special
strings read as plain text.

Cutting and finding distinct pieces is Arrow's work, putting ids together numpy's; Python sees distinct pieces only.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import WORKER_MEMOS, text_chunks

PIECES = 100_000  # that a worker remembers; memory stays bounded
CUT = "\x01"
PART_BYTES = 2 << 20  # text put together at once
_SPACE = r"[\t-\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_ODD = f"^$|^{_SPACE}|{_SPACE} | {_SPACE}| $|{CUT}"
_LETTER, _MARK = "[A-Za-zÀ-ÖØ-öø-ÿ]", r"[!-&(-/:-@\[-`{-~]"
_CUTS = [(f"({_LETTER})({_MARK})", rf"\1{CUT}\2"), (f"({_MARK})\n({_LETTER})", f"\\1{CUT}\n{CUT}\\2"), (f"({_MARK})({_LETTER})", rf"\1{CUT}\2")]
# pieces of letters alone: the library neither splits nor changes them, so many go to it in one text and their ids are told apart by a mark
_WORD = {False: re.compile("[a-zß-öø-ÿ]+"), True: re.compile(" [A-Za-zÀ-ÖØ-öø-ÿ]+")}
RUN = 512  # such pieces that make one text
_workers: dict[tuple[str, bool], "Encoder"] = {}
WORKER_MEMOS.append(_workers)


class Memo(dict):
    """What was made first stays, up to a size: frequent keys come early."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def values_of(self, keys: list[str], make) -> list[bytes]:
        values = list(map(self.get, keys))
        missing = [k for k, v in enumerate(values) if v is None]
        for k, v in zip(missing, make([keys[k] for k in missing]), strict=True):
            values[k] = v
        room = max(0, self.size - len(self))
        self.update((keys[k], values[k]) for k in missing[:room])
        return values


class Encoder:
    """Ids of texts. ``spaced`` says that a space belongs to the chunk after it, else white space is dropped."""

    def __init__(self, path: str, spaced: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.spaced, self.memo = spaced, Memo(PIECES)
        names = self.tokenizer.get_vocab()
        self.border = np.zeros(max(names.values(), default=0) + 1, bool)  # ids that begin a spaced word, else those that end a word
        self.border[[i for n, i in names.items() if (n.startswith("Ġ") if spaced else n.endswith("</w>"))]] = True

    def ids(self, texts: pa.Array, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, borders of rows) for parts of a string column; null is empty and ``end`` closes every row."""
        texts = texts.fill_null("")
        sizes = pc.binary_length(texts).to_pylist()
        for a, b in text_chunks([range(n) for n in sizes], PART_BYTES):
            yield a, *self._part(texts.slice(a, b - a), end)

    def _part(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, _ODD)
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        own = texts.take(pa.array(whole)).to_pylist()
        texts = pc.if_else(odd, "", texts)
        texts = pc.replace_substring(texts, " ", CUT + " " * self.spaced)
        if not self.spaced:
            texts = pc.ascii_lower(pc.replace_substring(texts, "\n", CUT))  # its vocabulary is lower case
        for pattern, replacement in _CUTS:
            texts = pc.replace_substring_regex(texts, pattern, replacement)
        lists = pc.split_pattern(texts, CUT)
        first = lists.offsets.to_numpy().astype(np.int64)
        first, flat = first - first[0], lists.flatten().dictionary_encode()
        code = flat.indices.to_numpy().astype(np.int32)
        values = self.memo.values_of(flat.dictionary.to_pylist(), self._encode)
        code[first[whole]] = len(values) + np.arange(len(whole))
        values += self._encode(own)
        code = np.insert(code, first[1:], len(values))
        values.append(struct.pack("<I", end))
        size = np.fromiter(map(len, values), np.int32, len(values)) // 4
        table, start = np.frombuffer(b"".join(values), "<u4"), np.cumsum(size, dtype=np.int32) - size
        count = size[code]
        total = np.cumsum(count, dtype=np.int32)  # a part has fewer than 2**31 ids
        ids = table[np.repeat(start[code] - (total - count), count) + np.arange(int(total[-1]), dtype=np.int32)]
        return ids, np.concatenate([[0], total[first[1:] + np.arange(len(first) - 1)]])

    def _encode(self, texts: list[str]) -> list[bytes]:
        words = [k for k, t in enumerate(texts) if _WORD[self.spaced].fullmatch(t)]
        out = [b""] * len(texts)
        for a in range(0, len(words), 64 * RUN):
            some = words[a: a + 64 * RUN]
            values = self._words([texts[k] for k in some])
            if values is None:  # a vocabulary without such marks
                values = self._each([texts[k] for k in some])
            for k, v in zip(some, values, strict=True):
                out[k] = v
        rest = np.setdiff1d(np.arange(len(texts)), np.array(words, np.int64)).tolist()
        for k, v in zip(rest, self._each([texts[k] for k in rest]), strict=True):
            out[k] = v
        return out

    def _each(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e)}I", *e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes] | None:
        """Ids of words that stand in few long texts, or None where not every word has its own mark."""
        texts = [("" if self.spaced else " ").join(words[k: k + RUN]) for k in range(0, len(words), RUN)]
        found = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(found)
        at = np.flatnonzero(self.border[ids])
        if len(at) != len(words) or (len(ids) and not self.border[ids[0 if self.spaced else -1]]):
            return None
        borders = (4 * (np.append(at, len(ids)) if self.spaced else np.append(0, at + 1))).tolist()
        data = ids.tobytes()
        return [data[x:y] for x, y in zip(borders, borders[1:])]


def encoder(path: str, spaced: bool) -> Encoder:
    """The worker's encoder: Python workers are reused by later tasks, and so is its memo."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    if (path, spaced) not in _workers:
        _workers[path, spaced] = Encoder(path, spaced)
    return _workers[path, spaced]

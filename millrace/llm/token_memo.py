"""Encoding with a public tokenizer file, each distinct stretch of text once per worker.

The tokenizers here split a text before they merge, and never merge across certain places (see ``cut``
and ``cut_words``). Texts are cut there; each stretch is encoded by the library the first time a worker
meets it and remembered, its numbers in numpy arrays. The memory is bounded: once it is full, stretches
it lacks are encoded for the batch in hand and forgotten.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Stretches a worker remembers; at about 160 bytes each this is some 160 MB.
REMEMBERED = 1_000_000
#: Longer stretches are never remembered.
LONGEST = 64
#: Parts of stretches a worker remembers, as Python strings: some 60 MB.
PARTS = 250_000
# White space beside white space, or other than a space or line feed; the control characters are those
# that one of the libraries or Python takes for white space.
_UNSAFE = (
    "[ \\n][ \\n]|[\\x00\\t\\v\\f\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
)
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_WORD = re.compile(f"[{_LATIN}]+")
# Between a Latin letter and an ASCII sign or digit every token ends.
_SIGN = re.compile(f"(?<=[{_LATIN}])(?=[!-@\\[-`{{-~])")
_loaded: dict = {}


def tokenizer(path: str):
    """The tokenizer of a ``.json`` file, loaded once per worker, without threads of its own."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def _byte_letters() -> dict[int, str]:
    """The letters byte-level vocabularies write bytes with: printable ones as they are, the others
    numbered from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


BYTE_LETTERS = _byte_letters()


def in_byte_letters(text: str) -> str:
    return text.encode().decode("latin-1").translate(BYTE_LETTERS)


#: Letters of words, and a space, by code point: what they are spelled with.
_SPELLED = {
    c: in_byte_letters(chr(c)) for c in (32, *range(0x80, 0x100)) if c == 32 or re.match(f"[{_LATIN}]", chr(c))
}


def spell(word: str) -> str:
    """``in_byte_letters`` for a word and the space before it."""
    return word.translate(_SPELLED)


def is_word(part: str) -> bool:
    return _WORD.fullmatch(part) is not None


def parts_of(stretch: str) -> list[str]:
    """``stretch`` cut further, where every token ends; not where it may hold a special token."""
    return [stretch] if stretch[1:].isalpha() or "<|" in stretch else _SIGN.split(stretch)


def _marked(texts: pa.Array, after_line_feed: str) -> pa.Array:
    spaced = pc.replace_substring(texts, " ", "\0 ")
    return pc.replace_substring(spaced, "\n", "\0\n" + after_line_feed)


def cut(texts: pa.Array) -> pa.Array:
    """For byte-level tokenizers that keep white space: lists of stretches that make up each text.

    A single space or line feed between characters that are not white space starts a new token, and a
    line feed ends it too. A text with any other white space is one stretch.
    """
    unsafe = pc.match_substring_regex(texts, _UNSAFE)
    if pc.any(unsafe).as_py():
        if pc.any(pc.match_substring(texts, "\0")).as_py():
            whole = unsafe.to_pylist()
            marked = _marked(pc.if_else(unsafe, "", texts), "\0").to_pylist()
            lists = [[t] if w else m.split("\0") for t, w, m in zip(texts.to_pylist(), whole, marked)]
            return pa.array(lists, pa.list_(pa.string()))
        return pc.split_pattern(pc.if_else(unsafe, texts, _marked(texts, "\0")), "\0")
    return pc.split_pattern(_marked(texts, "\0"), "\0")


def cut_words(texts: pa.Array) -> pa.Array:
    """For tokenizers that drop white space: cut before every space and line feed."""
    if pc.any(pc.match_substring(texts, "\0")).as_py():
        return pa.array(
            [re.split("(?=[ \n])", t) for t in texts.to_pylist()], pa.list_(pa.string())
        )
    return pc.split_pattern(_marked(texts, ""), "\0")


class Memo:
    """``encode``, from a list of stretches to 32-bit numbers for each (packed), remembered by stretch.

    The table of stretches and the arrays of their numbers are kept between batches and only ever added to.
    """

    def __init__(
        self,
        cut: Callable[[pa.Array], pa.Array],
        encode: Callable[[list[str]], list[bytes]],
        most: int = REMEMBERED,
    ):
        self.cut, self.encode, self.most = cut, encode, most
        self.slots: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, "<i4"), 0
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all ``texts`` (no nulls) in one array, and where each text's end."""
        lists = self.cut(texts.cast(pa.string()))
        coded = lists.flatten().dictionary_encode()
        distinct, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        known = self.slots.get
        at = np.fromiter((known(s, -1) for s in distinct), np.int64, len(distinct))
        self._add(distinct, at)
        each = self.sizes[at][index]
        ends = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
        place = np.arange(ends[-1], dtype=np.int32)
        place += np.repeat((self.starts[at][index] - ends[:-1]).astype(np.int32), each)
        return self.flat[place], ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()][1:]

    def _add(self, distinct: list[str], at: np.ndarray) -> None:
        """Gives those of ``distinct`` that lack a slot (-1 in ``at``) one, for good while there is room and they
        are short, else until the next batch."""
        lacking = np.flatnonzero(at < 0).tolist()
        n, room = len(self.slots), self.most - len(self.slots)
        short = [i for i in lacking if len(distinct[i]) <= LONGEST][: max(room, 0)]
        kept = set(short)
        lacking = short + [i for i in lacking if i not in kept]
        gc.disable()  # a batch makes many short-lived lists and no cycles
        try:
            values = self.encode([distinct[i] for i in lacking])
        finally:
            gc.enable()
        sizes = np.array([len(v) // 4 for v in values], np.int64)
        total = int(sizes.sum())
        self.flat = _room(self.flat, self.used, total)
        self.starts, self.sizes = _room(self.starts, n, len(sizes)), _room(self.sizes, n, len(sizes))
        self.flat[self.used : self.used + total] = np.frombuffer(b"".join(values), "<i4")
        self.starts[n : n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[n : n + len(sizes)] = sizes
        at[lacking] = np.arange(n, n + len(sizes))
        self.slots.update(zip([distinct[i] for i in short], range(n, n + len(short))))
        self.used += int(sizes[: len(short)].sum())


def _room(kept: np.ndarray, used: int, more: int) -> np.ndarray:
    """``kept`` with room for ``more`` behind its first ``used``; grown by half at least, so seldom copied."""
    if used + more <= len(kept):
        return kept
    grown = np.zeros(max(used + more, len(kept) * 3 // 2), kept.dtype)
    grown[:used] = kept[:used]
    return grown

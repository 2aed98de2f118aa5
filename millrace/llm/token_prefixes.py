"""Token counts of every prefix of a long text, without encoding each prefix.

Byte pairs merged by rank give the one split in which every two neighbours, merged anew, stay as they are. So
the last token of each prefix of a word is the only one that fits the last token of the prefix before
it, and is found once per prefix. A word's end has tokens of its own ("</w>"), which are chosen the same way
for the prefix in hand and change nothing in the chain.
"""

from __future__ import annotations

import json
import re
import unicodedata

from millrace.llm.token_memo import in_byte_letters, tokenizer

_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_END = "</w>"
_JAMO = re.compile("[\u1160-\u11ff\ud7b0-\ud7ff]")
#: Pairs and characters remembered.
_KNOWN = 500_000


class Vocabulary:
    """Merge ranks and tokens of a ``.json`` file, and which two tokens may stand side by side."""

    def __init__(self, path: str):
        self.tok = tokenizer(path)
        with open(path, encoding="utf-8") as f:
            stated = json.load(f)
        model = stated["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {p: i for i, p in enumerate(pairs)}
        tokens = model["vocab"].keys()
        self.inner = {t for t in tokens if not t.endswith(_END)}
        self.final = {t[: -len(_END)] for t in tokens if t.endswith(_END)}
        self.longest = max(map(len, self.inner | self.final))
        special = [t["content"] for t in stated["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.fits: dict = {}
        self.kinds: dict = {}
        self.normal: dict = {}

    def merged(self, symbols: list[str]) -> list[str]:
        """``symbols`` merged by rank, the leftmost of equal rank first."""
        while len(symbols) > 1:
            rank, at = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:])))
            if rank == 1 << 60:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def fit(self, left: str, right: str, final: bool) -> bool:
        """Whether the two stay as they are; an empty ``left`` asks it of ``right`` alone."""
        found = self.fits.get((left, right, final))
        if found is None:
            symbols = list(left + right)
            want = [t for t in (left, right) if t]
            if final:
                symbols[-1] += _END
                want[-1] += _END
            if len(self.fits) > _KNOWN:
                self.fits.clear()
            found = self.fits[(left, right, final)] = self.merged(symbols) == want
        return found

    def kind(self, c: str) -> str:
        """What the pre-tokenizer takes a normalised character for: S(pace), L(etter), N(umber), O(ther)."""
        found = self.kinds.get(c)
        if found is None:
            pieces = lambda t: len(self.tok.pre_tokenizer.pre_tokenize_str(t))
            found = "S" if not pieces(c) else "L" if pieces("a" + c) == 1 else "O" if pieces(c + c) == 1 else "N"
            self.kinds[c] = found
        return found

    def normalised(self, text: str) -> str:
        found = self.normal.get(text)
        if found is None:
            found = self.tok.normalizer.normalize_str(text)
            if len(text) == 1:
                self.normal[text] = found
        return found


class Word:
    """The last tokens of every prefix of a growing word, in byte letters."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.letters, self.last, self.counts = vocabulary, "", [""], [0]

    def _last(self, known: set[str], final: bool) -> tuple[str, int]:
        end = len(self.letters)
        for size in range(min(end, self.v.longest), 0, -1):
            token = self.letters[end - size :]
            if token in known and self.v.fit(self.last[end - size], token, final):
                return token, self.counts[end - size] + 1
        raise ValueError(f"no token ends {self.letters[-self.v.longest:]!r}")

    def add(self, text: str) -> Word:
        for letter in in_byte_letters(text):
            self.letters += letter
            token, n = self._last(self.v.inner, False)
            self.last.append(token)
            self.counts.append(n)
        return self

    def count(self) -> int:
        """Tokens of the word, were it to end here."""
        return self._last(self.v.final, True)[1] if self.letters else 0

    def cut(self, size: int) -> None:
        self.letters = self.letters[:size]
        del self.last[size + 1 :], self.counts[size + 1 :]


class Prefix:
    """A growing normalised text: tokens of its finished words, and the word that may still grow."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.done, self.kind, self.word, self.tail = vocabulary, 0, "S", Word(vocabulary), ""

    def _short(self, text: str) -> int:
        return Word(self.v).add(text).count()

    def _start(self, kind: str, text: str) -> None:
        self.done = self.count()
        self.kind, self.word, self.tail = kind, Word(self.v).add(text), ""

    def add(self, text: str) -> None:
        for c in text:
            kind = self.v.kind(c)
            if self.kind == "'" and kind == "L":  # an apostrophe at a word's start, and perhaps "re" after it
                tail = self.tail + c
                if tail in _CONTRACTIONS:
                    self.done += self._short("'" + tail)
                    self.kind, self.word, self.tail = "S", Word(self.v), ""
                elif any(x.startswith(tail) for x in _CONTRACTIONS):
                    self.tail = tail
                else:
                    self.tail = ""
                    self._start("L", tail)
            elif self.kind == "'" and kind == "O" and not self.tail:
                self.kind = "O"
                self.word.add(c)
            elif kind == self.kind and kind in "LO":
                self.word.add(c)
            else:
                self._start("'" if c == "'" else kind, "" if kind == "S" else c)

    def count(self) -> int:
        return self.done + self.word.count() + (self._short(self.tail) if self.tail else 0)

    def count_with(self, text: str) -> int:
        """The count, were ``text`` to follow."""
        kept = self.done, self.kind, self.word, self.tail, len(self.word.letters)
        self.add(text)
        n = self.count()
        self.done, self.kind, self.word, self.tail = kept[:4]
        self.word.cut(kept[4])
        return n


def _bound(text: str, i: int) -> bool:
    """Whether no character from ``i`` on can change how those before it are normalised."""
    c = text[i]
    return c < "\u0300" or not (unicodedata.category(c)[0] == "M" or unicodedata.combining(c) or _JAMO.match(c))


def counts(vocabulary: Vocabulary, text: str) -> list[int]:
    """Tokens of each prefix of ``text`` of 1, 2, ... code points."""
    out: list[int] = []
    before, at = 0, 0
    specials = vocabulary.special.finditer(text) if vocabulary.special else ()
    for stop, end in [*((m.start(), m.end()) for m in specials), (len(text), len(text))]:
        prefix, start, whole = Prefix(vocabulary), at, 0
        for i in range(at, max(stop, end - 1)):  # a special token that is not whole yet is text
            if i > start and _bound(text, i):
                prefix.add(vocabulary.normalised(text[start:i]))
                start = i
            n = prefix.count_with(vocabulary.normalised(text[start : i + 1]))
            out.append(before + n)
            if i < stop:
                whole = n
        if end > stop:
            before += whole + 1
            out.append(before)
        at = end
    return out

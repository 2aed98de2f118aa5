"""Token counts by prefix: how many tokens every prefix of a text has, as the library would say.

White space ends a token here and leaves none behind, so the count of a prefix of the text is the count up
to its last stretch plus that of the stretch's own prefix: a sum over prefixes that is built up once.
Prefixes of words are shared by many words, so each is encoded once and reused. A text's counts are
kept as the differences between neighbouring prefixes, one number per code point. Their running sum is the
exact count, which truncation and budget questions read instead of encoding again.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import no_nulls, slices
from millrace.llm.token_memo import (
    PARTS,
    Memo,
    cut_words,
    is_word,
    parts_of,
    spell,
    tokenizer,
)
from millrace.llm.token_prefixes import Vocabulary, counts

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Parts of more code points than this (no space or sign for so long) are not encoded prefix by prefix nor
#: remembered: their counts are built up token by token.
LONGEST_STRETCH = 128
_memos: dict[str, Memo] = {}


def _memo(path: str) -> Memo:
    """Stretch -> the differences of its prefixes' counts, as packed 32-bit numbers."""
    if path in _memos:
        return _memos[path]
    tok = tokenizer(path)
    merge = tok.model.tokenize
    parts: dict[str, bytes] = {}
    words: dict[str, int] = {}
    vocabulary: list[Vocabulary] = []  # read when a long part is met

    def steps_of_word(word: str) -> bytes:
        # Spelled once; a prefix of the word is a prefix of its spelling, a letter per byte.
        if (found := parts.get(word)) is not None:
            return found
        ascii, end, before, steps = word.isascii(), 0, 0, array("i")
        spelled = word if ascii else spell(word)
        for letter in word:
            end += 1 if ascii else len(letter.encode())
            prefix = spelled[:end]
            if (n := words.get(prefix)) is None:
                n = words[prefix] = len(merge(prefix))
            steps.append(n - before)
            before = n
        return parts.setdefault(word, steps.tobytes())

    def steps_of(part: str) -> bytes:
        if (found := parts.get(part)) is not None:
            return found
        if len(part) > LONGEST_STRETCH:
            if not vocabulary:
                vocabulary.append(Vocabulary(path))
            return np.diff(np.array([0, *counts(vocabulary[0], part)], "<i4")).tobytes()
        core = part.lstrip(" \n")
        if is_word(core):  # white space leaves no token
            return bytes(4 * (len(part) - len(core))) + steps_of_word(core.lower())
        ends = tok.encode_batch_fast(
            [part[:i] for i in range(1, len(part) + 1)], add_special_tokens=False
        )
        return parts.setdefault(part, np.diff(np.array([0, *map(len, ends)], "<i4")).tobytes())

    def encode(stretches: list[str]) -> list[bytes]:
        for known in (parts, words):
            if len(known) > PARTS:
                known.clear()
        return [b"".join(map(steps_of, parts_of(s))) for s in stretches]

    return _memos.setdefault(path, Memo(cut_words, encode))


def prefix_counts(docs: DataFrame, path: str | None = None, keep_steps: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row of ``docs(doc_id, text)`` and, if kept, ``steps``.

    ``steps`` has a number per code point: by how much the count of the prefix ending there exceeds that of
    the one before. Null texts are empty: 0 bytes, 0 tokens, no steps. Strings of special tokens
    inside a text count as the library's default says. Repeated rows are counted each; no row is dropped.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo(path)
        for batch in slices(batches, 1000):
            texts = no_nulls(batch.column(1))
            steps, ends = memo.of(texts)
            upto = np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            columns = [
                batch.column(0),
                pc.binary_length(texts).cast(pa.int64()),
                pa.array(upto[ends] - upto[starts], pa.int64()),
            ]
            names = ["doc_id", "n_bytes", "n_tokens"]
            if keep_steps:
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                values = pa.array(steps, pa.int32())
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), values))
                names.append("steps")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.select("doc_id").schema.fields[0].dataType.simpleString()
    more = ", steps array<int>" if keep_steps else ""
    return docs.select("doc_id", "text").mapInArrow(
        count, f"doc_id {kind}, n_bytes long, n_tokens long{more}"
    )


def count_at(steps: Column, length: Column | int) -> Column:
    """Tokens of the prefix of ``length`` code points; null if the text has fewer."""
    length = length if isinstance(length, Column) else F.lit(length)
    total = F.aggregate(F.slice(steps, 1, length), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(length <= F.size(steps), total)


def longest_prefix(steps: Column, budget: int) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("i"), F.lit(0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        n, i = a["n"] + x, a["i"] + 1
        return F.struct(n.alias("n"), i.alias("i"), F.when(n <= budget, i).otherwise(a["best"]).alias("best"))

    return F.aggregate(steps, start, step, lambda a: a["best"])


def counted(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The digest of every row of ``docs``: the count of the last prefix and whether it is over ``limit``."""
    return prefix_counts(docs, keep_steps=False).withColumn("over_limit", F.col("n_tokens") > limit)

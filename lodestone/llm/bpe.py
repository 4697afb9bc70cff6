"""Byte-level BPE encoding of whole texts by prefix-sharing trie traversal.

The encoding of every prefix of a word is fixed by its last token: a sequence of tokens is the encoding of its bytes
exactly if each token follows its predecessor as the merges would have it. So the distinct words of a batch are walked
as a trie in depth-first order; each node gets its last token from the states of its ancestors, and what words share
as a prefix is computed once. A word's ids are read back from its node.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; they are read there and never copied.
TOKENIZERS = os.environ.get("LODESTONE_TOKENIZERS", "/opt/tokenizers")
DEFAULT = "byte_bpe_50k.tiktoken"

# fixed values: the pattern that splits text into words before the merges
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts of ASCII only, without Unicode tables.
ASCII_PATTERN = r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
#: Distinct words whose ids a worker keeps; beyond, it forgets all and goes on.
WORDS_KEPT = 400_000
#: Characters of text that are in work at once.
CHARS_AT_ONCE = 4_000_000


def vocabulary(raw: bytes) -> dict[bytes, int]:
    """Ranks of a rank file (base64 token and rank per line)."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, raw.split(b"\n")))}


class TrieEncoder:
    """Encodes words and texts with one vocabulary; ids of distinct words are kept."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks))
        self.single: dict[int, bool] = {}
        self.follows: dict[int, bool] = {}
        self.history: dict[int, tuple] = {}
        self.unicode, self.ascii = regex.compile(PATTERN), re.compile(ASCII_PATTERN)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.spans, self.flat = [0], []

    def merged(self, text: bytes) -> list[int]:
        """The merges applied one by one, lowest rank first; for short texts."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def stands(self, t: int) -> bool:
        if t not in self.single:
            self.single[t] = self.merged(self.tokens[t]) == [t]
        return self.single[t]

    def edges(self, t: int) -> tuple[list[tuple[bytes, int, int]], list[tuple[bytes, int, int]]]:
        """What stands at the left and at the right edge of a token while its own merges go on: (part, rank of the merge
        that makes it, rank of the merge that takes it up)."""
        got = self.history.get(t)
        if got is None:
            text = self.tokens[t]
            parts, left, right, end = [text[i : i + 1] for i in range(len(text))], [], [], 1 << 30
            l_since = r_since = -1
            while len(parts) > 1:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], end), i) for i in range(len(parts) - 1))
                if rank == end:
                    break
                if at == 0:
                    left.append((parts[0], l_since, rank))
                    l_since = rank
                if at == len(parts) - 2:
                    right.append((parts[-1], r_since, rank))
                    r_since = rank
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            got = self.history[t] = ([*left, (parts[0], l_since, end)], [*right, (parts[-1], r_since, end)])
        return got

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the merges leave a border between two tokens: no parts that meet there are merged while both exist.

        Of merges of one rank the one further left comes first: one inside ``a`` before, one inside ``b`` after.
        """
        k = a << 20 | b
        ok = self.follows.get(k)
        if ok is None:
            if len(self.follows) > 2_000_000:
                self.follows.clear()
            ok, get = self.stands(a) and self.stands(b), self.ranks.get
            for x, x0, x1 in self.edges(a)[1] if ok else ():
                for y, y0, y1 in self.edges(b)[0]:
                    r = get(x + y)
                    if r is not None and x0 < r < x1 and y0 < r <= y1:
                        ok = False
                        break
                if not ok:
                    break
            self.follows[k] = ok
        return ok

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """Ids of distinct words; ``last[i]`` is the last token of the encoding of the first i bytes on the current path."""
        out: dict[bytes, list[int]] = {}
        get, tokens, longest = self.ranks.get, self.tokens, self.longest
        before, last = b"", [-1]
        for w in sorted(words):
            same = 0
            for x, y in zip(before, w):
                if x != y:
                    break
                same += 1
            del last[same + 1 :]
            for i in range(same + 1, len(w) + 1):
                for j in range(max(0, i - longest), i):
                    t = get(w[j:i])
                    if t is not None and (self.may_follow(last[j], t) if j else self.stands(t)):
                        last.append(t)
                        break
            before, ids, i = w, [], len(w)
            while i:
                t = last[i]
                ids.append(t)
                i -= len(tokens[t])
            ids.reverse()
            out[w] = ids
        return out

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, flat ids) of the texts, special tokens being ordinary text."""
        if len(self.index) > WORDS_KEPT:
            self.forget()
        split = [(self.ascii if t.isascii() else self.unicode).findall(t) for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        index = self.index
        new = {w for ws in split for w in ws if w not in index} if split else set()
        # what UTF-8 can't hold is replaced before; distinct words stay distinct as bytes
        by_bytes = {w.encode("utf-8", "replace"): w for w in new}
        for b, ids in self.encode_words(by_bytes).items():
            index[by_bytes[b]] = len(self.spans) - 1
            self.flat.extend(ids)
            self.spans.append(len(self.flat))
        words = np.fromiter((index[w] for ws in split for w in ws), np.int64, int(counts.sum()))
        spans, flat = np.asarray(self.spans, np.int64), np.asarray(self.flat, np.int32)
        start, size = spans[words], spans[words + 1] - spans[words]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(start - (ends - size), size) + np.arange(total)]
        upto = np.concatenate([[0], np.cumsum(counts)])
        return np.concatenate([[0], ends])[upto], ids


_ENCODERS: dict[int, TrieEncoder] = {}


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    at, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > CHARS_AT_ONCE:
            yield at, i
            at, held = i, 0
        held += len(t)
    yield at, len(texts)


def _encoding(raw, lengths_only: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = raw.value
        encoder = _ENCODERS.get(hash(data))
        if encoder is None:
            _ENCODERS.clear()
            encoder = _ENCODERS[hash(data)] = TrieEncoder(vocabulary(data))
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i, j in _slices(texts):
                offsets, ids = encoder.encode_texts(texts[i:j])
                out = pa.array(np.diff(offsets)) if lengths_only else pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), out], ["key", "n" if lengths_only else "ids"])

    return run


def _vocabulary_of(df: DataFrame, file: str | None):
    path = file or os.path.join(TOKENIZERS, DEFAULT)
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: under 2 MB whatever the data


def encode(df: DataFrame, key: str, text: str, file: str | None = None) -> DataFrame:
    """(key, ids) of every row: its text in tokens of a rank file, without special tokens.

    Empty and null texts give an empty list; look-alikes of special tokens are ordinary text; repeated rows come out
    repeated. Only the two named columns are read. No shuffle.
    """
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(_encoding(_vocabulary_of(df, file), False), f"key {kind}, ids array<int>")


def token_counts(df: DataFrame, key: str, text: str, file: str | None = None) -> DataFrame:
    """(key, n) of every row: the number of tokens of its text, 0 where it is null or empty."""
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(_encoding(_vocabulary_of(df, file), True), f"key {kind}, n long")

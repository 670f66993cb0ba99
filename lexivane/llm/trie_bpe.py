"""Encoding by a byte-level BPE vocabulary through a depth-first traversal of the trie of distinct words.

Any prefix of a word has one last token that its encoding ends with, and the encoding of a word is the chain
of last tokens back to its start. So a state of the trie is one number, and words that share a prefix share its states.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Classes of bytes and code points.
OTHER, LETTER, NUMBER, SPACE, FOLLOWS = 0, 1, 2, 3, 4
#: Bytes of text that one round of words is taken from: bounds the memory of a task whatever the size of a batch.
ROUND_BYTES = 8 << 20
#: Distinct words kept between rounds; beyond it the store starts anew (it saves time only).
STORE_WORDS = 1 << 19


@lru_cache(1)
def code_point_classes() -> np.ndarray:
    import regex

    out = np.zeros(0x110000, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            out[a : b + 1] = kind
    out[0xD800:0xE000] = OTHER
    return out


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that begins at each byte of valid UTF-8; FOLLOWS for the other bytes of a character."""
    table = code_point_classes()
    out = table[:128][data & 127]
    high = np.flatnonzero(data >= 128)
    if high.size:
        out[high] = FOLLOWS
        lead = high[data[high] >= 0xC0]
        b0 = data[lead].astype(np.int32)
        last = len(data) - 1
        b1, b2, b3 = (data[np.minimum(lead + i, last)].astype(np.int32) & 63 for i in (1, 2, 3))
        point = np.where(
            b0 < 0xE0, (b0 & 31) << 6 | b1, np.where(b0 < 0xF0, (b0 & 15) << 12 | b1 << 6 | b2, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3)
        )
        out[lead] = table[point]
    return out


def word_starts(data: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Offsets at which a word of the splitting pattern begins; data holds texts one after the other from doc_starts on.

    The pattern, as rules on runs of one class: a run of letters, of numbers or of other signs is a word and takes one space
    before it; a run of white space is a word without its last sign if something follows, and that sign, if it
    isn't a space, is one by itself; an apostrophe that begins a word makes a word with s, t, m, d, re, ve or ll after it.
    """
    n = len(data)
    kind = byte_classes(data)
    first = np.flatnonzero(kind != FOLLOWS)  # where characters begin
    k = kind[first]
    head = np.zeros(len(first), bool)
    doc = np.zeros(n + 1, bool)
    doc[doc_starts] = True
    doc = doc[:n][first]
    head[0:1] = True
    head[1:] = k[1:] != k[:-1]
    head |= doc
    space = k == SPACE
    ends = np.append(head[1:], True)  # the run ends here
    inner = np.append(doc[1:], True)  # the text ends here
    lone = space & ends & ~inner  # last sign of white space before another run of the same text
    start = head.copy()
    start[lone] = True
    plain = lone & (data[first] == 32)
    after = np.flatnonzero(plain) + 1
    start[after] = False  # the space belongs to the run after it
    quote = np.flatnonzero(head & (data[first] == 39))
    quote = quote[start[quote]] if quote.size else quote  # no space before it
    if quote.size:
        at = first[quote]
        stop = np.append(doc_starts[1:], n)[np.searchsorted(doc_starts, at, "right") - 1]
        c1 = np.where(at + 1 < stop, data[np.minimum(at + 1, n - 1)], 0)
        c2 = np.where(at + 2 < stop, data[np.minimum(at + 2, n - 1)], 0)
        one = np.isin(c1, np.frombuffer(b"stmd", np.uint8))
        two = ((c1 == 114) & (c2 == 101)) | ((c1 == 118) & (c2 == 101)) | ((c1 == 108) & (c2 == 108))
        for which, size in ((one, 1), (two, 2)):
            q = quote[which]
            start[q + 1] = False
            nxt = q + 1 + size
            nxt = nxt[nxt < len(first)]
            start[nxt] = True
            # a space that was to join the letters' run stays as it was: the letters after the cut are a word of their own
    return first[start]


class Vocabulary:
    """Tokens by rank, with the pair each was merged from."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in f)]
        self.rank = dict(ranks)
        size = max(self.rank.values()) + 1
        self.left, self.right = list(range(size)), list(range(size))
        self.pairs: dict[tuple[int, int], int] = {}
        self.fits: dict[int, bool] = {}
        tails: dict[bytes, set[int]] = {}
        for token in self.rank:
            if len(token) > 2:
                tails.setdefault(token[-3:], set()).add(len(token))
        #: By its last three bytes, the sizes a token can have, the largest first; two and one are always tried.
        self.sizes = {tail: (*sorted(sizes, reverse=True), 2, 1) for tail, sizes in tails.items()}
        for token, r in sorted(ranks, key=lambda x: x[1]):
            if len(token) == 1:
                continue
            for i in range(1, len(token)):
                a, b = self.rank.get(token[:i]), self.rank.get(token[i:])
                if a is not None and b is not None and a < r and b < r and self.stay_apart(a, b):
                    self.left[r], self.right[r] = a, b
                    self.pairs[a, b] = r
                    break
        self.fits.clear()

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether a followed by b is encoded as just a, b: no merge across their border comes before those within them.

        Both are taken apart in the order opposite to that of their merges, the later merge first; at each
        stage the two that touch must not merge before the stage's own merge would have taken place.
        """
        before = sys.maxsize
        while True:
            if self.pairs.get((a, b), before) < before:
                return False
            whole_a, whole_b = self.left[a] == a, self.left[b] == b
            if whole_a and whole_b:
                return True
            if whole_b or (not whole_a and a > b):
                before, a = a, self.right[a]
            else:
                # a merge of equal rank further left comes first, so the one across the border may still tie
                before, b = b + 1, self.left[b]

    def may_follow(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 1 << 20:
                self.fits.clear()
            known = self.fits[key] = self.stay_apart(a, b)
        return known

    def encode_sorted(self, words: list[bytes]) -> list[list[int]]:
        """The ids of words, which must be sorted: their order is the depth-first order of their trie, and the stack holds the
        last token and its length for each prefix of the word at hand."""
        rank, fits, apart, sizes, short = self.rank, self.fits, self.may_follow, self.sizes, (2, 1)
        lengths: list[int] = [0]
        tokens: list[int] = [-1]
        out, before = [], b""
        for word in words:
            n = len(word)
            shared, most = 0, min(n, len(before))
            if word[:most] == before[:most]:
                shared = most
            else:
                while word[shared] == before[shared]:
                    shared += 1
            del lengths[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, n + 1):
                for size in sizes.get(word[end - 3 : end], short) if end > 2 else short:
                    if size > end:
                        continue
                    t = rank.get(word[end - size : end])
                    if t is None:
                        continue
                    if size == end:
                        break
                    u = tokens[end - size]
                    ok = fits.get(u << 32 | t)
                    if ok or (ok is None and apart(u, t)):
                        break
                lengths.append(size)
                tokens.append(t)
            ids, at = [], n
            while at:
                ids.append(tokens[at])
                at -= lengths[at]
            ids.reverse()
            out.append(ids)
            before = word
        return out


class Encoder:
    """Words to ids, with a store of the words met so far."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.offsets, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def _add(self, words: list[bytes]) -> None:
        words.sort()
        ids = self.vocabulary.encode_sorted(words)
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        total, n = int(sizes.sum()), len(self.known)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(words) > len(self.sizes):
            self.sizes, self.offsets = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sizes, self.offsets))
        self.flat[self.used : self.used + total] = np.fromiter((t for x in ids for t in x), np.int32, total)
        self.sizes[n : n + len(words)] = sizes
        self.offsets[n : n + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.used += total
        self.known.update(zip(words, range(n, n + len(words))))

    def numbers(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The store's number of each word of data."""
        n, m = len(data), len(starts)
        offsets = pa.py_buffer(np.append(starts, n).astype(np.int32))
        words = pa.Array.from_buffers(pa.binary(), m, [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        if len(self.known) + len(distinct) > STORE_WORDS:
            self.forget()
        self._add([w for w in distinct if w not in self.known])
        known = self.known
        return np.fromiter((known[w] for w in distinct), np.int64, len(distinct))[words.indices.to_numpy()]

    def encode(self, texts: pa.Array, want_ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """The number of tokens of each text, and all ids one after the other. Null and empty texts have none."""
        counts = np.zeros(len(texts), np.int64)
        ids: list[np.ndarray] = []
        size = np.asarray(pc.binary_length(texts).fill_null(0)).astype(np.int64)
        rounds = np.searchsorted(np.cumsum(size), np.arange(0, size.sum(), ROUND_BYTES), "left")
        bounds = np.unique(np.append(rounds, len(texts)))
        bounds = np.unique(np.append(0, bounds))
        for a, b in zip(bounds[:-1], bounds[1:]):
            own = np.flatnonzero(size[a:b]) + a
            if not own.size:
                continue
            data = np.frombuffer(b"".join(texts.take(pa.array(own)).cast(pa.binary()).to_pylist()), np.uint8)
            docs = np.cumsum(size[own]) - size[own]
            starts = word_starts(data, docs)
            number = self.numbers(data, starts)
            length = self.sizes[number].astype(np.int64)
            counts[own] = np.add.reduceat(length, np.searchsorted(starts, docs))
            if want_ids:
                end = np.cumsum(length)
                source = np.repeat(self.offsets[number] - (end - length), length) + np.arange(end[-1])
                ids.append(self.flat[source])
        return counts, (np.concatenate(ids) if ids else np.zeros(0, np.int32)) if want_ids else None


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_texts(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ranks: str = DEFAULT_RANKS, ids: bool = True) -> DataFrame:
    """keep and the token ids (ids ARRAY<INT>), or only their number (n_tokens BIGINT), of each row of df.

    ranks: a file of base64 tokens and ranks at the same path on every executor. Nothing is shuffled: each task splits its
    texts into words, encodes the distinct ones through their trie, and puts the ids together again. Texts are
    taken whole; null and empty ones have no ids. Strings of special tokens are ordinary text. Rows keep their
    multiplicity. Columns besides keep and text are ignored.
    """
    field = df.select(*keep).schema
    out = "ids array<int>" if ids else "n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks)
        for b in batches:
            counts, flat = enc.encode(b.column(len(keep)), ids)
            if ids:
                offsets = np.zeros(len(counts) + 1, np.int32)
                np.cumsum(counts, out=offsets[1:])
                made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            else:
                made = pa.array(counts)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], made], names=[*keep, out.split()[0]])

    col: Column = F.col(text).alias("__text")
    return df.select(*keep, col).mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in field), out]))

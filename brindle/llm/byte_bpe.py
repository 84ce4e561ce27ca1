"""Byte-level BPE encoding and decoding with a vectorised pre-tokeniser, for files of ranks.

Pre-tokenisation finds the matches of ``PATTERN`` without a regular expression. Every code point has a class; every class is
a function on the ten states of a small automaton, and all products of these functions are numbered (there are a few dozen).
A table composes two of them. Composition is associative, so the prefix products of a whole batch of texts are found by a
blocked scan: within blocks side by side, over the blocks' totals by the same scan, then both together. The states before,
at and after a code point tell whether a match starts there. A code point of class END parts the texts of a batch.

Each match is merged by ranks, as tiktoken does it (lowest rank first, the leftmost of equals), and kept in a bounded table of
matches. The start byte of every token is kept beside the ids; decoding gathers the tokens' bytes by both, so any range of
tokens can be decoded by itself.

Which code points are letters, numbers and white space is asked of the tiktoken library itself, once per worker, since its
edition of Unicode is newer than Python's.

Nulls: a null text is an empty one, with no token; a null key stays null. Repeated rows give repeated results. Very long texts
are a batch of their own, and long matches merge in n log n steps. Strings of special tokens are ordinary text. An empty table
gives no row. Other columns may have any name.
"""

from __future__ import annotations

import heapq
from base64 import b64decode
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_of

#: The pattern that the automaton stands for; tests hold both against each other.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Classes of code points. APOSTROPHE may begin an ending, which ONE completes, and R_V with E, or two of ELL.
END, BLANK, WHITE, LETTER, NUMBER, OTHER, APOSTROPHE, ONE, R_V, ELL, E = range(11)
_LETTERS = (LETTER, ONE, R_V, ELL, E)
# States, each named by what has been read. MARK is an apostrophe at the start of a match; after ENDING a match has ended.
(NONE, WORD, DIGITS, SIGNS, SPACE, WIDE, MARK, MARK_R_V, MARK_L, ENDING) = range(10)
_STATES = 10
#: Code points that are pre-tokenised at once, and the length of the scan's blocks.
BATCH_POINTS = 1 << 18
BLOCK = 256
#: Matches that a worker keeps, some 40 MB.
KEPT = 3 << 16
#: Bytes of a match up to which its pairs are looked through again and again.
SHORT = 64


def _next(state: int, kind: int) -> int:
    if kind == END:
        return NONE
    if kind in (BLANK, WHITE):
        return SPACE if kind == BLANK else WIDE
    if kind == NUMBER:
        return DIGITS
    if kind == OTHER or kind == APOSTROPHE and state in (SIGNS, SPACE, MARK):
        return SIGNS
    if kind == APOSTROPHE:
        return MARK
    if state == MARK and kind in (ONE, R_V, ELL):
        return {ONE: ENDING, R_V: MARK_R_V, ELL: MARK_L}[kind]
    return ENDING if (state, kind) in ((MARK_R_V, E), (MARK_L, ELL)) else WORD


def _starts(before: int, state: int, after: int) -> bool:
    """Whether a match starts at a code point, by the states before it, at it and after it. The end of a text counts too."""
    white = (SPACE, WIDE)
    if state == NONE or state == MARK:
        return True
    if state in white:  # of a run, the last one stands alone, or with what follows it, unless the text ends there
        return before not in white or after not in (*white, NONE)
    if state == DIGITS:
        return before not in (DIGITS, SPACE)
    if state == SIGNS:
        return before not in (SIGNS, SPACE, MARK)
    if state == WORD:
        return before not in (WORD, SPACE, MARK_R_V, MARK_L)
    return state != ENDING and after != ENDING  # a letter after an apostrophe begins a word if no ending comes of it


def _products() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All products of the classes' functions: their values by state, their composition, and the classes' own numbers."""
    classes = [tuple(_next(s, k) for s in range(_STATES)) for k in range(11)]
    found = {tuple(range(_STATES)): 0}  # the identity comes first
    queue = list(found)
    while queue:
        f = queue.pop()
        for g in classes:
            if (h := tuple(g[x] for x in f)) not in found:
                found[h] = len(found)
                queue.append(h)
    values = list(found)
    compose = np.array([[found[tuple(g[x] for x in f)] for g in values] for f in values], np.uint16)
    return np.array(values, np.uint8), compose, np.array([found[c] for c in classes], np.uint16)


_VALUES, _COMPOSE, _OF_CLASS = _products()
_MANY = np.uint16(len(_VALUES))
_FLAT = _COMPOSE.reshape(-1)
_START = np.array([[[_starts(b, s, a) for a in range(_STATES)] for s in range(_STATES)] for b in range(_STATES)], bool).reshape(-1)


def prefix_products(functions: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The composition of all functions up to each place, by their numbers."""
    n = len(functions)
    if n <= 1:
        return functions.copy()
    block = min(block, n)
    rows = -(-n // block)
    laid = np.zeros(rows * block, np.uint16)
    laid[:n] = functions
    inside = np.ascontiguousarray(laid.reshape(rows, block).T)  # a row holds the same place of every block
    for j in range(1, block):
        inside[j] = _FLAT[inside[j - 1] * _MANY + inside[j]]
    if rows > 1:
        before = np.zeros(rows, np.uint16)
        before[1:] = prefix_products(inside[-1], block)[:-1]
        inside = _FLAT[before * _MANY + inside]
    return inside.T.reshape(-1)[:n]


_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of each code point."""
    global _classes
    if _classes is None:
        points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        single = {bytes([b]): b for b in range(256)}
        table = np.full(0x110000, OTHER, np.uint8)
        for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", WHITE)):
            found = bytes(tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(points)).decode()
            table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
        for marks, kind in ((" ", BLANK), ("'", APOSTROPHE), ("stmd", ONE), ("rv", R_V), ("l", ELL), ("e", E)):
            table[[ord(c) for c in marks]] = kind
        _classes = table
    return _classes


def boundaries(texts: list[str]) -> list[list[int]]:
    """Of each text, the starts of its matches and its end."""
    points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(x) + 1 for x in texts]) - 1
    kinds = classes()[points]
    kinds[ends] = END
    states = np.zeros(len(points) + 2, np.uint16)
    states[1:-1] = _VALUES[:, NONE][prefix_products(_OF_CLASS[kinds])]
    at = np.flatnonzero(_START[(states[:-2] * np.uint16(_STATES) + states[1:-1]) * np.uint16(_STATES) + states[2:]])
    first = np.searchsorted(at, ends - [len(x) for x in texts])
    return [(at[i : j + 1] - (e - len(x))).tolist() for x, e, i, j in zip(texts, ends, first, np.searchsorted(at, ends), strict=True)]


class Codec(dict):
    """Matches to their ids as little-endian unsigned 32-bit integers. One per Python worker and file; see codec()."""

    def __init__(self, path: str, kept: int = KEPT) -> None:
        super().__init__()
        with open(path, "rb") as lines:
            self.ranks = {b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
        self.kept = kept
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.places = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)

    def __missing__(self, match: str) -> bytes:
        ids = np.array(self.merged(match.encode("utf-8", "replace")), "<u4").tobytes()
        if len(self) < self.kept and len(match) <= SHORT:
            self[match] = ids
        return ids

    def merged(self, match: bytes) -> list[int]:
        """Ids of one match: the neighbours of lowest rank join first, the leftmost of equals."""
        whole = self.ranks.get(match)
        if whole is not None:
            return [whole]
        return self._short(match) if len(match) <= SHORT else self._long(match)

    def _short(self, match: bytes) -> list[int]:
        """Looks through all pairs again for each join, which is quicker for a word."""
        rank_of, never = self.ranks.get, len(self.tokens)
        parts = [match[i : i + 1] for i in range(len(match))]
        pairs = [rank_of(match[i : i + 2], never) for i in range(len(match) - 1)]
        while pairs and (low := min(pairs)) < never:
            i = pairs.index(low)
            del pairs[i]
            joined = parts[i] = self.tokens[low]
            del parts[i + 1]
            if i < len(pairs):
                pairs[i] = rank_of(joined + parts[i + 1], never)
            if i:
                pairs[i - 1] = rank_of(parts[i - 1] + joined, never)
        return [self.ranks[p] for p in parts]

    def _long(self, match: bytes) -> list[int]:
        """Keeps the pairs in a heap."""
        n = len(match)
        right = list(range(1, n + 1))  # the end of the part that starts here; 0 where none does
        left = list(range(-1, n - 1))  # the start of the part before
        heap: list[tuple[int, int, int]] = []

        def offer(a: int) -> None:
            b = right[a]
            if b < n and (rank := self.ranks.get(match[a : right[b]])) is not None:
                heapq.heappush(heap, (rank, a, right[b]))

        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, end = heapq.heappop(heap)
            b = right[a]
            if not b or b == n or right[b] != end:
                continue  # one of both has joined another part since
            right[a], right[b] = end, 0
            if end < n:
                left[end] = a
            offer(a)
            if left[a] >= 0:
                offer(left[a])
        return [self.ranks[match[a : right[a]]] for a in range(n) if right[a]]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of whole texts."""
        out = []
        for text, at in zip(texts, boundaries(texts), strict=True):
            out.append(np.frombuffer(b"".join(map(self.__getitem__, map(text.__getitem__, map(slice, at, at[1:])))), "<u4"))
        return out

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """The first byte of each token, and the end."""
        return np.concatenate([[0], np.cumsum(self.lengths[ids])])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The bytes of tokens, by their offsets; both may be a slice of a text's."""
        sizes = np.diff(offsets)
        if not np.array_equal(sizes, self.lengths[ids]):
            raise ValueError("offsets don't belong to these ids")
        shift = np.repeat(self.places[ids] - (offsets[:-1] - offsets[0]), sizes)
        return self.bytes[shift + np.arange(len(shift))]


_codecs: dict[tuple[str, int], Codec] = {}


def codec(path: str, kept: int = KEPT) -> Codec:
    """The worker's codec for a file of ranks."""
    if (path, kept) not in _codecs:
        _codecs[path, kept] = Codec(path, kept)
    return _codecs[path, kept]


def grouped(texts: list[str], points: int = BATCH_POINTS) -> Iterator[list[str]]:
    """Texts in order, in groups of about so many code points."""
    group, held = [], 0
    for x in texts:
        if group and held + len(x) > points:
            yield group
            group, held = [], 0
        group.append(x)
        held += len(x) + 1
    if group:
        yield group


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{key}`").cast("long").alias("__key"), text_of(text).alias("__text"))


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", kept: int = KEPT) -> DataFrame:
    """key, n_tokens, ids and offsets (little-endian unsigned 32-bit integers; the last offset is the end) of whole texts."""

    def run(b: dict) -> dict:
        own = codec(path, kept)
        ids = [x for group in grouped(b["__text"].to_pylist()) for x in own.encode(group)]
        return {"key": b["__key"], "n_tokens": [len(x) for x in ids], "ids": [x.tobytes() for x in ids], "offsets": [own.offsets(x).astype("<u4").tobytes() for x in ids]}

    return map_batches(_rows(docs, key, text), run, "key long, n_tokens long, ids binary, offsets binary").withColumnRenamed("key", key)


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """key and the text of rows of encode()."""

    def run(b: dict) -> dict:
        own = codec(path)
        pairs = zip(b["ids"].to_pylist(), b["offsets"].to_pylist(), strict=True)
        return {"key": b["key"], "text": [own.decode(np.frombuffer(i, "<u4"), np.frombuffer(o, "<u4").astype(np.int64)).tobytes().decode() for i, o in pairs]}

    return map_batches(encoded.withColumnRenamed(key, "key"), run, "key long, text string").withColumnRenamed("key", key)


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", kept: int = KEPT) -> DataFrame:
    """key, n_tokens and checksums of the ids and of what they decode to. Texts are encoded and decoded in one pass, since a
    second one would hold the ranks in further Python workers."""

    def run(b: dict) -> dict:
        own, out = codec(path, kept), []
        for group in grouped(b["__text"].to_pylist()):
            for ids in own.encode(group):
                out.append((len(ids), sha256(ids.tobytes()).hexdigest(), sha256(own.decode(ids, own.offsets(ids)).tobytes()).hexdigest()))
        return {"key": b["__key"]} | {n: [r[k] for r in out] for k, n in enumerate(("n_tokens", "ids_sha256", "decoded_sha256"))}

    return map_batches(_rows(docs, key, text), run, "key long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)

"""Token counts of the sections of a document, from one encoding of the whole document.

A byte-level tokenizer (tiktoken, from a file of ranks) encodes the whole text once; as its tokens are the text's bytes in
order, their lengths give each token's character offsets, which are joined to the spans of the text's sections as intervals. A token that lies in several sections counts for the one that holds most of its characters,
and of equals for the earliest (rule "majority"), or for the one where it starts (rule "start"). A token inside a multi-byte
character spans the character.

Sections are sentences: one ends with a line feed, or with the white space after ".", "!" or "?" and closing marks. As a
token takes the blank before its word, the first token of a sentence often crosses the boundary before it.

Strings of special tokens in a text are ordinary text. Nulls: a null or empty text has no section and no token; a null key
stays null. Repeated rows give repeated results. Very
long texts are encoded whole, one at a time. An empty table gives no row. Other columns may have any name.
"""

from __future__ import annotations

import re
from base64 import b64decode

import numpy as np
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_of

_END = re.compile(r"""\n|[.!?]["')\]]*[^\S\n]+""")


def section_starts(text: str) -> np.ndarray:
    """First characters of the sections; the end of the text starts no further one."""
    if not text:
        return np.empty(0, np.int64)
    return np.array([0, *(m.end() for m in _END.finditer(text) if m.end() < len(text))], np.int64)


class Tokenizer:
    """Whole texts to tokens with the characters that they cover."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            ranks = {b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """ids, and of each the first character and the one after the last; of part of a character, that character."""
        ids = np.array(self.encoding.encode_ordinary(text), np.int64)
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        if not text.isascii():
            character = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80) - 1
            starts, ends = character[starts], character[ends - 1] + 1
        return ids, np.stack([starts, ends], axis=1)


_tokenizers: dict[tuple[str, str], Tokenizer] = {}


def tokenizer(path: str, pattern: str) -> Tokenizer:
    """The worker's tokenizer of a file of ranks."""
    if (path, pattern) not in _tokenizers:
        _tokenizers[path, pattern] = Tokenizer(path, pattern)
    return _tokenizers[path, pattern]


def allocate(spans: np.ndarray, starts: np.ndarray, length: int, rule: str = "majority") -> tuple[np.ndarray, int]:
    """The section of each token, and the number of tokens that cross a boundary. Sections follow each other without gaps."""
    first = np.searchsorted(starts, spans[:, 0], "right") - 1
    last = np.maximum(np.searchsorted(starts, spans[:, 1] - 1, "right") - 1, first)
    crossing = np.flatnonzero(first != last)
    out = first.copy()
    if rule == "majority" and len(crossing):
        ends = np.append(starts[1:], length)
        among = (last - first + 1)[crossing]
        token = np.repeat(crossing, among)
        begin = np.cumsum(among) - among
        section = first[token] + np.arange(len(token)) - np.repeat(begin, among)
        held = np.minimum(ends[section], spans[token, 1]) - np.maximum(starts[section], spans[token, 0])
        best = np.repeat(np.maximum.reduceat(held, begin), among)
        out[crossing] = np.minimum.reduceat(np.where(held == best, section, len(starts)), begin)
    elif rule not in ("majority", "start"):
        raise ValueError(f"unknown rule {rule!r}")
    return out, len(crossing)


def attribute(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", rule: str = "majority") -> DataFrame:
    """Per row: key, n_tokens, n_sections, n_crossing and section_tokens, which sum to n_tokens."""

    def run(b: dict) -> dict:
        spans_of = tokenizer(path, pattern).spans
        out: dict[str, list] = {"key": b["__key"], "n_tokens": [], "n_sections": [], "n_crossing": [], "section_tokens": []}
        for x in b["__text"].to_pylist():
            (_, spans), starts = spans_of(x), section_starts(x)
            owner, crossing = allocate(spans, starts, len(x), rule)
            out["n_tokens"].append(len(spans))
            out["n_sections"].append(len(starts))
            out["n_crossing"].append(crossing)
            out["section_tokens"].append(np.bincount(owner, minlength=len(starts)).astype(np.int32))
        return out

    frame = docs.select(F.col(f"`{key}`").cast("long").alias("__key"), text_of(text).alias("__text"))
    return map_batches(frame, run, "key long, n_tokens long, n_sections int, n_crossing int, section_tokens array<int>").withColumnRenamed("key", key)


def sections(attributed: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per section: key, section number, tokens."""
    return attributed.select(key, F.posexplode("section_tokens").alias("section", "tokens"))

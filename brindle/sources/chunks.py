"""Structural chunks: pieces of a page under one path of headings, up to a budget of tokens, and its tables row by row.

Markdown is read with a stack of headings. A block of its own is a piece; one beyond the budget is cut at sentences, then at
words, and a table at rows with its header repeated. Neighbours of one path are joined while they fit. A chunk's text begins
with its path, which counts. Then the page's extracted tables are woven in: where a chunk holds a table, what isn't table
stays, and the rows of the first unused table that it matches follow, each a chunk with title, units, header and footnotes.
Tables that match nothing come last. Chunks are numbered over all.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from brindle.operators.search import ranked_encoding
from brindle.sources import tables

BUDGET = 512
SCHEMA = "doc_key string, chunk_index int, kind string, section string, chunk_text string, token_count int, table_index int, row_label string"
Counter = Callable[[str], int]

_ITEM = re.compile(r"\bItem\s+[\dA-Z.]+\b", re.IGNORECASE)
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def count_words(text: str) -> int:
    """Words and marks, one at least: a counter that needs no vocabulary."""
    return max(1, len(re.findall(r"\w+|[^\w\s]", text)))


def token_counter(path: str, pattern: str) -> Counter:
    """Tokens of a file of ranks, one at least; strings of special tokens are text."""
    return lambda text: max(1, len(ranked_encoding(path, pattern).encode_ordinary(text)))


def pieces(markdown: str) -> Iterator[tuple[tuple[str, ...], str]]:
    """Heading path and text of each block."""
    path: list[tuple[int, str]] = []
    for block in re.split(r"\n{2,}", markdown.strip()):
        if m := re.match(r"(#{1,6})\s+(.*)", block):
            path = [h for h in path if h[0] < len(m[1])] + [(len(m[1]), m[2].strip())]
            block = block[m.end() :].strip()
        if block.strip():
            yield tuple(h for _, h in path), block


def is_table(text: str) -> bool:
    return all(line.startswith("|") for line in text.splitlines())


def _packed(parts: list[str], glue: str, fits: Callable[[str], bool], lead: str = "") -> Iterator[str]:
    """Parts joined as far as they fit, each behind the lead; a single part may be too long."""
    held: list[str] = []
    for part in parts:
        if held and not fits(lead + glue.join([*held, part])):
            yield lead + glue.join(held)
            held = []
        held.append(part)
    if held:
        yield lead + glue.join(held)


def _cut(text: str, fits: Callable[[str], bool]) -> Iterator[str]:
    if fits(text):
        yield text
    elif is_table(text) and len(lines := text.splitlines()) > 3:
        yield from _packed(lines[2:], "\n", fits, "\n".join(lines[:2]) + "\n")
    else:
        for sentence in _packed(_SENTENCE.split(text), " ", fits):
            yield from [sentence] if fits(sentence) else _packed(sentence.split(" "), " ", fits)


def heading_chunks(markdown: str, budget: int = BUDGET, count: Counter = count_words) -> list[tuple[tuple[str, ...], str]]:
    """Path and text of each chunk; path and text together stay within the budget, but for a single word beyond it."""
    out: list[tuple[tuple[str, ...], str]] = []
    for path, block in pieces(markdown):
        fits = lambda text, path=path: count("\n".join([*path, text])) <= budget
        for text in _cut(block, fits):
            if out and out[-1][0] == path and not is_table(text) and not is_table(out[-1][1]) and fits(out[-1][1] + "\n" + text):
                out[-1] = (path, out[-1][1] + "\n" + text)
            else:
                out.append((path, text))
    return out


def section(path: tuple[str, ...], text: str) -> str | None:
    """The path, else the first item number in the text."""
    found = _ITEM.search(text)
    return " > ".join(path) or (found[0] if found else None)


def matches(text: str, table: dict) -> bool:
    """Whether the label or a value of a table's first row is in a text."""
    first = table["rows"][0]
    return bool(first["label"]) and first["label"] in text or any(c["text"].strip("$") in text for c in first["cells"] if c["text"])


def row_text(table: dict, row: dict) -> str:
    head = [table["title"] or f"Table {table['table_index'] + 1}", *([f"Units: {table['units']}"] if table["units"] else [])]
    return "\n".join([*head, tables.table_markdown(table["columns"], [row], []), *table["footnotes"]])


def woven(html: str | None, budget: int = BUDGET, count: Counter = count_words) -> list[dict]:
    """All chunks of a page."""
    every = tables.blocks(html)
    left = tables.extract(html, every)
    out: list[dict] = []

    def add(kind: str, sect: str | None, text: str, table: int | None = None, label: str | None = None) -> None:
        out.append({"chunk_index": len(out), "kind": kind, "section": sect, "chunk_text": text, "token_count": count(text), "table_index": table, "row_label": label})

    def add_rows(table: dict) -> None:
        for row in table["rows"]:
            add("table_row", table["title"], row_text(table, row), table["table_index"], row["label"])

    for path, text in heading_chunks(tables.to_markdown(html, every), budget, count):
        whole = "\n".join([*path, text])
        if not is_table(text):
            add("narrative", section(path, whole), whole)
            continue
        rest = "\n".join(path)
        if rest:
            add("narrative", section(path, rest), rest)
        found = next((t for t in left if matches(whole, t)), None)
        if found:
            left.remove(found)
            add_rows(found)
    for table in left:
        add_rows(table)
    return out


def structural_chunks(docs: DataFrame, key: str, html: str, budget: int = BUDGET, count: Counter = count_words) -> DataFrame:
    """One row for each chunk of each page."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start in range(0, len(b), tables.PAGES):
                part = b.iloc[start : start + tables.PAGES]
                rows = [{"doc_key": str(k)} | c for k, h in zip(part[key], part[html], strict=True) for c in woven(h, budget, count)]
                yield pd.DataFrame(rows, columns=names).astype({"table_index": "Int32"})

    return docs.select(key, html).mapInPandas(run, SCHEMA)


def markdown_of(docs: DataFrame, key: str, html: str) -> DataFrame:
    """key and the Markdown of each page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"k": b[key], "markdown": b[html].map(tables.to_markdown)})

    return docs.select(key, html).mapInPandas(run, "k long, markdown string").withColumnRenamed("k", key)

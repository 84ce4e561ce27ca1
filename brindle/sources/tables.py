"""Pages of filings as blocks in reading order: headings, paragraphs, list items and tables.

Tables become a grid first: each cell takes the places that its colspan and rowspan say, next to those that cells above take,
so that every place knows its cell. Rows are then read as labels and values, with the inline facts of each value's cells.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from hashlib import sha256
from html import unescape
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

FACT = "struct<name:string,context_ref:string,unit_ref:string,decimals:string,scale:string,fact_id:string,value:string>"
SCHEMA = f"doc_key string, table_index int, title string, units string, columns array<string>, rows array<struct<label:string,cells:array<struct<text:string,facts:array<{FACT}>>>>>, footnotes array<string>, markdown string, source_html_hash string"
_STRINGS = pa.list_(pa.string())
_FACT = pa.struct([(n, pa.string()) for n in ("name", "context_ref", "unit_ref", "decimals", "scale", "fact_id", "value")])
_ROW = pa.struct([("label", pa.string()), ("cells", pa.list_(pa.struct([("text", pa.string()), ("facts", pa.list_(_FACT))])))])
#: SCHEMA, as Arrow's.
ARROW = pa.schema([("doc_key", pa.string()), ("table_index", pa.int32()), ("title", pa.string()), ("units", pa.string()), ("columns", _STRINGS), ("rows", pa.list_(_ROW)), ("footnotes", _STRINGS), ("markdown", pa.string()), ("source_html_hash", pa.string())])
#: So many blocks before and after a table, up to the next table, say what it is.
NEAR = 4
#: The tables of so many pages are held at once.
PAGES = 64

#: What counts as an amount, a footnote and a statement of units.
AMOUNT = re.compile(r"^\(?\$?[\d,]+(?:\.\d+)?\)?$")
SHARE = re.compile(r"^\(?\d+\)?%?$")
NOTE = re.compile(r"^\(\d+\)")
UNITS = re.compile(r"\(([^)]*(?:million|thousand|billion)[^)]*)\)", re.IGNORECASE)

_BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol section article header footer nav blockquote pre center body html".split())
_SILENT = frozenset(("script", "style", "title", "template"))
_FACTS = frozenset(("ix:nonfraction", "ix:nonnumeric", "nonfraction", "nonnumeric"))
#: Plain markup: start tags whose attributes need no repair, end tags without any. Of other tags and forms nothing is plain.
_PLAIN = re.compile(r"""(/?)([a-zA-Z][a-zA-Z0-9:]*)((?:[ \t\n\r\f]+[a-zA-Z_:][a-zA-Z0-9_:.-]*(?:="[^"&]*"|=[a-zA-Z0-9_.%#-]+)?)*)[ \t\n\r\f]*""")
_ATTRIBUTE = re.compile(r"""[ \t\n\r\f]+([a-zA-Z_:][a-zA-Z0-9_:.-]*)(?:="([^"&]*)"|=([a-zA-Z0-9_.%#-]+))?""")
_PLAIN_TAGS = _BLOCKS | _FACTS | frozenset("table thead tbody tfoot tr td th span b i u em strong small sup sub font a".split())


@dataclass
class Cell:
    colspan: int = 1
    rowspan: int = 1
    parts: list[str] = field(default_factory=list)
    facts: list[dict] = field(default_factory=list)

    @cached_property
    def text(self) -> str:
        return tidy_cell(" ".join(self.parts))


@dataclass
class Block:
    """kind: heading (with its level), text, item or table. A table within a cell is a block of its own; its texts also belong
    to that cell."""

    kind: str
    level: int = 0
    parts: list[str] = field(default_factory=list)
    rows: list[list[Cell]] = field(default_factory=list)

    @cached_property
    def text(self) -> str:
        return plain(" ".join(self.parts))


def plain(text: str) -> str:
    return " ".join(text.split())  # at no-break spaces too


def tidy_cell(text: str) -> str:
    """Dashes as hyphens, no blank after a dollar sign or within brackets around whole numbers."""
    text = plain(text)
    if text in ("–", "—"):
        return "-"
    text = text.replace("$ ", "$")
    return re.sub(r"\( +([\d,]+) +\)", r"(\1)", text) if "( " in text else text


class _Reader(HTMLParser):
    """Blocks of a page. Unclosed cells and rows end with the next one; a table's texts don't reach the block around it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.tables: list[tuple[Block, list[Cell]]] = []  # open ones, the innermost last, each with its open cell
        self.facts: list[dict] = []
        self.silent = 0
        self.current: Block | None = None

    def _begin(self, kind: str, level: int = 0) -> None:
        self.current = Block(kind, level)
        self.blocks.append(self.current)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs} if attrs else {}
        if tag in _SILENT:
            self.silent += 1
        elif tag == "table":
            table = Block("table")
            self.blocks.append(table)
            self.tables.append((table, []))
        elif tag == "tr" and self.tables:
            self.tables[-1][1].clear()
            self.tables[-1][0].rows.append([])
        elif tag in ("td", "th") and self.tables:
            table, cell = self.tables[-1]
            cell[:] = [Cell(_span(a.get("colspan")), _span(a.get("rowspan")))]
            if not table.rows:
                table.rows.append([])
            table.rows[-1].append(cell[0])
        elif tag in _FACTS:
            names = {"name": "name", "context_ref": "contextref", "unit_ref": "unitref", "decimals": "decimals", "scale": "scale", "fact_id": "id"}
            fact = {k: a.get(v) for k, v in names.items()} | {"parts": []}
            self.facts.append(fact)
            for _, cell in self.tables:
                for c in cell:
                    c.facts.append(fact)
        elif not self.tables and tag in _BLOCKS:
            if re.fullmatch("h[1-6]", tag):
                self._begin("heading", int(tag[1]))
            else:
                self._begin("item" if tag == "li" else "text")

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "table" and self.tables:
            self.tables.pop()
            self.current = None
        elif tag in ("td", "th", "tr") and self.tables:
            self.tables[-1][1].clear()
        elif tag in _FACTS and self.facts:
            self.facts.pop()
        elif not self.tables and tag in _BLOCKS:
            self.current = None

    def handle_data(self, data: str) -> None:
        if self.silent or not data.strip():
            return
        for fact in self.facts:
            fact["parts"].append(data)
        if self.tables:
            for _, cell in self.tables:
                for c in cell:
                    c.parts.append(data)
        else:
            if self.current is None:
                self._begin("text")
            self.current.parts.append(data)


def _span(value: str | None) -> int:
    if value is None:
        return 1
    return min(max(int(value), 1), 1000) if value and value.strip().isdigit() else 1


def _plain_tag(inner: str) -> tuple[bool, str, list] | None:
    """Whether it's an end tag, its name and attributes, of what stands between < and >; None if that isn't plain."""
    m = _PLAIN.fullmatch(inner)
    if m is None or (tag := m[2].lower()) not in _PLAIN_TAGS or (m[1] and m[3]):
        return None
    return bool(m[1]), tag, [(name.lower(), quoted or bare) for name, quoted, bare in _ATTRIBUTE.findall(m[3])] if m[3] else []


_BARE = {tag: (tag[0] == "/", tag.lstrip("/"), []) for name in sorted(_PLAIN_TAGS) for tag in (name, f"/{name}")}


def _read_plain(html: str) -> _Reader | None:
    """The reader after a page of plain markup, as the parser would leave it; None for any other page."""
    reader = _Reader()
    data, start, end = reader.handle_data, reader.handle_starttag, reader.handle_endtag
    first, *pieces = html.split("<")
    data(unescape(first))
    for piece in pieces:
        inner, closed, text = piece.partition(">")
        tag = _BARE.get(inner) or _plain_tag(inner)
        if not closed or tag is None:
            return None
        if tag[0]:
            end(tag[1])
        else:
            start(tag[1], tag[2])
        if text:
            data(unescape(text) if "&" in text else text)
    return reader


def blocks(html: str | None) -> list[Block]:
    """Blocks with text, and tables, in reading order. Pages of plain markup are read without the parser, which is slower."""
    reader = _read_plain(html or "")
    if reader is None:
        reader = _Reader()
        reader.feed(html or "")
        reader.close()
    return [b for b in reader.blocks if b.kind == "table" or b.text]


def grid(rows: list[list[Cell]]) -> list[list[Cell | None]]:
    """The cell at every place; None where there is none. A cell that reaches over several places stands at all of them."""
    if all(c.rowspan == 1 for row in rows for c in row):
        return [[c for c in row for _ in range(c.colspan)] for row in rows]
    taken: dict[tuple[int, int], Cell] = {}
    out: list[list[Cell | None]] = []
    for y, row in enumerate(rows):
        x = 0
        for cell in row:
            while (y, x) in taken:
                x += 1
            for below in range(y, min(y + cell.rowspan, len(rows))):
                for at in range(x, x + cell.colspan):
                    taken.setdefault((below, at), cell)
            x += cell.colspan
        width = 1 + max((at for line, at in taken if line == y), default=-1)
        out.append([taken.pop((y, at), None) for at in range(width)])
    return out


def _filled(line: list[Cell | None], above: list[Cell | None] | None) -> list[Cell]:
    """A row's cells with text, each once; of those from above, the label alone belongs to this row too."""
    old = {id(c) for c in above or [] if c}
    out: dict[int, Cell] = {}
    for place, cell in enumerate(line):
        if cell is not None and cell.text and (id(cell) not in old or place == 0):
            out.setdefault(id(cell), cell)
    return list(out.values())


def _amount(cells: list[Cell]) -> tuple[str | None, int]:
    """An amount at the beginning of some cells, with signs that have cells of their own, and the cells it takes."""
    signs = 0
    while signs < len(cells) - 1 and cells[signs].text in ("$", "€", "("):
        signs += 1
    text = "".join(c.text for c in cells[: signs + 1])
    return (text, signs + 1) if signs or text.startswith("$") or AMOUNT.match(text) else (None, 0)


def _change(cells: list[Cell]) -> tuple[str, int]:
    """A share: with its sign, or up to the cell that has the sign; without one, the rest of the row is taken."""
    if cells[0].text.endswith("%") and cells[0].text != "%":
        return cells[0].text, 1
    end = next((i for i, c in enumerate(cells) if c.text == "%"), len(cells))
    if not end:
        return "", 1
    distinct = list(dict.fromkeys(c.text for c in cells[:end]))
    return ("-" if distinct == ["-"] else f"{distinct[0]}%"), min(end + 1, len(cells))


def _row(cells: list[Cell], n: int, changes: bool) -> dict | None:
    """label and n values; None if there are fewer. changes: every second value is a share."""
    if len(cells) < 2:
        return None
    values: list[dict] = []
    at = 1
    while at < len(cells) and len(values) < n:
        if changes and len(values) % 2:
            text, used = _change(cells[at:])
        else:
            text, used = _amount(cells[at:])
            if text is None and not changes:
                text, used = cells[at].text, 1
            while not changes and at + used < len(cells) and cells[at + used].text in ("%", ")", ")%"):
                text, used = text + cells[at + used].text, used + 1
        if not text:
            at += max(used, 1)
            continue
        facts = [{k: v for k, v in f.items() if k != "parts"} | {"value": plain(" ".join(f["parts"]))} for c in cells[at : at + used] for f in c.facts]
        values.append({"text": text, "facts": facts})
        at += used
    return {"label": cells[0].text, "cells": values} if len(values) == n else None


def _columns(header: list[str]) -> tuple[list[str], bool]:
    """The columns' names and whether the table pairs each year's amount with its change."""
    if "Change" in header:
        year, names = None, []
        for text in header:
            if re.fullmatch(r"\d{4}", text):
                year = text
                names.append(f"{year} Sales")
            elif text == "Change" and year:
                names.append(f"{year} Change")
        return ["Category", *names], True
    values_only = re.search(r"\b\d{4}\b", header[0]) or header[0].lower() in ("amount", "value")
    return (["Metric", *header] if values_only else header), False


def read_table(table: Block) -> dict | None:
    """columns and rows; None for a table without two texts, a number, or a row that fits its header."""
    lines = grid(table.rows)
    rows = [_filled(line, lines[i - 1] if i else None) for i, line in enumerate(lines)]
    texts = [c.text for r in rows for c in r]
    if len(texts) < 2 or not any(AMOUNT.match(t) or SHARE.match(t) for t in texts):
        return None
    head = next((i for i, r in enumerate(rows) if len(r) > 1), None)
    if head is None:
        return None
    columns, changes = _columns([c.text for c in rows[head]])
    body = [r for cells in rows[head + 1 :] if (r := _row(cells, len(columns) - 1, changes))]
    return {"columns": columns, "rows": body} if body else None


def pipes(cells: list[str]) -> str:
    return "| " + " | ".join(cells) + " |"


def table_markdown(columns: list[str], rows: list[dict], notes: list[str]) -> str:
    lines = [pipes(columns), pipes(["---"] * len(columns)), *(pipes([r["label"], *(c["text"] for c in r["cells"])]) for r in rows)]
    return "\n".join([*lines, "", *notes] if notes else lines)


def extract(html: str | None, every: list[Block] | None = None) -> list[dict]:
    """The tables of a page with title, units and footnotes from the blocks around each. every: its blocks, if they are there."""
    every, found = blocks(html) if every is None else every, []
    digest = sha256((html or "").encode("utf-8", "surrogatepass")).hexdigest()
    for at, block in enumerate(every):
        if block.kind != "table" or (table := read_table(block)) is None:
            continue
        before, after = [], []
        for texts, places in ((before, range(at - 1, -1, -1)), (after, range(at + 1, len(every)))):
            for i in places:
                if every[i].kind == "table" or len(texts) == NEAR:
                    break
                texts.append(every[i].text)
        units = next((m[1] for t in before if (m := UNITS.search(t))), None)
        title = next((t for t in before if not UNITS.search(t) and not t.lower().startswith("the following table")), None)
        notes = [t for t in after if NOTE.match(t)]
        found.append({"table_index": len(found), "title": title, "units": units, **table, "footnotes": notes, "markdown": table_markdown(table["columns"], table["rows"], notes), "source_html_hash": digest})
    return found


def to_markdown(html: str | None, every: list[Block] | None = None) -> str:
    """A page as Markdown: headings, paragraphs, list items, tables as rows of pipes. every: its blocks, if they are there."""
    out: list[str] = []
    for b in blocks(html) if every is None else every:
        if b.kind == "heading":
            out.append("#" * b.level + " " + b.text)
        elif b.kind == "item":
            out.append("- " + b.text)
        elif b.kind == "text":
            out.append(b.text)
        else:
            lines = [[c.text.replace("|", "\\|") if c and (not i or line[i - 1] is not c) else "" for i, c in enumerate(line)] for line in grid(b.rows)]
            lines = [line for line in lines if any(line)]
            if lines:
                out.append("\n".join([pipes(lines[0]), pipes(["---"] * len(lines[0])), *map(pipes, lines[1:])]))
    return "\n\n".join(out)


def filing_tables(docs: DataFrame, key: str, html: str) -> DataFrame:
    """One row for each table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start in range(0, len(b), PAGES):
                yield pd.DataFrame(_tables_of(b.iloc[start : start + PAGES], key, html), columns=ARROW.names)

    return docs.select(key, html).mapInPandas(run, SCHEMA)


def table_rows(docs: DataFrame, key: str, html: str) -> DataFrame:
    """The same rows by way of Arrow's arrays; nested values of Pandas are made one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, PAGES):
                part = b.slice(start, PAGES)
                rows = _tables_of({key: part.column(0).to_pylist(), html: part.column(1).to_pylist()}, key, html)
                yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in ARROW], schema=ARROW)

    return docs.select(key, html).mapInArrow(run, SCHEMA)


def _tables_of(pages, key: str, html: str) -> list[dict]:
    return [{"doc_key": str(k)} | t for k, h in zip(pages[key], pages[html], strict=True) for t in extract(h)]

"""Tables and chunks of pages: the grid against brute force, every rule of chunking, whole filings."""

import random
from xml.etree import ElementTree

import pandas as pd
import pytest

from brindle.plans import catalog, texts
from brindle.sources import chunks, tables

SF = "/root/testdata/sf0.001"


def one(html):
    return tables.extract(html)[0]


def texts_of(table):
    return [(r["label"], *(c["text"] for c in r["cells"])) for r in table["rows"]]


def test_grid_by_brute_force():
    """Places are taken one by one, with a second parser."""
    rng = random.Random(1)
    for _ in range(300):
        rows = [[(rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 1, 2, 4])) for _ in range(rng.randint(0, 4))] for _ in range(rng.randint(1, 6))]
        n = iter(range(10_000))
        html = "<table>" + "".join("<tr>" + "".join(f'<td colspan="{c}" rowspan="{r}">x{next(n)}</td>' for c, r in row) + "</tr>" for row in rows) + "</table>"
        taken = {}
        for y, tr in enumerate(ElementTree.fromstring(html)):
            for td in tr:
                x = next(i for i in range(1000) if (y, i) not in taken)
                for dy in range(int(td.get("rowspan"))):
                    for dx in range(int(td.get("colspan"))):
                        taken.setdefault((y + dy, x + dx), td.text)
        got = tables.grid(tables.blocks(html)[0].rows)
        assert {(y, x): c.text for y, line in enumerate(got) for x, c in enumerate(line) if c} == {p: t for p, t in taken.items() if p[0] < len(rows)}


def test_simple_tables():
    assert one("<p>Net sales</p><table><tr><th>Metric</th><th>2024</th></tr><tr><td>Revenue</td><td>$100</td></tr></table>")["columns"] == ["Metric", "2024"]
    t = one("<table><tr><td>Amount</td><td>x</td></tr><tr><td>a</td><td>$</td><td>1</td><td>b c</td></tr><tr><td>short</td><td>1</td></tr></table>")
    assert t["columns"] == ["Metric", "Amount", "x"] and texts_of(t) == [("a", "$1", "b c")] and t["title"] is None
    for html in ("<table><tr><td>only</td></tr></table>", "<table><tr><td>a</td><td>b</td></tr></table>", "<table><tr><td>a</td><td>1</td></tr></table>", "", None):
        assert tables.extract(html) == []


def test_changes():
    head = "<tr><td></td><td>2024</td><td>Change</td><td>2023</td><td>Change</td></tr>"
    t = one(f"<table>{head}<tr><td>Phone</td><td>$</td><td>5</td><td>(2</td><td>)%</td><td>4</td><td>—</td></tr><tr><td>Mac</td><td>7</td><td>3</td><td>%</td><td>6</td><td>1%</td></tr></table>")
    assert t["columns"] == ["Category", "2024 Sales", "2024 Change", "2023 Sales", "2023 Change"]
    assert ("Mac", "7", "3%", "6", "1%") in texts_of(t)


def test_context_of_a_table():
    html = "<p>far</p><table><tr><td>2024</td><td>x</td></tr><tr><td>a</td><td>1</td><td>2</td></tr></table><p>Sales</p><p>(dollars in millions)</p><p>The following table shows</p><div><table><tr><td>2023</td><td>y</td></tr><tr><td>b</td><td>1</td><td>2</td></tr></table></div><p>(1) one</p><p>text</p><p>(2) two</p><p>4</p><p>(3) too far</p>"
    t = tables.extract(html)[1]
    assert (t["title"], t["units"], t["footnotes"]) == ("Sales", "dollars in millions", ["(1) one", "(2) two"])
    assert t["markdown"] == "| Metric | 2023 | y |\n| --- | --- | --- |\n| b | 1 | 2 |\n\n(1) one\n(2) two"


def test_spans_nested_tables_and_facts():
    html = """<table><tr><td>K</td><td>2024</td><td>2023</td></tr>
    <tr><td rowspan=2>Both</td><td><ix:nonFraction name=N contextRef=c unitRef=u decimals=-3 scale=6 id=f1>1,0<b>00</b></ix:nonFraction></td><td>2</td></tr><tr><td>3</td><td>4</td></tr>
    <tr><td>In</td><td><table><tr><td>n</td><td>2024</td></tr><tr><td>z</td><td>9</td></tr></table></td><td>5</td></table>"""
    outer, inner = tables.extract(html)
    assert texts_of(outer) == [("Both", "1,0 00", "2"), ("Both", "3", "4"), ("In", "n 2024 z 9", "5")] and texts_of(inner) == [("z", "9")]
    assert outer["rows"][0]["cells"][0]["facts"] == [{"name": "N", "context_ref": "c", "unit_ref": "u", "decimals": "-3", "scale": "6", "fact_id": "f1", "value": "1,0 00"}]
    assert len(outer["source_html_hash"]) == 64 and outer["source_html_hash"] == inner["source_html_hash"]


def test_markdown_of_a_page():
    html = "<title>no</title><h1>A</h1><script>x</script><div>b <b>c</b><p>d</p>e<ul><li>f</li><li>g</li></ul></div><table><tr><td colspan=2>h|i</td></tr><tr><td>1</td><td></td></tr><tr><td></td></tr></table>"
    assert tables.to_markdown(html) == "# A\n\nb c\n\nd\n\ne\n\n- f\n\n- g\n\n| h\\|i |  |\n| --- | --- |\n| 1 |  |"


def test_heading_stack_and_joined_neighbours():
    md = "lead\n\n# A\n\none\n\ntwo\n\n### C\n\nthree\n\n## B\n\nfour\n\n# D\n\nfive"
    assert chunks.heading_chunks(md) == [((), "lead"), (("A",), "one\ntwo"), (("A", "C"), "three"), (("A", "B"), "four"), (("D",), "five")]


def test_budgets():
    words = chunks.count_words
    md = "# H\n\n" + " ".join(f"w{i} x." for i in range(40)) + "\n\n" + " ".join(f"y{i}" for i in range(50)) + "\n\nshort\n\nalso"
    got = chunks.heading_chunks(md, 20)
    assert all(words("\n".join([*p, t])) <= 20 for p, t in got)
    assert " ".join(t for _, t in got).split() == md.removeprefix("# H\n\n").split()
    rows = [f"| r{i} | {i} |" for i in range(30)]
    got = chunks.heading_chunks("\n".join(["| a | b |", "| --- | --- |", *rows]), 60)
    assert len(got) > 2 and all(t.startswith("| a | b |\n| --- | --- |\n") and words(t) <= 60 for _, t in got)
    assert [line for _, t in got for line in t.splitlines()[2:]] == rows
    assert chunks.heading_chunks("x" * 50 + " y", 1) == [((), "x" * 50), ((), "y")]


def test_woven_tables():
    """Rows follow the chunk that holds their table; what matches nothing comes last; numbers run on."""
    table = lambda label, a: f"<table><tr><td>K</td><td>2024</td></tr><tr><td>{label}</td><td>{a}</td></tr></table>"
    html = f"<h1>Part I</h1><p>See Item 1A. Risk</p><p>Title</p>{table('Rent', '$7')}<p>(1) n</p><p>end</p>"
    got = chunks.woven(html)
    assert [(c["chunk_index"], c["kind"], c["section"], c["row_label"]) for c in got] == [(0, "narrative", "Part I", None), (1, "narrative", "Part I", None), (2, "table_row", "Title", "Rent"), (3, "narrative", "Part I", None)]
    assert got[2]["chunk_text"] == "Title\n| K | 2024 |\n| --- | --- |\n| Rent | $7 |\n(1) n"
    assert [c["section"] for c in chunks.woven("<p>see item 7. now</p>")] == ["item 7"]
    assert chunks.woven("") == [] and chunks.woven(None) == []


@pytest.mark.parametrize("name", ["structural_chunks", "page_markdown"])
def test_whole_queries(spark, name):
    got = catalog.QUERIES[name](spark, SF).collect()
    if name == "page_markdown":
        pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
        assert {r.page_id: r.markdown for r in got} == {k: tables.to_markdown(v) for k, v in pages.items()} and all("<" not in r.markdown[:1] for r in got)
        return
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey", "o_orderkey").collect()
    rows = [(r.doc_key, r.table_index, r.row_label) for r in got if r.kind == "table_row"]
    assert sorted({(d, label) for d, t, label in rows if t == 1}) == sorted({(str(o.o_custkey), f"Order {o.o_orderkey}") for o in orders}) and len(rows) == 2 * len(orders)
    by_doc = {}
    for r in sorted(got, key=lambda r: (r.doc_key, r.chunk_index)):
        by_doc.setdefault(r.doc_key, []).append(r)
    assert all([r.chunk_index for r in v] == list(range(len(v))) and v[0].section == f"Part {k}" and v[-1].chunk_text.endswith("The end.") for k, v in by_doc.items())
    assert all(r.token_count <= 512 for r in got if r.kind == "narrative")


def test_pages_are_parsed_once_and_held_in_parts(spark, monkeypatch):
    """Blocks are read once a page; the rows of a batch come in parts of so many pages."""
    page = "<h1>A</h1><p>Sales</p><table><tr><th>Item</th><th>2024</th></tr><tr><td>x</td><td>$5</td></tr></table>"
    read, plain = [], tables.blocks
    monkeypatch.setattr(tables, "blocks", lambda html: read.append(1) or plain(html))
    assert {c["kind"] for c in chunks.woven(page)} == {"narrative", "table_row"} and len(read) == 1
    frames = []

    class Docs:
        def select(self, *columns):
            return self

        def mapInPandas(self, run, schema):
            frames.append(list(run(iter([pd.DataFrame({"k": range(150), "html": [page] * 150})]))))

    tables.filing_tables(Docs(), "k", "html")
    chunks.structural_chunks(Docs(), "k", "html")
    for parts, each in zip(frames, (1, 3), strict=True):
        assert [len(f) for f in parts] == [each * n for n in (64, 64, 22)]


PLAIN = '<html><body><h1>P &amp; Q</h1>tail &lt;x<p class="a b">one<table><tr><td></td><TH COLSPAN=2>2024<td rowspan="2">r</tr><tr><td> A &nbsp;b<td>$ <ix:nonFraction name="P" contextRef=c1 unitRef="EUR" id="F1">1,2</ix:nonFraction></td><td colspan="x"><table><tr><td>in</td><td>3</td></tr></table>( 5 )</td></tr></table></p>&amp'


def test_plain_pages_are_read_as_by_the_parser(spark):
    def parsed(html):
        reader = tables._Reader()
        reader.feed(html)
        reader.close()
        return [b for b in reader.blocks if b.kind == "table" or b.text]

    seen = lambda every: [(b.kind, b.level, b.parts, [[(c.colspan, c.rowspan, c.parts, c.text, c.facts) for c in row] for row in b.rows]) for b in every]
    odd = ["<!-- <p>a</p> -->b", "<p>a < b</p>", "<br/>x", "<script>1<td>2</script>y", "<p a='1'>q</p>", '<p a="x>y<z">t</p>', "<p", "a &am", "<title>t</title><p>u", "</p x>v", '<td a="&lt;">w', "<x-y>z</x-y>", "", "<p></>s</p>", "<![CDATA[a]]>b"]
    filings = [r.html for r in texts._filings(spark, SF).limit(20).collect()]
    assert tables._read_plain(PLAIN) and all(map(tables._read_plain, filings)) and not any(map(tables._read_plain, odd[:6]))
    pages = [PLAIN, *filings, *odd, *[a + b for a in odd for b in (PLAIN, *odd)], *[PLAIN[:n] for n in range(len(PLAIN))]]
    for html in pages:
        assert seen(tables.blocks(html)) == seen(parsed(html)), html


def test_rows_of_tables_by_arrow_are_those_by_pandas(spark):
    docs = spark.createDataFrame([(1, PLAIN), (2, None), (3, PLAIN * 3), (4, "<p>none</p>")], "k long, html string")
    rows = [sorted(map(tuple, f(docs, "k", "html").collect())) for f in (tables.filing_tables, tables.table_rows)]
    assert rows[0] == rows[1] and len(rows[0]) >= 4

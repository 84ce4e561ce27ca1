"""Every registered query against its SQL, over the smallest tables."""

import difflib

import duckdb
import pytest

from brindle.functions import markup
from brindle.operators import resolve
from brindle.plans import catalog, evaluation, finance

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(value):
    if value is None or value != value:
        return None
    if hasattr(value, "isoformat"):
        return value.isoformat().removesuffix("T00:00:00")
    if isinstance(value, (bool, str)):
        return str(value)
    return f"{float(value):.9g}"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, sql, name):
    found = catalog.QUERIES[name](spark, SF)
    wanted = sql.execute(catalog.ORACLES[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    order = sorted(columns)
    a = sorted([str([shown(r[c]) for c in order]) for r in found.collect()])
    b = sorted([str([shown(dict(zip(columns, r, strict=True))[c]) for c in order]) for r in wanted.fetchall()])
    assert a == b


def test_all_but_eight_have_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"ann_topk", "chunk_bpe_tokens", "invoice_assignment", "item_match_title", "page_markdown", "rfc822_parse", "runs_side_by_side", "structural_chunks"}


def test_invoice_assignment_by_a_loop(spark):
    invoices, debits = finance._sides(spark, SF)
    pairs = {}
    for r in resolve.match_signals(invoices, debits).collect():
        if len(r.signals) > 1:
            pairs.setdefault(r.invoice_id, []).append((r.debit_id, r.signals))
    taken, wanted = set(), []
    for r in sorted(invoices.select("id", "start").collect(), key=lambda r: (r.start, r.id)):
        able = [(d, s) for d, s in pairs.get(r.id, []) if d not in taken]
        strong = [(d, s) for d, s in able if "iban" in s or "reference" in s]
        wanted += [(r.id, d, "linked" if len(strong) == 1 else "suggested", ",".join(s)) for d, s in strong or able]
        taken |= {d for d, _ in strong} if len(strong) == 1 else set()
    got = catalog.QUERIES["invoice_assignment"](spark, SF).collect()
    assert wanted and sorted((r.invoice_id, r.debit_id, r.status, r.signals) for r in got) == sorted(wanted)


def test_title_matches_by_a_loop(spark):
    expected, actual = evaluation._extracted(spark, SF)
    done = resolve.match_urls(expected, actual).collect()
    sides = []
    for rows, used in ((expected, {(r.group, r.expected_idx) for r in done}), (actual, {(r.group, r.actual_idx) for r in done})):
        sides.append([(r.group, r.idx, r.title.casefold().strip()) for r in rows.collect() if (r.group, r.idx) not in used])
    scored = sorted((-difflib.SequenceMatcher(None, t, u).ratio(), g, i, j) for g, i, t in sides[0] for h, j, u in sides[1] if g == h)
    left, right, wanted = set(), set(), set()
    for ratio, g, i, j in scored:
        if -ratio >= 0.85 and (g, i) not in left and (g, j) not in right:
            left.add((g, i))
            right.add((g, j))
            wanted.add((g, i, j, round(-ratio, 6)))
    assert {tuple(r) for r in catalog.QUERIES["item_match_title"](spark, SF).select("group", "expected_idx", "actual_idx", "ratio").collect()} == wanted


def test_mails_by_their_parts(spark):
    turns = {f"{r.conv_id}/{r.turn}": r for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    got = catalog.QUERIES["rfc822_parse"](spark, SF).collect()
    assert len(got) == len(turns)
    for r in got:
        t = turns[r.path]
        assert (r.message_id, r.subject, r.from_address, r.from_name, r.to_addresses, r.sent_at.isoformat()) == (f"{t.conv_id}@x", f"turn {t.turn}", "ada@example.com", "Ada", ["b@example.com", "c@example.com"], "2024-01-02T09:00:00")
        assert r.body == markup.tidy(t.text or "") and r.attachments == []


def test_attachments_of_odd_documents_match_sql(spark, tmp_path):
    """Blanks of all kinds in the first word and the names, texts that begin with a blank or are long, nulls, an id that comes twice."""
    texts = [" starts", "\nfirst", "last\n\n next", "\t", "", "a\xa0b\u3000", "\x0bv\x1c\x85 w ", "W" * 5000 + " x", "\U0001f600" * 60, "=?utf-8?B?YQ==?= x", None, "é" * 30, "x\x00y z"]
    rows = [(i, t, "en", "s1") for i, t in enumerate(texts)] + [(5, "again ", "de", " two  blanks\n"), (100, "t x", None, None), (101, "u", None, "\xa0n"), (102, None, None, "s"), (None, "no id", "fr", "s, \"q\" <a@b>")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    wanted = con.execute(catalog.ORACLES["mail_attachments"])
    columns = [c[0] for c in wanted.description]
    got = [tuple(r[c] for c in columns) for r in catalog.QUERIES["mail_attachments"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(wanted.fetchall(), key=repr)

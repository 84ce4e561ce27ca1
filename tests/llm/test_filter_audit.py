"""The filter audit against a loop over all orders."""

import itertools
import re

import pytest

pytest.importorskip("brindle.llm.common")

from brindle.llm import filter_audit  # noqa: E402

SCHEMA = "doc_id long, text string, lang string"
LONG = " ".join(f"word{i} und{i % 31}" for i in range(20_000))
FEW = " ".join(f"w{i}" for i in range(250))
ROWS = [
    (5, FEW, "en"), (3, FEW, "de"), (3, FEW, "en"), (9, FEW, None), (None, FEW, "en"), (1, None, "en"), (2, "", ""), (4, "a " * 300, "en"), (6, "A B | c", "fr"),
    (7, FEW + " É中 # X", "en"), (8, "a\x0bb\x1cc\xa0d " * 120, "en"), (10, LONG, "de"), (11, LONG, "de"), (11, LONG, "de"), (12, LONG + " ", "de"),
    *((100 + i, "the same text again", "hot") for i in range(300)), *((1000 + i % 50, "other TEXT again", "hot") for i in range(200)),
]
LABELS = [(5, 1, 0), (5, 0, 1), (4, 0, 1), (None, 1, 1), (11, 1, None), (120, 1, 1), (777, 1, 1)]


def by_loop(rows, labels):
    smallest = {}
    for k, t, _ in rows:
        if k is not None:
            smallest[t or ""] = min(k, smallest.get(t or "", k))
    failed = []
    for k, t, p in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": k is not None and k > smallest[t]}
        mine = [x for x in labels if k is not None and x[0] == k]
        failed.append((p or "", {f for f, x in fails.items() if x}, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = {}
    for part in {f[0] for f in failed}:
        removed_of = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = [f for f in failed if f[0] == part]
            gone = []
            for s, x in enumerate(order):
                lost = [f for f in left if x in f[1]]
                left = [f for f in left if x not in f[1]]
                out[part, "".join(order), s + 1] = [len(left), len(lost), sum(x in f[1] for f in gone), sum(f[1] == {x} for f in failed if f[0] == part), sum(f[2] for f in lost), sum(f[3] for f in lost)]
                gone += lost
                removed_of[x] += len(lost)
        for (p, o, s), v in out.items():
            if p == part:
                v.append(removed_of[o[s - 1]])
    return out


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "'x' AS part", "1 AS mask", "2 AS quality", "3 AS run", "4 AS __text")
    return docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS n", "2 AS part")


@pytest.mark.parametrize("partitions", [1, 7, 97])
def test_by_a_loop(tables, partitions):
    """Copies of one text lie in many ranges, and ranges hold a single row."""
    docs, labels = tables
    got = filter_audit.filter_audit(docs, labels, partitions=partitions).collect()
    assert {(r.part, r.filter_order, r.step): list(r)[3:] for r in got} == by_loop(ROWS, LABELS)
    assert len(got) == 600 * 5


def test_equal_fingerprints(spark, tables, monkeypatch):
    """Different texts under one fingerprint lie among each other and are told apart by the texts."""
    docs, labels = tables
    monkeypatch.setattr(filter_audit.F, "xxhash64", lambda c: filter_audit.F.length(c) % 2)
    got = filter_audit.filter_audit(docs, labels, partitions=23).collect()
    assert {(r.part, r.filter_order, r.step): list(r)[3:] for r in got} == by_loop(ROWS, LABELS)


def test_empty_tables(tables):
    docs, labels = tables
    assert filter_audit.filter_audit(docs.where("false"), labels).count() == 0
    got = filter_audit.filter_audit(docs, labels.where("false")).collect()
    assert {(r.part, r.filter_order, r.step): list(r)[3:] for r in got} == by_loop(ROWS, [])

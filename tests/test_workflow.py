"""Runs side by side and token windows against loops, over whole tables."""

import difflib

import pytest

from brindle.operators import search, workflow
from brindle.plans import catalog
from brindle.sources import bank

SF = "/root/testdata/sf0.001"


def lined_up(runs, reference, least=0.85):
    """Groups as [position, {run: item}], built the slow way: an item at a time, every pair of titles anew."""
    groups = [[float(i), {reference: x}] for i, x in enumerate(runs[reference])]
    for name in sorted(r for r in runs if r != reference):
        anchors = [list(g[1].values())[0] for g in groups]
        partner = {}
        for i, x in enumerate(runs[name]):
            for g, a in enumerate(anchors):
                if x["link"] and a["link"] and a["url"] == x["url"] and g not in partner.values():
                    partner[i] = g
                    break
        while True:
            best = None
            for g, a in enumerate(anchors):
                for i, x in enumerate(runs[name]):
                    if i not in partner and g not in partner.values():
                        r = difflib.SequenceMatcher(None, a["title"].casefold().strip(), x["title"].casefold().strip()).ratio()
                        if r >= least and (best is None or r > best[0]):
                            best = (r, g, i)
            if best is None:
                break
            partner[best[2]] = best[1]
        last, old = -1.0, [g[0] for g in groups]
        for i, x in enumerate(runs[name]):
            if i in partner:
                groups[partner[i]][1][name] = x
                last = old[partner[i]]
            else:
                after = [old[partner[j]] for j in range(i + 1, len(runs[name])) if j in partner]
                last = (last + (after[0] if after else last + 1)) / 2
                groups.append([last, {name: x}])
    return sorted(groups, key=lambda g: g[0])


def test_runs_by_a_loop(spark, monkeypatch):
    seen = []
    real = workflow.grouped_runs
    monkeypatch.setattr(workflow, "grouped_runs", lambda items, reference: seen.append(items) or real(items, reference))
    got = catalog.QUERIES["runs_side_by_side"](spark, SF).collect()
    letters = {}
    for r in sorted(seen[0].collect(), key=lambda r: r.idx):
        letters.setdefault(r.newsletter, {}).setdefault(r.run, []).append(r.asDict())
    assert len(letters) == len({r.newsletter for r in got}) > 3
    by_reason = set()
    for number, runs in letters.items():
        wanted = lined_up(runs, "a")
        mine = sorted((r for r in got if r.newsletter == number), key=lambda r: r.place)
        assert [(r.position, {v.run: v.idx for v in r.versions}) for r in mine] == [(at, {n: x["idx"] for n, x in g.items()}) for at, g in wanted]
        for r, (_, g) in zip(mine, wanted, strict=True):
            good = {x["url"] for x in g.values() if x["in_text"]}
            if len(good) == 1:
                assert g[r.choice]["in_text"]
            elif good:
                assert r.choice is None
            else:
                assert r.choice == next((n for n, x in g.items() if not x["url"]), None)
            reasons = [x for x in (f"missing in {', '.join(n for n in 'abc' if n not in g)}" if len(g) < 3 else "", "different URLs" if len({x["url"] for x in g.values()}) > 1 and r.choice is None else "") if x]
            flags = {x["sponsor"] for x in g.values()}
            reasons += ["sponsor flag differs"] if len(flags) > 1 else ["flagged sponsor"] if flags == {True} else []
            assert r.reasons == reasons
            by_reason |= set(reasons)
    assert len(by_reason) > 3


def test_token_windows(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    encoding = search.ranked_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    chunks = {}
    for r in sorted(catalog.QUERIES["chunk_bpe_tokens"](spark, SF).collect(), key=lambda r: (r.parent_id, r.chunk_index)):
        chunks.setdefault(r.parent_id, []).append(r)
    assert chunks.keys() == docs.keys()
    for k, d in docs.items():
        ids = encoding.encode_ordinary(f"{d.source or ''}\n{d.text or ''}".strip())
        assert [c.token_count for c in chunks[k]] == [max(len(ids[i : i + 512]), 1) for i in range(0, max(len(ids), 1), 512)]
        assert [c.chunk_text for c in chunks[k]] == [encoding.decode(ids[i : i + 512]) for i in range(0, max(len(ids), 1), 512)]
    empty = spark.createDataFrame([(1, None, None), (2, "", " ")], "doc_id long, source string, text string")
    got = search.token_chunks(empty, "doc_id", "source", "text", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert sorted(map(tuple, got)) == [(1, 0, "", 1), (2, 0, "", 1)]


def test_job_runs_are_recorded(spark):
    """A running row first, then the counts or the error, which is raised on."""
    rows = []
    assert workflow.job_run(spark, "sync", lambda: {"new": 3}, lambda df: rows.append(df.first())) == {"new": 3}
    with pytest.raises(ValueError, match="lost"):
        workflow.job_run(spark, "sync", lambda: (_ for _ in ()).throw(ValueError("lost" + "x" * 3000)), lambda df: rows.append(df.first()))
    assert [(r.status, r.counts, (r.error or "")[:16]) for r in rows] == [("running", None, ""), ("ok", {"new": 3}, ""), ("running", None, ""), ("failed", None, "ValueError: lost")]
    assert len(rows[3].error) == 2000 and rows[1].finished_at >= rows[1].started_at


def test_fixtures_of_another_model_fail(spark):
    rows = spark.createDataFrame([("m1", [1.0, 2.0]), ("m2", [1.0, 2.0])], "model string, embedding array<float>")
    assert bank.guarded(rows.where("model = 'm1'"), "m1", 2).count() == 1
    for wrong, dims in ((rows, 2), (rows.where("model = 'm1'"), 3)):
        with pytest.raises(Exception, match="are asked for"):
            bank.guarded(wrong, "m1", dims).collect()
    cases = spark.createDataFrame([("c", ["a", "b", "a"])], "case_id string, keys array<string>")
    ids = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, id string")
    assert bank.with_ids(cases, ids, "case_id", ["keys"]).first()["keys"] == ["1", "2", "1"]
    with pytest.raises(Exception, match="unknown key b"):
        bank.with_ids(cases, ids.where("key = 'a'"), "case_id", ["keys"]).collect()

"""The corpus operators on small tables with nulls, empty and repeated rows, and on empty tables."""

import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("brindle.llm.common")
public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from brindle.llm import decontaminate, fixity, media, mixing, near_dup, pii, queries, token_counts, token_files, tool_calls, toxicity  # noqa: E402
from brindle.llm.pieces import encoder  # noqa: E402

SF = "/root/testdata/sf0.001"
PATH, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
LONG = " ".join(f"word{i % 977} und{i % 31}" for i in range(30_000))
ROWS = [(1, "a b c d e f g h", "s1"), (2, None, None), (3, "", "s1"), (1, "a b c d e f g h", "s1"), (4, "mail x@y.example now", None), (5, LONG, "s2"), (None, "no id here", "s2"), (6, LONG + " tail", "s2")]


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns bear names that operators use for themselves."""
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return frame.withColumns({"key": F.lit(1), "label": F.lit("x"), "size": F.lit(0), "__n": F.lit(2)})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_token_files(docs, empty):
    rows = token_files.token_files(docs, PATH).collect()
    assert len(rows) == len(ROWS)
    e, start = encoder(PATH), 0
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    for want, got in zip(order, sorted(rows, key=lambda r: r.start), strict=True):
        ids = [*e.tokenizer.encode(want[1] or "", add_special_tokens=False).ids, 0]
        assert (got.doc_id, got.start, got.n_tokens, got.ids_crc32) == (want[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.token_files(empty, PATH).count() == 0


def test_token_files_by_their_folder_alone(docs, tmp_path):
    """A second process, with nothing but the path, decodes what this one wrote."""
    import subprocess
    import sys

    folder = str(tmp_path / "files")
    token_files.token_files(docs, PATH, folder=folder)
    code = f"""
import json
from brindle.llm import token_files
from brindle.session import get_session
spark = get_session("reader", 2, 2)
rows = [[r.key, r.ids] for r in token_files.read_ids(spark, {folder!r}).collect()]
index = [[r.key, r.start, r.n_tokens, r.ids_crc32] for r in token_files.read_files(spark, {folder!r}).collect()]
print("FOUND" + json.dumps([rows, index]))
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=corpus_pipeline.__file__.rpartition("/")[0]).stdout
    import json

    rows, index = json.loads(said.rpartition("FOUND")[2])
    e = encoder(PATH)
    wanted = sorted((str(k), [*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 0]) for k, t, _ in ROWS)
    assert sorted((str(k), ids) for k, ids in rows) == wanted
    assert sorted(n for _, _, n, _ in index) == sorted(len(ids) for _, ids in wanted)


def test_short_items_and_shards(spark, docs):
    """Short items within longer texts are weak matches; a benchmark in many shards gives the items of one index."""
    rng = np.random.default_rng(8)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 4000, n))
    items = [(k, f"{word(9)}. {word(7)}") for k in range(60)] + [(90, "blue cat runs"), (91, None), (92, "cat runs")]
    rows = [(k, f"{word(20)} {items[k][1]}! {items[(k + 7) % 60][1]} {word(9)}") for k in range(0, 60, 3)]
    rows += [(1000, "the Blue cat, runs fast"), (1001, "blue cat runs"), (1002, None), (1003, "bluecat runs"), (1000, "a cat runs a cat runs"), (None, items[5][1])]
    texts, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    shown = lambda frame: sorted(str((r.doc_id, r.n_items, r["items"], r.question_overlap, r.answer_overlap, r.weak_items)) for r in frame.collect())
    one = decontaminate.search_benchmark(texts, bench)
    got = one.collect()
    assert sorted((r.doc_id, r.n_items, r.weak_items) for r in got if r.doc_id and r.doc_id >= 1000) == sorted([(1000, 0, [90, 92]), (1001, 1, [92]), (1002, 0, []), (1003, 0, []), (1000, 0, [92])])
    assert all(sorted(r["items"]) == sorted({r.doc_id, (r.doc_id + 7) % 60}) for r in got if r.doc_id is not None and r.doc_id < 60)
    many = decontaminate.search_benchmark(texts, bench, most_mb=0.001)
    assert len(list(decontaminate.shards(bench, most_mb=0.001))) > 4 and many.columns == one.columns
    assert shown(many) == shown(one)
    left = decontaminate.clean_benchmark(texts, bench, most_mb=0.001)
    assert sorted(r.doc_id for r in left.collect()) == [1000, 1000, 1002, 1003] and left.columns == texts.columns


def test_token_counts(docs, empty):
    got = by_id(token_counts.attribute(docs, RANKS, public_tokenizers.PATTERN))
    assert got[2].n_tokens == got[3].n_sections == 0
    assert all(sum(r.section_tokens) == r.n_tokens for r in got.values())
    assert token_counts.sections(token_counts.attribute(docs, RANKS, public_tokenizers.PATTERN)).where("doc_id = 4").count() == 1
    assert token_counts.attribute(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_media(docs, empty):
    got = by_id(media.digests(media.encode_wav(docs)))
    assert got[2].feature == got[3].feature and got[2].payload_bytes == 192 and got[2].n_bytes == 0
    assert got[5].payload_bytes % 192 == 0 and got[5].codes == sorted(set(got[5].codes))
    assert media.fingerprints(media.encode_wav(docs)).where("doc_id = 5").first().codes
    assert media.digests(media.encode_wav(empty)).count() == 0


def test_personal_data(docs, empty):
    got = by_id(pii.find(docs))
    assert got[4].n_email == 1 and got[4].spans == "email:5:16" and got[2].spans == ""
    assert pii.find(empty).count() == 0


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame([(1, "a b c d. e f g h"), (2, None), (3, "not in any of these texts at all. ever")], "item_id long, text string")
    index = decontaminate.load_index(bench)
    assert by_id(decontaminate.search(docs, index))[1]["items"] == [1]
    index = decontaminate.build([(7, "a b c d e f g h")])
    got = by_id(decontaminate.search(docs, index))
    assert got[1]["items"] == [7] and got[5]["items"] == [] and got[2].n_items == 0
    kept = decontaminate.clean(docs, index)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, 3, 4, 5, 6, None}
    assert decontaminate.search(docs, decontaminate.build([])).where("n_items > 0").isEmpty()
    assert decontaminate.search(empty, index).count() == 0


def test_decontamination_finds_verbatim_items(spark):
    """Every document that holds an item's text as it stands, whatever stands next to it."""
    items = [(1, "one two three four five six seven eight nine ten. Short end"), (2, "red green blue black white grey pink brown. A last one of five"), (3, "sun moon star sky rain snow wind fog. And one *word*")]
    around = [("", ""), ("before ", " after"), ("*** ", "***"), ("x#", "%%% y"), ("&&&", "&&&"), ("_", "_"), ("glued", "glued"), ("(", ").")]
    rows = [(100 * i + n, a + t + b, i) for i, t in items for n, (a, b) in enumerate(around)]
    rows += [(1000, "one two three four five six seven eight nine ten. Other words", 0), (1001, items[1][1].replace("last", "final"), 2)]
    index = decontaminate.load_index(spark.createDataFrame(items, "item_id long, text string"))
    got = by_id(decontaminate.search(spark.createDataFrame(rows, "doc_id long, text string, item long"), index))
    assert {k: r["items"] for k, r in got.items()} == {k: [i] if i else [] for k, _, i in rows}


def test_decontamination_of_short_and_long_items(spark):
    long = " ".join(f"w{i}" for i in range(1000)) + ". The end of it"
    index = decontaminate.load_index(spark.createDataFrame([(1, "yes"), (2, long), (3, "one two three four five six. seven eight nine")], "item_id long, text string"))
    assert index.stride == decontaminate.STRIDE
    far = " ".join(f"x{i}" for i in range(2000))
    rows = [(1, "yes"), (2, "and yes it is"), (3, f"{far} {long} {far}"), (4, f"{far} one two three four five six {far} seven eight nine {far}"), (5, f"{far} one two three four five six. {far[:40]} seven eight nine")]
    got = by_id(decontaminate.search(spark.createDataFrame(rows, "doc_id long, text string"), index))
    assert {k: r["items"] for k, r in got.items()} == {1: [1], 2: [], 3: [2], 4: [], 5: [3]}
    with pytest.raises(ValueError, match="MB"):
        decontaminate.load_index(spark.createDataFrame([(1, "yes")], "item_id long, text string"), most_mb=0)


def test_decontamination_finds_verbatim_items_of_the_table(spark):
    folder = "/root/testdata/sf0.1"
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = by_id(decontaminate.search(docs, decontaminate.build(items)))
    wanted = {(r.doc_id, i) for r in docs.select("doc_id", "text").toLocalIterator() for i, t in items if t in r.text}
    assert wanted and [(d, i) for d, i in wanted if i not in got[d]["items"]] == []


def test_near_duplicates(docs, empty):
    got = {r.doc_id: r.class_id for r in near_dup.classes(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, None: None}
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 1), (False, 2), (False, 3), (False, 4), (False, 5), (True, None)]
    assert near_dup.classes(empty).count() == 0 and near_dup.keep_one(empty).count() == 0


def test_near_duplicates_of_null_and_repeated_ids(spark):
    """Different texts stay, whatever their ids; of equal texts the one of the least id stays."""
    rows = [(None, "one text without an id"), (None, "another text without any id"), (None, "and a third such text"), (7, "a text of id seven"), (7, "not the same text of seven"), (8, "a text of id seven"), (8, "a text of id seven"), (None, "a text of id seven"), (9, ""), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((str(r.doc_id), r.text or "") for r in near_dup.keep_one(docs).collect())
    assert kept == sorted([("None", rows[0][1]), ("None", rows[1][1]), ("None", rows[2][1]), ("7", rows[3][1]), ("7", rows[4][1]), ("9", ""), ("9", "")])
    assert near_dup.keep_one(spark.createDataFrame(rows[7:8] + rows[7:8], "doc_id long, text string")).count() == 1


def brute_force(spark, docs):
    """Ids to the least id of their class, and the weighted sets, by comparing all pairs; ids and texts are distinct."""
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    sets = [near_dup.weighted_set(t) for _, t in rows]
    distinct = {t: s for (_, t), s in zip(rows, sets, strict=True)}
    df = {}
    for k, _ in distinct.values():
        for x in k.tolist():
            df[x] = df.get(x, 0) + 1
    n = len(distinct)
    common = sorted(x for x, c in df.items() if c >= max(2, near_dup.COMMON * n))
    idf = np.minimum(1, np.log(n / np.array([df[x] for x in common])) / np.log(1 / near_dup.COMMON))
    weights = near_dup.Weights(np.array(common, np.uint32), 1 - near_dup.STRENGTH * (1 - idf))
    sets = [(k, weights.of(k, c)) for k, c in sets]
    label = np.arange(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            if label[i] != label[j] and near_dup.similarity(sets[i], sets[j]) >= near_dup.THRESHOLD:
                label[np.isin(label, (label[i], label[j]))] = min(label[i], label[j])
    return {rows[i][0]: rows[x][0] for i, x in enumerate(label)}, sets


def test_near_duplicates_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert {r.doc_id: r.class_id for r in near_dup.classes(docs).collect()} == brute_force(spark, docs)[0]


def forms(opening, n, shared, own):
    """n pairs of texts with one opening; a pair has `shared` words more in common, each text `own` of its own."""
    start = [f"form{i}" for i in range(opening)]
    return [" ".join(start + [f"p{i}w{k}" for k in range(shared)] + [f"o{i}t{t}w{k}" for k in range(own)]) for i in range(n) for t in (0, 1)]


def test_near_duplicates_in_large_buckets(spark, monkeypatch):
    """600 pairs, weighted similarity some 0.82, of one form; strangers lie just below the threshold. Buckets have many
    chunks."""
    monkeypatch.setattr(near_dup, "CHUNK", 100)
    docs = spark.createDataFrame(list(enumerate(forms(270, 600, 18, 24))), "doc_id long, text string")
    wanted, sets = brute_force(spark, docs)
    strangers = near_dup.similarity(sets[0], sets[2])
    assert 0.7 < strangers < near_dup.THRESHOLD < near_dup.similarity(sets[0], sets[1]) < 0.85
    assert len(set(wanted.values())) == 600
    got = {r.doc_id: r.class_id for r in near_dup.classes(docs).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(600)) >= 594 and all(got[2 * i] == 2 * i for i in range(600))


def test_common_shingles_weigh_less(spark):
    docs = spark.createDataFrame(list(enumerate(forms(30, 40, 3, 3))), "doc_id long, text string").select(F.col("doc_id").alias("__key"), F.col("text").alias("__text"))
    nodes = near_dup.vectors(docs).select("keys")
    weights = near_dup.weights_of(nodes)
    factors = sorted(weights.factors.tolist())
    assert min(factors) == pytest.approx(1 - near_dup.STRENGTH) and factors.count(min(factors)) == 26
    (k, c), once = near_dup.weighted_set("a b c d e a b c d e a b c d e f"), near_dup.Weights(np.empty(0, np.uint32), np.empty(0))
    assert max(once.of(k, c)) == pytest.approx(1 + near_dup.TF_STRENGTH * np.log(3))


def test_bounds_hold_for_all_pairs():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 32, 300, dtype=np.uint32))
    sets = []
    for _ in range(40):
        k = np.unique(np.where(rng.random(len(base)) < 0.08, rng.integers(0, 1 << 32, len(base), dtype=np.uint32), base))
        sets.append((k, (0.75 + 0.5 * rng.random(len(k))).astype(np.float32)))
    wanted = {(i, j) for i in range(40) for j in range(i) if near_dup.similarity(sets[i], sets[j]) >= 0.6}
    assert wanted and wanted <= set(near_dup.at_least(sets, 0.6))
    found = near_dup.links_within(sets, list(range(40)), [0] * 40, 0.6)
    assert len(found) < 40


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS)
    total = sum(r.size for r in rows)
    targets = {(r.source_size, r.target) for r in rows}
    assert sum(t for _, t in targets) == pytest.approx(total) and all(t <= 3 * s for s, t in targets)
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    assert rows == mixing.mix(docs).collect() or sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_mixing_meets_targets(spark):
    rows = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max("size").alias("most")).collect()
    assert all(abs(r.taken - r.target) <= r.most for r in rows)


@pytest.mark.parametrize("last", [50_000, 3])
def test_mixing_of_repeated_rows(spark, monkeypatch, last):
    """Any number of equal rows: the taken words come as near to the targets as one document allows, and agree with SQL."""
    monkeypatch.setattr(mixing, "LAST", last)
    monkeypatch.setattr(mixing, "BINS", 8)
    rows = [(1, "a b c d", "x")] * 90 + [(i, "w " * (i % 7 + 1), "xyz"[i % 3]) for i in range(2, 60)] + [(None, "n n", None)] * 3 + [(5, None, "y"), (1, "a b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    wanted = con.execute(mixing.SQL.replace("order_key, w.size", "order_key, w.size, w.doc_id")).fetchall()
    assert sorted(str((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken)) for r in got) == sorted(str((a, b, c, round(d, 6), e)) for a, b, c, d, e in wanted)
    for target in {r.target for r in got}:
        part = [r for r in got if r.target == target]
        assert abs(sum(r.taken for r in part) - target * len({r.source_size for r in part})) <= max(r.size for r in part)


def test_token_files_of_repeated_keys(spark):
    """Many rows of one key, and of none: the order is the same whatever the partitions."""
    rows = [(None if i % 2 else 3, f"text {i % 40} of many") for i in range(120)] + [(i, "x") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted((r.start, str(r.doc_id), r.n_tokens, r.ids_crc32) for r in token_files.token_files(docs.repartition(n), PATH).collect()) for n in (1, 7)]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    assert all(a[0] + a[2] == b[0] for a, b in zip(got[0], got[0][1:], strict=False))


def test_toxicity_learns_from_bounded_rows(spark):
    """A labelled id that is repeated counts once; other columns may be called like the operator's own."""
    rows = [(1, f"text {i % 3}") for i in range(500)] + [(i, "bad words" if i % 2 else "fine words") for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"__key": F.lit(0), "__y": F.lit("q"), "score": F.lit("s")})
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)] + [(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model)
    assert got.columns == ["doc_id", "score", "predicted"] and got.count() == len(rows)
    one = toxicity.train(docs.where("doc_id <> 1").unionByName(docs.where("doc_id = 1 AND text = 'text 0'").limit(1)), labels)
    assert np.array_equal(model.weights, one.weights) and model.bias == one.bias
    assert toxicity.train(docs, labels, sample_rows=0).score(np.empty(0, np.int64)) < 1e-9


def test_toxicity(spark, docs, empty):
    bad = [(i, f"alpha beta you idiot{'s' * (i % 2)} gamma", 1) for i in range(0, 120, 2)]
    good = [(i, f"alpha beta you see gamma {i % 7}", 0) for i in range(1, 400, 2)]
    train = spark.createDataFrame(bad + good, "doc_id long, text string, toxic int")
    model = toxicity.train(train, train)
    got = by_id(toxicity.score(train, model))
    held = [(i, y) for i, _, y in bad + good if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(got[i].predicted == y for i, y in held)
    assert len(toxicity.score(docs, model).collect()) == len(ROWS)
    kept = toxicity.reject(train, model)
    assert kept.columns == train.columns and kept.where("toxic = 1").isEmpty() and kept.count() == len(good)
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.train(train, train.where("false"))
    assert toxicity.score(train, none).where("predicted = 1").isEmpty()


CALLS = "conv_id long, call_id string, position long, name string, arguments string, depends_on array<string>"


def test_tool_calls_order_and_errors(spark):
    calls = spark.createDataFrame(
        [(1, "c", 0, "f", '{"b":1,"a":"x"}', ["a"]), (1, "a", 1, "f", '{"a":2}', []), (1, "b", 2, "g", "{}", ["c"]), (2, "x", 0, "f", "oops", ["y"]), (2, "y", 1, "f", None, ["x"]), (None, "z", 0, "f", '{"a":"x"}', []), (1, "c", 0, "f", '{"b":1,"a":"x"}', ["a"])],
        CALLS,
    ).withColumns({"uid": F.lit(1), "level": F.lit("x"), "errors": F.lit("y")})
    results = spark.createDataFrame([(1, "c", 3, "r"), (1, "c", 4, "late"), (None, "z", 1, None), (9, "q", 0, "orphan"), (3, None, 1, "of none")], "conv_id long, call_id string, position long, content string")
    schemas = spark.createDataFrame([("f", "a", "STRING", True), ("f", "b", "BIGINT", False), ("f", "d", "DOUBLE", False)], "tool string, field string, type string, required boolean")
    got = {(r.conv_id, r.call_id): r for r in tool_calls.link(calls, results, schemas).collect()}
    assert {k: r.topo_order for k, r in got.items()} == {(1, "a"): 0, (1, "c"): 1, (1, "b"): 2, (2, "x"): None, (2, "y"): None, (None, "z"): 0}
    assert {k: r.errors for k, r in got.items()} == {(1, "a"): "type:a", (1, "c"): "", (1, "b"): "tool", (2, "x"): "arguments", (2, "y"): "arguments", (None, "z"): ""}
    assert got[1, "c"].line == '{"arguments":{"a":"x","b":1},"call_id":"c","name":"f","result":{"content":"r","position":3},"topo_order":1}'
    assert got[1, "c"].n_results == 2
    assert tool_calls.link(calls.where("false"), results, schemas).count() == 0
    long = '{"a":"' + "x" * 300_000 + '"}'
    more = [(3, None, 0, "f", '{"a":"x"}', None), (3, None, 1, "f", '{"a":"x","a":"y"}', []), (3, None, 1, "f", '{"a":"x","a":"y"}', []), (3, "t", 2, "f", '{"a":"x"} trailing', ["gone"]), (3, "u", 3, "f", '{"a":"x"},{}', []), (3, "l", 4, "f", long, []), (3, "d", 5, "f", '{"d":1,"b":1.5,"a":{"z":1,"y":2}}', [None]), (3, "n", None, None, "[]", [])]
    rows = tool_calls.link(spark.createDataFrame(more, CALLS), results, schemas).collect()
    assert sorted((str(r.call_id), r.topo_order, r.n_results, r.errors) for r in rows) == sorted([("None", 1, 0, ""), ("None", 2, 0, "arguments"), ("t", 3, 0, "arguments,unknown:gone"), ("u", 4, 0, "arguments"), ("l", 5, 0, ""), ("d", 6, 0, "type:a,type:b"), ("n", 0, 0, "tool")])
    assert next(r for r in rows if r.call_id == "l").line == '{"arguments":' + long + ',"call_id":"l","name":"f","result":null,"topo_order":5}'
    assert '"arguments":{"a":{"y":2,"z":1},"b":1.5,"d":1}' in next(r for r in rows if r.call_id == "d").line


def test_tool_calls_in_random_graphs(spark):
    """Orders by releasing calls one level at a time, conversation by conversation."""
    rng, rows, wanted = np.random.default_rng(8), [], {}
    for conv in range(40):
        n = int(rng.integers(1, 9))
        needs = {i: sorted({int(x) for x in rng.integers(0, n, int(rng.integers(0, 3))) if conv % 3 or x < i}) for i in range(n)}
        rows += [(conv, f"c{i}", i, "f", "{}", [f"c{x}" for x in needs[i]]) for i in range(n)]
        if all(x < i for i, xs in needs.items() for x in xs):
            order = list(range(n))
        else:
            order, left = [], dict(needs)
            while free := [i for i in sorted(left) if not any(x in left for x in left[i])]:
                order += free
                left = {i: xs for i, xs in left.items() if i not in free}
        wanted |= {(conv, f"c{i}"): order.index(i) if i in order else None for i in range(n)}
    calls = spark.createDataFrame(rows, CALLS)
    none = spark.createDataFrame([], "conv_id long, call_id string, position long, content string")
    schemas = spark.createDataFrame([("f", "a", "STRING", False)], "tool string, field string, type string, required boolean")
    assert {(r.conv_id, r.call_id): r.topo_order for r in tool_calls.link(calls, none, schemas).collect()} == wanted
    assert None in wanted.values()


def audited(found):
    """(id, status, number) of what isn't intact, sorted."""
    rows = found.where("status <> 'ok'").groupBy("page_id", "status").count().collect()
    return sorted(((r.page_id, r.status, r["count"]) for r in rows), key=str)


def test_fixity_finds_the_damage(spark, monkeypatch):
    rows = [(i, f"u{i}", "x" * i, 1) for i in range(40)] + [(None, None, None, 2), (3, "u3", "xxx", 3), (50, "u50", "long " * 100_000, 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, hash int")
    for most in (fixity.MOST, 2):
        monkeypatch.setattr(fixity, "MOST", most)
        same = fixity.audit(pages, pages)
        assert same.count() == 43 and audited(same) == [] and same.where("primary_root <> replica_root").isEmpty()
        rotten = pages.withColumn("html", F.when(F.col("page_id") == 17, "y" * 17).otherwise(F.col("html")))
        found = fixity.audit(pages, rotten)
        assert audited(found) == [(17, "corrupt", 1)] and found.where("primary_root = replica_root").isEmpty()
        spans = sorted((r.record_offset, r.record_offset + r.record_length) for r in found.collect())
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert audited(fixity.audit(pages, pages.where("page_id IS NULL OR page_id <> 10"))) == [(10, "missing", 1)]
        more = spark.createDataFrame([(100 + i, "new", "n", 0) for i in range(5)] + [(12, "u12", "other", 0), (3, "u3", "xxx", 0)], pages.schema)
        assert audited(fixity.audit(pages, pages.unionByName(more))) == sorted([(100 + i, "extra", 1) for i in range(5)] + [(12, "extra", 1), (3, "extra", 1)], key=str)
        assert audited(fixity.audit(pages, pages.dropDuplicates(["page_id"]))) == [(3, "missing", 1)]
    none = pages.where("false")
    assert fixity.audit(none, none).count() == 0
    assert fixity.audit(none, pages).where("status = 'extra'").count() == fixity.audit(pages, none).where("status = 'missing'").count() == 43


def test_fixity_of_sparse_and_repeated_ids(spark):
    """Hashed ids, a third of all rows equal and a third without id: roots differ by one record, which is found."""
    pages = spark.range(600).select(F.when(F.col("id") % 3 == 0, F.xxhash64("id")).when(F.col("id") % 3 == 1, 7).alias("page_id"), F.when(F.col("id") % 3 == 2, F.col("id").cast("string")).otherwise("u").alias("url"), F.when(F.col("id") % 3 == 2, F.col("id").cast("string")).otherwise("same").alias("html"))
    wrong = pages.withColumn("html", F.when(F.col("url") == "302", "other").otherwise(F.col("html")))
    found = fixity.audit(pages, wrong)
    assert found.count() == 600 and [(r.url, r.status) for r in found.where("status <> 'ok'").collect()] == [("302", "corrupt")]


def test_fixity_by_brute_force(spark):
    """The root, built anew from the records in order."""
    from hashlib import sha256

    pages = [(i * 5, f"http://x/{i}", f"<p>{i}</p>") for i in range(300)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = sorted(fixity.audit(frame, frame).collect(), key=lambda r: r.record_offset)
    assert [r.page_id for r in found] == [p[0] for p in pages]
    width, ranges = -(-(pages[-1][0] + 1) // 255), {}
    for (k, u, h), r in zip(pages, found, strict=True):
        record = fixity_record(k, u, h)
        assert (r.record_length, r.leaf_sha256) == (len(record), sha256(record).hexdigest())
        ranges.setdefault(k // width + 1, []).append((r.record_length, r.leaf_sha256))

    def node(children):
        at, said = 0, []
        for n, h in children:
            said.append(f"{at}:{at + n}:{h}")
            at += n
        return at, sha256(",".join(said).encode()).hexdigest()

    level = {k: node([node(v)]) for k, v in ranges.items()}
    for _ in range(2):
        above = {}
        for k in sorted(level):
            above.setdefault(k // 16, []).append(level[k])
        level = {k: node(v) for k, v in above.items()}
    assert {r.primary_root for r in found} == {level[0][1]}


def fixity_record(key, url, html):
    import hashlib
    import uuid

    ident = uuid.UUID(hashlib.md5(f"{key}|{url}".encode()).hexdigest())
    head = ["WARC/1.0", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{ident}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {url}", "Content-Type: text/html", f"Content-Length: {len(html.encode())}"]
    return "\r\n".join([*head, "", html, "", ""]).encode()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    wanted = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in wanted.description]
    found = queries.QUERIES[name](spark, SF)
    assert sorted(found.columns) == sorted(columns)
    key = lambda row: str([f"{v:.9g}" if isinstance(v, float) else v for v in row])
    assert sorted(map(key, found.select(*columns).collect())) == sorted(map(key, wanted.fetchall()))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.toArrow())
        assert 0 < docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()

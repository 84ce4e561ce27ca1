"""Byte-level BPE against the tiktoken library."""

import hashlib
import random
import re

import numpy as np
import pytest

pytest.importorskip("brindle.llm.common")
public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from brindle.llm import byte_bpe, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.codec(PATH).ranks, special_tokens={})


def odd_texts():
    rng = random.Random(12)
    made = ["".join(rng.choice("'''''stmdrvle  \n\t  abS1²!.-é中😀\x00\x1c\u0107\u017f") for _ in range(rng.randint(0, 30))) for _ in range(8000)]
    return [*made, "", " ", "  ", "a  ", "it's we'll they'RE 'rest 'll'll''s", "x" * 5000, "ab" * 3000, "'" * 700, " " * 999, "\n" * 10 + "a", "<|endoftext|>"]


def test_ids_are_the_librarys(library):
    own, texts = byte_bpe.codec(PATH), odd_texts()
    assert byte_bpe.PATTERN == public_tokenizers.PATTERN
    for text, ids in zip(texts, (x for g in byte_bpe.grouped(texts, 5000) for x in own.encode(g)), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
        offsets = own.offsets(ids)
        assert own.decode(ids, offsets).tobytes() == text.encode()
        if len(ids) > 4:  # a range by itself
            assert own.decode(ids[2:4], offsets[2:5]).tobytes() == text.encode()[offsets[2] : offsets[4]]


def test_every_code_point(library):
    """Letters, numbers and white space of the library's edition of Unicode."""
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    assert byte_bpe.codec(PATH).encode([text])[0].tolist() == library.encode_ordinary(text)


def test_boundaries_by_the_pattern():
    """ASCII text by Python's own patterns."""
    rng = random.Random(3)
    plain = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")
    texts = ["".join(rng.choice("''srevlmtd xA1.\n ") for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    for text, at in zip(texts, byte_bpe.boundaries(texts), strict=True):
        assert at == [m.start() for m in plain.finditer(text)] + [len(text)]


@pytest.mark.parametrize("block", [2, 3, 16, 256])
def test_prefix_products_in_any_blocks(block):
    rng = np.random.default_rng(5)
    functions = rng.integers(0, len(byte_bpe._VALUES), 1000).astype(np.uint16)
    found, state = byte_bpe.prefix_products(functions, block), np.arange(10)
    for f, product in zip(functions, found, strict=True):
        state = byte_bpe._VALUES[f][state]
        assert (byte_bpe._VALUES[product] == state).all()


def test_short_and_long_merges_agree():
    own, rng = byte_bpe.codec(PATH), random.Random(4)
    for _ in range(3000):
        match = "".join(rng.choice("abcdeinorst'中é ") for _ in range(rng.randint(2, 40))).encode()
        assert own._short(match) == own._long(match)


def test_offsets_of_other_ids_are_refused():
    own = byte_bpe.codec(PATH)
    with pytest.raises(ValueError, match="offsets"):
        own.decode(own.encode(["one two"])[0], np.array([0, 1, 2]))


def test_nulls_repeats_long_texts_and_clashing_columns(spark, library):
    long = " ".join(f"word{i % 977}'s über{i % 31}" for i in range(30_000))
    rows = [(1, "it's"), (2, None), (3, ""), (1, "it's"), (None, "no id"), (5, long)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS key", "'x' AS ids", "2 AS bytes", "3 AS n_tokens", "4 AS __text")
    got = byte_bpe.digests(docs, PATH).collect()
    wanted = []
    for key, text in rows:
        ids = library.encode_ordinary(text or "")
        wanted.append((key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(wanted, key=str)
    stored = byte_bpe.encode(docs, PATH)
    assert sorted(map(tuple, byte_bpe.decode(stored, PATH).collect()), key=str) == sorted(((k, t or "") for k, t in rows), key=str)
    for r in stored.collect():
        assert r.n_tokens == len(r.ids) // 4 == len(r.offsets) // 4 - 1
    assert byte_bpe.decode(byte_bpe.encode(docs.where("false"), PATH), PATH).count() == 0 == byte_bpe.digests(docs.where("false"), PATH).count()


def test_whole_table(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op12_byte_bpe"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()

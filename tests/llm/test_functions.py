"""The parts of the corpus operators that need no session, against brute force."""

import random
import re

import numpy as np
import pytest

pytest.importorskip("brindle.llm.common")
public_tokenizers = pytest.importorskip("public_tokenizers")

from brindle.llm import decontaminate, media, near_dup, pii, token_counts, token_files, toxicity  # noqa: E402
from brindle.llm.pieces import encoder  # noqa: E402

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def strings(alphabet, n, longest, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_pieces_give_the_ids_of_whole_texts():
    e = encoder(VOCABULARY)
    odd = strings(" \n\t\r\xa0 'sétlld09中😀.,!-abc\x1c​<|endoftext|>", 1500, 40, 1)
    for x in [*odd, *(" ".join(x.split()) for x in odd), "Éa, b.\nC d", " ", "\n", "a \n b", "word." * 5]:
        want = e.tokenizer.encode(x, add_special_tokens=False)
        assert np.frombuffer(e.ids(x), e.dtype).tolist() == want.ids


def test_sections_and_tokens_by_brute_force():
    """Against the library's offsets, character by character, with a tokenizer of the test's own."""
    from tokenizers import Tokenizer

    own, crossings = Tokenizer.from_file(VOCABULARY), 0
    own.encode_special_tokens = True
    counted = token_counts.tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for x in [*strings(" abé中\n.!\")", 300, 60, 2), "One. Two! (Three?) 4.5\n\nSix 😀. Seven", "a<|endoftext|>. b", "x." * 2000]:
        starts = token_counts.section_starts(x).tolist()
        section = [max((k for k, s in enumerate(starts) if s <= c), default=0) for c in range(len(x))]
        assert starts == [c for c in range(len(x)) if c == 0 or x[c - 1] == "\n" or (x[c - 1].isspace() and (not x[c].isspace() or x[c] == "\n") and re.search(r"""[.!?]["')\]]*[^\S\n]+$""", x[:c]))]
        e = own.encode(x, add_special_tokens=False)
        ids, spans = counted.spans(x)
        assert ids.tolist() == e.ids and [tuple(s) for s in spans.tolist()] == e.offsets
        owner, crossing = token_counts.allocate(spans, np.array(starts, np.int64), len(x))
        inside = [[section[c] for c in range(a, b)] for a, b in e.offsets]
        assert owner.tolist() == [min(set(s), key=lambda k: (-s.count(k), k)) for s in inside]
        assert crossing == sum(len(set(s)) > 1 for s in inside)
        crossings += crossing
    assert crossings > 50
    for x in ("a" * 300_000, " " * 300_000, "ab c. " * 100_000, "é" * 300_000):
        _, spans = counted.spans(x)
        assert spans[0, 0] == 0 and spans[-1, 1] == len(x) and (spans[1:, 0] <= spans[:-1, 1]).all()


def test_allocation_by_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(200):
        length = int(rng.integers(1, 40))
        starts = np.unique(np.r_[0, rng.integers(0, length, 4)])
        cuts = np.unique(np.r_[0, rng.integers(0, length, 8), length])
        spans = np.stack([cuts[:-1], cuts[1:]], axis=1)
        owner, crossing = token_counts.allocate(spans, starts, length)
        ends = np.append(starts[1:], length)
        want = [int(np.argmax([max(0, min(b, y) - max(a, x)) for x, y in zip(starts, ends, strict=True)])) for a, b in spans]
        assert owner.tolist() == want
        assert crossing == sum(sum(min(b, y) > max(a, x) for x, y in zip(starts, ends, strict=True)) > 1 for a, b in spans)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_variable_bytes_round_trip(n):
    rng = np.random.default_rng(n)
    v = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
    control, data = token_files.pack(v)
    assert len(control) == -(-n // 4)
    assert token_files.unpack(control, data, n).tolist() == v.tolist()


def test_wav_round_trip_and_fingerprints():
    for x in ["", "a", "é" * 96, "b" * 193]:
        p = media.payload(x)
        assert len(p) % media.UNIT == 0 and len(p) >= media.UNIT and p.rstrip(b" ") == x.encode()
        assert media.from_wav(media.to_wav(p)) == (p, media.RATE)
    t = np.arange(4000)
    tone = (128 + 60 * np.sin(2 * np.pi * t / 16) * (t // 500 % 2)).astype(np.uint8).tobytes()
    bins = media.peaks(tone)[1]
    assert media.FRAME // 16 in bins
    codes = media.fingerprint(tone)
    assert (np.diff(codes) > 0).all()
    # peaks don't depend on how frames are batched
    media.FRAMES_AT_ONCE, kept = 7, media.FRAMES_AT_ONCE
    assert media.fingerprint(tone).tolist() == codes.tolist()
    media.FRAMES_AT_ONCE = kept


def test_fingerprints_by_brute_force():
    """Spectrum, peaks and pairs, each by its definition."""
    rng = np.random.default_rng(9)
    for n in (192, 480, 1920):
        x = rng.integers(60, 200, n).astype(np.uint8)
        total = 1 + (n - 192) // 96
        window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(192) / 192)
        turn = np.exp(-2j * np.pi * np.outer(np.arange(97), np.arange(192)) / 192)
        m = np.array([np.abs(turn @ ((x[96 * t : 96 * t + 192].astype(float) - 128) * window)) for t in range(total)])
        got = media.spectrum(x.tobytes(), 0, total)
        assert np.abs(got - m).max() <= 0.51
        at = lambda t, f: int(got[t, f]) if 0 <= t < total and 0 <= f < 97 else -1  # noqa: B023, E731
        found = []
        for t in range(total):
            here = [f for f in range(1, 97) if at(t, f) > at(t, f - 1) and at(t, f) >= at(t, f + 1) and at(t, f) > at(t - 1, f) and at(t, f) >= at(t + 1, f)]
            found += [(t, f) for f in sorted(sorted(here, key=lambda f: (-at(t, f), f))[:5])]
        t, f = media.peaks(x.tobytes())
        assert list(zip(t.tolist(), f.tolist(), strict=True)) == found
        codes = {t << 24 | f << 16 | g << 8 | (u - t) for i, (t, f) in enumerate(found) for u, g in [p for p in found[i:] if p[0] > t][:3] if u - t <= 32}
        assert media.fingerprint(x.tobytes()).tolist() == sorted(codes)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_base(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(*m.span(), "email") for m in EMAIL.finditer(t)]
    out += [(*m.span(), "ip") for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(*m.span(), "card") for m in CARD.finditer(t) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [(*m.span(), "phone") for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.BASE.index(s[2])))


def test_base_spans_by_brute_force():
    for t in [*strings("0123a.@ -+()b.@12", 8000, 50, 4), "4111 1111 1111 1111 a.b+c@x-y.example 10.0.0.256 1.2.3.4.5.6.7.8 +49 (30) 123456"]:
        assert pii.base_spans(t) == plain_base(t)


def test_long_digit_runs_stay_linear():
    assert pii.base_spans("9" * 200_000 + ".1.1.1") == plain_base("9" * 50 + ".1.1.1")


def spans_of(labels):
    edges = [i for i in range(len(labels)) if not i or labels[i] != labels[i - 1]]
    return {(a, b, labels[a]) for a, b in zip(edges, [*edges[1:], len(labels)], strict=True) if labels[a] != "outside"}


def test_field_on_held_out_rows():
    """Precision and recall of whole spans, on rows of another seed, and the labels of full Viterbi."""
    field = pii.train()
    scores, right, found, wanted = pii._Scores(field), 0, 0, 0
    rows = [r for r in pii.training_table(600, seed=77) if r[0]]
    flat, ends = [w for words, _ in rows for w in words], np.cumsum([len(words) for words, _ in rows])
    together = scores.label(flat, ends)
    ids = scores.of(flat)
    full = field.emissions(scores.table, ids, ends, np.arange(len(ids)))
    assert together.tolist() == field.decode(full, np.diff(np.r_[0, ends])).tolist()
    for (_, labels), mine in zip(rows, np.split(together, ends[:-1]), strict=True):
        got, gold = spans_of([pii.LABELS[k] for k in mine]), spans_of(labels)
        right, found, wanted = right + len(got & gold), found + len(got), wanted + len(gold)
    assert right / found > 0.93 and right / wanted > 0.93


def test_labels_on_sentences_of_other_templates():
    """Whole spans with their bounds, by label: nothing of these templates was learnt from."""
    assert not set(pii.SENTENCES) & set(pii.HELD_OUT)
    rows = pii.sentence_rows(pii.HELD_OUT, 1000, 99)
    scores = pii._Scores(pii.train())
    got = pii.added_spans([t for t, _ in rows], scores, [[] for _ in rows])
    least = {"name": (0.95, 0.95), "address": (0.9, 0.85), "contact": (0.95, 0.95), "identifier": (0.95, 0.95), "secret": (0.75, 0.75)}
    for label, (precision, recall) in least.items():
        right = found = wanted = 0
        for (_, gold), mine in zip(rows, got, strict=True):
            a, b = {s for s in gold if s[2] == label}, {s for s in mine if s[2] == label}
            right, found, wanted = right + len(a & b), found + len(b), wanted + len(a)
        assert wanted >= 100 and right / found >= precision and right / wanted >= recall, (label, right / found, right / wanted)


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("My name is Maria Lopez", [("Maria Lopez", "name")]),
        ("Meet Angela Merkel on Monday", [("Angela Merkel", "name")]),
        ("The password is hunter2 ok", [("hunter2", "secret")]),
        ("contact John Smith at 12 Baker Street", [("John Smith", "name"), ("12 Baker Street", "address")]),
        ("sk-proj-abc123DEF456ghi789JKL", [("sk-proj-abc123DEF456ghi789JKL", "secret")]),
        ("call me on 555-123-4567", [("555-123-4567", "contact")]),
        ("The meeting is on Monday in Paris.", []),
    ],
)
def test_sentences(text, wanted):
    got = pii.added_spans([text], pii._Scores(pii.train()), [[]])[0]
    assert [(text[a:b], k) for a, b, k in got] == wanted


def test_emissions_by_brute_force():
    field, rng = pii.train(), random.Random(2)
    scores = pii._Scores(field)
    texts = [[rng.choice(["word", "ssn", "123", "-", "45", "6789", "A1b2C3", "Mr", ".", "Smith"]) for _ in range(rng.randint(1, 6))] for _ in range(50)]
    flat, ends = [w for t in texts for w in t], np.cumsum([len(t) for t in texts])
    got = field.emissions(scores.table if len(scores.of(flat)) else None, scores.of(flat), ends, np.arange(len(flat)))
    want = [sum(field.weights[p, field.names[f]] for p, place in enumerate(pii.PLACES) if 0 <= i + place < len(t) for f in pii.features(t[i + place]) if f in field.names) for t in texts for i in range(len(t))]
    assert np.allclose(got, want)


def test_field_finds_secrets_with_exact_bounds():
    scores = pii._Scores(pii.train())
    secret = "24be0f31d8a7c5e6942b13fa07de55c81b9034ff"
    texts = [f'thon token = "{secret}"### edth', "The ered*** THE!! of, a.", "", "erth Dear John Smith, we 123-45-6789 on", f"x{'y' * 100} {'z' * 70}={secret}"]
    got = pii.added_spans(texts, scores, [[] for _ in texts])
    assert [[(t[a:b], k) for a, b, k in g] for t, g in zip(texts, got, strict=True)] == [[(secret, "secret")], [], [], [("John Smith", "name"), ("123-45-6789", "identifier")], [(secret, "secret")]]
    at = texts[0].index(secret)
    assert pii.added_spans(texts[:1], scores, [[(at + 3, at + 5, "ip")]]) == [[]]


def test_viterbi_by_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    field = pii.Field({}, np.zeros((len(pii.PLACES), 1, 4)), rng.normal(size=(4, 4)))
    e = rng.normal(size=(5, 4))
    score = lambda y: sum(e[i, k] for i, k in enumerate(y)) + sum(field.moves[a, b] for a, b in itertools.pairwise(y))
    best = max(itertools.product(range(4), repeat=5), key=score)
    assert field.decode(e, np.array([5])).tolist() == list(best)


def first_of_runs(part, n):
    """Where each different run of n words begins."""
    return list({tuple(part[i : i + n]): i for i in range(len(part) - n + 1)}.values())


def test_wand_finds_all_above_the_threshold():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    index = decontaminate.build([(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(60)], k=rng.randint(3, 15)))) for i in range(40)], stride=8)
    assert len(index.item_of) > len(index.items)
    dense = np.zeros((len(index.terms), len(index.item_of)), np.float32)
    for t, (items, impacts) in enumerate(index.postings):
        dense[t, items] = impacts
    for threshold in (0.1, 0.3, 0.6):
        for _ in range(60):
            terms = sorted(rng.sample(range(len(index.terms)), rng.randint(1, 30)))
            want = {int(k) for k in np.flatnonzero(dense[terms].sum(axis=0) >= threshold - 1e-6)}
            assert set(index.retrieve(terms, threshold)) == want
    searcher = decontaminate.Searcher(index, 0.6)
    for text in (" ".join(rng.choices(words, k=50)) for _ in range(60)):
        raw = text.split()
        windows = [sorted({index.terms[w] for w in raw[a : a + 2 * index.stride] if w in index.terms}) for a in range(0, len(raw), index.stride)]
        want = {int(index.item_of[k]) for w in windows if w for k in np.flatnonzero(dense[w].sum(axis=0) >= 0.6 - 1e-6)}
        assert set(searcher.candidates(raw)) == want
        kept, decontaminate.AT_ONCE = decontaminate.AT_ONCE, 2
        assert set(searcher.candidates(raw)) == want
        decontaminate.AT_ONCE = kept
        wanted = []
        for k in sorted(want):
            q, a = index.parts[k]
            spans = [raw[i : i + 2 * index.stride] for i in range(0, len(raw), index.stride)]
            spans = [x for x in spans if dense[sorted({index.terms[w] for w in x if w in index.terms})][:, index.item_of == k].sum(axis=0).max() >= 0.6 - 1e-6]
            share = lambda p: sum(any(p[i : i + n] == x[j : j + n] for x in spans for j in range(len(x))) for i in starts) / len(starts) if (n := decontaminate.width_of(p)) and (starts := first_of_runs(p, n)) else 1.0  # noqa: B023, E731
            both = (1.0, 1.0) if " ".join(q + a) in text else (share(q), share(a))
            if min(both) >= searcher.overlap and (len(q + a) >= 5 or raw == q + a):
                wanted.append((index.items[k], *(round(x, 6) for x in both)))
        assert [(m[0], round(m[2], 6), round(m[3], 6)) for m in searcher.matches(text)] == wanted


def test_samples_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(5)
    sampler = near_dup.Sampler(samples=2000)
    base = rng.integers(0, 1 << 32, 400, dtype=np.uint32)
    other = np.r_[base[:300], rng.integers(0, 1 << 32, 100, dtype=np.uint32)]
    sets = []
    for h in (base, other):
        h = np.unique(h)
        w = (1 + (h % np.uint32(3))).astype(np.float32)
        sets.append((h, w))
    agree = (sampler.sample(*sets[0]) == sampler.sample(*sets[1])).mean()
    assert abs(agree - near_dup.similarity(*sets)) < 0.04


def test_score_by_pairs():
    rng = np.random.default_rng(6)
    model = toxicity.FactorizationMachine(np.arange(30, dtype=np.int32), -0.3, rng.normal(0, 1, 30).astype(np.float32), rng.normal(0, 0.4, (30, 4)).astype(np.float32))
    for n in (0, 1, 2, 9):
        p = np.sort(rng.choice(30, n, replace=False))
        margin = model.bias + sum(float(model.weights[i]) for i in p) + sum(float(model.factors[i] @ model.factors[j]) for i in p for j in p if i < j)
        assert model.score(p) == pytest.approx(1 / (1 + np.exp(-margin)), rel=1e-4)
    words = "Idiot, idiots! the the (group)"
    terms = {w.strip(toxicity.STRIP) for w in words.lower().split()}
    every = terms | {"^" + w[:k] if len(w) > k else w for w in terms for k in toxicity.PREFIXES}
    import xxhash

    assert toxicity.term_ids(words).tolist() == sorted({xxhash.xxh32_intdigest(t.encode()) % (1 << toxicity.BITS) for t in every})


def test_machine_learns_a_pair_that_weights_cannot():
    rng = np.random.default_rng(2)
    docs, labels = [], []
    for _ in range(1500):
        a, b = rng.integers(0, 2, 2)
        docs.append(np.array(sorted({10 + int(a), 20 + int(b)} | set(rng.integers(100, 120, 4).tolist())), np.int32))
        labels.append(int(a == b))
    y = np.array(labels)
    terms = np.array([10, 11, 20, 21], np.int32)
    kept, toxicity.select_terms = toxicity.select_terms, lambda *args, **kw: terms
    try:
        model = toxicity.fit(docs, y, epochs=60)
    finally:
        toxicity.select_terms = kept
    at = model.lookup()
    right = [(model.score(p[p >= 0]) >= 0.5) == bool(t) for p, t in zip((at[d] for d in docs), y, strict=True)]
    assert np.mean(right) > 0.95


@pytest.mark.parametrize("text", ["<|endoftext|>", "one two<|endoftext|> three", "a <|endoftext|><|endoftext|>\nb.", "a\u2003b <|endoftext|> c"])
def test_added_tokens_in_texts(text):
    """Ids by the library's plain call, with a tokenizer of the test's own."""
    from tokenizers import Tokenizer

    import public_tokenizers
    from brindle.llm.pieces import PieceEncoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    wanted, e = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, PieceEncoder(path)
    assert np.frombuffer(e.ids(text), e.dtype).tolist() == wanted

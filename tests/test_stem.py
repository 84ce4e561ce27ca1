"""The stemmer against words and stems of the published sample."""

import duckdb
import pytest

from brindle.functions.stem import porter2
from brindle.operators import search

SAMPLE = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consist": "consist", "consisted": "consist", "consistency": "consist", "consistent": "consist",
    "consistently": "consist", "consisting": "consist", "consists": "consist", "consolation": "consol", "consolations": "consol", "consolatory": "consolatori", "console": "consol", "consoled": "consol",
    "consoles": "consol", "consolidate": "consolid", "consolidated": "consolid", "consolidating": "consolid", "consoling": "consol", "consolingly": "consol", "consols": "consol", "consonant": "conson",
    "consort": "consort", "consorted": "consort", "consorting": "consort", "conspicuous": "conspicu", "conspicuously": "conspicu", "conspiracy": "conspiraci", "conspirator": "conspir",
    "conspirators": "conspir", "conspire": "conspir", "conspired": "conspir", "conspiring": "conspir", "constable": "constabl", "constables": "constabl", "constance": "constanc", "constancy": "constanc",
    "constant": "constant", "knack": "knack", "knackeries": "knackeri", "knacks": "knack", "knag": "knag", "knave": "knave", "knaves": "knave", "knavish": "knavish", "kneaded": "knead",
    "kneading": "knead", "knee": "knee", "kneel": "kneel", "kneeled": "kneel", "kneeling": "kneel", "kneels": "kneel", "knees": "knee", "knell": "knell", "knelt": "knelt", "knew": "knew",
    "knick": "knick", "knif": "knif", "knife": "knife", "knight": "knight", "knightly": "knight", "knights": "knight", "knit": "knit", "knits": "knit", "knitted": "knit", "knitting": "knit",
    "knives": "knive", "knob": "knob", "knobs": "knob", "knock": "knock", "knocked": "knock", "knocker": "knocker", "knockers": "knocker", "knocking": "knock", "knocks": "knock", "knopp": "knopp",
    "knot": "knot", "knots": "knot",
}
RULES = {
    "ties": "tie", "cries": "cri", "gas": "gas", "this": "this", "gaps": "gap", "kiwis": "kiwi", "luxuriating": "luxuri", "hopping": "hop", "hoping": "hope", "by": "by", "say": "say", "cry": "cri",
    "skies": "sky", "dying": "die", "news": "news", "herrings": "herring", "proceeded": "proceed", "generate": "generat", "generic": "generic", "communism": "communism", "arsenal": "arsenal",
    "relational": "relat", "sensitivity": "sensit", "possibility": "possibl", "analogy": "analog", "apology": "apolog", "happily": "happili", "adoption": "adopt", "rebellion": "rebellion", "yellow": "yellow",
    "boys": "boy", "agreed": "agre", "feed": "feed", "sized": "size", "falling": "fall", "controlling": "control", "probate": "probat", "cease": "ceas", "hopefulness": "hope", "formative": "format", "é": "é",
}


@pytest.mark.parametrize("known", [SAMPLE, RULES])
def test_published_stems(known):
    assert {w: porter2(w) for w in known} == known


def test_possessives():
    assert [porter2(w) for w in ("dog's", "dogs'", "dog's'", "'tis")] == ["dog", "dog", "dog", "tis"]


def test_stems_begin_like_their_words():
    """What the search in texts relies on, over every word of the documents."""
    found = duckdb.connect().execute(r"SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    words = [w for (w,) in found if w] + list(SAMPLE) + list(RULES)
    assert len(words) > 1000
    for w in words:
        assert w.startswith((t := porter2(w))[: max(1, len(t) - search.TAIL)]), w

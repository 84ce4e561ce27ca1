"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds what they miss.

Patterns (the base): e-mail, IPv4, card and international phone numbers, each found leftmost and non-overlapping, and dropped
where its check fails. The field labels words as parts of a name, an address, a contact written otherwise (national phone
numbers, spelled-out mail addresses), an identifier (social security, IBAN) or a secret (keys and passwords); a run of one
label is a span, from its first to its last word or mark. Spans that touch one of the base are dropped.

Words are runs of letters and digits, or of marks. The features of a word, and of the two before and the two after it, are its shape (runs of capitals, small letters and digits, as long as they are), coarser classes of it
(kind, length, changes between letters and digits), whether it is a common given name, and the word itself if it announces
personal data. All weights are
learned, by gradient ascent of the log-likelihood, from a small labelled table (training_table() and sentence_rows(), some
hundreds of short rows each); a feature that the table lacks weighs nothing, so that an unknown shape is judged by its coarser classes.

Decoding is exact Viterbi for all texts of a batch at once. A word whose score for "outside" exceeds every other label by
more than any transitions can make up is outside in every best path; texts are cut there, so that only the short stretches
between such words are decoded. Tests hold this against Viterbi over whole texts, and the labels against held-out rows.

Nulls: a null or empty text has no span. Repeated rows give equal results. Texts and words of any length are read whole. An
empty table gives no row. Other columns may have any name.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_of

BASE = ("email", "ip", "card", "phone")
ADDED = ("name", "address", "contact", "identifier", "secret")
LABELS = ("outside", *ADDED)

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Holds every match of the number patterns whole: none has other characters or starts otherwise.
_ZONE = re.compile(r"[+0-9][\x20().0-9+-]*")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int, str]]:
    """Each "@" is tried with all local characters before it: that is where the leftmost match starts."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, m.end(), "email"))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    return out


def _part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    out = _emails(text)
    for zone in _ZONE.finditer(text):
        a, b = zone.span()
        if b - a < 7:
            continue
        out += [(*m.span(), "ip") for m in _IP.finditer(text, a, b) if all(map(_part, m[0].split(".")))]
        for m in _CARD.finditer(text, a, b):
            digits = "".join(_DIGITS.findall(m[0]))
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
        out += [(*m.span(), "phone") for m in _PHONE.finditer(text, a, b) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], BASE.index(s[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


#: Words that announce personal data.
CUES = frozenset(("ssn", "social", "security", "iban", "account", "key", "api", "token", "secret", "password", "pwd", "call", "tel", "phone", "fax", "mail", "at", "dot", "mr", "mrs", "ms", "dr", "dear", "name", "signed", "street", "road", "avenue", "lane", "address", "no", "is", "am", "my", "me", "meet", "contact", "ask", "regards", "sincerely", "hello", "hi", "signed", "lives", "reach", "patient", "number", "login", "bearer", "sk", "ghp", "pk", "resident", "ring", "text", "thanks"))
#: Given names that are common in several languages.
GIVEN = frozenset(
    "Adam Alice Amy Ana Andrea Andrew Angela Anna Anne Anthony Antonio Barbara Ben Bernd Brian Carl Carlos Carol Carmen Charles Chloe Chris Christine Claire Claudia Daniel David Diana Elena Elizabeth Emily "
    "Emma Eric Eva Felix Fernando Frank Francisco George Grace Hans Helen Henry Isabel Jack James Jan Jane Javier Jean Jennifer Jessica Joe John Jorge Jose Joseph Juan Julia Julie Karen Karl Kevin Klaus Laura "
    "Lisa Louis Lucas Luis Maria Marie Mark Martin Mary Max Michael Michelle Miguel Nicole Nina Noah Oliver Olivia Oscar Pablo Patricia Paul Pedro Peter Philip Pierre Rachel Ricardo Richard Robert Rosa Sandra "
    "Sara Sarah Sofia Sophie Stefan Stephen Susan Thomas Tom Uwe Victor William".split()
)

#: Runs of letters and digits, and runs of marks.
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
_RUNS = re.compile(r"[0-9]+|[^\W0-9_]+|.", re.DOTALL)


words_of = _TOKEN.findall


def shape(word: str) -> str:
    """Runs of capitals, small letters and digits by their kind, digits with their number; a mark as itself."""
    kinds = "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in word)
    return "".join(f"9{len(r)}" if r[0] == "9" else r[0] for r in re.findall(r"9+|A+|a+|.", kinds, re.DOTALL))


def features(word: str) -> list[str]:
    """What is known of a word by itself."""
    if not word[0].isalnum():
        return ["mark", f"s={word[:4]}", f"first={word[0]}", f"last={word[-1]}"]
    runs = [r[0].isdigit() for r in _RUNS.findall(word)]
    changes = min(len(runs) - 1, 9)
    kind = "digits" if word.isdigit() else "mixed" if any(runs) else "small" if word.islower() else "title" if word.istitle() else "capitals" if word.isupper() else "camel"
    longest = len(word).bit_length()
    found = [kind, f"s={shape(word)}" if changes < 5 else "s=long", f"{kind}:{longest}", f"{kind}~{1 + changes // 3 if changes else 0}", f"~{1 + changes // 3 if changes else 0}:{longest}"]
    if kind == "title" and word in GIVEN:
        found.append("given")
    return [*found, f"w={word.lower()}"] if word.lower() in CUES else found


#: Sentences with places for a name, address, contact, identifier or secret, some that look alike but hold none, and made-up
#: words in sentences (plain). The field
#: learns from the first list; the second one is for the tests alone.
SENTENCES = (
    "My name is {name} and I work here.", "I am {name}, nice to see you.", "Please contact {name} at {address} today.", "Ask for {name} when you come in.", "Best regards, {name}", "Kind regards {name} from the office",
    "Hello {name}, how are you?", "Hi {name}, see below.", "signed by {name} on Friday", "This is {name} speaking.", "I spoke to {name} about the plan.", "The patient {name} was seen at noon.", "{name} lives at {address}.", "{name} wrote to us last week.",
    "We visited {name} and then left.", "Send it to {address}, please.", "He moved to {address} in May.", "Call me on {contact} after six.", "My number is {contact}.", "You can reach us at {contact} or come by.", "Ring {contact} for help.",
    "Text me at {contact} tonight", "Her ssn is {identifier}.", "The iban {identifier} belongs to them.", "Use account {identifier} for the payment.", "The password is {secret} ok", "My password: {secret}", "login with password {secret} and wait", "Set the api key to {secret} first.",
    "Authorization: Bearer {secret}", "export TOKEN={secret}", "the secret is {secret} here", "key {secret} was revoked",
    "The meeting is on Monday at noon.", "Paris is in France.", "I am happy to see that.", "This is important for us.", "Please contact the office at once.", "My friend is here.", "Ask for help when you need it.", "Call me on Monday.", "The number is 42 today.", "See Chapter 3 of the Report.",
    "She lives in Berlin, not in Rome.", "The New York Times wrote about it.", "Best regards from the team", "The key is on the table.", "The password is wrong.", "A secret is safe here.", "Hello World, again.", "It was built in 1987 at Main Station.", "He paid 250 for 12 items.",
    *["{plain}", "{plain} is {plain}", "{plain} me. {plain}", "{plain} my {plain}", "{plain} am {plain}"] * 2,
)
HELD_OUT = (
    "You may meet {name} on Monday.", "Thanks to {name} for the help.", "In her letter {name} asks for more time.", "Regards, {name}", "Yesterday {name} called again.", "The flat is at {address}, second floor.", "They deliver to {address} every day.", "If you need me, call {contact} now.", "phone {contact} before noon",
    "Please text {contact} when done.", "social security {identifier} on file", "Pay to iban {identifier} by Friday.", "your new password is {secret}", "He used {secret} as the token.", "api key: {secret}", "The train is at the station.", "I am in London on Tuesday.", "Turn to Page 12 of the Book.", "The token is gone.", "Call the office on Friday.",
)


def sentence_rows(templates: tuple[str, ...], rows: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Sentences made of the templates in turn, with the spans of what was filled in."""
    rng = np.random.default_rng(seed)
    pick = lambda options: options[int(rng.integers(len(options)))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    letters = lambda n, alphabet="abcdefghijklmnopqrstuvwxyz": "".join(alphabet[int(i)] for i in rng.integers(0, len(alphabet), n))
    some, upper, given = lambda a, b: int(rng.integers(a, b)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", sorted(GIVEN)
    title = lambda: letters(1, upper) + letters(some(2, 9))
    mixed = lambda n: letters(1) + "".join(pick([letters(1), letters(1, upper), digits(1)]) for _ in range(n - 3)) + digits(1) + letters(1)
    fill = {
        "name": lambda: pick([f"{pick(given)} {title()}"] * 4 + [pick(given)]),
        "address": lambda: f"{digits(some(1, 4))} {title()} {pick(['Street', 'Road', 'Avenue', 'Lane', 'Drive'])}",
        "contact": lambda: pick([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)} {digits(3)} {digits(4)}"]),
        "identifier": lambda: pick([f"{digits(3)}-{digits(2)}-{digits(4)}", f"{letters(2, upper)}{digits(some(16, 22))}"]),
        "plain": lambda: " ".join(pick([letters(some(1, 9)), letters(some(2, 9)) + pick([".", ","]) + " " + title(), title()]) for _ in range(some(2, 7))),
        "secret": lambda: pick([letters(some(3, 7)) + digits(some(1, 4)), mixed(some(16, 32)), f"sk-{mixed(24)}", f"sk-proj-{mixed(20)}", f"ghp_{mixed(30)}", f"AKIA{''.join(pick(upper + '0123456789') for _ in range(14))}{digits(1)}{letters(1, upper)}"]),
    }
    out = []
    for r in range(rows):
        text, spans = "", []
        for part in re.split(r"\{(\w+)\}", templates[r % len(templates)]):
            if part in fill:
                item = fill[part]()
                if part in ADDED:
                    spans.append((len(text), len(text) + len(item), part))
                text += item
            else:
                text += part
        out.append((text, spans))
    return out


def labelled(text: str, spans: list[tuple[int, int, str]]) -> tuple[list[str], list[str]]:
    """Words and labels of a text."""
    marks = list(_TOKEN.finditer(text))
    return [m[0] for m in marks], [next((k for a, b, k in spans if a <= m.start() < b), "outside") for m in marks]


def training_table(rows: int = 1000, seed: int = 5) -> list[tuple[list[str], list[str]]]:
    """Words and labels of short rows, made by a fixed rule: neutral words, and in most rows one item of one label."""
    rng = np.random.default_rng(seed)
    pick = lambda options: options[int(rng.integers(len(options)))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    letters = lambda n, alphabet="abcdefghijklmnopqrstuvwxyz": "".join(alphabet[int(i)] for i in rng.integers(0, len(alphabet), n))
    upper, some = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", lambda a, b: int(rng.integers(a, b))
    title = lambda: letters(1, upper) + letters(some(2, 9))
    neutral = lambda: pick([lambda: letters(some(1, 12))] * 12 + [title] * 4 + [lambda: letters(some(1, 9), upper) + "!!", lambda: letters(5) + ",", lambda: letters(6) + ".", lambda: letters(5) + "***", lambda: "| " + letters(4) + " |", lambda: pick(["at", "key", "call", "mail", "dot", "no", "name", "street", "token", "account"]), lambda: f"{letters(some(2, 6))}. {title()}", lambda: f"{letters(5)}, {title()}", lambda: f"{title()}. {title()}", lambda: f"{letters(4)} at {letters(some(2, 5))}", lambda: f"{letters(4)}%%% at%%% {letters(2)}", lambda: f"{title()}, {letters(4)}", lambda: " ".join([title()] * some(2, 5)), lambda: f"| {title()} | {title()}", lambda: f"{letters(3)} {title()}. | {title()}", lambda: f"{title()}.*** {title()}", lambda: digits(some(1, 5)), lambda: digits(1) + "." + digits(1), lambda: digits(16), lambda: letters(4) + digits(1), lambda: letters(2, upper) + "-" + letters(2, upper), lambda: "(" + letters(5) + ")", lambda: f"{digits(1)}.{digits(2)}.{digits(2)}", lambda: f'"{letters(6)}"'])()
    hexes = lambda n: "".join(pick("0123456789abcdef") for _ in range(n))
    mixed = lambda n: letters(2) + "".join(pick([letters(1), letters(1, upper), digits(1)]) for _ in range(n - 4)) + digits(1) + letters(1, upper)
    # words before the item, the item, words after it
    items = {
        "name": [lambda: (pick(["Mr. ", "Mrs. ", "Ms. ", "Dr. ", "Dear ", "name: ", "signed ", "Dear Dr. "]), pick([title(), f"{title()} {title()}"]), pick([",", ".", ""]))],
        "address": [lambda: (pick(["", "address: ", "at "]), f"{digits(some(1, 4))} {title()} {pick(['Street', 'Road', 'Avenue', 'Lane'])}", pick([",", ".", ""]))],
        "contact": [lambda: (pick(["call ", "tel ", "", "phone: ", "fax "]), pick([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)} {digits(3)}-{digits(4)}"]), pick(["", ".", ","])), lambda: ("mail ", pick([f"{letters(6)} at {letters(5)} dot com", f"{letters(6)} [at] {letters(5)} [dot] com"]), "")],
        "identifier": [lambda: (pick(["ssn ", "", "social security "]), f"{digits(3)}-{digits(2)}-{digits(4)}", pick(["", "."])), lambda: (pick(["iban ", "", "account "]), pick([f"{letters(2, upper)}{digits(some(14, 23))}", f"{letters(2, upper)}{digits(2)} " + " ".join(digits(4) for _ in range(4)) + f" {digits(2)}"]), pick(["", ".", ","]))],
        "secret": [lambda: (pick(['token = "', 'TOKEN = "', "key: ", "", "api key ", "password=", 'secret="', "'"]), pick([hexes(40), hexes(32), hexes(40).upper(), mixed(20), mixed(32), f"AKIA{''.join(pick(upper + '0123456789') for _ in range(14))}{digits(1)}{letters(1, upper)}"]), pick(['"', "", "###", ".", '"!!', "'"])), lambda: (pick(["password: ", "pwd=", "password = "]), letters(some(3, 7)) + digits(some(1, 4)), pick(["", ",", "."]))],
    }
    table = []
    for r in range(rows):
        before, after = (" ".join(neutral() for _ in range(some(0, 7))) for _ in range(2))
        if r % 3 == 2:
            text, inside, kind = f"{before} {after}", (0, 0), "outside"
        else:
            kind = ADDED[r // 3 % len(ADDED)]
            lead, item, tail = pick(items[kind])()
            text, inside = f"{before} {lead}{item}{tail} {after}", (len(before) + 1 + len(lead), len(before) + 1 + len(lead) + len(item))
        marks = list(_TOKEN.finditer(text))
        table.append(([m[0] for m in marks], [kind if inside[0] <= m.start() < inside[1] else "outside" for m in marks]))
    return table


#: Places whose words bear on a label: this word, the ones before, the ones after.
PLACES = (0, -1, -2, 1, 2)


class Field:
    """Scores of a label at a word: weights of the features of the words at PLACES, and of moves between labels."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray) -> None:
        self.names, self.weights, self.moves = names, weights, moves  # weights: PLACES x features x labels
        gain = (moves[:, :, None] + moves[None, :, :]) - (moves[:, :1, None] + moves[None, :1, :])
        #: What transitions can make up at most for another label than the first at one word, inside or at an end.
        self.reach = float(max(gain.max(), (moves - moves[:, :1]).max(), (moves - moves[:1, :]).max(), 0.0))

    def scores(self, word: str) -> np.ndarray:
        """What a word adds at its own place and to its neighbours': PLACES x labels."""
        known = [self.names[f] for f in features(word) if f in self.names]
        return self.weights[:, known].sum(axis=1)

    def emissions(self, table: np.ndarray, ids: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the words numbered `at`, words x labels. table: PLACES x known words x labels; words of a text follow each
        other, texts, none of which is empty, end at ends."""
        text = np.searchsorted(ends, at, "right")
        starts, ends_ = np.r_[0, ends[:-1]][text], ends[text]
        out = table[0][ids[at]]
        for p, place in enumerate(PLACES):
            if place:
                ok = np.flatnonzero((at + place >= starts) & (at + place < ends_))
                out[ok] += table[p][ids[at[ok] + place]]
        return out

    def decode(self, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best labels of stretches that follow each other in emissions (words x labels), all of a length at once."""
        out = np.zeros(len(emissions), np.int64)
        starts = np.cumsum(lengths) - lengths
        for size in np.unique(lengths[lengths > 0]):
            rows = starts[lengths == size][:, None] + np.arange(size)
            best, back = emissions[rows[:, 0]], []
            for t in range(1, size):
                total = best[:, :, None] + self.moves[None]
                back.append(total.argmax(axis=1))
                best = total.max(axis=1) + emissions[rows[:, t]]
            y = best.argmax(axis=1)
            out[rows[:, -1]] = y
            for t in range(size - 2, -1, -1):
                y = back[t][np.arange(len(rows)), y]
                out[rows[:, t]] = y
        return out

    def label(self, table: np.ndarray, most: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The best paths over whole texts, decoding only around words that may be labelled. most: PLACES x known words, by
        how much a word can favour another label over the first."""
        bound = most[0][ids]
        starts = np.r_[0, ends[:-1]]
        for p, place in enumerate(PLACES):
            if not place or len(ids) <= abs(place):
                continue
            moved = most[p][ids]
            for k in range(abs(place)):  # words whose neighbour would lie in another text
                moved[(ends - 1 - k)[ends - 1 - k >= starts] if place < 0 else (starts + k)[starts + k < ends]] = 0
            if place < 0:
                bound[-place:] += moved[:place]
            else:
                bound[:-place] += moved[place:]
        open_ = np.flatnonzero(bound + self.reach >= -1e-3)
        out = np.zeros(len(ids), np.int64)
        e = self.emissions(table, ids, ends, open_)
        keep = e[:, 1:].max(axis=1) - e[:, 0] + self.reach >= -1e-3
        open_, e = open_[keep], e[keep]
        if not len(open_):
            return out
        # a stretch has the certain words on both sides, as far as its text goes, which fix its ends to the first label
        text = np.searchsorted(ends, open_, "right")
        take = np.unique(np.concatenate([open_, np.maximum(open_ - 1, starts[text]), np.minimum(open_ + 1, ends[text] - 1)]))
        of = np.searchsorted(ends, take, "right")
        cut = np.flatnonzero(np.r_[True, (np.diff(take) > 1) | (np.diff(of) > 0)])
        each = np.full((len(take), len(LABELS)), -1e9, np.float64)
        each[:, 0] = 0
        each[np.searchsorted(take, open_)] = e
        out[take] = self.decode(each, np.diff(np.r_[cut, len(take)]))
        return out


@lru_cache(maxsize=1)
def train(rounds: int = 170, rate: float = 0.2, decay: float = 1e-3) -> Field:
    """Gradient ascent of the mean log-likelihood over all rows of the table at once, with Adam; deterministic."""
    table = training_table() + [labelled(*row) for row in sentence_rows(SENTENCES, 8 * len(SENTENCES), 6)]
    names = {f: i for i, f in enumerate(sorted({f for words, _ in table for w in words for f in features(w)}))}
    n, m, longest = len(LABELS), len(table), max(len(w) for w, _ in table)
    # features of the different words, and which word stands at a place beside each word; the last is none
    vocabulary = {w: i for i, w in enumerate(sorted({w for words, _ in table for w in words}))}
    known = np.zeros((len(vocabulary) + 1, len(names)))
    for w, i in vocabulary.items():
        known[i, [names[f] for f in features(w)]] = 1
    beside = np.full((len(PLACES), m, longest), len(vocabulary))
    for r, (words, _) in enumerate(table):
        for p, place in enumerate(PLACES):
            for t in range(max(0, -place), min(len(words), len(words) - place)):
                beside[p, r, t] = vocabulary[words[t + place]]
    beside = beside.reshape(len(PLACES), -1)
    gold = np.zeros((m, longest), np.int64)
    inside = np.zeros((m, longest), bool)
    for r, (words, labels) in enumerate(table):
        gold[r, : len(words)] = [LABELS.index(x) for x in labels]
        inside[r, : len(words)] = True
    params = [np.zeros((len(PLACES), len(names), n)), np.zeros((n, n))]
    first, second = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    onehot = np.eye(n)[gold] * inside[:, :, None]
    pairs = inside[:, 1:].astype(float)
    gold_moves = np.zeros((n, n))
    np.add.at(gold_moves, (gold[:, :-1][inside[:, 1:]], gold[:, 1:][inside[:, 1:]]), 1)
    lse = lambda x, axis: (top := x.max(axis=axis)) + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis=axis))
    for step in range(1, rounds + 1):
        weights, moves = params
        e = sum((known @ w)[at] for w, at in zip(weights, beside, strict=True)).reshape(m, longest, n)
        forward, backward = [e[:, 0]], [np.zeros((m, n))]
        for t in range(1, longest):
            forward.append(np.where(inside[:, t, None], e[:, t] + lse(forward[-1][:, :, None] + moves, 1), forward[-1]))
        for t in range(longest - 2, -1, -1):
            backward.append(np.where(inside[:, t + 1, None], lse(moves[None] + (e[:, t + 1] + backward[-1])[:, None, :], 2), backward[-1]))
        backward.reverse()
        z = lse(forward[-1], 1)
        marginal = np.exp(np.stack(forward, 1) + np.stack(backward, 1) - z[:, None, None]) * inside[:, :, None]
        error = ((onehot - marginal) / m).reshape(-1, n)
        by_word = [np.stack([np.bincount(at, error[:, k], len(known)) for k in range(n)], axis=1) for at in beside]
        grads = [np.stack([known.T @ g for g in by_word]) - decay * weights / 10, gold_moves / m - decay * moves]
        for t in range(1, longest):
            both = np.exp(forward[t - 1][:, :, None] + moves + (e[:, t] + backward[t])[:, None, :] - z[:, None, None])
            grads[1] -= (both * pairs[:, t - 1, None, None]).sum(axis=0) / m
        for k, g in enumerate(grads):
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g * g - second[k])
            params[k] = params[k] + rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Field(names, *params)


class _Scores(dict):
    """Words to numbers of what is known of them, and the scores of those; a bounded number of words is kept."""

    LIMIT = 1 << 17

    def __init__(self, field: Field) -> None:
        super().__init__()
        self.field, self.known = field, {}
        self.table, self.most = np.zeros((len(PLACES), 256, len(LABELS))), np.zeros((len(PLACES), 256), np.float32)

    def __missing__(self, word: str) -> int:
        # most words are plain small ones, of which only the length counts
        what = word.islower() and word.isalpha() and word not in CUES and len(word).bit_length() or tuple(features(word))
        k = self.known.setdefault(what, len(self.known))
        if k >= self.most.shape[1]:
            self.table, self.most = (np.concatenate([x, np.zeros_like(x)], axis=1) for x in (self.table, self.most))
        if k == len(self.known) - 1:
            self.table[:, k] = self.field.scores(word)
            self.most[:, k] = (self.table[:, k, 1:] - self.table[:, k, :1]).max(axis=1)
        if len(self) < self.LIMIT:
            self[word] = k
        return k

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def label(self, words: list[str], ends: np.ndarray) -> np.ndarray:
        ids = self.of(words)
        return self.field.label(self.table, self.most, ids, ends)


def added_spans(texts: list[str], scores: _Scores, base: list[list[tuple[int, int, str]]]) -> list[list[tuple[int, int, str]]]:
    """Runs of one label in each text, without those that touch a span of the base."""
    tokens = [words_of(x) for x in texts]
    ends = np.cumsum([len(t) for t in tokens])
    flat = [w for t in tokens for w in t]
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    if not flat:
        return out
    filled = np.unique(ends[np.diff(np.r_[0, ends]) > 0])  # empty texts have no words to end
    labels = scores.label(flat, filled)
    hits = np.flatnonzero(labels)
    for x in np.unique(np.searchsorted(ends, hits, "right")).tolist():
        mine = labels[ends[x] - len(tokens[x]) : ends[x]]
        edges = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
        runs = [(int(a), int(b) - 1, LABELS[mine[a]]) for a, b in zip(edges, np.r_[edges[1:], len(mine)], strict=True) if mine[a]]
        wanted = {i for a, b, _ in runs for i in (a, b)}
        place = {i: m.span() for i, m in enumerate(_TOKEN.finditer(texts[x])) if i in wanted}
        found = [(place[a][0], place[b][1], kind) for a, b, kind in runs]
        out[x] = [(a, b, kind) for a, b, kind in found if all(b <= p or a >= q for p, q, _ in base[x])]
    return out


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", field: Field | None = None) -> DataFrame:
    """Per row: key, the number of each base kind, base_sha256 and spans; n_added counts what the field adds."""
    shared = docs.sparkSession.sparkContext.broadcast(field or train())
    state: dict[str, _Scores] = {}
    order = {k: i for i, k in enumerate((*BASE, *ADDED))}

    def run(b: dict) -> dict:
        if "scores" not in state:
            state["scores"] = _Scores(shared.value)
        out: dict[str, list] = {c: [] for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")}
        texts = b["__text"].to_pylist()
        each = [base_spans(x) for x in texts]
        for base, more in zip(each, added_spans(texts, state["scores"], each), strict=True):
            for k in BASE:
                out[f"n_{k}"].append(sum(s[2] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(sorted(base + more, key=lambda s: (s[0], order[s[2]]))))
            out["n_added"].append(len(more))
        return {"key": b["__key"]} | out

    frame = docs.select(F.col(f"`{key}`").cast("long").alias("__key"), text_of(text).alias("__text"))
    schema = "key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return map_batches(frame, run, schema).withColumnRenamed("key", key)

"""Benchmark decontamination: a BM25 index of the test items, searched for every passage of every text by block-max WAND.

Index. The documents of the index are the test items, in segments of at most `stride` words; a posting's impact is its BM25
weight divided by the segment's own total, so a score is the share of the segment's BM25 mass that a passage holds, between 0
and 1, and one threshold serves all. Segments are held in blocks; with its postings a term has an upper bound for each block
in which it occurs, and none for the others. The index grows with the benchmark only, in proportion; its size is checked.

Search. A text is read whole, as overlapping passages of 2 * stride words, one each stride, so that each segment lies whole
in one of them. Bounds are summed for all passages at once: a passage whose bound in a block stays below the threshold can't
hold any of the block's segments. For the others, blocks whose bounds over the passage's distinct terms fall short are jumped
over; in the rest WAND walks the posting lists: the pivot is where the lists' bounds in the block first reach the threshold,
and segments before it are passed over; all segments at or above the threshold are returned. This is exact: tests hold it
against scoring every pair.

Verification. A retrieved item counts if the passages that gave it also repeat it in order: an item is cut into question (all
sentences but the last) and answer (the last); the share of the question's and of the answer's word 5-grams that occur in the
passages must both reach `overlap`. A part of three to eight words is cut into shorter runs, of two or three words, so that
one changed word needn't hide it; a shorter part must occur whole. A text that holds all the item's words as one run has both
shares 1, also where the first or last word is part of a longer one. An item of fewer than five words, which any text may
hold by chance, counts where it is the whole text; elsewhere its words, one after the other, make a weak match, which is told
apart (`weak_items`) and doesn't make clean() drop a text. Words are runs of letters and digits, so marks next to them don't
count.

A benchmark beyond `most_mb` MB of text is searched in shards of items, by hash of the item, one after the other: the driver
and the workers hold one shard's index at a time. Matches are kept by row number in the shared folder and joined at the end.
Each shard weighs words by its own items.

Nulls: a null, empty or blank text matches nothing; items without words are left out. Repeated rows match alike; of repeated
items each counts. Long texts and long items are searched whole. Empty tables give no match. Other columns may have any name.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored, text_of, where_text

K1, B = 1.2, 0.75
STRIDE = 64
BLOCK = 4
THRESHOLD = 0.6
OVERLAP = 0.5
GRAM = 5
#: Largest benchmark, of texts, that is read into the driver and sent to all workers.
MOST_MB = 64
#: Passages whose bounds are summed at once.
AT_ONCE = 512
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words of all sentences but the last, and of the last; of a single sentence, its two halves."""
    sentences = [s for s in (words_of(x) for x in re.split(r"(?<=[.!?])\s+", text)) if s]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = sentences[0] if sentences else []
    return words[: len(words) // 2], words[len(words) // 2 :]


def width_of(part: list[str]) -> int:
    """Words in a run of a part: GRAM, or about a third of a short part's words."""
    n = len(part)
    return GRAM if n >= 2 * GRAM - 1 else min(n, max(2, (n + 1) // 3))


def grams(words: list[str], width: int = GRAM) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


@dataclass
class Index:
    items: list[int]
    parts: list[tuple[list[str], list[str]]]
    item_of: np.ndarray  # of each segment
    terms: dict[str, int]
    postings: list[tuple[np.ndarray, np.ndarray]]  # per term: segments, ascending, and impacts
    first: np.ndarray  # per term, and after the last: where its bounds begin
    blocks: np.ndarray  # of each bound, ascending within a term
    bounds: np.ndarray
    stride: int
    short: dict[str, list[tuple[int, list[str]]]] = field(default_factory=dict)  # items of fewer than GRAM words, by the first

    def sums(self, terms: np.ndarray, cells: np.ndarray, n: int) -> np.ndarray:
        """Sums of the terms' bounds by cell, of n, and block."""
        size = 1 + (int(self.item_of.size) - 1) // BLOCK
        count = self.first[terms + 1] - self.first[terms]
        at = np.repeat(self.first[terms] - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.bincount(np.repeat(cells, count) * size + self.blocks[at], self.bounds[at], n * size).reshape(n, size)

    def retrieve(self, terms: list[int], threshold: float) -> dict[int, float]:
        """All segments whose score over the distinct terms is at least the threshold. Only blocks whose bounds add up to it
        are walked."""
        out: dict[int, float] = {}
        if terms:
            slack = threshold - 1e-6
            for block in np.flatnonzero(self.sums(np.array(terms), np.zeros(len(terms), np.int64), 1)[0] >= slack - 1e-6).tolist():
                self._walk(terms, block, slack, out)
        return out

    def _walk(self, terms: list[int], block: int, slack: float, out: dict[int, float]) -> None:
        """WAND within a block: lists in the order of their next segment, the pivot where their bounds reach the threshold."""
        low, high = block * BLOCK, (block + 1) * BLOCK
        lists = []
        for t in terms:
            x, y = int(self.first[t]), int(self.first[t + 1])
            at = x + int(np.searchsorted(self.blocks[x:y], block))
            if at < y and self.blocks[at] == block:
                segments, impacts = self.postings[t]
                a, b = np.searchsorted(segments, (low, high))
                lists.append([segments[a:b].tolist(), impacts[a:b].tolist(), 0, float(self.bounds[at])])
        while True:
            order = sorted((x for x in lists if x[2] < len(x[0])), key=lambda x: x[0][x[2]])
            total, pivot = 0.0, -1
            for p, x in enumerate(order):
                total += x[3]
                if total >= slack:
                    pivot = p
                    break
            if pivot < 0:
                return
            segment = order[pivot][0][order[pivot][2]]
            score = 0.0
            for x in order:
                if x[0][x[2]] > segment:
                    break
                while x[2] < len(x[0]) and x[0][x[2]] < segment:  # passed over: too few lists hold it
                    x[2] += 1
                if x[2] < len(x[0]) and x[0][x[2]] == segment:
                    score += x[1][x[2]]
                    x[2] += 1
            if score >= slack:
                out[segment] = score


def build(rows: list[tuple[int, str]], stride: int = STRIDE) -> Index:
    """Index the items (id, text), in the order of ids."""
    kept = [(i, question_and_answer(t or "")) for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))]
    kept = [(i, qa) for i, qa in kept if qa[0] or qa[1]]
    bags, item_of = [], []
    for k, (_, (q, a)) in enumerate(kept):
        words = q + a
        # segments of equal length, the last one whole
        for at in sorted({min(s, max(0, len(words) - stride)) for s in range(0, len(words), stride)}):
            bags.append(Counter(words[at : at + stride]))
            item_of.append(k)
    df = Counter(w for bag in bags for w in bag)
    n, lengths = len(bags), [sum(b.values()) for b in bags]
    mean = sum(lengths) / max(1, n)
    found: dict[str, list[tuple[int, float]]] = defaultdict(list)
    for k, bag in enumerate(bags):
        norm = K1 * (1 - B + B * lengths[k] / mean)
        impact = {w: np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f * (K1 + 1) / (f + norm) for w, f in bag.items()}
        total = sum(impact.values())
        for w, x in impact.items():
            found[w].append((k, float(x / total)))
    terms = {w: t for t, w in enumerate(sorted(found))}
    postings = [(np.array([k for k, _ in found[w]], np.int32), np.array([x for _, x in found[w]], np.float32)) for w in terms]
    first, blocks, bounds = [0], [], []
    for segments, impacts in postings:
        edges = np.flatnonzero(np.r_[True, np.diff(segments // BLOCK) > 0])
        blocks.append(segments[edges] // BLOCK)
        bounds.append(np.maximum.reduceat(impacts, edges))
        first.append(first[-1] + len(edges))
    flat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, kind)
    short: dict[str, list[tuple[int, list[str]]]] = defaultdict(list)
    for i, (q, a) in kept:
        if len(q + a) < GRAM:
            short[(q + a)[0]].append((i, q + a))
    return Index([i for i, _ in kept], [qa for _, qa in kept], np.array(item_of, np.int64), terms, postings, np.array(first), flat(blocks, np.int64), flat(bounds, np.float32), stride, dict(short))


def _items(benchmark: DataFrame, item: str, text: str) -> tuple[DataFrame, int]:
    rows = benchmark.select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").alias("text"))
    return rows, rows.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0


def load_index(benchmark: DataFrame, item: str = "item_id", text: str = "text", stride: int = STRIDE, most_mb: int = MOST_MB) -> Index:
    """The test set is read into the driver: it is the stated query set, and doesn't grow with the corpus. One of more than
    most_mb MB is refused; search_benchmark() and clean_benchmark() search for it in shards."""
    rows, size = _items(benchmark, item, text)
    if size > most_mb * 1_000_000:
        raise ValueError(f"a benchmark of {size / 1e6:.0f} MB is more than {most_mb} MB")
    return build([tuple(r) for r in rows.collect()], stride)


def shards(benchmark: DataFrame, item: str = "item_id", text: str = "text", stride: int = STRIDE, most_mb: float = MOST_MB) -> Iterator[Index]:
    """Indexes of at most about most_mb MB of items each, one for every benchmark within it."""
    rows, size = _items(benchmark, item, text)
    n = max(1, -(-size // int(most_mb * 1_000_000)))
    of = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    for k in range(n):
        yield build([tuple(r) for r in rows.where(of == k).collect()], stride)


class _Ids(dict):
    """Word to term number; unknown words get the last number. A bounded number of words is kept."""

    LIMIT = 1 << 17

    def __init__(self, terms: dict[str, int]) -> None:
        super().__init__()
        self.terms = terms

    def __missing__(self, word: str) -> int:
        value = self.terms.get(word, len(self.terms))
        if len(self) < self.LIMIT:
            self[word] = value
        return value


class Searcher:
    def __init__(self, index: Index, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> None:
        self.index, self.threshold, self.overlap = index, threshold, overlap
        self.ids = _Ids(index.terms)

    def candidates(self, words: list[str]) -> dict[int, tuple[float, list[int]]]:
        """Of each item with a segment that reaches the threshold in some passage: the best score, and the passages."""
        ix, unknown = self.index, len(self.index.terms)
        if not words or not ix.items:
            return {}
        ids = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        known = np.flatnonzero(ids != unknown)
        if not len(known):
            return {}
        out: dict[int, tuple[float, list[int]]] = {}
        strides = -(-len(ids) // ix.stride)
        for start in range(0, strides, AT_ONCE):  # of a very long text, some passages at a time
            stop = min(strides, start + AT_ONCE)
            a, b = np.searchsorted(known, (start * ix.stride, (stop + 1) * ix.stride))
            part = known[a:b]
            sums = ix.sums(ids[part], part // ix.stride - start, stop + 1 - start)
            bounds = (sums[:-1] + sums[1:]).max(axis=1)
            for w in np.flatnonzero(bounds >= self.threshold - 1e-4).tolist():
                terms = np.unique(ids[(start + w) * ix.stride : (start + w + 2) * ix.stride])
                for k, score in ix.retrieve(terms[terms != unknown].tolist(), self.threshold).items():
                    best, passages = out.setdefault(int(ix.item_of[k]), (0.0, []))
                    out[int(ix.item_of[k])] = (max(best, score), [*passages, start + w])
        return out

    def weak(self, text: str) -> list[int]:
        """Ids of the short items whose words follow each other in a longer text, in order, each as often as it is an item."""
        if not self.index.short:
            return []
        words, found = words_of(text), {}
        for at, w in enumerate(words):
            for k, (item, phrase) in enumerate(self.index.short.get(w, ())):
                if words[at : at + len(phrase)] == phrase != words:
                    found[w, k] = item
        return sorted(found.values(), key=lambda i: (i is not None, i or 0))

    def matches(self, text: str) -> list[tuple[int, float, float, float]]:
        """item id, score, question overlap, answer overlap of each verified item, in the order of ids."""
        words = words_of(text)
        found = self.candidates(words)
        if not found:
            return []
        joined, stride = " ".join(words), self.index.stride
        have: dict[tuple[int, int], set] = {}
        out = []
        for k in sorted(found):
            score, passages = found[k]
            parts = self.index.parts[k]
            whole = parts[0] + parts[1]
            if len(whole) < GRAM:
                shares = [1.0, 1.0] if words == whole else [0.0, 0.0]
            elif " ".join(whole) in joined:
                shares = [1.0, 1.0]
            else:
                shares = []
                for part in parts:
                    width = width_of(part)
                    g = grams(part, width) if width else set()
                    hit: set = set()
                    for w in passages if g else []:
                        if (w, width) not in have:
                            have[w, width] = grams(words[w * stride : (w + 2) * stride], width)
                        hit |= g & have[w, width]
                    shares.append(len(hit) / len(g) if g else 1.0)
            if min(shares) >= self.overlap:
                out.append((self.index.items[k], score, shares[0], shares[1]))
        return out


def search(docs: DataFrame, index: Index, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """One row per row of docs: key, n_items, the verified items with their scores, and the short items that are weak matches."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    state: dict[str, Searcher] = {}

    def run(b: dict) -> dict:
        if "searcher" not in state:
            state["searcher"] = Searcher(shared.value, threshold, overlap)
        texts = b["__text"].to_pylist()
        found = [state["searcher"].matches(x) for x in texts]
        weak = [state["searcher"].weak(x) for x in texts] if state["searcher"].index.short else [[]] * len(texts)
        return {
            "key": b["__key"],
            "n_items": [len(f) for f in found],
            "items": [[m[0] for m in f] for f in found],
            "scores": [[round(m[1], 4) for m in f] for f in found],
            "question_overlap": [[round(m[2], 4) for m in f] for f in found],
            "answer_overlap": [[round(m[3], 4) for m in f] for f in found],
            "weak_items": weak,
        }

    frame = docs.select(F.col(f"`{key}`").cast("long").alias("__key"), text_of(text).alias("__text"))
    schema = "key long, n_items int, items array<long>, scores array<double>, question_overlap array<double>, answer_overlap array<double>, weak_items array<long>"
    return map_batches(frame, run, schema).withColumnRenamed("key", key)


def clean(docs: DataFrame, index: Index, text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of docs that hold no test item, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    state: dict[str, Searcher] = {}

    def free(text: str) -> bool:
        if "searcher" not in state:
            state["searcher"] = Searcher(shared.value, threshold, overlap)
        return not state["searcher"].matches(text)

    return where_text(docs, free, text)


_LISTS = ("items", "scores", "question_overlap", "answer_overlap")


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a row number, stored, so that the number is the same in every pass."""
    return stored(docs.withColumn("__row", F.monotonically_increasing_id()), "leak-rows")


def search_benchmark(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", most_mb: float = MOST_MB) -> DataFrame:
    """search() for a benchmark of any size: one shard after the other."""
    indexes = shards(benchmark, most_mb=most_mb)
    first, second = next(indexes), next(indexes, None)
    if second is None:
        return search(docs, first, key, text)
    rows = _numbered(docs.select(F.col(f"`{key}`").cast("long").alias("__key"), text_of(text).alias("__body")))
    hits = []
    for index in chain((first, second), indexes):
        found = search(rows, index, "__row", "__body")
        hits.append(stored(found.where("n_items > 0 OR size(weak_items) > 0"), "leak-hits"))
    every = reduce(DataFrame.unionByName, hits)
    joined = every.groupBy("__row").agg(F.array_sort(F.flatten(F.collect_list(F.arrays_zip(*_LISTS)))).alias("m"), F.array_sort(F.flatten(F.collect_list("weak_items"))).alias("weak"))
    none = F.array().cast("array<struct<items:long,scores:double,question_overlap:double,answer_overlap:double>>")
    both = rows.select("__row", "__key").join(joined, "__row", "left").withColumns({"m": F.coalesce("m", none), "weak": F.coalesce("weak", F.array().cast("array<long>"))})
    return both.select(F.col("__key").alias(key), F.size("m").alias("n_items"), *[F.col(f"m.{c}").alias(c) for c in _LISTS], F.col("weak").alias("weak_items"))


def clean_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", most_mb: float = MOST_MB) -> DataFrame:
    """clean() for a benchmark of any size: what one shard leaves is stored and searched for the next one's items."""
    for k, index in enumerate(shards(benchmark, most_mb=most_mb)):
        docs = clean(stored(docs, "leak-clean") if k else docs, index, text)
    return docs

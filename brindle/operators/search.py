"""Filtered vector and full-text top-k, rank fusion, hydration, neighbours, reranking.

Filters stand below the ranking, so they reach the scan; rankings are ``orderBy().limit()``, which Spark runs as a top-k of
each partition; only ids and scores are ranked, and texts are joined to the few ids that are left.
"""

from __future__ import annotations

import re
from base64 import b64decode
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.stem import english
from brindle.functions.text import local_date, words

CANDIDATES, TOP, RRF_K, RADIUS = 50, 10, 60, 1


def all_of(*conditions: Column | None) -> Column:
    """Optional conditions joined by and; none at all lets every row pass."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def in_or_all(c: Column, values: Sequence | None) -> Column | None:
    """An empty list is no filter."""
    return c.isin(*values) if values else None


def scoped(rows: DataFrame, owner: Column, user, mailbox: Column, mailboxes: Sequence) -> DataFrame:
    """Rows of one user in the given mailboxes; no mailbox, no row."""
    return rows.where(F.lit(False)) if not mailboxes else rows.where((owner == user) & mailbox.isin(*mailboxes))


def on_local_days(c: Column, since: str | None, until: str | None, zone: str = "Europe/Berlin") -> Column:
    day = local_date(c, zone)
    return all_of(day >= F.lit(since).cast("date") if since else None, day <= F.lit(until).cast("date") if until else None)


def contains_any(text: str, *columns: Column) -> Column:
    """Case-insensitive containment in one of the columns; wildcards in the text stay wildcards."""
    return reduce(lambda a, b: a | b, [F.coalesce(c.ilike(f"%{text}%"), F.lit(False)) for c in columns])


def equals_any(text: str, *columns: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(c) == text.lower(), F.lit(False)) for c in columns])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def ranked(rows: DataFrame, score: Column, ident: str, k: int) -> DataFrame:
    """id, rank from 1, score of the k best; ties by id."""
    top = rows.select(F.col(ident).alias("id"), score.alias("score")).where("score is not null").orderBy(F.desc("score"), "id").limit(k)
    return top.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"), "score")


def semantic_topk(rows: DataFrame, query: Sequence[float] | Column, ident: str, vector: str = "embedding", k: int = CANDIDATES) -> DataFrame:
    q = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])
    return ranked(rows.where(F.col(vector).isNotNull()), F.round(cosine(F.col(vector), q), 6), ident, k)


#: English words that carry no meaning in a search.
STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself",
    "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into",
    "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when",
    "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can",
    "will", "just", "don", "should", "now",
)
#: Of an array of words to that of their stems. A stem may end otherwise than its word in the last TAIL letters only.
Stemmer = Callable[[Column], Column]
TAIL = 2
#: So many words of a text are stemmed at once.
PIECE = 16


def light_stem(words: Column) -> Column:
    """Plurals to singulars: a stemmer without Python, for other languages than English."""

    def one(word: Column) -> Column:
        cut = lambda n, end="": F.concat(F.substr(word, F.lit(1), F.length(word) - n), F.lit(end))
        return F.when(word.rlike("[^ea]ies$"), cut(3, "y")).when(word.rlike("[^aeo]es$"), cut(1)).when(word.rlike("[^us]s$"), cut(1)).otherwise(word)

    return F.transform(words, one)


def query_terms(query: str, stop: Sequence[str] = STOP_WORDS) -> list[str]:
    """Distinct words of a plain query, in small letters, without stop words; they are still to be stemmed."""
    return [w for w in dict.fromkeys(re.findall(r"[^\W_]+", query.lower())) if w not in stop]


def stems_of(spark: SparkSession, query: str, stem: Stemmer = english) -> list[str]:
    """The distinct stems of a query's terms."""
    terms = query_terms(query)
    return list(dict.fromkeys(spark.range(1).select(stem(F.array(*map(F.lit, terms)))).first()[0])) if terms else []


def _stemmed(placed: Column, stem: Stemmer) -> Column:
    """pos and term of an array of (pos, word)."""
    return F.zip_with(placed, stem(F.transform(placed, lambda p: p["word"])), lambda p, t: F.struct(p["pos"].alias("pos"), t.alias("term")))


def _placed(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)")), lambda w, i: F.struct((i + 1).alias("pos"), w.alias("word")))
    return F.filter(found, lambda p: ~p["word"].isin(*STOP_WORDS))


def lexemes(text: Column, stem: Stemmer = english) -> Column:
    """Stems of all words with their places, from 1; stop words keep their place and are left out."""
    return _stemmed(_placed(text), stem)


def postings(rows: DataFrame, ident: str, text: str = "text", stem: Stemmer = english) -> DataFrame:
    """term, id, positions: the index. Written once, by index_of, it serves queries without the texts."""
    # words go to the stemmer in short pieces, so that a batch of long texts isn't held at once; explode makes them once
    whole = rows.select(F.col(ident).alias("id"), F.explode(F.array(_placed(F.col(text)))).alias("placed")).where(F.size("placed") > 0)
    pieces = whole.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size("placed"), F.lit(PIECE)), lambda at: F.slice("placed", at, F.lit(PIECE)))).alias("piece"))
    each = pieces.select("id", F.explode(_stemmed(F.col("piece"), stem)).alias("p"))
    return each.groupBy(F.col("p.term").alias("term"), "id").agg(F.array_sort(F.collect_list("p.pos")).alias("positions"))


def index_of(rows: DataFrame, ident: str, text: str = "text", stem: Stemmer = english) -> DataFrame:
    """postings() as they are to be stored: each file in the order of its terms, so that a query reads the pages of its terms in
    every file and skips the others. Lists aren't shuffled once more to lie in one file each: a frequent term's would be one
    task's."""
    return postings(rows, ident, text, stem).sortWithinPartitions("term", "id")


def occurrences(rows: DataFrame, stems: Sequence[str], ident: str, text: str = "text", stem: Stemmer = english) -> DataFrame:
    """id, pos and term of the given stems in the texts that have the beginnings of all of them, without an index. Only these
    texts are cut into words."""
    heads = [t[: max(1, len(t) - TAIL)] for t in stems]
    begins = [F.contains(F.lower(F.col(text)), F.lit(h)) for h in heads]
    # of all words only those that begin like a stem are stemmed; explode keeps Spark from doing it all twice
    near = F.filter(_placed(F.col(text)), lambda p: reduce(lambda a, b: a | b, [p["word"].startswith(h) for h in heads]))
    few = rows.where(all_of(*begins)).select(F.col(ident).alias("id"), F.explode(F.array(near)).alias("near"))
    found = few.select("id", _stemmed(F.col("near"), stem).alias("at")).select("id", F.explode(F.array(F.filter("at", lambda p: p["term"].isin(*stems)))).alias("at"))
    return found.where(F.size(F.array_distinct(F.transform("at", lambda p: p["term"]))) == len(stems)).select("id", F.inline("at"))


def cover_density(found: DataFrame, stems: Sequence[str]) -> DataFrame:
    """id and score of the rows that have all stems. found: id, pos, term.

    A cover is a stretch of a text that has all terms and no shorter one within. It weighs 0.1 / (1 + the words in it that
    aren't terms), and a text the sum of its covers. The occurrences of one text stand in one window.
    """
    order = Window.partitionBy("id").orderBy("pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = found.withColumn("rn", F.row_number().over(order))
    # where each term stood last; the least of these places begins the cover that ends here
    last = [F.last(F.when(F.col("term") == t, F.struct("pos", "rn")), ignorenulls=True).over(so_far) for t in stems]
    covers = numbered.withColumn("last", F.array(*last)).where(~F.exists("last", lambda x: x.isNull())).withColumn("first", F.array_min("last"))
    fresh = covers.withColumn("earlier", F.lag("first.pos").over(order)).where(~F.col("first.pos").eqNullSafe(F.col("earlier")))
    noise = (F.col("pos") - F.col("first.pos")) - (F.col("rn") - F.col("first.rn"))
    return fresh.groupBy("id").agg(F.sum(F.lit(0.1) / (1 + noise)).alias("score"))


def fulltext_topk(rows: DataFrame, query: str, ident: str, text: str = "text", k: int = CANDIDATES, stem: Stemmer = english) -> DataFrame:
    """Rows that have all of the query's terms, by cover density. A query of stop words only finds nothing."""
    stems = stems_of(rows.sparkSession, query, stem)
    if not stems:
        return ranked(rows.where(F.lit(False)), F.lit(0.0), ident, k)
    return ranked(cover_density(occurrences(rows, stems, ident, text, stem), stems), F.round("score", 6), "id", k)


def indexed_topk(index: DataFrame, query: str, k: int = CANDIDATES, stem: Stemmer = english) -> DataFrame:
    """fulltext_topk over postings(): only the lists of the query's terms are read."""
    stems = stems_of(index.sparkSession, query, stem)
    if not stems:
        return ranked(index.where(F.lit(False)), F.lit(0.0), "id", k)
    lists = index.where(F.col("term").isin(*stems))
    every = lists.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(stems)).select("id")
    found = lists.join(every, "id", "left_semi").select("id", F.explode("positions").alias("pos"), "term")
    return ranked(cover_density(found, stems), F.round("score", 6), "id", k)


def rrf(semantic: DataFrame, fulltext: DataFrame, top: int = TOP, k: int = RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank); ties by the place in the semantic list, then in the full-text list."""
    both = semantic.select("id", F.col("rank").alias("s"), F.lit(None).cast("int").alias("f")).unionByName(fulltext.select("id", F.lit(None).cast("int").alias("s"), F.col("rank").alias("f")))
    sums = both.groupBy("id").agg(F.max("s").alias("semantic_rank"), F.max("f").alias("fulltext_rank"))
    score = F.coalesce(1.0 / (k + F.col("semantic_rank")), F.lit(0.0)) + F.coalesce(1.0 / (k + F.col("fulltext_rank")), F.lit(0.0))
    first = F.coalesce("semantic_rank", F.col("fulltext_rank") + 1_000_000)
    best = sums.withColumns({"fusion_score": F.round(score, 9), "__first": first}).orderBy(F.desc("fusion_score"), "__first").limit(top)
    return best.select(F.row_number().over(Window.orderBy(F.desc("fusion_score"), "__first")).alias("rank"), "id", "fusion_score", "semantic_rank", "fulltext_rank")


def neighbours(fused: DataFrame, chunks: DataFrame, parent: str, index: str, ident: str, radius: int = RADIUS) -> DataFrame:
    """Chunks within the radius of a hit and of its parent, not hits themselves, each given to its best-ranked hit."""
    hits = fused.select("rank", "id").join(chunks.select(F.col(ident).alias("id"), F.col(parent).alias("__p"), F.col(index).alias("__i")), "id")
    near = F.broadcast(hits).join(chunks, (F.col("__p") == F.col(parent)) & F.col(index).between(F.col("__i") - radius, F.col("__i") + radius))
    near = near.where(F.col(ident) != F.col("id")).join(F.broadcast(fused.select(F.col("id").alias(ident))), ident, "left_anti")
    claimed = near.withColumn("__n", F.row_number().over(Window.partitionBy(ident).orderBy("rank"))).where("__n = 1")
    return claimed.select("rank", F.col("id").alias("hit_id"), F.col(ident).alias("neighbour_id"))


def hydrate(fused: DataFrame, rows: DataFrame, ident: str) -> DataFrame:
    """The fused list with the rows' columns; ids that don't load drop out, the cut isn't filled up."""
    return rows.join(F.broadcast(fused).withColumnRenamed("id", "__id"), F.col(ident) == F.col("__id")).drop("__id")


def rerank(fused: DataFrame, verdicts: DataFrame, top: int = TOP) -> DataFrame:
    """Full before partial or failed, each in the old order; "none" drops out. verdicts: id, verdict (null: failed)."""
    group = F.when(F.col("verdict") == "full", 0).otherwise(1)
    judged = fused.join(verdicts, "id", "left").where(F.coalesce(F.col("verdict"), F.lit("partial")) != "none").withColumn("__g", group)
    best = judged.orderBy("__g", "rank").limit(top)
    return best.select(F.row_number().over(Window.orderBy("__g", "rank")).alias("rank"), "id", F.coalesce("verdict", F.lit("partial")).alias("verdict"))


def remote_scan(rows: DataFrame, columns: Sequence[str], equal: dict | None = None, null: Sequence[str] = (), where: Sequence[Column] = (), order: Sequence[Column] = (), limit: int | None = None) -> DataFrame:
    """The select, eq, is null, order and limit of a remote table's interface; filters come first, so that they reach the scan."""
    conditions = [F.col(c) == v for c, v in (equal or {}).items()] + [F.col(c).isNull() for c in null] + list(where)
    found = rows.where(all_of(*conditions)).select(*columns)
    found = found.orderBy(*order) if order else found
    return found.limit(limit) if limit else found


def with_count(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """Parents with the number of their children, 0 where there are none."""
    counts = children.groupBy(key).agg(F.count("*").alias(name))
    return parents.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def scoped_hydrate(fused: DataFrame, rows: DataFrame, ident: str, owner: Column, user, mailbox: Column, mailboxes: DataFrame) -> DataFrame:
    """hydrate with the owner's scope applied once more: rows of the user's active mailboxes. mailboxes: id, user_id,
    is_active."""
    active = mailboxes.where((F.col("user_id") == user) & F.col("is_active")).select(F.col("id").alias("__m"))
    return hydrate(fused, rows.where(owner == user).join(F.broadcast(active), mailbox == F.col("__m"), "left_semi"), ident)


def newest(rows: DataFrame, time: str, ident: str, k: int) -> DataFrame:
    """Filters only: the newest rows with the constant score 1."""
    return rows.orderBy(F.desc(time), ident).limit(k).select(F.col(ident).alias("id"), F.col(time).alias("at"), F.lit(1.0).alias("score"))


def fixed_chunks(rows: DataFrame, ident: str, text: str = "text", size: int = 512) -> DataFrame:
    """Windows of `size` words without overlap; an empty text is one empty chunk with the count 1."""
    w = words(F.coalesce(F.col(text), F.lit("")))
    starts = F.sequence(F.lit(0), F.greatest(F.size("__w") - 1, F.lit(0)), F.lit(size))
    # explode of one array keeps Spark from splitting the text for every slice; slices come before the next, so that no row carries the words of the whole text
    parts = F.transform(starts, lambda at: F.slice("__w", at + 1, size))
    chunks = F.transform(parts, lambda p: F.struct(F.array_join(p, " ").alias("chunk_text"), F.greatest(F.size(p), F.lit(1)).alias("token_count")))
    split = rows.select(F.col(ident).alias("parent_id"), F.explode(F.array(w)).alias("__w")).select("parent_id", chunks.alias("__c"))
    return split.select("parent_id", F.posexplode("__c").alias("chunk_index", "c")).select("parent_id", "chunk_index", "c.chunk_text", "c.token_count")


def token_chunks(rows: DataFrame, ident: str, subject: str, text: str, path: str, pattern: str, size: int = 512) -> DataFrame:
    """Windows of `size` tokens, without overlap, of subject and text, stripped: parent_id, chunk_index, chunk_text, token_count.
    Tokens are those of a file of ranks; a token that a window cuts within a character decodes to a replacement character. An
    empty mail is one empty chunk with the count 1. A text's chunks are made one after the other, not as one row."""
    whole = F.concat(F.coalesce(subject, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = ranked_encoding(path, pattern)
        for b in batches:
            for k, mail in zip(b["parent_id"], b["mail"], strict=True):
                ids = encoding.encode_ordinary(mail.strip())
                spans = [ids[i : i + size] for i in range(0, max(len(ids), 1), size)]
                yield pd.DataFrame({"parent_id": k, "chunk_index": range(len(spans)), "chunk_text": [encoding.decode(x) for x in spans], "token_count": [max(len(x), 1) for x in spans]})

    return rows.select(F.col(ident).alias("parent_id"), whole.alias("mail")).mapInPandas(run, "parent_id long, chunk_index int, chunk_text string, token_count int")


@lru_cache(4)
def ranked_encoding(path: str, pattern: str):
    """A tokenizer from a file of ranks, without special tokens; one for each worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def looked_up(rows: DataFrame, tables: Sequence[tuple[str, DataFrame]], default: str, name: str) -> DataFrame:
    """rows with a value from the first of several tables that has their key, else the default. tables: pairs of a key column
    and a table of that column and `value`, one row for each key."""
    found = []
    for n, (key, values) in enumerate(tables):
        rows = rows.join(values.select(key, F.col("value").alias(f"__{n}")), key, "left")
        found.append(F.col(f"__{n}"))
    return rows.withColumn(name, F.coalesce(*found, F.lit(default))).drop(*[f"__{n}" for n in range(len(tables))])


def placed(rows: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows and their place, from 1."""
    return rows.orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.orderBy(*order)))

"""Queries of hybrid retrieval over documents and embeddings (vec_id is doc_id)."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import stem
from brindle.operators import search
from brindle.operators.resolve import saved
from brindle.plans.catalog import query, table

_SEM = """SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) AS rank, score FROM (
  SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings {where}) ORDER BY score DESC, vec_id LIMIT {k}"""
_PLACES = "SELECT doc_id AS id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM documents)"


def _stems() -> str:
    """SQL of w and term: the Porter2 steps over the distinct words, one after the other. x: the word so far, with Y for a y
    that is no vowel; p1, p2: where R1 and R2 begin."""
    region = "'^[^aeiouy]*[aeiouy]+[^aeiouy]'"
    short = "'([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$'"
    fixed = lambda pairs: " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs)
    second, third = ("|".join(sorted(m, key=len, reverse=True)) for m in (stem.SECOND, stem.THIRD))
    cut = "length(x) - length(e) + 1"
    return f"""words AS (SELECT DISTINCT w FROM ({_PLACES})),
    a AS (SELECT w, regexp_replace(CASE WHEN left(w, 1) = 'y' THEN 'Y' || substr(w, 2) ELSE w END, '([aeiouy])y', '\\1Y', 'g') AS x FROM words WHERE length(w) > 2 AND w NOT IN ({", ".join(repr(k) for k in stem.SPECIAL)})),
    b AS (SELECT w, x, CASE WHEN regexp_matches(x, '^({"|".join(stem.LEADS)})') THEN length(regexp_extract(x, '^({"|".join(stem.LEADS)})')) + 1
      WHEN regexp_matches(x, {region}) THEN length(regexp_extract(x, {region})) + 1 ELSE length(x) + 1 END AS p1 FROM a),
    c AS (SELECT w, x, p1, CASE WHEN regexp_matches(substr(x, p1), {region}) THEN p1 + length(regexp_extract(substr(x, p1), {region})) ELSE length(x) + 1 END AS p2 FROM b),
    plural AS (SELECT w, p1, p2, CASE WHEN x LIKE '%sses' THEN left(x, -2) WHEN regexp_matches(x, '(ied|ies)$') THEN CASE WHEN length(x) > 4 THEN left(x, -2) ELSE left(x, -1) END
      WHEN regexp_matches(x, '(us|ss)$') THEN x WHEN regexp_matches(x, '[aeiouy].+s$') THEN left(x, -1) ELSE x END AS x FROM c),
    past AS (SELECT w, p1, p2, x, regexp_extract(x, '(eedly|ingly|edly|eed|ing|ed)$') AS e FROM plural WHERE x NOT IN {stem.FINISHED}),
    cut AS (SELECT w, p1, p2, CASE WHEN e LIKE 'eed%' THEN CASE WHEN {cut} >= p1 THEN left(x, length(x) - length(e) + 2) ELSE x END ELSE x END AS x,
      CASE WHEN e <> '' AND e NOT LIKE 'eed%' AND regexp_matches(left(x, length(x) - length(e)), '[aeiouy]') THEN left(x, length(x) - length(e)) END AS r FROM past),
    mended AS (SELECT w, p1, p2, CASE WHEN r IS NULL THEN x WHEN regexp_matches(r, '(at|bl|iz)$') THEN r || 'e' WHEN regexp_matches(r, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(r, -1)
      WHEN p1 > length(r) AND regexp_matches(r, {short}) THEN r || 'e' ELSE r END AS x FROM cut),
    ys AS (SELECT w, p1, p2, CASE WHEN regexp_matches(x, '.[^aeiouy][yY]$') THEN left(x, -1) || 'i' ELSE x END AS x FROM mended),
    s2 AS (SELECT *, regexp_extract(x, '({second})$') AS e FROM ys),
    t2 AS (SELECT w, p1, p2, CASE WHEN e = '' OR {cut} < p1 OR e = 'ogi' AND x NOT LIKE '%logi' OR e = 'li' AND NOT regexp_matches(x, '[cdeghkmnrt]li$') THEN x ELSE left(x, length(x) - length(e)) || CASE e {fixed(stem.SECOND.items())} END END AS x FROM s2),
    s3 AS (SELECT *, regexp_extract(x, '({third})$') AS e FROM t2),
    t3 AS (SELECT w, p1, p2, CASE WHEN e = '' OR {cut} < p1 OR e = 'ative' AND {cut} < p2 THEN x ELSE left(x, length(x) - length(e)) || CASE e {fixed(stem.THIRD.items())} END END AS x FROM s3),
    s4 AS (SELECT *, regexp_extract(x, '({"|".join(sorted(stem.FOURTH, key=len, reverse=True))})$') AS e FROM t3),
    t4 AS (SELECT w, p1, p2, CASE WHEN e = '' OR {cut} < p2 OR e = 'ion' AND NOT regexp_matches(x, '[st]ion$') THEN x ELSE left(x, length(x) - length(e)) END AS x FROM s4),
    t5 AS (SELECT w, CASE WHEN x LIKE '%e' AND (length(x) >= p2 OR length(x) >= p1 AND NOT regexp_matches(left(x, -1), {short})) OR x LIKE '%ll' AND length(x) >= p2 THEN left(x, -1) ELSE x END AS x FROM t4),
    stems AS (SELECT w, lower(x) AS term FROM t5 UNION ALL SELECT w, x FROM plural WHERE x IN {stem.FINISHED} UNION ALL SELECT w, w FROM words WHERE length(w) <= 2
      UNION ALL SELECT w, CASE w {fixed(stem.SPECIAL.items())} END FROM words WHERE w IN ({", ".join(repr(k) for k in stem.SPECIAL)}))"""


_TERMS = f"(WITH {_stems()} SELECT id, pos, w, term FROM ({_PLACES}) JOIN stems USING (w))"


def _cover(a: str, b: str) -> str:
    """SQL of id and score by cover density for two stems."""
    last = lambda t, what: f"last_value(CASE WHEN term = '{t}' THEN {what} END IGNORE NULLS) OVER (PARTITION BY id ORDER BY pos)"
    return f"""SELECT id, sum(0.1::DOUBLE / (1 + (pos - s) - (rn - rs))) AS score FROM (
      SELECT *, lag(s) OVER (PARTITION BY id ORDER BY pos) AS earlier FROM (
        SELECT id, pos, rn, least(pa, pb) AS s, CASE WHEN pa < pb THEN ra ELSE rb END AS rs FROM (
          SELECT id, pos, rn, {last(a, "pos")} AS pa, {last(b, "pos")} AS pb, {last(a, "rn")} AS ra, {last(b, "rn")} AS rb FROM (
            SELECT id, pos, term, row_number() OVER (PARTITION BY id ORDER BY pos) AS rn FROM {_TERMS} WHERE w NOT IN ({', '.join(repr(w) for w in search.STOP_WORDS)}) AND term IN ('{a}', '{b}')))
        WHERE pa IS NOT NULL AND pb IS NOT NULL))
      WHERE earlier IS NULL OR earlier <> s GROUP BY id"""


_QUERY = "The tions of the thon"
_FTS = f"""SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank, score FROM (SELECT id, round(score, 6) AS score FROM ({_cover("tion", "thon")})) ORDER BY score DESC, id LIMIT 50"""
_FUSED = f"""s AS ({_SEM.format(where='', k=50)}), f AS ({_FTS}),
  u AS (SELECT coalesce(s.id, f.id) AS id, s.rank AS semantic_rank, f.rank AS fulltext_rank, round(coalesce(1.0::DOUBLE / (60 + s.rank), 0) + coalesce(1.0::DOUBLE / (60 + f.rank), 0), 9) AS fusion_score FROM s FULL JOIN f ON s.id = f.id),
  fused AS (SELECT row_number() OVER (ORDER BY fusion_score DESC, coalesce(semantic_rank, 1000000 + fulltext_rank)) AS rank, * FROM u QUALIFY rank <= 10)"""


def _vector(spark, d):
    """The query vector, that of vec_id 0, as a literal: one row, looked up by key."""
    return table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]


def _semantic(spark, d, k=50):
    return search.semantic_topk(table(spark, d, "embeddings"), _vector(spark, d), "vec_id", k=k)


def _fulltext(spark, d, k=50):
    return search.fulltext_topk(table(spark, d, "documents"), _QUERY, "doc_id", k=k)


@query(_SEM.format(where="", k=50))
def semantic_topk(spark, d):
    return _semantic(spark, d)


@query(_SEM.format(where="WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en')", k=50))
def semantic_topk_filtered(spark, d):
    wanted = table(spark, d, "documents").where(search.all_of(F.col("lang") == "en", search.in_or_all(F.col("source"), []))).select(F.col("doc_id").alias("vec_id"))
    return search.semantic_topk(table(spark, d, "embeddings").join(wanted, "vec_id", "left_semi"), _vector(spark, d), "vec_id")


@query(_FTS)
def fulltext_match_topk(spark, d):
    return _fulltext(spark, d)


@query(f"WITH {_FUSED} SELECT rank, id, fusion_score, semantic_rank, fulltext_rank FROM fused")
def rrf_fusion(spark, d):
    return search.rrf(_semantic(spark, d), _fulltext(spark, d))


@query(f"WITH {_FUSED} SELECT rank, id, fusion_score, lang, source, length(text) AS n FROM fused JOIN documents ON doc_id = id")
def hybrid_search(spark, d):
    fused = search.rrf(_semantic(spark, d), _fulltext(spark, d))
    found = search.hydrate(fused, table(spark, d, "documents"), "doc_id")
    return found.select("rank", F.col("doc_id").alias("id"), "fusion_score", "lang", "source", F.length("text").alias("n"))


@query(
    f"""WITH {_FUSED}, near AS (SELECT fused.rank, fused.id AS hit_id, b.doc_id AS neighbour_id FROM fused JOIN documents a ON a.doc_id = fused.id JOIN documents b ON a.source = b.source AND b.doc_id BETWEEN a.doc_id - 20 AND a.doc_id + 20
      WHERE b.doc_id NOT IN (SELECT id FROM fused))
    SELECT min(rank) AS rank, min_by(hit_id, rank) AS hit_id, neighbour_id FROM near GROUP BY neighbour_id"""
)
def hybrid_neighbours(spark, d):
    fused = search.rrf(_semantic(spark, d), _fulltext(spark, d))
    return search.neighbours(fused, table(spark, d, "documents").select("doc_id", "source", F.col("doc_id").alias("place")), "source", "place", "doc_id", 20)


@query(
    f"""WITH {_FUSED}, v AS (SELECT rank AS r, id, CASE WHEN id % 4 = 0 THEN 'full' WHEN id % 4 = 1 THEN 'none' ELSE 'partial' END AS verdict FROM fused)
    SELECT row_number() OVER (ORDER BY CASE WHEN verdict = 'full' THEN 0 ELSE 1 END, r) AS rank, id, verdict FROM v WHERE verdict <> 'none'"""
)
def rerank_group_sort(spark, d):
    fused = search.rrf(_semantic(spark, d), _fulltext(spark, d))
    verdict = F.when(F.col("id") % 4 == 0, "full").when(F.col("id") % 4 == 1, "none").when(F.col("id") % 4 == 2, "partial")
    return search.rerank(fused, fused.select("id", verdict.alias("verdict")))


@query("SELECT event_id AS id, ts AS at, 1.0::DOUBLE AS score FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id LIMIT 20")
def recent_filters_only(spark, d):
    return search.newest(table(spark, d, "events").where("event_type = 'click'"), "ts", "event_id", 20)


@query(
    """SELECT event_id FROM events WHERE user_id IN (1, 2, 3) AND event_id % 2 = 0 AND (ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Berlin')::DATE BETWEEN DATE '2024-01-01' AND DATE '2024-01-03'
    AND (event_type ILIKE '%i%' OR props ILIKE '%zz%')"""
)
def scoped_search(spark, d):
    e = table(spark, d, "events").withColumn("owner", F.col("event_id") % 2)
    found = search.scoped(e, F.col("owner"), 0, F.col("user_id"), [1, 2, 3])
    return found.where(search.on_local_days(F.col("ts"), "2024-01-01", "2024-01-03") & search.contains_any("i", F.col("event_type"))).select("event_id")


@query(f"SELECT id AS doc_id, round(score, 6) AS score FROM ({_cover('eronth', 'thed')})")
def fulltext_cover_density(spark, d):
    """The proximity score of every document that has all terms."""
    stems = ("eronth", "thed")
    found = search.cover_density(search.occurrences(table(spark, d, "documents"), stems, "doc_id"), stems)
    return found.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(_FTS)
def fulltext_index_topk(spark, d):
    """The same ranking from a stored index, of which only two terms' lists are read."""
    index = saved(search.index_of(table(spark, d, "documents"), "doc_id"))
    return search.indexed_topk(index, _QUERY)


@query(f"SELECT id AS doc_id, term, array_to_string(list(pos ORDER BY pos), ',') AS positions FROM {_TERMS} WHERE w NOT IN ({', '.join(repr(w) for w in search.STOP_WORDS)}) GROUP BY 1, 2")
def text_vectors(spark, d):
    """Stems of every document and their places."""
    return search.postings(table(spark, d, "documents"), "doc_id").select(F.col("id").alias("doc_id"), "term", F.array_join("positions", ",").alias("positions"))


@query(f"WITH {_FUSED} SELECT rank, id, source FROM fused JOIN documents ON doc_id = id WHERE id % 2 = 0 AND source IN (SELECT source FROM documents GROUP BY 1 ORDER BY 1 LIMIT 3)")
def scoped_hydration(spark, d):
    """Hits of another owner, or in a mailbox that isn't active, drop out."""
    docs = table(spark, d, "documents").withColumn("owner", F.col("doc_id") % 2)
    first = docs.select(F.col("source").alias("id")).distinct().orderBy("id").limit(3)
    boxes = first.select("id", F.lit(0).alias("user_id"), F.lit(True).alias("is_active")).unionByName(first.select(F.concat(F.lit("no "), "id").alias("id"), F.lit(1).alias("user_id"), F.lit(True).alias("is_active")))
    fused = search.rrf(_semantic(spark, d), _fulltext(spark, d))
    return search.scoped_hydrate(fused, docs, "doc_id", F.col("owner"), 0, F.col("source"), boxes).select("rank", F.col("doc_id").alias("id"), "source")

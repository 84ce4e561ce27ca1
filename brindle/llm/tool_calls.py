"""Tool-call linking in DataFrame operations only: join calls and results, order, validate, serialise.

Calls and results are joined by identifier after each side is reduced to one row per identifier, so that the join can't fan
out. Calls are ordered so that each follows what it depends on: where every dependency stands before its call in the
transcript, the transcript's own order is topological; only the other conversations go through rounds that release calls
whose dependencies have all been released, until none is left or the rest is a cycle. A round costs two small tables; there
are as many as the longest chain of such conversations has links. Ranks within a conversation come from counts of position
blocks, so that a conversation with a third of all rows isn't sorted in one task.

Arguments are one JSON object, checked against the fields, types and required marks of the tool's schema. Lines are JSON with
keys sorted at every depth and no spaces.

Of repeated identifiers the first by position, then by content, counts. A call without identifier can't be linked or depended
on; it is a row of its own, but for repeated rows. Null names, arguments or contents are kept: arguments that are null,
unreadable, no object, followed by anything or with a repeated key are invalid ("arguments") and null in the line, an unknown
tool is "tool", a dependency that isn't a call of the conversation "unknown:" and its identifier. A call in a cycle, or
behind one, has no order. Texts of any length are kept whole. Empty tables give no row. Other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, stored

BLOCK = 1024
#: Fields of schemas are broadcast up to this number; beyond it the join shuffles.
BROADCAST_FIELDS = 10_000


def linked(calls: DataFrame, results: DataFrame) -> DataFrame:
    """calls: conv_id, call_id, position, name, arguments, depends_on; results: conv_id, call_id, position, content. Adds uid,
    the identifier or, for a call without, a hash that no identifier equals."""
    own = F.concat(F.lit("\0"), F.sha2(F.to_json(F.struct("position", "name", "arguments", "depends_on")), 256))
    calls = calls.select("conv_id", "call_id", F.coalesce("call_id", own).alias("uid"), "position", "name", "arguments", "depends_on")
    one = calls.groupBy("conv_id", "call_id", "uid").agg(F.min(F.struct("position", "name", "arguments", "depends_on")).alias("c"))
    answer = results.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("position", "content")).alias("result"), F.count("*").alias("n_results"))
    keys = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.uid") == F.col("b.call_id"))
    return one.alias("a").join(answer.alias("b"), keys, "left").select("a.conv_id", "a.call_id", "a.uid", "c.*", "result", F.coalesce("n_results", F.lit(0)).alias("n_results"))


def _same(a: DataFrame, b: DataFrame, left: str = "uid", right: str = "uid") -> Column:
    return a["conv_id"].eqNullSafe(b["conv_id"]) & (a[left] == b[right])


def edges_of(calls: DataFrame) -> DataFrame:
    """conv_id, uid, position, needs and at, the position of the needed call; null if there is no such call."""
    edges = calls.select("conv_id", "uid", "position", F.explode(F.array_distinct("depends_on")).alias("needs")).where("needs is not null")
    known = calls.where("call_id is not null").select(F.col("conv_id").alias("conv"), F.col("call_id").alias("known"), F.coalesce("position", F.lit(-1)).alias("at"))
    found = edges.join(known, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("needs") == F.col("known")), "left").select("conv_id", "uid", "position", "needs", "at")
    return stored(found, "call-edges")


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """conv_id, uid, level: 0 throughout a conversation whose own order is topological; null in and behind cycles."""
    edges = edges.where("at is not null")
    odd = stored(edges.where(F.col("at") >= F.coalesce("position", F.lit(-1))).select("conv_id").distinct(), "call-odd")
    if odd.isEmpty():
        return calls.select("conv_id", "uid", F.lit(0).alias("level"))
    of_odd = lambda x: x["conv_id"].eqNullSafe(odd["conv_id"])
    out = calls.join(odd, of_odd(calls), "left_anti").select("conv_id", "uid", F.lit(0).alias("level"))
    waiting = stored(calls.join(odd, of_odd(calls), "left_semi").select("conv_id", "uid"), "call-waiting")
    left = stored(edges.join(odd, of_odd(edges), "left_semi").select("conv_id", "uid", "needs"), "call-left")
    level = 0
    while not waiting.isEmpty():
        blocked = left.select("conv_id", "uid").distinct()
        marked = stored(waiting.join(blocked.select("conv_id", "uid", F.lit(True).alias("blocked")), _same(waiting, blocked), "left").select(waiting["conv_id"], waiting["uid"], "blocked"), "call-marked")
        free = marked.where("blocked is null").select("conv_id", "uid")
        waiting = marked.where("blocked").select("conv_id", "uid")
        if free.isEmpty():
            return out.unionByName(waiting.withColumn("level", F.lit(None).cast("int")))
        out = out.unionByName(free.withColumn("level", F.lit(level)))
        left = stored(left.join(free, _same(left, free, "needs"), "left_anti"), "call-left")
        level += 1
    return out


def ordered(calls: DataFrame) -> DataFrame:
    """Adds topo_order, from 0 in each conversation, by level, position and identifier, and unknown, the needed identifiers
    that no call has."""
    edges = edges_of(calls)
    lv = levels(calls, edges).withColumnsRenamed({"conv_id": "lc", "uid": "li"})
    placed = calls.join(lv, calls["conv_id"].eqNullSafe(lv["lc"]) & (calls["uid"] == lv["li"])).drop("lc", "li")
    placed = stored(placed.withColumn("block", F.floor(F.col("position") / BLOCK)), "call-levels")
    counts = placed.where("level is not null").groupBy("conv_id", "level", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("level", F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select(F.col("conv_id").alias("bc"), F.col("level").alias("bl"), F.col("block").alias("bb"), "before")
    inside = Window.partitionBy("conv_id", "level", "block").orderBy(F.col("position").asc_nulls_first(), "uid")
    ranked = placed.withColumn("inside", F.row_number().over(inside))
    same = F.col("conv_id").eqNullSafe(F.col("bc")) & (F.col("level") == F.col("bl")) & F.col("block").eqNullSafe(F.col("bb"))
    out = ranked.join(counts, same, "left").withColumn("topo_order", F.col("before") + F.col("inside") - 1).drop("bc", "bl", "bb", "before", "inside", "block", "level")
    lost = edges.where("at is null").groupBy(F.col("conv_id").alias("uc"), F.col("uid").alias("ui")).agg(F.collect_list("needs").alias("unknown"))
    return out.join(lost, F.col("conv_id").eqNullSafe(F.col("uc")) & (F.col("uid") == F.col("ui")), "left").drop("uc", "ui")


def parsed(arguments: Column) -> Column:
    """The one JSON object that arguments are, as a variant; else null."""
    # within brackets, what follows the object is a further element or an error
    whole = F.try_parse_json(F.concat(F.lit("["), arguments, F.lit("]")))
    only = F.when(F.schema_of_variant(whole).startswith("ARRAY<OBJECT"), whole.cast("array<variant>"))
    return F.when(F.size(only) == 1, F.get(only, F.lit(0)))


def kind_of(value: Column) -> Column:
    """STRING, BIGINT, DOUBLE, BOOLEAN, ARRAY, OBJECT or VOID."""
    kind = F.schema_of_variant(value)
    number = F.when(kind.rlike(r"^DECIMAL\(\d+, ?0\)$"), "BIGINT").otherwise("DOUBLE")
    return F.when(kind.startswith("DECIMAL"), number).when(kind.startswith("ARRAY"), "ARRAY").when(kind.startswith("OBJECT"), "OBJECT").otherwise(kind)


def validated(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Adds errors, sorted: "tool", "arguments", "missing:field", "type:field", "unknown:identifier". schemas: tool, field,
    type (see kind_of; DOUBLE takes whole numbers too), required."""
    few = schemas.limit(BROADCAST_FIELDS + 1).count() <= BROADCAST_FIELDS
    tools = schemas.groupBy("tool").agg(F.array_sort(F.collect_list(F.struct("field", "type", "required"))).alias("fields"))
    value = parsed(F.col("arguments"))
    given_ = calls.join(F.broadcast(tools) if few else tools, F.col("name") == F.col("tool"), "left").withColumn("given", F.when(F.schema_of_variant(value).startswith("OBJECT"), value.cast("map<string,variant>")))

    def problem(f: Column) -> Column:
        given = F.coalesce(F.map_contains_key("given", f["field"]), F.lit(False))
        kind = kind_of(F.element_at("given", f["field"]))
        fits = (kind == f["type"]) | ((kind == "BIGINT") & (f["type"] == "DOUBLE"))
        return F.when(~given & f["required"], F.concat(F.lit("missing:"), f["field"])).when(given & ~fits, F.concat(F.lit("type:"), f["field"]))

    found = F.when(F.col("fields").isNull(), F.array(F.lit("tool"))).when(F.col("given").isNull(), F.array(F.lit("arguments"))).otherwise(F.filter(F.transform("fields", problem), lambda e: e.isNotNull()))
    unknown = F.transform(F.coalesce("unknown", F.array().cast("array<string>")), lambda n: F.concat(F.lit("unknown:"), n))
    return given_.withColumn("errors", F.array_join(F.array_sort(F.concat(found, unknown)), ",")).drop("tool", "fields", "given")


def canonical(calls: DataFrame) -> DataFrame:
    """Adds line: the call with its result as JSON, keys sorted."""
    result = F.when(F.col("result").isNotNull(), F.struct(F.col("result.content").alias("content"), F.col("result.position").alias("position")))
    line = F.to_json(F.struct(parsed(F.col("arguments")).alias("arguments"), "call_id", "name", result.alias("result"), "topo_order"), {"ignoreNullFields": "false"})
    return calls.withColumn("line", line)


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call: conv_id, call_id, topo_order, n_results, errors, line."""
    found = stored(linked(calls, results), "calls-linked")
    done = stored(canonical(validated(ordered(found), schemas)).select("conv_id", "call_id", "topo_order", "n_results", "errors", "line"), "calls-lines")
    drop_stored(found)
    return done


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and schema of a plain conversation: a user turn calls "reply", the assistant turn after it is the
    result. So that orders, cycles and errors occur, by m = turn div 2: where m mod 4 is 0 the call needs the next one, else
    the one before, save where m mod 4 is 1 (but where m mod 16 is 5, which makes a cycle of two); where m mod 8 is 3 the
    turn is given as a string, where it is 6 not at all."""
    turn, m = F.col("turn"), F.expr("turn DIV 2")
    ident = lambda t: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.coalesce(t.cast("string"), F.lit("null")))
    needs = F.when(m % 4 == 0, F.array(ident(turn + 2))).when((m % 4 != 1) | (m % 16 == 5), F.array(ident(turn - 2))).otherwise(F.array().cast("array<string>"))
    arguments = F.when(m % 8 == 3, F.to_json(F.struct("text", turn.cast("string").alias("turn")))).when(m % 8 == 6, F.to_json(F.struct("text"))).otherwise(F.to_json(F.struct("text", "turn")))
    calls = turns.where("role = 'user'").select("conv_id", ident(turn).alias("call_id"), turn.alias("position"), F.lit("reply").alias("name"), arguments.alias("arguments"), needs.alias("depends_on"))
    results = turns.where("role = 'assistant'").select("conv_id", ident(turn - 1).alias("call_id"), turn.alias("position"), F.col("text").alias("content"))
    schemas = turns.sparkSession.sql("SELECT * FROM VALUES ('reply', 'text', 'STRING', true), ('reply', 'turn', 'BIGINT', true) AS t(tool, field, type, required)")
    return calls, results, schemas


#: A call is behind a cycle if a chain of calls that need the one before leads to it; chains are short, so that three steps do.
SQL = """
WITH calls AS (
  SELECT conv_id, coalesce(conv_id::VARCHAR, 'null') || ':' || coalesce(turn::VARCHAR, 'null') AS call_id, min({'turn': turn, 'text': text}) AS c
  FROM conversations WHERE role = 'user' GROUP BY ALL),
results AS (
  SELECT conv_id, coalesce(conv_id::VARCHAR, 'null') || ':' || coalesce((turn - 1)::VARCHAR, 'null') AS call_id, min({'position': turn, 'content': text}) AS r, count(*) AS n_results
  FROM conversations WHERE role = 'assistant' GROUP BY ALL),
needs AS (
  SELECT conv_id, call_id, c, c.turn // 2 AS m,
    CASE WHEN m % 4 = 0 THEN c.turn + 2 WHEN m % 4 <> 1 OR m % 16 = 5 THEN c.turn - 2 END AS need FROM calls),
known AS (
  SELECT n.*, o.c.turn AS place, CASE WHEN need IS NOT NULL AND o.call_id IS NULL THEN coalesce(n.conv_id::VARCHAR, 'null') || ':' || need END AS lost
  FROM needs n LEFT JOIN calls o ON n.conv_id IS NOT DISTINCT FROM o.conv_id AND o.c.turn = n.need),
odd AS (SELECT conv_id, bool_or(coalesce(place >= c.turn, false)) AS odd FROM known GROUP BY ALL),
step0 AS (SELECT k.*, odd, CASE WHEN NOT odd OR place IS NULL THEN 0 END AS l0 FROM known k JOIN odd o ON k.conv_id IS NOT DISTINCT FROM o.conv_id),
""" + ",\n".join(f"""step{k} AS (
  SELECT s.*, coalesce(s.l{k - 1}, o.l{k - 1} + 1) AS l{k} FROM step{k - 1} s LEFT JOIN step{k - 1} o ON s.conv_id IS NOT DISTINCT FROM o.conv_id AND o.c.turn = s.place)""" for k in range(1, 6)) + """,
ranked AS (
  SELECT s.conv_id, s.call_id, c, m, lost, l5, r, coalesce(n_results, 0) AS n_results,
    CASE WHEN l5 IS NOT NULL THEN row_number() OVER (PARTITION BY s.conv_id, l5 IS NULL ORDER BY l5, c.turn NULLS FIRST, s.call_id) - 1 END AS topo_order
  FROM step5 s LEFT JOIN results b ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.call_id = b.call_id)
SELECT conv_id, call_id, topo_order, n_results,
  concat_ws(',', CASE WHEN c.text IS NULL THEN 'missing:text' END, CASE WHEN c.turn IS NULL OR m % 8 = 6 THEN 'missing:turn' END,
    CASE WHEN m % 8 = 3 THEN 'type:turn' END, 'unknown:' || lost) AS errors,
  '{"arguments":{' || concat_ws(',', '"text":' || to_json(c.text)::VARCHAR, CASE m % 8 WHEN 6 THEN NULL WHEN 3 THEN '"turn":"' || c.turn || '"' ELSE '"turn":' || c.turn END)
    || '},"call_id":' || to_json(call_id)::VARCHAR
    || ',"name":"reply","result":' || CASE WHEN r IS NULL THEN 'null' ELSE '{"content":' || coalesce(to_json(r.content)::VARCHAR, 'null') || ',"position":' || r.position::VARCHAR || '}' END
    || ',"topo_order":' || coalesce(topo_order::VARCHAR, 'null') || '}' AS line
FROM ranked
"""

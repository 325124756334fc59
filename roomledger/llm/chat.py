"""Tool calls and results of conversations: linked, ordered, validated, as canonical JSON. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Steps, join_counted, text_of, word_count

#: A schema table may have so many rows; it is sent to every task.
MOST_FIELDS = 100_000
#: What the schema of a tool may ask of an argument.
SCHEMA = "name string, field string, kind string, required boolean, least double, most double"


def _kind(value: str) -> Column:
    """JSON kind of a variant: string, integer, number, boolean, object, array or null."""
    name = F.schema_of_variant(value)
    return (
        F.when(name == "STRING", "string").when(name == "BIGINT", "integer").when(name.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number")
        .when(name == "BOOLEAN", "boolean").when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array")
        .otherwise("null")
    )


def call_problems(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """(call_key, problem) for calls (call_key, name, arguments) against the schemas of their tools.

    Problems: unknown tool, arguments that are no JSON object, and by field: missing,
    unexpected, wrong kind (an integer is a number too), out of range (numbers by value,
    strings by length). ``schemas`` is a stated table of at most ``MOST_FIELDS`` rows with
    unique keys; more are an error. It is broadcast, as a few tools hold all the calls.
    """
    if schemas.limit(MOST_FIELDS + 1).count() > MOST_FIELDS:
        raise ValueError(f"more than {MOST_FIELDS} schema fields")
    schemas = F.broadcast(schemas)
    tools = F.broadcast(schemas.select("name").distinct().withColumn("_known", F.lit(True)))
    parsed = calls.select("call_key", "name", F.try_parse_json(F.coalesce("arguments", F.lit(""))).alias("_v"))
    parsed = parsed.join(tools, "name", "left")
    is_object = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    whole = parsed.select(
        "call_key", F.when(F.col("_known").isNull(), "unknown tool").when(~is_object, "arguments: no object").alias("problem")
    ).where("problem IS NOT NULL")
    objects = parsed.where(F.col("_known").isNotNull() & is_object)
    view = objects.select("call_key", "name", "_v")
    given = view.lateralJoin(view.sparkSession.tvf.variant_explode(F.col("_v").outer()))
    given = given.select("call_key", "name", F.col("key").alias("field"), F.col("value").alias("_value"))
    kinds = given.withColumn("_kind", _kind("_value"))
    size = F.when(F.col("_kind") == "string", F.length(F.try_variant_get("_value", "$", "string")).cast("double")).otherwise(
        F.try_variant_get("_value", "$", "double")
    )
    checked = kinds.withColumn("_size", size).drop("_value").join(schemas, ["name", "field"], "left")
    fits = (F.col("_kind") == F.col("kind")) | ((F.col("kind") == "number") & (F.col("_kind") == "integer"))
    problem = (
        F.when(F.col("kind").isNull(), "unexpected").when(~fits, "wrong kind")
        .when((F.col("_size") < F.col("least")) | (F.col("_size") > F.col("most")), "out of range")
    )
    by_field = checked.select("call_key", F.concat("field", F.lit(": "), problem).alias("problem")).where("problem IS NOT NULL")
    required = objects.select("call_key", "name").join(F.broadcast(schemas.where("required").select("name", "field")), "name")
    missing = required.join(given.select("call_key", "field"), ["call_key", "field"], "left_anti")
    missing = missing.select("call_key", F.concat("field", F.lit(": missing")).alias("problem"))
    return whole.unionByName(by_field).unionByName(missing)


def _anchors(steps: Steps, ids: DataFrame, needs: DataFrame) -> DataFrame:
    """(call_id, anchor, steps) for calls with at most one need: where the chain of needs ends.

    A chain ends at a call that needs nothing or several others. Jumps along the chain are
    doubled each round, so a chain of n calls takes about log2(n) rounds. Calls on a
    cycle, or behind one, find no end and are left out.
    """
    counted = needs.groupBy("call_id").agg(F.count(F.lit(1)).alias("n"), F.min("needed").alias("needed"))
    known = ids.join(counted, "call_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ends = known.where("n <> 1").select("call_id", F.col("call_id").alias("anchor"), F.lit(0).cast("long").alias("steps"))
    jumps = known.where("n = 1").select("call_id", F.col("needed").alias("to"), F.lit(1).cast("long").alias("steps"))
    found, jumps = steps.store(ends, "ends-0"), steps.store(jumps, "jumps-0")
    done, k = [found], 0
    while True:
        arrive = join_counted(jumps, found.select(F.col("call_id").alias("to"), "anchor", F.col("steps").alias("rest")), "to", F.col("call_id"))
        arrive = steps.store(arrive, f"arrive-{k}")
        found = arrive.where("anchor IS NOT NULL").select("call_id", "anchor", (F.col("steps") + F.col("rest")).alias("steps"))
        found = steps.store(found, f"ends-{k + 1}")
        done.append(found)
        away = arrive.where("anchor IS NULL").select("call_id", "to", "steps")
        if away.isEmpty() or found.isEmpty():  # all have arrived, or the others go round in circles
            break
        k += 1
        over = away.select(F.col("call_id").alias("to"), F.col("to").alias("_next"), F.col("steps").alias("_more"))
        hop = join_counted(away, over, "to", F.col("call_id"))
        hop = hop.select("call_id", F.coalesce("_next", "to").alias("to"), (F.col("steps") + F.coalesce("_more", F.lit(0))).alias("steps"))
        jumps = steps.store(hop, f"jumps-{k}")
        found = ids.sparkSession.read.schema(done[0].schema).parquet(*[steps.paths[f"ends-{i}"] for i in range(len(done))])
    return ids.sparkSession.read.schema(done[0].schema).parquet(*[steps.paths[f"ends-{i}"] for i in range(len(done))])


def topological_levels(steps: Steps, ids: DataFrame, needs: DataFrame) -> DataFrame:
    """(call_id, level): 0 for calls that need no other, else one more than the last they need.

    Chains of calls with one need each are followed by doubling; then a round for every
    level of calls with several needs takes those all of whose needs have a level. Calls
    on a cycle, or behind one, get no level.
    """
    needs = needs.join(ids, "call_id", "left_semi")
    needs = needs.join(ids.withColumnRenamed("call_id", "needed"), "needed", "left_semi").select("call_id", "needed").distinct()
    needs = steps.store(needs, "needs")
    ends = steps.store(_anchors(steps, ids, needs), "chains")
    several = steps.store(needs.groupBy("call_id").count().where("count > 1").select("call_id", "count"), "several")
    roots = ends.where("call_id = anchor").join(several, "call_id", "left_anti").select("call_id", F.lit(0).cast("long").alias("level"))
    settled = steps.store(roots, "settled-0")
    if not several.isEmpty():
        links = needs.join(several, "call_id")
        links = join_counted(links, ends.withColumnRenamed("call_id", "needed"), "needed", F.col("call_id"))
        links = steps.store(links.select("call_id", "count", "anchor", "steps"), "links")
        k = 0
        while True:
            reached = links.join(settled.withColumnRenamed("call_id", "anchor"), "anchor")
            ready = reached.groupBy("call_id", "count").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("level") + F.col("steps") + 1).alias("level"))
            ready = ready.where("n = count").select("call_id", "level").join(settled, "call_id", "left_anti")
            ready = steps.store(ready, f"ready-{k}")
            if ready.isEmpty():
                break
            k += 1
            settled = steps.store(settled.unionByName(ready), f"settled-{k}")
    levels = join_counted(ends, settled.withColumnRenamed("call_id", "anchor"), "anchor", F.col("call_id"))
    return levels.where("level IS NOT NULL").select("call_id", (F.col("level") + F.col("steps")).cast("int").alias("level"))


def canonical(json: Column) -> Column:
    """A JSON text with sorted keys, no white space and plain numbers; null if it is not JSON."""
    return F.to_json(F.try_parse_json(json))


def link_calls(spark: SparkSession, calls: DataFrame, results: DataFrame, needs: DataFrame, schemas: DataFrame) -> DataFrame:
    """One event per call and per result, in an order in which everything comes after what it needs.

    ``calls`` has conv_id, turn, call_id, name and arguments (JSON); ``results`` has conv_id,
    turn, call_id and content; ``needs`` has call_id and the ``needed`` call_id. Order events
    by conv_id, level, kind (call before result) and turn. ``linked`` says if a call has a
    result, or a result its call; ``problems`` lists what the schema finds, sorted.
    Identifiers are counted before they are joined, so repeated rows stay single events
    and a hot identifier is no hot task. A null call_id is linked to nothing and needs
    nothing; its level is 0 as for a result without a call. Calls on a cycle have a null
    level. Arguments that are not JSON go into the JSON as null.
    """
    steps = Steps(spark, "chat")
    calls = steps.store(calls.select("conv_id", "turn", "call_id", "name", "arguments")
                        .withColumn("call_key", F.monotonically_increasing_id()), "calls")
    ids = steps.store(calls.where("call_id IS NOT NULL").select("call_id").distinct(), "ids")
    answered = steps.store(results.where("call_id IS NOT NULL").select("call_id").distinct(), "answered")
    levels = steps.store(topological_levels(steps, ids, needs), "levels")
    known = steps.store(levels.join(answered.withColumn("_answered", F.lit(True)), "call_id", "left"), "known")
    problems = call_problems(calls, schemas)
    problems = problems.groupBy("call_key").agg(F.array_join(F.array_sort(F.collect_set("problem")), "; ").alias("problems"))
    linked = join_counted(calls, known, "call_id", F.col("call_key")).join(problems, "call_key", "left")
    no_id = F.col("call_id").isNull()
    call_json = F.to_json(
        F.struct(F.try_parse_json(F.coalesce("arguments", F.lit(""))).alias("arguments"), F.col("call_id").alias("id"), "name",
                 F.lit("call").alias("type")), {"ignoreNullFields": "false"},
    )
    call_events = linked.select(
        "conv_id", "turn", "call_id", F.lit("call").alias("kind"), F.when(no_id, 0).otherwise(F.col("level")).alias("level"),
        F.coalesce("_answered", F.lit(False)).alias("linked"), F.coalesce("problems", F.lit("")).alias("problems"), call_json.alias("json"),
    )
    rows = results.select("conv_id", "turn", "call_id", "content")
    found = join_counted(rows, levels.withColumn("_is_call", F.lit(True)), "call_id", F.struct("conv_id", "turn"))
    result_json = F.to_json(
        F.struct("content", F.col("call_id").alias("id"), F.lit("result").alias("type")), {"ignoreNullFields": "false"}
    )
    result_events = found.select(
        "conv_id", "turn", "call_id", F.lit("result").alias("kind"),
        F.when(F.col("_is_call").isNull(), 0).otherwise(F.col("level")).alias("level"),
        F.coalesce("_is_call", F.lit(False)).alias("linked"), F.lit("").alias("problems"), result_json.alias("json"),
    )
    return call_events.unionByName(result_events)


#: Longest question, in words and characters, that the assistant takes in one call.
MOST_WORDS, MOST_CHARS = 60.0, 2000.0


def conversation_events(conversations: DataFrame) -> DataFrame:
    """The turns of conversations as calls of the assistant and its results.

    A user turn is a call ``ask`` with the text, its turn and its number of words; the
    assistant's turn right after it is the result, and a question two turns later needs
    it. System turns and other roles are calls of the tool that the role names, which has
    a schema for ``system`` only. Null texts count as empty, a null role as the tool "".
    """
    spark = conversations.sparkSession
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text_of("text").alias("text"))
    call_id = lambda turn: F.concat_ws("/", "conv_id", turn)
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    calls = turns.where("role <> 'assistant'")
    arguments = F.struct("text", "turn", word_count(F.col("text")).alias("words"))
    calls = calls.select(
        "conv_id", "turn", F.when(known, call_id(F.col("turn"))).alias("call_id"),
        F.when(F.col("role") == "user", "ask").otherwise(F.col("role")).alias("name"), F.to_json(arguments).alias("arguments"),
    )
    results = turns.where("role = 'assistant'").select(
        "conv_id", "turn", F.when(known, call_id(F.col("turn") - 1)).alias("call_id"), F.col("text").alias("content")
    )
    needs = turns.where((F.col("role") == "user") & known).select(
        call_id(F.col("turn")).alias("call_id"), call_id(F.col("turn") - 2).alias("needed")
    ).distinct()
    fields = [("text", "string", 1.0, MOST_CHARS), ("turn", "integer", 0.0, None), ("words", "integer", 1.0, MOST_WORDS)]
    schemas = spark.createDataFrame([(tool, f, kind, True, low, high) for tool in ("ask", "system") for f, kind, low, high in fields], SCHEMA)
    return link_calls(spark, calls, results, needs, schemas)


SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations
), c AS (
  SELECT *, concat_ws('/', conv_id, turn) AS call_id, concat_ws('/', conv_id, turn - 2) AS needed FROM t WHERE role <> 'assistant'
), ids AS (
  SELECT call_id, max(CASE WHEN role = 'user' THEN needed END) AS needed FROM c GROUP BY call_id
), levels AS (
  SELECT call_id, 0 AS level FROM ids WHERE needed IS NULL OR needed NOT IN (SELECT call_id FROM ids)
  UNION ALL
  SELECT i.call_id, l.level + 1 FROM ids i JOIN levels l ON i.needed = l.call_id
), r AS (
  SELECT *, concat_ws('/', conv_id, turn - 1) AS call_id FROM t WHERE role = 'assistant'
)
SELECT conv_id, turn, c.call_id, 'call' AS kind, level,
       c.call_id IN (SELECT call_id FROM r) AS linked,
       CASE WHEN role IN ('user', 'system') THEN array_to_string(list_filter([
         CASE WHEN length(text) < 1 OR length(text) > 2000 THEN 'text: out of range' END,
         CASE WHEN words < 1 OR words > 60 THEN 'words: out of range' END], lambda x: x IS NOT NULL), '; ')
         ELSE 'unknown tool' END AS problems,
       '{"arguments":{"text":' || to_json(text) || ',"turn":' || turn || ',"words":' || words || '},"id":"' || c.call_id
         || '","name":' || to_json(CASE role WHEN 'user' THEN 'ask' ELSE role END) || ',"type":"call"}' AS json
FROM c JOIN levels USING (call_id)
UNION ALL
SELECT conv_id, turn, r.call_id, 'result', coalesce(level, 0), level IS NOT NULL, '',
       '{"content":' || to_json(text) || ',"id":"' || r.call_id || '","type":"result"}'
FROM r LEFT JOIN levels USING (call_id)
"""

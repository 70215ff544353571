"""Tool calls of chat transcripts: linked to their results, ordered, validated and written as canonical JSON.

Everything is Spark SQL functions.  Calls and results meet by hash join on the identifier.  A call names the earlier calls whose
results it uses; its level in that graph, its longest path from a call that uses none, orders the calls topologically.  Each call
first chooses one parent, and depths along the chosen ones come from pointer jumping, log2(n) joins for a chain of n.  Calls then
choose their highest parent, as long as that is higher than the one they have, and depths are worked out again: every pass ends
higher, and none is needed where each call has one parent.  Arguments are checked against a JSON schema for each tool.

Canonical JSON has the keys of objects in order, no white space, and every number as ECMAScript writes it, but with all of its digits:
1e2, 100 and 100.0 are 100, and 1E-7 is 1e-7; nothing is rounded.  For this, strings and numbers are marked before Spark parses the
text: every number becomes a string that begins with n, and every other string begins with s.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, join_spread, mark, saved, sweep, table

#: A JSON schema: type, properties, required, additionalProperties, items, enum, minimum, maximum, minLength, maxLength, minItems,
#: maxItems, pattern.
Schema = dict[str, Any]

_NUMBER = r"(?<![\w.+-])(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)(?![\w.+-])"


def _depths(choice: DataFrame) -> DataFrame:
    """(call_id, level) along one chosen parent each (call_id, up): its depth, or null on or below a cycle.

    up is the call reached so far, dist steps away; it is open as long as that one has a parent itself.  Each round doubles the
    steps, so what is still open after log2(n) of them runs in a circle.
    """
    known = choice.select(F.col("call_id").alias("up"), F.lit(True).alias("more"))
    state = saved(join_spread(choice, known, "up").select("call_id", "up", F.lit(1).cast("long").alias("dist"), F.col("more").isNotNull().alias("open")), "chains")
    for _ in range(math.ceil(math.log2(state.count() + 1)) + 1):
        if state.where("open").isEmpty():
            break
        above = state.select(F.col("call_id").alias("up"), F.col("up").alias("up2"), F.col("dist").alias("more"), F.col("open").alias("on"))
        moved = join_spread(state.where("open"), above, "up").select("call_id", F.col("up2").alias("up"), (F.col("dist") + F.col("more")).alias("dist"), F.col("on").alias("open"))
        before, state = state, saved(state.where("not open").unionByName(moved), "chains")
        forget(before)
    return state.select("call_id", F.when(~F.col("open"), F.col("dist")).alias("level"))


def call_levels(calls: DataFrame) -> DataFrame:
    """(call_id, level, cyclic) of calls (call_id, parents: array of ids): level 0 for a call without a known parent, else one
    above the highest of its parents'.

    Calls on a cycle, or that use one's results, have a null level and cyclic true.  Each call_id appears once; repeated ids have
    the parents of all their rows.  Null ids and null, repeated or unknown parents are left out.
    """
    ids = saved(calls.where("call_id is not null").select("call_id").distinct(), "calls")
    named = saved(calls.where("call_id is not null").select("call_id", F.explode("parents").alias("parent")).where("parent is not null").distinct(), "edges")
    edges = saved(join_spread(named, ids.select(F.col("call_id").alias("parent"), F.lit(True).alias("known")), "parent").where("known").drop("known"), "edges")
    choice = saved(edges.groupBy("call_id").agg(F.min("parent").alias("up")), "choice")
    while True:
        levels = saved(_depths(choice), "levels")
        # The highest parent of each call, a cyclic one before all others; a call whose choice is one of these stays.
        by_parent = levels.select(F.col("call_id").alias("parent"), F.coalesce("level", F.lit(1 << 62)).alias("height"))
        best = join_spread(edges, by_parent, "parent").groupBy("call_id").agg(F.max(F.struct(F.coalesce("height", F.lit(0)).alias("height"), "parent")).alias("best"))
        better = saved(best.join(levels.where("level is not null"), "call_id").where("best.height >= level").select("call_id", F.col("best.parent").alias("up")), "better")
        if better.isEmpty():
            break
        before, choice = choice, saved(choice.join(better.select("call_id"), "call_id", "left_anti").unionByName(better), "choice")
        for done in (before, levels, better):
            forget(done)
    out = ids.join(levels.withColumn("used", F.lit(True)), "call_id", "left")
    return out.select("call_id", F.when(F.col("used").isNull(), 0).otherwise(F.col("level")).cast("long").alias("level"), (F.col("used").isNotNull() & F.col("level").isNull()).alias("cyclic"))


def _outside(text: Column, inside: Column | None, outside: Column | None, joined: str) -> Column:
    """text cut at the quotes of its JSON strings, parts inside and outside of them changed by functions of a part.

    Escaped backslashes and quotes stand as the characters 1 and 2 meanwhile, which JSON does not allow in a text.
    """
    plain = F.replace(F.replace(text, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    parts = F.transform(F.split(plain, '"'), lambda p, i: F.when(i % 2 == 1, inside(p)).otherwise(outside(p)))
    whole = F.array_join(parts, joined)
    return F.when(~text.rlike("[\x01\x02]"), F.replace(F.replace(whole, F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\")))


def marked(text: Column) -> Column:
    """The JSON text with its numbers as strings that begin with n, and s before every other string; see the module."""
    return _outside(text, lambda p: F.concat(F.lit("s"), p), lambda p: F.regexp_replace(p, _NUMBER, '"n$1"'), '"')


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, also inside a higher-order function."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def canonical_number(x: Column) -> Column:
    """A JSON number as ECMAScript writes one, with all of its digits; null where the exponent has more than 17 digits."""
    body = F.lower(F.regexp_replace(x, "^-", ""))
    return _let(F.struct(F.when(F.startswith(x, F.lit("-")), "-").otherwise("").alias("sign"), F.substring_index(body, "e", 1).alias("mantissa"), F.when(F.contains(body, F.lit("e")), F.substring_index(body, "e", -1)).otherwise("0").alias("power")), _number)


def _number(parts: Column) -> Column:
    mantissa, power = parts["mantissa"], parts["power"]
    fraction = F.when(F.contains(mantissa, F.lit(".")), F.substring_index(mantissa, ".", -1)).otherwise("")
    raised = F.when(F.length(F.regexp_replace(power, "^[+-]?0*", "")) < 18, F.regexp_replace(power, r"^\+", "").try_cast("long"))
    digits = F.regexp_replace(F.concat(F.substring_index(mantissa, ".", 1), fraction), "^0+", "")
    found = F.struct(digits.alias("digits"), F.regexp_replace(digits, "0+$", "").alias("short"), (raised - F.length(fraction)).alias("raised"))
    return _let(found, lambda d: _let(F.struct(d["short"].alias("short"), F.length(d["short"]).cast("long").alias("k"), (d["raised"] + F.length(d["digits"])).alias("n")), lambda v: _shown(parts["sign"], v)))


def _shown(sign: Column, v: Column) -> Column:
    """k digits, of which the point stands behind n."""
    short, k, n = v["short"], v["k"], v["n"]
    power = F.concat(F.lit("e"), F.when(n > 0, "+").otherwise("-"), F.abs(n - 1).cast("string"))
    zeros = lambda m: F.repeat(F.lit("0"), F.greatest(m, F.lit(0)).cast("int"))
    number = (
        F.when((k <= n) & (n <= 21), F.concat(short, zeros(n - k)))
        .when((n > 0) & (n <= 21), F.concat(F.left(short, n.cast("int")), F.lit("."), F.substring(short, (n + 1).cast("int"), k.cast("int"))))
        .when((n > -6) & (n <= 0), F.concat(F.lit("0."), zeros(-n), short))
        .when(k == 1, F.concat(short, power)).otherwise(F.concat(F.left(short, F.lit(1)), F.lit("."), F.substring(short, 2, 1 << 30), power))
    )
    return F.when(short == "", F.lit("0")).otherwise(F.concat(sign, number))


def _written(parsed: Column) -> Column:
    """The canonical text of a marked variant."""
    rest = lambda p: F.substring(p, 2, 1 << 30)
    out = _outside(F.to_json(parsed), lambda p: F.when(F.startswith(p, F.lit("n")), canonical_number(rest(p))).otherwise(F.concat(F.lit('"'), rest(p), F.lit('"'))), lambda p: p, "")
    return out


def canonical_json(text: Column) -> Column:
    """The JSON text in canonical form (see the module); null if it is not JSON or an object has a key twice."""
    return _written(F.try_parse_json(marked(text)))


def _errors(value: Column, schema: Schema, path: str) -> Column:
    """Array of what is wrong with a marked variant."""
    kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    text = F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
    body = F.substring(text, 2, 1 << 30)
    number = F.when(F.startswith(text, F.lit("n")), body.try_cast("double"))
    string = F.when(F.startswith(text, F.lit("s")), body)
    name, inner = path or "arguments", f"{path}." if path else ""
    fits = {
        "string": string.isNotNull(), "number": number.isNotNull(), "integer": F.coalesce(number == F.floor(number), F.lit(False)) | F.coalesce(F.abs(number) >= 2.0**53, F.lit(False)),
        "boolean": kind == "BOOLEAN", "object": F.startswith(kind, F.lit("OBJECT")), "array": F.startswith(kind, F.lit("ARRAY")), "null": kind == "VOID",
    }
    none = F.array().cast("array<string>")
    found: list[Column] = []

    def rule(broken: Column, message: str) -> None:
        found.append(F.when(broken, F.array(F.lit(f"{name}: {message}"))).otherwise(none))

    for key, side, broken in (("minimum", "below", lambda x, b: x < b), ("maximum", "above", lambda x, b: x > b)):
        if key in schema:
            rule(broken(number, schema[key]), f"{side} {schema[key]}")
    for key, side, size, broken in (
        ("minLength", "shorter than", F.length(string), lambda x, b: x < b), ("maxLength", "longer than", F.length(string), lambda x, b: x > b),
        ("minItems", "fewer than", F.size(F.try_variant_get(value, "$", "array<variant>")), lambda x, b: (x >= 0) & (x < b)), ("maxItems", "more than", F.size(F.try_variant_get(value, "$", "array<variant>")), lambda x, b: x > b),
    ):
        if key in schema:
            rule(broken(size, schema[key]), f"{side} {schema[key]}")
    if "pattern" in schema:
        rule(~string.rlike(schema["pattern"]), "not like its pattern")
    if "enum" in schema:
        same = F.lit(False)
        for x in schema["enum"]:
            same |= F.coalesce(string == x if isinstance(x, str) else kind == "VOID" if x is None else F.try_variant_get(value, "$", "boolean") == x if isinstance(x, bool) else number == x, F.lit(False))
        rule(~same, "none of its values")
    fields = schema.get("properties", {})
    for field, inside in sorted(fields.items()):
        v = F.try_variant_get(value, f'$["s{field}"]', "variant")
        gone = F.coalesce(F.schema_of_variant(v), F.lit("VOID")) == "VOID"
        missing = F.array(F.lit(f"{inner}{field}: missing")) if field in schema.get("required", ()) else none
        found.append(F.when(fits["object"] & gone, missing).when(fits["object"], _errors(v, inside, f"{inner}{field}")).otherwise(none))
    if schema.get("additionalProperties") is False:
        keys = F.transform(F.coalesce(F.json_object_keys(F.to_json(value)), none), lambda k: F.substring(k, 2, 1 << 30))
        found.append(F.transform(F.filter(keys, lambda k: ~k.isin(*fields)), lambda k: F.concat(F.lit(inner), k, F.lit(": unknown"))))
    if "items" in schema:
        each = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))
        found.append(F.array_distinct(F.flatten(F.transform(each, lambda x: _errors(x, schema["items"], f"{path}[]")))))
    deeper = F.concat(*found) if found else none
    kinds = schema.get("type")
    if kinds is None:
        return deeper
    right = F.lit(False)
    for k in [kinds] if isinstance(kinds, str) else kinds:
        right |= fits[k]
    return F.when(right, deeper).otherwise(F.array(F.lit(f"{name}: not {kinds if isinstance(kinds, str) else ' or '.join(kinds)}")))


def argument_errors(tool: Column, arguments: Column, schema: dict[str, Schema]) -> Column:
    """Sorted messages of what is wrong with a call's arguments (a JSON text); empty if nothing is.

    A null property counts as missing.  Numbers are compared as doubles; any number of 2**53 or more counts as an integer.
    """
    return _argument_errors(tool, F.try_parse_json(marked(arguments)), schema)


def _argument_errors(tool: Column, parsed: Column, schema: dict[str, Schema]) -> Column:
    shape = F.when(parsed.isNull(), F.array(F.lit("not JSON"))).when(~F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), F.array(F.lit("not an object")))
    out = None
    for name, rules in sorted(schema.items()):
        errors = F.sort_array(_errors(parsed, rules, ""))
        out = F.when(tool == name, errors) if out is None else out.when(tool == name, errors)
    unknown = F.array(F.concat(F.lit("no such tool: "), F.coalesce(tool, F.lit("null"))))
    return F.coalesce(shape, unknown if out is None else out.otherwise(unknown))


def _quoted(c: str) -> Column:
    """A text column as a JSON string, or null."""
    text = F.to_json(F.struct(F.col(c).alias("v")))
    return F.when(F.col(c).isNull(), "null").otherwise(text.substr(F.lit(6), F.length(text) - 6))


def link_tool_calls(calls: DataFrame, results: DataFrame, schema: dict[str, Schema]) -> DataFrame:
    """One row per call: its result, level, errors and canonical JSON.

    calls: call_id, tool, arguments (JSON text), parents (array of call ids); results: call_id, content.  status is ``linked``, ``no
    result``, or ``invalid`` where arguments have errors.  Of several results with one id the least content counts (n_results says
    how many there were); results without a call are left out, and so is a result with a null id.  Repeated calls give a row each, a
    call with a null id is never linked and has no level.  Null arguments count as text that is no JSON, null parents as none.
    Empty tables give no rows.  Other columns are not read, so their names clash with nothing.
    """
    since = mark()
    own = saved(calls.select("call_id", "tool", "arguments", F.coalesce("parents", F.array().cast("array<string>")).alias("parents")), "calls")
    known = results.where("call_id is not null").groupBy("call_id").agg(F.min("content").alias("content"), F.count("*").alias("n_results"))
    facts = call_levels(own).join(known, "call_id", "left")
    sweep(calls.sparkSession, since, "calls", "levels")
    joined = join_spread(own, facts, "call_id").withColumn("_parsed", F.try_parse_json(marked(F.col("arguments"))))
    joined = joined.withColumn("errors", _argument_errors(F.col("tool"), F.col("_parsed"), schema))
    line = F.concat(
        F.lit('{"arguments":'), F.coalesce(_written(F.col("_parsed")), F.lit("null")), F.lit(',"id":'), _quoted("call_id"), F.lit(',"result":'), _quoted("content"), F.lit(',"tool":'), _quoted("tool"), F.lit("}")
    )
    return joined.select(
        "call_id", F.array_join("parents", ",").alias("parents"), "tool", "level", F.coalesce("cyclic", F.lit(False)).alias("cyclic"), F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.when(F.size("errors") > 0, "invalid").when(F.col("n_results") > 0, "linked").otherwise("no result").alias("status"), F.array_join("errors", "; ").alias("errors"), line.alias("canonical"),
    )


#: The tools that the turns of ``conversations`` stand for.
TOOLS: dict[str, Schema] = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1}, "exact": {"type": "boolean"}}, "required": ["query", "limit"], "additionalProperties": False},
    "summarise": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 5}}, "required": ["query", "limit"], "additionalProperties": False},
}


def turns_as_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results in a chat: a user's turn is a call with its text as the query, and the assistant's next turn its result.

    A call uses the results of the calls two and four turns before, if there are any.  Limits come from the turn's number and the
    text's length, so that some calls break the schema.
    """
    turn_id = F.concat_ws(":", "conv_id", "turn")
    length = F.length("text")
    limit = F.when(F.col("turn") % 10 == 4, F.concat(F.lit('"'), length.cast("string"), F.lit('"'))).otherwise((length % 12).cast("string"))
    query = F.to_json(F.struct(F.col("text").alias("query")))
    calls = turns.where("role = 'user' and conv_id is not null and turn is not null").select(
        turn_id.alias("call_id"), F.when(length % 3 == 0, "summarise").otherwise("search").alias("tool"),
        F.concat(F.substring(query, F.lit(1), F.length(query) - 1), F.lit(', "limit" : '), limit, F.when(length % 7 == 0, F.lit(', "exact":true}')).otherwise(F.lit("}"))).alias("arguments"),
        F.array_compact(F.array(*[F.when(F.col("turn") >= k, F.concat_ws(":", "conv_id", F.col("turn") - k)) for k in (2, 4)])).alias("parents"),
    )
    results = turns.where("role = 'assistant' and conv_id is not null and turn is not null").select(F.concat_ws(":", "conv_id", F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call in the conversations, linked, ordered, validated and in canonical JSON."""
    return link_tool_calls(*turns_as_calls(table(spark, sf_dir, "conversations")), TOOLS)


OP8_SQL = r"""
WITH RECURSIVE u AS (
  SELECT conv_id || ':' || turn AS call_id, turn, text, length(text) AS n, CASE WHEN length(text) % 3 = 0 THEN 'summarise' ELSE 'search' END AS tool,
    list_filter([CASE WHEN turn >= 2 THEN conv_id || ':' || (turn - 2) END, CASE WHEN turn >= 4 THEN conv_id || ':' || (turn - 4) END], lambda x: x IS NOT NULL) AS parents FROM conversations WHERE role = 'user'
), d AS (
  SELECT p.call_id, p.parent FROM (SELECT call_id, unnest(parents) AS parent FROM u) p WHERE parent IN (SELECT call_id FROM u)
), r AS (
  SELECT conv_id || ':' || (turn - 1) AS call_id, min(text) AS content, count(*) AS n_results FROM conversations WHERE role = 'assistant' GROUP BY 1
), path AS (
  SELECT call_id, 0::BIGINT AS level FROM u WHERE call_id NOT IN (SELECT call_id FROM d)
  UNION SELECT d.call_id, path.level + 1 FROM d JOIN path ON d.parent = path.call_id
), lv AS (
  SELECT call_id, max(level) AS level FROM path GROUP BY call_id
), e AS (
  SELECT *, list_sort(list_filter([
    CASE WHEN turn % 10 = 4 THEN 'limit: not integer' END,
    CASE WHEN turn % 10 <> 4 AND n % 12 < (CASE WHEN tool = 'search' THEN 1 ELSE 5 END) THEN 'limit: below ' || (CASE WHEN tool = 'search' THEN 1 ELSE 5 END) END,
    CASE WHEN n % 7 = 0 AND tool = 'summarise' THEN 'exact: unknown' END], lambda x: x IS NOT NULL)) AS errs FROM u
)
SELECT e.call_id, array_to_string(e.parents, ',') AS parents, e.tool, lv.level, false AS cyclic, coalesce(r.n_results, 0) AS n_results,
  CASE WHEN len(errs) > 0 THEN 'invalid' WHEN r.n_results > 0 THEN 'linked' ELSE 'no result' END AS status, array_to_string(errs, '; ') AS errors,
  '{"arguments":{' || CASE WHEN n % 7 = 0 THEN '"exact":true,' ELSE '' END || '"limit":' || CASE WHEN turn % 10 = 4 THEN '"' || n || '"' ELSE (n % 12)::VARCHAR END || ',"query":' || to_json(e.text)::VARCHAR
  || '},"id":' || to_json(e.call_id)::VARCHAR || ',"result":' || coalesce(to_json(r.content)::VARCHAR, 'null') || ',"tool":' || to_json(e.tool)::VARCHAR || '}' AS canonical
FROM e LEFT JOIN r USING (call_id) LEFT JOIN lv USING (call_id)
"""

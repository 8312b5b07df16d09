"""Queries over tool calls, episodes, backends, streams and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tandemlab.functions import parsing, tool_calls
from tandemlab.operators import agents
from tandemlab.plans.endpoint_queries import _F1, W
from tandemlab.sources import backends, records
from tandemlab.sources.tables import shared_dir, table
from tandemlab.streaming import ingest

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


_CALLS = r"""r AS (SELECT DISTINCT request_id, text FROM inference_responses WHERE text IS NOT NULL), t AS (SELECT request_id, text, contains(text, '[{"call"') AS tried, regexp_extract(text, '(?s)(\[\{"call".*)$', 1) AS raw FROM r)"""


def _texts(spark, folder):
    return table(spark, folder, "inference_responses").filter("text is not null").select("request_id", "text").distinct()


@query("c11_c15_tool_calls", f"WITH {_CALLS} SELECT request_id, CASE WHEN NOT tried OR json_valid(raw) THEN 'valid' ELSE 'invalid' END AS status, CASE WHEN tried AND json_valid(raw) THEN CAST(json_array_length(raw) AS INTEGER) ELSE 0 END AS calls, CASE WHEN tried AND json_valid(raw) THEN json_extract_string(raw, '$[0].call') END AS first_call FROM t")
def c11(spark, folder):
    """The calls of every response: a text without a sign of one holds none, a sign that cannot be read is an error."""
    p = _texts(spark, folder).select("request_id", tool_calls.parse_calls(F.col("text"), "array").alias("p"))
    return p.select("request_id", "p.status", F.size("p.calls").alias("calls"), F.get("p.calls", F.lit(0))["name"].alias("first_call"))


@query("c14_execution_strings", f"""WITH {_CALLS}, v AS (SELECT request_id, unnest(range(0, CAST(json_array_length(raw) AS BIGINT))) AS i, raw FROM t WHERE tried AND json_valid(raw)),
c AS (SELECT request_id, i, json_extract(raw, '$[' || i || ']') AS call FROM v), a AS (SELECT request_id, i, json_extract_string(call, '$.call') AS name, json_extract(call, '$.args') AS args FROM c),
k AS (SELECT request_id, i, name, args, json_keys(args) AS keys FROM a), s AS (SELECT request_id, i, name || '(' || array_to_string(list_transform(coalesce(keys, []), lambda x: x || '=' || CASE json_type(args, '$.' || x) WHEN 'VARCHAR' THEN chr(39) || json_extract_string(args, '$.' || x) || chr(39) ELSE json_extract_string(args, '$.' || x) END), ',') || ')' AS line FROM k)
SELECT request_id, string_agg(line, ';' ORDER BY i) AS calls FROM s GROUP BY request_id""")
def c14(spark, folder):
    p = _texts(spark, folder).select("request_id", tool_calls.parse_calls(F.col("text"), "array").alias("p")).filter("p.status = 'valid' and size(p.calls) > 0")
    return p.select("request_id", F.array_join(tool_calls.execution_strings(F.col("p.calls")), ";").alias("calls"))


_WORD = "replace(n_name, ' ', '_')"


@query("c11_tagged_calls", f"SELECT n_nationkey, CASE WHEN n_nationkey % 5 IN (0, 4) THEN 'invalid' ELSE 'valid' END AS status, CASE n_nationkey % 5 WHEN 1 THEN {_WORD} || '(region=' || n_regionkey || ')' WHEN 2 THEN {_WORD} || '(region=' || chr(39) || n_regionkey || chr(39) || ')' WHEN 3 THEN '' END AS calls FROM nation")
def c11_tagged(spark, folder):
    """Tagged calls of every form: cut off, an object, a function with parameters, none, and a broken parameter."""
    k, name, region = F.col("n_nationkey") % 5, F.replace("n_name", F.lit(" "), F.lit("_")), F.col("n_regionkey").cast("string")
    body = F.concat(F.lit("<function="), name, F.lit(">\n<parameter=region>\n"), region, F.lit("\n</parameter>\n</function>"))
    obj = F.concat(F.lit('{"name": "'), name, F.lit('", "arguments": {"region": '), region, F.lit("}}"))
    text = (
        F.when(k == 0, F.concat(F.lit("So. <tool_call>"), obj)).when(k == 1, F.concat(F.lit("<tool_call>\n"), obj, F.lit("\n</tool_call>"))).when(k == 2, F.concat(F.lit("<tool_call>"), body, F.lit("</tool_call>")))
        .when(k == 3, F.lit("No call is made here.")).otherwise(F.concat(F.lit("<tool_call>"), F.replace(body, F.lit("</parameter>"), F.lit("")), F.lit("</tool_call>")))
    )
    p = table(spark, folder, "nation").select("n_nationkey", tool_calls.parse_calls(text, "tagged").alias("p"))
    return p.select("n_nationkey", "p.status", F.when(F.col("p.status") == "valid", F.array_join(tool_calls.execution_strings(F.col("p.calls")), ";")).alias("calls"))


@query("c12_marked_calls", f"SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 3 THEN 'invalid' ELSE 'valid' END AS status, CASE n_nationkey % 4 WHEN 0 THEN 'f(to=' || chr(39) || {_WORD} || chr(39) || ')' WHEN 1 THEN {_WORD} || '(k=' || n_regionkey || ');g(x=None)' WHEN 2 THEN '' END AS calls FROM nation")
def c12_marked(spark, folder):
    """Marked calls of every form: an array, several with a mark each, none, and text after a call."""
    k, name, region = F.col("n_nationkey") % 4, F.replace("n_name", F.lit(" "), F.lit("_")), F.col("n_regionkey").cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit('[TOOL_CALLS][{"name": "f", "arguments": {"to": "'), name, F.lit('"}}]'))).when(k == 1, F.concat(F.lit("Well. [TOOL_CALLS]"), name, F.lit('[ARGS]{"k": '), region, F.lit('}[TOOL_CALLS]g{"x": null}')))
        .when(k == 2, F.lit("No call is made here.")).otherwise(F.concat(F.lit("[TOOL_CALLS]"), name, F.lit('[ARGS]{"k": 1} and more')))
    )
    p = table(spark, folder, "nation").select("n_nationkey", tool_calls.parse_calls(text, "marked").alias("p"))
    return p.select("n_nationkey", "p.status", F.when(F.col("p.status") == "valid", F.array_join(tool_calls.execution_strings(F.col("p.calls")), ";")).alias("calls"))


_NAMES = ["float", "long", "HashMap", "tuple", "bool", "odd"]
_KIND = "CASE n_nationkey % 6 WHEN 0 THEN 'number' WHEN 1 THEN 'integer' WHEN 2 THEN 'object' WHEN 3 THEN 'array' WHEN 4 THEN 'boolean' ELSE 'string' END"


@query("c15_schema_types", f"""SELECT n_nationkey, '{{"properties": {{"type": {{' || CASE WHEN n_nationkey % 6 = 0 THEN '"format": "float", ' ELSE '' END || '"type": "' || {_KIND} || '"}}}}, "type": "object"}}' AS normal FROM nation""")
def c15(spark, folder):
    """Parameter schemas with the types of other languages, one of whose parameters is called type."""
    kind = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("n_nationkey") % 6 + 1).cast("int"))
    raw = F.concat(F.lit('{"type": "dict", "properties": {"type": {"type": "'), kind, F.lit('"}}}'))
    return table(spark, folder, "nation").select("n_nationkey", tool_calls.schema_types(raw).alias("normal"))


_EP = """q AS (SELECT DISTINCT request_id, run_id, dataset_item_id AS item, condition_id AS cond FROM inference_requests WHERE request_id IS NOT NULL), p AS (SELECT request_id, max(status) AS status FROM parse_outcomes GROUP BY 1),
e AS (SELECT q.run_id, q.item, q.cond, count(*) AS n_steps, sum(CASE WHEN p.status = 'invalid' THEN 1 ELSE 0 END) AS bad FROM q LEFT JOIN p ON p.request_id = q.request_id GROUP BY ALL)"""


@query("m6_m7_episode_scores", f"WITH {_EP} SELECT cond, count(*) AS episodes, max(n_steps) AS longest, CAST(sum(CASE WHEN bad > 0 OR n_steps > 20 THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM e GROUP BY 1")
def m7(spark, folder):
    eps = agents.episode_scores(agents.episodes(table(spark, folder, "inference_requests"), table(spark, folder, "parse_outcomes")))
    return eps.groupBy("cond").agg(F.count("*").alias("episodes"), F.max("n_steps").cast("bigint").alias("longest"), F.count_if(~F.col("success")).alias("failed"))


@query("b9_episode_view", f"WITH {_EP} SELECT run_id, cond, count(*) AS episodes, CAST(sum(CASE WHEN bad = 0 AND n_steps <= 20 THEN 1 ELSE 0 END) AS BIGINT) AS valid FROM e GROUP BY ALL")
def b9(spark, folder):
    view = agents.as_observations(agents.episodes(table(spark, folder, "inference_requests"), table(spark, folder, "parse_outcomes")))
    return view.groupBy("run_id", "cond").agg(F.count("*").alias("episodes"), F.count_if("a").alias("valid"))


@query("a16_mock_backend", "WITH q AS (SELECT request_id, min(prompt) AS prompt, min(coalesce(seed, 0)) AS seed FROM inference_requests WHERE prompt IS NOT NULL GROUP BY 1) SELECT request_id, CASE WHEN contains(prompt, 'confidence') THEN '{\"confidence\": 0.9}' ELSE '{\"answer\": \"' || substr('ABCD', CAST(seed % 4 AS INTEGER) + 1, 1) || '\"}' END AS text FROM q")
def a16(spark, folder):
    q = table(spark, folder, "inference_requests").filter("prompt is not null").groupBy("request_id").agg(F.min("prompt").alias("prompt"), F.min(F.coalesce("seed", F.lit(0))).alias("seed"))
    return backends.generate(q)


@query("e11_resume_generation", """WITH q AS (SELECT request_id, min(prompt) AS prompt FROM inference_requests WHERE prompt IS NOT NULL GROUP BY 1), r AS (SELECT request_id, min(text) AS text FROM inference_responses WHERE text IS NOT NULL GROUP BY 1)
SELECT 'stored' AS origin, count(*) AS n, count(DISTINCT text) AS texts FROM r WHERE request_id IS NOT NULL UNION ALL SELECT 'generated', count(*), count(DISTINCT contains(prompt, 'confidence')) FROM q WHERE contains(prompt, 'confidence') AND request_id NOT IN (SELECT request_id FROM r WHERE request_id IS NOT NULL)
UNION ALL SELECT 'answers', count(*), 0 FROM q WHERE NOT contains(prompt, 'confidence') AND request_id NOT IN (SELECT request_id FROM r WHERE request_id IS NOT NULL)""")
def e11(spark, folder):
    """Only what has no stored response is generated: what was kept, and what the mock added for each kind of prompt."""
    q = table(spark, folder, "inference_requests").filter("prompt is not null").groupBy("request_id").agg(F.min("prompt").alias("prompt"), F.min(F.coalesce("seed", F.lit(0))).alias("seed"))
    stored = table(spark, folder, "inference_responses").filter("text is not null and request_id is not null").groupBy("request_id").agg(F.min("text").alias("text"))
    done = backends.generate_missing(q, stored).join(stored.select("request_id", F.lit(True).alias("kept")), "request_id", "left")
    origin = F.when(F.col("kept"), "stored").when(F.col("text").startswith('{"confidence"'), "generated").otherwise("answers")
    got = done.groupBy(origin.alias("origin")).agg(F.count("*").alias("n"), F.countDistinct("text").alias("texts")).withColumn("texts", F.when(F.col("origin") == "answers", 0).otherwise(F.col("texts")))
    names = spark.createDataFrame([("stored",), ("generated",), ("answers",)], "origin string")
    return names.join(got, "origin", "left").na.fill(0)


@query("a2_a3_jsonl_round_trip", "SELECT dataset_id, count(*) AS items FROM (SELECT DISTINCT dataset_id, item_id FROM items WHERE item_id IS NOT NULL) GROUP BY 1")
def a2(spark, folder):
    """Items written as sorted JSON lines and read again under the fixed schema."""
    rows = table(spark, folder, "items").filter("item_id is not null").groupBy("item_id").agg(F.min("dataset_id").alias("group_id"), F.min("question").alias("question"))
    path = f"{shared_dir(spark)}/jsonl-{uuid.uuid4().hex}"
    records.write_jsonl(rows, path)
    return records.read_jsonl(spark, path).groupBy(F.col("group_id").alias("dataset_id")).agg(F.count("*").alias("items"))


@query("l_stream_event_windows", "SELECT strftime(ts, '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark, folder):
    """An extension: tumbling windows over the event stream, drained in full."""
    schema = table(spark, folder, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{folder}/events.parquet*")
    done = ingest.drain(ingest.event_windows(stream), "w" + uuid.uuid4().hex, "complete", f"{shared_dir(spark)}/cp-{uuid.uuid4().hex}")
    return done.withColumn("start", F.date_format("start", "yyyy-MM-dd"))


@query("l_stream_endpoints", W + f"SELECT run_id, cond, {_F1} FROM done GROUP BY ALL")
def stream_endpoints(spark, folder):
    """An extension: endpoints of records as they arrive, each record once."""
    schema = table(spark, folder, "observations").schema
    stream = ingest.record_stream(spark, f"{folder}/observations.parquet*", schema, "record_id", "ingested_at", "3650 days")
    return ingest.drain(ingest.running_endpoints(stream, 0.8), "e" + uuid.uuid4().hex, "complete", f"{shared_dir(spark)}/cp-{uuid.uuid4().hex}")

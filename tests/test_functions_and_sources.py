"""Parsers, hashes, files, backends and streams."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tandemlab.functions import expressions, parsing, tool_calls
from tandemlab.sources import backends, records
from tandemlab.sources.tables import materialize, shared_dir, table
from tandemlab.streaming import ingest


@pytest.mark.parametrize(
    ("text", "v2", "v1"),
    [
        ('{"confidence": 0.5}', 0.5, 0.5), ('so {"confidence": 1}', 1.0, 1.0), ('```json\n{"confidence": 0.25}\n```', 0.25, None), ('{"confidence": 0.5} as said', None, None),
        ('{"confidence": 0.5, "confidence": 0.6}', None, None), ('{"confidence": true}', None, None), ('{"confidence": "0.9"}', None, None), ('{"confidence": 1.5}', None, None),
        ('{"confidence": NaN}', None, None), ('{"confidence": 0.5, "x": 1}', None, None), ('{"a": {"confidence": 0.5}}', None, None), ("", None, None), (None, None, None), ('{"confidence": null}', None, None), ("{}", None, None),
    ],
)
def test_confidence(spark, text, v2, v1):
    got = spark.createDataFrame([(text,)], "t string").select(parsing.confidence(F.col("t")).alias("a"), parsing.confidence(F.col("t"), fence=False).alias("b")).first()
    assert (got["a"], got["b"]) == (v2, v1)


@pytest.mark.parametrize(("text", "want"), [('{"answer": "B"}', "B"), ('x {"answer": "}"}', "}"), ('{"answer": ""}', None), ('{"answer": 4}', None), ('{"answer": "a", "b": 1}', None), ("B", None)])
def test_answer(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(parsing.answer(F.col("t"))).first()[0] == want


def test_exact_match_and_identity(spark):
    rows = [(" Abc\n", "aBC", True), (None, "x", False), ("x", None, None), ("y", "x", False)]
    got = spark.createDataFrame(rows, "g string, w string, want boolean").select(parsing.exact_match(F.col("g"), F.col("w")).alias("m"), "want").collect()
    assert all(r["m"] == r["want"] for r in got)
    assert spark.createDataFrame([(" \n",)], "t string").select(parsing.identity_answer(F.col("t"))).first()[0] is None


def test_template_values_are_not_scanned(spark):
    df = spark.createDataFrame([("{b}", "x")], "a string, b string")
    assert df.select(parsing.fill_template("<{a}|{b}>", {"a": F.col("a"), "b": F.col("b")})).first()[0] == "<{b}|x>"
    with pytest.raises(ValueError, match="once"):
        parsing.fill_template("{a}{a}", {"a": F.col("a")})


def test_shared_prefix(spark):
    rows = [("abc", "abd", 2), ("", "x", 0), ("ab", "ab", 2), ("ab", "abc", 2)]
    assert all(r["p"] == r["n"] for r in spark.createDataFrame(rows, "a string, b string, n int").select(parsing.shared_prefix(F.col("a"), F.col("b")).alias("p"), "n").collect())


def test_ids_and_seeds(spark):
    h = hashlib.sha256(b"11\0item\0answer").digest()
    got = spark.range(1).select(expressions.sampling_seed(F.lit(11), F.lit("item"), F.lit("answer")).alias("s"), expressions.stable_id(F.lit("11"), F.lit("item"), F.lit("answer")).alias("i")).first()
    assert got["i"] == h.hex() and got["s"] == int.from_bytes(h[:8], "big") & (2**63 - 1)


@pytest.mark.parametrize(
    ("dialect", "text", "want"),
    [
        ("tagged", "plain words", []), ("tagged", '<tool_call>{"name": "f", "arguments": {"a": 1}}</tool_call>', ["f(a=1)"]), ("tagged", '<tool_call>{"name": "f", "arguments": "{\\"a\\": 1}"}</tool_call>', ["f(a=1)"]),
        ("tagged", "<tool_call><function=g><parameter=x>\n2\n</parameter></function></tool_call>", ["g(x='2')"]), ("tagged", "<tool_call>{", None), ("tagged", "<tool_call><function=g>junk</function></tool_call>", None),
        ("tagged", '<tool_call>{"name": "bad name", "arguments": {}}</tool_call>', None), ("marked", "none", []), ("marked", '[TOOL_CALLS][{"name": "f", "arguments": {"a": "b"}}]', ["f(a='b')"]),
        ("marked", '[TOOL_CALLS]f[ARGS]{"a": true}[TOOL_CALLS]g{"b": null}', ["f(a=True)", "g(b=None)"]), ("marked", "[TOOL_CALLS]", None), ("marked", '[TOOL_CALLS]f[ARGS]{"a": 1} more', None),
        ("array", 'So: [{"call": "f", "args": {"a": 1}}]', ["f(a=1)"]), ("array", '[{"call": "f", "args"', None),
    ],
)
def test_tool_calls(dialect, text, want):
    if want is None:
        with pytest.raises(tool_calls.CallError):
            tool_calls.DIALECTS[dialect](text)
    else:
        assert [tool_calls.execution_string(n, a) for n, a in tool_calls.DIALECTS[dialect](text)] == want


def test_tool_call_columns(spark):
    df = spark.createDataFrame([('[{"call": "f", "args": {"a": 1}}]',), (None,), ('[{"call": 1}]',)], "t string")
    got = [r["p"]["status"] for r in df.select(tool_calls.parse_calls(F.col("t"), "array").alias("p")).collect()]
    assert got == ["valid", None, "invalid"]


def test_schema_types():
    got = tool_calls.normalised_schema({"type": "dict", "properties": {"a": {"type": "float"}, "b": {"type": "odd"}, "c": [{"type": "tuple"}]}})
    assert got == {"type": "object", "properties": {"a": {"type": "number", "format": "float"}, "b": {"type": "string"}, "c": [{"type": "array"}]}}


def test_jsonl(spark, tmp_path):
    p = tmp_path / "items.jsonl"
    p.write_text('{"item_id": "a", "question": "q"}\n\n{"item_id": "b"}\n')
    assert records.read_jsonl(spark, str(p), sha256=hashlib.sha256(p.read_bytes()).hexdigest()).count() == 2
    with pytest.raises(ValueError, match="hash"):
        records.read_jsonl(spark, str(p), sha256="0" * 64)
    p.write_text('{"item_id": "a"}\n{"item_id": "a"}\n')
    with pytest.raises(ValueError, match="repeated"):
        records.read_jsonl(spark, str(p))
    p.write_text('{"item_id": "a"\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        records.read_jsonl(spark, str(p)).collect()


def test_publication_is_idempotent_and_immutable(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    path = str(tmp_path / "out")
    assert records.publish(df, path) == "written" and records.publish(df, path) == "unchanged"
    with pytest.raises(ValueError, match="different"):
        records.publish(df.withColumn("v", F.lit(2)), path)
    with pytest.raises(Exception, match="(?i)exists"):
        records.write_immutable(df, path)


def test_markdown_prints_undefined(spark):
    assert records.markdown(spark.createDataFrame([("a", None)], "k string, v double")).splitlines()[-1] == "| a | undefined |"


def test_backends(spark):
    q = spark.createDataFrame([("1", "say confidence", 1), ("2", "pick", 3), ("3", "pick", None)], "request_id string, prompt string, seed bigint")
    assert {r["request_id"]: r["text"] for r in backends.generate(q).collect()} == {"1": '{"confidence": 0.9}', "2": '{"answer": "D"}', "3": '{"answer": "A"}'}
    stored = spark.createDataFrame([("2", "kept")], "request_id string, text string")
    assert {r["request_id"]: r["text"] for r in backends.generate_missing(q, stored).collect()}["2"] == "kept"
    scored = backends.score_once(spark.createDataFrame([("a", "xx"), ("b", "xx"), ("c", None)], "record_id string, text string"), lambda ts: [float(len(t)) for t in ts])
    assert {r["record_id"]: r["score"] for r in scored.collect()} == {"a": 2.0, "b": 2.0}


def test_materialize_goes_to_the_shared_folder(spark):
    df = materialize(spark.range(3))
    assert df.count() == 3 and shared_dir(spark).removeprefix("file://").removeprefix("file:").rstrip("/").split("/")[-1] in df.inputFiles()[0]


def test_record_stream_resumes_without_repeats(spark, tmp_path):
    src, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    rows = [("a", "2026-01-01 00:00:00"), ("b", "2026-01-01 01:00:00"), ("a", "2026-01-01 02:00:00")]
    make = lambda rs: spark.createDataFrame(rs, "record_id string, t string").withColumn("t", F.col("t").cast("timestamp"))
    make(rows).write.mode("append").parquet(src)

    def run():
        out = ingest.record_stream(spark, src, "record_id string, t timestamp", "record_id", "t")
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", cp).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r["record_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == ["a", "b"]
    make([("b", "2026-01-01 03:00:00"), ("c", "2026-01-01 03:00:00")]).write.mode("append").parquet(src)
    assert run() == ["a", "b", "c"]


def test_last_states(spark, smallest, tmp_path):
    events = table(spark, smallest, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{smallest}/events.parquet*")
    got = ingest.drain(ingest.last_states(stream), "last_states", "update", str(tmp_path / "cp"))
    want = {r["user_id"]: (r["n"], r["k"]) for r in events.groupBy("user_id").agg(F.count("*").alias("n"), F.max_by("event_type", F.struct("ts", "event_id")).alias("k")).collect()}
    assert {r["user_id"]: (r["events"], r["last_type"]) for r in got.collect()} == want


def test_schemas_may_have_parameters_named_type():
    schema = {"type": "dict", "properties": {"type": {"type": "long"}, "properties": {"type": "HashMap", "properties": {"x": {"type": "float"}}}}, "items": {"type": "char"}}
    got = tool_calls.normalised_schema(schema)
    assert got == {"type": "object", "properties": {"type": {"type": "integer"}, "properties": {"type": "object", "properties": {"x": {"type": "number", "format": "float"}}}}, "items": {"type": "string"}}
    assert schema["type"] == "dict"


def test_materialized_tables_can_be_released(spark):
    from tandemlab.sources.tables import release

    release(spark)
    a = materialize(spark.range(5))
    path = a.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:")
    import os

    assert os.path.isdir(path) and release(spark) == 1 and not os.path.isdir(path) and release(spark) == 0


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(session)


def test_plans_are_checked(spark, tmp_path):
    from tandemlab.sources import config

    good = {"experiment_id": "e", "dataset_id": "d", "reference": "r", "conditions": ["r", "s"], "seeds": [1, 2], "target_risk": 0.2, "minimum_coverage": 0.1, "fixed_coverage": 0.5}
    plan = config.plan_from(good)
    assert (plan.replicates, plan.randomisations) == (5000, 9999) and plan.design(spark.createDataFrame([("a",), ("a",)], "item_id string")).count() == 4
    for change in ({"conditions": ["s", "t"]}, {"conditions": ["r"]}, {"seeds": [1, 1]}, {"target_risk": 2.0}, {"target_risk": "0.2"}, {"extra": 1}, {"replicates": 0}, {"experiment_id": " "}, {"replicates": True}):
        with pytest.raises(config.PlanError):
            config.plan_from(good | change)
    with pytest.raises(config.PlanError):
        config.plan_from({k: v for k, v in good.items() if k != "seeds"})
    for text in ('{"seeds": [1], "seeds": [2]}', "[1]", "{"):
        (p := tmp_path / "plan.json").write_text(text)
        with pytest.raises(config.PlanError):
            config.load_plan(spark, str(p))


def test_results_stay_out_of_the_repository(tmp_path):
    from pathlib import Path

    from tandemlab.sources import config

    assert config.storage_root({"TANDEMLAB_STORAGE": str(tmp_path)}) == str(tmp_path.resolve()) and config.storage_root({"TANDEMLAB_STORAGE": "s3a://b/x/"}) == "s3a://b/x"
    for bad in ({}, {"TANDEMLAB_STORAGE": "here"}, {"TANDEMLAB_STORAGE": str(Path(config.__file__).parent)}):
        with pytest.raises(config.PlanError):
            config.storage_root(bad)


def test_datasets_by_kind_and_published_lines(spark, tmp_path):
    df = spark.createDataFrame([("b", "q2"), ("a", None)], "item_id string, question string")
    path = str(tmp_path / "lines")
    assert records.publish_jsonl(df, path) == "written" and records.publish_jsonl(df.repartition(2), path) == "unchanged"
    with pytest.raises(ValueError, match="different"):
        records.publish_jsonl(df.limit(1), path)
    assert records.load_dataset(spark, {"kind": "jsonl", "path": "lines", "schema": "item_id string, question string"}, str(tmp_path)).count() == 2
    with pytest.raises(ValueError, match="no such"):
        records.load_dataset(spark, {"kind": "csv", "path": "x"}, str(tmp_path))


def test_first_difference(spark):
    rows = [('{"a": {"b": 1, "c": 2}, "z": 0}', '{"z": 0, "a": {"c": 3, "b": 1}}', "a.c"), ('{"a": 1}', '{"a": 1}', None), ('{"a": 1}', '{"b": 1}', "a"), ("{", "{}", "$"), (None, None, None), ('{"a": {}}', '{"a": 1}', "a"), (None, "{}", "$")]
    got = spark.createDataFrame(rows, "x string, y string, want string").select(parsing.first_difference(F.col("x"), F.col("y")).alias("p"), "want").collect()
    assert all(r["p"] == r["want"] for r in got)

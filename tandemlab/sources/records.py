"""Record files: schemas, strict readers, immutable writers and report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemlab.operators.audit import duplicates

ITEM_SCHEMA = "item_id string, question string, answer string, success_criterion string, partition string, group_id string, scoring_payload string, metadata string"
GENERATION_SCHEMA = "request_id string, stage string, condition_id string, seed bigint, text string, finish_reason string, prompt_tokens int, completion_tokens int"


def read_jsonl(spark: SparkSession, path: str, schema: str = ITEM_SCHEMA, key: str = "item_id", sha256: str | None = None) -> DataFrame:
    """JSON lines under a fixed schema: broken lines fail, blank ones are skipped, a null or repeated key is an error; ``sha256`` checks a single file, on the executors."""
    if sha256 is not None and [r[0] for r in spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).collect()] != [sha256]:
        raise ValueError("content hash differs")
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if rows.filter(F.col(key).isNull() | (F.col(key) == "")).limit(1).count() or duplicates(rows, [key]).limit(1).count():
        raise ValueError(f"empty or repeated {key}")
    return rows


#: How a dataset of each kind is read: path, schema, key, hash.
KINDS = {
    "jsonl": lambda spark, path, schema, key, sha256: read_jsonl(spark, path, schema, key, sha256),
    "parquet": lambda spark, path, schema, key, sha256: spark.read.schema(schema).parquet(path),
    "store": lambda spark, path, schema, key, sha256: read_store(spark, path, schema),
}


def load_dataset(spark: SparkSession, spec: dict[str, str], folder: str) -> DataFrame:
    """The dataset of a spec {kind, path, and at will schema, key, sha256} below ``folder``; an unknown kind or entry is an error."""
    odd = set(spec) - {"kind", "path", "schema", "key", "sha256"}
    if odd or spec.get("kind") not in KINDS:
        raise ValueError(f"no such dataset: {sorted(odd) or spec.get('kind')}")
    return KINDS[spec["kind"]](spark, f"{folder.rstrip('/')}/{spec['path']}", spec.get("schema", ITEM_SCHEMA), spec.get("key", "item_id"), spec.get("sha256"))


def read_store(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A record store: one JSON file per record in nested folders."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("recursiveFileLookup", "true").option("multiLine", "true").json(folder)


def write_immutable(df: DataFrame, path: str) -> None:
    """Parquet that is never overwritten: an existing path is an error."""
    df.write.mode("errorifexists").parquet(path)


def publish(df: DataFrame, path: str) -> str:
    """Writes a result, or, where it exists, checks that it is the same: 'written', 'unchanged', or an error."""
    from tandemlab.operators.audit import republish_difference

    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        write_immutable(df, path)
        return "written"
    if republish_difference(spark.read.parquet(path), df).limit(1).count():
        raise ValueError("a different result is already published")
    return "unchanged"


def write_jsonl(df: DataFrame, path: str, key: str = "item_id") -> None:
    """Sorted JSON lines with null fields, range-partitioned by key so that the parts in order are the sorted file."""
    df.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def publish_jsonl(df: DataFrame, path: str, key: str = "item_id") -> str:
    """As ``publish``, for sorted JSON lines: 'written', 'unchanged', or an error where other lines stand there already."""
    from tandemlab.operators.audit import republish_difference

    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        write_jsonl(df, path, key)
        return "written"
    lines = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    if republish_difference(spark.read.text(path), lines).limit(1).count():
        raise ValueError("different lines are already published")
    return "unchanged"


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", "true").csv(path)


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A result of a few rows as a Markdown table; an undefined number is written as 'undefined', and more than ``limit`` rows are an error."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("too many rows for a report")
    show = lambda v: "undefined" if v is None else f"{v:.4f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |", *["| " + " | ".join(show(v) for v in r) + " |" for r in rows]])

"""The queries of the nine problems and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemlab.llm import cutoff, families, languages, leakage, mixing, overlap, pairs, residue, sampling, truncation
from tandemlab.sources.tables import materialize, table


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.judged(table(spark, folder, "inference_responses"), table(spark, folder, "inference_requests"), table(spark, folder, "truncation_diagnostic"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder).filter("cut").select("request_id")


def p1_rates(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncation_rates(_judged(spark, folder))


def p1_limits(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.read_pairs(table(spark, folder, "inference_responses"), table(spark, folder, "inference_requests"))[1]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return families.torn_items(table(spark, folder, "items"))


def p2_splits(spark: SparkSession, folder: str) -> DataFrame:
    return families.assign_splits(table(spark, folder, "items"), table(spark, folder, "split_targets"))


def p2_shares(spark: SparkSession, folder: str) -> DataFrame:
    targets = table(spark, folder, "split_targets")
    return families.split_shares(materialize(families.assign_splits(table(spark, folder, "items"), targets)), targets)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.cross_split_pairs(table(spark, folder, "items")).select("item_id_a", "item_id_b")


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.class_counts(table(spark, folder, "items"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    cut = cutoff.coverage_cutoffs(table(spark, folder, "observations"), table(spark, folder, "calibration_thresholds"))
    return cut.select("run_id", F.round(F.col("cutoff") * 1000).cast("bigint").alias("cutoff_milli"), "kept")


def p4_cutoffs(spark: SparkSession, folder: str) -> DataFrame:
    cut = cutoff.coverage_cutoffs(table(spark, folder, "observations"), table(spark, folder, "calibration_thresholds"))
    return cut.select("run_id", "n", "kept", "cutoff", F.round("coverage", 8).alias("coverage"), "target")


def p5_sample(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.stable_sample(table(spark, folder, "items"), table(spark, folder, "unit_selections"))


def _defects(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.find_defects(_judged(spark, folder), languages.learn(table(spark, folder, "items"), pairs.FREQUENT), pairs.learn_frames(table(spark, folder, "inference_requests")))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _defects(spark, folder).select("request_id", "defect")


def p6_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.defect_witnesses(_defects(spark, folder), table(spark, folder, "parse_outcomes"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "heldout_items")).select("doc_id", "heldout_id")


def p7_passages(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "heldout_items"))


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    held = table(spark, folder, "heldout_items")
    return leakage.leaked_items(leakage.leaks(table(spark, folder, "documents"), held), held)


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    targets = table(spark, folder, "mix_targets")
    return mixing.mix_shares(materialize(mixing.mix(table(spark, folder, "documents"), targets)), targets)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue_documents(table(spark, folder, "documents"))


def p9_clean(spark: SparkSession, folder: str) -> DataFrame:
    return residue.clean_documents(table(spark, folder, "documents")).select("doc_id", "source", "lang")


def p2_kept(spark: SparkSession, folder: str) -> DataFrame:
    """What the splits promise, per dataset: no family torn, and each share as near its target as its largest family allows."""
    targets = table(spark, folder, "split_targets")
    assigned = materialize(families.assign_splits(table(spark, folder, "items"), targets))
    torn = assigned.groupBy("family").agg(F.min("dataset_id").alias("dataset_id"), F.min("split").alias("lo"), F.max("split").alias("hi"), F.count("*").alias("n"))
    per = torn.groupBy("dataset_id").agg(F.count_if(F.col("lo") != F.col("hi")).alias("torn"), F.max("n").alias("largest"))
    sizes = assigned.groupBy("dataset_id").agg(F.count("*").alias("items"))
    off = families.split_shares(assigned, targets).groupBy("dataset_id").agg(F.max(F.abs(F.col("share") - F.col("target"))).alias("off"))
    out = sizes.join(per, "dataset_id", "left").join(off, "dataset_id")
    return out.select("dataset_id", "items", F.coalesce("torn", F.lit(0)).alias("torn"), (F.col("off") <= 0.02 + F.coalesce("largest", F.lit(0)) / F.col("items")).alias("near"))


def p7_kept(spark: SparkSession, folder: str) -> DataFrame:
    """How many reported passages break their promise: fewer than 12 words, or a place that is not in the text or does not hold them."""
    docs = table(spark, folder, "documents").filter("doc_id is not null").groupBy("doc_id").agg(F.max("text").alias("text"))
    found = leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "heldout_items")).join(docs, "doc_id")
    cut = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    letters = F.size(F.regexp_extract_all(cut, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    bad = F.coalesce((F.col("n_words") < leakage.RUN) | (F.col("start") < 0) | (F.col("end") > F.length("text")) | (letters < F.col("n_words")), F.lit(True))
    return found.agg(F.count_if(bad).alias("broken"))


def p8_kept(spark: SparkSession, folder: str) -> DataFrame:
    """What the mixture promises, per source that has documents: the share of its target among such sources but for a document, and no document above its repeats."""
    targets = table(spark, folder, "mix_targets")
    mixture = materialize(mixing.mix(table(spark, folder, "documents"), targets))
    held = mixing.mix_shares(mixture, targets).filter("tokens > 0")
    total = held.agg(F.sum("target_weight")).first()[0] or 1.0  # one row per source
    largest, tokens = mixture.agg(F.max("size"), F.sum("size")).first()
    slack = 0.01 + 2 * (largest or 0) / max(1, tokens or 0)  # a source ends with the document that reaches its share
    used = mixture.groupBy("source", "doc_id").agg(F.count("*").alias("k")).groupBy("source").agg(F.max("k").alias("k"))
    return held.join(used, "source").select("source", (F.abs(F.col("share") - F.col("target_weight") / total) <= slack).alias("near"), (F.col("k") <= F.col("max_repeats")).alias("capped"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_rates, p1_limits, p2_found, p2_splits, p2_shares, p2_kept, p3_found, p3_counts, p4_found, p4_cutoffs, p5_sample,
        p6_found, p6_kinds, p7_found, p7_passages, p7_items, p7_kept, p8_mixture, p8_shares, p8_kept, p9_found, p9_clean,
    )
}

_CUTOFFS = """
WITH rec AS (
  SELECT o.run_id, o.record_id, bool_or(o.answer_parse_status = 'valid' AND o.confidence_parse_status = 'valid' AND o.confidence IS NOT NULL) AS ok,
         max(CASE WHEN o.confidence_parse_status = 'valid' THEN o.confidence END) AS score
  FROM observations o
  WHERE o.condition_id = 'reference' AND o.dataset_partition = 'development' AND o.record_id IS NOT NULL
  GROUP BY 1, 2),
run AS (SELECT run_id, count(*) AS n FROM rec GROUP BY 1),
target AS (SELECT run_id, max(fixed_coverage_target) AS target FROM calibration_thresholds WHERE run_id IS NOT NULL GROUP BY 1),
atom AS (SELECT run_id, score, sum(CASE WHEN ok THEN 1 ELSE 0 END) AS c FROM rec WHERE score IS NOT NULL GROUP BY 1, 2),
walk AS (SELECT run_id, score, sum(c) OVER (PARTITION BY run_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS kept FROM atom),
hit AS (
  SELECT w.run_id, r.n, w.kept, w.score AS cutoff, t.target, row_number() OVER (PARTITION BY w.run_id ORDER BY w.score DESC) AS k
  FROM walk w JOIN run r ON r.run_id = w.run_id JOIN target t ON t.run_id = w.run_id
  WHERE w.kept >= t.target * r.n)
"""

SQL: dict[str, str] = {
    "p2_found": r"""
WITH RECURSIVE raw AS (
  SELECT item_id, nullif(trim(partition), '') AS partition,
         regexp_replace(regexp_replace(lower(regexp_replace(group_id, '^\s+|\s+$', '', 'g')), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') AS g,
         CASE WHEN dataset_id IN ('multi-rule', 'style-code', 'tool-turns') THEN nullif(regexp_extract(item_id, '^(.+?)-[nv][0-9]+$', 1), '') END AS stem,
         nullif(trim(json_extract_string(CASE WHEN json_valid(metadata) THEN metadata END, '$.scenario')), '') AS sc
  FROM items WHERE item_id IS NOT NULL),
named AS (SELECT item_id, partition, sc, coalesce(nullif(g, ''), lower(stem)) AS g FROM raw),
keyed AS (SELECT item_id, partition, sc, CASE WHEN regexp_matches(g, '^.*?-?0*[0-9]+$') THEN regexp_extract(g, '^(.*?)-?0*([0-9]+)$', 1) || '-' || regexp_extract(g, '^(.*?)-?0*([0-9]+)$', 2) ELSE g END AS g FROM named),
link AS (
  SELECT item_id, 'g:' || g AS k FROM keyed WHERE g IS NOT NULL
  UNION SELECT item_id, 's:' || sc FROM keyed WHERE sc IS NOT NULL
  UNION SELECT item_id, 'i:' || item_id FROM keyed),
edge AS (SELECT DISTINCT a.k AS u, b.k AS v FROM link a JOIN link b ON a.item_id = b.item_id),
reach AS (SELECT u AS root, u AS node FROM edge UNION SELECT r.root, e.v FROM reach r JOIN edge e ON e.u = r.node),
comp AS (SELECT node, min(root) AS c FROM reach GROUP BY 1),
fam AS (SELECT DISTINCT k.item_id, k.partition, c.c FROM keyed k JOIN comp c ON c.node = 'i:' || k.item_id),
torn AS (SELECT c FROM fam WHERE partition IS NOT NULL GROUP BY c HAVING count(DISTINCT partition) > 1)
SELECT DISTINCT item_id FROM fam WHERE c IN (SELECT c FROM torn)""",
    "p4_found": _CUTOFFS + "SELECT run_id, CAST(round(cutoff * 1000) AS BIGINT) AS cutoff_milli, CAST(kept AS BIGINT) AS kept FROM hit WHERE k = 1",
    "p4_cutoffs": _CUTOFFS + "SELECT run_id, CAST(n AS BIGINT) AS n, CAST(kept AS BIGINT) AS kept, cutoff, round(kept / n, 8) AS coverage, target FROM hit WHERE k = 1",
    "p2_kept": "SELECT dataset_id, count(*) AS items, CAST(0 AS BIGINT) AS torn, true AS near FROM (SELECT item_id, min(dataset_id) AS dataset_id FROM items WHERE item_id IS NOT NULL GROUP BY 1) WHERE dataset_id IN (SELECT dataset_id FROM split_targets) GROUP BY 1",
    "p7_kept": "SELECT CAST(0 AS BIGINT) AS broken",
    "p8_kept": "SELECT DISTINCT t.source, true AS near, true AS capped FROM mix_targets t JOIN documents d ON d.source = t.source WHERE t.target_weight > 0 AND d.doc_id IS NOT NULL AND (d.n_tokens > 0 OR (d.n_tokens IS NULL AND length(d.text) > 0))",
    "p5_sample": r"""
WITH sel AS (SELECT dataset_id, arg_max(selector_salt, coalesce(wave, 0)) AS salt, arg_max(keep_fraction, coalesce(wave, 0)) AS keep, max(CASE WHEN selected_item_ids IS NOT NULL THEN wave END) AS drawn_wave
  FROM unit_selections WHERE dataset_id IS NOT NULL AND keep_fraction IS NOT NULL GROUP BY 1),
rec AS (SELECT DISTINCT dataset_id, unnest(selected_item_ids) AS item_id FROM unit_selections),
one AS (SELECT dataset_id, item_id, min(wave) AS wave, max(wave) AS last_wave, bool_or(wave IS NULL) AS no_wave FROM items WHERE item_id IS NOT NULL AND dataset_id IS NOT NULL GROUP BY 1, 2),
cut AS (SELECT *, regexp_extract(item_id, '^(?:.*-)?[A-Za-z]*([0-9]{1,15})(?:-[nv]([0-9]{1,15}))?$', 1) AS g, regexp_extract(item_id, '^(?:.*-)?[A-Za-z]*([0-9]{1,15})(?:-[nv]([0-9]{1,15}))?$', 2) AS m FROM one),
num AS (SELECT *, CASE WHEN g = '' THEN CAST('0x' || substr(md5(item_id), 1, 8) AS BIGINT) WHEN m = '' THEN CAST(g AS BIGINT) ELSE CAST(g AS BIGINT) % 1099511627776 * 65536 + CAST(m AS BIGINT) END AS seq FROM cut),
x AS (SELECT n.*, s.keep, s.drawn_wave, (n.seq % 2147483648 * 2654435769 + CAST('0x' || substr(md5(coalesce(s.salt, '')), 1, 8) AS BIGINT)) % 4294967296 / CAST(4294967296 AS DOUBLE) AS v FROM num n JOIN sel s ON s.dataset_id = n.dataset_id)
SELECT x.dataset_id, x.item_id, CAST(x.wave AS INTEGER) AS wave, x.seq, CASE WHEN rec.item_id IS NOT NULL THEN 'recorded' ELSE 'drawn' END AS origin
FROM x LEFT JOIN rec ON rec.dataset_id = x.dataset_id AND rec.item_id = x.item_id
WHERE rec.item_id IS NOT NULL OR ((x.drawn_wave IS NULL OR x.no_wave OR x.last_wave > x.drawn_wave) AND x.v < x.keep)""",
}

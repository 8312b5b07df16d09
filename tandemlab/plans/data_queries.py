"""Split, sampling, parsing, join, audit and set queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tandemlab.functions import expressions as ex
from tandemlab.functions import parsing
from tandemlab.operators import audit, sampling
from tandemlab.operators.inference import with_upper_bound
from tandemlab.operators.ranking import range_rank
from tandemlab.plans.endpoint_queries import HOT, NARROW, REFERENCE, SUM, W, cell, done, obs
from tandemlab.plans.resampling_queries import bound_sql
from tandemlab.sources.tables import table

QUERIES, SQL = {}, {}
SALT = "tandem-split-salt-1"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def items(spark, folder):
    return table(spark, folder, "items").filter(F.col("item_id").isNotNull()).select("dataset_id", "item_id").distinct()


_SHA = lambda salt, k: f"sha256('{salt}' || chr(0) || {k})"
_ITEMS = "it AS (SELECT DISTINCT dataset_id, item_id FROM items WHERE item_id IS NOT NULL)"
_RK = f"rk AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY {_SHA(SALT, 'item_id')}, item_id) AS rank, count(*) OVER (PARTITION BY dataset_id) AS n FROM it)"
_COUNTS = """ct AS (SELECT *, n - b0 - b1 - b2 AS left_over FROM (SELECT DISTINCT dataset_id, n, floor(n * CAST(0.5 AS DOUBLE)) AS b0, floor(n * CAST(0.3 AS DOUBLE)) AS b1, floor(n * CAST(0.2 AS DOUBLE)) AS b2, n * CAST(0.5 AS DOUBLE) - floor(n * CAST(0.5 AS DOUBLE)) AS r0, n * CAST(0.3 AS DOUBLE) - floor(n * CAST(0.3 AS DOUBLE)) AS r1, n * CAST(0.2 AS DOUBLE) - floor(n * CAST(0.2 AS DOUBLE)) AS r2 FROM {src})),
cc AS (SELECT *, b0 + CASE WHEN CAST(r1 > r0 AS INT) + CAST(r2 > r0 AS INT) < left_over THEN 1 ELSE 0 END AS c0, b1 + CASE WHEN CAST(r0 >= r1 AS INT) + CAST(r2 > r1 AS INT) < left_over THEN 1 ELSE 0 END AS c1 FROM ct)"""


@query("d1_deterministic_split", f"WITH {_ITEMS}, {_RK}, {_COUNTS.format(src='rk')} SELECT r.dataset_id, r.item_id, CASE WHEN rank <= c0 THEN 'development' WHEN rank <= c0 + c1 THEN 'certification' ELSE 'test' END AS split FROM rk r JOIN cc c ON c.dataset_id = r.dataset_id")
def d1(spark, folder):
    return sampling.deterministic_split(items(spark, folder), ["dataset_id"], "item_id", SALT, (0.5, 0.3, 0.2))


@query("d2_item_window", f"WITH {_ITEMS}, {_RK} SELECT dataset_id, item_id FROM rk WHERE rank > 10 AND rank <= 40 AND n >= 40")
def d2(spark, folder):
    return sampling.window(items(spark, folder), ["dataset_id"], "item_id", SALT, 10, 30)


@query("d3_subselection", f"WITH {_ITEMS}, {_RK}, w AS (SELECT dataset_id, item_id FROM rk WHERE rank > 10 AND rank <= 40 AND n >= 40) SELECT dataset_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY {_SHA('second-salt-xyz-2', 'item_id')}, item_id) AS k FROM w) WHERE k <= 8")
def d3(spark, folder):
    return sampling.subselection(sampling.window(items(spark, folder), ["dataset_id"], "item_id", SALT, 10, 30), ["dataset_id"], "item_id", "second-salt-xyz-2", 8)


_GROUPS = "it AS (SELECT DISTINCT s_nationkey AS dataset_id, CAST(l_suppkey AS VARCHAR) AS item_id FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)"


@query("d4_group_split", f"WITH {_GROUPS}, {_RK}, {_COUNTS.format(src='rk')}, sp AS (SELECT r.item_id AS g, CASE WHEN rank <= c0 THEN 'development' WHEN rank <= c0 + c1 THEN 'certification' ELSE 'test' END AS split FROM rk r JOIN cc c ON c.dataset_id = r.dataset_id) SELECT split, count(*) AS rows, count(DISTINCT g) AS groups FROM lineitem JOIN sp ON g = CAST(l_suppkey AS VARCHAR) GROUP BY 1")
def d4(spark, folder):
    nation = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dataset_id"))
    rows = table(spark, folder, "lineitem").select("l_suppkey").join(nation, "l_suppkey").withColumn("g", F.col("l_suppkey").cast("string"))
    split = sampling.deterministic_split(rows.select("dataset_id", "g"), ["dataset_id"], "g", SALT, (0.5, 0.3, 0.2))
    return rows.join(split, ["dataset_id", "g"]).groupBy("split").agg(F.count("*").alias("rows"), F.countDistinct("g").alias("groups"))


@query("d5_balanced_anchors", f"""WITH v AS (SELECT DISTINCT s_nationkey AS ds, CAST(l_suppkey AS VARCHAR) AS g, l_linenumber AS lv FROM lineitem JOIN supplier ON s_suppkey = l_suppkey), l AS (SELECT ds, list_sort(list(DISTINCT lv)) AS levels FROM v GROUP BY 1),
wh AS (SELECT v.ds, v.g, any_value(l.levels) AS levels FROM v JOIN l ON l.ds = v.ds GROUP BY 1, 2 HAVING count(*) = len(any_value(l.levels))), tn AS (SELECT *, row_number() OVER (PARTITION BY ds ORDER BY {_SHA(SALT, 'g')}, g) AS rank FROM wh)
SELECT ds AS dataset_id, g, levels[(rank - 1) % len(levels) + 1] AS level, g || '-' || CAST(levels[(rank - 1) % len(levels) + 1] AS VARCHAR) AS item FROM tn""")
def d5(spark, folder):
    nation = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dataset_id"))
    v = table(spark, folder, "lineitem").select("l_suppkey", F.col("l_linenumber").alias("level")).distinct().join(nation, "l_suppkey")
    v = v.select("dataset_id", F.col("l_suppkey").cast("string").alias("g"), "level", F.concat_ws("-", F.col("l_suppkey").cast("string"), F.col("level").cast("string")).alias("item"))
    return sampling.balanced_anchors(v, ["dataset_id"], "g", "level", "item", SALT)


@query("d6_b11_replica_shards", f"WITH {_ITEMS} SELECT CAST('0x' || substr({_SHA('shard-v1', 'item_id')}, 1, 15) AS BIGINT) % 4 AS shard, count(*) AS items FROM it GROUP BY 1")
def d6(spark, folder):
    return items(spark, folder).groupBy(sampling.shard(F.col("item_id"), 4).alias("shard")).agg(F.count("*").alias("items"))


_D7 = f"""p AS (SELECT p_brand AS stratum, p_size AS level, CAST(p_partkey AS VARCHAR) AS k, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY {_SHA(SALT, 'CAST(p_partkey AS VARCHAR)')}, CAST(p_partkey AS VARCHAR)) AS turn FROM part),
sm AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY turn, {_SHA(SALT, 'k')}, k) AS r FROM p)"""


@query("d7_balanced_sample", f"WITH {_D7} SELECT stratum, level, k FROM sm WHERE r <= 10")
def d7(spark, folder):
    part = table(spark, folder, "part").select(F.col("p_brand").alias("stratum"), F.col("p_size").alias("level"), F.col("p_partkey").cast("string").alias("k"))
    return sampling.balanced_sample(part, "stratum", "level", "k", SALT, 10)


@query("d8_d9_greedy_partition")
def d8(spark, folder):
    part = table(spark, folder, "part").select(F.col("p_brand").alias("stratum"), F.col("p_size").alias("level"), F.col("p_partkey").cast("string").alias("k"))
    sampled = sampling.greedy_partition(part, "stratum", "level", "k", SALT, (4, 3, 3)).select("k", F.col("split").alias("sample_split"))
    return sampling.exact_partition(part, ["stratum", "level"], "k", SALT).join(sampled, "k", "left").select("stratum", "level", "k", "split", "sample_split")


@query("d10_group_contract", "SELECT dataset_id, group_id, count(DISTINCT item_id) AS variants FROM items WHERE group_id IS NOT NULL GROUP BY ALL HAVING count(DISTINCT item_id) <> 10")
def d10(spark, folder):
    rows = table(spark, folder, "items").filter(F.col("group_id").isNotNull())
    return rows.groupBy("dataset_id", "group_id").agg(F.countDistinct("item_id").alias("variants")).filter("variants != 10")


_DESIGN = f"""ds AS (SELECT item_id, ac, s, unnest(CASE WHEN ac = 'reference' THEN ['reference', 'low-top-p'] ELSE [ac, 'reference'] END) AS readout FROM it, unnest(['reference', 'high-temperature']) t(ac), unnest([11, 23]) u(s))"""
_ROLE = "CASE WHEN readout = ac AND readout = 'reference' THEN 'coupled+standardized' WHEN readout = ac THEN 'coupled' WHEN readout = 'reference' THEN 'standardized' ELSE 'report_only' END"


@query("d12_d14_design_roles", f"WITH {_ITEMS}, {_DESIGN} SELECT ac AS answer_condition, readout, {_ROLE} AS roles, count(*) AS cells FROM ds GROUP BY ALL")
def d12(spark, folder):
    cells = sampling.expand_design(items(spark, folder), [REFERENCE, HOT], [11, 23], REFERENCE, [NARROW])
    return cells.groupBy("answer_condition", "readout", "roles").agg(F.count("*").alias("cells"))


@query("d15_expected_cells", f"WITH {_ITEMS} SELECT dataset_id, count(*) * 2 * 2 AS cells FROM it GROUP BY 1")
def d15(spark, folder):
    return sampling.expand_design(items(spark, folder), [REFERENCE, HOT], [11, 23], REFERENCE, coupled_only=True).groupBy("dataset_id").agg(F.count("*").alias("cells"))


@query("d17_sample_of_files", f"WITH {_ITEMS}, {_RK} SELECT dataset_id, item_id FROM rk WHERE rank <= 12")
def d17(spark, folder):
    return sampling.ranked(items(spark, folder), ["dataset_id"], "item_id", SALT).filter("rank <= 12").select("dataset_id", "item_id")


_RAW = """CASE event_id % 9 WHEN 0 THEN '{"confidence": 0.' || k || '}' WHEN 1 THEN 'So it is. {"confidence": 0.' || k || '}' WHEN 2 THEN '```json\n{"confidence": 0.' || k || '}\n```' WHEN 3 THEN '{"confidence": 0.' || k || '} indeed' WHEN 4 THEN '{"confidence": 0.1, "confidence": 0.' || k || '}'
WHEN 5 THEN '{"confidence": true}' WHEN 6 THEN '{"confidence": "0.' || k || '"}' WHEN 7 THEN '{"confidence": ' || k || '.5}' ELSE '{"confidence": 0.' || k || ', "more": 1}' END"""


@query("c1_c3_parse_confidence", f"""WITH r AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events), t AS (SELECT event_id % 9 AS form, k, {_RAW} AS raw FROM r)
SELECT form, count(*) AS n, {SUM("form IN (0, 1, 2) OR form = 7 AND CAST(k AS INT) = 0")} AS valid_fence, {SUM("form IN (0, 1) OR form = 7 AND CAST(k AS INT) = 0")} AS valid_plain,
round(sum(CASE WHEN form IN (0, 1, 2) THEN CAST('0.' || k AS DOUBLE) WHEN form = 7 AND CAST(k AS INT) = 0 THEN 0.5 END), 6) AS total FROM t GROUP BY 1""")
def c3(spark, folder):
    rows = table(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    raw = F.expr(_RAW.replace("\n```'", "\\n```'").replace("```json\n", "```json\\n"))
    parsed = rows.select((F.col("event_id") % 9).alias("form"), parsing.confidence(raw).alias("v2"), parsing.confidence(raw, fence=False).alias("v1"))
    return parsed.groupBy("form").agg(F.count("*").alias("n"), F.count("v2").alias("valid_fence"), F.count("v1").alias("valid_plain"), F.round(F.sum("v2"), 6).alias("total"))


@query("c2_parse_answer", r"""WITH r AS (SELECT request_id, min(text) AS text FROM inference_responses WHERE text IS NOT NULL GROUP BY 1), q AS (SELECT request_id, min(stage) AS stage FROM inference_requests GROUP BY 1),
t AS (SELECT r.request_id, regexp_extract(text, '(?s)^.*(\{[^{]*\})([^{}]*)$', 1) AS o, trim(regexp_replace(regexp_extract(text, '(?s)^.*(\{[^{]*\})([^{}]*)$', 2), '\s+', ' ', 'g')) AS rest FROM r JOIN q ON q.request_id = r.request_id WHERE q.stage = 'answer')
SELECT count(*) AS responses, CAST(sum(CASE WHEN rest IN ('', '```') AND json_valid(o) AND json_keys(o) = ['answer'] AND json_type(o, '$.answer') = 'VARCHAR' AND length(json_extract_string(o, '$.answer')) >= 1 THEN 1 ELSE 0 END) AS BIGINT) AS valid FROM t""")
def c2(spark, folder):
    text = table(spark, folder, "inference_responses").filter("text is not null").groupBy("request_id").agg(F.min("text").alias("text"))
    stage = table(spark, folder, "inference_requests").groupBy("request_id").agg(F.min("stage").alias("stage"))
    return text.join(stage, "request_id").filter("stage = 'answer'").agg(F.count("*").alias("responses"), F.count(parsing.answer(F.col("text"))).alias("valid"))


@query("c4_score_answer", r"SELECT count(*) AS n, CAST(sum(CASE WHEN coalesce(lower(regexp_replace(o.parsed_answer, '^\s+|\s+$', '', 'g')) = lower(regexp_replace(i.answer, '^\s+|\s+$', '', 'g')), false) THEN 1 ELSE 0 END) AS BIGINT) AS right_answers FROM (SELECT DISTINCT record_id, dataset_item_id, parsed_answer FROM observations) o JOIN (SELECT item_id, min(answer) AS answer FROM items WHERE answer IS NOT NULL GROUP BY 1) i ON i.item_id = o.dataset_item_id")
def c4(spark, folder):
    given = table(spark, folder, "observations").select("record_id", F.col("dataset_item_id").alias("item_id"), "parsed_answer").distinct()
    key = table(spark, folder, "items").filter("answer is not null").groupBy("item_id").agg(F.min("answer").alias("answer"))
    return given.join(key, "item_id").agg(F.count("*").alias("n"), F.count_if(parsing.exact_match(F.col("parsed_answer"), F.col("answer"))).alias("right_answers"))


@query("c5_stable_ids", f"WITH {_ITEMS} SELECT item_id, sha256(dataset_id || chr(0) || item_id || chr(0) || 'answer') AS id FROM it")
def c5(spark, folder):
    return items(spark, folder).select("item_id", ex.stable_id(F.col("dataset_id"), F.col("item_id"), F.lit("answer")).alias("id"))


@query("c6_c7_sampling_seeds", f"WITH {_ITEMS}, h AS (SELECT item_id, sha256('11' || chr(0) || item_id || chr(0) || 'answer') AS h FROM it) SELECT item_id, CAST('0x' || CAST(CAST('0x' || substr(h, 1, 1) AS INTEGER) % 8 AS VARCHAR) || substr(h, 2, 15) AS BIGINT) AS seed FROM h")
def c6(spark, folder):
    return items(spark, folder).select("item_id", ex.sampling_seed(F.lit(11), F.col("item_id"), F.lit("answer")).alias("seed"))


@query("c8_c9_content_hash", "WITH d AS (SELECT DISTINCT item_id, question FROM items WHERE item_id IS NOT NULL AND question IS NOT NULL) SELECT item_id, sha256(item_id || chr(0) || question) AS id FROM d")
def c8(spark, folder):
    rows = table(spark, folder, "items").filter("item_id is not null and question is not null").select("item_id", "question").distinct()
    return rows.select("item_id", ex.stable_id(F.col("item_id"), F.col("question")).alias("id"))


@query("c10_template", "WITH d AS (SELECT DISTINCT item_id, dataset_id, success_criterion FROM items WHERE item_id IS NOT NULL AND success_criterion IS NOT NULL) SELECT item_id, md5('Item ' || item_id || ' of ' || dataset_id || ': {kept} ' || success_criterion || '.') AS prompt FROM d")
def c10(spark, folder):
    rows = table(spark, folder, "items").filter("item_id is not null and success_criterion is not null").select("item_id", "dataset_id", "success_criterion").distinct()
    filled = parsing.fill_template("Item {item} of {dataset}: {kept} {criterion}.", {"item": F.col("item_id"), "dataset": F.col("dataset_id"), "criterion": F.col("success_criterion")})
    return rows.select("item_id", F.md5(filled).alias("prompt"))


@query("c18_shared_prefix", "WITH p AS (SELECT p_partkey, p_type AS a, lead(p_type) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM part), n AS (SELECT p_partkey, a, b, coalesce(list_min(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1))) - 1, least(length(a), length(b))) AS shared FROM p WHERE b IS NOT NULL) SELECT p_partkey, CAST(shared AS INTEGER) AS shared FROM n")
def c18(spark, folder):
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    rows = table(spark, folder, "part").withColumn("b", F.lead("p_type").over(w)).filter("b is not null")
    return rows.select("p_partkey", parsing.shared_prefix(F.col("p_type"), F.col("b")).alias("shared"))


@query("c20_c21_choices", "WITH o AS (SELECT r_regionkey, list_sort(list(n_name)) AS names FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1) SELECT r_regionkey, array_to_string([chr(CAST(64 + i AS INTEGER)) || '. ' || names[i] for i in range(1, len(names) + 1)], chr(10)) AS choices, names[2] = names[ascii(chr(CAST(65 + r_regionkey AS INTEGER))) - 64] AS consistent FROM o")
def c20(spark, folder):
    names = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    return names.select("r_regionkey", parsing.choices(F.col("names")).alias("choices"), (F.element_at("names", 2) == F.element_at("names", F.ascii(F.char(F.col("r_regionkey") + 65)) - 64)).alias("consistent"))


@query("c22_identifier_parse", r"SELECT regexp_extract(item_id, '^([a-z]+-[a-z]+)-([0-9]+)', 1) AS category, count(DISTINCT item_id) AS items, max(CAST(nullif(regexp_extract(item_id, '^([a-z]+-[a-z]+)-([0-9]+)', 2), '') AS BIGINT)) AS last_number FROM items WHERE regexp_matches(item_id, '^[a-z]+-[a-z]+-[0-9]+') GROUP BY 1")
def c22(spark, folder):
    p = r"^([a-z]+-[a-z]+)-([0-9]+)"
    rows = table(spark, folder, "items").filter(F.col("item_id").rlike(p))
    return rows.groupBy(F.regexp_extract("item_id", p, 1).alias("category")).agg(F.countDistinct("item_id").alias("items"), F.max(F.regexp_extract("item_id", p, 2).cast("bigint")).alias("last_number"))


@query("a1_duplicate_ids", "SELECT item_id, count(*) AS rows FROM items GROUP BY 1 HAVING count(*) > 1")
def a1(spark, folder):
    return audit.duplicates(table(spark, folder, "items"), ["item_id"])


@query("a4_j1_completeness", W + ", e AS (SELECT DISTINCT dataset_id, dataset_item_id AS item_id FROM observations WHERE dataset_item_id IS NOT NULL AND dataset_id IS NOT NULL), f AS (SELECT DISTINCT dataset_id, item_id FROM items WHERE item_id IS NOT NULL) SELECT dataset_id, item_id, 'missing' AS kind FROM (SELECT * FROM f EXCEPT SELECT * FROM e) UNION ALL SELECT dataset_id, item_id, 'unexpected' FROM (SELECT * FROM e EXCEPT SELECT * FROM f)")
def a4(spark, folder):
    found = obs(spark, folder).select("dataset_id", F.col("item").alias("item_id")).filter("item_id is not null and dataset_id is not null")
    return audit.missing_and_unexpected(items(spark, folder), found, ["dataset_id", "item_id"])


@query("a5_condition_from_cell", "WITH q AS (SELECT DISTINCT request_id, 'a-' || condition_id || '--r-' || stage AS cell FROM inference_requests WHERE condition_id IS NOT NULL AND stage IS NOT NULL) SELECT regexp_extract(cell, '^a-(.*?)--r-', 1) AS answer_condition, count(*) AS cells FROM q GROUP BY 1")
def a5(spark, folder):
    q = table(spark, folder, "inference_requests").filter("condition_id is not null and stage is not null").select("request_id", F.concat(F.lit("a-"), "condition_id", F.lit("--r-"), "stage").alias("cell")).distinct()
    return q.groupBy(F.regexp_extract("cell", "^a-(.*?)--r-", 1).alias("answer_condition")).agg(F.count("*").alias("cells"))


@query("a7_identity_mismatches", """WITH o AS (SELECT DISTINCT dataset_item_id AS item_id, dataset_id, dataset_partition AS partition FROM observations WHERE dataset_item_id IS NOT NULL), i AS (SELECT item_id, min(dataset_id) AS dataset_id, min(partition) AS partition FROM items GROUP BY 1)
SELECT o.item_id, concat_ws(',', CASE WHEN o.dataset_id IS DISTINCT FROM i.dataset_id THEN 'dataset_id' END, CASE WHEN o.partition IS DISTINCT FROM i.partition THEN 'partition' END) AS fields FROM o JOIN i ON i.item_id = o.item_id WHERE o.dataset_id IS DISTINCT FROM i.dataset_id OR o.partition IS DISTINCT FROM i.partition""")
def a7(spark, folder):
    o = obs(spark, folder).select(F.col("item").alias("item_id"), "dataset_id", F.col("part").alias("partition")).filter("item_id is not null").distinct()
    i = table(spark, folder, "items").groupBy("item_id").agg(F.min("dataset_id").alias("dataset_id"), F.min("partition").alias("partition"))
    return audit.mismatches(o, i, ["item_id"], ["dataset_id", "partition"])


@query("a10_republication", "WITH a AS (SELECT run_id, count(*) AS n FROM observations GROUP BY 1), b AS (SELECT run_id, count(DISTINCT record_id) AS n FROM observations GROUP BY 1) SELECT *, 'stored' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'recomputed' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def a10(spark, folder):
    rows = table(spark, folder, "observations")
    return audit.republish_difference(rows.groupBy("run_id").agg(F.count("*").alias("n")), rows.groupBy("run_id").agg(F.countDistinct("record_id").alias("n")))


@query("e1_unscored", "SELECT scoring_status, count(DISTINCT record_id) AS records FROM observations WHERE correct IS NULL OR scoring_status <> 'scored' GROUP BY 1")
def e1(spark, folder):
    return table(spark, folder, "observations").filter("correct is null or scoring_status <> 'scored'").groupBy("scoring_status").agg(F.countDistinct("record_id").alias("records"))


@query("e2_strict_pairs", W + f"SELECT coalesce(r.run_id, s.run_id) AS run_id, {SUM('s.item IS NULL')} AS only_reference, {SUM('r.item IS NULL')} AS only_shifted FROM (SELECT * FROM cell WHERE cond = 'reference') r FULL JOIN (SELECT * FROM cell WHERE cond = 'high-temperature') s ON r.run_id = s.run_id AND r.item = s.item AND r.seed = s.seed GROUP BY 1")
def e2(spark, folder):
    c = cell(spark, folder).select("run_id", "item", "seed", "cond")
    r = c.filter(F.col("cond") == REFERENCE).drop("cond").withColumn("r", F.lit(1))
    s = c.filter(F.col("cond") == HOT).drop("cond").withColumn("s", F.lit(1))
    return r.join(s, ["run_id", "item", "seed"], "full").groupBy("run_id").agg(F.count_if(F.col("s").isNull()).alias("only_reference"), F.count_if(F.col("r").isNull()).alias("only_shifted"))


@query("e3_item_intersection", W + "SELECT run_id, count(*) AS items FROM (SELECT run_id, item FROM cell WHERE cond = 'reference' INTERSECT SELECT run_id, item FROM cell WHERE cond = 'low-top-p') GROUP BY 1")
def e3(spark, folder):
    c = cell(spark, folder)
    both = c.filter(F.col("cond") == REFERENCE).select("run_id", "item").intersect(c.filter(F.col("cond") == NARROW).select("run_id", "item"))
    return both.groupBy("run_id").agg(F.count("*").alias("items"))


@query("e4_cluster_sets", W + "SELECT run_id, cluster FROM done GROUP BY ALL HAVING bool_or(cond = 'reference') <> bool_or(cond = 'high-temperature')")
def e4(spark, folder):
    agg = done(spark, folder).groupBy("run_id", "cluster").agg(F.bool_or(F.col("cond") == REFERENCE).alias("r"), F.bool_or(F.col("cond") == HOT).alias("s"))
    return agg.filter("r != s").select("run_id", "cluster")


_AT = {"r": REFERENCE, "h": HOT, "n": NARROW}
_E6 = ", ".join(f"max(CASE WHEN cond = '{c}' THEN {e} END) AS {n}_{k}" for n, c in _AT.items() for k, e in (("ans", "CASE WHEN a THEN ans END"), ("conf", "CASE WHEN c THEN conf END")))


@query("e5_e6_pivot", W + f"""SELECT run_id, item, seed, {', '.join(f"max(CASE WHEN cond = '{c}' THEN CASE WHEN y THEN 1 ELSE 0 END ELSE -1 END) AS {n}" for n, c in _AT.items())} FROM cell GROUP BY ALL""")
def e5(spark, folder):
    at = lambda c: F.max(F.when(F.col("cond") == c, F.col("y").cast("int")).otherwise(-1))
    return cell(spark, folder).groupBy("run_id", "item", "seed").agg(*[at(c).alias(n) for n, c in _AT.items()])


@query("e6_changed_given_identical", W + f""", p AS (SELECT run_id, item, seed, {_E6} FROM cell GROUP BY ALL) SELECT run_id, {SUM("r_ans = h_ans")} AS identical_hot, {SUM("r_ans = h_ans AND r_conf IS DISTINCT FROM h_conf")} AS changed_hot,
{SUM("r_ans = n_ans")} AS identical_narrow, {SUM("r_ans = n_ans AND r_conf IS DISTINCT FROM n_conf")} AS changed_narrow FROM p GROUP BY run_id""")
def e6(spark, folder):
    """Per run: (item, seed) cells whose valid answer is the same as under the reference, and those of them whose confidence is another."""
    at = lambda c, v, ok: F.max(F.when((F.col("cond") == c) & F.col(ok), F.col(v)))
    wide = cell(spark, folder).groupBy("run_id", "item", "seed").agg(*[x for n, c in _AT.items() for x in (at(c, "ans", "a").alias(f"{n}_ans"), at(c, "conf", "c").alias(f"{n}_conf"))])
    out = []
    for n, label in (("h", "hot"), ("n", "narrow")):
        same = F.col("r_ans") == F.col(f"{n}_ans")
        out += [F.count_if(same).alias(f"identical_{label}"), F.count_if(same & ~F.col("r_conf").eqNullSafe(F.col(f"{n}_conf"))).alias(f"changed_{label}")]
    return wide.groupBy("run_id").agg(*out)


@query("e7_thresholds_by_run", W + "SELECT t.run_id, t.model_id, t.dataset_id, count(o.record_id) AS records FROM calibration_thresholds t LEFT JOIN obs o ON o.run_id = t.run_id GROUP BY ALL")
def e7(spark, folder):
    per = obs(spark, folder).groupBy("run_id").agg(F.count("*").alias("k"))
    t = table(spark, folder, "calibration_thresholds").select("run_id", "model_id", "dataset_id")
    return t.join(per, "run_id", "left").select("run_id", "model_id", "dataset_id", F.coalesce("k", F.lit(0)).alias("records"))


@query("e8_parent_lineage", "WITH q AS (SELECT DISTINCT request_id, stage, parent_request_id, dataset_item_id FROM inference_requests) SELECT c.request_id, CASE WHEN p.request_id IS NULL THEN 'no parent' WHEN p.stage <> 'answer' THEN 'parent stage' WHEN p.dataset_item_id IS DISTINCT FROM c.dataset_item_id THEN 'parent item' END AS fault FROM q c LEFT JOIN q p ON p.request_id = c.parent_request_id WHERE c.stage = 'confidence' AND (p.request_id IS NULL OR p.stage <> 'answer' OR p.dataset_item_id IS DISTINCT FROM c.dataset_item_id)")
def e8(spark, folder):
    q = table(spark, folder, "inference_requests").select("request_id", "stage", "parent_request_id", "dataset_item_id").distinct()
    p = q.select(F.col("request_id").alias("parent_request_id"), F.col("stage").alias("ps"), F.col("dataset_item_id").alias("pi"), F.lit(1).alias("hit"))
    fault = F.when(F.col("hit").isNull(), "no parent").when(F.col("ps") != "answer", "parent stage").when(~F.col("pi").eqNullSafe(F.col("dataset_item_id")), "parent item")
    return q.filter("stage = 'confidence'").join(p, "parent_request_id", "left").select("request_id", fault.alias("fault")).filter("fault is not null")


@query("e9_j4_leftovers", "SELECT coalesce(s.dataset_id, t.dataset_id) AS dataset_id, CASE WHEN s.dataset_id IS NULL THEN 'only thresholds' WHEN t.dataset_id IS NULL THEN 'only targets' ELSE 'both' END AS side FROM split_targets s FULL JOIN (SELECT DISTINCT dataset_id FROM calibration_thresholds) t ON t.dataset_id = s.dataset_id")
def e9(spark, folder):
    s = table(spark, folder, "split_targets").select("dataset_id", F.lit(1).alias("s"))
    t = table(spark, folder, "calibration_thresholds").select("dataset_id").distinct().withColumn("t", F.lit(1))
    return s.join(t, "dataset_id", "full").select("dataset_id", F.when(F.col("s").isNull(), "only thresholds").when(F.col("t").isNull(), "only targets").otherwise("both").alias("side"))


@query("e10_f24_batch_invariance", W + "SELECT r.run_id, count(*) AS shared, CAST(sum(CASE WHEN r.conf IS NOT DISTINCT FROM s.conf THEN 1 ELSE 0 END) AS BIGINT) AS same_confidence, round(sum(CASE WHEN r.conf IS NOT DISTINCT FROM s.conf THEN 1 ELSE 0 END) / count(*), 8) AS same_share FROM cell r JOIN cell s ON r.run_id = s.run_id AND r.item = s.item AND r.seed = s.seed WHERE r.cond = 'reference' AND s.cond = 'low-top-p' GROUP BY 1")
def e10(spark, folder):
    key = ["run_id", "item", "seed"]
    c = cell(spark, folder)
    both = c.filter(F.col("cond") == REFERENCE).select(*key, F.col("conf").alias("x")).join(c.filter(F.col("cond") == NARROW).select(*key, F.col("conf").alias("y")), key)
    same = F.count_if(F.col("x").eqNullSafe(F.col("y")))
    return both.groupBy("run_id").agg(F.count("*").alias("shared"), same.alias("same_confidence"), F.round(same / F.count("*"), 8).alias("same_share"))


@query("e11_e12_fan_out", "WITH t AS (SELECT request_id, min(text) AS text FROM inference_responses WHERE text IS NOT NULL GROUP BY 1), d AS (SELECT text, length(text) AS score FROM (SELECT DISTINCT text FROM t)) SELECT t.request_id, CAST(d.score AS INTEGER) AS score FROM t JOIN d ON d.text = t.text")
def e12(spark, folder):
    t = table(spark, folder, "inference_responses").filter("text is not null").groupBy("request_id").agg(F.min("text").alias("text")).withColumn("h", F.sha2("text", 256))
    scores = t.dropDuplicates(["h"]).select("h", F.length("text").alias("score"))  # every distinct answer is scored once
    return t.join(scores, "h").select("request_id", "score")


@query("e13_moderators", W + ", e AS (SELECT run_id, avg(CASE WHEN y THEN 1.0 ELSE 0.0 END) AS acc FROM done GROUP BY 1) SELECT t.model_id, t.model_mode, count(*) AS runs, round(avg(e.acc), 8) AS mean_accuracy FROM e JOIN calibration_thresholds t ON t.run_id = e.run_id GROUP BY ALL")
def e13(spark, folder):
    acc = done(spark, folder).groupBy("run_id").agg(F.avg(F.col("y").cast("double")).alias("acc"))
    t = table(spark, folder, "calibration_thresholds").select("run_id", "model_id", "model_mode")
    return acc.join(t, "run_id").groupBy("model_id", "model_mode").agg(F.count("*").alias("runs"), F.round(F.avg("acc"), 8).alias("mean_accuracy"))


@query("f18_integrity_rollup", "WITH r AS (SELECT request_id, min(finish_reason) AS finish_reason, max(completion_tokens) AS tokens FROM inference_responses GROUP BY 1), q AS (SELECT request_id, min(stage) AS stage FROM inference_requests GROUP BY 1) SELECT q.stage, coalesce(r.finish_reason, '(none)') AS finish_reason, count(*) AS n, max(r.tokens) AS max_tokens FROM r JOIN q ON q.request_id = r.request_id GROUP BY ALL")
def f18(spark, folder):
    r = table(spark, folder, "inference_responses").groupBy("request_id").agg(F.min("finish_reason").alias("finish_reason"), F.max("completion_tokens").alias("tokens"))
    q = table(spark, folder, "inference_requests").groupBy("request_id").agg(F.min("stage").alias("stage"))
    return r.join(q, "request_id").groupBy("stage", F.coalesce("finish_reason", F.lit("(none)")).alias("finish_reason")).agg(F.count("*").alias("n"), F.max("tokens").alias("max_tokens"))


@query("f19_status_conflicts", "SELECT request_id, count(DISTINCT status) AS kinds FROM parse_outcomes GROUP BY 1 HAVING count(DISTINCT status) > 1")
def f19(spark, folder):
    return audit.conflicts(table(spark, folder, "parse_outcomes"), ["request_id"], "status")


@query("f20_condition_summaries", "WITH q AS (SELECT DISTINCT request_id, stage, condition_id FROM inference_requests), p AS (SELECT request_id, max(CASE WHEN status = 'valid' THEN 1 ELSE 0 END) AS ok FROM parse_outcomes GROUP BY 1) SELECT q.condition_id, q.stage, count(*) AS episodes, round(avg(CAST(p.ok AS DOUBLE)), 8) AS valid_rate FROM q JOIN p ON p.request_id = q.request_id GROUP BY ALL")
def f20(spark, folder):
    q = table(spark, folder, "inference_requests").select("request_id", "stage", "condition_id").distinct()
    p = table(spark, folder, "parse_outcomes").groupBy("request_id").agg(F.max((F.coalesce(F.col("status") == "valid", F.lit(False))).cast("int")).alias("ok"))
    return q.join(p, "request_id").groupBy("condition_id", "stage").agg(F.count("*").alias("episodes"), F.round(F.avg(F.col("ok").cast("double")), 8).alias("valid_rate"))


_BUDGETS = "WITH t AS (SELECT request_id, max(completion_tokens) AS v FROM inference_responses WHERE completion_tokens IS NOT NULL GROUP BY 1), o AS (SELECT v, row_number() OVER (ORDER BY v, request_id) - 1 AS k, count(*) OVER () AS n FROM t) SELECT b AS budget, count(*) AS n, CAST(sum(CASE WHEN v > b THEN 1 ELSE 0 END) AS BIGINT) AS exceeding, max(CASE WHEN k = n // 2 THEN v END) AS median, max(CASE WHEN k = least(n - 1, CAST(floor(0.99 * n) AS BIGINT)) THEN v END) AS p99 FROM o, unnest([64, 128, 192, 256]) u(b) GROUP BY b"


@query("f23_budget_audit", _BUDGETS)
def f23(spark, folder):
    """Order statistics come from token counts (few distinct values), not from a sort of all rows."""
    t = table(spark, folder, "inference_responses").filter("completion_tokens is not null").groupBy("request_id").agg(F.max("completion_tokens").alias("v"))
    atom = t.groupBy("v").agg(F.count("*").alias("c"))
    up = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)  # one row per distinct count
    walked = atom.withColumn("hi", F.sum("c").over(up)).withColumn("n", F.sum("c").over(Window.partitionBy(F.lit(1))))
    at = lambda k: F.max(F.when((F.col("hi") > k) & (F.col("hi") - F.col("c") <= k), F.col("v")))
    spread = walked.withColumn("budget", F.explode(F.array(*[F.lit(b) for b in (64, 128, 192, 256)])))
    return spread.groupBy("budget").agg(F.max("n").alias("n"), F.sum(F.when(F.col("v") > F.col("budget"), F.col("c")).otherwise(0)).alias("exceeding"), at(F.floor(F.col("n") / 2)).alias("median"), at(F.least(F.col("n") - 1, F.floor(F.col("n") * 0.99))).alias("p99"))


@query("f23_budget_bounds", f"WITH bu AS ({_BUDGETS}), be AS (SELECT budget, n, exceeding AS e FROM bu), {bound_sql('be', 'budget')} SELECT u.*, round(d.upper, 6) AS upper FROM bu u LEFT JOIN bd d ON d.budget = u.budget")
def f23b(spark, folder):
    return with_upper_bound(f23(spark, folder), "exceeding", "n")


@query("f25_cell_qualification", "WITH r AS (SELECT request_id, bool_or(coalesce(finish_reason = 'length', false)) AS cut FROM inference_responses GROUP BY 1), q AS (SELECT DISTINCT request_id, stage, condition_id FROM inference_requests), g AS (SELECT condition_id, stage, count(*) AS n, count(r.request_id) AS found, avg(CASE WHEN r.cut THEN 1.0 ELSE 0.0 END) AS rate FROM q LEFT JOIN r ON r.request_id = q.request_id GROUP BY ALL) SELECT condition_id, stage, n, concat_ws('; ', CASE WHEN found < n THEN 'responses missing' END, CASE WHEN rate > 0.03 THEN 'too many cut at length' END) AS reasons, CASE WHEN found < n OR rate > 0.03 THEN 'unsupported' ELSE 'supported' END AS status FROM g")
def f25(spark, folder):
    r = table(spark, folder, "inference_responses").groupBy("request_id").agg(F.bool_or(F.coalesce(F.col("finish_reason") == "length", F.lit(False))).alias("cut"))
    q = table(spark, folder, "inference_requests").select("request_id", "stage", "condition_id").distinct()
    agg = q.join(r, "request_id", "left").groupBy("condition_id", "stage").agg(F.count("*").alias("n"), F.count("cut").alias("found"), F.avg(F.coalesce("cut", F.lit(False)).cast("double")).alias("rate"))
    gap, long = F.col("found") < F.col("n"), F.col("rate") > 0.03
    return agg.select("condition_id", "stage", "n", F.concat_ws("; ", F.when(gap, "responses missing"), F.when(long, "too many cut at length")).alias("reasons"), F.when(gap | long, "unsupported").otherwise("supported").alias("status"))


@query("j2_items_in_all_seeds", W + "SELECT run_id, item FROM cell WHERE cond = 'reference' GROUP BY ALL HAVING count(DISTINCT seed) = (SELECT count(DISTINCT seed) FROM cell)")
def j2(spark, folder):
    c = cell(spark, folder)
    all_seeds = c.agg(F.countDistinct("seed").alias("s"))  # one row
    per = c.filter(F.col("cond") == REFERENCE).groupBy("run_id", "item").agg(F.countDistinct("seed").alias("k"))
    return per.join(F.broadcast(all_seeds), F.col("k") == F.col("s")).select("run_id", "item")


@query("j3_union_of_roles", "SELECT run_id, array_to_string(list_sort(list(DISTINCT condition_id) FILTER (condition_id IS NOT NULL)), ',') AS conditions FROM observations GROUP BY 1")
def j3(spark, folder):
    return table(spark, folder, "observations").groupBy("run_id").agg(F.array_join(F.sort_array(F.collect_set("condition_id")), ",").alias("conditions"))


@query("j5_planned_minus_observed", W + "SELECT r.run_id, c.cond, CAST(s.seed AS BIGINT) AS seed FROM (SELECT DISTINCT run_id FROM obs WHERE run_id IS NOT NULL) r, unnest(['reference', 'high-temperature', 'low-top-p']) c(cond), unnest([11, 23, 47, 99]) s(seed) EXCEPT SELECT DISTINCT run_id, cond, seed FROM obs")
def j5(spark, folder):
    o = obs(spark, folder)
    plan = o.filter("run_id is not null").select("run_id").distinct().withColumn("cond", F.explode(F.array(*[F.lit(c) for c in (REFERENCE, HOT, NARROW)]))).withColumn("seed", F.explode(F.array(*[F.lit(s).cast("bigint") for s in (11, 23, 47, 99)])))
    return plan.subtract(o.select("run_id", "cond", "seed"))


@query("k1_k2_ranked_picks", W + "SELECT run_id, item FROM (SELECT run_id, item, row_number() OVER (PARTITION BY run_id ORDER BY conf DESC, item DESC) AS k FROM done WHERE c AND item IS NOT NULL) WHERE k = 1")
def k2(spark, folder):
    """The item of the highest confidence of each run, the last by name on a tie: one partial aggregate instead of a sort."""
    return done(spark, folder).filter("c and item is not null").groupBy("run_id").agg(F.max_by("item", F.struct("conf", "item")).alias("item"))


@query("k4_stable_order", f"WITH {_ITEMS} SELECT dataset_id, item_id, row_number() OVER (PARTITION BY dataset_id ORDER BY item_id) AS position FROM it")
def k4(spark, folder):
    return range_rank(items(spark, folder), ["dataset_id"], ["item_id"], "position")


@query("n1_n2_policy_decisions", "SELECT run_id, coalesce(status, '(none)') AS status, CASE WHEN status IS NULL OR threshold IS NULL THEN 'pending' WHEN reference_coverage >= minimum_coverage THEN 'open' ELSE 'closed' END AS decision FROM calibration_thresholds")
def n1(spark, folder):
    t = table(spark, folder, "calibration_thresholds")
    return t.select("run_id", F.coalesce("status", F.lit("(none)")).alias("status"), F.when(F.col("status").isNull() | F.col("threshold").isNull(), "pending").when(F.col("reference_coverage") >= F.col("minimum_coverage"), "open").otherwise("closed").alias("decision"))


@query("n5_stage_digest", "WITH r AS (SELECT request_id, min(sha256(text)) AS h FROM inference_responses WHERE text IS NOT NULL GROUP BY 1), q AS (SELECT request_id, min(stage) AS stage, min(run_id) AS run_id FROM inference_requests GROUP BY 1), e AS (SELECT q.run_id, q.stage, r.request_id || chr(0) || r.h AS line FROM r JOIN q ON q.request_id = r.request_id) SELECT run_id, stage, count(*) AS files, sha256(array_to_string(list_sort(list(line)), chr(10))) AS digest FROM e WHERE run_id IS NOT NULL GROUP BY ALL")
def n5(spark, folder):
    """A digest per run and stage. The sorted list of names and hashes of one run is needed in whole by definition of the digest."""
    r = table(spark, folder, "inference_responses").filter("text is not null").groupBy("request_id").agg(F.min(F.sha2("text", 256)).alias("h"))
    q = table(spark, folder, "inference_requests").groupBy("request_id").agg(F.min("stage").alias("stage"), F.min("run_id").alias("run_id"))
    lines = r.join(q, "request_id").filter("run_id is not null").withColumn("line", F.concat("request_id", F.lit("\0"), "h"))
    return lines.groupBy("run_id", "stage").agg(F.count("*").alias("files"), F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n"), 256).alias("digest"))


@query("a9_canonical_json", "SELECT n_nationkey, '{\"name\":\"' || n_name || '\",\"region\":' || CAST(n_regionkey AS VARCHAR) || '}' AS canonical FROM nation")
def a9(spark, folder):
    return table(spark, folder, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), {"ignoreNullFields": "false"}).alias("canonical"))

"""Queries of scans, sources and sinks (S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.sources import files, jsonio, rdfxml, turtle

from .registry import query

META = "id, name, domain_shortname, template_id, stage, is_draft, concept_bits, trace_concept_bits, violation_bits, law_bits, integral_complexity, solution_steps, used_count, origin"


@query("S1", f"SELECT {META} FROM v_questions_meta")
def scan_metadata(v):
    return v("questions_meta")


@query("S2", "SELECT subject, verb, object FROM v_facts")
def read_turtle(v):
    """Facts written as Turtle lines and parsed again."""
    return turtle.parsed(turtle.lines(v("facts")).select("value"))


@query("S3", "SELECT ':' || subject || ' :' || verb || ' ' || CASE WHEN object_type = 'rdf:resource' THEN ':' || object WHEN object_type = 'xsd:int' THEN object ELSE '\"' || object || '\"' END || ' .' AS value FROM v_facts")
def write_turtle(v):
    return turtle.lines(v("facts")).select("value")


@query("S4", "SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS subject, 'type' AS verb, 'Region' AS object FROM region UNION ALL SELECT 'r' || CAST(r_regionkey AS VARCHAR), 'label', r_name FROM region UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'in_region', 'r' || CAST(n_regionkey AS VARCHAR) FROM nation")
def read_rdf_xml(v):
    """RDF/XML documents, one a region, with its nations as plain descriptions."""
    head = F.lit('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://bank.invalid/#">')
    nation = F.concat(F.lit('<rdf:Description rdf:about="#n'), F.col("n_nationkey").cast("string"), F.lit('"><in_region rdf:resource="#r'), F.col("n_regionkey").cast("string"), F.lit('"/></rdf:Description>'))
    nations = v("nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_join(F.array_sort(F.collect_list(nation)), "").alias("nations"))
    region = F.concat(F.lit('<Region rdf:about="#r'), F.col("r_regionkey").cast("string"), F.lit('"><label>'), F.col("r_name"), F.lit("</label></Region>"))
    return rdfxml.parsed(v("region").join(nations, "r_regionkey", "left").select(F.concat(head, region, F.coalesce("nations", F.lit("")), F.lit("</rdf:RDF>")).alias("value")))


@query("S5", "SELECT DISTINCT subject, verb, object FROM v_facts WHERE verb IN ('in_nation', 'in_region') UNION SELECT 'extra', 'label', 'merged'")
def merged_graphs(v):
    extra = v.rows("subject string, verb string, object string", ("extra", "label", "merged"))
    return turtle.parsed(turtle.lines(v("facts").where("verb in ('in_nation', 'in_region')")).select("value")).unionByName(extra).distinct()


@query("S6", """WITH RECURSIVE r(algo_id, node, class, path) AS (SELECT algo_id, node, class, [node] FROM v_nodes WHERE parent IS NULL
  UNION ALL SELECT n.algo_id, n.node, n.class, list_append(r.path, n.node) FROM v_nodes n JOIN r ON n.algo_id = r.algo_id AND n.parent = r.node),
 l AS (SELECT algo_id, node, class, path, len(path) AS lv, LEAD(len(path)) OVER (PARTITION BY algo_id ORDER BY path) AS nl FROM r)
 SELECT algo_id, CAST(COUNT(*) AS BIGINT) AS nodes, STRING_AGG('{"node":' || CAST(node AS VARCHAR) || ',"class":"' || class || '","children":['
  || CASE WHEN nl > lv THEN '' ELSE repeat(']}', lv - coalesce(nl, 1) + 1) || CASE WHEN nl IS NULL THEN '' ELSE ',' END END, '' ORDER BY path) AS tree FROM l GROUP BY algo_id""")
def graph_to_json(v):
    """Each program's whole tree as nested JSON."""
    return jsonio.nested(v("nodes"), "algo_id")


@query("S7", "SELECT id, CASE WHEN id % 2 = 0 THEN 'MATCHING' ELSE 'ORDER' END AS kind, CAST(solution_steps AS BIGINT) AS steps FROM v_questions_meta")
def read_question_json(v):
    q = v("questions_meta").select(F.to_json(F.struct("id", F.when(F.col("id") % 2 == 0, "MATCHING").otherwise("ORDER").alias("questionType"), F.col("solution_steps").alias("steps"))).alias("value"))
    return jsonio.questions(q)


@query("S8", """SELECT '{"id":' || CAST(id AS VARCHAR) || ',"name":"' || name || '","steps":' || CAST(solution_steps AS VARCHAR) || '}' AS value FROM v_questions_meta""")
def write_question_json(v):
    return v("questions_meta").select(F.to_json(F.struct("id", "name", F.col("solution_steps").alias("steps"))).alias("value"))


@query("S9", "SELECT name, positive FROM v_laws UNION ALL SELECT 'error_' || class AS name, 0 AS positive FROM (SELECT DISTINCT class FROM v_nodes) t")
def laws_with_errors(v):
    laws = v("laws").select("name", F.col("positive").cast("bigint").alias("positive"))
    return laws.unionByName(v("nodes").select(F.concat(F.lit("error_"), "class").alias("name"), F.lit(0).cast("bigint").alias("positive")).distinct())


@query("S10", "SELECT * FROM (VALUES ('q1', 'yes', 1, 'q2', true), ('q1', 'no', 1, 'q3', false), ('q2', 'left', 1, CAST(NULL AS VARCHAR), true), ('q2', 'left', 2, 'q1', false)) t(question, answer, ord, next_question, correct)")
def transitions(v):
    text = '{"q1": {"yes": [{"next": "q2", "correct": true}], "no": [{"next": "q3", "correct": false}]}, "q2": {"left": [{"next": null, "correct": true}, {"next": "q1", "correct": false}]}}'
    return jsonio.transitions(v.rows("value string", (text,)))


@query("S11", "SELECT * FROM (VALUES ('+', 2, 6, 'L'), ('*', 2, 5, 'L'), ('=', 2, 16, 'R'), ('<', 2, 9, 'L'), ('&&', 2, 14, 'L'), ('-', 2, 6, 'L')) t(text, arity, precedence, associativity)")
def operator_table(v):
    return jsonio.operators(v.spark)


@query("S12", "SELECT id, name, file_size FROM v_templates WHERE file_size BETWEEN 3072 AND 40960 ORDER BY name LIMIT 25 OFFSET 5")
def templates_by_size(v):
    return files.sized(v("templates"), "file_size", 3072, 40960, skip=5, most=25, order="name").select("id", "name", "file_size")


@query("S13")
def found_files(v):
    """Files of an extension anywhere below the data folder, by name and length; no SQL, as DuckDB is not told
    the folder."""
    return files.listed(v.spark, v.dir, "*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


@query("S14", """SELECT name, hash, MIN(id) AS id FROM (SELECT p_partkey AS id, p_name AS name, p_size AS hash FROM part WHERE p_size <= 40) t
 WHERE id % 3 = 0 GROUP BY name, hash""")
def collected_results(v):
    """Of files with a log, the first of each name and hash up to a size."""
    part = v("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("hash"))
    logs = v("part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"))
    return files.first_of_each(part.where("hash <= 40").join(logs, "id", "left_semi"), ["name", "hash"], "id").select("name", "hash", "id")


@query("S15", "SELECT id - id % 64 AS archive_id, name || '.c' AS name, code AS content FROM (SELECT t.id, t.name, s.code FROM v_templates t JOIN v_sources s ON s.id = t.id) x")
def zipped_sources(v):
    """Sources of templates put into zip files of at most 64, and read back out of them."""
    rows = v("templates").join(v("sources"), "id").select((F.col("id") - F.col("id") % 64).alias("archive_id"), F.concat("name", F.lit(".c")).alias("name"), F.encode("code", "UTF-8").alias("content"))
    return files.unzipped(files.zipped(rows, "archive_id"), "archive_id").select("archive_id", "name", F.decode("content", "UTF-8").alias("content"))


@query("S16", "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS stars FROM supplier WHERE s_acctbal BETWEEN 50 AND 100000 AND s_nationkey % 2 = 0 ORDER BY s_acctbal DESC, s_suppkey LIMIT 10")
def repositories(v):
    r = v("supplier").where("s_acctbal between 50 and 100000 and s_nationkey % 2 = 0")
    return r.orderBy(F.desc("s_acctbal"), "s_suppkey").limit(10).select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("stars"))


@query("S17", "SELECT name, MAX(id) AS id, ROUND(MAX(integral_complexity), 5) AS complexity FROM v_questions_meta WHERE integral_complexity <= 0.9 GROUP BY name")
def exported_rows(v):
    q = v("questions_meta").where("integral_complexity <= 0.9")
    return q.groupBy("name").agg(F.max("id").alias("id"), F.round(F.max("integral_complexity"), 5).alias("complexity"))


@query("S18", "SELECT child AS concept, MIN(parent) AS base, CAST(COUNT(*) AS BIGINT) AS bases FROM v_concept_edges WHERE child % 4 <> 0 GROUP BY child")
def flagged_concepts(v):
    return v("concept_edges").where("child % 4 <> 0").groupBy(F.col("child").alias("concept")).agg(F.min("parent").alias("base"), F.count("*").alias("bases"))


@query("S19", "SELECT stage, CAST(COUNT(*) AS BIGINT) AS n FROM v_questions_meta GROUP BY stage")
def snapshot(v):
    return v("questions_meta").groupBy("stage").agg(F.count("*").alias("n"))


@query("S20", "SELECT CAST(SUM(file_size) AS BIGINT) AS bytes, CAST(COUNT(*) AS BIGINT) AS files FROM v_templates")
def directory_size(v):
    return v("templates").agg(F.sum("file_size").alias("bytes"), F.count("*").alias("files"))


@query("S21", "SELECT 't_' || CAST(id AS VARCHAR) AS name, UNNEST(STRING_SPLIT(CASE WHEN id % 2 = 0 THEN 'loop if' ELSE 'seq' END, ' ')) AS concept FROM v_templates")
def task_list(v):
    lines = v("templates").select(F.concat_ws("\t", F.concat(F.lit("t_"), "id"), F.when(F.col("id") % 2 == 0, "loop if").otherwise("seq")).alias("value"))
    return files.task_list(lines)


@query("S23", "SELECT batch, CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT CAST(FLOOR((ROW_NUMBER() OVER (ORDER BY subject, verb, object) - 1) / 400) AS BIGINT) AS batch FROM (SELECT DISTINCT subject, verb, object FROM v_facts) d) t GROUP BY batch")
def upload_batches(v):
    return files.batched(v("facts").select("subject", "verb", "object").distinct(), ["subject", "verb", "object"], 400).groupBy("batch").agg(F.count("*").alias("n"))

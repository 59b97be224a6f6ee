"""Queries of aggregations (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import query


@query("A1", "SELECT CAST(COUNT(*) AS BIGINT) AS n, COALESCE(MIN(integral_complexity), 0.0) AS low, COALESCE(ROUND(AVG(integral_complexity), 6), 0.5) AS mean, COALESCE(MAX(integral_complexity), 1.0) AS high FROM v_questions_meta WHERE domain_shortname = 'ctrl_flow' AND stage = 3 AND is_draft = 0")
def bank_statistics(v):
    c = F.col("integral_complexity")
    q = v("questions_meta").where("domain_shortname = 'ctrl_flow' and stage = 3 and is_draft = 0")
    return q.agg(F.count("*").alias("n"), F.coalesce(F.min(c), F.lit(0.0)).alias("low"), F.coalesce(F.round(F.avg(c), 6), F.lit(0.5)).alias("mean"), F.coalesce(F.max(c), F.lit(1.0)).alias("high"))


@query("A2", "SELECT CAST(COUNT(*) AS BIGINT) AS n FROM v_questions_meta WHERE domain_shortname = 'ctrl_flow' AND stage = 3 AND solution_steps BETWEEN 3 AND 20 AND (concept_bits & 16) = 0 AND (violation_bits & 131) <> 0 AND template_id NOT IN (3)")
def matching_count(v):
    q = v("questions_meta").where("domain_shortname = 'ctrl_flow' and stage = 3 and solution_steps between 3 and 20 and (concept_bits & 16) = 0 and (violation_bits & 131) <> 0 and template_id <> 3")
    return q.agg(F.count("*").alias("n"))


@query("A3", "SELECT concept_bits, CAST(COUNT(*) AS BIGINT) AS n FROM v_questions_meta GROUP BY concept_bits")
def mask_histogram(v):
    return v("questions_meta").groupBy("concept_bits").agg(F.count("*").alias("n"))


@query("A4", "SELECT CAST(COUNT(*) AS BIGINT) AS total, CAST(SUM(CASE WHEN concept_bits IN (1, 3, 7) THEN 1 ELSE 0 END) AS BIGINT) AS chosen FROM v_questions_meta")
def histogram_total(v):
    h = mask_histogram(v)
    return h.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("concept_bits").isin(1, 3, 7), F.col("n")).otherwise(0)).alias("chosen"))


@query("A5", "SELECT template_id, COALESCE(CAST(bit_or(violation_bits) AS BIGINT), 0) AS bits FROM v_questions_meta GROUP BY template_id")
def or_of_masks(v):
    return v("questions_meta").groupBy("template_id").agg(F.coalesce(F.bit_or("violation_bits"), F.lit(0)).alias("bits"))


@query("A6", "SELECT domain_shortname, CAST(COUNT(*) AS BIGINT) AS n, MIN(solution_steps) AS low, MAX(solution_steps) AS high, ROUND(AVG(solution_steps), 6) AS mean, CAST(COUNT(DISTINCT solution_steps) AS BIGINT) AS kinds FROM v_questions_meta GROUP BY domain_shortname")
def numeric_statistic(v):
    s = F.col("solution_steps")
    return v("questions_meta").groupBy("domain_shortname").agg(F.count("*").alias("n"), F.min(s).alias("low"), F.max(s).alias("high"), F.round(F.avg(s), 6).alias("mean"), F.count_distinct(s).alias("kinds"))


@query("A7", "SELECT DISTINCT origin FROM v_questions_meta WHERE domain_shortname = 'expression'")
def origins(v):
    return v("questions_meta").where("domain_shortname = 'expression'").select("origin").distinct()


@query("A8", """WITH last_grade AS (SELECT attempt_id, question_id, grade FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY question_id ORDER BY order_number DESC) AS n FROM v_interactions) t WHERE n = 1)
 SELECT i.attempt_id, CAST(COUNT(DISTINCT i.question_id) AS BIGINT) AS questions, CAST(COUNT(*) AS BIGINT) AS interactions, CAST(SUM(CASE WHEN violations_count > 0 THEN 1 ELSE 0 END) AS BIGINT) AS wrong,
 (SELECT ROUND(AVG(g.grade), 6) FROM last_grade g WHERE g.attempt_id = i.attempt_id) AS grade FROM v_interactions i GROUP BY i.attempt_id""")
def attempt_statistics(v):
    by_question = v("interactions").groupBy("attempt_id", "question_id").agg(F.count("*").alias("n"), F.count_if(F.col("violations_count") > 0).alias("w"), F.max_by("grade", "order_number").alias("g"))
    return by_question.groupBy("attempt_id").agg(F.count("*").alias("questions"), F.sum("n").alias("interactions"), F.sum("w").alias("wrong"), F.round(F.avg("g"), 6).alias("grade"))


@query("A9", """WITH b AS (SELECT algo_id, parent, COUNT(*) AS c FROM v_nodes WHERE parent IN (SELECT node FROM v_nodes x WHERE x.class = 'alternative' AND x.algo_id = v_nodes.algo_id) GROUP BY algo_id, parent)
 SELECT n.algo_id, CAST(COUNT(DISTINCT n.node) - 1 AS BIGINT) AS actions, CAST(SUM(CASE WHEN class = 'expr' THEN 1 ELSE 0 END) + 1 AS BIGINT) AS cyclomatic,
 COALESCE((SELECT CAST(MAX(c) AS BIGINT) FROM b WHERE b.algo_id = n.algo_id), 0) AS max_branches FROM v_nodes n GROUP BY n.algo_id""")
def code_metrics(v):
    n = v("nodes")
    base = n.groupBy("algo_id").agg((F.count_distinct("node") - 1).alias("actions"), (F.count_if(F.col("class") == "expr") + 1).alias("cyclomatic"))
    alternatives = n.where("class = 'alternative'").select("algo_id", F.col("node").alias("parent"))
    branches = n.join(alternatives, ["algo_id", "parent"]).groupBy("algo_id", "parent").count().groupBy("algo_id").agg(F.max("count").alias("m"))
    return base.join(branches, "algo_id", "left").select("algo_id", "actions", "cyclomatic", F.coalesce("m", F.lit(0)).alias("max_branches"))


@query("A10", """WITH kids AS (SELECT algo_id, parent, COUNT(*) AS c FROM v_nodes WHERE parent IS NOT NULL GROUP BY algo_id, parent)
 SELECT n.algo_id, CAST(SUM(CASE WHEN class = 'alternative' THEN 1 ELSE 0 END) AS BIGINT) AS selections, CAST(SUM(CASE WHEN class = 'loop' THEN 1 ELSE 0 END) AS BIGINT) AS loops,
 COALESCE(CAST(MAX(k.c) AS BIGINT), 0) AS longest, COALESCE(ROUND(AVG(k.c), 6), 0) AS mean_children FROM v_nodes n LEFT JOIN kids k ON k.algo_id = n.algo_id AND k.parent = n.node GROUP BY n.algo_id""")
def trace_metrics(v):
    n = v("nodes")
    kids = n.where("parent is not null").groupBy("algo_id", F.col("parent").alias("node")).agg(F.count("*").alias("c"))
    rows = n.join(kids, ["algo_id", "node"], "left").groupBy("algo_id")
    return rows.agg(F.count_if(F.col("class") == "alternative").alias("selections"), F.count_if(F.col("class") == "loop").alias("loops"), F.coalesce(F.max("c"), F.lit(0)).alias("longest"), F.coalesce(F.round(F.avg("c"), 6), F.lit(0.0)).alias("mean_children"))


@query("A11", "SELECT trace_id, CAST(MAX(n) AS BIGINT) AS most, ROUND(AVG(n), 6) AS mean FROM (SELECT trace_id, action_id, COUNT(*) AS n FROM v_acts WHERE class = 'loop' GROUP BY trace_id, action_id) t GROUP BY trace_id")
def iterations(v):
    per = v("acts").where("class = 'loop'").groupBy("trace_id", "action_id").agg(F.count("*").alias("n"))
    return per.groupBy("trace_id").agg(F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))


@query("A12", "SELECT CAST(COUNT(*) AS BIGINT) AS triples FROM v_facts")
def triple_count(v):
    return v("facts").agg(F.count("*").alias("triples"))


@query("A13", "SELECT CAST(n AS BIGINT) AS copies, CAST(COUNT(*) AS BIGINT) AS facts FROM (SELECT COUNT(*) AS n FROM v_facts GROUP BY subject, verb, object) t GROUP BY n")
def multiplicities(v):
    per = v("facts").groupBy("subject", "verb", "object").agg(F.count("*").alias("copies"))
    return per.groupBy("copies").agg(F.count("*").alias("facts"))


@query("A14", "SELECT CAST(MAX(concept_bits) AS BIGINT) AS top FROM v_questions_meta")
def highest(v):
    return v("questions_meta").agg(F.max("concept_bits").alias("top"))


@query("A15", "SELECT trace_id, STRING_AGG(DISTINCT class || CAST(reason AS VARCHAR), ',' ORDER BY class || CAST(reason AS VARCHAR)) AS mistakes FROM v_acts GROUP BY trace_id")
def mistakes_of_trace(v):
    step = v("acts").groupBy("trace_id", "step").agg(F.collect_set(F.concat("class", "reason")).alias("m"))
    return step.groupBy("trace_id").agg(F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list("m")))), ",").alias("mistakes"))


@query("A16", "SELECT n_regionkey AS exercise_id, CAST(COALESCE(SUM(n_nationkey % 5), -1) AS BIGINT) AS questions FROM nation GROUP BY n_regionkey UNION ALL SELECT -1, -1")
def stage_totals(v):
    n = v("nation").groupBy(F.col("n_regionkey").cast("bigint").alias("exercise_id")).agg(F.sum(F.col("n_nationkey") % 5).alias("questions"))
    return n.unionByName(v.rows("exercise_id bigint, questions bigint", (-1, -1)))


@query("A17", "SELECT attempt_id, CAST(SUM(CASE WHEN violations_count = 0 THEN 1 ELSE 0 END) AS BIGINT) AS without_violations, CAST(SUM(CASE WHEN correct_laws_count > 0 THEN 1 ELSE 0 END) AS BIGINT) AS with_correct_law FROM v_interactions GROUP BY attempt_id")
def correct_counts(v):
    return v("interactions").groupBy("attempt_id").agg(F.count_if(F.col("violations_count") == 0).alias("without_violations"), F.count_if(F.col("correct_laws_count") > 0).alias("with_correct_law"))


@query("A18", "SELECT mistakes, CAST(COUNT(*) AS BIGINT) AS traces FROM (SELECT trace_id, STRING_AGG(DISTINCT class, ',' ORDER BY class) AS mistakes FROM v_acts GROUP BY trace_id) t GROUP BY mistakes")
def traces_by_mistakes(v):
    t = v("acts").groupBy("trace_id").agg(F.array_join(F.sort_array(F.collect_set("class")), ",").alias("mistakes"))
    return t.groupBy("mistakes").agg(F.count("*").alias("traces"))


@query("A19", "SELECT algo_id, CAST(SUM(CASE WHEN class = 'expr' THEN 1 ELSE 0 END) + 1 AS BIGINT) AS cyclomatic, CAST(COUNT(*) - 1 + SUM(CASE WHEN class = 'expr' THEN 1 ELSE 0 END) + 1 AS BIGINT) AS structural FROM v_nodes GROUP BY algo_id")
def complexities(v):
    m = v("nodes").groupBy("algo_id").agg((F.count("*") - 1).alias("actions"), (F.count_if(F.col("class") == "expr") + 1).alias("cyclomatic"))
    return m.select("algo_id", "cyclomatic", (F.col("actions") + F.col("cyclomatic")).alias("structural"))


@query("A20", "SELECT expr_id, CAST(COUNT(*) AS BIGINT) AS steps FROM v_tokens t WHERE token_type = 'operator' AND NOT EXISTS (SELECT 1 FROM v_tokens u WHERE u.expr_id = t.expr_id AND u.text = '&&' AND t.idx = u.idx + 2) GROUP BY expr_id")
def solution_length(v):
    t = v("tokens")
    unevaluated = t.where("text = '&&'").select("expr_id", (F.col("idx") + 2).alias("idx"))
    return t.where("token_type = 'operator'").join(unevaluated, ["expr_id", "idx"], "left_anti").groupBy("expr_id").agg(F.count("*").alias("steps"))


@query("A21", "SELECT trace_id, CAST(bit_or(CASE class WHEN 'loop' THEN 1 WHEN 'alternative' THEN 2 WHEN 'expr' THEN 4 ELSE 8 END) AS BIGINT) AS mask FROM v_acts GROUP BY trace_id")
def executed_classes(v):
    bit = F.when(F.col("class") == "loop", 1).when(F.col("class") == "alternative", 2).when(F.col("class") == "expr", 4).otherwise(8)
    return v("acts").groupBy("trace_id").agg(F.bit_or(bit).alias("mask"))

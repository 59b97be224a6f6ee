"""Queries of joins and lookups (J)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import masks

from .registry import query


def joined(column, order):
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, column))), lambda s: s[column].cast("string")), ",")


@query("J1", """SELECT q.id, q.name FROM v_questions_meta q WHERE q.stage = 4 AND q.is_draft = 1 AND q.domain_shortname = 'ctrl_flow'
 AND NOT EXISTS (SELECT 1 FROM v_questions_meta p WHERE p.name = q.name AND p.domain_shortname = q.domain_shortname AND p.stage = 3)""")
def not_yet_exported(v):
    q = v("questions_meta")
    drafts = q.where("stage = 4 and is_draft = 1 and domain_shortname = 'ctrl_flow'")
    return drafts.join(q.where("stage = 3").select("name", "domain_shortname"), ["name", "domain_shortname"], "left_anti").select("id", "name")


@query("J2", "SELECT q.question_id, CAST(COUNT(i.id) AS BIGINT) AS interactions, STRING_AGG(CAST(i.order_number AS VARCHAR), ',' ORDER BY i.order_number) AS orders FROM (SELECT DISTINCT question_id FROM v_interactions) q LEFT JOIN v_interactions i ON i.question_id = q.question_id AND i.violations_count > 0 GROUP BY q.question_id")
def questions_with_interactions(v):
    i = v("interactions")
    hit = i.where("violations_count > 0").select("question_id", "id", "order_number")
    rows = i.select("question_id").distinct().join(hit, "question_id", "left").groupBy("question_id")
    return rows.agg(F.count("id").alias("interactions"), F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list("order_number")), lambda o: o.cast("string")), ","), F.lit("")).alias("orders"))


@query("J3", "SELECT i.attempt_id, CAST(COUNT(DISTINCT i.question_id) AS BIGINT) AS questions, c.c_name AS user_name FROM v_interactions i LEFT JOIN customer c ON c.c_custkey = i.attempt_id GROUP BY i.attempt_id, c.c_name")
def attempts_with_user(v):
    users = v("customer").select(F.col("c_custkey").alias("attempt_id"), F.col("c_name").alias("user_name"))
    return v("interactions").groupBy("attempt_id").agg(F.count_distinct("question_id").alias("questions")).join(users, "attempt_id", "left")


@query("J4", "SELECT r.r_regionkey AS survey, r.r_name AS title, n.n_nationkey AS question, c.c_custkey AS answer FROM region r LEFT JOIN nation n ON n.n_regionkey = r.r_regionkey LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey")
def survey_votes(v):
    n = v("nation").select(F.col("n_regionkey").alias("survey"), F.col("n_nationkey").alias("question"))
    c = v("customer").select(F.col("c_nationkey").alias("question"), F.col("c_custkey").alias("answer"))
    return v("region").select(F.col("r_regionkey").alias("survey"), F.col("r_name").alias("title")).join(n, "survey", "left").join(c, "question", "left").select("survey", "title", "question", "answer")


@query("J5", "SELECT t.id, t.name FROM v_templates t WHERE t.qt_s_graph IS NOT NULL AND NOT EXISTS (SELECT 1 FROM v_questions_meta q WHERE q.template_id = t.id AND q.stage = 2)")
def templates_without_questions(v):
    t = v("templates")
    nil = t.where(F.col("qt_s_graph").isNull()).select("id")
    used = v("questions_meta").where("stage = 2").select(F.col("template_id").alias("id"))
    return t.join(used, "id", "left_anti").join(nil, "id", "left_anti").select("id", "name")


@query("J6", "SELECT q.id, q.concept_bits | t.concept_bits AS concept_bits FROM v_questions_meta q JOIN v_templates t ON t.id = q.template_id")
def with_template_bits(v):
    t = v("templates").select(F.col("id").alias("template_id"), F.col("concept_bits").alias("more"))
    return v("questions_meta").join(t, "template_id").select("id", F.col("concept_bits").bitwiseOR(F.col("more").cast("bigint")).alias("concept_bits"))


def dictionary(v):
    return v.rows("name string, bit bigint", ("loop", 1), ("alternative", 2), ("expr", 4), ("stmt", 8), ("sequence", 16))


_DICT = "(VALUES ('loop', 1), ('alternative', 2), ('expr', 4), ('stmt', 8), ('sequence', 16)) d(name, bit)"


@query("J7", f"SELECT n.algo_id, CAST(bit_or(d.bit) AS BIGINT) AS mask FROM v_nodes n JOIN {_DICT} ON d.name = n.class GROUP BY n.algo_id")
def names_to_mask(v):
    d = F.broadcast(dictionary(v))  # five rows
    return v("nodes").join(d, F.col("class") == F.col("name")).groupBy("algo_id").agg(F.bit_or("bit").alias("mask"))


@query("J8", f"SELECT q.id, STRING_AGG(d.name, ',' ORDER BY d.bit) AS names FROM v_questions_meta q JOIN {_DICT} ON (q.concept_bits & d.bit) <> 0 GROUP BY q.id")
def mask_to_names(v):
    bits = v("questions_meta").select("id", F.explode(masks.single_bits(F.col("concept_bits"))).alias("bit"))
    return bits.join(F.broadcast(dictionary(v)), "bit").groupBy("id").agg(joined("name", "bit").alias("names"))


_REASONS = "(VALUES ('loop', 0, 'NoIteration'), ('loop', 1, 'ExtraIteration'), ('loop', 1, 'WrongOrder'), ('alternative', 0, 'NoBranch'), ('expr', 2, 'WrongOrder'), ('stmt', 0, 'Missing')) m(class, reason, mistake)"


@query("J9", f"SELECT a.trace_id, STRING_AGG(DISTINCT m.mistake, ',' ORDER BY m.mistake) AS mistakes FROM v_acts a JOIN {_REASONS} ON m.class = a.class AND m.reason = a.reason GROUP BY a.trace_id")
def reason_mistakes(v):
    m = v.rows("class string, reason bigint, mistake string", ("loop", 0, "NoIteration"), ("loop", 1, "ExtraIteration"), ("loop", 1, "WrongOrder"), ("alternative", 0, "NoBranch"), ("expr", 2, "WrongOrder"), ("stmt", 0, "Missing"))
    return v("acts").join(F.broadcast(m), ["class", "reason"]).groupBy("trace_id").agg(F.array_join(F.sort_array(F.collect_set("mistake")), ",").alias("mistakes"))


@query("J10", "SELECT l.l_orderkey AS answer, CAST(COUNT(*) AS BIGINT) AS n FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey GROUP BY l.l_orderkey")
def answers_to_objects(v):
    parts = v("part").select(F.col("p_partkey").alias("l_partkey"))
    return v("lineitem").join(parts, "l_partkey").groupBy(F.col("l_orderkey").alias("answer")).agg(F.count("*").alias("n"))


@query("J11", "SELECT a.subject AS x, b.object AS y FROM v_facts a JOIN v_facts b ON b.subject = a.object AND b.verb = 'in_region' WHERE a.verb = 'in_nation'")
def before_by_third(v):
    f = v("facts")
    a = f.where("verb = 'in_nation'").select(F.col("subject").alias("x"), F.col("object").alias("third"))
    b = f.where("verb = 'in_region'").select(F.col("subject").alias("third"), F.col("object").alias("y"))
    return a.join(b, "third").select("x", "y")


@query("J12", "SELECT a.question_id, CAST(a.order_number AS BIGINT) AS i, CAST(b.order_number AS BIGINT) AS j FROM v_interactions a JOIN v_interactions b ON a.question_id = b.question_id AND a.order_number < b.order_number")
def ordered_pairs(v):
    """Pairs of the answers of a question in order, as the operator asks for."""
    i = v("interactions").select("question_id", "order_number")
    a, b = i.withColumnRenamed("order_number", "i"), i.withColumnRenamed("order_number", "j")
    return a.join(b, "question_id").where("i < j")


@query("J12_unused", """WITH u AS (SELECT question_id, order_number FROM v_interactions WHERE correct_laws_count > 0), n AS (SELECT question_id, order_number FROM v_interactions WHERE correct_laws_count = 0)
 SELECT u.question_id, CAST(u.order_number AS BIGINT) AS used, CAST(n.order_number AS BIGINT) AS unused FROM u JOIN n ON n.question_id = u.question_id""")
def used_with_unused(v):
    """Each answer of a question that was used with each that was not."""
    i = v("interactions")
    used = i.where("correct_laws_count > 0").select("question_id", F.col("order_number").alias("used"))
    unused = i.select("question_id", F.col("order_number").alias("unused")).join(used.withColumnRenamed("used", "unused"), ["question_id", "unused"], "left_anti")
    return used.join(unused, "question_id")


@query("J13", "SELECT question_id, STRING_AGG(CAST(violations_count AS VARCHAR) || ':' || CAST(interactions_left AS VARCHAR), ',' ORDER BY order_number) AS zipped FROM v_interactions GROUP BY question_id")
def zipped(v):
    rows = v("interactions").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("order_number", "violations_count", "interactions_left"))).alias("s"))
    pairs = F.zip_with("s.violations_count", "s.interactions_left", lambda a, b: F.concat_ws(":", a.cast("string"), b.cast("string")))
    return rows.select("question_id", F.array_join(pairs, ",").alias("zipped"))


@query("J14", "SELECT a.trace_id, a.step, b.action_id AS next_action FROM v_acts a JOIN v_acts b ON b.trace_id = a.trace_id AND b.step = a.step + 1 AND b.reason = a.reason")
def reason_nodes(v):
    a = v("acts")
    b = a.select("trace_id", (F.col("step") - 1).alias("step"), "reason", F.col("action_id").alias("next_action"))
    return a.join(b, ["trace_id", "step", "reason"]).select("trace_id", "step", "next_action")


@query("J15", "SELECT e.child, CAST(MAX(e.parent) AS BIGINT) AS target FROM v_concept_edges e WHERE e.parent IN (1, 2, 3, 5) GROUP BY e.child")
def bits_to_targets(v):
    """Of several targets over one concept, the last wins."""
    targets = v.rows("parent bigint, ord int", (1, 1), (2, 2), (3, 3), (5, 4))
    hit = v("concept_edges").join(F.broadcast(targets), "parent")
    last = F.row_number().over(W.partitionBy("child").orderBy(F.desc("ord")))
    return hit.withColumn("n", last).where("n = 1").select("child", F.col("parent").alias("target"))

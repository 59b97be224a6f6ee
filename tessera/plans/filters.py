"""Queries of projections, filters and predicates (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import masks
from tessera.operators import facts as fx

from .registry import query

IDS = "id, name, concept_bits"


def meta(v):
    return v("questions_meta")


@query("F1", "SELECT id, name, stage FROM v_questions_meta WHERE name = 'q_8'")
def by_name(v):
    return meta(v).where(F.col("name") == "q_8").select("id", "name", "stage")


@query("F2", "SELECT id FROM v_questions_meta WHERE (concept_bits & 20) = 0")
def none_of(v):
    return meta(v).where(masks.has_none(F.col("concept_bits"), 20)).select("id")


@query("F3", "SELECT r.id AS request, CAST(COUNT(*) AS BIGINT) AS n FROM v_requests r JOIN v_questions_meta q ON q.domain_shortname = 'ctrl_flow' AND (r.concept_mask = 0 OR (q.concept_bits & r.concept_mask) <> 0) AND (r.violation_mask = 0 OR (q.violation_bits & r.violation_mask) <> 0) GROUP BY r.id")
def some_of(v):
    """Masks of each request against the whole bank. Rows of equal masks are one before the join, so it
    grows with the different masks only, and each request then looks up the count of its own."""
    q = meta(v).where("domain_shortname = 'ctrl_flow'").groupBy("concept_bits", "violation_bits").agg(F.count("*").alias("c"))
    r = v("requests").select(F.col("id").alias("request"), "concept_mask", "violation_mask")
    asked = r.select("concept_mask", "violation_mask").distinct()
    found = asked.join(q, masks.has_some(F.col("concept_bits"), F.col("concept_mask")) & masks.has_some(F.col("violation_bits"), F.col("violation_mask")))
    counts = found.groupBy("concept_mask", "violation_mask").agg(F.sum("c").alias("n"))
    return r.join(counts, ["concept_mask", "violation_mask"]).select("request", "n")


@query("F4", "SELECT id FROM v_questions_meta WHERE (concept_bits & 3) = 3")
def all_of(v):
    return meta(v).where(masks.has_all(F.col("concept_bits"), 3)).select("id")


@query("F5", "SELECT id FROM v_questions_meta WHERE bit_count(concept_bits & 31) >= 2")
def at_least(v):
    return meta(v).where(masks.hits(F.col("concept_bits"), 31) >= 2).select("id")


@query("F6", "SELECT id FROM v_questions_meta WHERE (concept_bits & 16) = 0 AND (concept_bits & 1) = 1 AND bit_count(concept_bits & 14) >= 1")
def combined(v):
    return meta(v).where(masks.fits(F.col("concept_bits"), 1, 14, 1, 16)).select("id")


@query("F7", "SELECT id FROM v_questions_meta WHERE (concept_bits & 16) = 0 AND (concept_bits & 1) = 1 AND bit_count(concept_bits & 6) >= 1 AND bit_count(concept_bits & 17592186044424) <= 1")
def combined_unwanted(v):
    return meta(v).where(masks.fits(F.col("concept_bits"), 1, 6, 1, 16, 17592186044424, 1)).select("id")


@query("F8", "SELECT id, solution_steps FROM v_questions_meta WHERE solution_steps BETWEEN 3 AND 12")
def steps_between(v):
    return meta(v).where(F.col("solution_steps").between(3, 12)).select("id", "solution_steps")


@query("F9", "SELECT id FROM v_questions_meta WHERE domain_shortname = 'ctrl_flow' AND stage = 3 AND is_draft = 0")
def published(v):
    return meta(v).where("domain_shortname = 'ctrl_flow' and stage = 3 and is_draft = 0").select("id")


@query("F10", "SELECT id, template_id FROM v_questions_meta WHERE template_id NOT IN (0, 7, 19) AND id NOT IN (1, 2, 3)")
def not_in(v):
    templates = v.rows("template_id bigint", (0,), (7,), (19,))
    ids = v.rows("id bigint", (1,), (2,), (3,))
    return meta(v).join(templates, "template_id", "left_anti").join(ids, "id", "left_anti").select("id", "template_id")


def on_stage(rows, stage: int = 0, most: int | None = None):
    """Stage 0 is no filter, no limit is all rows."""
    found = rows.where(F.col("stage") == stage) if stage else rows
    return found.orderBy("id").limit(most) if most else found


@query("F11", "SELECT id, stage FROM v_questions_meta WHERE stage = 4 ORDER BY id LIMIT 40")
def stage_with_limit(v):
    return on_stage(meta(v), 4, 40).select("id", "stage")


@query("F12", "SELECT id, attempt_id FROM v_requests WHERE outdated = 0 AND found_count <= 5")
def unprocessed(v):
    return v("requests").where("outdated = 0 and found_count <= 5").select("id", "attempt_id")


@query("F13", "SELECT id, name FROM v_laws WHERE id IN (1, 4, 9) OR name IN ('law_2', 'law_20')")
def by_lists(v):
    return v("laws").where(F.col("id").isin(1, 4, 9) | F.col("name").isin("law_2", "law_20")).select("id", "name")


@query("F14", "SELECT DISTINCT exercise_id AS id FROM v_interactions")
def ids_only(v):
    return v("interactions").select(F.col("exercise_id").alias("id")).distinct()


@query("F15", "SELECT subject, verb, object FROM v_facts WHERE verb = 'line' AND object = '3'")
def pattern(v):
    return fx.matching(v("facts"), None, "line", "3").select(*fx.TERMS)


@query("F16", "SELECT CAST(COUNT(*) > 0 AS BIGINT) AS found FROM v_facts WHERE subject = 's1' AND verb = 'in_nation'")
def exists(v):
    return fx.matching(v("facts"), "s1", "in_nation").limit(1).agg((F.count("*") > 0).cast("bigint").alias("found"))


@query("F17", "SELECT verb, CAST(COUNT(*) AS BIGINT) AS n FROM v_facts WHERE verb IN ('in_nation', 'label') GROUP BY verb")
def verbs(v):
    return fx.of_verbs(v("facts"), ["in_nation", "label"]).groupBy("verb").agg(F.count("*").alias("n"))


@query("F18", "SELECT object AS place, STRING_AGG(DISTINCT subject, ',' ORDER BY subject) AS subjects FROM v_facts WHERE verb = 'in_region' GROUP BY object")
def values_of(v):
    f = fx.matching(v("facts"), verb="in_region")
    return f.groupBy(F.col("object").alias("place")).agg(F.array_join(F.sort_array(F.collect_set("subject")), ",").alias("subjects"))


@query("F19", "SELECT id FROM v_templates WHERE qt_s_graph IS NULL")
def unsolved(v):
    return v("templates").where(F.col("qt_s_graph").isNull()).select("id")


@query("F20", "SELECT DISTINCT subject FROM v_facts WHERE verb = 'in_nation' ORDER BY subject LIMIT 7")
def names_of_class(v):
    return fx.matching(v("facts"), verb="in_nation").select("subject").distinct().orderBy("subject").limit(7)


def operator_counts(v):
    return v("tokens").groupBy("expr_id").agg(F.count_if(F.col("token_type") == "operator").alias("operators"), F.count_if(F.col("token_type") == "undefined").alias("undefined"))


_OPS = "SELECT expr_id, CAST(SUM(CASE WHEN token_type = 'operator' THEN 1 ELSE 0 END) AS BIGINT) AS operators FROM v_tokens GROUP BY expr_id"


@query("F21", f"{_OPS} HAVING SUM(CASE WHEN token_type = 'operator' THEN 1 ELSE 0 END) BETWEEN 2 AND 50 AND SUM(CASE WHEN token_type = 'undefined' THEN 1 ELSE 0 END) = 0")
def valid_nodes(v):
    return operator_counts(v).where("operators between 2 and 50 and undefined = 0").select("expr_id", "operators")


@query("F22", f"{_OPS} HAVING SUM(CASE WHEN token_type = 'operator' THEN 1 ELSE 0 END) BETWEEN 3 AND 30")
def clickable(v):
    return operator_counts(v).where("operators between 3 and 30").select("expr_id", "operators")


@query("F23", "SELECT id FROM v_questions_meta WHERE solution_steps <= 20 AND integral_complexity BETWEEN 0.1 AND 0.8")
def clamped(v):
    return meta(v).where("solution_steps <= 20 and integral_complexity between 0.1 and 0.8").select("id")


def tag_list(column: str):
    return F.filter(F.split(column, r"\s*,\s*"), lambda t: F.trim(t) != "")


@query("F24", "SELECT id, name FROM v_laws WHERE tags IN ('C', 'C, base', '')")
def laws_by_tags(v):
    """A law applies if all its tags are among the question's (C, base)."""
    return v("laws").where(F.size(F.array_except(tag_list("tags"), F.array(F.lit("C"), F.lit("base")))) == 0).select("id", "name")


@query("F25", "SELECT e.child AS concept, r.role FROM v_concept_edges e JOIN (VALUES (1, 'TARGETED'), (2, 'PERMITTED'), (3, 'FORBIDDEN')) r(concept, role) ON e.parent = r.concept WHERE r.role = 'FORBIDDEN'")
def by_role(v):
    roles = v.rows("parent bigint, role string", (1, "TARGETED"), (2, "PERMITTED"), (3, "FORBIDDEN"))
    return v("concept_edges").join(roles.where("role = 'FORBIDDEN'"), "parent").select(F.col("child").alias("concept"), "role")


@query("F26", "SELECT DISTINCT expr_id FROM v_tokens WHERE expr_id NOT IN (SELECT expr_id FROM v_tokens WHERE text IN ('&&', ''))")
def well_formed(v):
    t = v("tokens")
    return t.select("expr_id").distinct().join(t.where(F.col("text").isin("&&", "")), "expr_id", "left_anti")


@query("F27", "SELECT algo_id, CAST(COUNT(DISTINCT node) AS BIGINT) AS subjects FROM v_nodes GROUP BY algo_id HAVING COUNT(DISTINCT node) <= 12")
def small_templates(v):
    return v("nodes").groupBy("algo_id").agg(F.count_distinct("node").alias("subjects")).where("subjects <= 12")


@query("F28", "SELECT conv_id, STRING_AGG(CASE WHEN role = 'user' THEN CAST(turn AS VARCHAR) END, ',' ORDER BY turn) AS left_turns, STRING_AGG(CASE WHEN role <> 'user' THEN CAST(turn AS VARCHAR) END, ',' ORDER BY turn) AS right_turns FROM conversations GROUP BY conv_id")
def matching_columns(v):
    c = v("conversations")
    side = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.col("turn")))), lambda t: t.cast("string")), ",")
    return c.groupBy("conv_id").agg(F.nullif(side(F.col("role") == "user"), F.lit("")).alias("left_turns"), F.nullif(side(F.col("role") != "user"), F.lit("")).alias("right_turns"))


@query("F29", "SELECT attempt_id, STRING_AGG(CAST(question_id AS VARCHAR), ',' ORDER BY question_id) AS questions FROM (SELECT DISTINCT attempt_id, question_id FROM v_interactions WHERE question_id % 10 <> 9) t GROUP BY attempt_id")
def attempt_questions(v):
    q = v("interactions").where("question_id % 10 <> 9")
    return q.groupBy("attempt_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("question_id")), lambda x: x.cast("string")), ",").alias("questions"))


@query("F30", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_name = 'Customer#000000007' OR c_custkey = 12")
def user_by_login(v):
    return v("customer").where("c_name = 'Customer#000000007' or c_custkey = 12").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))

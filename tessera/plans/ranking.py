"""Queries of window-like operators (W) and of sort, top-k and sampling (K)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import masks, numeric
from tessera.sources import files

from .joins import joined
from .registry import query


def dealt(seed: int, column: str = "id"):
    """A fixed order in place of a random one, that every engine computes alike."""
    return (F.col(column) * 7919 + seed) % 10007


@query("W1", "SELECT question_id, order_number FROM (SELECT question_id, order_number, ROW_NUMBER() OVER (PARTITION BY question_id ORDER BY order_number DESC) AS n FROM v_interactions WHERE interactions_left >= 0 AND violations_count = 0) t WHERE n = 1")
def last_correct(v):
    i = v("interactions").where("interactions_left >= 0 and violations_count = 0")
    return i.groupBy("question_id").agg(F.max("order_number").alias("order_number"))


@query("W2", "SELECT question_id, COALESCE(grade, 0) AS grade FROM (SELECT question_id, grade, ROW_NUMBER() OVER (PARTITION BY question_id ORDER BY order_number DESC) AS n FROM v_interactions) t WHERE n = 1")
def last_grade(v):
    return v("interactions").groupBy("question_id").agg(F.coalesce(F.max_by("grade", "order_number"), F.lit(0.0)).alias("grade"))


_LAST4 = "SELECT attempt_id, question_id % 1500 AS meta_id FROM (SELECT attempt_id, question_id, ROW_NUMBER() OVER (PARTITION BY attempt_id ORDER BY question_id DESC) AS n FROM (SELECT DISTINCT attempt_id, question_id FROM v_interactions) d) t WHERE n <= 4"


@query("W3", f"SELECT l.attempt_id, CAST(bit_or(q.concept_bits) AS BIGINT) AS concepts FROM ({_LAST4}) l JOIN v_questions_meta q ON q.id = l.meta_id GROUP BY l.attempt_id")
def last_metas(v):
    i = v("interactions").select("attempt_id", "question_id").distinct()
    last = i.withColumn("n", F.row_number().over(W.partitionBy("attempt_id").orderBy(F.desc("question_id")))).where("n <= 4")
    q = v("questions_meta").select(F.col("id").alias("meta_id"), "concept_bits")
    return last.withColumn("meta_id", F.col("question_id") % 1500).join(q, "meta_id").groupBy("attempt_id").agg(F.bit_or("concept_bits").alias("concepts"))


@query("W4", """WITH s AS (SELECT n_regionkey AS exercise_id, n_nationkey AS stage, SUM(1 + n_nationkey % 3) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS upto FROM nation)
 SELECT e.exercise_id, e.done, COALESCE((SELECT MIN(stage) FROM s WHERE s.exercise_id = e.exercise_id AND e.done < s.upto), (SELECT MAX(stage) FROM s WHERE s.exercise_id = e.exercise_id)) AS stage
 FROM (SELECT r_regionkey AS exercise_id, d.d AS done FROM region CROSS JOIN (VALUES (0), (2), (5), (40)) d(d)) e""")
def next_stage(v):
    """The first stage whose running total is not reached yet, else the last."""
    run = W.partitionBy("exercise_id").orderBy("stage").rowsBetween(W.unboundedPreceding, W.currentRow)
    s = v("nation").select(F.col("n_regionkey").alias("exercise_id"), F.col("n_nationkey").alias("stage")).withColumn("upto", F.sum(1 + F.col("stage") % 3).over(run))
    e = v("region").select(F.col("r_regionkey").alias("exercise_id"), F.explode(F.array(F.lit(0), F.lit(2), F.lit(5), F.lit(40))).alias("done"))
    rows = e.join(s, "exercise_id").groupBy("exercise_id", "done")
    return rows.agg(F.coalesce(F.min(F.when(F.col("done") < F.col("upto"), F.col("stage"))), F.max("stage")).alias("stage"))


_POOL = "SELECT * FROM v_questions_meta WHERE domain_shortname = 'ctrl_flow' AND stage = 3"


@query("W5", f"""WITH p AS ({_POOL}), r AS (SELECT id, ROW_NUMBER() OVER (ORDER BY ABS(integral_complexity - 0.5), id) + ROW_NUMBER() OVER (ORDER BY bit_count(concept_bits & 12) - 3 * bit_count(concept_bits & 3), id) AS fused FROM p)
 SELECT id, CAST(fused AS BIGINT) AS fused FROM r ORDER BY fused, id LIMIT 25""")
def rank_fusion(v):
    """Two orders of the whole pool, added up; each is numbered by ranges, so no task orders it all."""
    unwanted = masks.hits(F.col("concept_bits"), 12) - 3 * masks.hits(F.col("concept_bits"), 3)
    pool = v("questions_meta").where("domain_shortname = 'ctrl_flow' and stage = 3")
    pool = pool.select("id", F.abs(F.col("integral_complexity") - 0.5).alias("far"), unwanted.alias("unwanted"))
    near = files.numbered(pool.select("far", "id"), ["far", "id"], "a").select("id", "a")
    other = files.numbered(pool.select("unwanted", "id"), ["unwanted", "id"], "b").select("id", "b")
    return near.join(other, "id").select("id", (F.col("a") + F.col("b") + 2).cast("bigint").alias("fused")).orderBy("fused", "id").limit(25)


@query("W6", """WITH t AS (SELECT algo_id, node, class, node - ROW_NUMBER() OVER (PARTITION BY algo_id, class ORDER BY node) AS island FROM v_nodes),
 c AS (SELECT *, COUNT(*) OVER (PARTITION BY algo_id, class, island) AS size, ROW_NUMBER() OVER (PARTITION BY algo_id, class, island ORDER BY node) AS n FROM t)
 SELECT algo_id, node FROM c WHERE size <= 3 OR n <= 2 OR n = size""")
def long_runs_cut(v):
    """Of a run of more than three neighbours of a class, the first two and the last."""
    n = v("nodes").withColumn("island", F.col("node") - F.row_number().over(W.partitionBy("algo_id", "class").orderBy("node")))
    of = W.partitionBy("algo_id", "class", "island")
    c = n.withColumn("size", F.count("*").over(of)).withColumn("n", F.row_number().over(of.orderBy("node")))
    return c.where("size <= 3 or n <= 2 or n = size").select("algo_id", "node")


@query("W7", "SELECT algo_id, node, CAST(ROW_NUMBER() OVER (PARTITION BY algo_id, parent ORDER BY node) - 1 AS BIGINT) AS item_index FROM v_nodes WHERE class <> 'stmt' AND parent IS NOT NULL")
def renumbered(v):
    n = v("nodes").where("class <> 'stmt' and parent is not null")
    return n.select("algo_id", "node", (F.row_number().over(W.partitionBy("algo_id", "parent").orderBy("node")) - 1).alias("item_index"))


@query("W8", "SELECT trace_id, step, action_id, LEAD(action_id) OVER (PARTITION BY trace_id ORDER BY step) AS next_action FROM v_acts")
def adjacent(v):
    return v("acts").select("trace_id", "step", "action_id", F.lead("action_id").over(W.partitionBy("trace_id").orderBy("step")).alias("next_action"))


@query("W9", "SELECT trace_id, step, CAST(ROW_NUMBER() OVER (PARTITION BY trace_id, action_id ORDER BY step) AS BIGINT) AS nth FROM v_acts WHERE class = 'expr'")
def occurrence(v):
    a = v("acts").where("class = 'expr'")
    return a.select("trace_id", "step", F.row_number().over(W.partitionBy("trace_id", "action_id").orderBy("step")).alias("nth"))


@query("W10", """WITH t AS (SELECT trace_id, step, phase, LAG(phase) OVER (PARTITION BY trace_id ORDER BY step) AS was FROM v_acts)
 SELECT trace_id, step, CAST(SUM(CASE WHEN phase = 'end' AND was = 'begin' THEN 0 ELSE 1 END) OVER (PARTITION BY trace_id ORDER BY step) AS BIGINT) AS act FROM t""")
def act_index(v):
    at = W.partitionBy("trace_id").orderBy("step")
    a = v("acts").withColumn("was", F.lag("phase").over(at))
    new = F.when((F.col("phase") == "end") & (F.coalesce(F.col("was"), F.lit("")) == "begin"), 0).otherwise(1)
    return a.withColumn("new", new).select("trace_id", "step", F.sum("new").over(at.rowsBetween(W.unboundedPreceding, 0)).alias("act"))


@query("W11", """WITH t AS (SELECT trace_id, step, action_id, phase, SUM(CASE WHEN phase = 'begin' THEN 1 ELSE -1 END) OVER (PARTITION BY trace_id ORDER BY step) + CASE WHEN phase = 'begin' THEN 0 ELSE 1 END AS depth FROM v_acts)
 SELECT trace_id, step, CAST(depth AS BIGINT) AS depth, (SELECT MAX(b.step) FROM t b WHERE b.trace_id = t.trace_id AND b.phase = 'begin' AND b.depth = t.depth - 1 AND b.step < t.step) AS enclosing FROM t""")
def enclosing(v):
    """Depth of each act and the step that opened the action around it: the last begin one up."""
    at = W.partitionBy("trace_id").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    up = F.when(F.col("phase") == "begin", 1).otherwise(-1)
    a = v("acts").withColumn("up", up).withColumn("depth", F.sum("up").over(at) + F.when(F.col("phase") == "begin", 0).otherwise(1))
    # Begins lifted one level stand among the acts of the level below; the latest before is wanted.
    begins = a.where("phase = 'begin'").select("trace_id", "step", (F.col("depth") + 1).alias("depth"), F.col("step").alias("opened"))
    both = a.select("trace_id", "step", "depth", F.lit(None).cast("bigint").alias("opened")).unionByName(begins)
    seen = F.last("opened", ignorenulls=True).over(W.partitionBy("trace_id", "depth").orderBy("step").rangeBetween(W.unboundedPreceding, -1))
    return both.withColumn("enclosing", seen).where("opened is null").select("trace_id", "step", "depth", "enclosing")


@query("W12", "SELECT question_id, id FROM (SELECT question_id, id, interactions_left, MAX(interactions_left) OVER (PARTITION BY question_id) AS top FROM v_interactions) t WHERE interactions_left = top")
def at_highest(v):
    i = v("interactions").withColumn("top", F.max("interactions_left").over(W.partitionBy("question_id")))
    return i.where("interactions_left = top").select("question_id", "id")


@query("W13", "SELECT algo, name FROM (SELECT id % 20 AS algo, id, name, SUM(LENGTH(name) + 1) OVER (PARTITION BY id % 20 ORDER BY id) AS upto FROM v_templates) t WHERE upto < 40")
def longest_prefix(v):
    t = v("templates").withColumn("algo", F.col("id") % 20)
    upto = F.sum(F.length("name") + 1).over(W.partitionBy("algo").orderBy("id").rowsBetween(W.unboundedPreceding, 0))
    return t.withColumn("upto", upto).where("upto < 40").select("algo", "name")


def candidates(bank, *, concepts=2, traces=5, violations=131, denied=17592186044416, denied_violations=4, complexity=0.5, width=0.125, steps=(3, 30), templates=(0,), ids=(0,), pool=12):
    """Inner stage of the search: the rows that match most, nearest and least used first."""
    q = bank.where("domain_shortname = 'ctrl_flow' and stage = 3 and is_draft = 0").where(F.col("solution_steps").between(*steps))
    q = q.where(masks.has_none(F.col("concept_bits"), denied) & masks.has_none(F.col("violation_bits"), denied_violations))
    q = q.where(~F.col("template_id").isin(*templates) & ~F.col("id").isin(*ids))
    kinds = [masks.hits(F.col(c), m) for c, m in (("trace_concept_bits", traces), ("concept_bits", concepts), ("violation_bits", violations))]
    q = q.select("id", sum(kinds[1:], kinds[0]).alias("matched"), sum([(k > 0).cast("bigint") for k in kinds[1:]], (kinds[0] > 0).cast("bigint")).alias("kinds"), numeric.quotient(F.col("integral_complexity"), complexity, width).alias("bucket"), "used_count")
    return q.orderBy(F.desc("matched"), "bucket", "used_count", "id").limit(pool)


_K1 = """SELECT id, CAST(bit_count(trace_concept_bits & 5) + bit_count(concept_bits & 2) + bit_count(violation_bits & 131) AS BIGINT) AS matched,
 CAST(CASE WHEN (trace_concept_bits & 5) <> 0 THEN 1 ELSE 0 END + CASE WHEN (concept_bits & 2) <> 0 THEN 1 ELSE 0 END + CASE WHEN (violation_bits & 131) <> 0 THEN 1 ELSE 0 END AS BIGINT) AS kinds,
 CAST(FLOOR(ABS(integral_complexity - 0.5) / 0.125) AS BIGINT) AS bucket, used_count
 FROM v_questions_meta WHERE domain_shortname = 'ctrl_flow' AND stage = 3 AND is_draft = 0 AND solution_steps BETWEEN 3 AND 30
 AND (concept_bits & 17592186044416) = 0 AND (violation_bits & 4) = 0 AND template_id NOT IN (0) AND id NOT IN (0)
 ORDER BY matched DESC, bucket ASC, used_count ASC, id ASC LIMIT 12"""


@query("K1", f"SELECT id, matched, bucket, used_count FROM ({_K1}) t ORDER BY kinds DESC, (id * 7919 + 17) % 10007, id LIMIT 12")
def bank_search(v):
    """Two stages: a pool of the best, then a dealt order by kinds of masks matched."""
    pool = candidates(v("questions_meta"))
    return pool.orderBy(F.desc("kinds"), dealt(17), "id").limit(12).select("id", "matched", "bucket", "used_count")


@query("K2", "SELECT id FROM v_questions_meta WHERE domain_shortname = 'expression' AND stage = 3 AND solution_steps BETWEEN 2 AND 23 ORDER BY id LIMIT 30")
def suitable(v):
    return v("questions_meta").where("domain_shortname = 'expression' and stage = 3 and solution_steps between 2 and 23").orderBy("id").limit(30).select("id")


@query("K3", """WITH s AS (SELECT id, CAST(bit_count(concept_bits & 3) AS BIGINT) AS hit, CAST(bit_count(concept_bits & 28) AS BIGINT) AS extra FROM v_questions_meta WHERE (violation_bits & 4) = 0 AND name NOT IN ('q_0', 'q_4')),
 b AS (SELECT MAX(hit * 100 - extra) AS top FROM s) SELECT id FROM s, b WHERE hit * 100 - extra = top ORDER BY (id * 7919 + 5) % 10007, id LIMIT 1""")
def best_match(v):
    """Most targets, then fewest others, then one by a dealt order."""
    q = v("questions_meta").where("(violation_bits & 4) = 0").where(~F.col("name").isin("q_0", "q_4"))
    return q.orderBy(F.desc(masks.hits(F.col("concept_bits"), 3)), masks.hits(F.col("concept_bits"), 28), dealt(5), "id").limit(1).select("id")


@query("K4", """WITH b AS (SELECT id, LEAST(CAST(FLOOR(integral_complexity * 8) AS BIGINT), 7) AS bin FROM v_questions_meta)
 SELECT id, bin FROM (SELECT id, bin, ROW_NUMBER() OVER (PARTITION BY bin ORDER BY (id * 7919 + 3) % 10007, id) AS n FROM b) t WHERE n <= 5""")
def stratified(v):
    """Equal-width bins, half open, the last one closed; as many as there are up to the share."""
    b = v("questions_meta").select("id", F.least(F.floor(F.col("integral_complexity") * 8), F.lit(7)).alias("bin"))
    return b.withColumn("n", F.row_number().over(W.partitionBy("bin").orderBy(dealt(3), "id"))).where("n <= 5").select("id", "bin")


@query("K5", """WITH t AS (SELECT trace_id, STRING_AGG(DISTINCT class, ',' ORDER BY class) AS mistakes, COUNT(*) AS len FROM v_acts GROUP BY trace_id),
 m AS (SELECT *, MIN(len) OVER (PARTITION BY mistakes) AS lo, MAX(len) OVER (PARTITION BY mistakes) AS hi FROM t),
 k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY mistakes ORDER BY (trace_id * 7919 + 11) % 10007, trace_id) AS n FROM m WHERE len <= lo + 0.5 * (hi - lo))
 SELECT trace_id, mistakes, CAST(len AS BIGINT) AS len FROM k WHERE n <= 2""")
def two_shortest(v):
    """Of each set of mistakes, two dealt traces out of the shorter half of the length range."""
    t = v("acts").groupBy("trace_id").agg(F.array_join(F.sort_array(F.collect_set("class")), ",").alias("mistakes"), F.count("*").alias("len"))
    of = W.partitionBy("mistakes")
    cut = t.withColumn("lo", F.min("len").over(of)).withColumn("hi", F.max("len").over(of)).where("len <= lo + 0.5 * (hi - lo)")
    return cut.withColumn("n", F.row_number().over(of.orderBy(dealt(11, "trace_id"), "trace_id"))).where("n <= 2").select("trace_id", "mistakes", "len")


@query("K6", "SELECT id FROM v_templates ORDER BY (id * 7919 + 42) % 10007, id LIMIT 15")
def dealt_templates(v):
    return v("templates").orderBy(dealt(42), "id").limit(15).select("id")


@query("K7", "SELECT expr_id, STRING_AGG(text, ' ' ORDER BY idx) AS code FROM v_tokens GROUP BY expr_id")
def tokens_in_order(v):
    return v("tokens").groupBy("expr_id").agg(F.replace(joined("text", "idx"), F.lit(","), F.lit(" ")).alias("code"))


@query("K8", """WITH RECURSIVE r(algo_id, a, node) AS (SELECT algo_id, node, node FROM v_nodes UNION ALL SELECT n.algo_id, r.a, n.parent FROM r JOIN v_nodes n ON n.algo_id = r.algo_id AND n.node = r.node WHERE n.parent IS NOT NULL)
 SELECT algo_id, a AS node, CAST(COUNT(*) - 1 AS BIGINT) AS place FROM r GROUP BY algo_id, a""")
def topological(v):
    """The number of nodes before a node on its way from the root."""
    from tessera.operators.closure import closure

    edges = v("nodes").where("parent is not null").select("algo_id", "parent", F.col("node").alias("child"))
    return closure(edges, ["algo_id"]).groupBy("algo_id", "node").agg((F.count("*") - 1).alias("place"))


@query("K9", "SELECT trace_id, step FROM (SELECT trace_id, step, ROW_NUMBER() OVER (PARTITION BY trace_id ORDER BY CASE WHEN class LIKE 'a%' THEN 0 ELSE 1 END, step DESC) AS n FROM v_acts) t WHERE n = 1")
def neighbours_first(v):
    order = W.partitionBy("trace_id").orderBy(F.when(F.col("class").startswith("a"), 0).otherwise(1), F.desc("step"))
    return v("acts").withColumn("n", F.row_number().over(order)).where("n = 1").select("trace_id", "step")


@query("K10", "SELECT id FROM v_questions_meta WHERE stage = 2 AND template_id NOT IN (SELECT id FROM v_templates WHERE stage = 1) ORDER BY (id * 7919 + 9) % 10007, id LIMIT 1")
def random_pick(v):
    denied = v("templates").where("stage = 1").select(F.col("id").alias("template_id"))
    return v("questions_meta").where("stage = 2").join(denied, "template_id", "left_anti").orderBy(dealt(9), "id").limit(1).select("id")


@query("K11", "SELECT name, salience FROM v_laws ORDER BY salience DESC, id")
def by_salience(v):
    return v("laws").orderBy(F.desc("salience"), "id").select("name", "salience")


@query("K12", "SELECT id FROM v_questions_meta ORDER BY id LIMIT 10 OFFSET 20")
def page(v):
    return v("questions_meta").orderBy("id").offset(20).limit(10).select("id")

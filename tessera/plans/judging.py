"""Queries of rules (I), judging (R) and target balancing (P)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import masks
from tessera.operators import expressions as ex
from tessera.operators import rules
from tessera.operators.closure import closure
from tessera.sources import jsonio

from .registry import query
from .sets import _TREE

# Rules ------------------------------------------------------------------------------------------


def program_facts(v):
    n = v("nodes").select(F.col("algo_id").cast("string").alias("graph_id"), F.col("node").cast("string").alias("node"), F.col("parent").cast("string").alias("parent"), "class")
    up = n.where("parent is not null").select("graph_id", F.col("parent").alias("s"), F.lit("parent_of").alias("p"), F.col("node").alias("o"))
    return up.unionByName(n.select("graph_id", F.col("node").alias("s"), F.lit("type").alias("p"), F.col("class").alias("o")))


_PARTS = f"{_TREE} SELECT CAST(algo_id AS VARCHAR) AS graph_id, CAST(a AS VARCHAR) AS s, CAST(node AS VARCHAR) AS o FROM r WHERE d > 0"
_INNER = f"{_TREE} SELECT CAST(r.algo_id AS VARCHAR) AS graph_id, CAST(a AS VARCHAR) AS s, CAST(r.node AS VARCHAR) AS o FROM r JOIN v_nodes x ON x.algo_id = r.algo_id AND x.node = r.a AND x.class = 'loop' JOIN v_nodes y ON y.algo_id = r.algo_id AND y.node = r.node AND y.class = 'loop' WHERE d > 0"


@query("I1", _PARTS)
def forward_chained(v):
    found = rules.inferred(program_facts(v), [r for r in rules.CONTROL_FLOW if r.salience == 2])
    return found.where("p = 'hasPartTransitive'").select("graph_id", "s", "o")


@query("I2", _INNER)
def stratified_rules(v):
    return rules.inferred(program_facts(v), rules.CONTROL_FLOW).where("p = 'has_inner_loop'").select("graph_id", "s", "o")


def expression_facts(v):
    ops = ex.operators(v("tokens"), jsonio.operators(v.spark))
    b = ex.before_direct(ops)
    return b.select(F.col("expr_id").cast("string").alias("graph_id"), F.col("first").cast("string").alias("s"), F.lit("before_direct").alias("p"), F.col("then").cast("string").alias("o"))


_OP = "(VALUES ('+', 6, 'L'), ('*', 5, 'L'), ('=', 16, 'R'), ('<', 9, 'L'), ('&&', 14, 'L'), ('-', 6, 'L')) o(text, prec, assoc)"
_ORDER = f"""ops AS (SELECT t.expr_id, t.idx, t.text, o.prec, o.assoc FROM v_tokens t JOIN {_OP} ON o.text = t.text WHERE t.token_type = 'operator'),
 nb AS (SELECT expr_id, idx, prec, assoc, LEAD(idx) OVER w AS r, LEAD(prec) OVER w AS rprec FROM ops WINDOW w AS (PARTITION BY expr_id ORDER BY idx)),
 bd AS (SELECT expr_id, CASE WHEN prec < rprec OR prec = rprec AND assoc = 'L' THEN idx ELSE r END AS first, CASE WHEN prec < rprec OR prec = rprec AND assoc = 'L' THEN r ELSE idx END AS second FROM nb WHERE r IS NOT NULL)"""


@query("I3", f"WITH {_ORDER} SELECT DISTINCT CAST(a.expr_id AS VARCHAR) AS graph_id, CAST(a.first AS VARCHAR) AS s, CAST(b.second AS VARCHAR) AS o FROM bd a JOIN bd b ON b.expr_id = a.expr_id AND b.first = a.second")
def solved(v):
    return rules.inferred(expression_facts(v), rules.EXPRESSION).select("graph_id", "s", "o")


@query("I4", f"WITH {_ORDER} SELECT CAST(expr_id AS VARCHAR) AS graph_id, CAST(second AS VARCHAR) AS s, CAST(first AS VARCHAR) AS o FROM bd WHERE second < first")
def judged(v):
    """Operators answered from left to right: what came before one that had to be first."""
    f = expression_facts(v)
    used = v("tokens").where("token_type = 'operator'").select(F.col("expr_id").cast("string").alias("graph_id"), F.col("idx").cast("string").alias("s"), F.lit("used_at").alias("p"), F.col("idx").cast("string").alias("o"))
    return rules.inferred(f.unionByName(used), rules.VIOLATIONS).select("graph_id", "s", "o")


@query("I5", "SELECT verb AS name, CASE WHEN MAX(CASE WHEN object_type = 'rdf:resource' THEN 1 ELSE 0 END) = 1 THEN 'ObjectProperty' ELSE 'DatatypeProperty' END AS kind FROM v_facts GROUP BY verb")
def declarations(v):
    resource = F.max(F.when(F.col("object_type") == "rdf:resource", 1).otherwise(0)) == 1
    return v("facts").groupBy(F.col("verb").alias("name")).agg(F.when(resource, "ObjectProperty").otherwise("DatatypeProperty").alias("kind"))


@query("I6", "SELECT subject, CASE WHEN object_type = 'xsd:int' THEN CAST(object AS BIGINT) END AS number, CASE WHEN object_type = 'xsd:string' THEN object END AS literal, CASE WHEN object_type = 'rdf:resource' THEN 'http://bank/' || object END AS uri FROM v_facts")
def typed(v):
    f, t = v("facts"), F.col("object_type")
    return f.select("subject", F.when(t == "xsd:int", F.col("object").cast("bigint")).alias("number"), F.when(t == "xsd:string", F.col("object")).alias("literal"), F.when(t == "rdf:resource", F.concat(F.lit("http://bank/"), "object")).alias("uri"))


@query("I7", "SELECT DISTINCT object, 'Region_' || REPLACE(REPLACE(REPLACE(base64(unhex(md5(object))), '+', '-'), '/', '_'), '=', '') AS name FROM v_facts WHERE verb = 'in_region'")
def new_names(v):
    return v("facts").where("verb = 'in_region'").select("object", rules.skolem("Region", F.col("object")).alias("name")).distinct()


@query("I9", "SELECT id, name FROM v_laws WHERE positive = 1 AND salience >= 1")
def rules_by_role(v):
    return v("laws").where("positive = 1 and salience >= 1").select("id", "name")


@query("I10", "SELECT DISTINCT parent AS class FROM v_concept_edges")
def schema_classes(v):
    return v("concept_edges").select(F.col("parent").alias("class")).distinct()


# Judging ----------------------------------------------------------------------------------------


def order_of(v):
    ops = ex.operators(v("tokens"), jsonio.operators(v.spark))
    return ops, ex.before_direct(ops)


_DONE = "idx <= 4"


@query("R1", f"WITH {_ORDER} SELECT expr_id, idx FROM ops p WHERE NOT ({_DONE}) AND NOT EXISTS (SELECT 1 FROM bd JOIN ops q ON q.expr_id = bd.expr_id AND q.idx = bd.first WHERE bd.expr_id = p.expr_id AND bd.second = p.idx AND q.idx > 4)")
def ready_operators(v):
    ops, order = order_of(v)
    return ex.ready(ops, order, ops.where(_DONE).select("expr_id", "idx")).select("expr_id", "idx")


@query("R2", "SELECT expr_id, CAST(SUM(CASE WHEN idx > 4 THEN 1 ELSE 0 END) + 1 AS BIGINT) AS steps_left FROM v_tokens WHERE token_type = 'operator' GROUP BY expr_id")
def steps_left(v):
    """Pending operators and the end token."""
    return v("tokens").where("token_type = 'operator'").groupBy("expr_id").agg((F.count_if(F.col("idx") > 4) + 1).alias("steps_left"))


@query("R3", f"WITH {_ORDER} SELECT expr_id, first AS idx, CASE WHEN second < first THEN 'error_base_higher_precedence_right' ELSE 'error_base_higher_precedence_left' END AS mistake FROM bd")
def possible_mistakes(v):
    _, order = order_of(v)
    side = F.when(F.col("then") < F.col("first"), "right").otherwise("left")
    return order.select("expr_id", F.col("first").alias("idx"), F.concat(F.lit("error_base_higher_precedence_"), side).alias("mistake"))


@query("R4", f"WITH {_ORDER} SELECT expr_id, CAST(COUNT(*) AS BIGINT) AS violations FROM bd WHERE second < first GROUP BY expr_id")
def order_violations(v):
    """Answers from left to right that break the order."""
    _, order = order_of(v)
    return order.where(F.col("then") < F.col("first")).groupBy("expr_id").agg(F.count("*").alias("violations"))


@query("R5", "SELECT o.expr_id, o.idx, a.idx AS answer, CASE WHEN a.idx = o.idx THEN 'operator' WHEN a.idx = o.idx - 1 THEN 'left' WHEN a.idx = o.idx + 1 THEN 'right' ELSE 'unrelated' END AS kind FROM v_tokens o JOIN v_tokens a ON a.expr_id = o.expr_id WHERE o.token_type = 'operator' AND o.idx = 4")
def operand_answers(v):
    t = v("tokens")
    o = t.where("token_type = 'operator' and idx = 4").select("expr_id", "idx")
    a = t.select("expr_id", F.col("idx").alias("answer"))
    d = F.col("answer") - F.col("idx")
    return o.join(a, "expr_id").select("expr_id", "idx", "answer", F.when(d == 0, "operator").when(d == -1, "left").when(d == 1, "right").otherwise("unrelated").alias("kind"))


@query("R6", f"WITH {_ORDER} SELECT expr_id, idx, r AS other, CASE WHEN prec < rprec THEN 'higher' WHEN prec > rprec THEN 'lower' ELSE 'same' END AS answer FROM nb WHERE r IS NOT NULL")
def precedence_answers(v):
    ops, _ = order_of(v)
    p = F.col("precedence") - F.col("r_precedence")
    return ex.neighbours(ops).select("expr_id", "idx", F.col("r_idx").alias("other"), F.when(p < 0, "higher").when(p > 0, "lower").otherwise("same").alias("answer"))


@query("R7", "SELECT question_id, order_number FROM (SELECT question_id, order_number, correct_laws_count, MAX(order_number) OVER (PARTITION BY question_id) AS top FROM v_interactions) t WHERE order_number = top AND correct_laws_count > 0")
def correct_laws(v):
    i = v("interactions").withColumn("top", F.max("order_number").over(W.partitionBy("question_id")))
    return i.where("order_number = top and correct_laws_count > 0").select("question_id", "order_number")


@query("R8", "WITH RECURSIVE r(a, node) AS (SELECT DISTINCT parent, parent FROM v_concept_edges UNION ALL SELECT r.a, e.child FROM r JOIN v_concept_edges e ON e.parent = r.node) SELECT w.trace_id, CAST(COUNT(DISTINCT w.c) AS BIGINT) AS kinds FROM (SELECT trace_id, action_id * 10 + reason AS c FROM v_acts) w WHERE w.c IN (SELECT node FROM r WHERE a = 2) AND w.c NOT IN (SELECT parent FROM v_concept_edges) GROUP BY w.trace_id")
def specific_errors(v):
    """Most specific error classes of the acts of a trace: leaves below class 2, each once."""
    e = v("concept_edges")
    leaves = closure(e, of=v.rows("ancestor bigint", (2,))).select(F.col("node").alias("c")).join(e.select(F.col("parent").alias("c")), "c", "left_anti")
    acts = v("acts").select("trace_id", (F.col("action_id") * 10 + F.col("reason")).alias("c"))
    return acts.join(leaves, "c", "left_semi").groupBy("trace_id").agg(F.count_distinct("c").alias("kinds"))


@query("R9", "SELECT law, mistake FROM (VALUES (0, 'TooEarly'), (0, 'TooLate'), (1, 'ExtraAct')) m(law, mistake) UNION ALL SELECT DISTINCT 2, 'Context' || class FROM v_nodes WHERE class IN ('loop', 'alternative')")
def mistakes_of_laws(v):
    fixed = v.rows("law bigint, mistake string", (0, "TooEarly"), (0, "TooLate"), (1, "ExtraAct"))
    context = v("nodes").where("class in ('loop', 'alternative')").select(F.lit(2).cast("bigint").alias("law"), F.concat(F.lit("Context"), "class").alias("mistake")).distinct()
    return fixed.unionByName(context)


@query("R10", "SELECT 'act_' || CAST(trace_id AS VARCHAR) || '_' || CAST(step AS VARCHAR) AS subject, 'next_act' AS verb, 'act_' || CAST(trace_id AS VARCHAR) || '_' || CAST(step + 1 AS VARCHAR) AS object FROM (SELECT *, LEAD(step) OVER (PARTITION BY trace_id ORDER BY step) AS nx FROM v_acts) t WHERE nx IS NOT NULL UNION ALL SELECT 'act_' || CAST(trace_id AS VARCHAR) || '_' || CAST(step AS VARCHAR), 'executes', CAST(action_id AS VARCHAR) FROM v_acts")
def response_facts(v):
    name = lambda step: F.concat_ws("_", F.lit("act"), F.col("trace_id").cast("string"), step.cast("string"))
    a = v("acts").withColumn("nx", F.lead("step").over(W.partitionBy("trace_id").orderBy("step")))
    s = name(F.col("step")).alias("subject")
    return a.where("nx is not null").select(s, F.lit("next_act").alias("verb"), name(F.col("nx")).alias("object")).unionByName(a.select(s, F.lit("executes").alias("verb"), F.col("action_id").cast("string").alias("object")))


@query("R11", "SELECT expr_id, CAST(MAX(CASE WHEN idx < 6 THEN idx END) AS BIGINT) AS on_left, CAST(MIN(CASE WHEN idx > 6 THEN idx END) AS BIGINT) AS on_right FROM v_tokens WHERE token_type = 'operator' AND text <> '=' GROUP BY expr_id")
def nearest_unused(v):
    o = v("tokens").where("token_type = 'operator' and text <> '='")
    return o.groupBy("expr_id").agg(F.max(F.when(F.col("idx") < 6, F.col("idx"))).alias("on_left"), F.min(F.when(F.col("idx") > 6, F.col("idx"))).alias("on_right"))


@query("R12", "SELECT id, CASE id % 3 WHEN 0 THEN 'q2' WHEN 1 THEN 'q3' ELSE 'q1' END AS next_question FROM v_requests")
def supplementary(v):
    steps = v.rows("answer bigint, next_question string", (0, "q2"), (1, "q3"), (2, "q1"))
    return v("requests").withColumn("answer", F.col("id") % 3).join(F.broadcast(steps), "answer").select("id", "next_question")


@query("R13", "SELECT trace_id, step, 'step ' || CAST(step AS VARCHAR) || ': ' || class || ' ' || phase AS line FROM v_acts")
def trace_lines(v):
    from tessera.functions.text import substituted

    text = substituted(F.lit("step ${step}: ${class} ${phase}"), F.create_map(F.lit("step"), F.col("step").cast("string"), F.lit("class"), F.col("class"), F.lit("phase"), F.col("phase")))
    return v("acts").select("trace_id", "step", text.alias("line"))


@query("R15", "SELECT id FROM v_requests WHERE 1 = 0")
def choice_facts(v):
    """Choice answers make no facts."""
    return v("requests").where("false").select("id")


@query("R14", "SELECT attempt_id, CAST(SUM(CASE WHEN violations_count > 0 THEN 1 ELSE 0 END) <= COUNT(*) * 0.0834 AS BIGINT) AS acceptable FROM v_interactions GROUP BY attempt_id")
def acceptable(v):
    return v("interactions").groupBy("attempt_id").agg((F.count_if(F.col("violations_count") > 0) <= F.count("*") * 0.0834).cast("bigint").alias("acceptable"))


# Target balancing -------------------------------------------------------------------------------


#: The fixture's concepts as bits: which bit is a child of which.
_BIT_EDGES = ((1, 2), (1, 4), (2, 8), (4, 16), (16, 32), (8, 32))


@query("P1", f"""WITH RECURSIVE e(parent, child) AS (VALUES {", ".join(map(str, _BIT_EDGES))}),
 b(bit) AS (SELECT parent FROM e UNION SELECT child FROM e), r(bit, below) AS (SELECT bit, bit FROM b UNION SELECT r.bit, e.child FROM r JOIN e ON e.parent = r.below),
 m AS (SELECT q.id, BIT_OR(CASE WHEN (q.concept_mask & r.bit) <> 0 THEN r.below ELSE 0 END) AS allowed, BIT_OR(CASE WHEN (q.denied_mask & r.bit) <> 0 THEN r.below ELSE 0 END) AS denied
       FROM v_requests q CROSS JOIN r GROUP BY q.id)
 SELECT q.id, CAST(q.concept_mask AS BIGINT) AS targets, CAST(q.concept_mask | m.allowed AS BIGINT) AS allowed, CAST(q.denied_mask | m.denied AS BIGINT) AS denied FROM v_requests q JOIN m ON m.id = q.id""")
def request_masks(v):
    """Targets, what is allowed with all below, what is denied with all below. A dictionary has at
    most 63 bits, so the masks of their descendants come to the driver and go into the row's expression."""
    c = closure(v.rows("parent bigint, child bigint", *_BIT_EDGES))
    below = {r["ancestor"]: r["mask"] for r in c.groupBy("ancestor").agg(F.bit_or("node").alias("mask")).collect()}
    return v("requests").select(
        "id",
        F.col("concept_mask").alias("targets"),
        masks.widened(F.col("concept_mask"), below).alias("allowed"),
        masks.widened(F.col("denied_mask"), below).alias("denied"),
    )


_USED = "SELECT r.attempt_id, b.bit, SUM(CASE WHEN (q.concept_bits & b.bit) <> 0 THEN 1 ELSE 0 END) AS hit, COUNT(*) AS n FROM v_requests r JOIN v_questions_meta q ON q.id = r.id % 1500 CROSS JOIN (VALUES (1), (2), (4)) b(bit) WHERE (r.concept_mask & b.bit) <> 0 GROUP BY r.attempt_id, b.bit"


def target_use(v, bits="concept_bits", mask="concept_mask"):
    """For each attempt and target bit: questions that had it, and all that asked for it."""
    q = v("questions_meta").select(F.col("id").alias("meta_id"), bits)
    asked = v("requests").withColumn("meta_id", F.col("id") % 1500).join(q, "meta_id").withColumn("bit", F.explode(masks.single_bits(F.col(mask))))
    return asked.groupBy("attempt_id", "bit").agg(F.count_if(F.col(bits).bitwiseAND(F.col("bit")) != 0).alias("hit"), F.count("*").alias("n"))


@query("P2", f"SELECT attempt_id, bit FROM (SELECT attempt_id, bit, hit, MIN(hit) OVER (PARTITION BY attempt_id) AS least FROM ({_USED}) u) t WHERE hit = least")
def least_used(v):
    u = target_use(v).withColumn("least", F.min("hit").over(W.partitionBy("attempt_id")))
    return u.where("hit = least").select("attempt_id", "bit")


@query("P3", f"SELECT attempt_id, bit, CAST(hit AS BIGINT) AS hit, CAST(n - hit AS BIGINT) AS miss, CAST(hit = 0 AS BIGINT) AS unreachable FROM ({_USED}) u")
def concept_use(v):
    return target_use(v).select("attempt_id", "bit", "hit", (F.col("n") - F.col("hit")).alias("miss"), (F.col("hit") == 0).cast("bigint").alias("unreachable"))


@query("P4", "SELECT r.attempt_id, b.bit, CAST(SUM(CASE WHEN (q.violation_bits & b.bit) <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS hit, CAST(COUNT(*) AS BIGINT) AS n FROM v_requests r JOIN v_questions_meta q ON q.id = r.id % 1500 CROSS JOIN (VALUES (1), (2)) b(bit) WHERE (r.violation_mask & b.bit) <> 0 GROUP BY r.attempt_id, b.bit")
def law_use(v):
    return target_use(v, "violation_bits", "violation_mask")


@query("P5", f"SELECT attempt_id, bit FROM (SELECT *, MIN(CASE WHEN hit > 0 THEN CAST(hit AS DOUBLE) / n END) OVER (PARTITION BY attempt_id) AS low FROM ({_USED}) u) t WHERE hit = 0 OR CAST(hit AS DOUBLE) / n <= low")
def minimum_ratio(v):
    """The least satisfied targets; one never met counts as unseen and so stays."""
    ratio = F.col("hit").cast("double") / F.col("n")
    low = F.min(F.when(F.col("hit") > 0, ratio)).over(W.partitionBy("attempt_id"))
    return target_use(v).withColumn("low", low).where((F.col("hit") == 0) | (ratio <= F.col("low"))).select("attempt_id", "bit")


@query("P6", "SELECT id, CASE WHEN domain_shortname = 'ctrl_flow' THEN concept_bits ELSE 0 END AS trace_targets, CASE WHEN domain_shortname = 'ctrl_flow' THEN 0 ELSE concept_bits END AS concept_targets, CASE WHEN domain_shortname = 'ctrl_flow' THEN 3 ELSE 2 END AS steps_min, CASE WHEN domain_shortname = 'ctrl_flow' THEN 30 ELSE 23 END AS steps_max FROM v_questions_meta")
def domain_masks(v):
    flow = F.col("domain_shortname") == "ctrl_flow"
    return v("questions_meta").select("id", F.when(flow, F.col("concept_bits")).otherwise(0).alias("trace_targets"), F.when(flow, 0).otherwise(F.col("concept_bits")).alias("concept_targets"), F.when(flow, 3).otherwise(2).alias("steps_min"), F.when(flow, 30).otherwise(23).alias("steps_max"))


@query("P7", "SELECT id, CAST(bit_count(concept_bits & 12) + bit_count(violation_bits & 3) - 3 * bit_count(concept_bits & 3) AS BIGINT) AS unwanted FROM v_questions_meta")
def unwanted_rank(v):
    c, w = F.col("concept_bits"), F.col("violation_bits")
    return v("questions_meta").select("id", (masks.hits(c, 12) + masks.hits(w, 3) - 3 * masks.hits(c, 3)).alias("unwanted"))


@query("P8", "SELECT attempt_id, CASE WHEN MAX(order_number) >= 3 THEN 'COMPLETED_BY_USER' ELSE 'INCOMPLETE' END AS status FROM v_interactions GROUP BY attempt_id")
def attempt_state(v):
    return v("interactions").groupBy("attempt_id").agg(F.when(F.max("order_number") >= 3, "COMPLETED_BY_USER").otherwise("INCOMPLETE").alias("status"))

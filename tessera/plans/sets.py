"""Queries of set operations (U) and graphs (G)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import facts as fx
from tessera.operators.closure import bag_closure, closure

from .registry import query

T = "subject, verb, object"


def _roles(v):
    f = v("facts").withColumn("graph_id", F.col("verb")).withColumn("role_ord", F.length("subject") % 4)
    return f


@query("U1", f"SELECT DISTINCT verb AS graph_id, {T} FROM v_facts WHERE LENGTH(subject) % 4 <= 2")
def role_union(v):
    return fx.up_to_role(_roles(v), 2)


@query("U2", f"SELECT DISTINCT {T} FROM v_facts WHERE verb IN ('line', 'label') EXCEPT SELECT {T} FROM v_facts WHERE object IN ('1', '2')")
def inferred_only(v):
    f = v("facts")
    return fx.minus(fx.as_set(fx.of_verbs(f, ["line", "label"])), f.where("object in ('1', '2')"))


@query("U3", "SELECT DISTINCT path FROM (SELECT name AS path FROM v_templates UNION ALL SELECT qt_s_graph FROM v_templates UNION ALL SELECT origin FROM v_questions_meta) t WHERE path IS NOT NULL")
def paths(v):
    t = v("templates").select(F.explode(F.array("name", "qt_s_graph")).alias("path"))
    return t.unionByName(v("questions_meta").select(F.col("origin").alias("path"))).where("path is not null").distinct()


@query("U4", f"SELECT DISTINCT {T} FROM v_facts")
def distinct_facts(v):
    return fx.as_set(v("facts"))


@query("U5", f"SELECT {T} FROM v_facts WHERE NOT (verb = 'line' AND object = '1') AND NOT (subject = 's3')")
def facts_without(v):
    gone = v.rows("subject string, verb string, object string", (None, "line", "1"), ("s3", None, None))
    return fx.without_like(v("facts"), gone).select(*fx.TERMS)


@query("U6", f"SELECT {T} FROM v_facts UNION ALL SELECT * FROM (VALUES ('x', 'label', 'new')) t")
def appended(v):
    more = v.rows("subject string, verb string, object string", ("x", "label", "new"), ("n1", "in_region", "r1"))
    f = v("facts").select(*fx.TERMS)
    return fx.with_new(f, more)


@query("U7", f"SELECT {T} FROM v_facts WHERE verb = 'in_region' AND object IN ('r1', 'r2')")
def retained(v):
    f = v("facts")
    return fx.retained(f.where("verb = 'in_region'"), f.where("object in ('r1', 'r2')")).select(*fx.TERMS)


@query("U8", "SELECT id, CAST((concept_mask | 8) - ((concept_mask | 8) & denied_mask) AS BIGINT) AS allowed FROM v_requests")
def targets_minus_denied(v):
    t = F.col("concept_mask").bitwiseOR(F.lit(8))
    return v("requests").select("id", t.bitwiseAND(F.bitwise_not(F.col("denied_mask"))).alias("allowed"))


@query("U9", "SELECT id AS law, id AS part FROM v_laws UNION ALL SELECT id, implied_by FROM v_laws WHERE implied_by IS NOT NULL")
def laws_and_implied(v):
    laws = v("laws")
    return laws.select(F.col("id").alias("law"), F.col("id").alias("part")).unionAll(laws.where("implied_by is not null").select("id", "implied_by"))


@query("U10", "SELECT CAST(MIN(p_partkey) AS BIGINT) AS id, p_brand AS name, p_size AS hash FROM part GROUP BY p_brand, p_size")
def distinct_units(v):
    return v("part").groupBy(F.col("p_brand").alias("name"), F.col("p_size").alias("hash")).agg(F.min("p_partkey").alias("id"))


@query("U11", "SELECT id FROM (SELECT id, solution_steps, ROW_NUMBER() OVER (PARTITION BY template_id, violation_bits ORDER BY id) AS n FROM v_questions_meta) t WHERE n = 1 AND solution_steps <= 20")
def distinct_questions(v):
    """The first of each template and suffix, then the clamp: a rejected one still blocks."""
    q = v("questions_meta").withColumn("n", F.row_number().over(W.partitionBy("template_id", "violation_bits").orderBy("id")))
    return q.where("n = 1 and solution_steps <= 20").select("id")


def edges(v):
    return v("concept_edges")


_REACH = "WITH RECURSIVE r(a, node, d) AS (SELECT DISTINCT parent, parent, 0 FROM v_concept_edges UNION ALL SELECT r.a, e.child, r.d + 1 FROM r JOIN v_concept_edges e ON e.parent = r.node)"
_TREE = "WITH RECURSIVE r(algo_id, a, node, d) AS (SELECT algo_id, node, node, 0 FROM v_nodes UNION ALL SELECT n.algo_id, r.a, n.node, r.d + 1 FROM r JOIN v_nodes n ON n.algo_id = r.algo_id AND n.parent = r.node)"


@query("G1", "SELECT DISTINCT b.subject AS node FROM v_facts a JOIN v_facts b ON b.verb = 'in_region' AND b.object = a.object WHERE a.verb = 'in_region' AND a.subject = 'n1'")
def chain(v):
    return fx.chain(v.rows("node string", ("n1",)), v("facts"), ["in_region", "^in_region"])


@query("G2", "SELECT DISTINCT node FROM (SELECT object AS node FROM v_facts WHERE verb = 'in_nation' AND subject IN ('s1', 's2') UNION ALL SELECT b.object FROM v_facts a JOIN v_facts b ON b.subject = a.object AND b.verb = 'in_region' WHERE a.verb = 'in_nation' AND a.subject IN ('s1', 's2')) t")
def optional_path(v):
    """in_nation / in_region?"""
    start = v.rows("node string", ("s1",), ("s2",))
    f = v("facts").where("verb <> 'line'")
    return fx.chain(start, f, ["in_nation"]).unionByName(fx.chain(start, f, ["in_nation", "in_region"])).distinct()


@query("G2_plus", """WITH RECURSIVE e AS (SELECT subject, object FROM v_facts WHERE verb IN ('in_nation', 'in_region')),
 r(node, reached) AS (SELECT subject, object FROM e UNION SELECT r.node, e.object FROM r JOIN e ON e.subject = r.reached) SELECT node, reached FROM r""")
def repeated_path(v):
    """(in_nation | in_region)+ from every subject."""
    return fx.repeated(v("facts"), ["in_nation", "in_region"]).select("node", "reached")


@query("G3", f"{_REACH} SELECT a AS concept, CAST(COUNT(DISTINCT node) AS BIGINT) AS descendants FROM r GROUP BY a")
def descendants(v):
    e = edges(v)
    c = closure(e, of=e.select(F.col("parent").alias("ancestor")))
    return c.groupBy(F.col("ancestor").alias("concept")).agg(F.count("*").alias("descendants"))


@query("G4", f"{_REACH} SELECT a AS concept, CAST(bit_or(CAST(1 AS BIGINT) << CAST(node % 40 AS INT)) AS BIGINT) AS mask FROM r GROUP BY a")
def subtree_mask(v):
    e = edges(v)
    c = closure(e, of=e.select(F.col("parent").alias("ancestor")))
    return c.groupBy(F.col("ancestor").alias("concept")).agg(F.bit_or(F.expr("shiftleft(1L, cast(node % 40 as int))")).alias("mask"))


@query("G5", f"{_REACH} SELECT DISTINCT node FROM r WHERE a = 3 AND d BETWEEN 1 AND 3 AND node NOT IN (SELECT parent FROM v_concept_edges)")
def near_leaves(v):
    """Leaves up to three levels below a class."""
    e = edges(v)
    near = bag_closure(e, 3).where("ancestor = 3").select("node").distinct()
    return near.join(e.select(F.col("parent").alias("node")), "node", "left_anti")


@query("G6", f"{_REACH} SELECT DISTINCT node, CAST(1 AS BIGINT) AS is_kind FROM r WHERE a = 5")
def kinds_of(v):
    return closure(edges(v), of=v.rows("ancestor bigint", (5,))).select("node", F.lit(1).cast("bigint").alias("is_kind"))


@query("G7", "WITH RECURSIVE r(a, node, d) AS (SELECT parent, child, 1 FROM v_concept_edges UNION ALL SELECT r.a, e.child, r.d + 1 FROM r JOIN v_concept_edges e ON e.parent = r.node WHERE r.d < 4) SELECT a AS law, CAST(COUNT(*) AS BIGINT) AS implied FROM r GROUP BY a")
def implied_bag(v):
    return bag_closure(edges(v), 4).groupBy(F.col("ancestor").alias("law")).agg(F.count("*").alias("implied"))


@query("G8", f"{_REACH}, n AS (SELECT node, a, ROW_NUMBER() OVER (PARTITION BY node ORDER BY d, a) AS k FROM (SELECT node, a, MIN(d) AS d FROM r WHERE a IN (1, 4, 6, 10) GROUP BY node, a) t) SELECT a AS grp, CAST(COUNT(*) AS BIGINT) AS members FROM n WHERE k = 1 GROUP BY a")
def grouped_concepts(v):
    """Each concept under its nearest wanted ancestor."""
    c = closure(edges(v), of=v.rows("ancestor bigint", (1,), (4,), (6,), (10,)))
    near = c.withColumn("k", F.row_number().over(W.partitionBy("node").orderBy("depth", "ancestor"))).where("k = 1")
    return near.groupBy(F.col("ancestor").alias("grp")).agg(F.count("*").alias("members"))


def tree(v):
    return v("nodes").where("parent is not null").select("algo_id", "parent", F.col("node").alias("child"))


@query("G9", f"{_TREE} SELECT algo_id, CAST(MAX(d) AS BIGINT) AS depth FROM r WHERE a = 0 GROUP BY algo_id")
def nesting(v):
    roots = tree(v).where("parent = 0").select("algo_id", F.col("parent").alias("ancestor"))
    return closure(tree(v), ["algo_id"], of=roots).groupBy("algo_id").agg(F.max("depth").alias("depth"))


@query("G10", f"{_TREE} SELECT l.algo_id, CAST(MAX(l.inner_loops) + 1 AS BIGINT) AS loop_containment FROM (SELECT r.algo_id, r.a, COUNT(CASE WHEN m.class = 'loop' AND r.d > 0 THEN 1 END) AS inner_loops FROM r JOIN v_nodes m ON m.algo_id = r.algo_id AND m.node = r.node JOIN v_nodes o ON o.algo_id = r.algo_id AND o.node = r.a AND o.class = 'loop' GROUP BY r.algo_id, r.a) l GROUP BY l.algo_id")
def loop_containment(v):
    """Loops transitively inside a loop, the most of any, plus one."""
    loops = v("nodes").where("class = 'loop'").select("algo_id", "node")
    c = closure(tree(v), ["algo_id"], of=loops.withColumnRenamed("node", "ancestor"))
    inside = c.join(loops, ["algo_id", "node"]).groupBy("algo_id", "ancestor").agg((F.count("*") - 1).alias("n"))
    return inside.groupBy("algo_id").agg((F.max("n") + 1).alias("loop_containment"))


@query("G11", "SELECT trace_id, STRING_AGG(CAST(action_id AS VARCHAR), '>' ORDER BY step) AS walk FROM v_acts GROUP BY trace_id")
def walk(v):
    a = v("acts").groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("step", "action_id"))).alias("s"))
    return a.select("trace_id", F.array_join(F.transform("s", lambda x: x["action_id"].cast("string")), ">").alias("walk"))


@query("G12", "WITH RECURSIVE r(node, place, hops) AS (SELECT child, child, 0 FROM (SELECT DISTINCT child FROM v_concept_edges) t UNION ALL SELECT r.node, f.parent, r.hops + 1 FROM r JOIN (SELECT child, MIN(parent) AS parent FROM v_concept_edges GROUP BY child) f ON f.child = r.place) SELECT node, CAST(MAX(hops) AS BIGINT) AS steps FROM r GROUP BY node")
def remaining_path(v):
    """Hops left on the way of first consequents to the end, a node that has none."""
    first = edges(v).groupBy("child").agg(F.min("parent").alias("parent"))
    ends = first.select(F.col("parent").alias("ancestor")).join(first.select(F.col("child").alias("ancestor")), "ancestor", "left_anti")
    c = closure(first, of=ends).join(first.select(F.col("child").alias("node")), "node", "left_semi")
    return c.select("node", F.col("depth").cast("bigint").alias("steps"))


@query("G13", "SELECT a.trace_id, a.step, (a.action_id + CASE WHEN a.reason = 0 THEN 1 WHEN a.reason = 1 THEN 2 ELSE 5 END) % 12 AS expected FROM v_acts a")
def next_act(v):
    """The consequent of an act by its recorded value."""
    step = v.rows("reason bigint, hop bigint", (0, 1), (1, 2), (2, 5))
    a = v("acts").join(F.broadcast(step), "reason")
    return a.select("trace_id", "step", ((F.col("action_id") + F.col("hop")) % 12).alias("expected"))


@query("G14", "SELECT algo_id, node, b.phase FROM v_nodes, (VALUES ('begin'), ('end')) b(phase)")
def boundaries(v):
    return v("nodes").select("algo_id", "node", F.explode(F.array(F.lit("begin"), F.lit("end"))).alias("phase"))


@query("G15", "SELECT parent AS concept, STRING_AGG(CAST(child AS VARCHAR), ',' ORDER BY child) AS children FROM v_concept_edges GROUP BY parent")
def inverted(v):
    return edges(v).groupBy(F.col("parent").alias("concept")).agg(F.array_join(F.transform(F.array_sort(F.collect_set("child")), lambda c: c.cast("string")), ",").alias("children"))


@query("G16", "SELECT n.algo_id, n.node, COALESCE(CASE WHEN p.class = 'stmt' THEN p.parent END, n.parent) AS parent FROM v_nodes n LEFT JOIN v_nodes p ON p.algo_id = n.algo_id AND p.node = n.parent")
def flattened(v):
    """Children of a plain statement move up to its parent."""
    n = v("nodes")
    p = n.where("class = 'stmt'").select("algo_id", F.col("node").alias("parent"), F.col("parent").alias("up"))
    return n.join(p, ["algo_id", "parent"], "left").select("algo_id", "node", F.coalesce("up", "parent").alias("parent"))


@query("G17", f"{_REACH} SELECT node, CAST(MAX(d) AS BIGINT) AS layer FROM r WHERE a = 0 GROUP BY node")
def dependency_order(v):
    """The round in which a concept can be read: all its bases come first; a cycle is an error."""
    e = edges(v)
    done = e.select(F.col("parent").alias("node")).distinct().join(e.select(F.col("child").alias("node")), "node", "left_anti").withColumn("layer", F.lit(0))
    left, layer = e, 0
    from tessera.operators.closure import saved

    done = saved(done)
    while not left.isEmpty():
        layer += 1
        waiting = left.join(done.select(F.col("node").alias("parent")), "parent", "left_anti").select("child").distinct()
        ready = saved(left.select("child").distinct().join(waiting, "child", "left_anti").select(F.col("child").alias("node"), F.lit(layer).alias("layer")))
        if ready.isEmpty():
            raise ValueError("the concepts have a cycle")
        done = done.unionByName(ready)
        left = saved(left.join(ready.select(F.col("node").alias("child")), "child", "left_anti"))
    return done

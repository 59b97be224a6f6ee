"""Queries of code structure (C), traces (E), scalars (B, M, H, T, X, D0) and writes (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import masks, numeric, text
from tessera.operators import expressions as ex
from tessera.operators import traces, writes
from tessera.operators import facts as fx
from tessera.sources import csource, jsonio

from .judging import _ORDER
from .registry import query

# Code -------------------------------------------------------------------------------------------


@query("C3", "SELECT expr_id, idx, text, token_type FROM v_tokens")
def flattened_tokens(v):
    """Tokens packed per expression, then laid out with their index again."""
    packed = v("tokens").groupBy("expr_id").agg(F.array_sort(F.collect_list(F.struct("idx", "text", "token_type"))).alias("t"))
    return packed.select("expr_id", F.posexplode("t").alias("at", "x")).select("expr_id", (F.col("at") + 1).alias("idx"), "x.text", "x.token_type")


def expression_trees(v):
    """Nodes of the expressions' trees, parsed from their tokens put together as text."""
    packed = v("tokens").groupBy(F.col("expr_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("t"))
    return csource.trees(packed.select("id", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("code")), "expression")


@query("C1", "SELECT expr_id, idx, CASE text WHEN '=' THEN 'assignment' WHEN '<' THEN 'comparison' ELSE text END AS matched FROM v_tokens WHERE token_type = 'operator'")
def matched_expressions(v):
    return csource.matched(expression_trees(v)).select(F.col("id").alias("expr_id"), (F.col("at") + 1).alias("idx"), "matched")


@query("C2", """WITH o(text, prec, assoc) AS (VALUES ('+', 6, 'L'), ('*', 5, 'L'), ('=', 16, 'R'), ('<', 9, 'L'), ('&&', 14, 'L'), ('-', 6, 'L')),
 n AS (SELECT t.expr_id, t.idx, t.text, t.token_type, o.prec, o.assoc FROM v_tokens t LEFT JOIN o ON o.text = t.text),
 w AS (SELECT * FROM n WHERE prec IS NOT NULL),
 l AS (SELECT n.expr_id, n.idx, MAX(w.idx) AS at FROM n JOIN w ON w.expr_id = n.expr_id AND w.idx < n.idx AND (n.prec IS NULL OR w.prec > n.prec OR w.prec = n.prec AND w.assoc = 'R') GROUP BY n.expr_id, n.idx),
 r AS (SELECT n.expr_id, n.idx, MIN(w.idx) AS at FROM n JOIN w ON w.expr_id = n.expr_id AND w.idx > n.idx AND (n.prec IS NULL OR w.prec > n.prec OR w.prec = n.prec AND w.assoc = 'L') GROUP BY n.expr_id, n.idx)
 SELECT n.expr_id, n.idx, n.text, CASE n.token_type WHEN 'operator' THEN 'binary' ELSE 'variable' END AS kind,
        CASE WHEN l.at IS NULL THEN r.at WHEN r.at IS NULL THEN l.at WHEN y.prec < x.prec OR y.prec = x.prec AND y.assoc = 'R' THEN r.at ELSE l.at END AS parent
 FROM n LEFT JOIN l ON l.expr_id = n.expr_id AND l.idx = n.idx LEFT JOIN r ON r.expr_id = n.expr_id AND r.idx = n.idx
 LEFT JOIN w x ON x.expr_id = n.expr_id AND x.idx = l.at LEFT JOIN w y ON y.expr_id = n.expr_id AND y.idx = r.at""")
def normal_forms(v):
    t = expression_trees(v)
    return t.select(F.col("id").alias("expr_id"), (F.col("at") + 1).alias("idx"), "text", "kind", (F.col("parent_at") + 1).alias("parent"))


@query("C4", """WITH e(k, node, parent, position, kind, text) AS (VALUES
 (0, 3, 1, 1, 'for', 'i = 0 ; i < n ; i ++'), (0, 4, 3, 0, 'sequence', ''), (0, 5, 4, 0, 'expression', 'g ( i )'), (0, 6, 1, 2, 'return', ''),
 (1, 3, 1, 1, 'while', 'i < n'), (1, 4, 3, 0, 'expression', 'i ++'), (1, 5, 1, 2, 'return', ''),
 (2, 3, 1, 1, 'do', 'i < n'), (2, 4, 3, 0, 'sequence', ''), (2, 5, 4, 0, 'if', ''), (2, 6, 5, 0, 'branch', 'i'), (2, 7, 6, 0, 'break', ''),
 (2, 8, 5, 1, 'else', ''), (2, 9, 8, 0, 'continue', ''), (2, 10, 1, 2, 'return', ''),
 (3, 3, 1, 1, 'if', ''), (3, 4, 3, 0, 'branch', 'n < 0'), (3, 5, 4, 0, 'return', ''), (3, 6, 3, 1, 'branch', 'n == 0'), (3, 7, 6, 0, 'sequence', ''),
 (3, 8, 3, 2, 'else', ''), (3, 9, 8, 0, 'expression', 'g ( n )'), (3, 10, 1, 2, 'return', ''),
 (4, 3, 1, 1, 'undefined', 'switch'), (4, 4, 1, 2, 'return', ''), (5, 3, 1, 1, 'undefined', ';'), (5, 4, 1, 2, 'return', ''))
 SELECT id, CAST(0 AS BIGINT) AS node, CAST(NULL AS BIGINT) AS parent, CAST(0 AS BIGINT) AS position, 'function' AS kind, 'f' || CAST(id AS VARCHAR) AS text FROM v_sources
 UNION ALL SELECT id, 1, 0, 0, 'sequence', '' FROM v_sources UNION ALL SELECT id, 2, 1, 0, 'declaration', 'int i = 0' FROM v_sources
 UNION ALL SELECT s.id, e.node, e.parent, e.position, e.kind, e.text FROM v_sources s JOIN e ON e.k = s.id % 6""")
def statement_trees(v):
    return csource.trees(v("sources")).select("id", "node", "parent", "position", "kind", "text")


@query("C5", "SELECT algo_id, parent, node, CAST(ROW_NUMBER() OVER w - 1 AS BIGINT) AS item_index, LEAD(node) OVER w AS next FROM v_nodes WHERE parent IS NOT NULL WINDOW w AS (PARTITION BY algo_id, parent ORDER BY node)")
def linked_statements(v):
    from pyspark.sql import Window as W

    w = W.partitionBy("algo_id", "parent").orderBy("node")
    return v("nodes").where("parent is not null").select("algo_id", "parent", "node", (F.row_number().over(w) - 1).alias("item_index"), F.lead("node").over(w).alias("next"))


@query("C6", "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 AND 0 < p_size % 7 THEN 'Infinite' WHEN 0 >= p_size % 7 THEN 'Zero' WHEN CEIL((p_size % 7) / CAST(p_size % 3 AS DOUBLE)) = 1 THEN 'One' ELSE '[0,' || CAST(p_size % 7 AS VARCHAR) || ')' END AS loops FROM part")
def loop_classes(v):
    p = v("part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 7).alias("stop"), (F.col("p_size") % 3).alias("step"))
    safe = F.when(F.col("step") == 0, F.lit(None)).otherwise(F.col("step"))
    loops = F.when((F.col("step") == 0) & (F.col("stop") > 0), "Infinite").otherwise(traces.loop_class(F.lit(0), F.col("stop"), safe))
    return p.select("id", loops.alias("loops"))


@query("C7", "SELECT algo_id, STRING_AGG(DISTINCT CASE class WHEN 'loop' THEN 'pointer' WHEN 'expr' THEN 'call' WHEN 'alternative' THEN 'member' ELSE 'array' END, ',' ORDER BY CASE class WHEN 'loop' THEN 'pointer' WHEN 'expr' THEN 'call' WHEN 'alternative' THEN 'member' ELSE 'array' END) AS concepts FROM v_nodes GROUP BY algo_id")
def concepts(v):
    c = F.when(F.col("class") == "loop", "pointer").when(F.col("class") == "expr", "call").when(F.col("class") == "alternative", "member").otherwise("array")
    return v("nodes").groupBy("algo_id").agg(F.array_join(F.sort_array(F.collect_set(c)), ",").alias("concepts"))


@query("C8", f"""WITH {_ORDER}, k AS (SELECT n.expr_id, n.idx, CASE WHEN n.prec <> n.rprec THEN 'precedence' WHEN n.assoc = o.assoc THEN 'associativity' END AS concept FROM nb n JOIN ops o ON o.expr_id = n.expr_id AND o.idx = n.r)
 SELECT expr_id, concept, CAST(COUNT(*) AS BIGINT) AS n FROM k WHERE concept IS NOT NULL GROUP BY expr_id, concept""")
def operator_relations(v):
    n = ex.neighbours(ex.operators(v("tokens"), jsonio.operators(v.spark)))
    concept = F.when(F.col("precedence") != F.col("r_precedence"), "precedence").when(F.col("associativity") == F.col("r_associativity"), "associativity")
    return n.select("expr_id", concept.alias("concept")).where("concept is not null").groupBy("expr_id", "concept").agg(F.count("*").alias("n"))


@query("C9", "SELECT id, SUBSTR('prefix_' || name || '_abcdefghijkl', 1, LENGTH('prefix_' || name || '_abcdefghijkl') - 12) AS name FROM v_templates")
def template_names(v):
    return v("templates").select("id", text.template_name(F.concat(F.lit("prefix__"), "name", F.lit("__abcdefghijkl__1234"))).alias("name"))


@query("C10", "SELECT id, ':n' || CAST(id AS VARCHAR) || ' a :return , :stmt' AS line FROM v_templates")
def patched_lines(v):
    return v("templates").select("id", text.patched_turtle(F.concat(F.lit(":n"), F.col("id").cast("string"), F.lit(" a :return  :stmt"))).alias("line"))


@query("C11", "SELECT algo_id, STRING_AGG(class || '_' || CAST(node AS VARCHAR) || ';', ' ' ORDER BY node) AS code FROM v_nodes GROUP BY algo_id")
def printed(v):
    n = v("nodes").groupBy("algo_id").agg(F.array_sort(F.collect_list(F.struct("node", "class"))).alias("s"))
    return n.select("algo_id", F.array_join(F.transform("s", lambda x: F.concat(x["class"], F.lit("_"), x["node"].cast("string"), F.lit(";"))), " ").alias("code"))


# Traces -----------------------------------------------------------------------------------------


def ways(v, parity: int):
    """Each class of a program's left (0) or right (1) parts of a statement as a partial trace."""
    n = v("nodes").where(f"parent is not null and node % 2 = {parity}")
    way = F.struct((F.col("node") % 3 + 1).alias("len"), F.lit(1).alias("depth"), F.array(F.lit("joint") if parity else F.col("class"), F.col("class") if parity else F.lit("joint")).alias("acts"), F.array("class").alias("mistakes"), F.lit(False).alias("invalid"))
    return n.select("algo_id", "parent", "node", way.alias("way"))


@query("E1", "SELECT a.algo_id, a.node AS left_node, b.node AS right_node, CAST(a.node % 3 + 1 + b.node % 3 + 1 AS BIGINT) AS len, a.class || ',joint,' || b.class AS acts FROM v_nodes a JOIN v_nodes b ON b.algo_id = a.algo_id AND b.parent = a.parent WHERE a.node % 2 = 0 AND b.node % 2 = 1")
def combined_ways(v):
    a = ways(v, 0).withColumnsRenamed({"node": "left_node", "way": "a"})
    b = ways(v, 1).withColumnsRenamed({"node": "right_node", "way": "b"})
    both = a.join(b, ["algo_id", "parent"]).withColumn("w", traces.combined(F.col("a"), F.col("b")))
    return both.select("algo_id", "left_node", "right_node", "w.len", F.array_join("w.acts", ",").alias("acts"))


@query("E2", "SELECT a.algo_id, a.parent, CAST(COUNT(*) AS BIGINT) AS n FROM v_nodes a JOIN v_nodes b ON b.algo_id = a.algo_id AND b.parent = a.parent GROUP BY a.algo_id, a.parent")
def products(v):
    """Every part of a statement with every one of the same statement."""
    n = v("nodes").select("algo_id", "parent", "node")
    return n.join(n.withColumnRenamed("node", "other"), ["algo_id", "parent"]).groupBy("algo_id", "parent").agg(F.count("*").alias("n"))


@query("E3")
def statement_traces(v):
    """Ways of a sequence of two statements, pruned after the product."""
    out = traces.product(ways(v, 0).drop("node"), ways(v, 1).drop("node"), ["algo_id", "parent"])
    return out.select("algo_id", "parent", "way.len", F.array_join("way.mistakes", ",").alias("mistakes"), F.array_join("way.acts", ",").alias("acts"))


@query("E4", "SELECT algo_id, node, CASE WHEN class = 'alternative' THEN 'return' WHEN class = 'loop' THEN 'break' ELSE 'normal' END AS exit_bound, CAST(COUNT(*) OVER (PARTITION BY algo_id, CASE WHEN class = 'alternative' THEN 'return' WHEN class = 'loop' THEN 'break' ELSE 'normal' END) AS BIGINT) AS ways FROM v_nodes")
def exits(v):
    from pyspark.sql import Window as W

    e = F.when(F.col("class") == "alternative", "return").when(F.col("class") == "loop", "break").otherwise("normal")
    n = v("nodes").withColumn("exit_bound", e)
    return n.select("algo_id", "node", "exit_bound", F.count("*").over(W.partitionBy("algo_id", "exit_bound")).alias("ways"))


@query("E5", "SELECT trace_id, step, b.value, action_id * 2 + b.value AS target FROM v_acts JOIN (VALUES (0), (1)) b(value) ON class IN ('loop', 'alternative') OR b.value = 0")
def transitions(v):
    """Acts with a condition branch by its value, others go on once."""
    two = F.col("class").isin("loop", "alternative")
    a = v("acts").withColumn("value", F.explode(F.when(two, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return a.select("trace_id", "step", "value", (F.col("action_id") * 2 + F.col("value")).alias("target"))


@query("E6", "SELECT id, CASE WHEN id % 2 = 0 THEN '01100000' ELSE '10011111' END AS vals FROM v_laws")
def boolean_values(v):
    show = lambda c: F.array_join(F.transform(c, lambda b: F.when(b, "1").otherwise("0")), "")
    return v("laws").select("id", F.when(F.col("id") % 2 == 0, show(traces.generated(1, 2))).otherwise(show(traces.generated(1, 2, True))).alias("vals"))


@query("E7", "SELECT p_partkey AS id, CAST(p_size % 4 AS VARCHAR) AS init, CASE WHEN p_size % 2 = 0 THEN '<' ELSE '<=' END AS op, CAST(p_size AS VARCHAR) AS bound FROM part")
def loop_headers(v):
    head = F.concat(F.lit("i = "), (F.col("p_size") % 4).cast("string"), F.lit("; i "), F.when(F.col("p_size") % 2 == 0, "<").otherwise("<="), F.lit(" "), F.col("p_size").cast("string"))
    init, op, bound = traces.loop_bounds(head)
    return v("part").select(F.col("p_partkey").alias("id"), init.alias("init"), op.alias("op"), bound.alias("bound"))


@query("E8", "SELECT trace_id, CAST(step - 1 AS BIGINT) AS place, action_id FROM v_acts")
def trace_graph(v):
    t = v("acts").groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("step", "action_id"))).alias("acts"))
    return t.select("trace_id", F.posexplode("acts").alias("place", "a")).select("trace_id", "place", "a.action_id")


@query("E9", """WITH p AS (SELECT expr_id, COUNT(*) AS n FROM v_tokens WHERE text = '&&' GROUP BY expr_id),
 k AS (SELECT expr_id, n, UNNEST(RANGE(0, n + 1)) AS k FROM p)
 SELECT expr_id, CASE WHEN k < n THEN REPEAT('t', CAST(k AS INT)) || 'f' ELSE REPEAT('t', CAST(n AS INT)) END AS name FROM k""")
def expression_variants(v):
    """One t or f at each && operand, ended by the first f."""
    points = v("tokens").where("text = '&&'").groupBy("expr_id").agg(F.count("*").alias("n"))
    return traces.variants(points)


_E10 = "0.39399354 + 0.16434003 * (bit_count(concept_bits) + 2) + 0.01391854 * solution_steps + 0.05685927 * (LENGTH(name) + 1)"


@query("E10", f"SELECT id, ROUND(1 / (1 + EXP(-(({_E10}) - 2) * 5)), 4) AS complexity FROM v_questions_meta")
def flow_complexity(v):
    q = v("questions_meta")
    return q.select("id", numeric.control_flow_complexity(F.bit_count("concept_bits"), F.col("solution_steps"), F.col("name")).alias("complexity"))


@query("E11", "SELECT id, ROUND(1 / (1 + EXP(-(0.18549906 * solution_steps - 0.01883239 * bit_count(violation_bits)))), 6) AS complexity FROM v_questions_meta")
def expr_complexity(v):
    q = v("questions_meta")
    return q.select("id", F.round(numeric.expression_complexity(F.col("solution_steps"), F.bit_count("violation_bits")), 6).alias("complexity"))


@query("E12", "SELECT trace_id, CAST(MAX(CASE WHEN class = 'loop' AND reason = 0 THEN 1 ELSE 0 END) AS BIGINT) AS loop_first_false, CAST(MAX(CASE WHEN class = 'alternative' AND reason = 1 THEN 1 ELSE 0 END) AS BIGINT) AS if_true FROM v_acts GROUP BY trace_id")
def trace_flags(v):
    flag = lambda c, r: F.max(((F.col("class") == c) & (F.col("reason") == r)).cast("bigint"))
    return v("acts").groupBy("trace_id").agg(flag("loop", 0).alias("loop_first_false"), flag("alternative", 1).alias("if_true"))


@query("E13", "SELECT algo_id, 'has_' || class AS concept FROM v_nodes GROUP BY algo_id, class UNION ALL SELECT algo_id, 'seq_longer_than1' FROM v_nodes WHERE parent = 0 GROUP BY algo_id HAVING COUNT(*) > 1")
def concept_list(v):
    n = v("nodes")
    has = n.select("algo_id", F.concat(F.lit("has_"), "class").alias("concept")).distinct()
    long = n.where("parent = 0").groupBy("algo_id").count().where("count > 1").select("algo_id", F.lit("seq_longer_than1").alias("concept"))
    return has.unionByName(long)


@query("E14", "SELECT q.id, q.name || '_' || t.name AS name, q.concept_bits | t.concept_bits AS bits, q.solution_steps AS steps, ROUND(q.integral_complexity, 4) AS complexity FROM v_questions_meta q JOIN v_templates t ON t.id = q.template_id")
def assembled(v):
    t = v("templates").select(F.col("id").alias("template_id"), F.col("name").alias("tn"), F.col("concept_bits").cast("bigint").alias("tb"))
    q = v("questions_meta").join(t, "template_id")
    return q.select("id", F.concat_ws("_", "name", "tn").alias("name"), F.col("concept_bits").bitwiseOR(F.col("tb")).alias("bits"), F.col("solution_steps").alias("steps"), F.round("integral_complexity", 4).alias("complexity"))


# Scalars ----------------------------------------------------------------------------------------


@query("B1", "SELECT id, CAST(bit_count(concept_bits & 23) AS BIGINT) AS n FROM v_questions_meta")
def popcount(v):
    return v("questions_meta").select("id", masks.hits(F.col("concept_bits"), 23).alias("n"))


@query("B2", "SELECT id, concept_bits & 6 AS a, concept_bits | 6 AS o, concept_bits - (concept_bits & 6) AS n FROM v_questions_meta")
def and_or_not(v):
    c = F.col("concept_bits")
    return v("questions_meta").select("id", c.bitwiseAND(F.lit(6)).alias("a"), c.bitwiseOR(F.lit(6)).alias("o"), masks.without(c, 6).alias("n"))


@query("B3", "SELECT id, m & 5 AS satisfied, 5 - (m & 5) AS unsatisfied FROM (SELECT id, CASE WHEN trace_concept_bits <> 0 THEN trace_concept_bits ELSE concept_bits END AS m FROM v_questions_meta) t")
def satisfied(v):
    m = F.when(F.col("trace_concept_bits") != 0, F.col("trace_concept_bits")).otherwise(F.col("concept_bits"))
    return v("questions_meta").select("id", m.bitwiseAND(F.lit(5)).alias("satisfied"), masks.without(F.lit(5).cast("bigint"), m).alias("unsatisfied"))


@query("B4", "SELECT q.id, b.bit FROM v_questions_meta q JOIN (VALUES (1), (2), (4), (8), (16), (17592186044416)) b(bit) ON (q.concept_bits & b.bit) <> 0")
def bits_of(v):
    return v("questions_meta").select("id", F.explode(masks.single_bits(F.col("concept_bits"))).alias("bit"))


@query("B5", "SELECT id, CAST((concept_bits & 16) <> 0 AS BIGINT) AS flag FROM v_questions_meta")
def flag(v):
    return v("questions_meta").select("id", (masks.both(F.col("concept_bits"), 16) != 0).cast("bigint").alias("flag"))


@query("M1", "SELECT id, CAST(FLOOR(ABS(integral_complexity - 0.25) / 0.125) AS BIGINT) AS bucket FROM v_questions_meta")
def bucket(v):
    return v("questions_meta").select("id", numeric.quotient(F.col("integral_complexity"), 0.25, 0.125).alias("bucket"))


@query("M2", "SELECT id, ROUND(0.25 + complexity * 0.5, 6) AS rescaled FROM v_requests")
def rescaled(v):
    return v("requests").select("id", F.round(numeric.rescaled(F.col("complexity"), F.lit(0.0), F.lit(1.0), F.lit(0.25), F.lit(0.75)), 6).alias("rescaled"))


@query("M3", "SELECT id, ROUND(CASE WHEN complexity <= 0.5 THEN 0.1 + (0.4 - 0.1) * complexity / 0.5 ELSE 0.4 + (0.9 - 0.4) * (complexity - 0.5) / 0.5 END, 6) AS rescaled FROM v_requests")
def rescaled_mean(v):
    return v("requests").select("id", F.round(numeric.rescaled_by_mean(F.col("complexity"), F.lit(1.0), F.lit(0.1), F.lit(0.4), F.lit(0.9)), 6).alias("rescaled"))


@query("M4", "SELECT id, ROUND(1 / (1 + EXP(-(integral_complexity * 20 - 10))), 6) AS s FROM v_questions_meta")
def sigmoids(v):
    return v("questions_meta").select("id", F.round(numeric.sigmoid(F.col("integral_complexity") * 20 - 10), 6).alias("s"))


@query("M5", "SELECT id, ABS(integral_complexity - 0.5) AS c, ABS(solution_steps - 10) AS s FROM v_questions_meta")
def distances(v):
    return v("questions_meta").select("id", F.abs(F.col("integral_complexity") - 0.5).alias("c"), F.abs(F.col("solution_steps") - 10).alias("s"))


@query("M6", "SELECT id, CAST(ROUND_EVEN(integral_complexity * 4, 0) AS DOUBLE) AS r FROM v_questions_meta")
def half_even(v):
    return v("questions_meta").select("id", F.bround(F.col("integral_complexity") * 4, 0).alias("r"))


@query("M8", "SELECT id, CAST(CEIL(solution_steps / 4.0) AS BIGINT) AS c FROM v_questions_meta")
def ceilings(v):
    return v("questions_meta").select("id", F.ceil(F.col("solution_steps") / 4).alias("c"))


@query("H1", """SELECT id, list_reduce(list_prepend(CAST(2863311530 AS BIGINT), list_transform(string_split(name, ''), lambda c: CAST(ascii(c) AS BIGINT))),
 lambda h, c, i: xor(h, CASE WHEN i % 2 = 0 THEN xor((h << 7) & 4294967295, (c * (h >> 3)) & 4294967295) ELSE ~(((h << 11) & 4294967295) + xor(c, h >> 5)) END) & 4294967295) AS h FROM v_templates""")
def string_hash(v):
    return v("templates").select("id", text.mixed_hash(F.col("name")).alias("h"))


@query("H2")
def directories(v):
    return v("templates").select("id", text.hash_directories(F.col("name"), 3).alias("path"))


@query("H3", "SELECT id, REPLACE(REPLACE(REPLACE(base64(unhex(md5(name))), '+', '-'), '/', '_'), '=', '') AS h FROM v_templates")
def md5_name(v):
    return v("templates").select("id", F.translate(F.base64(F.unhex(F.md5("name"))), "+/=", "-_").alias("h"))


@query("T1", "SELECT id, 'a_b/' || name AS name FROM v_templates")
def legal_names(v):
    return v("templates").select("id", text.legal_name(F.concat(F.lit("/a  b//"), "name", F.lit("?"))).alias("name"))


@query("T2", "SELECT id, origin || CASE WHEN n = 1 THEN '' ELSE '_' || CAST(n AS VARCHAR) END AS name FROM (SELECT id, origin, ROW_NUMBER() OVER (PARTITION BY origin ORDER BY id) AS n FROM v_questions_meta) t")
def unique_names(v):
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("origin").orderBy("id"))
    return v("questions_meta").withColumn("n", n).select("id", F.concat("origin", F.when(F.col("n") == 1, "").otherwise(F.concat(F.lit("_"), F.col("n").cast("string")))).alias("name"))


@query("T3", "SELECT id, 'x = \"abc...\" + ' || name AS short FROM v_templates")
def short_names(v):
    return v("templates").select("id", text.shortened(F.concat(F.lit('x  = "abcdef" + '), "name", F.lit(" // note"))).alias("short"))


@query("T4", "SELECT algo_id, node, CASE WHEN class = 'loop' THEN 'break' WHEN class = 'expr' THEN 'return' ELSE 'stmt' END AS kind FROM v_nodes")
def retyped(v):
    code = F.when(F.col("class") == "loop", " break;").when(F.col("class") == "expr", "return x;").otherwise("breaks = 1;")
    return v("nodes").select("algo_id", "node", text.retyped(code).alias("kind"))


@query("T5", "SELECT DISTINCT verb, verb AS local FROM v_facts")
def local_names(v):
    return v("facts").select("verb").distinct().select("verb", text.local_name(F.concat(F.lit("http://bank/terms#"), "verb")).alias("local"))


@query("T6", "SELECT id, REPLACE(REPLACE(name, 't_', 'template '), '1', 'one') AS name FROM v_templates")
def replaced(v):
    out = F.col("name")
    for a, b in (("^t_", "template "), ("1", "one")):
        out = F.regexp_replace(out, a, b)
    return v("templates").select("id", out.alias("name"))


@query("T7", "SELECT id, 'a b ' || name AS text FROM v_templates")
def collapsed(v):
    return v("templates").select("id", F.regexp_replace(F.concat(F.lit("a  \n b \t"), "name"), r"\s+", " ").alias("text"))


@query("T8", "SELECT id, 'use ' || name || ' of [unknown: nobody]' AS text FROM v_templates")
def substituted(v):
    return v("templates").select("id", text.substituted(F.lit("use ${name} of ${nobody}"), F.create_map(F.lit("name"), "name")).alias("text"))


@query("T9", "SELECT id, 'The act of ' || name AS text FROM v_templates")
def localized(v):
    said = F.regexp_replace(F.concat(F.lit("!{en:the} act act of "), "name"), r"!\{\w+:(\w+)\}", "$1")
    once = F.regexp_replace(said, r"\b(\w+) \1\b", "$1")
    return v("templates").select("id", F.concat(F.upper(F.substring(once, 1, 1)), F.expr("substring(regexp_replace(regexp_replace(concat('!{en:the} act act of ', name), '!\\\\{\\\\w+:(\\\\w+)\\\\}', '$1'), '\\\\b(\\\\w+) \\\\1\\\\b', '$1'), 2)")).alias("text"))


@query("T10", "SELECT expr_id, STRING_AGG('<span id=\"' || CAST(idx AS VARCHAR) || '\">' || REPLACE(REPLACE(text, '&', '&amp;'), '<', '&lt;') || '</span>', '' ORDER BY idx) AS html FROM v_tokens GROUP BY expr_id")
def tokens_html(v):
    safe = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    span = F.concat(F.lit('<span id="'), F.col("idx").cast("string"), F.lit('">'), safe, F.lit("</span>"))
    t = v("tokens").groupBy("expr_id").agg(F.array_sort(F.collect_list(F.struct("idx", span.alias("span")))).alias("s"))
    return t.select("expr_id", F.array_join(F.transform("s", lambda x: x["span"]), "").alias("html"))


@query("T11", "SELECT id, '<b>if</b> <i>' || name || '</i>' AS html FROM v_templates")
def filled_html(v):
    return v("templates").select("id", F.regexp_replace(F.lit("<b>if</b> <i>#</i>"), F.lit("#"), F.col("name")).alias("html"))


@query("T12", "SELECT id, TRY_CAST(REPLACE(name, 't_', '') AS BIGINT) AS number, CAST(LOWER(name) LIKE 't\\_1%' ESCAPE '\\' AS BIGINT) AS starts FROM v_templates")
def string_tests(v):
    return v("templates").select("id", F.replace("name", F.lit("t_"), F.lit("")).try_cast("bigint").alias("number"), F.lower("name").startswith("t_1").cast("bigint").alias("starts"))


@query("T13", "SELECT expr_id, idx, CAST(SPLIT_PART('op__0__' || CAST(idx AS VARCHAR), '__', 3) AS BIGINT) AS place FROM v_tokens")
def operator_names(v):
    name = F.concat(F.lit("op__0__"), F.col("idx").cast("string"))
    return v("tokens").select("expr_id", "idx", F.split_part(name, F.lit("__"), F.lit(3)).cast("bigint").alias("place"))


@query("T14", "SELECT id, CASE WHEN used_count = 1 THEN '1 iteration' ELSE CAST(used_count AS VARCHAR) || ' iterations' END AS hint FROM v_questions_meta")
def plural(v):
    n = F.col("used_count")
    return v("questions_meta").select("id", F.concat(n.cast("string"), F.when(n == 1, " iteration").otherwise(" iterations")).alias("hint"))


@query("T15", "SELECT n.algo_id, n.node, COALESCE(m.message, n.class) AS message FROM v_nodes n LEFT JOIN (VALUES ('loop', 'the loop'), ('expr', 'the condition')) m(class, message) ON m.class = n.class")
def messages(v):
    m = v.rows("class string, message string", ("loop", "the loop"), ("expr", "the condition"))
    return v("nodes").join(F.broadcast(m), "class", "left").select("algo_id", "node", F.coalesce("message", "class").alias("message"))


@query("T16", "SELECT l.id, TRIM(t.tag) AS tag FROM v_laws l, UNNEST(STRING_SPLIT(l.tags, ',')) t(tag) WHERE TRIM(t.tag) <> ''")
def tags(v):
    from .filters import tag_list

    return v("laws").select("id", F.explode(F.transform(tag_list("tags"), lambda t: F.trim(t))).alias("tag"))


@query("D0")
def created_now(v):
    return v("laws").select("id", (F.current_timestamp() > F.lit("2020-01-01").cast("timestamp")).alias("is_new"))


@query("X1", "SELECT reason, class, CAST(COUNT(*) AS BIGINT) AS n FROM v_acts GROUP BY reason, class")
def counts(v):
    return v("acts").groupBy("reason", "class").agg(F.count("*").alias("n"))


@query("X2", "SELECT trace_id, action_id, STRING_AGG(CAST(reason AS VARCHAR), '' ORDER BY step) AS vals FROM v_acts WHERE class = 'expr' GROUP BY trace_id, action_id")
def condition_values(v):
    t = v("acts").where("class = 'expr'").groupBy("trace_id", "action_id").agg(F.array_sort(F.collect_list(F.struct("step", "reason"))).alias("s"))
    return t.select("trace_id", "action_id", F.array_join(F.transform("s", lambda x: x["reason"].cast("string")), "").alias("vals"))


@query("X3", "SELECT id, CAST(solution_steps AS DOUBLE) AS steps, is_draft = 1 AS draft FROM v_questions_meta")
def feature_json(v):
    q = v("questions_meta").select("id", F.to_json(F.struct(F.create_map(F.lit("draft"), F.col("is_draft") == 1).alias("flags"), F.create_map(F.lit("steps"), F.col("solution_steps").cast("double")).alias("numeric"))).alias("j"))
    f = q.select("id", F.from_json("j", "flags map<string, boolean>, numeric map<string, double>").alias("f"))
    return f.select("id", F.col("f.numeric")["steps"].alias("steps"), F.col("f.flags")["draft"].alias("draft"))


# Writes -----------------------------------------------------------------------------------------


@query("D1", "SELECT id, CASE WHEN id % 7 = 0 AND id < 700 THEN 9 ELSE stage END AS stage FROM v_templates UNION ALL SELECT 1000000, 9")
def upserted(v):
    # Rows are found by name, and the new one's is no template's: it is added even where its id is taken.
    t = v("templates").select("name", "id", F.col("stage").cast("bigint").alias("stage"))
    changes = t.where("id % 7 = 0 and id < 700").select("name", "id", F.lit(9).cast("bigint").alias("stage")).distinct()
    changes = changes.unionByName(v.rows("name string, id bigint, stage bigint", ("new", 1000000, 9)))
    return writes.upserted(t, changes, ["name"]).select("id", "stage")


@query("D2", "SELECT * FROM (VALUES ('loop', 1), ('expr', 2), ('alternative', 4), ('sequence', 8), ('stmt', 16)) t(name, bit)")
def allocated(v):
    known = v.rows("name string, bit bigint", ("loop", 1), ("expr", 2))
    return writes.allocated(known, v("nodes").select(F.col("class").alias("name")))


@query("D3", "SELECT id, CASE WHEN qt_s_graph IS NULL THEN stage + 10 ELSE stage + 1 END AS stage FROM v_templates")
def next_stages(v):
    return v("templates").select("id", F.when(F.col("qt_s_graph").isNull(), F.col("stage") + 10).otherwise(F.col("stage") + 1).alias("stage"))


@query("D4", "SELECT id, GREATEST(stage, CASE WHEN id % 2 = 0 THEN 2 ELSE stage END) AS stage FROM v_templates")
def only_forward(v):
    t = v("templates").select("id", "stage")
    return writes.advanced(t, t.where("id % 2 = 0").select("id", F.lit(2).alias("stage")), "id")


@query("D5", "SELECT q.id, CAST(q.used_count + COALESCE(u.n, 0) AS BIGINT) AS used_count FROM v_questions_meta q LEFT JOIN (SELECT id, COUNT(*) AS n FROM (SELECT MIN(id % 1500) AS id FROM v_requests GROUP BY attempt_id HAVING COUNT(*) = 1) o GROUP BY id) u ON u.id = q.id")
def usage(v):
    loaded = v("requests").select(F.col("attempt_id").alias("request"), (F.col("id") % 1500).alias("id"))
    return writes.used(v("questions_meta").select("id", "used_count"), loaded, "id").select("id", "used_count")


@query("D6", "SELECT id FROM v_questions_meta WHERE template_id <> 7")
def deleted(v):
    return v("questions_meta").join(v.rows("template_id bigint", (7,)), "template_id", "left_anti").select("id")


@query("D7", "SELECT subject, verb, CASE WHEN subject = 'n1' AND verb = 'in_region' THEN 'r9' ELSE object END AS object FROM v_facts")
def set_object(v):
    return fx.replaced(v("facts"), v.rows("subject string, verb string, object string", ("n1", "in_region", "r9")))


@query("D8", "SELECT subject, CASE WHEN subject = 'n2' THEN 'lies_in' ELSE verb END AS verb, object FROM v_facts WHERE verb = 'in_region'")
def patched_facts(v):
    f = v("facts").where("verb = 'in_region'")
    p = f.where("subject = 'n2'").select(F.col("subject").alias("old_subject"), F.col("verb").alias("old_verb"), F.col("object").alias("old_object"), F.lit(None).cast("string").alias("new_subject"), F.lit("lies_in").alias("new_verb"), F.lit(None).cast("string").alias("new_object"))
    return fx.patched(f, p)


@query("D9", "SELECT id, CASE WHEN qt_s_graph IS NULL THEN 1 WHEN id % 5 = 0 THEN 2 ELSE 3 END AS reached FROM v_templates")
def reached(v):
    paths = [F.col("name"), F.col("qt_s_graph"), F.when(F.col("id") % 5 != 0, F.col("name"))]
    return v("templates").select("id", writes.reached_stage(paths).alias("reached"))


@query("D10", "SELECT id, concept_bits | 64 AS ored, 64 AS replaced FROM v_questions_meta")
def or_bits(v):
    return v("questions_meta").select("id", F.col("concept_bits").bitwiseOR(F.lit(64)).alias("ored"), F.lit(64).alias("replaced"))


@query("D11", "SELECT c_custkey AS id, '{\"name\":\"' || c_name || '\",\"stages\":[' || CAST(c_nationkey AS VARCHAR) || ',1]}' AS card FROM customer")
def exercise_card(v):
    return v("customer").select(F.col("c_custkey").alias("id"), F.to_json(F.struct(F.col("c_name").alias("name"), F.array("c_nationkey", F.lit(1)).alias("stages"))).alias("card"))

"""Derived views: the bank's tables made from the given ones by text that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations")

# Fixed formulas of the fixtures; integer columns that come out of them are cast where used.
VIEWS: dict[str, str] = {
    "v_questions_meta": """
SELECT o_orderkey AS id, 'q_' || CAST(o_orderkey - o_orderkey % 4 AS STRING) AS name,
       CASE WHEN (o_orderkey - o_orderkey % 4) % 3 = 0 THEN 'expression' ELSE 'ctrl_flow' END AS domain_shortname,
       o_orderkey % 200 AS template_id,
       CASE WHEN o_orderkey % 10 < 6 THEN 3 WHEN o_orderkey % 10 < 9 THEN 4 ELSE 2 END AS stage,
       CASE WHEN o_orderkey % 10 < 6 THEN 0 ELSE 1 END AS is_draft,
       o_orderkey % 2 + (CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END) + (CASE WHEN o_orderkey % 5 = 0 THEN 4 ELSE 0 END)
         + (CASE WHEN o_orderkey % 7 = 0 THEN 8 ELSE 0 END) + (CASE WHEN o_custkey % 4 = 0 THEN 16 ELSE 0 END)
         + (CASE WHEN o_orderkey % 11 = 0 THEN 17592186044416 ELSE 0 END) AS concept_bits,
       CASE WHEN (o_orderkey - o_orderkey % 4) % 3 = 0 THEN 0
            ELSE o_orderkey % 2 + (CASE WHEN o_orderkey % 5 = 0 THEN 4 ELSE 0 END) END AS trace_concept_bits,
       (CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN o_custkey % 3 = 0 THEN 2 ELSE 0 END)
         + (CASE WHEN o_custkey % 5 = 0 THEN 4 ELSE 0 END) + (CASE WHEN o_orderkey % 6 = 0 THEN 128 ELSE 0 END) AS violation_bits,
       CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 2 ELSE 4 END AS law_bits,
       CAST(o_orderkey % 65 AS DOUBLE) / 64 AS integral_complexity,
       2 + o_orderkey % 29 AS solution_steps, o_orderkey % 13 AS used_count,
       'repo_' || CAST(o_custkey % 17 AS STRING) AS origin
FROM orders""",
    "v_templates": """
SELECT p_partkey AS id, 't_' || CAST(p_partkey AS STRING) AS name,
       (CASE WHEN p_partkey % 2 = 0 THEN 32 ELSE 0 END) + (CASE WHEN p_partkey % 9 = 0 THEN 64 ELSE 0 END) AS concept_bits,
       CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 3 END AS stage,
       CASE WHEN p_partkey < 150 THEN 'qt_s/' || CAST(p_partkey AS STRING) ELSE NULL END AS qt_s_graph,
       1024 + (p_size * 997) % 50000 AS file_size
FROM part""",
    "v_interactions": """
SELECT event_id AS id, user_id % 5 AS exercise_id, user_id AS attempt_id, user_id * 10 + event_id % 10 AS question_id,
       ROW_NUMBER() OVER (PARTITION BY user_id * 10 + event_id % 10 ORDER BY ts, event_id) AS order_number,
       CASE WHEN event_type = 'error' THEN 1 + event_id % 2 ELSE 0 END AS violations_count,
       CASE WHEN event_type IN ('purchase', 'click') THEN 1 ELSE 0 END AS correct_laws_count,
       CASE WHEN event_type = 'signup' THEN -1 ELSE event_id % 6 END AS interactions_left,
       CAST(event_id % 65 AS DOUBLE) / 64 AS grade
FROM events""",
    "v_nodes": """
SELECT p_partkey % 20 AS algo_id, CAST((p_partkey - p_partkey % 20) / 20 AS BIGINT) AS node,
       CASE WHEN p_partkey < 20 THEN NULL
            ELSE CAST(FLOOR(((p_partkey - p_partkey % 20) / 20 - 1) / 2) AS BIGINT) END AS parent,
       CASE WHEN p_partkey < 20 THEN 'sequence' WHEN p_partkey % 3 = 0 THEN 'loop' WHEN p_partkey % 7 = 0 THEN 'alternative'
            WHEN p_partkey % 2 = 0 THEN 'expr' ELSE 'stmt' END AS class
FROM part""",
    "v_concept_edges": """
SELECT p_partkey AS child, CAST(FLOOR(p_partkey / 2) AS BIGINT) AS parent FROM part WHERE p_partkey >= 1 AND p_partkey < 128
UNION
SELECT p_partkey AS child, CAST(FLOOR(p_partkey / 5) AS BIGINT) AS parent FROM part WHERE p_partkey >= 10 AND p_partkey < 128 AND p_partkey % 10 = 0""",
    "v_facts": """
SELECT 'o' || CAST(l_orderkey AS STRING) AS subject, 'line' AS verb, 'xsd:int' AS object_type, CAST(l_linenumber AS STRING) AS object FROM lineitem
UNION ALL SELECT 's' || CAST(s_suppkey AS STRING), 'in_nation', 'rdf:resource', 'n' || CAST(s_nationkey AS STRING) FROM supplier
UNION ALL SELECT 'n' || CAST(n_nationkey AS STRING), 'in_region', 'rdf:resource', 'r' || CAST(n_regionkey AS STRING) FROM nation
UNION ALL SELECT 'r' || CAST(r_regionkey AS STRING), 'label', 'xsd:string', r_name FROM region""",
    "v_tokens": """
SELECT p.p_partkey AS expr_id, k.k AS idx,
       CASE WHEN k.k % 2 = 1 THEN 'variable' ELSE 'operator' END AS token_type,
       CASE WHEN k.k % 2 = 1 THEN 'v' || CAST((p.p_partkey + k.k) % 7 AS STRING)
            WHEN (p.p_partkey * 3 + k.k * 5) % 6 = 0 THEN '+' WHEN (p.p_partkey * 3 + k.k * 5) % 6 = 1 THEN '*'
            WHEN (p.p_partkey * 3 + k.k * 5) % 6 = 2 THEN '<' WHEN (p.p_partkey * 3 + k.k * 5) % 6 = 3 THEN '&&'
            WHEN (p.p_partkey * 3 + k.k * 5) % 6 = 4 THEN '=' ELSE '-' END AS text
FROM part p CROSS JOIN (VALUES (1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11),(12),(13),(14),(15),(16),(17),(18),(19)) k(k)
WHERE k.k <= 7 + 2 * (p.p_partkey % 7)""",
    "v_requests": """
SELECT event_id AS id, user_id AS attempt_id, event_id % 40 AS found_count, user_id % 2 AS outdated,
       1 + event_id % 7 AS concept_mask, event_id % 3 AS violation_mask, (event_id % 5) * 4 AS denied_mask,
       2 + event_id % 5 AS steps_min, 12 + event_id % 17 AS steps_max, CAST(event_id % 65 AS DOUBLE) / 64 AS complexity
FROM events""",
    "v_laws": """
SELECT n_nationkey AS id, 'law_' || CAST(n_nationkey AS STRING) AS name, n_nationkey % 3 AS salience, n_nationkey % 2 AS positive,
       CASE WHEN n_nationkey % 4 = 0 THEN 'C' WHEN n_nationkey % 4 = 1 THEN 'C, base' WHEN n_nationkey % 4 = 2 THEN 'base, loops ,' ELSE '' END AS tags,
       CASE WHEN n_nationkey = 0 THEN NULL ELSE CAST(FLOOR(n_nationkey / 3) AS BIGINT) END AS implied_by
FROM nation""",
    "v_acts": """
SELECT user_id AS trace_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, event_id % 12 AS action_id,
       CASE WHEN event_id % 2 = 0 THEN 'begin' ELSE 'end' END AS phase,
       CASE WHEN event_type = 'error' THEN 'loop' WHEN event_type = 'view' THEN 'alternative' WHEN event_type = 'click' THEN 'expr' ELSE 'stmt' END AS class,
       event_id % 3 AS reason
FROM events""",
    "v_sources": """
SELECT p_partkey AS id, 'void f' || CAST(p_partkey AS STRING) || '(int n) { int i = 0; '
       || CASE p_partkey % 6 WHEN 0 THEN 'for (i = 0; i < n; i++) { g(i); }' WHEN 1 THEN 'while (i < n) i++;'
               WHEN 2 THEN 'do { if (i) break; else continue; } while (i < n);'
               WHEN 3 THEN 'if (n < 0) return; else if (n == 0) { } else g(n);'
               WHEN 4 THEN 'switch (n) { case 1: g(1); }' ELSE ';' END || ' return; }' AS code
FROM part""",
}


def needed(sql: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]


def with_views(sql: str) -> str:
    """SQL that only the given tables are needed for: the views it names come first."""
    parts = [f"{v} AS ({VIEWS[v]})" for v in needed(sql)]
    if not parts:
        return sql
    m = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    if m:
        return f"WITH {'RECURSIVE ' if m[1] else ''}{', '.join(parts)}, {sql[m.end() :]}"
    return f"WITH {', '.join(parts)} {sql}"


class Bank:
    """The tables and views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        """A given table by its name, or a view by its name without ``v_``."""
        if name in TABLES:
            return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self.sql(VIEWS[f"v_{name}"])

    def sql(self, text: str) -> DataFrame:
        for t in TABLES:
            text = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 parquet.`{self.dir}/{t}.parquet`", text)
        return self.spark.sql(text)

    def rows(self, schema: str, *values: tuple) -> DataFrame:
        return self.spark.createDataFrame(list(values), schema)

"""Operators on small frames: worked values, properties, edge cases."""

from __future__ import annotations

import json

import hypothesis.strategies as st
import pytest
from hypothesis import HealthCheck, given, settings
from pyspark.sql import functions as F

from tessera.functions import masks, numeric, text
from tessera.operators import facts as fx
from tessera.operators import rules, traces, writes
from tessera.operators.closure import bag_closure, closure
from tessera.sources import files, jsonio, rdfxml, turtle
from tessera.streaming import stages

T3 = "subject string, verb string, object string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_boolean_generator(spark):
    assert one(spark, traces.generated(1, 2, length=6)) == [False, True, True, False, False, False]
    assert one(spark, traces.generated(1, 2, True, length=4)) == [True, False, False, True]


def test_single_bits(spark):
    assert one(spark, masks.single_bits(F.lit(109).cast("bigint"))) == [1, 4, 8, 32, 64]
    assert one(spark, masks.single_bits(F.lit(0).cast("bigint"))) == []
    assert one(spark, masks.single_bits(F.lit(1 << 62).cast("bigint"))) == [1 << 62]


def test_mask_predicates(spark):
    m = F.lit(0b1011).cast("bigint")
    assert one(spark, masks.fits(m, 1, 0b1010, 2, 0b100, 0b1000, 1)) is True
    assert one(spark, masks.has_some(m, 0)) is True
    assert one(spark, masks.has_none(F.lit(None).cast("bigint"), 7)) is True
    with pytest.raises(ValueError):
        masks.fits(m, 1, 0, 0, 1)


@pytest.mark.parametrize("x, y", [(0.0, 0.5), (2.0, 0.8808), (-2.0, 0.1192), (800.0, 1.0), (-800.0, 0.0)])
def test_sigmoid(spark, x, y):
    assert abs(one(spark, numeric.sigmoid(F.lit(x))) - y) < 1e-4


def test_rescaling(spark):
    assert one(spark, numeric.rescaled(F.lit(5.0), F.lit(3.0), F.lit(3.0), F.lit(0.2), F.lit(0.9))) == 0.2
    mean = lambda x: one(spark, numeric.rescaled_by_mean(F.lit(x), F.lit(1.0), F.lit(0.1), F.lit(0.4), F.lit(0.9)))
    assert (mean(0.0), mean(0.5), mean(1.0)) == (0.1, 0.4, 0.9)


def test_mixed_hash_is_stable(spark):
    def plain(s):
        h, m = 0xAAAAAAAA, (1 << 32) - 1
        for i, c in enumerate(s):
            x = (((h << 7) & m) ^ (ord(c) * (h >> 3) & m)) if i % 2 == 0 else ~(((h << 11) & m) + (ord(c) ^ (h >> 5)))
            h = (h ^ x) & m
        return h

    for s in ("", "a", "abc", "void main() { return 0; }"):
        assert one(spark, text.mixed_hash(F.lit(s))) == plain(s)


def test_substitution(spark):
    out = text.substituted(F.lit("${a}-${b}"), F.create_map(F.lit("a"), F.lit("1")))
    assert one(spark, out) == "1-[unknown: b]"


def test_turtle_round_trip(spark, tmp_path):
    f = spark.createDataFrame([("a", "v", "xsd:int", "3"), ("a", "w", "xsd:string", 'say "hi" \\ bye'), ("b", "x", "rdf:resource", "a")], "subject string, verb string, object_type string, object string")
    turtle.write(f, str(tmp_path / "t"))
    got = {tuple(r) for r in turtle.read(spark, str(tmp_path / "t")).collect()}
    assert got == {("a", "v", "3"), ("a", "w", 'say "hi" \\ bye'), ("b", "x", "a")}


def test_rdfxml(spark, tmp_path):
    p = tmp_path / "o.rdf"
    p.write_text('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:s="http://s#"><s:Class rdf:about="http://b#Loop"><s:subClassOf rdf:resource="http://b#Action"/><s:label>loop</s:label></s:Class></rdf:RDF>')
    assert {tuple(r) for r in rdfxml.read(spark, str(p)).collect()} == {("Loop", "type", "Class"), ("Loop", "subClassOf", "Action"), ("Loop", "label", "loop")}


def test_files_listed(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.ttl").write_text("12345")
    (tmp_path / "y.txt").write_text("1")
    assert [r["length"] for r in files.listed(spark, str(tmp_path), "*.ttl").collect()] == [5]


def test_facts(spark):
    f = spark.createDataFrame([("a", "v", "1"), ("a", "v", "1"), ("b", "v", "2")], T3)
    assert fx.as_set(f).count() == 2
    assert fx.matching(f, obj="2").count() == 1 and fx.matching(f).count() == 3
    assert fx.of_verbs(f, None).count() == 3
    assert fx.without_like(f, spark.createDataFrame([(None, None, "1")], T3)).count() == 1
    assert fx.without_like(f, spark.createDataFrame([(None, None, None)], T3)).count() == 0
    assert fx.with_new(f, f).count() == 3


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=1, max_size=12))
def test_closure_on_any_graph(spark, pairs):
    """Cycles end, and the closure is that of a plain search."""
    got = {(r["ancestor"], r["node"]) for r in closure(spark.createDataFrame(sorted(pairs), "parent bigint, child bigint")).collect()}
    nodes = {x for p in pairs for x in p}
    want = set()
    for a in nodes:
        seen, todo = {a}, [a]
        while todo:
            x = todo.pop()
            for p, c in pairs:
                if p == x and c not in seen:
                    seen.add(c)
                    todo.append(c)
        want |= {(a, b) for b in seen}
    assert got == want


def test_bag_closure_counts_paths(spark):
    e = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4)], "parent bigint, child bigint")
    assert bag_closure(e, 3).where("ancestor = 1 and node = 4").count() == 2


def test_rules_reach_a_fixpoint(spark):
    f = spark.createDataFrame([("g", "a", "parent_of", "b"), ("g", "b", "parent_of", "c"), ("h", "c", "parent_of", "d")], "graph_id string, s string, p string, o string")
    new = {tuple(r) for r in rules.inferred(f, rules.CONTROL_FLOW).collect()}
    assert new == {("g", "a", "hasPartTransitive", "b"), ("g", "b", "hasPartTransitive", "c"), ("g", "a", "hasPartTransitive", "c"), ("h", "c", "hasPartTransitive", "d")}
    assert rules.inferred(f.limit(0), rules.CONTROL_FLOW).count() == 0


def test_trace_product_is_pruned(spark):
    rows = [(1, (k + 1, 1, [f"a{k}", "j"], ["m"], False)) for k in range(6)]
    schema = "g int, way struct<len: int, depth: int, acts: array<string>, mistakes: array<string>, invalid: boolean>"
    a = spark.createDataFrame(rows, schema)
    b = spark.createDataFrame([(1, (1, 2, ["j", "z"], ["n"], False))], schema)
    out = traces.product(a, b, ["g"]).collect()
    assert len(out) == traces.KEPT
    assert all(r.way.acts.count("j") == 1 and r.way.depth == 2 and r.way.mistakes == ["m", "n"] for r in out)


def test_upsert(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, name string, n int")
    c = spark.createDataFrame([(2, 9), (3, 8)], "id int, n int")
    assert {tuple(r) for r in writes.upserted(t, c, ["id"]).collect()} == {(1, "a", 1), (2, "b", 9), (3, None, 8)}
    assert {tuple(r) for r in writes.upserted(t, c, ["id"], recreate=False).collect()} == {(1, "a", 1), (2, "b", 2), (3, None, 8)}


def test_bits_run_out(spark):
    full = spark.createDataFrame([("x", 1 << 62)], "name string, bit bigint")
    with pytest.raises(Exception, match="no bit is left"):
        writes.allocated(full, spark.createDataFrame([("y",)], "name string")).collect()


def test_batches(spark):
    b = files.batched(spark.range(0, 1000, 1, 5), ["id"], 300).groupBy("batch").count().collect()
    assert {r["batch"]: r["count"] for r in b} == {0: 300, 1: 300, 2: 300, 3: 100}


def test_stage_stream(spark, tmp_path):
    rows = [(1, 1, "click"), (11, 1, "view"), (21, 1, "purchase"), (2, 1, "view")]
    for k, r in enumerate(rows):
        spark.createDataFrame([r], "event_id bigint, user_id bigint, event_type string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = stages.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert {r["id"]: r["stage"] for r in out.collect()} == {11: 3, 12: 1}


def test_variants_of_many_operands(spark):
    """An expression of n operands has n + 1 variants, also beyond ten."""
    points = spark.createDataFrame([(1, 14), (2, 1)], "expr_id bigint, n bigint")
    got = {(r["expr_id"], r["name"]) for r in traces.variants(points).collect()}
    assert got == {(e, "t" * k + ("f" if k < n else "")) for e, n in ((1, 14), (2, 1)) for k in range(n + 1)}


def test_rdf_xml_of_several_files(spark, tmp_path):
    from tessera.sources import rdfxml

    head = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://x.invalid/#">'
    for k in range(3):
        (tmp_path / f"{k}.rdf").write_text(f'{head}\n<Part rdf:about="#p{k}"><label>part {k}</label></Part>\n</rdf:RDF>')
    got = {tuple(r) for r in rdfxml.read(spark, str(tmp_path)).collect()}
    assert got == {(f"p{k}", v, o) for k in range(3) for v, o in (("type", "Part"), ("label", f"part {k}"))}


def test_numbers_of_all_rows(spark):
    from tessera.sources import files

    rows = spark.range(1000).selectExpr("id", "(id * 7919) % 101 as x").repartition(5)
    got = files.numbered(rows, ["x", "id"], "n").collect()
    assert [(r["x"], r["id"]) for r in sorted(got, key=lambda r: r["n"])] == sorted((k * 7919 % 101, k) for k in range(1000))
    assert sorted(r["n"] for r in got) == list(range(1000))


def test_closure_of_wanted_ancestors(spark):
    from tessera.operators.closure import closure

    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 4)], "parent bigint, child bigint")
    every = {tuple(r) for r in closure(edges).collect()}
    some = {tuple(r) for r in closure(edges, of=spark.createDataFrame([(2,), (77,)], "ancestor bigint")).collect()}
    assert some == {r for r in every if r[0] == 2} == {(2, 2, 0), (2, 3, 1), (2, 1, 2), (2, 4, 2)}


def test_zip_files(spark):
    rows = [(1, "b.c", b"x" * 100_000, 0), (1, "a.c", None, 0), (2, "a.c", b"", 0), (2, "a.c", b"y", 0), (None, "n", b"z", 0), (3, None, b"z", 0)]
    frame = spark.createDataFrame(rows, "id int, name string, content binary, archive int")
    back = files.unzipped(files.zipped(frame, "id"), "id").collect()
    assert sorted((str(r.id), r.name, bytes(r.content)) for r in back) == [("1", "a.c", b""), ("1", "b.c", b"x" * 100_000), ("2", "a.c", b""), ("2", "a.c", b"y"), ("None", "n", b"z")]
    assert files.unzipped(files.zipped(frame.where("false"), "id"), "id").count() == 0


def test_nested_json(spark):
    rows = [(1, 0, None, "s"), (1, 1, 0, 'a"b'), (1, 2, 0, "l"), (1, 10, 1, "e"), (1, 9, 1, "e"), (2, 5, None, "s"), (3, 0, None, "s"), (3, 7, 8, "c"), (3, 8, 7, "c")]
    frame = spark.createDataFrame(rows, "id int, node bigint, parent bigint, class string")
    leaf = lambda n, c, *inside: {"node": n, "class": c, "children": list(inside)}
    found = {r.id: json.loads(r.tree) for r in jsonio.nested(frame, "id").collect()}
    assert found[1] == leaf(0, "s", leaf(1, 'a"b', leaf(9, "e"), leaf(10, "e")), leaf(2, "l"))
    assert found[2] == leaf(5, "s") and found[3] == leaf(0, "s")


def test_widened_masks(spark):
    below = {1: 0b111, 4: 0b100, 1 << 62: 1 << 61}
    frame = spark.createDataFrame([(0,), (1,), (4,), (8,), (1 << 62,), (None,)], "m bigint")
    assert [r.x for r in frame.select(masks.widened(F.col("m"), below).alias("x")).collect()] == [0, 7, 4, 8, 3 << 61, 0]


def test_repeated_steps(spark):
    f = spark.createDataFrame([("a", "v", "b"), ("b", "w", "c"), ("c", "v", "a"), ("c", "x", "d")], T3)
    found = {(r.node, r.reached) for r in fx.repeated(f, ["v", "w"]).collect()}
    assert found == {(x, y) for x in "abc" for y in "abc"}

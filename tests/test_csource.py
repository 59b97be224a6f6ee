"""Trees of C text against worked ones."""

from __future__ import annotations

import pytest

from tessera.sources import csource


def shown(tree):
    kind, text, _, inside = tree
    return f"({' '.join([text or kind, *map(shown, inside)])})" if inside else text or kind


@pytest.mark.parametrize(
    "code, tree",
    [
        ("a + b * c - d", "(- (+ a (* b c)) d)"),
        ("a = b = c", "(= a (= b c))"),
        ("(a + b) * -c", "(* (+ a b) (- c))"),
        ("a ? b : c ? d : e", "(?: a b (?: c d e))"),
        ("(int) x + (unsigned long) y", "(+ x y)"),
        ("p->q.r[i++](x, y)", "(() ([] (.r (->q p)) (++ i)) x y)"),
        ("!a && b || c", "(|| (&& (! a) b) c)"),
        ("f(\"a;b\", 'c') /* d */ + 1.5e-3", "(+ (() f \"a;b\" 'c') 1.5e-3)"),
        ("a +", "undefined"),
        ("a b", "undefined"),
        ("(" * 100_000, "undefined"),
    ],
)
def test_expressions(code, tree):
    assert shown(csource.parsed(code, "expression")) == tree


@pytest.mark.parametrize(
    "body, tree",
    [
        ("", "(f sequence)"),
        ("x = 1; T *p = &x; a * b; goto e; e: ;", "(f (sequence x = 1 T * p = & x T undefined undefined))"),
        ("while (a) { do b(); while (c); }", "(f (sequence (a (sequence (c b ( ))))))"),
        ("for (;;) { ", "undefined"),
    ],
)
def test_functions(body, tree):
    found = csource.parsed(f"int f(int a, char *b) {{{body}}}", "function")
    if body.startswith("x"):
        assert [k for k, *_ in found[3][0][3]] == ["expression", "declaration", "declaration", "undefined", "undefined"]
    else:
        assert shown(found) == tree


def test_long_text():
    code = "+".join(f"v{i}" for i in range(50_000))
    assert sum(1 for _ in csource.rows_of(csource.parsed(code, "expression"))) == 99_999


def test_rows(spark):
    code = [(1, "a + b"), (1, "a + b"), (2, None), (3, "  "), (None, "x"), (4, "1 +")]
    frame = spark.createDataFrame([(i, c, i) for i, c in code], "id int, code string, node int")
    rows = csource.trees(frame, "expression").collect()
    sums = [("1", 0, None, "binary", 1), ("1", 1, 0, "variable", 0), ("1", 2, 0, "variable", 2)]
    expected = [*sums, *sums, ("4", 0, None, "undefined", 0), ("None", 0, None, "variable", 0)]
    assert sorted(((str(r.id), r.node, r.parent, r.kind, r.at) for r in rows), key=str) == sorted(expected, key=str)
    assert csource.trees(frame.where("false")).count() == 0
    with pytest.raises(ValueError):
        csource.trees(frame, "file")


def test_matched(spark):
    code = "a.b(c) ? x++ : -y <= z && (w += 1)"
    found = csource.matched(csource.trees(spark.createDataFrame([(1, code)], "id int, code string"), "expression"))
    assert sorted(r.matched for r in found.collect()) == ["&&", "++", "assignment", "comparison", "conditional", "member", "member_call", "unary -"]

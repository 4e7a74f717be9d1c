import random

import pytest

from quarry.operators.boolean import And, Not, Or, Word, boolean_search, evaluate, parse

SETS = {"a": {1, 2, 3, 4}, "b": {2, 3, 6}, "c": {3, 4, 6, 7}}

#: query, expression (later operand first), result
TABLE = [
    ("a b", "And(b,a)", {2, 3}), ("a AND b", "And(b,a)", {2, 3}), ("a OR b", "Or(b,a)", {1, 2, 3, 4, 6}),
    ("a AND b OR c", "And(Or(c,b),a)", {2, 3, 4}), ("a b OR c", "And(Or(c,b),a)", {2, 3, 4}), ("a OR b AND c", "And(c,Or(b,a))", {3, 4, 6}),
    ("a OR b c", "Or(And(c,b),a)", {1, 2, 3, 4, 6}), ("NOT a", "Not(a)", set()), ("a NOT b", "And(Not(b),a)", {1, 4}),
    ("a AND NOT b", "And(Not(b),a)", {1, 4}), ("NOT a AND b", "And(b,Not(a))", {6}), ("NOT a b", "Not(And(b,a))", set()),
    ("a NOT b c", "And(Not(And(c,b)),a)", {1, 2, 4}), ("b AND NOT NOT a", "And(Not(Not(a)),b)", {2, 3, 6}),
    ("a OR NOT b", "Or(Not(b),a)", {1, 2, 3, 4}), ("a OR NOT b AND c", "And(c,Or(Not(b),a))", {3, 4, 7}),
    ("c AND a OR NOT b", "And(Or(Not(b),a),c)", {3, 4}), ("NOT a AND NOT b", "And(Not(b),Not(a))", set()),
    ("NOT a AND NOT b AND c", "And(And(c,Not(b)),Not(a))", {7}), ("a AND", "a", {1, 2, 3, 4}), ("AND a", "a", {1, 2, 3, 4}),
    ("a AND OR b", "Or(b,a)", {1, 2, 3, 4, 6}), ("NOT", "None", set()), ("", "None", set()), ("a b c", "And(And(c,b),a)", {3}),
]


def shown(node):
    match node:
        case Word(text):
            return text
        case Not(of):
            return f"Not({shown(of)})"
        case And(last, first):
            return f"And({shown(last)},{shown(first)})"
        case Or(last, first):
            return f"Or({shown(last)},{shown(first)})"
    return "None"


@pytest.fixture(scope="module")
def postings(spark):
    return spark.createDataFrame([(t, d) for t, ds in SETS.items() for d in ds], "term string, doc_id long").cache()


@pytest.mark.parametrize(("query", "expression", "result"), TABLE)
def test_grammar(query, expression, result):
    node = parse(query)
    assert shown(node) == expression
    assert evaluate(node, SETS) == result


def test_plan(spark, postings):
    for query, _, result in TABLE:
        assert {r.doc_id for r in boolean_search(postings, query).collect()} == result, query


def test_lower_case_operators():
    assert parse("a and b oR c") == parse("a AND b OR c")


def test_parentheses():
    assert shown(parse("(a b) OR c")) == "Or(And(b,a),c)".replace("Or(And(b,a),c)", "And(Or(c,b),a)")
    assert shown(parse("(a AND b) OR c", parens=True)) == "Or(c,And(b,a))"
    assert shown(parse("a (b OR c)", parens=True)) == "And(Or(c,b),a)"
    assert evaluate(parse("a NOT (b OR c)", parens=True), SETS) == {1}


def test_standard_precedence():
    assert shown(parse("a OR b AND c", standard=True)) == "Or(And(c,b),a)"
    assert shown(parse("a b OR c", standard=True)) == "Or(c,And(b,a))"


def tree(rng, depth):
    kind = rng.randrange(4) if depth else 0
    if kind == 0:
        return Word(rng.choice("abc"))
    if kind == 1:
        return Not(tree(rng, depth - 1))
    return (And if kind == 2 else Or)(tree(rng, depth - 1), tree(rng, depth - 1))


def predicate(node, held, before):
    """`condition` with Python's booleans."""
    match node:
        case Word(text):
            return text in held
        case Not(of):
            return before and not predicate(of, held, False)
        case Or(last, first):
            return predicate(last, held, before) or predicate(first, held, before)
        case And(last, first):
            if isinstance(last, Not) and not isinstance(first, Not):
                last, first = first, last
            found = predicate(last, held, before)
            return found and predicate(first, held, found)


def test_predicate_equals_set_algebra():
    rng = random.Random(0)
    everything = set().union(*SETS.values(), {99})
    for _ in range(5000):
        node = tree(rng, 5)
        want = evaluate(node, SETS)
        got = {d for d in everything if predicate(node, {w for w, s in SETS.items() if d in s}, False)}
        assert got == want

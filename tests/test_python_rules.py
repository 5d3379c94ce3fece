"""Compiled Python rules against a plain evaluator of the same text, on made-up rows with missing values."""

import ast
import math
import random

import pytest
from pyspark.sql import functions as F

from rulewright.operators import rules
from rulewright.operators.python_rules import parse_rule
from rulewright.plans import tasks

ROWS = [(i, a, b, c, t) for i, (a, b, c, t) in enumerate((a, b, c, t) for a in (None, 1.0, 4.0, 9.5, 86.0) for b in (None, 0, 1) for c in (None, -3.25, 8.0) for t in (None, "", "x", "yy"))]
SCHEMA = "id int, age double, sepsis int, score double, ward string"

TEXTS = {
    "triggers": """
def predict_a(f):
    age = f.get('age')
    score = f['score']
    if f.get('sepsis') == 1:
        return 1
    if age is not None and age > 85:
        if score >= 8 or f.get('ward') == 'x':
            return 1
    points = 0
    if age is not None:
        if age > 3:
            points += 1
        if age >= 9.5:
            points += 1
        elif age == 4 and score is not None:
            points += 2
    if not score:
        points -= 1
    return 1 if points >= 2 else 0
""",
    "early_else": """
import os

LIMIT = 'not read'

def predict_a(features: dict) -> int:
    '''Names that only the going-on branch sets.'''
    if features.get('age') is None:
        return 3
    else:
        level = features.get('age') * 2 - 1
    if level != 7:
        weight: float = -level / 2
    else:
        weight = 0.5
    if weight < -1 < level <= 18:
        return int(weight)
    return 2 * (features.get('ward') in ['x', 'yy']) + max(0, min(level, 3), 1) + abs(weight > 0)
""",
    "defaults": """
def predict_a(features):
    s = features.get('score', 8)
    n = features.get('not there')
    if n is not None or n == 3:
        return 9
    if any([s < 0, features.get('sepsis') != 0]) and all((s is not None, not bool(features.get('ward')))):
        return 5
    return sum((s > 0, features.get('age') == s, features.get('ward') not in ('x',), True)) if s else False
""",
    "chained": "def predict_a(x):\n    p = 0\n" + "".join(f"    if x.get('age') is not None and x.get('age') > {k}:\n        p += {1 + k % 3}\n" for k in range(40)) + "    return p\n",
}


class Gone(Exception):
    pass


def plain(node, features, env):
    """What Python would do, but that comparisons with None are false (``!=`` true) and arithmetic with it is None."""
    of = lambda x: plain(x, features, env)
    match node:
        case list():
            for x in node:
                of(x)
        case ast.Return():
            raise Gone(of(node.value))
        case ast.If():
            of(node.body if of(node.test) else node.orelse)
        case ast.Assign() | ast.AnnAssign():
            env[(node.targets[0] if isinstance(node, ast.Assign) else node.target).id] = of(node.value)
        case ast.AugAssign():
            env[node.target.id] = of(ast.BinOp(node.target, node.op, node.value))
        case ast.Expr() | ast.Pass():
            pass
        case ast.Constant():
            return node.value
        case ast.Name():
            return env[node.id]
        case ast.IfExp():
            return of(node.body if of(node.test) else node.orelse)
        case ast.BoolOp():
            values = [bool(of(x)) for x in node.values]
            return all(values) if isinstance(node.op, ast.And) else any(values)
        case ast.UnaryOp():
            x = of(node.operand)
            return not x if isinstance(node.op, ast.Not) else None if x is None else -x
        case ast.BinOp():
            a, b = of(node.left), of(node.right)
            if a is None or b is None:
                return None
            return {ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Div: lambda: a / b if b else None}[type(node.op)]()
        case ast.Subscript():
            return features[node.slice.value]
        case ast.Call(func=ast.Attribute()):
            found = features.get(node.args[0].value)
            return of(node.args[1]) if found is None and len(node.args) > 1 else found
        case ast.Call():
            args = [of(x) for x in node.args]
            if node.func.id in ("sum", "any", "all"):
                args = [bool(x) if node.func.id != "sum" else x for x in args[0]]
                return {"sum": sum, "any": any, "all": all}[node.func.id](args)
            if None in args and node.func.id != "bool":
                return None
            return {"int": int, "float": float, "bool": bool, "abs": abs, "min": min, "max": max}[node.func.id](*args)
        case ast.List() | ast.Tuple():
            return [of(x) for x in node.elts]
        case ast.Compare():
            left = of(node.left)
            for op, x in zip(node.ops, node.comparators, strict=True):
                right = of(x)
                empty = left is None or right is None
                ok = {
                    ast.Is: lambda: left is right, ast.IsNot: lambda: left is not right, ast.In: lambda: left in right, ast.NotIn: lambda: left not in right,
                    ast.Eq: lambda: left == right and not empty, ast.NotEq: lambda: left != right or empty, ast.Lt: lambda: not empty and left < right,
                    ast.LtE: lambda: not empty and left <= right, ast.Gt: lambda: not empty and left > right, ast.GtE: lambda: not empty and left >= right,
                }[type(op)]()
                if not ok:
                    return False
                left = right
            return True
        case _:
            raise AssertionError(ast.dump(node))


def plain_rule(text, features):
    body = next(x for x in ast.parse(text).body if isinstance(x, ast.FunctionDef)).body
    try:
        plain(body, features, {})
    except Gone as g:
        return None if g.args[0] is None else math.trunc(g.args[0])
    raise AssertionError("no return")


def check(spark, texts):
    df = spark.createDataFrame(ROWS, SCHEMA)
    columns = set(df.columns)
    got = df.select("*", *[rules.compile_rules(t, columns).alias(f"_{k}") for k, t in texts.items()]).collect()
    for r in got:
        features = {k: v for k, v in r.asDict().items() if not k.startswith("_")}
        for k, t in texts.items():
            assert r[f"_{k}"] == plain_rule(t, features), (k, features)


def test_texts_score_as_python_says(spark):
    check(spark, TEXTS)


def made_rule(rng):
    """A random point rule with triggers, nested conditions and else branches."""
    def predicate(depth=2):
        if depth and rng.random() < 0.4:
            return f"({predicate(depth - 1)} {rng.choice(['and', 'or'])} {predicate(depth - 1)})"
        if depth and rng.random() < 0.2:
            return f"not {predicate(depth - 1)}"
        name = rng.choice(["age", "sepsis", "score"])
        return rng.choice([f"f.get('{name}') {rng.choice(['<', '<=', '>', '>=', '==', '!='])} {rng.choice([0, 1, 4, 8, 9.5, -3.25])}", f"f.get('{name}') is {rng.choice(['', 'not '])}None", f"f.get('ward') {rng.choice(['==', '!='])} 'x'", f"f.get('{name}')"])

    def block(indent, depth):
        lines = []
        for _ in range(rng.randint(1, 4)):
            pad = " " * indent
            kind = rng.random()
            if kind < 0.45 and depth:
                lines += [f"{pad}if {predicate()}:", *block(indent + 4, depth - 1)]
                if rng.random() < 0.5:
                    lines += [f"{pad}else:", *block(indent + 4, depth - 1)]
            elif kind < 0.55:
                lines.append(f"{pad}return {rng.randint(0, 3)}")
            elif kind < 0.65:
                lines.append(f"{pad}p = {rng.randint(0, 2)} if {predicate()} else q")
            else:
                lines.append(f"{pad}{rng.choice('pq')} {rng.choice(['+=', '-='])} {rng.choice([1, 2, 0.5])}")
        return lines

    return "\n".join(["def predict_a(f):", "    p = 0", "    q = 1", *block(4, 3), f"    return int(p + q >= {rng.randint(0, 3)})"])


def test_random_rules_score_as_python_says(spark):
    rng = random.Random(11)
    check(spark, {f"r{i}": made_rule(rng) for i in range(40)})


@pytest.mark.parametrize("body", ["return open('x')", "return f.get(g)", "while True:\n        return 1", "x = [i for i in f]\n    return 1", "if f.get('a'):\n        return 1", "if f.get('a'):\n        x = 1\n    return x", "f = {}\n    return 1", "return __import__('os').system('true')", "return (lambda: 1)()", "return f.a", "return", "return 1 if f.get('a') else np.nan", "x: int\n    return 1", "return f.get('a') ** 2"])
def test_outside_the_subset(body):
    with pytest.raises(ValueError):
        parse_rule(f"def predict_a(f):\n    {body}\n")


def test_names_and_functions():
    two = "def predict_a(f):\n    return 1\ndef predict_b(f):\n    return 0\n"
    assert parse_rule(two, "predict_b")[0] == "const"
    for text in (two, "x = 1", "def predict_a(f, g):\n    return 1", "@d\ndef predict_a(f):\n    return 1", "def predict_a(:"):
        with pytest.raises(ValueError):
            parse_rule(text)


def test_a_needed_column_is_checked(spark):
    df = spark.createDataFrame([(1, 2.0)], "id int, x double")
    with pytest.raises(ValueError, match="unknown column"):
        rules.score_rules(df, "def predict_a(f):\n    return 1 if f['y'] == 2 else 0")
    assert rules.score_rules(df, "def predict_a(f):\n    return 1 if f.get('y') is None and f['x'] == 2 else 0").first()["prediction"] == 1


def test_stored_python_is_validated_and_scored(spark):
    """What validation calls ok can be scored, and what can't be compiled is load_failed."""
    import json

    good, bad = tasks.RULES_PYTHON["v1"], "def predict_v1(features):\n    return eval('1')"
    raw = [(i, json.dumps({"version": "v1", "error_analysis": "", "new_policy_code": c})) for i, c in enumerate((good, bad))]
    df = spark.createDataFrame([("r", "v1", i + 1, t) for i, t in raw], "run_id string, expected_version string, attempt int, raw_text string")
    got = rules.validate_proposals(df).orderBy("attempt").collect()
    assert [r["status"] for r in got] == ["ok", "load_failed"]
    stored = spark.createDataFrame([("r", "v1", got[0]["code"])], "run_id string, version string, rule_json string")
    rows = spark.createDataFrame([(1, 10.0, None, "F"), (2, 30.0, 0.1, "O")], "id int, quantity double, discount double, linestatus string").withColumn("tax", F.lit(0.1))
    assert [r["prediction"] for r in rules.predict_final(rows, stored, "r", "v1").orderBy("id").collect()] == [1, 0]

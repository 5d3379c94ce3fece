"""Stored Python rules as Columns: the text of ``predict_<version>(features)`` is read as a syntax tree, never run.

The subset is what point rules are written in: features by ``features.get(name)``, ``features.get(name, default)`` or ``features[name]``; local
names; ``if``, ``elif``, ``else``; ``+=`` and ``-=``; comparisons, chains, ``in`` lists of constants, ``is None``; ``and``, ``or``, ``not``; arithmetic; conditional
expressions; ``int float bool abs min max sum any all``; ``return`` on every path. Anything else is a ValueError that names the line.

``parse_rule`` needs no Spark and gives an expression of nested tuples; ``rule_column`` makes one Column of it. A value that changes under a condition is a sum of
guarded terms, so a chain of ``if .. points += 1`` stays as long as its text. A missing feature is None for ``is None`` and false as a truth;
every comparison with it is false but ``!=`` and ``not in``, and arithmetic with it is missing. Numbers are compared as doubles, a feature's text by ``==`` and
``in`` with text. Imports and text between the functions are skipped; a name that they would define is unknown.
"""

from __future__ import annotations

import ast
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARISONS = {ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">="}
ARITHMETIC = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/"}
#: Operators whose value is true or false.
TRUTHS = ("cmp", "and", "or", "not", "missing", "in", "truth", "bool")
NO = ("bool", False)


class _Function:
    """The body of one rule over expressions; ``env`` has the local names."""

    def __init__(self, argument: str):
        self.argument = argument

    def fail(self, node: ast.AST, why: str):
        raise ValueError(f"line {getattr(node, 'lineno', 0)}: {why}")

    def constant(self, node: ast.AST):
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub) and isinstance(node.operand, ast.Constant) and isinstance(node.operand.value, (int, float)):
            return -node.operand.value
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float, str, bool)):
            return node.value
        self.fail(node, "a constant is needed")

    def feature(self, node: ast.AST):
        """features.get(..) or features[..], or None."""
        of_argument = lambda x: isinstance(x, ast.Name) and x.id == self.argument
        if isinstance(node, ast.Subscript) and of_argument(node.value):
            return ("feature", self.constant(node.slice), True)
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "get" and of_argument(node.func.value) and not node.keywords and 1 <= len(node.args) <= 2:
            found = ("feature", self.constant(node.args[0]), False)
            if len(node.args) == 1 or isinstance(node.args[1], ast.Constant) and node.args[1].value is None:
                return found
            return ("if", ("missing", found), self.value(node.args[1], {}), found)
        return None

    def value(self, node: ast.AST, env: dict) -> tuple:
        if (found := self.feature(node)) is not None:
            return found
        if isinstance(node, ast.Constant):
            return ("none",) if node.value is None else ("bool", node.value) if isinstance(node.value, bool) else ("const", self.constant(node))
        if isinstance(node, ast.Name):
            return env[node.id] if node.id in env else self.fail(node, f"{node.id} isn't set on every path")
        if isinstance(node, ast.IfExp):
            return self.choose(self.truth(node.test, env), self.value(node.body, env), self.value(node.orelse, env))
        if isinstance(node, ast.BinOp) and type(node.op) in ARITHMETIC:
            a, b = self.value(node.left, env), self.value(node.right, env)
            return self.plus(a, b) if isinstance(node.op, ast.Add) else self.plus(a, ("neg", b)) if isinstance(node.op, ast.Sub) else (ARITHMETIC[type(node.op)], a, b)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            x = self.value(node.operand, env)
            return ("neg", x) if isinstance(node.op, ast.USub) else x
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
            return self.call(node, env)
        if isinstance(node, (ast.Compare, ast.BoolOp, ast.UnaryOp)):
            return self.truth(node, env)
        self.fail(node, f"{type(node).__name__} isn't in the subset")

    def call(self, node: ast.Call, env: dict) -> tuple:
        name, args = node.func.id, node.args
        if name in ("sum", "any", "all", "min", "max") and len(args) == 1 and isinstance(args[0], (ast.List, ast.Tuple)):
            args = args[0].elts
        elif name in ("sum", "any", "all"):
            self.fail(node, f"{name} takes a list or a tuple")
        if name in ("any", "all"):
            return ("or" if name == "any" else "and", tuple(self.truth(x, env) for x in args))
        found = [self.value(x, env) for x in args]
        if name == "sum":
            return reduce(self.plus, found, ("sum", ()))
        if name in ("min", "max") and len(found) > 1:
            return (name, tuple(found))
        if name in ("int", "float", "abs", "bool") and len(found) == 1:
            return self.as_truth(found[0]) if name == "bool" else (name, found[0])
        self.fail(node, f"the call of {name} isn't in the subset")

    def as_truth(self, x: tuple) -> tuple:
        return x if x[0] in TRUTHS else ("truth", x)

    def truth(self, node: ast.AST, env: dict) -> tuple:
        if isinstance(node, ast.BoolOp):
            return ("and" if isinstance(node.op, ast.And) else "or", tuple(self.truth(x, env) for x in node.values))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return ("not", self.truth(node.operand, env))
        if isinstance(node, ast.Compare):
            parts, left = [], node.left
            for op, right in zip(node.ops, node.comparators, strict=True):
                parts.append(self.compare(op, left, right, env))
                left = right
            return parts[0] if len(parts) == 1 else ("and", tuple(parts))
        return self.as_truth(self.value(node, env))

    def compare(self, op: ast.cmpop, left: ast.AST, right: ast.AST, env: dict) -> tuple:
        a = self.value(left, env)
        if isinstance(op, (ast.In, ast.NotIn)):
            if not isinstance(right, (ast.List, ast.Tuple, ast.Set)):
                self.fail(right, "a list of constants is needed")
            found = ("in", a, tuple(self.constant(x) for x in right.elts))
            return ("not", found) if isinstance(op, ast.NotIn) else found
        b = self.value(right, env)
        if ("none",) in (a, b) and isinstance(op, (ast.Is, ast.IsNot, ast.Eq, ast.NotEq)):
            found = ("missing", a if b == ("none",) else b)
            return ("not", found) if isinstance(op, (ast.IsNot, ast.NotEq)) else found
        if type(op) not in COMPARISONS:
            self.fail(left, f"{type(op).__name__} isn't in the subset")
        return ("cmp", COMPARISONS[type(op)], a, b)

    def plus(self, a: tuple, b: tuple) -> tuple:
        terms = [x[1] if x[0] == "sum" else ((None, x),) for x in (a, b)]
        return ("sum", (*terms[0], *terms[1]))

    def choose(self, c: tuple, a: tuple, b: tuple) -> tuple:
        """a where c holds, else b. Sums keep the terms that both begin with, and guard the others."""
        if a == b:
            return a
        if a[0] != "sum" and b[0] != "sum":
            return ("if", c, a, b)
        x, y = (v[1] if v[0] == "sum" else ((None, v),) for v in (a, b))
        n = 0
        while n < min(len(x), len(y)) and x[n] is y[n]:
            n += 1
        guarded = lambda terms, guard: tuple((guard if g is None else ("and", (guard, g)), v) for g, v in terms)
        return ("sum", (*x[:n], *guarded(x[n:], c), *guarded(y[n:], ("not", c))))

    def run(self, body: list[ast.stmt], env: dict) -> tuple[tuple, tuple | None, dict]:
        """(whether a return was met, its value, the names after it)."""
        done, result = NO, None
        for node in body:
            if done == ("bool", True):
                break
            if isinstance(node, ast.Return):
                now, value = ("bool", True), self.value(node.value, env) if node.value is not None else self.fail(node, "a value is needed")
            elif isinstance(node, ast.If):
                c = self.truth(node.test, env)
                (d1, v1, e1), (d2, v2, e2) = self.run(node.body, dict(env)), self.run(node.orelse, dict(env))
                now = d1 if d1 == d2 else ("or", (("and", (c, d1)), ("and", (("not", c), d2))))
                value = v1 if v2 is None else v2 if v1 is None else ("if", c, v1, v2)
                if ("bool", True) in (d1, d2) and d1 != d2:  # the names of the other branch are those that go on
                    env = e2 if d1 == ("bool", True) else e1
                else:
                    env = {k: self.choose(c, e1[k], e2[k]) for k in e1 if k in e2}
            else:
                self.assign(node, env)
                continue
            if value is not None:
                result = value if result is None else ("if", done, result, value)
                done = now if done == NO else ("bool", True) if now == ("bool", True) else ("or", (done, now))
        return done, result, env

    def assign(self, node: ast.stmt, env: dict) -> None:
        if isinstance(node, ast.Pass) or isinstance(node, ast.Expr) and isinstance(node.value, ast.Constant):
            return
        if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
            name, value = node.targets[0].id, self.value(node.value, env)
        elif isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name) and node.value is not None:
            name, value = node.target.id, self.value(node.value, env)
        elif isinstance(node, ast.AugAssign) and isinstance(node.target, ast.Name) and isinstance(node.op, (ast.Add, ast.Sub)):
            name, value = node.target.id, self.value(node.value, env)
            value = self.plus(self.value(ast.copy_location(ast.Name(node.target.id), node), env), value if isinstance(node.op, ast.Add) else ("neg", value))
        else:
            self.fail(node, f"{type(node).__name__} isn't in the subset")
        if name == self.argument:
            self.fail(node, "the features can't be replaced")
        # a number begins a sum, so that what is added later under conditions is a guarded term
        env[name] = ("sum", ((None, value),)) if value[0] == "const" and not isinstance(value[1], str) else value


def parse_rule(text: str, name: str | None = None) -> tuple:
    """The expression of the only function of ``text``, or of the one called ``name``; ValueError outside the subset."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, RecursionError) as e:
        raise ValueError(f"not Python: {e}") from None
    found = [x for x in tree.body if isinstance(x, ast.FunctionDef) and name in (None, x.name)]
    if len(found) != 1:
        raise ValueError(f"{len(found)} functions{f' {name}' if name else ''}, one is needed")
    args = found[0].args
    if len(args.args) != 1 or args.vararg or args.kwarg or args.kwonlyargs or args.posonlyargs or found[0].decorator_list:
        raise ValueError("a rule takes the features and nothing else")
    done, result, _ = _Function(args.args[0].arg).run(found[0].body, {})
    if done != ("bool", True):
        raise ValueError("a path ends without a return")
    return result


def rule_column(expression: tuple, columns: set[str] | None = None) -> Column:
    """The prediction, an INT; ValueError for a column that ``features[name]`` needs and ``columns`` lacks."""

    def raw(x: tuple) -> Column:
        if x[0] == "feature":
            if columns is not None and x[1] not in columns:
                if x[2]:
                    raise ValueError(f"unknown column: {x[1]}")
                return F.lit(None).cast("string")
            return F.col(f"`{x[1]}`")
        if x[0] == "if":
            sides = [text(s) if is_text(x) else number(s) for s in x[2:]]
            return F.when(truth(x[1]), sides[0]).otherwise(sides[1])
        return F.lit(x[1]) if x[0] == "const" and isinstance(x[1], str) else number(x)

    def is_text(x: tuple) -> bool:
        return x[0] == "const" and isinstance(x[1], str) or x[0] == "if" and (is_text(x[2]) or is_text(x[3]))

    def text(x: tuple) -> Column:
        return F.lit(None).cast("string") if x[0] == "none" else raw(x).cast("string")

    def number(x: tuple) -> Column:
        kind = x[0]
        if kind in TRUTHS:
            return truth(x).cast("double")
        if kind == "const":
            return F.lit(float(x[1])) if not isinstance(x[1], str) else F.lit(x[1]).try_cast("double")
        if kind == "none":
            return F.lit(None).cast("double")
        if kind == "feature" or kind == "if" and is_text(x):
            value = raw(x).try_cast("double")
            return F.when(~F.isnan(value), value)
        if kind == "if":
            return F.when(truth(x[1]), number(x[2])).otherwise(number(x[3]))
        if kind == "sum":
            terms = [number(v) if g is None else F.when(truth(g), number(v)).otherwise(0.0) for g, v in x[1]]
            return reduce(lambda a, b: a + b, terms, F.lit(0.0)) if len(terms) != 1 else terms[0]
        if kind in ("min", "max"):
            parts = [number(v) for v in x[1]]
            least = (F.least if kind == "min" else F.greatest)(*parts)
            return F.when(reduce(lambda a, b: a & b, [p.isNotNull() for p in parts]), least)
        of = {"neg": lambda a: -a, "abs": F.abs, "float": lambda a: a, "int": lambda a: F.signum(a) * F.floor(F.abs(a))}
        if kind in of:
            return of[kind](number(x[1]))
        a, b = number(x[1]), number(x[2])
        return a * b if kind == "*" else F.try_divide(a, b)

    def truth(x: tuple) -> Column:
        """Never null."""
        kind = x[0]
        if kind == "bool":
            return F.lit(x[1])
        if kind in ("and", "or"):
            both: Callable = (lambda a, b: a & b) if kind == "and" else (lambda a, b: a | b)
            return reduce(both, map(truth, x[1]), F.lit(kind == "and"))
        if kind == "not":
            return ~truth(x[1])
        if kind == "missing":
            return (raw(x[1]) if is_text(x[1]) else number(x[1]) if x[1][0] != "feature" else F.when(raw(x[1]).cast("string") != "NaN", raw(x[1]))).isNull() if x[1][0] not in TRUTHS else F.lit(False)
        if kind == "in":
            fits = [("cmp", "==", x[1], ("const", v) if not isinstance(v, bool) else ("bool", v)) for v in x[2]]
            return truth(("or", tuple(fits)))
        if kind == "truth":
            value = number(x[1])
            said = value != 0
            if x[1][0] in ("feature", "if", "const"):
                said = F.coalesce(said, F.length(text(x[1])) > 0)
            return F.coalesce(said, F.lit(False))
        _, op, a, b = x
        if is_text(a) or is_text(b):
            a, b = text(a), text(b)
        else:
            a, b = number(a), number(b)
        found = {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
        return F.coalesce(found, F.lit(op == "!="))

    return number(expression).cast("int")

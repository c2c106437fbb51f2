"""User expressions to Columns. Only names, literals, arithmetic, comparisons, and/or: the text never reaches the SQL parser."""

from __future__ import annotations

import ast
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COMPARE = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}
_ARITHMETIC = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul}


class ExpressionError(ValueError):
    """An expression outside the grammar, or one that names an unknown column."""


def _parse(text: str) -> ast.expr:
    try:
        return ast.parse(text.strip(), mode="eval").body
    except (SyntaxError, ValueError) as e:
        raise ExpressionError(f"can't parse {text!r}") from e


def referenced(text: str) -> list[str]:
    """Column names in an expression, in order of first use."""
    return list(dict.fromkeys(n.id for n in ast.walk(_parse(text)) if isinstance(n, ast.Name)))


def divide(a: Column, b: Column) -> Column:
    """Floating division with infinities and NaN instead of errors."""
    a, b = a.cast("double"), b.cast("double")
    at_zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(b == 0, F.when(a.isNull(), F.lit(None).cast("double")).otherwise(at_zero)).otherwise(F.try_divide(a, b))


class _Compiler:
    def __init__(self, schema: T.StructType):
        self.types = {f.name: f.dataType for f in schema.fields}

    def name(self, node: ast.Name) -> Column:
        if node.id not in self.types:
            raise ExpressionError(f"unknown column {node.id!r}; columns are {', '.join(sorted(self.types))}")
        return F.col(f"`{node.id}`")

    def numeric(self, node: ast.expr) -> Column:
        if isinstance(node, ast.Name):
            return self.name(node)
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return F.lit(node.value)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -self.numeric(node.operand)
        if isinstance(node, ast.BinOp):
            a, b = self.numeric(node.left), self.numeric(node.right)
            if isinstance(node.op, ast.Div):
                return divide(a, b)
            if type(node.op) in _ARITHMETIC:
                return _ARITHMETIC[type(node.op)](a, b)
        raise ExpressionError(f"not allowed in a numeric expression: {ast.unparse(node)}")

    def comparand(self, node: ast.expr) -> tuple[Column, type | None]:
        """A side of a comparison, and the type of a literal."""
        if isinstance(node, ast.Constant) and isinstance(node.value, (str, bool)):
            return F.lit(node.value), type(node.value)
        return self.numeric(node), None if isinstance(node, ast.Name) else float

    def kind(self, node: ast.expr) -> str | None:
        if isinstance(node, ast.Constant):
            return {str: "text", bool: "boolean"}.get(type(node.value), "number")
        if isinstance(node, ast.Name):
            t = self.types.get(node.id)
            return "text" if isinstance(t, T.StringType) else "boolean" if isinstance(t, T.BooleanType) else "number" if isinstance(t, T.NumericType) else None
        return "number"

    def boolean(self, node: ast.expr) -> Column:
        if isinstance(node, ast.BoolOp):
            parts = [self.boolean(v) for v in node.values]
            out = parts[0]
            for p in parts[1:]:
                out = (out & p) if isinstance(node.op, ast.And) else (out | p)
            return out
        if isinstance(node, ast.Compare) and len(node.ops) == 1 and type(node.ops[0]) in _COMPARE:
            kinds = {self.kind(node.left), self.kind(node.comparators[0])} - {None}
            left, right = self.comparand(node.left)[0], self.comparand(node.comparators[0])[0]
            if len(kinds) > 1:
                raise ExpressionError(f"can't compare {' with '.join(sorted(kinds))}: {ast.unparse(node)}")
            return _COMPARE[type(node.ops[0])](left, right)
        raise ExpressionError(f"not allowed in a boolean expression: {ast.unparse(node)}")


def compile_numeric(text: str, schema: T.StructType) -> Column:
    """Names, numbers, unary minus, + - * /."""
    return _Compiler(schema).numeric(_parse(text))


def compile_boolean(text: str, schema: T.StructType) -> Column:
    """One comparison (== != < <= > >=), or comparisons joined by and/or."""
    return _Compiler(schema).boolean(_parse(text))


def derive(df: DataFrame, derived: list[tuple[str, str]]) -> DataFrame:
    """Adds columns in order; later ones see earlier ones."""
    for name, text in derived:
        df = df.withColumn(name, compile_numeric(text, df.schema))
    return df

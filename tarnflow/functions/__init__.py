"""Scalar expressions and typed access to fields."""

from .compiler import FUNCTIONS, compile_condition, compile_expression, functions
from .syntax import ExpressionError, parse

__all__ = ["FUNCTIONS", "ExpressionError", "compile_condition", "compile_expression", "functions", "parse"]

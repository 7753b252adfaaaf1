"""Scalar and array functions: plain Column builders and their registry."""

from tessera.functions.registry import FUNCTIONS, METHODS, Function

__all__ = ["FUNCTIONS", "METHODS", "Function"]

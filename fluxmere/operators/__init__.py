"""Operators: what USING names. An operator maps one or more DataFrames to one."""

from .base import Operator, OperatorBase, frame_operator, operator
from .catalog import OperatorCatalog

__all__ = ["Operator", "OperatorBase", "OperatorCatalog", "frame_operator", "operator"]

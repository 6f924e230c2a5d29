"""Front end of the extended SQL: tokens, clauses, safety and rewrites into plain Spark SQL."""

from .clauses import ExtendedQuery, OperatorCall, parse
from .safety import where_is_safe

__all__ = ["ExtendedQuery", "OperatorCall", "parse", "where_is_safe"]

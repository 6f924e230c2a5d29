"""What a WHERE clause may hold."""

from __future__ import annotations

from .lexer import tokens

#: Statement words that a filter has no use for; fixed values.
FORBIDDEN = frozenset("DROP DELETE INSERT UPDATE ALTER CREATE EXEC EXECUTE TRUNCATE GRANT REVOKE".split())


def where_is_safe(clause: str) -> bool:
    """False if the clause, comments aside, has a forbidden word or a semicolon outside literals."""
    return not any(t.kind == "word" and t.key in FORBIDDEN or t.text == ";" for t in tokens(clause))

"""Tokens of a SQL text, with the nesting that tells clauses from subqueries and CASE expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

PATTERN = re.compile(
    r"""(?P<blank>\s+|--[^\n]*|/\*.*?(?:\*/|\Z))
      |(?P<string>'(?:[^'\\]|\\.|'')*'?|"(?:[^"\\]|\\.|"")*"?)
      |(?P<quoted>`(?:[^`]|``)*`?)
      |(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)
      |(?P<word>[^\W\d]\w*)
      |(?P<symbol>[<>!=]=|<>|\|\||::|.)""",
    re.VERBOSE | re.DOTALL,
)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    end: int
    depth: int  # of parentheses and CASE ... END

    @property
    def key(self) -> str:
        """Upper case for words, else the text."""
        return self.text.upper() if self.kind == "word" else self.text


def tokens(sql: str) -> list[Token]:
    """All tokens but blanks and comments; a closing parenthesis and END have the depth of what they close."""
    out: list[Token] = []
    depth = 0
    for m in PATTERN.finditer(sql):
        kind = m.lastgroup
        if kind == "blank":
            continue
        text = m.group()
        upper = text.upper()
        if text == ")" and kind == "symbol" or kind == "word" and upper == "END" and depth and not _is_name(out):
            depth = max(0, depth - 1)
        out.append(Token(kind, text, m.start(), m.end(), depth))
        if text == "(" and kind == "symbol" or kind == "word" and upper == "CASE" and not _is_name(out[:-1]):
            depth += 1
    return out


def _is_name(before: list[Token]) -> bool:
    """Whether a word after these tokens is part of a dotted name."""
    return bool(before) and before[-1].text == "."


def without_comments(sql: str) -> str:
    return "".join(" " if m.lastgroup == "blank" and m.group()[:2] in ("--", "/*") else m.group() for m in PATTERN.finditer(sql))

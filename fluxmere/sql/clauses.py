"""The clauses that the extended SQL adds to a query.

    SELECT ... FROM channel[, ...] [any Spark SQL] [GRANULARITY n] [USING cat.op [WITH k=v, ...]
    [THEN cat.op [WITH ...]] ...] [LABEL column] [INTO channel]

What is left without them is the body: Spark SQL over channels. Extension words are told from SQL's
own by nesting and by what follows: `JOIN t USING (k)`, `GROUP BY a WITH ROLLUP`, `CASE ... THEN` and
a leading `WITH x AS (...)` stay in the body.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..errors import EngineError
from .lexer import Token, tokens
from .safety import where_is_safe

#: Texts that users and tests of the grammar rely on; fixed values.
EXPECTED_SELECT = "expected SELECT"
EXPECTED_COLUMN = "expected column name or * after SELECT"
EXPECTED_FROM = "expected FROM"
EXPECTED_SOURCE = "expected source channel name after FROM"
EXPECTED_NEXT_SOURCE = "expected source channel name after ','"
FORBIDDEN_WHERE = "WHERE clause contains forbidden keywords"
EXPECTED_OPERATOR = "expected category.name format after USING/THEN, got: "
GLOBAL_WITH = "global WITH is not supported; use WITH after each operator"
EXPECTED_DESTINATION = "expected destination channel name after INTO"
TOO_LONG = "SQL too long (max 64KB)"

MAX_LENGTH = 64 * 1024
CHANNEL = re.compile(r"[A-Za-z0-9_.\-]+")
#: Words after which the list of sources or a table's alias ends.
AFTER_TABLE = frozenset("WHERE GROUP HAVING ORDER LIMIT OFFSET UNION INTERSECT EXCEPT MINUS JOIN INNER LEFT RIGHT FULL CROSS NATURAL SEMI ANTI ON USING WITH THEN INTO LABEL GRANULARITY WINDOW LATERAL TABLESAMPLE SORT CLUSTER DISTRIBUTE PIVOT UNPIVOT QUALIFY".split())


@dataclass(frozen=True)
class OperatorCall:
    category: str
    name: str
    params: dict[str, str]

    @property
    def full(self) -> str:
        return f"{self.category}.{self.name}"


@dataclass(frozen=True)
class Reference:
    """A channel named in table position: where it stands in the body, and whether an alias follows."""

    name: str
    start: int
    end: int
    aliased: bool


@dataclass
class ExtendedQuery:
    body: str
    sources: list[str] = field(default_factory=list)
    references: list[Reference] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)
    where: str = ""
    group: list[str] = field(default_factory=list)
    granularity: int | None = None
    operators: list[OperatorCall] = field(default_factory=list)
    with_params: dict[str, str] = field(default_factory=dict)
    label: str = ""
    dest: str = ""

    @property
    def is_plain(self) -> bool:
        """SELECT * FROM sources, with a WHERE at most: the body adds nothing to the frames themselves."""
        return not self.columns and re.sub(r"\s+", " ", self.body).strip().upper().startswith("SELECT * FROM")


def parse(sql: str) -> ExtendedQuery:
    """Raises EngineError (400) with one of the texts above."""
    if len(sql.encode()) > MAX_LENGTH:
        raise EngineError(TOO_LONG)
    sql = sql.strip().rstrip(";").rstrip()
    toks = tokens(sql)
    if toks and toks[0].kind == "word" and toks[0].key not in ("SELECT", "WITH") and (first := _operator_first(sql, toks)):
        sql = first
        toks = tokens(sql)
    if not toks or toks[0].key not in ("SELECT", "WITH", "("):
        raise EngineError(EXPECTED_SELECT)
    cut, tail = _tail(toks)
    body_end = toks[cut].start if cut < len(toks) else len(sql)
    query = ExtendedQuery(sql[:body_end].rstrip())
    _clauses(sql, toks, tail, query)
    _granularity(query)
    _body(query)
    return query


def _operator_first(sql: str, toks: list[Token]) -> str | None:
    """`cat.op columns FROM ...` is SELECT columns FROM ... USING cat.op."""
    if len(toks) < 4 or toks[1].text != "." or toks[2].kind != "word" or not any(t.key == "FROM" and t.depth == 0 for t in toks):
        return None
    rest = sql[toks[2].end :]
    into = next((t for t in toks if t.key == "INTO" and t.depth == 0), None)
    at = into.start - toks[2].end if into else len(rest)
    return f"SELECT {rest[:at].strip()} USING {toks[0].text}.{toks[2].text} {rest[at:]}".rstrip()


def _tail(toks: list[Token]) -> tuple[int, int]:
    """Where the body ends and the extension clauses begin (twice, for the reader's sake: token number)."""
    for k, t in enumerate(toks):
        if t.depth or t.kind != "word":
            continue
        after = toks[k + 1] if k + 1 < len(toks) else None
        named = k and toks[k - 1].text == "."
        if named or k == 0:
            continue
        if t.key == "INTO" or t.key == "USING" and not (after and after.text == "("):
            return k, k
        if t.key == "LABEL" and after and after.kind in ("word", "string", "quoted") and _is_clause(toks, k):
            return k, k
        if t.key == "WITH" and after and after.key not in ("ROLLUP", "CUBE") and k + 2 < len(toks) and toks[k + 2].text == "=":
            return k, k
    return len(toks), len(toks)


def _is_clause(toks: list[Token], k: int) -> bool:
    """LABEL as a clause: nothing but other extension clauses follows its name."""
    return k + 2 >= len(toks) or toks[k + 2].key in ("INTO", "USING", "WITH")


def _clauses(sql: str, toks: list[Token], k: int, query: ExtendedQuery) -> None:
    while k < len(toks):
        word = toks[k].key
        if word in ("USING", "THEN") and (word == "USING") == (not query.operators):
            m = re.compile(r"\s*([^\s,;]*)").match(sql, toks[k].end)
            full = m[1]
            category, _, name = full.partition(".")
            if not category or not name or name.endswith("."):
                raise EngineError(EXPECTED_OPERATOR + full)
            k = _next(toks, m.end())
            params: dict[str, str] = {}
            if k < len(toks) and toks[k].key == "WITH":
                params, k = _params(sql, toks, k + 1)
            query.operators.append(OperatorCall(category.lower(), name, params))
            query.with_params = query.with_params or params
        elif word == "WITH" and query.operators:
            raise EngineError(GLOBAL_WITH)
        elif word == "WITH":
            query.with_params, k = _params(sql, toks, k + 1)
        elif word == "LABEL" and k + 1 < len(toks):
            query.label = toks[k + 1].text.strip("'\"`")
            k += 2
        elif word == "INTO":
            m = re.compile(r"\s*([A-Za-z0-9_.\-]*)").match(sql, toks[k].end)
            if not m[1]:
                raise EngineError(EXPECTED_DESTINATION)
            query.dest = m[1]
            k = _next(toks, m.end())
        else:
            raise EngineError(f"unexpected text after the last clause: {sql[toks[k].start :][:40]}")


def _next(toks: list[Token], at: int) -> int:
    return next((k for k, t in enumerate(toks) if t.start >= at), len(toks))


def _params(sql: str, toks: list[Token], k: int) -> tuple[dict[str, str], int]:
    """k=v[, k=v ...]; a bare value reaches to the next blank or comma."""
    out: dict[str, str] = {}
    while k + 1 < len(toks) and toks[k + 1].text == "=":
        name, value = toks[k].text, toks[k + 2] if k + 2 < len(toks) else None
        if value is None:
            raise EngineError(f"expected a value for {name}")
        if value.kind == "string":
            quote = value.text[0]
            out[name] = value.text[1:-1].replace(quote * 2, quote)
            k += 3
        else:
            m = re.compile(r"[^\s,]+").match(sql, value.start)
            out[name] = m.group()
            k = _next(toks, m.end())
        if k < len(toks) and toks[k].text == ",":
            k += 1
        else:
            break
    return out, k


def _granularity(query: ExtendedQuery) -> None:
    """Takes GRANULARITY n out of the body; n is in seconds."""
    toks = tokens(query.body)
    for k, t in enumerate(toks):
        if t.key == "GRANULARITY" and t.depth == 0 and k + 1 < len(toks) and toks[k + 1].kind == "number":
            query.granularity = int(toks[k + 1].text)
            if query.granularity <= 0:
                raise EngineError("GRANULARITY must be a positive number of seconds")
            query.body = query.body[: t.start].rstrip() + " " + query.body[toks[k + 1].end :].lstrip()
            query.body = query.body.strip()
            return


def _body(query: ExtendedQuery) -> None:
    """Checks the body and finds the channels in it."""
    sql = query.body
    toks = tokens(sql)
    selects = [k for k, t in enumerate(toks) if t.key == "SELECT" and t.depth == 0]
    first = selects[0] if selects else 0
    froms = [k for k, t in enumerate(toks) if t.key == "FROM" and t.depth == toks[first].depth and k > first]
    if selects:
        after = toks[first + 1] if first + 1 < len(toks) else None
        if after is None or after.key == "FROM":
            raise EngineError(EXPECTED_COLUMN)
        if not froms:
            raise EngineError(EXPECTED_FROM)
        listed = _split(sql, toks, first + 1, froms[0])
        query.columns = [] if listed == ["*"] else listed
    ctes = {toks[k - 1].text.lower() for k, t in enumerate(toks) if t.key == "AS" and k + 1 < len(toks) and toks[k + 1].text == "(" and toks[k - 1].kind in ("word", "quoted")}
    for k, t in enumerate(toks):
        if t.kind != "word" or k and toks[k - 1].text == ".":
            continue
        if t.key == "FROM" and not _in_function(toks, k):
            _table_list(sql, toks, k + 1, t.depth, query, ctes, k in froms[:1])
        elif t.key == "JOIN":
            _table(sql, toks, k + 1, query, ctes)
    if froms and not query.sources and not query.references and not (froms[0] + 1 < len(toks) and (toks[froms[0] + 1].text == "(" or toks[froms[0] + 1].text.lower() in ctes)):
        raise EngineError(EXPECTED_SOURCE)
    where = next((k for k, t in enumerate(toks) if t.key == "WHERE" and t.depth == 0), None)
    if where is not None:
        end = next((t.start for t in toks[where + 1 :] if t.depth == 0 and t.key in ("GROUP", "HAVING", "ORDER", "LIMIT", "UNION", "INTERSECT", "EXCEPT", "WINDOW")), len(sql))
        query.where = sql[toks[where].end : end].strip()
        if not where_is_safe(sql[toks[where].end :]):
            raise EngineError(FORBIDDEN_WHERE)
    group = next((k for k, t in enumerate(toks) if t.key == "GROUP" and t.depth == 0), None)
    if group is not None:
        end = next((k for k in range(group + 2, len(toks)) if toks[k].depth == 0 and toks[k].key in ("HAVING", "ORDER", "LIMIT", "UNION", "INTERSECT", "EXCEPT", "WINDOW")), len(toks))
        query.group = _split(sql, toks, group + 2, end)


def _in_function(toks: list[Token], k: int) -> bool:
    """extract(x FROM y), trim(x FROM y), substring(x FROM n), IS DISTINCT FROM."""
    if toks[k - 1].key == "DISTINCT" and k > 1 and toks[k - 2].key in ("IS", "NOT"):
        return True
    opened = next((j for j in range(k - 1, -1, -1) if toks[j].text == "(" and toks[j].depth == toks[k].depth - 1), None)
    return opened is not None and opened > 0 and toks[opened - 1].key in ("EXTRACT", "TRIM", "SUBSTRING", "SUBSTR", "OVERLAY", "POSITION") and not any(t.key == "SELECT" and t.depth == toks[k].depth for t in toks[opened:k])


def _split(sql: str, toks: list[Token], a: int, b: int) -> list[str]:
    """Items between top-level commas."""
    if a >= b:
        return []
    depth, out, start = toks[a].depth, [], toks[a].start
    for t in toks[a:b]:
        if t.text == "," and t.depth == depth:
            out.append(sql[start : t.start].strip())
            start = t.end
    out.append(sql[start : toks[b].start if b < len(toks) else len(sql)].strip())
    return out


def _table_list(sql: str, toks: list[Token], k: int, depth: int, query: ExtendedQuery, ctes: set[str], top: bool) -> None:
    wanted = EXPECTED_SOURCE
    while True:
        if k >= len(toks):
            raise EngineError(wanted)
        found = _table(sql, toks, k, query, ctes)
        if found is None and toks[k].text != "(" and toks[k].text.lower() not in ctes and toks[k].kind not in ("quoted", "string"):
            raise EngineError(wanted)
        if found is not None and top:
            query.sources.append(found.name)
        # On to a comma of this list, if one comes before the list ends.
        while k < len(toks) and not (toks[k].text == "," and toks[k].depth == depth):
            if toks[k].depth == depth and toks[k].key in AFTER_TABLE or toks[k].depth < depth:
                return
            k += 1
        if k >= len(toks):
            return
        k += 1
        wanted = EXPECTED_NEXT_SOURCE


def _table(sql: str, toks: list[Token], k: int, query: ExtendedQuery, ctes: set[str]) -> Reference | None:
    """The channel at token k, if there is one."""
    if k >= len(toks) or toks[k].kind not in ("word", "number") or toks[k].key in AFTER_TABLE or toks[k].key in ("SELECT", "VALUES", "TABLE", "LATERAL"):
        return None
    m = CHANNEL.match(sql, toks[k].start)
    if m.group().lower() in ctes or sql[m.end() : m.end() + 1] == "(":
        return None
    after = next((t for t in toks if t.start >= m.end()), None)
    aliased = after is not None and (after.key == "AS" or after.kind in ("word", "quoted") and after.key not in AFTER_TABLE)
    found = Reference(m.group(), m.start(), m.end(), aliased)
    query.references.append(found)
    return found

"""Rewrites of the extended SQL into plain Spark SQL: channel names, time ranges and granularity."""

from __future__ import annotations

import re
from collections.abc import Callable

from ..errors import EngineError
from .clauses import ExtendedQuery
from .lexer import tokens

STAMP = r"\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}"
RANGE = re.compile(rf"\[\s*({STAMP})?\s*-\s*({STAMP})?\s*\]")


def time_range(text: str) -> tuple[str | None, str | None]:
    """The two ends of '[yyyy/MM/dd HH:mm:ss - yyyy/MM/dd HH:mm:ss]'; either may be left out."""
    m = RANGE.fullmatch(text.strip())
    if not m:
        raise EngineError(f"bad time range: {text}")
    return tuple(x and x.replace("/", "-") for x in m.groups())


def time_ranges(sql: str) -> str:
    """`column = '[a - b]'` becomes a comparison with both ends included; an open end is left out."""
    toks, out, at = tokens(sql), [], 0
    for k, t in enumerate(toks):
        if t.kind != "string" or k < 2 or toks[k - 1].text != "=" or not RANGE.fullmatch(t.text[1:-1].strip()):
            continue
        first = k - 2
        while first >= 2 and toks[first - 1].text == ".":
            first -= 2
        column = sql[toks[first].start : toks[k - 2].end]
        low, high = time_range(t.text[1:-1])
        parts = [f"{column} >= timestamp'{low}'"] * bool(low) + [f"{column} <= timestamp'{high}'"] * bool(high)
        out += [sql[at : toks[first].start], f"({' AND '.join(parts)})" if parts else f"{column} IS NOT NULL"]
        at = t.end
    return "".join([*out, sql[at:]])


def named_channels(query: ExtendedQuery, view_of: Callable[[str], str]) -> str:
    """The body with each channel replaced by its view, under the channel's last name unless it has an alias."""
    out, at = [], 0
    for r in sorted(query.references, key=lambda r: r.start):
        view = f"`{view_of(r.name)}`"
        out += [query.body[at : r.start], view if r.aliased else f"{view} AS `{r.name.rpartition('.')[2]}`"]
        at = r.end
    return "".join([*out, query.body[at:]])


def granular(sql: str, granularity: int, time_column: str) -> str:
    """GROUP BY a GRANULARITY n groups by a and n-second buckets of the time column too, in every branch of a union.

    The bucket's start comes out as time_bucket, before the selected columns.
    """
    toks = tokens(sql)
    cuts = [t for t in toks if t.depth == 0 and t.key in ("UNION", "INTERSECT", "EXCEPT", "MINUS")]
    out, at = [], 0
    for t in cuts:
        out += [_granular_branch(sql[at : t.start], granularity, time_column), " "]
        after = next((x for x in toks if x.start >= t.end and x.depth == 0), None)
        at = after.end if after is not None and after.key in ("ALL", "DISTINCT") else t.end
        out.append(sql[t.start : at] + " ")
    return "".join([*out, _granular_branch(sql[at:], granularity, time_column)]).strip()


def _granular_branch(sql: str, granularity: int, time_column: str) -> str:
    toks = tokens(sql)
    place = next(k for k, t in enumerate(toks) if t.key == "SELECT" and t.depth == 0)
    head = toks[place + 1] if place + 1 < len(toks) and toks[place + 1].key in ("DISTINCT", "ALL") else toks[place]
    window = f"window({time_column}, '{granularity} seconds')"
    group = next((k for k, t in enumerate(toks) if t.key == "GROUP" and t.depth == 0), None)
    if group is None and head.key == "DISTINCT":
        # Distinct rows of each bucket: there is nothing to group.
        grouped = sql
    elif group is None:
        before = next((t.start for t in toks if t.depth == 0 and t.key in ("HAVING", "ORDER", "LIMIT")), len(sql))
        grouped = f"{sql[:before].rstrip()} GROUP BY {window} {sql[before:]}"
    else:
        by = toks[group + 1].end
        grouped = f"{sql[:by]} {window},{sql[by:]}"
    return f"{grouped[: head.end]} {window}.start AS time_bucket,{grouped[head.end :]}".strip()

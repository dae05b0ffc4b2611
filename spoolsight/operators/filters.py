"""Filters that the read operations share. Wrong arguments are a ValueError of the caller."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterable
from string import ascii_lowercase, ascii_uppercase
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default and highest number of rows by operation; None is unbounded.
LIMITS = {
    "sessions": (50, 500), "transcript": (200, 1000), "blocks": (24, 200), "commands": (100, 1000), "history": (100, None),
    "tool_stats": (100, 1000), "session_events": (100, 1000), "artifacts": (100, None), "search": (20, 100),
}
# First words of user turns that an agent wrote itself, and kinds of artifacts that are searched.
SYNTHETIC_PROMPTS = {
    "claude": ["<local-command-caveat>", "<command-name>", "<command-message>", "<command-args>", "<local-command-stdout>", "<bash-input>", "<bash-stdout>", "<bash-stderr>", "<system-reminder>"],
    "codex": ["<environment_context>", "<permissions", "<recommended_plugins>", "<user_instructions>"],
    "pi": ["<skill "],
}
SEARCHABLE_ARTIFACTS = ("plan", "todo_list", "task_group", "paste", "memory", "usage_facet")


def day(text: str) -> date:
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        raise ValueError(f"not a day: {text!r}")
    return date.fromisoformat(text)


def day_window(at: Column, since: str | None, until: str | None) -> Column:
    """Times from the first to the last day, the last one included. Unknown times fall out once there is a bound."""
    out = F.lit(True)
    if since:
        out = out & (at >= F.lit(day(since)).cast("timestamp"))
    if until:
        out = out & (at < F.lit(day(until) + timedelta(days=1)).cast("timestamp"))
    return out


def equal(column: Column, value: str | None) -> Column:
    return F.lit(True) if not value else column == value


def canonical_argument(path: str) -> str:
    """A caller's path in the form that the workspace column has."""
    path = path.strip()
    cleaned = posixpath.normpath(path) if path else ""
    cleaned = re.sub(r"^//+", "/", cleaned)
    return "" if cleaned == "." else cleaned


def contains(column: Column, text: str | None) -> Column:
    """Literal substring; A-Z match in either case, other letters only as they are."""
    if not text:
        return F.lit(True)
    return F.translate(column, ascii_uppercase, ascii_lowercase).contains(text.translate(str.maketrans(ascii_uppercase, ascii_lowercase)))


def one_of(column: Column, values: str | Iterable[str] | None, allowed: Iterable[str], what: str) -> Column:
    """Membership in a comma list of known values."""
    wanted = [v.strip() for v in values.split(",")] if isinstance(values, str) else list(values or [])
    wanted = [v for v in wanted if v]
    unknown = sorted(set(wanted) - set(allowed))
    if unknown:
        raise ValueError(f"unknown {what}: {', '.join(unknown)}")
    return column.isin(*wanted) if wanted else F.lit(True)


def browsable_command(kind: Column, command: Column) -> Column:
    """Shell calls that a list of commands shows, and that its count counts."""
    return (kind == "shell") & (command != "")


def synthetic_prompt(agent: Column, text: Column) -> Column:
    """User turns that are no words of the user and make no title."""
    out = F.lit(False)
    for name, prefixes in SYNTHETIC_PROMPTS.items():
        out = out | ((agent == name) & F.ltrim(text).rlike("^(?:" + "|".join(map(re.escape, prefixes)) + ")"))
    return out


def searchable(kind: Column, text: Column) -> Column:
    return kind.isin(*SEARCHABLE_ARTIFACTS) & text.rlike(r"\S")


def page(df: DataFrame, order: list[Column], op: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Ordered page under the operation's policy: a default, a ceiling that is refused and not clipped, no negatives. A limit of 0
    is none given."""
    default, most = LIMITS.get(op, (None, None))
    limit = limit or default
    if offset < 0 or limit is not None and limit < 0:
        raise ValueError("limit and offset must not be negative")
    if most is not None and limit > most:
        raise ValueError(f"limit of {op} is at most {most}")
    df = df.orderBy(*order)
    df = df.offset(offset) if offset else df
    return df.limit(limit) if limit is not None else df


def positive(name: str, value: int | None) -> None:
    if value is not None and value < 0:
        raise ValueError(f"{name} must not be negative")

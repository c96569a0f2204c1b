"""Date variables (``TODAY-30``, ``MONTH_START`` ...) and date tokens in paths."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, functions as F

# The codes allowed in date formats,
# the names of the date variables and the clock texts appended to some of them.
FORMAT_CODES = ("yyyy", "yy", "MM", "dd", "HH", "mm", "ss")
DAY_START = " 00:00:00"
DAY_END = " 23:59:59"

_OFFSET = re.compile(r"^TODAY([+-])(\d+)$", re.IGNORECASE)


def checked_format(fmt: str) -> str:
    """Accept only codes with one meaning everywhere (``yyyy MM dd HH mm ss``)."""
    for run in re.findall(r"([A-Za-z])(\1*)", fmt):
        code = run[0] + run[1]
        if code not in FORMAT_CODES:
            raise ValueError(f"date format {fmt!r} uses the unsupported code {code!r}")
    return fmt


def _days(as_of: Column) -> dict[str, Column]:
    """Each named day as a date column."""
    today = as_of.cast("date")
    month = F.trunc(today, "MM")
    before = F.add_months(month, -1)
    year_start = F.trunc(today, "YEAR")
    return {
        "TODAY": today,
        "YESTERDAY": F.date_sub(today, 1),
        "MONTH_START": month,
        "MONTH_END": F.last_day(today),
        "YEAR_START": year_start,
        "YEAR_END": F.date_sub(F.add_months(year_start, 12), 1),
        "PREV_MONTH_START": before,
        "PREV_MONTH_END": F.last_day(before),
    }


# name -> (day, clock text)
_CLOCKED = {
    "TODAY_START": ("TODAY", DAY_START),
    "TODAY_END": ("TODAY", DAY_END),
    "YESTERDAY_START": ("YESTERDAY", DAY_START),
    "YESTERDAY_END": ("YESTERDAY", DAY_END),
    "MONTH_START_DT": ("MONTH_START", DAY_START),
    "MONTH_END_DT": ("MONTH_END", DAY_END),
}


def date_variable(expr: str, as_of: Column, fmt: str = "yyyy/MM/dd") -> Column:
    """The text of one variable as seen at ``as_of``; unknown names are literals."""
    checked_format(fmt)
    name, days = expr.strip().upper(), _days(as_of)
    if name == "NOW":
        return F.date_format(as_of, fmt + " HH:mm:ss")
    if name in days:
        return F.date_format(days[name], fmt)
    if name in _CLOCKED:
        day, clock = _CLOCKED[name]
        return F.concat(F.date_format(days[day], fmt), F.lit(clock))
    offset = _OFFSET.match(expr.strip())
    if offset:
        count = int(offset.group(2)) * (1 if offset.group(1) == "+" else -1)
        return F.date_format(F.date_add(days["TODAY"], count), fmt)
    return F.lit(expr)


def parse_variables(text: str) -> dict[str, str]:
    """``name=expr`` lines; a repeated name keeps its place and its last value."""
    out: dict[str, str] = {}
    for line in text.split("\n"):
        name, eq, expr = line.strip().partition("=")
        if eq and name.strip():
            out[name.strip()] = expr.strip()
    return out


def variable_columns(text: str, as_of: Column, fmt: str = "yyyy/MM/dd") -> list[Column]:
    return [date_variable(expr, as_of, fmt).alias(name) for name, expr in parse_variables(text).items()]


_STRFTIME = {"yyyy": "%Y", "yy": "%y", "MM": "%m", "dd": "%d", "HH": "%H", "mm": "%M", "ss": "%S"}


def resolve_path_tokens(path: str, at: datetime) -> str:
    """Fill ``{yyyyMMdd}``-like tokens; a token with other letters stays as it is."""

    def fill(token: re.Match) -> str:
        body = token.group(1)
        try:
            checked_format(body)
        except ValueError:
            return token.group(0)
        return re.sub(
            r"yyyy|yy|MM|dd|HH|mm|ss", lambda code: at.strftime(_STRFTIME[code.group(0)]), body
        )

    return re.sub(r"\{([^}]+)\}", fill, path)

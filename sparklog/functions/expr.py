"""Small column-expression builders shared by all operators.

Everything here returns a ``Column`` made of built-in functions, so it stays in
whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ntz(t: _dt.datetime | None) -> Column:
    """A naive datetime as a timestamp_ntz literal (no detour over the host's time zone)."""
    return F.lit(None if t is None else t.isoformat(sep=" ")).cast("timestamp_ntz")


def instant(t: _dt.datetime | None) -> Column:
    """A naive datetime, read in the session's time zone (UTC), as a timestamp literal."""
    return F.lit(None if t is None else t.isoformat(sep=" ")).cast("timestamp")


def lit_map(pairs: Sequence[tuple]) -> Column:
    """Literal ``map`` from ordered (key, value) pairs; a later duplicate key wins."""
    merged: dict = {}
    for k, v in pairs:
        merged.pop(k, None)
        merged[k] = v
    args = []
    for k, v in merged.items():
        args += [F.lit(k), F.lit(v)]
    return F.create_map(*args)


def lookup(pairs: Sequence[tuple], key: str | Column, default=None) -> Column:
    """Value of ``key`` in a fixed table, ``default`` when absent (or key NULL)."""
    # try_element_at: NULL for a missing key whatever spark.sql.ansi.enabled says
    found = F.try_element_at(lit_map(pairs), col(key)) if pairs else F.lit(None)
    if default is None:
        return found
    return F.coalesce(found, F.lit(default))


def contains_any(text: str | Column, tokens: Iterable[str]) -> Column:
    text = col(text)
    out = None
    for t in tokens:
        c = text.contains(t)
        out = c if out is None else (out | c)
    return out if out is not None else F.lit(False)


def max_weight(text: str | Column, weighted: Sequence[tuple[str, float]], floor: Column | float = 0.0) -> Column:
    """max(floor, weight of every contained keyword) — one ``greatest`` over all rules."""
    text = col(text)
    floor = floor if isinstance(floor, Column) else F.lit(float(floor))
    parts = [F.when(text.contains(k), F.lit(float(w))) for k, w in weighted]
    return F.greatest(floor, *parts)


def scale(value: str | Column, steps: Sequence[tuple[float, str]], otherwise) -> Column:
    """First label whose lower bound the value reaches (``>=``), else ``otherwise``."""
    value = col(value)
    expr = None
    for bound, label in steps:
        expr = F.when(value >= bound, label) if expr is None else expr.when(value >= bound, label)
    return expr.otherwise(otherwise)


def stored_severity(score: str | Column) -> Column:
    """.90 CRITICAL, .75 HIGH, .55 MEDIUM, else LOW."""
    return scale(score, R.STORED_SEVERITY_SCALE, R.STORED_SEVERITY_ELSE)


def summary_severity(score: str | Column) -> Column:
    """.95 / .85 / .70, else LOW."""
    return scale(score, R.SUMMARY_SEVERITY_SCALE, R.SUMMARY_SEVERITY_ELSE)


def stream_severity(score: str | Column) -> Column:
    """.90 / .72 / .55 / .35, else INFO."""
    return scale(score, R.STREAM_SEVERITY_SCALE, R.STREAM_SEVERITY_ELSE)


def threat_level(score_fraction: str | Column) -> Column:
    """G03 level of score/100: .95 / .85 / .70 / .50, else INFO."""
    return scale(score_fraction, R.THREAT_LEVEL_SCALE, R.THREAT_LEVEL_ELSE)


def severity_rank(severity: str | Column) -> Column:
    """F11 ordered scale INFO < LOW < MEDIUM < HIGH < CRITICAL (unknown -> NULL)."""
    return lookup(R.SEVERITY_RANK, F.upper(col(severity)))


def normalize_severity(severity: str | Column) -> Column:
    """F16: upper/trim; anything other than CRITICAL/HIGH/MEDIUM becomes LOW."""
    s = F.upper(F.trim(F.coalesce(col(severity).cast("string"), F.lit(""))))
    return F.when(s.isin("CRITICAL", "HIGH", "MEDIUM"), s).otherwise(F.lit("LOW"))


def is_present(c: str | Column) -> Column:
    """Python truthiness of an optional string: not NULL and not empty."""
    c = col(c)
    return c.isNotNull() & (c.cast("string") != "")


def round_to(c: str | Column, digits: int) -> Column:
    """Round a double the way the binary value decides: round(x * 10^d) / 10^d.

    ``F.round`` rounds the shortest decimal form half-up, so 79.695 (stored as
    79.69499...) would become 79.70; scaling first keeps the binary value's side of
    the tie, as the reference's Python ``round`` and DuckDB do.
    """
    scale = float(10 ** digits)
    return F.round(col(c) * F.lit(scale), 0) / F.lit(scale)


def round6(c: str | Column) -> Column:
    return round_to(c, 6)

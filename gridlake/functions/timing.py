"""Lap, gap and duration text to whole milliseconds, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlake.functions.scalars import strip

# Fixed formats: ``H:MM:SS[.f]``, ``M:SS[.f]`` or ``SS[.f]`` with an optional
# sign.  The leading part may have any number of digits, the others one or two.
_FORMAT = r"r'\A[+-]?([0-9]+|[0-9]+:[0-9]{1,2}|[0-9]+:[0-9]{1,2}:[0-9]{1,2})(\.[0-9]+)?\z'"

# The text is bound to ``s`` and its parts to ``p`` by one-element transforms,
# so the plan holds each once.  The fraction is padded or cut to three digits.
_LAST = "try_cast(substring_index(element_at(p, -1), '.', 1) AS INT)"
_READ = rf"""
    s -> transform(array(split(regexp_replace(s, r"^[+-]", ""), ':')), p -> named_struct(
      'problem', CASE
        WHEN s = '' THEN 'empty time'
        WHEN NOT s RLIKE {_FORMAT} THEN 'malformed time'
        WHEN size(p) = 3 AND try_cast(p[1] AS INT) > 59 THEN 'invalid minutes'
        WHEN size(p) > 1 AND {_LAST} > 59 THEN 'invalid seconds' END,
      'millis', IF(startswith(s, '-'), -1, 1) * (
        1000 * aggregate(p, 0L, (total, v) -> total * 60 + try_cast(substring_index(v, '.', 1) AS BIGINT))
        + try_cast(rpad(regexp_extract(s, r'\.([0-9]+)', 1), 3, '0') AS BIGINT)),
      'negative', startswith(s, '-')))[0]"""


def _read(text: Column) -> Column:
    return F.call_function("transform", F.array(strip(text)), F.expr(_READ))[0]


def time_problem(text: Column, allow_negative: bool = False) -> Column:
    """Why the text is not a duration; NULL if it is one (or is absent)."""
    read = _read(text)
    problem = read["problem"]
    if not allow_negative:
        problem = F.when(problem.isNull() & read["negative"], "negative duration").otherwise(problem)
    return F.when(text.isNotNull(), problem)


def time_to_millis(text: Column, allow_negative: bool = False) -> Column:
    """Whole milliseconds; NULL where ``time_problem`` names a problem.

    ``.7`` is 700 and ``.7425`` is 742.
    """
    read = _read(text)
    usable = read["problem"].isNull()
    if not allow_negative:
        usable = usable & ~read["negative"]
    return F.when(usable, read["millis"])


def _has_gap(text: Column) -> Column:
    return (strip(text) != "") & ~text.rlike("[a-zA-Z]")


def gap_problem(text: Column) -> Column:
    return F.when(_has_gap(text), time_problem(text, allow_negative=True))


def gap_to_millis(text: Column) -> Column:
    """Gap to the winner; text such as ``+1 Lap`` is no time gap and gives NULL."""
    return F.when(_has_gap(text), time_to_millis(text, allow_negative=True))


def _part(millis: Column, divisor: int, modulus: int | None = None) -> Column:
    value = F.call_function("div", millis.cast("bigint"), F.lit(divisor).cast("bigint"))
    return value % modulus if modulus else value


def _known(millis: Column, text: Column) -> Column:
    return F.when(millis.isNotNull(), text)


def lap_text(millis: Column) -> Column:
    """``M:SS.mmm``."""
    return _known(
        millis,
        F.format_string("%d:%02d.%03d", _part(millis, 60000), _part(millis, 1000, 60), _part(millis, 1, 1000)),
    )


def race_text(millis: Column) -> Column:
    """``H:MM:SS.mmm``."""
    return _known(
        millis,
        F.format_string(
            "%d:%02d:%02d.%03d",
            _part(millis, 3600000),
            _part(millis, 60000, 60),
            _part(millis, 1000, 60),
            _part(millis, 1, 1000),
        ),
    )


def seconds_text(millis: Column) -> Column:
    """``SS.mmm``."""
    return _known(millis, F.format_string("%d.%03d", _part(millis, 1000), _part(millis, 1, 1000)))

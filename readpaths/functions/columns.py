"""Scalar column helpers.

Everything here returns a ``Column`` built from ``pyspark.sql.functions``
so that it stays inside whole-stage codegen; nothing is a Python UDF.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_wiki(code: str | None) -> str | None:
    """``'en'`` / ``'enwiki'`` -> ``'enwiki'``.

    Only a trailing ``wiki`` is stripped before it is appended again, so a
    code such as ``'wikidata'`` is kept whole instead of becoming
    ``'datawiki'``.  ``None`` means "all wikis".
    """
    if code is None:
        return None
    code = code.strip()
    if code.endswith("wiki"):
        code = code[: -len("wiki")]
    return code + "wiki"


def md5int(c: ColumnOrName) -> Column:
    """First 32 bits of the md5 hex digest as a non-negative bigint.

    Deterministic and identical in other SQL engines, used wherever the
    reference draws a random number (pair choice, dev/test split).
    """
    return F.conv(F.substring(F.md5(_col(c).cast("string")), 1, 8), 16, 10).cast("bigint")


def epoch_micros(c: ColumnOrName) -> Column:
    """Microseconds since the epoch for TIMESTAMP or TIMESTAMP_NTZ input.

    NTZ values are read as UTC wall-clock time (the session zone is UTC).
    """
    return F.unix_micros(_col(c).cast("timestamp"))


def bucket_of(micros: ColumnOrName, width_micros: int) -> Column:
    """``floor(micros / width)`` in exact integer arithmetic."""
    m, w = _col(micros), F.lit(int(width_micros))
    return F.call_function("div", m - F.pmod(m, w), w)


def hour_start(year: ColumnOrName = "year", month: ColumnOrName = "month",
               day: ColumnOrName = "day", hour: ColumnOrName = "hour") -> Column:
    """Timestamp of the hour partition ``year-month-day hour:00:00``.

    Built with ``make_timestamp`` instead of parsing a concatenated string:
    un-padded parts such as ``2020-4-1 5:00:00`` do not parse.
    """
    return F.make_timestamp(_col(year), _col(month), _col(day), _col(hour),
                            F.lit(0), F.lit(0))


def to_utc_datetime(value: str | _dt.datetime | _dt.date) -> _dt.datetime:
    """A UTC instant without zone.

    Accepts ``YYYY-MM-DD``, ``YYYY-MM-DD-HH`` (the reference's argument
    format), ``YYYY-MM-DD HH:MM:SS`` or a ``datetime``/``date``.
    """
    if isinstance(value, _dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, _dt.date):
        return _dt.datetime(value.year, value.month, value.day)
    text = str(value).strip()
    for fmt in ("%Y-%m-%d-%H", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d"):
        try:
            return _dt.datetime.strptime(text, fmt)
        except ValueError:
            continue
    raise ValueError(f"not a date or hour: {value!r} (use YYYY-MM-DD or YYYY-MM-DD-HH)")


def to_utc_timestamp_lit(value: str | _dt.datetime | _dt.date) -> Column:
    """A timestamp literal read in the session zone (UTC), to the second."""
    return F.to_timestamp(F.lit(to_utc_datetime(value).strftime("%Y-%m-%d %H:%M:%S")), "yyyy-MM-dd HH:mm:ss")


def hour_not_before(value: str | _dt.datetime | _dt.date, columns=("year", "month", "day", "hour")) -> Column:
    """Whether the hour partition ``year, month, day, hour`` starts at or after an instant.

    Comparisons of single partition columns with constants, so that a
    metastore can prune on all of them: a later year, or the same year and a
    later month, and so on.
    """
    at = to_utc_datetime(value)
    if at != at.replace(minute=0, second=0, microsecond=0):
        at = at.replace(minute=0, second=0, microsecond=0) + _dt.timedelta(hours=1)
    parts = list(zip(columns, (at.year, at.month, at.day, at.hour), strict=True))
    out = F.col(parts[-1][0]) >= parts[-1][1]
    for name, part in reversed(parts[:-1]):
        out = (F.col(name) > part) | ((F.col(name) == part) & out)
    return out


def vector_norm(v: ColumnOrName) -> Column:
    """Euclidean norm of an array<float|double> column."""
    return F.sqrt(F.aggregate(_col(v), F.lit(0.0).cast("double"),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))

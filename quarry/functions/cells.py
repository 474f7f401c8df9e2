"""Cell primitives shared by every operator.

Table cells follow script-language string rules: trimming strips all Unicode
white space (not only U+0020), and a number is the longest numeric *prefix*
of a cell (``12abc`` is 12, ``1,234`` is 1, ``$45`` is not a number).
All of it is built from Spark column expressions so it stays JVM-side.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: must match the reference's string semantics ------------
# White space removed by trim and skipped before a number: TAB, LF, VT, FF,
# CR, SPACE, NBSP, OGHAM SPACE MARK, EN QUAD..HAIR SPACE, LINE SEPARATOR,
# PARAGRAPH SEPARATOR, NARROW NBSP, MEDIUM MATHEMATICAL SPACE, IDEOGRAPHIC
# SPACE, BYTE ORDER MARK.
WS_CHARS = ("\t\n\u000b\u000c\r\u0020\u00a0\u1680"
            + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000\ufeff")
# The same set as a Java regex character class.
WS_CLASS = r"[\s\x{000B}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
# Longest numeric prefix after leading white space (decimal literal or Infinity).
NUM_PREFIX = (r"^" + WS_CLASS + r"*([+-]?(?:Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)"
              r"(?:[eE][+-]?[0-9]+)?))")
# ---------------------------------------------------------------------------

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim(c) -> Column:
    """Trim every Unicode white-space character from both ends."""
    return F.btrim(_col(c), F.lit(WS_CHARS))


def cell(c) -> Column:
    """A table cell: trimmed text, SQL null read as the empty cell."""
    return F.coalesce(js_trim(c), F.lit(""))


def is_blank(c) -> Column:
    """True for null, empty and white-space-only cells."""
    return cell(c) == F.lit("")


def norm(c) -> Column:
    """Lower-cased trimmed cell (the fuzzy-compare form)."""
    return F.lower(cell(c))


def parse_number(c) -> Column:
    """Longest numeric prefix of a text cell as a double; null when none."""
    return _prefix_to_double(F.regexp_extract(_col(c), NUM_PREFIX, 1))


def _prefix_to_double(prefix: Column) -> Column:
    return F.when(prefix != "", prefix.try_cast(T.DoubleType()))


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def typed_number(c, dt: T.DataType) -> Column:
    """A typed numeric column as a double; NaN counts as missing."""
    x = _col(c).cast(T.DoubleType())
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(x), x)
    return x


def as_number(c, dt: T.DataType) -> Column:
    """Number of a cell of any type: typed numbers as is, text by prefix,
    and other types (dates, booleans) never numeric."""
    if is_numeric_type(dt):
        return typed_number(c, dt)
    if isinstance(dt, T.StringType):
        return parse_number(c)
    return F.lit(None).cast(T.DoubleType())


def as_cell(c, dt: T.DataType) -> Column:
    """Text form of a cell of any type (trimmed, '' for missing)."""
    if isinstance(dt, T.StringType):
        return cell(c)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        x = _col(c)
        return F.when(x.isNull() | F.isnan(x), F.lit("")).otherwise(x.cast("string"))
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def populated(c, dt: T.DataType) -> Column:
    """True when the cell holds a value (the reference's non-blank test)."""
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return _col(c).isNotNull() & ~F.isnan(_col(c))
    if isinstance(dt, T.StringType):
        return ~is_blank(c)
    return _col(c).isNotNull()


def resolve_column(headers: list[str], name: str) -> int:
    """Forgiving column lookup: case-insensitive and trimmed; first exact
    match, else first header containing the name, else first header the
    name contains; -1 when none. Metadata only, runs on the driver."""
    want = _py_trim(name).lower()
    keys = [_py_trim(h).lower() for h in headers]
    for test in (lambda h: h == want, lambda h: want in h, lambda h: h in want):
        for i, h in enumerate(keys):
            if test(h):
                return i
    return -1


def _py_trim(s: str) -> str:
    return s.strip(WS_CHARS)


def py_parse_number(s: str | None) -> float | None:
    """Driver-side twin of :func:`parse_number` for literal arguments."""
    import re

    if s is None:
        return None
    m = re.match(r"^[" + re.escape(WS_CHARS) + r"]*([+-]?(?:Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)"
                 r"(?:[eE][+-]?[0-9]+)?))", s)
    return float(m.group(1)) if m else None

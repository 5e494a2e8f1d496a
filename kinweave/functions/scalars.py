"""Column functions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Role-class patterns in order of priority.
ROLE_CLASSES = (
    ("writer", "writer|composer|lyricist|librettist|scriptwriter"),
    ("performer", "singer|performer|vocal|artist"),
    ("production", "producer|engineer"),
)
# Genre aliases.
GENRE_ALIASES = {"boom bap": "Hip Hop", "trap": "Hip Hop", "drill": "Hip Hop"}


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def clean(c: Column | str) -> Column:
    return F.lower(strip(c))


def strict_date(c: Column | str) -> Column:
    """yyyy-MM-dd, else null."""
    c = _c(c)
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def partial_date(y: Column, m: Column, d: Column) -> Column:
    """A date from numbers; absent month or day is 1; an impossible date is null."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", y.cast("int"), F.coalesce(m.cast("int"), F.lit(1)), F.coalesce(d.cast("int"), F.lit(1))), "yyyy-MM-dd")


def loose_date(c: Column | str) -> Column:
    """Y, Y-M or Y-M-D, else null."""
    c = strip(c)
    parts = F.split(c, "-")
    made = partial_date(F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int"), F.get(parts, F.lit(2)).try_cast("int"))
    return F.when(c.rlike(r"^[0-9]{4}(-[0-9]{1,2}){0,2}$"), made)


def precision_date(c: Column | str, precision: Column | str) -> Column:
    """A date read to its declared precision: year, month or day."""
    p = F.split(_c(c), "-")
    n = [F.get(p, F.lit(i)).try_cast("int") for i in range(3)]
    kind, none = _c(precision), F.lit(None)
    return F.when(kind == "day", partial_date(*n)).when(kind == "month", partial_date(n[0], n[1], none)).when(kind == "year", partial_date(n[0], none, none))


def plausible_year(c: Column | str, first: int, last: int) -> Column:
    y = F.regexp_extract(_c(c), r"^(\d{4})", 1).try_cast("int")
    return F.when(y.between(first, last), y)


def ordinal(c: Column | str) -> Column:
    """Proleptic day number of a date, 1 for 0001-01-01."""
    return F.unix_date(_c(c)) + 719163


def last_segment(c: Column | str) -> Column:
    return F.element_at(F.split(_c(c), "/"), -1)


def base62_id(c: Column | str, size: int = 22) -> Column:
    """The last path segment if it is an id of `size` base-62 digits, else null."""
    s = F.split(last_segment(c), r"\?")[0]
    return F.when(s.rlike(rf"^[0-9A-Za-z]{{{size}}}$"), s)


def uuid(c: Column | str) -> Column:
    """Lower-case hyphenated form of any common spelling, else null."""
    return hyphened(bare_uuid(c))


def bare_uuid(c: Column | str) -> Column:
    """A uuid's digits, of whatever spelling."""
    return F.lower(F.regexp_replace(_c(c), r"^urn:uuid:|[{}\-\s]", ""))


def hyphened(bare: Column | str) -> Column:
    """The uuid of these digits, else null."""
    h = _c(bare)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(h.rlike("^[0-9a-f]{32}$"), F.concat_ws("-", *cut))


def is_uuid(c: Column | str) -> Column:
    return _c(c).rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")


def role_class(c: Column | str) -> Column:
    """writer, performer, production or other; blank stays blank."""
    c = F.lower(F.coalesce(_c(c), F.lit("")))
    out = F.when(strip(c) == "", F.lit(""))
    for name, pattern in ROLE_CLASSES:
        out = out.when(c.rlike(pattern), F.lit(name))
    return out.otherwise(F.lit("other"))


def first_token(c: Column | str) -> Column:
    """First non-blank piece between , | and ;, trimmed; blank if there is none."""
    parts = F.filter(F.transform(F.split(F.coalesce(_c(c), F.lit("")), "[,|;]"), strip), lambda x: x != "")
    return F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit(""))


def alias_genre(c: Column | str) -> Column:
    c = _c(c)
    out = None
    for k, v in GENRE_ALIASES.items():
        out = F.when(F.lower(c) == k, F.lit(v)) if out is None else out.when(F.lower(c) == k, F.lit(v))
    return out.otherwise(c)


def known(c: Column | str, default: str = "unknown") -> Column:
    return F.coalesce(F.nullif(_c(c), F.lit("")), F.lit(default))


def finite(c: Column | str) -> Column:
    """Null for infinities and NaN."""
    c = _c(c)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def canonical_label(names: Column, ids: Column) -> Column:
    return F.coalesce(F.try_element_at(names, F.lit(1)), F.try_element_at(ids, F.lit(1)), F.lit(""))


def ordered_set_text(items: Column) -> Column:
    """An array's trimmed lower-case entries, first occurrences in order, without blanks, joined."""
    return F.concat_ws(", ", F.filter(F.array_distinct(F.transform(items, clean)), lambda x: x != ""))

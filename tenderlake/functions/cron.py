"""Cron expressions as columns: validity and field access."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderlake.functions.notice import literal_map

# Fields in order, each with its range and the single characters it admits.
FIELDS = {
    "seconds": (0, 59, "*,-"),
    "minutes": (0, 59, "*,-"),
    "hours": (0, 23, "*,-"),
    "dom": (1, 31, "*,-?LW"),
    "month": (1, 12, "*,-"),
    "dow": (0, 6, "*,-?L#"),
    "year": (1970, 2099, "*,-"),
}

# Names that stand for numbers.
NAMES = {
    "month": dict(zip("jan feb mar apr may jun jul aug sep oct nov dec".split(), range(1, 13))),
    "dow": dict(zip("sun mon tue wed thu fri sat".split(), range(7))),
}


def special_allowed(field: str, col: Column) -> Column:
    """True where ``col`` is one of the single characters the field admits."""
    return F.coalesce(col.isin(list(FIELDS[field][2])), F.lit(False))


def _at_least(number: int) -> str:
    """Digits whose value is not below ``number``."""
    text = str(number)
    if number == 0:
        return "[0-9]+"
    choices = [f"[1-9][0-9]{{{len(text)},}}", text]
    for i, digit in enumerate(text):
        if digit < "9":
            choices.append(f"{text[:i]}[{int(digit) + 1}-9][0-9]{{{len(text) - i - 1}}}")
    return "0*(?:" + "|".join(choices) + ")"


def _field_pattern(field: str) -> str:
    """What one field may hold. ``/`` steps pass unchecked, range ends are not ordered, nothing counts as 0."""
    low, high, specials = FIELDS[field]
    names = [f"(?i:{name})" for name in NAMES.get(field, ())]
    nothing = [""] if low == 0 else []
    within = "|".join(["0*(?:" + "|".join(map(str, range(low, high + 1))) + ")", *names, *nothing])
    start = "|".join([_at_least(low), *names, *nothing])
    end = "|".join([f"(?!{_at_least(high + 1)}(?![0-9]))[0-9]*", *names])
    choices = [
        "[" + "".join("\\" + c for c in specials if not c.isalpha()) + "".join(filter(str.isalpha, specials)) + "]",
        f"(?:{start})-(?:{end})(?:-[^ ]*)?",
        f"(?:{within})(?:,(?:{within}))*",
        "[^ ,-]+/[^ ,-]*|/[^ ,-]+",
    ]
    return "(?:" + "|".join(choices) + ")"


# One pattern per field count; five fields start at minutes.
_PATTERNS = {
    5: " ".join(_field_pattern(f) for f in list(FIELDS)[1:6]),
    6: " ".join(_field_pattern(f) for f in list(FIELDS)[:6]),
    7: " ".join(_field_pattern(f) for f in FIELDS),
}


def value_allowed(field: str, col: Column) -> Column:
    """Validity of the text of one field."""
    return F.coalesce(col.rlike(rf"\A{_field_pattern(field)}\z"), F.lit(False))


def cron_valid(col: Column) -> Column:
    """Validity of an expression. A field count outside 5 to 7 counts as valid."""
    verdict = F.when(F.coalesce(col, F.lit("")) == "", False)
    for count, pattern in _PATTERNS.items():
        verdict = verdict.when(F.size(F.split(col, " ")) == count, col.rlike(rf"\A{pattern}\z"))
    return verdict.otherwise(True)


def cron_field(col: Column, field: str) -> Column:
    """Text of one field; ``'0'`` where the expression is invalid or gives none.

    With six fields everything but the seconds is read one place to the left.
    """
    index = list(FIELDS).index(field)
    parts = F.split(col, " ")
    count = F.size(parts)
    if field == "seconds":
        value = F.when(count >= 6, F.get(parts, F.lit(0))).otherwise("0")
    else:
        value = (
            F.when(count == 7, F.get(parts, F.lit(index)))
            .when(count.isin(5, 6), F.get(parts, F.lit(index - 1)))
            .otherwise("0")
        )
    return F.when(cron_valid(col), value).otherwise("0")


def cron_fields(col: Column) -> dict[str, Column]:
    return {field: cron_field(col, field) for field in FIELDS}

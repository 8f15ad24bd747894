"""Small column rules shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters counted as blank when a line or a flag is trimmed.
BLANKS = " \t\n\r\x0b\x0c"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim every kind of blank on both sides, not only spaces."""
    return F.btrim(_col(c), F.lit(BLANKS))


def non_blank(c: Column | str) -> Column:
    """The value, or null where it is empty."""
    return F.nullif(_col(c), F.lit(""))


def or_default(c: Column | str, default: Column | str) -> Column:
    """The value; the default where it is missing or empty."""
    return F.coalesce(non_blank(c), default if isinstance(default, Column) else F.lit(default))


def truthy_flag(c: Column | str, rule: str) -> Column:
    """Read a raw text flag by one of five rules.

    any_true   true, 1 or yes in any case; unset is false
    only_true  "true" in any case; unset is false
    exact_true "true" in lower case only; unset is false
    not_off    anything but 0, off or no, blanks trimmed; unset is true
    non_blank  any text at all; unset is false
    """
    raw = _col(c)
    if rule == "any_true":
        return F.coalesce(F.lower(raw).isin("true", "1", "yes"), F.lit(False))
    if rule == "only_true":
        return F.coalesce(F.lower(raw) == "true", F.lit(False))
    if rule == "exact_true":
        return F.coalesce(raw == "true", F.lit(False))
    if rule == "not_off":
        return F.coalesce(~F.lower(strip(raw)).isin("0", "off", "no"), F.lit(True))
    if rule == "non_blank":
        return F.coalesce(raw != "", F.lit(False))
    raise ValueError(f"unknown flag rule: {rule}")


def record_fingerprint(*cols: Column | str) -> Column:
    """SHA-256 over the fields as text, each closed by the record separator 0x1E."""
    parts = [F.concat(_col(c).cast("string"), F.lit("\x1e")) for c in cols]
    return F.concat(F.lit("dump_"), F.sha2(F.concat(*parts), 256))


def render_template(
    template: Column | str, values: dict[str, Column | str], show: Column | None = None
) -> Column:
    """Put each value in place of its `{{NAME}}`, literally and everywhere, in the given order.

    `template` is a text, or a column holding one. Missing values become empty text. With
    `show`, rows where it does not hold give empty text.
    """
    text = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        filled = F.coalesce(_col(value).cast("string"), F.lit(""))
        text = F.replace(text, F.lit("{{" + name + "}}"), filled)
    return text if show is None else F.when(show, text).otherwise(F.lit(""))

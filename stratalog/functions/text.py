"""Text, path and format helpers as column expressions."""

from __future__ import annotations

from datetime import timedelta
from decimal import Decimal
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of relative periods in seconds.
PERIOD_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 7 * 86400, "mo": 30 * 86400, "y": 365 * 86400}


def substr_count(text: Column, part: Column) -> Column:
    """How often ``part`` occurs without overlap; null or an empty part: 0."""
    n = (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)
    return F.coalesce(F.when(F.length(part) > 0, n.cast("bigint")), F.lit(0).cast("bigint"))


def depth(path: Column) -> Column:
    """Slashes in a path."""
    return substr_count(path, F.lit("/"))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_path(path: Column) -> Column:
    """What stands before the last slash; empty without one."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"[^.]\.([^.]+)$", 1)


def normalized_path(path: Column) -> Column:
    """Slashes forward, repeated ones and a last one dropped."""
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/{2,}", "/"), "(.)/$", "$1")


def with_suffix(path: Column, suffix: Column) -> Column:
    """``suffix`` in parentheses before the extension of the file name."""
    stem = F.regexp_replace(path, r"(?<=[^/.])\.[^./]+$", "")
    return F.concat(stem, F.lit(" ("), suffix, F.lit(")"), F.substring(path, F.length(stem) + 1, F.length(path)))


def creatable_name(name: Column) -> Column:
    """Without characters that some file systems refuse."""
    return F.regexp_replace(name, r'[\\/:*?"<>|\x00]', "")


def camel_case(text: Column) -> Column:
    """Parts split at dash, underscore and space, each begun with upper case."""
    parts = F.filter(F.split(text, "[-_ ]"), lambda x: x != "")
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))), "")


def snake_case(text: Column) -> Column:
    """Lower case with an underscore before each former upper case letter but the first, and for each character that is no letter or digit."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"(?<=.)(?=[A-Z])", "_"), r"[^a-zA-Z0-9_]", "_"))


def to_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def from_hex(text: Column) -> Column:
    """Bytes of hexadecimal text; an odd length is an error."""
    return F.when(F.length(text) % 2 == 1, F.raise_error(F.lit("hexadecimal text of odd length")).cast("binary")).otherwise(F.unhex(text))


def human_size(size: Column) -> Column:
    """Bytes in the largest unit that keeps them at 1 or more."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(size >= 1024**k, F.concat(F.format_number(size / 1024**k, 1), F.lit(f" {unit}"))).otherwise(out)
    return out


def has_dos_attribute(attrs: Column, letter: str) -> Column:
    """Whether an ``rhas`` text has one of its letters."""
    return F.coalesce(F.contains(attrs, F.lit(letter)), F.lit(False))


def parse_period(text: str) -> timedelta:
    """``1y2mo3w4d5h6m7s``, each part a number and a unit, summed."""
    parts = re.findall(r"(\d+(?:\.\d+)?)(mo|[smhdwy])", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"no period: {text}")
    return timedelta(seconds=float(sum(Decimal(n) * PERIOD_SECONDS[u] for n, u in parts)))

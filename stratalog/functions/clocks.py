"""Vector clocks as ``map<string,bigint>`` columns; a client that is missing counts as 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text form of a clock.
CLOCK_PATTERN = r"^\(([a-zA-Z]+\d+(,[a-zA-Z]+\d+)*)?\)$"
ENTRY_PATTERN = r"([a-zA-Z]+)(\d+)"

EQUAL, SMALLER, GREATER, SIMULTANEOUS = "EQUAL", "SMALLER", "GREATER", "SIMULTANEOUS"


def vc_parse(text: Column) -> Column:
    """``(A7,B2)`` to a map; null stays null, anything else is an error."""
    names = F.regexp_extract_all(text, F.lit(ENTRY_PATTERN), F.lit(1))
    times = F.transform(F.regexp_extract_all(text, F.lit(ENTRY_PATTERN), F.lit(2)), lambda x: x.cast("bigint"))
    bad = F.raise_error(F.concat(F.lit("no vector clock: "), text)).cast("map<string,bigint>")
    return F.when(text.isNull(), F.lit(None)).when(text.rlike(CLOCK_PATTERN), F.map_from_arrays(names, times)).otherwise(bad)


def vc_format(clock: Column) -> Column:
    """The text form, clients in order."""
    entries = F.array_sort(F.map_entries(clock))
    return F.concat(F.lit("("), F.array_join(F.transform(entries, lambda e: F.concat(e["key"], e["value"].cast("string"))), ","), F.lit(")"))


def vc_get(clock: Column, client: Column) -> Column:
    return F.coalesce(F.try_element_at(clock, client), F.lit(0).cast("bigint"))


def vc_increment(clock: Column, client: Column) -> Column:
    """One more for ``client`` (absent: 1); a client that isn't letters only is an error."""
    ok = F.when(client.rlike("^[a-zA-Z]+$"), client).otherwise(F.raise_error(F.concat(F.lit("no client name: "), client)).cast("string"))
    return F.map_concat(F.map_filter(clock, lambda k, _: k != client), F.create_map(ok, vc_get(clock, client) + 1))


def vc_compare(a: Column, b: Column) -> Column:
    """EQUAL, SMALLER (a happened before b), GREATER or SIMULTANEOUS."""
    steps = F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))))
    more, less = F.exists(steps, lambda d: d > 0), F.exists(steps, lambda d: d < 0)
    return F.when(more & less, SIMULTANEOUS).when(more, GREATER).when(less, SMALLER).when(a.isNotNull() & b.isNotNull(), EQUAL)


def vc_max(a: Column, b: Column) -> Column:
    """Each client's larger time: the clock that knows what both know."""
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))

"""Text formatting with half-even ties, as the report wording expects."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowquarry.functions.numeric import exact_round


def thousands(c: Column) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(c.cast("long"), 0)


def fixed(c: Column, digits: int) -> Column:
    """Fixed number of decimals, ties to even."""
    return F.format_string(f"%.{digits}f", exact_round(c, digits))


def percent(c: Column, digits: int = 1) -> Column:
    """Share as a percentage with a trailing sign."""
    return F.concat(fixed(c * 100, digits), F.lit("%"))


def joined(items: Column, default: str, sep: str = ", ") -> Column:
    """List as one text, ``default`` when it is null or empty."""
    return F.when(F.size(items) > 0, F.array_join(items, sep)).otherwise(F.lit(default))


def template(pattern: str, **parts: Column) -> Column:
    """``pattern`` with ``{name}`` replaced by columns."""
    pieces, rest = [], pattern
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        if head:
            pieces.append(F.lit(head))
        pieces.append(parts[name].cast("string"))
    if rest:
        pieces.append(F.lit(rest))
    return F.concat(*pieces)


def quoted(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def template_sql(pattern: str, prefix: str = "") -> str:
    """``pattern`` as SQL text, ``{name}`` standing for the column ``prefix + name``."""
    parts = re.split(r"\{(\w+)\}", pattern)
    cells = [f"cast(`{prefix}{p}` as string)" if i % 2 else quoted(p)
             for i, p in enumerate(parts) if p]
    return "concat(" + ", ".join(cells) + ")"


def has_suffix(c: Column, suffix: str = ".csv") -> Column:
    """File name test, exact case."""
    return F.endswith(c, F.lit(suffix))


def parse_json(c: Column, ddl: str) -> Column:
    """JSON text to a struct; malformed text gives null."""
    return F.from_json(c, ddl, {"mode": "PERMISSIVE"})


def parse_checked(c: Column, ddl: str) -> Column:
    """``value``, the JSON text as ``ddl``, and ``malformed``: the text itself where it is no JSON or doesn't fit.

    A missing field is null; a field of another type makes the text malformed. A null text has neither.
    """
    parsed = F.try_parse_json(c)
    fits = F.schema_of_variant(parsed).startswith("OBJECT")
    for field in T.StructType.fromDDL(ddl).fields:
        path = f"$.{field.name}"
        given = F.try_variant_get(parsed, path, "variant")
        missing = given.isNull() | F.coalesce(F.is_variant_null(given), F.lit(False))
        fits = fits & (missing | F.try_variant_get(parsed, path, field.dataType.simpleString()).isNotNull())
    value = F.when(fits, F.try_variant_get(parsed, "$", T.StructType.fromDDL(ddl).simpleString()))
    return F.struct(value.alias("value"), F.when(value.isNull(), c).alias("malformed"))


def encode_json(c: Column) -> Column:
    """A struct as JSON text; null fields are left out."""
    return F.to_json(c)

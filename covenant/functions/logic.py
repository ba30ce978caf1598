"""Three-valued logic, names and types as a contract means them."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def fails(check: Column) -> Column:
    """A CHECK fails only where it is false; null passes."""
    return ~F.coalesce(check, F.lit(True))


def visible(using: Column) -> Column:
    """A row filter shows only rows where it is true; null hides."""
    return F.coalesce(using, F.lit(False))


def any_of(column: Column, values: Sequence) -> Column:
    """``IN`` and ``= ANY(array)`` are one predicate."""
    return column.isin(list(values))


def differs(a: Column, b: Column) -> Column:
    """Null-safe inequality."""
    return ~a.eqNullSafe(b)


def row_is_not_null(*columns: Column) -> Column:
    """``ROW(..) IS NOT NULL`` as the standard has it: every field is not null."""
    return reduce(lambda x, y: x & y, [c.isNotNull() for c in columns])


def glob(pattern: str) -> str:
    """``*``, ``?``, ``[a-z]`` and ``[^a-z]`` of a name pattern as an anchored
    regular expression; a backslash takes what follows as it is. An unclosed class
    and a backslash at the end are errors."""
    out, i = [], 0

    def escaped(at: int) -> str:
        if at + 1 >= len(pattern):
            raise ValueError(f"backslash at the end of {pattern!r}")
        return re.escape(pattern[at + 1])

    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(escaped(i))
            i += 1
        elif c == "[":
            inner, i = ["["], i + 1
            if pattern[i : i + 1] == "^":
                inner.append("^")
                i += 1
            first = i
            while i < len(pattern) and (pattern[i] != "]" or i == first):
                if pattern[i] == "\\":
                    inner.append(escaped(i))
                    i += 1
                else:
                    inner.append("\\" + pattern[i] if pattern[i] in "[]&^" else pattern[i])
                i += 1
            if i >= len(pattern):
                raise ValueError(f"unclosed class in {pattern!r}")
            out.append("".join(inner) + "]")
        else:
            out.append({"*": ".*", "?": "."}.get(c, re.escape(c)))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def name_matches(name: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Kept if any include matches (or none is given) and no exclude does."""
    kept = reduce(lambda x, y: x | y, [name.rlike(glob(p)) for p in include], F.lit(not include))
    return reduce(lambda x, y: x & ~y, [name.rlike(glob(p)) for p in exclude], kept)


#: Other names of types, and serial types as what they store.
TYPE_ALIASES = {
    "int": "integer", "int4": "integer", "serial": "integer", "serial4": "integer",
    "int8": "bigint", "bigserial": "bigint", "serial8": "bigint",
    "int2": "smallint", "smallserial": "smallint", "serial2": "smallint",
    "float4": "real", "float8": "double precision", "float": "double precision",
    "bool": "boolean", "varchar": "character varying", "char": "character", "bpchar": "character",
    "decimal": "numeric", "varbit": "bit varying",
    "timestamptz": "timestamp with time zone", "timestamp": "timestamp without time zone",
    "timetz": "time with time zone", "time": "time without time zone",
}


def type_name(name: Column, own_schema: Column | None = None, aliases: Mapping[str, str] = TYPE_ALIASES) -> Column:
    """A type's name in its usual form: aliases resolved, spaces in modifiers gone,
    the object's own schema dropped; array brackets stay."""
    low = F.lower(F.trim(name))
    if own_schema is not None:
        low = F.when(F.startswith(low, F.concat(own_schema, F.lit("."))), F.substr(low, F.length(own_schema) + 2)).otherwise(low)
    base = F.regexp_extract(low, r"^([^\(\[]*)", 1)
    rest = F.regexp_replace(F.substr(low, F.length(base) + 1), r"\s+", "")
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    full = F.coalesce(known[F.trim(base)], F.trim(base))
    # a precision stands before the zone: timestamp(3) with time zone
    zoned = F.regexp_extract(full, r"^(time|timestamp)( with(?:out)? time zone)$", 1) != ""
    digits = F.regexp_extract(rest, r"^(\(\d+\))", 1)
    placed = F.concat(F.regexp_extract(full, r"^(\w+)", 1), digits, F.regexp_replace(full, r"^\w+", ""), F.substr(rest, F.length(digits) + 1))
    return F.when(zoned, placed).otherwise(F.concat(full, rest))


def ordered(column: str, descending: bool = False, collation: str | None = None) -> Column:
    """Nulls last ascending and first descending, whatever Spark's default."""
    c = F.col(column) if collation is None else F.collate(F.col(column), collation)
    return c.desc_nulls_first() if descending else c.asc_nulls_last()


def collation_equal(a: Column, b: Column) -> Column:
    """Whether two names of collations mean one: the last parts agree, and so do
    the schemas where both are given; none only equals none."""
    part = lambda c: F.split(F.replace(c, F.lit('"'), F.lit("")), r"\.")
    last = F.element_at(part(a), -1) == F.element_at(part(b), -1)
    schemas = (F.size(part(a)) < 2) | (F.size(part(b)) < 2) | (part(a)[0] == part(b)[0])
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(last & schemas)


#: A cast behind a value in a default, such as ::character varying(40)[].
CAST = r"::\s*\"?[A-Za-z_][\w.\"]*(?: varying| precision| with(?:out)? time zone)?(?:\([\d, ]*\))?(?:\[\])*(?=(?:[^']*'[^']*')*[^']*$)"


def default_value(default: Column) -> Column:
    """A default without its casts and outer white space."""
    return F.trim(F.regexp_replace(default, CAST, ""))

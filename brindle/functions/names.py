"""Structured names as columns: extensions, positional fields, identities, ages, natural order."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The extensions that count as volumes.
EXTENSIONS = ["nii.gz", "nii", "mgz", "mha", "mhd", "nrrd"]
SCHEMA = ("id", "session", "age", "weighting")
AGE = r"[-+]?\d*\.?\d+"


def strip_ext(path: Column) -> Column:
    """The file name without its directory and without one known extension, in any case."""
    return F.regexp_replace(F.regexp_extract(path, r"[^/]*$", 0), r"(?i)\.(" + "|".join(e.replace(".", r"\.") for e in EXTENSIONS) + ")$", "")


def schema_fields(schema: str | list[str]) -> list[str]:
    parts = schema.split(",") if isinstance(schema, str) else schema
    return [p.strip() for p in parts if p.strip()]


def field(stem: Column, i: int) -> Column:
    """The i-th (from 0) part between underscores, empty where there is none."""
    return F.coalesce(F.get(F.split(stem, "_"), F.lit(i)), F.lit(""))


def parsed(stem: Column, schema: tuple[str, ...] = SCHEMA) -> list[Column]:
    n = F.size(F.split(stem, "_"))
    return [field(stem, i).alias(f) for i, f in enumerate(schema)] + [n.alias("n_tokens"), (n == len(schema)).alias("ok")]


def fault(stem: Column, schema: tuple[str, ...] = SCHEMA) -> Column:
    """Why a stem doesn't fit the schema, null if it does: the number of tokens, else the fields that are empty."""
    n = F.size(F.split(stem, "_"))
    empty = F.filter(F.array(*[F.when(field(stem, i) == "", F.lit(f)) for i, f in enumerate(schema)]), lambda x: x.isNotNull())
    return F.when(n != len(schema), F.concat(F.lit("tokens:"), n.cast("string"))).when(F.size(empty) > 0, F.concat(F.lit("empty:"), F.array_join(empty, ",")))


def identity(stem: Column, *parts: Column) -> Column:
    """The parts joined by underscores, or the whole stem if one is empty."""
    whole = F.lit(True)
    for p in parts:
        whole = whole & (p != "")
    return F.when(whole, F.concat_ws("_", *parts)).otherwise(stem)


def group_key(stem: Column, level: str) -> Column:
    if level not in ("subject", "session", "volume"):
        raise ValueError(f"no such level: {level}")
    return {"subject": identity(stem, field(stem, 0)), "session": identity(stem, field(stem, 0), field(stem, 1)), "volume": stem}[level]


def extracted(stem: Column, pattern: str) -> Column:
    """What a pattern's first group finds in a stem (all that it matches where it has no group), null where it finds nothing: in place of a schema's field."""
    return F.nullif(F.regexp_extract(stem, pattern, int(re.compile(pattern).groups > 0)), F.lit(""))


def subgroup(weighting: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(weighting), F.lit("")), F.lit("unknown"))


def age_number(token: Column) -> Column:
    return F.nullif(F.regexp_extract(token, AGE, 0), F.lit("")).try_cast("double")


def _by_value(digits: Column) -> Column:
    """Sorts digits without leading zeros by their number, then by themselves."""
    return F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)


def natural_key(name: Column) -> Column:
    """Sorts names so that runs of digits compare by value."""
    return F.transform(F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1)), lambda t: F.when(t.rlike(r"^\d+$"), _by_value(F.regexp_replace(t, "^0+", ""))).otherwise(t))


def _class(inside: str) -> str:
    """What stands between brackets, with its ranges; one that runs backwards holds nothing."""
    out, i = "", 0
    while i < len(inside):
        if inside[i + 1 : i + 2] == "-" and i + 2 < len(inside):
            if inside[i] <= inside[i + 2]:
                out += re.escape(inside[i]) + "-" + re.escape(inside[i + 2])
            i += 3
        else:
            out += re.escape(inside[i])
            i += 1
    return out


def glob_regex(pattern: str) -> str:
    """The regular expression of a shell pattern: * and ?, and [...] with ranges and ! first; a [ that nothing closes is itself."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] == "!")) if c == "[" else -1
        if end > 0:
            inside = pattern[i + 1 : end]
            inverse, inside = inside.startswith("!"), inside.removeprefix("!")
            held = _class(inside)
            out += "[" + "^" * inverse + held + "]" if held else "." if inverse else "(?!)"
            i = end
        else:
            out += {"*": ".*", "?": "."}.get(c) or re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def matches_any(name: Column, patterns: list[str]) -> Column:
    """True if a pattern fits: a glob (see glob_regex) if it has * ? or [, else a part of the name."""
    out = F.lit(False)
    for p in patterns:
        out = out | (name.rlike(glob_regex(p)) if re.search(r"[*?\[]", p) else name.contains(p))
    return out


def parse_counts(text: str) -> dict[str, int]:
    """'t1w=8;T2w=3' as a dict with lower-cased keys; of repeated keys the last counts."""
    return {k.strip().lower(): int(v) for k, v in (x.split("=") for x in re.split("[,;]", text) if x.strip())}

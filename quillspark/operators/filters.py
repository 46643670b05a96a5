"""Filter languages compiled to Columns.

Three forms are told apart as users write them: JSON (must, should, must_not, min_should, nested), extended terms
``key:op:value`` and simple terms ``key=value``. A string is compared with a column of another type only after a
cast; under ``strict`` it never matches, as in a store without coercion.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPS = {"gte": "__ge__", "gt": "__gt__", "lte": "__le__", "lt": "__lt__"}
TRUE, FALSE = F.lit, F.lit


def _type(df: DataFrame, key: str) -> T.DataType | None:
    """The type of a column or of a struct's field; None if there is none."""
    at: T.DataType = df.schema
    for part in key.split("."):
        if not isinstance(at, T.StructType) or part not in at.names:
            return None
        at = at[part].dataType
    return at


def equals(df: DataFrame, key: str, value, strict: bool = False) -> Column:
    """Equality as a payload test: on an array any element; a missing column or null never matches."""
    t = _type(df, key)
    if t is None:
        return F.lit(False)
    element = t.elementType if isinstance(t, T.ArrayType) else t
    if isinstance(value, str) != isinstance(element, T.StringType):
        if strict:
            return F.lit(False)
        value = F.expr(f"try_cast('{str(value)}' as {element.simpleString()})") if re.fullmatch(r"[\w.+-]*", str(value)) else F.lit(None).cast(element)
    else:
        value = F.lit(value)
    hit = F.array_contains(F.col(key), value) if isinstance(t, T.ArrayType) else F.col(key) == value
    return F.coalesce(hit, F.lit(False))


def any_of(df: DataFrame, key: str, values: list, strict: bool = False) -> Column:
    return reduce(lambda a, b: a | b, [equals(df, key, v, strict) for v in values], F.lit(False))


def within(df: DataFrame, key: str, bounds: dict[str, float]) -> Column:
    """Numeric comparison; anything but a number never matches."""
    if _type(df, key) is None:
        return F.lit(False)
    c = F.col(key).cast("double") if not isinstance(_type(df, key), T.StringType) else F.lit(None).cast("double")
    return F.coalesce(reduce(lambda a, b: a & b, [getattr(c, OPS[o])(F.lit(float(v))) for o, v in bounds.items() if o in OPS], F.lit(True)), F.lit(False))


def contains(df: DataFrame, key: str, text: str) -> Column:
    """Case-sensitive substring."""
    return F.coalesce(F.col(key).cast("string").contains(text), F.lit(False)) if _type(df, key) is not None else F.lit(False)


def parse(df: DataFrame, expr: str | None, strict: bool = False) -> Column | None:
    """A Column for any of the forms; None for an empty filter."""
    if not expr or not expr.strip():
        return None
    e = expr.strip()
    if e.startswith("{"):
        return from_json(df, json.loads(e), strict)
    if ":" in e and e.count(":") != e.count("="):
        return extended(df, e, strict)
    return simple(df, e, strict)


def simple(df: DataFrame, expr: str, strict: bool = False) -> Column | None:
    """k=v terms joined by commas, all of which must hold; terms without = are left out."""
    terms = [t.split("=", 1) for t in expr.split(",") if "=" in t]
    return reduce(lambda a, b: a & b, [equals(df, k.strip(), v.strip(), strict) for k, v in terms]) if terms else None


def terms_of(expr: str) -> list[list[str]]:
    """k:op:v terms; what follows a comma and is no term belongs to the list of an ``in`` before it."""
    out: list[list[str]] = []
    for part in expr.split(","):
        p = [x.strip() for x in part.split(":", 2)]
        if len(p) == 3:
            out.append(p)
        elif out and out[-1][1] == "in":
            out[-1][2] += "," + part.strip()
    return out


def extended(df: DataFrame, expr: str, strict: bool = False) -> Column | None:
    """k:op:v terms with match, in, gte, gt, lte, lt, contains; unknown operators and non-numeric bounds are left out.

    With ``strict`` an ``in`` keeps its first value only, as where terms are split at every comma.
    """
    found = []
    for key, op, value in terms_of(expr):
        if op == "in":
            values = [v.strip() for v in value.split(",")]
            found.append(any_of(df, key, values[:1] if strict else values, strict))
        elif op in OPS:
            try:
                found.append(within(df, key, {op: float(value)}))
            except ValueError:
                continue
        elif op == "contains":
            found.append(contains(df, key, value))
        elif op == "match":
            found.append(equals(df, key, value, strict))
    return reduce(lambda a, b: a & b, found) if found else None


def from_json(df: DataFrame, spec: dict, strict: bool = False) -> Column:
    """must, should, must_not, min_should and nested filters."""

    def one(c: dict) -> Column:
        if "key" in c:
            key, m = c["key"], c.get("match", {})
            if "range" in c:
                return within(df, key, c["range"])
            if "value" in m:
                return equals(df, key, m["value"], strict)
            if "any" in m:
                return any_of(df, key, m["any"], strict)
            if "except" in m:
                return F.col(key).isNotNull() & ~any_of(df, key, m["except"], strict)
            if "text" in m:
                return contains(df, key, m["text"])
            raise ValueError(f"no condition on {key}")
        if "is_null" in c:
            return F.col(c["is_null"]["key"]).isNull()
        if "is_empty" in c:
            k = c["is_empty"]["key"]
            t = _type(df, k)
            return F.lit(True) if t is None else F.col(k).isNull() | (F.size(k) == 0 if isinstance(t, T.ArrayType) else F.lit(False))
        return from_json(df, c, strict)

    some = lambda k: [one(c) for c in (spec.get(k) or [])]
    out = reduce(lambda a, b: a & b, some("must"), F.lit(True))
    if should := some("should"):
        out = out & reduce(lambda a, b: a | b, should)
    if no := some("must_not"):
        out = out & ~reduce(lambda a, b: a | b, no)
    if least := spec.get("min_should"):
        hits = [one(c).cast("int") for c in least["conditions"]]
        out = out & (reduce(lambda a, b: a + b, hits, F.lit(0)) >= least["min_count"])
    return out


def describe(expr: str | None) -> str:
    """The filter for people."""
    if not expr or not expr.strip():
        return "No filters applied"
    e = expr.strip()
    if e.startswith("{"):
        return "Complex filter"
    return " AND ".join(t.strip() for t in e.split(",") if t.strip())


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression; * goes over slashes too."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + (pattern[i : i + 1] in ("!", "]")))) > 0:
            body = pattern[i:end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = end + 1
        else:
            out.append(re.escape(c))
    return "(?s)^" + "".join(out) + "$"


def globs(path: Column, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """Any of include, none of exclude; a row without path is kept."""
    keep = F.lit(True)
    if include:
        keep = keep & reduce(lambda a, b: a | b, [path.rlike(glob_regex(p)) for p in include])
    for p in exclude:
        keep = keep & ~path.rlike(glob_regex(p))
    return path.isNull() | keep


def repositories(df: DataFrame, names: list[str]) -> Column:
    """name#branch selects the identifier, a bare name the project."""
    ids, bare = [n for n in names if "#" in n], [n for n in names if "#" not in n]
    return F.col("git_project_identifier").isin(*ids) | F.col("git_project_name").isin(*bare) if ids and bare else F.col("git_project_identifier").isin(*ids) if ids else F.col("git_project_name").isin(*bare)


class FilterError(ValueError):
    """A text filter that does not parse, or that uses an attribute not declared as filterable."""


_LEX = re.compile(r"\s*(?:(?P<str>\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|(?P<op><=|>=|!=|=|<|>|\(|\)|\[|\]|,)|(?P<word>[^\s()\[\],=<>!\"']+))")


def text_filter(df: DataFrame, expr: str, filterable: list[str] | None = None) -> Column:
    """=, !=, <, <=, >, >=, a TO b, IN [..], EXISTS, IS NULL, IS EMPTY, NOT, AND, OR, brackets.

    Strings compare without regard to case. NOT binds closest, then AND, then OR. ``!=`` and NOT hold for nulls.
    """
    tokens, at = [], 0
    e = expr.strip()
    while at < len(e):
        m = _LEX.match(e, at)
        if not m:
            raise FilterError(f"cannot read the filter at {at}: {e[at:at + 20]!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    pos = 0

    def peek(*words: str) -> bool:
        return pos < len(tokens) and tokens[pos][0] != "str" and tokens[pos][1].upper() in words

    def take(*words: str) -> bool:
        nonlocal pos
        if peek(*words):
            pos += 1
            return True
        return False

    def value() -> str:
        nonlocal pos
        if pos >= len(tokens):
            raise FilterError("the filter ends too early")
        kind, v = tokens[pos]
        pos += 1
        if kind == "op":
            raise FilterError(f"{v} where a value belongs")
        return re.sub(r"\\(.)", r"\1", v[1:-1]) if kind == "str" else v

    def same(key: str, v: str) -> Column:
        t = _type(df, key)
        lower = F.lit(v.lower())
        if isinstance(t, T.ArrayType):
            hit = F.exists(F.col(key), lambda x: F.lower(x.cast("string")) == lower)
        elif isinstance(t, T.StringType):
            hit = F.lower(key) == lower
        else:
            hit = equals(df, key, v)
        return F.coalesce(hit, F.lit(False))

    def either() -> Column:
        out = both()
        while take("OR"):
            out = out | both()
        return out

    def both() -> Column:
        out = unary()
        while take("AND"):
            out = out & unary()
        return out

    def unary() -> Column:
        if take("NOT"):
            return ~unary()
        if take("("):
            out = either()
            if not take(")"):
                raise FilterError("a bracket is not closed")
            return out
        return condition()

    def condition() -> Column:
        key = value()
        if filterable is not None and key not in filterable:
            raise FilterError(f"{key} is not filterable; filterable are {', '.join(sorted(filterable))}. Match content by a search for the words instead")
        t = _type(df, key)
        if t is None:
            raise FilterError(f"there is no attribute {key}")
        negated = take("NOT")
        if take("EXISTS"):
            out = F.col(key).isNotNull()
        elif take("IN"):
            if not take("["):
                raise FilterError("IN needs a list")
            vs = []
            while not take("]"):
                vs.append(value())
                take(",")
            out = reduce(lambda a, b: a | b, [same(key, v) for v in vs], F.lit(False))
        elif take("IS"):
            negated = take("NOT") or negated
            if take("NULL"):
                out = F.col(key).isNull()
            elif take("EMPTY"):
                out = F.coalesce(F.size(key) == 0 if isinstance(t, T.ArrayType) else F.col(key).cast("string") == "", F.lit(False))
            else:
                raise FilterError("IS needs NULL or EMPTY")
        elif take("="):
            out = same(key, value())
        elif take("!="):
            out = ~same(key, value())
        elif peek("<", "<=", ">", ">="):
            nonlocal pos
            op = {"<": "lt", "<=": "lte", ">": "gt", ">=": "gte"}[tokens[pos][1]]
            pos += 1
            out = within(df, key, {op: number(value())})
        else:
            low = number(value())
            if not take("TO"):
                raise FilterError(f"no condition on {key}")
            out = within(df, key, {"gte": low, "lte": number(value())})
        return ~out if negated else out

    def number(v: str) -> float:
        try:
            return float(v)
        except ValueError:
            raise FilterError(f"{v} is no number") from None

    out = either()
    if pos < len(tokens):
        raise FilterError(f"{tokens[pos][1]} is left over")
    return out

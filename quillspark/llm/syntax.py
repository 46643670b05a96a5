"""Problem 6: source files that do not parse.

Every file is parsed by all supported grammars, in the order its tokens speak for them. A file that the grammar of
its extension accepts is valid, unless that grammar takes it only as one bare scalar, as YAML takes nearly any words,
and a stricter one accepts it as a program. Otherwise the first foreign grammar that accepts it tells that the
extension is wrong; if all fail, the file is corrupt, by merge conflict, truncation or otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codefiles import FILE
from .grammar import EXTENSIONS, Undecided, error_of, one_scalar, ranked

CONFLICT = re.compile(r"^(?:<{7}(?: .*)?|={7}|>{7}(?: .*)?)$", re.M)


#: The verdicts that call a file invalid.
INVALID = ("wrong_extension", "conflict", "corrupt")


def parses(code: str, memory: dict) -> dict[str, str | None]:
    """language -> why it does not accept the text (None if it does), likeliest language first; undecided ones are left out."""
    out: dict[str, str | None] = {}
    for language in ranked(code):
        try:
            out[language] = error_of(code, language, memory)
        except Undecided:
            pass
    return out


def verdict(code: str, language: str | None, memory: dict) -> tuple[str, str | None, str | None]:
    """(valid | wrong_extension | conflict | corrupt | undecided | unsupported, the language that accepts it, the error).

    An unknown language (None) is unsupported; the likeliest grammar that accepts the text is told all the same. Undecided
    is a text that the grammar of its extension cannot follow to its depth, or for which no parser is there.
    """
    errors = parses(code, memory)
    # Nearly any prose is YAML, so YAML is no finding where the file's tokens speak for nothing.
    loose = errors.get("yaml", "") is None and one_scalar(code)
    foreign = [x for x, e in errors.items() if e is None and x != language and not (x == "yaml" and (loose or not re.search(r"^[\w\"'-]+:(?:\s|$)|^- ", code, re.M)))] if code.strip() else []
    if language is None:
        return "unsupported", foreign[0] if foreign else None, None
    if language not in errors:
        return "undecided", None, None
    error = errors[language]
    if error is None:
        strict = [x for x in foreign if x not in ("yaml", "json")] if language == "yaml" and loose and len(code.split()) > 3 else []
        return ("wrong_extension", strict[0], "a bare scalar") if strict else ("valid", language, None)
    if foreign:
        return "wrong_extension", foreign[0], error
    return ("conflict" if CONFLICT.search(code) else "corrupt"), None, error


def checked(files: DataFrame) -> DataFrame:
    """One row per file: FILE, language, verdict, accepted_as, error.

    An empty or blank file is valid but for JSON. A file of an extension without grammar has a null language and is
    unsupported, which is no finding against it.
    """
    f = files.select(*FILE, "extension", "content")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory: dict = {}
        for p in batches:
            rows = []
            for e, code in zip(p["extension"], p["content"], strict=True):
                language = EXTENSIONS.get(e)
                rows.append((language, *verdict(code or "", language, memory)))
            out = pd.DataFrame(rows, columns=["language", "verdict", "accepted_as", "error"])
            for i, c in enumerate(FILE):
                out.insert(i, c, p[c].to_numpy())
            yield out

    return f.mapInPandas(check, ", ".join(f"{c} string" for c in FILE) + ", language string, verdict string, accepted_as string, error string")


def invalid(found: DataFrame) -> DataFrame:
    return found.filter(F.col("verdict").isin(*INVALID))


def rates(found: DataFrame) -> DataFrame:
    """Files and invalid files per repository and language, with the rate; files without grammar have a null language and no rate."""
    bad = F.col("verdict").isin(*INVALID)
    return found.groupBy("git_project_identifier", "language").agg(
        F.count("*").alias("files"), F.count_if(bad).alias("invalid_files"), F.count_if(F.col("verdict") == "wrong_extension").alias("wrong_extension_files"),
        F.when(F.col("language").isNotNull(), F.round(F.avg(bad.cast("double")), 6)).alias("invalid_rate"),
    )

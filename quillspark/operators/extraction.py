"""Choosing and joining the texts that extraction and OCR give of a file."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

SEPARATOR = "\n\n[OCR fallback text]\n\n"


def merged_text(extracted: Column, ocr: Column) -> Column:
    """The extracted text, then the OCR's; either alone where the other is blank."""
    return F.when(tx.is_blank(ocr), F.coalesce(extracted, F.lit(""))).when(tx.is_blank(extracted), ocr).otherwise(F.concat(extracted, F.lit(SEPARATOR), ocr))


def merge_strategy(extracted: Column, ocr: Column) -> Column:
    return F.when(tx.is_blank(ocr), "ocr_failed_no_text").when(tx.is_blank(extracted), "ocr_only_empty_extraction").otherwise("append_ocr_to_extracted_text")


def merged_boundaries(extracted: Column, own: Column, ocr: Column, theirs: Column) -> Column:
    """Page boundaries of the merged text: the OCR's moved behind the extracted text."""
    move = F.when(tx.is_blank(extracted), 0).otherwise(F.length(extracted) + len(SEPARATOR))
    moved = F.transform(theirs, lambda b: F.struct(b["page_number"].alias("page_number"), (b["start_char"] + move).cast("int").alias("start_char"), b["page_text_length"].alias("page_text_length")))
    return F.when(tx.is_blank(ocr), own).when(tx.is_blank(extracted), moved).otherwise(F.concat(own, moved))


def action(text: Column, pages: Column, least: int = 100, score: float = 0.7) -> Column:
    """What a file's extraction calls for: ocr (too short, garbled or poor), plain (too little for its pages) or keep."""
    n = F.coalesce(F.length(text), F.lit(0))
    return F.when((n < least) | tx.needs_ocr(text) | (tx.score_text(text) < score), "ocr").when(tx.looks_like_dropout(n, pages), "plain").otherwise("keep")


def recovered(first: Column, plain: Column) -> Column:
    """dropout_recovered where plain extraction gave more than twice the text, extraction_floor otherwise."""
    n, m = F.coalesce(F.length(first), F.lit(0)), F.coalesce(F.length(plain), F.lit(0))
    return F.when(m > 2 * n, "dropout_recovered").otherwise("extraction_floor")


def confidence(value: Column) -> Column:
    """An OCR confidence from text; what is no number or negative is none."""
    c = value.try_cast("double")
    return F.when((c >= 0) & ~F.isnan(c), c)


def late_chunking(tokens: Column, supported: bool = True) -> Column:
    """Whether a text of so many tokens is chunked late: between 2,000 and 8,000, by a model that can."""
    return F.lit(supported) & (tokens > 2000) & (tokens < 8000)


def ocr_summary(pages: DataFrame, keys: list[str], page_confidence: str, text: str, low: float = 60, digits: int = 3) -> DataFrame:
    """Pages, pages without text, low-confidence pages, and the mean confidence of pages with text."""
    blank = tx.is_blank(F.col(text))
    c = F.when(~blank, F.col(page_confidence))
    return pages.groupBy(*keys).agg(F.count("*").alias("pages"), F.count_if(blank).alias("empty_pages"), F.count_if(c < low).alias("low_confidence_pages"), F.round(F.avg(c), digits).alias("mean_confidence"))


def matches_source(stored: Column, text: Column, xxh64: Column | None = None, xxh3: Column | None = None) -> Column:
    """Whether a stored hash is the content's: a prefix of its SHA-256, or one of the other hashes; null content matches."""
    ok = F.sha2(text, 256).startswith(stored)
    for other in (xxh64, xxh3):
        if other is not None:
            ok = ok | (stored == other)
    return F.when(text.isNull(), True).otherwise(F.coalesce(ok, F.lit(False)))


FRONTMATTER = "has_frontmatter boolean, title string, author string, tags array<string>, category string, project string, created_at string, custom string"


def frontmatter(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The YAML head of each markdown text: known fields, and the rest as JSON. A head that does not parse is none."""
    kind = docs.schema[key].dataType.simpleString()

    def read(t: str | None) -> tuple:
        import json
        import re

        none = (False, None, None, [], None, None, None, None)
        m = re.match(r"---[ \t]*\r?\n(.*?)\r?\n(?:---|\.\.\.)[ \t]*(?:\r?\n|$)", t or "", re.S)
        if not m:
            return none
        try:
            import yaml

            v = yaml.safe_load(m[1])
        except ImportError:
            v = {k.strip(): x.strip().strip("'\"") for k, _, x in (line.partition(":") for line in m[1].splitlines()) if x}
        except Exception:  # noqa: BLE001 - whatever is wrong with it, it is no head
            return none
        if not isinstance(v, dict) or not v:
            return none
        tags = v.pop("tags", [])
        tags = [x.strip() for x in tags.split(",") if x.strip()] if isinstance(tags, str) else [str(x) for x in tags] if isinstance(tags, list) else []
        date = v.pop("date", None)
        known = [v.pop(k, None) for k in ("title", "author", "category", "project", "created_at")]
        s = [None if x is None else str(x) for x in known]
        return (True, s[0], s[1], tags, s[2], s[3], s[4] or (None if date is None else str(date)), json.dumps(v, default=str, sort_keys=True) if v else None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.strip().split()[0] for f in FRONTMATTER.split(",")]
        for p in batches:
            out = pd.DataFrame([read(t) for t in p["_t"]], columns=names)
            out.insert(0, key, p["_k"].to_numpy())
            yield out

    return docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).mapInPandas(run, f"{key} {kind}, {FRONTMATTER}")


def page_offsets(pages: DataFrame, keys: list[str], order: list[str], content: str) -> DataFrame:
    """``pages`` with start_char and end_char: where each page stands in the file's text, pages joined by one character.

    ``order`` should end in a key. A null content has no characters.
    """
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    n = F.coalesce(F.length(content), F.lit(0)).cast("long")
    start = F.coalesce(F.sum(n + 1).over(before), F.lit(0)).cast("long")
    return pages.withColumn("start_char", start).withColumn("end_char", F.col("start_char") + n + 1)


def page_of(chunks: DataFrame, pages: DataFrame, keys: list[str], at: str = "start_char") -> DataFrame:
    """``chunks`` with the number of the page their first character is on; null if it is on none. pages: of ``page_offsets``."""
    p = pages.select(*keys, "page_number", F.col("start_char").alias("_a"), F.col("end_char").alias("_b"))
    on = [chunks[k].eqNullSafe(p[k]) for k in keys] + [chunks[at] >= p["_a"], chunks[at] < p["_b"]]
    return chunks.join(p, on, "left").select(*[chunks[c] for c in chunks.columns], "page_number")

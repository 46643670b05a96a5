"""Text functions as native column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The English stop words of the quality score.
QUALITY_STOP_WORDS = (
    "the of and is in to for a that with on are was it be as at by this from or an have has not but can which "
    "their will been would each were do there"
).split()

#: White space as Python's strip() knows it: Unicode's, and U+001C to U+001F.
BLANK = r"(?U)^[\s\x1c-\x1f]*$"


def is_blank(text: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(text.rlike(BLANK), F.lit(True))


def words(text: Column) -> Column:
    """Runs of ASCII letters, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


# The counts below are plain expressions outside any branch, so that generated code makes each of them once per row
# however often it is named; try_divide is null for empty texts.


def _n_words(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit("[a-z]+"))


def _stop_share(text: Column) -> Column:
    stop = F.regexp_count(F.lower(text), F.lit("(?<![a-z])(?:" + "|".join(QUALITY_STOP_WORDS) + ")(?![a-z])"))
    return F.try_divide(stop.cast("double"), _n_words(text))


def _mean_length(text: Column) -> Column:
    return F.try_divide(F.length(F.regexp_replace(F.lower(text), "[^a-z]+", "")).cast("double"), _n_words(text))


def _replacement_share(text: Column) -> Column:
    return F.try_divide((F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))).cast("double"), F.length(text))


def _printable_share(text: Column) -> Column:
    return F.try_divide(F.length(F.regexp_replace(text, r"[^\x20-\x7e\n\r\t]+", "")).cast("double"), F.length(text))


def score_text(text: Column) -> Column:
    """Readability from 0 to 1: replacement characters, stop words, printable characters, word length. Null counts as blank."""
    n, mean = _n_words(text), _mean_length(text)
    length = F.when(n == 0, 0.0).when((mean > 15) | (mean < 2), 0.2).when(mean > 10, 0.6).otherwise(1.0)
    score = (
        0.35 * F.greatest(F.lit(0.0), 1 - 10 * _replacement_share(text))
        + 0.30 * F.least(F.lit(1.0), F.coalesce(_stop_share(text) / 0.15, F.lit(0.0)))
        + 0.20 * F.least(F.lit(1.0), _printable_share(text) / 0.7)
        + 0.15 * length
    )
    sound = 1 - is_blank(text).cast("int")
    return F.coalesce(sound * F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 3), F.lit(0.0))


def needs_ocr(text: Column) -> Column:
    """Whether the text looks garbled enough for another extraction."""
    n = _n_words(text)
    return F.coalesce(
        is_blank(text) | (_replacement_share(text) > 0.05) | ((n == 0) & (F.length(text) > 100) & (_printable_share(text) < 0.1)) | ((n > 100) & (_stop_share(text) < 0.02)),
        F.lit(False),
    )


def looks_like_dropout(n_chars: Column, pages: Column, per_page: int = 500, least_pages: int = 2) -> Column:
    """Far too little text for the pages; false for null page counts and short documents."""
    return F.when(pages.isNull() | (pages < least_pages), False).otherwise(F.coalesce(n_chars, F.lit(0)) / pages < per_page)


def sanitize(text: Column) -> Column:
    """Control characters other than tab and line ends become blanks."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")


def normalize_whitespace(text: Column) -> Column:
    """Tabs and Unicode blanks to blanks, four or more line breaks to three, ends stripped."""
    one = F.regexp_replace(text, "[\\t   -   　]", " ")
    return F.regexp_replace(F.regexp_replace(one, r"\n{4,}", "\n\n\n"), r"^\s+|\s+$", "")


def normalize_text(text: Column) -> Column:
    """Also runs of blanks to one, three or more line breaks to two, and line ends stripped."""
    one = F.regexp_replace(F.regexp_replace(text, " +", " "), r"\n{3,}", "\n\n")
    return normalize_whitespace(F.regexp_replace(one, r"[ \t]+(?=\n)", ""))


def snippet(text: Column, length: int = 200) -> Column:
    """The text's beginning, cut at a blank if one stands in the last fifth, with an ellipsis."""
    cut = F.substring(text, 1, length)
    last = F.length(cut) - F.locate(" ", F.reverse(cut))  # 0-based place of the last blank
    shorter = F.when((F.locate(" ", F.reverse(cut)) > 0) & (last > 0.8 * length), F.substring(cut, F.lit(1), last)).otherwise(cut)
    return F.when(F.length(text) <= length, text).otherwise(F.concat(shorter, F.lit("...")))


def slugify(text: Column, length: int = 50) -> Column:
    """Lower-case letters, digits and single hyphens; ``untitled`` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), r"[\s_]+", "-"), r"[^a-z0-9\-]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"^-+|-+$", ""), "-+", "-")
    s = F.regexp_replace(F.substring(s, 1, length), "-+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", "untitled").otherwise(s)


def title(text: Column, stem: Column) -> Column:
    """The first top heading, else the file's stem."""
    t = F.regexp_extract(text, r"(?m)^#[ \t]+(\S.*)$", 1)
    return F.when(t != "", t).otherwise(stem)


def headings(text: Column) -> Column:
    """All headings, joined by bars."""
    return F.array_join(F.regexp_extract_all(text, F.lit(r"(?m)^#{1,6}[ \t]+(\S.*)$"), F.lit(1)), " | ")


def token_estimate(text: Column, chars_per_token: float = 3.3) -> Column:
    return F.floor(F.length(text) / F.lit(chars_per_token)).cast("int")


def format_size(n: Column) -> Column:
    """1.5 KB and the like, in powers of 1024; ties go to the even digit."""
    out = F.format_string("%.1f PB", F.bround(n / F.lit(1024.0**5), 1))
    for k, unit in reversed(list(enumerate(["B", "KB", "MB", "GB", "TB"]))):
        out = F.when(n < 1024.0 ** (k + 1), F.format_string(f"%.1f {unit}", F.bround(n / F.lit(1024.0**k), 1))).otherwise(out)
    return out


def format_duration(seconds: Column) -> Column:
    """45s, 3m 5s, 1h 2m; a null stays null."""
    s = seconds.cast("long")
    minutes, rest = F.floor(s / 60), s % 60
    hours, min_rest = F.floor(s / 3600), F.floor((s % 3600) / 60)
    return (
        F.when(s < 60, F.concat(s, F.lit("s")))
        .when(s < 3600, F.concat(minutes, F.lit("m"), F.when(rest == 0, "").otherwise(F.concat(F.lit(" "), rest, F.lit("s")))))
        .otherwise(F.concat(hours, F.lit("h"), F.when(min_rest == 0, "").otherwise(F.concat(F.lit(" "), min_rest, F.lit("m")))))
    )

"""Keyword, phrase, prefix and typo-tolerant search over an inverted index.

``postings`` is the index: one row per (document, attribute, term) with its positions; ``Index`` keeps it on files in the
order of the terms. A query is expanded against the terms, reads the postings of these alone, ranks keys, and only then
fetches the rows of its page. The rank, in this order: words matched, typos, proximity (the least span of places in one
attribute that holds every matched word), attribute, exactness, key.
"""

from __future__ import annotations

import copy
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The settings of the four index types.
_DOCUMENT_STOP_WORDS = "the a an and or but in on at to for".split()
INDEX_SETTINGS = {
    "source-code": {
        "searchable": ["content", "filename", "function_names", "class_names"],
        "filterable": ["language", "project", "branch", "file_path", "file_extension", "git_project_identifier"],
        "sortable": [], "one_typo": 7, "two_typos": 12, "stop_words": [], "max_total_hits": 1000,
    },
    "source-code-fulltext": {
        "searchable": ["content", "function_name", "class_name", "qualified_name", "filename"],
        "filterable": ["programming_language", "git_project_name", "git_branch", "git_project_identifier", "git_commit_hash", "file_path", "code_type", "file_extension"],
        "sortable": ["start_line"], "one_typo": 7, "two_typos": 12, "stop_words": [], "max_total_hits": 10000,
    },
    "pdf-docs": {
        "searchable": ["content", "title", "author", "filename"],
        "filterable": ["filename", "file_path", "page_number", "document_type", "file_hash", "extraction_method", "is_image_pdf"],
        "sortable": ["page_number"], "one_typo": 5, "two_typos": 9, "stop_words": _DOCUMENT_STOP_WORDS, "max_total_hits": 10000,
    },
    "markdown-docs": {
        "searchable": ["content", "title", "filename", "headings"],
        "filterable": ["filename", "file_path", "section", "tags"],
        "sortable": [], "one_typo": 5, "two_typos": 9, "stop_words": _DOCUMENT_STOP_WORDS, "max_total_hits": 1000,
    },
}
ALIASES = {"code": "source-code", "code-fulltext": "source-code-fulltext", "pdf": "pdf-docs", "markdown": "markdown-docs"}


def index_settings(kind: str) -> dict:
    """A copy of the settings of an index type or its alias."""
    try:
        return copy.deepcopy(INDEX_SETTINGS[ALIASES.get(kind, kind)])
    except KeyError:
        raise KeyError(f"unknown index type {kind}; known are {', '.join([*INDEX_SETTINGS, *ALIASES])}") from None


def tokens(text: Column) -> Column:
    """Words of letters, digits and underscores, lower-cased, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def postings(docs: DataFrame, key: str, attributes: list[str], stop_words: list[str] = ()) -> DataFrame:
    """(key, term, attr, attr_rank, tf, positions), positions from 0. Stop words keep their places but get no rows.

    A term's places in one row are collected before the shuffle, as a row lies in one task.
    """
    spread = occurrences(docs, key, attributes)
    if stop_words:
        spread = spread.filter(~F.col("term").isin(*stop_words))
    return spread.groupBy(key, "term", "attr", "attr_rank").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def occurrences(docs: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """(key, attr, attr_rank, pos, term): every word of every attribute, in one pass over the rows."""
    types = dict(docs.dtypes)
    whole = [F.struct(F.lit(a).alias("attr"), F.lit(r).alias("attr_rank"), tokens(F.array_join(a, " ") if types[a] == "array<string>" else F.col(a).cast("string")).alias("t")) for r, a in enumerate(attributes)]
    return docs.select(key, F.explode(F.array(*whole)).alias("_a")).select(key, "_a.attr", "_a.attr_rank", F.posexplode("_a.t").alias("pos", "term"))


def query_terms(query: str, stop_words: list[str] = ()) -> tuple[list[str], list[list[str]]]:
    """(words, phrases) of a query; what stands in double quotes is a phrase."""
    word = re.compile(r"[^\W]+")
    phrases = [word.findall(p.lower()) for p in re.findall(r'"([^"]*)"', query)]
    words = [w for w in word.findall(re.sub(r'"[^"]*"', " ", query).lower()) if w not in stop_words]
    return words, [p for p in phrases if p]


def has_phrase(text: Column, phrase: list[str]) -> Column:
    """Whether the words stand side by side in this order."""
    want = " ".join(phrase)
    return F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" ")).contains(f" {want} ")


def expansions(terms: DataFrame, words: list[str], one_typo: int = 5, two_typos: int = 9, prefix_last: bool = True) -> DataFrame:
    """``terms`` rows with word, typos, exact: what each query word matches. A row that matches no word goes."""
    found = []
    for i, w in enumerate(words):
        budget = 2 if len(w) >= two_typos else 1 if len(w) >= one_typo else 0
        d = F.when(F.col("term") == w, 0)
        if prefix_last and i == len(words) - 1:
            d = d.when(F.col("term").startswith(w), 0)
        if budget:
            d = d.when(F.abs(F.length("term") - len(w)) <= budget, F.levenshtein("term", F.lit(w), budget))
        found.append(F.struct(F.lit(w).alias("word"), F.coalesce(d, F.lit(-1)).alias("typos"), (F.col("term") == w).cast("int").alias("exact")))
    hits = F.filter(F.array(*found), lambda m: m["typos"] >= 0)
    return terms.withColumn("_m", F.explode(hits)).select(*terms.columns, "_m.word", "_m.typos", "_m.exact")


#: So many matching terms are looked up in the index by name; more are joined.
FEW_TERMS = 1_000
#: A page of at most so many rows is sent to the executors to fetch its rows.
PAGE_ROWS = 10_000


class Index:
    """Postings on files, sorted by term, and the dictionary of terms beside them."""

    def __init__(self, spark, at: str, key: str):
        self.spark, self.at, self.key = spark, at, key
        self.postings, self.terms = spark.read.parquet(f"{at}/postings"), spark.read.parquet(f"{at}/terms")

    @staticmethod
    def build(docs: DataFrame, key: str, attributes: list[str], stop_words: list[str], at: str) -> Index:
        """Written range by range of the terms, so that a query reads few row groups. Terms of any frequency are split over ranges by key."""
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        p = postings(docs, key, attributes, stop_words)
        p.repartitionByRange(parts, "term", key).sortWithinPartitions("term", key).write.option("compression", "zstd").parquet(f"{at}/postings")
        terms = docs.sparkSession.read.parquet(f"{at}/postings").groupBy("term").agg(F.countDistinct(key).alias("docs"), F.sum("tf").alias("tf"))
        terms.write.parquet(f"{at}/terms")
        return Index(docs.sparkSession, at, key)

    def lookup(self, terms: DataFrame) -> DataFrame:
        """The postings of some terms, with the other columns of ``terms``."""
        few = terms.select("term").distinct().limit(FEW_TERMS + 1).collect()
        if len(few) > FEW_TERMS:
            return self.postings.join(terms, "term")
        return self.postings.filter(F.col("term").isin([r["term"] for r in few])).join(F.broadcast(terms), "term")


def phrase_places(index: Index, phrase: list[str], stop_words: list[str]) -> DataFrame:
    """(key): rows in which the words of a phrase that are no stop words stand at their distances in one attribute."""
    want = [(w, i) for i, w in enumerate(phrase) if w not in stop_words]
    terms = index.spark.createDataFrame(want, "term string, _i int")
    at = index.lookup(terms).select(index.key, "attr_rank", "_i", F.explode("positions").alias("_p")).withColumn("_p", F.col("_p") - F.col("_i"))
    return at.groupBy(index.key, "attr_rank", "_p").agg(F.count("*").alias("_n")).filter(F.col("_n") == len(want)).select(index.key).distinct()


def least_span(matches: Column, n_words: int, attribute: int) -> Column:
    """The least span of places in an attribute that holds all ``n_words`` words; null if it does not hold all.

    matches: structs of pos, w (the word's number) and attr_rank. One pass over the places in order: the last place of
    each word so far is kept.
    """
    here = F.sort_array(F.transform(F.filter(matches, lambda m: m["attr_rank"] == attribute), lambda m: F.struct(m["pos"].alias("pos"), m["w"].alias("w"))))
    start = F.struct(F.array_repeat(F.lit(-1), n_words).alias("last"), F.lit(None).cast("int").alias("best"))

    def step(state, m):
        last = F.transform(state["last"], lambda v, i: F.when(i == m["w"], m["pos"]).otherwise(v))
        span = F.when(F.array_min(last) >= 0, m["pos"] - F.array_min(last))
        return F.struct(last.alias("last"), F.least(state["best"], span).alias("best"))

    return F.aggregate(here, start, step, lambda state: state["best"])


def ranked(docs: DataFrame, key: str, query: str, settings: dict, where: Column | None = None, require_all: bool = True, index: Index | None = None) -> tuple[DataFrame, list[Column]]:
    """(keys of all matches with their ranking columns, the order). A query without words has the key's order alone."""
    base = docs.filter(where) if where is not None else docs
    words, phrases = query_terms(query, settings["stop_words"])
    words = list(dict.fromkeys(words))
    stop = settings["stop_words"]
    attributes = [a for a in settings["searchable"] if a in docs.columns]
    kept = base.select(key) if where is not None else None
    for p in phrases:
        if index is not None and any(w not in stop for w in p):
            hit = phrase_places(index, p, stop)
            if any(w in stop for w in p):  # stop words have no postings: the texts of what is left tell
                hit = base.join(hit, key, "left_semi").filter(_has_phrase(docs, attributes, p)).select(key)
        else:
            hit = base.filter(_has_phrase(docs, attributes, p)).select(key)
        kept = hit if kept is None else kept.join(hit, key, "left_semi")
    if not words:
        return (kept if kept is not None else base.select(key)), [F.col(key)]
    if index is None:  # a scan keeps only the words that match, before anything is shuffled
        rows = base.join(kept, key, "left_semi") if phrases else base
        matched = expansions(occurrences(rows, key, attributes), words, settings["one_typo"], settings["two_typos"])
    else:
        terms = expansions(index.terms.select("term"), words, settings["one_typo"], settings["two_typos"])
        matched = index.lookup(terms)
        matched = matched.withColumn("pos", F.explode("positions")) if len(words) > 1 else matched.withColumn("pos", F.element_at("positions", 1))
        matched = matched.join(kept, key, "left_semi") if kept is not None else matched
    number = F.array_position(F.array(*map(F.lit, words)), F.col("word")).cast("int") - 1
    found = matched.groupBy(key).agg(F.collect_list(F.struct(number.alias("w"), "typos", "exact", "attr_rank", F.col("pos").cast("int").alias("pos"))).alias("_m"))

    def of(i: int, field: str) -> Column:
        return F.transform(F.filter("_m", lambda m: m["w"] == i), lambda m: m[field])

    total = lambda xs: sum((F.coalesce(x, F.lit(0)) for x in xs[1:]), F.coalesce(xs[0], F.lit(0)))
    spans = [least_span(F.col("_m"), len(words), a) for a in range(len(attributes))] if len(words) > 1 else []
    near = F.least(*spans) if len(spans) > 1 else spans[0] if spans else F.lit(0)
    hits = found.select(
        key, F.size(F.array_distinct(F.transform("_m", lambda m: m["w"]))).cast("long").alias("words_matched"), total([F.array_min(of(i, "typos")) for i in range(len(words))]).cast("long").alias("typos"),
        near.alias("proximity"), F.array_min(F.transform("_m", lambda m: m["attr_rank"])).alias("attr_rank"), total([F.array_max(of(i, "exact")) for i in range(len(words))]).cast("long").alias("exact_words"),
    )
    if require_all:
        hits = hits.filter(F.col("words_matched") == len(words))
    return hits, [F.col("words_matched").desc(), F.col("typos"), F.col("proximity").asc_nulls_last(), F.col("attr_rank"), F.col("exact_words").desc(), F.col(key)]


def _has_phrase(docs: DataFrame, attributes: list[str], phrase: list[str]) -> Column:
    hit = F.lit(False)
    for a in attributes:
        hit = hit | F.coalesce(has_phrase(F.col(a).cast("string"), phrase), F.lit(False))
    return hit


def search(docs: DataFrame, key: str, query: str, settings: dict, where: Column | None = None, limit: int = 20, offset: int = 0, require_all: bool = True, index: Index | None = None) -> DataFrame:
    """``docs`` rows that match, with the ranking columns, best first.

    Without words and phrases the query is a filter-only scan in the order of the key. The hit cap of the settings
    holds before the offset. With an ``index`` no text is read but that of the page's rows.
    """
    cap = min(settings["max_total_hits"], limit + offset)
    words, phrases = query_terms(query, settings["stop_words"])
    if not words and not phrases:
        return (docs.filter(where) if where is not None else docs).orderBy(key).limit(cap).offset(offset)
    hits, order = ranked(docs, key, query, settings, where, require_all, index)
    if cap > PAGE_ROWS:
        return docs.join(hits, key).orderBy(*order).limit(cap).offset(offset)
    page = hits.orderBy(*order).limit(cap).offset(offset)
    return docs.join(F.broadcast(page), key).orderBy(*order)


def estimated_total(docs: DataFrame, key: str, query: str, settings: dict, where: Column | None = None, index: Index | None = None) -> DataFrame:
    """(estimated_total, capped): the number of hits before any page, and whether the settings' cap hides some."""
    hits, _ = ranked(docs, key, query, settings, where, True, index)
    n = F.count("*")
    return hits.agg(F.least(n, F.lit(settings["max_total_hits"]).cast("long")).alias("estimated_total"), (n > settings["max_total_hits"]).alias("capped"))


def filterable(settings: dict, attributes: list[str]) -> list[str]:
    """The attributes, if an index can filter by all of them; else an error that names the others."""
    bad = [a for a in attributes if a not in settings["filterable"]]
    if bad:
        raise ValueError(f"not filterable: {', '.join(bad)}; filterable are {', '.join(settings['filterable'])}")
    return list(attributes)


def highlight(text: Column, words: list[str], before: str = "<em>", after: str = "</em>") -> Column:
    """Whole words marked, whatever their case."""
    if not words:
        return text
    return F.regexp_replace(text, r"(?iu)(?<![\p{L}\p{N}_])(" + "|".join(re.escape(w) for w in words) + r")(?![\p{L}\p{N}_])", f"{before}$1{after}")


def round_robin(hits: DataFrame, corpus: str, corpora: list[str], order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Hit 1 of each corpus in the order asked, then hit 2 of each, and so on."""
    w = Window.partitionBy(corpus).orderBy(*order)
    corpora = list(dict.fromkeys(corpora))
    df = hits.filter(F.col(corpus).isin(*corpora)).withColumn("corpus_rank", F.row_number().over(w)).filter(F.col("corpus_rank") <= limit + offset)
    return df.orderBy("corpus_rank", F.array_position(F.array(*map(F.lit, corpora)), F.col(corpus))).offset(offset).limit(limit)


def location(path: Column, start: Column | None = None, end: Column | None = None, function: Column | None = None, page: Column | None = None) -> Column:
    """path:start-end (f name), or path:pageN, or the path."""
    out = path
    if page is not None:
        out = F.when(page.isNotNull(), F.concat(path, F.lit(":page"), page)).otherwise(out)
    if start is not None:
        lines = F.concat(path, F.lit(":"), start)
        if end is not None:
            lines = F.when(end.isNotNull() & (end != start), F.concat(lines, F.lit("-"), end)).otherwise(lines)
        if function is not None:
            lines = F.concat(lines, F.when(F.coalesce(function, F.lit("")) != "", F.concat(F.lit(" ("), function, F.lit(" function)"))).otherwise(""))
        out = F.when(start.isNotNull(), lines).otherwise(out)
    return out


def statistics(index: DataFrame, key: str) -> DataFrame:
    """Terms, postings and documents of an index."""
    return index.agg(F.countDistinct("term").alias("n_terms"), F.sum("tf").alias("n_tokens"), F.countDistinct(key).alias("n_docs"))

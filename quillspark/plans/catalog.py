"""Query catalogue of the core: name -> plan, and name -> SQL that must give the same rows.

Plans run over whole tables. Floats are rounded to six places and lists are joined to strings, so that both engines
can be compared by value.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import embed, paths, vectors
from ..functions import text as tx
from ..operators import chunkers, dml, extraction, filters, fulltext, integrity, listings, ordering, records, sync, vector_index, vector_search
from ..session import shared_dir
from ..session import table as t
from ..sources import exchange
from ..sources.store import Store
from ..streaming import ingest
from . import corpus, pipelines

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- vector search ----------------------------------------------------------------------------------------------

_Q = "WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"
_COS = "list_cosine_similarity(embedding::DOUBLE[], e)"


def _points(spark: SparkSession, d: str) -> tuple[DataFrame, list[float]]:
    e = t(spark, d, "embeddings")
    return e, [float(x) for x in e.orderBy("vec_id").select("embedding").first()["embedding"]]


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("vec_id", "label", F.round("score", 6).alias("score"))


@query(f"{_Q} SELECT vec_id, label, round({_COS}, 6) AS score FROM embeddings, q ORDER BY {_COS} DESC, vec_id LIMIT 10")
def knn_cosine_topk(spark, d):
    e, q = _points(spark, d)
    return _rounded(vector_search.search(e, q, "vec_id"))


@query(f"{_Q} SELECT vec_id, label, round({_COS}, 6) AS score FROM embeddings, q WHERE label IN (1, 2, 3) AND {_COS} >= 0.05 ORDER BY {_COS} DESC, vec_id LIMIT 10")
def knn_filtered_threshold(spark, d):
    e, q = _points(spark, d)
    return _rounded(vector_search.search(e, q, "vec_id", threshold=0.05, where=filters.parse(e, "label:in:1,2,3")))


@query(f"{_Q} SELECT vec_id, label, round(list_inner_product(embedding::DOUBLE[], e), 6) AS score FROM embeddings, q ORDER BY list_inner_product(embedding::DOUBLE[], e) DESC, vec_id LIMIT 10")
def knn_dot(spark, d):
    e, q = _points(spark, d)
    return _rounded(vector_search.search(e, q, "vec_id", metric="dot"))


@query(f"{_Q} SELECT vec_id, label, round(list_distance(embedding::DOUBLE[], e), 6) AS score FROM embeddings, q ORDER BY list_distance(embedding::DOUBLE[], e), vec_id LIMIT 10")
def knn_euclid(spark, d):
    e, q = _points(spark, d)
    return _rounded(vector_search.search(e, q, "vec_id", metric="euclid"))


@query(f"{_Q} SELECT vec_id, label, round({_COS}, 6) AS score FROM embeddings, q ORDER BY {_COS} DESC, vec_id LIMIT 10 OFFSET 20")
def knn_pagination_offset(spark, d):
    e, q = _points(spark, d)
    return _rounded(vector_search.search(e, q, "vec_id", offset=20))


@query(f"""{_Q}, r AS (SELECT vec_id, label, {_COS} AS s, row_number() OVER (PARTITION BY label ORDER BY {_COS} DESC, vec_id) AS corpus_rank FROM embeddings, q WHERE label IN (2, 0, 5))
SELECT vec_id, label, corpus_rank, round(s, 6) AS score FROM r WHERE corpus_rank <= 15 ORDER BY s DESC, list_position([2, 0, 5], label), corpus_rank LIMIT 10 OFFSET 5""")
def knn_multi_corpus_merge(spark, d):
    e, q = _points(spark, d)
    return vector_search.search_corpora(e, q, "vec_id", "label", [2, 0, 5], 10, 5).select("vec_id", "label", F.col("corpus_rank").cast("long").alias("corpus_rank"), F.round("score", 6).alias("score"))


_L2 = "list_distance(embedding::DOUBLE[], e)"


@query(f"""{_Q}, r AS (SELECT vec_id, label, {_L2} AS s, row_number() OVER (PARTITION BY label ORDER BY {_L2}, vec_id) AS corpus_rank FROM embeddings, q WHERE label IN (2, 0, 5))
SELECT vec_id, label, corpus_rank, round(s, 6) AS score FROM r WHERE corpus_rank <= 15 ORDER BY s, list_position([2, 0, 5], label), corpus_rank LIMIT 10 OFFSET 5""")
def knn_multi_corpus_euclid(spark, d):
    e, q = _points(spark, d)
    return vector_search.search_corpora(e, q, "vec_id", "label", [2, 0, 5], 10, 5, metric="euclid").select("vec_id", "label", F.col("corpus_rank").cast("long").alias("corpus_rank"), F.round("score", 6).alias("score"))


@query(f"{_Q}, s AS (SELECT {_COS} AS s FROM embeddings, q ORDER BY s DESC LIMIT 100) SELECT count(*) AS n_results, round(avg(s), 6) AS avg_score, round(max(s), 6) AS max_score, round(min(s), 6) AS min_score FROM s")
def knn_score_summary(spark, d):
    e, q = _points(spark, d)
    return vector_search.summary(vector_search.search(e, q, "vec_id", limit=100))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.45")
def knn_similar_pairs(spark, d):
    return vector_search.similar_pairs_exact(t(spark, d, "embeddings"), "vec_id", 0.45).withColumn("score", F.round("score", 6))


_VALID = """CASE WHEN embedding IS NULL THEN 'missing' WHEN len(embedding) <> 64 THEN 'size' WHEN list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) THEN 'nan'
WHEN list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) = 0 THEN 'zero' WHEN sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) NOT BETWEEN 0.01 AND 1000 THEN 'norm' WHEN list_var_pop(embedding::DOUBLE[]) < 1e-10 THEN 'flat' END"""


@query(f"WITH v AS (SELECT DISTINCT id, {_VALID} AS fault FROM code_chunks) SELECT coalesce(fault, 'none') AS fault, count(*) AS n FROM v GROUP BY 1")
def embedding_validity(spark, d):
    v = t(spark, d, "code_chunks").select("id", vectors.fault(F.col("embedding"), 64).alias("fault")).distinct()
    return v.groupBy(F.coalesce("fault", F.lit("none")).alias("fault")).agg(F.count("*").alias("n"))


_CELLS: dict[tuple[str, str], vector_index.CellIndex] = {}


@query()
def knn_ann_topk(spark, d):
    """The ten nearest by an index of cells over all vectors, built once for a session and data folder; recall is tested against the exact search."""
    e, q = _points(spark, d)
    at = (spark.sparkContext.applicationId, d)
    if at not in _CELLS:
        _CELLS[at] = vector_index.CellIndex.build(e, "vec_id", "embedding", f"{shared_dir(spark)}/quillspark/cells-{uuid.uuid4().hex}")
    return _CELLS[at].search(q, 10).select("vec_id", F.round("score", 6).alias("score"))


@query()
def embedding_quantized(spark, d):
    """int8 steps of each vector (rows only: rounding at ties differs between engines)."""
    return t(spark, d, "embeddings").select("vec_id", vectors.quantized(F.col("embedding").cast("array<double>"), 3.0).alias("steps"))


# --- filters ----------------------------------------------------------------------------------------------------


def _docs(spark, d):
    return t(spark, d, "documents")


def _filtered(expr):
    def run(spark, d):
        df = _docs(spark, d)
        return df.filter(filters.parse(df, expr)).select("doc_id", "lang", "source")

    return run


for _name, _expr, _sql in (
    ("filter_simple", "lang=fr,source=handbook", "lang = 'fr' AND source = 'handbook'"),
    ("filter_extended_in", "lang:in:en,de,source:in:handbook,field-manual", "lang IN ('en', 'de') AND source IN ('handbook', 'field-manual')"),
    ("filter_range", "n_chars:gte:500,n_chars:lt:2000", "n_chars >= 500 AND n_chars < 2000"),
    ("filter_contains", "text:contains:index", "contains(text, 'index')"),
    ("filter_match_number", "doc_id:match:17", "doc_id = 17"),
    ("filter_json_must_should_not", '{"must": [{"key": "n_chars", "range": {"gt": 300}}], "should": [{"key": "lang", "match": {"value": "en"}}, {"key": "lang", "match": {"value": "fr"}}], "must_not": [{"key": "source", "match": {"any": ["handbook", "field-manual"]}}]}',
     "n_chars > 300 AND (coalesce(lang = 'en', false) OR coalesce(lang = 'fr', false)) AND NOT coalesce(source IN ('handbook', 'field-manual'), false)"),
    ("filter_min_should", '{"min_should": {"conditions": [{"key": "lang", "match": {"value": "en"}}, {"key": "n_chars", "range": {"gte": 1000}}, {"key": "source", "match": {"value": "handbook"}}], "min_count": 2}}',
     "(coalesce(lang = 'en', false)::INT + coalesce(n_chars >= 1000, false)::INT + coalesce(source = 'handbook', false)::INT) >= 2"),
):
    QUERIES[_name] = _filtered(_expr)
    SQL[_name] = f"SELECT doc_id, lang, source FROM documents WHERE {_sql}"


@query("SELECT doc_id, lang, collection FROM documents WHERE (lower(lang) = 'en' OR lower(lang) IN ('de', 'fr')) AND n_chars BETWEEN 200 AND 3000 AND NOT coalesce(lower(source) = 'handbook', false) AND collection IS NOT NULL")
def text_filter_expression(spark, d):
    df = _docs(spark, d)
    f = filters.text_filter(df, '(lang = EN OR lang IN ["de", fr]) AND n_chars 200 TO 3000 AND NOT source = handbook AND collection EXISTS')
    return df.filter(f).select("doc_id", "lang", "collection")


@query("SELECT git_project_identifier, file_path FROM code_chunks WHERE (file_path IS NULL) OR ((file_path LIKE '%/src/%' OR file_path LIKE '%.go') AND file_path NOT LIKE '%/index/%') GROUP BY 1, 2")
def glob_include_exclude(spark, d):
    c = t(spark, d, "code_chunks")
    return c.filter(filters.globs(F.col("file_path"), ["*/src/*", "*.go"], ["*/index/*"])).select("git_project_identifier", "file_path").distinct()


@query("SELECT git_project_identifier, count(*) AS n FROM code_chunks WHERE git_project_identifier = 'tinder-vault#main' OR git_project_name = 'orchard-index' GROUP BY 1")
def repository_filter(spark, d):
    c = t(spark, d, "code_chunks")
    return c.filter(filters.repositories(c, ["tinder-vault#main", "orchard-index"])).groupBy("git_project_identifier").agg(F.count("*").alias("n"))


# --- full text --------------------------------------------------------------------------------------------------

_TOK = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
_DT = _TOK.format("text")
_STOP = "('the', 'a', 'an', 'and', 'or', 'but', 'in', 'on', 'at', 'to', 'for')"
#: One row per document and term, with its first place.
_IDX = f"WITH tk AS (SELECT doc_id, unnest({_DT}) AS term, generate_subscripts({_DT}, 1) - 1 AS pos FROM documents), idx AS (SELECT doc_id, term, min(pos) AS pos, count(*) AS tf FROM tk WHERE term NOT IN {_STOP} GROUP BY 1, 2)"


def _settings(**over):
    return fulltext.index_settings("pdf") | {"searchable": ["text"], "max_total_hits": 10_000_000} | over


_INDEXES: dict[tuple[str, str], fulltext.Index] = {}


def _index(spark, d):
    """Postings of all documents, built once for a session and data folder and read from files afterwards."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _INDEXES:
        _INDEXES[at] = fulltext.Index.build(_docs(spark, d), "doc_id", ["text"], _settings()["stop_words"], f"{shared_dir(spark)}/quillspark/index-{uuid.uuid4().hex}")
    return _INDEXES[at]


@query(f"""{_IDX}, h AS (SELECT doc_id, 'vector' AS w, pos FROM idx WHERE term = 'vector' UNION ALL SELECT doc_id, 'store', min(pos) FROM idx WHERE term LIKE 'store%' AND term <> '' GROUP BY doc_id)
SELECT doc_id, count(*) AS words_matched FROM h GROUP BY doc_id HAVING count(*) = 2""")
def fts_keyword_and(spark, d):
    """Both words; the last may be a prefix. Short words allow no typo."""
    s = _settings(one_typo=99, two_typos=99)
    return fulltext.search(_docs(spark, d), "doc_id", "vector store", s, limit=10_000_000, index=_index(spark, d)).select("doc_id", "words_matched")


@query(f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({_DT}, ' ') || ' ', ' vector store ') AND contains(' ' || array_to_string({_DT}, ' ') || ' ', ' short delay ')")
def fts_phrase(spark, d):
    return fulltext.search(_docs(spark, d), "doc_id", '"vector store" "short delay"', _settings(), limit=10_000_000, index=_index(spark, d)).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({_DT}, ' ') || ' ', ' the vector store ')")
def fts_phrase_with_stop_word(spark, d):
    """Stop words have no postings; the texts of the rows that the other words leave decide."""
    return fulltext.search(_docs(spark, d), "doc_id", '"the vector store"', _settings(), limit=10_000_000, index=_index(spark, d)).select("doc_id")


_RANK = f"""{_IDX}, p AS (SELECT doc_id, 0 AS w, pos FROM tk WHERE term = 'vector' UNION ALL SELECT doc_id, 1, pos FROM tk WHERE term LIKE 'store%'), n AS (SELECT a.doc_id, min(abs(a.pos - b.pos)) AS proximity FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.w = 0 AND b.w = 1 GROUP BY 1),
x AS (SELECT doc_id, 1 + max((term = 'store')::INT) AS exact_words FROM tk WHERE term LIKE 'store%' GROUP BY 1)"""


@query(f"{_RANK} SELECT doc_id, row_number() OVER (ORDER BY proximity, exact_words DESC, doc_id) AS place, proximity::INT AS proximity, exact_words::BIGINT AS exact_words FROM n JOIN x USING (doc_id) ORDER BY place LIMIT 20")
def fts_rank_order(spark, d):
    """The first page of a two-word query: keys are ranked and cut first, then the page's rows are fetched."""
    hits = fulltext.search(_docs(spark, d), "doc_id", "vector store", _settings(one_typo=99, two_typos=99), limit=20, index=_index(spark, d))
    w = Window.orderBy("words_matched", "typos", "proximity", "attr_rank", F.col("exact_words").desc(), "doc_id")  # of the page's twenty rows
    return hits.select("doc_id", F.row_number().over(w).cast("long").alias("place"), "proximity", "exact_words")


@query(f"{_RANK} SELECT count(*) AS estimated_total, false AS capped FROM n")
def fts_estimated_total(spark, d):
    return fulltext.estimated_total(_docs(spark, d), "doc_id", "vector store", _settings(one_typo=99, two_typos=99), index=_index(spark, d))


@query(f"{_IDX} SELECT doc_id FROM idx WHERE term = 'manifest' OR term LIKE 'archive%' GROUP BY 1 HAVING count(DISTINCT CASE WHEN term = 'manifest' THEN 0 ELSE 1 END) = 2")
def fts_stopwords(spark, d):
    """Stop words of the query are passed over."""
    return fulltext.search(_docs(spark, d), "doc_id", "the manifest in an archive", _settings(one_typo=99, two_typos=99), limit=10_000_000, index=_index(spark, d)).select("doc_id")


@query(f"{_IDX} SELECT DISTINCT doc_id FROM idx WHERE term LIKE 'token%'")
def fts_prefix_last(spark, d):
    return fulltext.search(_docs(spark, d), "doc_id", "token", _settings(one_typo=99, two_typos=99), limit=10_000_000, index=_index(spark, d)).select("doc_id")


@query(f"""{_IDX}, e AS (SELECT DISTINCT term, regexp_replace(term, '[^\\x00-\\x7f]', '?', 'g') AS plain FROM idx), v AS (SELECT term, min(CASE WHEN term LIKE 'snapshit%' THEN 0 ELSE levenshtein(plain, 'snapshit') END) AS typos FROM e WHERE term LIKE 'snapshit%' OR levenshtein(plain, 'snapshit') <= 1 GROUP BY 1)
SELECT doc_id, min(typos)::BIGINT AS typos FROM idx JOIN v USING (term) GROUP BY 1""")
def fts_typo_one_edit(spark, d):
    """One edit for eight letters. The SQL's engine counts bytes, so each other letter is one mark there."""
    return fulltext.search(_docs(spark, d), "doc_id", "snapshit", _settings(), limit=10_000_000, index=_index(spark, d)).select("doc_id", "typos")


@query(r"""WITH tk AS (SELECT id, 0 AS attr_rank, unnest(regexp_extract_all(lower(content), '[\p{L}\p{N}_]+')) AS term FROM (SELECT DISTINCT id, content, title FROM dual_documents) UNION ALL
SELECT id, 1, unnest(regexp_extract_all(lower(title), '[\p{L}\p{N}_]+')) FROM (SELECT DISTINCT id, content, title FROM dual_documents))
SELECT id, min(attr_rank)::INT AS attr_rank FROM tk WHERE term LIKE 'scheduler%' GROUP BY 1""")
def fts_attribute_rank(spark, d):
    docs = t(spark, d, "dual_documents").select("id", "content", "title").distinct()
    s = fulltext.index_settings("pdf") | {"max_total_hits": 10_000_000, "one_typo": 99, "two_typos": 99}
    return fulltext.search(docs, "id", "scheduler", s, limit=10_000_000).select("id", "attr_rank")


@query(f"{_IDX} SELECT count(DISTINCT term) AS n_terms, sum(tf)::BIGINT AS n_tokens, count(DISTINCT doc_id) AS n_docs FROM idx")
def inverted_index_stats(spark, d):
    return fulltext.statistics(fulltext.postings(_docs(spark, d), "doc_id", ["text"], _settings()["stop_words"]), "doc_id")


@query(r"SELECT doc_id, sha256(regexp_replace(text, '(?i)\b(index|corpus)\b', '<em>\1</em>', 'g')) AS marked FROM documents WHERE regexp_matches(text, '(?i)\b(index|corpus)\b')")
def fts_highlight(spark, d):
    """Hashes stand for the marked texts; rows without a mark are left out."""
    marked = _docs(spark, d).select("doc_id", "text", fulltext.highlight(F.col("text"), ["index", "corpus"]).alias("marked"))
    return marked.filter("marked <> text").select("doc_id", F.sha2("marked", 256).alias("marked"))


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS corpus_rank FROM documents WHERE lang IN ('fr', 'en', 'de'))
SELECT doc_id, lang, corpus_rank FROM r WHERE corpus_rank <= 25 ORDER BY corpus_rank, list_position(['fr', 'en', 'de'], lang) LIMIT 20 OFFSET 5""")
def fts_round_robin(spark, d):
    df = fulltext.round_robin(_docs(spark, d), "lang", ["fr", "en", "de"], [F.col("n_chars").desc(), F.col("doc_id")], 20, 5)
    return df.select("doc_id", "lang", F.col("corpus_rank").cast("long").alias("corpus_rank"))


@query("SELECT id, CASE WHEN page_number IS NOT NULL THEN file_path || ':page' || page_number ELSE file_path END AS location FROM (SELECT DISTINCT id, file_path, page_number FROM dual_documents)")
def result_location(spark, d):
    r = t(spark, d, "dual_documents").select("id", "file_path", "page_number").distinct()
    return r.select("id", fulltext.location(F.col("file_path"), page=F.col("page_number")).alias("location"))


# --- text functions ---------------------------------------------------------------------------------------------

_SW = "(" + ", ".join(f"'{w}'" for w in tx.QUALITY_STOP_WORDS) + ")"
_BLANK = r"regexp_full_match(coalesce(text, ''), '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x1c-\x1f]*')"
_M = r"""WITH m AS (SELECT doc_id, lang, text, length(text) AS n, regexp_extract_all(lower(text), '[a-z]+') AS w, length(text) - length(replace(text, chr(65533), '')) AS bad, length(regexp_replace(text, '[^\x20-\x7e\n\r\t]', '', 'g')) AS ok FROM documents),
k AS (SELECT *, len(list_filter(w, lambda x: x IN """ + _SW + "))::DOUBLE AS st, length(array_to_string(w, ''))::DOUBLE AS wl FROM m)"
_SCORE = f"""CASE WHEN {_BLANK} THEN 0.0 ELSE round(least(1.0, greatest(0.0, 0.35 * greatest(0.0, 1 - 10 * (bad / n::DOUBLE)) + 0.30 * CASE WHEN len(w) > 0 THEN least(1.0, (st / len(w)) / 0.15) ELSE 0.0 END
+ 0.20 * least(1.0, (ok / n::DOUBLE) / 0.7) + 0.15 * CASE WHEN len(w) = 0 THEN 0.0 WHEN wl / len(w) > 15 OR wl / len(w) < 2 THEN 0.2 WHEN wl / len(w) > 10 THEN 0.6 ELSE 1.0 END)), 3) END"""


@query(f"{_M} SELECT doc_id, {_SCORE} AS score FROM k")
def text_quality_score(spark, d):
    return _docs(spark, d).select("doc_id", tx.score_text(F.col("text")).alias("score"))


@query(f"{_M} SELECT doc_id, ({_BLANK} OR bad / n::DOUBLE > 0.05 OR (len(w) = 0 AND n > 100 AND ok / n::DOUBLE < 0.1) OR (len(w) > 100 AND st / len(w) < 0.02)) AS needs_ocr FROM k")
def needs_ocr(spark, d):
    return _docs(spark, d).select("doc_id", tx.needs_ocr(F.col("text")).alias("needs_ocr"))


@query("SELECT collection, file_path, CASE WHEN page_count IS NULL OR page_count < 2 THEN false ELSE coalesce(total_text_chars, 0) / page_count::DOUBLE < 500 END AS dropout FROM file_verifications")
def dropout_flag(spark, d):
    return t(spark, d, "file_verifications").select("collection", "file_path", tx.looks_like_dropout(F.col("total_text_chars"), F.col("page_count")).alias("dropout"))


@query(f"{_M} SELECT lang, round(avg(CASE WHEN NOT {_BLANK} THEN {_SCORE} END), 3) AS avg_quality_score, sum(n)::BIGINT AS total_chars, count(*) AS chunks, coalesce(round(avg(CASE WHEN NOT {_BLANK} THEN {_SCORE} END), 3) < 0.9, false) AS has_garbled_text FROM k GROUP BY lang")
def collection_quality_report(spark, d):
    return integrity.quality(_docs(spark, d), ["lang"], "text")


@query("SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN instr(reverse(substring(text, 1, 200)), ' ') > 0 AND 200 - instr(reverse(substring(text, 1, 200)), ' ') > 160 THEN substring(text, 1, 200 - instr(reverse(substring(text, 1, 200)), ' ')) || '...' ELSE substring(text, 1, 200) || '...' END AS snippet FROM documents")
def snippet(spark, d):
    return _docs(spark, d).select("doc_id", tx.snippet(F.col("text")).alias("snippet"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', ' ', 'g')) AS clean FROM documents")
def sanitize(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(tx.sanitize(F.col("text"))).alias("clean"))


@query(r"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(text), '[ \t\n\r\f\v_]+', '-', 'g'), '[^a-z0-9\-]', '', 'g'), '^-+|-+$', '', 'g') AS s FROM documents)
SELECT doc_id, CASE WHEN s = '' THEN 'untitled' ELSE regexp_replace(substring(regexp_replace(s, '-+', '-', 'g'), 1, 50), '-+$', '') END AS slug FROM a""")
def slugify(spark, d):
    return _docs(spark, d).select("doc_id", tx.slugify(F.col("text")).alias("slug"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[\t\x{a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]', ' ', 'g'), '\n{4,}', E'\n\n\n', 'g'), '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g')) AS text_hash FROM documents")
def normalize_ws(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(tx.normalize_whitespace(F.col("text"))).alias("text_hash"))


@query(r"SELECT id, CASE WHEN regexp_extract(content, '(?m)^#[ \t]+(\S[^\n\r]*)$', 1) <> '' THEN regexp_extract(content, '(?m)^#[ \t]+(\S[^\n\r]*)$', 1) ELSE filename END AS title, array_to_string(regexp_extract_all(content, '(?m)^#{1,6}[ \t]+(\S[^\n\r]*)$', 1), ' | ') AS headings FROM (SELECT DISTINCT id, content, filename FROM dual_documents WHERE document_type = 'md')")
def title_headings(spark, d):
    m = t(spark, d, "dual_documents").filter("document_type = 'md'").select("id", "content", "filename").distinct()
    return m.select("id", tx.title(F.col("content"), F.col("filename")).alias("title"), tx.headings(F.col("content")).alias("headings"))


@query("SELECT collection, file_path, CASE WHEN file_size < 1024 THEN printf('%.1f B', file_size::DOUBLE) WHEN file_size < 1048576 THEN printf('%.1f KB', file_size / 1024.0::DOUBLE) ELSE printf('%.1f MB', file_size / 1048576.0::DOUBLE) END AS size FROM (SELECT DISTINCT collection, file_path, file_size FROM file_manifests)")
def format_size(spark, d):
    m = t(spark, d, "file_manifests").select("collection", "file_path", "file_size").distinct()
    return m.select("collection", "file_path", tx.format_size(F.col("file_size")).alias("size"))


@query("""WITH s AS (SELECT DISTINCT n_chars AS n FROM documents) SELECT n, CASE WHEN n < 60 THEN n || 's' WHEN n < 3600 THEN (n // 60) || 'm' || CASE WHEN n % 60 = 0 THEN '' ELSE ' ' || (n % 60) || 's' END
ELSE (n // 3600) || 'h' || CASE WHEN (n % 3600) // 60 = 0 THEN '' ELSE ' ' || ((n % 3600) // 60) || 'm' END END AS duration FROM s""")
def format_duration(spark, d):
    return _docs(spark, d).select(F.col("n_chars").alias("n")).distinct().select("n", tx.format_duration(F.col("n")).alias("duration"))


_LANG = "CASE lower(regexp_extract(file_path, '[^./]\\.([^./]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in paths.LANGUAGE_OF_EXTENSION.items()) + " END"


@query(f"SELECT {_LANG} AS language, count(DISTINCT file_path) AS files FROM code_chunks GROUP BY 1")
def language_of_extension(spark, d):
    return t(spark, d, "code_chunks").groupBy(paths.language_of(F.col("file_path")).alias("language")).agg(F.countDistinct("file_path").alias("files"))


@query(r"SELECT DISTINCT id, substring(regexp_replace(concat_ws('_', substring(regexp_replace(git_project_identifier, '[^a-zA-Z0-9_-]', '_', 'g'), 1, 100), substring(regexp_replace(file_path, '[^a-zA-Z0-9_-]', '_', 'g'), 1, 200), substring(regexp_replace(filename, '[^a-zA-Z0-9_-]', '_', 'g'), 1, 100), chunk_index::VARCHAR), '_+', '_', 'g'), 1, 511) AS doc_key FROM code_chunks")
def document_ids(spark, d):
    c = t(spark, d, "code_chunks")
    return c.select("id", paths.document_id(F.col("git_project_identifier"), F.col("file_path"), F.col("filename"), F.col("chunk_index")).alias("doc_key")).distinct()


@query("SELECT git_project_identifier, git_project_name || '#' || git_branch || '@' || CASE WHEN coalesce(git_commit_hash, '') = '' THEN 'unknown' ELSE substring(git_commit_hash, 1, 7) END AS version FROM git_projects")
def version_ids(spark, d):
    g = t(spark, d, "git_projects")
    return g.select("git_project_identifier", paths.version_id(F.col("git_project_name"), F.col("git_branch"), F.col("git_commit_hash")).alias("version"))


@query(r"""SELECT git_project_identifier, regexp_replace(git_remote_url, '^(https?://)[^/@]*@', '\1') AS url, CASE WHEN coalesce(regexp_extract(regexp_replace(git_remote_url, '\.git$', ''), '([^/:]*)$', 1), '') <> '' AND (contains(git_remote_url, '/') OR contains(git_remote_url, ':'))
THEN regexp_extract(regexp_replace(git_remote_url, '\.git$', ''), '([^/:]*)$', 1) ELSE regexp_extract(git_project_root, '([^/]*)/*$', 1) END AS project FROM git_projects""")
def project_from_url(spark, d):
    g = t(spark, d, "git_projects")
    return g.select("git_project_identifier", paths.strip_credentials(F.col("git_remote_url")).alias("url"), paths.project_of(F.col("git_remote_url"), F.col("git_project_root")).alias("project"))


@query(r"SELECT DISTINCT file_path, CASE WHEN starts_with(file_path, '/srv/repos/') THEN substring(file_path, 12) ELSE file_path END AS relative, CASE WHEN starts_with(file_path, '/srv/repos/') THEN '/mnt/new/' || substring(file_path, 12) ELSE file_path END AS attached FROM dual_documents")
def path_detach_attach(spark, d):
    p = t(spark, d, "dual_documents").select("file_path").distinct()
    rel = paths.detach(F.col("file_path"), F.lit("/srv/repos/"))
    return p.select("file_path", rel.alias("relative"), paths.attach(rel, F.lit("/mnt/new")).alias("attached"))


@query(r"SELECT DISTINCT file_path, CASE WHEN starts_with(file_path, '/srv/repos/orchard-index/') THEN '/data/oi' || substring(file_path, 25) WHEN starts_with(file_path, '/srv/repos/') THEN '/data/repos' || substring(file_path, 11) ELSE file_path END AS moved FROM code_chunks")
def path_remap(spark, d):
    p = t(spark, d, "code_chunks").select("file_path").distinct()
    return p.select("file_path", paths.remap(F.col("file_path"), [("/srv/repos/orchard-index", "/data/oi"), ("/srv/repos", "/data/repos")]).alias("moved"))


@query("""WITH p AS (SELECT string_split(min(file_path), '/') AS a, string_split(max(file_path), '/') AS b FROM dual_documents WHERE starts_with(file_path, '/')),
n AS (SELECT a, list_max(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i])) AS k FROM p) SELECT NULLIF(array_to_string(a[1:k], '/'), '') AS root FROM n""")
def path_root(spark, d):
    return listings.common_root(t(spark, d, "dual_documents"))


# --- counts and listings ----------------------------------------------------------------------------------------


@query("SELECT sha256(text) AS content_hash, count(DISTINCT file_path) AS n_paths, min(file_path) AS first_path, max(file_path) AS last_path FROM documents GROUP BY 1 HAVING count(DISTINCT file_path) > 1")
def content_hash_groups(spark, d):
    return listings.paths_by_content(_docs(spark, d).withColumn("content_hash", paths.content_hash(F.col("text"))), "content_hash", "file_path")


@query("SELECT collection, file_path, count(*) AS chunks, arg_min(filename, id || indexed_at) AS filename, arg_min(document_type, id || indexed_at) AS document_type FROM dual_documents GROUP BY 1, 2")
def items_by_file(spark, d):
    r = t(spark, d, "dual_documents")
    return listings.items(r, ["collection", "file_path"], ["filename", "document_type"], "id")


@query("SELECT git_project_identifier, min(git_commit_hash) AS commit, count(*) AS chunks, count(DISTINCT git_commit_hash) > 1 AS mixed_commits FROM code_chunks WHERE git_project_identifier IS NOT NULL GROUP BY 1")
def indexed_projects(spark, d):
    return listings.projects(t(spark, d, "code_chunks"), order="git_commit_hash")


@query("SELECT collection, count(*) AS chunks, count(DISTINCT file_path) AS items FROM dual_documents GROUP BY 1")
def distinct_items(spark, d):
    return listings.distinct_items(t(spark, d, "dual_documents"), ["collection"])


@query(r"WITH b AS (SELECT DISTINCT split_part(git_project_identifier, '#', 1) AS project, regexp_extract(git_project_identifier, '#(.*)$', 1) AS branch FROM code_chunks WHERE contains(git_project_identifier, '#')) SELECT project, count(*) AS n_branches, string_agg(branch, ',' ORDER BY branch) AS branches FROM b GROUP BY 1")
def branch_list(spark, d):
    return listings.branches(t(spark, d, "code_chunks"))


@query("SELECT git_project_identifier, count(*) AS chunks FROM dual_documents WHERE git_project_identifier IS NOT NULL GROUP BY 1 HAVING count(*) < 5")
def low_count_projects(spark, d):
    return listings.low_counts(t(spark, d, "dual_documents"), "git_project_identifier")


@query("SELECT CASE WHEN count(DISTINCT file_path) < 10000 THEN count(DISTINCT file_path) END AS distinct_values FROM dual_documents")
def facet_count(spark, d):
    return listings.facet(t(spark, d, "dual_documents"), "file_path")


@query("SELECT collection, file_path, min(quick_hash) AS quick_hash, min(file_hash) AS file_hash, coalesce(max(chunk_count)::BIGINT, count(*)) AS chunk_count, max(file_size) AS file_size FROM dual_documents GROUP BY 1, 2")
def manifest_build(spark, d):
    return listings.manifests(t(spark, d, "dual_documents"), ["collection", "file_path"])


_DUR = "CASE WHEN duration_ms >= 0 THEN duration_ms END"


@query(f"""WITH o AS (SELECT entry_id, any_value(command_name) AS command_name, any_value(error_text) AS error_text, any_value(result_count) AS result_count, any_value(duration_ms) AS duration_ms FROM interaction_log GROUP BY 1)
SELECT command_name, count(*) AS runs, count(error_text) AS failures, round(avg(result_count), 6) AS mean_results, quantile_disc({_DUR}, 0.5)::BIGINT AS p50_ms, quantile_disc({_DUR}, 0.95)::BIGINT AS p95_ms, max({_DUR}) AS max_ms FROM o GROUP BY 1""")
def log_usage(spark, d):
    return listings.log_usage(t(spark, d, "interaction_log"))


@query("""WITH o AS (SELECT DISTINCT ON (entry_id) entry_id, logged_at, command_name, error_text FROM interaction_log ORDER BY entry_id)
SELECT strftime(time_bucket(INTERVAL 1 HOUR, logged_at::TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS window_start, command_name, count(*) AS runs, count(error_text) AS failures FROM o WHERE logged_at IS NOT NULL GROUP BY 1, 2""")
def log_usage_windows(spark, d):
    return ingest.usage(t(spark, d, "interaction_log")).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def event_counts(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


# --- integrity --------------------------------------------------------------------------------------------------

_FC = """WITH per AS (SELECT {k}, chunk_index, count(*) AS n, max(chunk_count) AS hi, min(chunk_count) AS lo FROM {t} WHERE chunk_index IS NOT NULL GROUP BY ALL),
f AS (SELECT {k}, max(hi) AS expected_chunks, count(*) AS distinct_chunks, sum(n)::BIGINT AS actual_rows, sum(n - 1)::BIGINT AS duplicate_chunks, max(hi) <> min(lo) AS conflicting_counts, list_sort(list(chunk_index)) AS have FROM per GROUP BY {k}),
g AS (SELECT *, list_filter(range(0, coalesce(expected_chunks, 0)), lambda x: NOT list_contains(have, x::INT)) AS miss, list_filter(have, lambda x: x < 0 OR x >= coalesce(expected_chunks, 0)) AS more FROM f),
c AS (SELECT {k}, expected_chunks, distinct_chunks, actual_rows, duplicate_chunks, conflicting_counts, array_to_string(miss, ',') AS missing_indices, array_to_string(more, ',') AS unexpected_indices,
len(miss) = 0 AND len(more) = 0 AND coalesce(NOT conflicting_counts, true) AND coalesce(expected_chunks > 0, false) AS is_complete FROM g)"""
_FCD = _FC.format(k="collection, file_path", t="dual_documents")


def _complete(spark, d):
    return integrity.file_completeness(t(spark, d, "dual_documents"), ["collection", "file_path"])


def _joined(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.array_join(F.col(c).cast("array<string>"), ","))
    return df


@query(f"{_FCD} SELECT * FROM c")
def completeness_files(spark, d):
    return _joined(_complete(spark, d), "missing_indices", "unexpected_indices")


@query(f"{_FCD} SELECT collection, file_path, duplicate_chunks FROM c WHERE duplicate_chunks > 0")
def duplicate_chunks(spark, d):
    return _complete(spark, d).filter("duplicate_chunks > 0").select("collection", "file_path", "duplicate_chunks")


@query(f"""{_FC.format(k="git_project_identifier, file_path", t="code_chunks")} SELECT git_project_identifier, count(*) AS files, count(*) FILTER (is_complete) AS complete_files, sum(expected_chunks)::BIGINT AS expected_chunks, sum(distinct_chunks)::BIGINT AS actual_chunks,
CASE WHEN coalesce(sum(expected_chunks), 0) = 0 THEN 100.0 ELSE round(100.0::DOUBLE * sum(distinct_chunks) / sum(expected_chunks), 3) END AS completion FROM c GROUP BY 1""")
def project_completeness(spark, d):
    f = integrity.file_completeness(t(spark, d, "code_chunks"), ["git_project_identifier", "file_path"])
    return integrity.project_completeness(f, "git_project_identifier")


@query("SELECT l_orderkey, max(l_linenumber) AS expected, count(*) AS actual, max(l_linenumber) = count(*) AS is_complete FROM lineitem GROUP BY 1")
def order_completeness(spark, d):
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("expected"), F.count("*").alias("actual"), (F.max("l_linenumber") == F.count("*")).alias("is_complete"))


@query("""SELECT collection, count(*) AS files, count(*) FILTER (NOT coalesce(is_complete, true)) AS incomplete_files, count(*) FILTER (coalesce(has_garbled_text, false)) AS garbled_files, count(*) FILTER (coalesce(suspected_dropout, false)) AS dropout_files,
count(*) FILTER (coalesce(has_duplicate_chunks, false)) AS duplicate_files, count(*) FILTER (NOT coalesce(is_complete, true) OR coalesce(has_garbled_text, false) OR coalesce(suspected_dropout, false) OR coalesce(has_duplicate_chunks, false)) = 0 AS is_healthy FROM file_verifications GROUP BY 1""")
def collection_health(spark, d):
    return integrity.health(t(spark, d, "file_verifications"))


@query(f"{_FCD} SELECT coalesce(v.is_complete, false) AS reported, c.is_complete AS computed, count(*) AS files FROM c JOIN file_verifications v USING (collection, file_path) GROUP BY 1, 2")
def verification_compare(spark, d):
    v = t(spark, d, "file_verifications").select("collection", "file_path", F.coalesce("is_complete", F.lit(False)).alias("reported"))
    return _complete(spark, d).join(v, ["collection", "file_path"]).groupBy("reported", F.col("is_complete").alias("computed")).agg(F.count("*").alias("files"))


@query("""WITH p AS (SELECT DISTINCT collection, file_path, page_number, page_count, content FROM dual_documents WHERE document_type = 'pdf'),
g AS (SELECT collection, file_path, max(page_count) AS page_count, list_sort(list(DISTINCT page_number) FILTER (page_number IS NOT NULL AND length(coalesce(content, '')) > 0)) AS cov, list_sort(list(DISTINCT page_number) FILTER (page_number IS NOT NULL AND length(coalesce(content, '')) BETWEEN 1 AND 199)) AS low FROM p GROUP BY 1, 2),
h AS (SELECT *, list_filter(range(1, coalesce(page_count, 0) + 1), lambda x: NOT coalesce(list_contains(cov, x::INT), false)) AS miss FROM g)
SELECT collection, file_path, page_count, coalesce(array_to_string(cov, ','), '') AS covered_pages, coalesce(array_to_string(low, ','), '') AS low_text_pages, array_to_string(miss, ',') AS empty_pages, concat_ws(',', CASE WHEN len(miss) > 0 THEN 'empty_pages' END, CASE WHEN coalesce(len(low), 0) > 0 THEN 'low_text_pages' END) AS quality_warnings FROM h""")
def quality_manifest(spark, d):
    p = t(spark, d, "dual_documents").filter("document_type = 'pdf'").select("collection", "file_path", "page_number", "page_count", "content")
    return _joined(integrity.quality_manifest(p, ["collection", "file_path"], "page_number", "page_count", "content"), "covered_pages", "low_text_pages", "empty_pages")


# --- change detection -------------------------------------------------------------------------------------------

_FOUND = "SELECT DISTINCT file_path, quick_hash, file_hash FROM dual_documents"


def _found(spark, d):
    return t(spark, d, "dual_documents").select("file_path", "quick_hash", "file_hash").distinct()


@query(f"WITH f AS ({_FOUND}) SELECT file_path, quick_hash, quick_hash IS NOT NULL AND EXISTS (SELECT 1 FROM file_manifests m WHERE m.file_path = f.file_path AND m.quick_hash = f.quick_hash) AS unchanged FROM (SELECT DISTINCT file_path, quick_hash FROM f) f")
def change_detection_gate(spark, d):
    f, m = _found(spark, d).select("file_path", "quick_hash").distinct(), t(spark, d, "file_manifests")
    return sync.unchanged(f, m).withColumn("unchanged", F.lit(True)).unionByName(sync.changed(f, m).withColumn("unchanged", F.lit(False)))


_BRANCHES = """main AS (SELECT DISTINCT file_path, source_hash FROM code_chunks WHERE git_branch = 'main'), other AS (SELECT DISTINCT file_path, source_hash FROM code_chunks WHERE git_branch <> 'main')"""


def _branches(spark, d):
    c = t(spark, d, "code_chunks")
    return c.filter("git_branch = 'main'").select("file_path", "source_hash").distinct(), c.filter("git_branch <> 'main'").select("file_path", "source_hash").distinct()


@query(f"""WITH {_BRANCHES}, f AS (SELECT file_path, max(source_hash) AS h FROM other GROUP BY 1), i AS (SELECT file_path, max(source_hash) AS h FROM main GROUP BY 1)
SELECT file_path, CASE WHEN i.file_path IS NULL THEN 'new' WHEN f.file_path IS NULL THEN 'orphan' WHEN f.h IS NOT DISTINCT FROM i.h THEN 'unchanged' ELSE 'modified' END AS status FROM f FULL JOIN i USING (file_path)""")
def classified_files(spark, d):
    main, other = _branches(spark, d)
    return sync.classified(other, main, content="source_hash")


@query(f"""WITH {_BRANCHES}, n AS (SELECT source_hash, file_path AS new_path, row_number() OVER (PARTITION BY source_hash ORDER BY file_path) AS r FROM other WHERE source_hash IS NOT NULL AND file_path NOT IN (SELECT file_path FROM main)),
g AS (SELECT source_hash, file_path AS old_path, row_number() OVER (PARTITION BY source_hash ORDER BY file_path) AS r FROM main WHERE source_hash IS NOT NULL AND file_path NOT IN (SELECT file_path FROM other)) SELECT old_path, new_path, source_hash FROM g JOIN n USING (source_hash, r)""")
def rename_pairs(spark, d):
    """Files of the other branches' worktrees as found, those of main as indexed."""
    main, other = _branches(spark, d)
    return sync.renames(other, main, content="source_hash")


@query("SELECT DISTINCT file_path FROM file_manifests WHERE starts_with(file_path, '/srv/repos/') AND file_path NOT IN (SELECT file_path FROM dual_documents)")
def stale_paths(spark, d):
    return sync.stale(t(spark, d, "file_manifests"), t(spark, d, "dual_documents"), ["/srv/repos"])


@query("SELECT DISTINCT file_path FROM (SELECT file_path FROM file_manifests UNION ALL SELECT file_path FROM documents) WHERE file_path NOT IN (SELECT file_path FROM dual_documents WHERE file_path IS NOT NULL) AND file_path NOT IN (SELECT file_path FROM code_chunks WHERE file_path IS NOT NULL)")
def orphans(spark, d):
    """The files of the manifests and of documents as indexed, those of the two chunk tables as found."""
    disk = t(spark, d, "dual_documents").select("file_path").unionByName(t(spark, d, "code_chunks").select("file_path"))
    return sync.orphans(t(spark, d, "file_manifests").select("file_path").unionByName(_docs(spark, d).select("file_path")), disk)


@query("SELECT DISTINCT file_path FROM file_manifests WHERE file_path IN (SELECT file_path FROM dual_documents) AND file_path NOT IN (SELECT file_path FROM file_verifications WHERE is_complete)")
def uncovered(spark, d):
    return sync.uncovered(t(spark, d, "file_manifests"), t(spark, d, "dual_documents"), t(spark, d, "file_verifications").filter("is_complete"))


_PAR = """WITH a AS (SELECT file_path, count(*) AS l FROM (SELECT DISTINCT id, file_path FROM dual_documents) GROUP BY 1), b AS (SELECT file_path, max(chunk_count)::BIGINT AS r FROM file_manifests GROUP BY 1),
p AS (SELECT file_path, coalesce(l, 0) AS left_count, coalesce(r, 0) AS right_count, CASE WHEN b.file_path IS NULL THEN 'left_only' WHEN a.file_path IS NULL THEN 'right_only' WHEN l = r THEN 'synced' ELSE 'mismatch' END AS status FROM a FULL JOIN b USING (file_path))"""


def _parity(spark, d):
    left = t(spark, d, "dual_documents").select("id", "file_path").distinct()
    m = t(spark, d, "file_manifests").groupBy("file_path").agg(F.max("chunk_count").alias("n"))
    right = m.select("file_path", F.explode(F.sequence(F.lit(1), "n")).alias("i"))
    return sync.parity(left, right, ["file_path"])


@query(f"{_PAR} SELECT * FROM p")
def parity_status(spark, d):
    return _parity(spark, d)


@query(f"{_PAR} SELECT status, count(*) AS files, sum(left_count)::BIGINT AS left_rows, sum(right_count)::BIGINT AS right_rows FROM p GROUP BY 1")
def parity_summary(spark, d):
    return _parity(spark, d).groupBy("status").agg(F.count("*").alias("files"), F.sum("left_count").alias("left_rows"), F.sum("right_count").alias("right_rows"))


@query("""WITH h AS (SELECT file_path, arg_min(struct_pack(n := git_project_name, b := git_branch, c := git_commit_hash), id) AS m FROM (SELECT DISTINCT id, file_path, git_project_name, git_branch, git_commit_hash FROM code_chunks) WHERE git_project_name IS NOT NULL GROUP BY 1),
l AS (SELECT DISTINCT id, file_path, git_project_name, git_branch, git_commit_hash FROM code_chunks WHERE git_project_name IS NULL OR git_branch IS NULL OR git_commit_hash IS NULL)
SELECT id, coalesce(git_project_name, m.n) AS git_project_name, coalesce(git_project_name, m.n) || '#' || coalesce(git_branch, m.b) || '@' || substring(coalesce(git_commit_hash, m.c), 1, 7) AS version_identifier FROM l JOIN h USING (file_path)""")
def metadata_repair(spark, d):
    c = t(spark, d, "code_chunks").select("id", "file_path", "git_project_name", "git_branch", "git_commit_hash").distinct()
    return sync.metadata_repair(c, c).select("id", "git_project_name", "version_identifier")


@query("""WITH i AS (SELECT git_project_identifier, max(git_commit_hash) AS c FROM code_chunks WHERE git_project_identifier IS NOT NULL GROUP BY 1)
SELECT p.git_project_identifier, CASE WHEN i.git_project_identifier IS NULL THEN 'index' WHEN p.git_commit_hash IS NOT DISTINCT FROM i.c THEN 'skip' ELSE 'update' END AS action FROM git_projects p LEFT JOIN i USING (git_project_identifier)""")
def reindex_needed(spark, d):
    return sync.reindex_needed(t(spark, d, "git_projects"), t(spark, d, "code_chunks"))


@query("""WITH b AS (SELECT min(ts) + INTERVAL 5 DAY AS lo, max(ts) - INTERVAL 5 DAY AS hi FROM events), c AS (SELECT event_id, ts, CASE WHEN ts > hi THEN 'arrived' WHEN ts >= lo THEN 'covered' ELSE 'backlog' END AS phase FROM events, b),
l AS (SELECT *, lag(phase) OVER (ORDER BY event_id) AS prev FROM c) SELECT event_id, phase, sum(CASE WHEN prev IS NOT NULL AND prev <> phase THEN 1 ELSE 0 END) OVER (ORDER BY event_id)::BIGINT AS segment FROM l""")
def backlog_phases(spark, d):
    e = t(spark, d, "events")
    lo, hi = e.agg(F.expr("min(ts) + interval 5 days"), F.expr("max(ts) - interval 5 days")).first()
    return sync.phases(e, F.lit(hi).cast(e.schema["ts"].dataType), F.lit(lo).cast(e.schema["ts"].dataType), "ts", "event_id").select("event_id", "phase", "segment")


@query("""WITH p AS (SELECT DISTINCT id, collection, file_path, page_number, content FROM dual_documents WHERE document_type = 'pdf' AND page_number IS NOT NULL)
SELECT id, coalesce(sum(length(content) + 1) OVER (PARTITION BY collection, file_path ORDER BY page_number, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_char FROM p""")
def page_offsets(spark, d):
    p = t(spark, d, "dual_documents").filter("document_type = 'pdf' and page_number is not null").select("id", "collection", "file_path", "page_number", "content").distinct()
    return extraction.page_offsets(p, ["collection", "file_path"], ["page_number", "id"], "content").select("id", "start_char")


@query("""WITH c AS (SELECT doc_id, unnest(range(0, length(text), 1500)) AS start_char, length(text) AS n FROM documents WHERE length(text) > 0) SELECT doc_id, start_char, least(start_char // 1800 + 1, (n - 1) // 1800 + 1) AS page_number FROM c""")
def page_lookup_range_join(spark, d):
    """Chunks of 1,500 characters on pages of 1,800: each chunk's page by its first character."""
    docs = _docs(spark, d).filter(F.length("text") > 0)
    chunks = chunkers.fixed_windows(docs, "doc_id", "text", 1500, 0).select("doc_id", F.col("start_char").cast("long").alias("start_char"))
    cut = docs.select("doc_id", F.posexplode(F.expr("transform(sequence(0, cast((length(text) - 1) div 1800 as int)), i -> substring(text, i * 1800 + 1, 1799))")).alias("_i", "content"))
    pages = extraction.page_offsets(cut.withColumn("page_number", F.col("_i") + 1), ["doc_id"], ["page_number"], "content")
    return extraction.page_of(chunks, pages, ["doc_id"]).select("doc_id", "start_char", F.col("page_number").cast("long").alias("page_number"))


@query("SELECT doc_id, row_number() OVER (ORDER BY created_at DESC NULLS LAST, file_path, doc_id) AS place FROM documents")
def order_newest_nulls_last(spark, d):
    df = _docs(spark, d).select("doc_id", "created_at", "file_path")
    return ordering.numbered(df, [F.col("created_at").desc_nulls_last(), F.col("file_path"), F.col("doc_id")]).select("doc_id", "place")


# --- chunkers ---------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT doc_id, text, unnest(range(0, length(text), 400)) AS s FROM documents) SELECT doc_id, (s // 400)::INT AS chunk_index, s::INT AS start_char, md5(substring(text, s::BIGINT + 1, 500)) AS chunk_hash FROM c""")
def chunk_fixed_window(spark, d):
    return chunkers.fixed_windows(_docs(spark, d), "doc_id", "text", 500, 100).select("doc_id", "chunk_index", "start_char", F.md5("chunk").alias("chunk_hash"))


@query()
def chunk_sentence_window(spark, d):
    return chunkers.chunked(_docs(spark, d), "doc_id", "text", lambda s: [c for _, _, c in chunkers.sentence_windows(s)])


@query()
def chunk_line_based(spark, d):
    return chunkers.chunked(t(spark, d, "code_chunks").select("id", "content").distinct(), "id", "content", chunkers.line_chunks)


@query()
def chunk_markdown(spark, d):
    return chunkers.chunked(t(spark, d, "dual_documents").filter("document_type = 'md'").select("id", "content").distinct(), "id", "content", lambda s: [c for _, c in chunkers.markdown_chunks(s)])


@query()
def chunk_hard_split(spark, d):
    return chunkers.chunked(_docs(spark, d), "doc_id", "text", lambda s: [c for _, _, c in chunkers.hard_windows(s, 1000)])


@query()
def extract_definitions(spark, d):
    return chunkers.extract_definitions(t(spark, d, "code_chunks").select("file_path", "content").distinct(), "file_path", "content")


@query("""WITH c AS (SELECT doc_id, unnest(string_split(text, E'\n\n')) AS content, generate_subscripts(string_split(text, E'\n\n'), 1) AS page_number FROM documents) SELECT doc_id, page_number::BIGINT AS page_number, md5(content) AS content_hash FROM c WHERE trim(content) <> ''""")
def page_documents(spark, d):
    """Texts whose blocks stand for pages, one row per page that is not empty."""
    docs = _docs(spark, d).withColumn("text", F.replace("text", F.lit("\n\n"), F.lit("\f")))
    return chunkers.pages(docs, "doc_id", "text").select("doc_id", F.col("page_number").cast("long").alias("page_number"), F.md5("content").alias("content_hash"))


@query()
def batch_schedule(spark, d):
    docs = _docs(spark, d).select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("part"), tx.token_estimate(F.col("text")).alias("tokens")).filter("tokens is not null")
    return chunkers.batches(docs, "part", "doc_id", "tokens", 8192, 32)


@query()
def embed_documents(spark, d):
    """Vectors of the built-in hash model for each distinct text; copies are not embedded again."""
    docs = _docs(spark, d).filter("text is not null").select("doc_id", "text", paths.content_hash(F.col("text")).alias("h"))
    once = docs.groupBy("h").agg(F.any_value("text").alias("text")).select("h", embed.embedder()(F.col("text")).alias("embedding"))
    return docs.select("doc_id", "h").join(once, "h").select("doc_id", "embedding")


# --- changes ----------------------------------------------------------------------------------------------------


@query("SELECT doc_id, lang, md5(text) AS text_hash FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang IS NULL) UNION ALL SELECT doc_id, 'unknown', md5(text) FROM documents WHERE lang IS NULL")
def upsert_result(spark, d):
    """Rows without language replaced by corrected ones."""
    rows = _docs(spark, d).select("doc_id", "lang", F.md5("text").alias("text_hash"))
    return dml.upsert(rows, rows.filter("lang is null").withColumn("lang", F.lit("unknown")), ["doc_id"])


@query("SELECT id, file_path FROM dual_documents WHERE file_path NOT IN (SELECT file_path FROM file_verifications WHERE NOT is_complete)")
def delete_by_path(spark, d):
    bad = t(spark, d, "file_verifications").filter("not is_complete")
    return dml.delete(t(spark, d, "dual_documents").select("id", "file_path"), bad, ["file_path"])


@query("SELECT git_project_identifier, count(*) AS n FROM code_chunks WHERE NOT coalesce(git_project_identifier = 'tinder-vault#main', false) GROUP BY 1")
def delete_project(spark, d):
    return dml.delete_project(t(spark, d, "code_chunks"), "tinder-vault#main").groupBy("git_project_identifier").agg(F.count("*").alias("n"))


@query("SELECT id, CASE WHEN document_type = 'md' THEN regexp_replace(file_path, '\\.md$', '.markdown') ELSE file_path END AS file_path, CASE WHEN document_type = 'md' THEN regexp_extract(regexp_replace(file_path, '\\.md$', '.markdown'), '([^/]*)$', 1) ELSE filename END AS filename FROM dual_documents")
def rename_result(spark, d):
    r = t(spark, d, "dual_documents").select("id", "file_path", "filename", "document_type")
    moves = r.filter("document_type = 'md'").select(F.col("file_path").alias("old_path"), F.regexp_replace("file_path", r"\.md$", ".markdown").alias("new_path")).distinct()
    return dml.rename(r.drop("document_type"), moves)


@query("SELECT collection, file_path, quick_hash FROM file_manifests WHERE NOT (starts_with(file_path, '/srv/repos/') AND file_path NOT IN (SELECT file_path FROM dual_documents))")
def prune_result(spark, d):
    m = t(spark, d, "file_manifests").select("collection", "file_path", "quick_hash")
    return dml.prune(m, t(spark, d, "dual_documents").select("file_path").distinct(), ["/srv/repos"])


@query("SELECT id, strftime(max(indexed_at)::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS indexed_at FROM code_chunks GROUP BY 1")
def latest_rows(spark, d):
    c = t(spark, d, "code_chunks").select("id", "indexed_at", "chunk_index")
    return dml.exclusive(c, "id", "indexed_at").select("id", F.date_format("indexed_at", "yyyy-MM-dd HH:mm:ss").alias("indexed_at"))


@query("""WITH o AS (SELECT collection, file_path, avg_quality_score AS s FROM file_verifications WHERE avg_quality_score IS NOT NULL), n AS (SELECT collection, file_path, 0.7::DOUBLE AS s FROM o)
SELECT collection, file_path, greatest(o.s, n.s) AS s FROM o JOIN n USING (collection, file_path)""")
def repair_better_only(spark, d):
    o = t(spark, d, "file_verifications").filter("avg_quality_score is not null").select("collection", "file_path", F.col("avg_quality_score").alias("s"))
    return dml.better_only(o, o.withColumn("s", F.lit(0.7)), ["collection", "file_path"], "s")


@query("SELECT vec_id, label, len(embedding)::INT AS n, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def export_import_roundtrip(spark, d):
    """Written as JSON lines with their header, and read back."""
    to = f"{shared_dir(spark)}/quillspark/export-{uuid.uuid4().hex}"
    exchange.export_jsonl(t(spark, d, "embeddings"), to, "embeddings")
    _, back = exchange.import_jsonl(spark, to)
    return back.select("vec_id", "label", F.size("embedding").alias("n"), F.round(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


# --- records, extraction and catalogue rules --------------------------------------------------------------------


@query("SELECT id, programming_language AS language, git_project_name AS project, git_branch AS branch, md5(content) AS content_hash FROM (SELECT DISTINCT id, programming_language, git_project_name, git_branch, content FROM code_chunks)")
def text_document_view(spark, d):
    v = records.text_documents(t(spark, d, "code_chunks").select("id", "programming_language", "git_project_name", "git_branch", "content", "chunk_count", "source_hash").distinct())
    return v.select("id", "language", "project", "branch", F.md5("content").alias("content_hash"))


@query()
def vector_payload_view(spark, d):
    """Payload objects without null fields (rows only: engines order and escape JSON differently)."""
    c = t(spark, d, "code_chunks").drop("embedding", "content")
    return c.select("id", records.payload(c).alias("payload"))


@query("SELECT id, concat_ws(' | ', 'Language: ' || programming_language, 'Project: ' || git_project_name, CASE WHEN git_branch NOT IN ('main', 'master') THEN 'Branch: ' || git_branch END) AS line FROM (SELECT DISTINCT id, programming_language, git_project_name, git_branch FROM code_chunks)")
def inline_metadata(spark, d):
    c = t(spark, d, "code_chunks").select("id", "programming_language", "git_project_name", "git_branch").distinct()
    return c.select("id", records.inline_metadata(F.col("programming_language"), F.col("git_project_name"), F.col("git_branch"), F.lit(None).cast("int"), verbose=True).alias("line"))


@query("SELECT id, CASE WHEN schema_version IS NULL THEN 'legacy' WHEN schema_version < 1 THEN 'older' WHEN schema_version > 1 THEN 'newer' WHEN coalesce(chunking_version, '') = '' THEN 'no_app_version' ELSE 'ok' END AS state FROM (SELECT DISTINCT id, schema_version, chunking_version FROM dual_documents)")
def schema_version_check(spark, d):
    v = t(spark, d, "dual_documents").select("id", "schema_version", "chunking_version").distinct()
    return v.select("id", records.schema_state(F.col("schema_version"), F.col("chunking_version")).alias("state"))


@query("WITH n AS (SELECT git_project_identifier, count(*) AS c FROM code_chunks GROUP BY 1) SELECT p.git_project_identifier, coalesce(strftime(last_sync::TIMESTAMP, '%Y-%m-%d %H:%M:%S'), CASE WHEN coalesce(c, 0) > 0 THEN 'unknown' ELSE 'never synced' END) AS last_sync FROM git_projects p LEFT JOIN n USING (git_project_identifier)")
def last_sync_listing(spark, d):
    n = t(spark, d, "code_chunks").groupBy("git_project_identifier").agg(F.count("*").alias("c"))
    return t(spark, d, "git_projects").join(n, "git_project_identifier", "left").select("git_project_identifier", records.last_sync(F.col("last_sync"), F.coalesce("c", F.lit(0))).alias("last_sync"))


_P = _M.replace("doc_id, lang, text", "id, pages, text").replace("FROM documents)", "FROM (SELECT DISTINCT id, page_count AS pages, content AS text FROM dual_documents))")


@query(f"""{_P} SELECT id, CASE WHEN coalesce(n, 0) < 100 OR {_BLANK} OR bad / n::DOUBLE > 0.05 OR (len(w) = 0 AND n > 100 AND ok / n::DOUBLE < 0.1) OR (len(w) > 100 AND st / len(w) < 0.02) OR ({_SCORE}) < 0.7 THEN 'ocr'
WHEN pages >= 2 AND coalesce(n, 0) / pages::DOUBLE < 500 THEN 'plain' ELSE 'keep' END AS action FROM k""")
def extraction_action(spark, d):
    v = t(spark, d, "dual_documents").select("id", "page_count", "content").distinct()
    return v.select("id", extraction.action(F.col("content"), F.col("page_count")).alias("action"))


_B2 = _BLANK.replace("text", "content")


@query(f"SELECT collection, file_path, count(*) AS pages, count(*) FILTER ({_B2}) AS empty_pages, count(*) FILTER (NOT {_B2} AND ocr_confidence < 60) AS low_confidence_pages, round(avg(CASE WHEN NOT {_B2} THEN ocr_confidence END), 6) AS mean_confidence FROM (SELECT DISTINCT id, collection, file_path, ocr_confidence, content FROM dual_documents WHERE ocr_language IS NOT NULL) GROUP BY 1, 2")
def ocr_page_summary(spark, d):
    v = t(spark, d, "dual_documents").filter("ocr_language is not null").select("id", "collection", "file_path", "ocr_confidence", "content").distinct()
    return extraction.ocr_summary(v, ["collection", "file_path"], "ocr_confidence", "content", digits=6)


@query("SELECT doc_id, floor(length(text) / 3.3::DOUBLE)::INT AS tokens, floor(length(text) / 3.3::DOUBLE) > 2000 AND floor(length(text) / 3.3::DOUBLE) < 8000 AS late FROM documents")
def late_chunk_flag(spark, d):
    n = tx.token_estimate(F.col("text"))
    return _docs(spark, d).select("doc_id", n.alias("tokens"), extraction.late_chunking(n).alias("late"))


@query("""WITH o AS (SELECT DISTINCT ON (entry_id) entry_id, command_name, duration_ms, result_count FROM interaction_log WHERE duration_ms >= 0 ORDER BY entry_id, received_at DESC NULLS LAST), g AS (SELECT command_name, sum(duration_ms)::BIGINT AS total, sum(result_count)::BIGINT AS items FROM o GROUP BY 1)
SELECT command_name, total, round(100.0::DOUBLE * total / sum(total) OVER (), 3) AS percent, round(items / NULLIF(total, 0)::DOUBLE, 6) AS rate FROM g""")
def stage_profile(spark, d):
    o = dml.exclusive(t(spark, d, "interaction_log").filter("duration_ms >= 0"), "entry_id", "received_at")
    return records.stage_profile(o, "command_name", "duration_ms", "result_count")


@query("""WITH o AS (SELECT DISTINCT ON (entry_id) entry_id, project, error_text FROM interaction_log ORDER BY entry_id, received_at DESC NULLS LAST) SELECT project, count(*) AS runs, round(count(error_text) / count(*)::DOUBLE, 6) AS error_rate FROM o GROUP BY 1""")
def log_error_rate(spark, d):
    o = dml.exclusive(t(spark, d, "interaction_log"), "entry_id", "received_at")
    return o.groupBy("project").agg(F.count("*").alias("runs"), F.round(F.count("error_text") / F.count("*"), 6).alias("error_rate"))


@query("""WITH u AS (SELECT DISTINCT ON (id) id, git_project_identifier, file_path, list_transform(embedding, lambda x: coalesce(x, 0))::DOUBLE[] AS v, len(list_filter(embedding, lambda x: x IS NULL)) AS holes FROM code_chunks ORDER BY id, indexed_at DESC NULLS LAST),
v AS (SELECT * FROM u WHERE len(v) = 64 AND holes = 0 AND list_inner_product(v, v) > 0), q AS (SELECT v AS e FROM v ORDER BY id LIMIT 1), s AS (SELECT git_project_identifier, file_path FROM v, q ORDER BY list_cosine_similarity(v, e) DESC, id LIMIT 200)
SELECT DISTINCT s.git_project_identifier, s.file_path FROM s JOIN code_chunks c USING (git_project_identifier, file_path) WHERE contains(c.content, 'return')""")
def cooperative_search(spark, d):
    """Files among the 200 hits most similar to a chunk that also hold a word."""
    c = t(spark, d, "code_chunks").select("id", "git_project_identifier", "file_path", "content", "embedding", "indexed_at")
    c = dml.exclusive(c, "id", "indexed_at")
    usable = vectors.fault(F.col("embedding"), 64).isNull()
    q = [float(x) for x in c.filter(usable).orderBy("id").select("embedding").first()["embedding"]]
    near = vector_search.search(c.filter(usable), q, "id", limit=200).select("git_project_identifier", "file_path")
    return near.join(c.filter(F.col("content").contains("return")).select("git_project_identifier", "file_path"), ["git_project_identifier", "file_path"], "left_semi").distinct()


@query()
def chunk_resplit(spark, d):
    return chunkers.chunked(_docs(spark, d), "doc_id", "text", lambda s: chunkers.resplit(s, 900))


@query()
def frontmatter(spark, d):
    return extraction.frontmatter(t(spark, d, "dual_documents").filter("document_type = 'md'").select("id", "content").distinct(), "id", "content")


@query()
def chunk_code(spark, d):
    """Files by their definitions."""
    c = dml.exclusive(t(spark, d, "code_chunks").select("id", "indexed_at", "git_project_identifier", "file_path", "chunk_index", "content"), "id", "indexed_at")
    files = c.groupBy("git_project_identifier", "file_path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", F.coalesce("content", F.lit("")).alias("content")))), lambda x: x["content"]), "").alias("code"))
    return chunkers.chunked_code(files, "file_path", "code").select("file_path", "chunk_index", "chunk_count", F.md5("chunk").alias("chunk_hash"))


@query()
def chunk_markdown_naive(spark, d):
    return chunkers.chunked(t(spark, d, "dual_documents").filter("document_type = 'md'").select("id", "content").distinct(), "id", "content", lambda s: [c for *_, c in chunkers.naive_markdown_chunks(s)])


@query("SELECT collection, file_path, count(*) AS chunks, min(filename) AS filename FROM dual_documents GROUP BY 1, 2 ORDER BY coalesce(min(filename), collection || '/' || file_path), collection, file_path LIMIT 25 OFFSET 50")
def items_page(spark, d):
    """The third page of a listing by name."""
    return listings.page_of_items(t(spark, d, "dual_documents"), ["collection", "file_path"], 25, 50)


@query("SELECT git_project_identifier, count(*) AS chunks, count(DISTINCT file_path) AS items FROM code_chunks GROUP BY 1")
def items_by_project(spark, d):
    return listings.distinct_items(t(spark, d, "code_chunks"), ["git_project_identifier"])


_FCB = _FC.format(k="git_project_identifier, file_path", t="(SELECT * REPLACE (CASE WHEN chunk_index = 0 AND git_branch = 'main' THEN chunk_count + 1 ELSE chunk_count END AS chunk_count) FROM code_chunks)")


@query(f"{_FCB} SELECT git_project_identifier, file_path, expected_chunks, missing_indices FROM c WHERE conflicting_counts")
def conflicting_counts(spark, d):
    """The first chunks of the main branches say one chunk more than the others do: the larger number counts."""
    c = t(spark, d, "code_chunks").withColumn("chunk_count", F.when((F.col("chunk_index") == 0) & (F.col("git_branch") == "main"), F.col("chunk_count") + 1).otherwise(F.col("chunk_count")))
    f = integrity.file_completeness(c, ["git_project_identifier", "file_path"]).filter("conflicting_counts")
    return _joined(f.select("git_project_identifier", "file_path", "expected_chunks", "missing_indices"), "missing_indices")


@query("""WITH o AS (SELECT DISTINCT ON (entry_id) entry_id, command_name, duration_ms FROM interaction_log ORDER BY entry_id, received_at DESC NULLS LAST) SELECT command_name, count(*) AS n,
quantile_disc(duration_ms, 0.5)::BIGINT AS p50_ms, quantile_disc(duration_ms, 0.9)::BIGINT AS p90_ms, quantile_disc(duration_ms, 0.99)::BIGINT AS p99_ms FROM o WHERE duration_ms >= 0 GROUP BY 1""")
def latency_percentiles(spark, d):
    return listings.latencies(dml.exclusive(t(spark, d, "interaction_log"), "entry_id", "received_at"), ["command_name"])


@query("""WITH l AS (SELECT DISTINCT source_hash AS file_hash, file_path FROM code_chunks WHERE git_branch = 'main' AND source_hash IS NOT NULL), n AS (SELECT DISTINCT source_hash AS file_hash, file_path FROM code_chunks WHERE git_branch <> 'main' AND source_hash IN (SELECT file_hash FROM l))
SELECT file_hash, file_path FROM l UNION SELECT file_hash, file_path FROM n""")
def alternate_paths(spark, d):
    """The worktrees' paths as further places of contents that main has."""
    c = t(spark, d, "code_chunks").filter("source_hash is not null").select(F.col("source_hash").alias("file_hash"), "file_path", "git_branch", F.lit(None).cast("string").alias("quick_hash")).distinct()
    main, other = c.filter("git_branch = 'main'").drop("git_branch").distinct(), c.filter("git_branch <> 'main'").drop("git_branch").distinct()
    return dml.add_locations(main, other).select("file_hash", "file_path")


@query("""WITH s AS (SELECT DISTINCT id, file_path FROM dual_documents), g AS (SELECT file_path, count(*) AS n FROM s GROUP BY 1), h AS (SELECT file_path, count(*) AS m FROM s WHERE id NOT LIKE '%7' GROUP BY 1)
SELECT id, file_path FROM s JOIN g USING (file_path) LEFT JOIN h USING (file_path) WHERE coalesce(m, 0) <> n""")
def back_fill_rows(spark, d):
    """What a second store lacks that has lost some rows: whole files."""
    s = t(spark, d, "dual_documents").select("id", "file_path").distinct()
    return sync.back_fill(s, s.filter("id not like '%7'"), ["file_path"])


@query("""WITH a AS (SELECT collection, file_path, count(*) AS l FROM (SELECT DISTINCT id, collection, file_path FROM dual_documents) GROUP BY 1, 2), b AS (SELECT collection, file_path, max(chunk_count)::BIGINT AS r FROM file_manifests GROUP BY 1, 2),
p AS (SELECT coalesce(a.collection, b.collection) AS collection, coalesce(l, 0) AS l, coalesce(r, 0) AS r, l IS NULL AS nl, r IS NULL AS nr FROM a FULL JOIN b ON a.collection = b.collection AND a.file_path = b.file_path)
SELECT collection, count(*) FILTER (l = r AND NOT nl AND NOT nr) AS synced, count(*) FILTER (l <> r AND NOT nl AND NOT nr) AS mismatch, count(*) FILTER (nr) AS left_only, count(*) FILTER (nl) AS right_only,
CASE WHEN sum(r) = 0 THEN 'right missing' WHEN sum(l) = 0 THEN 'left missing' WHEN count(*) FILTER (l <> r OR nl OR nr) = 0 THEN 'in parity' ELSE 'out of parity' END AS state FROM p GROUP BY 1""")
def parity_all_corpora(spark, d):
    left = t(spark, d, "dual_documents").select("id", "collection", "file_path").distinct()
    m = t(spark, d, "file_manifests").groupBy("collection", "file_path").agg(F.max("chunk_count").alias("n"))
    return sync.parity_by_corpus(left, m.select("collection", "file_path", F.explode(F.sequence(F.lit(1), "n")).alias("i")), "collection", "file_path")


@query("""WITH h AS (SELECT git_project_identifier, max(git_commit_hash) AS c FROM code_chunks GROUP BY 1) SELECT p.git_project_identifier, git_remote_url IS NOT NULL AND coalesce(git_commit_hash = c, false) AS skip FROM git_projects p LEFT JOIN h USING (git_project_identifier)""")
def git_fast_path(spark, d):
    """A project with a remote stands for one with clean files."""
    p = t(spark, d, "git_projects").select("git_project_identifier", "git_commit_hash", F.col("git_remote_url").isNotNull().alias("clean"))
    return sync.fast_path(p, t(spark, d, "code_chunks"))


@query("SELECT v.collection, v.file_path, coalesce(v.page_count, max(d.page_count))::INT AS page_count FROM file_verifications v LEFT JOIN dual_documents d ON d.collection IS NOT DISTINCT FROM v.collection AND d.file_path = v.file_path GROUP BY v.collection, v.file_path, v.page_count")
def page_count_fallback(spark, d):
    v = t(spark, d, "file_verifications").select("collection", "file_path", "page_count")
    return sync.page_counts(v, t(spark, d, "dual_documents"), ["collection", "file_path"])


@query("SELECT file_path, sum(n)::BIGINT AS chunk_count FROM (SELECT file_path, CASE WHEN length(content) > 0 THEN (length(content) - 1) // 400 + 1 ELSE 0 END AS n FROM dual_documents) GROUP BY 1 HAVING sum(n) > 0")
def stream_incremental_ingest(spark, d):
    """All rows as a stream of files, in micro-batches of one: cut into chunks, published, then read as a table."""
    rows = t(spark, d, "dual_documents").select("file_path", F.col("content").alias("text"))
    to = f"{shared_dir(spark)}/quillspark/stream-{uuid.uuid4().hex}"
    rows.repartition(4, "file_path").write.parquet(f"{to}/arriving")
    done = ingest.ingest(spark, f"{to}/arriving", rows.schema, lambda b: chunkers.fixed_windows(b, "file_path", "text", 400, 0), f"{to}/chunks", f"{to}/manifests", f"{to}/checkpoint", files_per_trigger=1)
    done.awaitTermination()
    return spark.read.parquet(f"{to}/manifests").select("file_path", "chunk_count")


_MODELS = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in embed.REGISTRY)


@query(f"""WITH m(key, name, dimensions, backend, max_seq_length, params_billions, task) AS (VALUES {_MODELS}), n AS (SELECT *, backend = 'sentence-transformers' AS late, CASE WHEN backend = 'sentence-transformers' AND dimensions >= 1024 THEN 768 WHEN backend = 'sentence-transformers' THEN 512 ELSE 460 END AS size FROM m)
SELECT key, name, late AS late_chunking, size AS chunk_size, greatest(1, (floor(size * 0.15 / 23) * 23)::INT) AS chunk_overlap, coalesce(max_seq_length, 8192) * 2 AS hard_limit_chars, CASE WHEN params_billions >= 5 THEN 8 WHEN params_billions >= 1 THEN 16 WHEN params_billions >= 0.3 THEN 32 ELSE 128 END AS batch_size,
CASE WHEN params_billions >= 5 THEN 'very-high' WHEN params_billions >= 1 THEN 'high' WHEN params_billions >= 0.3 THEN 'medium' ELSE 'low' END AS risk,
CASE WHEN key = 'stella' THEN 'deprecated' WHEN task IS NOT NULL THEN 'stable-default' WHEN backend = 'fastembed' THEN 'stable' WHEN params_billions >= 1 THEN 'gpu-opt-in' ELSE 'opt-in' END AS support FROM n""")
def model_catalogue(spark, d):
    """The registry of embedding models with tiers, chunk sizes and batch hints."""
    m = records.model_tiers(records.chunk_sizing(embed.catalogue(spark)))
    return m.select("key", "name", "late_chunking", "chunk_size", "chunk_overlap", "hard_limit_chars", "batch_size", "risk", "support")


# --- a corpus through its changes -------------------------------------------------------------------------------


def _texts(spark, d):
    """The markdown files as found: one text and one stamp each."""
    m = dml.exclusive(t(spark, d, "dual_documents").filter("document_type = 'md'").select("id", "indexed_at", "file_path", "chunk_index", "content"), "id", "indexed_at")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "id", F.coalesce("content", F.lit("")).alias("content")))), lambda x: x["content"]), "\n\n")
    return m.groupBy("file_path").agg(text.alias("text")).withColumn("quick_hash", F.md5("text"))


@query("""WITH f AS (SELECT DISTINCT file_path FROM dual_documents WHERE document_type = 'md'), c AS (SELECT count(*) AS n, count(*) FILTER (file_path LIKE '%1%') AS ones, count(*) FILTER (file_path LIKE '%2%' AND file_path NOT LIKE '%1%') AS twos FROM f)
SELECT 'first' AS step, 0::BIGINT AS renamed, 0::BIGINT AS pruned, n AS indexed, n AS found FROM c UNION ALL SELECT 'again', 0, 0, 0, n FROM c UNION ALL SELECT 'changed', 0, ones, twos, n - ones FROM c UNION ALL SELECT 'in the end', 0, 0, n - ones, n - ones FROM c""")
def corpus_sync(spark, d):
    """Counts of a first sync, one without changes, and one in which some files are gone and others changed; then what the manifests hold."""
    c = corpus.Corpus(Store(spark, f"{shared_dir(spark)}/quillspark/corpus-{uuid.uuid4().hex}"), "notes")
    c.create("markdown", buckets=8)
    f = _texts(spark, d).cache()
    folders = [r[0] for r in f.select(F.regexp_extract("file_path", "^(/[^/]*)", 1)).distinct().collect()]  # a handful of roots
    steps = [("first", c.sync(f, folders)), ("again", c.sync(f, folders))]
    other = F.col("file_path").contains("2")
    later = f.filter(~F.col("file_path").contains("1")).withColumn("text", F.when(other, F.concat("text", F.lit("\n\nchanged "), "file_path")).otherwise(F.col("text"))).withColumn("quick_hash", F.md5("text"))
    steps.append(("changed", c.sync(later, folders)))
    f.unpersist()
    n = c.manifests.count()
    rows = [(s, x["renamed"], x["pruned"], x["indexed"], x["found"]) for s, x in steps] + [("in the end", 0, 0, n, c.manifests.select("file_path").distinct().count())]
    return spark.createDataFrame(rows, "step string, renamed long, pruned long, indexed long, found long")


@query("SELECT 'memory/' || item_id AS file_path, 1::BIGINT AS chunk_count FROM eval_items WHERE item_id IN (SELECT item_id FROM eval_items ORDER BY item_id LIMIT 3)")
def corpus_inject(spark, d):
    """Three short texts put into an empty corpus, one of them twice: the manifests tell them as any file."""
    c = corpus.Corpus(Store(spark, f"{shared_dir(spark)}/quillspark/corpus-{uuid.uuid4().hex}"), "memory")
    c.create("markdown", buckets=4)
    rows = t(spark, d, "eval_items").orderBy("item_id").limit(3).collect()
    for r in [*rows, rows[0]]:
        c.inject(f"memory/{r['item_id']}", r["text"])
    assert c.verify().filter("not is_complete").count() == 0
    return c.manifests.select("file_path", "chunk_count")


@query("""WITH p AS (SELECT git_project_identifier, git_branch FROM git_projects), h AS (SELECT DISTINCT git_project_identifier FROM code_chunks)
SELECT git_project_identifier, 'index' AS first_run, CASE WHEN h.git_project_identifier IS NULL THEN 'index' WHEN git_branch = 'main' THEN 'update' ELSE 'skip' END AS second_run FROM p LEFT JOIN h USING (git_project_identifier)""")
def pipeline_source_collection(spark, d):
    """What two runs over all projects do, the second after the main branches have moved on."""
    store = Store(spark, f"{shared_dir(spark)}/quillspark/source-{uuid.uuid4().hex}")
    files = pipelines.files_of_chunks(t(spark, d, "code_chunks").filter("git_project_identifier is not null"))
    heads = files.groupBy("git_project_identifier").agg(F.max("git_commit_hash").alias("git_commit_hash"))
    projects = t(spark, d, "git_projects").select("git_project_identifier", "git_branch").join(heads, "git_project_identifier", "left")
    first = pipelines.source_collection(store, "code", projects.drop("git_branch"), files, buckets=16)
    moved = projects.withColumn("git_commit_hash", F.when(F.col("git_branch") == "main", F.lit("f" * 40)).otherwise(F.col("git_commit_hash"))).drop("git_branch")
    second = pipelines.project_actions(moved, store, "code")
    return first.select("git_project_identifier", F.col("action").alias("first_run")).join(second.withColumnRenamed("action", "second_run"), "git_project_identifier")


@query()
def pipeline_code_documents(spark, d):
    """A document for each definition of every file."""
    docs = pipelines.code_documents(pipelines.files_of_chunks(t(spark, d, "code_chunks")))
    return docs.select("id", "file_path", "qualified_name", "code_type", "start_line", "end_line", F.md5("content").alias("content_hash"))


@query(r"""WITH f AS (SELECT file_path, min(coalesce(file_hash, '')) AS h FROM dual_documents WHERE document_type = 'pdf' GROUP BY 1), p AS (SELECT DISTINCT id, file_path, page_number, content FROM dual_documents WHERE document_type = 'pdf' AND page_number IS NOT NULL),
q AS (SELECT file_path, page_number, string_agg(coalesce(content, ''), E'\n' ORDER BY id) AS content FROM p GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY page_number) AS k FROM q)
SELECT file_path, k AS page_number, md5(content) AS content_hash FROM n JOIN f USING (file_path) WHERE h NOT IN (SELECT min(coalesce(file_hash, '')) FROM dual_documents WHERE document_type = 'pdf' AND file_path LIKE '%1%' GROUP BY file_path) AND trim(content, E' ') <> ''""")
def pipeline_page_documents(spark, d):
    """Pages of the PDF files that are not indexed yet; those with a 1 in their path are."""
    p = t(spark, d, "dual_documents").filter("document_type = 'pdf'")
    hashes = p.groupBy("file_path").agg(F.min(F.coalesce("file_hash", F.lit(""))).alias("file_hash"))
    pages = p.filter("page_number is not null").select("id", "file_path", "page_number", "content").distinct().groupBy("file_path", "page_number").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", F.coalesce("content", F.lit("")).alias("c")))), lambda x: x["c"]), "\n").alias("c"))
    text = pages.groupBy("file_path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_number", "c"))), lambda x: x["c"]), "\f").alias("text"))
    pdfs = text.join(hashes, "file_path").withColumn("ocr_confidence", F.lit(None).cast("double"))
    known = hashes.filter(F.col("file_path").contains("1"))
    done = pdfs.join(known.select("file_hash").distinct(), "file_hash", "left_semi").select("file_path", "file_hash")
    return pipelines.page_documents(pdfs, done).select("file_path", F.col("page_number").cast("long").alias("page_number"), F.md5("content").alias("content_hash"))


# --- small functions over whole tables ---------------------------------------------------------------------------


def _blank(x: str) -> str:
    return _BLANK.replace("text", x)


def _once(spark, d, *cols: str):
    """Distinct rows of dual_documents."""
    return t(spark, d, "dual_documents").select(*cols).distinct()


@query(f"""SELECT id, md5(CASE WHEN {_blank("title")} THEN coalesce(content, '') WHEN {_blank("content")} THEN title ELSE content || E'\\n\\n[OCR fallback text]\\n\\n' || title END) AS merged,
CASE WHEN {_blank("title")} THEN 'ocr_failed_no_text' WHEN {_blank("content")} THEN 'ocr_only_empty_extraction' ELSE 'append_ocr_to_extracted_text' END AS strategy FROM (SELECT DISTINCT id, content, title FROM dual_documents)""")
def ocr_merge(spark, d):
    """The titles stand for what OCR found."""
    c = _once(spark, d, "id", "content", "title")
    return c.select("id", F.md5(extraction.merged_text(F.col("content"), F.col("title"))).alias("merged"), extraction.merge_strategy(F.col("content"), F.col("title")).alias("strategy"))


@query("SELECT id, content IS NULL OR coalesce(starts_with(sha256(content), substring(sha256(content), 1, 16)), false) AS own, CASE WHEN content IS NULL THEN true ELSE coalesce(starts_with(sha256(content), source_hash), false) END AS of_file FROM (SELECT DISTINCT id, content, source_hash FROM code_chunks)")
def source_hash_match(spark, d):
    """A chunk's own short hash fits it; the hash of its file fits where the chunk is the file."""
    c = t(spark, d, "code_chunks").select("id", "content", "source_hash").distinct()
    return c.select("id", extraction.matches_source(paths.short_hash(F.col("content")), F.col("content")).alias("own"), extraction.matches_source(F.col("source_hash"), F.col("content")).alias("of_file"))


@query("SELECT doc_id, substring(sha256(text), 1, 16) AS h FROM documents")
def short_hashes(spark, d):
    return _docs(spark, d).select("doc_id", paths.short_hash(F.col("text")).alias("h"))


@query("SELECT id, CASE WHEN ocr_confidence - 70 >= 0 THEN ocr_confidence - 70 END AS confidence FROM (SELECT DISTINCT id, ocr_confidence FROM dual_documents)")
def ocr_confidence_clean(spark, d):
    c = _once(spark, d, "id", "ocr_confidence")
    return c.select("id", extraction.confidence((F.col("ocr_confidence") - 70).cast("string")).alias("confidence"))


@query("SELECT entry_id, CASE WHEN v <> 'true' AND regexp_full_match(v, '[0-9]+') THEN v::BIGINT END AS n FROM (SELECT DISTINCT entry_id, CASE WHEN entry_id % 3 = 0 THEN 'true' WHEN entry_id % 3 = 1 THEN (result_count - 3)::VARCHAR ELSE result_count::VARCHAR END AS v FROM interaction_log)")
def count_field_parse(spark, d):
    v = F.when(F.col("entry_id") % 3 == 0, "true").when(F.col("entry_id") % 3 == 1, (F.col("result_count") - 3).cast("string")).otherwise(F.col("result_count").cast("string"))
    return t(spark, d, "interaction_log").select("entry_id", v.alias("v")).distinct().select("entry_id", records.count_field(F.col("v")).alias("n"))


@query("SELECT language, CASE language WHEN 'markdown' THEN 'files' WHEN 'pdf' THEN 'documents' WHEN 'code' THEN 'repositories' ELSE 'unknown' END AS unit, count(DISTINCT file_path) AS items FROM dual_documents GROUP BY 1")
def item_units(spark, d):
    return t(spark, d, "dual_documents").groupBy("language", records.item_unit(F.col("language")).alias("unit")).agg(F.countDistinct("file_path").alias("items"))


_NWS = r"regexp_replace(regexp_replace(regexp_replace({0}, '[\t\x{{a0}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{205f}}\x{{3000}}]', ' ', 'g'), '\n{{4,}}', E'\n\n\n', 'g'), '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g')"
_NTX = r"regexp_replace(regexp_replace(regexp_replace(text, ' +', ' ', 'g'), '\n{3,}', E'\n\n', 'g'), '[ \t]+\n', E'\n', 'g')"


@query(f"SELECT doc_id, md5({_NWS.format(_NTX)}) AS text_hash FROM documents")
def normalize_text(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(tx.normalize_text(F.col("text"))).alias("text_hash"))


@query("""SELECT id, CASE WHEN chunk_index IS NULL THEN file_path ELSE file_path || ':' || chunk_index || CASE WHEN line_count IS NOT NULL AND line_count <> chunk_index THEN '-' || line_count ELSE '' END || CASE WHEN has_functions THEN ' (main function)' ELSE '' END END AS location
FROM (SELECT DISTINCT id, file_path, chunk_index, line_count, has_functions FROM code_chunks)""")
def line_location(spark, d):
    """A chunk's place stands for its first line, the number of lines for its last."""
    c = t(spark, d, "code_chunks").select("id", "file_path", "chunk_index", "line_count", "has_functions").distinct()
    return c.select("id", fulltext.location(F.col("file_path"), F.col("chunk_index"), F.col("line_count"), F.when(F.col("has_functions"), "main")).alias("location"))


@query("SELECT DISTINCT file_path, programming_language, git_project_name, git_branch, chunk_index FROM code_chunks")
def essential_fields(spark, d):
    return records.essential(t(spark, d, "code_chunks")).distinct()


@query("SELECT DISTINCT id, coalesce(schema_version, 1) AS schema_version, '9.1' AS app_version FROM dual_documents")
def schema_stamp(spark, d):
    return records.stamped(_once(spark, d, "id", "schema_version"), "9.1").distinct()


@query("SELECT id, file_path, coalesce(page_number, -1)::INT AS page_number, coalesce(title, '') AS title FROM (SELECT DISTINCT id, file_path, page_number, title FROM dual_documents)")
def payload_roundtrip(spark, d):
    """Fields into payload objects, which leave out nulls, and back with defaults."""
    c = _once(spark, d, "id", "file_path", "page_number", "title")
    p = c.select("id", records.payload(c, ["file_path", "page_number", "title"]).alias("payload"))
    return records.from_payload(p, "payload", "file_path string, page_number int, title string", {"page_number": -1, "title": ""})


_SNIP = "CASE WHEN length(text) <= 200 THEN text WHEN instr(reverse(substring(text, 1, 200)), ' ') > 0 AND 200 - instr(reverse(substring(text, 1, 200)), ' ') > 160 THEN substring(text, 1, 200 - instr(reverse(substring(text, 1, 200)), ' ')) || '...' ELSE substring(text, 1, 200) || '...' END"


@query(f"""WITH h AS (SELECT file_path AS location, text, n_chars / 100000.0::DOUBLE AS score FROM documents WHERE n_chars BETWEEN 300 AND 90000 ORDER BY n_chars DESC, doc_id LIMIT 8), n AS (SELECT *, row_number() OVER (ORDER BY score DESC, location) + 10 AS n FROM h)
SELECT n::INT AS n, '[' || n || '] ' || floor(score * 100)::BIGINT || '% ' || location || E'\\n' || {_SNIP} AS line FROM n""")
def rendered_hits(spark, d):
    """The longest documents as a second page of results."""
    hits = _docs(spark, d).filter("n_chars between 300 and 90000").orderBy(F.col("n_chars").desc(), "doc_id").limit(8)
    return records.rendered(hits.select(F.col("file_path").alias("location"), F.col("text").alias("content"), (F.col("n_chars") / F.lit(100000.0)).alias("score")), offset=10)


@query("""WITH o AS (SELECT label AS run, count(*)::DOUBLE AS throughput, label % 2 AS env FROM embeddings GROUP BY 1), n AS (SELECT label AS run, sum(vec_id % 10)::DOUBLE AS throughput, label % 4 AS env FROM embeddings GROUP BY 1)
SELECT n.run, CASE WHEN n.env = o.env THEN 'compared' ELSE 'different' END AS status, CASE WHEN n.env = o.env THEN round(n.throughput / o.throughput, 3) END AS speed_up FROM n JOIN o USING (run)""")
def benchmark_comparison(spark, d):
    """Labels stand for runs; those whose environment differs are not compared."""
    e = t(spark, d, "embeddings")
    old = e.groupBy(F.col("label").alias("run")).agg(F.count("*").cast("double").alias("throughput")).withColumn("env", F.col("run") % 2)
    new = e.groupBy(F.col("label").alias("run")).agg(F.sum(F.col("vec_id") % 10).cast("double").alias("throughput")).withColumn("env", F.col("run") % 4)
    return records.compared_runs(old, new, ["env"])


@query("""WITH r AS (SELECT label AS run, count(*) / 40.0::DOUBLE AS speed_up, 0.998 + label / 1000.0::DOUBLE AS agreement, CASE WHEN label = 4 THEN NULL ELSE 10.0 * label END AS soak_minutes FROM embeddings GROUP BY 1)
SELECT run, CASE WHEN coalesce(speed_up >= 1.2 AND agreement >= 0.999 AND soak_minutes >= 30, false) THEN 'qualified' ELSE 'experimental' END AS decision FROM r""")
def qualification(spark, d):
    r = t(spark, d, "embeddings").groupBy(F.col("label").alias("run")).agg((F.count("*") / F.lit(40.0)).alias("speed_up"))
    r = r.withColumn("agreement", F.lit(0.998) + F.col("run") / F.lit(1000.0)).withColumn("soak_minutes", F.when(F.col("run") != 4, 10.0 * F.col("run")))
    return records.qualified(r).select("run", "decision")


@query("SELECT DISTINCT id, epoch_us(indexed_at::TIMESTAMP) // 1000 AS ms, strftime(indexed_at::TIMESTAMP, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM dual_documents")
def file_times(spark, d):
    return t(spark, d, "dual_documents").select("id", paths.unix_ms(F.col("indexed_at")).alias("ms"), paths.iso_time(F.col("indexed_at")).alias("iso")).distinct()


@query("WITH f AS (SELECT file_path, count(*) AS n, max(file_size) AS s FROM code_chunks GROUP BY 1) SELECT sum(n)::BIGINT AS n_rows, count(file_path) AS n_files, coalesce(sum(s), 0)::BIGINT AS n_bytes, (SELECT count(DISTINCT git_project_identifier) FROM code_chunks) AS n_projects FROM f")
def store_statistics(spark, d):
    return listings.store_statistics(t(spark, d, "code_chunks"))


@query("SELECT id, file_path FROM dual_documents WHERE file_hash IS NULL OR file_hash NOT IN (SELECT file_hash FROM dual_documents WHERE document_type = 'md' AND file_hash IS NOT NULL)")
def delete_by_content(spark, d):
    r = t(spark, d, "dual_documents").select("id", "file_path", "file_hash", "document_type")
    return dml.delete(r, r.filter("document_type = 'md' and file_hash is not null"), ["file_hash"]).select("id", "file_path")


@query("SELECT doc_id FROM documents WHERE lang = 'fr' ORDER BY doc_id LIMIT 30 OFFSET 20")
def fts_empty_query(spark, d):
    """Without words the search is a scan by the filter in the order of the key."""
    return fulltext.search(_docs(spark, d), "doc_id", "", _settings(), F.col("lang") == "fr", 30, 20).select("doc_id")


@query(f"{_IDX} SELECT doc_id FROM idx WHERE term LIKE 'manifest%' GROUP BY 1 ORDER BY max((term = 'manifest')::INT) DESC, doc_id LIMIT 7")
def fts_hit_cap(spark, d):
    """The settings' cap holds before the page."""
    return fulltext.search(_docs(spark, d), "doc_id", "manifest", _settings(max_total_hits=7, one_typo=99, two_typos=99), limit=20, index=_index(spark, d)).select("doc_id")

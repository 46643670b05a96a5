"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from . import codefiles, encoding, leaks, neardup, neighbours, packing, provenance, scans, syntax, textstats
from .common import latest

QUERIES: dict = {}
SQL: dict[str, str] = {}


_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"


def _grams(table: str, key: str, text: str, n: int, least: int) -> str:
    """SQL for (key, g): the runs of n words of the texts of at least ``least`` words."""
    w = f"SELECT DISTINCT {key}, {_WORDS.format(text)} AS w FROM {table}"
    return f"SELECT DISTINCT {key}, unnest(list_transform(range(1, len(w) - {n - 2}), lambda k: array_to_string(w[k:k + {n - 1}], ' '))) AS g FROM ({w}) WHERE len(w) >= {least}"


SQL["p8_found"] = f"WITH d AS ({_grams('documents', 'doc_id', 'text', 12, 12)}), i AS ({_grams('eval_items', 'item_id', 'text', 12, 12)}) SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (g)"
SQL["p3_found"] = f"""WITH s AS ({_grams('dual_documents', 'id', 'content', 3, 20)}), n AS (SELECT id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2)
SELECT id_a, id_b FROM p JOIN n a ON a.id = id_a JOIN n b ON b.id = id_b WHERE c >= 0.5 * (a.n + b.n - c)"""


#: By brute force. With as few rows as here the operator's blocks hold all of them, so its result is exact.
SQL["p2_found"] = """WITH e AS (SELECT DISTINCT ON (id) id, embedding FROM code_chunks ORDER BY id, indexed_at DESC NULLS LAST), v AS (SELECT id, embedding::DOUBLE[] AS v FROM e WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
r AS (SELECT a.id, b.id AS neighbour_id, row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.v, b.v) DESC) AS k FROM v a JOIN v b ON a.id <> b.id) SELECT id, neighbour_id FROM r WHERE k <= 10"""


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p8_found(spark, d):
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query
def p9_statistics(spark, d):
    return textstats.text_statistics(table(spark, d, "documents"))


@query
def p9_found(spark, d):
    stats = textstats.text_statistics(table(spark, d, "documents"))
    return stats.filter("n_chars >= 80 and kind <> 'prose'").select("doc_id", "kind").distinct()


def _near(spark, d):
    return neardup.similar_nodes(neardup.rows_once(table(spark, d, "dual_documents")), "id", "content", n=3, threshold=0.5, least=20)


@query
def p3_found(spark, d):
    return neardup.similar_pairs(_near(spark, d), "id")


@query
def p3_groups(spark, d):
    return neardup.groups(_near(spark, d), "id")


@query
def p2_found(spark, d):
    chunks = latest(table(spark, d, "code_chunks").select("id", "embedding", "indexed_at"), "id", "indexed_at")
    return neighbours.nearest(chunks, "id", "embedding").select("id", "neighbour_id")


def _encoding(spark, d):
    return encoding.repaired(latest(table(spark, d, "dual_documents").select("id", "content", "indexed_at"), "id", "indexed_at"))


@query
def p5_found(spark, d):
    return _encoding(spark, d).filter("affected").select("id").distinct()


@query
def p5_restored(spark, d):
    """The affected rows with the chain and the text as far as it could be restored."""
    return _encoding(spark, d).filter("affected").select("id", "chain", "restored", F.col("text").alias("content"))


@query
def p7_packed(spark, d):
    return packing.pack(table(spark, d, "documents"))


#: A mixture as a training run may want it: manuals and handbooks up, chat down, the rest of the sources after them.
MIXTURE = {"field-manual": 3.0, "handbook": 3.0, "manual-page": 2.0, "wiki-export": 2.0, "support-desk": 1.0, "chat-session": 0.5}


@query
def p7_mixed(spark, d):
    """The documents packed to target shares."""
    return packing.pack(table(spark, d, "documents"), targets=MIXTURE)


@query
def p7_shares(spark, d):
    """Tokens of each source in each window of the mixture, with its share and target."""
    return packing.mixture(packing.pack(table(spark, d, "documents"), containers=32, targets=MIXTURE), MIXTURE)


def _files(spark, d):
    return codefiles.files(table(spark, d, "code_chunks"))


@query
def p6_found(spark, d):
    return syntax.invalid(syntax.checked(_files(spark, d))).select(*codefiles.FILE)


@query
def p6_files(spark, d):
    """Every invalid file with what is wrong with it."""
    return syntax.invalid(syntax.checked(_files(spark, d)))


@query
def p6_rates(spark, d):
    return syntax.rates(syntax.checked(_files(spark, d)))


@query
def p4_found(spark, d):
    return provenance.not_handwritten(_files(spark, d)).select(*codefiles.FILE).distinct()


@query
def p4_files(spark, d):
    """The same files with what they are."""
    return provenance.not_handwritten(_files(spark, d))


@query
def p1_found(spark, d):
    return scans.repaired(table(spark, d, "dual_documents")).select("id", F.explode("kinds").alias("kind")).distinct()


@query
def p1_repaired(spark, d):
    return scans.repaired(table(spark, d, "dual_documents")).select("id", "text")

"""The registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import extraction, language, lines, neardup, ordermin, packing, pieces, quality, topk, warc
from .shared import crc_of_id, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_packing(spark, sf_dir):
    """Every piece of every document with its place in a 2048-token sequence."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op1_language(spark, sf_dir):
    """The language of every whole document, learned from three quarters of the ids."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_of_id() % 4 == 2, F.lit(False))
    return language.predict(docs, language.train(docs.where(~held_out)), held_out=held_out)


def op3_neardup(spark, sf_dir):
    """Components of documents that share 85 of 100 three-word shingles."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op5_topk(spark, sf_dir):
    """The five best of all vectors for every vector whose id is divisible by 50."""
    vectors = topk.usable(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def op6_pieces(spark, sf_dir):
    """Two distinct sampled segmentations of every whole document, without replacement, with their piece ids."""
    return pieces.sample_segmentations(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_lines(spark, sf_dir):
    """Every document without lines whose template recurs across documents."""
    return lines.drop_recurring(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op8_quality(spark, sf_dir):
    """The quality of every whole document, learned from four fifths of the ids."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(crc_of_id() % 5 == 0, F.lit(False))
    scored = quality.classify(docs, quality.learnable(labels, held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_fingerprints(spark, sf_dir):
    """Order min-hash fingerprints of every whole document and its edited text."""
    return ordermin.fingerprints(table(spark, sf_dir, "documents"))


def op2_warc(spark, sf_dir):
    """Every page written to WARC archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_extraction(spark, sf_dir):
    """The main text of every page."""
    return extraction.extract_pages(table(spark, sf_dir, "pages"))


QUERIES = {"op1_language": op1_language, "op3_neardup": op3_neardup, "op5_topk": op5_topk, "op6_pieces": op6_pieces, "op7_lines": op7_lines, "op8_quality": op8_quality, "op2_warc": op2_warc, "op4_packing": op4_packing, "op9_fingerprints": op9_fingerprints, "op10_extraction": op10_extraction, "pipeline": pipeline}

#: Base32 of the SHA-1: hex digits to bits, bits in fives to letters.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
b AS (SELECT *, list_aggregate(list_transform(range(1, 41), lambda i: right('000' || bin(instr('0123456789abcdef', sha[i]) - 1), 4)), 'string_agg', '') AS bits FROM p),
d AS (SELECT page_id, html, list_aggregate(list_transform(range(0, 32), lambda i:
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * CAST(bits[5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2] AS INT) + 4 * CAST(bits[5 * i + 3] AS INT) + 2 * CAST(bits[5 * i + 4] AS INT) + CAST(bits[5 * i + 5] AS INT)]), 'string_agg', '') AS payload_digest FROM b),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM m
"""

#: Integer components, then every query against every other row.
TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

#: All pairs that share a shingle, counted; components as the closure of the links.
NEARDUP_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
x AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM x a JOIN x b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept FROM s JOIN m USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op2_warc": WARC_SQL, "op5_topk": TOPK_SQL, "op3_neardup": NEARDUP_SQL}

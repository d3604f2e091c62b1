"""Registered queries of this subpackage: one per operator, each over its whole table."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (ann, bitsliced, bpe, html_extraction, lm_scoring, merkle, mixing, quality_model, quality_rules, sharding, simhash, token_files,
               vector_codes)
from .common import documents, shared_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@_register
def op1_lm_scoring(spark, sf_dir):
    return lm_scoring.score(documents(spark, sf_dir), folds=5, held=1)


@_register
def op2_simhash(spark, sf_dir):
    near = simhash.near_duplicates(documents(spark, sf_dir), shingle=3, max_distance=3)
    return near.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                       F.col("component").alias("component_id"), "n_links")


@_register
def op3_nearest_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


@_register
def op4_html_extraction(spark, sf_dir):
    return html_extraction.extract(table(spark, sf_dir, "pages"))


@_register
def op5_mixing(spark, sf_dir):
    units = mixing.mix(documents(spark, sf_dir))
    return units.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
                        "source", F.explode(F.sequence(F.lit(1).cast("long"), "m")).alias("row")).drop("row")


@_register
def op7_token_files(spark, sf_dir):
    path = shared_path(spark, "token-files")
    token_files.write_files(documents(spark, sf_dir), tokenizer_path(), path, end_id=0)
    return token_files.read_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@_register
def op8_quality_classifier(spark, sf_dir):
    s = quality_model.score(documents(spark, sf_dir), table(spark, sf_dir, "labels"), folds=5, held=0)
    return s.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_register
def op9_bpe(spark, sf_dir):
    ids = bpe.encode(documents(spark, sf_dir), tokenizer_path(), keep=("doc_id",), decoded=True)
    return ids.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@_register
def op10_sharding(spark, sf_dir):
    s = sharding.shard_documents(documents(spark, sf_dir), shards=24)
    return s.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"))


@_register
def op6_quality_rules(spark, sf_dir):
    return quality_rules.apply_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _op6_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
    bounds = " AND ".join(f"{r.measure} {op} {v}" for r in quality_rules.RULES
                          for op, v in ((">=", r.least), ("<=", r.most)) if v is not None)
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS s FROM documents),
w AS (SELECT rid, doc_id, s, regexp_extract_all(s, '[^ \t-\r]+') AS w,
             list_filter(string_split(s, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS l FROM t),
win AS (SELECT rid, unnest(range(1, len(w) - 1)) AS p, w FROM w),
win2 AS (SELECT rid, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS x FROM win),
hits AS (SELECT rid, p FROM win2 QUALIFY count(*) OVER (PARTITION BY rid, x) > 1),
cov AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM hits) GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(s, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
  length(regexp_replace(s, '[^!?]', '', 'g')) AS n_marks,
  len(list_filter(w, lambda x: x <> lower(x) AND x = upper(x) AND length(x) > 1)) AS n_upper,
  len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop,
  len(list_filter(l, lambda x: regexp_matches(ltrim(x), '^[-*•]'))) AS n_bullets,
  len(list_filter(l, lambda x: regexp_matches(rtrim(x), '(\.\.\.|…)$'))) AS n_ellipses
  FROM w LEFT JOIN cov USING (rid)),
r AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_length,
  CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio,
  CASE WHEN n_words > 0 THEN n_marks / n_words ELSE 0 END AS mark_ratio,
  CASE WHEN n_words > 0 THEN n_upper / n_words ELSE 0 END AS upper_ratio,
  CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 0 END AS stop_word_ratio,
  CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
  CASE WHEN n_lines > 0 THEN n_bullets / n_lines ELSE 0 END AS bullet_line_ratio,
  CASE WHEN n_lines > 0 THEN n_ellipses / n_lines ELSE 0 END AS ellipsis_line_ratio,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {bounds} AS kept FROM r"""


ORACLES["op6_quality_rules"] = _op6_sql()


@_register
def op11_exact_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return bitsliced.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20, scale=64)


ORACLES["op11_exact_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS z FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.z, r.z)::BIGINT AS score
  FROM v q JOIN v r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 20"""


@_register
def op12_vector_codes(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    coded, books = vector_codes.compress(vectors, parts=4, entries=256, rounds=4, scale=1024, keep=("label",))
    coded = vector_codes.with_totals(coded, F.col("kept")["label"], "error", "label_error")
    return coded.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error",
                        F.lit(books.digest() if books else "").alias("codebooks_sha256"))


def _op12_sql() -> str:
    ctes = ["""v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label,
  list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS z FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
            """p AS MATERIALIZED (SELECT rid, p, z[p * (len(z) // 4) + 1:(p + 1) * (len(z) // 4)] AS y
  FROM v, (SELECT unnest(range(4)) AS p))""",
            """c0 AS MATERIALIZED (SELECT p, e, y AS c FROM p JOIN
  (SELECT rid, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v ORDER BY vec_id LIMIT 256) USING (rid))"""]
    for k in range(5):
        ctes.append(f"""a{k} AS MATERIALIZED (SELECT rid, p, min({{'d': list_inner_product(y, y) - 2 * list_inner_product(y, c)
  + list_inner_product(c, c), 'e': e}}) AS m FROM p JOIN c{k} USING (p) GROUP BY rid, p)""")
        if k < 4:
            ctes.append(f"""s{k} AS (SELECT p, e, list(floor(s / n) ORDER BY i) AS c FROM (SELECT p, m.e AS e, i, sum(y[i]) AS s, count(*) AS n
  FROM a{k} JOIN p USING (rid, p), (SELECT unnest(range(1, (SELECT max(len(y)) FROM p) + 1)) AS i) GROUP BY ALL) GROUP BY p, e)""")
            ctes.append(f"c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(s{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN s{k} USING (p, e))")
    return f"""WITH {", ".join(ctes)},
r AS (SELECT rid, string_agg(lower(lpad(to_hex(m.e), 2, '0')), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a4 GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT::VARCHAR), ','), ',' ORDER BY p, e)) FROM c4) AS codebooks_sha256
FROM r JOIN v USING (rid)"""


ORACLES["op12_vector_codes"] = _op12_sql()


@_register
def op13_merkle_manifest(spark, sf_dir):
    docs = documents(spark, sf_dir)
    fields = {f: F.col(f) for f in merkle.FIELDS}
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    seen = F.when(touched, merkle.leaf_digest(fields | {"text": merkle.ascii_lower(F.col("text"))})).otherwise(merkle.leaf_digest())
    proofs = merkle.prove(docs, carry={"seen": seen})
    return proofs.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"),
                         merkle.folded(F.col("seen"), F.col("proof")).alias("folded_root")) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))


def _op13_sql(levels: int = 8) -> str:
    """Enough levels for 16^8 rows a source and as many sources."""
    fields = " || ".join(f"CASE WHEN {f} IS NULL THEN '-' ELSE strlen({f}::VARCHAR) || ':' || {f}::VARCHAR END" for f in merkle.FIELDS)
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = ["""crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t)""",
            """d AS MATERIALIZED (SELECT row_number() OVER () AS rid, *, coalesce('=' || source, '') AS g, xor(4294967295,
  list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)) % 5 = 0 AS touched FROM documents, crc)""",
            f"""h AS MATERIALIZED (SELECT rid, doc_id, g, sha256({fields}) AS leaf,
  CASE WHEN touched THEN sha256({fields.replace("text", lower)}) ELSE sha256({fields}) END AS seen FROM d)""",
            """n0 AS MATERIALIZED (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS digest,
  count(*) OVER (PARTITION BY g) AS n, rid FROM h)"""]

    def tree(nodes: str) -> None:
        for k in range(levels):
            ctes.append(f"""{nodes}r{k} AS MATERIALIZED (SELECT g, i // 16 AS i, list(digest ORDER BY i) AS l, any_value(n) AS n
  FROM {nodes}{k} GROUP BY g, i // 16)""")
            ctes.append(f"""{nodes}{k + 1} AS MATERIALIZED (SELECT g, i, CASE WHEN n > 1 THEN sha256(array_to_string(l, '')) ELSE l[1] END AS digest,
  (n + 15) // 16 AS n FROM {nodes}r{k})""")

    tree("n")
    ctes.append(f"m0 AS MATERIALIZED (SELECT 0 AS g, row_number() OVER (ORDER BY g) - 1 AS i, digest, count(*) OVER () AS n, g AS s FROM n{levels})")
    tree("m")
    ctes.append("w0 AS (SELECT h.rid, h.doc_id, h.leaf, h.seen AS f, '' AS q, n0.g, n0.i, m0.i AS j, m0.digest AS subroot "
                "FROM h JOIN n0 USING (rid) JOIN m0 ON m0.s = n0.g)")
    at = 0
    for nodes, key, same in (("n", "i", "r.g = w.g"), ("m", "j", "TRUE")):
        for k in range(levels):
            own, left, right = f"(w.{key} // {16 ** k})", "", ""
            left = f"array_to_string(l[1:{own} % 16], '')"
            right = f"array_to_string(l[{own} % 16 + 2:], '')"
            ctes.append(f"""w{at + 1} AS (SELECT rid, doc_id, leaf, CASE WHEN n > 1 THEN sha256({left} || f || {right}) ELSE f END AS f,
  CASE WHEN n > 1 THEN q || {left} || {right} ELSE q END AS q, w.g, w.i, j, subroot
  FROM w{at} w JOIN {nodes}r{k} r ON {same} AND r.i = w.{key} // {16 ** (k + 1)})""")
            at += 1
    return f"""WITH {", ".join(ctes)}
SELECT doc_id, leaf, subroot, (SELECT digest FROM m{levels}) AS root, sha256(q) AS proof_sha256, f AS folded_root,
  f = (SELECT digest FROM m{levels}) AS verified FROM w{at}"""


ORACLES["op13_merkle_manifest"] = _op13_sql()


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

"""The registered queries of this subpackage and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from . import exact_dedup, fim, hyperminhash, language, mixing, packing, ppm, prefix_trie, simhash, suffix_levels, topk, toxicity, wavelet
from .shipping import ship


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ship(configure(spark)).read.parquet(f"{sf_dir}/{table}.parquet")


def op1_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(_read(spark, sf_dir, "documents"), words=2).select("doc_id", "n_shingles", "component_id", "kept")


OP1_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 80 * (x.n + y.n - p.c)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""


def op2_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    shards = wavelet.write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, wavelet.shard_path(spark))
    return wavelet.read_documents(shards)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.dedup(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP4_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
w AS (SELECT doc_id, t, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size FROM n WINDOW g AS (PARTITION BY t))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM w
"""


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"), keep=("doc_id", "source"))
    return mixed.select("doc_id", F.col("__mix.size").alias("size"), F.col("__mix.source_size").alias("source_size"),
                        F.col("__mix.target").alias("target"), F.col("__mix.taken").alias("taken"), "source")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def _remainder(n: int, column: str = "doc_id"):
    """crc32 of an id as text, modulo n; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = language.train(docs, _remainder(3) != 1)
    return language.predict(docs, model).select(
        "doc_id", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"), F.col("__lang.lang").alias("lang_pred"),
        F.col("__lang.score").alias("score"), F.col("__lang.rejected").alias("rejected"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP5_SQL = """
WITH f AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM f q JOIN f c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op8_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_levels.remove_repeats(_read(spark, sf_dir, "documents"))


def op9_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ppm.score(_read(spark, sf_dir, "documents"), _remainder(10) != 0)
    return found.select("doc_id", F.coalesce(_remainder(10) == 0, F.lit(False)).alias("held_out"), *found.columns[1:])


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"), _remainder(5) != 0)
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), F.col("__toxicity").alias("score"),
        (F.col("__toxicity") >= 0.5).cast("int").alias("predicted"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(_read(spark, sf_dir, "documents"))
    back = fim.restored(F.col("fim.output"), F.col("fim.form"))
    return made.select(
        "row.doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", F.sha2("fim.output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
h AS (SELECT doc_id, t, u, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(d, i, 8) AS BIGINT)) AS h FROM u),
c AS (SELECT doc_id, t, n, u, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
s AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256 FROM s
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(_read(spark, sf_dir, "conversations"))


OP13_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS l FROM t GROUP BY conv_id),
h AS (SELECT conv_id, l, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ord(x)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 9 AS h FROM o),
r AS (SELECT h.conv_id, list_concat(coalesce(b.l, [])[1:h], h.l[h + 1:]) AS s FROM h LEFT JOIN o b ON b.conv_id = h.base),
p AS (SELECT conv_id, d, s[1:d] AS k, len(s) AS n FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM r)),
v AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '') AS e FROM p GROUP BY d, k),
c AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n FROM v WHERE d > 0 GROUP BY 1, 2),
f AS (SELECT v.*, coalesce(c.n, 0) AS n_children, CASE WHEN v.d > 0 THEN (v.n_convs - 1) * strlen(v.k[v.d].text) ELSE 0 END AS saved FROM v LEFT JOIN c ON c.d = v.d AND c.k = v.k),
g AS (SELECT a AS d, k[1:a] AS k, sum(saved) AS saved, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM f) GROUP BY 1, 2)
SELECT f.conv_id, f.d AS depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(g.leaves AS BIGINT) AS n_leaves,
    CAST(g.saved AS BIGINT) AS saved_tokens, sha256(f.e) AS ends_sha256
FROM f JOIN g ON g.d = f.d AND g.k = f.k LEFT JOIN v up ON up.d = f.d - 1 AND up.k = f.k[1:f.d - 1]
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hyperminhash": op1_hyperminhash, "op2_wavelet_tokens": op2_wavelet_tokens, "op3_language_id": op3_language_id, "op4_exact_dedup": op4_exact_dedup, "op5_top_k": op5_top_k,
    "op6_mixing": op6_mixing, "op7_packing": op7_packing, "op8_suffix_levels": op8_suffix_levels, "op9_ppm": op9_ppm, "op10_toxicity": op10_toxicity,
    "op11_simhash": op11_simhash, "op12_fill_in_middle": op12_fill_in_middle, "op13_prefix_trie": op13_prefix_trie,
}
ORACLES: dict[str, str] = {"op1_hyperminhash": OP1_SQL, "op4_exact_dedup": OP4_SQL, "op5_top_k": OP5_SQL, "op12_fill_in_middle": OP12_SQL, "op13_prefix_trie": OP13_SQL}

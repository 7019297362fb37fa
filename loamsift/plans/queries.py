"""The queries of the reference's operators over the driver's tables, each with the SQL that checks it where SQL can say it.

Conventions of these queries: golden question number n has the vector of ``embeddings`` with vec_id n modulo 500, and a chunk the one
with the smallest vec_id in ``vector_store``; repeated rows of a table count once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import answers as A
from ..operators import bm25, chunking, dedup, dense, fusion, index, metrics, rerank
from ..sources import golden, loaders
from ..streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "golden_questions").select(F.col("id").alias("query_id"), "category", "question", "answer", "source_sections").dropDuplicates(["query_id"])


def vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions(spark, sf_dir).withColumn("vec_id", F.pmod(F.substring("query_id", 2, 9).cast("long"), F.lit(500)))
    return q.join(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector")), "vec_id").drop("vec_id")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").dropDuplicates(["chunk_id"])


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "vector_store").where("embedding IS NOT NULL")
    return v.groupBy("chunk_id").agg(F.min_by("embedding", "vec_id").alias("embedding"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_results").dropDuplicates(["result_id"])


def tok(x: str) -> str:
    """SQL for the tokens of x."""
    return rf"list_filter(string_split_regex(regexp_replace(lower({x}), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda t: t <> '')"


def without(x: str, stop: list[str]) -> str:
    return f"list_filter({tok(x)}, lambda t: NOT list_contains([{', '.join(repr(w) for w in stop)}], t))"


def sent(x: str) -> str:
    """SQL for the sentences of x."""
    return rf"""list_filter(list_transform(flatten(list_transform(string_split(regexp_replace({x}, '([.!?])\s+([A-Z0-9"''(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: string_split(s, chr(10)))), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"""


# The tables behind most of the SQL.
Q = "q AS (SELECT id AS query_id, any_value(category) AS category, any_value(question) AS question, any_value(answer) AS answer, any_value(source_sections) AS source_sections FROM golden_questions GROUP BY id)"
C = "c AS (SELECT chunk_id, any_value(doc_id) AS doc_id, any_value(content) AS content, any_value(source_file) AS source_file, any_value(section_heading) AS section_heading FROM chunks GROUP BY chunk_id)"
R = "r AS (SELECT DISTINCT ON (result_id) * FROM eval_results)"


def bm25_sql(source: str, key: str, text: str) -> str:
    """SQL of the BM25 ranking of ``source`` for all questions: CTEs up to ``s`` (query_id, key, score, rank), rank up to 20."""
    return f"""{Q},
t AS (SELECT {key} AS k, {tok(text)} AS t FROM {source}),
st AS (SELECT count(*) AS n, avg(coalesce(len(t), 0)) AS avgdl FROM t),
tf AS (SELECT k, dl, token, count(*) AS tf FROM (SELECT k, len(t) AS dl, unnest(t) AS token FROM t) GROUP BY 1, 2, 3),
raw AS (SELECT token, count(*) AS df, ln((SELECT n FROM st) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf GROUP BY 1),
idf AS (SELECT token, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT query_id, token, count(*) AS qn FROM (SELECT query_id, unnest({tok("question")}) AS token FROM q) GROUP BY 1, 2),
hit AS (SELECT query_id, k, sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM st)))) AS score FROM tf JOIN idf USING (token) JOIN qt USING (token) GROUP BY 1, 2),
every AS (SELECT query_id, k, coalesce(score, 0.0) AS score FROM (SELECT query_id, {key} AS k FROM (SELECT DISTINCT query_id FROM qt), {source}) LEFT JOIN hit USING (query_id, k)),
s AS (SELECT * FROM (SELECT query_id, k, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, k) AS rank FROM every) WHERE rank <= 20)"""


def dense_sql(vectors: str, asked: str, limit: int) -> str:
    """SQL of the cosine ranking of (k, v) ``vectors`` for (query_id, v) ``asked``: CTEs up to ``d``."""
    return f"""vv AS (SELECT k, v, sqrt(list_dot_product(v, v)) AS l FROM ({vectors})), qv AS (SELECT query_id, v, sqrt(list_dot_product(v, v)) AS l FROM ({asked})),
d AS (SELECT * FROM (SELECT query_id, k, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, k) AS rank
  FROM (SELECT query_id, k, CASE WHEN vv.l * qv.l = 0 THEN 0.0 ELSE list_dot_product(vv.v, qv.v) / (vv.l * qv.l) END AS score FROM vv, qv)) WHERE rank <= {limit})"""


CHUNK_VECTORS = "SELECT chunk_id AS k, arg_min(embedding, vec_id)::DOUBLE[] AS v FROM vector_store WHERE embedding IS NOT NULL GROUP BY 1"
QUESTION_VECTORS = "SELECT query_id, embedding::DOUBLE[] AS v FROM q JOIN embeddings ON vec_id = substr(query_id, 2)::BIGINT % 500"
FUSED = f"""{bm25_sql("c", "chunk_id", "content")}, {dense_sql(CHUNK_VECTORS, QUESTION_VECTORS, 20)},
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, dr NULLS LAST, sr NULLS LAST) AS rank
  FROM (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.k, s.k) AS k, d.rank AS dr, s.rank AS sr, coalesce(0.7 / (60 + d.rank), 0.0) + coalesce(0.3 / (60 + s.rank), 0.0) AS raw FROM d FULL JOIN s ON d.query_id = s.query_id AND d.k = s.k))"""


def lexical_sql(source: str) -> str:
    """SQL that reranks ``source`` (query_id, k, rank) over the chunks ``c``: CTEs up to ``ranked``."""
    stop = X.RERANK_STOPWORDS
    return f"""qq AS (SELECT query_id, {without("question", stop)} AS qt FROM q), cc AS (SELECT chunk_id AS k, {without("coalesce(content, '')", stop)} AS ct FROM c),
l AS (SELECT query_id, k, rank AS before, CASE WHEN len(qt) > 0 AND len(ct) > 0
  THEN len(list_filter(qt, lambda t: list_contains(ct, t))) / len(qt) + 0.1::DOUBLE * coalesce(list_sum(list_transform(qt, lambda t: len(list_filter(ct, lambda y: y = t)))), 0) ELSE 0.0 END AS score FROM {source} JOIN qq USING (query_id) JOIN cc USING (k)),
ranked AS (SELECT query_id, k, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS rank FROM l)"""


@query(f"SELECT doc_id, len({tok('text')})::INTEGER AS tokens, len(list_distinct({tok('text')}))::INTEGER AS distinct_tokens FROM documents WHERE text IS NOT NULL")
def tokenize_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.tokens("text")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.size(t).alias("tokens"), F.size(F.array_distinct(t)).alias("distinct_tokens"))


@query(f"WITH {bm25_sql('documents', 'doc_id', 'text')} SELECT token, df, round(idf, 6) AS idf FROM idf")
def bm25_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return bm25.term_stats(d, "text").select("token", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {bm25_sql('documents', 'doc_id', 'text')} SELECT query_id, k AS doc_id, round(score, 6) AS score, rank::INTEGER AS rank FROM s WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = bm25.topk(table(spark, sf_dir, "documents"), "doc_id", "text", questions(spark, sf_dir), "query_id", "question", 10)
    return best.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {Q}, {dense_sql(CHUNK_VECTORS, QUESTION_VECTORS, 10)} SELECT query_id, k AS chunk_id, round(score, 4) AS score, rank::INTEGER AS rank FROM d")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.topk(chunk_vectors(spark, sf_dir), "chunk_id", "embedding", vector_questions(spark, sf_dir), "query_id", "vector", 10)


@query(f"WITH {Q}, {dense_sql('SELECT vec_id AS k, embedding::DOUBLE[] AS v FROM embeddings WHERE label = 3', QUESTION_VECTORS, 5)} SELECT query_id, k AS vec_id, round(score, 4) AS score, rank::INTEGER AS rank FROM d")
def dense_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.topk(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", vector_questions(spark, sf_dir), "query_id", "vector", 5, {"label": 3})


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    q = vector_questions(spark, sf_dir)
    d = dense.topk(chunk_vectors(spark, sf_dir), "chunk_id", "embedding", q, "query_id", "vector", 20)
    return d, bm25.topk(chunks(spark, sf_dir), "chunk_id", "content", q, "query_id", "question", 20), q


@query(f"WITH {C}, {FUSED} SELECT query_id, k AS chunk_id, round(raw, 6) AS rrf_score, rank::INTEGER AS rank FROM f")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, s, _ = _lists(spark, sf_dir)
    return fusion.rrf(d, s, "query_id", "chunk_id").select("query_id", "chunk_id", "rrf_score", "rank")


@query(f"WITH {C}, {FUSED}, f20 AS (SELECT query_id, k, rank FROM f WHERE rank <= 20 AND k IN (SELECT chunk_id FROM c)), {lexical_sql('f20')} SELECT query_id, k AS chunk_id, round(score, 6) AS rerank_score, rank::INTEGER AS rank FROM ranked WHERE rank <= 10")
def hybrid_lexical_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, s, q = _lists(spark, sf_dir)
    best = fusion.hybrid(d, s, chunks(spark, sf_dir).withColumn("content", F.coalesce("content", F.lit(""))), q, "query_id", "question", "chunk_id", "content")
    return best.select("query_id", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"), "rank")


@query(f"WITH {C}, {bm25_sql('c', 'chunk_id', 'content')}, {lexical_sql('s')} SELECT query_id, k AS chunk_id, round(score, 6) AS rerank_score, rank::INTEGER AS rank FROM ranked WHERE rank <= 10")
def retrieve_sparse_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, c = questions(spark, sf_dir), chunks(spark, sf_dir).withColumn("content", F.coalesce("content", F.lit("")))
    few = bm25.topk(c, "chunk_id", "content", q, "query_id", "question", 20).join(c.select("chunk_id", "content"), "chunk_id").join(q.select("query_id", "question"), "query_id")
    return rerank.lexical(few, "query_id", "question", "content").where("rank <= 10").select("query_id", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"), "rank")


@query(f"WITH {C} SELECT chunk_id, min(chunk_id) OVER (PARTITION BY content) AS first_key, count(*) OVER (PARTITION BY content) AS copies FROM c WHERE content IS NOT NULL")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_duplicates(chunks(spark, sf_dir), "chunk_id", "content")


VEC = "u AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS l FROM (SELECT DISTINCT vec_id AS id, embedding::DOUBLE[] AS v FROM vector_store WHERE embedding IS NOT NULL) WHERE list_dot_product(v, v) > 0), p AS (SELECT x.id AS a, y.id AS b, round(list_dot_product(x.v, y.v) / (x.l * y.l), 4) AS s FROM u x JOIN u y ON x.id <> y.id WHERE round(list_dot_product(x.v, y.v) / (x.l * y.l), 4) > 0.95)"


@query(f"WITH {VEC} SELECT a, b, s AS similarity FROM p WHERE a < b")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "vector_store").dropDuplicates(["vec_id"])
    return dedup.similar_pairs(v, v, "vec_id", "embedding", 64).where("a < b")


@query(f"""WITH RECURSIVE {VEC}, o AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) AS r FROM (SELECT DISTINCT vec_id FROM vector_store)),
e AS (SELECT o.r, o.id, coalesce((SELECT list(b) FROM p WHERE a = o.id AND b < o.id), []) AS before FROM o),
w AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS kept UNION ALL SELECT e.r, CASE WHEN len(list_intersect(w.kept, e.before)) > 0 THEN w.kept ELSE list_append(w.kept, e.id) END FROM w JOIN e ON e.r = w.r + 1),
k AS (SELECT unnest(kept) AS id FROM (SELECT kept FROM w ORDER BY r DESC LIMIT 1)),
t AS (SELECT a AS id, arg_min(b, (-s, b)) AS duplicate_of, max(s) AS similarity FROM p WHERE b < a AND b IN (SELECT id FROM k) AND a NOT IN (SELECT id FROM k) GROUP BY 1)
SELECT o.id AS vec_id, o.id IN (SELECT id FROM k) AS kept, duplicate_of, similarity AS duplicate_similarity FROM o LEFT JOIN t ON t.id = o.id""")
def near_dup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "vector_store").dropDuplicates(["vec_id"]).withColumn("ord", F.col("vec_id"))
    return dedup.greedy_duplicates(v, "vec_id", "ord", "embedding", 64).select("vec_id", "kept", F.when(~F.col("kept"), F.col("duplicate_of")).alias("duplicate_of"), F.when(~F.col("kept"), F.col("duplicate_similarity")).alias("duplicate_similarity"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "source_files").dropDuplicates(["doc_id"])
    return f.select("doc_id", F.coalesce(F.nullif(F.col("clean_text"), F.lit("")), F.col("raw_content")).alias("text"))


# Blanks as str.strip sees them in these tables, and the texts of the files.
BLANKS = "(chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))"
FILES = "files AS (SELECT doc_id, any_value(CASE WHEN coalesce(clean_text, '') = '' THEN raw_content ELSE clean_text END) AS text FROM source_files GROUP BY 1)"


def heading_sql(prefix: str) -> str:
    """SQL for the last heading among the lines of a text's beginning."""
    line = f"trim(l, {BLANKS})"
    return rf"coalesce(list_last(list_transform(list_filter(string_split({prefix}, chr(10)), lambda l: regexp_matches({line}, '^#{{1,6}}\s+.+$')), lambda l: trim(regexp_extract({line}, '^#{{1,6}}\s+(.+)$', 1), {BLANKS}))), 'Introduction')"


def _last_of(separator: str, size: int) -> str:
    """SQL for where the last ``separator`` of the window w begins, if beyond its half."""
    before = f"length(regexp_extract(w, '(?s)^(.*){separator}', 1))"
    return f"WHEN regexp_matches(w, '(?s)^.*{separator}') AND {before} > {size / 2} THEN start + {before} + {2 if separator != ' ' and separator != chr(92) + 'n' else 1}"


_CUTS = " ".join(_last_of(x, 500) for x in ("\\n\\n", "\\n", "\\. ", "! ", "\\? ", " "))


@query(f"""WITH RECURSIVE {FILES}, t AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t]+', ' ', 'g'), {BLANKS}) AS t FROM files WHERE length(text) > 0),
step AS (SELECT doc_id, t, 0 AS start, substr(t, 1, 500) AS w FROM t WHERE length(t) > 0 UNION ALL
  SELECT doc_id, t, stop - 50, substr(t, stop - 49, 500) FROM (SELECT *, CASE WHEN start + 500 >= length(t) THEN length(t) {_CUTS} ELSE start + 500 END AS stop FROM step) WHERE stop < length(t)),
cut AS (SELECT *, CASE WHEN start + 500 >= length(t) THEN length(t) {_CUTS} ELSE start + 500 END AS stop FROM step),
body AS (SELECT doc_id, t, start, trim(substr(t, start + 1, stop - start), {BLANKS}) AS content FROM cut),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS i FROM body WHERE length(content) >= 50)
SELECT doc_id || '::chunk::' || i AS chunk_id, doc_id, i::INTEGER AS chunk_index, {heading_sql('left(t, start)')} AS section_heading, length(content)::INTEGER AS char_count, start::INTEGER AS char_offset, NULL::INTEGER AS num_sentences, 'fixed' AS chunking_strategy, content FROM n""")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(_files(spark, sf_dir), "doc_id", "text", chunking.ChunkingConfig())


@query(rf"""WITH RECURSIVE {FILES}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM files WHERE length(text) > 0),
h AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{{1,6}}\s+.+$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM l),
s AS (SELECT doc_id, section, string_agg(line, chr(10) ORDER BY pos) AS t, CASE WHEN section > 0 THEN trim(regexp_extract(arg_min(line, pos), '^#{{1,6}}\s+(.+)$', 1), {BLANKS}) ELSE 'Introduction' END AS heading FROM h GROUP BY 1, 2),
b AS (SELECT *, list_transform(string_split(t, chr(10) || chr(10)), lambda x: length(x)) AS parts FROM s WHERE trim(t, {BLANKS}) <> ''),
c AS (SELECT doc_id, section, heading, t, list_transform(range(1, len(parts)), lambda k: list_sum(parts[1:k]) + 2 * (k - 1)) AS breaks FROM b),
step AS (SELECT *, 0 AS start FROM c UNION ALL SELECT doc_id, section, heading, t, breaks, k - 23 FROM (
  SELECT *, CASE WHEN coalesce(m, start + 500) - start < 250 THEN start + 500 ELSE coalesce(m, start + 500) END AS k FROM (SELECT *, list_max(list_filter(breaks, lambda x: x <= start + 500 AND x > start)) AS m FROM step WHERE length(t) - start > 500)) WHERE k - 23 < length(t)),
cut AS (SELECT *, CASE WHEN length(t) - start <= 500 THEN length(t) WHEN coalesce(m, start + 500) - start < 250 THEN start + 500 ELSE coalesce(m, start + 500) END AS k FROM (SELECT *, list_max(list_filter(breaks, lambda x: x <= start + 500 AND x > start)) AS m FROM step)),
piece AS (SELECT doc_id, section, start, heading, substr(t, start + 1, (k - start)::BIGINT) AS content FROM cut),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section, start) - 1 AS i FROM piece WHERE length(content) >= 50 AND trim(content, {BLANKS}) <> '')
SELECT doc_id || '::chunk::' || i AS chunk_id, doc_id, i::INTEGER AS chunk_index, heading AS section_heading, length(content)::INTEGER AS char_count, NULL::INTEGER AS char_offset, NULL::INTEGER AS num_sentences, 'recursive' AS chunking_strategy, content FROM n""")
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(_files(spark, sf_dir), "doc_id", "text", chunking.ChunkingConfig(strategy="recursive"))


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_counts(texts: list[str]) -> list[list[float]]:
    """How often each letter stands in a text: vectors that SQL can make, too."""
    return [[float(t.lower().count(c)) for c in LETTERS] for t in texts]


@query(rf"""WITH RECURSIVE {FILES}, p AS (SELECT doc_id, text, regexp_extract_all(text, '[^.!?]+[.!?]*') AS p, length(regexp_extract(text, '^[.!?]*')) AS lead FROM files WHERE length(text) > 0),
q AS (SELECT doc_id, text, p, list_transform(range(1, len(p) + 1), lambda i: lead + coalesce(list_sum(list_transform(p[1:i - 1], lambda x: length(x))), 0)) AS pos FROM p),
u AS (SELECT doc_id, text, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS x, unnest(pos) AS pos, unnest(list_concat(p[2:], [NULL])) AS y FROM q),
s AS (SELECT doc_id, text, pos, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, trim(CASE WHEN y IS NULL OR regexp_matches(y, '^\s') THEN x ELSE regexp_replace(x, '[.!?]+$', '') END, {BLANKS}) AS s FROM u WHERE trim(CASE WHEN y IS NULL OR regexp_matches(y, '^\s') THEN x ELSE regexp_replace(x, '[.!?]+$', '') END, {BLANKS}) <> ''),
v AS (SELECT *, list_transform(string_split('{' '.join(LETTERS)}', ' '), lambda c: (length(s) - length(replace(lower(s), c, '')))::DOUBLE) AS v FROM s),
w AS (SELECT doc_id, i, 1 AS g, v AS total, length(s) AS chars FROM v WHERE i = 1 UNION ALL
  SELECT v.doc_id, v.i, w.g + n::INTEGER, CASE WHEN n THEN v.v ELSE list_transform(range(1, 27), lambda k: w.total[k] + v.v[k]) END, CASE WHEN n THEN length(v.s) ELSE w.chars + 1 + length(v.s) END
  FROM (SELECT w.*, CASE WHEN list_dot_product(w.total, w.total) * list_dot_product(v.v, v.v) = 0 THEN 0 ELSE list_dot_product(w.total, v.v) / sqrt(list_dot_product(w.total, w.total) * list_dot_product(v.v, v.v)) END < 0.8 AND w.chars >= 50 AS n, v.i AS j FROM w JOIN v ON v.doc_id = w.doc_id AND v.i = w.i + 1) w JOIN v ON v.doc_id = w.doc_id AND v.i = w.j),
g AS (SELECT v.doc_id, g, min(v.i) AS i, string_agg(s, ' ' ORDER BY v.i) AS t, count(*) AS n, any_value(text) AS text, arg_min(pos, v.i) AS pos FROM w JOIN v ON v.doc_id = w.doc_id AND v.i = w.i GROUP BY 1, 2),
m AS (SELECT *, sum(CASE WHEN length(t) >= 50 OR g = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY g) - 1 AS k FROM g),
c AS (SELECT doc_id, k, trim(string_agg(t, ' ' ORDER BY g), {BLANKS}) AS content, sum(n) AS n, any_value(text) AS text, arg_min(pos, g) AS pos FROM m GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i FROM c WHERE length(content) >= 50)
SELECT doc_id || '::chunk::' || i AS chunk_id, doc_id, k::INTEGER AS chunk_index, {heading_sql('left(text, pos::BIGINT)')} AS section_heading, length(content)::INTEGER AS char_count, NULL::INTEGER AS char_offset, n::INTEGER AS num_sentences, 'semantic' AS chunking_strategy, content FROM r""")
def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(_files(spark, sf_dir), "doc_id", "text", chunking.ChunkingConfig(strategy="semantic"), letter_counts)


@query(r"""WITH f AS (SELECT DISTINCT doc_id, CASE WHEN coalesce(clean_text, '') = '' THEN raw_content ELSE clean_text END AS text FROM source_files),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM f WHERE text IS NOT NULL)
SELECT doc_id, line_no::INTEGER AS line_no, len(regexp_extract(line, '^(#{1,6})\s+(.+)$', 1))::INTEGER AS level, trim(regexp_extract(line, '^(#{1,6})\s+(.+)$', 2), E' \t\r') AS heading FROM l WHERE regexp_matches(line, '^(#{1,6})\s+(.+)$')""")
def section_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _files(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    m = r"^(#{1,6})\s+([\s\S]+)$"
    return lines.where(F.col("line").rlike(m)).select("doc_id", "line_no", F.length(F.regexp_extract("line", m, 1)).alias("level"), F.regexp_replace(F.regexp_extract("line", m, 2), r"^[ \t\r]+|[ \t\r]+$", "").alias("heading"))


@query("""WITH c AS (SELECT chunk_id, any_value(doc_id) AS doc_id, any_value(source_file) AS source_file, any_value(chunking_strategy) AS chunking_strategy FROM chunks GROUP BY 1)
SELECT coalesce(doc_id, 'unknown') AS doc_id, arg_min(source_file, chunk_id) AS source_file, count(*) AS chunk_count, array_to_string(list_sort(list_distinct(list(chunking_strategy))), ',') AS strategies FROM c GROUP BY 1""")
def doc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.list_documents(chunks(spark, sf_dir))


@query("SELECT DISTINCT chunk_id, doc_id FROM incoming_chunks WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT chunk_id FROM chunks)")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.insert_if_absent(table(spark, sf_dir, "incoming_chunks"), table(spark, sf_dir, "chunks"), "chunk_id").select("chunk_id", "doc_id")


@query("WITH f AS (SELECT min(doc_id) AS d FROM chunks) SELECT DISTINCT chunk_id, doc_id FROM chunks WHERE doc_id <> (SELECT d FROM f)")
def delete_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    return index.delete_document(c, c.agg(F.min("doc_id")).first()[0]).select("chunk_id", "doc_id")


@query("SELECT *, dense_count = sparse_count AS in_sync FROM (SELECT count(DISTINCT chunk_id) AS dense_count FROM vector_store), (SELECT count(DISTINCT chunk_id) AS sparse_count FROM chunks)")
def sync_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.sync_status(table(spark, sf_dir, "vector_store"), table(spark, sf_dir, "chunks"), "chunk_id")


@query(f"WITH {bm25_sql('documents', 'doc_id', 'text')} SELECT query_id, coalesce(left(replace(trim(regexp_replace(coalesce(text, ''), '<[^>]+>', '', 'g')), chr(10), ' '), 120) || ' [1]', '{A.DECLINE.replace(chr(39), chr(39) * 2)}') AS answer FROM q LEFT JOIN (SELECT * FROM s WHERE rank = 1) USING (query_id) LEFT JOIN documents ON doc_id = k")
def extractive_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, q = table(spark, sf_dir, "documents"), questions(spark, sf_dir)
    return A.extractive(bm25.topk(d, "doc_id", "text", q, "query_id", "question", 1).join(d.select("doc_id", "text"), "doc_id"), q, "query_id", "text")


@query(f"""WITH {C}, {bm25_sql("c", "chunk_id", "content")},
b AS (SELECT query_id, rank, '<context id="' || rank || '">' || chr(10) || 'Reference ' || rank || '. ([Source: ' || coalesce(source_file, 'unknown') || ']' || CASE WHEN length(section_heading) > 0 THEN ' | heading: ' || section_heading ELSE '' END || ')' || chr(10) || trim(coalesce(content, ''), ' ') || chr(10) || '</context>' AS block FROM s JOIN c ON chunk_id = k WHERE rank <= 3)
SELECT query_id, '{A.INTRO}' || chr(10) || chr(10) || coalesce((SELECT string_agg(block, chr(10) ORDER BY rank) FROM b WHERE b.query_id = q.query_id), '{A.NO_CONTEXT}') AS context FROM q""")
def grounded_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, q = chunks(spark, sf_dir), questions(spark, sf_dir)
    ranked = bm25.topk(c, "chunk_id", "content", q, "query_id", "question", 3).join(c.select("chunk_id", "content", "source_file", "section_heading"), "chunk_id")
    return A.messages(ranked, q, "query_id", "question", "content", "source_file", "section_heading").select("query_id", "context")


@query(rf"""WITH {R}, s AS (SELECT result_id, unnest(s) AS claim, generate_subscripts(s, 1) - 1 AS sentence_pos FROM (SELECT result_id, {sent("generated_answer")} AS s FROM r)),
n AS (SELECT result_id, sentence_pos, claim, regexp_extract_all(claim, '\[(\d+)\]', 1) AS n FROM s)
SELECT result_id, sentence_pos::INTEGER AS sentence_pos, (generate_subscripts(n, 1) - 1)::INTEGER AS cite_pos, unnest(n)::INTEGER AS number, claim FROM n""")
def citation_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.citations(results(spark, sf_dir), "result_id", "generated_answer")


@query(rf"""WITH {R}, s AS (SELECT result_id, {sent("coalesce(generated_answer, '')")} AS s FROM r)
SELECT result_id, round(CASE WHEN len(s) > 0 THEN len(list_filter(s, lambda x: regexp_matches(x, '\[\d+\]'))) / len(s) ELSE 0.0 END, 6) AS coverage FROM s""")
def citation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).withColumn("generated_answer", F.coalesce("generated_answer", F.lit(""))).select("result_id", F.round(A.coverage("generated_answer"), 6).alias("coverage"))


@query(rf"""WITH {R}, n AS (SELECT result_id, unnest(regexp_extract_all(generated_answer, '\[(\d+)\]', 1))::INTEGER AS n FROM r)
SELECT result_id, count(*) AS total, 0::BIGINT AS supported, count_if(n <> 1) AS unsupported, 0.0::DOUBLE AS accuracy FROM n GROUP BY 1""")
def citation_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a judge: the golden answer is block 1, every other number was not provided."""
    r = results(spark, sf_dir)
    v = A.verify(A.citations(r, "result_id", "generated_answer"), r.select("result_id", F.lit(1).alias("rank"), "golden_answer"), "result_id", "golden_answer")
    return A.citation_report(v, "result_id")


COMPLETE = f"""CASE WHEN trim(coalesce(generated_answer, '')) = '' THEN 0.0 WHEN contains(lower(generated_answer), 'i don''t have enough information') OR contains(lower(generated_answer), 'i don''t know') THEN 0.1
  WHEN coalesce(len(qt), 0) = 0 THEN 1.0 ELSE len(list_filter(qt, lambda t: list_contains(a, t))) / len(qt) END"""
CONFIDENCE = rf"""{R}, t AS (SELECT *, {without("question", X.CONFIDENCE_STOPWORDS)} AS qt, {without("generated_answer", X.CONFIDENCE_STOPWORDS)} AS a, {sent("coalesce(generated_answer, '')")} AS s FROM r),
k AS (SELECT *, {COMPLETE} AS complete, CASE WHEN len(s) > 0 THEN len(list_filter(s, lambda x: regexp_matches(x, '\[\d+\]'))) / len(s) ELSE 0.0 END AS covered FROM t),
conf AS (SELECT *, 0.4 * greatest(0.0, least(1.0, coalesce(retrieval_relevance, 0.0))) + 0.3 * covered + 0.3 * complete AS confidence FROM k)"""


def _confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results(spark, sf_dir)
    cov = r.withColumn("generated_answer", F.coalesce("generated_answer", F.lit("")))
    c = A.composite(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("retrieval_relevance", F.lit(0.0)))), A.coverage("generated_answer"), A.completeness("question", "generated_answer"))
    return cov.withColumn("confidence", c)


@query(f"WITH {CONFIDENCE} SELECT result_id, round(confidence, 6) AS confidence FROM conf")
def confidence_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _confidence(spark, sf_dir).select("result_id", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {CONFIDENCE} SELECT coalesce(category, 'unknown') AS category, count_if(confidence >= 0.5) AS answered, count_if(confidence < 0.5) AS declined FROM conf GROUP BY 1")
def confidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _confidence(spark, sf_dir).withColumn("ok", A.can_answer("confidence", 0.5))
    return c.groupBy(F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.count_if("ok").alias("answered"), F.count_if(~F.col("ok")).alias("declined"))


@query(rf"""WITH {R}, f AS (SELECT *, trim(regexp_replace(coalesce(golden_answer, ''), '\s+', ' ', 'g')) AS g FROM r),
t AS (SELECT result_id, {without("question", X.CONFIDENCE_STOPWORDS)} AS q, regexp_extract_all(lower(coalesce(generated_answer, '')), '[a-z0-9]+') AS a, lower(left(g, 120) || CASE WHEN length(g) > 120 THEN '...' ELSE '' END) AS found FROM f)
SELECT result_id, array_to_string(list_filter(q, lambda t: NOT list_contains(a, t) AND NOT contains(found, t)), ' ') AS gaps FROM t""")
def answer_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results(spark, sf_dir).withColumn("found", F.array(A.snippet("golden_answer")))
    return r.select("result_id", F.array_join(A.gaps("question", "generated_answer", "found"), " ").alias("gaps"))


@query(f"""WITH {C}, {bm25_sql("c", "chunk_id", "content")}, {lexical_sql("s")},
d AS (SELECT query_id, coalesce(doc_id, source_file, 'unknown') AS doc_id, max(score) AS score, min(rank) AS seen FROM ranked JOIN c ON chunk_id = k WHERE rank <= 10 GROUP BY 1, 2)
SELECT query_id, doc_id, round(score, 6) AS score, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS place FROM d) WHERE place <= 3""")
def candidate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, c = questions(spark, sf_dir), chunks(spark, sf_dir).withColumn("content", F.coalesce("content", F.lit("")))
    few = bm25.topk(c, "chunk_id", "content", q, "query_id", "question", 20).join(c.select("chunk_id", "content", "doc_id", "source_file"), "chunk_id").join(q.select("query_id", "question"), "query_id")
    none = F.lit(None).cast("double")
    ranked = rerank.lexical(few, "query_id", "question", "content").where("rank <= 10").withColumn("rrf_score", none).withColumn("dense_score", none)
    return A.candidate_documents(ranked, "query_id", "doc_id", "source_file").select("query_id", "doc_id", F.round("score", 6).alias("score"), "place")


def ev(x: str) -> str:
    return f"list_distinct({without(f'coalesce({x}, {chr(39) * 2})', X.EVAL_STOPWORDS)})"


DECLINED = "(" + " OR ".join("contains(lower(coalesce(generated_answer, '')), '" + p.replace("'", "''") + "')" for p in X.DECLINES) + ")"


@query(f"""WITH {R}, t AS (SELECT *, {ev("golden_answer")} AS g, {ev("generated_answer")} AS a FROM r),
j AS (SELECT *, len(list_intersect(g, a)) / len(list_distinct(list_concat(g, a))) AS j FROM t)
SELECT result_id, round(CASE WHEN len(g) = 0 THEN 1.0 WHEN len(a) = 0 THEN 0.0 WHEN category = 'no_answer' THEN CASE WHEN {DECLINED} THEN 1.0 ELSE least(j + 0.2, 0.5) END ELSE j END, 6) AS score FROM j""")
def metric_correctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).select("result_id", F.round(metrics.correctness("category", "golden_answer", "generated_answer"), 6).alias("score"))


@query(f"""WITH {R}, s AS (SELECT result_id, lower(coalesce(golden_answer, '')) AS c, {sent("coalesce(generated_answer, '')")} AS s FROM r),
e AS (SELECT result_id, c, unnest(s) AS x FROM s), t AS (SELECT result_id, c, {ev("x")} AS t FROM e),
g AS (SELECT result_id, avg(CASE WHEN len(t) = 0 OR len(list_filter(t, lambda y: contains(c, y))) / len(t) >= 0.4 THEN 1.0 ELSE 0.0 END) AS score FROM t GROUP BY 1)
SELECT result_id, round(coalesce(score, 1.0), 6) AS score FROM r LEFT JOIN g USING (result_id)""")
def metric_faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).select("result_id", F.round(metrics.faithfulness("generated_answer", "golden_answer"), 6).alias("score"))


@query(f"""WITH {R}, {Q}, t AS (SELECT result_id, lower(coalesce(generated_answer, '')) AS c, {ev("golden_answer")} AS g, source_sections AS s FROM r JOIN q ON query_id = question_id)
SELECT result_id, round(CASE WHEN c = '' THEN 0.0 ELSE 0.5 * CASE WHEN coalesce(len(s), 0) = 0 THEN 1.0 ELSE len(list_filter(s, lambda x: contains(c, lower(x)))) / len(s) END
  + 0.5 * CASE WHEN len(g) = 0 THEN 1.0 ELSE len(list_filter(g, lambda x: contains(c, x))) / len(g) END END, 6) AS score FROM t""")
def metric_retrieval_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results(spark, sf_dir).join(questions(spark, sf_dir).select(F.col("query_id").alias("question_id"), "source_sections"), "question_id")
    return r.select("result_id", F.round(metrics.retrieval_relevance("golden_answer", "source_sections", "generated_answer"), 6).alias("score"))


@query(rf"""WITH {R}, t AS (SELECT result_id, category, len(regexp_extract_all(coalesce(generated_answer, ''), '\[\d+\]')) AS n FROM r)
SELECT result_id, CASE WHEN category = 'no_answer' THEN CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END WHEN n = 0 THEN CASE WHEN category = 'ambiguous' THEN 1.0 ELSE 0.5 END ELSE 0.5 END::DOUBLE AS score FROM t""")
def metric_citation_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).select("result_id", metrics.citation_accuracy("category", "generated_answer").alias("score"))


LONG = f"""{R}, l AS (SELECT strategy, coalesce(category, 'unknown') AS category, unnest(['correctness', 'faithfulness', 'retrieval_relevance', 'citation_accuracy']) AS metric, unnest([correctness, faithfulness, retrieval_relevance, citation_accuracy]) AS score FROM r),
g AS (SELECT strategy, category, metric, round(round(coalesce(avg(score), 0), 10) + 1e-11, 4) AS mean, round(round(coalesce(median(score), 0), 10) + 1e-11, 4) AS median, round(round(coalesce(min(score), 0), 10) + 1e-11, 4) AS min, round(round(coalesce(max(score), 0), 10) + 1e-11, 4) AS max, count(score) AS n FROM l GROUP BY GROUPING SETS ((strategy, metric), (strategy, category, metric))),
m AS (SELECT strategy, metric, mean FROM g WHERE category IS NULL)"""


@query(f"WITH {LONG} SELECT * FROM g")
def eval_report_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.report(results(spark, sf_dir))


@query(f"WITH {LONG}, b AS (SELECT *, max(mean) OVER (PARTITION BY metric) AS best FROM m) SELECT metric, max(best) AS best, string_agg(strategy, '+' ORDER BY mean DESC, strategy) AS winner FROM b WHERE abs(mean - best) <= 0.01 + 1e-9 GROUP BY 1")
def strategy_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.winners(metrics.strategy_means(results(spark, sf_dir)))


@query(f"WITH {LONG}, s AS (SELECT strategy, sum(mean) / 4 AS average FROM m GROUP BY 1) SELECT strategy, round(average, 6) AS average, (row_number() OVER (ORDER BY average DESC, strategy))::INTEGER AS place FROM s")
def strategy_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.overall(metrics.strategy_means(results(spark, sf_dir)))


@query(f"WITH {LONG} SELECT category, metric, strategy AS winner, mean FROM (SELECT *, row_number() OVER (PARTITION BY category, metric ORDER BY mean DESC, strategy) AS p FROM g WHERE category IS NOT NULL) WHERE p = 1")
def category_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.category_winners(metrics.report(results(spark, sf_dir)))


@query(f"WITH {LONG}, p AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY mean DESC, strategy) AS p FROM m) SELECT x.metric, x.strategy AS winner, y.strategy AS runner_up, round((x.mean - y.mean) / nullif(y.mean, 0) * 100, 1) AS gain_percent FROM p x LEFT JOIN p y ON x.metric = y.metric AND y.p = 2 WHERE x.p = 1")
def strategy_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.gains(metrics.strategy_means(results(spark, sf_dir)))


@query(f"WITH {R} SELECT strategy, count(*) AS questions, count_if(error IS NOT NULL) AS errors FROM r GROUP BY 1")
def eval_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.errors(results(spark, sf_dir))


@query("""WITH k AS (SELECT unnest(['lookup', 'multi_hop', 'no_answer', 'ambiguous']) AS category), n AS (SELECT category, count(*) AS n FROM golden_questions GROUP BY 1)
SELECT category, coalesce(n, 0) AS n FROM k LEFT JOIN n USING (category) UNION ALL SELECT 'total', count(*) FROM golden_questions""")
def golden_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden.counts(table(spark, sf_dir, "golden_questions"))


@query("""WITH i AS (SELECT id, unnest(list_filter([CASE WHEN trim(coalesce(id, '')) = '' THEN 'empty id' END, CASE WHEN category IS NULL OR category NOT IN ('lookup', 'multi_hop', 'no_answer', 'ambiguous') THEN 'bad category' END,
  CASE WHEN trim(coalesce(question, '')) = '' THEN 'empty question' END, CASE WHEN trim(coalesce(answer, '')) = '' THEN 'empty answer' END,
  CASE WHEN category IN ('lookup', 'multi_hop') AND coalesce(len(source_documents), 0) = 0 THEN 'missing source documents' END, CASE WHEN category IN ('lookup', 'multi_hop') AND coalesce(len(source_sections), 0) = 0 THEN 'missing source sections' END,
  CASE WHEN category = 'no_answer' AND len(source_documents) > 0 THEN 'unexpected source documents' END], lambda x: x IS NOT NULL)) AS issue FROM golden_questions)
SELECT * FROM i UNION ALL SELECT id, 'duplicate id' FROM golden_questions WHERE trim(coalesce(id, '')) <> '' GROUP BY id HAVING count(*) > 1""")
def golden_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden.validate(table(spark, sf_dir, "golden_questions"))


@query("SELECT id, category = 'lookup' AS is_lookup, category = 'multi_hop' AS is_multi_hop, category = 'no_answer' AS is_no_answer, category = 'ambiguous' AS is_ambiguous FROM golden_questions")
def golden_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden.flags(table(spark, sf_dir, "golden_questions")).select("id", "is_lookup", "is_multi_hop", "is_no_answer", "is_ambiguous")


@query("SELECT id, question FROM golden_questions WHERE category = 'multi_hop'")
def golden_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden.select(table(spark, sf_dir, "golden_questions"), "multi_hop").select("id", "question")


@query(f"""WITH {LONG}, s AS (SELECT strategy, round(sum(mean) / 4, 6) AS average FROM m GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY average DESC, strategy) AS place FROM s),
one AS (SELECT * FROM p WHERE place = 1), two AS (SELECT * FROM p WHERE place = 2),
gg AS (SELECT string_agg(x.metric || ' by ' || format('{{:.1f}}', (x.mean - y.mean) / y.mean * 100) || ' %', ' and ' ORDER BY x.metric) AS gains FROM m x, m y WHERE x.metric = y.metric AND x.strategy = (SELECT strategy FROM one) AND y.strategy = (SELECT strategy FROM two) AND x.metric IN ('correctness', 'faithfulness') AND x.mean > y.mean)
SELECT one.strategy AS winner, one.average AS winner_average, two.strategy AS runner_up, two.average AS runner_up_average,
  one.strategy || ' leads ' || two.strategy || CASE WHEN gains IS NULL THEN ' on average' ELSE ' in ' || gains END || ': ' || format('{{:.2f}}', one.average) || ' to ' || format('{{:.2f}}', two.average) AS summary FROM one, two, gg""")
def strategy_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.comparison(metrics.strategy_means(results(spark, sf_dir)))


@query("SELECT chunk_id, doc_id, coalesce(any_value(section_heading), '') AS section_heading, any_value(char_count) AS char_count, coalesce(any_value(content), '') AS content FROM chunks GROUP BY 1, 2")
def metadata_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.sanitize(chunks(spark, sf_dir).select("chunk_id", "doc_id", "section_heading", "char_count", "content", F.array("doc_id").alias("list"), F.create_map("doc_id", "doc_id").alias("map")))


SHARES = rf"""{R}, n AS (SELECT result_id, n.claim, n.number FROM (SELECT result_id, claim, unnest(regexp_extract_all(claim, '\[(\d+)\]', 1))::INTEGER AS number FROM (SELECT result_id, unnest({sent("generated_answer")}) AS claim FROM r)) n),
v AS (SELECT result_id, number, len(list_intersect(list_distinct(regexp_extract_all(lower(claim), '[a-z]{{4,}}')), list_distinct(regexp_extract_all(lower(coalesce(golden_answer, '')), '[a-z]{{4,}}')))) >= 3 AS good FROM n JOIN r USING (result_id))"""


def shares_words(claim: str, source: str) -> str:
    """A judge that SQL can be, too: a claim is supported by a source with which it shares three words of at least four letters."""
    import re

    words = lambda t: set(re.findall("[a-z]{4,}", (t or "").lower()))
    return "SUPPORTED" if len(words(claim) & words(source)) >= 3 else "UNSUPPORTED"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results(spark, sf_dir)
    v = A.verify(A.citations(r, "result_id", "generated_answer"), r.select("result_id", F.lit(1).alias("rank"), "golden_answer"), "result_id", "golden_answer", shares_words)
    return A.citation_report(v, "result_id")


@query(f"WITH {SHARES} SELECT result_id, count(*) AS total, count_if(number = 1 AND good) AS supported, count_if(NOT (number = 1 AND good)) AS unsupported, round(count_if(number = 1 AND good) / count(*), 4) AS accuracy FROM v GROUP BY 1")
def citation_verify_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a judge: the golden answer is block 1."""
    return _judged(spark, sf_dir)


@query(rf"""WITH {SHARES}, t AS (SELECT result_id, round(count_if(number = 1 AND good) / count(*), 4) AS accuracy FROM v GROUP BY 1), a AS (SELECT result_id, category, len(regexp_extract_all(coalesce(generated_answer, ''), '\[\d+\]')) AS n FROM r)
SELECT result_id, CASE WHEN category = 'no_answer' THEN CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END WHEN n = 0 THEN CASE WHEN category = 'ambiguous' THEN 1.0 ELSE 0.5 END ELSE coalesce(accuracy, 0.5) END::DOUBLE AS score FROM a LEFT JOIN t USING (result_id)""")
def metric_citation_accuracy_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results(spark, sf_dir).join(_judged(spark, sf_dir), "result_id", "left")
    return r.select("result_id", metrics.citation_accuracy("category", "generated_answer", F.col("total"), F.col("accuracy")).alias("score"))


def grade_by_length(prompt: str) -> str:
    """A judge that SQL can be, too: replies in several forms, by the length of the answer in the prompt."""
    answer = prompt.split("\n\nAnswer:\n", 1)[1].rsplit("\n\n", 1)[0] if "\n\nAnswer:\n" in prompt else ""
    n = len(answer)
    return (f'{{"score": {n % 13 / 10}}}', f"{n % 10 / 10} I think", "no number at all", "-0.5", ".8", f'{{"grounded": [true, {"true" if n % 2 else "false"}]}}')[n % 6]


GRADE = """CASE n % 6 WHEN 0 THEN least(1.0, n % 13 / 10) WHEN 1 THEN n % 10 / 10 WHEN 2 THEN {default} WHEN 3 THEN 0.0 WHEN 4 THEN 0.8 ELSE {listed} END"""


@query(f"""WITH {R}, t AS (SELECT result_id, length(coalesce(generated_answer, '')) AS n, coalesce(len({sent("coalesce(generated_answer, '')")}), 0) AS claims FROM r)
SELECT result_id, round({GRADE.format(default='0.5', listed='(1 + n % 2) / 2')}, 6) AS correctness, round(CASE WHEN claims = 0 THEN 1.0 ELSE {GRADE.format(default='0.0', listed='CASE WHEN claims = 1 THEN 1.0 ELSE (1 + n % 2) / claims END')} END, 6) AS faithfulness FROM t""")
def judge_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results(spark, sf_dir).withColumn("context", F.coalesce("golden_answer", F.lit("")))
    scores = metrics.judge_scores("question", "golden_answer", "generated_answer", "context", grade_by_length)
    return r.select("result_id", F.round(scores["correctness"], 6).alias("correctness"), F.round(scores["faithfulness"], 6).alias("faithfulness"))


def complete_by_length(prompt: str) -> str:
    n = len(prompt.split("\n\nAnswer: ", 1)[1])
    return ("none", f'Here: {{"score": {n % 13 / 10}, "reason": "r"}}', '{"reason": "no score"}', "{not json}")[n % 4]


@query(f"WITH {R}, t AS (SELECT result_id, length(coalesce(generated_answer, '')) AS n FROM r) SELECT result_id, CASE WHEN n % 4 = 1 THEN least(1.0, n % 13 / 10) ELSE 0.0 END::DOUBLE AS completeness FROM t")
def completeness_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).select("result_id", A.completeness_judged("question", "generated_answer", complete_by_length).alias("completeness"))


def _as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source files as ``binaryFile`` gives them."""
    f = table(spark, sf_dir, "source_files").dropDuplicates(["doc_id"])
    raw = F.encode(F.coalesce("raw_content", F.lit("")), "UTF-8")
    return f.select(F.col("source_path").alias("path"), F.timestamp_micros((F.col("last_modified") * 1000000).cast("long")).alias("modificationTime"), F.octet_length(raw).cast("long").alias("length"), raw.alias("content"))


# What the loaders make of a file: line ends, front matter, and sections by the kind of the file.
LOADED = rf"""f AS (SELECT DISTINCT ON (doc_id) source_path AS path, replace(replace(coalesce(raw_content, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS raw, octet_length(encode(coalesce(raw_content, ''))) AS bytes FROM source_files),
e AS (SELECT *, lower(regexp_extract(path, '\.[^./]*$')) AS ext FROM f),
m AS (SELECT *, CASE WHEN ext IN ('.md', '.markdown') AND regexp_matches(raw, '(?s)^---[ \t]*\n(.*?)\n---[ \t]*(\n|$)') THEN trim(regexp_replace(raw, '(?s)^---[ \t]*\n(.*?)\n---[ \t]*(\n|$)', ''), {BLANKS}) ELSE raw END AS text FROM e)"""


@query(rf"""WITH {LOADED}, s AS (SELECT path, ext, text, bytes, CASE WHEN ext = '.txt' THEN len(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(x, {BLANKS}) <> ''))
  WHEN ext IN ('.md', '.markdown') THEN len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^#{{1,6}}\s+.+$'))) + CASE WHEN trim(regexp_extract(chr(10) || text, '(?s)^(.*?)(\n#{{1,6}}\s+[^\n]|$)', 1), {BLANKS}) <> '' THEN 1 ELSE 0 END END AS sections FROM m)
SELECT left(md5(path), 12) AS doc_id, regexp_extract(path, '[^/]+$') AS source_file, ext AS file_extension, bytes::BIGINT AS file_size_bytes, CASE WHEN ext <> '.html' THEN length(text)::INTEGER END AS chars, CASE WHEN ext <> '.html' THEN sections::INTEGER END AS sections, NULL::VARCHAR AS error FROM s""")
def load_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All source files through the loaders; of HTML files SQL doesn't tell the text."""
    plain = F.col("file_extension") != ".html"
    d = loaders.parse_files(_as_files(spark, sf_dir))
    return d.select("doc_id", "source_file", "file_extension", "file_size_bytes", F.when(plain, F.length("clean_text")).alias("chars"), F.when(plain, F.size("sections")).alias("sections"), "error")


@query(rf"""WITH {LOADED}, l AS (SELECT path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM m WHERE ext IN ('.md', '.markdown')),
h AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{{1,6}}\s+.+$') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY pos) AS k FROM l),
s AS (SELECT path, k, trim(string_agg(line, chr(10) ORDER BY pos), {BLANKS}) AS content, arg_min(line, pos) AS head FROM h GROUP BY 1, 2)
SELECT left(md5(path), 12) AS doc_id, (row_number() OVER (PARTITION BY path ORDER BY k) - 1)::INTEGER AS chunk_index, CASE WHEN k > 0 THEN trim(regexp_extract(head, '^#{{1,6}}\s+(.+)$', 1), {BLANKS}) END AS section_heading, CASE WHEN k > 0 THEN length(regexp_extract(head, '^(#+)', 1)) ELSE 0 END::INTEGER AS heading_level, length(content)::INTEGER AS char_count FROM s WHERE content <> ''""")
def load_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of the Markdown files."""
    d = loaders.parse_files(_as_files(spark, sf_dir)).where(F.col("file_extension").isin(".md", ".markdown"))
    return loaders.sections(d).select("doc_id", "chunk_index", "section_heading", "heading_level", "char_count")


@query(r"""WITH f AS (SELECT DISTINCT ON (doc_id) source_path AS path, front_matter FROM source_files WHERE front_matter IS NOT NULL)
SELECT left(md5(path), 12) AS doc_id, unnest(map_keys(front_matter)) AS name, unnest(map_values(front_matter)) AS value FROM f""")
def load_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the loaders read as front matter."""
    d = loaders.parse_files(_as_files(spark, sf_dir)).where(F.col("file_extension").isin(".md", ".markdown"))
    return d.select("doc_id", F.explode("metadata").alias("name", "value"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals by the hour, as the stream counts them."""
    w = ingest.windowed_arrivals(table(spark, sf_dir, "events"), "ts", "event_type")
    return w.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n")


@query(f"WITH {bm25_sql('documents', 'doc_id', 'text')} SELECT query_id, coalesce(left(replace(trim(regexp_replace(coalesce(text, ''), '<[^>]+>', '', 'g')), chr(10), ' '), 200) || ' [1]', '{A.DECLINE.replace(chr(39), chr(39) * 2)}') AS answer FROM q LEFT JOIN (SELECT * FROM s WHERE rank = 1) USING (query_id) LEFT JOIN documents ON doc_id = k")
def default_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stub of the comparison: 200 characters of the best document."""
    d, q = table(spark, sf_dir, "documents"), questions(spark, sf_dir)
    return A.extractive(bm25.topk(d, "doc_id", "text", q, "query_id", "question", 1).join(d.select("doc_id", "text"), "doc_id"), q, "query_id", "text", 200)


@query(f"WITH {C}, {bm25_sql('c', 'chunk_id', 'content')}, {lexical_sql('s')} SELECT query_id, k AS chunk_id, round(score, 6) AS rerank_score, rank::INTEGER AS rank FROM ranked WHERE rank <= 3")
def rerank_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, c = questions(spark, sf_dir), chunks(spark, sf_dir).withColumn("content", F.coalesce("content", F.lit("")))
    few = bm25.topk(c, "chunk_id", "content", q, "query_id", "question", 20).join(c.select("chunk_id", "content"), "chunk_id").join(q.select("query_id", "question"), "query_id")
    return rerank.limited(rerank.lexical, few, "query_id", "question", "content", 3).select("query_id", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"), "rank")


@query(f"WITH {C} SELECT doc_id, count(*) AS n FROM c GROUP BY 1")
def chunk_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks each document has in the store."""
    return index.list_documents(chunks(spark, sf_dir)).select("doc_id", F.col("chunk_count").alias("n"))


def _reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best chunks of each question by the sparse index and the lexical reranker."""
    q, c = questions(spark, sf_dir), chunks(spark, sf_dir).withColumn("content", F.coalesce("content", F.lit("")))
    few = bm25.topk(c, "chunk_id", "content", q, "query_id", "question", 20).join(c.select("chunk_id", "content", "source_file"), "chunk_id").join(q.select("query_id", "question"), "query_id")
    none = F.lit(None).cast("double")
    return rerank.lexical(few, "query_id", "question", "content").where("rank <= 10").withColumn("rrf_score", none).withColumn("dense_score", none)


@query(f"WITH {C}, {bm25_sql('c', 'chunk_id', 'content')}, {lexical_sql('s')} SELECT query_id, round(greatest(0.0, least(1.0, avg(score))), 6) AS confidence FROM ranked WHERE rank <= 10 GROUP BY 1")
def retrieval_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(spark, sf_dir).groupBy("query_id").agg(F.round(A.retrieval_confidence(A.chunk_score()), 6).alias("confidence"))


@query(rf"""WITH {C}, {bm25_sql('c', 'chunk_id', 'content')}, {lexical_sql('s')},
found AS (SELECT query_id, rank, trim(regexp_replace(coalesce(content, ''), '\s+', ' ', 'g'), ' ') AS t, source_file FROM ranked JOIN c ON chunk_id = k WHERE rank <= 4)
SELECT query_id, string_agg(left(t, 120) || CASE WHEN length(t) > 120 THEN '...' ELSE '' END || CASE WHEN length(source_file) > 0 THEN ' (from ' || source_file || ')' ELSE '' END, chr(10) ORDER BY rank) AS found FROM found GROUP BY 1""")
def decline_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a declined answer tells that was found."""
    return A.findings(_reranked(spark, sf_dir), "query_id", "content", "source_file").select("query_id", F.array_join("found", "\n").alias("found"))

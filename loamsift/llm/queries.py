"""The queries of this subpackage, by problem, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import history, knn, languages, leak, neardup, packing, pairs, residue, split


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _splits(spark: SparkSession, sf_dir: str, with_text: bool) -> DataFrame:
    files = table(spark, sf_dir, "source_files")
    if with_text:
        files = files.select("doc_id", "clean_text", "raw_content").dropDuplicates(["doc_id"])
    files = files.select("doc_id", F.when(F.coalesce(F.col("clean_text"), F.lit("")) == "", F.col("raw_content")).otherwise(F.col("clean_text")).alias("text"))
    return split.split_texts(files, "doc_id", "text", table(spark, sf_dir, "chunking_config"), with_text)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files longer than a configuration's size, and whether a cut inside a run without blanks was forced."""
    return _splits(spark, sf_dir, False).select("doc_id", "config_id", "forced").distinct()


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces themselves; a repeated file gives its pieces once."""
    each = _splits(spark, sf_dir, True)
    return each.select("doc_id", "config_id", F.posexplode(F.arrays_zip("starts", "ends", "texts")).alias("piece", "p")).select("doc_id", "config_id", "piece", F.col("p.starts").alias("begin"), F.col("p.ends").alias("end"), F.col("p.texts").alias("text"))


def p1_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the pieces of a file: where the last one ends, and how many are too long, leave a gap, overlap by more than was asked for, or differ from the text at their place."""
    c = table(spark, sf_dir, "chunking_config").select("config_id", "chunk_size", "chunk_overlap")
    files = table(spark, sf_dir, "source_files").select("doc_id", F.when(F.coalesce(F.col("clean_text"), F.lit("")) == "", F.col("raw_content")).otherwise(F.col("clean_text")).alias("whole")).dropDuplicates(["doc_id"])
    p = _splits(spark, sf_dir, True).join(F.broadcast(c), "config_id").join(files, "doc_id")
    at = lambda i, s, e: F.struct(s.alias("s"), e.alias("e"), F.when(i > 0, F.element_at("ends", i.cast("int"))).otherwise(0).alias("before"))
    rows = p.withColumn("x", F.zip_with(F.sequence(F.lit(0), F.size("starts") - 1), F.arrays_zip("starts", "ends"), lambda i, y: at(i, y["starts"], y["ends"])))
    many = lambda f: F.size(F.filter("x", f)).cast("long")
    wrong = F.size(F.filter(F.arrays_zip("starts", "ends", "texts"), lambda y: F.substring(F.col("whole"), y["starts"] + 1, y["ends"] - y["starts"]) != y["texts"])).cast("long")
    return rows.select("doc_id", "config_id", F.element_at("ends", -1).cast("long").alias("length"), many(lambda y: y["e"] - y["s"] > F.col("chunk_size")).alias("too_long"), many(lambda y: y["s"] > y["before"]).alias("gaps"), many(lambda y: (y["before"] - y["s"] > F.col("chunk_overlap"))).alias("overlapping"), wrong.alias("other_text"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors of which one is among the five nearest of the other, with a cosine of at least 0.9."""
    near = knn.nearest_vectors(table(spark, sf_dir, "vector_store"), "vec_id", "embedding")
    return near.select(F.least("id", "other").alias("vec_a"), F.greatest("id", "other").alias("vec_b")).distinct()


def p2_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest others of each vector whose vec_id is divisible by 20, at any cosine."""
    v = table(spark, sf_dir, "vector_store")
    near = knn.nearest_of_queries(v, v.where(F.col("vec_id") % 20 == 0), "vec_id", "embedding")
    return near.select(F.col("id").alias("vec_id"), F.col("other").alias("neighbor"), F.round("cosine", 4).alias("cosine"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks with a similarity of at least 0.6."""
    return neardup.near_duplicate_pairs(table(spark, sf_dir, "chunks"), "chunk_id", "content").select(F.col("chunk_id_a").alias("chunk_a"), F.col("chunk_id_b").alias("chunk_b")).distinct()


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk with its class of equal shingle sets and the number of other classes like it."""
    return neardup.near_duplicate_groups(table(spark, sf_dir, "chunks"), "chunk_id", "content")


def _forest(spark: SparkSession, sf_dir: str) -> history.Forest:
    """The accepted chunks as a forest: the only time that their texts are read."""
    forest = history.Forest(spark)
    forest.append(table(spark, sf_dir, "chunks"), "chunk_id", "content")
    return forest


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming chunks with the accepted chunks that they repeat; all that comes in is one batch, the last one to this forest."""
    _, m = history.match_batch(_forest(spark, sf_dir), table(spark, sf_dir, "incoming_chunks"), "chunk_id", "content", "seq", append=False)
    return m.select(F.least("new", "old").alias("chunk_a"), F.greatest("new", "old").alias("chunk_b")).distinct()


def p5_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``duplicates`` of each new upload: how many of its rows were matched to an accepted chunk. The batches come one after another, each to the stored forest."""
    incoming, forest = table(spark, sf_dir, "incoming_chunks"), _forest(spark, sf_dir)
    batches = incoming.groupBy("batch_no").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).orderBy("lo").collect()
    # Rows are decided in the order of seq: batches that overlap in it are one.
    spans: list[list[int]] = []
    for r in batches:
        if spans and r.lo <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], r.hi)
        else:
            spans.append([r.lo, r.hi])
    decided = [history.match_batch(forest, incoming.where(F.col("seq").between(lo, hi)), "chunk_id", "content", "seq")[0] for lo, hi in spans]
    d = reduce(DataFrame.unionByName, decided)
    counts = d.join(incoming.select("seq", "doc_id"), "seq").groupBy("doc_id").agg(F.count_if(F.col("status") == "duplicate").alias("duplicates"), F.count_if(F.col("status") == "accepted").alias("accepted"))
    fresh = table(spark, sf_dir, "ingest_responses").where(F.col("duplicates").isNull()).select("doc_id", "batch_no")
    return fresh.join(counts, "doc_id", "left").select("doc_id", "batch_no", F.coalesce("duplicates", F.lit(0)).alias("duplicates"), F.coalesce("accepted", F.lit(0)).alias("accepted"))


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in containers of every capacity; a document has one token per UTF-8 byte and an end token."""
    return packing.pack(table(spark, sf_dir, "documents"), "doc_id", F.octet_length("text") + 1, table(spark, sf_dir, "pack_capacity"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that had to be split."""
    return p6_packing(spark, sf_dir).where("pieces > 1").select("capacity_id", "doc_id").distinct()


def p6_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used for each capacity, the least number that could do, those of best-fit-decreasing, and how full they are."""
    p = p6_packing(spark, sf_dir).groupBy("capacity_id").agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    c = table(spark, sf_dir, "pack_capacity")
    counts = {r[0]: r[1] for r in packing.sizes_of(table(spark, sf_dir, "documents"), "doc_id", F.octet_length("text") + 1).groupBy("size").count().collect()}
    plain = spark.createDataFrame([(r[0], packing.best_fit_decreasing(counts, r[1])) for r in c.select("capacity_id", "capacity_tokens").collect()], "capacity_id int, bfd int")
    return p.join(c, "capacity_id").join(plain, "capacity_id").select("capacity_id", "containers", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("bound"), "bfd", F.round(F.col("tokens") / F.col("capacity_tokens") / F.col("containers"), 4).alias("fill"))


def p6_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the packing: the documents and tokens placed for each capacity, none placed twice, no container above it, and no document split that fits."""
    p = p6_packing(spark, sf_dir).join(table(spark, sf_dir, "pack_capacity"), "capacity_id")
    boxes = p.groupBy("capacity_id", "container").agg(F.sum("tokens").alias("t"), F.first("capacity_tokens").alias("c")).groupBy("capacity_id").agg(F.count_if(F.col("t") > F.col("c")).alias("too_full"))
    docs = p.groupBy("capacity_id", "doc_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.first("pieces").alias("pieces"), F.first("capacity_tokens").alias("c"))
    d = docs.groupBy("capacity_id").agg(F.count("*").alias("documents"), F.sum("t").alias("tokens"), F.count_if(F.col("n") != F.ceil(F.col("t") / F.col("c"))).alias("split_otherwise"))
    return d.join(boxes, "capacity_id")


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages of test items, exact or near."""
    return leak.leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "golden_questions"), "id", ["question", "answer"]).withColumnRenamed("id", "question_id")


def p7_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact leaks with the longest run of words that document and item share."""
    return p7_leaks(spark, sf_dir).where(F.col("kind") == "exact").select("doc_id", "question_id", "words")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least 12 consecutive words of a question or answer."""
    return p7_leaks(spark, sf_dir).where(F.col("kind") == "exact").select("doc_id", "question_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that are no proper answers, with their defect. The language profiles are trained on a bounded sample of the labelled documents."""
    profiles = languages.train(table(spark, sf_dir, "documents"), "text", "lang")
    return pairs.flag_pairs(table(spark, sf_dir, "eval_results"), "result_id", "question", "golden_answer", "generated_answer", profiles).distinct()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with unfilled template parts, filler, error messages or script notices."""
    return p8_residue(spark, sf_dir).select("doc_id").distinct()


def p8_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the kind of residue."""
    return residue.find_residue(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p1_checked": p1_checked,
    "p2_found": p2_found,
    "p2_neighbors": p2_neighbors,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_duplicates": p5_duplicates,
    "p6_found": p6_found,
    "p6_packing": p6_packing,
    "p6_usage": p6_usage,
    "p6_checked": p6_checked,
    "p7_found": p7_found,
    "p7_runs": p7_runs,
    "p7_leaks": p7_leaks,
    "p8_found": p8_found,
    "p8_residue": p8_residue,
}

#: Sets of three-word sequences of ``{table}``, a row per sequence, and their sizes.
SHINGLES = """
w_{t} AS (SELECT DISTINCT chunk_id, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table} WHERE content IS NOT NULL {where}),
s_{t} AS (SELECT DISTINCT chunk_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w_{t} WHERE len(w) >= 3),
n_{t} AS (SELECT chunk_id, count(*) AS n FROM s_{t} GROUP BY 1)"""


def shingle_sql(t: str, table: str, where: str = "") -> str:
    return SHINGLES.format(t=t, table=table, where=where)


#: The usable vectors, once each.
UNIT = """e AS (SELECT DISTINCT vec_id AS id, embedding::DOUBLE[] AS v FROM vector_store WHERE embedding IS NOT NULL),
u AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS l FROM e WHERE list_dot_product(v, v) > 0)"""

#: The greedy choice among the incoming rows; ``final`` holds the keys that are accepted.
DECIDED = f"""WITH RECURSIVE {shingle_sql("c", "chunks")},
firsts AS (SELECT chunk_id, min(seq) AS seq FROM incoming_chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks) GROUP BY 1),
{shingle_sql("i", "incoming_chunks", "AND seq IN (SELECT seq FROM firsts)")},
old AS (SELECT x.chunk_id AS a, y.chunk_id AS b FROM s_i x JOIN s_c y ON x.s = y.s JOIN n_i p ON p.chunk_id = x.chunk_id JOIN n_c q ON q.chunk_id = y.chunk_id
  GROUP BY 1, 2, p.n, q.n HAVING count(*) >= 0.6 * (p.n + q.n - count(*))),
new AS (SELECT x.chunk_id AS a, y.chunk_id AS b FROM s_i x JOIN s_i y ON x.s = y.s AND x.chunk_id <> y.chunk_id JOIN n_i p ON p.chunk_id = x.chunk_id JOIN n_i q ON q.chunk_id = y.chunk_id
  JOIN firsts f ON f.chunk_id = x.chunk_id JOIN firsts g ON g.chunk_id = y.chunk_id WHERE g.seq < f.seq
  GROUP BY 1, 2, p.n, q.n HAVING count(*) >= 0.6 * (p.n + q.n - count(*))),
ranked AS (SELECT chunk_id, row_number() OVER (ORDER BY seq) AS r FROM firsts),
before AS (SELECT r.r, r.chunk_id, (SELECT count(*) FROM old WHERE a = r.chunk_id) AS hits, (SELECT coalesce(list(b), []) FROM new WHERE a = r.chunk_id) AS earlier FROM ranked r),
walk AS (SELECT 0::BIGINT AS r, []::VARCHAR[] AS accepted
  UNION ALL
  SELECT b.r, CASE WHEN b.hits > 0 OR len(list_intersect(walk.accepted, b.earlier)) > 0 THEN walk.accepted ELSE list_append(walk.accepted, b.chunk_id) END
  FROM walk JOIN before b ON b.r = walk.r + 1),
final AS (SELECT unnest(accepted) AS chunk_id FROM (SELECT accepted FROM walk ORDER BY r DESC LIMIT 1))"""

SQL: dict[str, str] = {
    "p1_found": """WITH t AS (SELECT DISTINCT doc_id, CASE WHEN coalesce(clean_text, '') = '' THEN raw_content ELSE clean_text END AS text FROM source_files),
l AS (SELECT doc_id, length(text) AS n, list_max(list_transform(regexp_split_to_array(text, '[ \\t\\r\\n]'), lambda x: length(x))) AS run FROM t WHERE text IS NOT NULL)
SELECT doc_id, config_id, CASE WHEN run > chunk_size THEN 1 ELSE 0 END::INTEGER AS forced FROM l JOIN chunking_config ON n > chunk_size""",
    "p1_checked": """WITH t AS (SELECT DISTINCT doc_id, CASE WHEN coalesce(clean_text, '') = '' THEN raw_content ELSE clean_text END AS text FROM source_files)
SELECT doc_id, config_id, length(text) AS length, 0::BIGINT AS too_long, 0::BIGINT AS gaps, 0::BIGINT AS overlapping, 0::BIGINT AS other_text FROM t JOIN chunking_config ON length(text) > chunk_size""",
    "p2_found": f"""WITH {UNIT},
near AS (SELECT x.id AS a, y.id AS b, list_dot_product(x.v, y.v) / (x.l * y.l) AS c FROM u x JOIN u y ON x.id <> y.id),
top AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS r FROM near)
SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM top WHERE r <= 5 AND c >= 0.9""",
    "p2_neighbors": f"""WITH {UNIT},
near AS (SELECT x.id AS a, y.id AS b, list_dot_product(x.v, y.v) / (x.l * y.l) AS c FROM u x JOIN u y ON x.id <> y.id WHERE x.id % 20 = 0),
top AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS r FROM near)
SELECT a AS vec_id, b AS neighbor, round(c, 4) AS cosine FROM top WHERE r <= 5""",
    "p3_found": f"""WITH {shingle_sql("c", "chunks")},
hits AS (SELECT x.chunk_id AS a, y.chunk_id AS b, count(*) AS k FROM s_c x JOIN s_c y ON x.s = y.s AND x.chunk_id < y.chunk_id GROUP BY 1, 2)
SELECT a AS chunk_a, b AS chunk_b FROM hits JOIN n_c p ON p.chunk_id = a JOIN n_c q ON q.chunk_id = b WHERE k >= 0.6 * (p.n + q.n - k)""",
    "p3_groups": f"""WITH {shingle_sql("c", "chunks")},
l AS (SELECT chunk_id, list(s ORDER BY s) AS l, count(*) AS n FROM s_c GROUP BY 1),
g AS (SELECT chunk_id, min(chunk_id) OVER (PARTITION BY l) AS class_id, count(*) OVER (PARTITION BY l) AS copies FROM l),
r AS (SELECT s_c.* FROM s_c WHERE chunk_id IN (SELECT class_id FROM g)),
hits AS (SELECT x.chunk_id AS a, y.chunk_id AS b, count(*) AS k FROM r x JOIN r y ON x.s = y.s AND x.chunk_id <> y.chunk_id GROUP BY 1, 2),
links AS (SELECT a, count(*) AS links FROM hits JOIN n_c p ON p.chunk_id = a JOIN n_c q ON q.chunk_id = b WHERE k >= 0.6 * (p.n + q.n - k) GROUP BY 1)
SELECT chunk_id, class_id, copies, coalesce(links, 0) AS links FROM g LEFT JOIN links ON a = class_id""",
    "p5_found": f"""{DECIDED},
m AS (SELECT a, b FROM old UNION SELECT a, b FROM new WHERE b IN (SELECT chunk_id FROM final))
SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b FROM m""",
    "p5_duplicates": f"""{DECIDED},
d AS (SELECT doc_id, seq, i.chunk_id IN (SELECT chunk_id FROM final) AS good FROM incoming_chunks i JOIN firsts USING (chunk_id, seq)),
t AS (SELECT doc_id, count_if(NOT good) AS duplicates, count_if(good) AS accepted FROM d GROUP BY 1)
SELECT r.doc_id, r.batch_no, coalesce(t.duplicates, 0) AS duplicates, coalesce(t.accepted, 0) AS accepted FROM ingest_responses r LEFT JOIN t USING (doc_id) WHERE r.duplicates IS NULL""",
    "p6_found": """SELECT DISTINCT capacity_id, doc_id FROM documents, pack_capacity WHERE strlen(text) + 1 > capacity_tokens""",
    "p6_checked": """SELECT capacity_id, count(*) AS documents, sum(n)::BIGINT AS tokens, 0::BIGINT AS split_otherwise, 0::BIGINT AS too_full
FROM (SELECT doc_id, max(strlen(text) + 1) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1), pack_capacity GROUP BY 1""",
    "p7_found": """WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
q AS (SELECT DISTINCT id, regexp_extract_all(lower(unnest([question, answer])), '[\\p{L}\\p{N}]+') AS w FROM golden_questions),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM d WHERE len(w) >= 12),
qg AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM q WHERE len(w) >= 12)
SELECT DISTINCT doc_id, id AS question_id FROM dg JOIN qg USING (g)""",
    # Runs of twelve words are joined to longer ones where they follow each other in both texts.
    "p7_runs": """WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
q AS (SELECT id, part, regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+') AS w FROM (SELECT DISTINCT id, question || answer AS part, unnest([question, answer]) AS t FROM golden_questions)),
dg AS (SELECT doc_id, unnest(range(1, len(w) - 10)) AS i, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM d WHERE len(w) >= 12),
qg AS (SELECT DISTINCT id, md5(array_to_string(w, ' ')) AS part, unnest(range(1, len(w) - 10)) AS j, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM q WHERE len(w) >= 12),
h AS (SELECT DISTINCT doc_id, id, part, i, j FROM dg JOIN qg USING (g)),
r AS (SELECT doc_id, id, i - row_number() OVER (PARTITION BY doc_id, id, part, i - j ORDER BY i) AS run, part, i - j AS diagonal FROM h),
n AS (SELECT doc_id, id, count(*) + 11 AS words FROM r GROUP BY doc_id, id, part, diagonal, run)
SELECT doc_id, id AS question_id, max(words)::INTEGER AS words FROM n GROUP BY 1, 2""",
}

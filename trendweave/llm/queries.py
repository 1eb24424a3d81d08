"""The registered corpus queries and, where SQL can express one, its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, hard_negatives, language_id, near_dedup, packing, quality_model, quality_rules, secret_scan, source_mix, spelling_variants, suffix_dedup, token_files, url_templates


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_read(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(_read(spark, sf_dir, "documents")))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents")))


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"), percent=85)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_documents(_read(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digests(_read(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(_read(spark, sf_dir, "documents"))
    return packed.withColumn("ids_crc32", packing.ids_crc32("ids", "length")).drop("ids")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge_urls(_read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "template")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_counts(_read(spark, sf_dir, "documents"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_languages(_read(spark, sf_dir, "documents"))


def _worn(doc_id: Column, run: Column) -> Column:
    """The contract's runs: one in 31, by a checksum of id and run, has lost a letter."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    k = (h % F.length(run)).cast("int")
    return F.when(h % 31 == 0, F.concat(F.substring(run, F.lit(1), k), F.substring(run, k + 2, F.length(run)))).otherwise(run)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.group_variants(spelling_variants.count_words(_read(spark, sf_dir, "documents"), change=_worn))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine_negatives(moved, F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality_model": op4_quality_model,
    "op5_near_dedup": op5_near_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_token_files": op7_token_files,
    "op8_packing": op8_packing,
    "op9_url_filter": op9_url_filter,
    "op10_source_mix": op10_source_mix,
    "op11_language_id": op11_language_id,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents),
h AS (SELECT doc_id, points, sha256(body) AS text_sha256 FROM t)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM h
WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
""",
    "op9_url_filter": r"""
WITH u AS (
  SELECT row_number() OVER () AS rid, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (
  SELECT rid, page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
rules(verdict, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fit AS (
  SELECT rid, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS says
  FROM h JOIN rules ON (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp) GROUP BY rid),
s AS (
  SELECT h.*, fit.rule, fit.says, list_filter(string_split(path, '/'), lambda x: x <> '') AS every FROM h LEFT JOIN fit USING (rid)),
d AS (
  SELECT rid, host, i AS depth, every[i] AS seg, regexp_replace(every[i], '[0-9]+', '#', 'g') AS shape,
         array_to_string(list_transform(every[1:i - 1], lambda x: regexp_replace(x, '[0-9]+', '#', 'g')), '/') AS prefix
  FROM (SELECT *, unnest(range(1, len(every) + 1)) AS i FROM s)),
n AS (
  SELECT rid, depth, seg, shape, count(*) OVER (PARTITION BY host, depth, prefix) AS p,
         count(*) OVER (PARTITION BY host, depth, prefix, shape) AS sn, count(*) OVER (PARTITION BY host, depth, prefix, seg) AS l FROM d),
names AS (
  SELECT rid, list(CASE WHEN l >= 5 AND l >= 0.02::DOUBLE * p THEN seg WHEN sn >= 5 AND sn >= 0.02::DOUBLE * p THEN shape ELSE '*' END ORDER BY depth) AS names FROM n GROUP BY rid),
t AS (
  SELECT s.*, coalesce(names.names, []::VARCHAR[]) AS names FROM s LEFT JOIN names USING (rid)),
nodes AS (SELECT rid, host, says, depth, array_to_string(names[1:depth], '/') AS node, CASE WHEN depth > 0 THEN array_to_string(names[1:depth - 1], '/') END AS parent FROM (SELECT *, unnest(range(0, len(names) + 1)) AS depth FROM t)),
tree AS (SELECT host, depth, node, parent, count(says)::DOUBLE AS n, count(CASE WHEN says = 'block' THEN 1 END)::DOUBLE AS b FROM nodes GROUP BY ALL),
beside AS (
  SELECT c.*, CASE WHEN c.n > 0 AND abs(c.b - c.n * (p.b / nullif(p.n, 0))) > 1.96::DOUBLE * sqrt(c.n * (p.b / nullif(p.n, 0)) * (1.0::DOUBLE - p.b / nullif(p.n, 0))) THEN CASE WHEN c.b > c.n * (p.b / p.n) THEN 1 ELSE -1 END END AS side
  FROM tree c LEFT JOIN tree p ON p.host = c.host AND p.depth = c.depth - 1 AND p.node = c.parent),
sides AS (SELECT host, depth, parent, side, sum(n) AS sn, sum(b) AS sb FROM beside WHERE side IS NOT NULL GROUP BY ALL),
merged AS (
  SELECT beside.host, beside.depth, node, CASE WHEN alike THEN sn ELSE n END AS labelled, CASE WHEN alike THEN sb ELSE b END AS blocked
  FROM (SELECT beside.*, sn, sb, coalesce(NOT abs(b - n * (sb / sn)) > 1.96::DOUBLE * sqrt(n * (sb / sn) * (1.0::DOUBLE - sb / sn)), false) AS alike
        FROM beside LEFT JOIN sides ON sides.host = beside.host AND sides.depth = beside.depth AND sides.parent = beside.parent AND sides.side = beside.side) beside),
counted AS (SELECT rid, depth, labelled, blocked FROM nodes JOIN merged USING (host, depth, node)),
prior AS (SELECT (count(CASE WHEN says = 'block' THEN 1 END) + 1)::DOUBLE / (count(says) + 2) AS p0 FROM t),
lines AS (
  SELECT rid, list_prepend({'n': -1.0::DOUBLE, 'b': any_value(p0)}, list({'n': labelled::DOUBLE, 'b': blocked::DOUBLE} ORDER BY depth)) AS line FROM counted, prior GROUP BY rid),
judged AS (
  SELECT rid, list_reduce(line, lambda a, x: {'n': -1.0::DOUBLE, 'b': CASE WHEN x.n > 0 AND abs(x.b - x.n * a.b) > 1.96::DOUBLE * sqrt(x.n * a.b * (1.0::DOUBLE - a.b)) THEN (x.b + 4.0::DOUBLE * a.b) / (x.n + 4.0::DOUBLE) ELSE a.b END}).b AS purity FROM lines)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN purity >= 0.7::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict,
       host || '/' || array_to_string(names, '/') AS template
FROM t JOIN judged USING (rid)
""",
    "op10_source_mix": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':mix') AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
r AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(source_size * 3) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS others,
         row_number() OVER o AS turn
  FROM w WINDOW o AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST)),
v AS (SELECT *, (total - capped)::DOUBLE / others::DOUBLE AS level FROM r),
f AS (SELECT arg_min(level, turn) AS level FROM v WHERE level * weight <= source_size * 3),
t AS (SELECT source, source_size, least((source_size * 3)::DOUBLE, f.level * weight) AS target FROM v, f),
b AS (SELECT greatest(1, least(64, coalesce(sum(floor(target + 0.5)::BIGINT), 0)::BIGINT // 65536))::BIGINT AS block FROM t),
e AS (SELECT source, floor(target + 0.5)::BIGINT AS words, (floor(target + 0.5)::BIGINT + block - 1) // block AS n FROM t, b WHERE floor(target + 0.5) > 0),
g AS (SELECT source, sum(n) OVER (ORDER BY source NULLS LAST) AS hi, sum(n) OVER (ORDER BY source NULLS LAST) - n AS lo FROM e),
m AS (SELECT coalesce(sum(n), 0)::BIGINT AS m FROM e),
step AS (SELECT m, min(x) AS step FROM (SELECT m, unnest(range((m::HUGEINT * 1327217885 // 2147483648)::BIGINT, (m::HUGEINT * 1327217885 // 2147483648)::BIGINT + 1000)) AS x FROM m) WHERE gcd(x, m) = 1 GROUP BY m),
points AS (SELECT i, (i::HUGEINT * step % m)::BIGINT AS v FROM (SELECT unnest(range(m)) AS i, step, m FROM step)),
slots AS (SELECT source, i AS position, row_number() OVER (PARTITION BY source ORDER BY i) - 1 AS k FROM points JOIN g ON v >= lo AND v < hi),
given AS (SELECT t.source, t.source_size, t.target, b.block, floor(t.target + 0.5)::BIGINT AS words FROM t, b),
p AS (
  SELECT d.*, given.source_size, given.target, given.block, given.words,
         (sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS a
  FROM d JOIN given ON d.source IS NOT DISTINCT FROM given.source),
q AS (SELECT p.*, epoch, a + epoch * source_size AS f, greatest(0, least(size, words - a - epoch * source_size)) AS part FROM p, range(3) x(epoch)),
r3 AS (
  SELECT rid, doc_id, source, size, source_size, target, sum(part)::BIGINT AS taken, any_value(a // block) AS kf,
         sum(CASE WHEN part > 0 THEN (f + part - 1) // block - f // block + 1 ELSE 0 END)::BIGINT AS n_slots FROM q GROUP BY ALL)
SELECT doc_id, size, source_size, target, taken, coalesce(position, -1)::BIGINT AS first_position, n_slots
FROM r3 LEFT JOIN slots ON taken > 0 AND slots.source IS NOT DISTINCT FROM r3.source AND slots.k = kf
""",
    "op12_spelling_variants": r"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END)) AS t),
runs AS (
  SELECT id, run, count(*) AS times FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents) GROUP BY ALL),
hashed AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195, ord(c)::BIGINT - 64] END))),
         lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8)), 4294967295) AS h FROM runs, tab),
words AS (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS v FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.v = b.v AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.v = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.v = b.word),
best AS (SELECT word, count(*) OVER (PARTITION BY word) AS n_near, near, m, row_number() OVER (PARTITION BY word ORDER BY m DESC, near) AS k FROM pairs),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * w.n THEN near END AS form, CASE WHEN m >= 10 * w.n THEN m END AS form_n
  FROM words w LEFT JOIN (SELECT * FROM best WHERE k = 1) b ON b.word = w.word),
chain AS (
  SELECT word, coalesce(form, word) AS last FROM formed
  UNION ALL SELECT chain.word, formed.form FROM chain JOIN formed ON formed.word = chain.last WHERE formed.form IS NOT NULL),
depth AS (SELECT chain.word, last FROM chain JOIN formed ON formed.word = chain.last WHERE formed.form IS NULL)
SELECT formed.word, form, depth.last AS root, n, n_near, form_n FROM formed JOIN depth ON depth.word = formed.word
""",
    "op13_hard_negatives": r"""
WITH e AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.rid AS anchor, a.vec_id AS anchor_id, a.label = e.label AS same, e.rid, e.vec_id, list_inner_product(a.v, e.v)::BIGINT AS score
  FROM e a, e WHERE a.vec_id % 100 = 0 AND a.rid <> e.rid),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, rid) AS k FROM s WHERE same) WHERE k <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.rid ORDER BY s.score DESC, s.vec_id, s.rid) AS rank,
         s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
""",
}

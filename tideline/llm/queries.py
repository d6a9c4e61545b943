"""The operators' queries over whole tables, under the columns that their contracts name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, lines, mixing, packing, quality, ranked, simhash, spans, token_files, topk, toxicity, trie, winnowing
from .common import Scratch, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lines.dedup_lines(docs, Scratch(spark, "lines")).select("doc_id", "text", "n_lines", "removed")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_table(spark, table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), Scratch(spark, "mixing")).select("doc_id", "source", "tokens", "weight", "block", "position", "copy")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, Scratch(spark, "topk"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "simhash"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.learn(docs, ratings(spark, sf_dir)))
    return scored.select("doc_id", "expected_grade", "p_good", "p_toxic", quality.accepted().alias("keep"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", quality.grade(F.col("toxic"), F.col("quality")).alias("grade"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.dedup_spans(table(spark, sf_dir, "documents"), Scratch(spark, "spans")).select("doc_id", "text", "n_sentences", "n_removed", "removed")


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edited_likeness(table(spark, sf_dir, "documents"), Scratch(spark, "winnowing"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)))
    model = langid.learn(docs.where("not held_out and doc_id is not null"))
    return langid.predict(docs, model).select("doc_id", "held_out", "lang_pred", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "ranked")
    index = ranked.build(table(spark, sf_dir, "documents"), scratch)
    return ranked.search(index, table(spark, sf_dir, "benchmark"), scratch)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"), Scratch(spark, "trie"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    net = toxicity.learn(docs, table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.score(docs.withColumn("held_out", held_out), net).select("doc_id", "held_out", "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_packing, op2_line_dedup, op3_token_files, op4_mixing, op5_topk, op6_simhash, op7_quality, op8_substring_dedup, op9_winnowing, op10_language, op11_ranked_search, op12_prefix_trie, op13_toxicity]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op5_topk": OP5_SQL, "op8_substring_dedup": OP8_SQL, "op11_ranked_search": OP11_SQL, "op12_prefix_trie": OP12_SQL}


OP5_SQL = """
WITH good AS (
  SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.own AS own, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0))), 0) AS BIGINT) AS score
  FROM good q JOIN good c ON q.own <> c.own
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

OP11_SQL = r"""
WITH words AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
d AS (SELECT row, doc_id, len(ws) AS n, unnest(list_transform(ws, lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term FROM words WHERE len(ws) > 0),
total AS (SELECT count(DISTINCT row) AS docs, count(*) AS terms FROM d),
tf AS (SELECT row, doc_id, n, term, count(*) AS tf FROM d GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, total GROUP BY term, docs),
q AS (SELECT own, item_id, term, count(*) AS qtf FROM (
  SELECT own, item_id, unnest(list_transform(ws, lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term
  FROM (SELECT row_number() OVER () AS own, item_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM benchmark)) GROUP BY ALL),
scored AS (SELECT own, item_id, row, doc_id, CAST(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term), total GROUP BY own, item_id, row, doc_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

OP12_SQL = r"""
WITH t AS (SELECT conv_id AS c, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS BIGINT) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT c, list_reduce(list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(substr(s, CAST(i AS INTEGER), 1)) AS BIGINT)),
    lambda r, b: list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(r, b)), CAST(4294967295 AS BIGINT)) AS r
  FROM (SELECT DISTINCT c, CAST(c AS VARCHAR) AS s FROM t)),
h AS (SELECT c, c - c % 5 AS base, xor(r, CAST(4294967295 AS BIGINT)) % 9 AS h FROM crc),
rebuilt AS (
  SELECT h.c, 0 AS part, t.pos, role, text FROM h JOIN t ON t.c = h.base AND t.pos < h.h
  UNION ALL SELECT h.c, 1, t.pos, role, text FROM h JOIN t ON t.c = h.c AND t.pos >= h.h),
n AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d, role, text FROM rebuilt),
p AS (SELECT c, d, text, md5(string_agg(concat(length(role), ':', role, length(text), ':', text), '') OVER (PARTITION BY c ORDER BY d)) AS k FROM n
  UNION ALL SELECT c, 0, '', 'root' FROM h),
len AS (SELECT c, max(d) AS len FROM p GROUP BY c),
node AS (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, strlen(any_value(text)) AS bytes FROM p GROUP BY k, d),
up AS (SELECT DISTINCT x.k, x.d, y.k AS pk FROM p x JOIN p y ON x.c = y.c AND y.d = x.d - 1),
kids AS (SELECT pk, count(*) AS n_children FROM up GROUP BY pk),
own AS (SELECT node.*, coalesce(n_children, 0) AS n_children, parent.conv_id AS parent_conv_id FROM node LEFT JOIN kids ON kids.pk = node.k LEFT JOIN up ON up.k = node.k AND up.d = node.d LEFT JOIN node parent ON parent.k = up.pk),
sub AS (SELECT a.k, a.d, CAST(sum(CASE WHEN u.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum((u.n_convs - 1) * u.bytes) AS BIGINT) AS saved_tokens FROM own u JOIN p a ON a.c = u.conv_id AND a.d <= u.d GROUP BY a.k, a.d),
ends AS (SELECT p.k, p.d, string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) AS ids FROM p JOIN len ON len.c = p.c AND len.len = p.d GROUP BY p.k, p.d)
SELECT conv_id, CAST(own.d AS BIGINT) AS depth, parent_conv_id, CAST(n_convs AS BIGINT) AS n_convs, CAST(n_children AS BIGINT) AS n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM own JOIN sub ON sub.k = own.k AND sub.d = own.d LEFT JOIN ends ON ends.k = own.k AND ends.d = own.d
"""

OP2_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(range(len(parts))) AS line, unnest(parts) AS raw FROM d),
w AS (SELECT doc_id, line, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(raw), '[ \t\x0b\x0c\r]+'), lambda x: x <> ''))) AS ws FROM l),
s AS (SELECT ws, len(ws) AS n, min(doc_id * 1000000 + line) AS at, row_number() OVER () AS sid FROM w WHERE len(ws) >= 1 GROUP BY ws),
tok AS (SELECT sid, n, unnest(ws) AS t FROM s),
df AS (SELECT t, count(*) AS c FROM tok GROUP BY t),
pre AS (SELECT sid, n, t, row_number() OVER (PARTITION BY sid ORDER BY c, t) AS p FROM tok JOIN df USING (t)),
pf AS (SELECT * FROM pre WHERE p <= n - (4 * n + 4) // 5 + 1),
cand AS (SELECT DISTINCT a.sid AS a, b.sid AS b FROM pf a JOIN pf b ON a.t = b.t AND a.sid <> b.sid AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
near AS (SELECT a, min(y.at) AS other FROM cand JOIN s x ON x.sid = a JOIN s y ON y.sid = b WHERE 9 * len(list_intersect(x.ws, y.ws)) >= 4 * (x.n + y.n) GROUP BY a),
keep AS (SELECT s.ws, least(s.at, coalesce(other, s.at)) AS keep FROM s LEFT JOIN near ON a = sid),
gone AS (SELECT w.doc_id, list_sort(list(CAST(w.line AS INTEGER))) AS removed FROM w JOIN keep USING (ws) WHERE w.doc_id * 1000000 + w.line > keep GROUP BY w.doc_id)
SELECT d.doc_id, CASE WHEN removed IS NULL THEN text ELSE array_to_string(list_filter(parts, lambda x, i: NOT list_contains(removed, i - 1)), chr(10)) END AS text,
  CAST(len(parts) AS INTEGER) AS n_lines, coalesce(removed, CAST([] AS INTEGER[])) AS removed
FROM d LEFT JOIN gone ON gone.doc_id = d.doc_id
"""

OP8_SQL = r"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '(?s).*?(?:[.!?\x{061f}\x{06d4}]+["'')\]]*\s+|[\x{3002}\x{ff01}\x{ff1f}\x{ff61}\x{0964}\x{0965}\x{1362}]+["'')\]\x{300d}\x{300f}\x{2019}\x{201d}]*\s*|\n+)|.+') AS parts FROM documents),
q AS (SELECT doc_id, unnest(range(len(parts))) AS o, unnest(parts) AS part FROM d),
c AS (SELECT doc_id, o, CASE WHEN len(list_filter(regexp_split_to_array(part, '\s+'), lambda x: x <> '')) >= 20 THEN regexp_extract_all(part, '\s*\S+(?:\s+\S+){0,9}\s*') ELSE [part] END AS pieces FROM q),
e AS (SELECT doc_id, o, unnest(range(len(pieces))) AS s, unnest(pieces) AS part FROM c),
p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o, s) - 1 AS i, part FROM e),
w AS (SELECT *, list_filter(regexp_split_to_array(lower(part), '\s+'), lambda x: x <> '') AS ws FROM p),
k AS (SELECT doc_id, i, greatest(len(ws), length(array_to_string(ws, ' ')) // 10) AS n, array_to_string(ws, ' ') AS t, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS kept
      FROM w WHERE len(ws) > 1 OR (len(ws) = 1 AND regexp_matches(ws[1], '[\p{L}\p{N}]'))),
u AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM k),
ends AS (SELECT a.doc_id, a.k AS first, min(b.k) AS last FROM u a JOIN u b ON a.doc_id = b.doc_id AND b.k BETWEEN least(a.k + 1, a.kept - 1) AND a.k + 12 AND b.upto - a.upto + a.n >= 12
         WHERE a.k + 1 < a.kept OR a.kept = 1 GROUP BY a.doc_id, a.k),
spans AS (SELECT x.doc_id, x.first, x.last, string_agg(u.t, ' | ' ORDER BY u.k) AS h FROM ends x JOIN u ON u.doc_id = x.doc_id AND u.k BETWEEN x.first AND x.last GROUP BY x.doc_id, x.first, x.last),
later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, first) AS place FROM spans) WHERE place > 1),
gone AS (SELECT DISTINCT l.doc_id, u.i FROM later l JOIN u ON u.doc_id = l.doc_id AND u.k BETWEEN l.first AND l.last),
b AS (SELECT doc_id, i, part, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM p),
g AS (SELECT b.*, gone.i IS NOT NULL AS off FROM b LEFT JOIN gone ON gone.doc_id = b.doc_id AND gone.i = b.i),
isl AS (SELECT doc_id, min(e - length(part)) AS a, max(e) AS z FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS s FROM g WHERE off) GROUP BY doc_id, s),
r AS (SELECT doc_id, list([CAST(a AS INTEGER), CAST(z AS INTEGER)] ORDER BY a) AS removed FROM isl GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(string_agg(CASE WHEN NOT off THEN part END, '' ORDER BY i), '') AS text, CAST(count(*) AS INTEGER) AS n_sentences, CAST(sum(CASE WHEN off THEN 1 ELSE 0 END) AS INTEGER) AS n_removed FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.text, d.text) AS text, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_removed, 0) AS n_removed, coalesce(removed, CAST([] AS INTEGER[][])) AS removed
FROM d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id
"""

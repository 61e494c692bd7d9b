"""The registered queries of the operators in this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.llm import conversations, divergence, exact_dedup, katz, langid, mixing, ngram_join, packing, secrets, sharding, substring_dedup, topk, toxicity
from skeinlog.llm._tables import new_path

#: Vocabulary file that packing uses, a parameter of the operator.
TOKENIZER_FILE = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_FILE)


def crc_of_id(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.in_training_order(mixing.assign_demand(table(spark, sf_dir, "documents")))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "full_copies", "cut_words", "position", "last_position")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_of_id() % 3 == 1)
    model = langid.train(docs, ~F.col("held_out"))
    return langid.predict(docs, model, ["doc_id", "held_out"])


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op5_shard_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the shard that holds it in the newest version, read back through the manifest."""
    docs = table(spark, sf_dir, "documents")
    store = sharding.shard_documents(docs, new_path(spark, "shards"))
    shards, _ = store.manifest()
    # file names and sizes, one row per shard of about the target size
    files = spark.createDataFrame(
        [(s.file, i, s.bytes, s.merges) for i, s in enumerate(shards)],
        "shard_file string, shard_id int, shard_bytes long, merges int",
    )
    rows = store.read(file_col="__file").select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.col("__file").alias("shard_file"))
    return rows.join(files, "shard_file").withColumn("version", F.lit(store.version()))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secrets.as_text(F.col("spans")).alias("spans"),
    )


def op7_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_of_id() % 7 == 2)
    scored = katz.KatzModel(order=2).fit_and_score(docs, ~F.col("held_out"))
    return scored.withColumn("held_out", ~F.col("in_training")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicate_components(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversations.damage(table(spark, sf_dir, "conversations"))
    pieces = conversations.repair(damaged, times=F.col("times"))
    return conversations.summarise(pieces).withColumnRenamed("conv", "conv_id")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), crc_of_id() % 4 != 2)
    return toxicity.predict(docs.withColumn("held_out", crc_of_id() % 4 == 2), model, ["doc_id", "held_out"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_source_mixing": op2_source_mixing,
        "op3_language_id": op3_language_id,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_shard_compaction": op5_shard_compaction,
        "op6_secret_scan": op6_secret_scan,
        "op7_katz_scoring": op7_katz_scoring,
        "op8_exact_top_k": op8_exact_top_k,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
        "op11_source_divergence": op11_source_divergence,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_toxicity": op13_toxicity,
    }


_OP2 = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
turned AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS turn FROM per),
weighed AS (SELECT *, turn % 3 + 1 AS weight, [-0.5, 0.0, 0.5][turn % 3 + 1]::DOUBLE AS ramp, source_size * 3 AS cap FROM turned),
levels AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, turn) AS pos,
    CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM weighed),
free AS (SELECT min(pos) AS pos, min_by(level, pos) AS level FROM levels WHERE cap > weight * level),
targets AS (
  SELECT l.source, l.source_size, l.ramp,
    CASE WHEN f.pos IS NOT NULL AND l.pos >= f.pos THEN l.weight * f.level ELSE CAST(l.cap AS DOUBLE) END AS target
  FROM levels l, free f),
rows_ AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.ramp, CAST(round(t.target) AS BIGINT) AS demand,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS supply
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT *, CASE WHEN source_size > 0 THEN demand // source_size ELSE 0 END AS full_copies,
    CASE WHEN source_size > 0 THEN greatest(0, least(size, demand % source_size - supply)) ELSE 0 END AS cut_words
  FROM rows_)
SELECT doc_id, size, source_size, target, CAST(full_copies * size + cut_words AS BIGINT) AS taken,
  CAST(full_copies AS BIGINT) AS full_copies, CAST(cut_words AS BIGINT) AS cut_words,
  CASE WHEN full_copies * size + cut_words > 0 THEN
    CASE WHEN ramp = 0 THEN supply / target
         ELSE (sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * (supply / target)) - (1 - ramp)) / (2 * ramp) END END AS position,
  CASE WHEN full_copies * size + cut_words > 0 THEN
    CASE WHEN ramp = 0 THEN last_supply / target
         ELSE (sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * (last_supply / target)) - (1 - ramp)) / (2 * ramp) END END AS last_position
FROM (SELECT *, (full_copies - CASE WHEN cut_words > 0 THEN 0 ELSE 1 END) * source_size + supply AS last_supply FROM copies)
"""

_OP4 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, i, words[i] AS word,
        CASE WHEN i + 19 <= len(words) THEN md5(array_to_string(words[i:i + 19], ' ')) END AS content
      FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM d)),
f AS (SELECT doc_id, i, word,
        content IS NOT NULL AND row_number() OVER (PARTITION BY content ORDER BY doc_id, i) > 1 AS later FROM w),
c AS (SELECT doc_id, i, word,
        bool_or(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
s AS (SELECT doc_id, count(*) AS n_words, sum(CASE WHEN gone THEN 1 ELSE 0 END) AS n_removed,
        coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id)
"""

_OP8 = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id IS DISTINCT FROM c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

_OP9 = r"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


_OP10 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reached = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) m ON d.doc_id = m.doc_id
"""


_OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
u AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM u GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
groups AS (
  SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(l.total, 0) AS lang_total, coalesce(c.total, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN langs l ON g.lang = l.lang
    LEFT JOIN (SELECT u.lang, source, count(*) AS total FROM u JOIN kept k ON u.lang = k.lang AND u.term = k.term GROUP BY u.lang, source) c
      ON g.lang = c.lang AND g.source = c.source),
counts AS (SELECT lang, source, term, count(*) AS n FROM u GROUP BY lang, source, term),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5) // (g.total + 5 * g.v) AS BIGINT) AS p,
    CAST(1 + CAST(1000000000 AS HUGEINT) * (k.n + 5) // (g.lang_total + 5 * g.v) AS BIGINT) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term),
f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source AS s1, y.source AS s2, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) s
      ON a.lang = s.lang AND a.source = s.s1 AND b.source = s.s2
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM f)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

_OP12 = r"""
WITH RECURSIVE said AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hashed AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(k, ''), lambda ch: CAST(ord(ch) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS fault
  FROM said),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
flagged AS (
  SELECT *, left(role, 1) AS c, NOT regexp_matches(text, '[^ 	-
]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
    NOT regexp_matches(text, '[.!?][ 	-
]*$') AS late,
    left(role, 1) || lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS step
  FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (seen AND NOT blank) AS duplicate, count(*) FILTER (late AND NOT blank AND NOT seen) AS truncated,
    count(*) FILTER (step NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM flagged GROUP BY conv_id),
grammar(q, c, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
inserts(q, t, letters) AS (VALUES (0, 0, ''), (1, 1, ''), (2, 2, ''), (3, 3, ''), (0, 2, 'I'), (1, 2, 'I'), (2, 3, 'I'), (3, 2, 'I'), (0, 3, 'II'), (1, 3, 'II')),
best AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS repaired FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, q, least.cost, least.audit, least.repaired FROM (
    SELECT conv_id, i, q, min({'cost': cost, 'audit': audit, 'repaired': repaired}) AS least FROM (
      SELECT b.conv_id, f.i, b.q, b.cost + 2 AS cost, b.audit || 'D' AS audit, b.repaired
      FROM best b JOIN flagged f ON b.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = b.i + 1
      UNION ALL
      SELECT b.conv_id, f.i, g.t, b.cost + 5 * length(n.letters) + CASE WHEN o.edit = 'R' THEN 1 ELSE 0 END + CASE WHEN f.late THEN 5 ELSE 0 END,
        b.audit || n.letters || o.edit,
        b.repaired || CASE WHEN n.letters = '' THEN '' WHEN b.q = 2 THEN chr(10) || 'assistant:' WHEN n.letters = 'I' THEN chr(10) || 'user:' ELSE chr(10) || 'user:' || chr(10) || 'assistant:' END
          || chr(10) || CASE WHEN o.edit = 'K' THEN f.role WHEN g.c = 'u' THEN 'user' ELSE 'assistant' END || ':' || f.text
      FROM best b JOIN flagged f ON b.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = b.i + 1 AND NOT f.blank AND NOT f.seen
        JOIN inserts n ON n.q = b.q JOIN grammar g ON g.q = n.t JOIN (VALUES ('K'), ('R')) o(edit) ON CASE WHEN o.edit = 'K' THEN g.c = f.c ELSE g.c <> 's' END)
    GROUP BY conv_id, i, q)),
ended AS (
  SELECT b.conv_id, min({'cost': b.cost + 5 * length(n.letters), 'audit': b.audit || n.letters,
    'repaired': b.repaired || CASE n.letters WHEN '' THEN '' WHEN 'I' THEN chr(10) || 'assistant:' ELSE chr(10) || 'user:' || chr(10) || 'assistant:' END}) AS least
  FROM best b LEFT JOIN counts c ON b.conv_id IS NOT DISTINCT FROM c.conv_id JOIN inserts n ON n.q = b.q AND n.t IN (0, 3)
  WHERE b.i = coalesce(c.n, 0) GROUP BY b.conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(least.cost AS BIGINT) AS cost, least.audit AS audit, sha256(substr(least.repaired, 2)) AS repaired_sha256
FROM ended e LEFT JOIN counts c ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_source_divergence": _OP11, "op12_conversation_repair": _OP12, "op10_ngram_jaccard_join": _OP10, "op2_source_mixing": _OP2, "op4_substring_dedup": _OP4, "op8_exact_top_k": _OP8, "op9_exact_dedup": _OP9}

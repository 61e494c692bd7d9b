"""The registered queries as they are: columns, types, contracts, and their SQL, on the smallest tables."""

import collections
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skeinlog.llm import mixing, queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op2_source_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op3_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op4_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op6_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op7_katz_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op8_exact_top_k": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op9_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op10_ngram_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op11_source_divergence": "lang string, source string, part string, item string, value bigint, rank int",
    "op12_conversation_repair": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string",
    "op13_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "conversations", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(rows):
    return collections.Counter(tuple(float(f"{v:.9g}") if isinstance(v, float) else v for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, tables, name):
    out = queries.queries()[name](spark, SF)
    if name in COLUMNS:
        kinds = {f.name: f.dataType.simpleString() for f in out.schema}
        for column in COLUMNS[name].split(", "):
            assert kinds[column.split()[0]] == column.split()[1]
    rows = out.collect()
    if sql := queries.oracle_sql().get(name):
        want = tables.sql(sql)
        names = sorted(out.columns)
        assert names == sorted(want.columns)
        assert plain([tuple(r[n] for n in names) for r in rows]) == plain(want.select(*[f'"{n}"' for n in names]).fetchall())
    ids = {r[0] for r in tables.sql("SELECT doc_id FROM documents").fetchall()}
    if name not in ("op1_best_fit_packing", "op8_exact_top_k", "op11_source_divergence", "op12_conversation_repair"):
        assert sorted(r.doc_id for r in rows) == sorted(ids)
    if name == "op1_best_fit_packing":
        assert {r.doc_id for r in rows} == ids and max(r.length for r in rows) <= 2048
    if name == "op3_language_id":
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    if name == "op7_katz_scoring":
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows)
        assert {r.train_tokens for r in rows} == {sum(r.n_tokens for r in rows if not r.held_out)}
        assert all(r.n_known == r.n_tokens for r in rows if not r.held_out)


def test_training_order(spark):
    """Range-sorted by position, also over several partitions; a document's last copy comes no earlier than its first."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.in_training_order(mixing.assign_demand(docs), 4).withColumn("part", F.spark_partition_id()).collect()
    taken = [r for r in rows if r.taken]
    assert [r.position for r in taken] == sorted(r.position for r in taken) and len({r.part for r in rows}) > 1
    assert all(0 <= r.position <= r.last_position <= 1 for r in taken) and all(r.position is None for r in rows if not r.taken)
    assert any(r.last_position > r.position for r in taken)


def test_pipeline_run(spark, tables):
    """The whole pipeline: what it packs are kept documents, each sequence filled without gaps, copies gone."""
    rows = corpus_pipeline.run(spark, SF).collect()
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= 2048
    texts = dict(tables.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    packed = {r.doc_id for r in rows}
    assert packed <= set(texts) and len({texts[i] for i in packed}) == len(packed)
    groups = collections.defaultdict(set)
    for i, _, c in tables.sql(queries._OP10.replace("FROM documents", "FROM (SELECT * FROM documents WHERE doc_id IN ({}))".format(",".join(map(str, packed))))).fetchall():
        groups[c].add(i)
    assert all(len(g) == 1 for g in groups.values())

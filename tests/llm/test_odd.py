"""Odd tables through the operators and the pipeline: clashing names, nulls, long texts, repeats, nothing at all."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import SCHEMA, docs, empty, odd_rows, prose  # noqa: F401
from tonguemill.llm import chat_format, decontaminate, license_scan, mixing, paragraph_dedup, pii_crf, quality_fm, sharding, simhash_trie, syncmers

CLASHING = "__tm_key __tm_no __tm_block __tm_tokens __tm_src __tm_whole __tm_end __tm_all __tm_took __tm_i __tm_h __tm_deal __tm_id __tm_y __TM_KEY_ key hi lo n label links group cluster uid bucket terms".split()


@pytest.fixture(scope="module")
def clashing(docs):  # noqa: F811
    return docs.select("doc_id", "text", "lang", "source", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHING])


def rows_of(df, columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_clashing_names(spark, clashing):
    b = spark.createDataFrame([(1, prose(random.Random(3), 40))], "item_id bigint, text string")
    columns, want = clashing.columns, rows_of(clashing, clashing.columns)
    kept = simhash_trie.without_near_copies(clashing)
    assert kept.columns == columns and not rows_of(kept, columns) - want
    kept = decontaminate.without_contaminated(clashing, b)
    assert kept.columns == columns and rows_of(kept, columns) == want
    model = quality_fm.train(clashing, spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id bigint, quality int, toxic int"))
    assert quality_fm.keep(clashing, model).columns == columns
    mixed = mixing.mix(clashing)
    assert mixed.columns[:-3] == columns and mixed.columns[-3:] == ["__tm_block_", "__tm_key__", "__tm_tokens_"]
    assert set(rows_of(mixed, columns)) <= set(want)
    dealt = sharding.uniform_shards(clashing)
    assert dealt.columns == [*columns, "shard", "pos"] and rows_of(dealt, columns) == want
    for run in (license_scan.license_scan, pii_crf.find_pii, syncmers.closed_syncmers, paragraph_dedup.repeated_paragraphs, simhash_trie.near_copies):
        assert rows_of(run(clashing), ["doc_id"]) == rows_of(run(clashing.select("doc_id", "text")), ["doc_id"])


def test_operators_after_each_other(docs):  # noqa: F811
    mixed = mixing.mix(docs)
    dealt = sharding.uniform_shards(mixed, 20)
    assert dealt.count() == mixed.count() and dealt.columns == [*mixed.columns, "shard_", "pos"]
    again = simhash_trie.without_near_copies(mixed)
    assert again.columns == mixed.columns and not rows_of(again, mixed.columns) - rows_of(mixed, mixed.columns)
    assert mixing.mix(mixed).columns[-3:] == ["__tm_block_", "__tm_key_", "__tm_tokens_"]


def test_ties_of_whole_rows(spark):
    """Of equal rows a partial block takes as many as its budget asks for."""
    d = spark.createDataFrame([(1, "a b c", "x")] * 30 + [(i, "w " * 5, "y") for i in range(40)], "doc_id bigint, text string, source string")
    out = Counter(r.source for r in mixing.mix(d, budget=100).collect())
    p = {r[0]: r for r in mixing.plan(d, budget=100)}
    assert out == {s: (r[4] * r[1] + r[5] + n - 1) // n for s, r in p.items() for n in [{"x": 3, "y": 5}[s]]}


def odd_pages():
    rng = random.Random(12)
    return [(None, None, None), (1, "", "s"), (1, "", "s"), (2, "a " * 60_000, None), *[(i, prose(rng, 30), "hot") for i in range(3, 40)], (50, "!?", "t")]


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_pipeline_on_odd_tables(spark, tmp_path, kind):
    import corpus_pipeline as cp

    documents = spark.createDataFrame(odd_pages() if kind == "odd" else [], "doc_id bigint, text string, source string").selectExpr("doc_id", "text", "cast(null as string) lang", "source", "length(text) n_chars", "'x' __tm_key")
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, i % 2, 0) for i in range(3, 30)] + [(None, None, 1), (3, 1, 1), (3, 1, 1)]
    spark.createDataFrame(labels if kind == "odd" else [], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, prose(random.Random(77), 40)), (None, None), (2, "")] if kind == "odd" else [], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = cp.run(spark, str(tmp_path))
    assert out.columns == [*cp.COLUMNS, "shard", "pos"]
    rows = out.collect()
    if kind == "empty":
        assert not rows
    else:
        assert {r.doc_id for r in rows} <= {r[0] for r in odd_pages()} and len(rows) == len({(r.shard, r.pos) for r in rows}) > 0


def test_empty_tables(spark, empty):  # noqa: F811
    chats = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    for df in (license_scan.license_scan(empty), pii_crf.find_pii(empty), syncmers.closed_syncmers(empty), paragraph_dedup.repeated_paragraphs(empty), simhash_trie.near_copies(empty), mixing.mix(empty), sharding.uniform_shards(empty), chat_format.format_chats(chats)):
        assert df.count() == 0

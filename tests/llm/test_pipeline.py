"""The pipeline on a small table, and the registered queries against SQL."""

import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from maskwell.llm import line_dedup, queries  # noqa: E402
from tests.llm.cases import documents, sentence, words  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA).cache()
        if name == "packing":
            assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()}
            assert out.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").isEmpty()
        else:
            assert out.columns == names and 0 < out.count()
            if name != "mixing":
                assert out.count() <= before
            before, docs = out.count(), out
    assert all(len(words(r["text"])) for r in docs.collect())


def test_one_of_many_exact_copies_is_left(spark):
    text = "\n".join(sentence(i, 20) for i in range(5))
    table = [(i, text, "en", f"s{i % 3}", len(text)) for i in range(50)]
    table += [(100, sentence(50, 60), "en", "s0", 0)]
    docs = documents(spark, table=table)
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, DATA).cache()
    assert sorted((r["doc_id"], r["text"]) for r in docs.collect()) == [(0, text), (100, sentence(50, 60))]
    # Rows that repeat an id and text share their lines' fate.
    out = line_dedup.without_repeated_lines(documents(spark, table=[table[0], *table]), min_docs=10, keep_first=True)
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 0, 100]


def test_sql(spark):
    duck = duckdb.connect()
    for name in ("documents", "conversations"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, DATA)
        result = duck.execute(sql)
        have = [d[0] for d in result.description]
        assert sorted(have) == sorted(df.columns)
        assert sorted(result.fetchall()) == sorted(tuple(r[c] for c in have) for r in df.collect())

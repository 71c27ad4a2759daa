"""Changed schemas of sharded tables, rows without keys in mixing, many languages, clashing columns."""

import time

import pytest
from pyspark.sql import functions as F

from tarnweave.llm import common, language_id, mixing, sharding, simhash


@pytest.fixture
def shards(spark):
    return sharding.ShardedTable(spark, common.new_path(spark, "s"), target_bytes=1 << 20, fan_in=3)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_columns_outlive_compaction(spark, shards):
    two = spark.createDataFrame([(1, "a"), (2, None)], "id long, extra string")
    for _ in range(3):
        shards.append(two)
    shards.append(two.select("id"))  # lacks a column
    shards.append(two.select("id", F.lit(0.5).alias("score")))  # has a new one
    before = rows_of(shards.read().select("id", "extra", "score"))
    assert before == sorted([(1, "a", None), (2, None, None)] * 3 + [(1, None, None), (2, None, None), (1, None, 0.5), (2, None, 0.5)], key=repr)
    assert shards.compact_all() > 5
    shards.expire(older=-1)
    assert shards.read().columns == ["id", "extra", "score"] and rows_of(shards.read()) == before


def test_types_are_widened_or_refused(spark, shards):
    shards.append(spark.createDataFrame([(1, 1.5)], "id long, v double"))
    shards.append(spark.createDataFrame([(2, 2.5)], "id int, v float"))
    for schema, row in (("id string", ("x",)), ("v decimal(9,2)", (None,)), ("ID long", (1,)), ("v array<double>", ([1.0],))):
        with pytest.raises(ValueError):
            shards.append(spark.createDataFrame([row], schema))
    with pytest.raises(ValueError):
        sharding.merged_schema(spark.createDataFrame([], "id int").schema, spark.createDataFrame([], "id long").schema)
    assert shards.versions() == [1, 2] and rows_of(shards.read()) == [(1, 1.5), (2, 2.5)]


def test_arrivals_of_one_pass(spark, shards):
    df = spark.createDataFrame([(k, k % 3) for k in range(30)], "id long, path int")
    assert shards.append_each(df, F.col("path").cast("long"), shard_rows=4) == [1, 2, 3]
    assert [shards.read(v).count() for v in (1, 2, 3)] == [10, 20, 30] and shards.manifest(1).count() >= 3
    assert rows_of(shards.read()) == rows_of(df) and shards.append_each(df.where("false"), F.lit(1)) == []


def test_rows_without_keys_are_mixed_by_their_texts(spark):
    df = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    mixed = mixing.mix_sources(df)
    counts = mixed.groupBy("text").count().groupBy("count").count().count()
    assert counts > 2 and mixed.select("shuffle_key").distinct().count() > 1000
    assert abs(mixed.count() / 2000 - 1) < 0.1
    same = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"), F.lit("s").alias("source"))
    coalescing = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalescing, "false")  # else so few rows become one partition
    spread = mixing.mix_sources(same, repeat=4.0).groupBy(F.spark_partition_id()).count().collect()
    spark.conf.unset(coalescing)
    assert len(spread) > 1  # one id doesn't fill one partition


def test_five_hundred_languages(spark):
    names = [f"{a}{b}{c}" for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvwx"][:500]
    docs = spark.createDataFrame([(k, " ".join([f"{n}word", f"{n[::-1]}text", n * 2]), n, "s") for k, n in enumerate(names)], "doc_id long, text string, lang string, source string")
    model = language_id.learn(docs)
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("https://a.example/").alias("url"), F.concat(F.lit("<html lang='"), "lang", F.lit("'><body><article>"), "text", F.lit("</article></body></html>")).alias("html"))
    began = time.time()
    found = language_id.identify_pages(pages, model).collect()
    assert len(found) == 500 and time.time() - began < 90
    assert sum(r.lang_id == names[r.page_id] for r in found) > 450


def test_clashing_columns_are_replaced(spark):
    docs = spark.createDataFrame([(1, "le chat est dans la maison " * 400_00, "fr", "s", 9, "x")], "doc_id long, text string, lang string, source string, n_words int, fp string")
    found = language_id.identify_documents(docs, language_id.learn(docs), ["doc_id", "n_words", "lang"]).first()
    assert found.n_words == 240_000 and found.lang == "fr"
    assert simhash.with_fingerprints(docs, keep=("doc_id", "fp")).columns == ["doc_id", "fp"]

"""The pipeline's stages, each on its own and one after the other."""

import collections

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from fedloom.llm import decontaminate as leak
from fedloom.llm import quality, simhash

SF = "/root/testdata/sf0.001"
STAGE = dict(pipeline.STAGES)


@pytest.fixture
def stored(spark, tmp_path):
    def write(df):
        path = f"{tmp_path}/{len(list(tmp_path.iterdir()))}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    return write


@pytest.fixture
def odd(spark, stored):
    good = " ".join(f"word{i}" for i in range(120))
    other = " ".join(f"term{i}" for i in range(200))
    rows = [(1, good), (2, good), (2, good), (3, None), (4, ""), (5, other), (None, " ".join(f"x{i}" for i in range(90))), (7, "y " * 400_000)]
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return stored(df.withColumns({c: F.lit(3) for c in ("fp", "kept", "key", "fail_bits", "n_words", "row", "spans", "component_fp")}))


def ids(df):
    return sorted((r.doc_id for r in df.collect()), key=str)


def test_filters_on_odd_rows(spark, odd):
    assert ids(STAGE["quality_rules"](spark, odd, SF)) == [1, 2, 2, 5, None]
    assert ids(STAGE["simhash_near_dedup"](spark, odd, SF)) == [1, 3, 5, 7, None]
    assert ids(STAGE["benchmark_decontamination"](spark, odd, SF)) == [1, 2, 2, 3, 4, 5, 7, None]
    for name in list(STAGE)[:4]:
        assert STAGE[name](spark, odd, SF).schema.names == odd.columns
        assert STAGE[name](spark, odd.limit(0), SF).collect() == []


def test_repeats_leave_the_text(spark, odd):
    got = STAGE["suffix_array_dedup"](spark, odd, SF)
    assert ids(got) == ids(odd)
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[1].text == "" and rows[1].n_chars == 0 and rows[3].text is None and rows[3].n_chars is None and rows[4].text == ""
    assert rows[5].text == odd.where("doc_id = 5").first().text and rows[None].n_chars == odd.where("doc_id IS NULL").first().n_chars


def test_packing_takes_odd_rows(spark, odd):
    got = STAGE["best_fit_packing"](spark, odd, SF)
    assert collections.Counter(r.doc_id for r in got.where("start = 0").collect()) == collections.Counter(r.doc_id for r in odd.collect())
    assert STAGE["best_fit_packing"](spark, odd.limit(0), SF).collect() == []


def test_stages_follow_each_other(spark, stored):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = stored(STAGE["quality_rules"](spark, docs, SF))
    verdict = {r.doc_id: r.kept for r in quality.quality_rules(docs).collect()}
    assert ids(good) == sorted((i for i, kept in verdict.items() if kept), key=str)
    apart = stored(STAGE["simhash_near_dedup"](spark, good, SF))
    groups = simhash.simhash_groups(good, 3, 2)
    assert ids(apart) == sorted({r.component_id for r in groups.collect()}, key=str)
    assert apart.join(good, docs.columns, "left_anti").count() == 0
    cut = stored(STAGE["suffix_array_dedup"](spark, apart, SF))
    assert ids(cut) == ids(apart) and cut.where("n_chars <> length(text)").count() == 0
    items = [leak.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = stored(STAGE["benchmark_decontamination"](spark, cut, SF))
    matcher = leak.Matcher(items)
    assert ids(clean) == sorted((r.doc_id for r in cut.collect() if not matcher.matches(leak.normal(r.text))), key=str)
    packed = pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.collect()} == set(ids(clean))
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_shape():
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "best_fit_packing"]
    assert pipeline.ORACLE_SQL is None

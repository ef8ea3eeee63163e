"""Every stage of the pipeline on odd tables: what goes, what stays, and the columns."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
KEEPING = [name for name, _ in corpus_pipeline.STAGES[:-1]]
#: Names that operators use inside.
CLASHES = "kept string, n_removed long, score double, quality_p double, toxic_p string, id string, carried string, row string, component long, spans string, item string"


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 40")
    last = [c.strip().split() for c in CLASHES.split(",")]
    rows = [(1_000_001, None, None, None, None), (1_000_002, "", "en", "s", 0), (1_000_003, " \n", "en", "s", 2), (None, "a row without an id and some words", "en", "s", 34)]
    rows += [(1_000_004, "w " * 50_000, "en", "s", 100_000), (1_000_005, "tied row", "en", "s", 8), (1_000_005, "tied row", "en", "s", 8)]
    more = spark.createDataFrame(rows, docs.schema)
    return docs.unionByName(more).withColumns({n: F.lit(None).cast(t) if n != "kept" else F.lit("mine") for n, t in last})


@pytest.mark.parametrize("name", KEEPING)
def test_stage_on_odd_rows(spark, odd, name):
    got = STAGES[name](spark, odd, FOLDER)
    assert got.schema.names == odd.schema.names and [f.dataType for f in got.schema] == [f.dataType for f in odd.schema]
    rows = got.collect()
    ids = {r["doc_id"] for r in rows}
    assert ids <= {r["doc_id"] for r in odd.collect()} and {r["kept"] for r in rows} == {"mine"}
    if name != "quality":
        assert {1_000_001, 1_000_002, 1_000_003, None, 1_000_004, 1_000_005} <= ids
        assert sum(r["doc_id"] == 1_000_005 for r in rows) == 2
        assert {r["doc_id"]: r["text"] for r in rows}[None] == "a row without an id and some words"
    if name == "repeats":
        assert {r["doc_id"]: (r["text"] or "") for r in rows}[1_000_001] == ""


@pytest.mark.parametrize("name", STAGES)
def test_stage_on_an_empty_table(spark, odd, name):
    assert STAGES[name](spark, odd.limit(0), FOLDER).count() == 0


def test_tokens_of_odd_rows(spark, odd):
    rows = STAGES["tokens"](spark, odd, FOLDER).collect()
    assert len(rows) == odd.count()
    assert {r["doc_id"]: r["n_tokens"] for r in rows}[1_000_001] == 0


def test_each_stage_takes_out_what_it_is_for(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    long = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").where("length(text) > 60").first()["text"]
    added = [(9001, long), (9002, long + " more"), (9003, "before. " + long + " and after it goes on"), (9004, f"x {item} y"), (9005, "quite alone here")]
    docs = docs.where("doc_id < 0").unionByName(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in added], docs.schema))
    left = {name: {r["doc_id"]: r["text"] for r in STAGES[name](spark, docs, FOLDER).collect()} for name in KEEPING[1:]}
    assert set(left["near_duplicates"]) == {9001, 9003, 9004, 9005}
    assert long not in left["repeats"][9003] and left["repeats"][9001] == long and left["repeats"][9005] == "quite alone here"
    assert set(left["decontamination"]) == {9001, 9002, 9003, 9005}

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from driftwarden.llm import mixing, toxicity
from driftwarden.llm.packing_query import vocabulary
from test_llm_exact import expected as exact_groups
from test_llm_jaccard import expected as near_groups
from test_llm_packing import reference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input and the result of every stage, each written and read again."""
    docs, made = spark.read.parquet(f"{SF}/documents.parquet"), {}
    folder = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        left = spark.read.parquet(f"{folder}/{name}")
        made[name] = (docs, left)
        docs = left
    return made


def ids(frame):
    return sorted(r["doc_id"] for r in frame.select("doc_id").collect())


def texts(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def test_stages_keep_the_columns(stages):
    for name, (given, left) in list(stages.items())[:-1]:
        assert left.columns == given.columns, name


def test_toxicity_rejects_what_scores_high(spark, stages):
    given, left = stages["toxicity"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.learn(given, labels, F.lit(False), corpus_pipeline.MOST_LABELS)
    low = toxicity.score(given, model).where(F.col("score") < corpus_pipeline.THRESHOLD)
    assert ids(left) == ids(low)
    assert given.count() - left.count() <= given.count() / 4


def test_exact_dedup_keeps_one_of_each(stages):
    given, left = stages["exact_dedup"]
    assert ids(left) == sorted(i for i, x in exact_groups(texts(given)).items() if x[2])


def test_near_dedup_keeps_one_of_each_group(stages):
    given, left = stages["near_dedup"]
    assert ids(left) == sorted(i for i, (_, c) in near_groups(texts(given), 5, 80).items() if c == i)


def test_mixing_keeps_every_document(stages):
    given, left = stages["mix_sources"]
    assert sorted(map(str, left.collect())) == sorted(map(str, given.collect()))


def test_packing_covers_every_document(stages):
    given, left = stages["packing"]
    got = {}
    for r in sorted(left.collect(), key=lambda r: r["start"]):
        got.setdefault(r["doc_id"], []).extend(r["ids"])
    pairs = texts(given)
    assert got == dict(zip([i for i, _ in pairs], reference([t for _, t in pairs]), strict=True))
    assert vocabulary().endswith(".json")


def test_run_gives_the_last_stage(spark, stages):
    _, left = stages["packing"]
    assert sorted(map(str, corpus_pipeline.run(spark, SF).select("doc_id", "start", "ids").collect())) == sorted(
        map(str, left.select("doc_id", "start", "ids").collect())
    )


def test_mixing_keeps_every_document_beside_a_tiny_source(spark, tmp_path):
    rows = [(i, f"text {i}", "A") for i in range(6000)] + [(6000 + i, "rare", "B") for i in range(10)]
    rows += [(6010 + i, "none", None) for i in range(5)] + [(None, "no id", "A"), (7, "text 7", "A"), (8, "other", "B")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    corpus_pipeline.mix_sources(spark, docs, SF).write.parquet(f"{tmp_path}/mixed")
    left = spark.read.parquet(f"{tmp_path}/mixed")
    assert sorted(map(str, left.collect())) == sorted(str(r) for r in docs.collect())
    place = {}
    for r in mixing.mix_sources(docs, exponent=corpus_pipeline.MIX_EXPONENT).collect():
        place.setdefault((r["doc_id"], r["source"]), []).append((r["slot"], r["place"]))
    seen = [
        min(place[r["doc_id"], r["source"] or ""])
        for file in sorted((tmp_path / "mixed").glob("part-*.parquet"))
        for r in spark.read.parquet(str(file)).coalesce(1).collect()
        if r["doc_id"] is not None
    ]
    assert seen == sorted(seen) and len(seen) == len(rows) - 1

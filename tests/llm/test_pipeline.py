"""The registered queries against their SQL, and the pipeline against its stages one by one."""

import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

from check_queries import bag, connect  # noqa: E402

import __spark_entry__  # noqa: E402
import corpus_pipeline  # noqa: E402
from roomledger.llm import catalog, exact_dedup, quality  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    result = connect(SF).execute(catalog.ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert bag(df.collect(), df.columns) == bag(result.fetchall(), columns)


def test_every_operator_is_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    frames = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], SF).write.parquet(str(tmp_path / str(k)))
        frames.append(spark.read.parquet(str(tmp_path / str(k))))
    for frame in frames[1:-1]:
        assert frame.columns == docs.columns
    rows = [{r["doc_id"]: r for r in f.collect()} for f in frames[:-1]]

    good = {r["doc_id"] for r in quality.score_documents(docs, labels).where("predicted = 1").collect()}
    assert set(rows[1]) == good and 0 < len(good) < len(rows[0])
    first = {}
    for d, r in sorted(rows[1].items()):
        key = "".join(c for c in r["text"] if c not in " \t\n\x0b\x0c\r")
        if key not in first or len(rows[1][first[key]]["text"]) < len(r["text"]):
            first[key] = d
    assert set(rows[2]) == set(first.values())
    assert {r["doc_id"] for r in exact_dedup.exact_groups(frames[1]).where("kept").collect()} == set(rows[2])
    assert set(rows[3]) == first_of_similar(rows[2])
    assert set(rows[4]) <= set(rows[3]) and frames[4].count() > len(rows[4])
    assert all(n <= 2 for n in Counter(r["doc_id"] for r in frames[4].collect()).values())
    packed = frames[5].collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in frames[4].collect())
    assert all(rows[0][d] == r for part in rows[1:] for d, r in part.items())


def first_of_similar(rows):
    """The smallest id of each group that links of five-word Jaccard similarity 0.8 connect."""

    def shingles(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    label = {d: d for d in rows}
    sets = {d: shingles(r["text"]) for d, r in rows.items()}
    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])):
                x, y = sorted((label[a], label[b]))
                label = {d: x if v == y else v for d, v in label.items()}
    return set(label.values())


CLASHING = [(1, "same words in here now", "a", 1, 2, 3), (2, "same words  in here now", "b", 2, 2, 3), (None, None, None, None, None, None), (None, "", "a", 1, 1, 1),
            (3, "quite another text of some words", "a", 5, 5, 5), (3, "quite another text of some words", "a", 5, 5, 5), (4, "y " * 30_000, None, 0, 0, 0)]


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_nulls_repeats_and_clashing_columns(spark, stage):
    schema = "doc_id long, text string, source string, key int, node long, row int"
    docs = spark.createDataFrame(CLASHING, schema).withColumn("tags", F.create_map(F.lit("k"), F.col("key"))).repartition(3)
    found = corpus_pipeline.STAGES[stage][1](spark, docs, SF)
    rows = found.collect()
    if stage == 4:
        assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(r[0] for r in CLASHING)
        return
    assert found.columns == docs.columns and found.schema["tags"].dataType == docs.schema["tags"].dataType
    left = sorted((r["doc_id"] or 0 for r in rows))
    if stage == 0:
        assert len({r["doc_id"] for r in rows}) <= 5
    elif stage < 3:
        assert left == [0, 1, 3, 4] or left == [0, 2, 3, 4] and stage == 1
    else:
        taken = Counter(r["doc_id"] for r in rows)
        assert taken[None] == 0 and taken[3] >= 2 and all(n <= 4 for n in taken.values())


def test_pipeline_of_nothing(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.count() == 0

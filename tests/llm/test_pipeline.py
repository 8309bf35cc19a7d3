"""The pipeline's stages on small tables."""

import random

import pytest

import corpus_pipeline
from thicket.llm.queries import ORACLES, QUERIES

R = random.Random(11)


def text(n):
    return "\n".join(" ".join("".join(R.choice("abcdefghij") for _ in range(R.randint(2, 8))) for _ in range(12)) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    texts = [text(8) for _ in range(40)]
    item = texts[7].split("\n")[2] + " " + texts[7].split("\n")[3]
    stock = "this line stands in every third document of the table"
    rows = [(i, "\n".join([t, stock]) if i % 3 == 0 else t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(100, texts[5], "en", "s", 1), (101, "too short", "en", "s", 9), (102, None, None, None, None), (103, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").coalesce(1).write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "tokens":
            assert out.schema == docs.schema
        docs = out.cache()
        seen.append({r["doc_id"] for r in docs.collect()})
    quality, lines, near, clean, tokens = seen
    assert not quality & {101, 102, 103} and len(quality) >= 39
    assert lines == quality
    assert near == lines - {100}
    assert clean == near - {7}
    rows = docs.collect()
    assert tokens == clean and all(len(r["ids"]) == r["n_tokens"] for r in rows)
    assert sum("this line stands" in r["text"] for r in rows) == 1


def test_run_is_all_stages(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() == 39


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLES) <= set(QUERIES)

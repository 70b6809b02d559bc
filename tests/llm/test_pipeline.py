"""Stages of the corpus pipeline on null and repeated ids, copies and empty tables."""

import pathlib

import pytest

import corpus_pipeline
from framespark.llm import storage
from framespark.llm.storage import new_path

FORM = "doc_id long, text string, lang string, source string, n_chars long, id long, n long, kept string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web", len(t or ""), 7, 9, "extra") for i, t in rows], FORM)


def test_near_duplicate_stage(spark):
    base = " ".join(f"word{i}" for i in range(200))
    near = base.replace("word100 ", "other ")
    rows = [(5, base), (5, base), (None, base), (3, near), (8, "quite another text of six words"), (9, None), (9, ""), (None, None)]
    docs = table(spark, rows)
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert got.columns == docs.columns
    texts = sorted((r["text"] or "") for r in got.collect())
    assert len(texts) == 5 and texts[:3] == ["", "", ""]
    assert sum(t in (base, near) for t in texts) == 1 and "quite another text of six words" in texts


def test_empty_near_duplicate_stage(spark):
    docs = table(spark, [])
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert got.columns == docs.columns and got.count() == 0


def test_stages_are_named_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "language ID", "MinHash near-dedup", "secret scans", "best-fit packing",
    ]


def test_secrets_and_packing_stages(spark):
    docs = table(spark, [(1, 'some words here token = "Zx9qLm47TbVr20KdPw8sYh3N" and more'), (1, "plain words"), (None, "no id"), (4, None), (5, "")])
    clean = corpus_pipeline.secrets_stage(spark, docs, "")
    assert clean.columns == docs.columns and clean.count() == 5
    assert {r["text"] for r in clean.collect()} >= {"plain words", "no id", "", None}
    packed = corpus_pipeline.packing_stage(spark, docs, "").collect()
    assert len(packed) == 5 and {r["doc_id"] for r in packed} == {1, None, 4, 5}
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in packed)
    at = {}
    for sequence, offset, length in places:
        assert offset == at.get(sequence, 0)
        at[sequence] = offset + length
    assert max(at.values()) <= 2048


def test_a_run_leaves_its_result_alone(spark):
    path = new_path(spark, "sf")
    rows = [(i, f"the river and the stone {i % 5} of the old house " * (5 + i % 3), "en", "s", 1) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    here = pathlib.Path(storage.shared_dir(spark).removeprefix("file://"))
    before = {p.name for p in here.iterdir()}
    result = corpus_pipeline.run(spark, path)
    assert result.count() > 0 and len({p.name for p in here.iterdir()} - before) == 1
    with storage.scope(spark):
        assert corpus_pipeline.run(spark, path).count() == result.count()
    with pytest.raises(ZeroDivisionError), storage.scope(spark):
        storage.materialize(spark.range(3), "lost")
        raise ZeroDivisionError
    assert len({p.name for p in here.iterdir()} - before) == 1

"""The pipeline stage by stage against plain versions, and the registry."""

import re

import public_tokenizers
import pytest
import sentencepiece

import __spark_entry__
import corpus_pipeline
from tidelens.llm import quality, tiling

from .helpers import messy, prose, texts_of
from .test_pairs import copies, plain_join, plain_tiles


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    junk = [(2000 + i, " ".join(w.upper() + "!!" for w in prose(500 + i, 60).split())) for i in range(40)]
    clean = [(3000 + i, prose(700 + i, 60)) for i in range(60)]
    item = prose(31, 30)
    messy(spark, [*copies(8), *junk, *clean, (4000, f"{prose(1, 9)} {item} {prose(2, 9)}")]).selectExpr("doc_id", "text", "lang", "row AS source", "length(text) AS n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 0) for i, _ in junk] + [(i, 1) for i, _ in clean], "doc_id long, quality int").selectExpr("*", "0 AS toxic").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def bag(rows):
    return sorted(rows, key=repr)


def test_stages_against_plain_versions(spark, folder):
    docs, names = spark.read.parquet(f"{folder}/documents.parquet"), [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "sentencepiece_encoding"]
    steps = [f for _, f in corpus_pipeline.STAGES]
    columns = docs.columns

    out = steps[0](spark, docs, folder)
    good = {r["doc_id"] for r in quality.classify(docs, spark.read.parquet(f"{folder}/labels.parquet")).filter("score >= 0.3").collect()}
    assert out.columns == columns and {r["doc_id"] for r in out.collect()} == good
    assert not any(2000 <= (i or 0) < 2040 for i in good) and sum(3000 <= (i or 0) < 3060 for i in good) >= 58

    before, out = docs, steps[1](spark, docs, folder)
    keep = {repr(i) for i, _, _, group in plain_join(texts_of(before)) if i is not None and i == group}
    assert out.columns == columns and bag(repr(r["doc_id"]) for r in out.collect() if r["doc_id"] is not None) == sorted(keep)

    out = steps[2](spark, docs, folder)
    item = tiling.WORD.findall(prose(31, 30))
    left = [(i, t) for i, t in texts_of(docs) if i == 6 or plain_tiles(item, tiling.WORD.findall((t or "").lower()), 5) < 0.6 * len(item)]
    assert out.columns == columns and bag(texts_of(out)) == bag(left) and 4000 not in {i for i, _ in left}

    out = steps[3](spark, docs, folder)
    assert out.columns == columns and out.count() == docs.count()
    for r in out.collect():
        assert r["text"] is None or (r["n_chars"] == len(r["text"]) and not re.search("password=[a-z0-9]{6}", r["text"]))

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = steps[4](spark, docs, folder)
    assert bag((r["doc_id"], r["ids"]) for r in out.collect()) == bag((i, sp.encode(t or "")) for i, t in texts_of(docs))


def test_run_applies_all_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    ids = {r["doc_id"] for r in out.collect()}
    assert 4000 not in ids and 2001 not in ids and out.columns == ["doc_id", "lang", "source", "ids"]


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)

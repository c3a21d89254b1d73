"""The pipeline's stages against brute force, and on odd tables."""

import hashlib
import random

import corpus_pipeline
import pytest
from pyspark.sql import types as T

from brindle.llm import bpe, catalogue, mixing

from .test_operators import brute_components, brute_cut, prose

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r, texts = random.Random(21), {}
    words = [prose(300 + i, 1) for i in range(60)]
    clean = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = clean(50)
    for i in range(90):
        texts[i] = clean(40)
    for i in range(90, 100):
        copy = texts[i - 90].split()
        copy[20 + i % 3] = "changed"
        texts[i] = " ".join(copy)
    for i in range(100, 106):
        texts[i] = f"{clean(30)} {passage} {clean(30)}"
    for i in range(200, 206):
        texts[i] = "".join(r.choice("#$%&*@!~") for _ in range(200))
    texts[300], texts[301] = None, ""
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in texts.items()]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 90, 2)] + [(200, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, texts


def test_stages_take_effect(spark, corpus):
    folder, texts = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    order = None
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == DOCS.names
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        got = {r.doc_id: r for r in docs.collect()}
        if name == "quality_classifier":
            assert set(before) - set(got) == set(range(200, 206))
        elif name == "ngram_join":
            want = {i for i, (_, c) in brute_components(before).items() if c == i}
            assert set(got) == want and len(want) < len(before)
        elif name == "suffix_dedup":
            cut = brute_cut(before.items())
            assert set(got) == set(before) and sum(c[1] for c in cut.values()) > 0
            assert all(len((got[i].text or "").encode()) <= cut[i][0] - cut[i][1] for i in got) and all(got[i].text == before[i] for i in got if not cut[i][1])
        elif name == "mixing":
            assert {i: r.text for i, r in got.items()} == before
            order = [r.source for r in docs.collect()]
        else:
            merger, table = bpe.Merger(bpe.vocabulary()), bpe.class_table()
            for i, t in before.items():
                assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
            assert len(got) == len(before) and merger and table is not None
    assert order is not None and len(set(order[:48])) == 3


def test_run_is_the_stages_in_turn(spark, corpus):
    folder, texts = corpus
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} <= set(texts) and len(rows) == len({r.doc_id for r in rows}) > 90


def test_empty_and_repeated_tables(spark, corpus, tmp_path):
    folder, _ = corpus
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.collect() == []
        docs = spark.createDataFrame([], docs.schema)
    twice = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11)] * 3 + [(None, None, None, None, None)], DOCS)
    kept = corpus_pipeline.ngram_join_stage(spark, twice, folder).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "None"]
    assert len(corpus_pipeline.mixing_stage(spark, twice, folder).collect()) == 4


def test_documents_that_share_an_id_stay(spark, corpus):
    folder, texts = corpus
    rows = [(1, texts[3], "en", "s0", 1), (1, texts[8], "en", "s0", 1), (2, texts[8] + " end", "en", "s1", 1), (1, "".join("#$%&"[i % 4] for i in range(300)), "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = corpus_pipeline.quality_classifier(spark, docs, folder).collect()
    assert {texts[3], texts[8]} <= {r.text for r in kept}
    joined = corpus_pipeline.ngram_join_stage(spark, spark.createDataFrame(rows[:3], DOCS), folder).collect()
    assert sorted((r.doc_id, r.text) for r in joined) == sorted([(1, texts[3]), (1, texts[8])])


def test_mixing_fills_all_files_in_order(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", "en", f"s{i % 5}", 6) for i in range(4000)], DOCS)
    mixed = corpus_pipeline.mixing_stage(spark, docs, "")
    mixed.write.parquet(str(tmp_path / "mixed"))
    back = spark.read.parquet(str(tmp_path / "mixed"))
    place = {r.doc_id: r.position for r in mixing.scheduled(docs).collect()}
    sizes, last = [], -1
    for file in sorted(back.inputFiles()):
        got = [place[r.doc_id] for r in spark.read.parquet(file).collect()]
        assert got == sorted(got) and got[0] > last
        last = got[-1]
        sizes.append(len(got))
    assert sum(sizes) == 4000 and len(sizes) == 4 and max(sizes) <= 2 * min(sizes)


def test_catalogue_names():
    assert sorted(int(n[2:].split("_")[0]) for n in catalogue.queries()) == list(range(1, 11))

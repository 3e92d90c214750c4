import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

import public_tokenizers  # noqa: E402
import test_line_dedup  # noqa: E402
import test_minhash  # noqa: E402
import test_tokens  # noqa: E402
import test_toxicity  # noqa: E402

import corpus_pipeline  # noqa: E402
from zetamill.llm import toxicity  # noqa: E402
from zetamill.llm.units import load_tokenizer  # noqa: E402


def fixture_rows():
    rng = random.Random(11)
    rows = [(i, text, toxic, rng.choice(["a", "a", "b"])) for i, text, toxic in test_toxicity.labelled(500, 9)]
    rows = [(i, t + "\nall rights reserved", y, s) if i % 3 else (i, t, y, s) for i, t, y, s in rows]
    for i in range(500, 640):  # near copies
        j = rng.randrange(500)
        words = rows[j][1].split(" ")
        if i % 2 and len(words) > 40:
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), rows[j][2], rows[j][3]))
    return rows


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that each stage gets and gives."""
    folder = tmp_path_factory.mktemp("tables")
    rows = fixture_rows()
    docs = [(i, t, "en", s, len(t)) for i, t, _, s in rows] + [(700, None, "en", "a", None), (701, "", None, None, 0), (None, "no id at all", "en", "b", 12), (703, "q " * 9000, "de", "b", 18000), (3, rows[3][1], "en", rows[3][3], len(rows[3][1]))]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y, _ in rows if i % 5 != 1], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    given, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, given, str(folder)).write.parquet(f"{folder}/{name}")
        taken = spark.read.parquet(f"{folder}/{name}")
        out.append((given, taken))
        given = taken
    return str(folder), out


def test_toxic_documents_go(spark, stages):
    folder, ((given, taken), *_) = stages
    assert taken.columns == given.columns
    model = toxicity.train(given, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = given.collect()
    scores = toxicity.Scorer(model).scores([r.text or "" for r in rows])
    assert sorted(map(str, taken.collect())) == sorted(str(r) for r, s in zip(rows, scores, strict=True) if s < 0.5)
    truth = {i: y for i, _, y, _ in fixture_rows()}
    left = {r.doc_id for r in taken.collect()}
    assert sum(truth[i] for i in left & set(truth)) <= 0.05 * sum(truth.values())
    assert sum(1 - truth[i] for i in truth if i not in left) <= 0.02 * len(truth)


def test_boilerplate_goes(stages):
    given, taken = stages[1][1]
    assert taken.columns == given.columns
    rows = [(r.doc_id, r.text, r.source) for r in given.collect()]
    want = sorted(((i, t) for i, t, _, _ in test_line_dedup.brute(rows, 0.08, 3)), key=str)
    assert sorted(((r.doc_id, r.text) for r in taken.collect()), key=str) == want
    assert any("rights" in (r.text or "") for r in given.collect()) and not any("rights" in (r.text or "") for r in taken.collect())
    assert all(r.text is None or r.n_chars == len(r.text) for r in taken.collect())


def test_one_document_of_each_group_stays(stages):
    given, taken = stages[1][2]
    assert taken.columns == given.columns
    rows = list({(r.doc_id, r.text) for r in given.collect() if r.doc_id is not None})
    groups = {i: c for i, (_, c) in test_minhash.brute(rows, 5).items()}
    assert sorted(r.doc_id for r in taken.collect() if r.doc_id is not None) == sorted(set(groups.values()))
    assert taken.where(F.col("doc_id").isNull()).count() == 1 and len(set(groups.values())) < len(groups)


def test_pieces_hold_everything(stages):
    given, taken = stages[1][3]
    rows = [(r.doc_id, r.text) for r in given.collect()]
    test_tokens.check_pieces(rows, taken.collect(), load_tokenizer(public_tokenizers.path("word_bpe_49k.json")), 2048)


def test_run_gives_the_last_stage(spark, stages):
    folder, out = stages
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sum(r.length for r in corpus_pipeline.run(spark, folder).select(*key).collect()) == sum(r.length for r in out[-1][1].collect())

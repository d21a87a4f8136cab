"""The corpus pipeline over a small folder, stage by stage and as a whole."""

import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers

WORDS = ["".join(random.Random(k).choices("abcdefghijklmnopqrstuvwxyz", k=3 + k % 6)) for k in range(900)]


def sentence(rand, n=14):
    return (" ".join(rand.choices(WORDS, k=n)) + ".").capitalize()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """60 clean documents (0-59), junk (100-129), near copies (200-204) of one text, and one with a benchmark item (300)."""
    rand, path = random.Random(2), tmp_path_factory.mktemp("corpus")
    docs = [(k, "\n".join(sentence(rand) for _ in range(6))) for k in range(60)]
    docs += [(100 + k, "!!! ### ".join(rand.choices("XYZQ", k=60)) + " $$$ " * 20) for k in range(30)]
    base = [sentence(rand, 40) for _ in range(3)]
    docs += [(200, "\n".join(base))] + [(200 + k, " ".join([*base, f"extra{k}"])) for k in range(1, 5)]
    item = sentence(rand, 20)
    docs += [(300, "\n".join([sentence(rand), item, sentence(rand)])), (301, None)]
    rows = [(k, t, "en", "web", len(t or "")) for k, t in docs]
    labels = [(k, 1) for k in range(60)] + [(100 + k, 0) for k in range(30)]
    for name, table in (
        ("documents", spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")),
        ("labels", spark.createDataFrame(labels, "doc_id long, quality int").withColumn("toxic", F.lit(0))),
        ("benchmark", spark.createDataFrame([(1, item)], "item_id long, text string")),
    ):
        table.write.parquet(f"{path}/{name}.parquet")
    return f"{path}", dict(docs)


def test_each_stage_keeps_the_columns_and_takes_effect(spark, folder):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    (_, quality), (_, lines), (_, near), (_, clean), (_, pack) = corpus_pipeline.STAGES
    good = quality(spark, docs, path)
    kept = {r["doc_id"] for r in good.collect()}
    assert good.columns == columns and not kept & set(range(100, 130)) and set(range(60)) <= kept
    cut = lines(spark, docs.where("doc_id < 100 OR doc_id >= 200"), path)
    assert cut.columns == columns and cut.count() == docs.count() - 30
    assert {r["doc_id"]: r["text"] for r in cut.where("doc_id < 60").collect()} == {k: texts[k] for k in range(60)}
    one = near(spark, docs.where("doc_id >= 200"), path)
    assert one.columns == columns and {r["doc_id"] for r in one.collect()} == {200, 300, 301}
    left = clean(spark, docs, path)
    assert left.columns == columns and {r["doc_id"] for r in left.collect()} == set(texts) - {300}
    assert pack(spark, docs.where("doc_id < 5"), path).select("doc_id").distinct().count() == 5


def test_the_whole_run(spark, folder):
    path, texts = folder
    rows = corpus_pipeline.run(spark, path).collect()
    ids = {r["doc_id"] for r in rows}
    assert set(range(60)) <= ids and not ids & set(range(100, 130)) and 300 not in ids
    # 201 to 204 are one line each, so line dedup leaves that of 201, and three texts become empty like that of 301; then 200
    # stands for 201, and 202 for the empty ones
    assert ids & set(range(200, 302)) == {200, 202}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {k: 0 for k in range(60)}
    for r in rows:
        if r["doc_id"] in tokens:
            tokens[r["doc_id"]] += r["length"]
    assert tokens == {k: len(library.encode(texts[k], add_special_tokens=False).ids) + 1 for k in range(60)}

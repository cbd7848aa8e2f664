"""What the classifier learns from its labels."""

from __future__ import annotations

import zlib

from loomfield.llm import classifier


def labelled(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string").repartition(3)
    return docs, spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(texts)], "doc_id long, quality int, toxic int")


def test_different_texts_that_share_a_common_word_are_all_evidence(spark):
    words = [f"w{i}" for i in range(400)]
    least = min(words, key=lambda w: zlib.crc32(w.encode()))
    others = [w for w in words if w != least and zlib.crc32(b"slur") > zlib.crc32(least.encode())]
    texts = [(f"{least} slur {others[i]}", 1) for i in range(8)] + [(f"{least} plain {others[20 + i]}", 0) for i in range(60)]
    assert "slur".encode() in classifier.fit(*labelled(spark, texts)).words


def test_copies_of_one_text_count_once(spark):
    texts = [("slur again and again", 1)] * 8 + [(f"plain text {i}", 0) for i in range(60)]
    assert "slur".encode() not in classifier.fit(*labelled(spark, texts)).words


def test_held_out_toxic_documents_are_found(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train, held = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    rows = classifier.classify(docs.join(held.select("doc_id"), "doc_id", "left_semi"), train, model=classifier.fit(docs, train)).join(held, "doc_id").collect()
    toxic = [r["p_toxic"] > 0.5 for r in rows if r["toxic"] == 1]
    assert sum(toxic) >= 0.92 * len(toxic)
    clean = [r["kept"] for r in rows if r["quality"] == 1 and r["toxic"] == 0]
    assert sum(clean) > 0.97 * len(clean)

"""The pipeline's stages on a small folder of tables, and its result against the stages one by one."""

from __future__ import annotations

import re

import numpy as np

import corpus_pipeline
from loomfield.llm import pii
from loomfield.llm.queries import pii_key, tokenizer

TINY = "/root/testdata/sf0.001"


def test_stages_and_result(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    columns, stage = docs.columns, docs
    rows = []
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, TINY).cache()
        assert stage.columns == columns
        rows.append(stage.collect())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    quality, single, private, mixed = rows
    # one of each group of near copies stays, the smallest of those the classifier kept
    shingles = {r["doc_id"]: _shingles(r["text"]) for r in quality}
    label = {i: i for i in shingles}
    links = [(a, b) for a in shingles for b in shingles if a < b and shingles[a] and 100 * len(shingles[a] & shingles[b]) >= 75 * len(shingles[a] | shingles[b])]
    for _ in links:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert {r["doc_id"] for r in single} == {i for i, m in label.items() if i == m}
    names = pii.Pseudonyms(__import__("hashlib").blake2b(pii_key(spark).encode(), digest_size=32).digest())
    assert {r["doc_id"]: r["text"] for r in private} == {r["doc_id"]: names.apply(texts[r["doc_id"]])[0] for r in single}
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in private}
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer())
    tokens = sum(len(model.encode(r["text"], add_special_tokens=False).ids) + 1 for r in mixed)
    assert sum(r["length"] for r in corpus_pipeline.run(spark, TINY).collect()) == tokens
    assert np.all([r["n_chars"] is not None for r in mixed])


ODD = [(1, None, "en", "a"), (2, "", "en", "b"), (3, "word", None, None), (3, "word", None, None), (4, "x " * 30_000, "en", "a"), (None, "a b c d e f", None, ""), (None, "a b c d e f", None, None), (7, " \n\t ", "de", "c")]


def test_stages_over_odd_and_empty_tables(spark, tmp_path):
    names = ["row", "doc", "kept", "copies", "size", "p_low", "text_2"]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([(*r, *[f"{n}-{i}" for n in names]) for i, r in enumerate(ODD)], schema).repartition(3)
    spark.createDataFrame([(1, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    words = lambda rows: sum(len((r["text"] or "").split()) for r in rows)
    stage, sizes = docs, []
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, str(tmp_path)).cache()
        rows = stage.collect()
        assert stage.columns == docs.columns
        assert all(len({r[n].removeprefix(f"{n}-") for n in names}) == 1 for r in rows)
        sizes.append((len(rows), words(rows)))
    # nothing is rejected without usable labels; of the repeated row one stays; rows without words are not mixed
    assert sizes[0] == (8, words(docs.collect())) and sizes[1] == sizes[2] == (7, sizes[0][1] - 1)
    assert {r["doc_id"] for r in stage.collect()} <= {3, 4, None}
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r["length"] for r in last) == sum(r["doc_tokens"] for r in last if r["start"] == 0)
    empty = docs.where("false")
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, empty, str(tmp_path)).count() == 0


def _shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

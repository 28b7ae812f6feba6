"""The pipeline's stages on a small corpus with planted toxic texts, copies and near copies."""

import random

import pytest
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from tallysheet.llm import bpe, simhash
from tests.llm.test_classifiers import FOUL, say


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that each stage returns, and the ids planted."""
    folder, rng = str(tmp_path_factory.mktemp("corpus")), random.Random(9)
    rows, labels, toxic, copies, near = [], [], set(), set(), set()
    for k in range(400):
        text = say(rng, "en", rng.randint(60, 160))
        if k % 5 == 0:
            words = text.split()
            for _ in range(6):
                words.insert(rng.randrange(len(words)), rng.choice(FOUL))
            text = " ".join(words)
            toxic.add(k)
        rows.append((k, text, "en", ["a", "a", "b", None][k % 4], len(text)))
        labels.append((k, 1, int(k % 5 == 0)))
    for k in range(1, 120, 6):
        if k not in toxic:
            rows.append((1000 + k, rows[k][1].replace(" ", "\t"), "en", "a", 0))
            copies.add(1000 + k)
            rows.append((2000 + k, rows[k][1].swapcase(), "en", "b", 0))
            near.add(2000 + k)
    rows.append((3000, None, None, None, None))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/out-{k}")
        docs = spark.read.parquet(f"{folder}/out-{k}")
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        out[name] = docs
    return rows, out, toxic, copies, near


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages(spark, stages):
    rows, out, toxic, copies, near = stages
    every = {r[0] for r in rows}
    clean, single, apart = (ids(out[n]) for n in ("toxicity", "exact dedup", "simhash near-dedup"))
    assert len(toxic & clean) <= 0.1 * len(toxic) and len((every - toxic) - clean) <= 0.02 * len(every)
    # Of equal texts the longest stays, then the smallest id: here the first.
    assert single == clean - copies
    text = {r[0]: r[1] for r in rows}
    prints = {i: simhash.fingerprint(text[i]) for i in single}
    group = {i: i for i in single}
    for i in sorted(single):
        for j in single:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = group[i], group[j]
                low, high = min(a, b), max(a, b)
                group = {k: low if g == high else g for k, g in group.items()}
    assert apart == set(group.values()) and not near & apart
    assert ids(out["mixing"]) <= apart
    most = out["mixing"].groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert most <= 3


def test_the_end_is_the_tokenizers_own(spark, stages):
    rows, out, *_ = stages
    tok, text = tokenizers.Tokenizer.from_file(bpe.default_vocabulary()), {r[0]: r[1] or "" for r in rows}
    got = out["bpe"].collect()
    assert len(got) == out["mixing"].count()
    assert all(r.n_tokens == len(tok.encode(text[r.doc_id], add_special_tokens=False).ids) for r in got)


def test_empty_and_odd_tables(spark, tmp_path):
    """No rows; and nulls, repeated rows and ids, columns with clashing names, no label to learn from."""
    shape = "doc_id long, text string, lang string, source string, n_chars long, id string, hash string"
    odd = [(1, None, None, None, None, "a", "b"), (None, "some words here", "en", "s", 1, "c", "d"), (None, "some words here", "en", "s", 1, "c", "d"), (2, " ", "en", "s", 1, "e", "f"), (3, "word " * 3000, "en", "t", 1, "g", "h"), (3, "other words", "en", "t", 1, "i", "j")]
    for name, rows in (("empty", []), ("odd", odd)):
        folder = str(tmp_path / name)
        spark.createDataFrame(rows, shape).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            before, docs = docs, f(spark, docs, folder)
            assert docs.columns == before.columns
            if name == "odd" and stage == "simhash near-dedup":
                assert {(r.doc_id, r.text and r.text[:5], r.id, r.hash) for r in docs.collect()} == {(2, " ", "e", "f"), (None, "some ", "c", "d"), (3, "word ", "g", "h"), (3, "other", "i", "j")}
        got = corpus_pipeline.run(spark, folder)
        assert (got.count() == 0) == (name == "empty")

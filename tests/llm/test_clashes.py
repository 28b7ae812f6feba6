"""Extra columns with the names that operators use inside come back as they were, and stop no operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallysheet.llm import bpe, embedding_dedup, exact_dedup, filter_audit, html_text, language, merkle, mixing, quality, simhash, suffix_dedup, toxicity
from tallysheet.llm.training import fold
from tests.llm.test_classifiers import corpus  # noqa: F401  a fixture

INSIDE = """__id __label __most __draw __score __source __bucket __of __in __copies __copy __text __part __n __start id label most draw row room size score kept bucket batch digest hash none
alike first least class blocks chars mask part good toxic again f doc data at tag number blob grp leaf tampered print component key chunk found copies copy rank weight cap target of_source in_bucket taken_source taken_bucket
shingle node m a b c d keep_id group_size kept_none kept_id kept_hash words held_out predicted lang_pred fingerprint component_id n_removed step level place path""".split()


@pytest.fixture(scope="module")
def crowded(corpus):  # noqa: F811
    docs, labels = corpus
    own = ["doc_id", "text", "lang", "source", "n_chars"]
    return docs.select(*own, *[F.lit(f"own {c}").alias(c) for c in INSIDE]).repartition(4), labels.select("*", *[F.lit("x").alias(c) for c in INSIDE if c not in labels.columns])


PASSING = {
    "toxicity": lambda d, l: toxicity.without_toxic(d, toxicity.fit_toxicity(d, l, fold("doc_id", 4) != 2), threshold=1.1),
    "exact dedup": lambda d, l: exact_dedup.DigestIndex(d.sparkSession).deduplicate(d),
    "simhash": lambda d, l: simhash.one_of_each(d),
    "mixing": lambda d, l: mixing.mixed(d),
}
SCORING = {
    "op1": lambda d, l: exact_dedup.DigestIndex(d.sparkSession).classify(d),
    "op2": lambda d, l: language.identify(d, language.fit_language(d, fold("doc_id", 4) != 2)),
    "op4": lambda d, l: bpe.digests(bpe.encode_documents(d, bpe.default_vocabulary())),
    "op5": lambda d, l: simhash.near_duplicates(d),
    "op7": lambda d, l: toxicity.score_documents(d, toxicity.fit_toxicity(d, l, fold("doc_id", 4) != 2)),
    "op8": lambda d, l: mixing.plan(d),
    "op9": lambda d, l: quality.score_documents(d, quality.fit_quality(d, l, fold("doc_id", 3) != 1)),
    "op11": lambda d, l: suffix_dedup.removals(d),
    "op12": lambda d, l: merkle.audited(d),
}


@pytest.mark.parametrize("name", PASSING)
def test_rows_pass_unchanged(crowded, name):
    docs, labels = crowded
    got = PASSING[name](docs, labels)
    assert got.columns == docs.columns
    wrong = got.where(~F.forall(F.array(*[F.struct(F.col(f"`{c}`").alias("own"), F.lit(f"own {c}").alias("want")) for c in INSIDE]), lambda x: x["own"] == x["want"]))
    assert got.count() > 300 and wrong.count() == 0


@pytest.mark.parametrize("name", SCORING)
def test_further_columns_are_ignored(crowded, name):
    docs, labels = crowded
    assert SCORING[name](docs, labels).count() == docs.count()


def test_others_ignore_them_too(crowded, spark):
    docs, labels = crowded
    assert filter_audit.audit(docs, labels).count() == 600
    extra = [F.lit(f"own {c}").alias(c) for c in INSIDE if c not in ("label", "vec_id", "page_id")]
    vectors = spark.range(40).select(F.col("id").alias("vec_id"), F.array(F.cos("id"), F.sin("id"), F.lit(1.0)).alias("embedding"), (F.col("id") % 2).alias("label")).select("*", *extra)
    assert embedding_dedup.near_duplicates(vectors).count() == 40
    pages = spark.range(3).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("<p>some words of a page</p>").alias("html")).select("*", *extra)
    assert html_text.extract_pages(pages).count() == 3


def test_stages_are_those_tested_here():
    assert {s for s, _ in corpus_pipeline.STAGES[:4]} == {"toxicity", "exact dedup", "simhash near-dedup", "mixing"}

"""Language, toxicity and quality: accuracy on rows kept back from the fitting, and odd rows."""

import math
import random
import re
from zlib import crc32

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tallysheet.llm import language, quality, toxicity
from tallysheet.llm.training import fold, labelled_sample
from tests.llm.conftest import ODD

#: Syllables of made-up languages.
SOUNDS = {"en": "th er on an re he in ed nd ha at en es of or nt ea ti to it", "fr": "eau oux ai ré que le de la en tion ment ç ê ou ch vi", "de": "sch ung keit ein er ä ö ü pf tz ch der ge be ver ie"}
FOUL = ["zxgrunk", "blarvix", "kwopfel", "snurgle"]


def say(rng, lang, n):
    sounds = SOUNDS[lang].split()
    return " ".join("".join(rng.choice(sounds) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, make_docs):
    rng, rows, labels = random.Random(3), [], []
    for k in range(900):
        lang, toxic, good = rng.choice([*SOUNDS]), int(rng.random() < 0.3), int(rng.random() < 0.6)
        words = say(rng, lang, rng.randint(20, 90)).split()
        if not good:
            words = [w + rng.choice(["", " |", "$$$", "%%"]) for w in words]
        for _ in range(4 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(FOUL) + rng.choice(["", "s", "ed"]))
        rows.append((k, " ".join(words), lang))
        labels.append((k, good, toxic, "x"))
    return make_docs(rows), spark.createDataFrame([*labels, (None, 1, 1, "x"), (5000, None, None, "x")], "doc_id long, quality int, toxic int, score string")


def check_odd(scored, columns):
    got = scored.collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got) and scored.columns[: len(columns)] == columns
    twins = [r for r in got if r.doc_id == 6]
    assert twins[0] == twins[1]
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    return {r.doc_id: r for r in got}


def test_language(spark, corpus, make_docs):
    docs, _ = corpus
    model = language.fit_language(docs, fold("doc_id", 4) != 2)
    assert (model.table == 0).mean() > 0.5  # sparse weights
    got = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert got[0] > 0.97 and got[1] > 150
    by = check_odd(language.identify(make_docs(ODD), model), ["doc_id", "held_out", "lang_pred", "score"])
    assert all(by[k].lang_pred == "und" for k in (1, 2, 3)) and all(by[k].lang_pred in SOUNDS for k in (4, 5, 7, 8, 9))
    assert language.identify(make_docs([]), model).count() == 0
    none = language.fit_language(make_docs([(1, "text")]), fold("doc_id", 4) != 2)
    assert [r.lang_pred for r in language.identify(make_docs([(1, "text")]), none).collect()] == ["und"]


def test_language_temperature_does_not_change_the_choice():
    rng = random.Random(1)
    texts = [say(rng, lang, 12) for lang in SOUNDS for _ in range(60)]
    from tallysheet.llm.training import Sample

    model = language.LanguageModel.fit(Sample(texts, [lang for lang in SOUNDS for _ in range(60)], {}))
    assert 0.05 <= model.temperature <= 20
    before = [model.predict(t) for t in texts]
    model.temperature *= 4
    assert [model.predict(t)[0] for t in texts] == [lang for lang, _ in before]
    assert sum(model.predict(t)[1] for t in texts) < sum(s for _, s in before)


def plain_bucket(points, salt, bits):
    """One word or n-gram at a time: the hash that the models share."""
    mask, base, mix = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
    h = sum((c + 1) * pow(base, i, 1 << 64) for i, c in enumerate(points)) & mask
    return (((h + salt) & mask) * mix & mask) >> (64 - bits)


def test_language_score_is_the_calibrated_softmax_of_the_mean_of_table_entries():
    rng = random.Random(4)
    from tallysheet.llm.training import Sample

    model = language.LanguageModel.fit(Sample([say(rng, lang, 12) for lang in SOUNDS for _ in range(40)], [lang for lang in SOUNDS for _ in range(40)], {}))
    for text in ["a", "one two\tthree", "één tiên 漢字 😀 und mehr", "SCHUNG keit " * 9, "1 2 x"]:
        points = [ord(c) for c in text.lower()]
        found = [plain_bucket(points[i : i + n], n, language.BITS) for n in language.SIZES for i in range(len(points) - n + 1)]
        logits = [(sum(float(model.table[b, k]) for b in found) / len(found) + model.bias[k]) / model.temperature for k in range(len(model.languages))]
        top = max(logits)
        shares = [math.exp(x - top) for x in logits]
        best = max(range(len(shares)), key=shares.__getitem__)
        got = model.predict(text)
        assert got[0] == model.languages[best] and got[1] == pytest.approx(shares[best] / sum(shares), abs=1e-6)


def test_toxicity(spark, corpus, make_docs):
    docs, labels = corpus
    model = toxicity.fit_toxicity(docs, labels, fold("doc_id", 4) != 2)
    got = toxicity.score_documents(docs, model).join(labels, "doc_id").where("held_out").select("toxic", "predicted").collect()
    assert sum(r.toxic == r.predicted for r in got) > 0.95 * len(got) > 150
    by = check_odd(toxicity.score_documents(make_docs(ODD), model), ["doc_id", "held_out", "score", "predicted"])
    assert by[1].score == by[2].score == by[3].score and by[1].predicted == 0
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() < docs.count()
    assert toxicity.score_documents(make_docs([]), model).count() == 0
    flat = toxicity.fit_toxicity(docs, labels.where("toxic = 0"), fold("doc_id", 4) != 2)
    assert toxicity.score_documents(docs, flat).select("score").distinct().count() == 1


def test_quality(spark, corpus, make_docs):
    docs, labels = corpus
    model = quality.fit_quality(docs, labels, fold("doc_id", 3) != 1)
    got = quality.score_documents(docs, model).join(labels, "doc_id").where("held_out").select("quality", "predicted").collect()
    assert sum(r.quality == r.predicted for r in got) > 0.95 * len(got) > 150
    by = check_odd(quality.score_documents(make_docs(ODD), model), ["doc_id", "held_out", "score", "predicted"])
    assert by[1].score == by[2].score
    assert quality.score_documents(make_docs([]), model).count() == 0


def test_quality_score_is_the_softmax_of_the_mean_of_table_entries(corpus):
    """Plain recomputation: each word and each character n-gram, one by one."""
    docs, labels = corpus
    model = quality.fit_quality(docs, labels, fold("doc_id", 3) != 1, {1: 100, 0: 100})
    for text in ["", "a", "word two\tword", "één tiên 漢字 😀 und mehr", "x" * 50, " spaced  out \n lines "]:
        points = [ord(c) for c in text]
        found = [plain_bucket(points[i : i + n], n, quality.BITS) for n in quality.SIZES for i in range(len(points) - n + 1)]
        found += [plain_bucket([ord(c) for c in w], 99, quality.BITS) for w in re.findall("[^ \t-\r]+", text)]
        mean = sum(float(model.table[b]) for b in found) / max(1, len(found))
        assert model.score(text) == pytest.approx(1 / (1 + math.exp(-(mean + model.bias))), abs=1e-6)


def test_sample_is_bounded_and_leaves_out_what_it_cannot_learn_from(spark, make_docs):
    docs = make_docs([(k, f"text number {k} of some words {k * k}") for k in range(400)] + [(400, None), (401, "y" * 60_000)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(402)] + [(7, 0), (7, 1), (None, 1)], "doc_id long, toxic int")
    sample = labelled_sample(docs, labels, "toxic", fold("doc_id", 4) != 2, {0: 50, 1: 1000})
    assert 20 < sample.labels.count(0) < 90 and sample.counts[1] > 100
    assert (crc32(b"401") % 4 == 2 or "y" * 60_000 in sample.texts) and "text number 7 of some words 49" not in sample.texts
    small = labelled_sample(docs, labels, "toxic", fold("doc_id", 4) != 2, {0: 50, 1: 1000}, most=1000)
    assert all(0 < sum(len(t) for t, y in zip(small.texts, small.labels, strict=True) if y == k) <= 500 for k in (0, 1))


def test_a_class_of_long_texts_only_is_learned(spark, make_docs):
    """Texts beyond the share of their label are learned from by some of their pieces."""
    rng = random.Random(8)
    rows = [(k, say(rng, "fr", 40), "fr") for k in range(40)] + [(100 + k, say(rng, "de", 12_000), "de") for k in range(6)]
    docs = make_docs(rows)
    for most in (48 << 20, 30_000):
        sample = labelled_sample(docs, docs, "lang", F.lit(True), 50, most=most)
        assert set(sample.labels) == {"fr", "de"} and sum(map(len, sample.texts)) <= most
    long = [t for t, lang in zip(sample.texts, sample.labels, strict=True) if lang == "de"]
    assert len(long) == 1 and 4096 <= len(long[0]) <= 15_000 and any(long[0][:4096] in t for _, t, lang in rows if lang == "de")
    model = language.fit_language(docs, F.lit(True))
    assert {r.lang_pred for r in language.identify(docs.where("doc_id >= 100"), model).collect()} == {"de"}


def test_toxicity_score_is_that_of_two_dictionaries_window_by_window():
    rng = random.Random(8)
    plain = [say(rng, "en", rng.randint(20, 60)) for _ in range(300)]
    foul = [f"{say(rng, 'en', 30)} {rng.choice(FOUL)} {say(rng, 'en', 20)}" for _ in range(120)]
    from tallysheet.llm.training import Sample

    model = toxicity.ToxicityModel.fit(Sample(plain + foul, [0] * 300 + [1] * 120, {0: 300, 1: 120}))

    def length(dictionary, part):
        parameters = zstandard.ZstdCompressionParameters.from_level(
            6, strategy=zstandard.STRATEGY_BTOPT, min_match=5, search_log=8, hash_log=17, chain_log=17, window_log=18, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS
        )
        held = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=held, compression_params=parameters).compress(part))

    for text in [plain[0], foul[0], say(rng, "de", 17) + " Blarvix", "", " \n"]:
        words, counts = text.encode().lower().split(), [0] * 12
        for i in range(0, len(words), 8):
            part = b" " + b" ".join(words[i : i + 8]) + b" "
            counts[min(11, max(0, length(model.ordinary, part) - length(model.ordinary + model.toxic, part)))] += 1
        n, at_least = max(1, sum(counts)), lambda k, c=counts: sum(c[k:])
        x = [math.log1p(n)]
        for k in (1, 2, 3, 4, 5, 6, 8):
            x += [math.log1p(at_least(k)), min(at_least(k) / n * 20, 3)]
        x += [float(at_least(k) > 0) for k in range(1, 9)]
        logit = sum(w * (v - m) / s for w, v, m, s in zip(model.weights, x, model.mean, model.scale, strict=False)) + model.weights[-1]
        got = model.scores(np.stack([toxicity.Gains(model.ordinary, model.toxic).counts(text)]))[0]
        assert got == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-9)


def test_both_dictionaries_are_trained_and_the_toxic_one_learns_what_toxic_texts_share():
    """Each marker is in a quarter of the toxic texts, three times; nothing else sets them apart."""
    rng = random.Random(5)
    words = say(rng, "en", 400).split()
    spoken = lambda n: " ".join(rng.choices(words, k=n))
    plain = [spoken(60) for _ in range(900)]
    foul = [f"{spoken(20)} {f} {spoken(20)} {f} {spoken(20)} {f}" for f in rng.choices(FOUL, k=400)]
    from tallysheet.llm.training import Sample

    model = toxicity.ToxicityModel.fit(Sample(plain + foul, [0] * 900 + [1] * 400, {0: 900, 1: 400}))
    assert all(d[:4] == b"\x37\xa4\x30\xec" for d in (model.ordinary, model.toxic))  # as zstandard marks them
    assert all(f[:6].encode() in model.toxic and f[:6].encode() not in model.ordinary for f in FOUL)  # a dictionary cuts words off

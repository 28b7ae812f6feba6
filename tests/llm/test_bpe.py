import hashlib
import random

import numpy as np
import pytest

from tallysheet.llm import bpe
from tests.llm.conftest import ODD

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as f:
        return bpe.Codec(f.read()), tokenizers.Tokenizer.from_file(PATH)


def test_same_ids_as_the_library(both):
    own, lib = both
    rnd = random.Random(4)
    alphabets = ["abc", "aAbB 01'\n\t  ", "the an in er on ", "éèñü漢字😀́", "<|endoftext|>", "\x1c\x1d\x85   \x0b", " !?.,;:'s't're"]
    texts = ["".join(rnd.choice("".join(rnd.sample(alphabets, 3))) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    texts += ["a<|endoftext|>b<|endoftext|>", "a" * 4000, " " * 3000, "=" * 2001, "The" * 900, "x" * 50_000]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        got = own.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == ids, t[:80]
        assert own.decode(got) == lib.decode(ids, skip_special_tokens=False) == t


def test_decoding_any_ids(both):
    own, lib = both
    rnd = random.Random(9)
    for _ in range(300):
        ids = [rnd.randrange(50_257) for _ in range(rnd.randint(0, 12))]
        assert own.decode(np.array(ids, "<u4").tobytes()) == lib.decode(ids, skip_special_tokens=False)


def test_documents(spark, make_docs, both):
    got = sorted(bpe.digests(bpe.encode_documents(make_docs(ODD), PATH)).collect(), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in ODD:
        ids = both[1].encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert bpe.encode_documents(make_docs([]), PATH).count() == 0


def test_columns(spark):
    tok = bpe.Tokenizer(spark, PATH)
    rows = spark.createDataFrame([("hello world",), (None,)], "t string").select(tok.encode("t").alias("i")).select("i", tok.decode("i").alias("d")).collect()
    assert len(rows[0].i) == 8 and rows[0].d == "hello world" and rows[1].d == "" and rows[1].i == b""

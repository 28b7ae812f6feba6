"""Byte-level BPE encoding by backtracking, and decoding by an offset table.

A piece of text is covered left to right by the longest tokens that an
Aho-Corasick automaton finds at each position. A token may follow another only
if the two are compatible: merging the bytes of both by rank gives just the two.
Where no token fits, the last one is taken back and a shorter prefix tried. The
one covering of compatible neighbours is the result of the merges, found in
time linear in the piece.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallysheet.llm.common import small_batches

#: The split of text into pieces that byte-level vocabularies of this format prescribe.
#: Fixed value; white space by the Unicode property.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pieces kept with their ids; when full, the store starts anew. Longer pieces aren't kept.
KEPT, LONGEST_KEPT = 1 << 17, 64


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves, the others for the code points from 256 on.
    """
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = iter(range(256, 512))
    return {chr(b if b in plain else next(rest)): b for b in range(256)}


class Codec:
    """Encoder and decoder of one vocabulary in the format of the tokenizers library.

    Tokens are numbered here by their merges: a byte by its value, the token
    that merge k makes 256 + k. A number is so also the order of the merges.
    """

    def __init__(self, content: bytes):
        spec = json.loads(content)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        strings = [*letters, *(a + b for a, b in merges)]
        strings[:256] = sorted(letters, key=letters.get)
        number = {s: k for k, s in enumerate(strings)}
        self.ids = [vocab[s] for s in strings]
        self.parts = [(k, k) for k in range(256)] + [(number[a], number[b]) for a, b in merges]
        self.merge = {pair: 256 + k for k, pair in enumerate(self.parts[256:])}
        raw = [bytes(letters[c] for c in s) for s in strings]
        self.lengths = [len(r) for r in raw]
        of = {r: k for k, r in enumerate(raw)}
        self.shorter = [next((of[r[:n]] for n in range(len(r) - 1, 0, -1) if r[:n] in of), None) for r in raw]
        self.automaton = ahocorasick.Automaton()
        for k, r in enumerate(raw):
            self.automaton.add_word(r.decode("latin-1"), k)
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.cut = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.split = regex.compile(PIECES).findall
        self.pieces = Pieces(self)
        texts = {i: r for i, r in zip(self.ids, raw, strict=True)} | {i: t.encode() for t, i in self.special.items()}
        ordered = [texts.get(i, b"") for i in range(max(texts) + 1)]
        self.width = np.array([len(t) for t in ordered], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.width)[:-1]])
        self.bytes = np.frombuffer(b"".join(ordered), np.uint8)

    def spine(self, token: int, side: int) -> list[int]:
        """The tokens along one edge of a token's merges, the byte first."""
        out = [token]
        while token >= 256:
            token = self.parts[token][side]
            out.append(token)
        return out[::-1]

    def fits(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border between two neighbouring tokens.

        A crossing pair merges if it comes before the merges that use up its two
        halves; of equal merges the one further left comes first.
        """
        known = self.compatible.get((left, right))
        if known is None:
            a, b = self.spine(left, 1), self.spine(right, 0)
            i = j = 0
            known = True
            while known:
                made = self.merge.get((a[i], b[j]))
                ends_a, ends_b = (s[k + 1] if k + 1 < len(s) else None for s, k in ((a, i), (b, j)))
                known = made is None or (ends_a is not None and ends_a <= made) or (ends_b is not None and ends_b < made)
                if ends_a is None and ends_b is None:
                    break
                if ends_b is None or (ends_a is not None and ends_a <= ends_b):
                    i += 1
                else:
                    j += 1
            if len(self.compatible) >= KEPT:
                self.compatible.clear()
            self.compatible[left, right] = known
        return known

    def cover(self, piece: bytes) -> list[int]:
        """Vocabulary ids of one piece."""
        n, lengths = len(piece), self.lengths
        longest: list[int | None] = [None] * n
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - lengths[token]] = token  # a later end is a longer token
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while token is not None and (dead[at + lengths[token]] or (out and not self.fits(out[-1], token))):
                token = self.shorter[token]
            if token is None:
                dead[at] = 1
                token = out.pop()
                at -= lengths[token]
                token = self.shorter[token]
            else:
                out.append(token)
                at += lengths[token]
                token = longest[at] if at < n else None
        return [self.ids[k] for k in out]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        get = self.pieces.__getitem__
        if self.cut is None or not any(t in text for t in self.special):
            return b"".join(map(get, self.split(text)))
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [*map(get, self.split(text[at : m.start()])), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, *map(get, self.split(text[at:]))])

    def decode(self, ids: bytes) -> str:
        """The text of ids in the form that :meth:`encode` gives; bytes that aren't UTF-8 become U+FFFD."""
        k = np.frombuffer(ids, "<u4")
        width = self.width[k]
        end = np.cumsum(width)
        at = np.repeat(self.offset[k] - (end - width), width) + np.arange(end[-1] if len(end) else 0)
        return self.bytes[at].tobytes().decode("utf-8", "replace")


class Pieces(dict):
    """Ids of the pieces met so far; a new piece is encoded when asked for."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        found = np.array(self.codec.cover(piece.encode()), "<u4").tobytes()
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = found
        return found


_held: dict[str, Codec] = {}


def codec(shared: Broadcast) -> Codec:
    """The codec of a broadcast vocabulary file, built once in each Python worker."""
    digest = hashlib.sha256(shared.value).hexdigest()
    if digest not in _held:
        _held[digest] = Codec(shared.value)
    return _held[digest]


class Tokenizer:
    """Columns that encode and decode by the vocabulary in the file ``path``.

    The driver reads the file and broadcasts it (a vocabulary, of fixed size).
    """

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as f:
            shared = spark.sparkContext.broadcast(f.read())

        @F.pandas_udf(T.BinaryType())
        def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            own = codec(shared)
            for batch in texts:
                yield pd.Series([own.encode(t or "") for t in batch], dtype=object)

        @F.pandas_udf(T.StringType())
        def decode(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
            own = codec(shared)
            for batch in ids:
                yield pd.Series([own.decode(b or b"") for b in batch], dtype=object)

        @F.pandas_udf("token_ids binary, decoded string")
        def both(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            own = codec(shared)
            for batch in texts:
                ids = [own.encode(t or "") for t in batch]
                yield pd.DataFrame({"token_ids": pd.Series(ids, dtype=object), "decoded": pd.Series([own.decode(b) for b in ids], dtype=object)})

        small_batches(spark)
        self._encode, self._decode, self._both = encode, decode, both

    def encode(self, text: Column | str) -> Column:
        """Ids of a text as little-endian unsigned 32-bit integers in a binary; null counts as empty."""
        return self._encode(text)

    def decode(self, ids: Column | str) -> Column:
        """The text of such a binary; null counts as no ids."""
        return self._decode(ids)

    def round_trip(self, text: Column | str) -> Column:
        """Both, as ``struct<token_ids, decoded>``: the ids of a text and the text of those ids."""
        return self._both(text)


def encode_documents(docs: DataFrame, path: str, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, token_ids (binary), decoded``.

    Null and empty texts have no tokens and decode to the empty text. Special
    tokens' strings in a text become those tokens. Rows alike stay apart; an
    empty table gives no rows; further columns are ignored.
    """
    tok = Tokenizer(docs.sparkSession, path)
    coded = docs.select(F.col(row_id).cast("long").alias("doc_id"), tok.round_trip(F.col(text).cast("string")).alias("coded"))
    return coded.select("doc_id", "coded.token_ids", "coded.decoded")


def digests(coded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of encoded documents."""
    return coded.select("doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every document's token count and the digests of its ids and of their text."""
    return digests(encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary()))

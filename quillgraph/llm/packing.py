"""Packing by power-of-two decomposition.

Pouransari et al., "Dataset decomposition" (2024): a document of n tokens is cut
into floor(n / 4096) pieces of 4096 tokens and one piece for each bit that is
set in the rest, longest first. Every piece is a sequence of its own, so no
sequence crosses documents and none holds padding; sequences of one length form
a bucket from which batches are drawn.

Words between ASCII white space are tokenised once a worker while they stay in a
bounded cache: the tokenizer drops white space and never looks across it, so a
text's ids are its words' ids one after another.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, batches_of_texts, held, ship, tidy

VOCABULARY = "word_bpe_49k.json"


class WordTokenizer:
    """Ids of whole texts, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, cached_words: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.words = Recent(cached_words)
        self.ends = np.zeros(self.library.get_vocab_size(with_added_tokens=True), bool)
        self.sizes = np.zeros(len(self.ends), np.int64)  # in bytes, for each of which a token has a character
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            self.ends[i] = token.endswith("</w>")
            self.sizes[i] = len(token.removesuffix("</w>"))
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall

    def together(self, words: list[bytes]) -> list[bytes]:
        """The words' ids, from one call: the tokenizer's own words each end in a
        token with the end mark, so that a word's share is found by counting them, and
        must have as many bytes as the word. Where that isn't so (special tokens, texts
        that the normal form changes) each word is a text of its own."""
        texts = [w.decode("utf-8", "replace") for w in words]
        whole = " ".join(texts)
        if "<|" not in whole and "\u0130" not in whole and unicodedata.is_normalized("NFC", whole):
            shares = [1 if t.isalpha() else len(self.split(t.lower())) for t in texts]
            ids = np.array(self.library.encode_batch_fast([whole], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == sum(shares):
                stops = np.r_[0, np.r_[0, ends][np.cumsum(shares)]]
                sizes = np.diff(np.r_[0, np.cumsum(self.sizes[ids])][stops])
                if sizes.tolist() == [len(t.lower().encode()) for t in texts]:
                    packed, stops = ids.tobytes(), (4 * stops).tolist()
                    return [packed[a:b] for a, b in zip(stops, stops[1:])]
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        words = [x.split() for x in texts]
        missing = self.words.missing(set().union(*words))
        for at in range(0, len(missing), 1000):
            part = missing[at : at + 1000]
            self.words.young.update(zip(part, self.together(part), strict=True))
        get = self.words.young.__getitem__
        return [b"".join(map(get, x)) for x in words]


def word_tokenizer(path: str) -> WordTokenizer:
    return held(WordTokenizer, path)


def piece_lengths(n: int, limit: int = 4096) -> list[int]:
    """limit, limit, ..., then the set bits of the rest, longest first."""
    rest = n % limit
    return [limit] * (n // limit) + [1 << i for i in range(rest.bit_length() - 1, -1, -1) if rest >> i & 1]


def pack(docs: DataFrame, path: str | None = None, end_id: int = 2, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids (binary, little-endian unsigned 32-bit),
    doc_tokens, bucket, sequence_id, offset: a row a piece; ``bucket`` is the binary
    logarithm of its length.

    Every document ends in ``end_id``, so a null or empty text is one piece of
    one token. Null and repeated ids and repeated rows are documents of their
    own, which get sequences of their own; an empty table gives no rows; other
    columns are ignored. One pass, no shuffle: sequence ids are made of the
    partition and the piece's place in it. ``write_buckets`` has the buckets as
    folders.
    """
    if limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    path = path or public_tokenizers.path(VOCABULARY)
    ship(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long"

    def run(batches):
        tokenizer = word_tokenizer(path)
        for doc_ids, texts in batches_of_texts(batches, 4 << 20):
            doc, start, length, ids, total = [], [], [], [], []
            for i, packed in enumerate(tokenizer.encode(texts)):
                packed += end
                n, at = len(packed) // 4, 0
                for size in piece_lengths(n, limit):
                    doc.append(i)
                    start.append(at)
                    length.append(size)
                    ids.append(packed[4 * at : 4 * (at + size)])
                    total.append(n)
                    at += size
            yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(doc, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64())], names=["doc_id", "start", "length", "ids", "doc_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), schema).withColumn("bucket", F.round(F.log2("length")).cast("int")).withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Pieces of equal lengths together: a folder a bucket, so that a training step that
    reads one has sequences of one length. No shuffle: each task writes its own files."""
    pieces.write.partitionBy("bucket").parquet(path)

"""Quality rules by tokeniser fertility, on top of a few word rules.

A public vocabulary is a yardstick for text: prose in a language that it covers
splits into tokens of a typical length, hardly ever falls back to single bytes
and uses many different tokens. Each document gets its characters per token under
each of two vocabularies (pieces with byte fallback; bytes, made for many
languages), and under the first also letters and digits per token, the share of
byte-fallback tokens and the entropy of its token distribution; the bands of its
language (or, without a known one, of its script) decide.

Words between ASCII white space are tokenised one by one and cached a worker, so
a figure belongs to a word wherever it stands.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of_texts, held, ship, tidy

VOCABULARY, OTHER = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"
SYMBOLS = b"#*$%&|<>"
#: First bytes of characters beyond U+07FF, outside Latin, Greek, Cyrillic, Hebrew and Arabic.
WIDE = bytes(range(0xE0, 0xF5))


@dataclass(frozen=True)
class Band:
    """A document outside is rejected."""

    letters_per_token: tuple[float, float]
    most_fallback: float
    least_entropy: float
    chars_per_token: tuple[float, float]
    other_chars_per_token: tuple[float, float]


#: The least figures a token are ``lower_bounds`` of sf0.1. Prose that is labelled
#: clean has 5.5 bits of entropy and more and no fallback. Rows of other languages
#: are judged by script, with wide bands.
BANDS = {
    "en": Band((1.91, 6.0), 0.05, 4.5, (1.85, 7.0), (1.98, 7.0)),
    "fr": Band((1.63, 6.0), 0.05, 4.5, (1.71, 7.0), (1.86, 7.0)),
    "de": Band((1.97, 6.0), 0.05, 4.5, (2.04, 7.0), (2.15, 7.0)),
    "es": Band((1.75, 6.0), 0.05, 4.5, (1.80, 7.0), (1.91, 7.0)),
    "latin": Band((1.20, 7.0), 0.10, 4.0, (1.20, 9.0), (1.20, 9.0)),
    "other": Band((0.20, 7.0), 0.95, 3.0, (0.20, 9.0), (0.20, 9.0)),
}


class Fertility:
    """Figures of words, cached, and of texts."""

    def __init__(self, path: str, other: str, cached_words: int = 300_000):
        import sentencepiece
        import tiktoken

        with open(other, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.other = tiktoken.Encoding("other", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.other_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.other_bytes[list(ranks.values())] = list(map(len, ranks))
        self.alnum = np.array([chr(c).isalnum() for c in range(0x110000)])
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.fallback = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.cached_words = cached_words
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.int32)  # of all words, one after another
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.chars = np.zeros(0, np.int64)
        self.letters = np.zeros(0, np.int64)
        self.other_tokens = np.zeros(0, np.int64)

    def learn(self, words: list[bytes]) -> None:
        texts = [w.decode("utf-8", "replace") for w in words]
        self.index.update(zip(words, range(len(self.sizes), len(self.sizes) + len(words)), strict=True))
        ids = self.model.encode(texts, num_threads=1)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.starts = np.r_[self.starts, len(self.ids) + np.cumsum(sizes) - sizes]
        self.sizes = np.r_[self.sizes, sizes]
        self.ids = np.r_[self.ids, np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))]
        # all words as one text, each behind a space, where a new token begins
        joined = "".join([f" {x}" for x in texts])
        chars = np.fromiter(map(len, texts), np.int64, len(texts))
        letters = np.add.reduceat(self.alnum[np.frombuffer(joined.encode("utf-32-le"), np.uint32)].astype(np.int64), np.cumsum(chars + 1) - (chars + 1))
        ends = np.cumsum(np.fromiter((len(x.encode()) + 1 for x in texts), np.int64, len(texts)))
        tokens = np.searchsorted(np.cumsum(self.other_bytes[np.array(self.other(joined), np.int64)]), ends, "right")
        self.chars, self.letters = np.r_[self.chars, chars], np.r_[self.letters, letters]
        self.other_tokens = np.r_[self.other_tokens, np.diff(np.r_[0, tokens])]

    def figures(self, texts: list[bytes]):
        """Per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
        n_tokens, characters a token under either vocabulary, letters and digits
        a token, fallback share, entropy, whether most characters are of a script
        that needs at most two bytes each."""
        words = [x.split() for x in texts]
        if len(self.sizes) > self.cached_words:
            self.clear()
        missing = list(set().union(*words).difference(self.index)) if words else []
        for at in range(0, len(missing), 50_000):
            self.learn(missing[at : at + 50_000])
        n_words = np.fromiter(map(len, words), np.int64, len(words))
        every = np.fromiter(map(self.index.__getitem__, chain.from_iterable(words)), np.int64, int(n_words.sum()))
        sizes = self.sizes[every]
        stops = np.cumsum(sizes)
        tokens = self.ids[np.repeat(self.starts[every] - (stops - sizes), sizes) + np.arange(int(sizes.sum()))]
        word_cuts = np.r_[0, np.cumsum(n_words)]
        token_cuts = np.r_[0, stops][word_cuts].tolist()
        word_cuts = word_cuts.tolist()
        for i, (text, own) in enumerate(zip(texts, words, strict=True)):
            index, ids = every[word_cuts[i] : word_cuts[i + 1]], tokens[token_cuts[i] : token_cuts[i + 1]]
            n = len(ids)
            ordered = np.sort(ids)
            held = np.diff(np.r_[np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]), n]) if n else ids
            entropy = float(np.log2(n) - (held * np.log2(held)).sum() / n) if n else 0.0
            lines = [x for x in text.split(b"\n") if x.strip()] if b"\n" in text else []
            chars = int(self.chars[index].sum())
            wide = len(text) - len(text.translate(None, WIDE)) if not text.isascii() else 0
            yield (len(own), chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated(index), n, chars / n if n else 0.0, chars / int(self.other_tokens[index].sum()) if n else 0.0, self.letters[index].sum() / n if n else 0.0, float(self.fallback[ids].sum() / n) if n else 0.0, entropy, 2 * wide < chars)


def repeated(index: np.ndarray, window: int = 3) -> int:
    """Words that stand in a window of words which the text holds twice or more."""
    n = len(index) - window + 1
    if n < 2:
        return 0
    _, code = np.unique(index, return_inverse=True)
    key = code[:n]
    for i in range(1, window):
        _, key = np.unique(key * (int(code.max()) + 1) + code[i : n + i], return_inverse=True)
    twice = np.bincount(key)[key] > 1
    covered = np.zeros(len(index), bool)
    for i in range(window):
        covered[i : n + i] |= twice
    return int(covered.sum())


def fertility(path: str, other: str) -> Fertility:
    return held(Fertility, path, other)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_tokens long, chars_per_token double, other_chars_per_token double, letters_per_token double, fallback_share double, token_entropy double, band string, kept boolean"
FIGURES = [x.split()[0] for x in SCHEMA.split(", ")]


def judged(docs: DataFrame, bands: dict[str, Band] | None, path: str | None, other: str | None, id_col: str, text_col: str, lang_col: str, carry: list[str]) -> DataFrame:
    """The columns of ``SCHEMA``, then those of ``carry`` as carried_0, carried_1, ..."""
    path, other, bands = path or public_tokenizers.path(VOCABULARY), other or public_tokenizers.path(OTHER), bands or BANDS
    ship(docs.sparkSession)
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    carried = [f"carried_{i}" for i in range(len(carry))]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), lang.alias("lang"), *[F.col(c).alias(to) for c, to in zip(carry, carried, strict=True)])
    schema = SCHEMA + "".join(f", {to} {docs.schema[c].dataType.simpleString()}" for c, to in zip(carry, carried, strict=True))

    def run(batches):
        own = fertility(path, other)
        for batch in batches:
            at = 0
            for doc_ids, texts in batches_of_texts([batch], 4 << 20):
                langs = batch.column(2).slice(at, len(texts)).to_pylist()
                out = []
                for code, (n_words, chars, symbols, dup, rep, n, per, other_per, letters, share, entropy, latin) in zip(langs, own.figures(texts), strict=True):
                    failed = n_words < 50 or 100 * rep > 50 * n_words
                    name = code if code in bands else "latin" if latin else "other"
                    band = bands[name]
                    ranges = ((letters, band.letters_per_token), (per, band.chars_per_token), (other_per, band.other_chars_per_token))
                    fits = all(least <= x <= most for x, (least, most) in ranges) and share <= band.most_fallback and entropy >= band.least_entropy
                    out.append((n_words, chars, symbols, dup, rep, failed, n, per, other_per, letters, share, entropy, name, fits and not failed))
                types = [pa.int64()] * 5 + [pa.bool_(), pa.int64()] + [pa.float64()] * 5 + [pa.string(), pa.bool_()]
                columns = [doc_ids, *(pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)), *(c.slice(at, len(texts)) for c in batch.columns[3:])]
                yield pa.RecordBatch.from_arrays(columns, FIGURES + carried)
                at += len(texts)

    return rows.mapInArrow(tidy(run), schema)


def quality(docs: DataFrame, bands: dict[str, Band] | None = None, path: str | None = None, other: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The figures of ``SCHEMA`` for each row.

    ``base_failed``: under 50 words, or more than half of the words in repeated
    three-word windows. ``kept``: neither that nor outside the band of the row's
    language, or of its script where the language is null, unknown or no column
    of the table. Null or empty texts have no words and are not kept. Null or
    repeated ids and repeated rows are rows of their own; an empty table gives no
    rows; other columns are ignored. One pass, no shuffle.
    """
    return judged(docs, bands, path, other, id_col, text_col, lang_col, [])


def kept_rows(docs: DataFrame, bands: dict[str, Band] | None = None, path: str | None = None, other: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with all their columns, whatever
    these are called."""
    names = docs.columns
    found = judged(docs, bands, path, other, id_col, text_col, lang_col, names).where("kept")
    return found.select(*[F.col(f"carried_{i}").alias(c) for i, c in enumerate(names)])


def lower_bounds(figures: DataFrame, labels: DataFrame, share: float = 0.001) -> DataFrame:
    """band, least, least_chars, least_other_chars: the letters a token that a ``share``
    of clean prose (quality 1, base rules passed, even ids; odd ones are held out) lies
    below, and the least characters a token of clean prose, to two decimals down."""
    rows = figures.where("not base_failed and doc_id % 2 = 0").join(labels.where("quality = 1").select("doc_id"), "doc_id")
    least = {"least": F.percentile("letters_per_token", F.lit(share)), "least_chars": F.min("chars_per_token"), "least_other_chars": F.min("other_chars_per_token")}
    return rows.groupBy("band").agg(*[(F.floor(100 * c) / 100).alias(name) for name, c in least.items()])

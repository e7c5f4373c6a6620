"""Splitting texts into overlapping chunks."""

from __future__ import annotations

import re
from collections import deque
from typing import ClassVar

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .state import spread

SEPARATORS = ("\n\n", "\n", " ", "")
_word = re.compile(r"[^\W]+")


def token_length(text: str) -> int:
    """Offline stand-in for a model's token count: words."""
    return len(_word.findall(text))


class Subwords:
    """Length in the tokens of a model's vocabulary (a tokenizers file), without special
    ones: what an embedding model with that vocabulary would see. Each Python worker loads
    the file once; it must be where the workers can read it."""

    loaded: ClassVar[dict] = {}

    def __init__(self, path: str):
        self.path = path

    def __call__(self, text: str) -> int:
        if self.path not in self.loaded:
            from tokenizers import Tokenizer

            self.loaded[self.path] = Tokenizer.from_file(self.path)
            self.loaded[self.path].no_truncation()
        return len(self.loaded[self.path].encode(text, add_special_tokens=False).ids)


def split(text: str, size: int = 510, overlap: int = 50, length=token_length, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` by ``length``, cut at the coarsest separator that
    does it, each starting with up to ``overlap`` of the one before. A piece that no
    separator cuts is cut by characters."""
    at = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    sep, finer = separators[at], separators[at + 1 :]
    pieces = [p for p in (text.split(sep) if sep else list(text)) if p]
    chunks: list[str] = []
    held: deque[tuple[str, int]] = deque()
    total = 0

    def close() -> None:
        nonlocal held, total
        whole = sep.join(p for p, _ in held).strip()
        if whole:
            chunks.append(whole)
        while held and total > overlap:
            total -= held.popleft()[1]

    for piece in pieces:
        n = length(piece)
        if n > size and finer:
            if held:
                close()
                held, total = deque(), 0
            chunks += split(piece, size, overlap, length, finer)
            continue
        if held and total + n > size:
            close()
            while held and total + n > size:
                total -= held.popleft()[1]
        held.append((piece, n))
        total += n
    if held:
        whole = sep.join(p for p, _ in held).strip()
        if whole:
            chunks.append(whole)
    return chunks


def pieces(text: Column, size: int = 510, overlap: int = 50, length=token_length) -> Column:
    """(pieces, problem): a text that can't be split has no pieces but the reason."""

    @F.pandas_udf("pieces array<string>, problem string")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            try:
                rows.append((split(t, size, overlap, length) if t and t.strip() else [], None))
            except Exception as e:  # one document's failure isn't the batch's
                rows.append(([], f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["pieces", "problem"])

    return run(text)


def chunks(docs: DataFrame, size: int = 510, overlap: int = 50, id_col: str = "doc_id", length=token_length, keep_problems: bool = False) -> DataFrame:
    """id, doc_id, language, index, text: a row a chunk, from the Arabic text if
    there is any, else the English one. Blank documents give none. A document that
    can't be split gives an error or, with ``keep_problems``, a row with its
    ``problem`` and no text."""
    lang, text = T.chunk_source(F.col("contentAr"), F.col("contentEn"))
    rows = spread(docs).select(F.col(id_col).alias("doc_id"), lang.alias("language"), text.alias("body")).where(F.col("language").isNotNull())
    cut = rows.select("doc_id", "language", pieces(F.col("body"), size, overlap, length).alias("p"))
    problem = F.col("p.problem") if keep_problems else F.when(F.col("p.problem").isNotNull(), F.raise_error(F.col("p.problem")).cast("string"))
    each = cut.select("doc_id", "language", problem.alias("problem"), F.explode_outer(F.transform("p.pieces", lambda x, i: F.struct(i.alias("index"), x.alias("text")))).alias("c"))
    each = each.where("problem is not null or c.index is not null").select(F.concat_ws("-", "doc_id", "language", "c.index").alias("id"), "doc_id", "language", F.col("c.index").cast("long").alias("index"), "c.text", "problem")
    return each if keep_problems else each.drop("problem")

"""Fill-in-middle transformation over code-point offsets.

Bavarian et al., "Efficient training of language models to fill in the middle" (2022).
A document is cut at two drawn places into prefix, middle and suffix, which are put
in another order behind sentinels (prefix-suffix-middle, or suffix first).

Units and places come from the tokenizers library: a ``Split`` pre-tokenizer that
isolates every match of a regex gives the matches' offsets in code points, and needs no
training. The number of offsets is n, and the offset of a rank is where to cut. As the
library takes 2 microseconds a match and keeps an object for each, offsets are made in
steps: matches of 4,096 code points, of 64 inside one of those, and single ones inside
one of these. Each step isolates the next units left to right, so ranks are the same.
The library is given at most ``WINDOW`` code points at a time.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of_texts, held, ship, tidy

STEPS = (4096, 64, 1)
WINDOW = 16 * STEPS[0]


@dataclass(frozen=True)
class Sentinels:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


class Ruler:
    """Ranks of a text's units and their code-point offsets."""

    def __init__(self, steps: tuple[int, ...] = STEPS):
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        self.steps = [(k, Split(Regex("[\\s\\S]" if k == 1 else f"[\\s\\S]{{1,{k}}}"), "isolated").pre_tokenize_str) for k in steps]

    def coarse(self, text: str) -> list[tuple[str, int]]:
        """(piece, offset) of the first step's matches."""
        cut = self.steps[0][1]
        return [(piece, at + start) for at in range(0, len(text), WINDOW) for piece, (start, _) in cut(text[at : at + WINDOW])]

    def count(self, coarse: list[tuple[str, int]]) -> int:
        """n: whole matches of each step, then the single ones of the rest."""
        if not coarse:
            return 0
        n, rest = self.steps[0][0] * (len(coarse) - 1), coarse[-1][0]
        for k, cut in self.steps[1:]:
            pieces = cut(rest)
            n, rest = n + k * (len(pieces) - 1), pieces[-1][0]
        return n + 1

    def offset(self, coarse: list[tuple[str, int]], rank: int) -> int:
        """Where unit ``rank`` starts; the end of the text for n."""
        i, rank = divmod(rank, self.steps[0][0])
        if i == len(coarse):  # n, and a whole number of matches
            return coarse[-1][1] + self.steps[0][0] if coarse else 0
        piece, at = coarse[i]
        for k, cut in self.steps[1:]:
            pieces = cut(piece)
            i, rank = divmod(rank, k)
            if i == len(pieces):
                return at + pieces[-1][1][1]
            piece, at = pieces[i][0], at + pieces[i][1][0]
        return at


def draws(seed: int, doc_id: int | None) -> list[int]:
    """The first four 8-digit groups of the hex sha256 of ``seed:doc_id``; a null id is no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def fill_in_middle(docs: DataFrame, seed: int = 1, rate: int = 90, spm: int = 20, sentinels: Sentinels | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: a row a document.

    ``rate`` percent of documents are transformed, ``spm`` percent of those suffix
    first. A text that is null or empty, or has a sentinel in it, stays as it is (form
    plain, without the two lengths). Repeated rows are treated alike, as draws come from
    the id; rows of one null id draw alike; an empty table gives no rows; other columns
    are ignored. One pass, no shuffle; memory follows one batch of texts, of 8 MB or
    one text.
    """
    marks = sentinels or Sentinels()
    ship(docs.sparkSession)
    p, s, m = marks.all()
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

    def run(batches):
        ruler = held(Ruler)
        for ids, texts in batches_of_texts(batches, 8 << 20):
            rows = []
            for doc_id, data in zip(ids.to_pylist(), texts):
                text = data.decode("utf-8", "replace")
                coarse = ruler.coarse(text)
                n = ruler.count(coarse)
                h1, h2, h3, h4 = draws(seed, doc_id)
                if not text or any(x in text for x in marks.all()) or h3 % 100 >= rate:
                    rows.append((n, "plain", None, None, text))
                    continue
                first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
                a, b = ruler.offset(coarse, first), ruler.offset(coarse, second)
                if h4 % 100 < spm:
                    rows.append((n, "spm", first, second - first, f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}"))
                else:
                    rows.append((n, "psm", first, second - first, f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"))
            n, form, prefix, middle, output = zip(*rows)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), schema)


def restored(output: Column, form: Column, sentinels: Sentinels | None = None) -> Column:
    """The text that an output was made of. A transformed text has no sentinel of its
    own, so the first of each kind is the one that was put in."""
    p, s, m = (sentinels or Sentinels()).all()

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substr(output, F.lit(len(first) + 1))
        at = F.locate(second, rest)
        after = F.substr(rest, at + F.lit(len(second)))
        end = F.locate(m, after)
        return F.substr(rest, F.lit(1), at - F.lit(1)), F.substr(after, F.lit(1), end - F.lit(1)), F.substr(after, end + F.lit(len(m)))

    prefix, suffix, middle = parts(p, s)
    other_suffix, other_prefix, other_middle = parts(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(other_prefix, other_middle, other_suffix)).otherwise(output)

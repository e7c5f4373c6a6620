"""Exact token counts at every prefix by dynamic programming.

A BPE encoding of a prefix extends that of a shorter one by one token: the last
token t of the prefix of length j is the only one such that t fits behind the
last token of the prefix of length j - len(t), where "t fits behind u" means
that encoding the two together gives u, t. So

    last[j]  = that t,   count[j] = count[j - len(t)] + 1

and every prefix of every word has its count after one walk along the word. The
last character of a text's word carries an end mark, so each prefix also has a
final token with the mark: ``counts[j]`` is the number of tokens that the text
has if it is cut there. Truncation ("the longest prefix of at most b tokens") and
budget questions are then look-ups.

Words sorted one after another share the walk along their common prefix. A text
keeps the count at the end of each word; inside a word the walk gives the rest.

Counts are of the normalised text. Where its characters don't stand one for one for
those of the text (decomposed accents, U+0130), the text falls into segments that
normalise on their own, and a cut inside a segment goes on, for a few characters,
from the walk's state at the segment's start (``Trail``). Nothing is encoded anew.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, batches_of_texts, held, ship, tidy

VOCABULARY = "word_bpe_49k.json"
END = "</w>"
NEVER = 1 << 60


def byte_units() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte:
    printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(plain))
    return [x for _, x in sorted([(b, chr(b)) for b in plain] + [(b, chr(256 + i)) for i, b in enumerate(others)])]


@cache
def seconds() -> frozenset[str]:
    """Characters that composition may join to what stands before them."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    return frozenset(chr(int(x[1], 16)) for x in pairs if len(x) == 2 and not x[0].startswith("<")) | frozenset(map(chr, (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))))


def segments(text: str) -> list[str]:
    """The text cut where normalising (NFC) can't reach across."""
    joins = seconds()
    starts = [i for i, c in enumerate(text) if not i or not (c in joins or unicodedata.combining(c))]
    return [text[i:j] for i, j in zip(starts, [*starts[1:], len(text)])]


class PrefixCounter:
    """Prefix token counts of words, of texts, and what follows from them."""

    def __init__(self, path: str, cached_words: int = 300_000, cached_fits: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"] for t in spec["added_tokens"]}
        self.apart = re.compile("(" + "|".join([*(re.escape(t) for t in sorted(self.special, key=len, reverse=True)), "[\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"]) + ")").split
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.ranks = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.made = {a + b: ((a, b), i) for i, (a, b) in enumerate(merges)}
        if len(self.made) != len(merges):
            raise ValueError("a token that two merges make has no single derivation")
        self.rights: dict[str, list[tuple[str, int]]] = {}
        self.lefts: dict[str, list[tuple[str, int]]] = {}
        self.inner, self.outer = ahocorasick.Automaton(), ahocorasick.Automaton()
        for t in spec["model"]["vocab"]:
            if t not in self.special:
                (self.outer if t.endswith(END) else self.inner).add_word(t.removesuffix(END), t)
        self.inner.make_automaton()
        self.outer.make_automaton()
        self.ended = {t for t in spec["model"]["vocab"] if t.endswith(END)}
        self.longest = max(len(t.removesuffix(END)) for t in self.ended)
        self.longest_unit = max(map(len, spec["model"]["vocab"]))
        self.byte_of = {u: b for b, u in enumerate(byte_units())}
        self.unit_of = {b: u for u, b in self.byte_of.items()}
        self.fits: dict[tuple[str, str], bool] = {}
        self.words = Recent(cached_words)
        self.cached_fits = cached_fits
        self.normal_chars: dict[str, str] = {}
        self.split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall

    def fit(self, u: str, t: str) -> bool:
        """Whether encoding the bytes of u and t together gives u, t.

        Merging goes by rank, so at any moment the tokens at the boundary are one
        of u's right edge and one of t's left edge. They merge across it if their
        own pair comes before either is taken into the next token of its edge; of
        equal ranks the leftmost goes first."""
        right, left = self.right_edge(u), self.left_edge(t)
        i = j = 0
        while True:
            (x, taken_x), (y, taken_y) = right[i], left[j]
            across = self.ranks.get((x, y), NEVER)
            if across < taken_x and across <= taken_y and across != NEVER:
                return False
            if taken_x == NEVER and taken_y == NEVER:
                return True
            if taken_x <= taken_y:
                i += 1
            else:
                j += 1

    def right_edge(self, t: str) -> list[tuple[str, int]]:
        """The tokens that end t as merging makes it, each with the rank that takes
        it into the next."""
        if t not in self.rights:
            made = self.made.get(t)
            if made is None:
                self.rights[t] = [(t, NEVER)]
            else:
                (_, b), rank = made
                own = self.right_edge(b)
                self.rights[t] = [*own[:-1], (b, rank), (t, NEVER)]
        return self.rights[t]

    def left_edge(self, t: str) -> list[tuple[str, int]]:
        if t not in self.lefts:
            made = self.made.get(t)
            if made is None:
                self.lefts[t] = [(t, NEVER)]
            else:
                (a, _), rank = made
                own = self.left_edge(a)
                self.lefts[t] = [*own[:-1], (a, rank), (t, NEVER)]
        return self.lefts[t]

    def walk(self, words: list[str]):
        """(word, tokens of the word as the end of a text) for each word of byte
        units, of which those in sorted order share their beginnings."""
        last, count = [""], [0]
        before = ""
        fits, fit, ended, longest = self.fits, self.fit, self.ended, self.longest
        for word in words:
            shared = len(os.path.commonprefix((before, word)))
            del last[shared + 1 :], count[shared + 1 :]
            n, made = len(word), shared
            last += [""] * (n - made)
            count += [0] * (n - made)
            for end, t in self.inner.iter(word):
                j = end + 1
                if j > made and not count[j]:
                    i = j - len(t)
                    u = last[i]
                    if u:
                        good = fits.get((u, t))
                        if good is None:
                            good = fits[u, t] = fit(u, t)
                    if not u or good:
                        last[j] = t
                        count[j] = count[i] + 1
            for i in range(max(0, n - longest), n):
                t = word[i:] + END
                if t in ended:
                    u = last[i]
                    if not u:
                        break
                    good = fits.get((u, t))
                    if good is None:
                        good = fits[u, t] = fit(u, t)
                    if good:
                        break
            yield word, count[i] + 1
            before = word
        if len(fits) > self.cached_fits:
            fits.clear()

    def table(self, word: str) -> tuple[list[str], list[int], list[int]]:
        """The walk along one word of byte units: at each place the last token, the
        count, and the count of the prefix as the end of a text."""
        n = len(word)
        last, count, final = [""] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        self.extend(word, 0, last, count)
        for end, t in self.outer.iter(word):
            j = end + 1
            i = j - len(t) + len(END)
            if not final[j] and (not i or self.fit(last[i], t)):
                final[j] = count[i] + 1
        return last, count, final

    def extend(self, word: str, known: int, last: list[str], count: list[int]) -> None:
        """Fills in last and count beyond the place ``known`` of a word, from what is
        there up to it."""
        for end, t in self.inner.iter(word):
            j = end + 1
            if j > known and not count[j]:
                i = j - len(t)
                if not i and not last[0] or last[i] and self.fit(last[i], t):
                    last[j] = t
                    count[j] = count[i] + 1

    def pretokens(self, normal: str) -> list[str]:
        """The tokenizer's words of a normalised text, as byte units."""
        if normal.isascii():
            found = self.split(normal)
            return found if normal.isprintable() else [t.translate(self.unit_of) for t in found]
        return [units for units, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def normal(self, part: str) -> str | None:
        """The normal form if it stands one character for one, else None."""
        if part.isascii():
            return part.lower()
        whole = self.library.normalizer.normalize_str(part)
        if len(whole) == len(part) and whole == "".join(map(self.normal_char, part)):
            return whole
        return None

    def normal_char(self, c: str) -> str:
        if c not in self.normal_chars:
            self.normal_chars[c] = self.library.normalizer.normalize_str(c)
        return self.normal_chars[c]

    def short_count(self, text: str) -> int:
        """Tokens of a few normalised characters."""
        return sum(n for _, n in self.walk(self.pretokens(text))) if text else 0

    def parts(self, word: str) -> list[str]:
        """The word cut at white space beyond ASCII and at special tokens, both kept."""
        if word.isascii() and "<|" not in word:
            return [word]
        return [x for x in self.apart(word) if x]

    def learn(self, raw: list[bytes]) -> None:
        """Puts the words' token counts into the cache."""
        known_words, held, odd = self.words.young, [], []
        for w in raw:
            if w.isascii() and b"<|" not in w:
                word = w.decode().lower()
                found = self.split(word)
                held.append((w, found if word.isprintable() else [t.translate(self.unit_of) for t in found]))
            else:
                odd.append((w, self.parts(w.decode("utf-8", "replace"))))
        tokens = self.tokens_of({part for _, parts in odd for part in parts})
        every = {t for _, found in held for t in found}
        every.update(t for found in tokens.values() if found for t in found)
        known = dict(self.walk(sorted(every)))
        for w, found in held:
            known_words[w] = known[found[0]] if len(found) == 1 else sum([known[t] for t in found])
        for w, parts in odd:
            known_words[w] = sum(1 if part in self.special else sum(known[t] for t in tokens[part]) for part in parts)

    def tokens_of(self, parts: set[str]) -> dict[str, list[str]]:
        """The pre-tokens of each part; none of special tokens and white space."""
        return {part: [] if part in self.special or part.isspace() else self.pretokens(self.normal(part) or self.library.normalizer.normalize_str(part)) for part in parts}

    def word_counts(self, w: bytes) -> np.ndarray:
        """Tokens of every code-point prefix of one word, the empty one first."""
        out, total, before = [np.zeros(1, np.int32)], 0, None
        for part in self.parts(w.decode("utf-8", "replace")):
            if part.isspace():
                own, before = np.zeros(len(part), np.int32), None
            elif part in self.special:  # cut inside, it is ordinary text that goes on from what stands before
                inside = [before.count(part[:i].lower()) - before.count("") if before else self.short_count(part[:i].lower()) for i in range(1, len(part))]
                own, before = np.array([*inside, 1], np.int32), None
            else:
                before = Trail(self, part)
                own = before.prefix_counts()
            out.append(own + total)
            total += int(own[-1])
        return np.concatenate(out)

    def counts(self, texts: list[bytes]) -> list[tuple[list[bytes], np.ndarray]]:
        """Of each text: its words between ASCII white space, and the number of
        tokens up to the end of each."""
        words = [x.split() for x in texts]
        missing = self.words.missing(set().union(*words))
        for at in range(0, len(missing), 50_000):
            self.learn(missing[at : at + 50_000])
        get = self.words.young.__getitem__
        return [(ws, np.cumsum(np.fromiter(map(get, ws), np.int64, len(ws)))) for ws in words]

    def prefix_counts(self, text: bytes) -> np.ndarray:
        """The number of tokens of every code-point prefix of the text, from 0 on."""
        [(words, ends)] = self.counts([text])
        out = np.zeros(len(text.decode("utf-8", "replace")) + 1, np.int32)
        at, chars, total = 0, 0, 0
        for w, end in zip(words, ends.tolist(), strict=True):
            gap = text.index(w, at) - at
            out[chars : chars + gap + 1] = total
            chars += gap
            own = self.word_counts(w)
            out[chars : chars + len(own)] = own + total
            chars, at, total = chars + len(own) - 1, at + gap + len(w), end
        out[chars:] = total
        return out

    def longest_fit(self, text: bytes, words: list[bytes], ends: np.ndarray, budget: int) -> int:
        """The code points of the longest prefix of at most ``budget`` tokens."""
        if not len(ends) or ends[-1] <= budget:
            return len(text.decode("utf-8", "replace"))
        before = np.r_[0, ends[:-1]]
        i = int(np.searchsorted(before, budget, "right")) - 1  # the cut is inside this word, or right before it
        good = np.flatnonzero(self.word_counts(words[i]) + before[i] <= budget)
        at = 0
        for w in words[:i]:
            at = text.index(w, at) + len(w)
        at = text.index(words[i], at)
        return len(text[:at].decode("utf-8", "replace")) + int(good[-1])


class Trail:
    """The walks along the pre-tokens of a part's normal form, from which the counts
    of all its prefixes follow."""

    def __init__(self, counter: PrefixCounter, part: str):
        self.counter, self.part = counter, part
        normal = counter.normal(part)
        self.one_for_one = normal is not None
        self.normal = normal if normal is not None else counter.library.normalizer.normalize_str(part)
        self.tokens = counter.pretokens(self.normal)
        self.tables: dict[str, tuple] = {}
        #: the pre-token of each character of the normal form, its first character, the bytes and tokens before it
        self.token_at: list[int] = []
        self.starts, self.before = [], []
        total = 0
        for i, token in enumerate(self.tokens):
            if token not in self.tables:
                text = bytes(map(counter.byte_of.__getitem__, token)).decode()
                self.tables[token] = (text, np.cumsum([0, *(len(c.encode()) for c in text)]), *counter.table(token))
            self.starts.append(len(self.token_at))
            self.before.append(total)
            self.token_at += [i] * len(self.tables[token][0])
            total += self.tables[token][4][-1]

    def at(self, n: int) -> int:
        """Tokens of the first n characters of the normal form."""
        if not n:
            return 0
        i = self.token_at[n - 1]
        text, places, _, _, final = self.tables[self.tokens[i]]
        inside = n - self.starts[i]
        if inside < len(text) and len(text) > 2 and text[0] == "'" and text[1].isalpha():  # a cut contraction is an apostrophe and letters
            return self.before[i] + self.counter.short_count(text[:inside])
        return self.before[i] + final[places[inside]]

    def count(self, tail: str, n: int | None = None) -> int:
        """Tokens of the first n (all) characters of the normal form and ``tail``, a
        few normalised characters more."""
        n = len(self.normal) if n is None else n
        if not tail:
            return self.at(n)
        if not n:
            return self.counter.short_count(tail)
        i = self.token_at[n - 1]
        text, places, last, count, final = self.tables[self.tokens[i]]
        inside, done = n - self.starts[i], self.before[i]
        if inside <= 3:  # an apostrophe there may begin a contraction
            return done + self.counter.short_count(text[:inside] + tail)
        # a longer one is a run of letters or of neither letters nor digits: does the tail go on with it?
        stand = "a" if len(self.counter.pretokens("a" + text[0])) == 1 else "!"
        more, *others = self.counter.pretokens(stand + tail)
        known = int(places[inside])
        if len(more) == 1:
            done += final[known]
        else:
            first = max(0, known - 2 * self.counter.longest_unit)
            word = self.tokens[i][first:known] + more[1:]
            last_, count_ = last[first : known + 1] + [""] * (len(more) - 1), count[first : known + 1] + [0] * (len(more) - 1)
            self.counter.extend(word, known - first, last_, count_)
            for j in range(max(0, len(word) - self.counter.longest), len(word)):
                t = word[j:] + END
                if t in self.counter.ended and (not last_[j] and not first + j or last_[j] and self.counter.fit(last_[j], t)):
                    done += count_[j] + 1
                    break
        return done + sum(n for _, n in self.counter.walk(others))

    def prefix_counts(self) -> np.ndarray:
        """Counts of the part's code-point prefixes, from length 1 on."""
        if self.one_for_one:
            return np.array([self.at(n) for n in range(1, len(self.part) + 1)], np.int32)
        normalise = cache(self.counter.library.normalizer.normalize_str)
        found = segments(self.part)
        if "".join(map(normalise, found)) != self.normal:  # another Unicode version than the library's
            found = [self.part]
        out, n = [], 0
        for segment in found:
            for j in range(1, len(segment)):
                out.append(self.count(normalise(segment[:j]), n))
            n += len(normalise(segment))
            out.append(self.at(n))
        return np.array(out, np.int32)


def counter(path: str) -> PrefixCounter:
    return held(PrefixCounter, path)


def token_counts(docs: DataFrame, budget: int = 2048, path: str | None = None, prefixes: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars (code points of the longest
    prefix of at most ``budget`` tokens) and, with ``prefixes``, prefix_counts
    (array<int>: tokens of every code-point prefix, the empty one first).

    Null text: empty, no tokens. Null or repeated ids and repeated rows are rows
    of their own; an empty table gives no rows; other columns are ignored. One
    pass, no shuffle.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    ship(docs.sparkSession)
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long" + ", prefix_counts array<int>" * prefixes

    def run(batches):
        own = counter(path)
        for doc_ids, texts in batches_of_texts(batches, 8 << 20):
            found = own.counts(texts)
            n = [int(ends[-1]) if len(ends) else 0 for _, ends in found]
            fit = [own.longest_fit(t, words, ends, budget) for t, (words, ends) in zip(texts, found, strict=True)]
            columns = [doc_ids, pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > budget for x in n]), pa.array(fit, pa.int64())]
            names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"]
            if prefixes:
                columns.append(pa.array([own.prefix_counts(t) for t in texts], pa.list_(pa.int32())))
                names.append("prefix_counts")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), schema)

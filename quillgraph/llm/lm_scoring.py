"""Document scoring by prediction by partial matching (PPM).

Cleary and Witten (1984); escape method D of Howard (1993) with symbol exclusion.
The model is a byte-context trie of order 4 over the training documents: a node
is a context of up to four bytes with the counts of the bytes that followed. A
byte is coded in its longest known context if it was seen there, with
(n - 1/2) / T; else an escape of q / 2T is paid (q distinct symbols, T
occurrences) and the next shorter context is asked, where symbols that the longer
one had are left out. A document's score is the sum over its bytes and its end.

The trie is never in one place. Documents are packed into batches of bounded
size; a batch is asked for its *distinct* five-byte strings, not its positions.
These are dealt by the three bytes nearest to the predicted one, so each task holds
all contexts of order three and more that its strings need. The lower orders are the
counts of three-byte strings, of which there are at most 2^24 whatever the corpus;
they are summed up first and broadcast. Each string's log probability goes back to
the batches that asked. Word counts of the base score travel the same way, dealt by
word. What moves grows with the number of batches, so with the input; the number of
slices grows with the bytes, and a batch sends rows to slices that it has strings of.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of_texts, shared_dir, ship, tidy, tidy_group

ORDER = 4
#: Bytes that UTF-8 never has: before a text's start, and its end.
START, END = 0xFE, 0xFF
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SLICES = 48
PACKED = pa.schema(
    [("batch", pa.int64()), ("texts", pa.list_(pa.binary())), ("lengths", pa.list_(pa.binary())), ("ids", pa.list_(pa.list_(pa.int64()))), ("held", pa.list_(pa.binary())), ("bytes", pa.int64()), ("train_docs", pa.int64()), ("train_words", pa.int64()), ("three", pa.binary()), ("three_n", pa.binary())]
)


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(strings, document of each): the ORDER + 1 bytes that end at each predicted
    byte, as one integer."""
    start, end = bytes([START]) * ORDER, bytes([END])
    flat = np.frombuffer(b"".join(x for t in texts for x in (start, t, end)), np.uint8)
    one = flat.astype(np.uint64)
    two = one.copy()
    two[1:] |= one[:-1] << np.uint64(8)
    gram = two.copy()
    gram[2:] |= two[:-2] << np.uint64(16)
    gram[4:] |= one[:-4] << np.uint64(32)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return gram[flat != START], np.repeat(np.arange(len(texts)), lengths)


def triples(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct three-byte strings that end at predicted bytes, how often each is there)."""
    start, end = bytes([START]) * 2, bytes([END])
    flat = np.frombuffer(b"".join(x for t in texts for x in (start, t, end)), np.uint8)
    x = flat.astype(np.uint32)
    x[1:] |= x[:-1] << np.uint32(8)
    three = x[1:-1] << np.uint32(8) | flat[2:]
    return np.unique(three[flat[2:] != START], return_counts=True)


def gram_slice(grams: np.ndarray, slices: int) -> np.ndarray:
    near = (grams >> np.uint64(8)) & np.uint64(0xFFFFFF)
    near = near * np.uint64(0x9E3779B97F4A7C15)
    return ((near ^ (near >> np.uint64(32))) % np.uint64(slices)).astype(np.int64)


def word_slice(word: bytes, slices: int) -> int:
    return zlib.crc32(word) % slices


def by_slice(items: np.ndarray, which: np.ndarray, slices: int):
    """Indices of each slice, in the order of ``items``."""
    order = np.argsort(which, kind="stable")
    cuts = np.searchsorted(which[order], np.arange(slices + 1))
    return [order[cuts[s] : cuts[s + 1]] for s in range(slices)]


def low(x: np.ndarray, k: int) -> np.ndarray:
    return x & np.uint64((1 << 8 * k) - 1)


class Lower:
    """Orders zero to two, from the counts of three-byte strings."""

    def __init__(self, key: np.ndarray, n: np.ndarray):
        self.pairs = np.bincount((key & np.uint32(0xFFFF)).astype(np.int64), n, 1 << 16).astype(np.int64).reshape(256, 256)
        self.key, self.n = key.astype(np.uint64), n.astype(np.float64)
        # a pair's own count, of strings that any byte stands before
        self.two = table_of(self.key, self.n, self.pairs[((self.key >> np.uint64(8)) & np.uint64(255)).astype(int), (self.key & np.uint64(255)).astype(int)].astype(float))


def table_of(key: np.ndarray, n: np.ndarray, beneath: np.ndarray) -> tuple:
    """(strings, n, contexts, T, q, sum of the shorter strings' n) of sorted strings."""
    if not len(key):
        return key, n, key, n, n, n
    ctx, first = np.unique(key >> np.uint64(8), return_index=True)
    return key, n, ctx, np.add.reduceat(n, first), np.diff(np.r_[first, len(key)]), np.add.reduceat(beneath, first)


def log_probabilities(grams: np.ndarray, counts: np.ndarray, lower: Lower) -> np.ndarray:
    """log10 P of each of the sorted distinct strings. ``counts``: occurrences of
    each in training, where all strings that share a string's three nearest bytes
    are given."""
    seen = counts > 0
    own, n_own = grams[seen], counts[seen].astype(np.float64)
    pairs = lower.pairs
    singles = pairs.sum(0).astype(np.float64)
    tables = {2: lower.two}
    for k in range(3, ORDER + 1):
        key, inverse = np.unique(low(own, k + 1), return_inverse=True)
        n = np.bincount(inverse, n_own, len(key)) if len(key) else np.zeros(0)
        tables[k] = table_of(key, n, tables[k - 1][1][np.searchsorted(tables[k - 1][0], low(key, k))] if len(key) else n)
    out = np.zeros(len(grams))
    left = np.arange(len(grams))
    gone_n, gone_q = np.zeros(len(grams)), np.zeros(len(grams))

    def step(hit, n, has, total, q):
        """Codes the strings in ``left``; of those not hit, tells which had the context."""
        nonlocal left
        total, q = total - gone_n[left], q - gone_q[left]
        safe = np.maximum(total, 1e-300)
        out[left] += np.where(hit, np.log10(np.maximum(n - 0.5, 1e-300) / safe), np.where(has & (total > 0.25), np.log10(np.maximum(q, 1e-300) / 2 / safe), 0.0))

    for k in range(ORDER, 1, -1):
        key, n, ctx, total, q, beneath = tables[k]
        if len(key):
            want = low(grams[left], k + 1)
            c = np.minimum(np.searchsorted(ctx, want >> np.uint64(8)), len(ctx) - 1)
            s = np.minimum(np.searchsorted(key, want), len(key) - 1)
            has = ctx[c] == want >> np.uint64(8)
            hit = key[s] == want
            step(hit, n[s], has, np.where(has, total[c], gone_n[left]), np.where(has, q[c], gone_q[left]))
            rest = ~hit
            gone_n[left[rest]] = np.where(has, beneath[c], 0.0)[rest]
            gone_q[left[rest]] = np.where(has, q[c], 0.0)[rest]
            left = left[rest]
    # orders one and zero
    byte = (grams & np.uint64(255)).astype(int)
    near = ((grams >> np.uint64(8)) & np.uint64(255)).astype(int)
    n = pairs[near[left], byte[left]].astype(float)
    total, q = pairs.sum(1).astype(float), (pairs > 0).sum(1).astype(float)
    beneath = ((pairs > 0) * singles).sum(1)
    c = near[left]
    has, hit = total[c] > 0, n > 0
    step(hit, n, has, np.where(has, total[c], gone_n[left]), np.where(has, q[c], gone_q[left]))
    rest = ~hit
    gone_n[left[rest]] = np.where(has, beneath[c], 0.0)[rest]
    gone_q[left[rest]] = np.where(has, q[c], 0.0)[rest]
    left = left[rest]
    n = singles[byte[left]]
    known = singles.sum() > 0
    hit = n > 0
    step(hit, n, np.full(len(left), known), np.full(len(left), singles.sum()), np.full(len(left), float((singles > 0).sum())))
    left = left[~hit]
    out[left] -= math.log10(256 - (singles > 0).sum()) if len(left) else 0.0
    return out


def adaptive_code_length(text: bytes, order: int = ORDER, trained: tuple[bytes, ...] = (), learn: bool = True) -> float:
    """log10 probability of one text by the same model in its plain form: a
    dictionary trie walked byte by byte, that learns from ``trained`` first and,
    with ``learn``, from the text as it goes."""
    trie: dict[bytes, Counter] = {}

    def update(padded_text: bytes, i: int) -> None:
        for k in range(order + 1):
            trie.setdefault(padded_text[i - k : i], Counter())[padded_text[i]] += 1

    for t in trained:
        whole = bytes([START]) * order + t + bytes([END])
        for i in range(order, len(whole)):
            update(whole, i)
    whole = bytes([START]) * order + text + bytes([END])
    score = 0.0
    for i in range(order, len(whole)):
        s, excluded = whole[i], set()
        for k in range(order, -1, -1):
            seen = trie.get(whole[i - k : i])
            if seen is None:
                continue
            open_ = {b: n for b, n in seen.items() if b not in excluded}
            total = sum(open_.values())
            if s in open_:
                score += math.log10((open_[s] - 0.5) / total)
                break
            if total:
                score += math.log10(len(open_) / 2 / total)
            excluded |= set(seen)
        else:
            score -= math.log10(256 - len(excluded))
        if learn:
            update(whole, i)
    return score


def score_documents(docs: DataFrame, held_out=None, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 8 << 20, parts_most: int = 2, slice_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out``: a boolean column expression; rows where it is true are not
    learned from (default: crc32 of the id as text, mod 5, is 1; a null id is the
    empty text and so learned from). Null text: empty, one end. Repeated rows
    count each time. Without training rows every byte has probability 1/256, and
    N = V = 0. An empty table gives no rows; other columns are ignored.

    Intermediate tables are written to the shared folder.
    """
    spark = docs.sparkSession
    ship(spark)
    if held_out is None:
        held_out = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 1
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.spark_partition_id().cast("long").alias("part"))
    folder = f"{shared_dir(spark)}/lm-{uuid.uuid4().hex}"

    def pack(batches):
        """Rows of up to ``parts_most`` parts of ``batch_bytes`` each."""
        seq, parts, part = 0, [], None

        def row():
            known = [x[4] for x in parts]
            three, n = (np.concatenate(x) for x in zip(*(x[5] for x in parts), strict=True))
            three, inverse = np.unique(three, return_inverse=True)
            values = [
                [part << 24 | seq], [[x[0] for x in parts]], [[x[1] for x in parts]], [[x[2] for x in parts]], [[x[3] for x in parts]], [sum(x[6] for x in parts)],
                [sum(k for k, _ in known)], [sum(w for _, w in known)], [three.astype(np.uint32).tobytes()], [np.bincount(inverse, n, len(three)).astype(np.int64).tobytes()],
            ]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, PACKED.types, strict=True)], schema=PACKED)

        for batch in batches:
            at = 0
            for ids, texts in batches_of_texts([batch], batch_bytes):
                held = batch.column(2).slice(at, len(texts)).to_numpy(zero_copy_only=False)
                part = batch.column(3)[at].as_py()
                at += len(texts)
                known = [t for t, h in zip(texts, held, strict=True) if not h]
                flat = b"".join(texts)
                parts.append((zstandard.compress(flat, 1), np.fromiter(map(len, texts), np.int64, len(texts)).tobytes(), ids.to_pylist(), held.astype(np.uint8).tobytes(), (len(known), sum(len(t.split()) for t in known)), triples(known), len(flat)))
                if len(parts) == parts_most or sum(x[6] for x in parts) >= parts_most * batch_bytes:
                    yield row()
                    parts, seq = [], seq + 1
        if parts:
            yield row()

    kinds = "batch long, texts array<binary>, lengths array<binary>, ids array<array<long>>, held array<binary>, bytes long, train_docs long, train_words long, three binary, three_n binary"
    rows.mapInArrow(tidy(pack), kinds).write.option("compression", "zstd").parquet(f"{folder}/packed")
    packed = spark.read.parquet(f"{folder}/packed")
    facts = packed.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("train_docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("train_words"), F.lit(0)).alias("words")).head()

    def unfolded(batches):
        for batch in batches:
            for three, n in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(three.as_py(), np.uint32).astype(np.int64)), pa.array(np.frombuffer(n.as_py(), np.int64))], ["three", "n"])

    found = packed.select("three", "three_n").mapInArrow(unfolded, "three long, n long").groupBy("three").agg(F.sum("n").alias("n")).orderBy("three").toPandas()  # at most 2^24 rows, of any corpus
    known_lower = spark.sparkContext.broadcast((found.three.to_numpy().astype(np.uint32), found.n.to_numpy().astype(np.int64)))
    slices = max(SLICES, facts.bytes // slice_bytes)

    def unpacked(texts: bytes, lengths: bytes) -> list[bytes]:
        flat, at, out = zstandard.decompress(texts), 0, []
        for n in np.frombuffer(lengths, np.int64).tolist():
            out.append(flat[at : at + n])
            at += n
        return out

    def dealt(words) -> dict[int, list[bytes]]:
        out: dict[int, list[bytes]] = {}
        for w in words:
            out.setdefault(word_slice(w, slices), []).append(w)
        return {s: sorted(ws) for s, ws in out.items()}

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                grams, counts, total = [], [], Counter()
                every: set[bytes] = set()
                for z, lengths, held in zip(row["texts"], row["lengths"], row["held"], strict=True):
                    texts, held = unpacked(z, lengths), np.frombuffer(held, np.uint8)
                    gram, doc = padded(texts)
                    gram = np.sort(gram << np.uint64(1) | (held[doc] == 0))  # the last bit: learned from
                    first = np.flatnonzero(np.r_[True, (gram[1:] ^ gram[:-1]) > 1]) if len(gram) else np.zeros(0, np.int64)
                    grams.append(gram[first] >> np.uint64(1))
                    counts.append(np.add.reduceat((gram & np.uint64(1)).astype(np.int64), first) if len(gram) else first)
                    for t, h in zip(texts, held, strict=True):
                        words = t.translate(LOWER).split()
                        every.update(words)
                        if not h:
                            total.update(words)
                distinct, inverse = np.unique(np.concatenate(grams), return_inverse=True)
                n = np.bincount(inverse, np.concatenate(counts), len(distinct)).astype(np.uint32)
                groups, words = by_slice(distinct, gram_slice(distinct, slices), slices), dealt(every)
                to = [s for s in range(slices) if len(groups[s]) or s in words]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(to, pa.int32()), pa.array([row["batch"]] * len(to), pa.int64()), pa.array([distinct[groups[s]].tobytes() for s in to], pa.binary()), pa.array([n[groups[s]].tobytes() for s in to], pa.binary()),
                        pa.array([b"\n".join(words.get(s, ())) for s in to], pa.binary()), pa.array([np.fromiter((total[w] for w in words.get(s, ())), np.uint32).tobytes() for s in to], pa.binary()),
                    ],
                    names=["slice", "batch", "grams", "gram_n", "words", "word_n"],
                )

    def answer(table: pa.Table) -> pa.Table:
        grams = [np.frombuffer(x.as_py(), np.uint64) for x in table["grams"]]
        distinct, inverse = np.unique(np.concatenate(grams), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table["gram_n"]]), len(distinct)) if len(distinct) else np.zeros(0)
        logs = log_probabilities(distinct, counts, Lower(*known_lower.value))[inverse].astype(np.float32)
        total: Counter = Counter()
        lists = []
        for words, n in zip(table["words"], table["word_n"], strict=True):
            ws = words.as_py().split(b"\n") if words.as_py() else []
            lists.append(ws)
            for w, c in zip(ws, np.frombuffer(n.as_py(), np.uint32).tolist(), strict=True):
                total[w] += c
        cuts = np.cumsum([0, *map(len, grams)])
        return pa.table(
            {
                "batch": table["batch"], "slice": table["slice"], "logs": pa.array([logs[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                "counts": pa.array([np.fromiter((total[w] for w in ws), np.int64, len(ws)).tobytes() for ws in lists], pa.binary()), "distinct": pa.array([sum(n > 0 for n in total.values())] + [0] * (len(lists) - 1), pa.int64()),
            }
        )

    answers = packed.select("batch", "texts", "lengths", "held").mapInArrow(tidy(ask), "slice int, batch long, grams binary, gram_n binary, words binary, word_n binary")
    answers = answers.groupBy("slice").applyInArrow(tidy_group(answer), "batch long, slice int, logs binary, counts binary, distinct long")
    answers.write.option("compression", "zstd").parquet(f"{folder}/answers")
    answers = spark.read.parquet(f"{folder}/answers")
    n_train = facts.words + facts.docs
    distinct = answers.agg(F.coalesce(F.sum("distinct"), F.lit(0))).head()[0] + (facts.docs > 0)
    scale = math.log10(n_train + 0.5 * (distinct + 1))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            found = []  # of each part, by its own distinct strings and words: what stands where
            for z, lengths in zip(row["texts"], row["lengths"], strict=True):
                texts = unpacked(z, lengths)
                gram, doc = padded(texts)
                own = np.unique(gram)
                at = np.searchsorted(own, gram).astype(np.int32)
                places = np.bincount(doc, minlength=len(texts))
                del gram, doc
                words = [t.translate(LOWER).split() for t in texts]
                index: dict[bytes, int] = {}
                for ws in words:
                    for w in ws:
                        index.setdefault(w, len(index))
                word_at = np.fromiter((index[w] for ws in words for w in ws), np.int32)
                found.append((own, at, places, list(index), word_at, np.fromiter(map(len, words), np.int64, len(words))))
            distinct = np.unique(np.concatenate([f[0] for f in found]))
            groups = by_slice(distinct, gram_slice(distinct, slices), slices)
            by_word = dealt(set().union(*(f[3] for f in found)))
            logs, counts = np.zeros(len(distinct)), {}
            for a in right.to_pylist():
                logs[groups[a["slice"]]] = np.frombuffer(a["logs"], np.float32)
                counts.update(zip(by_word.get(a["slice"], ()), np.frombuffer(a["counts"], np.int64).tolist(), strict=True))
            for (own, at, places, vocabulary, word_at, n_words), ids, held in zip(found, row["ids"], row["held"], strict=True):
                doc = np.repeat(np.arange(len(ids)), places)
                scores = np.bincount(doc, logs[np.searchsorted(distinct, own)][at], len(ids))
                c = np.fromiter(map(counts.__getitem__, vocabulary), np.int64, len(vocabulary))
                doc = np.repeat(np.arange(len(ids)), n_words)
                known = np.bincount(doc[c[word_at] > 0], minlength=len(ids)) + (facts.docs > 0)
                base = np.bincount(doc, np.log10(c + 0.5)[word_at], len(ids)) + math.log10(facts.docs + 0.5) - (n_words + 1) * scale
                out.append((ids, [bool(h) for h in held], (n_words + 1).tolist(), known.tolist(), [n_train] * len(ids), base.tolist(), scores.tolist()))
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        columns = [[x for part in column for x in part] for column in zip(*out, strict=True)] or [[]] * len(names)
        return pa.table([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=names)

    texts = packed.select("batch", "texts", "lengths", "ids", "held")
    return texts.groupBy("batch").cogroup(answers.select("batch", "slice", "logs", "counts").groupBy("batch")).applyInArrow(tidy_group(score), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

"""Exact substring deduplication with a column-wise suffix array.

Bauer, Cox and Rosone, "Lightweight algorithms for constructing and inverting the
BWT of string collections" (2013), and Cox et al., "Lightweight LCP construction
for very large collections of strings" (2016): the transform of a collection
starts with the empty suffixes and takes one more symbol of every string in each
round, from the last to the first; where each goes follows from the order of the
round before. Here a round takes eight symbols, by the rank of the piece they make:
the first column has the suffixes under eight symbols, and a suffix's place follows
from its piece and the place of what stands behind. Common prefixes of neighbours are
read off the ranks of their pieces in the last column.

Whole documents would need as many rounds as the longest has bytes, each over the
whole corpus. What a match of ``width`` bytes needs is less. Every window of that
many bytes has an anchor, the least hash of its ``gram``-byte strings; equal
windows have equal anchors. Neighbouring windows of one anchor form a segment of
under 2 width bytes, and segments are dealt by anchor, so that equal windows meet
wherever they are. Anchors that only one document has are found first, by their
hashes alone, and dropped: each batch is told which of its anchors others have, a bit
an anchor. A segment that stands under its anchor as the only one is compared by its
documents alone. The collections left are strings of bounded length, so the number of
rounds is bounded, whatever the documents' lengths; some anchors' strings, a bounded
number, are sorted at a time.

Where a batch of documents holds a segment several times, all but those of its least
id are copies whatever else there is, and stay at home: of a passage that any number
of documents share, a batch sends one.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import grouped, rows_of, slices_for, unpacked, write_packed
from .common import shared_dir, ship, tidy, tidy_group

#: No byte of UTF-8: what stands between strings.
NONE = b"\xff"
#: Symbols that a round of the sort puts in front, as many as a word of 64 bits has.
STEP = 8
#: Strings that are sorted together, and bytes of texts whose anchors are taken at once:
#: what they need stays in a processor's cache.
SORTED, AT_ONCE = 1024, 1 << 16
#: Bytes of segments that a slice compares at a time.
PART = 4 << 20
NO_ID = np.iinfo(np.int64).max
PRIME = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each ``gram``-byte string, by doubling."""
    h, k, power = b.astype(np.uint64) + np.uint64(1), 1, PRIME
    while k * 2 <= gram:
        h = h[:-k] * power + h[k:]
        with np.errstate(over="ignore"):
            power = power * power
        k *= 2
    if k < gram:
        h = h[: len(h) - (gram - k)] * np.uint64(0xD6E8FEB86659FD93) + h[gram - k :]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def anchors(b: np.ndarray, width: int, gram: int) -> np.ndarray:
    """The anchor of each window: the least hash in it, by doubling."""
    x, w, k = gram_hashes(b, gram), width - gram + 1, 1
    while k * 2 <= w:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    x = np.minimum(x[: len(x) - (w - k)], x[w - k :]) if w > k else x
    # least values crowd near zero; spread them again, for slices of like size
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def segments(anchor: np.ndarray, most: int, also: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first window, number of windows) of runs of one anchor, cut at ``most`` and
    ahead of the windows ``also``."""
    change = np.r_[True, anchor[1:] != anchor[:-1]]
    change[also[also < len(change)]] = True
    starts = np.flatnonzero(change)
    n = np.diff(np.r_[starts, len(anchor)])
    if n.max(initial=0) > most:
        parts = -(-n // most)
        first = np.repeat(starts, parts)
        step = np.arange(len(first)) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = first + step * most
        n = np.minimum(most, np.repeat(n, parts) - step * most)
    return starts, n


def all_segments(flat: bytes, lengths: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, number of windows, anchor) of the segments of texts that
    stand one after another, some ``AT_ONCE`` bytes of them at a time."""
    b = np.frombuffer(flat, np.uint8)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    found = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)]
    i = 0
    while i < len(lengths):
        j = max(i + 1, int(np.searchsorted(ends, begins[i] + AT_ONCE, "right")))
        here = b[begins[i] : ends[j - 1]]
        if len(here) >= width:
            a = anchors(here, width, gram)
            own, n = begins[i:j] - begins[i], lengths[i:j]
            over = np.maximum(own, own + n - width + 1)  # from there on windows reach into the next text
            first, count = segments(a, width - gram + 1, np.r_[own, over])
            text = np.searchsorted(own, first, "right") - 1
            good = first - own[text] <= n[text] - width
            first, text = first[good], text[good]
            found.append((text + i, first - own[text], count[good], a[first] & ~np.uint64(1)))
        i = j
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def dense(values: np.ndarray, dtype) -> bytes:
    """Differences of neighbours by byte, first bytes first, compressed: short for values
    that mostly grow a little."""
    steps = np.diff(values.astype(dtype), prepend=np.zeros(1, dtype))
    return zstandard.compress(steps.view(np.uint8).reshape(len(steps), steps.itemsize).T.tobytes(), 1)


def undense(data: bytes, dtype) -> np.ndarray:
    bytes_ = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.cumsum(bytes_.T.copy().view(dtype).ravel(), dtype=dtype)


def sorted_suffixes(strings: list[bytes], least: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, length, common prefix with the one before) of every suffix in
    order; suffixes that end a string sort before longer ones, by string. Where one
    of the two is under ``least`` long, the common prefix is said to be 0."""
    m = len(strings)
    if not m:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.uint8)
    lengths = np.fromiter(map(len, strings), np.int64, m)
    # symbols are one up, and zeros follow each string: its end sorts before any symbol
    symbols = np.frombuffer((NONE * STEP).join([*strings, b""]), np.uint8) + np.uint8(1)
    piece = np.lib.stride_tricks.sliding_window_view(symbols, STEP).copy().view(">u8").ravel().astype(np.uint64)
    rank = np.unique(piece, return_inverse=True)[1]
    digits = [(rank >> i & 0xFFFF).astype(np.uint16) for i in range(0, int(rank.max()).bit_length(), 16)]
    string = np.repeat(np.arange(m, dtype=np.int32), lengths + STEP)[: len(piece)]
    before = np.arange(len(piece), dtype=np.int32) - (np.cumsum(lengths + STEP) - lengths - STEP).astype(np.int32)[string]
    length = lengths.astype(np.int32)[string] - before

    def ordered(at: np.ndarray) -> np.ndarray:
        """By what stands first; what follows has its order already."""
        for digit in digits:
            at = at[np.argsort(digit[at], kind="stable")]
        return at

    short = ordered(np.flatnonzero((length >= 0) & (length < STEP)).astype(np.int32))
    column = short
    for _ in range(int(lengths.max()) // STEP):
        column = ordered(np.concatenate([short, column[before[column] >= STEP] - STEP]))
    common = np.zeros(len(column), np.int64)
    row = np.flatnonzero(np.minimum(length[column[1:]], length[column[:-1]]) >= least) + 1
    here, there = column[row], column[row - 1]
    while len(row):
        same = rank[here] == rank[there]
        differ = piece[here[~same]] ^ piece[there[~same]]
        common[row[~same]] += sum((differ < np.uint64(1 << (64 - 8 * i))).astype(np.int64) for i in range(1, STEP))
        row, here, there = row[same], here[same], there[same]
        common[row] += np.minimum(length[here], STEP)
        more = length[here] >= STEP
        row, here, there = row[more], here[more] + STEP, there[more] + STEP
    return string[column], length[column].astype(np.uint8), np.minimum(common, 254).astype(np.uint8)


def least_owner(strings: list[bytes], owner: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` bytes of each string, one after another, the least
    owner of any string that has the window."""
    string, length, common = sorted_suffixes(strings, width)
    whole = length >= width
    # rows that are too short end a group: nothing of ``width`` bytes reaches across them
    group = np.cumsum(common < width)[whole]
    string, length = string[whole], length[whole].astype(np.int64)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    least = np.repeat(np.minimum.reduceat(owner[string], starts), np.diff(np.r_[starts, len(group)])) if len(group) else owner[:0]
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    sizes = np.maximum(0, lengths - width + 1)
    out = np.zeros(int(sizes.sum()), np.int64)
    out[(np.cumsum(sizes) - sizes)[string] + lengths[string] - length] = least
    return out


def repeated_spans(docs: DataFrame, finish, schema: str, width: int = 50, gram: int = 20, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 8 << 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """``finish(ids, texts, covers, carried)`` for each batch of documents: covers are
    boolean arrays of the bytes to remove, carried are the values of the columns
    ``carry``; it returns the rows as a table of ``schema``."""
    spark = docs.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/suffix-{uuid.uuid4().hex}/packed"
    packed = write_packed(docs, path, id_col, text_col, batch_bytes, carry, int(spark.conf.get("spark.sql.shuffle.partitions")))
    plain = spark.read.schema(packed.schema).parquet(path)  # by size of files, not by bucket
    slices = slices_for(plain.count() // 4)

    def slice_of(a: np.ndarray) -> np.ndarray:
        """Slices are ranges of anchors."""
        return ((a >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)

    def cuts(a: np.ndarray) -> list[int]:
        """Where each slice of ordered anchors begins, and the last one ends."""
        return np.searchsorted(slice_of(a), np.arange(slices + 1)).tolist()

    def held(batches):
        """Each batch's anchors, their last bit set if two of its documents have it."""
        for row in rows_of(batches):
            doc, _, _, name = all_segments(zstandard.decompress(row["texts"]), np.frombuffer(row["lengths"], np.int64), width, gram)
            if not len(name):
                continue
            order = np.argsort(name, kind="stable")  # a document's stay together
            name, doc = name[order], doc[order]
            fresh = np.r_[True, name[1:] != name[:-1]]
            start = np.flatnonzero(fresh)
            fresh[1:] |= doc[1:] != doc[:-1]
            name, n = name[start], np.add.reduceat(fresh.astype(np.int64), start)
            at = cuts(name)
            name = (name >> np.uint64(KEPT)) & ~np.uint64(1) | (n > 1).astype(np.uint64)
            to = [s for s in range(slices) if at[s] < at[s + 1]]
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([row["batch"]] * len(to), pa.int64()), pa.array([dense(name[at[s] : at[s + 1]], np.uint64) for s in to], pa.binary())], names=["slice", "batch", "a"])

    def shared(table: pa.Table) -> pa.Table:
        """For each batch, a bit for each of its anchors of the slice: two documents have it."""
        own = [undense(x.as_py(), np.uint64) for x in table["a"]]
        a = np.concatenate(own)
        order = np.argsort(a & ~np.uint64(1))
        name = a[order] & ~np.uint64(1)
        start = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
        n = np.diff(np.r_[start, len(name)])
        several = (n > 1) | np.logical_or.reduceat((a[order] & np.uint64(1)).astype(bool), start)
        flags = np.empty(len(a), bool)
        flags[order] = np.repeat(several, n)
        parts = np.split(flags, np.cumsum([len(x) for x in own])[:-1])
        return pa.table([table["slice"], table["batch"], pa.array([np.packbits(x).tobytes() for x in parts], pa.binary())], names=["slice", "batch", "bits"])

    known = plain.select("batch", "texts", "lengths").mapInArrow(tidy(held), "slice int, batch long, a binary").groupBy("slice").applyInArrow(tidy_group(shared), "slice int, batch long, bits binary")

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        """Segments under shared anchors, equal ones once a batch, and where they stand."""
        rows: list[tuple] = []
        squeeze = zstandard.ZstdCompressor(3).compress
        for row in left.to_pylist():
            ids = np.array([NO_ID if i is None else i for i in row["ids"]], np.int64)
            flat, lengths = zstandard.decompress(row["texts"]), np.frombuffer(row["lengths"], np.int64)
            doc, start, n, name = all_segments(flat, lengths, width, gram)
            every, which = np.unique(name, return_inverse=True)
            at, good = cuts(every), np.zeros(len(every), bool)
            for s, bits in zip(right["slice"].to_pylist(), right["bits"].to_pylist(), strict=True):
                good[at[s] : at[s + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=at[s + 1] - at[s])
            good = good[which]
            if not good.any():
                continue
            doc, start, n, name = doc[good], start[good], n[good], name[good]
            begin = (np.cumsum(lengths) - lengths)[doc] + start
            index: dict[bytes, int] = {}
            where = np.array([index.setdefault(flat[f:e], len(index)) for f, e in zip(begin.tolist(), (begin + n + width - 1).tolist(), strict=True)], np.int64)
            contents, name = list(index), name[np.unique(where, return_index=True)[1]]
            least = np.full(len(contents), NO_ID, np.int64)
            np.minimum.at(least, where, ids[doc])
            copy = ids[doc] > least[where]
            if copy.any():
                rows.append((-1 - row["batch"], row["batch"], b"", n[copy].astype(np.uint8).tobytes(), b"", b"", doc[copy].astype(np.int32).tobytes(), b"", start[copy].astype(np.int64).tobytes()))
            where, doc, start = where[~copy], doc[~copy], start[~copy]
            new_place = np.empty(len(contents), np.int64)
            of_content = slice_of(name)
            by_slice, places = grouped(of_content, slices), grouped(of_content[where], slices)
            for s in range(slices):
                c, p = by_slice[s], places[s]
                if not len(c):
                    continue
                new_place[c] = np.arange(len(c))
                blob = [contents[x] for x in c.tolist()]
                owner = doc[p]
                present = np.unique(owner)
                rows.append((s, row["batch"], squeeze(b"".join(blob)), np.fromiter(map(len, blob), np.uint8, len(blob)).tobytes(), (name[c] >> np.uint64(8)).astype(np.uint32).tobytes(), dense(new_place[where[p]], np.int32), dense(owner, np.int32), dense(ids[present], np.int64), dense(start[p], np.int64)))
        return pa.table([pa.array(x, t) for x, t in zip(list(zip(*rows, strict=True)) or [()] * len(NAMES), [pa.int64(), pa.int64()] + [pa.binary()] * 7, strict=True)], names=NAMES)

    def compare(table: pa.Table) -> pa.Table:
        """Windows to remove, by batch: document, first window, number of windows."""
        if table["slice"][0].as_py() < 0:  # a batch's own copies
            return pa.table([table["batch"], table["doc"], table["start"], table["sizes"]], names=["batch", "doc", "start", "n"])
        rows = []
        for row in table.to_pylist():
            doc = undense(row["doc"], np.int32)
            _, own = np.unique(doc, return_inverse=True)
            rows.append((zstandard.decompress(row["blob"]), np.frombuffer(row["sizes"], np.uint8).astype(np.int64), np.frombuffer(row["names"], np.uint32), undense(row["at"], np.int32), doc, undense(row["id"], np.int64)[own], undense(row["start"], np.int64)))
        # a part of the anchors at a time
        parts = -(-sum(len(r[0]) for r in rows) // PART)
        by_part = [(grouped(names % parts, parts), grouped((names % parts)[at], parts)) for _, _, names, at, _, _, _ in rows]
        answers: list[list[tuple]] = [[] for _ in rows]
        for p in range(parts):
            compare_part([(r, c[p], o[p]) for r, (c, o) in zip(rows, by_part, strict=True)], answers)
        out = []
        for batch, found in zip(table["batch"].to_pylist(), answers, strict=True):
            if found:
                doc, start, n = map(np.concatenate, zip(*found, strict=True))
                out.append((batch, doc.astype(np.int32).tobytes(), start.astype(np.int64).tobytes(), n.astype(np.uint8).tobytes()))
        return pa.table([pa.array(x, t) for x, t in zip(list(zip(*out, strict=True)) or [()] * 4, [pa.int64(), pa.binary(), pa.binary(), pa.binary()], strict=True)], names=["batch", "doc", "start", "n"])

    def compare_part(rows: list[tuple], answers: list[list[tuple]]) -> None:
        index: dict[bytes, int] = {}
        occurrences, name = [], []
        for (flat, sizes, names, at, doc, id_, start), c, o in rows:
            ends = np.cumsum(sizes)
            place = np.empty(len(sizes), np.int64)
            before = len(index)
            place[c] = [index.setdefault(flat[f:e], len(index)) for f, e in zip((ends - sizes)[c].tolist(), ends[c].tolist(), strict=True)]
            name.append(names[c][place[c] >= before])  # a row's contents are distinct
            occurrences.append((place[at[o]], doc[o], id_[o], start[o]))
        owner = np.full(len(index), NO_ID, np.int64)
        for content, _, id_, _ in occurrences:
            np.minimum.at(owner, content, id_)
        contents = list(index)
        windows = np.fromiter(map(len, contents), np.int64, len(contents)) - width + 1
        _, group, members = np.unique(np.concatenate(name), return_inverse=True, return_counts=True)
        single = members[group] == 1
        several = np.flatnonzero(~single)
        several = several[np.argsort(group[several], kind="stable")]
        # whole groups are sorted together, some ``SORTED`` strings at a time
        begin = np.flatnonzero(np.diff(group[several], prepend=-1))
        begin = begin[np.diff(begin // SORTED, prepend=-1) > 0]
        least = [least_owner([contents[i] for i in x.tolist()], owner[x], width) for x in np.split(several, begin)[1:]]
        least_flat = np.concatenate(least) if least else np.zeros(0, np.int64)
        first = np.zeros(len(contents), np.int64)
        first[several] = np.cumsum(windows[several]) - windows[several]
        for found, (content, doc, id_, start) in zip(answers, occurrences, strict=True):
            whole = single[content] & (owner[content] < id_)
            part = np.flatnonzero(~single[content])
            n = windows[content[part]]
            at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            lower = least_flat[np.repeat(first[content[part]], n) + at] < np.repeat(id_[part], n)
            # runs of neighbouring windows
            edge = np.r_[at == 0, True]
            begin = np.flatnonzero(lower & ~(np.r_[False, lower[:-1]] & ~edge[:-1]))
            end = np.flatnonzero(lower & ~(np.r_[lower[1:], False] & ~edge[1:]))
            rest = np.repeat(part, n)[begin]
            if len(rest) or whole.any():
                found.append((np.r_[doc[whole], doc[rest]], np.r_[start[whole], start[rest] + at[begin]], np.r_[windows[content[whole]], end - begin + 1]))

    answers = packed.select("batch", "texts", "lengths", "ids").groupBy("batch").cogroup(known.groupBy("batch")).applyInArrow(tidy_group(cut), ", ".join(f"{n} {t}" for n, t in zip(NAMES, ["long", "long"] + ["binary"] * 7, strict=True))).groupBy("slice").applyInArrow(tidy_group(compare), "batch long, doc binary, start binary, n binary")

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        for row in left.to_pylist():
            texts = unpacked(row["texts"], row["lengths"])
            lengths = np.frombuffer(row["lengths"], np.int64)
            base = np.cumsum(lengths + 1) - (lengths + 1)
            change = np.zeros(int((lengths + 1).sum()) + 1, np.int32)
            for a in right.to_pylist():
                at = base[np.frombuffer(a["doc"], np.int32)] + np.frombuffer(a["start"], np.int64)
                np.add.at(change, at, 1)
                np.add.at(change, at + np.frombuffer(a["n"], np.uint8) + width - 1, -1)
            covered = np.cumsum(change, dtype=np.int32) > 0
            tables.append(finish(row["ids"], texts, [covered[b : b + n] for b, n in zip(base.tolist(), lengths.tolist(), strict=True)], [row[f"c{i}"] for i in range(len(carry))]))
        return pa.concat_tables(tables) if tables else finish([], [], [], [[] for _ in carry])

    return packed.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(tidy_group(remove), schema)


#: Low bits of an anchor that the first pass leaves out; it may then let a few more pass.
KEPT = 14

NAMES = ["slice", "batch", "blob", "sizes", "names", "at", "doc", "id", "start"]


def runs(cover: np.ndarray) -> np.ndarray:
    """The first bytes of the maximal removed runs."""
    if not cover.any():
        return np.zeros(0, np.int64)
    first = np.flatnonzero(cover[1:] > cover[:-1]) + 1
    return np.r_[0, first] if cover[0] else first


def suffix_dedup(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text", texts: bool = True, **more) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``texts``, kept
    (binary) and spans (array of (start, length)).

    A byte goes if a string of ``width`` bytes over it also starts in a document
    with a smaller id. Null texts are empty; a null id is larger than any other and
    no smaller than another null; rows of one id leave one another alone. Texts
    under ``width`` bytes are kept. An empty table gives no rows; other columns are
    ignored.
    """
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<struct<start: long, length: long>>" * texts

    def finish(ids, bodies, covers, _):
        kept = [np.frombuffer(t, np.uint8)[~c].tobytes() if c.any() else t for t, c in zip(bodies, covers, strict=True)]
        starts = [runs(c) for c in covers]
        columns = {
            "doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array([len(t) for t in bodies], pa.int64()), "n_removed": pa.array([int(c.sum()) for c in covers], pa.int64()),
            "n_spans": pa.array([len(s) for s in starts], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
        }
        if texts:
            ends = [runs(c[::-1]) for c in covers]
            columns["kept"] = pa.array(kept, pa.binary())
            columns["spans"] = pa.array([[{"start": int(s), "length": int(len(c) - e - s)} for s, e in zip(a, b[::-1], strict=True)] for c, a, b in zip(covers, starts, ends, strict=True)], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))
        return pa.table(columns)

    return repeated_spans(docs, finish, schema, width=width, id_col=id_col, text_col=text_col, **more)


def without_repeats(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with what ``suffix_dedup`` removes taken out of the text, and its
    length in ``chars_col`` renewed. Bytes of a character that was cut in two go
    as well; a document of which nothing is left goes; one of which nothing was
    removed is as it was, null included."""
    carry = tuple(c for c in docs.columns if c not in (id_col, text_col, chars_col))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    names = [id_col, text_col, *([chars_col] if chars_col in docs.columns else []), *carry]
    # columns travel by number, so that no name can clash
    own = {c: f"d{i}" for i, c in enumerate(names)}
    schema = ", ".join(f"{own[c]} {'string' if c == text_col else 'long' if c in (id_col, chars_col) else kinds[c]}" for c in names) + ", gone boolean"
    arrow = {c: t for c, t in zip(names, pa_types(docs, names), strict=True)}

    def finish(ids, bodies, covers, carried):
        texts = [np.frombuffer(t, np.uint8)[~c].tobytes().decode("utf-8", "ignore") if c.any() else t.decode("utf-8", "replace") for t, c in zip(bodies, covers, strict=True)]
        columns = {own[id_col]: pa.array(ids, pa.int64()), own[text_col]: pa.array(texts, pa.string())}
        if chars_col in names:
            columns[own[chars_col]] = pa.array(list(map(len, texts)), pa.int64())
        columns |= {own[c]: pa.array(v, arrow[c]) for c, v in zip(carry, carried, strict=True)}
        columns["gone"] = pa.array([bool(c.any()) and not t for t, c in zip(texts, covers, strict=True)], pa.bool_())
        return pa.table(columns)

    known = docs.where(F.col(text_col).isNotNull())
    found = repeated_spans(known, finish, schema, width=width, id_col=id_col, text_col=text_col, carry=carry)
    kept = found.where("not gone").select(*[F.col(own[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
    return kept.union(docs.where(F.col(text_col).isNull()))


def pa_types(docs: DataFrame, names: list[str]) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(docs.schema[c].dataType) for c in names]

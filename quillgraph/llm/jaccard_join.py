"""Exact n-gram Jaccard self-join by adaptive multi-match prefixes.

Wang, Li and Feng, "Can we beat the prefix filtering?" (AdaptJoin, 2012). Two
sets with Jaccard similarity s and more share at least k of their first
n - ceil(s n) + k elements in any common order. A document with costly elements
in its prefix (those on long posting lists) takes a longer one, with a larger k:
a pair becomes a candidate only if it shares the smaller of the two k.

* Order: rare shingles first. Posting lengths are counted over all documents for
  the shingles that can stand in a prefix; frequent ones (at most ``frequent_most``
  of them, the longest lists, so the broadcast is bounded) come last, by length.
* Texts with the same set are one class and meet as one.
* A posting carries its set's size and its place in the order: a match at place i of
  a elements and j of b leaves at most min(a - i, b - j) in common, besides the
  matches before it. So a pair needs a match that can be its first, matches that can't
  be among its first k aren't counted, and a prefix is as short as both sizes allow.
* Short posting lists count the matches of all their pairs. Long ones, which lie over
  tasks by class, first give a star each: all members are compared with the hub, the
  member in whose order the list comes first (of a group of near copies the one with
  the fewest shingles of its own). Then members outside the hub's component meet the
  others by size and place; those with k matches, in short and long lists, go on.
  Links that can't change a component are never made, so a group of any number of
  near copies costs a few comparisons each; no other link is missed.
* Candidates are verified on their whole sets.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import batches_of_texts, cut, held, shared_dir, ship, tidy, tidy_group

NO_ID = np.iinfo(np.int64).max
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Odd multipliers of the words of a shingle.
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def odd_numbers(n: int) -> np.ndarray:
    """n fixed 64-bit numbers, well mixed."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) | np.uint64(1)


#: A number for each byte; upper case as lower case, white space none.
BYTES = odd_numbers(256)
BYTES[65:91] = BYTES[97:123]
BYTES[[9, 10, 11, 12, 13, 32]] = 0
BASE = 0xD6E8FEB86659FD93
PIECE = 1 << 20


class Shingler:
    """Sorted distinct 64-bit hashes of texts' word shingles, many texts at once.

    A word's hash is a polynomial of its bytes' numbers, from running sums over a
    whole piece of text, so that no word is looked at on its own."""

    def __init__(self, width: int):
        self.width = width
        size = PIECE + 64
        self.powers = np.cumprod(np.full(size, BASE, np.uint64))
        self.inverses = np.cumprod(np.full(size, pow(BASE, -1, 1 << 64), np.uint64))

    def words(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first byte) of each word of at most PIECE bytes of text."""
        x = BYTES[flat]
        inside = x != 0
        edges = np.flatnonzero(np.diff(np.r_[False, inside, False].view(np.int8)))
        starts, ends = edges[0::2], edges[1::2]
        x *= self.powers[: len(x)]
        total = np.r_[np.zeros(1, np.uint64), np.cumsum(x)]
        h = (total[ends] - total[starts]) * self.inverses[starts]
        h += (ends - starts).astype(np.uint64) * ODD[5]
        h ^= h >> np.uint64(32)
        h *= ODD[6]
        return h ^ (h >> np.uint64(29)), starts

    def long_words(self, text: bytes) -> np.ndarray:
        """The words of a text over PIECE bytes, piece by piece; one over PIECE itself
        is hashed on its own."""
        out, at = [], 0
        while at < len(text):
            end = min(len(text), at + PIECE)
            while end < len(text) and end > at and text[end] not in b" \t\n\r\x0b\x0c":
                end -= 1
            if end == at:  # no white space in PIECE bytes
                end = at + PIECE
                while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
                    end += 1
                words = [w.translate(LOWER) for w in text[at:end].split()]
                out.append(np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64))
            else:
                out.append(self.words(np.frombuffer(text[at:end], np.uint8))[0])
            at = end
        return np.concatenate(out)

    def shingles(self, h: np.ndarray, k: int) -> np.ndarray:
        n = len(h) - k + 1
        s = np.full(n, k, np.uint64)
        for i in range(k):
            s += h[i : n + i] * ODD[i % 8]
        s ^= s >> np.uint64(32)
        s *= ODD[2]
        return s ^ (s >> np.uint64(29))

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        held: list[bytes] = []
        size = 0
        for t in [*texts, None]:
            if held and (t is None or size + len(t) + 1 > PIECE):
                out += self.together(held)
                held, size = [], 0
            if t is not None:
                if len(t) > PIECE:
                    h = self.long_words(t)
                    out.append(np.unique(self.shingles(h, min(self.width, len(h)))) if len(h) else h)
                else:
                    held.append(t)
                    size += len(t) + 1
        return out

    def together(self, texts: list[bytes]) -> list[np.ndarray]:
        h, starts = self.words(np.frombuffer(b" ".join(texts), np.uint8))
        cuts = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)])).tolist()
        s = self.shingles(h, self.width) if len(h) >= self.width else h[:0]
        out = []
        for a, b in zip(cuts, cuts[1:]):
            if b - a >= self.width:
                own = np.sort(s[a : b - self.width + 1])
                out.append(own[np.r_[True, own[1:] != own[:-1]]])
            else:
                out.append(self.shingles(h[a:b], b - a) if b > a else h[:0])
        return out


def shingler(width: int) -> Shingler:
    return held(Shingler, width)


def class_of(s: np.ndarray) -> int:
    """A signed 64-bit name of a set; of m sets two share one with odds m^2 / 2^65."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64)))


def least_overlap(n, percent: int):
    return -(-n * percent // 100)


def short_keys(tokens: np.ndarray, slices: int) -> np.ndarray:
    """What a shingle is called when lists are counted: its slice and 32 bits of the
    rest. Two that share a name only make a list look longer."""
    n = np.uint64(slices)
    return (tokens % n) << np.uint64(32) | ((tokens // n) & np.uint64(0xFFFFFFFF))


class Order:
    """Prefixes in the common order: other shingles by hash, then frequent ones,
    short posting lists first."""

    def __init__(self, keys: np.ndarray, lengths: np.ndarray, slices: int, percent: int, long: int):
        place = np.argsort(keys)
        self.keys, self.lengths, self.slices, self.percent, self.long = keys[place], lengths[place], slices, percent, long

    def known(self, s: np.ndarray) -> np.ndarray:
        """The posting length of each shingle, 0 for those that aren't frequent."""
        if not len(self.keys):
            return np.zeros(len(s), np.int64)
        own = short_keys(s, self.slices)
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        return np.where(self.keys[at] == own, self.lengths[at], 0)

    def prefix(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(prefix, its posting lengths, matches it needs)."""
        n = len(s)
        first = n - int(least_overlap(n, self.percent)) + 1
        known = self.known(s[:first])
        if not known.any():  # the order of what comes first is by hash
            return s[:first], known, 1
        known = self.known(s)
        order = np.lexsort((s, known))
        s, known = s[order], known[order]
        # each doubling of the expected candidates beyond a long list's buys one more match
        k = min(1 + int(np.log2(1 + int(known[:first].sum()) / self.long)), n - first + 1)
        return s[: first + k - 1], known[: first + k - 1], k


#: A posting besides its shingle: class, size of its set, place in the common order
#: (at most 65,535: an earlier place only rules out less) and matches its prefix needs.
POSTING = (("cls", np.int64), ("size", np.uint32), ("place", np.uint16), ("k", np.uint8))


def dealt(tokens: np.ndarray, others: list[np.ndarray], slices: int) -> list[list]:
    """A row for each slice that has tokens: its number, 32 bits of each token, and
    the other arrays beside."""
    keys = short_keys(tokens, slices)
    order = np.argsort(keys, kind="stable")
    which = (keys[order] >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.r_[True, which[1:] != which[:-1], True]) if len(which) else [0]
    arrays = [keys.astype(np.uint32), *others]
    return [[int(which[a]), *(x[order[a:b]].tobytes() for x in arrays)] for a, b in zip(cuts, cuts[1:])]


def packed_rows(rows: list[list]) -> pa.RecordBatch:
    columns = [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(1, len(rows[0])))]
    return pa.RecordBatch.from_arrays(columns, ["slice", *(f"x{i}" for i in range(len(rows[0]) - 1))])


def joined(column, dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_py(), dtype) for x in column]) if len(column) else np.zeros(0, dtype)


def may_reach(size, place, other, other_place, percent: int, before=0):
    """Whether two postings of a shingle can be a match of sets similar enough that
    has ``before`` matches ahead of it: with places i and j, sets of a and b have at
    most before + min(a - i, b - j) in common. Arrays, or columns."""
    arrays = isinstance(size, np.ndarray)
    total = (size + other) * percent
    need = -(-total // (100 + percent)) if arrays else F.ceil(total / (100 + percent))
    return (np.minimum if arrays else F.least)(size - place, other - other_place) + before >= need


def similar_components(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text", long: int = 16, frequent: int = 16, frequent_most: int = 1_000_000, batch_bytes: int = 8 << 20, slice_bytes: int = 32 << 20, rounds: int = 3, classes: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) and,
    with ``classes``, cls and root: the names of the row's set and of its component.

    Rows whose sets have 100 |A and B| >= percent |A or B| are linked; rows with
    no words are linked with nothing. Null ids take part, and count for no
    component's smallest id (a component of null ids only has a null one);
    repeated rows are linked like any others. An empty table gives no rows; other
    columns are ignored. Intermediate tables go to the shared folder.

    ``rounds`` bounds how often stars are tried; whatever they leave is compared.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    folder = f"{shared_dir(spark)}/join-{uuid.uuid4().hex}"

    def members(batches):
        own = shingler(width)
        for ids, texts in batches_of_texts(batches, batch_bytes):
            sets = own.sets(texts)
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) if len(s) else None for s in sets], pa.int64())], names=["doc_id", "n_shingles", "cls"])

    docs.mapInArrow(tidy(members), "doc_id long, n_shingles long, cls long").write.parquet(f"{folder}/members")
    members_ = spark.read.parquet(f"{folder}/members")
    # of each set about a quarter travels as postings
    shingles = members_.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).head()[0]
    slices = max(48, shingles * 19 // 4 // slice_bytes)
    first_of = cut(members_.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("own")))

    def distinct_sets(texts):
        """One set a class of the batch."""
        seen = {}
        for s in shingler(width).sets(texts):
            if len(s):
                seen.setdefault(class_of(s), s)
        return seen

    def count(known, batches):
        """Posting lengths: of what can stand in a prefix, by hash; then of all that
        documents hold whose prefix has frequent shingles."""
        only = Order(*known.value, slices, percent, long) if known else None
        for _, texts in batches_of_texts(batches, batch_bytes):
            found = []
            for s in distinct_sets(texts).values():
                if only is None:
                    found.append(s[: len(s) - int(least_overlap(len(s), percent)) + 1 + len(s) // 16])
                elif only.known(s[: len(s) - int(least_overlap(len(s), percent)) + 1]).any():
                    found.append(s)
            if found:
                tokens, n = np.unique(np.concatenate(found), return_counts=True)
                rows = dealt(tokens, [np.minimum(n, 65535).astype(np.uint16)], slices)
                yield packed_rows([[i, tokens, zlib.compress(n, 1)] for i, tokens, n in rows])

    def lengths(table: pa.Table) -> pa.Table:
        tokens, inverse = np.unique(joined(table["x0"], np.uint32), return_inverse=True)
        counts = np.concatenate([np.frombuffer(zlib.decompress(x.as_py()), np.uint16) for x in table["x1"]])
        n = np.bincount(inverse, counts, len(tokens)).astype(np.int64)
        keep = n > frequent
        keys = tokens[keep].astype(np.int64) | table["slice"][0].as_py() << 32
        return pa.table({"token": pa.array(keys), "n": pa.array(n[keep])})

    def frequent_tokens(known):
        counted = docs.mapInArrow(tidy(lambda batches: count(known, batches)), "slice int, x0 binary, x1 binary").groupBy("slice").applyInArrow(tidy_group(lengths), "token long, n long")
        counted = cut(counted)
        total, least = counted.count(), frequent
        if total > frequent_most:
            least = counted.agg(F.percentile("n", 1 - frequent_most / total)).head()[0]
        found = counted.where(F.col("n") > least).toPandas()  # frequent_most at most
        return found.token.to_numpy().astype(np.int64).view(np.uint64), found.n.to_numpy().astype(np.int64)

    first = frequent_tokens(None)
    known = spark.sparkContext.broadcast(first)
    second = frequent_tokens(known)
    tokens, inverse = np.unique(np.concatenate([first[0], second[0]]), return_inverse=True)
    most = np.zeros(len(tokens), np.int64)
    np.maximum.at(most, inverse, np.concatenate([first[1], second[1]]))
    known = spark.sparkContext.broadcast((tokens, most))

    def prefixes(batches):
        """Postings by slice of their shingle; those of lists known to be long by
        class instead (slices below zero), so that no task gathers such a list."""
        order = Order(*known.value, slices, percent, long)
        for _, texts in batches_of_texts(batches, batch_bytes):
            parts, hot = [], []
            for cls, s in distinct_sets(texts).items():
                head, n, k = order.prefix(s)
                place = np.minimum(np.arange(len(head)), 65535)
                large = n > long
                for to, which in ((hot, large), (parts, ~large)):
                    if which.any():
                        m = int(which.sum())
                        to.append((head[which], np.full(m, cls, np.int64), np.full(m, len(s), np.uint32), place[which].astype(np.uint16), np.full(m, k, np.uint8)))
            rows = []
            if parts:
                head, *others = (np.concatenate(x) for x in zip(*parts, strict=True))
                rows = [[*r, None] for r in dealt(head, others, slices)]
            if hot:
                head, cls, *others = (np.concatenate(x) for x in zip(*hot, strict=True))
                by_class = dealt(cls.view(np.uint64), [short_keys(head, slices).view(np.int64), cls, *others], slices)
                rows += [[-1 - i, None, *r, token] for i, _, token, *r in by_class]
            if rows:
                yield packed_rows(rows)

    def lists(table: pa.Table) -> pa.Table:
        """Pairs of short posting lists (0, a, b, matches, needed, whether one may be the
        first); members of long ones (1, token, class, size, k, place)."""
        if table["slice"][0].as_py() < 0:
            token = joined(table["x5"], np.int64)
        else:
            token = joined(table["x0"], np.uint32).astype(np.int64) | table["slice"][0].as_py() << 32
        cls, size, place, k = (joined(table[f"x{i}"], kind).astype(np.int64) for i, (_, kind) in enumerate(POSTING, 1))
        order = np.lexsort((cls, token))
        token, cls, size, place, k = (x[order] for x in (token, cls, size, place, k))
        fresh = np.r_[True, (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])] if len(token) else np.zeros(0, bool)
        token, cls, size, place, k = (x[fresh] for x in (token, cls, size, place, k))
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
        run = np.diff(np.r_[starts, len(token)])
        large = np.repeat(run > long, run) if table["slice"][0].as_py() >= 0 else np.ones(len(token), bool)
        # pairs by distance: each posting with the d-th after it in its list
        at = np.arange(len(token)) - np.repeat(starts, run)
        left = np.where(large, 0, np.repeat(run, run) - at - 1)
        pairs = []
        i = np.flatnonzero(left >= 1)
        d = 1
        while len(i):
            j = i + d
            need = np.minimum(k[i], k[j])
            good = (np.minimum(size[i], size[j]) * 100 >= np.maximum(size[i], size[j]) * percent) & may_reach(size[i], place[i], size[j], place[j], percent, need - 1)
            first = may_reach(size[i], place[i], size[j], place[j], percent)
            pairs.append((cls[i[good]], cls[j[good]], need[good], first[good]))
            d += 1
            i = i[left[i] >= d]
        if pairs:
            a, b, need, first = (np.concatenate(x) for x in zip(*pairs, strict=True))
            order = np.lexsort((b, a))
            a, b, need, first = a[order], b[order], need[order], first[order].astype(np.int64)
            starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
            c = np.diff(np.r_[starts, len(a)])
            a, b, need, first = a[starts], b[starts], need[starts], np.maximum.reduceat(first, starts) if len(a) else first
        else:
            a = b = need = first = c = np.zeros(0, np.int64)
        m = int(large.sum())
        both = lambda x, y: pa.array(np.r_[x, y])
        return pa.table({"kind": pa.array(np.r_[np.zeros(len(a), np.int32), np.ones(m, np.int32)]), "x": both(a, token[large]), "y": both(b, cls[large]), "n": both(c, size[large]), "need": both(need, k[large]), "place": both(first, place[large])})

    docs.mapInArrow(tidy(prefixes), "slice int, x0 binary, x1 binary, x2 binary, x3 binary, x4 binary, x5 binary").groupBy("slice").applyInArrow(tidy_group(lists), "kind int, x long, y long, n long, need long, place long").write.partitionBy("kind").parquet(f"{folder}/lists")
    found = spark.read.schema("x long, y long, n long, need long, place long, kind int").parquet(f"{folder}/lists")
    postings = found.where("kind = 1").select(F.col("x").alias("token"), F.col("y").alias("cls"), F.col("n").alias("size"), F.col("need").alias("k"), "place")
    short = found.where("kind = 0").select("x", "y", "n", "need", F.col("place").alias("first"))

    links, roots = None, None
    placed = cut(postings.withColumn("root", F.col("cls")))
    hub = F.min(F.struct((F.col("place") / F.col("size")).alias("at"), "cls", "size", "root")).alias("hub")

    def hubs_of(lists):
        """token, hub, hub_size, hub_root of lists whose members aren't all joined."""
        found = lists.groupBy("token").agg(hub, F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
        return cut(found.select("token", F.col("hub.cls").alias("hub"), F.col("hub.size").alias("hub_size"), F.col("hub.root").alias("hub_root")))

    rest = placed
    for _ in range(rounds):
        stars = rest.join(hubs_of(rest), "token").where("root <> hub_root").where(F.least("size", "hub_size") * 100 >= F.greatest("size", "hub_size") * percent)
        stars = cut(stars.select(F.col("cls").alias("x"), F.col("hub").alias("y")).distinct())
        new = None if stars.isEmpty() else cut(verified(docs, first_of, stars, percent, width, batch_bytes))
        if new is None or new.isEmpty():
            break
        links = new if links is None else cut(links.union(new))
        roots = cut(components(links))
        placed = cut(postings.join(roots, postings.cls == roots.node, "left").select(*postings.columns, F.coalesce("root", "cls").alias("root")))
        # the next stars are of those that no hub has reached
        rest = cut(placed.join(hubs_of(placed).select("token", "hub_root"), "token").where("root <> hub_root").drop("hub_root"))

    more = crossing(placed, hubs_of(placed), percent)
    if roots is not None:  # what is joined already is let go
        root = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
        short = short.join(root("x"), "x", "left").join(root("y"), "y", "left").where("coalesce(root_x, x) <> coalesce(root_y, y)").select("x", "y", "n", "need", "first")
    pairs = short.unionByName(more).groupBy("x", "y").agg(F.sum("n").alias("n"), F.max("need").alias("need"), F.max("first").alias("first")).where("first = 1")
    # matches in long lists count as well
    own = cut(postings.groupBy("cls").agg(F.collect_list("token").alias("t")))  # no more than a prefix has
    side = lambda name: own.select(F.col("cls").alias(name), F.col("t").alias(f"t{name}"))
    pairs = cut(pairs)
    open_ = pairs.where("n < need").join(side("x"), "x").join(side("y"), "y").where(F.col("n") + F.size(F.array_intersect("tx", "ty")) >= F.col("need"))
    pairs = cut(pairs.where("n >= need").select("x", "y").union(open_.select("x", "y")))
    if not pairs.isEmpty():
        new = cut(verified(docs, first_of, pairs, percent, width, batch_bytes))
        roots = cut(components(new if links is None else links.union(new)))
    if roots is None:
        roots = spark.range(0).select(F.col("id").alias("node"), F.col("id").alias("root"))

    named = cut(first_of.join(roots, first_of.cls == roots.node, "left").select("cls", "own", F.coalesce("root", "cls").alias("root")))
    of_root = named.groupBy("root").agg(F.min("own").alias("component_id"))
    by_class = cut(named.join(of_root, "root").select("cls", "component_id", "root"))
    return members_.join(by_class, "cls", "left").select("doc_id", "n_shingles", *(["cls", "root"] if classes else []), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def crossing(placed: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """x, y, n (0), need, first (1): pairs of classes that no links join and that meet
    in a long list at places that can be their first match.

    In each list the members outside the hub's component meet all others. What a
    member can reach has sizes from ``percent`` of its own to a bound that falls
    with its place, so that members late in their order meet few or none: lists are
    joined by token and band of sizes (four percent wide), which also divides them.
    """
    band = lambda size: F.floor(F.log2(size) * 16)
    lists = placed.join(hubs.select("token", "hub_root"), "token").withColumn("out", F.col("root") != F.col("hub_root")).drop("hub_root")
    outside = lists.where("out").select("token", *(F.col(c).alias(f"{c}_x") for c in ("cls", "size", "k", "place", "root")))
    most = F.floor((F.col("size_x") - F.col("place_x")) * F.lit((100 + percent) / percent) + F.lit(1e-6)) - F.col("size_x")
    least = F.ceil(F.col("size_x") * F.lit(percent / 100) - F.lit(1e-6))
    outside = outside.withColumn("most", F.least(most, F.floor(F.col("size_x") * F.lit(100 / percent) + F.lit(1e-6)))).where(F.col("most") >= least)
    outside = outside.withColumn("band", F.explode(F.sequence(band(least), band(F.col("most")))))
    met = outside.join(lists.withColumn("band", band(F.col("size"))), ["token", "band"])
    met = met.where("root <> root_x").where(~F.col("out") | (F.col("cls") > F.col("cls_x")))
    met = met.where(F.least("size", "size_x") * 100 >= F.greatest("size", "size_x") * percent)
    met = met.where(may_reach(F.col("size"), F.col("place"), F.col("size_x"), F.col("place_x"), percent))
    return met.select(F.least("cls", "cls_x").alias("x"), F.greatest("cls", "cls_x").alias("y"), F.lit(0).cast("long").alias("n"), F.least("k", "k_x").alias("need"), F.lit(1).cast("long").alias("first"))


def verified(docs: DataFrame, first_of: DataFrame, pairs: DataFrame, percent: int, width: int, batch_bytes: int, bits: int = 1 << 24) -> DataFrame:
    """x, y: those of ``pairs`` (classes) whose whole sets are similar enough.

    One document stands for each class, that of ``first_of``. Its text travels,
    compressed, which is less than its set; a bitmap of fixed size over their ids
    keeps others back (those that it lets pass are dropped by the join), and each
    pair meets by two joins.
    """
    spark = docs.sparkSession
    ends = pairs.select(F.explode(F.array("x", "y")).alias("cls")).distinct()
    chosen = cut(first_of.join(ends, "cls").select("cls", F.coalesce("own", F.lit(NO_ID)).alias("doc_id")))
    place = F.pmod("doc_id", F.lit(bits))
    words = chosen.groupBy(F.shiftright(place, 5).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1, cast(pmod(doc_id, {bits}) % 32 as int))")).alias("b")).toPandas()  # bits / 32 rows at most
    bitmap = np.zeros(bits // 32, np.uint32)
    bitmap[words.w.to_numpy(dtype=np.int64)] = words.b.to_numpy(dtype=np.int64).astype(np.int32).view(np.uint32)
    wanted = spark.sparkContext.broadcast(zlib.compress(bitmap.tobytes(), 1))

    def texts_of(batches):
        bits_set = np.frombuffer(zlib.decompress(wanted.value), np.uint32)
        for ids, texts in batches_of_texts(batches, batch_bytes):
            names = np.array([NO_ID if i is None else i for i in ids.to_pylist()], np.int64)
            at = names % bits
            good = np.flatnonzero(bits_set[at >> 5] >> (at & 31).astype(np.uint32) & np.uint32(1))
            own = [texts[i] for i in good.tolist()]
            sets = shingler(width).sets(own)
            keep = [i for i, s in enumerate(sets) if len(s)]
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array([class_of(sets[i]) for i in keep], pa.int64()), pa.array(names[good][keep]), pa.array([zstandard.compress(own[i], 1) for i in keep], pa.binary())], names=["cls", "doc_id", "z"])

    def similar(batches):
        own = shingler(width)
        lately: dict[bytes, np.ndarray] = {}  # sets of hubs come again
        bytes_held = 0

        def set_of(z: bytes) -> np.ndarray:
            nonlocal bytes_held
            if z not in lately:
                (s,) = own.sets([zstandard.decompress(z)])
                bytes_held += len(z) + s.nbytes
                if bytes_held > batch_bytes:
                    lately.clear()
                    bytes_held = len(z) + s.nbytes
                lately[z] = s
            return lately[z]

        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = set_of(a.as_py()), set_of(b.as_py())
                both = len(a) + len(b)
                together = np.sort(np.concatenate([a, b]))
                shared = int((together[1:] == together[:-1]).sum())
                keep.append(100 * shared >= percent * (both - shared))
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    found = docs.mapInArrow(tidy(texts_of), "cls long, doc_id long, z binary").join(chosen, ["cls", "doc_id"], "left_semi").select("cls", "z")
    found = cut(found.groupBy("cls").agg(F.min("z").alias("z")))  # one of repeated rows
    half = pairs.join(found.select(F.col("cls").alias("y"), F.col("z").alias("zy")), "y")
    whole = half.join(found.select(F.col("cls").alias("x"), F.col("z").alias("zx")), "x").select("x", "y", "zx", "zy")
    return whole.mapInArrow(tidy(similar), "x long, y long")


def one_of_each(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component left, that of the smallest id (null
    ids last, then by set); rows without words all stay. Columns are as they were."""
    spark = docs.sparkSession
    found = cut(similar_components(docs, percent, width, id_col, text_col, classes=True).where("cls is not null"))  # a table, not rows by class
    found = cut(found.groupBy("doc_id", "cls", "root").agg(F.count(F.lit(1)).alias("copies")))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "cls", "copies")).alias("f")).select(F.col("f.doc_id").alias("first_id"), F.col("f.cls").alias("first_cls"), F.col("f.copies").alias("copies"))
    names = docs.columns

    def named(batches):
        own = shingler(width)
        for batch in batches:
            at = 0
            for _, texts in batches_of_texts([batch.select(["key_id", "key_text"])], 8 << 20):
                cls = [class_of(s) if len(s) else None for s in own.sets(texts)]
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns[2:], pa.array(cls, pa.int64())], names=[*(f"c{i}" for i in range(len(names))), "cls"])
                at += len(texts)

    kinds = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names))
    keyed = docs.select(F.col(id_col).cast("long").alias("key_id"), F.col(text_col).cast("string").alias("key_text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    rows = keyed.mapInArrow(tidy(named), f"{kinds}, cls long")
    id_ = F.col(f"c{names.index(id_col)}").cast("long")
    kept = rows.where("cls is not null").join(first, (F.col("cls") == F.col("first_cls")) & id_.eqNullSafe(F.col("first_id")))
    kept = kept.where("copies = 1").drop("first_id", "first_cls", "copies", "cls").union(kept.where("copies > 1").dropDuplicates(["first_id", "first_cls"]).drop("first_id", "first_cls", "copies", "cls"))
    return kept.union(rows.where("cls is null").drop("cls")).toDF(*names)

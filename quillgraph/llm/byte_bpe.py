"""Byte-level BPE encoding and decoding by recursive queries.

Each partition holds its words as token-position rows in an embedded DuckDB. One
recursive query a batch joins neighbouring positions to the merge table and
contracts, in every word, the leftmost pair of least rank, until no pair of any word
is in the table. Decoding joins ids to their bytes and aggregates them in order.

In long words a round takes several steps at once: pairs of the same least rank, from
the left, that don't overlap. A contraction can make a pair of a lower rank, which
then is the next step; so each contracted pair is looked at with the neighbours that
it has when single steps come to it (to its left what the step before made of it, to
its right what stands there), and the round ends at the first one that makes such a
pair. Up to there the single steps are the same.

A word is encoded once a worker while it stays in a bounded cache. The recursion
is run in stretches of bounded depth, restarting from the last state, so that
its union of all rounds stays bounded for words of any length. What a word of tens of
megabytes needs beyond the database's 700 MB goes to the worker's scratch folder.
"""

from __future__ import annotations

import base64
import hashlib
import os
import tempfile

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, batches_of_texts, held, ship, tidy

RANKS = "byte_bpe_50k.tiktoken"

#: One pair a round: few operators, for words of ordinary length.
SINGLE = """
with recursive s(w, p, t, r) as (
  select w, p, t, 0 from state
  union all
  (with a as (
     select w, p, t, lead(t) over x as n, lead(p) over x as q
     from s where r < {depth} window x as (partition by w order by p)),
   pick as (
     select w, min((m.k::bigint << 32) | p) as kp, arg_min(q, (m.k::bigint << 32) | p) as q
     from a join merges m on m.pair = (a.t::bigint << 32) | a.n group by w)
   select s.w, s.p, case when s.p = (kp & 4294967295) then (kp >> 32)::int else s.t end, s.r + 1
   from s join pick using (w) where s.p <> pick.q and s.r < {depth})
)
select s.w, s.p, s.t, s.r from s join (select w, max(r) as r from s group by w) using (w, r) order by s.w, s.p
"""

#: As many pairs of the least rank a round as single steps would take next, for long words.
STRETCH = """
with recursive s(w, p, t, r) as (
  select w, p, t, 0 from state
  union all
  (with a as (
     select w, p, t, r, lag(t) over x as l, lead(t) over x as n, lead(t, 2) over x as y, lead(p) over x as q, row_number() over x as i
     from s where r < {depth} window x as (partition by w order by p)),
   b as (
     select a.w, a.p, a.q, a.i, a.l, a.y, a.t = a.n as same, m.k
     from a join merges m on m.pair = (a.t::bigint << 32) | a.n),
   best as (select w, min(k) as k from b group by w),
   hit as (
     select b.*, row_number() over (partition by b.w order by b.p) as j
     from b join best on b.w = best.w and b.k = best.k),
   every_ as (
     select w, p, q, i, k, l, y from (
       select *, row_number() over (partition by w, i - j order by p) as nth from hit)
     where not same or nth % 2 = 1),
   beside as (
     select w, p, k, y, case when lag(i) over (partition by w order by p) = i - 2 then k else l end as l from every_),
   ends as (
     select w, min(p) as p from (
       select e.w, e.p from beside e join merges m on m.pair = (e.l::bigint << 32) | e.k where m.k < e.k
       union all
       select e.w, e.p from beside e join merges m on m.pair = (e.k::bigint << 32) | e.y where m.k < e.k)
     group by w),
   pick as (
     select e.w, e.p, e.q, e.k from every_ e left join ends on ends.w = e.w where ends.p is null or e.p <= ends.p)
   select s.w, s.p, coalesce(l.k, s.t), s.r + 1
   from s join best using (w)
     left join pick l on l.w = s.w and l.p = s.p
     left join pick g on g.w = s.w and g.q = s.p
   where g.w is null and s.r < {depth})
)
select s.w, s.p, s.t, s.r from s join (select w, max(r) as r from s group by w) using (w, r) order by s.w, s.p
"""


class Codec:
    """Encodes words and decodes ids of one rank file in an embedded DuckDB."""

    def __init__(self, path: str, pattern: str, cached_words: int = 300_000, rows: int = 20_000_000):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern).findall
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [(ranks[w[:i]] << 32 | ranks[w[i:]], k) for w, k in ranks.items() for i in range(1, len(w)) if w[:i] in ranks and w[i:] in ranks]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "700MB", "temp_directory": f"{tempfile.gettempdir()}/bpe-{os.getpid()}", "max_temp_directory_size": "8GB"})
        self.db.register("m", pa.table({"pair": [p for p, _ in pairs], "k": pa.array([k for _, k in pairs], pa.int32())}))
        self.db.execute("create table merges as from m")
        self.db.register("v", pa.table({"t": pa.array(list(ranks.values()), pa.int32()), "hex": [w.hex() for w in ranks]}))
        self.db.execute("create table vocabulary as from v")
        self.words = Recent(cached_words)
        self.rows = rows

    def encode_words(self, words: list[str], long: int = 64) -> list[bytes]:
        """Each word's ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        for query, own in ((SINGLE, [i for i, x in enumerate(words) if len(x) <= long]), (STRETCH, [i for i, x in enumerate(words) if len(x) > long])):
            if own:
                for i, ids in zip(own, self.contracted([words[i] for i in own], query), strict=True):
                    out[i] = ids
        return out

    def contracted(self, words: list[str], query: str) -> list[bytes]:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.array([len(b) for b in raw])
        t = self.single[np.frombuffer(b"".join(raw), np.uint8)]
        w = np.repeat(np.arange(len(raw), dtype=np.int32), lengths)
        p = (np.arange(len(w)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        out: list[bytes] = [b""] * len(raw)
        while len(w):
            depth = max(1, min(48, self.rows // len(w)))
            self.db.register("state", pa.table({"w": w, "p": p, "t": t}))
            r = self.db.execute(query.format(depth=depth)).fetchnumpy()
            w, p, t = (np.ascontiguousarray(r[c]) for c in ("w", "p", "t"))
            going = r["r"] >= depth
            done = np.flatnonzero(~going)
            if len(done):
                which = w[done]
                ids = t[done].astype("<u4")
                cuts = np.flatnonzero(np.r_[True, np.diff(which) != 0, True])
                packed = ids.tobytes()
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    out[which[a]] = packed[4 * a : 4 * b]
            w, p, t = w[going], p[going], t[going]
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        words = [self.split(x.decode("utf-8", "replace")) for x in texts]
        missing = self.words.missing(set().union(*words))
        for at in range(0, len(missing), 100_000):
            part = missing[at : at + 100_000]
            self.words.young.update(zip(part, self.encode_words(part), strict=True))
        get = self.words.young.__getitem__
        return [b"".join(map(get, x)) for x in words]

    def decode(self, ids: list[bytes], most: int = 2_000_000) -> list[bytes]:
        """The bytes of each id list, by an ordered aggregation."""
        out: list[bytes] = [b""] * len(ids)
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        lengths = np.array([len(x) // 4 for x in ids], np.int64)
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), lengths)
        parts: dict[int, list[str]] = {}
        for at in range(0, len(flat), most):
            end = min(at + most, len(flat))
            self.db.register("ids", pa.table({"d": doc[at:end], "p": np.arange(end - at, dtype=np.int32), "t": flat[at:end]}))
            for d, text in self.db.execute("select d, string_agg(hex, '' order by p) from ids join vocabulary using (t) group by d").fetchall():
                parts.setdefault(d, []).append(text)
        for d, found in parts.items():
            out[d] = bytes.fromhex("".join(found))
        return out


def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process."""
    return held(Codec, path, pattern)


def byte_bpe(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``keep_ids``, ids
    (binary, little-endian unsigned 32-bit) and decoded (binary).

    A null text is empty: no tokens, digests of nothing. Null or repeated ids
    and repeated rows are rows of their own; other columns are ignored; an empty
    table gives no rows. No shuffle: one pass over the texts.
    """
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    ship(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded binary" * keep_ids

    def run(batches):
        own = codec(path, pattern)
        for doc_ids, texts in batches_of_texts(batches, 4 << 20):
            ids = own.encode(texts)
            decoded = own.decode(ids)
            sha = lambda xs: [hashlib.sha256(x).hexdigest() for x in xs]
            columns = [doc_ids, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(sha(ids)), pa.array(sha(decoded))]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns += [pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), schema)

"""Repeated substrings removed by merging Burrows-Wheeler transforms of shards.

Every string of WIDTH bytes belongs to the least hash among its GRAM-byte pieces (its minimizer), so equal
strings always share a minimizer. Consecutive strings whose minimizer stands at one place form a run; no
string occurs twice in a run.

1. Runs are dealt out by minimizer. A run whose minimizer stands nowhere else holds no repeat. Of runs
   equal byte for byte (told by their minimizer and 64 bits of hashes of their ends and length) the first is kept as the dictionary's entry, and the
   others are repeats as a whole, as in prefix-free parsing.
2. Dictionary entries whose minimizer others share too are fetched from the texts, a shard for each
   group of documents.
3. Of each minimizer group the shards' Burrows-Wheeler transforms are built and merged: the
   interleave vector, which tells the shard of each row, starts as shard by shard, and each refinement
   deals it out stably by the symbols that precede the rows, after which rows are in order of so many
   symbols more. Symbols are taken q at a time, from the q-step transform. Borders between rows whose
   prefixes differ are carried along, so WIDTH symbols later the intervals of rows between borders are
   the strings with a common prefix of WIDTH bytes. Suffixes are never sorted across shards.
4. In each interval the string that starts first stays; the others' bytes are removed.

Hot minimizers: a passage that many texts share has an entry for each text at its edges, where each text's
own bytes begin. A group of over HOT entries is split by the longest context there is, the string itself: its
runs become single strings that are dealt out by 128 bits of hashes, and of equal ones the first stays. So no
merge ever takes more than HOT entries of one minimizer, and no string is left out.

Bounds: buckets follow the input's splits and the shuffle partitions, of which there are PARTITIONS at most; their rows stream by, and of equal
ones only the first is held. Texts are hashed in pieces of CHUNK bytes, whatever their length, runs are
collapsed FLUSH at a time before they are dealt out, and a merge takes whole minimizer groups up to about
LIMIT bytes at a time, at 70 bytes of memory for each. Documents are dealt out by id and text, so only rows
equal in both meet in one task whatever their number.

Defined results: null text: empty; texts under WIDTH bytes: nothing removed; null ids stand after all
others, in order of the texts' crc32; ids are whole numbers; rows equal in id and text are one document and
get the same result; rows that share an id only go by the text's crc32, and are told apart by 32 bits more, or 96 under a null id; empty table: no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, bound_batches, in_chunks, parts, raw_texts, starts_of, written

WIDTH, GRAM = 100, 32
CHUNK, FLUSH, PLACE = 1 << 19, 1 << 18, (1 << 26) - 1
#: Entries of a minimizer beyond which it is hot; bytes of a merge; rows of a bucket held before equal ones are put together.
HOT, LIMIT, HELD = 4096, 1 << 16, 1 << 18
PARTITIONS = 1 << 14  # of a shuffle at most; further buckets share them and stream by one after the other
LAST = np.iinfo(np.int64).max  # what null ids count as
MULT, OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _rolled(buf: np.ndarray, mult: np.uint64) -> tuple[dict, dict]:
    """Polynomial hashes of 1, 2, 4 .. bytes up to WIDTH at each place, and what joins them, by their length."""
    powers, hashes, span = {}, {}, 1
    h = (buf.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        while True:
            hashes[span], powers[span] = h, mult
            if span * 2 > WIDTH:
                return hashes, powers
            h, mult, span = h[:-span] * mult + h[span:], mult * mult, span * 2


def _joined(hashes: dict, powers: dict, m: int) -> np.ndarray:
    """Hashes of the strings of WIDTH bytes at the first m places."""
    whole, at = np.zeros(m, np.uint64), 0
    for s in sorted(hashes, reverse=True):
        if WIDTH - at >= s:
            whole = whole * powers[s] + hashes[s][at : at + m]
            at += s
    return whole


def text_runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of the texts: (text, start, number of strings, minimizer, second hash of the bytes).

    A run has WIDTH - GRAM + 1 strings at most, so its first and last string cover it.
    """
    size = np.array([len(t) for t in texts], np.int64)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    n = len(buf)
    if n < WIDTH:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    hashes, powers = _rolled(buf, MULT)
    m = n - WIDTH + 1
    whole = _joined(hashes, powers, m)
    # the least hash and, of equal ones, the leftmost: the low bits hold the place
    gram = _mix(hashes[GRAM])
    del hashes
    place = np.arange(len(gram), dtype=np.uint64) & np.uint64(PLACE)
    least, count, want = (gram & ~np.uint64(PLACE)) | place, 1, WIDTH - GRAM + 1
    while count * 2 <= want:
        least, count = np.minimum(least[:-count], least[count:]), count * 2
    if want > count:
        least = np.minimum(least[:m], least[want - count : want - count + m])
    ends = np.cumsum(size)
    text = np.repeat(np.arange(len(texts)), size)[:m]
    fits = np.arange(m) + WIDTH <= ends[text]
    new = np.ones(m, bool)
    new[1:] = (least[1:] != least[:-1]) | ~fits[:-1] | (text[1:] != text[:-1])
    begin = np.flatnonzero(new & fits)
    border = np.flatnonzero(new | ~fits)
    stop = np.append(border, m)[np.searchsorted(border, begin, "right")]
    length = stop - begin
    second = _mix(whole[begin] * MULT + _mix(whole[stop - 1] + length.astype(np.uint64)))
    t = text[begin]
    anchor = begin + ((least[begin] - begin.astype(np.uint64)) & np.uint64(PLACE)).astype(np.int64)
    return t, begin - (ends - size)[t], length, gram[anchor], second


def string_hashes(data: bytes, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each string of WIDTH bytes in runs of so many strings, whose bytes stand one after the other."""
    buf = np.frombuffer(data, np.uint8)
    at = np.repeat(starts_of(length + WIDTH - 1) - starts_of(length), length) + np.arange(length.sum())
    return tuple(_mix(_joined(*_rolled(buf, mult), len(buf) - WIDTH + 1)[at]) for mult in (MULT, OTHER))


#: A packet: parallel arrays of runs or of covered stretches (kind 1) on their way to a bucket.
PACKET = "bucket int, kind int, doc binary, crc binary, start binary, length binary, low binary, high binary"
DTYPES = (np.int64, np.dtype("S16"), np.uint32, np.uint32, np.uint64, np.uint64)
RUN, COVER, SEND, SPLIT = 0, 1, 2, 3


def packets(schema: pa.Schema, bucket: np.ndarray, kind: int, *arrays: np.ndarray) -> pa.RecordBatch:
    """One packet for each bucket that has rows; missing arrays are empty."""
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    pieces = np.split(order, cut) if len(order) else []
    cols = [pa.array([int(bucket[p[0]]) for p in pieces], pa.int32()), pa.array([kind] * len(pieces), pa.int32())]
    for i, t in enumerate(DTYPES):
        data = arrays[i].astype(t) if i < len(arrays) else None
        cols.append(pa.array([b"" if data is None else data[p].tobytes() for p in pieces], pa.binary()))
    return pa.RecordBatch.from_arrays(cols, schema=schema)


def unpack(rows) -> list[np.ndarray]:
    """The arrays of many packets (rows of their six binary columns), joined."""
    return [np.concatenate([np.zeros(0, t), *(np.frombuffer(r[i], t) for r in rows)]) for i, t in enumerate(DTYPES)]


def _bucket(low: np.ndarray, n: int) -> np.ndarray:
    return ((low >> np.uint64(20)) % np.uint64(n)).astype(np.int64)


def _home(doc: np.ndarray, crc: np.ndarray, n: int) -> np.ndarray:
    """The bucket of a document."""
    told = np.ascontiguousarray(crc, "S16").view(np.uint64).reshape(-1, 2)[:, 0]
    return _bucket(_mix((doc.astype(np.int64).view(np.uint64) + told * OTHER) * MULT), n)


def told_apart(ids: pa.Array, texts: list[bytes]) -> np.ndarray:
    """What tells texts of one id apart, in order of their crc32: it and other hash bits, 96 under a null id and 32 under another, where zeros follow."""
    more = [12 if i is None else 4 for i in ids.to_pylist()]
    return np.array([zlib.crc32(t).to_bytes(4, "big") + xxhash.xxh3_128_digest(t)[:n] for n, t in zip(more, texts, strict=True)], "S16")


def _ids(column: pa.Array) -> np.ndarray:
    return np.array([LAST if x is None else x for x in column.to_pylist()], np.int64)


def _first_of_equal(doc, crc, start, *same) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by same, then place; and in that order which rows begin a class and which repeat its first."""
    order = np.lexsort((start, crc, doc, *reversed(same)))
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[order][1:] != x[order][:-1] for x in same], axis=0)
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    other = ~np.all([x[order] == x[order][first] for x in (doc, crc, start)], axis=0)
    return order, new, other


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(text, offset, bytes): long texts in pieces of CHUNK strings each, so that a run may be cut in two."""
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - WIDTH + 1), CHUNK):
            yield i, at, t[at : at + CHUNK + WIDTH - 1]


def _covers(n: int, schema: pa.Schema, doc, crc, start, strings) -> pa.RecordBatch:
    """Packets of the stretches that so many strings from start on cover."""
    return packets(schema, _home(doc, crc, n), COVER, doc, crc, start, strings + WIDTH - 1)


def _find_runs(n: int, schema: pa.Schema, flush_at: int):
    def run(batches):
        held, rows = [], 0

        def flush():
            doc, crc, start, length, low, high = (np.concatenate(x) for x in zip(*held, strict=True))
            order, new, other = _first_of_equal(doc, crc, start, low, high)
            keep, rest = order[new], order[other]
            yield packets(schema, _bucket(low[keep], n), RUN, *(x[keep] for x in (doc, crc, start, length, low, high)))
            # equal to an earlier run of this batch: covered, whatever the others hold
            yield _covers(n, schema, doc[rest], crc[rest], start[rest], length[rest])

        for b in batches:
            ids = _ids(b.column(0))
            texts = raw_texts(b.column(1))
            crcs = told_apart(b.column(0), texts)
            for chunk in in_chunks(_pieces(texts), CHUNK, lambda x: len(x[2])):
                t, start, length, low, high = text_runs([x[2] for x in chunk])
                of, offset = (np.array([x[i] for x in chunk], np.int64)[t] for i in (0, 1))
                held.append((ids[of], crcs[of], (start + offset).astype(np.uint32), length.astype(np.uint32), low, high))
                rows += len(t)
                if rows >= flush_at:
                    yield from flush()
                    held, rows = [], 0
        if held:
            yield from flush()

    return run


def _by_bucket(rows: DataFrame, bucket, ddl: str) -> DataFrame:
    """Rows sorted by their first column go one by one to bucket(), which gives add(row) and end() of a bucket."""

    def run(batches):
        at, own = None, None
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[0] != at:
                    if own:
                        yield from own.end()
                    at, own = r[0], bucket()
                yield from own.add(r)
        if own:
            yield from own.end()

    return rows.mapInArrow(run, ddl)


class Firsts:
    """Of rows (doc, crc, start, length, low, high) equal in low and high the first; the others are covered."""

    def __init__(self, n: int, schema: pa.Schema, most: int):
        self.n, self.schema, self.least, self.most = n, schema, most, most
        self.held, self.rows = [], 0

    def add(self, cols: list[np.ndarray]):
        self.held.append(cols)
        self.rows += len(cols[0])
        if self.rows >= self.most:
            yield from self.compact()
            self.most = max(self.least, 2 * self.rows)

    def compact(self):
        """Covers; what is held afterwards is one array a column, in order of low."""
        cols = [np.concatenate(x) for x in zip(*self.held, strict=True)] if self.held else unpack([])
        doc, crc, start, length, low, high = cols
        order, new, other = _first_of_equal(doc, crc, start, low, high)
        rest = order[other]
        yield _covers(self.n, self.schema, doc[rest], crc[rest], start[rest], length[rest])
        self.held = [[c[order[new]] for c in cols]]
        self.rows = int(new.sum())


class Runs(Firsts):
    """A bucket of runs: stretches covered as a whole, entries to be compared, and runs of hot minimizers."""

    def __init__(self, n: int, schema: pa.Schema, most: int, hot: int):
        super().__init__(n, schema, most)
        self.limit, self.hot = hot, np.zeros(0, np.uint64)

    def add(self, row):
        kind, cols = row[1], unpack([row[2:]])
        if kind == COVER:
            yield _covers(self.n, self.schema, *cols[:3], cols[3] - np.uint32(WIDTH - 1))
            return
        split = np.isin(cols[4], self.hot)
        if split.any():
            yield self.sent(SPLIT, [c[split] for c in cols])
            cols = [c[~split] for c in cols]
        yield from super().add(cols)

    def sent(self, kind: int, cols: list[np.ndarray]) -> pa.RecordBatch:
        return packets(self.schema, _home(cols[0], cols[1], self.n), kind, *cols[:5])

    def compact(self):
        yield from super().compact()
        cols = self.held[0]
        low, count = np.unique(cols[4], return_counts=True)
        if (count > self.limit).any():
            self.hot = np.union1d(self.hot, low[count > self.limit])
            split = np.isin(cols[4], self.hot)
            yield self.sent(SPLIT, [c[split] for c in cols])
            self.held = [[c[~split] for c in cols]]
            self.rows = int((~split).sum())

    def end(self):
        yield from self.compact()
        cols = self.held[0]
        low = cols[4]
        shared = np.zeros(len(low), bool)
        shared[1:] = low[1:] == low[:-1]
        shared[:-1] |= low[1:] == low[:-1]
        yield self.sent(SEND, [c[shared] for c in cols])


ENTRIES = "bucket int, kind int, shard int, doc binary, crc binary, start binary, length binary, low binary, high binary, bytes binary"
SLICE = 1 << 14  # runs of hot minimizers that are cut into strings at a time


def _entries(n: int, schema: pa.Schema):
    """Cuts a shard's dictionary entries, and the strings of hot minimizers, out of its documents."""

    def by(to):
        order = np.argsort(to, kind="stable")
        return np.split(order, np.flatnonzero(np.diff(to[order])) + 1) if len(to) else []

    def run(docs: pa.Table, sends: pa.Table) -> pa.Table:
        if not sends.num_rows or not docs.num_rows:
            return schema.empty_table()
        ids, whole = docs["doc_id"].combine_chunks(), raw_texts(docs["text"].combine_chunks())
        texts = dict(zip(zip(_ids(ids).tolist(), told_apart(ids, whole).tolist(), strict=True), whole, strict=True))
        rows = list(zip(*(sends[c].to_pylist() for c in ("kind", "doc", "crc", "start", "length", "low", "high")), strict=True))
        shard, out = docs["home"][0].as_py(), []

        def cut(cols, p):
            spans = zip(*(c[p].tolist() for c in cols[:3]), (cols[2][p].astype(np.int64) + cols[3][p] + WIDTH - 1).tolist(), strict=True)
            return b"".join([texts[d, c][s:e] for d, c, s, e in spans])

        cols = unpack([r[1:] for r in rows if r[0] == SEND])
        to = _bucket(cols[4], n)
        for p in by(to):
            out.append((int(to[p[0]]), SEND, shard, *(x[p].tobytes() for x in cols[:5]), b"", zlib.compress(cut(cols, p), 1)))
        cols = unpack([r[1:] for r in rows if r[0] == SPLIT])
        for at in range(0, len(cols[0]), SLICE):
            p = np.arange(at, min(at + SLICE, len(cols[0])))
            length = cols[3][p].astype(np.int64)
            low, high = string_hashes(cut(cols, p), length)
            own = np.repeat(p, length)
            start = cols[2][own] + (np.arange(len(own)) - np.repeat(starts_of(length), length)).astype(np.uint32)
            to, one = _bucket(low, n), np.ones(len(own), np.uint32)
            for k in by(to):
                out.append((int(to[k[0]]), SPLIT, shard, *(x[k].tobytes() for x in (cols[0][own], cols[1][own], start, one, low, high)), b""))
        if not out:
            return schema.empty_table()
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _stable(codes: np.ndarray) -> np.ndarray:
    """A stable order of codes below 2**32, by two counting passes of 16 bits."""
    p = np.argsort((codes & 0xFFFF).astype(np.uint16), kind="stable")
    if codes.size and codes.max() > 0xFFFF:
        p = p[np.argsort((codes[p] >> 16).astype(np.uint16), kind="stable")]
    return p


class Strings:
    """Strings of bytes, each ended by a mark of its own, in order of their shards."""

    def __init__(self, data: np.ndarray, length: np.ndarray, shard: np.ndarray):
        self.count, self.shard = len(length), shard.astype(np.uint16)
        self.size = (length + 1).astype(np.int32)
        self.first = starts_of(self.size.astype(np.int64)).astype(np.int32)
        self.sid = np.repeat(np.arange(self.count, dtype=np.int32), self.size)
        self.off = np.arange(len(self.sid), dtype=np.int32) - self.first[self.sid]
        alphabet, dense = np.unique(data, return_inverse=True)
        self.symbol = np.zeros(len(self.sid), np.uint16)
        self.symbol[self.left() > 0] = dense + 1
        self.bits = max(1, int(len(alphabet)).bit_length())
        self.q = max(1, min(62 // self.bits, WIDTH))

    def left(self) -> np.ndarray:
        """Symbols from each row to its string's mark; 0 at the mark."""
        return self.size[self.sid] - 1 - self.off

    def keys(self) -> np.ndarray:
        """The next q symbols of each row as one number; zeros from the mark on."""
        left = self.left()

        def joined(a, i, b, j):
            out = a << self.bits * j
            np.bitwise_or(out[: len(b) - i], b[i:], out=out[: len(b) - i], where=left[: len(b) - i] >= i)
            return out

        # what a mark is followed by is its own string's nothing, so its numbers stay zero
        part, k, key, have = self.symbol.astype(np.int64), 1, np.zeros(len(left), np.int64), 0
        while True:
            if self.q & k:
                key, have = joined(key, have, part, k), have + k
            if 2 * k > self.q:
                return key
            part, k = joined(part, k, part, k), 2 * k

    def codes(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Dense codes in the order of keys, where rows that hold a mark are told apart by their string."""
        order = np.argsort(key)
        k = key[order]
        new = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        code = np.empty(len(k), np.int32)
        code[order] = np.repeat(new, np.diff(np.append(new, len(k))))
        ended = np.flatnonzero(self.left() < self.q)
        e = ended[np.lexsort((self.sid[ended], key[ended]))]
        ke = key[e]
        first = np.maximum.accumulate(np.where(np.append(True, ke[1:] != ke[:-1]), np.arange(len(e)), 0))
        code[e] += (np.arange(len(e)) - first).astype(np.int32)
        return code, order.astype(np.int32)

    def suffix_arrays(self, code: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Each shard's rows in order of their suffixes, shard after shard, by prefix doubling within shards."""
        n = len(code)
        shard = self.shard[self.sid]
        # order is by key, codes tell apart the rows that hold a mark
        sa = order[np.argsort(code[order], kind="stable")]
        sa = sa[np.argsort(shard[sa], kind="stable")]
        rank, k = np.empty(n, np.int32), self.q
        new = np.append(True, (code[sa][1:] != code[sa][:-1]) | (shard[sa][1:] != shard[sa][:-1]))
        del shard
        rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
        at = np.flatnonzero(~(new & np.append(new[1:], True))).astype(np.int32)
        while len(at):
            rows = sa[at]
            # a row that ends within k symbols is already alone, so rank[rows + k] is in the same string
            both = rank[rows].astype(np.int64) << 32 | rank[np.minimum(rows.astype(np.int64) + k, n - 1)]
            p = np.argsort(both)
            rows, both = rows[p], both[p]
            sa[at] = rows
            fresh = np.append(True, both[1:] != both[:-1])
            rank[rows] = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
            at = at[~(fresh & np.append(fresh[1:], True))]
            k *= 2
        return sa

    def before(self, rows: np.ndarray, step: int) -> np.ndarray:
        """The rows step symbols earlier, round each string's end."""
        s = self.sid[rows]
        return self.first[s] + (self.off[rows] - step) % self.size[s]


def merge(strings: Strings, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Rows in merged order of their first width symbols, and which of them begin an interval of equal ones."""
    code, order = strings.codes(strings.keys())
    sa = strings.suffix_arrays(code, order)
    del order
    one = np.where(strings.symbol == 0, strings.sid, strings.count + strings.symbol.astype(np.int32))
    transforms = {strings.q: code[strings.before(sa, strings.q)], 1: one[strings.before(sa, 1)]}
    del code, one
    interleave = strings.shard[strings.sid[sa]]
    block, new = np.zeros(len(sa), np.int32), np.ones(len(sa), bool)
    for step in [1] * (width % strings.q) + [strings.q] * (width // strings.q):
        symbol = np.empty(len(sa), np.int32)
        symbol[np.argsort(interleave, kind="stable")] = transforms[step]
        move = _stable(symbol)
        interleave, symbol, block = interleave[move], symbol[move], block[move]
        new[1:] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        block = np.cumsum(new, dtype=np.int32)
    rows = np.empty(len(sa), np.int32)
    rows[np.argsort(interleave, kind="stable")] = sa
    return rows, new


def repeated(data: np.ndarray, doc, crc, start, length, shard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries of length strings each: (entry, first string, number of strings) of the stretches that repeat earlier ones."""
    strings = Strings(data, length.astype(np.int64) + WIDTH - 1, shard)
    order, new = merge(strings)
    by = np.lexsort((crc, doc))
    other = np.append(False, (doc[by][1:] != doc[by][:-1]) | (crc[by][1:] != crc[by][:-1]))
    place = np.empty(len(by), np.int64)
    place[by] = np.cumsum(other)
    sid, off = strings.sid[order], strings.off[order]
    valid = off < length[sid]
    key = place[sid] << 32 | (start[sid].astype(np.int64) + off)
    key[~valid] = LAST
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(key, first)
    again = order[valid & (key != np.repeat(least, np.diff(np.append(first, len(key)))))]
    again.sort()
    sid, off = strings.sid[again], strings.off[again]
    fresh = np.flatnonzero(np.append(True, (sid[1:] != sid[:-1]) | (off[1:] != off[:-1] + 1))[: len(again)])
    return sid[fresh], off[fresh], np.diff(np.append(fresh, len(again)))


class Entries:
    """A bucket of dictionary entries and of hot minimizers' strings: the stretches that repeat earlier ones."""

    def __init__(self, n: int, schema: pa.Schema, most: int, limit: int):
        self.n, self.schema, self.limit = n, schema, limit
        self.packed, self.strings = [], Firsts(n, schema, most)

    def add(self, row):
        if row[1] == SPLIT:
            yield from self.strings.add(unpack([row[3:9]]))
        else:
            self.packed.append(row[2:])

    def end(self):
        yield from self.strings.compact()
        self.strings, rows = None, sorted(self.packed, key=lambda r: r[0])
        if not rows:
            return
        doc, crc, start, length, low = unpack([r[1:7] for r in rows])[:5]
        shard = np.repeat(np.unique([r[0] for r in rows], return_inverse=True)[1], [len(r[1]) // 8 for r in rows])
        data = np.frombuffer(b"".join([zlib.decompress(r[7]) for r in rows]), np.uint8)
        self.packed = rows = None
        size = length.astype(np.int64) + WIDTH - 1
        at, by, found = starts_of(size), np.argsort(low, kind="stable"), []
        # merges of whole minimizer groups, each of about limit bytes
        group = np.flatnonzero(np.append(True, low[by][1:] != low[by][:-1]))
        take = starts_of(np.add.reduceat(size[by], group)) // self.limit
        ends = np.append(group[np.flatnonzero(np.diff(take)) + 1], len(by))
        for a, b in zip(np.append(0, ends[:-1]), ends, strict=True):
            own = np.sort(by[a:b])
            place = np.repeat(at[own] - starts_of(size[own]), size[own]) + np.arange(size[own].sum())
            e, first, count = repeated(data[place], doc[own], crc[own], start[own], length[own], shard[own])
            found.append((own[e], start[own[e]] + first.astype(np.uint32), count.astype(np.uint32)))
        e, first, count = (np.concatenate(x) for x in zip(*found, strict=True))
        yield _covers(self.n, self.schema, doc[e], crc[e], first, count)


def repeats(docs: DataFrame, carry: tuple[str, ...] = (), hot: int = HOT, limit: int = LIMIT, held: int = HELD) -> tuple[DataFrame, DataFrame]:
    """(documents with their bucket `home`, packets of covered stretches by bucket)."""
    spark = docs.sparkSession
    bound_batches(spark)
    n = 3 * parts(docs)
    schema, entry_schema = arrow_schema(spark, PACKET), arrow_schema(spark, ENTRIES)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), *carry)

    def homes(batches):
        for b in batches:
            home = _home(_ids(b.column(0)), told_apart(b.column(0), raw_texts(b.column(1))), n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home.astype(np.int32))], ["doc_id", "text", *carry, "home"])

    more = "".join(f"{c} {whole.schema[c].dataType.simpleString()}, " for c in carry)
    placed = whole.mapInArrow(homes, f"doc_id long, text string, {more}home int")
    runs = texts.mapInArrow(_find_runs(n, schema, FLUSH), PACKET).repartition(min(n, PARTITIONS), "bucket").sortWithinPartitions("bucket")
    found = written(_by_bucket(runs, lambda: Runs(n, schema, held, hot), PACKET), "runs")
    sends = found.where(f"kind IN ({SEND}, {SPLIT})").withColumnRenamed("bucket", "home")
    entries = placed.groupBy("home").cogroup(sends.groupBy("home")).applyInArrow(_entries(n, entry_schema), ENTRIES)
    covers = _by_bucket(entries.repartition(min(n, PARTITIONS), "bucket").sortWithinPartitions("bucket"), lambda: Entries(n, schema, held, limit), PACKET)
    return placed, found.where(f"kind = {COVER}").unionByName(covers).withColumnRenamed("bucket", "home")


def remove_repeats(docs: DataFrame, keep_text: bool = True, carry: tuple[str, ...] = (), **sizes: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with keep_text also kept, the remaining text.

    In kept, characters that a removal has cut in two are left out whole. carry: more columns of docs.
    sizes: hot, limit and held of repeats(), which don't change results.
    """
    placed, covers = repeats(docs, carry, **sizes)
    more = [*(["kept string"] if keep_text else []), *(f"{c} {docs.schema[c].dataType.simpleString()}" for c in carry)]
    ddl = ", ".join(["doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", *more])
    schema = arrow_schema(docs.sparkSession, ddl)

    def run(texts: pa.Table, packed: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return schema.empty_table()
        doc, crc, start, length, *_ = unpack(list(zip(*(packed[c].to_pylist() for c in ("doc", "crc", "start", "length", "low", "high")), strict=True)))
        order = np.lexsort((crc, doc))
        d, c = doc[order], crc[order]
        cut = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (c[1:] != c[:-1]))[: len(order)])
        spans = dict(zip(zip(d[cut].tolist(), c[cut].tolist(), strict=True), np.split(order, cut[1:]), strict=False))
        ids, whole = texts["doc_id"].combine_chunks(), raw_texts(texts["text"].combine_chunks())
        out = []
        for i, k, own, t in zip(ids.to_pylist(), _ids(ids).tolist(), told_apart(ids, whole).tolist(), whole, strict=True):
            p = spans.get((k, own))
            kept, n_spans = t, 0
            if p is not None:
                edge = np.zeros(len(t) + 1, np.int64)
                np.add.at(edge, start[p], 1)
                np.add.at(edge, start[p].astype(np.int64) + length[p], -1)
                gone = np.cumsum(edge[:-1]) > 0
                n_spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
            out.append((i, len(t), len(t) - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), *((kept.decode("utf-8", "ignore"),) if keep_text else ())))
        own = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=False)]
        return pa.Table.from_arrays([*own, *(texts[c] for c in carry)], schema=schema)

    return placed.groupBy("home").cogroup(covers.groupBy("home")).applyInArrow(run, ddl)


ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM d)),
r AS (SELECT unnest(list_sort(list(doc_id * 4294967296 + p))[2:]) AS q FROM s GROUP BY k HAVING count(*) > 1),
m AS (SELECT q // 4294967296 AS doc_id, q % 4294967296 AS p FROM r),
f AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh FROM m),
i AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS k FROM f),
c AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS e FROM i GROUP BY doc_id, k),
g AS (SELECT doc_id, a, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM c),
t AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, max(e) AS last, sum(e - a) AS removed, count(*) AS spans FROM g JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False)

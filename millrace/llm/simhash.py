"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints: each word shingle's XXH64 votes for 64 bits. Links: equal texts meet in one fingerprint; different fingerprints within the radius
agree in enough of their blocks to share a key (multi-index), and the fingerprints of one key are
compared bit-sliced: block columns of 64 fingerprints stand as bit planes, one word for each of the
64 bit places, a query's distances to all of them grow in carry-save counters word by word, and a
column is left as soon as all of its distances exceed the radius.

Skew: two fingerprints of a key with more than TILE of them, which agree in two blocks, differ in RADIUS bits
of the other bits at most, so they also agree in one of RADIUS + 1 pieces of those: such a key is dealt
out anew by each piece. A key that stays larger is cut into tiles by hash, and each pair of tiles is a
task's work of its own; nothing is dropped. A tile pair reports a spanning forest of its links, by rounds
over whole arrays.
Rows get their component by a join that broadcasts the few fingerprints of many rows.

With a similarity (one_of_each), linked texts also have that Jaccard similarity of shingle sets. The
radius this takes is too wide for bit blocks to prune (at 18, 190 tables of 6 bits), so the keys are a
set's SAMPLE least shingle hashes: two sets of similarity s share none of them with probability
(1 - s) ** SAMPLE. Sets of a key within the radius, and of sizes that allow the similarity, are compared
bit-sliced. Of n unlike sets of a key some n * n / 5000 pairs are that near by chance, which would join
most of a large key's sets in one component; so candidates also agree in a sketch: the least hash of each of 64
ranges, of which the share that agree is the similarity, give or take 0.05, and may fall short of it by SLACK.
The sets of a candidate component are then compared exactly, from pivots: as
Jaccard's distance is a metric, sets near a pivot have no link to sets over twice as far from it. Their texts
alone are shuffled, by a bitmap of those that are needed.

Defined results: null and empty texts have fingerprint zero and link like any other; fewer words than
a shingle: the whole sequence is the shingle; repeated rows: repeated results, null ids: never the
least unless all are null; empty table: no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, join_skewed, marked, marks, parts, raw_texts, written
from .components import components

SEED, RADIUS, TILE, ROWS = 42, 2, 1024, 1 << 16
SHINGLES = 1 << 21  # of a tile of sets, whose hashes take 16 MB; a longer text stands alone
SAMPLE = 8
SLACK = 0.3  # six standard deviations of a sketch at 0.8
FEW, WIDE = 8, 16  # tiles of a key of sets: of TILE up to FEW of them, then larger, of up to WIDE * TILE
SKETCH = ("s0", "s1", "s2", "s3")  # 16 ranges each, four bits a range
EDGES = np.arange(64, dtype=np.uint64) << np.uint64(58)
BITS = np.arange(64, dtype=np.uint64)
ONE = np.uint64(1)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of the word shingles of a text, repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([h(flat, SEED)], np.uint64)
    ends = []
    at = -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-1]]]
    return np.array([h(flat[s:e], SEED) for s, e in zip(starts, ends[width - 1 :], strict=False)], np.uint64)


def majority(hashes: np.ndarray, block: int = 1 << 16) -> int:
    """The bits set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), block):
        bits = np.unpackbits(hashes[at : at + block].view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(0, dtype=np.uint32)
    return int(((counts * 2 > len(hashes)).astype(np.uint64) << BITS).sum())


def _least() -> Column:
    """The row that stands for a group: of the least id, null ids last, then of the least text_key."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("least")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, text_key (a hash of the text), fp (the fingerprint as a signed long) for each row."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id"), F.col("text"), F.xxhash64("text").alias("text_key"))

    def run(batches):
        for b in batches:
            fp = np.array([majority(shingle_hashes(t, width)) for t in raw_texts(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp.view(np.int64))], ["doc_id", "text_key", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_key long, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes (64 x columns): bit j of word c of plane i is bit i of fingerprint 64c + j."""
    columns = -(-len(fps) // 64)
    padded = np.zeros(columns * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.reshape(columns, 64, 64).transpose(2, 0, 1), axis=2, bitorder="little")).view(np.uint64)[:, :, 0]


def within(fps: np.ndarray, low: np.ndarray, high: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Some at a time, (i, j) of all j in low[i]..high[i]-1 with fps[i] and fps[j] within radius of each other.

    Work goes on for (i, column) pairs, a column being 64 consecutive fingerprints; those whose
    distances all exceed the radius are left.
    """
    sliced, width = planes(fps), max(1, radius.bit_length())
    first, last = low >> 6, (high + 63) >> 6
    count = np.where(high > low, last - first, 0)
    for rows in np.split(np.arange(len(fps)), np.flatnonzero(np.diff(np.cumsum(count) >> 16)) + 1):
        n = count[rows]
        q = np.repeat(rows, n)
        if not len(q):
            continue
        c = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) + first[q]
        # places of the column outside low..high-1 count as beyond the radius
        over = _below(low[q] - 64 * c) | ~_below(high[q] - 64 * c)
        counter = [np.zeros(len(q), np.uint64) for _ in range(width)]
        for bit in range(64):
            carry = sliced[bit][c] ^ (np.uint64(0) - ((fps[q] >> np.uint64(bit)) & ONE))
            for i in range(width):
                counter[i], carry = counter[i] ^ carry, counter[i] & carry
            over |= carry | _beyond(counter, radius)
            if bit % 4 == 3:
                keep = over != ~np.uint64(0)
                if not keep.all():
                    q, c, over = q[keep], c[keep], over[keep]
                    counter = [x[keep] for x in counter]
                if not len(q):
                    break
        for at in range(0, len(q), 1 << 14):
            pair, place = np.nonzero((~over[at : at + (1 << 14), None] >> BITS) & ONE)
            yield q[at + pair], c[at + pair] * 64 + place


def _below(k: np.ndarray) -> np.ndarray:
    """A word for each k with its first k places set, k held to 0..64."""
    k = np.clip(k, 0, 64).astype(np.uint64)
    return np.where(k == 64, ~np.uint64(0), (ONE << (k & np.uint64(63))) - ONE)


def _beyond(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Places whose counter exceeds the radius: a bitwise comparison with a constant."""
    above, equal = np.uint64(0), ~np.uint64(0)
    for i in reversed(range(len(counter))):
        if radius >> i & 1:
            equal = equal & counter[i]
        else:
            above, equal = above | equal & counter[i], equal & ~counter[i]
    return np.zeros_like(counter[0]) | above


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Four bits of the least hash in each of 64 ranges, from 1 on, and 0 for a range without any; hashes are sorted."""
    at = np.searchsorted(hashes, EDGES)
    some = np.diff(np.append(at, len(hashes))) > 0
    least = np.zeros(64, np.uint64)
    least[some] = hashes[at[some]] % np.uint64(15) + ONE
    return np.bitwise_or.reduce(least.reshape(4, 16) << np.arange(0, 64, 4, dtype=np.uint64), axis=1)


def agree(a: list[np.ndarray], b: list[np.ndarray], least: float) -> np.ndarray:
    """Whether sketches agree in this share, at least, of the ranges that one of the two has something in."""

    def filled(x):
        x = x | x >> ONE
        return np.bitwise_count((x | x >> np.uint64(2)) & np.uint64(0x1111111111111111)).astype(np.int64)

    both = sum(filled(x | y) for x, y in zip(a, b, strict=True))
    return both - sum(filled(x ^ y) for x, y in zip(a, b, strict=True)) >= least * both


def forest(fps: np.ndarray, low: np.ndarray, high: np.ndarray, radius: int, sizes: np.ndarray | None = None, similarity: float = 0, sketches: list[np.ndarray] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that span the components which within() finds, of pairs whose sizes and sketches allow the similarity."""

    def pairs():
        for at, to in within(fps, low, high, radius):
            if sizes is not None:
                fit = np.minimum(sizes[at], sizes[to]) >= similarity * np.maximum(sizes[at], sizes[to])
                at, to = at[fit], to[fit]
            if sketches:
                fit = agree([x[at] for x in sketches], [x[to] for x in sketches], similarity - SLACK)
                at, to = at[fit], to[fit]
            yield at, to

    return spanned(len(fps), pairs())


def spanned(n: int, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Of n nodes with these links, each node that isn't the least of its component, and that least node."""
    root = np.arange(n)
    for at, to in pairs:
        while True:
            a, b = root[at], root[to]
            apart = a != b
            if not apart.any():
                break
            at, to, a, b = at[apart], to[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := root[root], root):
                root = up
    hung = np.flatnonzero(root != np.arange(n))
    return hung, root[hung]


def block_masks(radius: int) -> list[int]:
    """Masks over radius + 2 blocks of the 64 bits: those of any two blocks left equal by radius changes."""
    n = radius + 2
    edge = [64 * i // n for i in range(n + 1)]
    block = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(n)]
    return [block[i] | block[j] for i, j in combinations(range(n), 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) fingerprints that span the link graph of the distinct fps (column fp)."""
    masks = block_masks(radius)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("t", "key"))
    hot = written(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > TILE).select("t", "key"), "hot")
    if not hot.isEmpty():
        # the bits outside the key's blocks, in radius + 1 pieces of which one at least agrees
        pieces = [[_signed(m | p) for p in _pieces_of(~m & (1 << 64) - 1, radius + 1)] for m in masks]
        again = F.posexplode(F.element_at(F.array(*[F.array(*map(F.lit, x)) for x in pieces]), F.col("t") + 1)).alias("piece", "mask")
        split = keyed.join(hot, ["t", "key"], "left_semi").select("fp", "t", again)
        split = split.select("fp", (F.lit(len(masks)) + F.col("t") * (radius + 1) + F.col("piece")).alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        keyed = keyed.join(hot, ["t", "key"], "left_anti").select("fp", "t", "key").unionByName(split)
    return _compared(keyed, parts(fps), radius, ROWS)


def _pieces_of(mask: int, n: int) -> list[int]:
    """The bits of a mask in n pieces of nearly equal size."""
    bits = [i for i in range(64) if mask >> i & 1]
    return [sum(1 << i for i in bits[len(bits) * k // n : len(bits) * (k + 1) // n]) for k in range(n)]


def set_links(sets: DataFrame, radius: int, similarity: float) -> DataFrame:
    """(a, b) sets (node, fp, size, sample, sketch) that span the candidates for the similarity."""
    parted = [F.element_at("sketch", i + 1).alias(c) for i, c in enumerate(SKETCH)]
    keyed = sets.select("fp", F.lit(0).alias("t"), F.explode("sample").alias("key"), "node", "size", *parted)
    return _compared(keyed, parts(sets), radius, ROWS >> 4, ("node", "size", *SKETCH), similarity)


def _compared(keyed: DataFrame, n: int, radius: int, most: int, extra: tuple = (), similarity: float = 0) -> DataFrame:
    """(a, b) links of the rows (t, key, fp) that share a key; with node, size and sketch, between nodes."""
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    if extra:  # a row is repeated for each tile of its key
        tiles = F.least(tiles, F.greatest(F.lit(FEW), F.ceil(F.col("n") / (WIDE * TILE)).cast("int")))
    # inner join: keys of one fingerprint have nothing to compare
    dealt = keyed.join(sizes, ["t", "key"]).select("t", "key", "fp", tiles.alias("k"), F.pmod(F.xxhash64(extra[0] if extra else "fp"), tiles).cast("int").alias("own"), *extra)
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    pairs = pairs.select("t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp", *extra)
    order = ["t", "key", "i", "j", "own"]
    placed = pairs.repartition(n, *order[:4]).sortWithinPartitions(*order)

    def compare(batches):
        held, rows = [], 0
        for b in batches:
            if b.num_rows:
                held.append([np.asarray(c) for c in b.columns])
                rows += b.num_rows
            if rows >= most:
                cols = [np.concatenate(x) for x in zip(*held, strict=True)]
                ends = _borders(cols)
                if len(ends):  # the last group may go on in the next batch
                    yield _spanning([c[: ends[-1]] for c in cols], radius, similarity)
                    cols = [c[ends[-1] :] for c in cols]
                held, rows = [cols], len(cols[0])
        if rows:
            yield _spanning([np.concatenate(x) for x in zip(*held, strict=True)], radius, similarity)

    return placed.mapInArrow(compare, "a long, b long")


def _borders(cols: list[np.ndarray]) -> np.ndarray:
    """Where a new group (t, key, i, j) begins, but for the first."""
    return np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)) + 1


def _spanning(cols: list[np.ndarray], radius: int, similarity: float = 0) -> pa.RecordBatch:
    """Spanning links of whole groups of rows (t, key, i, j, own, fp and perhaps node, size, sketch) that are sorted."""
    _, _, i, j, own, fp, *more = cols
    size = len(fp)
    start = np.concatenate([[0], _borders(cols)])
    end = np.repeat(np.append(start[1:], size), np.diff(np.append(start, size)))
    here = np.arange(size)
    # within one tile each row meets those after it; of two tiles the first tile's rows meet the second's
    turn = np.add.reduceat((own == i).astype(np.int64), start)
    second = np.repeat(start + turn, np.diff(np.append(start, size)))
    low = np.where(i == j, here + 1, second)
    high = np.where((i == j) | (own == i), end, 0)
    fps = fp.view(np.uint64)
    at, to = forest(fps, low, high, radius, more[1] if more else None, similarity, [x.view(np.uint64) for x in more[2:]])
    node = more[0] if more else fp
    return pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[to])], ["a", "b"])


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_key, node (a hash of the text's set of shingles), fp (where each shingle votes once), size, sample, sketch."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id"), F.col("text"), F.xxhash64("text").alias("text_key"))

    def run(batches):
        for b in batches:
            sets = [np.unique(shingle_hashes(t, width)) for t in raw_texts(b.column(1))]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64)
            fp = np.array([majority(s) for s in sets], np.uint64)
            size = pa.array([len(s) for s in sets], pa.int32())
            sample = pa.array([s[:SAMPLE].view(np.int64) for s in sets], pa.list_(pa.int64()))
            drawn = pa.array([sketch(s).view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(node.view(np.int64)), pa.array(fp.view(np.int64)), size, sample, drawn], ["doc_id", "text_key", "node", "fp", "size", "sample", "sketch"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_key long, node long, fp long, size int, sample array<long>, sketch array<long>")


def exact(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (i, j) that span the components of the pairs of sets whose Jaccard similarity suffices.

    A pivot is compared with all sets left. Those near it link to it and need no comparison with each other,
    nor with sets of a similarity to the pivot under 2 * similarity - 1, which are over twice as far; those
    in between are compared with the near ones until each has a link or none. Then the pivot and the near
    ones are done with.
    """
    count = np.array([len(s) for s in sets])
    start = np.append(0, np.cumsum(count))
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    held = np.repeat(np.arange(len(sets)), count)[np.argsort(token, kind="stable")]
    first = np.append(0, np.cumsum(np.bincount(token)))

    def alike(x):
        t = token[start[x] : start[x + 1]]
        n = first[t + 1] - first[t]
        both = np.bincount(held[np.repeat(first[t] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sets))
        return both / np.maximum(count[x] + count - both, 1)

    left, links = np.ones(len(sets), bool), []
    for pivot in range(len(sets)):
        if not left[pivot]:
            continue
        left[pivot] = False
        s = alike(pivot)
        near = np.flatnonzero(left & (s >= similarity))
        ring = np.flatnonzero(left & (s < similarity) & (s >= 2 * similarity - 1 - 1e-9))
        links += [(pivot, y) for y in near.tolist()]
        left[near] = False
        if len(ring) <= len(near):
            for z in ring.tolist():
                found = near[alike(z)[near] >= similarity]
                links += [(int(found[0]), z)] if len(found) else []
        else:
            for y in near.tolist():
                if not len(ring):
                    break
                linked = alike(y)[ring] >= similarity
                links += [(y, z) for z in ring[linked].tolist()]
                ring = ring[~linked]
    return links


def similar_links(docs: DataFrame, members: DataFrame, width: int, similarity: float) -> DataFrame:
    """(a, b) sets that span the similar pairs of each candidate component.

    members: node, size, root and the row (id, key) that a set's text is taken from. A component of more than
    TILE sets, or SHINGLES shingles, is cut into tiles, and each pair of tiles is a task's work of its own.
    """
    tiles = F.ceil(F.greatest(F.col("n") / TILE, F.col("all") / SHINGLES)).cast("int")
    sized = members.join(members.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("all")), "root")
    sized = sized.select("root", "node", "id", "key", tiles.alias("k"), F.pmod(F.xxhash64("node"), tiles).cast("int").alias("own"))
    needed = marks(members, F.xxhash64("id", "key"))
    found = marked(docs.select(F.col("doc_id"), F.col("text"), F.xxhash64("text").alias("text_key")), F.xxhash64("doc_id", "text_key"), needed)
    found = found.join(sized, found["doc_id"].eqNullSafe(sized["id"]) & (found["text_key"] == sized["key"])).select("root", "node", "k", "own", "text").dropDuplicates(["node"])
    pairs = found.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    order = ["root", "i", "j"]
    placed = pairs.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "text")
    placed = placed.repartition(parts(docs), *order).sortWithinPartitions(*order, "own")

    def links_of(key, rows):
        # a pair of tiles of which one is empty has no more links than the other tile alone
        if len(rows) < 2 or key[1] != key[2] and len({own for own, _, _ in rows}) < 2:
            return []
        return [(rows[x][1], rows[y][1]) for x, y in exact([s for _, _, s in rows], similarity)]

    def run(batches):
        key, held = None, []
        for b in batches:
            out, texts = [], raw_texts(b.column(5))
            for *k, own, node, text in zip(*(c.to_pylist() for c in b.columns[:5]), texts, strict=True):
                if k != key:
                    out += links_of(key, held) if held else []
                    key, held = k, []
                held.append((own, node, np.unique(shingle_hashes(text, width))))
            yield _pairs(out)
        yield _pairs(links_of(key, held) if held else [])

    return placed.mapInArrow(run, "a long, b long")


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])


def near_copies(docs: DataFrame, width: int, radius: int, similarity: float) -> DataFrame:
    """doc_id, component_id (least doc_id reachable over texts of the similarity), text_key, head_key (of the least row)."""
    rows = written(shingle_sets(docs, width), "shingles")
    sets = rows.groupBy("node").agg(*[F.min(c).alias(c) for c in ("fp", "size", "sample", "sketch")], _least(), F.count("*").alias("n"))
    sets = written(sets, "sets")
    near = components(set_links(sets, radius, similarity), "a", "b").withColumnRenamed("node", "f")
    members = written(sets.join(near, F.col("node") == F.col("f")).select("node", "size", "root", F.col("least.doc_id").alias("id"), F.col("least.text_key").alias("key")), "members")
    roots = components(written(similar_links(docs, members, width, similarity), "similar"), "a", "b")
    named = _named(sets.select(F.col("node").alias("f"), "least", "n"), roots)
    return join_skewed(rows, named, F.col("node") == F.col("f"), "n", rows.count()).select("doc_id", "component_id", "text_key", "head_key")


def _named(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """f, n, component_id, head_key of classes (f, least, n): the least row of all that share a root (node, root)."""
    linked = classes.join(roots, F.col("f") == F.col("node")).select("f", "root", "least")
    heads = linked.groupBy("root").agg(F.min("least").alias("head"))
    found = written(linked.join(heads, "root").select(F.col("f").alias("linked"), "head"), "heads")
    row = classes.join(found, F.col("f") == F.col("linked"), "left").select("f", "n", F.coalesce("head", "least").alias("row"))
    return row.select("f", "n", F.col("row.doc_id").alias("component_id"), F.col("row.text_key").alias("head_key"))


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (least doc_id reachable), text_key."""
    return _near(docs, width, radius).drop("head_key")


def _near(docs: DataFrame, width: int, radius: int) -> DataFrame:
    """near_duplicates() with head_key, the text_key of the component's least row."""
    fp = written(fingerprints(docs, width), "fingerprints")
    classes = written(fp.groupBy("fp").agg(_least(), F.count("*").alias("n")).withColumnRenamed("fp", "f"), "classes")
    roots = components(links(classes.select(F.col("f").alias("fp")), radius), "a", "b")
    named = _named(classes, roots)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return join_skewed(fp, named, F.col("fp") == F.col("f"), "n", fp.count()).select("doc_id", digits.alias("fingerprint"), "component_id", "text_key", "head_key")


def one_of_each(docs: DataFrame, width: int = 3, radius: int = RADIUS, similarity: float = 0) -> DataFrame:
    """One row of each component, that of the least doc_id; columns unchanged.

    A null id goes where its component has another. Of rows that share the least id the one of the least
    text_key stays, and of those equal in both the least by all columns, which must be orderable then. Of
    rows that share an id only, each is judged by its own text. With a similarity, linked texts have that
    Jaccard similarity too.
    """
    found = near_copies(docs, width, radius, similarity) if similarity else _near(docs, width, radius)
    head = F.expr("doc_id <=> component_id AND text_key = head_key")
    seen = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), head.alias("head")).agg(F.count("*").alias("n"))
    seen = written(seen.where("NOT head OR n > 1"), "seen")
    same = docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_key"))
    again = seen.where("head")
    # the others stay where they are, so few texts are shuffled
    bits, h = marks(seen, F.xxhash64("_id", "_key")), F.xxhash64("doc_id", F.xxhash64("text"))
    some = marked(docs, h, bits)
    left = marked(docs, h, bits, "left_anti").unionByName(some.join(seen, same, "left_anti"))
    if again.isEmpty():
        return left
    one = some.join(again, same, "left_semi").groupBy("doc_id", F.xxhash64("text")).agg(F.min(F.struct(*docs.columns)).alias("row"))
    return left.unionByName(one.select("row.*"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Joins of texts: within an edit distance by segments, and of texts with the phrases that they hold by automata."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

PLACES, MORE = 64, 5  # characters up to which a length's segments follow how much its places tell; segments beyond k at most
TEXTS, MOST_PARTS = 2000, 8192  # texts a partition; partitions


def segments_by_information(bits: list[float], k: int) -> list[int]:
    """Ends of k + 1 segments of a text of len(bits) characters, the least telling of which tells as much as can be."""
    n = len(bits)
    total = [0.0]
    for b in bits:
        total.append(total[-1] + b)
    # best[j][i]: the most that the least telling of j segments of the first i characters can tell, of equal ones the longer text in it
    best = [{0: ((math.inf, 0), [])}]
    for j in range(1, k + 2):
        row = {}
        for i in range(j, n - (k + 1 - j) + 1):
            options = ((min(best[j - 1][s][0], (total[i] - total[s], i - s)), [*best[j - 1][s][1], i]) for s in best[j - 1] if s < i)
            row[i] = max(options, key=lambda x: x[0])
        best.append(row)
    return best[k + 1][n][1]


def _segments(bits: list[float], n: int, k: int) -> list[int]:
    """Ends of the k + 1 or more segments by which n texts of a length, whose places tell so many bits, meet the fewest others."""
    length, best = len(bits), (math.inf, [])
    for m in range(k + 1, min(length, k + MORE) + 1):
        ends = segments_by_information(bits, m - 1)
        told = [sum(bits[s:e]) for s, e in zip([0, *ends], ends, strict=False)]
        cost = sum(4 + 3 * n * 2.0 ** (sum(t for i, t in enumerate(told) if i in bad) - sum(told)) for bad in combinations(range(m), k))
        best = min(best, (cost, ends))
    return best[1]


def _ends(texts: list[DataFrame], k: int) -> dict[int, list[int]]:
    """Ends of the segments of each length up to PLACES, by the entropy of the characters at each place over all texts."""
    both = texts[0].select(F.col(texts[0].columns[0]).alias("t"))
    for t in texts[1:]:
        both = both.unionAll(t.select(F.col(t.columns[0]).alias("t")))
    each = both.where(F.length("t").between(k + 1, PLACES)).select(F.length("t").alias("l"), F.posexplode(F.split("t", "")).alias("p", "c"))
    count = each.groupBy("l", "p", "c").agg(F.count("*").alias("n"))
    sums = count.groupBy("l", "p").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    found: dict[int, dict[int, float]] = {}
    size: dict[int, int] = {}
    for r in sums.collect():  # PLACES * PLACES rows at most
        found.setdefault(r.l, {})[r.p] = math.log2(r.n) - r.s / r.n
        size[r.l] = max(size.get(r.l, 0), r.n)
    return {l: _segments([round(p.get(i, 0.0), 6) for i in range(l)], size[l], k) for l, p in found.items()}


def _cuts(length: int, k: int, ends: dict[int, list[int]]) -> list[tuple[int, int]]:
    """(start, end) of the segments of texts of this length: even ones beyond PLACES; none where no text has this length."""
    own = ends.get(length, []) if length <= PLACES else [length * (i + 1) // (k + 2) for i in range(k + 2)]
    return list(zip([0, *own], own, strict=False))


def _keys(text: str, length: int, k: int, ends: dict[int, list[int]]) -> set[str]:
    """Keys of a text for those of this length: for any k segments of theirs, what stands in the others, if all edits are in these k.

    A text of the length itself, with no shift, has just the key of its own segments.
    """
    cuts, off, out = _cuts(length, k, ends), len(text) - length, set()
    for shifts in product(range(-k, k + 1), repeat=k):
        if sum(shifts) != off or sum(map(abs, shifts)) > k:
            continue
        for c, bad in enumerate(combinations(range(len(cuts)), k)):
            at, parts, left = 0, [], list(zip(bad, shifts, strict=True))
            for i, (s, e) in enumerate(cuts):
                if left and left[0][0] == i:
                    at += left.pop(0)[1]
                elif s + at < 0 or e + at > len(text):
                    break
                else:
                    parts.append(text[s + at : e + at])
            else:
                out.add(f"{length} {c} {''.join(parts)}")
    return out


def _own_keys(text: str, k: int, ends: dict[int, list[int]]) -> set[str]:
    cuts = _cuts(len(text), k, ends)
    return {f"{len(text)} {c} {''.join(text[s:e] for i, (s, e) in enumerate(cuts) if i not in bad)}" for c, bad in enumerate(combinations(range(len(cuts)), k))}


def _keyed(df: DataFrame, keys: Callable[[str], set[str]]) -> DataFrame:
    """(text, key) of a table of one column, keys by 64 bits: those that are equal by chance only add candidates."""
    (name,) = df.columns

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.column(0).slice(at, 1024)
                found = [list(keys(t)) for t in part.to_pylist()]
                rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([part.take(pa.array(rows)), pa.array([x for f in found for x in f], pa.string())], [name, "key"])

    return df.mapInArrow(run, f"{name} string, key string").select(name, F.xxhash64("key").alias("key"))


def _without(text: Column, k: int) -> Column:
    """All texts that are left when up to k characters are deleted."""
    out = F.array(text)
    for _ in range(k):
        fewer = lambda s: F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))).otherwise(F.array().cast("array<string>"))
        out = F.array_distinct(F.array_union(out, F.flatten(F.transform(out, fewer))))
    return out


def edit_candidates(left: DataFrame, right: DataFrame, k: int, own: bool = False) -> DataFrame:
    """(a, b, at): pairs of texts that share all segments but k, among them all within k edits; pairs may come more than once.

    left and right have one column of different, non-null texts. own: both are one table, and a pair is wanted once, the
    shorter text, or the lesser of two of one length, as a.
    """
    (a,), (b,) = left.columns, right.columns
    l, r = left.select(F.col(a).alias("a")), right.select(F.col(b).alias("b"))
    ship(l.sparkSession)
    ends, most = _ends([l] if own else [l, r], k), 0 if own else k
    # by texts, not by bytes: few keys may have very many candidates
    n = min(MOST_PARTS, 1 + (l.count() if own else l.count() + r.count()) // TEXTS)

    def probes(text: str) -> set[str]:
        return set().union(*(_keys(text, length, k, ends) for length in range(max(k + 1, len(text) - k), len(text) + most + 1)))

    index = _keyed(l.where(F.length("a") > k).repartition(n), lambda t: _own_keys(t, k, ends)).repartition(n, "key")
    probe = _keyed(r.where(F.length("b") + most > k).repartition(n), probes).repartition(n, "key")
    met = index.hint("merge").join(probe, "key").select("a", "b")
    # texts of up to k characters have no such segments; what they are near to has 2 * k at most
    few = [t.where(F.length(c) <= 2 * k).select(c, F.explode(_without(F.col(c), k)).alias("key")) for t, c in ((l, "a"), (r, "b"))]
    met = met.unionAll(few[0].join(few[1], "key").where((F.length("a") <= k) | (F.length("b") <= k)).select("a", "b"))
    if own:
        met = met.where((F.length("a") < F.length("b")) | (F.length("a") == F.length("b")) & (F.col("a") < F.col("b")))
    return met


def edit_join(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """a, b, distance: pairs of the different texts of two one-column tables within k edits.

    Of the m segments of a text all but k stand unchanged, near their places, in every text within k edits: an equi join on (length,
    segments, characters) gives the candidates, and the distance itself, given up beyond k, decides. Segments of a length are cut
    where the places tell the same amount, so that a beginning that all texts share is no key of its own, and are as many as leave the fewest
    candidates, so that dense texts, such as numbered names, meet few that are not near; beyond PLACES characters they are k + 2 even ones. Work follows the candidates, whose keys Spark splits where they are skewed.

    Null texts match nothing; repeated ones count once; the empty text is k edits from all of k characters; an empty table gives no rows. Characters
    are code points.
    """
    l, r = (t.select(F.col(t.columns[0]).alias(c)).where(F.col(c).isNotNull()).distinct() for t, c in ((left, "a"), (right, "b")))
    return _within(edit_candidates(l, r, k), k)


def similar_texts(df: DataFrame, text: str, k: int) -> DataFrame:
    """a, b, distance: unordered pairs of different texts of a column within k edits, as in edit_join."""
    t = df.select(F.col(text).alias("t")).where(F.col("t").isNotNull()).distinct()
    return _within(edit_candidates(t, t, k, own=True), k)


def _within(pairs: DataFrame, k: int) -> DataFrame:
    d = F.levenshtein("a", "b", k)
    return pairs.select("a", "b", d.alias("distance")).where(F.col("distance") >= 0).distinct()


MOST_BYTES = 1 << 20  # phrases of one automaton, which takes up to some 100 bytes of memory for each

_automata: dict = {}


def automaton(name: str, phrases: list[str]):
    """The automaton of a block of phrases, made once in each worker; the last two are kept."""
    import ahocorasick

    if name not in _automata:
        while len(_automata) > 1:
            _automata.pop(next(iter(_automata)))
        made = ahocorasick.Automaton()
        for i, p in enumerate(phrases):
            made.add_word(p, i)
        made.make_automaton()
        _automata[name] = made
    return _automata[name]


def _blocks(phrases: DataFrame, key: str, text: str, most: int) -> Iterator[tuple[list[str], list[list]]]:
    """(different phrases, the keys of each), in blocks of about most bytes; one phrase is in one block."""
    rows = phrases.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t IS NOT NULL")
    n = -(-(rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // most) or 1
    for i in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("t"), F.lit(n)) == i)
        found: dict[str, list] = {}
        for r in part.toLocalIterator():
            found.setdefault(r.t, []).append(r.k)
        yield list(found), list(found.values())


def texts_with_phrases(docs: DataFrame, key: str, text: str, phrases: DataFrame, phrase_key: str, phrase: str, most: int = MOST_BYTES) -> DataFrame:
    """(key, phrase_key) of each row of docs and each row of phrases that its text holds, anywhere and letter by letter.

    One pass over the texts, in Arrow batches, by an automaton of all phrases (Aho-Corasick), so that a text costs its length and what it holds,
    however many phrases there are; nothing is shuffled. Phrases are broadcast after a check of their size: beyond `most` bytes they
    take a pass for each block of so many.

    Null texts and phrases match nothing; the empty phrase is in every text; repeated rows of either table each count; texts of any length are read whole;
    an empty table gives no rows.
    """
    spark, out = docs.sparkSession, None
    ship(spark)
    kinds = docs.schema[key].dataType.simpleString(), phrases.schema[phrase_key].dataType.simpleString()
    rows = docs.select(F.col(key), F.col(text)).where(F.col(text).isNotNull())
    for words, keys in _blocks(phrases, phrase_key, phrase, most):
        held, name = spark.sparkContext.broadcast((words, keys)), uuid.uuid4().hex

        def run(batches, held=held, name=name):
            words, keys = held.value
            empty = [i for i, w in enumerate(words) if not w]
            found = automaton(name, [w for w in words if w]) if len(words) > len(empty) else None
            own = [k for w, k in zip(words, keys, strict=True) if w]
            for b in batches:
                left, right = [], []
                for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    hits = {p for _, p in found.iter(t.as_py())} if found else ()
                    for ks in (*(own[p] for p in sorted(hits)), *(keys[p] for p in empty)):
                        left += [i] * len(ks)
                        right += ks
                yield pa.RecordBatch.from_arrays([pa.array(left, b.schema.field(0).type), pa.array(right) if right else pa.nulls(0)], [key, phrase_key])

        part = rows.mapInArrow(run, f"{key} {kinds[0]}, {phrase_key} {kinds[1]}")
        out = part if out is None else out.unionByName(part)
    return out

"""URL filters by a Bloom filter cascade.

Level 1 encodes the listed keys. Level 2 encodes those keys of the corpus's complete key universe
that level 1 lets through though unlisted, level 3 the listed ones that level 2 lets through, and so
on until a level has no false positive. Membership is then exact for every key of the universe,
and each page is judged by a few bit tests, without a join.

A key is a host suffix at a label border with a path prefix, such as `example.org/es/`. Only
suffixes and prefixes as long as some listed key's are formed.

Bounds: level 1 takes a false-positive rate of listed/universe, so the later levels hold about as
many keys as are listed and the broadcast filters grow with the list and the logarithm of the
universe. The list itself is a parameter on the driver.

Defined results: null url or no `://`: host and path are empty; no candidate key: no rule, and the
verdict is the default; equal urls: equal verdicts; empty table: no rows; columns of the input beside
page_id and url are ignored; a key both allowed and blocked is blocked.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bound_batches, written

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def split_url(url):
    """(host, path) columns of a url column."""
    part = lambda i: F.coalesce(F.regexp_extract(url, URL, i), F.lit(""))
    return ascii_lower(part(1)), part(2)


@dataclass
class Bloom:
    """A Bloom filter with k probes from one 128-bit hash; seed tells the levels apart."""

    n: int
    rate: float
    seed: int
    bits: np.ndarray = field(init=False)

    def __post_init__(self):
        rate = min(max(self.rate, 1e-12), 0.5)
        self.m = max(64, math.ceil(max(self.n, 1) * -math.log(rate) / math.log(2) ** 2))
        self.k = max(1, round(-math.log2(rate)))
        self.bits = np.zeros((self.m + 7) // 8, np.uint8)

    def probes(self, key: str) -> list[int]:
        h = xxhash.xxh3_128_intdigest(key.encode(), self.seed)
        a, b = h & (1 << 64) - 1, h >> 64 | 1
        return [(a + i * b) % self.m for i in range(self.k)]

    def add(self, key: str) -> None:
        for p in self.probes(key):
            self.bits[p >> 3] |= 1 << (p & 7)

    def __contains__(self, key: str) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self.probes(key))


@dataclass
class Cascade:
    """Alternating levels; an odd depth of the first refusal means listed."""

    levels: list[Bloom] = field(default_factory=list)

    def __contains__(self, key: str) -> bool:
        for depth, level in enumerate(self.levels):
            if key not in level:
                return depth % 2 == 1
        return len(self.levels) % 2 == 1


def _level(keys, rate: float, seed: int) -> Bloom:
    level = Bloom(len(keys), rate, seed)
    for k in keys:
        level.add(k)
    return level


def build_cascade(universe: DataFrame, listed: list[str], size: int, seed: int = 0) -> Cascade:
    """A cascade exact over the distinct column `key` of universe, which has size rows."""
    listed = sorted(set(listed))
    if not listed:
        return Cascade()
    bound, rate = 8 * len(listed) + 256, min(0.5, len(listed) / max(size, 1))
    known = universe.sparkSession.createDataFrame([(k,) for k in listed], "key string")
    while True:
        first = _level(listed, rate, seed)

        def passing(batches, first=first):
            for b in batches:
                keep = [k for k in b.column(0).to_pylist() if k in first]
                yield pa.RecordBatch.from_arrays([pa.array(keep, pa.string())], ["key"])

        # an anti join of what passed, not of the universe
        wrong = universe.select("key").mapInArrow(passing, "key string").join(known, "key", "left_anti")
        found = [r.key for r in wrong.limit(bound + 1).collect()]
        if len(found) <= bound:
            break
        rate /= 16  # more false positives than the bound: a stricter first level, nothing is dropped
    levels, inside, outside = [first], listed, found
    while outside:
        levels.append(_level(outside, 0.5, seed + len(levels)))
        inside, outside = outside, [k for k in inside if k in levels[-1]]
    return Cascade(levels)


def candidate_keys(host: str, path: str, labels: list[int], lengths: list[int]) -> list[str]:
    """Keys that could fit the url, longest first."""
    names = host.split(".")
    out = [
        ".".join(names[-n:]) + path[:k]
        for n in labels
        if n <= len(names) and host
        for k in lengths
        if k <= len(path)
    ]
    return sorted(set(out), key=lambda x: (-len(x), x))


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages.

    rules: (verdict, host, path); a rule fits its host and all subdomains where the url's path starts
    with the rule's; the longest wins.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    lists = {v: [h + p for w, h, p in rules if w == v] for v in ("block", "allow")}
    labels = sorted({h.count(".") + 1 for _, h, _ in rules}, reverse=True)
    lengths = sorted({len(p) for _, _, p in rules}, reverse=True)
    host, path = split_url(F.col("url"))
    urls = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))

    def keys(batches):
        for b in batches:
            pairs = set(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            found = sorted({k for h, p in pairs for k in candidate_keys(h, p, labels, lengths)})
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["key"])

    universe = written(urls.select("host", "path").mapInArrow(keys, "key string").distinct(), "keys")
    size = universe.count()
    cascades = {v: build_cascade(universe, lists[v], size, 100 * i) for i, v in enumerate(lists)}

    def judge(batches):
        for b in batches:
            seen, rule, verdict = {}, [], []
            for hp in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if hp not in seen:
                    seen[hp] = next(
                        ((k, v) for k in candidate_keys(*hp, labels, lengths) for v, c in cascades.items() if k in c),
                        (None, default),
                    )
                r, v = seen[hp]
                rule.append(r)
                verdict.append(v)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    kind = urls.schema["page_id"].dataType.simpleString()
    return urls.mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string")


#: Fixed values of the query's contract: verdict, host, path.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

ORACLE = r"""
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (
  SELECT page_id, arg_max(struct_pack(rule := rhost || rpath, verdict := verdict), length(rhost || rpath)) AS best
  FROM u JOIN r ON (host = rhost OR suffix(host, '.' || rhost)) AND prefix(path, rpath)
  GROUP BY page_id)
SELECT u.page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM u LEFT JOIN m ON u.page_id = m.page_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)

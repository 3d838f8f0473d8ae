"""Language identification by Bayesian evidence fusion.

Log posterior = log prior of the host + text likelihood + declared language + address suffix.

- Text: hashed byte trigrams of letters and spaces under a multinomial for each language, all counted and
  the sum tempered to EVIDENCE trigrams' worth, as neighbouring ones aren't independent. A language of
  none (every trigram alike) takes texts that no known language explains.
- Declared: the markup's lang attribute, or a documents table's lang column; it is right with TRUST.
- Suffix: a two-letter label at the host's end, or the first part of the path.
- Host: grouped counts of what text and declaration say, smoothed from all pages to the registered
  domain and from the domain to the host, each with WEIGHT pseudo-counts.

Bounds: the trigram tables are learned from TRAIN_ROWS declared documents a language, told by hash of
the ids (a documented sample of labelled rows), summed on the executors to languages x BUCKETS
counts, for the LANGUAGES languages that most documents declare, so the broadcast table is of 34 MB at most. That is a limit
of classes, well over the 183 languages that have two-letter codes; another declared value is no evidence. Host priors stay a table; a hot host is one row of it after partial
aggregation, its rows take the prior by broadcast and rows without a host by none.

A row is rejected where no language has over half of the posterior, or none of the known ones is the
likeliest, or it has no letters.

Defined results: null or empty text: rejected, with the posterior of the other evidence; null declared
language, host or path: that evidence is left out; ties: the language first in the order of code points, and
no majority rejects; texts of any length count whole, CHUNK bytes or one text at a time; repeated rows: each
counts; empty table: no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, in_chunks, join_skewed, raw_texts, starts_of, written
from .url_filter import split_url

BUCKETS, LANGUAGES, TRAIN_ROWS, CHUNK = 1 << 14, 256, 1500, 1 << 18
EVIDENCE, TRUST, SUFFIX_TRUST, WEIGHT = 60.0, 0.9, 0.8, 20.0
NONE = "none"
LETTER = re.compile(rb"[A-Za-z\x80-\xff]")


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(trigram bucket at each place, trigrams of each text)."""
    padded = [b" " + b" ".join(t.lower().split()) + b" " for t in texts]
    n = np.array([len(t) for t in padded])
    x = np.frombuffer(b"".join(padded), np.uint8).astype(np.uint32)
    h = (x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)) if len(x) > 2 else x[:0]
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    h = ((h >> np.uint32(12)) & np.uint32(BUCKETS - 1)).astype(np.int64)
    # digits and punctuation tell nothing of a language; only letters and spaces count
    said = SAYS[x]
    inside = said[:-2] & said[1:-1] & said[2:] if len(x) > 2 else np.zeros(0, bool)
    ends = np.cumsum(n)[:-1]
    for back in (1, 2):
        inside[ends - back] = False
    owner = np.repeat(np.arange(len(texts)), n)[: len(h)]
    return h[inside], np.bincount(owner[inside], minlength=len(texts))


def learn(docs: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, log likelihoods: BUCKETS x languages and none) from declared documents."""
    bound_batches(docs.sparkSession)
    known = docs.select("doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    counts = {r.lang: r.n for r in counts.collect()}
    languages = sorted(counts)
    if not languages:
        return [], np.zeros((BUCKETS, 1))
    share = F.element_at(F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, rows / counts[k])))]), F.col("lang"))
    sample = known.where((F.xxhash64("doc_id") / F.lit(float(2**64)) + 0.5) < share).select("lang", "text")
    place = {k: i for i, k in enumerate(languages)}

    def count(batches):
        total = np.zeros((len(place), BUCKETS), np.int64)
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), raw_texts(b.column(1)), strict=True):
                total[place[k]] += np.bincount(grams([t])[0], minlength=BUCKETS)
        i, g = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(g.astype(np.int32)), pa.array(total[i, g])], ["l", "g", "n"])

    summed = sample.mapInArrow(count, "l int, g int, n long").groupBy("l", "g").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((BUCKETS, len(languages)))
    table[summed["g"].to_numpy(), summed["l"].to_numpy()] = summed["n"].to_numpy()
    table = np.log((table + 0.5) / (table + 0.5).sum(0))
    return languages, np.hstack([table, np.full((BUCKETS, 1), -np.log(BUCKETS))])


def text_evidence(texts: list[bytes], table: np.ndarray) -> np.ndarray:
    """(texts x languages) tempered log likelihoods; zeros without letters."""
    out = np.zeros((len(texts), table.shape[1]))
    at = 0
    for chunk in in_chunks(texts, CHUNK):
        g, n = grams(chunk)
        lettered = np.array([LETTER.search(t) is not None for t in chunk])
        some = np.flatnonzero((n > 0) & lettered)
        if len(some):
            starts = starts_of(n)[some]
            for l in range(table.shape[1]):
                out[at + some, l] = np.add.reduceat(table[:, l][g], starts) * np.minimum(1, EVIDENCE / n[some])
        at += len(chunk)
    return out


#: Bytes that count: letters, the space and all of UTF-8's longer characters.
SAYS = np.array([b == 32 or b >= 128 or chr(b).isalpha() for b in range(256)])

TAG = re.compile(rb"<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>", re.S | re.I)
LANG = re.compile(rb"<html[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)


def markup(html: bytes) -> tuple[bytes, str | None]:
    """(visible text, declared language)."""
    m = LANG.search(html)
    return TAG.sub(b" ", html), m[1].decode().lower() if m else None


def _one_hot(values: list, languages: list[str], trust: float) -> np.ndarray:
    """Log likelihood of a declared value under each language; zeros where it says nothing."""
    n = len(languages)
    out = np.zeros((len(values), n + 1))
    place = {k: i for i, k in enumerate(languages)}
    for r, v in enumerate(values):
        if v in place and n > 1:
            out[r] = np.log((1 - trust) / n)
            out[r, place[v]] = np.log(trust)
    return out


def evidence(rows: DataFrame, languages: list[str], table: np.ndarray, html: bool = False) -> DataFrame:
    """key, host, domain, lettered, likelihood, first guess of rows (key, body, declared, host, path)."""
    kind = rows.schema["key"].dataType.simpleString()
    model = rows.sparkSession.sparkContext.broadcast(table)  # BUCKETS x languages, whatever the corpus

    def run(batches):
        for b in batches:
            texts, declared = raw_texts(b.column(1)), b.column(2).to_pylist()
            if html:
                pairs = [markup(t) for t in texts]
                texts, declared = [t for t, _ in pairs], [d for _, d in pairs]
            hosts, paths = b.column(3).to_pylist(), b.column(4).to_pylist()
            suffix = []
            for h, p in zip(hosts, paths, strict=True):
                first = (p or "").split("/")[1:2]
                end = (h or "").rsplit(".", 1)[-1]
                suffix.append(end if end in languages else first[0] if first and first[0] in languages else None)
            text = text_evidence(texts, model.value)
            said = text + _one_hot(declared, languages, TRUST)
            total = said + _one_hot(suffix, languages, SUFFIX_TRUST)
            domain = [None if h is None else ".".join(h.split(".")[-2:]) for h in hosts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(3), pa.array(domain, pa.string()), pa.array(text.any(axis=1)), pa.array(list(total), pa.list_(pa.float64())), pa.array(said.argmax(axis=1).astype(np.int32))],
                ["key", "host", "domain", "lettered", "likelihood", "guess"],
            )

    return rows.select("key", "body", "declared", "host", "path").mapInArrow(run, f"key {kind}, host string, domain string, lettered boolean, likelihood array<double>, guess int")


def _votes(votes: DataFrame, keys: list[str], n: int) -> DataFrame:
    """keys, v (votes of each of n guesses as an array), rows (all of them), from counts by guess."""
    some = votes.groupBy(*keys, "guess").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("guess", "n"))).alias("m"), F.sum("n").alias("rows"))
    every = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("double"))
    return some.withColumn("v", every).where("rows IS NOT NULL")


def fuse(found: DataFrame, languages: list[str]) -> DataFrame:
    """key, lang, posterior, keep: host priors by grouped aggregation, then the posterior."""
    n = len(languages) + 1
    votes = written(found.groupBy("host", "domain", "guess").agg(F.count("*").alias("n")), "hosts")
    base, rows = _votes(votes, [], n).select("v", "rows").first() or ([0.0] * n, 0)
    base = [(x + 1) / (rows + n) for x in base]
    # one array for all languages, however many; of a host or domain only the languages guessed are kept till then
    smooth = lambda prior: F.zip_with("v", prior, lambda x, p: (x + WEIGHT * p) / (F.col("rows") + WEIGHT))
    domains = _votes(votes.where("domain IS NOT NULL"), ["domain"], n).select(F.col("domain").alias("d"), smooth(F.lit(base)).alias("p_domain"))
    hosts = _votes(votes.where("host IS NOT NULL"), ["host", "domain"], n).join(domains, F.col("domain") == F.col("d"))
    hosts = hosts.select(F.col("host").alias("h"), smooth(F.col("p_domain")).alias("prior"), "rows")
    hosts = written(hosts, "priors")
    logs = F.zip_with("likelihood", F.coalesce("prior", F.lit(base)), lambda l, p: l + F.log(p))
    named = join_skewed(found.where("host IS NOT NULL"), hosts, F.col("host") == F.col("h"), "rows", rows).select("key", "lettered", "likelihood", "prior")
    bare = found.where("host IS NULL").select("key", "lettered", "likelihood", F.lit(None).cast("array<double>").alias("prior"))
    scored = named.unionByName(bare).select("key", "lettered", logs.alias("logs"))
    scored = scored.select("key", "lettered", F.transform("logs", lambda x: F.exp(x - F.array_max("logs"))).alias("e"))
    best = F.array_position("e", F.array_max("e")).cast("int")
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    names = F.lit([*languages, NONE])
    out = scored.select("key", "lettered", F.element_at(names, best).alias("lang"), (F.array_max("e") / total).alias("posterior"))
    return out.withColumn("keep", F.col("lettered") & (F.col("lang") != NONE) & (F.col("posterior") > 0.5)).drop("lettered")


def identify_documents(docs: DataFrame, model=None) -> DataFrame:
    """key (a hash of doc_id and text), doc_id, lang, posterior, keep: the source column stands for the host."""
    languages, table = model or learn(docs)
    key = F.struct(F.col("doc_id"), F.xxhash64("doc_id", "text").alias("h"))
    rows = docs.select(key.alias("key"), F.col("text").alias("body"), F.col("lang").alias("declared"), F.col("source").alias("host"), F.lit(None).cast("string").alias("path"))
    found = written(evidence(rows, languages, table), "evidence")
    return fuse(found, languages)


def identify_pages(pages: DataFrame, model) -> DataFrame:
    """page_id, lang, posterior, keep of web pages."""
    languages, table = model
    host, path = split_url(F.col("url"))
    none = lambda c: F.when(c != "", c)
    rows = pages.select(F.col("page_id").alias("key"), F.col("html").alias("body"), F.lit(None).cast("string").alias("declared"), none(host).alias("host"), none(path).alias("path"))
    return fuse(written(evidence(rows, languages, table, html=True), "evidence"), languages)


def only_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs that aren't rejected; columns unchanged."""
    bad = identify_documents(docs).where("NOT keep").select(F.col("key.doc_id").alias("_doc"), F.col("key.h").alias("_key"))
    bad = written(bad.distinct(), "rejected")
    same = docs["doc_id"].eqNullSafe(F.col("_doc")) & (F.xxhash64(docs["doc_id"], docs["text"]) == F.col("_key"))
    return docs.join(bad, same, "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    """Documents and pages, each row once: doc_id or page_id, lang, posterior, keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs)
    none = F.lit(None).cast("long")
    of = lambda d, doc, page: d.select(doc.alias("doc_id"), page.alias("page_id"), "lang", F.round("posterior", 6).alias("posterior"), "keep")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return of(identify_documents(docs, model), F.col("key.doc_id"), none).unionByName(of(identify_pages(pages, model), none, F.col("key")))

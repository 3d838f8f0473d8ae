"""Small fixtures against brute force: nulls, empty and long texts, ties, repeats, extra columns, empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import chat_format, common, contamination, language_id, media, mixing, queries, simhash, suffix_dedup, token_counts, toxicity, url_filter
from tests.oracle import SF, check, compare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, fp string, home int"


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6)))
    words = [word() for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, long = prose(60), prose(4000)
    out = [None, "", " \n\t ", "one", "two words", prose(100), shared, f"{prose(30)} {shared} {prose(20)}", f"{shared} {shared}", long, long, "xy" * 400, "z" * 350, f"{prose(20)}\n{shared}", prose(500)]
    near = prose(400).split()
    return [*out, " ".join(near), " ".join([*near[:200], "changed", *near[201:]])]


@pytest.fixture(scope="module")
def docs(spark):
    t = texts()
    rows = [(i, x, ["en", "de", None][i % 3], ["a", "b", None, "é", "b"][i % 5], i, 7, "clash", 1) for i, x in enumerate(t)]
    rows += [rows[7], (None, t[7], "en", "a", 0, 1, "", 2), (3, "another text of one id", None, "a", 0, 1, "", 2)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(docs):
    return [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]


def test_suffix_dedup_matches_brute_force(docs, empty):
    seen, want = {}, {}
    key = lambda r: (r[0] is None, r[0] or 0, zlib.crc32(r[1]))
    for i, b in sorted(set(rows_of(docs)), key=key):
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen[b[p : p + 100]] = 1
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        want[i, len(b)] = (len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    got = suffix_dedup.remove_repeats(docs).collect()
    assert len(got) == docs.count()
    assert {(r.doc_id, r.n_bytes): (r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_long_texts_in_pieces():
    rng = random.Random(4)
    t = bytes(rng.choice(b"ab ") for _ in range(3 * suffix_dedup.CHUNK + 50))
    cut = list(suffix_dedup._pieces([b"", t, b"short"]))
    assert [x for x in cut if x[0] != 1] == [(0, 0, b""), (2, 0, b"short")]
    starts = []
    for _, at, x in cut[1:-1]:
        _, start, length, *_ = suffix_dedup.text_runs([x])
        starts.append(np.concatenate([np.arange(a, a + n) for a, n in zip(start + at, length, strict=True)]))
    # every string of WIDTH bytes stands in one run
    assert np.array_equal(np.concatenate(starts), np.arange(len(t) - suffix_dedup.WIDTH + 1))


def test_suffix_dedup_of_cut_texts(docs, monkeypatch):
    want = sorted((str(r.doc_id), r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect())
    with monkeypatch.context() as m:
        # the patched function goes to the workers with the closure that names it
        whole = suffix_dedup._pieces
        m.setattr(suffix_dedup, "_pieces", lambda texts: ((i, o + k, p[k : k + 50 + suffix_dedup.WIDTH - 1]) for i, o, p in whole(texts) for k in range(0, max(1, len(p) - suffix_dedup.WIDTH + 1), 50)))
        got = sorted((str(r.doc_id), r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == want


def _fingerprint(b):
    words = b.lower().split()
    sh = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def test_simhash_matches_brute_force(docs, empty):
    rows = [(i, _fingerprint(b)) for i, b in rows_of(docs)]
    component = list(range(len(rows)))
    for _ in rows:
        for i, (_, a) in enumerate(rows):
            for j, (_, b) in enumerate(rows):
                if (a ^ b).bit_count() <= 2:
                    component[i] = component[j] = min(component[i], component[j])
    least = {c: min((r[0] for r, k in zip(rows, component, strict=True) if k == c and r[0] is not None), default=None) for c in set(component)}
    want = sorted((str(r[0]), f"{r[1]:016x}", str(least[c])) for r, c in zip(rows, component, strict=True))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each(docs)
    ids = {str(r[0]) for r, c in zip(rows, component, strict=True) if r[0] == least[c]}
    assert kept.columns == docs.columns and {str(r.doc_id) for r in kept.collect()} == ids
    # id 3 stands for two texts, neither of them a copy
    assert kept.where("doc_id = 3").count() == 2


def test_bit_sliced_comparison_over_tiles(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ np.uint64(1 << i) for i in range(0, 40, 3)], base ^ np.uint64(5)]))
    i, j = (np.concatenate(x) for x in zip(*simhash.within(fps, np.arange(len(fps)) + 1, np.full(len(fps), len(fps)), 2), strict=True))
    want = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if int(fps[a] ^ fps[b]).bit_count() <= 2}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want
    monkeypatch.setattr(simhash, "TILE", 4)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = simhash.links(df).collect()
    root = {int(x): int(x) for x in fps.view(np.int64)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in found:
        a, b = find(r.a), find(r.b)
        root[max(a, b)] = min(a, b)
    v = fps.view(np.int64)
    assert all(find(int(v[a])) == find(int(v[b])) for a, b in want)


@pytest.mark.parametrize("hot", [2, 8, 4096])
def test_skewed_join_of_hot_and_rare_keys(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    keys = ["a"] * 12 + ["b"] * 3 + ["c", None, None]
    rows = spark.createDataFrame(list(enumerate(keys)), "id int, key string")
    table = spark.createDataFrame([(k, keys.count(k)) for k in dict.fromkeys(keys)], "k string, n int")
    got = common.join_skewed(rows, table, F.col("key").eqNullSafe(F.col("k")), "n", len(keys)).collect()
    assert sorted((r.id, r.n) for r in got) == [(i, keys.count(k)) for i, k in enumerate(keys)]


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and mixing.mix(empty).count() == 0
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
    assert sum(x[0].target for x in by.values()) == pytest.approx(1.5 * total)
    order = sorted((s for s in by if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    most = {s: 2 * sum(r["size"] for r in x) for s, x in by.items()}
    target, open_ = {}, set(by)
    while True:
        left = 1.5 * total - sum(target.values())
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > most[s]]
        if not over:
            break
        for s in over:
            target[s] = most[s]
        open_ -= set(over)
    target |= {s: weight[s] * level for s in open_}
    for s, x in by.items():
        assert x[0].target == pytest.approx(target[s]) and x[0].source_size * 2 == most[s]
        assert abs(sum(r.taken for r in x) - x[0].target) <= max(r["size"] for r in x)
    again = {(r.doc_id, r["size"], r.copies) for r in mixing.mix(docs).collect()}
    assert again == {(r.doc_id, r["size"], r.copies) for r in got}


def test_media_round_trip(docs, empty):
    for r in media.audio_features(docs).collect():
        t = r.tensors
        assert r.payload_bytes % 64 == 0 and r.payload_bytes > 0 and hashlib.sha256(r.media).hexdigest() == r.media_sha256
        back = bytes(media.decode_wav(r.media)[1])
        assert len(back) == r.payload_bytes and hashlib.sha256(back).hexdigest() == r.payload_sha256 and zlib.crc32(back[-64:]) == r.tail_crc32
        import pyarrow as pa

        x = pa.ipc.open_stream(t).read_all()
        assert x["tensor"].type.shape == [media.SPAN, media.MELS] and x.num_rows == -(-r.n_frames // media.SPAN)
    assert media.audio_features(empty).count() == 0


def test_resampler():
    x = np.random.default_rng(0).normal(size=200).astype(np.float32)
    for up, down in ((1, 2), (3, 2), (2, 3)):
        y = media.resample(x, up, down)
        assert len(y) == -(-len(x) * up // down) and np.isfinite(y).all()
    tone = np.sin(np.arange(4000) * 0.05).astype(np.float32)
    z = media.resample(tone)
    assert abs(np.abs(z[100:-100]).max() - 1) < 0.02  # a low tone passes


def test_toxicity_learns_and_generalises(spark, empty):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        w = [rng.choice(words) for _ in range(60)]
        if bad:
            w[10] = w[30] = "wretched" if i % 10 else "wretchedd"  # a spelling of its own
        rows.append((i, " ".join(w), "x"))
        labels.append((i, int(bad), "clash"))
    docs = spark.createDataFrame([*rows, (None, None, "x"), (1000, "", "x")], "doc_id long, text string, score string")
    out = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int, text string")).collect()
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in out) and len(out) == 402
    assert toxicity.toxicity(empty, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_token_counts_across_blocks(docs, empty, monkeypatch):
    monkeypatch.setattr(token_counts.pack_tokens, "__defaults__", (token_counts.VOCABULARY, 97))  # many documents cross blocks
    enc = token_counts._encoder(open(token_counts.VOCABULARY, "rb").read())
    want = sorted((str(i), len(enc.encode_ordinary(b.decode()))) for i, b in rows_of(docs))
    assert sorted((str(r.doc_id), r.n_tokens) for r in token_counts.token_counts(docs).collect()) == want
    assert token_counts.token_counts(empty).count() == 0


def test_flat_file_scan(spark, tmp_path):
    ids = np.array([1, 2, 9, 9, 3, 4, 5, 6, 7, 9, 8], np.uint16)
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    blocks = token_counts.flat_file_blocks(spark, str(tmp_path / "*.bin"), block_tokens=2)
    got = sorted((r.ordinal, r.n_tokens, r.ended) for r in token_counts.scan_blocks(blocks, eod=9).collect())
    assert got == [(0, 2, True), (1, 0, True), (2, 5, True), (3, 1, False)]


def test_url_cascade_is_exact(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.org/es/x", "http://a.example.org/en/12?x#y", "https://x.com/fr/", "//", "http://x.com", "http://org/", "ftp://notexample.org/es/", "a://b://c.com/de/1", "http://x.com?/de/", "http://é.com/de/\n"]
    rows = [(i, u, "h") for i, u in enumerate([*urls, *[f"http://h{i}.net/p{i}" for i in range(500)]])]
    pages = spark.createDataFrame([*rows, rows[3]], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.url_verdicts(pages, url_filter.RULES).collect()}
    for i, u, _ in rows:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.split(r"[/?#]", rest)[0].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        path = re.split(r"[?#]", rest[len(host) :])[0]
        fit = max(((h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), key=lambda x: len(x[0]), default=(None, "allow"))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, *fit), u
    universe = spark.createDataFrame([(f"k{i}",) for i in range(3000)], "key string")
    cascade = url_filter.build_cascade(universe, [f"k{i}" for i in range(0, 3000, 7)], 3000)
    assert [f"k{i}" in cascade for i in range(3000)] == [i % 7 == 0 for i in range(3000)]


def test_urls_of_an_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.url_verdicts(pages, url_filter.RULES).count() == 0


def test_language_id(docs, empty, spark):
    out = queries.QUERIES["op5_language_id"](spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.col("lang").alias("declared"))
    assert out.join(truth, "doc_id").where("lang <> declared OR NOT keep").count() == 0
    assert out.where("page_id IS NOT NULL AND NOT keep").count() == 0
    kept = language_id.only_identified(docs)
    assert kept.columns == docs.columns and kept.where("text IS NULL OR trim(text) = ''").count() == 0
    assert language_id.only_identified(empty).count() == 0


def _viterbi(lines):
    score = np.full(chat_format.STATES, chat_format.LOW)
    score[1::2] = np.log(chat_format.FIRST)
    score, back = score + chat_format.emissions(lines[0]), []
    for x in lines[1:]:
        s = score[:, None] + chat_format.transitions()
        back.append(s.argmax(0))
        score = s.max(0) + chat_format.emissions(x)
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return [chat_format.ROLES[p // 2] for p in path[::-1]]


def test_chat_roles_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "CHUNK", 3)
    monkeypatch.setattr(chat_format, "FAN", 2)
    rng = random.Random(2)
    rows = [(c, i, rng.choice(["User: hi there", "AI: " + "word " * 70, "what is it?", "plain words", "[system] be kind", "### User: x?"]), "r") for c in (1, 2) for i in range(41)]
    rows += [rows[0], (None, None, None, "r"), (3, 10**6, "only", "r")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string, role string")
    got = {}
    for r in chat_format.recover_roles(df).collect():
        got.setdefault(r.conv_id, []).append((r.turn, r.role))
    for c in (1, 2):
        assert [x for _, x in sorted(set(got[c]))] == _viterbi([t for k, _, t, _ in rows[:82] if k == c])
    assert len(got[1]) == 42 and len(got[None]) == 1
    assert chat_format.recover_roles(df.where("false")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_oracle(spark, name):
    check(*compare(spark, queries.QUERIES[name], queries.ORACLE[name]))


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 0 < out.count() < docs.count() and len(corpus_pipeline.STAGES) == 5
    held = contamination.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).select("doc_id").distinct()
    assert out.join(held, "doc_id").count() == 0
    copies = docs.groupBy("text").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    texts = docs.join(copies, "text").where("doc_id <> first").select("doc_id")
    assert out.join(texts, "doc_id").count() == 0


def _jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("tile", [1024, 3])
def test_near_copies_match_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([30, 150, 600]))]
        for share in (0, 0, 0.005, 0.01, 0.02, 0.03, 0.04, 0.1):
            rows.append((n, " ".join(rng.choice(words) if rng.random() < share else w for w in base)))
            n += 1
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for _, t in rows]
    least = list(range(n))
    for _ in range(n):
        new = [min([least[j] for j in range(n) if _jaccard(sets[i], sets[j]) >= 0.8]) for i in range(n)]
        if new == least:
            break
        least = new
    # texts beyond radius 2 are found, and none below the similarity is
    found = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 5, 18, 0.8).collect()}
    assert [found[i] for i in range(n)] == least and 12 < len(set(least)) < n


def test_pipeline_stage_drops_near_copies(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    two = docs.where("doc_id IN (2, 56)").select(*corpus_pipeline.COLUMNS)
    assert [r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, two, "").collect()] == [2]


def test_one_row_of_each_component_stays(spark):
    text, other = "some words that are all the same here", "quite another text of its own for this"
    near = f"{text} {text}"  # more of the same shingles, and the same fingerprint or nearly so
    rows = [(1, text, "b"), (1, text, "a"), (1, text, "a"), (2, text, "a"), (None, text, "a"), (None, other, "b"), (None, other, "a"), (5, near * 9, "a"), (5, near * 9 + " ", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for more in ({}, {"width": 5, "radius": 18, "similarity": 0.8}):
        kept = simhash.one_of_each(df, **more).collect()
        assert {(r.doc_id, r.text, r.lang) for r in kept} >= {(1, text, "a"), (None, other, "a")}
        assert [r.doc_id for r in kept if r.doc_id != 5].count(1) == 1 and len(kept) == len({r.text.strip() for r in kept})


def test_chat_lines_of_a_row(spark):
    raw = "User: hi there\r\nhow are you?\nAI: hello\n\nI am well: thank you\n[user] good"
    rows = [(1, 0, raw), (2, 0, "System: be kind"), (2, 1, "Human: what is it?\nand why?"), (2, 2, "AI: one thing\nanother"), (3, None, raw)]
    got = {}
    for r in chat_format.recover_roles(spark.createDataFrame(rows, "conv_id long, turn long, text string")).orderBy("turn", "line").collect():
        got.setdefault(r.conv_id, []).append((r.line, r.role, r.begins, r.text, r.rendered))
    turns = [(0, "user", "hi there\nhow are you?"), (2, "assistant", "hello\n\nI am well: thank you"), (5, "user", "good")]
    assert got[1] == got[3] == [(k, role, True, text, f"<|{role}|>\n{text}\n") for k, role, text in turns]
    assert [x[:4] for x in got[2]] == [(0, "system", True, "be kind"), (0, "user", True, "what is it?\nand why?"), (0, "assistant", True, "one thing\nanother")]


def test_chat_lines_are_those_of_the_table(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "CHUNK", 4)
    df = chat_format.as_transcript(spark.read.parquet(f"{SF}/conversations.parquet"))
    given = {}
    for r in df.collect():
        given.setdefault(r.conv_id, []).append((r.turn, r.text))
    for r in (found := chat_format.recover_roles(df).collect()):
        assert r.rendered == (f"<|{r.role}|>\n" if r.begins else "") + r.text + "\n"
    for conv, rows in given.items():
        lines = [x for _, t in sorted(rows) for x in t.split("\n")]
        got = sorted((r for r in found if r.conv_id == conv), key=lambda r: (r.turn, r.line))
        assert sum(r.text.count("\n") + 1 for r in got) == len(lines)
        path = [chat_format.ROLES.index(r.role) * 2 + (r.begins and not k) for r in got for k in range(r.text.count("\n") + 1)]
        seen, trans, start = [chat_format.emissions(x) for x in lines], chat_format.transitions(), np.full(chat_format.STATES, chat_format.LOW)
        start[1::2] = np.log(chat_format.FIRST)
        best = start + seen[0]
        for e in seen[1:]:
            best = (best[:, None] + trans).max(0) + e
        # paths may tie, so their scores are compared
        score = start[path[0]] + sum(trans[a, b] for a, b in zip(path, path[1:], strict=False)) + sum(e[x] for e, x in zip(seen, path, strict=True))
        assert score == pytest.approx(best.max())

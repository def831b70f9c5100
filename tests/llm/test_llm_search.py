"""URL filters, SimHash, top-k, suffix dedup and the pipeline."""

import hashlib
import random
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import simhash, suffix_dedup, topk, url_filter
from tidemark.llm.common import written
from tidemark.llm.components import components
from tidemark.llm.queries import queries

from .test_llm_text import LONG, ODD, SF, odd


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


# --- URL filters

URLS = [None, "", "no scheme", "http://a.NET/x", "https://x.example.net/en/1?q=/de/", "http://example.net/enx", "http://notexample.net/en/", "http://example.com/de/#/en/", "http://EXAMPLE.com/DE/", "http://net", "http://net/", "http://www.org/fr/", "http://xorg/fr/", "ftp://h?x", "://b.net/", "http://a.net:80/", "http://é.NET/É", "http://adserver.io/", "http://y.io/casino/", "http://q.io/?casino/", "http://a.xxx/", "http://u/" + "z" * 100_000]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in url_filter.SITE_RULES:
        own, _, start = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    import re

    blocked = any(re.search(p, host + path) for p, _ in url_filter.PATTERNS)
    return host, path, best[1] if best else None, best[0] if best else "block" if blocked else "allow"


@pytest.mark.parametrize("in_plan", [1000, 0])
def test_urls(spark, in_plan):
    rows = [(k, u) for k, u in enumerate(URLS)] + [(None, URLS[3]), (3, URLS[3])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("token", F.lit(1)).withColumn("host", F.lit("x"))
    out = url_filter.judge(pages, max_in_plan=in_plan)
    assert Counter(map(tuple, out.collect())) == Counter((k, *judged(u)) for k, u in rows)
    assert url_filter.judge(pages.limit(0), max_in_plan=in_plan).count() == 0


def test_both_paths_agree_on_rules_without_tokens(spark):
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(URLS)], "page_id long, url string")
    patterns = [*url_filter.PATTERNS, ("^$", ()), ("[0-9]{2}/", ()), ("zz", ())]
    one, two = (Counter(map(tuple, url_filter.judge(pages, patterns=patterns, max_in_plan=n).collect())) for n in (1000, 0))
    assert one == two and sum(r[4] == "block" for r in one) > sum(r[4] == "block" for r in map(tuple, url_filter.judge(pages).collect()))
    assert one[0, "", "", None, "block"] == 1


def test_the_index_uses_the_rarest_token(spark):
    urls = spark.createDataFrame([(k, f"http://a{k}.example.net/en/x") for k in range(20)] + [(99, "http://b.org/fr/")], "page_id long, url string")
    host, path = url_filter.parts(F.col("url"))
    rules = url_filter.compile_rules(url_filter.SITE_RULES, url_filter.PATTERNS)
    index = dict((k, t) for t, k in url_filter._indexed(rules, urls.select(host.alias("_host"), path.alias("_path"))))
    assert index[2] in ("example", "com", "de") and index[3] in ("org", "fr") and index[4] == "adserver" and index[10] == "xxx" and "" not in index.values()
    assert "Python" not in url_filter.judge(urls)._jdf.queryExecution().toString()


# --- SimHash


def plain_fingerprint(text, words):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + words]) for k in range(len(w) - words + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(rows, words, radius):
    fps, sets, least = [plain_fingerprint(t, words) for _, t in rows], Sets(), {}
    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= radius:
                sets.join(i, j)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[sets.find(i)] = min(least.get(sets.find(i), d), d)
    return Counter((d, f"{f:016x}", least.get(sets.find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps, strict=True)))


def test_simhash_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = Counter(map(tuple, queries()["op5_simhash_near_dedup"](spark, SF).select("doc_id", "fingerprint", "component_id").collect()))
    assert found == plain_groups(rows, 4, 4)


def test_simhash_of_odd_rows(spark):
    out = simhash.group(odd(spark)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id").collect()
    assert Counter(map(tuple, out)) == plain_groups(ODD, 4, 4)
    assert simhash.group(odd(spark, [])).count() == 0


@pytest.mark.parametrize(("radius", "crowded"), [(0, 2000), (1, 2000), (4, 2000), (4, 1), (2, 3)])
def test_the_grid_loses_no_link(spark, radius, crowded):
    rng = np.random.default_rng(radius)
    centres = rng.integers(0, 1 << 64, 30, np.uint64)
    fps = {int(c) ^ sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, 6)))) for c in centres for _ in range(8)} | {0, (1 << 64) - 1, 1, 3}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), radius, crowded).collect()
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius}
    assert Counter(map(tuple, found)) == Counter(want)


def test_components(spark):
    rng, sets = random.Random(3), Sets()
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(2001, 2200)] + [(5, 5)]
    for a, b in edges:
        sets.join(a, b)
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: sets.find(x) for a, b in edges for x in (a, b) if a != b}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, words=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()


def survivors(rows, similarity):
    sets, own = Sets(), [shingles(t) for _, t in rows]
    for i, a in enumerate(own):
        sets.find(i)
        for j in range(i):
            common = len(a & own[j])
            if common >= similarity * (len(a) + len(own[j]) - common):
                sets.join(i, j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[sets.find(i)].append((d is None, d))
    return Counter(min(g)[1] for g in groups.values())


def test_near_duplicates(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = list(ODD)
    for g in range(12):
        text = [word() for _ in range(rng.randrange(60, 400))]
        for _ in range(6):
            copy = list(text)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((100 + len(rows), " ".join(copy)))
    frame = odd(spark, rows).withColumns({c: F.lit(1) for c in ("_nd_group", "_h1", "hash", "_id", "k1", "row", "g1")})
    kept = simhash.deduplicate(frame)
    assert Counter(r.doc_id for r in kept.collect()) == survivors(rows, 0.8)
    assert kept.columns == frame.columns and simhash.deduplicate(odd(spark, [])).count() == 0


def test_a_star_of_near_copies_is_joined_whole(spark):
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(334)]
    rows = [(0, " ".join(base))]
    for k in range(1, 1001):
        copy = list(base)
        for at in rng.sample(range(4, 330, 6), 5):  # each in five shingles of its own
            copy[at] = word()
        rows.append((k, " ".join(copy)))
    own = [shingles(t) for _, t in rows]
    like = lambda a, b: len(a & b) / len(a | b)
    assert all(like(own[0], x) > 0.85 for x in own[1:])
    assert np.mean([like(own[a], own[b]) < 0.8 for a, b in (rng.sample(range(1, 1001), 2) for _ in range(500))]) > 0.9
    assert [r.doc_id for r in simhash.deduplicate(odd(spark, rows)).collect()] == [0]


def broadcast_joins(spark, monkeypatch, query):
    """The joins by broadcast, by type, in the plans of a query's steps, under a threshold that any table is below."""
    plans, key = [], "spark.sql.autoBroadcastJoinThreshold"

    def noted(df, tag):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, tag)

    for module in (simhash, sys.modules[components.__module__]):
        monkeypatch.setattr(module, "written", noted)
    monkeypatch.setattr(simhash, "FEW", -1)
    was = spark.conf.get(key)
    spark.conf.set(key, "1g")
    try:
        noted(query(), "out").count()
    finally:
        spark.conf.set(key, was)
    joins = [line for plan in plans for line in plan.splitlines() if "Join" in line]
    assert sum("SortMergeJoin" in line for line in joins) > 5
    return {kind for line in joins if "BroadcastHashJoin" in line for kind in ("Inner", "LeftOuter", "LeftSemi", "LeftAnti") if kind in line}


def test_the_stage_broadcasts_no_cells(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # crowded cells, groups and survivors have true estimates
    assert "Inner" not in broadcast_joins(spark, monkeypatch, lambda: simhash.deduplicate(docs))


def test_the_query_broadcasts_no_cells(spark, monkeypatch):
    found = broadcast_joins(spark, monkeypatch, lambda: queries()["op5_simhash_near_dedup"](spark, SF))
    assert found <= {"LeftSemi", "LeftAnti"}  # crowded cells


@pytest.mark.parametrize("sampled", [True, False])
def test_the_first_shingles_of_alike_sets_meet(sampled):
    rng = np.random.default_rng(2)
    for _ in range(300):
        common = rng.integers(0, 1 << 64, rng.integers(1, 200), np.uint64)
        a, b = (np.concatenate([common, rng.integers(0, 1 << 64, rng.integers(0, len(common) // 5 + 2), np.uint64)]) for _ in range(2))
        known = np.sort(common[: len(common) // 2]) if sampled else np.zeros(0, np.uint64)
        (n, p), (m, q) = (simhash.prefix(x, 0.8, (known, np.arange(3, 3 + len(known)))) for x in (a, b))
        if len(common) >= 0.8 * (n + m - len(common)):
            assert len(np.intersect1d(p, q)) >= max(1, 0.8 / 1.8 * (n + m) - max(n - len(p), m - len(q)) - 1e-6)


def test_bands_catch_pairs_at_the_threshold():
    rng = np.random.default_rng(5)
    caught = 0
    for _ in range(300):
        common, a, b = (rng.integers(0, 1 << 64, n, np.uint64) for n in (320, 40, 40))
        caught += bool((simhash.bands(np.concatenate([common, a])) == simhash.bands(np.concatenate([common, b]))).any())
    assert caught >= 298


# --- top-k


def plain_top(rows, k, scale, every):
    """The answers of each row whose id is divisible, over all other rows."""
    whole = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for at, (q, a) in enumerate(whole):
        if q is None or q % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i is None, i or 0, i) for j, (i, b) in enumerate(whole) if j != at and len(b) == len(a))
        out.update((q, r + 1, s[3], -s[0]) for r, s in enumerate(scores[:k]))
    return out


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [1.0, 2.0]), (50, [1.0, 2.0]), (50, [3.0, 2.0]), (100, None), (150, [nan, 1.0]), (200, [inf, 1.0]), (250, [None, 1.0]), (300, []), (300, []), (350, [1.0]), (7, [0.001, -0.001]), (8, [1.0, 2.0]), (9, [5.0]), (None, [1.0, 2.0]), (400, [-1.0, -2.0]), (2**63 - 1, [1.0, 2.0]), (-(2**63), [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("score", "rid", "picked", "query")}).repartition(3)
    out = topk.top_k(frame, F.col("vec_id") % 50 == 0, k=3)
    assert Counter(map(tuple, out.collect())) == plain_top(rows, 3, 256, 50)
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_ties_blocks_and_large_numbers(spark):
    rng = np.random.default_rng(1)
    vectors = rng.integers(-2, 3, (300, 6)).astype(float)
    vectors[::3] = vectors[0]
    vectors[5] *= 1e9
    vectors[10] *= 1e9
    rows = [(int(i) % 290, [float(x) for x in v]) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    out = topk.top_k(frame, F.col("vec_id") % 10 == 0, k=4, lists=3, scale=1.0, block=500)
    assert Counter(map(tuple, out.collect())) == plain_top(rows, 4, 1.0, 10)


def test_the_threshold_leaves_most_pairs_unresolved():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True))
    rows = topk.Vectors(np.arange(4000), np.arange(4000), np.zeros(4000, bool), x)
    q, cuts = rows.part(slice(0, 50)), np.array_split(np.arange(64), 8)
    gathered, n = [[] for _ in range(50)], 0
    for a in range(0, 4000, 500):  # a task's local lists, a chunk at a time
        i, j = topk.local_list(q, rows.part(slice(a, a + 500)), cuts[0], 20)
        n += len(i)
        for k, e in zip(i, topk.exact(q.x[i], x[a + j]), strict=True):
            gathered[k].append(e)
    cutoff = np.array([sorted(g)[-5] for g in gathered], float)
    i2, j2 = topk.survivors(q, rows, cuts, cutoff)
    assert n + len(i2) < 0.25 * 50 * 4000
    score = x @ q.x.T
    for k in range(50):
        score[k, k] = -np.inf
        assert set(np.flatnonzero(score[:, k] >= cutoff[k])) <= set(j2[i2 == k])


# --- suffix dedup


def plain_removal(rows, length):
    seen, out = Counter(), Counter()
    whole = [(i, (t or "").encode()) for i, t in rows]
    for _, x in whole:
        seen.update(x[k : k + length] for k in range(len(x) - length + 1))
    for i, x in whole:
        gone = bytearray(len(x))
        for k in range(len(x) - length + 1):
            if seen[x[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        spans = sum(bool(g) and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def texts(seed, n=60):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("ab\né ") for _ in range(rng.randrange(15, 90))) for _ in range(25)]
    return [(k, "".join(rng.choice(pool)[rng.randrange(8) :] for _ in range(rng.randrange(0, 6))) + rng.choice(["", "a" * 70])) for k in range(n)]


@pytest.mark.parametrize("crowded", [200, 1])
def test_repeats(spark, crowded):
    rows = texts(crowded) + ODD[:6] + [(900, "x" * 3000), (901, None)]
    frame = odd(spark, rows).withColumns({c: F.lit(1) for c in ("r1", "gram", "head", "m", "bytes", "s", "dup")})
    found = suffix_dedup.remove_repeats(frame, length=24 if crowded == 200 else 40, gram=6, texts=True, crowded=crowded).collect()
    assert Counter(tuple(r)[:5] for r in found) == plain_removal(rows, 24 if crowded == 200 else 40)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in found)


def test_batches_meet_all_before_them(spark):
    rows = texts(11, 50) + [(7, "the same row " * 9), (7, "the same row " * 9)]
    levels = suffix_dedup.SuffixLevels(spark, 24, 6)
    for k in range(5):
        levels.add(odd(spark, rows[10 * k : 10 * k + 10] + ([rows[-1]] if k == 4 else [])))
        so_far = rows[: 10 * k + 10] + ([rows[-1]] if k == 4 else [])
        own = Counter(i for i, _ in rows[10 * k : 10 * k + 10])
        want = plain_removal(so_far, 24)
        # the batch alone was handed in; earlier documents lose what it repeats, too
        assert Counter(map(tuple, levels.removed().collect())) == want
        latest = Counter(map(tuple, levels.removed(latest=True).collect()))
        assert latest <= want and (k == 4 or latest == Counter({w: n for w, n in want.items() if w[0] in own}))
        assert [bool(p) for p in levels.levels] == [[True], [False, True], [True, True], [False, False, True], [True, False, True]][k]
    array = suffix_dedup.table(spark, levels.levels[2])
    assert [tuple(r) for r in array.select("head", "gram", "run").collect()] == [tuple(r) for r in array.select("head", "gram", "run", F.spark_partition_id().alias("p")).orderBy("p", "head", "gram", "run").select("head", "gram", "run").collect()]
    scan, merge = (f._jdf.queryExecution().executedPlan().toString() for f in (levels.merge_scan(suffix_dedup.table(spark, levels.levels[0])), levels.merged(array, suffix_dedup.table(spark, levels.levels[0]))))
    assert all("SortMergeJoin" in plan and "Exchange" not in plan for plan in (scan, merge))


def test_repeats_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert Counter(map(tuple, queries()["op8_suffix_dedup"](spark, SF).collect())) == plain_removal(rows, 200)


def test_long_texts_and_empty_tables(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_300_000))
    rows = [(1, long), (2, long[400_000:1_000_000]), (3, LONG[:50])]
    found = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(odd(spark, rows)).collect()}
    assert found == {1: (600_000, 1), 2: (600_000, 1), 3: (0, 0)}
    assert suffix_dedup.remove_repeats(odd(spark, [])).count() == 0


# --- pipeline


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
            docs = corpus_pipeline.written(out, "stage")
            kept[name] = {r.doc_id: r.text for r in docs.collect()}
        else:
            assert {r.doc_id for r in out.collect()} == set(kept["benchmark_decontamination"])
    assert kept["language_id"].keys() >= kept["line_dedup"].keys() >= kept["simhash_near_dedup"].keys() >= kept["benchmark_decontamination"].keys()
    before = sorted(kept["line_dedup"].items())
    assert set(survivors(before, 0.8)) == set(kept["simhash_near_dedup"])
    assert len(kept["language_id"]) >= 0.95 * spark.read.parquet(f"{SF}/documents.parquet").count()


def test_stages_take_odd_and_empty_tables(spark):
    for rows in (ODD, []):
        docs = odd(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            out = corpus_pipeline.written(stage(spark, docs, SF), "stage")
            assert out.count() <= max(len(rows), 1) or name == "best_fit_packing"
            docs = out

import random
from collections import defaultdict

import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from kerbline.llm import simhash


def brute(rows, shingle=3, most=3):
    prints = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
        h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)))
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                up[find(i)] = find(j)
    low = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)].append(k)
    return sorted((str(k), prints[i], str(min(low[find(i)], default=None))) for i, (k, _) in enumerate(rows))


def texts(seed=1):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(99)) for _ in range(120)) for _ in range(12)]
    out = []
    for k in range(260):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            words[rng.randrange(len(words))] = "x" + str(rng.randrange(999))
        out.append((k, " ".join(words)))
    return [*out, (900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "oNE"), (905, "a b"), (None, "a b"), (None, "lone words here"), (17, out[3][1]), (906, "w " * 60_000)]


def got(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("component", F.lit(1))
    return sorted((str(r.id), r.fp % 2**64, str(r.component)) for r in simhash.simhash_components(df, **kw).collect())


def test_equals_brute_force(spark):
    assert got(spark, texts()) == brute(texts())


def test_wider_distance(spark):
    assert got(spark, texts(2), shingle=5, max_distance=7) == brute(texts(2), 5, 7)


def test_split_buckets_give_the_same_components(spark, monkeypatch):
    rows = texts(3)
    monkeypatch.setattr(simhash, "BLOCK", 8)
    assert got(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert got(spark, []) == []
    assert simhash.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_deduplicate_keeps_one_of_each_group(spark):
    rows = texts(4)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    want = {k for (k, t), c in [((int(k), ""), int(c)) for k, _, c in brute([r for r in rows if r[0] is not None and (r[1] or "").strip()], 5, 7)] if k == c}
    assert sorted(x for x in ids if x is not None) == sorted([*want, 900, 901, 902, *([17] if 17 in want and ids.count(17) == 2 else [])])
    assert ids.count(None) == 2


def test_pipeline_stage_acts_on_exact_similarity(spark):
    rng = random.Random(6)
    rows = []
    for b in range(60):
        base = [f"b{b}x{k}" for k in range(rng.randrange(20, 200))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(2):
            words = list(base)
            # about 0.7 to 0.95: some pairs on either side of 0.8
            for p in rng.sample(range(len(words)), max(1, len(words) * rng.randrange(1, 5) // 100)):
                words[p] = f"e{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(words)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                lo, hi = sorted((find(i), find(j)))
                up[hi] = lo
    want = [i for i in range(len(rows)) if find(i) == i]
    assert 70 < len(want) < 150
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in got.collect()) == want


def test_rare_pairs_miss_no_similar_pair(spark):
    rng = random.Random(9)
    shared, sets = [rng.randrange(10**15) for _ in range(90)], {}
    for b in range(50):
        base = rng.sample(shared, rng.randrange(60, 91)) + [rng.randrange(10**15) for _ in range(rng.randrange(0, 60))]
        sets[len(sets)] = set(base)
        for _ in range(2):
            sets[len(sets)] = set(rng.sample(base, len(base) - rng.randrange(0, 14))) | {rng.randrange(10**15) for _ in range(rng.randrange(0, 5))}
    sets |= {len(sets): {1}, len(sets) + 1: {1}, len(sets) + 2: {1, 2}}
    root = {k: k - k % 3 if k % 4 == 0 else k for k in sets}
    like = lambda x, y: len(x & y) / len(x | y)
    want = {(a, b) for b in sets for a in range(b) if like(sets[a], sets[b]) >= 0.8 and root[a] != root[b]}
    members = spark.createDataFrame([(k, root[k], sorted(s)) for k, s in sets.items()], "key long, root long, s array<long>")
    got = {(r.a, r.b) for r in simhash.rare_pairs(simhash.rarest(members, 0.8), 0.8).collect()}
    assert len(want) > 50 and want <= got
    assert all(root[a] != root[b] and a < b for a, b in got)
    assert len(got) < 0.5 * len(sets) * (len(sets) - 1) / 2


def test_members_of_a_large_key_equal_those_of_small_ones(spark, monkeypatch):
    rng = random.Random(10)
    shared = " ".join(f"s{k}" for k in range(60))
    rows = []
    for b in range(40):
        own = [f"w{rng.randrange(10**9)}" for _ in range(rng.randrange(5, 40))]
        rows.append((len(rows), f"{shared} {' '.join(own)}"))
        rows.append((len(rows), f"{shared} {' '.join(own[: len(own) - rng.randrange(0, 5)])}"))
    docs = spark.createDataFrame(rows, "id long, text string")
    few = {(r.id, r.component) for r in simhash.similar(docs, "id", "text", 5, 0.8).collect()}
    monkeypatch.setattr(simhash, "FEW", 1)
    assert {(r.id, r.component) for r in simhash.similar(docs, "id", "text", 5, 0.8).collect()} == few


def test_rarest_makes_rows_for_first_shingles_only(spark, monkeypatch):
    made, put = {}, simhash.written

    def spied(df, path):
        out = put(df, path)
        made[path.split("/")[-1].rpartition("-")[0]] = out.count()
        return out

    monkeypatch.setattr(simhash, "written", spied)
    shared = list(range(-100, 0))
    sets = [(k, k, shared + list(range(1000 * k, 1000 * k + 25))) for k in range(1, 200)]
    first = simhash.rarest(spark.createDataFrame(sets, "key long, root long, s array<long>"), 0.8)
    assert made["similar-prefixes"] <= 199 * 26  # of 199 * 125 shingles; 26 of each would do, and the common ones come last
    assert sum(r.t < 0 for r in first.collect()) < 2 * 199  # one each, and a few whose own share a slot with a common one


def test_pipeline_stage_links_by_fingerprints(spark):
    base = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(base[:200] + [f"x{k}"] + base[201:])) for k in range(6)] + [(90, "some other text that stands alone here")]
    hashes = [simhash.shingles(t.encode()) for _, t in rows]
    fps = [simhash.majority(h) for h in hashes]
    linked = {k for k in range(1, 6) if any((fps[k] ^ fps[j]).bit_count() <= 3 for j in range(6) if j != k)}
    frame = spark.createDataFrame([(k, len(h), simhash.np.uint64(f).view(simhash.np.int64).item()) for k, (h, f) in enumerate(zip(hashes, fps, strict=True))], "key long, n int, fp long")
    pairs = {(r.hub, r.key) for r in simhash.fingerprint_pairs(frame, 3).collect()}
    assert linked and all(hub < key < 6 for hub, key in pairs) and {k for p in pairs for k in p} >= linked
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in got.collect()) == [0, 90]

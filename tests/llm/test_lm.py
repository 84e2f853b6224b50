import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kerbline.llm import lm, queries


def texts(seed=1):
    rng = random.Random(seed)
    words = ["the", "of", "a", *(f"w{k}" for k in range(60))]
    out = [(k, " ".join(rng.choices(words, [30, 20, 10] + [60 / (j + 1) for j in range(60)], k=rng.randrange(0, 40)))) for k in range(150)]
    return [*out, (900, None), (901, ""), (902, "New words Here"), (None, "the OF a"), (5, out[5][1]), (903, "the w1 " * 30_000)]


def brute(train, rows):
    tok = lambda t: [*(t or "").encode().lower().split(), "\n"]
    pairs = Counter(p for _, t in train for p in zip(["\x02", *tok(t)], tok(t), strict=False))
    one = Counter(w for _, t in train for w in tok(t))
    ends, n = Counter(b for _, b in pairs), sum(one.values())
    of = lambda cs: lm.discounts(*(sum(c == k for c in cs) for k in (1, 2, 3, 4)))
    dl, dh = of(ends.values()), of(pairs.values())
    begun, uniform = defaultdict(list), 1 / (len(one) + 1)
    for (a, _), c in pairs.items():
        begun[a].append(c)
    spare = sum(dl[min(c, 3) - 1] for c in ends.values()) / len(pairs) if pairs else 1.0

    def p(b, a):
        low = spare * uniform + ((ends[b] - dl[min(ends[b], 3) - 1]) / len(pairs) if ends[b] else 0)
        if not begun.get(a):
            return low
        c = pairs[a, b]
        return ((c - dh[min(c, 3) - 1]) if c else 0) / sum(begun[a]) + sum(dh[min(x, 3) - 1] for x in begun[a]) / sum(begun[a]) * low

    for k, t in rows:
        w = tok(t)
        yield str(k), len(w), sum(one[x] > 0 for x in w), n, sum(math.log10((one[x] + 1) / (n + len(one) + 1)) for x in w), sum(math.log10(p(b, a)) for a, b in zip(["\x02", *w], w, strict=False))
    if pairs:
        assert sum(p(b, "the".encode()) for b in one) + p("unseen", "the".encode()) == pytest.approx(1)


def check(spark, train, rows):
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = sorted((str(r.id), *r[1:]) for r in lm.score(frame(rows), lm.fit(frame(train))).collect())
    want = sorted(brute(train, rows))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[0] == w[0] and g[1:] == pytest.approx(w[1:], rel=1e-9), (g, w)


def test_equals_a_plain_model(spark, monkeypatch):
    rows = texts()
    check(spark, [r for r in rows if r[0] is None or r[0] % 3], rows)


def test_no_training_text_and_empty_table(spark):
    check(spark, [], [(1, "a b"), (2, None)])
    check(spark, [(1, "a b")], [])


def brute3(train, rows):
    tok = lambda t: [*(t or "").encode().lower().split(), "\n"]
    grams = lambda t: zip(["\x02", "\x02", *tok(t)], ["\x02", *tok(t)], tok(t), strict=False)
    counts = [None, None, None, Counter(g for _, t in train for g in grams(t))]
    counts[2] = Counter(g[1:] for g in counts[3])
    counts[1] = Counter(g[1:] for g in counts[2])
    d = [lm.discounts(*(sum(x == k for x in c.values()) for k in (1, 2, 3, 4))) if c is not None else None for c in counts]
    begun = defaultdict(list)
    for c in counts[1:]:
        for g, x in c.items():
            begun[g[:-1], len(g)].append(x)

    def p(g):
        if not g:
            return 1 / (len(counts[1]) + 1)
        below, all_of, e = p(g[1:]), begun.get((g[:-1], len(g))), d[len(g)]
        if not all_of:
            return below
        x = counts[len(g)][g]
        return ((x - e[min(x, 3) - 1] if x else 0) + sum(e[min(y, 3) - 1] for y in all_of) * below) / sum(all_of)

    return {k: sum(math.log10(p(g)) for g in grams(t)) for k, t in rows}


def test_order_3_equals_a_plain_model(spark):
    rows = [r for r in texts(3) if r[0] is not None]
    train = [(k, t) for k, t in rows if k % 3]
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    got = {r.id: r.score for r in lm.score(frame(rows), lm.fit(frame(train), order=3)).collect()}
    assert got == pytest.approx(brute3(train, rows), rel=1e-9)
    assert [r.score for r in lm.score(frame([(1, "a b")]), lm.fit(frame([]), order=3)).collect()] == [0.0]


def test_op1_is_of_order_3(spark, tmp_path):
    rows = [r for r in texts(4) if r[0] is not None]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op1_lm_score(spark, str(tmp_path)).collect()
    want = brute3([(k, t) for k, t in rows if zlib.crc32(str(k).encode()) % 7 != 2], rows)
    assert {r.doc_id: r.score for r in got} == pytest.approx(want, rel=1e-9)


def test_counts_beyond_a_byte_and_many_shards(spark, monkeypatch):
    """Thousands of shards, few of them mapped at once; counts of 255 and more are whole."""
    counts = np.array([1, 254, 255, 256, 2**40, 3])
    column, large = lm.packed(counts)
    raw = np.frombuffer(b"".join(column), np.uint8)
    assert large == 3
    back = lm.Counts(raw[:6], raw[6:30].view(np.int64), raw[30:54].view(np.int64))
    assert back[np.array([4, 0, 2, 2, 1, 5])].tolist() == [2**40, 1, 255, 255, 254, 3]
    monkeypatch.setattr(lm, "shards", lambda rows: 3000)
    monkeypatch.setattr(lm, "OPEN", 5)
    rows = texts(7)[:40]
    check(spark, rows, rows)


def test_keys_are_sent_whole():
    rng = np.random.default_rng(1)
    for keys in (np.zeros(0, np.uint64), np.array([0, 2**64 - 1], np.uint64), np.unique(rng.integers(0, 2**64, 5000, np.uint64)), np.unique(rng.integers(0, 2**40, 5000, np.uint64))):
        assert (lm.uncoded(lm.coded(keys)) == keys).all()


def test_gathering_a_shard_holds_few_copies():
    rng = np.random.default_rng(3)
    parts = [np.unique(rng.integers(0, 1 << 63, 50_000, np.uint64)) for _ in range(20)] + [np.arange(5, dtype=np.uint64)] * 2
    counts = [np.arange(1, len(p) + 1, dtype=np.uint32) for p in parts]
    table = pa.table({"keys": pa.array([lm.coded(p) for p in parts], pa.binary()), "counts": pa.array([c.tobytes() for c in counts], pa.binary())})
    tracemalloc.start()
    keys, sums = lm._gathered(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = Counter()
    for p, c in zip(parts, counts, strict=True):
        want.update(dict(zip(p.tolist(), c.tolist(), strict=True)))
    assert dict(zip(keys.tolist(), sums.tolist(), strict=True)) == want and (np.diff(keys.astype(object)) > 0).all()
    assert peak < 45 * sum(map(len, parts)), peak


def test_shards_are_small_however_large_the_corpus(spark):
    """A task sorts a whole shard: it gets 4 MB of input, not 32. The plan's estimate is that of all rows, few of which are kept."""
    docs = spark.range(1 << 24).where("id % 4000000 = 0").select(F.col("id").alias("doc_id"), F.concat(F.lit("one two "), F.col("id").cast("string")).alias("text"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    model = lm.fit(docs, order=3)
    assert size > 200 << 20 and len(model.bigrams.sizes) >= size >> 22
    assert model.tokens == 4 * docs.count() and sum(model.bigrams.sizes) == model.bigrams.total == 2 + 2 * docs.count()

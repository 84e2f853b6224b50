import random

import pytest
from pyspark.sql import functions as F

from kerbline.llm import decontamination as dc
from kerbline.llm.licenses import words_in


def fewest(item, doc):
    """Edits of item against the best part of doc."""
    row = [0] * (len(doc) + 1)
    for i, x in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(doc, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def brute(docs, items, most=dc.MAX_EDITS):
    out = {}
    for d, text in docs:
        w = words_in((text or "").encode())
        for i, t in items:
            x = words_in((t or "").encode())
            if len(x) >= dc.MIN_WORDS and w and (e := fewest(x, w)) <= int(len(x) * most + 1e-9):
                out[d, i] = e
    return out


def tables(seed=1):
    rng = random.Random(seed)
    pool = [f"w{k}" for k in range(150)] + ["the", "of"] * 20
    items = [(k, " ".join(rng.choice(pool) for _ in range(rng.randrange(8, 40)))) for k in range(14)]
    docs = []
    for k in range(90):
        w = [rng.choice(pool) for _ in range(rng.randrange(0, 60))]
        if k % 3 < 2:
            x = rng.choice(items)[1].split()
            for _ in range(int(len(x) * 0.2) if k % 3 else 0):
                p = rng.randrange(len(x))
                x[p : p + rng.randrange(2)] = [rng.choice(pool)] * rng.randrange(2)
            p = rng.randrange(len(w) + 1)
            w[p:p] = [t.upper() + rng.choice(["", ",", "."]) for t in x]
        docs.append((k, " ".join(w)))
    return docs, items


def test_finds_what_brute_force_finds(spark):
    docs, items = tables()
    docs += [(900, None), (901, ""), (None, items[0][1]), (3, docs[3][1]), (902, "w1 the " * 40_000 + items[2][1])]
    items += [(50, None), (51, "too short"), (None, items[1][1]), (52, " ".join(f"v{k}" for k in range(300)))]
    long = [f"v{k}" for k in range(300)]
    docs += [(903, " ".join(long[70:160])), (904, " ".join(["x"] * 500 + long[:120] + ["y", "z"] + long[159:] + ["x"] * 9)), (905, "a Too, short b")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = dc.find_passages(df, bench).collect()
    got = {(r.doc_id, r.item_id): r.edits for r in rows}
    want = brute([d for d in docs if d[0] not in (902, 903, 904)], items)
    assert got.pop((902, 2)) == 0 and (903, 52) not in got  # 90 of 300 words
    assert got.pop((904, 52)) == 39 and got.pop((905, 51)) == 0
    assert [(k, e, want.get(k)) for k, e in got.items() if e < want.get(k, 99) or k not in want] == []
    assert all(k in got for k, e in want.items() if e == 0)
    assert len(got) >= 0.95 * len(want) and len(want) > 50
    assert len([r for r in rows if r.doc_id == 3]) == 2 * len([k for k in got if k[0] == 3])
    for r in rows:
        text = next(t for d, t in docs if d == r.doc_id)
        part = words_in(text.encode())[r.first_word : r.last_word + 1]
        if r.item_words < 300 or r.doc_id == 904:
            assert fewest(words_in(next(t for i, t in items if i == r.item_id).encode()), part) == r.edits
    left = dc.without_passages(df, bench)
    assert left.columns == df.columns
    gone = {k[0] for k in got} | {902, 904, 905}
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(d) for d, _ in docs if d is None or d not in gone)
    assert dc.find_passages(df.limit(0), bench).collect() == [] and dc.find_passages(df, bench.limit(0)).collect() == []


def test_rows_and_blocks(spark, monkeypatch):
    """Equal ids, null ids and repeated rows are rows of their own, whatever the blocks."""
    docs, items = tables(4)
    items = [(7, t) for _, t in items[:4]] + [(None, t) for _, t in items[4:8]] + [items[9], items[9], (8, "seven words that stand in a row"), (9, "")]
    docs = [(k, f"{items[k % 9][1]} so, seven WORDS that stand in a row") for k in range(18)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(str, dc.find_passages(*frames).collect()))
    assert len(whole) == 18 + 2 + 18
    for size, piece in ((300, 1 << 20), (900, 1)):
        monkeypatch.setattr(dc, "BLOCK_BYTES", size)
        monkeypatch.setattr(dc, "PIECE_BYTES", piece)
        assert sorted(map(str, dc.find_passages(*frames).collect())) == whole
    assert dc.without_passages(*frames).collect() == []


def test_recall_at_all_edits():
    _, items = tables(5)
    index = dc.Index([(k, t.encode()) for k, t in items])
    assert index.simulated >= dc.RECALL or index.walks == dc.MAX_WALKS


def edited(kind, seed=8, n=60):
    """Items of 49 to 59 words, and a document for each with all the edits of one kind."""
    rng = random.Random(seed)
    items = [(k, " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(49, 60)))) for k in range(n)]
    docs = []
    for k, t in items:
        x = t.split()
        for _ in range(int(len(x) * dc.MAX_EDITS + 1e-9)):
            p = rng.randrange(len(x))
            x[p : p + (kind != "insertion")] = [] if kind == "deletion" else [f"e{rng.randrange(999)}"]
        docs.append((k, f"before it {' '.join(x)} after it"))
    return docs, items


@pytest.mark.parametrize("kind", ["deletion", "insertion", "substitution"])
def test_recall_of_each_kind_of_edit(spark, kind):
    docs, items = edited(kind, n=100)
    got = dc.find_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert len({(r.doc_id, r.item_id) for r in got.collect()} & brute(docs, items).keys()) >= 93


def test_every_window_left_is_verified_where_walks_do_not_suffice(spark, monkeypatch):
    monkeypatch.setattr(dc, "MAX_WALKS", 2)
    docs, items = tables(6)
    index = dc.Index([(k, t.encode()) for k, t in items])
    assert index.whole.any() and index.simulated >= dc.RECALL
    docs += [(200 + k, t) for k, t in edited("deletion", n=20)[0]]
    items += [(200 + k, t) for k, t in edited("deletion", n=20)[1]]
    got = dc.find_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id): r.edits for r in got.collect()} == want and len(want) > 60

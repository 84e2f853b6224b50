import math

import numpy as np
from pyspark.sql import functions as F

from kerbline.llm import embeddings


def brute(rows, threshold):
    def good(v, label):
        return label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    u = {i: np.array(v) / max(map(abs, v)) for i, (_, v, label) in enumerate(rows) if good(v, label)}
    u = {i: v / np.sqrt(v @ v) for i, v in u.items()}
    up, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in u:
        for j in u:
            if i != j and rows[i][2] == rows[j][2] and len(u[i]) == len(u[j]) and u[i] @ u[j] >= threshold - 1e-13:
                links[i] += 1
                up[find(i)] = find(j)
    low = {}
    for i, (k, _, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(k, low.get(find(i), k))
    return sorted((str(k), links[i], str(low.get(find(i)))) for i, (k, _, _) in enumerate(rows))


def rows_(seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(25, 24))
    out = []
    for k in range(300):
        v = base[rng.integers(25)] + rng.normal(size=24) * rng.choice([0, 0.15, 0.3, 1])
        out.append((k, [float(x) for x in v * rng.choice([1, 1, 100])], int(rng.integers(3))))
    one = out[0][1]
    out += [(900, None, 1), (901, [0.0] * 24, 1), (902, [float("nan")] + one[1:], out[0][2]), (903, [None] + one[1:], out[0][2]), (904, [float("inf")] + one[1:], 0), (905, one, None), (None, one, out[0][2]), (0, one, out[0][2]), (906, [], 1)]
    out += [(907, [1e200, 1e200], 0), (908, [1e-200, 1e-200], 0), (909, [1.0, -1.0], 0), (910, [5.0], 7), (911, [2.0], 7)]
    return out


def got(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n", F.lit("clash"))
    return sorted((str(r.id), r.n_links, str(r.component)) for r in embeddings.embedding_components(df).collect())


def test_equals_brute_force_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 40)
    monkeypatch.setattr(embeddings, "STRIPE", 16)
    monkeypatch.setattr(embeddings, "PAIRS", 7)
    rows = rows_()
    assert got(spark, rows) == brute(rows, 0.93)


def test_empty_table(spark):
    assert got(spark, []) == []

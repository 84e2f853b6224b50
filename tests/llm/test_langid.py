import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kerbline.llm import langid

SYLLABLES = {"en": ["the", "and", "ing", "er", "th"], "fr": ["eau", "tion", "é", "que", "ou"], "de": ["sch", "ung", "ein", "ß", "ich"]}


def texts(n, seed):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        lang = rng.choice(list(SYLLABLES))
        out.append((k, lang, " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(30)).capitalize() + "."))
    return out


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(spark.createDataFrame(texts(240, 1), "id long, lang string, text string"))


def test_held_out_accuracy_and_defined_cases(spark, model):
    rows = [*texts(300, 2), (900, "en", None), (901, "en", ""), (902, "en", "123 *** _ 4"), (903, "en", "the"), (None, "en", "the thing and"), (903, "en", "the"), (904, "fr", "queeau tion " * 40_000), (905, "xx", "жщъ " * 40)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("score", F.lit("clash"))
    got = langid.predict(df, model).collect()
    assert len(got) == len(rows)
    by = {r.id: r for r in got}
    assert sum(by[k].lang_pred == lang for k, lang, _ in rows[:300]) == 300
    assert all(0 <= r.score <= 1 for r in got)
    assert {(by[k].lang_pred, by[k].score, by[k].rejected) for k in (900, 901, 902)} == {("und", 0.0, True)}
    assert by[904].lang_pred == "fr" and by[905].rejected and not by[903].rejected and by[None].lang_pred == "en"
    kept = langid.accepted(df, model)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.id) for r in got if not r.rejected)
    assert sum(r.rejected for r in got) == 4


def test_word_scores_equal_a_plain_model():
    counts = {w: c for w, c in Counter(w for _, lang, t in texts(60, 3) if lang == "en" for w in langid._LETTERS.findall(t.lower())).items()}
    import numpy as np
    import pyarrow as pa

    order, rows = 3, defaultdict(int)
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(counts)), pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "times"])
    for b in langid._count(iter([batch]), order):
        for r in b.to_pylist():
            rows[r["n"], r["gram"], r["context"], r["longer"]] += r["times"]
    adjusted = defaultdict(int)
    for (n, g, ctx, longer), t in rows.items():
        adjusted[n, g, ctx] += t if n == order or longer == 0 else 1
    cols = list(zip(*adjusted, strict=True))
    arrays = langid.estimate(np.array(cols[1], np.int64).view(np.uint64), np.array(cols[2], np.int64).view(np.uint64), np.array(cols[0]), np.array(list(adjusted.values())), 0.01)
    got = langid.word_scores(langid.Model(["en"], order, [], [], 0.01), [arrays], ["thing", "anderz", "q"])

    # a plain model over strings
    full, left = Counter(), defaultdict(set)
    for w, c in counts.items():
        s = "\x02" + w + "\x03"
        for i in range(1, len(s)):
            for n in range(1, min(order, i + 1) + 1):
                full[s[i - n + 1 : i + 1]] += c
                if n <= i:
                    left[s[i - n + 1 : i + 1]].add(s[i - n])
    c_of = {g: c if len(g) == order or g[0] == "\x02" else len(left[g]) for g, c in full.items()}
    d = {}
    for n in range(1, order + 1):
        ones, twos = (sum(c == k and len(g) == n for g, c in c_of.items()) for k in (1, 2))
        d[n] = ones / (ones + 2 * twos) if ones else 0.5

    def p(c, h):
        low = p(c, h[1:]) if h else 0.01
        same = [x for g, x in c_of.items() if len(g) == len(h) + 1 and g[:-1] == h]
        if not same:
            return low
        return max(c_of.get(h + c, 0) - d[len(h) + 1] * ((h + c) in c_of), 0) / sum(same) + d[len(h) + 1] * len(same) / sum(same) * low

    for k, w in enumerate(["thing", "anderz", "q"]):
        s = "\x02" + w + "\x03"
        want = -sum(math.log(p(s[i], s[max(0, i - order + 1) : i])) for i in range(1, len(s)))
        assert got[k][0] == pytest.approx(want, rel=1e-9)


def test_no_labels_and_empty_table(spark):
    empty = langid.fit(spark.createDataFrame([(1, None, "a text"), (2, "en", None)], "id long, lang string, text string"))
    assert empty.languages == []
    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    assert [tuple(r)[:3] for r in langid.predict(docs, empty).collect()] == [(1, "und", 0.0)]
    assert langid.predict(docs.limit(0), empty).collect() == []

import random
import re

from pyspark.sql import functions as F

from kerbline.llm import licenses


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_base(text):
    w, places, labels = words(text), [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for i in range(len(w)):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def check_spans(phrase, row, found):
    """The spans are in order and apart, their errors are true, and between them lies no part of row within the errors."""
    most, at = len(phrase) // licenses.ERROR_EACH, 0
    raw = row.encode()
    for lo, hi, errors in [*found, (len(raw), len(raw), None)]:
        assert at <= lo <= hi
        gap = raw[at:lo].decode()
        assert all(distance(phrase, gap[i : i + n]) > most for i in range(len(gap)) for n in range(len(phrase) - most, len(phrase) + most + 1) if i + n <= len(gap))
        if errors is not None:
            assert distance(phrase, raw[lo:hi].decode()) == errors <= most
        at = hi


def test_spans_that_stand_close_together():
    for text, phrase in (("under the mti license and under the mit license", "under the mit license"), ("gnu generel public license gnu general public license", "gnu general public license")):
        found = licenses.Notice(phrase, "x").spans(f" {text} ".encode())
        check_spans(phrase, f" {text} ", found)
        assert len(found) == 2
    rng = random.Random(3)
    for phrase in ("all rights reserved", "under the mit license", "gnu lesser general public license"):
        for _ in range(60):
            row = " "
            for _ in range(rng.randrange(1, 5)):
                x = list(phrase)
                for _ in range(rng.randrange(4)):
                    p = rng.randrange(len(x))
                    x[p : p + rng.randrange(2)] = rng.choice(["", "é", "e", " "])
                row += "".join(x) + rng.choice(["", " ", " and "])
            check_spans(phrase, row, licenses.Notice(phrase, "x").spans(row.encode()))


def test_scan(spark):
    rng = random.Random(1)
    pool = ["Under the MIT License", "under the mit-licence", "Apache License, Version 2", "cc by nc", "CC BY-NC cc by nc", "gnu generel public license", "été", "the", "mit", "under", "all rights resreved", "a7é", "_", "ÀB"]
    rows = [(k, " ".join(rng.choice(pool) + rng.choice(["", ".", "\n", ","]) for _ in range(rng.randrange(25)))) for k in range(120)]
    rows += [(900, None), (901, ""), (902, "... \x00"), (None, "cc by nc"), (3, rows[3][1]), (903, "word " * 200_000 + "UNDER THE MIT LICENSE"), (904, "é" * 50 + " gnu général public license " + "日本" * 30), (905, "clean text about the licence of a driver and public rights")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = sorted(licenses.scan_licenses(df).collect(), key=lambda r: (str(r.doc_id), r.n_words))
    assert len(got) == len(rows)
    for r, (_, text) in zip(got, sorted(rows, key=lambda x: (str(x[0]), len(words(x[1])))), strict=True):
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(text)
        w = words(text)
        row, near = " ".join(w), set(r.base_labels.split(",")) - {""}
        for s in r.spans:
            near.add(s.label)
            assert 0 <= s.first_word <= s.last_word < len(w)
        assert r.labels == ",".join(sorted(near)) and 0 <= r.score <= 1
        if len(w) < 12:
            for phrase, label in licenses.NOTICES.items():
                check_spans(phrase, row, licenses.Notice(phrase, label).spans(row.encode()))
    by = {r.doc_id: r for r in got}
    assert "gpl" in by[904].labels and by[905].labels == "" and by[905].score == 0
    assert by[903].spans[0].first_word == 200_000 and by[903].spans[0].last_word == 200_003
    assert licenses.scan_licenses(df.limit(0)).collect() == []

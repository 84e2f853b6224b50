import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kerbline.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_assign_fills_every_sequence():
    rng = random.Random(1)
    for n in (0, 1, 5, 300):
        lengths = [rng.choice([1, 3, 40, 200, 2047, 2048, 5000]) for _ in range(n)]
        pieces, left = packing.assign(lengths)
        assert left == []
        of_doc, of_sequence = defaultdict(list), defaultdict(list)
        for d, start, size, s, offset in pieces:
            of_doc[d].append((start, size))
            of_sequence[s].append((offset, size))
        for d, size in enumerate(lengths):
            at = 0
            for start, m in sorted(of_doc[d]):
                assert start == at and m > 0
                at += m
            assert at == size
        filled = []
        for own in of_sequence.values():
            at = 0
            for offset, m in sorted(own):
                assert offset == at
                at += m
            filled.append(at)
        assert all(x == 2048 or x & (x - 1) == 0 for x in filled) and sum(x < 2048 for x in filled) <= 11
        pieces, left = packing.assign(lengths, last=False)
        assert sum(p[2] for p in pieces) % 2048 == 0 and sum(p[2] for p in pieces) + sum(lengths[d] - s for d, s in left) == sum(lengths)


def test_costs_are_closer_than_longest_first_in_a_row():
    rng = random.Random(2)
    lengths = [rng.randrange(10, 700) for _ in range(4000)]

    def spread(pieces):
        cost, size = defaultdict(float), defaultdict(int)
        for _, _, n, s, _ in pieces:
            cost[s] += packing.LINEAR * n + packing.QUADRATIC * n * n
            size[s] += n
        return np.std([c for s, c in cost.items() if size[s] == 2048])

    def in_a_row(order):
        at, out = 0, []
        for d, n in enumerate(order):
            while n:
                m = min(n, 2048 - at % 2048)
                out.append((d, 0, m, at // 2048, 0))
                at, n = at + m, n - m
        return spread(out)

    assert spread(packing.assign(lengths)[0]) < 0.7 * in_a_row(lengths)


def plain(lengths, length=2048):
    """Each rest of a document, longest first, to the first of the sequences of lowest cost with room."""
    full, rest = divmod(sum(lengths), length)
    sizes = [length] * full + [1 << b for b in reversed(range(12)) if rest >> b & 1]
    whole = sum(n // length for n in lengths)
    held = {k: [length - sizes[k], 0.0] for k in range(whole, len(sizes))}
    cost = {k: packing.LINEAR * held[k][0] for k in held}
    out, k = [], 0
    for d, n in enumerate(lengths):
        for start in range(0, n - n % length, length):
            out.append((d, start, length, k, 0))
            k += 1
    for n, d in sorted(((n % length, d) for d, n in enumerate(lengths) if n % length), key=lambda x: (-x[0], x[1])):
        start = lengths[d] - n
        while n:
            room = {k: length - h[0] for k, h in held.items()}
            some = [k for k in held if room[k] >= n] or [k for k in held if room[k]]
            k = min(some, key=lambda k: (cost[k], k))
            m = min(n, room[k])
            out.append((d, start, m, k, sizes[k] - room[k]))
            held[k][0] += m
            cost[k] += packing.LINEAR * m + packing.QUADRATIC * m * m
            n, start = n - m, start + m
    return out


def test_assign_equals_a_plain_version():
    rng = random.Random(4)
    for n in (1, 7, 120, 400):
        for high in (60, 900, 2048, 5000):
            lengths = [rng.choice([rng.randrange(1, high), 33]) for _ in range(n)]  # with ties
            assert packing.assign(lengths)[0] == plain(lengths)


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "WINDOW", 20_000)
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices(["the", "queeaux", "42", "Übung."], k=rng.randrange(0, 700)))) for k in range(120)]
    rows += [(900, None), (901, ""), (902, "very long " * 30_000), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("offset", F.lit("clash")).repartition(2)
    got = packing.pack(df, PATH, end=1).collect()
    tokenizer = Tokenizer.from_file(PATH)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for k, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by[k], key=lambda r: r.start):
            own = ids[r.start : r.start + r.length]
            assert (r.start, r.doc_tokens, r.ids_crc32, list(r.ids)) == (at, len(ids), zlib.crc32(own.tobytes()), own.tolist())
            at += r.length
        assert at == len(ids)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048 and (at & (at - 1)) == 0
    assert packing.pack(df.limit(0), PATH, end=1).collect() == []

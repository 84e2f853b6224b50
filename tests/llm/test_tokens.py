import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kerbline.llm import tokens
from kerbline.llm.common import scratch

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "don't I'M you'LL  x y　z", "<|endoftext|> a<|startoftext|>b <|end", "Éa ÉÀ éa İstanbul ŒUVRE ß ﬁ Ǆ ǅ ²³ Ⅷ ΣΑΣ", "\x1c\x1f\x85 ​\x00a\x7fb", "日本語 한국어 العربية 😀👍🏽 ä", "x" * 5000, "a_b-c'd''s 12,345.67 $$$***­·", "ı K Å ΐ ŉ ǰ", "퟿�"]


def texts(n=400, seed=1):
    rng = random.Random(seed)
    pool = ["the", "Thing,", "naïve", "Übung.", "it's", "42", "***", "queeaux", *ODD]
    return [*ODD, *("".join(rng.choice(pool) + rng.choice([" ", "\n", "\t", "  ", " ", ""]) for _ in range(rng.randrange(30))) for _ in range(n))]


def plain(rows, end):
    t = Tokenizer.from_file(PATH)
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for x in rows]


def test_encoder_equals_the_library():
    rows = [None, *texts()]
    encoder = tokens.Encoder(PATH)
    assert encoder.direct
    for _ in range(2):
        ids, lengths = encoder([None if r is None else r.encode() for r in rows], 2)
        for got, want in zip(np.split(ids, np.cumsum(lengths)[:-1]), plain(rows, 2), strict=True):
            assert got.tolist() == want.tolist()
    other = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.direct and other([b"a  b", None], 7)[1].tolist() == [4, 1]


def test_case_is_folded_only_where_no_id_changes():
    rows = ["H\u0331 h\u0331 THE", "İ I\u0307 É E\u0301", "A <|ENDOFTEXT|> <|endoftext|> B", "ÀÉ THE Ÿ", "ΣΑΣ A", "Kelvin \u212a K—K"]
    ids, lengths = tokens.Encoder(PATH)([r.encode() for r in rows], 2)
    for got, want in zip(np.split(ids, np.cumsum(lengths)[:-1]), plain(rows, 2), strict=True):
        assert got.tolist() == want.tolist()


def test_encoder_equals_the_library_while_it_forgets(monkeypatch):
    monkeypatch.setattr(tokens, "_KEPT", 3000)
    rng = random.Random(3)
    rows = [" ".join(rng.choice(["the", "Of,", "naïve", "".join(rng.choices("abcdeé", k=6))]) for _ in range(20)) for _ in range(60)]
    encoder, held = tokens.Encoder(PATH), []
    for lo in range(0, len(rows), 5):
        ids, lengths = encoder([r.encode() for r in rows[lo : lo + 5]], 2)
        for got, want in zip(np.split(ids, np.cumsum(lengths)[:-1]), plain(rows[lo : lo + 5], 2), strict=True):
            assert got.tolist() == want.tolist()
        held.append(encoder.n)
    assert any(b < a for a, b in zip(held, held[1:])) and b"the" in encoder.number


@pytest.mark.parametrize("bits", [1, 7, 16, 31, 60, 64])
def test_words_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 59, 1024, 1025, 5000):
        ids = rng.integers(0, 2**bits - 1, n, dtype=np.uint64, endpoint=True) >> rng.integers(0, bits, n).astype(np.uint64)
        words, first = tokens.encode_ids(ids)
        assert (tokens.decode_words(words) == ids).all() and len(first) == -(-n // tokens.BLOCK)
        for b, lo in enumerate(first):
            hi = first[b + 1] if b + 1 < len(first) else len(words)
            assert (tokens.decode_words(words[lo:hi]) == ids[b * tokens.BLOCK : (b + 1) * tokens.BLOCK]).all()


def test_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(tokens, "_FLUSH", 3000)
    rows = [(k, t) for k, t in enumerate(texts(60, 2))]
    rows += [(3, "again"), (3, None), (None, "no id"), (900, None), (901, "long words " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash")).repartition(3)
    files = tokens.write_ids(df, scratch(spark, "t"), PATH, 2)
    got = tokens.read_ids(files).orderBy("start").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for r, (k, _), ids in zip(got, want, plain([t for _, t in want], 2), strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, list(r.ids)) == (k, start, len(ids), zlib.crc32(ids.tobytes()), ids.tolist())
        start += len(ids)


def test_empty_table_and_damage(spark):
    files = tokens.write_ids(spark.createDataFrame([], "doc_id long, text string"), scratch(spark, "t"), PATH, 2)
    assert tokens.read_ids(files).collect() == []
    with pytest.raises(ValueError):
        list(tokens.read_file(io.BytesIO(b"x" * 100)))

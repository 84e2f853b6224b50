import random
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from kerbline.llm import langid

from .test_decontamination import brute as passages
from .test_langid import texts
from .test_simhash import brute as duplicates


def test_run_equals_brute_force(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, t * 3, lang, "s", 1) for k, lang, t in texts(150, 8)]
    items = [(k, " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(20))) for k in range(5)]
    rows += [(200 + k, f"{rows[k][1]} {items[k % 5][1]} {rows[k + 1][1]}", "en", "s", 1) for k in range(10)]
    rows += [(300 + k, rows[k][1], rows[k][2], "s", 1) for k in range(10)]
    rows += [(400, None, "en", "s", 1), (401, "... 123", "en", None, None), (402, "жщъ " * 60, None, "s", 1), (None, rows[3][1], "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    assert kept.schema == docs.schema
    left = [(r.doc_id, r.text) for r in kept.collect()]
    gone = {r[0] for r in rows} - {k for k, _ in left}
    assert {400, 401, 402} == gone
    by = {int(k): (k, c) for k, _, c in duplicates([x for x in left if x[0] is not None], 5, 7)}
    left = [x for x in left if x[0] is None or by[x[0]][0] == by[x[0]][1]]
    found = {d for d, _ in passages([x for x in left if x[0] is not None], items)}
    assert len(found) == 10
    left = [x for x in left if x[0] is None or x[0] not in found]

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {k: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for k, t in left}
    got, sequences = defaultdict(int), defaultdict(int)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id] += r.length
        sequences[r.sequence_id] += r.length
        assert r.doc_tokens == want[r.doc_id]
    assert got == want and max(sequences.values()) <= 2048
    assert langid.UND == "und"


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []

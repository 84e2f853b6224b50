"""Language ID by interpolated Kneser-Ney character models, one per language.

Words (letters with their marks, in lower case, with a start and an end sign) are modelled one by one, so a text's
cross-entropy is the sum over its words divided by the number of characters predicted, and a word's value can be kept
while a task meets it again. Each language's n-grams lie in sorted arrays of 64-bit hashes in the shared folder, which
workers memory-map. The language with the lowest length-normalised cross-entropy wins. Rejection is calibrated on
labelled texts that were not counted: a text of at least MIN_CHARS characters is rejected where even its best
cross-entropy lies further beyond the 99.5 % quantile than that lies beyond the median.

The model is fitted on a bounded sample: max_docs labelled texts of each language, those whose hashed ids come first, a
sixth of them for calibration. Texts are used whole, in fitting as in prediction.

Defined cases: null texts and texts without a letter get 'und' with score 0 and are rejected; a tie goes to the language
that sorts first; without any labelled text every prediction is 'und'; null ids and repeated rows each keep their row;
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_pieces, map_file, put_file, released, scratch, small_batches, texts, written

ORDER = 4
MAX_DOCS = 3000
MIN_CHARS = 40
KEPT = 200_000
LEARNT = 8192
UND = "und"
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * _A
    h = (h ^ (h >> np.uint64(27))) * _B
    return h ^ (h >> np.uint64(31))


def gram_hashes(words: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(word, place, hashes): for each character and end sign of the words its word, its place from 1, and by n the hash of the n characters up to it.

    Where fewer than n are there (the start sign is one), the hash is 0.
    """
    marked = ["\x02" + w + "\x03" for w in words]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    chars = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    word = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(chars)) - np.repeat(np.cumsum(size) - size, size)
    out, h = [], np.zeros(len(chars), np.uint64)
    for n in range(1, order + 1):
        h = np.concatenate([np.zeros(1, np.uint64), h[:-1]]) * _BASE + chars
        out.append(np.where(place >= n - 1, mixed(h + np.uint64(n)), np.uint64(0)))
    seen = place > 0
    return word[seen], place[seen], [x[seen] for x in out]


def context_hashes(words: list[str], order: int = ORDER) -> list[np.ndarray]:
    """By n from 2, the hash of the n - 1 characters before each place of gram_hashes."""
    marked = ["\x02" + w + "\x03" for w in words]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    chars = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    place = np.arange(len(chars)) - np.repeat(np.cumsum(size) - size, size)
    out, h = [], np.zeros(len(chars), np.uint64)
    for n in range(1, order):
        h = np.concatenate([np.zeros(1, np.uint64), h[:-1]]) * _BASE + chars
        x = np.where(place >= n - 1, mixed(h + np.uint64(n)), np.uint64(0))
        out.append(np.concatenate([np.zeros(1, np.uint64), x[:-1]])[place > 0])
    return out


@dataclass
class Model:
    """Where the arrays of each language lie. counts: by language, the sizes of (gram, context) arrays; bases: (1 - mass to share out, uniform share)."""

    languages: list[str]
    order: int
    files: list[str]
    sizes: list[tuple[int, int]]
    uniform: float
    beta: float = 8.0
    limit: float = float("inf")

    def arrays(self) -> list[tuple[np.ndarray, ...]]:
        out = []
        for path, (g, c) in zip(self.files, self.sizes, strict=True):
            out.append((map_file(path, np.uint64, g), map_file(path, np.float64, g, 8 * g), map_file(path, np.uint64, c, 16 * g), map_file(path, np.float64, c, 16 * g + 8 * c)))
        return out


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, else_: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), else_)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], else_)


def word_scores(model: Model, arrays: list, words: list[str]) -> np.ndarray:
    """A row for each word: minus its natural log probability by language, then the number of characters predicted."""
    out = np.zeros((len(words), len(arrays) + 1))
    if not words:
        return out
    word, place, grams = gram_hashes(words, model.order)
    # words share most of their n-grams: each is looked up once; of the empty context (n = 1) the key is 0
    asked = [pd.factorize(x) for x in grams]
    before = [pd.factorize(x) for x in [np.zeros(len(word), np.uint64), *context_hashes(words, model.order)]]
    for k, (keys, share, contexts, left) in enumerate(arrays):
        p = np.full(len(word), model.uniform)
        for n in range(1, model.order + 1):
            (gram_at, gram), (context_at, context) = asked[n - 1], before[n - 1]
            rest = _found(contexts, left, context, 1.0)[context_at]
            p = np.where(place >= n - 1, _found(keys, share, gram, 0.0)[gram_at] + rest * p, p)
        out[:, k] = np.bincount(word, -np.log(p), len(words))
    out[:, -1] = np.bincount(word, minlength=len(words))
    return out


def estimate(grams: np.ndarray, contexts: np.ndarray, order_of: np.ndarray, counts: np.ndarray, uniform: float) -> tuple[np.ndarray, ...]:
    """Sorted (gram keys, discounted shares, context keys, shares left over) from the adjusted counts of one language."""
    keys, shares, where, left = [], [], [], []
    for n in np.unique(order_of):
        at = order_of == n
        c, ctx = counts[at].astype(np.float64), contexts[at]
        ones, twos = (c == 1).sum(), (c == 2).sum()
        d = ones / (ones + 2 * twos) if ones else 0.5
        known, inverse = np.unique(ctx, return_inverse=True)
        total, kinds = np.bincount(inverse, c), np.bincount(inverse)
        keys.append(grams[at])
        shares.append((c - d) / total[inverse])
        where.append(known)
        left.append(d * kinds / total)
    keys, shares, where, left = (np.concatenate(x) for x in (keys, shares, where, left))
    a, b = np.argsort(keys), np.argsort(where)
    return keys[a], shares[a], where[b], left[b]


def _count(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """From (lang, word, n): the n-grams of the words with their counts, and the sign or letter to the left of each."""
    released()
    for batch in batches:
        langs, words, times = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_numpy()
        for lang in sorted(set(langs)):
            own = [i for i, x in enumerate(langs) if x == lang]
            some, n_of = [words[i] for i in own], times[own]
            word, place, grams = gram_hashes(some, order)
            before = context_hashes(some, order)
            for n in range(1, order + 1):
                there = place >= n - 1
                ctx = (before[n - 2] if n > 1 else np.zeros(len(word), np.uint64))[there]
                g = grams[n - 1][there]
                # one that begins a word has nothing to its left and counts as often as it occurs, as the longest do
                longer = grams[n][there] if n < order else np.zeros(len(g), np.uint64)
                c = n_of[word[there]]
                rows = np.stack([g, ctx, longer], axis=1)
                rows, inverse = np.unique(rows, axis=0, return_inverse=True)
                total = np.bincount(inverse.reshape(-1), c).astype(np.int64)
                m = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * m), pa.array(np.full(m, n, np.int32)), *(pa.array(rows[:, j].view(np.int64)) for j in range(3)), pa.array(total)], names=["lang", "n", "gram", "context", "longer", "times"])


def sample(labelled: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(lang, text, rank): of each language, the max_docs texts whose hashed ids come first, from columns id, lang, text."""
    some = labelled.where("text is not null and lang is not null").withColumn("h", F.xxhash64(F.col("id").cast("string")))
    counts = {r.lang: r["count"] for r in some.groupBy("lang").count().collect()}  # a row per language
    if not counts:
        return some.select("lang", "text", F.lit(1).alias("rank")).limit(0)
    # enough below this share of the hashes, all but surely; else all
    share = {k: min(1.0, 2 * max_docs / n + 100 / n) for k, n in counts.items()}
    below = {k: int((s - 0.5) * 2**64) if s < 1 else 2**63 - 1 for k, s in share.items()}
    cut = F.create_map(*[x for k, h in below.items() for x in (F.lit(k), F.lit(h).cast("long"))])
    some = some.where(F.col("h") <= F.element_at(cut, F.col("lang")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id", "text"))
    return some.withColumn("rank", rank).where(F.col("rank") <= max_docs).select("lang", "text", "rank")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    released()
    for batch in in_pieces(batches, 2 << 20):
        counts: dict[tuple[str, str], int] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for w in _LETTERS.findall(text.lower()):
                counts[lang, w] = counts.get((lang, w), 0) + 1
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts]), pa.array([k[1] for k in counts]), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "times"])


def fit(labelled: DataFrame, order: int = ORDER, max_docs: int = MAX_DOCS) -> Model:
    """A model of the languages in labelled (columns id, lang, text)."""
    spark = labelled.sparkSession
    some = written(sample(labelled, max_docs), scratch(spark, "langid-sample"))
    words = some.where("rank % 6 <> 0 or rank < 6").select("lang", "text").mapInArrow(_pieces, "lang string, word string, times long").groupBy("lang", "word").agg(F.sum("times").alias("times"))
    rows = words.mapInArrow(partial(_count, order=order), "lang string, n int, gram long, context long, longer long, times long")
    rows = rows.groupBy("lang", "n", "gram", "context", "longer").agg(F.sum("times").alias("times"))
    grams = rows.groupBy("lang", "n", "gram", "context").agg(F.when((F.col("n") == order) | (F.max(F.col("longer") == 0)), F.sum("times")).otherwise(F.count("*")).alias("c"))
    grams = written(grams, scratch(spark, "langid-grams"))
    uniform = 1 / (1 + grams.where("n = 1").select("gram").distinct().count())
    folder = scratch(spark, "langid-model")

    def language(table: pa.Table) -> pa.Table:
        """The arrays of one language, whose n-grams the sample bounds."""
        lang = table.column("lang")[0].as_py()
        n, gram, context, c = (table.column(x).to_numpy() for x in ("n", "gram", "context", "c"))
        arrays = estimate(gram.view(np.uint64), context.view(np.uint64), n, c, uniform)
        path = f"{folder}/{xxhash.xxh3_64_hexdigest(lang.encode())}.bin"
        put_file(path, [x.tobytes() for x in arrays])
        return pa.table({"lang": [lang], "path": [path], "grams": pa.array([len(arrays[0])], pa.int64()), "contexts": pa.array([len(arrays[2])], pa.int64())})

    made = written(grams.groupBy("lang").applyInArrow(language, "lang string, path string, grams long, contexts long"), scratch(spark, "langid-made")).collect()  # a row per language
    made.sort(key=lambda r: r.lang)
    languages = [r.lang for r in made]
    model = Model(languages, order, [r.path for r in made], [(r.grams, r.contexts) for r in made], uniform)
    if not languages:
        return model
    held = some.where("rank % 6 = 0").select(F.lit(0).cast("long").alias("id"), "text", "lang").mapInArrow(partial(_predict, model=model, entropies=True), "lang string, entropy array<double>, n_chars long")
    told = held.where(F.col("n_chars") >= MIN_CHARS).toArrow()  # bounded by the sample
    if told.num_rows:
        e = np.array(told.column("entropy").to_pylist())
        right = np.array([languages.index(x) if x in languages else -1 for x in told.column("lang").to_pylist()])
        e, right = e[right >= 0], right[right >= 0]
    if told.num_rows and len(e):
        best = e.min(axis=1)
        high, middle = np.quantile(best, 0.995), np.quantile(best, 0.5)
        model.limit = float(high + max(high - middle, 0.1))

        def loss(beta: float) -> float:
            z = -beta * (e - best[:, None])
            return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(e)), right]).mean())

        model.beta = min((float(2**k) for k in range(-1, 7)), key=loss)
    return model


def _predict(batches: Iterator[pa.RecordBatch], model: Model, entropies: bool = False, pieces=partial(in_pieces, budget=2 << 20)) -> Iterator[pa.RecordBatch]:
    released()
    arrays, width = model.arrays(), len(model.languages)
    rows_of: dict[str, int] = {}  # by what stands between blanks
    table, met = np.zeros((0, width + 1)), np.zeros(0, np.int64)  # met: how often, halved whenever rows are forgotten

    def forget() -> None:
        """Keeps the more frequent half of the rows, of those met more than once."""
        nonlocal rows_of, table, met
        often = np.argsort(-met, kind="stable")[: len(met) // 2]
        keep = np.sort(often[met[often] > 1])
        names = list(rows_of)
        rows_of = {names[k]: i for i, k in enumerate(keep.tolist())}
        table, met = table[keep], met[keep] // 2

    def learn(tokens: list[str]) -> np.ndarray:
        """Rows for tokens not met before: the sum over the words in each."""
        nonlocal table
        parts = [_LETTERS.findall(t) for t in tokens]
        own = sorted({w for p in parts for w in p})
        place = {w: i for i, w in enumerate(own)}
        values = word_scores(model, arrays, own)
        owner = np.repeat(np.arange(len(tokens)), [len(p) for p in parts])
        which = np.fromiter((place[w] for p in parts for w in p), np.int64, len(owner))
        return np.stack([np.bincount(owner, values[which, k], len(tokens)) for k in range(width + 1)], axis=1)

    for batch in pieces(batches):
        texts = batch.column(1).to_pylist()
        tokens = [t.lower().split() if t else [] for t in texts]
        fresh = list({w for t in tokens for w in t if w not in rows_of})
        if rows_of and len(rows_of) + len(fresh) > KEPT:
            forget()
            fresh = list({w for t in tokens for w in t if w not in rows_of})
        if fresh:
            rows_of.update(zip(fresh, range(len(table), len(table) + len(fresh)), strict=True))
            table = np.concatenate([table, *(learn(fresh[k : k + LEARNT]) for k in range(0, len(fresh), LEARNT))])
            met = np.concatenate([met, np.zeros(len(fresh), np.int64)])
        total = np.zeros((len(texts), width + 1))
        for i, t in enumerate(tokens):
            if t:
                at = np.fromiter(map(rows_of.__getitem__, t), np.int64, len(t))
                np.add.at(met, at, 1)
                total[i] = table[at].sum(axis=0)
        chars = total[:, -1]
        e = total[:, :-1] / np.maximum(chars, 1)[:, None]
        if entropies:
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(list(e), pa.list_(pa.float64())), pa.array(chars.astype(np.int64))], names=["lang", "entropy", "n_chars"])
            continue
        none = (chars == 0) | (width == 0)
        if width:
            best = e.argmin(axis=1)
            lowest = e[np.arange(len(e)), best]
            score = np.where(none, 0.0, 1 / np.exp(-model.beta * (e - lowest[:, None])).sum(axis=1))
        else:
            best, lowest, score = np.zeros(len(e), int), np.zeros(len(e)), np.zeros(len(e))
        lang = [UND if x else model.languages[b] for x, b in zip(none, best, strict=True)]
        rejected = none | ((chars >= MIN_CHARS) & (lowest > model.limit))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(lowest), pa.array(rejected)], names=["id", "lang_pred", "score", "entropy", "rejected"])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, entropy, rejected) for each row of docs."""
    rows = texts(docs, id_col, text_col)
    return rows.mapInArrow(partial(_predict, model=model), "id long, lang_pred string, score double, entropy double, rejected boolean")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text the model doesn't reject."""
    small_batches(docs.sparkSession)
    names = docs.columns
    i = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def own() -> Iterator[pa.RecordBatch]:
            for batch in in_pieces(batches, 2 << 20):
                held.append(batch)
                yield pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(i)], names=["id", "text"])

        for told in _predict(own(), model, pieces=iter):
            yield held.pop().filter(pa.array([not x for x in told.column(4).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

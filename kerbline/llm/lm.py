"""Perplexity by an interpolated modified Kneser-Ney model of order 2 or 3, counted in Spark and memory-mapped by workers.

Three passes over the corpus, each aggregating within a task before anything is shuffled: words, bigrams, scores.
Word hashes lie in sorted shards, a word's number is its place in them; a bigram's key is a bijective scramble of the
two numbers, so keys are exact and again lie in sorted shards. From each bigram shard come partial statistics (bigrams
ended by a word, bigrams and occurrences a word begins, by how often they occur), which a second small shuffle sums up.
A frequent word spreads over all bigram shards. Workers map the shards that a block asks for, at most OPEN at once, and look
up its distinct keys in order. Counts take a byte; those that don't fit stand in a second, sorted list, in 64 bits.

Of order 3, a fourth pass counts trigrams. A bigram's number is its place, a trigram's key are the place of its first bigram
in its shard (24 bits) and the number of its second one (40 bits); it lies in the shard of the first, its context, in order. There the context's statistics are counted,
and from there a shuffle tells every bigram how many different words come before it, which its order is estimated from.

The lower order is estimated from the number of different words before a word; the model gives the unseen word
1 / (V + 1) of the mass that the lower order leaves. Discounts are D1, D2 and D3+ of each order from counts of counts;
where these are missing (tiny corpora) a discount falls back to half its count.

Defined cases: a null or empty text is its end alone; a context that never occurred gives the lower order; without any
training text every probability is 1; a null id is never held out and is learned from; repeated rows count as often as
they occur; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binaries, by_size, delete, in_pieces, map_file, put_file, released, scratch, shards, texts, trimmed, words_of, written

TOKENS = 500_000
BYTES = 4 << 20
END = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))  # not a word: words hold no line break
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
NONE = np.int64(-1)
OPEN = 2048
PAIR = np.uint64(40)
#: Shards by input are so many times as many as elsewhere: a task sorts a shard's keys, about 80 bytes each with copies.
FINER = 8


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def _unshifted(x: np.ndarray, by: int) -> np.ndarray:
    out = x
    for _ in range(64 // by):
        out = x ^ (out >> np.uint64(by))
    return out


def unscrambled(x: np.ndarray) -> np.ndarray:
    x = _unshifted(x, 31) * np.uint64(pow(int(_B), -1, 1 << 64))
    x = _unshifted(x, 27) * np.uint64(pow(int(_A), -1, 1 << 64))
    return _unshifted(x, 30)


def shard_of(h: np.ndarray, n: int) -> np.ndarray:
    """By the leading bits, so that shards are ranges of the hashes."""
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def packed(counts: np.ndarray) -> tuple[list[bytes], int]:
    """(bytes of counts as a column of kind "count", how many of them don't fit a byte)."""
    large = np.flatnonzero(counts >= 255)
    return [np.minimum(counts, 255).astype(np.uint8).tobytes(), large.astype(np.int64).tobytes(), counts[large].astype(np.int64).tobytes()], len(large)


class Counts:
    """A column of kind "count"."""

    def __init__(self, small: np.ndarray, places: np.ndarray, large: np.ndarray) -> None:
        self.small, self.places, self.large = small, places, large

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        out = self.small[at].astype(np.int64)
        big = np.flatnonzero(out == 255)
        if len(big):
            out[big] = self.large[np.searchsorted(self.places, at[big])]
        return out


class Opened:
    """The arrays of each shard, mapped when they are asked for; of those not asked for lately, few stay mapped."""

    def __init__(self, shards: Shards) -> None:
        self.shards, self.held = shards, OrderedDict()

    def __len__(self) -> int:
        return len(self.shards.sizes)

    def __getitem__(self, shard: int) -> list:
        if shard not in self.held:
            self.held[shard] = self.shards.arrays(shard)
            if len(self.held) > OPEN:
                self.held.popitem(last=False)
        self.held.move_to_end(shard)
        return self.held[shard]


@dataclass
class Shards:
    """Columns of equal length in one file for each shard, one after another; of kind "count" the last one may be.

    large: of each shard, how many counts don't fit a byte.
    """

    folder: str
    sizes: list[int]
    kinds: list[str]
    large: list[int] | None = None
    starts: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)

    @property
    def total(self) -> int:
        return int(self.starts[-1])

    def arrays(self, shard: int) -> list:
        n, m = self.sizes[shard], self.large[shard] if self.large else 0
        width = sum(1 if kind == "count" else np.dtype(kind).itemsize for kind in self.kinds)
        whole, out, at = map_file(f"{self.folder}/{shard:06d}.bin", np.uint8, n * width + 16 * m), [], 0
        for kind in self.kinds:
            size = n * (1 if kind == "count" else np.dtype(kind).itemsize)
            part = whole[at : at + size]
            at += size
            if kind == "count":
                out.append(Counts(part, whole[at : at + 8 * m].view(np.int64), whole[at + 8 * m : at + 16 * m].view(np.int64)))
            else:
                out.append(part.view(kind))
        return out

    def open(self) -> Opened:
        return Opened(self)


def _runs(bounds: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) of the shards that something is asked of; bounds: the first place of each, then the end."""
    for k in np.flatnonzero(np.diff(bounds)).tolist():
        yield k, int(bounds[k]), int(bounds[k + 1])


def _sought(opened: Opened, starts: np.ndarray, keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out = np.full(len(keys), NONE)
    for k, lo, hi in _runs(bounds):
        have = opened[k][0]
        if len(have):
            at = np.minimum(np.searchsorted(have, keys[lo:hi]), len(have) - 1)
            out[lo:hi] = np.where(have[at] == keys[lo:hi], at + starts[k], NONE)
    return out


def places(opened: Opened, starts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place over all shards of each of the sorted keys, or NONE."""
    return _sought(opened, starts, keys, np.searchsorted(shard_of(keys, len(opened)), np.arange(len(opened) + 1)))


def taken(opened: Opened, starts: np.ndarray, at: np.ndarray, column: int) -> np.ndarray:
    """Values of a column at sorted places."""
    parts = [opened[k][column][at[lo:hi] - starts[k]] for k, lo, hi in _runs(np.searchsorted(at, starts))]
    return np.concatenate(parts) if parts else np.zeros(0)


def trigram_keys(context: np.ndarray, pair: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shard, key) of trigrams by the numbers of their bigrams. The sign before a text has the number behind all others, and is in the last shard."""
    shard = np.minimum(np.searchsorted(starts, context, side="right") - 1, len(starts) - 2)
    return shard, ((context - starts[shard]).astype(np.uint64) << PAIR) | pair.astype(np.uint64)


def distinct(shard: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shards, keys, counts, place of each in them) of the different pairs, sorted."""
    order = np.lexsort((key, shard))
    shard, key = shard[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (shard[1:] != shard[:-1])
    at = np.flatnonzero(new)
    back = np.empty(len(key), np.int64)
    back[order] = np.cumsum(new) - 1
    return shard[at], key[at], np.diff(np.append(at, len(key))), back


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(ids, tokens by text, hashes): of whole texts, a block's worth at a time; a longer text is a block of its own."""
    released()
    ids, sizes, parts, n, size = [], [], [], 0, 0
    digest = xxhash.xxh3_64_intdigest
    for batch in in_pieces(batches, 1 << 20):
        for k, text in zip(batch.column(0).to_pylist(), binaries(batch, 1), strict=True):
            words = words_of(text)
            h = np.empty(len(words) + 1, np.uint64)
            h[:-1] = np.fromiter(map(digest, words), np.uint64, len(words))
            h[-1] = END
            ids.append(k)
            sizes.append(len(h))
            parts.append(h)
            n, size = n + len(h), size + len(text or b"")
            if n >= TOKENS or size >= BYTES:
                yield ids, np.array(sizes), np.concatenate(parts)
                ids, sizes, parts, n, size = [], [], [], 0, 0
    if ids:
        yield ids, np.array(sizes), np.concatenate(parts)
    trimmed()


def coded(keys: np.ndarray) -> bytes:
    """Sorted keys as byte planes, steps of the upper halves and then the lower halves: what the shuffle compresses well."""
    high, low = (keys >> np.uint64(32)).astype(np.uint32), keys.astype(np.uint32)
    steps = np.diff(high, prepend=np.uint32(0)).astype(np.uint32)
    return planes(steps) + planes(low)


def planes(x: np.ndarray) -> bytes:
    """32-bit numbers, the lowest byte of all first."""
    return np.ascontiguousarray(np.ascontiguousarray(x, np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()


def unplaned(data: bytes | pa.Buffer) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.uint32).reshape(-1)


def uncoded(data: bytes | pa.Buffer) -> np.ndarray:
    steps, low = unplaned(data[: len(data) // 2]), unplaned(data[len(data) // 2 :])
    return (np.cumsum(steps, dtype=np.uint64) << np.uint64(32)) | low.astype(np.uint64)


def _sent(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray, n: int) -> pa.RecordBatch:
    """A row for each shard that gets something."""
    order = np.argsort(shard, kind="stable")
    keys, counts, shard = keys[order], counts[order], shard[order]
    bounds = np.searchsorted(shard, np.arange(n + 1))
    to = [k for k in range(n) if bounds[k] < bounds[k + 1]]
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([coded(keys[bounds[k] : bounds[k + 1]]) for k in to], pa.binary()), pa.array([counts[bounds[k] : bounds[k + 1]].tobytes() for k in to], pa.binary())], names=["shard", "keys", "counts"])


_SENT = "shard int, keys binary, counts binary"


def _gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The different keys sent to a shard, and the sums of their counts; read from the table's own memory, each array once."""
    trimmed()
    sizes = [len(x.as_buffer()) // 4 for x in table.column("counts")]
    ends = np.cumsum(sizes)
    keys, counts = np.empty(sum(sizes), np.uint64), np.empty(sum(sizes), np.uint32)
    for k, c, n, end in zip(table.column("keys"), table.column("counts"), sizes, ends, strict=True):
        keys[end - n : end], counts[end - n : end] = uncoded(k.as_buffer()), np.frombuffer(c.as_buffer(), np.uint32)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    del order
    at = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    return keys[at], np.add.reduceat(counts, at, dtype=np.int64) if len(at) else counts.astype(np.int64)


def _words(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for _, _, h in blocks(batches):
        keys, counts = np.unique(h, return_counts=True)
        yield _sent(keys, counts.astype(np.uint32), shard_of(keys, n).astype(np.int64), n)


def _numbers(opened: Opened, starts: np.ndarray, h: np.ndarray) -> np.ndarray:
    keys, inverse = np.unique(h, return_inverse=True)
    return places(opened, starts, keys)[inverse]


def _previous(ids: np.ndarray, sizes: np.ndarray, begin: int) -> np.ndarray:
    """The word before each token; begin before a text's first."""
    before = np.concatenate([[begin], ids[:-1]])
    before[np.cumsum(sizes)[:-1]] = begin
    return before


def _bigrams(batches: Iterator[pa.RecordBatch], vocabulary: Shards, n: int) -> Iterator[pa.RecordBatch]:
    opened = vocabulary.open()
    for _, sizes, h in blocks(batches):
        ids = _numbers(opened, vocabulary.starts, h)
        keys = np.sort((_previous(ids, sizes, vocabulary.total).astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64))
        keys, counts = np.unique(keys, return_counts=True)
        yield _sent(keys, counts.astype(np.uint32), shard_of(scrambled(keys), n).astype(np.int64), n)


def _pairs(ids: np.ndarray, before: np.ndarray, bigrams: Shards, opened: Opened) -> np.ndarray:
    """The number of each token's bigram with the word before it, or NONE."""
    both = (before >= 0) & (ids >= 0)
    some, back = np.unique(scrambled((before[both].astype(np.uint64) << np.uint64(32)) | ids[both].astype(np.uint64)), return_inverse=True)
    out = np.full(len(ids), NONE)
    out[both] = places(opened, bigrams.starts, some)[back]
    return out


def _trigrams(batches: Iterator[pa.RecordBatch], vocabulary: Shards, bigrams: Shards, n: int) -> Iterator[pa.RecordBatch]:
    words, opened = vocabulary.open(), bigrams.open()
    for _, sizes, h in blocks(batches):
        ids = _numbers(words, vocabulary.starts, h)
        pair = _pairs(ids, _previous(ids, sizes, vocabulary.total), bigrams, opened)
        shard, keys, counts, _ = distinct(*trigram_keys(_previous(pair, sizes, bigrams.total), pair, bigrams.starts))
        yield _sent(keys, counts.astype(np.uint32), shard, n)


STATS = "kind string, shard int, n long, large long, ones long, twos long, threes long, fours long, ids binary, sums binary"
_STATS = pa.schema([("kind", pa.string()), ("shard", pa.int32()), *((x, pa.int64()) for x in ("n", "large", "ones", "twos", "threes", "fours")), ("ids", pa.binary()), ("sums", pa.binary())])


def _of_counts(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


@dataclass
class Model:
    """All a worker needs: bigrams (key, count), words (hash, count), and by word what the two orders need of it."""

    vocabulary: Shards
    bigrams: Shards
    stats: Shards
    tokens: int
    begin: tuple[int, int, int, int]
    low: tuple[float, float, float]
    high: tuple[float, float, float]
    low_kinds: tuple[int, int, int]
    order: int = 2
    ends: Shards | None = None  # by bigram, how many different words come before it
    trigrams: Shards | None = None
    contexts: Shards | None = None  # of the bigrams that occur more than once: place in the shard, trigrams begun that occur once, twice, more often
    begin_pair: tuple[int, int, int, int] = (0, 0, 0, 0)
    top: tuple[float, float, float] = (0.5, 1.0, 1.5)


def discounts(ones: int, twos: int, threes: int, fours: int) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of n-grams with counts 1 to 4."""
    y = ones / (ones + 2 * twos) if ones else 0.0
    n = (ones, twos, threes, fours)
    out = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] and y else k / 2 for k in (1, 2, 3)]
    return tuple(d if 0 < d < k else k / 2 for k, d in zip((1, 2, 3), out, strict=True))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> Model:
    """A model of the texts of docs, of order 2 or 3."""
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col)
    n = max(shards(rows), by_size(rows, FINER))
    folder = scratch(spark, "lm")

    def words_shard(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, counts = _gathered(table)
        put_file(f"{folder}/words/{shard:06d}.bin", [keys.tobytes(), counts.tobytes()])
        return pa.table({"shard": pa.array([shard], pa.int32()), "types": pa.array([len(keys)], pa.int64()), "tokens": pa.array([int(counts.sum())], pa.int64())})

    made = written(rows.mapInArrow(partial(_words, n=n), _SENT).groupBy("shard").applyInArrow(words_shard, "shard int, types long, tokens long"), f"{folder}/words-made").collect()  # a row per shard
    size = {r.shard: r.types for r in made}
    vocabulary = Shards(f"{folder}/words", [size.get(k, 0) for k in range(n)], ["u8", "i8"])
    tokens = sum(r.tokens for r in made)
    total = vocabulary.total
    if total >= 2**32 - 1:
        raise ValueError("bigram keys have room for 2**32 - 2 words")
    starts = vocabulary.starts

    def by_words(keys: np.ndarray, counts: np.ndarray) -> list[dict]:
        """What the words of a shard's bigrams need of it; counts: occurrences or, below the highest order, words before."""
        out = []
        first, second = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(2**32 - 1)).astype(np.int64)
        ids, at = np.unique(np.concatenate([first, second]), return_inverse=True)
        one, two = at[: len(first)], at[len(first) :]
        # bigrams it ends; occurrences it begins; bigrams it begins that occur once, twice, more often
        sums = np.stack([np.bincount(two, minlength=len(ids)), np.bincount(one, counts, len(ids)), *(np.bincount(one, w, len(ids)) for w in (counts == 1, counts == 2, counts > 2))]).astype(np.int64)
        bounds = np.searchsorted(ids, [*starts[:-1], total, total + 1])
        for k in range(n + 1):  # shard n: the sign before a text's first word
            lo, hi = bounds[k], bounds[k + 1]
            if lo < hi:
                out.append({"kind": "words", "shard": k, "ids": ids[lo:hi].tobytes(), "sums": np.ascontiguousarray(sums[:, lo:hi]).tobytes()})
        return out

    def bigrams_shard(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, counts = _gathered(table)
        mixed = scrambled(keys)
        rank = np.argsort(mixed)
        column, large = packed(counts[rank])
        put_file(f"{folder}/bigrams/{shard:06d}.bin", [np.ascontiguousarray(mixed[rank]).tobytes(), *column])
        out = [{"kind": "bigrams", "shard": shard, "n": len(keys), "large": large, **dict(zip(("ones", "twos", "threes", "fours"), _of_counts(counts), strict=True))}]
        if order == 2:
            out += by_words(keys, counts)
        return pa.Table.from_pylist(out, schema=_STATS)

    counted = written(rows.mapInArrow(partial(_bigrams, vocabulary=vocabulary, n=n), _SENT).groupBy("shard").applyInArrow(bigrams_shard, STATS), f"{folder}/bigrams-made")

    pairs = counted.where("kind = 'bigrams'").select("shard", "n", "large", "ones", "twos", "threes", "fours").collect()  # a row per shard
    size = {r.shard: (r.n, r.large) for r in pairs}
    bigrams = Shards(f"{folder}/bigrams", [size.get(k, (0, 0))[0] for k in range(n)], ["u8", "count"], [size.get(k, (0, 0))[1] for k in range(n)])
    of = lambda rs: discounts(*(sum(r[c] for r in rs) for c in ("ones", "twos", "threes", "fours")))
    third: dict = {}
    if order == 3:
        delete(spark, f"{folder}/bigrams-made")
        counted, pairs, third = _third(rows, vocabulary, bigrams, n, folder, by_words, of)

    def stats_shard(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        lo, hi = (int(starts[shard]), int(starts[shard + 1])) if shard < n else (total, total + 1)
        sums = np.zeros((5, hi - lo), np.int64)
        trimmed()
        for ids, part in zip(table.column("ids"), table.column("sums"), strict=True):
            at = np.frombuffer(ids.as_buffer(), np.int64) - lo
            sums[:, at] += np.frombuffer(part.as_buffer(), np.int64).reshape(5, -1)
        put_file(f"{folder}/stats/{shard:06d}.bin", [sums.tobytes()])
        ends = _of_counts(sums[0]) if shard < n else [0] * 4
        row = {"kind": "stats", "shard": shard, "n": int((sums[0] > 2).sum()) if shard < n else 0, **dict(zip(("ones", "twos", "threes", "fours"), ends, strict=True)), "sums": sums.tobytes() if shard == n else None}
        return pa.Table.from_pylist([row], schema=_STATS)

    by_word = written(counted.where("kind = 'words'").groupBy("shard").applyInArrow(stats_shard, STATS), f"{folder}/stats-made").collect()  # a row per shard
    begin = next((tuple(int(x) for x in np.frombuffer(r.sums, np.int64)[1:]) for r in by_word if r.shard == n), (0, 0, 0, 0))
    kinds = (sum(r.ones for r in by_word), sum(r.twos for r in by_word), sum(r.n for r in by_word))
    for done in ("words", "bigrams", "ends", "stats"):
        delete(spark, f"{folder}/{done}-made")
    return Model(vocabulary, bigrams, Shards(f"{folder}/stats", vocabulary.sizes, ["i8"] * 5), tokens, begin, of(by_word), of(pairs), kinds, order, **third)


def _third(rows: DataFrame, vocabulary: Shards, bigrams: Shards, n: int, folder: str, by_words, of) -> tuple:
    """(statistics of words, counts of the words before bigrams, a row per shard, what the model has of order 3)."""
    if bigrams.total >= 2**40 or max(bigrams.sizes) >= 2**24 - 1:
        raise ValueError("trigram keys have room for 2**40 bigrams, 2**24 - 2 in a shard")
    spark, starts = rows.sparkSession, bigrams.starts

    def trigrams_shard(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, counts = _gathered(table)
        column, large = packed(counts)
        put_file(f"{folder}/trigrams/{shard:06d}.bin", [keys.tobytes(), *column])
        out = [{"kind": "trigrams", "shard": shard, "n": len(keys), "large": large, **dict(zip(("ones", "twos", "threes", "fours"), _of_counts(counts), strict=True))}]
        context = (keys >> PAIR).astype(np.int64)
        at = np.flatnonzero(np.diff(context, prepend=-1))
        context = context[at]
        total, *kinds = (np.add.reduceat(x, at) for x in (counts, *(w.astype(np.int64) for w in (counts == 1, counts == 2, counts > 2))))
        own = context < bigrams.sizes[shard]
        more = own & (total > 1)
        put_file(f"{folder}/contexts/{shard:06d}.bin", [x.astype(np.uint32).tobytes() for x in (context[more], *(k[more] for k in kinds))])
        out.append({"kind": "contexts", "shard": shard, "n": int(more.sum()), "sums": np.array([total[~own], *(k[~own] for k in kinds)], np.int64).tobytes()})
        ends, before = np.unique((keys & np.uint64((1 << 40) - 1)).astype(np.int64), return_counts=True)
        bounds = np.searchsorted(ends, starts)
        for k in range(n):
            lo, hi = bounds[k], bounds[k + 1]
            if lo < hi:
                out.append({"kind": "ends", "shard": k, "ids": planes(np.diff(ends[lo:hi], prepend=starts[k])), "sums": planes(before[lo:hi])})
        return pa.Table.from_pylist(out, schema=_STATS)

    counted = written(rows.mapInArrow(partial(_trigrams, vocabulary=vocabulary, bigrams=bigrams, n=n), _SENT).groupBy("shard").applyInArrow(trigrams_shard, STATS), f"{folder}/trigrams-made")

    def ends_shard(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        trimmed()
        before = np.zeros(bigrams.sizes[shard], np.int64)
        for ids, part in zip(table.column("ids"), table.column("sums"), strict=True):
            before[np.cumsum(unplaned(ids.as_buffer()), dtype=np.int64)] += unplaned(part.as_buffer())
        column, large = packed(before)
        put_file(f"{folder}/ends/{shard:06d}.bin", column)
        out = [{"kind": "ends", "shard": shard, "n": len(before), "large": large, **dict(zip(("ones", "twos", "threes", "fours"), _of_counts(before), strict=True))}]
        return pa.Table.from_pylist(out + by_words(unscrambled(np.asarray(bigrams.arrays(shard)[0])), before), schema=_STATS)

    ended = written(counted.where("kind = 'ends'").groupBy("shard").applyInArrow(ends_shard, STATS), f"{folder}/ends-made")
    few = ["shard", "n", "large", "ones", "twos", "threes", "fours"]
    made = counted.where("kind = 'trigrams'").select(few).collect()  # a row per shard
    sets = counted.where("kind = 'contexts'").select("shard", "n", "sums").collect()  # a row per shard
    size, more = ({r.shard: r.n for r in rs} for rs in (made, sets))
    summary = ended.where("kind = 'ends'").select(few).collect()  # a row per shard
    over, by_end = ({r.shard: r.large for r in rs} for rs in (made, summary))
    begin = next((tuple(np.frombuffer(r.sums, np.int64).tolist()) for r in sets if r.sums), (0, 0, 0, 0))
    third = {
        "ends": Shards(f"{folder}/ends", bigrams.sizes, ["count"], [by_end.get(k, 0) for k in range(n)]),
        "trigrams": Shards(f"{folder}/trigrams", [size.get(k, 0) for k in range(n)], ["u8", "count"], [over.get(k, 0) for k in range(n)]),
        "contexts": Shards(f"{folder}/contexts", [more.get(k, 0) for k in range(n)], ["u4"] * 4),
        "begin_pair": begin,
        "top": of(made),
    }
    delete(spark, f"{folder}/trigrams-made")
    return ended, summary, third


def _highest(p: np.ndarray, pair: np.ndarray, sizes: np.ndarray, model: Model, opened: tuple) -> np.ndarray:
    """Probabilities of order 3 from those of order 2 and the tokens' bigrams."""
    pairs, trigrams, contexts = opened
    context = _previous(pair, sizes, model.bigrams.total)
    some, back = np.unique(context, return_inverse=True)
    own = np.flatnonzero((some >= 0) & (some < model.bigrams.total))
    total, left = np.zeros(len(some)), np.zeros(len(some))
    total[own] = taken(pairs, model.bigrams.starts, some[own], 1)
    left[own] = model.top[0]  # one trigram that occurs once, unless listed
    for k, lo, hi in _runs(np.searchsorted(some[own], model.bigrams.starts)):
        mine = own[lo:hi]
        mine = mine[total[mine] > 1]
        if len(mine):
            listed, *kinds = contexts[k]
            at = np.searchsorted(listed, (some[mine] - model.bigrams.starts[k]).astype(np.uint32))
            left[mine] = sum(d * x[at] for d, x in zip(model.top, kinds, strict=True))
    begin = some == model.bigrams.total
    total[begin], left[begin] = model.begin_pair[0], np.dot(model.top, model.begin_pair[1:])
    there = total > 0
    share = np.divide(left, total, out=np.ones(len(some)), where=there)
    out = share[back] * p
    both = (context >= 0) & (pair >= 0)
    shard, keys, _, back3 = distinct(*trigram_keys(context[both], pair[both], model.bigrams.starts))
    found = _sought(trigrams, model.trigrams.starts, keys, np.searchsorted(shard, np.arange(len(trigrams) + 1)))
    c = np.zeros(len(keys))
    c[found >= 0] = taken(trigrams, model.trigrams.starts, found[found >= 0], 1)
    seen = c[back3]
    out[both] += np.divide(_discounted(seen, model.top), total[back][both], out=np.zeros(len(seen)), where=seen > 0)
    return out


def _discounted(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return c - np.array([0.0, *d])[np.minimum(c, 3).astype(np.int64)]


def _scores(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    words, pairs, stats = model.vocabulary.open(), model.bigrams.open(), model.stats.open()
    if model.order == 3:
        ends, third = model.ends.open(), (pairs, model.trigrams.open(), model.contexts.open())
    begin, bigrams = model.vocabulary.total, model.bigrams.total
    uniform = 1 / (begin + 1)
    spare = sum(d * k for d, k in zip(model.low, model.low_kinds, strict=True)) / bigrams if bigrams else 1.0
    for ids, sizes, h in blocks(batches):
        keys, inverse = np.unique(h, return_inverse=True)
        at = places(words, model.vocabulary.starts, keys)
        known = at >= 0  # numbers follow the order of the hashes
        count = np.zeros(len(keys))
        count[known] = taken(words, model.vocabulary.starts, at[known], 1)
        columns = np.zeros((5, len(keys)))
        for c in range(5):
            columns[c, known] = taken(stats, model.vocabulary.starts, at[known], c)
        low = np.full(len(keys), spare * uniform)
        if bigrams:
            low[known] += _discounted(columns[0, known], model.low) / bigrams
        base = np.log10((count + 1) / (model.tokens + 1 * (begin + 1)))
        # what each word leaves to the lower order when it is the context
        total = np.append(columns[1], [model.begin[0]])
        left = np.append(model.high @ columns[2:], [np.dot(model.high, model.begin[1:])])
        there = total > 0
        share = np.divide(left, total, out=np.ones(len(total)), where=there)
        token = inverse
        before = _previous(token, sizes, len(keys))  # the last of total: the sign before a text's first word
        number = np.append(at, begin)
        pair = _pairs(number[token], number[before], model.bigrams, pairs)
        some, back = np.unique(pair[pair >= 0], return_inverse=True)
        seen = (taken(ends, model.bigrams.starts, some, 0) if model.order == 3 else taken(pairs, model.bigrams.starts, some, 1))[back].astype(float)
        p = share[before] * low[token]
        p[pair >= 0] += _discounted(seen, model.high) / total[before[pair >= 0]]
        if model.order == 3:
            p = _highest(p, pair, sizes, model, third)
        first = np.cumsum(sizes) - sizes
        add = lambda x: np.add.reduceat(x, first)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(sizes.astype(np.int64)), pa.array(add((count > 0)[token].astype(np.int64))), pa.array(np.full(len(ids), model.tokens, np.int64)), pa.array(add(base[token])), pa.array(add(np.log10(p)))],
            names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for each row of docs; scores are log10 probabilities of whole texts."""
    rows = texts(docs, id_col, text_col)
    return rows.mapInArrow(partial(_scores, model=model), "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")

"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into so few segments that of two within max_distance bits one segment differs by one bit at
most. Each segment is indexed as it is and with each one of its bits taken out; equal keys are candidates, which a
count of differing bits verifies. Only distinct fingerprints are compared, each bucket yields a forest of its links
and not all pairs, and buckets with very many fingerprints are split into pairs of blocks.

drop_similar finds texts by their fingerprints in the same way, and the exact Jaccard similarity of the shingles (their
64-bit hashes) decides. As 64 bits can't tell a similarity of 0.8, texts that share a key of minima of their word shingles
are candidates too. Members of a key that very many texts share are compared where they share one of their rarest
shingles, which loses no similar pair.

Defined cases: a null or empty text, or one of blanks only, has fingerprint zero and is linked like any other; a null
id keeps its row and never names a component (a component of null ids only is null); repeated rows stay, each with its
component; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binaries, components, in_pieces, released, scratch, shards, texts, words_of, written

BITS = 64
BLOCK = 2048
BANDS, ROWS = 24, 4
#: Bits in which the fingerprints of candidates differ at most.
NEAR = 3
#: Members of a key that are compared with each other; more go by their rarest shingles.
FEW = 32
#: Slots in which shingles are counted, and the parts these are sent in.
SLOT_BITS, SLOT_PARTS = 18, 256
WORDS_KEPT = 100_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LANE = np.uint64(0x0101010101010101)
_SHIFTS = [np.uint64(k) for k in range(8)]


def majority(h: np.ndarray) -> int:
    """Bits that are set in over half of the 64-bit values h; zero for none."""
    if not len(h):
        return 0
    at = np.arange(0, len(h), 255)  # a byte-wide lane counts no further
    counts = np.empty((8, 8), np.int64)  # byte, bit
    for k, s in enumerate(_SHIFTS):
        counts[:, k] = np.add.reduceat((h >> s) & _LANE, at).view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return int(np.packbits(counts.reshape(-1) * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    words = words_of(text)
    if not words:
        return 0
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    if len(words) <= shingle:
        return digest(b" ".join(words))
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    return majority(np.fromiter(map(digest, grams), np.uint64, len(words) - shingle + 1))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): one row per row of docs; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        for batch in in_pieces(batches, 4 << 20):
            fp = np.array([fingerprint(t, shingle, seed) for t in binaries(batch, 1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fp)], names=["id", "fp"])

    return texts(docs, id_col, text_col).mapInArrow(run, "id long, fp long")


def _segments(max_distance: int) -> list[tuple[int, int]]:
    """(first bit, width) of the segments: of max_distance bits spread over them, one gets one bit or none."""
    n = max_distance // 2 + 1
    edges = [BITS * k // n for k in range(n + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:], strict=False)]


def _exact(first: int, width: int) -> F.Column:
    moved = F.shiftrightunsigned("fp", first)
    return moved if width == BITS else moved.bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _keys(segment: F.Column, first: int, width: int) -> F.Column:
    """(kind, value) of a segment's keys: kind is the number of the bit taken out, or 64 for the segment as it is, and its first bit."""
    out = [F.struct(F.lit(first * 128 + 64).cast("int").alias("kind"), segment.alias("value"))]
    for j in range(width):
        mask = ((1 << width) - 1) & ~(1 << j)
        mask -= (1 << 64) * (mask >> 63)
        out.append(F.struct(F.lit(first * 128 + first + j).cast("int").alias("kind"), segment.bitwiseAND(F.lit(mask).cast("long")).alias("value")))
    return F.array(*out)


def _near(fp: np.ndarray, bit: int, most: int) -> Iterator[np.ndarray]:
    """Forest of the links of one bucket; bit: of a deletion bucket, only pairs that differ there are new."""
    if bit >= 0:
        side = (fp >> np.uint64(bit)) & np.uint64(1)
        parts = [fp[side == 0], fp[side == 1]]
        if not len(parts[0]) or not len(parts[1]):
            return
        todo, reached = [p.copy() for p in parts], None
        # breadth first, from side to side
        while len(todo[0]) and len(todo[1]):
            front, at = todo[0][:1], 0
            todo[0] = todo[0][1:]
            while len(front):
                other, new = 1 - at, []
                for x in front:
                    if not len(todo[other]):
                        break
                    hit = np.bitwise_count(todo[other] ^ x) <= most
                    if hit.any():
                        reached = todo[other][hit]
                        yield np.stack([np.full(len(reached), x), reached], axis=1)
                        todo[other] = todo[other][~hit]
                        new.append(reached)
                front, at = (np.concatenate(new) if new else fp[:0]), other
        return
    todo = fp.copy()
    while len(todo) > 1:
        front, todo = todo[:1], todo[1:]
        while len(front) and len(todo):
            new = []
            for x in front:
                hit = np.bitwise_count(todo ^ x) <= most
                if hit.any():
                    yield np.stack([np.full(int(hit.sum()), x), todo[hit]], axis=1)
                    new.append(todo[hit])
                    todo = todo[~hit]
                if not len(todo):
                    break
            front = np.concatenate(new) if new else todo[:0]


def _buckets(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Links of rows sorted by (kind, value, sub): neighbours at a distance of up to 8 at once, larger runs one by one."""
    held: list[np.ndarray] = []

    def links(rows: np.ndarray) -> Iterator[np.ndarray]:
        kind, value, sub, fp = rows
        new = np.flatnonzero((kind[1:] != kind[:-1]) | (value[1:] != value[:-1]) | (sub[1:] != sub[:-1])) + 1
        start = np.concatenate([[0], new])
        size = np.diff(np.concatenate([start, [len(fp)]]))
        run = np.repeat(np.arange(len(start)), size)
        fp = fp.view(np.uint64)
        bit = np.where(kind % 128 == 64, -1, kind % 128)
        small = size[run] <= 8
        for d in range(1, 8):
            i = np.flatnonzero((run[d:] == run[:-d]) & small[d:])
            if not len(i):
                break
            x = fp[i] ^ fp[i + d]
            b = bit[i]
            ok = (np.bitwise_count(x) <= most) & ((b < 0) | ((x >> np.maximum(b, 0).astype(np.uint64)) & np.uint64(1) == 1))
            yield np.stack([fp[i][ok], fp[i + d][ok]], axis=1)
        for k in np.flatnonzero(size > 8):
            lo = start[k]
            yield from _near(fp[lo : lo + size[k]], int(bit[lo]), most)

    def out(rows: np.ndarray):
        for pairs in links(rows):
            if len(pairs):
                p = pairs.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.stack([batch.column(k).cast(pa.int64()).to_numpy() for k in range(4)]))
        if sum(x.shape[1] for x in held) < 200_000:
            continue
        rows = np.concatenate(held, axis=1)
        last = np.flatnonzero((rows[:3] != rows[:3, -1:]).any(axis=0))
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            yield from out(rows[:, :cut])
        held = [rows[:, cut:]]
    if held:
        yield from out(np.concatenate(held, axis=1))


def links(distinct: DataFrame, max_distance: int = 3) -> DataFrame:
    """(a, b): a forest of the links within max_distance bits in each bucket of distinct fingerprints (column fp)."""
    spark = distinct.sparkSession
    segments = _segments(max_distance)
    exact = distinct.select(F.explode(F.array(*[F.struct(F.lit(lo).alias("lo"), _exact(lo, w).alias("value")) for lo, w in segments])).alias("s"))
    hot = exact.groupBy("s.lo", "s.value").count().where(F.col("count") > BLOCK // 2)
    # a deletion bucket is the union of two exact ones: all that hold a hot one are split by at least its size
    each = F.coalesce(*[F.when(F.col("lo") == lo, _keys(F.col("value"), lo, w)) for lo, w in segments])
    hot = hot.select("count", F.explode(each).alias("k")).groupBy("k.kind", "k.value").agg(F.sum("count").alias("n"))
    hot = written(hot.select("kind", "value", F.ceil((F.col("n") + BLOCK // 2) / BLOCK).cast("int").alias("blocks")), scratch(spark, "simhash-hot"))
    n_hot = hot.count()
    rows = distinct.select("fp", F.explode(F.concat(*[_keys(_exact(lo, w), lo, w) for lo, w in segments])).alias("k")).select("k.kind", "k.value", "fp")
    if n_hot:
        rows = rows.join(F.broadcast(hot) if n_hot <= 100_000 else hot, ["kind", "value"], "left")
        own = F.pmod(F.xxhash64("fp"), "blocks").cast("int")
        subs = F.when(F.col("blocks") > 1, F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.least(i, own) * F.col("blocks") + F.greatest(i, own))).otherwise(F.array(F.lit(0)))
        rows = rows.select("kind", "value", F.explode(subs).alias("sub"), "fp")
    else:
        rows = rows.select("kind", "value", F.lit(0).alias("sub"), "fp")
    dealt = rows.repartition(shards(distinct, BITS), "kind", "value", "sub").sortWithinPartitions("kind", "value", "sub")
    return dealt.mapInArrow(partial(_buckets, most=max_distance), "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_distance: int = 3) -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over links of max_distance differing bits or fewer."""
    spark = docs.sparkSession
    prints = written(fingerprints(docs, id_col, text_col, shingle), scratch(spark, "simhash-prints"))
    distinct = prints.groupBy("fp").agg(F.min("id").alias("first"))
    joined = components(links(distinct.select("fp"), max_distance), "simhash")
    roots = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    lowest = roots.groupBy("root").agg(F.min("first").alias("component"))
    named = written(roots.join(lowest, "root").select("fp", "component"), scratch(spark, "simhash-named"))
    return prints.join(named, "fp").select("id", "fp", "component")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, max_distance: int = 7) -> DataFrame:
    """The rows of docs of which no near-duplicate with a smaller id exists; of repeated rows with one id, all stay or go.

    Texts without words and rows without id are kept: they say nothing that another row repeats.
    """
    spark = docs.sparkSession
    found = simhash_components(docs.where(F.col(id_col).isNotNull() & F.col(text_col).rlike(r"[^\x20\x09-\x0D]")), id_col, text_col, shingle, max_distance)
    gone = written(found.where("id <> component").select(F.col("id").alias("__gone")).distinct(), scratch(spark, "simhash-gone"))
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")


class _Hashes(dict):
    """Hashes of words, kept while a task meets them again."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes | None, shingle: int = 5, hashes: dict | None = None) -> np.ndarray:
    """Sorted different hashes of the word shingles of a text; of one with fewer words, of the whole."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map((_Hashes() if hashes is None else hashes).__getitem__, words), np.uint64, len(words))
    n = min(shingle, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = h * _ODD + w[k : len(w) - n + 1 + k]
    return np.unique(_mixed(h))


def _set_key(h: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).view(np.int64))


def _bands(h: np.ndarray, lenders: np.ndarray) -> np.ndarray:
    """A key for each band of ROWS minima of sorted hashes; two sets share a minimum as often as their similarity says.

    Each bin is a range of the hashes and holds the least one in it; an empty bin takes that of another bin, asked for in
    an order (lenders) that is the same for all sets.
    """
    n = BANDS * ROWS
    if not len(h):
        return np.zeros(BANDS, np.int64)
    of = ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
    full = np.zeros(n, bool)
    full[of] = True
    low = h[np.minimum(np.searchsorted(of, np.arange(n)), len(h) - 1)]
    empty = np.flatnonzero(~full)
    for places in lenders:
        if not len(empty):
            break
        hit = full[places[empty]]
        low[empty[hit]] = low[places[empty[hit]]]
        empty = empty[~hit]
    if len(empty):  # very few shingles: the next bin in turn
        some = np.flatnonzero(full)
        low[empty] = low[some[np.searchsorted(some, empty) % len(some)]]
    key = np.arange(BANDS, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        key = _mixed(key * _ODD + column)
    return key.view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    released()
    lenders = np.random.default_rng(42).integers(0, BANDS * ROWS, (64, BANDS * ROWS))
    hashes = _Hashes()
    for batch in in_pieces(batches, 1 << 20):
        sets = [shingles(t, shingle, hashes) for t in binaries(batch, 1)]
        bands = np.concatenate([_bands(h, lenders) for h in sets])
        fp = np.array([majority(h) for h in sets], np.uint64).view(np.int64)
        columns = [batch.column(0).cast(pa.int64()), pa.array(map(_set_key, sets), pa.int64()), pa.array(map(len, sets), pa.int32()), pa.array(fp)]
        yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * BANDS, pa.array(bands))], names=["id", "key", "n", "fp", "bands"])


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """(key, its shingles) of (wanted key, text); rows with another text of the same id go."""
    released()
    hashes = _Hashes()
    for batch in in_pieces(batches, 1 << 20):
        some = [(k, h) for k, t in zip(batch.column(0).to_pylist(), binaries(batch, 1), strict=True) if _set_key(h := shingles(t, shingle, hashes)) == k]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int64()), pa.array([h.view(np.int64) for _, h in some], pa.list_(pa.int64()))], names=["key", "s"])


def _slots(t: np.ndarray) -> np.ndarray:
    return (_mixed(t.view(np.uint64)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _loads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, counts): how many of the shingles of a task lie in each slot; parts without any are left out."""
    counts = np.zeros(1 << SLOT_BITS, np.int64)
    for batch in batches:
        counts += np.bincount(_slots(batch.column(0).flatten().to_numpy()), minlength=len(counts))
    parts = counts.reshape(SLOT_PARTS, -1)
    some = np.flatnonzero(parts.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[k].tobytes() for k in some], pa.binary())], names=["part", "counts"])


def _loads_summed(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in table.column("counts"))
    return pa.table({"part": table.column("part")[:1].cast(pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def _prefixes(batches: Iterator[pa.RecordBatch], loads, similarity: float) -> Iterator[pa.RecordBatch]:
    load = loads.value
    for batch in batches:
        rows = []
        for s in batch.column(2):
            t = s.values.to_numpy()
            of = load[_slots(t)]
            i = np.arange(int(len(t) * (1 - similarity) + 1e-6) + 1)[: len(t)]
            first = np.lexsort((t, of))[i]
            shared = of[first] > 1
            rows.append((len(t), i[shared], t[first[shared]]))
        m = np.array([len(i) for _, i, _ in rows], np.int64)
        whole = lambda parts, kind: pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]).astype(kind))
        own = [pa.array(np.repeat(batch.column(k).to_numpy(), m)) for k in (0, 1)]
        n = pa.array(np.repeat(np.array([n for n, _, _ in rows], np.int32), m))
        yield pa.RecordBatch.from_arrays([*own, n, whole([i for _, i, _ in rows], np.int32), whole([t for _, _, t in rows], np.int64)], names=["key", "root", "n", "i", "t"])


def rarest(members: DataFrame, similarity: float) -> DataFrame:
    """(key, root, n, i, t): the first shingles t of members (key, root, s: a set of n shingles), rarest first, that others have too.

    Two sets at that similarity share one of these, whatever order all sets follow. A shingle's place is that of the number
    of shingles in its slot, counted without a row for each: a passage that very many texts hold comes last in the order,
    and is reached only by texts that consist of it but for so little.
    """
    spark = members.sparkSession
    counted = members.select("s").mapInArrow(_loads, "part int, counts binary").groupBy("part").applyInArrow(_loads_summed, "part int, counts binary")
    load = np.zeros((SLOT_PARTS, (1 << SLOT_BITS) // SLOT_PARTS), np.int64)
    for r in counted.collect():  # SLOT_PARTS rows at most, 2 MB in all
        load[r.part] = np.frombuffer(r.counts, np.int64)
    loads = spark.sparkContext.broadcast(load.reshape(-1))
    first = members.select("key", "root", "s").mapInArrow(partial(_prefixes, loads=loads, similarity=similarity), "key long, root long, n int, i int, t long")
    first = written(first, scratch(spark, "similar-prefixes"))
    return first.join(first.groupBy("t").agg(F.count("*").alias("c")).where("c > 1").select("t"), "t").select("key", "root", "n", "i", "t")


def _may_reach(similarity: float) -> F.Column:
    """Whether sets of n_a and n_b shingles, whose first common one is at i_a and i_b, can have that similarity."""
    share, sizes = F.least(F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b")), F.col("n_a") + F.col("n_b")
    fits = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * similarity - 1e-9
    return fits & (share >= sizes * (similarity / (1 + similarity)) - 1e-6) & (F.col("root_a") != F.col("root_b"))


def _side(df: DataFrame, side: str) -> DataFrame:
    return df.select("t", *[F.col(c).alias(f"{c}_{side}") for c in ("key", "root", "n", "i")])


def central_pairs(first: DataFrame, similarity: float) -> DataFrame:
    """(a, b): of each shingle in first, the text least of which is its own, with all others: what many copies were made from."""
    centre = first.groupBy("t").agg(F.min(F.struct("i", "key", "root", "n")).alias("x")).select("t", "x.key", "x.root", "x.n", "x.i")
    return _side(first, "a").join(_side(centre, "b"), "t").where(_may_reach(similarity)).select(F.col("key_b").alias("a"), F.col("key_a").alias("b"))


def rare_pairs(first: DataFrame, similarity: float) -> DataFrame:
    """(a, b): candidates that share a shingle of first and have different roots; no pair at that similarity is missing.

    Let the first shingle in order that two sets share stand at places i and j (from 0). They share n - i and m - j at
    most, and must share similarity / (1 + similarity) * (n + m): so it is within a ninth (at 0.8) of the smaller set and
    within a fifth of the larger.
    """
    part = similarity / (1 + similarity)
    # a shingle's pairs of one root are none; those of its commonest root needn't meet
    top = first.groupBy("t", "root").agg(F.count("*").alias("c")).groupBy("t").agg(F.max(F.struct("c", "root"))["root"].alias("top"), F.count("*").alias("roots"))
    first = written(first.join(top.where("roots > 1").select("t", "top"), "t"), scratch(first.sparkSession, "similar-rare-roots"))
    small, odd = first.where(F.col("i") <= F.col("n") * (1 - 2 * part) + 1e-6), F.col("root") != F.col("top")
    pairs = _side(small.where(odd), "a").join(_side(first, "b"), "t").unionByName(_side(small.where(~odd), "a").join(_side(first.where(odd), "b"), "t"))
    return pairs.where((F.col("n_a") <= F.col("n_b")) & _may_reach(similarity)).select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b"))


def fingerprint_pairs(distinct: DataFrame, max_distance: int) -> DataFrame:
    """(hub, hub_n, key, n): shingle sets (key, n, fp) whose fingerprints are linked within max_distance bits, each with the one of the smallest key."""
    joined = components(links(distinct.select("fp").distinct(), max_distance), "similar-fingerprints").withColumnRenamed("node", "fp")
    rows = distinct.select("key", "n", "fp").join(joined, "fp", "left").select("key", "n", F.coalesce("component", "fp").alias("component"))
    rows = written(rows, scratch(distinct.sparkSession, "similar-of-fingerprints"))
    hub = rows.groupBy("component").agg(F.count("*").alias("size"), F.min(F.struct("key", "n")).alias("hub")).where("size > 1")
    return rows.join(hub, "component").where("key <> hub.key").select("hub.key", "key", "hub.n", "n").toDF("hub", "key", "hub_n", "n")


def similar(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """(id, component): component is the smallest id reachable over pairs of texts whose shingles have that Jaccard similarity or more.

    Sets whose fingerprints are linked within NEAR bits are compared with the first one linked. Beyond those, different sets
    share one of BANDS keys or are no candidates: at 0.8 a pair is missed about three times in a million, above more seldom.
    Each key's members are compared exactly with its hub, the one that shares its keys with the most sets (what many copies
    were made from shares more than they do with each other), then, where they aren't joined yet, with each other: up to FEW
    of them in pairs, of more first all with the most central ones, then those that share one of their rarest shingles. A
    key's size and hub are counted before anything is shuffled, and its members are joined back, so that a key very many
    texts share is a skewed join that Spark splits.
    """
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col)
    sketches = written(rows.mapInArrow(partial(_sketches, shingle=shingle), "id long, key long, n int, fp long, bands array<long>"), scratch(spark, "similar-sketches"))
    distinct = sketches.groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", "fp", "bands")])
    distinct = written(distinct, scratch(spark, "similar-distinct"))
    printed = written(fingerprint_pairs(distinct, NEAR), scratch(spark, "similar-printed"))
    dealt = distinct.select("key", "n", F.explode("bands").alias("band"))
    dealt = written(dealt.join(dealt.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "band"), scratch(spark, "similar-dealt"))
    weights = dealt.groupBy("key").agg(F.sum("size").alias("weight"))
    weighed = written(dealt.drop("size").join(weights, "key"), scratch(spark, "similar-weighed"))
    hub = weighed.groupBy("band").agg(F.min(F.struct((-F.col("weight")).alias("w"), "key", "n")).alias("hub"))
    shared = weighed.drop("weight").join(hub.select("band", F.col("hub.key").alias("hub"), F.col("hub.n").alias("hub_n")), "band")
    shared = written(shared, scratch(spark, "similar-shared"))
    like = lambda a, b: F.least(a, b) >= F.greatest(a, b) * (similarity - 1e-9)
    asked = shared.select("key").union(printed.select("key")).union(printed.select("hub")).distinct()
    firsts = sketches.select("id", "key").join(asked, "key", "left_semi").groupBy("key").agg(F.min("id").alias("id"))
    firsts = written(firsts, scratch(spark, "similar-firsts"))
    # no text is shuffled where the ids wanted are few
    wanted = rows.withColumnRenamed("text", "t").join(F.broadcast(firsts) if firsts.count() <= 500_000 else firsts, "id").select("key", "t")
    wanted = wanted.mapInArrow(partial(_sets, shingle=shingle), "key long, s array<long>")
    sets = written(wanted.groupBy("key").agg(F.first("s").alias("s")), scratch(spark, "similar-sets"))

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        both = pairs.distinct().join(sets.select(F.col("key").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("s").alias("y")), "b")
        common = both.select("a", "b", (F.size("x") + F.size("y")).alias("sizes"), F.size(F.array_intersect("x", "y")).alias("common"))
        return written(common.where(F.col("common") / (F.col("sizes") - F.col("common")) >= similarity).select("a", "b"), scratch(spark, f"similar-{name}"))

    each = ["hub", "key", "hub_n", "n"]
    close = shared.where("key <> hub").select(each).unionByName(printed.select(each)).where(like(F.col("n"), F.col("hub_n")))
    hubs = verified(close.select(F.least("hub", "key").alias("a"), F.greatest("hub", "key").alias("b")), "hubs")
    joined = components(hubs, "similar-hubs").withColumnRenamed("node", "key")
    others = shared.where("key <> hub").select("band", "key", "n").join(joined, "key", "left").select("band", "key", "n", F.coalesce("component", "key").alias("root"))
    others = written(others, scratch(spark, "similar-others"))
    several = others.groupBy("band").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    others = written(others.join(several.select("band", "size"), "band"), scratch(spark, "similar-several"))
    x, y = (others.where(F.col("size") <= FEW).select("band", *[F.col(c).alias(f"{c}_{side}") for c in ("key", "n", "root")]) for side in ("a", "b"))
    rest = x.join(y, "band").where((F.col("key_a") < F.col("key_b")) & (F.col("root_a") != F.col("root_b")) & like(F.col("n_a"), F.col("n_b")))
    rest = rest.select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))
    many = others.where(F.col("size") > FEW).select("key", "root").distinct().join(sets, "key")
    many = written(many, scratch(spark, "similar-many"))  # read twice
    first = written(rarest(many, similarity), scratch(spark, "similar-rarest"))
    hubs = written(hubs.unionByName(verified(central_pairs(first, similarity), "central")), scratch(spark, "similar-links"))
    joined = components(hubs, "similar-central").withColumnRenamed("node", "key")
    first = first.drop("root").join(joined, "key", "left").select("key", F.coalesce("component", "key").alias("root"), "n", "i", "t")
    rest = verified(rest.unionByName(rare_pairs(first, similarity)), "rest")
    joined = components(hubs.unionByName(rest), "similar")
    roots = sketches.select("id", "key").join(joined.withColumnRenamed("node", "key"), "key", "left").select("id", F.coalesce("component", "key").alias("root"))
    lowest = roots.groupBy("root").agg(F.min("id").alias("component"))
    return roots.join(lowest, "root").select("id", "component")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs of which no near-duplicate with a smaller id exists; of repeated rows with one id, all stay or go.

    Near-duplicates are texts whose word shingles have that Jaccard similarity or more, and chains of such.
    Texts without words and rows without id are kept: they say nothing that another row repeats.
    """
    spark = docs.sparkSession
    found = similar(docs.where(F.col(id_col).isNotNull() & F.col(text_col).rlike(r"[^\x20\x09-\x0D]")), id_col, text_col, shingle, similarity)
    gone = written(found.where("id <> component").select(F.col("id").alias("__gone")).distinct(), scratch(spark, "similar-gone"))
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")

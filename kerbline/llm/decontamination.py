"""Benchmark passages in documents, up to edits, by CGK embeddings and bit-sampling LSH.

A CGK walk reads a row of words: at step t it notes the word it stands on and moves on if a random bit of (t, word) says
so. Rows within few edits fall into step again, so edit distance becomes Hamming distance between walks. A table of the
LSH compares WORDS sampled steps of one walk; as many tables are drawn as simulated edits of the benchmark's own items
need for the target recall, in every class of lengths and for each kind of edit (classes that MAX_WALKS don't bring there
are searched without tables, by the exact distance of every window left). Windows as long as an item begin at every word
of a document. Before any walk, windows are left out that hold too few words, and pairs of neighbouring words, of the benchmark for any item within the allowed
edits (an edit spoils one word and two pairs at most); that loses nothing.
Candidates are verified by the exact edit distance in words between the item and the window, its end left free. An item
over MAX_WORDS words is cut into parts for the search (where it is within its edits, one part is within its own), and the
whole item is verified around each part found.

An item matches where at most max_edits (0.2) of its number of words are edits: similarity 0.8 or more. Words are runs
of letters and digits with A-Z in lower case, as in license scans.

Defined cases: a null or empty document matches nothing, and a null or wordless item matches nothing; an item with fewer
than MIN_WORDS words is found only word for word, as with an edit it would match everywhere; of several places of an item
in a document the one with the fewest edits, then the first, is reported; repeated rows and rows with a null id, of the
documents and of the benchmark, are each rows of their own; an empty table or benchmark gives an empty result; other
columns are not looked at. The benchmark is indexed in blocks of about BLOCK_BYTES by tasks, which write them to the shared
folder; one pass over the documents searches block after block, so a worker holds one at a time.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator
from functools import partial
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binaries, file_system, in_pieces, put_file, released, scratch, small_batches, texts, written
from .licenses import words_in

MAX_EDITS = 0.2
MIN_WORDS, MAX_WORDS = 8, 96
WORDS = 3
RECALL = 0.97
PER_WALK = 4
MAX_WALKS = 48
BLOCK_BYTES = 4 << 20
PIECE_BYTES = 1 << 20
PAIR_BITS = 24
PAIR_SLOTS = 1 << PAIR_BITS
SEED = 7
KINDS = ("deletion", "insertion", "substitution", "mixed")
TRIALS = 400


def _edited(row: list[int], edits: int, kind: str, rng: np.random.Generator) -> list[int]:
    """The row with so many edits: a kind's only, or half of them substitutions and the others deletions and insertions."""
    for _ in range(edits):
        now = kind if kind != "mixed" else ("deletion", "insertion", "substitution", "substitution")[int(rng.integers(4))]
        p = int(rng.integers(len(row)))
        if now == "deletion":
            del row[p]
        elif now == "insertion":
            row.insert(p, 0)
        else:
            row[p] = 0
    return row


class Index:
    """The items of a block of a benchmark, in parts of at most MAX_WORDS words, and the parts' LSH tables."""

    def __init__(self, items: list[tuple[int | None, bytes | None]], max_edits: float = MAX_EDITS, recall: float = RECALL) -> None:
        self.codes: dict[bytes, int] = {}
        self.ids, self.items, self.rows, of, offset = [], [], [], [], []
        self.short: dict[int, dict[tuple, list[int]]] = defaultdict(lambda: defaultdict(list))
        for k, text in items:
            words = np.array([self.codes.setdefault(w, len(self.codes) + 1) for w in words_in(text)], np.int32)
            if not len(words):
                continue
            item = len(self.items)
            self.ids.append(k)
            self.items.append(words)
            if len(words) < MIN_WORDS:
                self.short[len(words)][tuple(words.tolist())].append(item)
                continue
            parts = -(-len(words) // MAX_WORDS)
            for p in range(parts):
                of.append(item)
                offset.append(len(words) * p // parts)
                self.rows.append(words[len(words) * p // parts : len(words) * (p + 1) // parts])
        self.short = {n: dict(x) for n, x in self.short.items()}
        self.of, self.offset = np.array(of, np.int64), np.array(offset, np.int64)
        self.parts = np.bincount(self.of, minlength=len(self.items)) if len(of) else np.zeros(len(self.items), np.int64)
        self.allowed = [int(len(x) * max_edits + 1e-9) if len(x) >= MIN_WORDS else 0 for x in self.items]
        self.size = np.array([len(r) for r in self.rows], np.int64)
        self.width = self.steps = 1
        self.edits = np.floor(self.size * max_edits + 1e-9).astype(np.int64)
        if not self.rows:
            return
        self.width = int((self.size + self.edits).max())
        self.symbols = len(self.codes) + 2  # other words are 0, what follows an item is the last
        # an edit spoils two pairs of neighbours at most; a match keeps the other pairs of the item
        self.pairs = np.zeros(PAIR_SLOTS, bool)
        for r in self.rows:
            self.pairs[self._slot(r[:-1], r[1:])] = True
        need_pairs = self.size - 1 - 2 * self.edits
        need_any = self.size - self.edits
        # classes of items of like size share a window
        self.classes = []
        order = np.argsort(self.size, kind="stable")
        lo = 0
        while lo < len(order):
            hi = int(np.searchsorted(self.size[order], self.size[order[lo]] * 5 // 4, side="right"))
            own = order[lo:hi]
            self.classes.append((own, int((self.size[own] + self.edits[own]).max()), int(need_pairs[own].min()), int(need_any[own].min()), int(self.size[own].min() * 3 // 2)))
            lo = hi
        self.steps = max(c[4] for c in self.classes)
        self.seed, self.walks = SEED, 0
        self._draw(recall)

    def bits(self, walk: int) -> np.ndarray:
        return np.random.default_rng([self.seed, walk]).integers(0, 2, (self.steps, self.symbols), np.uint8).astype(bool)

    def sampled(self, walk: int, steps: int) -> np.ndarray:
        """The steps each of the walk's tables compares, for items that allow so many."""
        rng = np.random.default_rng([self.seed, walk, steps])
        return np.stack([rng.choice(steps, WORDS, replace=False) for _ in range(PER_WALK)])

    def walk(self, codes: np.ndarray, at: np.ndarray, walk: int) -> np.ndarray:
        """(steps, places) symbols met from each place on; codes end with enough of what follows."""
        bits, here = self.bits(walk), at.copy()
        out = np.empty((self.steps, len(at)), np.int32)
        for t in range(self.steps):
            s = codes[here]
            out[t] = s
            here += bits[t][s]
        return out

    def _keys(self, met: np.ndarray, steps: np.ndarray) -> np.ndarray:
        key = np.zeros(met.shape[1], np.int64)
        for s in steps:
            key = key * self.symbols + met[s]
        return key

    def _padded(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        gap = np.full(self.steps + 1, self.symbols - 1, np.int32)
        sizes = np.array([len(r) + len(gap) for r in rows])
        return np.concatenate([x for r in rows for x in (r, gap)]), np.cumsum(sizes) - sizes

    def _draw(self, recall: float) -> None:
        """Tables until, in every class and for each kind of edit, simulated matches with all their edits are found as often as asked for.

        A group that MAX_WALKS walks don't bring there is searched without tables: all its survivors are verified.
        """
        rng = np.random.default_rng(self.seed)
        codes, at = self._padded(self.rows)
        groups, edited, some = [], [], []
        for c, (own, *_) in enumerate(self.classes):
            for kind in KINDS:
                of = np.resize(rng.permutation(own), TRIALS)
                groups += [(c, kind)] * len(of)
                some.extend(of.tolist())
                edited += [np.array([*_edited(self.rows[i].tolist(), int(self.edits[i]), kind, rng), *repeat(0, self.steps)], np.int32) for i in of]
        some, labels = np.array(some), np.array([c * len(KINDS) + KINDS.index(kind) for c, kind in groups])
        codes_e, at_e = self._padded(edited)
        found = np.zeros(len(some), bool)
        self.tables: list[list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]] = []
        rates = lambda: np.bincount(labels, found) / np.bincount(labels)
        while self.walks < MAX_WALKS and (self.walks < 2 or rates().min() < recall):
            met, met_e = self.walk(codes, at, self.walks), self.walk(codes_e, at_e, self.walks)
            by_class = []
            for c, (own, _, _, _, steps) in enumerate(self.classes):
                tables = []
                for positions in self.sampled(self.walks, steps):
                    keys = self._keys(met[:, own], positions)
                    sort = np.argsort(keys, kind="stable")
                    tables.append((positions, keys[sort], own[sort]))
                    mine = np.flatnonzero(labels // len(KINDS) == c)
                    found[mine] |= self._keys(met_e[:, mine], positions) == self._keys(met[:, some[mine]], positions)
                by_class.append(tables)
            self.tables.append(by_class)
            self.walks += 1
        by_class = rates().reshape(-1, len(KINDS)).min(axis=1)
        self.whole = by_class < recall  # classes of which all survivors are verified
        self.simulated = float(np.where(self.whole, 1.0, by_class).min())

    def survivors(self, codes: np.ndarray) -> list[np.ndarray]:
        """By class, the places where a window may hold an item within its edits; codes end with width zeros."""
        both = np.zeros(len(codes), bool)
        both[:-1] = (codes[:-1] > 0) & (codes[1:] > 0)
        both[:-1] &= self.pairs[self._slot(codes[:-1], codes[1:])]
        pairs = np.concatenate([[0], np.cumsum(both, dtype=np.int32)])
        some = np.concatenate([[0], np.cumsum(codes > 0, dtype=np.int32)])
        n = len(codes) - self.width
        out = []
        for _, width, need_pairs, need_any, _ in self.classes:
            ok = (pairs[width - 1 : width - 1 + n] - pairs[:n]) >= need_pairs
            out.append(np.flatnonzero(ok & ((some[width : width + n] - some[:n]) >= need_any)))
        return out

    def _slot(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Where a pair of neighbours is marked; two pairs may share a slot, so marks err on the side of searching."""
        return (first.astype(np.uint32) * np.uint32(2654435761) ^ second.astype(np.uint32) * np.uint32(2246822519)) >> np.uint32(32 - PAIR_BITS)

    def candidates(self, codes: np.ndarray) -> np.ndarray:
        """(place, item) pairs that share a key in a table."""
        by_class = self.survivors(codes)
        places = np.unique(np.concatenate(by_class))
        found = []
        for lo in range(0, len(places), 20_000):
            at = places[lo : lo + 20_000]
            of = [np.searchsorted(at, x[(x >= at[0]) & (x <= at[-1])]) for x in by_class]
            for w in range(self.walks):
                met = self.walk(codes, at, w)
                for c, tables in enumerate(self.tables[w]):
                    if self.whole[c] or not len(of[c]):
                        continue
                    for positions, keys, items in tables:
                        mine = self._keys(met[:, of[c]], positions)
                        first, last = np.searchsorted(keys, mine), np.searchsorted(keys, mine, side="right")
                        n = last - first
                        hit = np.flatnonzero(n)
                        if len(hit):
                            which = np.repeat(first[hit], n[hit]) + np.arange(n[hit].sum()) - np.repeat(np.cumsum(n[hit]) - n[hit], n[hit])
                            found.append(np.unique(np.repeat(at[of[c][hit]], n[hit]) * len(self.rows) + items[which]))
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return np.stack([pairs // len(self.rows), pairs % len(self.rows)], axis=1)

    def verified(self, codes: np.ndarray, pairs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(place, item, edits, words) of the pairs within the item's edits; words: in the window of fewest edits, the shortest of them."""
        for c, (own, *_) in enumerate(self.classes):
            mine = pairs[np.isin(pairs[:, 1], own)]
            for lo in range(0, len(mine), 4000):
                place, item = mine[lo : lo + 4000].T
                yield self._distances(codes, place, item)
        if self.whole.any():
            for (own, *_), places in compress(zip(self.classes, self.survivors(codes), strict=True), self.whole):
                step = max(1, 4000 // len(own))
                for lo in range(0, len(places), step):
                    at = places[lo : lo + step]
                    for k in range(0, len(own), 4000):
                        some = own[k : k + 4000]
                        yield self._distances(codes, np.repeat(at, len(some)), np.tile(some, len(at)))

    def _distances(self, codes: np.ndarray, place: np.ndarray, item: np.ndarray):
        size, longest = self.size[item], int(self.size[item].max())
        width = int((self.size[item] + self.edits[item]).max())
        window = codes[place[:, None] + np.arange(width)]
        words = np.full((len(item), longest), -1, np.int32)
        for k in np.unique(item):
            words[item == k, : self.size[k]] = self.rows[k]
        step = np.arange(width + 1, dtype=np.int32)
        row = np.broadcast_to(step, (len(item), width + 1)).copy()
        last = row.copy()
        for i in range(longest):
            new = row + 1
            np.minimum(new[:, 1:], row[:, :-1] + (window != words[:, i : i + 1]), out=new[:, 1:])
            row = np.minimum.accumulate(new - step, axis=1) + step
            ended = size == i + 1
            last[ended] = row[ended]
        end = last.argmin(axis=1)
        edits = last[np.arange(len(item)), end]
        ok = edits <= self.edits[item]
        return place[ok], item[ok], edits[ok], end[ok]


SCHEMA = "doc_id long, item_id long, edits long, item_words long, similarity double, first_word long, last_word long"
_ARROW = pa.schema([(x, pa.float64() if x == "similarity" else pa.int64()) for x in (y.split()[0] for y in SCHEMA.split(", "))])
Found = dict[tuple[int, int], tuple[int, int, int]]


def _whole(item: np.ndarray, part: np.ndarray) -> tuple[int, int, int]:
    """(edits, first, end) of the item against the stretch of part that takes the fewest, then ends first, then is shortest."""

    def last_row(x: np.ndarray, y: np.ndarray, anchored: bool) -> np.ndarray:
        step = np.arange(len(y) + 1)
        row = step.copy() if anchored else np.zeros(len(y) + 1, np.int64)
        for i, w in enumerate(x, 1):
            new = row + 1
            np.minimum(new[1:], row[:-1] + (y != w), out=new[1:])
            new[0] = i
            row = np.minimum.accumulate(new - step) + step
        return row

    row = last_row(item, part, False)
    end = int(row.argmin())
    return int(row[end]), end - int(last_row(item[::-1], part[:end][::-1], True).argmin()), end


def _short(index: Index, codes: np.ndarray, starts: np.ndarray, best: Found) -> None:
    """Items under MIN_WORDS words, word for word."""
    for n, items in index.short.items():
        wanted = np.array(list(items), np.int32)
        known = np.zeros(len(index.codes) + 1, bool)
        known[wanted[:, 0]] = True
        at = np.flatnonzero(known[codes[: len(codes) - n + 1]])
        windows = codes[at[:, None] + np.arange(n)]
        both, which = np.unique(np.concatenate([wanted, windows]), axis=0, return_inverse=True)
        of = np.full(len(both), -1)
        of[which.reshape(-1)[: len(wanted)]] = np.arange(len(wanted))
        hit = of[which.reshape(-1)[len(wanted) :]]
        at, hit = at[hit >= 0], hit[hit >= 0]
        doc = np.searchsorted(starts, at, side="right") - 1
        _, first = np.unique(doc * len(wanted) + hit, return_index=True)
        rows = list(items.values())
        for d, p, h in zip(doc[first].tolist(), at[first].tolist(), hit[first].tolist(), strict=True):
            for item in rows[h]:
                best[d, item] = (0, p - int(starts[d]), n)


def _found(index: Index, words: list[list[bytes]]) -> Found:
    """By (document, item): edits, first word and number of words of the best place."""
    best: Found = {}
    if not index.items:
        return best
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter(map(index.codes.get, chain.from_iterable(words), repeat(0)), np.int32, int(sizes.sum()))
    # documents apart, so that no window or walk reaches the next one
    gap = max(index.width, index.steps) + MIN_WORDS
    starts = np.cumsum(sizes + gap) - sizes - gap
    codes = np.zeros(int((sizes + gap).sum()), np.int32)
    codes[np.arange(len(flat)) + np.repeat(np.arange(len(words)) * gap, sizes)] = flat
    _short(index, codes, starts, best)
    if not index.rows:
        return best
    pairs = index.candidates(codes)
    owner = np.searchsorted(starts, pairs[:, 0], side="right") - 1
    pairs = pairs[pairs[:, 0] - starts[owner] < sizes[owner]]  # none begins between documents
    around: dict[tuple[int, int], list[int]] = defaultdict(list)
    for place, part, edits, n in index.verified(codes, pairs):
        doc = np.searchsorted(starts, place, side="right") - 1
        inside = place - starts[doc] < sizes[doc]
        doc, place, part, edits, n = (x[inside] for x in (doc, place, part, edits, n))
        for d, p, i, e, m in zip(doc.tolist(), (place - starts[doc]).tolist(), part.tolist(), edits.tolist(), n.tolist(), strict=True):
            item = int(index.of[i])
            if index.parts[item] > 1:
                around[d, item].append(p - int(index.offset[i]))
            elif (d, item) not in best or (e, p, m) < best[d, item]:
                best[d, item] = (e, p, m)
    for (d, item), firsts in around.items():
        words_, most, own = index.items[item], index.allowed[item], codes[starts[d] : starts[d] + sizes[d]]
        stretch: list[list[int]] = []
        for p in sorted(set(firsts)):
            lo, hi = max(0, p - most), p + len(words_) + 2 * most
            if stretch and lo <= stretch[-1][1]:
                stretch[-1][1] = hi
            else:
                stretch.append([lo, hi])
        for lo, hi in stretch:
            e, first, end = _whole(words_, own[lo:hi])
            if e <= most and ((d, item) not in best or (e, lo + first) < best[d, item][:2]):
                best[d, item] = (e, lo + first, end - first)
    return best


def _indexes(benchmark: DataFrame, id_col: str, text_col: str) -> list[str]:
    """Files with the indexes of the benchmark's blocks."""
    spark = benchmark.sparkSession
    rows = texts(benchmark, id_col, text_col).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if not size:
        return []
    block = F.pmod(F.xxhash64("id", "text"), F.lit(-(-size // BLOCK_BYTES))).cast("int")
    folder = scratch(spark, "benchmark")

    def write(table: pa.Table) -> pa.Table:
        """The index of a block's items."""
        items = sorted(zip(table.column("id").to_pylist(), table.column("text").to_pylist(), strict=True), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        path = f"{folder}/{table.column('block')[0].as_py():06d}.pickle"
        put_file(path, [pickle.dumps(vars(Index([(k, t.encode()) for k, t in items])))])  # a worker may load the class anew
        return pa.table({"path": pa.array([path], pa.string())})

    made = rows.withColumn("block", block).groupBy("block").applyInArrow(write, "path string")
    return sorted(r.path for r in written(made, f"{folder}-made").collect())  # a row per block


def _blocks(paths: list[str]) -> Iterator[Index]:
    for path in paths:
        files, at = file_system(path)
        with files.open_input_file(at) as f:
            index = Index.__new__(Index)
            vars(index).update(pickle.loads(f.read()))
        yield index


def _each(batches: Iterator[pa.RecordBatch], column: int, paths: list[str]) -> Iterator[tuple[pa.RecordBatch, list[tuple[list, list[int], Found]]]]:
    """Pieces of the batches with what each block finds in them; of several blocks, one is held at a time."""
    released()
    only = list(_blocks(paths)) if len(paths) == 1 else None
    for batch in in_pieces(batches, PIECE_BYTES if only else 16 * PIECE_BYTES):
        found = []
        for index in only or _blocks(paths):
            sizes, lo = [len(x) for x in index.items], 0
            for part in in_pieces(iter([batch]), PIECE_BYTES):
                best = _found(index, [words_in(t) for t in binaries(part, column)])
                found.append((index.ids, sizes, {(lo + d, i): x for (d, i), x in best.items()}))
                lo += part.num_rows
        yield batch, found


def _search(batches: Iterator[pa.RecordBatch], paths: list[str]) -> Iterator[pa.RecordBatch]:
    for batch, found in _each(batches, 1, paths):
        ids = batch.column(0).to_pylist()
        rows = [
            {"doc_id": ids[d], "item_id": names[i], "edits": e, "item_words": sizes[i], "similarity": 1 - e / sizes[i], "first_word": first, "last_word": first + max(m, 1) - 1}
            for names, sizes, best in found
            for (d, i), (e, first, m) in best.items()
        ]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def find_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document and item found in it, in columns of SCHEMA; words are counted from 0, both ends included."""
    return texts(docs, id_col, text_col).mapInArrow(partial(_search, paths=_indexes(benchmark, item_id_col, item_text_col)), SCHEMA)


def without_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, in which no item is found. Each row is decided where it is read, so no text is shuffled.

    A row without id is kept: what was found couldn't name it.
    """
    small_batches(docs.sparkSession)
    column, own = docs.columns.index(text_col), docs.columns.index(id_col)
    paths = _indexes(benchmark, item_id_col, item_text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _each(batches, column, paths):
            gone = {d for _, _, best in found for d, _ in best}
            yield batch.filter(pa.array([k is None or d not in gone for d, k in enumerate(batch.column(own).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

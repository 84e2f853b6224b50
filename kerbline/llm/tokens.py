"""Token ids of whole texts, and files of them in Simple-8b words.

A file is a sequence of blocks. Each 64-bit word has a selector in its top 4 bits and 60 bits of payload: selector k
packs COUNTS[k] ids of BITS[k] bits, lowest first; selector ESCAPE announces one id of up to 64 bits in the next word.
A block holds up to BLOCK ids; its first word and the number of ids before it stand in the file's index, so blocks are
decoded independently, all words of one selector at once. File: MAGIC, numbers of documents, ids, blocks and words
(little-endian 64-bit), document ids, validity bytes, id counts, block index, words.

Documents are dealt to files by ranges of their id and sorted, so the files in order hold the documents in ascending
order. Defined cases: a null or empty text has its end id only; null ids come first; documents with one id are
ordered by text (null first); an empty table writes no file and reads back empty; other columns are not looked at.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binaries, file_system, in_pieces, kept, put_file, released, shards, texts, written

COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 15
BLOCK = 1024
MAGIC = b"S8B1\0\0\0\0"
#: Bytes of what an encoder keeps of words met; each counts as its own bytes, those of its ids and _PER_WORD.
_KEPT, _PER_WORD = 96 << 20, 200
_FLUSH = 1 << 22

# The tokenizer's own pattern; plain words go to its model directly, all others through the whole tokenizer.
_PLAIN = regex.compile(r"[\x21-\x7E¡-¬®-įı-ǃ]+")
#: Bytes that begin characters from U+0300 on.
_MARKS = bytes(range(0xCC, 0x100))
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: itself where printable, else the next from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class _Numbers(dict):
    """Numbers words as they come; fresh: those not asked for before."""

    def __init__(self) -> None:
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


class _Parts(dict):
    """Packed ids of words' lower-case parts as the library's model has them; held while one batch's words are learnt."""

    def __init__(self, model) -> None:
        self.model, self.letters = model, _byte_letters()

    def __missing__(self, part: str) -> bytes:
        text = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
        ids = self[part] = _packed([t.id for t in self.model.tokenize(text)])
        return ids


def _folded(text: bytes) -> bytes:
    """A text with A-Z in lower case, where that changes none of its ids: it holds no special token and no combining mark."""
    marks = not text.isascii() and len(text.translate(None, _MARKS)) < len(text)
    return text if marks or b"<|" in text else text.lower()


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class Encoder:
    """Ids of whole texts by a file of the tokenizers library, add_special_tokens=False.

    White space separates words for this tokenizer, so a text's ids are those of its words in a row, and a word's ids are
    kept while a task meets it again. A word of plain characters is in normal form but for its case: its parts go to the
    library's BPE model; any other word, and one that may hold a special token, goes through the library's whole encoder.
    """

    def __init__(self, path: str, most: int | None = None) -> None:
        """most: bytes of the words kept, _KEPT unless given."""
        from tokenizers import Tokenizer

        self.most = most
        self.tokenizer = Tokenizer.from_file(path)
        self.direct = self._words_apart()
        self.number, self.parts = _Numbers(), _Parts(self.tokenizer.model)
        self.flat, self.first, self.size, self.n, self.m = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0, 0
        self.met = np.zeros(1 << 14, np.int64)  # how often each word was met, halved whenever words are forgotten
        self.weight = 0

    def forget(self) -> None:
        """Keeps the more frequent half of the words, of those met more than once."""
        often = np.argsort(-self.met[: self.n], kind="stable")[: self.n // 2]
        keep = np.sort(often[self.met[often] > 1])
        size, first = self.size[keep], self.first[keep]
        ends = np.cumsum(size)
        flat = self.flat[np.arange(int(size.sum())) + np.repeat(first - ends + size, size)]
        words, self.number = list(self.number), _Numbers()
        for k in keep.tolist():
            self.number[words[k]] = len(self.number)
        self.n, self.m = len(keep), len(flat)
        self.flat[: self.m], self.first[: self.n], self.size[: self.n] = flat, ends - size, size
        self.met[: self.n] = self.met[keep] // 2
        self.weight = sum(map(len, self.number)) + 4 * self.m + _PER_WORD * self.n

    def _words_apart(self) -> bool:
        """Whether this tokenizer is of the kind described: else every text goes through the whole encoder."""
        import json

        kind = json.loads(self.tokenizer.to_str())
        normal = [x.get("type") for x in (kind.get("normalizer") or {}).get("normalizers", [])]
        split = (kind.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        pattern = split[0].get("pattern", {}).get("Regex")
        return normal == ["NFC", "Replace", "Lowercase"] and pattern == _PARTS.pattern and split[0].get("behavior") == "Removed" and kind["model"].get("end_of_word_suffix") == "</w>"

    def _word(self, word: str) -> bytes | None:
        plain, parts = word.isascii() or _PLAIN.fullmatch(word), self.parts
        if plain and word.isalpha():
            return parts[word.lower()]
        if plain and word[-1] in ".," and (stem := word[:-1]).isalpha():
            return parts[stem.lower()] + parts[word[-1]]
        if not plain or "<|" in word or not _PLAIN.fullmatch(word):
            return None
        return b"".join([parts[x] for x in _PARTS.findall(word.lower())])

    def _learn(self, words: list[bytes]) -> None:
        texts = [w.decode() for w in words]
        got = list(map(self._word, texts))
        odd = [i for i, x in enumerate(got) if x is None]
        for i, e in zip(odd, self.tokenizer.encode_batch([texts[i] for i in odd], add_special_tokens=False), strict=True):
            got[i] = _packed(e.ids)
        self.parts.clear()
        size = np.fromiter(map(len, got), np.int64, len(got)) // 4
        flat = np.frombuffer(b"".join(got), np.uint32)
        while self.m + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(got) > len(self.first):
            self.first, self.size, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size, self.met))
        self.flat[self.m : self.m + len(flat)] = flat
        self.first[self.n : self.n + len(got)] = self.m + np.cumsum(size) - size
        self.size[self.n : self.n + len(got)] = size
        self.met[self.n : self.n + len(got)] = 0
        self.n, self.m = self.n + len(got), self.m + len(flat)
        self.weight += sum(map(len, words)) + 4 * len(flat) + _PER_WORD * len(words)

    def __call__(self, texts: list[bytes | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all UTF-8 texts in a row, each followed by end; number of ids of each text, with its end)."""
        if not self.direct:
            got = [np.array([*e.ids, end], np.uint32) for e in self.tokenizer.encode_batch([(t or b"").decode() for t in texts], add_special_tokens=False)]
            return np.concatenate(got or [np.zeros(0, np.uint32)]), np.array([len(x) for x in got], np.int64)
        if self.weight > (self.most or _KEPT):
            self.forget()
        # bytes.split knows the ASCII blanks only, which end a word for the tokenizer too
        words = [_folded(t).split() if t else [] for t in texts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        if self.number.fresh:
            self._learn(self.number.fresh)
            self.number.fresh = []
        self.met[: self.n] += np.bincount(at, minlength=self.n)
        size = self.size[at]
        ends = np.cumsum(size)
        before = ends - size
        total = int(ends[-1]) if len(ends) else 0
        place = np.arange(total) + np.repeat(self.first[at] - before, size)
        of_text = np.concatenate([[0], ends])[np.cumsum(counts)]  # ids up to each text's end
        lengths = np.diff(np.concatenate([[0], of_text])) + 1
        out = np.empty(total + len(words), np.uint32)
        stops = np.cumsum(lengths) - 1
        inside = np.ones(len(out), bool)
        inside[stops] = False
        out[stops] = end
        out[inside] = self.flat[place]
        return out, lengths


def kept_encoder(path: str, most: int | None = None) -> Encoder:
    """The worker's encoder for path and a bound of the words it keeps; it stays for the tasks to come."""
    return kept(f"{path} {most}", lambda: Encoder(path, most))


def encode_ids(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block of BLOCK ids) of unsigned ids; all blocks advance together."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.arange(0, n, BLOCK)
    stop = np.minimum(at + BLOCK, n)
    # by place, the first selector whose bits hold the id; behind every block, so many that hold nothing that no word reaches over
    rows, reach = len(at), COUNTS[0]
    need = np.full((rows, BLOCK + reach), ESCAPE, np.uint8)
    held = np.zeros(rows * BLOCK, np.uint8)
    for bits in BITS:
        held[:n] += ids >= 1 << bits
    held[n:] = ESCAPE
    need[:, :BLOCK] = held.reshape(rows, BLOCK)
    need = need.ravel()
    # by place, the selector of a word that begins there: the one that packs most. widest[j] looks at the 2**j ids from there on
    widest = [need]
    for j in range(reach.bit_length() - 1):
        widest.append(np.maximum(widest[j], np.append(widest[j][1 << j :], np.full(1 << j, ESCAPE, np.uint8))))
    best = np.where(need < len(BITS), len(BITS) - 1, ESCAPE).astype(np.uint8)
    for k in range(len(COUNTS) - 2, -1, -1):
        # what fits fewer bits fits more, so later selectors may overwrite
        j = COUNTS[k].bit_length() - 1
        more = COUNTS[k] - (1 << j)
        fits = widest[j] <= k
        fits[: len(fits) - more] &= widest[j][more:] <= k
        if not fits.any():
            break
        best[fits] = k
    best = best.reshape(rows, BLOCK + reach)[:, :BLOCK].ravel()[:n]
    ahead = np.array([*COUNTS, 0, 1], np.uint8)[best]
    starts = []
    while len(at):
        starts.append(at)
        at = at + ahead[at]
        more = at < stop
        at, stop = at[more], stop[more]
    at = np.sort(np.concatenate(starts))
    chosen = best[at]
    size = np.where(chosen == ESCAPE, 2, 1)
    ends = np.cumsum(size)
    words = np.zeros(int(ends[-1]), np.uint64)
    slot = ends - size
    for k in np.unique(chosen):
        own = chosen == k
        if k == ESCAPE:
            words[slot[own]] = ESCAPE << 60
            words[slot[own] + 1] = ids[at[own]]
            continue
        rows = ids[at[own][:, None] + np.arange(COUNTS[k])] << (np.arange(COUNTS[k]) * BITS[k]).astype(np.uint64)
        words[slot[own]] = np.bitwise_or.reduce(rows, axis=1) | np.uint64(int(k) << 60)
    return words, slot[np.searchsorted(at, np.arange(0, n, BLOCK))]


def decode_words(words: np.ndarray) -> np.ndarray:
    """The ids in words, which begin at a block's start."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    # the word after an escape is an id whatever its top bits are; escapes in a row of raw words are told apart from the left
    maybe = np.flatnonzero(selector == ESCAPE)
    raw = np.zeros(len(words), bool)
    for i in maybe:
        if not raw[i]:
            raw[i + 1] = True
    counts = np.array([*COUNTS, 0, 0])[selector]
    counts[raw] = 1
    first = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for k in np.unique(selector[~raw]):
        if k == ESCAPE:
            continue
        own = np.flatnonzero((selector == k) & ~raw)
        rows = (words[own][:, None] >> (np.arange(COUNTS[k]) * BITS[k]).astype(np.uint64)) & np.uint64((1 << BITS[k]) - 1)
        out[first[own][:, None] + np.arange(COUNTS[k])] = rows
    out[first[raw]] = words[raw]
    return out


def file_bytes(doc_ids: list[int | None], lengths: np.ndarray, ids: Iterator[np.ndarray]) -> Iterator[bytes]:
    """A file's bytes; ids come in runs of whole blocks but for the last."""
    packed, index, n, words = [], [], 0, 0
    for part in ids:
        w, first = encode_ids(part)
        index.append(first + words)
        packed.append(w.astype("<u8").tobytes())
        n, words = n + len(part), words + len(w)
    index = np.concatenate(index) if index else np.zeros(0, np.int64)
    yield MAGIC + struct.pack("<4q", len(doc_ids), n, len(index), words)
    yield np.array([k or 0 for k in doc_ids], "<i8").tobytes() + bytes(k is not None for k in doc_ids)
    yield np.asarray(lengths, "<i8").tobytes() + index.astype("<i8").tobytes()
    yield from packed


def read_file(f) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
    """Groups of (document ids, ids of each) from an open token file, a few blocks at a time."""
    if f.read(8) != MAGIC:
        raise ValueError("not a token file")
    docs, n, blocks, words = struct.unpack("<4q", f.read(32))
    keys = np.frombuffer(f.read(8 * docs), "<i8")
    valid = np.frombuffer(f.read(docs), np.uint8)
    lengths = np.frombuffer(f.read(8 * docs), "<i8")
    index = np.append(np.frombuffer(f.read(8 * blocks), "<i8"), words)
    doc, held = 0, np.zeros(0, np.uint64)
    for b in range(0, blocks, 256):
        hi = min(b + 256, blocks)
        held = np.concatenate([held, decode_words(np.frombuffer(f.read(8 * int(index[hi] - index[b])), "<u8"))])
        ends = np.cumsum(lengths[doc : doc + len(held) + 1])
        whole = int(np.searchsorted(ends, len(held), side="right"))
        if whole:
            yield [int(k) if v else None for k, v in zip(keys[doc : doc + whole], valid[doc : doc + whole], strict=True)], np.split(held[: ends[whole - 1]], ends[: whole - 1])
            doc, held = doc + whole, held[ends[whole - 1] :]
    if doc != docs or len(held):
        raise ValueError("ids and documents don't agree")


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, end: int) -> Iterator[pa.RecordBatch]:
    """Files of about _FLUSH ids each, so that a task holds one."""
    encoder, part, k = kept_encoder(path), TaskContext.get().partitionId(), 0
    keys, lengths, runs, size = [], [], [], 0

    def file():
        name = f"{folder}/{part:06d}-{k:06d}.s8b"
        ids = np.concatenate(runs)
        n = put_file(name, file_bytes(keys, np.concatenate(lengths), (ids[i : i + 256 * BLOCK] for i in range(0, len(ids), 256 * BLOCK))))
        return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": pa.array([k], pa.int32()), "path": [name], "ids": pa.array([len(ids)], pa.int64()), "docs": pa.array([len(keys)], pa.int64()), "bytes": pa.array([n], pa.int64())})

    for batch in in_pieces(batches, 1 << 20):
        ids, n = encoder(binaries(batch, 1), end)
        keys += batch.column(0).to_pylist()
        lengths.append(n)
        runs.append(ids)
        size += len(ids)
        if size >= _FLUSH:
            yield file()
            keys, lengths, runs, size, k = [], [], [], 0, k + 1
    if keys:
        yield file()


def write_ids(docs: DataFrame, folder: str, path: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of docs below folder in ascending order of document ids; returns (path, start, ids, docs, bytes) of the files."""
    rows = texts(docs, id_col, text_col)
    dealt = rows.repartitionByRange(shards(rows), "id").sortWithinPartitions("id", "text")
    files = written(dealt.mapInArrow(partial(_write, folder=folder, path=path, end=end), "part int, file int, path string, ids long, docs long, bytes long"), f"{folder}-files")
    before = F.sum("ids").over(Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1))  # a row per file
    return written(files.select("path", F.coalesce(before, F.lit(0)).alias("start"), "ids", "docs", "bytes"), f"{folder}-index")


def read_ids(files: DataFrame, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) and with ids also ids, of every document in the files of write_ids."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, at = file_system(path)
                with system.open_input_stream(at, compression=None) as f:
                    for keys, parts in read_file(f):
                        size = np.array([len(p) for p in parts], np.int64)
                        first = start + np.cumsum(size) - size
                        start += int(size.sum())
                        crc = [zlib.crc32(p.astype("<u4").tobytes()) for p in parts]
                        out = [pa.array(keys, pa.int64()), pa.array(first), pa.array(size), pa.array(crc, pa.int64())]
                        yield pa.RecordBatch.from_arrays(out + ([pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64()))] if ids else []), names=names)

    n = max(1, files.count())
    return files.select("path", "start").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)

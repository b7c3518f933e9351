"""Token ids in files, coded by a static range asymmetric numeral system (rANS).

A file holds the ids of whole documents, in ascending order of doc_id over all files. Its ids are cut into blocks of
BLOCK ids that are coded independently with one frequency table for the whole file (scaled to 2**SCALE). Within a block
LANES states are interleaved: id i belongs to lane i mod LANES. A state x in [2**31, 2**63) takes symbol s of frequency
f and cumulated frequency c as ``x -> (x // f << SCALE) + x % f + c``, after the low 32 bits of a state of f * 2**43 or
more went to the block's words. Words are stored in the order the decoder needs them. The block table is the list of
checkpoints for parallel decoding: for each block its first word, number of ids, CRC-32 of the ids and LANES states.
Many blocks are coded and decoded at once as rows of arrays.

Layout, little-endian: ``PLT1``, words of all blocks (u32), zlib-packed frequency table (u32 id, u32 frequency), zlib-
packed block table, zlib-packed document table (i64 doc_id, u8 null mark, u32 tokens), then the four lengths and
counts and ``PLT1`` again. Files are written to the shared folder under a new name for each attempt; the index, a table
with a row for each file, names those that count.

Encoding is the tokenizers library's, word by word: the tokenizer drops white space, and no id spans it, so the ids of
a text are those of its words split at ASCII white space. Texts of about TEXTS bytes are split together as Arrow arrays,
each of their distinct words is encoded once, and the ids are strung together by the words' numbers. A task remembers
MEMO word parts at most.

Defined cases: a null or empty text has only the end id; repeated rows are repeated documents, ordered by text; a null
doc_id sorts first; an empty table gives no files and no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import clashing, cut, file_system, longs, new_folder

SCALE, LANES, BLOCK, TOGETHER = 20, 32, 16_384, 64
FILE_IDS, TEXTS, MEMO, END = 4_000_000, 8_000_000, 400_000, 1
INDEX = "file string, first_doc long, first_null boolean, place int, ids long, docs long"
MAGIC = b"PLT1"
_LOW = np.uint64(2**31)
_DOC = [("id", "<i8"), ("null", "u1"), ("n", "<u4")]
#: Letters of ASCII and Latin-1 that are one code point in every normal form, with the signs of ASCII: on words of these
#: alone the tokenizer's normaliser and splitting are the two lines below.
_PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
_PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
#: Byte-level BPE writes a byte that has no visible Latin-1 sign as a code point from 256 on.
_SEEN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_SIGN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SEEN)}


class Words:
    """ids of words (as bytes), by the library; `parts` remembers the pieces that plain words are made of."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parts: dict[str, bytes] = {}
        # only this normaliser and pre-tokenizer are known to act on a plain word as _PART does
        shape = (str(self.tokenizer.normalizer) + str(self.tokenizer.pre_tokenizer)).replace("\\\\", "\\")
        self.plain = "Lowercase()" in shape and "ByteLevel" in shape and r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in shape

    def part(self, text: str) -> bytes:
        ids = self.parts.get(text)
        if ids is None:
            if len(self.parts) >= MEMO:
                self.parts.clear()
            spelled = text if text.isascii() else text.encode().decode("latin-1").translate(_SIGN)
            ids = self.parts[text] = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return ids

    def word(self, text: str) -> bytes:
        if self.plain and text.isascii() and text.isalpha():
            return self.part(text.lower())
        if self.plain and "<|" not in text and _PLAIN.fullmatch(text):
            return b"".join(map(self.part, _PART.findall(text.lower())))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def encode_texts(texts: pa.Array, memo: Words, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts (not null), each with the end id, one after the other, and how many each has."""
    split = pc.ascii_split_whitespace(texts)
    words = split.flatten().dictionary_encode()
    coded = [memo.word(w) for w in words.dictionary.to_pylist()] + [struct.pack("<I", end)]
    n = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
    flat, first = np.frombuffer(b"".join(coded), "<u4"), np.cumsum(n) - n
    # the end id is a word too, after the last one of each text
    of = np.diff(split.offsets.to_numpy()).astype(np.int64)
    ends = np.cumsum(of + 1) - 1
    places = np.full(len(words) + len(texts), len(coded) - 1, np.int32)
    places[np.delete(np.arange(len(places)), ends)] = words.indices.to_numpy()
    k = n[places]
    ids = flat[np.arange(int(k.sum())) + np.repeat(first[places] - (np.cumsum(k) - k), k)]
    return ids, np.diff(np.cumsum(k)[ends], prepend=0)


def scaled(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that occur and their frequencies, at least 1 each, with the sum 2**SCALE."""
    count = np.bincount(ids)
    symbols = np.flatnonzero(count)
    count = count[symbols]
    freq = np.maximum(1, count * (2**SCALE - len(symbols)) // max(1, count.sum()))
    freq[np.argmax(freq)] += 2**SCALE - freq.sum()
    return symbols.astype(np.uint32), freq.astype(np.int64)


def _grid(ids: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """blocks x steps x lanes, and the number of ids in each block."""
    n = np.minimum(BLOCK, len(ids) - np.arange(0, len(ids), BLOCK))
    out = np.full(len(n) * BLOCK, pad, np.int32)
    out[: len(ids)] = ids
    return out.reshape(len(n), BLOCK // LANES, LANES), n


def encode_blocks(ids: np.ndarray, symbols: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all blocks, words in each block, ids in each block, and states (blocks x LANES)."""
    places = np.zeros(int(symbols[-1]) + 1 if len(symbols) else 1, np.int32)
    places[symbols] = np.arange(len(symbols))
    place = places[ids]
    f, start = freq.astype(np.uint64), np.r_[0, np.cumsum(freq)[:-1]].astype(np.uint64)
    words_out, counts, sizes, states = [], [], [], []
    for at in range(0, len(ids), BLOCK * TOGETHER):
        grid, n = _grid(place[at : at + BLOCK * TOGETHER], int(np.argmax(freq)))
        steps = -(-int(n.max()) // LANES)
        x = np.full((len(n), LANES), _LOW, np.uint64)
        low = np.zeros((len(n), steps, LANES), np.uint32)
        out = np.zeros((len(n), steps, LANES), bool)
        last = -(-n // LANES)
        for t in range(steps - 1, -1, -1):
            s = grid[:, t]
            fs, on = f[s], (t < last)[:, None]
            over = (x >= fs << np.uint64(63 - SCALE)) & on
            low[:, t], out[:, t] = x.astype(np.uint32), over
            y = np.where(over, x >> np.uint64(32), x)
            q = y // fs
            x = np.where(on, (q << np.uint64(SCALE)) + (y - q * fs) + start[s], x)
        words_out.append(low[out])
        counts.append(out.sum((1, 2)))
        sizes.append(n)
        states.append(x)
    if not words_out:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, LANES), np.uint64)
    return np.concatenate(words_out), np.concatenate(counts), np.concatenate(sizes), np.concatenate(states)


def decode_blocks(coded: np.ndarray, first: np.ndarray, sizes: np.ndarray, states: np.ndarray, symbols: np.ndarray, freq: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The ids of some blocks: first word of each in coded, ids in each, states; slots: symbol place of each slot."""
    f, start = freq.astype(np.uint64), np.r_[0, np.cumsum(freq)[:-1]].astype(np.uint64)
    x, at = states.copy(), first.astype(np.int64)
    last, steps = -(-sizes // LANES), -(-int(sizes.max()) // LANES)
    out = np.zeros((len(sizes), steps, LANES), np.uint32)
    padded = np.append(coded, np.uint32(0)).astype(np.uint64)
    for t in range(steps):
        slot = x & np.uint64(2**SCALE - 1)
        s = slots[slot.astype(np.int64)]
        out[:, t] = s
        y = f[s] * (x >> np.uint64(SCALE)) + slot - start[s]
        on = (t < last)[:, None]
        need = (y < _LOW) & on
        take = np.cumsum(need, 1)
        word = padded[np.minimum(at[:, None] + take - 1, len(padded) - 1) * need]
        x = np.where(on, np.where(need, y << np.uint64(32) | word, y), x)
        at = at + take[:, -1]
    flat = out.reshape(len(sizes), -1)
    return symbols[np.concatenate([flat[i, :n] for i, n in enumerate(sizes)])]


def to_file(docs: np.ndarray, ids: np.ndarray) -> bytes:
    """A file of documents, as rows of _DOC, and their ids."""
    symbols, freq = scaled(ids)
    coded, counts, sizes, states = encode_blocks(ids, symbols, freq)
    sums = [zlib.crc32(ids[i * BLOCK : i * BLOCK + n].astype("<u4").tobytes()) for i, n in enumerate(sizes)]
    table = np.empty(len(symbols), [("id", "<u4"), ("f", "<u4")])
    table["id"], table["f"] = symbols, freq
    block = np.empty(len(sizes), [("first", "<u8"), ("n", "<u4"), ("crc", "<u4"), ("x", "<u8", LANES)])
    block["first"], block["n"], block["crc"], block["x"] = np.cumsum(counts) - counts, sizes, sums, states
    tables = [zlib.compress(t.tobytes(), 1) for t in (table, block, docs)]
    return MAGIC + coded.astype("<u4").tobytes() + b"".join(tables) + struct.pack("<7Q", len(coded), *map(len, tables), len(symbols), len(sizes), len(docs)) + MAGIC


class Reader:
    """Tables of an open file, and its ids from any block on."""

    def __init__(self, f):
        self.f = f
        size = f.size()
        f.seek(size - 60)
        tail = f.read(60)
        if tail[-4:] != MAGIC:
            raise ValueError("not a token file")
        self.words, a, b, c, *_ = struct.unpack("<7Q", tail[:56])
        f.seek(4 + 4 * self.words)
        raw = f.read(a + b + c)
        table, block, doc = (zlib.decompress(raw[i:j]) for i, j in ((0, a), (a, a + b), (a + b, a + b + c)))
        table = np.frombuffer(table, [("id", "<u4"), ("f", "<u4")])
        self.symbols, self.freq = table["id"].copy(), table["f"].astype(np.int64)
        self.blocks = np.frombuffer(block, [("first", "<u8"), ("n", "<u4"), ("crc", "<u4"), ("x", "<u8", LANES)])
        self.docs = np.frombuffer(doc, _DOC)
        self.slots = np.repeat(np.arange(len(self.freq), dtype=np.int32), self.freq)

    def ids(self, first: int = 0, last: int | None = None) -> Iterator[np.ndarray]:
        """The ids of blocks first..last-1, TOGETHER blocks at a time; checksums are compared."""
        last = len(self.blocks) if last is None else last
        for at in range(first, last, TOGETHER):
            some = self.blocks[at : min(at + TOGETHER, last)]
            begin = int(some["first"][0])
            end = int(self.blocks["first"][at + len(some)]) if at + len(some) < len(self.blocks) else self.words
            self.f.seek(4 + 4 * begin)
            coded = np.frombuffer(self.f.read(4 * (end - begin)), "<u4")
            sizes = some["n"].astype(np.int64)
            out = decode_blocks(coded, some["first"].astype(np.int64) - begin, sizes, some["x"].astype(np.uint64), self.symbols, self.freq, self.slots)
            place = 0
            for n, crc in zip(sizes, some["crc"], strict=True):
                if zlib.crc32(out[place : place + n].astype("<u4").tobytes()) != crc:
                    raise ValueError("a block's checksum differs")
                place += n
            yield out


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END) -> DataFrame:
    """Writes docs(doc_id, text) to files in folder; returns the index, a row for each file."""
    docs = clashing(docs, ["doc_id", "text"]).withColumn("doc_id", F.col("doc_id").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = file_system(folder)
        fs.create_dir(at, recursive=True)
        memo, heads, wait, size, place = Words(tokenizer_path), [], [], 0, 0

        def save() -> pa.RecordBatch:
            name, docs = f"{uuid.uuid4().hex}.plt", np.concatenate(heads)
            with fs.open_output_stream(f"{at}/{name}", compression=None) as f:
                f.write(to_file(docs, np.concatenate(wait)))
            return pa.record_batch([[name], pa.array(docs["id"][:1]), pa.array(docs["null"][:1] > 0), pa.array([place], pa.int32()), [size], [len(docs)]], [c.split()[0] for c in INDEX.split(", ")])

        for b in batches:
            texts = pc.fill_null(b.column("text"), "")
            ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
            begin = 0
            while begin < len(ends):
                end = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + TEXTS)) + 1
                some = b.column("doc_id")[begin:end]
                ids, n = encode_texts(texts[begin:end], memo, end_id)
                head = np.empty(len(some), _DOC)
                head["id"], head["null"], head["n"] = pc.fill_null(some, 0).to_numpy(), some.is_null().to_numpy(zero_copy_only=False), n
                heads.append(head)
                wait.append(ids)
                size, begin = size + len(ids), end
                if size >= FILE_IDS:
                    yield save()
                    heads, wait, size, place = [], [], 0, place + 1
        if heads:
            yield save()

    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.col("text").isNull().desc(), "text")
    return cut(ordered.mapInArrow(run, INDEX), "token-index")


def placed(index: DataFrame) -> DataFrame:
    """The index with `before`, the ids of all files before each one. A row is a file of millions of ids, so this running
    sum is short."""
    from pyspark.sql import Window

    before = Window.orderBy(F.col("first_null").desc(), "first_doc", "place").rowsBetween(Window.unboundedPreceding, -1)
    return index.withColumn("before", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read(index: DataFrame, folder: str) -> DataFrame:
    """doc_id, file, start, n_tokens, ids_crc32 of each document of the files in an index with `before`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, at = file_system(folder)
        for b in batches:
            for name, before in zip(b["file"], b["before"], strict=True):
                with fs.open_input_file(f"{at}/{name}") as f:
                    reader = Reader(f)
                    ends = np.cumsum(reader.docs["n"].astype(np.int64))
                    sums, doc, done, crc = np.zeros(len(ends), np.int64), 0, 0, 0
                    for ids in reader.ids():
                        raw, begin = memoryview(ids.astype("<u4").tobytes()), done
                        done += len(ids)
                        while doc < len(ends) and ends[doc] <= done:
                            stop = 4 * (int(ends[doc]) - begin)
                            start = 4 * max(0, (int(ends[doc - 1]) if doc else 0) - begin)
                            sums[doc], crc = zlib.crc32(raw[start:stop], crc), 0
                            doc += 1
                        if doc < len(ends):
                            crc = zlib.crc32(raw[4 * max(0, (int(ends[doc - 1]) if doc else 0) - begin) :], crc)
                n = reader.docs["n"].astype(np.int64)
                ids = pd.Series(reader.docs["id"].astype(np.int64), dtype="Int64").mask(reader.docs["null"].astype(bool))
                yield pd.DataFrame({"doc_id": ids, "file": name, "start": before + ends - n, "n_tokens": n, "ids_crc32": sums})

    return _spread(index.select("file", "before")).mapInPandas(run, "doc_id long, file string, start long, n_tokens long, ids_crc32 long")


def _spread(files: DataFrame) -> DataFrame:
    """Files over all tasks; a count keeps adaptive execution from joining these small rows, large work, in one task."""
    return files.repartition(max(2, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def token_ids(index: DataFrame, folder: str) -> DataFrame:
    """doc_id and ids (array of long) of each document; the texts' ids as they were written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, at = file_system(folder)
        for b in batches:
            for name in b["file"]:
                with fs.open_input_file(f"{at}/{name}") as f:
                    reader = Reader(f)
                    wait, doc = np.zeros(0, np.uint32), 0
                    for ids in reader.ids():
                        wait, out = np.concatenate([wait, ids]), []
                        while doc < len(reader.docs) and reader.docs["n"][doc] <= len(wait):
                            n = int(reader.docs["n"][doc])
                            out.append((None if reader.docs["null"][doc] else int(reader.docs["id"][doc]), wait[:n].astype(np.int64)))
                            wait, doc = wait[n:], doc + 1
                        yield pd.DataFrame({"doc_id": longs(d for d, _ in out), "ids": [x for _, x in out]})

    return _spread(index.select("file")).mapInPandas(run, "doc_id long, ids array<long>")


def round_trip(docs: DataFrame, tokenizer_path: str, folder: str | None = None) -> DataFrame:
    """Writes docs and reads the files back: doc_id, start, n_tokens, ids_crc32."""
    folder = folder or new_folder(docs.sparkSession, "tokens")
    return read(placed(write(docs, folder, tokenizer_path)), folder).select("doc_id", "start", "n_tokens", "ids_crc32")

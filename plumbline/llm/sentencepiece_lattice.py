"""SentencePiece encoding over a relational lattice, and decoding.

A text gets the dummy prefix, spaces become U+2581, and it is cut before every run of U+2581 and wherever no piece holds
the two neighbouring characters: no piece crosses there, so the units between are encoded on their own.

A chunk is some whole documents of a partition, about CHUNK bytes. Its distinct units are numbered, and a file in the
shared folder keeps them and each document's unit numbers; texts are read once and never shuffled. The distinct units of all chunks are then encoded once: their substrings of bounded length are exploded and
equi-joined to the piece table (a vocabulary file, at most MAX_PIECES rows, broadcast), the matching edges are grouped by
unit, and a higher-order `aggregate` folds them. The result is one long for each unit, the bit mask of piece boundaries,
which goes back to the chunks that hold the unit; there the ids of units are put together, and from them the documents'.
A unit that is in every chunk has one light row for each, some ten million at 100 TB.

The fold depends on the model's type. A unigram model takes the Viterbi path: by position, the best score and the
start of the last piece. A BPE model's ids are not a best path under its scores, so a Viterbi fold would give other ids
than the model's own encoder; for BPE the same edges are folded by merges: at each step the edge of the best score
among those that span two neighbouring symbols removes the boundary inside, leftmost first among equals.

Units of more than LONG characters (no mask fits) are merged where the chunk is put together, by the same rule with a
heap. The file of a chunk is new for every attempt of a task and travels, as one more row, with its units through the
same shuffle, so a chunk's units and its file are always of one attempt; a chunk that lacks a row is an error. So docs
has to come back in the same order when a lost executor's part is read again, as a written table does.

A document's `round_trip` follows from its units: the ids of each one spell it again, and the text has no U+2581.

Defined cases: null and empty texts have no ids and decode to ""; characters outside the vocabulary become byte pieces,
or the unknown id if the model has none; U+2581 in a text decodes to a space; repeated rows each get a row; null ids
pass through; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import struct
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import clashing, file_system, keys, longs, new_folder, ship

SPACE = "▁"
CHUNK, LONG = 16_000_000, 62
#: Bytes of text that are split at once, distinct words that are cut at once, words or units that are strung at once.
STEP, WORDS, STRUNG = 2_000_000, 50_000, 500_000
#: Groups that Spark's aggregate of edges holds before it sorts instead; a group is a unit's few edges.
GROUPS = 100_000
MAX_PIECES = 1_000_000
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Model:
    """Pieces, scores and kinds of a SentencePiece model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            proto = pb.ModelProto.FromString(f.read())
        if len(proto.pieces) > MAX_PIECES:
            raise ValueError(f"{len(proto.pieces)} pieces; the join is made for {MAX_PIECES} at most")
        kind = pb.ModelProto.SentencePiece
        self.bpe = proto.trainer_spec.model_type == pb.TrainerSpec.BPE
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces or not (self.bpe or proto.trainer_spec.model_type == pb.TrainerSpec.UNIGRAM):
            raise ValueError("only BPE and unigram models with the identity normaliser are read")
        self.pieces = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type == kind.NORMAL}
        self.bytes = {int(p.piece[3:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == kind.BYTE}
        self.unknown = next((i for i, p in enumerate(proto.pieces) if p.type == kind.UNKNOWN), 0)
        self.longest = max(map(len, self.pieces), default=1)
        self.least = min((s for _, s in self.pieces.values()), default=0.0)
        order = sorted({s for _, s in self.pieces.values()}, reverse=True)
        place = {s: r for r, s in enumerate(order)}
        self.rank = {p: place[s] for p, (_, s) in self.pieces.items() if len(p) > 1}
        joins = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        known = sorted(set("".join(joins)))
        #: Number of each character that stands beside another one in a piece (0: none), and which two do.
        self.kinds = np.zeros(0x110000, np.int32)
        self.kinds[list(map(ord, known))] = np.arange(1, len(known) + 1)
        self.joined = np.zeros((len(known) + 1, len(known) + 1), bool)
        self.joined[self.kinds[[ord(x[0]) for x in joins]], self.kinds[[ord(x[1]) for x in joins]]] = True
        # texts whose spaces stand alone can be split at them; a line end then begins a word of its own
        self.plain = self.prefix and not any("\n" in x for x in joins)
        self.out: list[bytes] = [b""] * len(proto.pieces)
        for p, (i, _) in self.pieces.items():
            self.out[i] = p.replace(SPACE, " ").encode()
        for value, i in self.bytes.items():
            self.out[i] = bytes([value])
        self.out[self.unknown] = " ⁇ ".encode()

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """The words of texts (not null), cut before every run of U+2581 and, where no piece crosses one, before line ends:
        the order in which they are given, their words one after the other, and how many each has. `word` gives a word
        in full. Texts whose spaces stand alone are split as arrays, the others one by one."""
        odd = [pc.match_substring(texts, x) for x in ("  ", " \n", SPACE)] + [pc.starts_with(texts, " "), pc.equal(texts, "")]
        odd = reduce(pc.or_, odd).to_numpy(zero_copy_only=False) if self.plain else np.ones(len(texts), bool)
        order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
        split = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(~odd)), "\n", " \n"), " ")
        rest = [_UNIT.findall((SPACE if self.prefix and t else "") + t.replace(" ", SPACE)) for t in texts.filter(pa.array(odd)).to_pylist()]
        words = pa.concat_arrays([split.flatten(), pa.array(chain.from_iterable(rest), pa.string())])
        return order, words, np.concatenate([np.diff(split.offsets.to_numpy()), np.array([len(x) for x in rest], np.int64)])

    def word(self, token: str) -> str:
        return SPACE + token if self.prefix and token[:1] not in ("\n", SPACE) else token

    def cut(self, words: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The units of all words, cut where no piece holds both neighbours (so the units' pieces are those of the word),
        and how many each word has."""
        text = "".join(words)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        kind = self.kinds[code]
        begins = np.ones(len(kind) + 1, bool)
        begins[1:-1] = ~self.joined[kind[:-1], kind[1:]]
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        begins[ends] = True
        begun = np.cumsum(begins[:-1])  # units, up to each character
        place = np.zeros(len(code) + 1, np.int32)  # of characters in UTF-8
        np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), out=place[1:])
        at = place[begins]
        units = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(text.encode("utf-8", "surrogatepass")))
        return units, np.diff(begun[ends - 1], prepend=0)

    def ids(self, symbols: list[str]) -> list[int]:
        out = []
        for s in symbols:
            known = self.pieces.get(s)
            if known:
                out.append(known[0])
            elif self.bytes:
                out += [self.bytes[b] for b in s.encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def symbols(self, unit: str, mask: int) -> list[str]:
        """The parts of a unit between the boundaries of a mask (bit i: before character i)."""
        out, at = [], 0
        mask &= (1 << len(unit)) - 2
        while mask:
            low = mask & -mask
            i = low.bit_length() - 1
            out.append(unit[at:i])
            at, mask = i, mask ^ low
        return [*out, unit[at:]]

    def merged(self, unit: str) -> list[str]:
        """The encoder's rule for one unit in plain Python."""
        if not self.bpe:
            return self._best_path(unit)
        sym, left, right = list(unit), list(range(-1, len(unit) - 1)), [*range(1, len(unit)), -1]
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and right[i] >= 0 and (r := self.rank.get(both := sym[i] + sym[right[i]])) is not None:
                heapq.heappush(heap, (r, i, both))

        for i in range(len(unit) - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = right[i] if sym[i] else -1
            if j < 0 or sym[i] + sym[j] != both:
                continue
            sym[i], sym[j], right[i] = both, "", right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i])
            offer(i)
        return [s for s in sym if s]

    def _best_path(self, unit: str) -> list[str]:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for e in range(1, len(unit) + 1):
            ways = [(best[s][0] + self.pieces[unit[s:e]][1], -s) for s in range(max(0, e - self.longest), e) if unit[s:e] in self.pieces]
            if unit[e - 1] not in self.pieces:
                ways.append((best[e - 1][0] + self.least - 10, 1 - e))
            score, start = max(ways)
            best.append((score, -start))
        out, e = [], len(unit)
        while e:
            out.append(unit[best[e][1] : e])
            e = best[e][1]
        return out[::-1]

    def decode(self, ids) -> str:
        text = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def masks(units: DataFrame, model: Model) -> DataFrame:
    """unit, mask for each distinct row of units(unit); units without a longer piece are left out for BPE models.

    units has to be distinct, of at least two characters for BPE models and one for others, and dealt by unit already:
    the join is a broadcast and keeps that, so nothing is dealt again.
    """
    spark, shortest = units.sparkSession, 2 if model.bpe else 1
    if model.bpe:
        rows = [(p, r, 0.0) for p, r in model.rank.items()]
    else:
        rows = [(p, 0, s) for p, (_, s) in model.pieces.items()]
    pieces = spark.createDataFrame(rows, "piece string, rank int, score double")
    n = F.length("unit")
    starts = units.select("unit", F.explode(F.sequence(F.lit(0), n - shortest)).alias("s"))
    spans = starts.select("unit", "s", F.explode(F.sequence(F.col("s") + shortest, F.least(F.col("s") + model.longest, n))).alias("e"))
    edges = spans.withColumn("piece", F.substring("unit", F.col("s") + 1, F.col("e") - F.col("s"))).join(F.broadcast(pieces), "piece")
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    if model.bpe:
        # an edge is one number while edges are gathered and sorted: by rank, then start
        edge = F.col("rank").cast("long") * 4096 + F.col("s") * 64 + F.col("e")
        grouped = edges.groupBy("unit").agg(F.sort_array(F.collect_list(edge)).alias("k"))
        start, end = (lambda k: F.shiftright(k, 6).bitwiseAND(F.lit(63)).cast("int")), (lambda k: k.bitwiseAND(F.lit(63)).cast("int"))
        # bits s+1..e-1 are the boundaries inside, bits s and e the ends
        parts = F.transform("k", lambda k: F.struct((bit(end(k)) - bit(start(k) + 1)).alias("inside"), (bit(start(k)) + bit(end(k))).alias("ends")))
        return grouped.select("unit", parts.alias("edges")).select("unit", _merge_fold(n).alias("mask"))
    edge = F.struct("s", "e", "score")
    grouped = edges.groupBy("unit").agg(F.collect_list(edge).alias("edges"))
    return grouped.select("unit", _viterbi_fold(n, model).alias("mask"))


def _merge_fold(n: Column) -> Column:
    whole = F.call_function("shiftleft", F.lit(1).cast("long"), n + 1) - 1

    def step(state: Column, _: Column) -> Column:
        """Merges the first edge with one boundary inside and keeps the edges whose ends are left; none if none fits."""
        mask, edges = state["mask"], state["edges"]
        best = F.get(F.filter(edges, lambda e: F.bit_count(mask.bitwiseAND(e["inside"])) == 1)["inside"], F.lit(0))
        merged = F.array(mask.bitwiseAND(F.bitwise_not(best)))  # in an array of one, so that it is worked out once
        after = F.transform(merged, lambda m: F.struct(F.coalesce(m, mask).alias("mask"), F.filter(edges, lambda e: m.bitwiseAND(e["ends"]) == e["ends"]).alias("edges")))
        return F.when(F.size(edges) == 0, state).otherwise(F.get(after, F.lit(0)))

    return F.aggregate(F.sequence(F.lit(1), n - 1), F.struct(whole.alias("mask"), F.col("edges").alias("edges")), step, lambda state: state["mask"])


def _viterbi_fold(n: Column, model: Model) -> Column:
    def forward(acc: Column, e: Column) -> Column:
        into = F.filter("edges", lambda x: x["e"] == e)
        known = F.transform(into, lambda x: F.struct((F.get(acc, x["s"])["score"] + x["score"]).alias("score"), (-x["s"]).alias("s")))
        alone = F.struct((F.get(acc, e - 1)["score"] + F.lit(float(model.least) - 10)).alias("score"), (1 - e).alias("s"))
        known = F.when(F.exists(into, lambda x: x["s"] == e - 1), known).otherwise(F.concat(known, F.array(alone)))
        return F.concat(acc, F.array(F.array_max(known)))

    zero = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("s")))
    best = F.aggregate(F.sequence(F.lit(1), n), zero, forward)

    def back(state: Column, e: Column) -> Column:
        here = state["at"] == e
        start = -F.get(best_col, e)["s"]
        return F.when(here, F.struct(state["mask"].bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), start)).alias("mask"), start.alias("at"))).otherwise(state)

    best_col = best
    first = F.struct(F.call_function("shiftleft", F.lit(1).cast("long"), n).alias("mask"), n.alias("at"))
    return F.aggregate(F.sequence(n, F.lit(1), F.lit(-1)), first, back, lambda state: state["mask"])


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers as their lowest bytes, then their second ones, and so on: these pack far better."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()


_HEAD = [("id", "<i8"), ("null", "u1"), ("n", "<u4"), ("mark", "u1")]


def pack_chunk(units: list[str], docs: np.ndarray, places: np.ndarray) -> bytes:
    """A chunk's file: distinct units, (doc_id, units, whether U+2581 is in the text) of each document, and the numbers of
    all units in order."""
    press = zstandard.ZstdCompressor(6)
    raw = "".join(units).encode("utf-8", "surrogatepass"), _planes(np.fromiter(map(len, units), "<u4", len(units))), docs.tobytes(), _planes(places)
    packed = [press.compress(x) for x in raw]
    return struct.pack("<4Q", *map(len, packed)) + b"".join(packed)


def unpack_chunk(raw: bytes) -> tuple[list[str], np.ndarray, np.ndarray]:
    """units, docs and places of `pack_chunk`."""
    unpack, at, found = zstandard.ZstdDecompressor(), 32, []
    for n in struct.unpack("<4Q", raw[:32]):
        found.append(unpack.decompress(raw[at : at + n]))
        at += n
    text, ends = found[0].decode("utf-8", "surrogatepass"), np.cumsum(_numbers(found[1]).astype(np.int64)).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends)], np.frombuffer(found[2], _HEAD), _numbers(found[3])


def joined(encoded: list[pa.Array]) -> tuple[pa.Array, np.ndarray]:
    """The distinct values of some dictionary arrays, in order of first appearance, and the number of each value."""
    if not encoded:
        return pa.array([], pa.string()), np.zeros(0, np.int32)
    same = pa.chunked_array(encoded).unify_dictionaries().chunks
    return same[0].dictionary, np.concatenate([x.indices.to_numpy() for x in same])


def _strung(flat: np.ndarray, first: np.ndarray, n: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The items of some lists one after the other; list i has the n[i] items of flat from first[i] on."""
    k = n[places]
    return flat[np.arange(int(k.sum())) + np.repeat(first[places] - (np.cumsum(k) - k), k)]


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip (the ids decode to the text) of each row of docs(doc_id, text)."""
    import xxhash

    spark: SparkSession = docs.sparkSession
    docs = clashing(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    model = Model(model_path)
    sent, folder = ship(spark, model), new_folder(spark, "words")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The units of each chunk, and a row with place -1 that names its file and the number of its units."""
        m, (fs, at) = sent(), file_system(folder)

        def saved(chunk: int, words: list[pa.Array], heads: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            names, places = joined(words)
            cut = [m.cut(list(map(m.word, names[i : i + WORDS].to_pylist()))) for i in range(0, len(names), WORDS)]
            sizes = np.concatenate([np.zeros(0, np.int64), *(n for _, n in cut)])
            units, parts = joined([x.dictionary_encode() for x, _ in cut])
            del names, cut
            # documents as unit numbers, the most frequent units first: these pack best
            head, first = np.concatenate(heads), np.cumsum(sizes) - sizes
            begins = np.r_[0, np.cumsum(head["n"].astype(np.int64))]
            head["n"] = np.diff(np.r_[0, np.cumsum(sizes[places])][begins])
            places = np.concatenate([np.zeros(0, np.int32), *(_strung(parts, first, sizes, places[i : i + STRUNG]) for i in range(0, len(places), STRUNG))])
            order = np.argsort(-np.bincount(places, minlength=len(units)), kind="stable").astype(np.int32)
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            units = units.take(pa.array(order))
            raw, name = pack_chunk(units.to_pylist(), head, rank[places]), uuid.uuid4().hex
            fs.create_dir(at, recursive=True)
            with fs.open_output_stream(f"{at}/{name}", compression=None) as f:
                f.write(raw)
            key = xxhash.xxh64_intdigest(raw, chunk % 2**64) - 2**63
            del raw, parts, sizes, places
            size = pc.utf8_length(units).to_numpy()
            sent_on = np.flatnonzero((size > 1) & (size <= LONG)).astype(np.int32)
            yield pa.record_batch([[key], [f"\n{name} {len(sent_on)}"], pa.array([-1], pa.int32())], ["chunk", "unit", "place"])
            for start in range(0, len(sent_on), WORDS):
                some = sent_on[start : start + WORDS]
                yield pa.record_batch([pa.array(np.full(len(some), key)), units.take(pa.array(some)), pa.array(some)], ["chunk", "unit", "place"])

        from pyspark import TaskContext

        words, heads, size, made = [], [], 0, TaskContext.get().partitionId() << 32
        for b in batches:
            ends = np.cumsum(pc.binary_length(b.column("text")).to_numpy().astype(np.int64))
            begin = 0
            while begin < len(ends):
                done = int(ends[begin - 1]) if begin else 0
                end = min(len(ends), int(np.searchsorted(ends, done + min(STEP, CHUNK - size))) + 1)
                ids, texts = b.column("doc_id")[begin:end], b.column("text")[begin:end]
                order, found, n = m.tokens(texts)
                head = np.zeros(len(order), _HEAD)
                head["id"], head["null"] = pc.fill_null(ids, 0).to_numpy()[order], ids.is_null().to_numpy(zero_copy_only=False)[order]
                head["n"], head["mark"] = n, pc.match_substring(texts, SPACE).to_numpy(zero_copy_only=False)[order]
                words.append(found.dictionary_encode())
                heads.append(head)
                size, begin = size + int(ends[end - 1]) - done, end
                if size >= CHUNK:
                    yield from saved(made, words, heads)
                    words, heads, size, made = [], [], 0, made + 1
                    pa.default_memory_pool().release_unused()
        if heads:
            yield from saved(made, words, heads)

    def assemble(found: pa.Table) -> pa.Table:
        m, (fs, at) = sent(), file_system(folder)
        index = found.column("file").drop_null().to_pylist()
        name, n = index[0].strip().split(" ")
        if len(index) > 1 or found.num_rows != int(n) + 1:
            raise ValueError("a chunk's units are not those of its file: the documents came in another order when they were read again")
        with fs.open_input_stream(f"{at}/{name}", compression=None) as f:
            units, heads, places = unpack_chunk(f.read())
        mask = np.full(len(units) + 1, -2, np.int64)  # all boundaries; the file's row goes to the place after the last
        mask[found.column("place").to_numpy()] = pc.fill_null(found.column("mask"), -2).to_numpy()
        del found
        ids, whole, merge = [], np.zeros(len(units), bool), not m.bpe
        for i, (u, bits) in enumerate(zip(units, mask[:-1].tolist(), strict=True)):
            got = m.ids(m.merged(u) if len(u) > LONG or merge and bits == -2 else m.symbols(u, bits))
            ids.append(got)
            whole[i] = b"".join(map(m.out.__getitem__, got)) == u.replace(SPACE, " ").encode("utf-8", "surrogatepass")
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum()))
        del ids, units
        first = np.cumsum(n) - n
        got = [_strung(flat, first, n, places[i : i + STRUNG]) for i in range(0, len(places), STRUNG)]
        ends = np.r_[0, np.cumsum(heads["n"].astype(np.int64))]
        ids_before, odd_before = (np.r_[0, np.cumsum(x)][ends] for x in (n[places], ~whole[places]))
        fits = (np.diff(odd_before) == 0) & (heads["mark"] == 0)
        lists = pa.ListArray.from_arrays(pa.array(ids_before, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *got])))
        return pa.table([pa.array(heads["id"], mask=heads["null"].astype(bool)), pa.array(np.diff(ids_before)), lists, pa.array(fits)], ["doc_id", "n_tokens", "ids", "round_trip"])

    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(GROUPS))
    seen = docs.mapInArrow(number, "chunk long, unit string, place int").where("unit IS NOT NULL")
    # dealt once by unit: the distinct units and the join back read the same exchange (the counts and the filter, which the
    # join would infer on one side only, keep the two alike)
    dealt = seen.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "unit")
    distinct = dealt.groupBy("unit").agg(F.count("chunk").alias("c"), F.max("place").alias("p")).where("c > 0 AND p >= 0").select("unit")
    back = dealt.join(masks(distinct, model).hint("shuffle_hash"), "unit", "left")
    back = back.select("chunk", "place", "mask", F.when(F.col("place") < 0, F.col("unit")).alias("file"))
    return back.groupBy("chunk").applyInArrow(assemble, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decode(coded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and the text of each row of coded(doc_id, ids); null ids decode to "", null or foreign elements to nothing."""
    sent = ship(coded.sparkSession, Model(model_path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent()
        for b in batches:
            yield pd.DataFrame({"doc_id": longs(b["doc_id"]), "text": [m.decode([int(i) for i in (x if x is not None else ()) if i == i and 0 <= i < len(m.out)]) for x in b["ids"]]})

    return keys(clashing(coded, ["doc_id", "ids"]), "doc_id").mapInPandas(run, "doc_id long, text string")

"""Near-duplicate groups by SetSketch registers.

Every text becomes the set of its distinct five-word shingles (see shingles.py). A SetSketch keeps, for each of M hash
functions, ``floor(1 - log_b x)`` cut to 0..Q+1, where x is the smallest of the exponentially distributed values of the
set's elements: exponentially spaced truncated minima. Registers of a union are the maxima of the registers, and two
registers are equal with a probability that grows with the Jaccard similarity.

1. Texts with the same set become one node (smallest doc_id), so any number of exact copies costs one node.
2. BANDS bands of ROWS registers hash nodes to buckets. Round one compares every member of a bucket with the member
   that comes first in one random order of all nodes: linear in the members, whatever the bucket's size, and as the order
   is the same in every band, the buckets of a family of copies mostly name the same few members.
3. A pair is dropped if its similarity, estimated from the registers by maximum likelihood jointly with both known set
   sizes, is under the threshold by more than SIGMAS standard errors (or if the sizes alone rule it out). All other
   pairs are confirmed on the full sets.
4. Confirmed links give components. Round two looks at buckets whose members are in more than one component: each
   member outside the bucket's largest component is compared with all members in other components. Buckets of at most
   SMALL members give pairs; larger ones are worked through in pairs of blocks of about SQUARE members, which give the
   links found, never the pairs tried. A bucket with more than HUGE members outside its largest component is first
   split by each of the other bands, up to DEPTH times (a hot passage puts many unlike texts in one bucket; they part
   as soon as another band is added); what is left after that goes through in blocks.

So no link is lost to a bucket's size: the only misses are pairs that share no band, at similarity 0.75 one in 200,000
(``(1 - .75**4)**32``), and far fewer above.

Defined cases: null or empty texts, and texts without words, have n_shingles 0 and are linked with nothing; repeated
rows each get a result row; rows that share a doc_id but not a text each get the component of their own text; a null
doc_id gets n_shingles, but no component, and kept is false; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import clashing, cut, keys, longs, place_of, unique_names
from plumbline.llm.components import connected_components
from plumbline.llm.shingles import WordHashes, mix, overlap, shingle_set, split_words

#: Registers, and their division into bands.
M, ROWS = 128, 4
BANDS = M // ROWS
#: SetSketch's base, rate and register limit.
BASE, RATE, Q = 1.001, 20.0, 2**16 - 2
THRESHOLD = 75  # percent
SIGMAS = 5.0
#: Members of a bucket that is compared by pairs; members outside the largest component of one that is split; splits.
SMALL, HUGE, DEPTH = 32, 16_384, 3
SQUARE = 512
_rng = np.random.default_rng(20_100)
_PLACE = np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)
_MUL = _rng.integers(0, 2**64, M, np.uint64, endpoint=False) | np.uint64(1)
_ADD = _rng.integers(0, 2**64, M, np.uint64, endpoint=False)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The M registers (uint16) of a set of fingerprints; all 0 for the empty set."""
    if not len(hashes):
        return np.zeros(M, np.uint16)
    low = np.full(M, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 512):  # a block of 512 x M values stays in a core's cache
        low = np.minimum(low, (hashes[at : at + 512, None] * _MUL + _ADD).min(axis=0))
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / math.log(BASE)), 0, Q + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def estimate(n1: np.ndarray, n2: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of each pair of register rows, given both set sizes.

    With u = n1/(n1+n2), v = n2/(n1+n2) and p(x) = -log_b(1 - x(b-1)/b), a register of the first set is larger with
    probability p(u - vJ), smaller with p(v - uJ), else equal; the log-likelihood is concave in J, so its derivative is
    bisected.
    """
    more, less = (k1 > k2).sum(1).astype(float), (k1 < k2).sum(1).astype(float)
    same = k1.shape[1] - more - less
    u = n1 / (n1 + n2)
    v = 1 - u
    z, ln = (BASE - 1) / BASE, math.log(BASE)
    p = lambda x: -np.log1p(-np.maximum(x, 1e-12) * z) / ln
    dp = lambda x: z / (1 - np.maximum(x, 1e-12) * z) / ln
    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(30):
        j = (lo + hi) / 2
        a, b = u - v * j, v - u * j
        slope = -more * v * dp(a) / p(a) - less * u * dp(b) / p(b) + same * (v * dp(a) + u * dp(b)) / np.maximum(1 - p(a) - p(b), 1e-12)
        lo, hi = np.where(slope > 0, j, lo), np.where(slope > 0, hi, j)
    return (lo + hi) / 2


def band_keys(regs: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
    """rows x BANDS bucket keys; salt, one for each row, makes keys within a bucket."""
    parts = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    key = np.zeros(parts.shape[:2], np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    key = mix(key + np.asarray(salt, np.int64).astype(np.uint64).reshape(-1, 1) * np.uint64(0xD6E8FEB86659FD93))
    for i in range(ROWS):
        key = mix(key ^ (parts[:, :, i] + _PLACE[i]))
    return key.view(np.int64)


def _stack(col: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.uint16).reshape(len(col), M)


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import xxhash

    memo = WordHashes()
    for b in batches:
        n, fp, regs = [], [], []
        for text in b["text"]:
            s = shingle_set(text, memo)
            n.append(len(s))
            fp.append(xxhash.xxh128_digest(s.tobytes()) if len(s) else None)
            regs.append(registers(s).tobytes() if len(s) else None)
        yield pd.DataFrame({"doc_id": longs(b["doc_id"]), "n_shingles": n, "fp": fp, "regs": regs})


def _to_bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for at in range(0, len(b), 4096):
            part = b.iloc[at : at + 4096]
            yield pd.DataFrame({"key": band_keys(_stack(part["regs"])).ravel(), "node": np.repeat(part["node"].to_numpy(), BANDS)})


def _to_sub_bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for at in range(0, len(b), 4096):
            part = b.iloc[at : at + 4096]
            keys = band_keys(_stack(part["regs"]), part["key"].to_numpy())
            yield pd.DataFrame({"key": keys.ravel(), "node": np.repeat(part["node"].to_numpy(), BANDS), "label": np.repeat(part["label"].to_numpy(), BANDS)})


def _likely(threshold: int):
    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = threshold / 100
        for b in batches:
            if not len(b):
                continue
            n1, n2 = b["n_a"].to_numpy(float), b["n_b"].to_numpy(float)
            j = estimate(n1, n2, _stack(b["regs_a"]), _stack(b["regs_b"]))
            yield b.loc[j >= t - SIGMAS * math.sqrt(t * (1 - t) / M), ["a", "b"]]

    return prune


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    press = zstandard.ZstdCompressor(3)
    for b in batches:
        yield pd.DataFrame({"node": b["node"], "body": [press.compress(b" ".join(split_words(t))) for t in b["text"]]})


def _confirm(threshold: int):
    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, last, kept = WordHashes(), (None, None), {}
        unpack = zstandard.ZstdDecompressor()

        def whole(body: bytes) -> np.ndarray:
            return shingle_set(unpack.decompress(body).decode("utf-8", "surrogatepass"), memo)

        for b in batches:
            hit = []
            kept.clear()
            for node, one, two in zip(b["a"], b["body_a"], b["body_b"], strict=True):
                if last[0] != one:
                    last = (one, whole(one))
                if two not in kept:
                    if len(kept) >= 256:
                        kept.clear()
                    kept[two] = whole(two)
                s, t = last[1], kept[two]
                both = overlap(s, t)
                hit.append(100 * both >= threshold * (len(s) + len(t) - both))
            yield b.loc[hit, ["a", "b"]]

    return confirm


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id, text); see the module's text."""
    docs = clashing(docs, ["doc_id", "text"]).withColumn("doc_id", F.col("doc_id").cast("long"))
    sketched = cut(keys(docs, "doc_id").mapInPandas(_sketch, "doc_id long, n_shingles long, fp binary, regs binary"), "sketches")
    # exact copies: one node a set, its smallest doc_id
    groups = cut(sketched.where("fp IS NOT NULL AND doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs")), "nodes")
    nodes = groups.select("node", "n", "regs")
    bands = nodes.select("node", "regs").mapInPandas(_to_bands, "key long, node long")
    # written first: the join is then between two plain exchanges, and a bucket with very many members can be split
    shared = cut(bands.groupBy("key").agg(F.count("*").alias("members"), F.min_by("node", F.xxhash64("node")).alias("leader")).where("members > 1").select("key", "leader"), "leaders")
    members = cut(bands.join(shared, "key"), "buckets")
    involved = members.select("node").distinct()
    bodies = cut(
        docs.withColumnRenamed("doc_id", "node").join(involved, "node", "left_semi").mapInPandas(_pack, "node long, body binary"), "bodies"
    )

    def links(pairs: DataFrame) -> DataFrame:
        side = lambda s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("regs").alias(f"regs_{s}"))
        body = lambda s: bodies.select(F.col("node").alias(s), F.col("body").alias(f"body_{s}"))
        sized = pairs.distinct().join(side("b"), "b").join(side("a"), "a").where(f"100 * least(n_a, n_b) >= {threshold} * greatest(n_a, n_b)")
        likely = cut(sized.mapInPandas(_likely(threshold), "a long, b long"), "likely")
        return cut(likely.join(body("b"), "b").join(body("a"), "a").mapInPandas(_confirm(threshold), "a long, b long"), "links")

    first = links(members.where("node <> leader").select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")))
    labels = connected_components(first)
    # round two: buckets with members in more than one component
    named = members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    named = cut(named.join(_open(named), "key"), "open")
    pairs, more = None, first
    for depth in range(DEPTH + 1):
        counts = named.groupBy("key", "label").agg(F.count("*").alias("c"))
        major = counts.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("major"), F.sum("c").alias("size"), (F.sum("c") - F.max("c")).alias("minor"))
        told = cut(named.join(major, "key"), "told")
        small, huge = F.col("size") <= SMALL, F.col("minor") > (HUGE if depth < DEPTH else 2**62)
        few = told.where(small)
        left = few.where("label <> major").select("key", F.col("node").alias("x"), F.col("label").alias("lx"))
        found = left.join(few.select("key", F.col("node").alias("y"), F.col("label").alias("ly"), "major"), "key")
        found = found.where("lx <> ly AND (ly = major OR x < y)").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        pairs = found if pairs is None else pairs.unionByName(found)
        many = told.where(~small & ~huge)
        if many.limit(1).count():
            more = more.unionByName(_within(many, nodes, bodies, threshold))
        rest = told.where(~small & huge).select("key", "node", "label")
        if depth == DEPTH or not rest.limit(1).count():
            break
        named = rest.join(nodes.select("node", "regs"), "node").mapInPandas(_to_sub_bands, "key long, node long, label long")
        named = cut(named.join(_open(named), "key").distinct(), "open")
    labels = connected_components(more.unionByName(links(pairs)))
    return _result(sketched, groups, labels)


def _squares(rows: DataFrame, *columns: str) -> DataFrame:
    """For rows(key, node, label, major, size, ...) of buckets: each block of members outside the bucket's largest
    component beside each block of all members; blocks hold about SQUARE members, however large the bucket."""
    block = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / F.lit(SQUARE)))
    entry = F.struct("node", "label", (F.col("label") != F.col("major")).alias("minor"), *columns)
    blocks = cut(rows.groupBy("key", block.alias("block")).agg(F.collect_list(entry).alias("whole")), "blocks")
    minor = blocks.select("key", F.filter("whole", lambda r: r["minor"]).alias("minor")).where(F.size("minor") > 0)
    return minor.join(blocks.select("key", "whole"), "key")


def _near(threshold: int):
    """Members of a pair of blocks that have a likely link into another component."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = threshold / 100
        spread = math.sqrt(t * (1 - t) / M)
        for b in batches:
            for key, minor, whole in zip(b["key"], b["minor"], b["whole"], strict=True):
                (x, lx, nx, rx), (y, ly, ny, ry) = (
                    (np.array([r["node"] for r in side]), np.array([r["label"] for r in side]), np.array([r["n"] for r in side], float), np.frombuffer(b"".join(r["regs"] for r in side), np.uint16).reshape(-1, M))
                    for side in (minor, whole)
                )
                hit_x, hit_y = np.zeros(len(x), bool), np.zeros(len(y), bool)
                for i in range(len(x)):
                    # a cheap bound first: the share of equal registers, one standard error wider
                    j = np.flatnonzero((ly != lx[i]) & ((ry == rx[i]).sum(1) >= M * (t - (SIGMAS + 1) * spread)) & (100 * np.minimum(ny, nx[i]) >= threshold * np.maximum(ny, nx[i])))
                    if len(j):
                        j = j[estimate(np.full(len(j), nx[i]), ny[j], np.broadcast_to(rx[i], (len(j), M)), ry[j]) >= t - SIGMAS * spread]
                        hit_x[i] |= len(j) > 0
                        hit_y[j] = True
                node = np.unique(np.concatenate([x[hit_x], y[hit_y]]))
                yield pd.DataFrame({"key": key, "node": node}, index=range(len(node)))

    return run


def _exact(threshold: int):
    """Confirmed links between the members of a pair of blocks; links within what they already connect are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordHashes()
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for minor, whole in zip(b["minor"], b["whole"], strict=True):
                sets = {r["node"]: shingle_set(unpack.decompress(r["body"]).decode("utf-8", "surrogatepass"), memo) for r in (*minor, *whole)}
                y, ly = [r["node"] for r in whole], np.array([r["label"] for r in whole])
                size = np.array([len(sets[i]) for i in y])
                vocabulary, at = np.unique(np.concatenate([sets[i] for i in y]), return_inverse=True)
                start, mark = np.r_[0, np.cumsum(size)[:-1]], np.zeros(len(vocabulary), np.int64)
                parent: dict[int, int] = {r["label"]: r["label"] for r in (*minor, *whole)}

                def top(v: int, parent=parent) -> int:
                    while parent[v] != v:
                        parent[v] = v = parent[parent[v]]
                    return v

                out = []
                for r in minor:
                    s = sets[r["node"]]
                    where = np.searchsorted(vocabulary, s)
                    where[where == len(vocabulary)] = 0
                    where = where[vocabulary[where] == s]
                    mark[where] = 1
                    both = np.add.reduceat(mark[at], start)
                    mark[where] = 0
                    for j in np.flatnonzero((ly != r["label"]) & (100 * both >= threshold * (size + len(s) - both))):
                        p, q = top(r["label"]), top(int(ly[j]))
                        if p != q:
                            parent[max(p, q)] = min(p, q)
                            out.append((min(r["node"], y[j]), max(r["node"], y[j])))
                yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def _within(told: DataFrame, nodes: DataFrame, bodies: DataFrame, threshold: int) -> DataFrame:
    """Confirmed links between components within large buckets, by blocks: estimates first, then the full sets of the
    members that have a likely partner."""
    sketched = told.select("key", "node", "label", "major", "size").join(nodes.dropDuplicates(["node"]), "node")
    near = cut(_squares(sketched, "n", "regs").mapInPandas(_near(threshold), "key long, node long").distinct(), "near")
    whole = told.select("key", "node", "label", "major", "size").join(near, ["key", "node"]).join(bodies.dropDuplicates(["node"]), "node")
    return cut(_squares(whole, "body").mapInPandas(_exact(threshold), "a long, b long").distinct(), "within")


def _open(named: DataFrame) -> DataFrame:
    """Keys whose members are in more than one component."""
    return named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")


def _result(sketched: DataFrame, groups: DataFrame, labels: DataFrame) -> DataFrame:
    of_set = groups.select("fp", "node").join(labels, "node", "left").select("fp", F.coalesce("label", "node").alias("component_id"))
    # the copies of one text share a key; only the skewed side is large, so Spark can split it
    out = sketched.select("doc_id", "n_shingles", "fp").join(of_set, "fp", "left")
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", alone))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """docs without all but one row of each group: the row of the group's smallest doc_id (one of them, if repeated).

    Rows without a doc_id are kept as they are. Columns and their order are those of docs.
    """
    from pyspark.sql import Window

    keep = near_duplicates(docs, threshold).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    plain, text = unique_names(docs), f"_{place_of(docs, 'text')}"
    plain = plain.withColumn("_id", F.col(f"_{place_of(docs, 'doc_id')}").cast("long"))
    found = plain.join(keep, F.col("_id") == F.col("_kept_id"), "inner")
    # repeated rows of a kept doc_id: the partition by id is already there
    one = found.withColumn("_rank", F.row_number().over(Window.partitionBy("_kept_id").orderBy(F.col(text).isNull(), text)))
    names = [f"_{i}" for i in range(len(docs.columns))]
    return one.where("_rank = 1").select(*names).unionByName(plain.where("_id IS NULL").select(*names)).toDF(*docs.columns)

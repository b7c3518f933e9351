"""Benchmark decontamination: which documents hold short test items, however long the document.

A document holds an item when at least THRESHOLD percent of the item's distinct five-word shingles (shingles.py) are
among the document's. An item of fewer than five words is one shingle of its own length, looked up among the document's
windows of that length.

Containment MinHash, partitioned by item size. Items with at most LISTED shingles are looked up by all of them. Larger
ones are looked up by the shingle that is smallest under each of k hash functions, k by size class: each of those
shingles is in a document with a probability equal to the containment, so a document whose hits fall short of the
class's least number of hits holds 75 % of the item in fewer than one case in a million, whatever the document's
length. Candidates are then confirmed by exact shingle containment on the whole sets. A document's windows are looked
up in the sorted sketch of the items: documents are neither shuffled nor exploded.

The sketch and the sets of items go to executors in blocks of at most BLOCK shingles, measured first; more items make
more blocks, each with its own pass over the documents. One item larger than that is a block of its own.

Defined cases: null or empty texts, and texts without words, hold nothing and are held by nothing; repeated documents
or items give one row for each (doc_id, item_id), with the largest containment; null ids are ids like others; with no
items or no documents there are no rows; extra columns are ignored by `find` and kept by `clean`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import clashing, keys, longs, place_of, unique_names
from plumbline.llm.shingles import WORDS, WordHashes, overlap, shingle_set, split_words, windows

THRESHOLD = 75  # percent
LISTED = 16
#: Upper end of the size class, hash functions, least number of hits.
CLASSES = ((64, 16, 3), (512, 32, 10), (2**62, 64, 28))
BLOCK = 2_000_000
RESULT = "doc_id long, item_id long, shared long, item_shingles long, containment double"
_rng = np.random.default_rng(40_400)
_MUL = _rng.integers(0, 2**64, 64, np.uint64, endpoint=False) | np.uint64(1)
_ADD = _rng.integers(0, 2**64, 64, np.uint64, endpoint=False)


class Items:
    """Sketch and sets of one block of items."""

    def __init__(self, rows: list[tuple[int | None, str | None]], threshold: int):
        self.ids, self.sets, self.sizes, self.least = [], [], [], []
        self.threshold = threshold
        keys: dict[int, list[tuple[int, int, int]]] = {}
        memo = WordHashes()
        for item, text in rows:
            words = split_words(text)
            if not words:
                continue
            size, whole = min(WORDS, len(words)), shingle_set(text, memo)
            picked, least = self._sketch(whole)
            for key, weight in picked.items():
                keys.setdefault(size, []).append((key, len(self.ids), weight))
            self.ids.append(item)
            self.sets.append(whole)
            self.sizes.append(size)
            self.least.append(least)
        self.least = np.array(self.least, np.int64)
        self.postings = {}
        for size, found in keys.items():
            found.sort()
            key = np.array([x[0] for x in found], np.uint64)
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            self.postings[size] = (key[first], np.r_[first, len(key)], np.array([x[1] for x in found]), np.array([x[2] for x in found]))

    def _sketch(self, whole: np.ndarray) -> tuple[dict[int, int], int]:
        if len(whole) <= LISTED:
            return dict.fromkeys(whole.tolist(), 1), max(1, -(-self.threshold * len(whole) // 100))
        _, k, least = next(c for c in CLASSES if len(whole) <= c[0])
        picked: dict[int, int] = {}
        for i in range(k):
            key = int(whole[np.argmin(whole * _MUL[i] + _ADD[i])])
            picked[key] = picked.get(key, 0) + 1
        return picked, least

    def held(self, text: str | None, memo: WordHashes) -> list[tuple[int | None, int, int]]:
        """(item_id, shared shingles, item's shingles) of the items that a text holds."""
        words, out = split_words(text), []
        for size, (key, start, item, weight) in self.postings.items():
            w = windows(words, memo, size)
            if not len(w):
                continue
            at = np.searchsorted(key, w)
            at[at == len(key)] = 0
            at = np.unique(at[key[at] == w])
            if not len(at):
                continue
            hits = np.zeros(len(self.ids), np.int64)
            for a in at:
                s = slice(start[a], start[a + 1])
                np.add.at(hits, item[s], weight[s])
            whole = None
            for i in np.flatnonzero((hits >= self.least) & (hits > 0)):
                if self.sizes[i] != size:
                    continue
                whole = np.unique(w) if whole is None else whole
                both = overlap(self.sets[i], whole)
                if 100 * both >= self.threshold * len(self.sets[i]):
                    out.append((self.ids[i], both, len(self.sets[i])))
        return out


def blocks(items: DataFrame) -> list[DataFrame]:
    """Items in blocks of about BLOCK shingles at most; their total is counted first."""
    items = clashing(items, ["item_id", "text"]).withColumn("item_id", F.col("item_id").cast("long")).distinct()
    words = F.size(F.split("text", r"[\x20\x09-\x0D]+"))
    total = items.agg(F.sum(words)).first()[0] or 0
    n = max(1, -(-total // BLOCK))
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def _shipped(items: DataFrame, threshold: int):
    rows = [(r["item_id"], r["text"]) for r in items.collect()]  # one block, bounded by BLOCK
    return items.sparkSession.sparkContext.broadcast(rows), threshold


def find(docs: DataFrame, items: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, item_id, shared, item_shingles, containment of every document of docs(doc_id, text) and item it holds."""
    docs = keys(clashing(docs, ["doc_id", "text"]), "doc_id")
    out = None
    for block in blocks(items):
        sent, limit = _shipped(block, threshold)

        def search(batches: Iterator[pd.DataFrame], sent=sent, limit=limit) -> Iterator[pd.DataFrame]:
            index, memo = Items(sent.value, limit), WordHashes()
            for b in batches:
                rows = [(doc, item, both, n, both / n) for doc, text in zip(b["doc_id"], b["text"], strict=True) for item, both, n in index.held(text, memo)]
                yield pd.DataFrame({"doc_id": longs(r[0] for r in rows), "item_id": longs(r[1] for r in rows)} | {c: [r[i] for r in rows] for i, c in ((2, "shared"), (3, "item_shingles"), (4, "containment"))})

        part = docs.mapInPandas(search, RESULT)
        out = part if out is None else out.unionByName(part)
    best = F.max(F.struct("containment", "shared", "item_shingles")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.shared", "best.item_shingles", "best.containment")


def _free(sent, threshold: int):
    """Whether each text holds no item of one block."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index, memo = Items(sent.value, threshold), WordHashes()
        for texts in batches:
            yield pd.Series([not index.held(t, memo) for t in texts], dtype=bool)

    return F.pandas_udf(run, "boolean")


def clean(docs: DataFrame, items: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of docs whose text holds no item; only texts go through Python, so all columns are unchanged."""
    plain, text = unique_names(docs), f"_{place_of(docs, 'text')}"
    for block in blocks(items):
        plain = plain.where(_free(*_shipped(block, threshold))(F.col(text)))
    return plain.toDF(*docs.columns)


#: The same by plain joins of distinct shingles, for a second engine.
SQL = r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
it AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
item_sets AS (
  SELECT DISTINCT item_id, size, w, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS s
  FROM (SELECT item_id, w, least(5, len(w)) AS size FROM it WHERE len(w) > 0)),
item_sizes AS (SELECT item_id, size, w, count(*) AS n FROM item_sets GROUP BY ALL),
sizes AS (SELECT DISTINCT size FROM item_sets),
doc_sets AS (
  SELECT DISTINCT doc_id, w, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS s
  FROM (SELECT DISTINCT doc_id, w FROM lowered), sizes WHERE len(w) >= size),
both_sets AS (SELECT d.doc_id, d.w AS dw, i.item_id, i.w, i.size, count(*) AS shared FROM doc_sets d JOIN item_sets i USING (s, size) GROUP BY ALL),
held AS (SELECT doc_id, item_id, shared, n, shared / n AS c FROM both_sets JOIN item_sizes USING (item_id, size, w) WHERE 100 * shared >= 75 * n)
SELECT doc_id, item_id, max(shared) AS shared, max(n) AS item_shingles, max(c) AS containment FROM held GROUP BY doc_id, item_id
"""

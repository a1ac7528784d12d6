"""Ranked lexical search over inverted treaps.

A posting is a document and its impact, what the term adds to the document's score. Of each term a block of documents
has a treap: a search tree by document, a heap by impact, so a subtree is a range of documents and its root their largest
impact. An item's search walks the treaps of all its terms at once: a range of documents with the subtree of
each term in it; the sum of the roots' impacts bounds every score in the range. Ranges are taken best bound first, some at
a time; one that can't reach the k-th score found so far goes with its subtrees, others are split and each
subtree led down to its half. Of ranges of a few documents the postings are added up. Equal bounds are not cut, so ties are whole.

Texts become rows (document, length, terms, occurrences) once, for the terms that items ask for; the collection's figures
come from these rows, and blocks of a bounded number of postings are dealt at random, so a term that stands in every
document is spread over all blocks. Blocks hand on their k best of each item, and a window that cuts in each task first
ranks them. Items are taken in blocks with a bounded number of terms, so what goes to tasks is bounded.

Defined cases: a null text has no terms and counts nowhere; a document with a null id counts in the figures and is never
found; repeated rows of documents are documents each; a null item_id takes no part, an item_id with several texts asks with
the terms of all; an item without known terms finds nothing; ties go to the smaller doc_id; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import arrow_text as A
from lectern.llm.shared import written

TERM = np.zeros(256, bool)
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Terms of a block of items, postings of a block of documents, documents that are scored without a further split, ranges taken at once.
ITEM_TERMS, POSTINGS, LEAF, RANGES = 1 << 18, 1 << 20, 64, 32
RESULT = "item_id bigint, doc_id bigint, score bigint"


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(row of each term, the terms) of texts; A-Z are lower-cased."""
    data, offsets = A.text_buffers(texts)
    inside = TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = np.flatnonzero(inside & (edge[:-1] | np.concatenate([[True], ~inside[:-1]]))) if len(data) else np.zeros(0, np.int64)
    place = np.cumsum(inside)
    ends = np.concatenate([place[begin] - 1, place[-1:] if len(data) else [0]]).astype(np.int64)
    terms = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(A.LOWER[data[inside]])])
    return np.searchsorted(offsets, begin, "right") - 1, terms.dictionary_encode()


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "text"):
            row, terms = terms_of(A.column(batch, "text"))
            if len(row):
                yield pa.RecordBatch.from_arrays([A.column(batch, "item_id").take(pa.array(row)), terms.cast(pa.large_string()).cast(pa.string())], ["item_id", "term"])

    return items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "item_id bigint, term string").distinct()


def documents_of(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """(doc_id, n, deal, terms, tfs) of documents with terms; terms: places in the vocabulary, and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        chance = np.random.default_rng(context.partitionId() if context else 0)
        size = max(1, len(vocabulary))
        for batch in A.slices(batches, "text", 8 << 20):
            row, terms = terms_of(A.column(batch, "text"))
            if not len(row):
                continue
            known = pc.index_in(terms.dictionary, vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            term = known[terms.indices.to_numpy(zero_copy_only=False)]
            flat, tf = np.unique((row * size + term)[term >= 0], return_counts=True)
            n = np.bincount(row, minlength=batch.num_rows)
            held = np.flatnonzero(n)
            ends = np.searchsorted(flat // size, np.concatenate([held, [batch.num_rows]])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                A.column(batch, "doc_id").take(pa.array(held)), pa.array(n[held].astype(np.int64)), pa.array(chance.integers(0, 1 << 30, len(held)).astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(ends), pa.array((flat % size).astype(np.int32))), pa.ListArray.from_arrays(pa.array(ends), pa.array(tf.astype(np.int32))),
            ], ["doc_id", "n", "deal", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n bigint, deal int, terms array<int>, tfs array<int>")


def weight(count: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * count + 2) / (2 * df + 1)))


class Treaps:
    """The treaps of a block: postings by term and document, and each one's children."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, documents: int):
        order = np.lexsort((doc, term))
        self.term, self.doc, self.impact, self.documents = term[order], doc[order], impact[order], documents
        self.key = self.term.astype(np.int64) * documents + self.doc
        count = len(order)
        # Heap order: by impact, equal ones by a mixed number of the document, so that trees of many ties stay low.
        heap = np.empty(count, np.int64)
        heap[np.lexsort((A.mix(self.doc.astype(np.uint64) + np.uint64(1)), self.impact))] = np.arange(count)
        left, right = nearest_greater(heap, self.term)
        over = np.where(right < 0, left, np.where(left < 0, right, np.where(heap[left] < heap[right], left, right)))
        self.left, self.right = np.full(count, -1, np.int64), np.full(count, -1, np.int64)
        child = np.flatnonzero(over >= 0)
        below = child < over[child]
        self.left[over[child[below]]] = child[below]
        self.right[over[child[~below]]] = child[~below]
        roots = np.flatnonzero(over < 0)
        self.root = dict(zip(self.term[roots].tolist(), roots.tolist(), strict=True))

    def within(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Each subtree led down to the root of its part in [low, high), -1 if that is empty."""
        node = node.copy()
        at = np.flatnonzero(node >= 0)
        while len(at):
            d = self.doc[node[at]]
            below, above = d < low[at], d >= high[at]
            at, below = at[below | above], below[below | above]
            node[at] = np.where(below, self.right[node[at]], self.left[node[at]])
            at = at[node[at] >= 0]
        return node


def nearest_greater(heap: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each posting the nearest one of its term with a larger number on either side, or -1."""
    every, out = np.arange(len(heap)), []
    for step in (-1, 1):
        near = every + step
        open_ = every
        while len(open_):
            to = near[open_]
            inside = (to >= 0) & (to < len(heap))
            inside[inside] = term[to[inside]] == term[open_[inside]]
            near[open_[~inside]] = -1 if step < 0 else len(heap)
            open_, to = open_[inside], to[inside]
            lower = heap[to] < heap[open_]
            open_ = open_[lower]
            near[open_] = near[to[lower]]
        near[(near < 0) | (near >= len(heap))] = -1
        out.append(near)
    return out[0], out[1]


def searched(treaps: Treaps, terms: np.ndarray, k: int, scores: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, documents scored) of the k best for an item's terms. scores: zeros, and left so."""
    terms = np.array([t for t in terms.tolist() if t in treaps.root], np.int64)
    best, best_scores, seen = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    if not len(terms):
        return best, best_scores, seen
    low, high = np.array([0]), np.array([treaps.documents])
    node = np.array([[treaps.root[t] for t in terms.tolist()]])
    bound = treaps.impact[node].sum(axis=1)
    line = 1
    while len(low):
        keep = bound >= line
        low, high, node, bound = low[keep], high[keep], node[keep], bound[keep]
        if not len(low):
            break
        top = np.argpartition(-bound, RANGES)[:RANGES] if len(low) > RANGES else np.arange(len(low))
        rest = np.ones(len(low), bool)
        rest[top] = False
        small = top[high[top] - low[top] <= leaf]
        if len(small):
            start = np.searchsorted(treaps.key, (terms[None, :] * treaps.documents + low[small][:, None]).ravel())
            size = np.searchsorted(treaps.key, (terms[None, :] * treaps.documents + high[small][:, None]).ravel()) - start
            at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            np.add.at(scores, treaps.doc[at], treaps.impact[at])
            met = np.unique(treaps.doc[at])
            seen += len(met)
            found, own = np.concatenate([best, met]), np.concatenate([best_scores, scores[met]])
            scores[met] = 0
            order = np.lexsort((found, -own))[:k]
            best, best_scores = found[order], own[order]
            if len(best) == k:
                line = max(1, int(best_scores[-1]))
        large = top[high[top] - low[top] > leaf]
        middle = (low[large] + high[large]) // 2
        new_low, new_high = np.concatenate([low[large], middle]), np.concatenate([middle, high[large]])
        wide = len(terms)
        led = treaps.within(np.concatenate([node[large], node[large]]).ravel(), np.repeat(new_low, wide), np.repeat(new_high, wide)).reshape(-1, wide)
        new_bound = np.where(led >= 0, treaps.impact[led], 0).sum(axis=1)
        low, high, node, bound = np.concatenate([low[rest], new_low]), np.concatenate([high[rest], new_high]), np.concatenate([node[rest], led]), np.concatenate([bound[rest], new_bound])
    good = best_scores > 0
    return best[good], best_scores[good], seen


def ranked(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents (doc_id, text) for each item (item_id, text)."""
    asked = written(item_terms(items), "item_terms")
    blocks = max(1, -(-asked.count() // ITEM_TERMS))
    found = None
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toArrow()
        part = in_block(docs, own, k)
        found = part if found is None else found.unionByName(part)
    by = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(by).cast("int")).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def in_block(docs: DataFrame, own: pa.Table, k: int) -> DataFrame:
    """The k best of each block of documents for the items of own (item_id, term)."""
    words = own.column("term").combine_chunks().dictionary_encode()
    vocabulary = words.dictionary.cast(pa.large_string())
    ids, item = np.unique(own.column("item_id").to_numpy(), return_inverse=True)
    order = np.argsort(item, kind="stable")
    term_of = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)[order]
    bounds = np.searchsorted(item[order], np.arange(len(ids) + 1)).tolist()
    rows = written(documents_of(docs, vocabulary), "term_rows")
    count, length, postings = rows.agg(F.count("*"), F.sum("n"), F.sum(F.size("terms"))).first()
    weights = np.zeros(len(vocabulary), np.int64)
    for term, df in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        weights[term] = weight(count, df)
    blocks = max(1, -(-(postings or 0) // POSTINGS))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("doc_id")
        docs = group.column("doc_id").to_numpy()
        sizes = group.column("terms").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        term, tf = (group.column(c).combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
        m = 50 + (50 * group.column("n").to_numpy() * count) // length
        doc = np.repeat(np.arange(len(docs)), sizes)
        impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
        adds = impact > 0
        treaps = Treaps(term[adds], doc[adds], impact[adds], len(docs))
        scores = np.zeros(len(docs), np.int64)
        found = [searched(treaps, term_of[a:b], k, scores)[:2] for a, b in zip(bounds, bounds[1:], strict=False)]
        return pa.table({
            "item_id": pa.array(np.repeat(ids, [len(d) for d, _ in found]), pa.int64()),
            "doc_id": pa.array(docs[np.concatenate([d for d, _ in found])] if found else [], pa.int64()),
            "score": pa.array(np.concatenate([s for _, s in found]) if found else [], pa.int64()),
        })

    dealt = rows.where("doc_id is not null and size(terms) > 0").withColumn("block", F.pmod("deal", F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(run, RESULT)

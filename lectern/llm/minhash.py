"""MinHash near-duplicate detection with min-max signatures.

Each permutation's minimum and maximum are both kept, so half the hash evaluations give a signature of
the same length; both are unbiased estimates of the same similarity. Rows of a band come from
different permutations. With 144 permutations there are 48 bands of 6 rows: a pair at similarity 0.8
misses every band with a probability of 5e-7, a closer one with far less.

1. Documents with equal shingle sets are one class with its smallest id as representative.
2. Representatives that share a band are candidates. In each bucket all members are paired with three
   centres (the smallest id, and of two halves of the ids the one that shares most buckets, as the
   least changed of a group of copies does), not with each other.
3. Candidates are confirmed on the full shingle sets in two rounds: first of each document the one centre with
   which it shares most buckets, then those whose ends are in different components still. A later round's links are
   between components, one for each pair, so links stay near one a document however large a group is.
4. Where a bucket's members are still in several components, those outside its largest one are compared,
   on full sets and block by block, with all of that component and with each other. So no pair that
   shares a bucket and could join two components goes unchecked, and no pairs but links are emitted.

Scale: texts are shuffled once, to keep those of candidates; hot classes, buckets and centres are
pre-aggregated, or joined where both sides are shuffled, so that AQE can split them.

Defined cases: null or empty texts and texts of white space have an empty set and link with nothing;
null ids are left out of links and have a null component; a repeated id is one document with the sets of all its
rows (what is linked with one of them is linked with it), each row of it has its own size; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import arrow_text as A
from lectern.llm.components import components
from lectern.llm.shared import discard, written

PERMUTATIONS, ROWS = 144, 6


def _family(permutations: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(77)
    return (rng.integers(0, 1 << 31, permutations, dtype=np.uint32) * np.uint32(2) + np.uint32(1)), rng.integers(0, 1 << 32, permutations, dtype=np.uint32)


def signature(shingles: np.ndarray, permutations: int) -> tuple[np.ndarray, np.ndarray]:
    """(minima, maxima) over a shingle set under each permutation."""
    factor, shift = _family(permutations)
    low = np.full(permutations, 0xFFFFFFFF, np.uint32)
    high = np.zeros(permutations, np.uint32)
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(h), 1024):
            x = np.multiply.outer(factor, h[at : at + 1024])
            x += shift[:, None]
            np.minimum(low, x.min(axis=1), out=low)
            np.maximum(high, x.max(axis=1), out=high)
    return low, high


def bands(low: np.ndarray, high: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key of each band."""
    sig = np.concatenate([low.reshape(-1, rows), high.reshape(-1, rows)]).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = np.arange(1, len(sig) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for k in range(rows):
            h = A.mix(h ^ sig[:, k] * np.uint64(A.MULTIPLIER))
    return h.view(np.int64)


def signatures(docs: DataFrame, words: int = 2, permutations: int = PERMUTATIONS, rows: int = ROWS, least: int = 4) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands) of docs (doc_id, text). Sets of fewer than `least` shingles
    get no bands: only an equal set can be similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "text"):
            hashes, counts = A.word_hashes(*A.text_buffers(A.column(batch, "text")))
            sizes, keys, found = [], [], []
            for own in np.split(hashes, np.cumsum(counts)[:-1]) if batch.num_rows else ():
                s = A.shingles(own, words)
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                found.append(bands(*signature(s, permutations), rows) if len(s) >= least else np.empty(0, np.int64))
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = np.concatenate(found) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [A.column(batch, "doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                ["doc_id", "n_shingles", "set_key", "bands"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, set_key binary, bands array<bigint>")


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""
    both = (
        pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b", F.xxhash64("a", "text_a").alias("own_a"), F.xxhash64("b", "text_b").alias("own_b"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "text_b", 1 << 20):
            known: dict = {}

            def sets(name: str, batch=batch, known=known) -> list[np.ndarray]:
                ids, text = A.column(batch, f"own_{name}").to_pylist(), A.column(batch, f"text_{name}")
                first: dict = {}
                for i, k in enumerate(ids):
                    if k not in known and k not in first:
                        first[k] = i
                if first:
                    hashes, counts = A.word_hashes(*A.text_buffers(text.take(pa.array(list(first.values())))))
                    for k, own in zip(first, np.split(hashes, np.cumsum(counts)[:-1]), strict=True):
                        known[k] = A.shingles(own, words)
                return [known[k] for k in ids]

            keep = []
            for x, y in zip(sets("a"), sets("b"), strict=True):
                least = min(len(x), len(y))
                if 100 * least < percent * max(len(x), len(y)) or not least:
                    keep.append(False)
                    continue
                z = np.concatenate([x, y])
                z.sort()
                common = int((z[1:] == z[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([A.column(batch, "a"), A.column(batch, "b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint")


def confirm_families(apart: DataFrame, every: DataFrame, texts: DataFrame, words: int, percent: int, block: int = 512, spanning: bool = False) -> DataFrame:
    """Links (a, b) across components, between the documents of apart (family, doc_id) and all of their family:
    the component `family` of every (doc_id, label) and the other documents apart. Both sides are dealt into blocks of
    about `block` documents, and each pair of blocks is compared in a task that gives only links; with spanning, links
    of labels in place of documents, one for each pair of labels in a pair of blocks."""
    inside = every.join(apart.select("family").distinct(), F.col("label") == F.col("family")).select("family", "doc_id")
    whole = written(apart.withColumn("apart", F.lit(True)).unionByName(inside.withColumn("apart", F.lit(False))), "families")
    parts = whole.groupBy("family").agg(
        F.ceil(F.count("*") / block).cast("int").alias("right_parts"), F.ceil(F.count_if("apart") / block).cast("int").alias("left_parts"))
    dealt = whole.join(written(parts, "parts"), "family")
    own = F.xxhash64("doc_id")
    left = dealt.where("apart").select("family", "doc_id", F.lit(True).alias("left"), F.pmod(own, "left_parts").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("right_parts") - 1)).alias("j"))
    right = dealt.select("family", "doc_id", F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.col("left_parts") - 1)).alias("i"), F.pmod(own, "right_parts").cast("int").alias("j"))
    key = ["family", "i", "j"]
    rows = left.unionByName(right).join(texts.join(every, "doc_id"), "doc_id").select(*key, "left", "doc_id", "label", "text").repartition(*key).sortWithinPartitions(*key)

    def compare(ids: list, labels: list, lefts: list, sets: list) -> Iterator[tuple[int, int]]:
        x, y = [k for k, own in enumerate(lefts) if own], [k for k, own in enumerate(lefts) if not own]
        n = np.array([len(s) for s in sets])
        common = np.zeros((len(x), len(y)), np.float32)
        flat = np.concatenate(sets)
        values, token = np.unique(flat, return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), n)
        often = np.bincount(token, minlength=len(values)) > 1
        number = np.cumsum(often) - 1
        keep = often[token]
        token, owner = number[token[keep]], owner[keep]
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        for start in range(0, int(often.sum()), 2048):
            a, b = np.searchsorted(token, [start, start + 2048])
            dense = np.zeros((len(sets), 2048), np.float32)
            dense[owner[a:b], token[a:b] - start] = 1
            common += dense[x] @ dense[y].T
        near = 100 * common >= percent * (n[x][:, None] + n[y][None] - common)
        if spanning:
            known, own = np.unique(np.array(labels, np.int64), return_inverse=True)
            met = np.unique((own[x][:, None] * len(known) + own[y][None])[near])
            for p, q in zip(known[met // len(known)].tolist(), known[met % len(known)].tolist(), strict=True):
                if p != q:
                    yield min(p, q), max(p, q)
            return
        for r, c in zip(*np.nonzero(near), strict=True):
            p, q = ids[x[r]], ids[y[c]]
            if labels[x[r]] != labels[y[c]]:
                yield min(p, q), max(p, q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, labels, lefts, sets, out = None, [], [], [], [], []
        for batch in A.slices(batches, "text"):
            hashes, counts = A.word_hashes(*A.text_buffers(A.column(batch, "text")))
            owns = np.split(hashes, np.cumsum(counts)[:-1])
            keys = zip(*(A.column(batch, k).to_pylist() for k in [*key, "left", "doc_id", "label"]), strict=True)
            for (family, i, j, is_left, doc, label), own in zip(keys, owns, strict=True):
                if (family, i, j) != at:
                    if ids:
                        out += compare(ids, labels, lefts, sets)
                    at, ids, labels, lefts, sets = (family, i, j), [], [], [], []
                ids.append(doc)
                labels.append(label)
                lefts.append(is_left)
                sets.append(A.shingles(own, words))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([q for _, q in out], pa.int64())], ["a", "b"])
                out = []
        if ids and (out := list(compare(ids, labels, lefts, sets))):
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([q for _, q in out], pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def candidates(shared: DataFrame, common: DataFrame, percent: int) -> DataFrame:
    """(doc_id, centre, bands) of shared (band, doc_id, n, size): each member of a bucket with the bucket's
    centres, where sizes allow a link; bands: in how many buckets. common: (doc_id, common), buckets shared in all."""
    ranked = shared.join(common, "doc_id")
    best = F.struct("common", "doc_id", "n")
    even = F.xxhash64("doc_id") % 2 == 0
    centres = written(
        ranked.groupBy("band").agg(
            F.min(F.struct("doc_id", "n")).alias("c1"), F.max(F.when(even, best)).alias("c2"), F.max(F.when(~even, best)).alias("c3")
        ).select("band", F.array_distinct(F.array_compact(F.array("c1", F.when(F.col("c2").isNotNull(), F.struct("c2.doc_id", "c2.n")), F.when(F.col("c3").isNotNull(), F.struct("c3.doc_id", "c3.n"))))).alias("centres")),
        "centres",
    )
    pairs = shared.join(centres, "band").select("doc_id", "n", F.explode("centres").alias("c")).where(
        f"doc_id <> c.doc_id and 100 * least(n, c.n) >= {percent} * greatest(n, c.n)"
    ).groupBy("doc_id", F.col("c.doc_id").alias("centre")).agg(F.count("*").alias("bands"))
    out = written(pairs, "pairs")
    discard(centres)
    return out


def relabelled(every: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """every (doc_id, label) after links (a, b) between labels."""
    to = components(links)
    out = written(every.join(to.select("id", F.col("label").alias("to")), F.col("label") == F.col("id"), "left").select("doc_id", F.coalesce("to", "label").alias("label")), name)
    discard(to)
    return out


def joined(pairs: DataFrame, every: DataFrame, texts: DataFrame, words: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """(every with the labels that links give, the link tables): of pairs (doc_id, centre, bands), first each document's
    best one is confirmed, then those that could still join two components."""
    first = pairs.groupBy("doc_id").agg(F.max(F.struct("bands", (-F.col("centre")).alias("centre"))).alias("best")).select("doc_id", (-F.col("best.centre")).alias("centre"))
    stars = written(confirm(first.select(F.least("doc_id", "centre").alias("a"), F.greatest("doc_id", "centre").alias("b")).distinct(), texts, words, percent), "links")
    every = relabelled(every, stars, "labelled")
    left, right = every.select("doc_id", F.col("label").alias("la")), every.select(F.col("doc_id").alias("centre"), F.col("label").alias("lb"))
    open_ = pairs.join(left, "doc_id").join(right, "centre").where("la <> lb").select(F.least("doc_id", "centre").alias("a"), F.greatest("doc_id", "centre").alias("b")).distinct()
    met = confirm(open_, texts, words, percent)
    met = met.join(left.withColumnRenamed("doc_id", "a"), "a").join(right.withColumnRenamed("centre", "b"), "b")
    bridges = written(met.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "links")
    return (relabelled(every, bridges, "labelled") if bridges.limit(1).count() else every), [stars, bridges]


def near_duplicates(docs: DataFrame, words: int = 2, percent: int = 80, permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id reachable over
    links of at least `percent` per cent similarity), kept (doc_id = component_id)."""
    docs = docs.select("doc_id", "text")
    sig = written(signatures(docs, words, permutations, rows), "signatures")
    classes = written(
        sig.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
        .where("n > 1").drop("n"), "classes",
    )
    members = written(
        sig.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")), "members"
    )
    reps = members.where("rep = doc_id").select("doc_id").distinct()
    posted = sig.where("size(bands) > 0 and doc_id is not null").join(reps, "doc_id", "left_semi").select(
        "doc_id", F.col("n_shingles").alias("n"), F.explode("bands").alias("band")
    )
    sizes = posted.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    shared = written(posted.join(sizes, "band").select("band", "doc_id", "n", "size"), "shared")
    common = written(shared.groupBy("doc_id").agg(F.sum("size").alias("common")), "common")
    discard(sig, classes)
    texts = written(docs.join(common.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]), "texts")
    pairs = candidates(shared, common, percent)
    every, links = joined(pairs, common.select("doc_id", F.col("doc_id").alias("label")), texts, words, percent)
    discard(pairs, common, *links)

    totals = written(every.groupBy("label").agg(F.count("*").alias("size")), "totals")
    at = shared.select("band", "doc_id").join(every, "doc_id")
    counts = at.join(totals, "label").groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max(F.struct("size", "label")).alias("family"))
    mixed = written(counts.where("low < high").select("band", F.col("family.label").alias("family")), "mixed")
    apart = written(at.join(mixed, "band").where("label <> family").select("family", "doc_id").distinct(), "apart")
    discard(shared, mixed, totals)
    found = written(confirm_families(apart, every, texts, words, percent, spanning=True).distinct(), "links")
    discard(texts, apart)
    # Rows of one id are one document: what they stand for is linked.
    several = members.where("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("doc_id", "low")
    own = members.join(several, "doc_id").where("rep > low").select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct()
    label = F.coalesce("label", "rep")
    ends = own.join(every.select(F.col("doc_id").alias("a"), F.col("label").alias("la")), "a", "left").join(every.select(F.col("doc_id").alias("b"), F.col("label").alias("lb")), "b", "left")
    own = ends.select(F.coalesce("la", "a").alias("x"), F.coalesce("lb", "b").alias("y")).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    found = written(found.unionByName(own), "links")
    out = members.join(every.select(F.col("doc_id").alias("id"), "label"), F.col("rep") == F.col("id"), "left").select("doc_id", "n_shingles", label.alias("at"))
    if found.limit(1).count():
        out = out.join(components(found), F.col("at") == F.col("id"), "left").select("doc_id", "n_shingles", F.coalesce("label", "at").alias("at"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("at")).alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

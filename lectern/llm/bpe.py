"""Byte-level BPE encoding and decoding with content-defined chunk reuse.

Each text is cut into chunks where a rolling hash of its last 16 bytes has its low bits zero, so texts
that share a passage share its chunks. Within a task a chunk is encoded once, however many documents
hold it (a table of bounded size); a chunk's ids are then joined to its neighbour's. A join is
repaired by re-encoding the text around it, from a boundary that holds in any context to the next
such boundary, and only where the chunks' own ids agree exactly with the re-encoded sides; else the
window grows, at the end to both chunks whole. The result equals encoding the text in one piece.

A boundary between a character that is not white space and one that is holds in any context: no
alternative of the pre-tokenisation pattern has white space after its first character unless it is
white space only, and no added token holds any.

The merges run in tiktoken on the ranks that the vocabulary file holds, with the file's added tokens
recognised in texts; ids equal those of the tokenizers library with add_special_tokens=False.

Scale: no shuffle. Chunks are reused within a task; sharing them across tasks would move every shared
chunk's ids twice, which costs more than encoding them.

Defined cases: a null or empty text encodes to no ids, and null or empty ids decode to an empty text.
Ids that don't form UTF-8 decode with U+FFFD in place of each broken sequence. Rows are kept as they
are, repeated ones too, and other columns stay; a clash with the output column's name is replaced.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lectern.llm import arrow_text as A
from lectern.llm.shared import single_threaded

#: The pre-tokenisation pattern of the byte-level vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK_BITS, CHUNK_MIN, CHUNK_MAX = 11, 512, 16384
#: Chunks a task keeps.
KEPT_CHUNKS = 5_000
#: Bytes of texts or ids a task works on at a time.
SLICE = 2 << 20
SOLID = re.compile(r"(?<=\S)(?=\s)")


@lru_cache(2)
def vocabulary(path: str):
    """(tiktoken encoding, bytes of all tokens, starts by id, lengths by id) of a vocabulary file."""
    import tiktoken

    single_threaded()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
    ranks = {bytes(byte_of[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in added}
    encoding = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
    tokens = {v: k for k, v in ranks.items()} | {v: k.encode() for k, v in added.items()}
    by_id = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
    lengths = np.array([len(t) for t in by_id], dtype=np.int64)
    return encoding, np.frombuffer(b"".join(by_id), dtype=np.uint8), np.cumsum(lengths) - lengths, lengths


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes that end at each byte."""
    with np.errstate(over="ignore"):
        h = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(2654435761)
        h ^= h >> np.uint32(15)
        for step in (1, 2, 4, 8):
            h[step:] += h[:-step].copy() << np.uint32(step)
    return h >> np.uint32(9)


def cuts(candidates: np.ndarray, data: np.ndarray, start: int, end: int) -> list[int]:
    """Chunk ends of the text at data[start:end]; candidates: where a chunk may end, ascending."""
    out, at = [], start
    for c in candidates[np.searchsorted(candidates, start + CHUNK_MIN) : np.searchsorted(candidates, end)].tolist():
        while c - at > CHUNK_MAX:
            at = _whole(data, at + CHUNK_MAX)
            out.append(at)
        if c - at >= CHUNK_MIN:
            out.append(c)
            at = c
    while end - at > CHUNK_MAX + CHUNK_MIN:
        at = _whole(data, at + CHUNK_MAX)
        out.append(at)
    return [*out, end]


def _whole(data: np.ndarray, at: int) -> int:
    """The last start of a character at or before `at`."""
    while data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def join(encode, left: str, left_ids: np.ndarray, right: str, right_ids: np.ndarray) -> tuple[int, np.ndarray, int] | None:
    """(ids of left that stay, ids between, ids of right that go) where left + right is encoded as the
    ids of left up to there, those between and the rest of right's; None if no such place is found."""
    reach = 32
    while True:
        tail, head = left[-reach:], right[:reach]
        b = next((m.start() for m in SOLID.finditer(tail)), None)
        e = next((m.start() for m in SOLID.finditer(head)), None)
        if b is not None and e is not None:
            old_l, old_r = encode(tail[b:]), encode(head[:e])
            stay = len(left_ids) - len(old_l)
            if stay >= 0 and np.array_equal(left_ids[stay:], old_l) and np.array_equal(right_ids[: len(old_r)], old_r):
                return stay, encode(tail[b:] + head[:e]), len(old_r)
        if reach >= max(len(left), len(right)):
            return None
        reach *= 8


def encode_batch(values: np.ndarray, offsets: np.ndarray, encode, kept: dict) -> list[np.ndarray]:
    """Ids of each text of a batch; kept: ids by chunk, shared by a task's batches."""
    base = int(offsets[0])
    data = values[base : int(offsets[-1])]
    if len(data):
        mark = (rolling_hash(data) & np.uint32((1 << CHUNK_BITS) - 1)) == 0
        candidates = np.flatnonzero(mark) + 1
        candidates = candidates[candidates < len(data)]
        candidates = candidates[(data[candidates] & 0xC0) != 0x80]
    out = []
    for start, end in zip((offsets[:-1] - base).tolist(), (offsets[1:] - base).tolist(), strict=True):
        if start == end:
            out.append(np.empty(0, np.uint32))
            continue
        parts: list[np.ndarray] = []
        text, ids, used = "", None, 0
        for stop in cuts(candidates, data, start, end):
            raw = data[start:stop].tobytes()
            start = stop
            chunk = raw.decode()
            got = kept.get(raw)
            if got is None:
                if len(kept) >= KEPT_CHUNKS:
                    kept.pop(next(iter(kept)))
                got = kept[raw] = encode(chunk)
            if ids is None:
                text, ids = chunk, got
            elif (joint := join(encode, text, ids, chunk, got)) and joint[0] >= used:
                parts += [ids[used : joint[0]], joint[1]]
                text, ids, used = chunk, got, joint[2]
            else:  # no such place: both in one piece, whose first `used` ids end at a boundary and so stay
                text += chunk
                ids = encode(text)
        out.append(np.concatenate([*parts, ids[used:]]) if parts else ids)
    return out


def _with(batch: pa.RecordBatch, name: str, array: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(n)) for n in names), array], [*names, name])


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, kind)])


def _encoder(path: str, text: str, ids: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary(path)[0]
        kept: dict = {}

        def one(s: str) -> np.ndarray:
            return encoding.encode_to_numpy(s, allowed_special="all")

        for batch in A.slices(batches, text, SLICE):
            found = encode_batch(*A.text_buffers(A.column(batch, text)), one, kept)
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = np.concatenate(found).astype(np.int32) if found else np.empty(0, np.int32)
            yield _with(batch, ids, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))

    return run


def _decoder(path: str, ids: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, tokens, starts, lengths = vocabulary(path)
        for batch in A.slices(batches, ids, SLICE):
            column = A.column(batch, ids)
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            n = lengths[flat]
            before = np.cumsum(n) - n
            data = tokens[np.repeat(starts[flat] - before, n) + np.arange(int(n.sum()))]
            ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield _with(batch, text, pa.array(texts, pa.string()))

    return run


def encode(docs: DataFrame, vocabulary_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with `ids`, the token ids of `text`."""
    return docs.mapInArrow(_encoder(vocabulary_path, text, ids), _schema(docs, ids, T.ArrayType(T.IntegerType())))


def decode(docs: DataFrame, vocabulary_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """docs with `text`, what the token ids in `ids` stand for; special tokens are kept."""
    return docs.mapInArrow(_decoder(vocabulary_path, ids, text), _schema(docs, text, T.StringType()))


def round_trip(docs: DataFrame, vocabulary_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """encode, then decode what it gave, in one Python worker a task instead of two."""
    encoder, decoder = _encoder(vocabulary_path, text, ids), _decoder(vocabulary_path, ids, decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return decoder(encoder(batches))

    schema = T.StructType([*(f for f in docs.schema.fields if f.name not in (ids, decoded)), T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])
    return docs.mapInArrow(run, schema)

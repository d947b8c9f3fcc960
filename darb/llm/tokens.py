"""Encoding a whole corpus with a public byte-level BPE tokenizer, encoding shared text once.

Method: content-defined chunk reuse. A rolling hash over the characters cuts each text where the text itself
says so, hence passages that documents share fall into equal chunks. Distinct chunks are encoded once. A
document's ids are then joined from those of its chunks, and each joint is repaired: from the last piece
boundary that the text behind the joint can't move, the text is split and encoded again, further and further
into the next chunk, until a boundary falls on one of that chunk's own; from there on its ids are exact.

Why that is exact: the tokenizer's pattern splits text from left to right without looking behind, so two splits
that share one boundary share all later ones as far as they see the same text; and a piece depends on at most
two characters behind its end and three behind its start, so all but the last three pieces of a chunk stand
whatever follows. The merges never cross pieces. Chunks need no text of their own after encoding: the ids
decode to it.

Plan: first only the chunks' 128-bit digests are counted, with map-side combining; which occur more than once goes
to the workers as a bitmap of bounded size (a chunk taken for a repeated one by accident is merely shared by one
document). In one pass over the texts, documents without repeated chunks, and what lies between repeated chunks
in the others, are encoded where they are; the text of a repeated chunk leaves a task once and is encoded once.
References to repeated chunks are joined with their encodings on the digest, those of hot chunks (in over 1/2000
of all places, hence under 2000 chunks) salted; one shuffle by document brings the parts of the documents that
have repeated chunks together. A task holds one document at a time.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darb.session import durable

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the public pattern that splits a text into pieces before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

MIN_CHUNK, MAX_CHUNK, CUT_BITS, HELD_BACK = 64, 4096, 8, 3
HOT_SHARE, HOT_ROWS = 2000, 10_000
#: The bitmap of repeated chunks: bits a chunk, and bits at most and in a segment.
BITS_A_CHUNK, MOST_BITS, SEGMENT_BITS = 16, 1 << 29, 1 << 16
KEPT = 1_000_000  # names that a task remembers at once


class Tokenizer:
    """A rank file's encoding, with the pieces of a text visible."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self._encoding = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._split = regex.compile(PATTERN).findall
        self._known: dict[str, list[int]] = {}
        self.width = np.uint16 if max(ranks.values(), default=0) < 1 << 16 else np.uint32  # of an id in store

    def pieces(self, text: str) -> list[str]:
        return self._split(text)

    def ids(self, piece: str) -> list[int]:
        """Ids of one piece; short pieces are remembered, up to a bound."""
        if (found := self._known.get(piece)) is None:
            found = self._encoding.encode_ordinary(piece)
            if len(piece) < 32:
                if len(self._known) > 200_000:
                    self._known.clear()
                self._known[piece] = found
        return found

    def whole(self, text: str) -> list[int]:
        return self._encoding.encode_ordinary(text)

    def packed(self, text: str) -> bytes:
        """The ids of a whole text, as they are stored."""
        return np.array(self._encoding.encode_ordinary(text), self.width).tobytes()

    def text(self, ids: list[int]) -> str:
        return self._encoding.decode_bytes(ids).decode()


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def cut_points(codes: np.ndarray) -> np.ndarray:
    """Positions behind which the rolling hash of the last 32 characters asks for a cut."""
    with np.errstate(over="ignore"):
        h = codes.astype(np.uint32) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA77)
        for width in (1, 2, 4, 8, 16):  # h[i] becomes the sum over j < 2 * width of h[i - j] << j
            shifted = h[:-width] << np.uint32(width)
            h[width:] += shifted
    return np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1


def chunks(text: str) -> list[str]:
    """`text` cut by its content, between MIN_CHUNK and MAX_CHUNK characters a chunk (the last may be shorter)."""
    if len(text) <= MIN_CHUNK:
        return [text] if text else []
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    out, start = [], 0
    for cut in [*cut_points(codes).tolist(), len(text)]:
        while cut - start > MAX_CHUNK:
            out.append(text[start : start + MAX_CHUNK])
            start += MAX_CHUNK
        if cut - start >= MIN_CHUNK or cut == len(text) and cut > start:
            out.append(text[start:cut])
            start = cut
    return out


def encode_chunk(t: Tokenizer, text: str) -> tuple[list[int], list[int]]:
    """(ids, number of ids of each piece) of a chunk by itself."""
    ids: list[int] = []
    sizes: list[int] = []
    for piece in t.pieces(text):
        found = t.ids(piece)
        ids.extend(found)
        sizes.append(len(found))
    return ids, sizes


def join_chunks(t: Tokenizer, parts: Iterator[tuple[list[int], list[int]]]) -> list[int]:
    """Ids of the text whose chunks, in order, have these encodings.

    A repair that finds no agreement takes twice as many pieces each time, over as many chunks as that needs, so the
    work is linear in the text even where it has no boundaries.
    """
    out: list[int] = []
    parts = iter(parts)
    ahead: deque[tuple[list[int], list[int]]] = deque()  # chunks behind `pending`
    pending = ""  # text behind the last certain boundary, up to the first of `ahead`

    def reach(k: int) -> bool:
        while len(ahead) <= k:
            if (part := next(parts, None)) is None:
                return False
            ahead.append(part)
        return True

    while reach(0):
        first = 0  # pieces of the next chunk that the repair has used up
        if pending:
            own: dict[int, tuple[int, int]] = {}  # boundaries of the chunks, as places in pending + head
            head: list[str] = []
            at, k, i, done, take, met = len(pending), 0, 0, 0, HELD_BACK + 1, None
            while met is None and reach(k):
                for _ in range(take):
                    if not reach(k):
                        break
                    ids, sizes = ahead[k]
                    own[at] = (k, i)
                    head.append(t.text(ids[done : done + sizes[i]]))
                    at, done, i = at + len(head[-1]), done + sizes[i], i + 1
                    if i == len(sizes):
                        k, i, done = k + 1, 0, 0
                fresh, place = t.pieces(pending + "".join(head)), 0
                for n in range(len(fresh) - HELD_BACK):
                    place += len(fresh[n])
                    if place in own:
                        met = own[place]
                        break
                take *= 2
            if met is None:  # the text ends first
                pending += "".join(head)
                break
            for piece in fresh[: n + 1]:
                out.extend(t.ids(piece))
            for _ in range(met[0]):
                ahead.popleft()
            first = met[1]
        ids, sizes = ahead.popleft()
        last = max(first, len(sizes) - HELD_BACK)
        begin, end = sum(sizes[:first]), sum(sizes[:last])
        out.extend(ids[begin:end])
        pending = t.text(ids[end:])
    for piece in t.pieces(pending):
        out.extend(t.ids(piece))
    return out


def pack(numbers: list[int]) -> bytes:
    """Small numbers in one byte each, or all in two if one needs it; the first byte says which."""
    small = max(numbers, default=0) < 256
    return (b"\1" if small else b"\2") + np.array(numbers, np.uint8 if small else np.uint16).tobytes()


def unpack(data: bytes) -> list[int]:
    return np.frombuffer(data, np.uint8 if data[:1] == b"\1" else np.uint16, offset=1).tolist()


def _digest(text: str) -> bytes:
    return blake2b(text.encode(), digest_size=16).digest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_digest(part) for text in batch.column(0).to_pylist() for part in chunks(text)]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["digest"])


def _place(digest: bytes, bits: int) -> int:
    return int.from_bytes(digest[:8], "little") & (bits - 1)


def _bit_places(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.array([_place(d, bits) for d in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(places // SEGMENT_BITS, pa.int32()), pa.array(places % SEGMENT_BITS, pa.int32())], names=["segment", "bit"])

    return run


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each segment of the bitmap, of rows (segment, bit) that a task has all of."""
    made: dict[int, np.ndarray] = {}
    for batch in batches:
        segments, places = (batch.column(i).to_numpy() for i in range(2))
        for segment in np.unique(segments).tolist():
            bits = made.setdefault(segment, np.zeros(SEGMENT_BITS // 8, np.uint8))
            at = places[segments == segment]
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int32()), pa.array([b.tobytes() for b in made.values()], pa.binary())], names=["segment", "bits"])


def repeated_chunks(texts: DataFrame) -> tuple[bytes, int]:
    """A bitmap, with its number of bits (at most MOST_BITS), that has the place of every chunk which occurs more than once."""
    counts = texts.mapInArrow(_digests, "digest binary").groupBy("digest").agg(F.count("*").alias("n"))
    repeated = durable(counts.where("n > 1").select("digest"))
    bits = SEGMENT_BITS
    while bits < min(MOST_BITS, repeated.count() * BITS_A_CHUNK):
        bits *= 2
    out = bytearray(bits // 8)
    for row in repeated.mapInArrow(_bit_places(bits), "segment int, bit int").repartition("segment").mapInArrow(_segments, "segment int, bits binary").collect():  # at most MOST_BITS
        begin = row["segment"] * SEGMENT_BITS // 8
        out[begin : begin + SEGMENT_BITS // 8] = row["bits"]
    return bytes(out), bits


def text_parts(text: str, bitmap: bytes, bits: int) -> list[tuple[str, bytes | None]]:
    """The text as parts (text, digest): repeated chunks, and what lies between them, without a digest."""
    out: list[tuple[str, bytes | None]] = []
    between: list[str] = []
    for part in chunks(text):
        digest = _digest(part)
        place = _place(digest, bits)
        if not bitmap[place >> 3] >> (place & 7) & 1:
            between.append(part)
            continue
        if between:
            out.append(("".join(between), None))
            between = []
        out.append((part, digest))
    if between:
        out.append(("".join(between), None))
    return out


_PARTS = "doc_id bigint, text_key binary, seq int, digest binary, chunk string, ids binary, sizes binary"


def _parts(path: str, bitmap: bytes, bits: int):
    """Rows of _PARTS: a document encoded whole (seq -1), or its parts; a repeated chunk has its text once in a task and no ids yet."""
    types = (pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.string(), pa.binary(), pa.binary())
    names = [c.split()[0] for c in _PARTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        sent: set[bytes] = set()  # chunks whose text has left, and documents in parts, as repeated rows need only one
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = text_parts(text, bitmap, bits)
                size += len(text)
                if len(parts) == 1 and parts[0][1] is None:
                    rows.append((doc_id, None, -1, None, None, t.packed(text), None))
                else:
                    key = _digest(text)
                    if len(sent) > KEPT:
                        sent.clear()
                    if (name := b"%d:%s" % (doc_id, key) if doc_id is not None else key) in sent:
                        continue
                    sent.add(name)
                    for i, (part, digest) in enumerate(parts):
                        if digest is None:
                            ids, sizes = encode_chunk(t, part)
                            rows.append((doc_id, key, i, None, None, np.array(ids, t.width).tobytes(), pack(sizes)))
                        else:
                            rows.append((doc_id, key, i, digest, None if b"=" + digest in sent else part, None, None))
                            sent.add(b"=" + digest)
                if size > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], names=names)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], names=names)

    return run


def _unpacked(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = tokenizer(path).width
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                found = [np.frombuffer(x, width) for x in part.column(1).to_pylist()]
                offsets = np.cumsum([0, *map(len, found)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).astype(np.int32) if found else [], pa.int32()))], names=["doc_id", "ids"])

    return run


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                ids, sizes = [], []
                for text in part.column(1).to_pylist():
                    a, b = encode_chunk(t, text)
                    ids.append(np.array(a, t.width).tobytes())
                    sizes.append(pack(b))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(sizes, pa.binary()), part.column(2)], names=["digest", "ids", "sizes", "n"])

    return run


def _assemble(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        docs: list = []
        offsets, values = [0], []

        def flush() -> pa.RecordBatch:
            flat = np.concatenate(values) if values else np.array([], np.int32)
            return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))], names=["doc_id", "ids"])

        current, parts = None, []

        def close() -> None:
            if len(parts) == 1:
                found = np.array(parts[0][0], np.int32)
            else:
                found = np.array(join_chunks(t, iter(parts)), np.int32)
            docs.append(current[0])
            values.append(found)
            offsets.append(offsets[-1] + len(found))

        for batch in batches:
            for doc_id, key, ids, sizes in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
                if (doc_id, key) != current:
                    if current is not None:
                        close()
                    current, parts = (doc_id, key), []
                parts.append((np.frombuffer(ids, t.width).tolist(), unpack(sizes)))
                if offsets[-1] > 1_000_000:
                    yield flush()
                    docs, offsets, values = [], [0], []
        if current is not None:
            close()
            yield flush()

    return run


def encode_corpus(documents: DataFrame, path: str = BYTE_BPE) -> DataFrame:
    """p6: (doc_id bigint, ids array<int>) of each document's `text`, without special tokens.

    Empty and null texts give an empty list; strings of special tokens in a text are ordinary text. A repeated
    row (equal id and text) is one document; a null doc_id is kept as such; other columns are ignored whatever
    their names. `path` is the rank file, read by every worker.
    """
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = texts.where("text <> ''")
    bitmap, bits = repeated_chunks(known.select("text"))
    parts = durable(known.mapInArrow(_parts(path, bitmap, bits), _PARTS))
    whole = parts.where("seq < 0").select("doc_id", "ids").mapInArrow(_unpacked(path), "doc_id bigint, ids array<int>")
    empty = texts.where("text IS NULL OR text = ''").distinct().select("doc_id", F.array().cast("array<int>").alias("ids"))
    shared = parts.where("digest IS NOT NULL")
    distinct = shared.groupBy("digest").agg(F.first("chunk", ignorenulls=True).alias("chunk"), F.count("*").alias("n"))
    encoded = durable(distinct.mapInArrow(_encode(path), "digest binary, ids binary, sizes binary, n bigint"))
    places = encoded.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    many = max(HOT_ROWS, places // HOT_SHARE)
    hot = encoded.where(F.col("n") > many).select("digest", F.ceil(F.col("n") / many).cast("int").alias("salts"))  # under HOT_SHARE rows
    salted = shared.select("doc_id", "text_key", "seq", "digest").join(F.broadcast(hot), "digest", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id", "seq"), F.col("salts")), F.lit(0)).cast("int"))
    copies = encoded.withColumn("salt", F.explode(F.when(F.col("n") > many, F.sequence(F.lit(0), F.ceil(F.col("n") / many).cast("int") - 1)).otherwise(F.array(F.lit(0)))))
    columns = ["doc_id", "text_key", "seq", "ids", "sizes"]
    joined = salted.join(copies.select("digest", "salt", "ids", "sizes"), ["digest", "salt"]).select(columns)
    between = parts.where("seq >= 0 AND digest IS NULL").select(columns)
    # equal rows come in equal copies; one of each is enough
    placed = joined.unionByName(between).repartition("doc_id", "text_key").sortWithinPartitions("doc_id", "text_key", "seq")
    repaired = placed.mapInArrow(_once, "doc_id bigint, text_key binary, seq int, ids binary, sizes binary").mapInArrow(_assemble(path), "doc_id bigint, ids array<int>")
    return whole.unionByName(repaired).unionByName(empty)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows without those that repeat the (doc_id, text_key, seq) before them."""
    last = object()
    for batch in batches:
        keep = []
        for key in zip(*(batch.column(i).to_pylist() for i in range(3))):
            keep.append(key != last)
            last = key
        yield batch.filter(pa.array(keep, pa.bool_()))

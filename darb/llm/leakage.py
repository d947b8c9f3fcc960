"""Passages of held-out items inside a large corpus.

Method: q-gram lemma filtering. A region of L characters with at most k edits shares at least L + 1 - q(k + 1)
q-grams with what it was made from, and they lie on neighbouring diagonals (position in the document minus
position in the item). Shared q-grams are counted in overlapping diagonal bands, the stretches of a band that
hold enough of them within L + k characters are kept as regions, and every region is verified by banded
alignment. A passage is at least `min_words` words of an item, so L is the shortest run of that many words of
the item. An edit near a passage's end hides up to q grams of it, so a region is aligned with the characters
around it that k edits can hide, on both sides; so no passage within the edit budget is lost. An exact check on
words may follow.

Plan: the items are a query set. If they fit one block (`block_chars`), its q-gram index goes to the workers and
the documents are read once, in one Arrow pass without a shuffle but for the distinct of the result. If they
don't, documents are first joined with the items on minimizers (the least gram hash of every window that an
unedited part of a passage fills), which reads the corpus once; the documents that share one, with the blocks
they share it with, are written once, and each block looks at its own among those.

Memory: a slice of documents is cut by characters; hits are expanded in pieces of at most MOST_HITS, by items
and, for one item's repeating grams, by diagonals, so a phrase that all items have costs time but no memory;
alignments run in groups of bounded cells. Nothing is capped.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darb.session import durable

Q, MIN_WORDS, EDITS, EDIT_COST = 8, 12, 1, 3
BLOCK_CHARS, SLICE_CHARS = 4_000_000, 500_000
MOST_HITS, MOST_CELLS, MOST_HELD = 1_000_000, 2_000_000, 4_000_000
LONGEST = 1 << 20  # characters of a region that are aligned in one go
_HASH_BITS, _COUNT_BITS = 22, 20


@lru_cache(maxsize=1)
def _patterns():
    """(format characters, words)"""
    import regex

    return regex.compile(r"\p{Cf}+"), regex.compile(r"[\p{L}\p{N}]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits of the text without format characters (Cf), after NFKC and lower-casing."""
    if not text:
        return []
    formats, words = _patterns()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", formats.sub("", text))
    return words.findall(text.lower())


def gram_hashes(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """64-bit hash of the q characters that start at each position (of the positions that have as many)."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    n = len(codes) - q + 1
    with np.errstate(over="ignore"):
        # a polynomial of the characters; runs of 1, 2, 4, ... are put together as q's binary digits ask for
        power, run, factor = 1, codes.astype(np.uint64), np.uint64(0x9E3779B97F4A7C15)
        out, taken = None, 0
        while True:
            if q & power:
                out = run[:n].copy() if out is None else out * factor + run[taken : taken + n]
                taken += power
            if 2 * power > q:
                break
            run = run[:-power] * factor + run[power:]
            factor, power = factor * factor, 2 * power
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


@dataclass
class Index:
    """The q-grams of a block of items."""

    ids: np.ndarray  # item ids
    texts: list[str]  # normalised words with a space between them
    codes: np.ndarray  # the characters of all items, one behind the other
    offsets: np.ndarray  # where each item starts in `codes`, with the end behind the last
    shortest: np.ndarray  # characters of the shortest min_words words of each item
    grams: np.ndarray  # sorted distinct hashes
    starts: np.ndarray  # of each gram's postings, with the end behind the last
    places: np.ndarray  # postings: positions in `codes`, rising within a gram
    filter: np.ndarray  # which low hash bits occur

    def passages(self, i: int, min_words: int) -> set[str]:
        """All runs of min_words words of an item; those of the last items asked for are kept."""
        kept = self.__dict__.setdefault("_passages", {})
        if i not in kept:
            if len(kept) > 1000:
                kept.clear()
            w = self.texts[i].split(" ")
            kept[i] = {" ".join(w[k : k + min_words]) for k in range(len(w) - min_words + 1)}
        return kept[i]


def _shortest(words: list[str], n: int) -> int:
    """Characters of the shortest n successive words with a space between them."""
    ends = np.cumsum([0, *(len(x) + 1 for x in words)])
    return int((ends[n:] - ends[:-n]).min()) - 1


def build_index(items: list[tuple[int, str]], min_words: int = MIN_WORDS, q: int = Q) -> Index:
    """Index of (item_id, text); items with fewer than `min_words` words can't leak and are left out."""
    ids, texts, shortest, codes, hashes, places, offsets = [], [], [], [], [], [], [0]
    for item_id, text in items:
        w = words_of(text)
        if len(w) < min_words:
            continue
        joined = " ".join(w)
        own = _codes(joined)
        h = gram_hashes(own, q)
        hashes.append(h)
        places.append(np.arange(offsets[-1], offsets[-1] + len(h), dtype=np.int64))
        offsets.append(offsets[-1] + len(own))
        codes.append(own)
        shortest.append(_shortest(w, min_words))
        ids.append(item_id)
        texts.append(joined)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    order = np.argsort(h, kind="stable")
    grams, starts = np.unique(h[order], return_index=True)
    low = np.zeros(1 << _HASH_BITS, bool)
    low[(grams & np.uint64((1 << _HASH_BITS) - 1)).astype(np.int64)] = True
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return Index(np.array(ids, np.int64), texts, cat(codes).astype(np.uint32), np.array(offsets, np.int64), np.array(shortest, np.int64), grams, np.append(starts, len(h)).astype(np.int64), cat(places)[order], low)


def _known_grams(index: Index, codes: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, number of the gram) of every q-gram of the text that an item has."""
    h = gram_hashes(codes, q)
    at = np.flatnonzero(index.filter[(h & np.uint64((1 << _HASH_BITS) - 1)).astype(np.int64)])
    if not len(at) or not len(index.grams):
        return (np.zeros(0, np.int64),) * 2
    found = h[at]
    gram = np.minimum(np.searchsorted(index.grams, found), len(index.grams) - 1)
    same = index.grams[gram] == found
    return at[same], gram[same]


def _expanded(index: Index, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, place in the items) of each hit with postings low to high."""
    counts = high - low
    posting = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    return np.repeat(at, counts), index.places[posting]


def _pieces(index: Index, at: np.ndarray, gram: np.ndarray, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The hits (position, place in the items) in pieces of about MOST_HITS.

    Pieces are whole items, or ranges of diagonals of one item that overlap by a band, so that every band of every
    item is whole in a piece.
    """
    low, high = index.starts[gram], index.starts[gram + 1]
    if int((high - low).sum()) <= MOST_HITS:
        yield _expanded(index, at, low, high)
        return
    times = np.bincount(gram, minlength=len(index.grams))
    owner = np.searchsorted(index.offsets, index.places, side="right") - 1
    per_item = np.bincount(owner, weights=np.repeat(times, np.diff(index.starts)), minlength=len(index.ids))
    size = int(index.offsets[-1]) + 1
    keys = np.repeat(np.arange(len(index.grams)), np.diff(index.starts)) * size + index.places  # sorted
    names, which = np.unique(gram, return_inverse=True)

    def upto(place):  # postings of each hit's gram before a place, one for all or one per hit
        if np.ndim(place):
            return np.clip(np.searchsorted(keys, gram * size + np.clip(place, 0, size - 1)), low, high)
        return np.searchsorted(keys, names * size + place)[which]

    upto_item = np.cumsum(per_item)
    begin = 0
    while begin < len(index.ids):
        fits = int(np.searchsorted(upto_item, (upto_item[begin - 1] if begin else 0) + MOST_HITS, side="right")) - begin
        end = begin + max(1, fits)
        first, behind = int(index.offsets[begin]), int(index.offsets[end])
        if fits:
            yield _expanded(index, at, upto(first), upto(behind))
        elif per_item[begin]:
            todo = [(int(at[0]) - behind, int(at[-1]) - first + 1)]
            while todo:
                d0, d1 = todo.pop()
                a, b = upto(np.maximum(at - d1 + 1, first)), upto(np.minimum(at - d0 + 1, behind))
                b = np.maximum(a, b)
                if int((b - a).sum()) <= MOST_HITS or d1 - d0 <= 8 * step:
                    yield _expanded(index, at, a, b)
                else:
                    middle = (d0 + d1) // 2
                    todo += [(d0, middle + 2 * step), (middle - 2 * step, d1)]
        begin = end


def _dense(at: np.ndarray, group: np.ndarray, need, reach) -> np.ndarray:
    """Which hits belong to a stretch of `need` hits of one group within `reach` positions; groups and positions rise."""
    end = np.arange(len(at)) + need - 1  # the hit that completes the count
    inside = end < len(at)
    end = np.minimum(end, len(at) - 1)
    good = inside & (group[end] == group) & (at[end] - at <= reach)
    cover = np.bincount(np.flatnonzero(good), minlength=len(at) + 1) - np.bincount(end[good] + 1, minlength=len(at) + 1)
    return np.cumsum(cover[:-1]) > 0


def regions(index: Index, codes: np.ndarray, bounds: np.ndarray, q: int = Q, edits: int = EDITS) -> np.ndarray:
    """Rows (document, item, first, last, first in item): regions that pass the filter.

    `codes` are the documents' characters one behind the other, `bounds` where each starts, with the end; first
    and last are the first characters of a region's outermost grams in `codes`.
    """
    none = np.zeros((0, 5), np.int64)
    at, gram = _known_grams(index, codes, q)
    if not len(at):
        return none
    need_of = np.maximum(1, index.shortest + 1 - q * (edits + 1))
    reach_of = index.shortest - q + edits
    # a region of any item needs that many positions with known grams near each other
    near = _dense(at, np.searchsorted(bounds, at, side="right"), int(need_of.min()), int(reach_of.max()))
    at, gram = at[near], gram[near]
    step = edits + 1  # any edits + 1 neighbouring diagonals lie in one band of twice that width
    found = []
    for position, place in _pieces(index, at, gram, step) if len(at) else ():
        if not len(position):
            continue
        item = np.searchsorted(index.offsets, place, side="right") - 1
        diagonal = position - place
        diagonal -= diagonal.min()
        for shift in (0, step):
            band = (diagonal + shift) // (2 * step)
            key = item * (int(band.max()) + 1) + band
            # bands with too few grams go first: counted by a hash, which can only add
            bucket = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _COUNT_BITS)).astype(np.int64)
            enough = np.flatnonzero(np.bincount(bucket, minlength=1 << _COUNT_BITS)[bucket] >= need_of[item])
            if not len(enough):
                continue
            # hits come in order of their positions, hence of their documents; a stable sort keeps that in each band
            order = enough[np.argsort(key[enough], kind="stable")]
            i, b, a, x = item[order], key[order], position[order], place[order]
            d = np.searchsorted(bounds, a, side="right") - 1
            new = np.concatenate([[True], (d[1:] != d[:-1]) | (b[1:] != b[:-1])])
            # repeated grams of an item may hit one position more than once; more hits never lose a region
            covered = _dense(a, np.cumsum(new), need_of[i], reach_of[i])
            if not covered.any():
                continue
            # stretches are united where they overlap
            opens = covered & (np.concatenate([[True], ~covered[:-1]]) | new)
            run = np.cumsum(opens)[covered]
            first = np.flatnonzero(opens)
            last = first + np.bincount(run - 1) - 1
            found.append(np.stack([d[first], i[first], a[first], a[last], x[first] - index.offsets[i[first]]], axis=1))
    return np.unique(np.concatenate(found), axis=0) if found else none


_ONE, _EDIT, _NONE = 1 << 42, 1 << 21, 1 << 41


def banded_alignment(a: list[np.ndarray], b: list[np.ndarray], band: int, before: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, edits, characters of a) of the best local alignment of each pair of code arrays.

    A match counts 1 and an edit (replacement, insertion, deletion) -EDIT_COST; of equal scores the one with the
    fewest edits, then the longest counts. Only cells within `band` diagonals of the start's are computed; `before`
    is how many characters of each b (at most `band`; less than 0: none yet) come before the place where a starts. All pairs go
    through the rows of the banded table at once; a cell is one number: score, then edits, then characters.
    """
    count, width = len(a), 2 * band + 1
    rows = max(map(len, a), default=0)
    A = np.full((count, rows), 0xFFFFFFFF, np.uint32)
    B = np.full((count, rows + width), 0xFFFFFFFE, np.uint32)  # around a text nothing matches
    for k in range(count):
        A[k, : len(a[k])] = a[k]
        begin = band - (before[k] if before else 0)
        cut = max(0, min(len(b[k]), rows + width - begin))
        B[k, begin : begin + cut] = b[k][:cut]
    A, B = np.ascontiguousarray(A.T), np.ascontiguousarray(B.T)
    # row j + 1 is diagonal j - band, with an empty one at each end; the cell of an empty alignment is _NONE
    cells = np.full((width + 2, count), _NONE, np.int64)
    best = np.full(count, _NONE, np.int64)
    match, swap, gap = _ONE + 1, -EDIT_COST * _ONE - _EDIT + 1, -EDIT_COST * _ONE - _EDIT
    for i in range(rows):
        same = A[i] == B[i : i + width]
        value = cells[1:-1] + np.where(same, match, swap)
        np.maximum(value, cells[2:] + swap, out=value)
        for j in range(width):  # along a row each cell depends on the one before
            if j:
                np.maximum(value[j], value[j - 1] + gap, out=value[j])
            value[j][value[j] < _ONE] = _NONE
        cells[1:-1] = value
        np.maximum(best, value.max(axis=0), out=best)
    return (best >> 42).astype(np.int64), (1 << 20) - ((best >> 21) & (_EDIT - 1)), best & (_EDIT - 1)


def _cut_out(index: Index, codes: np.ndarray, bounds: np.ndarray, found: np.ndarray, q: int, edits: int) -> Iterator[tuple]:
    """(document, item, its characters, the item's, how many of those come before the start) of each region, widened at both ends by what edits can hide."""
    margin, band = (q + 1) * edits, 2 * (edits + 1) - 1
    for d, i, first, last, at in found.tolist():
        start, end = max(first - margin, int(bounds[d])), min(last + q + margin, int(bounds[d + 1]) - 1)
        own = index.codes[index.offsets[i] : index.offsets[i + 1]]
        # a very long region is aligned in parts that overlap by a passage
        overlap = min(LONGEST // 2, int(index.shortest[i]) + edits)
        for begin in range(start, max(start + 1, end - overlap), LONGEST - overlap):
            a = codes[begin : min(begin + LONGEST, end)]
            place = at - first + begin  # in the item, on the region's first diagonal; before the item if negative
            low = max(0, place - band)
            yield d, i, a, own[low : max(0, place + len(a) + band + 1)], place - low


def search(index: Index, docs: list[list[str]], q: int = Q, edits: int = EDITS, min_words: int = MIN_WORDS) -> list[tuple]:
    """(document number, item_id, exact, edits, chars, share) of verified regions of documents given as words.

    `exact`: the region holds `min_words` words of the item in a row. `edits` and `chars`: of the best local
    alignment, which must score as a passage with `edits` edits would. `share`: of the item's characters.
    """
    return list(verified(index, list(candidates(index, docs, q, edits)), edits, min_words))


def candidates(index: Index, docs: list[list[str]], q: int = Q, edits: int = EDITS) -> Iterator[tuple]:
    """(document number, item number, the document's words around the region, arrays to align) of each region."""
    texts = [" ".join(w) for w in docs]
    codes = _codes("\n".join(texts) + "\n")
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    found = regions(index, codes, bounds, q, edits)
    codes = codes.astype(np.uint32)
    for row in found:
        d, _, first, last, _ = row.tolist()
        start, end = first - int(bounds[d]), last - int(bounds[d]) + q
        text = texts[d]
        start = text.rfind(" ", 0, start + 1) + 1  # whole words at both ends
        end = text.find(" ", max(end - 1, 0))
        words = text[start : end if end >= 0 else len(text)]
        for _, i, a, b, before in _cut_out(index, codes, bounds, row[None], q, edits):
            yield d, i, words, a.copy(), b, before


def verified(index: Index, held: list[tuple], edits: int = EDITS, min_words: int = MIN_WORDS) -> Iterator[tuple]:
    """The rows of search() of candidates, aligned in groups of like length and bounded cells."""
    band = 2 * (edits + 1) - 1  # the region's grams lie in a band of so many diagonals, and one, to either side
    held = sorted(held, key=lambda c: len(c[3]))
    start = 0
    while start < len(held):
        end = start + 1
        while end < len(held) and (end + 1 - start) * len(held[end][3]) <= MOST_CELLS:
            end += 1
        part = held[start:end]
        start = end
        score, wrong, size = banded_alignment([c[3] for c in part], [c[4] for c in part], band, [c[5] for c in part])
        for (d, i, words, *_), points, x, n in zip(part, score.tolist(), wrong.tolist(), size.tolist()):
            if points < index.shortest[i] - edits * (EDIT_COST + 1):
                continue
            w, known = words.split(" "), index.passages(i, min_words)
            exact = any(" ".join(w[k : k + min_words]) in known for k in range(len(w) - min_words + 1))
            yield d, int(index.ids[i]), exact, x, n, min(1.0, n / len(index.texts[i]))


_FOUND = "doc_id bigint, item_id bigint, exact boolean, edits int, chars int, share double"


def _scan(index: Index, q: int, edits: int, min_words: int):
    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[list[str]]]]:
        for batch in batches:
            ids, words, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc_id)
                words.append(words_of(text))
                size += len(text)
                if size >= SLICE_CHARS:
                    yield ids, words
                    ids, words, size = [], [], 0
            if ids:
                yield ids, words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*verified(index, held, edits, min_words))) or [[]] * 6
            types = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "item_id", "exact", "edits", "chars", "share"])

        if not len(index.ids):
            return
        for ids, words in slices(batches):
            for d, *rest in candidates(index, words, q, edits):
                held.append((ids[d], *rest))
                size += len(rest[2]) + len(rest[1])
                if size > MOST_HELD:
                    yield flush()
                    held, size = [], 0
        yield flush()

    return run


def minimizers(codes: np.ndarray, window: int, q: int = Q) -> np.ndarray:
    """Distinct least gram hashes of all windows of so many successive q-grams.

    Two texts that share window + q - 1 successive characters share one. A text too short for a window has none.
    """
    least = gram_hashes(codes, q)
    if len(least) < window:
        return np.zeros(0, np.uint64)
    width = 1
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = window - width
    return np.unique(np.minimum(least[: len(least) - rest], least[rest:]) if rest else least)


def _minimizer_rows(window: int, q: int, min_words: int):
    """(id, key) of each text with at least min_words words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                if len(words) >= min_words:
                    keys = minimizers(_codes(" ".join(words)), window, q).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), row_id), pa.int64()), pa.array(keys, pa.int64())], names=["id", "key"])

    return run


def _shortest_rows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_shortest(w, min_words) for w in words if len(w) >= min_words], pa.int64())], names=["n"])

    return run


def _by_block(docs: DataFrame, items: DataFrame, block, min_words: int, edits: int, q: int) -> DataFrame:
    """(doc_id, text, blocks): the documents that share a minimizer with an item, and which blocks' items.

    A passage with k edits has an unedited run of at least (L - k) / (k + 1) characters, so a window that such a
    run fills is shared. The corpus is read here once for its keys and once for the texts that matter.
    """
    least = items.mapInArrow(_shortest_rows(min_words), "n bigint").agg(F.min("n").alias("n")).first()["n"] or 0
    window = max(1, -(-(least - edits) // (edits + 1)) - q + 1)
    keys = items.mapInArrow(_minimizer_rows(window, q, min_words), "id bigint, key bigint").select(block(F.col("id")).alias("block"), "key").distinct()
    own = docs.mapInArrow(_minimizer_rows(window, q, min_words), "doc_id bigint, key bigint")
    shared = own.join(keys, "key").groupBy("doc_id").agg(F.collect_set("block").alias("blocks"))  # at most one per block
    return durable(docs.join(shared, "doc_id"))


def leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, edits: int = EDITS, q: int = Q, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, exact, edits, chars, share) of each document and item with a leaked passage.

    A passage is a region that aligns with the item as well as its shortest `min_words` words with `edits` edits do
    (at best it has them exactly); of several, exact ones come first, then the longest. Documents and items
    without text or id, and items shorter than a passage, have none; repeated rows count once; other columns are
    ignored. `block_chars` bounds the text of the items that go to the workers at once.
    """
    usable = items.where("item_id IS NOT NULL AND item_text IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), "item_text").dropDuplicates(["item_id"])
    chars = usable.agg(F.coalesce(F.sum(F.length("item_text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-chars // block_chars))
    block_of = lambda item: F.pmod(F.xxhash64(item), F.lit(blocks))
    docs = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if blocks > 1:
        usable = durable(usable)
        docs = _by_block(docs, usable, block_of, min_words, edits, q)
    found = None
    for block in range(blocks):
        rows = usable.where(block_of(F.col("item_id")) == block).collect()  # about block_chars of text
        index = build_index(sorted((r.item_id, r.item_text) for r in rows), min_words, q)
        own = docs.where(F.array_contains("blocks", F.lit(block).cast("bigint"))).select("doc_id", "text") if blocks > 1 else docs
        part = own.mapInArrow(_scan(index, q, edits, min_words), _FOUND)
        found = part if found is None else found.unionByName(part)
    best = F.max_by(F.struct("exact", "edits", "chars", "share"), F.struct(F.col("exact"), F.col("chars"), -F.col("edits")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("r")).select("doc_id", "item_id", "r.exact", "r.edits", "r.chars", "r.share")


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """p7: (doc_id, item_id) of the documents that hold at least 12 consecutive words of an item.

    Such a passage has no edits, so the filter runs with an edit budget of 0.
    """
    return leaks(documents, items, edits=0).where("exact").select("doc_id", "item_id")

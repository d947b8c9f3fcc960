"""Languages of documents and of their segments, with a confidence, by hyperdimensional profiles.

Method: every letter has a fixed random vector of +1 and -1. The vector of an n-gram binds (multiplies) the
letters' vectors, each permuted (rotated) by its place; the n-grams of a language's words are bundled (added)
into the language's prototype, a word weighing the power POWER of its count, so that stock phrases don't rule it.
A segment is bundled likewise and compared with the prototypes by cosine; as bundles add up, its dot product with
a prototype is the sum of those of its n-grams, which are computed once per word and remembered. Prototypes are centred on their mean, so what all languages share doesn't count.

A document is cut into segments at sentence ends, line ends and, in long sentences, every WINDOW words. A
best path over the segments picks their languages, a change of language costing the evidence of SWITCH typical
words, so a name or a number doesn't make a segment of its own. A language of the document is one that has at
least `share` of its words.

POWER was chosen by three-fold cross-validation over the labelled documents of the sf0.1 tables (fitted on two
folds, agreement with the third's labels): 0 gives 0.937, all of 0.25, 0.5, 0.65, 0.8 and 1 give 0.941 (the labels
themselves are wrong on some per cent), so any of those does. TASKS is small since every task makes the vectors
of the n-grams that it meets.

Prototypes are fitted here: on at most `sample_per_language` labelled documents of each language, chosen by a
hash of their ids over all rows; after each round only segments that agree with their label are bundled again,
for labels may be wrong and texts mixed. Every n-gram's vector is made once a round, for all languages together.
Prototypes can be stored and loaded (`to_table`, `from_table`), so a run needn't fit. Classifying is one Arrow
pass over all documents without a shuffle; the texts of a batch are worked on together, in parts of PART_CHARS.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from darb.session import durable

DIMENSIONS, GRAM, WINDOW, SWITCH, SHARE = 4096, 3, 12, 3.0, 0.15
SAMPLE_PER_LANGUAGE, ROUNDS, TASKS, POWER, PART_CHARS = 2000, 3, 4, 0.8, 2_000_000

#: Codes (ISO 639-1, 639-2/T, 639-2/B) and English names of the languages.
LANGUAGES = {
    "en": ("en", "eng", "english"),
    "ar": ("ar", "ara", "arabic"),
    "fr": ("fr", "fra", "fre", "french"),
    "es": ("es", "spa", "spanish", "castilian"),
    "de": ("de", "deu", "ger", "german"),
    "pt": ("pt", "por", "portuguese"),
}
CODES = tuple(LANGUAGES)


def label_code(label: Column) -> Column:
    """The two-letter code that a label names, with or without region and in any case, or null."""
    base = F.regexp_extract(F.lower(F.trim(F.regexp_replace(label, r"\s+", " "))), r"^([a-z]+)(?:[-_ .,(/].*)?$", 1)
    out = F.lit(None).cast("string")
    for code, names in LANGUAGES.items():
        out = F.when(base.isin(*names), F.lit(code)).otherwise(out)
    return out


@lru_cache(maxsize=1)
def _patterns():
    """(segment ends, format characters, words, tokens of an ASCII text): a word is a run of letters and marks, with no digit or _ next to it."""
    import re

    import regex

    return regex.compile(r"[.!?؟;:|…]+(?=\s|$)|[\n\r]+"), regex.compile(r"\p{Cf}+"), regex.compile(r"\b[\p{L}\p{M}]++(?![\p{N}_])"), re.compile(r"\w+")


def segments_of(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of the segments of a text; words are its runs of letters, normalised, none with digits in it."""
    ends, formats, words_in, tokens = _patterns()
    out = []
    start, ascii_only = 0, text.isascii()
    plain = ascii_only or unicodedata.is_normalized("NFKC", text) and not formats.search(text)
    low = text.lower() if plain else ""
    whole = plain and len(low) == len(text)  # places in the lower-case text are those in the text
    for end in [*(m.end() for m in ends.finditer(text)), len(text)]:
        if whole:
            words = [w for w in tokens.findall(low, start, end) if w.isalpha()] if ascii_only else words_in.findall(low, start, end)
        else:
            words = words_in.findall(unicodedata.normalize("NFKC", formats.sub("", text[start:end])).lower())
        for k in range(0, len(words), WINDOW):
            out.append((start, end, words[k : k + WINDOW]))
        start = end
    return out


def letter_vector(letter: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The fixed random vector of a letter, from a hash of the letter alone."""
    bits = blake2b(letter.encode("utf-8", "replace"), digest_size=16).digest()
    return (np.random.default_rng(int.from_bytes(bits, "little")).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1).astype(np.int8)


class Grams:
    """n-gram vectors, with the letters' rotated vectors kept."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self._rotated: dict[tuple[str, int], np.ndarray] = {}

    def _letter(self, letter: str, turn: int) -> np.ndarray:
        if (v := self._rotated.get((letter, turn))) is None:
            v = self._rotated[letter, turn] = np.roll(letter_vector(letter, self.dimensions), turn)
        return v

    def vectors(self, grams: list[str]) -> np.ndarray:
        out = np.empty((len(grams), self.dimensions), np.int8)
        for k, gram in enumerate(grams):
            v = self._letter(gram[0], len(gram) - 1)
            for i in range(1, len(gram)):
                v = v * self._letter(gram[i], len(gram) - 1 - i)
            out[k] = v
        return out


def grams_of(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + GRAM] for i in range(max(1, len(padded) - GRAM + 1))]


@dataclass
class Prototypes:
    """Centred unit prototypes (languages x dimensions) and the typical evidence of a word."""

    matrix: np.ndarray
    scale: float = 1.0
    _grams: Grams = field(default_factory=Grams, repr=False)
    _gram_scores: dict = field(default_factory=dict, repr=False)
    _words: dict = field(default_factory=dict, repr=False)
    _table: np.ndarray = field(default_factory=lambda: np.zeros((4096, len(CODES)), np.float32), repr=False)

    def __getstate__(self):
        return {"matrix": self.matrix, "scale": self.scale}

    def __setstate__(self, state):
        self.__init__(**state)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Evidence (dot products over the vectors' length) of each word for each language."""
        if len(self._words) > 300_000:
            self._words.clear()
            self._gram_scores.clear()
        known = self._words
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            missing = list(dict.fromkeys(g for w in new for g in grams_of(w) if g not in self._gram_scores))
            for k in range(0, len(missing), 1024):
                part = missing[k : k + 1024]
                scores = self._grams.vectors(part).astype(np.float32) @ self.matrix.T.astype(np.float32) / np.sqrt(self._grams.dimensions)
                self._gram_scores.update(zip(part, scores))
            while len(known) + len(new) > len(self._table):
                self._table = np.concatenate([self._table, np.zeros_like(self._table)])
            for w in new:
                self._table[len(known)] = sum(self._gram_scores[g] for g in grams_of(w))
                known[w] = len(known)
        return self._table[[known[w] for w in words]]

    def segment_scores(self, segments: list[list[str]]) -> np.ndarray:
        """Evidence of each segment, given as its words."""
        starts = np.cumsum([0, *map(len, segments)])[:-1]
        return np.add.reduceat(self.word_scores([w for words in segments for w in words]), starts, axis=0)

    def paths(self, scores: np.ndarray, begins: np.ndarray, switch: float = SWITCH) -> np.ndarray:
        """Languages (as numbers) of the successive segments of texts, which begin at `begins`: for each text the best sum of evidence less the cost of changes."""
        cost, n = switch * self.scale, scores.shape[1]
        chosen = scores.argmax(1)
        sizes = np.diff(np.append(begins, len(scores)))
        same = np.maximum.reduceat(chosen, begins) == np.minimum.reduceat(chosen, begins)
        # texts whose segments agree are done; the others go on together, the longest first
        mixed = np.flatnonzero(~same)
        mixed = mixed[np.argsort(-sizes[mixed], kind="stable")]
        at, length = begins[mixed], sizes[mixed]
        best, back = scores[at].copy(), []
        live = lambda s: int(np.searchsorted(-length, -s, side="left"))  # noqa: E731  texts with more than s segments
        for s in range(1, int(length[0]) if len(length) else 0):
            k = live(s)
            now = best[:k]
            top = now.max(1, keepdims=True)
            stay = now >= top - cost
            back.append(np.where(stay, np.arange(n), now.argmax(1)[:, None]).astype(np.int8))
            best[:k] = np.where(stay, now, top - cost) + scores[at[:k] + s]
        language = best.argmax(1) if len(best) else np.zeros(0, np.int64)
        for s in range(len(back), -1, -1):
            k = live(s)
            chosen[at[:k] + s] = language[:k]
            if s:
                language[:k] = back[s - 1][np.arange(k), language[:k]]
        return chosen

    def confidence(self, scores: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """From 0 to 1: the logistic of the evidence for the chosen language over the next one, in typical words."""
        rows = np.arange(len(scores))
        rest = scores.copy()
        rest[rows, chosen] = -np.inf
        return 1.0 / (1.0 + np.exp(-np.clip((scores[rows, chosen] - rest.max(1)) / self.scale, -30, 30)))


def _segmented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, words): the segments of labelled texts, one a line, their words with a space between them."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(["\n".join(" ".join(w) for _, _, w in segments_of(t)) for t in batch.column(1).to_pylist()], pa.string())], names=["code", "words"])


def _word_counts(prototypes: Prototypes | None):
    """Counts of the words of a task's segments that agree with their label, with the segments' margins and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        margin, seen = 0.0, 0
        for batch in batches:
            codes, texts = [], []
            for code, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if words:
                    codes.append(code)
                    texts.append([line.split(" ") for line in words.split("\n")])
            if not texts:
                continue
            segments = [s for text in texts for s in text]
            owners = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
            kept = np.ones(len(segments), bool)
            if prototypes is not None:
                scores = prototypes.segment_scores(segments)
                kept = prototypes.paths(scores, np.flatnonzero(np.diff(owners, prepend=-1))) == np.array([CODES.index(c) for c in codes])[owners]
                ordered = np.sort(scores, axis=1)
                margin += float((ordered[:, -1] - ordered[:, -2]).sum())
                seen += sum(map(len, segments))
            for k in np.flatnonzero(kept).tolist():
                code = codes[owners[k]]
                counts.update((code, w) for w in segments[k])
        rows = [(code, w, n, 0.0, 0) for (code, w), n in counts.items()] + [(None, None, 0, margin, seen)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int64()))], names=["code", "word", "n", "margin", "words"])

    return run


def _gram_weights(power: float):
    """A task's weights of n-grams for each language: the sums of the powers of their words' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights: Counter = Counter()
        for batch in batches:
            for code, word, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for g in grams_of(word):
                    weights[g, code] += float(n) ** power
        yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in weights], pa.string()), pa.array([c for _, c in weights], pa.string()), pa.array(list(weights.values()), pa.float64())], names=["gram", "code", "weight"])

    return run


def _bundle(dimensions: int):
    """Partial bundles: per language the weighted sum of the vectors of a task's n-grams, of which it has all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, grams = np.zeros((len(CODES), dimensions)), Grams(dimensions)
        weights: dict[str, np.ndarray] = {}
        for batch in batches:
            for gram, code, weight in zip(*(batch.column(i).to_pylist() for i in range(3))):
                weights.setdefault(gram, np.zeros(len(CODES)))[CODES.index(code)] += weight
        names = list(weights)
        for k in range(0, len(names), 1024):
            part = names[k : k + 1024]
            total += np.array([weights[g] for g in part], np.float32).T @ grams.vectors(part).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(CODES), pa.array([x.tobytes() for x in total], pa.binary())], names=["code", "bundle"])

    return run


_COUNTS = "code string, word string, n bigint, margin double, words bigint"


def fit(documents: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, power: float = POWER) -> Prototypes:
    """Prototypes of the languages, from documents (doc_id, text, lang) whose label names one.

    A language without labelled documents gets an empty prototype, to which nothing is similar. At most about
    `sample_per_language` documents of a language are looked at, so everything behind the sample is bounded.
    """
    labelled = documents.select("doc_id", F.col("text").cast("string").alias("text"), label_code(F.col("lang")).alias("code")).where("text IS NOT NULL AND code IS NOT NULL")
    found = {r["code"]: r["n"] for r in labelled.groupBy("code").agg(F.count("*").alias("n")).collect()}  # six rows
    rate = F.lit(0.0)
    for code, n in found.items():
        rate = F.when(F.col("code") == code, F.lit(min(1.0, sample_per_language / n))).otherwise(rate)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = durable(labelled.where(draw < rate).select("code", "text").repartition(TASKS).mapInArrow(_segmented, "code string, words string"))
    prototypes = None
    for _ in range(rounds):
        counts = sample.mapInArrow(_word_counts(prototypes), _COUNTS).where("code IS NOT NULL").groupBy("code", "word").agg(F.sum("n").alias("n"))
        weights = counts.mapInArrow(_gram_weights(power), "gram string, code string, weight double").repartition(TASKS, "gram")
        rows = weights.mapInArrow(_bundle(dimensions), "code string, bundle binary").collect()  # tasks x languages
        total = np.zeros((len(CODES), dimensions))
        for r in rows:
            total[CODES.index(r["code"])] += np.frombuffer(r["bundle"])
        length = np.linalg.norm(total, axis=1, keepdims=True)
        unit = np.divide(total, length, out=np.zeros_like(total), where=length > 0)
        present = length[:, 0] > 0
        centred = unit - unit[present].mean(0) if present.any() else unit
        centred[~present] = 0
        size = np.linalg.norm(centred, axis=1, keepdims=True)
        prototypes = Prototypes(np.divide(centred, size, out=np.zeros_like(centred), where=size > 0).astype(np.float32))
    seen = sample.mapInArrow(_word_counts(prototypes), _COUNTS).where("code IS NULL").agg(F.sum("margin").alias("m"), F.sum("words").alias("w")).first()
    return Prototypes(prototypes.matrix, scale=(seen["m"] / seen["w"]) if seen["w"] and seen["m"] else 1.0)


def to_table(spark: SparkSession, prototypes: Prototypes) -> DataFrame:
    """(code, scale, prototype): fitted prototypes as a table of six rows, to be written anywhere."""
    rows = [(c, float(prototypes.scale), list(map(float, v))) for c, v in zip(CODES, prototypes.matrix)]
    return spark.createDataFrame(rows, "code string, scale double, prototype array<float>")


def from_table(stored: DataFrame) -> Prototypes:
    """The prototypes that to_table() gave."""
    rows = {r["code"]: r for r in stored.collect()}  # six rows
    return Prototypes(np.array([rows[c]["prototype"] for c in CODES], np.float32), scale=rows[CODES[0]]["scale"])


def _classified(prototypes: Prototypes, share: float, segments_out: bool):
    def rows_of(ids: list, texts: list[list[tuple[int, int, list[str]]]]) -> list:
        """Columns of the result for documents given as their segments."""
        segments = [s for text in texts for s in text]
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        if not segments:
            return [[]] * (7 if segments_out else 4)
        scores = prototypes.segment_scores([words for _, _, words in segments])
        known = np.zeros(len(texts), bool)
        np.logical_or.at(known, owner, scores.any(1))  # without any evidence a document has no language
        kept = known[owner]
        if not kept.all():
            segments, scores, owner = [s for s, k in zip(segments, kept) if k], scores[kept], owner[kept]
        if not segments:
            return [[]] * (7 if segments_out else 4)
        begins = np.flatnonzero(np.diff(owner, prepend=-1))
        chosen = prototypes.paths(scores, begins)
        sizes = np.array([len(words) for _, _, words in segments])
        codes = np.array(CODES, object)
        if segments_out:
            new = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])])
            runs = np.flatnonzero(new)
            last = np.append(runs[1:], len(segments)) - 1
            sure = prototypes.confidence(np.add.reduceat(scores, runs, axis=0), chosen[runs])
            number = np.arange(len(runs)) - np.searchsorted(runs, begins)[np.searchsorted(begins, runs, side="right") - 1]
            return [[ids[k] for k in owner[runs]], number, [segments[k][0] for k in runs], [segments[k][1] for k in last], codes[chosen[runs]], np.add.reduceat(sizes, runs), sure]
        n = len(CODES)
        key = owner * n + chosen
        total = np.stack([np.bincount(key, weights=scores[:, c], minlength=len(texts) * n) for c in range(n)], axis=1)
        words = np.bincount(key, weights=sizes, minlength=len(texts) * n)
        part = words / np.maximum(np.repeat(np.bincount(owner, weights=sizes, minlength=len(texts)), n), 1)
        found = np.flatnonzero((words > 0) & (part >= share))
        return [[ids[k] for k in found // n], codes[found % n], part[found], prototypes.confidence(total[found], found % n)]

    names = ["doc_id", "segment", "start", "end", "lang_code", "words", "confidence"] if segments_out else ["doc_id", "lang_code", "share", "confidence"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.float64()] if segments_out else [pa.int64(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for n, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), 1):
                ids.append(doc_id)
                texts.append(segments_of(text))
                size += len(text)
                if size > PART_CHARS or n == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows_of(ids, texts), types)], names=names)
                    ids, texts, size = [], [], 0

    return run


def _texts(documents: DataFrame) -> DataFrame:
    return documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def document_languages(documents: DataFrame, prototypes: Prototypes, share: float = SHARE) -> DataFrame:
    """(doc_id, lang_code, share, confidence): each language that has at least `share` of a document's words.

    Documents without id, text or words give no row; repeated rows give theirs again; other columns are ignored.
    """
    return _texts(documents).mapInArrow(_classified(prototypes, share, False), "doc_id bigint, lang_code string, share double, confidence double")


def document_segments(documents: DataFrame, prototypes: Prototypes) -> DataFrame:
    """(doc_id, segment, start, end, lang_code, words, confidence): the stretches of one language, in order.

    `start` and `end` are character positions in the text; stretches cut within one sentence share its bounds.
    """
    return _texts(documents).mapInArrow(_classified(prototypes, 0.0, True), "doc_id bigint, segment int, start int, end int, lang_code string, words int, confidence double")


def label_cases(documents: DataFrame, prototypes: Prototypes) -> DataFrame:
    """(doc_id, lang_code, share, confidence, label), one row per language, of documents whose label isn't their only language.

    That is: the label is missing, names no language or another one (`label` is the code that it names or null), or the
    text has several languages. Repeated rows of a document count once; of unequal labels the last in order counts.
    """
    found = document_languages(documents, prototypes).groupBy("doc_id", "lang_code").agg(F.max("share").alias("share"), F.max("confidence").alias("confidence"))
    labels = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), label_code(F.col("lang")).alias("label")).groupBy("doc_id").agg(F.max("label").alias("label"))
    each = found.groupBy("doc_id").agg(F.collect_list(F.struct("lang_code", "share", "confidence")).alias("found"))  # six at most
    cases = each.join(labels, "doc_id").where((F.size("found") > 1) | F.col("label").isNull() | (F.col("found")[0]["lang_code"] != F.col("label")))
    return cases.select("doc_id", F.explode("found").alias("f"), "label").select("doc_id", "f.lang_code", "f.share", "f.confidence", "label")


def wrong_labels(documents: DataFrame) -> DataFrame:
    """p8: (doc_id, lang_code) of label_cases, with prototypes fitted on the documents' own labels."""
    return label_cases(documents, fit(documents)).select("doc_id", "lang_code")

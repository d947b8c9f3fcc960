import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from darb.llm import languages as lg

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def prototypes(documents):
    return lg.fit(documents)


#: Sentences that the corpus doesn't have.
HELD_OUT = {
    "en": "We were told that the children should wait inside until their teacher comes back with the keys.",
    "ar": "قال المعلم إن الأطفال سوف ينتظرون داخل المبنى حتى يعود المدير من المدينة.",
    "fr": "Nous avons appris que les enfants devaient attendre dans la salle jusqu'au retour du directeur.",
    "es": "Nos dijeron que los niños tenían que esperar dentro hasta que volviera el director con las llaves.",
    "de": "Man hat uns gesagt, dass die Kinder drinnen warten sollen, bis der Lehrer mit den Schlüsseln kommt.",
    "pt": "Disseram que as crianças deviam esperar lá dentro até que o diretor voltasse com as chaves.",
}


def test_labels(spark):
    rows = ["en", " EN ", "en_US", "en-GB", "eng", "English", "fre", "German", "pt-BR", "spanish (Mexico)", "", None, "und", "nl", "mul", "english teacher2", "enx", "Portuguese"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "l string").select(lg.label_code(F.col("l"))).collect()]
    assert got == ["en"] * 6 + ["fr", "de", "pt", "es", None, None, None, None, None, "en", None, "pt"]


def found(spark, prototypes, rows, **options):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, lang_code string, segment int")
    return {(r.doc_id, r.lang_code): r for r in lg.document_languages(df, prototypes, **options).collect()}


def test_held_out_sentences(spark, prototypes):
    got = found(spark, prototypes, list(enumerate(HELD_OUT.values())))
    assert set(got) == set(enumerate(HELD_OUT)) and all(r.confidence > 0.9 for r in got.values())


def test_mixed_documents_and_their_segments(spark, prototypes):
    text = " ".join([HELD_OUT["es"]] * 3 + [HELD_OUT["de"]] * 3)
    got = found(spark, prototypes, [(1, text)])
    assert set(got) == {(1, "es"), (1, "de")} and abs(got[1, "es"].share - 0.5) < 0.1
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    parts = sorted((r.segment, r.lang_code, text[r.start : r.end].strip()[:12]) for r in lg.document_segments(df, prototypes).collect())
    assert [p[:2] for p in parts] == [(0, "es"), (1, "de")] and parts[1][2].startswith("Man hat uns")


def test_a_small_part_is_no_language_of_the_document(spark, prototypes):
    text = " ".join([HELD_OUT["en"]] * 9 + [HELD_OUT["fr"]])
    assert set(found(spark, prototypes, [(1, text)])) == {(1, "en")}


def test_texts_without_words(spark, prototypes):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "12 34; 56.7 | → ±4 %"), (5, "​‍"), (None, HELD_OUT["en"]), (6, "x1 BUS_31 0x12ab"), (7, HELD_OUT["en"] * 3000)]
    assert set(found(spark, prototypes, rows)) == {(7, "en")}
    assert found(spark, prototypes, []) == {}


@pytest.fixture(scope="module")
def folds(documents):
    """Two thirds of the labelled documents to fit on, and the others, which the fit doesn't see (equal texts are on one side)."""
    known = documents.where("text IS NOT NULL").withColumn("code", lg.label_code(F.col("lang"))).where("code IS NOT NULL").select("doc_id", "text", "lang", "code")
    fold = F.pmod(F.xxhash64("text"), F.lit(3))
    return lg.fit(known.where(fold > 0)), known.where(fold == 0)


def test_agreement_with_labels_of_documents_held_out(folds):
    """Labels are wrong on about six per cent of rows; elsewhere the only language found must be the label's."""
    fitted, held = folds
    one = lg.document_languages(held, fitted).withColumn("n", F.count("*").over(Window.partitionBy("doc_id"))).where("n = 1")
    row = one.join(held.select("doc_id", "code"), "doc_id").agg(F.avg((F.col("code") == F.col("lang_code")).cast("double")).alias("a"), F.count("*").alias("n")).first()
    assert row["n"] > 200 and row["a"] > 0.92


def test_mixed_texts_of_held_out_documents(spark, folds):
    """Two or three held-out texts of different languages on end: which languages, and how many words get theirs."""
    fitted, held = folds
    sure = lg.document_languages(held, fitted, share=0.0).groupBy("doc_id").agg(F.max_by("lang_code", "share").alias("found"), F.count("*").alias("n")).where("n = 1")
    pool: dict = {}
    for r in held.join(sure, "doc_id").where("found = code").select("code", "text").distinct().orderBy("code", "text").collect():
        words = " ".join(w for _, _, ws in lg.segments_of(r.text) for w in ws).split()
        if len(words) >= 12:
            pool.setdefault(r.code, []).append(" ".join(words[:40]) + ".")
    rng, rows, truth = random.Random(7), [], {}
    for k in range(300):
        codes = rng.sample(sorted(pool), rng.choice([2, 2, 3]))
        parts = [rng.choice(pool[c]) for c in codes]
        sizes = [len(p.split()) for p in parts]
        if min(sizes) < 0.2 * sum(sizes):
            continue
        truth[k] = (codes, parts)
        rows.append((k, "\n".join(parts)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets: dict = {}
    for r in lg.document_languages(df, fitted).collect():
        sets.setdefault(r.doc_id, set()).add(r.lang_code)
    both = sum(len(sets[k] & set(codes)) for k, (codes, _) in truth.items())
    precision, recall = both / sum(map(len, sets.values())), both / sum(len(c) for c, _ in truth.values())
    right = words = 0
    for r in lg.document_segments(df, fitted).collect():
        codes, parts = truth[r.doc_id]
        at = 0
        for code, part in zip(codes, parts):
            inside = part[max(0, r.start - at) : max(0, r.end - at)]
            right += len(inside.split()) * (code == r.lang_code)
            words += len(inside.split())
            at += len(part) + 1
    print(f"documents {len(rows)}: precision {precision:.4f}, recall {recall:.4f}; words in the right segment {right / words:.4f}")
    assert len(rows) > 200 and precision > 0.99 and recall > 0.98 and right / words > 0.98


def test_prototypes_are_stored(spark, prototypes, tmp_path):
    lg.to_table(spark, prototypes).write.parquet(str(tmp_path / "p"))
    back = lg.from_table(spark.read.parquet(str(tmp_path / "p")))
    assert (back.matrix == prototypes.matrix).all() and back.scale == prototypes.scale


def test_paths_are_the_best(prototypes):
    """Against all sequences of languages of short texts."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    sizes = [1, 4, 2, 5, 1, 3]
    scores = rng.normal(size=(sum(sizes), 6)).astype(np.float32) * prototypes.scale * 3
    begins = np.cumsum([0, *sizes])[:-1]
    got = prototypes.paths(scores, begins)
    cost = lg.SWITCH * prototypes.scale
    for b, n in zip(begins, sizes):
        value = lambda p: sum(scores[b + i, c] for i, c in enumerate(p)) - cost * sum(x != y for x, y in zip(p, p[1:]))  # noqa: B023, E731
        assert value(got[b : b + n].tolist()) == pytest.approx(max(map(value, itertools.product(range(6), repeat=n))), rel=1e-5)


def test_wrong_labels_rules(spark, documents, prototypes, monkeypatch):
    monkeypatch.setattr(lg, "fit", lambda d: prototypes)
    mixed = " ".join([HELD_OUT["es"]] * 3 + [HELD_OUT["de"]] * 3)
    rows = [(1, HELD_OUT["en"], "en"), (2, HELD_OUT["en"], "English"), (3, HELD_OUT["en"], "fr"), (4, HELD_OUT["en"], None), (5, HELD_OUT["en"], "und"), (6, mixed, "es"), (6, mixed, "es"), (7, mixed, "mul"), (8, "123", "xx"), (9, None, None), (10, HELD_OUT["pt"], "pt-BR")]
    got = sorted(tuple(r) for r in lg.wrong_labels(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect())
    assert got == [(3, "en"), (4, "en"), (5, "en"), (6, "de"), (6, "es"), (7, "de"), (7, "es")]
    cases = lg.label_cases(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), prototypes).collect()
    assert len(cases) == 7 and all(0.5 < r.confidence <= 1 and 0.15 <= r.share <= 1 for r in cases) and {r.doc_id: r.label for r in cases}[3] == "fr"


def test_a_corpus_without_labels(spark):
    df = spark.createDataFrame([(1, HELD_OUT["en"], None)], "doc_id bigint, text string, lang string")
    assert lg.wrong_labels(df).count() == 0 and lg.wrong_labels(df.limit(0)).count() == 0

import random

import numpy as np
import pytest

from darb.llm import leakage as lk

DOCS, ITEMS = "doc_id bigint, text string, exact string, item_id int", "item_id bigint, item_text string, doc_id int"


def vocabulary(rng, n=300):
    return ["".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randint(1, 9))) for _ in range(n)]


def brute(docs, items, n=12):
    out = set()
    for d, text in docs:
        w = lk.words_of(text)
        have = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for i, x in items:
            v = lk.words_of(x)
            if any(tuple(v[k : k + n]) in have for k in range(len(v) - n + 1)):
                out.add((d, i))
    return out


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    return lk.leaks(d, q, **options)


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_no_passage_is_lost(spark, edits):
    rng = random.Random(edits)
    words = vocabulary(rng)
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(8, 60)))) for i in range(40)]
    docs = []
    for d in range(120):
        text = [rng.choice(words) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            v = items[rng.randrange(40)][1].split()
            n = rng.choice([11, 12, 13, 30])
            k = rng.randrange(max(1, len(v) - n))
            text[len(text) // 2 : len(text) // 2] = v[k : k + n]
        docs.append((d, " ".join(text)))
    got = {(r.doc_id, r.item_id) for r in run(spark, docs, items, edits=edits).where("exact").collect()}
    assert got == brute(docs, items)


def test_blocks_of_items_give_the_same(spark):
    rng = random.Random(9)
    words = vocabulary(rng)
    items = [(i, " ".join(rng.choice(words) for _ in range(30))) for i in range(20)]
    docs = [(d, "pre " + items[d % 20][1] + " post") for d in range(40)]
    one = sorted(map(tuple, run(spark, docs, items).collect()))
    assert one == sorted(map(tuple, run(spark, docs, items, block_chars=1000).collect())) and {(r[0], r[1]) for r in one} >= brute(docs, items)


def test_normalisation(spark):
    item = "Ünïcode wörter ＦＵＬＬ width １２ and soft­hyphen zero​width one two three four five"
    doc = "x UNÏCODE" .replace("UNÏCODE", "ÜNÏCODE") + " wörter... full WIDTH, 12; and softhyphen zerowidth (one) two-three four five y"
    assert brute([(1, doc)], [(1, item)]) == {(1, 1)}
    assert {(r.doc_id, r.item_id) for r in run(spark, [(1, doc)], [(1, item)]).where("exact").collect()} == {(1, 1)}


def test_near_passages_and_their_edits(spark):
    item = "every bus that leaves the northern depot before seven must carry a second attendant on board today"
    changed = item.replace("northern", "northarn")
    got = run(spark, [(1, f"so {changed} end"), (2, f"so {item} end"), (3, "nothing like it here at all")], [(5, item)], edits=2).collect()
    found = {r.doc_id: (r.exact, r.edits, round(r.share, 2)) for r in got}
    assert found == {1: (False, 1, 1.0), 2: (True, 0, 1.0)}


def test_nulls_repeats_empty_and_long(spark):
    item = " ".join(f"w{k} word{k}" for k in range(10))
    docs = [(1, None), (2, ""), (3, "... !!"), (None, item), (4, item), (4, item), (5, ("filler text " * 40_000) + item + (" more" * 1000))]
    items = [(1, item), (1, item), (2, None), (3, ""), (None, item), (4, "too short an item")]
    assert sorted((r.doc_id, r.item_id) for r in run(spark, docs, items).where("exact").collect()) == [(4, 1), (5, 1)]
    assert run(spark, [], items).count() == 0 and run(spark, docs, []).count() == 0


def test_repeating_grams_in_item_and_document(spark):
    item = "a a a a a a a a a a a a b " * 4
    docs = [(1, "a " * 11), (2, "a " * 12), (3, "c " + "a " * 50), (4, "a b " * 30)]
    assert {(r.doc_id, r.item_id) for r in run(spark, docs, [(1, item)], edits=0).where("exact").collect()} == brute(docs, [(1, item)]) == {(2, 1), (3, 1)}


def test_banded_alignment():
    codes = lambda s: np.frombuffer(s.encode("utf-32-le"), np.uint32)
    a = [codes("abcdefghijklmnop")] * 3 + [codes("")]
    b = [codes("abcdefghijklmnop"), codes("abcdefghXijklmnop"), codes("zzzz"), codes("abc")]
    score, edits, size = lk.banded_alignment(a, b, 2)
    assert score.tolist() == [16, 13, 0, 0] and edits.tolist()[:2] == [0, 1] and size.tolist()[:2] == [16, 16]


def distance(a, b):
    """Edits between two texts."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2])
def test_an_edit_at_any_place_loses_no_passage(edits):
    """One edit at every character of a passage (and others anywhere), in the middle and at the ends of a document."""
    rng = random.Random(edits)
    words, lost, asked = vocabulary(rng), [], 0
    for _ in range(25):
        passage = " ".join(rng.choice(words) for _ in range(12))
        before, behind = (" ".join(rng.choice(words) for _ in range(20)) for _ in range(2))
        index = lk.build_index([(1, f"{before} {passage} {behind}" if rng.random() < 0.5 else passage)])
        docs = []
        for p in range(len(passage)):
            t = list(passage)
            for x in [p, *(rng.randrange(len(passage)) for _ in range(edits - 1))]:
                t[x] = rng.choice(["q", t[x] + "q", ""])
            edited = " ".join("".join(t).split())
            if distance(edited, passage) > edits:
                continue
            docs.append(rng.choice(["{}", "so {}", "{} end", "so it was {} in the end"]).format(edited).split())
        got = {r[0] for r in lk.search(index, docs, edits=edits)}
        asked += len(docs)
        lost += [docs[k] for k in range(len(docs)) if k not in got]
    assert asked > 500 and not lost


@pytest.mark.parametrize("edits", [0, 1])
def test_hits_in_pieces_give_the_same(monkeypatch, edits):
    rng = random.Random(3)
    words = vocabulary(rng, 30)
    phrase = " ".join(rng.choice(words) for _ in range(14))
    items = [(i, phrase + " " + " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(50)] + [(99, "a b " * 300), (98, "a a a c " * 200)]
    docs = [(phrase + " a b " * 40).split(), ("a " * 500).split(), ("a b " * 20 + phrase).split(), ("a a a c " * 90).split()]
    index = lk.build_index(items)
    whole = sorted(lk.search(index, docs, edits=edits))
    pieces = []
    monkeypatch.setattr(lk, "MOST_HITS", 500)
    expanded = lk._expanded
    monkeypatch.setattr(lk, "_expanded", lambda *a: pieces.append(expanded(*a)) or pieces[-1])
    assert {r[:3] for r in lk.search(index, docs, edits=edits)} == {r[:3] for r in whole} and len(pieces) > 50
    assert {(d, i) for d, i, exact, *_ in whole if exact} == brute([(k, " ".join(d)) for k, d in enumerate(docs)], items)


def test_a_phrase_that_all_items_have_takes_bounded_memory(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(lk, "MOST_HITS", 100_000)
    phrase, peaks = "on the day of the trip all of the children wait at the gate of ", []
    for n in (200, 1600):
        index = lk.build_index([(i, f"x{i} y{i} {phrase[:52]} z{i} " * 2) for i in range(n)])
        index.passages(0, 12)
        doc = (phrase * 40).split()
        tracemalloc.start()
        lk.regions(index, lk._codes(" ".join(doc) + "\n"), np.array([0, len(" ".join(doc)) + 1]), edits=1)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 2 * peaks[0]


def test_very_long_regions_are_aligned_in_parts(monkeypatch):
    monkeypatch.setattr(lk, "LONGEST", 300)
    rng = random.Random(5)
    words = vocabulary(rng)
    item = " ".join(rng.choice(words) for _ in range(400))
    index = lk.build_index([(1, item)])
    got = lk.search(index, [item.split(), item[500:1200].split()], edits=1)
    assert {r[0] for r in got if r[2]} == {0, 1}


def test_minimizers_are_shared_by_what_shares_a_window():
    rng = random.Random(8)
    for window in (1, 2, 7, 16):
        for _ in range(50):
            shared = "".join(rng.choice("abcd ") for _ in range(window + lk.Q - 1))
            a, b = ("".join(rng.choice("abcd ") for _ in range(30)) + shared + "".join(rng.choice("abcd ") for _ in range(30)) for _ in range(2))
            keys = [set(lk.minimizers(lk._codes(x), window).tolist()) for x in (a, b)]
            assert keys[0] & keys[1]
    assert not len(lk.minimizers(lk._codes("short"), 3))


@pytest.mark.parametrize("edits", [0, 1])
def test_many_blocks_lose_nothing(spark, edits):
    """Several blocks choose their documents by minimizers; the rows are those of one block."""
    rng = random.Random(12)
    words = vocabulary(rng)
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(12, 40)))) for i in range(30)]
    docs = []
    for d in range(80):
        text = [rng.choice(words) for _ in range(30)]
        v = items[rng.randrange(30)][1].split()
        passage = list(" ".join(v[:14]))
        if d % 2:
            passage[rng.randrange(len(passage))] = "q"
        docs.append((d, " ".join(text[:15] + "".join(passage).split() + text[15:]) if d % 4 else " ".join(text)))
    one = sorted(map(tuple, run(spark, docs, items, edits=edits).collect()))
    many = sorted(map(tuple, run(spark, docs, items, edits=edits, block_chars=1500).collect()))
    assert one == many and len(one) > 20

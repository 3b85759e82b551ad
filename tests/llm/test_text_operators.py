"""Substring removal, Jaccard join, language ID and fingerprints against brute force, with corner cases."""

import hashlib
import random
import re
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridterrain.llm import jaccard, substrings
from gridterrain.llm.fingerprints import add_fingerprints, edit_likeness, fingerprint, fingerprint_text
from gridterrain.llm.jaccard import jaccard_classes, runs_for, without_near_copies
from gridterrain.llm.language import PAD, STEPS, UNITS, _new_model, fit, is_held_out, label_languages, loss_and_gradients, pooled, train
from gridterrain.llm.mixing import mix_sources
from gridterrain.llm.substrings import longest_repeats, remove_repeats
from gridterrain.llm.words import hashed_words, windows

DOCS = "doc_id long, text string, part string, copies string"


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def make_texts(seed=3, n=60):
    """Texts with exact copies, near copies, shared passages, a text of one repeated word, odd white space and empties."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(400)]
    draw = lambda k: [rnd.choice(vocabulary) for _ in range(k)]
    passage = draw(35)
    texts = []
    for i in range(n):
        body = draw(rnd.choice([0, 3, 19, 20, 21, 60, 200]))
        if i % 4 == 0:
            at = rnd.randint(0, len(body))
            body[at:at] = passage
        texts.append(rnd.choice([" ", "\n", " \t "]).join(body))
    for i in range(0, n, 5):
        body = texts[i].split()
        texts.append(texts[i])
        if len(body) > 100:
            body[50] = "changed"
            texts.append(" ".join(body))
    return [*texts, None, "", "  \n ", "same " * 90, " not a gap  here", "x"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "p", "c") for i, t in enumerate(make_texts())], DOCS)


def brute_removal(rows, size):
    seen, out = {}, {}
    for i, text in sorted(rows):
        words = words_of(text)
        gone = set()
        for s in range(len(words) - size + 1):
            if seen.setdefault(tuple(words[s : s + size]), (i, s)) != (i, s):
                gone.update(range(s, s + size))
        out[i] = (len(words), len(gone), " ".join(w for j, w in enumerate(words) if j not in gone))
    return out


@pytest.mark.parametrize("size", [20, 8])
def test_removal_equals_brute_force(docs, size):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: r for r in remove_repeats(docs, size).collect()}
    want = brute_removal(rows, size)
    assert {i: (r["n_words"], r["n_removed"], " ".join(words_of(r["text"]))) for i, r in got.items()} == want
    assert all(r["part"] == "p" and r["copies"] == "c" for r in got.values())
    assert all(sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"] for r in got.values())
    untouched = dict(rows)
    assert all(r["text"] == untouched[i] for i, r in got.items() if not r["n_removed"])


def test_removal_of_small_slices_and_long_texts(docs, monkeypatch):
    want = {r["doc_id"]: r["text"] for r in remove_repeats(docs).collect()}
    from gridterrain.llm import workers

    monkeypatch.setattr(workers, "SLICE_BYTES", 64)
    monkeypatch.setattr(substrings, "slices", lambda bounds: workers.slices(bounds, 64))
    assert {r["doc_id"]: r["text"] for r in remove_repeats(docs).collect()} == want


def test_chosen_halves_are_the_leftmost_least_and_take_little_memory():
    import tracemalloc

    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, 3_000).astype(np.uint64)  # few different words, so many halves are equal
    for size in (2, 4, 7, 20):
        firsts, halves = np.array([0, 5, 5, 1_000, 3_000]), windows(words, size // 2)
        starts, chosen = substrings._chosen(words, firsts, size)
        assert starts.tolist() == [i for a, b in zip(firsts[:-1], firsts[1:], strict=True) for i in range(a, b - size + 1)]
        assert chosen.tolist() == [min(range(i, i + size - size // 2 + 1), key=lambda j: (halves[j], j)) for i in starts.tolist()]
    words = rng.integers(0, 2**63, 200_000).astype(np.uint64)
    tracemalloc.start()
    substrings._chosen(words, np.array([0, len(words)]), 20)
    assert tracemalloc.get_traced_memory()[1] < 10 * words.nbytes
    tracemalloc.stop()


def test_texts_of_a_batch_are_hashed_in_small_slices():
    import pyarrow as pa

    texts = pa.array(["some words " * 20_000] * 15)
    seen = [b - a for p in substrings._pieces(pa.RecordBatch.from_arrays([texts], names=["t"]), "t") for a, b, *_ in substrings._sliced(p, "t")]
    assert sum(seen) == 15 and max(seen) == 4


def test_removal_corner_cases(spark):
    text = " ".join(f"a{i}" for i in range(40))
    rows = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in remove_repeats(rows).collect())
    assert got == [(0, 0), (1, 40), (1, 40), (2, 40)]  # the null id is the first; repeated rows are one document
    assert remove_repeats(rows.limit(0)).collect() == []


def test_levels_double_until_nothing_is_left(spark):
    text = [f"a{i}" for i in range(100)]
    rows = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(text[:50])), (3, " ".join([*text[30:52], "other"]))], "doc_id long, text string")
    got = {r["id"]: (r["length"], r["windows"]) for r in longest_repeats(rows, 20).collect()}
    assert got == {1: (40, 11), 2: (40, 11), 3: (20, 3)}


def brute_classes(rows):
    sets = {}
    for i, text in rows:
        w = words_of(text)
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    links, parent = dict.fromkeys(sets, 0), {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                links[a], links[b] = links[a] + 1, links[b] + 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (root(i), links[i]) for i in sets}


@pytest.mark.parametrize(("bucket", "block"), [(1024, 1024), (4, 3)])
def test_classes_equal_brute_force(docs, monkeypatch, bucket, block):
    monkeypatch.setattr(jaccard, "BUCKET", bucket)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_classes(docs).collect()}
    assert got == brute_classes([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_a_chain_of_copies_is_one_class(spark):
    words = [f"v{i}" for i in range(300)]
    texts = []
    for i in range(40):  # each differs from the one before by a word, the ends by forty
        words[i * 7] = f"n{i}"
        texts.append((i, " ".join(words)))
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_classes(rows).collect()} == brute_classes(texts)


def test_classes_corner_cases(spark):
    rows = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (6, None), (7, None), (8, "a b"), (9, "a b")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["class_id"], r["n_links"]) for r in jaccard_classes(rows).collect())
    assert got == [(0, 5, 2), (5, 5, 2), (5, 5, 2), (6, 6, 0), (7, 7, 0), (8, 8, 1), (9, 8, 1)]
    assert jaccard_classes(rows.limit(0)).collect() == []


@pytest.mark.parametrize("block", [1024, 2])
def test_null_and_repeated_ids_with_different_texts(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    rnd = random.Random(9)
    texts = [[f"k{rnd.randrange(10**6)}" for _ in range(120)] for _ in range(12)]
    near = lambda i: " ".join([*texts[i][:60], "changed", *texts[i][61:]])
    full = [" ".join(t) for t in texts]
    rows = [(None, t) for t in full[:8]] + [(None, near(i)) for i in range(4)] + [(None, full[0]), (5, near(4)), (6, full[8]), (6, full[9]), (6, near(9)), (7, near(8)), (8, full[10])]
    rows += [(6, full[11])] * 3 + [(9, near(11)), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    # Brute force over rows that each have an id of their own, in the order of the ids.
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    classes = brute_classes([(n, rows[i][1]) for n, i in enumerate(order)])
    want = [(rows[i][0], rows[order[classes[n][0]]][0], classes[n][1]) for n, i in enumerate(order)]
    assert sorted(map(repr, map(tuple, jaccard_classes(docs).collect()))) == sorted(map(repr, want))
    kept = without_near_copies(docs).collect()
    place = {rows[i]: n for n, i in enumerate(order)}
    assert sorted(classes[place[tuple(r)]][0] for r in kept) == sorted({c for c, _ in classes.values()})
    assert all(r["doc_id"] == rows[order[classes[place[tuple(r)]][0]]][0] for r in kept)


def test_more_recall_takes_more_runs():
    assert 1 < runs_for(0.9) < runs_for(0.99) < runs_for(0.999)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    model, codes, target = _new_model(["a", "b"], rng), rng.integers(0, 257, (6, 4)), np.array([0, 1, 1, 0])
    _, grads = loss_and_gradients(model, codes, target)
    for part, grad in zip(model.parts(), grads, strict=True):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        kept = part[at]
        ends = []
        for step in (1e-2, -1e-2):
            part[at] = kept + step
            ends.append(loss_and_gradients(model, codes, target)[0])
        part[at] = kept
        assert abs((ends[0] - ends[1]) / 2e-2 - grad[at]) < 1e-3


def by_hand(model, text):
    """Label probabilities of one text, segment by segment and byte by byte."""
    squash = lambda x: x / (1 + abs(x))
    total = np.zeros(len(model.labels))
    for start in range(0, len(text), STEPS):
        part = text[start : start + STEPS]
        sides = []
        for d, codes in ((model.forward, part), (model.backward, part[::-1])):
            h, states = np.zeros(UNITS), []
            for c in codes:
                z, r = (0.5 + 0.5 * squash(d.table[i][c] + h @ d.back[i]) for i in (0, 1))
                n = squash(d.table[2][c] + r * (h @ d.back[2] + d.bias))
                h = z * h + (1 - z) * n
                states.append(h)
            sides.append(states)
        for f, b in zip(sides[0], sides[1][::-1], strict=True):
            e = np.exp(np.concatenate([f, b]) @ model.out + model.out_bias)
            total += e / e.sum()
    return total / max(1, len(text))


def test_prediction_equals_a_plain_loop_for_any_length_and_company():
    rng = np.random.default_rng(3)
    model = train([bytes(rng.integers(97 + 5 * (i % 3), 110, int(n), np.uint8)) for i, n in enumerate(rng.integers(1, 65, 90))], [f"l{i % 3}" for i in range(90)], epochs=2)
    texts = [bytes(rng.integers(0, 256, n, np.uint8)) for n in (1, 63, 64, 65, 0, 2, 200, 130_000, 64)]
    bounds = np.cumsum([0, *map(len, texts)])
    found = pooled(model, np.frombuffer(b"".join(texts), np.uint8), bounds)
    assert np.allclose(found, [by_hand(model, t) for t in texts], atol=2e-5)


def test_training_and_prediction_see_the_same_positions():
    rng = np.random.default_rng(4)
    model, text = _new_model(["a", "b"], rng), bytes(rng.integers(0, 256, 40, np.uint8))
    codes = np.full((STEPS, 1), PAD)
    codes[:40, 0] = list(text)
    loss, _ = loss_and_gradients(model, codes, np.array([1]))
    assert np.isclose(loss, loss_and_gradients(model, codes[:40], np.array([1]))[0], atol=1e-6)


def test_held_out_languages_are_recognised(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    labelled = label_languages(docs.withColumn("lang", F.when(is_held_out(F.col("doc_id")), None).otherwise(F.col("lang"))), fit(docs)).select("doc_id", "lang_pred", "score")
    both = labelled.join(docs.select("doc_id", "lang"), "doc_id").filter(is_held_out(F.col("doc_id"))).collect()
    assert len(both) > 200
    assert sum(r["lang"] == r["lang_pred"] for r in both) / len(both) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in both)


def test_language_corner_cases(spark):
    rows = spark.createDataFrame([(i, t, "x" if i % 2 else "y", "old") for i, t in enumerate(["abab " * 9, "cdcd " * 9] * 9)], "doc_id long, text string, lang string, score string")
    odd = spark.createDataFrame([(90, None, None, "s"), (None, "", "x", "s"), (91, "12 34 !", "x", "s"), (92, "abab", "x", "s")], rows.schema)
    model = fit(rows.unionByName(odd))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in label_languages(odd, model).collect()}
    assert got[90] == got[None] == got[91] == ("und", 0.0)
    assert got[92][0] in ("x", "y")
    assert fit(rows.limit(0)) is None
    assert [r["lang_pred"] for r in label_languages(odd, None).collect()] == ["und"] * 4
    assert label_languages(odd.limit(0), model).collect() == []


def brute_fingerprint(text):
    def hashes(part, n):
        return [xxhash.xxh64(part.encode(), seed=xxhash.xxh64(struct.pack("<i", k), seed=42).intdigest()).intdigest() for k in range(n)]

    exact, near = [0] * 16, [0] * 64
    for line in text.split("\n"):
        h = hashes(line, 8)
        exact = [(e + (h[i // 2] >> 32 * (i % 2))) % 2**32 for i, e in enumerate(exact)]
    for run in re.findall(r"[^\S\n]*(?:\S+[^\S\n]*){1,8}", text, re.A):
        h = hashes(run, 8)
        near = [(v + (h[i // 8] >> 8 * (i % 8) & 255) * 2 - 255) % 2**40 for i, v in enumerate(near)]
    return "".join(f"{x:08x}" for x in exact) + "".join(f"{x:010x}" for x in near)


def test_fingerprints_equal_brute_force(spark):
    texts = [t for t in make_texts() if t is None or " " not in t]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in edit_likeness(rows).select("*", fingerprint_text(F.col("fp")).alias("f"), fingerprint_text(F.col("edited_fp")).alias("e")).collect()}
    for i, text in enumerate(texts):
        text, following = text or "", texts[(i + 1) % len(texts)] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert (got[i]["n_chars"], got[i]["edited"]) == (len(text), edited)
        assert (got[i]["f"], got[i]["e"]) == (brute_fingerprint(text), brute_fingerprint(edited))
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
        assert got[i]["near_next"] == 1 or text != following


def test_fingerprints_add_up_and_forget_order(spark):
    rows = spark.createDataFrame([("a b\nc d e", "c d e\na b", "a b", "c d e")], "whole string, turned string, one string, two string")
    whole, turned, one, two = (fingerprint(F.col(c)) for c in rows.columns)
    equal = rows.select(whole == turned, whole == add_fingerprints(one, two), one == add_fingerprints(whole, two, -1), whole == one).first()
    assert tuple(equal) == (True, True, True, False)


def test_fingerprints_corner_cases(spark):
    rows = spark.createDataFrame([(1, "ab"), (1, "ab"), (None, "zz"), (7, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["edited"]) for r in edit_likeness(rows).collect())
    assert got == [(0, "za"), (1, "a"), (1, "aa"), (7, "")]
    assert edit_likeness(rows.limit(0)).collect() == []
    assert [(r["edited"], r["near_next"]) for r in edit_likeness(rows.limit(1)).collect()] == [("aa", 1.0)]
    assert hashlib.sha256(b"aa").hexdigest() == edit_likeness(rows.limit(1)).select(F.sha2("edited", 256)).first()[0]


def thue_morse(levels, a, b):
    one, two = [a], [b]
    for _ in range(levels):
        one, two = one + two, two + one
    return one, two


def test_words_and_windows_that_collide_in_powers_of_two(spark):
    one, two = ("".join(x) for x in thue_morse(11, "a", "b"))
    data = f"{one} {two}".encode()
    hashes = hashed_words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]
    assert hashes[0] != hashes[1]
    values = np.array([*thue_morse(11, 3, 8)[0], *thue_morse(11, 3, 8)[1]], np.uint64)
    for other in (False, True):
        found = windows(values, 2048, other)
        assert found[0] != found[2048]
    filler = " ".join(f"f{i}" for i in range(25))
    rows = spark.createDataFrame([(1, f"{filler} {one}"), (2, f"x {one}"), (3, f"y {two} z")], "doc_id long, text string")
    texts = spark.createDataFrame([(1, " ".join(f"p{i}" for i in range(19)) + " " + one), (2, " ".join(f"p{i}" for i in range(19)) + " " + two)], "doc_id long, text string")
    assert [r["n_removed"] for r in remove_repeats(texts).collect()] == [0, 0]
    alone = [(r["doc_id"], r["n_links"]) for r in jaccard_classes(spark.createDataFrame([(1, f"{one} " * 5), (2, f"{two} " * 5)], "doc_id long, text string")).collect()]
    assert sorted(alone) == [(1, 0), (2, 0)]
    assert all(r["n_removed"] == 0 for r in remove_repeats(rows).collect())


def test_hashes_of_words_depend_on_the_word_alone():
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("ab é\t") for _ in range(rnd.randint(0, 60))) for _ in range(200)]
    data = "".join(texts).encode()
    bounds = np.cumsum([0, *(len(t.encode()) for t in texts)])
    hashes, starts, ends, _ = hashed_words(np.frombuffer(data, np.uint8), bounds)
    found = {}
    for h, a, b in zip(hashes.tolist(), starts.tolist(), ends.tolist(), strict=True):
        assert found.setdefault(data[a:b], h) == h
    assert len(set(found.values())) == len(found)
    words = np.array([found[w] for w in sorted(found)] * 2, np.uint64)
    for size in (1, 2, 3, 5, 10, 20):
        once = windows(words, size)
        assert (once[: len(found) - size + 1] == once[len(found) : len(found) + len(found) - size + 1]).all()
        assert len(set(once[: len(found)].tolist())) == len(found)


def test_likeness_does_not_depend_on_how_often_lines_repeat(spark):
    from gridterrain.llm.fingerprints import likeness

    rows = spark.createDataFrame([(n, "a b c\n" * n, "a b c\n" * (n // 2) + "x y z\n" * (n // 2)) for n in (1000, 100_000)], "n int, one string, two string")
    found = rows.select(likeness(fingerprint(F.col("one")), fingerprint(F.col("two")))).collect()
    assert abs(found[0][0] - found[1][0]) < 1e-6


def test_names_of_the_input_meet_none_of_the_operators(spark):
    names = ["_letters", "letters", "c0", "_mix_key", "_mix_steps", "_mix_docs", "_mix_copies", "_id", "_mark", "class_id"]
    docs = spark.createDataFrame([(1, "abc def", "s"), (2, "xyz", "s")], "doc_id long, text string, source string").withColumns({n: F.lit(n) for n in names})
    weights = spark.createDataFrame([("s", 1.0)], "source string, weight double")
    model = train([b"abc", b"xyz"], ["a", "b"], epochs=1)
    for found in (label_languages(docs, model), mix_sources(docs, weights, total=20.0), without_near_copies(docs)):
        assert found.columns[: len(docs.columns)] == docs.columns
        assert found.count() and all(r[n] == n for r in found.collect() for n in names)

"""Language identification and compression classifier: held-out accuracy, exact code lengths, awkward rows."""

import math
import random
import zlib

import numpy as np
import pytest

from millrace.llm import language_id, quality_classifier
from millrace.llm.shared import held_out

SYLLABLES = {"aa": "ka mo ti ru ne lo".split(), "bb": "sch ung ei ach ver tz".split(), "cc": "ção em ão qu es ra".split()}


def text_of(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(3)
    return [(i, text_of(lang, rng.randint(4, 40), rng), lang) for i, lang in enumerate(rng.choice("aa bb cc".split()) for _ in range(400))]


def brute_bits(train, text, order=language_id.ORDER, least=language_id.LEAST_SEEN, alphabet=None, shared=None):
    """Code length by plain counting, with escapes and exclusion."""
    bits = 0.0
    data = text.encode()
    for i, symbol in enumerate(data):
        context = data[max(0, i - order) : i]
        while context and context not in shared:
            context = context[1:]
        excluded = set()
        while True:
            seen = {s: n for s, n in train.get(context, {}).items() if s not in excluded}
            if seen:
                total = sum(seen.values()) + len(seen)
                if symbol in seen:
                    bits -= math.log2(seen[symbol] / total)
                    break
                bits -= math.log2(len(seen) / total)
                excluded |= set(seen)
            if not context:
                bits += math.log2(256 - len(excluded))
                break
            context = context[1:]
    return bits


def count_contexts(texts, order=language_id.ORDER):
    out = {}
    for t in texts:
        data = t.encode()
        for i, symbol in enumerate(data):
            for k in range(min(order, i) + 1):
                at = out.setdefault(data[i - k : i], {})
                at[symbol] = at.get(symbol, 0) + 1
    return out


def test_code_lengths_equal_plain_counting(spark, labelled):
    df = spark.createDataFrame(labelled[:60], "doc_id long, text string, lang string")
    counts = [tuple(r) for r in language_id.context_counts(df).collect()]
    model = language_id.freeze(counts)
    trees = {lang: count_contexts([t for _, t, g in labelled[:60] if g == lang]) for lang in SYLLABLES}
    totals = {}
    for tree in trees.values():
        for context, seen in tree.items():
            totals[context] = totals.get(context, 0) + sum(seen.values())
    shared = {c for c, n in totals.items() if n >= language_id.LEAST_SEEN}
    tests = ["kamo tiru", "verschung", "xyz é", "ção", "k", "kamo" * 30]
    got = model.code_lengths([t.encode() for t in tests])
    for row, text in zip(got, tests):
        for bits, lang in zip(row, model.languages):
            assert bits == pytest.approx(brute_bits(trees[lang], text, shared=shared), rel=1e-5)


def test_runs_of_a_long_text_keep_their_contexts(spark, labelled, monkeypatch):
    df = spark.createDataFrame(labelled[:60], "doc_id long, text string, lang string")
    model = language_id.freeze([tuple(r) for r in language_id.context_counts(df).collect()])
    texts = [t.encode() for _, t, _ in labelled[60:70]] + [b"", b"x"]
    whole = model.code_lengths(texts)
    monkeypatch.setattr(language_id, "RUN_BYTES", 7)
    assert np.allclose(model.code_lengths(texts), whole, rtol=1e-5)


def test_languages_of_held_out_texts(spark, labelled):
    df = spark.createDataFrame(labelled, "doc_id long, text string, lang string").withColumn("held_out", held_out())
    model = language_id.learn(df.where("NOT held_out"))
    rows = language_id.predict(df, model, ["doc_id", "lang", "held_out"]).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    tested = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in tested) / len(tested) > 0.97


def test_languages_of_awkward_rows(spark, documents, labelled):
    df = spark.createDataFrame(labelled, "doc_id long, text string, lang string")
    model = language_id.learn(df)
    rows = [(1, None), (2, ""), (3, "12 %%"), (4, "kamo tiru neka"), (4, "kamo tiru neka"), (None, "schungver ei"), (5, "😀é")]
    out = language_id.predict(documents(rows, "lang_pred score"), model, ["doc_id"]).collect()
    assert sorted([(r.doc_id, r.lang_pred) for r in out if r.doc_id in (1, 2, 3, 4)]) == [
        (1, "und"), (2, "und"), (3, "und"), (4, "aa"), (4, "aa"),
    ]
    assert [r.lang_pred for r in out if r.doc_id is None] == ["bb"]
    assert all(0 <= r.score <= 1 for r in out)
    assert language_id.predict(documents([]), model, ["doc_id"]).count() == 0


def test_nothing_to_learn_from(documents):
    docs = documents([(1, "some text"), (2, None)])
    model = language_id.learn(docs)
    assert {r.lang_pred for r in language_id.predict(docs, model, ["doc_id"]).collect()} == {"und"}


def good(rng):
    return text_of("aa", rng.randint(30, 80), rng)


def bad(rng):
    return "!! ".join(w.upper() for w in text_of("aa", rng.randint(30, 80), rng).split())


@pytest.fixture(scope="module")
def judged():
    rng = random.Random(5)
    marks = [rng.random() < 0.7 for _ in range(500)]
    return [(i, good(rng) if m else bad(rng), int(m)) for i, m in enumerate(marks)]


def test_quality_of_held_out_texts(spark, judged):
    docs = spark.createDataFrame([r[:2] for r in judged], "doc_id long, text string").withColumn("held_out", held_out())
    labels = spark.createDataFrame([(r[0], r[2]) for r in judged] * 2, "doc_id long, quality int").where(~held_out())
    model = quality_classifier.learn(docs, labels)
    out = {r.doc_id: r for r in quality_classifier.classify(docs, model, ["doc_id", "held_out"]).collect()}
    tested = [(out[i], m) for i, _, m in judged if out[i].held_out]
    assert sum(r.predicted == m for r, m in tested) / len(tested) > 0.95
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in out.values())


def test_quality_of_awkward_rows(spark, documents, judged):
    docs = spark.createDataFrame([r[:2] for r in judged], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in judged] + [(None, 1), (3, None), (10**9, 0)], "doc_id long, quality int")
    model = quality_classifier.learn(docs, labels)
    rows = [(1, None), (2, ""), (3, "x" * 200_000), (4, "same"), (4, "same"), (None, "no key")]
    out = quality_classifier.classify(documents(rows, "score predicted"), model, ["doc_id"]).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert quality_classifier.classify(documents([]), model, ["doc_id"]).count() == 0


@pytest.mark.parametrize("marks", [[], [(1, 1)], [(1, 0), (2, 0)], [(1, 1), (2, 0)], [(1, 1), (2, 0), (3, 1), (4, 0)]])
def test_few_labels(spark, documents, marks):
    docs = documents([(i, f"text number {i} " * 5) for i in range(1, 6)])
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    out = quality_classifier.classify(docs, quality_classifier.learn(docs, labels), ["doc_id"]).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)

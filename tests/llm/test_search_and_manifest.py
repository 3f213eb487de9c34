"""Ranked search, prefix encoding and the Merkle manifest against plain versions of the same."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from millrace.llm import ball_tree_search, merkle_manifest, prefix_bpe
from millrace.llm.shared import tokenizer_path

RANKS, PATTERN = tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def words():
    return prefix_bpe.vocabulary(RANKS, PATTERN)


@pytest.fixture(scope="module")
def library(words):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=words.ranks, special_tokens={})


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


TEXTS = [
    None, "", " ", "  a  b ", "a\nb\r\n\tc", "don't 'S we'll they've 'l l", "é́ 日本語 ﬁ Ⅷ", "x" * 3000, "    " * 50 + "y", "\x1c\x85 　z",
    "A <|endoftext|> b", "ab" * 2000, "😀 K K.,", "\x00a", "the the the", " the", "the ",
]


@given(st.text(max_size=80) | st.text("ab \n\t'strelvdm.,éL1", max_size=120))
@settings(max_examples=400, deadline=None)
def test_prefix_encoding_equals_the_library(text):
    words = prefix_bpe.vocabulary(RANKS, PATTERN)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=words.ranks, special_tokens={})
    assert ids_of(words.encode(text)) == library.encode_ordinary(text)
    assert ids_of(prefix_bpe.PrefixText(words, text).ids()) == library.encode_ordinary(text)
    assert words.decode(words.encode(text)) == text.encode()


def test_every_prefix_has_its_own_encoding(words):
    piece = " unbelievablyaaaaantidisestablish"
    last = words.prefixes(piece.encode())
    for n in range(1, len(piece) + 1):
        assert words.back(last[:n]) == plain(piece[:n].encode(), words.ranks)
        assert words.prefixes(piece.encode(), last[:n]) == last


def plain(raw, ranks):
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while True:
        rank, at = min(((ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 40, 0))
        if rank == 1 << 40:
            return [ranks[p] for p in parts]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


def test_all_orders_of_merges():
    # Ranks in random order over a small alphabet: merges that overlap, repeat and tie.
    rng = random.Random(5)
    for _ in range(60):
        ranks = {bytes([b]): b for b in range(256)}
        for _ in range(14):
            a, b = rng.choice([t for t in ranks if t[0] in b"ab"][-6:] + [b"a", b"b"]), rng.choice([b"a", b"b", b"ab", b"aa"])
            # As in training, a merge joins two tokens that stand side by side.
            if a + b not in ranks and b in ranks and plain(a + b, ranks) == [ranks[a], ranks[b]]:
                ranks[a + b] = len(ranks)
        words = prefix_bpe.Vocabulary(ranks, PATTERN)
        library = tiktoken.Encoding("small", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for _ in range(40):
            text = "".join(rng.choice("aab") for _ in range(rng.randrange(1, 30)))
            assert ids_of(words.encode(text)) == library.encode_ordinary(text)


def test_edits_equal_encoding_anew(words):
    rng = random.Random(2)
    letters = "ab 'tslvré\n.1"
    for _ in range(300):
        held = prefix_bpe.PrefixText(words, "".join(rng.choice(letters) for _ in range(rng.randrange(40))))
        for _ in range(3):
            a = rng.randrange(len(held.text) + 1)
            held.edit(a, rng.randrange(a, min(len(held.text), a + 5) + 1), "".join(rng.choice(letters) for _ in range(rng.randrange(5))))
            held.append(rng.choice(["", "l", "'", " x", "\n"]))
            fresh = prefix_bpe.PrefixText(words, held.text)
            assert (held.table(), held.ids(), held.starts) == (fresh.table(), words.encode(held.text), fresh.starts)


def test_an_edit_encodes_little_again(words):
    held = prefix_bpe.PrefixText(words, "some words of a text " * 500)
    assert held.edit(5000, 5003, "other") <= 6
    assert held.append("end") <= 3


def test_encoding_a_table(spark, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "twice"), (3, "twice"), (3, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS ids", "'y' AS row")
    encoded = prefix_bpe.encode(docs.drop("ids"), RANKS, PATTERN, ["doc_id", "row"], tables=True)
    back = prefix_bpe.decode(encoded, RANKS, PATTERN, ["doc_id", "row"])
    found = sorted((r.doc_id is None, r.doc_id, ids_of(r.ids), bytes(r.decoded), r.row) for r in back.collect())
    assert found == sorted((i is None, i, library.encode_ordinary(t or ""), (t or "").encode(), "y") for i, t in rows)
    stored = prefix_bpe.encode(docs.drop("ids"), RANKS, PATTERN, ["doc_id", "text"], tables=True)
    edited = prefix_bpe.edit(stored, RANKS, PATTERN, ["doc_id"], F.length(F.coalesce("text", F.lit(""))), F.length(F.coalesce("text", F.lit(""))), F.lit("'ll go"))
    for r in edited.collect():
        assert ids_of(r.ids) == library.encode_ordinary(r.text) and r.text.endswith("'ll go")
    none = edited.limit(0)
    assert prefix_bpe.encode(none, RANKS, PATTERN, ["doc_id"]).count() == 0


# Ranked search


def ranked(docs, items, k):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(key, split(t)) for key, t in docs if split(t)]
    n, length = len(held), sum(len(w) for _, w in held)
    out = []
    for item, text in items:
        scores = []
        for key, found in held:
            m, score = 10 + 90 * len(found) * n // length, 0
            for t in set(split(text)):
                df, tf = sum(t in w for _, w in held), found.count(t)
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (1000000000 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scores.append((-score, key is None, key))
        out += [(item, rank + 1, key, -score) for rank, (score, _, key) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def found_by(spark, docs, items, k=10, **columns):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS score", "3 AS item", "4 AS key")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "5 AS rank", "6 AS doc_id")
    return sorted(map(tuple, ball_tree_search.search(d, i, k).collect()), key=repr)


def test_search_equals_scoring_all(spark, sentence, rng, monkeypatch):
    # Small trees, so that bounds and several trees a task take part.
    monkeypatch.setattr(ball_tree_search, "TREE_ROWS", 64)
    monkeypatch.setattr(ball_tree_search, "LEAF_ROWS", 4)
    docs = [(i, sentence(rng.randrange(1, 60))) for i in range(300)] + [(i, "Ähre, ähre STONE7 stone7!") for i in range(300, 330)]
    docs += [(1000, None), (1001, ""), (1002, " .,-"), (1003, "stone7 " * 3000), (None, "stone7 river1"), (5, "stone7 river1"), (5, "stone7 river1")]
    items = [(i, sentence(12)) for i in range(15)] + [(50, "Stone7 unknownword ähre"), (51, None), (52, ""), (53, "nowhere"), (50, "river1 river1")]
    assert found_by(spark, docs, items) == ranked(docs, items, 10)
    assert found_by(spark, docs, items, 3) == ranked(docs, items, 3)


def test_search_in_several_blocks_of_items(spark, sentence, monkeypatch):
    monkeypatch.setattr(ball_tree_search, "BLOCK_TERMS", 20)
    docs = [(i, sentence(20)) for i in range(80)]
    items = [(i, sentence(8)) for i in range(9)]
    assert found_by(spark, docs, items) == ranked(docs, items, 10)


def test_search_without_rows(spark):
    assert found_by(spark, [], [(1, "a b")]) == []
    assert found_by(spark, [(1, "a b")], []) == []


def test_bounds_hold_and_prune(rng):
    n, terms = 2000, 60
    # Two halves of the documents use different terms.
    rows = [np.sort(np.array(rng.sample(range(30 * (i % 2), 30 * (i % 2) + 30), 8))) for i in range(n)]
    values = np.array([rng.randrange(1, 10**6) for _ in range(8 * n)], np.int64)
    tree = ball_tree_search.Tree(list(range(n)), np.arange(0, 8 * n + 1, 8), np.concatenate(rows), values)
    columns, weights = np.array([1, 2, 40]), np.array([5000, 300, 9000])
    bounds = tree.bounds(np.searchsorted(tree.columns, columns), weights)
    item = np.zeros(terms, np.int64)
    item[columns] = weights
    for (a, b), bound in zip(tree.spans, bounds):
        for i in range(a, b, 17):
            s, e = tree.starts[i], tree.starts[i + 1]
            assert (item[tree.columns[tree.terms[s:e]]] * tree.values[s:e]).sum() <= bound
    best = []
    visited = tree.search(np.array([1]), np.array([5000]), best, 10)
    assert visited <= sum(c is None for c in tree.children) * 0.6 and len(best) == 10


# Merkle manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(digests):
    paths, places, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for i, p in enumerate(places):
            run = level[p // 3 * 3 : p // 3 * 3 + 3]
            paths[i].append((run[: p % 3], run[p % 3 + 1 :]))
            places[i] = p // 3
        level = [H(*level[j : j + 3]) for j in range(0, len(level), 3)]
    return level[0], paths


def proofs(rows):
    def leaf(d, text):
        return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d["doc_id"], d["source"], d["lang"], d["n_chars"], text)])

    groups = {}
    for d in rows:
        cut = d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 2 == 0
        text = d["text"].replace("\n", "") if cut and d["text"] else d["text"]
        groups.setdefault(d["source"], []).append((d["doc_id"] is not None, d["doc_id"], leaf(d, d["text"]), leaf(d, text)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    inner = [tree([x[2] for x in sorted(groups[s])]) for s in order]
    root, above = tree([top for top, _ in inner])
    out = []
    for (top, paths), up, s in zip(inner, above, order):
        for (_, key, digest, given), path in zip(sorted(groups[s]), paths):
            for l, r in path + up:
                given = H(*l, given, *r)
            proof = H(*[x for l, r in path + up for x in l + r])
            out.append((key, digest, top, root, proof, given, given == root))
    return sorted(out, key=repr)


def manifest(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    df = df.selectExpr("*", "1 AS tree", "2 AS idx", "3 AS part", "'x' AS digest", "4 AS `group`")
    return sorted(map(tuple, merkle_manifest.verified(df).collect()), key=repr), [r.asDict() for r in df.collect()]


def test_manifest_equals_building_it_by_hand(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["web", "web", "b", "é", "", None]), rng.choice(["en", None]), rng.choice([i, None]), f"a\nb{i}" * (i % 3)) for i in range(900)]
    rows += [(7, "web", "en", 1, "same")] * 5 + [(7, "web", "en", 1, "other"), (None, "web", None, None, None), (None, None, None, None, ""), (-5, "lone", "x", 2, "a\n")]
    found, given = manifest(spark, rows)
    assert found == proofs(given)
    assert any(r[-1] for r in found) and not all(r[-1] for r in found)


@pytest.mark.parametrize("n", [1, 4])
def test_manifest_of_few_rows(spark, n):
    for rows in ([(i, "one", "en", 1, "t\n") for i in range(n)], [(i, f"s{i}", "en", 1, "t") for i in range(n)]):
        found, given = manifest(spark, rows)
        assert found == proofs(given)


def test_manifest_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(merkle_manifest, "BROADCAST_BYTES", 0)
    found, given = manifest(spark, [(i, f"s{i % 7}", "en", i, f"text\n{i}") for i in range(300)])
    assert found == proofs(given)


def test_manifest_without_rows(spark):
    df = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    out = merkle_manifest.verified(df)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and out.count() == 0

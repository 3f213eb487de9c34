"""Near duplicates, decontamination and nearest neighbours against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontamination, jaccard_join, nearest_neighbours
from millrace.llm.components import components
from millrace.session import setting


def brute_shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_groups(rows):
    """Row index to the smallest key of its group, over all pairs."""
    sets = [brute_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return [(key, len(sets[i]), least.get(find(i)) if sets[i] else key) for i, (key, _) in enumerate(rows)]


def changed(text, rng, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_duplicates_equal_brute_force(spark, documents, sentence, rng, values, monkeypatch):
    # Small bounds, so that common shingles, split lists and several runs all occur.
    monkeypatch.setattr(jaccard_join, "COMMON_LEAST", 4)
    monkeypatch.setattr(jaccard_join, "LIST_SIZE", 3)
    monkeypatch.setattr(jaccard_join, "RUN_SHINGLES", 2000)
    passage = sentence(40)
    texts = [sentence(rng.randint(30, 120)) for _ in range(40)]
    texts += [f"{sentence(15)} {passage} {sentence(15)}" for _ in range(15)]
    for _ in range(6):
        base = sentence(rng.randint(40, 150))
        texts += [changed(base, rng, rng.randint(0, 6)) for _ in range(rng.randint(2, 14))]
    chain = sentence(100)
    for _ in range(8):
        chain = changed(chain, rng, 1)
        texts.append(chain)
    texts += [passage] * 5 + [passage.upper(), passage.replace(" ", " \n\t")]
    texts += [None, "", "  \n", "one two", "ONE two", "one", "a b c d e", "a b c d e f"]
    # Sizes at the very threshold: 8 of 10 shingles, and 7 of 9.
    texts += [" ".join(f"t{i}" for i in range(13)), " ".join(f"t{i}" for i in range(12)) + " u", " ".join(f"t{i}" for i in range(1, 13))]
    keys = list(range(0, 3 * len(texts), 3))
    rng.shuffle(keys)
    rows = list(zip(keys, texts))
    df = jaccard_join.near_duplicates(documents(rows, "key n digest node component"))
    assert values(df, "doc_id", "n_shingles", "component_id") == sorted(brute_groups(rows), key=repr)


@pytest.mark.parametrize("common_least", [4, 8])
def test_extended_copies_beside_a_hub(documents, values, monkeypatch, common_least):
    monkeypatch.setattr(jaccard_join, "COMMON_LEAST", common_least)
    monkeypatch.setattr(jaccard_join, "LIST_SIZE", 3)
    rng = random.Random(3)

    def own(n):
        return [f"w{rng.randrange(10**9)}" for _ in range(n)]

    rows = []
    # Per group a hub of 100 shingles, copies with 70 of them and 20 own ones, and longer copies of these: only the two last link.
    for group in range(60):
        hub = own(104)
        texts = [hub]
        for _ in range(1 if group < 45 else 5):
            copy = hub[:74] + own(20)
            texts += [copy, copy + own(rng.choice((18, 20, 22)))]
        rows += [(100 * group + i, " ".join(words)) for i, words in enumerate(texts)]
    df = jaccard_join.near_duplicates(documents(rows))
    assert values(df, "doc_id", "n_shingles", "component_id") == sorted(brute_groups(rows), key=repr)


def test_near_duplicates_of_awkward_keys(documents, sentence, values):
    one, two = sentence(30), sentence(30)
    rows = [(5, one), (5, two), (7, one), (None, two), (3, two), (None, "unlike any other text of these"), (8, None), (8, None), (9, one), (9, one)]
    df = jaccard_join.near_duplicates(documents(rows))
    assert values(df, "doc_id", "n_shingles", "component_id") == sorted(brute_groups(rows), key=repr)
    assert jaccard_join.near_duplicates(documents([])).count() == 0


def test_first_of_each_group_stays(documents, sentence, values):
    one, two = sentence(30), sentence(30)
    rows = [(5, one), (7, one + " more"), (2, two), (2, two), (8, None), (8, None), (9, "")]
    df = jaccard_join.keep_first(documents(rows, "key node component_id"))
    assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "node", "component_id"]
    assert values(df, "doc_id") == sorted([(5,), (2,), (8,), (8,), (9,)], key=repr)


def test_one_row_of_each_group_stays_with_repeated_keys(documents, sentence):
    one, two, three, four, five = (sentence(30) for _ in range(5))
    # Groups: one (3, 5), two (5), three (two texts of 6), four (null keys only), five (null and 9).
    rows = [(3, one), (5, one + " more"), (5, two), (6, three), (6, three + " more"), (6, three.upper()), (7, three)]
    rows += [(None, four), (None, four + " more"), (None, four), (None, five), (9, five), (5, None), (5, None)]
    df = jaccard_join.keep_first(documents(rows, "key row digest"))
    kept = [(r.doc_id, r.text) for r in df.collect()]

    def group(t):
        return next((i for i, g in enumerate((one, two, three, four, five)) if (t or "").lower().startswith(g)), None)

    assert sorted(((k, group(t)) for k, t in kept), key=repr) == sorted([(3, 0), (5, 1), (6, 2), (None, 3), (9, 4), (5, None), (5, None)], key=repr)
    assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "row", "digest"]


def test_join_of_open_pairs_is_a_short_loop(spark, capsys):
    """The JVM's compiler took 422 MB for a method of 5,869 bytes."""
    lists = spark.createDataFrame(
        [(s, node, 10, 500, s, 1, True) for s in range(3) for node in range(6)],
        "shingle long, node long, n int, own int, pos int, bucket int, common boolean",
    )
    labels = spark.createDataFrame([(0, 0), (1, 0)], "node long, component long")
    bounds = spark.createDataFrame([(0, 1, 9, 1), (1, 1, 10, 0)], "node long, hub long, inside long, loose long")
    with setting(spark, "spark.sql.adaptive.enabled", "false"), setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        pairs = jaccard_join.open_pairs(lists, labels, bounds, 80, [])
        capsys.readouterr()
        pairs.explain("codegen")
        sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
        assert sizes and max(sizes) < 5000
        # All pairs but the linked one: those that share the first shingles, once each.
        assert sorted((r.a, r.b) for r in pairs.collect()) == sorted({*combinations(range(6), 2)} - {(0, 1)})


def test_pairs_that_met_too_rarely_are_left_out(spark):
    """The bounds on one row each give what ``meet_often`` and the overlap with a common hub give per pair."""
    rng = random.Random(5)
    nodes = [(i, n := rng.randrange(5, 60), rng.randrange(n // 5 + 1), rng.randrange(1, 12), rng.choice([None, 1, 2]), rng.randrange(n + 1), rng.choice([None, 0, 3])) for i in range(60)]
    rows = [(7, i, n, pos, i, None, held, hub, inside if hub else None, loose if hub else None) for i, n, pos, held, hub, inside, loose in nodes]
    table = spark.createDataFrame(rows, "shingle long, node long, n int, pos int, component long, before long, held long, hub long, inside long, loose long")
    want = []
    for (i, n, pos, held, hub, inside, loose), (j, m, pos2, held2, hub2, inside2, loose2) in combinations(nodes, 2):
        overlap, rest = -(-80 * (n + m) // 180), -(-80 * max(n, m) // 100) - 1
        most = min(n - pos, m - pos2) + min(pos, pos2)
        if hub and hub == hub2:
            both = loose is not None and loose2 is not None
            most = min(most, min(inside, inside2) + (min(loose, loose2) if both else min(n - inside, m - inside2)))
        if 100 * min(n, m) >= 80 * max(n, m) and min(held, held2) >= overlap - rest and most >= overlap:
            want.append((i, n, j, m))
    assert want
    assert sorted(tuple(r) for r in jaccard_join.met_pairs(table, 80).collect()) == want


def test_components_of_long_chains(spark, values):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 9), (9, 7), (3, 3), (-5, 9)]
    df = components(spark.createDataFrame(edges, "a long, b long"))
    assert values(df, "node", "component") == sorted([(i, 100) for i in range(100, 161)] + [(7, -5), (9, -5), (-5, -5)], key=repr)


@pytest.fixture
def benchmark_rows(sentence):
    return [(i, sentence(20 + 4 * i)) for i in range(10)]


def test_planted_items_are_found(spark, documents, sentence, rng, benchmark_rows):
    items = dict(benchmark_rows)
    clean = {i: sentence(rng.randint(1, 300)) for i in range(60)}
    planted = {100 + i: f"{sentence(60)} {items[i]} {sentence(60)}" for i in items}
    planted |= {200 + i: items[i].upper().replace(" ", ",\n") for i in items}
    reworded = {}
    for i in items:
        words = items[i].split()
        for at in range(2, len(words), 6):
            words[at] = f"other{at}"
        reworded[300 + i] = f"{sentence(100)} {' '.join(words)} {sentence(10)}"
    docs = documents([*clean.items(), *planted.items(), *reworded.items(), (400, None), (401, ""), (402, "?!"), (None, items[0])], "key text_hash item")
    bench = spark.createDataFrame([*benchmark_rows, (90, None), (91, ""), (None, items[1])], "item_id long, text string")
    rows = decontamination.contaminated(docs, bench).collect()
    found = {(r.doc_id, r.item_id) for r in rows}
    assert found >= {(100 + i, i) for i in items} | {(200 + i, i) for i in items} | {(300 + i, i) for i in items} | {(None, 0), (101, None)}
    assert not {d for d, _ in found} & ({*clean} | {400, 401, 402})
    kept = decontamination.keep_clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted([*clean, 400, 401, 402])


def test_items_come_in_blocks(spark, documents, sentence, benchmark_rows, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 3)
    docs = documents([(i, f"{sentence(50)} {t}") for i, t in benchmark_rows])
    bench = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()} == {(i, i) for i in range(10)}


def test_full_blocks_lose_no_item(spark, documents):
    rng = random.Random(5)
    own = [f"b{i}" for i in range(6000)]
    items = {i: [rng.choice(own) for _ in range(rng.randint(30, 45))] for i in range(500)}

    def foreign(n):
        return [f"f{rng.randrange(3000)}" for _ in range(n)]

    rows = [(i, " ".join(foreign(37) + ws + foreign(43))) for i, ws in items.items()]
    rows += [(1000 + i, " ".join(foreign(21) + [w if k % 9 else "other" for k, w in enumerate(ws)] + foreign(30))) for i, ws in items.items()]
    rows += [(2000 + i, " ".join(foreign(100))) for i in range(50)]
    bench = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items.items()], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(documents(rows), bench).collect()}
    assert found == {(i, i) for i in items} | {(1000 + i, i) for i in items}


def test_long_items_are_split_over_blocks(spark, documents, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_PASSAGES", 4)
    rng = random.Random(6)
    texts = {i: " ".join(f"b{rng.randrange(2000)}" for _ in range(n)) for i, n in enumerate((300, 20, 90, 40))}
    bench = spark.createDataFrame([*texts.items(), (9, None)], "item_id long, text string")
    blocks = list(decontamination.item_blocks(bench, "item_id", "text", None))
    assert all(sum(b - a for a, b in block.spans) <= 4 for block in blocks)
    docs = documents([(i, f"some other words {t}") for i, t in texts.items()] + [(10, "nothing of it")])
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()} == {(i, i) for i in texts}


@pytest.mark.parametrize("leaked", [0, 100, 297])
def test_leaked_and_short_items_are_found(spark, documents, leaked):
    rng = random.Random(7)
    items = {i: [f"b{rng.randrange(3000)}" for _ in range(n)] for i, n in enumerate((3, 5, 7, 12, 20, 28, 32))}

    def foreign(n):
        return [f"f{rng.randrange(3000)}" for _ in range(n)]

    def planted():
        return " ".join(foreign(23) + [w for ws in items.values() for w in ws + foreign(41)])

    copy = planted()
    # Copies, half of them with a word of their own.
    rows = [(i, copy if i % 2 else f"{copy} own{i}") for i in range(leaked)]
    rows += [(1000 + 10 * i + k, " ".join(foreign(40 + 4 * k) + ws + foreign(47))) for i, ws in items.items() for k in range(4)]
    rows += [(2000 + i, " ".join(foreign(150))) for i in range(max(3, 200 - leaked))]
    bench = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items.items()], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(documents(rows), bench).collect()}
    assert found == {(d, i) for d in range(leaked) for i in items} | {(1000 + 10 * i + k, i) for i in items for k in range(4)}


def test_answers_decide(spark, documents, sentence):
    question = sentence(30)
    bench = spark.createDataFrame([(1, question, "forty two zebras")], "item_id long, text string, answer string")
    half = " ".join(question.split()[:20])
    others = [(i, sentence(80)) for i in range(10, 50)]
    docs = documents([(1, f"{half} forty two zebras {sentence(20)}"), (2, f"{half} {sentence(20)}"), *others])
    rows = decontamination.contaminated(docs, bench, answer="answer").collect()
    assert [(r.doc_id, r.answer_found) for r in rows] == [(1, True)]


def test_nothing_to_compare(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = documents([(1, "some text")])
    assert decontamination.contaminated(docs, none).count() == 0
    assert decontamination.keep_clean(docs, none).count() == 1
    some = spark.createDataFrame([(1, "some item text here")], "item_id long, text string")
    assert decontamination.contaminated(documents([]), some).count() == 0


def test_common_weight_by_hand():
    weights = np.array([1.0, 2.0, 4.0, 8.0])
    text = np.array([3, 0, -1, 1, 2], np.int32)
    assert decontamination.common_weight(np.array([0, 1, 2, 3]), text, weights) == 8.0
    assert decontamination.common_weight(np.array([0, 1, 2]), text, weights) == 7.0
    assert decontamination.common_weight(np.array([2, 1]), text, weights) == 4.0


def brute_neighbours(rows, k, every):
    def fine(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    rows = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and fine(v)]
    out = []
    for i, v in rows:
        if i % every:
            continue
        scores = sorted((-float((v * w).sum() / (np.sqrt((w * w).sum()) * np.sqrt((v * v).sum()))), j) for j, w in rows if j != i)
        out += [(i, rank, j, round(-s, 12)) for rank, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def searched(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, part string")
    found = nearest_neighbours.search(df, F.col("vec_id") % 5 == 0, 3, **how)
    return sorted((r.query_id, r.rank, r.vec_id, round(r.score, 12)) for r in found.collect())


def test_neighbours_in_small_and_awkward_tables(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(40)]
    rows += [(40 + i, rows[10][1]) for i in range(12)]
    rows += [(60, None), (65, []), (70, [0.0] * 8), (75, [float("nan")] + [1.0] * 7), (80, [None] + [1.0] * 7), (85, [float("inf")] + [1.0] * 7), (None, rows[0][1])]
    assert searched(spark, rows) == brute_neighbours(rows, 3, 5)
    assert searched(spark, rows[:3]) == brute_neighbours(rows[:3], 3, 5)
    assert searched(spark, rows[:1]) == [] and searched(spark, []) == []


def test_recall_over_parts(spark, monkeypatch):
    monkeypatch.setattr(nearest_neighbours, "PART_ROWS", 64)
    monkeypatch.setattr(nearest_neighbours, "BLOCK_ROWS", 50)
    monkeypatch.setattr(nearest_neighbours, "BLOCK_QUERIES", 20)
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((12, 16)) * 2
    rows = [(i, (centres[i % 12] + rng.standard_normal(16) * 0.5).astype(np.float32).tolist()) for i in range(900)]
    got, true = searched(spark, rows, sample=400), brute_neighbours(rows, 3, 5)
    assert len(got) == len(true)
    assert len({g[::2] for g in got} & {t[::2] for t in true}) / len(true) >= 0.95
    exact = {(q, j): s for q, _, j, s in got}
    by_id = dict(rows)
    for (q, j), s in list(exact.items())[:50]:
        v, w = np.array(by_id[q], np.float64), np.array(by_id[j], np.float64)
        assert s == pytest.approx(float(v @ w / np.sqrt((v @ v) * (w @ w))), abs=1e-12)


def test_parts_are_balanced():
    rng = np.random.default_rng(1)
    unit = rng.standard_normal((300, 8)).astype(np.float32)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    graph = nearest_neighbours.neighbour_graph(unit, 6)
    part = nearest_neighbours.balanced_parts(graph, 8)
    assert set(np.bincount(part)) <= {37, 38}
    cut = (part[graph] != part[:, None]).mean()
    random.seed(0)
    shuffled = rng.permutation(part)
    assert cut < 0.85 * (shuffled[graph] != shuffled[:, None]).mean()

"""Page extraction, source mixing, chat formatting and the pipeline."""

import hashlib
import os

import oracle
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import chat_formatting, html_extraction, queries, source_mixing

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p><p>no</p>";</script></head><body>
<header><a href=/>Home</a></header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>
<div class="cookie-notice">We use cookies and more words than the shortest paragraph has.</div>
%s
<div class="sidebar"><p>Other stories you may like, with a rather long line of text in it to read.</div>
<section id="comments"><p>First!<p>A long comment of a reader that has quite a lot to say about all of this.</section>
<form><label>Name</label><input><button>Send</button></form><footer>&copy; someone</footer></body></html>"""
BODY = "<h1>The   title</h1><p><b>Bold</b> start, caf&eacute; &amp; more<br>next\n\tline<p>Short.<ul><li>a<li>b</ul><blockquote>Said &#8220;so&#8221;</blockquote>"
TEXT = "The title\nBold start, café & more\nnext line\nShort.\na\nb\nSaid “so”"


@pytest.mark.parametrize("around", ["<article>%s</article>", "<main>%s</main>", "<div class='post'><div class='text'>%s</div></div>", "<article class='post has-sidebar'><header>%s</header></article>"])
def test_pages(around):
    assert html_extraction.main_text(PAGE % (around % BODY)) == TEXT


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""), ("", ""), ("   ", ""), ("plain  text", "plain text"), ("<p>a", "a"), ("<p></p>", ""), ("<nav>menu</nav>", ""),
        ("<article>a<article class=comment>reader</article>b</article>", "a\nb"), ("<article><p>one</article", "one"), ("a &lt;b&gt; &am", "a <b> &am"),
        ("</p></div>x<div>y", "x\ny"), ("<!-- no --><p>yes<!-- no --> it is</p>", "yes it is"), ("<p hidden>no</p><p>yes</p>", "yes"),
        ("<table><tr><td>a<td>b</table>", "a\nb"), ("<article><p>x\u00a0 y</p></article>", "x y"),
    ],
)
def test_fragments(html, text):
    assert html_extraction.main_text(html) == text


@given(st.text("<>/pdivbx &;=\"'!-\n", max_size=200))
@settings(max_examples=300, deadline=None)
def test_any_markup_is_survived(html):
    assert isinstance(html_extraction.main_text(html), str)


def test_deep_and_long_pages():
    deep = "<div>" * 20_000 + "core"
    assert html_extraction.main_text(deep) == "core"
    long = "<article>" + "<p>some words here</p>" * 20_000 + "</article>"
    assert html_extraction.main_text(long).count("\n") == 19_999


def prose(name, n):
    return f"{name} " + "and some more words of the story " * (n // 33)


INTRO, LONG, OTHER = prose("intro", 200).strip(), prose("first", 1300).strip(), prose("second", 300).strip()


@pytest.mark.parametrize(
    "body",
    [
        f"<p>{INTRO}</p><section><p>{LONG}</p></section><section><p>{OTHER}</p></section>",
        f"<p>{INTRO}</p><blockquote>{LONG}</blockquote><p>{OTHER}</p>",
        f"<p>{INTRO}</p><ul><li>{LONG}</li></ul><p>{OTHER}</p>",
        f"<p>{INTRO}</p><pre>{LONG}</pre><p>{OTHER}</p>",
        f"<p>{INTRO}</p><table><tr><td>{LONG}</td></tr></table><p>{OTHER}</p>",
        f"<div><p>{INTRO}</p></div><div><p>{LONG}</p></div><div><p>{OTHER}</p></div>",
        f"<article><p>{INTRO}</p></article><article><p>{LONG}</p></article><article>{OTHER}</article>",
        f"<main><p>{INTRO}</p><section><article><p>{LONG}</p></article></section><article>{OTHER}</article></main>",
    ],
)
@pytest.mark.parametrize("page", ["%s", PAGE, PAGE % "<div class=post>%s</div>"])
def test_whole_text_of_pages_in_parts(page, body):
    assert html_extraction.main_text(page.replace("%s", body)) == "\n".join((INTRO, LONG, OTHER))


def test_what_stands_beside_the_articles():
    comments = f"<section id=comments><article class=comment><p>{INTRO}</p></article><article><p>{OTHER}</p></article></section>"
    menu = "<div><a href=1>One</a><br><a href=2>Two</a><br><a href=3>Three</a></div>"
    assert html_extraction.main_text(f"<main><article><p>{LONG}</p></article>{comments}</main>") == LONG
    assert html_extraction.main_text(f"{menu}<article><p>{LONG}</p></article><article class=related>{OTHER}</article>") == LONG
    assert html_extraction.main_text(f"<article class='post sidebar'><p>{LONG}</p></article>{comments}") == LONG


def test_page_rows(spark, values):
    rows = [(1, "u", PAGE % f"<article>{BODY}</article>", "x"), (2, None, None, "x"), (2, None, None, "x"), (None, "v", "<p>é", "x")]
    df = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    expected = [(1, "u", TEXT, len(TEXT)), (2, None, "", 0), (2, None, "", 0), (None, "v", "é", 1)]
    assert values(df, "page_id", "url", "text", "n_chars") == sorted(expected, key=repr)
    assert html_extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Cut what is too much and share it again, until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= most * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: most * sizes[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, None: 30, "é": 7, "Z": 400}, {"x": 5}, {"a": 100, "b": 100, "c": 100}, {"a": 0, "b": 9}, {}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_mixing.source_targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_mix_comes_near_its_targets(documents, sentence, rng, monkeypatch):
    # Few slices, so that the cut lies in every kind of place.
    monkeypatch.setattr(source_mixing, "SLICES", 4)
    sources = ["hot"] * 300 + ["b"] * 60 + [None] * 50 + ["c"] * 40 + ["d"] * 30
    rows = [(i, sentence(rng.randint(1, 30)), "en", s) for i, s in enumerate(sources)]
    rows += [(1000, None, "en", "hot"), (1001, "", "en", "b"), (1002, "word " * 3000, "en", "hot")]
    docs = documents(rows, "key size rank copies")
    out = source_mixing.mix(docs).collect()
    assert sorted(r.doc_id for r in out) == sorted(r[0] for r in rows)
    size = {r[0]: len((r[1] or "").split()) for r in rows}
    by_source = {}
    for r in rows:
        by_source[r[3]] = by_source.get(r[3], 0) + size[r[0]]
    targets, of = brute_targets(by_source), {r[0]: r[3] for r in rows}
    taken = {}
    for r in out:
        assert r["size"] == size[r.doc_id] and r.source_size == by_source[of[r.doc_id]]
        assert r.target == pytest.approx(targets[of[r.doc_id]])
        assert 0 <= r.taken <= 2 * r["size"] and (not r["size"] or r.taken % r["size"] == 0)
        taken[of[r.doc_id]] = taken.get(of[r.doc_id], 0) + r.taken
    for source, target in targets.items():
        longest = max(size[i] for i in size if of[i] == source)
        assert abs(taken[source] - target) <= longest / 2 + 1e-6
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, source_mixing.mix(docs).collect()), key=repr)
    copies = source_mixing.repeat_documents(docs)
    assert copies.columns == docs.columns
    count = {}
    for r in copies.select("doc_id").collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert all(count.get(r.doc_id, 0) * r["size"] == r.taken for r in out)


def test_one_key_holds_a_quarter_of_all_rows(documents, sentence, rng, monkeypatch):
    monkeypatch.setattr(source_mixing, "SLICES", 8)
    rows = [(i, sentence(rng.randint(1, 30)), "en", "abc"[i % 3]) for i in range(450)]
    # One key with many texts, one row that occurs many times, and rows without a key.
    rows += [(5000, sentence(rng.randint(1, 30)), "en", "abc"[i % 3]) for i in range(150)]
    rows += [(6000, "one two three four five", "en", "a")] * 150 + [(None, f"no key {i % 7}", "en", "b") for i in range(60)]
    docs = documents(rows).repartition(5)
    out = source_mixing.mix(docs).collect()
    assert len(out) == len(rows)
    source_of = {r.source_size: r.target for r in out}
    for source_size, target in source_of.items():
        taken = [(r.taken, r["size"]) for r in out if r.source_size == source_size]
        assert abs(sum(t for t, _ in taken) - target) <= max(n for _, n in taken) / 2 + 1e-6
    twice = [r.taken for r in out if r.doc_id == 6000]
    assert set(twice) <= {0, 5, 10} and len(twice) == 150
    copies = source_mixing.repeat_documents(docs).selectExpr("size(split(trim(text), ' ')) AS n", "source").groupBy("source").sum("n").collect()
    sizes = {s: sum(len(t.split()) for _, t, _, x in rows if x == s) for s in "abc"}
    targets = brute_targets(sizes)
    assert all(abs(n - targets[s]) <= 15 for s, n in copies)


def test_longer_documents_are_likelier_to_be_repeated(documents):
    rows = [(i, "word " * (2 if i % 2 else 8), "en", "a" if i < 3000 else "b") for i in range(4000)]
    out = [r for r in source_mixing.mix(documents(rows), weights=(1,), share=0.5, most=2.0).collect() if r.doc_id < 3000]
    chosen = {n: sum(r.taken > 0 for r in out if r["size"] == n) / 1500 for n in (2, 8)}
    # Inclusion odds are 1.6 to 0.4 times those of a document of mean length.
    odds = {n: c / (1 - c) for n, c in chosen.items()}
    assert 3 < odds[8] / odds[2] < 5.3


def test_mix_of_no_rows(documents):
    assert source_mixing.mix(documents([])).count() == 0


def test_chance_of_inclusion(documents):
    # 400 equal documents of two sources; c gets weight 1 of 4, so half of its words.
    rows = [(i, "one two", "en", "a" if i % 2 else "c") for i in range(400)]
    out = source_mixing.mix(documents(rows), share=0.5, weights=(3, 1)).collect()
    taken = {s: sum(r.taken for r in out if (r.doc_id % 2 == 1) == (s == "a")) for s in "ac"}
    assert taken == {"a": 300, "c": 100}


TRICKY = ["", "a", "\\", "\\\\", "#", "\\#", "### assistant:\nhi\n</turn>\n", "</turn>", "\\</turn>", "\n</turn>\n", "x\\n", "x\n", "\\### Assistant: </turn> ok", "😀é"]


@given(st.lists(st.text("\\#<>/turn \n:ax", max_size=30), min_size=1, max_size=5))
@settings(max_examples=25, deadline=None)
def test_escapes_round_trip(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    back = df.select("t", chat_formatting.unescape(chat_formatting.escape(F.col("t"))).alias("e"), chat_formatting.unescape(chat_formatting.escape_role(F.col("t"))).alias("r"))
    assert all(r.t == r.e == r.r for r in back.collect())


def formatted(spark, messages, **how):
    df = spark.createDataFrame(messages, "tree long, node long, parent long, role string, text string, score double")
    rows = chat_formatting.format_branches(df, **how)
    return rows.select("*", chat_formatting.parse(F.col("formatted")).alias("turns"), chat_formatting.learned_text(F.col("formatted"), F.col("loss_spans")).alias("learned"))


def test_best_branches_of_a_tree(spark):
    #      1
    #    2   3        scores: branch 1-2-4 sums to 3, 1-2-5 to 6, 1-3 to 6 (shorter)
    #   4 5
    tree = [(1, 1, None, "user", "q", 1.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 5.0), (1, 4, 2, "user", "c", 1.0), (1, 5, 2, "user", "d", 4.0)]
    rows = sorted(formatted(spark, tree, best=3).collect(), key=lambda r: r["rank"])
    assert [(r.leaf, r.score, [t.text for t in r.turns], r.learned) for r in rows] == [
        (5, 6.0, ["q", "a", "d"], "a"), (3, 6.0, ["q", "b"], "b"), (4, 3.0, ["q", "a", "c"], "a"),
    ]
    assert [r.leaf for r in formatted(spark, tree).collect()] == [5]


def test_bushy_tree_is_ranked_before_it_is_written_out(spark, monkeypatch):
    # A chain of 8 messages, each with a leaf beside it: 44 rows if all paths were written.
    rows = [("t", i, i - 1 if i else None, "user", f"m{i}", 0.0) for i in range(8)]
    rows += [("t", 1000 + i, i, "assistant", f"leaf {i}", 500.0 if i == 5 else -float(i)) for i in range(8)]
    written = []
    keep = chat_formatting.stored

    def counted(df, *rest):
        out = keep(df, *rest)
        written.append(out.count())
        return out

    monkeypatch.setattr(chat_formatting, "stored", counted)
    df = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    (best,) = chat_formatting.format_branches(df).collect()
    assert (best.leaf, best.score) == (1005, 500.0) and len(best.formatted.split("</turn>")) == 8
    assert max(written) <= 16


def test_awkward_trees(spark):
    messages = [
        (1, 1, 2, "user", "circle", 0.0), (1, 2, 1, "user", "circle", 0.0), (1, 3, 1, "user", "hangs on a circle", 0.0),
        (2, 7, 99, "user", "parent is missing", None), (2, 8, 7, None, None, None), (2, 8, 7, None, None, None),
        (None, 1, None, "assistant", "null tree", 0.0), (3, None, None, "user", "no node", 0.0),
    ]
    rows = {r.tree: r for r in formatted(spark, messages).collect()}
    assert set(rows) == {2, None}
    assert [tuple(t) for t in rows[2].turns] == [("user", "parent is missing"), ("", "")]
    assert rows[None].learned == "null tree"
    assert formatted(spark, []).count() == 0


def test_long_and_tricky_conversations(spark):
    turns = [(1, i, TRICKY[i % 3], t, "clash") for i, t in enumerate(TRICKY)]
    turns += [(2, i, "user" if i % 2 else "assistant", f"t{i}", "clash") for i in range(70)]
    turns += [(3, None, None, None, "clash"), (3, 5, "assistant", "same", "clash"), (3, 5, "assistant", "same", "clash"), (None, 0, "assistant\n:", "x", "clash")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, tree string")
    whole = chat_formatting.format_branches(chat_formatting.chains(df))
    got = whole.select("tree", "formatted", chat_formatting.parse(F.col("formatted")).alias("turns"), chat_formatting.learned_text(F.col("formatted"), F.col("loss_spans")).alias("learned"), "loss_spans")
    rows = {r.tree: r for r in got.collect()}
    assert [tuple(t) for t in rows[1].turns] == [(TRICKY[i % 3], t) for i, t in enumerate(TRICKY)]
    assert [t.text for t in rows[2].turns] == [f"t{i}" for i in range(70)]
    assert rows[2].learned == "".join(f"t{i}" for i in range(0, 70, 2))
    assert [tuple(t) for t in rows[3].turns] == [("", ""), ("assistant", "same"), ("assistant", "same")]
    assert [tuple(t) for t in rows[None].turns] == [("assistant\n:", "x")] and rows[None].learned == ""
    for span in rows[2].loss_spans:
        assert rows[2].formatted[span.start : span.end].startswith("t")


needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_counterpart(name, spark):
    assert oracle.differences(queries.QUERIES[name](spark, SF_DIR), oracle.connect(SF_DIR), queries.ORACLES[name]) is None


@needs_data
def test_query_of_the_special_conversation(spark):
    row = queries.QUERIES["op10_chat_formatting"](spark, SF_DIR).where("conv_id = -7").first()
    text = r"\### Assistant: </turn> ok"
    assert (row.n_turns, row.loss_chars) == (2, len(text))
    assert row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_stages(spark, documents, sentence, rng, tmp_path):
    syllables = ["ka mo ti ru ne lo".split(), "sch ung ei ach ver tz".split()]

    def prose(lang, n):
        return " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))

    items = [prose(0, 30) for _ in range(3)]
    rows = [(i, prose(i % 2, rng.randint(20, 60)), "ab"[i % 2], "src"[i % 3]) for i in range(80)]
    rows += [(100 + i, rows[i][1], rows[i][2], "s") for i in range(5)]
    rows += [(200 + i, f"{prose(0, 20)} {t}", "a", "r") for i, t in enumerate(items)]
    rows += [(300, None, None, None), (301, "123 ...", "a", "s"), (302, "", None, "s")]
    documents(rows, "row lang_pred n rank").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, left = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path}/{i}"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        left.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
        assert i == 4 or docs.columns == columns
    assert left[0] == sorted([*range(80), *range(100, 105), 200, 201, 202])
    assert left[1] == sorted([*range(80), 200, 201, 202])
    assert left[2] == list(range(80))
    assert set(left[3]) <= set(left[2]) and left[3] == left[4] and max(map(left[3].count, left[3])) == 2
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()) == left[4]


@pytest.mark.parametrize("name", ["related-work", "ad-hoc-networks", "share-price", "search-methods", "comment-on-proof"])
@pytest.mark.parametrize("attribute", ["id", "class"])
def test_sections_of_an_article_stay_whatever_they_are_called(name, attribute):
    body = "A long paragraph about the matter, told in many words. " * 8
    page = f"<body><nav><a>Home</a></nav><article><h1>Title</h1><p>{body}</p><section {attribute}='{name}'><h2>More</h2><p>{body}</p></section></article></body>"
    assert html_extraction.main_text(page).count("A long paragraph") == 16


@pytest.mark.parametrize("name", ["ad", "ad-2", "comments", "comment-list", "share-buttons", "lead related-posts", "cookie-notice", "newsletter-signup"])
def test_furniture_inside_an_article_goes(name):
    body = "A long paragraph about the matter, told in many words. " * 8
    page = f"<body><article><h1>Title</h1><p>{body}</p><div class='{name}'><p>Nothing that belongs here. {'So many words. ' * 20}</p></div><p>{body}</p></article></body>"
    text = html_extraction.main_text(page)
    assert "Nothing" not in text and text.count("A long paragraph") == 16

"""Token counts and token files against the tokenizers themselves."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from millrace.llm import shared, token_counts, token_output
from millrace.llm.shared import tokenizer_path

PIECES, WORDS = tokenizer_path("piece_bpe_32k.model"), tokenizer_path("word_bpe_49k.json")
TRICKY = [
    None, "", " ", "  a  b ", "a\nb\r\n\tc", "<s>x</s>", "é́ 日本語 ﬁ Ⅷ", "a▁b", "<0x41>", "\x00a", "x" * 3000, "    " * 50 + "y",
    "A <|endoftext|> b<|startoftext|>c", "ΣΑΣ σ ας", "İ ı", "don't 'S", "zero​width \x85 nel nbsp", "😀 K K.,", "l'été, Straße. Łódź",
]


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@given(st.text(max_size=80) | st.text("ab▁ \n'.,é", max_size=200))
@settings(max_examples=300, deadline=None)
def test_piece_counts_equal_the_library(text):
    reference = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert token_counts.counter(PIECES).count(text) == len(reference.encode(text))


def test_merging_by_hand():
    scores = {"ab": -1.0, "abc": -2.0, "bc": -0.5}
    # bc first, so abc is reached from a + bc.
    assert token_counts.merge_count(list("abc"), scores, lambda s: 1) == 1
    assert token_counts.merge_count(list("aaaa"), {"aa": -1.0}, lambda s: 1) == 2
    assert token_counts.merge_count(list("abab"), {"ab": -1.0}, lambda s: 1) == 2
    assert token_counts.merge_count([], {}, lambda s: 1) == 0


def test_counts_of_awkward_rows(spark, documents, pieces, values):
    rows = [(i, t) for i, t in enumerate(TRICKY)] + [(0, "again"), (None, "no key")]
    df = token_counts.count_tokens(documents(rows, "n_bytes over_limit"), PIECES, limit=5)
    expected = []
    for i, t in rows:
        n = len(pieces.encode(t or ""))
        expected.append((i, len((t or "").encode()), n, n > 5))
    assert values(df, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(expected, key=repr)


def test_counts_of_no_rows(documents):
    assert token_counts.count_tokens(documents([]), PIECES).count() == 0


@given(st.lists(st.integers(0, 2**32 - 1), max_size=400) | st.lists(st.integers(0, 300), max_size=700))
@settings(max_examples=150, deadline=None)
def test_blocks_round_trip(ids):
    ids = np.array(ids, np.uint32)
    assert (token_output.decode_blocks(token_output.encode_blocks(ids)) == ids).all()


def test_block_layout():
    ids = np.arange(100, 100 + 128, dtype=np.uint32)
    ids[7] = 1_000_000
    payload = token_output.encode_blocks(ids)
    # 12 bytes of head, one block start, minimum, width 7, one exception of 1 + 4 bytes.
    assert len(payload) == 12 + 4 + 6 + 128 * 7 // 8 + 5
    assert payload[16:22] == np.array([100], "<u4").tobytes() + bytes([7, 1])
    with pytest.raises(ValueError):
        token_output.decode_blocks(b"else" + payload[4:])


def test_words_equal_whole_texts(monkeypatch):
    encode = token_output.WordEncoder(WORDS)
    assert encode.by_word and encode.plain
    reference = tokenizers.Tokenizer.from_file(WORDS)
    texts = [t or "" for t in TRICKY]
    expected = [np.array(reference.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encode.ids(pa.array(texts)) == expected
    # Also where a text is cut into runs.
    monkeypatch.setattr(token_output, "RUN_BYTES", 40)
    assert encode.ids(pa.array(texts)) == expected


@given(st.text(max_size=60) | st.text("aàÀſßŁ.,'s 1é́\t", max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text_equals_the_library(text):
    encode = token_output.encoder(WORDS)
    assert encode.ids(pa.array([text]))[0] == np.array(encode.encode(text), "<u4").tobytes()


def test_files_hold_every_document(spark, documents, tmp_path, monkeypatch):
    monkeypatch.setattr(token_output, "SEGMENT_IDS", 50)
    rows = [(i * 3 % 19, t) for i, t in enumerate(TRICKY)] + [(4, "same key"), (4, "same key"), (None, "no key"), (50, "word " * 400)]
    path = str(tmp_path / "tokens")
    df = token_output.encode_documents(documents(rows, "start key payload"), WORDS, 2, path)
    reference = tokenizers.Tokenizer.from_file(WORDS)
    at, expected = 0, []
    ordered = documents(rows).selectExpr("doc_id", "coalesce(text, '') AS text").orderBy("doc_id", F.xxhash64("text")).collect()
    for key, text in ordered:
        ids = np.array(reference.encode(text, add_special_tokens=False).ids + [2], "<u4")
        expected.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = [tuple(r) for r in df.orderBy("start").collect()]
    assert got == expected
    whole = token_output.read_tokens(spark, path, ids=True).orderBy("start").collect()
    assert sum(len(r.ids) for r in whole) == at


def test_files_of_no_rows(documents, tmp_path):
    assert token_output.encode_documents(documents([]), WORDS, 2, str(tmp_path / "none")).count() == 0


def test_segments_are_read_a_few_at_a_time(spark, documents, tmp_path, monkeypatch):
    monkeypatch.setattr(token_output, "SEGMENT_IDS", 3)
    rows = [(i, f"some words {i}") for i in range(300)]
    path = str(tmp_path / "tokens")
    batches = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    index = token_output.encode_documents(documents(rows), WORDS, 2, path)
    # The index is read as it is stored: no segment goes to Python in the session's larger batches.
    plan = index._jdf.queryExecution().toString()
    assert path not in plan and "MapInArrow" not in plan
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == batches
    assert [tuple(r) for r in index.orderBy("start").collect()] == [tuple(r) for r in token_output.read_tokens(spark, path).orderBy("start").collect()]
    assert index.count() == 300


def test_small_batches_are_gathered():
    whole = pa.RecordBatch.from_arrays([pa.array([str(i) * (i % 7) for i in range(100)])], ["text"])
    parts = [whole.slice(at, 9) for at in range(0, 100, 9)]
    got = list(shared.gathered(iter(parts), 20, 1 << 20))
    assert [b.num_rows for b in got] == [18, 18, 18, 18, 18, 10]
    assert pa.Table.from_batches(got).equals(pa.Table.from_batches([whole]))
    # What is larger than asked for passes as it is.
    assert [b.num_rows for b in shared.gathered(iter(parts), 20, 1)] == [b.num_rows for b in parts]
    assert list(shared.gathered(iter([]), 20, 1)) == []


def test_shorter_runs_give_the_same_ids():
    texts = pa.array([t or "" for t in TRICKY])
    short = token_output.WordEncoder(WORDS, run_bytes=40)
    assert short.ids(texts) == token_output.WordEncoder(WORDS).ids(texts)
    # No run is longer than asked for, unless a single word is.
    runs = []
    short._run, run = lambda part: runs.append(part) or run(part), short._run
    short.ids(texts)
    assert all(sum(len(t.encode()) for t in part.to_pylist()) <= 40 for part in runs if len(part) > 1)
    assert len(runs) > 1


def page_sizes(spark, file):
    """Bytes of the pages of a Parquet file's last column."""
    jvm = spark._jvm.org.apache
    source = jvm.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.hadoop.fs.Path(str(file)), spark._jsc.hadoopConfiguration())
    reader = jvm.parquet.hadoop.ParquetFileReader.open(source)
    column, sizes = list(reader.getFileMetaData().getSchema().getColumns())[-1], []
    while (group := reader.readNextRowGroup()) is not None:
        pages = group.getPageReader(column)
        while (page := pages.readPage()) is not None:
            sizes.append(page.getUncompressedSize())
    reader.close()
    return sizes


def test_pages_of_large_rows_are_small(spark, tmp_path):
    rows = spark.range(0, 64, 1, 1).selectExpr("id", "CAST(repeat(sha2(CAST(id AS string), 512), 2000) AS binary) AS payload")
    shared.write(rows, str(tmp_path / "usual"))
    shared.write(rows, str(tmp_path / "small"), page_rows=8)
    pages = {}
    for name in ("usual", "small"):
        found = spark.read.parquet(str(tmp_path / name))
        assert found.exceptAll(rows).isEmpty() and found.count() == 64
        (file,) = (tmp_path / name).glob("*.parquet")
        pages[name] = page_sizes(spark, file)
    # 256 KB a row: all 64 rows are one page unless its size is looked at before.
    assert max(pages["usual"]) > 8 << 20 and max(pages["small"]) < 4 << 20


def test_columns_are_read_in_pieces(spark, monkeypatch):
    import corpus_pipeline

    key = "parquet.hadoop.vectored.io.enabled"
    for name, stage in corpus_pipeline.STAGES:
        spark.conf.unset(key)
        with monkeypatch.context() as m:
            for module, call in (("language_id", "learn"), ("jaccard_join", "keep_first"), ("decontamination", "keep_clean"), ("source_mixing", "repeat_documents"), ("token_output", "encode_documents")):
                m.setattr(getattr(corpus_pipeline, module), call, lambda *a, **b: None)
            m.setattr(corpus_pipeline.language_id, "predict", lambda rows, *a: rows.selectExpr("row", "'en' AS lang_pred", "1D AS bits_per_byte"))
            m.setattr(corpus_pipeline, "table", lambda *a: None)
            stage(spark, spark.createDataFrame([(1, "a text")], "doc_id long, text string"), "")
        assert spark.conf.get(key) == "false", name
    spark.conf.unset(key)
    # Spark hands it on to the reader.
    corpus_pipeline.plain_reads(spark)
    assert spark._jsparkSession.sessionState().newHadoopConf().get(key) == "false"
    spark.conf.unset(key)

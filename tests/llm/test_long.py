"""Texts of a million words, words of a million characters, very long URLs; repeated rows and clashing names of pages."""

from __future__ import annotations

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from blobsight.llm import pieces, queries, rans, rules, urls

WORDS = 1_000_000


@pytest.fixture(scope="module")
def long_text():
    return " ".join(f"w{i * i % 9973}" for i in range(WORDS))


def test_token_files_of_a_very_long_text(spark, long_text):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    docs = spark.createDataFrame([(2, long_text), (1, "short one"), (3, None), (3, "x"), (3, "x"), (None, "y")], "doc_id long, text string")
    at, _ = rans.write(docs, path)
    found = {(r.doc_id, r.n_tokens, r.ids_crc32): r.start for r in rans.read(spark, at).collect()}
    encode = lambda t: Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids + [1]
    digest = lambda ids: (len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
    want = [(None, *digest(encode("y"))), (1, *digest(encode("short one"))), (2, *digest(encode(long_text))), (3, *digest([1])), (3, *digest(encode("x")))]
    assert set(found) == set(want) and found[want[2]] == want[0][1] + want[1][1]
    assert rans.read(spark, at).where("doc_id = 3").count() == 3


def test_rules_on_a_very_long_text(spark, long_text):
    docs = spark.createDataFrame([(1, long_text), (1, long_text), (2, "")], "doc_id long, text string")
    found = [r.asDict() for r in rules.judge(docs).collect()]
    words = long_text.split()
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = {p for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for p in (i, i + 1, i + 2)}
    assert [r["n_words"] for r in found] == [WORDS, WORDS, 0] and found[0] == found[1]
    assert found[0]["n_repeat_words"] == len(repeated) and found[0]["word_chars"] == sum(map(len, words))


def test_pieces_of_a_very_long_word(spark):
    word = "abcdefghij" * 100_000
    path = queries.vocabulary("piece_bpe_32k.model")
    import sentencepiece

    docs = spark.createDataFrame([(1, word), (1, word), (2, None)], "doc_id long, text string")
    found = pieces.encode(docs, path).collect()
    want = sentencepiece.SentencePieceProcessor(model_file=path).encode(word)
    assert [(r.doc_id, r.round_trip) for r in found] == [(1, True), (1, True), (2, True)] and found[0].ids == want == found[1].ids and found[2].ids == []


def test_pieces_of_clashing_columns(spark, clashing):
    path = queries.vocabulary("piece_bpe_32k.model")
    rows = pieces.encode(clashing.withColumn("key", F.lit("k")), path, keep=("doc_id", "key", "size", "n_tokens")).collect()
    assert {r.key for r in rows} == {"k"} and {r["size"] for r in rows} == {"clash"} and all(r.round_trip for r in rows)


def test_urls_that_repeat_are_long_or_clash(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    long = "https://example.com/en/7" + "a1-" * 100_000 + "?" + "q=1&" * 50_000
    odd = [(1, long), (1, long), (2, None), (2, ""), (None, "://"), (3, "http://"), (4, "https://shop.example.com/en/5#x"), (4, "https://shop.example.com/en/5#x")]
    rows = pages.unionAll(spark.createDataFrame(odd, pages.schema)).withColumns({n: F.lit("clash") for n in ("host", "path", "rule", "verdict", "p_block", "label", "f_length", "s_1", "html")})
    found = urls.judge(rows, model=urls.train(urls.labelled(pages)))
    assert found.columns == ["page_id", "host", "path", "rule", "verdict", "p_block"] and found.count() == rows.count()
    shown = Counter((r.page_id, r.host, len(r.path), r.rule, r.verdict) for r in found.collect())
    assert shown[1, "example.com", 5 + 300_000, "example.com/en/7", "allow"] == 2
    assert shown[4, "shop.example.com", 5, "com/en/", "block"] == 2
    assert {(h, p, r) for (i, h, p, r, _) in shown if i in (2, None, 3) and not h} == {("", 0, None)}
    assert urls.judge(rows.limit(0), model=urls.train(urls.labelled(pages))).count() == 0

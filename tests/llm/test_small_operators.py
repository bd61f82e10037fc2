"""Licence scan, URL filter, chat format, sentence pieces and WARC on small cases."""

import hashlib

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm import chat_format, license_scan, sentence_pieces, url_filter, warc
from threadloom.llm.queries import RULES, piece_model

# Licences


def best(text):
    return license_scan.TemplateIndex(license_scan.TEMPLATES, 0.75).scan(text)


def test_licence_units():
    prose = "word " * 400
    assert best(None) == best("") == best("one") == best(prose) == []
    assert best(prose + "\nReleased under the MIT licence.\n" + prose)[0][:4] == ("line", 1, 1, "MIT")
    assert ("block", 0, 2, "CC-BY-NC-4.0", 1.0) in best("Licensed under\nCC BY-NC 4.0.\n\nmore text that is not a notice at all")
    assert best("RELEASED, under the *MIT* License")[0][4] == 1.0


def test_licence_runs_inside_lines_and_over_wraps():
    prose = "some words of a longer paragraph that goes on and on before it comes to the point "
    hit = [m for m in best(prose * 3 + "and so it is Released under the MIT License. " + prose * 3) if m[0] == "run"]
    assert ("run", 0, 1, "MIT", 1.0) in hit
    wrapped = prose + "\n" + prose + "Permission is hereby granted, free of\ncharge, to any person obtaining a copy of this software and associated\ndocumentation files (the \"Software\"), to deal in the Software without\nrestriction, including without limitation the rights to use, copy, modify,\nmerge, publish, distribute, sublicense, and/or sell copies of the Software,\nand to permit persons to whom the Software is furnished to do so, subject to\nthe following conditions " + prose
    assert ("run", 1, 7, "MIT", 1.0) in best(wrapped)
    assert not best(prose * 50)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["released", "under", "the", "mit", "license", "x", "y"]), max_size=40))
def test_licence_runs_are_the_nearest(words):
    index = license_scan.TemplateIndex([("MIT", "Released under the MIT License."), ("T", "the the mit x y x")], 0.75)
    text = [w.encode() for w in words]
    want = set()
    for g, n in zip(index.grams, index.lengths, strict=True):
        scores = [(-2 * len(license_scan.bigrams(text[p : p + n]) & g) / max(1, len(license_scan.bigrams(text[p : p + n])) + len(g)), p) for p in range(len(text) - n + 1)]
        if scores and -min(scores)[0] >= 0.75:
            want.add((min(scores)[1], n))
    assert set(index.runs(text)) == want


def test_licence_bounds_lose_nothing():
    templates = [("t", "a b c d e f g h i j")]
    index = license_scan.TemplateIndex(templates, 0.75)
    target = license_scan.bigrams(license_scan.normalise(templates[0][1]).split())
    for n in range(2, 30):
        words = [b"%c" % (97 + k % 26) for k in range(n)]
        g = license_scan.bigrams(words)
        dice = 2 * len(g & target) / (len(g) + len(target))
        assert (index.match(words) is not None) == (dice >= 0.75)


def test_licence_empty_table_and_clashing_columns(spark, docs):
    assert license_scan.best_licence(license_scan.scan_licences(docs([]))).count() == 0
    from pyspark.sql import functions as F

    odd = docs([(1, "Released under the MIT License."), (None, None)]).withColumn("matches", F.lit(3)).withColumn("dice", F.lit("x"))
    got = {r["doc_id"]: (r["licence"], r["dice"]) for r in license_scan.best_licence(license_scan.scan_licences(odd)).collect()}
    assert got == {1: ("MIT", 1.0), None: (None, 0.0)}


def test_licence_long_texts_and_repeated_rows(spark, docs):
    text = "word " * 200_000 + "\n\nReleased under the MIT License.\n\n" + "more " * 200_000
    got = license_scan.best_licence(license_scan.scan_licences(docs([(1, text), (1, text), (2, "x")]))).collect()
    assert sorted((r["doc_id"], r["licence"] or "", r["dice"]) for r in got) == [(1, "MIT", 1.0), (1, "MIT", 1.0), (2, "", 0.0)]


# URLs


def brute(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    top = max(fits, key=lambda r: len(r.pattern), default=None)
    return (top.pattern, top.verdict) if top else None


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(["http", "https", "x"]), st.sampled_from(["example.net", "a.example.net", "notexample.net", "EXAMPLE.com", "b.org", "org", "net", "", "a.net:80", "a\nb.net", "net\n", "\nnet", "a\n.example.net", "x\t.org"]), st.sampled_from(["", "/", "/en/", "/en", "/de/x", "/fr/", "//fr/", "/fr/\n", "/en\n/", "/\r"]), st.sampled_from(["", "?a=/en/", "#x/y"]))
def test_urls_against_all_rules(scheme, host, path, tail):
    got = url_filter.split_url(f"{scheme}://{host}{path}{tail}")
    assert got == (host.lower(), path)
    assert url_filter.RuleIndex(RULES).judge(*got) == brute(*got)


def test_url_nulls_and_bad_rules(spark):
    rows = spark.createDataFrame([(1, None, "h"), (2, "no scheme", "h"), (3, "http://x.net/", "h"), (3, "http://x.net/", "h")], "page_id long, url string, host string")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(rows, RULES).collect())
    assert got == [(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "x.net", "/", "net/", "block"), (3, "x.net", "/", "net/", "block")]
    assert url_filter.judge_urls(rows.limit(0), RULES).count() == 0
    with pytest.raises(ValueError):
        url_filter.RuleIndex([url_filter.Rule("a/", "block"), url_filter.Rule("a/", "allow")])


def test_line_feeds_and_long_urls():
    index = url_filter.RuleIndex(RULES)
    assert index.judge(*url_filter.split_url("http://a\nb.net/x")) == ("net/", "block")
    assert index.judge(*url_filter.split_url("http://net\n/x")) is None
    assert index.judge(*url_filter.split_url("http://" + "a." * 50_000 + "net/" + "x/" * 100_000)) == ("net/", "block")


def test_prefix_tokens_are_no_keys():
    index = url_filter.RuleIndex([url_filter.Rule("a.b/pre", "block")])
    assert index.judge("a.b", "/prefix") == ("a.b/pre", "block")


# Chat


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["\\", "#", "### Assistant:", "### User:", "</turn>", "</", "turn>", " ", "x", "\n"]), max_size=12).map("".join))
def test_escape_is_reversible_and_inert(text):
    t = chat_format.Template()
    inert = t.escape(text)
    assert t.unescape(inert) == text
    assert not any(c in inert for c in t.controls())


def test_chat_edge_cases(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (2, 0, None, None), (2, None, "system", "s"), (None, 0, "user", "é" * 3), (None, 1, "assistant", "ü")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, loss int")
    got = {r["conv_id"]: r for r in chat_format.digest_segments(chat_format.format_turns(df)).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["violations"] == 1 and got[1]["loss_chars"] == 1
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\na\nuser\na\nassistant\nb\n").hexdigest()
    assert got[2]["turns_sha256"] == hashlib.sha256(b"system\ns\n\n\n").hexdigest() and got[2]["violations"] == 1
    assert got[None]["loss_sha256"] == hashlib.sha256("ü".encode()).hexdigest()
    assert chat_format.digest_segments(chat_format.format_turns(df.limit(0))).count() == 0


def test_chat_long_texts_and_clashing_columns(spark):
    long = "### Assistant: \\ é" * 20_000
    rows = [(k, t, r, x) for k in (1, 2) for t, r, x in ((0, "user", "q"), (1, "assistant", long))]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "conv_id long, turn long, role string, text string, `turn_no` int, `a.b` string")
    segments = chat_format.format_turns(df)
    got = [chat_format.digest_segments(segments, in_order).orderBy("conv_id").collect() for in_order in (False, True)]
    assert got[0] == got[1] and len(got[0]) == 2
    for r in got[0]:
        assert r["loss_chars"] == len(long) and r["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest()


def test_bad_template():
    with pytest.raises(ValueError):
        chat_format.Template(close_mark="\\end")


# Sentence pieces

TEXTS = ["", " ", "  two  spaces ", "▁ mark ▁▁", "a\x00b\n\tc", "naïve Straße 北京 🙂🙂", "x" * 5000, "un believ able " * 300, "　\xa0 wide", "tail ", "<s> </s> <unk> <0x41>"]


@pytest.mark.parametrize("text", TEXTS)
def test_chunks_encode_like_the_library(text):
    c = sentence_pieces.ChunkCodec(piece_model())
    assert c.by_chunk
    assert c.encode(text) == c.sp.encode(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text_encodes_like_the_library(text):
    c = sentence_pieces.codec(piece_model())
    ids = c.encode(text)
    assert ids == c.sp.encode(text) and c.decode(ids) == c.sp.decode(ids)


def test_pieces_in_spark(spark, docs, small):
    c = sentence_pieces.codec(piece_model())
    df = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").unionByName(docs([(-1, None), (-1, None), (-2, "")]).select("doc_id", "text"))
    want = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    got = sentence_pieces.digest_encoding(sentence_pieces.encode_documents(df, piece_model())).collect()
    assert len(got) == df.count()
    for r in got:
        ids = c.sp.encode(want[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(c.sp.decode(ids).encode() if ids else b"").hexdigest()


def test_pieces_of_odd_tables(spark, docs):
    from pyspark.sql import functions as F

    assert sentence_pieces.digest_encoding(sentence_pieces.encode_documents(docs([]), piece_model())).count() == 0
    odd = docs([(1, "a b"), (1, "a b"), (None, None)]).withColumn("ids", F.lit("x")).withColumn("n_tokens", F.lit(1)).withColumn("a.b", F.lit(1))
    got = sentence_pieces.digest_encoding(sentence_pieces.encode_documents(odd, piece_model())).collect()
    want = len(sentence_pieces.codec(piece_model()).sp.encode("a b"))
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(0, 0), (1, want), (1, want)]


# WARC


def test_bundle_is_seekable_and_plain_zstd():
    w = warc.BundleWriter()
    records = {warc.record_id(k): warc.make_record(k, f"http://x/{k}", b"payload %d " % k * 20_000, None, False, "1970-01-01T00:00:00Z") for k in range(5)}
    for name, record in records.items():
        w.add(name, record)
    archive = w.finish()
    assert len(warc.seek_table(archive)) > 1
    for entry in w.entries[::-1]:
        fields, block = warc.read_record(archive, entry)
        assert fields["WARC-Record-ID"] == entry["record_id"] and block in records[entry["record_id"]]
    assert zstandard.ZstdDecompressor().stream_reader(archive, read_across_frames=True).read() == b"".join(records.values())


def test_warc_edge_cases(spark, tmp_path):
    rows = [(1, "u", "same"), (2, "u\r\nWARC-Type: evil", "same"), (9, None, "same"), (9, None, "same"), (3, "u", None), (4, "u", ""), (None, "u", "same"), (5, "u", "€" * 100_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    bundles = warc.write_archives(pages)
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_archives(bundles.df).collect())
    assert got == [(0, 4, "revisit", 9), (1, 4, "revisit", 9), (2, 4, "revisit", 9), (3, 0, "revisit", 4), (4, 0, "response", None), (5, 300_000, "response", None), (9, 4, "response", None), (9, 4, "response", None)]
    kinds = {r["record_type"] for r in warc.read_archives(warc.write_archives(pages, min_bytes=5).df).collect()}
    assert kinds == {"response"}
    paths = [r["path"] for r in warc.export(bundles.df, f"file://{tmp_path}/out").collect()]
    assert paths and all(zstandard.ZstdDecompressor().stream_reader(open(p, "rb"), read_across_frames=True).read().startswith(b"WARC/1.1") for p in paths)
    assert warc.read_archives(warc.write_archives(pages.limit(0)).df).count() == 0

"""Archives, token shards, byte-pair encoding, HTML text, top-k search, mixing and the pipeline."""

import gzip
import math
import os
import random
import re
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gridterrain.llm.bpe import Bpe, add_encoding, decode_ids
from gridterrain.llm.html import extract_text, page_text
from gridterrain.llm.mixing import mix_sources, poisson_count, source_counts, tempered_weights
from gridterrain.llm.queries import ORACLES, QUERIES
from gridterrain.llm.shards import Library, find_token, read_shards, write_shards
from gridterrain.llm.topk import _top, quantised, top_inner_products
from gridterrain.llm.warc import list_archives, plan_records, read_warc, write_warc
from gridterrain.llm.wavelet import Wavelet, build
from gridterrain.scratch import scratch_path

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def odd_texts(n=300):
    rnd = random.Random(4)
    pieces = [*"ab  \n\t'sreé1²,.!?-_日本\x1c\x85 　", "<|endoftext|>", "'ll", "   ", "aaaa", " word", " é1 ", "\n\n", "👍🏽"]
    return ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


def test_encodings_equal_the_library():
    library, own, table = Tokenizer.from_file(VOCABULARY), Bpe(VOCABULARY), Library(VOCABULARY)
    texts = [*odd_texts(), "x" * 3000, "aé" * 500 + " end", ""]
    runs = table.encode(texts)
    for text, packed in zip(texts, runs, strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids
        assert np.frombuffer(packed, table.kind).tolist() == ids
        assert own.decode(own.encode(text)) == library.decode(ids, skip_special_tokens=False) == text


def test_encoding_corner_cases(spark):
    rows = spark.createDataFrame([(1, None, "old", 3), (1, "", "old", 3), (None, "a b", "old", 3)], "doc_id long, text string, ids string, n int")
    coded = add_encoding(rows, VOCABULARY, decoded="decoded")
    assert sorted((len(r["ids"]), r["decoded"], r["n"]) for r in coded.collect()) == [(0, "", 3), (0, "", 3), (8, "a b", 3)]
    assert sorted(r["again"] for r in decode_ids(coded, VOCABULARY, decoded="again").collect()) == ["", "", "a b"]
    assert add_encoding(rows.limit(0), VOCABULARY).collect() == []


def test_wavelet_answers_equal_a_list():
    rnd = random.Random(5)
    for values in ([], [7], [5] * 700, [rnd.choice([2, 3, 90, 50000]) for _ in range(2000)], [0, 2**31]):
        data = build(np.array(values, "<u4"), {"t": np.arange(3)})
        wave = Wavelet(lambda at, n, data=data: data[at : at + n])
        assert wave.values().tolist() == values
        assert wave.table("t").tolist() == [0, 1, 2]
        for value in {*values, 4}:
            places = [i for i, v in enumerate(values) if v == value]
            assert wave.count(value) == len(places)
            assert wave.count(value, len(values) // 2) == sum(p < len(values) // 2 for p in places)
            assert [wave.select(value, k) for k in range(0, len(places), 97)] == places[::97]
        assert all(wave.access(i) == values[i] for i in range(0, len(values), 131))


def test_shards_round_trip(spark):
    texts = [*odd_texts(80), None, ""]
    rows = spark.createDataFrame([(3 * i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, start int").repartition(3)
    manifest = write_shards(rows, scratch_path(spark, "test"), VOCABULARY, 2, shard_tokens=100)
    assert manifest.count() > 3
    library, start, everything = Tokenizer.from_file(VOCABULARY), 0, []
    got = {r["doc_id"]: (r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in read_shards(manifest).collect()}
    for i, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert got[3 * i] == (start, ids)
        start, everything = start + len(ids), everything + ids
    found = find_token(manifest, 2).agg(F.sum("count"), F.min("first")).first()
    assert tuple(found) == (len(texts), everything.index(2))


def test_shards_corner_cases(spark):
    rows = spark.createDataFrame([(None, "b"), (4, "a"), (4, "a")], "doc_id long, text string")
    manifest = write_shards(rows, scratch_path(spark, "test"), VOCABULARY, 2)
    assert sorted((r["doc_id"] or 0, r["start"], len(r["ids"])) for r in read_shards(manifest).collect()) == [(0, 0, 8), (4, 2, 8), (4, 4, 8)]
    empty = write_shards(rows.limit(0), scratch_path(spark, "test"), VOCABULARY, 2)
    assert read_shards(empty).collect() == [] and find_token(empty, 2).collect() == []


PAGES = "page_id long, url string, html string, digest string"


@pytest.mark.parametrize(("split", "size"), [(7, 200), (100_000, 1 << 20)])
def test_archives_round_trip(spark, split, size):
    rnd = random.Random(6)
    texts = [rnd.choice(["", "é same", "x" * 3000, str(rnd.random()), gzip.compress(b"WARC/1.1\r\nno").decode("latin-1")]) for _ in range(40)]
    rows = spark.createDataFrame([(i, f"http://u/{i}\r\nX: y", t, "d") for i, t in enumerate(texts)], PAGES).repartition(2)
    folder = scratch_path(spark, "test")
    write_warc(plan_records(rows, "page_id", "url", "html", min_bytes=1), folder, archive_bytes=size)
    got = {r["id"]: r for r in read_warc(list_archives(spark, folder), split).collect()}
    assert sorted(got) == list(range(40))
    last = {t: i for i, t in enumerate(texts)}
    for i, text in enumerate(texts):
        revisit = len(text) > 0 and last[text] != i
        assert (got[i]["type"], got[i]["refers_to"]) == (("revisit", last[text]) if revisit else ("response", None))
        assert got[i]["payload"] == (None if revisit else text.encode())
        assert got[i]["payload_length"] == len(text.encode()) and got[i]["uri"] == f"http://u/{i}%0D%0AX: y"


def test_broken_members_are_passed_over(spark, tmp_path):
    rows = spark.createDataFrame([(i, None, f"page {i}", "") for i in range(3)], PAGES).coalesce(1)
    written = write_warc(plan_records(rows, "page_id", "url", "html"), str(tmp_path / "a")).collect()
    data = b"".join(open(r["path"], "rb").read() for r in written)
    spoilt = b"\x1f\x8b\x08junk" + gzip.compress(b"no archive") + data + data[:40]
    os.makedirs(tmp_path / "b")
    (tmp_path / "b" / "x.warc.gz").write_bytes(spoilt)
    assert sorted(r["id"] for r in read_warc(list_archives(spark, str(tmp_path / "b")), 16).collect()) == [0, 1, 2]


def test_archives_corner_cases(spark):
    rows = spark.createDataFrame([(None, None, None, ""), (2, "u", None, ""), (2, "u", None, ""), (1, "u", "", "")], PAGES)
    got = read_warc(write_warc(plan_records(rows, "page_id", "url", "html"), scratch_path(spark, "test"))).collect()
    assert sorted((r["id"] or 0, r["type"], r["refers_to"], r["payload_length"]) for r in got) == [(0, "revisit", 2, 0), (1, "revisit", 2, 0), (2, "response", None, 0), (2, "response", None, 0)]
    assert read_warc(write_warc(plan_records(rows.limit(0), "page_id", "url", "html"), scratch_path(spark, "test"))).collect() == []


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain  text\n here", "plain text here"),
        ("<p>one<p>two &amp; <b>b</b>old<div>x</div>y", "one\n\ntwo & bold\n\nx\ny"),
        ("<head><title>T</title><style>a</style><script>b</script></head><body>c<noscript>d</noscript>", "T\nc"),
        ("a<span hidden>b</span><i aria-hidden=true>c</i><u style='color:red; display : none'>d</u><s style='visibility:hidden'>e</s>f", "af"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>", "* a\n* b\n  3. x\n  4. y\n* c"),
        ("<table><caption>cap</caption><tr><td>k<td>v<tr><th>longer<td>2</table>", "cap\nk       v\nlonger  2"),
        ("<table><tr><td>a<table><tr><td>in<td>ner</table><td>z</table>", "a\n\nin  ner\n\nz"),
        ("a<br>b<hr>c<pre>\n x\n\n  y\n</pre>d", "a\nb\n---\nc\n\n x\n\n  y\n\nd"),
        ("<details><summary>s</summary>no</details><details open><summary>s</summary>yes</details>", "s\ns\nyes"),
        ("<div>" * 3000 + "deep" + "</p></b>" + "&lt;t&gt;<!-- c --><img alt=pic>", "deep<t>pic"),
    ],
)
def test_pages_are_laid_out(html, text):
    assert page_text(html) == text


def test_every_visible_word_is_emitted(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("text", F.lit(1))
    for row in extract_text(pages).limit(40).collect():
        import re

        bare = re.sub(r"(?s)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ", row["html"])
        import html

        want = html.unescape(bare).split()
        assert "".join(want) == "".join(w for w in re.sub(r"(?m)^ *(\*|\d+\.) ", "", row["text"]).split())


@pytest.mark.parametrize(
    ("html", "words"),
    [
        ("<table><tr><td><p>one</p><p>two</p><td><div>a</div>b<h1>c</h1>d</table>", "one two a b c d"),
        ("<table><tr><td><dl><dt>t<dd>d</dl><td><img alt=pic> x<br>y<td><details><summary>s</summary>no</details></table>", "t d pic x y s"),
        ("<table>a<tr><td>x</td></tr>b<tr><td>y</table>", "a b x y"),
        ("<pre>a<img alt=pic>b<div>c</div>d<table><tr><td>e<td>f</table></pre>", "apicb c d e f"),
        ("<p>Pick <select><option>one<option selected>two<optgroup label=more><option>three</select> now <textarea>x &amp; <b>\ny</textarea>z", "Pick one two more three now x & <b> y z"),
        ("<textarea>open <i>", "open <i>"),
        ("<p>a <svg><title>no</title><defs><text>no</text></defs><text>b</text><text>c</text></svg> d", "a b c d"),
        ("<math><semantics><mfrac><mn>1</mn><mn>2</mn></mfrac><mo>=</mo><mi>x</mi><annotation>no</annotation></semantics></math>", "1 2 =x"),
        ("<map><p>in<area></map>", "in"),
    ],
)
def test_words_of_cells_forms_drawings_and_formulas(html, words):
    assert page_text(html).split() == words.split()


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("a<![foo[x]]>b", "ab"),
        ("<![ endif]>c<![if !IE]>d<![endif]>e<![", "cde"),
        ("f<![CDATA[x]]>g<svg><text><![CDATA[h>i]]></text></svg>", "fg\nh>i"),
        ("<table><tr><td colspan='²'>a<td colspan=" + "9" * 5000 + ">b<td colspan='٣'>c</table>", "a  b" + "  " * 100 + "c"),
        ("x&#" + "9" * 5000 + ";y&#" + "0" * 5000 + "65;<ol start='²'><li>z</ol>", "x\ufffdyA\n\n1. z"),
    ],
)
def test_odd_pages_do_not_end_the_job(spark, html, text):
    assert page_text(html) == text
    pages = spark.createDataFrame([(1, html), (2, "other")], "page_id long, html string")
    assert {r["page_id"]: r["text"] for r in extract_text(pages).collect()} == {1: text, 2: "other"}


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("a<b x " * 3, "a"), ("a <b>c</b><!-- d> e", "a c"), ("a</b c", "a"), ("a<? b", "a"), ("a<!b c", "a"),
        ("a < b<p>c", "a < b\n\nc"), ("<p>a<button><div>b<div>c</button><p>d", "a\nb\nc\n\nd"),
        ("<i><table><tr><td>a</i>b</table>c</i>d", "ab\n\ncd"),
    ],
)
def test_unclosed_tags_and_comments(html, text):
    assert page_text(html) == text


@pytest.mark.parametrize("part", ["<a ", "<a/", "x <a", "<!--", "<!-- x>", "</a ", "<?", "<!x ", "<![ ", "<p><button><div>", "<x><table><td><div></x>", "<a b='>\""])
def test_time_grows_with_the_page(part):
    start = time.monotonic()
    page_text(part * 50_000)
    assert time.monotonic() - start < 10


@pytest.mark.parametrize(
    "html",
    [
        "<table><tr><td>" + "a" * 20_000 + "<td>x" + "<tr><td>b<td>c" * 2_000,
        "<table>" + "<tr><td colspan=100>x<td>y" * 5_000,
        "<table>" + "".join(f"<tr>{'<td>' * i}{'w' * 90}" for i in range(300)),
    ],
)
def test_tables_stay_in_proportion_to_the_page(html):
    text = page_text(html)
    assert len(text) < 30 * len(html)
    assert text.split() == " ".join(re.split(r"<[^>]*>", html)).split()


def test_long_cells_run_over():
    long = "w" * 100
    assert page_text(f"<table><tr><td>{long}<td>x<tr><td>a<td>b</table>") == f"{long}  x\na{' ' * 81}b"


def test_word_lists_of_all_pages(spark, sf_dir):
    import html
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = extract_text(pages.withColumn("text", F.lit(1))).collect()
    assert len(rows) == pages.count()
    for row in rows:
        bare = re.sub(r"(?s)<(script|style)\b.*?</\1>|<!--.*?-->", "", row["html"] or "")
        want = html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?[ab]\b[^>]*>", "", bare))).split()
        assert want == re.sub(r"(?m)^ *(\*|\d+\.) ", "", row["text"]).split()


def brute_top(rows, k):
    vectors = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in vectors:
        if q % 5 == 0:
            scores = sorted((-sum(a * b for a, b in zip(vectors[q], v, strict=False)), i) for i, v in vectors.items() if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("slices", [1, 2, 3])
def test_top_products_equal_brute_force(spark, slices):
    rnd = random.Random(7)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(7)]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(30)] + [(300, None), (301, [None] * 7), (302, [math.inf] * 7), (303, [math.nan] * 7), (None, rows[0][1]), (305, [1.0, 2.0]), (310, [])]
    vectors = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<double>, rank int, query int")
    found = top_inner_products(vectors.withColumn("embedding", quantised(F.col("embedding"))), F.col("vec_id") % 5 == 0, 4, slices=slices, block_rows=20, query_rows=8)
    assert sorted(map(tuple, found.collect())) == brute_top(rows, 4)


def test_top_products_corner_cases(spark):
    schema = "vec_id long, embedding array<bigint>"
    top = lambda rows: sorted(map(tuple, top_inner_products(spark.createDataFrame(rows, schema), F.col("vec_id") % 5 == 0, 2).collect()))
    assert top([]) == top([(5, [1])]) == top([(1, [1]), (2, [1])]) == top([(5, None), (6, None)]) == []
    assert top([(5, [1]), (5, [1]), (6, [2])]) == [(5, 1, 6, 2)]
    big = 2**30
    assert top([(5, [big, big]), (6, [big, -1]), (7, [1, 1])]) == [(5, 1, 6, big * big - big), (5, 2, 7, 2 * big)]


def test_repeated_ids_keep_all_their_vectors(spark):
    rnd = random.Random(8)
    rows = [(i % 20, [rnd.randint(-3, 3) for _ in range(3)]) for i in range(90)]
    rows += [*rows[:9], *((7, rows[i][1]) for i in range(20)), *((5, [9, 9, i]) for i in range(12))]
    distinct = sorted({(i, tuple(v)) for i, v in rows})
    want = []
    for q in range(0, 20, 5):
        scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), j) for i, a in distinct if i == q for j, b in distinct if j != q)
        want += [(q, n + 1, j, -s) for n, (s, j) in enumerate(scores[:4])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<bigint>")
    found = top_inner_products(vectors, F.col("vec_id") % 5 == 0, 4, block_rows=20, query_rows=8)
    assert sorted(map(tuple, found.collect())) == want


def test_top_products_copy_no_matrix_for_pairs_of_blocks(spark):
    """Blocks of queries by blocks of rows are more than the driver may be sent; the blocks alone are not."""
    values = np.random.default_rng(9).integers(-20000, 20000, (3000, 64))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "vec_id long, embedding array<bigint>")
    conf = spark.sparkContext._jsc.sc().conf()
    conf.set("spark.driver.maxResultSize", "2m")
    try:
        found = top_inner_products(vectors, F.col("vec_id") % 5 == 0, 3, block_rows=50, query_rows=200).collect()
    finally:
        conf.remove("spark.driver.maxResultSize")
    scores = values[::5] @ values.T
    scores[np.arange(600), np.arange(0, 3000, 5)] = -(2**60)
    order = np.argsort(-scores, axis=1, kind="stable")[:, :3]
    assert sorted(map(tuple, found)) == [(5 * q, n + 1, i, scores[q, i]) for q, best in enumerate(order.tolist()) for n, i in enumerate(best)]


@pytest.mark.parametrize("rows, kept", [(300, 4), (300, 40), (130, 1), (64, 64), (5, 9)])
def test_top_places_hold_the_greatest_numbers(rows, kept):
    parts = np.random.default_rng(rows).integers(-9, 9, (7, rows))
    found = np.take_along_axis(parts, _top(parts, kept), 1)
    assert np.array_equal(np.sort(found, axis=1), np.sort(parts, axis=1)[:, -kept:])


def test_poisson_counts_invert_the_distribution(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, None).otherwise("s").alias("source"), F.lit("t").alias("copy"))
    weights = spark.createDataFrame([(None, 3.0), ("s", 1.0), ("unknown", 9.0)], "source string, weight double")
    mixed = mix_sources(docs, weights, total=8000).collect()
    rate = {None: 8000 * 0.75 / 400, "s": 8000 * 0.25 / 3600}
    for source, n in ((None, 400), ("s", 3600)):
        rows = [r for r in mixed if r["source"] == source]
        assert abs(len(rows) - rate[source] * n) < 5 * math.sqrt(rate[source] * n)
        assert len({(r["doc_id"], r["copy"]) for r in rows}) == len(rows)
    keys = [r["shuffle_key"] for r in mixed]
    assert keys == sorted(keys) and [r["doc_id"] for r in mixed] != sorted(r["doc_id"] for r in mixed)
    at = spark.sql("SELECT array(0.5, 0.8, 1.0) AS steps, explode(array(0.0, 0.49, 0.5, 0.79, 0.8, 0.99)) AS u")
    assert [r[0] for r in at.select(poisson_count(F.col("u"), F.col("steps"))).collect()] == [0, 0, 1, 1, 2, 2]


def test_mixing_corner_cases(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (2, None)], "doc_id long, source string")
    weights = tempered_weights(source_counts(docs), 0.5)
    counts = mix_sources(docs, weights, total=40).groupBy("doc_id").count().collect()
    assert all(r["count"] > 0 for r in counts)
    assert mix_sources(docs.limit(0), weights).collect() == []
    assert mix_sources(docs, weights.limit(0)).collect() == []
    hot = spark.createDataFrame([(i, "a") for i in range(50)], "doc_id long, source string")
    assert abs(mix_sources(hot, spark.createDataFrame([("a", 1.0)], "source string, weight double"), total=50_000.0).count() - 50_000) < 2000


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{file}')")
    ours, theirs = QUERIES[name](spark, sf_dir).toArrow(), con.execute(ORACLES[name]).to_arrow_table()
    assert {f.name: str(f.type) for f in ours.schema} == {f.name: str(f.type) for f in theirs.schema}
    columns = sorted(ours.column_names)
    assert sorted(repr([r[c] for c in columns]) for r in ours.to_pylist()) == sorted(repr([r[c] for c in columns]) for r in theirs.to_pylist())


def test_contract_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    library = Tokenizer.from_file(VOCABULARY)
    coded = {r["doc_id"]: [*library.encode(r["text"] or "", add_special_tokens=False).ids] for r in docs}
    for r in QUERIES["op10_token_shards"](spark, sf_dir).collect():
        ids = [*coded[r["doc_id"]], 2]
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert r["start"] == sum(len(coded[i]) + 1 for i in coded if i < r["doc_id"])
    import hashlib

    for r in QUERIES["op6_bpe"](spark, sf_dir).collect():
        ids = coded[r["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    texts = {r["doc_id"]: r["text"] for r in docs}
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in QUERIES["op6_bpe"](spark, sf_dir).collect())


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, None, "s", 0), (9002, "12 !", "en", None, 4)], docs.schema)
    before = docs.unionByName(extra)
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.cut(stage(spark, before, sf_dir), name)
        if name != "bpe_encode":
            assert after.columns == docs.columns
        if name == "language_id":
            assert {r[0] for r in before.select("doc_id").collect()} - {r[0] for r in after.select("doc_id").collect()} == {9001, 9002}
        if name == "near_copies":
            from gridterrain.llm.jaccard import jaccard_classes

            assert after.count() == jaccard_classes(before).select("class_id").distinct().count()
            assert jaccard_classes(after).agg(F.sum("n_links")).first()[0] == 0
        if name == "substring_dedup":
            assert after.count() == before.count()
            from gridterrain.llm.substrings import remove_repeats

            changed = {r["doc_id"] for r in remove_repeats(before).filter("n_removed > 0").collect()}
            was = {r["doc_id"]: r["text"] for r in before.collect()}
            assert {r["doc_id"] for r in after.collect() if r["text"] != was[r["doc_id"]]} == changed
        before = after
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in before.collect())
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_stages_take_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, sf_dir), "empty")
        assert docs.count() == 0

"""Operators over whole tables: archives, pages, near-duplicates, benchmark items, the pipeline."""

import base64
import hashlib
import io
import random
import struct

import duckdb
import pytest
import zstandard

import corpus_pipeline
from gridwarden.llm import decontaminate, html, neardup, queries, warc
from gridwarden.llm.graph import components
from tests.llm import brute

SF = "/root/testdata/sf0.001"


# --- archives ---


def test_archives_round_trip(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = queries.op1_warc(spark, SF).collect()
    assert sorted(r["page_id"] for r in out) == sorted(pages)
    for r in out:
        payload = (pages[r["page_id"]]["html"] or "").encode()
        assert r["payload_bytes"] == len(payload) and r["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_equal_payloads_are_revisits(spark, tmp_path):
    rows = [(1, "http://a b/é", "<p>x</p>"), (2, "u", "<p>x</p>"), (5, None, None), (7, "v", ""), (None, "w", "<p>x</p>"), (8, "z\r\nEvil: 1", "é" * 100_000), (9, "z", "only")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload_digest string")
    out = {r["page_id"]: r for r in warc.warc_round_trip(df, with_payload=True).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in out.items()} == {1: ("revisit", 2), 2: ("response", None), 5: ("revisit", 7), 7: ("response", None), None: ("revisit", 2), 8: ("response", None), 9: ("response", None)}
    assert out[1]["url"] == "http://a b/é" and out[8]["url"] == "z\r\nEvil: 1" and out[5]["url"] is None
    assert bytes(out[8]["payload"]).decode() == "é" * 100_000 and out[5]["payload_bytes"] == 0
    assert warc.warc_round_trip(df.limit(0)).collect() == []
    unmerged = warc.read_archives(warc.write_archives(warc.mark_revisits(df, least_bytes=5), folder := f"file://{tmp_path}"), folder)
    assert {r["page_id"]: r["record_type"] for r in unmerged.collect()}[5] == "response"


def archive(records, dictionary=b"WARC/1.1 response html", packed=True):
    content = zstandard.ZstdCompressor().compress(dictionary) if packed else dictionary
    frames = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).compress(r) for r in records]
    return struct.pack("<II", warc.SKIPPABLE_MAGIC, len(content)) + content + b"".join(frames)


@pytest.mark.parametrize("packed", [True, False])
def test_dictionary_comes_from_the_leading_frame(packed):
    records = [warc.build_record(i, "u", b"x" * i * 1000, None, False) for i in range(300)]
    assert list(warc.read_records(io.BytesIO(archive(records, packed=packed)))) == records


def test_damage_is_found():
    good = warc.build_record(1, "u", b"payload", None, False)
    assert warc.parse_record(good)["payload"] == b"payload"
    for bad in (good[:-1], good + b"x", good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"payload\r\n", b"Payload\r\n"), good.replace(b"WARC-Date", b"X-Date"), good.replace(b"Content-Length: 7", b"Content-Length: 8")):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(archive([good])[:-3])))


# --- pages ---


def test_pages_of_the_table(spark):
    import re

    def plain(page):
        body = page[page.find("<article>") + 9 :]
        body = body[: body.find("</article>")] if "</article>" in body else body
        blocks = [" ".join(html.unescape(b.replace("<br>", " ").replace("<b>", "").replace("</b>", "")).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        return "\n".join(b for b in blocks if b)

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op6_html(spark, SF).collect():
        assert r["text"] == plain(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


PAGE = '<html><head><title>t</title><style>p{{}}</style></head><body><div class="site-header">Site</div><div><p>Always the same words</p></div><div id="c"><h1>Title {0}</h1><p>Body&nbsp;{0} a&lt;b<br>next</div><div class="cookie-notice">ok?</div><div id="comments"><p>nice</p></div><form>f</form><script>var x="<p>no</p>"</script></body></html>'


def test_templates_are_removed_without_article_marks(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(i)) for i in range(12)] + [(90, None, None), (91, "odd", ""), (92, "http://other.example/", PAGE.format(7))]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    out = {r["page_id"]: r["text"] for r in html.extract_main_text(df).collect()}
    assert out[3] == "Title 3\nBody 3 a<b next"
    assert out[90] == out[91] == ""
    assert out[92] == "Always the same words\nTitle 7\nBody 7 a<b next"  # one page is no template
    assert html.extract_main_text(df.limit(0)).collect() == []


def test_copies_of_an_article_are_no_template(spark):
    page = "<body><nav>m</nav><article><h1>T</h1><p>One<p>Two <b>x</b></article><footer>f</footer>"
    df = spark.createDataFrame([(i, "http://h/", page) for i in range(20)], "page_id long, url string, html string")
    assert {r["text"] for r in html.extract_main_text(df).collect()} == {"T\nOne\nTwo x"}


BOX = "<body><article><h1>T {0}</h1><p>Body of number {0}</p><p>Yes.</p><div><h3>Read also</h3><ul><li>The same three</li></ul></div><p>End of {0}</p></article>"


def test_boxes_inside_articles_are_templates(spark):
    rows = [(i, "http://h/", BOX.format(i)) for i in range(8)] + [(90 + i, "http://other/", BOX.format(i)) for i in range(2)]
    rows += [(50 + i, "http://copies/", BOX.format(1)) for i in range(20)]  # one article, however many copies
    words = " ".join(f"word{i}" for i in range(60))
    near = "<main><div><p>First part of {1}</p></div><div><p>Kept in all</p></div><p>" + words + " {0}</p></main>"
    rows += [(100 + i, "http://near/", near.format(i, i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r["page_id"]: r["text"] for r in html.extract_main_text(df).collect()}
    assert out[3] == "T 3\nBody of number 3\nYes.\nEnd of 3"
    assert out[91] == "T 1\nBody of number 1\nYes.\nRead also\nThe same three\nEnd of 1"
    assert out[60] == out[91]
    assert out[107] == f"First part of 1\nKept in all\n{words} 7"


def test_rare_templates_of_large_hosts_are_found(spark):
    page = "<body><div><h1>T {0}</h1><p>Body of number {0}</p></div><div>{1}</div>"
    rows = [(i, "http://h/", page.format(i, "Now in section B" if i < 5 else f"Own {i}")) for i in range(400)]
    df = spark.createDataFrame([*rows, rows[0], (900, "http://h/", None)], "page_id long, url string, html string")
    out = [tuple(r) for r in html.extract_main_text(df).select("page_id", "text").collect()]
    assert out.count((0, "T 0\nBody of number 0")) == 2 and (4, "T 4\nBody of number 4") in out and (900, "") in out
    assert (399, "T 399\nBody of number 399\nOwn 399") in out and len(out) == 402


def test_names_inside_articles_lose_no_text():
    text = '<h2 id="related-work">Related</h2><h3 class="social">S</h3><p id="notice" class="share">P</p><section id="notices-of-1848"><p>N</p></section><div class="social-history">H</div><div id="menu">M</div>'
    boilerplate = '<div class="share-buttons">x</div><div class="body sharing">x</div><ul class="related posts"><li>x</ul><nav>x</nav>'
    for tag in ("article", "main"):
        assert html.main_text(f"<body><div class='menu'>x</div><{tag}>{text}{boilerplate}</{tag}>") == "Related\nS\nP\nN\nH\nM"
    assert html.main_text('<h2 id="related-work">Related</h2><section id="notices-of-1848">N</section><section id="comments">x</section><div id="site-menu">x</div>') == "Related\nN"


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "x", '<a "' * 50_000, "<" * 100_000, "<p>" * 20_000 + "x", "<article>" * 5_000 + "x", "<!-- " * 20_000])
def test_odd_markup_takes_linear_time(page):
    import time

    began = time.time()
    html.main_text(page)
    html.template_candidates(page)
    assert time.time() - began < 10


# --- near-duplicates ---


def check_components(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_shingles int")
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df, **options).collect()}
    want = brute.components(rows, **options)
    assert out == {d: (*x, d == x[1]) for d, x in want.items()}
    return want


def test_small_texts(spark):
    check_components(spark, list(enumerate(["", None, "a", "A", "a b", "b a", "a b", "   ", "A B c"])))


def edited(r, base, vocabulary, edits):
    out = list(base)
    for _ in range(edits):
        out[r.randrange(len(out))] = r.choice(vocabulary)
    return out


def test_a_group_with_links_beyond_its_pivot(spark):
    """Copies with few to many edits, and families with a passage of their own: only a part links with any one pivot."""
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [r.choice(vocabulary) for _ in range(150)]
    rows = [(1000 + i, " ".join(edited(r, base, vocabulary, r.randrange(22))[: 110 + i % 40 if i % 7 == 0 else 150])) for i in range(120)]
    for i in range(60):
        copy = edited(r, base, vocabulary, 8)
        copy[20:45] = [f"own{k + 100 * (i % 3)}" for k in range(25)]
        rows.append((2000 + i, " ".join(copy)))
    want = check_components(spark, rows)
    assert 1 < len({c for _, c in want.values()}) < len(rows)


def test_documents_of_the_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op7_neardup(spark, "/root/testdata/sf0.01").collect()}
    assert out == brute.components(rows)


def test_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (1, "q r s t"), (0, "q r s t")], "doc_id long, text string")
    out = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect()), key=str)
    assert out == [(0, 0, True), (1, 0, False), (1, 0, False), (1, 0, False), (None, None, True)]
    assert neardup.near_duplicates(df.limit(0)).collect() == []


def test_posterior_bounds():
    least = neardup.fewest_matches(0.8, 1e-6)
    assert len(least) == 4 and all(a < b for a, b in zip(least, least[1:], strict=False))
    assert 0.4 * 128 < least[-1] < 0.8 * 128


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    out = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(out.values()) == {0, 100} and out[50] == 0 and out[159] == 100 and len(out) == 111


# --- benchmark items ---


def test_items_in_documents(spark):
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(r.choice([5, 9, 14, 30, 59, 200])))) for i in range(40)] + [(50, "tiny item"), (51, None), (52, " "), (53, "one two three four five")]
    docs = []
    for i in range(200):
        body = text(r.choice([3, 50, 800, 3000]))
        chosen = items[r.randrange(40)][1].split()
        if i % 2:
            at = r.randrange(len(body))
            if i % 3 == 0:
                chosen[r.randrange(len(chosen))] = "changed"
            body[at:at] = [w.upper() for w in chosen]
        docs.append((i, " ".join(body)))
    docs += [(900, None), (901, ""), (902, "Tiny  ITEM"), (903, "a tiny item"), (904, "one two three four five six")]
    of_docs = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, shared int")
    of_items = spark.createDataFrame(items, "item_id long, text string")
    out = {tuple(x) for x in decontaminate.contaminated(of_docs, of_items).collect()}
    assert out == brute.leaks(docs, items)
    assert (902, 50, 1, 1) in out and (904, 53, 1, 1) in out
    assert decontaminate.contaminated(of_docs, of_items.limit(0)).collect() == [] == decontaminate.contaminated(of_docs.limit(0), of_items).collect()


def test_items_equal_sql(spark):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert {tuple(r) for r in queries.op8_decontaminate(spark, SF).collect()} == set(db.sql(decontaminate.SQL).fetchall())


# --- pipeline ---


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    names, functions = zip(*corpus_pipeline.STAGES, strict=True)
    assert names == ("language_id", "near_dedup", "decontamination", "pii", "bpe")
    out = []
    for f in functions:
        docs = corpus_pipeline.cut_lineage(f(spark, docs, SF), "test")
        out.append(docs)
    first, near, clean, masked, _ = ({r["doc_id"]: r["text"] for r in x.collect()} if "text" in x.columns else None for x in out)
    assert all(x.columns == ["doc_id", "text", "lang", "source", "n_chars"] for x in out[:4])
    assert len(first) == 200
    assert set(near) == {d for d, (_, c) in brute.components(list(first.items()), size=5).items() if d == c}
    assert set(clean) == set(near) - {d for d, *_ in brute.leaks(near.items(), items)}
    assert set(masked) == set(clean) and all(not brute.personal(t) for t in masked.values())
    assert all(masked[d] == t for d, t in clean.items() if not brute.personal(t))
    assert [r["n_chars"] for r in out[3].collect()] == [len(r["text"]) for r in out[3].collect()]
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()) == sorted(masked)


def test_stages_take_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "the and of 12", "en", "s", 13), (2, None, "en", None, None), (None, "the and a@b.cc", None, "s", 14), (3, "", None, None, 0), (4, "12 34", "en", "s", 5)]
    docs = spark.createDataFrame(rows, schema)
    for name, f in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut_lineage(f(spark, docs, SF), name)
        if "text" in docs.columns:
            assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["1", "None"]
            texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert texts == {1: "the and of 12", None: "the and [EMAIL]"}
    empty = spark.createDataFrame([], schema)
    for name, f in corpus_pipeline.STAGES:
        empty = corpus_pipeline.cut_lineage(f(spark, empty, SF), name)
        assert empty.count() == 0


def test_wrappers_with_names_of_boxes_keep_their_text():
    for page in (
        '<div class="page with-sidebar"><article><p>Hello</p></article></div>',
        '<div class="content no-sidebar"><p>Hello</p></div>',
        '<div id="ad-hoc"><p>Hello</p></div>',
        '<form id="aspnetForm"><main><p>Hello</p></main></form>',
        '<div class="sidebar"><article><p>Hello</p></article></div>',
        '<div>Top</div><form><div><p>Hello there, this is the long text</p></div></form>',
        '<div class="social"><p>Hello</p></div>',
    ):
        assert "Hello" in html.main_text(page), page
    for page in (
        '<article><p>Hello</p></article><div class="main-nav">x</div><div class="left-sidebar"><article>x</article></div><form>x</form>',
        '<p>Hello</p><div class="cookie-notice">x</div><div id="comments"><p>x</p></div><div class="footer-links">x</div>',
        '<p>Hello</p><aside><article>x</article></aside><div class="share-buttons">x</div><form><input>x</form>',
    ):
        assert html.main_text(page) == "Hello", page


def test_deep_open_elements_are_not_walked_again_and_again():
    import time

    start = time.time()
    html.main_text("<b>" * 20_000 + "<dt>a" * 2_000)
    assert time.time() - start < 3


def test_kept_columns_have_any_name(spark):
    df = spark.createDataFrame([(1, "http://h/", "<p>a</p>", ["t"], "own", 5)], "page_id long, url string, html string, _templates array<string>, _host string, _page int")
    row = html.extract_main_text(df, keep=("page_id", "_templates", "_host", "_page")).first()
    assert tuple(row) == (1, ["t"], "own", 5, "a", 1)


def test_repeated_ids_with_other_texts_in_any_order(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, b), (5, a), (3, a + " z"), (9, b + " z"), (7, "else"), (5, None)]
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        df = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect())
        assert got == [(3, 60, 3, True), (5, 0, 5, True), (5, 59, 3, False), (5, 59, 3, False), (7, 1, 7, True), (9, 60, 3, False)]


def test_pipeline_leaves_columns_with_names_of_made_ones(spark):
    text = " ".join(["the quick brown fox jumps over the lazy dog and runs home"] * 5)
    rows = [(i, f"{text} mail bob{i}@example.org", "en", "s", 5, 77.0, "mine", "own") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, masked string")
    for stage in (corpus_pipeline.keep_known_language, corpus_pipeline.mask_personal_data):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and {tuple(r)[5:] for r in out.collect()} == {(77.0, "mine", "own")}

"""Operators that work on each text by itself, against plain versions; nulls, empty and long texts, repeats, clashes."""

import hashlib
import random
import re
import zlib

import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import models

from gridwarden.llm import bpe, language, pii, queries, secrets, tiff, wordpiece
from gridwarden.llm.automaton import Scanner
from tests.llm import brute

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "a", "mail a.b@c.de or a.b@c.de, +1 (974) 555-3436", "4111 1111 1111 1111 and 97.51.17.173", "token = \"0123456789abcdef0123456789abcdef\"", "é" * 50_000 + " x@y.zz", "日本語 text\n\n  end", "7" * 100_000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", i, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", None, 0, "x"), (3, "a", "en", 0, "x"), (3, "a", "en", 0, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens int, spans string")


def rows_of(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()


PER_TEXT = [bpe.bpe_round_trip, secrets.find_secrets, pii.find_personal_data, wordpiece.count_pieces, tiff.tiff_features, language.learn_and_identify]


@pytest.mark.parametrize("operator", PER_TEXT)
def test_every_row_comes_back_once(operator, docs):
    out = operator(docs)
    assert sorted(map(str, (r["doc_id"] for r in out.collect()))) == sorted(map(str, (r["doc_id"] for r in docs.collect())))
    empty = operator(docs.limit(0))
    assert empty.collect() == [] and empty.columns == out.columns


def test_clashing_columns_give_way_to_made_ones(docs):
    out = secrets.find_secrets(docs, keep=("doc_id", "spans", "n_tokens"))
    assert out.columns == ["doc_id", "n_tokens", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    assert "x" not in {r["spans"] for r in out.collect()}


# --- tokens ---


def test_bpe_equals_the_library(spark, real):
    encoding = bpe.load_encoding(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    out = {r["doc_id"]: r for r in queries.op9_bpe(spark, SF).collect()}
    for r in real.itertuples():
        ids = encoding.encode_ordinary(r.text or "")
        assert out[r.doc_id]["n_tokens"] == len(ids)
        assert out[r.doc_id]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert out[r.doc_id]["decoded_sha256"] == hashlib.sha256((r.text or "").encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1'sé日 \n\t!. "), max_size=60), st.integers(1, 9))
def test_safe_parts_give_the_ids_of_the_whole(text, size):
    encoding = bpe.load_encoding(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    assert "".join(bpe.safe_parts(text, size)) == text
    assert bpe.encode(encoding, text, size) == encoding.encode_ordinary(text)


def test_ids_and_raw_bytes_round_trip(docs):
    back = {(r["doc_id"], bytes(r["decoded"]).decode()) for r in bpe.bpe_decode(bpe.bpe_encode(docs)).collect()}
    assert back == {(r["doc_id"], r["text"] or "") for r in docs.collect()}


def test_word_pieces_equal_the_greedy_rule(real):
    initial, continuing = wordpiece.load_pieces(public_tokenizers.path(wordpiece.VOCABULARY))
    vocabulary = {p: i for i, p in enumerate(dict.fromkeys([*initial, *["##" + p for p in continuing], "[UNK]"]))}
    greedy = models.WordPiece(vocabulary, unk_token="[UNK]", max_input_chars_per_word=10**6)
    matcher = wordpiece.load_matcher(public_tokenizers.path(wordpiece.VOCABULARY))
    for word in {w for t in real.text.dropna()[:60] for w in t.split()} | {"日本語a", "a日", "Ωx", "x" * 500}:
        pieces = [t.value for t in greedy.tokenize(word)]
        assert matcher.count(word) == (0 if pieces == ["[UNK]"] else len(pieces))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=4), max_size=6), st.lists(st.text("abc", min_size=1, max_size=4), max_size=6), st.text("abcd", min_size=1, max_size=12))
def test_matcher_on_small_vocabularies(initial, continuing, word):
    def greedy():
        at, n = 0, 0
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if word[at:e] in (initial if at == 0 else continuing)), None)
            if end is None:
                return 0
            at, n = end, n + 1
        return n

    assert wordpiece.Matcher(initial, continuing).count(word) == greedy()


# --- personal data ---


def test_base_spans_equal_the_patterns(spark, real):
    out = {r["doc_id"]: r for r in queries.op3_pii(spark, SF).collect()}
    for r in real.itertuples():
        spans = brute.personal(r.text)
        assert out[r.doc_id]["base_sha256"] == brute.digest(spans)
        assert [out[r.doc_id][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]


PARTS = ["a", "b.c", "@", ".", "com", "x-y", "%", "+", "1", "255", "256", "4111 1111 1111 1111", "4111-1111", "+1 (974) 555-3436", "(", ")", " ", "-", "é", "\n", "00012", "1.2.3.4"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join))
def test_base_spans_on_odd_texts(text):
    assert pii.base_spans(text) == brute.personal(text)


def test_field_adds_a_repeated_value_in_another_form_and_nothing_else():
    seen = [f"call +1 ({n}) 555-{n}7 or 41{n} boxes" for n in range(200, 400)]
    counts = {}
    for t in seen:
        nodes = pii.nodes_of(t, pii.base_spans(t))
        for a, b, label in nodes:
            key = ("node", pii._features(t[a:b]), max(label, 0), 0)
            counts[key] = counts.get(key, 0) + 1
    field = pii.fit_field([{"part": p, "features": list(f), "first": a, "second": b, "n": n} for (p, f, a, b), n in counts.items()])
    text = "call +1 (974) 555-3436 now. Later: (974) 555-3436 again. Order 7788990012 stays."
    added = pii.added_spans(text, pii.base_spans(text), field)
    assert [(k, text[a:b]) for k, a, b in added] == [("phone", "(974) 555-3436")]
    assert pii.masked(text, pii.base_spans(text) + added) == "call [PHONE] now. Later: [PHONE] again. Order 7788990012 stays."


def test_marginals_equal_enumeration_on_a_tree():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    unary, edges = rng.normal(size=(4, 3)), np.array([[0, 1], [1, 2], [1, 3]])
    potentials = rng.normal(size=(3, 3, 3))
    total = np.zeros((4, 3))
    for labels in itertools.product(range(3), repeat=4):
        w = np.exp(sum(unary[i, k] for i, k in enumerate(labels)) + sum(p[labels[a], labels[b]] for p, (a, b) in zip(potentials, edges, strict=True)))
        for i, k in enumerate(labels):
            total[i, k] += w
    want = total / total.sum(axis=1, keepdims=True)
    assert np.allclose(np.exp(pii.marginals(unary, edges, potentials, 100, 0.0)), want, atol=1e-6)


def test_many_repeats_stay_linear():
    text = "mail a.b@c.de " * 3000 + "and a.b@c "
    field = pii.fit_field([])
    assert len(pii.added_spans(text, pii.base_spans(text), field)) <= 1


# --- secrets ---


def test_secrets_equal_the_patterns(spark, real):
    out = {r["doc_id"]: r for r in queries.op4_secrets(spark, SF).collect()}
    for r in real.itertuples():
        spans = brute.secrets(r.text)
        assert out[r.doc_id]["base_sha256"] == brute.digest(spans)


SECRET_PARTS = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", ":", "=", " ", '"', "'", "abc", "abcdefgh", "12345678", "AKIA", "AKIAABCDEFGHIJKL", "XYZ123", "é", "日", "0123456789abcdef", "deadbeef", "\n", ".", "=="]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(SECRET_PARTS), max_size=14).map("".join))
def test_secrets_on_odd_texts(text):
    scanner, least = secrets.scanner_of(secrets.RULES), {r[0]: r[3] for r in secrets.RULES}
    assert [s for s in secrets.secret_spans(scanner, least, text) if s[0] in secrets.BASE] == brute.secrets(text)


@pytest.mark.parametrize("pattern", ["a(b|c)*d", "ab|abcd|bc", "a{2,}b?", "[^a]c+", "(ab?)+", "a{1,3}"])
def test_scanner_finds_leftmost_longest(pattern):
    import re

    scanner, random_ = Scanner({"x": (pattern, False), "y": ("bc", False)}), random.Random(2)
    for _ in range(300):
        text = "".join(random_.choices("abcd", k=random_.randrange(12)))
        want, at = [], 0
        while at < len(text):
            ends = [e for e in range(len(text), at, -1) if re.fullmatch(pattern, text[at:e])]
            if ends:
                want.append(("x", at, ends[0]))
            at = ends[0] if ends else at + 1
        assert [s for s in scanner.spans(text.encode()) if s[0] == "x"] == want


# --- language ---


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = queries.op2_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (out.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in out.doc_id]).all()
    held = out[out.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98
    assert out.score.between(0, 1).all()


def test_profiles_equal_counting_by_hand(spark):
    rows = [(1, "abba abba", "x"), (3, "cd cd!", "y"), (4, "12 ?", "y"), (5, None, "x"), (6, "abba", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language.learn_profiles(df)
    assert profiles.names == ["x", "y"]
    assert profiles.predict("Abba")[0] == "x" and profiles.predict("cd")[0] == "y"
    assert profiles.predict("12 ?") == ("und", 0.0) and profiles.predict(None) == ("und", 0.0)
    assert language.learn_profiles(df.limit(0)).predict("abba") == ("und", 0.0)


# --- media ---


def test_tiff_digests(spark, real):
    out = {r["doc_id"]: r for r in queries.op10_tiff(spark, SF).collect()}
    for r in real.itertuples():
        payload, n = tiff.padded(r.text)
        row = out[r.doc_id]
        assert (row["n_bytes"], row["payload_bytes"]) == (n, len(payload)) and len(payload) % 576 == 0 and len(payload) > 0
        assert row["payload_sha256"] == hashlib.sha256(payload).hexdigest() and row["tail_crc32"] == zlib.crc32(payload[-32:])


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiff_codecs(compression, predictor):
    r = random.Random(1)
    payload = bytes(r.randrange(256) for _ in range(576 * 30)) + b"a" * 576 * 40 + (b"abc " * 144) * 30
    media = tiff.write_tiff(payload, 576, 48, 16, compression, predictor)
    pages = list(tiff.read_tiff(media))
    assert b"".join(p.pixels.tobytes() for p in pages) == payload and [p.height for p in pages] == [48, 48, 4]


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=400) | st.text("ab", max_size=3000).map(str.encode))
def test_run_length_and_lzw_round_trip(data):
    assert tiff.packbits_decode(tiff.packbits_encode(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_big_endian_tiles():
    import struct

    tiles = [bytes([k]) * 256 for k in range(4)]  # 2 x 2 tiles of 16 x 16 over 20 x 20
    out = bytearray(b"MM\0*\0\0\0\0")
    offsets = []
    for t in tiles:
        offsets.append(len(out))
        out += t
    arrays = len(out)
    out += struct.pack(">4I", *offsets) + struct.pack(">4I", *[256] * 4)
    struct.pack_into(">I", out, 4, len(out))
    fields = [(256, 3, 1, 20 << 16), (257, 3, 1, 20 << 16), (258, 3, 1, 8 << 16), (259, 3, 1, 1 << 16), (277, 3, 1, 1 << 16), (322, 3, 1, 16 << 16), (323, 3, 1, 16 << 16), (324, 4, 4, arrays), (325, 4, 4, arrays + 16)]
    out += struct.pack(">H", len(fields)) + b"".join(struct.pack(">HHII", *f) for f in fields) + b"\0\0\0\0"
    (page,) = tiff.read_tiff(bytes(out))
    assert page.pixels.shape == (20, 20, 1) and [page.pixels[y, x, 0] for y, x in ((0, 0), (0, 19), (19, 0), (19, 19))] == [0, 1, 2, 3]


def test_damaged_files_give_an_error_row(spark):
    good = tiff.write_tiff(bytes(576 * 4), 576, 2)
    loop = bytearray(good)
    first = int.from_bytes(good[4:8], "little")
    n = int.from_bytes(good[first : first + 2], "little")
    loop[first + 2 + 12 * n : first + 6 + 12 * n] = good[4:8]
    df = spark.createDataFrame(pd.DataFrame({"doc_id": [1, 2, 3, 4, 5], "content": [good, bytes(loop), b"", b"II*\0\xff\xff\0\0", None]}), "doc_id long, content binary")
    out = {(r["doc_id"], r["page"]): r["error"] for r in tiff.tiff_pages(df).collect()}
    assert out[1, 0] is None and out[1, 1] is None and "loop" in out[2, None] and out[3, None] and out[4, None] and 5 not in {k for k, _ in out}


def test_chunks_before_a_letter_are_read_once():
    import time

    from gridwarden.llm import pii

    plain = re.compile(r"(?<![0-9A-Za-z])\+?\(?[0-9](?:[\x20().:/-]{0,2}[0-9])*+(?![0-9A-Za-z])")
    r = random.Random(4)
    for _ in range(2000):
        text = "".join(r.choice("0123 .-(+a/") for _ in range(r.randint(0, 60)))
        assert [m.span() for m in pii._CHUNK.finditer(text) if not pii._LETTER.match(text, m.end())] == [m.span() for m in plain.finditer(text)]
    start = time.time()
    pii.base_spans("1 " * 1_000_000 + "1a")
    assert not [m for m in pii._CHUNK.finditer("1 " * 1_000_000 + "1a") if not pii._LETTER.match("1 " * 1_000_000 + "1a", m.end())]
    assert time.time() - start < 5

"""Language ID, media, licenses, secrets and token counts against plain Python."""

import hashlib
import json
import math
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoweft.llm import langid, licenses, secrets, tiff, tokens
from tests.llm.conftest import ODD

# token counts


def test_token_counts_equal_the_library(docs):
    t = tokens.load(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in tokens.token_counts(docs).collect():
        n = len(t.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB 's\n\t1é日 \x1c!<|endoftext|>", max_size=40), max_size=5))
def test_parts_add_up(texts):
    texts = [*texts, "a <|endoftext|> b<|endoftext|>c", " x", "x ", "x  y"]
    c = tokens.counter(public_tokenizers.path("byte_bpe_50k.json"))
    assert c.counts(texts) == [len(c.tokenizer.encode(x, add_special_tokens=False).ids) for x in texts]


def test_token_counts_of_odd_rows(odd, empty):
    rows = tokens.token_counts(odd).collect()
    assert len(rows) == len(ODD) and all(r.n_tokens == 0 for r in rows if r.n_bytes == 0) and tokens.token_counts(empty).count() == 0


# media


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize(("predictor", "tile"), [(1, 0), (2, 0), (1, 16), (2, 32)])
def test_tiff_round_trip(compression, predictor, tile):
    rng = np.random.default_rng(3)
    pages = [rng.integers(0, top, shape).astype(np.uint8) for top, shape in ((3, (70, 45)), (256, (33, 64)), (2, (1, 1)))]
    back = list(tiff.read_tiff(tiff.write_tiff(pages, compression, predictor, tile, strip_rows=16)))
    assert len(back) == 3 and all(np.array_equal(a[:, :, 0], p) for (_, a), p in zip(back, pages, strict=True))


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000))
def test_codecs(data):
    assert tiff.unlzw(tiff.lzw(data)) == data and tiff.unpackbits(tiff.packbits(data), len(data)) == data


def test_lzw_fills_its_table():
    data = np.random.default_rng(1).integers(0, 256, 60_000).astype(np.uint8).tobytes()
    assert tiff.unlzw(tiff.lzw(data)) == data


def test_big_endian_16_bits():
    import struct

    pixels = struct.pack(">6H", 1, 3, 6, 10, 15, 21)
    tags = [(256, 3), (257, 2), (258, 16), (259, 1), (273, 8), (277, 1), (278, 2), (279, 12)]
    data = b"MM\0*" + struct.pack(">I", 20) + pixels + struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHII", t, 4, 1, v) for t, v in tags) + bytes(4)
    ((facts, a),) = tiff.read_tiff(data)
    assert facts["bits"] == 16 and a[:, :, 0].tolist() == [[1, 3, 6], [10, 15, 21]]


def test_pages_and_errors(spark):
    good = tiff.write_tiff([np.zeros((4, 4), np.uint8), np.ones((2, 3), np.uint8)])
    files = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"no tiff")), (3, None), (4, bytearray(good[:30]))], "id long, media binary")
    rows = {(r.id, r.page): r for r in tiff.tiff_pages(files, "id", "media").collect()}
    assert (rows[1, 0].width, rows[1, 1].height, bytes(rows[1, 1].pixels)) == (4, 2, b"\1" * 6)
    assert rows[2, 0].error and rows[4, 0].error and not [k for k in rows if k[0] == 3]


def test_text_features(docs, odd, empty):
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in tiff.text_features(docs).collect():
        data = texts[r.doc_id].encode()
        data += bytes(-len(data) % 64)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        assert r.media_sha256 == hashlib.sha256(tiff.text_tiff(data)).hexdigest()
    rows = tiff.text_features(odd).collect()
    assert len(rows) == len(ODD) and {r.payload_bytes for r in rows if r.n_bytes == 0} == {64} and tiff.text_features(empty).count() == 0


def stored_tiff(pages, order="<"):
    """A file of pages, each of tags and the bytes of its strips."""
    out, link = bytearray((b"II*\0" if order == "<" else b"MM\0*") + bytes(4)), 4
    for tags, strips in pages:
        at = []
        for x in strips:
            at.append(len(out))
            out += x
        entries = b""
        for tag, values in sorted((tags | {tiff.STRIP_OFFSETS: at, tiff.STRIP_BYTES: [*map(len, strips)]}).items()):
            packed = struct.pack(f"{order}{len(values)}I", *values)
            if len(values) > 1:
                place, out = len(out), out + packed
                packed = struct.pack(f"{order}I", place)
            entries += struct.pack(f"{order}HHI", tag, 4, len(values)) + packed
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(tags) + 2) + entries
        link = len(out)
        out += bytes(4)
    return bytes(out)


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_kinds_of_samples(order):
    rng = np.random.default_rng(3)
    size = {tiff.WIDTH: [11], tiff.HEIGHT: [5]}
    bilevel = rng.integers(0, 2, (5, 11), np.uint8)
    nibbles = rng.integers(0, 16, (5, 11), np.uint8)
    wide = rng.integers(0, 1 << 32, (5, 11), np.uint32)
    planes = rng.integers(0, 256, (5, 11, 3), np.uint8)
    real = rng.standard_normal((5, 11, 2)).astype(np.float32)
    split = real.astype(">f4").view(np.uint8).reshape(5, 22, 4).transpose(0, 2, 1).reshape(5, 44, 2)
    split = np.diff(split, axis=1, prepend=np.zeros((5, 1, 2), np.uint8)).tobytes()
    padded = np.concatenate([nibbles, np.zeros((5, 1), np.uint8)], axis=1)
    data = stored_tiff([
        (size | {tiff.COMPRESSION: [tiff.PACKBITS]}, [tiff.packbits(np.packbits(bilevel, axis=1).tobytes())]),
        (size | {tiff.BITS: [4]}, [(padded[:, ::2] << 4 | padded[:, 1::2]).tobytes()]),
        (size | {tiff.BITS: [32]}, [wide.astype(f"{order}u4").tobytes()]),
        (size | {tiff.BITS: [8] * 3, tiff.SAMPLES: [3], tiff.PLANAR: [2], tiff.ROWS_PER_STRIP: [3]}, [planes[r : r + 3, :, k].tobytes() for k in range(3) for r in (0, 3)]),
        (size | {tiff.BITS: [32] * 2, tiff.SAMPLES: [2], tiff.FORMAT: [3] * 2, tiff.PREDICTOR: [3]}, [split]),
    ], order)
    read = list(tiff.read_tiff(data))
    for (facts, got), want in zip(read, (bilevel, nibbles, wide, planes, real), strict=True):
        assert got.shape[:2] == (5, 11) and (got == want.reshape(5, 11, -1)).all()
        tiff.features(facts, got)
    assert json.loads(tiff.features(*read[4]))["mean"] == pytest.approx(real.mean(), abs=1e-6)


def test_tiff_pages_after_a_bad_one(spark):
    size = {tiff.WIDTH: [4], tiff.HEIGHT: [1], tiff.BITS: [8]}
    file = stored_tiff([(size, [b"abcd"]), (size | {tiff.COMPRESSION: [7]}, [b"jpeg"]), ({tiff.WIDTH: [4]}, [b""]), (size, [b"efgh"])])
    rows = tiff.tiff_pages(spark.createDataFrame([(1, bytearray(file))], "id long, media binary"), "id", "media").orderBy("page").collect()
    assert [(r.page, r.pixels and bytes(r.pixels), r.error is None) for r in rows] == [(0, b"abcd", True), (1, None, False), (2, None, False), (3, b"efgh", True)]


# language


def test_held_out_accuracy(docs):
    rows = langid.predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r.lang_pred == r.lang for r in rows if r.held_out]
    assert sum(out) >= 0.9 * len(out) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)


def test_languages_of_odd_rows(odd, empty, spark):
    rows = langid.predict_languages(odd).collect()
    texts = sorted(((r.doc_id is None, r.doc_id or 0), r.lang_pred) for r in rows)
    assert len(rows) == len(ODD) and {p for (_, k), p in texts if k in (2, 3, 4)} == {"und"} and langid.predict_languages(empty).count() == 0
    assert langid.known_language(odd).columns == odd.columns


def test_blocks_count_each_ngram_once():
    whole = np.zeros(langid.BUCKETS, int)
    parts = np.zeros(langid.BUCKETS, int)
    text = "".join(map(chr, np.random.default_rng(2).integers(97, 123, 5000)))
    for target, most in ((whole, 10_000), (parts, 37)):
        for _, bucket in langid.blocks([text], most):
            target += np.bincount(bucket, minlength=langid.BUCKETS)
    assert (whole == parts).all() and whole.sum() == 5001 + 5000


def test_priors_of_all_rows(spark):
    texts = ["le chat été", "12 !", None, "日本"]
    rows = [(k, texts[k % 4], "en" if k % 7 else "fr") for k in range(1400)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows_per_language=60)
    n = [sum(x == lang and k % 4 in (0, 3) and zlib.crc32(str(k).encode()) % 5 > 0 for k, _, x in rows) for lang in ("en", "fr")]
    assert model.languages == ["en", "fr"] and model.prior == pytest.approx([math.log((x + 1) / (sum(n) + 2)) for x in n])


# licenses


def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(k, label) for phrase, label in licenses.BASE for n in [len(phrase.split())] for k in range(len(words) - n + 1) if words[k : k + n] == phrase.split()]
    return len(words), len(found), min((k for k, _ in found), default=None), max((k for k, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_license_base(docs, odd, empty):
    for df in (docs, odd):
        texts = [(r.doc_id, r.text) for r in df.collect()]
        got = sorted((str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels) for r in licenses.license_scan(df).collect())
        assert got == sorted((str(i), a, b, str(c), str(d), e) for i, t in texts for a, b, c, d, e in [brute_licenses(t)])
    assert licenses.license_scan(empty).count() == 0


def test_license_rules(spark):
    cases = {
        1: ("Released under the MIT License. Under  the mit\nlicense!", "mit", 2),
        2: ("SPDX-License-Identifier: GPL-2.0", "gpl-2", 0),
        3: ("licensed under the GNU General Public License, version 3", "gpl-3", 0),
        4: ("CC-BY-NC and CC BY NC SA license", "cc-by-nc,cc-by-nc-sa", 2),
        5: ("Licensed under the Apache License, Version 2.0.", "apache-2", 1),
        6: ("all rights reserved", "all-rights-reserved", 0),
        7: ("kind summit license", "", 0),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "doc_id long, text string")
    for r in licenses.license_scan(df).collect():
        assert (r.labels, r.n_base) == cases[r.doc_id][1:], r
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    assert len(licenses.rules()) > 300 and all(all(k == k.lower() for k in r.keywords) for r in licenses.rules())


# secrets


def brute_secrets(text):
    text = text or ""
    spans = [("assign", *m.span()) for m in re.finditer(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 6]
    spans += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_secret_base(docs, odd, empty):
    for df in (docs, odd):
        want = []
        for r in df.collect():
            spans = brute_secrets(r.text)
            n = [sum(s[0] == k for s in spans) for k in ("assign", "access", "hex")]
            want.append((str(r.doc_id), *n, hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in spans).encode()).hexdigest()))
        got = secrets.secret_scan(df).collect()
        assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == sorted(want)
    assert secrets.secret_scan(empty).count() == 0


@pytest.mark.parametrize("text", ["token=token:abcdefgh", "PASSWORD : 'hunter22' passwd=abc", "apı_key=abcdefgh api_key=é", "toKen=abcdefgh", "a" * 30 + "g" + "0" * 24, "AKIAAKIA" + "B" * 16, "AKIA" + "C" * 15])
def test_secret_base_cases(text):
    assert secrets.listed(secrets.base_spans(text, text.lower())) == ",".join(f"{a}:{b}:{c}" for a, b, c in brute_secrets(text))


def test_linked_parts():
    key = "Ab1" * 12
    near = f"client_id = web-7 at https://x.example/api with {key}"
    found = secrets.scan(near, 400)[4]
    assert [x.split(":")[0] for x in found.split(",")] == ["identifier", "endpoint", "secret"]
    assert secrets.scan(f"client_id = web-7 {'. ' * 500}{key}", 400)[4] == ""
    assert secrets.scan(f"only {key}", 400)[4] == "" and secrets.scan("only https://x.example/api", 400)[4] == ""
    assert "secret:" in secrets.scan(f"AKIA{'Q' * 16} {key}", 400)[4]


@pytest.mark.parametrize("n", [128, 129, 172, 300, 5000])
def test_long_parts(n):
    key = ("Ab1" * n)[:n]
    assert secrets.scan(f"client_id = web-7 {key}", 400)[4] == f"identifier:0:17,secret:18:{18 + n}"
    assert secrets.scan(f"AKIA{'Q' * 16} {key}==", 400)[4] == f"access:0:20,secret:21:{23 + n}"
    name, path = "w" * n, "p" * 2 * n
    assert secrets.scan(f"login={name} {'Ab1' * 12}", 400)[4] == f"identifier:0:{6 + n},secret:{7 + n}:{43 + n}"
    assert secrets.scan(f"https://x.example/{path} password=hunter22", 400)[4].startswith(f"endpoint:0:{18 + 2 * n},")


def test_secret_beside_endpoint():
    key = "Ab1" * 12
    assert secrets.scan(f"https://x.example/api {key}", 400)[4] == "endpoint:0:21,secret:22:58"
    assert secrets.scan(f"https://x.example/api {'. ' * 500}{key}", 400)[4] == ""
    assert secrets.scan(f"see https://x.example/{key}", 400)[4] == ""


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9))), st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9))), st.integers(0, 8))
def test_interval_join(a, b, scope):
    a, b = ([(s, s + n) for s, n in x] for x in (a, b))
    assert secrets.within(a, b, scope) == [p for p in a if any(p[0] <= e + scope and s - scope <= p[1] for s, e in b)]
    assert secrets.apart(a, b) == [p for p in a if not any(p[0] < e and s < p[1] for s, e in b)]

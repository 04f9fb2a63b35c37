"""Edge cases of the corpus operators: long texts, ties, hot groups, damaged files, hand-written rules, and the whole pipeline on odd rows."""

import math
import re
import struct

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoweft.llm import langid, licenses, lines, mixing, packing, secrets, simhash, tiff, tokens
from geoweft.llm.common import Forest, connected_components
from geoweft.llm.license_rules import GATES
from tests.llm.conftest import ODD
from tests.llm.test_corpus_operators import brute_fingerprint, brute_lines, classes, gapless

# SimHash


def test_fingerprint_of_a_long_text():
    rng = np.random.default_rng(3)
    text = " ".join(map(str, rng.integers(0, 5000, 3 * simhash.BLOCK // 2)))
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def near_codes(seeds, copies, flips, seed):
    rng = np.random.default_rng(seed)
    return sorted({int(s) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, flips + 1), replace=False)) for s in rng.integers(0, 2**63, seeds) for _ in range(copies)})


@pytest.mark.parametrize(("shard", "part"), [(simhash.SHARD, simhash.PART), (1, simhash.PART), (simhash.SHARD, 3)])
def test_links_for_any_number_of_blocks_and_parts(spark, monkeypatch, shard, part):
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "PART", part)
    codes = near_codes(20, 12, 4, 11)
    want = classes(codes, lambda a, b: (a ^ b).bit_count() <= 4)
    signed = [int(np.array(x, np.uint64).view(np.int64)) for x in codes]
    roots = {r.node: r.root for r in connected_components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()}
    groups = {}
    for x, c in zip(codes, signed, strict=True):
        groups.setdefault(roots.get(c, c), set()).add(want.find(x))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({want.find(x) for x in codes})


def test_more_codes_more_blocks():
    assert [simhash.block_count(n, 4, 64) for n in (10, 4_000_000, 5_000_000, 10**9, 10**11)] == [5, 5, 6, 6, 7]


def test_trees_have_children():
    codes = np.array(near_codes(5, 5, 3, 2), np.uint64)
    tree, seen, todo = simhash.Tree(codes), 0, None
    todo = [tree]
    while todo:
        t = todo.pop()
        seen += 1
        for e, child in t.children.items():
            assert {(int(codes[m]) ^ int(codes[t.pivot])).bit_count() for m in child.members} == {e}
            todo.append(child)
    assert seen == len(codes)


# lines


@pytest.mark.parametrize("n", [30, 60, 120, 400])
def test_banding_recall_by_length(n):
    rng = np.random.default_rng(n)
    found = total = 0
    while total < 150:
        a = "".join(map(chr, rng.integers(97, 123, n)))
        b = a[: -max(1, n // 12)] + "".join(map(chr, rng.integers(97, 123, max(1, n // 12))))
        x, y = lines.shingles(a), lines.shingles(b)
        if len(x & y) >= 0.8 * len(x | y):
            total += 1
            found += (lines.bands([a]) == lines.bands([b])).any()
    assert found >= 0.95 * total


def test_lines_of_documents_with_string_ids(spark):
    line = "the same line of words stands in every one of these documents"
    df = spark.createDataFrame([(f"d{k}", f"{line}\nown words number {k} and nothing else at all {k * 7919}") for k in range(5)], "doc_id string, text string")
    rows = {(r.doc_id, r.line): (r.class_id, r.kept) for r in lines.line_classes(df).collect()}
    assert all(rows[f"d{k}", 0] == ("d0", k == 0) for k in range(5))
    kept = {r.doc_id: r.text.count("\n") for r in lines.without_repeated_lines(df).collect()}
    assert kept == {f"d{k}": int(k == 0) for k in range(5)}


# mixing


def test_mix_of_equal_rows(spark):
    rows = [(1, "a b c d e", "x")] * 7 + [(2, "f g", "x"), (3, "h", "y"), (3, "i", "y"), (4, None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = mixing.mix(df).collect()
    assert len(taken) == len(rows)
    for source, size in (("x", 37), ("y", 2)):
        own = [r for r in taken if r.source_size == size]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1 and all(r.taken <= 3 * r["size"] for r in own)
    mixed = mixing.mixed_documents(df)
    words = sum(len(r.text.split()) for r in mixed.collect())
    # rows that repeat id, source and text share a part evenly, in whole words
    assert abs(words - sum(r.taken for r in taken)) <= 4
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, mixing.mixed_documents(df.orderBy(F.desc("doc_id"))).collect()))


# packing


def test_every_letter_before_a_stop():
    e = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    letters = [c for c in map(chr, range(0x80, 0x30000)) if c.isalpha() and not 0x4E00 <= ord(c) < 0x9FFF and not 0xAC00 <= ord(c) < 0xD7A4 and ord(c) < 0x20000 or ord(c) in (0x20000, 0x2F800, 0x9F99, 0xD55C)]
    texts = [f"x{c}{stop} {c}{stop}" for c in letters for stop in ",."] + ["BELGESİ, ve", "क़ ख़, ढ़.", "שּׁ, לּ."]
    want = [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert list(e.encode(texts)) == want


def test_memory_of_parts_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 2000)
    monkeypatch.setattr(tokens, "REMEMBERED", 2000)
    e, c = packing.Encoder(public_tokenizers.path("word_bpe_49k.json")), tokens.PieceCounter(public_tokenizers.path("byte_bpe_50k.json"))
    for k in range(0, 2000, 50):
        text = " ".join(f"word{j}," for j in range(k, k + 50))
        assert next(e.encode([text])) == np.array(e.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert c.counts([text]) == [len(c.tokenizer.encode(text, add_special_tokens=False).ids)]
        assert len(e.known) < 200 and len(c.rest) < 200


# token counts


def test_every_letter_counts():
    c = tokens.PieceCounter(public_tokenizers.path("byte_bpe_50k.json"))
    letters = [x for x in map(chr, range(0x80, 0x30000)) if x.isalpha() and not 0x4E00 <= ord(x) < 0x9FFF and not 0xAC00 <= ord(x) < 0xD7A4 and ord(x) < 0x20000 or ord(x) in (0x20000, 0x2F800, 0x9F99, 0xD55C)]
    texts = [f"{x}{stop} a{x}{stop} {x}" for x in letters for stop in ",."]
    assert c.counts(texts) == [len(x.ids) for x in c.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_a_long_text_with_other_white_space_is_split():
    c = tokens.PieceCounter(public_tokenizers.path("byte_bpe_50k.json"))
    text = " start\n of  a text\t with tabs \r\n and  runs   of spaces " + "and then words " * 20_000 + "\n ᠎ x \xa0 y  z "
    seen = []
    encode, c.encode = c.encode, lambda texts: seen.extend(texts) or encode(texts)
    assert c.counts([text]) == [len(c.tokenizer.encode(text, add_special_tokens=False).ids)]
    assert max(map(len, seen)) < 40


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB 's \n \t1é \x1c\x85\xa0᠎​﻿ !<|endoftext|>", max_size=30))
def test_parts_of_any_white_space_add_up(text):
    c = tokens.counter(public_tokenizers.path("byte_bpe_50k.json"))
    assert c.counts([text]) == [len(c.tokenizer.encode(text, add_special_tokens=False).ids)]


def test_batches_are_balanced_by_bytes():
    parts = ["日" * 100] * 3000
    assert max(sum(map(tokens.size, x)) for x in tokens._chunks(parts)) <= tokens.BATCH_BYTES + 300


# media


def test_a_header_cannot_ask_for_memory():
    file = bytearray(tiff.write_tiff([np.zeros((64, 64), np.uint8)], tiff.DEFLATE))
    (at,) = struct.unpack_from("<I", file, 4)
    (n,) = struct.unpack_from("<H", file, at)
    for k in range(n):
        for value in (0, 1, 0x7FFFFFFF, 0xFFFFFFFF):
            damaged = bytearray(file)
            struct.pack_into("<I", damaged, at + 2 + 12 * k + 8, value)
            for _ in tiff.read_pages(bytes(damaged)):
                pass
            struct.pack_into("<I", damaged, at + 2 + 12 * k + 4, value)
            for _ in tiff.read_pages(bytes(damaged)):
                pass


@settings(max_examples=300, deadline=None)
@given(st.sampled_from([(tiff.NONE, 1, 0), (tiff.PACKBITS, 1, 0), (tiff.LZW, 2, 16), (tiff.DEFLATE, 2, 0)]), st.lists(st.tuples(st.integers(0, 10_000), st.integers(0, 255)), min_size=1, max_size=6))
def test_damaged_files_give_pages_or_errors(kind, changes):
    compression, predictor, tile = kind
    file = bytearray(tiff.write_tiff([np.arange(600, dtype=np.uint8).reshape(20, 30), np.ones((3, 3), np.uint8)], compression, predictor, tile))
    for at, value in changes:
        file[at % len(file)] = value
    try:
        for page in tiff.read_pages(bytes(file)):
            if not isinstance(page, tiff.TiffError):
                facts, pixels = page
                assert pixels.nbytes <= tiff.MOST and tiff.features(facts, pixels)
    except tiff.TiffError:
        pass


# language


def test_more_languages_than_stand_together(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = {f"l{k:02}": ["".join(map(chr, rng.integers(97, 123, 6))) for _ in range(6)] for k in range(9)}
    rows = [(k, " ".join(rng.choice(words[lang], 12)), lang) for k, lang in enumerate(sorted(words) * 12)]
    rows += [(1000, "zzz", None), (1001, None, "l00"), (1002, "12 !", "l01")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict_languages(df).orderBy("doc_id").collect()]
    monkeypatch.setattr(langid, "TOGETHER", 4)
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict_languages(df).orderBy("doc_id").collect()]
    assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=1e-9)
    assert sum(a == b for (_, a, _), (_, _, b) in zip(want, rows, strict=True)) >= 100


def test_posteriors_by_hand(spark):
    """Multinomial naive Bayes from its definition, in plain Python."""
    rows = [(k, x, y) for k, (x, y) in enumerate([("aba", "p"), ("abab", "p"), ("cdc", "q"), ("dcd", "q"), ("abcd", "p"), ("xy", "q")] * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    import zlib
    from collections import Counter

    used = [(x, y) for k, x, y in rows if zlib.crc32(str(k).encode()) % 5]
    counts, docs = {"p": Counter(), "q": Counter()}, Counter(y for _, y in used)
    grams = lambda x: [int(b) for _, bucket in langid.blocks([x], 100) for b in bucket]
    for x, y in used:
        counts[y].update(grams(x))
    for text in ("ab", "cd", "abcd", "zz"):
        s = {y: math.log((docs[y] + 1) / (sum(docs.values()) + 2)) + sum(math.log((counts[y][g] + 0.5) / (sum(counts[y].values()) + 0.5 * langid.BUCKETS)) for g in grams(text)) for y in "pq"}
        best = max("pq", key=lambda y: s[y])
        (name,), (score,) = model.predict([text])
        assert name == best and score == pytest.approx(1 / sum(math.exp(v - s[best]) for v in s.values()), abs=1e-5)


def test_equal_posteriors_go_to_the_first_language(spark):
    rows = [(k, "same words", ("b", "a")[k % 2]) for k in range(40)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    model.prior[:] = model.prior[0]
    model.table[:] = model.table[:, :1]
    assert model.predict(["same words"]) == (["a"], [0.5])


def test_no_language_at_all(spark):
    df = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.predict_languages(df).collect()] == [("und", 0.0)] and langid.known_language(df).count() == 0


# licenses


def sure(pattern):
    """The strings that every match of a rule's pattern holds, between marks."""
    while (shorter := re.sub(r"\((?:\?:)?[^()]*\)(?:\?|\{\d+,\d+\}\?)?", "\0", pattern)) != pattern:
        pattern = shorter
    return " " + re.sub(r"\.\{\d+,\d+\}\?|\[[^\]]*\]\??|\\w\+|.\?", "\0", pattern) + " "


def test_rules_stand_behind_their_keywords():
    every = licenses.rules()
    assert len(every) > 300 and len({r.pattern for r in every}) == len(every)
    for r in every:
        re.compile(r.pattern)
        choices = sure(r.pattern) if sure(r.pattern).strip("\0 ") else r.pattern
        assert any(g in choices for g in GATES), r
        for key in r.keywords:
            alternatives = re.findall(r"\(\?:([^()]*)\)", r.pattern)
            assert key in choices or any(all(key in x for x in a.split("|")) for a in alternatives) or all(key in f"{x}{r.pattern.rpartition(')')[2]}" for a in alternatives[-1:] for x in a.split("|")), r


def brute_detections(text):
    words = re.sub(licenses.GAP, " ", f" {text} ")
    found = []
    for n, r in enumerate(licenses.rules()):
        if all(k in words.lower() for k in r.keywords):
            for m in re.finditer(rf" ({r.pattern})(?= )", words, re.IGNORECASE):
                start = words[: m.start()].count(" ")
                found.append((start, start + len(m[1].split(" ")), r.priority, n, r))
    kept = []
    before = []
    for start, stop, priority, n, r in sorted(found, key=lambda x: (x[0], -x[1], -x[2], x[4].label, x[4].weight)):
        if not any(s <= start and stop <= e and p >= priority for s, e, p in before):
            kept.append((start, stop, r.label))
        before.append((start, stop, priority))
    return kept


LICENSE_TEXTS = [
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. MIT License too.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3.",
    "SPDX-License-Identifier: BSD-3-Clause. Redistribution and use in source and binary forms, with or without modification, are permitted. All rights reserved.",
    "under the MIT license under the mit license, the GNU GPL v2 license, GPL-3.0 licence, CC BY-NC-SA 4.0",
    "Creative Commons Attribution-ShareAlike 4.0 International; creativecommons.org/licenses/by/4.0; released under CC0 1.0 Universal license",
    "License :: OSI Approved :: MIT License",
    "no such thing here",
    "",
]


def test_detections_like_brute_force(spark):
    df = spark.createDataFrame([*enumerate(LICENSE_TEXTS), (99, None)], "doc_id long, text string")
    for r in licenses.license_scan(df).collect():
        text = LICENSE_TEXTS[r.doc_id] if r.doc_id != 99 else ""
        want = brute_detections(text)
        assert [(d.start, d.stop, d.label) for d in r.detections] == want, text
        assert r.labels == ",".join(sorted({x[2] for x in want} | set(filter(None, r.base_labels.split(",")))))


# secrets


def brute_links(text, scope):
    near = lambda a, b: a[0] <= b[1] + scope and b[0] <= a[1] + scope
    over = lambda a, b: a[0] < b[1] and b[0] < a[1]
    base = secrets.base_spans(text, text.lower())
    strong, access = base["assign"] + base["hex"], base["access"]
    ids = [m.span() for m in secrets.IDENTIFIER.finditer(text)]
    sites = [m.span() for m in secrets.ENDPOINT.finditer(text)]
    keys = [m.span() for m in secrets.SECRET.finditer(text) if secrets.mixed(m[0])]
    keys = [k for k in keys if not any(over(k, x) for x in strong + access + ids)]
    ids, sites = ([p for p in x if not any(over(p, y) for y in strong + access)] for x in (ids, sites))
    out = {"identifier": [i for i in ids if any(near(i, x) for x in strong + keys)]}
    out["secret"] = [k for k in keys if any(near(k, x) for x in ids + access) or not any(over(k, s) for s in sites) and any(near(k, s) for s in sites)]
    out["endpoint"] = [s for s in sites if any(near(s, x) for x in strong + access + out["identifier"] + out["secret"])]
    return secrets.listed(base | out)


PARTS = ["client_id = web-7", "Ab1" * 12, "https://x.example/api", f"AKIA{'Q' * 16}", "password=hunter22", "0123456789abcdef" * 2, "word " * 9, "é", f"https://x.example/{'Cd2' * 12}", "login=someone", "\n"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12), st.sampled_from([0, 20, 60, 400]))
def test_linked_spans_like_brute_force(parts, scope):
    text = " ".join(parts)
    assert secrets.scan(text, scope)[4] == brute_links(text, scope)


# pipeline


def test_pipeline_of_odd_rows(spark, odd, empty, tmp_path):
    import corpus_pipeline

    for name, docs in (("odd", odd), ("empty", empty)):
        columns = docs.columns
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, f"{tmp_path}/{name}").write.parquet(f"{tmp_path}/{name}/{k}")
            before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}/{k}")
            if k == 0 and name == "odd":
                assert {r.doc_id for r in docs.collect()} <= {1, None, 5, 6, 7} and docs.count() < len(ODD)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == columns
        rows = docs.collect()
        gapless(rows, 2048)
        assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows) and (name == "empty") == (not rows)
        assert docs.where("piece = 0").count() == before.count()


def test_language_stage_drops_what_is_not_sure(spark):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    words = {lang: ["".join(map(chr, rng.integers(a, a + 13, 6))) for _ in range(30)] for lang, a in (("p", 97), ("q", 110))}
    rows = [(k, " ".join(rng.choice(words["pq"[k % 2]], 30)), "pq"[k % 2]) for k in range(60)] + [(100, "123 456 !!", "p"), (101, None, "q"), (102, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()) == list(range(60))


def test_repeated_rows_through_line_dedup(spark):
    rows = [(1, "a line that stands twice here\nand another one of its own", 0)] * 2 + [(2, "a line that stands twice here", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, line int")
    want = brute_lines([(i, t) for i, t, _ in rows])
    kept = sorted((r.doc_id, r.text) for r in lines.without_repeated_lines(df).collect())
    assert kept == [(1, rows[0][1]), (1, rows[0][1]), (2, "")] and want[2, 0] == (1, 0)


def test_forest_edges_keep_what_is_united():
    forest = Forest()
    for a, b in ((1, 2), (2, 3), (7, 8)):
        forest.union(a, b)
    assert sorted((u, v) for batch in forest.edges() for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True)) == [(2, 1), (3, 1), (8, 7)]


def test_parts_that_come_again_are_encoded_once(monkeypatch):
    common, rare = [f"common{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40)], iter(f"rare{a}{b}{c}" for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefghij")
    texts = [" ".join([*common, *(f"{x}," for x in common), *(next(rare) for _ in range(60))]) for _ in range(12)]
    e = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    want = [struct.pack(f"<{len(ids)}I", *ids) for ids in (e.tokenizer.encode(x, add_special_tokens=False).ids for x in texts)]
    monkeypatch.setattr(packing, "REMEMBERED", 40_000)
    monkeypatch.setattr(packing, "BATCH_BYTES", 100)
    asked, pieces = [], e.pieces
    e.pieces = lambda word: asked.append(word) or pieces(word)
    assert list(e.encode(texts)) == want
    assert len(asked) == len(common) + 12 * 60

"""License scan against brute force and against its SQL."""

import random
import re

import duckdb

from tierscope.llm import licenses as s
from tierscope.llm.oracle import SQL
from tierscope.llm.queries import op8_license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def own_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text):
    """Best containment of each template, over every stretch of words."""
    w, best = own_words(text), {}
    for t, template in enumerate(s.TEMPLATES):
        whole = own_words(template.text)
        own, longest = set(whole), -(-len(whole) * 5 // 4)
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + longest) + 1):
                block = set(w[i:j])
                c = len(own & block)
                if 5 * c >= 4 * len(own) and block >= set(template.needs) and not block & set(template.lacks):
                    best[t] = max(best.get(t, 0), c / len(own))
    return best


def damaged(rng, vocabulary):
    """A notice with changed words and line breaks between other words."""
    w = rng.choice(s.TEMPLATES).text.split()
    for _ in range(rng.choice([0, 0, 1, 2, len(w) // 6])):
        k = rng.randrange(len(w))
        w[k:k + 1] = rng.choice([[], [rng.choice(vocabulary)], [w[k], rng.choice(vocabulary)]])
    before, after = ([rng.choice(vocabulary) for _ in range(rng.randint(0, 12))] for _ in range(2))
    return rng.choice([" ", "\n", " \n * "]).join([*before, *w, *after])


def test_equals_brute_force_and_sql(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = own_words(" ".join(t.text for t in s.TEMPLATES)) + ["é", "mit", "license", "cc", "by", "lesser", "sa", "nc"]
    texts = [None, "", "\n\n", "The MIT License and the Apache-License, CC BY cc by", "mit\nlicense", "x" * 10_000]
    texts += [damaged(rng, vocabulary) for _ in range(90)]
    docs = spark.createDataFrame([(t, i, "old") for i, t in enumerate(texts)], "text string, doc_id bigint, Score string")
    found = {r.doc_id: r for r in s.scan(docs).collect()}
    assert len(found) == len(texts)
    matched = 0
    for i, t in enumerate(texts):
        r, w, want = found[i], own_words(t), brute(t)
        matched += bool(want)
        assert r.n_words == len(w)
        assert [(p["first"], p["label"]) for p in r.places] == sorted(
            (k, label) for p, label in s.PHRASES.items() for k in range(len(w)) if w[k:k + len(p.split())] == p.split())
        assert r.score == max(want.values(), default=0.0)
        assert {b["label"] for b in r.blocks} == {s.TEMPLATES[k].label for k in want}
        by_label = {}
        for k, c in want.items():
            by_label.setdefault(s.TEMPLATES[k].label, []).append(c)
        for label, values in by_label.items():
            assert max(b["containment"] for b in r.blocks if b["label"] == label) == max(values)
        for b in r.blocks:  # what stands there really is that much of a template
            block = set(w[b["first"]:b["first"] + b["n"]])
            assert any(len(block & set(own_words(k.text))) / len(set(own_words(k.text))) == b["containment"]
                       for k in s.TEMPLATES if k.label == b["label"])
    assert 40 < matched < 90
    assert s.scan(docs.where("false")).count() == 0

    path = str(tmp_path / "documents.parquet")
    docs.select("doc_id", "text").write.parquet(path)
    spark_rows = sorted(tuple(r) for r in op8_license_scan(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    assert spark_rows == sorted(con.execute(SQL["op8_license_scan"]).fetchall())


LGPL = """/* This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version. */"""
BSD = """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions"""
GPL = """This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by"""
BY = "This work is licensed under a Creative Commons Attribution{} 4.0\nInternational License"

CASES = [
    (LGPL, "lgpl"), (LGPL.replace("Lesser", "Library"), "lgpl"), (BSD, "bsd"), (GPL, "gpl"),
    (GPL.replace("GNU", "GNU\nAffero"), "agpl"),
    ("Licensed\nunder CC BY 4.0", "cc-by"), ("Licensed under CC BY 4.0", "cc-by"),
    ("Licensed under CC\nBY-NC 4.0", "cc-by,cc-by-nc"), ("Licensed under CC BY-NC-SA 4.0", "cc-by,cc-by-nc-sa"),
    (BY.format(""), "cc-by"), (BY.format("-NonCommercial"), "cc-by-nc"), (BY.format("-ShareAlike"), "cc-by-sa"),
    ("x " * 500 + BSD + " y" * 500, "bsd"),
    ("released\n" + "x " * 20 + "under\n" + "x " * 20 + "the mit\n" + "x " * 20 + "license", ""),
    ("released something under a thing the cat likes mit green license", ""),
    ("Released under the BSD License", ""), ("Licensed under the Foo License, Version 2.0", ""),
    ("This work is licensed under the GNU Free Documentation License", ""),
    ("Software\nreleased under the MIT\n// License.", "mit"), (None, ""),
]


def test_labels(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id bigint, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.labels for r in op8_license_scan(spark, str(tmp_path)).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(CASES)] == CASES


def test_places_of_notices(spark):
    text = "a b\n" + BSD + "\nc " * 40 + BSD
    row = s.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    size = len(own_words(BSD))
    short = [(b["first"], b["label"]) for b in row.blocks if b["containment"] == 1.0]
    assert short == [(2, "bsd"), (2 + size + 40, "bsd")]
    assert row.score == 1.0


def test_every_notice_finds_itself(spark):
    docs = spark.createDataFrame(
        [(i, f"{'w ' * i}{t.text.upper()}") for i, t in enumerate(s.TEMPLATES)] * 2, "doc_id bigint, text string")
    for r in s.scan(docs).collect():
        t = s.TEMPLATES[r.doc_id]
        assert (t.label, 1.0) in {(b["label"], b["containment"]) for b in r.blocks}


def test_long_line(spark):
    """Words that a very long line holds here and there are no notice; a notice in it is."""
    text = ("the license of this software and " * 20_000)
    docs = spark.createDataFrame([(1, text), (2, text + s.TEMPLATES[0].text + " " + text)], "doc_id bigint, text string")
    got = {r.doc_id: {b["label"] for b in r.blocks} for r in s.scan(docs).collect()}
    assert got == {1: set(), 2: {"gpl"}}

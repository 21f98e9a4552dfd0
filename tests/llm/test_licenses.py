import re

from evidoc.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, rules=licenses.RULES):
    """Every phrase at every word; every expression without gate or keyword; then suppression."""
    w = words(text)
    places = [(i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    padded = f" {' '.join(w)} "
    found = set()
    for r in rules:
        found |= {(m.start(), m.end(), r.priority, r.label) for m in re.finditer(f" {r.pattern}(?= )", padded)}
    ordered = sorted(found, key=lambda x: (x[0], -x[1], -x[2], x[3]))
    kept, furthest = [], -1
    for s, e, p, label in ordered:
        if furthest < e:
            kept.append((p, label, s, e))
        furthest = max(furthest, e)
    final = []  # highest priority first, then the longest, then the first
    for p, label, s, e in sorted(kept, key=lambda x: (-x[0], x[2] - x[3], x[2])):
        if not any(s < e2 and s2 < e for _, _, s2, e2 in final):
            final.append((p, label, s, e))
    kept = [(p, label) for p, label, _, _ in final]
    base = sorted({x for _, x in places})
    return (
        len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(base),
        ",".join(sorted({*base, *(x for _, x in kept)})), max([p / 100 for p, _ in kept] + [0.6 if places else 0.0]),
    )


TEXTS = [
    "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License.",
    "This is free software under the GNU General Public License version 3 or (at your option) any later version.",
    "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "CC BY-SA 4.0 and cc by and cc-by. All rights reserved, all rights reserved.", "Copyright (c) 2019 2021 Someone. BSD 3-Clause License.",
    "Mozilla Public License 2.0", "creative commons attribution noncommercial 4.0 international", "the unlicense", "nothing here at all",
    "accord by law; general public; rights reserved", "General Public License General Public License", "no licenses and no licensing of the reserved kind",
    "Redistribution and use in source and binary forms, with or without modification, are permitted", "proprietary and confidential",
]


def test_scan_equals_brute_force(spark, docs):
    texts = TEXTS + list(HEADERS) + [r["text"] for r in docs.select("text").collect()] + [" ".join(TEXTS) * 3]
    frame = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(texts)], "doc_id long, text string, labels string, __row string")
    got = {r["doc_id"]: r for r in licenses.scan(frame).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        r, want = got[k], brute(t)
        assert tuple(r)[1:-1] == want[:-1], t
        assert abs(r["score"] - want[-1]) < 1e-9


def test_gate_and_keywords_hide_no_rule():
    """Each rule's keyword and some gate stem are in what its expression demands."""
    for r in licenses.RULES:
        sample = re.sub(r"\[cs\]", "s", r.pattern)
        assert r.keyword in r.pattern or r.keyword in sample or re.search(r.keyword.replace("license", "licen[cs]e"), r.pattern), r
    assert len(licenses.RULES) >= 200


def test_labels(spark):
    got = {t: brute(t)[5] for t in TEXTS}
    assert got[TEXTS[0]] == "apache-2.0" and "mit" in got[TEXTS[2]] and got[TEXTS[9]] == ""
    assert got[TEXTS[1]] == "gpl,gpl-3.0-or-later"


HEADERS = {
    "This project is GPL v3.": "gpl-3.0",
    "GPL-2.0-only": "gpl-2.0",
    "License: GPLv3": "gpl-3.0",
    "under LGPLv2.1 or later": "lgpl-2.1-or-later",
    "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2.0-or-later",
    "AGPL-3.0": "agpl-3.0",
    "LGPL 2.1": "lgpl-2.1",
    "MPL-2.0": "mpl-2.0",
    "dual licence, EPL 2.0 here": "epl-2.0",
    "This software is not licensed under the MIT license.": "not-licensed",
    "It is not released under the terms of the GNU General Public License": "gpl,not-licensed",
    "It is licensed under the MIT license.": "mit",
    "a simple example of an epl that is no licence": "",
}


def test_headers_and_short_forms(spark):
    frame = spark.createDataFrame(list(enumerate(HEADERS)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(frame).collect()}
    assert {t: got[k] for k, t in enumerate(HEADERS)} == HEADERS
    assert all(brute(t)[5] == want for t, want in HEADERS.items())


def test_priority_resolves_overlaps(spark):
    """Runs of detections that overlap in part: the stronger ones stay, whatever their order."""
    rules = (licenses.Rule("a", "licence", "one two licence", 50), licenses.Rule("b", "licence", "licence three four", 90), licenses.Rule("c", "five", "four five", 70), licenses.Rule("d", "five", "five six seven", 60))
    texts = ["one two licence three four five six seven", "one two licence three", "licence: four five six seven", "licence three four five six seven " * 3, "one two licence licence three four", "x " * 300 + "one two licence three four five " * 200]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(frame, rules).collect()}
    want = {k: brute(t, rules) for k, t in enumerate(texts)}
    assert {k: v[0] for k, v in got.items()} == {k: v[5] for k, v in want.items()}
    assert got[0] == ("b,d", 0.9) and got[1][0] == "a" and got[4][0] == "a,b"


def test_no_python_on_the_main_path(spark, docs):
    assert not re.search("Python|Pandas|Arrow", licenses.scan(docs)._jdf.queryExecution().toString())


def test_empty_and_repeated(spark, docs, empty):
    assert licenses.scan(empty).count() == 0 and licenses.scan(docs).count() == docs.count()

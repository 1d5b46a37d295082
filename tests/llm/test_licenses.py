import re

from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm import catalog, licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RULES, FOLD = licenses._rules(), licenses._fold()
GATES = licenses.gate(RULES)


def base(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places, found = [], set()
    for phrase, label in licenses.BASE_PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                found.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found))


PARTS = ["Under", "the", "MIT", "license", "Apache", "License,", "Version", "2.0", "CC", "BY-NC", "4.0", "cc", "by", "nc", "é", "under the mit license", "\n", "x_y"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=25))
def test_base_of_random_texts(parts):
    text = " ".join(parts)
    got = licenses.scan(text.encode(), RULES, FOLD, GATES)
    assert got[:5] == base(text)
    assert set(filter(None, got[4].split(","))) <= set(filter(None, got[5].split(",")))
    assert 0 <= got[6] <= 1


def labels(text):
    return licenses.scan(text.encode(), RULES, FOLD, GATES)[5]


def test_labels():
    assert labels("Released under the MIT License.") == "mit"
    assert labels("Licensed under the Apache License, Version 2.0.") == "apache-2"
    assert labels("This work is licensed under the GNU General Public License, version 3.") == "gpl-3"
    assert labels("Licensed under the terms of the GNU Lesser General Public License v2.1") == "lgpl-2.1"
    assert labels("Licensed under CC BY-NC 4.0.") == "cc-by-nc,cc-by-nc-4"
    assert labels("SPDX-License-Identifier: BSD-3-Clause") == "bsd-3-clause"
    assert labels("Permission is hereby granted, free of charge, to any person obtaining a copy") == "mit"
    assert labels("He said the license was nice") == ""


def test_suppression():
    found = [(0, 10, 40, 1.0, "long"), (2, 5, 30, 0.9, "inside"), (8, 20, 30, 0.9, "overlaps"), (20, 30, 5, 0.1, "apart"), (0, 10, 40, 1.0, "zzz")]
    assert [x[4] for x in licenses.suppress(found)] == ["long", "apart"]


def test_there_are_hundreds_of_rules():
    assert len(RULES) > 190 and len({r[0] for r in RULES}) > 90
    assert [r[3] for r in RULES] == sorted((r[3] for r in RULES), reverse=True)


def by_definition(text):
    """labels and score: every rule on every text without any gate, then every detection against every better one."""
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    line = " " + " ".join(words) + " "
    found = []
    for row in licenses.SIGNATURES.splitlines():
        if not row or row[0] == "#":
            continue
        label, priority, weight, _, pattern = row.split(" ; ")
        for m in re.finditer(f" {pattern}(?= )", line):
            version = ".".join(m["v"].split()) if "(?P<v>" in pattern else ""
            name = label[:-1] + (version[:-2] if version.endswith(".0") else version) if label.endswith("-V") else label
            found.append((-int(priority), m.start() - m.end(), m.start(), name, m.end(), float(weight)))
    kept = []
    for x in sorted(found):
        if all(x[4] <= y[2] or y[4] <= x[2] for y in kept):
            kept.append(x)
    marked = base(text)[4]
    labels = sorted({x[3] for x in kept} | set(filter(None, marked.split(","))))
    return ",".join(labels), max([*(x[5] for x in kept), 0.9 if marked else 0.0, 0.0])


NOTICES = {
    "Distributed under the BSD 3-Clause license": "bsd-3-clause",
    "This file is part of X. X is free software; see the GNU Affero General Public License v3.0": "agpl-3",
    "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
    "Creative Commons Attribution-ShareAlike 4.0 International": "cc-by-sa-4",
    "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0": "cc-by-nc-nd-4",
    "CC BY-SA 3.0": "cc-by-sa-3",
    "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2",
    "SPDX-License-Identifier: Apache-2.0": "apache-2",
    "Mozilla Public License, v. 2.0": "mpl-2",
    "Eclipse Public License 2.0": "epl-2",
    "Boost Software License - Version 1.0": "boost-1",
    "the European Union Public Licence v1.2": "eupl-1.2",
    "This is free and unencumbered software released into the public domain": "unlicense",
    "CC0 1.0 Universal": "cc0-1",
    "Business Source License 1.1": "busl-1.1",
    "Llama 3 Community License Agreement": "llama",
    "Copyright (c) 2020 Somebody. All rights reserved.": "copyright,proprietary",
    "the public domain": "public-domain",
    "Permission to use, copy, modify, and/or distribute this software for any purpose": "isc",
    "the apache attacked the licence office": "",
}


def test_notices():
    for text, want in NOTICES.items():
        assert labels(text) == want, text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*NOTICES, *PARTS, "gnu", "gpl", "lesser", "general", "public", "v2.1", "creative commons", "attribution", "and"]), max_size=12))
def test_detections_by_definition(parts):
    text = " ".join(parts)
    assert licenses.scan(text.encode(), RULES, FOLD, licenses.gate(RULES))[5:] == by_definition(text)


def test_query(spark, data):
    """Every document against the definitions, without keywords and gates."""
    top = data.replace("0.001", "0.01")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{top}/documents.parquet").collect()}
    got = catalog.op7_licenses(spark, top).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(texts[r.doc_id])
        assert (r.labels, r.score) == by_definition(texts[r.doc_id])
    assert sum(bool(r.labels) for r in got) > 0


def test_odd_rows(odd, empty):
    got = licenses.scan_documents(odd).collect()
    assert len(got) == odd.count()
    assert {(r.n_words, r.labels, r.score) for r in got if r.doc_id in (1, 2, 5)} == {(0, "", 0.0)}
    assert licenses.scan_documents(empty).collect() == []

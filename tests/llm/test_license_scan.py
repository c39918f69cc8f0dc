"""License scans: sentences, ordered rules, brute force over the documents."""

import re

import pytest

from cases import awkward, frame
from shelfprice.llm import license_scan, queries
from shelfprice.llm.common import table


def expected(text):
    if text is None or not re.search(license_scan.MARKS, text):
        return None, 0, 0
    lines = re.sub(r"([.!?])[\x20\x09-\x0D]+", r"\1\n", text).split("\n")
    normal = [re.sub(r"[\W_]+", " ", s.lower()).strip(" ") for s in lines]
    by = {v: k for k, v in license_scan.SENTENCES.items()}
    ids = [by[s] for s in normal if s in by]
    unknown = sum(bool(re.search(r"\blicen[sc]e", s)) for s in normal if s not in by)
    left, found = list(ids), set()
    for name, rule in license_scan.RULES:
        k = 0
        while k + len(rule) <= len(left):
            if left[k:k + len(rule)] == rule:
                left[k:k + len(rule)] = ["#"]
                found.add(name)
            k += 1
    return ";".join(sorted(found)) or None, len(ids), unknown


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in table(spark, folder, "documents").collect()}
    rows = queries.op8_license_scan(spark, folder).collect()
    assert {r["doc_id"]: (r["licenses"], r["n_sentences"], r["n_unknown"]) for r in rows} == {
        i: expected(t) for i, t in docs.items()}
    assert sum(r["licenses"] is not None for r in rows) > 20


@pytest.mark.parametrize(("text", "licenses"), [
    ("Released under the MIT License.", "MIT"),
    ("a b. LICENSED*** under the Apache-License, Version 2.0. Rest", "Apache-2.0"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance "
     "with the License.", "Apache-2.0"),
    ("Licensed under CC BY-NC 4.0.\nReleased under the MIT License.", "CC-BY-NC-4.0;MIT"),
    ("Not licensed under the MIT License.", None), ("", None), (None, None)])
def test_rules(spark, text, licenses):
    got = license_scan.scan(frame(spark, [(1, text, "en", "a", 0)])).first()
    assert got["licenses"] == licenses == expected(text)[0]


def test_awkward_rows(spark):
    rows = license_scan.scan(frame(spark)).collect()
    assert len(rows) == len(awkward())
    assert license_scan.scan(frame(spark, [])).count() == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU {kind}General Public License as published by
the Free Software Foundation, either version {v} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
CC0 = """To the extent possible under law, the author(s) have dedicated all copyright
and related and neighboring rights to this software to the public domain
worldwide. This software is distributed without any warranty.
"""
ONE_LINE = ('Copyright 2020 A. Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
            'except in compliance with the License.')
WRAPPED = [
    (MIT, "MIT"), (GPL.format(kind="", v=3), "GPL-3.0-or-later"), (GPL.format(kind="", v=2), "GPL-2.0-or-later"),
    (GPL.format(kind="Lesser ", v="2.1").replace("program", "library"), "LGPL-2.1-or-later"),
    (GPL.format(kind="Affero ", v=3), "AGPL-3.0-or-later"), (APACHE, "Apache-2.0"), (BSD, "BSD-2-Clause"),
    (BSD3, "BSD-3-Clause"), (ISC, "ISC"), (MPL, "MPL-2.0"), (CC0, "CC0-1.0"), (ONE_LINE, "Apache-2.0"),
    ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"), ("Licensed under CC0 1.0", "CC0-1.0"),
    ("Released under\n\nthe MIT License.", None)]


def test_wrapped_headers(spark):
    """The original headers, hard-wrapped as they are, with Windows line ends, and behind comment signs."""
    shapes = [lambda t: t, lambda t: t.replace("\n", "\r\n"), *[
        lambda t, sign=sign: "".join(f"{sign}{line}\n" for line in t.splitlines()) for sign in ("# ", " * ", "// ")]]
    rows = [(100 * k + j, shape(text), "en", "a", 0) for k, (text, _) in enumerate(WRAPPED) for j, shape in enumerate(shapes)]
    got = {r["doc_id"]: r["licenses"] for r in license_scan.scan(frame(spark, rows)).collect()}
    assert got == {100 * k + j: name for k, (_, name) in enumerate(WRAPPED) for j in range(len(shapes))}


def test_every_known_sentence_passes_the_gate():
    for s in license_scan.SENTENCES.values():
        assert re.search(license_scan.MARKS, s.replace(" ", "\n"))

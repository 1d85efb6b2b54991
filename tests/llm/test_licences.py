"""License sentences in abbreviated, wrapped and spaced forms."""

import pytest

from vetframe.llm import licences


@pytest.mark.parametrize(
    ("text", "licenses"),
    [
        ("Words.\nLicensed under CC BY-NC 4.0.", ["CC-by-nc-4.0"]),
        ("Released under CC BY 4.0.", ["CC-by-4.0"]),
        ("This work is licensed under a CC-BY-SA 3.0 license.", ["CC-by-sa-3.0"]),
        ("Licensed under CC-BY-NC-ND-4.0.", ["CC-by-nc-nd-4.0"]),
        ("Released under CC0.", ["CC0"]),
        ("Available under CC0 1.0 Universal.", ["CC0-1.0"]),
        ("Released under Creative Commons Attribution 4.0.", ["CC-attribution-4.0"]),
    ],
)
def test_creative_commons_in_short(text, licenses):
    assert licences.scan_text(text)[2:] == (licenses, 0)


APACHE = """Copyright 2020 Acme
Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
MIT = """MIT

Copyright (c) 2020 Acme
Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files, to deal in it
without restriction.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of it.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of fitness.
"""


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
@pytest.mark.parametrize(("text", "licenses"), [(APACHE, ["Apache-2.0"]), (MIT, ["MIT"]), (GPL, ["GPL-3"])])
def test_wrapped_headers(text, licenses, mark):
    assert licences.scan_text("".join(f"{mark}{line}\n" for line in text.splitlines()))[2:] == (licenses, 0)


@pytest.mark.parametrize(
    ("text", "licenses"),
    [
        ("This software is released under the MIT License.", ["MIT"]),
        ("The code is licensed under the BSD license.", ["BSD"]),
        ('Licensed under the Apache License, Version 2.0 (the "License");', ["Apache-2.0"]),
        ("Some title\nReleased under the MIT License\nMore words here", ["MIT"]),
        ("Licensed under the Apache License,\nVersion 2.0. More.", ["Apache-2.0"]),
        ("This project is distributed under the\nMozilla Public License, version 2.0.", ["MPL-2.0"]),
    ],
)
def test_subjects_and_wraps(text, licenses):
    assert licences.scan_text(text)[2:] == (licenses, 0)


MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at some place.
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to use it.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice appears.
"""


@pytest.mark.parametrize("mark", ["", "# ", " * "])
@pytest.mark.parametrize(("text", "licenses"), [(MPL, ["MPL-2.0"]), (UNLICENSE, ["Unlicense"]), (ISC, ["ISC"])])
def test_more_headers(text, licenses, mark):
    assert licences.scan_text("".join(f"{mark}{line}\n" for line in text.splitlines()))[2] == licenses


@pytest.mark.parametrize("text", ["\u00a9 2020 Foo Corp", "(c) 2020 Foo"])
def test_marks_alone_are_cues(text):
    assert licences.scan_text(text)[1] == ["copyright"]


def test_cues_over_odd_white_space():
    assert licences.scan_text("This work is in the public\tdomain.")[2] == ["public-domain"]


def test_query_equals_a_scan_without_cues(spark, docs, data, monkeypatch):
    got = sorted((str(r["doc_id"]), r["n_sentences"], r["sentence_ids"], r["licenses"], r["n_unmatched"]) for r in licences.scan(docs).collect())
    monkeypatch.setattr(licences, "CUES", ("",))
    want = []
    for d, t, *_ in data:
        n, ids, found, odd = licences.scan_text(t or "")
        want.append((str(d), n, ",".join(ids), ",".join(found), odd))
    assert [x[2:] for x in got] == [x[2:] for x in sorted(want)]

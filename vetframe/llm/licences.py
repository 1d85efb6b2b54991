"""License scans by sentence-rule recognition.

A text is cut into sentences, which are normalised (lower case, single spaces,
no marks at the ends).  A line end ends a sentence, unless the lines of a paragraph,
without their comment marks, make a known sentence together.  ``SENTENCES`` maps a normalised sentence to the
identifier of a known license sentence, with the version it names, if any.  The
sequence of identifiers is then read from the left: at each place the first of
the ordered ``RULES`` whose identifiers stand there, one after another, gives a
license and takes them.  A license sentence that no rule takes, or that is
unknown though it speaks of a license, is reported as such.

Every known sentence holds one of ``CUES``; a text that holds none, its white
space taken as single spaces, is passed over without cutting it, which changes
no result.

Defined results: null and empty texts have no sentence and no license; the same
license found again is listed once; repeated rows and ids are scanned alike, and
a null id passes through; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

CUES = ("licen", "copyright", "warrant", "redistribut", "permission", "public domain", "all rights reserved", "spdx", "creative commons", "cc by", "cc-by", "cc0", "cc-0", "cc 0", "(c)", "\u00a9")
#: What a sentence that names a license begins with, and the term that it may define.
_UNDER = r"(?:(?:this|the) (?:[a-z]+ ){1,3}?(?:is|are) )?(?:released|distributed|licensed|available) under "
_TERM = r"(?: \(the [\"'\u201c\u2018]?licen[cs]e[\"'\u201d\u2019]?\))?"
#: Pattern of a whole normalised sentence and its identifier; a group named v is a version.
SENTENCES = [
    (r"spdx-license-identifier: (?P<v>[a-z0-9.+-]+)", "spdx"),
    (_UNDER + r"(?:the )?(?:terms of the )?mit licen[cs]e" + _TERM, "mit-name"),
    (r"permission is hereby granted, free of charge, to any person obtaining a copy of this software.*", "mit-grant"),
    (r"the above copyright notice and this permission notice shall be included in all copies.*", "mit-notice"),
    (_UNDER + r"(?:the )?(?:terms of the )?apache (?:software )?licen[cs]e(?:,? version| v)?(?: (?P<v>[0-9.]+))?" + _TERM, "apache-name"),
    (r"you may not use this (?:file|work|software) except in compliance with the licen[cs]e", "apache-comply"),
    (r"you may obtain a copy of the licen[cs]e at.*", "licence-place"),
    (r"unless required by applicable law or agreed to in writing, software distributed under the licen[cs]e is distributed on an \"?as is\"? basis.*", "apache-warranty"),
    (_UNDER + r"(?:the )?(?:terms of the )?gnu (?P<k>lesser |affero )?general public licen[cs]e(?:,? version| v)?(?: (?P<v>[0-9.]+))?(?P<l>,? or \(?at your option\)? any later version)?" + _TERM, "gpl-name"),
    (r"this program is free software: you can redistribute it.*gnu (?P<k>lesser |affero )?general public licen[cs]e.*version (?P<v>[0-9.]+).*", "gpl-grant"),
    (r"this program is distributed in the hope that it will be useful, but without any warranty.*", "gpl-warranty"),
    (r"redistribution and use in source and binary forms, with or without modification, are permitted.*", "bsd-grant"),
    (r"redistributions of source code must retain the above copyright notice.*", "bsd-source"),
    (r"redistributions in binary form must reproduce the above copyright notice.*", "bsd-binary"),
    (_UNDER + r"(?:the |a )?(?:terms of the )?(?:(?P<v>[234])-clause )?bsd licen[cs]e" + _TERM, "bsd-name"),
    (_UNDER + r"(?:the |a )?creative commons (?P<k>[a-z ()-]*?)(?: ?licen[cs]e)?,?(?: version)?(?: (?P<v>[0-9.]+))?(?: international)?(?: licen[cs]e)?" + _TERM, "cc-name"),
    (_UNDER + r"(?:the |a )?(?:terms of the )?cc[ -](?P<k>by(?:[ -](?:nc|sa|nd))*)(?: licen[cs]e)?(?:,? version|[ -]v)?(?:[ -]?(?P<v>[0-9][0-9.]*))?(?: international| unported)?(?: licen[cs]e)?" + _TERM, "cc-name"),
    (_UNDER + r"(?:the |a )?(?:terms of the )?cc[ -]?0(?: licen[cs]e)?(?:,? version|[ -]v)?(?:[ -]?(?P<v>[0-9][0-9.]*))?(?: universal)?(?: licen[cs]e)?" + _TERM, "cc0-name"),
    (_UNDER + r"(?:the )?(?:terms of the )?mozilla public licen[cs]e(?:,? version| v)?(?: (?P<v>[0-9.]+))?" + _TERM, "mpl-name"),
    (r"this source code form is subject to the terms of the mozilla public licen[cs]e, v\. (?P<v>[0-9.]+)", "mpl-form"),
    (r"if a copy of the mpl was not distributed with this file, you can obtain one at.*", "mpl-place"),
    (r"this is free and unencumbered software released into the public domain", "unlicense"),
    (r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted.*", "isc-grant"),
    (r"this software is provided ['\"\u2018]as-is['\"\u2019],? without any express or implied warranty.*", "zlib-warranty"),
    (r"permission is granted to anyone to use this software for any purpose, including commercial applications.*", "zlib-grant"),
    (_UNDER + r"the boost software licen[cs]e(?:,? version| v)?(?: (?P<v>[0-9.]+))?" + _TERM, "boost-name"),
    (_UNDER + r"(?:the )?(?:terms of the )?eclipse public licen[cs]e(?:,? version| v| -)?(?: v)?(?: ?(?P<v>[0-9.]+))?" + _TERM, "epl-name"),
    (_UNDER + r"(?:the )?(?:terms of the )?isc licen[cs]e" + _TERM, "isc-name"),
    (r"(?:this (?:work|text|file|software) is |released into )(?:in )?the public domain", "public-domain"),
    (r"all rights reserved", "all-rights"),
    (r"(?:copyright|\(c\)|©).*", "copyright"),
]
#: Identifiers in order, and the license they make; the first that fits wins.
RULES = [
    (("mit-grant", "mit-notice"), "MIT"),
    (("apache-name", "apache-comply", "licence-place", "apache-warranty"), "Apache"),
    (("apache-name", "apache-comply", "licence-place"), "Apache"),
    (("gpl-grant", "gpl-warranty"), "GPL"),
    (("bsd-grant", "bsd-source", "bsd-binary"), "BSD"),
    (("mpl-form", "mpl-place"), "MPL"),
    (("zlib-warranty", "zlib-grant"), "Zlib"),
    (("spdx",), "SPDX"),
    (("mit-name",), "MIT"),
    (("mit-grant",), "MIT"),
    (("apache-name",), "Apache"),
    (("gpl-name",), "GPL"),
    (("gpl-grant",), "GPL"),
    (("bsd-name",), "BSD"),
    (("bsd-grant",), "BSD"),
    (("cc-name",), "CC"),
    (("cc0-name",), "CC0"),
    (("mpl-name",), "MPL"),
    (("mpl-form",), "MPL"),
    (("unlicense",), "Unlicense"),
    (("isc-grant",), "ISC"),
    (("isc-name",), "ISC"),
    (("zlib-grant",), "Zlib"),
    (("boost-name",), "Boost"),
    (("epl-name",), "EPL"),
    (("public-domain",), "public-domain"),
    (("copyright", "all-rights"), "all-rights-reserved"),
    (("all-rights",), "all-rights-reserved"),
]
_CUT = re.compile(r"(?<=[.!?])(?<! v\.)\s+|[\r\n]+")
#: Ends of a sentence in a line: its mark (but for that of "v. 2.0"), or the semicolon behind a defined term.
_STOP = re.compile(r"(?<=[.!?])(?<! v\.)\s+|(?<=\);)\s+")
#: What a known sentence begins with.
_OPENS = re.compile(r"spdx|if a copy|permission|the\b|this\b|you\b|unless|redistribution|released|distributed|licensed|available|all rights|copyright|\(c\)|©")
#: The longest wrapped sentence that is tried at each of its line ends; longer ones are tried whole.
_LONG = 1000
_SPACES = re.compile(r"\s+")
_KNOWN = [(re.compile(p), name) for p, name in SENTENCES]


def normalise(sentence: str) -> str:
    return re.sub(r"\s+", " ", sentence.lower()).strip(" \t*#/-.!?;:")


def identify(sentence: str) -> tuple[str, str] | None:
    """Identifier and version (with what qualifies it) of a normalised sentence; None if it is no known one."""
    for pattern, name in _KNOWN:
        if m := pattern.fullmatch(sentence):
            of = m.groupdict()
            kind = re.sub(r"[^a-z]+", "-", (of.get("k") or "").strip()).strip("-")
            version = (of.get("v") or "").strip(".")
            return name, "-".join(x for x in (kind, version, "or-later" if of.get("l") else "") if x)
    return None


def pieces(text: str) -> list[tuple[str, bool]]:
    """Parts of sentences as lines hold them, without comment marks, and whether a sentence ends there."""
    out: list[tuple[str, bool]] = []
    for line in re.split(r"\r\n|[\r\n]", text):
        parts = [p for p in _STOP.split(line.strip()) if normalise(p)]
        if not parts and out:
            out[-1] = (out[-1][0], True)  # an empty line ends a paragraph
        for i, part in enumerate(parts):
            part = part.lstrip(" \t*#/-;<!").rstrip(" \t*#/")
            out.append((part, i + 1 < len(parts) or part.endswith((".", "!", "?", ");"))))
    return out


def join_wrapped(parts: list[tuple[str, bool]]) -> list[tuple[str, tuple[str, str] | None]]:
    """Normalised sentences with their identifier; lines are joined where that makes a known sentence, the longest that does."""
    alone = [normalise(p) for p, _ in parts]
    found = [identify(s) if _OPENS.match(s) else None for s in alone]
    out, at = [], 0
    while at < len(parts):
        sentence, hit, to = alone[at], found[at], at + 1
        if _OPENS.match(sentence) and not (hit and hit[0] in ("copyright", "all-rights")):
            end = at + 1  # the sentence goes on to its mark or to the next known one
            while end < len(parts) and not parts[end - 1][1] and not found[end]:
                end += 1
            size, ends = len(parts[at][0]), [end]
            for k in range(at + 2, end):
                size += len(parts[k - 1][0]) + 1
                if size > _LONG:
                    break
                ends.insert(1, k)
            for k in ends:
                joined = normalise(" ".join(p for p, _ in parts[at:k])) if k > at + 1 else ""
                if joined and (more := identify(joined)) and more[0] != "copyright":
                    sentence, hit, to = joined, more, k
                    break
        out.append((sentence, hit))
        at = to
    return out


def scan_text(text: str) -> tuple[int, list[str], list[str], int]:
    """Sentences, identifiers of the known ones, licenses in order, and license sentences that no rule takes."""
    low = _SPACES.sub(" ", text.lower())
    if not any(cue in low for cue in CUES):
        return sum(1 for s in _CUT.split(text) if normalise(s)), [], [], 0
    sentences = join_wrapped(pieces(text))
    known = [f for _, f in sentences if f]
    unknown = sum(1 for s, f in sentences if f is None and "licen" in s)
    licenses, at = [], 0
    while at < len(known):
        for ids, license_ in RULES:
            if tuple(k[0] for k in known[at : at + len(ids)]) == ids:
                version = next((k[1] for k in known[at : at + len(ids)] if k[1]), "")
                name = f"{license_}-{version}" if version else license_
                if name not in licenses:
                    licenses.append(name)
                at += len(ids)
                break
        else:
            unknown += known[at][0] != "copyright"
            at += 1
    return len(sentences), [k[0] for k in known], licenses, unknown


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, sentence_ids (in order), licenses, n_unmatched of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                out = [scan_text(t or "") for t in part.column(1).to_pylist()]
                n, ids, licenses, unknown = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array([",".join(x) for x in ids], pa.string()), pa.array([",".join(x) for x in licenses], pa.string()), pa.array(unknown, pa.int64())],
                    ["doc_id", "n_sentences", "sentence_ids", "licenses", "n_unmatched"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_sentences long, sentence_ids string, licenses string, n_unmatched long")

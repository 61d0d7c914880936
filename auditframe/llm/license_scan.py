"""License scan by sentence rules.

A text is cut into sentences (stops before a blank or line end, and lines without a word), each is normalised (lower case, every run of
other characters than letters, digits and dots between digits is one blank), and known sentences get an identifier; values such as
versions are kept with it.  Single line ends and blanks after ':' or ';' only divide a sentence into pieces: a known sentence starts at
any piece and runs over as many as it needs, so hard-wrapped texts are read like texts on one line.  A pattern that ends with .* goes on
to the end of the sentence or the next piece that starts a known one; a copyright line is one piece.
Then ordered rules consume the sequence of identifiers from left to right: the first rule whose identifiers stand next to each other
(sentences that are no licence sentence do not count as a gap when they have fewer than GAP_WORDS words) names the licence, and what
remains after a consumed match is matched again.  Known sentences that no rule uses are reported as UNKNOWN, copyright lines aside.

Every known sentence holds one of ANCHORS, so other sentences are not looked at any closer; no text is cut.  Null and empty texts have
no sentence; repeated rows get equal results; ids are not used.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import query, table

V = r"(?: (?:version|v) ?| )(\d+(?:\.\d+)*)"
FREE = r"this (?:program|library|software) is free software you can redistribute it and or modify it under the terms of the gnu "
GPL_TAIL = r"general public license(?: as published by the free software foundation)?(?: either)?" + f"(?:{V})?.*"
#: (identifier, pattern of a whole normalised sentence); the first that fits names the sentence.
SENTENCES = [
    ("copyright", r"(?:copyright|c copyright|portions copyright)\b.*"),
    ("all_rights", r"all rights reserved"),
    ("apache_short", r"(?:this (?:work|file|project|software) is )?licensed under (?:the )?apache license" + f"(?:{V})?(?: the license)?"),
    ("apache_comply", r"you may not use this file except in compliance with the license"),
    ("apache_obtain", r"you may obtain a copy of the license at.*"),
    ("apache_asis", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis.*"),
    ("mit_short", r"(?:this (?:work|file|project|software) is )?(?:released|licensed|distributed) under (?:the )?(?:terms of the )?mit license"),
    ("mit_grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software.*"),
    ("mit_notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit_asis", r"the software is provided as is without warranty of any kind.*"),
    ("bsd_grant", r"redistribution and use in source and binary forms with or without modification are permitted.*"),
    ("bsd_source", r"(?:1 )?redistributions of source code must retain.*"),
    ("bsd_binary", r"(?:2 )?redistributions in binary form must reproduce.*"),
    ("bsd_endorse", r"(?:3 )?neither the name of .* may be used to endorse or promote products.*"),
    ("gpl_affero", r"(?:this .{1,40} is )?(?:licensed|released) under (?:the )?gnu affero general public license" + f"(?:{V})?"),
    ("gpl_lesser", r"(?:this .{1,40} is )?(?:licensed|released) under (?:the )?gnu lesser general public license" + f"(?:{V})?"),
    ("gpl_short", r"(?:this .{1,40} is )?(?:licensed|released) under (?:the )?gnu general public license" + f"(?:{V})?"),
    ("agpl_free", FREE + "affero " + GPL_TAIL),
    ("lgpl_free", FREE + "(?:lesser|library) " + GPL_TAIL),
    ("gpl_free", FREE + GPL_TAIL),
    ("gpl_hope", r"this (?:program|library|software) is distributed in the hope that it will be useful.*"),
    ("gpl_copy", r"you should have received a copy of the gnu (?:affero |lesser |library )?general public license.*"),
    ("cc", r"(?:this .{1,40} is )?licensed under (?:a |the )?(?:cc|creative commons) (by(?: nc| sa| nd)*)" + f"(?:{V})?"),
    ("cc0", r"(?:this .{1,40} is )?(?:licensed|released|dedicated) (?:under|to) (?:the )?(?:cc0|public domain).*"),
    ("isc_grant", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc_asis", r"the software is provided as is and the author disclaims all warranties with regard to this software.*"),
    ("zlib_asis", r"this software is provided as is without any express or implied warranty"),
    ("zlib_liable", r"in no event will the authors be held liable.*"),
    ("zlib_grant", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions.*"),
    ("boost_short", r"distributed under the boost software license" + f"(?:{V})?.*"),
    ("boost_grant", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license.*"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse public license" + f"(?:{V})?.*"),
    ("artistic_short", r"(?:this .{1,40} is )?(?:released|licensed|distributed) under (?:the )?(?:terms of the )?artistic license" + f"(?:{V})?"),
    ("isc_short", r"(?:this .{1,40} is )?(?:released|licensed|distributed) under (?:the )?(?:terms of the )?isc license"),
    ("bsd_short", r"(?:this .{1,40} is )?(?:released|licensed|distributed) under (?:the |a )?(?:terms of the )?(?:bsd )?([23]) clause (?:bsd )?license"),
    ("mpl", r"this source code form is subject to the terms of the mozilla public license" + f"(?:{V})?"),
    ("other", r"(?:this .{1,60} is )?(?:licensed|sublicensed) under .*"),
]
#: A known sentence holds at least one of these words.
ANCHORS = ["copyright", "reserved", "license", "licensed", "sublicensed", "released", "distributed", "dedicated", "permission", "redistribution", "redistributions", "endorse", "warranty", "warranties", "liable"]
#: (licence, identifiers in order); earlier rules win.  {} stands for the value of the first sentence.
RULES = [
    ("Apache-{}", ["apache_short", "apache_comply", "apache_obtain", "apache_asis"]),
    ("Apache-{}", ["apache_short", "apache_obtain"]),
    ("Apache-{}", ["apache_short"]),
    ("MIT", ["mit_grant", "mit_notice", "mit_asis"]),
    ("MIT", ["mit_short"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("AGPL-{}", ["gpl_affero"]),
    ("LGPL-{}", ["gpl_lesser"]),
    ("GPL-{}", ["gpl_short"]),
    ("AGPL-{}", ["agpl_free", "gpl_hope", "gpl_copy"]),
    ("AGPL-{}", ["agpl_free"]),
    ("LGPL-{}", ["lgpl_free", "gpl_hope", "gpl_copy"]),
    ("LGPL-{}", ["lgpl_free"]),
    ("GPL-{}", ["gpl_free", "gpl_hope", "gpl_copy"]),
    ("GPL-{}", ["gpl_free"]),
    ("ISC", ["isc_grant", "isc_asis"]),
    ("ISC", ["isc_short"]),
    ("Zlib", ["zlib_asis", "zlib_liable", "zlib_grant"]),
    ("Zlib", ["zlib_asis", "zlib_grant"]),
    ("BSL-{}", ["boost_short"]),
    ("BSL-1.0", ["boost_grant"]),
    ("Unlicense", ["unlicense"]),
    ("EPL-{}", ["epl"]),
    ("Artistic-{}", ["artistic_short"]),
    ("BSD-{}-Clause", ["bsd_short"]),
    ("CC-{}", ["cc"]),
    ("CC0", ["cc0"]),
    ("MPL-{}", ["mpl"]),
]
#: Alone these name no licence and are not reported either.
SILENT = {"copyright", "all_rights", "gpl_hope", "gpl_copy", "zlib_liable"}
GAP_WORDS = 4

_ANCHOR = re.compile("|".join(sorted(ANCHORS, key=len, reverse=True)))
_CUT = re.compile(r"(?<=[.!?])(?:[\t\r\x0b\x0c ]*\n|[\t\r\x0b\x0c ]+)|\n[^\w\n]*\n")
_PIECE = re.compile(r"\n|(?<=[;:])[\t\r\x0b\x0c ]+")
_OTHER = re.compile(r"(?:(?<!\d)\.|\.(?!\d)|[^a-z0-9.])+")
#: Whether the pattern is open at its end; an open one is written without its .*
_KNOWN = [(name, re.compile(p.removesuffix(".*")), p.endswith(".*")) for name, p in SENTENCES]
#: Inside a sentence these are no copyright line.
_NO_LINE = re.compile(r"copyright (?:notices?|holders?|owners?|laws?|licenses?|and|or)\b")
LOWER = {c: c + 32 for c in range(65, 91)}


def normal(sentence: str) -> str:
    return _OTHER.sub(" ", sentence.translate(LOWER)).strip()


def known(text: str, pos: int, ends: list[int]) -> tuple[str, str, int, bool] | None:
    """Identifier and value of the known sentence that starts at pos, number of the last of ends (ends of pieces) it needs, open or not."""
    for name, pattern, goes_on in _KNOWN:
        m = pattern.match(text, pos)
        if not m:
            continue
        last = bisect_left(ends, m.end()) if goes_on else bisect_right(ends, m.end()) - 1
        while not goes_on and last >= 0 and ends[last] > pos and not (m := pattern.fullmatch(text, pos, ends[last])):
            last -= 1
        if last >= 0 and ends[last] > pos and m:
            values = [g for g in m.groups() if g]
            return name, "-".join(v.upper().replace(" ", "-") for v in values), last, goes_on
    return None


def identifiers(text: str) -> list[tuple[str, str, int]]:
    """(identifier, value, words between it and the one before) in order."""
    out, gap = [], 0
    if not _ANCHOR.search(text.translate(LOWER)):
        return out
    for sentence in _CUT.split(text):
        if not _ANCHOR.search(sentence.translate(LOWER)):
            gap += len(sentence.split())
            continue
        pieces = [(p, n) for p in _PIECE.split(sentence) if (n := normal(p)) or p.strip()]
        whole, starts, ends, at = " ".join(n for _, n in pieces if n), [], [], 0
        for _, n in pieces:
            starts.append(at), ends.append(at + len(n))
            at += len(n) + 1 if n else 0
        i, running = 0, False
        while i < len(pieces):
            k = known(whole, starts[i], ends) if pieces[i][1] and not (i and _NO_LINE.match(whole, starts[i])) else None
            if k:
                name, value, last, goes_on = k
                out.append((name, value, gap))
                gap, i, running = 0, last + 1, goes_on and name != "copyright"
            else:
                gap += 0 if running else len(pieces[i][0].split())
                i += 1
    return out


def licences(found: list[tuple[str, str, int]], rules=RULES) -> list[str]:
    """Names by the rules, in the order of the text."""
    out, i = [], 0
    while i < len(found):
        for name, ids in rules:
            seq = found[i : i + len(ids)]
            if [x[0] for x in seq] == ids and all(x[2] < GAP_WORDS for x in seq[1:]):
                out.append(name.format(seq[0][1] or "unversioned"))
                i += len(ids)
                break
        else:
            if found[i][0] not in SILENT:
                out.append("UNKNOWN")
            i += 1
    return out


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with license_ids (identifiers in order) and licenses (names in order); columns of these names are replaced."""
    docs = docs.drop("license_ids", "licenses")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, names = [], []
            for t in batch.column(text):
                found = identifiers(t.as_py() or "")
                ids.append([x[0] for x in found]), names.append(licences(found))
            lists = [pa.array(x, pa.list_(pa.string())) for x in (ids, names)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=[*batch.schema.names, "license_ids", "licenses"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, T.ArrayType(T.StringType())) for n in ("license_ids", "licenses"))]))


@query("op2_license_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scanned(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return out.select("doc_id", F.size("license_ids").cast("long").alias("n_sentences"), F.concat_ws(",", "license_ids").alias("sentence_ids"), F.concat_ws(",", "licenses").alias("licenses"))

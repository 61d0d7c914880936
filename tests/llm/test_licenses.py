"""License rules: headers as they are published, hard-wrapped, and a plain matcher that tries every run of pieces."""
import random
import re
import textwrap

import pytest

from auditframe.llm import license_scan as L

GPL = """This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by
the Free Software Foundation{mark2} either version {v} of the License, or (at your option) any later version.

This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details.

You should have received a copy of the GNU {kind}General Public License along with this {what}. If not, see <https://www.gnu.org/licenses/>."""
TEXTS = {
    "GPL-3": GPL.format(what="program", mark=":", mark2=",", kind="", v="3"),
    "GPL-2": GPL.format(what="program", mark=";", mark2=";", kind="", v="2"),
    "LGPL-2.1": GPL.format(what="library", mark=";", mark2=";", kind="Lesser ", v="2.1"),
    "AGPL-3": GPL.format(what="program", mark=":", mark2=",", kind="Affero ", v="3"),
    "ISC": """Copyright (c) 2020 A Person

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
following restrictions: the origin of this software must not be misrepresented.""",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.",
    "Artistic-2.0": "This module is released under the Artistic License 2.0.",
    "BSD-3-Clause": "This library is licensed under the 3-clause BSD license.",
}


@pytest.mark.parametrize("name", sorted(TEXTS))
@pytest.mark.parametrize("width", [30, 72, 10_000])
def test_headers(name, width):
    text = "\n\n".join(textwrap.fill(p, width) for p in TEXTS[name].split("\n\n"))
    assert set(L.licences(L.identifiers(text))) == {name}, L.identifiers(text)
    assert set(L.licences(L.identifiers("Some words before it.\n\n" + text + "\n\nand after."))) == {name}


def plain(text):
    """Identifiers by trying, at every piece, every run of pieces of its sentence against every pattern."""
    found = []
    for sentence in L._CUT.split(text):
        pieces = [n for p in L._PIECE.split(sentence) if (n := L.normal(p))]
        i = 0
        while i < len(pieces):
            runs = [" ".join(pieces[i:j]) for j in range(i + 1, len(pieces) + 1)]
            hit = None
            for name, pattern in L.SENTENCES if not (i and L._NO_LINE.match(pieces[i])) else []:
                if pattern.endswith(".*"):
                    m = re.match(pattern.removesuffix(".*"), runs[-1])
                    hit = next((k for k, r in enumerate(runs) if m and len(r) >= m.end()), None)
                else:
                    hit = next((k for k in reversed(range(len(runs))) if re.fullmatch(pattern, runs[k])), None)
                if hit is not None:
                    found.append(name)
                    break
            i += 1 if hit is None else hit + 1
    return found


def test_identifiers_equal_the_plain_matcher():
    rnd = random.Random(3)
    parts = [p for t in TEXTS.values() for p in t.split("\n\n")] + [
        "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.", "The quick brown fox; it is licensed: no.",
        "Released under the MIT License.", "A sentence without a mark", "All rights reserved.", "!!!", "This work is licensed under CC BY-SA 4.0."]
    for _ in range(300):
        text = rnd.choice([" ", "\n", "\n\n"]).join(textwrap.fill(rnd.choice(parts), rnd.choice([20, 60, 5000])) for _ in range(rnd.randint(1, 6)))
        assert [x[0] for x in L.identifiers(text)] == plain(text), text


def test_every_rule_uses_known_sentences_and_every_sentence_has_an_anchor():
    names = {n for n, _ in L.SENTENCES}
    assert {i for _, ids in L.RULES for i in ids} <= names and names - {i for _, ids in L.RULES for i in ids} - L.SILENT == {"other"}
    assert all(L._ANCHOR.search(p) or n == "unlicense" for n, p in L.SENTENCES)

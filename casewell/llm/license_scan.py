"""License notices found by conditional compression."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from casewell.llm.common import text_batches

#: Wording of public license notices.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later "
        "version."),
    "LGPL-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
        "any later version."),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version."),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission."),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "CC0-1.0": ("Licensed under CC0 1.0.",
                "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this "
                "work."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.",
                  "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.",
                        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International "
                        "License."),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0.",
                        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 "
                        "International License."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
                "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "All-Rights-Reserved": ("All rights reserved.",),
}
#: A notice holds one of these (words in lower case with one space between); every template does.
HINTS = ("licen", "copyright", "permission is", "redistribut", "public domain", "cc by", "cc0", "creative commons", "rights reserved")
#: Words that tell one license from another; a difference in one of them refuses a template.
DECIDING = frozenset("gnu lesser library affero general apache mit mozilla bsd isc clause cc cc0 by nc nd sa attribution sharealike "
                     "noncommercial noderivatives noderivs zero unmodified not no".split())
_BEFORE_NUMBER = frozenset("version v license licence gpl lgpl agpl cc bsd".split())
LEAST_WORDS = 0.85              # share of a template's words that a notice must hold in order
MOST_ADDED = 0.25               # words put in between, as a share of the template's words
REACH = 1.3                     # words looked at on either side of a hint, as a multiple of the template's words
LONE = 2                        # a matching stretch of so few words,
FAR = 4                         # so many words away from the rest, belongs to other text
_WORD = re.compile(r"[^\W_]+(?:[.\-/][^\W_]+)*")
_STEMS = ("licen", "copyright", "permission", "redistribut", "domain", "commons", "reserved")
_SHORT = re.compile(r"cc0|cc\W+by")
_END = re.compile(r"""[.:;!/"')\]]*""")
_NUMBER = re.compile(r"v?\d{1,2}(?:\.\d+)+|v\d{1,2}")


@dataclass(frozen=True)
class Template:
    """A wording of a license with a compressor that has it as raw dictionary."""

    license: str
    number: int
    words: tuple[str, ...]
    counts: Counter
    hints: frozenset[str]
    reach: int
    press: zstandard.ZstdCompressor


@dataclass(frozen=True)
class Notice:
    """A notice among the words from ``first`` to ``after``."""

    license: str
    number: int
    saved: int
    share: float
    missing: str
    added: str
    first: int
    after: int


def words_of(text: str) -> list[str]:
    """Words in lower case, without punctuation around them."""
    return [w.lower() for w in _WORD.findall(text)]


@lru_cache(maxsize=1)
def _templates() -> list[Template]:
    """All templates; their reach is rounded up, so that windows are shared by templates of like size."""
    out = []
    for name, forms in TEMPLATES.items():
        for k, text in enumerate(forms):
            words = words_of(text)
            plain = " ".join(words)
            own = zstandard.ZstdCompressionDict(f"{plain} ".encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            reach = 1 << (int(REACH * len(words)) - 1).bit_length()
            out.append(Template(name, k, tuple(words), Counter(words), frozenset(h for h in HINTS if h in plain), reach,
                                zstandard.ZstdCompressor(level=3, dict_data=own, write_content_size=False)))
    return out


@lru_cache(maxsize=1)
def _by_hint() -> dict[str, dict[int, list[int]]]:
    """Numbers of the templates that hold a hint, by their reach."""
    out: dict[str, dict[int, list[int]]] = {h: {} for h in HINTS}
    for k, t in enumerate(_templates()):
        for h in t.hints:
            out[h].setdefault(t.reach, []).append(k)
    return out


def _decides(words: list[str] | tuple[str, ...], k: int) -> bool:
    """Whether word k names a family, a version or a modifier of a license."""
    word = words[k]
    return (not DECIDING.isdisjoint(word.split("-")) or bool(_NUMBER.fullmatch(word))
            or word.isdigit() and len(word) < 3 and k > 0 and words[k - 1] in _BEFORE_NUMBER)


def differences(wording: tuple[str, ...], words: list[str]) -> tuple[float, list[str], list[str], int, int] | None:
    """Share of the wording found in order, missing and added words, and the place; None if the wording is not there.

    Refused are too few words, too many in between, and any difference in a word that decides between licenses.
    """
    steps = [x for x in SequenceMatcher(None, wording, words, autojunk=False).get_matching_blocks() if x.size]
    while len(steps) > 1 and steps[0].size <= LONE and steps[1].b - steps[0].b - steps[0].size > FAR:
        steps.pop(0)
    while len(steps) > 1 and steps[-1].size <= LONE and steps[-1].b - steps[-2].b - steps[-2].size > FAR:
        steps.pop()
    share = sum(x.size for x in steps) / len(wording)
    if share < LEAST_WORDS:
        return None
    first, after = steps[0].b, steps[-1].b + steps[-1].size
    held = {k for x in steps for k in range(x.a, x.a + x.size)}
    used = {k for x in steps for k in range(x.b, x.b + x.size)}
    missing = [k for k in range(len(wording)) if k not in held]
    added = [k for k in range(first, after) if k not in used]
    if len(added) > MOST_ADDED * len(wording):
        return None
    if any(_decides(wording, k) for k in missing) or any(_decides(words, k) for k in added) or first and words[first - 1] == "not":
        return None
    return share, [wording[k] for k in missing], [words[k] for k in added], first, after


def savings(block: str, chosen: list[int]) -> list[tuple[int, int]]:
    """Bytes saved on the block by each of the chosen templates that saves some, with its number."""
    raw = block.encode("utf-8", "surrogatepass")
    alone = len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(raw))
    saved = ((alone - len(_templates()[k].press.compress(raw)), k) for k in chosen)
    return [(n, k) for n, k in saved if n > 0]


def notices(words: list[str]) -> Iterator[Notice]:
    """The notices among words, in order and without overlap.

    Around each hint a window per reach is compressed with the templates that hold the hint and find enough of their words there;
    from the greatest saving down, the first template whose wording confirms it wins.  A window goes no further back than
    the notice before.
    """
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    plain = " ".join(words)
    places = sorted((found.start(), h) for h in HINTS for found in re.finditer(re.escape(h), plain))
    low = 0
    for place, hint in places:
        here = bisect_right(starts, place) - 1
        if here < low:
            continue
        ranked = []
        for reach, fitting in _by_hint()[hint].items():
            first = max(low, here - reach)
            window = words[first:here + reach]
            seen = Counter(window)
            chosen = [k for k in fitting if sum((seen & _templates()[k].counts).values()) >= LEAST_WORDS * len(_templates()[k].words)]
            for saved, k in savings(" ".join(window), chosen) if chosen else ():
                ranked.append((saved, len(_templates()[k].words), -k, first, window))
        for saved, _, k, first, window in sorted(ranked, key=lambda x: x[:3], reverse=True):
            t = _templates()[-k]
            found = differences(t.words, window)
            if found and first + found[3] <= here < first + found[4]:
                share, missing, added, a, b = found
                yield Notice(t.license, t.number, saved, share, " ".join(missing), " ".join(added), first + a, first + b)
                low = first + b
                break


def find(text: str) -> Iterator[tuple[int, int, Notice]]:
    """Start, number of characters and kind of every notice in a text."""
    low = text.lower()
    if not any(s in low for s in _STEMS) and not ("cc" in low and _SHORT.search(low)):
        return
    spans = [found.span() for found in _WORD.finditer(text)]
    for notice in notices([text[a:b].lower() for a, b in spans]):
        start, end = spans[notice.first][0], spans[notice.after - 1][1]
        yield start, _END.match(text, end).end() - start, notice


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License notices: ``doc_id``, ``license``, ``start``, ``n_chars``, ``saved_bytes``, ``share``, ``missing``, ``added``.

    Candidate blocks (windows of words around a hint, as wide as the templates need) are compressed with each template that
    holds the hint as zstandard raw dictionary; the size reductions rank the templates, and exact wording differences
    confirm or refuse them: a difference in version, family or modifier is another license.  Line breaks, blank lines and
    punctuation do not matter, and a text may hold many notices.  One row per notice, none for documents without.  No shuffle.

    Null and empty texts hold no notice; repeated rows give their notices again; null ids are kept; other columns are ignored;
    an empty table gives an empty result; texts of any length are scanned whole, windows are short whatever their length.
    """
    names = ["doc_id", "license", "start", "n_chars", "saved_bytes", "share", "missing", "added"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.string()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_batches(batches):
            rows = [(key, x.license, start, size, x.saved, x.share, x.missing, x.added)
                    for key, text in zip(keys.to_pylist(), texts) for start, size, x in find(text)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)] if rows
                                             else [pa.array([], k) for k in kinds], names)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        work, "doc_id bigint, license string, start bigint, n_chars bigint, saved_bytes bigint, share double, missing string, "
              "added string")

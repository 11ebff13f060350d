"""License scans by patience alignment of whole texts with license templates.

Words that occur once in the text and once in the template are anchors. The longest run of anchors in the same
order in both is kept, and the gaps between them are aligned in the same way, down to equal words at their
ends. The share of a template's words that is aligned is its coverage.

A text that holds a notice more than once, or its words elsewhere, has too few unique words. Then the alignment is
done around every occurrence of some template words: of as many of the rarest ones as could all be missing, and one more,
so that a notice of enough coverage is met by at least one. The best window counts.

A license has templates of several kinds: its name in a short notice, its opening words, and its whole text. Each kind
has a coverage of its own. A named notice needs all words of the name, next to each other. Whole texts of many words are
aligned in windows of twice their length that begin at every quarter of it.

Words are those of the class of ``text_words.PLAIN``, in lower case. Null and empty texts and templates without words give
no rows. Repeated rows give their rows again, and templates of different licenses that fit equally well are all given. Other columns are
not looked at.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import ship_package
from .license_texts import TEXTS
from .text_words import PLAIN, SPACES

COVERAGE = 0.8
#: Short notices by their public license identifiers.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause OR BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                    "the following conditions are met.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: Templates above that are the first words of the license itself.
OPENINGS = ("BSD-2-Clause OR BSD-3-Clause", "MIT")
#: Names of licenses in short notices.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2", "GNU GPL v2", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3", "GNU GPL v3", "GPLv3"],
    "MIT": ["MIT License"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
}
NOTICES = ("Released under {}", "Released under the {}", "Licensed under {}", "Licensed under the {}", "Distributed under the {}",
           "Available under the {}", "Under the terms of the {}", "Subject to the terms of the {}")
#: Templates of more words are aligned in windows.
LONG = 400
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if PLAIN[b] else SPACES[0] for b in range(256))
_FOUND = "doc_id long, license string, template string, n_words long, n_matched long, coverage double, start_word long, end_word long"


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of ``pairs`` that rises in both places; they rise in the first already."""
    tails: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        at = bisect_left(tails, b)
        before[i] = last[at - 1] if at else -1
        if at == len(tails):
            tails.append(b)
            last.append(i)
        else:
            tails[at], last[at] = b, i
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def patience(text: list[bytes], template: list[bytes]) -> list[tuple[int, int]]:
    """Places (in the text, in the template) of the aligned words, rising in both."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        needed = Counter(template[c:d])
        seen = defaultdict(list)
        for i in range(a, b):
            if needed[text[i]] == 1:
                seen[text[i]].append(i)
        where = {w: i for i, w in enumerate(template[c:d], c)}
        anchors = _increasing(sorted((p[0], where[w]) for w, p in seen.items() if len(p) == 1))
        if anchors:
            out += anchors
            edges = [(a - 1, c - 1), *anchors, (b, d)]
            gaps += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:])]
    return sorted(out)


def best_alignment(text: list[bytes], places: dict[bytes, list[int]], template: list[bytes], coverage: float) -> list[tuple[int, int]]:
    """The alignment with the most words of ``template``; empty if none has enough of them."""
    need = -(-int(coverage * len(template) * 1_000_000) // 1_000_000)
    if sum(min(n, len(places.get(w, ()))) for w, n in Counter(template).items()) < need:
        return []
    best = patience(text, template)
    if len(best) < need:
        rarest = sorted(range(len(template)), key=lambda i: (len(places.get(template[i], ())), i))[:len(template) - need + 1]
        reach = 2 * len(template)
        done: set[tuple[int, int]] = set()
        for i in rarest:
            for at in places.get(template[i], ()):
                low, high = max(at - reach, 0), min(at + reach, len(text))
                if (low, high) in done:
                    continue
                done.add((low, high))
                found = _around(text, template, low, high, at, i)
                if len(found) > len(best):
                    best = found
                if len(best) == len(template):
                    return best
    return best if len(best) >= need else []


def _around(text, template, low, high, at, i) -> list[tuple[int, int]]:
    """The alignment in which word ``i`` of the template is the text's word at ``at``."""
    left = patience(text[low:at], template[:i])
    right = patience(text[at + 1:high], template[i + 1:])
    return [*((a + low, c) for a, c in left), (at, i), *((a + at + 1, c + i + 1) for a, c in right)]


def named_alignment(text: list[bytes], places: dict[bytes, list[int]], template: list[bytes], name: int, coverage: float) -> list[tuple[int, int]]:
    """The best alignment that holds the words from ``name`` to the end of the template next to each other."""
    best: list[tuple[int, int]] = []
    size, words = len(template) - name, template[name:]
    for at in places.get(template[name], ()):
        if text[at:at + size] == words:
            found = [*patience(text[max(at - 2 * name, 0):at], template[:name]), *((k, name + k) for k in range(size))]
            low = max(at - 2 * name, 0)
            found = [(a + (low if c < name else at), c) for a, c in found]
            if len(found) > len(best):
                best = found
    return best if len(best) >= coverage * len(template) else []


def long_alignment(text: list[bytes], template: list[bytes], coverage: float) -> list[tuple[int, int]]:
    """The best alignment with a long template in windows of the text."""
    need, size = coverage * len(template), len(template)
    wanted = Counter(template)
    best: list[tuple[int, int]] = []
    for low in range(0, max(len(text) - int(need), 0) + 1, size // 4):
        part = text[low:low + 2 * size]
        if (wanted & Counter(part)).total() >= max(need, len(best) + 1):
            found = patience(part, template)
            if len(found) > len(best):
                best = [(a + low, c) for a, c in found]
    return best if len(best) >= need else []


def _all_templates(templates: dict[str, str] | None) -> list[tuple[str, str, list[bytes], int | None]]:
    """(license, kind, words, place of the name or None)."""
    out = [(k, "opening" if templates is None and k in OPENINGS else "notice", words_of(v), None) for k, v in (templates or TEMPLATES).items()]
    if templates is None:
        out += [(k, "text", words_of(v), None) for k, v in TEXTS.items()]
        out += [(k, "notice", words_of(x.format(v)), len(words_of(x.format("")))) for k, names in NAMES.items() for v in names for x in NOTICES]
    return sorted((x for x in out if x[2]), key=lambda x: x[:2])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """One row for each document, license and kind of template of at least ``coverage``; places are counted in words of the text.

    Of templates of one kind the best is given. Of licenses aligned with the same words, only those are given that have the most
    words aligned, less those that miss.
    """
    ship_package(docs.sparkSession)
    named = [(*x, Counter(x[2]), frozenset(x[2])) for x in _all_templates(templates)]
    wanted = {w for x in named for w in x[2]}
    names = [x.split()[0] for x in _FOUND.split(", ")]

    def run(batches):
        for batch in batches:
            rows, out = [], []
            for row, value in enumerate(batch.column("text")):
                words = words_of(value.as_py() or "")
                places: dict[bytes, list[int]] = {}
                for i, word in enumerate(words):
                    if word in wanted:
                        places.setdefault(word, []).append(i)
                have, here = places.keys(), {}
                for license, kind, template, name, counts, distinct in named:
                    if name is not None and template[name] not in places or sum(counts[w] for w in distinct & have) < coverage * len(template):
                        continue
                    if name is not None:
                        found = named_alignment(words, places, template, name, coverage)
                    elif len(template) > LONG:
                        found = long_alignment(words, template, coverage)
                    else:
                        found = best_alignment(words, places, template, coverage)
                    fit = 2 * len(found) - len(template)
                    if found and ((license, kind) not in here or fit > here[license, kind][0]):
                        here[license, kind] = (fit, (license, kind, len(template), len(found), len(found) / len(template), found[0][0], found[-1][0] + 1))
                best = [x for f, x in here.values() if not any(g > f and y[0] != x[0] and y[5] < x[6] and x[5] < y[6] for g, y in here.values())]
                rows += [row] * len(best)
                out += best
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())),
                                              *(pa.array(x, t) for x, t in zip(columns, types, strict=True))], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _FOUND)

"""Operator 6: licence scans by sentence rules.

A text is cut into sentences; each is normalised and looked up among known licence
sentences. The document is then the sequence of identifiers found, and ordered rules,
longer and more specific ones first, consume it from left to right.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Ends at a sign before white space (not in ``v. 2.0``) or at a blank line; a single line break may be a wrap.
_SENTENCE = re.compile(r"[^.!?;:\n]+(?:(?:[.!?;:]+(?=\S|[ ]\d)|(?<=[Ii]dentifier):|\n(?!\s*\n))[^.!?;:\n]*)*")
_LINE = re.compile(r"[^\n]+")
_WORD = re.compile(r"[^\W_]+(?:[.][0-9]+)*")

SPDX = (
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "Unlicense", "GPL-2.0-only", "GPL-2.0-or-later",
    "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later",
)

#: identifier -> wordings; letters, digits and dotted numbers count, all else is a gap.
SENTENCES: dict[str, tuple[str, ...]] = {
    "MIT-grant": ("Released under the MIT License", "Licensed under the MIT License", "This software is released under the MIT License", "This project is licensed under the terms of the MIT license"),
    "MIT-permission": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",),
    "MIT-notice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",),
    "as-is": ("The Software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement",),
    "Apache-2.0-grant": ("Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")", "This work is licensed under the Apache License, Version 2.0"),
    "Apache-compliance": ("you may not use this file except in compliance with the License",),
    "Apache-basis": ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",),
    "GPL-3.0-grant": ("This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License v3.0"),
    "GPL-2.0-grant": ("This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2"),
    "GPL-free": ("This program is free software",),
    "GPL-3.0-redistribute": ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "GPL-2.0-redistribute": ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",),
    "LGPL-3.0-grant": ("Licensed under the GNU Lesser General Public License, version 3", "This work is licensed under the GNU Lesser General Public License, version 3"),
    "AGPL-3.0-grant": ("Licensed under the GNU Affero General Public License, version 3", "This work is licensed under the GNU Affero General Public License, version 3"),
    "MPL-2.0-grant": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, version 2.0"),
    "BSD-redistribution": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "BSD-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",),
    "BSD-binary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",),
    "BSD-endorse": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "BSD-3-Clause-grant": ("Licensed under the BSD 3-Clause License", "Released under the BSD 3-Clause License"),
    "ISC-permission": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",),
    "CC-BY-NC-4.0-grant": ("Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-4.0-grant": ("Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0-grant": ("Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC0-1.0-grant": ("Licensed under CC0 1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    "LGPL-free": ("This library is free software",),
    "LGPL-3.0-redistribute": ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "LGPL-2.1-redistribute": ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version",),
    "AGPL-3.0-redistribute": ("you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "GPL-warranty": ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    "MPL-2.0-copy": ("If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0"),
    **{f"SPDX-{x}": (f"SPDX-License-Identifier: {x}",) for x in SPDX},
    "Unlicense-domain": ("This is free and unencumbered software released into the public domain",),
}

#: (licence, identifier sequence), tried in this order at each place.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("MIT-grant", "MIT-permission", "MIT-notice", "as-is")),
    ("MIT", ("MIT-permission", "MIT-notice", "as-is")),
    ("BSD-3-Clause", ("BSD-redistribution", "BSD-source", "BSD-binary", "BSD-endorse")),
    ("BSD-2-Clause", ("BSD-redistribution", "BSD-source", "BSD-binary")),
    ("Apache-2.0", ("Apache-2.0-grant", "Apache-compliance", "Apache-basis")),
    ("Apache-2.0", ("Apache-2.0-grant", "Apache-compliance")),
    ("GPL-3.0-or-later", ("GPL-free", "GPL-3.0-redistribute", "GPL-warranty")),
    ("GPL-2.0-or-later", ("GPL-free", "GPL-2.0-redistribute", "GPL-warranty")),
    ("LGPL-3.0-or-later", ("LGPL-free", "LGPL-3.0-redistribute", "GPL-warranty")),
    ("LGPL-2.1-or-later", ("LGPL-free", "LGPL-2.1-redistribute", "GPL-warranty")),
    ("AGPL-3.0-or-later", ("GPL-free", "AGPL-3.0-redistribute", "GPL-warranty")),
    ("MPL-2.0", ("MPL-2.0-grant", "MPL-2.0-copy")),
    ("GPL-3.0-or-later", ("GPL-free", "GPL-3.0-redistribute")),
    ("LGPL-3.0-or-later", ("LGPL-free", "LGPL-3.0-redistribute")),
    ("LGPL-2.1-or-later", ("LGPL-free", "LGPL-2.1-redistribute")),
    ("AGPL-3.0-or-later", ("GPL-free", "AGPL-3.0-redistribute")),
    ("GPL-2.0-or-later", ("GPL-free", "GPL-2.0-redistribute")),
    ("MIT", ("MIT-permission", "MIT-notice")),
    ("ISC", ("ISC-permission",)),
    ("MIT", ("MIT-grant",)),
    ("Apache-2.0", ("Apache-2.0-grant",)),
    ("GPL-3.0", ("GPL-3.0-grant",)),
    ("GPL-2.0", ("GPL-2.0-grant",)),
    ("LGPL-3.0", ("LGPL-3.0-grant",)),
    ("AGPL-3.0", ("AGPL-3.0-grant",)),
    ("MPL-2.0", ("MPL-2.0-grant",)),
    ("BSD-3-Clause", ("BSD-3-Clause-grant",)),
    ("CC-BY-NC-4.0", ("CC-BY-NC-4.0-grant",)),
    ("CC-BY-4.0", ("CC-BY-4.0-grant",)),
    ("CC-BY-SA-4.0", ("CC-BY-SA-4.0-grant",)),
    ("CC0-1.0", ("CC0-1.0-grant",)),
    ("Unlicense", ("Unlicense-domain",)),
    *((x, (f"SPDX-{x}",)) for x in SPDX),
)
UNKNOWN = "unknown-licence"


def normalise(sentence: str) -> str:
    """Lower-case words and dotted numbers, one space between."""
    return " ".join(_WORD.findall(sentence.lower()))


class Rules:
    """Sentence and rule tables made ready for matching."""

    def __init__(self, sentences: dict[str, tuple[str, ...]] = SENTENCES, rules: tuple[tuple[str, tuple[str, ...]], ...] = RULES) -> None:
        self.ids: dict[str, str] = {}
        for name, wordings in sentences.items():
            for w in wordings:
                self.ids[normalise(w)] = name
        self.rules = rules
        self.longest = max(map(len, self.ids), default=0)
        first = sorted({k.split(" ", 1)[0] for k in self.ids})
        self.starts = re.compile(r"\b(?:" + "|".join(map(re.escape, first)) + r")\b", re.I) if first else re.compile(r"(?!)")

    def sentences(self, text: str) -> list[tuple[str, int, int]]:
        """(identifier, start, end) of every known sentence, in the order of the text.

        A sentence that runs over lines is looked up whole, and where that is unknown line by line.
        """
        out = []
        for m in _SENTENCE.finditer(text):
            got = self._known(text, *m.span())
            if got:
                out.append(got)
            elif "\n" in m.group():
                lines = [(m.start() + x.start(), m.start() + x.end()) for x in _LINE.finditer(m.group())]
                out += [k for k in (self._known(text, *x) for x in lines) if k]
        return out

    def _known(self, text: str, start: int, end: int) -> tuple[str, int, int] | None:
        """The identifier of one sentence; its words are read until they are more than any known sentence has, whatever lies between."""
        first = _WORD.search(text, start, end)
        if not first or not self.starts.match(text, first.start(), end):
            return None
        words, size = [], -1
        for m in _WORD.finditer(text, first.start(), end):
            words.append(m.group().lower())
            size += len(words[-1]) + 1
            if size > self.longest:
                return None
        name = self.ids.get(" ".join(words))
        return None if name is None else (name, first.start(), end)

    def licences(self, ids: list[str]) -> list[str]:
        """Licences in the order in which rules consume the identifiers; an identifier that no rule takes is unknown."""
        out, i = [], 0
        while i < len(ids):
            for licence, rule in self.rules:
                if tuple(ids[i : i + len(rule)]) == rule:
                    out.append(licence)
                    i += len(rule)
                    break
            else:
                out.append(UNKNOWN)
                i += 1
        return out


def scan_licences(docs: DataFrame, rules: Rules | None = None, column: str = "licence_scan") -> DataFrame:
    """``docs`` with a struct of ``sentences`` (identifiers with character spans, in order) and ``licences``.

    Null, empty and plain texts get empty arrays; a licence comes once for each place
    where a rule matches. A column of the given name is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(rules or Rules())

    @F.arrow_udf("struct<sentences:array<struct<id:string,start:int,end:int>>,licences:array<string>>")
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        r = shared.value
        kind = pa.list_(pa.struct([("id", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for texts in batches:
            found = [r.sentences(t) if t else [] for t in texts.to_pylist()]
            spans = pa.array([[{"id": n, "start": s, "end": e} for n, s, e in f] for f in found], kind)
            names = pa.array([r.licences([n for n, _, _ in f]) if f else [] for f in found], pa.list_(pa.string()))
            yield pa.StructArray.from_arrays([spans, names], ["sentences", "licences"])

    return docs.withColumn(column, scanned(F.col("text")))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_sentences (known ones), licences (sorted, distinct, comma-joined), n_licences (matches), licensed, for every document."""
    d = scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"), column="r").select("doc_id", "r")
    return d.select(
        "doc_id",
        F.size("r.sentences").cast("long").alias("n_sentences"),
        F.array_join(F.array_sort(F.array_distinct("r.licences")), ",").alias("licences"),
        F.size("r.licences").cast("long").alias("n_licences"),
        (F.size("r.licences") > 0).alias("licensed"),
    )

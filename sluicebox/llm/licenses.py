"""Licence scan by sentence rules, as expressions only.

A text's sentences are normalised to words of a-z and 0-9, and known ones get an identifier. The identifiers, in the order of the text, are
matched against rules: a rule is a sequence of identifiers that must occur in this order. A rule that another matched rule contains is not reported.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

# Sentences of well-known licences and notices, by identifier.
SENTENCES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-ref": "Licensed under the Apache License, Version 2.0.",
    "apache-1": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-2": "you may not use this file except in compliance with the License.",
    "apache-3": "You may obtain a copy of the License at",
    "apache-4": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-5": "See the License for the specific language governing permissions and limitations under the License.",
    "bsd-1": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-2": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-3": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-4": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "cc-by-ref": "Licensed under CC BY 4.0.",
    "cc-by-nc-ref": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-ref": "Licensed under CC BY-SA 4.0.",
    "cc-by-text": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-text": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-sa-text": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-ref": "This work is dedicated to the public domain.",
    "gpl2-ref": "This work is licensed under the GNU General Public License, version 2.",
    "gpl3-ref": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-1-v2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-1-v3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-3": "See the GNU General Public License for more details.",
    "isc-1": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-ref": "Released under the MIT License.",
    "mit-1": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-2": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mpl-1": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense-1": "This is free and unencumbered software released into the public domain.",
    "warranty-1": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
}
# Rules by name; the sentences of a rule in order.
RULES = {
    "All-Rights-Reserved": [["all-rights-reserved"]],
    "Apache-2.0": [["apache-ref"], ["apache-1", "apache-2", "apache-4", "apache-5"]],
    "BSD-2-Clause": [["bsd-1", "bsd-2", "bsd-3"]],
    "BSD-3-Clause": [["bsd-1", "bsd-2", "bsd-3", "bsd-4"]],
    "CC-BY-4.0": [["cc-by-ref"], ["cc-by-text"]],
    "CC-BY-NC-4.0": [["cc-by-nc-ref"], ["cc-by-nc-text"]],
    "CC-BY-SA-4.0": [["cc-by-sa-ref"], ["cc-by-sa-text"]],
    "CC0-1.0": [["cc0-ref"]],
    "GPL-2.0": [["gpl2-ref"]],
    "GPL-2.0-or-later": [["gpl-1-v2", "gpl-2", "gpl-3"]],
    "GPL-3.0": [["gpl3-ref"]],
    "GPL-3.0-or-later": [["gpl-1-v3", "gpl-2", "gpl-3"]],
    "ISC": [["isc-1"]],
    "MIT": [["mit-ref"], ["mit-1", "mit-2", "warranty-1"]],
    "MPL-2.0": [["mpl-1"]],
    "Unlicense": [["unlicense-1"]],
}
# Other names that licence identifiers of files have.
ALSO_NAMED = {"GPL-2.0": ["GPL-2.0-only"], "GPL-3.0": ["GPL-3.0-only"]}
SPDX = {
    f"spdx-{name.lower()}": (rule, f"SPDX {name}")
    for rule in RULES
    if rule != "All-Rights-Reserved"
    for name in [rule, *ALSO_NAMED.get(rule, [])]
}
SENTENCES |= {name: text for name, (_, text) in SPDX.items()}
RULES = {rule: [*ways, *[[name] for name, (r, _) in SPDX.items() if r == rule]] for rule, ways in RULES.items()}
_ENDS = r"[.!?;:]+(\s+|$)"
#: A line that names a licence becomes a sentence of its own, which SENTENCES holds.
_SPDX_LINE, _SPDX_SENTENCE = "spdx-license-identifier:[ \t]*([a-z0-9.+-]+)", "\x01spdx {}\x01"


def normalised(sentence: str) -> list[str]:
    """The parts of a known sentence as a text would be cut: the same cuts, lower case, words of a-z and 0-9."""
    parts = re.sub(_ENDS, "\x01", sentence.lower()).split("\x01")
    return [p for p in (re.sub("[^a-z0-9]+", " ", part).strip() for part in parts) if p]


#: Every part, and every line that names a licence, holds one of these words or is the 2.0 that mpl-1 is cut at, so that other texts need no sentences.
MAY = r"(?i)spdx|licen[sc]e|copyright|redistribut|permission|rights|domain|warrant|software|(?<![a-z0-9])2[^a-z0-9]+0(?![a-z0-9])"
#: Identifier of every part; a sentence that is cut has its number after a dot from the second part on.
PARTS = {part: name if i == 0 else f"{name}.{i}" for name, text in SENTENCES.items() for i, part in enumerate(normalised(text))}
#: The identifiers that a rule asks for, with those of all parts.
SEQUENCES = {
    rule: [[PARTS[p] for name in names for p in normalised(SENTENCES[name])] for names in ways] for rule, ways in RULES.items()
}
#: Rules whose sentences another rule contains, with that rule.
CONTAINED = {
    a: [b for b in SEQUENCES if a != b and any(set(x) < set(y) for x in SEQUENCES[a] for y in SEQUENCES[b])] for a in SEQUENCES
}
_FLOW = "\x01"
#: The third clause of BSD-3-Clause names a holder: up to 20 words of a name stand between its fixed words. A name with a full stop cuts the sentence, and its
#: second half begins with ``nor the names``.
_HOLDER = "(?:neither the|nor the|the) names? (?:[a-z0-9]+ ){1,20}used to endorse or promote products derived from this software without (?:specific )?prior written permission"
_HELD = next(p for p in PARTS if PARTS[p] == "bsd-4")


def _on_lines(pattern: str) -> str:
    return re.sub(r"(?<!\[) ", r"[ \\n]", pattern)


#: Known parts over whole lines, however they are wrapped; the longest one that begins at a line comes first.
_WRAPPED = r"(?m)^(?:" + "|".join(_on_lines(p) for p in [*sorted(PARTS, key=len, reverse=True), _HOLDER]) + ")$"


def identifiers(text: Column) -> Column:
    """Known sentences of a text in order, as ``,a,b,``. A line break, also a blank line, ends a sentence; a sentence may also run over line breaks.

    Where a run of lines is a known sentence, single lines of it that are known too are named before it. The clause of a named holder counts as the one of
    the copyright holder, and a line ``SPDX-License-Identifier: X`` as the sentence ``SPDX X``.
    """
    named = F.regexp_replace(F.lower(text), _SPDX_LINE, _SPDX_SENTENCE.format("$1"))
    ended = F.regexp_replace(named, _ENDS, _FLOW)

    known = F.create_map(*[F.lit(x) for item in PARTS.items() for x in item])
    flowing = F.split(ended, _FLOW)

    def lookup(words: Column) -> Column:
        return F.element_at(known, F.regexp_replace(words, f"^{_HOLDER}$", _HELD))

    def of_run(run: Column) -> Column:
        lines = F.when(run.contains("\n"), F.split(run, "\n")).otherwise(F.array().cast("array<string>"))
        return F.filter(F.transform(F.concat(lines, F.array(F.translate(run, "\n", " "))), lookup), lambda x: x.isNotNull())

    def of_one(sentence: Column) -> Column:
        whole = F.trim(F.regexp_replace(sentence, "[^a-z0-9]+", " "))
        lines = F.regexp_replace(F.regexp_replace(sentence, "[^a-z0-9\n]+", " "), " ?\n[ \n]*", "\n")
        hit = lookup(whole)
        runs = F.regexp_extract_all(F.trim(lines), F.lit(_WRAPPED), 0)
        return F.when(hit.isNotNull(), F.array(hit)).otherwise(F.flatten(F.transform(runs, of_run)))

    return F.concat(F.lit(","), F.concat_ws(",", F.flatten(F.transform(flowing, of_one))), F.lit(","))


def _matches(sequence: Column, rule: str) -> Column:
    ways = [sequence.rlike("," + ",(?:.*,)?".join(re.escape(i) for i in way) + ",") for way in SEQUENCES[rule]]
    found = ways[0]
    for way in ways[1:]:
        found = found | way
    return found


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sentences, licenses) of every row: known sentences in order and the licences whose rules match, by name, both joined by commas.

    A null or empty text has neither. Repeated rows each give a row.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    may = F.col("text").rlike(MAY)
    known = F.when(may, identifiers(F.col("text"))).otherwise(F.lit(",,"))
    found = rows.select("doc_id", known.alias("known"))
    matched = found.select("doc_id", "known", *[_matches(F.col("known"), r).alias(r) for r in RULES])
    named = []
    for rule in RULES:
        keep = F.col(f"`{rule}`")
        for other in CONTAINED[rule]:
            keep = keep & ~F.col(f"`{other}`")
        named.append(F.when(keep, F.lit(rule)))
    return matched.select("doc_id", F.trim(F.col("known"), F.lit(",")).alias("sentences"), F.concat_ws(",", *named).alias("licenses"))

"""Licence recognition by sentences and ordered rules.

Text is cut into fragments at line ends and sentence ends, and normalised
(lower case; anything but letters and digits is one space). A run of fragments
whose joined words are a known licence sentence becomes that sentence's
identifier, so a sentence that is wrapped over lines is found; of runs that
start at one fragment the longest known one is taken. The sequence of
identifiers is matched against ordered rules: a rule is a sequence that must
occur in this order, other sentences may stand between. All rules that match
name licences, but for those whose sentences all belong to a rule before them
that matches too; a fallback rule counts only where no other does. A sentence
that names several licences (an SPDX expression) has an identifier for each.

Every known sentence contains a cue word; texts without any cue are settled in
the JVM and only the others go through Python.

Defined results: null, empty and other texts without a known sentence have
licences null and no sentences. Known sentences that match no rule give
'UNKNOWN'. A licence is listed once, in the order of the rules. Repeated sentences are listed each time. Equal rows get equal
results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SENTENCES = {
    "mit-grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit-warranty": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'],
    "apache2-grant": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'],
    "apache2-copy": ["You may obtain a copy of the License at"],
    "apache2-warranty": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl2-free": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "gpl-warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "gpl-received": ["You should have received a copy of the GNU General Public License along with this program."],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "isc-warranty": ['THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'],
    "bsd-warranty": ['THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'],
    "lgpl21-free": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "lgpl3-free": [f"This {x} is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version." for x in ("program", "library")],
    "agpl3-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "epl2-terms": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "unlicense-free": ["This is free and unencumbered software released into the public domain."],
    "mpl2-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "mpl2-form": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "copyright-reserved": ["All rights reserved."],
}

#: Identifier of the sentences that only name a licence, by SPDX identifier, and the names it goes by.
NAMES = {
    "GPL-3.0-only": ("gpl3-name", ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"]),
    "GPL-2.0-only": ("gpl2-name", ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"]),
    "GPL-3.0-or-later": ("gpl3l-name", []),
    "GPL-2.0-or-later": ("gpl2l-name", []),
    "LGPL-3.0-only": ("lgpl3-name", ["GNU Lesser General Public License v3.0", "GNU LGPL v3", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"]),
    "LGPL-2.1-only": ("lgpl21-name", ["GNU Lesser General Public License v2.1", "GNU LGPL v2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"]),
    "LGPL-3.0-or-later": ("lgpl3l-name", []),
    "LGPL-2.1-or-later": ("lgpl21l-name", []),
    "AGPL-3.0-only": ("agpl3-name", ["GNU Affero General Public License v3.0", "GNU AGPL v3", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"]),
    "AGPL-3.0-or-later": ("agpl3l-name", []),
    "Apache-2.0": ("apache2-name", ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License", "Apache License Version 2.0, January 2004"]),
    "MIT": ("mit-name", ["MIT License", "MIT license (MIT)", "The MIT License (MIT)", "The MIT License"]),
    "BSD-3-Clause": ("bsd3-name", ["BSD 3-Clause License", "3-Clause BSD License", "BSD License", "BSD"]),
    "BSD-2-Clause": ("bsd2-name", ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"]),
    "ISC": ("isc-name", ["ISC License"]),
    "MPL-2.0": ("mpl2-name", ["Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0"]),
    "EPL-2.0": ("epl2-name", ["Eclipse Public License 2.0", "Eclipse Public License - v 2.0"]),
    "Unlicense": ("unlicense-name", ["The Unlicense"]),
    "CC-BY-NC-4.0": ("ccbync4-name", ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 4.0 International Public License"]),
    "CC-BY-SA-4.0": ("ccbysa4-name", ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0 International Public License"]),
    "CC-BY-4.0": ("ccby4-name", ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0 International Public License"]),
    "CC0-1.0": ("cc0-name", ["CC0 1.0", "CC0 1.0 Universal License"]),
}
FRAMES = ["Licensed under {}.", "Licensed under the {}.", "Released under {}.", "Released under the {}.", "This project is licensed under the {}.", "This work is licensed under the {}.", "This work is licensed under a {}.", "License: {}"]

for _spdx, (_id, _names) in NAMES.items():
    # A name alone is a sentence where it says that it is a licence's.
    SENTENCES[_id] = [f.format(n) for n in [*_names, _spdx] for f in FRAMES] + [n for n in _names if "licen" in n.lower()] + [f"SPDX-License-Identifier: {_spdx}"]
    for _other, (_second, _) in NAMES.items():
        if _other != _spdx:
            SENTENCES[f"{_id} {_second}"] = [f"SPDX-License-Identifier: {_spdx} {op} {_other}" for op in ("OR", "AND")]

#: More specific sequences stand before those that they contain.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("Apache-2.0", ["apache2-grant", "apache2-copy", "apache2-warranty"]),
    ("Apache-2.0", ["apache2-grant"]),
    ("LGPL-3.0-or-later", ["lgpl3-free"]),
    ("LGPL-2.1-or-later", ["lgpl21-free"]),
    ("AGPL-3.0-or-later", ["agpl3-free"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-warranty"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-2.0-or-later", ["gpl2-free"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("ISC", ["isc-grant"]),
    ("MPL-2.0", ["mpl2-form"]),
    ("EPL-2.0", ["epl2-terms"]),
    ("Unlicense", ["unlicense-free"]),
    *[(spdx, [name]) for spdx, (name, _) in NAMES.items()],
    ("PROPRIETARY", ["copyright-reserved"]),
]
#: Rules from this one on count only where no rule before them does.
FALLBACK = len(RULES) - 1
CUES = ["licen", "permission", "warrant", "copyright", "redistribut", "rights", "public domain", "mpl", "released under"]

_NOISE = re.compile(r"[\W_]+")
_FRAGMENT = re.compile(r"\n|(?<=[.!?:;])\s+")


def normalise(text: str) -> str:
    return _NOISE.sub(" ", text.lower()).strip()


def fragments(text: str) -> list[str]:
    return [f for f in (normalise(x) for x in _FRAGMENT.split(text)) if f]


def _catalogue() -> tuple[dict[str, str], frozenset[str]]:
    """Identifier by normalised sentence, and all beginnings of sentences that end between words."""
    known, begins = {}, set()
    for name, variants in SENTENCES.items():
        for v in variants:
            s = normalise(v)
            assert any(c in s for c in CUES) and known.setdefault(s, name) == name, v
            w = s.split(" ")
            begins.update(" ".join(w[:k]) for k in range(1, len(w)))
    return known, frozenset(begins)


KNOWN, BEGINS = _catalogue()


def sentence_ids(text: str) -> list[str]:
    parts, out, i = fragments(text), [], 0
    while i < len(parts):
        joined, j, found = parts[i], i, None
        while True:
            if joined in KNOWN:
                found = (KNOWN[joined], j)
            j += 1
            if joined not in BEGINS or j >= len(parts):
                break
            joined += " " + parts[j]
        if found:
            out.append(found[0])
            i = found[1] + 1
        else:
            i += 1
    return out


#: For each rule, those before it that have all its sentences.
_WIDER = [[j for j in range(k) if set(seq) <= set(RULES[j][1])] for k, (_, seq) in enumerate(RULES)]


def match(ids: list[str]) -> tuple[list[str], list[int]]:
    """(licences, numbers of their rules) of an identifier sequence."""
    if not ids:
        return [], []
    fits = set()
    for k, (_, rule) in enumerate(RULES):
        it = iter(ids)
        if all(x in it for x in rule) and not (k >= FALLBACK and fits):
            fits.add(k)
    found = [k for k in sorted(fits) if not fits.intersection(_WIDER[k])]
    return list(dict.fromkeys(RULES[k][0] for k in found)) or ["UNKNOWN"], found


def _scan(texts: pa.Array) -> pa.Array:
    ids = [" ".join(sentence_ids(t.as_py())) if t.is_valid else "" for t in texts]
    found = [match(i.split()) for i in ids]
    return pa.StructArray.from_arrays([pa.array([", ".join(f[0]) or None for f in found], pa.string()), pa.array([" ".join(map(str, f[1])) for f in found], pa.string()), pa.array(ids, pa.string())], ["licenses", "rules", "sentences"])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, licenses, rules, sentences) of every document: licences by comma, numbers of their rules and sentence identifiers by space."""
    common.tune(docs.sparkSession)
    low = F.lower("text")
    cue = low.contains(CUES[0])
    for c in CUES[1:]:
        cue = cue | low.contains(c)
    found = F.arrow_udf(_scan, "licenses string, rules string, sentences string")(F.when(cue, F.col("text")))
    return docs.select("doc_id", found.alias("r")).select("doc_id", "r.licenses", "r.rules", "r.sentences")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))


def oracle() -> str:
    """SQL for texts whose licence sentences are not wrapped over lines; wrapped ones are tested without SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({q(s)}, {q(i)})" for s, i in KNOWN.items())
    rules = ", ".join(f"({k}, {q(name)}, {q('% ' + ' %'.join(x + ' ' for x in seq).strip() + ' %')})" for k, (name, seq) in enumerate(RULES))
    wider = ", ".join(f"({k}, {j})" for k, js in enumerate(_WIDER) for j in js)
    return f"""
with known(s, id) as (values {known}), rules(k, license, pattern) as (values {rules}), wider(k, j) as (values {wider}),
t as (select doc_id, regexp_replace(text, '(?i)(spdx-license-identifier|license):[ \\t]+', '\\1 ', 'g') as text from documents),
f as (select doc_id, i, trim(regexp_replace(lower(fs[i + 1]), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) as s
      from (select doc_id, fs, unnest(range(0, len(fs))) as i from (select doc_id, string_split(regexp_replace(text, '([.!?:;])\\s+', '\\1' || chr(10), 'g'), chr(10)) as fs from t))),
g as (select doc_id, string_agg(id, ' ' order by i) as ids from f join known using (s) group by doc_id),
m as (select doc_id, k, license from g join rules on ' ' || ids || ' ' like pattern),
a as (select * from m where k < {FALLBACK} or doc_id not in (select doc_id from m where k < {FALLBACK})),
n as (select a.* from a where not exists (select 1 from wider w join a b on b.k = w.j where w.k = a.k and b.doc_id = a.doc_id)),
o as (select doc_id, license, min(k) as k from n group by 1, 2),
r as (select doc_id, string_agg(license, ', ' order by k) as licenses from o group by doc_id),
p as (select doc_id, string_agg(cast(k as varchar), ' ' order by k) as rules from n group by doc_id)
select d.doc_id, case when g.ids is null then null else coalesce(r.licenses, 'UNKNOWN') end as licenses, coalesce(p.rules, '') as rules, coalesce(g.ids, '') as sentences
from documents d left join g using (doc_id) left join r using (doc_id) left join p using (doc_id)
"""


ORACLE = oracle()

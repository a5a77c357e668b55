"""Licence recognition by sentence rules.

A text is normalised to lower-case letters, digits, dots, slashes and dashes with single spaces. Sentences end at
sentence marks before a space and at empty lines; comment leaders and other marks around a line end don't count. A known
sentence is found where it fills whole lines, one or several: so a hard-wrapped sentence is known, and so is one that
stands on a line of its own between others without marks. What remains of a text is the sequence of its known sentence
identifiers. A rule names identifiers that must follow each other in that order, with nothing known between
them; rules are tried in the order given, and identifiers that an earlier rule has used are gone for later ones.

Everything happens within a row: no shuffle, no Python.

Defined results: null and empty texts have no sentence and no licence; a sentence that no rule uses shows in
`unmatched`; repeated sentences in a row count once; columns of docs named like the results are replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonflow.llm.common import fresh


def key(sentence: str) -> str:
    """A sentence as it stands in a normalised text."""
    return re.sub(r"[^a-z0-9./-]+", " ", sentence.lower()).strip(" ./-")


# Sentences of common licences as they are written there, and the licences that they make up.
_TEXTS = [
    ("MIT-brief", "Released under the MIT License"),
    ("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    (
        "MIT-grant",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
    ),
    ("MIT-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("MIT-as-is", "The software is provided as is, without warranty of any kind"),
    (
        "MIT-as-is",
        "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement"
    ),
    (
        "MIT-liable",
        "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software"
    ),
    ("Apache-2-brief", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2-head", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("Apache-comply", "You may not use this file except in compliance with the License"),
    ("Apache-copy", "You may obtain a copy of the License at"),
    ("Apache-as-is", "Distributed under the License is distributed on an \"AS IS\" BASIS"),
    (
        "Apache-as-is",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"
    ),
    ("Apache-see", "See the License for the specific language governing permissions and limitations under the License"),
    (
        "BSD-grant",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ),
    ("BSD-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    (
        "BSD-binary",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"
    ),
    (
        "BSD-name",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
    ),
    (
        "BSD-as-is",
        "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
    ),
    (
        "BSD-liable",
        "In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services"
    ),
    (
        "BSD-liable",
        "In no event shall the copyright owner or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services"
    ),
    (
        "ISC-grant",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"
    ),
    (
        "ISC-grant",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"
    ),
    (
        "ISC-as-is",
        "The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"
    ),
    ("MPL-2-terms", "This Source Code Form is subject to the terms of the Mozilla Public License, v"),
    ("MPL-2-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("MPL-2-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("GPL-free", "This program is free software"),
    ("LGPL-free", "This library is free software"),
    ("GPL-hope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    ("LGPL-hope", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    ("GPL-implied", "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("GPL-3-brief", "This work is licensed under the GNU General Public License version 3"),
    ("GPL-2-brief", "This work is licensed under the GNU General Public License version 2"),
    ("CC-BY-NC-4-brief", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4-brief", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4-brief", "Licensed under CC BY-SA 4.0"),
    ("All-rights", "All rights reserved"),
    ("Public-domain", "This file is part of the public domain"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]
_GNU = {"GPL": "General", "LGPL": "Lesser General", "AGPL": "Affero General"}
_VERSIONS = {"GPL": ["2", "3"], "LGPL": ["2.1", "3"], "AGPL": ["3"]}
_CC = {
    "CC-BY-4.0": "Attribution", "CC-BY-SA-4.0": "Attribution-ShareAlike", "CC-BY-NC-4.0": "Attribution-NonCommercial",
    "CC-BY-NC-SA-4.0": "Attribution-NonCommercial-ShareAlike", "CC-BY-ND-4.0": "Attribution-NoDerivatives",
    "CC-BY-NC-ND-4.0": "Attribution-NonCommercial-NoDerivatives"
}
_SPDX = [
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "Unlicense", "CC0-1.0", *_CC,
    *[f"{g}-{v if '.' in v else v + '.0'}-{k}" for g, vs in _VERSIONS.items() for v in vs for k in ("only", "or-later")]
]


def _gnu_sentences():
    for g, name in _GNU.items():
        terms = f"you can redistribute it and/or modify it under the terms of the GNU {name} Public License"
        yield f"{g}-terms", terms
        yield f"{g}-terms", f"{terms} as published by the Free Software Foundation"
        yield f"{g}-see", f"See the GNU {name} Public License for more details"
        for v in _VERSIONS[g]:
            for later in ("or any later version", "or (at your option) any later version"):
                yield f"GNU-{v}-later", f"either version {v} of the License, {later}"
                yield f"{g}-{v}-terms", f"{terms} as published by the Free Software Foundation, either version {v} of the License, {later}"


#: Known sentences, normalised -> identifier.
SENTENCES = {key(text): i for i, text in [
    *_TEXTS, *_gnu_sentences(),
    *[(f"{i}-deed", f"This work is licensed under a Creative Commons {name} 4.0 International License") for i, name in _CC.items()],
    *[(f"SPDX-{i}", f"SPDX-License-Identifier {i}") for i in _SPDX],
]}


def _gnu_rules():
    for g in _GNU:
        own = ["LGPL-free", "LGPL-hope"] if g == "LGPL" else ["GPL-free", "GPL-hope"]
        for v in _VERSIONS[g]:
            name = f"{g}-{v if '.' in v else v + '.0'}-or-later"
            for head in ([own[0], f"{g}-terms", f"GNU-{v}-later"], [own[0], f"{g}-{v}-terms"]):
                yield name, [*head, own[1], "GPL-implied", f"{g}-see"]
                yield name, head


#: Licence <- ordered sentence identifiers; earlier rules go first.
RULES = [
    ("Apache-2.0", ["Apache-2-head", "Apache-comply", "Apache-copy", "Apache-as-is", "Apache-see"]),
    ("Apache-2.0", ["Apache-2-head", "Apache-comply", "Apache-copy"]),
    ("MIT", ["MIT-grant", "MIT-notice", "MIT-as-is", "MIT-liable"]),
    ("MIT", ["MIT-grant", "MIT-notice", "MIT-as-is"]),
    ("MIT", ["MIT-grant", "MIT-notice"]),
    ("BSD-3-Clause", ["BSD-grant", "BSD-source", "BSD-binary", "BSD-name", "BSD-as-is", "BSD-liable"]),
    ("BSD-3-Clause", ["BSD-grant", "BSD-source", "BSD-binary", "BSD-name"]),
    ("BSD-2-Clause", ["BSD-grant", "BSD-source", "BSD-binary", "BSD-as-is", "BSD-liable"]),
    ("BSD-2-Clause", ["BSD-grant", "BSD-source", "BSD-binary"]),
    ("ISC", ["ISC-grant", "ISC-as-is"]),
    ("ISC", ["ISC-grant"]),
    ("MPL-2.0", ["MPL-2-terms", "MPL-2-copy"]),
    *_gnu_rules(),
    ("Apache-2.0", ["Apache-2-brief"]),
    ("MIT", ["MIT-brief"]),
    ("GPL-3.0", ["GPL-3-brief"]),
    ("GPL-2.0", ["GPL-2-brief"]),
    ("CC-BY-NC-4.0", ["CC-BY-NC-4-brief"]),
    ("CC-BY-SA-4.0", ["CC-BY-SA-4-brief"]),
    ("CC-BY-4.0", ["CC-BY-4-brief"]),
    *[(i, [f"{i}-deed"]) for i in _CC],
    *[(i, [f"SPDX-{i}"]) for i in _SPDX],
    ("BSD", ["BSD-grant"]),
    ("Unlicense", ["Unlicense"]),
    ("Public-domain", ["Public-domain"]),
    ("Proprietary", ["All-rights"]),
]


def normalised(text: Column) -> Column:
    """The lines of a text between line ends; an empty line stands wherever a sentence must end."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\r\n?", "\n")
    t = F.replace(t, F.lit("license-identifier:"), F.lit("license-identifier "))
    t = F.regexp_replace(t, r"(?<![\n.!?;:])[.!?;:]++(?:\s+|$)", "\n\n")
    t = F.concat(F.lit("\n"), F.regexp_replace(t, r"[^a-z0-9./\n-]+", " "), F.lit("\n"))
    return F.regexp_replace(F.regexp_replace(t, r"(?<![ ./-])[ ./-]++\n", "\n"), r"\n[ ./-]++", "\n")


def known(text: Column, catalogue: dict[str, str] = SENTENCES) -> Column:
    """The identifiers of a text's known sentences, in order; runs of one identifier count once."""
    m = F.create_map(*[F.lit(x) for kv in catalogue.items() for x in kv])
    # the longest one first: a sentence may begin like another
    listed = "|".join(s.replace(".", r"\.").replace(" ", r"[ \n]") for s in sorted(catalogue, key=len, reverse=True))
    found = F.regexp_extract_all(normalised(text), F.lit(rf"(?<=\n)(?:{listed})(?=\n)"), F.lit(0))
    ids = F.transform(found, lambda s: F.element_at(m, F.replace(s, F.lit("\n"), F.lit(" "))))
    return F.filter(F.transform(ids, lambda x, i: F.when((i == 0) | (F.get(ids, i - 1) != x), x)), lambda x: x.isNotNull())


def recognise(docs: DataFrame, text_col: str = "text", rules: list = RULES, catalogue: dict[str, str] = SENTENCES) -> DataFrame:
    """docs with sentence_ids, licences and unmatched, all arrays of strings. licences follow the order of the rules.

    A sequence is held as a string '<id><id>', in which a rule's identifiers are found and replaced as one piece, as often
    as they occur: each identifier has marks of its own on both sides, so neighbouring sequences share nothing.
    """
    out = docs.withColumn("sentence_ids", known(F.col(text_col), catalogue))
    rest = F.array_join(F.transform("sentence_ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    work = fresh(docs, "_work")
    nothing = F.array().cast("array<string>")
    steps = F.array(*[F.struct(F.lit(name).alias("licence"), F.lit("".join(f"<{i}>" for i in ids)).alias("seq")) for name, ids in rules])
    start = F.struct(rest.alias("rest"), nothing.alias("found"))

    def apply(state: Column, rule: Column) -> Column:
        hit = F.contains(state["rest"], rule["seq"])
        # '|' keeps what stood before and after a used sequence from becoming neighbours
        return F.struct(
            F.replace(state["rest"], rule["seq"], F.lit("|")).alias("rest"),
            F.when(hit, F.concat(state["found"], F.array(rule["licence"]))).otherwise(state["found"]).alias("found")
        )

    done = F.when(F.size("sentence_ids") > 0, F.aggregate(steps, start, apply)).otherwise(start)
    out = out.withColumn(work, done)
    unmatched = F.regexp_extract_all(F.col(f"{work}.rest"), F.lit("<([^>]*)>"), F.lit(1))
    return out.withColumn("licences", F.array_distinct(f"{work}.found")).withColumn("unmatched", unmatched).drop(work)

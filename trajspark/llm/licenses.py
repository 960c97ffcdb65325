"""Operator 8: licence scans by sentence rules, with Spark expressions only.

Texts are cut into sentences, sentences are normalised and looked up among known licence sentences, and the sequence of identifiers is matched
against ordered rules: an earlier rule takes its identifiers away from later ones. What no rule takes stays as unmatched identifiers.
"""

from __future__ import annotations

from functools import reduce
from itertools import product
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

# Licences with their names as they stand in one-sentence grants.
NAMES = {
    "MIT": ("mit license", "mit"),
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license"),
    "GPL-2.0": ("gnu general public license version 2", "gpl version 2", "gplv2"),
    "GPL-3.0": ("gnu general public license version 3", "gpl version 3", "gplv3"),
    "LGPL-2.1": ("gnu lesser general public license version 2 1", "lgpl version 2 1"),
    "LGPL-3.0": ("gnu lesser general public license version 3", "lgpl version 3"),
    "AGPL-3.0": ("gnu affero general public license version 3", "agpl version 3"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license v 2 0"),
    "BSD-2-Clause": ("bsd 2 clause license", "simplified bsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "new bsd license", "modified bsd license"),
    "ISC": ("isc license",),
    "CC0-1.0": ("cc0 1 0", "cc0 1 0 universal"),
    "CC-BY-4.0": ("cc by 4 0", "creative commons attribution 4 0 international license"),
    "CC-BY-SA-4.0": ("cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"),
    "CC-BY-NC-4.0": ("cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"),
    "CC-BY-ND-4.0": ("cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license"),
    "CC-BY-NC-SA-4.0": ("cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international license"),
}
# How one-sentence grants begin.
GRANTS = ("", "this work is ", "this file is ", "this software is ", "this program is ", "the code is ", "this project is ")
VERBS = ("licensed under the ", "licensed under ", "released under the ", "released under ", "distributed under the ", "distributed under the terms of the ")
# Sentences of whole licence texts, by identifier.
SENTENCES = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "no-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-obtain": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "apache-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache-at": "you may obtain a copy of the license at",
    "lgpl-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl21-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "agpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "isc-no-liability": "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-no-liability": "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "bsd-intro": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl-subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "reserved": "all rights reserved",
}
#: Ordered rules: (licence, identifiers in sequence). Longer sequences stand first; "grant-X" is any one-sentence grant of X.
RULES = [
    ("MIT", ("mit-grant", "mit-notice", "as-is", "no-liability")),
    ("Apache-2.0", ("grant-Apache-2.0", "apache-comply", "apache-obtain", "apache-basis", "apache-see")),
    ("Apache-2.0", ("apache-header", "apache-at", "apache-basis", "apache-see")),
    ("Apache-2.0", ("apache-header", "apache-obtain", "apache-basis", "apache-see")),
    ("BSD-3-Clause", ("bsd-intro", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is", "bsd-no-liability")),
    ("BSD-2-Clause", ("bsd-intro", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-no-liability")),
    ("BSD-3-Clause", ("bsd-intro", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-intro", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant", "isc-as-is", "isc-no-liability")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("ISC", ("isc-grant", "as-is")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope")),
    ("LGPL-3.0-or-later", ("lgpl-free", "lgpl-hope")),
    ("LGPL-2.1-or-later", ("lgpl21-free", "lgpl-hope")),
    ("AGPL-3.0-or-later", ("agpl-free", "gpl-hope")),
    ("Apache-2.0", ("apache-header",)),
    ("LGPL-3.0-or-later", ("lgpl-free",)),
    ("LGPL-2.1-or-later", ("lgpl21-free",)),
    ("AGPL-3.0-or-later", ("agpl-free",)),
    ("Apache-2.0", ("grant-Apache-2.0", "apache-comply")),
    ("MIT", ("mit-grant",)),
    ("ISC", ("isc-grant",)),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("MPL-2.0", ("mpl-subject",)),
    ("Unlicense", ("unlicense",)),
    ("BSD", ("bsd-intro",)),
] + [(name, (f"grant-{name}",)) for name in NAMES]
#: Texts without any of these words' stems hold no known sentence and are not cut at all.
STEMS = ("licen", "released", "distributed", "permi", "warrant", "redistribut", "unencumbered", "liable", "rights")
#: Every known sentence matches this.
ANCHOR = r"licen|released[^a-z0-9]+under|distributed[^a-z0-9]+under|permi|warrant|redistribut|unencumbered|liable|all[^a-z0-9]+rights"
BREAK, LINE = "\u0001", "\u0002"
#: What opens a line of a comment, and what closes one.
LEADERS = ((r"(?m)^[ \t]*(?:/\*+|\*+/|\*+|//+[/!]*|#+|;+|--+|%+|<!--+|dnl\b|REM\b)", ""), (r"(?m)[ \t]*(?:\*+/|--+>)[ \t]*$", ""))
#: A sentence ends at a full stop, question or exclamation mark, at a colon before a list, and at a blank line. What is no known sentence
#: as a whole is cut at its line feeds before capital letters too (wrapped lines stay together where they make a known sentence).
CUTS = (*LEADERS, (r"([.!?])[ \t\r\n\f]+", "$1" + BREAK), (r":[ \t\r\f]*\n[ \t\r\f]*([0-9(\-A-Z])", BREAK + "$1"), (r"[ \t\r\f]*\n[ \t\r\f]*\n[ \t\r\n\f]*", BREAK), (r"[ \t\r\f]*\n[ \t\r\n\f]*([A-Z])", LINE + "$1"))


def known_sentences() -> dict[str, str]:
    """Normalised sentence -> identifier."""
    grants = {f"{who}{verb}{name}": f"grant-{key}" for (key, names), who, verb in product(NAMES.items(), GRANTS, VERBS) for name in names}
    grants |= {f"{text} the license": key for text, key in grants.items()}  # ("the License")
    tags = {f"spdx license identifier {' '.join(key.lower().replace('-', ' ').replace('.', ' ').split())}": f"grant-{key}" for key in NAMES}
    return {**grants, **tags, **{text: key for key, text in SENTENCES.items()}}


def normalise(sentence: Column) -> Column:
    """Lower case, 'licence' spelled 'license', everything but ASCII letters and digits one space, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(sentence), "licence", "license"), "[^a-z0-9]+", " "))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_known (licence sentences), sentence_ids, licenses (comma-joined, one for each rule match, by rule), unmatched.

    Null and empty texts, and texts without a known sentence, have 0 and empty strings. Repeated rows are scanned each. The whole text is
    read; one projection without a shuffle, so no key can be hot.
    """
    known = known_sentences()
    lookup = F.map_from_arrays(F.lit(list(known)), F.lit(list(known.values())))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("t"))
    cut = F.col("t")
    for pattern, by in CUTS:
        cut = F.regexp_replace(cut, pattern, by)
    def parts(sentence: Column) -> Column:
        return F.when(F.array_contains(F.lit(list(known)), normalise(sentence)), F.array(normalise(sentence))).otherwise(F.transform(F.split(sentence, LINE, -1), normalise))

    sentences = F.flatten(F.transform(F.filter(F.split(cut, BREAK, -1), lambda s: F.lower(s).rlike(ANCHOR)), parts))
    likely = F.filter(sentences, lambda s: s.rlike(ANCHOR))
    ids = F.filter(F.transform(likely, lambda s: F.element_at(lookup, s)), lambda x: x.isNotNull())
    lower = F.lower("t")
    anchored = reduce(or_, [F.contains(lower, F.lit(stem)) for stem in STEMS])
    rows = rows.select("doc_id", F.when(anchored, ids).otherwise(F.lit([]).cast("array<string>")).alias("ids"))
    rows = rows.withColumn("state", F.struct(F.concat(F.lit(","), F.array_join(F.transform("ids", lambda x: F.concat(x, F.lit(","))), "")).alias("left"), F.lit("").alias("licenses")))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f"{i}," for i in sequence)).alias("sequence")) for name, sequence in RULES])

    def step(state: Column, rule: Column) -> Column:
        # identifiers are matched after a comma; the gap keeps what stood apart from joining
        parts = F.split(state["left"], F.concat(F.lit(",\\Q"), rule["sequence"], F.lit("\\E")), -1)
        return F.struct(F.array_join(parts, ",;,").alias("left"), F.concat(state["licenses"], F.repeat(F.concat(rule["name"], F.lit(",")), F.size(parts) - 1)).alias("licenses"))

    matched = F.when(F.size("ids") > 0, F.aggregate(rules, F.col("state"), step)).otherwise(F.col("state"))
    rows = rows.withColumn("end", matched)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_known"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.regexp_replace(F.col("end")["licenses"], ",$", "").alias("licenses"),
        F.array_join(F.filter(F.split(F.col("end")["left"], "[,;]+"), lambda x: x != ""), ",").alias("unmatched"),
    )

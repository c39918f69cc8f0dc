"""License scans by sentence rules.

A text is cut into sentences, each is normalised to its letters and digits in lower case,
and known license sentences are mapped to identifiers. The sequence of identifiers is then
matched against ordered rules: the first rule whose identifiers occur in a row names the
license and takes them out of the sequence, so a full text is not also reported as its own
short notice. Sentences that speak of a license but are not known are counted.

A known sentence may be wrapped: the line breaks inside it, with or without comment signs, count as
spaces, but not blank lines. It begins and ends at a line break, a semicolon or the end of a
sentence. What is not known is counted line by line.

All expressions are built in, and a row needs no other row: no shuffle. Texts without any of the
marking words are not cut into sentences.

Defined results: a null or empty text has no license; repeated rows are treated alike; other
columns are ignored; the table of sentences is a parameter.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfprice.llm.common import let

# Normalised sentences of well-known licenses and notices, by identifier.
SENTENCES = {
    "gpl3_work": "this work is licensed under the gnu general public license version 3",
    "gpl_program": "this program is free software you can redistribute it and or modify it under the terms of the "
                   "gnu general public license as published by the free software foundation either version 3 of the "
                   "license or at your option any later version",
    "gpl_hope": "this program is distributed in the hope that it will be useful but without any warranty without even "
                "the implied warranty of merchantability or fitness for a particular purpose",
    "gpl_see": "see the gnu general public license for more details",
    "apache2_under": "licensed under the apache license version 2 0",
    "apache2_long": "licensed under the apache license version 2 0 the license",
    "apache2_use": "you may not use this file except in compliance with the license",
    "apache2_unless": "unless required by applicable law or agreed to in writing software distributed under the license "
                      "is distributed on an as is basis without warranties or conditions of any kind either express "
                      "or implied",
    "ccbync4_under": "licensed under cc by nc 4 0",
    "ccby4_under": "licensed under cc by 4 0",
    "mit_released": "released under the mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                 "associated documentation files the software to deal in the software without restriction including "
                 "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
                 "copies of the software and to permit persons to whom the software is furnished to do so subject to "
                 "the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial "
                  "portions of the software",
    "bsd_redistribution": "redistribution and use in source and binary forms with or without modification are permitted "
                          "provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the "
                  "following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
                  "following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                 "promote products derived from this software without specific prior written permission",
    "gpl2_program": "this program is free software you can redistribute it and or modify it under the terms of the "
                    "gnu general public license as published by the free software foundation either version 2 of the "
                    "license or at your option any later version",
    "gpl2_only": "this program is free software you can redistribute it and or modify it under the terms of the "
                 "gnu general public license version 2 as published by the free software foundation",
    "lgpl21_library": "this library is free software you can redistribute it and or modify it under the terms of the "
                      "gnu lesser general public license as published by the free software foundation either version 2 1 "
                      "of the license or at your option any later version",
    "lgpl3_library": "this library is free software you can redistribute it and or modify it under the terms of the "
                     "gnu lesser general public license as published by the free software foundation either version 3 "
                     "of the license or at your option any later version",
    "agpl3_program": "this program is free software you can redistribute it and or modify it under the terms of the "
                     "gnu affero general public license as published by the free software foundation either version 3 of "
                     "the license or at your option any later version",
    # the sentence is cut behind "v."; other versions of the license are not worded so
    "mpl2_form": "this source code form is subject to the terms of the mozilla public license v",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is "
                 "hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "ccbysa4_under": "licensed under cc by sa 4 0",
    "cc0_under": "licensed under cc0 1 0",
    "cc0_waived": "to the extent possible under law the author s have dedicated all copyright and related and neighboring "
                  "rights to this software to the public domain worldwide",
}
#: Ordered rules: the license and the identifiers that must follow each other.
RULES = [
    ("GPL-3.0-or-later", ["gpl_program", "gpl_hope", "gpl_see"]),
    ("GPL-3.0-or-later", ["gpl_program"]),
    ("MIT", ["mit_grant", "mit_notice"]),
    ("Apache-2.0", ["apache2_long", "apache2_use", "apache2_unless"]),
    ("Apache-2.0", ["apache2_long", "apache2_use"]),
    ("GPL-3.0", ["gpl3_work"]),
    ("Apache-2.0", ["apache2_long"]),
    ("Apache-2.0", ["apache2_under"]),
    ("CC-BY-NC-4.0", ["ccbync4_under"]),
    ("CC-BY-4.0", ["ccby4_under"]),
    ("MIT", ["mit_released"]),
    ("MIT", ["mit_grant"]),
    ("BSD-3-Clause", ["bsd_redistribution", "bsd_source", "bsd_binary", "bsd_names"]),
    ("BSD-2-Clause", ["bsd_redistribution", "bsd_source", "bsd_binary"]),
    ("BSD", ["bsd_redistribution"]),
    ("GPL-2.0-or-later", ["gpl2_program"]),
    ("GPL-2.0", ["gpl2_only"]),
    ("LGPL-2.1-or-later", ["lgpl21_library"]),
    ("LGPL-3.0-or-later", ["lgpl3_library"]),
    ("AGPL-3.0-or-later", ["agpl3_program"]),
    ("MPL-2.0", ["mpl2_form"]),
    ("ISC", ["isc_grant"]),
    ("CC-BY-SA-4.0", ["ccbysa4_under"]),
    ("CC0-1.0", ["cc0_under"]),
    ("CC0-1.0", ["cc0_waived"]),
]
_USUAL_MARKS = "(?i)licen[sc]|permission|redistribut|free software|warrant"


def marks(known: dict[str, str]) -> str:
    """Pattern that every text with a known sentence matches, wrapped or not."""
    one_word = _USUAL_MARKS.replace("|free software", "")
    rest = [s for s in known.values() if not re.search(one_word, s)]
    return "|".join([_USUAL_MARKS, *sorted({max(s.split(), key=len) for s in rest})])


MARKS = marks(SENTENCES)
SENTENCE_END = "([.!?])[\\x20\\x09-\\x0D]+"


#: Marks between normalised pieces: end of a sentence or paragraph, line break, semicolon.
_END, _LINE, _SEMICOLON = "\x01", "\x02", "\x03"
_ANY = "\\x01-\\x03"


def normalised(text: Column) -> Column:
    """Letters and digits of a text in lower case, other signs as single spaces, and marks where pieces end."""
    plain = F.translate(text, _END + _LINE + _SEMICOLON, "   ")
    ended = F.regexp_replace(plain, SENTENCE_END, f"$1{_END}")
    ended = F.regexp_replace(ended, "\n[^\\p{L}\\p{N}\\n\\x01]*(?=\n)", _END)  # blank lines, also in comments
    marked = F.lower(F.translate(ended, "\n;", _LINE + _SEMICOLON))
    spaced = F.regexp_replace(marked, f"[^\\p{{L}}\\p{{N}}{_ANY}]+", " ")
    spaced = F.regexp_replace(F.regexp_replace(spaced, f"([{_ANY}])", " $1 "), " +", " ")
    return F.concat(F.lit(f" {_END} "), F.trim(spaced), F.lit(f" {_END} "))


def sentence_pattern(known: dict[str, str]) -> str:
    """Pattern of all known sentences between marks, the longest first; lines may break between words."""
    gap = " (?:[\\x02\\x03] )*"
    ordered = sorted(known.values(), key=lambda s: (-len(s), s))
    return f"(?<=[{_ANY}] )(?:" + "|".join(gap.join(s.split()) for s in ordered) + f")(?= [{_ANY}])"


def read(text: Column, known: dict[str, str]) -> Column:
    """``ids`` of the known sentences of a text, in order, and the pieces ``rest`` between them."""
    pattern = sentence_pattern(known)
    table = F.create_map(*[F.lit(x) for name, sentence in known.items() for x in (" ".join(sentence.split()), name)])

    def parts(whole: Column) -> Column:
        found = F.regexp_extract_all(whole, F.lit(pattern), F.lit(0))
        between = F.flatten(F.transform(F.split(whole, pattern, -1), lambda x: F.split(x, "[\\x01\\x02]", -1)))
        return F.struct(
            F.transform(found, lambda s: F.try_element_at(table, F.regexp_replace(s, f"[ {_ANY}]+", F.lit(" ")))).alias("ids"),
            between.alias("rest"))

    return let(normalised(text), parts)


def licenses(sequence: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Licenses whose rules match a sequence of identifiers, each once, in order of the rules."""
    def marked(ids: list[str]) -> str:
        return "".join(f"<{i}>" for i in ids)

    start = F.struct(
        F.array_join(F.transform(sequence, lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "").alias("left"),
        F.array().cast("array<string>").alias("found"))
    ordered = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(marked(ids)).alias("ids")) for name, ids in rules])

    def match(acc: Column, rule: Column) -> Column:
        hit = F.contains(acc["left"], rule["ids"])
        return F.struct(
            F.replace(acc["left"], rule["ids"], F.lit("#")).alias("left"),  # no rule matches across the mark
            F.when(hit, F.array_union(acc["found"], F.array(rule["name"]))).otherwise(acc["found"]).alias("found"))

    return F.aggregate(ordered, start, match, lambda acc: acc["found"])


def scan(docs: DataFrame, known: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """License names (sorted, joined by ``;``; null if none), known sentences and unknown license sentences."""
    none = F.array().cast("array<string>")
    marked = F.coalesce(F.col("text").rlike(marks(known)), F.lit(False))

    def unknown(rest: Column) -> Column:
        return F.size(F.filter(rest, lambda s: s.rlike("\\blicen[sc]e"))).cast("long")

    untouched = F.struct(none.alias("ids"), none.alias("rest"))
    rows = docs.select("doc_id", F.when(marked, read(F.col("text"), known)).otherwise(untouched).alias("made_"))
    found = rows.select("doc_id", unknown(F.col("made_.rest")).alias("n_unknown"), F.col("made_.ids").alias("ids_"))
    return found.select(
        "doc_id", F.nullif(F.array_join(F.array_sort(licenses(F.col("ids_"), rules)), ";"), F.lit("")).alias("licenses"),
        F.size("ids_").cast("long").alias("n_sentences"), "n_unknown",
        F.array_join("ids_", ";").alias("identifiers"))

"""Licence recognition by sentences: texts become sequences of sentence ids, which rules then match.

A text is cut into fragments at line ends and after ``. ! ? ; :`` before white space; fragments are
lower-cased and all but a-z and 0-9 becomes single spaces. Neighbours together, up to the words of the longest
known sentence, are looked up among these, so that lines wrapped at any width are found too; only fragments
that a known sentence begins with are joined. The ids, in text order,
are matched against the rules: a rule is an ordered list of ids with any number of other ids between
them. The first rules are the more specific ones: a licence that another found one implies is not
reported.

All of it is row-local column arithmetic without a shuffle. Only texts with one of the ``CUES`` are cut up;
every known sentence holds a cue, which is checked when the tables are built.

Defined results: a null or empty text, or one without a known sentence, has no licence (empty
string) and 0 sentences; a sentence that occurs twice counts twice; of sentences that begin at one place the shorter comes
first; texts of any length are read whole; rows are kept one for one. Other
columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of well-known licence texts and notices, normalised, with their ids.
SENTENCES = {
    "released under the mit license": 1,
    "licensed under the mit license": 2,
    "the mit license": 3,
    "mit license": 4,
    "permission is hereby granted free of charge to any person obtaining a copy of this software "
    "and associated documentation files the software to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute sublicense "
    "and or sell copies of the software and to permit persons to whom the software is furnished to "
    "do so subject to the following conditions": 5,
    "the above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the software": 6,
    "the software is provided as is without warranty of any kind express or implied including but "
    "not limited to the warranties of merchantability fitness for a particular purpose and "
    "noninfringement": 7,
    "licensed under the apache license version 2 0": 10,
    "licensed under the apache license version 2 0 the license": 11,
    "you may not use this file except in compliance with the license": 12,
    "you may obtain a copy of the license at": 13,
    "apache license version 2 0": 14,
    "this work is licensed under the gnu general public license version 3": 20,
    "this program is free software you can redistribute it and or modify it under the terms of the "
    "gnu general public license as published by the free software foundation either version 3 of "
    "the license or at your option any later version": 21,
    "this program is free software": 22,
    "you can redistribute it and or modify it under the terms of the gnu general public license as "
    "published by the free software foundation either version 3 of the license or at your option "
    "any later version": 23,
    "either version 2 of the license or at your option any later version": 24,
    "this program is free software you can redistribute it and or modify it under the terms of the "
    "gnu general public license as published by the free software foundation either version 2 of "
    "the license or at your option any later version": 25,
    "you can redistribute it and or modify it under the terms of the gnu general public license as "
    "published by the free software foundation either version 2 of the license or at your option "
    "any later version": 26,
    "you can redistribute it and or modify it under the terms of the gnu general public license "
    "version 2 as published by the free software foundation": 27,
    "this work is licensed under the gnu general public license version 2": 28,
    "licensed under cc by nc 4 0": 30,
    "this work is licensed under a creative commons attribution noncommercial 4 0 international "
    "license": 31,
    "licensed under cc by 4 0": 32,
    "this work is licensed under a creative commons attribution 4 0 international license": 33,
    "licensed under cc by sa 4 0": 34,
    "this work is licensed under a creative commons attribution sharealike 4 0 international "
    "license": 35,
    "licensed under cc by nd 4 0": 36,
    "this work is licensed under a creative commons attribution noderivatives 4 0 international "
    "license": 37,
    "licensed under cc by nc sa 4 0": 38,
    "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 "
    "international license": 39,
    "redistribution and use in source and binary forms with or without modification are permitted "
    "provided that the following conditions are met": 40,
    "redistributions of source code must retain the above copyright notice this list of conditions "
    "and the following disclaimer": 41,
    "redistributions in binary form must reproduce the above copyright notice this list of "
    "conditions and the following disclaimer in the documentation and or other materials provided "
    "with the distribution": 42,
    "neither the name of the copyright holder nor the names of its contributors may be used to "
    "endorse or promote products derived from this software without specific prior written "
    "permission": 43,
    "this software is provided by the copyright holders and contributors as is and any express or "
    "implied warranties including but not limited to the implied warranties of merchantability and "
    "fitness for a particular purpose are disclaimed": 44,
    "all rights reserved": 50,
    "this library is free software": 60,
    "you can redistribute it and or modify it under the terms of the gnu lesser general public "
    "license as published by the free software foundation either version 2 1 of the license or at "
    "your option any later version": 61,
    "you can redistribute it and or modify it under the terms of the gnu lesser general public "
    "license as published by the free software foundation either version 3 of the license or at "
    "your option any later version": 62,
    "you can redistribute it and or modify it under the terms of the gnu affero general public "
    "license as published by the free software foundation either version 3 of the license or at "
    "your option any later version": 63,
    "this source code form is subject to the terms of the mozilla public license v 2 0": 64,
    "permission to use copy modify and or distribute this software for any purpose with or without "
    "fee is hereby granted provided that the above copyright notice and this permission notice "
    "appear in all copies": 65,
    "this is free and unencumbered software released into the public domain": 66,
    "licensed under cc0 1 0": 67,
    "distributed under the boost software license version 1 0": 68,
    "this program and the accompanying materials are made available under the terms of the eclipse "
    "public license 2 0 which is available at": 69,
    "this software is provided as is without any express or implied warranty": 70,
    "permission is granted to anyone to use this software for any purpose including commercial "
    "applications and to alter it and redistribute it freely subject to the following restrictions": 71,
    "spdx license identifier mit": 80,
    "spdx license identifier apache 2 0": 81,
    "spdx license identifier gpl 2 0 only": 82,
    "spdx license identifier gpl 2 0 or later": 83,
    "spdx license identifier gpl 3 0 only": 84,
    "spdx license identifier gpl 3 0 or later": 85,
    "spdx license identifier bsd 2 clause": 86,
    "spdx license identifier bsd 3 clause": 87,
    "spdx license identifier mpl 2 0": 88,
    "spdx license identifier lgpl 2 1 or later": 89,
    "spdx license identifier agpl 3 0 or later": 90,
    "spdx license identifier isc": 91,
    "spdx license identifier unlicense": 92,
    "spdx license identifier cc0 1 0": 93,
}
#: Licence, family and the ids of its sentences in order.
RULES = [
    ("BSD-3-Clause", "permissive", [40, 41, 42, 43]),
    ("BSD-2-Clause", "permissive", [40, 41, 42]),
    ("MIT", "permissive", [5, 6, 7]),
    ("MIT", "permissive", [5, 6]),
    ("MIT", "permissive", [1]),
    ("MIT", "permissive", [2]),
    ("MIT", "permissive", [3]),
    ("MIT", "permissive", [4]),
    ("Apache-2.0", "permissive", [11, 12]),
    ("Apache-2.0", "permissive", [10]),
    ("Apache-2.0", "permissive", [14]),
    ("GPL-3.0", "copyleft", [20]),
    ("GPL-3.0", "copyleft", [21]),
    ("GPL-3.0", "copyleft", [22, 23]),
    ("CC-BY-NC-4.0", "noncommercial", [30]),
    ("CC-BY-NC-4.0", "noncommercial", [31]),
    ("CC-BY-4.0", "permissive", [32]),
    ("CC-BY-4.0", "permissive", [33]),
    ("CC-BY-SA-4.0", "copyleft", [34]),
    ("GPL-2.0", "copyleft", [25]),
    ("GPL-2.0", "copyleft", [22, 26]),
    ("GPL-2.0", "copyleft", [22, 24]),
    ("GPL-2.0", "copyleft", [27]),
    ("GPL-2.0", "copyleft", [28]),
    ("CC-BY-SA-4.0", "copyleft", [35]),
    ("CC-BY-ND-4.0", "noderivatives", [36]),
    ("CC-BY-ND-4.0", "noderivatives", [37]),
    ("CC-BY-NC-SA-4.0", "noncommercial", [38]),
    ("CC-BY-NC-SA-4.0", "noncommercial", [39]),
    ("BSD-3-Clause", "permissive", [87]),
    ("BSD-2-Clause", "permissive", [86]),
    ("LGPL-2.1", "copyleft", [60, 61]),
    ("LGPL-2.1", "copyleft", [89]),
    ("LGPL-3.0", "copyleft", [60, 62]),
    ("AGPL-3.0", "copyleft", [22, 63]),
    ("AGPL-3.0", "copyleft", [90]),
    ("MPL-2.0", "copyleft", [64]),
    ("MPL-2.0", "copyleft", [88]),
    ("ISC", "permissive", [65]),
    ("ISC", "permissive", [91]),
    ("Unlicense", "permissive", [66]),
    ("Unlicense", "permissive", [92]),
    ("CC0-1.0", "permissive", [67]),
    ("CC0-1.0", "permissive", [93]),
    ("BSL-1.0", "permissive", [68]),
    ("EPL-2.0", "copyleft", [69]),
    ("Zlib", "permissive", [70, 71]),
    ("MIT", "permissive", [80]),
    ("Apache-2.0", "permissive", [81]),
    ("GPL-2.0", "copyleft", [82]),
    ("GPL-2.0", "copyleft", [83]),
    ("GPL-3.0", "copyleft", [84]),
    ("GPL-3.0", "copyleft", [85]),
    ("reserved", "reserved", [50]),
]
#: A licence that makes another one redundant in a report.
IMPLIES = {"BSD-3-Clause": "BSD-2-Clause"}
CUES = ["licen", "permission", "redistribut", "free software", "rights reserved", "without warranty", "public domain", "implied warrant"]

#: A fragment has a word at least, so no known sentence has more fragments.
MOST_WORDS = max(len(sentence.split()) for sentence in SENTENCES)

for _sentence in SENTENCES:
    if not any(cue in _sentence for cue in CUES):
        raise ValueError(f"no cue in {_sentence!r}")


def cue_pattern() -> str:
    """The cues, with anything but letters and digits between their words."""
    return "(?i)" + "|".join(cue.replace(" ", "[^A-Za-z0-9]+") for cue in CUES)


def rule_pattern(ids: list[int]) -> str:
    """Matches a sequence written as ``#1#2#3#`` that holds the ids in order."""
    return "#" + "#([0-9]+#)*".join(f"{n}" for n in ids) + "#"


def sentence_ids(text: Column) -> Column:
    """The ids of the known sentences of a text, in text order, as an array."""
    cut = F.regexp_replace(text, r"([.!?;:])[\x20\x09-\x0D]+", "$1\n")
    plain = F.transform(
        F.split(cut, "\n"), lambda x: F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))
    )
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])

    begins = F.array(*[F.lit(f"{sentence} ") for sentence in SENTENCES])

    def numbers(fragments: Column) -> Column:
        places = F.filter(
            F.sequence(F.lit(1), F.size(fragments)),
            lambda i: F.exists(
                begins, lambda x: F.startswith(x, F.concat(F.element_at(fragments, i), F.lit(" ")))
            ),
        )
        looked = F.transform(
            places,
            lambda i: F.transform(
                F.sequence(F.lit(1), F.least(F.lit(MOST_WORDS), F.size(fragments) - i + 1)),
                lambda k: known[F.concat_ws(" ", F.slice(fragments, i, k))],
            ),
        )
        return F.filter(F.flatten(looked), lambda n: n.isNotNull())

    pieces = F.filter(plain, lambda x: x != "")
    # evaluated once per row: the array is the one element of an outer array
    found = F.flatten(
        F.transform(
            F.array(pieces),
            lambda p: F.when(F.size(p) > 0, numbers(p)).otherwise(F.array().cast("array<int>")),
        )
    )
    none = F.array().cast("array<int>")
    return F.coalesce(F.when(text.rlike(cue_pattern()), found), none)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, sequence (ids), licenses and families of every row."""
    rows = docs.select("doc_id", sentence_ids(F.col("text")).alias("ids"))
    sequence = F.concat(F.lit("#"), F.array_join("ids", "#"), F.lit("#"))
    rows = rows.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), sequence.alias("sequence"))

    def found(name: str) -> Column:
        hits = [F.col("sequence").rlike(rule_pattern(ids)) for rule, _, ids in RULES if rule == name]
        hit = hits[0]
        for other in hits[1:]:
            hit = hit | other
        for stronger, weaker in IMPLIES.items():
            if weaker == name:
                hit = hit & ~found(stronger)
        return hit

    names = list(dict.fromkeys(rule for rule, _, _ in RULES))
    families = {rule: family for rule, family, _ in RULES}
    licenses = [F.when(found(n), F.lit(n)) for n in names]
    kinds = [F.when(found(n), F.lit(families[n])) for n in names]
    none = F.col("n_sentences") == 0
    return rows.select(
        "doc_id",
        "n_sentences",
        "sequence",
        F.when(none, "").otherwise(F.concat_ws(",", *licenses)).alias("licenses"),
        F.when(none, "").otherwise(
            F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*kinds)))), ",")
        ).alias("families"),
    )


def license_sql() -> str:
    """DuckDB SQL of ``scan_licenses`` over the table ``documents``, from the same tables."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    pairs = ", ".join(f"{quoted(s)}: {n}" for s, n in SENTENCES.items())
    names = list(dict.fromkeys(rule for rule, _, _ in RULES))
    families = {rule: family for rule, family, _ in RULES}

    def found(name: str) -> str:
        hits = [f"regexp_matches(sequence, '{rule_pattern(i)}')" for r, _, i in RULES if r == name]
        text = "(" + " OR ".join(hits) + ")"
        for stronger, weaker in IMPLIES.items():
            if weaker == name:
                text += f" AND NOT {found(stronger)}"
        return text

    def listed(values: list[str]) -> str:
        cases = ", ".join(f"CASE WHEN {found(n)} THEN '{v}' END" for n, v in zip(names, values))
        return f"list_filter([{cases}], lambda x: x IS NOT NULL)"

    return f"""
WITH cut AS (
  SELECT doc_id, list_filter(list_transform(
      string_split(regexp_replace(text, '([.!?;:])[\\x20\\x09-\\x0D]+', '\\1' || chr(10), 'g'), chr(10)),
      lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS parts
  FROM documents
), places AS (
  SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
  FROM (SELECT DISTINCT doc_id, parts FROM cut)
), known AS (
  SELECT unnest(map_keys(m)) AS sentence, unnest(map_values(m)) AS number
  FROM (SELECT MAP {{{pairs}}} AS m)
), begun AS (
  SELECT doc_id, i, parts, sentence, number, len(string_split(sentence, ' ')) AS words
  FROM places JOIN known ON starts_with(sentence || ' ', parts[i] || ' ')
), spans AS (
  SELECT doc_id, i, number, unnest(range(1, words + 1)) AS k, sentence, parts FROM begun
), ids AS (
  SELECT doc_id, list(number ORDER BY i, k) AS ids FROM spans
  WHERE i + k - 1 <= len(parts) AND array_to_string(list_slice(parts, i, i + k - 1), ' ') = sentence
  GROUP BY doc_id
), sequences AS (
  SELECT doc_id, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_sentences,
    '#' || coalesce(array_to_string(ids, '#'), '') || '#' AS sequence
  FROM documents LEFT JOIN ids USING (doc_id)
)
SELECT doc_id, n_sentences, sequence,
  array_to_string({listed(names)}, ',') AS licenses,
  array_to_string(list_sort(list_distinct({listed([families[n] for n in names])})), ',') AS families
FROM sequences"""


def normalised(sentence: str) -> str:
    """A sentence as the tables hold it."""
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()

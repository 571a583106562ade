"""Licence recognition by sentences and rules, in built-in functions only.

A text is cut into sentences; those with a legal word are normalised (lower case,
letters and digits only; what is licensed, and how it is said, becomes ``under``) and
mapped to identifiers: whole sentences that name a licence to its name, sentences of a
licence's text (which may go on after a whole word) to their own, any other to ``?``.  A
sentence that names several licences or an exception (``A or B``, ``A and B``, ``A with E``)
gives the identifier of each, if all are known.  The identifiers of a document, in order, are
then matched against ordered rules, each a sequence that stands for a licence; what a rule
matches is used up, so that a long form isn't found again in its short form.  That all
rights are reserved tells a licence only where no other is found.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licences and the names under which they are granted, normalised: fixed values.
LICENCES = {
    "AGPL-3.0-only": ["gnu affero general public license version 3", "gnu affero general public license v3 0", "gnu agpl v3", "agplv3", "agpl v3", "agpl 3 0"],
    "AGPL-3.0-or-later": ["gnu affero general public license version 3 or later", "agplv3 or later", "agpl v3 or later"],
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache license v2 0", "apache 2 0 license", "apache 2 0", "apache software license version 2 0"],
    "Artistic-2.0": ["artistic license 2 0", "artistic license version 2 0"],
    "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "bsd 2 clause"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license", "bsd 3 clause"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license 1 0"],
    "CC-BY-4.0": ["cc by 4 0", "creative commons attribution 4 0 international license", "creative commons attribution 4 0 international"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
    "CC-BY-NC-ND-4.0": ["cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives 4 0 international license"],
    "CC-BY-NC-SA-4.0": ["cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international license"],
    "CC-BY-ND-4.0": ["cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"],
    "CC0-1.0": ["cc0 1 0", "cc0", "cc0 1 0 universal license", "creative commons zero v1 0 universal license"],
    "EPL-2.0": ["eclipse public license version 2 0", "eclipse public license v2 0", "eclipse public license 2 0"],
    "GPL-2.0-only": ["gnu general public license version 2", "gnu general public license v2 0", "gnu gpl v2", "gplv2", "gpl v2", "gpl 2 0"],
    "GPL-2.0-or-later": ["gnu general public license version 2 or later", "gplv2 or later", "gpl v2 or later"],
    "GPL-3.0-only": ["gnu general public license version 3", "gnu general public license v3 0", "gnu gpl v3", "gplv3", "gpl v3", "gpl 3 0"],
    "GPL-3.0-or-later": ["gnu general public license version 3 or later", "gplv3 or later", "gpl v3 or later"],
    "ISC": ["isc license", "isc"],
    "LGPL-2.1-only": ["gnu lesser general public license version 2 1", "gnu lesser general public license v2 1", "lgplv2 1", "lgpl v2 1", "lgpl 2 1"],
    "LGPL-2.1-or-later": ["gnu lesser general public license version 2 1 or later", "lgplv2 1 or later"],
    "LGPL-3.0-only": ["gnu lesser general public license version 3", "gnu lesser general public license v3 0", "lgplv3", "lgpl v3", "lgpl 3 0"],
    "LGPL-3.0-or-later": ["gnu lesser general public license version 3 or later", "lgplv3 or later"],
    "MIT": ["mit license", "mit", "mit x11 license", "expat license"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license v2 0", "mozilla public license 2 0"],
    "Unlicense": ["unlicense"],
    "Zlib": ["zlib license"],
}

#: Exceptions to licences, normalised: fixed values.
EXCEPTIONS = {
    "Autoconf-exception-3.0": "autoconf exception 3 0",
    "Bison-exception-2.2": "bison exception 2 2",
    "Classpath-exception-2.0": "classpath exception 2 0",
    "GCC-exception-3.1": "gcc exception 3 1",
    "LLVM-exception": "llvm exception",
    "Linux-syscall-note": "linux syscall note",
}

#: Whole sentences of other meaning, normalised: fixed values.
WHOLE = {
    "all-rights-reserved": "all rights reserved",
    "unlicense-grant": "this is free and unencumbered software released into the public domain",
}

#: Starts of sentences of the licences' texts, normalised: fixed values.
SENTENCES = {
    "agpl-3-or-later": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    "apache-compliance": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice",
    "copyright": "copyright",
    "gpl-2-or-later": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-3-or-later": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-2-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-received": "you should have received a copy of the gnu general public license",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl-2.1-or-later": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl-3-or-later": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "mit-as-is": "the software is provided as is without warranty of any kind",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
}

#: Rules in order: sequences of identifiers, and the licence they stand for; fixed values.
RULES = [
    (("gpl-3-or-later", "gpl-hope", "gpl-received"), "GPL-3.0-or-later"),
    (("gpl-2-or-later", "gpl-hope", "gpl-received"), "GPL-2.0-or-later"),
    (("agpl-3-or-later",), "AGPL-3.0-or-later"),
    (("gpl-3-or-later",), "GPL-3.0-or-later"),
    (("gpl-2-or-later",), "GPL-2.0-or-later"),
    (("gpl-2-only",), "GPL-2.0-only"),
    (("lgpl-2.1-or-later",), "LGPL-2.1-or-later"),
    (("lgpl-3-or-later",), "LGPL-3.0-or-later"),
    (("Apache-2.0", "LLVM-exception"), "Apache-2.0 WITH LLVM-exception"),
    (("GPL-2.0-only", "Classpath-exception-2.0"), "GPL-2.0-only WITH Classpath-exception-2.0"),
    (("GPL-2.0-only", "Linux-syscall-note"), "GPL-2.0-only WITH Linux-syscall-note"),
    (("GPL-2.0-or-later", "Classpath-exception-2.0"), "GPL-2.0-or-later WITH Classpath-exception-2.0"),
    (("GPL-3.0-or-later", "GCC-exception-3.1"), "GPL-3.0-or-later WITH GCC-exception-3.1"),
    (("Apache-2.0", "apache-compliance", "apache-copy", "apache-as-is", "apache-see"), "Apache-2.0"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is"), "BSD-2-Clause"),
    (("MIT", "copyright", "mit-grant", "mit-notice", "mit-as-is"), "MIT"),
    (("mit-grant", "mit-notice", "mit-as-is"), "MIT"),
    (("isc-grant", "mit-as-is"), "ISC"),
    (("mpl-2",), "MPL-2.0"),
    (("unlicense-grant",), "Unlicense"),
    (("zlib-grant",), "Zlib"),
    *(((name,), name) for name in LICENCES),
]

#: The identifier that stands for a licence where no rule matches, and that licence.
ELSE = ("all-rights-reserved", "Proprietary")

#: A sentence without any of these is not a legal one; every known one has some.
LEGAL = (
    "licens|licenc|copyright|permission|warrant|redistribut|rights reserved|law or agreed|any later version|hope that|unencumbered|gpl[- v]*[0-9]|cc0"
    "|(?:released|distributed|published|available) under (?:the )?(?:mit|isc|apache|bsd|cc)(?:[^a-z]|$)"
)
#: A line that goes on in lower case, after a comment's leader perhaps, is part of the
#: sentence before.
WRAPPED = r"([a-z,])[ \t\r]*\n(?:[ \t]+[*]+[ \t]*|[ \t]*(?:[#;%]+|//+|--+)[ \t]*|[ \t]*)([a-z(])"
BETWEEN = r"[.!?]+[ \t\n\r\f]+|\n"
#: A version "or later", as ``GPLv2+`` has it.
PLUS = "([0-9])[+]"
#: What is licensed, and what is said after the licence's name.
LEAD = (
    "^(?:spdx license identifier|(?:(?:it|this|(?:this|the|our|all|your) [a-z0-9 ]{1,60}) (?:is|are) )?(?:dual |also )?"
    "(?:licensed|released|distributed|published|available|made available) under)(?: the terms of)?(?: both| either(?: of)?)?(?: the| an| a)? "
)
TAIL = "^(under .*) (?:the license|at your option|see (?:the )?license(?: file)?(?: for details)?)$"
#: Any name of a program that goes before these words becomes ``this program``.
NAMED = "^[a-z0-9 ]{1,60} is (free software you can redistribute|distributed in the hope)"
#: Several licences granted at once, what parts them, and versions, which don't.
SEVERAL = "^under .* (?:or|and|with) "
PARTED = " (?:or|and|with) (?:under )?(?:the terms of )?(?:the )?"
LATER = " or (?:at your option )?(?:any )?later(?: version)?( |$)"


def whole() -> dict[str, list[str]]:
    """The sentences that stand for each identifier as a whole: a licence granted, its
    title and its tag."""
    found = {}
    for name, names in LICENCES.items():
        names = names + [f"{n} or later" for n in LICENCES.get(name.replace("-or-later", "-only"), []) if name.endswith("-or-later")]
        titles = [n for n in names if "license" in n.split()]
        tag = re.sub("[^a-z0-9]+", " ", name.lower())
        tags = [tag] + [tag.removesuffix(" only")] * tag.endswith(" only")
        titles += [f"{t} {n}" for t in titles for n in dict.fromkeys(tags + names) if n not in titles]
        found[name] = list(dict.fromkeys([f"under {n}" for n in names + tags] + titles + [f"the {t}" for t in titles]))
    found |= {name: [f"under {text}"] for name, text in EXCEPTIONS.items()}
    return found | {name: [text] for name, text in WHOLE.items()}


def by_length() -> list[tuple[str, str]]:
    """Longer sentences first, as short ones may begin them."""
    named = [(name, re.sub(NAMED, r"this program is \1", text)) for name, text in SENTENCES.items()]
    return sorted(named, key=lambda x: (-len(x[1]), x[0]))


def identifiers(text: Column) -> Column:
    """The legal sentences of a text in order, as ``<identifier>`` one after another."""
    sentences = F.split(F.regexp_replace(text, WRAPPED, "$1 $2"), BETWEEN)
    legal = F.filter(sentences, lambda s: F.rlike(F.lower(s), F.lit(LEGAL)))

    def plain(sentence: Column) -> Column:
        later = F.regexp_replace(F.lower(sentence), PLUS, "$1 or later ")
        words = F.trim(F.regexp_replace(later, "[^a-z0-9]+", " "))
        granted = F.regexp_replace(F.regexp_replace(words, LEAD, "under "), TAIL, "$1")
        return F.regexp_replace(granted, NAMED, "this program is $1")

    def parts(said: Column) -> Column:
        versions = F.regexp_replace(F.substr(said, F.lit(len("under ") + 1)), LATER, " orlater$1")
        names = F.transform(F.split(versions, PARTED), lambda n: F.concat(F.lit("under "), F.replace(n, F.lit(" orlater"), F.lit(" or later"))))
        return F.when(F.rlike(said, F.lit(SEVERAL)), names).otherwise(F.array(said))

    def known(said: Column) -> Column:
        found = F.lit("<?>")
        for name, start in reversed(by_length()):
            found = F.when(F.startswith(F.concat(said, F.lit(" ")), F.lit(start + " ")), F.lit(f"<{name}>")).otherwise(found)
        for name, texts in whole().items():
            found = F.when(said.isin(texts), F.lit(f"<{name}>")).otherwise(found)
        return found

    def together(ids: Column) -> Column:
        return F.when(F.array_contains(ids, "<?>"), "<?>").otherwise(F.array_join(ids, ""))

    found = F.transform(F.transform(F.transform(legal, plain), parts), lambda said: F.transform(said, known))
    return F.array_join(F.transform(found, together), "")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, sentences, licences, status`` of every row.

    ``sentences`` are the identifiers in order, ``licences`` those whose rules match, in
    the order of the rules and each once, joined by commas.  ``status`` is ``none``
    without a legal sentence, ``recognised`` with a licence, else ``unrecognised``.  A
    null or empty text has no sentence; repeated rows and null ids stay; other columns
    are not read.
    """
    rules = F.array(
        *(F.struct(F.lit("".join(f"<{s}>" for s in seq)).alias("seq"), F.lit(name).alias("name")) for seq, name in RULES)
    )
    start = F.struct(F.col("sentences").alias("left"), F.array().cast("array<string>").alias("found"))

    def match(state: Column, rule: Column) -> Column:
        hit = F.contains(state["left"], rule["seq"])
        return F.struct(
            F.replace(state["left"], rule["seq"], F.lit("|")).alias("left"),
            F.when(hit, F.array_append(state["found"], rule["name"])).otherwise(state["found"]).alias("found"),
        )

    def listed(state: Column) -> Column:
        fallback = (F.size(state["found"]) == 0) & F.contains(state["left"], F.lit(f"<{ELSE[0]}>"))
        return F.when(fallback, ELSE[1]).otherwise(F.array_join(F.array_distinct(state["found"]), ","))

    found = F.aggregate(rules, start, match, listed)
    return (
        docs.select(F.col(id_col).alias("doc_id"), identifiers(F.coalesce(F.col(text_col), F.lit(""))).alias("sentences"))
        .withColumn("licences", F.when(F.col("sentences") == "", "").otherwise(found))
        .withColumn(
            "status",
            F.when(F.col("sentences") == "", "none").when(F.col("licences") == "", "unrecognised").otherwise("recognised"),
        )
    )


def scan_sql() -> str:
    """The same over ``documents`` in DuckDB's SQL."""
    exact = " ".join("WHEN plain IN (" + ", ".join(f"'{t}'" for t in texts) + f") THEN '<{name}>'" for name, texts in whole().items())
    ladder = exact + " " + " ".join(f"WHEN starts_with(plain || ' ', '{text} ') THEN '<{name}>'" for name, text in by_length())
    steps = ["s0 AS (SELECT nr, doc_id, sentences, sentences AS rest, CAST([] AS VARCHAR[]) AS found FROM joined)"]
    for n, (seq, name) in enumerate(RULES):
        ids = "".join(f"<{s}>" for s in seq)
        steps.append(
            f"s{n + 1} AS (SELECT nr, doc_id, sentences, replace(rest, '{ids}', '|') AS rest, CASE WHEN contains(rest, '{ids}')"
            f" AND NOT list_contains(found, '{name}') THEN list_append(found, '{name}') ELSE found END AS found FROM s{n})"
        )
    last = f"s{len(RULES)}"
    return f"""
WITH numbered AS (SELECT row_number() OVER () AS nr, doc_id, coalesce(text, '') AS text FROM documents),
cut AS (
  SELECT nr, string_split_regex(regexp_replace(text, '{WRAPPED}', '\\1 \\2', 'g'), '[.!?]+[ \\t\\n\\r\\f]+|\\n') AS parts FROM numbered
),
sentence AS (SELECT nr, unnest(parts) AS part, unnest(range(len(parts))) AS pos FROM cut),
legal AS (
  SELECT nr, pos, trim(regexp_replace(regexp_replace(lower(part), '{PLUS}', '\\1 or later ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS words
  FROM sentence WHERE regexp_matches(lower(part), '{LEGAL}')
),
said AS (
  SELECT nr, pos, regexp_replace(regexp_replace(regexp_replace(words, '{LEAD}', 'under '), '{TAIL}', '\\1'), '{NAMED}', 'this program is \\1') AS said
  FROM legal
),
parted AS (
  SELECT nr, pos, CASE WHEN regexp_matches(said, '{SEVERAL}')
    THEN ['under ' || replace(x, ' orlater', ' or later') FOR x IN string_split_regex(regexp_replace(substr(said, 7), '{LATER}', ' orlater\\1', 'g'), '{PARTED}')]
    ELSE [said] END AS names
  FROM said
),
piece AS (SELECT nr, pos, unnest(names) AS plain, unnest(range(len(names))) AS nth FROM parted),
mapped AS (SELECT nr, pos, nth, CASE {ladder} ELSE '<?>' END AS id FROM piece),
known AS (SELECT nr, pos, CASE WHEN bool_or(id = '<?>') THEN '<?>' ELSE string_agg(id, '' ORDER BY nth) END AS id FROM mapped GROUP BY nr, pos),
joined AS (
  SELECT n.nr, n.doc_id, coalesce(k.sentences, '') AS sentences
  FROM numbered n LEFT JOIN (SELECT nr, string_agg(id, '' ORDER BY pos) AS sentences FROM known GROUP BY nr) k ON n.nr = k.nr
),
{", ".join(steps)},
ended AS (
  SELECT doc_id, sentences, CASE WHEN len(found) = 0 AND contains(rest, '<{ELSE[0]}>') THEN ['{ELSE[1]}'] ELSE found END AS found FROM {last}
)
SELECT doc_id, sentences, array_to_string(found, ',') AS licences,
  CASE WHEN sentences = '' THEN 'none' WHEN len(found) = 0 THEN 'unrecognised' ELSE 'recognised' END AS status
FROM ended"""

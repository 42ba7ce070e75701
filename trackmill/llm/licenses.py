"""Operator 11: license scans by ordered signature rules, JVM expressions only.

A text becomes its words, each with a blank on both sides, so a rule is a regular expression over
whole words that needs no look-around. A rule has a keyword, a word of each of its matches:
only the rules of keywords that the text holds are tried. All their matches are detections,
intervals of words. A detection inside one of an equal or better priority is suppressed (of equal
intervals with equal priority the earlier rule stays). Being inside is transitive, so what
suppresses does not matter, and the result is the same in any order.

Everything is a projection of the row at hand: no shuffle, no state, no limit on the length of a
text or the number of its detections; the work grows as n log n in either.
"""

from __future__ import annotations

import json
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words of a lower-cased text: ASCII but letters and digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The base phrases with their labels, and how sure a detection of each priority makes.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
NOTICE, TAG, LINK, GRANT, NAME, WEAK = range(6)
WEIGHTS = (1.0, 1.0, 0.95, 0.9, 0.7, 0.5)

# License families. Label; keyword; the words of its name, `(a|b c)` for alternatives, `?` for what may
# lack; the words of its identifier in software metadata.
FAMILIES = """
gpl-1.0 | gnu | gnu (general public license|gpl) (version|v) 1 | gpl 1 0 (only|or later)?
gpl-2.0 | gnu | gnu (general public license|gpl) (version|v)? (2|2 0|v2) | gpl 2 0 (only|or later)?
gpl-3.0 | gnu | gnu (general public license|gpl) (version|v)? (3|3 0|v3) | gpl 3 0 (only|or later)?
gpl-2.0 | gplv2 | gplv2 (or later)? | gplv2
gpl-3.0 | gplv3 | gplv3 (or later)? | gplv3
lgpl-2.0 | library | gnu library general public license | lgpl 2 0 (only|or later)?
lgpl-2.1 | lesser | gnu lesser general public license (version|v)? 2 1 | lgpl 2 1 (only|or later)?
lgpl-3.0 | lesser | gnu lesser general public license (version|v)? (3|3 0) | lgpl 3 0 (only|or later)?
lgpl | lesser | gnu lesser general public license | lgpl
lgpl-3.0 | lgplv3 | lgplv3 | lgplv3
agpl-3.0 | affero | (gnu)? affero general public license ((version|v)? (3|3 0))? | agpl 3 0 (only|or later)?
agpl-3.0 | agplv3 | agplv3 | agplv3
gfdl | documentation | gnu free documentation license | gfdl 1 (1|2|3)
apache-1.1 | apache | apache (software)? license (version|v)? 1 1 | apache 1 1
apache-2.0 | apache | apache (software)? license (version|v)? (2|2 0|v2) | apache 2 0
mit | mit | mit (expat)? license | mit
mit-0 | attribution | mit no attribution license | mit 0
mit | expat | expat license | expat
bsd-2-clause | bsd | (2|two) clause bsd license | bsd 2 clause
bsd-3-clause | bsd | (3|three) clause bsd license | bsd 3 clause
bsd-4-clause | bsd | (4|four) clause bsd license | bsd 4 clause
bsd-2-clause | simplified | simplified bsd license | bsd 2 clause simplified
bsd-3-clause | bsd | (new|modified|revised) bsd license | bsd 3 clause (clear|lbnl)
0bsd | 0bsd | 0bsd license | 0bsd
bsd | bsd | bsd (style)? license | bsd
isc | isc | isc license | isc
mpl-1.1 | mozilla | mozilla public license (version|v)? 1 1 | mpl 1 1
mpl-2.0 | mozilla | mozilla public license (version|v)? (2|2 0) | mpl 2 0
mpl | mozilla | mozilla public license | mpl
epl-1.0 | eclipse | eclipse public license (version|v)? 1 0 | epl 1 0
epl-2.0 | eclipse | eclipse public license (version|v)? 2 0 | epl 2 0
cddl-1.0 | distribution | common development and distribution license | cddl 1 (0|1)
cpl-1.0 | common | common public license (version|v)? 1 0 | cpl 1 0
eupl-1.2 | european | european union public (license|licence) | eupl 1 (1|2)
artistic-2.0 | artistic | artistic license (version)? 2 0 | artistic 2 0
artistic-1.0 | artistic | artistic license | artistic 1 0
bsl-1.0 | boost | boost software license | bsl 1 0
busl-1.1 | business | business source license | busl 1 1
sspl-1.0 | server | server side public license | sspl 1 0
zlib | zlib | zlib license | zlib
libpng | libpng | libpng license | libpng 2 0
openssl | openssl | openssl license | openssl
php-3.01 | php | php license | php 3 01
python-2.0 | python | python software foundation license | psf 2 0
ruby | ruby | ruby license | ruby
postgresql | postgresql | postgresql license | postgresql
ofl-1.1 | sil | sil open font license | ofl 1 1
ms-pl | microsoft | microsoft public license | ms pl
ms-rl | microsoft | microsoft reciprocal license | ms rl
ncsa | ncsa | (university of illinois)? ncsa open source license | ncsa
upl-1.0 | permissive | universal permissive license | upl 1 0
w3c | w3c | w3c software (notice and)? license | w3c
wtfpl | wtfpl | wtfpl (license)? | wtfpl
unlicense | unlicense | unlicense | unlicense
afl-3.0 | academic | academic free license | afl 3 0
osl-3.0 | open | open software license | osl 3 0
odbl-1.0 | database | open database license | odbl 1 0
pddl-1.0 | dedication | public domain dedication and license | pddl 1 0
cc0-1.0 | cc0 | cc0 (1 0)? (universal)? | cc0 1 0
cc0-1.0 | creative | creative commons (zero|public domain dedication) | cc zero
cc-by-1.0 | cc | cc by 1 0 | cc by 1 0
cc-by-2.0 | cc | cc by 2 (0|5) | cc by 2 (0|5)
cc-by-3.0 | cc | cc by 3 0 | cc by 3 0
cc-by-4.0 | cc | cc by 4 0 | cc by 4 0
cc-by-sa-2.0 | cc | cc by sa 2 (0|5) | cc by sa 2 (0|5)
cc-by-sa-3.0 | cc | cc by sa 3 0 | cc by sa 3 0
cc-by-sa-4.0 | cc | cc by sa 4 0 | cc by sa 4 0
cc-by-sa | cc | cc by sa | cc by sa
cc-by-nc-3.0 | cc | cc by nc 3 0 | cc by nc 3 0
cc-by-nc-4.0 | cc | cc by nc 4 0 | cc by nc 4 0
cc-by-nc | cc | cc by nc | cc by nc
cc-by-nd-3.0 | cc | cc by nd 3 0 | cc by nd 3 0
cc-by-nd-4.0 | cc | cc by nd 4 0 | cc by nd 4 0
cc-by-nd | cc | cc by nd | cc by nd
cc-by-nc-sa-4.0 | cc | cc by nc sa 4 0 | cc by nc sa 4 0
cc-by-nc-sa | cc | cc by nc sa | cc by nc sa
cc-by-nc-nd-4.0 | cc | cc by nc nd 4 0 | cc by nc nd 4 0
cc-by-nc-nd | cc | cc by nc nd | cc by nc nd
cc-by-4.0 | creative | creative commons attribution 4 0 (international)? | cc attribution 4 0
cc-by-sa-4.0 | creative | creative commons attribution (share alike|sharealike) 4 0 (international)? | cc attribution sharealike 4 0
cc-by-sa-3.0 | creative | creative commons attribution (share alike|sharealike) 3 0 (unported)? | cc attribution sharealike 3 0
cc-by-nc-4.0 | creative | creative commons attribution (non commercial|noncommercial) 4 0 (international)? | cc attribution noncommercial 4 0
cc-by-nd-4.0 | creative | creative commons attribution (no derivatives|noderivatives|noderivs) 4 0 (international)? | cc attribution noderivatives 4 0
cc-by | creative | creative commons attribution | cc attribution
cc | creative | creative commons (license|licence) | cc license
"""

# Links. Label; keyword; words.
LINKS = """
gpl-2.0 | gnu | gnu org licenses (old licenses)? gpl 2 0
gpl-3.0 | gnu | gnu org licenses gpl 3 0
gpl | gnu | gnu org (licenses|copyleft) gpl
lgpl | gnu | gnu org (licenses|copyleft) (old licenses)? lgpl
agpl-3.0 | gnu | gnu org licenses agpl
gfdl | gnu | gnu org (licenses|copyleft) fdl
apache-2.0 | apache | apache org licenses license 2 0
apache-1.1 | apache | apache org licenses license 1 1
mit | opensource | opensource org licenses mit (license)?
bsd-2-clause | opensource | opensource org licenses bsd 2 clause
bsd-3-clause | opensource | opensource org licenses bsd 3 clause
isc | opensource | opensource org licenses isc
artistic-2.0 | opensource | opensource org licenses artistic (license)? 2 0
mpl-2.0 | mozilla | mozilla org (en us)? mpl 2 0
mpl-1.1 | mozilla | mozilla org (en us)? mpl 1 1
epl-1.0 | eclipse | eclipse org legal epl v10
epl-2.0 | eclipse | eclipse org legal epl (2 0|v20)
bsl-1.0 | boost | boost org license 1 0
ofl-1.1 | sil | scripts sil org ofl
unlicense | unlicense | unlicense org
wtfpl | wtfpl | wtfpl net
cc0-1.0 | publicdomain | creativecommons org publicdomain zero 1 0
cc-by-2.0 | creativecommons | creativecommons org licenses by 2 (0|5)
cc-by-3.0 | creativecommons | creativecommons org licenses by 3 0
cc-by-4.0 | creativecommons | creativecommons org licenses by 4 0
cc-by-sa-3.0 | creativecommons | creativecommons org licenses by sa 3 0
cc-by-sa-4.0 | creativecommons | creativecommons org licenses by sa 4 0
cc-by-nc-4.0 | creativecommons | creativecommons org licenses by nc 4 0
cc-by-nd-4.0 | creativecommons | creativecommons org licenses by nd 4 0
cc-by-nc-sa-4.0 | creativecommons | creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 | creativecommons | creativecommons org licenses by nc nd 4 0
cc | creativecommons | creativecommons org licenses
"""

# Sentences of license texts and notices. Label; keyword; words.
NOTICES = """
mit | charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | permission | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
isc | modify | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd-2-clause | redistributions | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-3-clause | endorse | neither the name of .* nor the names of its contributors may be used to endorse or promote products derived from this software
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display the following acknowledgement
apache-2.0 | compliance | you may not use this file except in compliance with the license
apache-2.0 | warranties | distributed on an as is basis without warranties or conditions of any kind either express or implied
gpl | redistribute | you can redistribute it and or modify it under the terms of the gnu general public license
lgpl | redistribute | you can redistribute it and or modify it under the terms of the gnu lesser general public license
agpl-3.0 | redistribute | you can redistribute it and or modify it under the terms of the gnu affero general public license
gpl | merchantability | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu (general public license|gpl)
mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public license (v|version) 2 0
epl-2.0 | eclipse | made available under the terms of the eclipse public license 2 0
epl-1.0 | eclipse | made available under the terms of the eclipse public license (v|version) 1 0
zlib | misrepresented | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
bsl-1.0 | boost | distributed under the boost software license (version)? 1 0
unlicense | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | fuck | do what the fuck you want to public license
cc0-1.0 | waived | has waived all copyright and related or neighboring rights
ofl-1.1 | font | this font software is licensed under the sil open font license
public-domain | domain | (released|dedicated|placed) (in|into|to|in to) the public domain
public-domain | domain | this work is in the public domain
proprietary | confidential | proprietary and confidential
proprietary | prohibited | unauthorized (copying|use|reproduction) (or distribution)? of this (file|software|document) .* is (strictly)? prohibited
all-rights-reserved | reserved | all rights reserved
"""

GRANTS = "(licensed|released|distributed|available|published|provided|covered) under (the)? (terms of)? (the)? (a)?"


class Rule(NamedTuple):
    order: int
    priority: int
    label: str
    keyword: str
    regex: str


def pattern(phrase: str) -> str:
    """The regular expression of a phrase over words with a blank on both sides.

    ``(a|b c)`` are alternatives, ``(a)?`` may lack, ``.*`` is up to twelve words; groups nest.
    """
    out = []
    for token in re.findall(r"\(|\)\??|\||\.\*|[^\s()|]+", phrase):
        if token == ".*":
            out.append("(?: [^ ]+ ){0,12}")
        else:
            out.append({"(": "(?:", ")": ")", ")?": ")?", "|": "|"}.get(token, f" {token} "))
    return "".join(out)


def _rows(table: str) -> list[list[str]]:
    return [[cell.strip() for cell in line.split(" | ")] for line in table.strip().splitlines()]


def rules() -> list[Rule]:
    """All rules in order: notices (a phrase of few words counts as a name), then each family's tag, grant and name, links and the base phrases."""
    found = [(NOTICE if len(phrase.split()) > 5 else NAME, label, keyword, phrase) for label, keyword, phrase in _rows(NOTICES)]
    for label, keyword, name, identifier in _rows(FAMILIES):
        found.append((TAG, label, "spdx", f"spdx license identifier {identifier}"))
        found.append((GRANT, label, keyword, f"{GRANTS} {name}"))
        found.append((NAME, label, keyword, name))
    found += [(LINK, label, keyword, phrase) for label, keyword, phrase in _rows(LINKS)]
    found += [(WEAK, label, phrase.split()[0], phrase) for phrase, label in BASE]
    return [Rule(n, priority, label, keyword, pattern(phrase)) for n, (priority, label, keyword, phrase) in enumerate(found)]


RULES = rules()
_FIRST_BASE = len(RULES) - len(BASE)


def _literal(found: list[Rule]) -> Column:
    """Rules by keyword, one constant of the plan."""
    by_keyword: dict[str, list[dict]] = {}
    for rule in found:
        by_keyword.setdefault(rule.keyword, []).append({f: getattr(rule, f) for f in ("order", "priority", "label", "regex")})
    # A constant text that the optimizer parses once: thousands of literals would slow every step of the analysis.
    return F.from_json(F.lit(json.dumps(by_keyword)), "map<string, array<struct<order: int, priority: int, label: string, regex: string>>>")


def scanned(documents: DataFrame, carry: tuple[str, ...] = ("doc_id",), found: list[Rule] | None = None) -> DataFrame:
    """The carried columns, n_words, places and detections of every row.

    ``places``: all matches of the rules, sorted; ``detections``: those that are not suppressed.
    Both are arrays of structs start, neg_end (words from 0, the end negative and exclusive),
    priority, order (of the rule), label. A null text is empty; rows are judged one by one, so
    ids may repeat or be null.
    """
    found = RULES if found is None else found
    keywords = F.array(*[F.lit(k) for k in sorted({r.keyword for r in found})])
    lowered = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    spaced = F.trim(F.regexp_replace(lowered, SEPARATORS, "  ")).alias("spaced")
    split = documents.select(*carry, spaced).withColumn("words", F.split("spaced", "  "))
    hints = split.select(
        *carry,
        F.when(F.col("spaced") == "", 0).otherwise(F.size("words")).cast("long").alias("n_words"),
        F.array_intersect("words", keywords).alias("hints"),
        F.concat(F.lit(" "), "spaced", F.lit(" ")).alias("normal"),
    )
    tried = F.flatten(F.transform("hints", lambda k: F.element_at(_literal(found), k)))
    matching = F.filter(tried, lambda r: F.rlike(F.col("normal"), r["regex"]))
    nothing = F.array().cast("array<struct<start:int,neg_end:int,priority:int,order:int,label:string>>")
    places = F.array_sort(F.flatten(F.transform(matching, lambda r: _places(F.col("normal"), r))))
    placed = hints.withColumn("places", F.when(F.size("hints") == 0, nothing).otherwise(places))
    kept = F.when(F.size("places") < 2, F.col("places")).otherwise(_unsuppressed("places"))
    return placed.select(*carry, "n_words", "places", kept.alias("detections"))


def _places(normal: Column, rule: Column) -> Column:
    """Matches of a rule: marks at both ends of each, then the numbers of the marked words."""
    marked = F.regexp_replace(normal, rule["regex"], F.lit("\u0001$0\u0002"))
    # The marks go inside the words' blanks, so the text still splits into words.
    inside = F.replace(F.replace(marked, F.lit("\u0001 "), F.lit(" \u0001")), F.lit(" \u0002"), F.lit("\u0002 "))
    words = F.split(F.trim(inside), "  ")
    numbers = F.filter(F.transform(words, lambda w, i: F.when(w.startswith("\u0001"), i)), lambda i: i.isNotNull())
    ends = F.filter(F.transform(words, lambda w, i: F.when(w.endswith("\u0002"), i + 1)), lambda i: i.isNotNull())
    return F.zip_with(
        numbers,
        ends,
        lambda a, b: F.struct(
            a.alias("start"), (-b).alias("neg_end"), rule["priority"].alias("priority"), rule["order"].alias("order"), rule["label"].alias("label")
        ),
    )


def _unsuppressed(name: str) -> Column:
    """Detections without an earlier one that ends no earlier and has an equal or better priority.

    The array is sorted by start, longest first, so these are the ones inside another. The
    furthest end before each detection, for each priority, is a running maximum: in pass k
    every element takes the maximum with the one 2^k before it.
    """
    all_ = F.col(name)
    n = F.size(all_)
    own = F.transform(all_, lambda d: F.array(*[F.when(d["priority"] <= p, -d["neg_end"]).otherwise(-1) for p in range(len(WEIGHTS))]))
    none = F.array(*[F.lit(-1)] * len(WEIGHTS))

    def shifted(ends: Column, by: Column) -> Column:
        return F.concat(F.array_repeat(none, by), F.slice(ends, F.lit(1), n - by))

    def furthest(ends: Column, k: Column) -> Column:
        by = F.least(F.pow(F.lit(2), k).cast("int"), n)
        return F.zip_with(ends, shifted(ends, by), lambda x, y: F.zip_with(x, y, lambda a, b: F.greatest(a, b)))

    passes = F.sequence(F.lit(0), F.ceil(F.log2(n)).cast("int"))
    before = F.aggregate(passes, shifted(own, F.lit(1)), furthest)
    paired = F.zip_with(all_, before, lambda d, ends: F.when(F.get(ends, d["priority"]) < -d["neg_end"], d))
    return F.filter(paired, lambda d: d.isNotNull())


def documents_to_licenses(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document.

    ``n_base``, ``first_word`` and ``last_word`` count all places of the base phrases, suppressed
    or not. ``labels``: those of the base and of the detections that stay. ``score``: how sure
    the best detection is, 0 without one. Columns besides doc_id and text are not read.
    """
    found = scanned(documents)
    base = F.filter("places", lambda d: d["order"] >= _FIRST_BASE)
    counted = found.withColumn("base", base)

    def labels(name: Column) -> Column:
        return F.transform(name, lambda d: d["label"])

    def joined(array: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(array)), ",")

    starts = F.transform("base", lambda d: d["start"].cast("long"))
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    best = F.array_min(F.transform("detections", lambda d: d["priority"]))
    return counted.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(labels(F.col("base"))).alias("base_labels"),
        joined(F.concat(labels(F.col("base")), labels(F.col("detections")))).alias("labels"),
        F.coalesce(F.get(weights, best), F.lit(0.0)).alias("score"),
    )


def sql(found: list[Rule] | None = None) -> str:
    """The same result in DuckDB's SQL, the rules as a table."""
    found = RULES if found is None else found
    values = ", ".join(f"({r.order}, {r.priority}, '{r.label}', '{r.keyword}', '{r.regex}')" for r in found)
    count = "(length({0}) - length(replace({0}, ' ', ''))) // 2"
    return f"""
WITH rules(rule, priority, label, keyword, regex) AS (VALUES {values}),
texts AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
hinted AS (SELECT r, ' ' || array_to_string(words, '  ') || ' ' AS normal, unnest(list_distinct(words)) AS keyword FROM texts),
tried AS (
  SELECT r, rule, priority, label, string_split_regex(normal, regex) AS gaps, regexp_extract_all(normal, regex) AS hits
  FROM hinted JOIN rules USING (keyword) WHERE regexp_matches(normal, regex)),
counted AS (
  SELECT r, rule, priority, label, list_transform(gaps, lambda x: {count.format("x")}) AS gaps, list_transform(hits, lambda x: {count.format("x")}) AS hits
  FROM tried),
numbered AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM counted),
places AS (
  SELECT r, rule, priority, label, list_sum(gaps[1:i]) + coalesce(list_sum(hits[1:i - 1]), 0) AS s, s + hits[i] AS e FROM numbered),
kept AS (
  SELECT * FROM places p WHERE NOT EXISTS (
    SELECT 1 FROM places q WHERE q.r = p.r AND q.s <= p.s AND q.e >= p.e AND q.priority <= p.priority AND (q.s, -q.e, q.priority, q.rule) < (p.s, -p.e, p.priority, p.rule))),
base AS (
  SELECT r, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM places WHERE rule >= {_FIRST_BASE} GROUP BY r),
named AS (
  SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT r, label FROM kept UNION ALL SELECT r, label FROM places WHERE rule >= {_FIRST_BASE}) GROUP BY r),
sure AS (SELECT r, min(priority) AS best FROM kept GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(CAST({list(WEIGHTS)} AS DOUBLE[])[best + 1], 0.0) AS score
FROM texts LEFT JOIN base USING (r) LEFT JOIN named USING (r) LEFT JOIN sure USING (r)
"""


SQL = sql()

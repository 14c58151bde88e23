"""Licence scans (operator 3), in DataFrame functions only: one projection, no shuffle.

Every line, every paragraph and the whole text are normalised (lower case, runs of other characters than letters and
digits as one space) and compared to licence templates by the Dice coefficient of their distinct word bigrams. At a
threshold t a template of b bigrams can only match between b * t / (2 - t) and b * (2 - t) / t bigrams; others are passed
over. A match also holds more than the share t / (2 - t) of the template's bigrams, so it holds one of any words that touch
the rest: texts and units without such a word are passed over before they are cut up.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegraph.llm.common import quote

THRESHOLD = 0.8
# Short licence notices, and parts of the published licence texts.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    # Titles, grants and standard notices of the published texts.
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "Apache-2.0-title": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "BSD-2-Clause-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-3-Clause-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSL-1.0-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "BSL-1.0-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-2.0-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "LGPL-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-2.1-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "LGPL-3.0-notice": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "LGPL-3.0-supplement": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    "MPL-2.0-title": "Mozilla Public License Version 2.0",
}


#: Words of everyday text, chosen as signals only where nothing else is left.
COMMON = frozenset("a above all any by conditions except following for free general in is may not of on or provided possible public subject the this to under use version with without work you".split())


def normal_words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def bigrams(words: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def signal_words(templates: dict[str, str], threshold: float) -> list[str]:
    """Words such that any unit that matches a template holds one: for each template, longest words first, until the
    bigrams without them are no more than a match may leave out of the template."""
    chosen: list[str] = []
    for text in templates.values():
        words = normal_words(text)
        pairs = bigrams(words)
        own: list[str] = []
        touched = lambda: sum(any(w in p.split() for w in own) for p in pairs)  # noqa: B023, E731
        for w in sorted(set(words), key=lambda w: (w in COMMON, w not in chosen, -len(w), w)):
            if touched() > len(pairs) * (1 - threshold / (2 - threshold)):
                break
            own.append(w)
        chosen += [w for w in own if w not in chosen]
    return sorted(chosen)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, license (best template), score (its Dice coefficient), unit (the text that
    matched), n_matches (templates that some unit meets at ``threshold`` or more).

    Ties go to the template first by name. Without a match license, score and unit are null and n_matches is 0; so for
    null, empty and wordless texts and texts of one word. Null and repeated doc_ids stay rows; further columns are ignored;
    an empty table gives no rows.
    """
    templates = templates or TEMPLATES
    text = F.lower(F.col("text").cast("string"))
    signals = signal_words(templates, threshold)
    holds = lambda c: F.greatest(*[c.contains(w) for w in signals], F.lit(False))
    paragraphs = F.split(text, "\n[ \\t\\r]*\n")
    units = F.array_distinct(F.filter(F.concat(F.split(text, "\n"), paragraphs, F.array(text)), holds))

    # What is used more than once is bound as a lambda's variable, or it would be computed anew each time.
    cut = F.transform(units, lambda u: F.struct(u.alias("unit"), F.filter(F.split(u, "[^\\p{L}\\p{N}]+"), lambda w: w != "").alias("words")))
    cut = F.filter(cut, lambda x: F.size(x["words"]) > 1)

    def pairs(words: Column) -> Column:
        after = F.slice(words, 2, F.size(words))
        return F.array_distinct(F.slice(F.zip_with(words, after, lambda a, b: F.concat(a, F.lit(" "), b)), 1, F.size(words) - 1))

    known = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(len(p)).alias("n"), F.array(*map(F.lit, sorted(p))).alias("pairs")) for name, t in sorted(templates.items()) if (p := bigrams(normal_words(t)))])
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold

    def compared(unit: Column) -> Column:
        own, n = unit["pairs"], F.size(unit["pairs"])
        near = F.filter(known, lambda t: (n >= t["n"] * F.lit(low) - 1e-9) & (n <= t["n"] * F.lit(high) + 1e-9))
        scored = F.transform(near, lambda t: F.struct((2.0 * F.size(F.array_intersect(own, t["pairs"])) / (n + t["n"])).alias("score"), t["name"].alias("license"), unit["unit"].alias("unit")))
        return F.filter(scored, lambda s: s["score"] >= threshold)

    cut = F.transform(cut, lambda x: F.struct(pairs(x["words"]).alias("pairs"), x["unit"].alias("unit")))
    found = F.when(holds(text), F.flatten(F.transform(cut, compared)))
    best = F.array_min(F.transform("found", lambda s: F.struct((-s["score"]).alias("score"), s["license"].alias("license"), s["unit"].alias("unit"))))
    names = F.array_distinct(F.transform("found", lambda s: s["license"]))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), found.alias("found")).withColumn("best", best)
    return rows.select("doc_id", "best.license", (-F.col("best.score")).alias("score"), "best.unit", F.coalesce(F.when(F.col("found").isNotNull(), F.size(names)), F.lit(0)).alias("n_matches"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "license", "score", "n_matches")


def oracle(templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL of :func:`digest`: every unit against every template."""
    rows = ", ".join(f"({quote(name)}, {quote(p)}, {len(bigrams(normal_words(t)))})" for name, t in sorted((templates or TEMPLATES).items()) for p in sorted(bigrams(normal_words(t))))
    return f"""
WITH template(name, pair, size) AS (VALUES {rows}),
units AS (
  SELECT DISTINCT d.rowid AS row_id, u.unit FROM (SELECT row_number() OVER () AS rowid, lower(text) AS text FROM documents) d,
  LATERAL (SELECT unnest(list_concat(list_concat(string_split(d.text, chr(10)), regexp_split_to_array(d.text, '\\n[ \\t\\r]*\\n')), [d.text])) AS unit) u),
words AS (SELECT row_id, unit, list_filter(regexp_split_to_array(unit, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM units),
pairs AS (
  SELECT DISTINCT row_id, unit, w[i] || ' ' || w[i + 1] AS pair FROM (SELECT row_id, unit, w, unnest(range(1, len(w))) AS i FROM words WHERE len(w) > 1)),
sizes AS (SELECT row_id, unit, count(*) AS n FROM pairs GROUP BY row_id, unit),
common AS (SELECT p.row_id, p.unit, t.name, t.size, count(*) AS n FROM pairs p JOIN template t ON p.pair = t.pair GROUP BY ALL),
scored AS (SELECT c.row_id, c.name, 2.0::DOUBLE * c.n / (s.n + c.size) AS score FROM common c JOIN sizes s ON c.row_id = s.row_id AND c.unit = s.unit),
hits AS (SELECT row_id, name, max(score) AS score FROM scored WHERE score >= {threshold}::DOUBLE GROUP BY row_id, name),
ranked AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, name) AS place, count(*) OVER (PARTITION BY row_id) AS n FROM hits)
SELECT d.doc_id, r.name AS license, r.score, CAST(coalesce(r.n, 0) AS INTEGER) AS n_matches
FROM (SELECT row_number() OVER () AS rowid, doc_id FROM documents) d LEFT JOIN ranked r ON r.row_id = d.rowid AND r.place = 1"""

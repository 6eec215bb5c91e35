"""Licence scan by sentence rules.

A text is normalised to words and boundaries, and the known licence sentences
are looked up in it: all words in order, from one boundary to another.  What
stands between the words of a known sentence does not matter, so it may be
wrapped over lines or comment lines and hold stops and semicolons of its own.
What remains of the document is the sequence of the identifiers found.  Rules
are ordered patterns over that sequence: all sentences of a rule in order, with
at most :data:`GAP` other sentences between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sentences end at a semicolon, at a line without letters and digits, and at a stop (with closing
#: marks) that white space or the end follows, but not inside "v. 2.0".
SPLIT = r"""(?!(?<=\bv)\.\s+\d)[.!?]+["')\]”’]*(?=\s|$)|;|\n(?:[^a-z0-9\n]*\n)+"""
#: A known sentence may also begin and end at a line end or a colon, which do not end other sentences.
SOFT = r":(?=\s)|\n"
#: At most so many sentences stand between two sentences of a rule.
GAP = 10

# Normalised sentences of public licence texts and notices, by identifier.
SENTENCES = {
    "mit_notice": "released under the mit license",
    "mit_notice_2": "licensed under the mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                 "associated documentation files the software to deal in the software without restriction",
    "mit_keep": "the above copyright notice and this permission notice shall be included in all copies or substantial "
                "portions of the software",
    "asis": "the software is provided as is without warranty of any kind express or implied",
    "mit_grant_2": "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                   "associated documentation files the software to deal in the software without restriction including "
                   "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
                   "copies of the software and to permit persons to whom the software is furnished to do so subject to "
                   "the following conditions",
    "mit_keep_2": "the above copyright notice and this permission notice including the next paragraph shall be included "
                  "in all copies or substantial portions of the software",
    "asis_2": "the software is provided as is without warranty of any kind express or implied including but not limited "
              "to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache_notice": "licensed under the apache license version 2 0",
    "apache_notice_2": "licensed under the apache license version 2 0 the license",
    "apache_use": "you may not use this file except in compliance with the license",
    "apache_copy": "you may obtain a copy of the license at",
    "gpl3_notice": "this work is licensed under the gnu general public license version 3",
    "gpl2_notice": "this work is licensed under the gnu general public license version 2",
    "gpl_free": "this program is free software",
    "gpl_terms_2": "you can redistribute it and or modify it under the terms of the gnu general public license as published "
                   "by the free software foundation either version 2 of the license or at your option any later version",
    "gpl_terms_3": "you can redistribute it and or modify it under the terms of the gnu general public license as published "
                   "by the free software foundation either version 3 of the license or at your option any later version",
    "cc_by_nc": "licensed under cc by nc 4 0",
    "cc_by": "licensed under cc by 4 0",
    "cc_by_sa": "licensed under cc by sa 4 0",
    "cc0": "to the extent possible under law the author has waived all copyright and related rights to this work",
    "cc_by_2": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc_by_3": "this work is licensed under the creative commons attribution 4 0 international license",
    "cc_by_nc_2": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc_by_nc_3": "this work is licensed under the creative commons attribution noncommercial 4 0 international license",
    "cc_by_sa_2": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc_by_sa_3": "this work is licensed under the creative commons attribution sharealike 4 0 international license",
    "cc0_2": "to the extent possible under law the person who associated cc0 with this work has waived all copyright "
             "and related or neighboring rights to this work",
    "cc0_3": "to the extent possible under law the author s have dedicated all copyright and related and neighboring "
             "rights to this software to the public domain worldwide",
    "bsd_permit": "redistribution and use in source and binary forms with or without modification are permitted provided "
                  "that the following conditions are met",
    "bsd_asis": "this software is provided by the copyright holders and contributors as is",
    "mpl_notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "reserved": "all rights reserved",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is "
                 "hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc_asis": "the software is provided as is and the author disclaims all warranties with regard to this software "
                "including all implied warranties of merchantability and fitness",
    "zero_bsd_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee "
                      "is hereby granted",
    "unlicense_free": "this is free and unencumbered software released into the public domain",
    "unlicense_any": "anyone is free to copy modify publish use compile sell or distribute this software either in source "
                     "code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "zlib_asis": "this software is provided as is without any express or implied warranty",
    "zlib_grant": "permission is granted to anyone to use this software for any purpose including commercial applications "
                  "and to alter it and redistribute it freely subject to the following restrictions",
    "bsl_notice": "distributed under the boost software license version 1 0",
    "lib_free": "this library is free software",
    "lgpl_terms_21": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as "
                     "published by the free software foundation either version 2 1 of the license or at your option any "
                     "later version",
    "lgpl_terms_3": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as "
                    "published by the free software foundation either version 3 of the license or at your option any "
                    "later version",
    "agpl_terms_3": "you can redistribute it and or modify it under the terms of the gnu affero general public license as "
                    "published by the free software foundation either version 3 of the license or at your option any "
                    "later version",
    "epl_notice": "this program and the accompanying materials are made available under the terms of the eclipse public "
                  "license 2 0 which is available at",
    "artistic_terms": "this license establishes the terms under which a given free software package may be copied modified "
                      "distributed and or redistributed",
}
#: The full sentence of the BSD licences, by who provides the software.
BSD_ASIS = {
    f"bsd_asis_{i}": f"this software is provided by {who} as is and any express or implied warranties including but not "
                     "limited to the implied warranties of merchantability and fitness for a particular purpose are "
                     "disclaimed"
    for i, who in enumerate(["the copyright holders and contributors", "the copyright holder and contributors",
                             "the copyright holders", "the copyright holder", "the regents and contributors",
                             "the authors and contributors", "the author and contributors", "the authors",
                             "the author"], 2)
}
SENTENCES |= BSD_ASIS

#: Rules: licence, and the sentences that must stand in this order.
RULES = [
    ("MIT", ["mit_notice"]), ("MIT", ["mit_notice_2"]),
    *[("MIT", [grant, keep, asis]) for grant in ("mit_grant", "mit_grant_2") for keep in ("mit_keep", "mit_keep_2")
      for asis in ("asis", "asis_2")],
    ("Apache-2.0", ["apache_notice"]), ("Apache-2.0", ["apache_notice_2", "apache_use"]),
    ("GPL-3.0", ["gpl3_notice"]), ("GPL-2.0", ["gpl2_notice"]),
    ("GPL-2.0-or-later", ["gpl_free", "gpl_terms_2"]), ("GPL-3.0-or-later", ["gpl_free", "gpl_terms_3"]),
    ("CC-BY-NC-4.0", ["cc_by_nc"]), ("CC-BY-4.0", ["cc_by"]), ("CC-BY-SA-4.0", ["cc_by_sa"]), ("CC0-1.0", ["cc0"]),
    ("CC-BY-NC-4.0", ["cc_by_nc_2"]), ("CC-BY-4.0", ["cc_by_2"]), ("CC-BY-SA-4.0", ["cc_by_sa_2"]),
    ("CC-BY-NC-4.0", ["cc_by_nc_3"]), ("CC-BY-4.0", ["cc_by_3"]), ("CC-BY-SA-4.0", ["cc_by_sa_3"]),
    ("CC0-1.0", ["cc0_2"]), ("CC0-1.0", ["cc0_3"]),
    *[("BSD", ["bsd_permit", asis]) for asis in ("bsd_asis", *BSD_ASIS)], ("MPL-2.0", ["mpl_notice"]),
    ("ISC", ["isc_grant", "isc_asis"]), ("0BSD", ["zero_bsd_grant", "isc_asis"]),
    ("Unlicense", ["unlicense_free", "unlicense_any"]), ("Zlib", ["zlib_asis", "zlib_grant"]), ("BSL-1.0", ["bsl_notice"]),
    *[(f"LGPL-{v}-or-later", [free, terms]) for v, terms in (("2.1", "lgpl_terms_21"), ("3.0", "lgpl_terms_3"))
      for free in ("lib_free", "gpl_free")],
    ("AGPL-3.0-or-later", ["gpl_free", "agpl_terms_3"]), ("EPL-2.0", ["epl_notice"]), ("Artistic-2.0", ["artistic_terms"]),
]


def follows(places: dict[str, list[int]], rule: list[str]) -> bool:
    """Whether the rule's sentences occur in order, each at most ``GAP`` others after the last."""
    ends = places.get(rule[0], [])
    for sentence in rule[1:]:
        at, reached = 0, []
        for p in places.get(sentence, []):  # both ascend; the last end before p is the nearest
            while at < len(ends) and ends[at] < p:
                at += 1
            if at and p - ends[at - 1] <= GAP + 1:
                reached.append(p)
        ends = reached
    return bool(ends)


def finder(split: str, soft: str, known: dict[str, str]):
    """A function from a text to its number of sentences and the known ones
    among them as (number, identifier), in text order.  Of known sentences that
    overlap, the first counts, of those that begin together the longest.

    Known sentences are kept by their first characters; each boundary of the
    text looks up what follows it, so the text is gone through once."""
    import re

    ends, softs = re.compile(split).sub, re.compile(soft).sub
    between, join = re.compile("[^a-z0-9\x01\x02]+").sub, re.compile("[ \x01\x02]*[\x01\x02][ \x01\x02]*").sub
    words, boundaries = str.maketrans("\x01\x02", "  "), re.compile("[\x01\x02]").finditer
    width = min(map(len, known.values()))
    by_start: dict[str, list[tuple[str, str]]] = {}
    for name, sentence in known.items():
        by_start.setdefault(sentence[:width], []).append((f" {sentence} ", name))

    def pieces(part: str) -> int:
        return sum(1 for x in part.split("\x02") if x.strip(" \x01"))

    def find(text: str) -> tuple[int, list[tuple[int, str]]]:
        text = text.lower().replace("\x01", " ").replace("\x02", " ")
        # \x02 stands where sentences end, \x01 where only known ones may, a space between other words
        text = between(" ", softs("\x01", ends("\x02", text)))
        text = "\x02" + join(lambda m: "\x02" if "\x02" in m[0] else "\x01", text).strip(" \x01\x02") + "\x02"
        flat, places = text.translate(words), []
        for boundary in boundaries(text):
            at = boundary.start()
            for sentence, name in by_start.get(flat[at + 1:at + 1 + width], ()):
                end = at + len(sentence) - 1
                if flat.startswith(sentence, at) and text[end] != " ":
                    places.append((at, -end, name))
        n, done, found = 0, 0, []
        for at, end, name in sorted(places):
            if at >= done:
                n += pieces(text[done:at])
                found.append((n, name))
                n, done = n + 1, -end
        return n + pieces(text[done:]), found

    return find


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_sentences, n_known, sentences
    (identifiers in text order, joined by a space), licences (found ones,
    sorted, joined by a comma; empty if none).

    Null and empty texts have no sentences; repeated rows and null ids give rows
    like others; an empty table gives an empty result; other columns are ignored."""
    split, soft, known, rules = SPLIT, SOFT, SENTENCES, RULES
    test, make = follows, finder

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = make(split, soft, known)
        for frame in frames:
            out = []
            for text in frame["text"]:
                n, known_here = find(text)
                ids, places = [name for _, name in known_here], {}
                for at, name in known_here:
                    places.setdefault(name, []).append(at)
                found = sorted({name for name, rule in rules if test(places, rule)}) if ids else []
                out.append((n, len(ids), " ".join(ids), ",".join(found)))
            made = pd.DataFrame(out, columns=["n_sentences", "n_known", "sentences", "licences"])
            made.insert(0, "doc_id", frame["doc_id"].astype("Int64").to_numpy())
            yield made

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return src.mapInPandas(rows, "doc_id long, n_sentences long, n_known long, sentences string, licences string")

"""Licence scans, with DataFrame and SQL functions only.

The notice of a file is all of its lines that speak of licences, wherever they
stand, with a line before and AFTER behind each.  A notice with SPDX tags has the
expressions that they state, as written but for -only, -or-later and + (several
tags: joined by AND), with a cosine of 1.  Others are cut into units, so that
what stands around a licence does not dilute it: sentences, and windows of
SPAN terms, one begun at every STEP terms; units without a word of licences are
left out.  Units and the passages of the licences (tags, sentences, standard
headers and parts of the full texts) become sparse TF-IDF vectors (1 + ln of the
count, times ln((1 + N) / (1 + documents with the term)) + 1, over all notices and
passages).  A notice takes the licence of the passage with the highest cosine to
one of its units, if that is at least ``threshold`` and nothing tells against the
licence: licences that share most of their words must be told apart by what differs
(IN_UNIT: names and versions in the matched unit; IN_NOTICE: clauses in the notice).
A notice that only such a ruled out licence resembles has none.  Files without a licence of
their own inherit that of the nearest ancestor directory that has one: a directory
has the best licence of its licence files, which are those named LICENSE, COPYING
and the like, or with at least half of their characters in sentences that speak of licences.

The texts are read once; work per notice is done once for each distinct unit, and
per directory once for each distinct directory; rows meet both again by
equi-joins, so a notice that a third of all files share costs one vector.  Joins
emit one row per file and, for directories, one per ancestor.

Null texts have no notice; null paths lie in the root and have no ancestors.
Ties in cosine go to the last licence by name.  Each input row gives one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import own_names, stored

THRESHOLD = 0.5
CUES = r"(?i)licen[cs]e|copyright|public domain|creative commons|redistribut|without warrant|permission is hereby|neither the names? of|endorse or promote|permission to use"
NAMED = r"(?i)(^|/)(un)?(licen[cs]e|copying|copyright|notice)([.-][^/]*)?$"
TERM = r"[^a-z0-9.+-]+"
TAG = r"SPDX-License-Identifier: *[A-Za-z0-9.+-]+"
OPENS = "SPDX-License-Identifier:?"
#: A whole tag with its expression as group 1.
EXPRESSION = r"SPDX-License-Identifier:[ \t]*([(]*[A-Za-z0-9.+-]+[)]*(?:[ \t]+(?:OR|AND|WITH)[ \t]+[(]*[A-Za-z0-9.+-]+[)]*)*)"

BEFORE, AFTER = 1, 4
SPAN, STEP = 32, 16

#: Tags, sentences and parts of the public texts of the licences.
PASSAGES = {
    "0BSD": (
        "SPDX-License-Identifier: 0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    ),
    "AGPL-3.0": (
        "SPDX-License-Identifier: AGPL-3.0-only",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc.",
    ),
    "Apache-2.0": (
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ),
    "BSD-2-Clause": (
        "SPDX-License-Identifier: BSD-2-Clause",
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice",
    ),
    "BSD-3-Clause": (
        "SPDX-License-Identifier: BSD-3-Clause",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "BSL-1.0": (
        "SPDX-License-Identifier: BSL-1.0",
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software",
    ),
    "CC-BY-4.0": (
        "SPDX-License-Identifier: CC-BY-4.0",
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "SPDX-License-Identifier: CC-BY-SA-4.0",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC0-1.0": (
        "SPDX-License-Identifier: CC0-1.0",
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.",
    ),
    "EPL-2.0": (
        "SPDX-License-Identifier: EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "Eclipse Public License - v 2.0",
    ),
    "GPL-2.0": (
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "This program is free software, licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc.",
    ),
    "GPL-3.0": (
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.",
    ),
    "ISC": (
        "SPDX-License-Identifier: ISC",
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "LGPL-2.1": (
        "SPDX-License-Identifier: LGPL-2.1-only",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc.",
    ),
    "LGPL-3.0": (
        "SPDX-License-Identifier: LGPL-3.0-only",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.",
    ),
    "MIT": (
        "SPDX-License-Identifier: MIT",
        "Released under the MIT License.",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "MPL-2.0": (
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0",
    ),
    "Unlicense": (
        "SPDX-License-Identifier: Unlicense",
        "This is free and unencumbered software released into the public domain.",
    ),
    "Zlib": (
        "SPDX-License-Identifier: Zlib",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ),
}

_VERSION = r"(version|licen[cs]e|gpl|v)[ -]?v?{}( |$)"
_KINDS = r"affero|agpl|lesser|lgpl|library general"
_NC, _SA, _ND = r"by-nc|non-?commercial", r"-sa( |$)|share-?alike", r"-nd( |$)|no-?deriv"
#: Patterns of which a matched unit must hold all, and one that it must not hold.
IN_UNIT = {
    "AGPL-3.0": (("affero|agpl", _VERSION.format(r"3(\.0)?")), None),
    "Apache-2.0": (("apache", r"[ v-]2(\.0)?( |$)"), None),
    "BSL-1.0": (("boost|person or organization",), None),
    "CC-BY-4.0": ((r"(^| )4\.0( |$)",), f"{_NC}|{_SA}|{_ND}"),
    "CC-BY-NC-4.0": ((r"(^| )4\.0( |$)", _NC), f"{_SA}|{_ND}"),
    "CC-BY-SA-4.0": ((r"(^| )4\.0( |$)", _SA), f"{_NC}|{_ND}"),
    "EPL-2.0": (("eclipse|epl", r"2\.0"), None),
    "GPL-2.0": (("general public|gpl", _VERSION.format(r"2(\.0)?")), _KINDS),
    "GPL-3.0": (("general public|gpl", _VERSION.format(r"3(\.0)?")), _KINDS),
    "LGPL-2.1": (("lesser|lgpl", _VERSION.format(r"2\.1")), None),
    "LGPL-3.0": (("lesser|lgpl", _VERSION.format(r"3(\.0)?")), None),
    "MIT": ((), "boost|person or organization"),
    "MPL-2.0": (("mozilla|mpl",), r"(^| )1\.[01]( |$)"),
}
_NAMES = r"neither[^a-z]+the[^a-z]+names?|3[ -]clause|bsd[ -]style|(new|revised|modified)[ -]bsd"
_PROVIDED = r"(^|[^a-z])isc([^a-z]|$)|provided[^a-z]+that[^a-z]+the[^a-z]+above"
#: The same of lower-cased notices.
IN_NOTICE = {
    "0BSD": ((), _PROVIDED),
    "BSD-2-Clause": ((), f"{_NAMES}|advertising[^a-z]+materials"),
    "BSD-3-Clause": ((_NAMES,), r"advertising[^a-z]+materials"),
    "ISC": ((_PROVIDED,), None),
    "MIT": ((), r"mit[ -]no[ -]attribution|mit-0"),
}


def _holds(text: Column, has: tuple[str, ...], lacks: str | None) -> Column:
    held = [F.regexp_like(text, F.lit(p)) for p in has] + ([~F.regexp_like(text, F.lit(lacks))] if lacks else [])
    return reduce(Column.__and__, held)


def _told_apart(license: Column, unit: Column) -> Column:
    found = F.when(F.lit(False), F.lit(True))
    for name, rule in IN_UNIT.items():
        found = found.when(license == name, _holds(unit, *rule))
    return found.otherwise(F.lit(True))


def _barred(notice: Column) -> Column:
    """The licences that a notice's own clauses rule out."""
    return F.filter(F.array(*[F.when(~_holds(F.lower(notice), *rule), F.lit(name)) for name, rule in IN_NOTICE.items()]), lambda x: x.isNotNull())


def stated(notice: Column) -> Column:
    """The expression of a notice's SPDX tags; null without any."""
    plain = lambda e: F.regexp_replace(F.regexp_replace(e, r"-only|-or-later|[+]", ""), r"[.-]+$|^[(]([^()]*)[)]$", "$1")
    found = F.transform(F.regexp_extract_all(notice, F.lit(EXPRESSION), F.lit(1)), plain)
    found = F.array_sort(F.array_distinct(F.filter(found, lambda e: ~e.isin("", "NONE", "NOASSERTION"))))
    joined = F.array_join(F.transform(found, lambda e: F.when((F.size(found) > 1) & F.contains(e, F.lit(" OR ")), F.concat(F.lit("("), e, F.lit(")"))).otherwise(e)), " AND ")
    return F.nullif(joined, F.lit(""))


def _cue_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(CUES)))


def notice(text: Column) -> Column:
    """The lines of licences with those around them; empty without any."""
    flags = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("x"), F.regexp_like(x, F.lit(CUES)).alias("f")))
    near = lambda i: F.exists(F.slice(flags, F.greatest(i + 1 - AFTER, F.lit(1)), F.lit(AFTER + BEFORE + 1)), lambda y: y["f"])
    # slices near the first line begin there, so they may reach too far ahead
    first = lambda i: F.exists(F.slice(flags, F.lit(1), i + 1 + BEFORE), lambda y: y["f"])
    kept = F.filter(F.transform(flags, lambda y, i: F.struct(y["x"].alias("x"), F.when(i < AFTER, first(i)).otherwise(near(i)).alias("f"))), lambda y: y["f"])
    return F.when(F.regexp_like(text, F.lit(CUES)), F.array_join(F.transform(kept, lambda y: y["x"]), "\n")).otherwise(F.lit(""))


def _terms(text: Column) -> Column:
    """Words without the full stops that end sentences."""
    return F.filter(F.transform(F.split(F.lower(text), TERM), lambda w: F.regexp_replace(w, r"^[.+-]+|[.-]+$", "")), lambda w: w != "")


def _sentences(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"([.;:!?])[ \t\r\n]+", "$1\n"), "\n")


def units(text: Column) -> Column:
    """The sentences of a notice, and windows of its terms, that speak of licences.
    The words that open a tag are no terms: what stands behind them was no licence."""
    text = F.regexp_replace(text, OPENS, " ")
    terms = _terms(text)
    begins = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(terms) - STEP), F.lit(STEP))
    windows = F.transform(begins, lambda i: F.array_join(F.slice(terms, i, SPAN), " "))
    both = F.concat(F.transform(_sentences(text), lambda x: F.array_join(_terms(x), " ")), windows)
    return F.array_distinct(F.filter(both, lambda u: F.regexp_like(u, F.lit(CUES))))


def _counted(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf)."""
    return df.select(key, F.explode(F.split(text, " ")).alias("term")).filter("term <> ''").groupBy(key, "term").agg((F.lit(1.0) + F.log(F.count("*"))).alias("tf"))


def match_notices(notices: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(notice, license, cosine) for notices (notice, n), n the files that have it."""
    spark = notices.sparkSession
    rows = [(f"{name} {k}", name, text) for name, texts in PASSAGES.items() for k, text in enumerate(texts)]
    passages = spark.createDataFrame(rows, "passage string, license string, text string").withColumn("text", F.array_join(_terms(F.col("text")), " "))
    known = _counted(passages, "passage", "text")
    tagged = notices.select("notice", stated(F.col("notice")).alias("license")).filter("license IS NOT NULL").withColumn("cosine", F.lit(1.0))
    plain = notices.filter(stated(F.col("notice")).isNull())
    parts = stored(plain.select("notice", _barred(F.col("notice")).alias("barred"), F.explode(units(F.col("notice"))).alias("unit")))
    whole = notices.select("n", F.explode(F.array_distinct(_terms(F.col("notice")))).alias("term"))
    total = (notices.agg(F.sum("n")).first()[0] or 0) + len(rows)
    spread = whole.groupBy("term").agg(F.sum("n").alias("df")).unionByName(known.groupBy("term").agg(F.count("*").alias("df")))
    weight = F.log(F.lit(1.0 + total) / (F.lit(1.0) + F.col("df"))) + 1
    idf = stored(spread.groupBy("term").agg(F.sum("df").alias("df")).select("term", weight.alias("idf")))
    vector = lambda df: df.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf")).select(*[c for c in df.columns if c != "tf"], "w")
    norm = lambda df, key, to: df.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias(to))
    left, right = vector(_counted(parts.select("unit").distinct(), "unit", "unit")), vector(known)
    # the passages' vectors are constants of this module: some hundred terms
    right = F.broadcast(right.join(norm(right, "passage", "rn"), "passage").select("term", "passage", (F.col("w") / F.col("rn")).alias("rw")))
    dots = left.join(right, "term").groupBy("unit", "passage").agg(F.sum(F.col("w") * F.col("rw")).alias("dot"))
    scored = dots.join(norm(left, "unit", "ln"), "unit").select("unit", "passage", F.round(F.col("dot") / F.col("ln"), 9).alias("cosine"))
    scored = scored.join(F.broadcast(passages.select("passage", "license")), "passage")
    near = scored.filter((F.col("cosine") >= threshold) & _told_apart(F.col("license"), F.col("unit")))
    best = near.groupBy("unit", "license").agg(F.max("cosine").alias("cosine"))
    allowed = parts.join(best, "unit").filter(~F.array_contains("barred", F.col("license")))
    found = allowed.groupBy("notice").agg(F.max(F.struct("cosine", "license")).alias("b")).select("notice", "b.license", "b.cosine")
    return found.unionByName(tagged)


NEW = ("license", "cosine", "how", "license_dir", "n_header_lines")


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """files without the text, with license, cosine, how (``header``,
    ``inherited`` or null), license_dir and n_header_lines (lines that speak of
    licences).  Columns of these names are replaced."""
    keep = [c for c in files.columns if c.lower() not in NEW and c != text_col]
    said, cues, file, dir_, at, given, of = own_names(files, "_notice", "_cues", "_file", "_dir", "_at", "_given", "_of")
    chars = lambda c: F.char_length(F.regexp_replace(c, r"[ \t\r\n]", ""))
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = F.coalesce(F.regexp_like(F.col(path_col), F.lit(NAMED)), F.lit(False))
    lines = F.when(F.regexp_like(text, F.lit(CUES)), _cue_lines(text)).otherwise(F.array().cast("array<string>"))
    base = files.withColumns({cues: lines, said: notice(text)})
    spoken_of = F.filter(_sentences(F.array_join(cues, "\n")), lambda x: F.regexp_like(x, F.lit(CUES)))
    base = stored(
        base.select(
            *keep,
            said,
            F.size(cues).cast("long").alias("n_header_lines"),
            F.when(F.size(cues) == 0, F.lit(False)).otherwise(named | (2 * chars(F.array_join(spoken_of, "")) >= chars(text))).alias(file),
            F.coalesce(F.regexp_replace(path_col, "/?[^/]*$", ""), F.lit("")).alias(dir_),
        )
    )
    # files without a notice skip the join, where they would all share one key
    silent = base.filter(F.col(said) == "").withColumns({"license": F.lit(None).cast("string"), "cosine": F.lit(None).cast("double")})
    spoken = base.filter(F.col(said) != "")
    notices = stored(spoken.groupBy(F.col(said).alias("notice")).agg(F.count("*").alias("n")))
    matched = match_notices(notices, threshold).withColumnRenamed("notice", of)
    own = stored(spoken.join(matched, F.col(said) == F.col(of), "left").drop(of).unionByName(silent).drop(said))
    holders = own.filter(F.col(file) & F.col("license").isNotNull()).groupBy(F.col(dir_).alias(at)).agg(F.max(F.struct("cosine", "license")).alias(given))
    parts = F.split(dir_, "/")
    # every directory with each of its ancestors and itself; the root is the empty path
    above = own.filter("license IS NULL").select(dir_).distinct().select(dir_, F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"))
    above = above.withColumn(at, F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/")).filter((F.col("depth") == 0) | (F.col(at) != ""))
    nearest = above.join(holders, at).groupBy(F.col(dir_).alias(of)).agg(F.max_by(F.struct(given, at), "depth").alias("n")).select(of, F.col(f"n.{given}").alias(given), F.col(f"n.{at}").alias(at))
    found = own.join(nearest, (F.col(dir_) == F.col(of)) & F.col("license").isNull(), "left")
    return found.select(
        *keep,
        F.coalesce("license", F.col(given)["license"]).alias("license"),
        F.coalesce("cosine", F.col(given)["cosine"]).alias("cosine"),
        F.when(F.col("license").isNotNull(), "header").when(F.col(given).isNotNull(), "inherited").alias("how"),
        F.when(F.col("license").isNull(), F.col(at)).alias("license_dir"),
        "n_header_lines",
    )

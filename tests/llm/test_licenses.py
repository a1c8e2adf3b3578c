"""Licence scans on a small tree of files."""

import math
import re
from collections import Counter

from sagebrush.llm import licenses as lc


def test_inheritance_and_headers(spark):
    mit, apache, gpl = lc.PASSAGES["MIT"][1], lc.PASSAGES["Apache-2.0"][1], lc.PASSAGES["GPL-3.0"][2]
    code = "int main() {\n  return 0; // the rest of a long file that says nothing of it\n}\n" * 5
    rows = [
        ("LICENSE", mit + "\n" + code), ("a/x.c", code), ("a/b/LICENSE.txt", apache), ("a/b/c/y.c", code), ("a/b/c/z.c", f"// {gpl}\n{code}"),
        ("q/short.txt", "some\n" + gpl), ("q/deep/er/w.c", code), ("q/none.c", "a license of an unknown and made up kind, entirely different words here"), (None, code), ("r/null.c", None),
    ]
    files = spark.createDataFrame([(i, p, t, "old") for i, (p, t) in enumerate(rows)], "id int, path string, text string, license string")
    out = {r["id"]: (r["license"], r["how"], r["license_dir"]) for r in lc.scan(files).collect()}
    assert out == {
        0: ("MIT", "header", None), 1: ("MIT", "inherited", ""), 2: ("Apache-2.0", "header", None), 3: ("Apache-2.0", "inherited", "a/b"), 4: ("GPL-3.0", "header", None),
        5: ("GPL-3.0", "header", None), 6: ("GPL-3.0", "inherited", "q"), 7: ("GPL-3.0", "inherited", "q"), 8: ("MIT", "inherited", ""), 9: ("MIT", "inherited", ""),
    }
    assert lc.scan(files.limit(0)).count() == 0


MIT = """MIT License

Copyright (c) 2021 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
APACHE = """/*
 * Copyright 2019 The Authors.
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *      http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */
"""
GPL3 = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
"""
GPL3_TEXT = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.
"""
BSD = """Copyright (c) 2015, Some One
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_standard_texts(spark):
    code = "\n".join(f"x{i} = call_{i}(y{i})" for i in range(40))
    prose = " ".join(f"word{i} of this long text" for i in range(60))
    rows = {
        "m/LICENSE": (MIT, "MIT"), "m/src/a.c": (code, "MIT"), "a/x.java": (APACHE + code, "Apache-2.0"), "g/x.py": (GPL3 + code, "GPL-3.0"),
        "g3/COPYING": (GPL3_TEXT + prose, "GPL-3.0"), "g3/b.c": (code, "GPL-3.0"), "b/LICENSE.md": (BSD, "BSD-3-Clause"), "b/q/r.c": (code, "BSD-3-Clause"),
        "s/a.c": ("// SPDX-License-Identifier: MIT\n" + code, "MIT"), "s/b.c": ("// SPDX-License-Identifier: GPL-3.0-only\n" + code, "GPL-3.0"),
        "s/c.c": ("// SPDX-License-Identifier: Apache-2.0\n" + code, "Apache-2.0"), "o/one.txt": (f"{prose}. Released under the MIT License. {prose}", "MIT"),
        "o/none.txt": (f"{prose} no licence was ever given for this {prose}", None),
    }
    for one in (False, True):  # with other files around, and in one line
        files = spark.createDataFrame([(p, t.replace("\n", " ") if one else t) for p, (t, _) in rows.items()], "path string, text string")
        out = {r["path"]: r["license"] for r in lc.scan(files).collect()}
        assert out == {p: want for p, (_, want) in rows.items()}


def test_inner_names_and_odd_rows(spark):
    names = "_notice _cues _file _dir _at _given _of _text depth n term notice".split()
    rows = [("LICENSE", MIT), ("LICENSE", MIT), (None, None), ("x/y", ""), ("x/y", "licence " * 20000)]
    files = spark.createDataFrame([(i, p, t, *range(len(names))) for i, (p, t) in enumerate(rows)], ["id", "path", "text", *names])
    out = lc.scan(files)
    kept = [c for c in files.columns if c != "text"]
    assert sorted(map(str, out.select(*kept).collect())) == sorted(map(str, files.select(*kept).collect()))
    assert {r["id"]: r["license"] for r in out.collect()} == dict.fromkeys(range(5), "MIT")


def test_cosine_by_hand(spark):
    notices = [("Released under the MIT License. Copyright me", 3), ("Licensed under CC BY-NC 4.0.", 1), (APACHE, 2)]
    terms = lambda x: [w for w in (re.sub(r"^[.+-]+|[.-]+$", "", t) for t in re.split(lc.TERM, x.lower())) if w]
    passages = [(name, Counter(terms(t))) for name, texts in lc.PASSAGES.items() for t in texts]
    docs = [(set(terms(h)), n) for h, n in notices] + [(set(t), 1) for _, t in passages]
    total, df = sum(n for _, n in docs), Counter()
    for t, n in docs:
        df.update(dict.fromkeys(t, n))
    vec = lambda t: {w: (1 + math.log(c)) * (math.log((1 + total) / (1 + df[w])) + 1) for w, c in t.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    best = {}
    for h, _ in notices:
        all_ = terms(h)
        units = [terms(x) for x in [*re.split(r"(?<=[.;:!?])[ \t\r\n]+|\n", h), *re.findall(lc.TAG, h)]] + [all_[i : i + lc.SPAN] for i in range(0, max(1, len(all_) - lc.STEP), lc.STEP)]
        for u in (u for u in units if re.search(lc.CUES, " ".join(u))):
            a = vec(Counter(u))
            top = max((sum(a[w] * b.get(w, 0) for w in a) / norm(a) / norm(b), name) for name, b in ((k, vec(t)) for k, t in passages))
            best[h] = max(best.get(h, (0, "")), top)
    out = lc.match_notices(spark.createDataFrame(notices, "notice string, n long"), 0.0).collect()
    assert len(out) == 3
    for r in out:
        cosine, name = best[r["notice"]]
        assert r["license"] == name and abs(r["cosine"] - cosine) < 1e-8


BSD_2 = """Copyright (c) 2015, Some One

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
"""
BSD_4 = BSD_2.replace("\nTHIS", "\n3. All advertising materials mentioning features or use of this software must\n   display an acknowledgement.\n\nTHIS", 1)
AGPL3, LGPL3 = (GPL3.replace("GNU General", f"GNU {kind} General") for kind in ("Affero", "Lesser"))
LGPL3 = LGPL3.replace("This program", "This library")
LGPL21 = LGPL3.replace("version 3", "version 2.1")
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted{}

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES.
"""
BOOST = """Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works.
"""
ZLIB = """This software is provided 'as-is', without any express or implied warranty.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
"""


def test_near_licences_told_apart(spark):
    code = "\n".join(f"x{i} = call_{i}(y{i})" for i in range(40))
    tag = "// SPDX-License-Identifier: "
    cases = [
        (BSD_2, "BSD-2-Clause"), (BSD, "BSD-3-Clause"), (BSD_4, None), (GPL3, "GPL-3.0"), (AGPL3, "AGPL-3.0"), (LGPL3, "LGPL-3.0"), (LGPL21, "LGPL-2.1"),
        (GPL3.replace("version 3", "version 2"), "GPL-2.0"), (GPL3.replace("version 3", "version 9"), None), (MIT, "MIT"), (BOOST, "BSL-1.0"), (ZLIB, "Zlib"),
        (ISC.format(",\nprovided that the above copyright notice appear in all copies."), "ISC"), (ISC.format("."), "0BSD"),
        ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"), ("Licensed under CC BY-NC-SA 4.0.", None),
        (tag + "AGPL-3.0-only", "AGPL-3.0"), (tag + "MIT OR Apache-2.0", "MIT OR Apache-2.0"), (tag + "(MIT AND BSD-3-Clause)", "MIT AND BSD-3-Clause"),
        (tag + "GPL-2.0-or-later WITH Classpath-exception-2.0", "GPL-2.0 WITH Classpath-exception-2.0"), (tag + "LicenseRef-Own.\n" + MIT, "LicenseRef-Own"),
        (f"{tag}MIT OR ISC\n{tag}Zlib", "(MIT OR ISC) AND Zlib"), (tag + "NONE", None), (tag + "<id>", None),
    ]
    files = spark.createDataFrame([(i, f"{i}/x.c", t + "\n" + code) for i, (t, _) in enumerate(cases)], "id int, path string, text string")
    out = {r["id"]: r["license"] for r in lc.scan(files).collect()}
    assert out == {i: want for i, (_, want) in enumerate(cases)}


def test_query_equals_sql_on_standard_texts(spark, tmp_path):
    import duckdb

    from sagebrush.llm import queries

    tags = "\n".join(["// SPDX-License-Identifier: MIT OR ISC", "// SPDX-License-Identifier: (Zlib)"])
    texts = [MIT, APACHE, GPL3, GPL3_TEXT, BSD, BSD_2, BSD_4, AGPL3, LGPL3, LGPL21, ISC.format("."), BOOST, ZLIB, tags, "// SPDX-License-Identifier: NONE", "Licensed under CC BY-NC-SA 4.0.", None, "none"]
    docs = spark.createDataFrame([(i, t, f"s{i % 3}" if i % 4 else None) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op3_license_scan(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(out.columns)} FROM ({queries.OP3_SQL})").fetchall()
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))

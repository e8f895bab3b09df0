"""Licence rules on small texts."""

import random

import duckdb

from tenderloom.llm import licenses

TEXTS = {
    1: "Intro.\nLicensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.\nmore",
    2: None,
    3: "",
    4: "Released under the MIT License. Words.\nAll rights reserved.\nreleased  under the MIT license",
    5: "not Licensed under CC BY-NC 4.0 at all",
    6: "Licensed under CC BY-NC 4.0.",
    7: "x " * 200_000 + "\nThis work is licensed under the GNU General Public License, version 3.",
}


def test_scan(spark):
    rows = [*TEXTS.items(), (1, TEXTS[1]), (None, TEXTS[6])]
    docs = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, licenses string")
    got = {r.doc_id: (r.licenses, r.n_sentences) for r in licenses.license_scan(docs).collect()}
    assert got == {
        1: ("Apache-2.0", 2),
        2: ("", 0),
        3: ("", 0),
        4: ("MIT,All-Rights-Reserved", 3),
        5: ("", 0),
        6: ("CC-BY-NC-4.0", 1),
        7: ("GPL-3.0-only", 1),
        None: ("CC-BY-NC-4.0", 1),
    }
    assert licenses.license_scan(docs).count() == len(rows)
    assert licenses.license_scan(docs.limit(0)).count() == 0


def test_padded_sentences(spark):
    texts = ["/" + "*" * 400 + " All rights reserved " + "*" * 400 + "/", "Released" + " " * 3000 + "under the MIT --- License"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses.license_scan(docs).collect()}
    assert got == {0: "All-Rights-Reserved", 1: "MIT"}


NOTICES = {
    "MIT": """MIT License

Copyright (c) 2020 Jane Doe

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
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.
""",
    "APACHE": """Copyright 2020 Jane Doe

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS.
""",
    "ASF": """Licensed to the Apache Software Foundation (ASF) under one
or more contributor license agreements.  The ASF licenses this file
to you under the Apache License, Version 2.0 (the
"License"); you may not use this file except in compliance
with the License.  You may obtain a copy of the License at
  http://www.apache.org/licenses/LICENSE-2.0
""",
    "GPL3": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
""",
    "LGPL": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
""",
    "AGPL": """Foo is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
""",
    "BSD": """Copyright (c) 2020, Jane Doe
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
""",
    "BSD3": """3. Neither the name of Jane Doe & Sons nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
""",
}


def test_notices_as_they_read(spark):
    n = NOTICES
    wanted = [
        (n["MIT"], "MIT"),
        (n["MIT"].split("\n\n", 2)[2], "MIT"),
        (n["MIT"].replace("\n\n", "@").replace("\n", " ").replace("@", "\n\n"), "MIT"),
        (n["APACHE"], "Apache-2.0"),
        (n["APACHE"].replace("License", "Licence"), "Apache-2.0"),
        (n["ASF"], "Apache-2.0"),
        (n["GPL3"], "GPL-3.0-or-later"),
        (n["GPL3"].replace("software:", "software;").replace("Foundation,", "Foundation;"), "GPL-3.0-or-later"),
        (n["GPL3"].replace("software:", "software;").replace("version 3", "version 2"), "GPL-2.0-or-later"),
        (n["GPL3"].replace("either version 3 of the License, or\n(at your option) any later version", "version 3"), "GPL-3.0-only"),
        (n["LGPL"], "LGPL-2.1-or-later"),
        (n["AGPL"], "AGPL-3.0-or-later"),
        (n["BSD"], "BSD-2-Clause,All-Rights-Reserved"),
        (n["BSD"] + n["BSD3"], "BSD-3-Clause,All-Rights-Reserved"),
        (n["ISC"], "ISC"),
        ("// SPDX-License-Identifier: BSD-3-Clause\nint x;", "BSD-3-Clause"),
        ("This work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International License.", "CC-BY-NC-4.0"),
        ("This work is licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
        ("The permission is granted to read; this program is free.\nWarranty of any kind.", ""),
    ]
    rows = []
    for text, _ in wanted:
        for mark in ("", "# ", "// ", " * ", "    "):
            rows.append((len(rows), "code\n" + "".join(mark + line + "\n" for line in text.split("\n")) + "more code"))
        rows.append((len(rows), text.replace("\n", "\r\n")))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses.license_scan(docs).collect()}
    assert [(i, got[i]) for i in sorted(got)] == [(i, wanted[i // 6][1]) for i in range(len(rows))]


def test_short_forms_as_in_the_statement(spark, tmp_path):
    rng = random.Random(3)
    # With words in front, "this program is free software" is a notice, which the statement does not know.
    parts = [*sorted(set(licenses.SENTENCES) - {"this program is free software"}), "all Rights (reserved)", "word", "a word\n"]
    ends = [". ", ".\n", "\n\n", "; ", ", ", " ", "...", "\r\n * "]
    rows = [(i, "".join(rng.choice(parts) + rng.choice(ends) for _ in range(rng.randint(0, 12)))) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in con.execute(licenses.OP2_SQL).fetchall()}
    got = {r[0]: tuple(r)[1:] for r in licenses.op2_licenses(spark, str(tmp_path)).collect()}
    assert [(i, got[i], want[i]) for i in got if got[i] != want[i]] == []

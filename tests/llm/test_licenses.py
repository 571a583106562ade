import re

import duckdb
import pyarrow as pa

from loomlog.llm import licenses

MIT = """The MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software, to deal in the Software. The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""
ROWS = [
    (1, None), (2, ""), (3, "Nothing legal here.\nAt all."), (4, "Text.\nReleased under the MIT License.\nMore"), (5, MIT),
    (6, "Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0!"), (7, GPL), (8, "All rights reserved"), (9, "Some odd licence text."),
    (10, 'Licensed under the Apache License, Version 2.0 (the "License"). x'), (10, "Licensed under the Apache License, Version 2.0."),
    (None, "SPDX-License-Identifier: MIT"), (11, "Licensed under CC BY-NC 4.0.\n" * 3000), (12, "ſpdx LICENSE É\x0b. Copyright"),
    (13, "This project is licensed under the MIT License."), (14, "The MIT licensed code base is a licence nightmare."),
    (15, "All rights reserved seats are licensed."), (16, "Released under the MIT licensees agreement."), (17, "SPDX-License-Identifier: LGPL-3.0-only"),
    (18, "The source code of this tool is distributed under the terms of the GNU Affero General Public License, version 3."),
    (19, "This is not licensed under the MIT License."), (20, "Released under CC0-1.0.\nLicensed under the GPLv2 or later."),
    (21, "Copyright (c) 2020 Someone. All rights reserved."), (22, "the license" * 3000),
    (25, MIT.replace("Someone", "Someone. All rights reserved.")), (26, "The MIT License (MIT)\nPermission is hereby granted, free of charge, to any person obtaining a copy"),
    (27, "// SPDX-License-Identifier: MIT OR Apache-2.0"), (28, "Licensed under either of Apache License, Version 2.0 or MIT license at your option."),
    (29, "Dual licensed under MIT and GPLv3."), (30, "".join(f"# {line}\n" for line in GPL.split("\n"))), (31, GPL.replace("This program", "Foo")),
    (32, "/*\n" + "".join(f" * {line}\r\n" for line in GPL.split("\n")) + " */"), (33, "SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception"),
    (34, "SPDX-License-Identifier: GPL-2.0+ WITH Classpath-exception-2.0"), (35, "Released under the MIT License and whatever you like."),
    (36, "Licensed under the GNU GPL v3 or any later version."), (37, "SPDX-License-Identifier: GPL-2.0-or-later OR (MIT AND BSD-3-Clause)"),
    (38, "Licensed under MIT or orlater and"), (39, "licensed under mit\n" + " " * 50_000 + "X"), (40, "Available under the ISC license\n* or so"),
    (41, "Bar is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    (23, "Released under MIT."), (24, "Published under CC-BY 4.0\nReleased under Iscariot."),
]
WANT = {1: "", 2: "", 3: "", 4: "MIT", 5: "MIT", 6: "CC-BY-4.0,CC-BY-NC-4.0", 7: "GPL-3.0-or-later", 8: "Proprietary", 9: "", 11: "CC-BY-NC-4.0"}
WANT |= {13: "MIT", 14: "", 15: "", 16: "", 17: "LGPL-3.0-only", 18: "AGPL-3.0-only", 19: "", 20: "CC0-1.0,GPL-2.0-or-later", 21: "Proprietary", 22: "", 23: "MIT", 24: "CC-BY-4.0"}
WANT |= {25: "MIT", 26: "MIT", 27: "Apache-2.0,MIT", 28: "Apache-2.0,MIT", 29: "GPL-3.0-only,MIT", 30: "GPL-3.0-or-later", 31: "GPL-3.0-or-later"}
WANT |= {32: "GPL-3.0-or-later", 33: "Apache-2.0 WITH LLVM-exception", 34: "GPL-2.0-or-later WITH Classpath-exception-2.0", 35: "", 36: "GPL-3.0-or-later"}
WANT |= {37: "BSD-3-Clause,GPL-2.0-or-later,MIT", 38: "", 39: "MIT", 40: "ISC", 41: "GPL-2.0-only"}


def test_every_known_sentence_is_legal_and_normal():
    named = licenses.whole()
    for s in [*licenses.SENTENCES.values(), *licenses.WHOLE.values(), *(t for name, texts in named.items() for t in texts if "licens" in t)]:
        assert re.search(licenses.LEGAL, s) and re.fullmatch(r"[a-z0-9]+( [a-z0-9]+)*", s)
    assert all(s in licenses.SENTENCES or s in named for seq, _ in licenses.RULES for s in seq)


def test_recognises_and_equals_sql(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, sentences string")
    got = licenses.scan(df).collect()
    of = {r.doc_id: r for r in got}
    assert {i: of[i].licences for i in WANT} == WANT
    assert of[9].status == "unrecognised" and of[1].status == "none" and of[5].status == "recognised"
    db = duckdb.connect()
    db.register("documents", pa.table({"doc_id": [r[0] for r in ROWS], "text": [r[1] for r in ROWS]}))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, db.execute(licenses.scan_sql()).fetchall())) == sorted(map(key, got))
    assert licenses.scan(df.limit(0)).count() == 0
    plan = licenses.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

"""Licences against DuckDB, by the SQL that weighs all lines."""

import random

import duckdb

from chronolith.llm import license_scan as ls
from chronolith.llm.license_texts import TEXTS


def test_licenses(spark):
    rng = random.Random(6)
    filler = ["the", "of", "work", "under", "version", "License", "alpha", "Beta", "é", "all", "rights"]
    rows = [(1, "a/b/LICENSE", "Released under the MIT License."), (2, "a/b/c/x.py", "print"), (3, "a/y.py", None), (4, None, "All rights reserved."), (None, "a/b/z", "All rights reserved."), (5, "top", ""), (6, "COPYING", "This work is licensed under the GNU General Public License, version 3."), (6, "COPYING", "This work is licensed under the GNU General Public License, version 3."), (7, "q/r", "code\nLicensed under the Apache License, Version 2.0\nmore"), (8, "a//d/e", "x"), (9, None, "plain")]
    mit, bsd = (next(t for n, t in TEXTS if n == name) for name in ("MIT", "BSD-3-Clause"))
    gpl = next(t for n, t in TEXTS if n == "GPL-3.0")
    rows += [(200, "m/LICENSE", "Copyright (c) 2020 A. Person\n\n" + mit.replace("MIT License\n", "").replace(" of ", " of\n")), (201, "m/deep/er/x.c", "int main"), (202, "n/LICENSE.txt", "Copyright 1999\n" + bsd), (203, "n/x.py", "x = 1"), (204, "g/x.c", "/*\n * " + gpl.replace(" under", "\n * under").replace(" either", "\n * either") + "\n *\n * more\n */\n" + "".join(f"x{k} = y{k} + z{k}\n" for k in range(90))), (205, "g/y.c", "y"), (206, "long/x", "alpha beta " * 40_000 + mit)]
    for i in range(20, 120):
        text = "\n".join(" ".join(rng.choice(filler) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 6)))
        if rng.random() < 0.3:
            text += "\n" + rng.choice(ls.TEMPLATES)[1].upper()[: rng.randint(10, 90)]
        rows.append((i, "/".join(rng.choice("abcd") for _ in range(rng.randint(0, 4))) + f"/{i}", text))
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, path string, text string, term string").repartition(3)
    got = ls.scan_licenses(frame)
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    con = duckdb.connect()
    con.execute("create table f(doc_id bigint, path varchar, text varchar)")
    con.executemany("insert into f values (?, ?, ?)", rows)
    want = con.sql(ls.oracle("select * from f")).fetchall()
    norm = lambda rs: sorted(((*r[:4], r[4] if r[4] is None else round(r[4], 5), r[5]) for r in map(tuple, rs)), key=str)
    assert norm(got.collect()) == norm(want)
    found = {r.doc_id: (r.license, r.origin) for r in got.collect()}
    assert [found[k] for k in range(200, 206)] == [("MIT", "header"), ("MIT", "directory"), ("BSD-3-Clause", "header"), ("BSD-3-Clause", "directory"), ("GPL-3.0", "header"), ("GPL-3.0", "directory")]  # the last from the root
    assert {r.origin for r in got.collect()} == {"header", "directory", "none"}
    assert ls.scan_licenses(frame.limit(0)).count() == 0

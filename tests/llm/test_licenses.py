import math
import re

import pytest
from llm_tables import of
from pyspark.sql import functions as F

from parley.llm import licenses, queries

LINE = "Licensed under the Apache License, Version 2.0."
FILES = [
    (1, "a/LICENSE", "MIT License\nReleased under the MIT License."),
    (2, "a/x.txt", "plain prose of nothing"),
    (3, "a/b/c/y.txt", "plain prose\n" + LINE + "\nmore"),
    (4, "a/b/c/z.txt", None),
    (5, "a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."),
    (6, "a/b/c/w.txt", "under the version of the license to you"),
    (7, "other/q.txt", ""),
    (8, "LICENSE.txt", "no licence in here"),
    (9, None, "plain"),
    (9, None, "plain"),
    (None, "a/x.txt", "second row of the path"),
    (10, "a/bb/v.txt", "Released under the MIT License. " + "and much more prose follows " * 30),
]


def brute(rows, templates=licenses.TEMPLATES, threshold=licenses.THRESHOLD):
    words = lambda t: [w for w in re.split("[^a-z0-9]+", (t or "").lower()) if w]
    total = len(rows)
    vocabulary = {w for _, t in templates for w in words(t)}
    having = {w: sum(w in words(t) for _, _, t in rows) for w in vocabulary}
    idf = {w: math.log((1 + total) / (1 + n)) + 1 for w, n in having.items()}
    highest = math.log(1 + total) + 1

    def vector(text):
        return {w: words(text).count(w) * idf.get(w, highest) for w in set(words(text))}

    def cosine(a, b):
        norm = math.sqrt(sum(x * x for x in a.values())) * math.sqrt(sum(x * x for x in b.values()))
        return sum(x * b.get(w, 0) for w, x in a.items()) / norm if norm else 0.0

    own = {}
    for _, path, text in rows:
        path = path or ""
        units = (text or "").split("\n")
        if re.search(licenses.LICENCE_FILES, path.split("/")[-1]):
            units.append(text or "")
        for unit in units:
            for licence, template in templates:
                score = round(cosine(vector(unit), vector(template)), 9)
                if score >= threshold:
                    own[path] = min(own.get(path, (0, "")), (-score, licence))
    offered = {}
    for path, (less, licence) in own.items():
        *above, name = path.split("/")
        if re.search(licenses.LICENCE_FILES, name):
            key = "/".join(above)
            offered[key] = min(offered.get(key, (0, "", "")), (less, licence, path))
    out = []
    for doc, path, _ in rows:
        path = path or ""
        above = path.split("/")[:-1]
        near = next((d for d in ("/".join(above[:n]) for n in range(len(above), -1, -1)) if d in offered), None)
        if path in own:
            out.append((doc, path, own[path][1], -own[path][0], own[path][1], None))
        else:
            out.append((doc, path, None, None, offered[near][1] if near is not None else None, near))
    return sorted(out, key=lambda r: tuple((x is not None, str(x)) for x in r))


def test_against_brute_force(spark):
    df = spark.createDataFrame(FILES, "doc_id long, path string, text string")
    found = of(licenses.scan(df))
    assert found == brute(FILES)
    told = {r[0]: r[4] for r in found}
    assert told[3] == "Apache-2.0" and told[4] == told[6] == "GPL-3.0" and told[2] == "MIT" and told[7] is None


def test_registered_query_against_brute_force(spark, docs):
    rows = [tuple(r) for r in queries.with_paths(docs).select("doc_id", "path", "text").collect()]
    assert of(queries.queries()["op9_license_scan"](spark, "/root/testdata/sf0.001")) == brute(rows)


def test_clashing_columns_and_empty_table(edge, none):
    df = edge.withColumns({"path": F.col("source"), "licence": F.lit(1), "unit_id": F.lit(2), "directory": F.lit("d")})
    assert licenses.scan(df).count() == edge.count()
    assert licenses.scan(none.withColumn("path", F.lit("p"))).count() == 0


def test_words_left_out_can_never_reach_the_threshold():
    vocabulary = sorted({w for _, t in licenses.TEMPLATES for w in licenses.words_of(t)})
    idf = {w: 1.0 + (len(w) % 5) for w in vocabulary}
    vectors = licenses.template_vectors(licenses.TEMPLATES, idf)
    anchors = set(licenses.anchors_of(vectors, licenses.THRESHOLD))
    for number in range(len(licenses.TEMPLATES)):
        rest = sum(v * v for t, _, w, v in vectors if t == number and w not in anchors)
        assert math.sqrt(rest) < licenses.THRESHOLD


@pytest.mark.parametrize(("path", "directory"), [("a/b/c.txt", "a/b"), ("c", ""), ("/a//b/", "a/b"), ("", "")])
def test_directories(spark, path, directory):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(licenses.directory_of(F.col("p"))).first()[0] == directory


def test_no_python_in_the_plan(docs):
    plan = licenses.scan(queries.with_paths(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_number_of_files_does_not_decide(spark):
    notice = "Our new server: licensed under the Apache License, Version 2.0."
    some = [notice, "Our new server.", "A new server of our own.", "plain prose", "under the moon", "nothing else"]
    shape = "doc_id long, path string, text string"
    for copies in (1, 100):
        rows = [(i, f"{i}.txt", text) for i, text in enumerate(some * copies)]
        told = licenses.scan(spark.createDataFrame(rows, shape)).filter(F.col("doc_id") % len(some) == 0)
        assert {r["license"] for r in told.collect()} == {"Apache-2.0"}


def test_wrapped_headers_and_full_texts(spark):
    bsd = """# Copyright Acme
# Redistribution and use in source and binary
#   forms, with or without modification, are permitted
# provided that the following conditions are met:
# here goes more of it, told in many other words
def f():
    return 1"""
    mit = "Copyright (c) 2020 Acme Inc.\n\n" + dict(licenses.FULL_TEXTS)["MIT"]
    rows = [(1, "a/x.py", bsd), (2, "b/LICENSE", mit), (3, "b/c/y.py", "x = 1"), (4, "d/LICENSE", "plain prose " * 200)]
    rows += [(i, f"e/{i}.txt", "the plain prose of a file and of the other files\n" * 3) for i in range(10, 60)]
    found = {r[0]: r[4] for r in of(licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")))}
    assert (found[1], found[2], found[3]) == ("BSD-3-Clause", "MIT", "MIT")
    assert {x for i, x in found.items() if i > 3} == {None}

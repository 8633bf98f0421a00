"""Licence files without a header line, and notices wrapped over lines."""

from slantree.llm import license_scan


def test_whole_texts_and_wrapped_notices(spark):
    texts = dict(license_scan.full_texts())
    mit = "Copyright (c) 2001 Some Body\n\n" + texts["MIT"]
    named = [(k, f"/{name}/LICENSE", text) for k, (name, text) in enumerate(sorted(texts.items()))]
    rows = named + [
        (100, "/m/LICENSE.txt", mit),
        (101, "/m/deep/x.py", "print(1)"),
        (102, "/w/a.c", "/* This program is free software under the GNU Affero\n * General Public License, version 3. */\nint x;"),
        (103, "/w/b.c", "# This work is dedicated to the public\n# domain under CC0 1.0 Universal.\n"),
        (104, "/p/LICENSE", "Nothing here says anything about terms."),
    ]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert len(got) == len(rows)
    assert {path.split("/")[1]: got[k]["own_license"] for k, path, _ in named} == {name: name for name in texts}
    assert got[100]["own_license"] == "MIT" and (got[101]["license"], got[101]["inherited_from"]) == ("MIT", "/m")
    assert got[102]["own_license"] == "AGPL-3.0" and got[103]["own_license"] == "CC0-1.0"
    assert got[104]["license"] is None and got[104]["own_score"] == 0

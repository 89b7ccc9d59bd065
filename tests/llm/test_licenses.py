import duckdb

from tillwise.llm.licenses import KNOWN, TEXTS, known_digests, scan_licenses
from tillwise.llm.oracles import ORACLES
from tillwise.llm.queries import op1_licenses

MIT = next(text for name, text in KNOWN if name == "MIT" and len(text) > 500)
ROWS = [
    (1, "Copyright (c) 2020 Someone\n\n" + MIT), (2, MIT.upper().replace(",", " ,\n").replace("sublicense", "sub-licence")),
    (3, MIT + " and more"), (4, "Text.\nLICENSED under the Apache Licence — version 2.0\nmore"), (5, None), (6, ""),
    (7, "© All\nLicensed under CC BY 4.0"), (None, "Released under the MIT license"), (8, "x" * 300_000), (8, " \t"),
    (9, "  copyright holders\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License"),
]


def test_canonical_lookup(spark, frame):
    docs = frame(ROWS).selectExpr("*", "1 as licenses", "2 as digest")
    rows = scan_licenses(docs, known_digests(spark)).collect()
    got = {r.doc_id: (r.licenses.whole_text, r.licenses.lines) for r in rows}
    assert got[1][0] == got[2][0] == "MIT" and got[3][0] is None
    assert got[4] == (None, ["Apache-2.0"])
    assert got[5] == got[6] == (None, [])
    assert got[7] == ("CC-BY-4.0", ["CC-BY-4.0"]) and got[None] == ("MIT", ["MIT"])
    assert got[9] == (None, ["CC-BY-NC-4.0", "MIT"])
    assert scan_licenses(frame([]), known_digests(spark)).count() == 0


def test_query_matches_its_sql(spark, frame, tmp_path):
    frame(ROWS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (str(tmp_path), "/root/testdata/sf0.001"):
        names = ["doc_id", "canonical_sha256", "license", "line_licenses"]
        got = sorted((tuple(r) for r in op1_licenses(spark, folder).select(names).collect()), key=str)
        path = f"{folder}/documents.parquet" + ("/*.parquet" if folder == str(tmp_path) else "")
        base = duckdb.connect()
        base.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
        assert sorted(base.execute(ORACLES["op1_licenses"]).fetchall(), key=str) == got


def test_whole_texts_with_and_without_title(spark, frame):
    text = lambda name: (TEXTS / f"{name}.txt").read_text()
    isc = next(x for name, x in KNOWN if name == "ISC")
    bsd = text("BSD-3-Clause")
    rows = {
        "MIT": ["MIT License\n\nCopyright (c) 2020 Someone\n\n" + MIT, "The MIT License (MIT)\n\n" + MIT],
        "ISC": ["ISC License\n\nCopyright (c) 2020, Someone\n\n" + isc],
        "BSD-3-Clause": ["BSD 3-Clause License\n\nCopyright (c) 2020, Someone\nAll rights reserved.\n\n" + bsd,
                         bsd.replace("HOLDER OR", "OWNER OR").replace("1. ", "- ").replace("2. ", "- ").replace("3. ", "- ")],
        "Apache-2.0": [text("Apache-2.0"), text("Apache-2.0").split("APPENDIX")[0]],
        "Unlicense": [text("Unlicense")], None: [bsd + " and more"],
    }
    rows |= {x: [text(x)] for x in ("BSD-2-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0")}
    flat = [(name, x) for name, texts in rows.items() for x in texts]
    found = scan_licenses(frame(list(enumerate(x for _, x in flat))), known_digests(spark)).collect()
    assert {r.doc_id: r.licenses.whole_text for r in found} == dict(enumerate(name for name, _ in flat))

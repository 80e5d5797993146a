import math
import re
import textwrap
from collections import Counter
from pathlib import Path

from lattiq.llm import licenses as lic


def brute_own(text):
    idf, weights, other = lic.template_weights()
    idf = dict(idf)
    best = None
    for s in re.split(r"[\n\r]+|(?<=[.!?;])[ \t]+", text or ""):
        c = Counter(re.findall(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*", s.lower()))
        if not c or not re.search(lic._ANCHOR, s):
            continue
        v = {t: n * idf.get(t, other) for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        dots, names = Counter(), {}
        for k, name, t, w in weights:
            dots[k] += v.get(t, 0) * w
            names[k] = name
        for k, d in dots.items():
            if d / norm >= lic.THRESHOLD:
                got = (-round(min(1.0, d / norm), 9), names[k])
                best = min(best or got, got)
    return best


def test_documents_against_brute_force(spark):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    own = {i: brute_own(r.text) for i, r in docs.items()}
    heads = {}
    for i, r in docs.items():
        if own[i] and re.search(lic._ANCHOR, r.text.split("\n")[0][:260]):
            key = (r.source, r.lang, i // 100)
            heads[key] = min(heads.get(key, own[i]), own[i])
    got = lic.op8_licenses(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs) and sum(b is not None for b in own.values()) > 20
    for r in got:
        d = docs[r.doc_id]
        want = own[r.doc_id] or heads.get((d.source, d.lang, r.doc_id // 100))
        assert (r.licence, r.via) == ((want[1], "own" if own[r.doc_id] else "inherited") if want else (None, None))


def test_nearest_ancestor_wins(spark):
    rows = [
        ("LICENSE", "Released under the MIT License."), ("a/COPYING", "x\nLicensed under the Apache License, Version 2.0.\n"), ("a/b/c/f.py", "code"), ("z/f.py", "code"),
        ("a/b/g.py", "All rights reserved. More text"), ("a/b/LICENSE.txt", "nothing known"), ("top.py", None), (None, ""), ("z/f.py", "code"),
    ]
    files = spark.createDataFrame(rows, "path string, text string")
    got = {(r.path, r.licence, r.via, r.from_dir) for r in lic.scan_licences(files).collect()}
    assert {("a/b/c/f.py", "Apache-2.0", "inherited", "a"), ("z/f.py", "MIT", "inherited", ""), ("a/b/g.py", "proprietary", "own", None), ("top.py", "MIT", "inherited", ""), ("a/b/LICENSE.txt", "Apache-2.0", "inherited", "a")} <= got
    assert lic.scan_licences(files).count() == len(rows) and lic.scan_licences(files.limit(0)).count() == 0


def wrapped(text, width, mark):
    return "\n\n".join("\n".join(mark + line for line in textwrap.wrap(p, width)) for p in text.split("\n\n"))


GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""


def test_standard_files_and_headers(spark):
    texts = {p.stem: p.read_text() for p in (Path(lic.__file__).parent / "licence_texts").glob("*.txt")}
    assert {"MIT", "Apache-2.0", "GPL-3.0", "GPL-2.0", "BSD-3-Clause", "BSD-2-Clause", "MPL-2.0", "LGPL-2.1", "LGPL-3.0", "CC0-1.0"} <= texts.keys()
    rows = [(f"whole/{k}", t.replace("<year>", "2021").replace("<holder>", "Jane Roe and others")) for k, t in texts.items()]
    rows += [(f"wrapped/{k}", "Copyright 2019, 2020 Some Company, Inc.\n\n" + wrapped(texts[k], 55, " * ")) for k in ("MIT", "BSD-2-Clause", "BSD-3-Clause")]
    rows += [("head/GPL-3.0", "\n".join(texts["GPL-3.0"].split("\n")[:12])), ("head/Apache-2.0", "\n".join(texts["Apache-2.0"].split("\n")[:6]))]
    code = "\n\nimport os\n\n\ndef main():\n    return os.getcwd()\n" * 5
    rows += [("header/GPL-3.0", GPL3 + code), ("header/GPL-2.0", wrapped(GPL3.replace("version 3", "version 2"), 70, "# ") + code), ("header/LGPL-3.0", GPL3.replace("program", "library").replace("GNU General", "GNU Lesser General") + code)]
    rows += [("header/MIT", wrapped(texts["MIT"], 60, "// ") + code), ("header/BSD-3-Clause", wrapped(texts["BSD-3-Clause"], 60, "# ").replace("\n\n", "\n#\n") + code)]
    rows += [("other/proprietary", "Copyright 2020 Acme.\nAll rights reserved."), ("other/none", "The rights of the people and copyright in general are a long story.\n\n" + "And so on. " * 60)]
    got = {r.path: r.licence for r in lic.own_licences(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {p: p.split("/")[1] for p, _ in rows if p != "other/none"}


def test_odd_documents(spark, tmp_path):
    """Null ids, sources and texts, repeated rows, a very long text and clashing columns; a row without an id takes no one's licence."""
    mit = "Released under the MIT License.\nmore"
    rows = [(None, mit, None, None, "a"), (None, "plain", None, None, "a"), (1, mit, "en", "web", "b"), (2, "plain", "en", "web", "c"), (2, "plain", "en", "web", "c"), (3, None, "en", "web", "d"), (250, "plain " * 100_000, "en", "web", "e"), (None, None, "en", "web", "f")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, licence string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(((r.doc_id or 0), r.licence or "", r.via or "") for r in lic.op8_licenses(spark, str(tmp_path)).collect())
    assert got == sorted([(0, "MIT", "own"), (0, "", ""), (1, "MIT", "own"), (2, "MIT", "inherited"), (2, "MIT", "inherited"), (3, "MIT", "inherited"), (250, "", ""), (0, "", "")])

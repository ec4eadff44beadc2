"""op5: whole licence texts are known, whoever holds the copyright and however lines are wrapped."""

import textwrap

import pytest

from papertrace.llm import licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
CLAIMS = ["Copyright (c) 2026", "Copyright (c) Microsoft Corporation", "Copyright © Microsoft Corporation", "Copyright Jane Doe, 2010-2012", "Copyright (c) <year> <holder>", ""]


def test_whole_texts(spark):
    wrap = lambda w: "\n".join(textwrap.fill(x, w) for x in MIT.split("\n"))
    made = [f"{h}{c}\n\n{wrap(w)}" for c in CLAIMS for h in ("MIT License\n\n", "") for w in (60, 78, 9999)]
    changed = [MIT.replace("free of charge", "for a fee"), MIT + "\nand more"]
    rows = list(enumerate(made + changed))
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(made))] == ["MIT"] * len(made)
    assert [got[i] for i in range(len(made), len(rows))] == [None, None]


@pytest.mark.parametrize("line", ["copyright notice and this permission notice", "copyright license to reproduce", "copyright holders and contributors", "c you must retain in the source form"])
def test_lines_that_grant_stay(line):
    assert licenses.canonical_of(line) == line


@pytest.mark.parametrize("file,spdx", [("Apache-2.0", "Apache-2.0"), ("GPL-3", "GPL-3.0-only"), ("MPL-2.0", "MPL-2.0")])
def test_common_texts(file, spdx):
    try:
        text = open(f"/usr/share/common-licenses/{file}", encoding="utf-8").read()
    except FileNotFoundError:
        pytest.skip("no such text here")
    assert licenses.digests()[licenses.digest_of(text)] == spdx

"""Readers and writers of files, and the streaming table, on small folders; names with spaces and signs among them."""

import json

import pytest

from papertrace.operators import runs
from papertrace.sources import readers, sinks
from papertrace.streaming import records


def test_runs_and_texts(spark, tmp_path):
    out = tmp_path / "out"
    for parser in ("a", "b c+d%"):
        (out / parser).mkdir(parents=True)
        recs = [{"doc_id": "d1", "dpi": 150, "seconds": 1.5, "chars": 3, "error": None, "text_file": "d 1+%_150.txt"}, {"doc_id": "d2", "dpi": 150, "seconds": 2.0, "chars": None, "error": "Boom: x\ny", "text_file": None}]
        (out / parser / "manifest.json").write_text(json.dumps({"parser": parser, "version": "1.2", "source": "png", "records": recs}))
        (out / parser / "d 1+%_150.txt").write_text("abc\n1")
        (out / parser / "stale.txt").write_text("old")
    (out / "empty").mkdir()
    (out / "a" / "usage.json").write_text(json.dumps([{"doc_id": "d1", "dpi": 150, "model": "m", "input_tokens": 5, "output_tokens": 7, "stop": None}]))
    m = readers.manifests(spark, str(out))
    assert sorted((r.parser, r.doc_id, r.version) for r in m.collect()) == [("a", "d1", "1.2"), ("a", "d2", "1.2"), ("b c+d%", "d1", "1.2"), ("b c+d%", "d2", "1.2")]
    joined = m.join(readers.texts(spark, str(out)), ["parser", "text_file"]).collect()
    assert sorted((r.parser, r.text) for r in joined) == [("a", "abc\n1"), ("b c+d%", "abc\n1")]
    assert [(r.parser, r.n_failed, r.first_error) for r in runs.failed(m).orderBy("parser").collect()] == [("a", 1, "Boom: x"), ("b c+d%", 1, "Boom: x")]
    assert readers.manifests(spark, str(out), "a").count() == 2
    u = readers.usage(spark, str(out / "*" / "usage.json")).first()
    assert (u.run, u.input_tokens, u.output_tokens) == ("out/a", 5, 7)
    assert readers.usage(spark, str(tmp_path / "none*" / "usage.json")).count() == 0 and readers.identities(spark, str(tmp_path / "no.json")).count() == 0


def test_corpus_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p 1.truth.json").write_text(json.dumps({"doc_id": "other", "printed": {"a": "1"}, "rows": [{"anchor": "x", "cells": {"y": "2"}}]}))
    (tmp_path / "in" / "page.png").write_bytes(b"\x89PNG")
    (tmp_path / "in" / "s.pdf").write_bytes(b"%PDF")
    t = readers.truth(spark, str(tmp_path / "in")).first()
    assert t.doc_id == "p 1" and t.printed == {"a": "1"} and t.rows[0].cells == {"y": "2"} and t.reconciliation is None
    got = {r.kind: r.data_url for r in readers.images(spark, str(tmp_path / "in")).collect()}
    assert got["image"] == "data:image/png;base64,iVBORw==" and got["pdf"].startswith("data:application/pdf;base64,")
    (tmp_path / "sources.json").write_text(json.dumps([{"doc_id": "a", "file": "page.png", "page": 1}, {"doc_id": "b", "file": "gone.pdf", "page": 2}]))
    have, miss = readers.present(spark, readers.page_sources(spark, str(tmp_path / "sources.json")), str(tmp_path / "in"))
    assert [r.doc_id for r in have.collect()] == ["a"] and [r.doc_id for r in miss.collect()] == ["b"]
    with pytest.raises(FileNotFoundError):
        readers.page_sources(spark, str(tmp_path / "none.json"))
    docs = spark.createDataFrame([("b", "n", "s", 101, "ocr", True), ("a", None, "s", 0, "none", False)], "doc_id string, note string, source string, text_layer_chars int, text_layer_source string, scanned boolean")
    sinks.write_index(docs, (150, 300), str(tmp_path / "index"))
    index = readers.corpus_index(spark, str(tmp_path / "index"))
    assert [(r.doc_id, r.dpi, r.png, r.pdf) for r in runs.jobs(index).collect()] == [(d, x, f"{d}_{x}.png", f"{d}.pdf") for d in "ab" for x in (150, 300)]
    assert [(r.doc_id, r.dpi) for r in runs.jobs(index, dpis=(300,), skip=("a",)).collect()] == [("b", 300)] and runs.jobs(index, limit=1).count() == 1
    with pytest.raises(Exception, match="no rendering at 600 dpi, only at 150, 300"):
        runs.jobs(index, dpis=(600,)).collect()
    used = spark.createDataFrame([("a", 300, "m", 1, 2, None)], "doc_id string, dpi long, model string, input_tokens int, output_tokens int, stop string")
    for _ in range(2):  # replaced, not merged
        sinks.write_usage(used, str(tmp_path / "run" / "x" / "usage.json"))
    assert spark.read.schema(readers.USAGE).json(str(tmp_path / "run" / "x" / "usage.json")).count() == 1


def test_page_class_at_the_limit(spark):
    big, small = [{"width": 1001, "height": 1001}], [{"width": 1000, "height": 2000}]
    df = spark.createDataFrame([(n, i) for n in (None, 99, 100, 101) for i in (big, small, None)], "text_layer_chars int, images array<struct<width:int,height:int>>")
    got = [(r.text_layer_chars, r.page_backed, r.layer) for r in runs.page_class(df).collect()]
    assert got == [(n, i is big, "none" if (n or 0) <= 100 else "ocr" if i is big else "typeset") for n in (None, 99, 100, 101) for i in (big, small, None)]


def test_streamed_upserts(spark, tmp_path):
    kind, path = "k string, n long, v string", str(tmp_path / "table")
    assert records.current(spark, path) is None
    merge = records.apply_batch(path, ["k"], "n", buckets=4)
    merge(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), (None, 1, "n")], kind), 0)
    merge(spark.createDataFrame([("a", 3, "w")], kind), 1)
    merge(spark.createDataFrame([("a", 3, "w")], kind), 1)  # repeated after a failure
    merge(spark.createDataFrame([], kind), 2)
    merge(spark.createDataFrame([("c", 9, "c"), (None, 2, "m")], kind), 3)
    assert sorted((r.k or "", r.n, r.v) for r in records.current(spark, path).collect()) == [("", 2, "m"), ("a", 3, "w"), ("b", 1, "z"), ("c", 9, "c")]

"""Files, archives and source trees."""

import zipfile

import pytest

from lockweave.sources import archives, source_tree


def test_archives(spark, tmp_path):
    jars = tmp_path / "soong" / "system_server_dexjars"
    jars.mkdir(parents=True)
    for name in ("services", "other"):
        with zipfile.ZipFile(jars / f"{name}.jar", "w") as z:
            z.writestr("classes2.dex", f"{name}2")
            z.writestr("classes.dex", name)
            z.writestr("x.txt", "no")
    got = archives.images(archives.files(spark, f"file://{tmp_path}", "serv")).collect()
    assert [(r["member"], bytes(r["content"])) for r in got] == [("classes.dex", b"services"), ("classes2.dex", b"services2")]
    (tmp_path / "flat").mkdir()
    (tmp_path / "flat" / "a.dex").write_bytes(b"dex")
    (tmp_path / "flat" / "b.txt").write_bytes(b"no")
    assert [(r["member"], bytes(r["content"])) for r in archives.images(archives.files(spark, f"file://{tmp_path}/flat", "ignored")).collect()] == [("a.dex", b"dex")]
    with pytest.raises(FileNotFoundError):
        archives.files(spark, f"file://{tmp_path}/none")


def test_external_disassembler(spark, tmp_path):
    script = tmp_path / "tool"
    script.write_text('#!/bin/sh\necho "flag $1"; cat "$2"\n')
    script.chmod(0o755)
    found = spark.createDataFrame([("p", "m", bytearray(b"body"))], "path string, member string, content binary")
    assert [tuple(r) for r in archives.disassembled(found, str(script)).collect()] == [("p!m", "flag -d\nbody")]


def test_source_tree(spark, tmp_path):
    for path, text in {"src/a/b/C.java": "one\nsynchronized (mLock) {\n  handler.post(r);\n}", "src/z/C.java": "other", "out/a/b/C.java": "built", "src/a/b/note.txt": "no"}.items():
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    lines = source_tree.index(spark, f"file://{tmp_path}").cache()
    assert {r["path"].split("/", 1)[1].removeprefix(str(tmp_path)[1:]).lstrip("/") for r in lines.collect()} and lines.select("path").distinct().count() == 2
    classes = spark.createDataFrame([("a.b.C$In",), ("q.C",), ("a.b.None",)], "class string")
    got = {r["class"]: r["path"] for r in source_tree.file_for(classes, lines).collect()}
    assert set(got) == {"a.b.C$In", "q.C"} and got["a.b.C$In"].endswith("src/a/b/C.java")
    assert [r["line_no"] for r in source_tree.acquire_sites(lines, "mLock").collect()] == [2]
    samples = spark.createDataFrame([("a.b.C", 2), ("a.b.C", None), ("x.Y", 1)], "class string, line int")
    rows = {(r["class"], r["line"]): r for r in source_tree.evidence(samples, lines, 1, 1).collect()}
    assert rows["a.b.C", 2]["snippet"].startswith("one\nsync") and rows["a.b.C", 2]["late"] and rows["x.Y", 1]["snippet"] is None and len(rows) == 3

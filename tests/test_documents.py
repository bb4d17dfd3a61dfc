"""Cleaning, chunking, page structures, sources, stores, indexing, streams."""

import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomdex.config import Settings
from loomdex.functions import cleaning
from loomdex.operators import chunking, evaluation, store, structure
from loomdex.operators.graph import connected_components
from loomdex.plans.index import Index, run
from loomdex.sources import files
from loomdex.streaming import ingest


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


def test_cleaning(spark):
    assert one(spark, "a\x07 b\u00a0\u00a0c\ufffd\nexam-\nple\n\n\n\nend ", cleaning.scrub) == "a b c\nexample\n\nend"
    assert one(spark, "Page 3 of 20\nreal\n- 12 -\nIntro......4\nCONFIDENTIAL note", cleaning.clean_text) == "real"
    assert one(spark, "A 1\n\nA 2\n\nB\n\nA 3", cleaning.dedup_paragraphs) == "A 1\n\nB\n\nA 3"
    assert one(spark, "", cleaning.language_by_script) == "en" and one(spark, "升级升级 a", cleaning.language_by_script) == "zh"
    rows = [("d", p, t) for p in range(1, 5) for t in (f"Guide page {p}", "body %d" % (p if p < 3 else 0))]
    got = cleaning.learned_noise(spark.createDataFrame(rows, "doc string, page int, line string")).collect()
    assert {(r["key"], r["n_pages"]) for r in got} == {("guide page #", 4), ("body #", 4)}


def test_windows():
    assert chunking.windows([3, 3, 3, 3, 3], 7, 0) == [(0, 2), (1, 3), (2, 4), (3, 5)]
    assert chunking.windows([], 5, 1) == [] and chunking.windows([9], 5, 1) == [(0, 1)]
    rng = random.Random(3)
    for _ in range(300):
        t = [rng.randrange(1, 9) for _ in range(rng.randrange(1, 25))]
        size, overlap = rng.randrange(4, 30), rng.randrange(0, 8)
        w = chunking.windows(t, size, overlap)
        assert w[0][0] == 0 and w[-1][1] == len(t) and all(b > a for a, b in w)
        assert all(y[0] <= x[1] and y[0] > x[0] and y[1] > x[1] - 1 for x, y in zip(w, w[1:]))
        assert all(sum(t[a:b]) <= size or b - a == 1 for a, b in w)


def test_splitters():
    assert chunking.sentences("See Fig. 3 now. Then go. No. 4 is e.g. Fine. End") == ["See Fig. 3 now.", "Then go.", "No. 4 is e.g. Fine.", "End"]
    table = "| a | b |\n| --- | --- |\n" + "\n".join(f"| {i} | {'x' * 40} |" for i in range(20))
    parts = chunking.split_table(table, 60)
    assert len(parts) > 1 and all(p.startswith("| a | b |\n| --- | --- |\n") and chunking.tokens(p) <= 60 for p in parts)
    code = "\n".join(f"line_{i} {'y' * 30}" for i in range(30))
    parts = chunking.split_code(code, 60)
    assert all(p.startswith("# 续：line_0") for p in parts[1:])
    assert chunking.parent_groups([5, 5, 5, 20, 1], 12) == [0, 0, 1, 2, 3]


def test_parent_groups_in_the_jvm(spark):
    rng = random.Random(5)
    rows = [([rng.randrange(1, 30) for _ in range(rng.randrange(0, 20))],) for _ in range(30)]
    for r in spark.createDataFrame(rows, "n array<int>").select("n", chunking.parent_groups_column(F.col("n"), 50).alias("g")).collect():
        assert r["g"] == chunking.parent_groups(r["n"], 50)


def test_split_documents(spark):
    rows = [("/c/a.pdf", 0, 1, None, "T", "T", "heading", 1), ("/c/a.pdf", 1, 1, 2, "T", ("Words of a sentence here. " * 60).strip(), "text", 1), ("/c/a.pdf", 2, 2, None, "T", "x = 1\n" * 20, "code", 1), ("/c/a.pdf", 2, 2, None, "T", "x = 1\n" * 20, "code", 1), ("/c/a.pdf", 3, 3, None, None, None, "text", 0), ("/c/a.pdf", 4, 3, None, "T", "WARNING: hot. " * 10, "text", 1)]
    segments = spark.createDataFrame(rows, files.SEGMENT)
    got = chunking.split_documents(segments).orderBy("chunk_index").toPandas()
    assert got["chunk_id"].is_unique and (got["token_estimate"] <= 520).all() and set(got["chunk_type"]) == {"text", "code"}
    assert got["has_warning"].any() and got[got["chunk_type"] == "code"]["has_code"].all()
    long = chunking.split_documents(segments, spark.createDataFrame([("/c/a.pdf", 300)], "doc string, pages int")).toPandas()
    parents = long[long["is_parent"]]
    assert len(parents) == 1 and set(long[~long["is_parent"]]["parent_chunk_id"]) == set(parents["chunk_id"])
    assert chunking.split_documents(segments.limit(0)).count() == 0


def block(x0, y0, x1, y1, text):
    return (float(x0), float(y0), float(x1), float(y1), text, 10.0, False, False)


def test_page_structures(spark):
    order = [block(0, 0, 40, 10, "l1"), block(0, 12, 40, 20, "l2"), block(50, 0, 90, 10, "r1"), block(50, 12, 90, 20, "r2"), block(0, 22, 40, 30, "l3"), block(50, 22, 90, 30, "r3")]
    df = spark.createDataFrame([(order, [(0.0, 0.0, 45.0, 11.0)])], f"b array<{structure.BLOCK}>, t array<struct<x0:double,y0:double,x1:double,y1:double>>")
    texts = [b["text"] for b in df.select(structure.reading_order(F.col("b")).alias("o")).first()["o"]]
    assert sorted(texts) == sorted(b[4] for b in order)
    assert "l1" not in [b["text"] for b in df.select(structure.outside_tables(F.col("b"), F.col("t")).alias("o")).first()["o"]]
    few = spark.createDataFrame([(order[:3],)], f"b array<{structure.BLOCK}>").select(structure.reading_order(F.col("b")).alias("o")).first()["o"]
    assert [b["text"] for b in few] == ["l1", "r1", "l2"]
    t = spark.createDataFrame([([["a", None], ["1", "2\n3", "x"], ["4"]],)], "r array<array<string>>").select(structure.markdown_table(F.col("r")).alias("m")).first()["m"]
    assert t == "| a |  |\n| --- | --- |\n| 1 | 2 3 |\n| 4 |  |"
    words = [(10.0, 0.0, "world", 0.9), (0.0, 2.0, "hello", None), (0.0, 30.0, "next", 0.8), (5.0, 30.0, "junk", 0.1)]
    got = spark.createDataFrame([(words,)], "w array<struct<x:double,y:double,text:string,conf:double>>").select(structure.ocr_lines(F.col("w")).alias("l")).first()["l"]
    assert got == ["hello world", "next"]
    toc = lambda *ls: spark.createDataFrame([(list(ls),)], "l array<string>").select(structure.is_toc(F.col("l")).alias("x")).first()["x"]
    assert toc("Contents", "a") and toc("1.1", "Intro.....4", "text") and not toc("1", "2", "text")
    assert one(spark, "E = mc^2", structure.is_formula) and one(spark, "∑∏∫ ab", structure.is_formula) and not one(spark, "plain words here", structure.is_formula)
    scan = spark.createDataFrame([("short", True), ("x" * 100, True), ("", False), (None, True)], "t string, i boolean").select(structure.is_scan(F.col("t"), F.col("i")).alias("s"))
    assert [r["s"] for r in scan.collect()] == [True, False, False, True]


def test_tables_over_pages(spark):
    head = ["Name", "Value"]
    rows = [("d", 1, 0, 2, [["x"], ["y"]]), ("d", 1, 1, 2, [head, ["a", "1"]]), ("d", 2, 0, 1, [head, ["b", "2"]]), ("d", 3, 0, 2, [head, ["c", "3"]]), ("d", 3, 1, 2, [head, ["z", "9"]])]
    got = structure.merge_tables(spark.createDataFrame(rows, "doc string, page int, pos int, n_on_page int, rows array<array<string>>")).orderBy("page_start", "page_end").collect()
    assert [(r["page_start"], r["page_end"], len(r["rows"])) for r in got] == [(1, 1, 2), (1, 3, 4), (3, 3, 2)]


def test_headings(spark):
    blocks = spark.createDataFrame([("d", i, s) for i, s in enumerate([14.0, 10.0, 10.0, 18.02, 10.0, 13.96, None])], "doc string, seq int, size double")
    r = structure.heading_sizes(blocks).first()
    assert r["body"] == 10.0 and r["sizes"] == [18.0, 14.0]
    level = lambda s: spark.createDataFrame([(s, [18.0, 14.0])], "s double, z array<double>").select(structure.heading_level(F.col("s"), F.col("z")).alias("l")).first()["l"]
    assert [level(18.02), level(14.0), level(13.96), level(10.0)] == [1, 2, 0, 0]  # the size is compared unrounded
    segs = spark.createDataFrame([("d", 1, "heading", 1, "A"), ("d", 2, "heading", 2, "B"), ("d", 3, "text", 0, "x"), ("d", 4, "heading", 1, "C"), ("d", 5, "text", 0, "y")], "doc string, seg_no int, kind string, level int, text string")
    assert [r["path"] for r in structure.section_paths(segs).orderBy("seg_no").collect()] == ["A", "A > B", "A > B", "C", "C"]


def test_parsers():
    md = files.markdown_segments(b"intro\n# One\ntext\n```\n# not a heading\n```\n## Two\nmore\n# Three\n```\nopen")
    assert [(s[2], s[3], s[4]) for s in md] == [("", "intro", "text"), ("One", "One", "heading"), ("One", "text", "text"), ("One", "# not a heading", "code"), ("One > Two", "Two", "heading"), ("One > Two", "more", "text"), ("Three", "Three", "heading"), ("Three", "open", "code")]
    html = files.html_segments(b"<html><body><nav>menu</nav><p>out</p><article><h1>T</h1><script>x()</script><p>Body</p></article></body></html>")
    assert html[0][3] == "T\nBody"
    assert files.text_segments("  héllo ".encode("cp1252"))[0][3] == "héllo" and files.text_segments(b"  ") == []
    assert files.decode("中文".encode("gb18030")) == "中文"


def test_index_is_incremental(spark, tmp_path):
    docs = tmp_path / "docs"
    (docs / ".git").mkdir(parents=True)
    (docs / "a.md").write_text("# A\n" + "Words about snapshots and pools of the array. " * 20)
    (docs / "b.txt").write_text("Words about batteries and fans of the enclosure. " * 20)
    (docs / "c.pdf").write_bytes(b"%PDF")
    (docs / ".git" / "x.md").write_text("hidden " * 100)
    (docs / "d.exe").write_text("no")
    ix = Index(spark, f"file://{tmp_path}/index")
    assert run(ix, [str(docs)]) == {"new": 2, "updated": 0, "failed": 1, "removed": 0, "skipped": 0, "too_large": 0}
    first = ix.chunks.read().count()
    assert first >= 2 and ix.vectors.read().count() == ix.chunks.read().where("not is_parent").count()
    assert run(ix, [str(docs)]) == {"new": 0, "updated": 0, "failed": 1, "removed": 0, "skipped": 2, "too_large": 0}
    (docs / "b.txt").unlink()
    (docs / "a.md").write_text("# A\n" + "Entirely other words on quotas and trees. " * 30)
    assert run(ix, [str(docs)]) == {"new": 0, "updated": 1, "failed": 1, "removed": 1, "skipped": 0, "too_large": 0}
    left = ix.chunks.read()
    assert left.where("content like '%batteries%' or content like '%snapshots%'").count() == 0 and left.count() > 0
    assert {r["status"] for r in ix.manifest.read().collect()} == {"done", "error"}


def test_index_takes_more_files_than_the_report(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    for i in range(2):
        (docs / f"old{i}.txt").write_text(f"Words {i} about batteries and fans of the enclosure. " * 20)
        os.utime(docs / f"old{i}.txt", (1_000 + i, 1_000 + i))
    ix, two = Index(spark, f"file://{tmp_path}/index"), Settings(newest_per_root=2)
    assert run(ix, [str(docs)], two)["new"] == 2
    for i in range(3):
        (docs / f"new{i}.txt").write_text(f"Words {i} about quotas and trees of the pool. " * 20)
    assert run(ix, [str(docs)], two) == {"new": 3, "updated": 0, "failed": 0, "removed": 0, "skipped": 2, "too_large": 0}
    assert ix.chunks.read().select("file_path").distinct().count() == 5
    (docs / "old0.txt").unlink()
    assert run(ix, [str(docs)], two) == {"new": 0, "updated": 0, "failed": 0, "removed": 1, "skipped": 4, "too_large": 0}
    for i in range(501):
        (docs / f"more{i}.txt").write_text("x")
    assert files.scan(spark, [str(docs)]).count() == 505


def test_store(spark, tmp_path):
    t = store.Table(spark, f"file://{tmp_path}/t", "k string, v int")
    assert t.read().count() == 0
    t.upsert(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), "k")
    t.upsert(spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int"), "k")
    assert {(r["k"], r["v"]) for r in t.read().collect()} == {("a", 1), ("b", 3), ("c", 4)}
    t.delete(spark.createDataFrame([("a",)], "k string"), "k")
    assert {r["k"] for r in t.read().collect()} == {"b", "c"}
    t.truncate()
    assert t.read().count() == 0
    old = spark.createDataFrame([("x", -1, "h")], "chunk_id string, page_number int, heading_path string")
    new = store.migrated(old).first()
    assert new["page_start"] is None and new["section_path"] == "h" and new["is_parent"] is None


def test_components_against_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 130)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {n: find(n) for n in root}
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_hit_rates(spark):
    cases = spark.createDataFrame([("1", "x", "easy", ["a.pdf"]), ("2", "x", None, ["z"]), ("3", "y", "easy", None)], "id string, category string, difficulty string, ground_truth_file array<string>")
    hits = spark.createDataFrame([("1", 1, "b.pdf"), ("1", 2, "a.pdf"), ("3", 1, "c")], "query_id string, rank int, file_name string")
    flags = evaluation.hit_flags(cases, hits)
    assert {r["id"]: (r["hit1"], r["hit3"], r["n_retrieved"]) for r in flags.collect()} == {"1": (0, 1, 2), "2": (0, 0, 0), "3": (0, 0, 1)}
    rates = {(r["level"], r["category"], r["difficulty"]): (r["n"], r["hit3"]) for r in evaluation.hit_rates(flags).collect()}
    assert rates[("overall", None, None)] == (3, 33.3) and rates[("category", "x", None)] == (2, 50.0) and rates[("difficulty", None, None)] == (1, 0.0)


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    pd.DataFrame({"k": ["a", "a", "b"], "v": [1, 2, 3]}).astype({"v": "int32"}).to_parquet(folder / "1.parquet")
    t = store.Table(spark, f"file://{tmp_path}/t", "k string, v int")
    for _ in range(2):
        ingest.upserts(spark, str(folder), "k string, v int", t, "k", f"{tmp_path}/ckpt", "v").awaitTermination()
    assert {(r["k"], r["v"]) for r in t.read().collect()} == {("a", 2), ("b", 3)}


def test_records(spark, tmp_path):
    from loomdex.sources import records

    path = f"{tmp_path}/cache.jsonl"
    records.write_cache(spark.createDataFrame([("q", "old", 1), ("q", "new", 2), ("r", "x", 1)], records.CACHE), path)
    (tmp_path / "cache.jsonl" / "bad.json").write_text("{broken\n")
    assert {tuple(r) for r in records.read_cache(spark, path).collect()} == {("q", "new", 2), ("r", "x", 1)}
    (tmp_path / "cases.json").write_text('{"cases": [{"id": "1", "question": "?", "ground_truth_doc": ["a"]}]}')
    assert records.read_cases(spark, f"{tmp_path}/cases.json").first()["ground_truth_file"] == ["a"]
    for _ in range(2):
        records.append_errors(spark.createDataFrame([("f", "e")], "file_path string, error_msg string"), f"{tmp_path}/errors")
    assert spark.read.json(f"{tmp_path}/errors").count() == 2


def test_harness(spark):
    from loomdex.plans.evaluate import evaluate, switches
    from tests_shared import LOW, corpus

    cases = spark.createDataFrame([("1", "battery module", "x", "easy", ["f1.pdf"]), ("2", "zebrafish", "neg", None, None)], "id string, question string, category string, difficulty string, ground_truth_file array<string>")
    runs = {k: v for k, v in switches(LOW).items() if k in ("optimized", "off_mmr")}
    got = {r["tag"]: (r["n"], r["hit1"]) for r in evaluate(cases, corpus(spark), runs).where("level = 'overall'").collect()}
    assert got == {"optimized": (2, 50.0), "off_mmr": (2, 50.0), "baseline": (2, 50.0)}


def test_clean_blocks(spark):
    blocks = [block(0, 0, 9, 8, "Guide page 7\nmore"), block(0, 40, 9, 60, "body text\nPage 3 of 9"), block(0, 95, 9, 99, "unlearned foot"), block(0, 50, 9, 60, "draft")]
    df = spark.createDataFrame([(blocks, ["guide page #"], 100.0)], f"b array<{structure.BLOCK}>, n array<string>, h double")
    assert df.select(cleaning.clean_blocks(F.col("b"), F.col("n"), F.col("h")).alias("t")).first()["t"] == ["body text", "unlearned foot"]


def test_command_line(spark, tmp_path, capsys):
    from loomdex.cli import main

    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("# Battery\n" + "The battery module of the enclosure is replaced while the node runs. " * 15)
    at = ["--index", f"file://{tmp_path}/ix"]
    assert main([]) == 1
    assert main([*at, "index", f"{tmp_path}/docs"]) == 0 and main([*at, "status"]) == 0
    assert "'done': 1" in capsys.readouterr().out
    assert main([*at, "ask", "battery module", "--threshold", "0.1"]) == 0
    assert "a.md" in capsys.readouterr().out
    assert main([*at, "quality"]) in (0, 1) and main([*at, "purge", "--yes"]) == 0


def _pdf(pages, compress):
    """A small PDF: pages are lists of (x, y, size, font, text)."""
    import zlib

    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b""]
    kids = []
    for page in pages:
        body = "".join(f"BT /{f} {s} Tf {x} {y} Td ({t}) Tj ET\n" for x, y, s, f, t in page).encode("cp1252")
        data = zlib.compress(body) if compress else body
        objects.append(b"<< /Length %d %s>>\nstream\n%s\nendstream" % (len(data), b"/Filter /FlateDecode " if compress else b"", data))
        objects.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % len(objects))
        kids.append(len(objects))
    fonts = b"/F1 << /Type /Font /BaseFont /Helvetica >> /F2 << /Type /Font /BaseFont /Courier >>"
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] /MediaBox [0 0 600 800] /Resources << /Font << %s >> >> >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids), fonts)
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>\n"


@pytest.mark.parametrize("compress", [False, True])
def test_pdf(compress):
    from loomdex.sources import pdf

    raw = _pdf([[(50, 700, 20, "F1", "Caf\\351 \\(one\\)"), (50, 660, 10, "F1", "First line"), (50, 648, 10, "F1", "second line"), (50, 600, 10, "F2", "svc_run --all")], [(50, 700, 10, "F1", "Contents"), (50, 680, 10, "F1", "A ..... 3")], [(50, 700, 10, "F1", "On page three")]], compress)
    assert pdf.page_count(raw) == 3 and pdf.page_count(b"no") == 0 and pdf.page_count(b"%PDF-1.4 broken") == 0
    assert pdf.pdf_segments(raw) == [
        (1, 1, "Café (one)", "Café (one)", "heading", 1),
        (1, 1, "Café (one)", "First line\nsecond line", "text", 0),
        (1, 1, "Café (one)", "svc_run --all", "code", 0),
        (3, 3, "Café (one)", "On page three", "text", 0),
    ]
    with pytest.raises(ValueError, match="encrypted"):
        pdf.Document(b"%PDF-1.4\n1 0 obj\n<< /Encrypt 5 0 R >>\nendobj")


def test_recognition(spark):
    from loomdex.operators import recognition

    @recognition.engine("fake")
    def fake():
        return lambda image: [(5.0, 1.0, "b", None), (1.0, 2.0, image.decode(), 0.9), (1.0, 30.0, "low", 0.1)]

    images = spark.createDataFrame([("d", 1, b"a"), ("d", 2, b"\xff")], "doc string, page int, image binary")
    got = {r["page"]: r for r in recognition.recognised(images, "fake").collect()}
    assert got[1]["lines"] == ["a b"] and got[1]["error"] is None
    assert got[2]["lines"] == [] and got[2]["error"].startswith("UnicodeDecodeError")
    with pytest.raises(ValueError, match="unknown OCR engine"):
        recognition.recognised(images, "none")


def test_no_text_is_lost():
    from loomdex.operators import chunking

    long = "x" * 5000 + "数" * 700
    for size in (24, 128):
        pieces = chunking.cut_run(long, size)
        assert "".join(pieces) == long and all(chunking.tokens(p) <= size for p in pieces)
        assert "".join(chunking.split_table(long + "\nb", size)) == long + "\nb"
    assert "".join(chunking._cut_words("a " + long, 24)).replace(" ", "").endswith("数" * 20)


def test_parsed_text_is_cleaned(spark):
    rows = [("a.md", "md", b"# T\n\nBody one.\nPage 3 of 9\nAll rights reserved\n"), ("b.txt", "txt", b"12\n"), ("c.html", "html", "<p>x\u00a0y</p><p>draft</p>".encode())]
    df = spark.createDataFrame([(p, e, bytearray(c)) for p, e, c in rows], "file_path string, ext string, content binary")
    got = {(r["doc"], r["kind"]): r["text"] for r in files.parse(df).collect()}
    assert got == {("a.md", "heading"): "T", ("a.md", "text"): "Body one.", ("c.html", "text"): "x y"}


def test_sentences_agree(spark):
    from loomdex.operators import chunking

    texts = ["One. Two e.g. three. A. B. Then 3. Next! Why? 好。 对！ Fig. 4 shows.", "", "no end", "X vs. y. Z etc. 12. 13. Done."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", chunking.sentences_column(F.col("t")).alias("s"))
    assert {r["i"]: r["s"] for r in df.collect()} == {i: chunking.sentences(t) for i, t in enumerate(texts)}

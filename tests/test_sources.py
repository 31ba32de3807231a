"""Readers and writers on files made here."""

import json
import zipfile

from pyspark.sql import functions as F

from termflow.functions import naming
from termflow.sources import appdata, books, dictionaries, sinks, subtitles

SRT = "﻿1\n00:00:01,000 --> 00:00:02,500\n<i>今日は</i>良い天気\n\n2\n00:00:03,000 --> 00:00:04,000\n（いい）\n\n3\n00:00:05,000 --> 00:00:06,000\n散歩に行く\n"


def test_subtitles(spark, tmp_path):
    (tmp_path / "a.srt").write_text(SRT)
    (tmp_path / "b.txt").write_text("今日は良い天気。散歩に行く！\n次の行(つぎのぎょう)です。")
    (tmp_path / "c.ass").write_text("[Events]\nDialogue: 0,0:00:01.50,0:00:02.00,D,,0,0,0,,{\\i1}斜体{\\i0}の,まま\n")
    (tmp_path / "d.pdf").write_text("x")
    rows, skipped = subtitles.read_sentences(spark, str(tmp_path))
    got = [(r["path"][-5:], r["ord"], r["text"], r["start_ms"]) for r in rows.orderBy("path", "ord").collect()]
    assert got == [("a.srt", 0, "今日は良い天気", 1000), ("a.srt", 1, "散歩に行く", 5000), ("b.txt", 0, "今日は良い天気", None), ("b.txt", 1, "散歩に行く", None), ("b.txt", 2, "次の行です", None), ("c.ass", 0, "斜体の,まま", 1500)]
    assert [(r["type"], r["reason"]) for r in skipped.collect()] == [("PDF", "unsupported file type")]
    blocks = [r["block"] for r in sinks.srt_blocks(rows.filter("start_ms IS NOT NULL").filter(F.col("path").endswith("a.srt"))).orderBy("ord").collect()]
    assert blocks[0] == "1\n00:00:01,000 --> 00:00:02,500\n今日は良い天気\n"


def epub(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/content.opf"/></rootfiles></container>')
        items = "".join(f'<item id="{n}" href="{n}.xhtml" media-type="application/xhtml+xml"/>' for n in ("cover", "c1", "c1b", "c2"))
        spine = "".join(f'<itemref idref="{n}"/>' for n in ("cover", "c1", "c1b", "c2"))
        z.writestr("O/content.opf", f'<package><metadata><title>本</title></metadata><manifest>{items}<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine>{spine}</spine></package>')
        z.writestr("O/toc.ncx", '<ncx><navMap><navPoint><navLabel><text>一章</text></navLabel><content src="c1.xhtml"/></navPoint><navPoint><navLabel><text></text></navLabel><content src="c2.xhtml#x"/></navPoint></navMap></ncx>')
        z.writestr("O/cover.xhtml", "<html><body><p>表紙</p></body></html>")
        z.writestr("O/c1.xhtml", "<html><head><title>x</title></head><body><p><ruby>漢字<rt>かんじ</rt></ruby>を読む。</p><p>次の段落&amp;終わり</p></body></html>")
        z.writestr("O/c1b.xhtml", "<html><body><p>続きの続き</p></body></html>")
        z.writestr("O/c2.xhtml", "<html><body>行Aは十文字以上ある<br/>行B</body></html>")


def test_books(spark, tmp_path):
    epub(tmp_path / "b.epub")
    lines = books.chapter_lines(books.read_books(spark, str(tmp_path)))
    got = [(r["chapter"], r["chapter_title"], r["line"]) for r in lines.orderBy("chapter", "ord").collect()]
    assert got == [(1, "一章", "漢字を読む。"), (1, "一章", "次の段落&終わり"), (1, "一章", "続きの続き"), (3, "Chapter 4", "行Aは十文字以上ある"), (3, "Chapter 4", "行B")]
    parts = books.split_chapters(lines, ["path", "chapter"])
    assert [r["part_id"] for r in books.list_parts(parts).orderBy("part_id").collect()] == [0, 1]
    assert books.select_parts(parts, [1, 1, 9]).count() == 2 and books.select_parts(parts, None).count() == 5
    assert subtitles.read_sentences(spark, str(tmp_path))[0].count() == 5


def test_part_sizes(spark):
    lines = spark.createDataFrame([(1, i, "x" * 3000) for i in range(5)], "chapter int, ord int, line string")
    got = books.split_chapters(lines).groupBy("part").agg(F.count("*"), F.sum(F.length("line"))).orderBy("part").collect()
    assert [tuple(r) for r in got] == [(0, 3, 9000), (1, 2, 6000)]


def test_dictionaries(spark, tmp_path):
    bank = [["犬", "freq", {"reading": "イヌ", "frequency": 120}], ["猫", "freq", {"value": 5, "displayValue": "5㋕"}], ["x", "pitch", 1], ["鳥", "freq", "77"], ["魚", "freq", -1], "bad", ["行く", "freq", {"reading": "いく", "frequency": {"value": 30}}]]
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("index.json", json.dumps({"title": "T", "revision": "1", "format": 3}))
        z.writestr("term_meta_bank_1.json", json.dumps(bank))
    with zipfile.ZipFile(tmp_path / "old.zip", "w") as z:
        z.writestr("index.json", json.dumps({"title": "Old", "revision": "1", "version": 1}))
    want = {("犬", "いぬ", 120, False), ("猫", None, 5, True), ("鳥", None, 77, False), ("行く", "いく", 30, False)}
    for _ in range(2):
        df = dictionaries.load_dictionaries(spark, str(tmp_path), str(tmp_path / "cache"))
        assert {(r["term"], r["reading"], r["value"], r["kana_marker"]) for r in df.collect()} == want


def test_exports(spark, tmp_path):
    counts = spark.createDataFrame([("犬", "いぬ", 3), ("の", None, 3), ('a"b', "x", 1)], "lemma string, reading string, n long")
    lines = [r["line"] for r in sinks.frequency_lines(counts).orderBy(F.asc_nulls_first("ord")).collect()]
    assert lines == ["Rank,Term,Reading,Frequency", '1,"の","",3', '1,"犬","いぬ",3', '3,"a"b","x",1']
    sinks.write_dictionary_zip(counts, str(tmp_path / "out.zip"), "T", "p", drop_hapax=True)
    with zipfile.ZipFile(tmp_path / "out.zip") as z:
        assert json.loads(z.read("term_meta_bank_1.json")) == [["の", "freq", 1], ["犬", "freq", {"reading": "いぬ", "frequency": 1}]]
        assert json.loads(z.read("index.json"))["revision"].startswith("p.frequency.")


def test_ignore_list(spark, tmp_path):
    (tmp_path / "t.txt").write_text("猫\n\n 犬 \n")
    (tmp_path / "i.json").write_text(json.dumps({"ignored_terms": ["鳥"], "files": [{"path": str(tmp_path / "t.txt"), "enabled": False}]}))
    df = appdata.ignore_list(spark, str(tmp_path / "i.json"))
    assert {(r["term"], r["enabled"]) for r in df.collect()} == {("鳥", True), ("猫", False), ("犬", False)}
    assert appdata.active_ignored(appdata.add_ignored(df, "魚")).count() == 2
    default = [r["term"] for r in appdata.ignore_list(spark, str(tmp_path / "none.json")).collect()]
    assert default == ["の", "は", "に", "へ", "を", "て", "が", "だ", "た", "と", "から", "も", "で", "か", "です", "ね", "な", "ん", "し", "お"]


def test_recents(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "path string, last_opened long, title string")
    assert [(r["path"], r["title"]) for r in appdata.recents(df).collect()] == [("a", "z"), ("b", "y")]


def test_catalog(spark):
    c = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", "1")], "title string, revision string")
    i = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "title string, revision string")
    assert {r[0]: r[1] for r in appdata.catalog_status(c, i).collect()} == {"a": "installed", "b": "outdated", "c": "unknown", "d": "missing"}


def test_ignore_list_changes(spark, tmp_path):
    (tmp_path / "t.txt").write_text("猫\n犬\n")
    df = spark.createDataFrame([("の", "manual", True), ("x", "old.txt", True)], appdata.IGNORE)
    assert {r["term"] for r in appdata.set_ignored(df, ["は", "は", "が"]).collect()} == {"は", "が", "x"}
    assert {r["term"] for r in appdata.set_ignored(df, []).collect()} == {"x"}
    got = appdata.set_ignore_files(spark, df, [(str(tmp_path / "t.txt"), False)])
    assert {(r["term"], r["enabled"]) for r in got.collect()} == {("の", True), ("猫", False), ("犬", False)}


def test_saved_tables(spark, tmp_path):
    path = str(tmp_path / "out.json")
    assert not sinks.exists(spark, path) and not sinks.delete(spark, path)
    sinks.write_json(spark.range(2), path)
    assert sinks.exists(spark, path) and sinks.delete(spark, path) and not sinks.exists(spark, path)
    cues = spark.createDataFrame([("v", 0, "一", 0, 1500)], "path string, ord int, text string, start_ms long, end_ms long")
    saved = sinks.save_srt(cues, str(tmp_path), 'a/b: "c"?' + "x" * 100)
    assert saved.endswith("/a_b_ _c__" + "x" * 71 + ".srt") and "00:00:00,000 --> 00:00:01,500" in spark.read.text(saved, wholetext=True).first()[0]
    assert sinks.save_srt(cues, str(tmp_path), " ").endswith("/video.srt")


def test_source_file_and_labels(one):
    p = lambda x: F.lit(x)
    r = one(naming.source_file(p("/x/Show S01E02 Netflix.srt"), p("Book"), p(" part 1 ")), naming.source_file(p("/x/b.epub"), p("Book"), p(" part 1 ")), naming.source_file(p("/x/b.epub"), p(""), p(" ")))
    assert tuple(r[0]) == ("SRT", "Show - S01E02", "Netflix", "/x/Show S01E02 Netflix.srt", None)
    assert tuple(r[1]) == ("EPUB", "Book", None, "/x/b.epub", "part 1") and tuple(r[2]) == ("EPUB", "B", None, "/x/b.epub", None)
    n = lambda x: F.lit(x).cast("long")
    assert one(naming.size_label(n(None)), naming.size_label(n(1536)), naming.terms_label(n(None)), naming.terms_label(n(1)), naming.terms_label(n(3)))[:] == ("Unknown", "1.5 KB", "Unknown terms", "1 term", "3 terms")
    assert one(naming.opened_label(F.lit("2024-03-04 05:06:07").cast("timestamp")))[0] == "2024-03-04 05:06"


def test_file_tree(spark):
    df = spark.createDataFrame([("/home/a/x/1.srt",), ("/home/a/x/2.srt",), ("/home/a/y/z/3.srt",), ("/home/a/4.srt",)], "path string")
    got = {(r["depth"], r["parent"], r["name"], r["path"], r["n_files"]) for r in naming.file_tree(df).collect()}
    assert got == {(1, "", "x", None, 2), (1, "", "y", None, 1), (1, "", "4.srt", "/home/a/4.srt", 1), (2, "x", "1.srt", "/home/a/x/1.srt", 1), (2, "x", "2.srt", "/home/a/x/2.srt", 1), (2, "y", "z", None, 1), (3, "y/z", "3.srt", "/home/a/y/z/3.srt", 1)}
    assert [(r["depth"], r["name"]) for r in naming.file_tree(spark.createDataFrame([("/home/a/x/1.srt",)], "path string")).collect()] == [(1, "1.srt")]
    assert naming.file_tree(df.limit(0)).count() == 0

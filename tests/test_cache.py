"""The store of cached pages as a data source, and what requests are answered with."""

import gzip

from pyspark.sql import functions as F

from pagequarry.operators import extract
from pagequarry.sources import cache


def store(folder):
    folder.mkdir()
    content = {"aa1.html": "<p>é</p>".encode(), "ab2.html.gz": gzip.compress(b"<p>packed</p>"), "ab3": b"%PDF-1.4 rest", "bc4.html": b"\x1f\x8b\x08broken", "bc5.html": b"<p>\xff</p>", "cd6.html": b"", "cd7.html": gzip.compress(b"by magic")}
    for name, data in content.items():
        (folder / name).write_bytes(data)
    return folder


def test_pages(spark, tmp_path):
    folder = store(tmp_path / "s")
    (folder / "deep" / "er").mkdir(parents=True)
    (folder / "deep" / "er" / "ef8.html").write_bytes(b"below")
    (folder / "notes.txt").write_text("no page")
    (tmp_path / "none").mkdir()
    want = {"aa1": (False, "<p>é</p>"), "ab2": (False, "<p>packed</p>"), "ab3": (True, None), "bc4": (False, "\x1f�\x08broken"), "bc5": (False, "<p>�</p>"), "cd6": (False, ""), "cd7": (False, "by magic"), "ef8": (False, "below")}
    for path in (str(folder), f"file://{folder}"):
        for files in ("1", "512"):
            assert {r["key"]: (r["is_pdf"], r["html"]) for r in cache.pages(spark, path, files=files, deep="true").collect()} == want
    assert sorted(r["key"] for r in cache.pages(spark, str(folder)).collect()) == sorted(set(want) - {"ef8"})
    assert [r["key"] for r in cache.pages(spark, str(folder), deep="true").where("key in ('ef8', 'zz')").collect()] == ["ef8"]
    assert cache.pages(spark, str(tmp_path / "none")).count() == 0 and cache.pages(spark, str(tmp_path / "absent")).count() == 0
    assert cache.pages(spark, str(folder)).columns == ["key", "is_pdf", "html"]


def test_conditions_on_keys(spark, tmp_path):
    folder = store(tmp_path / "s")
    for i in range(300):
        (folder / f"zz{i}.html").write_text("x")
    unread = folder / "zz_closed.html"
    unread.mkdir()
    df = cache.pages(spark, str(folder))
    keys = lambda d: sorted(r["key"] for r in d.collect())
    assert keys(df.where("key = 'ab2'")) == ["ab2"] and keys(df.where("key in ('aa1', 'ab3', 'nope')")) == ["aa1", "ab3"]
    assert keys(df.where(F.col("key").startswith("ab"))) == ["ab2", "ab3"]
    assert keys(df.where("key in ('aa1', 'ab3') and key like 'ab%' and is_pdf")) == ["ab3"] and keys(df.where("key = 'aa1' and key = 'ab3'")) == []
    assert keys(df.where("key = 'aa1.html'")) == [] and keys(df.where("key = ''")) == [] and keys(df.where("key = '../s/aa1'")) == [] and keys(df.where("key is null")) == []
    assert keys(df.where("key like '%2' or is_pdf").where("key not like 'zz%'")) == ["ab2", "ab3"]


def test_only_asked_files_are_opened(tmp_path, monkeypatch):
    folder = store(tmp_path / "s")
    opened = []
    monkeypatch.setattr(cache, "page_of", lambda store, path: (opened.append(cache.key_of(path)) or (False, "")))
    reader = cache.CacheReader(str(folder), 2, cache.ENDINGS)
    rest = list(reader.pushFilters([cache.In(("key",), ("aa1", "ab3", None)), cache.StringStartsWith(("key",), "a"), cache.EqualTo(("is_pdf",), True)]))
    assert [f.attribute for f in rest] == [("is_pdf",)]
    for part in reader.partitions():
        list(reader.read(part))
    assert sorted(opened) == ["aa1", "ab3"]
    opened.clear()
    reader = cache.CacheReader(str(folder), 2, cache.ENDINGS)
    list(reader.pushFilters([cache.StringStartsWith(("key",), "bc")]))
    assert [len(p.paths) for p in reader.partitions()] == [2]


def test_heads_only_of_pdfs(tmp_path):
    taken = []

    class Stream:
        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        def read(self, n=-1):
            taken.append(n)
            return b"%PDF-" if n == 5 else b"rest"

    class Store:
        def open_input_stream(self, path, compression):
            return Stream()

    assert cache.page_of(Store(), "x") == (True, None) and taken == [5]


def test_answers(spark):
    page = '<html><head><meta name="citation_author" content="Ann Lee"><meta name="citation_pdf_url" content="https://x.org/a.pdf"><title>A page with a title</title></head><body>' + "<p>words and more words</p>" * 60 + "</body></html>"
    plain = page.replace('<meta name="citation_pdf_url" content="https://x.org/a.pdf">', "")
    df = spark.createDataFrame([(1, "https://x.org/1", page), (2, "https://x.org/2", None), (3, "https://x.org/3", plain), (4, None, "%PDF-1.4")], "page_id int, url string, html string")
    got = lambda kind: {r["page_id"]: r for r in extract.answered(df, kind).collect()}
    get, post, link = got("get"), got("post"), got("find_pdf")
    assert {i: (r["status"], r["msg"]) for i, r in get.items()} == {1: (200, None), 2: (404, "No landing page found"), 3: (200, None), 4: (200, None)}
    assert (post[2]["status"], post[2]["msg"], post[2]["authors"], post[2]["error"]) == (400, "No html in request body", [], None)
    assert get[1]["authors"][0]["name"] == "Ann Lee" and get[4]["error"] == "UnusualTraffic" and get[4]["authors"] == []
    assert {i: (r["status"], r["msg"], r["pdf_url"]) for i, r in link.items()} == {1: (200, None, "https://x.org/a.pdf"), 2: (404, "No landing page found", None), 3: (404, "No PDF link found", None), 4: (404, "No PDF link found", None)}

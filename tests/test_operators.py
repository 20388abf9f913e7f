import io
import zipfile

import pytest
from pyspark.sql import functions as F

from corvina import schema
from corvina.operators import answers, catalog, chunking, layout, search
from corvina.sources import archive, epub, markup


def ranked(spark, ids):
    return spark.createDataFrame([(x, i) for i, x in enumerate(ids, 1)], "id string, rank int")


def test_fusion(spark):
    rows = {r["id"]: r for r in search.fuse(ranked(spark, ["a", "b"]), ranked(spark, ["b"])).collect()}
    assert rows["a"]["score"] == pytest.approx(1 / 61) and rows["b"]["score"] == pytest.approx(1 / 62 + 1 / 61)
    order = [r["id"] for r in search.fuse(ranked(spark, ["both", "lex"]), ranked(spark, ["both", "vec"])).orderBy("rank").collect()]
    assert order == ["both", "lex", "vec"]
    assert search.fuse(ranked(spark, []), ranked(spark, [])).count() == 0


def headings(spark, md, **o):
    return chunking.split_headings(spark.createDataFrame([(md,)], "markdown string"), **o).first()["chunks"]


def test_heading_split(spark):
    assert headings(spark, "  ") == []
    assert len(headings(spark, "## One\ntext a\n## Two\ntext b\n## Three\ntext c", min_chars=10)) == 3
    recipes = "\n".join(f"## Recipe {i}\n### Ingredients\nflour and so on\n### Method\nmix it" for i in range(3))
    got = headings(spark, recipes, min_chars=10, excluded=("ingredients", "method"))
    assert len(got) == 3 and all("### Method" in c for c in got)
    deep = "\n".join(f"### Recipe {i}\nintro text\n#### Ingredients\nflour" for i in range(3))
    assert len(headings(spark, deep, min_chars=5, excluded=("ingredients",))) == 3
    got = headings(spark, "## Book\n### Section One\nwords of one\n### Section Two\nwords of two\n### Section Three\nwords of three", min_chars=15)
    assert len(got) == 3 and got[0].startswith("## Book\n\n### Section One")
    assert len(headings(spark, "## A\nx\n## B\n" + "long text " * 5 + "\n## C\n" + "more text " * 5, min_chars=30)) == 2


def test_structural_and_semantic(spark):
    page = "Introduction\nThis is the opening part of the book.\n\nChapter One\nHere it goes on for a while."
    got = chunking.split_heuristic(spark.createDataFrame([(["", page],)], "pages array<string>"), boundary=schema.Boundary(min_chars=5)).first()["chunks"]
    assert len(got) == 2 and got[1].startswith("Chapter One")
    df = spark.createDataFrame([(1, "one para"), (2, "\n\n".join(["cats purr softly"] * 4 + ["stocks fell hard"] * 4)), (3, "")], "k int, markdown string")
    out = {r["k"]: r["chunks"] for r in chunking.split_semantic(df, "k", config=schema.Semantic(window=0, min_chars=5)).collect()}
    assert out[1] == ["one para"] and out[3] == [] and len(out[2]) == 2 and out[2][1].startswith("stocks")


def test_token_split_keeps_all_words():
    text = " ".join(f"Word{i} goes on." for i in range(400))
    assert " ".join(chunking.token_split(text, 100)).split() == text.split()
    assert chunking.token_split("") == [] and chunking.token_split("a b") == []


def test_token_split_goes_on_to_the_end(spark):
    text = " ".join(f"longword{i}" for i in range(10_050))
    got = chunking.token_split(text, 1)
    assert len(got) == 10_050 and got[-1] == "longword10049"
    words = text.split()
    assert chunking.token_split(text, 2, most=3) == [" ".join(words[i : i + 2]) for i in (0, 2, 4)] + [" ".join(words[6:])]
    df = spark.createDataFrame([([text],)], "c array<string>")
    for capped in (chunking.cap_semantic(F.col("c"), 4000, 1), chunking.cap_structural(F.col("c"), 4000, 1)):
        pieces = df.select(capped.alias("c")).first()["c"]
        assert len(pieces) == 10_050 and pieces[-1].endswith("longword10049")


def test_rerank():
    chat = lambda s, u: "[2, 0]"
    assert answers.rerank("q", ["a", "b", "c"], 2, str, chat) == ["c", "a"]
    assert answers.rerank("q", ["a", "b", "c", "d"], 3, str, chat) == ["c", "a", "b"]
    assert answers.rerank("q", ["a", "b", "c", "d"], 3, str, chat, strict_parity=True) == ["c", "a"]
    assert answers.rerank("q", ["a", "b", "c"], 2, str, lambda s, u: "none") == ["a", "b"]


def make_zip(entries):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in entries.items():
            z.writestr(k, v)
    return b.getvalue()


BOOK = {
    "mimetype": archive.EPUB_TYPE,
    "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>',
    "OPS/book.opf": '<package><manifest><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/><itemref idref="x"/></spine></package>',
    "OPS/a.xhtml": "<html><body><h1>A</h1><p>first</p></body></html>",
    "OPS/b.xhtml": "<html><body><h2>B</h2><p>second <b>bold</b></p></body></html>",
}


def test_archives():
    book = make_zip(BOOK)
    assert archive.resolve("epub", b"x", "f.epub")[0] == "EPUB" and archive.resolve("zip", book, "f.zip") == ("EPUB", "epub", book)
    nested = make_zip({"My Book.epub/" + k: v for k, v in BOOK.items()} | {"__MACOSX/x": "junk"})
    assert archive.epub_prefix(nested) == "My Book.epub/"
    kind, suffix, content = archive.resolve("zip", nested, "f.zip")
    assert (kind, suffix) == ("EPUB", "epub") and epub.read_epub(content) == "## B\n\nsecond bold\n\n# A\n\nfirst"
    assert archive.single_wrapped(make_zip({"R.epub": b"e", "__MACOSX/._R.epub": b"j"})) == ("epub", b"e")
    assert archive.single_wrapped(make_zip({"a.pdf": b"1", "b.pdf": b"2"})) is None and archive.epub_prefix(b"no zip") is None
    for suffix in ("txt", "zip", ""):
        with pytest.raises(schema.Unsupported):
            archive.resolve(suffix, b"zz", "f")
    assert epub.read_epub(b"broken") == ""


def test_markup():
    md = markup.html_to_markdown("<html><head><title>t</title></head><body><nav>n</nav><h1>Big <i>one</i></h1><p>one<p>two<ul><li>a<li>b</ul><table><tr><th>h<th>k<tr><td>1<td>2</table><hr><blockquote>q</blockquote>")
    assert md == "# Big one\n\none\n\ntwo\n\n- a\n- b\n\n| h | k |\n| --- | --- |\n| 1 | 2 |\n\n---\n\n> q"
    assert markup.html_to_markdown(None) == "" and "<script>" not in markup.markdown_to_html("a <script> [x](javascript:1)")


def test_catalog(spark):
    tag = spark.createDataFrame([("1", "d", "A", "", "a"), ("2", "d", "B", "", "a.b"), ("3", "e", "X", "", "a.c")], schema.TAG)
    assert [r["id"] for r in catalog.descendants(tag, "1").collect()] == ["2"] and catalog.descendants(tag, "1", strict_parity=True).count() == 2
    with pytest.raises(ValueError):
        catalog.delete_tag(tag, "1")
    more = catalog.insert_tags(tag, spark.createDataFrame([("9", "d", "Z", "", "p.q.z")], schema.TAG))
    assert {r["path"] for r in more.collect()} >= {"p", "p.q", "p.q.z"}
    with pytest.raises(ValueError):
        catalog.insert(tag, tag.limit(1), "tag")
    tree = {r["path"]: r["depth"] for r in catalog.tag_tree(tag.filter("id <> '1'")).collect()}
    assert tree == {"a.b": 0, "a.c": 0}
    with pytest.raises(schema.NotFound):
        catalog.find(tag, "77")


def test_layout(spark):
    bodies = [(1, i, 0, f"S{i}", f"Some Running Head 1{i}\nreal text {i}\n{i}") for i in range(1, 5)]
    s = spark.createDataFrame(bodies, "doc_id int, section_no int, level int, title string, body string")
    md = layout.outline_markdown(s).first()["markdown"]
    assert "Running" not in md and md.startswith("## S1\n\nreal text 1")
    lines = spark.createDataFrame([(1, 1, "Title", 20.0, True), (1, 2, "body", 10.0, False), (1, 3, "more", 10.0, False)], "doc_id int, line_no int, text string, font_size double, starts_paragraph boolean")
    assert layout.font_markdown(lines).first()["markdown"] == "# Title\n\nbody\nmore"
    glyph = [(1, 1, float(x), float(y), 8.0) for y in range(0, 120, 12) for x in (10, 20, 30, 100, 110)]
    g = spark.createDataFrame(glyph, "doc_id int, page int, x double, y double, width double")
    band = layout.column_bands(g, 0, 200, 200).first()
    assert (band["split_x"], band["y_start"], band["y_end"]) == (100, 0.0, 108.0)
    order = [r["x"] for r in layout.reading_order(g, layout.column_bands(g, 0, 200, 200)).orderBy("reading").collect()]
    assert order[:30] == [10.0, 20.0, 30.0] * 10 and order[30:32] == [100.0, 110.0]


def test_search_end_to_end(spark):
    docs = spark.createDataFrame([("d1", "dom", [], "TOKEN", ["Cats purr when they are happy. Dogs bark."]), ("d2", "dom", ["x.y"], "TOKEN", ["Stock markets fell on Monday."])], "id string, domain_id string, tags array<string>, chunk_strategy string, pages array<string>")
    docs = docs.withColumn("markdown", F.array_join("pages", "\n")).withColumn("structural_variant", F.lit("GENERIC"))
    chunk = chunking.to_chunk_rows(chunking.chunk_documents(docs))
    document = docs.select("id", F.upper("id").alias("title"), F.lit("me").alias("author"))
    embed = chunking.hashing_embedder()
    page = search.hybrid_search(chunk, document, "happy cats", embed, "dom")
    rows = page.results.collect()
    assert page.total == 2 and rows[0]["document_title"] == "D1" and rows[0]["search_type"] == "BOTH" and "<b>" in rows[0]["headline"] and page.total_pages == 1
    assert search.lexical_search(chunk, document, "markets", "dom", tags=["x"]).total == 1 and search.lexical_search(chunk, document, "markets", "dom", tags=["z"]).total == 0
    assert search.vector_search(chunk, document, embed("stock markets"), "dom", size=1).first()["document_title"] == "D2"
    got = answers.rag_answer(chunk, document, "happy cats", embed, "dom", answers.canned_chat)
    assert got["answer"].startswith("Cats purr") and got["context"].startswith("### D1")


def test_streaming_ingest(spark, tmp_path):
    from corvina.streaming import ingest

    inbox, store = tmp_path / "in", str(tmp_path / "store")
    inbox.mkdir()
    (inbox / "book.epub").write_bytes(make_zip(BOOK))
    (inbox / "note.txt").write_bytes(b"no")
    domain = spark.createDataFrame([("dom", "D", "", "STRUCTURAL", None)], schema.DOMAIN)
    for _ in range(2):
        ingest.ingest_stream(spark, str(inbox), domain, store, "dom").awaitTermination()
    status = {r["ingestion_status"]: r["n"] for r in ingest.status(spark, store).collect()}
    assert status == {"COMPLETED": 1, "FAILED": 1}
    ingest.ingest_batch(spark.read.format("binaryFile").load(str(inbox)), domain, store, "dom")
    assert ingest.status(spark, store).groupBy().sum("n").first()[0] == 2 and spark.read.parquet(store + "/chunk").count() > 0


def make_pdf(packed=True):
    """Two pages with an outline, a running head and a ToUnicode font; streams packed or plain."""
    import zlib

    def stream(body):
        data = zlib.compress(body) if packed else body
        return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), b"/Filter /FlateDecode" if packed else b"", data)

    first = b"BT /F1 20 Tf 50 700 Td (Great Title) Tj /F1 10 Tf 0 -40 Td 14 TL (Some \\(plain\\) words) Tj T* [(sp) -20 (lit) -300 (apart)] TJ ET"
    second = b"q 1 0 0 1 0 10 cm BT /F2 10 Tf 1 0 0 1 50 690 Tm <00010002> Tj ET BT /F1 10 Tf 50 600 Td (caf\\351 end) Tj ET Q"
    cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0001> <0048> endbfchar 1 beginbfrange <0002> <0003> <0069> endbfrange"
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R /Outlines 9 0 R >>", b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /Resources << /Font << /F1 7 0 R /F2 8 0 R >> >> >>",
        b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R >>", b"<< /Type /Page /Parent 2 0 R /Contents [6 0 R] >>", stream(first), stream(second),
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", b"<< /Type /Font /Subtype /Type0 /ToUnicode 12 0 R >>",
        b"<< /First 10 0 R >>", b"<< /Title (Opening) /Dest [3 0 R /XYZ 0 750 0] /Next 11 0 R >>", b"<< /Title <feff005a> /A << /S /GoTo /D [4 0 R /XYZ 0 720 0] >> >>", stream(cmap),
    ]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>\n%%EOF"


def test_pdf(spark):
    from corvina.sources import pdf

    for packed in (True, False):
        lines, marks = pdf.read_pdf(make_pdf(packed))
        assert [(x.page, x.text) for x in lines] == [(1, "Great Title"), (1, "Some (plain) words"), (1, "split apart"), (2, "Hi"), (2, "café end")]
        assert lines[0].size == 20 and lines[3].y == 700 and marks == [(0, "Opening", 1, 750.0), (0, "Z", 2, 720.0)]
    flat = make_pdf().replace(b"/Outlines 9 0 R", b"")
    files = spark.createDataFrame([("a", make_pdf()), ("b", flat), ("c", b"no pdf"), ("d", None)], "id string, content binary")
    got = {r["id"]: r for r in pdf.pdf_columns(files).collect()}
    assert got["a"]["pdf_markdown"] == "## Opening\n\nGreat Title\nSome (plain) words\nsplit apart\n\n## Z\n\nHi\ncafé end"
    assert got["b"]["pdf_markdown"].startswith("# Great Title\n\nSome (plain) words") and got["b"]["pdf_pages"] == ["Great Title\nSome (plain) words\nsplit apart", "Hi\ncafé end"]
    assert [got[k]["pdf_markdown"] for k in "cd"] == ["", ""] and pdf.read_pdf(make_pdf().replace(b"trailer <<", b"trailer << /Encrypt 1 0 R")) == ([], [])


def test_ingest_replays_after_a_crash(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    from corvina.sources import archive as arc
    from corvina.streaming import ingest

    inbox, store = tmp_path / "in", str(tmp_path / "store")
    inbox.mkdir()
    (inbox / "book.epub").write_bytes(make_zip(BOOK))
    (inbox / "paper.pdf").write_bytes(make_pdf())
    (inbox / "broken.pdf").write_bytes(b"%PDF-1.4 nothing")
    domain = spark.createDataFrame([("dom", "D", "", "TOKEN", None)], schema.DOMAIN)
    files = spark.read.format("binaryFile").load(str(inbox))
    write = DataFrameWriter.parquet

    def breaks(self, path, *a, **k):
        if path.endswith("/document"):
            raise OSError("lost between the two writes")
        return write(self, path, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", breaks)
    with pytest.raises(OSError):
        ingest.ingest_batch(files, domain, store, "dom")
    monkeypatch.setattr(DataFrameWriter, "parquet", write)
    before = spark.read.parquet(store + "/chunk").count()
    ingest.ingest_batch(files, domain, store, "dom")
    chunk, document = spark.read.parquet(store + "/chunk"), spark.read.parquet(store + "/document")
    assert chunk.count() == before == chunk.select("id").distinct().count() > 0
    rows = {r["source_filename"]: r for r in document.collect()}
    assert rows["broken.pdf"]["ingestion_status"] == "FAILED" and rows["broken.pdf"]["ingestion_error"] and rows["paper.pdf"]["ingestion_status"] == "COMPLETED"
    text = {r["content"] for r in chunk.collect()}
    assert any("Some (plain) words" in t for t in text) and not any("#" in t for t in text)  # TOKEN chunks are of plain text
    book = rows["book.epub"]
    stored = arc.read_files(spark, store + "/files").withColumn("path", F.regexp_replace("path", "^file:", ""))
    served = arc.serve(document, stored, book["id"]).first()
    assert bytes(served["content"]) == (inbox / "book.epub").read_bytes() and served["media_type"] == arc.EPUB_TYPE
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        ingest._existing(spark, str(tmp_path / "bad"), schema.DOCUMENT).count()


def test_deep_markup_and_long_texts():
    deep = "<div>" * 20_000 + "<b>x</b>" + "</div>" * 20_000
    assert markup.html_to_markdown(deep) == "**x**" and markup.html_to_text(deep) == "x"
    assert markup.html_to_markdown("<blockquote>" * 3000 + "q") == "> q"
    long_ = "A sentence goes on. " * 500_000
    got = chunking.token_split(long_, 600)
    assert sum(len(c.split()) for c in got) == 2_000_000 and max(map(len, got)) < 4000


def test_token_split_by_a_vocabulary():
    vocabulary = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    t, text = Tokenizer.from_file(vocabulary), "Prices rose 12.5% in Köln, 日本語 too. " * 400
    got = chunking.token_split(text, 50, min_chars=60, spans=chunking.vocabulary_spans(vocabulary))
    assert "".join("".join(got).split()) == "".join(text.split()) and all(len(t.encode(c).ids) <= 52 for c in got) and all(c.endswith(".") for c in got[:-1])


def test_search_page_and_detail(spark):
    row = lambda i, text: (f"c{i}", "d", "dom", ["x"], text, [1.0, float(i)], i, [("cat", 1)] if "cat" in text else [])
    chunk = spark.createDataFrame([row(0, "a cat"), row(1, "cat two"), row(2, "dog")], "id string, document_id string, domain_id string, tag_paths array<string>, content string, embedding array<float>, chunk_index int, lexemes array<struct<lexeme:string,pos:int>>").withColumn("chunk_strategy", F.lit("TOKEN"))
    document = spark.createDataFrame([("d", "T", "A")], "id string, title string, author string")
    ask = lambda q, **k: search.search_page(chunk, document, q, lambda _: [1.0, 0.0], "dom", **k)
    assert ask(" ") is None and ask(None) is None and search.search_page(chunk, document, "cat", lambda _: [1.0], None) is None
    page = ask("cats", tags=["", " "], size=2, page=1)
    assert page.total == 3 and [r["chunk_id"] for r in page.results.collect()] == ["c2"] and page.has_previous and not page.has_next
    one = search.chunk_detail(chunk, document, "c1").first()
    assert (one["previous_id"], one["next_id"], one["content"], one["document_title"]) == ("c0", "c2", "cat two", "T")
    with pytest.raises(schema.NotFound):
        search.chunk_detail(chunk, document, "zz")
    assert catalog.default_domain(spark.createDataFrame([("2", "b"), ("1", "a")], "id string, name string")).first()["id"] == "1"


def test_text_that_is_a_crumb_stays(spark):
    df = spark.createDataFrame([("a", " avec.\n"), ("b", " "), ("c", None), ("d", "Rain fell.")], "id string, t string")
    assert {r["id"]: r["c"] for r in df.select("id", chunking.token_chunks(F.col("t")).alias("c")).collect()} == {"a": ["avec."], "b": [], "c": [], "d": ["Rain fell."]}


def test_references_without_semicolon_stay(spark):
    page = "<h1>Salt &amp; ash&amp</h1><p>1 &lt; 2 &lt3 &#38; &#38 &nosuch; &copy2</p>"
    assert markup.html_to_markdown(page) == "# Salt & ash&amp\n\n1 < 2 &lt3 & &#38 &nosuch; &copy2"
    assert markup.html_to_text(page) == "Salt & ash&amp 1 < 2 &lt3 & &#38 &nosuch; &copy2"


def test_token_ends_follow_from_bytes(monkeypatch):
    import random

    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    spans, ends = chunking.vocabulary_spans(path), chunking.vocabulary_ends(path)
    pick = random.Random(3)
    monkeypatch.setattr(chunking, "REMEMBERED", 50)  # so that words are forgotten, too
    for n in [0, 1, 2, 5, 30, 300] * 30:
        words = ["".join(pick.choice(" \n\t　'sdet12é日😀.,!_<|>") for _ in range(pick.randint(0, 6))) for _ in range(n)]
        text = pick.choice(" \n").join(words).replace("tt", "<|endoftext|>")
        assert ends(text) == [b for _, b in spans(text)]


def test_texts_are_not_shuffled_for_their_embeddings(spark):
    import __spark_entry__ as entry
    from corvina.plans import queries

    chunk, document = queries._chunks(spark, entry.SMOKE_DIR)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for read in (chunk.select("id", "lexemes"), chunk.select("id", "content")):
        assert "Join" not in plan(read) and "Exchange" not in plan(read)
    ranked = spark.createDataFrame([("3", 0.5, 1, None, 1)], "id string, score double, lex_rank int, vec_rank int, rank int")
    shown = answers.contents(spark.createDataFrame([("3", 1, "head"), ("gone", 2, "kept")], "chunk_id string, rank int, headline string"), chunk)
    for read in (search.hydrate(ranked, chunk, document, "th"), chunk.select("id", "embedding")):
        assert read.count() > 0
    scan = [x for x in plan(shown).split("\n") if "SortMergeJoin" in x and "LeftOuter" not in x]
    assert not scan and {r["chunk_id"]: r["content"] == r["headline"] for r in shown.collect()} == {"3": False, "gone": True}


def test_rows_of_a_small_file_are_spread(spark):
    import __spark_entry__ as entry

    assert entry.queries()["c5_c6_recipes"](spark, entry.SMOKE_DIR).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_semantic_gaps_are_computed_once(spark):
    df = spark.createDataFrame([(1, "\n\n".join(["cats purr softly", "", "...", "dogs bark"] * 3))], "k int, markdown string")
    out = chunking.split_semantic(df, "k", config=schema.Semantic(window=0, min_chars=5))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lead(") == 1 and plan.count("zip_with(") == 3  # a norm, a product, and the grouping
    assert " ".join(out.first()["chunks"]).split() == ["cats", "purr", "softly", "...", "dogs", "bark"] * 3

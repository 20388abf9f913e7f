import pytest
from pyspark.sql import functions as F

from corvina.functions import analysis, paths, vectors
from corvina.functions import text as tx


def one(spark, column, **values):
    row = [tuple(values.values())] if values else [(1,)]
    return spark.createDataFrame(row, ", ".join(f"{k} {v}" for k, v in KINDS.items() if k in values) or "x int").select(column.alias("r")).first()["r"]


KINDS = {"s": "string", "a": "array<string>", "v": "array<double>", "w": "array<double>"}


def test_strip_and_excerpt(spark):
    assert one(spark, tx.strip_markdown(F.col("s")), s="# A *b*  [c](d)") == "A b c d"
    assert one(spark, tx.strip_markdown(F.col("s")), s=None) is None
    assert one(spark, tx.excerpt(F.col("s"), 10), s="abcde fghij klm") == "abcde…"
    assert one(spark, tx.excerpt(F.col("s"), 5), s="abcdefghij") == "abcde…"


@pytest.mark.parametrize(
    ("chunks", "n", "last"),
    [
        (["Rain fell all night. By dawn the river had risen.", "Boats were moved uphill."], 40, "By dawn the river had risen. Boats were moved uphill."),
        (["Brief.", "And then more."], 100, "Brief. And then more."),
        (["alpha beta gamma delta epsilon", "zeta"], 10, "ta epsilon zeta"),
    ],
)
def test_overlap(spark, chunks, n, last):
    from corvina.operators.chunking import overlap

    assert one(spark, overlap(F.col("a"), n), a=chunks)[-1] == last
    assert one(spark, overlap(F.col("a"), 0), a=chunks) == chunks
    assert one(spark, overlap(F.col("a"), n), a=chunks[:1]) == chunks[:1]


def test_rerank_numbers(spark):
    for text, n, want in [("[2,0,1]", 3, [2, 0, 1]), ("so: 1 and 0, 3, 99", 3, [1, 0]), ("none", 3, []), ("9999999999999 1", 3, [1])]:
        assert one(spark, tx.rerank_order(F.col("s"), n), s=text) == want


def test_headings(spark):
    could = lambda t, **o: one(spark, tx.could_be_heading(F.col("s"), **o), s=t)
    assert not could("Hi") and not could("X" * 81) and not could("Ends.") and not could("lowercase title")
    assert could("Is This A Heading?") and could("1.2 Background") and not could("1.2 background", numbered=False)
    assert not could("Notebook", excluded=("note",))


def test_header_key_and_furniture(spark):
    assert one(spark, tx.running_header_key(F.col("s")), s="Serves 4") == "Serves 4"
    assert one(spark, tx.running_header_key(F.col("s")), s="Bread and Other Things 12") == "Bread and Other Things"
    for t, want in [("12", True), ("a.INDD 3", True), ("see Page:11", True), ("Chapter 4 Beef", True), ("", False), ("12345", False)]:
        assert one(spark, tx.is_page_furniture(F.col("s")), s=t) is want


def test_merge_short_and_palindrome(spark):
    assert one(spark, tx.merge_short(F.col("a"), 5), a=["ab", "cdefg", "h"]) == ["ab\n\ncdefg", "h"]
    assert one(spark, tx.merge_short(F.col("a"), 5), a=[]) == []
    assert [one(spark, tx.is_palindrome(F.col("s")), s=x) for x in ("racecar", "hello", "")] == [True, False, False]


def test_paths(spark):
    assert one(spark, paths.ancestors(F.col("s")), s="a.b.c") == ["a", "a.b"] and one(spark, paths.ancestors(F.col("s")), s="d") == []
    assert one(spark, paths.any_under(F.col("a"), ["cuisine"]), a=["cuisine.italian"]) and not one(spark, paths.any_under(F.col("a"), ["cuisine"]), a=["cuisines"])
    assert one(spark, paths.display_name(F.col("s")), s="x.northern_italian") == "Northern italian"
    assert one(spark, tx.slug(F.col("s")), s="  Côte d'Or! ") == "c_te_d_or"


def test_vectors(spark):
    assert one(spark, vectors.cosine_similarity(F.col("v"), F.col("w")), v=[1.0, 0.0], w=[1.0, 1.0]) == pytest.approx(0.7071067811865)
    assert one(spark, vectors.cosine_similarity(F.col("v"), F.col("w")), v=[0.0, 0.0], w=[1.0, 1.0]) == 0.0
    assert one(spark, vectors.nearest_rank(F.col("v"), 0.85), v=[3.0, 1.0, 2.0]) == 3.0
    assert one(spark, vectors.upper_median(F.col("v")), v=[4.0, 1.0, 3.0, 2.0]) == 3.0


@pytest.mark.parametrize(
    ("word", "want"),
    [("running", "run"), ("ponies", "poni"), ("cries", "cri"), ("ties", "tie"), ("generously", "generous"), ("hopping", "hop"), ("hoping", "hope"), ("national", "nation"), ("happy", "happi"), ("consistency", "consist"), ("knightly", "knight"), ("sky", "sky"), ("agreed", "agre")],
)
def test_stems(word, want):
    assert analysis.stem(word) == want


def test_cover_density_and_headline():
    lex = analysis.lexemes("The quick fox met a slow fox and a quick dog")
    assert analysis.cover_density(lex, ["fox"]) == pytest.approx(0.2)
    assert analysis.cover_density(lex, ["quick", "fox"]) > 0.1 and analysis.cover_density(lex, ["quick", "cat"]) == 0 and analysis.query_lexemes("the of") == []
    shown = analysis.headline("word " * 60 + "foxes here", ["fox"])
    assert "<b>foxes</b>" in shown and len(shown.split()) <= 35


def test_ranks_within_groups(spark):
    from corvina.operators import ranks

    rows = [("a", float(i * i % 37)) for i in range(200)] + [("b", 5.0)] * 9 + [(None, None), (None, 2.0), ("c", 1e9), ("c", 0.0), ("c", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    for place in (lambda n: F.floor(n / 2) + 1, lambda n: n, lambda n: F.lit(1)):
        got = {r["g"]: r["v"] for r in ranks.nth_value(df, "g", "v", place).collect()}
        for g in ("a", "b", "c", None):
            v = sorted((x for k, x in rows if k == g), key=lambda x: (x is not None, x))
            at = spark.range(1).select(place(F.lit(len(v))).alias("p")).first()["p"]
            assert got[g] == v[at - 1]
    seq = spark.createDataFrame([(i % 3, i, f"x{i}") for i in range(300)], "g int, i int, v string").repartition(7)
    nxt = {r["i"]: r["n"] for r in ranks.with_next(seq, "g", "i", {"v": "n"}).collect()}
    assert nxt == {i: f"x{i + 3}" if i < 297 else None for i in range(300)}
    run = {r["i"]: r["before"] for r in ranks.running_before(seq.withColumn("k", F.col("i")), "g", "i", "k").collect()}
    assert run == {i: sum(range(i % 3, i, 3)) for i in range(300)}


def test_stored_index_is_searched_by_lexeme(spark, tmp_path):
    from corvina.operators import search

    c = spark.createDataFrame([(i, "d", [("even" if i % 2 == 0 else "odd", 1), (f"w{i % 7}", 2)]) for i in range(50)], "id int, domain_id string, lexemes array<struct<lexeme:string,pos:int>>")
    index = search.store_index(search.inverted_index(c), str(tmp_path / "index"))
    found = search.index_match(index, ["even", "w3"])
    assert sorted(r["id"] for r in found.collect()) == [i for i in range(50) if i % 2 == 0 and i % 7 == 3]
    assert "PushedFilters: [In(lexeme" in found._jdf.queryExecution().toString()


def test_ranking_gives_python_wanted_lexemes_only(spark):
    rows = [([("a", 1), ("x", 2), ("b", 3), ("y", 4), ("a", 5)],), ([("a", 1)],), (None,), ([],)]
    df = spark.createDataFrame(rows, "lex " + analysis.LEXEMES).select(analysis.rank_cd(F.col("lex"), ["a", "b"]).alias("r"))
    assert "ranked(filter(lex" in df._jdf.queryExecution().analyzed().toString()
    assert [r["r"] for r in df.collect()] == [pytest.approx(0.1), 0.0, 0.0, 0.0]


def test_lexemes_leave_python_in_bounded_arrays(spark):
    import pyarrow as pa

    texts = ["cats purring", None, "", "the dogs barked at night", "rain"] * 40
    got = list(analysis.lexeme_arrays(pa.array(texts, pa.string()), 10))
    assert len(got) > 10 and max(len(x.flatten()) for x in got) < 10 + 3
    assert [[(v["lexeme"], v["pos"]) for v in r] for x in got for r in x.to_pylist()] == [analysis.lexemes(t) for t in texts]
    assert [len(x) for x in analysis.lexeme_arrays(pa.array([], pa.string()))] == [0]

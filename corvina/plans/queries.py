"""Queries over the driver tables, named after the operators that they run.

A language is a domain, ``lang.source`` a tag path, a line a chunk, and an embedding
belongs to the document of its id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import analysis, paths, vectors
from ..functions import text as tx
from ..operators import answers, catalog, chunking, layout, ranks, search
from ..sources import markup

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def lines_of(s: SparkSession, d: str) -> DataFrame:
    """(doc_id, idx, line), lines as chunks in order."""
    return tx.unrolled(t(s, d, "documents"), "doc_id", F.split("text", "\n"), "idx", "line")


LINES = "lines AS (SELECT doc_id, (unnest(range(0, len(l))))::INT AS idx, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


def tags_of(s: SparkSession, d: str) -> DataFrame:
    """A tag per language and per language and source, as a catalogue would hold them."""
    x = t(s, d, "documents").select("lang", "source").filter("lang IS NOT NULL AND source IS NOT NULL").distinct()
    leaf = x.select(F.lit("all").alias("domain_id"), F.concat_ws(".", "lang", "source").alias("path"))
    both = leaf.union(x.select(F.lit("all"), "lang").distinct())
    return both.select(F.col("path").alias("id"), "domain_id", paths.display_name(F.col("path")).alias("name"), F.lit("").alias("description"), "path")


TAGS = """x AS (SELECT DISTINCT lang, source FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL),
 tag AS (SELECT path AS id, 'all' AS domain_id, path, upper(left(l, 1)) || substr(l, 2) AS name FROM (SELECT path, regexp_replace(path, '^.*\\.', '') AS l
 FROM (SELECT lang || '.' || source AS path FROM x UNION SELECT lang FROM x)))"""

TERM = "ering"
TF = f"len(list_filter(regexp_extract_all(lower(text), '([a-z0-9]+)', 1), lambda w: w = '{TERM}'))"


def _query_vector(s: SparkSession, d: str) -> list[float]:
    """The vector that is searched with: one row."""
    return t(s, d, "embeddings").filter("vec_id = 0").select("embedding").first()["embedding"]


def _legs(s: SparkSession, d: str, k: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = t(s, d, "documents").filter("lang = 'en'")
    tf = docs.select(F.col("doc_id").alias("id"), (analysis.term_frequency(F.col("text"), TERM) * F.lit(0.1)).alias("score")).filter("score > 0")
    sim = F.round(vectors.cosine_similarity(F.col("embedding"), vectors.literal(_query_vector(s, d))), 9)
    near = t(s, d, "embeddings").select(F.col("vec_id").alias("id"), sim.alias("score")).join(docs.select(F.col("doc_id").alias("id")), "id", "left_semi")
    return docs, search.top(tf, "score", "id", k), search.top(near, "score", "id", k)


@query(f"""
WITH lex AS (SELECT doc_id AS id, row_number() OVER (ORDER BY 0.1 * tf DESC, doc_id) AS r FROM (SELECT doc_id, {TF} AS tf FROM documents WHERE lang = 'en') WHERE tf > 0),
 vec AS (SELECT id, row_number() OVER (ORDER BY sim DESC, id) AS r FROM (SELECT e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS sim
         FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id, embeddings q WHERE q.vec_id = 0 AND d.lang = 'en')),
 f AS (SELECT id, sum(1e0 / (60 + r)) AS score, min(CASE WHEN leg = 0 THEN r END) AS lex_rank, min(CASE WHEN leg = 1 THEN r END) AS vec_rank
       FROM (SELECT id, r, 0 AS leg FROM lex WHERE r <= 50 UNION ALL SELECT id, r, 1 FROM vec WHERE r <= 50) GROUP BY id)
SELECT (row_number() OVER (ORDER BY score DESC, lex_rank NULLS LAST, vec_rank NULLS LAST))::INT AS rank, f.id AS doc_id, round(score, 9) AS score, lex_rank::INT AS lex_rank, vec_rank::INT AS vec_rank, d.source,
 CASE WHEN lex_rank IS NOT NULL AND vec_rank IS NOT NULL THEN 'BOTH' WHEN vec_rank IS NOT NULL THEN 'EMBEDDING' ELSE 'LEXICAL' END AS search_type
FROM f JOIN documents d ON d.doc_id = f.id""")
def hybrid_search(s: SparkSession, d: str) -> DataFrame:
    """R11, W2, O5, U1, P0e, J1: both legs' best fifty, fused, then joined to their documents."""
    docs, lex, vec = _legs(s, d)
    f = search.fuse(lex, vec)
    return f.join(docs.select(F.col("doc_id").alias("id"), "source"), "id").select(
        "rank", F.col("id").alias("doc_id"), F.round("score", 9).alias("score"), "lex_rank", "vec_rank", "source", search.search_type(F.col("lex_rank"), F.col("vec_rank")).alias("search_type")
    )


@query(f"SELECT doc_id, rank::INT AS rank, round(score, 9) AS score FROM (SELECT doc_id, 0.1e0 * tf AS score, row_number() OVER (ORDER BY tf DESC, doc_id) AS rank FROM (SELECT doc_id, {TF} AS tf FROM documents WHERE lang = 'en') WHERE tf > 0) WHERE rank <= 50")
def r5_lexical_single_term(s: SparkSession, d: str) -> DataFrame:
    return _legs(s, d)[1].select(F.col("id").alias("doc_id"), "rank", F.round("score", 9).alias("score"))


@query("""SELECT id AS doc_id, rank::INT AS rank, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (
 SELECT e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS score FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id, embeddings q WHERE q.vec_id = 0 AND d.lang = 'en')) WHERE rank <= 50""")
def r9_vector_search(s: SparkSession, d: str) -> DataFrame:
    return _legs(s, d)[2].select(F.col("id").alias("doc_id"), "rank", "score")


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def r8_cosine(s: SparkSession, d: str) -> DataFrame:
    e = t(s, d, "embeddings").select("vec_id", "embedding")
    o = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("o"))
    return e.join(o, "vec_id").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), F.round(vectors.cosine_similarity(F.col("embedding"), F.col("o")), 6).alias("similarity"))


@query("SELECT doc_id, source FROM documents WHERE lang = 'en'")
def f1_key_filter(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "documents").filter("lang = 'en'").select("doc_id", "source")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_name ILIKE '%1%'")
def f2_ilike(s: SparkSession, d: str) -> DataFrame:
    return catalog.search_names(t(s, d, "nation"), "n_name", "1").select("n_nationkey", "n_name")


@query(f"WITH {TAGS} SELECT path, name FROM tag WHERE contains(lower(name), 'rc1') OR contains(lower(path), 'rc1')")
def f3_name_or_path(s: SparkSession, d: str) -> DataFrame:
    return catalog.filter_tags(tags_of(s, d), "RC1").select("path", "name")


@query(f"WITH {LINES} SELECT doc_id, idx, line FROM lines WHERE doc_id = 11 AND idx = 1")
def f4_two_part_key(s: SparkSession, d: str) -> DataFrame:
    return lines_of(s, d).filter("doc_id = 11 AND idx = 1")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def f5_membership(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "documents").select("doc_id", "lang").join(t(s, d, "labels").filter("toxic = 1"), "doc_id", "left_semi")


@query("SELECT vec_id, label FROM embeddings WHERE embedding IS NOT NULL")
def f6_not_null(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "embeddings").filter(F.col("embedding").isNotNull()).select("vec_id", "label")


@query("SELECT doc_id, lang || '.' || source AS path FROM documents WHERE lang = 'de' OR starts_with(lang || '.' || source, 'de.') OR lang || '.' || source = 'en.src1' OR starts_with(lang || '.' || source, 'en.src1.')")
def f8_tag_filter(s: SparkSession, d: str) -> DataFrame:
    """Paths under any wanted tag, label by label."""
    docs = t(s, d, "documents").select("doc_id", F.concat_ws(".", "lang", "source").alias("path"))
    return docs.filter(paths.any_under(F.array("path"), ["de", "en.src1"]))


@query(f"WITH {TAGS} SELECT path FROM tag WHERE path <> 'en' AND starts_with(path, 'en.')")
def f9_h3_descendants(s: SparkSession, d: str) -> DataFrame:
    """J4, H3, F9."""
    return catalog.descendants(tags_of(s, d), "en").select("path")


@query("SELECT r_name, n_name, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN 'TOKEN' END, CASE WHEN r_regionkey % 2 = 0 THEN 'SEMANTIC' END, 'STRUCTURAL') AS chunk_strategy FROM nation JOIN region ON n_regionkey = r_regionkey")
def p0d_strategy(s: SparkSession, d: str) -> DataFrame:
    """P0d: a document's own strategy, else its domain's, else the default."""
    dom = t(s, d, "region").select(F.col("r_regionkey").cast("string").alias("id"), "r_name", F.when(F.col("r_regionkey") % 2 == 0, "SEMANTIC").alias("chunk_strategy"), F.lit(None).cast("string").alias("structural_variant"))
    doc = t(s, d, "nation").select(F.col("n_regionkey").cast("string").alias("domain_id"), "n_name", F.when(F.col("n_nationkey") % 3 == 0, "TOKEN").alias("chunk_strategy"), F.lit(None).cast("string").alias("structural_variant"))
    got = chunking.strategy(doc, dom)
    return got.join(dom.select(F.col("id").alias("domain_id"), "r_name"), "domain_id").select("r_name", "n_name", "chunk_strategy")


@query("""SELECT page_id, CASE WHEN position('.' IN url) > 0 THEN lower(regexp_replace(url, '^.*\\.', '')) ELSE '' END AS suffix,
 CASE WHEN regexp_replace(coalesce(title, ''), '^\\s+|\\s+$', '', 'g') = '' THEN regexp_replace(url, '^\\s+|\\s+$', '', 'g') ELSE title END AS title
 FROM (SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN '  ' ELSE 'Page ' || page_id END AS title FROM pages)""")
def p0f_upload_names(s: SparkSession, d: str) -> DataFrame:
    p = t(s, d, "pages").withColumn("title", F.when(F.col("page_id") % 2 == 0, "  ").otherwise(F.concat(F.lit("Page "), "page_id")))
    return p.select("page_id", tx.file_suffix(F.col("url")).alias("suffix"), tx.title_or_filename(F.col("title"), F.col("url")).alias("title"))


@query("SELECT coalesce(l.id, v.id) AS id, l.rank::INT AS lex_rank, v.rank::INT AS vec_rank FROM (SELECT doc_id AS id, doc_id + 1 AS rank FROM documents) l FULL JOIN (SELECT vec_id + 100 AS id, vec_id + 1 AS rank FROM embeddings) v ON l.id = v.id")
def j5_full_outer(s: SparkSession, d: str) -> DataFrame:
    """J5 over two lists as long as their tables, which overlap in part."""
    lex = t(s, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") + 1).cast("int").alias("rank"))
    vec = t(s, d, "embeddings").select((F.col("vec_id") + 100).alias("id"), (F.col("vec_id") + 1).cast("int").alias("rank"))
    return search.fused(lex, vec).select("id", "lex_rank", "vec_rank")


@query("SELECT b.item_id, coalesce(d.text, 'gone ' || b.item_id) AS content FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id * 37")
def j7_content_or_headline(s: SparkSession, d: str) -> DataFrame:
    """Results whose chunk is there, and, past the last document, some whose isn't."""
    r = t(s, d, "benchmark").select("item_id", (F.col("item_id") * 37).alias("chunk_id"), F.concat(F.lit("gone "), "item_id").alias("headline"))
    c = t(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return answers.contents(r, c).select("item_id", "content")


@query(f"WITH {TAGS} SELECT a.path, a.parent_path, p.name AS parent_name FROM (SELECT *, CASE WHEN position('.' IN path) > 0 THEN regexp_replace(path, '\\.[^.]*$', '') END AS parent_path FROM tag) a LEFT JOIN tag p ON p.path = a.parent_path")
def j8_parent(s: SparkSession, d: str) -> DataFrame:
    g = tags_of(s, d)
    p = g.select(F.col("path").alias("parent_path"), F.col("name").alias("parent_name"))
    return g.select("path", paths.parent(F.col("path")).alias("parent_path")).join(p, "parent_path", "left").select("path", "parent_path", "parent_name")


@query(f"WITH {TAGS} SELECT d.doc_id, [coalesce(a.name, d.lang || '.' || d.source), 'none.such'] AS labels FROM documents d LEFT JOIN tag a ON a.path = d.lang || '.' || d.source")
def j9_tag_labels(s: SparkSession, d: str) -> DataFrame:
    docs = t(s, d, "documents").select(F.col("doc_id").alias("id"), F.lit("all").alias("domain_id"), F.array(F.concat_ws(".", "lang", "source"), F.lit("none.such")).alias("tags"))
    return catalog.tag_labels(docs, tags_of(s, d)).select(F.col("id").alias("doc_id"), "labels")


@query("SELECT c.conv_id, c.turn, p.turn AS previous_turn, n.turn AS next_turn FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1 LEFT JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1")
def j10_neighbours(s: SparkSession, d: str) -> DataFrame:
    c = t(s, d, "conversations").select(F.struct("conv_id", "turn").alias("id"), F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"))
    n = search.neighbours(c)
    return n.select(F.col("document_id").alias("conv_id"), F.col("chunk_index").alias("turn"), F.col("previous_id.turn").alias("previous_turn"), F.col("next_id.turn").alias("next_turn"))


@query("SELECT count(*) AS n FROM documents WHERE lang = 'fr' AND source ILIKE '%src1%'")
def a1_filtered_count(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "documents").filter(F.col("lang") == "fr").filter(tx.contains_ci(F.col("source"), "src1")).agg(F.count(F.lit(1)).alias("n"))


HEADER_KEY = "CASE WHEN length(bare) >= 12 AND len(list_filter(regexp_split_to_array(bare, '\\s+'), lambda w: w <> '')) >= 3 THEN bare ELSE one END"


@query(f"""WITH {LINES}, k AS (SELECT doc_id, regexp_replace(line, ' {{2,}}', ' ', 'g') AS one FROM (SELECT doc_id, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM lines)),
 b AS (SELECT doc_id, one, regexp_replace(one, ' \\d{{1,4}}$', '') AS bare FROM k), h AS (SELECT DISTINCT source, doc_id, {HEADER_KEY} AS line FROM b JOIN documents USING (doc_id)),
 n AS (SELECT source, count(*) AS n FROM documents GROUP BY source)
 SELECT h.source, line, count(*) AS c FROM h JOIN n USING (source) WHERE line <> '' AND length(line) <= 60 GROUP BY h.source, line, n HAVING count(*) >= greatest(n * 0.02, 2.0)""")
def a3_a4_repeated_lines(s: SparkSession, d: str) -> DataFrame:
    """Short lines by how many of a source's documents hold them, from a share on."""
    docs = t(s, d, "documents").select("source", "doc_id", "text")
    # a row's own lines are made distinct within the row, so nothing is shuffled for it
    short = F.filter(F.split("text", "\n"), lambda l: F.length(tx.trim_ws(l)) <= 60 + 5)
    keys = F.array_distinct(F.transform(short, lambda l: tx.running_header_key(tx.trim_ws(l))))
    x = docs.select("source", F.explode_outer(keys).alias("line")).filter((F.col("line") != "") & (F.length("line") <= 60))
    n = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    c = x.groupBy("source", "line").agg(F.count(F.lit(1)).alias("c"))
    return c.join(F.broadcast(n) if n.count() < 10_000 else n, "source").filter(F.col("c") >= F.greatest(F.col("n") * 0.02, F.lit(2.0))).select("source", "line", "c")


def _glyphs(s: SparkSession, d: str) -> DataFrame:
    li = t(s, d, "lineitem")
    return li.select(
        (F.col("l_orderkey") % 7).alias("doc_id"), (F.col("l_orderkey") % 3).cast("int").alias("page"), ((F.col("l_linenumber") - 1) * 70 + F.col("l_suppkey") % 4).cast("double").alias("x"),
        ((F.col("l_orderkey") % 60) * 12).cast("double").alias("y"), F.lit(8.0).alias("width"),
    ).distinct()


GLYPHS = "g AS (SELECT DISTINCT l_orderkey % 7 AS doc_id, (l_orderkey % 3)::INT AS page, ((l_linenumber - 1) * 70 + l_suppkey % 4)::DOUBLE AS x, ((l_orderkey % 60) * 12)::DOUBLE AS y, 8.0::DOUBLE AS width FROM lineitem)"


@query(f"""WITH {GLYPHS}, l AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, page ORDER BY y, x ROWS UNBOUNDED PRECEDING) AS line FROM (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY doc_id, page ORDER BY y, x) > 3 THEN 1 ELSE 0 END AS s FROM g)),
 z AS (SELECT doc_id, page, count(*) AS glyphs, count(DISTINCT line) AS lines FROM l GROUP BY doc_id, page),
 e AS (SELECT doc_id, page, first_value(y) OVER w AS line_y, x + width AS f, lead(x) OVER w AS t FROM l WINDOW w AS (PARTITION BY doc_id, page, line ORDER BY x)),
 b AS (SELECT doc_id, page, floor(t / 10)::BIGINT AS bucket, count(*) AS n, trunc(avg(t))::INT AS split_x, min(line_y) AS y_start, max(line_y) AS y_end, min({{'a': line_y, 'b': t}}) AS first FROM e WHERE t - f >= 15 AND t BETWEEN 50 AND 450 GROUP BY doc_id, page, floor(t / 10)),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY n DESC, first) AS rn FROM b)
 SELECT r.doc_id, r.page, split_x, y_start, y_end FROM r JOIN z USING (doc_id, page) WHERE rn = 1 AND glyphs >= 20 AND lines >= 4 AND n >= greatest(4, floor(lines * 0.15))""")
def p4_column_bands(s: SparkSession, d: str) -> DataFrame:
    """Lines by step, gaps within them, the fullest bucket of gap ends, its band."""
    return layout.column_bands(_glyphs(s, d), 0, 500, 800)


@query("SELECT l_returnflag, list_sort(list(l_quantity::DOUBLE))[(count(*) // 2 + 1)::INT] AS median FROM lineitem GROUP BY l_returnflag")
def a7_upper_median(s: SparkSession, d: str) -> DataFrame:
    x = t(s, d, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("v"))
    return ranks.nth_value(x, "l_returnflag", "v", lambda n: F.floor(n / 2) + 1).select("l_returnflag", F.col("v").alias("median"))


@query("SELECT lang, list_sort(list(n_chars))[(floor(0.85 * (count(*) - 1) + 0.5) + 1)::INT]::BIGINT AS p85 FROM documents GROUP BY lang")
def a8_nearest_rank(s: SparkSession, d: str) -> DataFrame:
    x = t(s, d, "documents").select("lang", "n_chars")
    return ranks.nth_value(x, "lang", "n_chars", lambda n: F.floor(F.lit(0.85) * (n - 1) + 0.5) + 1).select("lang", F.col("n_chars").alias("p85"))


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def a10_ordered_text(s: SparkSession, d: str) -> DataFrame:
    part = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("p"))))
    return t(s, d, "conversations").groupBy("conv_id").agg(part.alias("x")).select("conv_id", F.array_join(F.transform("x", lambda v: v["p"]), "\n").alias("transcript"))


@query("SELECT doc_id, n_chars, (SELECT count(*) FROM documents WHERE lang = 'en') AS total FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 20")
def w1_page_with_total(s: SparkSession, d: str) -> DataFrame:
    """A page, and the total by an aggregation of its own instead of a one-partition window."""
    en = t(s, d, "documents").filter("lang = 'en'")
    total = en.agg(F.count(F.lit(1)).alias("total"))
    return catalog.page_of(en.select("doc_id", "n_chars").orderBy(F.col("n_chars").desc(), "doc_id"), [F.col("n_chars").desc(), "doc_id"], 1, 20).join(F.broadcast(total))  # one row


@query(f"WITH {LINES} SELECT doc_id, idx, string_agg(line, ' ') OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS window_text FROM lines")
def w3_sliding_windows(s: SparkSession, d: str) -> DataFrame:
    x = t(s, d, "documents").select("doc_id", F.split("text", "\n").alias("p"))
    return tx.unrolled(x, "doc_id", chunking.windows(F.col("p"), 2), "idx", "window_text")


@query("""WITH g AS (SELECT label, vec_id, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS nx, embedding FROM embeddings),
 dd AS (SELECT label, vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], nx::DOUBLE[]), 6) AS d FROM g),
 f AS (SELECT label, vec_id, sum(CASE WHEN pd > 1.0 THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING) AS segment FROM (SELECT *, lag(d) OVER (PARTITION BY label ORDER BY vec_id) AS pd FROM dd))
 SELECT label, segment::BIGINT AS segment, min(vec_id) AS first_id, count(*) AS n FROM f GROUP BY label, segment""")
def w4_w5_breakpoints(s: SparkSession, d: str) -> DataFrame:
    """Distance to the next row, a new segment after each one above the threshold; a label of any size is cut into ranges."""
    e = ranks.with_next(t(s, d, "embeddings").select("label", "vec_id", "embedding"), "label", "vec_id", {"embedding": "nx"})
    dist = F.round(F.lit(1.0) - vectors.cosine_similarity(F.col("embedding"), F.col("nx")), 6)
    x = e.select("label", "vec_id", F.coalesce((dist > 1.0).cast("int"), F.lit(0)).alias("ends"))
    x = ranks.running_before(x, "label", "vec_id", "ends").withColumnRenamed("before", "segment")
    return x.groupBy("label", "segment").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LINES}, p AS (SELECT doc_id, idx, line, regexp_replace(lag(line) OVER (PARTITION BY doc_id ORDER BY idx), '^\\s+|\\s+$', '', 'g') AS w0 FROM lines),
 q AS (SELECT *, CASE WHEN length(w0) <= 60 THEN w0 ELSE right(w0, 60) END AS win FROM p), r AS (SELECT *, length(regexp_extract(win, '^[^.?!]*[.?!]')) AS b FROM q)
 SELECT doc_id, idx, CASE WHEN t IS NULL OR t = '' THEN line ELSE t || ' ' || line END AS chunk FROM (SELECT doc_id, idx, line, CASE WHEN length(w0) <= 60 THEN w0 WHEN b > 0 AND b < length(win) THEN regexp_replace(substr(win, b + 1), '^\\s+|\\s+$', '', 'g') ELSE win END AS t FROM r)""")
def c3_overlap(s: SparkSession, d: str) -> DataFrame:
    """Each line led by the tail of the one before."""
    x = t(s, d, "documents").select("doc_id", F.split("text", "\n").alias("p"))
    return tx.unrolled(x, "doc_id", chunking.overlap(F.col("p"), 60), "idx", "chunk")


HEAD = r"length({0}) BETWEEN 3 AND 80 AND NOT regexp_matches({0}, '[.,;:]$') AND (regexp_matches(substr({0}, 1, 1), '^\p{{Lu}}') OR regexp_matches({0}, '^\d+(\.\d+)*\.?\s+[A-ZÀ-ÿ]'))"


@query(f"""WITH {LINES}, x AS (SELECT doc_id, idx, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS l, coalesce(regexp_replace(lag(line) OVER (PARTITION BY doc_id ORDER BY idx), '^\\s+|\\s+$', '', 'g'), '') AS p FROM lines)
 SELECT doc_id, idx, {HEAD.format('l')} AS could, ({HEAD.format('l')}) AND (p = '' OR (length(p) >= 20 AND regexp_matches(p, '[.!?]$'))) AS heading FROM x""")
def c14_c15_headings(s: SparkSession, d: str) -> DataFrame:
    """Lines that look like headings, alone and in their context."""
    o = Window.partitionBy("doc_id").orderBy("idx")
    x = lines_of(s, d).select("doc_id", "idx", tx.trim_ws(F.col("line")).alias("l"), F.lag("line").over(o).alias("p"))
    return x.select("doc_id", "idx", tx.could_be_heading(F.col("l")).alias("could"), tx.heading_in_context(F.col("l"), F.col("p")).alias("heading"))


@query("SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10) || chr(10)), '\\n{2,}'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '') AS paragraphs FROM documents")
def c16_paragraphs(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "documents").select("doc_id", tx.paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n\n"))).alias("paragraphs"))


def _markdown(s: SparkSession, d: str) -> DataFrame:
    """Lines under headings: the first line of a document at level 2, the others at level 3."""
    return t(s, d, "documents").select("doc_id", F.concat(F.lit("## "), F.replace("text", F.lit("\n"), F.lit("\n\n### "))).alias("markdown"))


@query(f"WITH {LINES} SELECT doc_id, count(*) AS n, sum(length(line) + CASE WHEN idx = 0 THEN 3 ELSE 4 END)::BIGINT AS chars FROM lines WHERE regexp_matches(line, '\\S') GROUP BY doc_id")
def c4_heading_split(s: SparkSession, d: str) -> DataFrame:
    """A segment per heading; their number and their length."""
    parts = F.filter(chunking.split_at_level(F.col("markdown"), 3), lambda x: ~x.rlike(r"^#+$"))
    x = _markdown(s, d).select("doc_id", F.explode_outer(parts).alias("c"))
    return x.filter("c IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("c")).alias("chars"))


@query()
def c7_c8_chunks(s: SparkSession, d: str) -> DataFrame:
    """Level choice, neighbouring levels, short segments merged."""
    x = chunking.split_headings(_markdown(s, d))
    return tx.unrolled(x, "doc_id", F.col("chunks"), "chunk_index", "content")


def _vocabulary() -> str | None:
    try:
        from public_tokenizers import path
    except ModuleNotFoundError:
        return None
    return path("byte_bpe_50k.json")


@query()
def c2_token_chunks(s: SparkSession, d: str) -> DataFrame:
    """C2 then C3 over whole texts, by a byte-pair vocabulary's tokens where its file is there."""
    x = t(s, d, "documents").select("doc_id", chunking.token_chunks(F.col("text"), 200, _vocabulary()).alias("c"))
    return tx.unrolled(x, "doc_id", chunking.overlap(F.col("c"), 200), "chunk_index", "content")


@query()
def c9_structural(s: SparkSession, d: str) -> DataFrame:
    """Headings or line heuristics, capped."""
    x = t(s, d, "documents").select("doc_id", F.lit("").alias("markdown"), F.array("text").alias("pages"))
    return tx.unrolled(chunking.split_structural(x, "ACADEMIC"), "doc_id", F.col("chunks"), "chunk_index", "content")


@query()
def c17_semantic(s: SparkSession, d: str) -> DataFrame:
    """Breaks where neighbouring windows' embeddings differ most."""
    x = t(s, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("markdown"))
    return tx.unrolled(chunking.split_semantic(x, "doc_id"), "doc_id", F.col("chunks"), "chunk_index", "content")


@query("SELECT doc_id, trim(regexp_replace(regexp_replace('# ' || text || ' *end*', '[#*`_~\\[\\]()!>]', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM documents")
def r1_strip_markdown(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "documents").select("doc_id", tx.strip_markdown(F.concat(F.lit("# "), "text", F.lit(" *end*"))).alias("plain"))


@query("SELECT doc_id, CASE WHEN length(x) <= 240 THEN x ELSE regexp_replace(substr(x, 1, 240), ' [^ ]*$', '') || '…' END AS excerpt FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') AS x FROM documents)")
def r10_excerpt(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "documents").select("doc_id", tx.excerpt(F.col("text")).alias("excerpt"))


@query()
def r2_lexemes(s: SparkSession, d: str) -> DataFrame:
    """R2: stems with positions, per document how many and how many distinct."""
    x = t(s, d, "documents").select("doc_id", analysis.to_lexemes(tx.strip_markdown(F.col("text"))).alias("l"))
    return x.select("doc_id", F.size("l").alias("n"), F.size(F.array_distinct(F.transform("l", lambda v: v["lexeme"]))).alias("n_distinct"))


@query()
def r7_lexical_search(s: SparkSession, d: str) -> DataFrame:
    """R3 to R7 with two words: match, cover density, headline."""
    c = t(s, d, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("id"), "text", analysis.to_lexemes(tx.strip_markdown(F.col("text"))).alias("lexemes"))
    top = search.lexical_leg(c, "thering ered", 20)
    page = t(s, d, "documents").select(F.col("doc_id").alias("id"), "text").join(F.broadcast(top), "id")  # twenty rows
    return page.select("rank", F.col("id").alias("doc_id"), F.round("score", 9).alias("score"), analysis.to_headline(F.col("text"), analysis.query_lexemes("thering ered")).alias("headline"))


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '([a-z0-9]+)', 1) AS l FROM documents WHERE lang = 'en')
 SELECT doc_id, len(list_filter(l, lambda x: x = 'the' OR x = 'ering'))::BIGINT AS hits FROM w WHERE list_contains(l, 'the') AND list_contains(l, 'ering')""")
def r4_index_match(s: SparkSession, d: str) -> DataFrame:
    """R4 by the part of an inverted index that the query needs, over words as they stand."""
    wanted = ["the", "ering"]
    return search.index_match(search.inverted_index(_plain_chunks(s, d), wanted), wanted).select(F.col("id").alias("doc_id"), "hits")


def _plain_chunks(s: SparkSession, d: str) -> DataFrame:
    """English texts as chunks whose lexemes are the words as they stand."""
    words = F.transform(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1), lambda w, i: F.struct(w.alias("lexeme"), i.alias("pos")))
    return t(s, d, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("id"), F.col("lang").alias("domain_id"), words.alias("lexemes"))


#: Minimal covers of two words: neighbouring hits of which one is the one and one the other.
COVERS = """w AS (SELECT doc_id, regexp_extract_all(lower(text), '([a-z0-9]+)', 1) AS l FROM documents WHERE lang = 'en'),
 o AS (SELECT doc_id, unnest(l) AS w, unnest(range(0, len(l))) AS p FROM w),
 c AS (SELECT doc_id, w, p, lag(w) OVER q AS pw, lag(p) OVER q AS pp FROM o WHERE w IN ('thering', 'ered') WINDOW q AS (PARTITION BY doc_id ORDER BY p)),
 x AS (SELECT doc_id, sum(CASE WHEN pw <> w THEN 0.1e0 / (1 + (p - pp) - 1) END) AS score FROM c GROUP BY doc_id HAVING count(DISTINCT w) = 2)"""


@query(f"WITH {COVERS} SELECT doc_id, rank::INT AS rank, round(score, 9) AS score FROM (SELECT doc_id, round(score, 9) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM x) WHERE rank <= 20")
def r7_two_words(s: SparkSession, d: str) -> DataFrame:
    """F7, R4, R5, R7 with two words as they stand: match of both, cover density, the best twenty."""
    wanted = ["thering", "ered"]
    c = _plain_chunks(s, d)
    hits = c.filter(analysis.matches(F.col("lexemes"), wanted)).select("id", F.round(analysis.rank_cd(F.col("lexemes"), wanted), 9).alias("score"))
    return search.top(hits, "score", "id", 20).select(F.col("id").alias("doc_id"), "rank", "score")


@query("SELECT item_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(a, '(\\d+)', 1), lambda x: try_cast(x AS INT)), lambda x: x IS NOT NULL AND x < 5))) AS passages FROM (SELECT item_id, '[' || (item_id % 7) || ', 3, -1, ' || (item_id % 4) || ', 3, 99] then 99999999999' AS a FROM benchmark)")
def r15_passage_numbers(s: SparkSession, d: str) -> DataFrame:
    """Passage numbers of an answer (sorted here, to compare as a set)."""
    a = F.concat(F.lit("["), (F.col("item_id") % 7).cast("string"), F.lit(", 3, -1, "), (F.col("item_id") % 4).cast("string"), F.lit(", 3, 99] then 99999999999"))
    return t(s, d, "benchmark").select("item_id", F.array_sort(tx.rerank_order(a, 5)).alias("passages"))


@query("SELECT n AS total, greatest(1, (n + 19) // 20)::BIGINT AS total_pages, 1 < greatest(1, (n + 19) // 20) AS has_next, false AS has_previous FROM (SELECT count(*) AS n FROM documents WHERE lang = 'es')")
def o7_page_facts(s: SparkSession, d: str) -> DataFrame:
    total = t(s, d, "documents").filter("lang = 'es'").count()
    facts = catalog.page_facts(total, 0, 20)
    return s.createDataFrame([(total, facts["total_pages"], facts["has_next"], facts["has_previous"])], "total long, total_pages long, has_next boolean, has_previous boolean")


@query(f"WITH {TAGS} SELECT row_number() OVER (ORDER BY sort_key, path)::INT AS place, path, depth::INT AS depth FROM (SELECT a.path, CASE WHEN p.path IS NULL THEN 0 ELSE 1 END AS depth, CASE WHEN p.path IS NULL THEN a.name ELSE p.name || chr(1) || a.name END AS sort_key FROM (SELECT * FROM tag WHERE path <> 'fr') a LEFT JOIN (SELECT * FROM tag WHERE path <> 'fr') p ON a.path <> p.path AND p.path = regexp_replace(a.path, '\\.[^.]*$', ''))")
def o8_h7_tag_tree(s: SparkSession, d: str) -> DataFrame:
    """Siblings by name; children of a tag that was filtered out are roots."""
    x = catalog.tag_tree(tags_of(s, d).filter("path <> 'fr'"))
    return x.select(F.row_number().over(Window.orderBy("sort_key", "path")).alias("place"), "path", "depth")


@query("SELECT id, count(*) AS legs FROM (SELECT doc_id AS id FROM documents WHERE lang = 'de' UNION ALL SELECT vec_id FROM embeddings WHERE label = 3) GROUP BY id HAVING count(*) = 2")
def u2_in_both(s: SparkSession, d: str) -> DataFrame:
    a = t(s, d, "documents").filter("lang = 'de'").select(F.col("doc_id").alias("id"))
    b = t(s, d, "embeddings").filter("label = 3").select(F.col("vec_id").alias("id"))
    return a.union(b).groupBy("id").agg(F.count(F.lit(1)).alias("legs")).filter("legs = 2")


@query("WITH c AS (SELECT DISTINCT lang || '.' || source || '.deep' AS path FROM documents), a AS (SELECT DISTINCT unnest([regexp_extract(path, '^[^.]*'), regexp_replace(path, '\\.[^.]*$', '')]) AS path FROM c) SELECT path, upper(left(l, 1)) || substr(l, 2) AS name FROM (SELECT path, replace(regexp_replace(path, '^.*\\.', ''), '_', ' ') AS l FROM a)")
def h5_missing_ancestors(s: SparkSession, d: str) -> DataFrame:
    rows = t(s, d, "documents").select(F.lit("all").alias("domain_id"), F.concat_ws(".", "lang", "source", F.lit("deep")).alias("path")).distinct()
    none = rows.filter("false")
    return catalog.missing_ancestors(none, rows).select("path", "name")


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(regexp_replace(p_type, '^\\s+|\\s+$', '', 'g')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, position('.' IN p_type) = 0 AS is_root, regexp_replace(p_brand, '^.*\\.', '') AS leaf FROM part")
def h6_slugs(s: SparkSession, d: str) -> DataFrame:
    """H4, H6, H10."""
    return t(s, d, "part").select("p_partkey", tx.slug(F.col("p_type")).alias("slug"), paths.is_root(F.col("p_type")).alias("is_root"), paths.leaf(F.col("p_brand")).alias("leaf"))


@query("SELECT 'customer' AS tab, count(*) AS n FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT 'supplier', count(*) FROM supplier WHERE s_nationkey <> 3 UNION ALL SELECT 'nation', count(*) FROM nation WHERE n_nationkey <> 3")
def m1_cascade_delete(s: SparkSession, d: str) -> DataFrame:
    """M1: a domain goes with all that hangs from it."""
    tabs = {
        "domain": t(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("id")),
        "document": t(s, d, "supplier").select(F.col("s_nationkey").cast("string").alias("domain_id")),
        "chunk": t(s, d, "customer").select(F.col("c_nationkey").cast("string").alias("domain_id")),
    }
    left, names = catalog.delete_domain(tabs, "3"), {"domain": "nation", "document": "supplier", "chunk": "customer"}
    one = [left[k].agg(F.count(F.lit(1)).alias("n")).select(F.lit(v).alias("tab"), "n") for k, v in names.items()]
    return one[0].union(one[1]).union(one[2])


@query("SELECT doc_id, CASE WHEN doc_id = 7 THEN ['x.y'] ELSE [lang] END AS tags, CASE WHEN doc_id = 7 THEN 'FAILED' ELSE 'PENDING' END AS ingestion_status FROM documents")
def m4_m5_updates(s: SparkSession, d: str) -> DataFrame:
    """M4, M5: one row changes, the others stay."""
    docs = t(s, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.array("lang").alias("tags"), F.lit("PENDING").alias("ingestion_status"), F.lit("e").alias("ingestion_error"), F.lit(None).cast("timestamp").alias("ingested_at"))
    chunk = docs.select(F.col("id").alias("document_id"), F.col("tags").alias("tag_paths"))
    out = catalog.set_document_tags({"document": docs, "chunk": chunk}, "7", ["x.y"])
    return catalog.set_status(out["document"], "7", "FAILED").select(F.col("id").cast("long").alias("doc_id"), "tags", "ingestion_status")


@query(f"WITH {LINES} SELECT doc_id, idx, u <> '' AND (regexp_matches(u, '^\\d{{1,4}}$') OR regexp_matches(u, '(?i)\\.indd|fogra') OR regexp_matches(u, '(?i)\\b(dtp|page):\\d+\\b') OR regexp_matches(u, '(?i)^chapter\\s+\\d+\\b')) AS furniture FROM (SELECT doc_id, idx, CASE idx WHEN 0 THEN doc_id::VARCHAR WHEN 1 THEN 'Chapter ' || doc_id || ' x' WHEN 2 THEN 'see page:' || doc_id ELSE regexp_replace(line, '^\\s+|\\s+$', '', 'g') END AS u FROM lines)")
def p6_furniture(s: SparkSession, d: str) -> DataFrame:
    u = F.when(F.col("idx") == 0, F.col("doc_id").cast("string")).when(F.col("idx") == 1, F.concat(F.lit("Chapter "), "doc_id", F.lit(" x"))).when(F.col("idx") == 2, F.concat(F.lit("see page:"), "doc_id")).otherwise(F.col("line"))
    return lines_of(s, d).select("doc_id", "idx", tx.is_page_furniture(u).alias("furniture"))


@query("""WITH x AS (SELECT l_orderkey AS doc_id, l_linenumber::INT AS section_no, (l_orderkey % 5 + l_linenumber)::INT AS page, (l_partkey % 700)::INT AS position FROM lineitem),
 n AS (SELECT *, lead(page) OVER w AS tp, coalesce(lead(position) OVER w, 0) AS q FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY section_no, page, position)),
 p AS (SELECT doc_id, section_no, page AS first, CASE WHEN tp >= page THEN tp ELSE page END AS last, position, q FROM n WHERE page >= 1),
 e AS (SELECT *, (unnest(range(first, last + 1)))::INT AS page FROM p)
 SELECT doc_id, section_no, page, CASE WHEN page = last THEN q ELSE 0 END AS y, h FROM (SELECT *, greatest(CASE WHEN page = first AND page = last THEN position - q WHEN page = first THEN position WHEN page = last THEN 800 - q ELSE 800 END, 0) AS h FROM e) WHERE h > 0""")
def p2_section_ranges(s: SparkSession, d: str) -> DataFrame:
    """What each section covers of each page."""
    li = t(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("section_no"), (F.col("l_orderkey") % 5 + F.col("l_linenumber")).cast("int").alias("page"), (F.col("l_partkey") % 700).cast("int").alias("position"))
    return layout.section_ranges(li, 800)


@query("""WITH x AS (SELECT doc_id, (unnest(range(0, len(l))))::INT AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
 z AS (SELECT doc_id, i, line, CASE WHEN i % 5 = 0 THEN 20.0 WHEN i % 7 = 1 THEN 15.0 ELSE 10.0 END::DOUBLE AS f FROM x),
 m AS (SELECT doc_id, list_sort(list(f))[(count(*) // 2 + 1)::INT] AS med FROM z GROUP BY doc_id)
 SELECT doc_id, regexp_replace(string_agg(CASE WHEN f / med > 1.8 THEN chr(10) || chr(10) || '# ' || line || chr(10) || chr(10) WHEN f / med > 1.4 THEN chr(10) || chr(10) || '## ' || line || chr(10) || chr(10) WHEN f / med > 1.15 THEN chr(10) || chr(10) || '### ' || line || chr(10) || chr(10) ELSE line || chr(10) END, '' ORDER BY i), '^\\s+|\\s+$', '', 'g') AS markdown FROM z JOIN m USING (doc_id) GROUP BY doc_id""")
def p8_font_headings(s: SparkSession, d: str) -> DataFrame:
    size = F.when(F.col("idx") % 5 == 0, 20.0).when(F.col("idx") % 7 == 1, 15.0).otherwise(10.0)
    x = lines_of(s, d).select("doc_id", F.col("idx").alias("line_no"), F.col("line").alias("text"), size.alias("font_size"), F.lit(False).alias("starts_paragraph"))
    return layout.font_markdown(x)


#: A page without what isn't shown, and the entities of what is.
SHOWN = "regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<(head|script|style|nav|aside|footer|figure)\\b[^>]*>.*?</(head|script|style|nav|aside|footer|figure)>', '', 'g')"
BLOCKS = "address|article|aside|blockquote|details|div|dl|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|main|nav|ol|p|pre|section|table|ul|br|li|tr|td|th"


def _spelt(x: str) -> str:
    """SQL for text with its other tags gone, entities spelt and white space collapsed."""
    x = f"regexp_replace({x}, '<[!/a-zA-Z][^>]*>', '', 'g')"
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "\'\'"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{sign}')"
    return f"regexp_replace({x}, '\\s+', ' ', 'g')"


T1_PARTS = _spelt("regexp_replace(regexp_replace(regexp_replace(" + SHOWN + ", '<h1>', chr(1) || '# ', 'g'), '<br>', ' ', 'g'), '</?(p|h1|div|article|body|html)\\b[^>]*>', chr(1), 'g')")


@query(f"SELECT page_id, array_to_string(list_filter(list_transform(string_split({T1_PARTS}, chr(1)), lambda x: trim(x)), lambda x: x <> ''), chr(10) || chr(10)) AS markdown FROM pages")
def t1_html_markdown(s: SparkSession, d: str) -> DataFrame:
    """T1 to T3 over whole pages."""
    return t(s, d, "pages").select("page_id", markup.to_markdown(F.col("html")).alias("markdown"))


S12_TEXT = _spelt("regexp_replace(" + SHOWN + ", '(?i)</?(" + BLOCKS + ")\\b[^>]*>', ' ', 'g')")


@query(f"SELECT page_id, trim({S12_TEXT}) AS text FROM pages")
def s12_plain_text(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "pages").select("page_id", markup.to_text(F.col("html")).alias("text"))


@query("SELECT n_nationkey, n_name <> '' AND reverse(lower(n_name) || reverse(lower(n_name))) = lower(n_name) || reverse(lower(n_name)) AS mirrored, reverse(n_name) = n_name AND n_name <> '' AS palindrome FROM nation")
def scalar_palindrome(s: SparkSession, d: str) -> DataFrame:
    low = F.lower("n_name")
    return t(s, d, "nation").select("n_nationkey", tx.is_palindrome(F.concat(low, F.reverse(low))).alias("mirrored"), tx.is_palindrome(F.col("n_name")).alias("palindrome"))


@query("SELECT doc_id, regexp_replace(regexp_replace(replace(text, chr(10), repeat(chr(10), 4)), '^\\s+|\\s+$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g') AS collapsed FROM documents")
def t3_collapse(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "documents").select("doc_id", tx.collapse_blank(F.replace("text", F.lit("\n"), F.lit("\n\n\n\n"))).alias("collapsed"))


# the operators' own functions, each reached by an entry of its own

STOPS = ", ".join(f"'{w}'" for w in sorted(analysis.STOP))
PLAIN = "trim(regexp_replace(regexp_replace(text, '[#*`_~\\[\\]()!>]', ' ', 'g'), '\\s+', ' ', 'g'))"
#: Words with their places, stop words counted; ``th`` and ``nd`` are their own stems and no other word's.
PLACES = f"""w AS (SELECT doc_id, lang, regexp_extract_all(lower({PLAIN}), '[\\p{{L}}\\p{{N}}]+') AS l FROM documents),
 o AS (SELECT doc_id, lang, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS p FROM w)"""


@query(f"WITH {PLACES} SELECT doc_id, count(*) AS n, sum(p)::BIGINT AS places, max(p)::BIGINT AS last FROM o WHERE w NOT IN ({STOPS}) GROUP BY doc_id")
def r2_positions(s: SparkSession, d: str) -> DataFrame:
    """R2: how many lexemes, and where: stop words are left out and keep their places."""
    x = t(s, d, "documents").select("doc_id", F.explode_outer(analysis.to_lexemes(tx.strip_markdown(F.col("text")))).alias("l")).filter("l IS NOT NULL")
    return x.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("l.pos").alias("places"), F.max("l.pos").cast("long").alias("last"))


def _chunks(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(chunk, document): a text a chunk, with its analysed words and the embedding of its id."""
    docs = t(s, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "doc_id", "text", "lang", "source")
    # one row an id, which the plan must know: what doesn't read embeddings then needs no join, and no text is shuffled
    e = t(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding").dropDuplicates(["doc_id"])
    chunk = docs.join(e, "doc_id", "left").select(
        "id", F.col("id").alias("document_id"), F.col("lang").alias("domain_id"), F.array(F.concat_ws(".", "lang", "source")).alias("tag_paths"), F.col("text").alias("content"), "embedding",
        F.lit(0).alias("chunk_index"), F.lit("TOKEN").alias("chunk_strategy"), analysis.to_lexemes(tx.strip_markdown(F.col("text"))).alias("lexemes"),
    )
    return chunk, docs.select("id", F.concat(F.lit("Title "), "id").alias("title"), F.col("source").alias("author"))


def _shown(page: DataFrame) -> DataFrame:
    return page.select("rank", "chunk_id", F.round("score", 9).alias("score"), "document_title", "document_author", "search_type")


TWO_WORDS = f"""{PLACES}, c AS (SELECT doc_id, w, p, lag(w) OVER q AS pw, lag(p) OVER q AS pp FROM o WHERE w IN ('th', 'nd') AND lang = 'en' WINDOW q AS (PARTITION BY doc_id ORDER BY p)),
 x AS (SELECT doc_id::VARCHAR AS id, sum(CASE WHEN pw <> w THEN 0.1e0 / (1 + (p - pp) - 1) END) AS score FROM c GROUP BY doc_id HAVING count(DISTINCT w) = 2)"""


@query(f"WITH {TWO_WORDS} SELECT count(*) AS total, greatest(1, (count(*) + 19) // 20)::BIGINT AS total_pages, count(*) > 40 AS has_next, true AS has_previous FROM x")
def r7_total(s: SparkSession, d: str) -> DataFrame:
    """How many texts hold both words, and what a second page has around it."""
    p = search.lexical_search(*_chunks(s, d), "th nd", "en", size=20, page=1)
    return s.createDataFrame([(p.total, p.total_pages, p.has_next, p.has_previous)], "total long, total_pages long, has_next boolean, has_previous boolean")


@query(f"WITH {TWO_WORDS} SELECT count(*) AS n, round(sum(score), 6) AS scores FROM x")
def r5_cover_density(s: SparkSession, d: str) -> DataFrame:
    """R5 over all texts that hold both words."""
    wanted = analysis.query_lexemes("th nd")
    c = _chunks(s, d)[0].filter("domain_id = 'en'").filter(analysis.matches(F.col("lexemes"), wanted))
    return c.select(analysis.rank_cd(F.col("lexemes"), wanted).alias("x")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 6).alias("scores"))


HEADLINE = """hw AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents WHERE lang = 'en'),
 h AS (SELECT doc_id, w, len(w) AS n, list_transform(w, lambda x: CASE WHEN list_has_any(regexp_extract_all(lower(x), '[\\p{L}\\p{N}]+'), ['th', 'nd']) THEN 1 ELSE 0 END) AS h FROM hw),
 hc AS (SELECT *, list_transform(range(0, greatest(1, n - 34)), lambda i: coalesce(list_sum(h[i + 1:i + 35]), 0)::INT) AS inside FROM h),
 hb AS (SELECT *, list_position(inside, list_max(inside)) - 1 AS at0 FROM hc),
 he AS (SELECT *, least(n, at0 + 35) AS stop FROM hb), f AS (SELECT *, greatest(0, least(at0, stop - 15)) AS a1 FROM he)"""


@query(f"WITH {HEADLINE} SELECT doc_id, array_to_string(list_transform(w[a1 + 1:stop], lambda x, i: CASE WHEN h[a1 + i] = 1 THEN '<b>' || x || '</b>' ELSE x END), ' ') AS headline FROM f")
def r6_headline(s: SparkSession, d: str) -> DataFrame:
    """Of each text the window with the most words of the query, those in bold."""
    docs = t(s, d, "documents").filter("lang = 'en'")
    return docs.select("doc_id", analysis.to_headline(F.col("text"), analysis.query_lexemes("th nd")).alias("headline"))


HYBRID = f"""{PLACES}, lex AS (SELECT doc_id, id, row_number() OVER (ORDER BY score DESC, id) AS r FROM (SELECT doc_id, doc_id::VARCHAR AS id, 0.1e0 * count(*) AS score FROM o WHERE w = 'th' AND lang = 'en' GROUP BY doc_id)),
 vec AS (SELECT id, row_number() OVER (ORDER BY sim DESC, id) AS r FROM (SELECT e.vec_id::VARCHAR AS id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS sim
         FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id, embeddings q WHERE q.vec_id = 0 AND d.lang = 'en')),
 f AS (SELECT id, sum(1e0 / (60 + r)) AS score, min(CASE WHEN leg = 0 THEN r END) AS lex_rank, min(CASE WHEN leg = 1 THEN r END) AS vec_rank
       FROM (SELECT id, r, 0 AS leg FROM lex WHERE r <= 50 UNION ALL SELECT id, r, 1 FROM vec WHERE r <= 50) GROUP BY id),
 page AS (SELECT (row_number() OVER (ORDER BY score DESC, lex_rank NULLS LAST, vec_rank NULLS LAST))::INT AS rank, id AS chunk_id, round(score, 9) AS score,
   CASE WHEN lex_rank IS NOT NULL AND vec_rank IS NOT NULL THEN 'BOTH' WHEN vec_rank IS NOT NULL THEN 'EMBEDDING' ELSE 'LEXICAL' END AS search_type FROM f)"""


@query(f"WITH {HYBRID} SELECT rank, chunk_id, score, 'Title ' || chunk_id AS document_title, d.source AS document_author, search_type FROM page JOIN documents d ON d.doc_id::VARCHAR = chunk_id WHERE rank BETWEEN 21 AND 40")
def r12_second_page(s: SparkSession, d: str) -> DataFrame:
    """The search itself; its second page, hydrated."""
    return _shown(search.search_page(*_chunks(s, d), "th", lambda _: _query_vector(s, d), "en", ["en", " "], 20, 1).results)


@query(f"WITH {HYBRID} SELECT rank, chunk_id, 'Title ' || chunk_id AS document_title FROM page WHERE rank IN (1, 2, 3, 4, 5)")
def r16_sources(s: SparkSession, d: str) -> DataFrame:
    """R16 with a canned model: the passages that an answer cites."""
    got = answers.rag_answer(*_chunks(s, d), "th", lambda _: _query_vector(s, d), "en", answers.canned_chat)
    return s.createDataFrame([(r["rank"], r["chunk_id"], r["document_title"]) for r in got["sources"]], "rank int, chunk_id string, document_title string")


@query(f"""WITH {TWO_WORDS}, {HEADLINE},
 best AS (SELECT id::BIGINT AS doc_id, round(score, 9) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, id::BIGINT) AS rank FROM x)
 SELECT rank::INT AS rank, doc_id, score, array_to_string(list_transform(f.w[a1 + 1:stop], lambda x, i: CASE WHEN h[a1 + i] = 1 THEN '<b>' || x || '</b>' ELSE x END), ' ') AS headline FROM best JOIN f USING (doc_id) WHERE rank <= 20""")
def r7_ranked(s: SparkSession, d: str) -> DataFrame:
    """Analysed texts that hold both words, by cover density, the best twenty with their headlines."""
    wanted = analysis.query_lexemes("th nd")
    docs = t(s, d, "documents").filter("lang = 'en'")
    c = docs.select(F.col("doc_id").alias("id"), analysis.to_lexemes(tx.strip_markdown(F.col("text"))).alias("lexemes"))
    hits = c.filter(analysis.matches(F.col("lexemes"), wanted)).select("id", F.round(analysis.rank_cd(F.col("lexemes"), wanted), 9).alias("score"))
    page = F.broadcast(search.top(hits, "score", "id", 20))  # twenty rows
    shown = docs.select(F.col("doc_id").alias("id"), "text").join(page, "id")
    return shown.select("rank", F.col("id").alias("doc_id"), "score", analysis.to_headline(F.col("text"), wanted).alias("headline"))


@query("SELECT count(*) AS n, count(DISTINCT doc_id) AS ids FROM (SELECT doc_id FROM documents WHERE lang = 'fr' LIMIT 20)")
def o4_slice(s: SparkSession, d: str) -> DataFrame:
    """An unordered page; any twenty rows will do, so they are counted."""
    return t(s, d, "documents").filter("lang = 'fr'").select("doc_id").limit(20).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids"))


@query("SELECT n_name, (n_nationkey + 1)::INT AS place FROM nation WHERE n_nationkey < 7 UNION ALL SELECT r_name, (7 + r_regionkey + 1)::INT FROM region WHERE r_regionkey < 2")
def r14_rerank(s: SparkSession, d: str) -> DataFrame:
    """A model names some passages first, those it leaves out follow, the best nine are taken."""
    region = [r["r_name"] for r in t(s, d, "region").orderBy("r_regionkey").collect()]  # two small tables as passages
    nation = [r["n_name"] for r in t(s, d, "nation").orderBy("n_nationkey").collect()]
    first = list(range(len(region), len(region) + 7))
    got = answers.rerank("q", region + nation, 9, str, lambda a, b: f"passages {first}, then 99999999999 and {first[0]}")
    return s.createDataFrame([(x, i) for i, x in enumerate(got, 1)], "n_name string, place int")


@query("SELECT a.vec_id AS a, round(CASE WHEN na = 0 OR nb = 0 THEN 0 ELSE dot / (sqrt(na) * sqrt(nb)) END, 6) AS similarity FROM (SELECT a.vec_id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1] * x[2])::DOUBLE)) AS dot, list_sum(list_transform(a.embedding, lambda x: (x * x)::DOUBLE)) AS na, list_sum(list_transform(b.embedding, lambda x: (x * x)::DOUBLE)) AS nb FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) a")
def r18_float_cosine(s: SparkSession, d: str) -> DataFrame:
    """Products in single precision, sums in double."""
    e = t(s, d, "embeddings").select("vec_id", "embedding")
    o = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("o"))
    return e.join(o, "vec_id").select(F.col("vec_id").alias("a"), F.round(vectors.cosine_similarity(F.col("embedding"), F.col("o"), "float"), 6).alias("similarity"))


def _documents(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """Documents and their lines as chunks."""
    docs = t(s, d, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("domain_id"), F.col("source").alias("title"), F.lit("me").alias("author"), F.lit("p").alias("source_path"),
        F.array("lang").alias("tags"), F.lit("COMPLETED").alias("ingestion_status"), F.lit("e").alias("ingestion_error"), F.current_timestamp().alias("ingested_at"),
    )
    x = lines_of(s, d).select(F.concat_ws("-", "doc_id", "idx").alias("id"), F.col("doc_id").cast("string").alias("document_id"), F.col("idx").alias("chunk_index"))
    return {"document": docs, "chunk": x.join(docs.select(F.col("id").alias("document_id"), "domain_id"), "document_id")}


@query("SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id = 5 THEN 'New' ELSE source END AS title, CASE WHEN doc_id = 5 THEN NULL ELSE 'me' END AS author, CASE WHEN doc_id = 5 THEN '/x' ELSE 'p' END AS source_path FROM documents")
def m3_update(s: SparkSession, d: str) -> DataFrame:
    return catalog.update(_documents(s, d)["document"], "5", title="New", author=None, source_path="/x").select("id", "title", "author", "source_path")


@query(f"WITH {TAGS} SELECT path, CASE WHEN path = 'en' THEN 'English' ELSE name END AS name, CASE WHEN path = 'en' THEN 'all of it' ELSE '' END AS description FROM tag")
def h9_update_tag(s: SparkSession, d: str) -> DataFrame:
    return catalog.update(tags_of(s, d), "en", name="English", description="all of it").select("path", "name", "description")


@query(f"WITH {LINES} SELECT doc_id::VARCHAR AS document_id, count(*) AS n FROM lines WHERE doc_id <> 11 GROUP BY doc_id")
def m6_delete_document(s: SparkSession, d: str) -> DataFrame:
    """M6: a document and its chunks go; what is left, counted."""
    left = catalog.delete_document(_documents(s, d), "11")
    return left["document"].select(F.col("id").alias("document_id")).join(left["chunk"], "document_id", "left").groupBy("document_id").agg(F.count("id").alias("n"))


@query(f"WITH {LINES} SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id = 11 THEN 'PENDING' ELSE 'COMPLETED' END AS ingestion_status, CASE WHEN doc_id = 11 THEN NULL ELSE 'e' END AS ingestion_error, sum(CASE WHEN doc_id = 11 THEN 0 ELSE 1 END)::BIGINT AS chunks FROM lines GROUP BY doc_id")
def m7_reset(s: SparkSession, d: str) -> DataFrame:
    """M7, M5: a document taken in again loses its chunks and its status."""
    r = catalog.reset_for_ingest(_documents(s, d), "11")
    n = r["chunk"].groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("chunks"))
    return r["document"].join(n, "id", "left").select("id", "ingestion_status", "ingestion_error", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query("SELECT '11-0' AS id")
def m9_first_chunk(s: SparkSession, d: str) -> DataFrame:
    return catalog.first_chunk(_documents(s, d)["chunk"], "11")


@query("SELECT sha256(lang || chr(1) || doc_id || '.Epub') AS id, doc_id || '.Epub' AS title, doc_id || '.Epub' AS source_filename, 'EPUB' AS source_type, 'PENDING' AS ingestion_status FROM documents")
def m2_import(s: SparkSession, d: str) -> DataFrame:
    """M2, P0f: uploads as pending documents, named after their files."""
    up = t(s, d, "documents").select(F.col("lang").alias("domain_id"), F.concat(F.lit(" "), F.col("doc_id").cast("string"), F.lit(".Epub ")).alias("source_filename"), F.lit(" ").alias("title"))
    return catalog.new_document(up).select("id", "title", "source_filename", "source_type", "ingestion_status")


@query(f"WITH {TAGS} SELECT path FROM tag WHERE path <> 'en.src1'")
def h8_delete_tag(s: SparkSession, d: str) -> DataFrame:
    """H8: a tag without tags below it goes; one with some is refused."""
    g = tags_of(s, d)
    try:
        catalog.delete_tag(g, "en")
    except ValueError:
        return catalog.delete_tag(g, "en.src1").select("path")
    raise AssertionError("a tag with tags below it was deleted")


@query("SELECT n_nationkey::VARCHAR AS id, n_name AS name FROM nation ORDER BY n_name, id LIMIT 1")
def o10_default_domain(s: SparkSession, d: str) -> DataFrame:
    return catalog.default_domain(t(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name")))


@query(f"WITH {LINES} SELECT l.line AS content, p.idx AS previous, n.idx AS next FROM lines l LEFT JOIN lines p ON p.doc_id = 11 AND p.idx = 0 LEFT JOIN lines n ON n.doc_id = 11 AND n.idx = 2 WHERE l.doc_id = 11 AND l.idx = 1")
def chunk_detail(s: SparkSession, d: str) -> DataFrame:
    """The page of one chunk: its text and the chunks beside it."""
    x = lines_of(s, d).select(F.concat_ws("-", "doc_id", "idx").alias("id"), F.col("doc_id").cast("string").alias("document_id"), F.col("idx").alias("chunk_index"), F.col("line").alias("content"))
    got = search.chunk_detail(x, _documents(s, d)["document"], "11-1")
    place = lambda c: F.substring_index(c, "-", -1).cast("int")
    return got.select("content", place("previous_id").alias("previous"), place("next_id").alias("next"))


@query("SELECT page_id, url AS path, strlen(html)::BIGINT AS bytes, 'application/pdf' AS media_type FROM pages WHERE page_id = 17")
def s15_serve(s: SparkSession, d: str) -> DataFrame:
    """A stored file by its document's id."""
    from ..sources import archive

    p = t(s, d, "pages")
    doc = p.select(F.col("page_id").cast("string").alias("id"), F.col("url").alias("source_path"), F.lit("PDF").alias("source_type"))
    got = archive.serve(doc, p.select(F.col("url").alias("path"), F.encode("html", "utf-8").alias("content")), "17")
    return got.select(F.lit(17).cast("long").alias("page_id"), "path", F.octet_length("content").cast("long").alias("bytes"), "media_type")


# layout

SECTIONS = """s AS (SELECT doc_id, (i // 5)::INT AS section_no, (i // 5 % 3)::INT AS level, i, CASE i % 5 WHEN 0 THEN 'Some Running Head ' || doc_id WHEN 1 THEN (i + 1)::VARCHAR ELSE line END AS raw
 FROM (SELECT doc_id, (unnest(range(0, len(l))))::INT AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"""
#: Lines as they stay: no furniture, no line that three sections and a third of them share.
CLEANED = f"""{SECTIONS}, u AS (SELECT *, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS t FROM s),
 k AS (SELECT *, regexp_replace(regexp_replace(t, ' {{2,}}', ' ', 'g'), ' \\d{{1,4}}$', '') AS bare, regexp_replace(t, ' {{2,}}', ' ', 'g') AS one FROM u),
 h AS (SELECT *, {HEADER_KEY} AS key FROM k),
 r AS (SELECT doc_id, key FROM (SELECT DISTINCT doc_id, section_no, key FROM h WHERE key <> '' AND length(key) <= 60) JOIN (SELECT doc_id, count(DISTINCT section_no) AS n FROM s GROUP BY doc_id) USING (doc_id)
   GROUP BY doc_id, key, n HAVING count(*) >= greatest(n * 0.3, 3.0)),
 f AS (SELECT * FROM h WHERE NOT (t <> '' AND (regexp_matches(t, '^\\d{{1,4}}$') OR regexp_matches(t, '(?i)\\.indd|fogra') OR regexp_matches(t, '(?i)\\b(dtp|page):\\d+\\b') OR regexp_matches(t, '(?i)^chapter\\s+\\d+\\b')))
   AND NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = h.doc_id AND r.key = h.key)),
 b AS (SELECT doc_id, section_no, regexp_replace(string_agg(regexp_replace(regexp_replace(raw, ' {{2,}}', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), chr(10) ORDER BY i), '^\\s+|\\s+$', '', 'g') AS body FROM f GROUP BY doc_id, section_no),
 a AS (SELECT DISTINCT doc_id, section_no, level, 'S' || section_no AS title FROM s),
 c AS (SELECT a.*, coalesce(b.body, '') AS body FROM a LEFT JOIN b USING (doc_id, section_no))"""


def _sections(s: SparkSession, d: str) -> DataFrame:
    """Five lines a section: a running head, a page number, three lines of text."""
    i = F.col("idx")
    raw = F.when(i % 5 == 0, F.concat(F.lit("Some Running Head "), "doc_id")).when(i % 5 == 1, (i + 1).cast("string")).otherwise(F.col("line"))
    x = lines_of(s, d).select("doc_id", F.floor(i / 5).cast("int").alias("section_no"), "idx", raw.alias("raw"))
    g = x.groupBy("doc_id", "section_no").agg(F.array_sort(F.collect_list(F.struct("idx", "raw"))).alias("x"))
    return g.select("doc_id", "section_no", (F.col("section_no") % 3).alias("level"), F.concat(F.lit("S"), "section_no").alias("title"), F.array_join(F.transform("x", lambda v: v["raw"]), "\n").alias("body"))


@query(f"WITH {CLEANED} SELECT doc_id, section_no, body FROM c")
def p5_clean_sections(s: SparkSession, d: str) -> DataFrame:
    """Bodies without furniture and running heads."""
    return layout.clean_sections(_sections(s, d)).select("doc_id", "section_no", "body")


@query(f"WITH {CLEANED} SELECT doc_id, string_agg(repeat('#', least(level + 2, 6)::INT) || ' ' || title || CASE WHEN body = '' THEN '' ELSE chr(10) || chr(10) || body END, chr(10) || chr(10) ORDER BY section_no) AS markdown FROM c GROUP BY doc_id")
def p1_outline(s: SparkSession, d: str) -> DataFrame:
    """Sections under their titles as one markdown text."""
    return layout.outline_markdown(_sections(s, d))


@query(f"""WITH {GLYPHS}, bands AS (SELECT doc_id, page, 210 AS split_x, 60.0 AS y_start, 240.0 AS y_end FROM (SELECT DISTINCT doc_id, page FROM g) WHERE doc_id % 2 = 0),
 l AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, page ORDER BY y, x ROWS UNBOUNDED PRECEDING) AS line FROM (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY doc_id, page ORDER BY y, x) > 3 THEN 1 ELSE 0 END AS s FROM g)),
 p AS (SELECT l.*, CASE WHEN split_x IS NULL THEN 0 WHEN y BETWEEN y_start - 8 AND y_end + 8 AND x < split_x THEN 1 WHEN y BETWEEN y_start - 8 AND y_end + 8 THEN 2 WHEN y > y_end THEN 3 ELSE 0 END AS part FROM l LEFT JOIN bands USING (doc_id, page))
 SELECT doc_id, page, x, y, part::INT AS part, (row_number() OVER (PARTITION BY doc_id, page ORDER BY part, line, x))::INT AS reading FROM p""")
def p3_reading_order(s: SparkSession, d: str) -> DataFrame:
    """Inside a page's band the left column is read before the right one."""
    g = _glyphs(s, d)
    bands = g.select("doc_id", "page").distinct().filter("doc_id % 2 = 0").select("doc_id", "page", F.lit(210).alias("split_x"), F.lit(60.0).alias("y_start"), F.lit(240.0).alias("y_end"))
    return layout.reading_order(g, bands).select("doc_id", "page", "x", "y", "part", "reading")


# chunking

def merged(parts: str, least: int) -> str:
    """SQL for a list of segments where one shorter than ``least`` takes the next; chr(1) parts those that stay."""
    tail = "regexp_replace(regexp_extract(a, '[^\\x01]*$'), '^\\s+|\\s+$', '', 'g')"
    return f"string_split(list_reduce({parts}, lambda a, x: CASE WHEN length({tail}) < {least} THEN a || chr(10) || chr(10) || x ELSE a || chr(1) || x END), chr(1))"


@query(f"""WITH h AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i = 1 THEN '## ' ELSE '### ' END || x) AS l FROM documents),
 n AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(array_to_string(list_transform(l, lambda x: CASE WHEN regexp_matches(regexp_replace(x, '\\s+$', ''), '^#+ .') THEN chr(2) ELSE '' END || x), chr(10) || chr(10)), '^\\x02', ''), chr(2)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS p FROM h),
 m AS (SELECT doc_id, {merged('p', 200)} AS c FROM n)
 SELECT doc_id, (unnest(range(0, len(c))))::INT AS chunk_index, unnest(c) AS content FROM m""")
def c8_merged_headings(s: SparkSession, d: str) -> DataFrame:
    """The neighbouring level that gives more, short segments merged."""
    return c7_c8_chunks(s, d)


RECIPES = "'## Dish ' || p_partkey || chr(10) || '### Ingredients' || chr(10) || p_name || chr(10) || '### Method' || chr(10) || p_type || ' ' || {0}"


@query(f"SELECT p_partkey, i::INT AS chunk_index, {RECIPES.format('i')} AS content FROM part, range(0, 3) r(i)")
def c5_c6_recipes(s: SparkSession, d: str) -> DataFrame:
    """Headings that only part a recipe don't part chunks, and the level above the first of them does."""
    one = lambda i: F.concat(F.lit("## Dish "), F.col("p_partkey").cast("string"), F.lit("\n### Ingredients\n"), "p_name", F.lit("\n### Method\n"), "p_type", F.lit(f" {i}"))
    part = t(s, d, "part").select("p_partkey", "p_name", "p_type")
    part = part.repartition(4 * s.sparkContext.defaultParallelism, "p_partkey")  # a small file of many rows is one task, and a row's split takes longer than its way
    x = part.select("p_partkey", F.concat_ws("\n", *[one(i) for i in range(3)]).alias("markdown"))
    return tx.unrolled(chunking.split_headings(x, preferred=4, min_chars=5, excluded=("ingredients", "method")), "p_partkey", F.col("chunks"), "chunk_index", "content")


@query(f"""WITH {LINES.replace('FROM documents)', "FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM documents))")},
 x AS (SELECT doc_id, idx, line, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS l, coalesce(regexp_replace(lag(line) OVER (PARTITION BY doc_id ORDER BY idx), '^\\s+|\\s+$', '', 'g'), '') AS p FROM lines),
 h AS (SELECT doc_id, idx, line, idx > 0 AND ({HEAD.format('l')}) AND (p = '' OR (length(p) >= 20 AND regexp_matches(p, '[.!?]$'))) AS starts FROM x),
 g AS (SELECT doc_id, string_agg(CASE WHEN starts THEN chr(2) ELSE '' END || line, chr(10) ORDER BY idx) AS a FROM h GROUP BY doc_id),
 n AS (SELECT doc_id, list_filter(list_transform(string_split(a, chr(2)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS p FROM g),
 m AS (SELECT doc_id, {merged('p', 200)} AS c FROM n WHERE len(p) > 0)
 SELECT doc_id, (unnest(range(0, len(c))))::INT AS chunk_index, unnest(c) AS content FROM m""")
def c13_heuristic(s: SparkSession, d: str) -> DataFrame:
    """Lines that look like headings in their context begin segments; short ones are merged."""
    x = t(s, d, "documents").select("doc_id", F.array("text").alias("pages"))
    return tx.unrolled(chunking.split_heuristic(x), "doc_id", F.col("chunks"), "chunk_index", "content")


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'TOKEN' WHEN 1 THEN 'SEMANTIC' ELSE 'STRUCTURAL' END AS chunk_strategy, left(regexp_replace(lower(text), '\\s+', '', 'g'), 100) AS begins FROM documents")
def c1_dispatch(s: SparkSession, d: str) -> DataFrame:
    """Each row goes through its own strategy's splitter; what the chunks of each begin with."""
    kind = F.element_at(F.array(F.lit("TOKEN"), F.lit("SEMANTIC"), F.lit("STRUCTURAL")), (F.col("doc_id") % 3 + 1).cast("int"))
    x = t(s, d, "documents").select(F.col("doc_id").cast("string").alias("id"), kind.alias("chunk_strategy"), F.lit("GENERIC").alias("structural_variant"), F.col("text").alias("markdown"), F.array("text").alias("pages"))
    letters = F.regexp_replace(F.lower(F.array_join("chunks", "")), r"\s+", "")
    return chunking.chunk_documents(x).select(F.col("id").cast("long").alias("doc_id"), "chunk_strategy", F.left(letters, F.lit(100)).alias("begins"))


# readers


def _html(s: SparkSession, d: str) -> DataFrame:
    """Small pages with a head, a list, a table, emphasis and nesting."""
    n = t(s, d, "nation").select("n_nationkey", F.col("n_name").alias("n"))
    parts = ["<html><head><title>x</title></head><body><nav>menu</nav><h2>", "n", " <i>land</i></h2><p>Of ", "n", " &amp; more<p>next</p><ul><li>one<li>", "n",
             "</ul><ol><li>a</li></ol><table><tr><th>h</th><th>k</th></tr><tr><td>", "n", "</td><td>2</td></tr></table><hr><blockquote>said <b>", "n", "</b></blockquote><div><div><b>", "n", "</b><br><em>it</em></div></div>"]
    return n.select("n_nationkey", F.concat(*[F.col("n") if x == "n" else F.lit(x) for x in parts]).alias("html"))


@query("""SELECT n_nationkey, '## ' || n || ' land' || chr(10) || chr(10) || 'Of ' || n || ' & more' || chr(10) || chr(10) || 'next' || chr(10) || chr(10) || '- one' || chr(10) || '- ' || n || chr(10) || chr(10) || '1. a' || chr(10) || chr(10)
 || '| h | k |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || n || ' | 2 |' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '> said ' || n || chr(10) || chr(10) || '**' || n || '**' || chr(10) || '*it*' AS markdown FROM (SELECT n_nationkey, n_name AS n FROM nation)""")
def t1_t2_markup(s: SparkSession, d: str) -> DataFrame:
    """Pages as markdown."""
    return _html(s, d).select("n_nationkey", markup.to_markdown(F.col("html")).alias("markdown"))


@query("SELECT n_nationkey, n || ' land Of ' || n || ' & more next one ' || n || ' a h k ' || n || ' 2 said ' || n || ' ' || n || ' it' AS text FROM (SELECT n_nationkey, n_name AS n FROM nation)")
def s12_small_pages(s: SparkSession, d: str) -> DataFrame:
    return _html(s, d).select("n_nationkey", markup.to_text(F.col("html")).alias("text"))


@query("SELECT n_nationkey, '<h2>' || n_name || ' &amp; <strong>co</strong></h2>' || chr(10) || '<ul><li>a</li><li><em>' || n_name || '</em></li></ul>' || chr(10) || '<p><a href=\"https://x.y\">l</a> &lt;script&gt;</p>' AS html FROM nation")
def t4_html(s: SparkSession, d: str) -> DataFrame:
    """T4: markdown as safe HTML."""
    md = F.concat(F.lit("## "), "n_name", F.lit(" & **co**\n\n- a\n- *"), "n_name", F.lit("*\n\n[l](https://x.y) <script>"))
    return t(s, d, "nation").select("n_nationkey", markup.to_html(md).alias("html"))


UPLOADS = "(SELECT n_nationkey AS k, n_name AS n, n_nationkey % 5 AS kind FROM nation)"


@query(f"""SELECT k, CASE kind WHEN 0 THEN 'EPUB' WHEN 1 THEN 'EPUB' WHEN 2 THEN 'EPUB' WHEN 3 THEN 'PDF' END AS source_type, kind = 4 AS refused,
 CASE WHEN kind < 3 THEN '# ' || n || chr(10) || chr(10) || 'Body of ' || n || '.' ELSE '' END AS markdown, CASE WHEN kind = 3 THEN n || chr(10) || 'Body of ' || n || '.' ELSE '' END AS page FROM {UPLOADS}""")
def s2_s9_uploads(s: SparkSession, d: str) -> DataFrame:
    """Books as they are, in folders, and wrapped alone; PDF files; other kinds refused. Each is written here and read back."""
    from ..sources import archive, epub, fixtures, pdf

    n = t(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n"), (F.col("n_nationkey") % 5).alias("kind"))
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("epub", "zip", "zip", "pdf", "txt")]), (F.col("kind") + 1).cast("int"))
    files = n.select("k", F.concat(F.lit("/in/f"), F.col("k").cast("string"), F.lit("."), suffix).alias("path"), fixtures.upload(F.col("kind"), F.col("n")).alias("content"))
    r = archive.resolve_uploads(files)
    pages = pdf.pdf_columns(r.filter("source_type = 'PDF'").select(F.col("k").alias("id"), "content")).select(F.col("id").alias("k"), F.array_join("pdf_pages", "|").alias("page"))
    r = r.join(pages, "k", "left")
    text = F.when(F.col("source_type") == "EPUB", epub.epub_markdown(F.col("content"))).otherwise("")
    return r.select("k", "source_type", F.col("error").isNotNull().alias("refused"), text.alias("markdown"), F.coalesce("page", F.lit("")).alias("page"))

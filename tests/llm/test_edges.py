"""Rows at the edges: empty tables, missing labels, null and repeated ids, clashing columns, very long texts."""

import hashlib
import io

import numpy as np
from pyspark.sql import functions as F

from corvina.llm import embeddings, langid, quality, simhash, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
WORDS = [f"w{i}" for i in range(300)]


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def test_quality_edges(spark):
    d = spark.createDataFrame([(1, "a b", "en", "s", 1), (1, "a b", "en", "s", 1), (None, None, None, None, None)], DOCS).withColumn("quality_score", F.lit("clash"))
    w = quality.fit_quality(d, spark.createDataFrame([], LABELS))
    assert not w.any() and [r["quality_score"] for r in quality.score_quality(d, w).collect()] == [0.5] * 3
    assert quality.score_quality(d, w).columns == d.columns and quality.score_quality(d.limit(0), w).count() == 0
    assert quality.score("word " * 500_000, w) == 0.5


def test_toxicity_edges(spark):
    d = spark.createDataFrame([(1, "you fool", "en", "s", 1), (2, None, None, None, None), (None, "x " * 800_000, "en", "s", 1)], DOCS).withColumn("toxic", F.lit("clash"))
    chain = toxicity.fit_toxicity(d, spark.createDataFrame([], LABELS))
    assert toxicity.reject_toxic(d, chain).count() == 3 and toxicity.reject_toxic(d, chain).columns == d.columns
    assert toxicity.reject_toxic(d.limit(0), chain).count() == 0
    one = toxicity.fit_toxicity(d, spark.createDataFrame([(1, 1, 0), (2, 1, 0)], LABELS))  # no toxic row to learn from
    assert toxicity.reject_toxic(d, one).count() == 3


def test_language_edges(spark):
    rows = [(i, ("la li lu " if i % 2 else "ko ka ke ") * 20, "xx" if i % 2 else "yy", "s", 1) for i in range(40)]
    d = spark.createDataFrame([*rows, rows[0], rows[0]], DOCS).withColumn("p", F.lit("clash"))
    m = langid.fit_languages(d)
    assert m.names == ("xx", "yy") and langid.infer("la li lu " * 300_000, m)[0] == "xx"
    assert langid.infer("q", m) == ("xx", 0.5, ["xx"], [1.0])  # nothing to go by: the first in order
    flat = langid.Languages(("aa", "bb"), np.zeros((1 << langid.BITS, 2), np.float32))
    assert langid.infer("some words alike in both", flat)[0] == "aa"
    assert langid.reject_undetermined(d, m).columns == d.columns and langid.reject_undetermined(d.limit(0), m).count() == 0
    many = spark.createDataFrame([(i, f"t{i} " * 9, f"l{i}", "s", 1) for i in range(1200)], DOCS)
    assert len(langid.fit_languages(many.filter("doc_id < 40")).names) > 20


def test_embedding_edges(spark):
    v = [float(i) for i in range(1, 9)]
    rows = [(None, v, 1), (None, v, 1), (3, v, 1), (3, v, 1), (4, [x + 0.001 for x in v], 1), (5, v, 2), (6, [1e300 if i % 2 else 0.0 for i in range(8)], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit(1)).withColumn("sig", F.lit(2))
    got = sorted(map(tuple, embeddings.link_embeddings(df).collect()), key=str)
    assert got == sorted([(None, 0, None, True), (None, 0, None, True), (3, 2, 3, True), (3, 2, 3, True), (4, 2, 3, False), (5, 0, 5, True), (6, 0, 6, True)], key=str)


def test_sketches_spare_true_pairs():
    most = embeddings.sketch_distance()
    rng, lost = np.random.default_rng(4), 0
    planes = rng.standard_normal((32, embeddings.SKETCH))
    for _ in range(3000):
        a, b = rng.standard_normal((2, 32))
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        c = 0.98 * a + (1 - 0.98**2) ** 0.5 * b / np.linalg.norm(b)
        lost += ((a @ planes > 0) != (c @ planes > 0)).sum() > most
    assert lost == 0 and most < 32


def test_embedding_recall(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((1500, 24))
    near = base[:500] + rng.standard_normal((500, 24)) * 0.19
    x = np.r_[base, near].astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = (np.triu(unit @ unit.T, 1) >= 0.98).sum()
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    found = embeddings.link_embeddings(df).agg(F.sum("n_links")).first()[0] // 2
    assert want > 100 and found == want


def test_warc_edges(spark):
    big, huge = "b" * 1200, "häß " * 900_000
    rows = [(1, "http://a/", big), (None, "http://a/", big), (7, "u", big), (7, "v", big), (None, None, None), (9, "http://a/", huge), (3, "x\ty", "s"), (3, "x\ty", "s")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    where = warc.scratch_path(spark, "e")
    got = [r.asDict() for r in warc.read_archives(warc.write_archives(warc.captures(pages), where), where).collect()]
    want = []
    for i, _, html in rows:
        shared = html == big and i != 7  # every row of the largest id keeps the payload
        data = (html or "").encode()
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if shared else "response", 7 if shared else None))
    assert sorted([tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got], key=str) == sorted(want, key=str)
    nulls = spark.createDataFrame([(None, "a", big), (None, "b", big)], "page_id long, url string, html string")
    assert [r["refers_to"] for r in warc.captures(nulls).collect()] == [None, None]


def test_runs_are_searched_by_halving(tmp_path):
    import pyarrow.fs as pafs

    out = warc.IndexWriter(pafs.LocalFileSystem(), str(tmp_path / "run.idx"))
    keys = [(f"org,h{i // 7:05d})/{'p' * (i % 90)}", "2020", i) for i in range(20_000)]
    for k in sorted(keys):
        out.add(k, "path\t0\t1")
    got = out.close()
    assert got["n"] == 20_000 and warc.SAMPLE // 2 <= len(got["sample"]) <= warc.SAMPLE and got["sample"] == sorted(got["sample"])
    keys.sort()
    data = (tmp_path / "run.idx").read_bytes()
    for low in [keys[0], keys[1], keys[9_999], keys[-1], ("zzz", "", 0), ("", "", 0)]:
        at = warc.seek_key(io.BytesIO(data), len(data), low, near=256)
        assert at == 0 or data[at - 1 : at] == b"\n"
        assert [k for k, _ in warc.stream_run(io.BytesIO(data), at, low, None)] == [k for k in keys if k >= low]
        assert len(data) - at < 512 + sum(len(k[0]) + 40 for k in keys if k >= low)


def test_many_runs_are_merged_in_passes(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 11}/{i}", f"page {i}") for i in range(900)], "page_id long, url string, html string")
    where = warc.scratch_path(spark, "p")
    m = warc.write_archives(warc.captures(pages).repartition(40), where)
    got = warc.read_archives(m, where, fan_in=3, range_rows=50)
    assert got.rdd.getNumPartitions() > 5
    keys = [(r["urlkey"], r["ts"], r["page_id"]) for r in got.collect()]
    assert len(keys) == 900 and keys == sorted(keys)  # partitions are ranges in order


def test_simhash_reads_whole_long_texts():
    a = prose(1, 400_000)
    assert simhash.fingerprint(a) != simhash.fingerprint(a[: len(a) // 2]) and (simhash.wide_fingerprint(a) != simhash.wide_fingerprint(a[: len(a) // 3])).any()


def brute_mix(rows):
    """(text, taken) of the rows that a mix of 150 % takes words of: targets by resharing, then a walk in the order of hashed ids."""
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    names = sorted(by, key=lambda x: (x is None, x or ""))
    size = {n: sum(len(r["text"].split()) for r in by[n]) for n in names}
    weight = {n: (3, 1, 2)[k % 3] for k, n in enumerate(names)}
    target, left, free = {}, 1.5 * sum(size.values()), set(names)
    while free:
        level = left / sum(weight[n] for n in free)
        full = {n for n in free if 2 * size[n] <= level * weight[n]}
        for n in full or free:
            target[n] = 2.0 * size[n] if full else level * weight[n]
            left -= target[n] if full else 0
        free = free - full if full else set()
    out = set()
    for n in names:
        budget = int(target[n] + 0.5)
        rest = budget % size[n]
        key = lambda r: hashlib.md5(f"0:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()
        for r in sorted(by[n], key=lambda r: (key(r), r["doc_id"] is not None, r["doc_id"] or 0, len(r["text"].split()))):
            words = len(r["text"].split())
            taken = budget // size[n] * words + max(0, min(words, rest))
            rest -= words
            if taken:
                out.add((r["text"], taken))
    return out


def test_pipeline_edges(spark, tmp_path):
    import corpus_pipeline

    rude = " you worthless idiot scum "
    rows = [(i, prose(i, 80), "en", f"s{i % 3}", 1) for i in range(90)] + [(100 + i, prose(100 + i, 60) + rude + prose(200 + i, 9), "en", "s1", 1) for i in range(45)]
    rows += [(None, prose(0, 80), "en", "s0", 1), (None, prose(900, 80), "en", "s0", 1), (None, prose(901, 80), None, "s0", 1), (5, prose(902, 80), "en", "s0", 1), (300, prose(903, 30) + rude, "en", "s2", 1), (301, None, "en", None, None)]
    d = spark.createDataFrame(rows, DOCS).withColumns({"size": F.lit("clash"), "key": F.lit(1), "row": F.lit(2), "__extra": F.array(F.lit(1))})
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(90)] + [(100 + i, 1, 1) for i in range(45)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, prose(901, 20))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == d.columns, name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    texts = sorted(r["text"] for r in docs.collect())
    assert texts == sorted([prose(i, 80) for i in range(90)] + [prose(900, 80), prose(902, 80)])  # rude rows, the copy, the passage and the null are gone
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r["text"], r["taken"]) for r in out} == brute_mix(docs.collect()) and all(r["size"] == len(r["text"].split()) for r in out)
    empty = tmp_path / "empty"
    for name, df in (("documents", d), ("labels", spark.createDataFrame([], LABELS)), ("benchmark", spark.createDataFrame([], "item_id long, text string"))):
        df.limit(0).write.parquet(str(empty / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0

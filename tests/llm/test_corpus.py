"""Small fixtures against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corvina.llm import buckets, components, decontam, embeddings, langid, licenses, mixing, quality, simhash, tokens, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, key string"


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", f"s{i % 3}", None, 9, "k") for i, t in enumerate(texts)], DOCS)


WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def unite(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# -- mixing


def test_mix_cuts_exactly_and_keeps_ties(spark):
    texts = [None, "", " \t "] + [prose(i, 3 + i % 40) for i in range(200)] + ["same words here"] * 20
    d = docs_of(spark, texts).withColumn("source", F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("source")))
    a = mixing.mix(d).collect()
    assert sorted(map(tuple, a), key=str) == sorted(map(tuple, mixing.mix(d.repartition(7)).collect()), key=str)
    assert len(a) == len(texts) and all(0 <= r["taken"] <= 2 * r["size"] for r in a)
    total = sum(r["size"] for r in a)
    for s in {r["source"] for r in a}:
        mine = [r for r in a if r["source"] == s]
        assert sum(r["taken"] for r in mine) == round(mine[0]["target"]) and mine[0]["target"] <= 2 * sum(r["size"] for r in mine) + 1e-6
    assert sum({r["source"]: r["target"] for r in a}.values()) == pytest.approx(1.5 * total)
    assert mixing.mix(d.limit(0)).count() == 0
    kept = mixing.take_mix(d)
    assert kept.filter("taken <= 0").count() == 0 and "n_chars" in kept.columns


def test_targets_reshare(spark):
    s = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, source_size long")
    t = {r["source"]: r["target"] for r in mixing.targets(s).collect()}
    assert t["a"] == 20 and t[None] == 0 and t["b"] + t["c"] == pytest.approx(1.5 * 2010 - 20) and t["c"] == pytest.approx(2 * 1000 if 2 * t["b"] > 2000 else 2 * t["b"])


def test_take_mix_meets_budgets_with_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "UNROLL", 3)
    rows = [(7, "a b c d e f g", "en", "s", None, 9, "k")] * 2 + [(None, f"x y {i}", "en", "s", None, i, "k") for i in range(6)] + [(None, "same text here", "en", "t", None, 1, "k")] * 11 + [(3, None, None, None, None, 0, "k")] * 2
    d = spark.createDataFrame(rows, DOCS)
    for share in (0.4, 0.73, 1.5):
        got = mixing.take_mix(d, share).collect()
        plan = {r["source"]: int(r["target"] + 0.5) for r in mixing.mix(d, share).collect()}
        assert mixing.mix(d, share).count() == len(rows)
        for s in ("s", "t"):
            mine = [r for r in got if r["source"] == s]
            assert sum(r["taken"] for r in mine) == plan[s] == sum(r["taken"] for r in mixing.mix(d, share).collect() if r["source"] == s)
            assert all(0 < r["taken"] <= 2 * r["size"] and r["size"] == len(r["text"].split()) for r in mine)
        assert not any(r["source"] is None for r in got) and sorted(map(str, got)) == sorted(map(str, mixing.take_mix(d.repartition(5), share).collect()))
    assert mixing.take_mix(d.limit(0)).count() == 0
    long_ = mixing.mix(docs_of(spark, [prose(1, 300_000), "one"])).collect()
    assert {r["size"] for r in long_} == {300_000, 1}


def test_ordered_prefix_in_ranges(spark):
    names = [f"s{i:03d}" for i in range(100)] + [None]
    s = spark.createDataFrame([(n, float(i * i)) for i, n in enumerate(names)], "source string, v double").repartition(7)
    got = {r["source"]: (r["place"], r["before_v"]) for r in mixing.ordered_prefix(s, ["source"], ["v"]).collect()}
    assert got == {n: (i, float(sum(k * k for k in range(i)))) for i, n in enumerate(names)}


# -- decontamination


def report(texts, items):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    out = []
    for t in texts:
        w, hit, names = word(t), set(), set()
        for i, x in items:
            v = word(x)
            m = min(10, len(v))
            wins = {tuple(v[k : k + m]) for k in range(len(v) - m + 1)} if v else set()
            for k in range(len(w) - m + 1) if wins else ():
                if tuple(w[k : k + m]) in wins:
                    hit |= set(range(k, k + m))
                    names.add(str(i))
        out.append((len(w), len(hit), len(names)))
    return out


def test_contamination_matches_brute_force(spark):
    items = [(1, prose(1, 30)), (2, prose(2, 12)), (3, prose(1, 30)), (4, "Alpha Beta gamma"), (5, "zeta9"), (6, "p q"), (7, None), (8, "!!"), (9, "la " * 14)]
    a, b = items[0][1], items[1][1]
    texts = [None, "", a.upper(), prose(9, 50) + " " + " ".join(a.split()[5:16]) + " " + prose(8, 3), b + " x " + b, " ".join(a.split()[:9]), "alpha-beta GAMMA!", "x zeta9 p q", "la " * 11, "la " * 9, prose(7, 5000) + " " + b, "Été alpha beta gammas", a, a]
    got = decontam.contamination(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_hit"], r["n_items"]) for r in got] == report(texts, items)
    none = decontam.contamination(docs_of(spark, texts), spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(none) == len(texts) and not any(r["contaminated"] for r in none)
    assert decontam.contamination(docs_of(spark, texts).limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontam.drop_contaminated(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")).columns == [x.split()[0] for x in DOCS.split(", ")]


def test_contamination_seeks_items_without_id(spark):
    import duckdb

    items = [(None, prose(1, 30)), (None, "lone pair"), (7, prose(2, 30)), (7, "zeta9"), (None, None), (None, "!!")]
    texts = [prose(9, 20) + " " + prose(1, 30), "a lone pair here", prose(1, 30) + " lone pair " + prose(2, 30), prose(8, 20), None]
    docs, bench = docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, decontam.contamination(docs, bench).collect()))
    assert [r[2:4] for r in got] == [(30, 1), (2, 1), (62, 2), (0, 0), (0, 0)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    assert got == sorted(con.execute(decontam.OP5_SQL).fetchall())
    assert {r["doc_id"] for r in decontam.drop_contaminated(docs, bench).collect()} == {3, 4}


# -- near duplicates


def test_fingerprints_and_components(spark):
    base = prose(5, 300).split()
    texts = [None, "", "  ", "Hello World", "hello  WORLD"] + [" ".join(base[:i] + ["changed"] + base[i + 1 :]) for i in range(0, 60, 3)] + [prose(i + 50, 40) for i in range(30)] + [" ".join(base)] * 5 + [prose(77, 20_000)]

    def fp(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    f = [fp(t) for t in texts]
    want = unite(len(f), [(i, j) for i in range(len(f)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 4])
    for limit in (4096, 3):
        got = simhash.near_duplicates(docs_of(spark, texts), limit=limit).orderBy("doc_id").collect()
        assert [r["fp"] & (1 << 64) - 1 for r in got] == f and [r["component_id"] for r in got] == want
    assert simhash.drop_near_duplicates(docs_of(spark, texts), simhash.EXACT).count() == len(set(want))
    assert simhash.near_duplicates(docs_of(spark, texts).limit(0)).count() == 0


def test_wide_fingerprints_match_brute_force(spark):
    rng = np.random.default_rng(8)
    texts = [None, "", "one", "One", "a b c d"]
    for i in range(25):
        base = prose(400 + i, 120).split()
        texts.append(" ".join(base))
        for edits in (1, 2, 4, 30):
            w = list(base)
            for at in rng.integers(0, len(w), edits):
                w[at] = f"edit{rng.integers(1000)}"
            texts.append(" ".join(w))
    spec = simhash.WIDE
    f = [sum(int(np.uint64(x)) << 64 * k for k, x in enumerate(simhash.wide_fingerprint(t).view(np.uint64))) for t in texts]

    def linked(a, b):
        x = a ^ b
        return x.bit_count() <= spec.most and any((x >> s & (1 << n) - 1).bit_count() <= 1 for s, n in spec.segments)

    want = unite(len(f), [(i, j) for i in range(len(f)) for j in range(i) if linked(f[i], f[j])])
    assert len(set(want)) < len(f) - 40  # most slightly edited copies link
    for limit in (4096, 2):
        got = simhash.near_duplicates(docs_of(spark, texts), spec, limit).orderBy("doc_id").collect()
        assert [r["component_id"] for r in got] == want
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs_of(spark, texts)).collect()}
    assert kept == set(want)


def test_wide_links_miss_no_pair_within_the_bits(spark):
    # two bits or more in each sixth of the fingerprint, so that no sixth finds the pair
    for seed in (5011, 5015, 5044):
        w = prose(seed, 120).split()
        edited = " ".join("edited" if i in (20, 60, 100) else x for i, x in enumerate(w))
        a, b = (simhash.wide_fingerprint(t) for t in (" ".join(w), edited))
        assert np.bitwise_count(a ^ b).sum() <= 19
        assert [r["doc_id"] for r in simhash.drop_near_duplicates(docs_of(spark, [" ".join(w), edited])).collect()] == [0]
    # bits spread evenly over random fingerprints and by chance, on both sides of the threshold
    rng = np.random.default_rng(3)
    f = []
    for k in range(240):
        x = int.from_bytes(rng.bytes(16))
        at = (int(rng.integers(128)) + np.arange(15 + k % 8) * 128 // (15 + k % 8)) % 128 if k % 2 else rng.choice(128, 15 + k % 8, replace=False)
        f += [x, x ^ sum(1 << int(b) for b in at)]
    want = unite(len(f), [(i, j) for i in range(len(f)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 19])
    assert len(f) > len(set(want)) > len(f) // 2
    signed = lambda x: x - (x >> 63 << 64)
    fps = spark.createDataFrame([(signed(x & (1 << 64) - 1), signed(x >> 64)) for x in f], "f0 long, f1 long")
    at = {f"{x & (1 << 64) - 1:016X}{x >> 64:016X}": i for i, x in enumerate(f)}
    for limit in (None, 4096, 2):
        edges = simhash.link_fingerprints(fps, simhash.WIDE, limit).collect()
        assert unite(len(f), [(at[r["a"]], at[r["b"]]) for r in edges]) == want
    with pytest.raises(ValueError):
        simhash.Spec(5, simhash.WIDE.segments[:9], 19)


def test_stages_keep_rows_by_text_not_by_id(spark):
    unlike = [prose(3000 + i, 60) for i in range(10)]
    rows = [(None, t, "en", "s", None, 9, "k") for t in unlike]  # null ids, unlike texts
    rows += [(1, prose(1, 60), "en", "s", None, 9, "k"), (2, prose(1, 60), "en", "s", None, 9, "k"), (2, prose(2, 60), "en", "s", None, 9, "k")]  # an id with a copy and a text of its own
    rows += [(3, prose(4, 60), "en", s, None, 9, "k") for s in ("t", "u", "u")] + [(None, prose(1, 60), "en", "s", None, 9, "k")]
    d = spark.createDataFrame(rows, DOCS)
    want = sorted([(t, None) for t in unlike] + [(prose(1, 60), 1), (prose(2, 60), 2), (prose(4, 60), 3)])
    a = simhash.drop_near_duplicates(d)
    assert a.columns == d.columns and sorted((r["text"], r["doc_id"]) for r in a.collect()) == want
    assert sorted(map(str, a.collect())) == sorted(map(str, simhash.drop_near_duplicates(d.repartition(5)).collect()))
    b = decontam.drop_contaminated(d, spark.createDataFrame([(1, unlike[0]), (2, prose(2, 60))], "item_id long, text string"))
    assert b.columns == d.columns and sorted((r["text"], str(r["doc_id"])) for r in b.collect()) == sorted((r[1], str(r[0])) for r in rows if r[1] not in (unlike[0], prose(2, 60)))


def test_components_of_a_long_path(spark):
    n = 300
    order = np.random.default_rng(0).permutation(n).tolist()
    e = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(900, 901), (901, 900), (5, 5)], "x long, y long")
    got = {r["node"]: r["component"] for r in components.connected_components(e).collect()}
    assert got == {i: 0 for i in range(n)} | {900: 900, 901: 900}


def test_groups_stream():
    import pyarrow as pa

    key = np.repeat([1, 2, 3, 4, 5], [1, 30, 2, 9, 1])
    batches = [pa.RecordBatch.from_pydict({"key": key[i : i + 4], "v": np.arange(len(key))[i : i + 4]}) for i in range(0, len(key), 4)]
    whole, large = [], []
    for c, x in buckets.whole_groups(iter(batches), 10):
        whole += c["key"].tolist()
        large += x["key"].tolist()
    assert sorted(whole) == [1, 3, 3, *[4] * 9, 5] and large == [2] * 30


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=16)
    rows = [(i, [float(v) for v in base + rng.normal(size=16) * (0.08 if i % 3 else 0.5)], 1) for i in range(120)] + [(500 + i, [1.0] * 16, 2) for i in range(20)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [1.0, None] * 8, 2), (903, [float("nan")] * 16, 2), (904, [1.0] * 16, None), (905, [float("inf")] * 16, 2), (906, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit("x"))
    live = [(r["vec_id"], np.array(r["embedding"], float), r["label"]) for r in df.collect() if r["vec_id"] < 900]
    unit = [(i, v / np.linalg.norm(v), k) for i, v, k in live]
    links = [(a, b) for a in range(len(unit)) for b in range(a) if unit[a][2] == unit[b][2] and unit[a][1] @ unit[b][1] >= 0.98]
    root, n = unite(len(unit), links), [0] * len(unit)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    want = {(unit[k][0], n[k], unit[root[k]][0]) for k in range(len(unit))} | {(i, 0, i) for i in range(900, 907)}
    for limit in (4096, 10):
        assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.link_embeddings(df, limit=limit).collect()} == want
    assert embeddings.link_embeddings(df.limit(0)).count() == 0


# -- per document


@pytest.fixture(scope="module")
def labelled(spark):
    clean = [prose(i, 60) for i in range(120)]
    bad = [" ".join(f"{w.upper()}!!" for w in prose(i, 60).split()) for i in range(1000, 1060)]
    rude = [prose(i, 50) + " idiot " + "worthless scum " for i in range(2000, 2060)]
    texts = clean + bad + rude + [None, "", "12 34"]
    d = docs_of(spark, texts)
    lab = spark.createDataFrame([(i, int(not 120 <= i < 180), int(180 <= i < 240)) for i in range(240)] + [(3, None, 0), (None, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    return d, lab, texts


def test_quality(spark, labelled):
    d, lab, texts = labelled
    w = quality.fit_quality(d, lab)
    r = {x["doc_id"]: x["quality_score"] for x in quality.score_quality(d, w).collect()}
    assert all((r[i] > 0.5) != (120 <= i < 180) for i in range(240)) and all(0 <= v <= 1 for v in r.values())
    assert np.array_equal(w, quality.fit_quality(d.repartition(5), lab.repartition(3)))
    long_ = "abc " * 700_000
    assert quality.features(long_)[1] == 700_000
    assert quality.fit_quality(d, lab.limit(0))[-1] == 0 and quality.score(None, quality.fit_quality(d.limit(0), lab)) == 0.5


def test_toxicity(spark, labelled):
    d, lab, texts = labelled
    chain = toxicity.fit_toxicity(d, lab)
    kept = {r["doc_id"] for r in toxicity.reject_toxic(d, chain).collect()}
    assert kept == set(range(len(texts))) - set(range(180, 240)) and toxicity.reject_toxic(d, chain).columns == d.columns
    assert chain.earlier[0].tolist() == [0, 0, 0]


def test_language(spark):
    langs = {"aa": ["ka", "lo", "mi"], "bb": ["eur", "ssa", "tch"], "cc": ["zyx", "wvu", "qrs"]}
    rng = np.random.default_rng(1)
    make = lambda k, n: " ".join("".join(rng.choice(langs[k], 3)) for _ in range(n))
    rows = [(i, make(k, 40), k) for i, k in enumerate(sorted(langs) * 40)]
    d = spark.createDataFrame(rows + [(900, None, "aa"), (901, "12 !", "bb"), (902, "x", None)], "doc_id long, text string, lang string")
    m = langid.fit_languages(d)
    assert m.names == ("aa", "bb", "cc") and all(langid.infer(t, m)[0] == k for _, t, k in rows)
    name, share, names, shares = langid.infer(make("aa", 60) + " " + make("bb", 20), m)
    assert name == "aa" and set(names) == {"aa", "bb"} and 0.4 < share < 0.8 and sum(shares) == pytest.approx(1)
    assert langid.infer(None, m)[0] == langid.infer("12 !", m)[0] == "und" and langid.infer("x y", langid.Languages((), np.zeros((1, 0))))[0] == "und"
    assert {r["doc_id"] for r in langid.reject_undetermined(d, m).collect()} >= set(range(120)) and langid.fit_languages(d.limit(0)).names == ()


def test_language_stage_rejects_mixtures_and_gibberish(spark):
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    word = lambda: "".join(rng.choice(letters, rng.integers(4, 9)))
    lexicon = {k: [word() for _ in range(150)] for k in ("aa", "bb", "cc", "dd", "ee", "ff")}
    make = lambda k, n: " ".join(rng.choice(lexicon[k], n))
    clean = [(i, make(k, n), k) for i, (k, n) in enumerate((k, n) for k in sorted(lexicon) for n in [1, 3, 10, *[120] * 30])]
    mixed = " ".join(make(k, 100) for k in sorted(lexicon))
    gibberish = " ".join(word() for _ in range(200))
    d = spark.createDataFrame(clean, "doc_id long, text string, lang string")
    m = langid.fit_languages(d)
    more = [(1000, mixed, None), (1001, gibberish, None), (1003, make("aa", 60) + " " + make("bb", 60), None), (1004, None, None), (1005, "12 !", None)]
    kept = langid.reject_undetermined(d.union(spark.createDataFrame(more, d.schema)), m)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {r[0] for r in clean} | {1003}
    assert langid.standing("a b", m) == pytest.approx(1 / 6) and langid.standing(None, m) == 0.0


def test_language_set_has_no_fixed_size():
    rng = np.random.default_rng(4)
    make = lambda a, n: " ".join("".join(rng.choice(list(a), 6)) for _ in range(n))
    alphabets = ("abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx")
    m = langid.train([make(a, 400) for a in alphabets], list(alphabets))
    name, share, names, shares = langid.infer(" ".join(make(a, 100) for a in alphabets), m)
    assert sorted(names) == sorted(alphabets) and shares == pytest.approx([1 / 6] * 6, abs=0.02) and name == names[0]


def library(path=None):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path or tokens.default_path())
    t.no_truncation()
    t.no_padding()
    return lambda x: len(t.encode(x or "", add_special_tokens=False).ids)


ODD = [
    "it's A <|endoftext|>x don't we'll 12.5 café × İstanbul ΣΑΣ e\u0301 z\x1c日本語 ''s ", "", "\n\n", "’s “q” naïve Ünï 中a1b2 ÀÉ÷ŉ ſt x\u0301a",
    "'ll 'l 're're !'s a'b'll'r'rex <|startoftext|><|endoftext|", "e\u0323\u0301a \u1100\u1161\u11a8x A\u030a \u212b b<|endoftext|>\u0301c", " á İ ǅ ß ﬁ ª ² ½ Ⅷ\u2003x",
]


def test_tokens_at_every_prefix(spark):
    c, exact = tokens.PrefixCounter(tokens.default_path()), library()
    rng = np.random.default_rng(5)
    signs = list("abcthe'slrvmdng <|>endoftext12.,!é\u0301中ÀİΣŉſ\x1c\x85")
    texts = [*ODD, prose(3, 50), *("".join(rng.choice(signs, rng.integers(1, 24))) for _ in range(300))]
    assert c.totals([None, *texts]) == [0, *map(exact, texts)]
    for t in texts:
        counts = [exact(t[:k]) for k in range(len(t) + 1)]
        p = c.prefixes(t)
        assert p.tolist() == counts
        for budget in range(0, counts[-1] + 1, 5):
            assert tokens.longest_within(p, budget) == max(k for k, n in enumerate(counts) if n <= budget)
    d = docs_of(spark, [*texts, None]).withColumn("n_tokens", F.lit("clash"))
    got = tokens.with_token_counts(d, limit=9).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == [*map(exact, texts), 0] and all(r["over_limit"] == (r["n_tokens"] > 9) for r in got)
    assert all(exact((r["text"] or "")[: r["within_limit"]]) <= 9 for r in got)
    stored = [r["prefix"] for r in tokens.prefix_table(d).orderBy("doc_id").collect()]
    assert stored[0] == c.prefixes(texts[0]).tolist() and stored[-1] == [0] and tokens.tokens_at(stored[0], 4) == exact(texts[0][:4])
    assert tokens.with_token_counts(d.limit(0)).count() == 0


def test_tokens_never_encode(monkeypatch):
    import tokenizers

    c = tokens.PrefixCounter(tokens.default_path())

    class Refuses:
        def __getattr__(self, name):
            raise AssertionError(f"the library was asked to {name}")

    monkeypatch.setattr(tokenizers, "Tokenizer", Refuses())
    assert not any("encode" in dir(x) for x in (c.v.normaliser, c.v.parter))
    p = c.prefixes("Some words it's fun")
    assert tokens.tokens_at(p, 4) == 1 and tokens.longest_within(p, 1) >= 4


def test_tokens_of_long_texts_and_colliding_hashes(monkeypatch):
    exact = library()
    c = tokens.PrefixCounter(tokens.default_path())
    text = prose(4, 200_000)  # beyond one group
    assert len(text) > 2 * tokens.GROUP // 2 and c.totals([text, None, "x"]) == [exact(text), 0, 1]
    run = "ab" * 20_000  # one very long piece
    p = c.prefixes(run)
    assert p[-1] == exact(run) and all(p[k] == exact(run[:k]) for k in (1, 199, 2001))
    monkeypatch.setattr(tokens.bw, "hashes", lambda b, s, e: (e - s).astype(np.uint64) % np.uint64(3))  # nearly all pieces collide
    c = tokens.PrefixCounter(tokens.default_path())
    assert c.totals(ODD) == [exact(x) for x in ODD]


def test_licences(spark):
    r = licenses.Rules()
    for name, wordings in licenses.SENTENCES.items():
        for w in wordings:
            assert [x[0] for x in r.sentences(f"Some text. {w}.\n\nmore")] == [name]
    assert r.licences(["MIT-permission", "MIT-notice", "as-is", "GPL-free", "Apache-2.0-grant"]) == ["MIT", licenses.UNKNOWN, "Apache-2.0"]
    texts = [None, "", "Not licensed. Licensed under the MIT License\nfoo bar. Released under the MIT License.", "x " * 100_000 + ". Licensed under CC BY-NC 4.0."]
    got = licenses.scan_licences(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [x["licence_scan"]["licences"] for x in got] == [[], [], ["MIT", "MIT"], ["CC-BY-NC-4.0"]]
    assert all(texts[2][s["start"] : s["end"]].lower().endswith("mit license") for s in got[2]["licence_scan"]["sentences"])


def test_warc_round_trip(spark):
    big = "z" * 1500
    rows = [(1, "http://a.b/x", big), (2, "http://A.b:80/x#f", big), (3, None, None), (4, "http://www.b.com", ""), (6, "q\nr", "é" * 600), (7, "x", "short"), (8, "x", "short"), (9, "http://a.b/x", "é" * 600)]
    rows += [(100 + i, f"http://h{i % 3}.org/{i % 5}", prose(i, 30)) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    where = warc.scratch_path(spark, "w")
    m = warc.write_archives(warc.captures(pages).repartition(5), where)
    for fan_in, n in ((2, 7), (128, 200_000)):
        got = {r["page_id"]: r for r in warc.read_archives(m, where, fan_in, n).collect()}
        assert len(got) == len(rows)
        for i, _, html in rows:
            assert got[i]["payload_bytes"] == len((html or "").encode()) and got[i]["payload_digest"] == __import__("hashlib").sha1((html or "").encode()).hexdigest()
        assert (got[1]["record_type"], got[1]["refers_to"], got[2]["refers_to"], got[6]["refers_to"], got[7]["record_type"]) == ("revisit", 2, None, 9, "response")
    keys = [(r["urlkey"], r["ts"]) for r in warc.read_archives(m, where).coalesce(1).collect()]
    assert keys == sorted(keys)
    assert warc.read_archives(warc.write_archives(warc.captures(pages.limit(0)), where + "e"), where + "e").count() == 0


def test_loser_tree_merges_like_sorted():
    rng = np.random.default_rng(2)
    for k in (1, 2, 3, 5, 8):
        runs = [sorted(("u" + str(rng.integers(5)), "t", int(rng.integers(9))) for _ in range(rng.integers(0, 20))) for _ in range(k)]
        got = [x[0] for x in warc.LoserTree([iter([(y, "") for y in r]) for r in runs])]
        assert got == sorted(y for r in runs for y in r)


def test_split_is_by_crc(spark):
    from corvina.llm.common import held_out

    got = {r["doc_id"]: r["h"] for r in spark.range(200).select(F.col("id").alias("doc_id")).select("doc_id", held_out().alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(200)}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    texts = [prose(i, 80) for i in range(60)] + [prose(0, 80)] * 3 + [prose(900, 40) + " idiot scum moron"] * 1 + [None, "123"] + [prose(901, 30) + " " + prose(902, 20)]
    docs_of(spark, texts).drop("size", "key").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, prose(902, 20))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    ids = [r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert len(ids) == len(set(ids)) and not set(ids) & {60, 61, 62, 64, 65, 66} and len(ids) > 30

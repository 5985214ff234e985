"""Exact, line, substring, fingerprint and vector deduplication against plain Python over small and odd tables."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from compare import same
from pyspark.sql import functions as F

from mosaikon.llm import exact, lines, mixing, oracle, queries, simhash, substrings, vectors
from mosaikon.operators import graph as components

WS = " \t\n\x0b\x0c\r"
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(30_000))
SENTENCE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "Same text here, long enough"), (5, "same TEXT here, long enough"), (6, "Same text  here,\nlong enough"), (7, "Same text here, long enough"),
    (8, "ünïcode Äpfel line of text\nünïcode äpfel line of text"), (9, "ünïcode Äpfel line of text\nshort"), (10, LONG), (11, LONG + " end"), (12, SENTENCE), (13, "prefix words " + SENTENCE + " and more words"),
    (14, "a b c word"), (15, "\n\nline that repeats often\n\n"), (16, "line that repeats often\nLine that REPEATS often  \nother"), (17, "x " * 40), (18, "x " * 40), (19, "日本語 のテキスト です"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def plain_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(f"[{WS}]", "", t or ""), []).append((-len(t or ""), i))
    return {i: (min(g)[1], len(g), i == min(g)[1], hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g}


def plain_lines(rows):
    owner, count = {}, {}
    for i, t in sorted(rows):
        for k in {ascii_lower(x.strip(WS)) for x in (t or "").split("\n")}:
            owner.setdefault(k, i)
            count[k] = count.get(k, 0) + 1
    out = {}
    for i, t in rows:
        own = (t or "").split("\n")
        gone = [len(k := ascii_lower(x.strip(WS))) >= 10 and count[k] >= 2 and owner[k] < i for x in own]
        out[i] = (len(own), sum(gone), "\n".join(x for x, g in zip(own, gone, strict=True) if not g))
    return out


def plain_substrings(rows):
    first, out = {}, {}
    for i, t in sorted(rows):
        w = words(t)
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), i)
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < i:
                gone[p : p + 13] = [True] * 13
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def plain_fingerprint(t):
    w = words(ascii_lower(t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def least_reachable(ids, near):
    label = np.array(ids)
    while True:
        new = np.array([label[near[k]].min() for k in range(len(ids))])
        if (new == label).all():
            return label.tolist()
        label = new


def plain_simhash(rows):
    ids = [i for i, _ in rows]
    fp = np.array([plain_fingerprint(t) for _, t in rows], np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    return {i: (f"{int(f):016x}", c) for i, f, c in zip(ids, fp, least_reachable(ids, near), strict=True)}


def test_exact(odd):
    assert by_id(exact.exact_dedup(odd), "keep_id", "group_size", "kept", "text_sha256") == plain_exact(ODD)


def test_exact_in_ranges(odd):
    """A filter too small for all rows: the hashes come in ranges, one after the other."""
    assert by_id(exact.exact_dedup(odd, most_bits=100), "keep_id", "group_size", "kept", "text_sha256") == plain_exact(ODD)


def test_lines(odd):
    assert by_id(lines.line_dedup(odd), "n_lines", "n_dropped", "kept_text") == plain_lines(ODD)


def test_lines_with_a_higher_threshold(spark):
    docs = spark.createDataFrame([(k, "a line of some length\nown line number " + str(k)) for k in (1, 2)] + [(k, "this line is in three") for k in (3, 4, 5)], "doc_id long, text string")
    got = by_id(lines.line_dedup(docs, min_docs=3), "n_dropped")
    assert got == {1: (0,), 2: (0,), 3: (0,), 4: (1,), 5: (1,)}


def test_substrings(odd):
    assert by_id(substrings.substring_dedup(odd), "n_words", "n_removed", "kept_text") == plain_substrings(ODD)


def test_substrings_with_a_full_table(odd):
    """Bit tables that let everything through give the same rows."""
    assert by_id(substrings.substring_dedup(odd, most_bits=17), "n_words", "n_removed", "kept_text") == plain_substrings(ODD)


def test_simhash(odd):
    assert by_id(simhash.near_duplicates(odd), "fingerprint", "component_id") == plain_simhash(ODD)


def test_links_at_each_distance(spark):
    """Pairs at distance 3 meet wherever their bits are, pairs at distance 4 don't link."""
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = []
    for k, b in enumerate(base):
        bits = rng.choice(64, 4, replace=False)
        n = k % 5
        fps += [int(b), int(b) ^ sum(1 << int(x) for x in bits[:n])]
    distinct = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in set(fps)], "fp long")
    got = {tuple(sorted((r["u"] % (1 << 64), r["v"] % (1 << 64)))) for r in simhash.links_between(distinct).collect()}
    assert got == {tuple(sorted(p)) for k, p in enumerate(zip(fps[::2], fps[1::2], strict=True)) if 1 <= k % 5 <= 3}


def test_hot_variants_are_dealt_in_parts(spark, monkeypatch):
    """Many fingerprints on one variant, compared part by part, connect as they do at once."""
    rng = np.random.default_rng(4)
    fp = np.unique(rng.integers(0, 1 << 10, 150, dtype=np.uint64))
    monkeypatch.setattr(simhash, "PART", 20)
    monkeypatch.setattr(simhash, "SAMPLED", 1)
    links = simhash.links_between(spark.createDataFrame([(int(x),) for x in fp], "fp long"))
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    want = dict(zip(fp.tolist(), least_reachable(fp.tolist(), near), strict=True))
    assert {k: got.get(k, k) for k in want} == want


def test_large_meetings_stay_connected():
    """A dense ball of fingerprints: the links are few and connect all."""
    rng = np.random.default_rng(1)
    fp = np.unique(np.array([sum(1 << int(b) for b in rng.choice(22, rng.integers(0, 4), replace=False)) for _ in range(3000)], np.uint64))
    u, v = simhash._links_of(fp)
    assert len(u) <= 2 * len(fp)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    want = least_reachable(list(range(len(fp))), near)
    at = {int(f): k for k, f in enumerate(fp)}
    links = np.eye(len(fp), dtype=bool)
    for a, b in zip(u, v, strict=True):
        links[at[int(a)], at[int(b)]] = links[at[int(b)], at[int(a)]] = True
    assert least_reachable(list(range(len(fp))), links) == want


def test_components(spark):
    chain = [(k, k + 1) for k in range(60)] + [(100, 200), (300, 200), (7, 7), (0, 1), (500, 400)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert {got[k] for k in range(61)} == {0}
    assert (got[100], got[200], got[300], got[400], got[500]) == (100, 100, 100, 400, 400)
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    """3000 nodes in rising order, whose least node is at one end: rounds rise with the logarithm."""
    links, put = [], components.scratch
    monkeypatch.setattr(components, "scratch", lambda df, label: links.append(label) or put(df, label))
    got = components.components(spark.range(3000).selectExpr("id as u", "id + 1 as v"))
    assert [tuple(r) for r in got.groupBy("component").count().collect()] == [(0, 3001)]
    assert links.count("links") <= 20


def unit(rng, n, dim):
    x = rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_vectors(spark):
    rng = np.random.default_rng(2)
    centres = unit(rng, 20, 16)
    near = np.concatenate([c + rng.normal(scale=0.03, size=(9, 16)) for c in centres])
    rows = [(k, x.astype(np.float32).tolist()) for k, x in enumerate(np.concatenate([near, unit(rng, 60, 16)]))]
    rows += [(1000, rows[3][1]), (1001, rows[3][1]), (1002, None), (1003, [0.0] * 16), (1004, [float("nan")] * 16), (1005, [1.0, None]), (1006, [1.0] * 8), (1007, []), (1008, [float("inf")] + [0.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: tuple(r)[1:] for r in vectors.near_vectors(df).collect()}
    fine = [(k, np.array(x, float)) for k, x in rows if x and len(x) == 16 and None not in x and np.isfinite(x).all() and any(x)]
    x = np.stack([v / np.linalg.norm(v) for _, v in fine])
    sim = x @ x.T >= 0.9
    ids = [k for k, _ in fine]
    want = {k: (int(s.sum()) - 1, c, k == c) for k, s, c in zip(ids, sim, least_reachable(ids, sim), strict=True)}
    want |= {k: (0, k, True) for k, _ in rows if k not in want}
    assert len(got) == len(rows)
    assert sum(got[k][0] for k in got) >= 0.99 * sum(w[0] for w in want.values())
    assert sum(got[k] != want[k] for k in want) <= 2


def test_hot_buckets_are_dealt_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centre = unit(rng, 1, 16)[0]
    rows = [(k, (centre + rng.normal(scale=0.01, size=16)).tolist()) for k in range(300)]
    monkeypatch.setattr(vectors, "PART", 50)
    monkeypatch.setattr(vectors, "SAMPLED", 1)
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["component_id"] for r in got} == {0}
    assert {r["n_links"] for r in got} == {299}


def test_links_do_not_depend_on_how_vectors_travel(spark, monkeypatch):
    """One component of 600 vectors, whole in a task and bucket by bucket: a row gives the same."""
    rng = np.random.default_rng(8)
    centre = unit(rng, 1, 24)[0]
    rows = [(k, (centre + rng.normal(scale=0.06 + 0.03 * (k % 3), size=24)).tolist()) for k in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = np.array([r for _, r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = (x @ x.T >= 0.9).sum() - len(x)
    found = []
    for part in (2048, 100):
        monkeypatch.setattr(vectors, "PART", part)
        found.append(sorted(tuple(r) for r in vectors.near_vectors(df).collect()))
    assert found[0] == found[1]
    assert 0.97 * true <= sum(r[1] for r in found[0]) < true


@pytest.mark.parametrize("dim", [16, 64, 256, 768])
def test_recall_of_buckets(dim):
    """Pairs of one cosine exactly: how many share a bucket and pass by their signs."""
    rng, size = np.random.default_rng(dim), vectors.tables(50_000)
    x = unit(rng, 3000, dim)
    y = unit(rng, 3000, dim)
    y = y - (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    for cosine, least in ((0.9, 0.95), (0.91, 0.96), (0.95, 0.995)):
        z = cosine * x + np.sqrt(1 - cosine**2) * y
        met = (vectors._buckets(x, size) == vectors._buckets(z, size)).any(1)
        met &= np.bitwise_count(vectors._signs(x) ^ vectors._signs(z)).sum(1, dtype=int) <= vectors.SIGNS
        assert met.mean() >= least


def test_vectors_that_repeat_an_id(spark):
    """Two vectors of one vec_id are two members; a null vec_id is never the least."""
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.0, 1.0, 0.01]), (None, [1.0, 0.0, 0.01]), (None, [0.0, 0.0, 1.0])]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"] or 99, r["n_links"], r["component_id"] or 99) for r in got) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (99, 0, 99), (99, 1, 1)]


def test_empty_tables(spark, none):
    for f in (exact.exact_dedup, lines.line_dedup, substrings.substring_dedup, simhash.near_duplicates):
        assert f(none).count() == 0
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_extra_columns_and_repeated_rows(spark):
    """Columns that clash with those of the result are replaced or left alone; repeated rows stay."""
    rows = [(1, "a line of some length\nother", 7, "x"), (1, "a line of some length\nother", 8, "y"), (2, "a line of some length", 9, None), (None, "a line of some length", 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, pos string")
    got = lines.line_dedup(docs)
    assert got.columns == ["doc_id", "text", "pos", "n_lines", "n_dropped", "kept_text"]
    assert sorted((r["doc_id"] or 99, r["n_dropped"]) for r in got.collect()) == [(1, 0), (1, 0), (2, 1), (99, 1)]
    assert sorted((r["doc_id"] or 99, r["group_size"]) for r in exact.exact_dedup(docs).collect()) == [(1, 2), (1, 2), (2, 2), (99, 2)]
    assert simhash.near_duplicates(docs).count() == 4
    assert substrings.substring_dedup(docs).count() == 4


def test_columns_of_any_name(spark):
    """Names that the operators use within, names with dots, and names in other cases."""
    extra = ["__doc", "__version", "__flags", "__gone", "__own", "__rate", "__COPY", "a.b", "N_LINES"]
    rows = [(k, t, "en", *range(10 * k, 10 * k + len(extra))) for k, t in ((1, "a line of some length\nother"), (2, "a line of some length"), (3, None))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"`{c}` int" for c in extra))
    got = lines.line_dedup(docs)
    assert got.columns == [*docs.columns[:-1], "n_lines", "n_dropped", "kept_text"]
    assert sorted(tuple(r) for r in got.collect()) == [(*rows[0][:-1], 2, 0, rows[0][1]), (*rows[1][:-1], 1, 1, ""), (*rows[2][:-1], 1, 0, "")]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert {tuple(r) for r in mixed.collect()} <= set(rows)


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_matches_sql(spark, sf, name):
    same(queries.QUERIES[name](spark, sf), oracle.ORACLE[name], sf)


def test_simhash_query_against_plain_python(spark, sf):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert by_id(queries.op3_simhash_near_dedup(spark, sf), "fingerprint", "component_id") == plain_simhash(rows)


def test_substring_query_against_plain_python(spark, sf):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = {k: (a, b, hashlib.sha256(t.encode()).hexdigest()) for k, (a, b, t) in plain_substrings(rows).items()}
    assert by_id(queries.op2_substring_dedup(spark, sf), "n_words", "n_removed", "kept_sha256") == want


def test_keep_first_keeps_all_columns(odd):
    got = simhash.keep_first(odd.withColumn("source", F.lit("s")))
    assert got.columns == ["doc_id", "text", "source"]
    assert {r["doc_id"] for r in got.collect()} == {c for _, c in plain_simhash(ODD).values()}


def test_keep_first_with_null_ids_and_several_texts_of_one_id(spark):
    """Each text is kept by its own class; a null doc_id is the largest."""
    other, third = "words that no other document of this table has in it", "yet more words of a third text that stands alone"
    rows = [(None, other), (1, SENTENCE), (2, SENTENCE), (2, third), (None, third), (3, None), (None, "")]
    got = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 99, r["text"] or "") for r in got) == [(1, SENTENCE), (2, third), (3, ""), (99, other)]
    # two texts of one null doc_id in one class: one of them stays
    near = spark.createDataFrame([(None, "same words here"), (None, "same  words here")], "doc_id long, text string")
    assert simhash.keep_first(near).count() == 1


@pytest.mark.parametrize("bits", [exact.MOST_BITS, 50])
def test_exact_with_null_ids(spark, bits):
    rows = [(None, "a  b"), (1, "a b"), (2, "ab"), (3, "c"), (None, "c"), (None, "alone")]
    got = exact.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), bits).collect()
    assert sorted((r["doc_id"] or 99, r["keep_id"] or 99, r["group_size"], r["kept"]) for r in got) == [
        (1, 99, 3, False), (2, 99, 3, False), (3, 3, 2, True), (99, 3, 2, False), (99, 99, 1, True), (99, 99, 3, True)
    ]

"""Spelling variants, ranked search and language-model scores against plain Python over small and odd tables."""

import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from mosaikon.llm import lm, search, trie, variants


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def plain_variants(rows):
    n = Counter()
    for d, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = ascii_lower(r)
            h = 1 if d is None else zlib.crc32(f"{d}:{r}".encode())
            n[r[: h % len(r)] + r[h % len(r) + 1 :] if h % 31 == 0 else r] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near, less = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            v = w[:i] + w[i + 1 :]
            less[i, v].add(w)
            if v in n:
                near[w].add(v)
                near[v].add(w)
    for same in less.values():
        for a in same:
            near[a] |= same - {a}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def found_variants(docs):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in variants.spelling_variants(docs).collect()}


def some_words(seed):
    """Documents of few letters, so that most words are near others, some very frequent."""
    rng, rows = random.Random(seed), []
    stems = ["".join(rng.choice("abÀé") for _ in range(rng.randint(6, 12))) for _ in range(40)]
    for d in range(150):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = list(stems[min(int(rng.expovariate(0.2)), 39)])
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "é", "×"])
            words.append("".join(w).upper() if rng.random() < 0.2 else "".join(w))
        rows.append((d, rng.choice([" ", "\n", "1", "-"]).join(words)))
    return rows


ODD = [
    (1, None), (2, ""), (3, "1234567"), (None, "letters letters Letters lettersx lettersx"), (4, "aaaaaaa aaaaaaa aaaaaaaa aaaaaaaa aaaaaa"), (4, "aaaaaaa aaaaaaa aaaaaaaa aaaaaaaa aaaaaa"),
    (5, "x" * 600 + " " + "x" * 601), (6, "x" * 600 + " " + "x" * 601), (7, "Ünderwåy ünderwåy Ünderwåy Ünderwåx ünderwåx Ünderwåx"), (8, "letters " * 300), (9, "chained " * 300 + "chainex " * 25 + "chaimex " * 2),
]


@pytest.mark.parametrize("part", [8192, 3])
def test_variants_are_those_of_a_plain_version(spark, monkeypatch, part):
    monkeypatch.setattr(variants, "PART", part)
    monkeypatch.setattr(variants, "PAIRS", 50 if part == 3 else 1 << 20)
    monkeypatch.setattr(variants, "SAMPLED", 1 if part == 3 else 16)
    for rows in (some_words(1), some_words(2) + ODD):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        want = plain_variants(rows)
        assert found_variants(docs) == want


def test_variants_of_odd_tables(spark):
    assert found_variants(spark.createDataFrame([], "doc_id long, text string")) == {}
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in ODD], "doc_id long, text string, `a.b` string, word double")
    want = plain_variants(ODD)
    assert found_variants(docs) == want
    assert want["chaimex"][:2] == ("chainex", "chained")


def plain_search(docs, items):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    own = [(d, Counter(term.findall(ascii_lower(t or "")))) for d, t in docs]
    n_docs, total, df = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own), Counter(t for _, c in own for t in c)
    asked, out = defaultdict(set), []
    for i, t in items:
        asked[i] |= set(term.findall(ascii_lower(t or "")))
    for i, terms in asked.items():
        scores = []
        for d, c in own:
            m = 10 + 90 * sum(c.values()) * n_docs // max(total, 1)
            s = sum(int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df[t] + 1)))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(i, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(scores)[:10])]
    return Counter(out)


def some_texts(seed, n):
    rng = random.Random(seed)
    text = lambda most: " ".join(f"w{min(int(rng.expovariate(0.05)), 199)}" for _ in range(rng.randint(0, most)))
    rows = [(d, text(60)) for d in range(n)]
    return rows + [(d + n, t) for d, t in rows[:20]] + [(None, rows[3][1]), (4, rows[4][1]), (5000, None), (5001, ""), (5002, "-- . !"), (5003, "Ünïc0de W1 w1\x00W2, w3"), (5004, "w5 " * 9000)], [
        *((i, text(12)) for i in range(15)), (None, "w1 W2"), (3, "w7 w8"), (40, None), (41, ""), (42, "no such terms here"), (43, "ünïc0de Ünïc0de")]


@pytest.mark.parametrize("small", [False, True])
def test_search_ranks_as_a_plain_version_does(spark, monkeypatch, small):
    if small:  # many segments of one to a few documents, many blocks, an index of all terms
        for name, value in (("SEGMENT_BYTES", 700), ("BLOCK_PAIRS", 30), ("MOST_TERMS", 5), ("ROWS", 7)):
            monkeypatch.setattr(search, name, value)
    docs, items = some_texts(5, 1500 if not small else 150)
    got = search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect())) == plain_search(docs, items)


def test_search_opens_only_some_ranges(spark, monkeypatch):
    """A rare term in one document: the ranges without it are never opened."""
    opened = []
    monkeypatch.setattr(search._Segment, "_open", lambda self, *a, f=search._Segment._open: opened.append(a[2:]) or f(self, *a))
    texts = [["common"] * (k % 7 + 1) + ["filler"] * (k % 11) + (["rare"] if k == 4000 else []) for k in range(6000)]
    names = [b"common", b"filler", b"rare"]
    owner, term = np.repeat(np.arange(6000), [len(t) for t in texts]), np.array([names.index(w.encode()) for t in texts for w in t])
    rows = list(search._trees(0, list(range(6000)), np.array([len(t) for t in texts]), owner, term, names, 6000, len(term)))
    import pyarrow as pa

    segment = search._Segment(pa.Table.from_batches(rows))
    got = segment.best([("rare", 9000), ("common", 300)], 1)
    assert [segment.ids[p].as_py() for _, p in got] == [4000]
    assert len(opened) < 20


def test_search_of_empty_tables(spark):
    docs, items = (spark.createDataFrame([], f"{c} long, text string") for c in ("doc_id", "item_id"))
    some = spark.createDataFrame([(1, "a b", 2.0, 3)], "doc_id long, text string, rank double, `x.y` int")
    asked = spark.createDataFrame([(1, "a", 2.0, 3)], "item_id long, text string, doc_id double, term int")
    assert search.search(docs, asked).count() == 0
    assert search.search(some, items).count() == 0
    assert [tuple(r)[:3] for r in search.search(some.unionByName(some), asked).collect()] == [(1, 1, 1), (1, 2, 1)]


def plain_scores(rows):
    """By row: held_out, n_tokens, n_known, train_tokens, base_score, score."""
    texts = [(d, d is not None and zlib.crc32(str(d).encode()) % 10 == 0, ["\n", "\n", *re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t or "")), ""]) for d, t in rows]
    c1, c2, c3, t2, t3 = (Counter() for _ in range(5))
    for _, held, w in texts:
        for a, b, c in zip(w, w[1:], w[2:], strict=False) if not held else ():
            c1[c] += 1
            c2[b, c] += 1
            c3[a, b, c] += 1
            t2[b] += 1
            t3[a, b] += 1
    total, out = sum(c1.values()), []
    for d, held, w in texts:
        base = score = known = 0
        for a, b, c in zip(w, w[1:], w[2:], strict=False):
            p1 = (c1[c] + 0.1) / (total + 0.1 * (len(c1) + 1))
            p2 = (c2[b, c] + lm.MU2 * p1) / (t2[b] + lm.MU2)
            base, known = base + np.log10(p1), known + (c1[c] > 0)
            score += np.log10((c3[a, b, c] + lm.MU3 * p2) / (t3[a, b] + lm.MU3))
        out.append((d if d is not None else -1, held, len(w) - 2, known, total, base, score))
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_scores_are_those_of_a_plain_version(spark, monkeypatch, small):
    if small:  # many segments, many shards, and most contexts dealt out
        for name, value in (("SEGMENT", 500), ("SEGMENT_DOCS", 9), ("SHARD", 900), ("HOT", 100), ("SAMPLED", 1)):
            monkeypatch.setattr(lm, name, value)
    rows = some_texts(7, 300)[0] + [(6000 + k, "same words again and again " * 20) for k in range(12)] + [(7000, "no one knows these words"), (7010, "Ä ä A a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if small:
        assert len(lm._hot_contexts(lm.segments(docs), 10_000)[0]) > 5
    got = sorted((-1 if r[0] is None else r[0], *tuple(r)[1:]) for r in lm.scores(docs).collect())
    want = plain_scores(rows)
    key = lambda r: (*r[:4], round(r[5], 6))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    assert np.allclose([r[6] for r in got], [r[6] for r in want], rtol=3e-3)


def test_scores_of_odd_tables(spark):
    assert lm.scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 10 == 0)
    docs = spark.createDataFrame([(held, "only a held-out text", 1.0, 2)], "doc_id long, text string, score double, `n.b` int")
    ((_, out, n, known, tokens, base, score),) = map(tuple, lm.scores(docs).collect())
    assert (out, n, known, tokens) == (True, 5, 0, 0)
    assert abs(base) < 1e-9 and abs(score) < 1e-4  # one slot for all that is unknown


def test_sequences_and_tries_give_back_what_was_put_in():
    rng = np.random.default_rng(3)
    for n, universe in ((0, 0), (1, 1), (1, 5), (10, 10**12), (1000, 1000), (5000, 10**9), (3000, 200), (70_000, 10**13)):
        v = np.sort(rng.integers(0, universe + 1, n))
        e = trie.EliasFano(v, universe + 1)
        assert (e[np.arange(n)] == v).all()
        assert (e.stretch(n // 3, n) == v[n // 3 :]).all()
        assert (lm.unpack(lm.pack(v, v[:1]))[0] == v).all()
    for order in (2, 3):
        grams = np.unique(np.minimum(rng.zipf(1.3, (30_000, order)), 999), axis=0)
        contexts, owner = np.unique(grams[:, :-1], axis=0, return_inverse=True)
        share, rest, held = rng.uniform(1e-6, 1, len(grams)), rng.uniform(0.01, 1, len(contexts)), rng.random(len(grams)) < 0.6
        seen = np.unique(owner[held])
        t = trie.Trie(contexts[seen], grams[held, -1], np.searchsorted(seen, owner[held]), share[held], rest[seen], 1000)
        s, r = t.find(contexts, grams[:, -1], owner, 777)
        assert np.allclose(trie.meaning(s), np.where(held, share, 0), rtol=7e-3)
        assert np.allclose(trie.meaning(r), np.where(np.isin(np.arange(len(contexts)), seen), rest, 0), rtol=7e-3)


def test_a_shard_is_answered_some_middle_words_at_a_time(monkeypatch):
    """What a shard holds at once beside what it was sent goes by STEP; the answers don't."""
    rng = np.random.default_rng(8)
    words = lm._pack_words([b"", b"\n", *(b"w%d" % k for k in range(5000))])
    rows = []
    for k in range(2):
        tokens = np.r_[rng.integers(2, 5002, 150_000), 0]
        rows.append((k, [k], len(tokens), lm.pack(np.array([len(tokens)]), np.array([1]), tokens), words))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["segment", "ids", "n", "blob", "words"])
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sent = pa.Table.from_batches(list(lm._ask(1, none[0])([batch])))
    got, peak = {}, {}
    for step in (20_000, 10**9):
        monkeypatch.setattr(lm, "STEP", step)
        tracemalloc.start()
        got[step] = lm._answer(*none)(sent)["blob"].to_pylist()
        peak[step] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert got[20_000] == got[10**9]
    assert peak[20_000] < 0.5 * peak[10**9]

"""Spelling variants: words one edit apart, found by cutting them in two even parts.

A word of l letters is cut behind its first l // 2.  One edit leaves one of the parts whole, so a word that is one edit
away, of l letters or l + 1, begins with the first part or ends with the second: the first is looked for at the
beginning of a word and the second at its end, which in a word one longer stands a place further on.  Rows:

    part of a word of l letters  x  beginning and end of the words of l and l + 1 letters

Words that meet on a part are compared in the task where they meet.  There what is left of them is cut in two again, by
the same argument, so that only those that share three quarters of a word are looked at letter by letter.  A part that
many words share is dealt out as pairs of shares.  No pair leaves a task: for each word its number of near words and the
best of them go on, which are added up afterwards.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dealt, mix64, one_in, run_starts, scratch, whole_runs

#: Shorter words are no words here, and rarer ones aren't either.
LEAST_LETTERS, LEAST_N = 7, 2
#: A run of letters whose hash this number divides loses a letter.
SPOILT = 31
#: How many times more frequent the form of a word has to be.
TIMES = 10
#: Words of a share of a frequent part, and one in how many words tells which parts are frequent.
PART, SAMPLED = 8192, 16
#: Runs that a task counts before it passes them on, and pairs it looks at together.
HELD, PAIRS = 400_000, 1 << 20
#: Following forms: each is at least ten times as frequent as the one before, so 19 steps reach the last one.
ROUNDS = 5

_RUN = re.compile(r"[A-Za-zÀ-ÿ]{7,}")


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for b in batches:
        for d, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
            if not text.is_valid:
                continue
            crc = None if d is None else zlib.crc32(f"{d}:".encode())
            for run, n in Counter(_RUN.findall(text.as_py().lower().decode())).items():
                if crc is not None and (h := zlib.crc32(run.encode(), crc)) % SPOILT == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                    if len(run) < LEAST_LETTERS:
                        continue
                held[run] += n
            if len(held) > HELD:
                yield out()
                held.clear()
    if held:
        yield out()


def count_words(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (word, n): runs of letters, lower-cased from A to Z, of at least LEAST_LETTERS and found LEAST_N times.

    A run whose crc32 of "doc_id:run" SPOILT divides loses the letter at that hash modulo its length.  With a null
    doc_id there is nothing to hash, and the run stays.  Null and empty texts have no words.
    """
    # bytes.lower() takes A to Z alone
    each = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(_words, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_N)


def _meeting_rows(words: DataFrame) -> DataFrame:
    """key, l, front, longer, word, n: each word under its two parts, and under those of words one shorter."""
    long = F.char_length("word")

    def rows(l, longer: bool):
        first = (l / 2).cast("int")
        return [
            F.struct(
                F.xxhash64(l, F.lit(front), F.substring("word", F.lit(1), first) if front else F.substring("word", long - (l - first) + 1, l - first)).alias("key"),
                l.alias("l"), F.lit(front).alias("front"), F.lit(longer).alias("longer"),
            )
            for front in (True, False)
        ]

    shorter = F.when(long > LEAST_LETTERS, F.array(*rows(long - 1, True))).otherwise(F.array())
    return words.select("word", "n", F.explode(F.concat(F.array(*rows(long, False)), shorter)).alias("row")).select("row.*", "word", "n")


def _pairs(h: np.ndarray, longer: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i, j with equal h, in blocks; i is never a longer word, and no pair comes twice."""
    order = np.lexsort((longer, h))
    starts, sizes = run_starts(h[order])
    after = np.repeat(starts + sizes, sizes) - np.arange(len(h)) - 1
    after[longer[order]] = 0
    upto = np.cumsum(after)
    a = 0
    while a < len(h):
        base = upto[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(upto, base + PAIRS, side="right")))
        i = np.repeat(np.arange(a, b), after[a:b])
        j = i + 1 + np.arange(len(i)) - np.repeat(upto[a:b] - after[a:b] - base, after[a:b])
        if len(i):
            yield order[i], order[j]
        a = b


def _near(rest: np.ndarray, m: int, i: np.ndarray, j: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Whether rests i (m letters) and j (m or m + 1) are one edit apart."""
    same = rest[i, :m] == rest[j, :m]
    ok = same.sum(1) == m - 1
    k = np.flatnonzero(longer[j])
    if len(k):
        front = np.where(same[k].all(1), m, same[k].argmin(1))
        back = (rest[i[k], :m] == rest[j[k], 1 : m + 1])[:, ::-1]
        ok[k] = front + np.where(back.all(1), m, back.argmin(1)) >= m
    return ok


def _links(t: dict, l: int, front: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of words one edit apart among rows of one l and one kind of part."""
    longer, side, run = t["longer"], t["side"], t["run"]
    letters = t["word"].astype(f"U{l + 1}").view(np.uint32).reshape(len(run), l + 1)
    m = l - l // 2 if front else l // 2
    rest = letters[:, l // 2 :] if front else letters[:, : m + 1].copy()
    if not front:
        rest[~longer, m] = 0
    half, base, found = m // 2, mix64(run.astype(np.uint64) + np.uint64(1)), []
    ends = np.where(longer[:, None], rest[:, half + 1 : m + 1], rest[:, half:m])
    for k, shared in enumerate((rest[:, :half], ends)):
        powers = np.multiply.accumulate(np.full(max(1, shared.shape[1]), 0xD1342543DE82EF95, np.uint64))[: shared.shape[1]]
        for i, j in _pairs(mix64(base + (shared.astype(np.uint64) * powers).sum(1, dtype=np.uint64)), longer):
            meet = (run[i] == run[j]) & ((side[i] == 2) | (side[i] != side[j]))
            i, j = i[meet], j[meet]
            ok = _near(rest, m, i, j, longer)
            if k:  # found by their first quarters before
                ok &= ~(rest[i, :half] == rest[j, :half]).all(1)
            if not front:  # found by their first parts elsewhere
                ok &= ~(rest[i, :m] == rest[j, :m]).all(1)
            found.append((i[ok], j[ok]))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (list(zip(*found, strict=True)) or ((), ())))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by l, kind and part.  Out: word, n_near and the most frequent near word of each that has any."""
    keys = ("l", "front", "key", "part_a", "part_b")
    for table in whole_runs(batches, keys):
        cols = [table.column(c).to_numpy() for c in keys]
        starts, sizes = run_starts(*cols)
        run = np.repeat(np.arange(len(starts)), sizes)
        for s, size in zip(*run_starts(cols[0], cols[1]), strict=True):
            part = table.slice(s, size)
            t = {c: part.column(c).to_numpy() for c in ("longer", "side", "n")} | {"word": np.array(part.column("word").to_pylist()), "run": run[s : s + size]}
            i, j = _links(t, int(cols[0][s]), bool(cols[1][s]))
            if not len(i):
                continue
            i, j = np.r_[i, j], np.r_[j, i]
            rank = np.unique(t["word"][j], return_inverse=True)[1]
            order = np.lexsort((rank, -t["n"][j], i))
            i, j = i[order], j[order]
            at, many = run_starts(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(t["word"][i[at]], pa.string()), pa.array(many, pa.int64()), pa.array(t["word"][j[at]], pa.string()), pa.array(t["n"][j[at]], pa.int64())], ["word", "n_near", "near", "near_n"]
            )


def near_words(words: DataFrame) -> DataFrame:
    """words(word, n), each word once -> word, n_near, near (the most frequent near word, of equal ones the first), near_n.

    Words without a near one don't appear.
    """
    rows, few = _meeting_rows(words), _meeting_rows(words.where(one_in("word", SAMPLED)))
    keys = ["l", "front", "key", "part_a", "part_b"]
    met = dealt(rows, few, SAMPLED, "key", "word", PART).repartition("key", "part_a", "part_b").sortWithinPartitions(*keys)
    found = met.mapInArrow(_compare, "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """forms(word, form) -> word, root: the last of the forms that follow one another."""
    reach = forms.withColumnRenamed("form", "root")
    for _ in range(ROUNDS):
        on = reach.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        reach = scratch(reach.join(on, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("__moved")), "roots")
        if reach.where("__moved").isEmpty():
            break
        reach = reach.drop("__moved")
    return reach.select("word", "root")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> word, n, n_near, form, form_n, root: a row for each word that count_words() finds.

    Two words are near if exactly one inserted, deleted or replaced code point makes one of the other.  A word's form is
    its near word of largest n, of equal ones the first in code-point order, if that is TIMES as frequent; form and
    form_n are null otherwise.  root follows forms to the last, and is the word itself where it has none.  Null and
    empty texts have no words; repeated rows count again; other columns are ignored; an empty table gives none.
    """
    words = scratch(count_words(docs), "words")
    near = near_words(words)
    joined = words.join(near, "word", "left")
    is_form = F.col("near_n") >= TIMES * F.col("n")
    table = scratch(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")),
        "forms",
    )
    roots = _roots(table.where("form is not null").select("word", "form"))
    return table.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

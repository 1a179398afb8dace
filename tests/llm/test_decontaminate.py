"""Template windows by hash join against brute force, bare placeholders, long tables of figures."""

import collections
import itertools
import re
import time

import numpy as np
import pytest

pytest.importorskip("gridloom.llm")
from gridloom.llm import decontaminate as dc  # noqa: E402

SF = "/root/testdata/sf0.001"


def words_of(text):
    """(said, kind) of each word, and whether it may be a name; kinds: num, unit, name, None."""
    out, start = [], True
    for w in (text or "").split():
        c = dc.core(w)
        said = c.lower() or w
        kind = "num" if c and dc.NUMBER.fullmatch(c) else "unit" if c.lower() in dc.UNITS and c else None
        name = kind is None and bool(c) and c[0].isupper() and c[1:].islower()
        out.append((said, "name" if name and not start else kind, name and start))
        start = w.rstrip("\"')]»”")[-1:] in (".", "!", "?", ":") and bool(w.rstrip("\"')]»”"))
    return out


def windows_of(words, size):
    """(window, place, plain) in all readings."""
    for p in range(len(words) - size + 1):
        own = words[p : p + size]
        poor = False
        for names in itertools.product(*[(False, True) if e else (False,) for _, _, e in own]):
            kinds = ["name" if n else k for (_, k, _), n in zip(own, names, strict=True)]
            if kinds.count(None) < min(dc.LITERALS, size):
                poor = True
            else:
                yield tuple(f"<{k}>" if k else s for (s, _, _), k in zip(own, kinds, strict=True)), p, not any(names)
        if poor:
            yield ("=", *[s for s, _, _ in own]), p, True


def holds(doc, item, size):
    mine = collections.defaultdict(list)
    for w, p, plain in windows_of(item, size):
        mine[w].append((p, plain))
    hits = [(d, p, plain and own) for w, d, plain in windows_of(doc, size) for p, own in mine.get(w, ())]
    places, slack = len(item) - size + 1, int(dc.SLACK * len(item))
    sure = {s for s, k, _ in item if k == "name"}
    for names in (True, False):
        some = [(d, p) for d, p, plain in hits if names or plain]
        for base, _ in sorted(collections.Counter(d - p for d, p in some).items(), key=lambda x: (-x[1], x[0])):
            near = sorted({x for x in some if abs(x[0] - x[1] - base) <= slack}, key=lambda x: (abs(x[0] - x[1] - base), x[0] - x[1], x[1]))
            best = {}
            for d, p in near:
                best.setdefault(p, d - p)
            if len(best) < dc.SIMILARITY * places:
                continue
            order = sorted(best, key=lambda p: (abs(best[p] - base), best[p], p))
            shift = {}
            for reach in (range(size), [*range(1 - dc.WINDOW, 0), *range(size, 2 * dc.WINDOW - 1)]):
                for p in order:
                    for o in reach:
                        if 0 <= p + o < len(item) and 0 <= p + o + best[p] < len(doc):
                            shift.setdefault(p + o, best[p])
            pairs = set()
            for q, s in shift.items():
                (a, k, e), (b, m, f) = item[q], doc[q + s]
                k = "name" if e and (names or a in sure) else k
                if k and (k == m or (k == "name" and f)):
                    pairs.add((a, b))
            if len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}):
                return True
    return False


def leaks_of(docs, items):
    out = set()
    own = [(i, words_of(t)) for i, t in items]
    for d, text in docs:
        words = words_of(text)
        here = set(text.lower().split()) if text else set()
        for i, item in own:
            if item and words and (len(item) < 20 or len({s for s, k, _ in item if k is None and len(s) > 3} & {dc.core(w) for w in here}) > 2):
                if holds(words, item, min(dc.WINDOW, len(item))):
                    out.add((d, i))
    return out


def found(spark, rows, items):
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in dc.leaks(docs.withColumn("hash", docs["doc_id"]), bench.withColumn("doc", bench["item_id"])).collect()}


def test_against_brute_force(spark):
    """Whole tables, and texts made of the items by other numbers, names, words, orders and ends."""
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rng = np.random.default_rng(6)
    for k, (_, t) in enumerate(items):
        w = t.split()
        docs.append((10_000 + k, "before it. " + re.sub(r"\d+", lambda m: str(int(m[0]) + 1), t) + " and after"))
        docs.append((20_000 + k, "x " + re.sub(r"\d+", lambda m: str(rng.integers(0, 9)), t) + " y"))
        docs.append((30_000 + k, " ".join(w[len(w) // 2 :] + w[: len(w) // 2])))
        docs.append((40_000 + k, " ".join(x for x in w if rng.random() > 0.04)))
        docs.append((50_000 + k, re.sub(r"\b[A-Z][a-z]+\b", lambda m: f"Q{m[0].lower()}", t)))
        docs.append((60_000 + k, " ".join(w[3:])))
    want = leaks_of(docs, items)
    assert found(spark, docs, items) == want and len(want) > 100


def test_bare_placeholders(spark):
    """Figures, units and names alone match equal ones only."""
    items = [(1, "1 2 3 4 5"), (2, "12 cm 5 kg 3 m"), (3, "Anna Berta Carla Dora Emma"), (4, "7"), (5, "the Anna of 5 cm")]
    docs = [(1, "sales 2019 2020 2021 2022 2023 were up"), (2, "prices 7 9 11 13 15 are"), (3, "call 01 42 68 53 00 now"), (4, "so 4 mm 9 g 2 km it is"), (5, "see Otto Paul Karl Hans Emil there"), (6, "we saw 8 of them")]
    exact = [(11, "he said 1 2 3 4 5 and left"), (12, "take 12 cm 5 kg 3 m of"), (13, "with Anna Berta Carla Dora Emma there"), (14, "page 7 of it"), (15, "see the Otto of 9 mm there")]
    assert found(spark, docs, items) - {(2, 4)} == set() and found(spark, docs, items) == leaks_of(docs, items)
    assert found(spark, exact, items) == {(11, 1), (12, 2), (13, 3), (14, 4), (15, 5)} == leaks_of(exact, items)


def test_figures_take_time_by_their_number(spark):
    """10,000 numbers against an item of 300: under a second, as are the hits of a text that repeats an item's template all along."""
    item = " ".join(str(1000 + k) for k in range(300)).encode().split()
    text = " ".join(str(k * 7) for k in range(10_000)).encode().split()
    known, wanted = (dc.Filter(np.zeros(1 << 20, bool)) for _ in range(2))
    known.add(np.array([dc.word_hash(w.decode()) for w in item], np.uint64))
    wanted.add(dc.found_windows(item, dc.Words(), [5])[0])
    began = time.perf_counter()
    hits = dc.found_windows(text, dc.Words(), [5], known, wanted)
    assert time.perf_counter() - began < 1 and len(hits[0]) < 100
    there, here = np.repeat(np.arange(2000), 60), np.tile(np.arange(60), 2000)
    slots, own = (((x[:, None] + dc._AROUND) % n) << 3 | 1 for x, n in ((there, 50), (here, 7)))
    began = time.perf_counter()
    assert dc.aligned(there, here, slots, own, 60, 64, True) is None and time.perf_counter() - began < 3


def test_odd_rows(spark):
    items = [(None, "the quick brown fox jumps over it"), (1, "the quick brown fox jumps over it"), (1, None), (2, ""), (3, " \n")]
    docs = [(1, "so the quick brown fox jumps over it again"), (1, "so the quick brown fox jumps over it again"), (None, "the quick brown fox jumps over it"), (4, None), (5, ""), (6, "the quick " * 30_000)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(repr, ((r["doc_id"], r["item_id"]) for r in dc.leaks(df, bench).collect())))
    assert got == sorted(map(repr, [(1, None), (1, 1)] * 2 + [(None, None), (None, 1)]))
    kept = dc.clean(df.withColumn("row", df["doc_id"]).withColumn("mark", df["text"]), bench)
    assert kept.columns == ["doc_id", "text", "row", "mark"] and sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 6]
    assert dc.leaks(df, bench.limit(0)).count() == dc.leaks(df.limit(0), bench).count() == dc.clean(df.limit(0), bench).count() == 0 and dc.clean(df, bench.filter("item_id = 2")).count() == 6


def test_one_scan_and_no_closure_of_items(spark):
    plan = dc.leaks(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"))._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "FlatMapGroupsInArrow" in plan

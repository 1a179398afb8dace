"""Each operator against a brute-force version on the small tables, and on awkward rows."""

import collections
import hashlib
import html
import re

import duckdb
import numpy as np
import pytest

pytest.importorskip("gridloom.llm")
from gridloom.llm import bpe, decontaminate, html_extract, licenses, near_dedup, pii, quality, substring_dedup, token_files, toxicity  # noqa: E402
from gridloom.llm.queries import tokenizer_path  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()


@pytest.fixture
def frame(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture
def odd(spark):
    """Nulls, empty and blank texts, repeated rows, a long text, a clashing column."""
    rows = [(1, None, "a"), (2, "", "b"), (3, " \t\n", None), (4, "x" * 5000, "c"), (4, "x" * 5000, "c"), (None, "no id", "d"), (5, "1 " * 5000, "e")]
    return spark.createDataFrame(rows, "doc_id long, text string, words string")


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")


def test_quality(spark, docs, frame, odd, labels):
    got = {r["doc_id"]: r for r in quality.score(frame, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    for d, t in docs:
        w = re.findall(r"[^ \t-\r]+", t)
        c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cov = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        r = got[d]
        lines = [x for x in t.split("\n") if re.search(r"[^ \t-\r]", x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(cov))
        assert (r["n_symbols"], r["n_dup_lines"]) == (len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)))
        assert r["kept"] == (not r["base_failed"] and r["score"] >= quality.Params().threshold)
        assert r["base_failed"] == (len(w) < 10 or 100 * len(cov) > 20 * len(w))
        assert not (r["kept"] and r["base_failed"])
    grams, target = [collections.Counter(), collections.Counter()], {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    for d, t in docs:
        w = re.findall(r"[^ \t-\r]+", t)
        own = [*w, *zip(w, w[1:])]
        grams[0].update(own)
        grams[1].update(own if d in target else [])
    # without buckets: hashing moves the score a little
    size = [sum(g.values()) + 10_000 for g in grams]
    ratio = lambda g: np.log((grams[1][g] + 1) / size[1]) - np.log((grams[0][g] + 1) / size[0])
    plain = {d: np.mean([ratio(g) for g in [*w, *zip(w, w[1:])]]) for d, t in docs if len(w := re.findall(r"[^ \t-\r]+", t)) >= 10}
    assert np.corrcoef([plain[d] for d in plain], [got[d]["score"] for d in plain])[0, 1] > 0.8
    assert {(r["doc_id"], r["n_words"], r["base_failed"], r["kept"]) for r in quality.score(odd, labels).collect()} == {(1, 0, True, False), (2, 0, True, False), (3, 0, True, False), (4, 1, True, False), (None, 2, True, False), (5, 5000, True, False)}
    assert quality.score(odd.limit(0), labels.limit(0)).count() == 0


def test_html():
    page = "<body><nav><a href=x>Home page</a></nav><div class='sidebar'><p>The side of the page is not the text.</p></div><article><h1>A &amp; B</h1><p>One <b>two</b>\n three<p>Four</article><div id=comments><p>I am the first one.</p></div><footer>The end of it</footer>"
    assert html_extract.main_text(page) == "A & B One two three Four"
    assert html_extract.main_text(None) == html_extract.main_text("") == ""
    assert html_extract.main_text("<script>var x='<p>no'</script><p>" + "this is the text of the page and it is long enough to be good " * 4) .startswith("this is")


def _article(page):
    """Brute force: what stands in a page's one article element."""
    inner = re.search(r"<article[^>]*>(.*)</article>", page, re.S)[1]
    inner = re.sub(r"<script.*?</script>|<style.*?</style>|<!--.*?-->", "", inner, flags=re.S)
    return " ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|br|h1)\b[^>]*>", " ", inner))).split())


def test_html_against_labelled_pages(spark):
    pages = duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet' order by page_id").fetchall()
    bare = lambda t: t.replace("<article>", "<div>").replace("</article>", "</div>")
    teaser = lambda t: bare(t).replace("<footer>", "<article><h2><a href=x>Other story</a></h2><p>What it is of and how that was.</p></article><footer>")
    for change, least in ((lambda t: t, 1.0), (lambda t: t.replace('<div class="ad">', "<div>"), 0.995), (bare, 0.93), (teaser, 0.9)):
        recall, precision = [], []
        for (page,) in pages:
            got, want = (collections.Counter(x.split()) for x in (html_extract.main_text(change(page)), _article(page)))
            both = sum((got & want).values())
            recall.append(both / sum(want.values()))
            precision.append(both / max(1, sum(got.values())))
        assert np.mean(recall) >= least and np.mean(precision) >= least, (least, np.mean(recall), np.mean(precision))


def test_html_neighbours():
    good = "This is what we have to say of it and that was all that there is in the story of the day. " * 3
    near = "And this was the rest of it, that we have to say, as it is"
    p = lambda *x: "".join(f"<p>{y}</p>" for y in x)
    text = html_extract.main_text
    assert text(f"<body><ul><li><a href=a>Go there</a></ul><div>{p(good, 'Short one.', good)}</div></body>") == " ".join([good.strip(), "Short one.", good.strip()])
    assert text(f"<body>{p(good)}<div>{p('<a href=b>More of it here</a>', 'Stray.', '<a href=b>And more of it</a>')}</div></body>") == good.strip()
    assert text(f"<article>{p(good)}<p class='search'>{near}</p><p class='tags'>Few words</p></article>") == f"{good.strip()} {near} Few words"
    assert text(f"<article>{p(good)}<div class='social'>{p('Share it')}</div><form>{p(good)}</form></article><div class='comments'>{p(good)}</div>") == good.strip()
    assert text(f"<div class=content>{p(good, good, near)}</div><article><h2>Teaser</h2>{p('Read it.')}</article>") == f"{good.strip()} {good.strip()} {near}"
    assert text("<p>Only this.</p>") == "Only this." and text("<a href=x>Only a link</a>") == ""


def test_html_rows(spark, odd):
    rows = [(1, "u", None, 1), (2, None, "", 2), (None, "u", "<p>a</p>", 3), (2, "u", "<p>b &amp; c</p><!-- x", 4), (2, "u", "<p>b &amp; c</p><!-- x", 4)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted([(r["page_id"] or 0, r["url"], r["text"], r["n_chars"]) for r in got], key=str) == sorted([(1, "u", "", 0), (2, None, "", 0), (0, "u", "a", 1), (2, "u", "b & c", 5), (2, "u", "b & c", 5)], key=str)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_licenses(spark, odd):
    rows = [(1, "Licensed under CC-BY 4.0. All rights reserved. cc\nby"), (2, "The GNU General Public License, version 3"), (3, "permit by law")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (3, 2, 9, "cc-by,reserved")
    assert got[2]["base_labels"] == "gpl" and "gpl" in got[2]["labels"] and (got[3]["n_base"], got[3]["first_word"], got[3]["score"]) == (0, None, 0.0)
    assert licenses.scan(odd).count() == 7
    assert len(licenses.rules()) > 200


def test_license_suppression(spark):
    """Brute force: a detection falls if another one of the same or a higher priority holds it."""
    texts = [
        "All rights reserved. Licensed under the MIT License, version 2.0 without warranty of any kind", "Alle Rechte vorbehalten, ohne Gewähr", "Tous droits réservés, sous licence libre", "todos los derechos reservados sin garantía",
        "released under the terms of the GNU General Public License version 3 or the mit license", "copyright 2020-2021 x copyright (c) 1999 y public domain, placed in the public domain", "nothing of it", "",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["detections"] for r in licenses.scan(rows).collect()}
    for d, text in enumerate(texts):
        low = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        found = sorted((m.start(), -m.end(), r.priority, r.label, r.weight) for r in licenses.rules() for m in re.finditer(r.pattern, low))
        stand = [x for k, x in enumerate(found) if not any(-y[1] >= -x[1] and y[2] <= x[2] for y in found[:k])]
        assert [(x["s"], -x["e"], x["label"], x["weight"]) for x in got[d]] == [(a, b, label, w) for a, b, _, label, w in stand], text
    labels = lambda d: {x["label"] for x in got[d]}
    assert labels(1) == {"reserved", "no-warranty"} and labels(2) == {"reserved", "license-notice"} and labels(3) == {"reserved", "no-warranty"} and {"gpl", "mit"} <= labels(4)


def test_license_keywords_are_in_every_match(spark):
    plain = lambda p: re.sub(r"\\(.)", r"\1", re.sub(r"\[(.)[^]]*\]", r"\1", re.sub(r"\(\?:([^)|]*)[^)]*\)\??", r"\1", p)))
    short = lambda p: plain(re.sub(r"\(\?:[^)]*\)\?", "", p))
    want = [(label, f(name)) for label, _, names in licenses.FAMILIES for name in names for f in (plain, short)]
    texts = [f"x {head}{name.upper()} y" for _, name in want for head in ("released under the ", "licensed under ", "covered by ", "")]
    texts += ["in the\npublic  domain", "all rights\nreserved", "provided as-is", "permission\nis hereby granted, free of charge, to any person obtaining a copy", "under CC\nBY"]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, (label, _) in enumerate(want):
        assert all(label in got[4 * i + k]["labels"].split(",") and got[4 * i + k]["score"] >= 0.6 for k in range(4)), texts[4 * i]
    assert [got[4 * len(want) + k]["labels"] for k in range(5)] == ["public-domain", "reserved", "no-warranty", "mit", "cc-by"]
    for r in licenses.rules():
        assert not re.search(r"\s", r.keyword + r.also)
        assert all(r.keyword in m.group() and r.also in m.group() for t in texts for m in re.finditer(r.pattern, t.lower()))


def test_near_duplicates(spark, docs, frame, odd):
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(frame).collect()}
    sets = [near_dedup.elements(t, 5) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if docs[i][1] == docs[j][1] or len(sets[i]) and near_dedup.jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert got == {d: docs[find(i)][0] for i, (d, _) in enumerate(docs)}
    assert near_dedup.classes(odd).count() == 7
    assert near_dedup.one_of_each(odd).columns == odd.columns


def _edited(rnd, words, k):
    out = list(words)
    for i in rnd.choice(len(words), k, replace=False):
        out[i] = f"w{rnd.integers(10**9)}"
    return " ".join(out)


def _linked_components(texts):
    """Brute force: the least index of each text's component, and the linked pairs with their similarity."""
    sets = [set(collections.Counter(zip(*[t.split()[i:] for i in range(5)])).items()) for t in texts]  # no shingle occurs twice here
    label, links = list(range(len(texts))), []
    for i in range(len(texts)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same >= 0.8 * (len(sets[i]) + len(sets[j]) - same):
                links.append((j, i, same / (len(sets[i]) + len(sets[j]) - same)))
    for a, b, _ in links:
        label = [label[a] if x == label[b] else x for x in label] if label[a] < label[b] else [label[b] if x == label[a] else x for x in label]
    return label, links


def test_near_duplicate_recall(spark):
    """600 planted pairs between 0.8 and 0.9, and a group of near copies at all distances from its centre, without the centre."""
    rnd = np.random.default_rng(7)
    texts = []
    while len(texts) < 1200:
        words = [f"v{rnd.integers(10**9)}" for _ in range(rnd.integers(60, 300))]
        pair = [" ".join(words), _edited(rnd, words, max(1, round(len(words) * rnd.uniform(0.012, 0.021))))]
        same = len(a := set(zip(*[pair[0].split()[i:] for i in range(5)]))) and len(a & (b := set(zip(*[pair[1].split()[i:] for i in range(5)])))) / len(a | b)
        if 0.8 <= same < 0.9:
            texts += pair
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = sum(got[i] == got[i + 1] for i in range(0, 1200, 2))
    assert found >= 0.95 * 600 and all(got[i] == i for i in range(0, 1200, 2))
    base = [f"u{i}" for i in range(150)]
    group = [_edited(rnd, base, k) for k in rnd.choice([1, 1, 1, 2, 2, 2, 3, 4, 5, 6, 8, 12], 260)]
    label, links = _linked_components(group)
    rows = near_dedup.classes(spark.createDataFrame(list(enumerate(group)), "doc_id long, text string")).collect()
    got = {r["doc_id"]: r["class_id"] for r in rows}
    assert sum(got[a] == got[b] for a, b, _ in links) >= 0.99 * len(links)
    assert all(got[i] == got[j] for i in range(260) for j in range(260) if label[i] == label[j] and i < j) and len(set(got.values())) == len(set(label))
    assert all((r["n_links"] > 0) == (label.count(label[r["doc_id"]]) > 1) for r in rows)


def test_one_of_each_keeps_one_row_a_class(spark, docs, frame):
    words = [f"{k} {i}" for k in "abcdef" for i in range(40)]
    text = lambda k: " ".join(words[40 * k : 40 * k + 40])
    near = text(5) + " end"
    rows = [(None, text(0)), (None, text(1)), (None, text(1)), (None, text(2)), (7, text(3)), (7, text(4)), (9, text(5)), (8, near), (None, near), (None, ""), (None, None), (None, "one"), (7, text(3))]
    kept = near_dedup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == sorted([(0, text(0)), (0, text(1)), (0, text(2)), (7, text(3)), (7, text(4)), (8, near), (0, ""), (0, "one")])
    got = collections.Counter(r["doc_id"] for r in near_dedup.one_of_each(frame).collect())
    assert got == collections.Counter({r["class_id"] for r in near_dedup.classes(frame).collect()})
    blind = frame.selectExpr("cast(null as bigint) as doc_id", "text")
    assert near_dedup.one_of_each(blind).count() == sum(got.values())


def test_signature_estimates_weighted_jaccard():
    rnd = np.random.default_rng(1)
    a = rnd.integers(0, 400, 3000).astype(np.uint64)
    b = np.concatenate([a[:2400], rnd.integers(0, 400, 600).astype(np.uint64)])
    ca, cb = collections.Counter(a.tolist()), collections.Counter(b.tolist())
    true = sum((ca & cb).values()) / sum((ca | cb).values())
    assert abs((near_dedup.signature(a, 4096) == near_dedup.signature(b, 4096)).mean() - true) < 0.04


def test_token_files(spark, docs, frame, odd):
    path = tokenizer_path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    folder, files = token_files.write_corpus(frame, path)
    got = {r["doc_id"]: r for r in token_files.read_corpus(spark, folder, files).collect()}
    import zlib

    start = 0
    for d, text in docs:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    folder, files = token_files.write_corpus(odd, path)
    assert token_files.read_corpus(spark, folder, files).count() == 7
    other = token_files.WordEncoder(tokenizer_path("byte_bpe_50k.json"))  # no word tokenizer: whole texts go to the library
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    texts = ["Ab c. d", None, "x  y\n"]
    assert [np.frombuffer(x, other.kind).tolist() for x in other.encode(texts).to_pylist()] == [[*library.encode(t or "", add_special_tokens=False).ids, token_files.END_ID] for t in texts]
    with pytest.raises(ValueError):
        bpe.ByteBPE(path)
    r = np.array([0, 255, 256, 65535, 65536, 2**24, 2**32 - 1], np.uint32)
    assert (token_files.unpack(*token_files.pack(r), len(r)) == r).all()


def test_word_encoder_odd_chunks():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), token_files.WordEncoder(path, kept=5)
    texts = [None, "", "\u0130stanbul Q\u0958. x", "a<|endoftext|>b c<|startoftext|>", "don't we're 'll x'", "abc*** d.,%%% e.'s f'.s abc", "x\x1cy z", "\xa0A\x85B\u3000c  "]
    for batch in (texts, texts, texts[::-1]):
        got = [np.frombuffer(x, own.kind).tolist() for x in own.encode(batch).to_pylist()]
        assert got == [[*library.encode(t or "", add_special_tokens=False).ids, token_files.END_ID] for t in batch]


def test_personal_data(spark, odd):
    text = "mail a@b.example.com.x_y@c.d 300.1.2.3 10.0.0.1 card 4111 1111 1111 1111 call +1 (555) 010-9999 😀 z@q.org"
    r = pii.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    mails = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    others = [f"ip:{text.index('10.0')}:{text.index('10.0') + 8}", f"card:{text.index('4111')}:{text.index('4111') + 19}", f"phone:{text.index('+1')}:{text.index('+1') + 17}"]
    assert r["base_sha256"] == hashlib.sha256(",".join(mails + others).encode()).hexdigest()
    assert r["spans"] == ",".join(mails + others)  # the local part of a phone number is no span of its own
    assert pii.report(odd).count() == 7
    masked = pii.mask(spark.createDataFrame([(1, "to a@b.org now"), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [m["text"] for m in masked] == ["to [EMAIL] now", None]


def test_personal_data_by_classifier(spark):
    """True and false spans of the kinds that the classifier decides."""
    true = [
        ("Contact: Maria Schmidt of the house", "name", "Maria Schmidt"), ("as Dr. Paul Weber said", "name", "Paul Weber"), ("he lives at 12 Baker Street now", "address", "12 Baker Street"), ("wohnt Goethe Straße 7 seit", "address", "Goethe Straße 7"),
        ("born on 03.04.1985 in", "birth_date", "03.04.1985"), ("IBAN DE89370400440532013000 is", "iban", "DE89370400440532013000"), ('token = "04dbebab91ab85687d33eeaaf9ac699e"', "secret", 'token = "04dbebab91ab85687d33eeaaf9ac699e"'), ("call (212) 555-0123 now", "local_phone", "(212) 555-0123"),
    ]
    false = [
        ("we saw the Great Plains of it", "name"), ("It was so. Then Came the rain", "name"), ("in March 2020 we went", "address"), ("about 300 Meter of it", "address"), ("on 03.04.2024 we met", "birth_date"), ("on 39.94.1985 we met", "birth_date"),
        ("the code DE00370400440532013000 is", "iban"), ("my password: correcthorse", "secret"),
    ]
    rows = [(i, t[0]) for i, t in enumerate(true)] + [(100 + i, t[0]) for i, t in enumerate(false)]
    rows += [(1000 + i, f"{'in the North Wind we' if i % 2 else 'at 50 Meter it'} went on 0{i % 9 + 1}.02.2024 again") for i in range(300)]
    got = {r["doc_id"]: r["spans"] for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (text, kind, span) in enumerate(true):
        assert f"{kind}:{text.index(span)}:{text.index(span) + len(span)}" in got[i].split(","), (text, got[i])
    for i, (text, kind) in enumerate(false):
        assert f"{kind}:" not in got[100 + i], (text, got[100 + i])
    assert not any(got[i] for i in got if i >= 1000)


def test_secrets_need_no_digit(spark):
    rows = [(1, "password: correcthorsebattery"), (2, "Api-Key:abcdefgh"), (3, "token=abcdefgh"), (4, "my password is long"), (5, "note: nothing here")]
    got = {r["doc_id"]: [x["kind"] for x in r["spans"]] for r in pii.candidates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["secret"], 2: ["secret"], 3: ["secret"], 4: [], 5: []}


def test_bpe(spark, docs, odd):
    path = tokenizer_path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    t, own = Tokenizer.from_file(path), bpe.ByteBPE(path)
    for text in [x for _, x in docs] + ["", "a  b ", "<|endoftext|>x", "\n\n x's 12é😀", "ab" * 3000]:
        ids = t.encode(text, add_special_tokens=False).ids
        packed = own.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == ids and own.decode(packed) == t.decode(ids, skip_special_tokens=False)
    assert bpe.digests(odd, path).count() == 7


def test_toxicity(spark, frame, odd, labels):
    known = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r["doc_id"]: r for r in toxicity.score(frame, known).collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    kept = {r["doc_id"] for r in toxicity.clean(frame, known).select("doc_id").collect()}
    assert kept == {d for d, r in got.items() if not r["predicted"]}
    assert toxicity.score(odd, labels).count() == 7 and toxicity.clean(odd, labels).columns == odd.columns


def test_toxicity_on_held_out_rows(spark):
    docs, known = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    own = toxicity.score(docs, known).join(known.filter("toxic is not null").select("doc_id", "toxic"), "doc_id").filter("held_out")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in own.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.01 * n[0, 0]


def test_lexicon_counts_texts_with_one_header(spark):
    p = toxicity.Params()
    header = "This message was sent through the common portal of all the users of the service. "
    rows = [(f"{header}zorgful words {i}", 1) for i in range(p.support)] + [(f"{header}bralgish words {i}", int(i == 0)) for i in range(4 * p.support)] + [(f"{header}krintous", 1)] * p.support
    got = toxicity.learned_lexicon(spark.createDataFrame(rows, "text string, toxic int"), p)
    assert any("zorgful".startswith(x) for x in got) and not any(w.startswith(x) for x in got for w in ("bralgish", "krintous", "message"))


def test_isotonic_rises():
    m = np.array([0.0, 1, 2, 3, 4])
    k = toxicity.isotonic(m, np.array([0.0, 1, 0, 1, 1]))
    assert [a for a, _ in k] == sorted(a for a, _ in k) and [b for _, b in k] == sorted(b for _, b in k)


def test_decontamination(spark, docs, frame, odd):
    bench = spark.createDataFrame([(1, "so Tom has 3 apples and Tom eats 2 apples with joy"), (2, ""), (3, None)], "item_id long, text string")
    rows = [(1, "now so Ann has 5 apples and Ann eats 7 apples with joy today"), (2, "now so Ann has 5 apples and Bob eats 7 apples with joy today"), (3, "nothing"), (4, None)]
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 1)]
    assert decontaminate.clean(odd, bench).count() == 7
    real = spark.read.parquet(f"{SF}/benchmark.parquet")
    flat = lambda t: " ".join(t.lower().split())
    items = [(r["item_id"], flat(r["text"])) for r in real.collect()]
    want = {(d, i) for d, t in docs for i, b in items if b in flat(t)}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(frame, real).collect()} >= want


def test_decontamination_tries_each_alignment(spark):
    item, sibling = "Add 3 and 3 to get the total now", "Add 4 and 5 to get the total now"
    long = "so we take 3 of the red and 3 of the blue ones home with us today"
    other = long.replace("3", "4", 1)
    bench = spark.createDataFrame([(1, item), (2, long)], "item_id long, text string")
    gap = long.replace("ones home", "ones quite happily home")
    rows = [(1, f"{sibling} . {item}"), (2, f"{sibling} . {sibling} ."), (3, f"{sibling} . " * 50 + item), (4, f"{other} . {long}"), (5, f"{other} . {other}"), (6, gap), (7, f"{other} x {other}"), (8, f"{item} . {sibling}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(1, 1), (3, 1), (4, 2), (8, 1)}
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, bench).collect()) == [2, 5, 6, 7]


def test_decontamination_keeps_order_and_slots(spark):
    a, b = "the old mill by the river was sold to the town", "because no one would ever pay more for such land"
    bench = spark.createDataFrame([(1, f"{a} {b}"), (2, "take 3 mm of rope and 5 mm of wire to the man on the hill")], "item_id long, text string")
    rows = [
        (1, f"x {a} {b} y"), (2, f"x {b} {a} y"), (3, f"{a} and so {b}"), (4, "take 4 mm of rope and 9 mm of wire to the man on the hill"), (5, "take 4 mm of rope and 4 mm of wire to the man on the hill"),
        (6, f"{b}. {a}. {b}"), (7, "to the man on the hill take 3 mm of rope and 5 mm of wire"),
    ]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 1), (4, 2), (6, 1)}


def test_decontamination_names_by_position(spark):
    items = [(1, "Tom has 3 apples and Tom eats 2 apples with joy"), (2, "Compute the sum of all"), (3, "Name every planet"), (4, "Tom eats 3 pears. Tom has 2 left now."), (5, "The big old oak tree fell. The men were all sad about it then and they left soon.")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [
        (1, "we know Ann has 5 apples and Ann eats 7 apples with joy today"), (2, "we know Ann has 5 apples and Bob eats 7 apples with joy today"),
        (3, "text (see\nCompute the sum of all here"), (4, "a list\nName every planet"), (5, "we compute the sum of all here"), (6, "So. Compute the sum of all"), (7, "well Name every Planet"),
        (8, "See: Ann eats 5 pears. Ann has 4 left now. End"), (9, "See: Ann eats 5 pears. Bob has 4 left now. End"), (10, "Ann has 5 apples and Bob eats 7 apples with joy"),
        (11, "note The big old oak tree fell. The men were all sad about it then and they left soon. x"), (12, "a big old oak tree fell. The men were all sad about it then and they left soon."), (13, "A big old oak tree fell. The men were all sad about it then and they left soon."), (14, "Oh. Ann has 5 apples and Ann eats 7 apples with joy"),
    ]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 1), (3, 2), (4, 3), (5, 2), (6, 2), (8, 4), (11, 5), (12, 5), (13, 5), (14, 1)}


def test_substring_dedup(docs, frame, odd):
    first = {}
    for d, t in docs:
        w = t.encode().split()
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), d)
    got = {r["doc_id"]: r for r in substring_dedup.digests(frame).collect()}
    for d, t in docs:
        w = t.encode().split()
        keep = [True] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                keep[i : i + 50] = [False] * 50
        kept = [x for x, k in zip(w, keep) if k]
        assert (got[d]["n_words"], got[d]["n_removed"], got[d]["kept_sha256"]) == (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    longest, size = dict.fromkeys(got, 0), 50
    while True:
        holders = collections.defaultdict(set)
        for d, t in docs:
            w = t.encode().split()
            for i in range(len(w) - size + 1):
                holders[tuple(w[i : i + size])].add(d)
        again = set().union(*[x for x in holders.values() if len(x) > 1])
        if not again:
            break
        longest |= dict.fromkeys(again, size)
        size *= 2
    assert {d: r["longest_repeat"] for d, r in got.items()} == longest
    rows = {(r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.digests(odd).collect()}
    assert rows == {(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 1, 0), (None, 2, 0), (5, 5000, 0)} and substring_dedup.digests(odd.limit(0)).count() == 0


def test_purity_by_folds(spark):
    """Starts that stand in clean texts as well cost the loose purities; the held-out rows are never asked."""
    rows = []
    for k in range(60):
        rows.append((f"zorgus zorgus plain {k}", 1, k % 2))
        rows.append((f"brotan brotan brotan {k}" if k % 5 == 0 else f"zorgus more {k}", 1, k % 2))
        rows.append((f"calm brotan {k}" if k % 5 < 2 else f"calm words {k}", 0, k % 2))
    df = spark.createDataFrame(rows, "text string, toxic int, fold int")
    p = toxicity.Params(purities=(0.5, 0.95), support=4)
    assert toxicity.chosen_purity(df, p) in p.purities
    words = [toxicity.learned_lexicon(df, toxicity.replace(p, purity=x)) for x in p.purities]
    assert "zorg" in words[1] and "brot" in words[0] and "brot" not in words[1]
    assert toxicity.chosen_purity(df.filter("toxic = 0"), p) == toxicity.chosen_purity(df.limit(0), p) == p.purity


def test_stray_tags_take_time_by_their_number():
    import time

    for page in ("<div>" * 100_000 + "</p>" * 100_000, "<p><article>" + "<div>" * 50_000 + "</p>" * 100_000, "<li><b>" * 50_000 + "</i></b></li>" * 50_000):
        began = time.perf_counter()
        html_extract.main_text(page + "the end of it")
        assert time.perf_counter() - began < 5  # a second or two; by walking the open elements it would take an hour
    text = html_extract.main_text("<article><p>This is the first of the parts of the text, and it is long enough to be a good one for all of us here.</section></p><p>And this is the other one of the two, as long as the first and with as many of the words.</article><p>Out</p>")
    assert text.startswith("This is the first") and text.endswith("many of the words.")

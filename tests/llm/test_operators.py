"""Training-data operators against brute force, with nulls, empty texts, ties, repeated rows, empty tables and clashing names."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skilltide.llm import ann, common, html, licenses, media, minhash, mixing, oracle, packing, tokens, toxicity, warc

DOCS = "doc_id long, text string, source string, id string, sig string, bucket string, digest string, size long"


def docs(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, s, "id", "sig", "b", "d", -1) for i, t, s in rows], DOCS)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(n))


def test_media_round_trip(spark):
    rows = [(None, "x", "a"), (1, None, "a"), (2, "", None), (3, "é" * 576, "a"), (4, "a" * 577, "a"), (4, "a" * 577, "a"), (5, prose(1, 30_000), "b")]
    got = media.media(docs(spark, rows), rangeBytes=2000).collect()
    want = Counter()
    for i, t, _ in rows:
        data = (t or "").encode()
        data += b"\xff" * (-len(data) % 576 or (0 if data else 576))
        want[i, len((t or "").encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    same = [(r.media_sha256, r.feature) for r in got if r.doc_id == 4]
    assert same[0] == same[1] and media.media(docs(spark, [])).count() == 0


def test_media_damage_is_one_row(spark, tmp_path):
    uri = f"file://{tmp_path}/m"
    media.store(docs(spark, [(i, prose(i, 50), "a") for i in range(6)]).coalesce(1), uri)
    path = next(p for p in (tmp_path / "m").iterdir() if p.suffix == ".zip")
    data = bytearray(path.read_bytes())
    data[60] ^= 255
    path.write_bytes(bytes(data))
    got = spark.read.format("media_archive").options(onError="row", attempts=2).load(uri).collect()
    assert len(got) == 6 and sum(r.error is not None for r in got) == 1
    with pytest.raises(Exception):
        spark.read.format("media_archive").options(attempts=1).load(uri).collect()


def test_png_is_a_standard_image():
    payload, _ = media.payload_of("hello")
    assert media.samples(media.png(payload)).tobytes() == payload
    with pytest.raises(ValueError):
        media.samples(media.png(payload)[:-20])


def test_licenses(spark):
    rows = [
        ("LICENSE", "Released under the MIT License."), ("a/x.py", "hi"), ("a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("a/b/c/d/y", "none"), ("a/b/z", "code\nLicensed under CC BY-NC 4.0.\nmore"),
        (None, "x"), ("a/LICENSE.txt", None), ("k/i", ""), ("long", prose(1, 30_000)), ("k/i", ""),
    ]
    files = spark.createDataFrame([(p, t, "mine", 1) for p, t in rows], "path string, text string, license string, other int")
    got = Counter((r.path, r.license, r.basis, r.license_path) for r in licenses.scan(files).collect())
    mit = ("MIT", "inherited", "LICENSE")
    assert got == Counter({("LICENSE", "MIT", "file", "LICENSE"): 1, ("a/x.py", *mit): 1, ("a/b/COPYING", "GPL-3.0", "file", "a/b/COPYING"): 1, ("a/b/c/d/y", "GPL-3.0", "inherited", "a/b/COPYING"): 1, ("a/b/z", "CC-BY-NC-4.0", "header", "a/b/z"): 1, (None, None, None, None): 1, ("a/LICENSE.txt", *mit): 1, ("k/i", *mit): 2, ("long", *mit): 1})
    assert licenses.scan(files.limit(0)).count() == 0


def matcher():
    return licenses.Matcher({w: 3.0 for w in licenses.VOCABULARY}, 6.0)


def test_every_cue_of_a_long_line():
    line = f"{'x' * 999} copyright {'y ' * 2250}" + "licensed under cc by 4.0." + " z" * 100
    assert matcher().scan(line.replace("copyright", "nothing"))[1] == matcher().scan(line)[1] == "CC-BY-4.0"
    assert matcher().scan(line) == matcher().scan(line.replace("copyright", "nothing"))


def test_notices_among_other_words():
    texts = {
        "Released under the MIT License. Please keep this notice in copies.": "MIT",
        "This project is released under the MIT license, see the file for details.": "MIT",
        "Copyright (c) 2021 Jane Doe. All rights reserved.": "Proprietary",
        "// SPDX-License-Identifier: MIT": "MIT",
        "SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0",
        "/* SPDX-License-Identifier: (MIT OR Apache-2.0) */": "(MIT OR Apache-2.0)",
        f"{prose(1, 20)} Licensed under CC BY 4.0. {prose(2, 20)}": "CC-BY-4.0",
        f"{prose(1, 20)} Licensed under CC BY-NC-SA 4.0. {prose(2, 20)}": "CC-BY-NC-SA-4.0",
        "Copyright Jane Doe. All rights reserved.\n# Licensed under the Apache\n# License, Version 2.0.": "Apache-2.0",
        f"{prose(1, 9)} GNU Lesser General Public License, version 3. {prose(2, 9)}": "LGPL-3.0",
        "The SPDX-License-Identifier: is a line": None,
        "Released under the Foobar License.": None,
        "The driving licence is issued under the rules of the road.": None,
    }
    assert {t: name if score >= 0.7 else None for t in texts for score, name in [matcher().scan(t)]} == texts


def test_document_frequency_counts_by_one_rule(spark):
    files = spark.createDataFrame([("The software, its terms.",), ("software terms",), ("Copyright: software, terms.",), (None,)], "text string")
    counts, n = licenses.document_frequency(files, "text")
    assert (counts["software"], counts["terms"], n) == (3, 3, 4)


def best_by_hand(text, idf, rare, least):
    """Every run of words near every cue against every template, each cosine from two whole sparse vectors."""
    weigh = lambda counts: {w: n * idf.get(w, rare) for w, n in counts.items()}
    best = (False, 0.0, 0.0), None
    low = text.lower()
    for cue in re.finditer("licen|copyright|spdx|public domain|all rights reserved|permission is hereby|permission to use|creative commons|redistribution and use|free software", low):
        before = re.findall(r"[^\W_]+(?:\.\d+)*", low[: cue.start()])
        words = before + re.findall(r"[^\W_]+(?:\.\d+)*", low[cue.start() :])
        for name, template, needed in licenses.TEMPLATES:
            want = Counter(re.findall(r"[^\W_]+(?:\.\d+)*", template.lower()))
            size, t = sum(want.values()) + 8, weigh(want)
            first, last = max(0, len(before) - size + 1), min(len(words), len(before) + size)
            for end in range(first + 1, last + 1):
                held = Counter(words[max(first, end - size) : end]) & want
                if all(held[w] for w in needed.split()):
                    dot = sum(x * t[w] for w, x in weigh(held).items())
                    score = round(math.sqrt(dot / sum(x * x for x in t.values())), 9)
                    one = (score >= least and name != "Proprietary", score, round(dot, 6))
                    best = max(best, (one, name), key=lambda b: b[0])
    return best[0][1], best[1]


def test_licenses_against_all_windows():
    r = random.Random(12)
    files = [" ".join(r.choices(licenses.VOCABULARY, k=40)) for _ in range(30)]
    for _, template, _ in licenses.TEMPLATES:
        for _ in range(3):  # a template with words lost, changed and among others
            words = [w if r.random() < 0.9 else r.choice(licenses.VOCABULARY) for w in template.split() if r.random() < 0.95]
            files.append(" ".join([prose(r.random(), 12), *words, prose(r.random(), 12), *r.sample(["Copyright", "license", "all rights reserved."], 2)]))
    seen = Counter(w for f in files for w in set(re.findall(r"[^\W_]+(?:\.\d+)*", f.lower())))
    idf = {w: math.log((1 + len(files)) / (1 + seen[w])) + 1 for w in licenses.VOCABULARY}
    rare = math.log(1 + len(files)) + 1
    matcher = licenses.Matcher(idf, rare)
    found = [matcher.scan(f) for f in files]
    for f, got in zip(files, found, strict=True):
        want = best_by_hand(f, idf, rare, 0.7)
        assert got[0] == pytest.approx(want[0], abs=1e-8) and got[1] == want[1], f
    assert len({name for score, name in found if score >= 0.7}) > 10


def test_token_counts(spark):
    sp, public = pytest.importorskip("sentencepiece"), pytest.importorskip("public_tokenizers")
    model = public.path("piece_bpe_32k.model")
    library = sp.SentencePieceProcessor(model_file=model)
    r = random.Random(3)
    texts = ["", "  a  b ", "\n\n a\n", "▁x▁▁y", "<s> hi </s>", "日本語 𝒳😀", "a" * 300, " " * 40, "\x00z", prose(2, 5000), *("".join(r.choices("ab \n▁é😀1.<>", k=r.randint(0, 40))) for _ in range(200))]
    got = tokens.token_counts(docs(spark, [*((i, t, "a") for i, t in enumerate(texts)), (-1, None, None), (None, "a", "a")]), model)
    by = {r.doc_id: r for r in got.collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t))
        assert (by[i].n_tokens, by[i].n_bytes, by[i].over_limit) == (n, len(t.encode()), n > 4096), t[:40]
    assert by[-1].n_tokens == 0 and by[None].n_tokens == 1


def test_deobfuscation():
    model = np.full((64,) * 3, -8.0, np.float32)
    for w in ("idiot", "moron", "fine", "disgusting", "a", "you"):
        s = [0, 0, *map(toxicity.symbol, w), 0]
        for a, b, c in zip(s, s[1:], s[2:]):
            model[a, b, c] = -1.0
    restore = toxicity.Restorer(model)
    assert [restore.token(t)[0] for t in ("1d10t", "idiooooot", "m0r0n!!", "d1sgust1ng", "i.d.i.o.t", "fine")] == ["idiot", "idiot", "moron", "disgusting", "idiot", "fine"]
    assert "idiot" in restore.words("you i d i o t") and restore.words("") == set()


def test_deobfuscation_of_any_length():
    model = np.full((64,) * 3, -8.0, np.float32)
    s = [0, 0, *map(toxicity.symbol, "idiot"), 0]
    for a, b, c in zip(s, s[1:], s[2:]):
        model[a, b, c] = -1.0
    restore = toxicity.Restorer(model)
    assert [restore.token(t)[0] for t in ("idi" + "o" * 100 + "t", "1di" + "o" * 100 + "t", "id" + "1" * 100 + "ot", ".".join("idiot" * 30))] == ["idiot"] * 4
    assert restore.spaced(" ".join("idiot" * 30)) == ["idiot"] * 30
    assert restore.words(" ".join("idiot" * 30)) == {"i", "d", "o", "t", "idiot"}
    assert restore.spaced(" ".join("1diot" * 20_000)) == ["idiot"] * 20_000


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(1)
    model = np.log(r.dirichlet(np.ones(64), (64, 64))).astype(np.float32)
    lattice = [[("a", 0.0), ("b", -0.5)], [("c", 0.0), ("", -1.0)], [("d", 0.0), ("e", -0.1), ("f", 0.0)], [("a", 0.0), ("aa", -0.7)]]

    def score(path):
        s, (x, y) = sum(c for _, c in path), (0, 0)
        for c in "".join(o for o, _ in path) + " ":
            k = toxicity.symbol(c)
            s, x, y = s + model[x, y, k], y, k
        return s

    best = max(itertools.product(*lattice), key=score)
    assert toxicity.decode(lattice, model.ravel().tolist()) == "".join(o for o, _ in best)


def test_toxicity(spark):
    r = random.Random(5)
    bad = ["nasty", "vileword", "scumlike"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = prose(i, 20).split()
        if toxic:
            w = r.choice(bad)
            words[5] = w.replace("a", "4") if i % 8 == 0 else w
        rows.append((i, " ".join(words), "a"))
        labels.append((i, int(toxic)))
    rows += [(1000, None, None), (1001, "", "a"), (None, "a nasty thing", "a"), (1002, "nasty", "a"), (1002, "nasty", "a"), (1003, prose(9, 20_000), "a")]
    table = spark.createDataFrame([*labels, (7, None), (None, 1), (0, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs(spark, rows), table).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(by[i].held_out for i in held) and sum(r.held_out for r in got if r.doc_id is not None and r.doc_id < 400) == len(held)
    assert sum(by[i].predicted == (i % 4 == 0) for i in held) / len(held) >= 0.95
    assert by[None].predicted == 1 and by[1002].predicted == 1 and by[1000].predicted == by[1001].predicted == 0 and all(0 <= r.score <= 1 for r in got)
    kept = toxicity.without_toxic(docs(spark, rows), table)
    assert kept.columns == docs(spark, rows).columns and kept.where("doc_id = 1000").count() == 1 and kept.where("doc_id = 1002").count() == 0
    assert toxicity.toxicity(docs(spark, rows[:3]), table.limit(0)).agg(F.max("score")).first()[0] == 0.0
    assert toxicity.toxicity(docs(spark, []), table).count() == 0


def test_boundaries_against_all_choices():
    r = random.Random(2)

    def cost(h, ends):
        return sum(n * (next(e for e in ends if e >= length) - length) for length, n in h)

    for _ in range(200):
        h = [(length, r.randint(1, 9)) for length in r.sample(range(30), r.randint(1, 9))]
        k, lengths = r.randint(1, 5), sorted(length for length, _ in h)
        best = min(cost(h, [*c, lengths[-1]]) for m in range(min(k, len(h))) for c in itertools.combinations(lengths[:-1], m))
        ends = packing.boundaries(h, k)
        assert len(ends) <= k and cost(h, ends) == best


def test_packing(spark):
    rows = [(i, prose(i, i % 37), "a") for i in range(300)] + [(None, "x y", "a"), (7, None, None), (7, None, None), (900, prose(1, 5000), "a")]
    got = packing.pack(docs(spark, rows), buckets=4, budget=100).collect()
    assert Counter(r.n_words for r in got) == Counter(len((t or "").split()) for _, t, _ in rows)
    batches = defaultdict(list)
    for r in got:
        batches[r.batch].append(r)
        assert r.padding == r.bucket_len - r.n_words >= 0 and r.over_budget == (r.n_words > 100) and not (r.over_budget and r.padding)
    for b in batches.values():
        assert len(b) == b[0].batch_rows and len({r.bucket for r in b}) == 1 and (len(b) == 1 or len(b) * b[0].bucket_len <= 100)
    assert packing.pack(docs(spark, [])).count() == 0
    nulls = packing.pack(docs(spark, [(None, prose(i, 9), "a") for i in range(40)]).drop("doc_id").withColumn("doc_id", F.lit(None).cast("long")), budget=30)
    assert Counter(r.batch_rows for r in nulls.dropDuplicates(["batch"]).collect()) == {3: 13, 1: 1}
    own = packing.pack(docs(spark, [(1, None, "a"), (2, None, "a")]).select("doc_id", F.lit(5).alias("n_tokens")), length_col="n_tokens")
    assert [(r.n_tokens, r.padding, r.batch_rows) for r in own.collect()] == [(5, 0, 2)] * 2
    assert packing.pack(docs(spark, [(1, "a b c", "a")]), budget=2).first().over_budget


PAGE = "<!DOCTYPE html><html><head><title>T</title><script>var t='</p>';</script></head><body><nav><a href='/'>menu</a></nav><div class=\"ad\">buy</div><article><h1>Head {0}</h1><p><b>Bold &amp; text {0}<br><p>Para</p></article><div id='comments'><article>me too</article></div><footer>&copy; x</footer></body></html>"


def test_html(spark):
    plain = "<body><div class='top'>same words</div><div class='text'>own {0}&nbsp;words</div></body>"
    rows = [(i, "http://a.org/x", PAGE.format(i)) for i in range(10)] + [(100 + i, "http://b.org/x", plain.format(i)) for i in range(10)] + [(None, None, None), (5, "u", ""), (206, "http://c.org", "a<b>c</b> &lt;d&gt;<p>e<li>f")]
    pages = spark.createDataFrame([(*r, "low", "host") for r in rows], "page_id long, url string, html string, low string, host string")
    got = {r.page_id: r for r in html.extract(pages).where("page_id is null or url != 'u'").collect()}
    for i in range(10):
        assert got[i].text == f"Head {i} Bold & text {i} Para"
        assert got[100 + i].text == f"own {i} words"  # the same block on every page of the host is dropped
    assert (got[None].text, got[206].text, got[206].n_chars) == ("", "ac <d> e f", 10)
    assert html.extract(pages.limit(0)).count() == 0


def test_html_tree_decides(spark):
    page = "<body><article><h1>Head {0}</h1><p>own {0}</p><p>Also on some: {1}</p><div><p>Read our other stories.</p></div></article></body>"
    rows = [(i, "http://a.org/x", page.format(i, i % 2)) for i in range(60)]
    rows += [(100 + i, "http://b.org/x", f"<body><div class='top'>same words</div><div class='text'>own {i} words</div></body>") for i in range(2)]
    rows += [(200 + i, "http://c.org/x", "<body><article><p>One text.</p></article></body>") for i in range(40)]
    rows += [(300 + i, "http://d.org/x", "<body><div>One text.</div></body>") for i in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert all(got[i] == f"Head {i} own {i} Also on some: {i % 2}" for i in range(60))  # a block of all pages goes, one of half of them stays
    assert [got[100], got[101]] == ["own 0 words", "own 1 words"]
    assert {got[i] for i in (*range(200, 240), 300, 301)} == {"One text."}  # pages that are copies keep their text


def test_html_main_text_outranks_class_names():
    for page, text in {
        '<article class="post has-sidebar"><p>a b</p></article><p>out</p>': "a b",
        '<div class="layout-with-sidebar"><p>a</p><div class="sidebar">no</div><p>b</p></div>': "a b",
        '<main><div class="share-price-report">a</div><p>b</p></main>': "a b",
        '<article><p class="notice">a</p><div class="related-work">b</div><p>c</p></article>': "a b c",
        '<form id="aspnetForm"><div><p>one two three</p><input value="x"><button>Go</button></div><div class="nav-bar">no</div></form>': "one two three",
        '<article><p>a</p><div class="ad-slot">no</div><section id="comments"><p>no</p></section><form>no</form><p>b more</p></article>': "a b more",
        '<div class="cookie-banner">no</div><div class="notice">no</div><div class="page"><p>a long text of its own</p></div><ul class="menu"><li>no</ul>': "a long text of its own",
        '<div class="sidebar"><article>a</article></div><div class="comments"><article class="comment">no no no no</article></div>': "a",
        '<header><h1>no</h1></header><article><header><h1>a</h1></header>b</article>': "a b",
        "<article><div>a</article>b<article>c": "a c",
    }.items():
        assert html.main_text(page) == text, page


def test_html_tree_decides_on_ambiguous_names_in_main_text(spark):
    rows = [(i, "http://a.org/x", f'<article><p class="notice">say {i % 2 and "the same" or i}</p><p>text {i}</p><div class="related-work">{i}</div></article>') for i in range(60)]
    rows += [(100 + i, "http://b.org/x", f'<article><p class="notice">the same</p><p>text {i}</p></article>') for i in range(60)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "say the same text 3 3" and got[4] == "say 4 text 4 4" and got[103] == "text 3"


def test_html_of_any_depth():
    for n in (250, 20_000):
        page = f"<div><article>{'<div>' * n}in<nav>menu</nav>{'</div>' * n} rest</article> out</div>"
        assert html.main_text(page) == "in rest"
    assert html.main_text('<article><p>a<svg class="i"/> b</p><p>c</p></article>') == "a b c"
    assert html.main_text('<article><p>a<svg data-x="/>"><text>no</text></svg> b<svg/>c<svg viewBox="0" /></p><p>d</p></article>') == "a bc d"


def links_by_hand(rows):
    sets = {}
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            u, v = comp[a], comp[b]
            comp = {k: min(u, v) if c in (u, v) else c for k, c in comp.items()}
    return sets, comp


def near_rows():
    r = random.Random(8)
    base = prose(1, 60).split()
    rows = [(i, prose(i, 40), "a") for i in range(100, 130)]
    for i in range(60):  # a chain of drifting copies: not all pairs are linked
        base[r.randrange(60)] = f"w{i}"
        rows.append((i, " ".join(base), "a"))
    return rows + [(200, "One two", "a"), (201, "one  TWO", "a"), (202, None, "a"), (203, "", None), (204, " \t", "a"), (205, prose(3, 8000), "a"), (206, prose(3, 8000) + " end", "a"), (207, "É a", "a"), (208, "é a", "a")]


@pytest.mark.parametrize("block_bytes", [8 * 1200, 2 << 20])
def test_near_duplicates(spark, block_bytes):
    rows = near_rows()
    sets, comp = links_by_hand(rows)
    got = minhash.near_duplicates(docs(spark, [*rows, rows[0], (None, "x", "a")]), block_bytes=block_bytes).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), comp[r.doc_id], comp[r.doc_id] == r.doc_id), r.doc_id
    kept = minhash.without_copies(docs(spark, [*rows, rows[0], (None, "x", "a")]))
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(i for i, c in comp.items() if c == i) and kept.where("doc_id is null").count() == 1
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("rounds, block_bytes", [(0, 30_000), (2, 2 << 20)])
def test_near_copies_around_the_threshold(spark, rounds, block_bytes):
    """One group of hundreds of near copies whose similarities lie around the threshold, so that some members are alone."""
    r, base, rows = random.Random(4), prose(6, 120).split(), []
    for i in range(400):
        words = list(base)
        for k in r.sample(range(120), r.randint(0, 6)):
            words[k] = f"x{r.randrange(10**6)}"
        rows.append((i * 7 % 401, " ".join(words), "a"))
    _, comp = links_by_hand(rows)
    assert 3 < len(set(comp.values())) < 200
    got = minhash.near_duplicates(docs(spark, rows), rounds=rounds, block_bytes=block_bytes).collect()
    assert {r.doc_id: r.component_id for r in got} == comp


def test_one_of_each_group_stays_with_all_its_columns(spark):
    table = spark.createDataFrame([(1, "a b c", 5, True, 2), (2, "A b c", 6, False, 3), (2, "A b c", 6, False, 3), (3, None, 7, None, 4), (None, "a b c", 8, None, 5)], "doc_id long, text string, _id long, kept boolean, rows long")
    got = minhash.without_copies(table)
    assert got.columns == table.columns and sorted(r["_id"] for r in got.collect()) == [5, 7, 8]


def test_a_mix_keeps_columns_of_any_name(spark):
    table = spark.createDataFrame([(1, "a b c", "s", 5, 1, 2), (2, None, "t", 6, 1, 3), (None, "d e", None, 7, 1, 4)], "doc_id long, text string, source string, _id long, _times int, _copy int")
    got = mixing.mixed(table)
    assert got.columns == table.columns and {r["_id"] for r in got.collect()} <= {5, 7}


def test_repeated_rows_and_empty_tables(spark):
    public = pytest.importorskip("public_tokenizers")
    model = public.path("piece_bpe_32k.model")
    got = tokens.token_counts(docs(spark, [(1, "a b", "s"), (1, "a b", "s"), (2, " ", "s")]), model).collect()
    assert len(got) == 3 and len({r.n_tokens for r in got if r.doc_id == 1}) == 1 and tokens.token_counts(docs(spark, []), model).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    scored = toxicity.toxicity(docs(spark, [(1, "a b", "s"), (1, "a b", "s"), (2, None, "s")]), labels).collect()
    assert [r.score for r in scored] == [0.0] * 3 and toxicity.without_toxic(docs(spark, []), labels).count() == 0


def test_license_columns_are_replaced(spark):
    files = spark.createDataFrame([("a/LICENSE", "Released under the MIT License.", 1.5, "x")], "path string, text string, score double, basis string")
    assert [r.asDict() for r in licenses.scan(files).select("path", "license", "basis").collect()] == [{"path": "a/LICENSE", "license": "MIT", "basis": "file"}]


def test_sequential_bound():
    bounds = minhash.least_matches(240, 0.75, 1e-6)
    n, m = bounds[-1]
    tail = sum(math.comb(n + 1, k) * 0.75**k * 0.25 ** (n + 1 - k) for k in range(m))
    assert n == 240 and tail < 1e-6 <= tail + math.comb(n + 1, m) * 0.75**m * 0.25 ** (n + 1 - m)


def test_warc(spark):
    rows = [(None, None, "x"), (1, None, None), (2, "http://É.x/ü\n\t?q", ""), (3, "ftp://u@H.com:8/p", "a"), (4, "junk", "a"), (4, "junk", "a"), (4, "junk", "b"), (5, "", "b"), (6, "http://a.b/c", prose(1, 30_000))]
    pages = spark.createDataFrame([(*r, "surt", "sha") for r in rows], "page_id long, url string, html string, surt string, sha string")
    same = defaultdict(list)
    for i, _, h in rows:
        same[h or ""].append(-1 if i is None else i)

    def key(i, h):
        top = max(same[h or ""])
        first = top == (-1 if i is None else i)
        return i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if first else "revisit", None if first else top

    got = Counter(tuple(r) for r in warc.warc(pages).collect())
    assert got == Counter(key(i, h) for i, _, h in rows)
    small = warc.warc(pages, least_bytes=2).where("record_type = 'revisit'").count()
    assert small == 0 and warc.warc(pages.limit(0)).count() == 0


def test_surt():
    assert warc.surt_text("http://M.a.Org:80/x?y#z") == "org,a,m)/x?y#z"


def test_nearest(spark):
    r = np.random.default_rng(4)
    vectors = r.normal(size=(300, 8))
    vectors[10:40] = vectors[10]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(20, vectors[20].tolist()), (None, [1.0] * 8), (1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8), (1060, [1.0]), (1080, [1.0] * 7 + [None])]
    table = spark.createDataFrame([(*x, "v", 1) for x in rows], "vec_id long, embedding array<double>, v string, h int")
    got = defaultdict(list)
    for x in ann.nearest(table).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.rank, x.vec_id, x.score))
    assert sorted(got) == list(range(0, 300, 20))
    hits = 0
    for q, found in got.items():
        scores = vectors @ vectors[q]
        want = sorted((i for i in range(300) if i != q), key=lambda i: (-round(scores[i], 12), i))[:20]
        hits += len({v for _, v, _ in found} & set(want))
        assert [x[0] for x in found] == list(range(1, 21)) and all(abs(scores[v] - s) < 1e-12 for _, v, s in found)
        assert found == sorted(found, key=lambda x: (-x[2], x[1]))
    assert hits / (20 * len(got)) >= 0.9
    assert [v for _, v, _ in got[20] if 10 <= v < 40][:3] == [10, 11, 12]  # copies in the order of their ids
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.8, 0.2])], "vec_id long, embedding array<double>")
    assert [x.vec_id for x in ann.nearest(few).orderBy("rank").collect()] == [1, 2] and ann.nearest(few.limit(0)).count() == 0


@pytest.mark.parametrize("norm", [1.0, 10.0, 1e200])
def test_nearest_beside_a_long_vector(spark, norm):
    vectors = np.random.default_rng(6).normal(size=(1000, 64))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[7] *= norm
    got = defaultdict(list)
    for x in ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")).collect():
        got[x.query_id].append(x.vec_id)
    hits = 0
    for q in range(0, 1000, 20):
        scores = vectors @ vectors[q]
        hits += len(set(got[q]) & set(sorted((i for i in range(1000) if i != q), key=lambda i: -scores[i])[:20]))
        assert len(got[q]) == len(set(got[q])) == 20
    assert hits / (20 * 50) >= 0.9


def recall_of(spark, vectors):
    """Rows of each query, and recall against brute force in double precision."""
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for x in ann.nearest(table).collect():
        got[x.query_id].append(x.vec_id)
    n, hits = len(vectors), 0
    want = min(20, n - 1)
    for q in range(0, n, 20):
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        hits += len(set(got[q]) & set(np.argsort(-scores, kind="stable")[:want].tolist()))
        assert len(got[q]) == len(set(got[q])) == want
    return hits / (want * len(range(0, n, 20)))


@pytest.mark.parametrize("n", [2, 21, 50])
def test_nearest_gives_all_rows_of_few_vectors(spark, n):
    assert recall_of(spark, np.random.default_rng(n).normal(size=(n, 64))) >= 0.9


@pytest.mark.parametrize("n, dim, spread", [(10_000, 64, 0.0), (2_000, 384, 0.0), (2_000, 64, 1.0)])
def test_recall_at_real_sizes(spark, n, dim, spread):
    """Unit vectors without structure, the hardest case, and norms that are log-normal."""
    r = np.random.default_rng(11)
    vectors = r.normal(size=(n, dim))
    vectors *= (np.exp(spread * r.normal(size=n)) / np.linalg.norm(vectors, axis=1))[:, None]
    recall = recall_of(spark, vectors)
    print(f"recall {recall:.3f} of {n} vectors of {dim} components, norms spread {spread}")
    assert recall >= 0.9


def test_nearest_holds_short_queries_against_all(spark):
    r = np.random.default_rng(3)
    axis = np.r_[1.0, np.zeros(7)]
    vectors = np.vstack([axis + r.normal(size=(10, 8)) / 100, -axis + r.normal(size=(30, 8)) / 100])  # 9 near, the rest at the opposite pole
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    scores = vectors @ vectors[0]
    got = [x.vec_id for x in ann.nearest(table).where("query_id = 0").orderBy("rank").collect()]
    assert got == sorted(range(1, 40), key=lambda i: -scores[i])[:20]


def test_apportionment(spark):
    r = random.Random(1)
    for _ in range(2):
        votes = [r.choice([0.0, r.random() ** 4 * 1e6, r.random()]) for _ in range(r.randint(2, 20))] + [1.0]
        q, seats = r.randint(0, 2000), None
        seats = [0] * len(votes)
        for _ in range(q):
            seats[max(range(len(votes)), key=lambda i: (votes[i] / (2 * seats[i] + 1), -i))] += 1
        df = spark.createDataFrame([(1, i, v, q) for i, v in enumerate(votes)], "g int, k int, v double, q long")
        got = {x.k: x.o for x in mixing.apportion(df, ["g"], "k", "v", "q", "o").collect()}
        assert [got[i] for i in range(len(votes))] == seats


def test_mixing(spark):
    r = random.Random(7)
    rows = [(i, prose(i, r.randint(0, 60)), r.choice(["a", "b", "b", "b", "c", "É", None])) for i in range(600)] + [(9000, None, "a"), (None, "x y", "b"), (5, prose(5, 9), "b"), (5, prose(5, 9), "b"), (9001, "w " * 5, "tiny")]
    got = mixing.mix(docs(spark, rows)).collect()
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, free = {}, set(order)
    while True:
        level = (sum(size.values()) - sum(target.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * size[s]
            free.discard(s)
    target |= {s: level * weight[s] for s in free}
    taken = defaultdict(int)
    for x in got:
        assert x.source_size == size[x.source] and x.target == pytest.approx(target[x.source]) and 0 <= x.taken <= 3 * x.size
        taken[x.source] += x.taken
    assert all(abs(taken[s] - target[s]) <= 16 + 0.01 * target[s] for s in order if s != "tiny") and taken["tiny"] <= 15
    again = mixing.mix(docs(spark, rows).repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    copies = Counter(x.doc_id for x in mixing.mixed(docs(spark, rows)).collect())
    assert set(copies) <= {i for i, _, _ in rows} and mixing.mix(docs(spark, [])).count() == 0


def test_sql_twins(spark):
    """The SQL forms and the queries give the same rows, copies, short, empty and null texts included."""
    import duckdb
    import pyarrow as pa

    documents = [(i, t, s) for i, t, s in near_rows() if i < 400]
    pages = [(1, "http://a.b/1", None), (2, None, ""), (3, "http://a.b/2", "x"), (4, "http://a.b/2", "x"), (5, "http://c.d/", "é"), (6, "http://c.d/", "x")]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in documents], "text": [r[1] for r in documents]}))
    con.register("pages", pa.table({"page_id": [r[0] for r in pages], "url": [r[1] for r in pages], "html": [r[2] for r in pages]}))
    got = {"op7_minhash": minhash.near_duplicates(docs(spark, documents)), "op8_warc": warc.warc(spark.createDataFrame(pages, "page_id long, url string, html string"))}
    assert set(got) == set(oracle.ORACLE_SQL)
    for name, df in got.items():
        found = con.execute(oracle.ORACLE_SQL[name])
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert Counter(found.fetchall()) == Counter(tuple(r[c] for c in columns) for r in df.collect()), name


def test_hot_keys_are_looked_up_apart(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{i % 20}") for i in range(300)], "id long, key string")
    found = spark.createDataFrame([("hot", 100, 1, None), ("k1", 5, 2, "b"), ("k2", 11, 3, "c"), ("none", 99, 4, "d")], "key string, n long, v int, w string")
    want = Counter((r.id, r.key, r.v, r.w) for r in rows.join(found, "key", "left").collect())
    for hot in (0, 10, 1000):
        got = common.looked_up(rows, found, "key", ["id"], hot)
        assert got.columns == ["id", "key", "v", "w"] and Counter(map(tuple, got.collect())) == want


def test_kept_hosts_are_bounded(spark, tmp_path):
    low = spark.createDataFrame([(f"h{i}", 9, list(range(i)), [j / 10 for j in range(i)]) for i in range(1, 9)], "host string, n long, paths array<long>, owns array<double>")
    hosts, where = html.Hosts(f"file://{tmp_path}/x", most=10), html.store(low, f"file://{tmp_path}/x").collect()
    for r in [*where, *where[::-1], *where]:
        assert hosts.of(r.file, r.start, r.size) == {j: j / 10 for j in range(int(r.host[1:]))}
        assert hosts.held == sum(map(len, hosts.kept.values())) and (hosts.held <= 10 or len(hosts.kept) == 1)
    assert hosts.of(None, None, None) == {}

"""The training-data operators against brute force, and on odd rows."""

import collections
import hashlib
import html as pages_html
import itertools
import math
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from fedloom.llm import html, licenses, packing, phrases, quality, queries, scoring, simhash, suffixes, urls
from fedloom.llm import decontaminate as leak
from fedloom.llm.components import components
from tools.check_sql import rows_of

SF = "/root/testdata/sf0.001"
CLASH = ("fp", "n_words", "kept", "sequence_id", "license", "verdict", "component_id", "distance", "key", "row", "block", "hash", "text_digest")


def corpus(seed, n, words=60, vocabulary=25):
    """Texts that share passages, some of them copies and near copies."""
    r = random.Random(seed)
    bag = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 6))) for _ in range(vocabulary)]
    passages = [" ".join(r.choice(bag) for _ in range(r.randint(10, 90))) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [" ".join(r.choice(bag) for _ in range(r.randint(0, words))) for _ in range(r.randint(1, 3))]
        for _ in range(r.randint(0, 2)):
            parts.insert(r.randint(0, len(parts)), r.choice(passages))
        out.append(r.choice([" ", "\n", "\t "]).join(parts))
    out += [out[0], out[1], out[2] + " x", out[3].upper(), "a" * 700, "b c " * 90]
    return out


@pytest.fixture
def mixed(spark):
    """Plain texts among NULL, empty, wordless, very long and repeated ones, a NULL id and clashing columns."""
    texts = corpus(5, 12)
    rows = [*enumerate(texts), (50, None), (51, ""), (52, " \n\t"), (53, "long words " * 30_000), (54, texts[0]), (54, texts[0]), (None, texts[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit(1) for c in CLASH}), rows


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def remaining_bytes(docs, span):
    count = collections.Counter(t[p:p + span] for _, t in docs for p in range(len(t) - span + 1))
    for i, t in docs:
        gone = bytearray(len(t))
        for p in range(len(t) - span + 1):
            if count[t[p:p + span]] > 1:
                gone[p:p + span] = b"\1" * span
        rest = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        yield i, len(t), sum(gone), sum(1 for k in range(len(t)) if gone[k] and (not k or not gone[k - 1])), hashlib.sha256(rest).hexdigest()


@pytest.mark.parametrize("seed, span, k, most", [(1, 40, 20, 20_000), (2, 40, 9, 2), (3, 64, 60, 20_000), (4, 30, 1, 5)])
def test_suffix_dedup_equals_brute_force(spark, seed, span, k, most):
    docs = [(i, t.encode()) for i, t in enumerate(corpus(seed, 40))]
    df = spark.createDataFrame([(i, t.decode()) for i, t in docs], "doc_id long, text string")
    got = suffixes.without_repeats(df, span, k, most=most)
    assert sorted(map(tuple, got.collect())) == sorted(remaining_bytes(docs, span))


def test_suffix_dedup_on_odd_rows(spark, mixed, none):
    df, rows = mixed
    got = collections.Counter(tuple(r) for r in suffixes.without_repeats(df).collect())
    assert got == collections.Counter(remaining_bytes([(i, (t or "").encode()) for i, t in rows], 200))
    assert suffixes.without_repeats(none).collect() == []


def later_words(docs, span):
    order = lambda i: math.inf if i is None else i
    least = {}
    for i, t in docs:
        w = t.split()
        for p in range(len(w) - span + 1):
            key = tuple(w[p:p + span])
            least[key] = min(least.get(key, math.inf), order(i))
    for i, t in docs:
        w = t.split()
        gone = bytearray(len(w))
        for p in range(len(w) - span + 1):
            if least[tuple(w[p:p + span])] < order(i):
                gone[p:p + span] = b"\1" * span
        yield i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()


@pytest.mark.parametrize("seed, span, k, most, together", [(1, 13, 5, 20_000, 1 << 14), (2, 13, 5, 2, 10), (3, 6, 2, 20_000, 30), (4, 9, 9, 3, 5)])
def test_phrase_dedup_equals_brute_force(spark, seed, span, k, most, together):
    docs = [(i, t.encode()) for i, t in enumerate(corpus(seed, 60))]
    random.Random(seed).shuffle(docs)
    df = spark.createDataFrame([(i, t.decode()) for i, t in docs], "doc_id long, text string")
    got = phrases.without_later(df, span, k, most=most, together=together)
    assert sorted(map(tuple, got.collect())) == sorted(later_words(docs, span))


def test_phrase_dedup_on_odd_rows(mixed, none):
    df, rows = mixed
    got = collections.Counter(tuple(r) for r in phrases.without_later(df).collect())
    assert got == collections.Counter(later_words([(i, (t or "").encode()) for i, t in rows], 13))
    assert phrases.without_later(none).collect() == []


def test_family_tells_every_repeat_once():
    r = np.random.default_rng(3)
    from fedloom.llm.anchors import Family

    keys, family, told = r.integers(0, 3000, 5000).astype(np.uint64), Family(), []
    for a in range(0, 5000, 170):
        own = np.arange(a, min(a + 170, 5000))
        row, place = family.add(keys[own], own, own, np.zeros(len(own), bool))
        assert (row == place).all()
        told += row.tolist()
        sizes = [len(x[0]) for x in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
    count = np.bincount(keys.astype(int))
    assert sorted(told) == [i for i in range(5000) if count[keys[i]] > 1]


def simple_fingerprint(text, width):
    w = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    if not w:
        return 0
    grams = [b" ".join(w[i:i + width]) for i in range(max(1, len(w) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, near):
    """Index of the first of each value's component."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(values)), 2):
        if near(values[i], values[j]) and find(i) != find(j):
            root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("radius, tile", [(2, 2048), (2, 3), (5, 2048), (0, 2)])
def test_simhash_links_equal_brute_force(spark, radius, tile):
    r = random.Random(radius)
    seeds = [r.getrandbits(64) for _ in range(40)]
    fps = sorted({s ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for s in seeds for _ in range(8)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), radius, tile))
    root = {x.node: x.root for x in found.collect()}
    expected = groups(fps, lambda a, b: (a ^ b).bit_count() <= radius)
    members = collections.defaultdict(set)
    for f, g in zip(signed, expected, strict=True):
        members[g].add(f)
    assert all(root.get(f, f) == min(m) for m in members.values() for f in m)


def test_simhash_on_odd_rows(mixed, none):
    df, rows = mixed
    fps = [simple_fingerprint(t or "", 3) for _, t in rows]
    group = groups(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    expected = [(i, f"{f:016x}", least[g]) for (i, _), f, g in zip(rows, fps, group, strict=True)]
    got = simhash.simhash_groups(df).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
    assert simhash.simhash_groups(none).collect() == []


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1300)] + [(7, 7), (7, 1000)]
    found = {x.node: x.root for x in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(1000, 1300)]}


def test_scores(spark, mixed, none):
    df, rows = mixed
    tokens = [[*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), None] for _, t in rows]
    held = [zlib.crc32(str("" if i is None else i).encode()) % 10 == 0 for i, _ in rows]
    count = collections.Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(count.values()), len(count)
    for order in (2, 3):
        got = sorted(map(tuple, scoring.score(df, order=order, shards=3, block_bytes=2000).collect()), key=str)
        expected = sorted(
            ((i, h, len(t), sum(count[w] > 0 for w in t), n, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for (i, _), h, t in zip(rows, held, tokens, strict=True)),
            key=str,
        )
        assert [g[:5] for g in got] == [x[:5] for x in expected]
        assert all(math.isclose(g[5], x[5], rel_tol=1e-9) and math.isfinite(g[6]) and g[6] <= 0 for g, x in zip(got, expected, strict=True))
    assert scoring.score(none).collect() == []


def test_scores_beat_the_base_on_held_out_text(spark):
    found = scoring.score(spark.read.parquet(f"{SF}/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert found[2] > 10 and found[0] > found[1] + 0.1 * abs(found[1])


def test_scores_are_a_mixture_that_sums_to_one():
    r = random.Random(9)
    texts = [" ".join(r.choice("ab cd ef gh".split()) for _ in range(20)).encode() for _ in range(30)]
    _, keys, contexts = scoring.ngrams(texts, 2)
    distinct, count = np.unique(keys[0], return_counts=True)
    pair = collections.Counter(keys[1].tolist())
    context = collections.Counter(contexts[0].tolist())
    given = int(keys[0][0])
    follow = {}
    for i, c in enumerate(contexts[0].tolist()):
        if c == given:
            follow[int(keys[0][i])] = pair[int(keys[1][i])]
    total = 0.0
    mix = scoring.learn_weights(np.array([[5.0, 0.1, 0.3, 0.0], [9.0, 0.1, 0.2, 0.6]]))
    assert math.isclose(mix.sum(), 1) and mix[0] >= scoring.FLOOR / 2
    for w, c in zip(distinct.tolist(), count.tolist(), strict=True):
        p, _ = scoring.estimates([np.array([float(c)]), np.array([float(follow.get(w, 0))]), np.array([float(context[given])])], 2, float(count.sum()), len(distinct))
        total += float((p[:, 0] * mix).sum())
    total += mix[0] / (len(distinct) + 1)  # the unknown word
    assert math.isclose(total, 1)


def exact_ids(text):
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids


def test_token_ids_equal_the_tokenizer():
    texts = [t or "" for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet'").fetchall()]
    for t in [*texts, "", "<|endoftext|>", "a<|endoftext|> b", "  \n\n x\t", "İstanbul ﬁ é́ 🙂 　", "x" * 300_000]:
        assert packing.token_ids(t).tolist() == exact_ids(t)


@pytest.mark.parametrize("part", [50_000, 5])
def test_packing(spark, mixed, none, part):
    df, rows = mixed
    got = packing.pack_documents(df, part=part).collect()
    pieces = collections.Counter()
    for i, t in rows:
        ids = [*exact_ids(t or ""), 2]
        first = len(ids) % 1024 or 1024
        starts = [0, *range(first, len(ids), 1024)]
        for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            pieces[i, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert collections.Counter((g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in got) == pieces
    sequences = collections.defaultdict(list)
    for g in got:
        sequences[g.sequence_id].append((g.offset, g.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    lengths = np.array([g.length for g in got])
    assert len(sequences) <= packing.lower_bound(lengths, 1024) + (0 if part > 5 else 2)
    assert packing.pack_documents(none).collect() == []


def test_bound_never_exceeds_the_best_packing():
    r = random.Random(4)
    for _ in range(200):
        capacity = r.randint(6, 20)
        lengths = [r.randint(1, capacity) for _ in range(r.randint(1, 7))]
        best = next(n for n in range(1, 8) if any(
            all(sum(x for x, b in zip(lengths, own, strict=True) if b == k) <= capacity for k in range(n)) for own in itertools.product(range(n), repeat=len(lengths))
        ))
        bins, offsets, fill = packing.best_fit(np.array(lengths), capacity)
        assert packing.lower_bound(np.array(lengths), capacity) <= best <= len(fill)
        assert max(fill) <= capacity and sorted(fill) == sorted(np.bincount(bins, lengths).astype(int))


def test_extraction_of_whole_pages(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract_pages(df).collect()}
    for r in df.collect():
        blocks = re.split(r"</?(?:h1|p)\b[^>]*>", re.search(r"<article>(.*)</article>", r.html, re.S)[1])
        text = "\n\n".join(b for b in (" ".join(pages_html.unescape(re.sub(r"<[^>]*>", " " if "<br" in x else "", x)).split()) for x in blocks) if b)
        assert got[r.page_id] == (text, len(text))


@pytest.mark.parametrize("page, text", [
    ("", ""), ("<!-- x -->", ""), ("plain  words", "plain words"), ("<p title='a > b'>hi <b>x</b>y &lt;z&gt; 1 < 2</p>", "hi xy <z> 1 < 2"),
    ("<div class=menu>Home</div><h1>T</h1><p>one two three four</p><div id='comments'><p>me too</p></div>", "T\n\none two three four"),
    ("<script>if (a < b) document.write('<p>x</p>')</script><p>real words here</p>", "real words here"),
    ("<div class='with sidebar'><article><p>a b&nbsp;c</p><aside>no</aside><form>no</form><p>d</p></article></div><footer>f</footer>", "a b c\n\nd"),
])
def test_extraction_of_odd_pages(page, text):
    assert html.extract(page, html.Weights({})) == text


@pytest.mark.parametrize("inner, text", [
    ("<p title='the old hidden valley'>a b</p>", "a b"), ("<h2 id='related-work'>Related</h2><p id='ad-hoc-networks'>a b</p>", "Related\n\na b"),
    ("<section id='social-effects' class='related-effects'><p>a b</p></section>", "a b"), ("<div class='article-header'><h1>The title in words</h1></div><p>a b</p>", "The title in words\n\na b"),
    ("<div data-id='share' data-class=\"hidden\" alt=\"style=display:none\">a b</div>", "a b"),
    ("<p>a b</p><div class='share'>no</div><p class='x comments'>no</p><div class='share-buttons'>no</div>", "a b"),
    ("<p>a b</p><p hidden>no</p><p aria-hidden=\"true\">no</p><p style='color:red; DISPLAY : none'>no</p>", "a b"),
])
def test_extraction_reads_attributes_inside_the_article(inner, text):
    for name in ("article", "main"):
        page = f"<h1 id='share-this'>no</h1><div id='related-links'>no</div><{name}>{inner}</{name}><div class='page-header'>no</div>"
        assert html.extract(page, html.Weights({})) == text


@pytest.mark.parametrize("open_, shut", [
    ("<section id='comments'>", "section"), ("<div id='comments'>", "div"), ("<ol class='comment-list'><li class='comment-body'>", "ol"), ("<section class='comments-area'>", "section"),
    ("<p class='notice-box'>", "p"), ("<div id='sidebar'>", "div"), ("<div id='cookie-consent'>", "div"), ("<div class='postComments'>", "div"), ("<div class='row article-share'>", "div"),
    ("<section id='comments'><article>", "article></section"), ("<span class='ad'>", "span"), ("<h2 id='comments'>", "h2"), ("<div class='ad-728x90'>", "div"),
])
def test_extraction_leaves_out_what_is_no_article_text(open_, shut):
    for page in ("<article><p>one two three four</p>{}<p>five six seven eight</p></article>", "<div><p>one two three four</p>{}<p>five six seven eight</p></div>"):
        if "<article>" in open_ and "<article>" not in page:
            continue  # the only article of a page is its article
        assert html.extract(page.format(f"{open_}no no no</{shut}>"), html.Weights({})) == "one two three four\n\nfive six seven eight"


@pytest.mark.parametrize("open_, shut", [
    ("<span class='ad-hoc'>", "span"), ("<div class='share-price'>", "div"), ("<a class='related'>", "a"), ("<div class='search-algorithms'>", "div"), ("<pre class='menu'>", "pre"),
    ("<h2 id='related-work'>", "h2"), ("<div id='ad-hoc-networks'>", "div"), ("<section id='social-effects'>", "section"), ("<h3 id='notice-periods'>", "h3"), ("<span class='token comment'>", "span"),
    ("<div class='entry-header'>", "div"), ("<h2 class='header'>", "h2"), ("<div class='has-sidebar'>", "div"),
])
def test_extraction_keeps_article_text_whose_names_look_like_marks(open_, shut):
    for page in ("<article><p>one two three four</p>{}<p>five six seven eight</p></article>", "<div><p>one two three four</p>{}<p>five six seven eight</p></div>"):
        assert html.extract(page.format(f"{open_}yes it is text</{shut}>"), html.Weights({})) == "one two three four\n\nyes it is text\n\nfive six seven eight"


def test_weights_of_names_are_learned(spark):
    said = "words that are said in the article of this page"
    rows = [(i, "u", f"<div class='glimpse'>{said}</div><div class='glimpse-ad'>x</div><article class='a'><p class='notice'>{said}</p><p>{said}</p></article>") for i in range(40)]
    one = [(100 + i, "u", f"<div class='rare{'x' * i}'>a</div><article><p>{said}</p></article>") for i in range(3)]
    learned = html.learn(spark.createDataFrame([*rows, *one], "page_id long, url string, html string"))
    assert learned.of_name("notice") == 0 and learned.of_name("glimpse") < 1 and learned.of_name("ad") == -6 and "n:rare" not in learned.by_feature and learned.of_name("rare") == html.CONTENT
    page = f"<article><p>{said}</p><p class='notice'>{said}</p><div class='glimpse-ad'>no</div></article>"
    assert html.extract(page, learned) == f"{said}\n\n{said}" and html.extract(page, html.Weights({})) == f"{said}\n\nno"


def test_best_region_equals_all_regions():
    r = random.Random(8)
    for _ in range(3000):
        scores = [r.choice([-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0]) for _ in range(r.randint(0, 12))]
        first, last = html.best_region(scores)
        best = max((sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=0.0)
        assert (first, last) == (0, 0) if best <= 0 else sum(scores[first:last]) == best
        if best > 0:
            longest = max(b - a for a in range(len(scores)) for b in range(a + 1, len(scores) + 1) if sum(scores[a:b]) == best)
            assert last - first == longest


def test_extraction_of_a_layout_absent_from_the_sample(spark):
    said = [" ".join(f"word{k}x{i}" for i in range(25)) for k in range(4)]
    seen = [(i, "u", f"<div>one</div><div>two</div><article><p>{said[0]}</p></article><{kind}>x</{kind}>") for i in range(300) for kind in ["dl" if i < 30 else "ul"]]
    other = "<p>" + "".join(f"<div><p>{x}</p></div>" for x in said)
    pages = spark.createDataFrame([*seen, (1000, "u", other)], "page_id long, url string, html string")
    assert html.extract_pages(pages).where("page_id = 1000").first().text == "\n\n".join(said)
    assert {"t:dl", "t:ul"} <= html.learn(pages, most=100).by_feature.keys() and "t:ul" in html.learn(pages, most=30).by_feature


def test_extraction_is_linear_and_takes_odd_rows(spark):
    for bad in ("<a title=\"x ", "<", "<p ", "<script>", "<![CDATA["):
        html.extract(bad * 20_000, html.Weights({}))
    df = spark.createDataFrame([(1, "u", None), (1, "u", None), (None, None, "<p>a b</p>")], "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("text", "n_chars")})
    assert sorted(map(str, map(tuple, html.extract_pages(df).collect()))) == ["(1, 'u', '', 0)", "(1, 'u', '', 0)", "(None, None, 'a b', 3)"]
    assert html.extract_pages(df.limit(0)).collect() == []


def test_urls(spark):
    cases = {
        None: ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "http://A.Net": ("a.net", "", None, "allow"), "http://A.Net/": ("a.net", "/", "net/", "block"),
        "https://x.example.net/en/a?b#c": ("x.example.net", "/en/a", "example.net/en/", "allow"), "http://example.net/EN/": ("example.net", "/EN/", "net/", "block"),
        "http://www.example.com/de/1": ("www.example.com", "/de/1", "example.com/de/", "block"), "http://myexample.com/de/1": ("myexample.com", "/de/1", None, "allow"),
        "http://casino-win.example.org/fr/": ("casino-win.example.org", "/fr/", "org/fr/", "allow"), "http://casino-win.org?q=/": ("casino-win.org", "", None, "block"), "://": ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "rule", "verdict")})
    got = urls.url_filter(df.unionAll(df)).orderBy("page_id").collect()
    assert [tuple(r)[1:] for r in got] == [c for c in cases.values() for _ in (0, 1)]
    assert urls.url_filter(df.limit(0)).collect() == []


def test_digest_array_confirms_strings(tmp_path, monkeypatch):
    entries = [f"host{i}.org" for i in range(500)]
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda b: len(b) % 3)  # every probe collides
    urls.write_array(entries, str(tmp_path / "a"))
    array = urls.DigestArray(str(tmp_path / "a"))
    assert array.find(entries[:40]).all() and not array.find(["host500.org", "", "x"]).any()
    urls.write_array([], str(tmp_path / "b"))
    assert not urls.DigestArray(str(tmp_path / "b")).find(["x"]).any()


def test_licences(spark, mixed, none):
    mit = "Copyright (c) 2020 Somebody\n\n" + licenses._MIT.replace("sublicense", "sublicence").replace('"', "“").upper()
    df = spark.createDataFrame([(1, mit), (1, mit), (2, "words\nReleased under the MIT Licence\nwords"), (3, licenses._ISC + " More."), (4, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.license, r.n_license_lines, r.line_licenses) for r in licenses.license_scan(df.withColumn("license", F.lit("x"))).collect() if r.doc_id != 3)
    assert got == [(1, "MIT", 0, ""), (1, "MIT", 0, ""), (2, None, 1, "MIT"), (4, None, 0, "")]
    assert licenses.license_scan(df.where("doc_id = 3")).first().license is None
    assert licenses.license_scan(mixed[0]).count() == len(mixed[1]) and licenses.license_scan(none).collect() == []


def test_licences_of_whole_texts_and_notices(spark):
    digests = collections.defaultdict(set)
    known = spark.createDataFrame(list(licenses.KNOWN), "license string, text string")
    for r in known.select("license", licenses.digest(F.array_join(licenses.canonical_lines(F.col("text")), " ")).alias("d")).collect():
        digests[r.d].add(r.license)
    assert all(len(x) == 1 for x in digests.values())
    texts = {f: open(f"{licenses.__file__[:-len('licenses.py')]}license_texts/{f}.txt").read() for f in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC-BY-SA-4.0", "CC0-1.0")}
    filled = texts["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2020 Some Body, Inc.")
    bsd = [t for k, t in licenses.KNOWN if k == "BSD-3-Clause" and t.startswith("\n")][0]
    whole = [*texts.items(), ("Apache-2.0", filled), ("Apache-2.0", texts["Apache-2.0"].split("END OF")[0]), ("GPL-3.0", texts["GPL-3.0"].replace("\n", "\r\n").upper()), ("BSD-3-Clause", "Copyright (c) 1999, J. R. Smith and Sons Ltd.\nAll rights reserved.\n" + bsd)]
    lines = [
        ("MIT", "Copyright 2020 X. Licensed under the MIT License."), ("MIT", "(c) 2020 J. R. Smith. All rights reserved. Released under the MIT License."), ("MIT", "Copyright (c) 2001-2020 Acme, Inc., licensed under the MIT licence"),
        ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
        ("CC-BY-NC-SA-4.0", "Released under CC BY-NC-SA 4.0"), ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."), ("LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ]
    rest = [(None, "Copyright 2020 Someone. The price of bread rose."), (None, "Copyright 2020 Someone. The price of bread fell.")]
    rows = [*whole, *((None, f"words\n{t}\nwords") for _, t in lines), *rest]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()}
    assert [got[i].license for i in range(len(rows))] == [k for k, _ in rows]
    assert [(got[len(whole) + i].n_license_lines, got[len(whole) + i].line_licenses) for i in range(len(lines))] == [(1, k) for k, _ in lines]
    assert len({got[len(rows) - i].text_digest for i in (1, 2)}) == 2


def test_carried_columns_may_be_named_like_those_inside_and_of_the_result(spark):
    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(300))
    rows = [(1, text, "a"), (2, "x" + text, "b"), (3, None, "c")]
    for name in ("key", "left", "right", "mark", "place", "__row", "spans", "Kept", "n_bytes", "sequence_id"):
        docs = spark.createDataFrame(rows, f"`{name}` long, text string, `first` string")
        left = suffixes.without_repeats(docs, id_col=name, carry=("first",), kept=True)
        same = name + "_" * (name in ("Kept", "n_bytes"))
        assert left.columns == [same, "first", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        assert sorted(map(tuple, left.select(left.columns[:4]).collect())) == [(1, "a", 300, 300), (2, "b", 301, 300), (3, "c", 0, 0)]
        later = phrases.without_later(docs.withColumn("text", F.repeat(F.lit("a b c d e f g "), 3)), id_col=name)
        assert later.columns == [name, "n_words", "n_removed", "kept_sha256"] and sorted(r[:3] for r in map(tuple, later.collect())) == [(1, 21, 0), (2, 21, 21), (3, 21, 21)]
        packed = packing.pack_documents(docs, id_col=name)
        assert packed.columns[0] == name + "_" * (name == "sequence_id") and sorted(r[0] for r in packed.collect()) == [1, 2, 3]
    for name in ("host", "Verdict", "key"):
        pages = spark.createDataFrame([(1, "http://a.net/"), (2, None)], f"`{name}` long, url string")
        assert [tuple(r)[0] for r in urls.url_filter(pages, id_col=name).collect()] == [1, 2] and urls.url_filter(pages, id_col=name).columns[0] == name + "_" * (name != "key")


def test_more_shards_with_more_text_give_the_same_rows(spark, mixed, monkeypatch):
    from fedloom.llm import anchors

    runs = [lambda: sorted(map(str, suffixes.without_repeats(mixed[0]).collect())), lambda: sorted(map(str, phrases.without_later(mixed[0]).collect()))]
    before = [run() for run in runs]
    monkeypatch.setattr(anchors, "SHARD_BYTES", 1 << 14)
    assert [run() for run in runs] == before


#: Lines and the licence each one states, written by hand.
STATED = [
    ("MIT", "Released under the MIT License."), ("MIT", "LICENSED UNDER THE MIT LICENCE"), ("MIT", "# Licensed under the MIT license"), ("MIT", "This file is distributed under the terms of the MIT License."),
    ("MIT", "Copyright 2020 X. Licensed under the MIT License."), ("MIT", "Copyright (c) 2001-2020 Acme, Inc., licensed under the MIT licence"), ("MIT", "(c) 2020 J. R. Smith. All rights reserved. Released under the MIT License."),
    ("MIT", "Copyright © [year] [name]. Released under the MIT License."), ("MIT", "Copyright 1999, 2001-05. SPDX-License-Identifier: MIT"), ("MIT", "Copyright 2001 Acme 2002 | License: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Made available under the Apache License v2.0"), ("Apache-2.0", "Copyright 2015 The Authors - licensed under the Apache License, version 2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"), ("GPL-2.0-or-later", "SPDX-License-Identifier: GPL-2.0+"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-NC-4.0", "Copyright (c) 2020 Someone (licensed under CC BY-NC 4.0)"),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."), ("MPL-2.0", "Copyright 2011 A. B. Co. Ltd. Licensed under the Mozilla Public License, Version 2.0."),
    ("", "Copyright 2020 Someone."), ("", "The MIT campus was licensed to nobody."), ("", "All rights reserved."), ("", "Copyright law of 1976 is older than the MIT License text."), ("", "A licence is needed to fish here."),
]


def test_licences_of_lines_written_by_hand(spark):
    docs = spark.createDataFrame([(i, f"words before\n{t}\nwords behind") for i, (_, t) in enumerate(STATED)], "doc_id long, text string")
    got = {r.doc_id: r.line_licenses for r in licenses.license_scan(docs).collect()}
    assert [(got[i], t) for i, (_, t) in enumerate(STATED)] == STATED


def test_canonical_lines_are_the_same_in_both_engines(spark):
    r = random.Random(3)
    parts = ["copyright", "(c)", "©", "2001", "20012", "2002-05", "[year]", "<date", "acme", "inc.", "x.", "someone.", "2003.", "!", ". ", ", ", "(", ")", "-", "/", "licensed under the mit license", "license:", "licence(s) :", "the mit x license", "this ", "all rights reserved", " ", " ", " ", "  "]
    lines = sorted({"".join(r.choice(parts[:3] + [""]) if not i else r.choice(parts) for i in range(r.randint(2, 14))) for _ in range(6000)})
    rows = spark.createDataFrame([(x,) for x in lines], "line string")
    ours = {x.line: x.c for x in rows.select("line", licenses.canonical_line(F.col("line")).alias("c")).collect()}
    with duckdb.connect() as con:
        con.execute("CREATE TABLE t(line VARCHAR)")
        con.executemany("INSERT INTO t VALUES (?)", [(x,) for x in lines])
        theirs = dict(con.execute(f"SELECT line, {queries._canonical_sql('line')} FROM t").fetchall())
    assert {x: (ours[x], theirs[x]) for x in lines if ours[x] != theirs[x]} == {}


def test_licences_take_linear_time(spark):
    shapes = ["(c) 2001 ", "copyright 2001, x ", "© ", "copyright a. ", "(c) 2001 mit ", "(c) 2001 license;", "(c) 2001 " + "a", "copyright 2001" + " ", "(", "2001 ", "all rights reserved "]
    for n in (1_000, 1_000_000):
        rows = [(i, (s * n)[:n]) for i, s in enumerate(shapes)] + [(90, "(c) 2001 " + "a" * n), (91, "(c) 2001" + " " * n), (92, "(c) " + "2" * n), (93, "copyright 2001 " + "x. " * (n // 3) + "Licensed under the MIT License.")]
        began = time.monotonic()
        assert licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(len(rows))).count() == len(rows)
        took = time.monotonic() - began
    assert took < 60


def test_every_notice_of_the_given_tables_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    notice = F.size(F.filter(F.split("text", "[\r\n]"), lambda x: F.lower(x).rlike("licen[sc]ed under|released under")))
    wanted = {r.doc_id: r.n for r in docs.select("doc_id", notice.alias("n")).where("n > 0").collect()}
    assert {r.doc_id: r.n_license_lines for r in licenses.license_scan(docs).where("n_license_lines > 0").collect()} == wanted and len(wanted) > 200


def distance_within(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_leaks_equal_brute_force(spark):
    r = random.Random(6)
    words = ["".join(r.choice("abcd") for _ in range(r.randint(1, 5))) for _ in range(30)]
    items = [(k, " ".join(r.choice(words) for _ in range(r.randint(5, 25)))) for k in range(12)] + [(90, None), (91, " ")]
    docs = []
    for i in range(60):
        item = list(r.choice(items[:12])[1])
        for _ in range(r.randint(0, 8)):
            at = r.randrange(len(item))
            item[at:at + r.randint(0, 1)] = r.choice(["", "x", "e"])
        docs.append((i, " ".join(r.choice(words) for _ in range(15)) + " " + "".join(item).replace(" ", r.choice([" ", "\n "])) + " " + " ".join(r.choice(words) for _ in range(15))))
    docs += [(70, None), (71, ""), (72, items[0][1]), (72, items[0][1])]
    rate = 0.1
    expected = []
    for (i, t), (k, item) in itertools.product(docs, items):
        one = leak.normal(item)
        if one and (d := distance_within(one, leak.normal(t))) <= int(len(one) * rate):
            expected.append((i, k, d))
    a, b = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASH}), spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 100):
        found = leak.leaks(a, b, rate, block_chars=block).collect()
        assert sorted((f.doc_id, f.item_id, f.distance) for f in found) == sorted(expected)
        left = leak.clean(a, b, rate, block_chars=block)
        assert left.columns == a.columns and sorted(x.doc_id for x in left.collect()) == sorted(i for i, _ in docs if i not in {e[0] for e in expected})
    files = leak.store_items(b, "item_id", "text", 100)
    blocks = list(leak.StoredItems(files, rate, 100).matchers())
    assert len(files) > 3 and len(blocks) > 3 and sorted(k for keys, _ in blocks for k in keys) == sorted(k for k, t in items if leak.normal(t))
    for one in (leak.leaks(a, b, rate, block_chars=100), leak.clean(a, b, rate, block_chars=100)):  # one reading of the documents, whatever the number of items
        plan = one._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Union" not in plan and "Join" not in plan
    text = dict(docs)
    assert all(distance_within(leak.normal(dict(items)[f.item_id]), leak.normal(text[f.doc_id])[f.start:f.end]) == f.distance for f in found)
    assert leak.leaks(a.limit(0), b).collect() == [] and leak.leaks(a, b.limit(0)).collect() == [] and leak.clean(a, b.limit(0)).count() == len(docs)


def test_quality_ledger(spark, mixed, none):
    df, rows = mixed
    got = quality.quality_rules(df.drop("n_words", "kept"))
    assert got.count() == len(rows) and all(r.base_failed and not r.kept for r in got.where("doc_id IN (50, 51, 52)").collect())
    for r in got.collect():
        text = next((t or "" for i, t in rows if i == r.doc_id), "")
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        again = {j for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(again))
    table = quality.ablations(got)
    plain = got.collect()
    for a in table.collect():
        policy = quality.BASE if a.policy == "base" else quality.STRICT
        bit, mask = quality.mask_of(quality.Policy("", 1, (a.rule,))), quality.mask_of(policy)
        assert a.n_failing == sum(bool(r.fail_bits & bit) for r in plain)
        assert a.n_only == sum(r.fail_bits & mask == bit for r in plain) and a.n_kept == sum(not r.fail_bits & mask for r in plain)
    assert quality.quality_rules(none).collect() == []


def test_quality_keeps_labelled_good_documents(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.quality_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(labels, "doc_id").collect()
    assert all(r.kept for r in rows if r.quality == 1 and not r.base_failed) and not any(r.kept for r in rows if r.quality == 0)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cursor = duck.execute(queries.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


def test_the_query_scores_trigrams(spark):
    total = F.sum("score")
    asked = scoring.score(spark.read.parquet(f"{SF}/documents.parquet"), order=3).agg(total).first()[0]
    assert math.isclose(queries.op2(spark, SF).agg(total).first()[0], asked, rel_tol=1e-9)


@pytest.mark.parametrize("run", [suffixes.without_repeats, phrases.without_later, scoring.score, licenses.license_scan])
def test_rows_keep_their_numbers_when_cores_are_lost(spark, tmp_path, run):
    """Eight files are one partition each for eight cores, and fewer for one core."""
    cores, least = "spark.sql.leafNodeDefaultParallelism", "spark.sql.files.minPartitionNum"
    path = str(tmp_path / "documents")
    spark.read.parquet(f"{SF}/documents.parquet").repartition(8, "doc_id").write.parquet(path)
    docs = spark.read.parquet(path)
    spark.conf.unset(least)
    spark.conf.set(cores, "8")
    try:
        expected = sorted(map(str, run(docs).collect()))
        spark.conf.unset(least)
        found = run(docs)
        spark.conf.set(cores, "1")
        assert sorted(map(str, found.collect())) == expected
    finally:
        spark.conf.unset(cores)
        spark.conf.unset(least)


def test_all_are_registered():
    assert {int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES} == set(range(1, 14))

"""Span scans, licences, HTML, URLs, quality, decontamination and mixing."""

import hashlib
import html
import math
import random
import re
import struct
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from contentmill.llm import decontaminate, html_text, licenses, mixing, pii, quality, secrets, skew, spans, url_filter
from contentmill.llm.hashing import blocks
from contentmill.llm.queries import URL_RULES
from contentmill.llm.workspace import Workspace

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def digest(found):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found)).encode()).hexdigest()


def base_secrets(t):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    return out + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]


def luhn(s):
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(s)))) % 10 == 0


def base_pii(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


def fuzz(pieces, n=250, seed=4):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14))) for _ in range(n)]


SECRET_PIECES = ["password", "TOKEN", "api_key", "apikey", "Secret", ":", "=", " ", '"', "'", "abcdefghijkl", "short", "AKIA", "AKIAABCDEFGHIJKLMN", "0123456789abcdef", "deadbeef", "é", "\n", "😀", "Zz9+/", "."]
PII_PIECES = ["a.b", "@", "example", ".", "com", "1", "23", "192.168.0.1", "256", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (325) 555-8094", "+", "-", " ", "(", ")", "é", "😀", "\n", "000"]
LONG = {"secret": "deadbeef" * 3000 + " é " + "x " * 20000 + "token=" + "Q7x" * 9000 + " ab" * 20000, "pii": "1 " * 30000 + "a" * 60000 + " 4111111111111111 " + ".".join(["1"] * 20000) + " x@" + ".".join(["a"] * 20000)}


def table(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, spans string, start int")


@pytest.mark.parametrize("kind", ["secret", "pii"])
def test_base_spans_equal_python(spark, kind):
    texts = [None, "", *fuzz(SECRET_PIECES if kind == "secret" else PII_PIECES), LONG[kind], "repeat", "repeat"]
    docs = table(spark, texts).repartition(4)
    found = secrets.secret_digest(secrets.scan_secrets(docs)) if kind == "secret" else pii.pii_digest(pii.find_pii(docs))
    got = {r.doc_id: r for r in found.collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        base = (base_secrets if kind == "secret" else base_pii)(t or "")
        assert got[i].base_sha256 == digest(base), (i, t and t[:200])
        names = [x for x in got[i].asDict() if x.startswith("n_")]
        assert all(got[i][n] == sum(k == n[2:] for *_, k in base) for n in names)
        assert set(f"{k}:{s}:{e}" for s, _, e, k in base) <= set(got[i].spans.split(","))


def test_markov_finds_noise_and_leaves_words(spark):
    noise = ["Xq7Rk2Lp9Vt4Zn8Wc3Yb", "hT9sKd02LmQx7VbN4cRz8w"]
    words = ["getUserNameFromRequest", "connection_pool_max_size", "====================", "internationalisation"]
    got = secrets.secret_digest(secrets.scan_secrets(table(spark, [f"see {w} here" for w in noise + words]))).orderBy("doc_id").collect()
    assert [r.spans for r in got] == [f"markov:4:{4 + len(w)}" for w in noise] + [""] * 4


def test_markov_on_held_out_samples(spark):
    rng = random.Random(21)
    letters = "abcdefghijklmnopqrstuvwxyz"
    base36, base62 = letters + "0123456789", letters + letters.upper() + "0123456789"
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    words = "river mountain customer invoice payment window garden kitchen travel monthly account balance transfer weather station morning orange planet signal engine bridge castle forest Rechnung Zahlung Fenster Garten Küche maison fenêtre voiture ventana cocina jardín".split()
    some = lambda n: [rng.choice(words) for _ in range(n)]
    noise = {
        "base62 of 24": lambda: pick(base62, 24),
        "base62 of 40": lambda: pick(base62, 40),
        "base36 of 20": lambda: pick(base36, 20),
        "hex head": lambda: pick("0123456789abcdef", 16) + pick(base62, 16),
        "named": lambda: f"name={pick(base62, 24)}",
        "dotted": lambda: f"{pick(base62, 16)}.{pick(base62, 18)}",
        "in a path": lambda: f"/srv/{rng.choice(words)}/{pick(base62, 24)}/index",
        "base64": lambda: pick(base62 + "+/", 44) + "=",
    }
    plain = {
        "camel": lambda: "".join(w.title() for w in some(4)),
        "snake": lambda: "_".join(some(4)),
        "kebab": lambda: "-".join(some(4)),
        "constant": lambda: "_".join(some(3)).upper(),
        "joined": lambda: "".join(some(3)),
        "path": lambda: "/".join(some(5)),
        "numbered": lambda: f"{rng.choice(words)}-{rng.randrange(10**4)}-{rng.choice(words)}",
        "date": lambda: f"20{rng.randrange(10, 30)}-{rng.randrange(10, 13)}-{rng.randrange(10, 29)}-{rng.randrange(10, 24)}-{rng.randrange(10, 60)}-00",
    }
    texts = [(kind, f"see {make()} here") for kinds in (noise, plain) for kind, make in kinds.items() for _ in range(150)]
    got = secrets.scan_secrets(table(spark, [t for _, t in texts])).select("doc_id", F.size("markov").alias("n")).collect()
    hit = {}
    for r in got:
        hit.setdefault(texts[r.doc_id][0], []).append(r.n > 0)
    share = {k: sum(v) / len(v) for k, v in hit.items()}
    assert all(share[k] >= 0.9 for k in noise), share
    assert all(share[k] <= 0.02 for k in plain), share


def test_markov_scores_equal_brute_force(spark):
    model = secrets.train_markov(secrets.samples(spark, 500))
    k, place = len(secrets.ALPHABET) + 1, {c: i + 1 for i, c in enumerate(secrets.ALPHABET)}
    sample = [(r.body, r.random) for r in secrets.samples(spark, 500).collect()]
    counts = {c: np.ones((k, k)) for c in (True, False)}
    for body, kind in sample:
        p = [place.get(c, 0) for c in body]
        for x, y in zip(p, p[1:], strict=False):
            counts[kind][x, y] += 1
    logs = {c: np.log(m / m.sum(1, keepdims=True)) for c, m in counts.items()}
    expected = np.round(logs[True] - logs[False], 6)
    assert np.allclose(np.array(model).reshape(k, k), expected)
    texts = ["Xq7Rk2Lp9Vt4Zn8Wc3Yb", "a", "", "plain_words_only é", "aB3/" * secrets.CHUNK + "zQ", "x" * (secrets.CHUNK + 1), "y" * (secrets.CHUNK + 2)]
    ratios = F.from_json(F.lit("[" + ",".join(map(str, model)) + "]"), "array<double>")
    got = [r[0] for r in table(spark, texts).orderBy("doc_id").select(secrets.markov_ratio(F.col("text"), ratios)).collect()]
    for t, g in zip(texts, got, strict=True):
        p = [place.get(c, 0) for c in t]
        assert math.isclose(g, sum(expected[x, y] for x, y in zip(p, p[1:], strict=False)), rel_tol=1e-9, abs_tol=1e-6)


def test_markov_leaves_the_tables_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert secrets.scan_secrets(docs).where("size(markov) > 0").count() == 0


def test_masking(spark):
    docs = table(spark, ["é token = abcdefghijklmnop end", "clean", None, "ab 0123456789abcdef0123"])
    assert [r.text for r in secrets.mask_secrets(docs).orderBy("doc_id").collect()] == ["é <secret> end", "clean", None, "ab <secret>"]
    assert secrets.mask_secrets(docs).columns == docs.columns


def test_patterns_reveal_identifiers(spark):
    texts = [f"the client mail is user{i}@example.com now" for i in range(30)] + ["the client mail is AB1234567 now", "my own number AB7654321 now", None]
    found = pii.find_pii(table(spark, texts))
    assert [(r.doc_id, r.context[0].kind) for r in found.where("size(context) > 0").collect()] == [(30, "context-email")]
    assert pii.find_pii(table(spark, texts).limit(0)).count() == 0


def test_patterns_reveal_further_patterns(spark):
    # A: seeds reveal members' numbers; B: those numbers reveal a pattern; C: it reveals others.
    texts = [f"w{i} please call phone +1 (325) 555-{8000 + i} x{i}" for i in range(40)]
    texts += [f"v{i} please call phone M{700000 + i} y{i}" for i in range(12)]
    texts += [f"u{i} our member card M{700000 + i} z{i}" for i in range(12)]
    texts += ["t our member card 0171 2345678 s", "r our member card 12.345.678-9 q"]
    texts += [f"p{i} built in year {100000 + i} o{i}" for i in range(30)] + ["n built in year M700003 m"]
    got = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.context] for r in pii.find_pii(table(spark, texts)).where("size(context) > 0").collect()}
    assert set(got) == set(range(40, 66)), got
    assert got[64] == [("context-phone", "0171 2345678")] and got[65] == [("context-phone", "12.345.678-9")]


def brute_patterns(edges):
    graph = {}
    for p, i, k in edges:
        graph.setdefault(p, {})
        graph[p][i] = min(x for x in (k, graph[p].get(i)) if x) if k or graph[p].get(i) else None
    graph = {p: g for p, g in graph.items() if len(g) >= pii.SEEDS_LEAST}
    trust, known = {}, None
    while True:
        out = {}
        for p, g in graph.items():
            scores = [(1.0, k) if k else trust.get(i, (0.0, None)) for i, k in g.items()]
            total, trusted = sum(s for s, _ in scores), [x for x in scores if x[1]]
            c = total / (total + pii.UNKNOWN * (len(scores) - len(trusted)) + 1)
            if len(trusted) >= pii.SEEDS_LEAST and c >= pii.CONFIDENCE_LEAST:
                mass = {}
                for s, k in trusted:
                    mass[k] = mass.get(k, 0) + s
                out[p] = (c, max(mass, key=lambda k: (round(mass[k], 9), k)))
        if len(out) == known or not out:
            return out
        known, trust = len(out), {}
        for p, x in out.items():
            for i, k in graph[p].items():
                if not k:
                    trust[i] = max(trust.get(i, (0.0, "")), x)


@pytest.mark.parametrize("hot", [1, 6, 1000])
def test_patterns_equal_brute_force(spark, monkeypatch, hot):
    """At any bound for hot keys; one pattern and one instance have half of the rows."""
    monkeypatch.setattr(skew, "HOT_SHARE", hot)
    rng = random.Random(9)
    edges = []
    for _ in range(900):
        p = min(int(rng.expovariate(0.12)), 30)
        i = rng.randrange(60) + 40 * (p % 4)
        edges.append((f"p{p}", f"i{i}", rng.choice(("email", "phone")) if i % 3 and i < 90 else None))
    edges += [("p0", f"i{rng.randrange(200)}", None) for _ in range(450)] + [(f"p{rng.randrange(30)}", "i91", None) for _ in range(450)]
    df = spark.createDataFrame(edges, "pattern string, instance string, kind string")
    got = {r.pattern: (r.confidence, r.kind) for r in pii.learn_patterns(Workspace(spark, "t"), df).collect()}
    expected = brute_patterns(edges)
    assert got.keys() == expected.keys() and len(got) > 3
    assert all(math.isclose(got[p][0], expected[p][0]) and got[p][1] == expected[p][1] for p in got)


def test_long_words_stay_whole_in_patterns(spark):
    word = "w" * 500
    texts = [f"{word} {word} user{i}@example.com" for i in range(20)] + [f"{word} {word} A1234567", f"{word} v{word[1:]} A7654321"]
    assert [r.doc_id for r in pii.find_pii(table(spark, texts)).where("size(context) > 0").collect()] == [20]


def test_running_starts_are_exact_past_one_chunk(spark):
    n = 3 * spans.CHUNK + 7
    got = secrets.scan_secrets(table(spark, [" 0123456789abcdef" * n])).first()["hex"]
    assert [s.start for s in got] == [1 + 17 * i for i in range(n)]


def test_licenses(spark):
    texts = ["x\nReleased under the MIT License.\ny", "This work is licensed under the GNU General Public License, version 3. And more.", "a license plate", None, "", "Licensed under CC BY 4.0.", "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.", "released UNDER the, mit license"]
    got = {(r.doc_id, r.license): (r.dice, r.n_passages) for r in licenses.scan_licenses(table(spark, texts)).collect()}
    # A whole text that is little more than the statement is a passage too.
    assert got == {(0, "MIT"): (1.0, 2), (1, "GPL-3.0"): (1.0, 2), (5, "CC-BY-4.0"): (1.0, 1), (6, "CC-BY-NC-4.0"): (1.0, 2), (7, "MIT"): (1.0, 1)}
    assert licenses.scan_licenses(table(spark, texts).limit(0)).count() == 0


def test_license_windows_run_over_lines_and_sentences(spark):
    fill = "plain prose about a river\nand the town on its banks. "
    wrap = lambda t: "\n".join(" ".join(t.split()[i : i + 9]) for i in range(0, len(t.split()), 9))
    mit, gpl3 = licenses.NOTICES["MIT"], licenses.full_texts()["GPL-3.0"][0]
    texts = [mit[0], wrap(mit[0]), fill + wrap(mit[1]) + fill, fill + wrap(licenses.TEMPLATES["BSD-3-Clause"][1]), fill + licenses.NOTICES["GPL-3.0"][0], "This article is licensed under CC BY 4.0.", "The code of this project is released under the MIT License.", fill * 20 + wrap(gpl3) + fill, fill * 30, "Released under the\nMIT License. " + fill * 3 + "It is licensed under\nCC BY-NC 4.0.", f"{fill}This work is licensed under the GNU General Public\nLicense, version 2.\n{fill}"]
    got = {}
    for r in licenses.scan_licenses(table(spark, texts)).collect():
        got.setdefault(r.doc_id, {})[r.license] = r.dice
    assert {i: set(x) for i, x in got.items()} == {0: {"MIT"}, 1: {"MIT"}, 2: {"MIT"}, 3: {"BSD-3-Clause"}, 4: {"GPL-3.0"}, 5: {"CC-BY-4.0"}, 6: {"MIT"}, 7: {"GPL-3.0"}, 9: {"MIT", "CC-BY-NC-4.0"}, 10: {"GPL-2.0"}}
    assert all(d == 1.0 for x in got.values() for d in x.values())


def test_license_window_anchors_lose_nothing():
    texts = [t for table in (licenses.TEMPLATES, licenses.NOTICES, licenses.full_texts()) for ts in table.values() for t in ts]
    words = licenses.window_anchors(texts, 0.8)
    for grams in map(licenses.bigram_list, texts):
        assert sum(not any(f" {w}" in f" {g}" for w in words) for g in grams) < 0.8 / 1.2 * len(grams)


def test_gates_match_what_their_words_match():
    words = licenses.window_anchors([t for ts in (licenses.TEMPLATES, licenses.NOTICES, licenses.full_texts()) for x in ts.values() for t in x], 0.8)
    branched, flat = (re.compile(f"(?<![a-z0-9])(?:{p})") for p in (licenses.one_of(words), "|".join(words)))
    rng = random.Random(3)
    texts = [" ".join(rng.choice([*words, "the", "x", "cop"])[: rng.randrange(1, 12)] for _ in range(3)) for _ in range(5000)]
    assert {bool(flat.search(t)) for t in texts} == {True, False} and all(bool(branched.search(t)) == bool(flat.search(t)) for t in texts)


def test_licence_anchors_lose_nothing():
    words = licenses.anchors(licenses.TEMPLATES, 0.8)
    for text in (t for ts in licenses.TEMPLATES.values() for t in ts):
        grams = licenses.bigram_list(text)
        assert sum(not any(f" {w}" in f" {g}" for w in words) for g in grams) < 0.8 / 1.2 * len(grams)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><article>";</script><style>p{}</style></head><body>
<header><a href=/>Home</a></header><nav><ul><li><a href="/x">one</a><li><a href="/y">two</a></ul></nav>
<div class="cookie-notice">We use cookies</div><main><article><header><h1>Ti&shy;tle &amp; more</h1></header>
<p>First <b>bold</b> para&#8217;s\n\n text<p>Second<br>line <a href="/z">link</a>
<ul><li>item</li></ul><aside>Related</aside><form><input><button>Go</button>field</form><!-- hidden <p>x</p> -->
<table><tr><td>cell</td></tr></table></article><section id="comments"><p>Reader says</p></section></main>
<div id="sidebar">Side</div><footer>&copy; f</footer></body></html>"""


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "plain words with no markup at all", "x"), (5, "u", "<p>a" * 3000, "x"), (6, "u", "<article>" + "<div>" * 2000 + "deep", "x"), (6, "u", "<", "x")], "page_id long, url string, html string, text string")
    got = {(r.page_id, r.text): r.n_chars for r in html_text.extract_text(pages).collect()}
    assert (1, html.unescape("Ti&shy;tle & more\nFirst bold para’s text\nSecond\nline link\nitem\ncell")) in got
    assert got[2, ""] == 0 and got[3, ""] == 0 and (4, "plain words with no markup at all") in got and (6, "deep") in got
    assert all(n == len(t) for (_, t), n in got.items())
    assert html_text.extract_text(pages.limit(0)).count() == 0


STORY = "<h1>A title of the day</h1><p>One paragraph of the story has some words in it, and more.</p><p>Another one follows here and it ends the story of today.</p>"
STORY_TEXT = "A title of the day\nOne paragraph of the story has some words in it, and more.\nAnother one follows here and it ends the story of today."


WRAPPERS = ["<div class='content-sidebar-wrap'>", "<div class='layout has-sidebar'>", "<div class='post comments-open'>", "<form id=aspnetForm><input type=hidden>", "<form role=form><main>", "<div class=widget><main>", "<div class=sidebar><article>", "<div class=advert>", "<article class='post comments related'>", "<section>", ""]


@pytest.mark.parametrize("opening", WRAPPERS)
def test_html_wrappers_keep_the_article(opening):
    tree = html_text.train_tree()
    assert html_text.main_text(f"<body><ul class=menu><li><a href=/>Home</a></ul>{opening}{STORY}", tree) == STORY_TEXT


def test_html_elements_around_the_article_stay_out():
    tree = html_text.train_tree()
    talk = "<p>A reader says a few things about this story here.</p>"
    story = STORY + STORY
    page = f"<body><form><p>Search this site for words of any kind and more</p></form><div class='site-sidebar'>{talk}</div><main><article>{story}</article><section id=comments><article class='comment-body'>{talk}</article></section></main><div class='footer-widgets'>{talk}</div>"
    assert html_text.main_text(page, tree) == f"{STORY_TEXT}\n{STORY_TEXT}"
    # Names say nothing: comments and notices are told by their neighbours alone.
    for name in ("reader-remarks", "article-body", "x"):
        page = f"<body><ul><li><a href=/>Home</a></ul><div>{story}</div><div class={name}><div><a href=/u>Bob</a></div><div>{talk}</div><div><a href=/v>Eve</a></div><div>{talk}</div></div>"
        assert html_text.main_text(page, tree) == f"{STORY_TEXT}\n{STORY_TEXT}"


def test_html_of_common_layouts():
    w = lambda n, s="w": " ".join(f"{s}{i}" for i in range(n))
    blog = f"<body><header><a href=/>Site</a><p>Just another site</p></header><main><article><header><h1>The title of post</h1><div class=meta>By <a>Bob</a> on May 1</div></header><div class=c><p>{w(60)}</p><h2>Sub head</h2><p>{w(45)}</p><ul><li>{w(8)}<li>{w(9)}</ul><p>{w(30)}</p></div></article><section><h2>3 comments</h2><div><a>Ann</a><p>{w(14)}</p></div><div><a>Joe</a><p>{w(25)}</p></div></section></main><footer>c</footer>"
    boxes = f"<body><div><a>Home</a> <a>News</a></div><div><h1>Title of it</h1><div>{w(50)}</div><div>{w(70)}</div><div>{w(40)}</div></div><div><h3>Related</h3><ul><li><a>{w(5)}</a><li><a>{w(6)}</a></ul></div><div>{w(9)} <a>terms</a></div>"
    notice = f"<body><div>{w(14)} <a>ok</a></div><ul><li><a>a</a><li><a>b</a></ul><div><h1>Hello there you</h1><p>{w(20)}</p><p>{w(35)}</p></div><div>{w(12)}</div>"
    tree = html_text.train_tree()
    assert html_text.main_text(blog, tree) == "\n".join(["The title of post", w(60), "Sub head", w(45), w(8), w(9), w(30)])
    assert html_text.main_text(boxes, tree) == "\n".join(["Title of it", w(50), w(70), w(40)])
    assert html_text.main_text(notice, tree) == "\n".join(["Hello there you", w(20), w(35)])


def article_of(page):
    inner = re.search("<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split("</?p>|<br>|</?h1>", inner)]
    return "\n".join(b for b in blocks if b)


def test_html_of_the_tables_with_and_without_article_tags(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    expected, tree = [article_of(p) for p in pages], html_text.train_tree()
    for put in ("<article>", "", "<div class='related comments'>", "<section id=sidebar>"):
        end = f"</{put[1:].split()[0].strip('>')}>" if put else ""
        assert html_text.main_texts([p.replace("<article>", put).replace("</article>", end) for p in pages], tree) == expected


def test_html_neighbours_decide(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()]
    tree, x, y = html_text.train_tree(), *html_text.labelled_blocks()
    assert ((html_text.judge(tree, x) >= 0.5) == y).mean() >= 0.99
    blocks = [html_text.text_blocks(p) for p in pages]
    for names in (html_text.NEIGHBOURS, ("together",), ("text_before", "text_after", "words_before", "words_after", "links_before", "links_after")):
        changed = 0
        for b in blocks:
            features = html_text.block_features(b)
            before = html_text.judge(tree, features) >= 0.5
            features[:, [html_text.FIELDS.index(f) for f in names]] = 0
            changed += bool((before != (html_text.judge(tree, features) >= 0.5)).any())
        assert changed > 0, names


def test_html_malformed_pages_take_linear_time():
    tree = html_text.train_tree()
    n = 50_000
    start = time.perf_counter()
    for page in ("<a x" * 5 * n + '"', "<b>" * n + "<p></p>" * n + "</x>" * n, "<p><button>" + "<b>" * n + "<li></li>" * n, "<!--" * 5 * n, "<table>" * n + "</p>" * n, "<a b='" * n, "<" * 5 * n, "<p " + "x " * 5 * n):
        html_text.main_text(page, tree)
    assert time.perf_counter() - start < 20


def test_html_edges(spark):
    # Repeated rows, null ids, clashing columns, text ids.
    rows = [("a", "u", "<p>one two three", "x"), ("a", "u", "<p>one two three", "x"), (None, None, "<nav>menu</nav>", "x"), ("b", "u", "<p>" + "word " * 200_000, "x")]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string, n_chars string")
    got = sorted(((r.page_id or "", r.n_chars) for r in html_text.extract_text(pages).collect()))
    assert got == [("", 0), ("a", 13), ("a", 13), ("b", 999_999)]


def rule_of(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    fit = [(h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit, key=lambda x: len(x[0])) if fit else (None, None))


@pytest.mark.parametrize("in_place", [True, False])
def test_url_rules_equal_brute_force(spark, monkeypatch, in_place):
    monkeypatch.setattr(url_filter, "RULES_IN_PLACE", 256 if in_place else 0)
    rng = random.Random(2)
    urls = [f"{rng.choice(('http', 'HTTPS', ''))}://{rng.choice(('a.', 'B.c.', ''))}{rng.choice(('example.com', 'Example.NET', 'org', 'xnet', 'net'))}{rng.choice(('/en/7', '/en/8', '/de/8', '/de/', '/es/1', '', '?x=/en/', '#/en/', '/En/7'))}" for _ in range(120)]
    urls += [None, "", "no scheme", "http://", "x://y://z/en/", "http://é.com/en/ü\n/x"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, URL_RULES).collect()}
    for i, u in enumerate(urls):
        host, path, rule, verdict = rule_of(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule) and got[i].verdict == (verdict or got[i].verdict) and got[i].verdict in ("block", "allow")
    assert url_filter.filter_urls(pages.limit(0), URL_RULES).count() == 0


def brute_templates(keys):
    """(host, segments) -> (template, share), by recursion over each host's keys (bad, labels)."""
    P, L, W, V = url_filter.MERGE_ERRORS, url_filter.MERGE_LABELS, url_filter.PARENT_WEIGHT, url_filter.VARIETY_LEAST
    smooth = lambda bad, n, parent: (bad + W * parent) / (n + W)
    sums = lambda part: (sum(keys[k][0] for k in part), sum(keys[k][1] for k in part))
    out = {}

    def walk(part, template, level, parent):
        share = smooth(*sums(part), parent)
        for k in part:
            if len(k[1]) == level:
                out[k] = (template, share)
        part = [k for k in part if len(k[1]) > level]
        bad, n = sums(part)
        if len(part) < V and n < 2 * L:
            for k in part:
                out[k] = ("/".join([template, *k[1][level:]]), smooth(*keys[k], share if level else elsewhere(k[0], k[1][0], share)))
            return
        kinds = {}
        for k in part:
            kinds.setdefault(k[1][level], []).append(k)
        if len(kinds) == 1:
            end = level
            while len({k[1][end] if len(k[1]) > end else None for k in part}) == 1 and len(part[0][1]) > end:
                end += 1
            return walk(part, "/".join([template, *part[0][1][level:end]]), end, share if level else elsewhere(part[0][0], part[0][1][0], share))
        groups = {}
        for segment, own in kinds.items():
            b, m = sums(own)
            if m >= L and n - m >= L:
                pooled = (bad + 1) / (n + 2)
                joined = abs(b / m - (bad - b) / (n - m)) <= P * math.sqrt(pooled * (1 - pooled) * (1 / m + 1 / (n - m)))
            else:
                joined = len(kinds) >= V and len(kinds) >= url_filter.VARIETY_SHARE * len(part)
            groups.setdefault("*" if joined else segment.replace("*", "%2A"), []).extend(own)
        for segment, own in groups.items():
            walk(own, f"{template}/{segment}", level + 1, share if level or segment == "*" else elsewhere(own[0][0], own[0][1][0], share))

    suffixes = lambda host: ["*", *[".".join(host.split(".")[-i:]) for i in range(1, len(host.split(".")) + 1)]]
    nodes, hosts = {}, {}
    for k, (bad, n) in keys.items():
        hosts.setdefault(k[0], []).append(k)
        for s in suffixes(k[0]):
            x = nodes.setdefault(s, {}).setdefault(k[1][0] if k[1] else "", [0, 0])
            x[0], x[1] = x[0] + bad, x[1] + n

    def elsewhere(host, prefix, share):
        for s in suffixes(host)[:-1]:
            share = smooth(*nodes[s].get(prefix, (0, 0)), share)
        return share

    for host, part in hosts.items():
        share = url_filter.PRIOR_SHARE
        for s in suffixes(host):
            told = [b / n for b, n in nodes[s].values() if n]
            share = smooth(sum(told), len(told), share)
        walk(part, "", 0, share)
    return out


def judged_by_brute(urls, labels, rules):
    keys, known = {}, []
    for u, told in zip(urls, labels, strict=True):
        host, path, _, ruled = rule_of(u) if rules else (*rule_of(u)[:2], None, None)
        known.append(((host, tuple(s for s in path.split("/") if s)), ruled or told))
    for k, v in known:
        keys.setdefault(k, []).append(v)
    found = brute_templates({k: (sum(v == "block" for v in vs) / max(1, sum(v is not None for v in vs)), float(any(v is not None for v in vs))) for k, vs in keys.items()})
    return [(*found[k], v or ("block" if found[k][1] >= url_filter.REJECT_FROM else "allow")) for k, v in known]


def check_templates(spark, urls, labels, rules):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    told = spark.createDataFrame([(i, v) for i, v in enumerate(labels) if v], "page_id long, verdict string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, URL_RULES if rules else [], told).collect()}
    assert len(got) == len(urls)
    for i, (template, share, verdict) in enumerate(judged_by_brute(urls, labels, rules)):
        assert got[i].template == template and math.isclose(got[i].impurity, share, rel_tol=1e-9) and got[i].verdict == verdict, (urls[i], got[i], template, share, verdict)
    return [got[i] for i in range(len(urls))]


def test_url_tree_equals_brute_force_on_the_tables(spark):
    urls = [r.url for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    got = check_templates(spark, urls, [None] * len(urls), True)
    # The tree itself blocks some of the urls that no rule decides and allows others, in each domain.
    for domain in ("com", "net", "org"):
        assert {r.verdict for r in got if r.rule is None and r.host.endswith(f".{domain}")} == {"allow", "block"}


def test_wildcards_and_merges_decide(spark, monkeypatch):
    """Without generalised segments, urls of unlabelled names fall back on their host."""
    urls = [f"http://h.org/u{i}/{kind}/x" for i in range(40) for kind in ("ads", "posts")]
    labels = [("block" if "/ads/" in u else "allow") if i < 40 else None for i, u in enumerate(urls)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    told = spark.createDataFrame([(i, v) for i, v in enumerate(labels) if v], "page_id long, verdict string")
    verdicts = lambda: {r.page_id: r.verdict for r in url_filter.filter_urls(pages, [], told).collect()}
    right = {i: "block" if "/ads/" in u else "allow" for i, u in enumerate(urls)}
    assert verdicts() == right
    monkeypatch.setattr(url_filter, "VARIETY_LEAST", 10**6)
    monkeypatch.setattr(url_filter, "MERGE_LABELS", 10**6)
    assert sum(v != right[i] for i, v in verdicts().items()) >= 15


def test_url_tree_equals_brute_force(spark):
    rng = random.Random(11)
    names = ["a", "b", "good", "bad", "*", "x y", "é", *map(str, range(30))]
    deep = "/".join("abcdefgh" * 4)
    urls = [f"http://{rng.choice(('h1.org', 'h2.org', 'www.h1.org', 'com'))}/" + "/".join(rng.choice(names) for _ in range(rng.randrange(0, 6))) for _ in range(400)]
    urls += [f"http://h1.org/{deep}/{rng.choice(('good', 'bad'))}/{i}" for i in range(60)] + [None, "", "none", "http://", "http://h1.org//a///b/"]
    urls += urls[:40]
    labels = [None if rng.random() < 0.5 else "block" if "bad" in (u or "") or rng.random() < 0.1 else "allow" for u in urls]
    check_templates(spark, urls, labels, False)


@pytest.mark.parametrize("copies", [1, 3])
def test_url_templates_do_not_follow_copies(spark, copies):
    slugs = [f"http://a.com/slug-{w}" for w in "abcdefghi"]
    deep = [f"http://b.com/{w}/{i}" for w in ("en", *"abcdefghi") for i in range(8)]
    urls = (slugs + ["http://a.com/en/", "http://a.com/en/1"] + deep) * copies
    got = check_templates(spark, urls, [None] * len(urls), True)
    assert {r.template for r in got if r.path.startswith("/slug")} == {"/*"}


def test_url_tree_has_no_depth_limit(spark):
    # Good and bad branches below a long shared stretch are told apart.
    stem = "/".join("abcdefg" * 9)
    urls = [f"http://h.org/{stem}/{w}/{i}" for w in ("good", "bad") for i in range(20)]
    got = check_templates(spark, urls, ["block" if "/bad/" in u else "allow" if i % 20 < 10 else None for i, u in enumerate(urls)][:30] + [None] * 10, False)
    assert {r.verdict for r in got if "/bad/" in r.path} == {"block"} and {r.verdict for r in got if "/good/" in r.path} == {"allow"}


def test_url_edges(spark):
    rows = [(None, "http://a.org/x", "c"), (None, "http://a.org/x", "c"), ("t", None, "c"), ("t", "http://a.org/" + "/".join(["s"] * 50_000), "c")]
    pages = spark.createDataFrame(rows, "page_id string, url string, template string")
    got = url_filter.filter_urls(pages, URL_RULES)
    assert sorted((r.page_id or "", r.host) for r in got.collect()) == [("", "a.org"), ("", "a.org"), ("t", ""), ("t", "a.org")]
    assert dict(got.dtypes)["page_id"] == "string"


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(None, None, "en", "s", 0), (10**9, "", "en", "s", 0)], docs.schema))
    out = quality.classify_quality(docs, labels)
    assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1 or predicted <> cast(score >= 0.3 as int)").isEmpty()
    assert out.where("held_out <> (crc32(cast(doc_id as string)) % 5 = 0)").isEmpty()
    held = out.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert held >= 0.95
    assert quality.keep_quality(docs, quality.QualityModel(0.4)).columns == docs.columns


def test_quality_without_labels(spark):
    docs = table(spark, ["a b", None])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify_quality(docs, none).collect()} == {0.5}
    assert quality.classify_quality(docs.limit(0), none).count() == 0


def test_isotonic_is_the_least_squares_monotone_fit():
    rng = np.random.default_rng(1)
    raw, y = rng.normal(size=60), rng.integers(0, 2, 60).astype(float)
    x, v = quality.isotonic(raw, y)
    assert (np.diff(x) > 0).all() and (np.diff(v) >= 0).all()
    order = np.sort(raw)
    ys = y[np.argsort(raw)]
    fit = [max(min(ys[i : j + 1].mean() for j in range(k, 60)) for i in range(k + 1)) for k in range(60)]
    assert set(np.round(v, 9)) == set(np.round(fit, 9)) and len(order) == 60


def test_decontamination_tolerates_substitutions(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    items = [[word() for _ in range(n)] for n in (40, 15, 30, 4)]
    fill = lambda n: [word() for _ in range(n)]

    def changed(item, every):
        return [word() if i % every == every - 1 else w for i, w in enumerate(item)]

    docs = [fill(50) + items[0] + fill(9), fill(9) + changed(items[0], 6), changed(items[1], 5), fill(300) + items[2][:24] + fill(3), items[2][:8] + fill(50), fill(80), items[3] + fill(3), changed(items[0], 3)]
    texts = [" ".join(d) for d in docs] + [None, "", " ".join(items[1]).upper().replace(" ", ", "), docs and " ".join(docs[0])]
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(9, None), (None, "a b c d e f")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table(spark, texts).repartition(3), bench).collect()}
    assert got == {(0, 0), (1, 0), (2, 1), (3, 2), (6, 3), (10, 1), (11, 0)}
    kept = decontaminate.decontaminate(table(spark, texts), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 7, 8, 9] and kept.columns == table(spark, texts).columns
    assert decontaminate.contaminated(table(spark, texts), bench.limit(0)).count() == 0
    assert decontaminate.contaminated(table(spark, texts).limit(0), bench).count() == 0


def test_decontamination_at_the_edges_of_documents(spark):
    item = [f"item{i}" for i in range(59)]
    fill = [f"other{i}" for i in range(40)]
    docs = [fill + item[:18], item[-19:] + fill, item[20:38], fill + item[:16], fill + item[:15], item[30:45] + fill, fill + item[:18] + fill, item[2:14], item[:12]]
    bench = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(item[:15]))], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.agreeing, r.compared) for r in decontaminate.contaminated(table(spark, [" ".join(d) for d in docs]), bench).collect()}
    assert {g for g in got if g[1] == 0} == {(0, 0, 18, 20), (1, 0, 19, 20), (2, 0, 18, 20), (3, 0, 16, 20), (6, 0, 18, 20)}
    assert {g for g in got if g[1] == 1} == {(0, 1, 15, 15), (3, 1, 15, 15), (4, 1, 15, 15), (6, 1, 15, 15), (7, 1, 12, 15), (8, 1, 12, 15)}


def test_decontamination_finds_short_items_whole(spark):
    items = ["The answer is four", "blue whale", "zebra", "one two three", "...", "one two three four five"]
    texts = ["question: the answer is four", "the answer is Four!", "the answer is five", "answer is four", "a blue, whale", "blue", "whale blue", "zebra", "zebras", "one two three four", "x one two three", "one two", "one two three four five", None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.agreeing, r.compared) for r in decontaminate.contaminated(table(spark, texts).repartition(3), bench).collect()}
    assert got == {(0, 0, 4, 4), (1, 0, 4, 4), (4, 1, 2, 2), (7, 2, 1, 1), (9, 3, 3, 3), (10, 3, 3, 3), (12, 3, 3, 3), (12, 5, 5, 5)}


def test_decontamination_finds_any_substitution_in_six_words(spark):
    item = [f"item{i}" for i in range(6)]
    texts = [" ".join(["before", *item[:i], "other", *item[i + 1 :], "after"]) for i in range(6)]
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contaminated(table(spark, texts), bench).collect()} == set(range(6))


def test_mixing(spark):
    rng = random.Random(6)
    data = [(i, "w " * rng.randrange(0, 40), "big" if i % 3 else rng.choice(["s1", "s2", None]), 7) for i in range(900)] + [(1000, None, "void", 7)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, pass int")
    sizes = {}
    for _, t, s, _ in data:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    total = sum(sizes.values())
    out = mixing.mix_sources(docs, entropy=0.97, repeats=2.5).collect()
    weights = {r.source: r.weight for r in out}
    assert math.isclose(sum(weights.values()), 1) and "void" not in weights
    entropy = -sum(w * math.log(w) for w in weights.values()) / math.log(len(weights))
    assert abs(entropy - 0.97) < 1e-6 or max(weights[s] * total / sizes[s] for s in weights) <= 2.5 + 1e-6
    for s, w in weights.items():
        used = sum(r.n_tokens for r in out if r.source == s)
        assert w * total - 45 <= used <= w * total + 1e-6
        for p in range(int(w * total / sizes[s])):
            assert sum(r.n_tokens for r in out if r.source == s and r["pass"] == p) == sizes[s]
    assert len({(r.doc_id, r["pass"]) for r in out}) == len(out)
    limited = mixing.mix_sources(docs, entropy=1.0, repeats=1.0).collect()
    assert max(r["pass"] for r in limited) == 0 and mixing.mix_sources(docs.limit(0)).count() == 0


def test_token_count(spark):
    texts = [None, "", " ", "a", " a\tb \n", "a\u00a0b c", "x\x1cy"]
    got = [r[0] for r in table(spark, texts).orderBy("doc_id").select(mixing.token_count(F.col("text"))).collect()]
    assert got == [0, 0, 0, 1, 2, 2, 1]


def spark_hash(*values):
    """Spark's xxhash64 of longs and strings."""
    seed = 42
    for v in values:
        if v is not None:
            seed = xxhash.xxh64(v.encode() if isinstance(v, str) else struct.pack("<i" if isinstance(v, np.int32) else "<q", v), seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def brute_mixing(data, target, limit, weight=None):
    """Rows (id, text, source) -> weights by source key on a dense grid of exponents, and the rows of the order.

    The order follows from ``weight``, if given, or from the weights of the grid.
    """
    seed = np.int32(17)
    tokens = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in data}
    key = {i: "n" if s is None else f"s{s}" for i, _, s in data}
    size = {}
    for i, k in key.items():
        size[k] = size.get(k, 0) + tokens[i]
    size = {k: n for k, n in size.items() if n}
    total = sum(size.values())
    p = np.array([size[k] / total for k in sorted(size)])
    # The exponent: the highest with enough entropy, but not below the lowest without too much repetition.
    grid = np.linspace(0, 1, 200_001)[:, None]
    w = p[None, :] ** grid
    w /= w.sum(1, keepdims=True)
    entropy = -(w * np.log(w)).sum(1) / np.log(len(p))
    enough, spare = entropy >= target - 1e-12, (w / p[None, :]).max(1) <= limit * (1 + 1e-12)
    best = max(grid[enough, 0].max(initial=0), grid[spare, 0].min(initial=1))
    found = dict(zip(sorted(size), p**best / (p**best).sum(), strict=True))
    expected = {}
    for k in size:
        want = math.floor((weight or found)[k] * total + 1e-6)
        passes, left = divmod(want, size[k])
        own = sorted(i for i in key if key[i] == k)
        block = {i: spark_hash(i, tokens[i], seed) % mixing.BLOCKS for i in own}
        for n in range(passes):
            expected |= {(i, n): (spark_hash(seed, n, k, block[i]), spark_hash(seed, n, k, i)) for i in own}
        for b in sorted(set(block.values()), key=lambda b: (spark_hash(seed, passes, k, b), b)):
            held = [i for i in own if block[i] == b]
            need = sum(tokens[i] for i in held)
            if not left or need > left:
                at = 0
                for i in sorted(held, key=lambda i: (spark_hash(seed, passes, k, i), i)):
                    at += tokens[i]
                    if left and at <= left:
                        expected[i, passes] = (spark_hash(seed, passes, k, b), spark_hash(seed, passes, k, i))
                break
            left -= need
            expected |= {(i, passes): (spark_hash(seed, passes, k, b), spark_hash(seed, passes, k, i)) for i in held}
    return found, expected, key


def check_mixing(data, out, target, limit):
    got = {(r.doc_id, r["pass"]): r for r in out}
    found, _, key = brute_mixing(data, target, limit)
    assert all(math.isclose(r.weight, found[key[i]], rel_tol=1e-4) for (i, _), r in got.items())
    # Exactly these rows, in this order, under the weights found.
    weight = found | {key[i]: r.weight for (i, _), r in got.items()}
    assert {x: (r.block_order, r.doc_order) for x, r in got.items()} == brute_mixing(data, target, limit, weight)[1]


def test_mixing_equals_brute_force(spark):
    rng = random.Random(12)
    data = [(i, "w " * rng.randrange(0, 30), rng.choice(["big"] * 6 + ["mid", "mid", "small", None])) for i in range(700)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    check_mixing(data, mixing.mix_sources(docs, entropy=0.93, repeats=2.5).collect(), 0.93, 2.5)


def test_decontamination_equals_comparing_all_windows(spark):
    rng = random.Random(31)
    vocabulary = [f"v{i}" for i in range(4000)]
    items = {i: [rng.choice(vocabulary) for _ in range(rng.choice((5, 6, 8, 12, 20, 25, 60)))] for i in range(12)}
    docs = {}
    for d in range(200):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 80))]
        if rng.random() < 0.8:
            item = items[rng.randrange(12)]
            a = rng.randrange(len(item))
            part = [w if rng.random() > rng.choice((0, 0, 0.1, 0.25)) else rng.choice(vocabulary) for w in item[a if rng.random() < 0.4 else 0 :][: rng.choice((6, 12, 18, 60))]]
            at = rng.choice((0, len(words), len(words) // 2))
            words[at:at] = part
        docs[d] = words
    expected = {}
    for d, x in docs.items():
        for i, y in items.items():
            size, best = min(len(y), 20), 0
            for shift in range(-len(y) + 1, len(x)):
                equal = [0 <= shift + j < len(x) and x[shift + j] == y[j] for j in range(len(y))]
                best = max(best, *(sum(equal[j : j + size]) for j in range(len(y) - size + 1)))
            if best >= max(min(size, 5), 0.8 * size):
                expected[d, i] = (best, size)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.agreeing, r.compared) for r in decontaminate.contaminated(table(spark, [" ".join(docs[d]) for d in range(200)]), bench).collect()}
    assert got == expected and len(expected) > 60


def brute_quality(texts, quality_of):
    """Scores by id: one solve over all labelled texts, in numpy."""
    measure = lambda t: quality.statistics(next(blocks(pa.array([t or ""]))))[0]
    labels = {i: float(q) for i, q in quality_of.items() if zlib.crc32(str(i).encode()) % 5 and i in texts}
    ids = sorted(labels)
    x, y = np.array([measure(texts[i]) for i in ids]), np.array([labels[i] for i in ids])
    model = quality.QualityModel(0.5, x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0))
    held = np.array([spark_hash(i, np.int32(7)) % 4 == 0 for i in ids])
    z = model.features(x)
    model.weights = np.linalg.solve(z[~held].T @ z[~held] + quality.RIDGE * max(1.0, len(ids) / 1000) * np.eye(z.shape[1]), z[~held].T @ (2 * y[~held] - 1))
    model.knots = quality.isotonic(model.raw(x[held]), y[held])
    return {i: model.score(measure(t)[None, :])[0] for i, t in texts.items()}


def test_quality_equals_normal_equations(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    expected = brute_quality({r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.quality for r in labels.collect()})
    got = {r.doc_id: r.score for r in quality.classify_quality(docs, labels).collect()}
    assert got.keys() == expected.keys() and all(abs(got[i] - expected[i]) < 1e-6 for i in got)

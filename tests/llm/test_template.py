"""Main-text extraction: template deduction over hosts, cuts, block rules, odd pages."""

import html
import random
import re

from costlens.llm import template as T

SCHEMA = "page_id long, url string, html string, host string"


def pages_of(rows):
    return [(i, u, h, "clash") for i, u, h in rows]


def texts(spark, rows):
    out = T.extracted(spark.createDataFrame(pages_of(rows), SCHEMA))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = out.collect()
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    return sorted(((r["page_id"], r["text"]) for r in got), key=repr)


def test_article_pages(spark):
    rng, rows, want = random.Random(4), [], []
    vocab = ["é", "tea &amp; co", "a&nbsp;b", "x\n  y", "&lt;tag&gt;", "word", "&#233;", "<b>bold</b> tail", "<a href='/x'>link</a>"]
    for i in range(60):
        paras = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 5))]
        paras.append("All rights reserved.")  # repeats on every page, and is article text
        close = rng.choice(["</p>", ""])
        body = "".join(f"<p>{p}{close}" for p in paras)
        nav = "".join(f"<li><a href=#>{rng.choice(vocab)}</a></li>" for _ in range(4))
        rows.append((i, f"https://h{i % 3}.example/{i}", f"""<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style>
          <script>var t="</p><article>no</article>";</script></head><body><header>Site</header><nav><ul>{nav}</ul></nav>
          <div class="cookie-notice">We use cookies</div><!-- <article>no</article> --><div class="ad">buy</div>
          <article><h1>Title {i}</h1>{body}<div class="ad">more ad</div><form><input>Search</form></article>
          <aside>side</aside><div id="comments"><article><p>reader says</p></article></div><footer>&copy; x</footer>"""))
        clean = [" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in paras]
        want.append((i, "\n".join([f"Title {i}", *[c for c in clean if c]])))
    assert texts(spark, rows) == sorted(want, key=repr)


def test_pages_without_named_elements_use_the_host_template(spark):
    rng = random.Random(9)
    rows, want = [], []
    for i in range(12):
        paras = [" ".join(rng.choices("lorem ipsum dolor sit amet".split(), k=20)) + f" {i}" for _ in range(3)]
        rows.append((i, "http://soup/", "<html><body><div class=top><div>Home</div><div>News of soup</div></div><div class=c1><div class=c2>"
                     "<div>Share this page</div>" + "".join(f"<p>{p}</p>" for p in paras) + "</div></div><div class=bottom>Contact us</div>"))
        want.append((i, "\n".join(paras)))
    assert texts(spark, rows) == sorted(want, key=repr)


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "nonsense", "bare <b>text</b> &amp; more"), (4, "http://a/", "<p>one<p>two<br>three"),
            (5, "http://b/x", "<main>m<nav>n</nav></main>"), (6, "http://b/y", "<div class='post'>p<div class='share'>s</div></div><div>q</div>"),
            (7, "http://c/", "<article>open <i>never closed"), (8, "http://c/", "</div></p>stray < 5 > <article>a</span>b</article>"),
            (9, "http://d/", "<article>" + "<p>long text</p>" * 20_000 + "</article>"), (None, "http://c/", "<article>no id</article>"),
            (9, "http://d/", "<article>" + "<p>long text</p>" * 20_000 + "</article>"), (10, "http://e/", "<article><!-- x")]
    got = dict(x for x in texts(spark, rows) if x[0] not in (9,))
    assert got == {1: "", 2: "", 3: "bare text & more", 4: "one\ntwo\nthree", 5: "m", 6: "p", 7: "open never closed", 8: "ab",
                   None: "no id", 10: ""}
    long = [t for i, t in texts(spark, rows) if i == 9]
    assert long == ["\n".join(["long text"] * 20_000)] * 2
    assert T.extracted(spark.createDataFrame([], SCHEMA)).count() == 0


def test_classes_of_equal_vectors_nest(spark):
    rows = [(i, "http://h/", "<html><body><nav>menu</nav><div id=x>" + "<p>item</p>" * (i + 1) + "</div></body></html>") for i in range(5)]
    found = T.template(T.frequent_tokens(spark.createDataFrame(pages_of(rows), SCHEMA))).collect()
    by = {r["path"]: r["class"] for r in found}
    assert set(by) == {"/html", "/html/body", "/html/body/nav", "/html/body/div.x", "/html/body/div.x/p"}
    assert len({by[p] for p in by if not p.endswith("/p")}) == 1 and by["/html/body/div.x/p"] != by["/html"]


def test_slot_holds_the_whole_article(spark):
    rows = [(i, "http://n/", f"<div class=post><div class=intro-text>intro {i}</div><p>rest {i}</p></div><footer>f</footer>") for i in range(6)]
    rows += [(10 + i, "http://o/", f"<article>a{i}<article>b{i}</article><p>c{i}</p></article>") for i in range(6)]
    rows += [(20 + i, "http://s/", f"<body><div><div class=x1>{'long ' * 7}{i}</div><div class=x2><p>short {i}</p></div></div><nav>n</nav>"
              "<div>Contact</div></body>") for i in range(6)]
    rows += [(30, "http://t/", "<div class=post><div class=text>own</div><p>rest</p></div>"), (31, "http://u/", "<div>one</div><p>two</p>")]
    want = [(i, f"intro {i}\nrest {i}") for i in range(6)] + [(10 + i, f"a{i}\nb{i}\nc{i}") for i in range(6)]
    want += [(20 + i, f"{'long ' * 7}{i}\nshort {i}") for i in range(6)] + [(30, "own\nrest"), (31, "one\ntwo")]
    assert texts(spark, rows) == sorted(want, key=repr)


def test_own_elements_and_copies(spark):
    rows = [(i, "http://p/", f"<body><article id=post-{i}><header><h1>Title {i}</h1></header><p>text {i}</p></article><div>poll {i}</div></body>")
            for i in range(6)]
    rows += [(10 + i, "http://q/", f"<body><div id=n{i} class=c1><h2>Top {i}</h2><p>text {i}</p></div><div>Imprint</div></body>") for i in range(6)]
    rows += [(20 + i, "http://r/", "<body><div><h2>Same</h2><p>text</p></div></body>") for i in range(6)]
    rows += [(30 + i, "http://v/", f"<body><div><h2>Head {min(i, 4)}</h2><p>{'one' if i > 3 else i}</p></div><i>Home</i></body>") for i in range(10)]
    want = [(i, f"Title {i}\ntext {i}") for i in range(6)] + [(10 + i, f"Top {i}\ntext {i}") for i in range(6)]
    want += [(20 + i, "Same\ntext") for i in range(6)]
    want += [(30 + i, f"Head {min(i, 4)}\n{'one' if i > 3 else i}") for i in range(10)]
    assert texts(spark, rows) == sorted(want, key=repr)


def nameless(i, rng):
    """A page of bare divs: a menu, a notice and a footer that vary, a story with a line that repeats; and its text."""
    vocab = "tea mill river stone light paper north field glass road".split()
    say = lambda n: " ".join(rng.choices(vocab, k=n))
    paras = [say(rng.randint(20, 40)) + f" {i}." for _ in range(rng.randint(2, 5))]
    title, kept = say(4) + f" {i}", "All rights to this story are ours."
    menu = "".join(f"<li><a href=#>{say(1)} {rng.random()}</a></li>" for _ in range(5))
    page = (f"<html><body><div><ul>{menu}</ul></div><div>{say(3)} {i}</div><div><h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paras)
            + f"<p>{kept}</p><div><b>Tell</b> a friend</div></div><div>Editor {say(1)} {i}</div></body></html>")
    return page, "\n".join([title, *paras, kept])


def test_classes_decide_on_pages_without_names(spark):
    rng = random.Random(21)
    made = [nameless(i, rng) for i in range(40)]
    rows = [(i, f"http://n{i % 2}/{i}", page) for i, (page, _) in enumerate(made)]
    assert texts(spark, rows) == sorted(((i, text) for i, (_, text) in enumerate(made)), key=repr)
    # No page's own elements give it.
    assert all(T.main_text(page, frozenset()) != text for page, text in made)


def test_names_choose_among_slots_and_classes_cut_inside(spark):
    rows = [(i, "http://k/", f"<body><div>poll {i}</div><article><h1>Title {i}</h1><p>text {i}</p><p>ours</p><div><p>Read more here</p></div>"
             f"</article></body>") for i in range(6)]
    assert texts(spark, rows) == [(i, f"Title {i}\ntext {i}\nours") for i in range(6)]
    # On three pages equal vectors are chance.
    assert texts(spark, rows[:3]) == [(i, f"Title {i}\ntext {i}\nours\nRead more here") for i in range(3)]


def test_classes_against_plain_vectors(spark):
    rng, rows = random.Random(5), []
    for i in range(40):
        body = "".join(rng.choice([f"<p>{rng.choice('abc')}</p>", "<div class=c1><i>fixed</i></div>", f"<section>{i}</section>", "<ul><li>x<li>y</ul>"])
                       for _ in range(rng.randint(0, 6)))
        rows.append((i, f"http://h{i % 3 if i < 36 else 9 + i}/", f"<body><div class='top n{i}'>{body}</div><div>end</div></body>"))
    rows += rows[:10]  # copies count once
    frame = spark.createDataFrame(pages_of(rows), SCHEMA)
    kept = {r["host"]: frozenset(r["kept"] or ()) for r in T.frequent_names(frame).collect()}
    want = {}
    for host in kept:
        pages = sorted({page for _, url, page in rows if url == f"http://{host}/"})
        least = max(T.LEAST_PAGES, len(pages) * T.SUPPORT)
        if len(pages) < T.LEAST_PAGES:
            continue
        found = [T.page_tokens(page, kept[host]) for page in pages]
        vectors = {t: tuple(f[t][2] if t in f else 0 for f in found) for f in found for t in f}
        vectors = {t: v for t, v in vectors.items() if sum(map(bool, v)) >= least}
        tagged = {vectors[t] for f in found for t, e in f.items() if e[0] is not None and t in vectors}
        groups = {}
        for t, v in vectors.items():
            if v in tagged:
                groups.setdefault((host, v), set()).add(t)
        want |= {(host, frozenset(g)): sum(map(bool, v)) for (_, v), g in groups.items()}
    got = {}
    for r in T.frequent_tokens(frame).collect():
        got.setdefault((r["host"], r["class"], r["support"]), set()).add(r["token"])
    assert {(h, frozenset(g)): n for (h, _, n), g in got.items()} == want and len(want) > 4

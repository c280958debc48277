"""Mixing (brute force of the tree and the epochs) and site trees (hand-made sites)."""

import hashlib
import random

from gavelworks.llm import mixing as M
from gavelworks.llm import sitetree as S


def fill(have, kids):
    """kids: key -> (weight, cap); the share of each child, in whole tokens."""
    give, open_ = {}, dict(kids)
    left = have
    while open_:
        w = sum(x for x, _ in open_.values())
        full = [k for k, (x, cap) in open_.items() if cap * w <= left * x]
        if not full:
            return give | {k: left * x // w for k, (x, _) in open_.items()}
        k = min(full, key=lambda k: (open_[k][1] / open_[k][0], k))
        give[k] = open_[k][1]
        left -= open_.pop(k)[1]
    return give


def brute(rows, budget=M.BUDGET):
    def domain(s):
        return {**dict.fromkeys("0369", "web"), **dict.fromkeys("147", "books"), **dict.fromkeys("258", "code")}.get((s or "")[-1:], "other")

    leaf = {}
    for i, t, lang, src, *_ in rows:
        leaf.setdefault((domain(src), lang or "", src or ""), []).append((i, len((t or "").encode().split())))
    sup = {k: sum(n for _, n in v) for k, v in leaf.items()}
    total = sum(sup.values()) * budget[0] // budget[1]
    caps = lambda d, m: sum(v * M.EPOCHS for k, v in sup.items() if k[: len(m)] == m)  # noqa: E731,ARG005
    out = {}
    dom = fill(total, {d: (M.DOMAIN_WEIGHTS.get(d, 1), caps(0, (d,))) for d in {k[0] for k in sup}})
    for d, h in dom.items():
        lan = fill(h, {x: (M.LANG_WEIGHTS.get(x, 1), caps(0, (d, x))) for x in {k[1] for k in sup if k[0] == d}})
        for x, g in lan.items():
            for s, give in fill(g, {k[2]: (1, sup[k] * M.EPOCHS) for k in sup if k[:2] == (d, x)}).items():
                k = (d, x, s)
                whole = give // sup[k] if sup[k] else 0
                rest, cum = give - whole * sup[k], 0
                key = lambda i: hashlib.md5(f"{M.SEED}:{whole}:{'' if i is None else i}".encode()).hexdigest()  # noqa: B023,E731,S324
                by = {}
                for i, n in leaf[k]:
                    by.setdefault(key(i), []).append((i, n))
                more, going = set(), rest > 0
                for h2 in sorted(by):
                    cum += sum(n for _, n in by[h2])
                    going = going and cum <= rest
                    if going:
                        more.add(h2)
                for i, n in leaf[k]:
                    e = whole + (key(i) in more)
                    if e:
                        out.setdefault((i, *k, n), []).append(e)
    return {k: sorted(v) for k, v in out.items()}


def table(spark, seed=1, n=700):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        src = None if r.random() < 0.02 else "src0" if r.random() < 0.35 else f"src{r.randrange(1, 14)}"
        rows.append((i, None if r.random() < 0.02 else "w " * r.choice([0, 1, 5, 40, 300]), r.choice(["en", "en", "fr", "de", None]), src, "x", 1))
    rows += [rows[3], rows[3], (None, "a b c", "en", "src5", "x", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, domain string, epochs int")


def test_same_as_brute_force(spark):
    for seed in (1, 2):
        rows, df = table(spark, seed)
        got = {}
        for g in M.mix(spark, df).collect():
            got.setdefault((g.doc_id, g.domain, g.lang, g.source, g.n_tokens), []).append(g.epochs)
        assert {k: sorted(v) for k, v in got.items()} == brute(rows)


def test_many_ranges_and_scarce_leaves(spark):
    r = random.Random(7)
    rows = [(i, "t " * r.randint(1, 4), "en", "src3") for i in range(9000)] + [(9000 + i, "t " * 3, "en", "src1") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {(g.doc_id, g.domain, g.lang, g.source, g.n_tokens): [g.epochs] for g in M.mix(spark, df).collect()}
    assert got == brute(rows)
    assert {v[0] for k, v in got.items() if k[3] == "src1"} == {M.EPOCHS}


def test_stage_and_empty(spark):
    rows, df = table(spark)
    out = M.stage(spark, df, "")
    assert out.columns == df.columns
    assert out.count() == sum(sum(v) for v in brute(rows).values())
    assert M.mix(spark, df.where("false")).collect() == [] == M.stage(spark, df.where("false"), "").collect()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Home</a><li>More</ul></nav><div class="ad">Buy &amp; go</div>
<article><h1>Ti<b>tle</b> &eacute; %d</h1><p><b>First par
 one.<br><p>Second&nbsp;<i>par</i> a&lt;b.</p><aside>aside text</aside><div class="share-bar">Share</div><ul><li>x<li>y</ul></article>
<section id="comments"><p>Reader says</p></section><form>Name <input></form><footer>&copy; 2020</footer></body></html>"""


def run(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    return {r.page_id: r.text for r in S.extract(spark, df).collect()}


def test_article_pages_and_edges(spark):
    rows = [(i, f"https://a.example.com/{i}", PAGE % i, "x") for i in range(5)] + [(90, None, None, None), (91, "u", "", ""), (92, "http://b.example.com", "<p>a<p>b < c <b>d</b>e &amp;amp; <", "x"), (0, "https://a.example.com/0", PAGE % 0, "x")]
    rows += [(93, "http://c.example.com", "<article>" + "<p>long paragraph</p>" * 20000, "x"), (94, "http://d.example.com", "<article><p>one<!-- x --><article class='comment'><p>no</article></article>", "x")]
    got = run(spark, rows)
    for i in range(5):
        assert got[i] == f"Title é {i} First par one. Second par a<b. x y"
    assert got[90] == "" and got[91] == "" and got[92] == "a b < c de &amp; <"
    assert run(spark, [(1, "http://f.example.com", "<div class='content has-sidebar'>kept<div class='sideBar'>gone</div></div>", "x")]) == {1: "kept"}
    assert got[93] == " ".join(["long paragraph"] * 20000) and got[94] == "one"
    assert S.extract(spark, spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_style_tree_removes_what_repeats_on_a_host(spark):
    r = random.Random(3)
    words = lambda n: " ".join("".join(r.choices("abcdefg", k=5)) for _ in range(n))
    bodies = {i: words(20) for i in range(12)}
    rows = [(i, f"http://e.example.com/{i}", f"<body><div class='lead'>Follow our paper for more news</div><div class='story'><p>{bodies[i]}</p></div></body>", "") for i in bodies]
    got = run(spark, rows)
    assert got == bodies
    tree = {(x.path): x.importance for x in S.site_tree(spark.createDataFrame([(i, "h", S_nodes(rows[i][2])) for i in range(12)], "_uid long, host string, nodes array<struct<path:string,kind:int,h:bigint,kids:int>>")).collect()}
    assert tree[">div.lead"] < 0.01 and tree[">div.story>p"] > 0.99


def S_nodes(html):
    import pyarrow as pa

    return next(S._scan([pa.RecordBatch.from_arrays([pa.array([html])], names=["html"])])).column("nodes")[0].as_py()


def test_parser_never_fails():
    r = random.Random(5)
    bits = ["<p>", "</p>", "<b", ">", "<a href='", "\"", "<!--", "-->", "<script>", "</script>", "x", "&", "&#x41;", "&#99999999;", "<div class=ad>", "</div>", "<td>", "<li>", "<", "</", "<article>", "</article>", "<svg/>", "<title>"]
    for _ in range(3000):
        S.parse("".join(r.choices(bits, k=r.randint(0, 20))))
    S.parse("<div>" * 20000 + "x")
    S.parse("<a '" * 3000)


def test_tree_against_brute_force(spark):
    import math
    from collections import Counter

    r = random.Random(12)
    word = lambda: "".join(r.choices("abcdefg", k=5))
    pages = []
    for i in range(40):
        host = f"h{i % 3}"
        body = "".join(f"<div class='{r.choice(['x', 'y', 'z'])}'><p>{r.choice(['same', word(), word()])}</p>{r.choice(['', '<ul><li>k</li></ul>'])}</div>" for _ in range(r.randint(1, 5)))
        pages.append((host, f"<body><article>{body}</article><div>{r.choice(['one', 'two'])}</div></body>"))
    rows = spark.createDataFrame([(h, S.page_nodes(p)) for h, p in pages], "host string, nodes array<struct<path:string,kind:int,h:bigint,kids:int>>")
    got = {(x.host, x.path): x for x in S.site_tree(rows).collect()}
    want = {}
    for host in {h for h, _ in pages}:
        seen = Counter(n[:3] for h, p in pages if h == host for n in {x[:3]: x for x in S.page_nodes(p)}.values())
        kids = {}
        for h, p in pages:
            if h == host:
                for path, _, _, k in S.page_nodes(p):
                    kids[path] = max(kids.get(path, 0), k)
        for path in kids:
            m = math.log(max(2, seen[path, 2, 0]))
            shown = [c for (q, kind, _), c in seen.items() if q == path and kind == 0]
            said = [c for (q, kind, _), c in seen.items() if q == path and kind == 1]
            show = -sum(c / sum(shown) * math.log(c / sum(shown)) for c in shown) / m if shown else 0.0
            say = 1 - sum(math.log(c) for c in said) / len(said) / m if said else 1.0
            w = S.GAMMA ** kids[path]
            want[host, path] = (1 - w) * max(show, 0.0) + w * say
    assert set(got) == set(want) and all(abs(got[k].importance - v) < 1e-9 for k, v in want.items())


def site(n, page, host="s.example.com"):
    r = random.Random(n)
    words = lambda k: " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(k))
    return [(i, f"http://{host}/{i}", page(i, words), "") for i in range(n)]


def test_importance_decides_inside_articles(spark):
    said = {}

    def page(i, words):
        said[i] = [words(3), words(30), words(25), words(12)]
        a, b, c, d = said[i]
        menu = "".join(f"<li><a href='/{i}'>{words(1)}</a></li>" for _ in range(i % 5 + 1))
        return f"<nav><ul>{menu}</ul></nav><main><article><h1>{a}</h1><p>{b}</p><div class='box'>Read this on paper as well</div><p>{c}</p><p>Written by our staff for you</p><section class='side-effects'><p>{d}</p></section></article></main><div class='notice-period'>Closed on Sundays</div>"

    got = run(spark, site(12, page))
    assert got == {i: " ".join(x) for i, x in said.items()}
    # the same pages without a site tell nothing about repetition
    alone = run(spark, [(0, "http://one.example.com", page(0, lambda k: "x y z"), "")])
    assert "Read this on paper" in alone[0] and "Sundays" not in alone[0]


def test_names_inside_articles(spark):
    for name in ("class='legal'", "class='side-effects'", "class='social-history'", "class='notice-period'", "class='menu-engineering'", "id='discussion'"):
        assert run(spark, [(1, "http://f.example.com", f"<article><h1>T</h1><section {name}><p>kept text</p></section></article>", "")]) == {1: "T kept text"}, name
    for name in ("class='share-buttons'", "class='ad-slot'", "id='comments'", "class='related-posts'", "role='navigation'"):
        assert run(spark, [(1, "http://f.example.com", f"<article><h1>T</h1><section {name}><p>gone</p></section></article>", "")]) == {1: "T"}, name
    html = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> and press <button>Go</button> now</p></article>"
    assert run(spark, [(1, "http://f.example.com", html, "")]) == {1: "Let x=2 and press Go now"}


def test_a_teaser_does_not_hide_the_story(spark):
    story = "word " * 80
    assert run(spark, [(1, "http://f.example.com", f"<main><p>Short teaser</p></main><div class='story'><p>{story}</p></div>", "")])[1] == f"Short teaser {story.strip()}"
    assert run(spark, [(1, "http://f.example.com", f"<main><p>{story}</p></main><div class='x'><p>Short extra</p></div>", "")])[1] == story.strip()


def test_copies_of_a_page_keep_their_article(spark):
    got = run(spark, [(i, f"http://c.example.com/{i}", "<nav>n</nav><article><h1>Same</h1><p>The same words</p></article><footer>f</footer>", "") for i in range(20)])
    assert set(got.values()) == {"Same The same words"}


def test_deep_paths_and_long_names_stay_apart(spark):
    def page(i, words):
        deep = "<div>" * 120
        long = "n" * 400
        return f"<body>{deep}<div class='{long}a'>Repeated everywhere</div><div class='{long}b'><p>{words(20)}</p></div></body>"

    rows = site(9, page)
    got = run(spark, rows)
    assert all("Repeated" not in v and len(v) > 100 for v in got.values())
    assert all(len(n[0]) <= S.LONG + 30 for n in S.page_nodes(rows[0][2]))


def test_many_hosts_are_joined_by_shuffle(spark, monkeypatch):
    rows = [(100 * k + i, f"http://h{k}.example.com/{i}", f"<div class='lead'>Same for all</div><div class='story'><p>{k} {i} words of this page</p></div>", "") for k in range(4) for i in range(8)]
    a = run(spark, rows)
    monkeypatch.setattr(S, "FEW_HOSTS", 1)
    assert run(spark, rows) == a and not any("Same" in v for v in a.values())

"""Template deduction against brute force, copied pages, notices inside main elements, forms and named elements."""

from collections import Counter, defaultdict

import pytest

from lodestrand.llm import htmlext

SCHEMA = "page_id long, url string, html string, host string, token long, key long"
PAGE = "<body><div class=top><p>Welcome to our site</p></div><section><h2>{0}</h2>{1}</section><div><p>All rights</p></div></body>"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, 2) for i, u, h in rows], SCHEMA)


def site(n, host="a.org"):
    return [(i, f"http://{host}/{i}", PAGE.format(f"title {i}", "".join(f"<p>body {i * 7} {j}</p>" for j in range(1 + i % 3)))) for i in range(n)]


def test_classes_equal_brute_force(spark):
    rows = site(9) + site(6, "b.org") + [(20, "http://a.org/x", PAGE.format("title 3", "<p>body 21 0</p>")), (21, None, "<p>x"), (22, "http://a.org/y", "")]
    rows += [(30 + i, f"http://a.org/copy{i}", rows[4][2]) for i in range(5)]
    got = {r.host: Counter(frozenset(x["token"] for x in r.template if x["vector"] == v) for v in {x["vector"] for x in r.template}) for r in htmlext.templates(htmlext.hosted(frame(spark, rows))).collect()}
    want = {}
    for host in ("a.org", "b.org"):
        pages = sorted({h for _, u, h in rows if u and f"//{host}/" in u and h})
        vectors = defaultdict(lambda: [0] * len(pages))
        for k, h in enumerate(pages):
            for t, c in htmlext._tokens(htmlext.read(h))[0].items():
                vectors[t][k] = c
        classes = defaultdict(set)
        for t, v in vectors.items():
            if sum(map(bool, v)) >= max(4, len(pages) / 2):
                classes[tuple(v)].add(t)
        want[host] = Counter(frozenset(c) for c in classes.values() if len(c) >= 2)
    assert got == want


@pytest.mark.parametrize("copies", [4, 400])
def test_copied_pages_keep_their_text(spark, copies):
    page = "<body><div><h2>One</h2><p>The first block of text.</p><p>And the second block.</p></div></body>"
    want = "One\n\nThe first block of text.\n\nAnd the second block."
    same = [(1, "http://c.org/1", page)] * copies
    urls = [(i, f"http://d.org/{i}", page) for i in range(copies)]
    near = [(i, f"http://e.org/{i}", page.replace("<body>", f"<body data-i={i}>")) for i in range(copies)]
    for max_tokens in (500_000, 0):
        rows = htmlext.main_text(frame(spark, same + urls + near), max_tokens=max_tokens).collect()
        assert len(rows) == 3 * copies and {r.text for r in rows} == {want}


def test_template_drops_and_slots_stay(spark):
    rows = site(12)
    main = [(100 + i, f"http://m.org/{i}", f"<nav><a>{i}</a></nav><main><div>Subscribe to our paper</div><h1>t{i}</h1><p>{'same words' if i % 2 else 'own'} {i // 2}</p></main>") for i in range(12)]
    for max_tokens in (500_000, 0):
        got = {r.page_id: r for r in htmlext.main_text(frame(spark, rows + main), max_tokens=max_tokens).collect()}
        assert got[3].text == "title 3\n\nbody 21 0" and got[5].text.count("\n\n") == 3 and got[3].n_template >= 4 and got[3].n_slots >= 1
        assert got[103].text == "t3\n\nsame words 1"  # what every page of the host has in its main element goes
    off = {r.page_id: r.text for r in htmlext.main_text(frame(spark, main), roles=False).collect()}
    assert all(f"t{i}" in off[100 + i] and "Subscribe" not in off[100 + i] for i in range(12))


def test_forms_and_names():
    x = lambda h: htmlext.extract(h, None)[0]
    assert x("<div class='story'>teaser</div><div id='text'>The article itself, which is longer") == "teaser\n\nThe article itself, which is longer"
    assert x('<h1 class="post-title">T</h1><div class="body"><p>The article</p></div>') == "T\n\nThe article"
    assert x("<form id=f><nav>menu</nav><div><p>The text of the whole page</p><label>a</label><div class=comments>no</div></div></form>") == "The text of the whole page"
    assert x("<p>A text that is longer than the form below it, as most are</p><form>Write to us</form>").endswith("most are")
    assert x("<div class='page with-sidebar'><h1>x</h1><p>para</p><div class=sidebar>no</div></div>") == "x\n\npara"
    assert x("<div class=comments><h1>x</h1>no</div>") == "" and x("<nav>no</nav>") == "" and x("") == ""


def test_slot_choice_by_deduction_alone():
    page = "<body><div><a>m{0}</a><a>n{0}</a></div><div><h1>t{0}</h1><p>{1}</p></div><div>f{0}</div></body>"
    pages = [page.format(i, f"the main text of page {i} " * 9) for i in range(6)]
    tokens = [htmlext._tokens(htmlext.read(p)) for p in pages]
    every = [t for t in tokens[0][0] if all(c.get(t) == tokens[0][0][t] for c, _ in tokens)]
    template = sorted((tokens[0][1][t], 1, t, 1.0) for t in every)
    assert htmlext.extract(pages[2], template, roles=False)[0] == "t2\n\n" + ("the main text of page 2 " * 9).strip()
    place = {t: 10 - i for i, t in enumerate([1, 2, 3])}
    assert len(htmlext.valid_tokens(place, [(0, 7, 1, 1.0), (1, 7, 2, 1.0), (2, 7, 3, 1.0)])) == 1
    assert set(htmlext.valid_tokens({1: 0, 2: 10, 3: 2, 4: 12}, [(0, 7, 1, 1.0), (9, 7, 2, 1.0), (2, 8, 3, 1.0), (12, 8, 4, 1.0)])) == {1, 2}

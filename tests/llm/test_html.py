import collections
import random

from pyspark.sql import functions as F

from quillmill.llm import html

FRAME = (
    "<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body><header class='page'>Site head</header><nav><ul><li><a href=/>Home</a><li>About</ul></nav>"
    "<div class='cookie-notice'>We use cookies</div><aside>Side</aside>{main}<div id=comments><p>A comment</p></div><form><label>Name</label><input></form><div class=ad>Buy</div><footer>&copy; site</footer></body></html>"
)
ARTICLE = "<article><h1>Head &amp; title</h1><p>First   line<br>goes\non <b>here</b>.<p>Second &lt;line&gt; &#233;<ul><li>One<li>Two</ul><script>x()</script><div class=share>Share</div></article>"


def test_article_alone():
    page = FRAME.format(main=ARTICLE)
    assert html.main_text(page) == ["Head & title", "First line goes on here.", "Second <line> é", "One", "Two"]


def test_odd_markup():
    for page in ("", "plain text", "<", "<p", "a < b > c", "<p>x</div></p></b>y", "<!-- open", "<script>never closed", "<p title='a>b'>x</p>", "<![CDATA[x]]>y", "</", "<a" * 1000):
        html.parse(page)
    assert html.main_text("a < b &amp; c") == ["a < b & c"]
    assert html.main_text("<p title='a>b'>x</p>") == ["x"]
    assert html.main_text("<article><p>keep <span class=ad>buy</span> this</p>") == ["keep this"]


def test_op5(spark, tables):
    rows = []
    for k in range(12):
        # a host without article elements: its container and the notice on every page follow from the template
        body = f"<body><div class=top><a href=/>Home</a> <a href=/x>More</a></div><div class=text><p>Story {k} is told here at length.</p><p>It has an end, number {k * 7}.</p><p>Every page says this.</p></div><div class=low><p>Call {k % 3} us</p></div></body>"
        rows.append((k, f"https://plain.example/{k}", body))
        rows.append((100 + k, f"http://WWW.x.example:80/{k}?q", FRAME.format(main=ARTICLE.replace("Second", f"Second {k}"))))
    rows += [(500, None, None), (501, "odd", ""), (502, "https://one.example/", "<p>Only page</p>"), (502, "https://one.example/", "<p>Only page</p>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = html.op5_html(spark, tables(pages=df)).collect()
    assert len(found) == len(rows) and all(len(x["text"]) == x["n_chars"] for x in found)
    by = {x["page_id"]: x["text"] for x in found}
    assert by[3] == "Story 3 is told here at length.\nIt has an end, number 21."
    assert by[105] == "Head & title\nFirst line goes on here.\nSecond 5 <line> é\nOne\nTwo"  # the article's own, whatever other pages say
    assert by[500] == by[501] == "" and by[502] == "Only page"
    assert html.op5_html(spark, tables(pages=df.limit(0))).count() == 0


def host_of(body, n=9, host="h.example"):
    return [(k, f"https://{host}/{k}", body(k)) for k in range(n)]


def extracted(spark, rows, hints=True):
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit("clash")).withColumn("template", F.lit(1))
    return {x["page_id"]: x["text"] for x in html.extract(df.repartition(3), hints).collect()}


def story(k, part=0):
    r = random.Random(f"{k} {part}")
    return " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(30)) + "."


def test_headings_that_articles_share_stay(spark):
    for n in (2, 7, 9):
        found = extracted(spark, host_of(lambda k: f"<nav>Menu</nav><article><h1>T{k}</h1><h2>Summary</h2><p>{story(k)}</p><h2>Details</h2><p>{story(k, 1)}</p></article>", n))
        assert all(found[k] == f"T{k}\nSummary\n{story(k)}\nDetails\n{story(k, 1)}" for k in range(n))
        plain = extracted(spark, host_of(lambda k: f"<div class=a><h2>Summary</h2><p>{story(k)}</p><h2>Details</h2><p>{story(k, 1)}</p></div><div class=b>Every page ends so.</div>", n))
        assert n == 2 or all(plain[k] == f"Summary\n{story(k)}\nDetails\n{story(k, 1)}" for k in range(n))


def test_names_alone_take_nothing_from_an_article(spark):
    page = "<article><p class=warning>Mind the {k} gap.</p><div id=related-work><p>They did {k}.</p></div><p>x <span class=search>search term</span> y</p><div class=ad-container>Buy</div><ul class='share-bar'><li>Share</ul><p class=notice>Signed up yet?</p></article>"
    found = extracted(spark, host_of(lambda k: page.replace("{k}", str(k))))
    # the notice has a name that hints at it and the same text on every page
    assert all(found[k] == f"Mind the {k} gap.\nThey did {k}.\nx search term y" for k in range(9))
    alone = extracted(spark, host_of(lambda k: page.replace("{k}", str(k)), 1))
    assert alone[0] == "Mind the 0 gap.\nThey did 0.\nx search term y\nSigned up yet?"


def test_layouts_of_a_host_have_a_template_each(spark):
    def body(k):
        top = f"<div class=bar><a href=/>Home</a> <a href=/{k}>Page {k}</a></div>"
        if k % 2:
            return f"{top}<div class=one><h1>T{k}</h1><div class=text>Intro {story(k)}<section><p>{story(k, 1)}</p></section></div></div><div class=foot>Call {k % 3}</div>"
        return f"{top}<table class=two><tr><td class=side><p>Side {k % 3}</p></td><td class=wide><p>{story(k)}</p><p>Read this too.</p><p>{story(k, 1)}</p></td></tr></table>"

    found = extracted(spark, [*host_of(body, 20), (50, "https://h.example/", None), (51, "https://h.example/x", ""), (None, "https://h.example/y", body(1))])
    for k in range(20):
        one = f"T{k}\nIntro {story(k)}\n{story(k, 1)}" if k % 2 else f"{story(k)}\nRead this too.\n{story(k, 1)}"
        assert found[k] == one
    assert found[50] == found[51] == "" and found[None] == found[1]


def test_a_near_copy_of_another_page_stays_whole(spark):
    found = extracted(spark, host_of(lambda k: f"<div class=a><p>{story(1)}</p><p>{story(2)}</p><p>Copy {k}</p></div>", 6))
    assert all(found[k] == f"{story(1)}\n{story(2)}\nCopy {k}" for k in range(6))


def brute_template(pages):
    """Elements of the classes that nest, by occurrence vectors that are written out."""
    seen = [html.parse(p) for p in pages]
    seen = [(b, p) for b, p in seen if b or p]
    occurs = collections.defaultdict(lambda: [0] * len(seen))
    for n, (blocks, paths) in enumerate(seen):
        for path, k in paths.items():
            occurs["", path][n] = k
        for x in blocks:
            occurs[x.text, x.path][n] += not x.excluded
    many = {t: tuple(v) for t, v in occurs.items() if sum(k > 0 for k in v) >= max(html.LEAST_PAGES, html.SUPPORT * len(seen))}
    groups = collections.defaultdict(list)
    for (text, path), v in many.items():
        if not text:
            around = [path.rsplit("/", k)[0] for k in range(1, path.count("/"))]
            groups[v, next((p for p in around if many.get(("", p), v) != v), "")].append(path)
    texts = collections.Counter(v for (text, _), v in many.items() if text)
    ones = (1,) * len(seen)
    return {frozenset(g) for (v, _), g in groups.items() if len(g) + texts[v] + (v == ones) >= 2}


def test_classes_are_those_of_written_out_vectors(spark):
    r = random.Random(2)
    for _ in range(3):
        parts = [f"<div class=p{j}>" + r.choice(["<p>{k}</p>", "<ul><li>{k}<li>same</ul>", "<p>same</p><section><p>{k}</p></section>", "<p>{k}</p><p>{k}</p>"]) + "</div>" for j in range(6)]
        chance = [r.choice([1, 1, 0.5, 0.3, 0.1]) for _ in parts]
        pages = ["<body>" + "".join((x * r.choice([1, 1, 2])).replace("{k}", str(n)) for x, c in zip(parts, chance, strict=True) if r.random() < c) + "</body>" for n in range(25)] + ["", None]
        df = spark.createDataFrame([("h", p) for p in pages], "host string, html string").repartition(3)
        elements, _ = html._classes(bytes(html.classes(df).first()["template"]))
        found = collections.defaultdict(set)
        names = {html._hash(path): path for p in pages for path in html.parse(p or "")[1]}
        for token, (number, _, _) in elements.items():
            found[number].add(names[token])
        assert {frozenset(g) for g in found.values()} == brute_template([p or "" for p in pages])


def test_a_class_in_two_orders_is_no_template(spark):
    one, two = "<div class=x>A</div>", "<div class=y>B</div>"
    mixed = spark.createDataFrame([("h", f"<body>{one + two if k % 2 else two + one}<p>{story(k)}</p></body>") for k in range(12)], "host string, html string")
    straight = spark.createDataFrame([("h", f"<body>{one + two}<p>{story(k)}</p></body>") for k in range(12)], "host string, html string")
    assert html.templates(straight).first()["elements"] == 4 and html.templates(mixed).first()["elements"] == 0


def test_templates_alone_find_the_article(spark):
    def body(k):
        return f"<body><nav><ul><li><a href=/{k}>Menu {k}</a></ul></nav><div class=ad>Ad {k % 4}</div><article><h1>T{k}</h1><p>{story(k)}</p><p>{story(k, 1)}</p></article><footer>Foot of the site</footer></body>"

    found = extracted(spark, host_of(body, 30), hints=False)
    assert all(found[k] == f"T{k}\n{story(k)}\n{story(k, 1)}" for k in range(30))


def test_long_and_deep_pages():
    deep = "<div>" * 50_000 + "x" + "</div>" * 50_000 + "</b>" * 50_000
    assert html.main_text(deep) == ["x"]
    long = "<article>" + "".join(f"<p>{k} some words of a very long page</p>" for k in range(200_000)) + "</article>"
    assert len(html.main_text(long)) == 200_000


def test_the_template_decides_on_pages_that_name_an_article(spark):
    def body(k):
        card = f"<section class=more><article class=card><a href=/{k + 1}>See story {k + 1}</a></article></section>"
        return f"<body>{card}<div class=text><p>{story(k)}</p><p>{story(k, 1)}</p></div></body>"

    # all that the page names is a linked card beside the slot of its prose
    found = extracted(spark, host_of(body, 12))
    assert all(found[k] == f"{story(k)}\n{story(k, 1)}" for k in range(12))
    # where the named element is around the slot, it says how far the article reaches
    named = extracted(spark, host_of(lambda k: body(k).replace("<div class=text>", f"<main><h1>T{k}</h1>By {k}<div class=text>").replace("</div></body>", "</div></main></body>"), 12))
    assert all(named[k] == f"T{k}\nBy {k}\n{story(k)}\n{story(k, 1)}" for k in range(12))

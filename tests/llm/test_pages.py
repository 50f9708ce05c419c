"""Main texts of pages: markup of many kinds, votes of hosts, odd rows."""

import pytest

from freshet.llm import host_paths
from freshet.llm.host_paths import extract, vote

PROSE = "It was a long day in the harbour, and nobody spoke of the weather. " * 3
CASES = [
    ("<body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>T &amp;amp; U</h1><p>One <b>bo</b>ld\n\t line<p>Two&nbsp;x<br>y</article><footer>F</footer>",
     "T &amp; U One bold line Two x y"),
    ("<html><head><title>x</title><style>p{}</style><script>var a='<p>no</p>'</script></head><body><div class='site-header'>Site</div>"
     f"<div class='post-7 content'><h2>Title</h2><p>{PROSE}</p><div class='ad-slot'>buy</div><ul><li>a<li>b</ul></div><div id=sidebar>S</div></body></html>",
     f"Title {PROSE.strip()} a b"),
    (f"<div class='has-sidebar'><main><header><h1>Name</h1><p>by me</p></header><p>{PROSE}<!-- no <p>no</p> --></p>"
     "<section class='comments'><article><p>first!</p></article></section><form><input><label>mail</label></form></main></div>",
     f"Name {PROSE.strip()}"),
    (f"<form class=aspnet><div id='cookie-notice'>We use cookies</div><article><p>{PROSE}</p><aside>more</aside><p hidden>no</p>"
     "<p>a<span class=share>tweet</span></p><p style='display: none'>no</p></article></form>", f"{PROSE.strip()} a"),
    (f"<body><ul><li><a href=a>A</a><li><a href=b>B</a></ul><h1>Head</h1><p>{PROSE}</p>", f"Head {PROSE.strip()}"),
    ("just text &lt;here&gt; &copy; &#233;&#x41; &unknown; &amp", "just text <here> © éA &unknown; &"),
    ("<article><table><tr class='header'><th>K<td>V<tr><td>1<td>2</table><pre> a  b </pre><blockquote>q</blockquote></article>",
     "K V 1 2 a b q"),
    ("<p>1 < 2 and <3 > x</p>", "1 < 2 and <3 > x"),
    ("<nav>only</nav><footer>marks</footer>", ""), ("<body></body>", ""), ("", ""), (None, ""), ("<", "<"), ("<!-- open", ""),
    ("<script>never closed <p>x</p>", ""),
]


@pytest.mark.parametrize("page,text", CASES)
def test_own_container(page, text):
    assert extract(page, []) == text


def test_winners_and_fallback():
    page = f"<body><div class='c1 story'><p>short</p></div><div class='box'><p>{PROSE}</p></div>"
    assert vote(page) == "body>div.box"
    assert extract(page, ["body>div.c.story"]) == "short"
    assert extract(page, ["body>div.none"]) == PROSE.strip()
    assert extract(page, ["body>div.none", "body>div.box"]) == PROSE.strip()
    assert extract("<body><div class='story'></div><div class='box'><p>x</p></div>", ["body>div.story"]) == ""
    assert extract("<body><div class=s><p>a</p></div><div class=s><p>b</p></div>", ["body>div.s"]) == "a b"


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "x", "<" * 200_000, "<a " * 200_000, "<a \"" * 200_001, "<p class=x>" * 50_000,
                                  "&" * 200_000, "<b>word " * 100_000, "</p>" * 100_000, "<div class='" + "a" * 10 ** 6 + "'>x</div>"])
def test_long_pages_end(page):
    assert isinstance(extract(page, []), str)


def test_hosts_agree(spark):
    def page(body, extra=""):
        return f"<html><body><div class='main-{len(body)}'><p>{body}</p></div><div class='links2'><p>{extra}</p></div></body></html>"
    rows = [(i, f"https://A.example.org/{i}", page(PROSE)) for i in range(12)]
    rows += [(20, "http://a.example.org:80/odd", page("Short.", PROSE * 2)), (21, "http://b.example.org/x", page("Short.", PROSE * 2)),
             (22, None, page(PROSE)), (23, "no url", None), (24, "https://u@a.example.org?x", ""), (24, "https://a.example.org/0", page(PROSE))]
    df = spark.createDataFrame([(*r, "h", ["p"]) for r in rows], "page_id long, url string, html string, host string, paths array<string>")
    got = sorted(tuple(r) for r in host_paths.main_texts(df.repartition(3)).collect())
    want = [(i, u, PROSE.strip()) for i, u, _ in rows[:12]] + [
        (20, rows[12][1], "Short."), (21, rows[13][1], " ".join([PROSE.strip()] * 2)), (22, None, PROSE.strip()),
        (23, "no url", ""), (24, rows[16][1], ""), (24, rows[17][1], PROSE.strip())]
    assert got == sorted(((i, u, t, len(t)) for i, u, t in want), key=lambda r: (r[0], r[1] or ""))
    assert host_paths.main_texts(df.limit(0)).collect() == []
    shuffled = host_paths.SENT_HOSTS
    try:
        host_paths.SENT_HOSTS = 0
        assert sorted(tuple(r) for r in host_paths.main_texts(df).collect()) == got
    finally:
        host_paths.SENT_HOSTS = shuffled

"""op12: token streams, alignment, distributed inference and extraction."""

import html
import random

import pytest

from flowtide.llm import queries, wrappers
from flowtide.llm.wrappers import Wrapper, page_tree, read, slots

SCHEMA = "page_id long, url string, html string"


def wrapper_of(*pages):
    out = Wrapper()
    for page in pages:
        out.fold(page_tree(page)[1])
    return out


def texts(*pages):
    found = slots(wrapper_of(*pages))
    return ["\n".join(read(page_tree(p), found["main"]) or read(page_tree(p), found["rest"])) for p in pages]


def test_mismatches_become_slots_optionals_and_repeats():
    assert wrapper_of("<ul><li>a</li></ul><p>x</p>", "<ul><li>b</li><li>c</li></ul><p>x</p>").expression() == "<ul>{<li>#text</li>}+</ul> <p>#fixed</p>"
    assert wrapper_of("<div>a</div>", "<div>b</div><hr><p>c</p>").expression() == "<div>#text</div> (<p>#text</p>)?"
    assert wrapper_of("<dl><dt>a<dd>b<dt>c<dd>d</dl>").expression() == "<dl>{(<dt>#text</dt>)? (<dd>#text</dd>)?}+</dl>"
    # A token that the wrapper has before the cursor turns all from there on into one repeated group.
    assert wrapper_of("<h1>a</h1><p>b</p>", "<p>b</p><h1>a</h1>").expression() == "{(<h1>#fixed</h1>)? (<p>#fixed</p>)?}+"


def random_page(rng):
    inner = "".join(rng.choice(["<p>%d</p>", "<h2>%d</h2>", "<ul><li>%d<li>x</ul>", "<div class=ad>%d</div>", "t%d"]) % rng.randint(0, 3) for _ in range(rng.randint(0, 5)))
    return f"<body><nav><a href=x>m</a></nav><article>{inner}</article></body>"


def test_merged_wrappers_accept_what_one_fold_accepts():
    rng = random.Random(4)
    pages = [random_page(rng) for _ in range(60)]
    one = wrapper_of(*pages)
    for cuts in ((20, 40), (1, 59), (30, 30)):
        parts = [wrapper_of(*pages[a:b]) for a, b in zip((0, *cuts), (*cuts, 60))]
        total = Wrapper.unpacked(parts[0].packed())
        for p in parts[1:]:
            total.merge(Wrapper.unpacked(p.packed()))
        assert slots(total) == slots(one)

        def stats(w):
            return (w.count, w.held, w.size, w.linked, w.fixed, {k: stats(v) for k, v in w.inner.items()})

        assert stats(total) == stats(one)
        # Each name is in exactly one part of its expression.
        names = [l for part in total.parts for l in part[1]]
        assert sorted(names) == sorted(total.inner)


@pytest.mark.parametrize(
    "page, wanted",
    [
        ("", ""),
        ("just words &lt;b&gt; &amp;amp;", "just words <b> &amp;"),
        ("<script>var t='</p><p>no</p>'</script><p>yes", "yes"),
        ("<style>p{}</style><p>a\n  b&nbsp;c<br>d</p>", "a b c d"),
        ("<!-- <p>no</p> --><p>1 < 2 <b>bo<i>ld</i></b></p><!-- open <p>no", "1 < 2 bold"),
        ("<title>no</title><p title='a > b'>x</p><p class=\"open>y</p>", "x\ny"),
        ("<article><h1>T</h1><p>a<p>b</article><footer>no</footer>", "T\na\nb"),
        ("<nav><p>no</p></nav><header>no</header><aside>no</aside><form><p>no</p></form><p>yes</p>", "yes"),
        ("<article><header><h1>T</h1></header><p>a</p><section id='comments'><p>no</p></section><div class='share-box'>no</div></article>", "T\na"),
        ("<div class='cookie-notice'>no</div><main><p>a</p><aside>no</aside></main><div>no</div>", "a"),
        ("<body class='with-sidebar no-ads'><div id='wrapper'><article>a</article></div><div role='complementary'>no</div>", "a"),
        ("<form id='page'><article><p>in a page-wide form, long enough to be most of it</p></article></form>", "in a page-wide form, long enough to be most of it"),
        ("<table><tr><td>a<td>b<tr><td><p>c</table><textarea><p>no</textarea>", "a\nb\nc"),
        ("<p>cut off <a href='x", "cut off"),
    ],
)
def test_one_page(page, wanted):
    assert texts(page) == [wanted]


def test_without_an_article_fixed_strings_and_menus_go():
    pages = [f"<div class=top>Site name</div><div id=c><div><h1>Title {i}</h1><p>{'words %d ' % i * 30}</p><p>more {i * i}</p></div></div><div>All rights</div>" for i in range(5)]
    assert texts(*pages) == [f"Title {i}\n{('words %d ' % i * 30).strip()}\nmore {i * i}" for i in range(5)]


def test_deep_and_long_pages():
    deep = "<div>" * 3000 + "down here" + "</div>" * 3000 + "<p>after</p>"
    assert texts(deep) == ["down here\nafter"]
    long = "<article>" + "".join(f"<p>{i} {'w ' * 20}</p>" for i in range(20_000)) + "</article>"
    assert texts(long)[0].count("\n") == 19_999
    names = "<article>" + "".join(f"<p class='{chr(97 + i // 26)}{chr(97 + i % 26)}z'>{i}</p>" for i in range(300)) + "</article>"
    assert texts(names)[0] == "\n".join(map(str, range(300)))
    assert len(wrapper_of(names).inner["article|a"].inner) <= wrappers.NAMES + 1


def built(i, host):
    """A page and its main text, by the rules of construction of this test."""
    rng = random.Random(f"{host}{i}")
    words = lambda n: " ".join(rng.choice(["alpha", "b & c", "<tag>", "naïve", "“q”"]) for _ in range(n))
    blocks = [words(rng.randint(1, 30)) for _ in range(rng.randint(1, 9))]
    body = f"<h1>{html.escape(blocks[0])}</h1>" + "".join(f"<p>{html.escape(b)}" + rng.choice(["</p>", "\n"]) for b in blocks[1:])
    ad = f"<div class='ad'>{words(9)}</div>" if rng.random() < 0.5 else ""
    page = f"<html><head><title>t</title></head><body><nav><ul><li><a href=/>Home<li><a href=/x>{words(1)}</ul></nav>{ad}<article>{body}</article>{ad}"
    return page + f"<section class='comments'><p>{words(8)}</p></section><footer>&copy; {host}</footer></body></html>", "\n".join(blocks)


def test_query_against_construction(spark, tmp_path):
    hosts = ["hot.example"] * 60 + [f"h{k}.example" for k in range(12)] * 3
    made = [built(i, h) for i, h in enumerate(hosts)]
    rows = [(i, f"https://u@{h.upper()}:80/p/{i}?q#f", page) for i, (h, (page, _)) in enumerate(zip(hosts, made))]
    rows += [(900, None, None), (901, "no url", ""), (None, rows[0][1], rows[0][2]), rows[1]]
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS host", "2 AS slots", "3 AS copies", "4 AS row").repartition(4).write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.op12_html_extraction(spark, str(tmp_path)).collect()
    wanted = sorted(((i, u, t) for (i, u, _), t in zip(rows, [m[1] for m in made] + ["", "", made[0][1], made[1][1]])), key=repr)
    assert sorted(((r.page_id, r.url, r.text) for r in got), key=repr) == wanted
    assert all(r.n_chars == len(r.text) for r in got)
    small = wrappers.extract(spark.read.parquet(str(tmp_path / "pages.parquet")), keep=["page_id", "url"], most=60, together=10)
    assert sorted(small.collect(), key=repr) == sorted(got, key=repr)
    kept = wrappers.extract(spark.createDataFrame(rows[:3], SCHEMA).selectExpr("*", "1 AS host", "'n' AS n_chars", "7 AS `a.b`"))
    assert kept.columns == ["page_id", "url", "host", "a.b", "text", "n_chars"] and kept.count() == 3
    assert wrappers.extract(spark.createDataFrame([], SCHEMA)).collect() == []

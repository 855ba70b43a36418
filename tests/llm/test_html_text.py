import html
import random
import time

from quillmatch.llm import html_text
from quillmatch.llm.html_text import Page, host_paths, main_text, op4_html_extraction

SCHEMA = "page_id long, url string, html string, text string"
WORDS = ["the", "thing & co", "<tag>", "été", "x,", "other."]


def line(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def page(rng, kind, n):
    """-> (html, its article as text). Three templates; some pages hold more menu than article."""
    blocks = [line(rng, rng.randrange(1, 60)) for _ in range(n)]
    esc = lambda t: html.escape(t).replace(" ", rng.choice([" ", "\n ", "  "]))
    body = "".join(f"<p>{esc(b)}" + rng.choice(["</p>", "", "\n"]) for b in blocks[1:])
    menu = "<nav><ul>" + "".join(f"<li><a href='/{i}'>{esc(line(rng, 3))}</a>" for i in range(rng.randrange(40))) + "</ul></nav>"
    noise = f"<script>var a='<p>no</p>';</script><div class='ad-box'>{esc(line(rng, 90))}</div><!-- <p>no</p> -->"
    foot = f"<footer>&copy; {esc(line(rng, 5))}</footer>"
    comments = "<section id=comments>" + "".join(f"<div class=comment-{i}><p>{esc(line(rng, 70))}</p></div>" for i in range(rng.randrange(4))) + "</section>"
    head = f"<!DOCTYPE html><html><head><title>{esc(blocks[0])}</title><style>p{{}}</style></head><body>"
    if kind == 0:
        core = f"<article><h1>{esc(blocks[0])}</h1>{body}</article>{comments}"
    elif kind == 1:
        core = f"<div class='wrap w{rng.randrange(9)}'><div class='post post-{rng.randrange(999)}'><h2>{esc(blocks[0])}</h2>{body}</div><div class='sidebar'><p>{esc(line(rng, 80))}</p></div></div>{comments}"
    else:
        core = f"<main><div class=story><header><h1>{esc(blocks[0])}</h1></header>{body}<form><label>{esc(line(rng, 9))}</label></form></div></main>"
    return head + menu + noise + core + foot + rng.choice(["</body></html>", ""]), "\n".join(" ".join(b.split()) for b in blocks)


def test_templates(spark, tmp_path, monkeypatch):
    rng = random.Random(11)
    rows, want = [], {}
    for i in range(240):
        source, text = page(rng, i % 3, rng.choice([1, 2, 5, 20]))
        rows.append((i, f"https://user@H{i % 3}.example.com:80/{i}?x", source, "x"))
        want[i] = text
    rows += [(900, None, None, "x"), (901, "", "", "x"), (None, "no host", "<p>a<p>b &amp; c&nbsp;d", "x"), (3, rows[3][1], rows[3][2], "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = op4_html_extraction(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert {(r.page_id, r.text) for r in got if r.page_id in (None, 900, 901)} == {(None, "a\nb & c d"), (900, ""), (901, "")}
    assert [r.page_id for r in got if r.page_id in want and r.text != want[r.page_id]] == []
    paths = {r.host: r.path for r in host_paths(df).collect()}
    assert paths["h0.example.com"] == "/body/article" and paths["h2.example.com"] == "/body/main/div.story"
    assert main_text(df.limit(0)).count() == 0
    monkeypatch.setattr(html_text, "BROADCAST_HOSTS", 0)  # the salted join
    assert sorted(map(str, op4_html_extraction(spark, str(tmp_path)).collect())) == sorted(map(str, got))


def test_markup():
    text = lambda s: Page(s).text(None)
    assert text("<body><p>a<br>b <b>c<p>d</b> e") == "a b c\nd e"
    assert text("<body>x &am<div>y &lt;p&gt; &#233; &eacute") == "x &am\ny <p> é é"
    assert text("<div><script>if (a<b) x()</script>t<style>p</style> u</div>") == "t u"
    assert text("a < b <i>c</i>") == "a < b c"
    assert text("<div>one<ul><li>two<li>three</ul>four</div>") == "one\ntwo\nthree\nfour"
    assert text("<div hidden>no</div><div><p>yes</p></div>") == "yes"
    assert text("<table><tr><td>a<td>b<tr><td>c</table>") in ("a\nb\nc", "a")


def test_names_are_only_hints():
    long = "A sentence of the article, which goes on for a while. " * 5
    text = lambda s: Page(s).text(None)
    assert text(f"<body><div class='layout with-sidebar'><p>{long}</p></div><div class=sidebar>side</div>") == long.strip()
    assert text(f"<body><article class='post no-comments'><p>{long}</p></article>") == long.strip()
    assert text(f"<body><div class='story ad-free'><p>{long}</p></div><div class=teaser><p>short</p></div>") == long.strip()
    assert text(f"<body><div class=story><p class='lead hidden-print'>Lead.</p><p>{long}</p></div>") == "Lead.\n" + long.strip()
    # all of the article inside a form, or under a name of the list: the name loses against the text
    assert text(f"<body><form><div class=post><p>{long}</p><div class=related>no</div></div></form>") == long.strip()
    assert text(f"<body><div class=comments><p>{long}</p><div class=comments-form>no</div></div>") == long.strip()
    assert text(f"<body><div class=post><p>{long}</p><div class=comments>{'<p>A comment, longer.</p>' * 9}</div></div>") == long.strip()


def test_reading_is_linear():
    """A megabyte of unclosed tags, attributes, quotes, nested or stray elements takes a second or so each."""
    for part in ("<a ", "<a x='", "<a x", "<div class=abcdefgh>", "<b>", "<p><b><i>", "</i>", "<td>", "<!", "<!-", "</", "&amp", "<script"):
        for end in ("", '"', ">", "</i>" * 1000 + "<div>" * 1000):
            began = time.process_time()
            Page(part * (1_000_000 // len(part)) + end).text(None)
            assert time.process_time() - began < 10, part


def layout(kind, i):
    """A page of an article that is spread over containers or has parts of odd names -> (html, its text)."""
    lines = [" ".join([f"Sentence {i} number {j}, long enough to be some text of the article."] * (1 + (i * j) % 4)) for j in range(8)]
    p = lambda *some: "".join(f"<p>{x}</p>" for x in some)
    core = {
        "sections": f"<article><section class=a>{p(*lines[:3])}</section><section class=b>{p(*lines[3:])}</section></article>",
        "top sections": f"<section class=a>{p(*lines[:3])}</section><section class=b>{p(*lines[3:])}</section>",
        "quote": f"<article>{p(*lines[:2])}<blockquote>{p(*lines[2:6])}</blockquote>{p(*lines[6:])}</article>",
        "heading beside": f"<div class=story><h2>{lines[0]}</h2><div class=text-1>{p(*lines[1:3])}</div><div class=text-2>{p(*lines[3:])}</div></div>",
        "heading above": f"<article><h1>{lines[0]}</h1><div class=content>{p(*lines[1:])}</div></article>",
        "heading alone": f"<article><h1>{lines[0]}</h1></article><div class=content>{p(*lines[1:])}</div>",
        "names": f"<article>{p(lines[0])}<div class=share-of-market>{p(lines[1])}</div><ul class=tags-explained><li>{lines[2]}</li></ul><p class=search-results>{lines[3]}</p>{p(*lines[4:])}</article>",
    }[kind]
    noise = "<div class='box latest'><ul><li><a href=a>Another story</a><li><a href=b>And another one</a></ul></div>"
    comments = f"<div class=comment-list>{p(*['I think so too, and so on. ' * 3] * 9)}</div><div class=sidebar-content>{p('Side. ' * 50)}</div>"
    return f"<html><body><nav><a href=x>menu</a></nav><div class=ad-box>{p('Buy. ' * 60)}</div>{core}{noise}{comments}<footer>f</footer></body></html>", "\n".join(lines)


def test_articles_spread_over_containers(spark):
    kinds = ["sections", "top sections", "quote", "heading beside", "heading above", "heading alone", "names"]
    rows = [(20 * k + i, f"http://h{k}.example.org/{i}", *layout(kind, i)) for k, kind in enumerate(kinds) for i in range(20)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [(kinds[i // 20], i) for i, _, _, text in rows if got[i] != text] == []

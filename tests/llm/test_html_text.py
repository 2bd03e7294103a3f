import random
import time

import pytest

from tremorlake.llm.html_text import extract, extract_text

CASES = {
    "<p>One<p>Two  \n three": "One\n\nTwo three",
    "<div>a</div><div>b<b>c</b> d</div>": "a\nbc d",
    "<ul><li>x<li>y <i>z</i></ul>": "- x\n- y z",
    "<ol start=3><li>x<ul><li>deep</ul><li>y</ol>": "3. x\n   - deep\n4. y",
    "<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>": "a     bbb\ncccc  d",
    "<table><tr><th colspan=2>head<tr><td>long cell<td>z</table>": "head\nlong cell  z",
    "a<br>b<br><br>c": "a\nb\n\nc",
    "<script>x='</p>'</script>ok<style>p{}</style><!-- no -->": "ok",
    "<head><title>T &amp; U</title></head><body>b &lt; c &copy;": "b < c ©",
    "<div hidden>no</div><p style='color:red; display : none'>no</p><p>yes": "yes",
    "<style>.x{display:none} #i , q{visibility:hidden}</style><p class='a x'>no</p><i id=i>no</i><q>no</q><b>yes</b>": "yes",
    "<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>": "s\nt\nyes",
    "<pre>\n a\n   b</pre>": " a\n   b",
    "<p>a</div>b</p>c": "ab\nc".replace("ab\nc", "ab\n\nc"),
    "<select><option>1<option>2</select>": "1\n2",
    "a < b and c > d": "a < b and c > d",
    "<input value=v><input type=hidden value=no>": "v",
    "<a href='x'>one<a href=y>two</a>": "onetwo",
    "<template>no</template><noscript>no</noscript><p>": "",
    "<dl><dt>k<dd>v<dt>l<dd>w</dl>": "k\n  v\nl\n  w",
}


@pytest.mark.parametrize("html", CASES)
def test_cases(html):
    assert extract(html)[1] == CASES[html]


def test_title():
    assert extract("<title> A\n b &amp; c</title>x") == ("A b & c", "x")


def test_deep_and_long_pages():
    assert extract("<div>" * 20000 + "x" + "</div>" * 20000)[1] == "x"
    assert extract("<ul><li>" * 3000 + "x")[1].endswith("x")
    assert extract("<table><tr><td>" * 3000 + "x")[1] == "x"
    assert len(extract("<p>word " * 50000)[1]) == 50000 * 6 - 2


def test_table_function(spark):
    rows = [(1, "u", "<p>a"), (2, None, None), (3, "v", ""), (None, "w", "<b>b"), (1, "u", "<p>a")]
    df = spark.createDataFrame([(*r, "old") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(map(tuple, extract_text(df).select("page_id", "url", "title", "text").collect()), key=str)
    assert got == sorted([(1, "u", "", "a"), (2, None, "", ""), (3, "v", "", ""), (None, "w", "", "b"), (1, "u", "", "a")], key=str)
    assert extract_text(df.limit(0)).collect() == []


def page(rnd, words, depth, shown):
    """A random page and, in words, its visible ones in order."""

    def word():
        w = f"w{rnd.randrange(10**9)}"
        if shown:
            words.append(w)
        return w + rnd.choice([" ", "\n"])

    def inner(more=True):
        return page(rnd, words, depth - 1, shown) if more and depth else word()

    out = []
    for _ in range(rnd.randint(1, 3)):
        kind = rnd.randrange(10)
        if kind == 0:
            out.append(f"<ul>{''.join(f'<li>{inner()}' for _ in range(2))}</ul>")
        elif kind == 1:
            out.append(f"<table>{''.join('<tr>' + ''.join(f'<td>{inner()}' for _ in range(rnd.randint(1, 2))) for _ in range(2))}</table>")
        elif kind == 2:
            out.append(f"<p>{word()}")
        elif kind == 3:
            out.append(f"<div {rnd.choice(['hidden', 'style=display:none', 'class=gone'])}>{page(rnd, [], max(0, depth - 1), False)}</div>")
        elif kind == 4:
            out.append(f"<script>if (a < b) {{ '<p>{rnd.random()}' }}</script><!-- <b>{rnd.random()} -->")
        elif kind == 5:
            out.append(f"<pre>{word()}</pre><span title='a > b'>{word()}</span>")
        else:
            out.append(rnd.choice(["<div>{}</div>", "<section>{}</section>", "<b>{}</b>", "<blockquote>{}</blockquote>"]).format(inner()))
    return "".join(out)


def test_random_pages_give_all_visible_words_in_order():
    """Against the words as they were put in, by cells row by row: a line of a table shows cells side by side."""
    for seed in range(300):
        rnd, words = random.Random(seed), []
        html = "<style>.gone { display: none }</style>" + page(rnd, words, 3, True)
        got = [w for w in extract(html)[1].split() if w.startswith("w")]
        assert sorted(got) == sorted(words), html
        if "<table" not in html:
            assert got == words


@pytest.mark.parametrize("html", ["<a " * 300_000, "<a href='" * 100_000, "</a " * 250_000, "<script></script " * 60_000, "<!--" * 250_000, "<ul><li>" * 120_000 + "x", "<table><td>" * 90_000 + "x", "<style>display:none" + "a" * 1_000_000, "<style>;display:none" + "/*" * 500_000, "<p><table><td>" + "<i>" * 400 + "<p>x" * 200_000, "<a x=" * 200_000, "<" * 1_000_000, "&" * 1_000_000, "<td colspan=" + "9" * 5000 + ">x"])
def test_broken_pages_take_linear_time(html):
    began = time.process_time()
    extract(html)
    assert time.process_time() - began < 8


def test_output_of_wide_tables_is_bounded():
    wide = "<table><tr><td>" + "x" * 20_000 + "<td>y" + "<tr><td>a<td>b" * 1000 + "</table>"
    got = extract(wide)[1].split("\n")
    assert got[0] == "x" * 20_000 + "  y" and got[1:] == ["a  b"] * 1000
    tall = "<table><tr>" + "<td>c" * 1000 + "<tr>" + "<td>" * 999 + "x<br>" * 5000 + "</table>"
    assert len(extract(tall)[1]) < 5000 * 202 + 10_000
    spans = "<table><tr>" + ("<td>" + "w" * 40) * 1000 + "<tr><td colspan=1000>a<td>b" * 2000 + "</table>"
    assert len(extract(spans)[1]) < 2000 * 210 + 50_000
    deep = "<ul><li>" * 200 + "x<br>" * 20_000
    assert len(extract(deep)[1]) < 20_000 * 60

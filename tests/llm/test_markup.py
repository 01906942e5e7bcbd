import pytest
from pyspark.sql import functions as F

from quirefold.llm import clean, markup
from quirefold.llm import markup as M


def found(text):
    return [(b.kind, M.first_word(b.text)) for b in M.parse(text)[1] if b.kind != "text"]


MD = """# Ünter *den* Linden

Text with `# no` and <u>tag</u>. \\# no heading
<!-- # hidden
- hidden -->

[Link](http://x/a_b) first
---------

- [x] done **thing**
    - nested
1. first
2) other

    indented code
    # still code

```md
# not a heading
- not an item
```

$$
\\frac{1}{2}
$$

$$E = m$$

## closed ##

| a | b |
|---|---:|
| 1 | 2 |

* * *

+ plus
~~~~
~~~
unclosed"""

HTML = """<html><head><title><h1>no</h1></title><style>li {}</style></head><body>
<!-- <li>no</li> --><H1 id="a" class='t'>
12. <EM>Caf&eacute;</EM></H1>
With x < 2 and y > 5.
<ul><LI class=i>one <a title="a > b" href=x>two</a>
<ul><li>deep</li></ul>
<li><p>three</p></ul>
<pre><code class="x">&lt;ul&gt;
# no
</code></pre>
<script type="math/tex; mode=display">\\sum_i</script><script>var h = "<h2>no</h2>";</script>
<div class="math">\\[ T_{x} \\]</div><h3></h3></body></html>"""

WIKI = """{{Notice|keep = yes}}
__NOTOC__
== ''Über'' [[Handbook|uns]] ==
Text<ref name="k">== no ==</ref> <nowiki>== no ==</nowiki>
===[https://x.example/y linked]===<!-- * hidden -->
*one
**'''two'''
# three
:<math>a^2</math>
<math display="block">\\bar x</math>
inline <math>z</math> stays
<pre>
== no ==
</pre>
<syntaxhighlight lang="sh">
#!/bin/sh
* no
</syntaxhighlight>
{| class="wikitable"
! name !! n
|-
| a || 1
|}
[[Category:Notes]]"""

TEX = r"""\documentclass{article}
\section{Before}
\begin{document}
\section*{{\it Dr\"uber} und} % \section{no}
% \item no
50\% of \#917 \cite{k} ``so''
\begin{itemize}
  \item \textbf{one} \href{http://x}{two}
\begin{enumerate}
  \item[a)] deep
\end{enumerate}
  \item \textless{} three
\end{itemize}
\begin{verbatim}
\section{no} % kept
\end{verbatim}
\begin{lstlisting}[language=sh]
* no
\end{lstlisting}
\[ x^2 \]
\begin{align*}
y &= 1
\end{align*}
%$$ no $$
$$z$$ inline $q$
\subsection{Last}
\end{document}
\section{After}"""


@pytest.mark.parametrize(
    "text,lang,want",
    [
        (MD, "markdown", [("heading", "ünter"), ("heading", "link"), ("list_item", "done"), ("list_item", "nested"), ("list_item", "first"), ("list_item", "other"), ("code", "indented"), ("code", "not"), ("formula", "frac"), ("formula", "e"), ("heading", "closed"), ("list_item", "plus"), ("code", "unclosed")]),
        (HTML, "html", [("heading", "12"), ("list_item", "one"), ("list_item", "deep"), ("list_item", "three"), ("code", "ul"), ("formula", "sum"), ("formula", "t"), ("heading", "")]),
        (WIKI, "wiki", [("heading", "über"), ("heading", "linked"), ("list_item", "one"), ("list_item", "two"), ("list_item", "three"), ("formula", "a"), ("formula", "bar"), ("code", "no"), ("code", "bin")]),
        (TEX, "latex", [("heading", "drüber"), ("list_item", "one"), ("list_item", "a"), ("list_item", "three"), ("code", "section"), ("code", "no"), ("formula", "x"), ("formula", "y"), ("formula", "z"), ("heading", "last")]),
    ],
)
def test_structure(text, lang, want):
    if lang == "markdown":
        # an indented block after a list belongs to the list's item unless a paragraph ends it
        text = text.replace("2) other\n", "2) other\n\nA paragraph.\n")
    assert M.language(text) == lang
    got = found(text)
    assert got == want


def test_line_ends_and_switches():
    for nl in ("\n", "\r\n", "\r"):
        assert found(f"== One =={nl}{nl}*two{nl}") == [("heading", "one"), ("list_item", "two")]
    assert found("1. __INSEE__ no\n2. *b*\n") == [("list_item", "insee"), ("list_item", "b")]


def test_html_blocks_in_markdown():
    text = "# Title\n\n<h2>Two</h2>\n\n<p>Open.\n\n<ul>\n<li>a\n<LI>b\n</ul>\n\n**bold** text\n\n<pre>\n- no\n\n# no\n</pre>\n\n- yes\n"
    assert found(text) == [("heading", "title"), ("heading", "two"), ("list_item", "a"), ("list_item", "b"), ("code", "no"), ("list_item", "yes")]


def test_odd_texts():
    for t in ("", " \n\t ", "<", "{{", "\\", "```", "$$", "[[", "<!--", "\\begin{itemize}", "# ", "-", "\\section{", "{|", "<pre>", "=" * 50, "> " * 300, "*" * 4000, "[" * 3000, "<b " * 2000, "{" * 3000, "_a" * 5000, "\\item " * 3000, "- " * 3000):
        M.parse(t)
    long = "# h\n\n" + "word *x* " * 60_000
    assert found(long) == [("heading", "h")]


def test_clean_text_keeps_structure():
    for t in (MD, HTML, WIKI, TEX):
        c = M.render(M.parse(t)[1])
        assert "```" in c and "$$" in c and "\n- " in c and "# " in c and "<u>" not in c and "&eacute;" not in c and "\\textbf" not in c and "'''" not in c


def test_tables(spark):
    text = MD.replace("2) other\n", "2) other\n\nA paragraph.\n")
    df = spark.createDataFrame([(1, text, "S"), (2, None, None), (3, "", "s"), (1, "# x", "s"), (None, "# y", "s")], "doc_id long, content_text string, source string").withColumn("kind", F.lit("clash"))
    got = clean.found_structure(df)
    assert got.where("doc_id = 1 AND kind = 'heading'").count() == 4 and got.where("doc_id IS NULL").count() == 1
    assert {r["doc_id"]: r["clean_text"] for r in clean.clean_texts(df.where("doc_id > 1")).collect()} == {2: None, 3: ""}
    assert clean.found_structure(df.limit(0)).count() == 0 and clean.prune_sites(df.limit(0)).count() == 0


def test_site_style_tree_prunes_what_pages_share(spark):
    foot = "\n\n- Home\n- Imprint\n\nAll rights reserved."
    rows = [(k, f"# Page {k}\n\nOnly here: word{k} and word{k * 7}." + foot, "blog") for k in range(40)] + [(100 + k, f"# Page {k}\n\nOnly here: word{k}.", "other") for k in range(5)] + [(200, None, "blog")]
    got = {r["doc_id"]: r for r in clean.prune_sites(spark.createDataFrame(rows, "doc_id long, content_text string, source string")).collect()}
    assert len(got) == len(rows) and got[200]["clean_text"] is None
    assert all(got[k]["n_removed"] == 3 and got[k]["n_blocks"] == 5 and "Imprint" not in got[k]["clean_text"] and f"word{k}" in got[k]["clean_text"] for k in range(40))
    assert all(got[100 + k]["n_removed"] == 0 for k in range(5))
    feats = clean._features(spark.createDataFrame([(r[0], r[2], r[1]) for r in rows], "key long, host string, text string"))
    nodes, _ = clean.style_tree(feats)
    n = {(r["host"], r["path"]): r["importance"] for r in nodes.where("leaf").collect()}
    assert n["blog", "markdown/ul/li"] < 0.05 < 0.4 < n["blog", "markdown/h1"]


def test_a_branch_that_only_its_presentation_shares_goes_whole(spark):
    """The footer's date and visitor number are on one page each; they go with the branch. The article stays."""
    page = "<html><body><article><h1>Page {k}</h1><p>Words {k} and {k}{k}.</p></article><footer><ul><li>Home</li><li>About</li><li>Imprint</li><li>Terms</li><li>Contact</li><li>Jobs</li><li>visit {k} of today</li></ul></footer></body></html>"
    rows = [(k, page.format(k=1000 + k * 7), "site") for k in range(30)] + [(500, "<html><body><footer><ul><li>alone</li></ul></footer></body></html>", "single"), (501, None, "site")]
    docs = spark.createDataFrame(rows, "doc_id long, content_text string, source string")
    got = {r["doc_id"]: r for r in clean.prune_sites(docs).collect()}
    assert len(got) == len(rows) and got[500]["n_removed"] == 0 and got[501]["clean_text"] is None
    for k in range(30):
        assert got[k]["n_blocks"] == 9 and got[k]["n_removed"] == 7
        assert "visit" not in got[k]["clean_text"] and "Home" not in got[k]["clean_text"] and f"Words {1000 + k * 7}" in got[k]["clean_text"]
    nodes, _ = clean.style_tree(clean._features(docs.selectExpr("doc_id AS key", "source AS host", "content_text AS text")))
    n = {(r["host"], r["path"]): r["importance"] for r in nodes.where("NOT leaf").collect()}
    assert n["site", "html/html/body/footer"] < 0.2 < n["site", "html/html/body/article"]
    # nothing goes by branches alone if none may be low
    kept = clean.prune_sites(docs, branch_threshold=0.0).where("doc_id = 3").head()
    assert kept["n_removed"] == 6 and "visit" in kept["clean_text"]


def composite(tree, path, leaf):
    """The recursion of the definition, in plain Python: tree is {(path, leaf): (styles, own importance)}."""
    styles, own = tree[path, leaf]
    if leaf:
        return own
    g = clean.GAMMA**styles
    kids = [x for x in tree if x[0].rpartition("/")[0] == path]
    return (1 - g) * own + g * sum(composite(tree, *x) for x in kids) / len(kids)


def test_composite_importance_is_that_of_the_recursion(spark):
    import math
    import random
    from collections import Counter, defaultdict

    r = random.Random(4)
    feats = []
    for k in range(25):
        paths = r.sample(["m/a/b", "m/a/b/c", "m/a/d", "m/e", "m/a/d/f/g"], 3)
        feats += {(k, "h", p, True, r.randrange(6)) for p in paths for _ in range(2)}
        feats += [(k, "h", u, False, r.randrange(3)) for u in {"/".join(p.split("/")[:i]) for p in paths for i in range(1, len(p.split("/")))}]
    feats = list(dict.fromkeys(feats))
    nodes, _ = clean.style_tree(spark.createDataFrame(feats, "key long, host string, path string, leaf boolean, h long"))
    got = {(x["path"], x["leaf"]): x["importance"] for x in nodes.collect()}
    by = defaultdict(list)
    for k, _, p, leaf, h in feats:
        by[p, leaf].append((k, h))
    tree = {}
    for (p, leaf), rows in by.items():
        m, n = len({k for k, _ in rows}), Counter(h for _, h in rows)
        if leaf:
            imp = {h: max(0.0, 1 - (math.log(c) / math.log(m) if m > 1 else 0)) for h, c in n.items()}
            tree[p, leaf] = (len(n), sum(c * imp[h] for h, c in n.items()) / sum(n.values()))
        else:
            tree[p, leaf] = (len(n), max(0.0, -sum(c / m * math.log(c / m) for c in n.values()) / math.log(m)) if m > 1 else 1.0)
    assert got.keys() == tree.keys()
    for x in got:
        assert abs(got[x] - composite(tree, *x)) < 1e-9, x


def kinds(text):
    lang, blocks = M.parse(text)
    return lang, [(b.kind, M.first_word(b.text)) for b in blocks if b.kind in clean.KINDS]


def test_one_chance_mark_does_not_settle_the_language():
    assert kinds("See [[x]] in docs\n\n# Title\n\n- item\n") == ("markdown", [("heading", "title"), ("list_item", "item")])
    assert kinds("# Setup\n\nLook in C:\\item first.\n\n- one\n- two\n") == ("markdown", [("heading", "setup"), ("list_item", "one"), ("list_item", "two")])
    assert kinds("Use \\emph{x} in TeX.\n\n# Title\n\n1. a\n2. b\n")[0] == "markdown"
    assert kinds("== Top ==\n\n# first\n# second [[x]]\n")[0] == "wiki" and kinds("Only [[links]] here.")[0] == "wiki"
    assert kinds("\\section{One}\n\n\\begin{itemize}\n\\item a\n\\end{itemize}\n") == ("latex", [("heading", "one"), ("list_item", "a")])


def test_quotes_hold_blocks():
    assert kinds("> - item\n> - two\n>\n> # Head\n>\n> ```\n> code here\n> ```\n\nafter\n") == ("markdown", [("list_item", "item"), ("list_item", "two"), ("heading", "head"), ("code", "code")])
    assert kinds("> > ## Deep\n> text\n") == ("markdown", [("heading", "deep")])

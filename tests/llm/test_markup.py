import pytest

from noctiluca.llm.markup import clean_field, clean_markup, kept_structure, parse, residue, train, walk, without_markup

WORDS = "stars measure rotation velocity halo dust signal galaxy bright cluster survey angular merger".split()


@pytest.fixture(scope="module")
def model():
    return train(WORDS, pages=1500)


@pytest.mark.parametrize(
    ("text", "found", "clean"),
    [
        ("Plain text about stars.", [], "Plain text about stars."),
        ("We see <b>bright</b> stars &amp; dust", ["html"], "We see bright stars & dust"),
        ("<h2>Aims</h2><p>One.</p><ul><li>a b</li><li>c d</li></ul>", ["html"], "## Aims\n\nOne.\n\n- a b\n- c d"),
        ("&lt;p&gt;Escaped text.&lt;/p&gt;", ["html"], "Escaped text."),
        ("<pre><code>x &gt; 5</code></pre> done", ["html"], "```\nx > 5\n```\ndone"),
        ("A **bold** word and a [link](http://x.example/y)", ["markdown"], "A bold word and a link"),
        ("## Data\n\n- one two\n- three four", ["markdown"], "## Data\n\n- one two\n- three four"),
        ("see\n\n```\na = 1\n```\n\nend", ["markdown"], "see\n\n```\na = 1\n```\n\nend"),
        ("One line.  \nAnother line.  \nA third.", [], "One line.\nAnother line.\nA third."),
        ("One **line**.  \nAnother line.  \nA third.", ["markdown"], "One line.\nAnother line.\nA third."),
        ("padded text  \n", [], "padded text"),
        ("Text [[File:a.png|thumb]] on ''dust'' and [[halo|haloes]]", ["wiki"], "Text on dust and haloes"),
        ("== Aims ==\nStars\n* [[One]] is\n* [[Two]] is", ["wiki"], "## Aims\n\nStars\n- One is\n- Two is"),
        ("As \\emph{shown} by~\\cite{ab1} the \\textbf{halo} of $H_0$", ["latex"], "As shown by the halo of $H_0$"),
        ("\\section{Aims} Stars \\begin{equation} \\label{e} a = b \\end{equation} end", ["latex"], "# Aims\n\nStars $a = b$ end"),
        ("<p>Dust</p> Here $\\beta = 0.4$.", ["html", "latex"], "Dust\nHere $\\beta = 0.4$."),
    ],
)
def test_dialects_and_text(model, text, found, clean):
    out, dialects, _ = clean_field(text, model)
    assert dialects == found
    assert out == clean


@pytest.mark.parametrize("text", ["A* and B* type nuclei", "from $40 to $83 a night", "prices of $9, $12 and $88", "5'' by 7'' wide", "pairs with x<y and y>z were dropped", "For 2.0 < z < 3.4 it", "R_50 and snr_r_band_ok", "the H&K emitters, R&D", "[Fe/H] = -1 and note [12]", "bands {g, r, i} and [u, z]", "Field #415, item #3", "if a == b then", "about ~83 per cent", "appendix A|B", "3 * n * m"])
def test_lookalikes_stay(model, text):
    out, dialects, _ = clean_field(text, model)
    assert dialects == []
    assert out.split() == text.split()


def test_star_list_without_wiki_links_is_markdown(model):
    assert clean_field("Stars:\n\n* one two three\n* four **five**", model)[1] == ["markdown"]


def test_marginals_are_distributions(model):
    tree = parse("<p>a *b* [[c]] \\emph{d}</p>")
    for p in model.marginals(tree).values():
        assert abs(p.sum() - 1) < 1e-9 and (p >= 0).all()


def test_messages_equal_enumeration(model):
    """Marginals by messages against the sum over all states of a small tree."""
    import itertools

    tree = parse("* [[a]] b\n* c")
    nodes = list(walk(tree))
    parent = {id(c): n for n in [tree, *nodes] for c in n.children}
    total, by = 0.0, {id(n): [0.0] * 5 for n in nodes}
    for states in itertools.product(range(5), repeat=len(nodes) + 1):
        of = {id(tree): states[0]} | {id(n): s for n, s in zip(nodes, states[1:], strict=True)}
        p = model.root[states[0]]
        for n in nodes:
            p *= model.link[of[id(parent[id(n)])], of[id(n)]] * model.cue.get(n.cue, model.other)[of[id(n)]]
        total += p
        for n in nodes:
            by[id(n)][of[id(n)]] += p
    got = model.marginals(tree)
    for n in nodes:
        assert got[id(n)].tolist() == pytest.approx([v / total for v in by[id(n)]], abs=1e-9)


def test_bare_words():
    assert without_markup("Dust\u200b \\emph{settling}\\footnote{see text} <b>now</b>").split() == ["Dust", "settling", "now"]


def test_hard_inputs_do_not_crash(model):
    for text in ["", " ", "<" * 500, "[" * 500, "{" * 500, "*" * 501, "$" * 301, "\\" * 300, "''" * 300, "<p>" * 200 + "x", "&amp;" * 300, "a" * 200_000, ("word <b>x</b> " * 3000)]:
        clean_field(text, model)


def test_table(spark):
    schema = "paper_id bigint, title string, abstract string, markup string, text string, at int"
    rows = [(1, "A <b>b</b>", None, "m", "t", 1), (2, None, "", "m", "t", 1), (1, "A <b>b</b>", None, "m", "t", 1), (None, "x **y** z", "[[a]] and $H_0$", None, None, None)]
    out = clean_markup(spark.createDataFrame(rows, schema), pages=800)
    assert out.count() == 8
    got = {(r["paper_id"], r["field_name"], r["markup"]) for r in residue(out).collect()}
    assert got == {(1, "title", "html"), (None, "title", "markdown"), (None, "abstract", "wiki"), (None, "abstract", "latex")}
    assert {r["clean_text"] for r in out.where("paper_id = 2").collect()} == {None, ""}
    assert clean_markup(spark.createDataFrame([], schema), pages=200).count() == 0


def test_kept_structure(spark):
    schema = "paper_id bigint, title string, abstract string"
    rows = [(1, "Plain", "## Data\n\n- one two\n- three four"), (2, "Plain", "\\section{Aims} of $H_0$ and $x^2$"), (3, "Plain", "Plain text."), (4, "Plain", "see\n\n```\na = 1\n```\n\nend")]
    got = {(r["field_name"], r["markup"]): tuple(r)[2:] for r in kept_structure(clean_markup(spark.createDataFrame(rows, schema), pages=800)).collect()}
    assert got == {("abstract", "markdown"): (2, 1, 2, 1, 0), ("abstract", "latex"): (1, 1, 0, 0, 2)}


def test_model_is_the_same_in_any_order(spark):
    rows = [(i, f"word{chr(97 + i % 26) * 3} <b>x</b>", f"text {chr(97 + i % 7) * 4} about stars") for i in range(200)]
    one, other = (clean_markup(spark.createDataFrame(r, "paper_id bigint, title string, abstract string").repartition(n), sample_rows=20, pages=200) for r, n in ((rows, 1), (rows[::-1], 5)))
    assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))

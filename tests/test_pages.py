"""Pages as trees: nodes and texts as a plain walk gives them, sanitised trees, elements."""

from html.parser import HTMLParser

import duckdb
import pytest
from pyspark.sql import functions as F

from inkveil.operators import elements
from inkveil.plans import page_tree, page_tree_sql
from inkveil.sources import dom
from inkveil.sources import pages as pg

SF = "/root/testdata/sf0.001"
ODD = [
    "", "plain & text", "<p>a<p>b</i></p></p>c", "<div><b>x<i>y</div>z</i>", "<br/><img src=a/><input value='1 > 0'>", '<a href="x>y" HREF=z data-q>t</a>', "<script>if (a < b) {'</p>'}</script>after<style>p{}</style>",
    "<!-- c <p> --><p title='&lt;&#233;&#x1F600;&amp;lt;'>&copy;&nope;&#233; &amp</p>", "<!DOCTYPE html><ul><li>1<li>2</ul><li>3", "<p", "a < b <3 c", "<DIV><Span hidden>no<b>no</b></sPAN>yes</DIV>", "<p/>self</p>", "</p></div>only ends", "<x-y.z a1='2'>t</x-y.z>",
    "<p>" * 40 + "deep" + "</p>" * 40, "<b>n</b>" * 700,
]


class Walk(HTMLParser):
    """(tag, depth, number among siblings, attributes or text) in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.open, self.seen, self.pending = [], [], [{}], ""

    def flush(self):
        if self.pending:
            if not self.open or self.open[-1] not in ("script", "style"):
                self.rows.append(("#text", len(self.open) + 1, 0, self.pending))
            self.pending = ""

    def handle_starttag(self, tag, attrs):
        self.flush()
        n = self.seen[-1][tag] = self.seen[-1].get(tag, 0) + 1
        first = {}
        for k, v in attrs:
            first.setdefault(k, v or "")
        self.rows.append((tag, len(self.open) + 1, n, first))
        if tag not in dom.VOID:
            self.open.append(tag)
            self.seen.append({})

    def handle_endtag(self, tag):
        self.flush()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i] == tag:
                del self.open[i:], self.seen[i + 1 :]
                return

    def handle_data(self, data):
        self.pending += data

    def handle_comment(self, data):
        self.flush()

    handle_decl = handle_comment


def walked(html):
    parser = Walk()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.rows


def rows_of(r):
    return [(n["tag"], n["depth"], n["nth"], n["text"] if n["text"] is not None else n["attributes"]) for n in r["nodes"]]


def test_nodes_of_the_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in dom.with_nodes(pages).collect():
        assert rows_of(r) == walked(html[r["page_id"]])


#: Where the parser of the standard library differs on purpose: it keeps broken markup as text in its own way.
BROKEN = {"<p", "a < b <3 c"}


def test_nodes_of_odd_markup(spark):
    pages = spark.createDataFrame([*enumerate(ODD), (99, None)], "page_id long, html string")
    got = {r["page_id"]: r for r in dom.with_nodes(pages).collect()}
    for i, html in enumerate(ODD):
        if html not in BROKEN:
            assert rows_of(got[i]) == walked(html), html
        ids = [n["id"] for n in got[i]["nodes"]]
        assert ids == list(range(1, len(ids) + 1))
        for n in got[i]["nodes"]:
            assert n["depth"] == len(n["ancestors"]) + 1 and n["parent"] == (n["ancestors"] or [0])[-1]
    assert got[99]["nodes"] == []


def test_texts_are_those_of_the_other_reader(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    old = sorted(tuple(r) for r in pg.text_nodes(pages).collect())
    assert sorted(tuple(r) for r in dom.text_rows(pages, sorted(pg.SKIPPED), 1000).collect()) == old


def test_texts_of_fields(spark):
    html = '<label>L</label><select><option>A</option><option selected> B b </option></select><div contenteditable="">E <b>f</b></div><textarea value="v">x</textarea><input type="hidden" value="no"><p aria-hidden="true">no</p><p aria-label="al">t</p>'
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    got = [(r["source"], r["text"]) for r in dom.text_rows(pages, sorted(pg.SKIPPED), 1000).orderBy("pos").collect()]
    assert got == [("text", "L"), ("select", "B b"), ("text", "A"), ("text", "B b"), ("contenteditable", "E f"), ("text", "E"), ("text", "f"), ("textarea", "v"), ("text", "x"), ("aria", "al"), ("text", "t")]
    assert dom.text_rows(pages, sorted(pg.SKIPPED), 3).count() == 3


def test_sanitised_tree(spark):
    html = (
        '<div onclick="x()" data-secret="s" onpointerup="y" href="JavaScript:go(1)" title="eval(1) eval(2)"><script>1</script><iframe><p>in</p></iframe>'
        '<input type="Password" value="hunter2" name="pw"><p>mail a@b.io, eval(x) call +1 (415) 555-0199</p><base href="/q"></div>'
    )
    rows = dom.sanitized(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("node_id").collect()
    got = [(r["tag"], r["depth"], r["attributes"], r["text"]) for r in rows]
    assert got == [
        ("div", 0, {"href": "#go(1)", "title": "[NEUTRALIZED_CODE] [NEUTRALIZED_CODE]"}, None),
        ("input", 1, {"type": "Password", "name": "pw", "sanitizedvalue": "[LOCAL_ONLY_PROTECTED]"}, None),
        ("p", 1, {}, None),
        ("#text", 2, {}, "mail [EMAIL_REDACTED], [NEUTRALIZED_CODE] call [PHONE_REDACTED]"),
    ]


def tree_brute(html, most_depth, most_nodes):
    """Nodes kept by a walk that counts what it visits."""
    kept, count, skip = [], 0, None
    for place, (tag, depth, _, _) in enumerate(walked(html), 1):
        if skip is not None and depth > skip:
            continue
        skip = None
        if depth - 1 > most_depth:
            continue
        if count >= most_nodes:
            break
        count += 1
        if tag in dom.FORBIDDEN:
            skip = depth
        else:
            kept.append(place)
    return kept


@pytest.mark.parametrize("limits", [(32, 1000), (3, 20), (1, 5)])
def test_limits_of_the_tree(spark, limits):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html")
    pages = pages.unionByName(spark.createDataFrame([(-1 - i, x) for i, x in enumerate(ODD) if x not in BROKEN], "page_id long, html string"))
    kept = dom.sanitized(pages, *limits).groupBy("page_id").agg(F.array_sort(F.collect_list("node_id")).alias("ids"))
    got = {r["page_id"]: r["ids"] for r in kept.collect()}
    for r in pages.collect():
        assert got.get(r["page_id"], []) == tree_brute(r["html"], *limits)


#: Deeper than 32, more than 1000 nodes, more than 1000 texts.
LARGE = ["<html><body>" + "".join(f"<p>text {i}" for i in range(90)) + "</body></html>", "".join(f"<b>n {i}</b> " for i in range(700)), "<ul>" + "".join(f"<li>item {i}</li>" for i in range(1300)) + "</ul>"]


def large(spark, tmp_path):
    """A folder of tables whose pages are LARGE."""
    spark.createDataFrame(list(enumerate(LARGE, 1)), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.read.parquet(f"{SF}/part.parquet").limit(3).write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def by_sql(name, sf):
    con = duckdb.connect()
    for table in ("pages", "part"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet/*.parquet'")
    return sorted(con.execute(page_tree_sql.ORACLE_SQL[name]).fetchall())


def test_sanitised_trees_are_whole(spark, tmp_path):
    sf = large(spark, tmp_path)
    got = sorted(tuple(r) for r in page_tree.page_tree_sanitized(spark, sf).collect())
    assert got == by_sql("page_tree_sanitized", sf)
    assert [r[:3] for r in got] == [(1, 182, 90), (2, 2100, 1400), (3, 2601, 1300)]


def test_visible_texts_are_whole(spark, tmp_path):
    sf = large(spark, tmp_path)
    got = sorted(tuple(r) for r in page_tree.page_visible_texts(spark, sf).collect())
    assert got == by_sql("page_visible_texts", sf)
    assert [r[:3] for r in got if r[0] > 0] == [(1, "text", 90), (2, "text", 700), (3, "text", 1300)]


def test_elements_have_no_secret_and_no_python(spark):
    shops = page_tree.shops(spark, SF)
    rows = elements.described(shops)
    assert rows.where("type = 'password' AND value IS NOT NULL").count() == 0
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


@pytest.mark.parametrize(
    "html,want",
    [
        ('<a>x</a><span role="TAB">r</span><i tabindex="0">t</i><i tabindex="1">n</i><i contenteditable="false">n</i><u onclick="f">o</u>', ["a", "span", "i", "u"]),
        ("<summary>s</summary><option>o</option><label>l</label><div>d</div>", ["summary", "option"]),
    ],
)
def test_membership(spark, html, want):
    assert [r["tag"] for r in elements.described(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()] == want


@pytest.mark.parametrize(
    "field,want",
    [
        ('name="first name"', "first_name"), ('name="username"', None), ('placeholder="Your name"', "name"), ('type="search"', "search"), ('name="q"', "search"), ('type="password"', "password"),
        ('id="mobile"', "phone"), ('aria-label="E-Mail"', "email"), ('autocomplete="lname"', "last_name"), ('name="notes"', "message"), ('name="zip"', None),
    ],
)
def test_semantic_types(spark, field, want):
    assert elements.described(spark.createDataFrame([(1, f"<input {field}>")], "page_id long, html string")).first()["semantic_type"] == want


def test_labels_of_boxes(spark):
    html = '<label for="a">For a</label><input type=radio id=a><ul><li>Item <input type=checkbox></li></ul><div>Wrap <input type=submit></div><input type=button title=T>'
    got = [(r["text"], r["value"]) for r in elements.described(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()]
    assert got == [("For a", "on"), ("Item", "on"), ("Wrap", None), ("T", None)]

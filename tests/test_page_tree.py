"""Pages of plain markup are cut by one pattern; elements and texts are those of the tolerant parser."""

import random

from pyspark.sql import functions as F

from bandwise import adapters as A
from bandwise.functions import dom
from bandwise.sources import parsing as P

SF = "/root/testdata/sf0.001"
BITS = ["<", ">", "&amp;", "&", "<p>", "</p>", "<li>", "<ul>", "<script>", "</ script>", "</script>", "<!--", "-->", "<title>", "</title>",
        "<textarea>", "<br/>", "<DIV CLASS=badge>", "</div>", "<a href=x/>", '<a href="/search?q=A&amp;x">', "<template>", "</template>",
        "<!doctype html>", "<svg:a/>", "<noscript>", "<iframe>", "<?php x ?>", "&notit;", "\x00", '<i a= "x">', '<p a=1 A="2">', "$3 sold", "<dl>", "<dt>"]


class Tolerant(dom._Page):
    def _read_plain(self, html):
        return False


def tolerant(html, spec, monkeypatch):
    with monkeypatch.context() as only:
        only.setattr(dom, "_Page", Tolerant)
        return dom.read_fragments(html, spec)


def test_same_slots_as_the_tolerant_parser(spark, monkeypatch):
    pages = [r.content for r in A.auction_pages(spark, SF).where("content <> '' and source <> 'ebay'").select("content").limit(60).collect()]
    specs = [s.spec for s in P.SOURCES.values() if s.spec is not None]
    whole = dom._Page("")
    for page in pages:
        whole._clear()
        assert whole._read_plain(page)
    draw = random.Random(3)
    for n in range(1500):
        if n % 3:
            html = "".join(draw.choices(BITS, k=draw.randint(1, 25)))
        else:
            html = draw.choice(pages)
            at = draw.randrange(len(html))
            html = html[:at] + draw.choice(BITS) + html[at + draw.randint(0, 5):]
        for spec in specs:
            assert dom.read_fragments(html, spec) == tolerant(html, spec, monkeypatch), html


def test_a_tag_is_read_once_for_all_pages(monkeypatch):
    made, mark = [], dom._Mark.__init__

    def counted(self, tag, *rest):
        made.append(tag)
        mark(self, tag, *rest)

    monkeypatch.setattr(dom._Mark, "__init__", counted)
    rules = dom._Rules(P.PCARMARKET)
    for n in range(50):
        found = dom.read_fragments(f'<h1 class="listing-title">{n}</h1><ul><li>VIN: {n}</li><li><a href="/{n}">x</a></li></ul>', rules)
        assert (found["title"], found["values"]) == ([str(n)], [str(n)])
    assert sorted(set(made)) == ["a", "h1", "li", "ul"] and len(made) == 53
    monkeypatch.setattr(dom, "MARKS", 2)  # a list that starts anew all the time gives the same
    html = '<dl><dt>VIN<dd>7</dl><p id="description">A <b>car</b></p>'
    assert dom.read_fragments(html, dom._Rules(P.PCARMARKET)) == dom.read_fragments(html, rules)


def test_wanted_slots_alone_are_read_and_stay_the_same(monkeypatch):
    pages = "".join(BITS[4:]), '<h1>T</h1><dl><dt>VIN<dd>7</dl><table><tr><td>a<td>b</table><ul><li>x: 1</ul><a href="/q">q</a>'
    for source in P.SOURCES.values():
        if source.spec is None:
            continue
        for html in pages:
            whole = dom.read_fragments(html, source.spec)
            for slot in whole:
                own = dom.read_fragments(html, source.spec | {"wanted": (slot,)})
                assert own[slot] == whole[slot]
                assert set(own) <= {slot, "labels", "values"}


def test_a_column_asks_for_its_slots_only(spark):
    def asked(name, *columns):
        return P.slots_read(P.SOURCES[name].extraction(P.Scope(name)), P.Scope(name), columns)

    assert asked("bat", "exterior_color_raw") == {"title", "items"}
    assert asked("carsandbids", "exterior_color_raw") == {"title", "labels", "values"}
    assert asked("pcarmarket", "is_completed") == {"title", "result", "badge"}
    assert asked("ebay", "vin") == frozenset()
    for use in (F.map_keys("f"), F.col("f")[F.col("url")][0]):  # slots that the text does not name: all of them
        made = P.Extraction([{"x": use}], P.Scope("new")("x").isNotNull(), {})
        assert P.slots_read(made, P.Scope("new"), ()) is None
    pages = A.auction_pages(spark, SF)
    whole = {r.source_url: r for r in P.parse_pages(pages).collect()}
    columns = ("source_url", "vin", "final_price")
    some = P.parse_pages(pages, columns=columns)
    assert some.columns == list(columns)
    assert {r.source_url: tuple(r) for r in some.collect()} == {u: tuple(r[c] for c in columns) for u, r in whole.items()}


def test_pages_are_not_made_before_they_are_spread(spark):
    plan = P.parse_pages(A.auction_pages(spark, SF), columns=("year",))._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression"):]
    assert "<html>" in plan and "<html>" not in below


def test_an_item_counts_if_it_is_an_object_with_entries(spark):
    texts = ['{"Item": {"a": 1}}', '{"item": {"a": null}}', '{"Item": null, "item": {"a": 1}}', '{"Item": {}, "item": {"a": 1}}',
             '{"Item": [1]}', '{"Item": 3, "item": {"a": 1}}', '{"Item": "x"}', '{"item": {}}', "[]", "{", "null", '{"Item": null}', '{"Item": [{"a": 1}]}']
    rows = spark.createDataFrame([(t,) for t in texts], "content string").select(
        "*", F.try_parse_json("content").alias(P.Scope("ebay").name("page")))
    kind = F.schema_of_variant(F.try_variant_get("_ebay_page", "$.Item", "variant"))
    kind = F.coalesce(F.nullif(kind, F.lit("VOID")), F.schema_of_variant(F.try_variant_get("_ebay_page", "$.item", "variant")))
    found = rows.select("content", F.coalesce(P.ebay(P.Scope("ebay")).keep, F.lit(False)).alias("keep"), F.coalesce(
        kind.startswith("OBJECT<") & (kind != "OBJECT<>"), F.lit(False)).alias("known")).collect()
    assert [(r.content, r.keep) for r in found] == [(r.content, r.known) for r in found]
    assert sum(r.keep for r in found) == 3

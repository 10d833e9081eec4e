"""Node tables against the tree reader: structure, texts, faults; contents and reading order against the decoder."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import nodes as N
from quire.plans import fixtures
from quire.sources import decode as D
from quire.sources import xmltree
from quire.sources.archive import read

GOOD = [
    "<a/>", "<a></a>", '<?xml version="1.0"?><!DOCTYPE a [<!ENTITY x "<y>"> <!ATTLIST [z] q>]>\n<a x="1" y=\'2\'z="&lt;&#65;&amp;amp;"><b>t<c/>u</b>v</a >tail',
    "<a><![CDATA[<x>&amp;]]><!-- <b> --><?p <q> ?>&amp;&#x41;&nbsp;&unknown;</a>", '<n:a n:id="1" m:id="2" id="3"><n:b/><b n:q="x>y"/></n:a>', "﻿ <a>\n<b>1</b><b>2<b>3</b></b>\n</a><!-- end -->",
    "<a>" + "<b>x</b>" * 300 + "</a>", "<d>" * 60 + "deep" + "</d>" * 60, '<a t="l1\nl2"\n  u = "v"/>', "junk <a>1</a> junk", "<!DOCTYPE x><a>]]></a>",
]
BAD = [None, "", "text", "<a>", "</a>", "<a></b>", "<a/><b/>", "<a x=1/>", "<a x/>", '<a x="1>', "<a><b></a></b>", "<a><!-- </a>", "<a><![CDATA[x</a>", "<a>x<</a>", "<a></a></a>", "<a", "<a><?x </a>", "<!DOCTYPE a [ <a/>"]


def made(seed: int) -> str:
    rng = random.Random(seed)

    def element(depth: int) -> str:
        name = rng.choice(["a", "b", "ol", "li", "x:a"])
        inner = "".join(element(depth + 1) if rng.random() < 0.5 else rng.choice(["t", " ", "&lt;", "é"]) for _ in range(rng.randrange(5))) if depth < 6 else ""
        return f"<{name}/>" if not inner and rng.random() < 0.5 else f'<{name} id="{rng.randrange(9)}">{inner}</{name}>'

    return element(0)


def preorder(root: xmltree.Node):
    """(name, local name, depth, preorder number of the parent, attributes, own text, whole text) of every element."""
    out = []

    def walk(node, depth, above):
        me = len(out)
        out.append((node.name, node.local, depth, above, dict(node.attributes), node.text, node.deep_text()))
        for child in node.children:
            walk(child, depth + 1, me)

    walk(root, 1, None)
    return out


@pytest.fixture(scope="module")
def documents(spark):
    texts = [*GOOD, *BAD, *map(made, range(40))]
    return texts, spark.createDataFrame(list(enumerate(texts)), "id long, xml string").repartition(3).cache()


def test_tree_equals_the_tree_reader(documents):
    texts, df = documents
    nodes = N.tree(df, ["id"], "xml").cache()
    whole = {(r.id, r.pre): r.t for r in N.texts_within(N.tree(df, ["id"], "xml").withColumn("is_root", F.col("depth") == 1), ["id"], F.col("is_root"), "t").collect()}
    rows = {}
    for r in nodes.collect():
        rows.setdefault(r.id, []).append(r)
    for k, text in enumerate(texts):
        try:
            want = preorder(xmltree.parse(text or ""))
        except xmltree.XmlError:
            assert k not in rows
            continue
        found = sorted(rows[k], key=lambda r: r.pre)
        elements = [r for r in found if r.kind == "element"]
        number = {r.pre: i for i, r in enumerate(elements)}
        own = lambda e: "".join(r.value for r in found if r.kind == "text" and r.parent == e.pre)  # noqa: B023, E731
        deep = lambda e: "".join(r.value for r in found if r.kind == "text" and e.pre < r.pre < e.post)  # noqa: B023, E731
        got = [(e.qname, e.name, e.depth, number.get(e.parent), {a["name"]: xmltree.entities(a["value"]) for a in e.attributes}, own(e), deep(e)) for e in elements]
        assert got == want
        assert all(e.above == (elements[number[e.parent]].name if e.parent is not None else None) for e in elements)
        assert whole.get((k, elements[0].pre), "") == want[0][6]
    assert {r.id for r in N.broken(df, ["id"], "xml").collect()} == set(range(len(texts))) - rows.keys()


def test_structural_passes_equal_interval_joins(documents):
    _, df = documents
    nodes = N.tree(df, ["id"], "xml").filter("kind = 'element'").select("id", "pre", "post", "depth", "name").cache()
    got = N.enclosing(N.first_within(nodes, ["id"], F.col("name") == "li", "li", "depth"), ["id"], F.col("name") == "ol", "ol", level="inside").collect()
    rows = nodes.collect()
    for r in got:
        around = [x for x in rows if x.id == r.id and x.name == "ol" and x.pre < r.pre and r.post <= x.post]
        assert (r.ol, r.inside) == (max((x.pre for x in around), default=None), len(around))
        inner = [x for x in rows if x.id == r.id and x.name == "li" and r.pre <= x.pre <= r.post]
        assert r.li == (min(inner, key=lambda x: x.pre).depth if inner else None)
    assert len(got) == len(rows) and any(r.inside > 1 for r in got)


def test_attributes_prefer_exact_names(documents):
    _, df = documents
    row = N.tree(df.filter("id = 4"), ["id"], "xml").select("pre", N.attribute("id").alias("x"), N.attribute("q").alias("q")).orderBy("pre").collect()
    assert [(r.x, r.q) for r in row] == [("3", None), (None, None), (None, "x>y")]


def test_encodings(spark):
    text = "<a>Жé</a>"
    files = [text.encode(), b"\xef\xbb\xbf" + text.encode(), b"\xff\xfe" + text.encode("utf-16-le"), f'<?xml version="1.0" encoding="windows-1251"?>{text[:4]}</a>'.encode("windows-1251"), f'<?xml version="1.0" encoding="UTF-8"?>{text}'.encode()]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(files)], "id long, content binary")
    assert [r.t for r in df.select("id", N.xml_text(F.col("content")).alias("t")).orderBy("id").collect()] == [xmltree.decode(b) for b in files]


NAVS = [
    '<nav><ol><li><a href="text/c1.xhtml">first nav with a list</a></li></ol></nav>', "<nav/><nav><ol><li>own <b>text</b></li><li><span>bare</span></li></ol></nav>",
    '<nav type="toc"/><nav><ol><li><a href="text/c1.xhtml">not this</a></li></ol></nav>',
    '<nav epub:type="x toc"><div><ol><li><span>S</span><ol><li><a href="gone.xhtml">gone</a></li><li><a>no target</a><ol><li><a href="text/c%202.xhtml#f%20g">deep <i>label</i></a></li></ol><ol><li><a href="text/c1.xhtml">second list</a></li></ol></li></ol></li><p><li><a href="text/c1.xhtml">wrong way</a></li></p></ol></div></nav>',
    '<nav epub:type="toc"><ol><li><a href="#here">own document</a></li><li><a href="text/c1.xhtml#">empty</a><a href="text/c%202.xhtml">second link</a></li><li>text <span>span</span> more<ol><li><span>x</span><a href="text/c1.xhtml">link after span</a></li></ol></li></ol></nav>',
]


def test_contents_and_reading_order_equal_the_decoder(spark):
    head = '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body>'
    books = [fixtures.epub(), *(fixtures.nested_epub(str(i), "en", "\n".join(f"line {k}" for k in range(i * 7 + 1))) for i in range(5))]
    books += [fixtures.epub(extra=(("OPS/nav.xhtml", f"{head}{nav}</body></html>".encode()),), drop=()) for nav in NAVS]
    # Of equal names the first entry counts, so the replaced contents have to stand alone.
    for k, nav in enumerate(NAVS):
        entries = D.Archive(books[6 + k])
        books[6 + k] = fixtures.archive([(e["name"], read(entries.data, e)) for e in entries.entries if e["name"] != "OPS/nav.xhtml"] + [("OPS/nav.xhtml", f"{head}{nav}</body></html>".encode())], ("mimetype",))
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(books)], "doc_id long, content binary").repartition(2).cache()
    entries = D.archive_entries(df, ["doc_id"], r"xml$|opf$|nav\.xhtml$").select("doc_id", F.col("name").alias("file"), N.xml_text(F.col("body")).alias("xml"))
    nodes = N.tree(entries.repartition("doc_id"), ["doc_id", "file"], "xml").cache()
    items = N.spine(N.packages(nodes, ["doc_id"], "file"), ["doc_id", "directory"])
    sections = items.filter("section_index IS NOT NULL")
    decoded = D.read_books(df).cache()
    want = [(r.doc_id, r.section_index, r.section_id, r.linear, r.path) for r in D.sections_of(decoded, "doc_id").collect()]
    assert sorted((r.doc_id, r.section_index, r.section_id, r.linear, r.path) for r in sections.collect()) == sorted(want)
    toc = N.contents(nodes.filter("file = 'OPS/nav.xhtml'"), sections.select("doc_id", "section_id", "path"), ["doc_id"], "file")
    names = ["doc_id", "node_id", "parent_id", "depth", "label", "section_id", "fragment"]
    got = sorted((tuple(r[c] for c in names) for r in toc.collect()), key=str)
    assert got == sorted((tuple(r[c] for c in names) for r in D.toc_of(decoded, "doc_id").collect()), key=str)
    assert {r[0] for r in got} >= {0, 1, 2, 3, 4, 6, 9, 10}


def test_documents_are_dealt_by_their_size(spark, monkeypatch):
    """A task's nodes are bounded, whatever the session's number of partitions, and the tables stay the same."""
    from quire.plans import nodes as P

    docs = spark.createDataFrame([(k, "<a>" + "x" * 9993 + "</a>") for k in range(20)] + [(20, None)], "id long, xml string")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert N.tasks(docs, "xml", 20_000) == 10 and N.tasks(docs, "xml") == N.tasks(docs.limit(0), "xml") == least
    sf, dealt = "/root/testdata/sf0.001", []
    monkeypatch.setattr(N, "tasks", lambda d, xml, keep=N.tasks: dealt.append(keep(d, xml, 1 << 13)) or dealt[-1])
    got = {name: sorted(map(str, P.QUERIES[name](spark, sf).collect())) for name in ("epub_spine_nodes", "toc_nodes")}
    assert len(dealt) == 3 and min(dealt) > least
    monkeypatch.undo()
    assert got == {name: sorted(map(str, P.QUERIES[name](spark, sf).collect())) for name in got}


def test_a_tag_looks_up_no_pattern(monkeypatch):
    looked = []
    monkeypatch.setattr(xmltree.regex, "compile", lambda *a, **k: looked.append(a))
    root = xmltree.parse("<!DOCTYPE a [<!ENTITY x 'y'>]><a><b>1</b><c >2</c ></a>")
    assert [n.name for n in root.content] == ["b", "c"] and not looked

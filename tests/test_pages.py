"""The page contract, the stemmer, files in and out, and the stream."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexiloom import schemas
from lexiloom.functions.html import Page, parse
from lexiloom.functions.stem_fr import stem_word
from lexiloom.operators import extract
from lexiloom.sources import corpus, sinks
from lexiloom.streaming.ingest import stream_corpus


def page(title="3 mai 2010 &gt; Bulletin Veille 12 &gt; Le titre", cell="", author="<span>Rédacteur :</span><span>ADIT - Jean DUPONT - email</span>", spans=45, content=True):
    filler = "".join(f"<span>s{i}</span>" for i in range(spans))
    inner = f"<table><tr><td></td></tr><tr><td></td></tr><tr><td>{cell}</td></tr></table>" if content else ""
    head = "".join(f'<meta name="m{i}" content="c{i}">' for i in range(7))
    rows = f"<tr><td>{filler}<span>Santé</span></td></tr>" + "<tr><td></td></tr>" * 5 + f"<tr><td>{inner}</td></tr><tr><td>{author}</td></tr>"
    return f"<html><head>{head}<title>{title}</title></head><body><div><table>{rows}</table></div></body></html>"


def docs(spark, *htmls):
    df = spark.createDataFrame([(f"/x/BULLETINS/{i}.htm", h) for i, h in enumerate(htmls)], schemas.PAGE)
    return {int(r["article"]): r for r in extract.documents(df).collect()}


def test_contract(spark):
    abc = "".join(f'<span class="style95">{x}</span>' for x in "ABC") + '<span class="style95 x">no</span>'
    pics = '<div><img src="a.png"><span>L&eacute;gende &amp; co</span></div><div><img src="b.png"><span>B</span></div>'
    got = docs(
        spark,
        page(cell=abc + pics),
        page(cell="<div><span>no image</span></div>", author=""),
        page(title="3 mai &gt; B 1 &gt; T &gt; Suite", author="<span>Rédacteurs :</span><span>X - Y</span>"),
        page(title="3 mai &gt; B 1", content=False),
        page(title="\xa0 3 mai \xa0&gt; &gt; a &lt; b", spans=3),
        "",
        None,
    )
    assert got[0]["texte"] == "C B A " and got[0]["auteur"] == "Jean DUPONT-email" and got[0]["bulletin"] == "12" and got[0]["rubrique"] == "Santé"
    assert [tuple(i) for i in got[0]["images"]["image"]] == [("a.png", "Légende & co"), ("b.png", "B")]
    assert got[1]["images"] is None and got[1]["texte"] == "" and got[1]["auteur"] is None and not got[1]["_error"]
    assert got[2]["titre"] == "T" and got[2]["auteur"] is None
    assert got[3]["titre"] is None and got[3]["texte"] is None and got[3]["_error"]
    assert got[4]["date"] == "3 mai" and got[4]["titre"] == "a < b" and got[4]["bulletin"] is None
    assert got[5]["date"] is None and got[6]["_error"]


def test_author_from_meta(spark):
    df = spark.createDataFrame([("a/1.htm", page())], schemas.PAGE)
    assert extract.meta_author(df).first()["auteur"] == "c6"


def test_tolerant_parser():
    p = Page("<P>one<b>two<p>three</b> four</i><br/>five <!-- <b>no</b> --> &lt;x&gt;<script>if (a<b) x()</script><img alt='a>b'>")
    assert p.tags == ["p", "b", "p", "br", "script", "img"]
    assert p.content(0).startswith("onetwothree fourfive") and "<x>" in p.content(0) and p.attr(5, "ALT".lower()) == "a>b"
    assert p.content(1) == "twothree"
    assert parse("<body>")["failed"]


# Pairs of the algorithm's published sample vocabulary, and forms of one verb.
SAMPLE = {
    "continu": "continu", "continua": "continu", "continuait": "continu", "continuant": "continu", "continuation": "continu", "continue": "continu",
    "continué": "continu", "continuel": "continuel", "continuelle": "continuel", "continuellement": "continuel", "continuer": "continu", "continuera": "continu",
    "continuerait": "continu", "continueront": "continu", "continuez": "continu", "continuité": "continu", "continuons": "continuon", "contorsions": "contors",
    "contour": "contour", "contournait": "contourn", "contournant": "contourn", "contourne": "contourn", "contours": "contour", "contractait": "contract",
    "contracté": "contract", "contractée": "contract", "contracter": "contract", "contractés": "contract", "contraction": "contract", "contradictoirement": "contradictoir",
    "contradictoires": "contradictoir", "contraindre": "contraindr", "contraint": "contraint", "contrainte": "contraint", "contraintes": "contraint", "contraire": "contrair",
    "main": "main", "mains": "main", "maintenaient": "mainten", "maintenait": "mainten", "maintenant": "mainten", "maintenir": "mainten", "maintenue": "maintenu",
    "maintien": "maintien", "maintint": "maintint", "maire": "mair", "maires": "mair", "mairie": "mair", "mais": "mais", "maïs": "maï", "maison": "maison",
    "maisons": "maison", "maistre": "maistr", "maitre": "maitr", "maître": "maîtr", "maîtres": "maîtr", "maîtresse": "maîtress", "majesté": "majest",
    "majestueuse": "majestu", "majestueusement": "majestu", "majestueux": "majestu", "majeur": "majeur", "majeure": "majeur", "major": "major", "majordome": "majordom",
    "majorité": "major", "majorités": "major", "mal": "mal", "malacca": "malacc", "malade": "malad", "malades": "malad", "maladie": "malad", "maladies": "malad", "maladive": "malad",
    "manger": "mang", "mangeons": "mangeon", "mangé": "mang", "mangeait": "mang", "": "",
}


@pytest.mark.parametrize("word", SAMPLE)
def test_stemmer(word):
    assert stem_word(word) == SAMPLE[word]


def test_latest(spark):
    df = spark.createDataFrame([("a", "old", 1, "x"), ("a", "new", 2, None), ("b", "t1", 3, None), ("b", "t2", 3, None), (None, "z", 1, None)], "k string, v string, loaded_at int, extra string")
    assert sorted((r["k"], r["v"]) for r in corpus.latest(df, "k").collect()) == [("a", "new"), ("b", "t2")]


def test_latest_keeps_single_rows_where_they_lie(spark):
    data = [(f"k{i}", i, f"v{i}") for i in range(50)] + [("k1", 99, "new"), ("k2", None, "none"), ("k3", 3, "v3"), ("k4", 5, "b"), ("k4", 6, "c"), ("k4", 6, "a")]
    df = spark.createDataFrame(data, "k string, loaded_at int, v string")
    got = {r["k"]: r["v"] for r in corpus.latest(df, "k").collect()}
    assert len(got) == 50 and got["k1"] == "new" and got["k2"] == "v2" and got["k3"] == "v3" and got["k4"] == "c" and got["k7"] == "v7"
    assert corpus.latest(df, "k").count() == 50 and corpus.latest(df.limit(0), "k").count() == 0
    plan = corpus.latest(df.where("k <> 'k4' and k <> 'k2' and k <> 'k3'"), "k")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_page_files_and_sub_corpus(spark, tmp_path):
    df = spark.createDataFrame([("b/1.htm", page()), ("b/2.htm", "é\r\n<p>"), ("b/3.htm", None), (None, "x")], schemas.PAGE)
    assert sinks.write_pages(df, str(tmp_path / "pages")) == 2
    assert {r["path"][-5:]: r["html"] for r in corpus.read_pages(spark, str(tmp_path / "pages")).collect()} == {"1.htm": page(), "2.htm": "é\r\n<p>"}
    docs = spark.createDataFrame([("1", "a < b"), ("2", None)], schemas.SUBCORPUS_TITRE)
    sinks.write_corpus_xml(docs, str(tmp_path / "sub"))
    assert sorted(map(tuple, corpus.read_corpus_xml(spark, str(tmp_path / "sub"), schemas.SUBCORPUS_TITRE).collect())) == [("1", "a < b"), ("2", None)]


def test_pages_from_files(spark, tmp_path):
    (tmp_path / "67937.htm").write_text(page(), encoding="utf8")
    (tmp_path / "IMAGESWEB").mkdir()
    (tmp_path / "IMAGESWEB" / "1.htm").write_text("no", encoding="utf8")
    (tmp_path / "note.txt").write_text("no", encoding="utf8")
    got = extract.documents(corpus.read_pages(spark, str(tmp_path))).collect()
    assert [r["article"] for r in got] == ["67937"] and got[0]["titre"] == "Le titre"


def test_tsv_both_ways(spark, tmp_path):
    df = spark.createDataFrame([("1", "pomme", 2), ("2", "la", None)], schemas.TF)
    for padded in (False, True):
        at = str(tmp_path / f"tsv{padded}")
        sinks.write_tsv(df, at, padded)
        assert sorted(map(tuple, corpus.read_tsv(spark, at, schemas.TF).collect())) == [("1", "pomme", 2), ("2", "la", None)]
    assert corpus.read_words(spark, str(tmp_path / "tsvTrue"), schemas.TF).count() == 2


def test_lines_and_substitution_file(spark, tmp_path):
    sinks.write_lines(spark.createDataFrame([("la",), ("de",)], "token string").coalesce(1), str(tmp_path / "stop"), "\t")
    assert {(r["word"], r["replacement"]) for r in corpus.read_substitutions(spark, str(tmp_path / "stop")).collect()} == {("la", None), ("de", None)}
    (tmp_path / "s.tsv").write_text("pomme\tpoire\nla\npomme\tfruit rond\n", encoding="utf8")
    from lexiloom.operators.vocab import rules

    assert sorted(map(tuple, rules(corpus.read_substitutions(spark, str(tmp_path / "s.tsv"))).collect())) == [("la", ""), ("pomme", "fruit rond")]


def test_xml_both_ways(spark, tmp_path):
    rows = [("3 mai", "1", "7", "a < b", "r", "x & y ", None, "c", {"image": [{"urlimage": "u", "legendeimage": "l"}]}), ("4 mai", "1", "8", "t", None, "z", "A", None, None)]
    df = spark.createDataFrame(rows, schemas.DOCUMENT)
    sinks.write_corpus_xml(df, str(tmp_path / "xml"), one_file=True)
    back = {r["article"]: r for r in corpus.read_corpus_xml(spark, str(tmp_path / "xml")).collect()}
    assert back["7"]["titre"] == "a < b" and back["7"]["images"]["image"][0]["urlimage"] == "u" and back["8"]["images"] is None
    line = df.where("article = '7'").select(sinks.document_xml()).first()[0]
    assert "<titre>a &lt; b</titre>" in line and "<auteur>" not in line and "<urlImage>u</urlImage>" in line


def test_malformed_corpus(spark, tmp_path):
    (tmp_path / "c.xml").write_text("<corpus>\n<document>\n<article>1</article>\n<titre>a & b</titre>\n<texte>x <i>y</texte>\n<images>\n<image>\n</document>\n</corpus>", encoding="utf8")
    r = corpus.read_corpus_tolerant(spark, str(tmp_path / "c.xml")).first()
    assert r["article"] == "1" and r["titre"] == "a & b" and r["texte"].startswith("x y") and r["auteur"] is None


def test_stream(spark, tmp_path):
    spark.createDataFrame([("b/1.htm", page())], schemas.PAGE).write.parquet(str(tmp_path / "in"))
    q = stream_corpus(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).select("article").first()[0] == "1"


def test_extra_columns_and_spans(spark):
    df = spark.createDataFrame([("b/1.htm", page(), "z", "w")], "path string, html string, article string, page string")
    assert extract.spans(df).where(F.col("pos") == 45).first()["text"] == "Santé"

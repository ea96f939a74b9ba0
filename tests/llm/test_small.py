"""Small cases of each operator: nulls, empties, ties, repeats, clashing columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import boilerplate, distinctive, frequency, looks, mixing, names, packing, sentences, sizes

TOKENS = "article string, pos int, token string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# p2


def test_residuals(spark):
    raw = [("a", i, "de") for i in range(10)] + [("a", 10 + i, "zeta") for i in range(30)] + [("b", i, "de") for i in range(8)] + [(f"c{k}", 0, "De ") for k in range(8)]
    raw += [("a", 0, "de"), ("b", 99, None), (None, 1, "de")]
    df = spark.createDataFrame(raw, TOKENS)
    got = {(r["article"], r["token"]): r for r in distinctive.residuals(df).collect()}
    n, rn, cn = 56, 40, 30
    e = rn * cn / n
    assert got["a", "zeta"]["expected"] == pytest.approx(e)
    assert got["a", "zeta"]["residual"] == pytest.approx((30 - e) / (e * (1 - rn / n) * (1 - cn / n)) ** 0.5)
    assert got["a", "zeta"]["score"] == pytest.approx(30.0)
    assert got["a", "de"]["residual"] < 0 and got["b", "de"]["score"] == 0
    assert rows(distinctive.typical(df).select("article", "token")) == [("a", "zeta")]


def test_residuals_degenerate(spark):
    one = spark.createDataFrame([("a", 0, "x"), ("a", 1, "x")], TOKENS)
    assert [r["residual"] for r in distinctive.residuals(one).collect()] == [0.0]
    assert distinctive.typical(one.limit(0)).count() == 0


# p3


def _batches(n, terms, size):
    rng = np.random.default_rng(1)
    t = rng.integers(0, terms, n)
    h = np.array([hash((int(x), 7)) for x in t], dtype=np.int64)
    for i in range(0, n, size):
        x = t[i : i + size]
        yield pa.RecordBatch.from_arrays([pa.array(h[i : i + size]), pa.array([f"t{k}" for k in x]), pa.array(np.ones(len(x), np.int64)), pa.array(np.ones(len(x), np.int64))], schema=frequency._SCHEMA)


@pytest.mark.parametrize("hold", [100, 10**6])
def test_radix_spills_and_splits(tmp_path, hold):
    out = pa.Table.from_batches(list(frequency.radix(_batches(5000, 300, 700), str(tmp_path), hold))).to_pydict()
    assert len(out["token"]) == len(set(out["token"])) <= 300 and sum(out["occurrences"]) == 5000
    assert not list(tmp_path.glob("r-*"))


def test_radix_of_one_hot_term(tmp_path):
    b = pa.RecordBatch.from_arrays([pa.array([7] * 1000), pa.array(["x"] * 1000), pa.array([2] * 1000), pa.array([1] * 1000)], schema=frequency._SCHEMA)
    assert pa.Table.from_batches(list(frequency.radix([b, b], str(tmp_path), 50))).to_pydict()["occurrences"] == [4000]


def test_frequencies(spark):
    raw = [(a, 0, "Le") for a in "abcde"] + [("a", 1, "rare"), ("a", 1, "rare"), ("b", 1, " rare\t"), ("c", 2, None), ("d", 3, " ")]
    df = spark.createDataFrame(raw, TOKENS)
    for hold in (1, 10**6):
        freq = frequency.frequencies(df, hold=hold)
        assert rows(freq) == [("le", 5, 5, False, True), ("rare", 2, 2, True, False)]
    assert rows(frequency.marks(freq)) == [("common", "le"), ("rare", "rare")]
    assert frequency.frequencies(df.limit(0)).count() == 0
    both = frequency.marks(frequency.frequencies(df.where("article = 'a'")))
    assert ("common", "le") in rows(both) and ("rare", "le") in rows(both)


# p4

SAME = [
    ["Frédéric PANBROBRITEAU-email", "panbrobriteau frédéric", "Fred Panbrobriteau-email", "Frédréic Panbrobrieau", "Dr Frédéric PANBROBRITEAU", "F. Panbrobriteau", "PANBROBRITEAU, Frédéric-email"],
    ["Marie-Claude CRÉPUBRORIEUX", "M.-C. Crépubrorieux-email", "CREPUBRORIEUX Marie-Claude"],
    ["Hippolyte VÉVEPITEAU-email", "Polo VÉVEPITEAU"],
    ["Laboratoire de chimie fine de Randoulébourg", "Randoulébourg, Laboratoire de chimie fine", "Labo. chimie fine Randoulébourg", "LCR - Laboratoire de chimie fine de Randoulébourg", "Laboratoire chimienfine Randoulébourg", "Randoulébourg (Laboratoire de chimie fine)"],
    ["Élisabeth FIFOUMOPARD-email", "Élisabeth FIFOUMOPARD (ADIT)", "FIFOUMOPARD Babeth"],
]
APART = ["Léopold CRÉPUBRORIEUX-email", "Françoise VÉVEPITEAU-email", "Université de chimie fine de Randoulébourg", "Valentin TOUSOUZAC-email", "Véronique TOUSOUZAC-email", "V. Tousouzac"]


def test_writers(spark):
    known = [f"{g} {s}{k}ATIZ-email" for g in ("Frédéric", "Marie-Claude", "Hippolyte", "Léopold", "Françoise", "Valentin", "Véronique", "Élisabeth", "Alexandre", "Alexandra") for k, s in enumerate(("LOR", "BUMU", "KEPA", "SIDU"))]
    values = [v for group in SAME for v in group] + APART + known + [None, "", "Anonyme", "La rédaction", " - "]
    df = spark.createDataFrame([(v, 1) for v in values * 2], "auteur string, value int")
    got = dict(rows(names.writers(df)))
    assert len(got) == len(set(values)) - 5
    for group in SAME:
        assert len({got[v] for v in group}) == 1, [(v, got[v]) for v in group]
    single = [got[v] for v in APART] + [got[g[0]] for g in SAME]
    assert len(set(single)) == len(single)
    assert len({got[v] for v in known}) == len(known)
    pairs = rows(names.pairs(names.writers(df)))
    assert len(pairs) == sum(len(g) * (len(g) - 1) // 2 for g in SAME) and all(a < b for a, b in pairs)
    assert names.writers(df.limit(0)).count() == 0


@pytest.mark.parametrize(("value", "kind"), [("CNRS", "body"), ("INSERM Unité 12", "body"), ("Muséum national d'histoire naturelle", "body"), ("Groupe d'étude des sols vivants", "body"), ("DUPONT", "person"), ("Jean de La Fontaine", "person"), ("panbrobriteau frédéric", "person"), ("J. Li", "person"), ("Anonyme", None), ("...", None), (None, None)])
def test_kinds(value, kind):
    assert names.parse(value)["kind"] == kind


def test_costs():
    pets = {"bob": {"robert"}}
    cost = lambda a, b: names.given_cost(a, b, pets)
    assert cost("bob", "robert") < cost("bobby", "robert") < 0.5 and cost("pierrot", "pierre") and cost("toine", "antoine") and cost("m-c", "marie-claude") and cost("mc", "marie-claude")
    assert cost("paul", "pierre") is None and cost("", "pierre") is None and cost("o", "antoine") is None
    assert names.close("schwartzenberg", "schwarzenburg") and not names.close("martin", "marton" + "s") and not names.close("li", "lu") and names.close("", "")
    assert names.body_cost("institut physique nord", "physique institut nord") == 0 and names.body_cost("institut physique nord", "institut phys nord") and names.body_cost("institut physique nord", "institut phisique nord")
    assert names.body_cost("inserm unite 12", "inserm unite 13") is None and names.body_cost("institut physique nord", "institut chimie nord") is None and names.body_cost("a b", "a b c") is None


def test_groups_dont_chain(spark):
    nodes = spark.createDataFrame([("martin", 9), ("marton", 2), ("barton", 8), ("baron", 1), ("alone", 1), ("x", 1), ("xx", 1), ("xxx", 1)], "id string, w long")
    edges = spark.createDataFrame([("martin", "marton"), ("marton", "barton"), ("barton", "baron"), ("x", "xx"), ("xx", "xxx"), ("x", "x")], "a string, b string")
    assert dict(rows(names._stars(nodes, edges))) == {"martin": "martin", "marton": "martin", "barton": "barton", "baron": "barton", "alone": "alone", "x": "xx", "xx": "xx", "xxx": "xx"}
    assert rows(names._stars(nodes.limit(0), edges.limit(0))) == []


def test_common_surname_and_rare_names(spark):
    common = [f"{g}{k} MARTIN-email" for g in ("Xavi", "Olga", "Ruth", "Knut") for k in ("as", "or", "il", "um", "ek")]
    rare = ["Pierrot SCHWARTZENBERG-email", "Pierre Schwarzenburg", "Robert BAMATIZ", "Bobby Bamatiz-email", "INSERM Unité 12", "Unité 12, INSERM", "INSERM Unité 13", "Muséum national d'histoire naturelle", "Muséum d'histoire naturelle national"]
    known = [f"Pierre {s}ATIZ-email" for s in ("LOR", "BUMU", "KEPA")]
    df = spark.createDataFrame([(v,) for v in common + rare + known], "auteur string")
    got = dict(rows(names.writers(df)))
    for a, b in ((0, 1), (2, 3), (4, 5), (7, 8)):
        assert got[rare[a]] == got[rare[b]], rare[a]
    assert len({got[rare[i]] for i in (0, 2, 4, 6, 7)}) == 5 and len({got[v] for v in common}) == len(common)
    other = dict(rows(names.writers(df, pets=())))
    assert other[rare[2]] != other[rare[3]]


def test_common_words_of_organisations(spark, monkeypatch):
    rng = np.random.default_rng(21)
    towns = ["".join(rng.choice(list("bdfglmnprtv")) + rng.choice(list("aeiou")) for _ in range(6)) for _ in range(300)]
    words = [f"institut robotique {t}" for t in towns] + [f"institut robotiqe {t}" for t in towns[:20]] + [f"institut robot {towns[20]}", f"institut robotique {towns[21]}l", "institut robotique"]
    df = spark.createDataFrame([(w, w) for w in words], "id string, words string")
    found = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if names.body_cost(a, b) is not None}
    assert {frozenset(r) for r in rows(names._same_words(df))} == set(map(frozenset, found)) and len(found) == 22
    monkeypatch.setattr(names, "_matches", lambda a, b, test: F.lit(True))
    assert names._same_words(df).count() < 100  # of 45,000 pairs with two words alike


def test_within_one():
    assert names.within_one("ab", "ba") and names.within_one("abc", "ac") and names.within_one("abc", "abcd") and names.within_one("abc", "axc") and names.within_one("", "a")
    assert not names.within_one("abc", "cba") and not names.within_one("ab", "cd") and not names.within_one("abcd", "ab")


# p5


@pytest.mark.parametrize(
    ("a", "b"),
    [("ｅté", "été".replace("été", "eté")), ("5\xa0mai", "5 mai"), ("﻿m​a\xadi ", "mai"), ("е́t", "ét"), ("ﬁn", "fin"), ("2005⁄03⁄03", "2005／03/03"), ("peut‐on", "peut‑on"), ("АС", "AC"), ("ꓮ", "A"), ("ᎪᏢ", "AP"), ("ⅼ", "l"), ("Ⅿ", "M"), ("օո", "on"), ("ѡ", "w"), ("−3", "–3")],
)
def test_same_look(a, b):
    assert looks.look_of(a) == looks.look_of(b)


@pytest.mark.parametrize(("a", "b"), [("m²", "m2"), ("Mai", "mai"), ("é", "e"), ("a", "a."), ("½", "1/2"), ("a b", "ab"), ("a  b", "a b"), ("…", "..."), ("г", "r"), ("α", "a"), ("ı", "i"), ("–", "-")])
def test_different_look(a, b):
    assert looks.look_of(a) != looks.look_of(b)


def test_look_is_stable_and_folds():
    for s in ("ＡＢｃ é", "е́", "ﬁﬂ ‍", "नमस्‍ते", "🧑‍🔬"):
        assert looks.look_of(looks.look_of(s)) == looks.look_of(s)
    assert "‍" in looks.look_of("नमस्‍ते")
    assert looks.fold_of(looks.look_of("STRASSE  ²")) == looks.fold_of(looks.look_of("straße 2"))


def test_plain_values_need_no_python(spark):
    values = ["été", " \tÉté d'hiver ", "Œuvre « 3 € »", "STRASSE ß", "m²", "e\u0301", "a\u200bb", "", " ", "\xa0x", "İ", "ſ", "ﬁn", "한글", "\u1112\u1161", "नमस्ते", None, "x" * 100_000 + "é"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = {r["i"]: r for r in df.select("i", "v", looks._is_plain(df.v).alias("plain"), looks.look("v").alias("look"), looks.fold("v").alias("fold")).collect()}
    for i, v in enumerate(values):
        assert got[i]["look"] == (None if v is None else looks.look_of(v)) and got[i]["fold"] == (None if v is None else looks.fold_of(looks.look_of(v))), v
    assert [got[i]["plain"] for i in range(7)] == [True, True, True, False, False, False, False]


def test_classes(spark):
    df = spark.createDataFrame([("1", "été"), ("2", "e\u0301té".replace("té", "t\u0301e")), ("3", "été "), ("4", "Été"), ("5", None)], "cle string, value string")
    got = {r["cle"]: (r["classe"], r["chaines"]) for r in looks.classes(df, "cle", "value").collect()}
    assert got["1"] == got["3"] and got["1"][1] == 2 and got["4"][1] == 1 and len({c for c, _ in got.values()}) == 3 and "5" not in got


def test_alike(spark):
    data = [("1", "été"), ("2", "été"), ("3", "été"), ("3", "été"), ("4", "Été"), ("5", None), ("6", " ​"), ("7", ""), (None, "été "), ("8", "été ")]
    df = spark.createDataFrame(data, "raw string, look string")
    assert rows(looks.alike(df, "raw", "look")) == [("1", "2"), ("1", "8"), ("2", "3"), ("2", "8"), ("3", "8")]
    assert looks.alike(df.limit(0), "raw", "look").count() == 0


def test_alike_one_hot_string(spark):
    df = spark.range(3000).selectExpr("cast(id as string) k", "if(id = 7, 'a​', 'a') v")
    assert looks.alike(df, "k", "v").count() == 2999


def test_alike_hot_string_under_a_salt(spark, monkeypatch):
    from lexiloom import session

    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(session.broadcast_if_small, "__defaults__", (0, 0))
    df = spark.range(3000).selectExpr("cast(id as string) k", "case when id < 3 then 'a\u200b' when id % 3 = 0 then 'a' else concat('v', id) end v")
    assert looks.alike(df, "k", "v").count() == 3 * 999


# p6


def test_sizes(spark):
    enc = sizes.encoder(sizes.VOCABULARY)
    text = "Le capteur <|endoftext|> coûte 3 €."
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id int, text string")
    assert rows(df.select("doc_id", sizes.n_tokens("text"))) == [(1, len(enc.encode_ordinary(text))), (2, 0), (3, 0)]
    assert enc.decode(enc.encode_ordinary(text)) == text


def test_two_fit_beats_greedy():
    counts = np.zeros(11, np.int64)
    for s in (6, 3, 2, 2):  # greedily 6 + 3 leaves 1; 6 + 2 + 2 leaves none
        counts[s] += 1
    p = packing.plan(counts)
    first = sorted(int(s) for s, b in zip(p.size, p.bin0, strict=True) for _ in range(int(p.per[list(p.size).index(s)])) if b == 0)
    assert first == [2, 2, 6] and packing.plan(counts, False).bins == p.bins == 2


def test_pairs_left():
    rng = np.random.default_rng(2)
    for _ in range(200):
        counts = np.where(rng.random(40) < 0.3, rng.integers(1, 3, 40), 0)
        counts[0] = 0
        left = packing._Left(counts)
        items = [s for s in range(40) for _ in range(counts[s])]
        for x in range(40):
            assert left.below(x) == max([s for s in items if s <= x], default=-1)
        least, most = sorted(rng.integers(1, 39, 2).tolist())
        sums = [a + b for i, a in enumerate(items) for b in items[i + 1 :] if least < a + b <= most]
        two = left.pair(least, most)
        assert (sum(two) if two else None) == max(sums, default=None)


def test_large_capacity_is_planned():
    import time

    rng = np.random.default_rng(4)
    capacity = 131_072
    sizes_ = np.clip(rng.lognormal(7, 1.5, 1_000_000).astype(int), 1, capacity)
    start = time.perf_counter()
    p = packing.plan(np.bincount(sizes_, minlength=capacity + 1))
    assert time.perf_counter() - start < 30 and sizes_.sum() / (p.bins * capacity) > 0.99


@pytest.mark.parametrize("group", [3, 10**6])
def test_pack(spark, monkeypatch, group):
    monkeypatch.setattr(packing, "RANK_GROUP", group)
    rng = np.random.default_rng(3)
    data = [(i, int(s)) for i, s in enumerate(np.concatenate([rng.integers(1, 60, 300), [0, 0, 100, 101, 350, 200], [33] * 200]))] + [(900, None), (5, 20)]
    df = spark.createDataFrame(data, "doc_id int, size int")
    out = packing.pack(df, 100).toPandas()
    per = out.groupby("bin").tokens.sum()
    assert per.max() <= 100 and out.tokens.sum() == sum(s or 0 for _, s in data) and out.bin.notna().all()
    assert len(out) == len(data) + 1 + 3 + 1
    assert sorted(packing.over_capacity(packing.pack(df, 100)).toPandas().doc_id) == [303, 304, 305]
    big = out[out.doc_id == 304].sort_values("part")
    assert list(big.tokens) == [100, 100, 100, 50] and list(big.start) == [0, 100, 200, 300]
    assert per.sum() / (len(per) * 100) > 0.97
    assert packing.pack(df.limit(0), 100).count() == 0
    assert [r["bin"] for r in packing.pack(df.where("size = 0"), 100).collect()] == [None, None]


# p7


def test_water_fill():
    assert mixing.water_fill(100, [1, 1, 2], [10, 1000, 1000]) == pytest.approx([10, 30, 60])
    assert mixing.water_fill(100, [1, 1], [10, 20]) == [10, 20]
    assert mixing.water_fill(100, [0, 1], [50, 60]) == [0, 60]


def test_shortage_goes_to_siblings_first():
    leaf = lambda s, lang, w, supply: mixing.Leaf(s, ("d", lang), w, 1, supply, 1)
    leaves = [leaf("a", "fr", 0.4, 10), leaf("b", "fr", 0.1, 1000), leaf("c", "en", 0.5, 1000)]
    mixing.assign(leaves, 100)
    assert [x.budget for x in leaves] == pytest.approx([10, 40, 50])


@pytest.mark.parametrize("bucket", [5, 10**5])
def test_mixture(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    docs = [(i, "big", "fr", 10) for i in range(200)] + [(1000 + i, "small", "FR", 10) for i in range(10)] + [(2000, None, None, 500), (2001, "other", "en", 300), (2002, "big", "fr", None)]
    d = spark.createDataFrame(docs, "doc_id int, source string, lang string, size int")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("none", 0.1, 4), (None, 0.5, 1), ("big", 0.6, 1)], "source string, target_share double, max_repeats int")
    shares = mixing.budgets(d, targets)
    got = {r["source"]: r for r in shares.collect()}
    assert got["small"]["short"] and got["none"]["short"] and not got["big"]["short"]
    assert got["small"]["budget"] == 300 and got["big"]["budget"] == 2000 and got["none"]["budget"] == 0
    shares = mixing.budgets(d, targets, 1000)
    mix = mixing.select(d, shares, seed=1).toPandas()
    assert mix[mix.source == "small"].groupby("doc_id").size().max() <= 3
    for r in shares.collect():
        n = mix[mix.source == r["source"]]["size"].sum()
        assert r["budget"] - 10 < n <= r["budget"]
    assert not mix.duplicated(["doc_id", "epoch"]).any()
    reached = mixing.reached(mixing.select(d, shares, seed=1), shares)
    assert abs(sum(r["reached"] for r in reached.collect()) - 1) < 1e-5
    assert mixing.select(d.limit(0), mixing.budgets(d.limit(0), targets)).count() == 0


def test_three_levels_with_shortages(spark):
    docs = [(1, "a", "fr", "web", 10), (2, "b", "fr", "web", 500), (3, "c", "en", "web", 30), (4, "d", "fr", "livres", 100), (5, "e", "de", "livres", 1000), (6, "a", "en", "web", 30), (7, "x", "fr", "web", 330)]
    d = spark.createDataFrame(docs, "doc_id int, source string, lang string, domain string, size int")
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.2, 1), ("c", 0.2, 1), ("d", 0.3, 1), ("e", 0.1, 1)], "source string, target_share double, max_repeats int")
    got = {(r["domain"], r["language"], r["source"]): r["budget"] for r in mixing.budgets(d, targets, 1000).collect()}
    # a has a quarter of its tokens in French, the rest in English
    # web: 600 = fr 250 + en 350; en is full at 60, so French takes 540: a its 10, b 500, and 30 more are for books
    assert got == pytest.approx({("web", "fr", "a"): 10, ("web", "fr", "b"): 500, ("web", "en", "a"): 30, ("web", "en", "c"): 30, ("livres", "fr", "d"): 100, ("livres", "de", "e"): 330})
    shares = mixing.budgets(d, targets, 1000)
    assert {r["source"] for r in shares.where("short").collect()} == {"a", "c", "d"}
    mix = mixing.select(d, shares)
    by = {(r["language"], r["source"]): r["tokens"] for r in mixing.reached(mix, shares, ("domain", "language", "source")).collect()}
    assert by["fr", "b"] == 500 and by["en", "a"] == 30 and by["de", "e"] == 0  # its one text is longer than its budget
    assert mixing.reached(mix, shares).where("source = 'a'").first()["tokens"] == 40


# p8

TEXTS = {
    "Le prix\n\nIl y a 3,5 kg. M. Durand (cf. fig. 3) vient.Il part !": ["Le prix", "Il y a 3,5 kg.", "M. Durand (cf. fig. 3) vient.", "Il part !"],
    "« Quel robot ! Nous en sommes ravis », dit M. X. C'est tout. « Fin. » Bien.": ["« Quel robot ! Nous en sommes ravis », dit M. X. C'est tout.", "« Fin. »", "Bien."],
    "1. Un point\n2. Deux. Trois ;\n- quatre\nSuite sans point": ["1. Un point", "2. Deux. Trois ;", "- quatre", "Suite sans point"],
    "sold in the U.S. The team left at 1 p.m. It rained, e.g. in Mt. Vernon Inc. of Delmora.": ["sold in the U.S.", "The team left at 1 p.m.", "It rained, e.g. in Mt. Vernon Inc. of Delmora."],
    "Am 7. März 2009 kam z. B. Glas, Holz usw. In Bonn nicht.": ["Am 7. März 2009 kam z. B. Glas, Holz usw.", "In Bonn nicht."],
    "「電池は動く。問題はない。」と研究員は述べた。なぜ？値は4.6倍だ！": ["「電池は動く。問題はない。」と研究員は述べた。", "なぜ？", "値は4.6倍だ！"],
    "“卫星成功了！我们很高兴。”工程师这样说。去年降低了7.1%。": ["“卫星成功了！我们很高兴。”工程师这样说。", "去年降低了7.1%。"],
    "डॉ. कमोद ने कहा। यह ठीक है।": ["डॉ. कमोद ने कहा।", "यह ठीक है।"],
    "قال د. سمران إن اللقاح يحمي! لماذا؟ بلغت النسبة 27.8 في المئة.": ["قال د. سمران إن اللقاح يحمي!", "لماذا؟", "بلغت النسبة 27.8 في المئة."],
    "ทำไมจึงเพิ่ม ปัจจุบันวัดได้": ["ทำไมจึงเพิ่ม", "ปัจจุบันวัดได้"],
    "Γιατί μειώνει; Η ομάδα, δηλ. 18 άτομα, μειώνει. «Λειτουργεί;», ρωτούν.": ["Γιατί μειώνει;", "Η ομάδα, δηλ. 18 άτομα, μειώνει.", "«Λειτουργεί;», ρωτούν."],
    "La fibre réduit un très long calculateur de mesure en série dans le\ncentre de Paris. Il reste à optimiser cette base avec la caméra de\nPierre.": ["La fibre réduit un très long calculateur de mesure en série dans le\ncentre de Paris.", "Il reste à optimiser cette base avec la caméra de\nPierre."],
    "« Un. « Deux ! “Trois. Quatre.” » Cinq. Fin. » dit-il. Bien.": ["« Un. « Deux ! “Trois. Quatre.” » Cinq. Fin. » dit-il.", "Bien."],
    "« Jamais fermé. Suite. Fin.\n\n« Un. Deux. » dit-elle.": ["« Jamais fermé.", "Suite.", "Fin.", "« Un. Deux. » dit-elle."],
    "« " + "La fibre réduit le bruit. " * 60 + "» dit-il. Bien.": ["« " + "La fibre réduit le bruit. " * 60 + "» dit-il.", "Bien."],
    "": [], " \n\t ": [], "..": [".."],
}


@pytest.mark.parametrize("text", TEXTS)
def test_sentences(spark, text):
    df = spark.createDataFrame([(1, text, "x")], "doc_id int, text string, _m string")
    u = sentences.sentences(df)
    got = sorted(map(tuple, sentences.restored(df, u).collect()), key=lambda r: r[1])
    assert [r[3] for r in got] == TEXTS[text]


_PROSE = "La fibre de Pierre réduit un très long calculateur de mesure en série. Le projet de Paris et de Lyon mesure une eau claire et stable avec la caméra du Centre Marie Curie de la ville. Il reste à optimiser cette base avec la caméra de Jean Martin et de Louise Petit, selon M. Durand, en 2009."


@pytest.mark.parametrize("width", [30, 45, 60, 72, 100])
def test_wraps_of_any_width(spark, width):
    import textwrap

    text = "Un titre court\n\n" + textwrap.fill(_PROSE, width) + "\n\n" + "Une ligne qui ne fut jamais coupée " * 8 + "finit.\nUn autre titre\nLa suite."
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    got = [r["sentence"].replace("\n", " ") for r in sentences.restored(df, sentences.sentences(df)).orderBy("debut").collect()]
    want = [x.strip() + "." for x in _PROSE.replace("M. Durand", "M@ Durand").split(".")[:-1]]
    assert got == ["Un titre court", *(x.replace("@", ".") for x in want), "Une ligne qui ne fut jamais coupée " * 8 + "finit.", "Un autre titre", "La suite."]


def test_wraps_without_case(spark):
    words = "تقيس المجموعة درجة حرارة الماء في كل مرحلة من مراحل التجربة وتقارن النتائج مع القيم السابقة التي نشرت".split()
    import textwrap

    text = textwrap.fill(" ".join(words * 3) + ".", 60)
    east = "研究员测量水的温度并与以前公布的数值进行比较结果表明新方法更稳定" * 4 + "。"
    east = "\n".join(east[i : i + 40] for i in range(0, len(east), 40))
    df = spark.createDataFrame([(1, text), (2, east), (3, "عنوان قصير\n" + " ".join(words) + ".")], "doc_id int, text string")
    assert {r["doc_id"]: r["count"] for r in sentences.sentences(df).groupBy("doc_id").count().collect()} == {1: 1, 2: 1, 3: 2}


def test_lines_are_split_once(spark):
    docs = spark.createDataFrame([("a", "Un «mot.» et\ndeux. \u00a0\nTrois ؟ fin; 「終。」後\u3000")], "doc_id string, text string")
    plan = sentences.masked(docs, "text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(_m") == 1  # each is a pass over all lines
    assert [r["sentence"] for r in sentences.restored(docs, sentences.sentences(docs)).orderBy("debut").collect()] == ["Un «mot.» et\ndeux.", "Trois ؟ fin; 「終。」後"]


def test_sentence_places(spark):
    long = "Une 😀 phrase. " * 1000
    df = spark.createDataFrame([(1, long), (2, None), (3, "ab. C.")], "doc_id int, text string")
    got = sentences.sentences(df).toPandas()
    one = got[got.doc_id == 1].sort_values("debut")
    assert list(one.debut) == [14 * i for i in range(1000)] and set(one.fin - one.debut) == {13}
    assert 2 not in set(got.doc_id) and len(got[got.doc_id == 3]) == 2


# p1


_WORDS = "banc bois câble canal carte chaîne champ coeur corde couche dune eau encre essai étude feu fibre fil filtre four gaz gel graine huile jour lac laser lent lien lourd mer mesure métal mince miroir moteur mur neige nuage onde papier pile pluie pont prix puits racine robot roche sable sel seuil sol sonde table tige toile vent verre vis zinc".split()


def _site(name, n):
    """Pages of a site, each with the places of its frame lines. Articles share no wording."""
    rng = np.random.default_rng(sum(map(ord, name)))
    say = lambda k: " ".join(rng.choice(_WORDS, k))
    for i in range(n):
        title = f"{say(5)}".capitalize()
        body = [title, f"{say(12)}.".capitalize(), f"{say(9)} {i}. {say(14)}.".capitalize()]
        lists = ["À lire aussi", *(say(5).capitalize() for _ in range(3))]
        ad = ["Publicité", f"Entreprise{name.split()[-1]}{chr(97 + i % 26)}{chr(97 + i // 26)} Optique : -{i} % sur toutes les loupes !"]
        menu = ["Accueil", "Presse | Agenda | Forum", f"© 2004 {name} – Tous droits réservés"]
        yield f"B/{name}-{i}.htm", f"<title>3 mai &gt; Bulletin {name} {i} &gt; {title}</title>", menu[:2] + body[:2] + ad + body[2:] + menu[2:] + lists, {0, 1, 4, 5, 7, 8, 9, 10, 11}


def test_frames(spark):
    pages = [p for s in ("Portail Abagouoz", "Veille Bebemont", "Lettre Cucucourt") for p in _site(s, 30)]
    pages += [("B/404.htm", "<title>3 mai &gt; Bulletin Portail Abagouoz 9 &gt; Page introuvable</title>", ["Accueil", "Page introuvable"], {0, 1})]
    pages += [(f"B/404{s}.htm", f"<title>3 mai &gt; Bulletin {s} 9 &gt; Page introuvable</title>", ["Accueil", "Page introuvable"], {0, 1}) for s in ("Veille Bebemont", "Lettre Cucucourt")]
    pages += [p for p in _site("Bulletins Seuls", 1)]
    pages += [("B/pur.htm", "<title>x</title>", ["Un article seul.", "Deux lignes."], set())]
    data = [(p, h, "\n".join(t), 1) for p, h, t, _ in pages] + [(pages[0][0], pages[0][1], "\n".join(pages[0][2]), 2), ("B/nul.htm", "", None, 1), (None, "", "x", 1), ("B/vide.htm", None, "", 1)]
    df = spark.createDataFrame(data, "path string, html string, texte string, n int")
    framed = boilerplate.frame(df)
    got: dict[str, set[int]] = {}
    every = framed.collect()
    for r in every:
        got.setdefault(r["path"], set())
        if r["frame"]:
            got[r["path"]].add(r["line_no"])
    for path, _, _, want in pages:
        assert got[path] == want, path
    assert len(every) == sum(len(t) for _, _, t, _ in pages) + 1
    text = dict(map(tuple, boilerplate.articles(df, framed).collect()))
    assert text["B/pur.htm"] == "Un article seul.\nDeux lignes." and text["B/404.htm"] == "" and len(text) == len(pages) + 1
    assert boilerplate.frame(df.limit(0)).count() == 0


def _framed(spark, pages):
    """The frame lines of each path. pages: (path, host, title, lines)."""
    data = [(p, f"<title>3 mai &gt; Bulletin {s} {i} &gt; {t}</title>", "\n".join(ls)) for i, (p, s, t, ls) in enumerate(pages)]
    got: dict[str, set[str]] = {p: set() for p, *_ in pages}
    at = {p: ls for p, _, _, ls in pages}
    for r in boilerplate.frame(spark.createDataFrame(data, "path string, html string, texte string")).where("frame").collect():
        got[r["path"]].add(at[r["path"]][r["line_no"]])
    return got


def _body(rng):
    say = lambda k: " ".join(rng.choice(_WORDS, k)).capitalize()
    return say(5), [f"{say(12)}.", f"{say(14)}."]


def test_wrapper_alignment():
    w = boilerplate.Wrapper()
    page = lambda ks: w.add(ks, [[1, 1, 1, 0, 0, 0, 0]] * len(ks))
    for ks in ([1, 2, 3, 4], [1, 3, 4], [1, 5, 4], [4, 1]):
        page(ks)
    at = dict(zip(w.keys, [s[0] for s in w.stats], strict=False))
    assert w.keys.count(1) == 1 or w.keys.count(4) == 2  # the last page has an order of its own
    for ks in ([1, 2, 3, 4], [1, 5, 4], [4, 1]):
        assert -1 not in w.align(ks)
    assert w.align([9]) == [-1] and w.align([]) == [] and at[5] == 1
    other = boilerplate.Wrapper()
    other.add([1, 6, 4], [[7, 7, 7, 0, 0, 0, 3]] * 3)
    w.add(other.keys, other.stats)
    assert -1 not in w.align([1, 6, 4]) and sum(s[0] for k, s in zip(w.keys, w.stats, strict=True) if k == 6) == 7


def test_lists_end_by_structure():
    f = lambda s: [c == "F" for c in s]
    item = lambda s: [c in "ieT" for c in s]
    run = lambda s, most, title="", ranks=None: boilerplate.entries(f(s), f(s), [most if c == "F" else None for c in s], [c == "T" for c in s], item(s), ranks or [0] * len(s))
    assert run("FeeeeeeeeeeF", 2) == set(range(1, 11))  # ends at an item: all
    assert run("TpFeee", 2) == {3, 4, 5}  # ends with the text
    assert run("TpFeeeep", 3) == {3, 4, 5}  # ends at a paragraph: the longest known
    assert run("FeeTp", 9) == {1, 2}  # the page's title is no entry
    assert run("Feep", 9) == {1}  # no title is known: the line before the paragraph is it
    assert run("Fiiii", 0, ranks=[0, 1, 2, 3, 0]) == {1, 2, 3}


def test_subheads_need_evidence_on_the_host(spark):
    rng = np.random.default_rng(11)
    pages = []
    for h, n, every in (("Portail Abagouoz", 6, 1), ("Veille Bebemont", 6, 1), ("Lettre Cucucourt", 300, 100)):
        for i in range(n):
            title, body = _body(rng)
            subhead = ["Contexte scientifique"] if i % every == 0 else []
            pages.append((f"B/{h}{i}.htm", h, title, ["Accueil", title, body[0], *subhead, body[1], "Haut de page"]))
    got = _framed(spark, pages)
    assert all(not any("Contexte" in x for x in got[p]) for p, h, _, _ in pages if h == "Lettre Cucucourt")
    assert all({"Accueil", "Haut de page"} <= got[p] for p, *_ in pages)


def test_rare_layout_of_a_large_host(spark):
    rng = np.random.default_rng(12)
    pages = []
    for i in range(200):
        title, body = _body(rng)
        rare = ["Espace des lecteurs", "Petites annonces", "Nos archives sonores"] if i % 40 == 0 else ["Accueil"]
        pages.append((f"B/{i}.htm", HOSTS[0], title, [*rare, title, *body]))
    got = _framed(spark, pages)
    assert all(got[p] == set(ls[:-3]) for p, _, _, ls in pages)


def test_article_given_again_is_no_frame(spark):
    rng = np.random.default_rng(13)
    again = _body(rng)
    pages = []
    for i in range(40):
        title, body = again if i % 4 == 0 else _body(rng)
        pages.append((f"B/{i}.htm", HOSTS[0], title, ["Accueil", title, *body]))
    assert all(x == {"Accueil"} for x in _framed(spark, pages).values())


def test_last_load_counts(spark):
    rng = np.random.default_rng(14)
    rows = []
    for i in range(12):
        title, body = _body(rng)
        rows.append((f"B/{i}.htm", f"<title>3 mai &gt; Bulletin {HOSTS[0]} {i} &gt; {title}</title>", "\n".join(["Accueil", title, *body]), i))
    rows += [("B/0.htm", rows[0][1], "Accueil\nUn.", 100), ("B/0.htm", rows[0][1], "Un.\nAccueil\nDeux.", 99), ("B/0.htm", rows[0][1], None, 101)]
    df = spark.createDataFrame(rows, "path string, html string, texte string, loaded_at int")
    got = sorted((r["line_no"], r["frame"]) for r in boilerplate.frame(df).collect() if r["path"] == "B/0.htm")
    assert got == [(0, True), (1, False)]


def test_hot_lines_without_broadcasts(spark, monkeypatch):
    from lexiloom import session

    rng = np.random.default_rng(15)
    pages = []
    for i in range(60):
        title, body = _body(rng)
        pages.append((f"B/{i}.htm", HOSTS[i % 3], title, ["Accueil", title, body[0], *["Publicité"] * 12, body[1]]))  # a third of all lines
    monkeypatch.setattr(boilerplate, "CHUNK_PAGES", 7)
    monkeypatch.setattr(boilerplate, "FAN_IN", 2)
    monkeypatch.setattr(session.broadcast_if_small, "__defaults__", (0, 0))
    monkeypatch.setattr(session.hot_keys, "__defaults__", (50,))
    assert all(x == {"Accueil", "Publicité"} for x in _framed(spark, pages).values())


def test_parts_are_cut_once(spark):
    pages = spark.createDataFrame([("B/1.htm", "<title>3 mai &gt; Bulletin X 1 &gt; Un titre</title>", "Accueil | 3 mai 2011 | X\nUn titre\nsans signe")], "path string, html string, texte string")
    read = boilerplate.lines(pages)
    assert read._jdf.queryExecution().optimizedPlan().toString().count("[|·>•") == 1  # a pass over all lines with signs
    assert [r["parts"] for r in read.orderBy("n").collect()] == [["accueil", "@"], None, None]


def test_texts_and_lines_are_split_once(spark, monkeypatch):
    pages = spark.createDataFrame([("B/1.htm", "<title>3 mai &gt; Bulletin X 1 &gt; Un titre</title>", " \t\n\x0b \u2028\n\u0085a;\n\t12. a\n \r- a\n-a\na - b:\n\n \u0663 a")], "path string, html string, texte string")
    read = boilerplate.lines(pages)
    assert read._jdf.queryExecution().optimizedPlan().toString().count("split(texte") == 1  # not again for a filter of empty arrays
    got = [(r["bare"], r["item"], r["rank"]) for r in read.orderBy("n").collect()]
    assert got == [(True, True, None), (True, True, None), (False, False, None), (True, True, 12), (True, False, None), (True, True, None), (False, False, None), (True, True, None), (True, True, None)]
    plans, cut = [], boilerplate.cut
    monkeypatch.setattr(boilerplate, "cut", lambda d: plans.append(d._jdf.queryExecution().optimizedPlan().toString()) or cut(d))
    wrapper = [(1, "a b c d e f g"), (2, "a b c")]
    rest = [(3, "a b c d e f g h i j k l m"), (4, "a b c d e f g h i j k l m n"), (5, "a b c d"), (6, "a x c d y f g"), (7, "a b c")]
    found = boilerplate._slots(*(spark.createDataFrame(x, "k long, t string") for x in (rest, wrapper)))
    assert sorted((r["k"], r["key"]) for r in found.collect()) == [(3, 1), (5, 1), (6, 1)]
    assert plans[0].count("split(") == 1


def test_menus_are_groups_but_not_single_entries(spark):
    rng = np.random.default_rng(17)
    rows = []
    for i in range(12):
        title, body = _body(rng)
        ls = ["- Accueil", title, *body, "Presse | Agenda", "Presse", "Agenda"]
        rows.append((f"B/{i}.htm", f"<title>3 mai &gt; Bulletin {HOSTS[0]} {i} &gt; {title}</title>", "\n".join(ls)))
    got = boilerplate.expressions(spark.createDataFrame(rows, "path string, html string, texte string")).orderBy("pos").collect()
    assert [(r["template"], r["kind"]) for r in got] == [("accueil", "fixed"), ("presse agenda", "group"), ("presse", "fixed"), ("agenda", "fixed")]


def test_expressions(spark):
    rng = np.random.default_rng(16)
    rows = []
    for i in range(20):
        title, body = _body(rng)
        ls = ["Accueil", title, body[0], *(["Publicité"] if i % 2 else []), body[1], f"Offert ici par {_odd(i)} ;", "Presse | Agenda | Forum", "Presse", "Agenda", "Forum"]
        rows.append((f"B/{i}.htm", f"<title>3 mai &gt; Bulletin {HOSTS[0]} {i} &gt; {title}</title>", "\n".join(ls)))
    got = boilerplate.expressions(spark.createDataFrame(rows, "path string, html string, texte string")).orderBy("pos").collect()
    assert [r["kind"] for r in got] == ["fixed", "optional", "slot", "group", "fixed", "fixed", "fixed"] and got[1]["pages"] == 10


HOSTS = ("Portail Abagouoz", "Veille Bebemont", "Lettre Cucucourt")
_odd = lambda i, j=0: "Xa" + chr(97 + i % 26) + chr(97 + i // 26) + chr(97 + j)


def test_one_word_slots(spark):
    slotted = ["Cet article vous est offert par {}.", "Offert ici par {} ;", "- Espace offert par {} ce mois", "Bonjour cher {} bienvenue", " ".join(["Ce service vous est proposé sans frais par {} pour"] + ["toute demande voyez notre bureau central"] * 4)]
    rng = np.random.default_rng(5)
    pages, want = [], {}
    for i in range(60):
        title, body = _body(rng)
        frame = [x.format(_odd(i, j)) for j, x in enumerate(slotted)]
        pages.append((f"B/{i}.htm", HOSTS[i % 3], title, [title, body[0], *frame, body[1]]))
        want[f"B/{i}.htm"] = set(frame)
    assert _framed(spark, pages) == want


@pytest.mark.parametrize("size", range(60))
def test_common_words(size):
    rng = np.random.default_rng(size)
    a, b = (list(rng.choice(list("abcdef"), n)) for n in (size, int(rng.integers(0, 60))))
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    assert boilerplate.common_words(a, b) == row[-1]


def test_slots_are_all_compared(spark):
    rng = np.random.default_rng(1)
    made = [" ".join(rng.choice(list("abcdefgh"), int(rng.integers(4, 15)))) for _ in range(150)]
    known = ["bonjour x se deconnecter", "a b x c d y e", "a b x c d y e f z g", *made[:50]]
    lines = ["bonjour u se deconnecter", "a b u c d v e", "a b u c d v e f w g", *made[50:]]
    table = lambda ts: spark.createDataFrame([(hash(t), t) for t in set(ts)], "k long, t string")
    agree = lambda u, v: 2 * boilerplate.common_words(u, v) >= 0.7 * (len(u) + len(v)) - 1e-9
    got = {r["k"] for r in boilerplate._slots(table(lines), table(known)).collect()}
    assert got == {hash(t) for t in lines if any(agree(t.split(), w.split()) for w in known)}


def test_long_lines(spark):
    rng = np.random.default_rng(7)
    legal = "Ce site dépose des traceurs sur votre appareil afin de mesurer son audience et de retenir vos choix de lecture ; " * 4
    legal += "vous pouvez les refuser - voir notre charte revue par {} le 3 {} 2005, ou écrire au service des lecteurs du siège."
    entries = [f"{w.capitalize()} {v}" for w in _WORDS[:30] for v in ("actuel", "passé")]
    pages, want = [], {}
    for i in range(60):
        title, body = _body(rng)
        notice = legal.format(_odd(i), ("mai", "juin", "juillet", "mars")[i % 4])
        sitemap = " | ".join(rng.permutation(entries)[:50])
        menu = " ".join(rng.permutation(entries)[:40])
        assert min(map(len, (notice, sitemap, menu))) > 400
        pages.append((f"B/{i}.htm", HOSTS[i % 3], title, [*entries[2 * (i % 30) : 2 * (i % 30) + 2], title, body[0], notice, sitemap, menu, body[1]]))
        want[f"B/{i}.htm"] = {notice, sitemap, menu}
    got = _framed(spark, pages)
    assert {p: w - got[p] for p, w in want.items() if w - got[p]} == {}
    assert all(not {t, b[-1]} & got[p] for p, _, t, b in pages)

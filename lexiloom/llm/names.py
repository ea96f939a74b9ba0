"""Spellings of one person's or organisation's name, linked.

A symmetric-delete index (each token with its deletions of one letter, in long tokens of two) finds tokens within a small edit distance;
the tokens of two names are then matched by the cheapest assignment, in which an initial, an abbreviation or a pet name may stand for a
given name, and an abbreviation for a word of an organisation's.

Persons whose given name is well established in the data are anchors. Any other spelling joins the writer that it fits best, and none if
it fits several equally well: `V. Martin` beside a Valentin and a Véronique Martin stays alone. What fits no anchor is compared with its like.

Close forms are grouped around the most frequent of them, not chained: every member of a group is close to its head.
"""

from __future__ import annotations

import re
import unicodedata as ud
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.looks import look_of
from lexiloom.session import cut, flagged, rows_of

# Words of French author lines.
NO_NAME = frozenset("anonyme anonymous inconnu auteur-inconnu la-redaction redaction redacteur collectif n-a sans-nom".split())
TITLES = frozenset("dr docteur pr prof professeur mr mme mlle monsieur madame mademoiselle ing".split())
SMALL = frozenset("de du des la le les d l et en".split())
BODIES = {
    "laboratoire": "labo lab", "institut": "inst", "universite": "univ", "observatoire": "obs", "agence": "ag", "centre": "ctr cent",
    "ecole": "ec", "departement": "dept dep", "faculte": "fac", "societe": "soc ste", "association": "assoc", "ministere": "min",
    "fondation": "fond", "academie": "acad", "commissariat": "commis", "conseil": "cons", "direction": "dir", "service": "serv",
}
PET_NAMES = {
    "alexandra": "sandra", "alexandre": "alexis", "anne": "annie nanou", "beatrice": "bea", "benedicte": "bene", "catherine": "cathy cath", "charlotte": "lotte",
    "christine": "cricri", "christophe": "tophe kiki", "daniel": "dany dani", "dominique": "domi", "elisabeth": "babeth zabeth lisa elise", "emmanuel": "manu",
    "francoise": "fanfan", "francois": "fanfan", "frederic": "fredo", "gabrielle": "gaby", "genevieve": "ginette viva", "gerard": "gege", "gregoire": "greg",
    "helene": "lena nelly", "henri": "riton", "hippolyte": "polo", "isabelle": "zaza", "jacqueline": "jacquie", "jacques": "jacquot", "joseph": "jojo",
    "josephine": "josy jo fifine", "laurent": "lolo", "leopold": "leo", "louis": "loulou", "madeleine": "mado", "marguerite": "margot", "maximilien": "max",
    "michel": "mimi", "monique": "momo", "nathalie": "nath", "nicolas": "nico colas", "patrick": "pat", "paul": "polo", "penelope": "penny", "philippe": "fifi", "robert": "bob",
    "romane": "romy", "sebastien": "bastien", "simone": "momone", "stephanie": "fanny", "suzanne": "suzy", "theodore": "theo", "therese": "tess", "thierry": "titi",
    "valentin": "tintin", "veronique": "vero", "victor": "totor", "william": "bill willy", "yolande": "yoyo",
}
#: Endings by which French and English make pet names of the beginning of a name.
DIMINUTIVES = "ot ette et on ou ounet inou y ie by ny".split()
_BODY = {a: k for k, v in BODIES.items() for a in [k, *v.split()]}
#: (pet name, name) pairs, the default of every parameter `pets`.
PETS = tuple(sorted((s, full) for full, short in PET_NAMES.items() for s in short.split()))
_MAIL = re.compile(r"\s*[-–—,;]?\s*\b(?:e-?mail|mail|courriel|mel)\s*$", re.I)
_AFFILIATION = re.compile(r"\s*[(\[]\s*[A-ZÀ-Þ0-9.&/ -]{2,12}\s*[)\]]\s*$")


def folded(s: str) -> str:
    return "".join(c for c in ud.normalize("NFKD", s.casefold()) if not ud.combining(c))


def letters(s: str) -> str:
    return "".join(c for c in folded(s) if c.isalnum())


def within_one(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or swap of neighbours at most leads from a to b."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def edits(n: int) -> int:
    """Edits allowed in a word of n letters: none in the shortest, where another letter is another word; two in long ones."""
    return 0 if n < 4 else 1 if n < 12 else 2


def close(a: str, b: str) -> bool:
    """Whether a and b are within the edits that the shorter one allows: insertions, deletions, substitutions, swaps of neighbours."""
    k = edits(min(len(a), len(b)))
    if k < 2:
        return a == b or (k == 1 and within_one(a, b))
    if abs(len(a) - len(b)) > k:
        return False
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, last[j - 2] + 1)
            row.append(d)
        if min(row) > k:
            return False
    return row[-1] <= k


def _body(token: str) -> str | None:
    """The kind of organisation that a token names, with one typing error allowed in long words."""
    t = letters(token)
    if t in _BODY:
        return _BODY[t]
    return next((k for k in BODIES if len(k) >= 6 and len(t) >= 6 and within_one(t, k)), None)


def _organisation(s: str) -> str | None:
    """An organisation in one form, without small words; NULL if s names none.

    Where a word names a known kind, that comes first, then the other words as they follow it, then those before it without an acronym
    of its own. Without one the words stay in order: what holds a number, several words in lower case beside a capital, or nothing but
    capitals that can't be spoken names an organisation too.
    """
    tokens = [t for t in re.split(r"[\s,;()\[\]]+|\s-\s|(?<=\s)-|-(?=\s)|(?<=d)['’]|(?<=l)['’]", s) if letters(t)]
    at = next((i for i, t in enumerate(tokens) if _body(t)), None)
    if at is None or len(tokens) < 2:
        plain = [t for t in tokens if letters(t) not in SMALL]
        low = [t for t in plain if t.islower() and len(t) > 2]
        capital = any(t[0].isupper() for t in tokens)
        number = len(plain) > 1 and any(t.isdigit() for t in plain)
        unspoken = len(tokens) == 1 and len(s) > 2 and s.isupper() and s.isalpha() and not set(letters(s)) & set("aeiouy")
        return " ".join(letters(t) for t in plain) if capital and (number or len(low) > 1 or unspoken) else None
    # an abbreviated kind needs its case: "Ag.", not the initials of a person
    kind = _body(tokens[at])
    if letters(tokens[at]) != kind and len(letters(tokens[at])) <= 3 and len(tokens) < 3:
        return None
    before = [t for t in tokens[:at] if not (t.isupper() and len(letters(t)) <= 6 and not tokens[at].isupper())]
    rest = [letters(t) for t in tokens[at + 1 :] + before]
    return " ".join([kind, *(t for t in rest if t and t not in SMALL)])


def word_cost(a: str, b: str) -> float | None:
    """How far one word of an organisation is from another: 0, 0.3 for an abbreviation, 1 for a typing error; NULL if they are two words. Numbers are never misspelt."""
    if a == b:
        return 0.0
    if a.isdigit() or b.isdigit():
        return None
    short, long = sorted((a, b), key=len)
    if len(short) >= 2 and long.startswith(short):
        return 0.3
    return 1.0 if close(a, b) else None


def body_cost(a: str, b: str) -> float | None:
    """The cheapest assignment of the words of two organisations of as many words, in any order. NULL if there is none, or if over one word is misspelt or no longer word agrees."""
    x, y = a.split(), b.split()
    if len(x) != len(y) or len(x) < 2:
        return None
    for w in set(x) & set(y):  # words that agree are matched first: no assignment is cheaper
        for _ in range(min(x.count(w), y.count(w))):
            x.remove(w)
            y.remove(w)
    if len(x) > 6 or not any(len(w) >= 4 for w in set(a.split()) & set(b.split())):
        return None  # seven words that differ are another name

    @lru_cache(None)
    def best(i: int, used: int) -> float:
        if i == len(x):
            return 0.0
        costs = [c + best(i + 1, used | 1 << j) for j in range(len(y)) if not used >> j & 1 and (c := word_cost(x[i], y[j])) is not None]
        return min(costs, default=float("inf"))

    total = best(0, 0)
    return total if total < 2 else None


def _person(s: str) -> tuple[list[tuple[str, str, bool]], bool]:
    """Readings (family name, given name, abbreviated), and whether the writing marks the family name. The given name keeps its hyphens."""
    comma = re.fullmatch(r"\s*([^,]+),\s*([^,]+)", s)
    tokens = s.replace(",", " ").split()
    while len(tokens) > 2 and letters(tokens[0]) in TITLES | {"m"} and (letters(tokens[0]) in TITLES or len(tokens[0]) <= 2):
        tokens = tokens[1:]
    if len(tokens) == 2 and letters(tokens[0]) in TITLES:
        tokens = tokens[1:]
    dotted = lambda t: t.endswith(".") or "." in t or len(letters(t)) == 1
    if len(tokens) > 2:  # an initial between or after full names says nothing that they don't
        full = [t for t in tokens if not (dotted(t) and len(letters(t)) <= 2)]
        if len(full) >= 2:
            tokens = full
    given = lambda ts: "-".join(filter(None, (letters(p) for t in ts for p in re.split(r"[-.‐‑]+", t))))
    family = lambda ts: "".join(map(letters, ts))
    if not tokens or not family(tokens):
        return [], False
    if comma and family(comma[1].split()):
        g = comma[2].split()
        return [(family(comma[1].split()), given(g), any(map(dotted, g)))], True
    upper = [t for t in tokens if t.isupper() and len(letters(t)) > 1 and not dotted(t)]
    other = [t for t in tokens if t not in upper]
    if upper and other:
        return [(family(upper), given(other), any(map(dotted, other)))], True
    if len(tokens) == 1:
        return [(family(tokens), "", False)], False
    short = [t for t in tokens if dotted(t)]
    long = [t for t in tokens if not dotted(t)]
    if short and long:
        return [(family(long), given(short), True)], True
    ends = [(family(tokens[1:]), given(tokens[:1]), dotted(tokens[0])), (family(tokens[:-1]), given(tokens[-1:]), dotted(tokens[-1]))]
    return ends, False


def parse(value: str | None) -> dict:
    """kind is NULL for what names nobody."""
    out: dict = {"kind": None, "body": None, "readings": [], "marked": False}
    s = look_of(value or "")
    s = _MAIL.sub("", s).strip(" -–—,;")
    if not letters(s) or "-".join(filter(None, re.split(r"\W+", folded(s)))) in NO_NAME:
        return out
    if body := _organisation(s):
        return out | {"kind": "body", "body": body}
    s = _AFFILIATION.sub("", s).strip(" -–—,;")
    readings, marked = _person(s)
    if readings:
        out |= {"kind": "person", "marked": marked, "readings": [{"family": f, "given": g, "short": d} for f, g, d in readings]}
    return out


def stems_of(x: str) -> list[str]:
    """A given name without the ending of a pet name, if it may have one: at least three letters stay."""
    return [x[: -len(e)] for e in DIMINUTIVES if x.endswith(e) and len(x) - len(e) >= 3]


def given_cost(a: str, b: str, pets: dict[str, set[str]]) -> float | None:
    """How far given name a (perhaps short) is from the full b; NULL if it can't stand for it. pets: names by pet name."""
    x, y = a.replace("-", ""), b.replace("-", "")
    if x == y:
        return 0.0
    if not x or not y:
        return None
    if y in pets.get(x, ()):
        return 0.1
    parts, full = a.split("-"), b.split("-")
    if len(parts) == len(full) and all(f.startswith(p) for p, f in zip(parts, full, strict=True)):
        return 0.2
    if len(parts) == 1 and (y.startswith(x) or (len(full) > 1 and x == "".join(f[0] for f in full))):
        return 0.3
    if any(y in pets.get(s, ()) or y.startswith(s) for s in stems_of(x)) or (len(x) >= 4 and y.endswith(x)):
        return 0.4
    if close(x, y) or (len(x) == 3 and within_one(x, y)):
        return 0.5
    return None


def _deletes(x: Column) -> Column:
    """A string and what is left of it without as many letters as `edits` allows."""
    one = lambda v: F.transform(F.sequence(F.lit(1), F.greatest(F.length(v), F.lit(1))), lambda i: F.concat(F.substring(v, F.lit(1), i - 1), F.substring(v, i + 1, F.length(v))))
    cuts = F.array_append(one(x), x)
    two = F.flatten(F.transform(cuts, lambda v: F.array_append(one(v), v)))
    return F.when(F.length(x) < 4, F.array(x)).when(F.length(x) < 12, F.array_distinct(cuts)).otherwise(F.array_distinct(two))


def _matches(a: str, b: str, test) -> Column:
    @F.pandas_udf("boolean")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([test(v, w) for v, w in zip(x, y, strict=True)], dtype="bool")

    return run(a, b)


def _close(a: str, b: str) -> Column:
    """`close` of two columns: by the built-in distance, but for pairs that only swaps of neighbours may bring together."""

    @F.pandas_udf("boolean")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([v is not None and close(v, w) for v, w in zip(x, y, strict=True)], dtype="bool")

    n = F.least(F.length(a), F.length(b))
    k = F.when(n < 4, 0).when(n < 12, 1).otherwise(2)
    d = F.levenshtein(a, b)
    swaps = (d > k) & (d <= 2 * k)
    return (d <= k) | run(F.when(swaps, F.col(a)), F.col(b))


def _near(nodes: DataFrame, text: str, *equal: str) -> DataFrame:
    """(a, b): ids of nodes whose texts are close and whose `equal` columns are the same. nodes: (id, text, *equal), ids unique."""
    # a long text has hundreds of keys: only their hashes travel
    keyed = nodes.select("id", F.explode(F.transform(_deletes(F.col(text)), lambda v: F.xxhash64(v, *equal))).alias("_k"))
    met = keyed.select("_k", F.col("id").alias("a")).join(keyed.select("_k", F.col("id").alias("b")).hint("merge"), "_k").where("a < b").select("a", "b").distinct()
    of = lambda c: nodes.select(F.col("id").alias(c), F.struct(*equal).alias(f"_e{c}") if equal else F.lit(0).alias(f"_e{c}"), F.col(text).alias(f"_t{c}"))
    return met.join(of("a"), "a").join(of("b"), "b").where("_ea = _eb").where(_close("_ta", "_tb")).select("a", "b")


def _parted(edges: DataFrame) -> DataFrame:
    """Those edges of close persons, ids `part|part`, whose other parts are close by themselves where one is the same: a long family name allows a short given one no more edits."""
    a, b = F.split("a", r"\|"), F.split("b", r"\|")
    rest = edges.withColumns({"_same": F.size(F.array_intersect(a, b)), "_ra": F.array_join(F.array_except(a, b), ""), "_rb": F.array_join(F.array_except(b, a), "")})
    return rest.where((F.col("_same") == 0) | (F.col("_ra") == "") | (F.col("_rb") == "") | _close("_ra", "_rb")).select("a", "b")


def _same_words(bodies: DataFrame) -> DataFrame:
    """(a, b): ids of organisations whose words match one by one. bodies: (id, words).

    Distinct words are matched with each other once, within the edits or as an abbreviation. As all words of two such names match, one word
    of a name finds them all: the one whose matches stand in the fewest names. So a word that many names have, rightly or misspelt, brings
    none together while they have a rarer one.
    """
    listed = F.split("words", " ")
    toks = cut(bodies.select("id", "words", F.size(listed).alias("m"), F.explode(F.array_distinct(listed)).alias("t")).where("m > 1"))
    words = cut(toks.groupBy("t").agg(F.count(F.lit(1)).alias("n")))
    begins = F.transform(F.sequence(F.lit(2), F.greatest(F.length("t"), F.lit(2))), lambda i: F.concat(F.lit("<"), F.substring(F.col("t"), F.lit(1), i)))
    asked = words.select(F.col("t").alias("x"), F.explode(F.array_append(_deletes(F.col("t")), F.concat(F.lit("<"), "t"))).alias("k"))
    held = words.select(F.col("t").alias("y"), F.explode(F.array_union(_deletes(F.col("t")), begins)).alias("k"))
    met = asked.join(held.hint("merge"), "k").select("x", "y").distinct()
    number = F.rlike("x", F.lit("^[0-9]+$")) | F.rlike("y", F.lit("^[0-9]+$"))
    met = met.where((F.col("x") == F.col("y")) | ~number & ((F.length("x") >= 2) & F.startswith("y", "x") | _close("x", "y")))
    met = cut(met.unionByName(met.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    reach = met.join(words.withColumnRenamed("t", "y"), "y").groupBy(F.col("x").alias("t")).agg(F.sum("n").alias("n"))
    one = cut(flagged(toks, cut(reach), ["t"]).groupBy("id", "words", "m").agg(F.min(F.struct("n", "t"))["t"].alias("x")))
    met = cut(met.join(one.select("x").distinct(), "x", "left_semi"))
    # other words travel nowhere
    found = flagged(toks, cut(met.select(F.col("y").alias("t"), F.lit(True).alias("_found")).distinct()), ["t"]).where("_found")
    left = one.select(F.struct("id", "words").alias("a"), "m", "x").join(met.hint("merge"), "x").select("a", "m", F.col("y").alias("t"))
    pairs = left.join(found.select(F.struct("id", "words").alias("b"), "m", "t").hint("merge"), ["m", "t"]).where("a.id <> b.id")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.words").alias("wa"), F.col("b.words").alias("wb"))
    # words that agree or abbreviate each other begin alike, so all but a misspelt one do
    begins_of = lambda c: F.array_distinct(F.transform(F.split(c, " "), lambda v: F.left(v, F.lit(1))))
    pairs = pairs.where(F.size(F.array_except(begins_of("wa"), begins_of("wb"))) <= 1)
    return pairs.where(_matches("wa", "wb", lambda v, w: body_cost(v, w) is not None)).select("a", "b")


def _stars(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of all nodes: groups around a head, the heaviest of its neighbours (of equal ones that with the most); component is the head's id. nodes: (id, w); edges: (a, b).

    Round by round, every node heavier than all its free neighbours takes those (one with several such heads goes to the heaviest) and
    all of them leave. So a chain of close forms is cut where its frequent ones are, and no group is wider than two steps.
    """
    by = lambda c: F.struct(F.col("w").alias("w"), F.col("n").alias("n"), F.col(c).alias("id"))
    one = edges.where("a <> b").distinct()
    both = cut(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    w = cut(nodes.select("id", "w").join(both.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n")), "id"))
    free = cut(both.join(w.withColumnRenamed("id", "b"), "b").select("a", by("b").alias("b")).join(w.withColumnRenamed("id", "a"), "a").select(by("a").alias("a"), "b"))
    taken: list[DataFrame] = []
    while rows_of(free):
        heads = cut(free.groupBy("a").agg(F.max("b").alias("b")).where("a > b").select(F.col("a").alias("head")))
        caught = cut(free.join(heads, free["b"] == heads["head"]).groupBy("a").agg(F.max("head").alias("head")))
        taken.append(caught.select(F.col("a.id").alias("id"), F.col("head.id").alias("component")))
        gone = cut(heads.select(F.col("head").alias("x")).unionByName(caught.select(F.col("a").alias("x"))))
        free = cut(free.join(gone, free["a"] == gone["x"], "left_anti").join(gone, free["b"] == gone["x"], "left_anti"))
    out = nodes.select("id")
    if not taken:
        return out.withColumn("component", F.col("id"))
    every = taken[0]
    for t in taken[1:]:
        every = every.unionByName(t)
    return out.join(every, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _given_costs(pets: dict[str, set[str]]) -> Column:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([given_cost(v, w, pets) for v, w in zip(a, b, strict=True)], dtype="float64").astype(object).where(lambda v: v.notna(), None)

    return run("x", "y")


def _scored(left: DataFrame, right: DataFrame, cost: Column) -> DataFrame:
    """(x, y, cost) of the words x of left and y of right that share a key and stand at a cost. Both: (word, keys), words unique; cost of x and y, NULL if they don't match."""
    x = left.select(F.col("word").alias("x"), F.explode(F.array_distinct("keys")).alias("k"))
    y = right.select(F.col("word").alias("y"), F.explode(F.array_distinct("keys")).alias("k"))
    # the sides are many times as large as what they are made from, so they aren't broadcast by their estimated size
    met = x.join(y.hint("merge"), "k").select("x", "y").distinct()
    return met.withColumn("cost", cost).where("cost is not null")


def _attach(others: DataFrame, anchors: DataFrame, pets: tuple[tuple[str, str], ...], loose: bool = True) -> DataFrame:
    """(value, component, cost): of every value the components it fits, each at its best cost. others: (value, family, given); anchors: (family, given, component).

    Distinct family names are matched with each other, and distinct given names, once each, over symmetric-delete indexes; the given
    ones also by what they may stand for: beginnings, ends, initials, the names of a pet name. Values then meet anchors on both names in
    full, so a family name that many have brings none together by itself. A value has a reading for each way to assign its parts, and the cheapest counts.
    loose: whether beginnings, ends and initials count too.
    """
    table: dict[str, set[str]] = {}
    for short, full in pets:
        table.setdefault(short, set()).add(full)
    names = F.create_map(*(F.lit(x) for s, full in sorted(table.items()) for x in (s, "|".join(sorted(full))))) if table else F.lit(None).cast("map<string,string>")
    plain = F.replace("word", F.lit("-"), F.lit(""))
    key = lambda kind, xs: F.transform(xs, lambda x: F.concat(F.lit(kind), x))
    stems = F.filter(F.array(*(F.when(F.endswith(plain, F.lit(e)) & (F.length(plain) - len(e) >= 3), F.substring(plain, F.lit(1), F.length(plain) - len(e))).otherwise("") for e in DIMINUTIVES)), lambda v: v != "")
    full = F.flatten(F.transform(F.array_append(stems, plain), lambda x: F.coalesce(F.split(F.try_element_at(names, x), r"\|"), F.array().cast("array<string>"))))
    short = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.concat(F.substring(plain, F.lit(1), i - 1), F.substring(plain, i + 1, F.lit(3))))
    near = F.array_union(_deletes(plain), F.when(F.length(plain) == 3, short).otherwise(F.array().cast("array<string>")))
    asked = held = key("=", near)
    asked = F.concat(asked, key("=", full))
    if loose:
        starts = F.transform(F.sequence(F.lit(1), F.greatest(F.length(plain), F.lit(1))), lambda i: F.substring(plain, F.lit(1), i))
        ends = F.when(F.length(plain) > 4, F.transform(F.sequence(F.lit(4), F.greatest(F.length(plain), F.lit(4))), lambda i: F.right(plain, i))).otherwise(F.array(plain))
        initials = F.array_join(F.transform(F.split("word", "-"), lambda p: F.substring(p, 1, 1)), "")
        asked = F.concat(asked, key("<", F.array_union(F.array(plain, F.substring_index("word", "-", 1)), stems)), key(">", F.array(plain)), key(".", F.array(plain)))
        held = F.concat(held, key("<", starts), key(">", ends), key(".", F.array(initials)))
    words = lambda d, c: d.where(F.col(c) != "").select(F.col(c).alias("word")).distinct()
    by_edits = lambda d: d.withColumn("keys", _deletes(F.col("word")))
    families = cut(_scored(by_edits(words(others, "family")), by_edits(words(anchors, "family")), F.when(F.col("x") == F.col("y"), 0.0).when(_close("x", "y"), 1.0)))
    givens = cut(_scored(words(others, "given").withColumn("keys", asked), words(anchors, "given").withColumn("keys", held), _given_costs(table)))
    one = others.where("given <> ''").select("value", F.col("family").alias("f"), F.col("given").alias("g")).distinct()
    one = one.join(families.select(F.col("x").alias("f"), F.col("y").alias("family"), F.col("cost").alias("cf")), "f")
    one = one.join(givens.select(F.col("x").alias("g"), F.col("y").alias("given"), F.col("cost").alias("cg")), "g")
    met = one.join(anchors.select("family", "given", "component"), ["family", "given"])
    # costs differ by tenths
    return met.groupBy("value", "component").agg(F.min(F.round(F.col("cf") + F.col("cg"), 3)).alias("cost"))


def _best(fits: DataFrame) -> DataFrame:
    """(value, component) of the values that fit exactly one component best."""
    fits = cut(fits)
    best = fits.groupBy("value").agg(F.min("cost").alias("_best"))
    rivals = fits.join(best, "value").where("cost = _best").groupBy("value").agg(F.min("component").alias("component"), F.count(F.lit(1)).alias("n"))
    return rivals.where("n = 1").select("value", "component")


def _established(readings: DataFrame, pets: tuple[tuple[str, str], ...]) -> DataFrame:
    """(g): given names that stand beside at least three family names, and aren't a misspelling or a shortening of one five times as common."""
    used = readings.where("marked and not short and length(given) >= 3")
    n = cut(used.select(F.replace("given", F.lit("-"), F.lit("")).alias("g"), "family").distinct().groupBy("g").agg(F.count(F.lit(1)).alias("n")))
    names = n.select(F.col("g").alias("id"), "g")
    near = _near(names, "g")
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    starts = n.select(F.col("g").alias("b"), F.explode(F.sequence(F.lit(3), F.greatest(F.lit(3), F.length("g") - 1))).alias("k")).select(F.expr("substring(b, 1, k)").alias("a"), "b").where("a <> b")
    rival = both.unionByName(starts.join(n.select(F.col("g").alias("a")), "a")).distinct()
    less, more = n.select(F.col("g").alias("a"), F.col("n").alias("_n")), n.select(F.col("g").alias("b"), F.col("n").alias("_m"))
    dominated = rival.join(less, "a").join(more, "b").where("_m >= 5 * _n").select(F.col("a").alias("g"))
    out = n.where("n >= 3").select("g").join(dominated, "g", "left_anti")
    if not pets:
        return out
    return out.join(F.broadcast(names.sparkSession.createDataFrame(sorted({(p,) for p, _ in pets}), "g string")), "g", "left_anti")


def writers(values: DataFrame, column: str = "auteur", pets: tuple[tuple[str, str], ...] = PETS) -> DataFrame:
    """(value, writer): every distinct value that names somebody, and the writer it names, as an arbitrary but stable key. pets: (pet name, name) pairs.

    NULL, empty and anonymous values give no row. A value that can't be told stands alone under its own key.
    """
    types = "kind string, body string, readings array<struct<family:string,given:string,short:boolean>>, marked boolean"

    @F.pandas_udf(types)
    def parsed(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(v) for v in x], columns=["kind", "body", "readings", "marked"])

    distinct = values.select(F.col(column).alias("value")).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("w"))
    p = cut(distinct.select("value", "w", parsed("value").alias("p")).select("value", "w", "p.*").where("kind is not null"))

    r = p.where("kind = 'person'").select("value", "w", "marked", F.size("readings").alias("n"), F.inline("readings"))
    known = _established(r, pets)
    plain = F.replace("given", F.lit("-"), F.lit(""))
    r = r.withColumn("g", plain).join(known.withColumn("known", F.lit(True)), "g", "left").withColumn("known", F.coalesce("known", F.lit(False)) & ~F.col("short"))
    sure = r.groupBy("value").agg(F.count_if("known").alias("_sure"))
    r = cut(r.join(sure, "value").where("_sure <> 1 or known"))

    named = r.where("known and (n = 1 or _sure = 1)")
    anchors = named.groupBy("family", "g").agg(F.max(F.struct(F.length("given").alias("n"), "given")).alias("given"), F.sum("w").alias("w"))
    anchors = cut(anchors.select(F.concat_ws("|", "family", "g").alias("id"), "family", "g", "given.given", "w"))
    bodies = p.where("kind = 'body'").select("value", "w", "body", F.concat(F.lit("b:"), "body").alias("id"))
    # organisations and anchors in one graph; what must agree between them is the given name, or being an organisation and its numbers
    forms = bodies.groupBy("id", "body").agg(F.sum("w").alias("w")).select("id", F.replace("body", F.lit(" "), F.lit("")).alias("text"), F.concat(F.lit("b:"), F.trim(F.regexp_replace("body", r"\P{Nd}+", " "))).alias("with"), "w", "body")
    forms = cut(forms.unionByName(anchors.select("id", F.col("family").alias("text"), F.col("g").alias("with"), "w", F.lit(None).cast("string").alias("body"))))
    edges = _near(forms, "text", "with").unionByName(_same_words(forms.where("body is not null").select("id", F.col("body").alias("words"))))
    grouped = cut(_stars(forms, edges))
    body = bodies.join(grouped, "id").select("value", F.col("component").alias("writer"))
    anchors = cut(anchors.join(grouped, "id").select("id", "family", "given", "component"))
    first = named.select("value", F.concat_ws("|", "family", "g").alias("id")).join(anchors, "id").select("value", "component")
    rest = r.join(first.select("value"), "value", "left_anti")
    second = cut(_best(_attach(rest.select("value", "family", "given"), anchors, pets)).unionByName(first))

    left = cut(r.join(second.select("value"), "value", "left_anti"))
    # what fits no anchor: the same parts in any order are one form; close forms, pet names, and short forms of full ones
    form = left.groupBy("value").agg(F.min(F.array_join(F.array_sort(F.array("family", plain)), "|")).alias("id"), F.min("short").alias("short"), F.max("w").alias("w"))
    full = cut(form.where("not short").groupBy("id").agg(F.sum("w").alias("w")).withColumn("text", F.replace("id", F.lit("|"), F.lit(""))))
    whole = cut(left.where("not short and given <> ''").select("value", "family", "given").join(form.where("not short").select("value", "id"), "value"))
    alike = _attach(whole.select(F.col("id").alias("value"), "family", "given").distinct(), whole.select("family", "given", F.col("id").alias("component")).distinct(), pets, loose=False)
    edges = _parted(_near(full, "text")).unionByName(alike.select(F.least("value", "component").alias("a"), F.greatest("value", "component").alias("b")).where("a <> b"))
    full = cut(_stars(full, edges))
    members = form.where("not short").join(full, "id").select("value", "component")
    like = whole.join(full, "id").select("family", "given", "component").distinct()
    third = cut(_best(_attach(left.where("short").select("value", "family", "given"), like, pets)))
    alone = form.where("short").join(third.select("value"), "value", "left_anti").select("value", F.col("id").alias("component"))
    loose = members.unionByName(third).unionByName(alone).select("value", F.concat(F.lit("q:"), "component").alias("writer"))
    return body.unionByName(second.select("value", F.concat(F.lit("p:"), "component").alias("writer"))).unionByName(loose)


def pairs(named: DataFrame) -> DataFrame:
    """(auteur_a, auteur_b): all pairs of values of one writer, the smaller first."""
    a, b = named.select("writer", F.col("value").alias("auteur_a")), named.select("writer", F.col("value").alias("auteur_b"))
    return a.join(b, "writer").where("auteur_a < auteur_b").select("auteur_a", "auteur_b")

r"""Sentences, titles and list items of texts in many scripts, in SQL expressions only.

Full stops of decimals, addresses, initials and abbreviations, and all ends inside quotations and list items, are masked by private-use
placeholders of one character each, so places in the masked text are places in the text. Line breaks that merely wrap a sentence are
masked too. What ends a unit in its script is then marked, the marked text is cut, and the units are read from the text by place.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How much longer than the width of its text a wrapped line may be, as blanks were doubled since.
SLACK = 1.1
_CHUNK = 256

# Placeholders.
DOT, ITEM, GREEK_END, INSIDE = (chr(0xE000 + k) for k in range(4))
OPEN, CLOSE, OPEN_COLON, CLOSE_COLON, NESTED = (chr(0xE010 + k) for k in range(5))
CUT, SOFT = chr(0xE020), chr(0xE030)

# Abbreviations that something always follows, by language; and those that only a number follows.
ALWAYS = """
M MM Mme Mmes Mlle Mlles Me Dr Drs Pr Prof St Ste Sté cf Cf fig Fig figs Figs tab chap Chap art Art vol Vol env éd réf resp tél av apr
Mr Mrs Ms Mt Rev Gen Col Sgt Lt Capt Hon vs approx pp p Eq Ref
z ca Ca Nr Abb Tab Kap Mio Mrd Hr Fr vgl Vgl Bd bzw Str
Sr Sra Srta Dra Sres pág págs Pág aprox núm EE ej Ud Uds
рис Рис т им ул стр табл проф акад см
δηλ κ κα αρ σελ
د أ
डॉ प्रो
""".split()
BEFORE_NUMBER = "No Nos no nos Sept Oct Nov Dec Jan Feb Aug Apr Mar Jun Jul n S Sec ch".split()
AFTER = ("la Cie", "La Cie", "c.-à-d", "e.g", "i.e", "p. ex", "d. h", "π.χ", "d.h", "z.B", "т. е", "т.е", "u. a")
ORDINAL_BEFORE = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember Jahrhundert Jahrhunderts Jahrhunderte Jh".split()

_SP = r"[\s\x{a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}\x{e030}]"
_BLANK = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
_END = r"[.!?…‼⁇⁈⁉؟۔\x{e002}]"
_CJK_END = r"[。！？｡]"
_DANDA = r"[।॥]"
_O = r"\x{e010}\x{e012}"
_C = r"\x{e011}"
_CLOSER = rf"[)\]}}’）】》{_C}\x{{e013}}]"
#: What begins a sentence after white space: capitals, numbers, letters without case, and names such as iX; behind opening signs.
_BEGIN = rf"[{_O}(\[¿¡–—•-]*{_SP}?[¿¡]*(?:[\p{{Lu}}\p{{Lt}}\p{{Lo}}\p{{N}}]|i\p{{Lu}})"
_MARKER = r"(?:[-•*–—·▪◦‣]|\p{Nd}{1,2}[.)\x{e001}]|[a-z]\))"


def _quotes(x: Column) -> Column:
    """Quotation signs of all kinds as opening and closing placeholders; straight and ambiguous ones by what is beside them."""
    signs = r"\"\x{ab}\x{bb}\x{201c}-\x{201e}\x{300c}-\x{300f}"
    # a class of one range and Latin signs is tried at most characters, the signs only where it fits
    closing = rf"[\"\x{{bb}}\x{{201c}}-\x{{300f}}](?:(?<=[»”」』])|(?<=[\"“])(?=(?:{_SP}|[.,;:!?…)\]]|$))(?<=[^\s(\[\x{{a0}}\x{{202f}}][\"“]))"
    opened = F.regexp_replace(x, closing, CLOSE)
    for sign in "\"«»“”„「」『』":
        opened = F.replace(opened, F.lit(sign), F.lit(OPEN))
    return F.when(F.rlike(x, F.lit(f"[{signs}]")), opened).otherwise(x)


def _dots(x: Column) -> Column:
    """Full stops that end nothing."""
    word = r"(?<![\p{L}\p{N}])"
    esc = lambda ws: "|".join(w.replace(".", r"\.").replace(" ", _SP) for w in ws)
    rules = (
        r"(?=(?!i\p{Lu})[\p{Ll}\p{Nd}_/~@-])",  # decimals, addresses, file names, versions, p.m.
        rf"(?<={word}(?:{esc(ALWAYS)})\.)",
        rf"(?<={word}(?:{esc(AFTER)})\.)",
        rf"(?<={word}(?:{esc(BEFORE_NUMBER)})\.)(?={_SP}*\p{{Nd}})",
        rf"(?<=\p{{Nd}}\.)(?={_SP}+(?:{esc(ORDINAL_BEFORE)})\b)",
        rf"(?<=(?<![\p{{L}}\p{{N}}'’-]|\p{{Nd}}[ \x{{a0}}\x{{202f}}]|\p{{Lu}}\.)\p{{Lu}}\.)(?={_SP}+\p{{Lu}})",  # J. R. Name
        rf"(?<=['’]\p{{Lu}}\.)(?={_SP}+\p{{Lu}}\p{{Ll}})",
        rf"(?<=(?<!(?:av|apr)\.{_SP})\p{{Lu}}\.-\p{{Lu}}\.)(?={_SP}+\p{{Lu}})",  # J.-P. Name, but not av. J.-C.
    )
    return F.regexp_replace(x, r"\.(?:" + "|".join(rules) + ")", DOT)


#: What ends a sentence; inside a quotation it doesn't.
_ENDS = ".!?…。！？｡;।؟"
#: Most characters of a text, none of them in _ENDS, a line break or a placeholder: tried before classes of many signs, which cost a test a sign.
_COMMON = r"[\x{40}-\x{60f} ,'0123456789():/-]++"


def _east(x: Column) -> Column:
    """Whether a text holds one of _CJK_END; four searches of bytes are cheaper than a pattern."""
    return reduce(or_, (F.contains(x, F.lit(c)) for c in "。！？｡"))


def _inside(x: Column) -> Column:
    """Ends inside quotations, of any length and in any nesting; and the quotations that follow a colon, by signs of their own.

    The text is cut at signs and blank lines. The depth behind each piece counts the signs open there, from 0 at each blank line. A piece
    is inside a quotation if the depth falls below its own later in the paragraph: an opening sign that none closes counts for nothing.
    """
    apart = F.regexp_replace(x, r"\n(?=[^\S\n]*\n)", f"{CUT}\n")
    for sign in (OPEN, CLOSE):
        apart = F.replace(apart, F.lit(sign), F.lit(CUT + sign + CUT))
    pieces = F.split(apart, CUT)
    none = F.array().cast("array<int>")

    def deeper(acc: Column, p: Column) -> Column:
        d = F.when(p == OPEN, F.greatest(acc["d"], F.lit(0)) + 1).when(p == CLOSE, F.greatest(acc["d"] - 1, F.lit(0))).when(F.startswith(p, F.lit("\n")) & F.rlike(p, F.lit(r"^\n[^\S\n]*\n")), -1).otherwise(F.greatest(acc["d"], F.lit(0)))
        return F.struct(d.alias("d"), F.array_append(acc["o"], d).alias("o"))

    # -1 marks the first piece behind a blank line
    depths = lambda ps: F.aggregate(ps, F.struct(F.lit(0).alias("d"), none.alias("o")), deeper, lambda a: a["o"])

    def later(acc: Column, d: Column) -> Column:
        """From the end: the least depth behind each piece in its paragraph."""
        return F.struct(F.when(d < 0, _FAR).otherwise(F.least(acc["m"], d)).alias("m"), F.array_append(acc["o"], acc["m"]).alias("o"))

    least = lambda ds: F.reverse(F.aggregate(F.reverse(ds), F.struct(F.lit(_FAR).alias("m"), none.alias("o")), later, lambda a: a["o"]))
    # a sign inside another quotation begins and ends nothing
    mask = lambda p, d, m: F.when((p == OPEN) & (m >= d - 1), p).when(m < d, F.translate(p, _ENDS + OPEN + CLOSE, INSIDE * len(_ENDS) + NESTED * 2)).otherwise(p)

    def put_together(s: Column) -> Column:
        masked = F.transform(s, lambda r, i: mask(r["p"], r["d"], r["m"]))
        # it matters where sentences follow each other without a blank
        east = _east(x)
        opens = lambda r, i: (r["p"] == OPEN) & (r["m"] < r["d"]) & (i > 0) & F.rlike(F.get(s, i - 1)["p"], F.lit(rf"[:：]{_SP}?$"))
        simple = lambda i: (F.get(s, i + 2)["p"] == CLOSE)
        colon = F.transform(s, lambda r, i: F.when(opens(r, i) & simple(i), OPEN_COLON).when((r["p"] == CLOSE) & (i > 2) & opens(F.get(s, i - 2), i - 2), CLOSE_COLON).otherwise(mask(r["p"], r["d"], r["m"])))
        return F.array_join(F.when(east, colon).otherwise(masked), "")

    zipped = lambda ps: F.transform(F.array(depths(ps)), lambda ds: F.arrays_zip(ps.alias("p"), ds.alias("d"), least(ds).alias("m")))[0]
    # an array of one element binds a value once
    done = F.transform(F.transform(F.array(pieces), zipped), put_together)[0]
    # without a quotation in another one a chain of matches does the same; its lookaheads are for texts that aren't very long
    near = rf"(?:{_COMMON}|[^{OPEN}{CLOSE}\n]++|\n(?![^\S\n]*\n))*+"
    plain = rf"(?:{_COMMON}|[^{OPEN}{CLOSE}{_ENDS}\n]++|\n(?![^\S\n]*\n))*+"
    chain = F.regexp_replace(x, rf"({OPEN}{plain}|\G(?<!^){plain})[{_ENDS}](?={near}{CLOSE})", f"$1{INSIDE}")
    chain = F.when(_east(x), F.regexp_replace(chain, rf"(?<=[:：]{_SP}?){OPEN}({near}){CLOSE}", f"{OPEN_COLON}$1{CLOSE_COLON}")).otherwise(chain)
    nested = F.rlike(x, F.lit(rf"{OPEN}[^{OPEN}{CLOSE}]*+{OPEN}")) | (F.length(x) > _LONG)
    done = F.when(nested, done).otherwise(chain)
    # most quotations hold no end and no other quotation: nothing to mask
    held = F.rlike(x, F.lit(rf"{OPEN}[^{OPEN}{CLOSE}{_ENDS}]*+[{OPEN}{_ENDS}]")) | _east(x)
    return F.when((F.instr(x, CLOSE) > 0) & held, done).otherwise(x)


_FAR = 1 << 30
_LONG = 20_000


def _line(trimmed: Column) -> Column:
    """What a line (x, and t without blanks before it) says about wraps: its text, length (double blanks as one), how it begins, and the length of its first word."""
    x, t = trimmed["x"], trimmed["t"]
    first = F.left(t, F.lit(1))
    # where words aren't parted by blanks a line may break at any letter
    tight = (first >= "\u0e00") & F.rlike(first, F.lit(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]"))
    word = F.when(tight, 1).otherwise(F.length(F.substring_index(t, " ", 1)))
    return F.struct(x.alias("x"), F.length(F.replace(x, F.lit("  "), F.lit(" "))).alias("n"), word.alias("word"), first.alias("first"))


def _test(cheap: Column, line: Column, pattern: str) -> Column:
    """A pattern, tried where a cheap test of a line's first sign allows it."""
    return cheap & F.rlike(line["x"], F.lit(pattern))


def _marked(line: Column) -> Column:
    return _test(F.rlike(line["first"], F.lit(r"[-•*–—·▪◦‣\p{Nd}a-z]")), line, rf"^{_SP}*{_MARKER}{_SP}")


def _low(line: Column) -> Column:
    return _test(F.rlike(line["first"], F.lit(rf"[\p{{Ll}},;:){_C}\x{{e013}}]")), line, rf"^{_SP}*(?!i\p{{Lu}})(?!{_MARKER}{_SP})")


def _finished(line: Column) -> Column:
    end = F.right(line["x"], F.lit(8))
    return F.rlike(end, F.lit(rf"(?:{_END}|{_CJK_END}|{_DANDA}|\x{{e003}}{_SP}?[{_C}\x{{e013}}])(?:{_SP}|{_CLOSER})*$"))


def _lines(x: Column) -> Column:
    """The text with wraps masked, while other line breaks stay and end a unit.

    A break wraps a sentence if the next line goes on in lower case; or if the line is unfinished and full, as the next word would have
    crossed the width at which the text is wrapped. That width is one that most breaks behind unfinished lines agree on: one before lower
    case is enough to show it, two before letters without case, three before any other. Lines that aren't wrapped, however long, say nothing about it.
    """
    breaks = lambda ls: F.filter(
        F.zip_with(ls, F.slice(ls, F.lit(2), F.size(ls)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        lambda p: p["a"].isNotNull(),
    )

    def told(p: Column) -> Column:
        """A break, and whether lower case follows (NULL beside a blank line)."""
        both = (p["a"]["word"] > 0) & (p["b"]["word"] > 0)
        return F.struct(p["a"].alias("a"), p["b"].alias("b"), F.when(both, _low(p["b"])).alias("low"))

    def more(p: Column) -> Column:
        """Where it doesn't, whether the line is finished and the next one marked."""
        return F.struct(p["a"].alias("a"), p["b"].alias("b"), p["low"].alias("low"), F.when(~p["low"], _finished(p["a"])).alias("finished"), F.when(~p["low"], _marked(p["b"])).alias("marked"))

    def ranges(ps: Column) -> Column:
        """The widths that each break which may be a wrap allows, as the events +v and -v."""
        may = F.filter(ps, lambda p: (p["low"] | ~p["finished"] & ~p["marked"]) & (p["b"]["n"] <= p["a"]["n"] + p["b"]["word"]))

        def events(p: Column) -> Column:
            v = F.when(p["low"], 3).when((p["b"]["first"] >= "\u0590") & F.rlike(p["b"]["first"], F.lit(r"\p{Lo}")), 2).otherwise(1)
            return F.array(
                F.struct(F.greatest(p["a"]["n"], p["b"]["n"]).alias("at"), F.lit(0).alias("end"), v.alias("v")),
                F.struct((p["a"]["n"] + p["b"]["word"]).alias("at"), F.lit(1).alias("end"), (-v).alias("v")),
            )

        return F.array_sort(F.flatten(F.transform(may, events)))

    def widest(acc: Column, e: Column) -> Column:
        now = acc["now"] + e["v"]
        better = (e["end"] == 0) & (now > acc["best"])
        # the range of the best is open until the first event that ends one
        hi = F.when(better, _FAR).when((e["end"] == 1) & (acc["hi"] == _FAR), e["at"]).otherwise(acc["hi"])
        return F.struct(now.alias("now"), F.when(better, now).otherwise(acc["best"]).alias("best"), F.when(better, e["at"]).otherwise(acc["lo"]).alias("lo"), hi.alias("hi"))

    zero = F.struct(F.lit(0).alias("now"), F.lit(2).alias("best"), F.lit(_FAR).alias("lo"), F.lit(0).alias("hi"))
    none = F.struct(F.lit(_FAR).alias("lo"), F.lit(0).alias("hi"))
    found = lambda ps: F.aggregate(ranges(ps), zero, widest, lambda a: F.struct(a["lo"].alias("lo"), a["hi"].alias("hi")))
    # the width matters only where a line is unfinished and no lower case follows
    width = lambda ps: F.when(F.exists(ps, lambda p: ~p["low"] & ~p["finished"] & ~(p["marked"] & _marked(p["a"]))), found(ps)).otherwise(none)

    def wraps(p: Column, w: Column) -> Column:
        a, b = p["a"], p["b"]
        full = (F.greatest(a["n"], b["n"]) <= SLACK * w["hi"]) & (a["n"] + b["word"] >= w["lo"])
        bullet = F.rlike(b["first"], F.lit("[•*·▪◦‣]")) & F.rlike(b["x"], F.lit(rf"^{_SP}*[•*·▪◦‣]{_SP}"))
        return F.coalesce(p["low"] | (full & ~p["finished"] & ~bullet & ~(p["marked"] & _marked(a))), F.lit(False))

    join = lambda ps, w: F.array_join(F.transform(ps, lambda p: F.concat(p["a"]["x"], F.when(p["b"].isNull(), "").when(wraps(p, w), SOFT).otherwise("\n"))), "")
    # each step binds a value that the next one uses several times
    trimmed = F.transform(F.split(x, "\n"), lambda v: F.struct(v.alias("x"), F.ltrim(v, F.lit(_BLANK + SOFT)).alias("t")))
    lines = F.transform(F.array(F.transform(trimmed, _line)), lambda ls: F.transform(F.transform(breaks(ls), told), more))
    both = F.transform(lines, lambda ps: F.struct(ps.alias("ps"), width(ps).alias("w")))
    return F.transform(both, lambda r: join(r["ps"], r["w"]))[0]


def _items(x: Column) -> Column:
    """Ends inside list items: an item is one unit, to the end of its line."""
    inner = rf"(?:{_COMMON}|[^\n.!?…。！？;])*+"
    lined = F.concat(F.lit("\n"), x)
    head = F.regexp_replace(lined, rf"(\n[^\S\n]*\p{{Nd}}{{1,2}})\.(?={_SP})", f"$1{ITEM}")
    chain = rf"(\n[^\S\n]*{_MARKER}{_SP}{inner}|\G(?<!^){inner})[.!?…。！？;]"
    return F.when(F.rlike(lined, F.lit(rf"\n[^\S\n]*{_MARKER}{_SP}")), F.substring(F.regexp_replace(head, chain, f"$1{ITEM}"), F.lit(2), F.length(x))).otherwise(x)


def _cuts(x: Column) -> Column:
    """A mark behind every end of a unit."""
    tail = rf"(?:{_SP}?{_CLOSER})*"
    quoted = rf"\x{{e003}}{_SP}?[{_C}\x{{e013}}]"
    latin = rf"(?:{_END}|{quoted}){tail}(?={_SP}+{_BEGIN})"
    tight = rf"(?:[!?]|[.…](?<=[\p{{Ll}}\p{{N}}%°$€)\]{_C}\x{{e013}}][.!?…]{{1,3}})|{quoted})(?=\p{{Lu}}|i\p{{Lu}}|[¿¡{_O}]|\(\p{{Lu}})"
    east = rf"{_CJK_END}+[)）】》{_C}\x{{e013}}]*(?!{_CJK_END})|\x{{e003}}\x{{e013}}(?=[\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}])"
    thai = rf"[\x{{e00}}-\x{{e7f}}](?={_SP}+[\x{{e00}}-\x{{e7f}}])"
    # all ends are one of four signs or above U+060F: one cheap test for most characters
    return F.regexp_replace(x, rf"(?=[\n!.?[^\x{{0}}-\x{{60f}}]])(\n|{latin}|{tight}|{east}|{_DANDA}+{tail}|{thai})", f"$1{CUT}")


def masked(docs: DataFrame, text: str) -> DataFrame:
    """docs with `_m`: the text masked and marked."""
    x = F.col(text)
    greek = F.when(F.instr(x, ";") > 0, F.regexp_replace(x, rf"[;\x{{37e}}](?<=[\x{{370}}-\x{{3ff}}\x{{1f00}}-\x{{1fff}}][;\x{{37e}}])(?={_SP}|$)", GREEK_END)).otherwise(x)
    one = docs.withColumn("_m", _inside(_dots(_quotes(greek))))
    two = one.withColumn("_m", F.when(F.rlike("_m", F.lit(r"\S[^\S\n]*\n[^\S\n]*\S")), _lines(F.col("_m"))).otherwise(F.col("_m")))
    return two.withColumn("_m", _cuts(_items(F.col("_m"))))


def _prefix(values: Column) -> Column:
    """Sums of the values before each."""
    step = lambda acc, v: F.struct(F.array_append(acc["o"], acc["s"]).alias("o"), (acc["s"] + v).alias("s"))
    return F.aggregate(values, F.struct(F.array().cast("array<int>").alias("o"), F.lit(0).alias("s")), step, lambda a: a["o"])


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, debut, fin): units of each text by code points, without white space at their ends.

    NULL, empty and blank texts give no unit. Repeated rows give their units again. A text is cut in one row: its work grows with
    its length, in steps of _CHUNK units. Private-use characters in a text count as letters only where they aren't placeholders.
    """
    own = r"[\x{e000}-\x{e003}\x{e010}-\x{e014}\x{e020}\x{e030}]"
    clean = docs.where(F.col(text).isNotNull()).select(key, F.when(F.rlike(text, F.lit(r"[\x{e000}-\x{e030}]")), F.regexp_replace(text, own, "x")).otherwise(F.col(text)).alias("_t"))
    blank = F.lit(_BLANK + SOFT)

    def size(p: Column) -> Column:
        left = F.ltrim(p, blank)
        # few units end in white space, and to look for it takes a pass over all of a unit
        whole = F.when(F.right(p, F.lit(1)).isin(*_BLANK, SOFT), F.length(F.rtrim(left, blank))).otherwise(F.length(left))
        return F.struct(F.length(p).alias("n"), F.length(left).alias("l"), whole.alias("t"))

    m = masked(clean, "_t").select(key, F.transform(F.split("_m", CUT), size).alias("_p"))
    chunks = F.transform(F.sequence(F.lit(0), F.size("_p") - 1, F.lit(_CHUNK)), lambda i: F.slice("_p", i + 1, F.lit(_CHUNK)))
    m = m.select(key, chunks.alias("_c"))
    sums = F.transform("_c", lambda c: F.aggregate(c, F.lit(0), lambda a, p: a + p["n"]))
    m = m.select(key, F.inline(F.arrays_zip(F.col("_c").alias("c"), _prefix(sums).alias("o"))).alias("_s", "_o"))
    m = m.select(key, "_o", F.inline(F.arrays_zip(F.col("_s").alias("s"), _prefix(F.transform("_s", lambda s: s["n"])).alias("b"))).alias("s", "b"))
    start = (F.col("_o") + F.col("b") + F.col("s.n") - F.col("s.l")).cast("int")
    return m.where("s.t > 0").select(key, start.alias("debut"), (start + F.col("s.t")).cast("int").alias("fin"))


def restored(docs: DataFrame, units: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """units with their text, as it stands."""
    t = docs.select(key, text)
    return units.join(t, key).select(key, "debut", "fin", F.substring(F.col(text), F.col("debut") + 1, F.col("fin") - F.col("debut")).alias("sentence"))

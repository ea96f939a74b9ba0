"""Text brought to one form: equal for values that look equal.

The method named for this problem (compatibility normalisation, full case folding) also makes equal what a reader tells apart: case,
raised digits, fractions. So there are two forms. `look` keeps every visible difference; `fold` is the named one, made from it, for
comparisons that should overlook them. Values of equal look have equal folds; candidates are found by fold, then held against look.

Values of plain characters only are their own look, which a test in the JVM tells; others go through Python, each distinct one of a batch once.
"""

from __future__ import annotations

import re
import unicodedata as ud
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import BLANKS
from lexiloom.session import cut, flagged, joined

# Letters and signs of other scripts that are drawn like the ones below them: Cyrillic small and capital, Greek, Armenian,
# Cherokee, Lisu; signs. Letters that public lists of confusables call similar but that a reader can tell apart (г and r, α and a) aren't here.
ALIKE = (
    ("аеорсухіѕјԁһԛԝӏɡοѵѡ", "aeopcyxisjdhqwlgovw"),
    ("АВЕКМНОРСТХІЅЈԚԜҮ", "ABEKMHOPCTXISJQWY"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳ", "ABEZHIKMNOPTYXCj"),
    ("օոսհՕՍՏԼ", "onuhOUSL"),
    ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃᎡ", "ABCDEGHJKLMPSTVWZR"),
    ("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"),
    ("⁄∕⧸‐‑﹘−", "///---–"),
)
#: Code points without a look of their own, as ranges. Joiners count only where letters don't join.
UNSEEN = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200B), (0x200E, 0x200F), (0x202A, 0x202C), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB), (0xE0000, 0xE0FFF))
_JOINERS = re.compile("(?<![\u0600-\u08ff\u0900-\u0dff\U0001f000-\U0001faff\ufe0f])[\u200c\u200d]+")
_SAME_DRAWING = ("<wide>", "<narrow>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>")


@lru_cache(maxsize=1)
def _table() -> dict[int, str | None]:
    """What each code point is drawn as. By rule: forms by width, position or line breaking are the ordinary character; a letter
    sign of several letters (ligatures, Roman numerals) or a Roman numeral is those letters; any space is a blank."""
    out: dict[int, str | None] = {}
    for c in range(0x80, 0x30000):
        ch = chr(c)
        kind = ud.category(ch)
        way = ud.decomposition(ch)
        if kind == "Zs" or c == 0x2800:
            out[c] = " "
        elif kind in ("Zl", "Zp"):
            out[c] = "\n"
        elif way.startswith(_SAME_DRAWING) or (kind == "Nl" and way.startswith("<compat>")) or (way.startswith("<compat>") and kind[0] in "LN" and way.count(" ") > 1 and ud.normalize("NFKC", ch).isalpha()):
            out[c] = ud.normalize("NFKD", ch)
    for seen, as_ in ALIKE:
        out |= {ord(a): b for a, b in zip(seen, as_, strict=True)}
    for first, last in UNSEEN:
        out |= dict.fromkeys(range(first, last + 1))
    return out


def look_of(s: str) -> str:
    if s.isascii():
        return s.strip()
    return ud.normalize("NFC", _JOINERS.sub("", ud.normalize("NFD", s)).translate(_table())).strip()


def fold_of(look: str) -> str:
    """The NFKC case fold: normalised before and after folding, white space runs as one blank."""
    return " ".join(ud.normalize("NFKC", ud.normalize("NFKC", look).casefold()).split())


@lru_cache(maxsize=1)
def _plain_class() -> str:
    """A character class, in the syntax of Java, of those that stand for themselves whatever is beside them, by rule: no mark, not
    changed by any form of normalisation or by the table, and folded as lower() does. Of the first 256 and of punctuation only: these are
    tested by bits and a few ranges, while a class of all scripts takes longer than the work it saves. Other texts take the longer way."""

    def plain(c: int) -> bool:
        ch = chr(c)
        if c < 0x80:
            return True
        if ud.category(ch)[0] in "MCZ" or c in _table():
            return False
        return all(ud.normalize(f, ch) == ch for f in ("NFC", "NFKC")) and ch.casefold() == ch.lower() and len(ch.lower()) == 1 and ud.normalize("NFKC", ch.lower()) == ch.lower()

    ranges: list[list[int]] = []
    for c in (0x152, 0x153, *range(0x2010, 0x2028), 0x20AC):
        if plain(c):
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    bits = "".join(rf"\x{c:x}" for c in range(0x80, 0x100) if plain(c))
    return rf"\x00-\x7f{bits}" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges)


def _is_plain(x: Column) -> Column:
    """Whether x is its own look but for the blanks at its ends, and lower() its fold. Both hold for most texts, which so stay out of Python."""
    return ~F.rlike(x, F.lit(f"[^{_plain_class()}]"))


def _per_value(x: Column, plain: Column, f) -> Column:
    """plain of plain values; f of all others, once for each distinct value of a batch."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map({v: f(v) for v in s.dropna().unique()})

    return F.coalesce(run(F.when(~_is_plain(x), x)), plain)


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _look(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANKS))


def _fold(x: Column) -> Column:
    """Of a plain value, which has no blanks but those of ASCII."""
    one = F.when(F.rlike(x, F.lit(r"[\t-\r\x1c-\x1f]|  ")), F.regexp_replace(x, r"[\t-\r\x1c-\x20]+", " ")).otherwise(x)
    return F.lower(F.trim(one))


def look(x: Column | str) -> Column:
    """The visible form; NULL stays NULL, a value with nothing visible becomes ""."""
    x = _column(x)
    return _per_value(x, _look(x), look_of)


def fold(x: Column | str) -> Column:
    """The named form of the look: compatibility normalisation, full case folding, runs of white space as one blank; NULL stays NULL."""
    x = _column(x)
    return _per_value(x, _fold(x), lambda v: fold_of(look_of(v)))


def _digest(x: Column, name: str) -> list[Column]:
    """128 bits of a string as two numbers."""
    return [F.xxhash64(x).alias(f"{name}1"), F.xxhash64(F.lit(1), x).alias(f"{name}2")]


_KEYS = {name: [f"{name}1", f"{name}2"] for name in ("look", "raw")}


def digests(values: DataFrame, key: str, value: str) -> DataFrame:
    """(cle, fold, look1, look2, raw1, raw2): one row a key and string; values with nothing visible, NULLs and NULL keys are left out. Only digests are kept: 64 bits of the fold, 128 of the look and of the string."""

    @F.pandas_udf("look string, fold string")
    def run(s: pd.Series) -> pd.DataFrame:
        seen = {v: (w := look_of(v), fold_of(w)) for v in s.dropna().unique()}
        return pd.DataFrame([seen.get(v, (None, None)) for v in s], columns=["look", "fold"])

    x = F.col("_x")
    rows = values.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(F.col(key).alias("cle"), F.col(value).alias("_x"))
    rows = rows.withColumn("_p", run(F.when(~_is_plain(x), x)))
    rows = rows.withColumn("_look", F.coalesce("_p.look", _look(x))).withColumn("_fold", F.coalesce("_p.fold", _fold(x)))
    return rows.where("_look <> ''").select("cle", F.xxhash64("_fold").alias("fold"), *_digest(F.col("_look"), "look"), *_digest(x, "raw")).distinct()


def alike(values: DataFrame, key: str, value: str) -> DataFrame:
    """(cle_a, cle_b): keys, smaller first, of values that look the same and aren't the same string.

    Values with nothing visible, NULLs and NULL keys are no cases. Only digests are shuffled, and written once. Equal strings form a class first and
    classes of one fold are paired, then held against their looks, so a string that a third of all rows hold is not compared with itself row by row.
    The pairs asked for are then written out, once each, rows of a common string under a salt.
    """
    rows = cut(digests(values, key, value))
    strings = cut(rows.groupBy("fold", *_KEYS["look"], *_KEYS["raw"]).agg(F.count(F.lit(1)).alias("n")))
    several = strings.groupBy("fold").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("fold")
    few = cut(strings.join(several, "fold", "left_semi"))
    side = lambda s: few.select("fold", *_KEYS["look"], *(F.col(c).alias(f"{c}_{s}") for c in (*_KEYS["raw"], "n")))
    met = side("a").join(side("b"), ["fold", *_KEYS["look"]]).where("struct(raw1_a, raw2_a) < struct(raw1_b, raw2_b)")
    pairs = cut(met.select(*(F.struct(f"raw1_{s}", f"raw2_{s}").alias(s) for s in "ab"), "n_a", "n_b"))
    named = rows.select(F.struct(*(F.col(c).alias(f"{c}_a") for c in _KEYS["raw"])).alias("a"), F.col("cle").alias("x"))
    first = joined(named, pairs, "a", F.col("x"), F.col("n_a")).select("x", "b", "n_b")
    named = rows.select(F.struct(*(F.col(c).alias(f"{c}_b") for c in _KEYS["raw"])).alias("b"), F.col("cle").alias("y"))
    second = joined(named, cut(first), "b", F.col("y"), F.col("n_b"))
    return second.where("x <> y").select(F.least("x", "y").alias("cle_a"), F.greatest("x", "y").alias("cle_b")).distinct()


def classes(values: DataFrame, key: str, value: str) -> DataFrame:
    """(cle, classe, chaines): one row a key and look: the look's digest, and how many different strings have it. The form of `alike` that doesn't grow with pairs."""
    rows = cut(digests(values, key, value))
    strings = cut(rows.select(*_KEYS["look"], *_KEYS["raw"]).distinct().groupBy(*_KEYS["look"]).agg(F.count(F.lit(1)).alias("chaines")))
    name = F.concat(F.lpad(F.hex("look1"), 16, "0"), F.lpad(F.hex("look2"), 16, "0"))
    return flagged(rows.select("cle", *_KEYS["look"]).distinct(), strings, _KEYS["look"]).select("cle", name.alias("classe"), "chaines")

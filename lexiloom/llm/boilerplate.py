"""Main content of pages: wrappers of a site's frame, inferred without unions, taken off.

A wrapper is a regular expression over lines without alternatives: fixed items, optional ones, items with text slots, and repeated groups;
what lies between its items is a slot of any text, the article. A site's wrapper is formed by aligning its pages:

1. Lines that agree, numbers and dates and the host's own name apart, can align. What stands on enough pages of a host under different
   titles is an item there. A line of small hosts, which show no recurrence of their own, is an item if many hosts have it as one; on a
   large host such a line needs evidence of place: beside other items.
2. Mismatching lines become items with text slots: lines that recur but for one word, and lines that agree with an item's words in order.
3. A line all of whose parts are known is a group (a menu).
4. The items of each page, in order, are aligned with the wrapper so far (longest common subsequence). An item that the page lacks becomes
   optional, one that the wrapper lacks is put in where the page has it. Large hosts are aligned in chunks, whose wrappers are aligned
   with each other in turn. An item that is always followed by a run of varying lines heads a repeated group of slots (a list).
5. Each page is read by its host's wrapper: lines that its items and groups take are frame, those in slots of any text are the article.
   A page whose only line left stands alone on many pages of several hosts is a notice in place of an article.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from itertools import groupby
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import WS, pystrip
from lexiloom.session import broadcast_if_small, cut, flagged, rows_of
from lexiloom.sources.corpus import latest

#: A line is an item of a host from this share of its pages, and from MIN_PAGES anyway: fewer may agree by chance.
HOST_SHARE, MIN_PAGES = 0.08, 4
#: From so many pages on a host shows all its items by itself; smaller ones lean on the family.
OWN_PAGES = MIN_PAGES / HOST_SHARE
#: A line is the family's if hosts have it as an item, as many as this share of the hosts of OWN_PAGES, two at least; or if this share of the
#: hosts that are too small for one hold it (a third of that share, MIN_PAGES at least), and SMALL_TIMES as often as by their share of the pages of hosts whose item it isn't.
FAMILY_SHARE, SMALL_TIMES = 0.03, 5
#: How much of a line's occurrences must lie beside the same line (rare layouts) or beside items (the family's lines on large hosts).
PLACE_SHARE = 0.5
#: Words of lines that are aligned with slots, and how much of both must agree in order.
SLOT_WORDS, SLOT_SHARE = 4, 0.7
#: A notice is the only line of this share of all pages with one line left, on two hosts at least.
NOTICE_SHARE = 0.02
#: Pages of a chunk of a host, and wrappers of chunks that are aligned in one go.
CHUNK_PAGES, FAN_IN = 2000, 32

# Month names count as parts of a date; signs that part the entries of a menu; how a text's lines may be bulleted.
MONTHS = "janvier février mars avril mai juin juillet août septembre octobre novembre décembre january february march april may june july august september october november december"
_PARTS = r"\s*[|·>•\[\]–—^*]\s*|\s+[-/]\s+|\s{3,}|<<|^\s*-\s"
_BULLET = r"^[-•*–—·▪]\s"


def host(title: Column) -> Column:
    """The site named in a page title `DATE > Bulletin SITE NUMBER > TITLE`; NULL if none is."""
    named = F.regexp_replace(pystrip(F.get(F.split(title, ">"), F.lit(1))), rf"^(?i:bulletin){WS}+|{WS}*\p{{Nd}}+$", "")
    return F.nullif(pystrip(named), F.lit(""))


def _plain(x: Column, keep: str = "") -> Column:
    """Words in lower case, parts of hyphened ones together, numbers and dates as #."""
    x = F.lower(F.when(F.contains(x, F.lit("-")), F.regexp_replace(x, r"-(?<=\p{L}-)(?=\p{L})", "")).otherwise(x))
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\p{Nd}+", "#"), rf"[^a-z#{keep}\p{{L}}\p{{N}}]+", " "))


def _dated(x: Column) -> Column:
    """A plain line with its dates as one #."""
    return F.when(F.instr(x, "#") > 0, F.regexp_replace(x, rf"#(?: (?:#|(?:{'|'.join(MONTHS.split())})(?!\p{{L}})))+", "#")).otherwise(x)


def _named(x: Column, name: Column) -> Column:
    """A plain line with the host's plain name as @."""
    padded = F.replace(F.concat(F.lit(" "), x, F.lit(" ")), F.concat(F.lit(" "), name, F.lit(" ")), F.lit(" @ "))
    return F.when(F.instr(x, name) > 0, F.trim(padded)).otherwise(x)


def template(rows: DataFrame, line: str, to: str) -> DataFrame:
    """rows with a line as a wrapper sees it; column name: the host's plain name."""
    return rows.withColumn("_x", _plain(F.col(line))).withColumn("_x", _dated(F.col("_x"))).withColumn(to, _named(F.col("_x"), F.col("name"))).drop("_x")


def _title(html: Column) -> Column:
    @F.pandas_udf("string")
    def decoded(x: pd.Series) -> pd.Series:
        from html import unescape

        return x.map(unescape, na_action="ignore")

    return decoded(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def newest(pages: DataFrame) -> DataFrame:
    """(path, html, texte): one row a path. Of several loads with a text the last counts; without times the greatest html and text."""
    pages = pages.where("path is not null and texte is not null")
    if "loaded_at" not in pages.columns:
        pages = pages.withColumn("loaded_at", F.lit(None).cast("timestamp"))
    return latest(pages.select("path", "html", "texte", "loaded_at"), "path").drop("loaded_at")


def lines(pages: DataFrame) -> DataFrame:
    """(path, who, named, site, n, k, t, title, item, bare, rank, near, parts, pk): one row a line of each page's text. pages: (path, html, texte), a row a path.

    k is the template's hash (0 for a line without words), t the template itself where it has words, bare whether the line has no sign
    at its end, item whether it has no bullet either, near hashes of the lines before and after it, parts the templates of the parts
    that signs cut the line into, pk their hash. who tells articles apart: pages that give one article again under the same title
    share it; named is that title, or the text where it has none. A page that names no host is its own.
    """
    one = pages.select("path", _title(F.col("html")).alias("title"), F.split("texte", "\n").alias("l"))
    one = one.withColumn("site", host(F.col("title"))).withColumn("name", _dated(_plain(F.coalesce("site", F.lit("")))))
    longest = F.array_max(F.transform("l", lambda x: F.struct(F.length(x).alias("n"), F.xxhash64(x).alias("h"))))
    one = one.select("path", F.xxhash64(F.coalesce("site", F.concat(F.lit("/"), "path"))).alias("site"), F.when(F.col("name") == "", "@").otherwise(F.col("name")).alias("name"), F.get(F.split("title", ">"), F.lit(2)).alias("own"), longest.alias("most"), "l")
    one = template(one, "own", "own").select("path", F.xxhash64("own", "most").alias("who"), F.when(F.col("own") != "", F.xxhash64("own")).otherwise(F.xxhash64("most")).alias("named"), "site", "name", F.nullif("own", F.lit("")).alias("own"), "l", F.transform("l", lambda x: F.xxhash64(F.when(F.rlike(x, F.lit("[0-9]")), F.regexp_replace(x, "[0-9]+", "")).otherwise(x))).alias("h"))
    # outer: else all texts are split a second time, for a filter of empty arrays; there are none
    rows = one.select("path", "who", "named", "site", "name", "own", "h", F.posexplode_outer("l").alias("n", "line"))
    near = F.array_compact(F.array(F.when(F.col("n") > 0, F.get("h", F.col("n") - 1)), F.get("h", F.col("n") + 1)))
    rows = template(rows.withColumn("near", near).drop("h"), "line", "t")
    # what a line begins with is matched on two characters: an anchored pattern is tried at every place of a line
    rows = rows.withColumn("head", F.left(F.ltrim("line", F.lit(" \t\r\x0b\x0c")), F.lit(2)))
    bare = F.instr(F.lit(".;:»…"), F.right(F.rtrim("line", F.lit(" \t\r\x0b\x0c")), F.lit(1))) < 1
    bare = bare | F.col("head").isin("", "\x85", "\u2028", "\u2029")
    item = bare & ~F.rlike("head", F.lit(_BULLET))
    rank = F.when(F.rlike("head", F.lit(r"^\p{Nd}")), F.regexp_extract("line", r"^\s*(\p{Nd}+)\.\s", 1).try_cast("int"))
    signs = reduce(or_, (F.contains("line", F.lit(x)) for x in ("|", "·", ">", "•", "[", "]", "–", "—", "^", "*", "<<", " - ", " / ", "   ")), F.startswith("line", F.lit("-")))
    # columns of their own: what follows uses each several times
    rows = rows.withColumn("_cut", F.when(signs, F.regexp_replace("line", _PARTS, "\n"))).withColumn("_cut", _plain(F.col("_cut"), r"\n"))
    parts = F.filter(F.transform(F.split(_dated(F.col("_cut")), r" ?\n ?"), lambda p: _named(p, F.col("name"))), lambda p: ~p.isin("", "#"))
    return rows.select(
        "path", "who", "named", "site", "n", F.when(F.col("t") == "", 0).otherwise(F.xxhash64("t")).alias("k"), F.nullif("t", F.lit("")).alias("t"),
        F.coalesce(F.col("t") == F.col("own"), F.lit(False)).alias("title"), item.alias("item"), bare.alias("bare"), rank.alias("rank"), "near", parts.alias("parts"),
    ).withColumn("pk", F.when(F.size("parts") > 0, F.xxhash64("parts")))


class _Sizes:
    """Pages by host, counting an article given again once, and how many hosts are large enough to show a recurrence."""

    def __init__(self, every: DataFrame) -> None:
        self.of = cut(every.where("n = 0").select("site", "who").distinct().groupBy("site").agg(F.count(F.lit(1)).alias("pages")))
        small = F.col("pages") < MIN_PAGES
        r = self.of.agg(F.sum("pages"), F.sum(F.when(small, F.col("pages"))), F.count_if(F.col("pages") >= OWN_PAGES), F.count_if(small), F.max("pages")).first()
        self.total, self.small, self.large_hosts, self.small_hosts, self.largest = float(r[0] or 0), float(r[1] or 0), r[2], r[3], int(r[4] or 0)

    def own(self, counts: DataFrame) -> DataFrame:
        """(site, k) of hosts' own items. counts: (site, k, c), c of a host's pages having k."""
        strong = F.col("c") >= F.greatest(F.lit(MIN_PAGES), HOST_SHARE * F.col("pages"))
        return counts.where(f"k <> 0 and c >= {MIN_PAGES}").join(broadcast_if_small(self.of), "site").where(strong).select("site", "k")

    def family(self, own: DataFrame, counts: DataFrame) -> DataFrame:
        """(k) of the family's: items of enough of the hosts that can show it, or on enough of the others."""
        on_large = own.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(2.0, FAMILY_SHARE * self.large_hosts)).select("k")
        loose = flagged(counts.where("k <> 0"), own.withColumn("own", F.lit(True)), ["site", "k"]).where("own is null").drop("own")
        on_small = flagged(loose, self.of, ["site"]).groupBy("k").agg(F.sum("c").alias("c"), F.count_if(F.col("pages") < MIN_PAGES).alias("small"))
        on_small = on_small.where((F.col("small") >= max(float(MIN_PAGES), FAMILY_SHARE / 3 * self.small_hosts)) & (F.col("small") * self.total >= SMALL_TIMES * F.col("c") * self.small))
        return on_large.unionByName(on_small.select("k")).distinct()


def _counts(rows: DataFrame) -> DataFrame:
    """(site, k, c): pages of each host with k. The lines of a page lie in one task, so repeats go before the shuffle."""
    return rows.select("who", "site", "k").distinct().groupBy("site", "k").agg(F.count(F.lit(1)).alias("c"))


def _layouts(every: DataFrame, counts: DataFrame, per_host: DataFrame) -> DataFrame:
    """(site, k) of lines on few of a large host's pages that lie beside one and the same line on most of them, under different titles: items of a rare layout, not of an article given again."""
    rare = cut(counts.where(f"c >= {MIN_PAGES} and k <> 0").join(broadcast_if_small(per_host), ["site", "k"], "left_anti"))
    at = every.join(broadcast_if_small(rare), ["site", "k"]).select("site", "k", "c", "named", F.explode("near").alias("x")).distinct()
    return at.groupBy("site", "k", "c", "x").agg(F.count(F.lit(1)).alias("m")).where(f"m >= {MIN_PAGES} and m >= {PLACE_SHARE} * c").select("site", "k").distinct()


def _wildcards(texts: DataFrame, rest: DataFrame, sizes: _Sizes) -> tuple[DataFrame, DataFrame]:
    """Lines that recur but for one word, a text slot, whatever it holds: (site, k, key) on hosts of their own, and (k, key) of the family; key is the line's but for that word. texts: (k, t, c), c on all hosts; rest: (site, k, c).

    Lines that agree but for one word agree in one whole half. Only those whose half stands on MIN_PAGES pages in several lines are
    laid out by the words of their other half; the rest can't recur with a slot.
    """
    w = F.split("t", " ")
    one = texts.where(F.size(w) >= SLOT_WORDS).select("k", "c", F.transform(w, lambda x, i: F.xxhash64(x, i)).alias("h"))
    m = F.floor(F.size("h") / 2).cast("int")
    half = lambda side, at, n: F.struct(F.xxhash64(F.lit(side), F.size("h"), F.slice("h", at, n)).alias("half"), F.lit(side).alias("side"))
    halved = one.withColumn("_h", F.explode(F.array(half(0, F.lit(1), m), half(1, m + 1, F.size("h"))))).select("k", "c", "h", "_h.*")
    shared = halved.groupBy("half").agg(F.min("k").alias("a"), F.max("k").alias("b"), F.sum("c").alias("c")).where(f"a <> b and c >= {MIN_PAGES}").select("half", F.lit(True).alias("_s"))
    met = flagged(halved, cut(shared), ["half"]).where("_s")
    whole = F.aggregate("h", F.size("h").cast("long"), lambda a, h: a.bitwiseXOR(h))
    holes = F.transform("h", lambda h, i: F.xxhash64(F.col("whole").bitwiseXOR(h), i))  # all words but one
    holes = F.when(F.col("side") == 0, F.slice(holes, m + 1, F.size("h"))).otherwise(F.slice(holes, F.lit(1), m))
    keyed = cut(met.withColumn("whole", whole).select(F.col("k").alias("line"), F.explode_outer(holes).alias("k")))
    held = cut(keyed.join(rest.select("site", "c", F.col("k").alias("line")), "line").groupBy("site", "k").agg(F.sum("c").alias("c")))
    varied = held.groupBy("k").agg(F.sum("c").alias("c")).where(f"c >= {MIN_PAGES}").select("k", F.lit(True).alias("_v"))
    held = cut(flagged(held, cut(varied), ["k"]).where("_v").select("site", "k", "c"))
    own = cut(sizes.own(held))
    family = sizes.family(own, held)
    line = lambda d, *by: d.groupBy(*by, F.col("line").alias("k")).agg(F.min("key").alias("key"))
    named = keyed.select("line", F.col("k").alias("key"))
    own = named.join(own.select("site", F.col("k").alias("key")), "key").join(rest.select("site", F.col("k").alias("line")), ["site", "line"])
    return line(own, "site"), line(named.join(broadcast_if_small(cut(family.select(F.col("k").alias("key")))), "key"))


def common_words(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bits of one number (Hyyrö)."""
    at: dict[str, int] = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    every = v = (1 << len(b)) - 1
    for x in a:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & every
    return len(b) - v.bit_count()


def _slots(rest: DataFrame, wrapper: DataFrame) -> DataFrame:
    """(k, key): templates of rest that are wrapper lines but for text slots, each with the hashes of those. Both: (k, t).

    Where SLOT_SHARE of both lines' words agree in order, the lines have `least` of the words of either in common, wherever those
    stand, and neither has less than `least` times the other's words. So in any one order of words, here the rarest of the wrapper
    first, what is left of each line without its last `least` * words - 1 shares a word (prefix filter); and from the first such word
    on, enough words are left. No pair is lost.
    """
    least = SLOT_SHARE / (2 - SLOT_SHARE)

    def said(d: DataFrame, most: int | None = None) -> DataFrame:
        """Lines of SLOT_WORDS to `most` words by word. Each line is split once: words are counted by blanks, and outer needs no filter of empty arrays."""
        w = F.length("t") - F.length(F.replace("t", F.lit(" "), F.lit(""))) + 1
        d = d.where(w >= SLOT_WORDS) if most is None else d.where(w.between(SLOT_WORDS, most))
        return d.select("k", F.transform(F.split("t", " "), lambda x: F.xxhash64(x)).alias("g")).select("k", F.size("g").alias("w"), F.explode_outer("g").alias("g"))

    known = cut(said(wrapper))
    rare = cut(known.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("lo"), F.max("w").alias("hi")))
    most = int((rare.agg(F.max("hi")).first()[0] or 0) / least + 1e-9)
    rare = broadcast_if_small(rare)

    def rarest(d: DataFrame) -> DataFrame:
        near = F.expr(f"hi >= {least} * w - 1e-9 and w >= {least} * lo - 1e-9")  # a wrapper line with the word is long and short enough
        r = d.join(rare, "g").where(near).groupBy("k", "w").agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("r"))
        r = r.withColumn("spare", F.size("r") - F.ceil(least * F.col("w") - 1e-9).cast("int") + 1).where("spare > 0")
        return r.select("k", "w", F.size("r").alias("m"), F.posexplode_outer(F.slice("r.g", F.lit(1), F.col("spare"))).alias("i", "g")).groupBy("k", "w", "m", "g").agg(F.min("i").alias("i"))

    b = rarest(known).select(F.col("k").alias("fk"), F.col("w").alias("fw"), F.col("m").alias("fm"), F.col("i").alias("fi"), "g")
    met = rarest(said(rest, most)).join(broadcast_if_small(cut(b)), "g").where(f"least(m - i, fm - fi) >= {SLOT_SHARE / 2} * (w + fw) - 1e-9")
    pairs = met.select("k", "fk").distinct().join(rest.select("k", "t"), "k").join(wrapper.select(F.col("k").alias("fk"), F.col("t").alias("ft")), "fk")

    @F.pandas_udf("boolean")
    def agree(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([2 * common_words(u := a.split(), v := b.split()) >= SLOT_SHARE * (len(u) + len(v)) - 1e-9 for a, b in zip(x, y, strict=True)], dtype="bool")

    return pairs.where(agree("t", "ft")).select("k", F.col("fk").alias("key"))


class Wrapper:
    """An expression: items in order, and of each how its pages bear it out.

    pages: pages that have it; sure: those of them on which it needs no evidence of place; beside: those on which it lies beside a sure item
    or an end of the text; runs, lists, reach, clean: runs of lines behind it that could be entries of a list, those of two or more, their sum,
    and the longest that the structure of its page ends.
    """

    STATS = ("pages", "sure", "beside", "runs", "lists", "reach", "clean")

    def __init__(self) -> None:
        self.keys: list[int] = []
        self.stats: list[list[int]] = []
        self.at: dict[int, list[int]] = {}

    def align(self, keys: Sequence[int]) -> list[int]:
        """The place of each key, -1 where it has none: a longest common subsequence with the expression."""
        ends: list[int] = []
        last: list[tuple[int, int]] = []  # (key's index, place) of the end of the best chain of each length
        back: dict[tuple[int, int], tuple[int, int] | None] = {}
        for j, key in enumerate(keys):
            for p in reversed(self.at.get(key, ())):
                n = bisect_left(ends, p)
                back[j, p] = last[n - 1] if n else None
                if n == len(ends):
                    ends.append(p)
                    last.append((j, p))
                elif p < ends[n]:
                    ends[n], last[n] = p, (j, p)
        out = [-1] * len(keys)
        step = last[-1] if last else None
        while step:
            out[step[0]] = step[1]
            step = back[step]
        return out

    def add(self, keys: Sequence[int], stats: Sequence[Sequence[int]]) -> None:
        """Aligns a page's items, or another wrapper's, and merges them."""
        places = self.align(keys)
        if -1 in places:
            new_keys: list[int] = []
            new_stats: list[list[int]] = []
            taken = 0
            for j, p in enumerate(places):
                if p >= 0:
                    new_keys += self.keys[taken : p + 1]
                    new_stats += self.stats[taken : p + 1]
                    taken = p + 1
                    places[j] = len(new_keys) - 1
                else:
                    new_keys.append(keys[j])
                    new_stats.append([0] * len(self.STATS))
                    places[j] = len(new_keys) - 1
            self.keys, self.stats = new_keys + self.keys[taken:], new_stats + self.stats[taken:]
            self.at = {}
            for p, key in enumerate(self.keys):
                self.at.setdefault(key, []).append(p)
        for p, one in zip(places, stats, strict=True):
            mine = self.stats[p]
            for i, v in enumerate(one[:-1]):
                mine[i] += v
            mine[-1] = max(mine[-1], one[-1])


def _run(key: Sequence[int], item: Sequence[bool], rank: Sequence[int], i: int) -> int:
    """Lines that follow line i and could be entries of a list: as far as their numbers run, or up to an item or a paragraph."""
    n = len(key)
    j = i + 1
    if j < n and rank[j] == 1:
        while j < n and rank[j] == j - i:
            j += 1
    else:
        while j < n and not key[j] and item[j]:
            j += 1
    return j - i - 1


def page_stats(key: Sequence[int], sure: Sequence[int], title: Sequence[bool], item: Sequence[bool], rank: Sequence[int]) -> tuple[list[int], list[list[int]]]:
    """The items of a page and what each says (Wrapper.STATS). key is 0 for lines that are no items; sure: 0 if an item needs evidence of
    place, 1 if it doesn't but may be an entry of a list, 2 if it ends a list."""
    n = len(key)
    stop = [k if s == 2 else 0 for k, s in zip(key, sure, strict=True)]
    first = next((i for i in range(n) if title[i]), n)
    keys, stats = [], []
    for i in range(n):
        if not key[i]:
            continue
        run = _run(stop, item, rank, i)
        end = i + 1 + run
        clean = run > 0 and i > first and (end == n or stop[end]) and not rank[i + 1]
        beside = i == 0 or i == n - 1 or bool(key[i - 1] and sure[i - 1]) or bool(key[i + 1] and sure[i + 1])
        keys.append(key[i])
        stats.append([1, int(sure[i] > 0), int(beside), 1, int(run >= 2), run, run if clean else 0])
    return keys, stats


def entries(frame: Sequence[bool], stop: Sequence[bool], most: Sequence[int | None], title: Sequence[bool], item: Sequence[bool], rank: Sequence[int]) -> set[int]:
    """Places of the entries of a page's lists. stop: items that are no entries themselves; most, of a line that heads a list: the longest list that ends by structure; None of any other line.

    Numbered entries run as far as the numbers. Others run to the page's own title, or to the next item or the end of the text; where a
    paragraph ends them, which may have a head of its own, they are as many as the longest list of that head.
    """
    out: set[int] = set()
    n = len(frame)
    titles = [i for i in range(n) if title[i]]
    for i in range(n):
        if not frame[i] or most[i] is None:
            continue
        end = i + 1 + _run(stop, item, rank, i)
        own = next((t for t in titles if i < t < end), None)
        if end > i + 1 and rank[i + 1] == 1:
            pass
        elif own is not None:
            end = own
        elif end < n and not frame[end] and end not in titles:
            if not titles and end - i > 2:
                end -= 1  # what stands before the first paragraph is the title
            if most[i]:
                end = min(end, i + 1 + most[i])
        out.update(range(i + 1, end))
    return out


_COLS = ("key", "sure", "title", "item", "rank")
_NODES = "site long, chunk int, key array<long>, " + ", ".join(f"{c} array<int>" for c in Wrapper.STATS)


def _by_page(rows: DataFrame) -> DataFrame:
    """A page's lines in order, each of _COLS an array."""
    r = rows.groupBy("site", "path").agg(F.array_sort(F.collect_list(F.struct("n", "k", *_COLS))).alias("r"))
    return r.select("site", "path", *(F.col(f"r.{c}").alias(c) for c in ("k", *_COLS)))


def _laid(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("site", "chunk").sortWithinPartitions("site", "chunk", *order)


def _wrappers(paged: DataFrame, largest: int) -> DataFrame:
    """_NODES: the wrapper of each site, chunk 0. paged: (site, chunk, path, *_COLS)."""

    def grown(batches: Iterable[pd.DataFrame], columns: Sequence[str], read) -> Iterator[pd.DataFrame]:
        every = (row for b in batches for row in zip(*(b[c] for c in ("site", "chunk", *columns)), strict=True))
        out: list[tuple] = []
        for (site, chunk), group in groupby(every, key=lambda r: (r[0], r[1])):
            w = Wrapper()
            for r in group:
                w.add(*read(*r[2:]))
            out.append((site, chunk, w.keys, *([s[i] for s in w.stats] for i in range(len(Wrapper.STATS)))))
            if len(out) >= 1000:
                yield pd.DataFrame(out, columns=["site", "chunk", "key", *Wrapper.STATS])
                out = []
        yield pd.DataFrame(out, columns=["site", "chunk", "key", *Wrapper.STATS])

    def of_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return grown(batches, _COLS, lambda *c: page_stats(*(x.tolist() for x in c)))

    def of_wrappers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return grown(batches, ("key", *Wrapper.STATS), lambda key, *stats: (key.tolist(), list(zip(*(s.tolist() for s in stats), strict=True))))

    nodes = cut(_laid(paged.select("site", "chunk", "path", *_COLS), "path").mapInPandas(of_pages, _NODES))
    chunks = -(-largest // CHUNK_PAGES)
    while chunks > 1:
        chunks = -(-chunks // FAN_IN)
        joint = nodes.withColumnRenamed("chunk", "part").withColumn("chunk", F.floor(F.col("part") / FAN_IN).cast("int"))
        nodes = cut(_laid(joint, "part").mapInPandas(of_wrappers, _NODES))
    return nodes


def wrappers(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(paged, items, texts, groups): pages by line; the items of every site's expression; the templates they stand for; and which are groups.

    paged: (site, chunk, path, k, *_COLS). items: (site, pos, key, pages, of, kept, most): the item's place, how many pages of how many
    have it, whether it is frame, and for the head of a repeated group the longest list that ends by structure (NULL: no head). texts: (key, t, slot).
    groups: (site, key) of lines of several parts that are all known, items of their own or not.
    """
    every = cut(lines(newest(pages)))
    sizes = _Sizes(every)
    counts = cut(_counts(every))
    strong = cut(sizes.own(counts))
    rare = _layouts(every, counts, strong).withColumn("soft", F.lit(True))
    per_host = cut(strong.withColumn("soft", F.lit(False)).unionByName(rare))
    family = cut(sizes.family(strong, counts))
    yes = lambda d, name: d.withColumn(name, F.lit(True))

    # groups of parts: a part is known as a line of its own, or recurs as a part
    kinds = cut(every.where("pk is not null").groupBy("site", "pk").agg(F.count(F.lit(1)).alias("c"), F.first("parts").alias("parts")))
    cells = cut(kinds.select("site", "pk", "c", F.size("parts").alias("m"), F.explode("parts").alias("t")).withColumn("k", F.xxhash64("t")))
    part_counts = cut(cells.where("m > 1 and instr(t, '#') = 0").groupBy("site", "k").agg(F.sum("c").alias("c")))
    part_host = cut(sizes.own(part_counts))
    as_part = cut(family.unionByName(sizes.family(part_host, part_counts)).distinct())
    here = cut(per_host.select("site", "k").unionByName(part_host).distinct())
    grouped = flagged(flagged(cells, yes(as_part, "ok"), ["k"]), yes(here, "here"), ["site", "k"])
    grouped = cut(grouped.groupBy("site", "pk").agg(F.every(F.coalesce("ok", "here", F.lit(False))).alias("all")).where("all").select("site", "pk"))
    # menus without signs between their entries: every word is one of short entries
    texts = cut(every.where("t is not null").groupBy("k", "t").agg(F.max("item").alias("bare")))
    entry = texts.select("k", "t").unionByName(cells.select("k", "t").distinct()).where("size(split(t, ' ')) <= 3").join(as_part.unionByName(here.select("k")).distinct(), "k", "left_semi")
    entry = yes(cut(entry.select(F.explode_outer(F.split("t", " ")).alias("w")).distinct()), "is")
    spaced = flagged(texts.where("bare and size(split(t, ' ')) >= 4 and instr(t, '#') = 0").select("k", "t", F.substring_index("t", " ", 1).alias("w")), entry, ["w"]).where("is")
    menus = flagged(spaced.select("k", F.explode_outer(F.split("t", " ")).alias("w")), entry, ["w"]).groupBy("k").agg(F.every(F.coalesce("is", F.lit(False))).alias("all")).where("all").select("k")
    menus = cut(menus)
    groups = every.where("size(parts) > 1").select("site", "pk", "k").distinct().join(grouped, ["site", "pk"]).select("site", "k")
    groups = groups.unionByName(counts.join(broadcast_if_small(menus), "k").select("site", "k")).distinct().withColumnRenamed("k", "key")

    marked = flagged(flagged(flagged(every, yes(as_part, "f"), ["k"]), yes(per_host, "h"), ["site", "k"]), yes(grouped, "g"), ["site", "pk"])
    marked = cut(flagged(marked, yes(menus, "m"), ["k"]).select("path", "site", "n", "k", "title", "item", F.coalesce("rank", F.lit(0)).alias("rank"), "f", "h", "soft", F.coalesce("g", "m").alias("g")))
    # text slots: lines that recur but for one word; then lines like those known
    open_here = marked.where("f is null and h is null and g is null and k <> 0").select("site", "k").distinct()
    rest = cut(counts.join(open_here, ["site", "k"], "left_semi"))
    open_texts = cut(rest.groupBy("k").agg(F.sum("c").alias("c")).join(texts.select("k", "t"), "k"))
    holed_here, holed = map(cut, _wildcards(open_texts, rest, sizes))
    holed_any = cut(holed.select("k").unionByName(holed_here.select("k")).distinct())
    known = cut(as_part.unionByName(per_host.select("k")).unionByName(holed_any).distinct())
    said = flagged(texts.select("k", "t"), yes(known, "known"), ["k"]).where("known").select("k", "t")
    alike = cut(_slots(flagged(open_texts.select("k", "t"), yes(holed_any, "x"), ["k"]).where("x is null").select("k", "t"), said))
    slot_here = rest.select("site", "k").join(broadcast_if_small(alike), "k").join(broadcast_if_small(cut(per_host.select("site", F.col("k").alias("key")))), ["site", "key"]).groupBy("site", "k").agg(F.min("key").alias("key"))
    slots = alike.groupBy("k").agg(F.min("key").alias("key")).unionByName(holed.select("k", "key"))
    own_slots = cut(holed_here.unionByName(slot_here).groupBy("site", "k").agg(F.min("key").alias("a")))
    group = F.xxhash64(F.lit("group"))
    marked = flagged(flagged(marked, own_slots, ["site", "k"]), cut(slots.groupBy("k").agg(F.min("key").alias("b"))), ["k"])
    key = F.when(F.col("h"), F.col("k")).when(F.col("g"), group).when(F.col("f"), F.col("k")).otherwise(F.coalesce("a", "b", F.lit(0)))
    marked = flagged(marked.withColumn("key", F.when(F.col("k") == 0, 0).otherwise(key)), sizes.of, ["site"])
    sure = F.when(F.col("soft"), 1).when(F.coalesce("h", "g", F.col("a").isNotNull() | (F.col("pages") < OWN_PAGES)), 2).otherwise(0)
    paged = _by_page(marked.select("site", "path", "n", "k", "key", sure.alias("sure"), "title", "item", "rank"))
    chunks = F.ceil(F.col("pages") / CHUNK_PAGES)
    paged = cut(flagged(paged, sizes.of, ["site"]).withColumn("chunk", F.pmod(F.xxhash64("path"), chunks).cast("int")).drop("pages"))

    nodes = _wrappers(paged, sizes.largest)
    each = nodes.select("site", F.posexplode(F.arrays_zip("key", *Wrapper.STATS)).alias("pos", "x")).select("site", "pos", "x.*")
    each = cut(flagged(each, sizes.of.withColumnRenamed("pages", "of"), ["site"]))
    kept = F.greatest("sure", "beside") >= PLACE_SHARE * F.col("pages")
    heads = lambda d, *by: d.groupBy(*by, "key").agg(*(F.sum(c).alias(c) for c in ("runs", "lists", "reach")), F.max("clean").alias("clean")).where(f"runs >= {MIN_PAGES}")
    most = lambda d, name: d.select(*(c for c in ("site", "key") if c in d.columns), F.when((F.col("lists") >= 0.9 * F.col("runs")) & (F.col("reach") >= 2 * F.col("runs")), F.col("clean")).alias(name))
    own, of_all = most(heads(each, "site"), "here"), most(heads(each), "any")
    items = flagged(flagged(each.withColumn("kept", kept), cut(own), ["site", "key"]), cut(of_all), ["key"])
    # what a host's own lists show counts; where they are too few or mixed with items, those of all hosts
    items = items.withColumn("most", F.coalesce("here", "any"))
    items = cut(items.select("site", "pos", "key", "pages", "of", "kept", "most"))
    named = texts.select(F.col("k").alias("key"), "t", F.lit(False).alias("slot")).unionByName(slots.select("key", "k").unionByName(own_slots.select(F.col("a").alias("key"), "k")).join(texts.select("k", "t"), "k").select("key", "t", F.lit(True).alias("slot")))
    return paged, items, named, groups


def frame(pages: DataFrame) -> DataFrame:
    """(path, line_no, frame): every line of every text, and whether it belongs to the site's frame. pages: (path, html, texte, loaded_at or not).

    Pages without a path or text have no lines. Of several loads of a path the last one's text counts. Blank lines are no frame.
    """
    paged, items, _, _ = wrappers(pages)
    empty = lambda t: F.array().cast(f"array<{t}>")
    rows = paged.select("site", "chunk", F.lit(1).alias("o"), "path", "k", "key", "sure", "title", "item", "rank", empty("boolean").alias("kept"), empty("int").alias("most"))
    inner = F.array_sort(F.collect_list(F.struct("pos", "key", "kept", "most")))
    heads = items.groupBy("site").agg(inner.alias("r")).join(paged.select("site", "chunk").distinct(), "site")
    heads = heads.select("site", "chunk", F.lit(0).alias("o"), F.lit("").alias("path"), empty("long").alias("k"), F.col("r.key").alias("key"), empty("int").alias("sure"), empty("boolean").alias("title"), empty("boolean").alias("item"), empty("int").alias("rank"), F.col("r.kept").alias("kept"), F.transform("r.most", lambda m: F.coalesce(m, F.lit(-1))).alias("most"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, kept, most = Wrapper(), [], []
        for b in batches:
            out = []
            for site, o, path, k, key, sure, title, item, rank, ok, longest in zip(*(b[c] for c in ("site", "o", "path", "k", "key", "sure", "title", "item", "rank", "kept", "most")), strict=True):
                if not o:
                    w = Wrapper()
                    w.keys = key.tolist()
                    for p, x in enumerate(w.keys):
                        w.at.setdefault(x, []).append(p)
                    kept, most = ok.tolist(), longest.tolist()
                    continue
                key, k = key.tolist(), k.tolist()
                at = [i for i, x in enumerate(key) if x]
                framed = [False] * len(key)
                heads: list[int | None] = [None] * len(key)
                for i, p in zip(at, w.align([key[i] for i in at]), strict=True):
                    if p >= 0 and kept[p]:
                        framed[i] = True
                        heads[i] = most[p] if most[p] >= 0 else None
                stop = [f and s != 1 for f, s in zip(framed, sure.tolist(), strict=True)]
                gone = entries(framed, stop, heads, title.tolist(), item.tolist(), rank.tolist())
                left = [i for i, f in enumerate(framed) if not f and i not in gone]
                out += [(path, site, i, k[i], f or i in gone, left == [i]) for i, f in enumerate(framed)]
            yield pd.DataFrame(out, columns=["path", "site", "n", "k", "frame", "only"])

    final = cut(_laid(rows.unionByName(heads), "o").mapInPandas(read, "path string, site long, n int, k long, frame boolean, only boolean"))
    alone = cut(final.where("only").groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.count_distinct("site").alias("hosts")))
    least = NOTICE_SHARE * (alone.agg(F.sum("c")).first()[0] or 0)
    notices = cut(alone.where((F.col("hosts") >= 2) & (F.col("c") >= max(3.0, least))).select("k", F.lit(True).alias("notice")))
    return flagged(final, notices, ["k"]).select("path", F.col("n").alias("line_no"), (F.col("frame") | (F.col("only") & F.coalesce("notice", F.lit(False)))).alias("frame"))


def expressions(pages: DataFrame) -> DataFrame:
    """(site, pos, kind, template, pages, of, most): the items of every site's wrapper in order; any text may stand between them.

    kind: `fixed` if all pages have it, `optional`, `slot` for lines that agree but for words, `group` for menus; most: the longest list
    behind a head. site is a hash.
    """
    _, items, texts, groups = wrappers(pages)
    texts = texts.groupBy("key").agg(F.min("t").alias("template"), F.every("slot").alias("slot"))
    menu = F.coalesce("menu", F.col("key") == F.xxhash64(F.lit("group")))
    kind = F.when(menu, "group").when(F.col("slot"), "slot").when(F.col("pages") >= F.col("of"), "fixed").otherwise("optional")
    named = flagged(items.where("kept"), cut(texts), ["key"])
    return flagged(named, cut(groups.withColumn("menu", F.lit(True))), ["site", "key"]).select("site", "pos", kind.alias("kind"), "template", "pages", "of", "most")


def articles(pages: DataFrame, framed: DataFrame) -> DataFrame:
    """(path, article): each text without its frame; "" if nothing is left. Pages without text have no row."""
    body = newest(pages).select("path", F.posexplode(F.split("texte", "\n")).alias("line_no", "line")).join(framed, ["path", "line_no"])
    kept = F.array_sort(F.collect_list(F.when(~F.col("frame"), F.struct("line_no", "line"))))
    return body.groupBy("path").agg(F.array_join(F.transform(kept, lambda r: r["line"]), "\n").alias("article"))

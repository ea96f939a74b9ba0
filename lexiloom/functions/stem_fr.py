"""The published Snowball stemming algorithm for French, run once a distinct word of a batch."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = "aeiouyâàëéêèïîôûù"


def _longest(text: str) -> re.Pattern[str]:
    """Matches the longest of the endings at the end of a word."""
    return re.compile("(?:" + "|".join(sorted(text.split(), key=len, reverse=True)) + r")\Z")


# Endings, marked vowels (I, U, Y: not vowels here) and exceptions of the published algorithm.
PLAIN = "ance iqUe isme able iste eux ances iqUes ismes ables istes"
AGENT = "atrice ateur ation atrices ateurs ations"
LOGY = "logie logies"
USION = "usion ution usions utions"
ENCE = "ence ences"
EMENT = "ement ements"
ITY = "ité ités"
IVE = "if ive ifs ives"
EUSE = "euse euses"
ISSEMENT = "issement issements"
MENT = "ment ments"
ANY_STANDARD = _longest(" ".join((PLAIN, AGENT, LOGY, USION, ENCE, EMENT, ITY, IVE, "eaux aux", EUSE, ISSEMENT, "amment emment", MENT)))
I_VERB = _longest(
    "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant"
    " issante issantes issants isse issent isses issez issiez issions issons it"
)
E_VERB = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez"
A_VERB = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions"
ANY_VERB = _longest(f"ions {E_VERB} {A_VERB}")
RESIDUAL = _longest("ion ier ière Ier Ière e ë")
DOUBLED = _longest("enn onn ett ell eill")
WHOLE_START = ("par", "col", "tap")
GROUP = {e: g for g in (PLAIN, AGENT, LOGY, USION, ENCE, EMENT, ITY, IVE, EUSE, ISSEMENT, MENT) for e in g.split()}

_V = f"[{VOWELS}]"
_MARK = (
    (re.compile(f"(?<=q)u|(?<={_V})u(?={_V})"), "U"),
    (re.compile(f"(?<={_V})i(?={_V})"), "I"),
    (re.compile(f"(?<={_V})y|y(?={_V})"), "Y"),
)
_REGION = re.compile(f"{_V}[^{VOWELS}]")
_RV = re.compile(f"(?<!^){_V}")
_ACCENT = re.compile(f"[éè](?=[^{VOWELS}]+\\Z)")


class _Word:
    def __init__(self, word: str) -> None:
        for pattern, to in _MARK:
            word = pattern.sub(to, word)
        self.s = word
        n = len(word)
        m = _REGION.search(word)
        self.r1 = m.end() if m else n
        m = _REGION.search(word, self.r1)
        self.r2 = m.end() if m else n
        if word.startswith(WHOLE_START) or (n > 1 and word[0] in VOWELS and word[1] in VOWELS):
            self.rv = min(3, n)
        else:
            m = _RV.search(word, 1)
            self.rv = m.end() if m else n

    def drop(self, ending: str, region: int, to: str = "") -> bool:
        """Replaces the ending if the word has it within the region."""
        if not self.s.endswith(ending) or len(self.s) - len(ending) < region:
            return False
        self.s = self.s[: len(self.s) - len(ending)] + to
        return True

    def drop_or(self, ending: str, to: str, region: int = 0) -> None:
        """Drops the ending in R2, else replaces it within the other region."""
        self.drop(ending, self.r2) or self.drop(ending, region, to)

    def standard(self) -> tuple[bool, bool]:
        """(an ending went, verbs are still to be tried)."""
        m = ANY_STANDARD.search(self.s)
        if not m:
            return False, True
        e = m[0]
        g = GROUP.get(e)
        done = False
        if g == PLAIN:
            done = self.drop(e, self.r2)
        elif g == AGENT:
            if done := self.drop(e, self.r2):
                self.drop_or("ic", "iqU")
        elif g == LOGY:
            done = self.drop(e, self.r2, "log")
        elif g == USION:
            done = self.drop(e, self.r2, "u")
        elif g == ENCE:
            done = self.drop(e, self.r2, "ent")
        elif g == EMENT:
            if done := self.drop(e, self.rv):
                self._after_ement()
        elif g == ITY:
            if done := self.drop(e, self.r2):
                self._after_ity()
        elif g == IVE:
            if done := self.drop(e, self.r2):
                if self.drop("at", self.r2):
                    self.drop_or("ic", "iqU")
        elif e == "eaux":
            done = self.drop(e, 0, "eau")
        elif e == "aux":
            done = self.drop(e, self.r1, "al")
        elif g == EUSE:
            done = self.drop(e, self.r2) or self.drop(e, self.r1, "eux")
        elif g == ISSEMENT:
            k = len(self.s) - len(e)
            done = k > 0 and self.s[k - 1] not in VOWELS and self.drop(e, self.r1)
        elif e in ("amment", "emment"):
            return self.drop(e, self.rv, "ant" if e == "amment" else "ent"), True
        else:
            k = len(self.s) - len(e)
            return k - 1 >= self.rv and self.s[k - 1] in VOWELS and self.drop(e, self.rv), True
        return done, not done

    def _after_ement(self) -> None:
        if self.s.endswith("iv"):
            if self.drop("iv", self.r2):
                self.drop("at", self.r2)
        elif self.s.endswith("eus"):
            self.drop_or("eus", "eux", self.r1)
        elif self.s.endswith(("abl", "iqU")):
            self.drop(self.s[-3:], self.r2)
        elif self.s.endswith(("ièr", "Ièr")):
            self.drop(self.s[-3:], self.rv, "i")

    def _after_ity(self) -> None:
        if self.s.endswith("abil"):
            self.drop_or("abil", "abl")
        elif self.s.endswith("ic"):
            self.drop_or("ic", "iqU")
        else:
            self.drop("iv", self.r2)

    def verbs(self) -> bool:
        m = I_VERB.search(self.s, self.rv)
        if m and m.start() > self.rv and self.s[m.start() - 1] not in VOWELS:
            return self.drop(m[0], self.rv)
        m = ANY_VERB.search(self.s, self.rv)
        if not m:
            return False
        if m[0] == "ions":
            return self.drop("ions", self.r2)
        self.drop(m[0], self.rv)
        if m[0] in A_VERB.split():
            self.drop("e", self.rv)
        return True

    def residual(self) -> None:
        if len(self.s) > 1 and self.s[-1] == "s" and self.s[-2] not in "aiouès":
            self.s = self.s[:-1]
        m = RESIDUAL.search(self.s, self.rv)
        if not m:
            return
        e, k = m[0], m.start()
        if e == "ion":
            if k > self.rv and self.s[k - 1] in "st":
                self.drop(e, self.r2)
        elif e == "e":
            self.drop(e, self.rv)
        elif e == "ë":
            if self.s[:k].endswith("gu"):
                self.drop(e, self.rv)
        else:
            self.drop(e, self.rv, "i")


def stem_word(word: str) -> str:
    """The stem of a lower-case word; "" gives ""."""
    w = _Word(word)
    changed, go_on = w.standard()
    if go_on:
        changed = w.verbs() or changed
    if changed:
        if w.s.endswith(("Y", "ç")):
            w.s = w.s[:-1] + ("i" if w.s[-1] == "Y" else "c")
    else:
        w.residual()
    if DOUBLED.search(w.s):
        w.s = w.s[:-1]
    w.s = _ACCENT.sub("e", w.s)
    return w.s.replace("I", "i").replace("U", "u").replace("Y", "y")


def stem(word: Column) -> Column:
    """NULL stays NULL."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map({w: stem_word(w) for w in x.dropna().unique()})

    return run(word)

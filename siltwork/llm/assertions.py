"""What a claim asserts, apart from how it is worded, spelled and quoted.

A claim is reduced to its anchor (figures, names, negation), which a repeat must share exactly, and to its content
words, which a repeat may misspell. Wording that only frames an assertion or says how a figure moved is left out or
brought to one form.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import regex

# Words of no content, among them the verbs of reporting and the framing of claims.
PLAIN = frozenset(
    """a an the of in on at by for to from over during through with via within per and or as that this these those it its their
    his her our we i you they he she was were is are be been being has have had do did does will would can could may might
    there here then so also just now again all any each every some such own same than into onto about after before since
    until while when where who which what how much many one two year years end percent percentage cent points point pct
    overall total full stop surprised me looked look books say says said saying state stated states report reported reports
    reporting announce announced announces note noted notes noticed notice found finds find according see guest episode letter
    transcript discussed mentioned quoted quote claim claims claimed fact facts told tells tell and because due thanks
    regarding among amid against out off up down went go goes took take takes brought bring brings effect effects such
    et le la les de du des un une en au aux par pour sur dans que qui il elle est a été der die das den dem des ein eine im
    am von vom und mit für auf bei nach el los las un una y por para con del al se su es fue ha""".split()
)
#: Words the list above holds but that carry content in what is counted.
CONTENT = frozenset("notes among abroad letters claims".split())
# Verbs and adverbs of rising and falling.
UP = frozenset("rose rise rises risen rising climbed climb climbs increased increase increases grew grow grows grown gained gain gains up higher jumped raised raise raises improved expanded".split())
DOWN = frozenset("fell fall falls fallen falling dropped drop drops declined decline declines decreased decrease decreases cut cuts cutting reduced reduce reduces reducing lowered lower lowers shrank shrink shrunk down slid sank trimmed lost".split())
# Words that deny.
NOT = frozenset("not no never none without neither nor cannot nicht kein keine nie pas jamais aucun sin nunca ningún didn't doesn't wasn't isn't don't hasn't haven't won't didn’t doesn’t wasn’t isn’t".split())

NUMBER = regex.compile(r"\d+(?:[.,]\d+)*")
TOKEN = regex.compile(r"\d+(?:[.,]\d+)*|[\p{L}\p{M}]+(?:[’'][\p{L}\p{M}]+)*")
HIDDEN = regex.compile(r"[\p{Cf}\p{Cc}]+")


def clean(text: str | None) -> str:
    """Compatibility forms, no invisible characters, single spaces."""
    if not text:
        return ""
    text = HIDDEN.sub(lambda m: " " if any(c in "\t\n\r" for c in m.group()) else "", unicodedata.normalize("NFKC", text))
    return " ".join(text.split())


def figure(text: str) -> str:
    """A number in one form: no grouping commas, a point before decimals, no trailing zeros after it."""
    if regex.fullmatch(r"\d{1,3}(?:,\d{3})+(?:\.\d+)?", text):
        text = text.replace(",", "")
    text = text.replace(",", ".")
    return text.rstrip("0").rstrip(".") if "." in text else text


@dataclass(frozen=True)
class Assertion:
    """``named`` is False where a text in one case does not show which of its words are names; they stand among the words then."""

    figures: tuple[str, ...]
    names: tuple[str, ...]
    denied: bool
    words: tuple[str, ...]
    named: bool = True

    def anchor(self) -> str:
        return " ".join(["#", *self.figures, "@" if self.named else "?", *self.names, "!" if self.denied else "."])

    def canonical(self) -> str:
        """The anchor, then the content words: in order of the alphabet, or of the text where the names are among them."""
        return " ".join([self.anchor(), *self.words])

    def empty(self) -> bool:
        return not (self.figures or self.names or self.words)


def read(text: str | None) -> Assertion:
    """The assertion of a text; an empty one for an empty or null text."""
    text = clean(text)
    found = [(m.group(), m.start()) for m in TOKEN.finditer(text)]
    figures, names, words, denied = set(), [], [], False
    cased = any(c.islower() for c in text)
    for k, (token, at) in enumerate(found):
        if token[0].isdigit():
            figures.add(figure(token))
            continue
        low = token.lower()
        if low in NOT:
            denied = True
            continue
        if cased and token[0].isupper():
            after = found[k + 1] if k + 1 < len(found) else ("", 0)
            before = text[:at].rstrip(" \"“”„«([–—-")
            starts = not before or before[-1] in ".!?:…"
            follows = after[0][:1].isupper() and text[at + len(token) : after[1]].strip(" ") == ""
            if (not starts or follows) and not (starts and low in PLAIN):
                names.append(low)
                continue
        if low in PLAIN and low not in CONTENT or low in UP or low in DOWN or len(low) < 2:
            if low in UP or low in DOWN:
                words.append("+" if low in UP else "-")
            continue
        words.append(low)
    named = cased and any(c.isupper() for c in text)
    kept = tuple(sorted(set(words))) if named else tuple(dict.fromkeys(words))
    return Assertion(tuple(sorted(figures)), tuple(names), denied, kept, named or not words)


def read_claim(text: str | None, quote: str | None) -> tuple[Assertion, Assertion]:
    """The assertions of a claim's text and of its quote; the quote stands for a missing text, and its names for those
    of a text in one case only."""
    told = read(quote)
    said = read(text)
    if said.empty():
        said = told
    if not said.named and told.names and set(told.names) <= set(said.words):
        said = Assertion(said.figures, told.names, said.denied, tuple(sorted(w for w in said.words if w not in told.names)))
    return said, told


def record(text: str | None, quote: str | None) -> str:
    """What is indexed of a claim: the canonical forms of its text and of its quote."""
    said, told = read_claim(text, quote)
    return f"{said.canonical()}\t{told.canonical() if quote else ''}"


def parse(canonical: str) -> Assertion:
    """The assertion of a canonical form."""
    tokens = canonical.split(" ")
    at = next(i for i, t in enumerate(tokens) if t in ("@", "?"))
    end = next(i for i in range(at + 1, len(tokens)) if tokens[i] in ("!", "."))
    return Assertion(tuple(tokens[1:at]), tuple(tokens[at + 1 : end]), tokens[end] == "!", tuple(tokens[end + 1 :]), tokens[at] == "@")


def repeats(a: str, b: str) -> bool:
    """Do two records make the same assertion? By their texts, or, with anchors that agree, by their quotes."""
    if a == b:
        return True
    (a, _, qa), (b, _, qb) = a.partition("\t"), b.partition("\t")
    x, y = parse(a), parse(b)
    if same(x, y):
        return True
    if not (qa and qb and x.figures == y.figures and x.denied == y.denied):
        return False
    if x.named and y.named and "".join(x.names) != "".join(y.names):
        return False
    return same(parse(qa), parse(qb))


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | (1 << i)
    row = full = (1 << len(a)) - 1
    for c in b:
        hit = at.get(c)
        if hit is not None:
            same = row & hit
            row = (row + same) | (row - same)
    return len(a) - (row & full).bit_count()


@lru_cache(maxsize=200_000)
def alike(a: str, b: str) -> float:
    """Longest-common-subsequence ratio of two words."""
    return 2 * common(a, b) / (len(a) + len(b)) if a and b else 0.0


#: Least ratio at which two words are one word, misspelled, and at which a long word is one of framing, misspelled.
SPELLING, FRAMING = 0.66, 0.7
_frames = sorted(w for w in PLAIN | UP | DOWN if len(w) >= 4)


@lru_cache(maxsize=200_000)
def framing(word: str) -> bool:
    """Is this a misspelled word of framing or movement?"""
    least = FRAMING if len(word) >= 6 else 0.8
    return any(abs(len(word) - len(w)) <= 3 and alike(word, w) >= least for w in _frames)


def leftover(a: tuple[str, ...], b: tuple[str, ...]) -> list[str]:
    """Words of a without a partner, equal or misspelled, in b; a word is partnered once."""
    rest = [w for w in b if w not in a]
    out = []
    for w in a:
        if w in b:
            continue
        best = max(rest, key=lambda x: alike(w, x), default="")
        if best and len(w) > 2 and len(best) > 2 and alike(w, best) >= SPELLING:
            rest.remove(best)
        else:
            out.append(w)
    return out


def same(a: Assertion, b: Assertion) -> bool:
    """Do two assertions agree in figures, names and denial, and in their content up to spelling?

    Where one does not show its names, the names of the other must stand among its words as they are; where neither
    does, names are words like others.
    """
    if a.figures != b.figures or a.denied != b.denied:
        return False
    wa, wb = set(a.words), set(b.words)
    if a.named and b.named:
        if "".join(a.names) != "".join(b.names):
            return False
    elif a.named != b.named:
        names, among = (a.names, wb) if a.named else (b.names, wa)
        if not among.issuperset(names):
            return False
        among.difference_update(names)
    if wa == wb:
        return not a.empty()
    moves = {"+", "-"}
    ma, mb = moves & wa, moves & wb
    if ma and mb and ma != mb:
        return False
    xa, xb = tuple(sorted(wa - moves)), tuple(sorted(wb - moves))
    return all(framing(w) for w in leftover(xa, xb)) and all(framing(w) for w in leftover(xb, xa))

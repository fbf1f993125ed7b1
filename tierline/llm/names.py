"""Parsing of company names as people type them: core words, descriptor words, ticker."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: Legal forms and share classes at the end of a name.
LEGAL = ("inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "plc", "ag", "sa", "nv", "se", "gmbh", "llc", "holdings", "holding", "group", "hldgs", "grp")
SHARES = (("class", "a", "common", "stock"), ("class", "b", "common", "stock"), ("class", "c", "common", "stock"), ("american", "depositary", "shares"), ("american", "depositary", "receipts"), ("common", "stock"), ("ordinary", "shares"), ("sponsored", "adr"), ("class", "a"), ("class", "b"), ("class", "c"), ("adr",), ("ads",))
#: Words that never describe what a company does.
FORMS = frozenset(LEGAL) | {w for s in SHARES for w in s} | {"the", "of", "and"}
#: Letters without a decomposition, and digits typed for letters.
PLAIN = str.maketrans({"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "ß": "ss", "đ": "d", "Đ": "D", "æ": "ae", "Æ": "AE", "œ": "oe", "ı": "i"})
DIGITS = str.maketrans("013457", "oleast")
#: Stand-ins for a ticker that is not known.
NO_TICKER = ("", "N/A", "NA", "NONE", "NULL", "-", "--", "?", "TBD", "UNKNOWN", "NAN", "N.A.")
#: Slots of the letters sketch that hold no vowel, two bits a slot, as a signed 64-bit number.
CONSONANTS = ~sum(0b11 << 2 * (ord(c) - ord("a")) for c in "aeiou")

_TICKER = re.compile(r"^[\s($\[]*(?:(?:nyse|nasdaq|amex|arca|bats|ticker|symbol)\s*:?\s*)?\$?([a-z]{1,6}[0-9]?)(?:\s+us)?[\s)\]]*$", re.IGNORECASE)
_VOWELS = re.compile("[aeiou]")


def osa(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance (edits and swaps of neighbours), or most + 1 if it is larger; time and memory grow with the length, not its square."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    lo, hi_a, hi_b = 0, len(a), len(b)
    while lo < min(hi_a, hi_b) and a[lo] == b[lo]:
        lo += 1
    while hi_a > lo and hi_b > lo and a[hi_a - 1] == b[hi_b - 1]:
        hi_a, hi_b = hi_a - 1, hi_b - 1
    a, b = a[lo:hi_a], b[lo:hi_b]
    n, m, far, width = len(a), len(b), most + 1, 2 * most + 1
    # cell k of row i stands for column i - most + k
    two, one = None, [j if 0 <= (j := k - most) <= m else far for k in range(width)]
    for i in range(1, n + 1):
        now, x = [far] * width, a[i - 1]
        for k in range(max(0, most - i), min(width, m + most - i + 1)):
            j = i - most + k
            if not j:
                now[k] = i
                continue
            c = one[k] + (x != b[j - 1])
            if k + 1 < width and one[k + 1] < c:
                c = one[k + 1] + 1
            if k and now[k - 1] < c:
                c = now[k - 1] + 1
            if two is not None and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1] and two[k] < c:
                c = two[k] + 1
            now[k] = c if c < far else far
        if min(now) > most and min(one) > most:
            return far
        two, one = one, now
    return min(one[m - n + most], far)


def ascii_lower(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.translate(PLAIN)) if not unicodedata.combining(c)).lower()


def _within(short: str, long: str) -> bool:
    it = iter(long)
    return all(c in it for c in short)


def bones(word: str) -> str:
    """First letter and consonants."""
    return word[:1] + _VOWELS.sub("", word[1:])


def _there(word: str) -> int:
    """Which letters occur, as bits."""
    out = 0
    for c in word:
        out |= 1 << ord(c) % 32
    return out


class Lexicon:
    """Descriptor words, such as an industry, and the ways in which people shorten or misspell them."""

    def __init__(self, words: tuple[str, ...]):
        self.words = frozenset(words)
        self.bones = {w: bones(w) for w in sorted(words)}
        self.masks = {w: _there(w) for w in self.bones}
        self.longest = max(map(len, words), default=0) + 2
        self._known = lru_cache(maxsize=200_000)(self._kin)

    def kin(self, token: str) -> str:
        """The descriptor that a token is, abbreviates or misspells; '' if none or if several fit equally."""
        return self._known(token) if len(token) <= self.longest else ""

    def _kin(self, token: str) -> str:
        if token in self.words:
            return token
        n = len(token)
        if n >= 3:
            stem = token[:-1] if n > 3 and token[-1] == "s" else token
            hits = [w for w in self.bones if w.startswith(token)] or [w for w in self.bones if w.startswith(stem)]
            if len(hits) == 1:
                return hits[0]
        if n >= 2 and not _VOWELS.search(token[1:]):
            hits = [w for w, b in self.bones.items() if token in (b, b.rstrip("s"))]
            if len(hits) == 1:
                return hits[0]
            if n >= 3:  # the longest share of the consonants, both ends included
                share = sorted(((n / len(b), w) for w, b in self.bones.items() if token[0] == b[0] and token[-1] == b[-1] and _within(token, b)), reverse=True)
                if share and (len(share) == 1 or share[0][0] > share[1][0]):
                    return share[0][1]
        if n >= 5:
            mine = _there(token)  # an edit changes two bits at most
            near = sorted((osa(token, w, 2), w) for w, m in self.masks.items() if abs(len(w) - n) <= 2 and (mine ^ m).bit_count() <= 4)
            near = [(d, w) for d, w in near if d <= (2 if len(w) >= 8 else 1)]
            if near and (len(near) == 1 or near[0][0] < near[1][0]):
                return near[0][1]
        if n >= 4:  # a beginning and an end put together, or letters left out anywhere but at the ends
            hits = [w for w in self.bones if n < len(w) and any(w.startswith(token[:k]) and w.endswith(token[k:]) for k in range(3, n))]
            hits = hits or [w for w in self.bones if n < len(w) and 2 * n > len(w) and token[:2] == w[:2] and token[-1] == w[-1] and _within(token, w)]
            if len(hits) == 1:
                return hits[0]
        return ""


@lru_cache(maxsize=4)
def lexicon_of(words: tuple[str, ...]) -> Lexicon:
    return Lexicon(words)


def ticker_of(text: str | None) -> str:
    """The ticker that a text states in any dress (NYSE:X, $x, (X), 'ticker X', 'X US'), or ''."""
    if text is None:
        return ""
    t = text.strip()
    if t.upper() in NO_TICKER:
        return ""
    m = _TICKER.match(t)
    return m.group(1).upper() if m else ""


def parse(name: str, lexicon: Lexicon) -> tuple[tuple[str, ...], str]:
    """(core words, descriptor words in sorted order) of a company name; '' where no descriptor is written at either end."""
    s = re.sub(r"\([^)]*\)", " ", name)
    s = re.sub(r"\s[–—]\s.*$", " ", s, flags=re.DOTALL)
    s = ascii_lower(s).replace("’", "'")
    s = re.sub(r"'s\b\s*$", " ", s.strip())
    s = re.sub(r"&\s*co\b\.?", " ", s)
    s = re.sub(r"\b([a-z])\.([a-z])\b\.?", r"\1\2", s).replace("'", "")
    tokens = re.findall(r"[^\W_]+", s)
    lo, hi = 0, len(tokens)
    while hi - lo > 1 and tokens[lo] == "the":
        lo += 1
    moved = next((i for i in range(lo, min(lo + 4, hi)) if tokens[i] == "of"), lo)
    if moved > lo and any(lexicon.kin(t) for t in tokens[lo:moved]):  # "Paper of X Y"
        tokens = [t for i, t in enumerate(tokens[moved + 1 :] + tokens[lo:moved]) if i == 0 or t not in LEGAL]
        lo, hi = 0, len(tokens)
    before = None
    while before != hi:
        before = hi
        for end in SHARES:
            if hi - lo > len(end) and tuple(tokens[hi - len(end) : hi]) == end:
                hi -= len(end)
        if hi - lo > 1 and (tokens[hi - 1] in LEGAL or (len(tokens[hi - 1]) >= 6 and any(osa(tokens[hi - 1], w, 1) <= 1 for w in ("corporation", "limited", "holdings")))):
            hi -= 1
    said: set[str] = set()

    def descriptor(token: str) -> str:
        w = lexicon.kin(token)
        return "" if w and said and hi - lo < 3 and osa(token, w, 1) > 1 else w  # one core word is left: no second abbreviation

    while hi - lo > 1 and (w := descriptor(tokens[hi - 1])):
        said.add(w)
        hi -= 1
    if not said:
        while hi - lo > 1 and (w := descriptor(tokens[lo])):
            said.add(w)
            lo += 1
    tokens = tokens[lo:hi]
    core = tuple(t.translate(DIGITS) if re.search("[a-z]", t) else t for t in tokens)
    return core, " ".join(sorted(said))


def skeleton(core: tuple[str, ...]) -> str:
    """The consonants of the core's words, put together."""
    return "".join(_VOWELS.sub("", w) for w in core)


def letters(core: tuple[str, ...]) -> int:
    """Sketch of how often each letter occurs (not, once, more often), as a signed 64-bit number: one letter more or less changes one bit at most."""
    seen = [0] * 32
    for w in core:
        for c in w:
            seen[(ord(c) - ord("a")) % 32] += 1
    out = sum((0b11 if k > 1 else 1) << 2 * i for i, k in enumerate(seen) if k)
    return out - (1 << 64) if out >> 63 else out


def slack(core: tuple[str, ...], least: float, edits: int) -> int:
    """Most bits in which the sketches of this core and of one as alike as ``least`` may differ: two an edit."""
    w = len(core)
    return 2 * max(edits, min(edits * w, int((1 - least) * w * max(map(len, core), default=0) + 1e-9)))


def monge_elkan(a: tuple[str, ...], b: tuple[str, ...], most: int = 2) -> float:
    """Symmetric Monge–Elkan similarity with normalised edit distance inside, 0 if a word has no partner within ``most`` edits.

    The joined words count as one word, too, in any rotation.
    """

    def inner(x: str, y: str) -> float:
        d = osa(x, y, most)
        return 0.0 if d > most else 1 - d / max(len(x), len(y), 1)

    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    one, two = "".join(a), "".join(b)
    whole = 0.0
    if abs(len(one) - len(two)) <= most:
        twice, at, head = two + two, 0, min(8, len(two))
        for w in b:
            if osa(one[:head], twice[at : at + head], 2 * most) <= 2 * most:  # else the rest is not worth a look
                whole = max(whole, inner(one, twice[at : at + len(two)]))
            at += len(w)
    if whole > 0 or len(a) != len(b):
        return whole

    def towards(xs: tuple[str, ...], ys: tuple[str, ...]) -> float:
        there, total = set(ys), 0.0
        for x in xs:
            s = 1.0 if x in there else max(inner(x, y) for y in ys)
            if not s:
                return 0.0
            total += s
        return total / len(xs)

    forth = towards(a, b)
    return min(forth, towards(b, a)) if forth else 0.0

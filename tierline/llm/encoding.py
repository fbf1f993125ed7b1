"""Problem 10: text garbled by a wrong character encoding, by round-trip repair."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from html.entities import html5

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings under which bytes may have been read by mistake; "+" marks those whose undefined bytes pass as C1 controls.
READ_AS = ("cp1252+", "latin-1", "mac_roman", "cp437", "cp850", "cp1250+", "cp1251+", "cp866", "koi8-r", "iso8859-2")
#: One-byte encodings in which the text may have been written, beside UTF-8.
WRITTEN_AS = ("cp1252", "cp1250", "cp1251", "koi8-r", "cp866", "mac_roman", "iso8859-2")
#: Cost of one character: (1) lost or control character, (2) a symbol or foreign letter inside a word.
LOST, ODD = 3.0, 2.0
#: A text that no reading improves is garbled beyond repair if it costs so much, and so much for each of its non-ASCII characters.
RESIDUE, DENSE = 4 * ODD, 0.2

#: Second halves of UTF-8 sequences when read as Latin-1 or one of its kin.
_TAIL = "[\u0080-\u00BF€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]"
#: Symbols and letters of other scripts that stand for letters in DOS and Mac pages.
_FOREIGN = "─-▟Α-Ωα-ω√∂≤≥∫≈∆∏π∞⌐ⁿ·‡†˙˚˝ˇ˘˛ı¬¯‰÷"
#: Places that cost something or can be half a sequence; a text with none of them is sound. Each begins with a non-ASCII character.
SUSPECT = "(?=[^\\x00-\\x7F])(?:" + "|".join((
    "[\uFFFD\u0080-\u009F]",  # lost and control characters
    f"[Â-ß]{_TAIL}", f"[à-ï]{_TAIL}{_TAIL}", "(?<![A-ZÀ-Þ])[ÃÂ][ \u00AD]",  # UTF-8 read as Latin-1
    f"[{_FOREIGN}][A-Za-zÀ-ÿĀ-ſ©®£¢ªº]", f"(?<=[A-Za-zÀ-ÿ])[{_FOREIGN}]",  # as DOS or Mac pages
    "[┬├┼╬╠╨╤─][─-▟░▒▓┐└┴]?[^\\s─-▟]", "[ĂĹĐŃÄŔÓÔ√¬‚][^\\sa-zA-Z0-9]", "[–—][À-ÿ≤≥∞±¥∏π∫Ω]",
    "(?<=[a-zß-ÿ])[À-ÖØ-ÞŠŽŒŸĂĐŁŃŘŚŤŹŻ]", "[À-ÿ]{4}",  # one-byte pages for each other
    "(?<=[а-яё])[А-ЯЁ]", "(?<=[a-zA-Z])[Ѐ-ӿ]", "[Ѐ-ӿ][a-zA-Z]", "[А-яЁё][Ђ-Џђ-џ©®°±µ†‡€‰‹•™›¬¦§]",  # Cyrillic pages
)) + ")"

#: References to non-ASCII characters: two in a row, or one beside such a character, may be garbled; one may stand for a lost character.
REFERENCES = "&(?:#[0-9xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});(?:&(?:#|[A-Za-z])|[^\\x00-\\x7F])|[^\\x00-\\x7F]&(?:#|[A-Za-z])|&#(?:65533|[xX][fF]{3}[dD]);"


@lru_cache(maxsize=None)
def _bytes_of(enc: str) -> dict[str, int]:
    """Character to byte for the bytes from 128 up."""
    name, loose, table = enc.rstrip("+"), enc.endswith("+"), {}
    for b in range(128, 256):
        try:
            table[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            if loose:
                table[chr(b)] = b
    if enc == "cp1252+":  # files read as Latin-1 and as its superset look alike apart from C1
        table |= {chr(b): b for b in range(128, 160) if chr(b) not in table}
    return table


@lru_cache(maxsize=None)
def _utf8_pattern(enc: str) -> re.Pattern[str]:
    """Runs of characters that are whole UTF-8 sequences of two to four bytes when put back into ``enc``."""
    by = _bytes_of(enc)
    cls = lambda lo, hi: "[" + "".join(re.escape(c) for c, b in by.items() if lo <= b <= hi) + "]"
    tail = cls(0x80, 0xBF)
    return re.compile(f"(?:{cls(0xC2, 0xDF)}{tail}|{cls(0xE0, 0xEF)}{tail}{tail}|{cls(0xF0, 0xF4)}{tail}{tail}{tail})+")


@lru_cache(maxsize=None)
def _halves(enc: str) -> tuple[frozenset[str], frozenset[str]]:
    by = _bytes_of(enc)
    return frozenset(c for c, b in by.items() if 0xC2 <= b <= 0xF4), frozenset(c for c, b in by.items() if b <= 0xBF)


@lru_cache(maxsize=100_000)
def _kind(c: str) -> str:
    """l/u: Latin small/capital letter, c/C: Cyrillic, g: other letter, m: mark, x: lost, b: drawing, s: symbol, p: punctuation, d: digit, blank."""
    if c in "�" or "\x80" <= c <= "\x9f":
        return "x"
    cat = unicodedata.category(c)
    if cat[0] == "L":
        name = unicodedata.name(c, "")
        if name.startswith("LATIN") or c in "ªº":
            return "u" if cat == "Lu" else "l"
        if name.startswith("CYRILLIC"):
            return "C" if cat == "Lu" else "c"
        return "g"
    if cat[0] == "M":
        return "m"
    if "─" <= c <= "▟":
        return "b"
    return {"N": "d", "Z": " ", "C": " "}.get(cat[0], "s" if cat[0] == "S" or cat == "No" else "p")


#: Letters that occur in correct texts of the languages at hand; others inside a word are odd.
USUAL = frozenset("àâäáãåæçéèêëíìîïñóòôöõøœúùûüýÿßšžąćęłńśźżčřěůđğışțăâșőű" + "абвгдеёжзийклмнопрстуфхцчшщъыьэюя")
#: Other characters that a sequence may stand for: typographic and mathematical signs, Greek, combining marks, and the garbled forms of a further layer.
SOUND = frozenset(map(chr, [*range(0x80, 0x180), 0x192, *range(0x2B0, 0x370), *range(0x391, 0x3CA), *range(0x402, 0x460), *range(0x2010, 0x2045), 0x20AC, *range(0x2100, 0x2300), *range(0x2320, 0x2322), *range(0x2500, 0x25A0), 0x25CA]))
#: Joins that stand between letters in correct text.
JOINS = frozenset("'’‘-‐‑/&.·_@+*#:´­​‌‍‑=~%,;!?()[]{}|\\<>\"^`$0123456789")


def cost(text: str) -> float:
    """How garbled a text looks: lost characters and, inside words, symbols, foreign letters and odd capitals."""
    total, n = 0.0, len(text)
    for m in re.finditer(r"[^\x00-\x7f]", text):
        i, c = m.start(), m.group()
        k = _kind(c)
        if k == "x":
            total += LOST
            continue
        before, after = (text[i - 1] if i else " "), (text[i + 1] if i + 1 < n else " ")
        p, q = _kind(before), _kind(after)
        word = "lucCg"
        if k in "lu":
            if p in "cCg" or q in "cCg":
                total += ODD
            elif k == "u" and p == "l":
                total += ODD
            elif c.lower() not in USUAL and (p in "lu" or q in "lu"):
                total += ODD / 2
            elif ord(c) > 127 and p in "lu" and q in "lu" and before > "\x7f" and after > "\x7f":
                total += ODD / 2  # rows of accented letters
        elif k in "cC":
            if p in "lug" or q in "lug" or (k == "C" and p == "c") or (c.lower() not in USUAL and (p in "cC" or q in "cC")):
                total += ODD
        elif k == "g":
            if p in "lucC" or q in "lucC":
                total += ODD
        elif k in "sbpd" and c not in JOINS:
            if p in word and q in word:
                total += ODD
            elif k == "b" and (p in word or q in word):
                total += ODD
            elif k in "sp" and c in "¬∫∂√≥≤∏∑Ω◊˘˙˚¸˝˛ˇ¯÷×¶§¨±¼½¾¿¡†‡•‰‹›™®©µ" and p in word:
                total += ODD / 2
    return total


_RUN = re.compile("[^\\x00-\\x7f]{2,}")


@lru_cache(maxsize=200_000)
def _put_back(run: str, before: str, after: str, enc: str) -> tuple[str, float]:
    """A run of non-ASCII characters with its UTF-8 sequences restored as far as that is likely, and its cost between its neighbours."""
    by = _bytes_of(enc)

    def put(m: re.Match[str]) -> str:
        old = m.group()
        try:
            new = bytes(by[c] for c in old).decode("utf-8")
        except UnicodeDecodeError:
            return old
        a, b = run[m.start() - 1] if m.start() else before, run[m.end()] if m.end() < len(run) else after
        if len(old) == 2 and _kind(old[0]) in "uC" and _kind(old[1]) == "p" and a in "„“«‘‚" and not (b and _kind(b) in "lucC"):
            return old  # one capital between quotes
        if all(_kind(c) in "lc" and c in USUAL for c in old):
            return old  # a plain run of small letters
        return new if all(c in SOUND or c.lower() in USUAL for c in new) else old

    new = _utf8_pattern(enc).sub(put, run)
    falls = cost(before + new + after) - 0.5 * (len(run) - len(new))
    old = cost(before + run + after)
    return (new, falls) if falls < old else (run, old)


def _undo_utf8(text: str) -> str:
    """Put back the sequences that were UTF-8, under the reading that lowers the cost most; else the text itself.

    All of a sequence's characters are non-ASCII, so only runs of such characters are looked at. A
    sequence is only taken where its place becomes likelier: an accented capital in quotes („Å“) is as
    likely before, while a letter pair that is half symbol (Ã©) is not.
    """
    runs = [(m.start(), m.end(), m.group()) for m in _RUN.finditer(text)]
    if not runs:
        return text
    there = {c for _, _, r in runs for c in r}
    sides = [(text[i - 1] if i else " ", text[j] if j < len(text) else " ") for i, j, _ in runs]
    best, least = None, None
    for enc in READ_AS:
        leads, tails = _halves(enc)
        if there.isdisjoint(leads) or there.isdisjoint(tails):
            continue
        new = [_put_back(r, p, q, enc) for (_, _, r), (p, q) in zip(runs, sides, strict=True)]
        if all(n == r for (n, _), (_, _, r) in zip(new, runs, strict=True)):
            continue
        total = sum(c for _, c in new)
        if least is None or total < least:
            best, least = new, total
    if best is None:
        return text
    out, at = [], 0
    for (i, j, _), (n, _) in zip(runs, best, strict=True):
        out += [text[at:i], n]
        at = j
    return "".join(out) + text[at:]


def _undo_single(text: str) -> str:
    """Re-read the whole text, or each of its paragraphs, in another one-byte encoding if that removes most of the cost."""
    odd = {c for c in text if c > "\x7f"}
    if not odd or "\uFFFD" in odd:
        return text
    before = cost(text)
    if before < 2 * ODD:
        return text
    best, least = text, before
    for known, table in _tables():
        if odd <= known:
            new = text.translate(table)
            c = cost(new)
            if c < least:
                best, least = new, c
    return best if least <= 0.35 * before else text


@lru_cache(maxsize=None)
def _tables() -> list[tuple[frozenset[str], dict[int, str]]]:
    """For each pair of one-byte encodings: the characters that it can re-read, and their strict decoding."""
    out = []
    for enc in READ_AS:
        for intended in WRITTEN_AS:
            if intended != enc.rstrip("+"):
                table = {}
                for c, b in _bytes_of(enc).items():
                    try:
                        table[c] = bytes([b]).decode(intended)
                    except UnicodeDecodeError:
                        continue
                out.append((frozenset(table), str.maketrans(table)))
    return out


#: A character reference, and runs of such and of non-ASCII characters.
_REFERENCE = re.compile("&(?:#(?:([0-9]{1,7})|[xX]([0-9a-fA-F]{1,6}))|([A-Za-z][A-Za-z0-9]{1,30}));")
_REFERRED = re.compile("(?:&(?:#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6})|[A-Za-z][A-Za-z0-9]{1,30});|[^\\x00-\\x7f])+")


def _character(m: re.Match[str]) -> str:
    """The non-ASCII character that a reference stands for; other references stay."""
    number, hexed, name = m.groups()
    if name:
        c = html5.get(name + ";", "")
        return c if len(c) == 1 and c > "\x7f" else m.group()
    code = int(number) if number else int(hexed, 16)
    return chr(code) if 0x80 <= code < 0x110000 and not 0xD800 <= code < 0xE000 else m.group()


def _dereferenced(text: str) -> str:
    """The text with those runs of character references resolved that hold UTF-8 read in another encoding, or a lost character; sound references stay."""

    def put(m: re.Match[str]) -> str:
        run = m.group()
        if "&" not in run:
            return run
        plain = _REFERENCE.sub(_character, run)
        if "&" in plain:
            return run
        around = text[m.start() - 1 : m.start()] + plain + text[m.end() : m.end() + 1]
        return plain if "\uFFFD" in plain or _undo_utf8(around) != around else run

    return _REFERRED.sub(put, text) if "&" in text else text


def repair(text: str) -> tuple[str, int, bool, bool]:
    """(text, layers undone, garbled, whole): what came out, and whether nothing garbled is left in it."""
    text = _dereferenced(text)
    layers, seen, before = 0, text, {text}
    while True:
        new = _undo_utf8(seen)
        if new == seen:
            new = _undo_single(seen)
        if new == seen:  # perhaps only a part was read wrongly
            new = "".join(_undo_single(p) for p in re.split(r"(\n+|(?<=[.!?;:])\s+)", seen))
        if new in before:  # nothing to undo, or going round in circles
            break
        before.add(new)
        seen, layers = new, layers + 1
    lost = bool(re.search("[�\x80-\x9f]", seen)) or bool(re.search(r"(?<![A-ZÀ-Þ])(?:Ã[ ­]|Â[ ­](?=[a-z0-9]))", seen))
    left = cost(seen)
    lost = lost or (left >= RESIDUE and left >= DENSE * sum(c > "\x7f" for c in seen))
    return seen, layers, layers > 0 or lost, not lost


def _batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        out = [repair(t) for t in pdf["text"]]
        new = pd.DataFrame(out, columns=["repaired", "layers", "garbled", "whole"], index=pdf.index)
        new = pd.concat([pdf[["doc_id"]], new], axis=1)
        yield new[new["garbled"]][["doc_id", "repaired", "layers", "whole"]]


def garbled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each record whose text is garbled: doc_id, repaired, layers, whole.

    Legacy readings are undone by re-encoding and strict decoding, layer by layer, as long as the
    garbling cost falls. ``whole`` is false where something stayed lost; ``repaired`` is then restored
    as far as it can be. Character references are resolved where they hold garbled characters and stay elsewhere. A text that
    looks garbled but that no reading improves comes out, too, as it is. Null and empty texts are not garbled. Texts without any suspect character or reference, whose
    cost is zero, are set aside inside the JVM; no shuffle.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").rlike(SUSPECT) | F.col("text").rlike(REFERENCES))
    return rows.mapInPandas(_batches, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, repaired string, layers int, whole boolean")

"""Problem 9: evaluation texts that leak into documents, by q-gram lemma filtering in diagonal bands and banded alignment."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

#: Length of the q-grams, width of a diagonal band (neighbours overlap by half).
Q, BAND = 8, 64
#: Edit budget of the filter: by the lemma one edit undoes at most Q q-grams, so a region that spans g of them with SURE * g edits or fewer, however
#: scattered, keeps DENSITY * g. Edits that fall on the same words undo fewer, and more of them pass.
SURE = 1 / 16
DENSITY = 1 - Q * SURE
#: A region needs this many shared q-grams: those of a stretch of 47 characters at that density.
SHARED = 20
#: A passage shorter than this is joined with its neighbours in the item; one that stays shorter needs all of its q-grams.
SHORT = SHARED + Q - 1
#: Most edits of an aligned region, as a share of its length: wider than the filter's budget, for edits that fall on the same words.
EDITS = 0.25
#: Least share of an item's words that must stand in a document.
COVERAGE = 0.4
#: Sentences that the same items share are no stock but copies of an item if they are this share or more of each one's words, besides those shared otherwise.
COPY = 0.8
#: Characters of items that one index holds (some 24 bytes each), and indexes that one scan of the documents takes along; so what is broadcast stays bounded.
BLOCK_CHARS, SCAN_BLOCKS = 2_000_000, 4

_SPACE = 32


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    """Code point to one byte: small unaccented Latin letters and digits as they are, other letters folded into 128 to 255, marks 0 (left out), all else a blank."""
    out = np.full(0x10000, _SPACE, dtype=np.uint8)
    for code in range(0x10000):
        c = chr(code)
        cat = unicodedata.category(c)
        if cat[0] == "M" or code in (0xAD, 0x200B, 0x200C, 0x200D, 0xFEFF):
            out[code] = 0
        elif cat[0] in "LN":
            base = unicodedata.normalize("NFKD", c)[0].lower()[0]
            out[code] = ord(base) if base.isascii() else 128 + ord(base) % 127
    return out


def codes(text: str) -> np.ndarray:
    """The text as bytes: case, accents, marks, character references and all that separates words evened out."""
    if "&" in text and ";" in text:
        text = html.unescape(text)
    if "Â" in text:
        text = text.replace("Â\xa0", " ")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    x = _table()[np.minimum(points, 0xFFFF)]
    if not x.all():
        x = x[x != 0]
    blank = x == _SPACE
    keep = np.ones(len(x), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    return x[keep]


def grams(x: np.ndarray) -> np.ndarray:
    """All q-grams of eight coded bytes as 64-bit numbers. Latin letters and digits keep their own codes; letters of other scripts share 127, so there two q-grams can be equal by chance."""
    if len(x) < Q:
        return np.zeros(0, dtype=np.uint64)
    return np.ndarray((len(x) - Q + 1,), dtype="<u8", buffer=np.ascontiguousarray(x), strides=(1,)).copy()


def distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edits that turn ``a`` into some part of ``b``, by alignment in a band of diagonals that leaves it ``most`` outside either end; more than most: most + 1."""
    width = max(len(b) - len(a), 0) + 2 * most + 1
    padded = np.zeros(width + len(a) + 1, dtype=np.uint8)  # 0 matches nothing
    padded[most : most + len(b)] = b[: len(padded) - most]
    steps = np.arange(width, dtype=np.int32)
    row = np.zeros(width, dtype=np.int32)
    for i in range(len(a)):
        new = row + (padded[i : i + width] != a[i])
        np.minimum(new[:-1], row[1:] + 1, out=new[:-1])
        new -= steps
        np.minimum.accumulate(new, out=new)
        new += steps
        row = new
        if not i % 16 and row.min() > most:
            return most + 1
    return int(min(row.min(), most + 1))


def passages(parts: list[str], stock: set[str]) -> list[str]:
    """The sentences of an item that are no stock; short neighbours, as answer options are, are joined into one, a short last one with the one before."""
    out: list[list[str]] = [[]]  # a stock sentence parts what is joined
    for s in parts:
        if s in stock:
            out.append([])
        elif out[-1] and len(out[-1][-1]) < SHORT:
            out[-1][-1] += s[1:]  # one blank between them
        else:
            out[-1].append(s)
    for run in out:
        if len(run) > 1 and len(run[-1]) < SHORT:
            run[-2:] = [run[-2] + run[-1][1:]]
    return [s for run in out for s in run]


class Index:
    """Q-grams of the items' sentences. An item is its ids, its coded sentences, and those of them that are stock and left out."""

    def __init__(self, items: list[tuple[list, list[str], list[str]]]):
        self.ids = [ids for ids, _, _ in items]
        self.total = Counter({i: sum(len(s.split(" ")) - 2 for s in parts) for i, (_, parts, _) in enumerate(items)})
        coded = [(i, np.frombuffer(s.encode("latin-1"), dtype=np.uint8)) for i, (_, parts, stock) in enumerate(items) for s in passages(parts, set(stock))]
        self.item = [i for i, _ in coded]
        self.text = [x for _, x in coded]
        keys = [grams(x) for x in self.text]
        self.need = np.array([min(SHARED, max(len(k), 1)) for k in keys], dtype=np.int64)
        self.least = int(self.need.min(initial=SHARED))
        blanks = [np.concatenate(([0], np.cumsum(x == _SPACE))) for x in self.text]
        self.offset = np.concatenate(([0], np.cumsum([len(x) for x in blanks])))[:-1].astype(np.int64)
        self.blanks = np.concatenate(blanks) if blanks else np.zeros(0, dtype=int)
        flat = np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)
        sid = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        pos = np.concatenate([np.arange(len(k)) for k in keys]) if keys else np.zeros(0, dtype=int)
        order = np.argsort(flat, kind="stable")
        self.sid, self.pos = sid[order].astype(np.int32), pos[order].astype(np.int32)
        self.keys, self.start = np.unique(flat[order], return_index=True)
        # how often a q-gram stands in one sentence at most
        runs = np.flatnonzero(np.diff(flat[order], prepend=flat[order][:1] ^ np.uint64(1)).astype(bool) | (np.diff(self.sid, prepend=-1) != 0)) if len(flat) else np.zeros(0, dtype=int)
        self.often = np.maximum.reduceat(np.diff(runs, append=len(flat)), np.searchsorted(runs, self.start)) if len(flat) else runs
        self.start = np.append(self.start, len(flat))
        self.filter = np.zeros(1 << 22, dtype=bool)
        self.filter[self._slot(self.keys)] = True

    @staticmethod
    def _slot(k: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)

    def search(self, x: np.ndarray, k: np.ndarray, coverage: float = COVERAGE) -> list[tuple[int, float]]:
        """(item, share of its words found) for items that reach ``coverage`` in a text of these codes and q-grams.

        Only items whose regions, were they all to align, would reach it are aligned.
        """
        if not len(k) or not len(self.keys):
            return []
        hit = np.flatnonzero(self.filter[self._slot(k)])
        if len(hit) < self.least:
            return []
        at = np.minimum(np.searchsorted(self.keys, k[hit]), len(self.keys) - 1)
        same = self.keys[at] == k[hit]
        hit, at = hit[same], at[same]
        if not self._crowded(hit, self.often[at]):
            return []
        count = self.start[at + 1] - self.start[at]
        first = np.repeat(self.start[at] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        sid, spos, dpos = self.sid[first].astype(np.int64), self.pos[first].astype(np.int64), np.repeat(hit, count)
        # a sentence needs its number of q-grams before it is worth a look where they lie
        there = (np.bincount(sid, minlength=len(self.need)) >= self.need)[sid]
        sid, spos, dpos = sid[there], spos[there], dpos[there]
        if not len(sid):
            return []
        diagonal = dpos - spos + 1024
        regions, most = [], Counter()
        bound: dict[int, int] = {}
        for shift in (0, BAND // 2):
            band = sid * (1 << 32) + (diagonal + shift) // BAND
            order = np.argsort(band, kind="stable")
            lead = np.flatnonzero(np.diff(band[order], prepend=-1))
            n = np.diff(lead, append=len(order))
            lo, hi = np.minimum.reduceat(spos[order], lead), np.maximum.reduceat(spos[order], lead) + Q
            s = sid[order[lead]]
            ok = np.flatnonzero((n >= self.need[s]) & (n >= DENSITY * (hi - lo - Q + 1)))
            words = self.blanks[self.offset[s[ok]] + hi[ok]] - self.blanks[self.offset[s[ok]] + lo[ok]] + 1
            for j, w in zip(ok.tolist(), words.tolist(), strict=True):
                regions.append((int(s[j]), order[lead[j] : lead[j] + n[j]]))
                bound[int(s[j])] = max(bound.get(int(s[j]), 0), w)
        for s, w in bound.items():
            most[self.item[s]] += w
        hopeful = {i for i, w in most.items() if w >= coverage * self.total[i]}
        best: dict[int, int] = {}
        for s, rows in regions:
            if self.item[s] in hopeful and best.get(s, 0) < bound[s]:
                best[s] = max(best.get(s, 0), self._verify(s, x, spos[rows], dpos[rows]))
        found: Counter[int] = Counter()
        for s, w in best.items():
            found[self.item[s]] += w
        return [(i, w / self.total[k]) for k, w in found.items() if w >= coverage * self.total[k] for i in self.ids[k]]

    def _crowded(self, hit: np.ndarray, often: np.ndarray) -> bool:
        """Whether some ``least`` hits lie close enough together for a region.

        A region of n hits spans n / DENSITY + BAND places of the document at most; cut into groups of ``least``
        hits, one group spans no more than its share of that, and 2 * least - 1 hits still are one group.
        """
        n = self.least
        at = np.repeat(hit, often) if (often > 1).any() else hit
        return len(at) >= n and int((at[n - 1 :] - at[: len(at) - n + 1]).min()) <= 2 * n / DENSITY + BAND

    def _verify(self, s: int, x: np.ndarray, spos: np.ndarray, dpos: np.ndarray) -> int:
        """Words of sentence s that stand in the region of these shared q-grams, 0 if it doesn't align within the edit budget."""
        a, b = int(spos.min()), int(spos.max()) + Q
        if len(np.unique(spos)) < DENSITY * (b - a - Q + 1):
            return 0
        piece = self.text[s][a:b]
        diagonal = dpos - spos
        lo, hi = int(diagonal.min()), int(diagonal.max())
        if lo == hi and len(spos) == b - a - Q + 1:
            return len(piece.tobytes().split())  # letter for letter
        slack = int(EDITS * len(piece))
        region = x[max(0, a + lo - Q) : b + hi + Q]
        if distance(piece, region, slack) > slack:
            return 0
        there = Counter(region.tobytes().split())
        return sum(min(n, there[w]) for w, n in Counter(piece.tobytes().split()).items())


@F.pandas_udf(T.ArrayType(T.StringType()))
def sentences(texts: pd.Series) -> pd.Series:
    """The coded sentences of a text, each between blanks; their bytes stand as Latin-1."""
    return texts.map(lambda t: [x.tobytes().decode("latin-1") for x in (codes(f" {s} ") for s in re.split(r"(?<=[.?!])\s+", t)) if len(x) > 2])


def wholes(items: DataFrame) -> DataFrame:
    """(ids, parts, stock) of items (i, t): items of the same sentences are one with several ids; stock has the sentences that it shares with otherwise different ones.

    Decided over all items: sentences with the same holders are taken together and compared with the words that a holder has alone.
    """
    parted = items.select("i", sentences("t").alias("parts")).groupBy("i").agg(F.flatten(F.sort_array(F.collect_list("parts"))).alias("parts")).where("size(parts) > 0")
    whole = cut(parted.groupBy(F.array_sort("parts").alias("same")).agg(F.sort_array(F.collect_list("i")).alias("ids"), F.min("parts").alias("parts")).select(F.col("ids")[0].alias("w"), "ids", "parts"))
    said = whole.select("w", F.explode("parts").alias("part")).groupBy("w", "part").agg(F.sum(F.size(F.split(F.trim("part"), " "))).alias("n"))
    holders = cut(said.groupBy("part").agg(F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("w")).alias("who")).where("k > 1"))
    alone = said.join(holders, "part", "left_anti").groupBy("w").agg(F.sum("n").alias("alone"))
    shared = said.join(holders, "part").groupBy("k", "who", "w").agg(F.sum("n").alias("n")).join(alone, "w", "left")
    copied = shared.groupBy("k", "who").agg(F.min(F.col("n") / (F.col("n") + F.coalesce("alone", F.lit(0)))).alias("share")).where(F.col("share") >= COPY)
    stock = said.join(holders.join(copied, ["k", "who"], "left_anti"), "part").groupBy("w").agg(F.collect_list("part").alias("stock"))
    return whole.join(stock, "w", "left").select("ids", "parts", F.coalesce("stock", F.array().cast("array<string>")).alias("stock"))


def leaks(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, coverage) for each document that holds ``coverage`` or more of an item's words in the item's wording.

    Each sentence of an item is sought by itself, so their order is free; short ones are sought joined with their
    neighbours, and if the whole is short all of it must be there, and an item under Q characters is never found; a sentence cut off counts by the
    words that are there. Sentences that otherwise different items share are stock and never count as found;
    copies of an item under several ids are sought once and come out under each. The
    documents are scanned once for SCAN_BLOCKS blocks of items, without a shuffle. Null and empty texts hold nothing.
    """
    spark = docs.sparkSession
    held = cut(wholes(items.where(F.col(text).isNotNull()).select(F.col(item_id).alias("i"), F.col(text).alias("t"))))
    size = held.agg(F.sum(F.length(F.array_join("parts", "")))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_CHARS))
    out_type = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, item_id {items.schema[item_id].dataType.simpleString()}, coverage double"
    pairs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.length("text") > 0)
    block = F.pmod(F.xxhash64("ids"), F.lit(blocks))
    out = None
    for at in range(0, blocks, SCAN_BLOCKS):
        some = range(at, min(at + SCAN_BLOCKS, blocks))
        indexes = [spark.sparkContext.broadcast(Index([tuple(r) for r in held.where(block == b).sort("ids").collect()])) for b in some]  # about BLOCK_CHARS characters each

        def scan(batches: Iterator[pd.DataFrame], indexes=indexes) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for d, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                    x = codes(f" {t} ")
                    k = grams(x)
                    rows += [(d, i, c) for index in indexes for i, c in index.value.search(x, k, coverage)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "coverage"])

        part = pairs.mapInPandas(scan, out_type)
        out = part if out is None else out.unionByName(part)
    return out

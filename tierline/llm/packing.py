"""Problem 8: texts packed whole into windows of fixed capacity, by Karmarkar–Karp multiway differencing."""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Fixed value: the pattern that cuts a text before its pieces are merged, as published with this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CAPACITY = 2048
#: Windows that the items of one block fill, about; what a task holds and what is wasted at block ends both follow from it.
BLOCK_WINDOWS = 128
#: Tasks over which blocks are spread.
MOST_TASKS = 10_000


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, tokenizer: str, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens): tokens of each whole text; null texts have none. ``tokenizer`` is a vocabulary file that the executors can read."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        enc = _encoding(tokenizer, pattern)
        return texts.map(lambda t: len(enc.encode_ordinary(t)) if t else 0)

    return docs.select(F.col(doc_id).alias("doc_id"), count(F.col(text)).alias("n_tokens"))


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """Bin of each item after Karmarkar–Karp differencing into ``k`` bins.

    A heap holds partial partitions by the spread of their bins. The two widest are merged, the fullest bins
    of one with the emptiest of the other, until one partition is left.
    """
    n = len(sizes)
    if not n:
        return np.zeros(0, dtype=int)
    left, right = [-1] * n, [-1] * n  # a bin is a tree over items

    heap = []
    for i in range(n):
        loads, trees = np.zeros(k, dtype=np.int64), np.full(k, -1, dtype=np.int64)
        loads[0], trees[0] = sizes[i], i
        heap.append((-int(sizes[i]) if k > 1 else 0, i, loads, trees, 1))
    heapq.heapify(heap)
    turn = n
    while len(heap) > 1:
        _, _, a, ta, na = heapq.heappop(heap)
        _, _, b, tb, nb = heapq.heappop(heap)
        loads, trees = a.copy(), ta.copy()
        # only the nb used bins of b meet the nb emptiest of a
        at = np.arange(k - 1, k - 1 - nb, -1)
        loads[at] += b[:nb]
        for p, q in zip(at.tolist(), range(nb), strict=True):
            if trees[p] < 0:
                trees[p] = tb[q]
            else:
                left.append(int(trees[p]))
                right.append(int(tb[q]))
                trees[p] = len(left) - 1
        order = np.argsort(-loads, kind="stable")
        loads, trees = loads[order], trees[order]
        heapq.heappush(heap, (-int(loads[0] - loads[-1]), turn, loads, trees, min(k, na + nb)))
        turn += 1
    out = np.zeros(n, dtype=int)
    for j, tree in enumerate(heap[0][3].tolist()):
        stack = [tree] if tree >= 0 else []
        while stack:
            t = stack.pop()
            if t < n:
                out[t] = j
            else:
                stack += [left[t], right[t]]
    return out


def fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each item, none over capacity: the number of windows rises as long as one would be."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        bins = differencing(sizes, k)
        worst = int(np.bincount(bins, weights=sizes, minlength=k).max(initial=0))
        if worst <= capacity:
            return bins
        k += max(1, int(k * (worst - capacity) / capacity / 4))


def pack(sizes: DataFrame, capacity: int = CAPACITY, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(doc_id, piece, start_token, n_tokens, window_id) for ``sizes`` (doc_id, n_tokens); ids are unique.

    A text of up to ``capacity`` tokens stays whole. A longer one is cut into pieces of exactly ``capacity``,
    each a window of its own, and a rest that is packed like a text. Texts without tokens take no place and
    do not come out. Items are spread by a hash over blocks of about ``block_windows`` windows, so no task holds
    more than a block; within a block Karmarkar–Karp differencing makes windows of near-equal load.
    """
    sizes = cut(sizes.where("n_tokens > 0"))
    total = sizes.agg(F.sum(F.col("n_tokens") % capacity)).first()[0] or 0
    blocks = max(1, round(total / (capacity * block_windows)))
    pieces = sizes.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / capacity).cast("int"))).alias("piece"), F.col("n_tokens").alias("all"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * F.lit(capacity).cast("bigint")).alias("start_token"), F.least(F.lit(capacity).cast("bigint"), F.col("all") - F.col("piece") * F.lit(capacity).cast("bigint")).alias("n_tokens"))
    full = pieces.where(F.col("n_tokens") == capacity).withColumn("window_id", F.concat(F.lit("d"), F.col("doc_id"), F.lit("-"), F.col("piece")))
    loose = pieces.where(F.col("n_tokens") < capacity).withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        bins = fit(pdf["n_tokens"].to_numpy(), capacity)
        return pdf.assign(window_id=[f"b{b}-{j}" for b, j in zip(pdf["block"], bins, strict=True)])[["doc_id", "piece", "start_token", "n_tokens", "window_id"]]

    tasks = min(blocks, MOST_TASKS)  # by number: by their few bytes all blocks would be put into one task
    schema = f"doc_id {sizes.schema['doc_id'].dataType.simpleString()}, piece int, start_token bigint, n_tokens bigint, window_id string"
    return full.unionByName(loose.repartition(tasks, "block").groupBy("block").applyInPandas(one, schema))

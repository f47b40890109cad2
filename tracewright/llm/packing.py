"""Filling containers of fixed capacity.

Items are spread over blocks of about ``WINDOWS`` containers' worth each. Within a block, multiway differencing (Karmarkar and
Karp) merges the two partial partitions of largest imbalance, fullest windows against emptiest, until one partition into
near-equal windows is left. Windows over the capacity and some of the least full are then emptied into the others, which gathers the
space that differencing spreads over all; what finds no place raises the number of windows.
"""

from __future__ import annotations

import bisect
import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.tokens import VOCABULARY, token_sizes, with_occurrence
from tracewright.session import materialize

CAPACITY = 2048
WINDOWS = 256


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Multiway differencing: the indices of ``sizes`` in ``windows`` parts of near-equal sums. Ties go by index."""
    if not sizes:
        return [[] for _ in range(windows)]
    # A partial partition: window sums in falling order and the members of each; windows at zero are left out.
    heap: list[tuple] = []
    for i, s in enumerate(sizes):
        gap = s if windows > 1 else 0
        heap.append((-gap, i, [s], [[i]]))
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, a, am = heapq.heappop(heap)
        _, _, b, bm = heapq.heappop(heap)
        # window j of a meets window (windows - 1 - j) of b, counting from the fullest
        merged: list[tuple[int, list[int]]] = []
        for j in range(len(a)):
            o = windows - 1 - j
            if o < len(b):
                merged.append((a[j] + b[o], am[j] + bm[o]))
            else:
                merged.append((a[j], am[j]))
        for o in range(len(b)):
            if windows - 1 - o >= len(a):
                merged.append((b[o], bm[o]))
        merged.sort(key=lambda x: -x[0])
        sums = [x[0] for x in merged]
        gap = sums[0] - (sums[-1] if len(sums) == windows else 0)
        heapq.heappush(heap, (-gap, tick, sums, [x[1] for x in merged]))
        tick += 1
    _, _, _, members = heap[0]
    return members + [[] for _ in range(windows - len(members))]


def fill(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``; sizes over it are an error.

    Differencing into as few windows as the sum allows leaves some a little over the capacity and spreads the space that is left over all.
    So overfull windows and a part of the least full ones are emptied into the others (:func:`refill`): an eighth, if that is not
    enough a quarter, then half of them. The number of windows rises only if all of these need more.
    """
    if max(sizes, default=0) > capacity:
        raise ValueError("an item is larger than the capacity")
    if not sizes:
        return []
    k = max(1, -(-sum(sizes) // capacity))
    parts = differencing(sizes, k)
    best: list[list[int]] = []
    for share in (8, 4, 2):
        got = refill(sizes, parts, capacity, -(-len(parts) // share))
        if not best or len(got) < len(best):
            best = got
        if len(best) <= k:
            break
    return best


def refill(sizes: list[int], parts: list[list[int]], capacity: int, emptied: int) -> list[list[int]]:
    """The windows with the overfull and the ``emptied`` least full ones taken apart, their items put where they fit most tightly, largest first."""
    order = sorted(parts, key=lambda p: (sum(sizes[i] for i in p), p))
    over = [p for p in order if sum(sizes[i] for i in p) > capacity]
    kept = [list(p) for p in order[emptied : len(order) - len(over)] if p]
    room = [capacity - sum(sizes[i] for i in p) for p in kept]
    loose = [i for p in order[: min(emptied, len(order) - len(over))] + over for i in p]
    by_room = sorted((r, w) for w, r in enumerate(room))
    for i in sorted(loose, key=lambda i: (-sizes[i], i)):
        at = bisect.bisect_left(by_room, (sizes[i], -1))
        if at < len(by_room):
            r, w = by_room.pop(at)
        else:
            r, w = capacity, len(kept)
            kept.append([])
        kept[w].append(i)
        bisect.insort(by_room, (r - sizes[i], w))
    return kept


def pack(df: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY, path: str = VOCABULARY, windows: int = WINDOWS) -> DataFrame:
    """Every text in containers of ``capacity`` tokens: ``(container, id, occurrence, piece, from_token, tokens)``.

    A text of at most ``capacity`` tokens is one piece; a longer one is cut into full pieces, each a container, and a rest.
    Texts without tokens (null or empty) are pieces of size 0. Repeated rows are packed each on their own, told apart by
    ``occurrence``; the result depends on ids and texts only, not on the files or the order they come in. An empty table
    gives no rows; columns other than the two named are not read.
    """
    named = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    sizes = materialize(token_sizes(named, "id", "text", ("h",), path), "sizes")
    keys = ["id", "h", "occurrence", "tokens"]
    sizes = with_occurrence(sizes, ["id", "h", "tokens"])
    pieces = F.greatest(F.lit(1), F.ceil(F.col("tokens") / capacity)).cast("int")
    cut = sizes.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1))).withColumn("from_token", F.col("piece").cast("long") * capacity)
    cut = materialize(cut.select(*keys, "piece", "from_token", F.least(F.lit(capacity).cast("long"), F.col("tokens") - F.col("from_token")).alias("size")), "pieces")
    full = F.col("size") == capacity
    # full pieces are containers as they are; blocks are made of the tokens of the others
    total = cut.where(~full).agg(F.sum("size")).first()[0] or 0
    blocks = max(1, -(-total // (capacity * windows)))
    alone = cut.where(full).select(F.concat_ws("-", F.lit("f"), "id", "h", "occurrence", "piece").alias("container"), "id", "occurrence", "piece", "from_token", F.col("size").alias("tokens"))
    items = cut.where(~full).withColumn("block", F.pmod(F.xxhash64("id", "h", "occurrence", F.lit(5)), F.lit(blocks)))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "id", "h", "occurrence"], ascending=[False, True, True, True]).reset_index(drop=True)
        at = np.zeros(len(pdf), np.int64)
        for w, members in enumerate(fill(pdf["size"].tolist(), capacity)):
            at[members] = w
        return pd.DataFrame({"container": [f"b-{key[0]}-{w}" for w in at], "id": pdf["id"], "occurrence": pdf["occurrence"], "piece": pdf["piece"], "from_token": pdf["from_token"], "tokens": pdf["size"]})

    kind = sizes.schema["id"].dataType.simpleString()
    packed = items.select("block", "id", "h", "occurrence", "piece", "from_token", "size").groupBy("block").applyInPandas(one, f"container string, id {kind}, occurrence long, piece int, from_token long, tokens long")
    return alone.unionByName(packed).withColumnRenamed("id", id_col)


def over_capacity(packed: DataFrame, id_col: str, capacity: int = CAPACITY) -> DataFrame:
    """Ids of the texts that the packing has spread over more than one container, with their containers and tokens.

    The pieces of such a text must add up: they follow one another from the first token without a gap.
    """
    per = packed.groupBy(id_col, "occurrence").agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens"), F.max(F.col("from_token") + F.col("tokens")).alias("last"))
    whole = F.when(F.col("tokens") == F.col("last"), F.col("tokens")).otherwise(F.raise_error(F.lit("pieces of a text do not add up")).cast("long"))
    return per.where("containers > 1").withColumn("tokens", whole).groupBy(id_col).agg(F.max("containers").alias("containers"), F.max("tokens").alias("tokens"))

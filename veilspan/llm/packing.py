"""Texts packed into containers of fixed token capacity, certified by lower bounds.

Method: bound-certified repacking. Items are hashed over partitions; each partition is packed
by best-fit decreasing. While all containers together are more than the best of several dual
feasible function bounds of all items, partitions exchange: their containers with room are
dealt anew over partitions of the same size, packed again, and the new packing is kept where it
takes fewer containers. This repeats until the bound is met or a round gains nothing.
``certificate`` reports containers, bound and gap of every partition and of the whole.

A text is cut only if it alone exceeds the capacity; its pieces are full but for the last and
join to the text. Null and empty texts are no items.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.session import durable

CAPACITY = 2048
#: Where the public tokenizers' files lie.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Items a partition holds on average: thousands of containers, a few seconds of packing.
ITEMS_PER_PART = 20_000
#: Containers filled to less than this share, and at least the emptiest of a partition, are opened for the exchange.
OPEN_BELOW = 0.995
#: Fixed value: the public pre-tokenizing pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def cut_text(text: str, encode, capacity: int) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of the pieces of a text, each of at most ``capacity`` tokens.

    Cuts fall before white space where one stands in the last tenth, so that neither side
    tokenises differently on its own; each piece is counted again to be sure.
    """
    if len(encode(text)) <= capacity:
        return [(0, len(text), len(encode(text)))]
    out, at = [], 0
    while at < len(text):
        # A window that surely holds a full piece, then the longest prefix within capacity.
        width = capacity
        while at + width < len(text) and len(encode(text[at : at + width])) <= capacity:
            width *= 2
        low, high = 1, min(width, len(text) - at)
        if len(encode(text[at : at + high])) <= capacity:
            low = high
        while low < high:
            mid = (low + high + 1) // 2
            if len(encode(text[at : at + mid])) <= capacity:
                low = mid
            else:
                high = mid - 1
        if at + low < len(text):
            space = max(text.rfind(" ", at + low * 9 // 10, at + low), text.rfind("\n", at + low * 9 // 10, at + low))
            if space > at and len(encode(text[at:space])) <= capacity:
                low = space - at
        out.append((at, at + low, len(encode(text[at : at + low]))))
        at += low
    return out


def item_sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """(key, piece_no, pieces, start, end, tokens): one row per item, several for texts over capacity."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(vocabulary).encode_ordinary
        for batch in batches:
            rows = []
            for k, t in zip(batch["key"], batch["text"]):
                n = len(encode(t))
                if n <= capacity:
                    rows.append((k, 1, 1, 0, len(t), n))
                else:
                    cut = cut_text(t, encode, capacity)
                    rows += [(k, no, len(cut), a, b, m) for no, (a, b, m) in enumerate(cut, 1)]
            yield pd.DataFrame(rows, columns=["key", "piece_no", "pieces", "start", "end", "tokens"])

    return (
        docs.where(F.length(text) > 0)
        .select(F.col(key).alias("key"), F.col(text).alias("text"))
        .mapInPandas(run, f"key {kind}, piece_no int, pieces int, start int, end int, tokens int")
    )


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item; the fullest container with room takes the item.

    Containers are held by free space, and one integer's bits tell which amounts of free
    space occur, so each item takes constant time.
    """
    where = np.empty(len(sizes), np.int64)
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, opened = 0, 0
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        fit = mask >> size
        if fit:
            free = size + ((fit & -fit).bit_length() - 1)
            box = by_free[free].pop()
            if not by_free[free]:
                mask ^= 1 << free
        else:
            free, box = capacity, opened
            opened += 1
        where[i] = box
        free -= size
        by_free[free].append(box)
        mask |= 1 << free
    return where


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Containers that any packing needs: the best of two families of dual feasible functions."""
    if not len(sizes):
        return 0
    hist = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    items, total = np.cumsum(hist), np.cumsum(hist * np.arange(capacity + 1))
    best = math.ceil(int(total[-1]) / capacity)
    for e in range(1, capacity // 2 + 1):
        # Items over capacity - e count as full, items under e as nothing.
        big = int(items[-1] - items[capacity - e])
        middle = int(total[capacity - e] - total[e - 1])
        best = max(best, big + -(-middle // capacity))
    x = np.arange(capacity + 1, dtype=np.int64)
    for k in range(1, 21):
        # In units of capacity * k: x stays where (k + 1) x is a multiple of the capacity, else it rounds down.
        scaled = (k + 1) * x
        value = np.where(scaled % capacity == 0, x * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((value * hist).sum()) // (capacity * k)))
    return best


_ITEM = ["key", "piece_no", "pieces", "start", "end", "tokens"]


def _pack(capacity: int):
    """Pack one partition anew, and keep the packing where it takes fewer containers than before.

    ``heads`` marks one item of each container, ``open`` those of containers for the exchange.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "key", "piece_no"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        old = pdf["box"].nunique() if pdf["box"].notna().all() else None
        sizes = pdf["tokens"].to_numpy(np.int64)
        where = best_fit_decreasing(sizes, capacity)
        boxes = int(where.max()) + 1
        if old is None or boxes < old:
            pdf["box"] = [f"{label}-{b}" for label, b in zip(pdf["part"], where)]
        fill = pdf.groupby("box")["tokens"].transform("sum")
        pdf["open"] = (fill < capacity * OPEN_BELOW) | (fill == fill.min())
        pdf["heads"] = ~pdf["box"].duplicated()
        return pdf[[*_ITEM, "part", "box", "open", "heads"]]

    return run


def _bound_of(counts: DataFrame, capacity: int) -> int:
    """The lower bound of all items: one row per size comes to the driver, ``capacity`` at most."""
    rows = counts.groupBy("tokens").agg(F.count("*").alias("n")).toArrow()
    return lower_bound(np.repeat(rows["tokens"].to_numpy(), rows["n"].to_numpy()), capacity)


def fill_containers(
    docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}", items_per_part: int = ITEMS_PER_PART
) -> DataFrame:
    """(key, piece_no, pieces, start, end, tokens, part, box): the container of every item, and the partition it was last packed in.

    Each round's packing is a table in the shared folder. Partitions are spread by a hash of
    key and piece, so no key, source or group of copies gathers in one of them; an exchange
    deals whole containers.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, piece_no int, pieces int, start int, end int, tokens int, part string, box string, open boolean, heads boolean"
    sizes = durable(item_sizes(docs, key, text, capacity, vocabulary), "sizes")

    def dealt(rows: DataFrame, by: list, count: int, no: int) -> DataFrame:
        label = F.concat(F.lit(f"{no}."), F.pmod(F.xxhash64(*by, F.lit(no)), F.lit(max(1, -(-count // items_per_part)))))
        return durable(rows.withColumn("part", label).groupBy("part").applyInPandas(_pack(capacity), schema), "packed")

    def counted(rows: DataFrame) -> tuple[int, int, int]:
        r = rows.agg(F.count_if("heads").alias("boxes"), F.count_if("open").alias("items"), F.count_if(F.col("open") & F.col("heads")).alias("held")).first()
        return r.boxes, r.items, r.held

    packed = dealt(sizes.withColumn("box", F.lit(None).cast("string")), ["key", "piece_no"], sizes.count(), 0)
    done: list[DataFrame] = []
    total, items, held = counted(packed)
    bound = _bound_of(sizes, capacity) if items else total
    no = 0
    while items and total > bound:
        no += 1
        done.append(packed.where("NOT open"))
        packed = dealt(packed.where("open").select(*_ITEM, "box"), ["box"], items, no)
        now, items, still = counted(packed)
        gain, held = held - now, still
        total -= gain
        if not gain:
            break
    for rows in done:
        packed = packed.unionByName(rows)
    return packed.select(F.col("key").alias(key), *_ITEM[1:], "part", "box")


def certificate(filled: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(part, items, tokens, containers, bound, gap) of the partitions of ``fill_containers``; a null part is the whole.

    Bounds follow from how many items of each size there are, so a partition's input is one row
    per size, and so is that of the whole. Without items there are no rows.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bound = lower_bound(np.repeat(pdf["size"].to_numpy(), pdf["n"].to_numpy()), capacity)
        boxes, n = int(pdf["boxes"].sum()), int(pdf["n"].sum())
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "items": [n], "tokens": [int((pdf["size"] * pdf["n"]).sum())], "containers": [boxes], "bound": [bound], "gap": [boxes - bound]})

    by_box = filled.groupBy("box").agg(F.min("tokens").alias("tokens"), F.lit(1).alias("boxes"), F.min("part").alias("part"))
    rows = filled.groupBy("part", "tokens").agg(F.count("*").alias("n")).join(by_box.groupBy("part", "tokens").agg(F.sum("boxes").alias("boxes")), ["part", "tokens"], "left")
    rows = rows.select("part", F.col("tokens").alias("size"), "n", F.coalesce("boxes", F.lit(0)).alias("boxes"))
    whole = rows.groupBy("size").agg(F.sum("n").alias("n"), F.sum("boxes").alias("boxes")).select(F.lit(None).cast("string").alias("part"), "size", "n", "boxes")
    return rows.unionByName(whole).groupBy("part").applyInPandas(run, "part string, items long, tokens long, containers long, bound long, gap long")

"""Packing of tokenized documents by shortest-pack-first over the length histogram.

Documents are cut into full pieces and a rest. The histogram of rests has at most ``capacity``
entries however large the corpus is; lengths are placed longest first, each into the pack that is
filled least, and patterns of packs are counted, not packs. Patterns are then joined back to the
pieces by the rank of a piece among those of its length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.session import cut_lineage

#: Chunks whose ids a worker remembers before it starts anew, and their longest.
REMEMBERED = 400_000
LONGEST_REMEMBERED = 60


class _Ids(dict):
    """Ids, as little-endian 32-bit bytes, of chunks that no token crosses."""

    def __init__(self, path: str):
        super().__init__()
        import json

        import public_tokenizers
        import tiktoken

        # The same vocabulary as ranks: this library is the faster one on short chunks and gives equal ids (tested).
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
        hidden = [b for b in range(256) if b not in set(visible)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in held["model"]["vocab"].items() if piece not in self.special}
        self.encoding = tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def __missing__(self, chunk: str) -> bytes:
        ids = np.array(self.encoding.encode_ordinary(chunk), "<u4").tobytes()
        if len(chunk) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = ids
        return ids

    def plain(self, text: str) -> bytes:
        # A token never runs from other characters into white space, so a space after one begins a new chunk.
        if _SPACED.search(text):
            chunks = _CHUNKS.split(text)
        else:
            first, *rest = text.split(" ")
            chunks = [first, *(" " + r for r in rest)]
        return b"".join(map(self.__getitem__, chunks))

    def text(self, text: str) -> bytes:
        if self.split is None or not any(s in text for s in self.special):
            return self.plain(text)
        return b"".join(np.array([self.special[x]], "<u4").tobytes() if x in self.special else self.plain(x) for x in self.split.split(text))


_SPACED, _CHUNKS = re.compile(r"\s "), re.compile(r"(?<=\S)(?= )")


@lru_cache(maxsize=2)
def _ids(path: str) -> _Ids:
    return _Ids(path)


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, doc_key, start, length, ids_crc32, doc_tokens (and ids).

    ``tokenizer_path`` must be readable on every executor. A document is the ids of its whole text and
    one id 0 at its end; a null text is empty, so every document has at least one id. ``doc_key`` is a
    hash of id and text. ``ids`` (array of bigint) is given if ``keep_ids``.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = _ids(tokenizer_path)
        width = 4 * capacity
        for batch in batches:
            rows = []
            for doc_id, key, text in zip(batch["doc_id"], batch["doc_key"], batch["text"], strict=True):
                whole = ids.text(text or "") + b"\0\0\0\0"
                for at in range(0, len(whole), width):
                    piece = whole[at : at + width]
                    row = (doc_id, key, at // 4, len(piece) // 4, zlib.crc32(piece), len(whole) // 4)
                    rows.append((*row, np.frombuffer(piece, "<u4").astype("i8")) if keep_ids else row)
            yield pd.DataFrame(rows, columns=names)

    schema = "doc_id string, doc_key bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<bigint>" * keep_ids
    names = [x.split(" ")[0] for x in schema.split(", ")]
    keyed = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))).alias("doc_key"), "text")
    return keyed.mapInPandas(pieces, schema).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns of packs with their counts; a pattern is its (length, copies) in order of placing.

    Lengths are placed longest first. All packs of one filling and pattern are one heap entry; the
    entry filled least takes as many copies of the length as fit, for as many packs as are needed.
    """
    heap: list[tuple[int, int, tuple[tuple[int, int], ...], int]] = []
    order = 0
    for length in sorted((n for n, c in histogram.items() if c > 0), reverse=True):
        left = histogram[length]
        while left:
            if heap and heap[0][0] + length <= capacity:
                filled, _, pattern, packs = heappop(heap)
            else:
                filled, pattern, packs = 0, (), left  # new packs; each takes one below
            # One copy per pack, so that all packs of the entry are again alike; the least filled is looked up anew.
            used = min(packs, left)
            if pattern and used < packs:
                order += 1
                heappush(heap, (filled, order, pattern, packs - used))
            grown = (*pattern[:-1], (length, pattern[-1][1] + 1)) if pattern and pattern[-1][0] == length else (*pattern, (length, 1))
            order += 1
            heappush(heap, (filled + length, order, grown, used))
            left -= used
    return [(pattern, packs) for _, _, pattern, packs in sorted(heap)]


def pack(pieces: DataFrame, capacity: int = 1024, rows_per_bucket: int = 200_000) -> DataFrame:
    """Adds sequence_id and offset to pieces with doc_key, start and length of at most ``capacity``.

    ``pieces`` is read three times, so give a written table. Ranks among pieces of one length come from
    buckets by hash: a length that holds most rows is many buckets, and only their counts are summed up.
    Repeated rows are pieces of their own; an empty table gives no rows.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("length").count().collect()  # at most capacity rows
    histogram = {r["length"]: r["count"] for r in counts}
    slots, sequence, base = [], 0, {}
    for pattern, packs in shortest_pack_first(histogram, capacity):
        offset = 0
        for length, copies in pattern:
            for _ in range(copies):
                low = base.get(length, 0)
                slots.append((length, low, low + packs, sequence, offset))
                base[length] = low + packs
                offset += length
        sequence += packs
    places = spark.createDataFrame(slots, "length bigint, low bigint, high bigint, first_sequence bigint, offset bigint")

    buckets = 1 + sum(histogram.values()) // rows_per_bucket
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_key", "start"), F.lit(buckets)))
    sizes = bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_key", "start", "ids_crc32")
    ranked = bucketed.withColumn("within", F.row_number().over(within) - 1).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("within"))
    # The slots are bounded by the patterns, those by the capacity.
    placed = ranked.join(F.broadcast(places), (ranked["length"] == places["length"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).drop(places["length"])
    return placed.withColumn("sequence_id", F.col("first_sequence") + F.col("rank") - F.col("low")).drop("bucket", "within", "before", "rank", "low", "high", "first_sequence")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, keep_ids: bool = False) -> DataFrame:
    """Tokenizes whole documents and packs them into sequences of at most ``capacity`` ids.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids if
    ``keep_ids``). Pieces are written once to the shared folder, so texts are tokenized once and a lost
    executor costs no more than its tasks. Null ids and texts, repeated rows, empty tables and extra
    columns: see :func:`tokenize_pieces` and :func:`pack`.
    """
    pieces = cut_lineage(tokenize_pieces(docs, tokenizer_path, capacity, keep_ids), "pieces")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids
    return pack(pieces, capacity).select(*columns)

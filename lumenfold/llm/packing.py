"""Vector best-fit packing of token pieces into sequences.

Every piece has a size vector: its tokens, one document, and its attention cost (tokens squared). A sequence has a
capacity for each. Pieces go in descending length to the sequence that fits under all three capacities with the
smallest weighted norm of what stays free (``rule="norm"``) or the largest weighted dot product of size and free room
(``rule="dot"``); if none fits, a new one opens.

All pieces of one length have the same size vector, so the driver packs *lengths with counts* (at most ``capacity``
rows, however large the corpus) and gets segments "the pieces of length L with ranks lo..hi go, k to a sequence, to
sequences from b at offset o". Ranks come from counts per (length, hash bucket), so no length meets in one task.

Defined results: null text counts as empty; an empty text is the end id alone; repeated rows are packed as rows of their
own; ties between equal rows are broken by id, piece and checksum; null ids stay null and large ids exact; very long texts
are tokenized whole; other columns are not looked at, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.whole import as_text, kinds, restored
from lumenfold.plans.tables import cut, parts

#: Pieces of a (length, bucket) group that one window task sorts.
BUCKET_ROWS = 50_000

#: Texts of these characters get the same ids from the rank file as from the tokenizer file (a test goes through them);
#: any other text goes through the tokenizer file itself.
_SAME = re.compile(r"[\x00-\u2fff]*")

PIECES = "doc_id string, piece int, start long, length long, ids_crc32 long"


def _encoder(tokenizer_path: str, ranks_path: str | None, pattern: str | None):
    """A function from texts to lists of ids, as the tokenizer file gives them without added special tokens."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path)
    if not ranks_path:
        return lambda texts: [e.ids for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
    import base64

    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    special = [t.content for t in whole.get_added_tokens_decoder().values()]

    def encode(texts: list[str]) -> list[list[int]]:
        return [
            fast.encode_ordinary(t) if _SAME.fullmatch(t) and not any(s in t for s in special) else whole.encode(t, add_special_tokens=False).ids
            for t in texts
        ]

    return encode


def token_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    capacity: int = 1024,
    end_id: int = 2,
    ranks_path: str | None = None,
    pattern: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """Tokenize, append ``end_id`` and cut what is longer than ``capacity``; of its pieces only the first is shorter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(tokenizer_path, ranks_path, pattern)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                rows = []
                for key, ids in zip(part["doc_id"], encode(part["text"].tolist()), strict=True):
                    ids = np.array([*ids, end_id], dtype="<u4")
                    first = len(ids) % capacity or capacity
                    edges = [0, *range(first, len(ids) + 1, capacity)]
                    for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                        row = (key, n, a, b - a, zlib.crc32(ids[a:b].tobytes()))
                        rows.append((*row, ids[a:b].astype("int64").tolist()) if keep_ids else row)
                names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
                yield pd.DataFrame(rows, columns=names)

    named = docs.select(F.col(doc_id).cast("long").cast("string").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return named.mapInPandas(run, PIECES + ", ids array<long>" * keep_ids).withColumn("doc_id", F.col("doc_id").cast("long"))


def plan(
    counts: dict[int, int],
    capacity: tuple[float, float, float],
    *,
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01),
    rule: str = "norm",
) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Segments (length, first rank, end rank, pieces to a sequence, first sequence, offset), and how many sequences.

    Sequences with the same free room are one state with ranges of ids; what a state holds is placed at one go, so the
    work depends on the number of lengths, not of pieces.
    """
    cap, w = np.array(capacity, float), np.array(weights, float)
    states: dict[tuple[float, float, float], list[tuple[int, int]]] = {}
    segments: list[tuple[int, int, int, int, int, int]] = []
    bins = 0

    def score(room: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Lower is better."""
        if rule == "dot":
            return -((room / cap) @ (w * size / cap))
        return (((room - size) / cap) ** 2) @ w

    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        size, left, rank = np.array([length, 1.0, float(length) ** 2]), counts[length], 0
        if (size > cap).any():
            raise ValueError(f"a piece of {length} tokens exceeds a sequence's capacity")
        heap: list[tuple[float, tuple[float, float, float]]] = []
        if states:
            room = np.array(list(states))
            fits = (room >= size).all(axis=1)
            heap = [(s, tuple(r)) for s, r in zip(score(room[fits], size).tolist(), room[fits].tolist(), strict=True)]
            heapq.heapify(heap)
        while left and heap:
            _, state = heapq.heappop(heap)
            ranges, rest = states.pop(state), []
            after = tuple((np.array(state) - size).tolist())
            into = []
            for first, n in ranges:
                k = min(n, left)
                if k:
                    segments.append((length, rank, rank + k, 1, first, int(cap[0] - state[0])))
                    into.append((first, k))
                    rank, left = rank + k, left - k
                if n > k:
                    rest.append((first + k, n - k))
            if rest:
                states[state] = rest
            if into:
                new = after not in states
                states.setdefault(after, []).extend(into)
                if new and (np.array(after) >= size).all():
                    heapq.heappush(heap, (float(score(np.array(after), size)), after))
        each = max(1, int((cap // size).min()))
        for k, n in ((each, left // each), (left % each, 1)):
            if k and n and left:
                segments.append((length, rank, rank + k * n, k, bins, 0))
                states.setdefault(tuple((cap - k * size).tolist()), []).append((bins, n))
                rank, bins = rank + k * n, bins + n
    return segments, bins


def pack(
    pieces: DataFrame,
    *,
    tokens: int = 1024,
    documents: int = 1024,
    attention: int = 1024 * 1024,
    rule: str = "norm",
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01),
) -> DataFrame:
    """``pieces`` (any columns; ``doc_id, piece, length, ids_crc32`` among them) with ``sequence_id`` and ``offset``.

    ``pieces`` is read three times (counts, counts by bucket, rows): hand over a written table.
    """
    spark = pieces.sparkSession
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # as many rows as the capacity at most
    segments, _ = plan(counts, (tokens, documents, attention), weights=weights, rule=rule)
    segments.sort()
    keys = [(s[0] << 44) + s[1] for s in segments]
    table = np.array(segments, dtype="int64").reshape(-1, 6)

    buckets = parts(spark, sum(counts.values()), BUCKET_ROWS)
    bucketed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    by = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = bucketed.groupBy("length", "_bucket").count().select("length", "_bucket", F.coalesce(F.sum("count").over(by), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = bucketed.withColumn("_in", F.row_number().over(inside) - 1).join(before, ["length", "_bucket"]).withColumn("_key", F.shiftleft(F.col("length"), 44) + F.col("_before") + F.col("_in"))

    edges = np.array(keys, dtype="int64")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            key = b["_key"].to_numpy("int64")
            at = table[np.searchsorted(edges, key, side="right") - 1]
            nth = (key & ((1 << 44) - 1)) - at[:, 1]
            b["sequence_id"] = at[:, 4] + nth // at[:, 3]
            b["offset"] = at[:, 5] + nth % at[:, 3] * at[:, 0]
            yield b[names]

    names = [*pieces.columns, "sequence_id", "offset"]
    kept = as_text(ranked.withColumn("_key", F.col("_key").cast("decimal(38,0)")).select(*pieces.columns, "_key")).withColumn("_key", F.col("_key").cast("long"))
    return restored(kept.mapInPandas(place, f"{kinds(pieces)}, sequence_id long, offset long"), pieces)


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = 1024, documents: int | None = None, attention: int | None = None, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.01, 0.01), **how) -> DataFrame:
    """Tokenize, cut and pack ``docs``; the pieces are written once, without their texts.

    Without ``documents`` and ``attention`` these two capacities are what ``capacity`` tokens allow anyway, for the fewest sequences.
    """
    pieces = cut(token_pieces(docs, tokenizer_path, capacity=capacity, **how), "pieces")
    return pack(pieces, tokens=capacity, documents=documents or capacity, attention=attention or capacity * capacity, rule=rule, weights=weights)

"""N-gram Jaccard join: documents whose sets of word n-grams are alike, by a blocked sparse matrix product.

Documents and n-grams form a sparse 0/1 matrix; overlaps are entries of its product with its transpose. Bounds that follow
from sizes keep almost all of the product from being formed, and none of them loses a pair:

1. *Columns of one document.* A pair shares at least ``t`` of either set, so of a document that links, a share of ``t`` of its
   n-grams are in other documents too. N-grams travel in binary blobs, a column block at a time, to be counted; back come
   those of two or more documents with their counts. Documents below the share are done. Rows that are equal become one.
2. *Prefixes.* With n-grams in the order of their counts, rarest first, two documents that link share one of their first
   ``size - ceil(t * size) + 1``. Columns of these prefixes say which rows may meet; in each, rows sorted by size are
   chained, broken where sizes differ too much to link. Chains make groups of rows: links lie within groups.
3. *Blocks.* Rows of groups are laid out in blocks of up to ``ROWS`` rows, whole groups together; a larger group spans
   blocks. A pair of blocks is one task's product, in numpy; overlaps are
   summed over shared columns and compared exactly with what the two sizes ask. A spanning forest of the links leaves it.
   Blocks first meet themselves and the next; of a large group only rows outside its largest component by then meet others.

Components of the links come from star contractions. No pair of documents is a row of any table; a group of a third of all
rows is spread over its blocks.

Defined results: null text is empty; an empty set links with nothing, and its component is its own id; documents with equal
sets link; fewer than n words are one n-gram; repeated rows link, rows of one id and other text are rows of their own; null
ids have a null component unless they link; very long texts are read whole; other columns are not looked at, whatever their
names; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.components import components
from lumenfold.plans.tables import FILE_ROWS, cut, parts

#: Rows of a batch whose n-grams are sent together, and of a block of the product.
BATCH, ROWS = 1024, 512
#: N-grams that end a batch or a block before it has all its rows.
BATCH_GRAMS = 500_000
#: N-grams that one column block counts.
COLUMNS = 1_000_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)


class _Words(dict):
    """Hashes of words, each computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ngrams(text: str | None, n: int, words: dict) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams, of 53 bits."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out += h[i : len(h) - width + 1 + i] * np.uint64(_MULTIPLIERS[i % 8] + 2 * (i // 8))
        if i % 8 == 7:
            out = _mix(out)
    return np.unique(_mix(out) >> np.uint64(11))


def digest(h: np.ndarray) -> bytes:
    """A set's name: 127 bits, so that none of very many unequal sets share one; its last byte isn't 0, which numpy would strip."""
    d = xxhash.xxh3_128_digest(h.tobytes())
    return d[:15] + bytes([d[15] | 1])


def need(a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The least overlap of two sets that link: ``100 * o >= percent * (a + b - o)``."""
    return -(-percent * (a + b) // (100 + percent))


def _shared_columns(docs: DataFrame, blocks: int, n: int, percent: int) -> DataFrame:
    """Two kinds of rows. Of every batch of sets: their ``ids, nodes, sizes``. Of a set that may link: ``node, size, grams``,
    its n-grams of two or more sets, those of the fewest sets first.

    N-grams go out by column block under their batch's name, are counted, and what is shared comes back to the batch. Names of
    sets take the same way, so a batch is computed once and need not be kept.
    """

    def out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, ids, sets, held = _Words(), [], [], 0

        def send() -> pd.DataFrame:
            name = uuid.uuid4().hex
            nodes = np.array([digest(s) for s in sets], "S16")
            sizes = np.array([len(s) for s in sets], "<u4")
            grams = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
            to = (grams % np.uint64(blocks)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            grams, owner, to = grams[order] // np.uint64(blocks), owner[order], to[order]
            edges = np.searchsorted(to, np.arange(blocks + 1))
            packed = grams.view(np.uint8).reshape(-1, 8)[:, :6]  # 53 bits over 32 or more blocks
            rows = [(zlib.crc32(name.encode()) % blocks, name, list(ids), nodes.tobytes(), sizes.tobytes())]
            for k in np.flatnonzero(np.diff(edges)):
                a, z = edges[k], edges[k + 1]
                rows.append((int(k), name, None, packed[a:z].tobytes(), np.bincount(owner[a:z], minlength=len(sets)).astype("<u2").tobytes()))
            ids.clear()
            sets.clear()
            return pd.DataFrame(rows, columns=["block", "batch", "ids", "a", "b"])

        for b in batches:
            for key, t in zip(b["doc_id"], b["text"], strict=True):
                ids.append(key)
                sets.append(ngrams(t, n, words))
                held += len(sets[-1])
                # counts of a document in a block are of 16 bits
                if len(sets) >= BATCH or held >= BATCH_GRAMS:
                    yield send()
                    held = 0
        if sets:
            yield send()

    def count(group: pd.DataFrame) -> pd.DataFrame:
        block = np.uint64(group["block"].iloc[0])
        named = group["ids"].notna()
        rows = [(r.batch, r.ids, r.a, r.b, None) for r in group[named].itertuples()]
        group = group[~named]
        blobs = [np.frombuffer(g, np.uint8).reshape(-1, 6) for g in group["a"]]
        if blobs:
            wide = np.zeros((sum(map(len, blobs)), 8), np.uint8)
            np.concatenate(blobs, out=wide[:, :6])
            grams = wide.reshape(-1).view("<u8") * np.uint64(blocks) + block
            order = np.argsort(grams, kind="stable")
            ordered = grams[order]
            starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            runs = np.diff(np.append(starts, len(ordered)))
            counts = np.empty(len(grams), np.uint32)
            counts[order] = np.repeat(runs.astype(np.uint32), runs)
            at = 0
            for batch, p, per in zip(group["batch"], blobs, group["b"], strict=True):
                hit = np.flatnonzero(counts[at : at + len(p)] > 1)
                if len(hit):
                    per = np.frombuffer(per, "<u2")
                    owners = np.repeat(np.arange(len(per), dtype=np.uint16), per)
                    rows.append((batch, None, grams[at + hit].tobytes(), owners[hit].tobytes(), counts[at + hit].tobytes()))
                at += len(p)
        return pd.DataFrame(rows, columns=["batch", "ids", "a", "b", "c"])

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        named = group["ids"].notna()
        head, rest = group[named].iloc[0], group[~named]
        nodes, sizes = np.frombuffer(head["a"], "S16"), np.frombuffer(head["b"], "<u4").astype("int64")
        rows = [(None, None, None, head["ids"], head["a"], head["b"])]
        if len(rest):
            grams = np.concatenate([np.frombuffer(x, "<u8") for x in rest["a"]])
            owners = np.concatenate([np.frombuffer(x, np.uint16) for x in rest["b"]])
            counts = np.concatenate([np.frombuffer(x, "<u4") for x in rest["c"]])
            may = (100 * np.bincount(owners, minlength=len(nodes)) >= percent * sizes) & (sizes > 0)
            keep = may[owners]
            grams, owners, counts = grams[keep], owners[keep], counts[keep]
            order = np.lexsort((grams, counts, owners))
            grams, owners = grams[order], owners[order]
            edges = np.searchsorted(owners, np.arange(len(nodes) + 1))
            rows += [(bytes(nodes[i]), int(sizes[i]), grams[edges[i] : edges[i + 1]].tobytes(), None, None, None) for i in np.flatnonzero(may)]
        # a plain column of whole numbers and nulls would become one of floats
        whole = {"size": pd.array([r[1] for r in rows], "Int64")}
        return pd.DataFrame({c: whole.get(c, pd.Series([r[i] for r in rows], dtype="object")) for i, c in enumerate(("node", "size", "grams", "ids", "nodes", "sizes"))})

    rows = docs.mapInPandas(out, "block int, batch string, ids array<string>, a binary, b binary")
    counted = rows.groupBy("block").applyInPandas(count, "batch string, ids array<string>, a binary, b binary, c binary")
    return counted.groupBy("batch").applyInPandas(gather, "node binary, size long, grams binary, ids array<string>, nodes binary, sizes binary")


def _sets(named: DataFrame) -> DataFrame:
    """``doc_id, node, size`` of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, nodes, sizes in zip(b["ids"], b["nodes"], b["sizes"], strict=True):
                yield pd.DataFrame({"doc_id": list(ids), "node": np.frombuffer(nodes, "S16").tolist(), "size": np.frombuffer(sizes, "<u4").astype("int64")})

    return named.filter("ids IS NOT NULL").select("ids", "nodes", "sizes").mapInPandas(run, "doc_id string, node binary, size long").withColumn("doc_id", F.col("doc_id").cast("long"))


def _chains(rows: DataFrame, percent: int, blocks: int) -> DataFrame:
    """``u, v``: rows next to each other, by size, in a column of prefixes; each block of columns sends a forest."""

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), BATCH):
                grams, nodes, sizes = [], [], []
                for node, size, blob in zip(b["node"].iloc[lo : lo + BATCH], b["size"].iloc[lo : lo + BATCH], b["grams"].iloc[lo : lo + BATCH], strict=True):
                    own = np.frombuffer(blob, "<u8")
                    # n-grams of no other set come first of all in the order
                    first = own[: max(0, size + percent * size // -100 + 1 - (size - len(own)))]
                    grams.append(first)
                    nodes.append(np.full(len(first), node, "S16"))
                    sizes.append(np.full(len(first), size, np.uint32))
                g, nd, sz = np.concatenate(grams), np.concatenate(nodes), np.concatenate(sizes)
                to = (g % np.uint64(blocks)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                g, nd, sz = g[order], nd[order], sz[order]
                edges = np.searchsorted(to[order], np.arange(blocks + 1))
                out = [(int(k), g[a:z].tobytes(), nd[a:z].tobytes(), sz[a:z].tobytes()) for k, a, z in zip(range(blocks), edges, edges[1:], strict=False) if z > a]
                yield pd.DataFrame(out, columns=["block", "grams", "nodes", "sizes"])

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        g = np.concatenate([np.frombuffer(x, "<u8") for x in group["grams"]])
        nd = np.concatenate([np.frombuffer(x, "S16") for x in group["nodes"]])
        sz = np.concatenate([np.frombuffer(x, "<u4") for x in group["sizes"]]).astype(np.int64)
        order = np.lexsort((nd, sz, g))
        g, nd, sz = g[order], nd[order], sz[order]
        link = (g[1:] == g[:-1]) & (nd[1:] != nd[:-1]) & (100 * sz[:-1] >= percent * sz[1:])
        return pd.DataFrame(forest(nd[:-1][link], nd[1:][link]), columns=["u", "v"])

    spread = rows.select("node", "size", "grams").mapInPandas(prefixes, "block int, grams binary, nodes binary, sizes binary")
    return spread.groupBy("block").applyInPandas(chain, "u binary, v binary").distinct()


def forest(u: np.ndarray, v: np.ndarray) -> list[tuple[bytes, bytes]]:
    """A star of links for every component of the graph."""
    names, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    root = np.arange(len(names))
    while True:  # hook to the least root of a neighbour, then jump to the top
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[root]
        if (new == root).all():
            break
        root = new
    low = np.flatnonzero(root != np.arange(len(names)))
    return list(zip(names[low].tolist(), names[root[low]].tolist(), strict=True))


def _block_links(a: pd.DataFrame, b: pd.DataFrame | None, percent: int) -> list[tuple[bytes, bytes]]:
    """Links within ``a``, or between ``a`` and ``b``, of rows that may meet: one block of the matrix product."""
    rows = a if b is None else pd.concat([a, b])
    sizes, nodes = rows["size"].to_numpy("int64"), np.array(rows["node"].tolist(), "S16")
    parts_ = [np.frombuffer(x, "<u8") for x in rows["grams"]]
    grams = np.concatenate(parts_)
    owner = np.repeat(np.arange(len(rows)), [len(p) for p in parts_])
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    runs = np.diff(np.append(starts, len(grams)))
    column = np.repeat(np.cumsum(runs > 1) - 1, runs)  # columns of one row have no part
    keep = np.repeat(runs > 1, runs)
    column, owner = column[keep], owner[keep]
    split = len(a) if b is not None else len(rows)
    overlap = np.zeros((split, len(rows) - split if b is not None else len(rows)), np.float32)
    width = 4096
    edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 1 + width, width))
    for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        part = np.zeros((len(rows), width), np.float32)
        part[owner[lo:hi], column[lo:hi] - k * width] = 1.0
        overlap += part[:split] @ (part[split:] if b is not None else part).T
    left, right = (sizes[:split], sizes[split:]) if b is not None else (sizes, sizes)
    i, j = np.nonzero((100 + percent) * overlap.astype(np.int64) >= percent * (left[:, None] + right[None, :]))
    names = (nodes[:split], nodes[split:]) if b is not None else (nodes, nodes)
    u, v = names[0][i], names[1][j]
    return forest(u[u != v], v[u != v]) if (u != v).any() else []


def _links(rows: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """``u, v``: links that connect all that links connect, from rows laid out in blocks.

    First every block meets itself and the next. Rows of a large group that are connected by then need not meet: of its
    largest component no two rows do, only the other rows meet each other and it. So a group of near copies, whatever part
    of all rows it is, costs about as many block pairs as it has blocks.
    """
    members = groups.select("component").union(groups.select("component").distinct()).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    every = groups.unionByName(groups.select(F.col("component").alias("node"), "component").distinct())
    laid = rows.join(every, "node").join(members, "component")
    # small groups share a block, as a hash says; a large one has blocks of its own
    total, grams = laid.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    shared = max(1, math.ceil(total / (ROWS // 2)), math.ceil(grams / BATCH_GRAMS))
    large = F.col("n") > ROWS // 2
    home = F.when(large, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(shared)).cast("string").cast("binary"))
    # a large group's rows are dealt to blocks by bands of size, and by a hash within a band
    # bands are a little wider than the ratio, so that rounding parts no pair by two
    band = F.floor(F.log(F.col("size")) / (1e-6 + math.log(100 / percent))).cast("int")
    laid = laid.select("node", "size", "grams", home.alias("home"), large.alias("large"), F.when(large, band).otherwise(0).alias("band"))
    laid = cut(laid, "laid", rows=total + grams // 40)
    near = cut(_met(laid, "large", percent, first=True), "near-links", rows=total)
    wide = laid.filter("large")
    known = components(near.join(wide.select(F.col("node").alias("u")), "u", "left_semi"))
    parts_ = wide.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    most = parts_.groupBy("home", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("home").agg(F.max_by("component", F.struct("k", "component")).alias("main"))
    marked = parts_.join(most, "home").withColumn("rest", F.col("component") != F.col("main")).drop("component", "main")
    # a group that is one component by now has no rest, and nothing left to meet
    left = marked.join(marked.filter("rest").select("home").distinct(), "home", "left_semi")
    left = cut(left.select("node", "size", "grams", "home", "large", "band", "rest"), "rest", rows=total + grams // 40)
    return near.unionByName(_met(left, "rest", percent, first=False))


def _met(laid: DataFrame, side: str, percent: int, first: bool) -> DataFrame:
    """Links of blocks that meet. ``first``: each with itself and the next; else all in which a row of ``rest`` takes part."""
    key = ["home", side, "band"]
    bands = laid.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("grams"))
    fit = F.ceil(F.greatest(F.col("n") / ROWS, F.col("grams") / BATCH_GRAMS)).cast("int")
    bands = cut(bands.withColumn("pieces", F.when(F.col(side), fit).otherwise(1) if first else fit), "bands", rows=1)
    keyed = laid.join(bands.select(*key, "pieces"), key).withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    keyed = keyed.select(*key, "piece", "node", "size", "grams")
    pieces = bands.select(*key, F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "pieces")
    b = pieces.select("home", F.col(side).alias("side2"), F.col("band").alias("band2"), F.col("piece").alias("piece2"))
    a = pieces.withColumn("side2", F.col(side))
    if first:
        to = [F.struct(F.col("band").alias("band2"), F.col("piece").alias("piece2"))]
        own = a.withColumn("to", F.array(*to)).unionByName(a.filter("piece + 1 < pieces").withColumn("to", F.array(F.struct(F.col("band").alias("band2"), (F.col("piece") + 1).alias("piece2")))))
        own = own.select(*key, "piece", F.explode("to").alias("to"), "side2").select(*key, "piece", "side2", "to.band2", "to.piece2")
        over = a.filter((F.col("piece") == 0) & F.col(side)).withColumn("band2", F.col("band") + 1).join(b.filter("piece2 = 0"), ["home", "side2", "band2"])
        pairs = own.unionByName(over.select(*own.columns))
    else:
        odd = a.filter(side).drop("side2")
        same = (F.col("side2") & (F.col("band2") == F.col("band")) & (F.col("piece2") >= F.col("piece"))) | (F.col("side2") & (F.col("band2") == F.col("band") + 1))
        cross = ~F.col("side2") & F.abs(F.col("band2") - F.col("band")).between(0, 1)
        pairs = odd.join(b, "home").filter(same | cross).select(*key, "piece", "side2", "band2", "piece2")
    pairs = pairs.withColumn("name", F.concat_ws(":", F.hex("home"), side, "band", "piece", "side2", "band2", "piece2"))
    alone = (F.col("side2") == F.col(side)) & (F.col("band2") == F.col("band")) & (F.col("piece2") == F.col("piece"))
    ends = pairs.select(*key, "piece", "name", F.lit(0).alias("end")).unionByName(pairs.filter(~alone).select("home", F.col("side2").alias(side), F.col("band2").alias("band"), F.col("piece2").alias("piece"), "name", F.lit(1).alias("end")))

    def product(group: pd.DataFrame) -> pd.DataFrame:
        x, y = group[group["end"] == 0], group[group["end"] == 1]
        return pd.DataFrame(_block_links(x, y if len(y) else None, percent) if len(x) else [], columns=["u", "v"])

    met = keyed.join(ends, [*key, "piece"]).select("name", "end", "node", "size", "grams")
    return met.groupBy("name").applyInPandas(product, "u binary, v binary").distinct()


def link(docs: DataFrame, *, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, class_id`` of every row; ``class_id`` is that of rows with an equal set."""
    spark = docs.sparkSession
    # ids travel as text: in pandas whole numbers beside nulls would become floats
    rows = docs.select(F.col(doc_id).cast("long").cast("string").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # a word has some five characters; fewer than 32 blocks don't fit the width of what is sent
    number, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(32, parts(spark, size // 5, COLUMNS))
    both = cut(_shared_columns(rows, blocks, n, percent), "shared", size=size)
    sets = _sets(both)
    classes = sets.filter("size > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    # equal sets have equal columns and counts: one row stays
    rows = cut(both.filter("node IS NOT NULL").select("node", "size", "grams").groupBy("node").agg(F.first("size").alias("size"), F.first("grams").alias("grams")), "rows", size=size)
    groups = components(_chains(rows, percent, blocks))
    linked = components(_links(rows, groups, percent))
    named = cut(classes.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node")), "classes", rows=number)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = named.join(least, "component").select("node", "component_id", F.col("least").alias("class_id"))
    out = sets.select("doc_id", "size", "node").filter("size > 0").join(ids, "node").select("doc_id", F.col("size").alias("n_shingles"), "component_id", "class_id")
    empty = sets.filter("size = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"))
    return out.unionByName(empty).coalesce(max(1, -(-number // FILE_ROWS)))

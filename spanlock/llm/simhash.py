"""Near-duplicates by SimHash, found in an embedding of fingerprints as segment popcounts.

A fingerprint is cut into segments, and its bit counts per segment are a point on a grid.
One differing bit moves the point by one step in one segment, so the Manhattan distance of
two points is a lower bound of the Hamming distance of their fingerprints. Two fingerprints
within two bits have a point within one step of both: each fingerprint enters the cell of
its own point and the cells one step away (a range join on the grid), and cells with a
single member are dropped. What is left is verified exactly: in each cell a fingerprint
names the 64-bit values within one bit of it that lie in that cell; two fingerprints
within two bits name a common value, and any two that name a common value are within two
bits. At most 65 fingerprints can name one value, so groups are bounded whatever the data,
and no pairs are listed inside a cell.

Copies share a fingerprint and count once. Components are found by alternating large-star
and small-star rounds on the links between different fingerprints, each cut by a checkpoint.

Defined cases: null and blank texts have fingerprint zero and link like any other; a text
of fewer words than a shingle is one shingle; repeated rows are copies; a null id takes
part but never names a component unless the group has no other; an empty table gives an
empty result; very long texts are hashed whole, in blocks; links are unordered, so there are no ties but
of ids, where the smallest wins. Extra columns do not matter. Components settle in a few rounds (each
at least halves the paths); 60 are an error, not a cut.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, join_small, table

#: Bits of a segment: 16 segments, so a fingerprint enters at most 33 cells.
SEGMENT_BITS = 4
BITS = 64
#: Shingles that so many texts of a block have come late in prefixes; so many of them are kept.
FREQUENT, FREQUENT_ROWS = 4, 200_000
#: Counts of a shingle set by which pairs are sorted out.
CELLS = 64
#: In groups of a token with more unconnected texts than this, pairs are held against each other's parities before they are listed.
HOT = 2
#: Parity bits of a shingle set, in words of 64.
PARITY_WORDS = 8


def fingerprint_of(words: list[bytes], shingle: int, seed: int = 42) -> int:
    """The signed 64-bit SimHash of a word sequence: a bit is set if set in over half the shingle hashes."""
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(b" ".join(words[i : i + shingle]), seed) for i in range(n)), dtype="<u8", count=n))


def majority(hashes: np.ndarray) -> int:
    """The signed 64-bit value whose bits are set if set in over half the hashes; 0 for none."""
    n = len(hashes)
    ones = np.zeros(BITS, dtype=np.int64)
    for a in range(0, n, 1 << 16):  # bounded memory for very long texts
        block = hashes[a : a + (1 << 16)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *, shingle: int = 3, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text, as a signed long."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            # bytes.lower() and bytes.split() know only ASCII: A-Z, and the six white-space characters.
            out = [fingerprint_of(texts[i].as_py().lower().split(), shingle) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["doc_id", "fp"])

    return rows.mapInArrow(work, "doc_id long, fp long")


def _segment(fp: Column | str, i: int) -> Column:
    return F.bit_count(F.shiftrightunsigned(fp, i * SEGMENT_BITS).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1).cast("long"))).cast("long")


def _cells() -> Column:
    """The cell of a fingerprint's point and those one step away.

    A cell is (id, moved, up): its coordinates in one long, the segment that moved (or -1) and
    whether it moved up. Coordinates take 0 to 4; four bits each hold them.
    """
    own = F.lit(0).cast("long")
    for i in range(BITS // SEGMENT_BITS):
        own = own.bitwiseOR(F.shiftleft(_segment("fp", i), 4 * i))
    cells = [F.struct(F.col("__own").alias("cell"), F.lit(-1).alias("moved"), F.lit(False).alias("up"))]
    for i in range(BITS // SEGMENT_BITS):
        one = F.shiftleft(F.lit(1).cast("long"), 4 * i)
        at = F.shiftrightunsigned("__own", 4 * i).bitwiseAND(F.lit(15).cast("long"))
        cells.append(F.when(at < SEGMENT_BITS, F.struct((F.col("__own") + one).alias("cell"), F.lit(i).alias("moved"), F.lit(True).alias("up"))))
        cells.append(F.when(at > 0, F.struct((F.col("__own") - one).alias("cell"), F.lit(i).alias("moved"), F.lit(False).alias("up"))))
    return own, F.filter(F.array(*cells), lambda c: c.isNotNull())


def links(fps: DataFrame) -> DataFrame:
    """(a, b), a < b: stars over all fingerprints of ``fps`` (distinct ``fp``) within two bits of each other.

    Not all pairs, but every two fingerprints within two bits are joined by at most two links.
    """
    own, cells = _cells()
    members = fps.withColumn("__own", own).select("fp", F.explode(cells).alias("c")).select("fp", "c.cell", "c.moved", "c.up")
    members = members.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("cell"))).where("n > 1")
    bits = F.sequence(F.col("moved") * SEGMENT_BITS, F.col("moved") * SEGMENT_BITS + SEGMENT_BITS - 1)
    flipped = F.transform(bits, lambda b: F.when(F.col("fp").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b)).eqNullSafe(F.lit(0).cast("long")) == F.col("up"), F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))))
    values = F.when(F.col("moved") < 0, F.array("fp")).otherwise(F.filter(flipped, lambda v: v.isNotNull()))
    named = members.select("fp", F.explode(values).alias("value"))
    groups = named.groupBy("value").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)  # at most 65 each
    groups = groups.select(F.array_sort("fps").alias("fps"))
    stars = groups.select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, BITS + 1)).alias("b"))
    return stars.distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable over the links (a, b), for roots too; nodes without links are left out.

    Alternates large-star (a node's larger neighbours join its smallest) and small-star (its
    smaller ones do) until nothing changes, when every node is linked to its root alone.
    """
    def signature(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()

    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    last = signature(edges)
    for _ in range(max_rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select("u", "v", "m")
        small = small.select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b")).where("a <> b").distinct()
        edges = cut(small)
        now = signature(edges)
        if now == last:
            ends = F.explode(F.array("b", "a")).alias("node")  # a root leads to itself
            return edges.select(ends, F.col("a").alias("root")).distinct()
        last = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_duplicates(docs: DataFrame, *, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): documents grouped by links at two or fewer differing bits."""
    rows = cut(fingerprints(docs, shingle=shingle))
    by_fp = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")))
    roots = cut(components(links(by_fp.select("fp"))))
    of = by_fp.join(roots, by_fp.fp == roots.node, "left").where("rows > 1 or root is not null").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = of.groupBy("root").agg(F.min("least").alias("component_id"))
    of = cut(of.join(named, "root").select("fp", "component_id"))
    # A row alone names itself, so only groups are joined, and a fingerprint of very many rows is no single task.
    rows = join_small(rows, of.withColumn("__grouped", F.lit(True)), ["fp"], "left")
    return rows.select("doc_id", "fp", F.when(F.col("__grouped"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; a text of fewer words than a shingle is one shingle."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    k = min(shingle, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        out = (out ^ each[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _frequent(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, ranks): shingles that many texts have, sorted, and their places from rare to frequent.

    Each task counts over blocks of about two million shingles and hands on those of ``FREQUENT``
    texts or more. This only orders the shingles: any one order for all texts finds every pair.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
            held.clear()
            many = n >= FREQUENT
            return pa.RecordBatch.from_arrays([pa.array(values[many].view(np.int64)), pa.array(n[many].astype(np.int64))], names=["token", "n"])

        size = 0
        for batch in batches:
            for text in batch.column(0):
                held.append(shingle_set(text.as_py(), shingle))
                size += len(held[-1])
                if size >= 1 << 21:
                    yield out()
                    size = 0
        yield out()

    counted = texts.select(F.col("text").cast("binary")).mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "token").limit(FREQUENT_ROWS).toArrow()
    tokens, n = top["token"].to_numpy().view(np.uint64), top["n"].to_numpy()
    by_token = np.argsort(tokens)
    ranks = np.empty(len(tokens), dtype=np.int64)
    ranks[np.lexsort((tokens, n))] = np.arange(1, len(tokens) + 1)
    return tokens[by_token], ranks[by_token]


def prefixes(texts: DataFrame, *, shingle: int, similarity: float) -> DataFrame:
    """(node, id, n, counts, fp, tokens): of the set of shingles its size, its counts by low bits, its fingerprint, and its prefix.

    Shingles have one order, rare before frequent. Two sets at the similarity share at least
    that part of each, so they share one of the first n - ceil(similarity * n) + 1 of both. A set
    without shingles has the token 0. ``node`` and ``id`` are carried over.
    """
    shared = texts.sparkSession.sparkContext.broadcast(_frequent(texts, shingle))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, ranks = shared.value
        for batch in batches:
            sizes, counts, fps, tokens = [], [], [], []
            for text in batch.column(2):
                values = shingle_set(text.as_py(), shingle)
                n = len(values)
                sizes.append(n)
                cells = np.bincount((values & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
                counts.append(np.minimum(cells, 0xFFFF).astype("<u2").tobytes())
                fps.append(majority(values))
                if len(frequent) and n:
                    at = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
                    values = values[np.argsort(np.where(frequent[at] == values, ranks[at], 0), kind="stable")]
                tokens.append(values[: n - math.ceil(similarity * n - 1e-9) + 1].view(np.int64) if n else np.zeros(1, dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(counts, pa.binary()), pa.array(fps, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))],
                names=["node", "id", "n", "counts", "fp", "tokens"],
            )

    return texts.select("node", "id", F.col("text").cast("binary").alias("text")).mapInArrow(work, "node long, id long, n long, counts binary, fp long, tokens array<long>")


def _possible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(a, b, a_id, b_id): the pairs (a, b) whose shingle counts by low bits leave room for the similarity.

    Two sets share at most the smaller count of each cell; no pair at the similarity is dropped.
    """
    for node in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(node), F.col("id").alias(f"{node}_id"), F.col("n").alias(f"{node}_n"), F.col("counts").alias(f"{node}_counts")), node)
    pairs = pairs.where(F.least("a_n", "b_n") >= F.greatest("a_n", "b_n") * similarity - 1e-6)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype="<u2").reshape(-1, CELLS) for i in (6, 7))
            size = batch.column(4).to_numpy() + batch.column(5).to_numpy()
            both = np.minimum(x, y).sum(axis=1, dtype=np.int64)
            keep = (both >= similarity * (size - both) - 1e-6) | (np.maximum(x, y).max(axis=1, initial=0) == 0xFFFF)
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=["a", "b", "a_id", "b_id"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "a_id", "b_id", "a_n", "b_n", "a_counts", "b_counts").mapInArrow(work, "a long, b long, a_id long, b_id long")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets of word shingles have this Jaccard similarity; ``texts`` has node, id and text, and a pair the ids too."""
    wanted = cut(pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("a_id").alias("id")), F.struct(F.col("b").alias("node"), F.col("b_id").alias("id")))).alias("w")).select("w.*").distinct())
    if wanted.count() <= BROADCAST_ROWS:  # other texts need not travel
        texts = texts.join(F.broadcast(wanted), ["node", "id"], "left_semi")
    side = lambda node, text: texts.select(F.col("node").alias(node), F.col("id").alias(f"{node}_id"), F.col("text").alias(text))
    rows = pairs.join(side("a", "left"), ["a", "a_id"]).join(side("b", "right"), ["b", "b_id"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (shingle_set(v.as_py(), shingle) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.select("a", "b", F.col("left").cast("binary"), F.col("right").cast("binary")).mapInArrow(work, "a long, b long").distinct()


def grid_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): texts whose fingerprints are within two bits, as stars, from the popcount grid."""
    by_fp = cut(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    same = nodes.join(by_fp, "fp").select(F.col("node").alias("a"), F.col("first").alias("b"))
    near = links(by_fp.select("fp"))
    for end in ("a", "b"):
        near = near.join(by_fp.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_first")), end)
    return same.unionByName(near.select(F.col("a_first").alias("a"), F.col("b_first").alias("b")))


def star_pairs(members: DataFrame) -> DataFrame:
    """(a, b): each text with three of every group of texts that share a token of their prefixes.

    One of the three has the token earliest: it has the fewest rare tokens of its own, so
    most likely it is the original of copies.
    """
    three = members.groupBy("token").agg(F.array(F.min_by("node", F.struct("place", "node")), F.min("node"), F.min_by("node", F.xxhash64("node"))).alias("three"))
    return members.join(three, "token").select(F.col("node").alias("a"), F.explode("three").alias("b"))


def _class_of(n: Column) -> Column:
    """Classes of sizes, each five parts in a hundred wider than the one before; 0 is a class of its own."""
    return F.when(n > 0, F.floor(F.log(n.cast("double")) / math.log(1.05))).otherwise(F.lit(-1)).cast("int")


def parity(values: np.ndarray) -> np.ndarray:
    """Each shingle flips one bit: two sets differ in at least as many shingles as their parities in bits."""
    bit = (values >> np.uint64(40)) % np.uint64(PARITY_WORDS * 64)
    odd = np.bincount(bit.astype(np.int64), minlength=PARITY_WORDS * 64) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def parities(nodes: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(node, parity) of the texts of ``nodes``."""
    nodes = cut(nodes.select("node").distinct())
    of = F.broadcast(nodes) if nodes.count() <= BROADCAST_ROWS else nodes

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [parity(shingle_set(text.as_py(), shingle)).tolist() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], names=["node", "parity"])

    rows = texts.join(of, "node", "left_semi").select("node", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(work, "node long, parity array<long>").groupBy("node").agg(F.first("parity").alias("parity"))


def remaining_pairs(members: DataFrame, texts: DataFrame, roots: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b): pairs of a group that are not connected yet and can have the similarity, by the places of the shared token.

    Let x be the smaller set and y the larger. Both keep at least t / (1 + t) of their joint size
    after the place of their first shared token. So x has that token very early (the place
    that fits a partner of its own size), and the later y has it, the smaller x is: y looks it up in the
    size classes that are left. In each group only texts outside its largest component look up or are
    looked up, so copies that are connected are not listed pair by pair. Where more than ``HOT`` of such texts share a token,
    pairs are listed only if their parities leave room for the similarity: pairs of texts that are just less alike are compared there
    and not listed, and none at the similarity is dropped.
    """
    t = similarity
    of = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = of.groupBy("token", "root").agg(F.count(F.lit(1)).alias("rows"))
    major = sizes.groupBy("token").agg(F.max_by("root", F.struct("rows", "root")).alias("major"), F.count(F.lit(1)).alias("roots"), (F.sum("rows") - F.max("rows")).alias("minors")).where("roots > 1").select("token", "major", (F.col("minors") > HOT).alias("hot"))
    of = cut(of.join(major, "token").select("token", "node", "root", "n", "place", (F.col("root") != F.col("major")).alias("minor"), "hot"))
    hot = of.where("hot")
    hot = cut(hot.join(parities(hot, texts, shingle), "node"))
    differ = sum((F.bit_count(F.get("a_parity", F.lit(i)).bitwiseXOR(F.get("b_parity", F.lit(i)))) for i in range(PARITY_WORDS)), F.lit(0))
    room = differ <= (F.col("a_n") + F.col("b_n")) * F.lit((1 - t) / (1 + t)) + 1e-6
    return _looked_up(of.where("not hot").withColumn("parity", F.lit(None)), t).unionByName(_looked_up(hot, t, room))


def _looked_up(of: DataFrame, t: float, room: Column | None = None) -> DataFrame:
    """The pairs of ``remaining_pairs`` among members; ``room`` is one more condition, on a_parity and b_parity."""
    early = of.where(F.col("n") - F.col("place") >= F.ceil(F.lit(2 * t / (1 + t)) * F.col("n") - 1e-9))
    x = early.select("token", _class_of(F.col("n")).alias("class"), F.col("node").alias("a"), F.col("root").alias("a_root"), F.col("n").alias("a_n"), F.col("place").alias("a_place"), F.col("minor").alias("a_minor"), F.col("parity").alias("a_parity"))
    most = F.least(F.col("n").cast("double"), F.lit((1 + t) / t) * (F.col("n") - F.col("place")) - F.col("n") + 1e-6)
    y = of.withColumn("most", most).where(F.col("most") >= F.col("n") * t - 1e-6)
    classes = F.sequence(_class_of(F.floor(F.col("n") * t)), _class_of(F.ceil(F.col("most"))))
    y = y.select("token", F.explode(classes).alias("class"), F.col("node").alias("b"), F.col("root").alias("b_root"), F.col("n").alias("b_n"), F.col("place").alias("b_place"), F.col("minor").alias("b_minor"), F.col("parity").alias("b_parity"))
    fits = F.expr("a_root <> b_root and a_n <= b_n") & (F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place")) >= (F.col("a_n") + F.col("b_n")) * F.lit(t / (1 + t)) - 1e-6) & (F.col("a_n") >= F.col("b_n") * t - 1e-6)
    fits = fits if room is None else fits & room
    met = x.where("a_minor").join(y, ["token", "class"]).where(fits).select("a", "b")
    return met.unionByName(x.where("not a_minor").join(y.where("b_minor"), ["token", "class"]).where(fits).select("a", "b"))


def similar(nodes: DataFrame, texts: DataFrame, *, shingle: int, similarity: float) -> DataFrame:
    """(a, b): links by which every two texts at the similarity are connected. ``nodes`` as from ``prefixes``, one row each.

    Candidates come from the popcount grid of the fingerprints and from stars over texts that share a
    token of their prefixes; what these leave unconnected is compared pair by pair. All are verified
    exactly, so no pair at the similarity is lost, and a large group of copies is not listed pair by pair.
    """
    members = nodes.select("node", "n", F.posexplode("tokens").alias("place", "token"))
    shared = members.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("token")
    members = cut(members.join(shared, "token").select("token", "node", "n", "place"))
    first = cut(_possible(_ordered(grid_pairs(nodes).unionByName(star_pairs(members))), nodes, similarity))
    found = cut(_verified(first, texts, shingle, similarity))
    rest = _ordered(remaining_pairs(members, texts, cut(components(found)), shingle, similarity)).join(first.select("a", "b"), ["a", "b"], "left_anti")
    more = _verified(cut(_possible(rest, nodes, similarity)), texts, shingle, similarity)
    # Computed anew, so that Spark does not take the two for partitioned alike and zip them.
    return found.unionByName(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def keep_one(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents left when one of each group of near-duplicates stays, that with the smallest id.

    Texts are near-duplicates at a Jaccard similarity of their sets of word shingles of at
    least ``similarity``; every such pair is found and checked exactly. Of rows with the same id
    and text one stays; a null id counts as the largest.

    Texts are read where they lie and only prefixes are gathered by text. Rows of a text that
    no other row has and that no group drops are left where they are; others are sorted out by
    text hash in salts, so that a text with very many copies is no single task.
    """
    rows = docs.withColumn("__node", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)))
    texts = rows.select(F.col("__node").alias("node"), F.col("__id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    nodes = prefixes(texts, shingle=shingle, similarity=similarity).groupBy("node").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.first("counts").alias("counts"), F.first("fp").alias("fp"), F.first("tokens").alias("tokens"))
    nodes = cut(nodes)
    roots = components(similar(nodes, texts, shingle=shingle, similarity=similarity))
    named = nodes.select("node", "id", "rows").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = named.groupBy("root").agg(F.min(F.struct("id", "node")).alias("k")).select(F.col("k.node").alias("node"), F.lit(True).alias("stays"))
    several = cut(named.join(kept, "node", "left").where("stays is null or rows > 1").select(F.col("node").alias("__node"), F.col("id").alias("__id"), F.coalesce("stays", F.lit(False)).alias("__stays")))
    alone = join_small(rows, several.select("__node"), ["__node"], "left_anti")
    first = join_small(rows, several.where("__stays").select("__node", "__id"), ["__node", "__id"])
    one = Window.partitionBy("__id", "__node").orderBy(F.lit(0))
    first = first.withColumn("__n", F.row_number().over(one)).where("__n = 1")
    return alone.select(*docs.columns).unionByName(first.select(*docs.columns))


def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprint and the component that it is in."""
    rows = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

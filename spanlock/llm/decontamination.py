"""Benchmark decontamination: pigeonhole edit matching.

Texts are folded to lower-case words joined by single spaces. An item may occur in a
document with at most k edits (``errors`` of its length). Split into k + 1 pieces, at least
one piece of an occurrence is unedited, so exact piece hits, found for all pieces at once by
an Aho-Corasick automaton over the whole document, are candidates for all occurrences. Each
hit places a window of the document, where Myers' bit-parallel algorithm gives the smallest
edit distance of the item to any part of it.

Items are taken in blocks of at most ``block_chars`` characters, so an automaton is of
bounded size; each block is held against all documents. Output is one row for each document
and item that match, with the best occurrence.

Defined cases: null texts are empty; an item without words matches nothing; an item too
short for an edit must occur exactly and as whole words; repeated items and repeated documents are reported
each; of equally near occurrences the first one found is reported, and of the parts that end there the shortest; very long texts are searched whole, a
very long item is one block of its own; empty tables give an empty result; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: One edit is allowed for this many characters of an item.
CHARS_PER_ERROR = 16
BLOCK_CHARS = 2 << 20

RESULT = "doc_id long, item_id long, start long, distance int, errors int"


def fold(column: str) -> Column:
    """Lower-case letters and digits, anything between them one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(column, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " "))


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): errors + 1 pieces of nearly equal length."""
    cuts = [i * len(item) // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(item_masks: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """(distance, end): the smallest edit distance of the item to a part of the text, and where that part ends."""
    ones = (1 << length) - 1
    high = 1 << (length - 1)
    plus, minus = ones, 0
    distance = best = length
    end = 0
    for j, c in enumerate(text):
        eq = item_masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & ones
        mh = plus & xh
        if ph & high:
            distance += 1
        elif mh & high:
            distance -= 1
        if distance < best:
            best, end = distance, j + 1
        ph = ph << 1 & ones  # an occurrence may begin anywhere: no carry into the first row
        mh = mh << 1 & ones
        plus = mh | ~(xv | ph) & ones
        minus = ph & xv
    return best, end


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    held, size = [], 0
    for row in items.toLocalIterator():
        if row["folded"]:
            held.append((row["item_id"], row["folded"]))
            size += len(row["folded"])
        if size >= block_chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def matcher(items: list[tuple[int, str]], chars_per_error: int):
    """A function from a folded text to its matches: {item number: (distance, start)}.

    The start of a match with edits comes from the same search backwards from its end.
    """
    automaton = ahocorasick.Automaton()
    budget = [len(t) // chars_per_error for _, t in items]
    bits = [masks(t) for _, t in items]
    backwards: dict[int, dict[str, int]] = {}
    found: dict[str, list[tuple[int, int]]] = {}
    for i, (_, t) in enumerate(items):
        for offset, piece in pieces(t, budget[i]):
            found.setdefault(piece, []).append((i, offset))
    for piece, where in found.items():
        automaton.add_word(piece, (len(piece), where))
    automaton.make_automaton()

    def start_of(i: int, text: str, low: int, end: int) -> int:
        """Where the best part of text[low:end] begins; nothing that ends earlier is as near, so it ends at ``end``."""
        if i not in backwards:
            backwards[i] = masks(items[i][1][::-1])
        return end - myers(backwards[i], len(items[i][1]), text[low:end][::-1])[1]

    def match(text: str) -> dict[int, tuple[int, int]]:
        seen: set[tuple[int, int]] = set()
        best: dict[int, tuple[int, int]] = {}
        window_of: dict[int, tuple[int, int]] = {}
        for stop, (length, where) in automaton.iter(text):
            for i, offset in where:
                begin = stop + 1 - length - offset  # where the item would begin without edits before the piece
                k, n = budget[i], len(items[i][1])
                if i in best and best[i][0] == 0:
                    continue
                if k == 0:  # the hit is the whole item; it counts as words of its own
                    if (begin == 0 or text[begin - 1] == " ") and text[begin + n : begin + n + 1] in ("", " "):
                        best[i] = (0, begin)
                    continue
                # Begins that fall in one cell share a window that holds them all.
                cell = begin // (k + 1)
                if (i, cell) in seen:
                    continue
                seen.add((i, cell))
                low = max(0, cell * (k + 1) - k)
                window = text[low : max(0, cell * (k + 1) + k + n + k)]
                distance, end = myers(bits[i], n, window)
                if distance <= k and (i not in best or distance < best[i][0]):
                    best[i] = (distance, low + end)
                    window_of[i] = (low, low + end)
        return {i: (distance, start_of(i, text, *window_of[i]) if i in window_of else at) for i, (distance, at) in best.items()}

    return match


def contaminated(docs: DataFrame, items: DataFrame, *, chars_per_error: int = CHARS_PER_ERROR, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, start, distance, errors): every item that occurs in a document with at most ``errors`` edits."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold("text").alias("folded"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), fold("text").alias("folded"))
    spark = docs.sparkSession

    def scan(block: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            match = matcher(shared.value, chars_per_error)
            for batch in batches:
                out = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    for i, (distance, start) in match(text.as_py()).items():
                        item, t = shared.value[i]
                        out.append((doc, item, start, distance, len(t) // chars_per_error))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "item_id", "start", "distance", "errors"])

        return rows.mapInArrow(work, RESULT)

    scans = [scan(block) for block in _blocks(items, block_chars)]
    return reduce(DataFrame.unionAll, scans) if scans else spark.createDataFrame([], RESULT)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

"""Document fingerprints that are invertible Bloom lookup sketches of paragraph digests.

A text is cut into units (paragraphs, and long ones at sentence ends); the set of their
64-bit digests goes into a sketch of cells, each the XOR of its digests. Every digest enters
one cell in each of four rows and carries 20 bits that check the other 44. The sketches of
two versions subtract (XOR) cell by cell, and what is left is the sketch of the digests that
only one version has: a cell whose check bits fit holds a single digest and gives it away,
the digest is taken out of its other cells, and so on (peeling).

If a difference is too large for the sketch, both digest sets are split by digest into
parts of about twelve and each part gets a sketch of its own, so that capacity grows with
the texts; a part that still fails is tried with four times the cells and other hash bits,
and at last compared digest by digest. Likeness is the Jaccard similarity of the digest
sets, from their sizes and the number of recovered differences.

All of it is built-in SQL functions: arrays inside a row, without Python and without a
shuffle of digests. Splitting in two levels keeps the work at n**1.5 for a text of n units.

Defined cases: null text is empty; two texts without units have likeness 1; units repeated
in a text count once; after the last document comes the first, and a single document is its
own next; documents with the same id are ordered by their texts' hash (rows equal in both follow each other in
any order); null ids come first; very long texts are cut whole into units; extra columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Rows of a sketch, and cells in each row of the fingerprint (a power of two).
ROWS, WIDTH = 4, 8

#: Digests, of both versions together, in a part of the second try.
PART = 12

#: Documents in a run of consecutive ids, and at most how many runs there are.
RUN_ROWS, MAX_RUNS = 2048, 1 << 16

#: Low bits of a digest that check the others.
CHECK_BITS = 20
CHECK_MASK = (1 << CHECK_BITS) - 1

#: A unit: whole sentences of 40 to 160 characters together, or 40 characters up to the next space, or the rest of the line.
UNIT = r"[^\\n]{40,160}?[.!?](?=\\s)|[^\\n]{40,}?(?=\\s)|[^\\n]+"


def digests(text: str) -> Column:
    """The distinct digests of the non-blank units of a text column.

    A digest is 44 hash bits of the unit and 20 check bits of those.
    """
    units = f"filter(transform(regexp_extract_all({text}, '{UNIT}', 0), u -> btrim(u, ' \\t\\r\\f')), u -> u <> '')"
    return F.expr(f"array_distinct(transform(transform({units}, u -> xxhash64(u) & {~CHECK_MASK}L), h -> h | (xxhash64(h) & {CHECK_MASK}L)))")


def _at(row: int, bits: int, tried: int) -> int:
    """The lowest of the digest bits that choose the cell in a row."""
    return CHECK_BITS + tried + row * bits


def sketch(keys: str, width: int = WIDTH, tried: int = 0) -> str:
    """SQL of the cells of an array of digests: one array of XORs for each row."""
    bits = width.bit_length() - 1
    rows = []
    for row in range(ROWS):
        low = _at(row, bits, tried)
        cells = ",".join(f"{c << low}L" for c in range(width))
        rows.append(f"transform(array({cells}), c -> aggregate(filter({keys}, k -> (k & {(width - 1) << low}L) = c), 0L, (a, k) -> a ^ k))")
    return f"concat({','.join(rows)})"


def subtract(left: str, right: str) -> str:
    return f"zip_with({left}, {right}, (x, y) -> x ^ y)"


def _pure(cells: str) -> str:
    """The digests that lie alone in a cell: their check bits fit."""
    return f"array_distinct(filter({cells}, x -> (x & {CHECK_MASK}L) = (xxhash64(x & {~CHECK_MASK}L) & {CHECK_MASK}L) and x <> 0L))"


def peel(cells: str, width: int = WIDTH, tried: int = 0) -> str:
    """SQL of the digests in a subtracted sketch, as an array, or null if it does not come apart."""
    step = (
        "if(size(s.pure) = 0, s, element_at(transform(array("
        f"{subtract('s.cells', sketch('s.pure', width, tried))}), c -> struct(c as cells, {_pure('c')} as pure, concat(s.got, s.pure) as got)), 1))"
    )
    begin = f"element_at(transform(array({cells}), c -> struct(c as cells, {_pure('c')} as pure, cast(array() as array<bigint>) as got)), 1)"
    rounds = f"sequence(1, {2 * width})"
    return f"aggregate({rounds}, {begin}, (s, r) -> {step}, s -> if(exists(s.cells, x -> x <> 0L), cast(null as array<bigint>), s.got))"


def difference(left: str, right: str) -> str:
    """SQL of the digests that only one of two arrays has, by sketches of parts."""
    def try_part(width: int, tried: int) -> str:
        return peel(subtract(sketch("p.l", width, tried), sketch("p.r", width, tried)), width, tried)

    exact = "concat(array_except(p.l, p.r), array_except(p.r, p.l))"
    found = f"coalesce({try_part(WIDTH, 0)}, {try_part(4 * WIDTH, ROWS * 3)}, {exact})"
    side = f"greatest(1, cast(ceil(sqrt((size({left}) + size({right})) / {PART}D)) as int))"
    part = lambda keys, at, of, which: f"filter({keys}, k -> shiftrightunsigned(k, {at}) % {of} = {which})"
    inner = (
        "flatten(transform(transform(sequence(0, g.side - 1), j -> struct("
        f"{part('g.l', 40, 'g.side', 'j')} as l, {part('g.r', 40, 'g.side', 'j')} as r)), p -> {found}))"
    )
    groups = f"transform(sequence(0, {side} - 1), i -> struct({side} as side, {part(left, 33, side, 'i')} as l, {part(right, 33, side, 'i')} as r))"
    return f"flatten(transform({groups}, g -> {inner}))"


def differing(left: str, left_cells: str, right: str, right_cells: str) -> str:
    """SQL of the digests that only one of two versions has: their sketches peeled, with larger sketches where those fail."""
    return f"coalesce({peel(subtract(left_cells, right_cells))}, {difference(left, right)})"


def recovered(left: str, left_cells: str, right: str, right_cells: str) -> Column:
    """(only_left, only_right): the recovered digests by the version that has them; each side knows its own."""
    found = differing(left, left_cells, right, right_cells)
    return F.expr(f"element_at(transform(array({found}), d -> struct(array_intersect(d, {left}) as only_left, array_intersect(d, {right}) as only_right)), 1)")


def likeness(left: str, left_cells: str, right: str, right_cells: str) -> Column:
    """Jaccard similarity of two digest arrays from their sizes and the number of digests recovered."""
    both = f"(size({left}) + size({right}))"
    found = f"size({differing(left, left_cells, right, right_cells)})"
    return F.expr(f"if({both} = 0, 1D, element_at(transform(array({found}), d -> ({both} - d) / cast({both} + d as double)), 1))")


def text_of(cells: str) -> Column:
    """A sketch as a string: its cells in hexadecimal."""
    return F.expr(f"lower(array_join(transform({cells}, x -> lpad(hex(x), 16, '0')), ''))")


def _run_of(bounds: list[int]) -> Column:
    """The number of bounds that are not above ``__id``, through two short arrays."""
    if not bounds:
        return F.lit(0)
    wide = max(1, math.isqrt(len(bounds)))
    blocks = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    heads = "array(" + ",".join(f"{b[0]}L" for b in blocks) + ")"
    body = "array(" + ",".join("array(" + ",".join(f"{x}L" for x in b) + ")" for b in blocks) + ")"
    return F.expr(f"element_at(transform(array(size(filter({heads}, b -> b <= __id))), h -> if(h = 0, 0, (h - 1) * {wide} + size(filter(element_at({body}, h), b -> b <= __id)))), 1)")


def with_next(docs: DataFrame, ahead: dict[str, str]) -> DataFrame:
    """Adds columns of the next document by id; after the last document comes the first.

    ``ahead`` maps new columns to the columns of the next row that they take. Ids are cut into
    runs at quantiles; the first row of each run is also sent to the run before it, so that
    a window over runs sees every next row and no task sees all rows.
    """
    rows = docs.withColumn("__key", F.xxhash64("text")).withColumn("__known", F.col("doc_id").isNotNull()).withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.col("__key")))
    ids = rows.select("__known", "__id")
    counts = {r["__known"]: r["n"] for r in ids.groupBy("__known").agg(F.count(F.lit(1)).alias("n")).collect()}
    number = F.lit(0)
    before = 0
    for known in (False, True):  # null ids first, by text hash
        runs = min(MAX_RUNS, counts.get(known, 0) // RUN_ROWS + 1)
        bounds: list[int] = []
        if runs > 1:
            bounds = sorted(set(ids.where(F.col("__known") == known).agg(F.percentile_approx("__id", [i / runs for i in range(1, runs)], 10 * runs)).first()[0]))
        number = F.when(F.col("__known") == known, F.lit(before) + _run_of(bounds)).otherwise(number)
        before += len(bounds) + 1
    rows = rows.withColumn("__run", number)
    place = F.struct("__known", "__id", "__key")
    firsts = sorted((r["__run"], r["f"]["__id"], r["f"]["__key"]) for r in rows.groupBy("__run").agg(F.min(place).alias("f")).collect())  # a row for each run
    own = F.struct(F.col("__run").alias("run"), F.lit(0).alias("wrap"), F.lit(False).alias("extra"))
    places = F.array(own)
    if firsts:
        before = {run: firsts[i - 1][0] for i, (run, _, _) in enumerate(firsts)}
        to = F.element_at(F.create_map(*[F.lit(x) for item in before.items() for x in item]), F.col("__run"))
        again = F.struct(to.alias("run"), (F.col("__run") == firsts[0][0]).cast("int").alias("wrap"), F.lit(True).alias("extra"))
        first = F.col("__id").isin([f[1] for f in firsts]) & F.col("__key").isin([f[2] for f in firsts])
        places = F.when(first, F.array(own, again)).otherwise(F.array(own))
    rows = rows.select(*docs.columns, "__known", "__id", "__key", F.explode(places).alias("__p"))
    order = Window.partitionBy("__p.run").orderBy("__p.wrap", "__known", "__id", "__key", "__p.extra")
    rows = rows.withColumns({new: F.lead(c).over(order) for new, c in ahead.items()})
    return rows.where("not __p.extra").select(*docs.columns, *ahead)


def op10_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and likeness to the edit and to the next document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("a", digests("text")).withColumn("ca", F.expr(sketch("a")))
    rows = with_next(docs, {"next_text": "text", "b": "a", "cb": "ca"}).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 4 as int)), substring(next_text, 1, cast(n_chars div 4 as int)))"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digests("edited").alias("e"), "a", "b", "ca", "cb")
    rows = rows.withColumn("ce", F.expr(sketch("e")))
    return rows.select("doc_id", "n_chars", "edited_sha256", text_of("ca").alias("fingerprint"), text_of("ce").alias("edited_fingerprint"), likeness("a", "ca", "e", "ce").alias("near_edited"), likeness("a", "ca", "b", "cb").alias("near_next"))

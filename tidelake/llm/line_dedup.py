"""Near-duplicate lines: MinHash over character shingles, banding, exact Jaccard, union-find. DataFrame functions only.

1. Each line's shingles are hashed once, to 64 bits. Three windows of the hash are three orders of the shingles; XOR with
   masks whose leading bits differ starts each in eight places, which gives the MinHash values, pre-aggregated on the
   map side. Copies of a line share its hash and count once from here on.
2. Lines that agree in a band meet. Each is verified against the centre of its band, the line that shares its bands
   with most others, by the exact Jaccard similarity of their shingle sets: as many pairs as lines, not all pairs.
3. Lines of a star that are not in one component yet meet again in tiles. A pair is passed on, to be verified from its
   texts, only if its sketches allow it, so hardly more pairs are made than there are links.
4. Of each component and of each set of copies one line stays: the one in the smallest document, first place.

Why step 3 loses no pair: lines of na and nb shingles are similar by at least t if and only if they differ in at most
(1 - t) / (1 + t) * (na + nb) shingles. The sketch of a line holds, for each of some bits, the parity of how many of the
shingles that set it apart from the centre have that bit. What two such differences share cancels out, so the XOR of two
sketches is the sketch of what sets the lines apart from each other: it has at most as many bits as they differ in shingles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stash
from .graph import components
from .names import unused

SHINGLE = 8  # characters
BANDS, ROWS = 8, 3  # a pair of similarity 0.8 meets with probability 1 - (1 - 0.8**3)**8 = 0.997
WORDS = 16  # of 64 bits, in a sketch
TILE = 512  # lines of a part of a large star; two parts meet in a tile
CELLS = 1 << 20  # bound of the broadcast table that sorts out lines without partner before the shuffle


def _masks(n: int) -> list[int]:
    """Fixed 32-bit masks by a linear congruential rule."""
    found, x = [], 0x2545F491
    for _ in range(n):
        x = (x * 1664525 + 1013904223) & 0xFFFFFFFF
        found.append((x ^ (x >> 15)) - (1 << 31))
    return found


def _orders() -> list[tuple[int, int]]:
    """How far the hash is shifted and the mask, for each MinHash value, band by band. The leading bits of a mask are the
    number of its band, so the bands take their shingles from different parts of the hashes: masks alike in these bits
    would let several bands pick the same shingle. The rows of a band are different windows of the hash."""
    low = iter(_masks(2 * BANDS * ROWS))
    masks = [(b - BANDS // 2 << 61) + ((next(low) & 0x1FFFFFFF) << 32) + (next(low) & 0xFFFFFFFF) for b in range(BANDS) for _ in range(ROWS)]
    return [(64 // ROWS * (k % ROWS), mask) for k, mask in enumerate(masks)]


def _lines(docs: DataFrame) -> DataFrame:
    """One row per line that isn't blank: where it is, the line without outer spaces, its hash, and a mark of its place."""
    cut = docs.select("__id", "__th", F.posexplode(F.split("__text", "\n")).alias("__pos", "__raw"))
    line = cut.select("__id", "__th", "__pos", F.trim("__raw").alias("line")).where("line <> ''")
    return line.withColumn("key", F.xxhash64("line")).withColumn("place", F.xxhash64("__id", "__th", "__pos"))


def _coded(lines: DataFrame, *columns: str) -> DataFrame:
    """``columns, units, wide, last``: the characters of each line in two bytes each, or in four (``wide``) where
    some need a surrogate pair, and the place of the last shingle."""
    two = lines.select(*columns, "line", F.encode("line", "UTF-16BE").alias("two"))
    wide = two.withColumn("wide", F.octet_length("two") > 2 * F.length("line"))
    units = F.when(F.col("wide"), F.encode("line", "UTF-32")).otherwise(F.col("two"))
    last = F.greatest(F.length("line") - F.lit(SHINGLE), F.lit(0))
    return wide.select(*columns, units.alias("units"), "wide", last.alias("last"))


def _starts(side: str = "") -> Column:
    """Where the shingles of a line start in its bytes, from 1."""
    step = F.when(F.col("wide" + side), 4).otherwise(2)
    return F.sequence(F.lit(1), F.col("last" + side) * step + 1, step)


def _pairs(units: Column, at: Column) -> Column:
    return F.substring(units, at, F.lit(2 * SHINGLE))


def _fours(units: Column, at: Column) -> Column:
    """A shingle of a line of four bytes each, in UTF-16 like all others; the mark in front is the decoder's."""
    found = F.substring(units, at, F.lit(4 * SHINGLE))
    return F.encode(F.decode(F.concat(F.lit(b"\0\0\xfe\xff"), found), "UTF-32"), "UTF-16BE")


def _signed(lines: DataFrame) -> DataFrame:
    """``key, n, place, bands`` of each different line: its copies, and the mark of one place where it stands."""
    # the encoding stands in a projection of its own, below the generator: once per line, not per shingle
    each = _coded(lines, "key", "place").select("key", "place", "units", "wide", F.explode(_starts()).alias("at"))
    shingle = F.when(F.col("wide"), _fours(F.col("units"), F.col("at"))).otherwise(_pairs(F.col("units"), F.col("at")))
    hashed = each.select("key", "place", F.xxhash64(shingle).alias("h"), (F.col("at") == 1).alias("first"))
    lows = [F.min(F.shiftleft("h", by).bitwiseXOR(F.lit(mask))).alias(f"m{k}") for k, (by, mask) in enumerate(_orders())]
    signed = hashed.groupBy("key").agg(*lows, F.count_if("first").alias("n"), F.min("place").alias("place"))
    bands = [F.xxhash64(F.lit(b), *[F.col(f"m{b * ROWS + k}") for k in range(ROWS)]) for b in range(BANDS)]
    return signed.select("key", "n", "place", F.array(*bands).alias("bands"))


def _members(signed: DataFrame) -> DataFrame:
    """``band, key, size`` for each band that different lines share; size: the lines of the band."""
    rows = signed.select("key", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    return rows.join(shared, "band")


def _stars(members: DataFrame, signed: DataFrame) -> DataFrame:
    """``a, b, size``: each line b with the centre a of each of its bands, and how many lines have that centre."""
    meets = members.groupBy("key").agg(F.sum("size").alias("meets")).join(signed.select("key", "n"), "key")
    best = F.max(F.struct("meets", "n", "key")).alias("best")
    centres = members.join(meets, "key").groupBy("band").agg(best).select("band", F.col("best.key").alias("a"))
    pairs = members.join(centres, "band").where("key <> a").select("a", F.col("key").alias("b")).distinct()
    return pairs.join(pairs.groupBy("a").agg(F.count("*").alias("size")), "a")


def _shingles(side: str) -> Column:
    """The set of a line's shingles, each as a 64-bit hash."""
    units, at = F.col("units" + side), _starts(side)

    def each(cut: Callable[[Column, Column], Column]) -> Column:
        # the bytes are the variable of an outer function: from the row they would be copied for each shingle
        return F.transform(F.array(units), lambda u: F.transform(at, lambda i: F.xxhash64(cut(u, i))))[0]

    return F.array_distinct(F.when(F.col("wide" + side), each(_fours)).otherwise(each(_pairs)))


def _compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) with ``x, y``, their shingle sets, ``na, nb``, the sizes of these, ``d``, in how many shingles
    they differ, and ``j``, the exact Jaccard similarity."""
    both = pairs
    for side in "ab":
        both = both.join(texts.select(F.col("key").alias(side), *[F.col(c).alias(c + side) for c in ("units", "wide", "last")]), side)
    sets = both.select(*pairs.columns, _shingles("a").alias("x"), _shingles("b").alias("y"))
    shared = sets.select("*", F.size("x").alias("na"), F.size("y").alias("nb"), F.size(F.array_intersect("x", "y")).alias("shared"))
    either = F.col("na") + F.col("nb") - F.col("shared")
    return shared.withColumn("j", F.col("shared") / either).withColumn("d", either - F.col("shared"))


def _sketched(compared: DataFrame) -> DataFrame:
    """``a, b, size, nb, d, j`` and the words ``s0, s1, ...`` of the sketch of what sets b apart from a; zeros where no other line has the centre."""
    apart = F.when(F.col("size") > 1, F.concat(F.array_except("x", "y"), F.array_except("y", "x")))
    own = ("a", "b", "size", "nb", "d", "j")
    each = compared.select(*own, F.explode_outer(apart).alias("e"))
    word, bit = F.shiftright("e", 6).bitwiseAND(F.lit(WORDS - 1)), F.expr("shiftleft(1L, cast(e & 63 as int))")
    return each.groupBy(*own).agg(*[F.coalesce(F.bit_xor(F.when(word == k, bit)), F.lit(0)).alias(f"s{k}") for k in range(WORDS)])


def _tiled(rest: DataFrame, least: float) -> DataFrame:
    """``a, b``: pairs of lines of a star (``centre, key, own, n, d, lines`` and a sketch) in different components (own) that
    may be similar; in tiles of two parts of about ``TILE`` lines."""
    parts = F.ceil(F.col("lines") / TILE).cast("int")
    dealt = rest.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    line = ["key", "own", "n", "d", *[f"s{k}" for k in range(WORDS)]]
    one = dealt.select("centre", F.col("part").alias("i"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("j"), *[F.col(c).alias("x_" + c) for c in line])
    two = dealt.select("centre", F.explode(F.sequence(F.lit(0), "part")).alias("i"), F.col("part").alias("j"), *[F.col(c).alias("y_" + c) for c in line])
    apart = F.lit((1 - least) / (1 + least)) * (F.col("x_n") + F.col("y_n")) + 1e-6  # what similar lines differ in, at most
    sizes = F.least("x_n", "y_n") >= F.lit(least) * F.greatest("x_n", "y_n") - 1e-6
    bits = [F.bit_count(F.col(f"x_s{k}").bitwiseXOR(F.col(f"y_s{k}"))) for k in range(WORDS)]
    near = (F.abs(F.col("x_d") - F.col("y_d")) <= apart) & (sum(bits[1:], bits[0]) <= apart)
    met = one.join(two, ["centre", "i", "j"]).where("(i < j OR x_key < y_key) AND x_own <> y_own").where(sizes & near)
    return met.select(F.least("x_key", "y_key").alias("a"), F.greatest("x_key", "y_key").alias("b")).distinct()


def _second_meeting(scored: DataFrame, united: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """``a, b``: the links between lines of a star that the links with its centre leave in different components."""
    labelled = scored.where("size > 1").join(united.select(F.col("node").alias("b"), "component"), "b", "left")
    rows = labelled.withColumn("own", F.coalesce("component", "b"))
    groups = rows.groupBy("a").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low <> high").select("a")
    rest = rows.join(groups, "a").select(
        F.col("a").alias("centre"), F.col("b").alias("key"), "own", F.col("nb").alias("n"), "d", F.col("size").alias("lines"), *[f"s{k}" for k in range(WORDS)]
    )
    return _compared(stash(_tiled(rest, least), "pairs"), texts).where(F.col("j") >= least).select("a", "b")


def _united(lines: DataFrame, signed: DataFrame, least: float) -> DataFrame:
    """``node, component`` of the lines that are similar to another line, also by steps."""
    members = stash(_members(signed), "bands")
    # texts of the lines that have a partner, from the one place that is known for each
    wanted = signed.join(members.select("key").distinct(), "key", "left_semi").select("key", "place")
    cell = F.pmod(F.col("key"), F.lit(CELLS))
    cells = members.select(cell.alias("cell")).distinct()  # at most CELLS rows
    near = lines.withColumn("cell", cell).join(F.broadcast(cells), "cell", "left_semi")
    found = near.join(wanted, ["key", "place"], "left_semi").select("key", "line")
    texts = stash(_coded(found.dropDuplicates(["key"]), "key"), "texts")

    scored = stash(_sketched(_compared(_stars(members, signed), texts)), "links")
    linked = scored.where(F.col("j") >= least).select("a", "b")
    united = components(linked)
    more = stash(_second_meeting(scored, united, texts, least), "links")
    return united if more.isEmpty() else components(linked.unionByName(more))


def line_decisions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """``__id, __th, drops``: places (from 0) of the lines that go, for each document that loses any."""
    docs = df.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__th"), F.col(text_col).alias("__text"))
    lines = _lines(docs)
    signed = stash(_signed(lines), "signed")
    united = _united(lines, signed, least)
    owned = signed.select("key", "n").join(united, F.col("key") == F.col("node"), "left").where("n > 1 OR component IS NOT NULL")
    repeated = owned.select("key", F.coalesce("component", "key").alias("own"))
    at = F.struct(F.col("__id").alias("i"), F.col("__pos").alias("p"), F.col("__th").alias("t"))
    places = stash(lines.select("key", at.alias("at")).join(repeated, "key").select("own", "at"), "places")
    kept = places.groupBy("own").agg(F.min("at").alias("kept"))
    gone = places.join(kept, "own").where(~F.col("at").eqNullSafe(F.col("kept")))
    return gone.groupBy(F.col("at.i").alias("__id"), F.col("at.t").alias("__th")).agg(F.collect_set("at.p").alias("drops"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, count: bool = False) -> DataFrame:
    """The documents without lines that repeat or nearly repeat another line of the table.

    Lines are compared without outer spaces; blank lines stay. Of lines joined by similarity of at least ``least``
    (also by steps) one stays, in the document with the smallest id (null first), at its first place. All columns
    and rows stay: a document may become empty, a null text stays null, rows that repeat id and text are treated
    alike, so a kept line stays in each. ``count`` adds ``n_lines`` and ``n_dropped`` (long).
    """
    other_id, other_th, drops = unused(df, "id", "hash", "drops")
    found = line_decisions(df, id_col, text_col, least).select(F.col("__id").alias(other_id), F.col("__th").alias(other_th), F.col("drops").alias(drops))
    same = F.col(id_col).eqNullSafe(F.col(other_id)) & (F.xxhash64(text_col) == F.col(other_th))
    joined = df.join(found, same, "left")
    cut = F.split(text_col, "\n")
    kept = F.filter(cut, lambda x, i: ~F.array_contains(drops, i))
    text = F.when(F.col(drops).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    columns = [text.alias(c) if c == text_col else F.col(c) for c in df.columns]
    if count:
        columns += [
            F.coalesce(F.size(cut), F.lit(0)).cast("long").alias("n_lines"),
            F.coalesce(F.size(drops), F.lit(0)).cast("long").alias("n_dropped"),
        ]
    return joined.select(*columns)

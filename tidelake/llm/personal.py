"""Personal data: base patterns with exact places, and terms that disclose a protected entity. DataFrame functions only.

An entity is a value found by a base pattern. Over all documents, the information content of an entity e is
IC(e) = -log2 P(e), and a term t tells PMI(t; e) = log2(P(t, e) / (P(t) P(e))) of it. A term discloses e as far as
PMI reaches IC, that is, as far as documents with t are documents with e. Terms whose ratio PMI / IC reaches the
disclosure threshold, with enough different texts behind it, are further spans: they are generalised, and removed
from the removal threshold on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stash
from .names import unused

# The kinds in their order. The patterns match what the plain ones match (leftmost, no overlap); a
# look-behind and possessive quantifiers keep them linear on long runs, and free of deep recursion.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
TERM = "term"
WORD = r"\P{L}+"  # what separates terms
SHORTEST = 4  # letters of a term in lower case; shorter ones are terms if they have a capital, or letters without case
DISCLOSES, REMOVES = 0.9, 0.99  # PMI / IC
SUPPORT = 3  # different texts that hold both the term and the entity
CELLS = 1 << 20  # bound of broadcast tables that sort rows out before a shuffle


def _maybe(kind: str, text: Column) -> Column:
    """A cheap condition that holds wherever the kind can occur."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    if kind == "ip":
        return text.rlike(r"[0-9]\.[0-9]++\.[0-9]")
    return text.rlike("[0-9](?:[ -]?[0-9]){11}")


def _digits(value: str) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: Column, value: str) -> Column:
    digits = _digits(value)
    small = F.forall(F.split(value, r"\."), lambda x: _at_most_255(x))
    card = F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", small)
        .when(kind == "card", card)
        .otherwise(F.length(digits).between(9, 15))
    )


def _at_most_255(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= F.lit("255")))


def base_spans(docs: DataFrame) -> DataFrame:
    """``__id, __th, kind, start, end, value`` of the base matches that pass. docs: __id, __th, __text."""
    found = []
    for kind in KINDS:
        hit = docs.where(_maybe(kind, F.col("__text")))
        values = F.regexp_extract_all("__text", F.lit(PATTERNS[kind]), F.lit(0))
        gaps = F.split("__text", PATTERNS[kind], -1)
        both = hit.select("__id", "__th", F.arrays_zip(values.alias("value"), F.transform(gaps, F.length).alias("gap")).alias("m"))
        each = both.select("__id", "__th", F.lit(kind).alias("kind"), F.posexplode("m").alias("n", "m"))
        found.append(each.where("m.value IS NOT NULL").select("__id", "__th", "kind", "n", "m.value", "m.gap"))
    rows = found[0]
    for x in found[1:]:
        rows = rows.unionByName(x)
    # rows that repeat id and text give the same matches
    before = W.partitionBy("__id", "__th", "kind").orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = rows.distinct().withColumn("end", F.sum(F.col("gap") + F.length("value")).over(before))
    spans = placed.select("__id", "__th", "kind", (F.col("end") - F.length("value")).alias("start"), "end", "value")
    return spans.where(_valid(F.col("kind"), "value"))


def _terms(text: Column) -> Column:
    """Distinct terms of a text without what the base patterns match."""
    for kind in KINDS:
        text = F.when(_maybe(kind, text), F.regexp_replace(text, PATTERNS[kind], " ")).otherwise(text)
    return F.array_distinct(F.filter(F.split(text, WORD), lambda w: (F.length(w) >= SHORTEST) | w.rlike(r"[^\p{Ll}]")))


def disclosing_terms(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``term, ratio`` of the terms that disclose an entity. docs: __id, __th, __text; every row counts."""
    total = F.lit(docs.count())
    entities = spans.select("__id", "__th", F.concat_ws(":", "kind", "value").alias("entity")).distinct()
    copies = docs.groupBy("__id", "__th").agg(F.count("*").alias("rows"))
    held = entities.join(copies, [F.col("rows") > 0, entities["__id"].eqNullSafe(copies["__id"]), entities["__th"] == copies["__th"]])
    held = stash(held.select(entities["__id"], entities["__th"], "entity", "rows"), "entities")
    known = held.groupBy("entity").agg(F.sum("rows").alias("n_entity"), F.count_distinct("__th").alias("texts")).where(F.col("texts") >= SUPPORT)
    wide = held.join(known.select("entity", "n_entity"), "entity")

    # PMI / IC >= r means P(e | t) >= P(e) ** (1 - r), so a term that discloses e is in at most n_e / P(e) ** (1 - r) documents;
    # only terms below the largest of these bounds meet the entities of their documents
    most = known.agg(F.max(F.col("n_entity") * F.pow(total / F.col("n_entity"), F.lit(1 - DISCLOSES))))
    counts = docs.select(F.explode(_terms(F.col("__text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    rare = counts.where(F.col("n_term") >= SUPPORT).join(F.broadcast(most.toDF("most")), F.col("n_term") <= F.col("most")).select("term", "n_term")

    cells = wide.select(F.pmod("__th", F.lit(CELLS)).alias("cell")).distinct()  # at most CELLS rows
    near = docs.withColumn("cell", F.pmod("__th", F.lit(CELLS))).join(F.broadcast(cells), "cell", "left_semi")
    words = near.select("__id", "__th", F.explode(_terms(F.col("__text"))).alias("term")).distinct().join(rare, "term")
    both = wide.alias("w").join(words.alias("d"), [F.col("w.__th") == F.col("d.__th"), F.col("w.__id").eqNullSafe(F.col("d.__id"))])
    joint = both.groupBy("entity", "term", "n_entity", "n_term").agg(F.sum("rows").alias("n_both"), F.count_distinct("w.__th").alias("texts"))
    content = -F.log2(F.col("n_entity") / total)
    shared = F.log2(F.col("n_both") * total / (F.col("n_term") * F.col("n_entity")))
    told = joint.where(F.col("texts") >= SUPPORT).withColumn("ratio", F.when(content > 0, shared / content).otherwise(F.lit(0.0)))
    return told.groupBy("term").agg(F.max("ratio").alias("ratio")).where(F.col("ratio") >= DISCLOSES)


def term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``__id, __th, kind, start, end, value, ratio`` wherever one of the terms stands as a whole word."""
    cells = terms.select(F.pmod(F.xxhash64("term"), F.lit(CELLS)).alias("cell")).distinct()  # at most CELLS rows
    words = docs.select("__id", "__th", "__text", F.explode(_terms(F.col("__text"))).alias("term"))
    near = words.withColumn("cell", F.pmod(F.xxhash64("term"), F.lit(CELLS))).join(F.broadcast(cells), "cell", "left_semi")
    hits = near.join(terms, "term")
    # a term is letters only, so it needs no quoting
    parts = F.transform(F.split("__text", F.concat(F.lit(r"(?<!\p{L})"), F.col("term"), F.lit(r"(?!\p{L})")), F.lit(-1)), F.length)
    each = hits.select("__id", "__th", "term", "ratio", F.posexplode(parts).alias("n", "gap")).distinct()
    before = W.partitionBy("__id", "__th", "term").orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = W.partitionBy("__id", "__th", "term")
    placed = each.withColumn("start", F.sum("gap").over(before) + F.col("n") * F.length("term")).withColumn("last", F.max("n").over(last))
    found = placed.where("n < last").withColumn("end", F.col("start") + F.length("term"))
    return found.select("__id", "__th", F.lit(TERM).alias("kind"), "start", "end", F.col("term").alias("value"), "ratio")


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__th"), text.alias("__text"))


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All spans: ``__id, __th, kind, start, end, value, ratio`` (null for base kinds); places count code points.

    Base spans always stay; a term span that overlaps a base span is left out, as its text is gone with it.
    """
    docs = _keyed(df, id_col, text_col)
    base = stash(base_spans(docs), "spans")
    terms = stash(disclosing_terms(docs, base), "terms")
    more = term_spans(docs, terms)
    own = base.select(F.col("__id").alias("i"), F.col("__th").alias("t"), F.col("start").alias("s"), F.col("end").alias("e"))
    apart = more.join(own, [F.col("__th") == F.col("t"), F.col("__id").eqNullSafe(F.col("i")), F.col("start") < F.col("e"), F.col("s") < F.col("end")], "left_anti")
    return stash(base.withColumn("ratio", F.lit(None).cast("double")).unionByName(apart), "spans")


def _joined(items: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, TERM)])
    return F.array_join(F.transform(items, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["start"], x["end"])), ",")


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for each row.

    A null text counts as empty: no spans, the digest of the empty string. Rows that repeat id and text get the
    same result each; null ids stay; other columns are not read. An empty table gives no rows.
    """
    found = spans(df, id_col, text_col)
    order = F.array_position(F.array(*[F.lit(k) for k in (*KINDS, TERM)]), F.col("kind")).cast("int") - 1
    item = F.struct(F.col("start"), order.alias("k"), F.col("end"))
    grouped = found.groupBy("__id", "__th").agg(F.sort_array(F.collect_list(item)).alias("items"))
    keyed = _keyed(df, id_col, text_col).select(F.col("__id").alias(id_col), F.col("__th").alias("__key"))
    both = keyed.join(grouped, [F.col("__key") == F.col("__th"), F.col(id_col).eqNullSafe(F.col("__id"))], "left")
    items = F.coalesce("items", F.array().cast("array<struct<start:bigint,k:int,end:bigint>>"))
    full = both.select(id_col, items.alias("items"))
    base = F.filter("items", lambda x: x["k"] < len(KINDS))

    def of_kind(n: int) -> Column:
        return F.size(F.filter("items", lambda x: x["k"] == n)).cast("long")

    counts = [of_kind(n).alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return full.select(id_col, *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("items")).alias("spans"))


def sanitised(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns, the text without personal data: base spans become ``[email]`` and so on, disclosing
    terms ``[term]``, and from the removal threshold on nothing. Of overlapping spans the first, then longest,
    takes effect, and what sticks out of it goes with it. A null text stays null."""
    found = spans(df, id_col, text_col)
    items, other_id, other_th = unused(df, "items", "id", "hash")
    mark = F.when((F.col("kind") == TERM) & (F.col("ratio") >= REMOVES), "").otherwise(F.concat(F.lit("["), F.col("kind"), F.lit("]")))
    item = F.struct("start", (-F.col("end")).alias("minus"), mark.alias("mark"))
    grouped = found.groupBy(F.col("__id").alias(other_id), F.col("__th").alias(other_th)).agg(F.sort_array(F.collect_list(item)).alias(items))
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    both = df.join(grouped, [key == F.col(other_th), F.col(id_col).eqNullSafe(F.col(other_id))], "left")

    def step(done: Column, x: Column) -> Column:
        gap = F.substring(F.col(text_col), done["at"] + 1, x["start"] - done["at"])
        fresh = x["start"] >= done["at"]
        return F.struct(
            F.greatest(done["at"], -x["minus"]).cast("int").alias("at"),
            F.when(fresh, F.concat(done["out"], gap, x["mark"])).otherwise(done["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cast = F.transform(items, lambda x: F.struct(x["start"].cast("int").alias("start"), x["minus"].cast("int").alias("minus"), x["mark"].alias("mark")))
    rest = lambda d: F.concat(d["out"], F.substring(F.col(text_col), d["at"] + 1, F.length(text_col)))
    text = F.when(F.col(items).isNull(), F.col(text_col)).otherwise(F.aggregate(cast, start, step, rest))
    return both.select(*[text.alias(c) if c == text_col else F.col(c) for c in df.columns])

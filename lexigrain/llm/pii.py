r"""Personal data and the terms that give it away.

Base spans are found by four patterns (email, ip, card, phone), leftmost and
non-overlapping for each kind, and checked (parts of an address, number of
digits, Luhn).  Where a match lies follows from the lengths of the matches and
of the gaps between them, as running sums of a window; positions count code
points.  The patterns are written with possessive repetition and a look behind
at their start, which finds the same matches in time linear in the text.

The method then asks which ordinary terms reveal a protected value.  The words
of two letters or more within ``CONTEXT`` characters of a base span, on any line
of the text, are the value's context there; a word that the context's far edge
may cut is left out.  With N documents, n(e) of them holding the value e, n(t)
the term t, and n(e,t) the term in a context of e,

    PMI(e;t) = log2(N n(e,t) / (n(e) n(t)))   and   IC(e) = -log2(n(e) / N);

PMI / IC is the share of the value's information that the term discloses, 1
when the term occurs with no other value.  A pair with a share of ``DISCLOSURE``
or more that two different contexts at least bear out is disclosing, and every
occurrence of its term in a document that holds its value becomes a span of kind
``term``.  Counts are grouped sums over all documents.  A disclosing term is in
at most (N / n(e))^(1 - DISCLOSURE) times as many documents as it is near its
value, which bounds the rows that look for its occurrences.  ``sanitised``
replaces base spans by their kind and generalises such terms.

Only SQL functions run.  Texts aren't shuffled for finding spans, as long as the
disclosing pairs are proven few enough to be broadcast.

Defined results: null and empty texts have no spans; rows that repeat a doc_id
each get their own text's spans; null ids are kept; terms that touch a base
span are left to it; of overlapping spans ``sanitised`` replaces the union;
other columns pass through ``sanitised`` untouched, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace, spread

_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
KINDS = {
    # \G: a match may also start where the one before ended, inside a run of such characters.
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_HINT = {"email": "@", "ip": ".", "card": None, "phone": "+"}
TERM = r"\p{L}[\p{L}\p{N}_]++"
#: Characters on each side of a span, and the matches at most that can lie in so many (three characters each at least).
CONTEXT, PIECES = 120, 40
DISCLOSURE = 0.8
#: Rows of small tables (ids, terms) that are broadcast at most.
BROADCAST_ROWS = 200_000
_KEY = ["doc_id", "text_hash"]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right doubled, its digits added; the sum a multiple of ten."""

    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    values = F.transform(F.reverse(F.split(digits, "")), worth)
    return F.aggregate(values, F.lit(0), lambda s, x: s + x) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    digits = _digits(value)
    part = lambda p: F.ltrim(p, F.lit("0")).rlike(r"^(?:|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", F.forall(F.split(value, r"\."), part))
        .when(kind == "card", F.length(digits).between(13, 19) & F.when(F.length(digits) <= 19, _luhn(digits)).otherwise(False))
        .otherwise(F.length(digits).between(9, 15))
    )


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _small(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it is proven to have few rows, to be built into hash tables by partition otherwise."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df.hint("shuffle_hash")


def _placed(rows: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``end`` to rows (.., i, value, gap length n): where the i-th match ends, as a running sum over gaps and matches."""
    # Rows that repeat a document wholly would count their lengths twice.
    order = Window.partitionBy(*by).orderBy("i")
    return rows.withColumn("end", F.sum(F.col("n").cast("long") + F.coalesce(F.length("value"), F.lit(0))).over(order))


def _matches(docs: DataFrame) -> DataFrame:
    """Valid base spans: key, kind, value, start, end, and the text before and after within ``CONTEXT``."""
    for kind, pattern in KINDS.items():
        hit = F.col("text").contains(_HINT[kind]) if _HINT[kind] else F.lit(True)
        docs = docs.withColumn(f"m_{kind}", F.when(hit, _found(F.col("text"), pattern)))
    # Only texts with a match are cut into gaps.
    docs = docs.where(reduce(lambda a, b: a | b, (F.size(f"m_{k}") > 0 for k in KINDS)))
    each = F.array(
        *(
            F.when(
                F.size(f"m_{k}") > 0,
                F.struct(F.lit(k).alias("kind"), F.col(f"m_{k}").alias("values"), F.split("text", p, -1).alias("gaps")),
            )
            for k, p in KINDS.items()
        )
    )
    kinds = docs.select(*_KEY, F.explode(F.filter(each, lambda x: x.isNotNull())).alias("k"))
    most = F.lit(CONTEXT)
    gaps = F.transform("k.gaps", lambda g: F.struct(F.length(g).alias("n"), F.right(g, most).alias("tail"), F.left(g, most).alias("head")))
    rows = kinds.select(*_KEY, F.col("k.kind").alias("kind"), F.posexplode(F.arrays_zip(F.col("k.values").alias("value"), gaps.alias("gap"))).alias("i", "m"))
    rows = rows.select(*_KEY, "kind", "i", F.col("m.value").alias("value"), F.col("m.gap").alias("gap"))
    rows = rows.groupBy(*_KEY, "kind", "i").agg(F.first("value").alias("value"), F.first("gap").alias("gap"))
    rows = _placed(rows.select(*_KEY, "kind", "i", "value", "gap.n", "gap.tail", "gap.head"), [*_KEY, "kind"])
    # Pieces of the text, a gap and the match after it, or the match before it: enough of them on each side make a context.
    value = F.coalesce("value", F.lit(""))
    before, after = F.right(F.concat("tail", F.right(value, most)), most), F.left(F.concat("head", F.left(value, most)), most)
    order = Window.partitionBy(*_KEY, "kind").orderBy("i")
    earlier = F.collect_list(before).over(order.rowsBetween(-PIECES, -1))
    later = F.collect_list(after).over(order.rowsBetween(1, PIECES))
    rows = rows.withColumn("left", F.right(F.concat(F.array_join(earlier, ""), F.col("tail")), most)).withColumn("right", F.left(F.array_join(later, ""), most))
    rows = rows.where("value is not null").select(*_KEY, "kind", "value", (F.col("end") - F.length("value")).alias("start"), "end", "left", "right")
    return rows.where(_valid(F.col("kind"), F.col("value")))


def _context_terms(base: DataFrame) -> DataFrame:
    """Terms of the spans' contexts: key, entity, context, term."""
    # A word that begins at the edge of a context that doesn't begin its text may be cut off.
    left = F.when(F.col("start") > CONTEXT, F.regexp_replace("left", r"^[\p{L}\p{N}_]++", "")).otherwise(F.col("left"))
    right = F.when(F.length("right") == CONTEXT, F.regexp_replace("right", r"[\p{L}\p{N}_]++$", "")).otherwise(F.col("right"))
    words = F.array_distinct(_found(F.lower(F.concat(left, F.lit("\n"), right)), TERM))
    context = F.xxhash64("left", "right")
    return base.select(*_KEY, F.concat_ws(":", "kind", F.lower("value")).alias("entity"), context.alias("context"), F.explode(words).alias("term"))


def _revealing(base: DataFrame, keyed: DataFrame, work: Workspace, disclosure: float) -> DataFrame:
    """(entity, term) pairs of which the term discloses enough of the entity."""
    n = F.lit(keyed.count())
    held = base.select(*_KEY, F.concat_ws(":", "kind", F.lower("value")).alias("entity")).distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    together = (
        _context_terms(base)
        .groupBy(*_KEY, "entity", "term")
        .agg(F.min("context").alias("low"), F.max("context").alias("high"))
        .groupBy("entity", "term")
        .agg(F.count("*").alias("n_et"), F.min("low").alias("low"), F.max("high").alias("high"))
        .where("low < high")
        .select("entity", "term", "n_et")
    )
    together = work.write(together, "together")
    # Counted for all terms: sums per task first, and the rows that travel follow the vocabulary, not the candidates.
    counted = keyed.select(F.explode(F.array_distinct(_found(F.lower("text"), TERM))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    ic = -F.log2(F.col("n_e") / n)
    pmi = F.log2(n * F.col("n_et") / (F.col("n_e") * F.col("n_t")))
    found = together.join(held, "entity").join(counted, "term").where((ic > 0) & (pmi >= F.lit(disclosure) * ic)).select("entity", "term")
    return work.write(found, "revealing")


def _term_spans(base: DataFrame, keyed: DataFrame, revealing: DataFrame, work: Workspace) -> DataFrame:
    """key, start, end of every occurrence of a disclosing term in the documents that hold its entity."""
    holders = base.select(*_KEY, F.concat_ws(":", "kind", F.lower("value")).alias("entity")).distinct()
    known = revealing.select(F.col("term").alias("known"), "entity")
    small = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = keyed if small else keyed.join(holders.select(*(F.col(c).alias(f"h_{c}") for c in _KEY)).distinct().hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("h_doc_id")) & (F.col("text_hash") == F.col("h_text_hash")), "left_semi")
    words = texts.select(*_KEY, F.explode(F.array_distinct(_found(F.lower("text"), TERM))).alias("term"))
    met = words.join(F.broadcast(known) if small else known, F.col("term") == F.col("known")).select(*_KEY, "term", "entity")
    same = F.col("doc_id").eqNullSafe(F.col("h_doc_id")) & (F.col("text_hash") == F.col("h_text_hash")) & (F.col("entity") == F.col("h_entity"))
    owners = holders.select(*(F.col(c).alias(f"h_{c}") for c in [*_KEY, "entity"]))
    wanted = met.join(owners, same, "left_semi").groupBy(*_KEY).agg(F.collect_set("term").alias("terms"))
    wanted = work.write(wanted, "wanted").select(F.col("doc_id").alias("h_doc_id"), F.col("text_hash").alias("h_text_hash"), "terms")
    rows = keyed.join(_small(wanted), F.col("doc_id").eqNullSafe(F.col("h_doc_id")) & (F.col("text_hash") == F.col("h_text_hash"))).select(*_KEY, "text", "terms")
    gaps = F.transform(F.split("text", TERM, -1), lambda g: F.length(g))
    rows = rows.select(*_KEY, "terms", F.posexplode(F.arrays_zip(_found(F.col("text"), TERM).alias("value"), gaps.alias("n"))).alias("i", "m"))
    rows = rows.select(*_KEY, "i", F.col("m.value").alias("value"), F.col("m.n").alias("n"), F.array_contains("terms", F.lower("m.value")).alias("reveals"))
    rows = rows.groupBy(*_KEY, "i").agg(F.first("value").alias("value"), F.first("n").alias("n"), F.first("reveals").alias("reveals"))
    return _placed(rows, _KEY).where("reveals").select(*_KEY, (F.col("end") - F.length("value")).alias("start"), "end")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE) -> DataFrame:
    """(doc_id, text_hash, spans): for texts with any, their spans as sorted (place, start, end, kind)."""
    work = Workspace(docs.sparkSession, "personal-data")
    keyed = spread(_keyed(docs, id_col, text_col))
    base = work.write(_matches(keyed), "base")
    terms = _term_spans(base, keyed, _revealing(base, keyed, work, disclosure), work)

    place = F.when(F.col("kind") == "email", 0).when(F.col("kind") == "ip", 1).when(F.col("kind") == "card", 2).otherwise(3)
    one = base.select(*_KEY, place.alias("place"), "start", "end", "kind")
    two = terms.select(*_KEY, F.lit(4).alias("place"), "start", "end", F.lit("term").alias("kind"))
    order = Window.partitionBy(*_KEY).orderBy("start", "place")
    own = lambda c: F.when(F.col("place") < 4, F.col(c))
    reached = F.max(own("end")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(own("start")).over(order.rowsBetween(1, Window.unboundedFollowing))
    rows = one.unionAll(two).withColumn("reached", reached).withColumn("ahead", ahead)
    touches = (F.coalesce("reached", F.lit(-1)) > F.col("start")) | (F.coalesce(F.col("ahead") < F.col("end"), F.lit(False)))
    kept = rows.where((F.col("place") < 4) | ~touches)
    return kept.groupBy(*_KEY).agg(F.sort_array(F.collect_set(F.struct("place", "start", "end", "kind"))).alias("spans"))


def _joined(docs: DataFrame, found: DataFrame) -> DataFrame:
    found = found.select(F.col("doc_id").alias("f_id"), F.col("text_hash").alias("f_hash"), "spans")
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("text_hash") == F.col("f_hash")), "left").drop("f_id", "f_hash")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row."""
    work = Workspace(docs.sparkSession, "personal-data-spans")
    found = work.write(spans(docs, id_col, text_col), "spans")
    rows = _joined(_keyed(docs, id_col, text_col).drop("text"), found)
    listed = F.coalesce(F.col("spans"), F.array().cast(found.schema["spans"].dataType))
    named = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.array_join(F.transform(F.filter(listed, lambda x: x["place"] < 4), named), ",")
    count = lambda k: F.size(F.filter(listed, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *(count(k) for k in KINDS), F.sha2(base.cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform(listed, named), ",").alias("spans"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with base spans replaced by their kind and disclosing terms generalised, columns as they were."""
    work = Workspace(docs.sparkSession, "personal-data-spans")
    found = work.write(spans(docs, id_col, text_col), "spans")
    columns = docs.columns
    found = found.select(F.col("doc_id").alias("f_id"), F.col("text_hash").alias("f_hash"), "spans")
    # The table's own columns travel as one struct, so that no name of theirs can clash with ours.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col(id_col).alias("own_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("own_hash"))
    # The spans are the small side: built into a hash table, with the texts streamed past it.
    rows = rows.join(found.hint("shuffle_hash"), F.col("own_id").eqNullSafe(F.col("f_id")) & (F.col("own_hash") == F.col("f_hash")), "left")
    kind = "array<struct<start:bigint,end:bigint,kind:string>>"
    by_start = F.sort_array(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    merged = F.aggregate(
        by_start,
        F.array().cast(kind),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.coalesce(last(acc)["end"], F.lit(-1)) > x["start"]),
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], x["end"]).alias("end"), last(acc)["kind"].alias("kind"))),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    text = F.col(f"row.`{text_col}`")
    rows = rows.select("row", F.when(F.size("spans") > 0, merged).alias("merged"))
    since = lambda i: F.when(i > 0, F.get("merged", i - 1)["end"]).otherwise(F.lit(0))
    piece = F.transform("merged", lambda x, i: F.concat(F.substr(text, (since(i) + 1).cast("int"), (x["start"] - since(i)).cast("int")), F.lit("["), F.upper(x["kind"]), F.lit("]")))
    rest = F.substr(text, (last(F.col("merged"))["end"] + 1).cast("int"))
    clean = F.when(F.col("merged").isNotNull(), F.concat(F.array_join(piece, ""), rest)).otherwise(text)
    return rows.select(*((clean if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in columns))

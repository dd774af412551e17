"""Token analysis: surface tokens and the filters that rewrite or drop them.

A token table has doc_id, seq (place among all tokens of the text), pos_inc (how
far its position lies after the one before) and term.  Filters that leave a
hole keep pos_inc; filters that skip a token hand nothing on.  Dictionaries are
small lookup tables of terms, broadcast by Spark when they are below its own
threshold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOWER, UPPER = "a-zà-öø-ÿœ", "A-ZÀ-ÖØ-ÞŒ"
WORD = f"[{UPPER}{LOWER}][{UPPER}{LOWER}0-9]*(?:[-'][{UPPER}{LOWER}0-9]+)*"
SURFACE = f"<[^<>]*>|{WORD}|[0-9]+(?:[.,][0-9]+)*|[.!?]+|[,;:()|]"
SENTENCE_END = "^[.!?]+$"
CLITIC_KEEP = ("aujourd'hui", "c'est-à-dire", "peut-être", "vis-à-vis", "au-dessus", "au-dessous", "là-bas", "ci-dessus", "ci-dessous", "quelqu'un", "presqu'île", "prud'homme")
_PREFIX = re.compile(r"^(qu|jusqu|lorsqu|puisqu|quoiqu|[cdjlmnst])'", re.I)
_SUFFIX = re.compile(r"-(t-)?(je|tu|ils?|elles?|on|nous|vous|moi|toi|lui|leur|les?|la|ce|y|en|ci|là)$", re.I)


def surface(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, seq, pos_inc, term: words, numbers, tags and punctuation in their order."""
    found = F.regexp_extract_all(F.col(text), F.lit(SURFACE), F.lit(0))
    return df.select(F.col(id_col).alias("doc_id"), F.posexplode(found).alias("seq", "term")).select("doc_id", "seq", F.lit(1).alias("pos_inc"), "term")


#: Abbreviations that keep their dot.
ABBREVIATIONS = ("M", "MM", "Mr", "Mme", "Mlle", "Dr", "etc", "cf", "p", "pp", "vol", "fig", "chap", "art", "no", "env", "av", "apr")
_ENTITY = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}
LONGEST = 256


def markup_pattern(abbreviations: Sequence[str] = ABBREVIATIONS) -> str:
    """Tags, entities, dotted forms that keep their dot, words, numbers, sentence and clause punctuation, in this order.

    Dotted forms are initials joined by hyphens, groups of up to three letters with a dot each, listed abbreviations and
    single letters.  Any other dot after a word is sentence punctuation.
    """
    letter = f"[{UPPER}{LOWER}]"
    listed = "|".join(sorted((re.escape(a) for a in abbreviations), key=len, reverse=True))
    dotted = rf"[{UPPER}]\.(?:-[{UPPER}]\.)+|{letter}{{1,3}}\.(?:{letter}{{1,3}}\.)+|(?:{listed})\.|{letter}\."
    return f"<[^<>]*>|&(?:amp|lt|gt|quot|apos);|{dotted}|{WORD}|[0-9]+(?:[.,][0-9]+)*|[.!?…]+|[,;:()|—–]"


def markup(df: DataFrame, text: str = "text", id_col: str = "doc_id", abbreviations: Sequence[str] = ABBREVIATIONS) -> DataFrame:
    """doc_id, seq, pos_inc, term of marked-up text: typographic apostrophes and hyphens made plain, entities decoded, tokens cut at 256 characters."""
    found = df.select(F.col(id_col).alias("doc_id"), F.posexplode(_marked(F.col(text), abbreviations)).alias("seq", "term"))
    return found.select("doc_id", "seq", F.lit(1).alias("pos_inc"), _decoded(F.col("term")).alias("term"))


def _marked(text: Column, abbreviations: Sequence[str] = ABBREVIATIONS) -> Column:
    return F.regexp_extract_all(F.translate(text, "’ʼ‐‑", "''--"), F.lit(markup_pattern(abbreviations)), F.lit(0))


def _decoded(term: Column) -> Column:
    return F.coalesce(*(F.when(term == k, F.lit(v)) for k, v in _ENTITY.items()), F.left(term, F.lit(LONGEST)))


def is_word(term: Column) -> Column:
    return term.rlike(f"^{WORD}$")


def lines(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, line, term, start_off, end_off: each line that isn't empty is one token; offsets count code points."""
    rows = df.select("doc_id", F.posexplode(F.split(text, "\n", -1)).alias("line", "term"))
    end = F.sum(F.length("term") + 1).over(Window.partitionBy("doc_id").orderBy("line")) - 1
    return rows.withColumn("end_off", end).where("term <> ''").select("doc_id", "line", "term", (F.col("end_off") - F.length("term")).alias("start_off"), "end_off")


def _ordered():
    return Window.partitionBy("doc_id").orderBy("seq")


def stop(tokens: DataFrame, words: Sequence[str]) -> DataFrame:
    """Drop stop words; the next token keeps the gap."""
    dropped = F.lower("term").isin(list(words))
    marked = tokens.withColumn("out", dropped).withColumn("run", F.sum(F.when(F.col("out"), 0).otherwise(1)).over(_ordered()))
    # The dropped tokens since the kept one before: all that share its running number.
    gap = F.sum(F.when(F.col("out"), F.col("pos_inc")).otherwise(0)).over(_ordered())
    kept = marked.withColumn("gap", gap).where(~F.col("out"))
    before = F.coalesce(F.lag("gap").over(_ordered()), F.lit(0))
    return kept.withColumn("pos_inc", (F.col("pos_inc") + F.col("gap") - before).cast("int")).select(*tokens.columns)


def replaced(tokens: DataFrame, mapping: DataFrame) -> DataFrame:
    """Exact lookup of (surface, correction); a capitalised word without an entry is tried in lower case."""
    exact = mapping.select(F.col("surface").alias("s1"), F.col("correction").alias("c1"))
    low = mapping.select(F.col("surface").alias("s2"), F.col("correction").alias("c2"))
    rows = tokens.join(exact, F.col("term") == F.col("s1"), "left").join(low, F.col("term").rlike(f"^[{UPPER}]") & (F.lower("term") == F.col("s2")), "left")
    return rows.select("doc_id", "seq", "pos_inc", F.coalesce("c1", "c2", "term").alias("term"))


def uppercase_normalised(term: Column, keep: Sequence[str] = (), least: int = 4) -> Column:
    """Words all in capitals: kept if listed or one letter, dropped if short, else in title case, also after hyphens."""
    capital = term.rlike(f"^[{UPPER}]+(?:-[{UPPER}]+)*$")
    title = F.array_join(F.transform(F.split(term, "-"), lambda p: F.concat(F.substr(p, F.lit(1), F.lit(1)), F.lower(F.substr(p, F.lit(2))))), "-")
    return F.when(~capital, term).when(term.isin(list(keep)) | (F.length(term) == 1), term).when(F.length(term) < least, F.lit("")).otherwise(title)


def sentence_start_lowered(tokens: DataFrame, lexicon: Sequence[str]) -> DataFrame:
    """The first word of a sentence in lower case where the lexicon has it so."""
    before = F.lag("term").over(_ordered())
    first = before.isNull() | before.rlike(SENTENCE_END)
    low = F.lower("term")
    return tokens.withColumn("term", F.when(first & low.isin(list(lexicon)), low).otherwise(F.col("term")))


def initials_joined(tokens: DataFrame) -> DataFrame:
    """``J`` ``.`` ``Name`` become ``J. Name`` (not ``M``)."""
    o = _ordered()
    two, three = F.lead("term", 1).over(o), F.lead("term", 2).over(o)
    heads = F.col("term").rlike(f"^[{UPPER}]$") & (F.col("term") != "M") & (two == ".") & three.rlike(f"^[{UPPER}][{LOWER}]")
    marked = tokens.withColumn("head", F.coalesce(heads, F.lit(False))).withColumn("name", three)
    eaten = F.coalesce(F.lag("head", 1).over(o), F.lit(False)) | F.coalesce(F.lag("head", 2).over(o), F.lit(False))
    return marked.withColumn("eaten", eaten).where(~F.col("eaten")).select("doc_id", "seq", "pos_inc", F.when(F.col("head"), F.concat_ws(". ", "term", "name")).otherwise(F.col("term")).alias("term"))


def _first(lexicon: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The first entry of each key: by ``ord`` where the lexicon has it, else the least value."""
    order = F.min_by(value, F.struct("ord", value)) if "ord" in lexicon.columns else F.min(value)
    return lexicon.groupBy(*keys).agg(order.alias(value))


def lemmas(tokens: DataFrame, lexicon: DataFrame, proper: Sequence[str] = ()) -> DataFrame:
    """Adds lemma from (form, lemma), with the columns tag and ord where there are some.

    With a tag in both tables the entry of form and tag comes first, then the form's first entry, in ``ord`` (the least
    lemma without it).  A word that the lexicon lacks is tried in lower case, which then replaces the term, unless it is
    listed as proper or its second letter is a capital.
    """
    tagged = "tag" in tokens.columns and "tag" in lexicon.columns
    keep = [c for c in ("tag",) if c in tokens.columns]
    known = _first(lexicon, ["form"], "lemma")
    exact = known.select(F.col("form").alias("f1"), F.col("lemma").alias("l1"))
    low = known.select(F.col("form").alias("f2"), F.col("lemma").alias("l2"))
    retry = ~F.col("term").rlike(f"^.[{UPPER}]") & ~F.col("term").isin(list(proper))
    rows = tokens.join(exact, F.col("term") == F.col("f1"), "left").join(low, F.col("f1").isNull() & retry & (F.lower("term") == F.col("f2")), "left")
    rows = rows.withColumn("term", F.coalesce("f1", "f2", "term")).withColumn("lemma", F.coalesce("l1", "l2"))
    if tagged:
        both = _first(lexicon.where("tag is not null"), ["form", "tag"], "lemma").select(F.col("form").alias("f3"), F.col("tag").alias("t3"), F.col("lemma").alias("l3"))
        rows = rows.join(both, (F.col("term") == F.col("f3")) & (F.col("tag") == F.col("t3")), "left").withColumn("lemma", F.coalesce("l3", "lemma"))
    return rows.select("doc_id", "seq", "pos_inc", "term", *keep, "lemma")


def _by_size(entries: Sequence[str]) -> dict[int, list[str]]:
    """The expressions of two words or more by their number of words."""
    words: dict[int, set[str]] = {}
    for e in entries:
        words.setdefault(len(e.split()), set()).add(" ".join(e.split()).lower())
    return {n: sorted(w) for n, w in words.items() if n > 1}


def _taken(candidates: str) -> Column:
    """Of candidates (at, n, whole) in order, those that the ones before leave free."""
    empty = F.struct(F.lit(0).alias("next"), F.filter(candidates, lambda x: F.lit(False)).alias("taken"))
    take = lambda s, x: F.when(x["at"] >= s["next"], F.struct((x["at"] + x["n"]).alias("next"), F.array_append(s["taken"], x).alias("taken"))).otherwise(s)
    return F.aggregate(candidates, empty, take)["taken"]


def expressions(tokens: DataFrame, entries: Sequence[str]) -> DataFrame:
    """Longest listed multi-word expressions, left to right without overlap: one token each, with its canonical form.

    Where tokens have a lemma, an expression is met by forms or by lemmas; of equal length the one by forms goes first.
    Candidates are found by window functions.  Those that overlap form runs, which are resolved by a fold over the
    run's few candidates, so that no document is gathered as a whole.
    """
    words = _by_size(entries)
    sizes = sorted(words, reverse=True)
    lemma = "lemma" in tokens.columns
    plain = [c for c in ("doc_id", "seq", "pos_inc", "term", "tag") if c in tokens.columns]
    if not sizes:
        return tokens.select(*plain)
    o = _ordered()

    def grown(col: Column, n: int) -> Column:
        return F.concat_ws(" ", col, *(F.lead(col, j).over(o) for j in range(1, n)))

    form, root = F.lower("term"), (F.lower(F.coalesce("lemma", "term")) if lemma else None)
    numbered = tokens.select(*plain, F.row_number().over(o).alias("at"), *(grown(form, n).alias(f"g{n}") for n in sizes), *(grown(root, n).alias(f"r{n}") for n in sizes if lemma))
    listed = [(n, c) for n in sizes for c in ([f"g{n}", f"r{n}"] if lemma else [f"g{n}"])]
    size = F.coalesce(*(F.when(F.col(c).isin(words[n]), F.lit(n)) for n, c in listed))
    whole = F.coalesce(*(F.when(F.col(c).isin(words[n]), F.col(c)) for n, c in listed))
    numbered = numbered.select(*plain, "at", size.alias("n"), whole.alias("whole"))
    # Runs of candidates that overlap: a candidate that starts behind the end of all before it opens one.
    heads = numbered.where("n is not null").select("doc_id", "at", "n", "whole")
    by = Window.partitionBy("doc_id").orderBy("at")
    reach = F.max(F.col("at") + F.col("n")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    heads = heads.withColumn("opens", F.when(F.col("at") < reach, 0).otherwise(1)).withColumn("run", F.sum("opens").over(by))
    runs = heads.groupBy("doc_id", "run").agg(F.sort_array(F.collect_list(F.struct("at", "n", "whole"))).alias("c"))
    taken = runs.select("doc_id", F.explode(_taken("c")).alias("x"))
    covered = taken.select("doc_id", F.explode(F.sequence("x.at", F.col("x.at") + F.col("x.n") - 1)).alias("at"), F.col("x.at").alias("head"), F.col("x.whole").alias("canonical"))
    rows = numbered.select(*plain, "at").join(covered, ["doc_id", "at"], "left").where("head is null or head = at")
    return rows.select(*(F.coalesce("canonical", "term").alias("term") if c == "term" else F.col(c) for c in plain))


#: Tags of one-letter words that are words.
SHORT = ("ADP", "AUX", "PRON", "VERB")


def _skipped(term: Column, short: Column) -> Column:
    return term.rlike("^<") | ((F.length(term) == 1) & is_word(term) & ~short) | term.rlike("^..$") & term.rlike("['’.]$") | term.rlike(f"^[{UPPER}{LOWER}]+[0-9]+$")


def _shaped(term: Column) -> Column:
    return term.rlike(f"^{WORD}(?: {WORD})*$") & ~term.rlike("^[-']|[-'.]$")


def cleaned(tokens: DataFrame) -> DataFrame:
    """Final positions: tags and single characters vanish without a hole, punctuation and malformed words leave one.

    With a tag, words of one letter stay if they are of ``SHORT``.  With a lemma, it replaces the term of a word with
    good edges before its letters are looked at.  Returns doc_id, pos, term.
    """
    term = F.col("term")
    short = F.col("tag").isin(*SHORT) if "tag" in tokens.columns else F.lit(False)
    skipped = _skipped(term, F.coalesce(short, F.lit(False)))
    edges = ~term.rlike("^[-'0-9]|[-'.0-9]$") & term.rlike(f"[{UPPER}{LOWER}]")
    lemma = F.col("lemma") if "lemma" in tokens.columns else F.lit(None).cast("string")
    accepted = F.coalesce(edges & lemma.isNotNull(), F.lit(False)) | _shaped(term)
    rows = tokens.withColumn("skipped", skipped).withColumn("accepted", accepted).withColumn("shown", F.coalesce(lemma, term))
    place = F.sum(F.when(F.col("skipped"), 0).otherwise(F.col("pos_inc"))).over(_ordered()) - 1
    return rows.withColumn("pos", place.cast("int")).where(~F.col("skipped") & F.col("accepted")).select("doc_id", "pos", F.col("shown").alias("term"))


def canonic(stopwords: Sequence[str] = (), lexicon: DataFrame | None = None, entries: Sequence[str] = (), replacements: DataFrame | None = None, proper: Sequence[str] = (), split: bool = True):
    """The analysis chain, as a function from documents (doc_id, text) to positioned tokens (doc_id, pos, term).

    Markup tokens, clitics cut off, replacements, lemmas, expressions, stop words out with their gap, final positions;
    stages without their dictionary are left out.  A chain that looks nothing up and splits nothing has an attribute
    ``words``, which makes the same of each document in its own row (``canonic_words``).
    """

    def chain(docs: DataFrame) -> DataFrame:
        rows = markup(docs)
        if split:
            pieces = clitics(rows)
            # A split word takes one place for each of its pieces.
            order = Window.partitionBy("doc_id").orderBy("seq", "piece")
            rows = pieces.withColumn("seq", F.row_number().over(order) - 1).select("doc_id", "seq", F.lit(1).alias("pos_inc"), "term")
        if replacements is not None:
            rows = replaced(rows, replacements)
        if lexicon is not None:
            rows = lemmas(rows, lexicon, proper)
        if entries:
            merged = expressions(rows, entries)
            # An expression has no lemma, the others keep theirs.
            rows = merged.join(rows.select("doc_id", "seq", F.col("term").alias("alone"), "lemma"), ["doc_id", "seq"], "left").withColumn("lemma", F.when(F.col("alone") == F.col("term"), F.col("lemma"))).drop("alone") if lexicon is not None else merged
        if stopwords:
            rows = stop(rows, stopwords)
        return cleaned(rows)

    if lexicon is None and replacements is None and not split:
        chain.words = lambda docs: canonic_words(docs, stopwords, entries)
    return chain


def canonic_words(docs: DataFrame, stopwords: Sequence[str] = (), entries: Sequence[str] = ()) -> DataFrame:
    """The other columns of the documents, and ``words`` for their text: markup tokens, expressions, stop words and final positions, NULL for a hole.

    Each step rewrites the array of a document's tokens, so no token leaves its document's row.
    """
    keep = [c for c in docs.columns if c != "text"]
    once = lambda rows, value, *others: rows.select(*keep, *others, F.explode(F.array(value)).alias("x"))
    found = F.coalesce(_marked(F.col("text")), F.array().cast("array<string>"))
    rows = once(docs, F.transform(found, _decoded)).withColumnRenamed("x", "t")
    words = _by_size(entries)
    if words:
        sizes = sorted(words, reverse=True)
        rows = once(rows, F.transform("t", F.lower), "t").withColumnRenamed("x", "low")

        def candidate(x: Column, i: Column) -> Column:
            grown = {n: F.concat_ws(" ", x, *(F.get("low", i + j) for j in range(1, n))) for n in sizes}
            return F.coalesce(*(F.when(grown[n].isin(words[n]), F.struct(i.alias("at"), F.lit(n).alias("n"), grown[n].alias("whole"))) for n in sizes))

        rows = once(rows, F.array_compact(F.transform("low", candidate)), "t").withColumnRenamed("x", "c")
        rows = once(rows, _taken("c"), "t").withColumnRenamed("x", "h")
        behind = lambda k: F.coalesce(F.get("h", k)["at"] + F.get("h", k)["n"], F.lit(0))
        upto = lambda h, k: F.concat(F.slice("t", behind(k - 1) + 1, h["at"] - behind(k - 1)), F.array(h["whole"]))
        last = behind(F.size("h") - 1)
        rows = once(rows, F.concat(F.flatten(F.transform("h", upto)), F.slice("t", last + 1, F.size("t") - last))).withColumnRenamed("x", "t")
    stopped = (lambda x: F.lower(x).isin(list(stopwords))) if stopwords else (lambda x: F.lit(False))
    rows = once(rows, F.filter(F.transform("t", lambda x, i: F.struct(x.alias("term"), i.alias("at"))), lambda x: ~stopped(x["term"]))).withColumnRenamed("x", "k")
    # How many stop words were dropped before each token; those before a token that is skipped go with it.
    gap = lambda x, i: F.struct(x["term"].alias("term"), (x["at"] - F.coalesce(F.get("k", i - 1)["at"], F.lit(-1)) - 1).alias("gap"))
    rows = once(rows, F.filter(F.transform("k", gap), lambda x: ~_skipped(x["term"], F.lit(False)))).withColumnRenamed("x", "k")
    placed = F.flatten(F.transform("k", lambda x: F.concat(F.array_repeat(F.lit(None).cast("string"), x["gap"]), F.array(F.when(_shaped(x["term"]), x["term"])))))
    rows = once(rows, placed)
    width = F.coalesce(F.array_max(F.transform("x", lambda w, i: F.when(w.isNotNull(), i + 1))), F.lit(0))
    return rows.select(*keep, F.explode(F.array(F.slice("x", F.lit(1), width))).alias("words"))


def ocr_garbage(term: Column) -> Column:
    """True for words that scanning has spoiled: no two letters, three like letters in a row, or a bad edge."""
    return ~term.rlike(f"^[{UPPER}{LOWER}].*[{UPPER}{LOWER}]$") | F.lower(term).rlike(r"(.)\1\1")


def boundaries(tokens: DataFrame, sections: Sequence[str] = ("section", "article", "div"), paragraphs: Sequence[str] = ("p", "li", "h1", "h2")) -> DataFrame:
    """Tags become marks: the close of a section a §, of a paragraph a ¶; of marks in a row one stays, a § if there is one."""
    name = F.lower(F.regexp_extract("term", "^</([A-Za-z0-9]+)", 1))
    kind = F.when(name.isin(list(sections)), 2).when(name.isin(list(paragraphs)), 1).otherwise(0)
    marked = tokens.withColumn("kind", F.when(F.col("term").rlike("^<"), kind)).where(F.col("kind").isNull() | (F.col("kind") > 0))
    island = F.sum(F.when(F.col("kind").isNull(), 1).otherwise(0)).over(_ordered())
    marked = marked.withColumn("island", island)
    words = marked.where("kind is null").select("doc_id", "seq", "term")
    marks = marked.where("kind is not null").groupBy("doc_id", "island").agg(F.min("seq").alias("seq"), F.max("kind").alias("k"))
    return words.unionByName(marks.select("doc_id", "seq", F.when(F.col("k") == 2, "§").otherwise("¶").alias("term")))


def _zone_matches(tag: Column, expr: Sequence[str]) -> Column:
    """Whether an opening tag fits one of the atoms: a local element name, ``@attr`` or ``@attr="value"``."""
    names, tests = [], [F.lit(False)]
    for atom in expr:
        atom = atom.strip()
        if not atom.startswith("@"):
            names.append(atom.rpartition(":")[2].lower())
            continue
        m = re.fullmatch(r"@([^\s=]+)(?:\s*=\s*(['\"])(.*?)\2)?", atom)
        if not m:
            raise ValueError(f"bad attribute test {atom!r}")
        name, value = re.escape(m[1].rpartition(":")[2]), m[3]
        attribute = rf"\s(?:[^\s=<>:]+:)?{name}"
        tests.append(tag.rlike(rf"{attribute}(?=[\s=/>])" if value is None else rf"{attribute}\s*=\s*(?:\"{re.escape(value)}\"|'{re.escape(value)}')"))
    local = F.lower(F.regexp_extract(tag, "^<(?:[A-Za-z0-9_.-]+:)?([A-Za-z0-9_.-]+)", 1))
    hit = local.isin(names) if names else F.lit(False)
    for t in tests:
        hit = hit | t
    return hit


def zone(tokens: DataFrame, elements: Sequence[str], include: bool) -> DataFrame:
    """Tokens inside (or outside) the elements that fit one of the atoms: names, ``@attr`` or ``@attr="value"``.

    By names alone, depth is a running sum over the tags.  With attributes a closing tag doesn't say what its element
    had, so it is matched with its opening tag first: the last one at the same depth of the element tree.
    """
    tag = F.col("term").rlike("^</?[A-Za-z]")
    markup_ = F.col("term").rlike("^<")
    closing, single = F.col("term").rlike("^</"), F.col("term").rlike("/>$")
    if not any(e.strip().startswith("@") for e in elements):
        name = F.lower(F.regexp_extract("term", "^</?([A-Za-z0-9]+)", 1))
        step = F.when(markup_ & name.isin([e.lower() for e in elements]) & ~single, F.when(closing, -1).otherwise(1)).otherwise(0)
        rows = tokens.withColumn("depth", F.sum(step).over(_ordered()))
    else:
        o = _ordered()
        step = F.when(tag & ~single, F.when(closing, -1).otherwise(1)).otherwise(0)
        rows = tokens.withColumn("step", step).withColumn("level", F.sum("step").over(o))
        # An opening tag and its closing tag meet at the same level: the opening one's own.
        rows = rows.withColumn("own", F.when(F.col("step") > 0, F.col("level")).when(F.col("step") < 0, F.col("level") + 1))
        opened = F.when(F.col("step") > 0, F.when(_zone_matches(F.col("term"), elements), 1).otherwise(0))
        same = Window.partitionBy("doc_id", "own").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("opened", opened).withColumn("back", F.when(F.col("step") < 0, -F.coalesce(F.last("opened", True).over(same), F.lit(0))))
        rows = rows.withColumn("depth", F.sum(F.coalesce("opened", "back", F.lit(0))).over(o))
    return rows.where(~markup_ & (F.col("depth") > 0 if include else F.col("depth") <= 0)).select("doc_id", "seq", "pos_inc", "term")


def split_clitics(word: str) -> list[str]:
    """French clitics cut off: l'enfant -> l', enfant; parle-t-il -> parle, il."""
    if word.lower() in CLITIC_KEEP:
        return [word]
    head, tail, rest = [], [], word
    while (m := _PREFIX.match(rest)) and len(rest) > m.end() and len(head) < 8:
        head.append(rest[: m.end()])
        rest = rest[m.end() :]
    while (m := _SUFFIX.search(rest)) and m.start() > 0 and len(tail) < 8:
        tail.insert(0, m[2])
        rest = rest[: m.start()]
    if rest.lower().endswith("'s"):
        rest = rest[:-2]
    out = [*head, rest, *tail]
    return out if len(out) <= 8 else [word]


def clitics(tokens: DataFrame) -> DataFrame:
    """``split_clitics`` over a token table; only words with an apostrophe or hyphen go to Python, each distinct one once."""
    marked = F.col("term").rlike("[-']") & is_word(F.col("term"))
    distinct = tokens.where(marked).select("term").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"whole": pdf["term"], "pieces": [split_clitics(t) for t in pdf["term"]]})

    table = distinct.mapInPandas(run, "whole string, pieces array<string>")
    rows = tokens.join(table, F.col("term") == F.col("whole"), "left")
    return rows.select("doc_id", "seq", "pos_inc", F.posexplode(F.coalesce("pieces", F.array("term"))).alias("piece", "term"))


def detagged(text: Column) -> Column:
    """Text without tags, blanks collapsed; a tag cut by the text's edge goes too."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "<[^<>]*>", " "), "^[^<>]*>", " "), "<[^<>]*$", " ")
    return F.trim(F.regexp_replace(plain, r"[ \t\n\r]+", " "))


_KEPT = re.compile(r"<(/?)([A-Za-z0-9]+)([^<>]*)>")


def detag_keeping(xml: str, keep: Sequence[str] = ()) -> str:
    """Like ``detagged``, with the listed tags kept; what is left open is closed, a stray close is dropped."""
    xml = re.sub(r"^[^<>]*>", " ", xml) if re.match(r"^[^<>]*>", xml) else xml
    xml = re.sub(r"<[^<>]*$", " ", xml)
    opened: list[str] = []

    def one(m: re.Match) -> str:
        name = m[2].lower()
        if name not in keep:
            return " "
        if m[1]:
            if name not in opened:
                return ""
            closing = ""
            while opened:
                last = opened.pop()
                closing += f"</{last}>"
                if last == name:
                    break
            return closing
        if not m[3].endswith("/"):
            opened.append(name)
        return m[0]

    out = _KEPT.sub(one, xml)
    out += "".join(f"</{n}>" for n in reversed(opened))
    return re.sub(r"\s+", " ", out).strip()


def roman_value(term: Column) -> Column:
    """The number of a Roman numeral, -1 for other strings."""
    digits = F.transform(
        F.split(F.upper(term), ""),
        lambda c: F.when(c == "I", 1).when(c == "V", 5).when(c == "X", 10).when(c == "L", 50).when(c == "C", 100).when(c == "D", 500).when(c == "M", 1000).otherwise(0),
    )
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last"))
    step = lambda s, v: F.struct((s["sum"] + F.when(v < s["last"], -v).otherwise(v)).cast("int").alias("sum"), F.when(v < s["last"], s["last"]).otherwise(v).cast("int").alias("last"))
    total = F.aggregate(F.reverse(digits), zero.cast("struct<sum:int,last:int>"), step)["sum"]
    valid = F.upper(term).rlike("^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$") & (F.length(term) > 0)
    return F.when(valid, total).otherwise(-1)


def dotted_abbreviation(term: Column) -> Column:
    """True for a single letter, dotted groups of up to three letters and hyphenated initials, each with its dot."""
    return term.rlike(f"^(?:[{UPPER}{LOWER}]|(?:[{UPPER}{LOWER}]{{1,3}}\\.)+[{UPPER}{LOWER}]{{1,3}}|[{UPPER}]\\.(?:-[{UPPER}]\\.)*-[{UPPER}])\\.$")

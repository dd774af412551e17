"""Registered queries, each with the DuckDB statement that gives the same rows.

Every query runs over its whole tables.  Where a query takes terms or
documents as input (pivots, a focus, probes), they are its parameters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.functions import scorers
from lexigrain.operators import analysis, concord, cooc, parts, tagging, vectors
from lexigrain.operators import frequency as freq
from lexigrain.operators.rank import DIGITS, ranked_outside, sorted_by_label, top, top_per_group, top_with_includes
from lexigrain.sources import lexicon, xml

from . import spans as sp
from . import store
from .corpus import Corpus, folded, year_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BASE = """
w AS (SELECT doc_id, lang, source, try_cast(regexp_extract(source, '^.{3}([0-9]+)$', 1) AS INTEGER) AS year,
             text, lower(text) AS lt, regexp_extract_all(lower(text), '[a-zà-öø-ÿœ]+') AS ws FROM documents),
tok AS (SELECT doc_id, lang, year, CAST(i - 1 AS INTEGER) AS pos, ws[i] AS term
        FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM w)),
post AS (SELECT term, doc_id, lang, year, count(*) AS tf FROM tok GROUP BY ALL),
ds AS (SELECT doc_id, lang, year, CAST(coalesce(len(ws), 0) AS BIGINT) AS dl FROM w),
tot AS (SELECT CAST(sum(dl) AS BIGINT) AS n, count(*) FILTER (dl > 0) AS nd FROM ds),
voc AS (SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM post GROUP BY term)
"""


def sql(body: str, *, ctes: str = "") -> str:
    """The common tables, those of the query, and its statement."""
    return f"WITH {BASE}{',' + ctes if ctes else ''} {body}"


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return register


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """The stored corpus of the documents, built by the application's first query."""
    c = Corpus.open(spark, sf_dir)
    return store.shared(spark, c.documents, c)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# -- corpus tables ---------------------------------------------------------------------------------------------------

query("tokens_core", sql("SELECT doc_id, pos, term FROM tok"))(lambda s, d: corpus(s, d).tokens.select("doc_id", "pos", "term"))
query("doc_stats", sql("SELECT doc_id, dl AS doc_tokens, dl AS doc_width FROM ds"))(lambda s, d: corpus(s, d).doc_stats.select("doc_id", "doc_tokens", "doc_width"))
query("vocab", sql("SELECT term, tf, df FROM voc"))(lambda s, d: corpus(s, d).vocabulary)
query("term_doc_matrix", sql("SELECT term, doc_id, tf FROM post"))(lambda s, d: corpus(s, d).postings.select("term", "doc_id", "tf"))
_places = """pl AS (SELECT *, CAST(sum(length(gap) + length(term)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e FROM
    (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS term, unnest(gs[1:len(ws)]) AS gap FROM (SELECT doc_id, ws, string_split_regex(lt, '[a-zà-öø-ÿœ]+') AS gs FROM w WHERE len(ws) > 0)))"""
query("token_offsets", sql("SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, term, e - length(term) AS start_off, e AS end_off FROM pl", ctes=_places))(lambda s, d: corpus(s, d).with_offsets())


@query("field_totals", sql("SELECT n AS n_tokens, nd AS n_docs, (SELECT count(*) FROM ds) AS all_docs, (SELECT max(dl) FROM ds) AS max_width FROM tot"))
def field_totals(spark, sf_dir):
    t = corpus(spark, sf_dir).totals
    return spark.range(1).select(*(F.lit(t[k]).cast("long").alias(k) for k in ("n_tokens", "n_docs", "all_docs", "max_width")))


# -- document filters ------------------------------------------------------------------------------------------------

query("year_filter", "SELECT doc_id FROM documents WHERE try_cast(regexp_extract(source, '^.{3}([0-9]+)$', 1) AS INTEGER) BETWEEN 3 AND 7")(
    lambda s, d: freq_year(_docs(s, d), 7, 3).select("doc_id")
)
query("type_filter", "SELECT doc_id FROM documents WHERE lang = 'fr'")(lambda s, d: _docs(s, d).where("lang = 'fr'").select("doc_id"))
query("tag_filter_any", "SELECT doc_id FROM documents WHERE list_has_any([lang, source], ['fr', 'src2'])")(
    lambda s, d: _docs(s, d).where(F.arrays_overlap(F.array("lang", "source"), F.array(F.lit("fr"), F.lit("src2")))).select("doc_id")
)
query("filter_conjunction", "SELECT d.doc_id FROM documents d WHERE lang IN ('fr', 'de') AND try_cast(regexp_extract(source, '^.{3}([0-9]+)$', 1) AS INTEGER) >= 5 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")(
    lambda s, d: _docs(s, d).where(F.col("lang").isin("fr", "de") & (year_of(F.col("source")) >= 5)).join(s.read.parquet(f"{d}/labels.parquet").where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id")
)
query("doc_by_id", "SELECT doc_id, lang, source FROM documents WHERE doc_id = 17")(lambda s, d: _docs(s, d).where("doc_id = 17").select("doc_id", "lang", "source"))
query("book_chapters", "SELECT conv_id AS book, turn AS chapter, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS ord, role, length(text) AS n_chars FROM conversations")(
    lambda s, d: lexicon.chapters(s.read.parquet(f"{d}/conversations.parquet"))
)


def freq_year(docs: DataFrame, a: int, b: int) -> DataFrame:
    """Documents with a year in [a, b], reversed bounds put right; no overlap gives none."""
    return docs.where(year_of(F.col("source")).between(min(a, b), max(a, b)))


# -- analysis --------------------------------------------------------------------------------------------------------

STOP = ["the", "of", "and", "a", "in", "to", "de", "la", "le", "der", "die", "und", "el", "que", "y", "is", "that"]
_stop = ", ".join(f"'{x}'" for x in STOP)
SURF = f"""
sw AS (SELECT doc_id, regexp_extract_all(text, '{analysis.SURFACE.replace("'", "''")}') AS ss FROM documents),
surf AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS seq, ss[i] AS term FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM sw))
"""
_word = f"^{analysis.WORD}$".replace("'", "''")
_up, _low = analysis.UPPER, analysis.LOWER
_map = "(VALUES ('the', 'THE'), ('anst', 'an st'), ('und', 'u.'), ('de', 'of'))"
_lex = "(VALUES ('the', 'the'), ('ands', 'and'), ('thes', 'the'), ('ont', 'on'), ('und', 'und'))"


def _surface(s, d):
    return analysis.surface(_docs(s, d))


def _two(s, rows, names):
    """A small lookup table as a plan of literals."""
    parts_ = [s.range(1).select(*(F.lit(v).alias(n) for n, v in zip(names, r, strict=True))) for r in rows]
    out = parts_[0]
    for p in parts_[1:]:
        out = out.unionAll(p)
    return out


query("surface_tokens", f"WITH {SURF} SELECT doc_id, seq, term FROM surf")(lambda s, d: _surface(s, d).select("doc_id", "seq", "term"))
_mark = analysis.markup_pattern().replace("'", "''")
query("markup_tokens", f"""SELECT page_id AS doc_id, CAST(i - 1 AS INTEGER) AS seq, CASE m[i] WHEN '&amp;' THEN '&' WHEN '&lt;' THEN '<' WHEN '&gt;' THEN '>' WHEN '&quot;' THEN '"' WHEN '&apos;' THEN '''' ELSE left(m[i], 256) END AS term FROM
    (SELECT page_id, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(translate(html, '’ʼ‐‑', '''''--'), '{_mark}') AS m FROM pages))""")(
    lambda s, d: analysis.markup(s.read.parquet(f"{d}/pages.parquet"), "html", "page_id").select("doc_id", "seq", "term")
)
query("line_tokens", """SELECT doc_id, line, term, e - length(term) AS start_off, e AS end_off FROM (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line, term, CAST(sum(length(term) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS BIGINT) AS e FROM
    (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS term FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))) WHERE term <> ''""")(
    lambda s, d: analysis.lines(_docs(s, d))
)
query("stopword_antijoin", sql(f"SELECT doc_id, pos, term FROM tok WHERE term NOT IN ({_stop})"))(
    lambda s, d: corpus(s, d).tokens.where(~F.col("term").isin(STOP)).select("doc_id", "pos", "term")
)
query("stop_gaps", f"""WITH {SURF}, k AS (SELECT doc_id, seq, term, lag(seq, 1, -1) OVER (PARTITION BY doc_id ORDER BY seq) AS b FROM surf WHERE lower(term) NOT IN ({_stop}))
    SELECT doc_id, seq, CAST(seq - b AS INTEGER) AS pos_inc, term FROM k""")(lambda s, d: analysis.stop(_surface(s, d), STOP))
query("replace_map", f"""WITH {SURF}, m(s, c) AS {_map} SELECT doc_id, seq, coalesce(a.c, b.c, term) AS term FROM surf
    LEFT JOIN m a ON a.s = term LEFT JOIN m b ON regexp_matches(term, '^[{_up}]') AND b.s = lower(term)""")(
    lambda s, d: analysis.replaced(_surface(s, d), _two(s, [("the", "THE"), ("anst", "an st"), ("und", "u."), ("de", "of")], ("surface", "correction"))).select("doc_id", "seq", "term")
)
query("lemma_lookup", f"""WITH {SURF}, m(f, l) AS {_lex} SELECT doc_id, seq, CASE WHEN a.l IS NULL AND b.l IS NOT NULL THEN b.f ELSE term END AS term, coalesce(a.l, b.l) AS lemma FROM surf
    LEFT JOIN m a ON a.f = term LEFT JOIN m b ON regexp_matches(term, '^[{_up}]([^{_up}]|$)') AND term NOT IN ('Und') AND b.f = lower(term)""")(
    lambda s, d: analysis.lemmas(_surface(s, d), _two(s, [("the", "the"), ("ands", "and"), ("thes", "the"), ("ont", "on"), ("und", "und")], ("form", "lemma")), ["Und"]).select("doc_id", "seq", "term", "lemma")
)
query("uppercase_norm", f"""WITH {SURF} SELECT doc_id, seq, CASE WHEN NOT regexp_matches(term, '^[{_up}]+(?:-[{_up}]+)*$') THEN term WHEN term IN ('DE', 'LA') OR length(term) = 1 THEN term
    WHEN length(term) < 4 THEN '' ELSE array_to_string(list_transform(string_split(term, '-'), lambda p: p[1:1] || lower(p[2:])), '-') END AS term FROM surf""")(
    lambda s, d: _surface(s, d).select("doc_id", "seq", analysis.uppercase_normalised(F.col("term"), ["DE", "LA"]).alias("term"))
)
query("sentence_start_lower", f"""WITH {SURF}, x AS (SELECT *, lag(term) OVER (PARTITION BY doc_id ORDER BY seq) AS b FROM surf)
    SELECT doc_id, seq, CASE WHEN (b IS NULL OR regexp_matches(b, '^[.!?]+$')) AND lower(term) IN ('the', 'and', 'de', 'und') THEN lower(term) ELSE term END AS term FROM x""")(
    lambda s, d: analysis.sentence_start_lowered(_surface(s, d), ["the", "and", "de", "und"]).select("doc_id", "seq", "term")
)
query("pers_initials", f"""WITH {SURF}, x AS (SELECT *, lead(term, 1) OVER o AS t2, lead(term, 2) OVER o AS t3 FROM surf WINDOW o AS (PARTITION BY doc_id ORDER BY seq)),
    h AS (SELECT *, coalesce(regexp_matches(term, '^[{_up}]$') AND term <> 'M' AND t2 = '.' AND regexp_matches(t3, '^[{_up}][{_low}]'), FALSE) AS head FROM x),
    y AS (SELECT *, coalesce(lag(head, 1) OVER o, FALSE) OR coalesce(lag(head, 2) OVER o, FALSE) AS eaten FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY seq))
    SELECT doc_id, seq, CASE WHEN head THEN term || '. ' || t3 ELSE term END AS term FROM y WHERE NOT eaten""")(lambda s, d: analysis.initials_joined(_surface(s, d)).select("doc_id", "seq", "term"))
query("ocr_garbage", sql(f"SELECT DISTINCT term FROM tok WHERE NOT regexp_matches(term, '^[{_low}].*[{_low}]$') OR len(list_filter(range(1, length(term) - 1), lambda i: term[i] = term[i + 1] AND term[i] = term[i + 2])) > 0"))(
    lambda s, d: corpus(s, d).vocabulary.where(analysis.ocr_garbage(F.col("term"))).select("term")
)
query("cleanup_positions", f"""WITH {SURF}, k AS (SELECT doc_id, seq, term, seq - lag(seq, 1, -1) OVER (PARTITION BY doc_id ORDER BY seq) AS inc FROM surf WHERE lower(term) NOT IN ({_stop})),
    f AS (SELECT *, regexp_matches(term, '^<') OR (length(term) = 1 AND regexp_matches(term, '{_word}')) OR (length(term) = 2 AND regexp_matches(term, '[''’.]$')) OR regexp_matches(term, '^[{_up}{_low}]+[0-9]+$') AS skipped,
                 regexp_matches(term, '{_word}') AND NOT regexp_matches(term, '^[-'']|[-''.]$') AS accepted FROM k),
    p AS (SELECT *, CAST(sum(CASE WHEN skipped THEN 0 ELSE inc END) OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS INTEGER) AS pos FROM f)
    SELECT doc_id, pos, term FROM p WHERE NOT skipped AND accepted""")(lambda s, d: analysis.cleaned(analysis.stop(_surface(s, d), STOP)))
_suffix = "(?i)-(t-)?(je|tu|ils?|elles?|on|nous|vous|moi|toi|lui|leur|les?|la|ce|y|en|ci|là)$"
EXPRESSIONS = ["of the", "of the and", "in the", "de la", "und der"]
_two_words = ", ".join(f"'{e}'" for e in EXPRESSIONS if len(e.split()) == 2)


def _merged(table: str) -> str:
    """Expressions merged; as no inner word of one begins another, none overlap."""
    return f"""mx AS (SELECT *, lower(term) AS t1, lower(lead(term, 1) OVER o) AS t2, lower(lead(term, 2) OVER o) AS t3 FROM {table} WINDOW o AS (PARTITION BY doc_id ORDER BY seq)),
    mh AS (SELECT *, CASE WHEN t1 = 'of' AND t2 = 'the' AND t3 = 'and' THEN 3 WHEN t1 || ' ' || t2 IN ({_two_words}) THEN 2 ELSE 1 END AS n FROM mx),
    me AS (SELECT *, coalesce(lag(n, 1) OVER o > 1, FALSE) OR coalesce(lag(n, 2) OVER o > 2, FALSE) AS eaten FROM mh WINDOW o AS (PARTITION BY doc_id ORDER BY seq)),
    mm AS (SELECT doc_id, seq, CASE n WHEN 3 THEN t1 || ' ' || t2 || ' ' || t3 WHEN 2 THEN t1 || ' ' || t2 ELSE term END AS term FROM me WHERE NOT eaten)"""


query("mwe_merge", f"WITH {SURF}, {_merged('surf')} SELECT doc_id, seq, term FROM mm")(lambda s, d: analysis.expressions(_surface(s, d), EXPRESSIONS).select("doc_id", "seq", "term"))
_keep = ", ".join("'" + w.replace("'", "''") + "'" for w in analysis.CLITIC_KEEP)
query("clitic_split", f"""WITH RECURSIVE {SURF}, cd AS (SELECT DISTINCT term FROM surf WHERE regexp_matches(term, '[-'']') AND regexp_matches(term, '{_word}')),
    cp AS (SELECT term, term AS rest, CAST([] AS VARCHAR[]) AS head, 0 AS n FROM cd WHERE lower(term) NOT IN ({_keep})
           UNION ALL SELECT term, rest[length(m) + 1:], list_append(head, m), n + 1 FROM (SELECT *, regexp_extract(rest, '(?i)^(qu|jusqu|lorsqu|puisqu|quoiqu|[cdjlmnst])\\x27') AS m FROM cp) WHERE m <> '' AND length(rest) > length(m) AND n < 8),
    ch AS (SELECT term, arg_max(rest, n) AS rest, arg_max(head, n) AS head FROM cp GROUP BY term),
    cs AS (SELECT term, rest, head, CAST([] AS VARCHAR[]) AS tail, 0 AS n FROM ch
           UNION ALL SELECT term, rest[:length(rest) - length(m)], head, list_prepend(g, tail), n + 1 FROM (SELECT *, regexp_extract(rest, '{_suffix}') AS m, regexp_extract(rest, '{_suffix}', 2) AS g FROM cs) WHERE m <> '' AND length(rest) > length(m) AND n < 8),
    ct AS (SELECT term, arg_max(rest, n) AS rest, any_value(head) AS head, arg_max(tail, n) AS tail FROM cs GROUP BY term),
    cl AS (SELECT term, list_concat(list_append(head, CASE WHEN lower(rest) LIKE '%''s' THEN rest[:length(rest) - 2] ELSE rest END), tail) AS p FROM ct)
    SELECT doc_id, seq, CAST(unnest(range(0, len(p))) AS INTEGER) AS piece, unnest(p) AS term FROM (SELECT doc_id, seq, CASE WHEN cl.term IS NULL OR len(p) > 8 THEN [surf.term] ELSE p END AS p FROM surf LEFT JOIN cl ON cl.term = surf.term)""")(
    lambda s, d: analysis.clitics(_surface(s, d)).select("doc_id", "seq", "piece", "term")
)
query("ascii_fold", sql("SELECT term, translate(replace(replace(replace(term, 'œ', 'oe'), 'æ', 'ae'), 'ß', 'ss'), 'àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ', 'aaaaaaceeeeiiiinoooooouuuuyy') AS folded FROM voc"))(
    lambda s, d: corpus(s, d).vocabulary.select("term", folded(F.col("term")).alias("folded"))
)
query("detag_pages", """SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^<>]*>', ' ', 'g'), '^[^<>]*>', ' '), '<[^<>]*$', ' '), '[ \\t\\n\\r]+', ' ', 'g')) AS plain FROM pages""")(
    lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", analysis.detagged(F.col("html")).alias("plain"))
)
_pages = SURF.replace("FROM documents", "FROM pages").replace("doc_id", "page_id").replace("(text,", "(html,")


def _page_tokens(s, d):
    return analysis.surface(s.read.parquet(f"{d}/pages.parquet"), "html", "page_id")


_zone = f"""WITH {_pages}, t AS (SELECT *, regexp_matches(term, '^<') AS tag, lower(regexp_extract(term, '^</?([A-Za-z0-9]+)', 1)) AS name FROM surf),
    z AS (SELECT *, sum(CASE WHEN tag AND name IN ('nav', 'p') AND NOT regexp_matches(term, '/>$') THEN CASE WHEN regexp_matches(term, '^</') THEN -1 ELSE 1 END ELSE 0 END) OVER (PARTITION BY page_id ORDER BY seq) AS depth FROM t)
    SELECT page_id AS doc_id, seq, term FROM z WHERE NOT tag AND depth """
query("zone_include", _zone + "> 0")(lambda s, d: analysis.zone(_page_tokens(s, d), ["nav", "p"], True).select("doc_id", "seq", "term"))
query("zone_exclude", _zone + "<= 0")(lambda s, d: analysis.zone(_page_tokens(s, d), ["nav", "p"], False).select("doc_id", "seq", "term"))
query("zone_attribute", f"""WITH {_pages}, t AS (SELECT *, regexp_matches(term, '^<') AS tag, regexp_matches(term, '^</?[A-Za-z]') AND NOT regexp_matches(term, '/>$') AS moves, regexp_matches(term, '^</') AS shut FROM surf),
    l AS (SELECT *, CASE WHEN moves THEN CASE WHEN shut THEN -1 ELSE 1 END ELSE 0 END AS step FROM t), v AS (SELECT *, sum(step) OVER (PARTITION BY page_id ORDER BY seq) AS level FROM l),
    o AS (SELECT *, CASE step WHEN 1 THEN level WHEN -1 THEN level + 1 END AS own, CASE WHEN step = 1 THEN CASE WHEN regexp_matches(term, '\\shref[\\s=/>]') THEN 1 ELSE 0 END END AS opened FROM v),
    b AS (SELECT *, CASE WHEN step = -1 THEN -coalesce(last_value(opened IGNORE NULLS) OVER (PARTITION BY page_id, own ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS back FROM o),
    z AS (SELECT *, sum(coalesce(opened, back, 0)) OVER (PARTITION BY page_id ORDER BY seq) AS depth FROM b)
    SELECT page_id AS doc_id, seq, term FROM z WHERE NOT tag AND depth > 0""")(lambda s, d: analysis.zone(_page_tokens(s, d), ["@href"], True).select("doc_id", "seq", "term"))
_pos = [("the", "DET", 1), ("of", "ADP", 2), ("of", "ADV", 3), ("und", "CONJ", 4), ("le", "PRON", 6), ("le", "DET", 5)]
query("pos_tags", f"""WITH {SURF}, m(f, t) AS (VALUES ('the', 'DET'), ('of', 'ADP'), ('und', 'CONJ'), ('le', 'DET')) SELECT doc_id, seq, surf.term, coalesce(a.t, b.t, 'X') AS tag FROM surf LEFT JOIN m a ON a.f = surf.term LEFT JOIN m b ON b.f = lower(surf.term)""")(
    lambda s, d: tagging.by_lexicon(_surface(s, d), _two(s, _pos, ("form", "tag", "ord"))).select("doc_id", "seq", "term", "tag")
)
_taglem = [("the", "DET", "the-det", 1), ("the", "X", "the-x", 2), ("of", "ADP", "of-adp", 3), ("of", "ADV", "of-adv", 4), ("le", "NOUN", "le-noun", 5), ("le", "VERB", "le-verb", 6)]
query("lemma_by_tag", f"""WITH {SURF}, m(f, t) AS (VALUES ('the', 'DET'), ('of', 'ADP'), ('und', 'CONJ'), ('le', 'DET')), tg AS (SELECT doc_id, seq, surf.term, coalesce(a.t, b.t, 'X') AS tag FROM surf LEFT JOIN m a ON a.f = surf.term LEFT JOIN m b ON b.f = lower(surf.term)),
    lo AS (SELECT *, CASE WHEN NOT regexp_matches(term, '^.[{_up}]') AND lower(term) IN ('the', 'of', 'le') THEN lower(term) ELSE term END AS form FROM tg)
    SELECT doc_id, seq, form AS term, tag, CASE form WHEN 'the' THEN CASE tag WHEN 'X' THEN 'the-x' ELSE 'the-det' END WHEN 'of' THEN CASE tag WHEN 'ADV' THEN 'of-adv' ELSE 'of-adp' END WHEN 'le' THEN CASE tag WHEN 'VERB' THEN 'le-verb' ELSE 'le-noun' END END AS lemma FROM lo""")(
    lambda s, d: analysis.lemmas(tagging.by_lexicon(_surface(s, d), _two(s, _pos, ("form", "tag", "ord"))), _two(s, _taglem, ("form", "tag", "lemma", "ord"))).select("doc_id", "seq", "term", "tag", "lemma")
)
query("name_runs", f"""WITH {SURF}, c AS (SELECT *, regexp_matches(term, '^\\p{{Lu}}\\p{{L}}') AS up FROM surf), r AS (SELECT *, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY seq) AS run FROM c),
    g AS (SELECT string_agg(term, ' ' ORDER BY seq) AS name FROM r WHERE up GROUP BY doc_id, run HAVING count(*) > 1) SELECT name, count(*) AS n FROM g GROUP BY name ORDER BY n DESC, name LIMIT 2000""")(lambda s, d: lexicon.name_runs(_surface(s, d), 2000))
for _k, _v in {"ignore": "arg_min", "replace": "arg_max"}.items():
    query(f"lexicon_{_k}", f"SELECT role, {_v}(text, (turn, conv_id)) AS text FROM conversations GROUP BY role")(
        lambda s, d, k=_k: lexicon.unique_by(s.read.parquet(f"{d}/conversations.parquet").withColumn("o", F.struct("turn", "conv_id")), "role", "o", k).select("role", "text")
    )
query("boundary_marks", f"""WITH {_pages}, k AS (SELECT *, CASE WHEN regexp_matches(term, '^<') THEN CASE WHEN lower(regexp_extract(term, '^</([A-Za-z0-9]+)', 1)) IN ('section', 'article', 'div') THEN 2
        WHEN lower(regexp_extract(term, '^</([A-Za-z0-9]+)', 1)) IN ('p', 'li', 'h1', 'h2') THEN 1 ELSE 0 END END AS kind FROM surf),
    i AS (SELECT *, sum(CASE WHEN kind IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY seq) AS island FROM k WHERE kind IS NULL OR kind > 0)
    SELECT page_id AS doc_id, seq, term FROM i WHERE kind IS NULL
    UNION ALL SELECT page_id, min(seq), CASE WHEN max(kind) = 2 THEN '§' ELSE '¶' END FROM i WHERE kind IS NOT NULL GROUP BY page_id, island""")(lambda s, d: analysis.boundaries(_page_tokens(s, d)))
query("dotted_abbreviation", f"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[{_up}{_low}]+[.]')) AS term FROM documents) SELECT term FROM w WHERE regexp_matches(term, '^([{_up}{_low}]|([{_up}{_low}]{{1,3}}\\.)+[{_up}{_low}]{{1,3}}|[{_up}]\\.(-[{_up}]\\.)*-[{_up}])\\.$')")(
    lambda s, d: _docs(s, d).select(F.explode(F.regexp_extract_all("text", F.lit(f"[{_up}{_low}]+[.]"), F.lit(0))).alias("term")).distinct().where(analysis.dotted_abbreviation(F.col("term")))
)
_digits = "list_transform(regexp_extract_all(upper(term), '.'), lambda c: CASE c WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 WHEN 'D' THEN 500 ELSE 1000 END)"
query("roman_to_int", sql(f"""SELECT term, CAST(list_sum(list_transform(range(1, len(v) + 1), lambda i: CASE WHEN v[i] < coalesce(v[i + 1], 0) THEN -v[i] ELSE v[i] END)) AS INTEGER) AS value FROM
    (SELECT term, {_digits} AS v FROM voc WHERE regexp_matches(upper(term), '^M{{0,3}}(CM|CD|D?C{{0,3}})(XC|XL|L?X{{0,3}})(IX|IV|V?I{{0,3}})$'))"""))(lambda s, d: corpus(s, d).vocabulary.select("term", analysis.roman_value(F.col("term")).alias("value")).where("value > 0"))

# -- a corpus of analysed tokens: holes, expressions ---------------------------------------------------------------------

_CANON = f"""mk AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS seq, CASE m[i] WHEN '&amp;' THEN '&' WHEN '&lt;' THEN '<' WHEN '&gt;' THEN '>' WHEN '&quot;' THEN '"' WHEN '&apos;' THEN chr(39) ELSE left(m[i], 256) END AS term FROM
        (SELECT doc_id, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(translate(text, '’ʼ‐‑', chr(39) || chr(39) || '--'), '{_mark}') AS m FROM documents))),
    {_merged('mk')},
    mr AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS nr FROM mm),
    ms AS (SELECT doc_id, nr, term, nr - lag(nr, 1, 0) OVER (PARTITION BY doc_id ORDER BY nr) AS inc FROM mr WHERE lower(term) NOT IN ({_stop})),
    mf AS (SELECT *, regexp_matches(term, '^<') OR (length(term) = 1 AND regexp_matches(term, '{_word}')) OR (length(term) = 2 AND regexp_matches(term, '[\\x27’.]$')) OR regexp_matches(term, '^[{_up}{_low}]+[0-9]+$') AS skipped,
                  (regexp_matches(term, '{_word}') OR term IN ({", ".join(f"'{e}'" for e in EXPRESSIONS)})) AND NOT regexp_matches(term, '^[-\\x27]|[-\\x27.]$') AS accepted FROM ms),
    mp AS (SELECT *, CAST(sum(CASE WHEN skipped THEN 0 ELSE inc END) OVER (PARTITION BY doc_id ORDER BY nr) - 1 AS INTEGER) AS pos FROM mf),
    ct AS (SELECT doc_id, pos, term FROM mp WHERE NOT skipped AND accepted)"""


def canonic(spark: SparkSession, sf_dir: str) -> Corpus:
    """The stored corpus of analysed tokens: markup, expressions, stop words with their gaps, final positions."""
    c = Corpus.open(spark, sf_dir).analysed(analysis.canonic(STOP, entries=EXPRESSIONS, split=False))
    return store.shared(spark, c.documents, c, "canonic")


query("canonic_tokens", f"WITH {_CANON} SELECT doc_id, pos, term FROM ct")(lambda s, d: canonic(s, d).tokens.select("doc_id", "pos", "term"))
query("canonic_stats", f"WITH {_CANON} SELECT d.doc_id, count(ct.term) AS doc_tokens, CAST(coalesce(max(pos) + 1, 0) AS BIGINT) AS doc_width FROM documents d LEFT JOIN ct ON ct.doc_id = d.doc_id GROUP BY d.doc_id")(
    lambda s, d: canonic(s, d).doc_stats.select("doc_id", "doc_tokens", "doc_width")
)
query("canonic_vocab", f"WITH {_CANON} SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM ct GROUP BY term")(lambda s, d: canonic(s, d).vocabulary)
query("span_quoted", f"WITH {_CANON} SELECT doc_id, pos AS \"start\", pos + 1 AS \"end\" FROM ct WHERE term = 'of the'")(lambda s, d: sp.find(canonic(s, d), '"of the"'))

# -- spans, snippets and concordances --------------------------------------------------------------------------------

_the = "sp AS (SELECT doc_id, pos AS s, pos + 1 AS e FROM tok WHERE term = 'the')"


def _spans_sql(where: str) -> str:
    return f"SELECT doc_id, pos AS \"start\", pos + 1 AS \"end\" FROM tok WHERE {where}"


query("span_term", sql(_spans_sql("term = 'the'")))(lambda s, d: sp.find(corpus(s, d), "the"))
_expand = "SELECT term FROM voc WHERE {} ORDER BY tf DESC, term LIMIT 256"
query("span_prefix", sql(_spans_sql("term IN (" + _expand.format("starts_with(term, 'than')") + ")")))(lambda s, d: sp.find(corpus(s, d), "than*"))
query("span_wildcard", sql(_spans_sql("term IN (" + _expand.format("regexp_matches(term, '^th.n.*$')") + ")")))(lambda s, d: sp.find(corpus(s, d), "th?n*"))
query("span_or", sql(_spans_sql("term IN ('the', 'und', 'les')")))(lambda s, d: sp.find(corpus(s, d), "(the und les)"))
query("span_phrase", sql("SELECT doc_id, pos AS \"start\", pos + 2 AS \"end\" FROM (SELECT *, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS t2 FROM tok) WHERE term = 'of' AND t2 = 'the'"))(
    lambda s, d: sp.phrase(corpus(s, d), ["of", "the"])
)
_near = """a AS (SELECT doc_id, pos FROM tok WHERE term = 'of'), b AS (SELECT doc_id, pos FROM tok WHERE term = 'the'),
    m AS (SELECT a.doc_id, least(a.pos, b.pos) AS s, greatest(a.pos, b.pos) + 1 AS e FROM a JOIN b ON a.doc_id = b.doc_id AND abs(a.pos - b.pos) - 1 <= 5)"""
query("span_near", sql('SELECT doc_id, s AS "start", min(e) AS "end" FROM m GROUP BY ALL', ctes=_near))(lambda s, d: sp.find(corpus(s, d), "of the", 5))
query("span_unindexed", sql('SELECT doc_id, s AS "start", min(e) AS "end" FROM m GROUP BY ALL', ctes=_near))(lambda s, d: sp.find(corpus(s, d), 'of zzabsent (zznone "no such") the', 5))
query("span_stopped", sql(_spans_sql("term = 'the'")))(lambda s, d: sp.find(corpus(s, d), "of the", 5, stopwords=["of"]))
query("span_roots", sql(_spans_sql("term IN ('the', 'und')")))(
    lambda s, d: sp.find(corpus(s, d), "zzthes", roots=_two(s, [("zzthes", "the"), ("zzthes", "und"), ("zzthes", "zzabsent"), ("the", "zzabsent")], ("form", "root")))
)
query("span_near_phrase", sql('SELECT doc_id, s AS "start", min(e) AS "end" FROM m GROUP BY ALL', ctes="""p AS (SELECT doc_id, pos FROM (SELECT *, lead(term, 30) OVER (PARTITION BY doc_id ORDER BY pos) AS t31 FROM tok) WHERE term = 'of' AND t31 IS NOT NULL),
    b AS (SELECT doc_id, pos FROM tok WHERE term = 'and'), m AS (SELECT p.doc_id, least(p.pos, b.pos) AS s, greatest(p.pos + 31, b.pos + 1) AS e FROM p JOIN b ON p.doc_id = b.doc_id AND p.pos <> b.pos AND greatest(p.pos + 31, b.pos + 1) - least(p.pos, b.pos) - 32 <= 4)"""))(
    lambda s, d: (lambda c: sp.near([_long_spans(c), sp.find(c, "and")], 4))(corpus(s, d))
)


def _long_spans(c: Corpus) -> DataFrame:
    """31 positions from every ``of`` on that has so many behind it."""
    room = sp.find(c, "of").join(c.doc_stats.select("doc_id", "doc_width"), "doc_id").where(F.col("start") + 31 <= F.col("doc_width"))
    return room.select("doc_id", "start", (F.col("start") + 31).cast("int").alias("end"))


query("span_near_three", sql('SELECT doc_id, s AS "start", min(e) AS "end" FROM m GROUP BY ALL', ctes="""a AS (SELECT doc_id, pos FROM tok WHERE term = 'of'), b AS (SELECT doc_id, pos FROM tok WHERE term = 'the'), c AS (SELECT doc_id, pos FROM tok WHERE term = 'and'),
    m AS (SELECT a.doc_id, least(a.pos, b.pos, c.pos) AS s, greatest(a.pos, b.pos, c.pos) + 1 AS e FROM a JOIN b ON a.doc_id = b.doc_id AND abs(a.pos - b.pos) < 9 JOIN c ON a.doc_id = c.doc_id AND abs(a.pos - c.pos) < 9
          WHERE greatest(a.pos, b.pos, c.pos) + 1 - least(a.pos, b.pos, c.pos) - 3 <= 4)"""))(lambda s, d: sp.find(corpus(s, d), "of the and", 4))  # fmt: skip

SNIP = _the + """,
    sf AS (SELECT *, CASE WHEN max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 20 >= s THEN 0 ELSE 1 END AS opens FROM sp),
    si AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) - 1 AS snip FROM sf),
    sn AS (SELECT doc_id, CAST(snip AS INTEGER) AS snip, min(s) AS s, max(e) AS e, count(*) AS hits FROM si GROUP BY ALL)"""


def _snips(s, d, c=None, term="the", gap=20):
    return sp.snippets(sp.find(c or corpus(s, d), term), gap)


query("snippets_merge", sql('SELECT doc_id, snip, s AS "start", e AS "end", hits FROM sn', ctes=SNIP))(lambda s, d: _snips(s, d))
query("match_positions", sql("SELECT DISTINCT doc_id, s AS pos FROM sp", ctes=_the))(lambda s, d: concord.matches(sp.find(corpus(s, d), "the")))
query("snippet_matches", sql("SELECT sn.doc_id, snip, min(sp.s) AS first_match, max(sp.s) AS last_match FROM sn JOIN sp ON sp.doc_id = sn.doc_id AND sp.s >= sn.s AND sp.s < sn.e GROUP BY ALL", ctes=SNIP))(
    lambda s, d: (lambda c: concord.snippet_matches(_snips(s, d, c), sp.find(c, "the")))(corpus(s, d))
)
query("hits_count", sql("SELECT count(DISTINCT doc_id) AS docs, count(*) AS spans FROM sp JOIN ds USING (doc_id) WHERE lang = 'en'", ctes=_the))(
    lambda s, d: concord.hits(sp.find(corpus(s, d).select("lang = 'en'"), "the"))
)
query("raw_spans", sql("""SELECT doc_id, count(*) AS spans, bool_or(coalesce(s < b, FALSE)) AS overlapping FROM
    (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (SELECT doc_id, s, min(e) AS e FROM m GROUP BY ALL)) GROUP BY doc_id""", ctes=_near))(
    lambda s, d: concord.span_diagnosis(sp.find(corpus(s, d), "of the", 5))
)
_bm = "ln(1 + (nd - x.df + 0.5) / (x.df + 0.5))"
query("results_bm25", sql(f"""SELECT doc_id, spans, round({_bm} * spans * 2.2 / (spans + 1.2 * (0.25 + 0.75 * dl / (CAST(n AS DOUBLE) / nd))), 6) AS score FROM f JOIN ds USING (doc_id), tot, (SELECT count(*) AS df FROM f) x
    ORDER BY score DESC, doc_id LIMIT 100""", ctes=_the + ", f AS (SELECT doc_id, count(*) AS spans FROM sp GROUP BY doc_id)"))(
    lambda s, d: (lambda c: concord.ranked_documents(c, sp.find(c, "the"), 100))(corpus(s, d)).select("doc_id", "spans", "score")
)
query("results_by_date", sql("SELECT doc_id, count(*) AS spans FROM sp WHERE doc_id > 40 GROUP BY doc_id ORDER BY doc_id LIMIT 100", ctes=_the))(
    lambda s, d: concord.page_by_document(sp.find(corpus(s, d), "the"), 40, 100)
)
_THEME = [("of", 1.0), ("and", 0.5), ("in", 0.25), ("to", 2.0)]
_theme = SNIP + """, tw(term, weight) AS (VALUES ('of', 1.0::DOUBLE), ('and', 0.5), ('in', 0.25), ('to', 2.0)),
    th AS (SELECT DISTINCT sn.doc_id, snip, term, weight FROM sn JOIN tok ON tok.doc_id = sn.doc_id AND tok.pos >= sn.s - 5 AND tok.pos < sn.e + 5 JOIN tw USING (term)),
    sc AS (SELECT sn.doc_id, sn.snip, round(coalesce(sum(weight), 0), 6) AS score FROM sn LEFT JOIN th ON th.doc_id = sn.doc_id AND th.snip = sn.snip GROUP BY ALL)"""


def _themed(s, d):
    c = corpus(s, d)
    snips = _snips(s, d, c)
    return snips, concord.theme_scores(c, snips, _two(s, _THEME, ("term", "weight")), 5)


query("theme_words_score", sql("SELECT doc_id, snip, score FROM sc", ctes=_theme))(lambda s, d: _themed(s, d)[1])
query("results_top_snippets", sql("SELECT doc_id, snip, score FROM sc ORDER BY score DESC, doc_id, snip LIMIT 50", ctes=_theme))(lambda s, d: concord.best_snippets(_themed(s, d)[1], 50))
query("snippets_top_per_doc", sql("SELECT doc_id, snip, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, snip) AS r FROM sc) WHERE r <= 3", ctes=_theme))(
    lambda s, d: (lambda t: concord.snippets_per_document(t[0], 3, t[1]).select("doc_id", "snip", "score", "rank"))(_themed(s, d))
)
query("kwic", sql("""SELECT pl.doc_id, CAST(i - 1 AS INTEGER) AS "start", text[greatest(a - 40, 0) + 1 : a] AS "left", text[a + 1 : e] AS pivot, text[e + 1 : e + 40] AS "right" FROM (SELECT *, e - length(term) AS a FROM pl WHERE term = 'reth') pl JOIN w ON w.doc_id = pl.doc_id""", ctes=_places))(
    lambda s, d: (lambda c: concord.keyword_in_context(c, sp.find(c, "reth")))(corpus(s, d))
)
query("highlight", sql("SELECT doc_id, regexp_replace(text, '(^|[^a-zà-öø-ÿœ])(reth)($|[^a-zà-öø-ÿœ])', '\\1<mark>\\2</mark>\\3', 'gi') AS html FROM w WHERE list_contains(ws, 'reth')"))(
    lambda s, d: (lambda c: concord.highlighted(c, sp.find(c, "reth"), apart=True))(corpus(s, d))
)

# -- co-occurrence ---------------------------------------------------------------------------------------------------

_ctx = SNIP + """, cx AS (SELECT tok.doc_id, snip, term FROM sn JOIN tok ON tok.doc_id = sn.doc_id AND tok.pos >= sn.s - 5 AND tok.pos < sn.e + 5),
    cc AS (SELECT term, count(*) AS freq, count(DISTINCT doc_id) AS docs, count(DISTINCT (doc_id, snip)) AS contexts FROM cx GROUP BY term)"""
query("cooc_terms", sql("SELECT * FROM cc", ctes=_ctx))(lambda s, d: (lambda c: cooc.context_counts(c, _snips(s, d, c), 5, 5))(corpus(s, d)))
query("cooc_terms_minus_pivots", sql("SELECT * FROM cc WHERE term <> 'the'", ctes=_ctx))(
    lambda s, d: (lambda c: cooc.without_pivots(cooc.context_counts(c, _snips(s, d, c), 5, 5), ["the"]))(corpus(s, d))
)

# Statements of the keyness scores: a of fa in the focus, b of fb outside.
_cell = "CASE WHEN {o} > 0 AND {e} > 0 THEN 2 * {o} * ln({o} / {e}) ELSE 0 END"


def keyness_sql(kind: str, a: str, fa: str, b: str, fb: str) -> str:
    a, fa, b, fb = (f"CAST({x} AS DOUBLE)" for x in (a, fa, b, fb))
    hit, miss, total = f"({a} + {b})", f"({fa} + {fb} - {a} - {b})", f"({fa} + {fb})"
    cells = [(a, f"({fa} * {hit} / {total})"), (b, f"({fb} * {hit} / {total})"), (f"({fa} - {a})", f"({fa} * {miss} / {total})"), (f"({fb} - {b})", f"({fb} * {miss} / {total})")]
    signed = "CASE WHEN {fa} <= 0 OR {fb} <= 0 THEN 0 WHEN {a} < 0 OR {b} < 0 OR {a} > {fa} OR {b} > {fb} THEN NULL WHEN {a} / {fa} >= {b} / {fb} THEN ({v}) ELSE -({v}) END"
    if kind == "count":
        return a
    if kind == "g2":
        return signed.format(a=a, fa=fa, b=b, fb=fb, v=" + ".join(_cell.format(o=o, e=e) for o, e in cells))
    if kind == "chi2":
        return signed.format(a=a, fa=fa, b=b, fb=fb, v=" + ".join(f"CASE WHEN {e} > 0 THEN ({o} - {e}) * ({o} - {e}) / {e} ELSE 0 END" for o, e in cells))
    if kind == "logdice":
        return f"CASE WHEN {fa} <= 0 THEN NULL WHEN {a} <= 0 THEN '-inf'::DOUBLE ELSE 14 + log2(2 * {a} / ({fa} + {a} + {b})) END"
    if kind == "logratio":
        return f"CASE WHEN {a} > 0 AND {fa} > 0 AND {b} > 0 AND {fb} > 0 THEN log2(({a} / {fa}) / ({b} / {fb})) * ln({a}) ELSE 0 END"
    return f"CASE WHEN {fa} <= 0 OR {fb} <= 0 THEN 0 ELSE ({a} * 1e6 / {fa} + 1) / ({b} * 1e6 / {fb} + 1) END"


def _keyness_rows(kind: str) -> str:
    return f"""SELECT term, docs, freq, field_docs, field_freq, round({keyness_sql(kind, 'freq', 'fa', 'field_freq - freq', 'n - fa')}, 6) AS score FROM fc, fo, tot WHERE freq > 0"""


_focus = """fc AS (SELECT term, CAST(sum(tf) FILTER (lang = 'fr') AS BIGINT) AS freq, count(*) FILTER (lang = 'fr') AS docs, CAST(sum(tf) AS BIGINT) AS field_freq, count(*) AS field_docs FROM post GROUP BY term),
    fo AS (SELECT sum(dl) AS fa FROM ds WHERE lang = 'fr')"""
for _k in scorers.KEYNESS:
    query(f"keyness_{_k}", sql(f"SELECT CAST(row_number() OVER (ORDER BY score DESC, term) AS INTEGER) AS rank, * FROM (SELECT * FROM ({_keyness_rows(_k)}) WHERE score IS NOT NULL ORDER BY score DESC, term LIMIT 50)", ctes=_focus))(
        lambda s, d, k=_k: freq.keyness(corpus(s, d), F.col("lang") == "fr", k, 50)
    )
QUERIES["terms_focus_keyness"], ORACLES["terms_focus_keyness"] = QUERIES["keyness_g2"], ORACLES["keyness_g2"]
query("select_terms", sql("SELECT term, freq, docs, field_freq, field_docs FROM fc WHERE freq > 0", ctes=_focus))(
    lambda s, d: freq.focus_counts(corpus(s, d), F.col("lang") == "fr").where("freq > 0")
)
query("terms_include_exclude", sql(f"SELECT term, score FROM (SELECT term, score, term IN ('le', 'absent', 'tre') AS inc FROM ({_keyness_rows('g2')}) WHERE term NOT IN ('de', 'la') ORDER BY inc DESC, score DESC, term LIMIT 20)", ctes=_focus))(
    lambda s, d: top_with_includes(_scored(s, d), "score", 20, ["le", "absent", "tre"], ["de", "la"]).select("term", "score")
)


def _scored(s, d):
    return freq.keyness(corpus(s, d), F.col("lang") == "fr", "g2", 1 << 30).select("term", "freq", "score")


query("terms_near_pivot", sql(f"""SELECT term, freq, docs, contexts, field_freq, score FROM (SELECT cc.term, freq, docs, contexts, voc.tf AS field_freq, round({keyness_sql('g2', 'freq', 'ft', 'voc.tf - freq', 'n - ft')}, 6) AS score
    FROM cc JOIN voc ON voc.term = cc.term, tot, (SELECT sum(freq) AS ft FROM cc WHERE term <> 'the') WHERE cc.term <> 'the') WHERE score IS NOT NULL ORDER BY score DESC, term LIMIT 50""", ctes=_ctx))(
    lambda s, d: (lambda c: top(cooc.cooccurrents(c, _snips(s, d, c), ["the"], 5, 5), "score", 50).select("term", "freq", "docs", "contexts", "field_freq", "score"))(corpus(s, d))
)
TICKS = [2, 5, 10]
_sh = SNIP + """, sx AS (SELECT tok.doc_id, tok.pos, term, min(CASE WHEN pos < s THEN s - pos ELSE greatest(pos - e + 1, 0) END) AS gap
        FROM sn JOIN tok ON tok.doc_id = sn.doc_id AND tok.pos >= sn.s - 10 AND tok.pos < sn.e + 10 GROUP BY ALL),
    st AS (SELECT *, CASE WHEN gap <= 2 THEN 2 WHEN gap <= 5 THEN 5 ELSE 10 END AS tick FROM sx),
    sd AS (SELECT *, min(tick) OVER (PARTITION BY term, doc_id) AS f FROM (SELECT term, doc_id, tick, count(*) AS c FROM st GROUP BY ALL)),
    sh AS (SELECT term, tick, CAST(sum(c) AS BIGINT) AS freq, count(*) FILTER (tick = f) AS docs FROM sd GROUP BY ALL),
    cu AS (SELECT term, tick, CAST(sum(coalesce(freq, 0)) OVER o AS BIGINT) AS freq, CAST(sum(coalesce(docs, 0)) OVER o AS BIGINT) AS docs
           FROM (SELECT DISTINCT term FROM sh) CROSS JOIN (VALUES (2), (5), (10)) t(tick) LEFT JOIN sh USING (term, tick) WINDOW o AS (PARTITION BY term ORDER BY tick ROWS UNBOUNDED PRECEDING))"""


def _shell(s, d):
    c = corpus(s, d)
    return c, cooc.shells(c, _snips(s, d, c), TICKS)


query("cooc_profile_shells", sql("SELECT * FROM sh", ctes=_sh))(lambda s, d: _shell(s, d)[1])
query("cooc_profile_cumulated", sql("SELECT * FROM cu", ctes=_sh))(lambda s, d: cooc.cumulated(_shell(s, d)[1], TICKS))
_ptop = f"""pt AS (SELECT tick, CAST(row_number() OVER (PARTITION BY tick ORDER BY score DESC, term) AS INTEGER) AS rank, term, freq, score FROM
    (SELECT tick, cu.term, freq, round({keyness_sql('g2', 'freq', 'total', 'voc.tf - freq', 'n - total')}, 6) AS score FROM cu JOIN (SELECT tick, sum(freq) AS total FROM cu WHERE term <> 'the' GROUP BY tick) USING (tick) JOIN voc ON voc.term = cu.term, tot WHERE cu.term <> 'the' AND freq > 0)
    WHERE score IS NOT NULL QUALIFY rank <= 20)"""
query("cooc_profile_topk", sql("SELECT * FROM pt", ctes=_sh + "," + _ptop))(lambda s, d: (lambda p: cooc.profile_top(*p, TICKS, ["the"], 20))(_shell(s, d)))
query("cooc_profile_entries", sql("SELECT term, min(tick) AS entry_tick, arg_min(rank, tick) AS entry_rank, arg_max(score, tick) AS last_score, max(tick) AS last_tick FROM pt GROUP BY term", ctes=_sh + "," + _ptop))(
    lambda s, d: (lambda p: cooc.profile_entries(cooc.profile_top(*p, TICKS, ["the"], 20)))(_shell(s, d))
)
MAT = ["of", "and", "in", "to", "was"]
_mat = SNIP + ", mx AS (SELECT tok.doc_id, snip, pos, term FROM sn JOIN tok ON tok.doc_id = sn.doc_id AND tok.pos >= sn.s - 5 AND tok.pos < sn.e + 5 WHERE term IN ('of', 'and', 'in', 'to', 'was')), mp AS (SELECT a.term AS r, b.term AS c FROM mx a JOIN mx b ON a.doc_id = b.doc_id AND a.snip = b.snip AND a.pos < b.pos AND a.term <> b.term)"
query("cooc_matrix_directed", sql('SELECT r AS "row", c AS col, count(*) AS n FROM (SELECT * FROM mp UNION ALL SELECT term, term FROM mx) GROUP BY ALL', ctes=_mat))(
    lambda s, d: (lambda c: cooc.matrix(c, _snips(s, d, c), MAT, 5, 5, True))(corpus(s, d))
)
query("cooc_matrix_undirected", sql('SELECT r AS "row", c AS col, count(*) AS n FROM (SELECT * FROM mp UNION ALL SELECT c, r FROM mp UNION ALL SELECT term, term FROM mx) GROUP BY ALL', ctes=_mat))(
    lambda s, d: (lambda c: cooc.matrix(c, _snips(s, d, c), MAT, 5, 5, False))(corpus(s, d))
)
_pairs = """sel AS (SELECT term FROM voc WHERE df >= 3 ORDER BY tf DESC, term LIMIT 200), pt AS (SELECT doc_id, pos, term FROM tok WHERE term IN (SELECT term FROM sel)),
    ph AS (SELECT a.term AS r, b.term AS c, count(*) AS n FROM pt a JOIN pt b ON a.doc_id = b.doc_id AND b.pos - a.pos BETWEEN 1 AND 10 WHERE (a.term NOT IN ('the', 'of', 'and') AND b.term NOT IN ('the', 'of', 'and')) OR b.pos - a.pos <= 2 GROUP BY ALL),
    pp AS (SELECT r, c, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM ph UNION ALL SELECT c, r, n FROM ph) GROUP BY ALL)"""


def _window(s, d):
    c = corpus(s, d)
    return cooc.window_pairs(c, vectors.selected_terms(c, 3, 200), 10, ["the", "of", "and"])


query("cooc_window_corpus", sql('SELECT r AS "row", c AS col, n FROM pp', ctes=_pairs))(_window)
_am = _pairs + ", mg AS (SELECT r, CAST(sum(n) AS DOUBLE) AS m FROM pp GROUP BY r), al AS (SELECT pp.r, pp.c, CAST(n AS DOUBLE) AS o, a.m AS rm, b.m AS cm, (SELECT CAST(sum(n) AS DOUBLE) FROM pp) AS t FROM pp JOIN mg a ON a.r = pp.r JOIN mg b ON b.r = pp.c)"
_e = lambda o, x: f"CASE WHEN {o} > 0 AND {x} > 0 THEN 2 * {o} * ln({o} / ({x})) ELSE 0 END"
_ag2 = " + ".join([_e("o", "rm * cm / t"), _e("(rm - o)", "rm * (t - cm) / t"), _e("(cm - o)", "(t - rm) * cm / t"), _e("(t - rm - cm + o)", "(t - rm) * (t - cm) / t")])
_assoc = {
    "logdice": "14 + log2(2 * o / (rm + cm))",
    "g2": f"CASE WHEN o > rm OR o > cm OR rm > t OR cm > t OR t - rm - cm + o < 0 THEN NULL WHEN o >= rm * cm / t THEN {_ag2} ELSE -({_ag2}) END",
    "npmi": "CASE WHEN o = 0 THEN -1 WHEN o / t >= 1 THEN 1 ELSE log2(o * t / (rm * cm)) / -log2(o / t) END",
    "pearson": "(o - rm * cm / t) / sqrt(rm * cm / t)",
    "ppmi": "CASE WHEN o = 0 THEN 0 ELSE greatest(0, log2(o * t / (rm * cm))) END",
    "raw": "o",
}
for _k, _v in _assoc.items():
    query(f"assoc_{_k}", sql(f'SELECT r AS "row", c AS col, CAST(o AS BIGINT) AS n, round({_v}, 6) AS score FROM al', ctes=_am))(lambda s, d, k=_k: cooc.associations(_window(s, d), k))

# -- term and document weights ---------------------------------------------------------------------------------------

_idf = """fl AS (SELECT term, tf, dl, p.lang = 'fr' AS f FROM post p JOIN ds USING (doc_id)), ft AS (SELECT sum(dl) AS ft, count(*) FILTER (dl > 0) AS fd FROM ds WHERE lang = 'fr'),
    lo AS (SELECT term, f, CAST(tf AS DOUBLE) AS tf, dl, tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (CAST(n AS DOUBLE) / nd))) AS l FROM fl, tot),
    ac AS (SELECT term, sum(tf) AS cf, count(*) AS df, count(*) FILTER (f) AS fdf, coalesce(sum(tf) FILTER (f), 0) AS ff, coalesce(sum(l) FILTER (f), 0) AS acc, coalesce(sum(l) FILTER (NOT f), 0) AS oth FROM lo GROUP BY term)"""
_ci = "power(ln(1 + (nd - df + 0.5) / (df + 0.5)), 0.9)"
_rsj = "ln((fdf + 0.5) * ((nd - fd) - (df - fdf) + 0.5) / ((df - fdf + 0.5) * (fd - fdf + 0.5)))"
_modes = {
    "bm25": f"{_ci} * (acc + oth)",
    "irdf": "power(ln(1 + ((nd - fd) - (df - fdf) + 0.5) / ((df - fdf) + 0.5)), 0.9) * acc",
    "rsj": f"sign({_rsj}) * power(abs({_rsj}), 0.9) * acc",
    "factor": f"CASE WHEN ff > 0 THEN {_ci} * acc * ln((ff / ft) / (cf / n)) * ln(ff) ELSE 0 END",
    "weighted": f"{_ci} * (acc - 2 * oth)",
    "minus": f"{_ci} * (acc - oth)",
    "raw": "CAST(ff AS DOUBLE)",
}
for _k, _v in _modes.items():
    query(f"idf_{_k}", sql(f"SELECT term, round({_v}, 6) AS score FROM ac, tot, ft", ctes=_idf))(
        lambda s, d, k=_k: freq.idf_weights(corpus(s, d), None if k == "bm25" else F.col("lang") == "fr", k)
    )
_sum = lambda x: f"coalesce(sum({x}) FILTER (f), 0) - coalesce(sum({x}) FILTER (NOT f), 0)"
query("idf_g2", sql(f"SELECT lo.term, round({_sum('2 * lo.tf * ln(lo.tf / (voc.tf / CAST(n AS DOUBLE) * dl))')}, 6) AS score FROM lo JOIN voc ON voc.term = lo.term, tot GROUP BY lo.term", ctes=_idf))(
    lambda s, d: freq.idf_weights(corpus(s, d), F.col("lang") == "fr", "g2")
)
query("idf_jaccard", sql(f"SELECT lo.term, round({_sum('lo.tf / (dl + voc.tf - lo.tf)')}, 6) AS score FROM lo JOIN voc ON voc.term = lo.term GROUP BY lo.term", ctes=_idf))(
    lambda s, d: freq.idf_weights(corpus(s, d), F.col("lang") == "fr", "jaccard")
)
_dk = lambda f, p: f"CASE WHEN coalesce(sum(tf) FILTER ({f}), 0) > 0 AND ({p}) > 0 THEN (sum(tf * ln(tf)) FILTER ({f}) - sum(tf) FILTER ({f}) * ln(sum(tf) FILTER ({f})) - sum(tf * ln(dl)) FILTER ({f}) + sum(tf) FILTER ({f}) * ln({p})) / sum(tf) FILTER ({f}) END"
query("idf_dkl", sql(f"SELECT term, round({_dk('NOT f', '(SELECT n FROM tot) - (SELECT ft FROM ft)')} - {_dk('f', '(SELECT ft FROM ft)')}, 6) AS score FROM lo GROUP BY term", ctes=_idf))(
    lambda s, d: freq.idf_weights(corpus(s, d), F.col("lang") == "fr", "dkl")
)
query("terms_theme", sql(f"SELECT term, round({_ci.replace('0.9', '1.0')} * (acc + oth), 6) AS score FROM ac, tot ORDER BY score DESC, term LIMIT 50", ctes=_idf))(
    lambda s, d: top(freq.idf_weights(corpus(s, d), None, "bm25", 1.0), "score", 50).select("term", "score")
)
_tp = "tp AS (SELECT post.term, post.doc_id, post.tf, dl, voc.tf AS cf, df, n, nd FROM post JOIN ds USING (doc_id) JOIN voc ON voc.term = post.term, tot)"
query("termdoc_binary", sql("SELECT term, doc_id, tf, 1.0::DOUBLE AS score FROM tp", ctes=_tp))(lambda s, d: freq.document_weights(corpus(s, d), "binary"))
query("termdoc_bm25", sql("SELECT term, doc_id, tf, round(ln(1 + (nd - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (CAST(n AS DOUBLE) / nd))), 6) AS score FROM tp", ctes=_tp))(
    lambda s, d: freq.document_weights(corpus(s, d), "bm25")
)
query("termdoc_keyness", sql(f"SELECT term, doc_id, tf, round({keyness_sql('g2', 'tf', 'dl', 'cf - tf', 'n - dl')}, 6) AS score FROM tp", ctes=_tp))(
    lambda s, d: freq.document_weights(corpus(s, d), "keyness")
)
_x = "(CAST(cf AS DOUBLE) * dl / n)"
_sims = {
    "chi2": f"CASE WHEN tf = {_x} THEN NULL WHEN tf < {_x} THEN -log2((tf - {_x}) * (tf - {_x}) / {_x}) ELSE log2((tf - {_x}) * (tf - {_x}) / {_x}) END",
    "chi2inv": f"CASE WHEN tf > {_x} THEN 0 ELSE (tf - {_x}) * (tf - {_x}) / {_x} END",
    "freq": "CAST(tf AS DOUBLE)",
    "g": f"CASE WHEN tf < {_x} THEN -1 ELSE 1 END * (tf * ln(tf / {_x}) + (n - tf) * ln((n - tf) / (n - {_x})))",
    "gsimple": f"CASE WHEN tf < {_x} THEN -1 ELSE 1 END * tf * ln(tf / {_x})",
}
for _k, _v in _sims.items():
    query(f"sim_{_k}", sql(f"SELECT doc_id, term, round({_v}, 6) AS score FROM tp WHERE term IN ('the', 'reth', 'und')", ctes=_tp))(
        lambda s, d, k=_k: freq.similarities(corpus(s, d), k, ["the", "reth", "und"])
    )

# -- histograms, labels, lists and suggestion ------------------------------------------------------------------------

_hist = "SELECT y.year, coalesce(docs, 0) AS docs, coalesce(tokens, 0) AS tokens, coalesce(tokens, 0) AS width FROM (SELECT CAST(unnest(range((SELECT min(year) FROM ds), (SELECT max(year) FROM ds) + 1)) AS INTEGER) AS year) y LEFT JOIN (SELECT year, count(*) AS docs, CAST(sum(dl) AS BIGINT) AS tokens FROM ds {} GROUP BY year) h ON h.year = y.year"
query("histo_docs", sql(_hist.format("")))(lambda s, d: freq.histogram(corpus(s, d)))
query("histo_filtered", sql(_hist.format("WHERE lang = 'fr'")))(lambda s, d: freq.histogram(corpus(s, d), F.col("lang") == "fr"))
query("chrono_snippets", sql(f"SELECT b.*, coalesce(snippets, 0) AS snippets, coalesce(docs_hit, 0) AS docs_hit FROM ({_hist.format('')}) b LEFT JOIN (SELECT year, count(*) AS snippets, count(DISTINCT sn.doc_id) AS docs_hit FROM sn JOIN ds USING (doc_id) GROUP BY year) h ON h.year = b.year", ctes=SNIP))(
    lambda s, d: chrono(corpus(s, d), "the")
)


def chrono(c: Corpus, text: str, gap: int = 20) -> DataFrame:
    """The histogram with the snippets of a query and the documents that hold them, by year."""
    snips = sp.snippets(sp.find(c, text), gap).groupBy("doc_id").agg(F.count("*").alias("n"))
    hit = snips.join(c.doc_stats.select("doc_id", "year"), "doc_id").groupBy("year").agg(F.sum("n").alias("snippets"), F.count("*").alias("docs_hit"))
    return freq.histogram(c).join(hit, "year", "left").na.fill(0, ["snippets", "docs_hit"])


query("category_counts", "SELECT lang AS label, count(*) AS docs FROM documents WHERE lang IS NOT NULL GROUP BY lang")(lambda s, d: freq.label_counts(_docs(s, d), F.col("lang")))
query("facet_counts", "SELECT label, count(*) AS docs FROM (SELECT unnest(list_distinct([lang, source])) AS label FROM documents) WHERE label IS NOT NULL GROUP BY label")(
    lambda s, d: freq.label_counts(_docs(s, d), F.array("lang", "source"), many=True)
)
query("top_labels", "SELECT source AS label, count(*) AS docs FROM documents GROUP BY source ORDER BY docs DESC, label DESC LIMIT 20")(lambda s, d: freq.top_labels(_docs(s, d), F.col("source")))
query("first_rank_by_label", sql(f"""SELECT lang AS label, CAST(min(r) AS INTEGER) AS first_rank FROM (SELECT lang, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM (SELECT doc_id, lang, round({_bm} * spans * 2.2 / (spans + 1.2 * (0.25 + 0.75 * dl / (CAST(n AS DOUBLE) / nd))), 6) AS score FROM f JOIN ds USING (doc_id), tot, (SELECT count(*) AS df FROM f) x
    ORDER BY score DESC, doc_id LIMIT 1000)) GROUP BY lang""", ctes="sp AS (SELECT doc_id, pos AS s FROM tok WHERE term IN ('the', 'de', 'und')), f AS (SELECT doc_id, count(*) AS spans FROM sp GROUP BY doc_id)"))(
    lambda s, d: (lambda c: freq.first_rank(concord.ranked_documents(c, sp.find(c, "(the de und)"), 1000), "lang"))(corpus(s, d))
)
query("series_stats", sql("SELECT count(dl) AS size, min(dl) AS least, max(dl) AS greatest, round(avg(dl), 6) AS mean, median(dl) AS median, round(stddev_pop(dl), 6) AS stddev, CAST(sum(dl) AS BIGINT) AS total, quantile_disc(dl, 0.25) AS q1, quantile_disc(dl, 0.75) AS q3, (SELECT dl FROM ds GROUP BY dl ORDER BY count(*) DESC, dl LIMIT 1) AS mode FROM ds"))(
    lambda s, d: freq.series_statistics(corpus(s, d).doc_stats, "doc_tokens")
)
_tenths = [i / 10 for i in range(1, 10)]
query("series_deciles", sql("SELECT " + ", ".join(f"quantile_disc(dl, {q}) AS d{i}" for i, q in enumerate(_tenths, 1)) + " FROM ds"))(lambda s, d: freq.series_deciles(corpus(s, d).doc_stats, "doc_tokens"))
query("docs_sorted", "SELECT doc_id, lang, source FROM documents ORDER BY source DESC NULLS LAST, doc_id LIMIT 100")(lambda s, d: sorted_by_label(_docs(s, d), "source", 100, True).select("doc_id", "lang", "source"))
query("set_ranking", sql("SELECT voc.term, tf AS freq, score, CAST(row_number() OVER (ORDER BY score DESC, voc.term) AS INTEGER) AS rank FROM voc JOIN (VALUES ('the', 2.0::DOUBLE), ('of', 3.0), ('und', 2.0), ('zzabsent', 9.0)) x(term, score) ON x.term = voc.term"))(
    lambda s, d: ranked_outside(corpus(s, d).vocabulary.select("term", F.col("tf").alias("freq")), _two(s, [("the", 2.0), ("of", 3.0), ("und", 2.0), ("zzabsent", 9.0)], ("term", "score"))).select("term", "freq", "score", "rank")
)
_starlex = [("ands", "and"), ("thes", "the"), ("the", "the")]
query("star_lemmas", sql("SELECT coalesce(m.l, term) AS lem, CAST(sum(tf) AS BIGINT) AS n FROM voc LEFT JOIN (VALUES ('ands', 'and'), ('thes', 'the'), ('the', 'the')) m(f, l) ON m.f = term GROUP BY lem"))(
    lambda s, d: _star(corpus(s, d), _two(s, _starlex, ("form", "lemma")))["lem"].select("lem", "n")
)


def _star(c: Corpus, forms: DataFrame) -> dict[str, DataFrame]:
    from .operations import star_schema

    return star_schema(c, forms)


_xml = """xb AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ord FROM conversations)"""
query("xml_books", f"""WITH {_xml} SELECT 'b' || conv_id AS id, 'b' || conv_id AS book_id, 'book' AS type, 0 AS ord, conv_id AS number, CAST(NULL AS VARCHAR) AS role, 0 AS n_chars FROM xb GROUP BY conv_id
    UNION ALL SELECT 'b' || conv_id || '-' || CASE WHEN ord < 10 THEN '0' ELSE '' END || ord, 'b' || conv_id, 'chapter', CAST(ord AS INTEGER), NULL, role, length(text) FROM xb""")(lambda s, d: xml_books(s.read.parquet(f"{d}/conversations.parquet")))


def xml_books(turns: DataFrame) -> DataFrame:
    """Conversations as XML books of chapters, read back by the ingest grammar."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    chapter = F.concat(F.lit('<chapter><field name="role" type="category" value="'), F.col("role"), F.lit('"/><field name="text" type="text">'), safe(F.col("text")), F.lit("</field></chapter>"))
    books = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", chapter.alias("c")))).alias("t"))
    head = F.concat(F.lit('<book xml:id="b'), F.col("conv_id").cast("string"), F.lit('"><field name="number" type="int" value="'), F.col("conv_id").cast("string"), F.lit('"/>'))
    content = F.concat(head, F.array_join(F.transform("t", lambda x: x["c"]), ""), F.lit("</book>")).cast("binary")
    table = xml.corpus_table(xml.parsed(books.select(content.alias("content"), F.lit("conversations").alias("stem"))), {"number": "int", "role": "category", "text": "text"})
    return table.select("id", "book_id", "type", "ord", F.col("number").cast("long").alias("number"), "role", F.length("text").cast("long").alias("n_chars"))


query("freqlist", f"WITH t AS (SELECT unnest(regexp_extract_all(text, '{analysis.WORD.replace(chr(39), chr(39) * 2)}')) AS term FROM documents) SELECT term, count(*) AS tf FROM t WHERE regexp_matches(term, '^[{_up}]') GROUP BY term ORDER BY tf DESC, term LIMIT 200")(
    lambda s, d: top(_docs(s, d).select(F.explode(F.regexp_extract_all("text", F.lit(analysis.WORD), F.lit(0))).alias("term")).where(F.col("term").rlike(f"^[{_up}]")).groupBy("term").agg(F.count("*").alias("tf")), "tf", 200).select("term", "tf")
)
_fold = "translate(replace(replace(replace(term, 'œ', 'oe'), 'æ', 'ae'), 'ß', 'ss'), 'àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ', 'aaaaaaceeeeiiiinoooooouuuuyy')"
query("gamma_functions", sql("SELECT term, df, round(gamma(df / 4.0), 6) AS gamma FROM voc WHERE df <= 40"))(
    lambda s, d: corpus(s, d).vocabulary.where("df <= 40").select("term", "df", F.round(scorers.gamma(F.col("df") / 4.0), DIGITS).alias("gamma"))
)
query("suggest_ligature", sql(f"SELECT CAST(row_number() OVER (ORDER BY tf DESC, term) AS INTEGER) AS rank, term, tf AS freq, df AS docs FROM (SELECT * FROM voc WHERE contains({_fold}, 'oeu') ORDER BY tf DESC, term LIMIT 20)"))(lambda s, d: freq.suggest(corpus(s, d), "œu"))
query("suggest_prefix", sql(f"SELECT CAST(row_number() OVER (ORDER BY tf DESC, term) AS INTEGER) AS rank, term, tf AS freq, df AS docs FROM (SELECT * FROM voc WHERE starts_with({_fold}, 're') ORDER BY tf DESC, term LIMIT 20)"))(
    lambda s, d: freq.suggest(corpus(s, d), "ré")
)
query("suggest_infix", sql(f"SELECT CAST(row_number() OVER (ORDER BY freq DESC, term) AS INTEGER) AS rank, * FROM (SELECT term, freq, docs FROM fc WHERE freq > 0 AND contains({_fold}, 'ete') ORDER BY freq DESC, term LIMIT 20)", ctes=_focus))(
    lambda s, d: freq.suggest(corpus(s, d), "été", focus=F.col("lang") == "fr")
)
query("dictionary_compile", sql("SELECT term, tf, df, dw.tags AS tags FROM voc JOIN (VALUES ('the', 'po:det'), ('of', 'po:adp'), ('absent', 'po:noun'), ('und', 'po:conj')) dw(w, tags) ON w = term"))(
    lambda s, d: lexicon.compiled(corpus(s, d).vocabulary, _two(s, [("the", "po:det"), ("of", "po:adp"), ("absent", "po:noun"), ("und", "po:conj")], ("term", "tags")))
)
query("dictionary_unknowns", sql("SELECT term, tf FROM voc WHERE term NOT IN ('the', 'of', 'und') ORDER BY tf DESC, term LIMIT 2000"))(
    lambda s, d: lexicon.unknown(corpus(s, d).vocabulary, _two(s, [("the",), ("of",), ("und",)], ("term",)), 2000)
)
query("term_flags", sql("SELECT term, tf FROM voc JOIN (VALUES ('the', 'po:det'), ('of', 'po:adp'), ('of', 'po:noun'), ('und', 'po:conj')) dw(w, f) ON w = term WHERE (w, f) IN (('of', 'po:adp'), ('und', 'po:conj'))"))(
    lambda s, d: lexicon.flagged(corpus(s, d).vocabulary, _two(s, [("the", "po:det", 0), ("of", "po:adp", 1), ("of", "po:noun", 2), ("und", "po:conj", 3)], ("term", "flag", "ord")), ["po:adp", "po:conj"]).select("term", "tf")
)
query("trigrams", sql("SELECT gram, n FROM (SELECT term || ' ' || t2 || ' ' || t3 AS gram, count(*) AS n FROM (SELECT term, lead(term, 1) OVER o AS t2, lead(term, 2) OVER o AS t3 FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY pos)) WHERE t3 IS NOT NULL GROUP BY gram) ORDER BY n DESC, gram LIMIT 2000"))(
    lambda s, d: lexicon.ngrams(corpus(s, d).tokens, 3, 2000)
)
query("training_text", sql("SELECT doc_id, array_to_string(list_filter(ws, lambda x: x NOT IN ('the', 'of')), ' ') AS line FROM w"))(lambda s, d: lexicon.training_lines(corpus(s, d), ["the", "of"]))

# -- parts -----------------------------------------------------------------------------------------------------------

_P = [(0, 4), (5, 9), (10, 14), (15, 19)]
_part = "CASE WHEN year BETWEEN 0 AND 4 THEN 0 WHEN year BETWEEN 5 AND 9 THEN 1 WHEN year BETWEEN 10 AND 14 THEN 2 WHEN year BETWEEN 15 AND 19 THEN 3 END"
_pa = f"""pp AS (SELECT term, {_part} AS part, sum(tf) AS tf, count(*) AS d FROM post WHERE {_part} IS NOT NULL GROUP BY ALL),
    pt AS (SELECT {_part} AS part, CAST(sum(dl) AS DOUBLE) AS t, count(*) FILTER (dl > 0) AS d FROM ds WHERE {_part} IS NOT NULL GROUP BY ALL),
    pw AS (SELECT term, """ + ", ".join(f"CAST(coalesce(sum(tf) FILTER (part = {i}), 0) AS DOUBLE) AS f{i}, (SELECT t FROM pt WHERE part = {i}) AS t{i}" for i in range(4)) + """, coalesce(sum(d) FILTER (part = 1), 0) AS fd, (SELECT d FROM pt WHERE part = 1) AS dd FROM pp GROUP BY term)"""  # fmt: skip


def _four(c: Corpus):
    return parts.part_of([parts.Part(a, b, 0, 0) for a, b in _P], F.col("year"))


def _part_query(s, d, kind, digits=DIGITS):
    c = corpus(s, d)
    totals, docs = parts.part_totals(c, _four(c), 4, 1)
    return parts.part_arrays(c, _four(c), 4, 1).select("term", F.round(parts.part_score(kind, totals, 1, docs), digits).alias("score")).where("score is not null")


def _pg(i):
    return f"CASE WHEN f1 + f{i} = 0 OR f1 + f{i} = t1 + t{i} THEN 0 ELSE {keyness_sql('g2', 'f1', 't1', f'f{i}', f't{i}')} END"


_n, _t, _x1 = "(f0 + f1 + f2 + f3)", "(t0 + t1 + t2 + t3)", "((f0 + f1 + f2 + f3) * t1 / (t0 + t1 + t2 + t3))"
_dv = lambda o, e: f"CASE WHEN {o} > 0 THEN 2 * ({o} * ln({o} / {e}) - {o} + {e}) ELSE 2 * {e} END"
_lc = lambda n, k: f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"
_hyper = f"exp({_lc(_n, 'CAST(k AS DOUBLE)')} + {_lc(f'({_t} - {_n})', '(t1 - k)')} - {_lc(_t, 't1')})"
_pscores = {
    "ll": f"CASE WHEN fd >= 3 THEN least({_pg(0)}, {_pg(2)}, {_pg(3)}) * power(fd / CAST(dd AS DOUBLE), 0.3) END",
    "ll_tail": f"CASE WHEN fd >= 3 THEN least({_pg(0)}, {_pg(2)}, {_pg(3)}) * power(fd / CAST(dd AS DOUBLE), 0.3) END",
    "residual": f"CASE WHEN f1 >= 5 AND {_x1} > 0 AND {_x1} < {_n} THEN CASE WHEN f1 >= {_x1} THEN 1 ELSE -1 END * sqrt({_dv('f1', _x1)} + {_dv(f'({_n} - f1)', f'({_n} - {_x1})')}) END",
    "pearson": f"CASE WHEN f1 >= 5 THEN (f1 - {_x1}) / sqrt({_x1} * (1 - {_n} / {_t}) * (1 - t1 / {_t})) END",
    "rate_ratio": "CASE WHEN f1 >= 5 THEN log2((f1 + 0.3) / (t1 + 0.3) / greatest((f0 + 0.3) / (t0 + 0.3), (f2 + 0.3) / (t2 + 0.3), (f3 + 0.3) / (t3 + 0.3))) END",
}
for _k, _v in _pscores.items():
    query(f"part_{_k}", sql(f"SELECT * FROM (SELECT term, round({_v}, 6) AS score FROM pw) WHERE score IS NOT NULL", ctes=_pa))(lambda s, d, k=_k: _part_query(s, d, k))
query("part_specificity", sql(f"""SELECT term, round(CASE WHEN up THEN -log10(greatest(least(p, 1), 1e-300)) ELSE log10(greatest(least(p, 1), 1e-300)) END, 4) AS score FROM
    (SELECT term, up, sum({_hyper}) AS p FROM (SELECT *, f1 >= {_x1} AS up, unnest(CASE WHEN f1 >= {_x1} THEN range(CAST(f1 AS BIGINT), CAST(least({_n}, t1) AS BIGINT) + 1) ELSE range(CAST(greatest(0, {_n} + t1 - {_t}) AS BIGINT), CAST(f1 AS BIGINT) + 1) END) AS k FROM pw WHERE f1 >= 5) GROUP BY ALL)""", ctes=_pa))(
    lambda s, d: _part_query(s, d, "specificity", 4)
)
query("part_topk", sql(f"SELECT part, term, CAST(tf AS BIGINT) AS freq, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY tf DESC, term) - 1 AS r FROM pp) WHERE r < 500", ctes=_pa))(
    lambda s, d: (lambda c: parts.part_ranks(c, _four(c), 500))(corpus(s, d))
)
_rk = _pa + """, rk AS (SELECT * FROM (SELECT term, part, tf, row_number() OVER (PARTITION BY part ORDER BY tf DESC, term) - 1 AS r FROM pp) WHERE r < 500),
    rw AS (SELECT term, """ + ", ".join(f"CAST(coalesce(min(r) FILTER (part = {i}), 500) AS DOUBLE) AS r{i}, coalesce(sum(tf) FILTER (part = {i}), 0) / (SELECT t FROM pt WHERE part = {i}) AS q{i}, CAST(coalesce(sum(tf) FILTER (part = {i}), 0) AS DOUBLE) AS c{i}" for i in range(4)) + " FROM rk GROUP BY term HAVING count(*) FILTER (part = 1) > 0)"  # fmt: skip
_rr = lambda x: f"(1 / (60 + {x}))"
_bst, _med = "least(r0, r2, r3)", "list_sort([r0, r2, r3])[2]"
_shr = "ln(1 + c1) * greatest(0, 1 - greatest(q0, q2, q3) / q1)"
_ranks = {
    "gap": f"{_bst} - r1",
    "rrf": f"{_rr('r1')} - {_rr(_bst)}",
    "weighted": f"({_rr('r1')} - {_rr(_bst)}) * ln(1 + c1)",
    "rate": f"({_rr('r1')} - {_rr(_bst)}) * {_shr}",
    "rate_median": f"({_rr('r1')} - {_rr(_med)}) * {_shr}",
    "ratio": f"{_rr('r1')} / ({_rr('r0')} + {_rr('r1')} + {_rr('r2')} + {_rr('r3')})",
}


def _rank_query(s, d, kind):
    c = corpus(s, d)
    totals, _ = parts.part_totals(c, _four(c), 4, 1)
    return parts.rank_contrast(parts.part_ranks(c, _four(c), 500), kind, 4, 1, 500, totals)


for _k, _v in _ranks.items():
    query(f"rank_{_k}", sql(f"SELECT term, round({_v}, 8) AS score FROM rw", ctes=_rk))(lambda s, d, k=_k: _rank_query(s, d, k))


@query("partition_periods")
def partition_periods(spark, sf_dir):
    found = parts.partition(corpus(spark, sf_dir), 8, 10, edge_tokens=2500, inner_tokens=1000, least_docs=3)
    return _two(spark, [(p.start, p.end, p.docs, p.tokens, p.focus) for p in found], ("first", "last", "docs", "tokens", "focus"))


# -- vectors and matrices --------------------------------------------------------------------------------------------

_sel = "sel AS (SELECT term, tf, df FROM voc WHERE df >= 3 ORDER BY tf DESC, term LIMIT 100)"
_rc = _sel + """, ce AS (SELECT post.term AS r, post.doc_id AS c, CAST(post.tf AS DOUBLE) AS o FROM post WHERE term IN (SELECT term FROM sel)),
    ex AS (SELECT ce.*, rt * ct / (SELECT sum(o) FROM ce) AS e FROM ce JOIN (SELECT r, sum(o) AS rt FROM ce GROUP BY r) USING (r) JOIN (SELECT c, sum(o) AS ct FROM ce GROUP BY c) USING (c))"""
_res = {
    "deviance": "CASE WHEN o >= e THEN 1 ELSE -1 END * sqrt(greatest(0, 2 * (o * ln(o / e) - o + e)))",
    "freeman_tukey": "sqrt(o) + sqrt(o + 1) - sqrt(4 * e + 1)",
    "pearson": "(o - e) / sqrt(e)",
}


def _cells(c: Corpus, most: int = 100) -> DataFrame:
    return vectors.term_document_cells(c, vectors.selected_terms(c, 3, most))


def _held(c: Corpus, name: str = "w", most: int = 100) -> DataFrame:
    """The counts of ``_cells`` in the documents' rows."""
    held = vectors.document_cells(c, vectors.selected_terms(c, 3, most), lambda tf, dl, cf, df: tf.cast("double"))
    return held if name == "w" else held.select("col", F.transform("held", lambda x: F.struct(x["row"].alias("row"), x["w"].alias(name))).alias("held"))


for _k, _v in _res.items():
    query(f"residual_{_k}", sql(f'SELECT r AS "row", c AS col, round({_v}, 6) AS value FROM ex', ctes=_rc))(lambda s, d, k=_k: vectors.residuals(_cells(corpus(s, d)), k))
query("table_inertia", sql("SELECT round(2 * sum(o * ln(o / e)), 6) AS g2 FROM ex", ctes=_rc))(lambda s, d: vectors.inertia(_cells(corpus(s, d))))
_bw = _sel + ", bw AS (SELECT post.term AS r, doc_id AS c, ln(1 + (nd - sel.df + 0.5) / (sel.df + 0.5)) * post.tf / (post.tf + 1.2 * (0.25 + 0.75 * dl / (CAST(n AS DOUBLE) / nd))) AS w FROM post JOIN sel ON sel.term = post.term JOIN ds USING (doc_id), tot)"


def _bm(s, d):
    c = corpus(s, d)
    return vectors.document_cells(c, vectors.selected_terms(c, 3, 100), vectors.bm25_weight(c))


query("latent_bm25_raw", sql("SELECT a, b, round(dot / (x.nm * y.nm), 6) AS cosine FROM (SELECT p.r AS a, q.r AS b, sum(p.w * q.w) AS dot FROM bw p JOIN bw q ON p.c = q.c AND p.r < q.r GROUP BY ALL) JOIN (SELECT r, sqrt(sum(w * w)) AS nm FROM bw GROUP BY r) x ON x.r = a JOIN (SELECT r, sqrt(sum(w * w)) AS nm FROM bw GROUP BY r) y ON y.r = b", ctes=_bw))(
    lambda s, d: vectors.cosine_rows(_bm(s, d))
)
for _k, _w in {"g2": "({0})", "g2root": "sign({0}) * sqrt(abs({0}))"}.items():
    _gw = _sel + f", gw AS (SELECT post.term AS r, doc_id AS c, {_w.format(keyness_sql('g2', 'post.tf', 'dl', 'sel.tf - post.tf', 'n - dl'))} AS w FROM post JOIN sel ON sel.term = post.term JOIN ds USING (doc_id), tot)"
    query(f"latent_{_k}", sql("SELECT a, b, round(dot / (x.nm * y.nm), 6) + 0.0 AS cosine FROM (SELECT p.r AS a, q.r AS b, sum(p.w * q.w) AS dot FROM gw p JOIN gw q ON p.c = q.c AND p.r < q.r GROUP BY ALL) JOIN (SELECT r, sqrt(sum(w * w)) AS nm FROM gw GROUP BY r) x ON x.r = a JOIN (SELECT r, sqrt(sum(w * w)) AS nm FROM gw GROUP BY r) y ON y.r = b WHERE x.nm > 0 AND y.nm > 0", ctes=_gw))(
        lambda s, d, k=_k: (lambda c: vectors.cosine_rows(vectors.document_cells(c, vectors.selected_terms(c, 3, 100), vectors.g2_weight(c, k == "g2root"))))(corpus(s, d))
    )
_full = _bw + """, fm AS (SELECT x.r, y.c, coalesce(w, 0) AS w, x.rt * y.ct / (SELECT sum(w) FROM bw) AS e FROM (SELECT r, sum(w) AS rt FROM bw GROUP BY r) x CROSS JOIN (SELECT c, sum(w) AS ct FROM bw GROUP BY c) y LEFT JOIN bw ON bw.r = x.r AND bw.c = y.c)"""
_lat = {"pearson": "(w - e) / sqrt(e)", "dev": "CASE WHEN w > 0 THEN CASE WHEN w >= e THEN 1 ELSE -1 END * sqrt(greatest(0, 2 * (w * ln(w / e) - w + e))) ELSE -sqrt(2 * e) END"}
for _k, _v in _lat.items():
    query(f"latent_bm25_{_k}", sql(f"SELECT 'the' AS a, q.r AS b, round(sum(p.v * q.v) / (sqrt(sum(p.v * p.v)) * sqrt(sum(q.v * q.v))), 6) AS cosine FROM rv p JOIN rv q ON p.c = q.c WHERE p.r = 'the' AND q.r <> 'the' GROUP BY q.r", ctes=_full + f", rv AS (SELECT r, c, {_v} AS v FROM fm)"))(
        lambda s, d, k=_k: vectors.residual_cosine(_bm(s, d).select("col", F.explode("held").alias("c")).select(F.col("c.row").alias("row"), "col", F.col("c.w").alias("w")), "the", k)
    )
_contrast = _bw + """, nr AS (SELECT c, sqrt(sum(w * w)) AS nm FROM bw GROUP BY c), rt AS (SELECT r, sum(w) AS t FROM bw GROUP BY r), gv AS (SELECT bw.r, bw.c, w / nm AS g, w / t AS v FROM bw JOIN nr USING (c) JOIN rt USING (r)),
    mg AS (SELECT r AS b, sum(g) / (SELECT count(*) FROM nr) AS mean FROM gv GROUP BY r), pg AS (SELECT x.r AS a, y.r AS b, sum(x.v * y.g) AS p FROM gv x JOIN gv y ON x.c = y.c GROUP BY ALL),
    aw AS (SELECT t.a, mg.b, coalesce(p, 0) - mean AS d FROM (SELECT r AS a FROM rt) t CROSS JOIN mg LEFT JOIN pg ON pg.a = t.a AND pg.b = mg.b), xx AS (SELECT a, c, sum(d * g) AS x FROM aw JOIN gv ON gv.r = aw.b GROUP BY ALL),
    yy AS (SELECT xx.a, xx.c, x + coalesce(v, 0) AS x FROM xx LEFT JOIN gv ON gv.r = xx.a AND gv.c = xx.c), nn AS (SELECT a, sqrt(sum(x * x)) AS n FROM yy GROUP BY a)"""
query("latent_contrast", sql("SELECT b, round(dot / (x.n * y.n), 6) AS cosine FROM (SELECT q.a AS b, sum(p.x * q.x) AS dot FROM yy p JOIN yy q ON p.c = q.c WHERE p.a = 'the' AND q.a <> 'the' GROUP BY q.a) JOIN nn x ON x.a = 'the' JOIN nn y ON y.a = b ORDER BY dot / (x.n * y.n) DESC, b LIMIT 30", ctes=_contrast))(lambda s, d: vectors.contrast_neighbours(_bm(s, d), "the"))


def _dev_gram(s, d, most=60):
    return vectors.deviance_gram(_held(corpus(s, d), "n", most))


@query("svd_embedding")
def svd_embedding(spark, sf_dir):
    rows, _, gram = _dev_gram(spark, sf_dir)
    return vectors.coordinates_frame(spark, rows, vectors.decompose_gram(gram, 8)[0])


@query("mds_layout")
def mds_layout(spark, sf_dir):
    rows, _, gram = _dev_gram(spark, sf_dir)
    size = gram.diagonal() ** 0.5
    size[size == 0] = 1
    return vectors.coordinates_frame(spark, rows, vectors.map_layout(gram / size[:, None] / size[None, :])[0])


@query("word_plane")
def word_plane(spark, sf_dir):
    rows, mass, gram = _dev_gram(spark, sf_dir)
    return vectors.coordinates_frame(spark, rows, vectors.word_plane_gram(gram, mass)[0])


_qs = "vec_id IN (0, 7, 42)"
_dots = "list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST({}.embedding[i] AS DOUBLE)))"
query("knn_euclid", f"SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY value, id) AS INTEGER) AS rank, id, value FROM (SELECT q.vec_id AS query_id, a.vec_id AS id, round(sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: power(CAST(a.embedding[i] AS DOUBLE) - CAST(q.embedding[i] AS DOUBLE), 2)))), 6) AS value FROM embeddings a JOIN embeddings q ON q.{_qs} AND a.vec_id <> q.vec_id) QUALIFY rank <= 50")(
    lambda s, d: (lambda e: vectors.nearest(e, e.where(_qs), 50))(s.read.parquet(f"{d}/embeddings.parquet"))
)
query("knn_cosine", f"SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY value DESC, id) AS INTEGER) AS rank, id, value FROM (SELECT q.vec_id AS query_id, a.vec_id AS id, round({_dots.format('q')} / (sqrt({_dots.format('a')}) * sqrt({_dots.format('q').replace('a.embedding', 'q.embedding')})), 6) AS value FROM embeddings a JOIN embeddings q ON q.{_qs} AND a.vec_id <> q.vec_id) QUALIFY rank <= 50")(
    lambda s, d: (lambda e: vectors.nearest(e, e.where(_qs), 50, "cosine"))(s.read.parquet(f"{d}/embeddings.parquet"))
)
_lt = _sel.replace("LIMIT 100", "LIMIT 300") + ", lc AS (SELECT lang AS r, term AS c, sum(tf) AS n FROM post WHERE term IN (SELECT term FROM sel) GROUP BY ALL), lr AS (SELECT r, sum(n) AS rt FROM lc GROUP BY r), lk AS (SELECT c, sum(n) AS ct FROM lc GROUP BY c)"


def _lang_cells(s, d):
    c = corpus(s, d)
    sel = vectors.selected_terms(c, 3, 300)
    return c.postings.join(F.broadcast(sel.select("term")), "term").groupBy(F.col("lang").alias("row"), F.col("term").alias("col")).agg(F.sum("tf").alias("n"))


_chord = ", lu AS (SELECT r, c, w / sqrt(sum(w * w) OVER (PARTITION BY r)) AS w FROM lw)"
_pair = "SELECT x.r AS a, y.r AS b, round(sqrt(greatest(0, 2 - 2 * coalesce(least(1, greatest(-1, (SELECT sum(p.w * q.w) FROM lu p JOIN lu q ON p.c = q.c WHERE p.r = x.r AND q.r = y.r))), 0))), 6) AS distance FROM lr x JOIN lr y ON x.r < y.r"
query("dist_hellinger", sql(_pair, ctes=_lt + ", lw AS (SELECT r, c, sqrt(CAST(n AS DOUBLE) / rt) AS w FROM lc JOIN lr USING (r))" + _chord))(lambda s, d: vectors.profile_distance(_lang_cells(s, d), "hellinger"))
query("dist_keyness_chord", sql(_pair, ctes=_lt + f", lw AS (SELECT r, c, sqrt(greatest(0, {keyness_sql('g2', 'n', 'rt', 'ct - n', '(SELECT sum(n) FROM lc) - rt')})) AS w FROM lc JOIN lr USING (r) JOIN lk USING (c))" + _chord))(
    lambda s, d: vectors.profile_distance(_lang_cells(s, d), "keyness_chord")
)
_setd = _sel + ", m AS (SELECT term AS r, doc_id AS c FROM post WHERE term IN (SELECT term FROM sel)), z AS (SELECT r, CAST(count(*) AS DOUBLE) AS k FROM m GROUP BY r), i AS (SELECT p.r AS a, q.r AS b, count(*) AS n FROM m p JOIN m q ON p.c = q.c AND p.r < q.r GROUP BY ALL)"
for _k, _v in {"gene_sharing": "1 - n / least(x.k, y.k)", "ochiai": "sqrt(greatest(0, 2 - 2 * (n / sqrt(x.k * y.k))))"}.items():
    query(f"dist_{_k}", sql(f"SELECT a, b, round({_v}, 6) AS distance FROM i JOIN z x ON x.r = a JOIN z y ON y.r = b", ctes=_setd))(lambda s, d, k=_k: vectors.set_distance(_held(corpus(s, d)), k))
query("dist_euclid", sql("SELECT x.r AS a, y.r AS b, round(sqrt(greatest(0, x.sq + y.sq - 2 * coalesce(dot, 0))), 6) AS distance FROM (SELECT r, sum(o * o) AS sq FROM ce GROUP BY r) x JOIN (SELECT r, sum(o * o) AS sq FROM ce GROUP BY r) y ON x.r < y.r LEFT JOIN (SELECT p.r AS a, q.r AS b, sum(p.o * q.o) AS dot FROM ce p JOIN ce q ON p.c = q.c AND p.r < q.r GROUP BY ALL) t ON t.a = x.r AND t.b = y.r", ctes=_rc))(
    lambda s, d: vectors.euclid_rows(_held(corpus(s, d)))
)
query("dist_cosine", sql("SELECT a, b, round(dot / (x.nm * y.nm), 6) AS cosine FROM (SELECT p.r AS a, q.r AS b, sum(p.o * q.o) AS dot FROM ce p JOIN ce q ON p.c = q.c AND p.r < q.r GROUP BY ALL) JOIN (SELECT r, sqrt(sum(o * o)) AS nm FROM ce GROUP BY r) x ON x.r = a JOIN (SELECT r, sqrt(sum(o * o)) AS nm FROM ce GROUP BY r) y ON y.r = b", ctes=_rc))(
    lambda s, d: vectors.cosine_rows(_held(corpus(s, d)))
)
_fish = "fx AS (SELECT term, freq AS a, field_freq - freq AS b, CAST(fa AS BIGINT) - freq AS c, n - CAST(fa AS BIGINT) - (field_freq - freq) AS e FROM fc, fo, tot WHERE freq > 0)"
_hp = lambda k: f"exp({_lc('CAST(a + b AS DOUBLE)', f'CAST({k} AS DOUBLE)')} + {_lc('CAST(c + e AS DOUBLE)', f'CAST(a + c - {k} AS DOUBLE)')} - {_lc('CAST(a + b + c + e AS DOUBLE)', 'CAST(a + c AS DOUBLE)')})"
query("fisher_exact", sql(f"SELECT term, round(least(1, sum(p) FILTER (p <= own * (1 + 1e-7))), 6) AS two_sided, round(least(1, sum(p) FILTER (k <= a)), 6) AS left_side, round(least(1, sum(p) FILTER (k >= a)), 6) AS right_side FROM (SELECT *, {_hp('k')} AS p, {_hp('a')} AS own FROM (SELECT *, unnest(range(greatest(0, a + b + a + c - (a + b + c + e)), least(a + b, a + c) + 1)) AS k FROM fx)) GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY term"), ctes=_focus + "," + _fish))(
    lambda s, d: fisher(s, d)
)


def fisher(s, d):
    """Every term of the focus against the true totals of focus and rest."""
    c = corpus(s, d)
    inside, whole = freq.focus_total(c, F.col("lang") == "fr"), c.totals["n_tokens"]
    rows = freq.focus_counts(c, F.col("lang") == "fr").where("freq > 0")
    a, b = F.col("freq"), F.col("field_freq") - F.col("freq")
    f = scorers.fisher(a, b, F.lit(inside) - a, F.lit(whole - inside) - b)
    return rows.select("term", f.alias("f")).select("term", *(F.round(F.col(f"f.{c}"), DIGITS).alias(c) for c in ("two_sided", "left_side", "right_side")))


query("hypergeometric", sql(f"SELECT term, CASE WHEN df >= 2 AND nd - df >= 8 THEN round(exp({_lc('CAST(df AS DOUBLE)', '2.0')} + {_lc('CAST(nd - df AS DOUBLE)', '8.0')} - {_lc('CAST(nd AS DOUBLE)', '10.0')}), 6) ELSE 0 END AS p FROM voc, tot"))(
    lambda s, d: hypergeometric(corpus(s, d))
)


def hypergeometric(c: Corpus) -> DataFrame:
    """Every term's chance to be in just two of ten documents drawn; 0 where that can't be."""
    n, df = F.lit(c.totals["n_docs"]), F.col("df")
    can = (df >= 2) & (n - df >= 8)
    p = scorers.hypergeometric(F.lit(2), F.lit(10), F.when(can, df), n)
    return c.vocabulary.select("term", F.when(can, F.round(p, DIGITS)).otherwise(0.0).alias("p"))


query("top_terms_per_label", sql("SELECT lang, term, CAST(freq AS BIGINT) AS freq, CAST(r AS INTEGER) AS rank FROM (SELECT lang, term, sum(tf) AS freq, row_number() OVER (PARTITION BY lang ORDER BY sum(tf) DESC, term) AS r FROM post GROUP BY lang, term) WHERE r <= 25"))(
    lambda s, d: top_per_group(corpus(s, d).postings.groupBy("lang", "term").agg(F.sum("tf").alias("freq")), ["lang"], "freq", 25, "term")
)

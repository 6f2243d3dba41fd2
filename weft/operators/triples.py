"""The triple table: N-Triples in and out, hashes of documents, pattern queries, replacement and pages.

A triple is (s, p, o, o_is_iri, webid, doc_url). The same tuple may occur under two people.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.crawl import TRIPLES_PER_DOC
from weft.functions.urls import let
from weft.operators.tables import ROWS_PER_RANGE, number_groups

TERMS = ["s", "p", "o", "o_is_iri"]
_ISSUER = "http://www.w3.org/ns/solid/terms#oidcIssuer"
_LINE = r'^\s*(<([^>]*)>|_:(\S+))\s+<([^>]*)>\s+(<([^>]*)>|_:(\S+)|"((?:[^"\\]|\\.)*)"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)\s*\.\s*$'


_ESCAPES = (('"', r"\""), ("'", r"\'"), ("\n", r"\n"), ("\r", r"\r"), ("\t", r"\t"), ("\b", r"\b"), ("\f", r"\f"))


def escape(text: Column) -> Column:
    """A literal's text as N-Triples writes it."""
    text = F.replace(text, F.lit("\\"), F.lit(r"\\"))
    for raw, written in (_ESCAPES[0], *_ESCAPES[2:5]):
        text = F.replace(text, F.lit(raw), F.lit(written))
    return text


def _decode_units(text: Column) -> Column:
    """``text`` with ``\\uXXXX`` and ``\\UXXXXXXXX`` decoded. Two ``\\u`` that follow each other can be one character; what is none
    becomes U+FFFD."""

    def decode(parts: Column) -> Column:
        code = lambda n: F.lower(F.substring(F.try_element_at(parts, n), 1, 4))
        rest = lambda n: F.substring(F.try_element_at(parts, n), 5, 1 << 30)
        pair = lambda n: F.coalesce(code(n).rlike("^d[89ab]") & (rest(n) == "") & code(n + 1).rlike("^d[c-f]"), F.lit(False))
        utf16 = lambda digits: F.decode(F.unhex(digits), "UTF-16BE")
        one = lambda n: (
            F.when(pair(n), utf16(F.concat(code(n), code(n + 1))))
            .when((n > 2) & pair(n - 1), rest(n))
            .when(code(n).rlike("^d[89a-f]"), F.concat(F.lit("\ufffd"), rest(n)))
            .otherwise(F.concat(utf16(code(n)), rest(n)))
        )
        more = F.transform(F.sequence(F.lit(2), F.size(parts)), one)
        return F.when(F.size(parts) < 2, F.element_at(parts, 1)).otherwise(F.concat(F.element_at(parts, 1), F.array_join(more, "")))

    def wide(part: Column, n: Column) -> Column:
        digits = F.substring(part, 1, 8)
        none = digits.rlike("(?i)^0000d[89a-f]") | ~digits.rlike("(?i)^00(0[0-9a-f]|10)")
        char = F.when(none, F.lit("\ufffd")).otherwise(F.decode(F.unhex(digits), "UTF-32"))
        return F.when(n == 0, part).otherwise(F.concat(char, F.substring(part, 9, 1 << 30)))

    short = F.when(text.contains(r"\u"), let(F.split(text, r"\\u(?=[0-9A-Fa-f]{4})"), decode)).otherwise(text)
    return F.when(text.contains(r"\U"), F.array_join(F.transform(F.split(short, r"\\U(?=[0-9A-Fa-f]{8})"), wide), "")).otherwise(short)


def unescape(text: Column) -> Column:
    """The text that N-Triples wrote. Escaped back slashes part what is read by itself."""

    def read(piece: Column) -> Column:
        piece = _decode_units(piece)
        for raw, written in _ESCAPES:
            piece = F.replace(piece, F.lit(written), F.lit(raw))
        return piece

    return F.when(text.contains("\\"), F.array_join(F.transform(F.split(text, r"\\\\"), read), "\\")).otherwise(text)


def line(s: Column, p: Column, o: Column, o_is_iri: Column) -> Column:
    """One N-Triples statement."""
    term = F.when(o_is_iri, F.concat(F.lit("<"), o, F.lit(">"))).otherwise(F.concat(F.lit('"'), escape(o), F.lit('"')))
    return F.concat(F.lit("<"), s, F.lit("> <"), p, F.lit("> "), term, F.lit(" ."))


def _lines(triples: DataFrame) -> Column:
    return line(*[F.col(c) for c in TERMS])


def to_ntriples(triples: DataFrame) -> DataFrame:
    """Distinct statements as lines, for ``write.text``."""
    return triples.select(_lines(triples).alias("value")).distinct()


def from_ntriples(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Statements of N-Triples texts: the other columns of ``bodies`` with s_kind, s, p, o_kind, o and the line; a line that is no
    statement has a null p. Blank lines and comments are left out."""
    rest = [c for c in bodies.columns if c != body]
    lines = bodies.select(*rest, F.explode(F.split(body, "\n")).alias("line")).filter(r"line rlike '\\S' AND NOT line rlike '^\\s*#'")
    g = lambda n: F.regexp_extract("line", _LINE, n)
    good = F.col("line").rlike(_LINE)
    s_iri, o_iri, o_blank = g(1).startswith("<"), g(5).startswith("<"), g(5).startswith("_:")
    return lines.select(
        *rest,
        "line",
        F.when(good, F.when(s_iri, F.lit("iri")).otherwise(F.lit("blank"))).alias("s_kind"),
        F.when(good, F.when(s_iri, g(2)).otherwise(g(3))).alias("s"),
        F.when(good, g(4)).alias("p"),
        F.when(good, F.when(o_iri, F.lit("iri")).when(o_blank, F.lit("blank")).otherwise(F.lit("literal"))).alias("o_kind"),
        F.when(good, F.when(o_iri, g(6)).when(o_blank, g(7)).otherwise(unescape(g(8)))).alias("o"),
    )


def indexable(terms: DataFrame) -> DataFrame:
    """Triples of parsed statements, without blank nodes."""
    kept = terms.filter("p IS NOT NULL AND s_kind = 'iri' AND o_kind IN ('iri', 'literal')")
    return kept.withColumn("o_is_iri", F.col("o_kind") == "iri").drop("s_kind", "p_kind", "o_kind", "line")


def content_hashes(triples: DataFrame, most: int = TRIPLES_PER_DOC) -> DataFrame:
    """(doc_url, hash): sha-256 of a document's sorted distinct statements, each ended by a newline.

    A document of more than ``most`` statements, which is refused as too large before it could be stored, has a null hash: its lines are counted, not gathered.
    """
    lines = triples.select("doc_url", _lines(triples).alias("line")).distinct()
    over = lines.groupBy("doc_url").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("doc_url")
    body = F.concat(F.array_join(F.sort_array(F.collect_list("line")), "\n"), F.lit("\n"))
    hashed = lines.join(over, "doc_url", "left_anti").groupBy("doc_url").agg(F.sha2(body, 256).alias("hash"))
    return hashed.union(over.select("doc_url", F.lit(None).cast("string")))


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` (doc_url, hash) that are absent or different in ``old``; two null hashes are alike."""
    was = old.select(F.col("doc_url").alias("__url"), F.col("hash").alias("__hash"))
    return new.join(was, (F.col("doc_url") == F.col("__url")) & F.col("hash").eqNullSafe(F.col("__hash")), "left_anti")


def solid(triples: DataFrame) -> DataFrame:
    """(webid, is_solid): does a person's profile name an identity issuer?"""
    return triples.groupBy("webid").agg(F.bool_or(F.col("p") == _ISSUER).alias("is_solid"))


def pattern(triples: DataFrame, s=None, p=None, o=None, o_is_iri=None) -> DataFrame:
    """Triples that match the bound terms; None is a variable."""
    for name, value in (("s", s), ("p", p), ("o", o), ("o_is_iri", o_is_iri)):
        if value is not None:
            triples = triples.filter(F.col(name) == F.lit(value))
    return triples


#: Patterns without any bound term that are answered by one scan.
WHOLE_PER_SCAN = 1_000


def bulk_patterns(patterns: DataFrame, triples: DataFrame) -> DataFrame:
    """(pattern_id, s, p, o, o_is_iri) for many patterns (pattern_id, s, p, o) at once, null terms being variables; repeated patterns and triples count once.

    A pattern's shape is which terms it binds. A triple stands once for each shape that is asked, with the terms of the shape, and one equi-join finds the
    patterns of all shapes. Patterns without any bound term ask for the whole table and are put to each of its rows; their ids, and no
    others, come to the driver.
    """
    bits = [F.when(F.col(c).isNotNull(), 1 << n).otherwise(0) for n, c in enumerate("spo")]
    wanted = patterns.select("pattern_id", (bits[0] + bits[1] + bits[2]).alias("b_shape"), *[F.col(c).alias("b_" + c) for c in "spo"])
    shapes = sorted(r[0] for r in wanted.select("b_shape").distinct().collect())  # eight at most
    facts, kind = triples.select(*TERMS), patterns.schema["pattern_id"].dataType
    out = triples.sparkSession.createDataFrame([], facts.schema).select(F.lit(None).cast(kind).alias("pattern_id"), *TERMS)
    keyed = [s for s in shapes if s]
    if keyed:
        none = F.lit(None).cast("string")
        key = lambda shape: F.struct(F.lit(shape).alias("shape"), *[(F.col(c) if shape >> n & 1 else none).alias(c) for n, c in enumerate("spo")])
        each = facts.select(*TERMS, F.explode(F.array(*map(key, keyed))).alias("k"))
        on = F.col("k.shape") == F.col("b_shape")
        for c in "spo":
            on = on & F.col(f"k.{c}").eqNullSafe(F.col("b_" + c))
        out = out.union(each.join(wanted, on).select("pattern_id", *TERMS).distinct())
    if 0 in shapes:
        ids = [r[0] for r in wanted.filter("b_shape = 0").select("pattern_id").distinct().toLocalIterator()]
        whole = facts.distinct()
        for at in range(0, len(ids), WHOLE_PER_SCAN):
            some = F.array(*[F.lit(i).cast(kind) for i in ids[at : at + WHOLE_PER_SCAN]])
            out = out.union(whole.select(F.explode(some).alias("pattern_id"), *TERMS))
    return out


def page(triples: DataFrame, size: int, after: tuple | None = None) -> DataFrame:
    """First ``size`` + 1 distinct tuples in (s, p, o, o_is_iri) order after a cursor; the extra row tells that there is more."""
    rows = triples.select(*TERMS).distinct()
    if after:
        rows = rows.filter(F.struct(*TERMS) > F.struct(*[F.lit(x) for x in after]))
    return rows.orderBy(*TERMS).limit(size + 1)


def number_pages(rows: DataFrame, order: list[str], size: int, per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``rows``, no two alike in ``order``, with page_no from 0 and its place on the page, in the order of ``order``, in one job for all pages."""
    numbered = number_groups(rows, [], order, "__place", per_range)
    return numbered.select(
        *rows.columns,
        F.floor(F.col("__place") / size).cast("long").alias("page_no"),
        (F.col("__place") % size).cast("long").alias("place"),
    )


def replace(existing: DataFrame, new: DataFrame, touched: DataFrame, gate: DataFrame) -> DataFrame:
    """All triples after the people in ``touched`` (webid) have been projected anew: theirs in ``new``, none if gated."""
    kept = existing.join(touched.select("webid").distinct(), "webid", "left_anti")
    fresh = new.join(touched.select("webid").distinct(), "webid", "left_semi").join(gate.select("webid"), "webid", "left_anti")
    columns = [*TERMS, "webid", "doc_url"]
    return kept.select(*columns).unionByName(fresh.select(*columns))


def stale_projections(existing: DataFrame, resolved: DataFrame) -> DataFrame:
    """(webid, doc_url) of people still projected from a document that now resolves (doc_url, webid) to someone else."""
    now = resolved.select("doc_url", F.col("webid").alias("now_webid"))
    own = existing.select("webid", "doc_url").distinct()
    return own.join(now, "doc_url").filter("webid != now_webid").select("webid", "doc_url").distinct()


#: Values of one node object, about.
VALUES_PER_NODE = 10_000


def expanded_json(triples: DataFrame, most: int = VALUES_PER_NODE) -> DataFrame:
    """(s, value): one expanded JSON-LD node for each subject, objects sorted.

    A subject of more than ``most`` distinct values is several node objects of the same @id, which mean the same as one, so no list
    grows with a subject. A value's hash tells its node.
    """
    node = F.when(F.col("o_is_iri"), F.to_json(F.struct(F.col("o").alias("@id")))).otherwise(F.to_json(F.struct(F.col("o").alias("@value"))))
    values = triples.select("s", "p", node.alias("node")).distinct()
    large = values.groupBy("s").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("s", F.ceil(F.col("n") / most).alias("pieces"))
    piece = F.coalesce(F.pmod(F.xxhash64("p", "node"), F.col("pieces")), F.lit(0))
    dealt = values.join(large, "s", "left").select("s", piece.alias("piece"), "p", "node")
    by_p = dealt.groupBy("s", "piece", "p").agg(F.array_join(F.sort_array(F.collect_list("node")), ",").alias("nodes"))
    quoted = lambda x: F.to_json(F.array(x))
    name = F.regexp_extract(quoted(F.col("p")), r"^\[(.*)\]$", 1)
    member = F.concat(name, F.lit(":["), "nodes", F.lit("]"))
    by_s = by_p.groupBy("s", "piece").agg(F.array_join(F.sort_array(F.collect_list(member)), ",").alias("members"))
    own = F.regexp_extract(quoted(F.col("s")), r"^\[(.*)\]$", 1)
    return by_s.select("s", F.concat(F.lit('{"@id":'), own, F.lit(","), "members", F.lit("}")).alias("value"))

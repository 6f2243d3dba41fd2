"""Entries, lookups and result lists as bulk tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.functions.urls import canonical_webid, slug_valid
from weft.operators.gates import gate_object

_RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
FOAF, SOLID, PIM = "http://xmlns.com/foaf/0.1/", "http://www.w3.org/ns/solid/terms#", "http://www.w3.org/ns/pim/space#"
DCT, VOID, IDX = "http://purl.org/dc/terms/", "http://rdfs.org/ns/void#", "https://weft.example/ns#"
PROV, RDFS = "http://www.w3.org/ns/prov#", "http://www.w3.org/2000/01/rdf-schema#"
MOST_KNOWS = 500


def profile_rollup(triples: DataFrame, most: int = MOST_KNOWS) -> DataFrame:
    """(webid, name, photo, issuers, storages, knows) of each person; lists are sorted and distinct, knows has ``most`` at most.

    The first ``most`` people are chosen before they are gathered, in each task first, so no list of all that a person knows is made.
    """
    one = lambda p: F.min(F.when(F.col("p") == p, F.col("o")))
    many = lambda p: F.array_sort(F.collect_set(F.when((F.col("p") == p) & F.col("o_is_iri"), F.col("o"))))
    links = triples.filter((F.col("p") == FOAF + "knows") & F.col("o_is_iri")).select("webid", "o").distinct()
    first = links.withColumn("n", F.row_number().over(Window.partitionBy("webid").orderBy("o"))).filter(F.col("n") <= most)
    known = first.groupBy(F.col("webid").alias("__webid")).agg(F.array_sort(F.collect_list("o")).alias("__knows"))
    rest = triples.groupBy("webid").agg(
        one(FOAF + "name").alias("name"), one(FOAF + "img").alias("photo"), many(SOLID + "oidcIssuer").alias("issuers"), many(PIM + "storage").alias("storages")
    )
    joined = rest.join(known, F.col("webid").eqNullSafe(F.col("__webid")), "left")
    return joined.select(*rest.columns, F.coalesce("__knows", F.array().cast("array<string>")).alias("knows"))


def knows_visible(profiles: DataFrame, gate: DataFrame) -> DataFrame:
    """``profiles`` (webid, knows) without gated people in knows."""
    links = profiles.select("webid", F.explode("knows").alias("o"), F.lit(True).alias("o_is_iri"))
    kept = gate_object(links, gate).groupBy("webid").agg(F.array_sort(F.collect_list("o")).alias("kept"))
    empty = F.array().cast("array<string>")
    return profiles.join(kept, "webid", "left").withColumn("knows", F.coalesce("kept", empty)).drop("kept")


def entry_triples(people: DataFrame) -> DataFrame:
    """(s, p, o, kind) that describe each served person (webid, doc_url, slug, name, photo, issuers, storages, knows, freshness, modified).

    The entry describes the person's own WebID and makes no new name for them.
    """
    entry = F.concat(F.lit("urn:entry:"), "slug")

    def t(s: Column, p: str, o: Column, kind: str) -> Column:
        return F.when(o.isNotNull(), F.struct(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("kind")))

    me = F.col("webid")
    single = F.array(
        t(entry, _RDF + "type", F.lit(IDX + "Entry"), "iri"),
        t(entry, _RDF + "type", F.lit(FOAF + "PersonalProfileDocument"), "iri"),
        t(entry, FOAF + "primaryTopic", me, "iri"),
        t(entry, FOAF + "topic", me, "iri"),
        t(entry, DCT + "source", F.col("doc_url"), "iri"),
        t(entry, PROV + "wasDerivedFrom", F.col("doc_url"), "iri"),
        t(entry, DCT + "modified", F.col("modified"), "literal"),
        t(entry, PROV + "generatedAtTime", F.col("modified"), "literal"),
        t(entry, VOID + "inDataset", F.lit("urn:dataset"), "iri"),
        t(entry, IDX + "crawlState", F.concat(F.lit(IDX), "freshness"), "iri"),
        t(me, FOAF + "isPrimaryTopicOf", entry, "iri"),
        t(me, RDFS + "seeAlso", F.col("doc_url"), "iri"),
        t(me, FOAF + "name", F.col("name"), "literal"),
        t(me, FOAF + "img", F.col("photo"), "iri"),
    )
    issuers = F.transform("issuers", lambda x: t(me, SOLID + "oidcIssuer", x, "iri"))
    storages = F.transform("storages", lambda x: t(me, PIM + "storage", x, "iri"))
    knows = F.transform("knows", lambda x: t(me, FOAF + "knows", x, "iri"))
    return people.select(F.inline(F.array_compact(F.concat(single, issuers, storages, knows))))


def void_triples(stats: DataFrame) -> DataFrame:
    """(s, p, o) that describe the dataset from its counters (k, v); a partition's blank node is named after its IRI."""
    shown = stats.filter("v > 0")
    kind, iri = F.substring("k", 1, 2), F.substring("k", 3, 1 << 20)
    label = F.concat(F.lit("_:"), F.regexp_replace("k", "[^A-Za-z0-9]", "_"))
    row = lambda s, p, o: F.struct(s.alias("s"), F.lit(VOID + p).alias("p"), o.cast("string").alias("o"))
    whole = F.lit("urn:dataset")
    partition = lambda link, term, count: F.array(row(whole, link, label), row(label, term, iri), row(label, count, F.col("v")))
    rows = (
        F.when(F.col("k").isin("triples", "entities"), F.array(F.struct(whole.alias("s"), F.concat(F.lit(VOID), "k").alias("p"), F.col("v").cast("string").alias("o"))))
        .when(kind == "p:", partition("propertyPartition", "property", "triples"))
        .otherwise(partition("classPartition", "class", "entities"))
    )
    return shown.select(F.inline(rows))


def lookup_by_slug(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """``asked`` (slug) with status 200, 410 or 404 and the webid of a live entry; a malformed slug is 404 without a lookup."""
    good = asked.filter(slug_valid(F.col("slug")))
    found = good.join(docs.select("slug", "webid", "state"), "slug", "left")
    status = F.when(F.col("state").isNull(), 404).when(F.col("state") == "tombstone", 410).otherwise(200)
    answered = found.select("slug", status.alias("status"), F.when(status == 200, F.col("webid")).alias("webid"))
    bad = asked.filter(~slug_valid(F.col("slug"))).select("slug", F.lit(404).alias("status"), F.lit(None).cast("string").alias("webid"))
    return answered.union(bad)


def lookup_by_webid(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """``asked`` (id, url) with bad (no canonical key), indexed and slug."""
    keyed = asked.withColumn("webid", canonical_webid(F.col("url")))
    live = docs.filter("state != 'tombstone'").select("webid", "slug")
    found = keyed.join(live, "webid", "left")
    return found.select("id", F.col("webid").isNull().alias("bad"), F.col("slug").isNotNull().alias("indexed"), "slug")


def member_rows(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """(member, name, modified) of search hits (doc_url): the person, or the document where no person is known."""
    found = hits.join(docs.select("doc_url", "webid", "label", "modified"), "doc_url", "left")
    return found.select(F.coalesce("webid", "doc_url").alias("member"), F.col("label").alias("name"), "modified")


def inbox_members(page: DataFrame) -> DataFrame:
    """(iri, type, created) of notifications (id, type, at_ms)."""
    moment = F.timestamp_add("MILLISECOND", F.col("at_ms"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    created = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return page.select(F.concat(F.lit("urn:inbox:"), "id").alias("iri"), "type", created.alias("created"))


def collection_project(triples: DataFrame) -> DataFrame:
    """(member, name, photo, modified) of each member in the triples of a result list; photos only over https."""
    one = lambda p: F.min(F.when(F.col("p") == p, F.col("o")))
    photo = F.min(F.when((F.col("p") == FOAF + "img") & F.col("o").startswith("https://"), F.col("o")))
    return triples.groupBy(F.col("s").alias("member")).agg(one(FOAF + "name").alias("name"), photo.alias("photo"), one(DCT + "modified").alias("modified"))

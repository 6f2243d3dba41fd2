"""The rules as SQL functions of a session."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from weft.functions import crawl, sql, urls


def test_text_of_a_rule_is_parsed_again(spark):
    """Signs, quotes, line ends, parentheses inside literals, nested lambdas and structs."""
    values = ["it's +(a", "b\\c\n(d)", 'e"f`g(', "", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    inner = lambda x: F.aggregate(F.split(x, r"[(+]"), F.lit(0), lambda a, p: a + F.length(p))
    rules = [
        F.when(F.col("v").isin("it's +(a", 'e"f`g('), F.concat(F.lit("+('\\\n`"), "v")).otherwise(F.lit(None)),
        F.transform(F.array("v", F.lit("x(y")), inner),
        F.struct(F.length("v").try_cast("long").alias("n"), (F.length("v") % 2 == 0).alias("even"))["n"],
        ~F.col("v").eqNullSafe(F.lit("")) & (F.col("v").rlike(r"^\w") | F.col("v").isNull()),
    ]
    for rule in rules:
        assert [r[0] for r in df.select(rule).collect()] == [r[0] for r in df.selectExpr(sql.sql_text(rule)).collect()]


def test_every_rule_is_a_function(spark):
    names = sql.register(spark)
    assert len(names) == len(sql.RULES)
    assert {"weft_" + n for n in sql.RULES} <= {f.name.split(".")[-1] for f in spark.catalog.listFunctions()}
    now = int(datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp() * 1000)
    row = spark.sql(f"""SELECT weft_retry_after_ms('120', {now}) AS asked, weft_retry_after_ms('Mon, 01 Jan 2024 00:01:00 GMT', {now}) AS at, weft_backoff(3, NULL).delay AS delay,
      weft_fetch_outcome(410, NULL, false, true).next_state AS gone, weft_query_tokens('Ada, LOVELACE!') AS terms, weft_day_key({now}) AS day, weft_host_denied('a.localhost') AS denied,
      weft_freshness('done', 1, {now}) AS freshness, weft_canonical_webid(NULL) AS none, weft_next_eligible('done', true, 0) AS due""").first()
    assert row.asDict() == {
        "asked": 120_000, "at": 60_000, "delay": 240_000, "gone": "tombstone", "terms": ["ada", "lovelace"], "day": "2024-01-01",
        "denied": True, "freshness": "Stale", "none": None, "due": 14 * 86_400_000,
    }


def test_functions_are_the_columns(spark):
    sql.register(spark, ["canonical_doc_url", "ip_normalise", "admission_reason", "noindex_header"])
    values = ["https://A.example:443/b/../c/?d=e f", "https://0x7f.1/", "https://[2001:DB8::0:1]/", "\\\\x", "https://ä.example/ü", "noindex, x", "", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    pairs = {"canonical_doc_url": urls.canonical_doc_url, "ip_normalise": urls.ip_normalise, "admission_reason": urls.admission_reason, "noindex_header": crawl.noindex_header}
    for name, rule in pairs.items():
        assert [r[0] for r in df.select(rule(F.col("v"))).collect()] == [r[0] for r in df.selectExpr(f"weft_{name}(v)").collect()], name
    assert "PythonUDF" not in df.selectExpr("weft_canonical_doc_url(v)")._jdf.queryExecution().toString()

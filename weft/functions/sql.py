"""The rules of keys, admission, crawl and serving as SQL functions of a session.

Each function is a temporary SQL function whose body is the text of the Column rule itself, so SQL and DataFrame users run the same expression and Catalyst sees
through both: no UDF is made. Names begin with ``weft_``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from weft.functions import crawl, urls

#: name: (arguments as DDL, rule).
RULES = {
    "canonical_doc_url": ("url string", urls.canonical_doc_url),
    "canonical_webid": ("url string", urls.canonical_webid),
    "host_of": ("url string", urls.host_of),
    "slug": ("webid string", urls.slug),
    "slug_valid": ("value string", urls.slug_valid),
    "ip_normalise": ("host string", urls.ip_normalise),
    "ip_public": ("host string", urls.ip_public),
    "ip_loopback": ("host string", urls.ip_loopback),
    "host_denied": ("host string", urls.host_denied),
    "admission_reason": ("url string", urls.admission_reason),
    "query_tokens": ("text string", crawl.query_tokens),
    "noindex_header": ("header string", crawl.noindex_header),
    "content_type_ok": ("content_type string, status int, noindex boolean", crawl.content_type_ok),
    "fetch_outcome": ("status int, error_kind string, noindex boolean, type_ok boolean", crawl.fetch_outcome),
    "retry_after_ms": ("header string, now bigint", crawl.retry_after_ms),
    "backoff": ("attempts int, asked bigint", crawl.backoff),
    "next_eligible": ("state string, is_solid boolean, now bigint", crawl.next_eligible),
    "freshness": ("state string, next_eligible_at bigint, now bigint", crawl.freshness),
    "https_photo": ("url string", crawl.https_photo),
    "object_kind": ("o string", crawl.object_kind),
    "day_key": ("at_ms bigint", crawl.day_key),
    "error_truncate": ("message string", crawl.error_truncate),
    "suggest_outcome": ("status int", crawl.suggest_outcome),
}
PREFIX = "weft_"

#: A unit of time, a literal, which stays as it is, or a name or sign before a parenthesis.
_CALL = re.compile(r"(?P<unit>timestamp(?:diff|add)\()'(?P<name>\w+)'|'(?:[^'\\]|\\.)*'|(?P<call>[A-Za-z_]\w*|[^\w\s'\"(),\[\]`]+)\(", re.S)
#: Words with a syntax of their own; all others are names of functions, and are quoted, as `+` and `in` are no names otherwise.
_SYNTAX = {"CAST", "TRY_CAST", "STRUCT"}


def sql_text(rule: Column) -> str:
    """A Column rule as SQL that Spark can parse."""

    def quote(m: re.Match) -> str:
        if m["unit"]:
            return m["unit"] + m["name"]
        return m[0] if not m["call"] or m["call"].upper() in _SYNTAX else f"`{m['call']}`("

    return _CALL.sub(quote, rule._jc.node().sql())


def register(spark: SparkSession, names: Iterable[str] = RULES, prefix: str = PREFIX) -> list[str]:
    """Make the RULES of ``names``, or all, functions of the session, in place of functions of the same names, and give the functions' names."""
    for name in names:
        arguments, rule = RULES[name]
        columns = [a.split()[0] for a in arguments.split(", ")]
        body = rule(*map(F.col, columns))
        kind = spark.createDataFrame([], arguments).select(body.alias("x")).schema["x"].dataType.simpleString()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({arguments}) RETURNS {kind} RETURN {sql_text(body)}")
    return [prefix + name for name in names]

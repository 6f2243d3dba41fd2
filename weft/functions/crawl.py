"""Scalar rules of crawling, serving and search as Column expressions. Times are epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000
#: Intervals and limits of the crawl.
LEASE, HOST_DELAY, MAX_ATTEMPTS = 360_000, 1_000, 5
BACKOFF_BASE, BACKOFF_MAX, FAILED_COOLDOWN = 60_000, 21_600_000, DAY
RECRAWL_SOLID, RECRAWL_OTHER, NEVER = 14 * DAY, 30 * DAY, 365 * DAY
#: For a completion that names no next time.
RECRAWL_DEFAULT = 14 * DAY
PROFILE_BYTES, INBOX_BYTES, TRIPLES_PER_DOC = 256 * 1024, 64 * 1024, 50_000
MAX_TOKENS, MAX_TOKEN_LENGTH = 8, 32
#: Robots directives that allow indexing, and media types of documents.
SAFE_ROBOTS = ["index", "follow", "all", "nofollow", "noarchive", "nosnippet", "noimageindex", "notranslate", "indexifembedded"]
RDF_TYPES = [
    "text/turtle",
    "application/ld+json",
    "application/json",
    "application/n-triples",
    "application/n-quads",
    "application/trig",
    "text/n3",
    "application/rdf+xml",
]
#: Kinds of fetch errors that another attempt would not mend; a refused media type is one of them.
LASTING_ERRORS = ["address", "scheme", "port", "userinfo", "denied", "malformed", "redirect", "content-type", "too-large"]
ENDED = ["done", "failed", "skipped", "blocked", "tombstone"]
#: The longest delay that a header can ask for: a hundred years, so that sums of times stay in range.
LONGEST_DELAY = 100 * 365 * DAY
STATES = ["pending", "claimed", "done", "failed", "tombstone", "skipped", "blocked"]
FAIL_CLASSES = ["deterministic", "transient"]
REASONS = ["opt-out", "erasure", "abuse", "noindex"]
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def query_tokens(text: Column) -> Column:
    """Search terms of a text: at most 8 lower-case [a-z0-9] words of at most 32 characters; null if none."""
    kept = F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " ")
    words = F.filter(F.split(kept, r"\s+"), lambda w: w != "")
    few = F.slice(F.transform(words, lambda w: F.substring(w, 1, MAX_TOKEN_LENGTH)), 1, MAX_TOKENS)
    return F.when(F.size(few) > 0, few)


def noindex_header(header: Column) -> Column:
    """Does a robots header forbid indexing? Absent: no; empty, explicit or unknown directives: yes."""
    words = F.transform(F.split(F.lower(header), ","), lambda d: F.trim(F.element_at(F.split(d, ":"), -1)))
    words = F.filter(words, lambda d: d != "")
    return F.when(header.isNull(), F.lit(False)).otherwise((F.size(words) == 0) | F.exists(words, lambda d: ~d.isin(SAFE_ROBOTS)))


def media_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))


def content_type_ok(content_type: Column, status: Column, noindex: Column) -> Column:
    """Is a response's media type accepted? Not asked of noindex responses and of those without a document body."""
    skipped = noindex | status.isin(204, 205, 304) | (status >= 400)
    return F.when(skipped, F.lit(True)).otherwise(F.coalesce(media_type(content_type).isin(RDF_TYPES), F.lit(False)))


def fetch_outcome(status: Column, error_kind: Column, noindex: Column, type_ok: Column) -> Column:
    """Struct (next_state, fail_class) of a fetch: tombstone, done, parse, pending or skipped.

    Errors that will last skip a document; all others, known or not, are tried again. Responses without a document body
    cannot forbid indexing.
    """
    of = lambda state, cls=None: F.struct(F.lit(state).alias("next_state"), F.lit(cls).cast("string").alias("fail_class"))
    return (
        F.when(error_kind.isin(LASTING_ERRORS), of("skipped", "deterministic"))
        .when(error_kind.isNotNull(), of("pending", "transient"))
        .when(noindex & status.between(200, 299) & ~status.isin(204, 205), of("tombstone"))
        .when(~type_ok, of("skipped", "deterministic"))
        .when(status == 304, of("done"))
        .when(status.between(200, 299), of("parse"))
        .when(status == 410, of("tombstone"))
        .when((status >= 500) | (status == 429), of("pending", "transient"))
        .otherwise(of("skipped", "deterministic"))
    )


def retry_after_ms(header: Column, now: Column) -> Column:
    """Delay that a Retry-After header asks for: seconds or an HTTP date; null if neither, never negative, a hundred years at most."""
    number = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
    seconds = F.when(F.trim(header).rlike(number), F.least(F.trim(header).try_cast("double") * 1000, F.lit(float(LONGEST_DELAY))))
    stamp = F.try_to_timestamp(F.substring(header, 6, 20), F.lit("dd MMM yyyy HH:mm:ss"))
    zone = F.to_timestamp_ntz(F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"))
    date = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), zone)
    asked = F.coalesce(F.when(seconds < 0, F.lit(0.0)).otherwise(seconds).cast("long"), F.when(header.rlike("GMT$"), date - now))
    return F.when(asked < 0, F.lit(0).cast("long")).when(asked > LONGEST_DELAY, F.lit(LONGEST_DELAY)).otherwise(asked)


def backoff(attempts: Column, retry_after: Column) -> Column:
    """Struct (state, delay) after a transient failure: exponential or as asked; failed for a day after the last attempt."""
    exponential = F.least(F.lit(BACKOFF_BASE) * F.pow(F.lit(2), F.greatest(attempts - 1, F.lit(0))), F.lit(BACKOFF_MAX)).cast("long")
    delay = F.when(retry_after > 0, retry_after).otherwise(exponential)
    spent = attempts >= MAX_ATTEMPTS
    return F.struct(
        F.when(spent, F.lit("failed")).otherwise(F.lit("pending")).alias("state"),
        F.when(spent, F.lit(FAILED_COOLDOWN)).otherwise(delay).cast("long").alias("delay"),
    )


def next_eligible(state: Column, is_solid: Column, now: Column) -> Column:
    """Next crawl time after success or a permanent end; null for states that back off."""
    again = F.when(is_solid, F.lit(RECRAWL_SOLID)).otherwise(F.lit(RECRAWL_OTHER))
    return F.when(state.isin("done", "parse"), now + again).when(state.isin("tombstone", "skipped"), now + F.lit(NEVER))


def freshness(state: Column, next_eligible_at: Column, now: Column) -> Column:
    """How current an entry is: Live, Stale (done, and due again) or Unreachable."""
    due = (next_eligible_at > 0) & (next_eligible_at <= now)
    return F.when(state != "done", F.lit("Unreachable")).when(due, F.lit("Stale")).otherwise(F.lit("Live"))


def https_photo(url: Column) -> Column:
    return F.when(F.lower(url).rlike("^https://"), url)


def object_kind(term: Column) -> Column:
    return F.when(term.rlike("^(https?|urn):"), F.lit("iri")).otherwise(F.lit("literal"))


def etag(body: Column, media: Column, profile: Column) -> Column:
    mixed = F.concat(body, F.lit("\0"), media, F.lit("\0"), F.coalesce(profile, F.lit("")))
    return F.concat(F.lit("sha256-"), F.substring(F.sha2(mixed, 256), 1, 16))


def notification_id(at: Column, payload: Column) -> Column:
    """26 characters that sort by time: 48 bits of milliseconds, then 80 of the payload's digest, so a replay has the same id."""
    symbol = lambda bits: F.substring(F.lit(CROCKFORD), bits.cast("int") + 1, F.lit(1))
    time = [symbol(F.shiftright(at, 5 * n).bitwiseAND(31)) for n in range(9, -1, -1)]
    digest = F.sha2(payload, 256)
    rest = []
    for group in range(4):
        bits = F.conv(F.substring(digest, group * 5 + 1, 5), 16, 10).cast("long")
        rest += [symbol(F.shiftright(bits, 15 - 5 * n).bitwiseAND(31)) for n in range(4)]
    return F.concat(*time, *rest)


def notification_key(given: Column, at: Column, payload: Column) -> Column:
    """The id that a client gives where it is one, and otherwise :func:`notification_id`."""
    return F.when(F.coalesce(notification_id_valid(given), F.lit(False)), given).otherwise(notification_id(at, payload))


def size_verdict(size: Column, most: int = PROFILE_BYTES, triples: Column | None = None, most_triples: int = TRIPLES_PER_DOC) -> Column:
    """Why a document of ``size`` bytes is refused: too-large or too-many-triples; null if it is not."""
    over = F.when(size > most, F.lit("too-large"))
    return over.when(triples > most_triples, F.lit("too-many-triples")) if triples is not None else over


def notification_id_valid(value: Column) -> Column:
    return value.rlike("^[0-9A-HJKMNP-TV-Z]{26}$")


def day_key(at: Column) -> Column:
    """UTC day of epoch milliseconds, whatever the session's zone."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(at / DAY).cast("int")), "yyyy-MM-dd")


def error_truncate(message: Column, most: int = 500) -> Column:
    return F.when(F.length(message) > most, F.concat(F.substring(message, 1, most), F.lit("…"))).otherwise(message)


def suggest_outcome(status: Column) -> Column:
    """What a client is told for an intake status code."""
    return (
        F.when(status.isin(201, 202), F.lit("submitted"))
        .when(status.isin(200, 409), F.lit("already-indexed"))
        .when(status == 429, F.lit("rate-limited"))
        .when(status.isin(400, 413, 415, 422), F.lit("invalid"))
        .otherwise(F.lit("error"))
    )

"""Canonical keys of documents and people, and admission of candidate urls, as Column expressions.

Urls are read as browsers read them: back slashes, dot segments, percent signs, numeric and international hosts have one form. Only
https urls have canonical keys; what cannot be one gives null instead of an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*):/*([^/?#]*)([^?#]*)([?][^#]*)?(#.*)?$"
#: Characters that are written as percent signs in a path, a query and a fragment.
_IN_PATH, _IN_QUERY, _IN_FRAGMENT = r"[^!#-;=?-_a-z|~]|[?#]", r"[^!$-&(-;=?-~]", r"[^!#-;=?-_a-~]"
_HOST = r"^[a-z0-9!\"$&'()*+,;=_`{}~.-]+$|^\[[0-9a-f:.]+\]$"
_BASE32 = "abcdefghijklmnopqrstuvwxyz234567"
#: Host names and suffixes that are never fetched.
DENIED_HOSTS = [
    "metadata.google.internal",
    "metadata.goog",
    ".internal",
    ".svc.cluster.local",
    ".cluster.local",
    ".vercel-internal.com",
    "localhost",
    ".localhost",
    ".local",
]


#: Hosts that end in a number are addresses or nothing.
_NUMERIC = r"(^|\.)(0x[0-9a-f]*|[0-9]+)\.?$"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _clean(url: Column) -> Column:
    """A url without blanks around it, tabs and line ends, and with slashes for back slashes before the query."""
    text = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
    parts = lambda t: let(F.regexp_extract(t, r"^([^?#]*)", 1), lambda head: F.concat(F.replace(head, F.lit("\\"), F.lit("/")), F.substring(t, F.length(head) + 1, F.length(t))))
    return F.when(url.rlike(r"^[\x00-\x20]|[\x00-\x20]$|[\t\n\r\\]"), let(text, parts)).otherwise(url)


_PARTS = ["scheme", "authority", "path", "query", "fragment"]


def _with_parts(url: Column, use) -> Column:
    """``use(parts)`` with the parts of a url as a struct, found once."""
    return let(_clean(url), lambda t: let(F.struct(*[F.regexp_extract(t, _URL, n + 1).alias(p) for n, p in enumerate(_PARTS)], t.alias("text")), use))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(_clean(url), _URL, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(_clean(url), _URL, 2)


def _userinfo(authority_: Column) -> Column:
    return F.regexp_extract(authority_, "^(.*)@", 1)


def _host(authority_: Column) -> Column:
    raw = F.regexp_extract(authority_, r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1)

    def normal(host: Column) -> Column:
        plain = F.when(host.contains("%"), F.coalesce(F.try_url_decode(F.replace(host, F.lit("+"), F.lit("%2B"))), host)).otherwise(host)
        # Only the JVM's own library knows how international names are written.
        ascii_ = lambda x: F.when(x.rlike(r"[^\x00-\x7F]"), F.coalesce(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), x), x)).otherwise(x)
        return let(F.lower(let(plain, ascii_)), lambda h: F.when(h.rlike(_NUMERIC), ip_normalise(h)).otherwise(h))

    return F.when(raw.rlike("^[a-z.-]*$"), raw).otherwise(let(raw, normal))


def ipv6_text(hextets: Column) -> Column:
    """The one short form of an address: numbers without leading zeros, and the first of its longest runs of zeros, if of two or more, as two colons."""

    def short(full: Column) -> Column:
        out = full
        for n in range(2, 9):
            run = rf"^(.*?)(?:^|:)0(?::0){{{n - 1}}}(?::|$)(.*)$"
            out = F.when(full.rlike(run), F.regexp_replace(full, run, "$1::$2")).otherwise(out)
        return out

    return let(F.array_join(F.transform(hextets, lambda h: F.lower(F.hex(h))), ":"), short)


def _one_form(host: Column) -> Column:
    """A host with an IPv6 address in its one form; a host in brackets that is no address, and any sign that no host has, give null."""
    address = let(ipv6_hextets(F.regexp_replace(host, r"^\[|\]$", "")), lambda h: F.when(h.isNotNull(), F.concat(F.lit("["), ipv6_text(h), F.lit("]"))))
    return F.when(host.startswith("["), address).when(host.rlike(_HOST) & ~(host.rlike(_NUMERIC) & ~is_ipv4(host)), host)


def _port_good(authority_: Column) -> Column:
    """Is what follows the host nothing, or a colon and a number that a port can have, if any?"""
    rest = F.regexp_extract(authority_, r"^(?:.*@)?(?:\[[^\]]*\]|[^:]*)(.*)$", 1)
    return rest.rlike("^(:[0-9]*)?$") & F.coalesce(_port(authority_).try_cast("int") < 65536, _port(authority_) == "")


def _port(authority_: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(authority_, r":([0-9]*)$", 1), "^0+(?=[0-9])", "")


def hostname(url: Column) -> Column:
    """Host without userinfo and port, in lower case and ASCII, an IPv4 address as a dotted quad; empty where there is none."""
    return let(authority(url), _host)


def port(url: Column) -> Column:
    return _port(authority(url))


def _percent(text: Column, signs: str) -> Column:
    """``text`` with the characters of class ``signs`` as percent signs of their bytes."""
    one = lambda c: F.when(c.rlike(signs), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c)
    return F.when(text.rlike(signs), F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), 0), one), "")).otherwise(text)


def _without_dots(path: Column) -> Column:
    """A path with its segments `.` and `..` followed."""
    one, two = r"(?i)^(\.|%2e)$", r"(?i)^(\.|%2e){2}$"
    up = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
    step = lambda done, s: F.when(s.rlike(two), up(done)).when(s.rlike(one), done).otherwise(F.concat(done, F.array(s)))

    def follow(segments: Column) -> Column:
        last = F.element_at(segments, -1)
        done = F.aggregate(F.slice(segments, 2, F.greatest(F.size(segments) - 2, F.lit(0))), F.array().cast("array<string>"), step)
        ended = let(done, lambda d: F.when(last.rlike(one) | last.rlike(two), F.concat(step(d, last), F.array(F.lit("")))).otherwise(step(d, last)))
        return F.concat(F.lit("/"), F.array_join(ended, "/"))

    return F.when(path.rlike(r"(?i)/(\.|%2e){1,2}(/|$)"), let(F.split(path, "/"), follow)).otherwise(path)


def _canonical(url: Column, fragment: bool) -> Column:
    encoded = lambda part, signs: F.concat(F.substring(part, 1, 1), _percent(F.substring(part, 2, 1 << 30), signs))
    slash = lambda p: F.when(p == "", F.lit("/")).when((F.length(p) > 1) & p.endswith("/"), F.substring(p, F.lit(1), F.length(p) - 1)).otherwise(p)

    def key(parts: Column) -> Column:
        path = let(let(_percent(parts["path"], _IN_PATH), _without_dots), slash)
        tail = F.concat(encoded(parts["query"], _IN_QUERY), encoded(parts["fragment"], _IN_FRAGMENT)) if fragment else encoded(parts["query"], _IN_QUERY)
        named = F.struct(_host(parts["authority"]).alias("host"), _port(parts["authority"]).alias("port"))

        def put(at: Column) -> Column:
            host, port_ = at["host"], at["port"]
            good = _userinfo(parts["authority"]).isin("", ":") & _port_good(parts["authority"])
            keep = F.when(port_.isin("", "443"), F.lit("")).otherwise(F.concat(F.lit(":"), port_))
            return F.when(good, F.concat(F.lit("https://"), _one_form(host), keep, path, tail))

        return F.when(F.lower(parts["scheme"]) == "https", let(named, put))

    return _with_parts(url, key)


#: Urls that are canonical but for an empty path or one slash too many: most of them, and cheap to tell.
_SIGNS = r"\w~!$&()*+,;=:@."
_PLAIN = (
    r"^https://(?:[a-z0-9-]+\.)*[a-z][a-z0-9-]*(?:/(?!\.{1,2}(?:[/?#]|$))[" + _SIGNS + r"-]*)*"
    r"(?:\?[" + _SIGNS + r"/?-]*)?(?:#[" + _SIGNS + r"/?-]*)?$"
)


def _quick(url: Column, fragment: bool) -> Column:
    """The key of a url that is _PLAIN."""
    whole = F.regexp_replace(F.regexp_extract(url, "^([^#]*)", 1), r"^(https://[^/?]*)(?=\?|$)", "$1/")
    key = F.regexp_replace(whole, r"^(https://[^/?]+/[^?]*)/(?=\?|$)", "$1")
    return F.concat(key, F.regexp_extract(url, "(#.*)$", 1)) if fragment else key


def canonical_doc_url(url: Column) -> Column:
    """Document key: https only, no userinfo, one form of host and path, no port 443, one trailing slash less, no fragment; else null."""
    return F.when(url.rlike(_PLAIN), _quick(url, False)).otherwise(_canonical(url, False))


def canonical_webid(url: Column) -> Column:
    """Person key: as the document key, with the fragment."""
    return F.when(url.rlike(_PLAIN), _quick(url, True)).otherwise(_canonical(url, True))


def host_of(url: Column) -> Column:
    """Host of a url, or the raw string where it has none."""
    return let(hostname(url), lambda h: F.when(h == "", url).otherwise(h))


def slug(webid: Column) -> Column:
    """First 24 characters of the lower-case base32 of the sha-256 of a key."""
    digest = F.sha2(webid, 256)
    letters = []
    for group in range(6):
        bits = F.conv(F.substring(digest, group * 5 + 1, 5), 16, 10).cast("long")
        for n in range(4):
            letters.append(F.substring(F.lit(_BASE32), F.shiftright(bits, 15 - 5 * n).bitwiseAND(31).cast("int") + 1, F.lit(1)))
    return F.when(webid.isNotNull(), F.concat(*letters))


def slug_valid(value: Column) -> Column:
    return value.rlike("^[a-z2-7]{24}$")


def ip_normalise(host: Column) -> Column:
    """Dotted quad of an IPv4 literal in any of its forms (one to four parts, each decimal, octal or hex); other hosts as they are, lower-cased."""
    # No part of an address has more digits; a longer number is a name that no address has.
    number = lambda p: (
        F.when(p.rlike("^0x0*[0-9a-f]{1,8}$"), F.conv(F.regexp_replace(p, "^0x0*(?=[0-9a-f])", ""), 16, 10))
        .when(p == "0x", F.lit("0"))
        .when(p.rlike("^0+[0-7]{0,11}$"), F.conv(F.regexp_replace(p, "^0+(?=[0-7])", ""), 8, 10))
        .when(p.rlike("^[1-9][0-9]{0,10}$"), p)
        .try_cast("long")
    )
    rooms = F.lit([1 << 32, 1 << 24, 1 << 16, 1 << 8])

    def quad(values: Column) -> Column:
        n = F.size(values)
        leading, last, room = F.slice(values, 1, n - 1), F.element_at(values, -1), F.element_at(rooms, F.least(n, F.lit(4)))
        valid = (n <= 4) & F.forall(values, lambda v: v.isNotNull()) & F.forall(leading, lambda v: v < 256) & (last < room)
        whole = F.aggregate(leading, F.lit(0).cast("long"), lambda acc, v: acc * 256 + v) * room + last
        parts = lambda number_: F.transform(F.lit([24, 16, 8, 0]), lambda by: (F.floor(number_ / F.pow(F.lit(2), by)) % 256).cast("long").cast("string"))
        return F.when(valid, F.array_join(let(whole, parts), "."))

    parts = F.split(F.regexp_replace(F.lower(host), r"\.$", ""), r"\.")
    # Most hosts do not end in a number, which is cheap to tell.
    return F.when(F.lower(host).rlike(_NUMERIC), F.coalesce(let(F.transform(parts, number), quad), F.lower(host))).otherwise(F.lower(host))


def is_ipv4(host: Column) -> Column:
    return host.rlike(r"^((25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\.|$)){4}$") & ~host.endswith(".")


def _public_octets(o: Column) -> Column:
    a, b, c = (F.element_at(o, n) for n in (1, 2, 3))
    special = (
        a.isin(0, 10, 127)
        | (a >= 224)
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168))
        | ((a == 169) & (b == 254))
        | ((a == 100) & b.between(64, 127))
        | ((a == 192) & (b == 0) & (c == 2))
        | ((a == 198) & b.isin(18, 19))
        | ((a == 198) & (b == 51) & (c == 100))
        | ((a == 203) & (b == 0) & (c == 113))
    )
    return ~special


def ipv4_public(host: Column) -> Column:
    """Is a dotted quad outside all private, shared, link-local, multicast, test and reserved ranges? False for anything else."""
    octets = F.transform(F.split(host, r"\."), lambda p: p.try_cast("int"))
    return F.coalesce(F.when(is_ipv4(host), let(octets, _public_octets)), F.lit(False))


def ipv6_hextets(address: Column) -> Column:
    """The eight 16-bit numbers of an IPv6 literal, a dotted tail included; null for what is none."""
    text = F.lower(address)
    quad = r"^(.*:)([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$"

    def pair(octets: Column) -> Column:
        word = lambda n: F.lower(F.hex(F.element_at(octets, n) * 256 + F.element_at(octets, n + 1)))
        return F.concat_ws(":", word(1), word(3))

    tail = let(F.transform(F.split(F.regexp_extract(text, quad, 2), r"\."), lambda p: p.try_cast("int")), pair)
    plain = F.when(text.rlike(quad), F.concat(F.regexp_extract(text, quad, 1), tail)).otherwise(text)

    def words(half: Column) -> Column:
        return F.filter(F.split(F.coalesce(half, F.lit("")), ":"), lambda x: x != "")

    def fill(halves: Column) -> Column:
        def join(sides: Column) -> Column:
            left, right = F.element_at(sides, 1), F.element_at(sides, 2)
            gap = 8 - F.size(left) - F.size(right)
            return F.when(F.size(halves) == 1, left).when(gap >= 1, F.concat(left, F.array_repeat(F.lit("0"), gap), right))

        sides = F.array(words(F.element_at(halves, 1)), words(F.try_element_at(halves, F.lit(2))))
        return F.when(F.size(halves) <= 2, let(sides, join))

    number = lambda h: F.when(h.rlike("^[0-9a-f]{1,4}$"), F.conv(h, 16, 10).cast("int"))
    numbers = F.transform(let(F.split(plain, "::"), fill), number)
    whole = lambda h: F.when((F.size(h) == 8) & F.forall(h, lambda x: x.isNotNull()), h)
    return F.when(address.contains(":"), let(numbers, whole))


def _embedded(h: Column, at: int) -> Column:
    """Octets of the IPv4 address in two hextets."""
    high, low = F.element_at(h, at), F.element_at(h, at + 1)
    return F.array(F.shiftright(high, 8), high.bitwiseAND(255), F.shiftright(low, 8), low.bitwiseAND(255))


def ipv6_public(address: Column) -> Column:
    """Is an IPv6 literal public? Mapped, 6to4 and NAT64 forms follow the IPv4 address inside; false for all others that begin with
    sixteen zero bits, such as the loopback and IPv4-compatible forms, and for anything else."""

    def judge(h: Column) -> Column:
        zeros = lambda a, b: F.forall(F.slice(h, a, b - a + 1), lambda x: x == 0)
        first, second, sixth = (F.element_at(h, n) for n in (1, 2, 6))
        return (
            F.when(h.isNull(), F.lit(False))
            .when(zeros(1, 5) & (sixth == 0xFFFF), _public_octets(_embedded(h, 7)))
            .when(first == 0, F.lit(False))
            .when(first.bitwiseAND(0xFFC0) == 0xFE80, F.lit(False))
            .when(first.bitwiseAND(0xFE00) == 0xFC00, F.lit(False))
            .when(first.bitwiseAND(0xFF00) == 0xFF00, F.lit(False))
            .when(first == 0x2002, _public_octets(_embedded(h, 2)))
            .when((first == 0x64) & (second == 0xFF9B) & zeros(3, 6), _public_octets(_embedded(h, 7)))
            .otherwise(F.lit(True))
        )

    return F.coalesce(let(ipv6_hextets(address), judge), F.lit(False))


def ip_public(host: Column) -> Column:
    return F.when(is_ipv4(host), ipv4_public(host)).otherwise(ipv6_public(host))


def ip_loopback(host: Column) -> Column:
    """Is a literal the machine itself: 127.0.0.0/8, ::1, or the former mapped into IPv6?"""

    def judge(h: Column) -> Column:
        zeros = lambda n: F.forall(F.slice(h, 1, n), lambda x: x == 0)
        mapped = zeros(5) & (F.element_at(h, 6) == 0xFFFF) & (F.shiftright(F.element_at(h, 7), 8) == 127)
        return mapped | zeros(7) & (F.element_at(h, 8) == 1)

    return F.coalesce(is_ipv4(host) & host.startswith("127."), F.lit(False)) | F.coalesce(let(ipv6_hextets(host), judge), F.lit(False))


def host_denied(host: Column, denied: list[str] = DENIED_HOSTS) -> Column:
    """Is a host equal to a denied name, or below one? A leading dot in the list means the same."""
    out = F.lit(False)
    for name in denied:
        bare = name.lstrip(".")
        out = out | (F.lower(host) == bare) | F.lower(host).endswith("." + bare)
    return out


def admission_reason(url: Column, denied: list[str] = DENIED_HOSTS) -> Column:
    """Why a candidate url is refused: parse, scheme, userinfo, port, denied or address; null if admitted."""

    def by_host(names: Column) -> Column:
        host, norm = names["host"], names["norm"]
        literal = is_ipv4(norm) | norm.contains(":")
        return F.when(host_denied(host, denied) | host_denied(norm, denied), F.lit("denied")).when(literal & ~ip_public(norm), F.lit("address"))

    def judge(parts: Column) -> Column:
        def of(host: Column) -> Column:
            named = F.struct(host.alias("host"), F.regexp_replace(host, r"^\[|\]$", "").alias("bare"), F.lower(parts["scheme"]).alias("scheme"))
            return let(named, by_parts)

        def by_parts(at: Column) -> Column:
            broken = _one_form(at["host"]).isNull() | ~_port_good(parts["authority"])
            return (
                F.when((at["bare"] == "") | at["scheme"].isin("https", "http") & broken, F.lit("parse"))
                .when(at["scheme"] != "https", F.lit("scheme"))
                .when(~_userinfo(parts["authority"]).isin("", ":"), F.lit("userinfo"))
                .when(~_port(parts["authority"]).isin("", "443"), F.lit("port"))
                .otherwise(let(F.struct(at["bare"].alias("host"), ip_normalise(at["bare"]).alias("norm")), by_host))
            )

        return F.when(~parts["text"].rlike(_URL), F.lit("parse")).otherwise(let(_host(parts["authority"]), of))

    return F.when(url.isNull(), F.lit("parse")).otherwise(_with_parts(url, judge))

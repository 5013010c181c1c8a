"""Which stored URLs a server may fetch: scheme, credentials, blocked names, and addresses, literal or resolved.

An address is a text of 32 hex digits, so addresses compare as 128-bit numbers do; one of four parts stands at ``::ffff:0:0``,
where mapped ones are too, and is judged alike.  Ranges are cut into intervals that don't overlap, sorted, and held as one
literal array: each address finds its interval by halving, inside the row, so neither ranges nor rows are shuffled.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.joins import lookup

# Names that are never fetched; ranges of the public registries of special addresses, by what they are for.
BLOCKED_HOSTS = ["localhost", "metadata", "metadata.google.internal"]
RANGES = {
    "metadata": ["169.254.169.254/32", "100.100.100.200/32", "fd00:ec2::254/128"],
    "unspecified": ["0.0.0.0/32", "::/128"],
    "loopback": ["127.0.0.0/8", "::1/128"],
    "link-local": ["169.254.0.0/16", "fe80::/10"],
    "multicast": ["224.0.0.0/4", "ff00::/8"],
    "private": [
        "0.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24",
        "203.0.113.0/24", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7",
    ],
    "reserved": [
        "240.0.0.0/4", "::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "4000::/3", "6000::/3", "8000::/3", "a000::/3",
        "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fe00::/9",
    ],
    "": [
        "::ffff:0:0/96", "192.0.0.9/32", "192.0.0.10/32", "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28",
    ],
}
#: A table of ranges is a literal of the plan: it must stay small.
MAX_RANGES = 10_000
_V4 = r"^(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})$"
_TOP = 1 << 128


def intervals(ranges: dict[str, list[str]]) -> list[tuple[int, str]]:
    """Starts of intervals that cover all addresses, sorted, each with what its narrowest range is for (``""``: allowed)."""
    spans = []
    for use, nets in ranges.items():
        for net in map(ipaddress.ip_network, nets):
            shift, wide = (0xFFFF << 32, 96) if net.version == 4 else (0, 0)
            spans.append((net.prefixlen + wide, int(net[0]) + shift, int(net[-1]) + shift, use))
    if len(spans) > MAX_RANGES:
        raise ValueError(f"{len(spans)} ranges are more than {MAX_RANGES}")
    starts = sorted({0, *(a for _, a, _, _ in spans), *(b + 1 for _, _, b, _ in spans if b + 1 < _TOP)})
    # Ranges nest or are apart, so a stack of the open ones has the narrowest on top.
    order, opened, found, k = sorted(spans, key=lambda s: (s[1], s[0])), [], [], 0
    for start in starts:
        while opened and opened[-1][2] < start:
            opened.pop()
        while k < len(order) and order[k][1] == start:
            opened.append(order[k])
            k += 1
        found.append((start, opened[-1][3] if opened else ""))
    return found


def _hex4(part: Column) -> Column:
    return F.lower(F.lpad(F.hex(part), 4, "0"))


def _four(text: Column) -> Column:
    """The last two groups of an address of four parts; null where it is none.  Parts have no leading zeros."""
    part = lambda k: F.regexp_extract(text, _V4, k).cast("int")
    fits = text.rlike(_V4) & (F.greatest(*map(part, range(1, 5))) <= 255)
    return F.when(fits, F.concat(_hex4(part(1) * 256 + part(2)), F.lit(":"), _hex4(part(3) * 256 + part(4))))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which stands in the plan once however often it is used: copies of copies would grow without bound."""
    return F.get(F.transform(F.array(value), use), 0)


def address(text: Column) -> Column:
    """An IPv4 or IPv6 literal (its zone left out) as 32 hex digits; null where the text is none."""
    groups = lambda side: F.when(side == "", F.array().cast("array<string>")).otherwise(F.split(side, ":", -1))

    def joined(held: Column) -> Column:
        fits = (F.size(held) == 8) & F.forall(held, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(fits, F.array_join(F.transform(held, lambda g: F.lpad(g, 4, "0")), ""))

    def padded(s: Column) -> Column:
        n = F.size(s["l"]) + F.size(s["r"])
        return F.when(s["n"] == 1, s["l"]).when((s["n"] == 2) & (n <= 7), F.concat(s["l"], F.array_repeat(F.lit("0"), F.lit(8) - n), s["r"]))

    def six(low: Column) -> Column:
        # Four parts at the end stand for two groups.
        last = F.substring_index(low, ":", -1)
        whole = _let(last, lambda t: F.when(t.contains("."), F.concat(F.substr(low, F.lit(1), F.length(low) - F.length(t)), _four(t))).otherwise(low))
        sides = lambda x: F.struct(F.size(x).alias("n"), groups(F.get(x, 0)).alias("l"), groups(F.get(x, 1)).alias("r"))
        return _let(_let(_let(F.split(whole, "::", -1), sides), padded), joined)

    def either(t: Column) -> Column:
        four = F.concat(F.lit("0" * 20 + "ffff"), F.replace(_four(t), F.lit(":"), F.lit("")))
        bare = F.lower(F.when(F.endswith(t, F.lit("%")), t).otherwise(F.substring_index(t, "%", 1)))
        return F.when(t.contains(":"), _let(bare, six)).otherwise(four)

    return _let(text, either)


def use_of(number: Column, ranges: dict[str, list[str]] | None = None) -> Column:
    """What the range of an address (32 hex digits) is for; ``""`` where it may be fetched, null for null."""
    found = intervals(RANGES if ranges is None else ranges)
    starts = F.array(*[F.lit(f"{a:032x}") for a, _ in found])
    uses = F.array(*[F.lit(use) for _, use in found])
    # The interval is the last one that starts at or before the address: halve between 1, which starts at 0, and the end.
    span = F.struct(F.lit(1).alias("lo"), F.lit(len(found)).alias("hi"))
    steps = F.sequence(F.lit(1), F.lit(max(1, len(found).bit_length())))

    def search(n: Column) -> Column:
        def halve(s: Column, _: Column) -> Column:
            mid = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
            under = F.element_at(starts, mid) <= n
            return F.struct(F.when(under, mid).otherwise(s["lo"]).alias("lo"), F.when(under, s["hi"]).otherwise(mid - 1).alias("hi"))

        return F.when(n.isNotNull(), F.element_at(uses, F.aggregate(steps, span, halve, lambda s: s["lo"])))

    return _let(number, search)


def url_safety(rows: DataFrame, resolved: DataFrame | None = None, ranges: dict[str, list[str]] | None = None) -> DataFrame:
    """``rows`` (with a ``url``) and ``url_host, allowed, reason``: the first of these that holds, else null.

    ``empty``; ``scheme`` (not http or https); ``host`` (none, or brackets around what is no IPv6 address); ``credentials``;
    ``blocked`` (a name that is never fetched); the use of the literal's range; with ``resolved`` (host, address: one row an
    answer), ``unresolved`` for a name without answers and the use of any answer's range, the smallest address first.
    Answers that are no address are left out.  Names of hosts are compared without case.
    """
    def cut(u: Column) -> Column:
        return F.struct(
            u.alias("url"), F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)).alias("scheme"),
            F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1).alias("place"),
        )

    def sited(c: Column) -> Column:
        site = F.substring_index(c["place"], "@", -1)
        inside = F.regexp_extract(site, r"^\[([^\[\]]*)\](:[0-9]*)?$", 1)
        bracket = site.contains("[") | site.contains("]")
        name = F.when(bracket, inside).otherwise(F.substring_index(site, ":", 1))
        login = F.substr(c["place"], F.lit(1), F.length(c["place"]) - F.length(site))
        return F.struct(c["url"].alias("url"), c["scheme"].alias("scheme"), login.alias("login"), bracket.alias("bracket"), F.lower(F.trim(name)).alias("host"))

    def judged(c: Column) -> Column:
        def by_number(n: Column) -> Column:
            odd = c["bracket"] & (n.isNull() | ~c["host"].contains(":"))
            reason = (
                F.when(c["url"] == "", "empty").when(~c["scheme"].isin("http", "https"), "scheme").when(odd | (c["host"] == ""), "host")
                .when(~c["login"].isin("", "@", ":@"), "credentials").when(c["host"].isin(BLOCKED_HOSTS), "blocked")
                .when(n.isNotNull(), use_of(n, ranges))
            )
            return F.struct(c["host"].alias("host"), reason.alias("reason"))

        return _let(address(c["host"]), by_number)

    # A use of "" is that of a literal which may be fetched: nothing is asked about it.
    found = _let(_let(_let(F.regexp_replace(F.ltrim(F.coalesce("url", F.lit(""))), r"[\t\r\n]", ""), cut), sited), judged)
    held = rows.withColumn("found_", found).withColumns({"url_host": F.col("found_.host"), "first_": F.col("found_.reason")}).drop("found_")
    reason = F.nullif("first_", F.lit(""))
    if resolved is not None:
        answers = resolved.select(F.lower(F.trim("host")).alias("url_host"), address(F.trim("address")).alias("number_")).filter("url_host IS NOT NULL")
        answers = answers.withColumn("bad_", use_of(F.col("number_"), ranges))
        worst = F.min(F.when(F.col("bad_") != "", F.struct("number_", "bad_")))["bad_"]
        held = lookup(held, answers.groupBy("url_host").agg(worst.alias("bad_"), (F.count("number_") > 0).alias("known_")), "url_host")
        by_answer = F.when(F.coalesce("known_", F.lit(False)), F.col("bad_")).otherwise("unresolved")
        reason = F.when(F.col("first_").isNotNull(), reason).otherwise(by_answer)
    kept = [c for c in rows.columns if c.lower() not in ("url_host", "allowed", "reason")]
    return held.withColumn("reason", reason).select(*[F.col(f"`{c}`") for c in kept], "url_host", F.col("reason").isNull().alias("allowed"), "reason")

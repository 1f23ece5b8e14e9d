"""IPv4 and IPv6 addresses and networks as strings of bits.

An address is its family, ``4`` or ``6``, and its bits; a network the family
and the leading bits it fixes.  A network holds an address if the one string
begins with the other, whatever the length of the prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from palisade.functions.text import let

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
#: ::ffff:0:0/96, IPv4 addresses written as IPv6.
_MAPPED = "6" + "0" * 80 + "1" * 16


def _bits(digits: Column, base: int, width: int) -> Column:
    return F.lpad(F.conv(digits, base, 2), width, "0")


def _octet_bits(octets: Column) -> Column:
    return F.array_join(F.transform(octets, lambda o: _bits(o, 10, 8)), "")


def _v4_bits(ip: Column) -> Column:
    return F.when(ip.rlike(_V4), F.concat(F.lit("4"), _octet_bits(F.split(ip, r"\."))))


def _v6_bits(ip: Column) -> Column:
    text = F.lower(F.substring_index(ip, "%", 1))
    tail = F.substring_index(text, ":", -1)
    dotted = F.concat(F.regexp_extract(text, "^(.*:)[^:]*$", 1), F.array_join(F.transform(
        F.array(F.lit(1), F.lit(17)), lambda at: F.conv(F.substring(_v4_bits(tail), at + 1, F.lit(16)), 2, 16)), ":"))
    text = F.when(F.contains(text, F.lit(".")), F.when(_v4_bits(tail).isNotNull(), F.lower(dotted))).otherwise(text)

    def groups(part: Column) -> Column:
        return F.filter(F.split(part, ":"), lambda g: g != "")

    def expand(t: Column) -> Column:
        halves = F.split(t, "::")
        left, right = groups(F.get(halves, F.lit(0))), F.coalesce(groups(F.get(halves, F.lit(1))), F.array().cast("array<string>"))
        missing = 8 - F.size(left) - F.size(right)
        fits = F.when(F.size(halves) == 1, missing == 0).when(F.size(halves) == 2, missing >= 1).otherwise(F.lit(False))
        whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
        sound = t.rlike("^[0-9a-f:]+$") & ~t.rlike("^:[^:]|[^:]:$|:::|[0-9a-f]{5}") & fits
        return F.when(sound, F.concat(F.lit("6"), F.array_join(F.transform(whole, lambda g: _bits(g, 16, 16)), "")))

    return let(text, expand)


def address_bits(ip: Column) -> Column:
    """Family and bits of an address, NULL if it can't be read; IPv4 inside IPv6 (``::ffff:``) is IPv4."""
    found = F.when(F.contains(ip, F.lit(":")), _v6_bits(ip)).otherwise(_v4_bits(ip))
    return let(found, lambda b: F.when(b.startswith(_MAPPED), F.concat(F.lit("4"), F.substring(b, 98, 32))).otherwise(b))


def network_bits(network: Column) -> Column:
    """Family and fixed bits of ``a.b.`` (whole octets), ``a.b.c.d/n``, ``x::/n`` or a single address; NULL if it can't be read.

    Bits of the address beyond the prefix length don't count.
    """
    parts = F.split(network, "/")
    octets = F.split(F.regexp_replace(network, r"\.$", ""), r"\.")
    begun = F.when(network.rlike(rf"^({_OCTET}\.){{1,3}}$"), F.concat(F.lit("4"), _octet_bits(octets)))
    length = F.when(F.get(parts, F.lit(1)).rlike("^[0-9]{1,3}$"), F.get(parts, F.lit(1)).cast("int"))

    def cut(bits: Column) -> Column:
        mapped = bits.startswith("4") & F.contains(network, F.lit(":"))
        kept = length - F.when(mapped, 96).otherwise(0)
        return F.when(kept.between(0, F.length(bits) - 1), F.substring(bits, F.lit(1), kept + 1))

    address = let(address_bits(F.get(parts, F.lit(0))), lambda b: F.when(F.size(parts) == 1, b).when(F.size(parts) == 2, cut(b)))
    return F.coalesce(begun, address)


def range_networks(first: Column, last: Column) -> Column:
    """The fewest networks that together hold the IPv4 addresses from ``first`` to ``last``; none if either can't be read."""
    def number(ip: Column) -> Column:
        return F.conv(F.substring(_v4_bits(ip), 2, 32), 2, 10).cast("long")

    def written(value: Column, bits: Column) -> Column:
        octets = [F.shiftright(value, 24 - 8 * k).bitwiseAND(F.lit(255)).cast("string") for k in range(4)]
        return F.concat_ws("/", F.concat_ws(".", *octets), (32 - bits).cast("string"))

    def step(state: Column, bits: Column) -> Column:
        # from single addresses to ever larger blocks: an odd end is a block of its own
        lo, hi = state["lo"], state["hi"]
        open_ = lo < hi
        left, right = open_ & (lo % 2 == 1), open_ & (hi % 2 == 1) & (lo + lo % 2 < hi)

        def block(index: Column) -> Column:
            return written((index * F.pow(F.lit(2.0), bits).cast("long")).cast("long"), bits)

        none = F.array().cast("array<string>")
        found = F.concat(state["found"], F.when(left, F.array(block(lo))).otherwise(none), F.when(right, F.array(block(hi - 1))).otherwise(none))
        return F.struct(F.floor((lo + 1) / 2).cast("long").alias("lo"), F.floor(hi / 2).cast("long").alias("hi"), found.alias("found"))

    start = F.struct(number(first).alias("lo"), (number(last) + 1).alias("hi"), F.array().cast("array<string>").alias("found"))
    return F.coalesce(F.aggregate(F.sequence(F.lit(0), F.lit(32)), start, step)["found"], F.array().cast("array<string>"))

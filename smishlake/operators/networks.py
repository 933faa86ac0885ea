"""Addresses and networks: IPv4 and IPv6 literals as hex digits, and the longest network of a table that holds an address.

Everything is built-in expressions. An address is its version and its digits ("4" and 8, "6" and 32), so that addresses of
one version compare as text, and a network is its length and the digits that it fixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smishlake.functions import constants as C
from smishlake.functions.columns import barrier
from smishlake.sources.tables import sized

DIGITS = "0123456789abcdef"


def _let(value: Column, then) -> Column:
    """then(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _v4_digits(dotted: Column) -> Column:
    """Eight hex digits of a dotted IPv4 literal without leading zeros, else null."""
    octets = F.split(F.when(dotted.rlike(rf"^{C.IPV4}$"), dotted), r"\.")
    return F.lower(F.array_join(F.transform(octets, lambda o: F.lpad(F.hex(o.cast("int")), 2, "0")), ""))


def _groups(side: Column) -> Column:
    return F.when(side == "", F.array().cast("array<string>")).otherwise(F.split(side, ":", -1))


def _all_groups(sides: Column) -> Column:
    """The eight groups of an address that is split at "::", or null."""
    def filled(both: Column) -> Column:
        n = F.size(both["left"]) + F.size(both["right"])
        gap = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - n))
        return F.when((F.size(sides) == 2) & (n <= 7), F.concat(both["left"], gap, both["right"])).when((F.size(sides) == 1) & (n == 8), both["left"])

    return _let(F.struct(_groups(F.get(sides, F.lit(0))).alias("left"), _groups(F.coalesce(F.get(sides, F.lit(1)), F.lit(""))).alias("right")), filled)


def _v6_digits(text: Column) -> Column:
    """32 hex digits of an IPv6 literal, else null: at most one "::", a dotted IPv4 tail, a zone behind "%"."""
    bare = _let(F.split(F.lower(text), "%", -1), lambda z: F.when((F.size(z) == 1) | (F.size(z) == 2) & (F.get(z, F.lit(1)) != ""), F.get(z, F.lit(0))))

    def undotted(whole: Column) -> Column:
        last = F.substring_index(whole, ":", -1)
        as_groups = _let(_v4_digits(last), lambda t: F.concat(F.substr(whole, F.lit(1), F.length(whole) - F.length(last)), F.substring(t, 1, 4), F.lit(":"), F.substring(t, 5, 4)))
        return F.when(whole.contains("."), as_groups).otherwise(whole)

    groups = _let(F.split(_let(bare, undotted), "::", -1), _all_groups)
    return _let(groups, lambda g: F.when(F.forall(g, lambda x: x.rlike("^[0-9a-f]{1,4}$")), F.array_join(F.transform(g, lambda x: F.lpad(x, 4, "0")), "")))


def address(host: Column) -> Column:
    """Version and hex digits of an address literal (IPv6 with or without brackets), null for anything else."""
    bare = F.regexp_replace(host, r"^\[|\]$", "")
    return F.coalesce(F.concat(F.lit("4"), _v4_digits(host)), F.concat(F.lit("6"), _v6_digits(F.when(bare.contains(":"), bare))))


def prefix(address_: Column, length: int) -> Column:
    """What a network of this length fixes of an address: its version and leading digits, the last one cut to its bits."""
    whole, bits = divmod(length, 4)
    head = F.substring(address_, 1, 1 + whole)
    if not bits:
        return head
    cut = "".join(DIGITS[d >> 4 - bits << 4 - bits] for d in range(16))
    return F.concat(head, F.translate(F.substring(address_, 2 + whole, 1), DIGITS, cut))


def in_network(address_: Column, cidr: str) -> Column:
    """Whether an address lies in one given network; false for null."""
    from ipaddress import ip_network

    net = ip_network(cidr)
    digits = "{}{:0{}x}".format(net.version, int(net.network_address), net.max_prefixlen // 4)
    last = "{}{:0{}x}".format(net.version, int(net.broadcast_address), net.max_prefixlen // 4)
    return F.coalesce(address_.between(digits, last), F.lit(False))


def as_networks(df: DataFrame, cidr_col: str = "cidr") -> DataFrame:
    """df with net_length and net_prefix of its networks ("10.0.0.0/8"); rows that are no network are left out. Host bits are
    ignored."""
    parts = F.split(F.col(cidr_col), "/")
    df = df.withColumn("_a", address(parts[0])).withColumn("net_length", F.try_element_at(parts, F.lit(2)).try_cast("int"))
    df = barrier(df, "_a", "net_length")
    most = F.when(F.col("_a").startswith("4"), 32).otherwise(128)
    df = df.filter(F.col("_a").isNotNull() & F.col("net_length").between(0, most))
    whole, bits = F.floor(F.col("net_length") / 4).cast("int"), (F.col("net_length") % 4).cast("int")
    cuts = F.array(*(F.lit("".join(DIGITS[d >> 4 - b << 4 - b] for d in range(16))) for b in (0, 1, 2, 3)))
    digit = F.instr(F.lit(DIGITS), F.substr("_a", whole + 2, F.lit(1)))
    last = F.when(bits > 0, F.substr(F.get(cuts, bits), digit, F.lit(1))).otherwise("")
    return df.withColumn("net_prefix", F.concat(F.substr("_a", F.lit(1), whole + 1), last)).drop("_a")


def longest_match(df: DataFrame, networks: DataFrame, key: str, address_col: str, value_col: str) -> DataFrame:
    """key, net_length, value: for each row of df the longest network that holds its address, with the network's value (of
    equal networks the smallest); rows that no network holds are left out.

    networks (as as_networks() gives them) may be of any number: an address offers its prefix of each length that is there
    (162 at most), and one equi-join meets them. Address 0.0.0.0/0 takes part like any other.
    """
    lengths = sorted({(r["v"], r["net_length"]) for r in networks.select(F.substring("net_prefix", 1, 1).alias("v"), "net_length").distinct().collect()})
    once = networks.groupBy("net_length", "net_prefix").agg(F.min(value_col).alias("value"))
    keys = F.array_compact(F.array(*(F.when(F.col("_a").startswith(v), F.struct(F.lit(n).alias("net_length"), prefix(F.col("_a"), n).alias("net_prefix"))) for v, n in lengths)))
    offered = barrier(df.select(key, F.col(address_col).alias("_a")), "_a").filter("_a IS NOT NULL").select(key, F.inline(keys) if lengths else F.inline(F.expr("array(named_struct('net_length', -1, 'net_prefix', ''))")))
    hits = offered.join(sized(once, row_bytes=96), ["net_length", "net_prefix"])
    best = hits.groupBy(key).agg(F.max(F.struct("net_length", "value")).alias("b"))
    return best.select(key, "b.net_length", "b.value")

"""Addresses against any number of networks: an equal join on prefixes, for both address families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bits(text: Column, base: int, width: int) -> Column:
    return F.lpad(F.conv(text, base, 2), width, "0")


def address_bits(ip: Column) -> Column:
    """The bits of an IPv4 or IPv6 address as 32 or 128 digits; null if it isn't one."""
    four = ip.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
    six = ip.rlike(r"^[0-9A-Fa-f:]+$") & ip.contains(":") & ~ip.rlike(r":::|::.*::|^:[^:]|[^:]:$|[0-9A-Fa-f]{5}")
    groups = lambda side: F.filter(F.split(side, ":"), lambda g: g != "")
    head, tail = groups(F.substring_index(ip, "::", 1)), groups(F.when(ip.contains("::"), F.substring_index(ip, "::", -1)).otherwise(""))
    missing = F.lit(8) - F.size(head) - F.size(tail)
    whole = F.concat(head, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), tail)
    fits = F.when(ip.contains("::"), missing >= 1).otherwise(missing == 0)
    return (
        F.when(four, F.array_join(F.transform(F.split(ip, r"\."), lambda x: _bits(x, 10, 8)), ""))
        .when(six & fits, F.array_join(F.transform(whole, lambda g: _bits(g, 16, 16)), "")))


def in_networks(addresses: DataFrame, ip: str, networks: DataFrame, network: str) -> DataFrame:
    """``addresses`` with ``denied``: whether ``ip`` lies in one of ``networks`` (a/b); what is no address is denied.

    An address is joined by its first bits, once for each length that networks have (162 at
    most), so no row meets all networks.
    """
    parts = F.split(network, "/")
    nets = networks.select(address_bits(parts[0]).alias("_b"), parts[1].cast("int").alias("_n")).where("_b IS NOT NULL AND _n BETWEEN 0 AND length(_b)")
    nets = nets.select(F.length("_b").alias("_family"), "_n", F.expr("substring(_b, 1, _n)").alias("_prefix")).distinct()
    lengths = [(r["_family"], r["_n"]) for r in nets.select("_family", "_n").distinct().collect()]  # 33 + 129 at most
    asked = addresses.select(F.col(ip).alias("_ip")).where(F.col(ip).isNotNull()).distinct().withColumn("_b", address_bits(F.col("_ip")))
    of = lambda family: F.array(*[F.lit(n) for f, n in sorted(lengths) if f == family]).cast("array<int>")
    each = asked.select("_ip", "_b", F.explode(F.when(F.length("_b") == 32, of(32)).otherwise(of(128))).alias("_n")).where("_b IS NOT NULL")
    hit = each.select("_ip", F.length("_b").alias("_family"), "_n", F.expr("substring(_b, 1, _n)").alias("_prefix")).join(nets, ["_family", "_n", "_prefix"], "left_semi").select("_ip").distinct().withColumn("_hit", F.lit(True))
    joined = addresses.join(hit, F.col(ip) == F.col("_ip"), "left")
    return joined.withColumn("denied", F.col("_hit").isNotNull() | address_bits(F.col(ip)).isNull()).drop("_ip", "_hit")

import ipaddress
import random

import pytest

from strandline.operators import networks


def brute(address, nets):
    try:
        a = ipaddress.ip_address(address.strip().replace("%", "!"))  # zones are no part of an address
    except (ValueError, AttributeError):
        return ""
    fits = [(n.prefixlen, label) for n, label in nets if n.version == a.version and a in n]
    longest = max((f[0] for f in fits), default=None)
    return min((f[1] for f in fits if f[0] == longest), default="")


@pytest.mark.parametrize("limit", [0, 1000])
def test_longest_network(spark, monkeypatch, limit):
    monkeypatch.setattr(networks, "BROADCAST_NETWORKS", limit)
    r = random.Random(1)
    four = lambda: ipaddress.IPv4Address(r.choice([0x0A000000, 0xC0A80000, 0xFFFFFFFF, 0]) ^ r.getrandbits(r.randrange(1, 24)))
    six = lambda: ipaddress.IPv6Address((r.choice([0x20010DB8 << 96, (1 << 128) - 1, 0xFFFF << 32]) ^ r.getrandbits(r.randrange(1, 110))))
    nets = [(ipaddress.ip_network((four(), r.randrange(0, 33)), strict=False), f"n{i}") for i in range(60)] + [(ipaddress.ip_network((six(), r.randrange(0, 129)), strict=False), f"n{i}") for i in range(60, 120)]
    texts = [(str(n), label) for n, label in nets] + [(f"{four()}/33", "bad"), ("x/8", "bad"), (None, "bad"), ("1.2.3.4/", "bad"), ("::/129", "bad")]
    nets += [(ipaddress.ip_network("9.9.9.9"), "lone"), (ipaddress.ip_network("10.0.0.0/9"), "zz"), (ipaddress.ip_network("10.0.0.0/9"), "aa")]
    texts += [("9.9.9.9", "lone"), ("10.1.2.3/9", "zz"), ("10.0.0.0/9", "aa")]
    addresses = [str(four()) for _ in range(150)] + [r.choice([str, lambda a: a.exploded.upper()])(six()) for _ in range(150)]
    addresses += ["::ffff:10.1.2.3", "::", "::1", "2001:db8::", "9.9.9.9", "10.0.0.1", "01.2.3.4", "1.2.3", "nothing", "", None, "fe80::1%eth0", "1:2:3:4:5:6:7:8:9", ":::", "12345::"] + ["10.0.0.1"] * 50
    df = spark.createDataFrame([(i, a, "kept") for i, a in enumerate(addresses)], "id int, ip string, label string")
    out = networks.longest_network(df, "ip", spark.createDataFrame(texts, "cidr string, owner string"), "cidr", "owner")
    got = {x["id"]: x["ip.owner"] for x in out.collect()}
    assert [got[i] for i in range(len(addresses))] == [brute(a, nets) for a in addresses]
    assert sum(v != "" for v in got.values()) > 150


def test_no_networks(spark):
    df = spark.createDataFrame([("1.2.3.4",), (None,)], "ip string")
    assert [r["ip.owner"] for r in networks.longest_network(df, "ip", spark.createDataFrame([], "cidr string, owner string"), "cidr", "owner").collect()] == ["", ""]

"""Network address helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def split_host_port(address: Column) -> tuple[Column, Column]:
    """Host and port of ``host:port`` or ``[v6]:port``.

    Anything else, bare IPv6 included, is returned unchanged with port 0.
    """
    bracketed = r"^\[([^\[\]]*)\]:([^:\[\]]*)$"
    plain = r"^([^:\[\]]*):([^:\[\]]*)$"

    def group(n: int) -> Column:
        return (
            F.when(address.rlike(bracketed), F.regexp_extract(address, bracketed, n))
            .when(address.rlike(plain), F.regexp_extract(address, plain, n))
        )

    has_port = F.contains(address, F.lit(":"))
    host = F.coalesce(F.when(has_port, group(1)), address)
    port = F.regexp_extract(F.when(has_port, group(2)), r"^\s*([+-]?\d+)", 1).try_cast("int")
    return host, F.coalesce(port, F.lit(0))


def _v4_hex(address: Column) -> Column:
    octets = F.split(address, r"\.")
    return F.array_join(F.transform(octets, lambda o: F.lpad(F.lower(F.hex(o.cast("int"))), 2, "0")), "")


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it."""
    return F.transform(F.array(value), use)[0]


def _fold_dotted_tail(text: Column) -> Column:
    """Replace a dotted quad at the end of an IPv6 text by two hex groups."""

    def folded(tail: Column) -> Column:
        hexed = _v4_hex(tail)
        head = F.substring(text, F.lit(1), F.length(text) - F.length(tail))
        return F.concat(head, F.substring(hexed, 1, 4), F.lit(":"), F.substring(hexed, 5, 4))

    dotted = F.regexp_extract(text, rf":({_V4})$", 1)
    return F.when(F.contains(text, F.lit(".")), F.when(dotted != "", _bind(dotted, folded))).otherwise(text)


def _expand_groups(text: Column) -> Column:
    """32 hex digits of an IPv6 text without dots, or null when it is malformed."""
    groups = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")
    short = F.contains(text, F.lit("::"))
    shape = text.rlike("^[0-9a-f:]+$") & ~text.rlike("[0-9a-f]{5}|:::|::.*::|^:[^:]|[^:]:$")

    def fill(parts: Column) -> Column:
        head, rest = parts["head"], parts["rest"]
        missing = F.lit(8) - F.size(head) - F.size(rest)
        zeros = F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0)))
        whole = F.transform(F.concat(head, zeros, rest), lambda g: F.lpad(g, 4, "0"))
        return F.when(F.when(short, missing >= 1).otherwise(missing == 0), F.array_join(whole, ""))

    rest = F.when(short, groups(F.substring_index(text, "::", -1))).otherwise(F.array().cast("array<string>"))
    parts = F.struct(groups(F.substring_index(text, "::", 1)).alias("head"), rest.alias("rest"))
    return F.when(shape, _bind(parts, fill))


def _v6_key(text: Column) -> Column:
    mapped = "0" * 20 + "ffff"
    unmapped = lambda key: F.when(F.startswith(key, F.lit(mapped)), F.substring(key, 25, 8)).otherwise(key)
    return _bind(_bind(_fold_dotted_tail(text), _expand_groups), unmapped)


def ip_key(address: Column) -> Column:
    """Sortable fixed-width hex form: 8 digits for IPv4, 32 for IPv6, null when invalid.

    IPv4 written inside IPv6 (``::ffff:a.b.c.d``) counts as IPv4.
    """
    return F.when(address.rlike(rf"^{_V4}$"), _v4_hex(address)).when(
        F.contains(address, F.lit(":")), _bind(F.lower(address), _v6_key)
    )

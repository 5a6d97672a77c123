"""Scalar expressions over log rows, specs and quantities."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results, and the phrases by which an unavailable answer is known to have failed.
REFUSALS = ["quorum not reached", "no replica accepted", "local write failed", "local read failed"]
MESSAGE_BYTES = 160
UNITS_NS = {"ns": 1, "us": 1_000, "µs": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000}


def classify_result(code: Column, message: Column) -> Column:
    """ok, failed or unknown, by the RPC code and message of an answer (null code: no error)."""
    refused = message.rlike("|".join(REFUSALS))
    return F.when(code.isNull(), "ok").when(code.isin("Canceled", "DeadlineExceeded"), "unknown").when((code == "Unavailable") & ~F.coalesce(refused, F.lit(False)), "unknown").otherwise("failed")


def client_code(code: Column) -> Column:
    """The code that a client sees: its own cancellation and deadline, and Unavailable for anything else."""
    return F.when(code.isNull(), F.lit(None).cast("string")).when(code.isin("Canceled", "DeadlineExceeded"), code).otherwise("Unavailable")


def value_matches(value: Column, key: Column) -> Column:
    return value.startswith(F.concat(key, F.lit("|")))


def classify_get(found: Column, values: Column, key: Column) -> Column:
    return F.when(~found, "notfound").when(F.exists(values, lambda v: value_matches(v, key)), "ok").otherwise("mismatch")


def synthetic_value(key: Column, size: int) -> Column:
    """key and a bar, padded with x to size and never cut."""
    head = F.concat(key, F.lit("|"))
    return F.concat(head, F.repeat(F.lit("x"), F.greatest(F.lit(0), F.lit(size) - F.octet_length(head))))


def key_name(prefix: Column, i: Column) -> Column:
    return F.concat(prefix, F.lit("-"), F.when(i < 10_000_000, F.lpad(i.cast("string"), 7, "0")).otherwise(i.cast("string")))


def size_tier(size: Column) -> Column:
    """Decimal digits beyond three, by integers."""
    return F.greatest(F.lit(0), F.length(size.cast("string")) - 3).cast("int")


def duration_ns(text: Column) -> Column:
    """Nanoseconds of a duration such as 1h2m3.5s or 500ms; null if it isn't one."""
    part = r"([0-9]*\.?[0-9]+)(ns|us|µs|ms|s|m|h)"
    numbers, units = (F.regexp_extract_all(text, F.lit(part), F.lit(i)) for i in (1, 2))
    scale = F.create_map(*[F.lit(x) for kv in UNITS_NS.items() for x in kv])
    whole = F.aggregate(F.zip_with(numbers, units, lambda n, u: F.round(n.cast("decimal(28,9)") * scale[u], 0).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(text.rlike(rf"^[-+]?({part})+$"), F.when(text.startswith("-"), -whole).otherwise(whole)).when(text.isin("0", "+0", "-0"), F.lit(0).cast("long"))


def duration_text(ns: Column) -> Column:
    """A duration as it is written: 1h2m3.5s, 15m0s, 1.5s, 250ms, 7µs, 3ns or 0s; a sign before negative ones."""
    n = F.abs(ns)
    trimmed = lambda x: F.regexp_replace(F.regexp_replace(x.cast("string"), r"0+$", ""), r"\.$", "")
    of = lambda scale: trimmed((n.cast("decimal(28,0)") / F.lit(scale).cast("decimal(28,0)")).cast("decimal(28,9)"))
    secs = trimmed(((n % 60_000_000_000).cast("decimal(28,0)") / F.lit(1_000_000_000).cast("decimal(28,0)")).cast("decimal(28,9)"))
    hours, minutes = F.floor(n / 3_600_000_000_000), F.floor(n / 60_000_000_000) % 60
    long_ = F.concat(F.when(hours > 0, F.concat(hours, F.lit("h"))).otherwise(""), F.when(n >= 60_000_000_000, F.concat(minutes, F.lit("m"))).otherwise(""), secs, F.lit("s"))
    text = F.when(n == 0, "0s").when(n < 1_000, F.concat(n, F.lit("ns"))).when(n < 1_000_000, F.concat(of(1_000), F.lit("µs"))).when(n < 1_000_000_000, F.concat(of(1_000_000), F.lit("ms"))).otherwise(long_)
    return F.when(ns < 0, F.concat(F.lit("-"), text)).otherwise(text)


def duration_ns_py(text: str) -> int:
    found = re.findall(r"([0-9]*\.?[0-9]+)(ns|us|µs|ms|s|m|h)", text)
    if not found or "".join(a + b for a, b in found) != text.lstrip("+-"):
        raise ValueError(f"duration {text!r}")
    return (-1 if text[0] == "-" else 1) * sum(round(float(a) * UNITS_NS[b]) for a, b in found)


def rfc3339_ns(text: Column) -> Column:
    """Nanoseconds since 1970 of an RFC 3339 time of microseconds at most."""
    return F.unix_micros(F.to_timestamp(text)) * 1000


def detection_ns(interval: int, timeout: int, misses: int) -> int:
    return misses * interval + timeout


def recovery_ns(backoff: int, interval: int, timeout: int) -> int:
    return backoff + 2 * interval + timeout


def millicores(quantity: Column) -> Column:
    return F.when(quantity.endswith("m"), F.regexp_replace(quantity, "m$", "").cast("double")).otherwise(quantity.cast("double") * 1000)


def stages(spec: Column) -> Column:
    """rate:secs,rate:secs as an array of structs."""
    return F.transform(F.split(spec, ","), lambda x: F.struct(F.split(x, ":")[0].cast("double").alias("rate"), F.split(x, ":")[1].cast("int").alias("secs")))


def short_message(message: Column) -> Column:
    """At most 160 bytes; a character cut in two is replaced."""
    return F.decode(F.substring(F.encode(message, "UTF-8"), 1, MESSAGE_BYTES), "UTF-8")


def fault_kind(spec: Column) -> Column:
    kind = F.split(spec, ":", 2)[0]
    return F.when(kind == "zone", "down").when(kind == "partition-zone", "partition").otherwise(kind)


def fault_pods(spec: Column) -> Column:
    """The pods that a down: or partition: spec names, sorted and distinct; zones are resolved by a join."""
    rest = F.get(F.split(spec, ":", 2), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce(rest, F.lit("")), ","), lambda p: p != "")))


def fault_text(kind: Column, pods: Column) -> Column:
    return F.when(kind == "none", "none").otherwise(F.concat(kind, F.lit(":"), F.array_join(pods, ",")))


def percent(share: Column) -> Column:
    return F.format_string("%5.1f%%", share * 100)


def json_value(value: Column) -> Column:
    """A JSON string's own text, or the JSON text of any other value."""
    return F.when(value.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")).otherwise(value)


def hint_key(target: Column, key: Column) -> Column:
    return F.concat(target, F.lit("\0"), key)


def hint_target(packed: Column) -> Column:
    return F.substring_index(packed, "\0", 1)


def hint_item_key(packed: Column) -> Column:
    return F.substr(packed, F.locate("\0", packed) + 1)


DELIVERED = "\0delivered"  # fixed value: the clock entry that marks delivered hints


def is_marker(clock: Column) -> Column:
    return F.map_contains_key(clock, DELIVERED)


def member_address(name: str, namespace: str, port: int = 7000) -> str:
    return f"{name}.{name.rsplit('-', 1)[0]}.{namespace}.svc.cluster.local:{port}"


def ordinal(member: Column) -> Column:
    return F.regexp_extract(member, r"-(\d+)$", 1).cast("int")

"""Where keyed records go: identifiers, and placement on named nodes, as column expressions.

Spark places its own partitions; this is for reading or laying out stores that other programs partition by these rules.
Identifiers are SHA-256 digests in lower-case hexadecimal of one length, so their order as strings is that of the numbers.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def node_id(ip: str, port: int) -> str:
    """The identifier of a node: the digest of its compact JSON."""
    return hashlib.sha256(json.dumps({"ip": ip, "port": port}, separators=(",", ":")).encode()).hexdigest()


def key_id(key: Column) -> Column:
    """The identifier of a string key: the digest of its JSON."""
    quoted = F.to_json(F.struct(key.alias("k")))
    return F.sha2(F.substring(quoted, F.lit(6), F.length(quoted) - 6), 256)


def remainder(ident: Column, n: int) -> Column:
    """A 256-bit identifier modulo ``n`` (under 2^31), folded over eight 32-bit parts."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(ident, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda r, p: (r * F.lit(1 << 32) + p) % F.lit(n))


def by_remainder(ident: Column, nodes: Sequence[str]) -> Column:
    """The node at the identifier's remainder, nodes in order."""
    ordered = sorted(nodes)
    return F.get(F.array(*map(F.lit, ordered)), remainder(ident, len(ordered)).cast("int"))


def on_ring(ident: Column, nodes: Sequence[str]) -> Column:
    """The first node from the identifier onwards on the ring of identifiers."""
    ordered = F.array(*map(F.lit, sorted(nodes)))
    return F.coalesce(F.get(F.filter(ordered, lambda n: n >= ident), F.lit(0)), F.lit(min(nodes)))


def by_weight(ident: Column, nodes: Sequence[str]) -> Column:
    """The node whose digest together with the identifier is the greatest."""
    return F.greatest(*(F.struct(F.sha2(F.concat(ident, F.lit(n)), 256).alias("w"), F.lit(n).alias("n")) for n in nodes))["n"] if len(nodes) > 1 else F.lit(nodes[0])

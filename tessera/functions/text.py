"""String functions: templates, names, hashes, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK = (1 << 32) - 1


def substituted(template: Column, values: Column) -> Column:
    """Replace ``${name}`` by a map's values; a name that is left gives an error text."""
    out = F.aggregate(F.map_entries(values), template, lambda t, e: F.replace(t, F.concat(F.lit("${"), e["key"], F.lit("}")), e["value"]))
    return F.regexp_replace(out, r"\$\{(\w+)\}", "[unknown: $1]")


def mixed_hash(text: Column) -> Column:
    """32-bit string hash of seed 0xAAAAAAAA that mixes by the parity of the place; ASCII only."""
    places = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1)).otherwise(F.array().cast("array<int>"))

    def step(h: Column, i: Column) -> Column:
        c = F.ascii(F.substring(text, i + 1, F.lit(1))).cast("bigint")
        # Products are kept in 64 bits by cutting the shifted hash to 32 bits first.
        even = F.shiftleft(h, 7).bitwiseAND(F.lit(_MASK)).bitwiseXOR(((c * F.shiftrightunsigned(h, 3)) % F.lit(1 << 32)))
        odd = F.bitwise_not((F.shiftleft(h, 11).bitwiseAND(F.lit(_MASK)) + c.bitwiseXOR(F.shiftrightunsigned(h, 5))) % F.lit(1 << 32)).bitwiseAND(F.lit(_MASK))
        return h.bitwiseXOR(F.when(i % 2 == 0, even).otherwise(odd)).bitwiseAND(F.lit(_MASK))

    return F.aggregate(places, F.lit(0xAAAAAAAA).cast("bigint"), step)


def hash_directories(path: Column, levels: int) -> Column:
    """Directories from the low half-bytes of the path's CRC32."""
    h = F.crc32(path.cast("binary"))
    return F.concat_ws("/", *[F.lower(F.hex(F.shiftright(h, 4 * i).bitwiseAND(F.lit(15)))) for i in range(levels)])


def legal_name(name: Column) -> Column:
    """Legal characters only, separators merged, no blank ends, reserved names avoided."""
    clean = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._/-]+", "_"), r"/+", "/")
    clean = F.btrim(clean, F.lit("_/ "))
    return F.when(F.upper(clean).isin("CON", "PRN", "AUX", "NUL", ""), F.concat(clean, F.lit("_"))).otherwise(clean)


def local_name(uri: Column) -> Column:
    return F.regexp_extract(uri, r"([^/#:]*)$", 1)


def shortened(code: Column, most: int = 35) -> Column:
    """A readable short name of a statement: comments cut, literals and blanks shortened."""
    s = F.regexp_replace(code, r"//[^\n]*|/\*.*?\*/", " ")
    s = F.regexp_replace(s, r'"([^"]{3})[^"]*"', '"$1..."')
    return F.substring(F.btrim(F.regexp_replace(s, r"\s+", " ")), 1, most)


def retyped(statement: Column) -> Column:
    s = F.btrim(statement)
    return F.when(s.rlike(r"^return\b"), "return").when(s.rlike(r"^break\b"), "break").when(s.rlike(r"^continue\b"), "continue").otherwise("stmt")


def template_name(file_name: Column, cut: int = 12) -> Column:
    """Without the last ``__`` part, the others joined by ``_``, less the last characters."""
    parts = F.split(file_name, "__")
    whole = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "_")
    return F.substring(whole, 1, F.greatest(F.length(whole) - cut, F.lit(0)))


def patched_turtle(line: Column) -> Column:
    return F.regexp_replace(line, r"(:(?:return|break|continue))\s+(:stmt)", "$1 , $2")

"""Fill ``{name}`` templates with columns (Spark) or SQL expressions (oracle)."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_FIELD = re.compile(r"\{(\w+)\}")

#: The characters of the Unicode property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    """``text`` without white space at its ends."""
    return F.btrim(text, F.lit(WHITE))


def _parts(template: str):
    pos = 0
    for m in _FIELD.finditer(template):
        if m.start() > pos:
            yield "lit", template[pos:m.start()]
        yield "col", m.group(1)
        pos = m.end()
    if pos < len(template):
        yield "lit", template[pos:]


def fill(template: str, **values: Column) -> Column:
    """``fill("Escalated to {tier}.", tier=col)`` -> concat("Escalated to ", col, ".")."""
    return F.concat(*[F.lit(v) if kind == "lit" else values[v].cast("string")
                      for kind, v in _parts(template)])


def fill_sql(template: str, **values: str) -> str:
    """The same template as a SQL string expression."""
    out = []
    for kind, v in _parts(template):
        out.append("'" + v.replace("'", "''") + "'" if kind == "lit" else f"CAST({values[v]} AS VARCHAR)")
    return "(" + " || ".join(out) + ")"

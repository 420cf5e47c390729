"""Sentences put at the end of the driver's documents, so that every rule has something to match.

The driver's texts hold no marker words, canned phrases, formulas or
abbreviations. Both the queries and their SQL append the same sentences by
document id, and turn ampersands into spaces: entities are beyond SQL and have
a query of their own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCES = [
    "Furthermore, we delve into a multifaceted tapestry of robust methodology. Moreover, it is important to note that synergy plays a pivotal role in every paradigm.",
    "Honestly I kinda love this stuff, lol. It was super weird and totally cool, tbh. Yeah, we just went home anyway.",
    "Dr. Gray met Prof. Stone at ten, e.g. for tea. They talked.Then they left! \"Go now.\" he said, etc. Fig. 3 shows it.",
    "The value $\\sigma$ is \\textbf{large} and \\alpha \\leq 3; see ∑ of π × 2 ≥ 4 … “quoted” text — done – here • item.",
    "In conclusion, it is evident that this framework is comprehensive. It is worth noting that it is what it is, and they are here because we are sure that there is hope.",
    "The cat sat here today. The dog ran over there. The bird flew up high. The fish swam down low. It is a nice day for all of us.",
    "This camelCase word and anotherOne split oddly. Use `code spans` or ```fenced\nblocks``` at will, and do not worry about what cannot be helped.",
    "In today's digital age a broad spectrum of readers love nuanced essays; we harness the power of words; thus holistic prose will foster a holistic understanding of all that matters to the people who live in towns and villages far away, and nobody ever minds a longer sentence.",
]


def planted(text: Column, doc_id: Column) -> Column:
    own = F.element_at(F.array(*[F.lit(s) for s in SENTENCES]), (F.pmod(doc_id, F.lit(len(SENTENCES))) + 1).cast("int"))
    return F.concat(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit(" ")), F.lit(" "), own)


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SQL = f"src AS (SELECT doc_id, replace(coalesce(text, ''), '&', ' ') || ' ' || ([{', '.join(map(quoted, SENTENCES))}])[(doc_id % {len(SENTENCES)})::INT + 1] AS t FROM documents)"

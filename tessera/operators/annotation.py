"""Annotation clean-up: spans as array<struct<start,end,label>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int,label:string>>"


def normalise(raw: Column) -> Column:
    """raw: array<struct<start:string,end:string,label:string>>; spans that are no integers or empty are dropped."""
    one = lambda x: F.struct(x["start"].try_cast("int").alias("start"), x["end"].try_cast("int").alias("end"), x["label"].alias("label"))
    return F.filter(F.transform(raw, one), lambda x: x["start"].isNotNull() & x["end"].isNotNull() & (x["start"] < x["end"])).cast(SPANS)


def without_overlap(spans: Column) -> Column:
    """Longest first (then the first in text order), kept if it touches nothing kept; in text order."""
    order = F.transform(spans, lambda x: F.struct((x["start"] - x["end"]).alias("l"), x["start"].alias("start"), x["end"].alias("end"), x["label"].alias("label")))
    clash = lambda acc, x: F.exists(acc, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"]))
    one = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["label"].alias("label"))
    return F.array_sort(F.aggregate(F.array_sort(order), F.array().cast(SPANS), lambda acc, x: F.when(clash(acc, x), acc).otherwise(F.array_append(acc, one(x))).cast(SPANS)))


def reanchor(text: Column, said: Column) -> Column:
    """Start (from 0) of the first occurrence of ``said``, else of one in any case, else null."""
    exact, loose = F.locate(said, text) if isinstance(said, str) else F.instr(text, said), F.instr(F.lower(text), F.lower(said))
    return F.when(exact > 0, exact - 1).when(loose > 0, loose - 1)

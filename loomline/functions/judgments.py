"""Tolerant readers of judges' JSON answers, as column expressions over the answer text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import half_even_clamped

QUALITY = "overall_winner string, qualities array<struct<evidence:string,quality:string,description:string>>"
WINNERS = "criteria array<struct<name:string,winner:string>>"
SCORES = "criteria array<struct<name:string,score:double>>"


def json_block(text: Column) -> Column:
    """From the first brace to the last, code fences and chatter left out; null without both."""
    t = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(t != "", t)


def _kept(items: Column) -> Column:
    return F.coalesce(items, F.array().cast("array<struct<evidence:string,quality:string,description:string>>"))


def comparative(text: Column) -> Column:
    """``struct<winner, qualities>``; null without a valid winner; qualities without a name are dropped, fields trimmed."""
    obj = F.from_json(json_block(text), QUALITY)
    tidy = lambda q: F.struct(F.trim(F.coalesce(q["evidence"], F.lit(""))).alias("evidence"), F.trim(q["quality"]).alias("quality"), F.trim(F.coalesce(q["description"], F.lit(""))).alias("description"))
    named = F.filter(_kept(obj["qualities"]), lambda q: F.coalesce(F.trim(q["quality"]), F.lit("")) != "")
    return F.when(obj["overall_winner"].isin("A", "B"), F.struct(obj["overall_winner"].alias("winner"), F.transform(named, tidy).alias("qualities")))


def winners(text: Column, names: Column) -> Column:
    """``array<struct<name, winner>>`` for an array of criterion names, by exact name (a later answer wins).

    By position only if no name matched and the numbers of answers and names agree.
    """
    items = F.coalesce(F.from_json(json_block(text), WINNERS)["criteria"], F.array().cast("array<struct<name:string,winner:string>>"))
    valid = F.filter(items, lambda x: x["name"].isNotNull() & x["winner"].isin("A", "B"))
    one = lambda n: F.element_at(F.transform(F.filter(valid, lambda x: F.trim(x["name"]) == n), lambda x: x["winner"]), -1)
    some = lambda n: F.exists(valid, lambda x: F.trim(x["name"]) == n)
    by_name = F.transform(F.filter(names, some), lambda n: F.struct(n.alias("name"), one(n).alias("winner")))
    by_place = F.filter(F.zip_with(names, items, lambda n, x: F.struct(n.alias("name"), x["winner"].alias("winner"))), lambda x: x["winner"].isin("A", "B"))
    return F.when((F.size(by_name) == 0) & (F.size(items) == F.size(names)), by_place).otherwise(by_name)


def pointwise(text: Column, names: Column, low: int = 0, high: int = 10) -> Column:
    """``array<struct<name, score>>``, scores rounded half to even and clamped; names as in ``winners``."""
    items = F.coalesce(F.from_json(json_block(text), SCORES)["criteria"], F.array().cast("array<struct<name:string,score:double>>"))
    score = lambda x: half_even_clamped(x["score"], low, high)
    valid = F.filter(items, lambda x: x["name"].isNotNull() & x["score"].isNotNull())
    some = lambda n: F.exists(valid, lambda x: F.trim(x["name"]) == n)
    one = lambda n: F.element_at(F.transform(F.filter(valid, lambda x: F.trim(x["name"]) == n), score), -1)
    by_name = F.transform(F.filter(names, some), lambda n: F.struct(n.alias("name"), one(n).alias("score")))
    by_place = F.filter(F.zip_with(names, items, lambda n, x: F.struct(n.alias("name"), score(x).alias("score"))), lambda x: x["score"].isNotNull())
    return F.when((F.size(by_name) == 0) & (F.size(items) == F.size(names)), by_place).otherwise(by_name)


def panel_fault(text: Column, names: Column, low: int = 0, high: int = 10) -> Column:
    """Why a panel answer is not usable, or null: empty, malformed, duplicate, unknown, missing or bad score."""
    block = json_block(text)
    raw = F.from_json(block, "criteria array<struct<name:string,score:string>>")["criteria"]
    found = F.transform(raw, lambda x: F.trim(x["name"]))
    whole = lambda s: s.rlike("^-?[0-9]+$")
    bad = F.exists(raw, lambda x: x["score"].isNull() | ~whole(x["score"]) | ~F.when(whole(x["score"]), F.try_to_number(x["score"], F.lit("S999999999")).between(low, high)).otherwise(False))
    return (
        F.when(F.coalesce(F.trim(text), F.lit("")) == "", "empty")
        .when(block.isNull() | raw.isNull(), "malformed")
        .when(F.size(F.array_distinct(found)) < F.size(found), "duplicate")
        .when(F.size(F.array_except(found, names)) > 0, "unknown")
        .when(F.size(F.array_except(names, found)) > 0, "missing")
        .when(bad, "bad score")
    )


def elicited(text: Column, exactly: int | None = None, least: int = 1) -> Column:
    """Features ``array<struct<name, description>>`` of an elicited panel, trimmed, blank names and evidence dropped.

    Null unless there are ``exactly`` so many or, without that, ``least`` of them and no name twice.
    """
    raw = F.from_json(json_block(text), "features array<struct<name:string,evidence:string,description:string>>")["features"]
    kept = F.transform(F.filter(raw, lambda x: F.coalesce(F.trim(x["name"]), F.lit("")) != ""), lambda x: F.struct(F.trim(x["name"]).alias("name"), F.trim(F.coalesce(x["description"], F.lit(""))).alias("description")))
    names = F.transform(kept, lambda x: x["name"])
    good = F.size(kept) == exactly if exactly is not None else (F.size(kept) >= least) & (F.size(F.array_distinct(names)) == F.size(names))
    return F.when(good, kept)


def verdict(text: Column) -> Column:
    """A or B from the answer's JSON field ``winner``, else from a phrase; null if neither."""
    by_json = F.get_json_object(json_block(text), "$.winner")
    by_phrase = F.upper(F.regexp_extract(text, r"(?i)\b(?:winner|answer|verdict)\W{0,5}([AB])\b", 1))
    return F.when(by_json.isin("A", "B"), by_json).otherwise(F.when(by_phrase.isin("A", "B"), by_phrase))


def request_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of the fields as JSON with sorted keys; null fields are left out."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)

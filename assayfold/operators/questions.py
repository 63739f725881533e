"""Typed questions and the bodies that carry them, as column expressions; texts are JSON without needless spaces.

A question row has instructions (string), criteria and options (map<string,string>) and levels (array<string>). Empty
maps and arrays count as none. Levels make a score, options a choice, and neither a yes/no, whose criteria are optional."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The state's key for a shared question.
SHARED = "guidance"


def given(x: Column) -> Column:
    """A map or an array that holds anything."""
    return F.coalesce(F.size(x) > 0, F.lit(False))


def kind(options: Column, levels: Column) -> Column:
    return F.when(given(levels), "score").when(given(options), "choice").otherwise("noul")


def typed(instructions: Column, criteria: Column, options: Column, levels: Column) -> Column:
    """The question as JSON: type, instructions and, where it has any, criteria."""
    put = lambda name, x: F.to_json(F.struct(F.lit(name).alias("type"), instructions.alias("instructions"), x.alias("criteria")))
    plain = F.to_json(F.struct(F.lit("noul").alias("type"), instructions.alias("instructions")))
    return F.when(given(levels), put("score", levels)).when(given(options), put("choice", options)).when(
        given(criteria), put("noul", criteria)
    ).otherwise(plain)


def guidance(instructions: Column, criteria: Column, options: Column, levels: Column) -> Column:
    """The question as one text for the state: of a yes/no its criteria follow as lines, the others keep theirs."""
    lines = F.transform(F.map_entries(criteria), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    whole = F.array_join(F.concat(F.array(instructions), lines), "\n")
    return F.when(given(options) | given(levels) | ~given(criteria), instructions).otherwise(whole)


def with_defaults(
    rows: DataFrame, instructions: str | None = None, criteria: dict | None = None, options: dict | None = None, levels: list | None = None
) -> DataFrame:
    """Rows with a question each, missing (null) parts taken from the call; empty parts are given ones and stay.

    A row without instructions, and one with both options and levels, stops the run with its place in the message."""
    as_map = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv]).cast("map<string,string>") if d is not None else F.lit(None).cast(
        "map<string,string>"
    )
    own = lambda name, type_: F.col(name) if name in rows.columns else F.lit(None).cast(type_)
    told = F.coalesce(own("instructions", "string"), F.lit(instructions).cast("string"))
    place = F.concat(F.lit("row "), (F.col("pos") + 1).cast("string"))
    told = F.coalesce(told, F.raise_error(F.concat(place, F.lit(" has no instructions"))).cast("string"))
    out = rows.withColumns({
        "criteria": F.coalesce(own("criteria", "map<string,string>"), as_map(criteria)),
        "options": F.coalesce(own("options", "map<string,string>"), as_map(options)),
        "levels": F.coalesce(
            own("levels", "array<string>"), F.array(*map(F.lit, levels)) if levels is not None else F.lit(None).cast("array<string>")
        ),
    })
    both = F.raise_error(F.concat(place, F.lit(" has options and levels"))).cast("string")
    return out.withColumn("instructions", F.when(given(F.col("options")) & given(F.col("levels")), both).otherwise(told))


def asked_of(position: Column, shared: Column) -> tuple[Column, Column]:
    """(the item's name, the instructions of its question in a pack)."""
    name = F.concat(F.lit("item_"), position.cast("string"))
    alone = F.concat(F.lit(" Answer for "), name, F.lit(" alone; no other item matters."))
    pointed = F.concat(F.lit("Answer the question in "), F.lit(SHARED), F.lit(" for "), name, F.lit(" alone; no other item matters."))
    return name, F.when(shared, pointed).otherwise(F.concat(F.col("instructions"), alone))


def bodies(packed: DataFrame, model: str, once: bool = False) -> DataFrame:
    """(pack_id, items, shared, body) of rows (pack_id, position, item and a question).

    A pack of one asks its question as it is. With `once`, a pack whose rows all ask the same, by value, carries the
    question in its state, and each item points at it."""
    question = [F.col(c) for c in ("instructions", "criteria", "options", "levels")]
    value = lambda m: F.to_json(F.array_sort(F.map_entries(m)))
    same = F.md5(
        F.concat_ws(
            "\x1f",
            F.col("instructions"),
            F.coalesce(value("criteria"), F.lit("-")),
            F.coalesce(value("options"), F.lit("-")),
            F.coalesce(F.to_json("levels"), F.lit("-")),
        )
    )
    rows = packed.withColumn("_same", same)
    packs = rows.groupBy("pack_id").agg(F.count("*").alias("items"), (F.min("_same") == F.max("_same")).alias("equal"))
    rows = rows.join(packs, "pack_id").withColumn("shared", F.lit(once) & F.col("equal") & (F.col("items") > 1))
    name, told = asked_of(F.col("position"), F.col("shared"))
    none = F.lit(None).cast("map<string,string>")
    asked = F.when(F.col("items") == 1, typed(*question)).otherwise(
        typed(told, F.when(F.col("shared"), none).otherwise(F.col("criteria")), *question[2:])
    )
    rows = rows.select("pack_id", "items", "shared", "position", name.alias("name"), "item", asked.alias("asked"), guidance(*question).alias("text"))
    entry = F.array_sort(F.collect_list(F.struct("position", "name", "item", "asked")))
    out = rows.groupBy("pack_id", "items", "shared").agg(entry.alias("rows"), F.min("text").alias("text"))
    quoted = lambda x: F.regexp_replace(F.to_json(F.array(x)), "^\\[|\\]$", "")
    state = F.transform("rows", lambda r: F.concat(quoted(r["name"]), F.lit(":"), quoted(r["item"])))
    state = F.when(F.col("shared"), F.concat(state, F.array(F.concat(F.lit(f'"{SHARED}":'), quoted(F.col("text")))))).otherwise(state)
    asked = F.transform("rows", lambda r: F.concat(quoted(r["name"]), F.lit(":"), r["asked"]))
    body = F.concat(
        F.lit('{"model":'),
        quoted(F.lit(model)),
        F.lit(',"state":{'),
        F.array_join(state, ","),
        F.lit('},"questions":{'),
        F.array_join(asked, ","),
        F.lit("}}"),
    )
    return out.select("pack_id", "items", "shared", body.alias("body"))


def quoted_length(text: Column) -> Column:
    """Characters of a string as JSON in ASCII: quotes, two for a short escape, six for another sign, twelve beyond the BMP."""
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    short, long, beyond = count(r'["\\\n\r\t\x08\f]'), count(r"[\x00-\x07\x0B\x0E-\x1F\x7F-\x{FFFF}]"), count(r"[\x{10000}-\x{10FFFF}]")
    return F.length(text) + 2 + short + 5 * long + 11 * beyond


def overhead(instructions: Column, criteria: Column, options: Column, levels: Column, once: bool = False) -> Column:
    """Characters that an item's question adds to a request, as JSON in ASCII with a space behind each comma and colon."""
    told = F.lit(f"Answer the question in {SHARED} for item_00 alone; no other item matters.") if once else instructions
    criteria = F.lit(None).cast("map<string,string>") if once else criteria
    add = lambda a, x: a + x
    of_map = lambda m: F.aggregate(
        F.transform(F.map_entries(m), lambda e: quoted_length(e["key"]) + quoted_length(e["value"]) + 2), F.lit(0), add
    ) + 2 * F.size(m)
    of_list = lambda x: F.aggregate(F.transform(x, quoted_length), F.lit(0), add) + 2 * F.size(x)
    more = F.when(given(levels), of_list(levels)).when(given(options), of_map(options)).when(given(criteria), of_map(criteria))
    base = F.length(F.concat(F.lit('{"type": "'), kind(options, levels), F.lit('", "instructions": }'))) + quoted_length(told)
    return base + F.coalesce(more + len(', "criteria": '), F.lit(0))

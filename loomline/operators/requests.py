"""Requests to judges as JSON columns, answers' texts by shape, and the ledger of reported numbers."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How the forced tool is described, and the model names that take the older chat fields.
TOOL_NOTE = "Record the comparison result."
OLDER_CHAT = ("gpt-4", "gpt-3")


def quoted(text: Column) -> Column:
    """A JSON string."""
    a = F.to_json(F.array(F.coalesce(text, F.lit(""))))
    return F.substring(a, F.lit(2), F.length(a) - 2)


def fields(*pairs: tuple[str, Column | str | None]) -> Column:
    """A JSON object of names and JSON values in this order; a null value leaves its name out."""
    parts = [F.concat(F.lit(json.dumps(n) + ":"), v if isinstance(v, Column) else F.lit(v)) for n, v in pairs if v is not None]
    return F.concat(F.lit("{"), F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), ","), F.lit("}"))


def _turn(role: str, text: Column) -> Column:
    return fields(("role", f'"{role}"'), ("content", quoted(text)))


def _list(*items: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]"))


def older_chat(model: Column) -> Column:
    out = F.lit(False)
    for prefix in OLDER_CHAT:
        out = out | model.startswith(prefix)
    return out


def body(kind: str, model: Column, system: Column, user: Column, most: int, temperature: float = 0.0, seed: int | None = None, schema: dict | None = None, effort: str | None = None, thinking: str | None = None) -> Column:
    """The request body of a provider's interface: ``chat``, ``responses``, ``messages``, ``generate`` or ``tool_chat``.

    ``schema``: ``{"name": ..., "schema": {...}}`` that the answer must keep to, by a response format where there is
    one and by a forced tool elsewhere. Optional fields that are not given are left out.
    """
    turns, cap, heat = _list(_turn("system", system), _turn("user", user)), F.lit(str(most)), F.lit(json.dumps(temperature))
    raw = (lambda x: json.dumps(x, separators=(",", ":"), ensure_ascii=False)) if schema else (lambda x: None)
    tool = raw(schema and {"name": schema["name"], "description": TOOL_NOTE, "input_schema": schema["schema"]})
    if kind == "chat":
        old = older_chat(model)
        return F.when(old, fields(("model", quoted(model)), ("messages", turns), ("max_tokens", cap), ("temperature", heat), ("seed", seed if seed is None else str(seed)))).otherwise(
            fields(("model", quoted(model)), ("messages", turns), ("max_completion_tokens", cap), ("reasoning_effort", effort and json.dumps(effort)))
        )
    if kind == "responses":
        text = raw(schema and {"format": {"type": "json_schema", **schema, "strict": True}})
        return fields(("model", quoted(model)), ("input", turns), ("max_output_tokens", cap), ("reasoning", effort and json.dumps({"effort": effort}, separators=(",", ":"))), ("text", text))
    if kind == "messages":
        choice = raw(schema and {"type": "tool", "name": schema["name"]})
        return fields(("model", quoted(model)), ("system", quoted(system)), ("messages", _list(_turn("user", user))), ("max_tokens", cap), ("temperature", heat), ("tools", tool and f"[{tool}]"), ("tool_choice", choice))
    if kind == "generate":
        part = lambda t: _list(fields(("text", quoted(t))))
        config = fields(("maxOutputTokens", cap), ("temperature", heat), ("responseMimeType", '"application/json"' if schema else None), ("responseSchema", raw(schema and ordered_schema(schema))), ("thinkingConfig", thinking and json.dumps({"thinkingLevel": thinking}, separators=(",", ":"))))
        return fields(("model", quoted(model)), ("contents", _list(fields(("role", '"user"'), ("parts", part(user))))), ("systemInstruction", fields(("parts", part(system)))), ("generationConfig", config))
    if kind == "tool_chat":
        call = raw(schema and {"type": "function", "function": {"name": schema["name"], "description": TOOL_NOTE, "parameters": schema["schema"], "strict": True}})
        choice = raw(schema and {"type": "function", "function": {"name": schema["name"]}})
        return fields(("model", quoted(model)), ("messages", turns), ("max_tokens", cap), ("temperature", heat), ("thinking", thinking and json.dumps({"type": thinking}, separators=(",", ":"))), ("tools", call and f"[{call}]"), ("tool_choice", choice))
    raise ValueError(f"no such interface: {kind}")


def ordered_schema(schema: dict) -> dict:
    """A JSON schema for providers that refuse ``additionalProperties`` and take an explicit order of properties."""
    todo = [(schema["schema"], root := {})]
    while todo:
        node, out = todo.pop()
        for name, value in node.items():
            if name == "properties":
                out[name] = {p: {} for p in value}
                out["propertyOrdering"] = list(value)
                todo += [(value[p], out[name][p]) for p in value]
            elif name == "items":
                out[name] = {}
                todo.append((value, out[name]))
            elif name != "additionalProperties":
                out[name] = value
    return root


def response_text(answer: Column) -> Column:
    """The text of a provider's answer (JSON), whichever of four shapes it has; empty where there is none.

    A chat choice's content, else a plain ``output_text``, else the joined text parts of ``output``, else the input of a
    used tool or, without one, the joined texts of ``content``.
    """
    part = "array<struct<content:array<struct<type:string,text:string>>>>"
    parts = F.flatten(F.transform(F.from_json(F.get_json_object(answer, "$.output"), part), lambda o: F.coalesce(o["content"], F.array().cast("array<struct<type:string,text:string>>"))))
    said = F.filter(parts, lambda p: p["type"].isin("output_text", "text") & (F.coalesce(p["text"], F.lit("")) != ""))
    blocks = F.from_json(F.get_json_object(answer, "$.content"), "array<struct<type:string,text:string,input:string>>")
    used = F.get(F.filter(blocks, lambda b: b["type"] == "tool_use"), F.lit(0))["input"]
    prose = F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]), "")
    return F.coalesce(F.get_json_object(answer, "$.choices[0].message.content"), F.get_json_object(answer, "$.output_text"), F.array_join(F.transform(said, lambda p: p["text"]), ""), used, prose, F.lit(""))


def ledger(records: DataFrame, key: str = "id") -> DataFrame:
    """``records``, or an error if a record's id repeats."""
    twice = [r[key] for r in records.groupBy(key).count().filter("count > 1").orderBy(key).limit(5).collect()]
    if twice:
        raise ValueError(f"ids of the ledger repeat: {twice}")
    return records


def fan_out(items: DataFrame, item: str, names: list[str], reps: int, variants: int, seed: str) -> DataFrame:
    """Each item once a replicate, with the wording variant and the criteria in an order of their own by hash."""
    from ..functions.numeric import md5_number

    each = items.select(item, F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    place = lambda n: md5_number(F.concat_ws(":", F.lit(seed), F.col(item).cast("string"), F.col("rep").cast("string"), n))
    order = F.array_sort(F.transform(F.array(*map(F.lit, names)), lambda n: F.struct(place(n).alias("h"), n.alias("name"))))
    return each.withColumns({"variant": F.col("rep") % variants, "criteria": F.transform(order, lambda x: x["name"])})


def with_backoff(call: Callable[..., Any], *args: Any, signs: tuple[str, ...] = ("rate limit", "overloaded", "timeout"), tries: int = 5, base: float = 3.0, sleep: Callable[[float], None] = time.sleep, **kwargs: Any) -> Any:
    """``call``, again after 3, 6, 12, ... seconds while its error names one of ``signs``; other errors pass at once."""
    for attempt in range(tries):
        try:
            return call(*args, **kwargs)
        except Exception as e:
            if attempt == tries - 1 or not any(s in str(e).lower() for s in signs):
                raise
            sleep(base * 2**attempt)

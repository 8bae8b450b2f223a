"""Text, id and JSON functions as column expressions."""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SLUG = r"^[a-z0-9]+(-[a-z0-9]+)*$"


def word_set(text: Column) -> Column:
    """Distinct runs of letters a-z and digits of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; of two empty sets, 1."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def fixed(c: Column, digits: int = 8) -> Column:
    """A double with so many decimals (10 at most), rounded as its exact binary value is, halves to the even digit, as C and Python print it.

    format_string rounds the shortest decimal that stands for the number instead, halves up. The fraction is taken in 2^-124ths, in two
    whole numbers; what has smaller bits is far from a half. Numbers from 1e15 on, infinities and NaN are left to format_string.
    """
    size = F.when(F.abs(c) < 1e15, F.abs(c)).otherwise(0.0)
    whole = F.floor(size).cast("long")
    units = (size - whole) * F.lit(float(2**62))
    high = units.cast("long")
    low = ((units - high) * F.lit(float(2**62))).cast("long")
    unit, half = (F.lit(str(n)).cast("decimal(19,0)") for n in (2**62, 2**61))
    times = lambda x: x.cast("decimal(19,0)") * F.lit(10**digits).cast("decimal(11,0)")
    scaled = times(high) + F.call_function("div", times(low), unit).cast("decimal(11,0)")
    over, quotient = scaled % unit, F.call_function("div", scaled, unit)
    up = (over > half) | ((over == half) & ((times(low) % unit != 0) | (quotient % 2 == 1)))
    decimals = quotient + up.cast("long")
    carry = F.when(decimals == 10**digits, 1).otherwise(0)
    sign = F.when((c < 0) | (c.cast("string") == "-0.0"), "-").otherwise("")
    text = F.concat(sign, (whole + carry).cast("string"), F.lit("."), F.lpad((decimals - carry * 10**digits).cast("string"), digits, "0"))
    return F.when(F.abs(c) < 1e15, text).when(c.isNotNull(), F.format_string(f"%.{digits}f", c))


def is_slug(c: Column) -> Column:
    return c.rlike(SLUG)


def is_trimmed(c: Column) -> Column:
    """Not empty and without white space at either end."""
    return (F.length(c) > 0) & (c == F.regexp_replace(c, r"^\s+|\s+$", ""))


def strip_route_suffix(model: Column) -> Column:
    return F.regexp_replace(model, r":(free|batch)$", "")


def canonical_json(c: Column) -> Column:
    """Compact JSON of a struct whose fields are already in order; nulls are written."""
    return F.to_json(c, {"ignoreNullFields": "false"})


def cell_id(instruction: Column, framing: Column, channel: Column, author: Column, assistant: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the cell's canonical JSON."""
    spec = F.struct(author.alias("author"), channel.alias("channel"), framing.alias("framing"), instruction.alias("instruction"))
    return F.substring(F.sha2(canonical_json(F.struct(assistant.alias("assistant"), spec.alias("input"))), 256), 1, 16)


def trial_id(study: Column, permutation: Column, rollout: Column) -> Column:
    return F.format_string("%s-permutation-%06d-rollout-%04d", study, permutation, rollout)


def response_id(payload: Column) -> Column:
    """The JSON payload's id where it is a string, else null."""
    raw = F.get_json_object(payload, "$.id")
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(payload), "$.id", "variant"))
    return F.when(kind == "STRING", raw)


def strict_boolean(payload: Column, field: str) -> Column:
    """The field where the payload is an object with that boolean alone, else null."""
    found = F.try_variant_get(F.try_parse_json(payload), f"$.{field}", "variant")
    return F.when((F.size(F.json_object_keys(payload)) == 1) & (F.schema_of_variant(found) == "BOOLEAN"), found.cast("boolean"))


def tool_call_id(assistant: Column, identity: Column, long_prefix: str = "Qwen3.8 2.4T") -> Column:
    """Id of a tool call in the assistant's own form; no built-in function has BLAKE2s, so batches go through Arrow."""

    @F.arrow_udf("string")
    def digest(text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else hashlib.blake2s(t.encode(), digest_size=16).hexdigest() for t in text.to_pylist()], pa.string())

    d = digest(identity)
    return F.when(assistant == long_prefix, F.concat(F.lit("chatcmpl-tool-"), F.substring(d, 1, 16))).otherwise(F.concat(F.lit("call_"), F.substring(d, 1, 24)))


def response_fingerprint(payload: Column) -> Column:
    """SHA-256 of a response's canonical JSON, its model without a route's suffix; null where it is no JSON object."""

    @F.arrow_udf("string")
    def digest(text: pa.Array) -> pa.Array:
        out = []
        for t in text.to_pylist():
            try:
                found = json.loads(t) if t is not None else None
            except ValueError:
                found = None
            if not isinstance(found, dict):
                out.append(None)
                continue
            if isinstance(found.get("model"), str):
                found["model"] = re.sub(r":(free|batch)$", "", found["model"])
            out.append(hashlib.sha256(json.dumps(found, sort_keys=True, separators=(",", ":")).encode()).hexdigest())
        return pa.array(out, pa.string())

    return digest(payload)


def pair_audit(content: Column) -> Column:
    """The audit of a pair of instructions where the content is exactly that, else null.

    {first, second: {feasible, requires_tools, difficulty}, mutually_exclusive, issues}, with booleans, whole numbers
    from 1 to 5 and a list of strings.
    """
    parsed = F.try_parse_json(content)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))
    value = lambda path, of: F.try_variant_get(parsed, path, of)
    keys = lambda c, *names: F.coalesce(F.sort_array(F.json_object_keys(c)) == F.array(*map(F.lit, sorted(names))), F.lit(False))
    ok = keys(content, "first", "second", "mutually_exclusive", "issues") & (kind("$.mutually_exclusive") == "BOOLEAN") & kind("$.issues").isin("ARRAY<STRING>", "ARRAY<VOID>")
    sides = []
    for side in ("first", "second"):
        at = f"$.{side}"
        ok = ok & keys(F.get_json_object(content, at), "feasible", "requires_tools", "difficulty") & (kind(f"{at}.feasible") == "BOOLEAN") & (kind(f"{at}.requires_tools") == "BOOLEAN")
        ok = ok & (kind(f"{at}.difficulty") == "BIGINT") & value(f"{at}.difficulty", "int").between(1, 5)
        sides.append(F.struct(value(f"{at}.feasible", "boolean").alias("feasible"), value(f"{at}.requires_tools", "boolean").alias("requires_tools"), value(f"{at}.difficulty", "int").alias("difficulty")).alias(side))
    issues = F.from_json(F.get_json_object(content, "$.issues"), "array<string>")
    return F.when(F.coalesce(ok, F.lit(False)), F.struct(*sides, value("$.mutually_exclusive", "boolean").alias("mutually_exclusive"), issues.alias("issues")))


def is_written(content: Column, placeholder: str = "TODO:") -> Column:
    """Whether a text is there and not just a placeholder."""
    text = F.regexp_replace(content, r"^\s+|\s+$", "")
    return F.coalesce((text != "") & ~F.startswith(text, F.lit(placeholder)), F.lit(False))


def ordered_inputs(inputs: Column, permutation: Column) -> Column:
    """The two inputs in the order of a permutation."""
    return F.when(permutation == 2, F.reverse(inputs)).otherwise(inputs)


def response_content(payload: Column) -> Column:
    """Content of the first choice of a response."""
    return F.get_json_object(payload, "$.choices[0].message.content")


def tool_calls(payload: Column) -> Column:
    """Names and arguments of the first choice's tool calls."""
    raw = F.get_json_object(payload, "$.choices[0].message.tool_calls")
    calls = F.from_json(raw, "array<struct<id:string,function:struct<name:string,arguments:string>>>")
    return F.transform(calls, lambda c: F.struct(c["id"].alias("id"), c["function"]["name"].alias("name"), c["function"]["arguments"].alias("arguments")))


def verdict_with_issues(payload: Column) -> Column:
    """{complies, issues} where the payload is exactly that and complies means no issues, else null."""
    parsed = F.try_parse_json(payload)
    complies = F.try_variant_get(parsed, "$.complies", "variant")
    keys = F.sort_array(F.json_object_keys(payload)) == F.array(F.lit("complies"), F.lit("issues"))
    issues = F.from_json(F.get_json_object(payload, "$.issues"), "array<string>")
    flag = F.when(F.schema_of_variant(complies) == "BOOLEAN", complies.cast("boolean"))
    return F.when(keys & (flag == (F.size(issues) == 0)), F.struct(flag.alias("complies"), issues.alias("issues")))

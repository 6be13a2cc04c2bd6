"""Tool definitions: docs, stubs, stripped schemas, catalog."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ctxledger.functions.text import u16len

#: Which schema keys go, and how keys lead to subschemas.
DEPTH, FORMAT_MOST = 20, 32
DROP = ("description", "title", "examples", "default", "$id", "$comment")
BY_NAME = ("properties", "patternProperties", "definitions", "$defs")
BY_ITEM = ("oneOf", "anyOf", "allOf")
SINGLE = ("items", "additionalProperties", "not", "contains", "propertyNames", "unevaluatedItems", "unevaluatedProperties", "if", "then", "else")
VERBATIM = ("enum", "const", "required", "type")
STRUCTURE = ("properties", "patternProperties", "oneOf", "anyOf", "allOf", "items", "$ref", "enum", "const")


def strip_value(node, depth: int = 0):
    """A schema node without its prose; names of properties are never prose."""
    if depth > DEPTH or not isinstance(node, dict):
        return node
    out = {}
    for key, value in node.items():
        if key in DROP or key == "format" and isinstance(value, str) and len(value) > FORMAT_MOST:
            continue
        if key in VERBATIM:
            pass
        elif key in BY_NAME and isinstance(value, dict):
            value = {k: strip_value(v, depth + 1) for k, v in value.items()}
        elif (key in BY_ITEM or key in SINGLE) and isinstance(value, list):
            value = [strip_value(v, depth + 1) for v in value]
        elif isinstance(value, dict):
            value = strip_value(value, depth + 1)
        out[key] = value
    return out


@F.pandas_udf(StringType())
def strip_schema(schemas: pd.Series) -> pd.Series:
    """Schemas without prose, key order kept; text that is not an object with structure stays as it is."""

    def one(raw):
        try:
            node = json.loads(raw)
        except (TypeError, ValueError):
            return raw
        if not isinstance(node, dict) or not any(k in node for k in STRUCTURE):
            return raw
        return json.dumps(strip_value(node), ensure_ascii=False, separators=(",", ":"))

    memo = {s: one(s) for s in schemas.unique()}
    return schemas.map(memo)


#: Fixed value: the prose keys that annotation lines name, in order.
PROSE = ("description", "title", "examples", "default", "$comment")


def _json(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _below(node, path: str) -> list:
    """(path, subschema) of each node right under a schema node or list, in order."""
    if isinstance(node, list):
        return [(f"{path}[{i}]", x) for i, x in enumerate(node)]
    named = [(f"{path}.{name}", x) for key in BY_NAME if isinstance(node.get(key), dict) for name, x in node[key].items()]
    listed = [(f"{path}.{key}[{i}]", x) for key in BY_ITEM if isinstance(node.get(key), list) for i, x in enumerate(node[key])]
    return named + listed + [(f"{path}.{key}", node[key]) for key in SINGLE if key in node]


def annotations(schema) -> list[str]:
    """``path key: value`` lines of the prose that strip_value takes out of a schema, from its root ``$`` down."""
    out, open_ = [], [("$", schema, 0)]
    while open_:
        path, node, depth = open_.pop()
        if depth > DEPTH or not isinstance(node, dict | list):
            continue
        if isinstance(node, dict):
            out += [f"{path} {key}: {_json(node[key])}" for key in PROSE if key in node]
            if isinstance(node.get("format"), str) and len(node["format"]) > FORMAT_MOST:
                out.append(f"{path} format: {_json(node['format'])}")
        open_ += [(p, x, depth + 1) for p, x in reversed(_below(node, path))]
    return out


@F.pandas_udf(StringType())
def annotation_lines(schemas: pd.Series) -> pd.Series:
    """The annotations of each schema text, one a line; empty where there are none or the text is no JSON."""

    def one(raw):
        try:
            return "\n".join(annotations(json.loads(raw)))
        except (TypeError, ValueError):
            return ""

    memo = {s: one(s) for s in schemas.unique()}
    return schemas.map(memo)


def annotated_doc(name: Column, description: Column, schema: Column) -> Column:
    """A stub's documentation: its name, description and the prose of its schema; null where there is neither."""
    lines, told = annotation_lines(schema), F.coalesce(description, F.lit("")) != ""
    text = F.concat(F.lit("## Tool: "), name, F.when(told, F.concat(F.lit("\n"), description)).otherwise(""), F.when(lines != "", F.concat(F.lit("\n"), lines)).otherwise(""))
    return F.when(told | (lines != ""), text)


def eligible_tools(tools: DataFrame) -> DataFrame:
    """Tools that may be rewritten: untyped or custom, not deferred."""
    return tools.where((F.coalesce("type", F.lit("custom")) == "custom") & ~F.coalesce("defer_loading", F.lit(False)))


def tool_doc(name: Column, description: Column, schema: Column) -> Column:
    text = F.concat(F.lit("## Tool: "), F.when(F.coalesce(name, F.lit("")) == "", "?").otherwise(name))
    text = F.concat(text, F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit("\n"), description)).otherwise(""))
    return F.concat(text, F.when(schema.isNotNull(), F.concat(F.lit("\n```json\n"), schema, F.lit("\n```"))).otherwise(""))


def tool_docs(tools: DataFrame) -> DataFrame:
    """The documentation text of each request's eligible tools, in order."""
    rows = eligible_tools(tools).withColumn("doc", tool_doc(F.col("name"), F.col("description"), F.col("schema_json")))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("tool_idx", "doc"))), lambda x: x["doc"])
    return rows.groupBy("request_id").agg(F.array_join(parts, "\n\n").alias("docs"))


def rewrite_plan(tools: DataFrame) -> DataFrame:
    """Eligible tools with their stub, stripped schema, and characters before and after. Schemas are stripped once a distinct text."""
    rows = eligible_tools(tools)
    distinct = rows.select("schema_json").where("schema_json is not null").distinct().withColumn("stripped", strip_schema("schema_json"))
    stub = F.concat(F.lit('Full docs: see "## Tool: '), F.col("name"), F.lit('" in the tool reference.'))
    out = rows.join(distinct, "schema_json", "left").withColumn("stub", stub)

    def size(*cols):
        return sum((F.coalesce(u16len(F.col(c)), F.lit(0)) for c in cols), F.lit(0))

    return out.withColumns({"chars_before": size("description", "schema_json"), "chars_after": size("stub", "stripped")})


def tool_catalog(tools: DataFrame) -> DataFrame:
    """Per distinct tool over the corpus: requests that use it, characters of its docs, characters that its stub saves."""
    plan = rewrite_plan(tools)
    return plan.groupBy("name", F.sha2("schema_json", 256).alias("schema_sha")).agg(
        F.countDistinct("request_id").alias("requests"), F.max("chars_before").alias("doc_chars"), F.sum(F.col("chars_before") - F.col("chars_after")).alias("saved_chars"))

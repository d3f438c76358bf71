"""Values that tasks hand on: extraction from output, JSON paths, text forms."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def json_in_output(output: str | Column) -> Column:
    """The whole output if it is JSON, else its last line that starts like an array or object and parses, else a first line that is JSON, else the output."""
    out = _c(output)
    lines = F.transform(F.split(out, "\n", -1), F.rtrim)
    # Each candidate is parsed only where those before it are no JSON.
    good = F.filter(F.reverse(lines), lambda x: x.rlike(r"^[\[{]") & F.try_parse_json(x).isNotNull())
    first = F.filter(F.slice(lines, 1, 1), lambda x: F.try_parse_json(x).isNotNull())
    return F.coalesce(F.when(F.try_parse_json(out).isNotNull(), out), F.get(good, F.lit(0)), F.get(first, F.lit(0)), out)


def parsed_output(output: str | Column) -> Column:
    """VARIANT of ``json_in_output``, null if that is no JSON; every candidate is parsed once."""
    out = _c(output)
    lines = F.transform(F.split(out, "\n", -1), F.rtrim)
    tried = F.filter(F.reverse(lines), lambda x: x.rlike(r"^[\[{]"))
    last = F.get(F.filter(F.transform(tried, F.try_parse_json), lambda v: v.isNotNull()), F.lit(0))
    return F.coalesce(F.try_parse_json(out), last, F.try_parse_json(F.get(lines, F.lit(0))))


def regex_group(text: str | Column, pattern: str, group: int = 0) -> Column:
    """A group of the first match, null without one. A pattern or group that can't be is an error at once."""
    if group > re.compile(pattern).groups:
        raise ValueError(f"pattern has no group {group}")
    t = _c(text)
    return F.when(t.rlike(pattern), F.regexp_extract(t, pattern, group))


def json_path(value: Column, path: str | Column) -> Column:
    """The part of a VARIANT at ``a.b[0].c`` (a leading dot is allowed, an empty path is the whole); null if there is none."""
    p = F.regexp_replace(_c(path) if isinstance(path, Column) else F.lit(path), r"^\.", "")
    full = F.when(p == "", "$").when(p.startswith("["), F.concat(F.lit("$"), p)).otherwise(F.concat(F.lit("$."), p))
    return F.try_variant_get(value, full, "variant")


def text_form(value: Column) -> Column:
    """Text of a VARIANT: strings as they are, whole numbers, other numbers with six decimals, true or false, else JSON."""
    kind = F.schema_of_variant(value)
    decimal = kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT")
    number = F.try_variant_get(value, "$", "double")
    return F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).when(decimal, F.format_string("%f", number)).otherwise(F.to_json(value))


def extracted(results: DataFrame, key: str, source: str, path: str | None = None, pattern: str | None = None, group: int = 0) -> DataFrame:
    """Adds xkey, value (VARIANT) and error for one push rule over results (exit_code, stdout, stderr)."""
    if source == "exit_code":
        return results.withColumns({"xkey": F.lit(key), "value": F.col("exit_code").cast("variant"), "error": F.lit(None).cast("string")})
    text = F.col("stderr" if source == "stderr" else "stdout")
    if pattern is not None:
        text = regex_group(text, pattern, group)
    if source == "json" or path:
        results = results.withColumn("_text", text).withColumn("_whole", parsed_output("_text"))
        results = results.withColumn("value", json_path(F.col("_whole"), path or ""))
        error = F.when(F.col("_text").isNull(), "NotFound").when(F.col("_whole").isNull(), "ParseError").when(F.col("value").isNull(), "NotFound")
        return results.withColumns({"xkey": F.lit(key), "error": error}).drop("_text", "_whole")
    else:
        value, error = text.cast("variant"), F.when(text.isNull(), "NotFound")
    return results.withColumns({"xkey": F.lit(key), "value": value, "error": error})


def all_or_nothing(extractions: DataFrame, keys: list[str]) -> DataFrame:
    """Values of the tasks none of whose rules failed. The extraction runs once: one window by task tells of failures."""
    failures = F.count("error").over(Window.partitionBy(*keys))
    return extractions.withColumn("_failures", failures).where("_failures = 0").drop("error", "_failures")


def dependency_list(text: str | Column) -> Column:
    """array<struct<task,label>> of a JSON array of task ids or {task, label} objects."""
    items = F.try_parse_json(_c(text)).try_cast("array<variant>")
    plain = lambda v: F.schema_of_variant(v) == "STRING"
    task = lambda v: F.when(plain(v), F.try_variant_get(v, "$", "string")).otherwise(F.try_variant_get(v, "$.task", "string"))
    label = lambda v: F.when(~plain(v), F.try_variant_get(v, "$.label", "string"))
    return F.transform(items, lambda v: F.struct(task(v).alias("task"), F.coalesce(label(v), F.lit("")).alias("label")))


def dependency_json(deps: str | Column) -> Column:
    """JSON of dependencies: a text for a plain one, an object for a labelled one."""
    plain = lambda d: F.regexp_extract(F.to_json(F.array(d["task"])), r"(?s)^\[(.*)\]$", 1)
    item = lambda d: F.when(d["label"] == "", plain(d)).otherwise(F.to_json(F.struct(d["task"].alias("task"), d["label"].alias("label"))))
    return F.concat(F.lit("["), F.array_join(F.transform(deps, item), ","), F.lit("]"))

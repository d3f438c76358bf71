"""Text, template and identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ds(t: str | Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd")


def ts(t: str | Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")


def date_values(execution: str | Column, start: str | Column | None = None, end: str | Column | None = None) -> dict[str, Column]:
    """Template variables of a run's dates; those of an unset date are null and not replaced."""
    unset = F.lit(None).cast("timestamp")
    interval = lambda t: F.date_format(unset if t is None else t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return {
        "ds": ds(execution), "ds_nodash": F.date_format(execution, "yyyyMMdd"), "ts": ts(execution), "ts_nodash": F.date_format(execution, "yyyyMMdd'T'HHmmss"),
        "data_interval_start": interval(start), "data_interval_end": interval(end),
    }


def resolve_template(template: str | Column, values: dict[str, Column], xcoms: Column | None = None) -> Column:
    """Replaces ``{{name}}`` and ``{{xcom.task.key}}`` from left to right.

    White space inside the braces is trimmed, ``\\{{`` stands for ``{{``, unclosed and unknown names stay as they are, and what was put
    in is not looked at again. ``xcoms`` maps ``task.key`` to text; the task ends at the first dot.
    """
    parts = F.regexp_extract_all(_c(template), F.lit(r"(?s)(\\\{\{|\{\{.*?\}\}|.)"), F.lit(1))
    values = values or {"ds": F.lit(None)}
    known = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in values.items()]), lambda e: e["v"].isNotNull()))

    def part(p: Column) -> Column:
        name = F.btrim(F.substring(p, F.lit(3), F.length(p) - 4), F.lit(" \t\n\x0b\x0c\r"))
        value = F.element_at(known, name)
        if xcoms is not None:
            value = F.when(name.startswith("xcom."), F.element_at(xcoms, F.substring(name, F.lit(6), F.length(name)))).otherwise(value)
        return F.when(p == r"\{{", "{{").when(p.startswith("{{") & (F.length(p) > 3), F.coalesce(value, p)).otherwise(p)

    return F.array_join(F.transform(parts, part), "")


def replace_all(text: str | Column, values: dict[str, Column]) -> Column:
    """Literal replacement of ``{{name}}``, one name after the other; no space inside the braces."""
    out = _c(text)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def shell_prefix(env: str | Column) -> Column:
    """``KEY='value' `` for each entry of a map, by key; quotes in values are closed, escaped and opened again."""
    entries = F.array_sort(F.map_entries(env))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("='"), F.replace(e["value"], F.lit("'"), F.lit("'\\''")), F.lit("' "))), "")


def preview(text: str | Column, size: int = 80) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(_c(text))


def truncated(text: str | Column, size: int = 10 << 20) -> Column:
    """The first ``size`` bytes of a text; a character that is cut in two becomes U+FFFD."""
    t = _c(text)
    return F.when(F.octet_length(t) > size, F.make_valid_utf8(F.substring(t.cast("binary"), 1, size).cast("string"))).otherwise(t)


def words_of(text: str | Column, separator: str) -> Column:
    """Trimmed parts between separators, without empty ones."""
    return F.filter(F.transform(F.split(text, separator), F.trim), lambda x: x != "")


def log_level(stream: str | Column, message: str | Column) -> Column:
    m = _c(message)
    return (
        F.when(_c(stream) == "stderr", "ERROR").when(m.contains("[ERROR]") | m.contains("failed"), "ERROR").when(m.contains("[SUCCESS]") | m.contains("completed"), "SUCCESS")
        .when(m.contains("[WARN]"), "WARN").when(m.contains("[DEBUG]"), "DEBUG").otherwise("INFO")
    )


def run_id(dag_id: str | Column, suffix: str | Column) -> Column:
    return F.concat_ws("_", dag_id, suffix)


def url_parts(url: str | Column) -> Column:
    """struct(host, port, path) of an http URL; null for other schemes and ports outside 1 to 65535."""
    u = _c(url)
    host = F.regexp_extract(u, r"^http://([^/:?#]+)", 1)
    port = F.regexp_extract(u, r"^http://[^/:?#]+:(\d+)", 1)
    number = F.when(port == "", 80).otherwise(port.try_cast("int"))
    path = F.regexp_extract(u, r"^http://[^/?#]+([/?].*)$", 1)
    good = (host != "") & number.between(1, 65535) & u.rlike(r"^http://[^/:?#]+(:\d+)?([/?#].*)?$")
    return F.when(good, F.struct(host.alias("host"), number.alias("port"), F.when(path == "", "/").otherwise(path).alias("path")))


def iso(t: str | Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ``, empty for an unset time."""
    return F.coalesce(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))


def from_millis(ms: str | Column) -> Column:
    """Timestamp of epoch milliseconds, of which 0 means unset."""
    return F.timestamp_millis(F.nullif(_c(ms), F.lit(0)))


def day_or_null(text: str | Column) -> Column:
    """A timestamp from ``YYYY-MM-DD``; null for any other text."""
    return F.when(_c(text).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(_c(text), F.lit("yyyy-MM-dd")))


def duration_text(seconds: str | Column) -> Column:
    """``h m``, ``m s`` or ``s``; ``-`` if negative or unset."""
    s = _c(seconds).cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    short = F.when(h > 0, F.format_string("%dh %dm", h, m)).when(m > 0, F.format_string("%dm %ds", m, r)).otherwise(F.format_string("%ds", r))
    return F.when(s >= 0, short).otherwise("-")


def exit_status(status: str | Column) -> Column:
    """Exit code of a wait status: the code, 128 and the signal, or -1 for anything else."""
    s = _c(status)
    signal = s.bitwiseAND(127)
    return F.when(signal == 0, F.shiftright(s, 8).bitwiseAND(255)).when(signal != 127, signal + 128).otherwise(-1)


def backoff_ms(attempt: str | Column) -> Column:
    return F.least(F.lit(30000), 1000 * F.pow(F.lit(2.0), _c(attempt))).cast("int")


def with_default(value: str | Column, built_in, default: str | Column) -> Column:
    """A default applies where the value is the built-in one, which an explicit value can't be told from."""
    return F.when(_c(value) == F.lit(built_in), F.coalesce(_c(default), _c(value))).otherwise(_c(value))


def percent_encoded(text: str | Column) -> Column:
    """All but letters, digits and ``-_.~`` as UTF-8 bytes in hexadecimal."""
    encoded = F.url_encode(_c(text))
    return F.replace(F.replace(F.replace(encoded, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def valid_env_key(text: str | Column) -> Column:
    return _c(text).rlike(r"^[A-Za-z_][A-Za-z0-9_]*$")


def valid_container_id(text: str | Column) -> Column:
    """Names and ids of containers: letters, digits and ``_.-``, the first a letter or digit."""
    return _c(text).rlike(r"^[A-Za-z0-9][A-Za-z0-9_.-]*$")

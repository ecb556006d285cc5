"""Raw log lines of several formats into one event schema.

Every parser is a column: null or an empty array where a line is not its format. One pass
over the lines picks the parser by line and explodes what it found.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchtide.functions.text import strip

# Severities of numeric scales and words.
CEF_SEVERITY = ("info", "info", "info", "low", "low", "medium", "medium", "high", "high", "critical", "critical")
SYSLOG_SEVERITY = ("critical", "critical", "critical", "high", "medium", "low", "info", "info")
SEVERITY_WORDS = {
    "critical": ("critical", "fatal", "emerg", "alert", "crit"),
    "high": ("high", "error", "err"),
    "medium": ("medium", "warn", "warning", "moderate"),
    "low": ("low", "notice"),
}
# Category patterns, first match counts.
CATEGORIES = (
    ("auth", "login|auth|password|credential|ssh|logon|logoff|kerberos|ldap"),
    ("network", "firewall|tcp|udp|packet|flow|nat|dns|http|tls|port|scan|ddos|syn"),
    ("endpoint", "process|registry|file|malware|endpoint|host|agent|driver"),
    ("application", "app|api|request|response|sql|exception|error|deploy"),
)
# Field names tried in order.
JSON_FIELDS = {
    "event_type": ("event_type", "eventType", "eventName", "type", "action"),
    "message": ("message", "msg", "description", "detail"),
    "source": ("source", "sourceIPAddress", "host", "hostname", "ip"),
    "severity": ("severity", "level", "priority"),
    "time": ("timestamp", "eventTime", "time", "@timestamp"),
}
KV_FIELDS = {
    "event_type": ("event_type", "type", "action", "cmd"),
    "message": ("message", "msg"),
    "source": ("src", "host", "source", "ip"),
    "severity": ("severity", "level"),
    "time": ("timestamp", "time", "ts"),
}
CEF_TIME = ("end", "rt", "deviceReceiptTime")
CEF_SOURCE = ("src", "sourceAddress", "dhost")
# Line patterns.
CEF_LINE = r"(?i)^CEF:\d+\|(?:[^|]*\|){5}\d+\|"
RFC5424_LINE = r"^<\d+>\d+\s+(?:\S+\s+){5}"
RFC3164_LINE = r"^<\d{1,4}>"
RFC3164_TIME = r"^[A-Za-z]{3}\s+\d+\s+\d{2}:\d{2}:\d{2}$"
PAIR_BREAK = r"\s(?=[A-Za-z0-9_]+=)"
# Characters of a line that stand in for a message it lacks, where those are to be short.
MESSAGES = {"raw": 500, "json": 200}


def _cut(text: Column, messages: Mapping[str, int] | None, kind: str) -> Column:
    """The whole text, or the first characters of it where a number is given for the kind."""
    return F.substring(text, 1, messages[kind]) if messages and kind in messages else text


def _from_scale(level: Column, scale: Sequence[str]) -> Column:
    names = F.array(*[F.lit(s) for s in scale])
    return F.coalesce(F.get(names, level.cast("int")), F.lit("info"))


def severity_of_number(level: Column) -> Column:
    """0-10 scale, values outside clamped, fractions unknown."""
    clamped = F.least(F.greatest(level, F.lit(0)), F.lit(10))
    whole = F.when(clamped == F.floor(clamped), clamped)
    return _from_scale(whole, CEF_SEVERITY)


def severity_of_word(word: Column) -> Column:
    low = F.lower(word)
    out = F
    for name, words in SEVERITY_WORDS.items():
        out = out.when(low.isin(*words), name)
    return out.otherwise("info")


def infer_category(event_type: Column, message: Column) -> Column:
    return category_of(F.concat(event_type, F.lit(" "), message))


def category_of(text: Column) -> Column:
    text = F.lower(text)
    out = F
    for name, pattern in CATEGORIES:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("system")


def detect_format(line: Column) -> Column:
    t = strip(line)
    return (
        F.when(t.rlike("(?i)^CEF:"), "cef")
        .when(t.rlike(r"^<\d+>"), "syslog")
        .when(t.rlike(r"^[{\[]"), "json")
        .otherwise("kv")
    )


def _first(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def _field(fields: Column, names: Sequence[str]) -> Column:
    return _first(*[fields[n] for n in names])


def _after(text: Column, mark: str) -> Column:
    """What follows the first ``mark``; the text holds one."""
    return F.substr(text, F.position(F.lit(mark), text) + len(mark))


def _pairs(text: Column, unquote: bool) -> Column:
    """Array of (k, v) of the key=value tokens, repeats included."""

    def pair(token: Column) -> Column:
        value = strip(_after(token, "="))
        if unquote:
            quoted = F.startswith(value, F.lit('"')) & F.endswith(value, F.lit('"'))
            inner = F.substr(value, F.lit(2), F.length(value) - 2)
            value = F.when(quoted & (F.length(value) >= 2), inner).otherwise(value)
        return F.struct(strip(F.substring_index(token, "=", 1)).alias("k"), value.alias("v"))

    tokens = F.filter(F.split(text, PAIR_BREAK), lambda t: F.position(F.lit("="), t) > 1)
    return F.filter(F.transform(tokens, pair), lambda p: p["k"] != "")


def _as_map(pairs: Column) -> Column:
    """Later values of a key replace earlier ones."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    last = F.transform(
        keys,
        lambda k: F.struct(
            k.alias("k"), F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"].alias("v")
        ),
    )
    return F.map_from_entries(F.when(F.size(keys) == F.size(pairs), pairs).otherwise(last))


def json_objects(line: Column) -> Column:
    """Texts of a line's JSON objects: itself, or the elements of an array or of its Records.

    A line that is one object, the usual case, is not parsed here: whether it is JSON shows
    when its fields are read.
    """
    strings = "array<string>"
    records = F.get_json_object(line, "$.Records")
    is_list = F.startswith(line, F.lit("["))
    many = F.when(is_list, F.from_json(line, strings)).when(
        F.startswith(records, F.lit("[")), F.from_json(records, strings)
    )
    nested = is_list | F.contains(line, F.lit('"Records"'))
    valid = F.try_parse_json(line).isNotNull()
    return F.when(nested, F.when(valid, F.coalesce(many, F.array(line)))).otherwise(F.array(line))


def _syslog_parts(t: Column) -> Column:
    """pri, time, host, tag and message of either syslog form, then its name; or null."""
    pri = F.substring_index(_after(t, "<"), ">", 1)
    words = F.split(t, r"\s+", 7)
    new = F.array(pri, words[1], words[2], words[3], words[6], F.lit("syslog-rfc5424"))
    rest = strip(_after(t, ">"))
    after_time = strip(F.substr(rest, F.lit(16)))
    host = F.substring_index(after_time, " ", 1)
    after_host = strip(_after(after_time, " "))
    tag = F.substring_index(after_host, ":", 1)
    old = F.array(
        pri, F.substring(rest, 1, 15), host, tag, strip(_after(after_host, ":")), F.lit("syslog-rfc3164")
    )
    is_old = (
        t.rlike(RFC3164_LINE)
        & (F.length(rest) >= 16)
        & F.substring(rest, 1, 15).rlike(RFC3164_TIME)
        & (F.position(F.lit(" "), after_time) > 1)
        & (F.position(F.lit(":"), after_host) > 1)
    )
    return F.when(t.rlike(RFC5424_LINE), new).when(is_old, old)


def _json_event(now: Column, messages: Mapping[str, int] | None) -> dict[str, Column]:
    """Event columns of ``_object``; numbers and texts differ for severity and time."""
    def is_text(name: str) -> str:
        return f"""schema_of_variant(try_variant_get(_typed, "$['{name}']", 'variant')) = 'STRING'"""

    def truthy(name: str) -> str:
        return (
            f"if(_fields['{name}'] in ('0', '0.0', 'false') and not {is_text(name)}, null, "
            f"nullif(_fields['{name}'], ''))"
        )

    def number(name: str) -> Column:
        return F.expr(
            f"if(_fields['{name}'] rlike '^-?[0-9.]+([eE][-+]?[0-9]+)?$' and not {is_text(name)}, "
            f"try_cast(_fields['{name}'] as double), null)"
        )

    def first(names: Sequence[str], default: Column) -> Column:
        return F.coalesce(F.expr(f"coalesce({', '.join(truthy(n) for n in names)})"), default)

    def by_kind(names: Sequence[str], of_number, of_text, default: Column) -> Column:
        chosen = " ".join(f"when {truthy(n)} is not null then '{n}'" for n in names)
        value, out = F.expr(f"case {chosen} end"), F
        for n in names:
            text, num = F.expr(f"_fields['{n}']"), number(n)
            out = out.when(value == n, F.coalesce(of_number(num), of_text(text)))
        return out.otherwise(default)

    event_type = first(JSON_FIELDS["event_type"], F.lit("generic_event"))
    message = first(JSON_FIELDS["message"], _cut(F.col("_object"), messages, "json"))
    return {
        "ts": by_kind(
            JSON_FIELDS["time"],
            lambda n: F.timestamp_millis(n.cast("long")),
            F.try_to_timestamp,
            now,
        ),
        "source": first(JSON_FIELDS["source"], F.lit("unknown")),
        "severity": by_kind(
            JSON_FIELDS["severity"],
            lambda n: F.when(n.isNotNull(), severity_of_number(n)),
            severity_of_word,
            F.lit("info"),
        ),
        "event_type": event_type,
        "message": message,
        "raw_data": F.col("_fields"),
        "parser": F.lit("json"),
    }


def _cef_event(now: Column) -> dict[str, Column]:
    """Event columns of a CEF line from its eight parts and its extension."""
    vendor, product, sig, name, level = (F.col("_parts")[i] for i in (1, 2, 4, 5, 6))
    head = {"vendor": vendor, "product": product, "sigId": sig, "name": name}
    entries = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in head.items()])
    own = F.filter(entries, lambda h: ~F.map_contains_key("_map", h["k"]))
    return {
        "ts": F.try_to_timestamp(_field(F.col("_map"), CEF_TIME)),
        "source": F.coalesce(_field(F.col("_map"), CEF_SOURCE), vendor),
        "severity": _from_scale(level.try_cast("int"), CEF_SEVERITY),
        "event_type": F.concat(sig, F.lit(": "), name),
        "message": F.concat(F.lit("["), vendor, F.lit("/"), product, F.lit("] "), name),
        "category_text": F.concat_ws(" ", name, vendor, product),
        "raw_data": F.map_concat(F.map_from_entries(own), "_map"),
        "parser": F.lit("cef"),
    }


def _syslog_event(now: Column, year: Column) -> dict[str, Column]:
    pri, time, host, tag, message, parser = (F.col("_parts")[i] for i in range(6))
    number = pri.try_cast("long")
    dated = F.concat_ws(" ", year.cast("string"), F.regexp_replace(time, r"\s+", " "))
    is_new = parser == "syslog-rfc5424"
    key = F.when(is_new, "appName").otherwise("tag")
    raw = [("hostname", host), ("pri", number.cast("string")), ("msg", message)]
    return {
        "ts": F.when(is_new, F.try_to_timestamp(time)).otherwise(
            F.try_to_timestamp(dated, F.lit("yyyy MMM d HH:mm:ss"))
        ),
        "source": host,
        "severity": _from_scale(F.pmod(number, F.lit(8)), SYSLOG_SEVERITY),
        "event_type": strip(tag),
        "message": message,
        "raw_data": F.create_map(*[x for k, v in raw for x in (F.lit(k), v)], key, tag),
        "parser": parser,
    }


def _kv_event(now: Column, line: Column) -> dict[str, Column]:
    fields = F.col("_map")
    return {
        "ts": F.try_to_timestamp(_field(fields, KV_FIELDS["time"])),
        "source": F.coalesce(_field(fields, KV_FIELDS["source"]), F.lit("unknown")),
        "severity": severity_of_word(
            F.coalesce(_field(fields, KV_FIELDS["severity"]), F.lit("info"))
        ),
        "event_type": F.coalesce(_field(fields, KV_FIELDS["event_type"]), F.lit("kv_event")),
        "message": F.coalesce(_field(fields, KV_FIELDS["message"]), line),
        "raw_data": fields,
        "parser": F.lit("key-value"),
    }


def _raw_event(now: Column, line: Column, messages: Mapping[str, int] | None) -> dict[str, Column]:
    return {
        "ts": now,
        "source": F.lit("unknown"),
        "severity": F.lit("info"),
        "event_type": F.lit("raw_log"),
        "message": _cut(line, messages, "raw"),
        "raw_data": F.create_map(F.lit("raw"), line),
        "parser": F.lit("raw"),
    }


COLUMNS = ("ts", "source", "severity", "category", "event_type", "message", "raw_data", "parser")


def _events(
    df: DataFrame,
    column: str,
    kind: Column,
    now: Column,
    year: Column,
    loose: bool,
    last: bool,
    messages: Mapping[str, int] | None = None,
) -> DataFrame:
    """Parse every line as its kind; ``loose`` reads refused JSON as pairs, ``last`` as raw.

    The pieces of a line become columns step by step, so no expression parses a line twice
    and each line runs only the parser of its kind.
    """
    line = F.col("_line")
    rows = df.withColumn("_line", strip(F.col(column))).filter(line != "")
    rows = rows.withColumn("_kind", kind)
    rows = rows.withColumn("_objects", F.when(F.col("_kind") == "json", json_objects(line)))
    some = F.filter("_objects", lambda o: F.startswith(strip(o), F.lit("{")))
    rows = rows.withColumn("_object", F.explode_outer(some)).drop("_objects")
    rows = rows.withColumn("_typed", F.try_parse_json("_object"))
    rows = rows.withColumn(
        "_form",
        F.when(F.col("_typed").isNotNull(), "json")
        .when(F.col("_kind") == "json", "kv" if loose else "raw")
        .otherwise(F.col("_kind")),
    )
    form = F.col("_form")
    rows = rows.withColumns(
        {
            "_fields": F.when(form == "json", F.from_json("_object", "map<string,string>")),
            "_parts": F.when(
                (form == "cef") & line.rlike(CEF_LINE), F.split(line, r"\|", 8)
            ).when(form == "syslog", _syslog_parts(line)),
        }
    )
    rows = rows.withColumn(
        "_pairs",
        F.when((form == "cef") & F.col("_parts").isNotNull(), _pairs(F.col("_parts")[7], False)).when(
            form == "kv", _pairs(line, True)
        ),
    ).withColumn("_map", F.when(F.col("_pairs").isNotNull(), _as_map(F.col("_pairs"))))
    raw = F.lit("raw" if last else None).cast("string")
    rows = rows.withColumn(
        "_form",
        F.when(form.isin("cef", "syslog"), F.when(F.col("_parts").isNotNull(), form))
        .when(form == "kv", F.when(F.size("_pairs") > 0, "kv").otherwise(raw))
        .when(form == "raw", raw)
        .otherwise(form),
    ).filter(form.isNotNull())
    events = {
        "json": _json_event(now, messages),
        "cef": _cef_event(now),
        "syslog": _syslog_event(now, year),
        "kv": _kv_event(now, line),
        "raw": _raw_event(now, line, messages),
    }

    def pick(name: str) -> Column:
        out = F
        for f, cols in events.items():
            if name in cols:
                out = out.when(form == f, cols[name])
        return out

    parts = {
        f"_e_{n}": pick(n)
        for n in ("ts", "source", "severity", "event_type", "message", "raw_data", "parser")
    }
    rows = rows.withColumns({**parts, "_e_text": pick("category_text")})
    text = F.coalesce("_e_text", F.concat_ws(" ", "_e_event_type", "_e_message"))
    rows = rows.withColumns(
        {
            "_e_ts": F.coalesce("_e_ts", now),
            "_e_category": F.when(form == "raw", "unknown").otherwise(category_of(text)),
        }
    )
    return rows.select(*df.columns, *[F.col(f"_e_{c}").alias(c) for c in COLUMNS])


def parse_json_logs(df: DataFrame, now: Column, column: str = "line", messages: Mapping[str, int] | None = None) -> DataFrame:
    """JSON lines only; arrays and Records give one event per element, bad lines none."""
    return _events(df, column, F.lit("json"), now, F.lit(None), loose=False, last=False, messages=messages)


def parse_cef_logs(df: DataFrame, now: Column, column: str = "line") -> DataFrame:
    return _events(df, column, F.lit("cef"), now, F.lit(None), loose=False, last=False)


def parse_syslog(df: DataFrame, now: Column, year: Column, column: str = "line") -> DataFrame:
    return _events(df, column, F.lit("syslog"), now, year, loose=False, last=False)


def parse_kv_logs(df: DataFrame, now: Column, column: str = "line") -> DataFrame:
    return _events(df, column, F.lit("kv"), now, F.lit(None), loose=True, last=False)


def parse_raw(df: DataFrame, now: Column, column: str = "line", messages: Mapping[str, int] | None = None) -> DataFrame:
    return _events(df, column, F.lit("raw"), now, F.lit(None), loose=False, last=True, messages=messages)


def normalize_logs(
    df: DataFrame,
    now: Column,
    year: Column,
    format: str = "auto",
    column: str = "line",
    messages: Mapping[str, int] | None = None,
) -> DataFrame:
    """Events of lines in a given or detected format, one schema whatever the format.

    A CEF or syslog line its pattern refuses is dropped; a JSON line that is not JSON is
    read as key=value pairs, and a line without pairs becomes a raw event. A line without a
    message is its own message, whole unless ``messages`` says how much of it.
    """
    kinds = {"auto": detect_format(F.col(column)), "ndjson": F.lit("json")}
    kind = kinds.get(format, F.lit(format))
    return _events(df, column, kind, now, year, loose=format == "auto", last=True, messages=messages)


def formats_detected(events: DataFrame, *keys: str) -> DataFrame:
    """Events per parser and batch."""
    return events.groupBy(*keys, "parser").agg(F.count(F.lit(1)).alias("n"))


# Registered schemas, field to type.
SCHEMAS = {"v1": {"event_type": "string", "source": "string", "timestamp": "number"}}
TYPE_NAMES = {
    "string": "string",
    "double": "number",
    "float": "number",
    "bigint": "number",
    "int": "number",
    "smallint": "number",
    "tinyint": "number",
    "boolean": "boolean",
}


def validate_schema(
    df: DataFrame, version: str = "v1", schemas: Mapping[str, Mapping[str, str]] = SCHEMAS
) -> DataFrame:
    """Add the array of what is wrong with each row; an empty array means valid.

    A missing column or a null is a missing field; a column of another type is a wrong one.
    """
    if version not in schemas:
        return df.withColumn("errors", F.array(F.lit(f'Schema version "{version}" not registered.')))
    checks = []
    for field, wanted in schemas[version].items():
        missing = F.lit(f'Missing required field: "{field}"')
        if field not in df.columns:
            checks.append(missing)
            continue
        actual = TYPE_NAMES.get(df.schema[field].dataType.simpleString(), "object")
        wrong = F.lit(f'Invalid type for field "{field}": expected {wanted}, got {actual}')
        check = F.when(F.col(field).isNull(), missing)
        checks.append(check if actual == wanted else check.otherwise(wrong))
    return df.withColumn("errors", F.array_compact(F.array(*checks)))


def valid_rows(df: DataFrame, **kwargs) -> DataFrame:
    return validate_schema(df, **kwargs).filter(F.size("errors") == 0).drop("errors")


def quarantine(df: DataFrame, **kwargs) -> DataFrame:
    return validate_schema(df, **kwargs).filter(F.size("errors") > 0)


# Allowed states of the stored tables.
ENUMS = {
    "status": ("OPEN", "INVESTIGATING", "MITIGATED", "CLOSED"),
    "severity": ("LOW", "MEDIUM", "HIGH", "CRITICAL"),
}


def reject_invalid_enums(df: DataFrame, enums: Mapping[str, Sequence[str]] = ENUMS) -> DataFrame:
    """Rows whose checked columns hold an allowed value; null passes as in a table check."""
    keep = F.lit(True)
    for column, values in enums.items():
        keep = keep & F.coalesce(F.col(column).isin(*values), F.lit(True))
    return df.filter(keep)

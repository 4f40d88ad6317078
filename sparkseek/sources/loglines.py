"""Container log lines of six formats to one schema; stateless, batch or stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the formats and of bracketed pairs, severity letters,
# and the keys that carry roles in JSON lines.
_PAIR = r'\[("(?:[^"\\]|\\.)*"|[^=\]\s]+)=("(?:[^"\\]|\\.)*"|[^\]]*)\]'
_TIDB = r'^\[([^\]]+)\] \[([A-Za-z]+)\] \[([^\]]+)\] \[("(?:[^"\\]|\\.)*"|[^\]]*)\](.*)$'
_KLOG = r"^([IWEF])[0-9]{4} [0-9:.]+ +[0-9]+ ([^ \]]+)\] ?(.*)$"
_KLOG_TEXT = r'^"((?:[^"\\]|\\.)*)" ?(.*)$'
_ISO = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:.]+Z?)[\t ]+([A-Z]{4,5})[\t ]+(.*)$"
_SEVERITY = {"I": "INFO", "W": "WARN", "E": "ERROR", "F": "FATAL"}
_LEVEL, _MSG, _TIME, _SOURCE = ["level", "severity", "levelname"], ["msg", "message"], ["ts", "time", "timestamp"], ["caller", "logger", "source"]

#: Key and value of a logfmt pair; a key alone is true.
_LOGFMT = r'([^\s=]+)(?:=("(?:[^"\\]|\\.)*"|\S*))?'


def _bare(c: Column) -> Column:
    """Without a pair of outer quotes; escaped quotes inside are plain then."""
    quoted = c.rlike(r'(?s)^".*"$') & (F.length(c) >= 2)
    return F.when(quoted, F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('\\"'), F.lit('"'))).otherwise(c)


def _mapped(entries: Column) -> Column:
    """A map of (key, value) entries; of a key's values the last counts."""
    none = F.array().cast("array<struct<key:string,value:string>>")

    def add(seen: Column, e: Column) -> Column:
        return F.concat(F.filter(seen, lambda o: o["key"] != e["key"]), F.array(F.struct(e["key"].alias("key"), e["value"].alias("value"))))

    return F.map_from_entries(F.aggregate(entries, none, add))


def _pairs(text: Column, pattern: str) -> Column:
    keys, values = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.zip_with(keys, values, lambda k, v: F.struct(_bare(k).alias("key"), _bare(v).alias("value")))


def _rest(text: Column) -> Column:
    """Entries of what no pair was found in."""
    none = F.array().cast("array<struct<key:string,value:string>>")
    return F.when(F.trim(text) != "", F.array(F.struct(F.lit("rest_unparsed").alias("key"), F.trim(text).alias("value")))).otherwise(none)


_PARTS = "struct<ts:string,level:string,source:string,msg:string,entries:array<struct<key:string,value:string>>>"


def _parts(ts=None, level=None, source=None, msg=None, entries=None) -> Column:
    values = {"ts": ts, "level": level, "source": source, "msg": msg, "entries": entries}
    return F.struct(*[(F.lit(None) if v is None else v).alias(k) for k, v in values.items()]).cast(_PARTS)


def _tidb(text: Column) -> Column:
    group = lambda i: F.regexp_extract(text, _TIDB, i)

    def build(rest: Column) -> Column:
        return F.concat(_pairs(rest, _PAIR), _rest(F.regexp_replace(rest, _PAIR, "")))

    entries = F.get(F.transform(F.array(group(5)), build), 0)
    # The offset stands apart from the clock.
    ts = F.regexp_replace(F.replace(group(1), F.lit("/"), F.lit("-")), r" ([+-]\d\d:?\d\d)$", "$1")
    return _parts(ts, F.upper(group(2)), group(3), group(4), entries)


def _klog(text: Column) -> Column:
    """Its own time has no year, so it has none here."""

    def build(rest: Column) -> Column:
        entries = F.transform(_pairs(F.regexp_extract(rest, _KLOG_TEXT, 2), _LOGFMT), lambda e: F.struct(e["key"].alias("key"), F.when(e["value"] == "", F.lit("true")).otherwise(e["value"]).alias("value")))
        quoted = _parts(None, None, None, F.replace(F.regexp_extract(rest, _KLOG_TEXT, 1), F.lit('\\"'), F.lit('"')), entries)
        return F.when(rest.rlike(_KLOG_TEXT), quoted).otherwise(_parts(msg=rest))

    found = F.get(F.transform(F.array(F.regexp_extract(text, _KLOG, 3)), build), 0)
    severity = F.create_map(*[F.lit(x) for kv in _SEVERITY.items() for x in kv])[F.regexp_extract(text, _KLOG, 1)]
    return _parts(None, severity, F.regexp_extract(text, _KLOG, 2), found["msg"], found["entries"])


def _iso(text: Column, fmt: Column) -> Column:
    """zap: a message, more columns and JSON at the end, between tabs; tracing: a message."""

    def build(columns: Column) -> Column:
        tail = F.trim(F.element_at(columns, -1))
        json = F.from_json(tail, "map<string,string>")
        more = F.when(tail.startswith("{"), F.when(json.isNotNull(), F.map_entries(json)).otherwise(_rest(tail)))
        more = F.coalesce(more, _rest(F.array_join(F.slice(columns, 2, F.greatest(F.size(columns), F.lit(1))), " ")))
        return _parts(None, None, None, F.trim(F.get(columns, 0)), more)

    rest = F.regexp_extract(text, _ISO, 3)
    zap = F.get(F.transform(F.array(F.split(rest, "\t", -1)), build), 0)
    is_zap = fmt == "zap"
    return _parts(F.regexp_extract(text, _ISO, 1), F.regexp_extract(text, _ISO, 2), None, F.when(is_zap, zap["msg"]).otherwise(rest), F.when(is_zap, zap["entries"]))


def _json(fields: Column) -> Column:
    """Keys of a role count in any case."""

    def build(entries: Column) -> Column:
        last = lambda names: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]).isin(names)), -1)["value"]
        some = lambda names: F.when(F.exists(entries, lambda e: F.lower(e["key"]).isin(names)), last(names))
        rest = F.filter(entries, lambda e: ~F.lower(e["key"]).isin([*_LEVEL, *_MSG, *_TIME, *_SOURCE]))
        return _parts(some(_TIME), F.upper(some(_LEVEL)), some(_SOURCE), some(_MSG), rest)

    return F.get(F.transform(F.array(F.map_entries(fields)), build), 0)


def _message(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, '^"', ""), '"$', ""))


def parse_lines(df: DataFrame, line: str = "message", runtime: str | None = None, container: str | None = None, service: str | None = None) -> DataFrame:
    """``df`` with ts, level, source_file, msg, kv (map), format and raw.

    The time is the line's own, else ``runtime``'s, else now.  Lines that no format
    fits are ``raw`` with level UNKNOWN.  With a ``container`` column the bag also
    holds what the collector adds: container, service and format.  Each line goes
    through its own format's expressions only.
    """
    text = F.col(line)
    fields = F.from_json(F.trim(text), "map<string,string>")
    kind = F.when(text.rlike(_TIDB), "tidb").when(text.rlike(_KLOG), "klog")
    kind = kind.when(text.rlike(_ISO), F.when(F.contains(F.regexp_extract(text, _ISO, 3), F.lit("\t")), "zap").otherwise("tracing"))
    kind = kind.when(F.trim(text).startswith("{") & fields.isNotNull(), "json").otherwise("raw")
    fmt = F.col("format")
    parts = F.when(fmt == "tidb", _tidb(text)).when(fmt == "klog", _klog(text)).when(fmt.isin("zap", "tracing"), _iso(text, fmt)).when(fmt == "json", _json(fields)).otherwise(_parts(msg=text))
    none = F.array().cast("array<struct<key:string,value:string>>")
    # The format as an array of one, so that no filter works it out again; the parts as a
    # column of their own, which goes where none of them is asked for (a filter on one
    # works them out again for the rows that it keeps).
    rows = df.withColumn("format", F.explode(F.array(kind))).withColumn("__parts", parts)
    entries = F.coalesce(F.col("__parts.entries"), none)
    if container:
        entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
        before = F.array(entry("container", F.col(container)), *([entry("service", F.lower(F.col(service)))] if service else []))
        entries = F.concat(F.filter(before, lambda e: F.coalesce(e["value"], F.lit("")) != ""), entries, F.array(entry("format", fmt)))
    own = F.try_to_timestamp(F.col("__parts.ts"))
    seen = F.col(runtime).cast("timestamp") if runtime else F.lit(None).cast("timestamp")
    msg = _message(F.coalesce(F.col("__parts.msg"), text))
    return (
        rows.withColumn("ts", F.coalesce(own, seen, F.current_timestamp()))
        .withColumn("level", F.coalesce(F.nullif(F.col("__parts.level"), F.lit("")), F.lit("UNKNOWN")))
        .withColumn("source_file", F.nullif(F.col("__parts.source"), F.lit("")))
        .withColumn("msg", msg)
        .withColumn("kv", _mapped(entries))
        .withColumn("raw", text)
        .drop("__parts")
    )


def without_table_art(df: DataFrame) -> DataFrame:
    """Rows but for raw lines that draw a table.

    A raw line is its own message, so that no line is taken to pieces for this.
    """
    art = (F.col("format") == "raw") & _message(F.col("raw")).rlike(r"^[|+]")
    return df.where(~F.coalesce(art, F.lit(False)))


def component(*names: Column) -> Column:
    """The first non-empty name, in lower case; give the strongest first."""
    return F.coalesce(*[F.nullif(F.lower(n), F.lit("")) for n in names])


def search_line(msg: Column, kv: Column) -> Column:
    """The derived surface: the message and the bag's values but the collector's own."""
    values = F.map_values(F.map_filter(kv, lambda k, v: ~k.isin("container", "service", "format")))
    return F.concat_ws(" ", msg, F.when(F.size(values) > 0, F.to_json(values)))

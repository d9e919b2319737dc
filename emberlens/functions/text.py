"""Column functions on text: templates, first matching rule, redaction, sizes, hosts, folders, call sites."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a name must contain for its value to be masked, and what masks it.
SENSITIVE = ("password", "passwd", "secret", "token", "credential", "access.key", "accesskey", "access_key", "apikey", "api_key", "api-key", "private.key", "private_key")
MASK = "[redacted]"


class Pattern(NamedTuple):
    """A rule of first_match: its name, a word that every match contains, and a regular expression whose groups are the fields."""

    name: str
    guard: str
    regex: str
    fields: tuple[str, ...] = ()


def template(text: Column) -> Column:
    """Runs of digits become #, so that lines that differ in numbers only are equal."""
    return F.regexp_replace(text, "[0-9]+", "#")


def fold_templates(df: DataFrame, keys: Sequence[str], text: str, line: str) -> DataFrame:
    """n, first and last line, and the first line's text of each template per key."""
    return (
        df.filter(F.col(text).isNotNull())
        .groupBy(*keys, template(F.col(text)).alias("template"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(line).alias("first_line"), F.max(line).alias("last_line"), F.min_by(text, line).alias("example"))
    )


def first_match(text: Column, rules: Sequence[Pattern]) -> Column:
    """Name of the first rule that matches; null if none. A cheap contains comes before each regular expression."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        out = F.when(text.contains(r.guard) & text.rlike(r.regex), r.name).otherwise(out)
    return out


def matched_fields(text: Column, rule: Column, rules: Sequence[Pattern]) -> Column:
    """Map of the fields that the named rule takes from the text; null without a rule."""
    out = F.lit(None).cast("map<string,string>")
    for r in rules:
        if r.fields:
            pairs = [x for i, f in enumerate(r.fields) for x in (F.lit(f), F.regexp_extract(text, r.regex, i + 1))]
            out = F.when(rule == r.name, F.map_filter(F.create_map(*pairs), lambda _, v: v != "")).otherwise(out)
    return out


def redact_text(text: Column, in_json: bool = False) -> Column:
    """Masks values of sensitive names in name=value and name: value pairs, passwords in URLs, and access-key ids. Running it again changes nothing.

    A name is looked at once, where it begins, and runs don't give back what they took, so time grows with the text's length. In a JSON text a value ends with its string, so that the text stays JSON.
    """
    names = "|".join(n.replace(".", r"[._-]?") for n in SENSITIVE)
    run, ends = r"[A-Za-z0-9_.\-]", r"\s,;&)\]}"
    value = rf'(?:\\.|[^{ends}\["\\])(?:\\.|[^{ends}"\\])*+' if in_json else rf"\"[^\"]*+\"|'[^']*+'|[^{ends}\[][^{ends}]*+"
    out = F.regexp_replace(text, rf"(?i)(?<!{run})(?={run}*?(?:{names}))({run}++[ \t]*+[=:][ \t]*+)({value})", rf"$1{MASK}")
    out = F.regexp_replace(out, r"(?<=[A-Za-z0-9+.\-])(://[^\s/:@]++:)([^\s/@]++)(@)", rf"$1{MASK}$3")
    return F.regexp_replace(out, r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", MASK)


def is_sensitive(key: Column) -> Column:
    low = F.lower(key)
    out = F.lit(False)
    for n in SENSITIVE:
        out = out | low.contains(n)
    return out


def redact_map(m: Column) -> Column:
    """Values of sensitive keys masked, others as text."""
    return F.transform_values(m, lambda k, v: F.when(is_sensitive(k), F.lit(MASK)).otherwise(redact_text(v)))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of value, which is computed once however often f names it, also within lambdas, where Spark computes what stands there anew for each item and mention."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def redact_args(args: Column) -> Column:
    """An argument list: the value after an option of a sensitive name, and pairs within arguments."""
    hides = lambda option: F.coalesce(option.startswith("-") & is_sensitive(option), F.lit(False))
    return once(args, lambda xs: F.transform(xs, lambda a, i: F.when((i > 0) & hides(F.get(xs, i - 1)), MASK).otherwise(redact_text(a))))


def clean(text: Column) -> Column:
    """Without control characters but tab and line feed, and without marks that change direction or have no width."""
    return F.regexp_replace(text, r"[\u0000-\u0008\u000b-\u001f\u007f-\u009f​-‏‪-‮⁠-⁤⁦-⁩﻿]", "")


def size_to_bytes(text: Column, default_unit: str = "b") -> Column:
    """Bytes of a size such as 4g, 10MB or 1.5 KiB; -1 if it isn't one."""
    low = F.lower(F.trim(text))
    shape = r"^([+-]?[0-9]+(?:\.[0-9]+)?)\s*([kmgtp]?)(?:i?b)?$"
    number, unit = F.regexp_extract(low, shape, 1), F.regexp_extract(low, shape, 2)
    bare = low.rlike(r"^[+-]?[0-9]+(?:\.[0-9]+)?$")
    letter = F.when(bare, F.lit(default_unit[:1])).otherwise(unit)
    factor = F.lit(1)
    for i, u in enumerate("kmgtp"):
        factor = F.when(letter == u, F.lit(1 << 10 * (i + 1))).otherwise(factor)
    return F.when(low.rlike(shape), F.floor(number.cast("double") * factor).cast("long")).otherwise(F.lit(-1)).cast("long")


def norm_host(host: Column) -> Column:
    """Every loopback form becomes localhost."""
    low = F.lower(host)
    return F.when(low.isin("localhost", "::1", "[::1]", "0:0:0:0:0:0:0:1") | low.rlike(r"^127\.[0-9.]+$") | low.startswith("localhost."), "localhost").otherwise(host)


def host_key(host: Column) -> Column:
    """What names of one machine share: lower case, dotted numbers as ip-a-b-c-d, no domain."""
    low = F.lower(norm_host(host))
    return F.when(low.rlike(r"^\d+\.\d+\.\d+\.\d+$"), F.concat(F.lit("ip-"), F.translate(low, ".", "-"))).otherwise(F.substring_index(low, ".", 1))


def call_site(text: Column) -> Column:
    """x at /dir/job.py:3 as x at job.py:3."""
    return F.regexp_replace(text, r" at \S*/([^/\s]+:\d+)$", " at $1")


def data_folder(path: Column) -> Column:
    """The folder that a file is data of: without its name, staging folders (. and _) and what follows them, and trailing k=v folders."""
    folder = F.regexp_replace(path, r"/[^/]*$", "")
    folder = F.regexp_replace(folder, r"/[._][^/]*(/.*)?$", "")
    return F.regexp_replace(folder, r"(/[^/=]+=[^/]*)+$", "")


#: Phrases of Spark and YARN that tell why an executor went, in lower case, in the order in which the kinds are tried, and the exit codes of a memory kill.
REMOVALS = {
    "memory-kill": ("exceeding physical memory", "exceeding memory limits", "exceeding virtual memory", "outofmemory"),
    "decommissioned": ("decommission",),
    "killed-by-driver": ("killed by driver", "requested by driver"),
    "idle": ("idle",),
    "lost": ("heartbeat", "lost node", "*lost*", "disconnected", "bad node"),
}
MEMORY_EXITS = ("137", "-104")


def removal_kind(reason: Column) -> Column:
    """Why an executor went: the first kind of REMOVALS one of whose phrases the reason has. Some exit codes alone tell of a memory kill, any other of a loss; null without a reason."""
    low = F.lower(reason)
    code = F.regexp_extract(low, r"exit(?:ed with)? (?:code|status)[:\s]+(-?[0-9]+)", 1)
    out = F.lit("other")
    for kind, phrases in reversed(REMOVALS.items()):
        told = F.lit(False)
        for p in phrases:
            told = told | low.contains(p)
        told = told | code.isin(*MEMORY_EXITS) if kind == "memory-kill" else told | (code != "") if kind == "lost" else told
        out = F.when(told, kind).otherwise(out)
    return F.when(low != "", out)


def short_error(text: Column) -> Column:
    """The first line without the word of a most recent failure, and a Python traceback's last line where there is one."""
    first = F.regexp_replace(F.element_at(F.split(text, "\n"), 1), r"^.*[Mm]ost recent failure: ", "")
    python = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w.]*(Error|Exception|Interrupt|Exit)(:|$)"))
    return F.when(text.contains("Traceback (most recent call last)") & (F.size(python) > 0), F.concat_ws(": ", first, F.element_at(python, -1))).otherwise(first)


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 if whole isn't above 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def block_kind(block_id: Column) -> Column:
    """What a block holds: its id up to the first _ or -."""
    return F.regexp_extract(block_id, r"^[^_-]*", 0)


def config_group(origin: Column, key: Column) -> Column:
    """The product a setting belongs to."""
    return (
        F.when(origin == "jvm", "JVM")
        .when(key.startswith("spark.hadoop."), "Hadoop")
        .when(key.startswith("spark.sql.hive") | key.startswith("hive."), "Hive")
        .when(key.startswith("hbase.") | key.contains(".hbase."), "HBase")
        .when(key.startswith("spark."), "Spark")
        .otherwise(F.when(origin == "hadoop", "Hadoop").otherwise("JVM"))
    )


def level_name(level: Column) -> Column:
    """Storage level from its flags, such as MEMORY_AND_DISK_SER_2."""
    base = F.when(level["off_heap"], "OFF_HEAP").otherwise(
        F.when(level["memory"] & level["disk"], "MEMORY_AND_DISK").when(level["memory"], "MEMORY_ONLY").when(level["disk"], "DISK_ONLY").otherwise("NONE")
    )
    ser = F.when(level["memory"] & ~level["deserialized"] & ~level["off_heap"], "SER")
    return F.concat_ws("_", base, ser, F.when(level["replication"] > 1, level["replication"].cast("string")))


def container_attempt(container: Column) -> Column:
    """Attempt number within a container id; null of anything else."""
    return F.regexp_extract(container, r"^container_(?:e\d+_)?\d+_\d+_(\d+)_\d+$", 1).try_cast("int")


def row_key_bytes(key: Column) -> Column:
    r"""Bytes of a printed row key, in which \xNN stands for a byte, as hexadecimal digits: they sort as the bytes do."""
    parts = F.regexp_extract_all(key, F.lit(r"(?s)(\\x[0-9A-Fa-f]{2}|.)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\\x[0-9A-Fa-f]{2}$"), F.upper(F.substring(p, 3, 2))).otherwise(F.hex(F.encode(p, "UTF-8")))), "")


def map_diff(props: Column, base: Column, other: Column, most: int = 100) -> Column:
    """The first most entries, by key, whose value differs from base's and from other's."""
    own = F.map_filter(props, lambda k, v: ~v.eqNullSafe(base[k]) & ~v.eqNullSafe(other[k]))
    return F.map_from_entries(F.slice(F.array_sort(F.map_entries(own)), 1, most))

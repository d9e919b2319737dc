"""Command lines and nested values: words that know quotes, the script that a command runs, and secrets masked at any depth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import MASK, SENSITIVE, once, redact_args, redact_text

#: A word: plain characters, escaped ones, and quoted runs; an open quote runs to the end. Nothing is read twice.
WORD = r"""(?s)(?:[^\s"'\\]++|\\.|\\$|"(?:[^"\\]++|\\.)*+(?:"|\\?$)|'[^']*+(?:'|$))++"""
#: Options of spark-submit that take no value.
FLAGS = ("--verbose", "-v", "--supervise", "--help", "-h", "--version", "--usage-error")
_STRING = r'"(?:[^"\\]++|\\.)*+"'


def command_words(command: Column) -> Column:
    """The words of a command line, without the quotes and escapes that they were written with. A null command has none."""
    words = F.regexp_extract_all(command, F.lit(WORD), F.lit(0))
    # Within single quotes nothing is escaped; elsewhere a backslash stands before what it makes plain.
    pieces = r"""(?s)'([^']*+)(?:'|$)|"((?:[^"\\]++|\\.)*+)(?:"|\\?$)|((?:[^"'\\]++|\\.|\\$)++)"""
    plain = lambda x: F.regexp_replace(x, r"(?s)\\(.)", "$1")

    def bare(word: Column) -> Column:
        parts = F.regexp_extract_all(word, F.lit(pieces), F.lit(0))
        return F.array_join(F.transform(parts, lambda p: F.when(p.startswith("'"), F.regexp_replace(p, r"^'|'$", "")).when(p.startswith('"'), plain(F.regexp_replace(p, r'(?s)^"(.*?)"?$', "$1"))).otherwise(plain(p))), "")

    return F.transform(words, bare)


def redact_command(command: Column) -> Column:
    """A command line with secrets masked: the value after an option of a sensitive name, and pairs within words. Words that need quotes are written in double ones, so that it reads as the same words again."""
    escaped = lambda w: F.regexp_replace(w, r'(["\\])', r"\\$1")
    quoted = lambda w: F.when(w.rlike(r"""^[^\s"'\\]+$"""), w).otherwise(F.concat(F.lit('"'), escaped(w), F.lit('"')))
    return F.array_join(F.transform(redact_args(command_words(command)), quoted), " ")


def submitted_script(command: Column) -> Column:
    """What a spark-submit command runs: its first word that is neither an option nor an option's value. Null without one."""

    def first(rest: Column) -> Column:
        valued = lambda w: w.startswith("-") & ~w.isin(*FLAGS) & ~w.contains("=")
        own = F.filter(rest, lambda w, i: (i > 0) & ~w.startswith("-") & ~F.coalesce(valued(F.get(rest, i - 1)), F.lit(False)))
        return F.get(own, F.lit(0))

    def after_submit(words: Column) -> Column:
        submit = F.array_position(F.transform(words, lambda w: F.regexp_extract(w, r"([^/]*)$", 1)), F.lit("spark-submit")).cast("int")
        return F.slice(words, F.greatest(submit, F.lit(1)), F.size(words))

    return once(once(command_words(command), after_submit), first)


def redact_json(value: Column) -> Column:
    """A JSON text with secrets masked at any depth: strings and numbers, and lists and objects of these, of keys with a sensitive name; and pairs within all strings.

    The text is read once from left to right and stays JSON; keys keep their order and spelling. Objects of such a key that hold objects are masked where their own keys say so. Text that is no JSON is masked as text.
    """
    names = "|".join(n.replace(".", r"[._-]?") for n in SENSITIVE)
    key = rf'(?i)("(?=[^"\\]*?(?:{names}))(?:[^"\\]++|\\.)*+"\s*+:\s*+)'
    scalar = rf"(?:{_STRING}|-?[0-9][0-9.eE+-]*+)"
    flat = rf"(?:{scalar}|\[\s*+(?:{scalar}\s*+,?\s*+)*+\]|\{{\s*+(?:{_STRING}\s*+:\s*+{scalar}\s*+,?\s*+)*+\}})"
    return redact_text(F.regexp_replace(value, key + flat, rf'$1"{MASK}"'), in_json=True)

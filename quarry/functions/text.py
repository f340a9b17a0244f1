"""Scalar functions over columns; all of them built-in expressions."""

from __future__ import annotations

import fnmatch
import html
import re
import unicodedata
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType



def plain_letter(c: str) -> str:
    """A letter as searching knows it: its simple case fold, without its mark if it is a Latin letter with one mark alone."""
    folded = c.casefold() if len(c.casefold()) == 1 else c.lower()
    parts = unicodedata.normalize("NFD", folded)
    return parts[0] if len(parts) == 2 and unicodedata.combining(parts[1]) and parts[0].isascii() else folded


def _fold_table() -> tuple[str, str]:
    """What lower-casing doesn't do by itself, for ``translate``: letters and what they become, then marks that go."""
    letters = [c for c in map(chr, range(0x80, 0x10000)) if unicodedata.category(c).startswith("L") and plain_letter(c) != c.lower()]
    letters.append("Σ")  # whose lower case depends on its place in a word
    parts = [unicodedata.normalize("NFD", c.lower()) for c in letters]
    marks = sorted({p[1] for p in parts if len(p) == 2 and unicodedata.combining(p[1])})
    return "".join([*letters, *marks]), "".join(map(plain_letter, letters))


FOLD_FROM, FOLD_TO = _fold_table()


def fold(text: Column) -> Column:
    return F.lower(F.translate(text, FOLD_FROM, FOLD_TO))


def padded_tokens(text: Column) -> Column:
    """Runs of letters and digits, folded, each between single blanks: ' a b c '. Of ASCII a plain class says the same."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")
    words = F.when(F.octet_length(text) == F.char_length(text), ascii_only).otherwise(F.regexp_replace(fold(text), r"[^\p{L}\p{N}]+", " "))
    return F.concat(F.lit(" "), F.trim(words), F.lit(" "))


def token_length(padded: Column) -> Column:
    return F.when(F.trim(padded) == "", 0).otherwise(F.char_length(padded) - F.char_length(F.replace(padded, F.lit(" "), F.lit(""))) - 1)


def preprocess_query(query: Column) -> Column:
    """The match string of a search: quoted parts stay, other words are quoted, AND between; nothing for a blank one."""
    parts = F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(r'"[^"]*"|\S+'), F.lit(0))
    quoted = lambda p: (F.char_length(p) >= 2) & F.startswith(p, F.lit('"')) & F.endswith(p, F.lit('"'))
    return F.array_join(F.transform(parts, lambda p: F.when(quoted(p), p).otherwise(F.concat(F.lit('"'), p, F.lit('"')))), " AND ")


def word_terms(text: Column) -> Column:
    """Lower-case ASCII words of two letters and more, where no other letter, digit or underscore adjoins."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w.rlike("^[a-z]{2,}$"))


def sentences(text: Column) -> Column:
    """Trimmed, non-empty sentences."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[.!?]+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded down: the documented fall-back where no vocabulary can be loaded."""
    return F.floor(F.coalesce(F.char_length(text), F.lit(0)) / 4)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    """The folder of a path, '' at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def suffix(path: Column) -> Column:
    """The last extension with its dot, lower-case; names that only begin with a dot have none."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def glob_match(path: Column, patterns: list[str]) -> Column:
    """Does any shell pattern match the whole path? A star crosses folders."""
    whole = F.lit(False)
    for p in patterns:
        whole = whole | path.rlike("^(?s:" + fnmatch.translate(p).removeprefix("(?s:").removesuffix(r")\z").removesuffix(r")\Z") + r")\z")
    return whole


#: Fixed value: what names of vector namespaces begin with.
NAMESPACE_PREFIX = "mcp_code_"


def namespace(name: Column) -> Column:
    return F.lower(F.concat(F.lit(NAMESPACE_PREFIX), F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_")))


def redaction_marker(kind: str, match: Column) -> Column:
    """[REDACTED:KIND], cut or padded with X to the length of what it replaces."""
    mark = F.lit(f"[REDACTED:{kind.upper()}]")
    n = F.char_length(match)
    return F.rpad(F.substring(mark, F.lit(1), n), n, F.lit("X"))


def ellipsis(text: Column, most: int) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def speed(seconds: Column) -> Column:
    return F.when(seconds < 0.1, "fast").when(seconds < 1, "normal").when(seconds < 5, "slow").otherwise("very_slow")


def change_type(event: Column) -> Column:
    """created, modified, deleted or moved; null for other events, which are dropped."""
    return (
        F.when(event.isin("created", "added"), "created").when(event.isin("modified", "changed"), "modified")
        .when(event.isin("deleted", "removed"), "deleted").when(event.isin("moved", "renamed"), "moved")
    )


def language(path: Column) -> Column:
    s = suffix(path)
    return F.when(s == ".py", "python").when(s.isin(".js", ".jsx"), "javascript").when(s.isin(".ts", ".tsx"), "typescript").otherwise(F.concat(F.lit("generic"), s))


def demote_headers(text: Column) -> Column:
    """Markdown headers one level down, if there is a top one."""
    return F.when(text.rlike(r"(?m)^#\s"), F.regexp_replace(text, r"(?m)^(#{1,6})", "#$1")).otherwise(text)


def table_cell(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


@F.pandas_udf(StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else html.unescape(t))


_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _closed_entity(match: re.Match) -> str:
    """What an entity stands for; a name that is no entity's stays, though it may begin with one's."""
    whole = match.group()
    return html.unescape(whole) if whole[1] == "#" else html5.get(whole[1:], whole)


@F.pandas_udf(StringType())
def _closed_unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else _CLOSED.sub(_closed_entity, t))


def unescape_html(text: Column, closed: bool = False) -> Column:
    """Named and numeric entities as characters, each once; texts without an ampersand don't reach Python. As browsers do,
    also those that miss their semicolon (``&amp`` before a tag); ``closed`` leaves these alone."""
    marked = F.contains(text, F.lit("&"))
    return F.when(marked, (_closed_unescaped if closed else _unescaped)(F.when(marked, text))).otherwise(text)


#: What an error's message holds, its class, and whether retrying helps. The first rule that holds counts.
ERROR_RULES = (
    (("database is locked", "sqlite_locked", "attempt to write a readonly database", "timeout waiting for database lock"), "DatabaseLockError", True),
    (("database is busy", "sqlite_busy", "cannot start a transaction within a transaction"), "DatabaseBusyError", True),
    (("unable to open database", "disk i/o error", "database disk image is malformed", "no such database"), "DatabaseConnectionError", True),
    (("no such table", "no such column", "already exists", "syntax error"), "DatabaseSchemaError", False),
    (("unique constraint failed", "foreign key constraint failed", "primary key constraint failed", "check constraint failed"), "DatabaseIntegrityError", False),
)


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    whole = F.lit(False)
    for p in parts:
        whole = whole | F.contains(text, F.lit(p))
    return whole


def error_class(message: Column) -> Column:
    out, text = F.lit("DatabaseError"), F.lower(message)
    for parts, name, _ in reversed(ERROR_RULES):
        out = F.when(_any(text, parts), name).otherwise(out)
    return out


def error_subtype(message: Column) -> Column:
    """What kind of lock, resource or constraint; empty for other classes."""
    text, kind = F.lower(message), error_class(message)
    constraint = F.when(F.contains(text, F.lit("unique")), "unique").when(F.contains(text, F.lit("foreign key")), "foreign_key").when(F.contains(text, F.lit("primary key")), "primary_key").otherwise("check")
    return (
        F.when(kind == "DatabaseLockError", F.when(text.rlike("write|readonly"), "write").otherwise("read"))
        .when(kind == "DatabaseBusyError", F.when(F.contains(text, F.lit("transaction")), "transaction").otherwise("connection"))
        .when(kind == "DatabaseIntegrityError", constraint).otherwise("")
    )


def retryable(message: Column) -> Column:
    return error_class(message).isin(*(name for _, name, again in ERROR_RULES if again))


def provider_error(status: Column, message: Column) -> Column:
    """How a failed call to a remote model is reported."""
    text = F.concat_ws(" ", status.cast("string"), F.lower(message))
    return (
        F.when(text.rlike("401|unauthorized|invalid api key"), "authentication").when(text.rlike("403|forbidden"), "permission").when(text.rlike("429|rate limit"), "rate_limit")
        .when(text.rlike("quota|insufficient"), "quota").when(text.rlike(r"\b5[0-9]{2}\b"), "server").otherwise("unknown")
    )


def client_ip(forwarded: Column, real: Column, peer: Column) -> Column:
    first = F.trim(F.element_at(F.split(forwarded, ","), 1))
    return F.coalesce(F.when(first != "", first), F.when(F.trim(real) != "", F.trim(real)), peer, F.lit("unknown"))


def backoff(base: Column, attempt: Column) -> Column:
    return base * F.pow(F.lit(2.0), attempt - 1)


def scrub(text: Column, most: int = 10_000) -> Column:
    """Without control characters but tab and line ends, cut to ``most`` characters."""
    return F.substring(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), 1, most)


#: Characters that users' input loses.
DANGEROUS = "\x00\x08\x0b\x0c\x0e\x0f"


def sanitised_input(text: Column, most: int = 10_000) -> Column:
    """Cut after ``most`` characters, which dots show, and without dangerous characters."""
    return F.translate(F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text), DANGEROUS, "")


def valid_request(text: Column) -> Column:
    """Is the text a JSON-RPC request: an object of version "2.0" whose method is a text that isn't empty?"""
    request = F.try_parse_json(text)

    def field(name: str) -> Column:
        value = F.try_variant_get(request, f"$.{name}", "variant")
        return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(request, f"$.{name}", "string"))

    return F.coalesce((field("jsonrpc") == "2.0") & (field("method") != ""), F.lit(False))


def diff_chunk_size(tokens: Column, files: Column, limit: int = 100_000) -> Column:
    """Files of a commit that go into one prompt: 70 % of the limit over the average file, between 5 and 50."""
    size = F.floor(F.lit(0.7 * limit) / F.try_divide(tokens.cast("double"), files))
    return F.when(files == 0, 10).otherwise(F.greatest(F.lit(5), F.least(F.lit(50), F.greatest(F.lit(1), F.coalesce(size, F.lit(50)))))).cast("long")


def embedding_text(name: Column, content: Column) -> Column:
    return F.when(name.isNotNull() & (name != ""), F.concat(F.lit("# "), name, F.lit("\n"), content)).otherwise(content)


def line_section(text: Column, first: int, last: int) -> Column:
    """Lines first to last, counted from 1, both included, cut at the end of the text; null where it has no such line."""
    lines = F.split(text, "\n")
    n = F.size(lines)
    return F.when(n >= first, F.array_join(F.slice(lines, F.lit(first), F.least(n, F.lit(last)) - first + 1), "\n"))


def sanitised(name: Column, value: Column, most: int = 100) -> Column:
    """An argument as it may be logged: not at all if its name tells of a secret, else cut."""
    return F.when(F.lower(name).rlike("password|token|secret|key|auth"), "[REDACTED]").otherwise(ellipsis(value, most))

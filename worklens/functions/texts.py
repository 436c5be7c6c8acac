"""JSON in its canonical form, by a small helper a row in Arrow batches, and secrets taken out of texts, by patterns in the JVM."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _no_number(name: str):
    raise ValueError(f"{name} is not JSON")


def _canonical(text: str | None) -> str | None:
    try:
        return None if text is None else json.dumps(json.loads(text, parse_constant=_no_number), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """Members in the order of their names at every depth, no blanks; null for what isn't JSON."""
    return texts.map(_canonical)


def json_digest(text: Column) -> Column:
    """H7: SHA-256 of the canonical form; what is equal as JSON has one digest."""
    return F.sha2(canonical_json(text), 256)


#: Words that make a line sensitive if a colon or an equals sign follows.
MARKERS = [
    "authorization", "bearer", "token", "secret", "password", "passwd", "credential", "credentials", "api_key", "api-key", "apikey", "private key", "access key", "access_key", "secret_key",
    "client_secret", "client key", "cookie", "dsn", "session_id", "sessionid",
]
#: Beginnings of access tokens.
PREFIXES = ["ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "sk-", "xoxb-", "xoxp-", "xoxa-", "xoxr-"]
#: What stands in the place of a sensitive line, and of a token.
LINE, TOKEN = "[redacted sensitive diagnosis line]", "[redacted-token]"
#: Signs around a token that aren't part of it.
_AROUND = "'\"`()\\[\\]{},;"
_MARKED = "(?:" + "|".join(MARKERS) + ")['\"` \t]*[:=]"
#: A line of text that names a private key, at its beginning or its end.
_KEY_LINE = "(?=[^\n]*-----{} )(?=[^\n]*private key-----)"
#: A key's first line, all lines up to its last one, and that; without a last one all the rest.
_KEY = "(?id)(?m:^)" + _KEY_LINE.format("begin") + "(?:(?!" + _KEY_LINE.format("end") + ")[^\n]*\n)*+[^\n]*"
_SECRET = "|".join([
    "(?i:" + "|".join(PREFIXES) + r")\S*",
    rf"A[KS]IA\S{{11,}}[^\s{_AROUND}]\S*",  # access keys of 16 characters and more
    r"(?=\S*://)\S*[@?]\S*",  # addresses with credentials or a query
    rf"[^\s.]{{8,}}\.[^\s.]{{8,}}\.[^\s.]{{7,}}[^\s.{_AROUND}]",  # three long parts
    rf"(?!(?:[0-9a-f]{{40}}|[0-9a-f]{{64}})(?![^\s{_AROUND}]))[0-9A-Fa-f]{{32,}}",  # hex, save plain digests
    rf"(?=[^\s0-9]*[0-9])(?![0-9A-Fa-f]+(?![^\s{_AROUND}]))(?:(?=[^\sa-z]*[a-z])(?=[^\sA-Z]*[A-Z])|(?=[A-Za-z0-9+/_=-]{{40}}))[A-Za-z0-9+/_=-]{{32,}}",  # random looks
])
_SENSITIVE = rf"(?U)(?<!\S)[{_AROUND}]*+(?:{_SECRET})[{_AROUND}]*(?!\S)"


def marked_line(line: Column) -> Column:
    """A marker word, then a colon or an equals sign, with at most quotes and blanks between."""
    return F.lower(line).rlike(_MARKED)


def holds_token(line: Column) -> Column:
    """An access key, an address with credentials or a query, three long parts between dots, or 32 characters and more that look random."""
    return line.rlike(_SENSITIVE)


def redacted(text: Column) -> Column:
    """The text with the lines of private keys, lines that marked_line() finds and tokens that holds_token() finds replaced, trimmed at both ends.

    Three replacements over the whole text, all in the JVM. A key's lines become
    as many replaced lines; those are counted in what the pattern found.
    """
    keys = F.regexp_extract_all(text, F.lit(_KEY), F.lit(0))
    covered = F.transform(keys, lambda k: F.array_join(F.array_repeat(F.lit(LINE), F.size(F.split(k, "\n"))), "\n"))
    out = F.array_join(F.zip_with(F.split(text, _KEY, -1), covered, lambda rest, key: F.concat(rest, F.coalesce(key, F.lit("")))), "")
    out = F.regexp_replace(out, "(?id)(?m:^)[^\n]*" + _MARKED + "[^\n]*", LINE)
    return F.regexp_replace(F.regexp_replace(out, _SENSITIVE, TOKEN), r"(?U)\A\s+|\s+\z", "")


def worker_outcome(text: Column) -> Column:
    """(class, paths, reason) of a worker's JSON outcome; null class for no outcome, `invalid` for one that lacks or adds members or exceeds its bounds."""
    at = lambda name: F.get_json_object(text, f"$.{name}")
    members = F.array_sort(F.json_object_keys(text))
    only = lambda *names: members == F.array(*[F.lit(n) for n in sorted(names)])
    paths = F.from_json(at("paths"), "array<string>")
    authority = only("outcome", "paths") & paths.isNotNull() & (F.size(paths).between(1, 128)) & F.forall(paths, lambda p: p.isNotNull() & F.length(p).between(1, 4096))
    impossible = only("outcome", "reason") & F.length(F.trim(at("reason"))).between(1, 12_000)
    kind = F.when(at("outcome") == "needs-authority", F.when(F.coalesce(authority, F.lit(False)), "needs-authority").otherwise("invalid")).when(at("outcome") == "impossible", F.when(F.coalesce(impossible, F.lit(False)), "impossible").otherwise("invalid"))
    return F.struct(kind.alias("class"), F.when(kind == "needs-authority", F.array_sort(F.array_distinct(paths))).alias("paths"), F.when(kind == "impossible", F.trim(at("reason"))).alias("reason"))

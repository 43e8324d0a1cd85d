"""Predicates over file paths, as expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
TEST_DIRS = ("tests", "test", "spec", "specs", "__tests__")
TEST_NAMES = r"(?i)^(test_.*\.py|.*_test\.(py|go|rb|cc|cpp)|.*\.(test|spec)\.(js|jsx|ts|tsx|mjs)|.*tests?\.(java|cs|kt|swift)|.*_spec\.rb)$"
CREDENTIAL_DIRS = (".ssh", ".gnupg", ".aws", ".gcloud", ".azure", ".kube")
SECRET_NAMES = r"(?i)(^\.env(\..+)?$|\.(pem|key|p12|pfx|jks|keystore)$|^id_(rsa|dsa|ecdsa|ed25519)|^\.netrc$|^\.pgpass$)"
SECRET_WORDS = r"(?i)(^|[._-])(credentials?|secrets?|passwords?|token)([._-]|$)"
NOISE_DIRS = ("node_modules", ".git", "__pycache__", ".venv", "venv", "dist", "build", ".tox", ".mypy_cache", "target", ".idea", ".gradle")
TEMPLATE = r"(?i)\.(example|sample|template|dist)$"


def segments(path: Column) -> Column:
    return F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda s: s != "")


def name(path: Column) -> Column:
    return F.element_at(segments(path), -1)


def is_test(path: Column) -> Column:
    return F.exists(segments(path), lambda s: F.lower(s).isin(*TEST_DIRS)) | name(path).rlike(TEST_NAMES)


def is_noise(path: Column) -> Column:
    return F.exists(segments(path), lambda s: s.isin(*NOISE_DIRS))


def is_sensitive(path: Column, is_source: Column) -> Column:
    """A credential folder, a secret's name that isn't a template's, or a telling word in the
    name of a file that isn't source."""
    n = name(path)
    stored = F.exists(segments(path), lambda s: F.lower(s).isin(*CREDENTIAL_DIRS))
    return stored | (n.rlike(SECRET_NAMES) & ~n.rlike(TEMPLATE)) | (n.rlike(SECRET_WORDS) & ~is_source)


def rule_regex(rule: str) -> tuple[str, bool]:
    """The regex of one ignore rule over a path without leading slash, and whether it negates."""
    negates = rule.startswith("!")
    body = rule.removeprefix("!").rstrip("/")
    anchored = "/" in body
    out, i = "", 0
    body = body.lstrip("/")
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("/**", i) and i + 3 == len(body):
            out, i = out + "/.*", i + 3
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + (body[i] if body[i].isalnum() or body[i] in "_-/" else "\\" + body[i]), i + 1
    return f"^{'' if anchored else '(?:.*/)?'}{out}$", negates


def is_ignored(path: Column, rules: Sequence[str]) -> Column:
    """The last rule that matches decides; an ignored folder ignores all below it."""
    parts = segments(path)
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))

    def verdict(p: Column) -> Column:
        out = F.lit(False)
        for rule in rules:
            regex, negates = rule_regex(rule)
            out = F.when(p.rlike(regex), F.lit(not negates)).otherwise(out)
        return out

    return F.exists(heads, verdict)


def public_url(url: Column) -> Column:
    """http or https, and a host that isn't local or a private address."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    private = host.rlike(r"^(localhost|(127|10)(\.\d+){3}|192\.168(\.\d+){2}|172\.(1[6-9]|2[0-9]|3[01])(\.\d+){2}|169\.254(\.\d+){2}|0\.0\.0\.0|\[?::1\]?)$")
    return url.rlike("(?i)^https?://") & (host != "") & ~private

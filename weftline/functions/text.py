"""Scalar functions on text, as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
PAPER_SIGNALS = (
    r"(?i)\barxiv\b", r"(?i)\bdoi\s*:", r"(?i)\babstract\b", r"(?i)\bproceedings\b", r"(?i)\bjournal\b", r"(?i)\bpreprint\b",
    r"\\cite\{", r"\[\d+\]", r"\[\n\d+\n\]", r"(?i)eq\.\s*\d+|equation\s+\d+", r"\d{4}\.\d{4,5}", r"(?i)\bwe propose\b", r"(?i)\bliterature\b",
)
ACTIVE = ("in-progress", "in_progress", "active", "current", "wip")
ARCHIVED = ("_done", "done", "archive", "archived", "backup", "bak", "old", "attic", "graveyard", "completed")


def _folding() -> tuple[str, str]:
    """Letters of the Latin blocks whose decomposition is a base letter and marks, and those bases."""
    pairs = []
    for code in range(0xC0, 0x250):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code) and base.isalpha():
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_diacritics(c: Column) -> Column:
    marked, plain = _folding()
    return F.translate(c, marked, plain)


def normalize_id(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^\p{L}\p{N}_]+", "_"), "_+", "_"), F.lit("_"))


def normalize_label(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)[^\p{L}\p{N}]+", " "))


def search_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(strip_diacritics(c)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def bare_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"\(\)$", ""), r"^\.", "")


def shingles(c: Column, k: int) -> Column:
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (k - 1), F.lit(1))), lambda i: F.substr(c, i, F.lit(k)))
    return F.array_distinct(parts)


def entropy(c: Column) -> Column:
    """Bits per character; 0 for an empty text."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    n = F.size(chars)
    share = lambda x: F.size(F.filter(chars, lambda y: y == x)) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, x: acc - share(x) * F.log2(share(x)))


def numeric_tokens(c: Column) -> Column:
    """Digit runs without leading zeros, sorted."""
    runs = F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0))
    return F.sort_array(F.transform(runs, lambda r: F.when(r.rlike("^0+$"), "0").otherwise(F.ltrim(r, F.lit("0")))))


def variant_pair(a: Column, b: Column) -> Column:
    """Short labels of one stem with different version suffixes."""
    form = r"^(.*[a-z])([0-9]+[a-z]*|[a-z]{2,})$"
    stem = lambda c: F.regexp_extract(c, form, 1)
    tail = lambda c: F.regexp_extract(c, form, 2)
    return (a != b) & (F.greatest(F.length(a), F.length(b)) < 12) & a.rlike(form) & b.rlike(form) & (stem(a) == stem(b)) & (tail(a) != tail(b))


def lifecycle_penalty(path: Column) -> Column:
    """0 if a directory says active, 2 if one says archived, else 1; the lowest counts."""
    parts = F.filter(F.split(F.lower(path), "/"), lambda s: s != "")
    dirs = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    marks = F.transform(F.filter(dirs, lambda s: s.isin(*ACTIVE, *ARCHIVED)), lambda s: F.when(s.isin(*ACTIVE), 0).otherwise(2))
    return F.coalesce(F.array_min(marks), F.lit(1))


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("long")


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(r"\S+")), F.lit(0)).cast("long")


def paper_signals(c: Column, window: int = 3000) -> Column:
    head = F.substring(c, 1, window)
    return sum((head.rlike(p).cast("int") for p in PAPER_SIGNALS), F.lit(0))


def strip_frontmatter(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\A---\n.*?\n---\n", "")


def content_hash(text: Column, path: Column) -> Column:
    return F.sha2(F.concat(text, F.lit("\0"), F.lower(path)), 256)


def html_to_text(c: Column, most: int = 8000) -> Column:
    bare = F.regexp_replace(F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>", ""), r"(?is)<style[^>]*>.*?</style>", "")
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]+>", " "), r"\s+", " ")), 1, most)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def url_type(url: Column) -> Column:
    low = F.lower(url)
    path = F.lower(url_path(url))
    return (
        F.when(low.contains("twitter.com") | low.contains("x.com"), "tweet")
        .when(low.contains("arxiv.org"), "arxiv")
        .when(low.contains("github.com"), "github")
        .when(low.contains("youtube.com") | low.contains("youtu.be"), "youtube")
        .when(path.endswith(".pdf"), "pdf")
        .when(path.rlike(r"\.(png|jpg|jpeg|webp|gif)$"), "image")
        .otherwise("webpage")
    )


def url_filename(url: Column, suffix: str) -> Column:
    name = F.regexp_replace(F.concat(url_host(url), url_path(url)), r"[^A-Za-z0-9_\-]", "_")
    return F.concat(F.substring(F.regexp_replace(F.trim(name, F.lit("_")), "_+", "_"), 1, 80), F.lit(suffix))


def sanitise(c: Column, most: int = 256) -> Column:
    return F.substring(F.regexp_replace(c, r"[\x00-\x1f\x7f]", ""), 1, most)

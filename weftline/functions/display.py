"""Names for display and search, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import search_tokens, strip_diacritics

#: Labels of built-ins, and short names of relations.
BUILTIN_LABELS = (
    "str int float bool bytes bytearray complex object True False MagicMock Mock AsyncMock NonCallableMock NonCallableMagicMock PropertyMock patch "
    "sentinel Path Any Optional List Dict Set Tuple Union Callable Type ClassVar Final Literal Protocol Counter defaultdict OrderedDict datetime Enum "
    "os sys re json io abc typing Foundation SwiftUI UIKit AppKit Combine String Int Double Float Bool Data URL Date UUID Sendable Codable Decodable "
    "Encodable Equatable Hashable Identifiable Comparable AnyObject Error LocalizedError NSObject NSString NSError NSLock View Color Font DispatchQueue"
).split()
RELATION_NAMES = {
    "imports_from": "imports", "rationale_for": "explains", "conceptually_related_to": "relates", "participate_in": "joins", "form": "forms",
}
NODE_TYPES = {
    "klass": ("class", "klass", "struct", "interface", "enum", "trait", "model"), "module": ("module", "file", "package", "namespace"),
    "api": ("endpoint", "route", "api", "handler", "controller"), "test": ("test", "spec"), "ui": ("component", "hook", "view", "page"),
}
SOURCE_SUFFIXES = ("py", "ts", "tsx", "js", "jsx", "go", "rs", "java", "kt", "rb", "php", "cs", "swift", "vue", "svelte")


def _basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def humanized(label: Column, source: Column) -> Column:
    """A short label: methods without their dot, files without folders, long names by their last
    three words, at most 42 characters."""
    text = F.trim(F.coalesce(label, F.lit("")))
    parts = F.filter(F.split(text, "_"), lambda p: p != "")
    tail = F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 2), F.lit(3)), " ")
    long = text.contains("_") & ~text.contains(" ") & (F.length(text) > 28) & (F.size(parts) > 0)
    short = F.when(long, tail).otherwise(text)
    cut = F.when(F.length(short) > 42, F.concat(F.rtrim(F.substring(short, 1, 39)), F.lit("..."))).otherwise(short)
    return (
        F.when(text == "", F.when(F.coalesce(source, F.lit("")) != "", _basename(source)).otherwise("Unknown"))
        .when(text.startswith(".") & text.endswith("()"), F.substr(text, F.lit(2)))
        .when(text.rlike(r"\.(py|ts|tsx|js|jsx|go|rs|java|rb)$"), _basename(text))
        .otherwise(cut)
    )


def node_kind(label: Column, source: Column, file_type: Column, node_type: Column) -> Column:
    """klass, module, api, test, ui, concept, entry, async or function."""
    raw = F.coalesce(label, F.lit(""))
    low, path = F.lower(raw), F.lower(F.coalesce(source, F.lit("")))
    said = F.lower(F.coalesce(node_type, F.lit("")))
    out = F.when(F.lit(False), "")
    for kind, types in NODE_TYPES.items():
        out = out.when(said.isin(*types), kind)
    hook = raw.rlike(r"^use[A-Z_-]")
    return (
        out.when(F.lower(F.coalesce(file_type, F.lit(""))).isin("rationale", "document"), "concept")
        .when(path.contains("test") | low.startswith("test_") | path.contains("spec"), "test")
        .when(low.rlike("endpoint|router|api|route"), "api")
        .when(low.rlike("cli|command|click|typer"), "entry")
        .when(low.rlike("async|await|stream|sse"), "async")
        .when(low.rlike("component|props|hook|store") | hook | path.rlike(r"\.(tsx|jsx|vue|svelte)$"), "ui")
        .when(raw.rlike(r"^\p{Lu}") & ~raw.endswith("()"), "klass")
        .when(raw.rlike(rf"\.({'|'.join(SOURCE_SUFFIXES)})$"), "module")
        .otherwise("function")
    )


def relation_name(relation: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in RELATION_NAMES.items() for x in pair))
    said = F.trim(F.coalesce(relation, F.lit("")))
    return F.coalesce(names[said], F.replace(said, F.lit("_"), F.lit(" ")))


def is_builtin(label: Column) -> Column:
    return label.isin(*BUILTIN_LABELS)


def is_free_function(label: Column, file_type: Column) -> Column:
    """A function's own name with brackets: no method, no qualified name."""
    text = F.trim(F.coalesce(label, F.lit("")))
    return (file_type == "code") & text.endswith(")") & ~text.contains(".")


def is_type_like(label: Column, file_type: Column) -> Column:
    text = F.trim(F.coalesce(label, F.lit("")))
    return (file_type == "code") & text.rlike(r"^\p{Lu}[\p{L}\p{N}_]*$")


def normalized_path(path: Column, root: Column) -> Column:
    """Slashes for backslashes; an absolute path below root without it."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    base = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    return F.when(p.startswith(base), F.substr(p, F.length(base) + 1)).otherwise(p)


def repo_relative(query: Column, root: Column) -> Column:
    """A path as the graph stores it: without `./`, doubled slashes and the root; other texts and
    paths outside the root stay."""
    tidy = F.regexp_replace(F.regexp_replace(query, "/+", "/"), r"(?<=/)(\./)+|^(\./)+", "")
    tidy = F.when(F.length(tidy) > 1, F.regexp_replace(tidy, "(/\\.)?/$", "")).otherwise(tidy)
    base = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    absolute = F.when(tidy.startswith(base), F.substr(tidy, F.length(base) + 1)).otherwise(query)
    return F.when(query.startswith("/"), absolute).otherwise(tidy)


def attribute_text(attributes: Column) -> Column:
    """Keys and values of a map of strings in order of keys, folded, for search."""
    keys = F.array_sort(F.map_keys(attributes))
    parts = F.flatten(F.transform(keys, lambda k: F.filter(F.array(k, attributes[k]), lambda x: x.isNotNull())))
    return F.lower(strip_diacritics(F.array_join(parts, " ")))


def search_text(label: Column, id_: Column, source: Column, *more: Column) -> Column:
    """Every field that a query may match, parted by NUL so that no match spans two."""
    text, path = F.coalesce(label, F.lit("")), F.coalesce(source, F.lit(""))
    folded = F.lower(strip_diacritics(id_))
    fields = [
        F.lower(strip_diacritics(text)), F.array_join(search_tokens(text), " "), F.lower(id_), F.lower(path), F.array_join(search_tokens(path), " "),
        F.when(folded != F.lower(id_), folded), *(F.when(m != "", m) for m in more),
    ]
    return F.concat_ws("\0", *fields)


def strip_jsonc(text: Column) -> Column:
    """JSON without comments and trailing commas; strings stay as they are."""
    bare = F.regexp_replace(text, r'("(?:\\.|[^"\\])*")|/\*[\s\S]*?\*/|//[^\n]*', "$1")
    return F.regexp_replace(bare, r",(\s*[}\]])", "$1")


def node_line(label: Column, source: Column, community: Column) -> Column:
    return F.concat(F.lit("NODE "), label, F.lit(" [src="), F.coalesce(source, F.lit("")), F.lit(" community="), community.cast("string"), F.lit("]"))


def edge_line(src: Column, dst: Column, relation: Column, confidence: Column, context: Column, source: Column, place: Column) -> Column:
    """With the place of the relation where there is one."""
    at = F.when(F.coalesce(place, F.lit("")) != "", F.concat(F.lit(" at="), F.coalesce(source, F.lit("")), F.lit(":"), place)).otherwise("")
    said = F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit(" context="), context)).otherwise("")
    return F.concat(F.lit("EDGE "), src, F.lit(" --"), relation, F.lit(" ["), confidence, said, F.lit("]--> "), dst, at)


def failure_kind(message: Column, markers: Sequence[str]) -> Column:
    """What to do about a failed call: halve it where it was too long, wait where it was too slow
    or too much, else give up."""
    low = F.lower(message)
    long = F.lit(False)
    for m in markers:
        long = long | low.contains(m)
    return F.when(long, "bisect").when(low.rlike("timed? ?out|rate.?limit|429|503|overloaded"), "retry").otherwise("give up")

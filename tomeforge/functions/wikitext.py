"""Wiki markup as Spark columns: links, categories, titles and keys.

Everything here is built from Spark's own functions, so it runs inside the JVM. A null text
gives a null result, an array function of a text without markup an empty array.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKER = "==References=="
#: All characters with the property White_Space.
_BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_OPEN_LINK = r"(?s)\[\[(?!#)(?![A-Za-z]+:)(?=(.*?)\]\])"
_OPEN_ANY = r"(?s)\[\[(?:(?=Category:)(?=(.*?)\]\]))?"
HIDDEN_TITLES = ("File:", "Template:", "Wikipedia:", "User talk:", "File talk:")
INVALID_ALIASES = ("Wikipedia:", "Template:", "Portal:", "List of ")
KINDS = {
    "file": ("File:", "Image:"),
    "wiktionary": ("wikt:", "wiktionary:"),
    "wikisource": ("s:",),
    "wikiversity": ("v:",),
    "handle": ("hdl:",),
}
ANCHOR = "struct<page:string,surface:string>"


def starts_with_any(value: Column, prefixes: tuple[str, ...]) -> Column:
    out = value.startswith(prefixes[0])
    for prefix in prefixes[1:]:
        out = out | value.startswith(prefix)
    return out


def utrim(value: Column) -> Column:
    """Without Unicode white space at either end; by itself, Spark's trim knows the blank alone."""
    return F.trim(value, F.lit(_BLANKS))


def closed_part(text: Column) -> Column:
    """The text through its last ``]]``: no link that is closed opens behind it."""
    return F.regexp_extract(text, r"(?s)^.*\]\]", 0)


def link_candidates(text: Column) -> Column:
    """Text of every link, in order: from each ``[[`` to the next ``]]``, nested ones included.

    Links that begin with ``#`` or with ASCII letters and a colon are left out. The scan stops at
    the last ``]]``, so brackets that are never closed cost nothing.
    """
    return F.regexp_extract_all(closed_part(text), F.lit(_OPEN_LINK), F.lit(1))


def anchor_page(candidate: Column) -> Column:
    """Target of a link: before the first pipe and before a fragment.

    Without a pipe, the fragment is sought in the untrimmed text and cut from the trimmed one; with
    one, blanks before the fragment stay.
    """
    pipe = F.instr(candidate, "|")
    hash_at = F.instr(candidate, "#")
    whole = utrim(candidate)
    return (
        F.when(pipe > 0, F.substring_index(utrim(F.left(candidate, pipe - 1)), "#", 1))
        .when(hash_at > 0, F.left(whole, hash_at - 1))
        .otherwise(whole)
    )


def anchor_surface(candidate: Column) -> Column:
    """Label behind the first pipe, trimmed and without outer apostrophes; null where there is none."""
    pipe = F.instr(candidate, "|")
    label = F.trim(utrim(F.substr(candidate, pipe + 1)), F.lit("'"))
    return F.when(pipe > 0, F.nullif(label, F.lit("")))


def parse_anchor(candidate: Column) -> Column:
    """(page, surface) of a link's text; a null surface means that the page's name is shown."""
    return F.struct(anchor_page(candidate).alias("page"), anchor_surface(candidate).alias("surface"))


def before_references(text: Column) -> Column:
    """The text ahead of the last references heading, or all of it."""
    return F.regexp_replace(text, f"(?s)^(.*){MARKER}.*$", "$1")


def from_references(text: Column) -> Column:
    """The text from the last references heading on, or all of it."""
    return F.regexp_replace(text, f"(?s)^.*(?={MARKER})", "")


def page_anchors(text: Column) -> Column:
    """Anchors of a page's body, in order."""
    return F.transform(link_candidates(before_references(text)), parse_anchor)


def page_categories(text: Column) -> Column:
    """Categories named from the last references heading on, or anywhere where there is none."""
    found = F.regexp_extract_all(closed_part(from_references(text)), F.lit(_OPEN_ANY), F.lit(1))
    named = F.filter(found, lambda c: c.startswith("Category:"))
    return F.transform(named, lambda c: F.substr(F.substring_index(c, "|", 1), F.lit(len("Category:") + 1)))


def is_filtered_title(title: Column) -> Column:
    return starts_with_any(title, HIDDEN_TITLES)


def is_valid_alias(title: Column) -> Column:
    return ~starts_with_any(title, INVALID_ALIASES)


def is_template_title(title: Column) -> Column:
    return title.startswith("Template:")


def is_kind(page: Column, kind: str) -> Column:
    """Whether a target belongs to one of KINDS."""
    return starts_with_any(page, KINDS[kind])


def anchor_kind(page: Column) -> Column:
    """Name of the first of KINDS that a target belongs to, or null."""
    names = list(KINDS)
    out = F.when(is_kind(page, names[0]), F.lit(names[0]))
    for name in names[1:]:
        out = out.when(is_kind(page, name), F.lit(name))
    return out


def counts_in_flat(candidate: Column) -> Column:
    """Whether the flat counter takes a link, by its raw text: label, blanks and fragment included."""
    talk = F.contains(candidate, F.lit("User talk:")) | F.contains(candidate, F.lit("File talk:"))
    return ~(candidate.startswith(":") | candidate.startswith("<") | talk)


def surface_key(page: Column, surface: Column) -> Column:
    """Lower-case label, or the page's name where there is no label."""
    return utrim(F.lower(F.coalesce(surface, page)))


def entity_key(page: Column) -> Column:
    return utrim(page)


def pair_key(surface: Column, entity: Column) -> Column:
    """The two keys in one string, with a tab between them."""
    return F.concat(surface, F.lit("\t"), entity)


def key_surface(key: Column) -> Column:
    """A key's part before its first tab."""
    return F.substring_index(key, "\t", 1)


def key_entity(key: Column) -> Column:
    """A key's part behind its first tab; null where there is none."""
    return F.get(F.split(key, "\t", 2), F.lit(1))


def outlinks(anchors: Column) -> Column:
    """Targets with underscores for blanks, joined by blanks."""
    return F.array_join(F.transform(anchors, lambda a: F.replace(a["page"], F.lit(" "), F.lit("_"))), " ")


def fully_qualified_category(name: Column) -> Column:
    return F.concat(F.lit("Category:"), name)


def title_stripped(title: Column, cut: bool = False) -> Column:
    """The title unchanged; with `cut`, what stands before its first parenthesis or comma."""
    return F.regexp_replace(title, r"(?s)[(,].*$", "") if cut else title


def positions_of(haystack: Column, needle: Column) -> Column:
    """0-based character positions of the needle, overlapping ones included; none for an empty needle.

    The text is split ahead of every occurrence, in one pass, and the pieces' lengths are added up.
    """
    literal = F.concat(F.lit(r"(?=\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    pieces = F.split(haystack, literal, -1)
    start = F.struct(F.lit(0).alias("at"), F.when(haystack.startswith(needle), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")).alias("found"))

    def step(state: Column, piece: Column) -> Column:
        behind = state["at"] + F.length(piece)
        return F.struct(behind.alias("at"), F.array_append(state["found"], behind).alias("found"))

    places = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), start, step, lambda s: s["found"])
    return F.when((F.length(haystack) > 0) & (F.length(needle) > 0), places).when(haystack.isNotNull() & needle.isNotNull(), F.array().cast("array<int>"))


def template_text(title: Column, page: Column) -> Column:
    """A template as the page block that template stores hold; its text goes in as it is."""
    rows = (
        F.lit("<page>"),
        F.concat(F.lit("   <title>"), title, F.lit("</title>")),
        F.lit("   <ns>10</ns>"),
        F.concat(F.lit("   <text>"), page),
        F.lit("   </text>"),
        F.lit("</page>"),
    )
    # array_join leaves nulls out, so a null part must make the whole null
    return F.when(title.isNotNull() & page.isNotNull(), F.array_join(F.array(*rows), "\n"))

"""Scalar text functions as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def slug(s: Column) -> Column:
    """Lower case, apostrophes dropped, other runs than letters, digits and hyphens one hyphen, none at the ends."""
    x = F.regexp_replace(F.regexp_replace(F.lower(s), "'", ""), "[^-a-z0-9]+", "-")
    return F.regexp_replace(F.regexp_replace(x, "-+", "-"), "^-|-$", "")


def url_file(url: Column) -> Column:
    """The part after the last slash, then after the last ``=``, then up to ``?``, in this order."""
    x = F.element_at(F.split(F.element_at(F.split(url, "/"), -1), "="), -1)
    return F.element_at(F.split(x, r"\?"), 1)


def split_trim(s: Column, separator: str = ";") -> Column:
    return F.transform(F.split(s, re.escape(separator)), lambda x: F.trim(x))


def stem(path: Column) -> Column:
    """The file name without folders and without its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def link_names(s: Column) -> Column:
    """Names of ``[[name]]`` and ``[[name|alias]]`` links, first mention first."""
    return F.array_distinct(F.regexp_extract_all(s, F.lit(r"\[\[([^\]|]+)"), F.lit(1)))


def without_links(s: Column) -> Column:
    return trimmed(F.regexp_replace(s, r"\[\[[^\]]+\]\]", ""))


def cut_bytes(s: Column, n: int) -> Column:
    """At most n bytes of UTF-8 and an ellipsis where something is cut; a character that would be split is left out."""
    hexed = F.hex(F.substring(F.encode(s, "UTF-8"), 1, n))
    # a lead byte at the end without all its continuation bytes
    torn = "(?:[CDEF].|[EF].[89AB].|F.[89AB].[89AB].)$"
    whole = "(?:[CD].[89AB].|E.[89AB].[89AB].|F.[89AB].[89AB].[89AB].)$"
    kept = F.when(hexed.rlike(whole), hexed).otherwise(F.regexp_replace(hexed, torn, ""))
    return F.when(F.octet_length(s) > n, F.concat(F.decode(F.unhex(kept), "UTF-8"), F.lit("…"))).otherwise(s)


def trimmed(s: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(s, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")


def squeeze(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"[ \t\n\x0B\f\r]+", " "))


def minutes_seconds(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.format_string("%02d:%02d", F.floor(s / 60).cast("long"), s % 60)


def snake(s: Column) -> Column:
    """camelCase to snake_case: an underscore before each capital that neither begins the name nor follows an underscore."""
    return F.lower(F.regexp_replace(s, r"(?<!_|^)([A-Z])", "_$1"))


def unquote(s: Column) -> Column:
    """Without the quotes around it, if both ends have the same; line ends count as any character."""
    return F.regexp_replace(s, r"(?s)^(['\"])(.*)\1\z", "$2")


def error_code(s: Column) -> Column:
    return F.regexp_replace(F.lower(s), "[^a-z0-9_]", "_")


def record_map(s: Column) -> Column:
    """``key: value`` lines as a map; the first hyphen of a key becomes an underscore, quotes in values too. The last of a key counts."""
    pairs = F.filter(F.transform(F.split(s, "\n"), lambda x: F.split(x, ":", 2)), lambda x: F.size(x) == 2)
    entries = F.transform(pairs, lambda x: F.struct(F.regexp_replace(F.trim(x[0]), "^([^-]*)-", "$1_").alias("k"), F.regexp_replace(F.trim(x[1]), "['\"]", "_").alias("v")))
    keys = F.array_distinct(F.transform(entries, lambda x: x["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda x: x["k"] == k), -1)["v"]))


def query_map(url: Column) -> Column:
    """Parameters of a url's query string; the first of a name counts."""
    q = F.regexp_extract(url, r"\?([^#]*)", 1)
    pairs = F.transform(F.filter(F.split(q, "&"), lambda x: x != ""), lambda x: F.split(x, "=", 2))
    keys = F.array_distinct(F.transform(pairs, lambda x: x[0]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.coalesce(F.try_element_at(F.element_at(F.filter(pairs, lambda x: x[0] == k), 1), F.lit(2)), F.lit(""))))


def integer_kind(s: Column) -> Column:
    """binary, octal, bad octal, hex or decimal literal; null for anything else."""
    x = F.lower(s)
    return (
        F.when(x.rlike("^0b[01]+$"), "binary").when(x.rlike("^0x[0-9a-f]+$"), "hex").when(x.rlike("^0[0-7]*[89][0-9]*$"), "bad octal")
        .when(x.rlike("^0[0-7]+$"), "octal").when(x.rlike("^(0|[1-9][0-9]*)$"), "decimal")
    )


def glob_body(glob: str) -> str:
    """A regex of a glob with * and ?, without anchors."""
    return "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob)


def glob_regex(glob: str) -> str:
    """A whole-string regex of a glob with * and ?."""
    return "^" + glob_body(glob) + "$"


def natural_key(s: Column) -> Column:
    """An array that sorts numbers in s by value, whatever their length: runs of digits by the count of digits, then by these; leading zeros don't count.

    A number sorts before other text, and between equal keys nothing is decided.
    """
    parts = F.regexp_extract_all(s, F.lit(r"(\d+|\D+)"), F.lit(1))
    bare = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    number = lambda x: F.struct(F.lit(0).alias("kind"), F.length(bare(x)).alias("digits"), bare(x).alias("text"))
    other = lambda x: F.struct(F.lit(1).alias("kind"), F.lit(0).alias("digits"), x.alias("text"))
    return F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), number(x)).otherwise(other(x)))


def capitalise(s: Column) -> Column:
    """Each run of letters with a capital first and small letters after."""
    parts = F.regexp_extract_all(s, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))), "")


def underscored(s: Column) -> Column:
    """Dots as underscores."""
    return F.translate(s, ".", "_")


def one_quote(s: Column) -> Column:
    """Carriage returns as line feeds, apostrophes as double quotes."""
    return F.translate(s, "\r'", '\n"')


def path_entries(s: Column, separator: str = ":") -> Column:
    """The entries of a path list, in order."""
    return F.split(s, re.escape(separator))


_LINK = r"\[\[[^\]]*\]\]"


def hide_links(s: Column) -> Column:
    """(text, links): each link replaced by a mark of its length that has no blank, and the links in order."""
    links = F.regexp_extract_all(s, F.lit(f"({_LINK})"), F.lit(1))
    marks = F.transform(links, lambda x: F.concat(F.lit("\x02"), F.repeat(F.lit("\x01"), F.length(x) - 1)))
    return F.struct(_woven(F.split(s, _LINK), marks).alias("text"), links.alias("links"))


def show_links(text: Column, links: Column) -> Column:
    """The text with its marks replaced by the links in order; what was between them may have changed."""
    return _woven(F.split(text, "\x02\x01*"), links)


def _woven(parts: Column, between: Column) -> Column:
    return F.array_join(F.transform(parts, lambda x, i: F.concat(x, F.coalesce(F.get(between, i), F.lit("")))), "")


def line_prefix(s: Column) -> Column:
    """(prefix, continuation, rest) of a line: a numbered or bulleted mark, which further lines continue by blanks, a quote mark, or an indent, which they repeat."""
    listed = F.regexp_extract(s, r"^(\s*\d+\.\s+)", 1)
    listed = F.when(listed == "", F.regexp_extract(s, r"^(\s*[-*]\s+)", 1)).otherwise(listed)
    quoted = F.regexp_extract(s, r"^(\s*>\s*)", 1)
    indent = F.regexp_extract(s, r"^(\s+)", 1)
    prefix = F.coalesce(F.nullif(listed, F.lit("")), F.nullif(quoted, F.lit("")), indent)
    continuation = F.when((listed != "") | (quoted != ""), F.repeat(F.lit(" "), F.length(prefix))).otherwise(prefix)
    return F.struct(prefix.alias("prefix"), continuation.alias("continuation"), F.substr(s, F.length(prefix) + 1).alias("rest"))


#: Formats of dates in names.
DATE_NAMES = {"day": "yyyy-MM-dd", "stamp": "yyyyMMddHHmmss", "notes": "yyyy-MM-dd 'Notes'", "numbered": "'00'yyyyMMdd"}


def date_name(at: Column, kind: str = "day") -> Column:
    return F.date_format(at, DATE_NAMES[kind])


#: Fixed value: a variable in a double-quoted string, with members, indexes and calls, in braces or not.
_VARIABLE = r"(?:(?<!\\)\$\{[a-zA-Z_]\w*(?:\[[^\]]+\])*\}|\{(?<!\\)\$[a-zA-Z_]\w*(?:(?:->|::)\$?[a-zA-Z_]\w*|\[[^\]]+\]|\([^)]*\))*\}|(?<!\\)\$[a-zA-Z_]\w*(?:(?:->|::)\$?[a-zA-Z_]\w*|\[[^\]]+\]|\([^)]*\))*)"


def without_variables(s: Column) -> Column:
    return F.when(F.contains(s, F.lit("$")), F.regexp_replace(s, _VARIABLE, "")).otherwise(s)


def extension_at(name: Column, first: bool = False) -> Column:
    """How many characters of a name come before its extension: before its last dot, or with ``first`` before the first dot after other characters; null if there is none."""
    found = F.length(F.regexp_extract(name, r"^(\.*[^.]+)" if first else r"^(.*)\.", 1))
    return F.when(F.contains(name, F.lit(".")) | F.lit(first), found)


def put_entry(m: Column, key: str, value: Column) -> Column:
    """A map with an entry set, or taken out if the value is empty."""
    kept = F.map_filter(m, lambda k, v: k != F.lit(key))
    return F.when(F.coalesce(value, F.lit("")) == "", kept).otherwise(F.map_concat(kept, F.create_map(F.lit(key), value)))


def get_entry(m: Column, key: str) -> Column:
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(""))


def keys_with(m: Column, prefix: str) -> Column:
    """The keys that begin with prefix, in order."""
    return F.array_sort(F.filter(F.map_keys(m), lambda k: k.startswith(prefix)))


def note_text(title: Column, date: Column, tag: str = "Notes") -> Column:
    """A note with front matter and its title as heading."""
    from .templates import NOTE, render

    return render(NOTE, {"title": title, "date": date_name(date), "tags": F.array(F.lit(tag))})


def pretty_json(s: Column, schema: str) -> Column:
    return F.to_json(F.from_json(s, schema), {"pretty": "true"})


#: The kind of definition that each keyword of the language begins.
DEFINED_BY = {"fn": "function", "type": "type", "enum": "enum", "struct": "struct", "mod": "module", "static": "const", "const": "const", "trait": "trait", "impl": "impl", "macro_rules!": "macro"}
#: Words that may stand before the keyword, and the kinds that take them.
QUALIFIERS, QUALIFIED = ("default", "unsafe", "async", "extern"), ("function", "trait", "impl")


def _after(s: Column, regex: str) -> Column:
    """What follows a match at the beginning; all of it if there is none."""
    return F.regexp_replace(s, r"\A" + regex, "")


def symbols(line: Column) -> Column:
    """array<(kind, name)> of what a line of Rust defines, one entry at most.

    A line is taken apart from the left: attributes, visibility (``pub``, with or without a scope), qualifiers with a quoted calling convention, keyword,
    name. ``const`` before a function is a qualifier. The name of an ``impl`` of a trait for a type names both, its parameters left out: ``Trait for Type``.
    """
    shown = _after(_after(line, r"\s*(?:#!?\[[^\]]*\]\s*)*"), r"pub(?:\s*\([^)]*\))?\s+")
    words = "|".join([*QUALIFIERS, r'"[^"]+"', rf"const(?=\s+(?:{'|'.join(QUALIFIERS)}|fn)\b)"])
    bare = _after(shown, rf"(?:(?:{words})\s+)+")
    keyword = F.regexp_extract(bare, r"\A(\w+!?)", 1)
    kind = F.try_element_at(F.create_map(*(F.lit(x) for pair in DEFINED_BY.items() for x in pair)), keyword)
    rest = F.substr(bare, F.length(keyword) + 1)
    plain = F.regexp_extract(_after(rest, r"(?=\s)(?:\s+mut(?=\s))?"), r"\A\s+(\w+)", 1)
    params = r"<(?:[^<>]|<[^<>]*>)*>"
    of = _after(rest, rf"\s*{params}")
    trait = F.regexp_extract(of, rf"\A\s+([\w:]+)\s*(?:{params})?\s+for\s", 1)
    type_ = F.regexp_extract(F.when(trait != "", _after(of, rf"\s+[\w:]+\s*(?:{params})?\s+for(?=\s)")).otherwise(of), r"\A\s+([\w:]+)", 1)
    name = F.when(kind != "impl", plain).when(trait != "", F.concat_ws(" for ", trait, type_)).otherwise(type_)
    right = kind.isNotNull() & (name != "") & ((F.length(bare) == F.length(shown)) | kind.isin(*QUALIFIED))
    return F.when(right, F.array(F.struct(kind.alias("kind"), name.alias("name")))).otherwise(F.array().cast("array<struct<kind:string,name:string>>"))


def hyphenated_file(name: Column) -> Column:
    """The expected name of a file: its stem in small letters with hyphens for punctuation, and its last extension."""
    dot = extension_at(name)
    return F.concat(F.lower(F.regexp_replace(F.left(name, F.coalesce(dot, F.length(name))), r"\p{Punct}", "-")), F.when(dot.isNotNull(), F.substr(name, dot + 1)).otherwise(F.lit("")))


def class_file(class_name: Column, file: Column) -> Column:
    """The expected name of the file of a class."""
    dot = extension_at(file)
    return F.concat(F.lit("class-"), F.lower(F.translate(class_name, "_", "-")), F.when(dot.isNotNull(), F.substr(file, dot + 1)).otherwise(F.lit("")))


def peeled(s: Column, names: list[str]) -> Column:
    """The last lines of a record as fields, the last line first; the last field has all that is left. Fields that the record lacks repeat its first line, as peeling finds no line end."""
    lines = F.split(s, "\n")
    n = F.size(lines)
    fields = [F.element_at(lines, F.greatest(n - i, F.lit(1))).alias(x) for i, x in enumerate(names[:-1])]
    return F.struct(*fields, F.array_join(F.slice(lines, 1, F.greatest(n - len(names) + 1, F.lit(1))), "\n").alias(names[-1]))


def leading_word(identifier: Column) -> Column:
    """The first word of an identifier in small letters, without $, _ and backslashes before it."""
    bare = F.regexp_replace(identifier, r"^[$_\\]+", "")
    return F.lower(F.regexp_extract(bare, r"^([A-Z]*[a-z0-9]*+)", 1))


def decimal_value(s: Column) -> Column:
    """The whole number that a literal or a quoted run of digits stands for: binary, octal, hex or decimal, signed or not; null for anything else."""
    bare = unquote(s)
    quoted = bare != s
    sign = F.when(F.regexp_extract(bare, "^([-+]?)", 1) == "-", -1).otherwise(1)
    x = F.lower(F.when(quoted, bare).otherwise(F.regexp_replace(bare, "^[-+]+", "")))
    number = (
        F.when(x.rlike("^0b[01]+$"), F.conv(F.substr(x, F.lit(3)), 2, 10)).when(x.rlike("^0x[0-9a-f]+$"), F.conv(F.substr(x, F.lit(3)), 16, 10))
        .when(x.rlike("^0[0-7]+$") & ~quoted, F.conv(x, 8, 10)).when(x.rlike("^(0|[1-9][0-9]*)$") | quoted & x.rlike("^[0-9]+$"), x)
    )
    return F.when(~quoted | bare.rlike("^[0-9]+$"), number.try_cast("long") * sign)

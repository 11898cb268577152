"""Scalar functions over names, paths and texts, as columns."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

#: Least length of a word that counts as the stem of another.
MIN_STEM = 4
# Fixed value: the pattern that cuts CamelCase and snake_case names into words.
WORD = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z0-9]+|[A-Z]+"


def words(name):
    """The distinct lower-case words of a CamelCase or snake_case name."""
    return F.array_distinct(F.transform(F.regexp_extract_all(name, F.lit(f"({WORD})"), F.lit(1)), F.lower))


def share_a_word(xs, ys):
    """True if a word of xs equals one of ys, or one is a stem (MIN_STEM letters or more) of the other."""
    stem = lambda short, long: (F.length(short) >= MIN_STEM) & long.startswith(short)
    return F.exists(xs, lambda x: F.exists(ys, lambda y: (x == y) | stem(x, y) | stem(y, x)))


def first_sentence(text):
    """The first sentence after white space is collapsed; empty for null."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.get(F.split(flat, r"(?<=[.!?])\s+", 2), F.lit(0))


def mentioned(name, text):
    """True if the name stands as a whole word in the text, in either case; a hyphen is part of a word."""
    quoted = F.concat(F.lit(r"(?<![\w-])\Q"), F.lower(name), F.lit(r"\E(?![\w-])"))
    return F.regexp_like(F.lower(text), quoted)


def camel(dotted, whole: bool = False):
    """CamelCase of a dotted name; without ``whole`` the first of several segments is left out."""
    parts = F.split(dotted, r"\.")
    used = parts if whole else F.when(F.size(parts) > 1, F.slice(parts, 2, 1 << 20)).otherwise(parts)
    pieces = F.filter(F.flatten(F.transform(used, lambda s: F.split(s, r"[_\W]+"))), lambda w: w != "")
    return F.array_join(F.transform(pieces, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), "")


def text_digest(text):
    """sha256 of the text with all line ends as \\n."""
    return F.sha2(F.regexp_replace(text, "\r\n?", "\n"), 256)


def entry_identity(kind, module, target, name):
    """The JSON array of the four fields that identify a way in."""
    return F.to_json(F.array(*[F.coalesce(c, F.lit("")) for c in (kind, module, target, name)]))


def module_of(path, root: str = ""):
    """The dotted module of a Python file below ``root``."""
    inner = F.regexp_replace(path, f"^{re.escape(root)}/?", "") if root else path
    return F.replace(F.regexp_replace(inner, r"(/__init__)?\.py$", ""), F.lit("/"), F.lit("."))


def plane_of(module, planes: list[str]):
    """The second segment of the name if it is listed, else ``core``."""
    second = F.get(F.split(module, r"\."), F.lit(1))
    return F.when(second.isin(planes), second).otherwise("core")


def ref_module(ref):
    """The module of ``module[:symbol]@digest``."""
    return F.substring_index(F.substring_index(ref, "@", 1), ":", 1)


def edge_key(src, dst):
    return F.concat(src, F.lit("->"), dst)


def opening(text, limit: int = 300):
    """The first paragraph on one line, at most ``limit`` characters, empty if it is a notice."""
    first = F.regexp_replace(F.trim(F.get(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n", 2), F.lit(0))), r"\s+", " ")
    return F.when(is_notice(first), "").otherwise(F.substring(first, 1, limit))


def is_notice(text):
    """True if the text begins as a license or copyright notice."""
    return F.regexp_like(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"^\s*(copyright|\(c\)|licen[sc]ed? |all rights reserved|spdx-)"))


def printable(text):
    """Control characters as ``\\xNN``: seen, not acted on."""
    cut = F.split(text, "")
    return F.array_join(F.transform(cut, lambda c: F.when(F.regexp_like(c, F.lit(r"^[\x00-\x1f\x7f]$")), F.concat(F.lit("\\x"), F.lower(F.lpad(F.hex(F.ascii(c)), 2, "0")))).otherwise(c)), "")


def has_control(name):
    return F.regexp_like(name, F.lit(r"[\x00-\x1f\x7f]"))


def flat(text, limit: int):
    """One line of at most ``limit`` characters."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, limit)


def headings(markdown):
    """The titles of the second-level headings of a Markdown text."""
    return F.regexp_extract_all(markdown, F.lit(r"(?m)^##[ \t]+(.+?)[ \t]*$"), F.lit(1))


def identifier_at(text):
    """The identifier (and method) that a text begins with, empty if none."""
    return F.regexp_extract(text, r"^([\p{L}_][\p{L}\p{N}_]*(?:\.[\p{L}_][\p{L}\p{N}_]*)?)", 1)


def glob_pattern(glob: str) -> str:
    """A regular expression for a path glob: ``**/`` any folders, ``*`` and ``?`` within one name."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i]) or re.escape(glob[i])
            i += 1
    return f"^{out}$"


def overlap_area(ax, ay, aw, ah, bx, by, bw, bh):
    """Area that two rectangles share."""
    wide = F.greatest(F.lit(0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    high = F.greatest(F.lit(0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    return wide * high


def polyline_length(xs, ys):
    """Sum of the horizontal and vertical steps of a polyline given as two arrays."""
    steps = lambda a: F.aggregate(F.zip_with(F.slice(a, 2, 1 << 20), F.slice(a, 1, F.size(a) - 1), lambda p, q: F.abs(p - q)), F.lit(0.0), lambda s, d: s + d)
    return F.when(F.size(xs) > 1, steps(xs) + steps(ys)).otherwise(F.lit(0.0))


def common_parent(paths):
    """The longest folder that all paths of the array share."""
    parts = F.transform(paths, lambda p: F.slice(F.split(p, "/"), 1, F.size(F.split(p, "/")) - 1))
    first = F.get(parts, F.lit(0))
    keep = F.filter(F.sequence(F.lit(1), F.greatest(F.size(first), F.lit(1))), lambda i: F.forall(parts, lambda p: F.slice(p, 1, i) == F.slice(first, 1, i)) & (i <= F.size(first)))
    return F.array_join(F.slice(first, 1, F.coalesce(F.array_max(keep), F.lit(0))), "/")


def plan_id(day, task):
    """Day, eight digits of the task's digest, and its first four words."""
    slug = F.array_join(F.slice(F.regexp_extract_all(F.lower(task), F.lit("([a-z0-9]+)"), F.lit(1)), 1, 4), "-")
    return F.concat_ws("-", F.date_format(day, "yyyyMMdd"), F.substring(F.sha2(task, 256), 1, 8), slug)


def days_between(a, b):
    return F.abs(F.datediff(a, b))


def canonical_digest(*columns):
    """sha256 of the columns joined by a unit separator; arrays are sorted first. Nulls count as empty."""
    texts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.sha2(F.concat_ws("\x1f", *texts), 256)

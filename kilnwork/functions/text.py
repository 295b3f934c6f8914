"""Scalar functions on text as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapsed(text: Column) -> Column:
    """HTML white space (tab, line feed, form feed, carriage return, blank) in runs becomes one blank; no-break spaces stay."""
    return F.regexp_replace(text, r"[\t\n\f\r ]+", " ")


def class_tokens(value: Column) -> Column:
    """The distinct tokens of a class attribute, parted by any Unicode white space."""
    return F.array_distinct(F.filter(F.split(value, r"(?U)\s+"), lambda x: x != ""))


def math_normal(text: Column) -> Column:
    r"""Paired $$$..$$$ become $..$ with `\lt` read as < inside; what follows an unpaired $$$ is left as it is."""
    parts = F.split(text, F.lit(r"\Q$$$\E"), -1)
    n = F.size(parts)
    paired = n - 1 - F.pmod(n - 1, F.lit(2))  # how many of the marks have a partner

    def part(x: Column, k: Column) -> Column:
        inside = (k % 2 == 1) & (k < paired)
        body = F.when(inside, F.replace(x, F.lit("\\lt"), F.lit("<"))).otherwise(x)
        return F.concat(F.when(k == 0, "").when(k <= paired, "$").otherwise("$$$"), body)

    return F.when(F.contains(text, F.lit("$$$")), F.array_join(F.transform(parts, part), "")).otherwise(text)


def escaped(text: Column) -> Column:
    """HTML escapes, quotes included."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


# The languages that a code block may name.
LANGUAGES = ("bash", "c", "cpp", "csharp", "go", "java", "javascript", "kotlin", "pascal", "php", "python", "qsharp", "ruby", "rust", "scala", "swift", "typescript")

# For each language, in the order that they are tried, what the first 400 characters must (and must not) match.
_SIGNS: list[tuple[str, list[str], list[str]]] = [
    ("qsharp", [r"\boperation\s+[A-Za-z_]\w*\s*(?:<[^>]+>\s*)?\("], []),
    ("qsharp", [r"\bfunction\s+[A-Za-z_]\w*\s*(?:<[^>]+>\s*)?\(", r"Qubit|Microsoft\.Quantum"], []),
    ("c", [r"#include\s*[<\"]", r"\b(?:printf|scanf)\s*\("], [r"\b(?:cin|cout|std::|vector<)\b|bits/stdc\+\+"]),
    ("cpp", [r"#include\s*[<\"]|\b(?:cin|cout|endl|std::|vector<|using namespace|int main\s*\()"], []),
    ("rust", [r"\bfn\s+\w+\s*\(", r"\b(?:let\s+mut|println!|use\s+\w+::)"], []),
    ("kotlin", [r"\bfun\s+\w+\s*\("], []),
    ("go", [r"\b(?:package\s+main|func\s+\w+\s*\()"], []),
    ("csharp", [r"\busing\s+System(?:\.|;)|\bConsole\.(?:Write|Read)|\bstatic\s+void\s+Main\s*\("], []),
    ("java", [r"\bSystem\.out|\bimport\s+java\.|\bstatic\s+void\s+main\s*\(\s*String(?:\[\]|\s*\.\.\.)"], []),
    ("python", [r"\bdef\s+\w+\s*\([^)]*\)\s*:"], []),
    ("python", [r"\bprint\s*\(", r"\b(?:for\s+\w+\s+in|range\s*\(|import\s+\w+|from\s+\w+\s+import|if\s+__name__)"], []),
    ("javascript", [r"\bfunction\s+\w+\s*\("], []),
    ("javascript", [r"\b(?:const|let|var)\s+\w+", "=>"], []),
]


def code_language(code: Column) -> Column:
    """The language that a piece of code looks like, by its first 400 characters; null if none."""
    head = F.substring(code, 1, 400)
    out = F.when(F.trim(F.regexp_replace(head, r"(?U)\s+", " ")) == "", F.lit(None).cast("string"))
    for name, must, not_ in _SIGNS:
        test = F.lit(True)
        for sign in must:
            test = test & head.rlike(f"(?U){sign}")
        for sign in not_:
            test = test & ~head.rlike(f"(?U){sign}")
        out = out.when(test, name)
    return out


def media_type(value: Column) -> Column:
    return F.lower(F.trim(F.substring_index(value, ";", 1)))


def without_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", " ")


def stem(name: Column) -> Column:
    """A file name up to its first full stop."""
    return F.substring_index(name, ".", 1)


def heading_level(value: Column) -> Column:
    """The level that a string of digits gives, 6 for anything else."""
    return F.when(value.rlike("^[0-9]{1,9}$"), F.try_to_number(value, F.lit("999999999")).cast("int")).otherwise(6)


def canonical_json(text: Column) -> Column:
    """The compact form with sorted keys; null where the text is no JSON or an object repeats a key."""
    return F.to_json(F.try_parse_json(text))


def is_canonical(text: Column) -> Column:
    return F.coalesce(canonical_json(text) == text, F.lit(False))


def valid_timestamp(text: Column) -> Column:
    """A UTC time in ISO form that ends with Z."""
    return F.coalesce(F.endswith(text, F.lit("Z")) & F.try_to_timestamp(text).isNotNull(), F.lit(False))


def valid_reference(contest: Column, index: Column) -> Column:
    return F.coalesce(contest.rlike(r"(?U)^\d{1,6}$") & index.rlike(r"^[\p{L}\p{N}]{1,3}$"), F.lit(False))


def valid_problem_code(code: Column) -> Column:
    return F.coalesce(code.rlike(r"^\p{Nd}[\p{L}\p{N}]{0,8}$"), F.lit(False))


def safe_component(value: Column) -> Column:
    """A name of letters, digits, full stops, underscores and dashes that is not `.` or `..`."""
    return F.coalesce(value.rlike(r"^[A-Za-z0-9._-]+$") & ~value.isin(".", ".."), F.lit(False))


def blocked_page(body: Column, markers: tuple[str, ...]) -> Column:
    """Whether a page holds one of the markers of a block, in any case."""
    low = F.lower(body)
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(low, F.lit(m))
    return F.coalesce(out, F.lit(False))

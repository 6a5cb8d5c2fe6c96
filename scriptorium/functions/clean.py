"""Cleaning and normalising of text as column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .translit import nfd

#: Vowel and nasal letters of Manding Latin folded to ASCII. Fixed values.
FOLDED = [("ɛ", "e"), ("ɔ", "o"), ("ɲ", "ny"), ("ŋ", "ng")]
#: Character references that are resolved in SQL. Fixed values.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
PUNCTUATION = "[،؟!.,:;\"\\[\\](){}]"


def words(text: Column) -> Column:
    """Runs between white space; none for an empty or blank text."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def phrase(text: Column) -> Column:
    """Punctuation taken out, white space folded; case is kept."""
    return F.array_join(words(F.regexp_replace(text, PUNCTUATION, "")), " ")


def word_form(text: Column) -> Column:
    """Lower case without combining marks."""
    return F.trim(F.regexp_replace(nfd(F.lower(text)), r"\p{Mn}", ""))


def folded(text: Column) -> Column:
    """Lower case with Manding letters in ASCII."""
    out = F.lower(F.trim(text))
    for a, b in FOLDED:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def entities(text: Column) -> Column:
    for a, b in ENTITIES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _squeeze(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[ \\t]+", " "), "\\n{3,}", "\n\n"), "^\\s+|\\s+$", "")


def html_to_plain(text: Column) -> Column:
    """Tags taken out, br as a line end, character references resolved."""
    return _squeeze(entities(F.regexp_replace(F.regexp_replace(text, "<br\\s*/?\\s*>", "\n"), "<[^>]+>", "")))


#: What the scanner of wikitext stops at; everything between is text.
MARKUP = re.compile(r"(?P<comment><!--)|(?P<tag></?[A-Za-z][^<>]*>)|(?P<open>\{\{|\{\||\[\[|\[(?=https?://))|(?P<close>\}\}|\|\}|\]\]|\])|(?P<quotes>'{2,})|(?P<switch>__[A-Z]+__)")
PAIRS = {"{{": "}}", "{|": "|}", "[[": "]]", "[": "]"}
HEADING = re.compile(r"(={1,6})\s*(.*?)\s*\1\s*")


def _shown(opener: str, inside: str) -> str:
    """What a reader sees of a closed construct: nothing of templates, tables and links
    into a namespace, the label of other links."""
    if opener in ("{{", "{|"):
        return ""
    if opener == "[[":
        return "" if ":" in inside.split("|", 1)[0] else inside.rsplit("|", 1)[-1]
    return (inside.split(None, 1) + ["", ""])[1]


def plain_wikitext(source: str) -> str:
    """The text a reader sees, in one scan with a stack of open constructs. One that is
    never closed is text, and so is a close without its opener."""
    if source.lstrip()[:9].upper() == "#REDIRECT":
        return ""
    stack: list[tuple[str, list[str]]] = [("", [])]
    at = 0
    while m := MARKUP.search(source, at):
        stack[-1][1].append(source[at : m.start()])
        at, kind, mark = m.end(), m.lastgroup, m[0]
        if kind == "comment":
            end = source.find("-->", at)
            at = len(source) if end < 0 else end + 3
        elif kind == "tag":
            name = re.match(r"</?([A-Za-z]+)", mark)[1].lower()
            if name == "br":
                stack[-1][1].append("\n")
            elif name == "ref" and mark[1] != "/" and not mark.endswith("/>"):
                end = source.find("</ref>", at)
                at = at if end < 0 else end + 6
        elif kind == "open":
            stack.append((mark, []))
        elif kind == "close":
            if PAIRS.get(stack[-1][0]) != mark and mark == "]]" and stack[-1][0] == "[":
                at, mark = at - 1, "]"
            if PAIRS.get(stack[-1][0]) == mark:
                opener, inside = stack.pop()
                stack[-1][1].append(_shown(opener, "".join(inside)))
            else:
                stack[-1][1].append(mark)
    stack[-1][1].append(source[at:])
    out = []
    for line in "".join(opener + "".join(parts) for opener, parts in stack).split("\n"):
        if line.lstrip()[:1] in ("|", "!"):
            line = ""  # left over of a table
        heading = HEADING.fullmatch(line)
        out.append(heading[2] if heading else line.lstrip("*#:;").lstrip() if line[:1] in ("*", "#", ":", ";") else line)
    return "\n".join(out)


@F.pandas_udf(StringType())
def _plain_wikitext(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else plain_wikitext(t) for t in text], dtype=object)


def strip_wikitext(text: Column) -> Column:
    """Plain text of wikitext; a redirect is empty. Templates nest to any depth."""
    return _squeeze(entities(_plain_wikitext(text)))


def clean_generation(text: Column) -> Column:
    """Thinking blocks and special tokens of model output taken out."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "(?s)<think>.*?</think>", ""), "<\\|[^|>]*\\|>", ""))


def strip_fence(text: Column) -> Column:
    """The inside of a fenced block, or the text."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), "^```[a-z]*\\s*", ""), "\\s*```$", ""))


def only_native(text: Column) -> Column:
    """The script's characters, spaces and line ends of a text, less marks of emphasis and a leading label."""
    bare = F.trim(F.regexp_replace(text, "[*`]+", ""))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, "^(?:NKO ?:|nko:)", ""), "[^\\x{07C0}-\\x{07FF} \n]", ""), "^[ \n]+|[ \n]+$", "")


#: What an answer holds, with a place for text that is no JSON.
ANSWER = "slide_title string, has_nko boolean, sections array<struct<type: string, nko_text: string, latin_text: string>>, reading_order array<int>, _bad string"


def ocr(raw: Column, least: int = 3) -> Column:
    """struct(structured, slide_title, sections, reading_order, has_nko, cleaned, nko_chars) of
    a service's answer: JSON, fenced or not, or flat text. Sections without the script go."""
    inside = strip_fence(raw)
    found = F.from_json(inside, ANSWER, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    structured = F.coalesce(found["_bad"].isNull() & inside.startswith("{"), F.lit(False))
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    parsed = F.transform(F.coalesce(found["sections"], F.array()), lambda s: F.struct(F.coalesce(s["type"], F.lit("vocabulary")).alias("type"), only_native(F.coalesce(s["nko_text"], F.lit(""))).alias("nko_text"), some(s["latin_text"]).alias("latin_text")))
    flat = F.array(F.struct(F.lit("vocabulary").alias("type"), only_native(raw).alias("nko_text"), F.lit(None).cast("string").alias("latin_text")))
    sections = F.filter(F.when(structured, parsed).otherwise(flat), lambda s: s["nko_text"] != "")
    n = F.size(sections)
    order = F.filter(F.when(structured, F.coalesce(found["reading_order"], F.array().cast("array<int>"))).otherwise(F.array().cast("array<int>")), lambda i: i < n)
    every = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    cleaned = F.array_join(F.transform(sections, lambda s: s["nko_text"]), " ")
    chars = F.length(F.regexp_replace(cleaned, "[^\\x{07C0}-\\x{07FF}]", ""))
    claimed = F.when(structured, F.coalesce(found["has_nko"], F.lit(False))).otherwise(F.lit(True))
    return F.struct(
        structured.alias("structured"), F.when(structured, some(found["slide_title"])).alias("slide_title"), sections.alias("sections"), F.when(F.size(order) > 0, order).otherwise(every).alias("reading_order"),
        (claimed & (chars >= least)).alias("has_nko"), cleaned.alias("cleaned"), chars.alias("nko_chars"),
    )


def candidates(text: Column) -> Column:
    """Words that may be vocabulary: runs of the script, words with Manding letters, quoted spans."""
    letters = "a-zA-ZɛɔɲŋÈÉÊËèéêëÒÓÔÕòóôõ"
    script = F.regexp_extract_all(text, F.lit("([\\x{07C0}-\\x{07FF}]+)"), F.lit(1))
    special = F.filter(F.transform(F.regexp_extract_all(text, F.lit(f"([{letters}]{{2,}})"), F.lit(1)), F.lower), lambda w: w.rlike("[ɛɔɲŋ]"))
    quoted = F.transform(F.regexp_extract_all(text, F.lit(f"[\"']([{letters}\\s]{{2,}})[\"']"), F.lit(1)), lambda w: F.lower(F.trim(w)))
    return F.array_distinct(F.concat(script, special, F.filter(quoted, lambda w: F.length(w) <= 30)))

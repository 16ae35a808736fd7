"""Scalar text functions as columns; offsets are 0-based, ends exclusive."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: What tiles a text into sentences, and what is cut off their ends.
TILE = r"[^.!?\n]*[.!?\n]+|[^.!?\n]+$"
BLANK = " \t\n\r"
EDGE = " \t\n,;:"
#: A short English stop list for lexical search.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there",
    "these", "they", "this", "to", "was", "will", "with",
)
#: Entity labels and the group of each.
LABEL_GROUPS = {
    "PERSON": "person", "ORG": "org", "GPE": "place", "LOC": "place", "FAC": "place", "DATE": "time", "TIME": "time", "CARDINAL": "number", "QUANTITY": "number", "MONEY": "number",
    "PERCENT": "number", "ORDINAL": "number", "NORP": "group", "EVENT": "thing", "WORK_OF_ART": "thing", "LAW": "thing", "PRODUCT": "thing", "LANGUAGE": "thing",
}
NAMED_GROUPS = ("person", "org", "place", "group", "thing")
#: Words of negation, what dates a time, and what makes one relative. Word borders are spelled out
#: (ASCII letters, digits and the underscore are word characters), so that every engine sees the same ones.
NEGATION = r"(^|[^a-z0-9_])(not|no|never|none|nor|without)([^a-z0-9_]|$)|n't([^a-z0-9_]|$)"
DATED = "(^|[^a-z0-9_])(1[0-9]{3}|20[0-9]{2})s?([^a-z0-9_]|$)|(^|[^a-z0-9_])[0-9]{1,2}(st|nd|rd|th) century([^a-z0-9_]|$)"
RELATIVE = "(^|[^a-z0-9_])(previous|next|following|last|that|this|same|earlier|later|ago|recent)([^a-z0-9_]|$)"


def _trimmed(text: Column, begin: Column, chars: str) -> tuple[Column, Column]:
    cut = F.lit(chars)
    left, right = F.length(F.ltrim(text, cut)), F.length(F.rtrim(text, cut))
    start = begin + F.length(text) - left
    return start, F.greatest(begin + right, start)


#: Pieces that are put together at a time: an array grows by a copy of itself.
BLOCK = 16


def sentences(text: Column) -> Column:
    """array<struct<s, e>>: trimmed sentences that are not blank, found without leaving the row."""
    return _sentences(text, False)


def sentence_texts(text: Column) -> Column:
    """array<struct<s, e, text>>: the same with what they say, so that nobody has to look for it in the whole text again."""
    return _sentences(text, True)


def _sentences(text: Column, said: bool) -> Column:
    blank = F.lit(BLANK)
    cells = F.transform(F.regexp_extract_all(text, F.lit(TILE), F.lit(0)), lambda p: F.struct(
        F.length(p).alias("n"), F.length(F.ltrim(p, blank)).alias("left"), F.length(F.rtrim(p, blank)).alias("right"), *[F.trim(p, blank).alias("text")] * said))
    kind = "array<struct<s: int, e: int" + ", text: string" * said + ">>"
    # A lambda's variable, as an expression in its body would be computed for each of its calls.
    blocks = F.transform(F.array(cells), lambda c: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(c) - 1) / BLOCK), F.lit(0)).cast("int")), lambda k: F.slice(c, k * BLOCK + 1, F.lit(BLOCK))))[0]

    def add(acc: Column, c: Column) -> Column:
        found = F.struct((acc["at"] + c["n"] - c["left"]).alias("s"), (acc["at"] + c["right"]).alias("e"), *[c["text"].alias("text")] * said)
        return F.struct((acc["at"] + c["n"]).alias("at"), F.array_append(acc["out"], found).alias("out"))

    def add_block(acc: Column, block: Column) -> Column:
        start = F.struct(acc["at"].alias("at"), F.expr(f"cast(array() as {kind})").alias("out"))
        return F.aggregate(block, start, add, lambda x: F.struct(x["at"].alias("at"), F.array_append(acc["out"], x["out"]).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{kind}>)").alias("out"))
    # Of a blank piece all is cut off from the left.
    return F.aggregate(blocks, start, add_block, lambda acc: F.filter(F.flatten(acc["out"]), lambda x: x["e"] > x["s"]))


def span_text(text: Column, s: Column, e: Column) -> Column:
    return F.substring(text, s + 1, e - s)


def trim_span(text: Column, s: Column, e: Column) -> Column:
    """struct<s, e> without edge characters (a full stop stays)."""
    start, end = _trimmed(span_text(text, s, e), s, EDGE)
    return F.struct(start.cast("int").alias("s"), end.cast("int").alias("e"))


def span_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap over hull."""
    hull = F.greatest(e1, e2) - F.least(s1, s2)
    return F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0)) / F.nullif(hull, F.lit(0))


def normalize_answer(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(text), r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "), r"(?U)\s+", " "))


def normalize_concept(text: Column) -> Column:
    """Lower case, no possessive, no leading article, figures without thousands commas, only word characters and . % $."""
    out = F.trim(F.replace(F.lower(text), F.lit("’"), F.lit("'")), F.lit(BLANK))
    out = F.regexp_replace(F.regexp_replace(out, "'s$", ""), r"^(the|a|an)\s+", "")
    out = F.regexp_replace(out, r"(?<=\d),(?=\d{3}(?!\d))", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[^\p{L}\p{N}_\s.%$]", " "), r"\s+", " "), F.lit(" ."))


def numbers(text: Column) -> Column:
    """Sorted distinct numbers, without commas."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\d+(?:[.,]\d+)*"), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit("")))))


def negated(text: Column) -> Column:
    return F.lower(text).rlike(NEGATION)


def acronym(text: Column) -> Column:
    """Initials of the capitalised words."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w.rlike(r"^\p{Lu}"))
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")


def title_prefix(title: Column) -> Column:
    return F.concat(F.replace(title, F.lit("_"), F.lit(" ")), F.lit(": "))


def clean_answer(text: Column) -> Column:
    line = F.trim(F.split(F.trim(text, F.lit(BLANK)), "\n")[0])
    return F.trim(F.trim(F.trim(F.regexp_replace(line, "^(?i)answer:", "")), F.lit('"')))


def parse_label(text: Column) -> Column:
    """First of SAME, RELATED, DIFFERENT as a word, or null."""
    return F.nullif(F.regexp_extract(F.upper(text), r"(?:^|[^A-Z0-9_])(SAME|RELATED|DIFFERENT)(?:[^A-Z0-9_]|$)", 1), F.lit(""))


def terms(text: Column) -> Column:
    """Search terms: lower-case words of two characters at least, without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))


def tokens(text: Column) -> Column:
    """White-space tokens, the default of the token seam."""
    return F.filter(F.split(text, r"[ \t\n\r]+"), lambda w: w != "")


def truncate_tokens(text: Column, n: Column) -> Column:
    return F.array_join(F.slice(tokens(text), F.lit(1), n), " ")


def document_of(pid: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(pid, r"^([a-z]+\d+)p", 1), F.lit("")), pid)


def merges_by_string(text: Column, group: Column) -> Column:
    """May a mention merge with equal strings elsewhere without a judged pair?"""
    low = F.lower(text)
    dated, relative = low.rlike(DATED), low.rlike(RELATIVE)
    return F.when(group.isin(*NAMED_GROUPS), True).when(group == "time", dated & ~relative).otherwise(False)


def overlap_score(a: Column, b: Column) -> Column:
    """Distinct lower-case tokens in common: the default cross-encoder."""
    return F.size(F.array_intersect(tokens(F.lower(a)), tokens(F.lower(b))))


def cosine(a: Column, b: Column) -> Column:
    """Inner product in double precision (vectors are of unit length)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)

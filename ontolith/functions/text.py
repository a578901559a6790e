"""Text expressions: chunks, sentences, citations, reply payloads, n-grams. All of them are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences that begin so need no citation.
LEAD_INS = ("根据现有证据", "综上", "如下", "针对该问题")
#: Sentence ends, question marks, citation markers.
SENTENCE = r"([^。！？!?\n]+)([。！？!?\n]|$)"
QUESTION_MARKS = ("？", "?")
MARKER = r"\[([EC])(\d+)\]"


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"(?U)^\s*$")


def sliding_chunks(text: Column, size: int) -> Column:
    """Windows of `size` characters that overlap by a tenth (one at least); none of a blank text, the text itself if short."""
    overlap = max(1, size // 10)
    step = max(1, size - overlap)
    n = F.char_length(text)
    starts = F.sequence(F.lit(0), n - F.lit(overlap + 1), F.lit(step))
    windows = F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size)))
    return F.when(is_blank(text), F.array().cast("array<string>")).when(n <= size, F.array(text)).otherwise(windows)


def sentences(text: Column) -> Column:
    """array<struct<fragment, terminator>>, blank fragments left out."""
    text = F.coalesce(text, F.lit(""))
    parts = F.arrays_zip(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(1)).alias("fragment"), F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(2)).alias("terminator"))
    named = F.transform(parts, lambda p: F.struct(p["fragment"].alias("fragment"), p["terminator"].alias("terminator")))
    return F.filter(named, lambda p: ~is_blank(p["fragment"]))


def has_citation(text: Column) -> Column:
    return text.rlike(MARKER)


def is_lead_in(sentence: Column) -> Column:
    return sentence.rlike("^(" + "|".join(LEAD_INS) + ")")


def assertions(text: Column) -> Column:
    """The stripped sentences that assert something: no questions, no lead-ins."""
    kept = F.filter(sentences(text), lambda p: ~p["terminator"].isin(*QUESTION_MARKS) & ~is_lead_in(strip(p["fragment"])))
    return F.transform(kept, lambda p: strip(p["fragment"]))


def cited(sentences_: Column) -> Column:
    return F.filter(sentences_, lambda s: has_citation(s))


def unsupported(text: Column) -> Column:
    """Sentences that need a citation and have none. A citation exempts before a lead-in does; the result is the same."""
    kept = F.filter(sentences(text), lambda p: ~p["terminator"].isin(*QUESTION_MARKS))
    stripped = F.transform(kept, lambda p: strip(p["fragment"]))
    return F.filter(stripped, lambda s: ~has_citation(s) & ~is_lead_in(s))


def citations(text: Column) -> Column:
    """array<struct<marker, evidence_id, claim_id>> in order of first occurrence: [E3] is evidence E3, [C2] is claim:2."""
    text = F.coalesce(text, F.lit(""))
    markers = F.array_distinct(F.regexp_extract_all(text, F.lit(MARKER), F.lit(0)))

    def refer(m: Column) -> Column:
        evidence, number = F.substring(m, 2, 1) == "E", F.regexp_extract(m, r"(\d+)", 1)
        return F.struct(
            m.alias("marker"),
            F.when(evidence, F.concat(F.lit("E"), number)).alias("evidence_id"),
            F.when(~evidence, F.concat(F.lit("claim:"), number)).alias("claim_id"),
        )

    return F.transform(markers, refer)


def payload(reply: Column) -> Column:
    """A reply's JSON as a variant, without code fences; null if it is not JSON."""
    return F.try_parse_json(strip(F.regexp_replace(strip(reply), r"^```[A-Za-z]*|```$", "")))


def object_payload(reply: Column) -> Column:
    """The text from the first { to the last }, null if there is none."""
    return F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit(""))


def characters(text: Column) -> Column:
    """One string for each code point."""
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def ngrams_of(chars: Column) -> Column:
    """The distinct characters and pairs of neighbours."""
    pairs = F.zip_with(chars, F.slice(chars, F.lit(2), F.greatest(F.size(chars), F.lit(1))), lambda a, b: F.concat(a, b))
    return F.array_union(F.filter(pairs, lambda p: p.isNotNull()), chars)


def ngrams(text: Column) -> Column:
    return ngrams_of(characters(text))


#: Fixed value: what comparison of claim and evidence leaves out besides markers.
PUNCTUATION = r"[\s，。；：、｜|,.;:!?！？（）()【】\[\]\"'“”‘’]"


def comparable(text: Column) -> Column:
    """Without citation markers, punctuation and white space."""
    return F.regexp_replace(F.regexp_replace(text, MARKER, ""), PUNCTUATION, "")


def overlap_ratio(claim_grams: Column, evidence_grams: Column) -> Column:
    """The share of the claim's n-grams that the evidence has; 0 without any."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(claim_grams, evidence_grams)), F.size(claim_grams)), F.lit(0.0))


def entailment(df: DataFrame, claim: str, evidence: str, least: float = 0.7) -> DataFrame:
    """df with a column entailed: whether any of the evidence texts (an array) holds the claim, as a substring or by n-grams.
    Each text is prepared once, in a step of its own."""
    plain = df.withColumn("_claim", comparable(F.col(claim))).withColumn("_evidence", F.transform(evidence, comparable))
    split = plain.withColumn("_chars", characters(F.col("_claim"))).withColumn("_each", F.transform("_evidence", lambda e: F.struct(e.alias("text"), characters(e).alias("chars"))))
    grams = split.withColumn("_grams", ngrams_of(F.col("_chars"))).withColumn("_sets", F.transform("_each", lambda e: F.struct(e["text"].alias("text"), ngrams_of(e["chars"]).alias("grams"))))
    found = (F.col("_claim") != "") & F.exists("_sets", lambda e: e["text"].contains(F.col("_claim")) | (overlap_ratio(F.col("_grams"), e["grams"]) >= least))
    return grams.withColumn("entailed", found).drop("_claim", "_evidence", "_chars", "_each", "_grams", "_sets")


def node_text(label: Column, name: Column, entries: Column) -> Column:
    """label｜name｜k=v、k=v; entries: array<struct<key, value>> in source order. Empty parts are left out."""
    facts = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None")))), "、")
    return F.concat_ws("｜", *[F.nullif(part, F.lit("")) for part in (label, name, facts)])


def object_text(fields: dict[str, Column], entries: Column) -> Column:
    """The first of text, content, description and name that says something, else k=v; k=v."""
    facts = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None")))), "; ")
    said = [F.nullif(fields[k], F.lit("")) for k in ("text", "content", "description", "name") if k in fields]
    return F.coalesce(*said, facts, F.lit(""))


def record_text(name: Column, properties: Column) -> Column:
    """What is embedded of a record: its name, then k=v by key without id, parts separated by ' | '."""
    entries = F.array_sort(F.map_entries(F.map_filter(properties, lambda k, _: k != "id")))
    facts = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None"))))
    return F.concat_ws(" | ", F.nullif(name, F.lit("")), F.nullif(F.array_join(facts, " | "), F.lit("")))


#: Headings of paged documents.
PART, CHAPTER, SECTION = r"^第[一二三四五六七八九十]+部分$", r"^第.{1,3}章(\s*·\s*.*)?$", r"^(\d{1,2}\.\d{1,2})\s*(\S.*)$"


def heading(line: Column) -> Column:
    """Markdown of a line: part ##, chapter ###, a numbered section whose title has over four characters ####."""
    number, title = F.regexp_extract(line, SECTION, 1), F.regexp_extract(line, SECTION, 2)
    return (
        F.when(line.rlike(PART), F.concat(F.lit("\n## "), line, F.lit("\n")))
        .when(line.rlike(CHAPTER), F.concat(F.lit("\n### "), line, F.lit("\n")))
        .when(line.rlike(SECTION) & (F.char_length(title) > 4), F.concat(F.lit("\n#### "), number, F.lit(" "), title, F.lit("\n")))
        .otherwise(line)
    )


def is_page_mark(line: Column, header: str | None = None, footer: str | None = None, pages: int | None = None) -> Column:
    """Page headers and footers by pattern, and lines like 12/153 if the document has 153 pages."""
    out = F.lit(False) if pages is None else line.rlike(rf"^\d{{1,3}}/{pages}$")
    for pattern in filter(None, (header, footer)):
        out = out | line.rlike(pattern)
    return out

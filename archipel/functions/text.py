"""Scalar text functions as Catalyst expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Surfaces that name nobody in particular, and words that don't tell names apart.
PRONOUNS = "i me my mine you your yours he him his she her hers we us our ours they them their theirs".split()
GENERIC = ["a boy", "a car", "a company", "a country", "a girl", "a group", "a guy", "a man", "a person", "a woman", "an official", "another person", "bystander", "bill", "company", "country", "friend of mine", "government", "here", "inside", "official", "other person", "outside", "person", "rule", "rules", "someone", "somebody", "there", "the company", "the country", "the government", "the group", "the official", "the organization", "the person", "your wife"]
ROLES = ["administration", "agency", "analyst", "association", "authorities", "authority", "board", "campaign", "chairman", "chairwoman", "city", "committee", "company", "corporation", "country", "department", "director", "doctor", "executive", "firm", "government", "governor", "group", "hospital", "lawyer", "leader", "manager", "mayor", "minister", "official", "officer", "president", "prime minister", "professor", "program", "reporter", "researcher", "school", "secretary", "senator", "spokesman", "spokesperson", "spokeswoman", "state", "university"]
PERSON_WORDS = ["boy", "friend", "girl", "guy", "husband", "man", "people", "person", "wife", "woman"]
AMBIGUOUS = ["april", "august", "black", "brown", "china", "christian", "france", "georgia", "green", "hope", "jack", "james", "john", "jordan", "june", "king", "lee", "mark", "martin", "mary", "may", "paris", "rose", "smith", "spring", "turkey", "washington", "white"]
BLOCK_STOPWORDS = ["campaign", "case", "event", "foundation", "group", "initiative", "law", "movement", "office", "operation", "organization", "party", "plan", "program", "project", "system", "team", "the"]


def normalize_text(c: Column) -> Column:
    """Line ends to LF, escaped quotes freed, runs of blanks to one, three or more LF to two, ends stripped; null is empty."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n")
    c = F.regexp_replace(c, r"\\(['\"])", "$1")
    c = F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), "\n{3,}", "\n\n")
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(r"\S+")), F.lit(0))


def stable_id(*parts: Column, length: int = 24) -> Column:
    """First hex digits of SHA-256 over the parts joined by ``::``; nulls are left out."""
    return F.substring(F.sha2(F.concat_ws("::", *(p.cast("string") for p in parts)), 256), 1, length)


def uuid5(name: Column) -> Column:
    """Version-5 UUID in the URL namespace, from SHA-1 bytes with version and variant set."""
    digest = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def surface(c: Column) -> Column:
    """Small letters, everything but letters and digits to single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}]+", " "))


def block_key(s: Column) -> Column:
    """Of a surface: one word gives its first four letters; else the first of the longest telling words; else two words."""
    words = F.filter(F.split(s, " "), lambda w: w != "")
    telling = F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(BLOCK_STOPWORDS))
    longest = F.array_max(F.transform(telling, F.length))
    first = F.element_at(F.filter(telling, lambda w: F.length(w) == longest), 1)
    return F.when(F.size(words) == 0, "").when(F.size(words) == 1, F.substring(F.element_at(words, 1), 1, 4)).when(F.size(telling) > 0, first).otherwise(F.array_join(F.slice(words, 1, 2), " "))


def is_acronym(c: Column) -> Column:
    letters = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}]", "")
    return F.length(letters).between(2, 8) & (letters == F.upper(letters))


def is_generic(s: Column, kind: Column) -> Column:
    last = F.element_at(F.split(s, " "), -1)
    person = (kind == "PERSON") & (s.rlike("^(a|an|another|her|his|my|other|our|some|their|your) ") | last.isin(ROLES + PERSON_WORDS))
    organisation = kind.isin("ORGANIZATION", "ORG", "POLITICAL_GROUP") & (s.rlike("^(a|an|another|other|some) ") | last.isin("authorities", "center", "commission", "entities", "judges", "owners", "voters", "workers"))
    event = (kind == "EVENT") & last.isin("demonstration", "discussion", "game", "issue", "meeting")
    return F.coalesce((s == "") | s.isin(PRONOUNS + GENERIC + ROLES) | person | organisation | event, F.lit(True))


def is_ambiguous(s: Column) -> Column:
    return F.coalesce((s == "") | s.isin(AMBIGUOUS) | (~s.contains(" ") & (F.length(s) <= 3)), F.lit(True))


def text_stats(c: Column) -> dict[str, Column]:
    text = F.coalesce(c, F.lit(""))
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), 0)
    alpha = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    alnum = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    solid = F.greatest(F.length(F.regexp_replace(text, r"(?U)\s", "")), F.lit(1))
    return {
        "text_char_count": F.length(text).cast("bigint"),
        "text_token_count": F.size(words).cast("bigint"),
        "unique_token_count": F.size(F.array_distinct(words)).cast("bigint"),
        "alpha_ratio": F.round(alpha / F.greatest(F.length(text), F.lit(1)), 6),
        "punctuation_noise_ratio": F.round(F.greatest(solid - alnum, F.lit(0)) / solid, 6),
    }


def quality(text: Column, tokens: Column, chars: Column, unique: Column, alpha: Column, noise: Column) -> dict[str, Column]:
    metadata = F.coalesce(text, F.lit("")).rlike(r"(?i)^\s*(dataset|modality|title|summary|metadata)\s*:") & (tokens < 120)
    ocr = (alpha < 0.45) | (noise > 0.35) | ((unique < 25) & (tokens >= 80))
    short = (chars < 300) | (tokens < 45) | (unique < 20)
    bucket = F.when(tokens <= 80, "short").when(tokens <= 180, "medium").when(tokens <= 400, "long").otherwise("very_long")
    return {"length_bucket": bucket, "is_metadata_only_like": metadata, "query_candidate_quality": F.when(metadata, "metadata_only").when(ocr, "ocr_noise").when(short, "too_short").otherwise("usable")}


def query_form(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def query_id(chunk: Column, query: Column) -> Column:
    return F.concat(F.lit("q_"), F.substring(F.sha1(F.concat_ws("|", chunk, query_form(query))), 1, 16))


# Words that open a question and name nothing.
QUERY_STOPWORDS = "A An And Are Did Do Does How In Of On Or The To What When Where Which Who Why".split()


def compact(terms: Column, limit: int) -> Column:
    """The first ``limit`` of an array's terms, blanks squeezed, each once whatever its case, in order."""
    tidy = F.filter(F.transform(terms, lambda x: F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))), lambda x: x != "")
    low = F.transform(tidy, lambda x: F.lower(x))
    once = F.filter(F.transform(tidy, lambda x, i: F.when(F.array_position(low, F.lower(x)) == i + 1, x)), lambda x: x.isNotNull())
    return F.slice(once, 1, limit)


def surface_terms(c: Column, limit: int = 8) -> Column:
    """Quoted strings, runs of capitalised words and acronyms, in this order, each once whatever its case."""
    quoted = F.transform(F.regexp_extract_all(c, F.lit("\"([^\"]+)\"|'([^']+)'"), 0), lambda x: F.substr(x, F.lit(2), F.length(x) - 2))
    runs = F.regexp_extract_all(c, F.lit(r"\b[A-Z][A-Za-z0-9&.-]*(?:\s+[A-Z][A-Za-z0-9&.-]*)*"), 0)
    found = F.concat(quoted, runs, F.regexp_extract_all(c, F.lit(r"\b[A-Z]{2,}\b"), 0))
    return compact(F.filter(found, lambda x: ~F.trim(x).isin(QUERY_STOPWORDS)), limit)


def embedding_text(dataset: Column, modality: Column, title: Column, summary: Column, content: Column, metadata: Column | None = None) -> Column:
    """What is embedded: masked content below lines of context. Dataset, modality and content always have their line;
    title, summary and metadata only where there is something to say. Metadata is a map; its null values and the raw and
    masked texts are left out, and its JSON has Spark's spacing."""
    line = lambda label, c: F.when(c.isNotNull() & (F.trim(c) != ""), F.concat(F.lit(label + ": "), c))
    always = lambda label, c: F.concat(F.lit(label + ": "), F.coalesce(c, F.lit("")))
    lines = [always("Dataset", dataset), always("Modality", modality), line("Title", title), line("Summary", summary)]
    if metadata is not None:
        kept = F.map_filter(metadata, lambda k, v: v.isNotNull() & ~k.isin("raw_text", "masked_text"))
        lines.append(F.when(F.size(kept) > 0, F.concat(F.lit("Metadata: "), F.to_json(kept))))
    return F.concat_ws("\n", *lines, always("Content", content))


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def ratio(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def token_lists(batches: Iterator[pa.Array], most: int = 1 << 16) -> Iterator[pa.Array]:
    """The words of every text with their offsets, in as many arrays as it takes to hold about ``most`` words in each: a
    batch of long texts, as Python objects, is many times its size."""
    kind = pa.list_(pa.struct([("token", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def packed() -> pa.Array:
        words = pa.StructArray.from_arrays([pa.array(tokens, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], fields=list(kind.value_type))
        return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), words, type=kind)

    for texts in batches:
        tokens, starts, ends, counts = [], [], [], [0]
        for text in texts:
            for m in re.finditer(r"\S+", text.as_py() or ""):
                tokens.append(m[0])
                starts.append(m.start())
                ends.append(m.end())
            counts.append(len(tokens))
            if len(tokens) >= most:
                yield packed()
                tokens, starts, ends, counts = [], [], [], [0]
        if len(counts) > 1:
            yield packed()


def token_offsets(c: Column) -> Column:
    """Words with their half-open offsets. Positions of matches are no built-in, so this is an Arrow function."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return token_lists(batches)

    return F.arrow_udf(run, "array<struct<token:string,start:int,end:int>>")(c)


def token_span(offsets: Column, start: Column, end: Column) -> Column:
    """Inclusive (first, last) indices of the tokens that a half-open character span touches, null if none. ``offsets``:
    array of structs with start and end."""
    hit = F.transform(offsets, lambda o, i: F.when((o["end"] > start) & (o["start"] < end), i))
    first, last = F.array_min(hit), F.array_max(hit)  # both skip nulls
    return F.when(first.isNotNull(), F.struct(first.alias("first"), last.alias("last")))


def token_span_sorted(offsets: Column, start: Column, end: Column) -> Column:
    """The same over sorted offsets, by counting the tokens that end before the span and those that begin before its end:
    an empty span has none, and one between two tokens has none either."""
    first = F.size(F.filter(offsets, lambda o: o["end"] <= start))
    last = F.size(F.filter(offsets, lambda o: o["start"] < end)) - 1
    ok = (end > start) & (first <= last) & (last < F.size(offsets))
    return F.when(ok, F.struct(first.alias("first"), last.alias("last")))


def token_gap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Tokens between two inclusive token spans, 0 where they touch or overlap."""
    return F.when(e1 < s2, s2 - e1 - 1).when(e2 < s1, s1 - e2 - 1).otherwise(F.lit(0))


# Other names of mention labels, and what a masking label is called in words.
LABEL_ALIASES = {"PRODUCT_OR_BRAND": "PRODUCT", "CREATIVE_WORK_TITLE": "CREATIVE_WORK", "LAW_OR_REGULATION": "LAW", "RELIGIOUS_GROUP": "RELIGION", "PROGRAM_OR_INITIATIVE": "PROGRAM_INITIATIVE"}
SEMANTIC_LABELS = {"PERSON": "person", "ORG": "organization", "LOC": "location", "DATETIME": "date/time", "CODE": "code", "DEM": "demographic", "QUANTITY": "quantity", "MISC": "miscellaneous"}


def lookup(values: dict[str, str], key: Column, otherwise: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(table[key], otherwise)


def entity_type_form(c: Column) -> Column:
    """Upper case, blanks, hyphens and slashes as underscores; null is empty."""
    return F.translate(F.upper(F.trim(F.coalesce(c, F.lit("")))), " -/", "___")


def mention_label(c: Column) -> Column:
    """A model's label as the archive writes it: ``Law or regulation`` is LAW."""
    form = F.replace(entity_type_form(c), F.lit(","), F.lit(""))
    return lookup(LABEL_ALIASES, form, form)


def semantic_label(kind: Column) -> Column:
    form = entity_type_form(kind)
    return lookup(SEMANTIC_LABELS, form, F.translate(F.lower(form), "_", " "))


def policy_label(kind: Column, identifier: Column, compact: bool = False) -> Column:
    """Identifier class and entity type together: ``DIRECT_PERSON`` or, in words, ``direct person``."""
    identifier = F.upper(F.trim(F.coalesce(identifier, F.lit(""))))
    if compact:
        return F.trim(F.concat_ws("_", identifier, entity_type_form(kind)), F.lit("_"))
    return F.trim(F.concat_ws(" ", F.translate(F.lower(identifier), "_", " "), semantic_label(kind)))


def policy_words(label: Column) -> Column:
    return F.translate(F.lower(F.trim(F.coalesce(label, F.lit("")))), "_", " ")


def policy_is_sensitive(label: Column) -> Column:
    return policy_words(label).rlike("^(direct|quasi) ")


def policy_type(label: Column) -> Column:
    """The label without its policy prefix."""
    return F.trim(F.regexp_replace(policy_words(label), "^(direct|quasi|no mask) ", ""))


def is_sensitive_identifier(identifier: Column) -> Column:
    return F.coalesce(F.upper(F.trim(identifier)).isin("DIRECT", "QUASI"), F.lit(False))


def gold_slug(c: Column) -> Column:
    slug = F.trim(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]+", "_"), F.lit("_"))
    return F.when(slug == "", "UNSPECIFIED").otherwise(slug)


def model_slug(c: Column) -> Column:
    """A model name that can be a file name."""
    slug = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "[^a-zA-Z0-9._-]+", "__"), F.lit("._-"))
    return F.when(slug == "", "judge").otherwise(slug)


def masking_id(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts))), 1, 16)


def page_key(document: Column, page: Column, other: Column, *fallback: Column) -> Column:
    """Key of a scanned page: document and page number, else another id, else one made of ``fallback``."""
    d, n, o = (normalize_text(c.cast("string")) for c in (document, page, other))
    return F.when((d != "") & (n != ""), F.concat(d, F.lit("::page-"), n)).when(o != "", F.concat(F.lit("doc-"), o)).otherwise(stable_id(*fallback))


def as_bool(c: Column) -> Column:
    """true/1/yes/y/t in any case, everything else but null is false."""
    return F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes", "y", "t")


def as_int(c: Column) -> Column:
    """An integer, also where it is written as 3.0; else null."""
    return c.cast("string").try_cast("double").try_cast("bigint")


def as_list(c: Column) -> Column:
    """A JSON array of strings as an array; a blank or null cell is an empty one, any other text one element."""
    text = F.trim(F.coalesce(c, F.lit("")))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.coalesce(F.when(text.startswith("["), F.from_json(text, "array<string>")), F.array(text)))


def first_present(columns: list[str], *names: str) -> Column:
    """The first of several possible columns that the table has and that is not null."""
    have = [F.col(n) for n in names if n in columns]
    return F.coalesce(*have) if have else F.lit(None)


def unmasked(c: Column) -> Column:
    """The place where masking will stand: the text as it is."""
    return c


def whole_json(c: Column) -> Column:
    """A JSON object: the whole text, else what lies between its first and last brace; null if neither parses. Spark's
    parser stops at the end of the first value, so further text after an object does not make it null."""
    parsed = F.coalesce(F.try_parse_json(c), F.try_parse_json(F.regexp_extract(c, r"(?s)\{.*\}", 0)))
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)


def first_json(c: Column) -> Column:
    """The first JSON object in free text as its own JSON string, null if none parses: decoding starts at one brace after
    the other, and what follows the object does not matter. No built-in decodes a prefix, so this is an Arrow function."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import json

        decoder = json.JSONDecoder()

        def first(text: str | None) -> str | None:
            at = text.find("{") if text else -1
            while at >= 0:
                try:
                    return json.dumps(decoder.raw_decode(text, at)[0], ensure_ascii=False)
                except ValueError:
                    at = text.find("{", at + 1)
            return None

        for texts in batches:
            yield texts.map(first)

    return F.pandas_udf(run, "string")(c)

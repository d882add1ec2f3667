"""Records of the archive's sources as documents: transcripts, articles, timed captions, scanned pages, benchmark records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archipel.functions.text import is_sensitive_identifier, normalize_text, policy_label, semantic_label, stable_id, token_offsets, token_span
from archipel.operators.spans import repaired

CONFIDENCE = 35.0  # least confidence of a recognised word


def document(dataset: str, modality: str, source: Column, title: Column, text: Column, summary: Column) -> list[Column]:
    """Columns of a document; a source without an id gets one made of its text and summary."""
    own = F.trim(F.coalesce(source.cast("string"), F.lit("")))
    sid = F.when(own != "", own).otherwise(stable_id(F.lit(dataset), F.substring(text, 1, 500), F.substring(summary, 1, 200)))
    return [stable_id(F.lit(dataset), sid).alias("document_id"), sid.alias("source_id"), F.lit(dataset).alias("dataset"), F.lit(modality).alias("modality"), F.coalesce(F.nullif(title, F.lit("")), F.concat(F.lit(f"{dataset} "), sid)).alias("title"), text.alias("raw_text"), summary.alias("summary")]


def transcript_text(whole: Column, speakers: Column, utterances: Column) -> Column:
    """A transcript: as one text where there is one, else a line per utterance with its speaker; blank utterances are left
    out, an utterance without a speaker stands alone."""
    said = F.transform(utterances, lambda u, i: F.struct(normalize_text(F.try_element_at(speakers, i + 1)).alias("who"), normalize_text(u).alias("what")))
    lines = F.transform(F.filter(said, lambda x: x["what"] != ""), lambda x: F.when(x["who"] != "", F.concat(x["who"], F.lit(": "), x["what"])).otherwise(x["what"]))
    return F.when(normalize_text(whole) != "", normalize_text(whole)).otherwise(normalize_text(F.array_join(F.coalesce(lines, F.array()), "\n")))


def transcripts(records: DataFrame, dataset: str = "mediasum") -> DataFrame:
    """Documents of transcript records (id, title, summary, document, speaker array, utt array)."""
    text = transcript_text(F.col("document"), F.col("speaker"), F.col("utt"))
    rows = records.select("id", normalize_text(F.col("title")).alias("t"), normalize_text(F.col("summary")).alias("s"), text.alias("x"))
    return rows.select(*document(dataset, "transcript", F.col("id"), F.col("t"), F.col("x"), F.col("s")))


def articles(records: DataFrame, dataset: str = "cnn_dailymail") -> DataFrame:
    """Documents of article records (id, article, highlights)."""
    rows = records.select("id", normalize_text(F.col("article")).alias("x"), normalize_text(F.col("highlights")).alias("s"))
    return rows.select(*document(dataset, "article", F.col("id"), F.lit(None).cast("string"), F.col("x"), F.col("s")))


def seconds(c: Column) -> Column:
    """A time as text projections have it: ``12.50s``, or ``unknown``."""
    x = c.cast("string").try_cast("double")
    return F.when(x.isNull(), "unknown").otherwise(F.concat(F.format_string("%.2f", x), F.lit("s")))


def videos(captions: DataFrame, dataset: str = "msr_vtt") -> DataFrame:
    """One document per video of timed captions (video_id, sen_id, caption, start_time, end_time): a line per caption in the
    order of time (missing times last), numbered over all captions, blank ones left out; the first five make the summary.
    A video's captions are those of one text."""
    late = lambda c: F.coalesce(F.col(c), F.lit(float("inf")))
    row = F.struct(late("start_time").alias("a"), late("end_time").alias("b"), "sen_id", normalize_text(F.col("caption")).alias("c"), "start_time", "end_time")
    g = captions.where("video_id is not null").groupBy("video_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    lines = F.transform("rows", lambda x, i: F.when(x["c"] != "", F.concat(F.lit("Segment "), i.cast("string"), F.lit(" ["), seconds(x["start_time"]), F.lit("-"), seconds(x["end_time"]), F.lit("]: "), x["c"])))
    text = normalize_text(F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n"))
    summary = normalize_text(F.array_join(F.filter(F.transform(F.slice("rows", 1, 5), lambda x: x["c"]), lambda c: c != ""), " "))
    return g.select("video_id", text.alias("x"), summary.alias("s")).select(*document(dataset, "video", F.col("video_id"), F.lit(None).cast("string"), F.col("x"), F.col("s")))


def ocr_lines(words: DataFrame, page: str = "page_key", least: float = CONFIDENCE) -> DataFrame:
    """(page, line, text, left, top, right, bottom, projected) of recognised words (page, text, conf, block, par, line_no,
    left, top, width, height): words under the least confidence are dropped (an unknown one, below zero, stays), lines
    are numbered by block, paragraph and line, words stand by their left edge, and boxes are joined."""
    sure = F.coalesce(F.col("conf").cast("double"), F.lit(-1.0))
    w = words.withColumn("t", normalize_text(F.col("text"))).where((F.col("t") != "") & ((sure < 0) | (sure >= least)))
    lines = w.groupBy(page, "block", "par", "line_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "top", "t"))), lambda x: x["t"]), " ").alias("text"),
        F.min("left").alias("x0"), F.min("top").alias("y0"), F.max(F.col("left") + F.col("width")).alias("x1"), F.max(F.col("top") + F.col("height")).alias("y1"),
    )
    n = F.row_number().over(Window.partitionBy(page).orderBy("block", "par", "line_no")) - 1
    out = lines.withColumn("line", n)
    box = F.concat_ws(",", *(F.col(c).cast("string") for c in ("x0", "y0", "x1", "y1")))
    return out.select(page, "line", "text", F.col("x0").alias("left"), F.col("y0").alias("top"), F.col("x1").alias("right"), F.col("y1").alias("bottom"), F.concat(F.lit("OCR Line "), F.col("line").cast("string"), F.lit(" ["), box, F.lit("]: "), F.col("text")).alias("projected"))


def pages(lines: DataFrame, page: str = "page_key", dataset: str = "docvqa") -> DataFrame:
    """One document per scanned page, of its lines."""
    g = lines.groupBy(page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "projected"))), lambda x: x["projected"]), "\n").alias("x"))
    return g.select(*document(dataset, "ocr_document", F.col(page), F.lit(None).cast("string"), normalize_text(F.col("x")), F.lit("")))


def benchmark_records(records: DataFrame) -> DataFrame:
    """Anonymisation records (chunk_id, raw_text, split, mentions array) with repaired offsets and the counts that say
    whether they are fit for evaluation. Blank texts are dropped; of a repeated chunk_id the first by split and text."""
    text = F.trim(F.coalesce("raw_text", F.lit("")))
    rows = records.where((text != "") & F.col("chunk_id").isNotNull())
    first = F.min_by(F.struct("raw_text", "split", "mentions"), F.struct("split", "raw_text"))
    rows = rows.groupBy("chunk_id").agg(first.alias("r")).select("chunk_id", "r.*")

    def fixed(m):
        at = repaired(F.col("raw_text"), m["text"], m["start"], m["end"])
        return F.struct(m["entity_type"].alias("entity_type"), m["identifier_type"].alias("identifier_type"), m["text"].alias("text"), F.coalesce(at, m["start"]).alias("start"), F.when(at.isNotNull(), at + F.length(m["text"])).otherwise(m["end"]).alias("end"), at.isNotNull().alias("offset_matches"))

    rows = rows.withColumn("mentions", F.transform(F.coalesce("mentions", F.array()), fixed))
    count = lambda f: F.size(F.filter("mentions", f))
    rows = rows.withColumns({"gold_spans": F.size("mentions"), "sensitive_spans": count(lambda m: is_sensitive_identifier(m["identifier_type"])), "unmasked_spans": count(lambda m: F.coalesce(F.upper(F.trim(m["identifier_type"])) == "NO_MASK", F.lit(False))), "mismatches": count(lambda m: ~m["offset_matches"])})
    return rows.withColumns({"has_sensitive": F.col("sensitive_spans") > 0, "usable": (F.col("gold_spans") > 0) & (F.col("sensitive_spans") > 0) & (F.col("mismatches") == 0)})


def training_records(records: DataFrame, policy: bool = False) -> DataFrame:
    """(chunk_id, tokens, ner) of benchmark records: whitespace tokens and inclusive token spans with a label in words, each
    once; mentions whose offsets do not fit are left out, and so are records without any."""
    rows = records.withColumn("offsets", token_offsets(F.col("raw_text")))
    label = lambda m: policy_label(m["entity_type"], m["identifier_type"]) if policy else semantic_label(m["entity_type"])

    def one(m):
        t = token_span(F.col("offsets"), m["start"], m["end"])
        return F.when(m["offset_matches"] & t.isNotNull(), F.struct(t["first"].alias("first"), t["last"].alias("last"), label(m).alias("label")))

    ner = F.array_distinct(F.filter(F.transform("mentions", one), lambda x: x.isNotNull()))
    return rows.select("chunk_id", F.transform("offsets", lambda o: o["token"]).alias("tokens"), ner.alias("ner")).where(F.size("ner") > 0)


def label_summary(records: DataFrame) -> DataFrame:
    """(kind, label, mentions): how often each entity type, identifier type and pair of both occurs."""
    m = records.select(F.explode("mentions").alias("m")).select("m.*")
    kinds = F.array(F.struct(F.lit("entity_type").alias("kind"), F.col("entity_type").alias("label")), F.struct(F.lit("identifier_type").alias("kind"), F.col("identifier_type").alias("label")), F.struct(F.lit("policy").alias("kind"), policy_label(F.col("entity_type"), F.col("identifier_type"), True).alias("label")))
    return m.select(F.explode(kinds).alias("k")).groupBy("k.kind", "k.label").agg(F.count("*").alias("mentions"))

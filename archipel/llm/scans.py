"""Problem 4: noise in text from scanned pages.

Words are counted over all chunks; those that make up at least one word in a million are the vocabulary (so it has at
most a million words, whatever the corpus), without those that are misreadings themselves: however often a word occurs,
it is one if it is hardly found outside scans and confusions explain it by a far more frequent word. Every other word of
a scan is a suspect. Its Levenshtein automaton, built
state by state as it is used, is intersected with the vocabulary's trie, a depth-first walk over ranges of the sorted
word list, which gives all vocabulary words within two edits. Those that a scanner's confusions explain, and that are
far more frequent than the suspect, are its readings; several readings are ranked by how often each follows the word
before it.

Running headers and footers are found by their look, their repetition over a document's pages and their place beside
page numbers; hyphens at line ends by what joining them makes of the word. The repaired text drops page furniture,
joins broken words, puts in the readings and runs lines on into paragraphs.
"""

from __future__ import annotations

import re
import unicodedata as ud
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archipel.llm.automata import Trie
from archipel.llm.words import token_counts
from archipel.session import checkpoint, slots, spread

SHARE, RATIO, EDITS = 1e-6, 20, 2

# What a scanner reads for what was printed.
CONFUSIONS = """
0 o
0 d
1 l
1 i
! l
! i
| l
| i
l i
i l
5 s
$ s
8 b
6 b
6 g
9 g
9 q
9 o
9 l
2 z
@ a
4 a
3 e
7 t
c e
e c
f t
t f
v y
y v
u v
v u
n h
h b
h n
n u
u n
o c
c o
b h
a o
o a
í i
ì i
î i
ï i
rn m
m rn
nn m
cl d
d cl
vv w
w vv
li h
h li
ii u
u ii
lj y
tl d
nl m
ri n
n ri
fi h
lc k
ni m
in m
m in
"""
PAIRS = {tuple(line.split()) for line in CONFUSIONS.strip().splitlines()}

MARK = re.compile(r"[ \t]*OCR Line \d+ \[[^\]\n]*\]: ?")
PAGE = re.compile(r"^\W*(?:(?:page|pg|p|seite|folio|sheet)\W{0,3})?(?:\d{1,5}|[ivxlcdm]{1,7})(?:\s*(?:/|of|von|de)\s*\d{1,5})?\W*$", re.I)
BARE_ROMAN = re.compile(r"^[ivxlcdm]+$", re.I)
ROMAN = re.compile(r"^m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$", re.I)
SECTION = re.compile(r"^\W*(?:s[e3c][ec]t[il1!|í][o0]n|section|chapter|part|appendix|article|annex|schedule|table|figure|exhibit|§)\b", re.I)
NUMBERED = re.compile(r"^\W*(?:\d{1,2}|[IVX]{1,5}|[A-Z])[.)]\s+\S")
STOP_END = re.compile(r"[.!?:;,](?:[\"'’”)\]]*)$")
TOKEN = re.compile(r"\S+")
TITLE_WORD = re.compile(r"[\w@!|]+")
EDGE_L, EDGE_R = re.compile(r"^[\"'“”‘’«»(\[{<*_~.,;:?-]+"), re.compile(r"[\"'“”‘’«»)\]}>*_~.,;:?-]+$")
PLAIN = re.compile(r"^[^\W\d_]+(?:['’-][^\W\d_]+)*(?:['’]s?)?$")
NOT_WORD = re.compile(r"@.*[.(]|^https?:|www\.|\d{2}|^#|[/\\=+]|\(at\)|_")
RECORD = re.compile(r"@|\(at\)|\d{3}[-. )/]+\d{3}|\d{6}|;|\b(?:tel|phone|fax|name|contact|apt|unit|ssn|e-?mail|extension)\b[.:]?|^\W*(?:return to|applicant|form|lot|batch|order|invoice|catalog|item|docket|tracking|ref|rev|home)\b", re.I)
SMALL = {"of", "the", "and", "for", "in", "on", "at", "to", "by", "vol", "no", "de", "des", "du", "der", "und", "from"}


def skeleton(line: str) -> str:
    """A line without what differs between its copies on other pages: numbers, case, spacing, misread characters."""
    flat = ud.normalize("NFKD", line.lower())
    flat = "".join(ch for ch in flat if not ud.combining(ch))
    flat = flat.replace("rn", "m").replace("cl", "d").replace("vv", "w").replace("li", "h").replace("ii", "u")
    flat = re.sub(r"\b\d+\b", " ", flat)
    flat = flat.translate(str.maketrans("0159@!|$368cyf", "olsgalls" + "ebb" + "evt"))
    return re.sub(r"[^a-z]+", "", flat)


def lines_of(text: str) -> list[tuple[int, str]]:
    """(offset after the line mark, text of the line)."""
    out, at, marked = [], 0, "OCR Line" in text
    for raw in text.split("\n"):
        m = MARK.match(raw) if marked else None
        skip = m.end() if m else 0
        out.append((at + skip, raw[skip:]))
        at += len(raw) + 1
    return out


def page_number(line: str) -> bool:
    s = line.strip()
    if len(s) > 30 or not PAGE.match(s):
        return False
    letters = re.sub(r"[^a-z]", "", re.sub(r"(?i)page|pg|seite|folio|sheet|\bof\b|\bvon\b|\bde\b|\bp\b", "", s).lower())
    return not letters or bool(ROMAN.match(letters))


def title_like(line: str) -> bool:
    """Short, unpunctuated, capitalised throughout, no section title."""
    s = line.strip()
    if not 4 <= len(s) <= 90 or s[-1] in ".!?;:-":
        return False
    big = 0
    for m in TITLE_WORD.finditer(s):
        w = m[0]
        if len(w) > 2 and w.lower() not in SMALL and re.search(r"[^\W\d_]", w):
            if w[0].islower() and w.upper() != w:
                return False
            big += 1
    return big >= 2 and not SECTION.match(s) and not NUMBERED.match(s)


def shape(text: str) -> list[dict]:
    """The lines with what can be told from this chunk alone."""
    rows = [{"at": a, "text": t, "page": page_number(t), "title": title_like(t), "skeleton": ""} for a, t in lines_of(text)]
    widths = sorted(len(r["text"].rstrip()) for r in rows if r["text"].strip() and not r["page"] and not r["title"])
    width = widths[int(0.8 * (len(widths) - 1))] if widths else 0
    ends: list[str] = []  # the end of text before each line, and its start after it
    last = ""
    for r in rows:
        ends.append(last)
        if not r["page"] and not r["title"] and r["text"].strip():
            last = r["text"].strip()[-1]
    starts, nxt = [""] * len(rows), ""
    for i in range(len(rows) - 1, -1, -1):
        starts[i] = nxt
        r = rows[i]
        if not r["page"] and not r["title"] and r["text"].strip():
            nxt = r["text"].strip()[0]
    for i, r in enumerate(rows):
        s = r["text"].strip()
        r["short"] = bool(s) and (len(s) < 0.85 * max(width, 20) or len(s) <= 60 and r["title"])
        r["loose"] = (r["short"] or r["title"]) and not r["page"] and (s[0].isupper() or s[0].isdigit()) and not s.endswith("-") and not STOP_END.search(s[-4:]) and not SECTION.match(s) and not NUMBERED.match(s)
        r["breaks"] = ends[i] != "" and ends[i] not in ".!?:" or starts[i].islower()
        if r["loose"]:
            r["alone"] = (i == 0 or not rows[i - 1]["text"].strip()) and (i + 1 == len(rows) or not rows[i + 1]["text"].strip())
            # a candidate for repetition over pages; its skeleton is counted over the document
            if len(s) <= 90 and len(re.findall(r"[^\W\d_]", s)) >= 4:
                r["skeleton"] = skeleton(s)
    return rows


def title_words(line: str) -> list[str]:
    return [w for w in re.findall(r"[^\W\d_]{3,}", line.lower()) if w not in SMALL]


def candidates(text: str) -> list[tuple[str, str, list[str]]]:
    """(skeleton, neighbouring lines, words) of the lines that may repeat over pages."""
    rows = shape(text)
    return [(r["skeleton"], (rows[i - 1]["text"] if i else "") + "|" + (rows[i + 1]["text"] if i + 1 < len(rows) else ""), title_words(r["text"]) if r["title"] or len(r["text"].split()) <= 6 else []) for i, r in enumerate(rows) if r["skeleton"] and not RECORD.search(r["text"])]


def furniture(rows: list[dict], counts: dict[str, int], titles: set[str]) -> list[str | None]:
    """``header``, ``page_number`` or nothing for every line. ``counts``: places of a skeleton in the same document;
    ``titles``: words of the lines that repeat over the pages of some document."""
    kind: list[str | None] = ["page_number" if r["page"] else None for r in rows]
    for i, r in enumerate(rows):
        if kind[i] or not r["skeleton"] or RECORD.search(r["text"]):
            continue
        n = counts.get(r["skeleton"], 0)
        numbered = bool(re.search(r"(?:^\s*\d{1,4}\s{2,}\S|\S\s{2,}\d{1,4}\s*$)", r["text"]))
        beside = any(0 <= j < len(rows) and (rows[j]["page"] or rows[j]["title"] and rows[j]["loose"]) for j in (i - 1, i + 1))
        words = title_words(r["text"])
        usual = sum(w in titles for w in words) >= 0.6 * max(1, len(words))
        if r["title"] and (n >= 2 or usual and (numbered or beside or r["breaks"] or not r["alone"])) or n >= 3 and r["short"] or n >= 2 and r["short"] and beside:
            kind[i] = "header"
    for step in (1, -1):  # a short loose line beside a header or page number is furniture too
        for i in range(len(rows)) if step == 1 else range(len(rows) - 1, -1, -1):
            j = i - step
            r = rows[i]
            words = [w for w in re.findall(r"[^\W\d_]+", r["text"]) if len(w) > 2]
            big = sum(w[0].isupper() for w in words) >= 0.5 * max(1, len(words))
            if kind[i] is None and r["skeleton"] and r["short"] and 0 <= j < len(rows) and kind[j] and len(words) <= 7 and not RECORD.search(r["text"]) and big and sum(w.lower() in titles for w in words) >= 0.5 * max(1, len(words)):
                kind[i] = "header"
    return kind


def bare(token: str) -> tuple[str, int]:
    """The word in a token and its offset there."""
    m = EDGE_L.match(token)
    skip = m.end() if m else 0
    core = EDGE_R.sub("", token[skip:])
    return core, skip


def normal(word: str) -> str:
    w = word.lower().replace("’", "'")
    return w[:-2] if w.endswith("'s") else w.rstrip("'")


class Lexer:
    """Looks a token up once: its word, the word's offset in it, the word's normal form."""

    MEMO = 200_000

    def __init__(self) -> None:
        self.memo: dict[str, tuple[str, int, str]] = {}

    def __call__(self, token: str) -> tuple[str, int, str]:
        known = self.memo.get(token)
        if known is None:
            if len(self.memo) >= self.MEMO:
                self.memo.clear()
            core, skip = bare(token)
            known = self.memo[token] = (core, skip, normal(core))
        return known


def running(rows: list[dict], kind: list[str | None]) -> list[list]:
    """Words of the running text in order: [offset, token, offset of the hyphen where a line end broke it, offset and
    text of what follows that line end]."""
    words: list[list] = []
    joint = None
    for r, k in zip(rows, kind):
        text = r["text"]
        if k or not text or text.isspace():
            if not k:
                joint = None
            continue
        base, n = r["at"], 0
        for m in TOKEN.finditer(text):
            t = m[0]
            n += 1
            if joint is not None:
                if re.match(r"[^\W_]", t):
                    joint[3], joint[4] = base + m.start(), t
                    last, joint = joint, None
                    continue
                joint = None
            last = [base + m.start(), t, None, 0, ""]
            words.append(last)
        if n and t[-1] in "-‐­" and last[1] is t and len(t) > 1 and (n > 1 or len(t) > 3) and t[-2].isalnum():
            last[2] = last[0] + len(t) - 1
            joint = last
    return words


def spelled(word: list, lexer: Lexer) -> tuple[str, str, int]:
    """(the word joined, the word with its hyphen, offset of its first letter)."""
    at, first, hyphen, _, rest = word
    if hyphen is not None and rest:
        joined, skip, _ = lexer(first[:-1] + rest)
        return joined, lexer(first + rest)[0], at + skip
    core, skip, _ = lexer(first)
    return core, core, at + skip


def confusion_steps(read: str, printed: str, most: int = 2) -> int | None:
    """Least number of confusions that turn ``printed`` into ``read``, if at most ``most``."""
    best: dict[tuple[int, int], int] = {(0, 0): 0}
    for i in range(len(read) + 1):
        for j in range(len(printed) + 1):
            d = best.get((i, j))
            if d is None or d > most:
                continue
            if i < len(read) and j < len(printed) and read[i] == printed[j]:
                best[i + 1, j + 1] = min(best.get((i + 1, j + 1), 9), d)
            for a in (1, 2):
                for b in (1, 2):
                    if i + a <= len(read) and j + b <= len(printed) and (read[i : i + a], printed[j : j + b]) in PAIRS:
                        best[i + a, j + b] = min(best.get((i + a, j + b), 9), d + 1)
    got = best.get((len(read), len(printed)))
    return got if got is not None and got <= most else None


def suspect_form(w: str) -> bool:
    """A word, or a word with signs a scanner puts for letters; no number, code, address or mark."""
    letters = sum(ch.isalpha() for ch in w)
    return letters >= 3 and letters >= 0.5 * len(w) and not NOT_WORD.search(w) and len(w) <= 40


def odd_signs(w: str) -> bool:
    return bool(re.search(r"[^\W\d_][0-9@!|$][^\W\d_]|^[0-9@!|$][^\W\d_]{3}|[^\W\d_]{3}[0-9@|$]$", w))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n, small) over all texts: plain words, edges trimmed, and how often they are written in small letters."""
    tokens = token_counts(texts).withColumnRenamed("token", "t")
    word = F.regexp_replace(F.regexp_replace(F.lower("t"), r"^[\"'“”‘’«»(\[{<*_~.,;:?-]+|[\"'“”‘’«»)\]}>*_~.,;:?-]+$", ""), "’", "'")
    small = F.when(F.col("t") == F.lower("t"), F.col("n")).otherwise(0).alias("small")
    return tokens.select(F.regexp_replace(word, "'s$", "").alias("word"), "n", small).where("length(word) between 3 and 40").groupBy("word").agg(F.sum("n").alias("n"), F.sum("small").alias("small"))


def readings(suspects: DataFrame, vocabulary: list[str], counts: list[int]) -> DataFrame:
    """(word, reading, steps, weight) of every suspect (word, n); the word itself stands where no reading is known."""
    spark = suspects.sparkSession
    shared = spark.sparkContext.broadcast((vocabulary, counts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, numbers = shared.value
        trie = Trie(words)
        for batch in batches:
            out = []
            for word, n in zip(batch["word"], batch["n"]):
                found = []
                for v in trie.near(word, EDITS):
                    m = numbers[bisect_left(words, v)]
                    steps = confusion_steps(word, v) if v != word and (m >= RATIO * n or odd_signs(word)) else None
                    if steps and (steps == 1 or len(word) >= 6):
                        found.append((word, v, steps, m))
                least = min((f[2] for f in found), default=0)
                out += [f for f in found if f[2] == least]
            yield pd.DataFrame(out, columns=["word", "reading", "steps", "weight"])

    return suspects.mapInPandas(run, "word string, reading string, steps int, weight bigint")


def is_scan() -> F.Column:
    return F.coalesce(F.regexp_replace(F.lower(F.col("dataset")), r"[^a-z]", "") == "docvqa", F.lit(False))


def misreadings(counts: DataFrame, vocabulary: list[str], numbers: list[int], least: float) -> set[str]:
    """Vocabulary words (at most as many as it has) that are misreadings: ``RATIO`` times rarer outside scans than in
    them, and with a reading in the vocabulary. Only shares are compared, so the size of the corpus does not matter."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("inside"), F.lit(0)).alias("inside")).head()
    own, other = F.col("inside") / max(total["inside"], 1), (F.col("n") - F.col("inside")) / max(total["n"] - total["inside"], 1)
    doubtful = counts.where((F.col("n") >= least) & (F.col("inside") > 0) & (own >= RATIO * other)).where(~F.col("word").rlike(r"[\d_@!|$]")).select("word", "n")
    found = readings(doubtful.repartition(slots(counts.sparkSession) * 4), vocabulary, numbers)
    return {r["word"] for r in found.select("word").distinct().collect()}


def scanned(chunks: DataFrame) -> DataFrame:
    """Pages of the scan dataset, whatever their modality says; a chunk_id once, with its first text."""
    rows = chunks.where("chunk_id is not null and raw_text is not null").where(is_scan())
    return rows.groupBy("chunk_id").agg(F.min(F.struct("document_id", "raw_text")).alias("x")).select("chunk_id", "x.*")


def prepare(chunks: DataFrame) -> tuple:
    """Scans with the counts of their candidate header lines, and for every suspect word in them its readings by the
    word before it: (prev, word, reading)."""
    spark = chunks.sparkSession
    scans = checkpoint(scanned(chunks))
    texts = chunks.where("raw_text is not null")  # all rows as they stand
    counted = word_counts(texts.where(is_scan())).withColumn("inside", F.col("n")).union(word_counts(texts.where(~is_scan())).withColumn("inside", F.lit(0)))
    counts = checkpoint(counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("small").alias("small"), F.sum("inside").alias("inside")))
    total = counts.agg(F.sum("n")).head()[0] or 0
    least = max(float(RATIO), SHARE * total)
    frequent = counts.where(F.col("n") >= least).orderBy("word").collect()  # at most 1 / SHARE words
    ordered = sorted((r["word"], r["n"]) for r in frequent if PLAIN.match(r["word"]))
    wrong = misreadings(counts, [w for w, _ in ordered], [n for _, n in ordered], least)
    ordered = [x for x in ordered if x[0] not in wrong]
    vocabulary, numbers = [w for w, _ in ordered], [n for _, n in ordered]
    proper = {r["word"] for r in frequent if r["small"] < 0.4 * r["n"]}

    def title_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(c, d or c, *x) for c, d, t in zip(batch["chunk_id"], batch["document_id"], batch["raw_text"]) for x in candidates(t)]
            yield pd.DataFrame(out, columns=["chunk_id", "document", "skeleton", "beside", "words"])

    lines = checkpoint(spread(scans, "chunk_id").mapInPandas(title_lines, "chunk_id string, document string, skeleton string, beside string, words array<string>"))
    # chunks overlap: a line counts once for each neighbourhood it is seen in
    repeated = checkpoint(lines.groupBy("document", "skeleton").agg(F.count_distinct("beside").alias("n"), F.first("words").alias("words")).where("n > 1"))
    usual = repeated.where("n > 2").select(F.explode("words").alias("word")).distinct().join(counts.where(F.col("n") >= least), "word", "left_semi")
    usual = spark.sparkContext.broadcast({r[0] for r in usual.collect()})  # part of the vocabulary
    repeated = repeated.drop("words")
    own = lines.select("chunk_id", "document", "skeleton").distinct().join(repeated, ["document", "skeleton"]).groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("skeleton", "n"))).alias("repeated"))  # lines of one chunk
    scans = checkpoint(spread(scans.join(own, "chunk_id", "left"), "chunk_id"))
    known = spark.sparkContext.broadcast(set(vocabulary))

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Suspects with their chunk and the word before; and, without chunk, how often known words follow each other."""
        lexer, have = Lexer(), known.value
        for batch in batches:
            out, follows = [], {}
            for chunk, text, rep in zip(batch["chunk_id"], batch["raw_text"], batch["repeated"]):
                rows = shape(text)
                prev, own = "^", {}
                for w in running(rows, furniture(rows, dict(rep) if rep is not None else {}, usual.value)):
                    if w[2] is None:
                        x = lexer(w[1])[2]
                        if x in have:
                            follows[prev, x] = follows.get((prev, x), 0) + 1
                        elif suspect_form(x):
                            own[prev, x] = own.get((prev, x), 0) + 1
                        prev = x
                    else:
                        joined, whole, _ = spelled(w, lexer)
                        for x in {normal(joined), normal(whole)}:
                            if x not in have and suspect_form(x):
                                own[prev, x] = own.get((prev, x), 0) + 1
                        prev = normal(whole)
                out += [(chunk, p, x, n) for (p, x), n in own.items()]
            yield pd.DataFrame(out + [(None, p, x, n) for (p, x), n in follows.items()], columns=["chunk_id", "prev", "word", "n"])

    seen = checkpoint(scans.mapInPandas(pairs, "chunk_id string, prev string, word string, n bigint"))
    own = seen.where("chunk_id is not null")
    rare = own.groupBy("word").agg(F.sum("n").alias("in_scans")).join(counts, "word", "left").select("word", F.greatest("in_scans", F.coalesce("n", F.lit(0))).alias("n"))
    found = checkpoint(readings(rare.repartition(slots(spark) * 4), vocabulary, numbers))
    # several readings: the one that most often follows the word before
    options = found.select("reading").distinct()
    follows = seen.where("chunk_id is null").join(options, seen.word == options.reading, "left_semi").groupBy("prev", F.col("word").alias("reading")).agg(F.sum("n").alias("after"))
    ranked = own.groupBy("prev", "word").agg(F.count("*").alias("c")).join(found, "word").join(follows, ["prev", "reading"], "left")
    w = Window.partitionBy("prev", "word").orderBy(F.coalesce("after", F.lit(0)).desc(), F.desc("weight"), "reading")
    best = ranked.withColumn("r", F.row_number().over(w)).where("r = 1").select("prev", "word", "reading")
    fixes = own.join(best, ["prev", "word"]).groupBy("chunk_id").agg(F.collect_list(F.struct("prev", "word", "reading")).alias("fixes"))  # words of one chunk
    return scans, usual, (fixes, vocabulary, numbers, proper)


def worked(chunks: DataFrame) -> DataFrame:
    """(chunk_id, noise array<struct<start_char, noise_type, reading>>, clean_text) of every scan."""
    scans, usual, (fixes, vocabulary, numbers, proper) = prepare(chunks)
    spark = chunks.sparkSession
    shared = spark.sparkContext.broadcast((dict(zip(vocabulary, numbers)), proper))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (count, proper_), lexer = shared.value, Lexer()
        for batch in batches:
            noise, clean = [], []
            for text, rep, fix in zip(batch["raw_text"], batch["repeated"], batch["fixes"]):
                n, c = repair(text, dict(rep) if rep is not None else {}, {(f["prev"], f["word"]): f["reading"] for f in fix} if fix is not None else {}, count, usual.value, lexer, proper_)
                noise.append([{"start_char": a, "noise_type": t, "reading": r} for a, t, r in n])
                clean.append(c)
            yield pd.DataFrame({"chunk_id": batch["chunk_id"], "noise": noise, "clean_text": clean})

    return spread(scans.join(fixes, "chunk_id", "left"), "chunk_id").mapInPandas(run, "chunk_id string, noise array<struct<start_char:int,noise_type:string,reading:string>>, clean_text string")


def broken(second: str, joined: str, whole: str, count: dict[str, int], fixed: bool) -> bool:
    """Whether the hyphen at a line end is only the line's: joined, the word is better known than with its hyphen."""
    if not second or not second[0].isalpha() or second[0].isupper() and not joined.isupper():
        return False
    if NOT_WORD.search(joined) or not re.search(r"[^\W\d_]-", whole) or re.search(r"\d$", whole.split("-")[0]):
        return False
    a, b = count.get(normal(joined), 0), count.get(normal(whole), 0)
    if a or b:
        return a >= b
    if fixed:
        return True
    left, right = whole.rsplit("-", 1) if "-" in whole else (whole, "")
    return not (count.get(normal(left), 0) and count.get(normal(right), 0))


def repair(text: str, counts: dict[str, int], fixes: dict[tuple[str, str], str], count: dict[str, int], titles: set[str], lexer: Lexer, proper: set[str]) -> tuple[list[tuple[int, str, str | None]], str]:
    rows = shape(text)
    kind = furniture(rows, counts, titles)
    noise: list[tuple[int, str, str | None]] = [(r["at"], k, None) for r, k in zip(rows, kind) if k]
    replaced: dict[int, str] = {}  # offset of a token -> its text in the clean version
    gone: set[int] = set()
    prev, before = "^", None
    for w in running(rows, kind):
        start, token, hyphen, second_at, second = w
        if hyphen is None:
            core, skip, h = lexer(token)
            if h in count or not suspect_form(h):
                prev, before = h, token
                continue
            use, at, reading = core, start + skip, fixes.get((prev, h))
        else:
            joined, whole, at = spelled(w, lexer)
            j, h = normal(joined), normal(whole)
            use, reading = whole, None
            if second:
                is_break = broken(second, joined, whole, count, (prev, j) in fixes)
                if is_break:
                    noise.append((hyphen, "hyphen", None))
                    use = joined
                x = normal(use)
                reading = fixes.get((prev, x)) if x not in count and suspect_form(x) else None
                replaced[start] = (token[:-1] if is_break else token) + second
                gone.add(second_at)
        x = normal(use)
        opens = before is None or before[-1] in ".!?:)\"'" or before.isupper()
        prev, before = h, second or token
        name = use[:1].isupper() and not use.isupper() and not opens and not odd_signs(x) and reading not in proper  # a name, not a slip
        if x not in count and not name and suspect_form(x) and (reading or odd_signs(x)):
            noise.append((at, "char", reading))
            if reading:
                shown = reading.upper() if use.isupper() and len(use) > 1 else reading.capitalize() if use[:1].isupper() else reading
                tail = "'s" if re.search(r"['’]s$", use) else ""
                replaced[start] = replaced.get(start, token).replace(use, shown + tail, 1)
    paragraphs: list[list[str]] = [[]]
    for r, k in zip(rows, kind):
        if k:
            continue
        if not r["text"].strip():
            if paragraphs[-1]:
                paragraphs.append([])
            continue
        if SECTION.match(r["text"]) and r["text"].upper() == r["text"]:
            paragraphs += [[r["text"].strip()], []]
            continue
        for m in TOKEN.finditer(r["text"]):
            a = r["at"] + m.start()
            if a not in gone:
                paragraphs[-1].append(replaced.get(a, m[0]))
    joined_up: list[list[str]] = []
    for p in paragraphs:
        if not p:
            continue
        last = joined_up[-1][-1] if joined_up and joined_up[-1] else ""
        if joined_up and last and last[-1] not in ".!?:\"”)" and p[0][:1].islower():
            joined_up[-1] += p  # a page break in mid-sentence
        else:
            joined_up.append(p)
    return sorted(set(noise), key=lambda x: (x[0], x[1])), "\n\n".join(" ".join(p) for p in joined_up)


def noise_rows(work: DataFrame) -> DataFrame:
    return work.select("chunk_id", F.explode("noise").alias("n")).select("chunk_id", "n.start_char", "n.noise_type", "n.reading")

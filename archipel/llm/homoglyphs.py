"""Problem 10: visually identical text with different characters.

One consistent form for all text. A transducer is compiled once from rules over the Unicode database and a table of
look-alike letters; it reads a text in one pass, takes the longest match at each place, grapheme clusters whole, and
emits its canonical form:

* full- and half-width forms become the ordinary width (half-width kana with its sound mark is one cluster), letters in
  mathematical weights and slants the plain ones;
* base plus combining marks becomes the composed letter, marks in canonical order;
* every kind of blank becomes a space, every kind of line break a line feed, invisible characters vanish. Joiners
  inside an emoji sequence or between letters of a joining script are visible and stay;
* look-alike letters of Latin, Cyrillic, Greek, Armenian, Cherokee and Lisu take the script of their word, the context of
  their key. A word's script is that of its letters without look-alikes, else that of most words of the text; both are
  unchanged by any look-alike substitution, so two texts that look alike get equal forms while Russian and Greek words
  keep their own script. Letters that only the rarer scripts share with Latin speak for Latin, so a word of
Cherokee or Lisu that is all look-alikes becomes Latin.

Letter case, accents, digits, raised or circled numbers, fractions and emoji are visible and never changed.
A null text has a null form, an empty text an empty one.
"""

from __future__ import annotations

import unicodedata as ud
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archipel.session import checkpoint, spread

# Letters of other scripts that are drawn like the Latin letter before them, per script the first one being
# that script's own letter.
LOOKALIKES = """
a а
c с ϲ
d ԁ
e е
h һ հ
i і Ꭵ
j ј ϳ
l ӏ
o о ο օ
p р ρ
q ԛ
s ѕ
u ս
v ѵ ν
w ԝ
x х
y у
A А Α Ꭺ ꓮ
B В Β Ᏼ ꓐ
C С Ϲ Ꮯ ꓚ
D Ꭰ ꓓ
E Е Ε Ꭼ ꓰ
F ꓝ
G Ԍ Ꮐ ꓖ
H Н Η Ꮋ ꓧ
I І Ι Ӏ ꓲ
J Ј Ϳ Ꭻ ꓙ
K К Κ Ꮶ ꓗ
L Լ Ꮮ ꓡ
M М Μ Ꮇ ꓟ
N Ν ꓠ
O О Ο Օ ꓳ
P Р Ρ Ꮲ ꓑ
Q Ԛ
R Ꭱ ꓣ
S Ѕ Տ Ꮪ ꓢ
T Т Τ Ꭲ ꓔ
U Ս ꓴ
V Ѵ Ꮩ ꓦ
W Ԝ Ꮃ ꓪ
X Х Χ ꓫ
Y У Ү Υ ꓬ
Z Ζ Ꮓ ꓜ
"""

# Other characters drawn like the plain one before them.
SAME_DRAWING = {"-": "‐‑", "i": "ⅰ", "v": "ⅴ", "x": "ⅹ", "l": "ⅼ", "c": "ⅽ", "d": "ⅾ", "m": "ⅿ", "I": "Ⅰ", "V": "Ⅴ", "X": "Ⅹ", "L": "Ⅼ", "C": "Ⅽ", "D": "Ⅾ", "M": "Ⅿ", "a": "ɑ", "g": "ɡ", "μ": "µ"}

BREAKS = ("\r\n", "\r", "\x0b", "\x0c", "\x85", " ", " ")
LINKS = "\u200c\u200d"  # joiners, visible in some scripts and in emoji
SCRIPTS = ("latin", "cyrillic", "greek", "armenian", "cherokee", "lisu")
RANGES = ((0x370, 0x400, "greek"), (0x400, 0x530, "cyrillic"), (0x530, 0x590, "armenian"), (0x13A0, 0x1400, "cherokee"), (0x1E00, 0x1F00, "latin"), (0x1F00, 0x2000, "greek"), (0xA4D0, 0xA500, "lisu"))


def script_of(ch: str) -> str | None:
    cp = ord(ch)
    if not ch.isalpha():
        return None
    return "latin" if cp < 0x250 else next((name for lo, hi, name in RANGES if lo <= cp < hi), None)


def invisible(ch: str) -> bool:
    return ud.category(ch) == "Cf" and not 0x600 <= ord(ch) < 0x700 and not 0xE0000 <= ord(ch) or ch in "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0" or 0xFE00 <= ord(ch) <= 0xFE0F


def pictographic(ch: str) -> bool:
    return 0x1F000 <= ord(ch) < 0x20000 or 0x2190 <= ord(ch) < 0x2BFF and ud.category(ch) == "So" and not 0x2460 <= ord(ch) < 0x2500


def joining(ch: str) -> bool:
    """Letters of scripts in which a joiner changes the drawing: Arabic to N'Ko, and the Indic scripts."""
    return 0x600 <= ord(ch) < 0x800 or 0x900 <= ord(ch) < 0xE00


def width_rules() -> dict[str, str]:
    rules = {chr(cp): ud.normalize("NFKC", chr(cp)) for cp in range(0xFF01, 0xFFEF) if ud.east_asian_width(chr(cp)) in "FH" and not invisible(chr(cp))}
    for cp in range(0xFF66, 0xFF9E):  # a half-width kana and its half-width sound mark are one letter
        for mark in "\uff9e\uff9f":
            pair = ud.normalize("NFKC", chr(cp) + mark)
            if len(pair) == 1:
                rules[chr(cp) + mark] = pair
    return rules


def blank_rules() -> dict[str, str]:
    rules = {chr(cp): " " for cp in range(0x80, 0x3001) if ud.category(chr(cp)) == "Zs"}
    return rules | {"\t": " ", "\u2800": " "} | {x: "\n" for x in BREAKS}


def letter_rules() -> dict[str, str]:
    """Letters that differ from plain ones in weight or slant only, by the names the Unicode database has for them."""
    rules = {}
    for cp in range(0x1D400, 0x1D6A6):
        words = ud.name(chr(cp), "").split()
        if words and not {"SCRIPT", "FRAKTUR", "DOUBLE-STRUCK"} & {*words} and (plain := ud.normalize("NFKC", chr(cp))).isascii() and plain.isalpha():
            rules[chr(cp)] = plain
    return rules


def accent_rules() -> dict[str, str]:
    """Every letter with marks that has a composed form, taken apart in canonical order, and that form."""
    rules = {}
    for cp in (*range(0xC0, 0x2000), *range(0x3040, 0x3100), *range(0xFB1D, 0xFB50)):
        apart = ud.normalize("NFD", chr(cp))
        if len(apart) > 1:
            rules[apart] = ud.normalize("NFC", apart)
    return rules


def compile_transducer() -> tuple[dict[str, dict], dict[str, frozenset], frozenset]:
    """A trie of all keys for every script a word can be in, the scripts that characters with a rule speak for, and the
    letters that speak for none.

    The script is the context of a key: the same look-alike has one output in a Latin word and another in a Greek one.
    Checked for conflicts: no key has two outputs in one context, and every output is a fixed point there, so the form of
    a form is itself.
    """
    plain: dict[str, str] = {}

    def add(rules: dict[str, str]) -> None:
        for key, out in rules.items():
            if plain.setdefault(key, out) != out:
                raise ValueError(f"conflicting outputs for {key!r}: {plain[key]!r} and {out!r}")

    for rules in (width_rules(), blank_rules(), letter_rules(), accent_rules(), {ch: out for out, same in SAME_DRAWING.items() for ch in same}):
        add(rules)
    latin = {ch: line.split()[0] for line in LOOKALIKES.strip().splitlines() for ch in line.split()}
    roots = {}
    for script in SCRIPTS:
        own: dict[str, str] = {}
        for ch, letter in latin.items():
            if script_of(ch) == script:
                own.setdefault(letter, ch)
        here = {ch: own.get(letter, letter) for ch, letter in latin.items()}

        def spell(text: str, here: dict[str, str] = here) -> str:
            return ud.normalize("NFC", "".join(here.get(ch, ch) for ch in ud.normalize("NFD", text)))

        table = {key: spell(out) for key, out in plain.items()}
        for key, out in here.items():
            if table.setdefault(key, out) != out:
                raise ValueError(f"conflicting outputs for {key!r} in {script}: {table[key]!r} and {out!r}")
        for key in [k for k in accent_rules() if k[0] in latin]:  # a look-alike under the same marks is the same letter
            for ch, letter in latin.items():
                if letter == latin[key[0]]:
                    table[ch + key[1:]] = spell(key)
        root: dict = {}
        for key, out in table.items():
            if spell(out) != out or table.get(out, out) != out:
                raise ValueError(f"the output {out!r} of {key!r} is itself rewritten in {script}")
            node = root
            for ch in key:
                node = node.setdefault(ch, {})
            node[""] = out
        roots[script] = root
    living = {latin[ch] for ch in latin if script_of(ch) in ("cyrillic", "greek")}

    def said(ch: str) -> str | None:
        """A letter speaks for its script; one that Cyrillic or Greek has too for none, any other look-alike for Latin."""
        return script_of(ch) if ch not in latin else None if latin[ch] in living else "latin"

    votes = {ch: frozenset(["latin"]) for ch in latin if said(ch)}
    for key, out in plain.items():
        if len(key) == 1:
            votes[key] = frozenset(s for ch in ud.normalize("NFD", out) if (s := said(ch)))
    return roots, votes, frozenset(ch for ch in latin if said(ch) is None)


class Transducer:
    """Compiled once per task. A text is read once: what needs no rewriting is copied, other blanks, marks and signs are
    taken cluster by cluster and words whole. A word's script is that of its letters without look-alikes; where those say
    nothing or disagree, the word waits, in its place, for the script that most words of the text have. Words met before
    are remembered, up to a bound."""

    MEMO = 1 << 16

    def __init__(self) -> None:
        import regex

        self.roots, self.speaks, self.silent = compile_transducer()
        self.odd = regex.compile(r"[^ -~\n]")
        self.wordish = regex.compile(r"[\p{L}\p{M}\p{N}\p{Cf}’＇]")
        self.word = regex.compile(r"[\p{L}\p{M}\p{N}\p{Cf}'’＇]+")
        self.cluster = regex.compile(r"\r\n|\X")
        self.ascii_word = regex.compile(r"[A-Za-z0-9']+")
        self.memo: dict[str, tuple] = {}

    def rewrite(self, text: str, script: str) -> str:
        """Longest match from each place in the script's trie; what is invisible goes, what has no rule stays."""
        root, out, i, n = self.roots[script], [], 0, len(text)
        while i < n:
            node, j, best = root, i, None
            while j < n and text[j] in node:
                node = node[text[j]]
                j += 1
                if "" in node:
                    best = (j, node[""])
            if best:
                i = best[0]
                out.append(best[1])
                continue
            ch = text[i]
            if invisible(ch):
                before, after = text[i - 1 : i] if i else "", text[i + 1 : i + 2]
                emoji = before and (pictographic(before) or before == "\ufe0f" or 0x1F3FB <= ord(before) <= 0x1F3FF)
                keep = emoji and (ch == "\u200d" and after and pictographic(after) or ch in "\ufe0e\ufe0f") or ch in LINKS and before and joining(before)
                if not keep:
                    i += 1
                    continue
            out.append(ch)
            i += 1
        return "".join(out)

    def read(self, word: str) -> tuple[frozenset, dict[str, str], str]:
        """The scripts a word's letters speak for, its forms known so far, and the word with marks in canonical order."""
        known = self.memo.get(word)
        if known is None:
            apart = ud.normalize("NFD", word) if not word.isascii() else word
            apart = "".join(ch for ch in apart if not invisible(ch) or ch in LINKS or ch in "\ufe0e\ufe0f")  # so that marks meet their letter
            scripts: set[str] = set()
            for ch in apart:
                said = self.speaks.get(ch)
                if said is not None:
                    scripts |= said
                elif ch not in self.silent and (s := script_of(ch)):
                    scripts.add(s)
            if len(self.memo) >= self.MEMO:
                self.memo.clear()
            known = self.memo[word] = (frozenset(scripts), {}, apart)
        return known

    def form(self, word: str, script: str) -> str:
        _, forms, apart = self.read(word)
        found = forms.get(script)
        if found is None:
            found = forms[script] = ud.normalize("NFC", self.rewrite(ud.normalize("NFD", apart), script))
        return found

    def __call__(self, text: str | None) -> str | None:
        if text is None or not self.odd.search(text):
            return text
        parts: list = []  # text, or a word whose script is not known yet, as a tuple
        end, counts, waiting = 0, dict.fromkeys(SCRIPTS, 0), False
        for m in self.odd.finditer(text):
            start = m.start()
            if start < end:
                continue
            if self.wordish.match(text, start):
                while start > end and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] == "'"):
                    start -= 1
                piece = self.word.match(text, start)
                scripts = self.read(piece[0])[0]
                for s in scripts:
                    counts[s] += 1
                if len(scripts) == 1:
                    new: object = self.form(piece[0], next(iter(scripts)))
                else:
                    new, waiting = (piece[0],), True
            else:
                piece = self.cluster.match(text, start)
                new = self.rewrite(piece[0], "latin")
            parts += [text[end:start], new]
            end = piece.end()
        parts.append(text[end:])
        home = "latin"
        if waiting or any(counts[s] for s in SCRIPTS[1:]):
            for k in range(0, len(parts), 2):  # plain stretches: their words speak for Latin by the letters it alone has
                counts["latin"] += sum(any(ch not in self.silent and ch.isalpha() for ch in w) for w in self.ascii_word.findall(parts[k]))
            home = max(SCRIPTS, key=lambda s: (counts[s], s == "latin"))
            if home != "latin":
                alike = lambda w: w[0] if any(ch not in self.silent and ch.isalpha() for ch in w[0]) else self.form(w[0], home)
                parts[0::2] = [self.ascii_word.sub(alike, x) for x in parts[0::2]]
        return ud.normalize("NFC", "".join(self.form(x[0], home) if isinstance(x, tuple) else x for x in parts))


def canonical(df: DataFrame, column: str = "text", output: str = "canonical_text") -> DataFrame:
    """``df`` with ``output`` beside its columns; a column of that name is replaced. Nulls stay null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        transduce = Transducer()
        for texts in batches:
            yield texts.map(transduce, na_action="ignore").astype(object).where(texts.notna(), None)

    fn = F.pandas_udf(run, "string")
    return df.withColumn(output, F.when(F.col(column).rlike(r"[^ -~\n]"), fn(F.col(column))).otherwise(F.col(column)))


def classes(df: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, class_id, n_alike): for every row the least key whose text has its form, and the number of rows whose texts look
    the same though they are different strings. Linear, whatever the size of a class; rows without key or text have none."""
    k, t = F.col(key), F.col("__form")
    forms = canonical(spread(df.select(key, column).where(k.isNotNull() & F.col(column).isNotNull())), column, "__form")
    rows = checkpoint(forms.select(k.alias("k"), F.xxhash64(t, F.length(t)).alias("h1"), F.crc32(t).alias("h2"), F.xxhash64(F.col(column)).alias("raw")).distinct())
    per = rows.groupBy("h1", "h2", "raw").agg(F.count("*").alias("n"), F.min("k").alias("lo"))
    whole = per.groupBy("h1", "h2").agg(F.sum("n").alias("total"), F.min("lo").alias("class_id"))
    return rows.join(per.drop("lo"), ["h1", "h2", "raw"]).join(whole, ["h1", "h2"]).select(F.col("k").alias(key), "class_id", (F.col("total") - F.col("n")).alias("n_alike"))


def alike_pairs(df: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Pairs (smaller key first) of rows whose texts are different strings with one canonical form.

    Texts are compared by hashes of the form, so texts themselves are not shuffled. Forms written in only one way leave
    before the join, so a hot group of exact copies costs one aggregation and no join. Links are found between
    different texts; each copy of a text is then paired with the first row of every other text of its form, which
    keeps a group with many copies linear and loses no link between different texts. Rows whose text or key is null
    pair with nothing; a repeated row counts once.
    """
    k, t = F.col(key), F.col("__form")
    forms = canonical(spread(df.select(key, column).where(k.isNotNull() & F.col(column).isNotNull())), column, "__form")
    rows = checkpoint(forms.select(k.alias("k"), F.xxhash64(t, F.length(t)).alias("h1"), F.crc32(t).alias("h2"), F.xxhash64(F.col(column)).alias("raw")).distinct())
    texts = rows.groupBy("h1", "h2", "raw").agg(F.min("k").alias("rep"))  # one row per different text
    varied = texts.groupBy("h1", "h2").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("h1", "h2")
    texts = checkpoint(texts.join(varied, ["h1", "h2"], "left_semi"))
    a, b = texts.alias("a"), texts.alias("b")
    links = a.join(b, (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2")) & (F.col("a.raw") != F.col("b.raw")))
    links = links.select(F.col("a.h1").alias("h1"), F.col("a.h2").alias("h2"), F.col("a.raw").alias("raw"), F.col("b.rep").alias("other"))
    pairs = rows.join(links, ["h1", "h2", "raw"])  # every copy of a text with the representative of each other text
    return pairs.select(F.least("k", "other").alias(f"{key}_a"), F.greatest("k", "other").alias(f"{key}_b")).distinct()

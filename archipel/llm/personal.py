"""Problem 3: personal information inside free text, by a skip-chain conditional random field.

Patterns propose what could be personal: e-mail addresses in all their written-out forms, runs of digits, house numbers
with streets, and words that look like parts of names by how the corpus writes them (rarely in small letters, seldom
after prepositions of place). These are the field's nodes. Chain factors tie neighbouring nodes; skip factors tie
nodes of one document whose words are equal or similar, however far apart, so a name plain in one place is found in the
others. All nodes of a document with one word share one factor through a hub, which keeps a word that occurs ten thousand
times linear. Inference is loopy belief propagation, vectorised over all nodes of a batch; between the texts of a document
the hubs' messages are sums that Spark aggregates.

Weights of features and of the three kinds of factors start from stated values and are trained by gradient steps on a
bounded sample of chunks (``TRAIN_CHUNKS``) whose older, incomplete ``sensitive_entities`` hold; what the older masker left
out counts as unknown or, where the corpus speaks against it, as doubtful.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archipel.llm.words import MARK, token_counts
from archipel.session import checkpoint, spread

LABELS = ("O", "PERSON_NAME", "EMAIL", "PHONE", "ID_NUMBER", "STREET_ADDRESS")
INDEX = {x: i for i, x in enumerate(LABELS)}
TRAIN_CHUNKS, EPOCHS, RATE, PULL, ROUNDS, SHARE, FREQUENT = 500, 20, 0.05, 0.02, 4, 1e-6, 2e-5
NEVER, DOUBT = 2e-5, 0.3  # share of all words from which a word that is recorded in no name is none; weight of such labels

# Words about names, numbers and streets.
TITLES = set("mr mrs ms miss mx dr prof professor doctor sen senator rep representative judge justice gov governor capt captain sgt sergeant lt lieutenant col colonel gen general rev reverend sir dame lord lady hon nurse officer inspector detective sister brother father pastor president chairman chairwoman secretary minister mayor coach chief deputy herr frau monsieur madame señor señora".split())
PARTICLES = set("de da do dos das del della di du la le van von der den ter ten al el bin ibn ben abu st zu zur af av y".split())
ROLES = set("host anchor guest reporter caller moderator analyst speaker unidentified narrator interviewer announcer correspondent producer commentator operator man woman male female audience member voice question answer q a".split())
ORGANISATIONS = set("clinic company foods corporation corp inc ltd llc limited hospital university college school institute institution laboratory laboratories network group association society foundation department agency bureau council committee commission ministry board bank trust museum library gallery theater theatre church cathedral center centre club union league party press news times gazette herald journal post magazine studio studios productions records hotel inn restaurant cafe café bridge tower park square station airport stadium arena hall house building office district county quarry mill mine farm dairy brewery bakery cooperative partners brothers sons industries systems services holdings prize award cup festival act law report handbook review price list catalogue minutes memorandum survey results holdings report annual quarterly internal inspection street avenue road lane drive court blvd boulevard river lake mount mountain valley island bay ocean".split())
LEFT_NAME = ("my name is", "name is", "spoke with", "us is", "identified as", "mail for", "should go to", "neighbor,", "neighbour,", "signed by", "the name", "the hearing", "prepared by", "attention", "name:", "contact", "cc:", "applicant", "written by", "interview with", "talked to", "met with", "called", "named", "i am", "i'm", "welcome,", "thank you,", "thanks,", "dear", "sincerely,", "attn", "from:", "to:", "patient", "witness,", "by")
RIGHT_NAME = ("told", "said", "says", "wrote", "called", "replied", "added", ", who", "tel.", "phone", "with ssn", "with social", "with passport", "with national", "with taxpayer", "with resident", "with driver", "and i am", "is a", "( ")
LEFT_RE = re.compile(r"(?:^|[^a-z])(" + "|".join(re.escape(x) for x in sorted(LEFT_NAME, key=len, reverse=True)) + r")\s*$")
PHONE_LEFT = re.compile(r"(?:phone|tel|telephone|fax|call|called|number|hotline is|reach me on|contact|mobile|cell|dial|text|line|and|at|gave)\W*$", re.I)
PHONE_RIGHT = re.compile(r"^\W*(?:as the contact|any time|day or night|,? or by e?-?mail|ext|x\d)", re.I)
ID_LEFT = re.compile(r"(?:\bssn|social security(?: number| no)?|passport(?: no| number)?|licen[sc]e(?: no| number)?|insurance number|taxpayer (?:number|id)|tax (?:id|number)|resident card|identity card|id card|national id|national identity number|nin|nino|personal number|id(?: no| number)?|card)\W{0,4}$", re.I)
OTHER_LEFT = re.compile(r"(?:invoice|part number|order|ref|reference|catalog(?:ue)? item|item|lot|batch|docket|form|tracking number|case|flight|room|page|no\.? of|serial|account|bill|model|version|rev|channel|score was|between|and|opened in|segment|vol)\W{0,5}(?:no\W*|number\W*)?$", re.I)

STAMP = re.compile(r"^(?:Segment \d+ )?\[[\d.s:]+-[\d.s:]+\]: ?", re.M)
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
EMAIL = re.compile(
    r"(?<![\w.+@-])[A-Za-z0-9][\w.+-]*\s?@\s?[A-Za-z0-9][A-Za-z0-9-]*(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?!\w)"
    r"|(?<![\w.+@-])[A-Za-z0-9][\w.+-]*\s*(?:\[at\]|\(at\)|\{at\})\s*[A-Za-z0-9-]+(?:(?:\.|\s*(?:\[dot\]|\(dot\)|\{dot\})\s*)[A-Za-z0-9-]+)+(?!\w)"
    r"|(?<![\w.+@-])[A-Za-z0-9][\w.+-]*(?:\s+(?:dot|underscore|plus|dash|hyphen)\s+[\w+-]+)*\s+at\s+[A-Za-z0-9-]+(?:\s+dot\s+[A-Za-z0-9-]+)+(?!\w)",
    re.I,
)
SPOKEN = re.compile(r"\b(?:(?:oh|zero|one|two|three|four|five|six|seven|eight|nine|double|triple)[\s,-]+){6,14}(?:oh|zero|one|two|three|four|five|six|seven|eight|nine)\b", re.I)
EXTENSION = r"(?:,?\s*(?:(?i:ext\.?|extension)\s*|x\s?)\d{1,6})?"
DIGITS = re.compile(
    rf"(?<![\w.@#$€£%+-])(?:[A-Z]{{2}}\s?\d{{2}}\s?\d{{2}}\s?\d{{2}}\s?[A-Z](?!\w)|[A-Z]-\d{{6,9}}-[A-Z](?!\w)|[A-Z]{{1,2}}\d{{6,9}}(?!\w)|[A-Z]\d{{3}}-\d{{4}}-\d{{4}}(?!\w)"
    rf"|(?:\+\s?|\(\s?)?\d(?:\d|[\s().\-/]{{1,3}}(?=[\d(]))*\d(?!\w|%|@|-[A-Z]){EXTENSION}(?!\w))"
)
STREETS = r"(?i:street|st\.?|avenue|ave\.?|road|rd\.?|lane|ln\.?|drive|dr\.?|boulevard|blvd\.?|court|ct\.?|place|pl\.?|way|terrace|square|sq\.?|highway|hwy\.?|parkway|pkwy\.?|circle|cir\.?|crescent|close|row|alley|path|walk)"
UNIT = r"(?:,?\s*(?:\b(?i:apt|apartment|unit|suite|ste|flat|room|rm)\b\.?\s*#?\s*[A-Za-z]?\d{1,5}[A-Za-z]?|#\s?\d{1,5}[A-Za-z]?)(?!\w))?"
ADDRESS = re.compile(
    rf"(?<![\w.-])\d{{1,5}}[A-Za-z]?,?\s+(?:(?:[NSEW]\.?|[NS][EW]|(?i:north|south|east|west))\s+)?(?:[A-Z][\w'’]*\s+){{1,4}}?{STREETS}(?![\w]){UNIT}"
    rf"|(?<![\w.-])\d{{1,5}}(?:\s?(?:bis|ter))?,?\s+(?i:rue|avenue|boulevard|place|chemin|allée|impasse|quai|route|calle|via|viale|piazza|avenida|rua)\s+(?:(?i:de\s+la|de\s+l['’]|du|des|de|del|della|dei|da|do|la|le)\s+)?[A-Z][\w'’-]*{UNIT}"
)
COMPOUND = re.compile(r"(?<![\w-])[A-ZÄÖÜ]\w*(?:-[A-ZÄÖÜ]\w*)*(?i:straße|strasse|str\.|weg|platz|gasse|allee|damm|ufer)\s+\d{1,4}[a-z]?(?![\w])")
HINT_MAIL = re.compile(r"@|[\[({]at[\])}]|\sat\s+[a-z0-9-]+\s+dot\s")
HINT_STREET = re.compile(r"\d[a-z]?,?\s+[a-z][\w'’.]*\s(?:[^\d\n]{0,40}\n?[^\d\n]{0,30}?)(?:street|st\b|ave|road|rd\b|lane|ln\b|drive|dr\b|blvd|boulevard|court|ct\b|place|pl\b|way|terrace|square|highway|parkway|circle|crescent|close|row|alley|path|walk)|\d\s?(?:bis|ter)?,?\s+(?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|route|calle|via|viale|piazza|avenida|rua)\s|street|avenue")
HINT_COMPOUND = re.compile(r"(?:stra(?:ß|ss)e|str\.|weg|platz|gasse|allee|damm|ufer)\s+\d")
HINT_SPOKEN = re.compile(r"\b(?:oh|zero|one|two|three|four|five|six|seven|eight|nine)[\s,-]+(?:oh|zero|one|two|three|four|five|six|seven|eight|nine)\b")
FORM = set("attention attn applicant contact name names tel telephone fax phone mobile email e mail cc bcc ssn return to home address form please re from date subject dear signed prepared item invoice lot batch order ref printed confidential catalog part number section page vol segment ocr line monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december english french german spanish".split())


def visible(text: str) -> str:
    """The text with scanner and segment marks blanked out, so offsets stay."""
    blank = lambda m: " " * len(m[0])
    return STAMP.sub(blank, MARK.sub(blank, text)) if "OCR Line" in text or "]: " in text else text


def folded(word: str) -> str:
    w = word.lower().replace("’", "'")
    w = w[:-2] if w.endswith("'s") else w
    return "".join(ch for ch in ud.normalize("NFKD", w) if not ud.combining(ch)) if not w.isascii() else w


class Words:
    """How the corpus writes words: sets of ordinary words, of names of places, of words seen in names; words so
    frequent that they are no part of anybody's name count as ordinary."""

    def __init__(self, ordinary: set[str], places: set[str], names: set[str], frequent: set[str], often: set[str] = frozenset()) -> None:
        self.ordinary, self.places, self.names = ordinary | (frequent - names - places), places, names
        self.never = often - names


def trimmed_address(text: str, s: int, e: int) -> int:
    """The end of an address: the full stop belongs to it only in an abbreviation that the sentence goes on after."""
    if text[e - 1] == "." and not re.search(r"(?i)\b(?:st|rd)\.$", text[s:e]):
        after = text[e : e + 2]
        if not after.strip() or after[:1] in " \n" and after[1:2].isupper():
            return e - 1
    return e


def digit_shape(s: str) -> str:
    flat = re.sub(r"(?i),?\s*(?:ext\.?|extension|x)\s*\d+$", "", s)
    return re.sub(r"\s+", " ", re.sub(r"[A-Za-z]", "A", re.sub(r"\d", "9", flat)))


PHONE_SHAPES = re.compile(r"^(?:\+9{1,3}[ .\-/()9]{7,17}|0{0}99[9]{2}-99-9{5}-9{3}|999 9999 9999|\(? ?999 ?\)[ .-]{0,3}999 ?[-. ] ?9999|999[-./ ]999[-. ]9999|9-999-999-9999|9{10}|999-9999)$")
ID_SHAPES = re.compile(r"^(?:999[- ]99[- ]9999|9{9}|99-9{7}|A-9{8}-A|A9{8}|A999-9999-9999|AA ?99 ?99 ?99 ?A|9{5} 9{5})$")


def proposals(text: str, words: Words) -> list[tuple]:
    """Nodes in order: (start, end, kind, features, skip key, run)."""
    view = visible(text)
    nodes: list[tuple] = []
    taken = bytearray(len(view))

    def left_of(at: int, n: int = 34) -> str:
        return " ".join(view[max(0, at - n - 30) : at].split())[-n:]

    def right_of(at: int, n: int = 26) -> str:
        return " ".join(view[at : at + n + 30].split())[:n]

    def free(s: int, e: int) -> bool:
        return 1 not in taken[s:e]

    def take(s: int, e: int) -> None:
        taken[s:e] = b"\x01" * (e - s)

    low = view.lower()
    if HINT_MAIL.search(low):
        for m in EMAIL.finditer(view):
            s, e = m.span()
            if not free(s, e):
                continue
            kind = "email_at" if "@" in m[0] else "email_mark" if re.search(r"[\[({]at", m[0], re.I) else "email_words"
            nodes.append((s, e, "email", ["email", kind], None, None))
            take(s, e)
    if re.search(r"\d", view):
        for m in [*(ADDRESS.finditer(view) if HINT_STREET.search(low) else ()), *(COMPOUND.finditer(view) if HINT_COMPOUND.search(low) else ())]:
            s, e = m.span()
            e = trimmed_address(view, s, e)
            if free(s, e) and "\n\n" not in view[s:e]:
                left = left_of(s).lower()
                feats = ["address"] + (["address_left"] if re.search(r"(?:live at|lives at|lived at|sent to|calling from|arrives at|gave|address|return to:?|to:|at|from)\W*$", left) else [])
                nodes.append((s, e, "address", feats, None, None))
                take(s, e)
        for m in DIGITS.finditer(view):
            s, e = m.span()
            s += len(m[0]) - len(m[0].lstrip())
            raw = view[s:e]
            if len(raw) < 6:
                continue
            digits = sum(ch.isdigit() for ch in raw)
            if digits < 6 or "\n\n" in raw or not free(s, e):
                continue
            left, right = left_of(s), right_of(e)
            shape = digit_shape(raw)
            feats = ["digits", f"n{min(digits, 16)}"]
            if raw[0] == "(" and raw.count("(") > raw.count(")"):
                continue
            feats += ["phone_shape"] * bool(PHONE_SHAPES.match(shape) or shape.startswith("0099")) + ["id_shape"] * bool(ID_SHAPES.match(shape.upper()))
            feats += ["phone_left"] * bool(PHONE_LEFT.search(left)) + ["phone_right"] * bool(PHONE_RIGHT.match(right)) + ["id_left"] * bool(ID_LEFT.search(left)) + ["other_left"] * bool(OTHER_LEFT.search(left))
            feats += ["extension"] * bool(re.search(r"(?i)(?:ext|x)", raw)) + ["plus"] * (raw[0] == "+")
            nodes.append((s, e, "digits", feats, None, None))
            take(s, e)
    if HINT_SPOKEN.search(low):
        for m in SPOKEN.finditer(view):
            if free(*m.span()):
                nodes.append((*m.span(), "digits", ["spoken"] + ["phone_left"] * bool(PHONE_LEFT.search(left_of(m.start()))), None, None))
                take(*m.span())
    nodes += name_nodes(view, words, taken, left_of, right_of)
    nodes.sort()
    return nodes


def name_nodes(view: str, words: Words, taken: bytearray, left_of, right_of) -> list[tuple]:
    tokens = []
    ordinary, marked = words.ordinary, PARTICLES | TITLES
    for m in TOKEN.finditer(view):
        w = m[0]
        if w in ordinary and w not in marked:  # an ordinary word in small letters
            continue
        s, e = m.span()
        if taken[s]:
            continue
        f = w.lower() if w.isascii() and "'" not in w else folded(w)
        plain, big = f in ordinary, w[0].isupper()
        if len(w) == 1:
            if not big or view[e : e + 1] not in ". \n" or plain and view[e : e + 1] != "." or s and not view[s - 1].isspace() and view[s - 1] not in "(\"'":
                continue
            kind = "initial"
        elif f in FORM or f in ROLES and f not in words.names:
            continue
        elif f in PARTICLES and not (big and plain):
            kind = "particle"
        elif f in TITLES and (big or view[e : e + 1] == "."):
            kind = "title"
        elif plain:
            if not big:
                continue
            kind = "ordinary"
        else:
            kind = "rare"
        tokens.append((s, e, w, f, kind))
    out, i, n, run = [], 0, len(tokens), 0
    while i < n:
        kind = tokens[i][4]
        if kind == "title":
            i += 1
            continue
        j, rare = i, kind == "rare"
        while j + 1 < n and tokens[j + 1][4] != "title":
            a, b = tokens[j], tokens[j + 1]
            gap = view[a[1] : b[0]]
            if a[4] == "initial" and gap[:1] == ".":
                gap = gap[1:] or " "
            elif gap[:1] == "," and j == i and a[4] == "rare" and b[4] == "rare" and a[3] not in words.places and b[3] not in words.places:
                gap = gap[1:]  # surname, given name
            if not (gap == "-" or gap.isspace() and "\n\n" not in gap):
                break
            j += 1
            rare |= b[4] == "rare"
        if rare:
            run += 1
            out += run_nodes(view, words, tokens, i, j, run, left_of, right_of)
        i = j + 1
    return out


def run_nodes(view: str, words: Words, tokens: list, i: int, j: int, run: int, left_of, right_of) -> list[tuple]:
    """Nodes of one run of words that could make up a name. What stands around the run speaks for all its words."""
    group = tokens[i : j + 1]
    # a word that only opens the sentence or line is no part of the name
    edge = lambda t: t[4] == "particle" or t[4] == "ordinary" and t[3] not in words.names
    while group and edge(group[0]):
        if group[0][4] == "ordinary" and len(group) > 1 and group[1][4] == "rare" and (m := LEFT_RE.search(left_of(group[0][0]).lower())) and m[1] not in ("by", "the name", "called"):
            break  # "Contact Rose Miller": an ordinary word as a given name
        group = group[1:]
    while group and edge(group[-1]):
        group = group[:-1]
    if not group or not any(t[4] == "rare" for t in group):
        return []
    s, e = group[0][0], group[-1][1]
    left = left_of(s).lower()
    before = tokens[i - 1] if i else None
    entitled = before is not None and before[4] == "title" and bool(re.fullmatch(r"\.?\s{1,3}", view[before[1] : s] or " "))
    triggered = LEFT_RE.search(left) if left else None
    if all(t[3] in words.places for t in group if t[4] == "rare") and not entitled and not triggered:
        return []  # a place as places are written
    right = right_of(e)
    low_right = right.lower()
    at_line = view.rfind("\n", 0, s) + 1
    opens_line = not view[at_line:s].strip()
    label = opens_line and bool(re.match(r"\s?(?:,\s*[A-Za-z .-]{2,30})?:\s", right + " ")) and e - s < 60
    shared = []
    if label and not re.match(r"(?:name|contact|tel|fax|phone|ssn|attention)\b", view[s:e].lower()):
        shared.append("speaker")
    if triggered:
        shared.append("left_by" if triggered[1] == "by" else "left_name")
    elif re.search(r"(?:;|\band)\W*$", left):
        shared.append("left_list")
    if entitled:
        shared.append("title")
    if low_right.startswith(RIGHT_NAME):
        shared.append("right_name")
    if re.match(r"\s?\(?[\w.+-]+(?:@|\s?\[at\]|\s?\(at\)|\s+at\s+\w+\s+dot| @)", right):
        shared.append("right_mail")
    following = re.match(r"\s+([A-Za-z][\w]*)(?:\s+([A-Za-z]\w*))?(?:\s+([A-Za-z]\w*))?", view[e : e + 60])
    next_words = [w.lower() for w in following.groups() if w] if following else []
    inner = [t[3] for t in group]
    if any(w in ORGANISATIONS for w in inner) or next_words and next_words[0] in ORGANISATIONS and following[1][0].isupper() or len(next_words) > 1 and next_words[1] in ORGANISATIONS and following[1][0].isupper() and following[2][0].isupper():
        shared.append("organisation")
    if left.endswith(" the") or left == "the":
        shared.append("after_the")
    if re.search(r"\b(?:in|near|to|from|at|around|outside|of|called|district of)\s*$", left) and not left.endswith("go to"):
        shared.append("after_place")
    if re.search(r"\d\s*$", left):
        shared.append("after_number")
    rare = [t for t in group if t[4] == "rare"]
    known = sum(t[3] in words.names for t in group)
    if known:
        shared.append("name_word" if known == 1 else "name_words")
    if len(rare) >= 2 or len(rare) == 1 and any(t[4] == "initial" for t in group):
        shared.append("two_rare")
    if all(t[2][0].islower() for t in rare):
        shared.append("small_letters")
    if all(t[3] in words.places for t in rare):
        shared.append("all_places")
    elif any(t[3] in words.places for t in rare):
        shared.append("a_place")
    nodes = []
    for t in group:
        own = [*shared, "k_" + t[4]]
        if t[4] == "rare":
            own += ["place"] * (t[3] in words.places) + ["name_own"] * (t[3] in words.names) + ["hyphened"] * (view[t[1] : t[1] + 1] == "-" or view[t[0] - 1 : t[0]] == "-")
            if re.search(r"\d", view[max(0, t[0] - 1) : t[1] + 1]) or view[t[1] : t[1] + 1] in "@|!_" and view[t[1] : t[1] + 1]:
                own.append("noisy")
        end = t[1] - 2 if re.search(r"['’][sS]$", t[2]) else t[1]
        nodes.append((t[0], end, "name", own, t[3] if t[4] == "rare" and len(t[3]) > 2 else None, run))
    return nodes


# Starting weights, feature -> label -> weight; what is not stated is 0.
START = {
    "email": {"EMAIL": 3.0}, "email_at": {"EMAIL": 3.0}, "email_mark": {"EMAIL": 2.5}, "email_words": {"EMAIL": 1.5},
    "address": {"STREET_ADDRESS": 2.0}, "address_left": {"STREET_ADDRESS": 3.0},
    "digits": {"O": 1.0}, "phone_shape": {"PHONE": 2.0}, "id_shape": {"ID_NUMBER": 1.0}, "phone_left": {"PHONE": 2.0}, "phone_right": {"PHONE": 2.0}, "id_left": {"ID_NUMBER": 4.5},
    "other_left": {"O": 3.0}, "extension": {"PHONE": 2.0}, "plus": {"PHONE": 1.5}, "spoken": {"PHONE": 3.0}, "n6": {"O": 1.5}, "n9": {"ID_NUMBER": 0.3},
    "k_rare": {"PERSON_NAME": -1.0}, "k_ordinary": {"PERSON_NAME": -2.0}, "k_initial": {"PERSON_NAME": -0.5}, "k_particle": {"PERSON_NAME": -0.3},
    "speaker": {"PERSON_NAME": 3.0}, "left_name": {"PERSON_NAME": 3.0}, "left_by": {"PERSON_NAME": 1.0}, "left_list": {"PERSON_NAME": 0.7}, "title": {"PERSON_NAME": 3.5}, "right_name": {"PERSON_NAME": 2.5}, "right_mail": {"PERSON_NAME": 2.0},
    "organisation": {"PERSON_NAME": -6.0}, "after_the": {"PERSON_NAME": -2.5}, "after_place": {"PERSON_NAME": -1.0}, "after_number": {"PERSON_NAME": -2.0}, "name_word": {"PERSON_NAME": 1.5}, "name_words": {"PERSON_NAME": 3.0}, "name_own": {"PERSON_NAME": 0.5},
    "two_rare": {"PERSON_NAME": 1.5}, "small_letters": {"PERSON_NAME": -2.5}, "all_places": {"PERSON_NAME": -3.5}, "a_place": {"PERSON_NAME": -0.5}, "place": {"PERSON_NAME": -1.0}, "hyphened": {"PERSON_NAME": 0.3}, "noisy": {"PERSON_NAME": -2.5},
}
FACTORS = {"chain": 1.5, "equal": 1.2, "similar": 1.1}  # agreement of neighbours in a run, of equal and of similar words
PROPOSED = {"email": ("O", "EMAIL"), "address": ("O", "STREET_ADDRESS"), "digits": ("O", "PHONE", "ID_NUMBER"), "name": ("O", "PERSON_NAME")}


def start_weights() -> dict[str, np.ndarray]:
    out = {}
    for feature, by in START.items():
        out[feature] = np.zeros(len(LABELS))
        for label, x in by.items():
            out[feature][INDEX[label]] = x
    return out


def unary(nodes: list[tuple], weights: dict[str, np.ndarray]) -> np.ndarray:
    u = np.zeros((len(nodes), len(LABELS)))
    for k, node in enumerate(nodes):
        for f in node[3]:
            w = weights.get(f)
            if w is not None:
                u[k] += w
        mask = np.full(len(LABELS), -1e6)
        for label in PROPOSED[node[2]]:
            mask[INDEX[label]] = 0.0
        u[k] += mask
    return u


def lse(x: np.ndarray) -> np.ndarray:
    m = x.max(-1, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(-1, keepdims=True)))[..., 0]


def skeleton(word: str) -> str | None:
    """What similar spellings of a word share: its first letter and its consonants, doubled ones once."""
    rest = [ch for ch in word[1:] if ch not in "aeiouyh'"]
    kept = word[0] + "".join(ch for i, ch in enumerate(rest) if i == 0 or ch != rest[i - 1])
    return "~" + kept if len(kept) >= 4 else None


def graph(documents: list[list[list[tuple]]]) -> tuple[np.ndarray, list[list[str | None]], np.ndarray]:
    """Over the nodes of all texts of all documents in a row: the runs they belong to, their two keys (the word, and its
    skeleton), and the documents they are in."""
    runs, keys, docs, at = [], [[], []], [], {}
    for d, texts in enumerate(documents):
        for t, nodes in enumerate(texts):
            for k, node in enumerate(nodes):
                runs.append(at.setdefault((d, t, node[5] if node[5] is not None else -k - 1), len(at)))
                keys[0].append(node[4])
                keys[1].append(skeleton(node[4]) if node[4] else None)
                docs.append(d)
    return np.array(runs, int), keys, np.array(docs, int)


def hubs_of(keys: list[str | None], docs: np.ndarray, far: dict[tuple[int, str], float]) -> tuple[np.ndarray, np.ndarray, dict]:
    """A hub for every key that a document has more than once, here or in a text elsewhere: its number for each node (-1 for
    none), and what the texts elsewhere say to it, as log-odds of a name."""
    count = Counter((d, k) for d, k in zip(docs.tolist(), keys) if k)
    names: dict[tuple[int, str], int] = {}
    ids = np.array([names.setdefault((d, k), len(names)) if k and (count[d, k] > 1 or (d, k) in far) else -1 for d, k in zip(docs.tolist(), keys)], int)
    outside = np.zeros(len(names))
    for key, i in names.items():
        outside[i] = far.get(key, 0.0)
    return ids, outside, names


def beliefs(u: np.ndarray, runs: np.ndarray, skips: list[tuple[np.ndarray, np.ndarray, float]], chain: float, rounds: int = ROUNDS) -> tuple[np.ndarray, list[np.ndarray]]:
    """Loopy belief propagation: exact forward and backward passes along every run, messages to and from the hubs of each kind
    of skip factor between the rounds. A kind is (hub of every node, what is said to each hub from elsewhere, weight).
    Returns the marginals and, per kind, what every node says to its hub."""
    n, L = u.shape
    said = [np.zeros(n) for _ in skips]
    if not n:
        return u, said
    same, name = np.eye(L), INDEX["PERSON_NAME"]
    order = np.arange(n)
    start = np.append(True, runs[1:] != runs[:-1])
    place = order - np.maximum.accumulate(np.where(start, order, 0))  # position in the run
    length = place.max() + 1
    members = [np.flatnonzero(h >= 0) for h, _, _ in skips]
    to_node = [np.zeros_like(u) for _ in skips]  # hub -> node
    b = u
    for _ in range(rounds if any(len(m) for m in members) else 1):
        local = u + sum(to_node) if skips else u
        f, g = np.zeros_like(u), np.zeros_like(u)
        for p in range(1, length):
            at = np.flatnonzero(place == p)
            prev = local[at - 1] + f[at - 1]
            f[at] = lse(prev[:, None, :] + chain * same[None])
            f[at] -= f[at].max(1, keepdims=True)
        for p in range(length - 2, -1, -1):
            at = np.flatnonzero((place == p) & np.append(~start[1:], False))
            nxt = local[at + 1] + g[at + 1]
            g[at] = lse(nxt[:, None, :] + chain * same[None])
            g[at] -= g[at].max(1, keepdims=True)
        b = local + f + g
        for k, ((hub, outside, weight), member) in enumerate(zip(skips, members)):
            if not len(member):
                continue
            cavity = b[member] - to_node[k][member]
            up = lse(cavity[:, None, :] + weight * same[None])
            up -= up.max(1, keepdims=True)
            said[k][member] = up[:, name] - up[:, 0]
            total = np.zeros((len(outside), L))
            total[:, name] = outside
            np.add.at(total, hub[member], up)
            down = lse((total[hub[member]] - up)[:, None, :] + weight * same[None])
            to_node[k][member] = down - down.max(1, keepdims=True)
    p = np.exp(b - b.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True), said


def spans(nodes: list[tuple], p: np.ndarray) -> list[tuple[int, int, str]]:
    """Decided spans of (start, end, kind, -, -, run): neighbouring name nodes of a run are one name."""
    best = p.argmax(1) if len(nodes) else []
    out: list[tuple[int, int, str]] = []
    last = None
    for node, k in zip(nodes, best):
        label = LABELS[k]
        if label == "PERSON_NAME" and last is not None and last == node[5]:
            out[-1] = (out[-1][0], node[1], label)
        elif label != "O":
            out.append((node[0], node[1], label))
        last = node[5] if label == "PERSON_NAME" else None
    return [x for x in out if x[2] != "PERSON_NAME" or x[1] - x[0] > 2]


def masked(text: str, found: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for s, e, label in found:
        out.append(text[at:s] + f"[{label}]")
        at = e
    return "".join(out) + text[at:]


def train(sample: pd.DataFrame, words: Words) -> tuple[dict[str, np.ndarray], dict[str, float]]:
    """Weights of features and factors, by gradient steps on nodes whose label is known: how far the field with the known
    labels held agrees with itself more than the free field, for every feature and every pair that a factor ties.

    Known are the nodes the older masker recorded rightly. Known in doubt, as it left out much, are numbers it left alone in
    a text in which it recorded one, and words that the corpus has often and no recorded name anywhere. None of these labels
    is read off the surroundings. The pull keeps weights near their start where evidence is thin.
    """
    weights, factors = start_weights(), dict(FACTORS)
    init = {f: w.copy() for f, w in weights.items()}
    documents: dict = {}
    for i, (doc, text, entities) in enumerate(zip(sample["document_id"], sample["raw_text"], sample["sensitive_entities"])):
        nodes = proposals(text, words)
        marks = [(e["start"], e["end"], e["entity_type"]) for e in (entities if entities is not None else []) if e["entity_type"] in INDEX and e["start"] is not None and e["text"] and text[e["start"] : e["end"]] == e["text"]]
        numbers = any(t in ("PHONE", "ID_NUMBER") for _, _, t in marks)
        known = []
        for node in nodes:
            hit = next((t for x, y, t in marks if x <= node[0] and node[1] <= y + 2 and t in PROPOSED[node[2]]), None)
            never = node[2] == "digits" and numbers or node[2] == "name" and node[4] in words.never
            known.append((INDEX[hit], 1.0) if hit else (0, DOUBT) if never else (-1, 0.0))
        if any(k >= 0 for k, _ in known):
            documents.setdefault(doc if isinstance(doc, str) else i, []).append((nodes, known))
    if not documents:
        return weights, factors
    texts = [[nodes for nodes, _ in d] for d in documents.values()]
    flat = [node for d in texts for nodes in d for node in nodes]
    y, sure = (np.array(x) for x in zip(*[k for d in documents.values() for _, known in d for k in known]))
    runs, keys, docs = graph(texts)
    hubs = [hubs_of(k, docs, {})[:2] for k in keys]
    at = np.flatnonzero(y >= 0)
    ties = [np.flatnonzero(runs[1:] == runs[:-1])] + [np.flatnonzero(h >= 0) for h, _ in hubs]

    def agreement(p: np.ndarray) -> list[float]:
        """How likely the two ends of a tie agree, summed: neighbours with each other, members with the mean of their hub."""
        out = [float((p[ties[0]] * p[ties[0] + 1]).sum())]
        for (h, outside), member in zip(hubs, ties[1:]):
            n = np.maximum(np.bincount(h[member], minlength=len(outside)), 1)[:, None]
            mean = np.zeros((len(outside), p.shape[1]))
            np.add.at(mean, h[member], p[member])
            out.append(float((p[member] * (mean / n)[h[member]]).sum()))
        return out

    for _ in range(EPOCHS):
        u = unary(flat, weights)
        clamp = u.copy()
        hold = np.full((len(at), len(LABELS)), -1e6)
        hold[np.arange(len(at)), y[at]] = 0.0
        clamp[at] = np.where(sure[at, None] == 1, hold, clamp[at])
        skips = [(h, o, factors[name]) for (h, o), name in zip(hubs, ("equal", "similar"))]
        free, held = beliefs(u, runs, skips, factors["chain"])[0], beliefs(clamp, runs, skips, factors["chain"])[0]
        target = held[at].copy()
        target[sure[at] < 1] = np.eye(len(LABELS))[y[at][sure[at] < 1]]
        gap = (target - free[at]) * sure[at, None]
        steps: dict[str, np.ndarray] = {}
        seen: Counter = Counter()
        for k, i in enumerate(at):
            for f in flat[i][3]:
                if f in weights:
                    steps[f] = steps.get(f, 0) + gap[k]
                    seen[f] += 1
        for f, step in steps.items():
            weights[f] = weights[f] + RATE * step / np.sqrt(seen[f]) - PULL * (weights[f] - init[f])
        for name, a, b, tie in zip(FACTORS, agreement(held), agreement(free), ties):
            if len(tie):
                factors[name] = float(np.clip(factors[name] + RATE * (a - b) / np.sqrt(len(tie)) - PULL * (factors[name] - FACTORS[name]), 0.0, 3.0))
    return weights, factors


def corpus_words(rows: DataFrame, names: set[str]) -> Words:
    """Counts of all words by their writing; only words that make up at least one in a million are kept, so the sets
    have at most a million members."""
    place_after = r"\b(?:in|near|from|to|at|around) ([A-Z][a-zà-ÿ]+)(?= |[.,;:?!]|$)(?! [A-Z])"
    tokens = token_counts(rows, pattern=place_after)
    trimmed = tokens.select(F.regexp_replace("token", r"^[^\p{L}]+|[^\p{L}]+$", "").alias("w"), "n", "m").where(F.col("w").rlike(r"^\p{L}+(?:['’-]\p{L}+)*$"))
    low = F.regexp_replace(F.regexp_replace(F.lower("w"), "’", "'"), "'s$", "")
    small = F.when(F.col("w") == F.lower("w"), F.col("n")).otherwise(0)
    counted = checkpoint(trimmed.groupBy(low.alias("word")).agg(F.sum("n").alias("n"), F.sum(small).alias("small"), F.sum("m").alias("p")))
    total = counted.agg(F.sum("n")).head()[0] or 0
    kept = counted.where(F.col("n") >= max(2.0, SHARE * total)).collect()
    ordinary = {r["word"] for r in kept if r["small"] >= 0.4 * r["n"] and r["small"] >= 3}
    frequent = {r["word"] for r in kept if r["n"] >= max(10.0, FREQUENT * total)}
    place = {r["word"] for r in kept if r["p"] and r["p"] >= 0.2 * r["n"] and r["word"] not in ordinary}
    often = {r["word"] for r in kept if r["n"] >= max(10.0, NEVER * total)}
    return Words(ordinary, place, names - place, frequent, often)


def find(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunk_id, found array<struct<start_char, end_char, entity_type>>), and the texts (chunk_id, document_id, raw_text), one
    row per chunk_id.

    A first pass proposes the nodes of every text, weighs them and passes messages within it. What its words say is summed
    per document and word, so that a document of any number of chunks, or a word of any number of uses, is an aggregation
    and never one task; a second, light pass gives every text what the rest of its document says and decides.
    """
    spark = chunks.sparkSession
    rows = chunks.where("chunk_id is not null").select("chunk_id", "document_id", "raw_text", "sensitive_entities")
    marks = F.min(F.when(F.size("sensitive_entities") > 0, F.struct("raw_text", "sensitive_entities"))).alias("m")
    texts = checkpoint(spread(rows, "chunk_id").groupBy("chunk_id").agg(F.min("raw_text").alias("raw_text"), F.min("document_id").alias("document_id"), marks).select("chunk_id", "document_id", "raw_text", F.when(F.col("m.raw_text") == F.col("raw_text"), F.col("m.sensitive_entities")).alias("sensitive_entities")))
    # words the older masker saw in names, where they are rarely ordinary
    named = texts.select(F.explode("sensitive_entities").alias("e")).where("e.entity_type = 'PERSON_NAME'").select(F.explode(F.split(F.lower("e.text"), r"[^\p{L}'’]+")).alias("w")).where("length(w) > 2").groupBy("w").agg(F.count("*").alias("n"))
    total = named.agg(F.sum("n")).head()[0] or 0
    names = {r["w"] for r in named.where(F.col("n") >= max(2.0, 1e-5 * total)).collect()} - PARTICLES  # at most 100,000
    words = corpus_words(texts.where("raw_text is not null"), names)
    labelled = texts.where("raw_text is not null and size(sensitive_entities) > 0").withColumn("_d", F.xxhash64("chunk_id") / F.lit(2.0**64) + 0.5)
    share = min(1.0, 2.0 * TRAIN_CHUNKS / max(1, labelled.count()))  # so tasks send few more rows than are wanted
    labelled = labelled.where(F.col("_d") <= share).orderBy("_d", "chunk_id").limit(TRAIN_CHUNKS).drop("_d").toPandas()
    weights, factors = train(labelled, words)
    shared = spark.sparkContext.broadcast((weights, factors, (words.ordinary, words.places, words.names)))
    KINDS = list(PROPOSED)

    def settled(texts_: list[list[tuple]], u: np.ndarray, far: list[dict[str, float]]) -> tuple[np.ndarray, list[dict[str, float]]]:
        """Marginals of texts, each a document of its own, and what every text's words say to the rest of its document."""
        _, factors_, _ = shared.value
        runs, keys, docs = graph([[nodes] for nodes in texts_])
        known = {(d, k): x for d, said in enumerate(far) for k, x in said.items()}
        every = {(d, k) for ks in keys for d, k in zip(docs.tolist(), ks) if k}
        hubs = [hubs_of(k, docs, {key: known.get(key, 0.0) for key in every}) for k in keys]
        p, said = beliefs(u, runs, [(h, o, factors_[name]) for (h, o, _), name in zip(hubs, ("equal", "similar"))], factors_["chain"])
        out: list[dict[str, float]] = [{} for _ in texts_]
        for ks, x in zip(keys, said):
            for d, k, v in zip(docs.tolist(), ks, x.tolist()):
                if k:
                    out[d][k] = out[d].get(k, 0.0) + v
        return p, out

    def propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights_, _, sets = shared.value
        words_ = Words(*sets, set())
        for batch in batches:
            for part in range(0, len(batch), 500):
                piece = batch.iloc[part : part + 500]
                nodes = [proposals(t or "", words_) for t in piece["raw_text"]]
                u = unary([x for n in nodes for x in n], weights_)
                _, said = settled(nodes, u, [{} for _ in nodes])
                ends = np.cumsum([len(n) for n in nodes])
                yield pd.DataFrame({
                    "chunk_id": piece["chunk_id"].to_numpy(), "document_id": piece["document_id"].to_numpy(),
                    "nodes": [[{"s": x[0], "e": x[1], "kind": KINDS.index(x[2]), "key": x[4], "run": x[5]} for x in n] for n in nodes],
                    "u": [u[e - len(n) : e].ravel().tolist() for n, e in zip(nodes, ends)],
                    "said": [[{"key": k, "x": v} for k, v in d.items()] for d in said],
                })

    schema = "chunk_id string, document_id string, nodes array<struct<s:int,e:int,kind:int,key:string,run:int>>, u array<double>, said array<struct<key:string,x:double>>"
    first = checkpoint(texts.select("chunk_id", "document_id", "raw_text").mapInPandas(propose, schema))
    spoken = first.where("document_id is not null").select("chunk_id", "document_id", F.inline("said"))
    sums = spoken.groupBy("document_id", "key").agg(F.sum("x").alias("total"), F.count("*").alias("n")).where("n > 1")
    heard = spoken.join(sums, ["document_id", "key"]).groupBy("chunk_id").agg(F.collect_list(F.struct("key", (F.col("total") - F.col("x")).alias("x"))).alias("heard"))  # words of one text

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in range(0, len(batch), 2000):
                piece = batch.iloc[part : part + 2000]
                nodes = [[(x["s"], x["e"], KINDS[x["kind"]], None, x["key"], x["run"]) for x in n] for n in piece["nodes"]]
                u = np.concatenate([np.asarray(x, float) for x in piece["u"]]).reshape(-1, len(LABELS)) if len(piece) else np.zeros((0, len(LABELS)))
                far = [{x["key"]: x["x"] for x in h} if h is not None else {} for h in piece["heard"]]
                p, _ = settled(nodes, u, far)
                found, at = [], 0
                for n in nodes:
                    found.append([{"start_char": s, "end_char": e, "entity_type": label} for s, e, label in spans(n, p[at : at + len(n)])])
                    at += len(n)
                yield pd.DataFrame({"chunk_id": piece["chunk_id"].to_numpy(), "found": found})

    given = first.select("chunk_id", "nodes", "u").join(heard, "chunk_id", "left")
    return given.mapInPandas(decide, "chunk_id string, found array<struct<start_char:int,end_char:int,entity_type:string>>"), texts.select("chunk_id", "document_id", "raw_text")


def detect(chunks: DataFrame) -> DataFrame:
    """(chunk_id, entities array<struct<start_char, end_char, entity_type, text>>, masked_text), one row per chunk_id.

    A null or blank text has no entities and masks to itself. Of several texts under one chunk_id the smallest counts. Chunks
    of one document_id speak to each other; one without stands alone.
    """
    found, texts = find(chunks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            entities = [[{**x, "text": t[x["start_char"] : x["end_char"]]} for x in f] for t, f in zip(batch["raw_text"], batch["found"])]
            texts_ = [masked(t, [(x["start_char"], x["end_char"], x["entity_type"]) for x in f]) if t is not None else None for t, f in zip(batch["raw_text"], batch["found"])]
            yield pd.DataFrame({"chunk_id": batch["chunk_id"].to_numpy(), "entities": entities, "masked_text": texts_})

    schema = "chunk_id string, entities array<struct<start_char:int,end_char:int,entity_type:string,text:string>>, masked_text string"
    return texts.join(found, "chunk_id").select("chunk_id", "raw_text", "found").mapInPandas(run, schema)


def span_rows(found: DataFrame) -> DataFrame:
    return found.select("chunk_id", F.inline("found"))


def entity_rows(found: DataFrame) -> DataFrame:
    return found.select("chunk_id", F.explode("entities").alias("e")).select("chunk_id", "e.start_char", "e.end_char", "e.entity_type", "e.text")

"""Problem 1: broken prompt and response pairs.

Every defect has a handful of noisy labelling functions, each reading its own kind of evidence, that vote for, against or
not at all. A label model per defect, fitted by expectation-maximisation over the counts of vote patterns, learns how far
each function can be trusted and turns a pattern into a posterior. Defects planted in every whole answer anchor the model
(one half of the answers) and validate its cutoffs (the other half). A response gets every defect whose posterior exceeds
the cutoff of that defect. The language model is counted over all queries and responses.

Nothing is read from judge_error and judgment_status but one weak vote.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, reduce
from hashlib import blake2b
from itertools import accumulate
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archipel.session import checkpoint, ranked, release, spread

TOLERANCE = 0.03  # of F1 that a lower cutoff may cost
DEFECTS = ("empty", "truncated", "refusal", "copy", "other_language")
VOTES = (6, 7, 6, 6, 5)  # functions of each

# The fields of an answer, as keys and as spelt in line form, and what a judge is told to put in them.
FIELDS = ("relevance_score", "relevance_label", "contains_expected_information", "missing_information", "supporting_evidence", "rationale")
INSTRUCTIONS = (
    "irrelevant|related|highly_relevant|perfectly_relevant",
    "State what the chunk lacks, or leave blank.",
    "Quote from the chunk, or leave blank.",
    "Explain the score in one sentence.",
)
NOTHING = {"", "null", "none", "n a", "na", "nan", "nil", "undefined", "endoftext", "eos", "s", "json", "empty", "no response", "no output", "pad", "unk", "relevance score", "rationale", "score"}

# Frequent function words of languages written in Latin letters.
STOPWORDS = {
    "en": "the of and to in is that it was for on are as with be by this which or from not but what when why how did have has had an were at no only a i we you he she they its their my me do does can will would there here than then so if because since while about between both only never nothing any most every still though without score answer text chunk passage question",
    "fr": "le la les des du une un et est dans que qui pour pas sur au aux avec ne par ce cette sont mais ou elle il on y de en à se sans aucune toute toutes tout quand pourquoi été manque traite reste donc plus son sa ses note texte réponse question demande extrait",
    "de": "der die das und ist nicht ein eine einen einer den dem des im in mit auf für von zu sich aber auch wie wird wurde an er sie es kein keine fehlt jeder hier daher fast alles warum wann nennt grund ohne bewertung text frage antwort abschnitt",
    "es": "el la los las de que y en un una es por con para no se del al a lo pero su sus más como está están toda todo todos cuándo qué ninguna falta cualquier otro otra sin ni sobre casi nota puntuación texto pregunta respuesta fragmento pasaje motivo petición consulta",
    "pt": "o a os as de que e em um uma é por com para não se do da dos das no na nos nas mas ao à mais como está estão todas todos quase tudo nenhuma sem sobre nota trecho texto outra outro questão resposta falta pergunta motivo pedido",
    "it": "il lo la gli le di che e in un una è per con non si del della dei delle nel nella ma come più tutto tutte tutti quasi nessuna senza su al alla manca punteggio brano testo altra questione risposta domanda motivo richiesta",
    "nl": "de het een en van is dat niet in op met voor zijn er aan ook maar bij naar om uit geen wordt deze te als score tekst antwoord vraag fragment wel",
    "pl": "i w na z nie się że jest do to o jak ale po co tak za od przez oraz bez ocena tekst odpowiedź pytanie fragment brak",
    "sv": "och i att det som en på är av för med den till inte om ett men var från utan betyg texten svaret frågan saknas",
    "tr": "ve bir bu için ile de da olarak metin soru yanıt değil yok var çok daha ama puan",
}
# Spellings that tell one of these languages from its neighbours.
SPELLINGS = {
    "en": r"\w{3,}ing\b|\bth\w+|\w+'s\b",
    "fr": r"\b[ldnsjc]'|\bqu'|\w+(?:é|ée|és|ées|eux|aux|ait|aient|ère)\b|[êœ]|\w+ç",
    "de": r"[äüß]|\w+(?:ung|keit|heit|lich|isch|schen)\b|\bsch\w+",
    "es": r"ñ|\w+(?:ción|ciones|sión|dad|mente)\b|[¿¡]|\w+ó\b|\w+ía\b",
    "pt": r"[ãõ]|\w+(?:ção|ções|ência|ância|dade)\b|\w+nh\w+|\w+lh\w+",
    "it": r"\w+(?:zione|zioni|tà|ità)\b|\b(?:dell|nell|all|l|un|un)'|\b\w+gli\w*|\w+ò\b",
    "nl": r"\w*ij\w*|\w+aa\w+|\w+oo\w+|\w+heid\b",
    "pl": r"[łąęśćźż]",
    "sv": r"å|\w+ö\w+|\w+het\b",
    "tr": r"[ğış]|\w+lar\b|\w+ler\b",
}
SPELT = {lang: re.compile(pattern) for lang, pattern in SPELLINGS.items()}
STOP = {w: frozenset(lang for lang, words in STOPWORDS.items() if w in words.split()) for words_ in STOPWORDS.values() for w in words_.split()}

STOPS = {lang: frozenset(words.split()) for lang, words in STOPWORDS.items()}

SCRIPTS = (("ja", re.compile(r"[぀-ヿ]")), ("zh", re.compile(r"[一-鿿]")), ("ko", re.compile(r"[가-힯]")), ("ru", re.compile(r"[Ѐ-ӿ]")), ("el", re.compile(r"[Ͱ-Ͽ]")), ("ar", re.compile(r"[؀-ۿ]")), ("he", re.compile(r"[֐-׿]")), ("hi", re.compile(r"[ऀ-ॿ]")), ("th", re.compile(r"[฀-๿]")))
ANY_SCRIPT = re.compile("[" + "".join(script.pattern[1:-1] for _, script in SCRIPTS) + "]")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
LETTERS = bytes(c if chr(c).isalpha() and c < 128 else 32 for c in range(256))
QUOTED = re.compile(r"\"[^\"\n]{1,600}\"|“[^”]{1,600}”|«[^»]{1,600}»|„[^“”]{1,600}[“”]")
LINE = re.compile(r"^\s*[*#>-]*\s*([^\W\d_][\w ]{2,40}?)\s*[:：][ \t]*(.*)$", re.M)
FENCE = re.compile(r"```[a-zA-Z]*\s*")
MEMBER = re.compile(r'"(\w+)"\s*:\s*("(?:[^"\\]|\\.)*"?|[^,}\n]*)')
LEAD = re.compile(r"^\s*(?:sure|certainly|of course|okay|ok|here is (?:the|my) judg\w+|here you go)\s*[.:!,]?\s*", re.I)
BARE = re.compile(r"^\W*(?:[^\W\d_][\w ]{0,25}[:：=]?\s*)?[0-3](?:\s*/\s*3)?\W*$")
END = re.compile(r"[.!?。！？…][\"'”’»)\]]*$")

# Words of the first person in several languages.
PERSON = frozenset("i i'm i've i'd i'll my me we we're us our je j'ai nous ich wir yo nos io mi eu ik wij ja jag ben я мы".split())
# How inability, apology and speaking as a machine are put in several languages.
# a text with none of these words has no match unless it is in another script, and looking for words is much cheaper
INABLE_WORDS = frozenset("can cannot can't could couldn't won't will would prefer unable able decline declining refuse refusing pass comfortable appropriate permitted allowed possible position permit allow prohibit prohibits outside pas nicht puedo podemos posible posso possiamo grado consigo kan niet inte mogę".split())
INABLE = re.compile(
    r"\b(?:can ?not|can't|could not|couldn't|won't|will not|would rather not|prefer not|unable|not able|decline|declining|refuse|refusing|have to pass|not (?:be )?(?:comfortable|appropriate|permitted|allowed|possible|in a position)|isn't appropriate|do(?:es)?(?:n't| not) (?:feel comfortable|permit|allow)|prohibits?|outside (?:of )?(?:what|my|the scope))\b"
    r"|\bne (?:peux|suis|pouvons) pas\b|\brefuse\b|\b(?:kann|darf|können|dürfen|möchte)\b[^.]{0,60}\bnicht\b|\bno (?:puedo|podemos|me es posible)\b|\bnon (?:posso|possiamo|sono in grado)\b|\bnão (?:posso|consigo|podemos)\b|\bkan (?:ik )?niet\b|\bnie mogę\b|\bkan inte\b|не (?:могу|можем|в состоянии)|できません|お答えできない|致しかねます|无法|不能|할 수 없"
)
SORRY = re.compile(r"^\W*(?:i'?m (?:very |really |so )?sorry|i am (?:very |really |so )?sorry|sorry|i apologi[sz]e|(?:my |our )?apologies|unfortunately|regrettably|i regret|thank you|thanks|désolé|je (?:suis désolé|regrette)|malheureusement|lo siento|lamentablemente|es tut mir leid|tut mir leid|leider|entschuldigung|mi dispiace|purtroppo|desculpe|lamento|infelizmente|helaas|sorry|przepraszam|niestety|tyvärr|извините|к сожалению|申し訳|抱歉|죄송)")
MACHINE_WORDS = frozenset("ai artificial automated language machine assistant judge evaluator model my tant ki sprachmodell modelo ia inteligencia modello".split())
MACHINE = re.compile(r"\bas an? (?:ai|artificial|automated|language|machine|assistant|judge|evaluator)|\b(?:language model|automated (?:system|judge|assistant)|ai (?:model|assistant|system)|my (?:guidelines|policy|policies|instructions|programming|role))\b|\ben tant qu'|\bals (?:ki|sprachmodell)|\bcomo (?:modelo|ia|inteligencia)|\bcome (?:modello|ia)\b|言語モデル|языковая модель")
# Every apology and every offer has a word that holds one of these, so a text with none needs no closer look.
POLITE = re.compile(r"sorry|apolog|unfortunately|regret|thank|désolé|malheureusement|siento|lament|leid|entschuldigung|dispiace|purtroppo|desculpe|infelizmente|helaas|przepraszam|niestety|tyvärr|извините|сожалению|申し訳|抱歉|죄송|else|further|know")
OFFER = re.compile(r"\b(?:any|some)thing else\b|\bfurther (?:help|assistance)\b|\blet me know\b")


def words_of(text: str) -> list[str]:
    """All that WORD finds; in plain letters without apostrophes, blanks for all but letters do as well."""
    if text.isascii() and "'" not in text:
        return text.encode().translate(LETTERS).decode().split()
    return WORD.findall(text)


def parsed(text: str) -> dict:
    """The answer's parts: its form, whether it is whole in form, its fields, and its own words."""
    body = text.strip()
    if body[:1] != "{":
        body = led(body).strip()
    if "```" in body:
        if fence := FENCE.match(body):
            body = body[fence.end() :]
        body = led((body[:-3] if body.endswith("```") else body).strip())
    brace = body.find("{")
    if brace >= 0 and brace < 40:
        if "}" in body:
            try:
                value, _ = json.JSONDecoder(strict=False).raw_decode(body, brace)
                if isinstance(value, dict):
                    return {"form": "json", "whole": True, "fields": value, "body": body}
            except ValueError:
                pass
        return {"form": "json", "whole": False, "fields": {k: v.strip().strip('"') for k, v in MEMBER.findall(body)}, "body": body}
    if LINE.match(body):
        return {"form": "lines", "whole": True, "fields": {k.strip().lower().replace(" ", "_"): v.strip() for k, v in LINE.findall(body)}, "body": body}
    return {"form": "text", "whole": True, "fields": {}, "body": body}


def led(body: str) -> str:
    """A text without the words that lead up to an answer."""
    lead = LEAD.match(body)
    return body[lead.end() :] if lead else body


JUDGED = frozenset(("relevance_label", "supporting_evidence", "relevance_score", "contains_expected_information"))


def own_words(p: dict) -> str:
    """What the judge itself wrote: explanations without field names, labels, scores and quotations."""
    if p["form"] == "json":
        parts = [v for k, v in p["fields"].items() if isinstance(v, str) and k not in JUDGED]
    elif p["form"] == "lines":
        parts = [v for k, v in p["fields"].items() if not re.fullmatch(r"relevance_(?:score|label)|contains_expected_information|supporting_evidence|query|question|score|label|relevan\w+|pertinence|rilevanza|релевантность", k)]
    else:
        parts = [p["body"]]
    kept = [v for v in parts if (x := v.strip()) and x not in INSTRUCTIONS]
    return "\n".join([QUOTED.sub(" ", v) if '"' in v or "“" in v or "«" in v or "„" in v else v for v in kept])


def explanation(p: dict) -> str:
    """The text at whose end a broken-off answer shows."""
    if p["form"] == "text":
        return p["body"]
    if p["form"] == "lines":
        last = p["body"].strip().rsplit("\n", 1)[-1]
        m = LINE.match(last)
        return m[2] if m else last
    values = [v for v in p["fields"].values() if isinstance(v, str)]
    return values[-1] if values else ""


class Languages:
    """Evidence for each language: its function words, shared ones counting less, and, apart from them, its spellings; and how
    likely ``trigrams`` finds a word in it. Words are looked up once, a text's evidence is the sum of the rows of its words.
    The script of a language decides at once."""

    MEMO, PIECE = 200_000, 16_384  # words kept, words summed at once
    NAMES = tuple(STOPWORDS)
    WIDTH = 2 * len(NAMES)

    def __init__(self, trigrams: Trigrams | None = None) -> None:
        self.trigrams = trigrams or Trigrams()
        self.place: dict[str, int] = {}
        self.names: list[str] = []
        self.rows = np.zeros((1024, self.WIDTH + 1 + len(self.trigrams.langs)))
        self.edges = np.zeros((1024, 2), int)  # first and last letter

    def learn(self, w: str) -> None:
        """Adds the row of a word, or of the letters on both sides of a blank."""
        i = self.place[w] = len(self.place)
        self.names.append(w)
        if i >= len(self.rows):
            self.rows, self.edges = (np.concatenate([x, np.zeros_like(x)]) for x in (self.rows, self.edges))
        row, self.edges[i] = self.rows[i], (ord(w[0]), ord(w[-1]))
        row[:] = 0
        seam = " " in w
        if not seam:
            for part in {w, *w.split("'")}:
                for lang in STOP.get(part, ()):
                    row[self.NAMES.index(lang)] += 1 / len(STOP[part])
            for j, lang in enumerate(self.NAMES):
                row[len(self.NAMES) + j] = 0.5 * len(SPELT[lang].findall(w))
            row[self.WIDTH] = bool(POLITE.search(w))
        if self.trigrams.langs:
            row[self.WIDTH + 1 :] = self.trigrams.likely[[self.trigrams.place.get(w, -1)] if seam else self.trigrams.places(w)].sum(0)

    def places(self, words: list[str]) -> list[int]:
        """Rows of words; places given before are void."""
        if len(self.place) > self.MEMO:
            self.place.clear()
            self.names.clear()
        at = [*map(self.place.get, words)]
        if None in at:
            for w in words:
                if w not in self.place:
                    self.learn(w)
            at = [*map(self.place.get, words)]
        return at

    def sums(self, words: list[str]) -> list[float]:
        """Of function words by language, spellings by language, words of courtesy, and likelihood by language of the trigrams."""
        at = self.places(words)
        total = np.add.reduce(self.rows.take(at[: self.PIECE], 0), 0)
        for i in range(self.PIECE, len(at), self.PIECE):
            total += np.add.reduce(self.rows.take(at[i : i + self.PIECE], 0), 0)
        return total.tolist()

    def whole(self, words: list[str]) -> list[float]:
        """The sums with the trigrams about blanks."""
        return self.sums(words + [a[-1] + " " + b[0] for a, b in zip(words, words[1:])])

    @staticmethod
    def script(text: str, words: list[str]) -> str | None:
        if text.isascii() or not ANY_SCRIPT.search(text):
            return None
        letters = sum(map(len, words))
        return next((lang for lang, script in SCRIPTS if letters and len(script.findall(text)) > 0.3 * letters), None)

    def of(self, text: str, words: list[str]) -> str | None:
        script = self.script(text, words)
        if script or not words:
            return script
        sums, n = self.sums(words), len(self.NAMES)
        both = [a + b for a, b in zip(sums[:n], sums[n : 2 * n])]
        return self.NAMES[both.index(max(both))] if any(both) else None


def parts(response: str | None) -> tuple[dict, str, str, list[str]]:
    """The parsed answer, its own words as written and in small letters, and these one by one."""
    p = parsed(response or "")
    own = own_words(p)
    lower = own.lower().replace("’", "'")
    return p, own, lower, words_of(lower)


def overlap(answer: dict[str, int], have: dict[str, int]) -> float:
    """Share of the answer's words that a source has, each as often at most."""
    get = have.get
    return sum([min(n, get(w, 0)) for w, n in answer.items()]) / max(1, sum(answer.values()))


class Asked:
    """What a query and its expected information say, worked out once for all their responses."""

    def __init__(self, query: str, expected: str, languages: Languages) -> None:
        q, e = words_of(query.lower().replace("’", "'")), words_of(expected.lower().replace("’", "'"))
        self.q, self.e, self.n, self.m = " ".join(q), " ".join(e), len(q), len(q) + len(e)
        self.known = {*q, *e}
        self.query, self.expected, self.words = query, expected, q + e
        self.language = languages.of(f"{query} {expected}", q + e)
        self.copies: dict[int, str] = {}

    @cached_property
    def sources(self) -> list[Counter]:
        q, e = self.words[: self.n], self.words[self.n :]
        return [Counter(q * 3), Counter(q + e)]  # these hold what the query and the expected information hold alone

    @cached_property
    def twice(self) -> Counter:
        return Counter(self.words * 2)

    @cached_property
    def pairs(self) -> set[tuple[str, str]]:
        q, e = self.words[: self.n], self.words[self.n :]
        return {*zip(q, q[1:]), *zip(e, e[1:])}


SCAFFOLD = re.compile(r"(?im)^\s*(?:query|question|the question is|expected relevant information|retrieved chunk|chunk|expected information)\s*[:：]?\s*")
ASKS = re.compile(r"(?i)\s*(?:query|the question is|question|expected relevant information|retrieved chunk)\s*[:：]")
PROMPT = re.compile(r"(?i)expected relevant information:|retrieved chunk:|the question is:|^\s*query\s*:")
SCORE = re.compile(r"\s*\"?[0-3](?:\.0)?\s*\"?")
ANY_SCORE = re.compile(r"(?<![\d.,])[0-3](?:\.0)?(?:\s*/\s*3)?(?![\d.,]*\d)")
SENTENCE = re.compile(r"(?<=[.!?。！？])\s*|\n+")
LEVEL = {"irrelevant", "related", "highly relevant", "perfectly relevant"}
DANGLING = re.compile(r"(?:[,;:\-–—(/]|\b(?:the|a|an|of|and|or|to|in|is|that|with|for|but|not|which|as|by|le|la|les|de|du|des|et|un|une|der|die|das|und|den|el|los|las|y|que|il|di|che|o|os|e|it|its|also|this|these|their|because|since|was|were|are|only|what|than|into|from|at|on))\s*$")
GOES_ON = frozenset(",;:-–—(/")
CJK_END = re.compile(r"[぀-ヿ一-鿿。]")


class Trigrams:
    """How likely each language makes runs of three letters, from the counts of runs of texts whose function words give them
    away: the total of each language and its most common runs."""

    MOST, LEAST, KINDS = 4000, 200, 27_000  # runs kept, runs needed, runs there may be

    def __init__(self, totals: dict[str, int] | None = None, common: dict[str, dict[str, int]] | None = None) -> None:
        self.langs = sorted(lang for lang, n in (totals or {}).items() if n >= self.LEAST)
        self.place: dict[str, int] = {}
        for lang in self.langs:
            for run in common[lang]:
                self.place.setdefault(run, len(self.place))
        whole = np.array([totals[lang] + 0.5 * self.KINDS for lang in self.langs])
        counts = np.zeros((len(self.place) + 1, len(self.langs)))  # the last row is of runs that no language keeps
        for j, lang in enumerate(self.langs):
            for run, n in common[lang].items():
                counts[self.place[run], j] = n
        self.known, self.likely = counts > 0, np.log((counts + 0.5) / whole)

    @staticmethod
    def runs(text: str) -> Iterator[str]:
        t = f" {text} "
        return (t[i : i + 3] for i in range(len(t) - 2))

    def places(self, text: str) -> list[int]:
        get, rare = self.place.get, len(self.place)
        return [get(run, rare) for run in self.runs(text)]

    def unlike(self, text: str, home: str) -> bool:
        """Hardly any run of the text is known of ``home``."""
        at = self.places(text)
        return home in self.langs and self.known[at, self.langs.index(home)].sum() < 0.2 * len(at)

    def gains(self, text: str) -> dict[str, float]:
        """For every language by how much per run another one beats it; negative for the best."""
        return self.ahead(self.likely[self.places(text)].mean(0).tolist())

    def ahead(self, scores: list[float]) -> dict[str, float]:
        if len(self.langs) < 2:
            return {}
        first, second = sorted(scores, reverse=True)[:2]
        return {lang: (second if s == first else first) - s for lang, s in zip(self.langs, scores)}


def spoken(words: list[str], languages: Languages) -> str | None:
    """The language that the function words of a text clearly speak for."""
    if not words:
        return None
    stops = languages.sums(words)[: len(languages.NAMES)]
    second, first = sorted(stops)[-2:]
    return languages.NAMES[stops.index(first)] if first >= 2 + second else None


class Runs:
    """Counts of runs of three letters by language, from counts of words and of the letters on both sides of blanks."""

    def __init__(self) -> None:
        self.words: dict[str, Counter] = {}
        self.seams: dict[str, Counter] = {}

    def add(self, lang: str, words: list[str], times: int = 1) -> None:
        kinds, seams = self.words.setdefault(lang, Counter()), self.seams.setdefault(lang, Counter())
        between = [a[-1] + " " + b[0] for a, b in zip(words, words[1:])]
        if times == 1:
            kinds.update(words)
            seams.update(between)
        else:
            for x in words:
                kinds[x] += times
            for x in between:
                seams[x] += times

    def add_spoken(self, texts: list[list[str]], languages: Languages) -> None:
        """Adds every text under the language it is ``spoken`` in, if any, all at once."""
        texts = [words for words in texts if words]
        if not texts:
            return
        at = np.array(languages.places([w for words in texts for w in words]))
        long = np.array([*map(len, texts)])
        ends = long.cumsum()
        stops = np.add.reduceat(languages.rows.take(at, 0)[:, : len(languages.NAMES)], ends - long)
        second, first = np.partition(stops, -2, 1)[:, -2:].T
        lang = np.repeat(np.where(first >= 2 + second, stops.argmax(1), -1), long)
        goes_on = np.ones(len(at), bool)
        goes_on[ends - 1] = False
        seams = (languages.edges[at[:-1], 1] << 21 | languages.edges[at[1:], 0])[goes_on[:-1]]  # a letter has 21 bits
        for j in {*lang.tolist()} - {-1}:
            name = languages.NAMES[j]
            kinds, between = self.words.setdefault(name, Counter()), self.seams.setdefault(name, Counter())
            for i, n in zip(*(x.tolist() for x in np.unique(at[lang == j], return_counts=True))):
                kinds[languages.names[i]] += n
            for x, n in zip(*(x.tolist() for x in np.unique(seams[lang[:-1][goes_on[:-1]] == j], return_counts=True))):
                between[chr(x >> 21) + " " + chr(x & 0x1FFFFF)] += n

    def rows(self) -> Iterator[tuple[str, str, int]]:
        """The counts so far, which then begin anew."""
        for lang, kinds in self.words.items():
            counts = self.seams[lang]
            for w, n in kinds.items():
                for run in Trigrams.runs(w):
                    counts[run] += n
            yield from ((lang, run, n) for run, n in counts.items())
        self.words, self.seams = {}, {}


def unable(text: str, words: list[str]) -> bool:
    return not (INABLE_WORDS.isdisjoint(words) and (text.isascii() or not ANY_SCRIPT.search(text))) and bool(INABLE.search(text))


def machine(text: str, words: list[str]) -> bool:
    return not (MACHINE_WORDS.isdisjoint(words) and text.isascii()) and bool(MACHINE.search(text))


def declines(sentence: str) -> bool:
    """A sentence that declines or closes politely instead of saying something about the chunk."""
    words = words_of(sentence)
    return bool(unable(sentence, words) and not PERSON.isdisjoint(words) or SORRY.match(sentence) or machine(sentence, words) or OFFER.search(sentence))


# Versions of an empty answer and of one that declines, planted to learn how the functions vote on them.
EMPTY = ("", "...", "null", "{}", json.dumps({k: "" for k in FIELDS}))
SORRIES = ("I'm sorry, but I cannot help with this request.", "I am unable to provide an assessment of this.", "As an AI language model, I can't evaluate this content.", "Unfortunately, I won't be able to answer that.", "I must decline to respond.")
TEMPLATE = json.dumps(dict(zip(FIELDS, (0, INSTRUCTIONS[0], False, *INSTRUCTIONS[1:]))))
GIVEN = (lambda q, e: q, lambda q, e: e, lambda q, e: f"Query: {q}", lambda q, e: q.upper(), lambda q, e: TEMPLATE, lambda q, e: json.dumps({"relevance_score": 1, "rationale": e}))  # what a copy is a copy of
WHOLE = (".", "!", "?", '"', "}")


class Heard:
    """What a judge wrote, as the functions on language read it; worked out once for all the queries it is held against."""

    def __init__(self, p: dict, own: str, words: list[str], refusal: str, languages: Languages) -> None:
        self.p, self.own, self.words, self.refusal, self.languages = p, own, words, refusal, languages

    @cached_property
    def rest(self) -> tuple[list[str], str | None, list[float]] | None:
        """Words, script and evidence without the sentences that decline to answer, which are no answer in any language."""
        own, words = self.own, self.words
        sums = self.languages.whole(words)
        # a text in which nothing declines has no sentence that does
        if self.refusal[2] == "y" or self.refusal[0] == self.refusal[4] == "y" or sums[Languages.WIDTH]:
            rest = " ".join([x for x in SENTENCE.split(own) if not declines(x.lower().replace("’", "'"))])
            if len(rest) < len(own) - 4:
                own, words = rest, words_of(rest.lower().replace("’", "'"))
                if len(words) < 3 and own.isascii() or not words:
                    return None
                sums = self.languages.whole(words)
        return words, self.languages.script(own, words), sums

    @cached_property
    def gains(self) -> dict[str, float]:
        """By language, of the trigrams."""
        words, _, sums = self.rest
        n = len(" ".join(words))  # a run about every letter and blank
        return self.languages.trigrams.ahead([x / n for x in sums[Languages.WIDTH + 1 :]])


class Voter:
    """The labelling functions. Each reads its own kind of evidence and votes ``y`` for the defect, ``n`` against it, or ``0``
    not at all, whatever the others say; a defect's votes are a string. None rules a defect out: a response may have several.

    * empty: no letter or digit; fields all unfilled; words of the judge's own; a score or level anywhere; length; the error
    * truncated: form not closed; no end of a sentence; a last word that must go on; ``?`` until counted: a last word
      hardly seen elsewhere, two last words that hardly end a text; a missing explanation; the error
    * refusal: words of inability; an apology at the start; speaking as a machine; no score or level; first person; words that
      have nothing to do with what was asked
    * copy: contained in what was given or the reverse; share of words; share of pairs of words; the prompt's scaffold; the
      instructions; hardly a word of its own
    * other_language: function words; spellings; runs of three letters; script; words shared with what was asked
    """

    MEMO, BRIEF = 4096, 200  # queries and short answers kept, letters of a short answer

    def __init__(self, trigrams: Trigrams | None = None) -> None:
        self.trigrams = trigrams or Trigrams()
        self.languages = Languages(self.trigrams)
        self.asked: dict[tuple[str, str], Asked] = {}
        self.brief: dict[tuple[str, str | None], tuple] = {}
        self.empties = [self(x, "", "", None)[0]["empty"] for x in EMPTY]
        self.sorries = [(words := words_of(x.lower()), self.refusal(x.lower(), words, False, 0)[:-1]) for x in SORRIES]

    def about(self, query: str, expected: str) -> Asked:
        known = self.asked.get((query, expected))
        if known is None:
            if len(self.asked) >= self.MEMO:
                self.asked.clear()
            known = self.asked[query, expected] = Asked(query, expected, self.languages)
        return known

    def __call__(self, response: str | None, query: str | None, expected: str | None, error: str | None) -> tuple[dict[str, str], str, str, list[str], Heard]:
        """The votes, the last two words of the explanation, all its words, and what the judge wrote. Answers without words of
        the judge's own are often the same; what is said of them doesn't depend on the query."""
        known = self.brief.get((response, error))
        if known is None:
            p, own, lower, words = parts(response)
            known, alone = self.of_parts(p, own, lower, words, self.about(query or "", expected or ""), error)
            if alone and len(response or "") <= self.BRIEF:
                if len(self.brief) >= self.MEMO:
                    self.brief.clear()
                self.brief[response, error] = known
        return known

    def of_parts(self, p: dict, own: str, lower: str, words: list[str], asked: Asked, error: str | None) -> tuple[tuple, bool]:
        """What a call gives, and whether it would be the same for any query."""
        fields, body, form, whole = p["fields"], p["body"], p["form"], p["whole"]
        n = len(words)
        strings = [str(v).strip() for v in fields.values() if v is not None and not isinstance(v, bool)]
        scored = any(SCORE.fullmatch(v) or len(v) < 20 and v.lower().replace("_", " ") in LEVEL for v in strings) or form == "text" and len(body) < 400 and bool(ANY_SCORE.search(body))
        known = len([w for w in words if w in asked.known])
        said = self.said(p, own, words)
        end = explanation(p).rstrip()
        inner = words if end == own and "’" not in own else words_of(end.lower())
        before, last = (inner[-2] if len(inner) > 1 else "^", inner[-1]) if inner else ("^", "")
        refusal = self.refusal(lower, words, scored, known) if n else self.refusal(shown := body.lower().replace("’", "'"), words_of(shown), scored, 0)
        heard = Heard(p, own, words, refusal, self.languages)
        votes = {
            "empty": self.empty(body, form, whole, strings, words, scored, error),
            "truncated": self.truncated(body, form, whole, fields, end, inner, error),
            "refusal": refusal,
            "copy": self.copying(p, said, asked),
            "other_language": self.language(heard, known, asked),
        }
        return (votes, before, last, inner, heard), not n and len(said) < 4 and own.isascii()

    @staticmethod
    def empty(body: str, form: str, whole: bool, strings: list[str], words: list[str], scored: bool, error: str | None) -> str:
        flat = " ".join(re.findall(r"[^\W_]+", body.lower())) if len(body) < 80 else body
        nothing = not flat or flat in NOTHING or "<" in body and bool(re.fullmatch(r"\W*<[^<>]{1,30}>\W*", body))
        filled = any(v.lower() not in NOTHING and any(map(str.isalnum, v)) for v in strings)
        return (
            ("y" if nothing else "n")
            + ("0" if form == "text" or not whole else "n" if filled else "y")
            + ("n" if len(words) >= 3 else "y" if nothing or not words else "0")
            + ("n" if scored else "y")
            + ("y" if len(body) < 3 and not body.isdigit() else "n" if len(body) > 40 else "0")
            + ("y" if error and "empty" in error.lower() else "0")
        )

    @staticmethod
    def truncated(body: str, form: str, whole: bool, fields: dict, end: str, inner: list[str], error: str | None) -> str:
        enough = len(inner) >= 3
        closed = bool(END.search(end[-6:])) or bool(CJK_END.search(end[-1:]))
        dangling = (end[-1:].isalpha() or end[-1:] in GOES_ON) and bool(DANGLING.search(end[-14:].lower()))
        broken = form == "json" and not whole or form != "json" and body.count('"') % 2 == 1
        judged = "relevance_score" in fields or "relevance_label" in fields
        explained = "rationale" in fields
        open_ = "?" if inner and not closed and (enough or broken or form == "lines") else "0"
        return (
            ("y" if broken else "n" if form == "json" else "0")
            + ("y" if not closed and (enough or broken) else "n" if closed and not broken else "0")
            + ("y" if inner and dangling else "0")
            + open_
            + open_
            + ("y" if form == "lines" and len(fields) >= 2 and judged and not explained else "0")
            + ("y" if error and ("ntermin" in error or "incomplete" in error) else "0")
        )

    @staticmethod
    def refusal(speech: str, words: list[str], scored: bool, known: int) -> str:
        return (
            ("y" if unable(speech, words) else "n")
            + ("y" if SORRY.match(speech) else "0")
            + ("y" if machine(speech, words) else "0")
            + ("n" if scored else "y")
            + ("n" if PERSON.isdisjoint(words) else "y")
            + Voter.strange(words, known)
        )

    @staticmethod
    def strange(words: list[str], known: int) -> str:
        return "0" if len(words) < 3 else "y" if known < 0.35 * len(words) else "n" if known > 0.55 * len(words) else "0"

    @staticmethod
    def said(p: dict, own: str, words: list[str]) -> list[str]:
        """The words that may be a copy."""
        explained, body = p["fields"].get("rationale"), p["body"]
        if isinstance(explained, str):
            if explained.strip() in INSTRUCTIONS:
                return []
            return words if explained == own else words_of(explained.lower().replace("’", "'"))
        if p["form"] == "text" or ASKS.match(body):
            return words_of(SCAFFOLD.sub(" ", body).lower().replace("’", "'"))
        return words

    @staticmethod
    def copying(p: dict, said: list[str], asked: Asked) -> str:
        fields, body = p["fields"], p["body"]
        explained = fields.get("rationale") if isinstance(fields.get("rationale"), str) else None
        told = len([v for v in fields.values() if isinstance(v, str) and v.strip() in INSTRUCTIONS])
        prompt = ("uery" in body or "QUERY" in body or "uestion is" in body or "hunk:" in body or "nformation:" in body) and bool(PROMPT.search(body))
        n = len(said)
        marks = ("y" if prompt else "0") + ("y" if told >= 2 and (explained is None or explained.strip() in INSTRUCTIONS) else "n" if fields and not told else "0")
        if n < 4:
            return "000" + marks + "0"
        fresh = n - len([w for w in said if w in asked.known])
        if fresh > 0.5 * n or fresh > 2 and 5 * (n - fresh) < 3 * (n - 1):  # most words are its own, or too many for any share below
            return "nnn" + marks + "n"
        joined, counts = " ".join(said), Counter(said)
        contained = joined in asked.q or joined in asked.e or bool(asked.q and asked.q in joined or asked.e and asked.e in joined) and overlap(counts, asked.twice) >= 0.8
        share = max([overlap(counts, c) for c in asked.sources]) if 10 * (n - fresh) >= 7 * n else 0.0  # no share is larger than that of known words
        pairs = sum(map(asked.pairs.__contains__, zip(said, said[1:]))) / (n - 1)
        return ("y" if contained else "n") + ("y" if share >= 0.85 else "n" if share < 0.7 else "0") + ("y" if pairs >= 0.8 else "n" if pairs < 0.6 else "0") + marks + ("y" if fresh <= 0.1 * n else "n" if fresh > 0.25 * n else "0")

    def language(self, heard: Heard, known: int, asked: Asked) -> str:
        own, words, home = heard.own, heard.words, asked.language
        n = len(words)
        if not home or n < 3 and own.isascii() or not n:
            return "00000"
        shared = "y" if known <= 0.1 * n else "n" if known >= 0.3 * n else "0"
        stops_of_home = STOPS[home] if home in STOPS else frozenset()
        if n >= 5 and len([w for w in words if w in stops_of_home]) >= 0.4 * n:  # plainly the language asked in: the costlier functions have nothing to add
            return "n000" + shared
        if heard.rest is None:
            return "00000"
        words, script, sums = heard.rest
        if script:
            other, fitting = script != home, not stops_of_home.isdisjoint(words)
            return ("n" if fitting else "y" if other else "0") + "0" + (("y" if self.trigrams.unlike(" ".join(words), home) else "n") if other else "0") + ("y" if other else "n") + shared
        k = len(Languages.NAMES)
        at = Languages.NAMES.index(home) if home in STOPS else None

        def vote(got: list[float], least: float = 1.0) -> str:
            best, here = max(got), 0.0 if at is None else got[at]
            return "0" if not best else "n" if here >= best - 1e-9 else "y" if best - here >= least else "0"

        gain = heard.gains.get(home, 0.0) if len(words) >= 3 else 0.0
        return vote(sums[:k]) + vote(sums[k : 2 * k]) + ("y" if gain > 0.3 else "n" if gain < -0.3 else "0") + "0" + shared

    def planted(self, response: str, heard: Heard, asked: Asked, other: Asked | None, draw: int) -> Iterator[tuple[str, str, str, str]]:
        """(defect, pattern, last two words of a pattern that waits for counts) of defective versions of a whole answer:
        blanked, declined, replaced by what was given, cut off as a whole or within its explanation, and put to another
        query in another language. ``draw`` chooses among versions."""

        def drawn(n: int) -> int:
            nonlocal draw
            draw, x = divmod(draw, n)
            return x

        yield "empty", self.empties[drawn(len(EMPTY))], "", ""
        sorry, marks = self.sorries[drawn(len(SORRIES))]
        yield "refusal", marks + self.strange(sorry, len([w for w in sorry if w in asked.known])), "", ""
        version = drawn(len(GIVEN))
        if version not in asked.copies:
            as_read, own, _, words = parts(GIVEN[version](asked.query, asked.expected))
            asked.copies[version] = self.copying(as_read, self.said(as_read, own, words), asked)
        yield "copy", asked.copies[version], "", ""
        p = heard.p
        told = p["fields"].get("rationale")
        if p["form"] == "json" and p["whole"] and isinstance(told, str) and len(told) > 30 and drawn(2):
            broken = p | {"fields": p["fields"] | {"rationale": told[: 8 + drawn(len(told) - 11)]}}
        else:
            broken = parsed(response[: 40 + drawn(len(response) - 43)])
        end = explanation(broken).rstrip()
        inner = words_of(end.lower())
        votes = self.truncated(broken["body"], broken["form"], broken["whole"], broken["fields"], end, inner, None)
        yield "truncated", votes, *((inner[-2] if len(inner) > 1 else "^", inner[-1]) if "?" in votes else ("", ""))
        if other:
            yield "other_language", self.language(heard, len([w for w in heard.words if w in other.known]), other), "", ""


PAIRS = 20  # uses of two words from which their place in a text says something


def settle(cut, ends, inside, known) -> F.Column:
    """Fills the open votes of a possibly broken-off answer from the counts of its last words: a word that stands nowhere
    inside a text, and, of a known word, two words that go on nearly always or often end a text that is surely whole."""
    new = F.coalesce(known, F.lit(0)) < 2
    total = F.coalesce(ends + inside, F.lit(0))
    pair = F.when(new | (total < PAIRS), "0").when(ends < 0.02 * total, "y").when(ends >= 0.2 * total, "n").otherwise("0")
    return F.concat(F.substring(cut, 1, 3), F.when(new, "y").otherwise("0"), pair, F.substring(cut, 6, 2))


KINDS = 200_000  # words and queries that a task counts before it hands the counts on


def learnt(rows: DataFrame) -> tuple[Trigrams, DataFrame]:
    """The language model, from all queries and responses, each under the language its function words clearly speak for; and
    (query, expected, other_query, other_expected): what was asked, each beside another in another language, if any."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        languages, runs, asked = Languages(), Runs(), Counter()

        def counted() -> pd.DataFrame:
            out = [(*x, None, None) for x in runs.rows()] + [(None, None, n, *x) for x, n in asked.items()]
            asked.clear()
            return pd.DataFrame(out, columns=["language", "run", "n", "query", "expected"])

        for batch in batches:
            asked.update(zip(batch["query"].tolist(), batch["expected"].tolist()))
            texts, n = [], 0
            for response in batch["response"].tolist():
                words = parts(response)[3]
                if len(words) > Languages.PIECE:
                    if lang := spoken(words, languages):
                        runs.add(lang, words)
                    continue
                texts.append(words)
                n += len(words)
                if n > Languages.PIECE:
                    runs.add_spoken(texts, languages)
                    texts, n = [], 0
            runs.add_spoken(texts, languages)
            if len(asked) + sum(map(len, runs.words.values())) > KINDS:
                yield counted()
        yield counted()

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        languages, columns = Languages(), ["query", "expected", "home", "language", "run", "n"]
        for batch in batches:
            runs, out = Runs(), []
            for query, expected, n in zip(batch["query"], batch["expected"], batch["n"]):
                asked = Asked(query, expected, languages)
                words = asked.words
                out.append((query, expected, asked.language, None, None, 0))
                lang = spoken(words, languages)
                if lang:
                    runs.add(lang, words, n)
            yield pd.DataFrame(out + [(None, None, None, *x) for x in runs.rows()], columns=columns)

    told = checkpoint(rows.mapInPandas(count, "language string, run string, n bigint, query string, expected string"))
    pairs = spread(told.where("run is null").groupBy("query", "expected").agg(F.sum("n").alias("n")), "query", "expected")
    pairs = checkpoint(pairs.mapInPandas(ask, "query string, expected string, home string, language string, run string, n bigint"))
    counts = told.select("language", "run", "n").union(pairs.select("language", "run", "n")).where("run is not null")
    counts = counts.groupBy("language", "run").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("language")
    counts = counts.withColumn("total", F.sum("n").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "run"))).where(F.col("r") <= Trigrams.MOST)
    totals: dict[str, int] = {}
    common: dict[str, dict[str, int]] = {}
    for r in sorted(counts.collect(), key=lambda r: (r["language"], r["r"])):  # at most MOST rows a language
        totals[r["language"]] = r["total"]
        common.setdefault(r["language"], {})[r["run"]] = r["n"]
    return Trigrams(totals, common), checkpoint(others(pairs.where("run is null").select("query", "expected", "home")))


def others(pairs: DataFrame) -> DataFrame:
    """Beside each pair one drawn by a hash from those in other languages, all of which are numbered language by language."""
    held = {r["home"]: r["n"] for r in pairs.where("home is not null").groupBy("home").agg(F.count("*").alias("n")).collect()}
    total, begin, rows = sum(held.values()), 0, []
    for home, n in sorted(held.items()):
        rows.append((home, begin, n))
        begin += n
    spans = pairs.sparkSession.createDataFrame(rows, "home string, begin bigint, held bigint")
    die = F.xxhash64("query", "expected")
    numbered = ranked(pairs.where("home is not null").join(F.broadcast(spans), "home"), ["home"], die / F.lit(2.0**64) + 0.5, "query", "expected")
    numbered = checkpoint(numbered.withColumn("i", F.col("begin") + F.col("_rank") - 1))
    apart = F.lit(total) - F.col("held")
    aim = F.when(apart > 0, (F.col("begin") + F.col("held") + F.pmod(F.xxhash64(F.lit(1), "query", "expected"), apart)) % F.lit(total))
    drawn = numbered.select("i", F.col("query").alias("other_query"), F.col("expected").alias("other_expected"))
    return numbered.select("query", "expected", aim.alias("i")).where("i is not null").join(drawn, "i").drop("i")


def patterns(judgments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(record_id and for every defect its vote pattern as a string), and (defect_type, pattern, half, n) of planted defects.

    One pass over the responses counts the language model. A second votes, plants defects, votes on them and counts words:
    how often two words end an explanation and how often they go on, how often a word stands inside one. A last, narrow
    step settles the votes that wait for these counts.
    """
    rows = judgments.where("record_id is not null").select("record_id", F.col("raw_judge_response").alias("response"), F.coalesce("query", F.lit("")).alias("query"), F.coalesce("expected_relevant_information", F.lit("")).alias("expected"), F.col("judge_error").alias("error"))
    rows = spread(rows, "record_id").dropDuplicates(["record_id", "response", "query", "expected"])
    trigrams, apart = learnt(rows.select("response", "query", "expected"))
    rows = rows.join(apart, ["query", "expected"], "left")
    release(judgments.sparkSession)

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voter = Voter(trigrams)
        ends: dict[tuple[str, str], int] = {}
        inside: Counter = Counter()
        known: dict[str, int] = {}
        cases: Counter = Counter()
        waited: set[tuple[str, str]] = set()  # last two words of which counts are needed

        def frame(n: int, **columns: list) -> pd.DataFrame:
            return pd.DataFrame({c: columns.get(c, 0 if c in "eikw" else [None] * n) for c in ("record_id", "before", "last", "e", "i", "k", "w", "half", "planted", "votes")}, index=range(n)).astype({"record_id": "Int64", "half": "Int64"})

        def planted() -> pd.DataFrame:
            kinds = [*cases]
            out = frame(len(kinds), before=[x[2] for x, _ in kinds], last=[x[3] for x, _ in kinds], e=[*cases.values()], half=[h for _, h in kinds], planted=[x[0] for x, _ in kinds], votes=[x[1] for x, _ in kinds])
            cases.clear()
            return out

        def counted() -> Iterator[pd.DataFrame]:
            for (_, w), m in inside.items():
                known[w] = known.get(w, 0) + m
            pairs = [*{**inside, **ends, **dict.fromkeys(waited)}]
            yield frame(len(pairs), before=[a for a, _ in pairs], last=[b for _, b in pairs], e=[ends.get(x, 0) for x in pairs], i=[inside[x] for x in pairs], w=[x in waited for x in pairs])
            lasts = {b for _, b in waited}
            words = [*{**known, **dict.fromkeys(lasts)}]
            yield frame(len(words), last=words, k=[known.get(x, 0) for x in words], w=[x in lasts for x in words])
            ends.clear(), inside.clear(), known.clear(), waited.clear()

        for batch in batches:
            records, befores, lasts, votes = [], [], [], []
            for record, response, query, expected, error, other_query, other_expected in zip(*(batch[c].tolist() for c in ("record_id", "response", "query", "expected", "error", "other_query", "other_expected"))):
                o, before, last, words, heard = voter(response, query, expected, error)
                cut = o["truncated"]
                waits = "?" in cut
                records.append(record)
                if waits:
                    waited.add((before, last))
                befores.append(before if waits else None)
                lasts.append(last if waits else None)
                votes.append("".join(o.values()))
                if last:
                    inside.update(zip(["^", *words], words[:-1]))
                    if cut[1] == "n":  # an end that is surely one, and a last word that is surely whole
                        ends[before, last] = ends.get((before, last), 0) + 1
                        known[last] = known.get(last, 0) + 1
                if isinstance(response, str) and len(response) > 60 and response.rstrip().endswith(WHOLE):
                    draw = int.from_bytes(blake2b(str(record).encode(), digest_size=16).digest())
                    half = draw & 1
                    for case in voter.planted(response, heard, voter.about(query, expected), voter.about(other_query, other_expected) if isinstance(other_query, str) else None, draw >> 1):
                        cases[case, half] += 1
                        if case[3]:
                            waited.add(case[2:])
            yield frame(len(records), record_id=records, before=befores, last=lasts, votes=votes)
            if len(inside) + len(waited) > KINDS:
                yield from counted()
            if len(cases) > KINDS:
                yield planted()
        if inside or ends or waited:
            yield from counted()
        if cases:
            yield planted()

    voted = checkpoint(rows.mapInPandas(vote, "record_id bigint, before string, last string, e bigint, i bigint, k bigint, w int, half bigint, planted string, votes string"))
    del rows
    release(judgments.sparkSession)
    seen = voted.where("votes is null").groupBy("before", "last").agg(*(F.sum(c).alias(c) for c in "eik"), F.max("w").alias("w")).where("w > 0")
    seen = checkpoint(seen.drop("w"))
    ending = seen.where("before is not null").select("before", "last", F.col("e").alias("ends"), F.col("i").alias("insides"))
    known = seen.where("before is null").select("last", F.col("k").alias("known"))
    cases = voted.where("planted is not null").groupBy("before", "last", "half", F.col("planted").alias("defect_type"), F.col("votes").alias("truncated")).agg(F.sum("e").alias("n"))
    begins = dict(zip(DEFECTS, accumulate(VOTES, initial=1)))
    voted = voted.where("record_id is not null").select("record_id", "before", "last", *(F.substring("votes", begins[d], n).alias(d) for d, n in zip(DEFECTS, VOTES)))
    open_ = "truncated rlike '[?]'"
    filled = F.when(F.expr(open_), settle(F.col("truncated"), F.col("ends"), F.col("insides"), F.col("known"))).otherwise(F.col("truncated"))
    settled = lambda df: df.join(ending, ["before", "last"], "left").join(known, "last", "left").withColumn("truncated", filled)
    out = voted.where(f"not {open_}").select("record_id", *DEFECTS).union(settled(voted.where(open_)).select("record_id", *DEFECTS))
    return out, settled(cases).groupBy("defect_type", F.col("truncated").alias("pattern"), "half").agg(F.sum("n").alias("n"))


FALSE, TRUE = 0.03, 0.8  # chance of a vote for the defect, of those that vote, on fine and on defective records, at the start
PULL_FINE, PULL_DEFECT = 0.01, 0.3  # weight of the start against the records, on fine and on defective ones


def label_model(counts: dict[str, float], cases: list[str] | dict[str, int] | None = None, iterations: int = 60) -> dict[str, float]:
    """Posterior of the defect for each pattern: a two-class model with independent functions, fitted by EM. A function that
    does not vote says nothing, so a class can't form about silence.

    It starts from functions that are mostly right and a rare defect. How functions vote on the defect is held near their
    votes on ``cases``, patterns (or their counts) of records known to have it, as far as there are any; how they vote on fine records is learnt.
    """
    names = list(counts)
    if not names:
        return {}
    n = np.array([counts[x] for x in names], float)
    yes, no = (np.array([[c == want for c in x] for x in names], float) for want in "yn")
    width = yes.shape[1]
    start = np.stack([np.full(width, FALSE), np.full(width, TRUE)])
    if cases:
        often = Counter(cases)
        seen, times = np.array([[c for c in x] for x in often]), np.array([*often.values()], float)
        start[1] = (times @ (seen == "y") + 10 * TRUE) / (times @ (seen != "0") + 10)
    table, prior = start.copy(), 0.03
    weight = (PULL_FINE * n.sum() + 1, (PULL_DEFECT if cases else PULL_FINE) * n.sum() + 1)
    post = np.zeros(len(n))
    for _ in range(iterations):
        like = [yes @ np.log(t) + no @ np.log(1 - t) for t in table]
        post = 1 / (1 + np.exp(-np.clip(like[1] - like[0] + np.log(prior / (1 - prior)), -60, 60)))
        prior = float(np.clip((n @ post + 1) / (n.sum() + 30), 1e-5, 0.5))
        for c, r in ((0, n * (1 - post)), (1, n * post)):
            table[c] = np.clip((r @ yes + weight[c] * start[c]) / (r @ (yes + no) + weight[c]), 1e-4, 1 - 1e-4)
    return dict(zip(names, post.tolist()))


def cutoff(posterior: dict[str, float], counts: dict[str, float], cases: list[str] | dict[str, int]) -> tuple[float, float, float]:
    """The lowest cutoff with almost the best F1 on planted cases, and its recall and precision there. Recall is the share of the cases at
    or above it; precision follows from that, the share of all records there and how many the model thinks defective."""
    names = [x for x in counts if x in posterior]
    p, n = np.array([posterior[x] for x in names]), np.array([counts[x] for x in names], float)
    if not len(p) or n @ p < 1e-9:
        return 0.5, 0.0, 0.0
    true = n @ p
    often = {x: k for x, k in Counter(cases).items() if x in posterior}
    known, times = np.array([posterior[x] for x in often]), np.array([*often.values()], float)
    tried = []
    for c in np.unique(np.clip(np.append(p, known), 0.3, 0.8)):
        taken = n[p >= c].sum()
        recall = float(times[known >= c].sum() / times.sum()) if times.sum() >= 20 else float(n[p >= c] @ p[p >= c] / true)
        precision = min(1.0, float(n[p >= c] @ p[p >= c]) / taken) if taken else 0.0
        f1 = 2 * recall * precision / (recall + precision) if recall + precision else 0.0
        tried.append((f1, float(c), recall, precision))
    least = max(tried)[0] - TOLERANCE
    return min((x for x in tried if x[0] >= least), key=lambda x: x[1])[1:]


def majority(pattern: str) -> bool:
    """What the functions say without a model: more votes for than against."""
    return pattern.count("y") > pattern.count("n")


def defects(judgments: DataFrame, iterations: int = 60) -> DataFrame:
    """(record_id, defect_type, posterior, cutoff), one row per defect of a record; a record may have several.

    A null response is an empty one. A repeated row counts once. A missing query or expected information only silences
    the functions that need it. An empty table gives no rows.
    """
    found, cases = patterns(judgments)
    voted = checkpoint(found)
    long = lambda df, *columns: df.select(*columns, F.explode(F.array(*[F.struct(F.lit(d).alias("defect_type"), F.col(d).alias("pattern")) for d in DEFECTS])).alias("x")).select(*columns, "x.*")
    table = long(voted.groupBy(*DEFECTS).agg(F.count("*").alias("n")), "n").groupBy("defect_type", "pattern").agg(F.sum("n").alias("n")).toPandas()  # at most 3^7 rows a defect
    rows = []
    planted = cases.toPandas()  # at most 3^7 rows a defect and half
    for d, g in table.groupby("defect_type"):
        counts = g.set_index("pattern")["n"].to_dict()
        # the planted cases of one half of the answers fit the model, the others validate its cutoff
        fit, check = (x.set_index("pattern")["n"].to_dict() for x in (planted[(planted["defect_type"] == d) & (planted["half"] == h)] for h in (0, 1)))
        posterior = label_model(counts | {x: 0.0 for x in check if x not in counts}, fit, iterations)
        at, _, _ = cutoff(posterior, counts, check)
        rows += [(d, x, posterior[x], at) for x in counts if posterior[x] >= at]
    spark = judgments.sparkSession
    flagged = spark.createDataFrame(rows, "defect_type string, pattern string, posterior double, cutoff double")
    some = reduce(or_, [F.col(d).isin([x for of, x, *_ in rows if of == d]) for d in DEFECTS])
    return long(voted.where(some), "record_id").join(F.broadcast(flagged), ["defect_type", "pattern"]).select("record_id", "defect_type", "posterior", "cutoff").dropDuplicates(["record_id", "defect_type"])

"""Problem 5: variant spellings of names typed by people.

A trie join links the distinct words of the mentions with the words of the entities' names: names are sharded into
tries, a mention's word visits the tries its edits can reach, and its Levenshtein automaton, which counts swapped
neighbours as one edit, enumerates all words within the bound. Words under four letters have no edits to spare and
join where they are equal. Candidate pairs of mention and entity are then checked word by word over the orders in which
the words can stand: titles and remarks are set aside, and every other word must be a spelling, a nickname, an
abbreviation or an initial of a word of the name. Acronyms join on equality. Where a mention fits several entities
equally well, the one that clearly most of the unequivocal mentions mean is taken, else none.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archipel.llm.automata import Trie, edit_distance
from archipel.session import checkpoint, slots, spread

MOST_EDITS, SHARD_KEYS, SHARD_WORDS, LONGEST, CLEAR_SHARE = 2, 50_000, 100_000, 64, 0.6

# Short forms of given names.
NICKNAMES = """
alexander alex al sandy sasha xander
alexandra alex sandra lexi lexie sandy sasha alexa
andrew andy drew
anthony tony
barbara barb babs
benjamin ben benny
catherine cathy kate katie kit kitty cat
charles charlie chuck
christina chris tina chrissy
christopher chris kit topher kris
daniel dan danny
david dave davy
deborah deb debbie
dorothy dot dottie dolly dora thea
edward ed eddie ted ned
eleanor ellie nell nora
elizabeth liz beth betty eliza lizzie bess libby betsy elsie lisa
frances fran frankie
francis frank
frederick fred freddie freddy fritz rick
gabrielle gaby gabby gabi elle brie
george georgie
gregory greg
harold harry hal
henrietta etta hettie hattie hetty henny ettie
henry harry hank hal
ignatius nacho iggy nate ignaz
isabella bella izzy
jacob jake
james jim jimmy jamie
jennifer jen jenny
john jack johnny
jonathan jon jonny
joseph joe joey
josephine jo josie posy fina jojo
joshua josh
judith judy
katherine kate kathy katie kit kitty kat kay
kenneth ken kenny
lawrence larry laurie lars lorry
leonard leo len lenny
margaret maggie meg peggy marge margie madge greta daisy rita
martha marty patty
matthew matt
michael mike mick mickey
nathaniel nate nat nathan natty
nicholas nick nicky
oliver oli ollie olly noll
pamela pam
patricia pat patty tricia trish
patrick pat paddy rick
peter pete
philip phil pip
rebecca becky becca
richard dick rick rich richie ricky dickie
robert bob rob bobby robbie bert robin
ronald ron ronnie
samuel sam sammy
stephen steve
susan sue susie
theodore ted theo teddy dore
theresa terry tess tessa
thomas tom tommy
timothy tim
ursula ursie uschi ula sula ursa
victoria vicky vic tori vicki vickie
vincent vince
virginia ginny
walter walt wally
william bill will billy liam willy willie
yolanda yola yoli lana landa
zachary zach zack zak
"""
SHORT = {}
for _line in NICKNAMES.strip().splitlines():
    _full, *_short = _line.split()
    for _s in _short:
        SHORT.setdefault(_s, set()).add(_full)
LONG: dict[str, set] = {}
for _s, _fulls in SHORT.items():
    for _full in _fulls:
        LONG.setdefault(_full, set()).add(_s)

# Abbreviations of words in names of organisations that are not beginnings of the word.
ABBREVIATIONS = {"assn": "association", "assoc": "association", "intl": "international", "natl": "national", "dept": "department", "mfg": "manufacturing", "ltd": "limited", "grp": "group", "bdcst": "broadcasting", "bcast": "broadcasting", "hosp": "hospital", "lab": "laboratory", "labs": "laboratory", "svc": "service", "ntwk": "network", "netwk": "network", "shpg": "shipping", "agric": "agriculture", "cty": "county", "govt": "government", "mgmt": "management", "bros": "brothers"}

NOISE = {"mr", "mrs", "ms", "miss", "mx", "dr", "prof", "professor", "doctor", "sen", "senator", "rep", "representative", "judge", "justice", "gov", "governor", "capt", "captain", "sgt", "lt", "col", "gen", "rev", "reverend", "sir", "dame", "lord", "lady", "hon", "president", "secretary", "chairman", "jr", "sr", "ii", "iii", "iv", "phd", "md", "esq", "guest", "host", "anchor", "speaker", "caller", "reporter", "the"}
LINKING = {"of", "at", "and", "for", "in", "de", "du", "von", "van", "und"}


def words_of(text: str) -> list[str]:
    """Lower-case words of a name as typed: words run together are cut where a capital follows a small letter."""
    flat = "".join(ch for ch in ud.normalize("NFKD", text) if not ud.combining(ch)).replace("’", "'")
    flat = re.sub(r"'s\b", "", flat, flags=re.I)
    out = []
    for token in re.findall(r"[^\W_]+", re.sub(r"(?<=[^\W\d_])'(?=[^\W\d_])", "", flat)):
        upper = sum(ch.isupper() for ch in token)
        if upper < 0.6 * len(token) and re.fullmatch(r"[A-Z][a-z]*(?:[A-Z][a-z]+)+", token):
            out += re.findall(r"[A-Z][a-z]*", token)
        else:
            out.append(token)
    return [w.lower() for w in out]


def content(words: list[str]) -> list[str]:
    return [w for w in words if w not in NOISE and w not in LINKING]


def acronym(words: list[str]) -> str | None:
    """The letters of a mention that is nothing but an acronym."""
    if len(words) == 1 and 3 <= len(words[0]) <= 6:
        return words[0]
    if len(words) >= 3 and all(len(w) == 1 for w in words):
        return "".join(words)
    return None


def reach(length: int) -> int:
    """Edits allowed in a word of this length."""
    return 0 if length < 4 else 1 if length < 6 else 2


def spelt(typed: str, meant: str) -> int | None:
    """Edits between two words, none if they are more than words of these lengths may have."""
    if typed == meant:
        return 0
    most = min(reach(len(meant)), reach(len(typed) + 1))
    d = edit_distance(typed, meant, most) if most else 1
    return d if d <= most else None


def word_cost(typed: str, meant: str, person: bool) -> float | None:
    """Cost of ``typed`` standing for the word ``meant``, none if it can't."""
    if typed == meant:
        return 0.0
    if person:
        if meant in SHORT.get(typed, ()):
            return 0.3
        if len(typed) >= 4 and any(len(short) >= 4 and edit_distance(typed, short, 1) == 1 for short in LONG.get(meant, ())):
            return 1.3
    elif ABBREVIATIONS.get(typed) == meant or len(typed) >= 2 and meant.startswith(typed) and len(typed) < len(meant):
        return 0.3
    d = spelt(typed, meant)
    if d is not None:
        return float(d)
    if not person and any(full == meant and len(short) >= 4 and edit_distance(typed, short, 1) == 1 for short, full in ABBREVIATIONS.items()):
        return 1.3
    return None


def cheapest_order(table: list[list[float | None]]) -> list[int] | None:
    """The columns that rows take, all different, at the least sum: the best of all orders, found by augmenting paths
    instead of trying every one. None if there is no order."""
    rows, cols = len(table), len(table[0]) if table else 0
    if rows > cols or any(all(c is None for c in row) for row in table):
        return None
    never = 1e6
    u, v, owner, way = [0.0] * (rows + 1), [0.0] * (cols + 1), [0] * (cols + 1), [0] * (cols + 1)
    for i in range(1, rows + 1):
        owner[0], j = i, 0
        least, used = [float("inf")] * (cols + 1), [False] * (cols + 1)
        while True:
            used[j] = True
            row, delta, nxt = owner[j], float("inf"), 0
            for k in range(1, cols + 1):
                if not used[k]:
                    c = table[row - 1][k - 1]
                    x = (never if c is None else c) - u[row] - v[k]
                    if x < least[k]:
                        least[k], way[k] = x, j
                    if least[k] < delta:
                        delta, nxt = least[k], k
            for k in range(cols + 1):
                if used[k]:
                    u[owner[k]] += delta
                    v[k] -= delta
                else:
                    least[k] -= delta
            j = nxt
            if not owner[j]:
                break
        while j:
            owner[j], j = owner[way[j]], way[j]
    taken = [0] * rows
    for k in range(1, cols + 1):
        if owner[k]:
            taken[owner[k] - 1] = k - 1
    return taken if all(table[i][k] is not None for i, k in enumerate(taken)) else None


def person_cost(typed: list[str], name: list[str]) -> float | None:
    """Cost of a mention for a person: over all orders, one word is the surname and every other is the given or a middle
    name; given name, initials and middle names may be left out."""
    surname, given, middle = name[-1], name[0], name[1:-1]
    others = ([given] if len(name) > 1 else []) + [m for m in middle if len(m) > 1]
    best = None
    for k, w in enumerate(typed):
        d = spelt(w, surname)
        if d is None:
            continue
        rest = typed[:k] + typed[k + 1 :]
        full, letters = [x for x in rest if len(x) > 1], [x for x in rest if len(x) == 1]
        table = [[word_cost(x, o, True) for o in others] for x in full]
        order = cheapest_order(table) if full else []
        if order is None:
            continue
        cost = d + sum(table[i][j] for i, j in enumerate(order))
        if 0 not in order or len(name) == 1:
            if len(name) == 1:
                if letters:
                    continue
            elif letters and letters[0] == given[0]:
                cost += 0.5
                letters = letters[1:]
            elif letters:
                continue
            else:
                cost += 1.0  # the surname alone
        for x in letters:
            if any(m[0] == x for m in middle):
                cost -= 0.1
            else:
                cost += 0.6 if middle else 0.2
        best = cost if best is None else min(best, cost)
    return best


def org_cost(typed: list[str], name: list[str], key: str) -> float | None:
    """Cost of a mention for an organisation: its key word must be there, other words in any order of the name's."""
    others = [w for w in name if w not in LINKING and w not in NOISE]
    if key in others:
        others.remove(key)
    best = None
    for k, w in enumerate(typed):
        d = spelt(w, key)
        if d is None:
            continue
        rest = typed[:k] + typed[k + 1 :]
        table = [[word_cost(x, o, False) for o in others] for x in rest]
        order = cheapest_order(table) if rest else []
        if order is not None:
            total = d + sum(table[i][j] for i, j in enumerate(order)) + 0.1 * (len(others) - len(rest)) + (0.5 if not rest else 0)
            best = total if best is None else min(best, total)
    return best


def entity_keys(entities: DataFrame) -> DataFrame:
    """(entity_id, name array, person, key, letters): the key is the rarest word of the name, ties to the longer."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names = [words_of(n) for n in batch["canonical_name"]]
            yield pd.DataFrame({"entity_id": batch["entity_id"], "name": names, "person": batch["entity_type"].fillna("").str.upper().str.startswith("PER"), "letters": ["".join(w[0] for w in n if w not in LINKING and w not in NOISE) for n in names]})

    rows = entities.where("entity_id is not null and canonical_name is not null").groupBy("entity_id").agg(F.min(F.struct("canonical_name", "entity_type")).alias("e")).select("entity_id", "e.*")
    named = checkpoint(rows.mapInPandas(split, "entity_id string, name array<string>, person boolean, letters string").where(F.size("name") > 0))
    uses = named.select("entity_id", F.explode(F.array_distinct("name")).alias("word")).withColumn("uses", F.count("*").over(Window.partitionBy("word")))
    key = uses.groupBy("entity_id").agg(F.min(F.struct("uses", (-F.length("word")).alias("l"), "word")).alias("k"))
    # a person's key is the surname
    chosen = named.join(key, "entity_id").select("entity_id", "name", "person", "letters", F.when(F.col("person"), F.element_at("name", -1)).otherwise(F.col("k.word")).alias("key"))
    return checkpoint(chosen.withColumn("name_id", F.col("entity_id")))


def trie_join(words: DataFrame, keys: DataFrame) -> DataFrame:
    """(word, key): all pairs within the edits that the key's length allows.

    Keys go to tries by their length, a length with many keys to several tries; a word visits the tries of the lengths
    its edits can reach. Words are dealt out by a hash besides, so that there are as many groups as the cluster has
    cores, whatever the lengths.
    """
    keys = keys.select("key").distinct()
    length = lambda c: F.least(F.length(c), F.lit(LONGEST))
    sizes = keys.groupBy(length("key").alias("n")).agg(F.count("*").alias("c")).collect()  # at most LONGEST rows
    tries = {r["n"]: -(-r["c"] // SHARD_KEYS) for r in sizes}
    salts = max(slots(words.sparkSession), -(-words.count() // SHARD_WORDS))
    if not tries:
        return words.select("word", F.lit("").alias("key")).limit(0)
    counts = F.create_map(*[F.lit(x) for pair in tries.items() for x in pair])
    at = F.explode(F.sequence(F.greatest(length("word") - MOST_EDITS, F.lit(0)), length("word") + MOST_EDITS))
    visits = words.select("word", at.alias("n")).where(F.col("n").isin(list(tries)))
    visits = visits.select("word", "n", F.explode(F.sequence(F.lit(0), counts[F.col("n")].cast("int") - 1)).alias("part"), F.pmod(F.xxhash64("word"), F.lit(salts)).alias("salt"))
    shards = keys.withColumn("n", length("key")).withColumn("part", F.pmod(F.xxhash64("key"), counts[F.col("n")]).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            trie = Trie(sorted(right["key"]))
            for w in left["word"]:
                found += [(w, k) for k in trie.near(w, reach(len(w) + MOST_EDITS), True) if edit_distance(w, k, MOST_EDITS) <= reach(len(k))]
        return pd.DataFrame(found, columns=["word", "key"])

    by = ("n", "part", "salt")
    return spread(visits, *by).groupBy(*by).cogroup(spread(shards, *by).groupBy(*by)).applyInPandas(search, "word string, key string")


def nicknames(words: DataFrame) -> DataFrame:
    """(word, key): the given names that a word is short for, as spelt or with one edit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = Trie(sorted(s for s in SHORT if len(s) >= 4))
        for batch in batches:
            out = []
            for w in batch["word"]:
                shorts = {w} | ({*trie.near(w, 1, True)} if len(w) >= 4 else set())
                out += [(w, full) for full in {f for s in shorts for f in SHORT.get(s, ())}]
            yield pd.DataFrame(out, columns=["word", "key"])

    return words.mapInPandas(run, "word string, key string")


def candidates(forms: DataFrame, keys: DataFrame) -> DataFrame:
    """(form, name_id): names that a form may stand for.

    An organisation is met by its key word, the rarest of its name. A person is met by the surname together with one more
    of the name's words, where the form has any, so a surname that many persons bear does not pair all its forms with all
    of them; a form that is a surname, with initials or without, meets its bearers, and of such forms a surname has few.
    """
    single = F.length("word") == 1
    flat = forms.select("form", F.size(F.filter("words", lambda w: F.length(w) > 1)).alias("n_full"), F.posexplode("words").alias("pos", "word"))
    most = keys.agg(F.max(F.size("name"))).head()[0] or 0
    flat = flat.where(F.col("n_full") <= most)  # every word but initials must stand for another word of the name
    persons, others = keys.where("person"), keys.where("not person")
    meant = persons.select(F.explode("name").alias("key")).union(others.select("key"))
    words = checkpoint(flat.select("word").distinct())
    hits = checkpoint(trie_join(words, meant).union(nicknames(words).join(meant.distinct(), "key", "left_semi").select("word", "key")).distinct())
    met = checkpoint(flat.join(hits, "word").select("form", "pos", "n_full", (~single).cast("int").alias("full"), "key"))
    by_org = met.join(others.select("key", "name_id"), "key").select("form", "name_id")
    surname = met.join(persons.select("key").distinct(), "key", "left_semi")
    alone = surname.where("n_full = full").select("form", "key", F.lit("").alias("more"))
    more = surname.where("n_full > full").select("form", "key", "pos").join(met.where("full = 1").select("form", F.col("key").alias("more"), F.col("pos").alias("at")), "form").where("pos <> at").select("form", "key", "more")
    given = F.array_distinct(F.concat(F.array(F.lit("")), F.filter(F.slice("name", 1, F.size("name") - 1), lambda w: F.length(w) > 1)))
    bearers = persons.select("key", F.explode(given).alias("more"), "name_id")
    return by_org.union(alone.union(more).distinct().join(bearers, ["key", "more"]).select("form", "name_id")).distinct()


def links(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(mention_id, entity_id, cost): the entity each mention means; mentions of nobody known are left out.

    The text counts, not the type; a null or blank text falls back to the normalised text and else means nobody. A
    repeated row counts once; of several texts under one mention_id the smallest counts. Texts with the same words after
    titles and remarks are set aside are one form, judged once.
    """
    text = F.coalesce(F.nullif(F.trim("mention_text"), F.lit("")), F.nullif(F.trim("normalized_mention_text"), F.lit("")))
    rows = mentions.where("mention_id is not null").select("mention_id", text.alias("text")).where("text is not null").groupBy("mention_id").agg(F.min("text").alias("text"))
    rows = checkpoint(rows)
    keys = entity_keys(entities)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [content(words_of(t)) for t in batch["text"]]
            yield batch.assign(form=[" ".join(w) for w in words], words=words, letters=[acronym(w) for w in words])

    texts = checkpoint(spread(rows.groupBy("text").agg(F.count("*").alias("uses")), "text").mapInPandas(split, "text string, uses bigint, form string, words array<string>, letters string").where("form <> ''"))
    forms = checkpoint(texts.groupBy("form").agg(F.sum("uses").alias("uses"), F.any_value("words").alias("words"), F.any_value("letters").alias("letters")))
    pairs = candidates(forms, keys).join(keys, "name_id").join(forms.select("form", "words"), "form")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cost = [person_cost(list(t), list(n)) if p else org_cost(list(t), list(n), k) for t, n, p, k in zip(batch["words"], batch["name"], batch["person"], batch["key"])]
            yield pd.DataFrame([(t, e, c) for t, e, c in zip(batch["form"], batch["entity_id"], cost) if c is not None], columns=["form", "entity_id", "cost"])

    judged = spread(pairs, "form", "name_id").mapInPandas(judge, "form string, entity_id string, cost double")
    short = forms.where("letters is not null").join(keys.where("not person").select("letters", "entity_id"), "letters").select("form", "entity_id", F.lit(2.0).alias("cost"))
    near = Window.partitionBy("form")
    fits = checkpoint(judged.union(short).groupBy("form", "entity_id").agg(F.min("cost").alias("cost")).withColumn("least", F.min("cost").over(near)).where("cost <= least + 1e-9").withColumn("options", F.count("*").over(near)))
    # several entities fit equally: the one that most of the unequivocal mentions of these entities mean
    sure = fits.where("options = 1").join(forms.select("form", "uses"), "form").groupBy("entity_id").agg(F.sum("uses").alias("known"))
    open_ = fits.where("options > 1").join(sure, "entity_id", "left").withColumn("known", F.coalesce("known", F.lit(0)))
    clear = open_.withColumn("share", F.try_divide("known", F.sum("known").over(near))).where(F.col("share") > CLEAR_SHARE)
    chosen = fits.where("options = 1").select("form", "entity_id", "cost").union(clear.select("form", "entity_id", "cost"))
    meant = texts.select("text", "form").join(chosen, "form").select("text", "entity_id", "cost")
    return rows.join(meant, "text").select("mention_id", "entity_id", "cost")

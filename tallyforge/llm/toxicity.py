"""Toxicity by a weighted finite-state grammar of clauses."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ranking import seeded_key
from ..plans.scratch import cut

#: A document of at least this score is toxic: a strong insult of somebody, a threat, or two insults of nobody in particular.
LEAST = 1.5
#: Labelled rows that learnt() draws at most.
SAMPLE_ROWS, SEED = 16_384, 59
#: A word is learnt if so large a share of the labelled rows with it are toxic (strong from STRONG on, else weak), and if
#: the chance that any word of its language is as often in toxic rows alone is under CHANCE.
SHARE, STRONG, CHANCE = 0.8, 0.9, 0.01

#: Classes of words by language. thee: you as an object; iwill, iharm: a verb that says who does it; yoube: one that says of whom;
#: harmthee: a verb with its object; gone: an order to kill oneself; bring, um: a verb in two parts; every: all of them.
_CLASSES = {
    "en": {
        "strong": "idiot idiots moron morons scum loser losers worthless imbecile imbeciles scumbag scumbags dumbass retard retards bastard bastards asshole assholes bitch bitches vermin "
        "cretin cretins subhuman dimwit dimwits halfwit halfwits nitwit jackass shithead dickhead motherfucker cunt cunts",
        "weak": "trash pathetic disgusting stupid clown clowns filth filthy dumb garbage repulsive useless",
        "harm": "kill murder stab shoot strangle behead slaughter lynch hurt cripple maim",
        "die": "die perish",
        "ill": "cancer aids",
        "harmed": "shot hanged beaten killed lynched slaughtered gassed butchered strangled stabbed",
        "you": "you your youre you're yourselves y'all",
        "self": "yourself",
        "they": "he she they him her them his their these those everyone he's she's they're",
        "me": "i we i'm im",
        "iwill": "i'll we'll i'd ill",
        "be": "is are was were be am being been look sound",
        "filler": "a an the such so very really just total complete fucking damn absolute utter always of as like and or more most",
        "every": "all",
        "not": "not never no isn't aren't wasn't weren't won't don't didn't doesn't cannot can't wouldn't ain't without nobody",
        "say": "said says say saying told tells called calls wrote writes claimed claims quoted reported shouted yelled alleged accused",
        "will": "will shall gonna going to want wanna can could would am",
        "urge": "go should must hope deserve deserves",
    },
    "de": {
        "strong": "idiot idioten vollidiot vollidioten trottel dummkopf dummköpfe arschloch arschlöcher abschaum wichser hurensohn missgeburt missgeburten bastard bastarde untermensch untermenschen "
        "drecksack drecksau schlampe schlampen mistkerl ungeziefer",
        "weak": "dumm dumme dummer blöd blöde erbärmlich erbärmliche erbärmlicher wertlos wertlose wertloser widerlich widerliche ekelhaft ekelhafte dreck",
        "harm": "töten umbringen erschießen erstechen erwürgen totschlagen abstechen abknallen ermorden verprügeln",
        "harm1": "töte ermorde erwürge erschieße ersteche",
        "die": "sterben stirb stirbst verrecken verrecke verreckst krepieren",
        "ill": "krebs",
        "harmed": "erschossen gehängt aufgehängt vergast getötet ermordet abgeschlachtet umgebracht",
        "you": "du dein deine",
        "thee": "dich euch",
        "they": "er sie es ihn ihnen diese jeder",
        "me": "ich wir",
        "yoube": "bist seid",
        "be": "ist sind war waren bin wärst",
        "filler": "ein eine einen einem einer der die das den dem so sehr wirklich nur total völlig absolut ganz echt doch wie und oder verdammter verdammte als zu",
        "every": "alle alles",
        "not": "nicht kein keine keinen keiner keinem nie niemals ohne niemand",
        "say": "sagte sagt sagen sagten rief ruft schrieb schreibt meinte behauptet behauptete erzählte nannte",
        "will": "werde will werden wollen möchte kann könnte",
        "urge": "sollst sollt sollen sollte solltest sollten musst müssen muss verdienst verdienen hoffe geh",
        "bring": "bring bringe bringt bringen",
        "um": "um",
    },
    "fr": {
        "strong": "idiot idiots idiote idiotes imbécile imbéciles connard connards connasse abruti abrutis abrutie crétin crétins salaud salauds salope ordure ordures enculé enculés vermine débile débiles",
        "weak": "stupide stupides minable minables pathétique pathétiques dégoûtant dégoûtante dégueulasse inutile inutiles",
        "harm": "tuer assassiner poignarder égorger étrangler buter abattre",
        "harm1": "tue égorge étrangle",
        "die": "mourir crever crève meurs meures",
        "ill": "cancer sida",
        "harmed": "tués tué pendus pendu fusillés fusillé abattus gazés égorgés",
        "you": "tu vous ton ta",
        "thee": "te toi t'",
        "they": "il elle ils elles les ces eux leur",
        "me": "je nous j'",
        "yoube": "es êtes",
        "be": "est sont était étaient être suis sommes c'est",
        "filler": "un une le la l' des de d' du très vraiment si tellement complet complète total totale sale sales gros espèce et ou à que qu'",
        "every": "tous toutes",
        "not": "pas ne n' jamais aucun aucune sans personne",
        "say": "dit disait disent disait-il déclare déclara écrit écrivit écrivait cria crie affirme affirma raconte répondit",
        "will": "vais va vas allons vont veux voudrais peux",
        "urge": "dois devez doivent devrais devrait devraient mérites mérite méritent espère",
    },
    "es": {
        "strong": "idiota idiotas imbécil imbéciles estúpido estúpida estúpidos estúpidas gilipollas cabrón cabrones pendejo pendejos escoria tarado subnormal subnormales hijoputa bastardo bastardos",
        "weak": "patético patética patéticos basura asqueroso asquerosa asquerosos inútil inútiles repugnante",
        "harm": "matar asesinar apuñalar estrangular degollar",
        "harmthee": "matarte asesinarte apuñalarte estrangularte matarlos matarlas mataros matarlo",
        "iharm": "mato asesino",
        "gone": "mátate suicídate mátense",
        "die": "morir morirte muere mueras mueran muérete",
        "ill": "cáncer sida",
        "harmed": "fusilados fusilado ahorcados ahorcado asesinados gaseados",
        "you": "tú tu usted ustedes vosotros",
        "thee": "te os",
        "they": "él ella ellos ellas esos estos los las les",
        "me": "yo nosotros",
        "iwill": "voy vamos quiero queremos",
        "yoube": "eres sois",
        "be": "es son soy somos era eran ser",
        "filler": "un una unos unas el la de muy tan realmente completo completa total maldito maldita a que y o",
        "every": "todos todas",
        "not": "no ni nunca jamás sin ningún ninguna tampoco nadie",
        "say": "dijo dice dicen dijeron gritó escribió escribe afirmó llamó contó respondió",
        "will": "va vas van puedo",
        "urge": "debes debe deben deberías debería deberían mereces merece merecen ojalá espero",
    },
}
LEXICONS = {lang: {word: name for name, words in classes.items() for word in words.split()} for lang, classes in _CLASSES.items()}
_LOADED = ("strong", "weak", "harm", "harm1", "iharm", "harmthee", "die", "ill", "harmed")
#: Words that say which language a sentence is in, and its insults, which count in a sentence of any.
_LIGHT = {lang: {w for w, c in words.items() if c not in _LOADED} for lang, words in LEXICONS.items()}
_INSULTS = {w: c for words in LEXICONS.values() for w, c in words.items() if c in ("strong", "weak")}
#: quote: a mark that opens or closes, as the state has it.
_MARKS = {",": "comma", ":": "comma", "\n": "break", '"': "quote", "“": "open", "„": "open", "”": "close", "«": "open", "»": "close"}
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;\n,:\"“”„«»]")
#: Marks whose neighbours say what they do, whatever their shape: German and Swedish marks, and straight ones.
_OPENS, _CLOSES = re.compile(r"(?<![^\s(\[{—–-])[\"“”»](?=\w)"), re.compile(r"(?<=[^\s(\[{—–])[\"“«](?!\w)")
#: Without one of these words no clause of the grammar is complete.
_ANCHORS = sorted({w for words in LEXICONS.values() for w, c in words.items() if c in (*_LOADED, "gone", "bring")})
SYMBOLS = [*dict.fromkeys(c for classes in _CLASSES.values() for c in classes), "comma", "quote", "open", "close", "end", "break", "word"]


@dataclass
class Transducer:
    """A sequential transducer: arcs[state][symbol] is (output, weight, next); a symbol without an arc is copied and goes to other[state]."""

    arcs: list[dict[str, tuple[str, float, int]]]
    other: list[int]

    def step(self, state: int, symbol: str) -> tuple[str, float, int]:
        return self.arcs[state].get(symbol) or (symbol, 0.0, self.other[state])


def compose(first: Transducer, second: Transducer, symbols: list[str]) -> Transducer:
    """The transducer that runs second on what first puts out, for inputs among symbols; weights add."""
    number, todo, arcs = {(0, 0): 0}, [(0, 0)], []
    for a, b in todo:
        row = {}
        for symbol in symbols:
            middle, w1, to_a = first.step(a, symbol)
            out, w2, to_b = second.step(b, middle)
            if (to_a, to_b) not in number:
                number[to_a, to_b] = len(todo)
                todo.append((to_a, to_b))
            row[symbol] = (out, w1 + w2, number[to_a, to_b])
        arcs.append(row)
    return Transducer(arcs, [0] * len(arcs))


def negation() -> Transducer:
    """After a negation, and over fillers, forms of be, and persons, an insult or threat is denied."""
    through = {s: (s, 0.0, 1) for s in ("filler", "every", "be", "yoube", "will", "iwill", "urge", "you", "thee", "they", "not")}
    denied = {s: (f"{s} denied", 0.0, 0) for s in _LOADED}
    return Transducer([{"not": ("not", 0.0, 1)}, through | denied], [0, 0])


def reported() -> Transducer:
    """After a verb of saying, to the end of the sentence, and in quotation marks, insults and threats are another's words.

    A quotation goes on over ends of sentences. One that isn't closed ends with its paragraph: at a line break after the end
    of a sentence, or at an empty line. A closing mark outside a quotation is nothing. Puts out end for break.
    States: none, said, quoted, quoted after an end, quoted after a break, quoted in a sentence with a verb of saying.
    """
    ends = {"end": ("end", 0.0, 0), "break": ("end", 0.0, 0)}

    def others(to: int) -> dict:
        return {s: (f"{s} reported", 0.0, to) for s in _LOADED}

    def marks(opened: int, closed: int | None) -> dict:
        out = {"open": ("open", 0.0, opened), "quote": ("quote", 0.0, opened)}
        return out if closed is None else out | {s: (s, 0.0, closed) for s in ("quote", "close")}

    def quoted(to: int, closed: int, broken: int) -> dict:
        return others(to) | marks(to, closed) | {"end": ("end", 0.0, 3), "break": ("end", 0.0, broken)}

    rows = [
        {"say": ("say", 0.0, 1), "break": ("end", 0.0, 0)} | marks(2, None),
        others(1) | ends | marks(5, None),
        quoted(2, 0, 4),
        quoted(2, 0, 0),
        quoted(2, 0, 0),
        quoted(5, 1, 4),
    ]
    return Transducer(rows, [0, 1, 2, 2, 2, 5])


def targeted() -> Transducer:
    """Marks insults whose sentence addresses somebody, or says of him that he is so: states none, you, they, they are, I, I am."""
    kinds = [f"{s}{r}" for s in ("strong", "weak") for r in ("", " reported")]

    def at(who: str, to: int) -> dict:
        return {s: (f"{s} at {who}", 0.0, to) for s in kinds}

    def stay(n: int) -> dict:
        return {s: (s, 0.0, n) for s in ("filler", "every")}

    enter = {s: (s, 0.0, to) for s, to in (("you", 1), ("thee", 1), ("yoube", 1), ("they", 2), ("me", 4), ("iwill", 4))}
    end = {"end": ("end", 0.0, 0)}
    be = {"be": ("be", 0.0, 3)}
    mine = {s: (s, 0.0, 5) for s in ("be", "will", "iwill")}
    return Transducer(
        [enter, at("you", 1) | end, enter | be | stay(2), enter | at("them", 3) | stay(3) | end, enter | mine | stay(4), enter | at("me", 5) | stay(5) | end],
        [0, 1, 0, 0, 0, 0],
    )


def threats() -> Transducer:
    """Puts out threat where somebody will harm you, where you are told to harm yourself or to die, or should be harmed or ill.

    The object stands after the verb, or before it as in German, French and Spanish. (To die needs you or an urging word before
    it: die is also an article.) An order to harm others is one at the beginning of a sentence and of all of them.
    """
    names = "start none me iwill harming harm you urged urged_thee quoted they should with_thee thee thee_will harm1 wish order order_all order_them bring bring_thee bring_um".split()
    at = {n: k for k, n in enumerate(names)}

    def go(**to: str) -> dict:
        return {s: (s, 0.0, at[n]) for s, n in to.items()}

    def over(state: str, *more: str) -> dict:
        return go(**dict.fromkeys(("filler", "every", *more), state))

    def threat(*symbols: str) -> dict:
        return {s: ("threat", 0.0, at["none"]) for s in symbols}

    base = go(me="me", iwill="iwill", you="you", yoube="you", harm="harm", urge="urged", they="they", thee="thee", harm1="harm1", iharm="harm1", bring="bring", end="start", **{"break": "start"})
    base |= threat("gone") | {"harm reported": ("harm reported", 0.0, at["quoted"])}
    base |= {"gone reported": ("threat reported", 0.0, at["none"])}
    object_ = threat("you", "thee", "they", "self")
    rows = {
        "start": go(**dict.fromkeys(("filler", "quote", "open", "comma"), "start"), harm="order"),
        "none": {},
        "me": go(will="iwill", iwill="iwill", urge="iwill", be="me", thee="with_thee", harm1="harm1") | over("me"),
        "iwill": go(will="iwill", urge="iwill", harm="harming", you="wish", thee="with_thee", they="with_thee") | threat("harmthee") | over("iwill"),
        "harming": object_ | over("harming"),
        "harm": threat("self"),
        "you": go(will="you", iwill="you", urge="should") | threat("die") | over("you"),
        "urged": go(will="urged", iwill="urged", you="should", yoube="should", thee="urged_thee", they="should") | threat("die", "harmthee") | over("urged"),
        "urged_thee": go(will="urged_thee") | threat("die", "harm") | over("urged_thee"),
        "quoted": {s: ("threat reported", 0.0, at["none"]) for s in ("you", "thee", "they", "self")},
        "they": go(urge="should") | over("they"),
        "should": over("should", "will", "iwill", "be", "yoube", "urge") | threat("die", "harmed"),
        "with_thee": over("with_thee", "will", "iwill", "urge") | threat("harm", "harm1", "iharm"),
        "thee": go(iwill="thee_will") | threat("iharm") | over("thee"),
        "thee_will": threat("harm") | over("thee_will"),
        "harm1": object_ | over("harm1"),
        "wish": dict.fromkeys(("filler", "every", "be", "yoube", "comma", "word", "harm", "they", "me"), None),
        "order": go(they="order_them", every="order_all", filler="order") | threat("self"),
        "order_all": over("order_all") | threat("they", "you", "thee"),
        "order_them": threat("every") | go(filler="order_them"),
        "bring": go(thee="bring_thee", filler="bring"),
        "bring_thee": go(um="bring_um", filler="bring_thee"),
        "bring_um": threat("end", "break", "comma", "close", "quote"),
    }
    rows["wish"] = {s: (s, 0.0, at["wish"]) for s in rows["wish"]} | threat("die", "ill", "harmed")
    other = [at["wish"] if n == "wish" else at["none"] for n in names]
    return Transducer([base | rows[n] for n in names], other)


def weights() -> Transducer:
    """What a clause is worth."""
    worth = {"strong": 1.0, "weak": 0.75}
    who = {"": 1.0, " at you": 2.0, " at them": 1.5, " at me": 0.25}
    arcs = {f"{s}{said}{at}": ("clause", w * much * share, 0) for s, w in worth.items() for at, much in who.items() for said, share in (("", 1.0), (" reported", 0.25))}
    return Transducer([arcs | {"threat": ("clause", 3.0, 0), "threat reported": ("clause", 0.5, 0)}], [0])


def grammar() -> Transducer:
    """The composition of all five."""
    machine = negation()
    for part in (reported(), targeted(), threats(), weights()):
        machine = compose(machine, part, SYMBOLS)
    return machine


def _language(words: list[str], likely: str) -> str:
    """The language of most of a sentence's function words; likely, if that is one of several."""
    votes = {lang: sum(w in light for w in words) for lang, light in _LIGHT.items()}
    return max(votes, key=lambda lang: (votes[lang], lang == likely))


def _parts(word: str, lexicon: dict[str, str], learnt: dict[str, str]) -> list[str]:
    """Classes of a word; one with an apostrophe that is in no lexicon is two words."""
    if found := learnt.get(word) or lexicon.get(word) or _INSULTS.get(word):
        return [found]
    if "'" in word:
        first, _, rest = word.partition("'")
        return [lexicon.get(f"{first}'", "word"), learnt.get(rest) or lexicon.get(rest) or _INSULTS.get(rest, "word")]
    return ["word"]


def symbols(text: str, lang: str | None = None, learnt: dict[str, str] | None = None) -> list[str]:
    """The classes of the words and marks of a text, and an end.

    Each sentence's words have the classes of its own language; lang is the text's, if known. learnt: words that labelled rows
    have taught (of the text's language), which count in sentences of any.
    """
    out: list[str] = []
    known = lang if lang in LEXICONS else "en"
    text = _CLOSES.sub("”", _OPENS.sub("„", text.lower()))
    sentence: list[str] = []
    for token in [*_TOKEN.findall(text), "."]:
        if token[0].isalpha():
            sentence.append(token.replace("’", "'"))
            continue
        sentence.append(token)
        if (mark := _MARKS.get(token, "end")) == "end" or mark == "break":
            known = _language(sentence, known)
            for word in sentence:
                out += _parts(word, LEXICONS[known], learnt or {}) if word[0].isalpha() else [_MARKS.get(word, "end")]
            sentence = []
    return out


def clause_scores(text: str | None, machine: Transducer, lang: str | None = None, learnt: dict[str, str] | None = None) -> list[float]:
    """The weights of the clauses that the grammar finds, in order."""
    state, out = 0, []
    for symbol in symbols(text or "", lang, learnt):
        put, weight, state = machine.arcs[state][symbol]
        if put == "clause":
            out.append(weight)
    return out


_Learnt = dict[str | None, dict[str, str]]


def _for(learnt: _Learnt, lang: str | None) -> dict[str, str]:
    """The learnt words of a text: those of its language, or all where that has none of its own."""
    return learnt.get(lang) or learnt.get("*", {})


def _anchored(words: list[str]):
    """Whether a lower-case text has one of words as a word."""
    found = ahocorasick.Automaton()
    for word in words:
        found.add_word(word, len(word))
    found.make_automaton()

    def run(text: str) -> bool:
        for end, size in found.iter(text):
            if not (text[end + 1 : end + 2].isalpha() or (end >= size and text[end - size].isalpha())):
                return True
        return False

    return run


def _scorer(learnt: _Learnt):
    everything = {w: c for words in learnt.values() for w, c in words.items()}
    learnt = {**learnt, "*": everything}

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        machine, anchored = grammar(), _anchored(sorted({*_ANCHORS, *everything}))
        for texts, langs in batches:
            found = [clause_scores(t, machine, lang, _for(learnt, lang)) if t is not None and anchored(t.lower()) else [] for t, lang in zip(texts, langs)]
            yield pd.DataFrame({"score": [float(sum(f)) for f in found], "clauses": [len(f) for f in found]}).astype({"score": float, "clauses": "int32"})

    return run


def scores(text: Column, lang: Column | None = None, learnt: _Learnt | None = None) -> Column:
    """Struct of score and clauses."""
    return F.pandas_udf(_scorer(learnt or {}), "score double, clauses int")(text, F.lit(None).cast("string") if lang is None else lang.cast("string"))


def _contexts(text: str) -> dict[str, int]:
    """The words of a text, each with one bit of 63 for each pair of neighbours that it has there."""
    words = ["", *(t.replace("’", "'") for t in _TOKEN.findall(text.lower()) if t[0].isalpha()), ""]
    out: dict[str, int] = {}
    for before, word, after in zip(words, words[1:], words[2:]):
        out[word] = out.get(word, 0) | 1 << sum(map(ord, f"{before} {after}")) % 63
    return out


def _seen(only: dict[str | None, set[str]] | None):
    """For mapInArrow: (lang, word, contexts) of each text, only those words if they are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column("__lang").to_pylist(), batch.column("text")):
                found = _contexts(text.as_py())
                some = list(found if only is None else found.keys() & only.get(lang, set()))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.string()), pa.array([found[w] for w in some], pa.int64())], ["lang", "word", "contexts"])

    return run


def learnt(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, seed: int = SEED) -> _Learnt:
    """Classes of words by language, from labels (doc_id, toxic 0 or 1) of docs.

    At most rows seeded rows of labels are used, with the whole texts of their documents; a document with both labels is left out. Of each language (lang of docs, null is one
    too), a word becomes strong or weak if at least SHARE of the labelled texts with it are toxic, and if so many toxic
    ones would hardly have it by chance; that number is no higher than that of the word's different neighbours, so
    that copies of one text teach nothing. No labels, or none toxic: no words. Null texts, ids and labels don't count.
    """
    drawn = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("__labelled"), (F.col("toxic").cast("int") > 0).alias("__toxic"))
    drawn = drawn.orderBy(seeded_key(seed, F.col("__labelled")), "__labelled", "__toxic").limit(rows)
    one = drawn.groupBy("__labelled").agg(F.min("__toxic").alias("__toxic"), F.max("__toxic").alias("__most")).where(F.col("__toxic") == F.col("__most"))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("__id"), lang.alias("__lang"), "text")
    sample = cut(texts.join(F.broadcast(one), F.col("__id") == F.col("__labelled")).select("__lang", "__toxic", "text"))
    size = Counter({(r["__lang"], r["__toxic"]): r["count"] for r in sample.groupBy("__lang", "__toxic").count().collect()})
    schema = "lang string, word string, contexts long"
    toxic = sample.where("__toxic").mapInArrow(_seen(None), schema).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"), F.bit_count(F.bit_or("contexts")).alias("contexts"))
    often = toxic.where("n > 2").collect()
    only: dict[str | None, set[str]] = {}
    for r in often:
        only.setdefault(r["lang"], set()).add(r["word"])
    if not only:
        return {}
    clean = {(r["lang"], r["word"]): r["count"] for r in sample.where("not __toxic").mapInArrow(_seen(only), schema).groupBy("lang", "word").count().collect()}
    out: _Learnt = {}
    for r in often:
        lang, word = r["lang"], r["word"]
        a, b = r["n"], clean.get((lang, word), 0)
        chance = (size[lang, True] + 1) / (size[lang, True] + size[lang, False] + 2)
        different = 1e9 if r["contexts"] == 63 else -63 * math.log(1 - r["contexts"] / 63)
        share = (a + 1) / (a + b + 2)
        if share >= SHARE and min(a, different) * -math.log(chance) >= math.log(len(only[lang]) / CHANCE):
            out.setdefault(lang, {})[word] = "strong" if share >= STRONG else "weak"
    return out


def _scores_of(docs: DataFrame, labels: DataFrame | None) -> Column:
    found = learnt(docs, labels) if labels is not None else {}
    return scores(F.col("text"), F.col("lang") if "lang" in docs.columns else None, found)


def toxicity(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(doc_id, score, clauses, toxic): one row for each row of docs.

    Five transducers over the classes of words are composed into one: negation denies what follows it;
    verbs of saying and quotation marks make it another's words; a target in the sentence, or a person that
    is said to be so, turns an insult into one of somebody; persons, intentions and verbs of harm make threats; the
    last gives each complete clause its weight (weights()). score is their sum, clauses their number; an
    insult in a clause that names nobody counts singly, so one such word alone is not toxic. toxic: score >= LEAST.
    The classes are lexicons of English, German, French and Spanish, and insults that labels teach: learnt().

    Null and empty texts, and texts without a clause, score 0 and are not toxic. Rows of equal or null doc_id get a row
    each. No documents: no rows. Without a lang column, or with a null or unknown lang, all learnt words count. Other columns are not looked at.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _scores_of(docs, labels).alias("__s"))
    return found.select("doc_id", "__s.*", (F.col("__s.score") >= LEAST).alias("toxic"))


def without_toxic(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """docs that are not toxic, with all columns."""
    return docs.where(_scores_of(docs, labels)["score"] < LEAST)

"""Toxicity by a weighted finite-state pattern grammar.

Words of a clause become symbols (``CLASSES``, ``TARGETS`` and the like), and small transducers mark and weigh
the hits among them:

* *reported speech* marks what a reporting verb governs or quotation marks hold. A report ends at a
  comma that an address, an agent or a vocative insult follows; a quotation runs on over sentences to
  its end or the end of the line.
* *negation* marks the next few words after a negator, and more where a verb such as "think" carries the
  negation on; it ends at a comma or "but".
* *target* gives threats and insults their person. A threat needs an object ("you", "them", "her" where no
  noun follows, not "your") and either an agent with a modal ("I will") or none at all (an imperative).
  A weak insult ("pig") counts only as what "you" are called. Any insult weighs more beside a target.
* *insult* and *threat* weigh the marked classes.

They are composed into one machine, which reads a clause and gives its weight and the classes that it
has found. Objects stand behind their verbs, so a second machine reads the clause backwards first and
marks the hits by what follows them.

A document is judged by the classes that the machine puts out: insults, aimed insults and aimed threats
count as attacks; what is negated or reported counts as mitigated, apart from them; a threat that is not
aimed counts for nothing. A logistic curve over the classes' strengths is fitted to labelled rows from
prior weights (``PRIOR``); the prior of mitigated hits is tight, so that they don't become attacks
because a few labelled texts have nothing else.

The lexicon is learned from the same rows: beside the fixed entries with their endings, words whose odds
for label 1 are strong and can't be chance, and beginnings of words that several different words support.
The labels have no threats, so those are fixed. A bounded sample of labelled rows (``sample_rows``)
serves. Nothing but the text is an input of a score.

Defined results: null and empty texts score as texts without a hit; without any training rows the
fixed lexicon and the prior weights hold; repeated rows each give a row; an empty table gives none;
other columns are not read, and pass unchanged through :func:`drop_toxic`.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosspan.llm.common import fold, fresh_name, text_of, written

#: Fixed word lists of the grammar's classes. Insults also have their endings (``forms``); weak ones are such only of "you".
INSULTS = (
    "idiot", "moron", "stupid", "scum", "trash", "loser", "clown", "pathetic", "worthless", "disgusting", "imbecile", "vermin", "bastard", "scumbag", "dumbass", "asshole", "lowlife", "halfwit", "dimwit",
    "crétin", "imbécile", "dummkopf", "abschaum", "basura", "estúpido", "escoria", "connard", "arschloch", "idiota", "imbécil",
)
WEAK_INSULTS = ("pig", "rat", "dog", "animal", "garbage", "parasite", "cockroach", "maggot", "swine", "fool", "coward", "creep", "jerk", "freak", "filth", "failure", "disgrace", "dumb", "useless", "ugly", "liar", "schwein", "cochon", "cerdo")
THREATS = (
    "kill", "hurt", "destroy", "beat", "shoot", "stab", "burn", "murder", "strangle", "choke", "smash", "crush", "punch", "slaughter", "hang", "drown",
    "tuer", "tue", "frapper", "töten", "töte", "umbringen", "schlagen", "matar", "mato", "golpear",
)
TARGETS = (
    "you", "ya", "you're", "yourself", "he", "she", "they", "he's", "she's", "they're", "them", "him", "her", "everyone", "everybody",
    "du", "dich", "ihr", "euch", "ihn", "tu", "vous", "toi", "te", "usted", "ustedes", "ellos",
)
#: Targets that are only subjects, only objects, and an object only where no noun follows.
SUBJECTS, OBJECTS, DETERMINERS = ("he", "she", "they", "he's", "she's", "they're", "ellos"), ("them", "him", "yourself", "everyone", "everybody", "dich", "euch", "ihn", "toi", "te"), ("her",)
NEGATORS = (
    "not", "no", "never", "nobody", "isn't", "aren't", "wasn't", "weren't", "don't", "doesn't", "didn't", "won't", "wouldn't", "can't", "cannot", "couldn't", "shouldn't",
    "nicht", "kein", "keine", "niemals", "pas", "jamais", "nunca",
)
REPORTERS = ("said", "says", "wrote", "writes", "called", "calls", "claimed", "claims", "quoted", "reported", "alleged", "shouted", "sagte", "schrieb", "nannte", "dit", "écrit", "dijo", "escribió", "llamó")
#: The other classes: possessives, agents, modals, both in one, verbs that carry a negation on, commas, copulas, words that
#: change nothing, articles, and words after which an object is complete.
CLASSES = {
    "P": ("your", "yours", "his", "their", "my", "our", "its", "dein", "euer", "ton", "votre", "vos", "tes"),
    "A": ("i", "we", "someone", "somebody", "ich", "wir", "je", "nous", "yo", "nosotros"),
    "M": ("will", "gonna", "going", "shall", "should", "must", "wanna", "want", "would", "werde", "werden", "vais", "allons", "vamos"),
    "W": ("i'll", "we'll", "i'd", "i'm", "we're", "voy"),
    "V": ("think", "believe", "suppose", "mean", "consider", "find", "glaube", "denke", "pense", "crois", "creo"),
    "C": (",", "but", "aber", "mais", "pero"),
    "B": ("are", "is", "be", "were", "was", "am", "bist", "seid", "ist", "es", "êtes", "est", "eres", "son"),
    "D": ("the", "all", "of", "such", "so", "really", "just", "please", "go", "then", "total", "complete", "absolute", "utter", "nothing", "every", "each", "one", "both", "last", "little", "damn", "filthy", "ein", "eine", "un", "une"),
    "Z": ("a", "an"),
    "U": ("up", "down", "now", "tonight", "today", "tomorrow", "to", "with", "and", "or", "until", "in", "if", "when", "like", "for", "at", "on", "soon", "too", "again", "and", "that"),
}
FIXED_WEIGHT, SAMPLE_ROWS, LEXICON_SIZE, PREFIXES, TRAIN_FOLDS = 3.0, 10_000, 2_000, range(4, 9), 5
#: A beginning needs so many different words, and none of them more than this share of its support.
LEAST_WORDS, LARGEST_SHARE = 4, 0.5
#: The curve's features, each with its weight before anything is learned and how firmly that holds.
PRIOR = {
    "": (-3.0, 0.01), "attacks": (5.0, 0.05), "aimed insults": (0.5, 0.5), "aimed threats": (0.5, 5.0),
    "mitigated insults": (0.3, 40.0), "mitigated threats": (0.3, 40.0), "length": (0.0, 1.0), "density": (0.0, 1.0),
}

TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)*|[\"“”«»,]")
BREAK = re.compile(r"[.!?;:\n|]")

# --------------------------------------------------------------------------------- transducers

#: A symbol is a base class and its marks, such as ("I", "n") for a negated insult.
Symbol = tuple[str, str]
BASES = ("I", "J", "H", "Y", "S", "O", "G", "N", "R", "Q", *CLASSES, "-")
HITS = "IJH"


@dataclass
class Transducer:
    """Arcs (state, symbol) -> (state, symbol, weight); weights multiply along the marks."""

    start: int
    arcs: dict[tuple[int, Symbol], tuple[int, Symbol, float]] = field(default_factory=dict)


def alphabet(marks: tuple[str, ...]) -> list[Symbol]:
    """All symbols whose marks are made of ``marks``, in order."""
    out = [""]
    for m in marks:
        out += [x + m for x in out]
    return [(b, x) for b in BASES for x in out]


def machine(symbols: list[Symbol], start, step) -> Transducer:
    """The transducer of ``step`` (state, symbol) -> (state, marks, weight); its states are found from ``start``."""
    numbers, todo, t = {start: 0}, [start], Transducer(0)
    while todo:
        state = todo.pop()
        for s in symbols:
            after, marks, weight = step(state, s)
            if after not in numbers:
                numbers[after] = len(numbers)
                todo.append(after)
            t.arcs[numbers[state], s] = (numbers[after], (s[0], marks), weight)
    return t


def reported(symbols: list[Symbol], factor: float = 0.5) -> Transducer:
    """Hits that a reporting verb governs or quotation marks hold get the mark r."""

    def step(state: str, s: Symbol):
        base, marks = s
        hit = base in HITS
        if state == "quoted":
            return ("none" if base == "Q" else state), marks + "r" * hit, factor if hit else 1.0
        if base == "Q":
            return "quoted", marks, 1.0
        if base == "R":
            return "verb", marks, 1.0
        if state == "none" or (state == "verb" and base == "C"):
            return state, marks, 1.0
        # After a comma an address or an agent speaks anew; so does an insult, unless it goes on with a list of them.
        if state.endswith(",") and (base in "YAW" or (base in "IJ" and state == "said,")):
            return "none", marks, 1.0
        state = state.rstrip(",")
        if base == "C":
            return state + ",", marks, 1.0
        return ("said hit" if hit or state == "said hit" else "said"), marks + "r" * hit, factor if hit else 1.0

    return machine(symbols, "none", step)


def negated(symbols: list[Symbol], scope: int = 3, factor: float = 0.4) -> Transducer:
    """Hits within ``scope`` words after a negator get the mark n, or twice as many where a verb carries it on."""

    def step(left: int, s: Symbol):
        base, marks = s
        hit = left > 0 and base in HITS
        after = scope if base == "N" else 0 if base == "C" else 2 * scope if base == "V" and left else left if base in "BZD" else max(0, left - 1)
        return after, marks + "n" * hit, factor if hit else 1.0

    return machine(symbols, 0, step)


def followed(symbols: list[Symbol]) -> Transducer:
    """Reads a clause backwards: t marks insults before a target, threats before their object, weak insults without a noun."""

    def step(state: tuple[str, bool], s: Symbol):
        right, seen = state
        base, marks = s
        mark = {"I": seen, "H": right == "object", "J": right != "noun"}.get(base, False)
        if base in "YO":
            right = "noun" if right == "article" else "object"
        elif base == "G":
            right = "object" if right == "end" else "noun"
        elif base == "Z":
            right = "article"
        elif base in "CUQNB":
            right = "end"
        elif base != "D":
            right = "noun"
        return (right, seen or base in "YSOG"), marks + "t" * mark, 1.0

    return machine(symbols, ("end", False), step)


def targeted(symbols: list[Symbol], factor: float = 1.5) -> Transducer:
    """Keeps or gives the mark t: insults beside a target, aimed threats, and weak insults of "you"."""

    def step(state: tuple[str, bool, bool, bool, bool], s: Symbol):
        # Who acts; a target seen, an object seen, the last word a target, and "you" with what it is called to come.
        actor, seen, object_, last, open_ = state
        base, marks = s
        held, rest = "t" in marks, marks.replace("t", "")
        mark = {"I": held or seen, "H": (held or object_) and actor in ("nobody", "agent with modal"), "J": held and open_}.get(base, False)
        object_ = object_ or base == "O" or (base in "AW" and last)
        if base == "A":
            actor = "agent"
        elif base == "W":
            actor = "agent with modal"
        elif base == "M":
            actor = "agent with modal" if actor != "another" else actor
        elif base == "C":
            actor = "nobody" if actor == "another" else actor
        elif base == "S" or (base == "Y" and actor != "agent with modal") or (actor == "nobody" and base not in "DUNQHIJO"):
            actor = "another"
        open_ = base == "Y" or (open_ and base in "BDZNCIJ")
        return (actor, seen or base in "YSOG", object_ and base != "C", base in "YO", open_), rest + "t" * mark, factor if mark else 1.0

    return machine(symbols, ("nobody", False, False, False, False), step)


def weighed(symbols: list[Symbol]) -> Transducer:
    """Insults count; weak insults and threats count only with the mark t; all else weighs nothing."""
    return machine(symbols, 0, lambda state, s: (state, s[1], 1.0 if s[0] == "I" or (s[0] in "HJ" and "t" in s[1]) else 0.0))


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The machine that feeds a's output to b; weights multiply. States are found from the start."""
    by_state: dict[int, list] = {}
    for (state, symbol), arc in a.arcs.items():
        by_state.setdefault(state, []).append((symbol, *arc))
    numbers, out, todo = {(a.start, b.start): 0}, Transducer(0), [(a.start, b.start)]
    while todo:
        p, q = pair = todo.pop()
        for symbol, after, made, w in by_state.get(p, ()):
            if (q, made) in b.arcs:
                then, last, v = b.arcs[q, made]
                if (after, then) not in numbers:
                    numbers[after, then] = len(numbers)
                    todo.append((after, then))
                out.arcs[numbers[pair], symbol] = (numbers[after, then], last, w * v)
    return out


@functools.cache
def grammar() -> Transducer:
    """All five, composed in the order of the marks; what it reads may have the mark t already."""
    out = reported(alphabet(("t",)))
    out = compose(out, negated(alphabet(("t", "r"))))
    out = compose(out, targeted(alphabet(("t", "r", "n"))))
    return compose(out, weighed([*alphabet(("t", "r", "n")), *alphabet(("r", "n", "t"))]))


# ------------------------------------------------------------------------------------- scoring


@dataclass
class Model:
    """Lexicon entries (word, or word beginning with a trailing *) and the curve, as ``PRIOR`` has it."""

    lexicon: dict[str, float]
    curve: tuple[float, ...] = tuple(w for w, _ in PRIOR.values())

    def digest(self) -> str:
        return hashlib.sha256(repr((sorted(self.lexicon.items()), self.curve)).encode()).hexdigest()


def forms(word: str) -> Iterator[str]:
    """The word with the endings that insults take in the four languages."""
    yield from (word + end for end in ("", "s", "es", "'s", "e", "en"))
    if word.endswith("o"):
        yield from (word[:-1] + end for end in ("a", "os", "as"))
    if word.endswith("y"):
        yield word[:-1] + "ies"


def fixed_lexicon() -> dict[str, float]:
    return {form: FIXED_WEIGHT for word in INSULTS for form in forms(word)}


def word_classes() -> dict[str, str]:
    """The class of every listed word; insults come from the lexicon."""
    out = {word: base for base, words in CLASSES.items() for word in words}
    out |= {form: "J" for word in WEAK_INSULTS for form in forms(word)}
    out |= {word: "S" if word in SUBJECTS else "O" if word in OBJECTS else "G" if word in DETERMINERS else "Y" for word in TARGETS}
    for base, words in (("H", THREATS), ("N", NEGATORS), ("R", REPORTERS)):
        out |= dict.fromkeys(words, base)
    return out | dict.fromkeys('"“”«»', "Q")


class Scorer:
    def __init__(self, model: Model) -> None:
        import ahocorasick

        self.model, self.machine, self.backward = model, grammar(), followed(alphabet(()))
        self.classes = word_classes()
        self.words = {k: w for k, w in model.lexicon.items() if not k.endswith("*")}
        self.heads = {k[:-1]: w for k, w in model.lexicon.items() if k.endswith("*")}
        # Whole words, and beginnings of words, at which a clause can have a hit.
        self.automaton = ahocorasick.Automaton()
        for key in {*self.words, *self.heads, *(w for w, base in self.classes.items() if base in "HJ")}:
            self.automaton.add_word(key, (len(key), key in self.heads))
        self.automaton.make_automaton()
        self.lengths = sorted({len(h) for h in self.heads}, reverse=True)

    def weight(self, word: str) -> float:
        """The entry of the word, or of its longest known beginning."""
        if word in self.words:
            return self.words[word]
        for n in self.lengths:
            if n <= len(word) and (w := self.heads.get(word[:n])) is not None:
                return w
        return 0.0

    def hits(self, words: list[str]) -> list[tuple[Symbol, float, float]]:
        """What the machine puts out for a clause's insults and threats: class and marks, strength, weight."""
        lexical = [self.weight(word) for word in words]
        read = [("I" if own else self.classes.get(word, "-"), "") for word, own in zip(words, lexical, strict=True)]
        # Backwards, for the hits whose target follows.
        state = self.backward.start
        for i in range(len(words) - 1, -1, -1):
            state, read[i], _ = self.backward.arcs[state, read[i]]
        state, out = self.machine.start, []
        for symbol, own in zip(read, lexical, strict=True):
            state, made, w = self.machine.arcs[state, symbol]
            if w:
                out.append((made, own or FIXED_WEIGHT, w))
        return out

    def clause(self, words: list[str]) -> float:
        """The machine's weight for a clause; the lexicon's weights scale the insults."""
        return sum(own * w for _, own, w in self.hits(words))

    def found(self, text: str) -> Iterator[tuple[int, int, list[tuple[Symbol, float, float]]]]:
        """(start, end, hits) of the clauses in which a lexicon entry, weak insult or threat stands."""
        low = text.lower()
        done, counted, quoted = 0, 0, False
        for end, (n, head) in self.automaton.iter(low):
            at = end - n + 1
            if at < done or (at and (low[at - 1].isalnum() or low[at - 1] == "_")) or not (head or end + 1 == len(low) or not low[end + 1].isalnum()):
                continue
            left = max([done, *(low.rfind(c, done, at) + 1 for c in ".!?;:\n|")])
            m = BREAK.search(low, end)
            right = m.start() if m else len(low)
            # A quotation of this line that an earlier clause has opened is still open.
            line = low.rfind("\n", counted, left)
            quoted = (quoted and line < 0) ^ bool(sum(low.count(c, max(counted, line), left) for c in '"“”«»') & 1)
            counted = left
            hits = self.hits([*('"' if quoted else ""), *TOKEN.findall(low, left, right)])
            done = right
            if hits:
                yield left, right, hits

    def clauses(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the clauses that weigh anything."""
        return [(a, b, sum(own * w for _, own, w in hits)) for a, b, hits in self.found(text)]

    def judged(self, text: str) -> tuple[list[float], int, float]:
        """The curve's features, the number of clauses with a hit, and the heaviest clause's weight."""
        clauses = [hits for _, _, hits in self.found(text)]
        return features(clauses, text), len(clauses), max((sum(own * w for _, own, w in hits) for hits in clauses), default=0.0)

    def score(self, text: str) -> float:
        return curve(self.model, self.judged(text)[0])


def features(clauses: list[list[tuple[Symbol, float, float]]], text: str) -> list[float]:
    """The features of ``PRIOR``, from the hits of a text's clauses."""
    strength = dict.fromkeys(("I", "It", "Ht", "Im", "Hm"), 0.0)
    for hits in clauses:
        for (base, marks), own, _ in hits:
            mark = "m" if "n" in marks or "r" in marks else "t" if "t" in marks else ""
            strength[("I" if base == "J" else base) + mark] += own / FIXED_WEIGHT
    attacks, words = strength["I"] + strength["It"] + strength["Ht"], 1 + text.count(" ")
    parts = (attacks, strength["It"], strength["Ht"], strength["Im"], strength["Hm"], math.log(words), 1000.0 * attacks / words)
    return [math.log1p(x) for x in parts]


def curve(model: Model, x: list[float]) -> float:
    z = model.curve[0] + sum(a * b for a, b in zip(model.curve[1:], x, strict=True))
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


# ------------------------------------------------------------------------------------ learning


def sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample_rows: int) -> DataFrame:
    """(id, text, y) of at most ``sample_rows`` labelled rows, chosen by a hash of the id."""
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("toxic").cast("int").alias("y"))
    known = known.orderBy(F.xxhash64(id_col), id_col).limit(sample_rows)
    # At most sample_rows rows of two numbers: the bound of this broadcast.
    return docs.select(docs[id_col], text_of(docs, text_col).alias("text")).join(F.broadcast(known), id_col)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: int | None = 0, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from ``labels`` (id, toxic); rows of the fold ``held`` aren't learned from."""
    if held is not None:
        labels = labels.where(fold(labels[id_col], TRAIN_FOLDS) != held)
    rows = written(sampled(docs, labels, id_col, text_col, sample_rows), "labelled")

    def count(batches):
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for pdf in batches:
            for text, y in zip(pdf["text"], pdf["y"], strict=True):
                seen[int(y)].update(set(TOKEN.findall(text.lower())))
                seen[int(y)][""] += 1
        found = sorted(seen[0] | seen[1])
        for at in range(0, len(found), 50_000):
            keys = found[at : at + 50_000]
            yield pd.DataFrame({"entry": keys, "bad": [seen[1][k] for k in keys], "good": [seen[0][k] for k in keys]})

    counted = rows.select("text", "y").mapInPandas(count, "entry string, bad long, good long")
    words = written(counted.groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "words")
    total = words.where("entry = ''").first()
    if not total or not total.bad or not total.good:
        return Model(fixed_lexicon())
    words = words.where("entry <> ''")
    sums = words.agg(F.count("*").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    own = telling(words, total.bad, total.good, sums.n or 1).withColumn("rank", F.col("w") * F.sqrt("bad"))
    begun = words.where(F.length("entry") > PREFIXES[0]).select(F.explode(F.array([F.when(F.length("entry") > n, F.substring("entry", 1, n)) for n in PREFIXES])).alias("entry"), "bad", "good").where("entry is not null")
    begun = begun.groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.max("bad").alias("most"), F.count(F.when(F.col("bad") > 0, 1)).alias("words"))
    begun = begun.where((F.col("words") >= LEAST_WORDS) & (F.col("most") <= LARGEST_SHARE * F.col("bad")))
    begun = telling(begun, sums.bad or 1, sums.good or 1, sums.n or 1).select(F.concat("entry", F.lit("*")).alias("entry"), "bad", "w", (F.col("w") * F.sqrt("bad")).alias("rank"))
    # LEXICON_SIZE is a parameter of the model, like the size of any vocabulary.
    kept = own.select("entry", "bad", "w", "rank").union(begun).orderBy(F.desc("rank"), "entry").limit(LEXICON_SIZE).collect()
    model = Model({r.entry: float(r.w) for r in kept} | fixed_lexicon())
    feature = F.pandas_udf(lambda texts: pd.Series([scorer_of(model).judged(t)[0] for t in texts]), "array<double>")
    table = rows.select(feature("text").alias("x"), "y").toPandas()  # at most sample_rows rows of seven numbers
    return Model(model.lexicon, logistic(np.array(table["x"].tolist(), float), table["y"].to_numpy(float)))


def telling(counts: DataFrame, n_bad: int, n_good: int, tried: int) -> DataFrame:
    """The entries whose odds for label 1 are strong (``w``) and, of so many tried, not chance."""
    bad, good = F.col("bad") + 0.5, F.col("good") + 0.5
    odds = F.log(bad / (n_bad + 1)) - F.log(good / (n_good + 1))
    share = n_bad / (n_bad + n_good)
    n = F.col("bad") + F.col("good")
    # Twice this is the likelihood ratio against the labels' own share.
    evidence = F.col("bad") * F.log(F.greatest(F.col("bad"), F.lit(0.5)) / (n * share)) + F.col("good") * F.log(F.greatest(F.col("good"), F.lit(0.5)) / (n * (1 - share)))
    return counts.withColumn("w", odds).where((F.col("w") > 2.0) & (evidence > math.log(tried) + 3.0))


_cached: dict[str, Scorer] = {}


def scorer_of(model: Model) -> Scorer:
    key = model.digest()
    if key not in _cached:
        _cached.clear()
        _cached[key] = Scorer(model)
    return _cached[key]


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, ...]:
    """Logistic regression by Newton's method, from the weights of ``PRIOR`` and held by their firmness."""
    x1 = np.column_stack([np.ones(len(x)), x])
    prior, firm = np.array(list(PRIOR.values())).T
    w = prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        g = x1.T @ (p - y) + firm * (w - prior)
        h = (x1 * (p * (1 - p) + 1e-9)[:, None]).T @ x1 + np.diag(firm)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 2.0 / np.abs(step).max()) if np.abs(step).max() else 0.0
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


# ------------------------------------------------------------------------------------ operators


def scoring(model: Model):
    """A function of a text column that gives struct<score, clauses, heaviest>."""

    @F.pandas_udf("struct<score:double,clauses:long,heaviest:double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for texts in batches:
            rows = []
            for t in texts:
                x, clauses, heaviest = scorer.judged(t)
                rows.append((curve(model, x), clauses, heaviest))
            yield pd.DataFrame(rows, columns=["score", "clauses", "heaviest"])

    return score


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted, and the heaviest clause's weight."""
    scored = docs.select(docs[id_col].alias(id_col), scoring(model)(text_of(docs, text_col)).alias("r"))
    held: Column = F.coalesce(fold(F.col(id_col), TRAIN_FOLDS) == 0, F.lit(False))
    return scored.select(id_col, held.alias("held_out"), "r.score", (F.col("r.score") >= 0.5).cast("int").alias("predicted"), "r.heaviest")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that score 0.5 or more."""
    name = fresh_name(docs, "toxic_score")
    return docs.withColumn(name, scoring(model)(text_of(docs, text_col))["score"]).where(F.col(name) < 0.5).drop(name)

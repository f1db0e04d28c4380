"""Rules that read two prompts and say why a stored answer must not be served.

Each rule takes what `text.read` made of the incoming and the stored prompt and returns its reason, or null to
accept. Rules are pure column expressions; a chain is the first reason, cheapest and most decisive rules first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import text as T
from palisade.functions.vocabulary import COORDINATORS, ENGLISH, Vocabulary


@dataclass(frozen=True)
class Guard:
    """name, and rejects(incoming, stored, response): a boolean column. Response is the stored answer, for rules that read it.

    symmetric: the verdict is the same with the prompts exchanged, so that one direction stands for both.
    """

    name: str
    rejects: Callable[[Column, Column, Column | None], Column]
    needs_response: bool = False
    symmetric: bool = False

    def reason(self, incoming: Column, stored: Column, response: Column | None = None) -> Column:
        if self.needs_response and response is None:
            return F.lit(None).cast("string")
        return F.when(F.coalesce(self.rejects(incoming, stored, response), F.lit(False)), F.lit(self.name))


@cache
def numeric() -> Guard:
    return Guard("numeric", lambda q, c, _: q["numbers"] != c["numbers"], symmetric=True)


@cache
def unit() -> Guard:
    def rejects(q, c, _):
        mine, theirs = F.array_except(q["units"], c["units"]), F.array_except(c["units"], q["units"])
        kinds = lambda u: F.transform(u, lambda x: x["dimension"])
        return F.arrays_overlap(kinds(mine), kinds(theirs))

    return Guard("unit", rejects, symmetric=True)


@cache
def temporal(vocabulary: Vocabulary = ENGLISH) -> Guard:
    return Guard("temporal", lambda q, c, _: (q["moments"] != c["moments"]) & T.differs_only_by(q["content"], c["content"], vocabulary.temporal, 0), symmetric=True)


@cache
def negation(vocabulary: Vocabulary = ENGLISH) -> Guard:
    return Guard("negation", lambda q, c, _: (q["negated"] != c["negated"]) & T.differs_only_by(q["content"], c["content"], vocabulary.negation, 1), symmetric=True)


@cache
def antonym(vocabulary: Vocabulary = ENGLISH) -> Guard:
    opposite: dict[str, list[str]] = {}
    for a, b in vocabulary.antonyms:
        opposite.setdefault(a, []).append(b)
        opposite.setdefault(b, []).append(a)
    if not opposite:
        return Guard("antonym", lambda q, c, _: F.lit(False))

    def rejects(q, c, _):
        table = T.table({w: "|".join(o) for w, o in opposite.items()})
        count = lambda p, w: F.size(F.filter(p["words"], lambda x: x == w))
        more = lambda w: count(q, w) > count(c, w)
        flipped = lambda w: F.exists(F.split(F.element_at(table, w), r"\|"), lambda o: count(c, o) > count(q, o))
        return F.exists(F.filter(F.array_distinct(q["words"]), lambda w: T.among(w, opposite)), lambda w: more(w) & flipped(w))

    return Guard("antonym", rejects, symmetric=True)


@cache
def entity(vocabulary: Vocabulary = ENGLISH) -> Guard:
    def spelled(name: Column, other: Column) -> Column:
        n = F.length(name)
        window = lambda i: F.slice(other["words"], i, n)
        initials = lambda i: F.array_join(F.transform(window(i), lambda w: F.substring(w, 1, 1)), "")
        places = F.when((n >= 3) & (n <= 6) & (F.size(other["words"]) >= n), F.sequence(F.lit(1), F.greatest(F.size(other["words"]) - n + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.exists(places, lambda i: (initials(i) == name) & F.forall(window(i), lambda w: ~T.among(w, vocabulary.stopwords)))

    def rejects(q, c, _):
        mine = F.filter(F.array_except(q["names"], c["names"]), lambda n: ~spelled(n, c))
        theirs = F.filter(F.array_except(c["names"], q["names"]), lambda n: ~spelled(n, q))
        return (F.size(q["names"]) > 0) & (F.size(c["names"]) > 0) & (F.size(mine) > 0) & (F.size(theirs) > 0)

    return Guard("entity", rejects, symmetric=True)


def _places(a: Column, b: Column, same: Callable[[Column, Column], Column]) -> Column:
    """The places (from 0) at which two lists of one length differ."""
    differ = F.zip_with(a, b, lambda x, y: ~same(x, y))
    return F.filter(F.transform(differ, lambda d, i: F.when(d, i)), lambda i: i.isNotNull())


@cache
def substitution(vocabulary: Vocabulary = ENGLISH, least: int = 4, most: int | None = None, head_least: int | None = None) -> Guard:
    def same(a: Column, b: Column) -> Column:
        unit = F.when(T.among(a, vocabulary.units) & T.among(b, vocabulary.units), F.element_at(T.unit_names(vocabulary), a) == F.element_at(T.unit_names(vocabulary), b)).otherwise(False)
        return T.same_word(a, b) | unit if vocabulary.units else T.same_word(a, b)

    def rejects(q, c, _):
        a, b = q["content"], c["content"]
        n, places = F.size(a), _places(a, b, same)
        hit = (n == F.size(b)) & (n >= least)
        if most is not None:
            hit = hit & (n <= most)
        # Sizes are tested first, so unequal lists are never walked.
        one = F.when(hit, F.size(places) == 1).otherwise(False)
        return one if head_least is None else one & ((F.get(places, F.lit(0)) > 0) | (n >= head_least))

    return Guard("substitution", rejects, symmetric=True)


@cache
def scope() -> Guard:
    def rejects(q, c, _):
        mine, theirs = F.array_except(q["shapes"], c["shapes"]), F.array_except(c["shapes"], q["shapes"])
        return (F.size(mine) > 0) & (F.size(theirs) > 0)

    return Guard("scope", rejects, symmetric=True)


@cache
def direction(vocabulary: Vocabulary = ENGLISH) -> Guard:
    def rejects(q, c, _):
        a, b = q["content"], c["content"]
        n = F.size(a)
        turned = F.exists(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.slice(F.concat(a, a), i, n) == b)
        turned = F.when(n == 2, F.exists(a, lambda w: T.among(w, vocabulary.direction))).otherwise(turned)
        first = F.get(_places(a, b, lambda x, y: x == y), F.lit(0))
        x, y = F.get(a, first), F.get(b, first)

        def either(p: Column) -> Column:
            w = p["words"]
            at = lambda i, k: F.get(w, i + k)
            pair = lambda i: ((at(i, 0) == x) & (at(i, 2) == y)) | ((at(i, 0) == y) & (at(i, 2) == x))
            listed = F.exists(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.coalesce(pair(i) & T.among(at(i, 1), COORDINATORS), F.lit(False)))
            return listed & ~F.array_contains(w, "than")

        moved = (n == F.size(b)) & (n > 0) & (a != b) & (F.array_sort(a) == F.array_sort(b))
        return F.when((q["directed"] | c["directed"]) & moved, ~turned & ~either(q) & ~either(c)).otherwise(False)

    return Guard("direction", rejects, symmetric=True)


@cache
def sub_span() -> Guard:
    def rejects(q, c, _):
        a, b = q["content"], c["content"]
        found = lambda w, words: F.array_contains(words, w) | F.exists(words, lambda x: T.same_word(w, x))
        inside = lambda short, long: F.forall(short, lambda w: found(w, long))

        def narrowed(long: Column, short: Column) -> Column:
            new = lambda s: F.exists(s["words"], lambda w: ~found(w, short))
            last = F.element_at(long["spans"], -1)
            return F.when(F.size(long["spans"]) > 0, (F.size(F.filter(long["spans"], new)) == 1) & new(last) & last["opener"].isNotNull() & ~last["framing"]).otherwise(False)

        return F.when((F.size(a) > F.size(b)) & inside(b, a), narrowed(q, b)).when((F.size(b) > F.size(a)) & inside(a, b), narrowed(c, a)).otherwise(False)

    return Guard("sub-span", rejects, symmetric=True)


def shared_words(a: Column, b: Column) -> Column:
    """How many words of a find a partner of their own in b, each taking the first that is left."""
    none = F.struct(b.alias("left"), F.lit(0).alias("shared"))

    def take(state: Column, word: Column) -> Column:
        match = F.transform(state["left"], lambda x, i: F.when(T.same_word(word, x), i))
        at = F.array_min(match)
        left = F.when(at.isNull(), state["left"]).otherwise(F.filter(state["left"], lambda x, i: i != at))
        return F.struct(left.alias("left"), (state["shared"] + F.when(at.isNull(), 0).otherwise(1)).alias("shared"))

    return F.aggregate(a, none, take, lambda s: s["shared"])


@cache
def lexical_divergence(least: float = 0.25, least_words: int = 5) -> Guard:
    def rejects(q, c, _):
        a, b = q["content"], c["content"]
        apart = lambda shared: shared / (F.size(a) + F.size(b) - shared) < least
        # Words in both lists: pairing loses half of them at most, so often there is nothing to pair.
        surely = F.size(F.array_intersect(a, b)) / 2
        long = (F.size(a) >= least_words) & (F.size(b) >= least_words)
        return F.when(~long, False).when(~apart(surely), False).otherwise(T.let(shared_words(a, b), apart))

    return Guard("lexical-divergence", rejects)


@cache
def length_ratio(most: float = 4.0) -> Guard:
    def rejects(q, c, _):
        a, b = F.size(q["words"]), F.size(c["words"])
        return F.when((a > 0) & (b > 0), F.greatest(a, b) / F.least(a, b) > most).otherwise(False)

    return Guard("length-ratio", rejects, symmetric=True)


@cache
def word_order(least_anchors: int = 2) -> Guard:
    def rejects(q, c, _):
        anchors = lambda p: F.array_union(p["names"], F.array_distinct(F.filter(p["words"], lambda w: w.rlike(r"\p{Nd}"))))
        shared = F.array_intersect(anchors(q), anchors(c))
        a, b = (F.filter(p["content"], lambda w: F.array_contains(shared, w)) for p in (q, c))
        moved = F.exists(F.transform(a, lambda w, i: F.exists(F.slice(a, i + 2, F.size(a)), lambda x: F.array_position(b, w) > F.array_position(b, x))), lambda m: m)
        return F.when((F.array_sort(q["content"]) == F.array_sort(c["content"])) & (F.size(shared) >= least_anchors), moved).otherwise(False)

    return Guard("word-order", rejects, symmetric=True)


@cache
def answer_anchor(most: int = 2) -> Guard:
    def rejects(q, c, response):
        a, b = q["content"], c["content"]
        places = _places(a, b, T.same_word)
        said = T.words(response)
        anchored = lambda w: ~F.exists(a, lambda x: T.same_word(x, w)) & F.exists(said, lambda x: T.same_word(x, w))
        return F.when(F.size(a) == F.size(b), F.size(places).between(1, most) & F.exists(places, lambda i: anchored(F.get(b, i)))).otherwise(False)

    return Guard("answer-anchor", rejects, needs_response=True)


def disjoint_terms(name: str, groups: dict[str, tuple[str, ...]]) -> Guard:
    """A rule for one field of knowledge: rejects when both prompts name groups and share none of them."""

    def rejects(q, c, _):
        table = T.table({term: group for group, terms in groups.items() for term in terms})
        mine, theirs = (F.array_distinct(F.transform(F.filter(p["words"], lambda w: T.among(w, [t for ts in groups.values() for t in ts])), lambda w: F.element_at(table, w))) for p in (q, c))
        return (F.size(mine) > 0) & (F.size(theirs) > 0) & ~F.arrays_overlap(mine, theirs)

    return Guard(name, rejects)


# The words that part a prompt's arguments.
RELATIONS = frozenset(["to", "than", "into", "versus", "vs", "over", "against", "before", "after"])


@cache
def slot_order(vocabulary: Vocabulary = ENGLISH, relations: frozenset[str] = RELATIONS) -> Guard:
    """An experiment: rejects when what stands before and after the last relation word is exchanged. A prompt with no
    relation word, or with different ones, says nothing."""

    def slots(p: Column) -> Column:
        w = p["words"]
        found = F.filter(F.transform(w, lambda x, i: F.when(T.among(x, relations), i)), lambda i: i.isNotNull())

        def cut(at: Column) -> Column:
            kept = lambda words: F.filter(words, lambda x: ~T.among(x, vocabulary.stopwords))
            return F.struct(F.get(w, at).alias("relation"), kept(F.slice(w, 1, at)).alias("before"), kept(F.slice(w, at + 2, F.size(w))).alias("after"))

        alone = F.size(F.array_distinct(F.transform(found, lambda i: F.get(w, i)))) == 1
        return F.when(alone, cut(F.array_max(found)))

    def rejects(q, c, _):
        a, b = slots(q), slots(c)
        swapped = (a["before"] == b["after"]) & (a["after"] == b["before"]) & (F.size(a["before"]) > 0) & (F.size(a["after"]) > 0)
        return (a["relation"] == b["relation"]) & swapped & ((a["before"] != b["before"]) | (a["after"] != b["after"]))

    return Guard("slot-order", rejects, symmetric=True)


# What partial evidence counts.
BELOW_FLOOR, TWO_PLACES, ONE_SIDED, MOVED, GAP, CONTAINED, CEILING, DIVERGED = 0.7, 0.5, 0.35, 0.4, 0.3, 0.5, 0.5, 0.6


def suspicion(q: Column, c: Column) -> Column:
    """An experiment: the evidence that eight readings of the rules nearly found, summed; the more of both directions."""
    return F.greatest(_suspicion(q, c), _suspicion(c, q))


def _suspicion(q: Column, c: Column) -> Column:
    a, b = q["content"], c["content"]
    la, lb = F.size(a), F.size(b)
    longer = F.greatest(la, lb, F.lit(1))
    found = lambda x, y: F.filter(x, lambda w: F.exists(y, lambda v: T.same_word(v, w)))
    apart = F.size(_places(a, b, T.same_word))
    swap = F.when((la != lb) | (la == 0), 0.0).when((apart == 1) & (la >= 4), 1.0).when(apart == 1, BELOW_FLOOR).when((apart == 2) & (la >= 4), TWO_PLACES).otherwise(0.0)
    mine, theirs = F.size(F.array_except(q["names"], c["names"])), F.size(F.array_except(c["names"], q["names"]))
    named = F.when((mine > 0) & (theirs > 0), 1.0).when((mine > 0) | (theirs > 0), ONE_SIDED).otherwise(0.0)
    number = F.when(numeric().reason(q, c).isNotNull(), 1.0).otherwise(0.0)
    ours, others = F.array_except(q["units"], c["units"]), F.array_except(c["units"], q["units"])
    measure = F.when((F.size(ours) == 0) | (F.size(others) == 0), 0.0).when(unit().reason(q, c).isNotNull(), 1.0).otherwise(ONE_SIDED)
    overlap = lambda shared: shared / (la + lb - shared)
    diverged = F.when((la == 0) | (lb == 0), 0.0).otherwise(T.let(F.size(found(a, b)), lambda n: F.when(overlap(n) >= CEILING, 0.0).otherwise((CEILING - overlap(n)) / CEILING * DIVERGED)))
    contained = F.when((la != lb) & ((F.size(found(a, b)) == la) | (F.size(found(b, a)) == lb)), CONTAINED).otherwise(0.0)
    moved = F.when((F.array_sort(a) == F.array_sort(b)) & (a != b), MOVED).otherwise(0.0)
    return swap + named + number + measure + diverged + contained + moved + F.abs(la - lb) / longer * GAP


# Chains ----------------------------------------------------------------------------------------------------------


def _standard(vocabulary: Vocabulary, swap: Guard | None) -> list[Guard]:
    chain = [numeric(), unit(), temporal(vocabulary), negation(vocabulary), antonym(vocabulary), entity(vocabulary), swap, scope(), direction(vocabulary), sub_span(), lexical_divergence()]
    return [g for g in chain if g is not None]


def standard(vocabulary: Vocabulary = ENGLISH) -> list[Guard]:
    return _standard(vocabulary, substitution(vocabulary))


def response_aware(vocabulary: Vocabulary = ENGLISH) -> list[Guard]:
    return [*standard(vocabulary), answer_anchor()]


def long_prompts(vocabulary: Vocabulary = ENGLISH) -> list[Guard]:
    return _standard(vocabulary, substitution(vocabulary, most=12))


def short_questions(vocabulary: Vocabulary = ENGLISH) -> list[Guard]:
    return _standard(vocabulary, substitution(vocabulary, least=3, head_least=4))


def prose(vocabulary: Vocabulary = ENGLISH) -> list[Guard]:
    return _standard(vocabulary, None)


def strict() -> list[Guard]:
    return [*standard()[:-1], lexical_divergence(0.35, 4), length_ratio(4.0)]


def none() -> list[Guard]:
    return []


PRESETS: dict[str, Callable[[], list[Guard]]] = {"standard": standard, "response_aware": response_aware, "long_prompts": long_prompts, "short_questions": short_questions, "prose": prose, "strict": strict, "none": none}


def first_rejection(guards: list[Guard], incoming: Column, stored: Column, response: Column | None = None) -> Column:
    """The first rule's reason, or null. Later rules aren't evaluated once one has rejected."""
    return F.coalesce(*(g.reason(incoming, stored, response) for g in guards), F.lit(None).cast("string"))


def first_rejections(rows: DataFrame, chains: dict[str, list[Guard]], incoming: str, stored: str, response: str | None = None) -> DataFrame:
    """Adds each chain's first reason under the chain's name. A rule that several chains have is evaluated once, and only
    where one of them has come to it."""
    said = F.col(response) if response else None
    columns: dict[Guard, str] = {}
    before = lambda chain, g: [F.col(columns[x]) for x in chain[: chain.index(g)]]
    ahead = [list(c) for c in chains.values()]
    while any(ahead):
        # The next rule is one that no chain still has something before.
        g = next(c[0] for c in ahead if c and not any(c[0] in other[1:] for other in ahead))
        open_ = [F.coalesce(*b).isNull() if (b := before(c, g)) else F.lit(True) for c in chains.values() if g in c]
        columns[g] = f"_rule{len(columns)}"
        rows = rows.withColumn(columns[g], F.when(reduce(or_, open_), g.reason(F.col(incoming), F.col(stored), said)))
        ahead = [c[1:] if c and c[0] is g else c for c in ahead]
    firsts = {n: F.coalesce(*(F.col(columns[g]) for g in c), F.lit(None).cast("string")) for n, c in chains.items()}
    return rows.withColumns(firsts).drop(*columns.values())


def verdicts(guards: list[Guard], incoming: Column, stored: Column, response: Column | None = None) -> Column:
    """Every rule's reason by its name, in order; null where it accepts."""
    if not guards:
        return F.lit(None).cast("map<string,string>")
    return F.create_map(*[x for g in guards for x in (F.lit(g.name), g.reason(incoming, stored, response))])


def either_way(guard: Guard, a: Column, b: Column) -> Column:
    """Whether the rule rejects the pair in one direction or the other."""
    one = guard.reason(a, b).isNotNull()
    return one if guard.symmetric else one | guard.reason(b, a).isNotNull()

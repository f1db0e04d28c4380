"""Reading prompts: words, numbers, units, names and spans, as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.vocabulary import ABBREVIATIONS, ENGLISH, FRAMING, Vocabulary

WORD = r"[\p{L}\p{N}]+"
#: Shortest word that a substituted letter leaves the same, longest ending, shortest rearrangement.
FUZZY_LENGTH, ENDING, REARRANGED_LENGTH = 5, 3, 4


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once: inside lambdas Spark would evaluate it again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def among(word: Column, words: Iterable[str]) -> Column:
    """Whether the word is listed. The list is one literal, so that plans stay small: a pattern that branches on the first letter."""
    return word.rlike(_pattern(frozenset(words)))


@cache
def _pattern(words: frozenset[str]) -> str:
    quoted = lambda x: x if x.isalnum() or not x else f"\\Q{x}\\E"
    by: dict[str, list[str]] = {}
    for w in sorted(words):
        by.setdefault(w[:1], []).append(quoted(w[1:]))
    return r"\A(?:" + "|".join(f"{quoted(first)}(?:{'|'.join(rest)})" for first, rest in by.items()) + r")\z" if by else r"\A\b\B"


def table(pairs: dict[str, str]) -> Column:
    """A map as one literal; neither side may hold a comma, a colon or a blank."""
    return F.str_to_map(F.lit(",".join(f"{k}:{v}" for k, v in sorted(pairs.items()))), F.lit(","), F.lit(":"))


def words(text: Column) -> Column:
    """All runs of letters or digits in lower case, in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 0), F.lower)


def content(tokens: Column, vocabulary: Vocabulary = ENGLISH) -> Column:
    """The words that aren't stopwords, the first of each."""
    return F.array_distinct(F.filter(tokens, lambda w: ~among(w, vocabulary.stopwords)))


def numbers(text: Column) -> Column:
    """The numbers, sorted, without grouping commas and with a decimal point for any other comma."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d+(?:[.,]\d+)*"), 0)
    return F.array_sort(F.transform(found, lambda n: F.replace(F.regexp_replace(n, r",(\d{3})(?!\d)", "$1"), F.lit(","), F.lit("."))))


def unit_names(vocabulary: Vocabulary) -> Column:
    return table({w: name for w, (name, _) in vocabulary.units.items()})


def units(tokens: Column, vocabulary: Vocabulary = ENGLISH) -> Column:
    """The units of measure: canonical name and dimension of each, once."""
    if not vocabulary.units:
        return F.array().cast("array<struct<name: string, dimension: string>>")
    kinds = table({w: kind for w, (_, kind) in vocabulary.units.items()})
    struct = lambda w: F.struct(F.element_at(unit_names(vocabulary), w).alias("name"), F.element_at(kinds, w).alias("dimension"))
    return F.array_distinct(F.transform(F.filter(tokens, lambda w: among(w, vocabulary.units)), struct))


def names(text: Column, vocabulary: Vocabulary = ENGLISH) -> Column:
    """The capitalised words that plausibly name something, in lower case, once each.

    The text falls into words and the gaps before them; a gap says whether its word opens a sentence.
    """
    text = F.coalesce(text, F.lit(""))

    def of(found: Column) -> Column:
        rows = F.zip_with(F.transform(found, lambda w, i: F.struct(w.alias("word"), F.lower(F.get(found, i - 1)).alias("before"))), F.split(text, WORD, -1), lambda w, g: F.struct(w["word"].alias("word"), w["before"].alias("before"), g.alias("gap")))
        return F.array_distinct(F.transform(F.filter(rows, named), lambda r: F.lower(r["word"])))

    def opens(r: Column) -> Column:
        end = F.regexp_extract(r["gap"], "[.?!]", 0)
        return F.when(end == "", False).when(end != ".", True).otherwise((F.length(r["before"]) > 1) & ~among(r["before"], ABBREVIATIONS))

    def named(r: Column) -> Column:
        low = F.lower(r["word"])
        return r["before"].isNotNull() & r["word"].rlike(r"^\p{Lu}") & (F.length(r["word"]) >= 2) & ~among(low, vocabulary.capitals) & ~(among(low, vocabulary.openers) & opens(r))

    return let(F.regexp_extract_all(text, F.lit(WORD), 0), of)


def spans(text: Column, vocabulary: Vocabulary = ENGLISH) -> Column:
    """Spans between clause punctuation and qualifiers: opener, content words, and whether the span is about the asker."""
    chunks = F.split(F.coalesce(text, F.lit("")), r"[,;:]|\s-\s", -1)

    def of(marked: Column) -> Column:
        opens = F.filter(F.transform(marked, lambda w, i: F.when((w == "") | among(w, vocabulary.qualifiers), i + 1)), lambda i: i.isNotNull())

        def cut(starts: Column) -> Column:
            ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(marked) + 1))
            return F.zip_with(starts, ends, lambda start, end: span(F.element_at(marked, start), F.slice(marked, start + 1, end - start - 1)))

        return F.filter(let(opens, cut), lambda s: F.size(s["words"]) > 0)

    def span(opener: Column, inner: Column) -> Column:
        return F.struct(
            F.nullif(opener, F.lit("")).alias("opener"),
            F.filter(inner, lambda w: ~among(w, vocabulary.stopwords)).alias("words"),
            F.exists(inner, lambda w: among(w, FRAMING)).alias("framing"),
        )

    return let(F.flatten(F.transform(chunks, lambda c: F.concat(F.array(F.lit("")), words(c)))), of)


def _rearranged(a: Column, b: Column) -> Column:
    letters = lambda w: F.array_sort(F.split(w, ""))
    return (F.length(a) == F.length(b)) & (F.length(a) >= REARRANGED_LENGTH) & a.rlike(r"\p{L}") & (letters(a) == letters(b))


def one_typo(a: Column, b: Column) -> Column:
    """One insertion, deletion, substitution or swap of neighbours turns one into the other."""
    letter = lambda w, i: F.substring(w, i, F.lit(1))
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: letter(a, i) != letter(b, i))
    first = F.get(places, F.lit(0))
    swapped = (F.length(a) == F.length(b)) & (F.size(places) == 2) & (F.get(places, F.lit(1)) == first + 1)
    swapped = swapped & (letter(a, first) == letter(b, first + 1)) & (letter(a, first + 1) == letter(b, first))
    far = F.levenshtein(a, b, 2)
    return far.between(0, 1) | ((far == 2) & swapped)


def same_word(a: Column, b: Column) -> Column:
    """One word written differently: equal, a typo, a rearrangement or an ending. Cheap tests come first."""
    la, lb = F.length(a), F.length(b)
    short = _rearranged(a, b) | ((la != lb) & (F.levenshtein(a, b, 1) == 1))
    ending = (F.abs(la - lb) <= ENDING) & F.when(la <= lb, F.startswith(b, a)).otherwise(F.startswith(a, b))
    long = ending | _rearranged(a, b) | ((F.abs(la - lb) <= 1) & one_typo(a, b))
    return F.when(a == b, True).when(F.abs(la - lb) > ENDING, False).when(F.least(la, lb) < FUZZY_LENGTH, short).otherwise(long)


def differs_only_by(a: Column, b: Column, ignored: Iterable[str], tolerance: int) -> Column:
    """Whether two lists of content words agree, but for ignored words, in all but `tolerance` places."""
    left, right = (F.filter(x, lambda w: ~among(w, ignored)) for x in (a, b))
    return (F.size(left) == F.size(right)) & (F.size(F.filter(F.zip_with(left, right, same_word), lambda s: ~s)) <= tolerance)


def read(text: Column, vocabulary: Vocabulary = ENGLISH) -> Column:
    """What the rules need to know of a prompt. Computed once for each prompt, before any pairing."""
    marked = lambda tokens, which: F.array_sort(F.array_distinct(F.filter(tokens, lambda w: among(w, which))))

    def of(tokens: Column) -> Column:
        return F.struct(
            text.alias("text"),
            tokens.alias("words"),
            content(tokens, vocabulary).alias("content"),
            numbers(text).alias("numbers"),
            units(tokens, vocabulary).alias("units"),
            names(text, vocabulary).alias("names"),
            marked(tokens, vocabulary.temporal).alias("moments"),
            marked(tokens, vocabulary.scope).alias("shapes"),
            (F.coalesce(F.lower(text), F.lit("")).contains("n't") | F.exists(tokens, lambda w: among(w, vocabulary.negation))).alias("negated"),
            F.exists(tokens, lambda w: among(w, vocabulary.direction)).alias("directed"),
            spans(text, vocabulary).alias("spans"),
        )

    return let(words(text), of)


def n_grams(text: Column, size: int = 4) -> Column:
    """The distinct character n-grams of the text in lower case, white space collapsed and a blank at both ends."""
    flat = F.concat(F.lit(" "), F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))), F.lit(" "))
    places = lambda t: F.sequence(F.lit(1), F.greatest(F.length(t) - size + 1, F.lit(1)))
    return let(flat, lambda t: F.array_distinct(F.transform(places(t), lambda i: F.substring(t, i, F.lit(size)))))


def jaccard(a: Column, b: Column) -> Column:
    both = F.struct(F.size(F.array_intersect(a, b)).alias("shared"), F.size(F.array_union(a, b)).alias("union"))
    return let(both, lambda s: F.when(s["union"] == 0, 0.0).otherwise(s["shared"] / s["union"]))


# The words that tell a prompt's register, and the bounds of the length bands.
_ASKING = ("what", "who", "whom", "whose", "where", "when", "why", "which", "how", "is", "are", "was", "were", "am", "be", "do", "does", "did", "can", "could", "should", "would", "will", "shall", "may", "might", "has", "have", "had")
_TELLING = (
    "explain", "define", "list", "show", "give", "write", "convert", "calculate", "find", "compare", "translate", "summarize", "summarise",
    "describe", "tell", "name", "create", "make", "generate", "set", "add", "remove", "install", "configure", "fix", "recommend", "suggest",
    "draft", "rewrite", "outline", "analyse", "analyze", "check", "review",
)
_VERB = r"\b(is|are|was|were|be|been|being|has|have|had|do|does|did|will|would|can|could|should|may|might|\w+ed|\w+s)\b"
_FRAGMENT_WORDS = 6
REGISTERS = ("question", "imperative", "fragment", "declarative", "mixed")
BAND_BOUNDS = (48, 96, 192, 384, 768, 1536)
BANDS = ("<48", "48-95", "96-191", "192-383", "384-767", "768-1535", "1536+")


def register(text: Column) -> Column:
    """question, imperative, fragment (up to six words without a verb form, or none) or declarative, by the first word."""
    low = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""))

    def of(found: Column) -> Column:
        first = F.get(found, F.lit(0))
        kind = F.when(F.size(found) == 0, "fragment").when(F.endswith(low, F.lit("?")) | among(first, _ASKING), "question").when(among(first, _TELLING), "imperative")
        return kind.when((F.size(found) <= _FRAGMENT_WORDS) & ~low.rlike(_VERB), "fragment").otherwise("declarative")

    return let(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}']+"), 0), of)


def pair_register(a: Column, b: Column) -> Column:
    """The register of both, or mixed."""
    return F.when(register(a) == register(b), register(a)).otherwise("mixed")


def length_band(a: Column, b: Column, bounds: tuple[int, ...] = BAND_BOUNDS) -> Column:
    """The band that the pair's mean length in whole characters falls into, by number from 0."""
    mean, band = F.floor((F.length(a) + F.length(b)) / 2), F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        band = F.when(mean < bounds[i], i).otherwise(band)
    return band

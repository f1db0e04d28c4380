"""What the engine's queries must return, as SQL for DuckDB."""

from __future__ import annotations

from palisade.functions.vocabulary import ABBREVIATIONS, COORDINATORS, ENGLISH, FRAMING
from palisade.plans import prompts
from palisade.plans.queries import THRESHOLD
from palisade.sources.readers import INSTRUCTION


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words)) + "]"


_WORDS = "list_transform(regexp_extract_all({t}, '[\\p{{L}}\\p{{N}}]+'), lambda w: lower(w))"


def _words(text: str) -> str:
    return _WORDS.format(t=text)


def _content(words: str) -> str:
    return f"list_filter({words}, lambda z, i: list_position({words}, z) = i AND NOT list_contains({_list(ENGLISH.stopwords)}, z))"


def _numbers(text: str) -> str:
    # The next character after three digits of a number is its end, a point or a comma: no lookahead is needed. Twice, for groups in a row.
    ungrouped = "n"
    for _ in range(2):
        ungrouped = f"regexp_replace({ungrouped}, ',(\\d{{3}})([.,]|$)', '\\1\\2', 'g')"
    return f"list_sort(list_transform(regexp_extract_all({text}, '\\d+(?:[.,]\\d+)*'), lambda n: replace({ungrouped}, ',', '.')))"


def _same(a: str, b: str) -> str:
    letters = f"(length({a}) = length({b}) AND length({a}) >= 4 AND regexp_matches({a}, '\\p{{L}}') AND list_sort(string_split({a}, '')) = list_sort(string_split({b}, '')))"
    return (
        f"(CASE WHEN {a} = {b} THEN true WHEN abs(length({a}) - length({b})) > 3 THEN false "
        f"WHEN least(length({a}), length({b})) < 5 THEN {letters} OR (length({a}) <> length({b}) AND levenshtein({a}, {b}) = 1) "
        f"ELSE starts_with({a}, {b}) OR starts_with({b}, {a}) OR {letters} OR (abs(length({a}) - length({b})) <= 1 AND damerau_levenshtein({a}, {b}) <= 1) END)"
    )


def _differ(x: str, y: str) -> str:
    """The places at which two lists of words differ."""
    return f"list_filter(range(1, len({x}) + 1), lambda i: NOT {_same(f'{x}[i]', f'{y}[i]')})"


_READ = f"""
WITH p AS ({prompts.ORDER_PAIRS}), w AS (
  SELECT *, {_words('a')} AS wa, {_words('b')} AS wb FROM p
), r AS (
  SELECT *, {_content('wa')} AS ca, {_content('wb')} AS cb FROM w
)
"""


def _guard(condition: str, more: str = "") -> str:
    return f"{_READ} {more} SELECT pair_id, coalesce({condition}, false) AS rejects FROM {'m' if more else 'r'}"


def _marked(words: str, which) -> str:
    return f"list_sort(list_distinct(list_filter({words}, lambda w: list_contains({_list(which)}, w))))"


def _only(which, tolerance: int) -> str:
    """Agreement but for marker words; as a further step m with the lists xa and xb."""
    drop = lambda c: f"list_filter({c}, lambda w: NOT list_contains({_list(which)}, w))"
    return f", m AS (SELECT *, {drop('ca')} AS xa, {drop('cb')} AS xb FROM r)", f"len(xa) = len(xb) AND len({_differ('xa', 'xb')}) <= {tolerance}"


_UNIT_NAMES = "map {" + ", ".join(f"'{w}': '{n}'" for w, (n, _) in ENGLISH.units.items()) + "}"
_UNIT_KINDS = "map {" + ", ".join(f"'{w}': '{k}'" for w, (_, k) in ENGLISH.units.items()) + "}"
_OPPOSITES = "[" + ", ".join(f"['{a}', '{b}'], ['{b}', '{a}']" for a, b in ENGLISH.antonyms) + "]"


def _unit_names(words: str) -> str:
    return f"list_distinct(list_transform(list_filter({words}, lambda w: list_contains({_list(ENGLISH.units)}, w)), lambda w: {_UNIT_NAMES}[w]))"


def _kinds(words: str, other: str) -> str:
    mine = f"list_filter({words}, lambda w: list_contains({_list(ENGLISH.units)}, w) AND NOT list_contains({other}, {_UNIT_NAMES}[w]))"
    return f"list_transform({mine}, lambda w: {_UNIT_KINDS}[w])"


_temporal_step, _temporal_only = _only(ENGLISH.temporal, 0)
_negation_step, _negation_only = _only(ENGLISH.negation, 1)
_NEGATED = "(contains(lower({t}), 'n''t') OR list_has_any({w}, " + _list(ENGLISH.negation) + "))"
_COUNT = "len(list_filter({w}, lambda x: x = {o}))"
_SUB_SAME = f"({_same('ca[i]', 'cb[i]')} OR (list_contains({_list(ENGLISH.units)}, ca[i]) AND list_contains({_list(ENGLISH.units)}, cb[i]) AND {_UNIT_NAMES}[ca[i]] = {_UNIT_NAMES}[cb[i]]))"


def _substitution(least: int, extra: str = "true") -> str:
    return _guard(f"len(ca) = len(cb) AND len(ca) >= {least} AND len(places) = 1 AND ({extra})", f", m AS (SELECT *, CASE WHEN len(ca) = len(cb) THEN list_filter(range(1, len(ca) + 1), lambda i: NOT {_SUB_SAME}) ELSE [] END AS places FROM r)")


_SHAPES_A, _SHAPES_B = _marked("wa", ENGLISH.scope), _marked("wb", ENGLISH.scope)

GUARD_SQL = {
    "guard_numeric": _guard(f"{_numbers('a')} <> {_numbers('b')}"),
    "guard_unit": _guard(f"list_has_any({_kinds('wa', 'ub')}, {_kinds('wb', 'ua')})", f", m AS (SELECT *, {_unit_names('wa')} AS ua, {_unit_names('wb')} AS ub FROM r)"),
    "guard_temporal": _guard(f"{_marked('wa', ENGLISH.temporal)} <> {_marked('wb', ENGLISH.temporal)} AND {_temporal_only}", _temporal_step),
    "guard_negation": _guard(f"{_NEGATED.format(t='a', w='wa')} <> {_NEGATED.format(t='b', w='wb')} AND {_negation_only}", _negation_step),
    "guard_antonym": _guard(f"len(list_filter({_OPPOSITES}, lambda o: {_COUNT.format(w='wa', o='o[1]')} > {_COUNT.format(w='wb', o='o[1]')} AND {_COUNT.format(w='wb', o='o[2]')} > {_COUNT.format(w='wa', o='o[2]')})) > 0"),
    "guard_substitution": _substitution(4),
    "guard_substitution_short": _substitution(3, "places[1] > 1 OR len(ca) >= 4"),
    "guard_substitution_long": _substitution(4, "len(ca) <= 12"),
    "guard_scope": _guard(f"len(list_filter({_SHAPES_A}, lambda x: NOT list_contains({_SHAPES_B}, x))) > 0 AND len(list_filter({_SHAPES_B}, lambda x: NOT list_contains({_SHAPES_A}, x))) > 0"),
    "guard_length_ratio": _guard("CASE WHEN len(wa) > 0 AND len(wb) > 0 THEN greatest(len(wa), len(wb)) / least(len(wa), len(wb)) > 4.0 ELSE false END"),
    "guard_answer_anchor": _guard(
        f"len(ca) = len(cb) AND len(places) BETWEEN 1 AND 2 AND len(list_filter(places, lambda i: len(list_filter(ca, lambda x: {_same('x', 'cb[i]')})) = 0 AND len(list_filter(said, lambda x: {_same('x', 'cb[i]')})) > 0)) > 0",
        f", m AS (SELECT *, CASE WHEN len(ca) = len(cb) THEN {_differ('ca', 'cb')} ELSE [] END AS places, {_words('concat($$It is about $$, b)')} AS said FROM r)",
    ),
}

# The whole chain -------------------------------------------------------------------------------------------------

_WORD = "'[\\p{L}\\p{N}]+'"


def _names(found: str, gaps: str) -> str:
    """Names of a text's words and of the gaps before them, the first of each."""
    end = f"regexp_extract({gaps}[i], '[.?!]')"
    opens = f"CASE WHEN {end} = '' THEN false WHEN {end} <> '.' THEN true ELSE length({found}[i - 1]) > 1 AND NOT list_contains({_list(ABBREVIATIONS)}, lower({found}[i - 1])) END"
    named = f"regexp_matches({found}[i], '^\\p{{Lu}}') AND length({found}[i]) >= 2 AND NOT list_contains({_list(ENGLISH.capitals)}, lower({found}[i])) AND NOT (list_contains({_list(ENGLISH.openers)}, lower({found}[i])) AND {opens})"
    return f"list_transform(list_filter(range(2, len({found}) + 1), lambda i: {named}), lambda i: lower({found}[i]))"


def _spans(marked: str, starts: str) -> str:
    """Spans as opener, words, framing; those without words are left out."""
    inner = f"{marked}[{starts}[k] + 1 : coalesce({starts}[k + 1], len({marked}) + 1) - 1]"
    span = f"{{'opener': nullif({marked}[{starts}[k]], ''), 'words': list_filter({inner}, lambda w: NOT list_contains({_list(ENGLISH.stopwords)}, w)), 'framing': list_has_any({inner}, {_list(FRAMING)})}}"
    return f"list_filter(list_transform(range(1, len({starts}) + 1), lambda k: {span}), lambda s: len(s.words) > 0)"


def _found(word: str, words: str) -> str:
    return f"(list_contains({words}, {word}) OR len(list_filter({words}, lambda v: {_same(word, 'v')})) > 0)"


def _spelled(name: str, words: str) -> str:
    part = f"{words}[i : i + length({name}) - 1]"
    return f"(length({name}) BETWEEN 3 AND 6 AND len(list_filter(range(1, len({words}) - length({name}) + 2), lambda i: array_to_string(list_transform({part}, lambda v: v[1]), '') = {name} AND NOT list_has_any({part}, {_list(ENGLISH.stopwords)}))) > 0)"


def _shared(a: str, b: str) -> str:
    """How many words of a find a partner of their own in b, each taking the first that is left."""
    at = f"coalesce(list_position(list_transform(s.l, lambda v: {_same('x.w', 'v')}), true), 0)"
    step = f"{{'l': list_filter(s.l, lambda v, i: i <> {at}), 'w': '', 'n': s.n + CASE WHEN {at} > 0 THEN 1 ELSE 0 END}}"
    return f"list_reduce(list_prepend({{'l': {b}, 'w': '', 'n': 0}}, list_transform({a}, lambda w: {{'l': []::VARCHAR[], 'w': w, 'n': 0}})), lambda s, x: {step}).n"


def _diverges(a: str, b: str, least: float = 0.25, words: int = 5) -> str:
    return f"(CASE WHEN len({a}) >= {words} AND len({b}) >= {words} THEN (SELECT n / (len({a}) + len({b}) - n) < {least} FROM (SELECT {_shared(a, b)} AS n)) ELSE false END)"


def _narrowed(spans: str, short: str) -> str:
    new = lambda s: f"len(list_filter({s}.words, lambda w: NOT {_found('w', short)})) > 0"
    last = f"{spans}[len({spans})]"
    return f"coalesce(len({spans}) > 0 AND len(list_filter({spans}, lambda s: {new('s')})) = 1 AND {new(last)} AND {last}.opener IS NOT NULL AND NOT {last}.framing, false)"


def _inside(short: str, long: str) -> str:
    return f"len(list_filter({short}, lambda w: NOT {_found('w', long)})) = 0"


def _either(words: str) -> str:
    pair = f"(({words}[i] = fx AND {words}[i + 2] = fy) OR ({words}[i] = fy AND {words}[i + 2] = fx))"
    return f"(len(list_filter(range(1, len({words}) - 1), lambda i: {pair} AND list_contains({_list(COORDINATORS)}, {words}[i + 1]))) > 0 AND NOT list_contains({words}, 'than'))"


def _drop(words: str, which) -> str:
    return f"list_filter({words}, lambda w: NOT list_contains({_list(which)}, w))"


RULES = ("numeric", "unit", "temporal", "negation", "antonym", "entity", "substitution", "scope", "direction", "sub-span", "lexical-divergence")
_G = {r: f"g_{r.replace('-', '_')}" for r in RULES}
_FIRST = "coalesce(" + ", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, c in _G.items()) + ")"


def _but_last(last: str) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, c in list(_G.items())[:-1]) + f", {last})"


#: The first rule that rejects with the prompts exchanged: only one rule reads them in order.
_FIRST_BACK = _but_last("CASE WHEN g_back THEN 'lexical-divergence' END")


def _chain(source: str) -> str:
    """Steps c1 to c5: the rows of source with a column for each rule about its texts a and b."""
    read = lambda t, k: f"{_words(t)} AS w{k}, regexp_extract_all({t}, {_WORD}) AS f{k}, string_split_regex({t}, {_WORD}) AS x{k}, flatten(list_transform(string_split_regex({t}, '[,;:]|\\s-\\s'), lambda c: list_prepend('', {_words('c')}))) AS m{k}"
    more = lambda k: f"{_content(f'w{k}')} AS c{k}, {_unit_names(f'w{k}')} AS u{k}, {_names(f'f{k}', f'x{k}')} AS e{k}, list_filter(range(1, len(m{k}) + 1), lambda i: m{k}[i] = '' OR list_contains({_list(ENGLISH.qualifiers)}, m{k}[i])) AS s{k}"
    third = lambda k: f"{_spans(f'm{k}', f's{k}')} AS p{k}, {_drop(f'c{k}', ENGLISH.temporal)} AS t{k}, {_drop(f'c{k}', ENGLISH.negation)} AS n{k}"
    exclusive = lambda x, y, w: f"len(list_filter({x}, lambda z: NOT list_contains({y}, z) AND NOT {_spelled('z', w)})) > 0"
    turned = f"CASE WHEN len(ca) = 2 THEN list_has_any(ca, {_list(ENGLISH.direction)}) ELSE len(list_filter(range(1, len(ca) + 1), lambda i: list_concat(ca, ca)[i : i + len(ca) - 1] = cb)) > 0 END"
    rules = {
        "numeric": f"{_numbers('a')} <> {_numbers('b')}",
        "unit": f"list_has_any({_kinds('wa', 'ub')}, {_kinds('wb', 'ua')})",
        "temporal": f"{_marked('wa', ENGLISH.temporal)} <> {_marked('wb', ENGLISH.temporal)} AND len(ta) = len(tb) AND len({_differ('ta', 'tb')}) = 0",
        "negation": f"{_NEGATED.format(t='a', w='wa')} <> {_NEGATED.format(t='b', w='wb')} AND len(na) = len(nb) AND len({_differ('na', 'nb')}) <= 1",
        "antonym": f"len(list_filter({_OPPOSITES}, lambda o: {_COUNT.format(w='wa', o='o[1]')} > {_COUNT.format(w='wb', o='o[1]')} AND {_COUNT.format(w='wb', o='o[2]')} > {_COUNT.format(w='wa', o='o[2]')})) > 0",
        "entity": f"{exclusive('ea', 'eb', 'wb')} AND {exclusive('eb', 'ea', 'wa')}",
        "substitution": f"len(ca) = len(cb) AND len(ca) >= 4 AND len(list_filter(range(1, len(ca) + 1), lambda i: NOT {_SUB_SAME})) = 1",
        "scope": f"len(list_filter({_SHAPES_A}, lambda x: NOT list_contains({_SHAPES_B}, x))) > 0 AND len(list_filter({_SHAPES_B}, lambda x: NOT list_contains({_SHAPES_A}, x))) > 0",
        "direction": f"(list_has_any(wa, {_list(ENGLISH.direction)}) OR list_has_any(wb, {_list(ENGLISH.direction)})) AND len(ca) > 0 AND len(ca) = len(cb) AND ca <> cb AND list_sort(ca) = list_sort(cb) AND NOT ({turned}) AND NOT {_either('wa')} AND NOT {_either('wb')}",
        "sub-span": f"CASE WHEN len(ca) > len(cb) AND {_inside('cb', 'ca')} THEN {_narrowed('pa', 'cb')} WHEN len(cb) > len(ca) AND {_inside('ca', 'cb')} THEN {_narrowed('pb', 'ca')} ELSE false END",
        "lexical-divergence": _diverges("ca", "cb"),
    }
    found = ", ".join(f"coalesce({rule}, false) AS {_G[name]}" for name, rule in rules.items())
    return f"""
c1 AS (SELECT *, {read('a', 'a')}, {read('b', 'b')} FROM {source}),
c2 AS (SELECT *, {more('a')}, {more('b')} FROM c1),
c3 AS (SELECT *, {third('a')}, {third('b')}, ca[list_filter(range(1, len(ca) + 1), lambda i: ca[i] <> cb[i])[1]] AS fx, cb[list_filter(range(1, len(ca) + 1), lambda i: ca[i] <> cb[i])[1]] AS fy FROM c2),
c4 AS (SELECT *, {found}, coalesce({_diverges('cb', 'ca')}, false) AS g_back FROM c3),
c5 AS (SELECT *, {_FIRST} AS guard_reason, {_FIRST_BACK} AS back_reason FROM c4)"""


_PAIRS = f"WITH p AS ({prompts.ORDER_PAIRS}), {_chain('p')}"
_STRICT = _but_last(f"CASE WHEN {_diverges('ca', 'cb', 0.35, 4)} THEN 'lexical-divergence' END, CASE WHEN len(wa) > 0 AND len(wb) > 0 AND greatest(len(wa), len(wb)) / least(len(wa), len(wb)) > 4.0 THEN 'length-ratio' END")
_PROSE = _FIRST.replace("CASE WHEN g_substitution THEN 'substitution' END, ", "")
_ANCHORS = "list_distinct(list_concat(e{k}, list_filter(w{k}, lambda w: regexp_matches(w, '\\p{{Nd}}'))))"
_MOVED = "len(list_filter(range(1, len(oa) + 1), lambda i: len(list_filter(range(i + 1, len(oa) + 1), lambda j: list_position(ob, oa[i]) > list_position(ob, oa[j]))) > 0)) > 0"
_PLACES = {"lisbon": "iberia", "madrid": "iberia", "vienna": "centre", "prague": "centre", "warsaw": "east"}
_GROUPS = "list_distinct(list_transform(list_filter({w}, lambda w: list_contains(" + _list(_PLACES) + ", w)), lambda w: map {{" + ", ".join(f"'{k}': '{v}'" for k, v in _PLACES.items()) + "}}[w]))"

GUARD_SQL |= {f"guard_{r.replace('-', '_')}": f"{_PAIRS} SELECT pair_id, {_G[r]} AS rejects FROM c4" for r in ("entity", "direction", "sub-span", "lexical-divergence")} | {
    "guard_chain": f"{_PAIRS} SELECT pair_id, guard_reason AS standard, {_STRICT} AS strict, {_PROSE} AS prose FROM c5",
    "guard_word_order": f"{_PAIRS}, o1 AS (SELECT *, list_intersect({_ANCHORS.format(k='a')}, {_ANCHORS.format(k='b')}) AS sh FROM c2), o2 AS (SELECT *, list_filter(ca, lambda w: list_contains(sh, w)) AS oa, list_filter(cb, lambda w: list_contains(sh, w)) AS ob FROM o1) SELECT pair_id, list_sort(ca) = list_sort(cb) AND len(sh) >= 2 AND {_MOVED} AS rejects FROM o2",
    "guard_field_terms": f"WITH p AS ({prompts.ORDER_PAIRS}), w AS (SELECT pair_id, {_GROUPS.format(w=_words('a'))} AS x, {_GROUPS.format(w=_words('b'))} AS y FROM p) SELECT pair_id, len(x) > 0 AND len(y) > 0 AND NOT list_has_any(x, y) AS rejects FROM w",
}

# Vectors ---------------------------------------------------------------------------------------------------------


def _dot(a: str, b: str) -> str:
    return f"list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE)), lambda s, x: s + x)"


_NORM = f"sqrt({_dot('embedding', 'embedding')})"
_Q, _E = f"q AS ({prompts.REQUESTS})", f"e AS ({prompts.ENTRIES})"
_NEAR = f"""
{_Q}, {_E}, s AS (
  SELECT q.query_id, e.entry_id, {_dot('q.embedding', 'e.embedding')} AS similarity FROM q JOIN e ON q.scope = e.scope
), n AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, entry_id) AS INTEGER) AS rank FROM s
)
"""


def _short(score: str, keep: int, codes: str) -> str:
    return f"""
WITH {_Q}, {_E}, qc AS (SELECT *, {codes} AS code FROM q), ec AS (SELECT *, {codes} AS code FROM e), s AS (
  SELECT qc.query_id, ec.entry_id, qc.embedding AS qv, ec.embedding AS ev, {score} AS score FROM qc JOIN ec ON qc.scope = ec.scope
), k AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS place FROM s
), x AS (
  SELECT query_id, entry_id, {_dot('qv', 'ev')} AS similarity FROM k WHERE place <= {keep}
), n AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, entry_id) AS INTEGER) AS rank FROM x
)
SELECT query_id, entry_id, similarity, rank FROM n WHERE rank <= 5
"""


_INT8 = "list_transform(embedding, lambda x: CAST(least(greatest(floor(x::DOUBLE * 127 + 0.5), -127), 127) AS INTEGER))"

# Lookups ---------------------------------------------------------------------------------------------------------

_JUDGED = f"""
{_NEAR}, c AS (
  SELECT n.*, q.scope, q.embedder AS qe, e.embedder AS ee, q.prompt AS a, e.prompt AS b, e.response FROM n JOIN q USING (query_id) JOIN e USING (entry_id) WHERE rank <= 5
), {_chain('c')}, v AS (SELECT *, b AS stored, a AS prompt FROM c5)
"""


def _decided(threshold: str, extra: str = "") -> str:
    return f"""
{_JUDGED}, t AS (SELECT *, {threshold} AS threshold FROM v), d AS (
  SELECT *, CASE WHEN similarity < threshold THEN 'BELOW_THRESHOLD' WHEN qe <> ee THEN 'EMBEDDER_MISMATCH'
    WHEN guard_reason IS NOT NULL THEN 'GUARD_REJECTED' END AS why,
    CASE WHEN similarity >= threshold AND qe = ee THEN guard_reason END AS guard
  FROM t
), f AS (
  SELECT query_id,
    min(CASE WHEN why IS NULL THEN rank END) AS hit,
    min(CASE WHEN why IS NOT NULL AND why <> 'BELOW_THRESHOLD' THEN rank END) AS refused,
    bool_or(similarity >= threshold AND qe <> ee) AS embedder_mismatch
  FROM d GROUP BY query_id
), out AS (
  SELECT q.query_id, q.scope, h.rank IS NOT NULL AS is_hit, h.entry_id, h.similarity, h.response,
    CASE WHEN h.rank IS NULL THEN coalesce(m.why, 'EMPTY_SCOPE') END AS reason,
    CASE WHEN h.rank IS NULL THEN m.guard END AS guard,
    CASE WHEN h.rank IS NULL THEN m.similarity END AS best_similarity,
    CASE WHEN h.rank IS NULL THEN m.stored END AS best_prompt,
    coalesce(f.embedder_mismatch, false) AS embedder_mismatch
  FROM q LEFT JOIN f USING (query_id)
  LEFT JOIN d h ON h.query_id = q.query_id AND h.rank = f.hit
  LEFT JOIN d m ON m.query_id = q.query_id AND m.rank = coalesce(f.refused, 1)
){extra}
"""


_STATS = """count(*) AS lookups, count(*) FILTER (WHERE is_hit) AS hits,
  count(*) FILTER (WHERE reason = 'EMPTY_SCOPE') AS miss_empty_scope, count(*) FILTER (WHERE reason = 'BELOW_THRESHOLD') AS miss_below_threshold,
  count(*) FILTER (WHERE reason = 'EMBEDDER_MISMATCH') AS miss_embedder_mismatch, count(*) FILTER (WHERE reason = 'GUARD_REJECTED') AS miss_guard_rejected,
  count(*) FILTER (WHERE reason = 'VERIFIER_REJECTED') AS miss_verifier_rejected, count(*) FILTER (WHERE embedder_mismatch) AS embedder_mismatches,
  count(*) - count(*) FILTER (WHERE is_hit) AS misses, count(*) FILTER (WHERE is_hit) / count(*) AS hit_rate,
  count(*) FILTER (WHERE reason = 'GUARD_REJECTED') / count(*) AS guard_rejection_rate"""

# Events and entries ----------------------------------------------------------------------------------------------

_SEEN = "s AS (SELECT event_id, event_type AS scope, concat('user ', CAST(user_id AS STRING)) AS prompt FROM events), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY scope, prompt ORDER BY event_id) AS INTEGER) AS sighting FROM s)"
_STORED = """st AS (
  SELECT concat(CAST(user_id AS STRING), '-', event_type) AS entry_id, event_type AS scope, event_id AS seq, concat('prompt ', CAST(event_id AS STRING)) AS prompt,
    props AS response, ts AS created_at, concat('k', CAST(event_id % 10 AS STRING)) AS tag, 8 + octet_length(encode(concat('prompt ', CAST(event_id AS STRING)))) + octet_length(encode(props)) + 128 AS bytes
  FROM events)"""
_LIVE = "epoch_us(created_at) + 432000000000 > epoch_us(TIMESTAMP '2024-01-20 00:00:00')"
_FOLD = f"""
WITH {_STORED}, l AS (
  SELECT entry_id, seq, tag AS has_tag, CASE WHEN seq % 97 = 0 THEN 'R' WHEN seq % 2003 = 0 THEN 'C' WHEN seq % 501 = 0 THEN 'T' ELSE 'P' END AS op, scope AS s0 FROM st
), lg AS (
  SELECT *, CASE WHEN op = 'T' AND seq % 2 = 0 THEN NULL ELSE s0 END AS scope FROM l
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY seq DESC) AS n FROM lg WHERE op IN ('P', 'R')) WHERE n = 1 AND op = 'P'
)
SELECT p.entry_id, p.seq FROM p
WHERE NOT EXISTS (SELECT 1 FROM lg c WHERE c.op = 'C' AND c.seq > p.seq AND (c.scope IS NULL OR c.scope = p.scope))
  AND NOT EXISTS (SELECT 1 FROM lg t WHERE t.op = 'T' AND t.seq > p.seq AND t.has_tag = p.has_tag AND (t.scope IS NULL OR t.scope = p.scope))
"""

# Scoring ---------------------------------------------------------------------------------------------------------

_CORPUS = f"""
WITH p0 AS ({prompts.ORDER_PAIRS}), p AS (SELECT *, kind IN ('same', 'typo', 'grouped') AS should_match FROM p0), {_chain('p')}, j AS (
  SELECT *, list_filter([{', '.join(f"CASE WHEN {c}{' OR g_back' if r == 'lexical-divergence' else ''} THEN '{r}' END" for r, c in _G.items())}], lambda x: x IS NOT NULL) AS rejecting,
    (guard_reason IS NULL) <> (back_reason IS NULL) AS disagrees FROM c5
), cs AS (
  SELECT kind, count(*) FILTER (WHERE NOT should_match) AS near_misses, count(*) FILTER (WHERE NOT should_match AND len(rejecting) > 0) AS caught,
    count(*) FILTER (WHERE should_match) AS paraphrases, count(*) FILTER (WHERE should_match AND len(rejecting) = 0) AS kept, count(*) FILTER (WHERE disagrees) AS direction_disagreements
  FROM j GROUP BY GROUPING SETS ((kind), ())
)
"""
_RULE_LIST = "[" + ", ".join(f"'{r}'" for r in RULES) + "]"


def _wilson(k: str, n: str, sign: str, edge: str) -> str:
    z, nd, p = "1.959964", f"CAST({n} AS DOUBLE)", f"({k} / {n})"
    bound = f"({p} + {z} * {z} / (2 * {nd})) / (1 + {z} * {z} / {nd}) {sign} {z} * sqrt({p} * (1 - {p}) / {nd} + {z} * {z} / (4 * {nd} * {nd})) / (1 + {z} * {z} / {nd})"
    return f"CASE WHEN {n} = 0 THEN {edge} ELSE {'greatest(0.0' if sign == '-' else 'least(1.0'}, {bound}) END"


_OUTCOMES = f"""
{_NEAR}, z AS (
  SELECT similarity, entry_id % 5 = 0 AS vetoed, (query_id + entry_id) % 3 <> 0 AS should_match FROM n WHERE rank <= 5
), gr AS (
  WITH RECURSIVE t(step, threshold) AS (SELECT 1, 0.10::DOUBLE UNION ALL SELECT step + 1, threshold + 0.01::DOUBLE FROM t WHERE threshold + 0.01::DOUBLE <= 0.35::DOUBLE + 1e-9) SELECT * FROM t
), cf AS (
  SELECT step, threshold,
    count(*) FILTER (WHERE should_match AND similarity >= threshold AND NOT vetoed) AS tp, count(*) FILTER (WHERE NOT should_match AND similarity >= threshold AND NOT vetoed) AS fp,
    count(*) FILTER (WHERE NOT should_match AND NOT (similarity >= threshold AND NOT vetoed)) AS tn, count(*) FILTER (WHERE should_match AND NOT (similarity >= threshold AND NOT vetoed)) AS fn
  FROM gr, z GROUP BY step, threshold
), oc AS (
  SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall, CASE WHEN fp + tn = 0 THEN 0.0 ELSE fp / (fp + tn) END AS false_hit_rate FROM cf
), of1 AS (
  SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM oc
)
"""

# The bands and registers as their definition has them.
_MEAN = "(length(a) + length(b)) // 2"
_BAND = f"CAST(CASE WHEN {_MEAN} < 48 THEN 0 WHEN {_MEAN} < 96 THEN 1 WHEN {_MEAN} < 192 THEN 2 WHEN {_MEAN} < 384 THEN 3 WHEN {_MEAN} < 768 THEN 4 WHEN {_MEAN} < 1536 THEN 5 ELSE 6 END AS INTEGER)"
_ASKS = "what who whom whose where when why which how is are was were am be do does did can could should would will shall may might has have had".split()
_TELLS = "explain define list show give write convert calculate find compare translate summarize summarise describe tell name create make generate set add remove install configure fix recommend suggest draft rewrite outline analyse analyze check review".split()
_VERB = "'\\b(is|are|was|were|be|been|being|has|have|had|do|does|did|will|would|can|could|should|may|might|\\w+ed|\\w+s)\\b'"
_BANDS = "(VALUES (0, '<48'), (1, '48-95'), (2, '96-191'), (3, '192-383'), (4, '384-767'), (5, '768-1535'), (6, '1536+')) AS bands(band, label)"
_REGISTERS = "(VALUES ('question'), ('imperative'), ('fragment'), ('declarative'), ('mixed')) AS registers(register)"


def _register(t: str) -> str:
    low = f"lower(regexp_replace({t}, '^\\s+|\\s+$', '', 'g'))"
    found = f"regexp_extract_all({low}, '[\\p{{L}}\\p{{N}}'']+')"
    return f"CASE WHEN len({found}) = 0 THEN 'fragment' WHEN {low} LIKE '%?' OR list_contains({_list(_ASKS)}, {found}[1]) THEN 'question' WHEN list_contains({_list(_TELLS)}, {found}[1]) THEN 'imperative' WHEN len({found}) <= 6 AND NOT regexp_matches({low}, {_VERB}) THEN 'fragment' ELSE 'declarative' END"


_PAIR_REGISTER = f"CASE WHEN {_register('a')} = {_register('b')} THEN {_register('a')} ELSE 'mixed' END"
_COUNTS = "count(j.pair_id) AS pairs, count(j.pair_id) FILTER (WHERE NOT should_match) AS near_misses, count(j.pair_id) FILTER (WHERE NOT should_match AND len(rejecting) > 0) AS caught, count(j.pair_id) FILTER (WHERE should_match) AS paraphrases, count(j.pair_id) FILTER (WHERE should_match AND len(rejecting) = 0) AS kept"


def _grams(t: str) -> str:
    flat = f"concat(' ', lower(trim(regexp_replace({t}, '\\s+', ' ', 'g'))), ' ')"
    return f"list_distinct(list_transform(range(1, greatest(length({flat}) - 3, 1) + 1), lambda i: substring({flat}, i, 4)))"


_JACCARD = f"WITH p AS ({prompts.ORDER_PAIRS}), g AS (SELECT pair_id, {_grams('a')} AS x, {_grams('b')} AS y FROM p), j AS (SELECT pair_id, len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) AS jaccard FROM g)"



def _walk(accepts: str) -> str:
    """Lookups without rules whose verifier is a condition on prompt, stored and similarity."""
    return f"""
WITH {_JUDGED}, d AS (
  SELECT *, CASE WHEN similarity < {THRESHOLD} THEN 'BELOW_THRESHOLD' WHEN qe <> ee THEN 'EMBEDDER_MISMATCH' WHEN NOT ({accepts}) THEN 'VERIFIER_REJECTED' END AS why FROM v
), f AS (
  SELECT query_id, min(CASE WHEN why IS NULL THEN rank END) AS hit, min(CASE WHEN why <> 'BELOW_THRESHOLD' THEN rank END) AS refused FROM d GROUP BY query_id
)
SELECT q.query_id, h.rank IS NOT NULL AS is_hit, h.entry_id, CASE WHEN h.rank IS NULL THEN coalesce(m.why, 'EMPTY_SCOPE') END AS reason
FROM q LEFT JOIN f USING (query_id) LEFT JOIN d h ON h.query_id = q.query_id AND h.rank = f.hit LEFT JOIN d m ON m.query_id = q.query_id AND m.rank = coalesce(f.refused, 1)"""


#: Decisions of ranked candidates n(query_id, entry_id, prompt, stored, qe, ee, similarity, rank) by one rule.
_NUMERIC_WALK = f"""d AS (
  SELECT *, CASE WHEN similarity < {{threshold}} THEN 'BELOW_THRESHOLD' WHEN qe <> ee THEN 'EMBEDDER_MISMATCH' WHEN {_numbers('prompt')} <> {_numbers('stored')} THEN 'GUARD_REJECTED' END AS why FROM n WHERE rank <= 5
), f AS (
  SELECT query_id, min(CASE WHEN why IS NULL THEN rank END) AS hit, min(CASE WHEN why <> 'BELOW_THRESHOLD' THEN rank END) AS refused FROM d GROUP BY query_id
)
SELECT q.query_id, h.rank IS NOT NULL AS is_hit, h.entry_id, CASE WHEN h.rank IS NULL THEN coalesce(m.why, 'EMPTY_SCOPE') END AS reason
FROM q LEFT JOIN f USING (query_id) LEFT JOIN d h ON h.query_id = q.query_id AND h.rank = f.hit LEFT JOIN d m ON m.query_id = q.query_id AND m.rank = coalesce(f.refused, 1)""".replace("\\d{3}", "\\d{{3}}")
_ANSWERED = f"""
WITH {_Q}, {_E}, s AS (
  SELECT q.query_id, e.entry_id, q.prompt, e.prompt AS stored, q.embedder AS qe, e.embedder AS ee, e.response, {_dot('q.embedding', 'e.embedding')} AS similarity FROM q JOIN e ON q.scope = e.scope
), n AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, entry_id) AS rank FROM s
), h AS (
  SELECT query_id, arg_min(response, rank) AS found FROM n WHERE rank <= 5 AND similarity >= {THRESHOLD} AND qe = ee AND {_numbers('prompt')} = {_numbers('stored')} GROUP BY query_id
), answered AS (
  SELECT q.query_id, q.scope, q.prompt, CASE WHEN q.query_id % 17 <> 0 AND found IS NOT NULL THEN found ELSE concat('made for ', q.prompt) END AS response,
    CASE WHEN q.query_id % 17 = 0 THEN 'degraded' WHEN found IS NOT NULL THEN 'hit' ELSE 'computed' END AS how FROM q LEFT JOIN h USING (query_id)
)"""
_EXCLUSIVE = "len(list_filter({x}, lambda z: NOT list_contains({y}, z))) > 0"


def _suspicion(k: str, o: str) -> str:
    """One direction's evidence, from the steps of _chain."""
    only, others = _EXCLUSIVE.format(x=f"e{k}", y=f"e{o}"), _EXCLUSIVE.format(x=f"e{o}", y=f"e{k}")
    units, foreign = _EXCLUSIVE.format(x=f"u{k}", y=f"u{o}"), _EXCLUSIVE.format(x=f"u{o}", y=f"u{k}")
    same = lambda x, y: f"len(list_filter({x}, lambda w: len(list_filter({y}, lambda v: {_same('v', 'w')})) > 0))"
    a, b = f"c{k}", f"c{o}"
    places = f"len({_differ(a, b)})"
    overlap = f"({same(a, b)} / (len({a}) + len({b}) - {same(a, b)}))"
    return (
        f"(CASE WHEN len({a}) <> len({b}) OR len({a}) = 0 THEN 0.0 WHEN {places} = 1 AND len({a}) >= 4 THEN 1.0 WHEN {places} = 1 THEN 0.7 WHEN {places} = 2 AND len({a}) >= 4 THEN 0.5 ELSE 0.0 END)::DOUBLE"
        f" + (CASE WHEN {only} AND {others} THEN 1.0 WHEN {only} OR {others} THEN 0.35 ELSE 0.0 END)::DOUBLE + (CASE WHEN g_numeric THEN 1.0 ELSE 0.0 END)::DOUBLE"
        f" + (CASE WHEN NOT ({units}) OR NOT ({foreign}) THEN 0.0 WHEN g_unit THEN 1.0 ELSE 0.35 END)::DOUBLE"
        f" + (CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 WHEN {overlap} >= 0.5 THEN 0.0 ELSE (0.5 - {overlap}) / 0.5 * 0.6 END)::DOUBLE"
        f" + (CASE WHEN len({a}) <> len({b}) AND ({same(a, b)} = len({a}) OR {same(b, a)} = len({b})) THEN 0.5 ELSE 0.0 END)::DOUBLE"
        f" + (CASE WHEN list_sort({a}) = list_sort({b}) AND {a} <> {b} THEN 0.4 ELSE 0.0 END)::DOUBLE + abs(len({a}) - len({b}))::DOUBLE / greatest(len({a}), len({b}), 1) * 0.3"
    )


_RELATIONS = "['to', 'than', 'into', 'versus', 'vs', 'over', 'against', 'before', 'after']"


def _slots(k: str) -> str:
    at = f"list_filter(range(1, len(w{k}) + 1), lambda i: list_contains({_RELATIONS}, w{k}[i]))"
    stop = f"list_contains({_list(ENGLISH.stopwords)}, w)"
    return f"len(list_distinct(list_filter(w{k}, lambda w: list_contains({_RELATIONS}, w)))) AS kinds{k}, w{k}[list_max({at})] AS rel{k}, list_filter(w{k}[: list_max({at}) - 1], lambda w: NOT {stop}) AS before{k}, list_filter(w{k}[list_max({at}) + 1 :], lambda w: NOT {stop}) AS after{k}"


ORACLES: dict[str, str] = GUARD_SQL | {
    "guard_suspicion": f"{_PAIRS} SELECT pair_id, round(greatest({_suspicion('a', 'b')}, {_suspicion('b', 'a')}), 9) AS suspicion FROM c4",
    "guard_slot_order": f"WITH p AS ({prompts.ORDER_PAIRS}), w AS (SELECT pair_id, {_words('a')} AS wa, {_words('b')} AS wb FROM p), s AS (SELECT *, {_slots('a')}, {_slots('b')} FROM w) SELECT pair_id, coalesce(kindsa = 1 AND kindsb = 1 AND rela = relb AND len(beforea) > 0 AND len(aftera) > 0 AND beforea = afterb AND aftera = beforeb AND (beforea <> beforeb OR aftera <> afterb), false) AS rejects FROM s",
    "guard_languages": """SELECT * FROM (VALUES
  ('it', 'Come attivare il registro', 'antonym'), ('it', 'Vorrei 3 grammi di farina', 'unit'), ('it', 'Spiega la fotosintesi', NULL),
  ('es', 'Cómo abrir una cuenta', 'antonym'), ('es', 'Qué tiempo hace hoy', 'temporal'), ('es', 'Escribe un poema', NULL),
  ('de', 'Datei verschlüsseln', 'antonym'), ('de', 'Wetter heute', 'temporal'), ('de', 'Erkläre den Satz', NULL),
  ('fr', 'Comment ajouter un compte', 'antonym'), ('fr', 'Courir 5 heures', 'unit'), ('fr', 'Décris le plan', NULL)) AS t(lang, a, guard)""",
    "text_envelopes": f"""
WITH RECURSIVE {_Q}, p AS (SELECT query_id, prompt, row_number() OVER (ORDER BY query_id) - 1 AS i, count(*) OVER () AS n FROM q), t(query_id, prompt, i, n, step, long, lines) AS (
  SELECT query_id, prompt, i, n, 1, {len(INSTRUCTION)} + length(prompt), '' FROM p
  UNION ALL SELECT t.query_id, t.prompt, t.i, t.n, t.step + 1, t.long + length(o.prompt) + 3, concat(t.lines, '- ', o.prompt, chr(10)) FROM t JOIN p o ON o.i = (t.i + t.step) % t.n WHERE t.long < 512 AND t.step < t.n
), l AS (SELECT query_id, prompt, arg_max(lines, step) AS lines FROM t GROUP BY 1, 2)
SELECT query_id AS pair_id, md5(concat('{INSTRUCTION}', chr(10), chr(10), 'Context:', chr(10), lines, chr(10), 'Question: ', prompt)) AS a_md5, length(concat('{INSTRUCTION}', chr(10), chr(10), 'Context:', chr(10), lines, chr(10), 'Question: ', prompt, '?')) AS b_length FROM l""",
    "vector_norms": f"SELECT vec_id, {_NORM} AS norm, abs({_NORM} - 1) <= 1e-4 AS unit, {_dot('embedding', 'u')} AS self_dot FROM (SELECT *, list_transform(embedding, lambda x: CAST(x::DOUBLE / {_NORM} AS FLOAT)) AS u FROM embeddings)",
    "vector_codes": f"SELECT vec_id, {_INT8} AS int8, [CAST(list_reduce(list_prepend(0::HUGEINT, list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN CASE WHEN i = 64 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << (i - 1)::INTEGER) END ELSE 0 END)), lambda s, x: s + x) AS BIGINT)] AS signs FROM embeddings",
    "nearest_in_scope": f"WITH {_NEAR} SELECT query_id, entry_id, similarity, rank FROM n WHERE rank <= 5",
    "nearest_int8": _short("list_sum(list_transform(range(1, 65), lambda i: CAST(qc.code[i] AS BIGINT) * ec.code[i]))", 20, _INT8),
    "nearest_binary": _short("len(list_filter(range(1, 65), lambda i: (qc.code[i] > 0) = (ec.code[i] > 0)))", 120, "embedding"),
    "visible_at_request": f"""
WITH {_Q}, {_E}, s AS (
  SELECT q.query_id, e.entry_id, {_dot('q.embedding', 'e.embedding')} AS similarity FROM q JOIN e ON q.scope = e.scope WHERE e.entry_id * 7919 % 100000 < q.query_id * 7919 % 100000
), n AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, entry_id) AS INTEGER) AS rank FROM s)
SELECT query_id, entry_id, similarity, rank FROM n WHERE rank <= 3""",
    "retrieval": f"WITH {_NEAR} SELECT query_id, entry_id FROM n WHERE rank = 1",
    "text_words": f"WITH w AS (SELECT conv_id, turn, {_words('text')} AS w FROM conversations), c AS (SELECT *, {_content('w')} AS c FROM w) SELECT conv_id, turn, len(w) AS n_words, len(c) AS n_content, array_to_string(c, ' ') AS content FROM c",
    "text_numbers": f"WITH p AS ({prompts.ORDER_PAIRS}) SELECT pair_id, array_to_string({_numbers('a')}, ' ') AS numbers_a, array_to_string({_numbers('b')}, ' ') AS numbers_b FROM p",
    "document_numbers": f"WITH n AS (SELECT doc_id, {_numbers('text')} AS n FROM documents) SELECT doc_id, len(n) AS n_numbers, array_to_string(n, ' ') AS numbers FROM n",
    "text_units": f"WITH p AS ({prompts.ORDER_PAIRS}), w AS (SELECT pair_id, {_words('a')} AS w FROM p) SELECT pair_id, array_to_string(list_sort({_unit_names('w')}), ' ') AS units FROM w",
    "text_ngrams": f"{_JACCARD} SELECT pair_id, jaccard FROM j",
    "text_similar_questions": f"{_JACCARD} SELECT pair_id FROM j WHERE jaccard >= 0.6",
    "text_names": f"{_PAIRS} SELECT pair_id, array_to_string(list_filter(ea, lambda z, i: list_position(ea, z) = i), ' ') AS names_a, array_to_string(list_filter(eb, lambda z, i: list_position(eb, z) = i), ' ') AS names_b FROM c2",
    "text_registers": f"WITH p AS ({prompts.ORDER_PAIRS}), r AS (SELECT {_PAIR_REGISTER} AS register, {_BAND} AS band FROM p) SELECT registers.register, bands.band, count(r.band) AS n FROM {_REGISTERS} CROSS JOIN {_BANDS} LEFT JOIN r ON r.register = registers.register AND r.band = bands.band GROUP BY 1, 2",
    "lookup_decisions": f"WITH {_decided(str(THRESHOLD))} SELECT * FROM out",
    "lookup_standard": f"WITH {_decided(str(THRESHOLD))} SELECT * FROM out",
    "lookup_scope_thresholds": f"WITH {_decided(f'CASE scope WHEN $$0$$ THEN 0.1 WHEN $$1$$ THEN 0.3 ELSE {THRESHOLD} END')} SELECT query_id, is_hit, entry_id, reason FROM out",
    "lookup_verified": f"""
WITH {_JUDGED}, d AS (
  SELECT *, CASE WHEN similarity < {THRESHOLD} THEN 'BELOW_THRESHOLD' WHEN qe <> ee THEN 'EMBEDDER_MISMATCH' WHEN right(prompt, 3) <> right(stored, 3) THEN 'VERIFIER_REJECTED' END AS why FROM v
), f AS (
  SELECT query_id, min(CASE WHEN why IS NULL THEN rank END) AS hit, min(CASE WHEN why <> 'BELOW_THRESHOLD' THEN rank END) AS refused FROM d GROUP BY query_id
)
SELECT q.query_id, h.rank IS NOT NULL AS is_hit, h.entry_id, CASE WHEN h.rank IS NULL THEN coalesce(m.why, 'EMPTY_SCOPE') END AS reason
FROM q LEFT JOIN f USING (query_id) LEFT JOIN d h ON h.query_id = q.query_id AND h.rank = f.hit LEFT JOIN d m ON m.query_id = q.query_id AND m.rank = coalesce(f.refused, 1)""",
    "lookup_explained": f"WITH {_JUDGED} SELECT query_id, entry_id, rank, similarity, similarity >= {THRESHOLD} AS above, qe = ee AS same_embedder, {', '.join(f"CASE WHEN {c} THEN '{r}' END AS {c.removeprefix('g_')}" for r, c in _G.items())} FROM v",
    "lookup_shadow": f"""
WITH {_JUDGED}, t AS (SELECT unnest([0.18, 0.22, 0.26])::DOUBLE AS threshold), x AS (
  SELECT query_id, threshold, rank, entry_id, similarity, stored, guard_reason AS guard FROM v, t WHERE similarity >= threshold
), f AS (
  SELECT query_id, threshold, min(CASE WHEN guard IS NULL THEN rank END) AS hit, min(CASE WHEN guard IS NOT NULL THEN rank END) AS refused FROM x GROUP BY 1, 2
)
SELECT q.query_id, t.threshold, h.rank IS NOT NULL AS would_hit, h.entry_id, CASE WHEN h.rank IS NULL THEN m.guard END AS guard,
  CASE WHEN h.rank IS NOT NULL THEN NULL WHEN m.rank IS NOT NULL THEN 'GUARD_REJECTED' WHEN b.rank IS NOT NULL THEN 'BELOW_THRESHOLD' ELSE 'EMPTY_SCOPE' END AS reason,
  CASE WHEN h.rank IS NOT NULL THEN h.similarity WHEN m.rank IS NOT NULL THEN m.similarity ELSE b.similarity END AS best_similarity,
  CASE WHEN h.rank IS NOT NULL THEN h.stored WHEN m.rank IS NOT NULL THEN m.stored ELSE b.stored END AS matched_prompt
FROM q CROSS JOIN t LEFT JOIN f ON f.query_id = q.query_id AND f.threshold = t.threshold
LEFT JOIN x h ON h.query_id = q.query_id AND h.threshold = t.threshold AND h.rank = f.hit LEFT JOIN x m ON m.query_id = q.query_id AND m.threshold = t.threshold AND m.rank = f.refused
LEFT JOIN v b ON b.query_id = q.query_id AND b.rank = 1""",
    "lookup_confident": _walk("similarity * 2 + CASE WHEN right(prompt, 3) = right(stored, 3) THEN 0.3 ELSE 0.0 END >= 0.75"),
    "lookup_recorded": _walk("right(prompt, 1) = right(stored, 1) AND (length(prompt) + length(stored)) % 3 = 0"),
    "lookup_tenants": f"""
WITH {_Q}, {_E}, s AS (
  SELECT q.query_id, e.entry_id, q.prompt, e.prompt AS stored, q.embedder AS qe, e.embedder AS ee, {_dot('q.embedding', 'e.embedding')} AS similarity FROM q JOIN e ON q.scope = e.scope AND (q.query_id // 2) % 3 = (e.entry_id // 2) % 3
), n AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, entry_id) AS rank FROM s
), {_NUMERIC_WALK.format(threshold='0.15')}""",
    "cache_answers": f"{_ANSWERED} SELECT query_id, response, how FROM answered",
    "cache_written": f"{_ANSWERED} SELECT md5(concat(scope, chr(31), prompt)) AS entry_id, scope, prompt, concat('made for ', prompt) AS response, min(query_id) AS first_query_id, CASE WHEN contains(prompt, 'tutorial') THEN 'no tutorials' END AS veto_reason FROM answered WHERE how = 'computed' GROUP BY scope, prompt",
    "cache_stats": f"{_ANSWERED}, w AS (SELECT DISTINCT scope, prompt FROM answered WHERE how = 'computed') SELECT count(*) FILTER (WHERE how <> 'degraded') AS lookups, count(*) FILTER (WHERE how = 'hit') AS hits, 0 AS exact_hits, count(*) FILTER (WHERE how = 'degraded') AS degraded, (SELECT count(*) FROM w WHERE NOT contains(prompt, 'tutorial')) AS writes, (SELECT count(*) FROM w WHERE contains(prompt, 'tutorial')) AS vetoed, count(*) FILTER (WHERE how = 'hit') / count(*) FILTER (WHERE how <> 'degraded') AS hit_rate FROM answered",
    "cache_exact": "SELECT q.doc_id AS query_id, md5(q.text) AS response, CASE WHEN EXISTS (SELECT 1 FROM documents e WHERE e.lang = q.lang AND e.text = q.text AND e.doc_id % 2 = 0) THEN 'exact_hit' ELSE 'computed' END AS how FROM documents q WHERE q.doc_id % 2 = 1 AND q.text IS NOT NULL",
    "lookup_exact": "SELECT q.doc_id AS query_id, max(e.doc_id) AS entry_id, 1.0::DOUBLE AS similarity FROM documents q JOIN documents e ON q.lang = e.lang AND q.text = e.text AND q.doc_id % 2 = 1 AND e.doc_id % 2 = 0 GROUP BY q.doc_id",
    "conversation_keys": """
WITH c AS (
  SELECT conv_id, turn, role, text, coalesce(string_agg(concat(upper(role), ': ', coalesce(text, ''), chr(10)), '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context FROM conversations
)
SELECT conv_id, turn, md5(concat(context, coalesce(text, ''))) AS key_md5, length(concat(context, coalesce(text, ''))) AS key_length FROM c WHERE role = 'user'""",
    "stats_total": f"WITH {_decided(str(THRESHOLD))} SELECT {_STATS} FROM out",
    "stats_by_scope": f"WITH {_decided(str(THRESHOLD))} SELECT scope, {_STATS} FROM out GROUP BY scope",
    "stats_guards": f"WITH {_decided(str(THRESHOLD))}, k AS (SELECT unnest({_RULE_LIST}) AS guard) SELECT k.guard, count(out.query_id) AS rejections FROM k LEFT JOIN out ON out.guard = k.guard GROUP BY k.guard",
    "stats_savings": """
WITH h AS (SELECT event_type AS scope, CASE WHEN event_id % 7 <> 0 THEN event_id % 50 END AS n_in, CASE WHEN event_id % 3 <> 0 THEN event_id % 90 END AS n_out FROM events),
s AS (SELECT scope, count(*) AS hits, CAST(coalesce(sum(n_in), 0) AS BIGINT) AS tokens_in, CAST(coalesce(sum(n_out), 0) AS BIGINT) AS tokens_out, count(*) FILTER (WHERE n_in IS NULL AND n_out IS NULL) AS uncounted FROM h GROUP BY scope),
p(scope, currency, price_in, price_out, price_call) AS (VALUES ('view', 'USD', 0.5::DOUBLE, 1.5::DOUBLE, 0.25::DOUBLE), ('click', 'EUR', 0.25, 1.0, 0.0), ('error', 'USD', 1.0, 2.0, 0.5))
SELECT scope, currency, hits, tokens_in, tokens_out, uncounted, tokens_in * price_in + tokens_out * price_out + hits * price_call AS saved FROM s JOIN p USING (scope)""",
    "stats_metrics": "SELECT event_type, json_extract_string(props, '$.k') AS tag, count(*) AS n, round(sum(value), 4) AS total, max(value) AS most FROM events GROUP BY 1, 2",
    "stats_spans": """
WITH e AS (SELECT event_id AS q, event_id * 1000 + 5000 AS t, event_id % 100 AS a, event_id % 37 AS b, event_id % 11 AS c FROM events)
SELECT q AS query_id, CAST(NULL AS VARCHAR) AS parent, 'lookup' AS name, t - a - b - c AS start_nanos, t AS end_nanos FROM e
UNION ALL SELECT q, 'lookup', 'embed', t - a - b - c, t - b - c FROM e WHERE a > 0
UNION ALL SELECT q, 'lookup', 'search', t - b - c, t - c FROM e WHERE b > 0 UNION ALL SELECT q, 'lookup', 'verify', t - c, t FROM e WHERE c > 0""",
    "stats_timers": """
WITH s AS (SELECT 'embed' AS stage, event_id % 100 AS nanos FROM events UNION ALL SELECT 'search', event_id % 37 FROM events UNION ALL SELECT 'verify', event_id % 11 FROM events WHERE event_id % 11 > 0)
SELECT stage, count(*) AS n, CAST(sum(nanos) AS BIGINT) AS total_nanos, max(nanos) AS longest_nanos FROM s GROUP BY stage""",
    "stats_log": "SELECT event_id, concat('event=', event_type, ' scope=u', CAST(user_id AS STRING), ' prompt=', CAST(length(props) AS STRING)) AS line FROM events",
    "admission_outcomes": f"WITH {_SEEN} SELECT event_id, sighting, CASE WHEN sighting > 2 THEN 'hit' WHEN sighting = 2 THEN 'stored' ELSE 'held_back' END AS outcome FROM k",
    "admission_rates": f"WITH {_SEEN}, t AS (SELECT unnest([1, 2, 3]) AS nth) SELECT nth, count(*) FILTER (WHERE sighting > nth) AS n_hit, count(*) FILTER (WHERE sighting = nth) AS n_stored, count(*) FILTER (WHERE sighting < nth) AS n_held_back, count(*) AS n_requests, count(*) FILTER (WHERE sighting > nth) / count(*) AS hit_rate FROM k, t GROUP BY nth",
    "admission_coalesced": f"WITH {_SEEN} SELECT scope, prompt, count(*) AS waiting, min(event_id) AS first_query_id FROM s GROUP BY 1, 2",
    "adaptive_thresholds": """
WITH RECURSIVE w AS (
  SELECT event_type AS scope, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 200 AS wd, value > 40 AS refused FROM events
), f AS (
  SELECT scope, wd, count(*) FILTER (WHERE refused) / 200 AS r FROM w GROUP BY 1, 2 HAVING count(*) = 200
), m AS (
  SELECT scope, wd, CASE WHEN r > 0.1 THEN 0.005 WHEN r < 0.05 THEN -0.005 ELSE 0.0 END::DOUBLE AS move FROM f
), t(scope, wd, threshold) AS (
  SELECT scope, wd, greatest(0.9::DOUBLE, least(0.98::DOUBLE, (0.9::DOUBLE + 0.98::DOUBLE) / 2 + move)) FROM m WHERE wd = 0
  UNION ALL SELECT m.scope, m.wd, greatest(0.9::DOUBLE, least(0.98::DOUBLE, t.threshold + m.move)) FROM t JOIN m ON m.scope = t.scope AND m.wd = t.wd + 1
)
SELECT scope, wd AS "window", threshold FROM t""",
    "score_corpus": f"{_CORPUS} SELECT near_misses, caught, paraphrases, kept, direction_disagreements, caught / near_misses AS catch_rate, {_wilson('caught', 'near_misses', '-', '0.0')} AS catch_low, {_wilson('caught', 'near_misses', '+', '1.0')} AS catch_high, kept / paraphrases AS retention, {_wilson('kept', 'paraphrases', '-', '0.0')} AS retention_low, {_wilson('kept', 'paraphrases', '+', '1.0')} AS retention_high FROM cs WHERE kind IS NULL",
    "score_by_kind": f"{_CORPUS} SELECT kind, near_misses, caught, paraphrases, kept, direction_disagreements FROM cs WHERE kind IS NOT NULL",
    "score_standard": f"{_CORPUS} SELECT kind, near_misses, caught, paraphrases, kept, direction_disagreements FROM cs WHERE kind IS NOT NULL",
    "score_by_guard": f"""{_CORPUS}, k AS (SELECT unnest({_RULE_LIST}) AS guard), x AS (
  SELECT k.guard, count(*) FILTER (WHERE NOT should_match AND list_contains(rejecting, k.guard)) AS caught, count(*) FILTER (WHERE NOT should_match AND rejecting = [k.guard]) AS "only",
    count(*) FILTER (WHERE should_match AND list_contains(rejecting, k.guard)) AS lost, count(*) FILTER (WHERE NOT should_match) AS nm FROM k, j GROUP BY k.guard)
SELECT guard, caught, "only", lost, CASE WHEN caught + lost > 0 THEN caught / (caught + lost) END AS precision, CASE WHEN nm > 0 THEN caught / nm END AS recall FROM x""",
    "score_breakdown": f"{_CORPUS}, b AS (SELECT kind, {_BAND} AS band, rejecting FROM j) SELECT kind, band, count(*) AS n, count(*) FILTER (WHERE len(rejecting) > 0) AS rejected FROM b GROUP BY GROUPING SETS ((kind), (band), ())",
    "score_by_band": f"{_CORPUS}, b AS (SELECT *, {_BAND} AS band FROM j) SELECT bands.band, bands.label, {_COUNTS.replace('j.', 'b.')} FROM {_BANDS} LEFT JOIN b ON b.band = bands.band GROUP BY 1, 2",
    "score_by_register": f"{_CORPUS}, b AS (SELECT *, {_PAIR_REGISTER} AS register FROM j) SELECT registers.register, {_COUNTS.replace('j.', 'b.')} FROM {_REGISTERS} LEFT JOIN b ON b.register = registers.register GROUP BY 1",
    "score_pairs": f"WITH e AS (SELECT vec_id, vec_id - vec_id % 10 AS other, list_transform(embedding, lambda x: CAST(x::DOUBLE / {_NORM} AS FLOAT)) AS u FROM embeddings) SELECT x.vec_id AS pair_id, x.vec_id % 3 = 0 AS should_match, round({_dot('x.u', 'y.u')}, 9) AS similarity, x.vec_id <> x.other AS vetoed FROM e x JOIN e y ON y.vec_id = x.other",
    "calibrate_trials": f"""
WITH p AS (SELECT unnest([0.05, 1.0, 5.0, 20.0, 60.0])::DOUBLE AS points), n AS (SELECT unnest(range(10, 1000001, 10)) AS n), k AS (
  SELECT points, n, floor(least(greatest(0.68::DOUBLE - points / 200, 0), 1) * n) AS lo, floor(least(greatest(0.68::DOUBLE + points / 200, 0), 1) * n) AS hi FROM p, n
), s AS (SELECT points, min(n) AS n FROM k WHERE {_wilson('lo', 'n', '+', '1.0')} < {_wilson('hi', 'n', '-', '0.0')} GROUP BY points)
SELECT points, CAST(coalesce(n, 2147483647) AS BIGINT) AS trials FROM p LEFT JOIN s USING (points)""",
    "calibrate_outcomes": f"WITH {_OUTCOMES} SELECT step, threshold, tp, fp, tn, fn, precision, recall, f1, false_hit_rate FROM of1",
    "calibrate_recommended": f"""
WITH {_OUTCOMES}
SELECT coalesce((SELECT threshold FROM of1 WHERE false_hit_rate <= 0.2 ORDER BY recall DESC, step LIMIT 1), (SELECT threshold FROM of1 ORDER BY false_hit_rate + 0.1 * (1 - recall), step LIMIT 1)) AS recommended,
  (SELECT min(threshold) FROM of1 WHERE fp = 0) AS safest, (SELECT threshold FROM of1 ORDER BY f1 DESC, step LIMIT 1) AS best_f1""",
    "calibrate_wilson": f"WITH c AS (SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 200000) AS k, count(*) AS n FROM orders GROUP BY 1) SELECT o_orderstatus, round({_wilson('k', 'n', '-', '0.0')}, 9) AS low, round({_wilson('k', 'n', '+', '1.0')}, 9) AS high FROM c",
    "verifier_costs": "WITH a AS (SELECT count(*) AS calls, count(DISTINCT user_id) AS lookups, CAST(sum(event_id % 30) AS BIGINT) AS tokens, count(*) FILTER (WHERE event_id % 4 <> 0 AND NOT value > 20) AS avoided FROM events) SELECT *, calls / lookups AS calls_per_lookup, tokens / calls AS tokens_per_call, tokens / avoided AS tokens_per_avoided FROM a",
    "verifier_cuts": "WITH c AS (SELECT unnest([0.05, 0.5, 0.9])::DOUBLE AS cut), a AS (SELECT cut, count(*) FILTER (WHERE event_id % 4 <> 0 AND value / 100 < cut) AS stopped, count(*) FILTER (WHERE event_id % 4 <> 0) AS near_misses, count(*) FILTER (WHERE event_id % 4 = 0 AND value / 100 >= cut) AS kept, count(*) FILTER (WHERE event_id % 4 = 0) AS paraphrases FROM events, c GROUP BY cut) SELECT *, stopped / near_misses AS stop_rate, kept / paraphrases AS keep_rate FROM a",
    "store_upsert": f"WITH {_STORED} SELECT entry_id, seq, prompt FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY seq DESC) AS n FROM st) WHERE n = 1",
    "store_live": f"WITH {_STORED} SELECT seq FROM st WHERE {_LIVE}",
    "store_expired_count": f"WITH {_STORED} SELECT count(*) FILTER (WHERE NOT ({_LIVE})) AS n_expired, count(*) FILTER (WHERE {_LIVE}) AS n_live FROM st",
    "store_sizes": f"WITH {_STORED} SELECT scope, count(*) AS n_entries FROM st WHERE {_LIVE} GROUP BY scope",
    "store_recent": f"""
WITH {_STORED}, u AS (SELECT entry_id, max(seq) AS seq FROM st GROUP BY entry_id), a AS (SELECT concat(CAST(user_id AS STRING), '-view') AS entry_id, max(event_id) + 1000000 AS used FROM events WHERE event_id % 13 = 0 GROUP BY 1)
SELECT entry_id FROM (SELECT u.entry_id, greatest(seq, coalesce(used, seq)) AS r FROM u LEFT JOIN a USING (entry_id) ORDER BY r DESC, entry_id LIMIT 100)""",
    "store_bytes": f"WITH {_STORED} SELECT seq FROM (SELECT seq, sum(bytes) OVER (ORDER BY seq DESC, entry_id) AS total FROM st) WHERE total <= 200000",
    "store_tags": f"WITH {_STORED} SELECT seq FROM st WHERE NOT (tag = 'k3' AND scope = 'view')",
    "store_tagged": f"WITH {_STORED} SELECT count(*) FILTER (WHERE tag = 'k3' AND scope = 'view') AS n_invalidated FROM st",
    "store_live_written": f"WITH {_STORED} SELECT seq FROM st WHERE {_LIVE.replace('432000000000', '518400000000')}",
    "cache_warm": f"WITH {_STORED} SELECT entry_id, max(seq) AS seq FROM st WHERE seq % 3 < 2 GROUP BY entry_id",
    "store_clear": f"WITH {_STORED} SELECT scope, count(*) AS n_entries FROM st WHERE scope <> 'click' GROUP BY scope",
    "store_remove": f"WITH {_STORED} SELECT seq FROM st WHERE entry_id NOT IN (SELECT entry_id FROM st WHERE seq % 10 = 0)",
    "store_log": _FOLD,
    "store_compacted": _FOLD,
    "store_encrypted": f"WITH {_STORED} SELECT seq, prompt, response FROM st",
    "store_vetoed": "SELECT CASE WHEN l.toxic = 1 THEN 'toxic' WHEN length(d.text) < 100 THEN 'short' END AS veto_reason, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1",
    "store_chunks": """
WITH d AS (SELECT doc_id, text, CASE WHEN length(text) >= 30 THEN [substring(text, 1, 10), substring(text, 11, 15), substring(text, 26)] ELSE [text] END AS c FROM documents)
SELECT doc_id AS entry_id, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS place, length(unnest(c)) AS n, md5(unnest(c)) AS chunk_md5 FROM d""",
    "store_faults": f"WITH {_STORED}, f AS (SELECT CASE WHEN seq % 50 = 0 THEN 'blank id' WHEN seq % 3 = 0 AND length(response) <> 1 THEN $$chunks don't make the response$$ END AS fault FROM st) SELECT fault, count(*) AS n FROM f GROUP BY 1",
    "store_point_ids": "WITH c AS (SELECT c_custkey, md5(c_name) AS m FROM customer) SELECT c_custkey, concat(m[1:8], '-', m[9:12], '-', m[13:16], '-', m[17:20], '-', m[21:32]) AS point_id FROM c",
    "store_near_duplicates": f"""
WITH {_E}, x AS (SELECT a.entry_id, b.entry_id AS replaces, {_dot('a.embedding', 'b.embedding')} AS similarity, a.prompt AS a, b.prompt AS b FROM e a JOIN e b ON a.scope = b.scope AND b.entry_id < a.entry_id AND a.embedder = b.embedder),
g AS (SELECT * FROM x WHERE similarity >= 0.2), {_chain('g')},
f AS (SELECT * FROM c5 WHERE guard_reason IS NULL AND back_reason IS NULL)
SELECT entry_id, replaces, similarity FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY similarity DESC, replaces) AS n FROM f) WHERE n = 1""",
    "stream_metrics": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS most FROM events GROUP BY 1, 2",
    "stream_answers": """
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text,
    count(*) FILTER (WHERE role <> 'assistant') OVER w AS breaks, count(*) FILTER (WHERE role = 'user') OVER w AS ends
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT e.conv_id AS stream_id, e.ends AS answer_no, md5(coalesce(string_agg(k.text, '' ORDER BY k.turn), '')) AS answer_md5, count(k.turn) FILTER (WHERE k.text <> '') AS n_chunks, count(k.turn) FILTER (WHERE k.text = '') AS n_empty
FROM c e LEFT JOIN c k ON k.conv_id = e.conv_id AND k.breaks = e.breaks AND k.role = 'assistant' AND k.turn < e.turn
WHERE e.role = 'user' GROUP BY e.conv_id, e.ends, e.turn""",
}

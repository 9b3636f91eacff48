"""SQL for DuckDB that says what the queries of ``forms`` return, written apart from the Column builders."""

from __future__ import annotations

# What the queries are given and what is fixed is spelled out here once more: nothing is taken from the code that is checked.
TARGETS = {"STATUS": ["Status", "Statut", "État"], "PRIORITY": ["Priority", "Priorité"], "SEGMENT": ["Segment", "Market"], "NATION": ["Nation", "Country"], "ZONE": ["Zone"]}
ID_LABELS = ["phase", "indice", "revision", "echelle", "format", "emetteur", "lot", "zone", "niveau", "numero", "n°", "affaire", "projet", "batiment", "type", "date"]
CONTACT_TERMS = ["rue", "avenue", "boulevard", "cedex", "immeuble", "constructeur", "mainteneur", "maitrise", "maitre d", "controle technique", "coordonnateur", "bureau d"]
ZONES = ["top-left", "top-center", "top-right", "middle-left", "middle-center", "middle-right", "bottom-left", "bottom-center", "bottom-right"]
CORNERS = ["bottom-right", "bottom-left", "top-right", "top-left"]
LABELS = [
    ["Status", "STATUT :", "Order status", "État"], ["Priority", "Priorité :", "Prio rity", "N° priority"], ["Segment", "Market segment", "SEGMENT", "Mkt"], ["Nation", "Country / Nation", "Pays", "NATION :"],
    ["Status", "Remarks", "Status priority", "Segment nation"],
]


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _values(rows: list[tuple], *names: str) -> str:
    shown = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) AS t({', '.join(names)})"


_TARGET_ROWS = [(i, n) for i, n in enumerate(TARGETS)]
_SYNONYM_ROWS = [(i, j, x) for i, n in enumerate(TARGETS) for j, x in enumerate(TARGETS[n])]
_CODE_ROWS = [("STATUS", i, c, c) for i, c in enumerate("OFP")] + [("PRIORITY", i, str(i), "") for i in range(1, 6)] + [("SEGMENT", i, c, "") for i, c in enumerate(["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])]
_VALUES = [
    "CASE WHEN o_orderkey % 3 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END",
    "CASE WHEN o_orderkey % 2 = 0 THEN '00' || substr(o_orderpriority, 1, 1) ELSE substr(o_orderpriority, 1, 1) END",
    "CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 2 = 0 THEN lower(c_mktsegment) ELSE ' ' || c_mktsegment END",
    "n_name",
    "CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'note ' || (o_orderkey % 97) END",
]
_PAIRS = " UNION ALL ".join(f"SELECT o_orderkey AS doc_id, {i} AS pair_idx, {_list(x)}[(o_orderkey % 4 + 1)::INT] AS label, {v} AS value FROM joined" for i, (x, v) in enumerate(zip(LABELS, _VALUES, strict=True)))
_JOINED = "joined AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, c_mktsegment, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
_FORMS = f"{_JOINED},\npairs AS ({_PAIRS})"


def _norm(x: str) -> str:
    plain = rf"regexp_replace(lower(strip_accents({x})), '[ \t\n\x0b\f\r]+', ' ', 'g')"
    return f"coalesce(trim(regexp_replace(trim({plain}), ':+$', '')), '')"


def _value_norm(x: str) -> str:
    return f"CASE WHEN regexp_full_match({_norm(x)}, '[0-9]+') THEN CASE WHEN ltrim({_norm(x)}, '0') = '' THEN '0' ELSE ltrim({_norm(x)}, '0') END ELSE {_norm(x)} END"


def _ratio(a: str, b: str) -> str:
    """Twice the longest common subsequence over both lengths, by folds over places."""
    cell = f"list_append(q, greatest(p[j + 1], q[j], p[j] + CASE WHEN substr({a}, j, 1) = substr({b}, i, 1) THEN 1 ELSE 0 END))"
    row = f"list_reduce(range(1, length({a}) + 1), lambda q, j: {cell}, [0])"
    lcs = f"list_reduce(range(1, length({b}) + 1), lambda p, i: {row}, list_transform(range(0, length({a}) + 1), lambda z: 0))[length({a}) + 1]"
    return f"CASE WHEN length({a}) + length({b}) = 0 OR length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE floor(200.0::DOUBLE * {lcs} / (length({a}) + length({b})) + 0.5::DOUBLE)::INT END"


def _word_list(x: str) -> str:
    return f"list_distinct(list_filter(string_split(lower(regexp_replace({x}, '[^A-Za-z0-9_]', ' ', 'g')), ' '), lambda w: w <> ''))"


def _scores(pairs: str) -> str:
    """CTEs that end in ``scores(a, b, ratio, token_set, similarity)`` of the different rows of ``pairs``."""
    both = "list_sort(list_filter(wa, lambda w: list_contains(wb, w)))"
    return f"""
ab AS (SELECT DISTINCT a, b FROM {pairs}),
ws AS (SELECT a, b, {_word_list("a")} AS wa, {_word_list("b")} AS wb FROM ab),
ts AS (
  SELECT a, b, array_to_string({both}, ' ') AS ti,
    array_to_string(list_concat({both}, list_sort(list_filter(wa, lambda w: NOT list_contains(wb, w)))), ' ') AS tx,
    array_to_string(list_concat({both}, list_sort(list_filter(wb, lambda w: NOT list_contains(wa, w)))), ' ') AS ty FROM ws),
rs AS (SELECT a, b, {_ratio("a", "b")} AS ratio, greatest({_ratio("ti", "tx")}, {_ratio("ti", "ty")}, {_ratio("tx", "ty")}) AS token_set FROM ts),
scores AS (SELECT *, greatest(ratio, token_set - 1) AS similarity FROM rs)"""


_TARGETS = f"targets AS (SELECT * FROM {_values(_TARGET_ROWS, 'target_idx', 'name')}),\nsynonyms AS (SELECT * FROM {_values(_SYNONYM_ROWS, 'target_idx', 'syn_idx', 'synonym')})"
_BEST = f"""
{_FORMS},
{_TARGETS},
labels AS (SELECT DISTINCT label, {_norm("label")} AS a FROM pairs),
words AS (SELECT *, {_norm("synonym")} AS b FROM synonyms),
asked AS (SELECT a, b FROM labels, words WHERE a <> '' AND b <> ''),
{_scores("asked")},
best AS (
  SELECT label, target_idx, similarity AS score, synonym FROM labels JOIN scores USING (a) JOIN words USING (b) WHERE similarity >= 60
  QUALIFY row_number() OVER (PARTITION BY label, target_idx ORDER BY similarity DESC, syn_idx) = 1)"""
_ASSIGN = """
cand AS (
  SELECT doc_id, pair_idx, target_idx, score, synonym, label, value,
    row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, trim(value) = '', target_idx, pair_idx) AS k
  FROM free JOIN best USING (label) ANTI JOIN done USING (doc_id, target_idx) WHERE score >= 80),
fold AS (
  SELECT doc_id, 0::BIGINT AS k, []::BIGINT[] AS t, []::BIGINT[] AS p, false AS taken FROM (SELECT DISTINCT doc_id FROM cand)
  UNION ALL
  SELECT c.doc_id, c.k, CASE WHEN list_contains(t, c.target_idx) OR list_contains(p, c.pair_idx) THEN t ELSE list_append(t, c.target_idx) END,
    CASE WHEN list_contains(t, c.target_idx) OR list_contains(p, c.pair_idx) THEN p ELSE list_append(p, c.pair_idx) END,
    NOT (list_contains(t, c.target_idx) OR list_contains(p, c.pair_idx))
  FROM fold JOIN cand c ON c.doc_id = fold.doc_id AND c.k = fold.k + 1),
chosen AS (SELECT cand.* FROM cand JOIN fold USING (doc_id, k) WHERE taken)"""
_LINK = f"""{_BEST},
free AS (SELECT * FROM pairs), done AS (SELECT 0::BIGINT AS doc_id, 0 AS target_idx WHERE false),{_ASSIGN}"""
#: Proposals in their order, each with the pairs that have its value; a step takes the first one left.
_PROPOSED = f"""{_BEST},
said AS (
  SELECT doc_id, pair_idx AS asg_idx, label, [{", ".join(f"'{n}'" for n in TARGETS)}][((pair_idx + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END) % 5 + 1)::INT] AS name,
    CASE WHEN doc_id % 4 = 0 AND pair_idx = 1 THEN 'invented' ELSE upper(value) END AS value FROM pairs WHERE pair_idx < 4),
props AS (SELECT doc_id, asg_idx, target_idx, {_norm("label")} AS l, {_norm("value")} AS v FROM said JOIN targets USING (name) WHERE trim(value) <> ''),
reads AS (SELECT doc_id, pair_idx, label, {_norm("label")} AS l, {_norm("value")} AS v FROM pairs),
steps AS (
  SELECT p.doc_id, p.target_idx, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.asg_idx) AS k,
    list(struct_pack(pair := r.pair_idx, score := coalesce(b.score, -1)) ORDER BY p.l <> r.l, r.pair_idx) AS o
  FROM props p JOIN reads r ON r.doc_id = p.doc_id AND r.v = p.v LEFT JOIN best b ON b.label = r.label AND b.target_idx = p.target_idx
  GROUP BY p.doc_id, p.asg_idx, p.target_idx),
walk AS (
  SELECT doc_id, 0::BIGINT AS k, []::BIGINT[] AS t, []::BIGINT[] AS p, NULL::BIGINT AS target_idx, NULL::BIGINT AS pair_idx, 0::BIGINT AS score, false AS taken FROM (SELECT DISTINCT doc_id FROM steps)
  UNION ALL
  SELECT doc_id, k, CASE WHEN good THEN list_append(t, target_idx) ELSE t END, CASE WHEN good THEN list_append(p, x.pair) ELSE p END, target_idx, x.pair, x.score, good
  FROM (
    SELECT *, coalesce(x.score >= 60 AND NOT list_contains(t, target_idx), false) AS good
    FROM (SELECT s.doc_id, s.k, w.t, w.p, s.target_idx::BIGINT AS target_idx, list_filter(s.o, lambda z: NOT list_contains(w.p, z.pair))[1] AS x FROM walk w JOIN steps s ON s.doc_id = w.doc_id AND s.k = w.k + 1))),
done AS (SELECT doc_id, target_idx, pair_idx, score FROM walk WHERE taken),
free AS (SELECT * FROM pairs ANTI JOIN done USING (doc_id, pair_idx)),{_ASSIGN}"""
_CODES = f"""
codes AS (
  SELECT field, ord, code FROM {_values(_CODE_ROWS, "field", "ord", "code", "libelle")}
  UNION ALL SELECT 'NATION', n_nationkey, n_name FROM nation)"""
_SAMPLES = """
samples AS (
  SELECT conv_id AS call_id, turn::INT AS sample_idx, (conv_id + turn) % 3 <> 0 AS found, (length(text) % 37)::INT AS n_pairs,
    (conv_id * 5 + turn) % 7 <> 0 AND conv_id % 10 <> 3 AS ok,
    ['bottom-right', 'bottom-right', 'top-left', 'unknown', 'unknown'][((conv_id * 3 + turn * turn) % 5 + 1)::INT] AS corner
  FROM conversations),
votes AS (SELECT *, 2 * sum(found::INT) OVER (PARTITION BY call_id) >= count(*) OVER (PARTITION BY call_id) AS majority FROM samples WHERE ok),
camp AS (SELECT * FROM votes WHERE found = majority)"""


def _any(x: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{t}')" for t in terms) + ")"


def _count(x: str) -> str:
    return f"CASE WHEN trim({x}) = '' THEN 0 ELSE len(string_split_regex(trim({x}), ' +')) END"


_FOLD = "lower(strip_accents({}))"
_SHORT = f"(trim(value) <> '' AND length(trim(value)) <= 14 AND {_count('value')} <= 3 AND regexp_matches(value, '[\\p{{L}}\\p{{Nd}}]'))"
_POINTS = (
    f"(CASE WHEN {_any(_FOLD.format('label'), ID_LABELS)} THEN 2 ELSE 0 END + CASE WHEN {_SHORT} THEN 1 ELSE 0 END"
    f" - CASE WHEN {_any(_FOLD.format('label'), CONTACT_TERMS)} OR {_any(_FOLD.format('value'), CONTACT_TERMS)} OR length(regexp_replace(value, '[^0-9]', '', 'g')) >= 7 OR contains(value, '@') OR regexp_matches(value, '\\b[0-9]{{5}}\\b') THEN 3 ELSE 0 END"
    f" - CASE WHEN {_count('value')} > 5 THEN 1 ELSE 0 END)"
)
_LABELS = ", ".join(f"'{v}'" for x in LABELS for v in x)


def _route() -> str:
    n = lambda m, s: f"((doc_id * {s} + i * 31) % {m})"
    stages = ", ".join(f"('{s}', {i})" for i, s in enumerate(["text", "boxed", "full", *(f"corner:{c}" for c in CORNERS)]))
    order = " ".join(f"WHEN '{c}' THEN {i + 1}" for i, c in enumerate(CORNERS))
    return f"""
WITH pages AS (
  SELECT o_orderkey AS doc_id, o_orderkey % 3 <> 0 AS large, o_orderkey % 6 * 60 AS text_chars, ['top-left', 'bottom-right', NULL][(o_orderkey % 7 % 3 + 1)::INT] AS zone,
    o_orderkey % 2 = 0 AS usable, CASE WHEN o_orderkey % 23 = 0 THEN 'top-left' END AS forced, o_orderkey % 19 <> 0 AS seen,
    (o_orderkey % 7)::DOUBLE / 20.0::DOUBLE + 0.1::DOUBLE AS cx, (o_orderkey % 11)::DOUBLE / 20.0::DOUBLE + 0.15::DOUBLE AS cy FROM orders),
named AS (
  SELECT *, coalesce(zone, CASE WHEN cy < 1.0::DOUBLE / 3 THEN 'top' WHEN cy > 2.0::DOUBLE / 3 THEN 'bottom' ELSE 'middle' END || '-' || CASE WHEN cx < 1.0::DOUBLE / 3 THEN 'left' WHEN cx > 2.0::DOUBLE / 3 THEN 'right' ELSE 'center' END) AS at_box FROM pages),
r0 AS (
  SELECT doc_id, stage, i, CASE WHEN doc_id % 43 = 0 AND i > 0 THEN 0 ELSE {n(6, 17)} END AS n_pairs
  FROM (SELECT o_orderkey AS doc_id, stage, i FROM orders, (VALUES {stages}) AS s(stage, i)) WHERE NOT (doc_id % 41 = 0 AND i > 2)),
r AS (SELECT doc_id, stage, n_pairs, {n(9, 29)} AS score, {n(5, 7)} = 0 AND n_pairs > 0 AS passes, {n(3, 11)} = 0 AND n_pairs > 0 AS mentions, substr(stage, 8) AS spot FROM r0),
c AS (
  SELECT r.*, CASE WHEN seen AND spot = zone THEN -1 ELSE CASE spot {order} END END AS ord FROM r JOIN pages USING (doc_id) WHERE stage LIKE 'corner:%'),
best AS (SELECT * FROM c WHERE passes QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY mentions DESC, score DESC, ord) = 1),
rich AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY mentions DESC, n_pairs DESC, ord) = 1),
j AS (
  SELECT p.*, t.passes AND t.mentions AS text_good, b.passes AND b.mentions AS box_good, b.passes AS box_passes, b.n_pairs AS box_n, b.mentions AS box_m, f.n_pairs AS full_n,
    best.spot AS best_at, rich.spot AS rich_at, rich.n_pairs AS rich_n, rich.mentions AS rich_m, coalesce(fc.passes, false) AS forced_passes
  FROM named p JOIN r t ON t.doc_id = p.doc_id AND t.stage = 'text' JOIN r b ON b.doc_id = p.doc_id AND b.stage = 'boxed' JOIN r f ON f.doc_id = p.doc_id AND f.stage = 'full'
  LEFT JOIN best ON best.doc_id = p.doc_id LEFT JOIN rich ON rich.doc_id = p.doc_id LEFT JOIN r fc ON fc.doc_id = p.doc_id AND fc.stage = 'corner:' || p.forced),
k AS (
  SELECT *, CASE WHEN text_chars >= 200 AND text_good THEN 1 WHEN large AND forced IS NOT NULL THEN 2 WHEN usable AND box_good THEN 3
    WHEN NOT large AND usable AND box_n > full_n THEN 4 WHEN NOT large THEN 5 WHEN best_at IS NOT NULL THEN 6
    WHEN usable AND (rich_at IS NULL OR box_m > rich_m OR (box_m = rich_m AND box_n > rich_n)) THEN 4 WHEN rich_n > 0 THEN 8 ELSE 9 END AS way FROM j)
SELECT doc_id, ['TEXT_LAYER', 'TWO_PASS_CROP', 'TWO_PASS_CROP', 'TWO_PASS_CROP', 'SINGLE_PAGE', 'TWO_PASS_CROP', '', 'TWO_PASS_CROP', 'NEEDS_TILING'][way] AS mode,
  CASE way WHEN 2 THEN forced WHEN 3 THEN at_box WHEN 4 THEN at_box WHEN 6 THEN best_at WHEN 8 THEN rich_at WHEN 9 THEN coalesce(zone, 'unknown') END AS corner,
  CASE way WHEN 2 THEN forced_passes WHEN 4 THEN box_passes WHEN 8 THEN false WHEN 9 THEN false ELSE true END AS quality_passed,
  [1, 1, 1, 1, 1, 4, 0, 4, 0][way]::INT AS attempts,
  CASE way WHEN 1 THEN 'text' WHEN 2 THEN 'corner:' || forced WHEN 3 THEN 'boxed' WHEN 4 THEN 'boxed' WHEN 5 THEN 'full' WHEN 6 THEN 'corner:' || best_at WHEN 8 THEN 'corner:' || rich_at END AS stage
FROM k"""


def _switches() -> str:
    """By hand: on a large page the route is forced top-right (every 5th), boxed (every 3rd), a corner, or none."""
    even, six = "(k % 2 = 0)", "(k % 2 = 0 AND k % 3 = 0)"
    # a corner that passes, the located one first; where none passes, the located one of equals
    free = "CASE WHEN k % 11 = 0 OR k % 4 <> 0 THEN 'top-left' ELSE 'top-right' END"
    unlocated = "CASE WHEN k % 4 = 0 THEN 'top-right' WHEN k % 11 = 0 THEN 'top-left' ELSE 'top-right' END"  # the fixed order decides
    crop, single = "'TWO_PASS_CROP'", "'SINGLE_PAGE'"
    ways = {
        "none": (f"CASE WHEN k % 7 = 0 THEN 'TEXT_LAYER' WHEN {even} THEN {crop} ELSE {single} END", f"CASE WHEN k % 7 = 0 THEN NULL WHEN {even} AND k % 5 = 0 THEN 'top-right' WHEN {six} THEN 'top-left' WHEN {even} THEN {free} END"),
        "text_layer": (f"CASE WHEN {even} THEN {crop} ELSE {single} END", f"CASE WHEN {even} AND k % 5 = 0 THEN 'top-right' WHEN {six} THEN 'top-left' WHEN {even} THEN {free} END"),
        "locate": (f"CASE WHEN {even} THEN {crop} ELSE {single} END", f"CASE WHEN {even} AND k % 5 = 0 THEN 'top-right' WHEN {even} THEN {unlocated} END"),
        "forced": (f"CASE WHEN {even} THEN {crop} ELSE {single} END", f"CASE WHEN {six} THEN 'top-left' WHEN {even} THEN {free} END"),
    }
    return " UNION ALL ".join(f"SELECT '{off}' AS off, mode, corner, count(*) AS n FROM (SELECT {mode} AS mode, {at} AS corner FROM (SELECT o_orderkey AS k FROM orders)) GROUP BY mode, corner" for off, (mode, at) in ways.items())


_REQUESTS = {
    "r0": [("STATUS", ["Status", "Statut", "État"], ["O", "F", "P"]), ("NATION", ["Nation", "Country"], []), ("STATUS", ["Segment"], [])],
    "r1": [("PRIORITY", ["Priority", "Priorité"], ["1", "2", "3"]), ("STATUS", ["Order status"], ["X"]), ("LOT", ["Lot"], ["BUILDING"])],
    "r2": [("ZONE", ["Nation"], ["FRANCE", "CHINA"]), ("PRIORITY", [], ["1"]), ("SEGMENT", ["Segment", "Market"], ["building", "Household"])],
}


def _extract() -> str:
    """CTEs that end in ``fields``, ``remaining`` and ``calls`` of the three requests."""
    targets = [(r, i, n) for r, x in _REQUESTS.items() for i, (n, _, _) in enumerate(x)]
    synonyms = [(r, i, j, y) for r, x in _REQUESTS.items() for i, (_, ys, _) in enumerate(x) for j, y in enumerate(ys)]
    codes = [(r, n, j, c) for r, x in _REQUESTS.items() for n, _, cs in x for j, c in enumerate(cs)]
    return f"""
{_JOINED},
every AS ({_PAIRS}),
calls AS (
  SELECT o_orderkey AS doc_id, 'r' || (o_orderkey % 3) AS request_id, o_orderkey % 13 = 0 AS bare, o_orderkey % 17 = 0 OR o_orderkey % 19 = 0 AS unread, o_orderkey % 4 = 0 AS texty FROM orders),
pairs AS (SELECT request_id, e.*, texty FROM every e JOIN calls USING (doc_id) WHERE NOT (bare OR unread)),
targets AS (SELECT * FROM {_values(targets, "request_id", "target_idx", "name")}),
synonyms AS (SELECT * FROM {_values(synonyms, "request_id", "target_idx", "syn_idx", "synonym")}),
codes AS (SELECT *, request_id || ' ' || code AS libelle FROM {_values(codes, "request_id", "field", "ord", "code")}),
labels AS (SELECT DISTINCT request_id, label, {_norm("label")} AS a FROM pairs),
words AS (SELECT *, {_norm("synonym")} AS b FROM synonyms),
asked AS (SELECT a, b FROM labels JOIN words USING (request_id)),
{_scores("asked")},
best AS (
  SELECT l.request_id, label, target_idx, similarity AS score, synonym FROM labels l JOIN words w ON w.request_id = l.request_id JOIN scores s ON s.a = l.a AND s.b = w.b WHERE similarity >= 60
  QUALIFY row_number() OVER (PARTITION BY l.request_id, label, target_idx ORDER BY similarity DESC, syn_idx) = 1),
done AS (
  SELECT p.request_id, doc_id, target_idx, pair_idx, score, synonym, label, value FROM pairs p JOIN best b USING (request_id, label)
  WHERE pair_idx = 0 AND texty AND target_idx = CASE request_id WHEN 'r0' THEN 0 WHEN 'r1' THEN 1 END),
served AS (SELECT d.doc_id, t.target_idx FROM done d JOIN targets t ON t.request_id = d.request_id AND t.name = 'STATUS'),
cand AS (
  SELECT p.request_id, p.doc_id, pair_idx, target_idx, score, synonym, label, value,
    row_number() OVER (PARTITION BY p.doc_id ORDER BY score DESC, trim(value) = '', target_idx, pair_idx) AS k
  FROM (SELECT * FROM pairs ANTI JOIN done USING (doc_id, pair_idx)) p JOIN best USING (request_id, label) ANTI JOIN served USING (doc_id, target_idx) WHERE score >= 80),
fold AS (
  SELECT doc_id, 0::BIGINT AS k, []::BIGINT[] AS t, []::BIGINT[] AS p, false AS taken FROM (SELECT DISTINCT doc_id FROM cand)
  UNION ALL
  SELECT c.doc_id, c.k, CASE WHEN list_contains(t, c.target_idx) OR list_contains(p, c.pair_idx) THEN t ELSE list_append(t, c.target_idx) END,
    CASE WHEN list_contains(t, c.target_idx) OR list_contains(p, c.pair_idx) THEN p ELSE list_append(p, c.pair_idx) END,
    NOT (list_contains(t, c.target_idx) OR list_contains(p, c.pair_idx))
  FROM fold JOIN cand c ON c.doc_id = fold.doc_id AND c.k = fold.k + 1),
chosen AS (
  SELECT request_id, doc_id, target_idx, pair_idx, score, synonym, label, value FROM cand JOIN fold USING (doc_id, k) WHERE taken
  UNION ALL SELECT * FROM done),
remaining AS (SELECT request_id, doc_id, pair_idx, label, value FROM pairs ANTI JOIN chosen USING (doc_id, pair_idx)),
firsts AS (SELECT *, min(target_idx) OVER (PARTITION BY request_id, name) AS source FROM targets),
seen AS (SELECT DISTINCT request_id, name, value, {_value_norm("value")} AS v FROM chosen JOIN targets USING (request_id, target_idx) WHERE trim(value) <> ''),
near AS (
  SELECT s.request_id, s.name, s.value, c.code, c.libelle, c.ord, {_ratio("v", "c")} AS s FROM seen s JOIN (SELECT *, {_value_norm("code")} AS c FROM codes) c ON c.request_id = s.request_id AND c.field = s.name),
hit AS (SELECT * FROM near WHERE s >= 85 QUALIFY row_number() OVER (PARTITION BY request_id, name, value ORDER BY s DESC, ord) = 1),
fields AS (
  SELECT d.request_id, d.doc_id, t.target_idx::INT AS target_idx, t.name, c.label, c.value, coalesce(c.score, 0)::INT AS score, c.synonym,
    CASE WHEN c.doc_id IS NULL THEN 'MISSING' WHEN h.code IS NULL THEN 'TO_REVIEW' ELSE 'AUTO_VALIDATED' END AS status, h.code, h.libelle AS code_label, h.s::INT AS code_score,
    CASE WHEN texty AND NOT bare AND NOT unread AND n_short >= 3 THEN 'TEXT_LAYER' ELSE 'SINGLE_PAGE' END AS mode, NOT unread AS found
  FROM calls d JOIN firsts t ON t.request_id = d.request_id LEFT JOIN chosen c ON c.doc_id = d.doc_id AND c.target_idx = t.source LEFT JOIN hit h ON h.request_id = d.request_id AND h.name = t.name AND h.value = c.value
  LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE trim(value) <> '' AND {_count("label")} <= 6 AND {_count("value")} <= 6) AS n_short FROM pairs GROUP BY doc_id) n ON n.doc_id = d.doc_id)"""


def _requests() -> str:
    """The bodies as text, with the escapes of JSON."""
    text = '{"type":"string"}'
    pair = f'"label":{text},"value":{text}'
    item = lambda own, names: '{"type":"object","properties":{' + own + '},"required":[' + names + '],"additionalProperties":false}'
    found = '"cartoucheFound":{"type":"boolean"},"fields":{"type":"array","items":' + item(pair, '"label","value"') + "}"
    schema = lambda own, names: '{"type":"json_schema","json_schema":{"name":"extraction","schema":' + item(own, names) + ',"strict":true}}'
    head, tail = schema(found + ',"assignments":{"type":"array","items":' + item('"field":{"type":"string","enum":@},' + pair, '"field","label","value"') + "}", '"cartoucheFound","fields","assignments"').split("@")
    sides = item(",".join(f'"{c}":' + '{"type":"number"}' for c in ("left", "top", "right", "bottom")), '"left","top","right","bottom"')
    place = item(f'"cartoucheFound":{{"type":"boolean"}},"box":{sides},"corner":{{"type":"string","enum":["top-left","unknown"]}},"rotation":{{"type":"string","enum":["none","180"]}}', '"cartoucheFound","box","corner","rotation"')
    location = '{"type":"json_schema","json_schema":{"name":"location","schema":' + place + ',"strict":true}}'
    plain = schema(found, '"cartoucheFound","fields"')
    return f"""
WITH d AS (
  SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN '{plain}' ELSE '{head}["' || o_orderstatus || '"]{tail}' END AS f,
    'Read.' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '\\nFill:\\n- ' || o_orderstatus || CASE WHEN o_orderkey % 2 = 0 THEN ' (labels: ' || o_orderpriority || ', say \\"x\\")' ELSE '' END END AS p,
    'Find.' || CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 2 <> 0 THEN '' ELSE ' Labels: ' || o_orderpriority || ', say \\"x\\".' END AS l,
    'data:image/png;base64,' || to_base64(encode(CASE WHEN o_orderkey % 5 = 0 THEN 'image' ELSE o_orderstatus END)) AS u FROM orders),
b AS (
  SELECT doc_id,
    '{{"model":"m-1","response_format":' || f || ',"max_completion_tokens":900,"reasoning_effort":"low","temperature":0.0,"seed":7,"messages":[{{"role":"system","content":"be exact"}},{{"role":"user","content":"' || p || '\\n\\nline\\n\\"' || doc_id || '"}}]}}' AS text_body,
    '{{"model":"m-1","response_format":' || f || ',"max_completion_tokens":900,"reasoning_effort":"low","temperature":0.0,"seed":7,"messages":[{{"role":"system","content":"be exact"}},{{"role":"user","content":[{{"type":"text","text":"' || p || '"}},{{"type":"image_url","image_url":{{"url":"' || u || '","detail":"high"}}}}]}}]}}' AS image_body,
    '{{"model":"m-2","response_format":{location},"messages":[{{"role":"system","content":""}},{{"role":"user","content":[{{"type":"text","text":"' || l || '"}},{{"type":"image_url","image_url":{{"url":"' || u || '"}}}}]}}]}}' AS plain_body,
    '{{"model":"m-1","document_annotation_format":' || f || ',"document_annotation_prompt":"' || p || '","include_image_base64":false,"document":{{"type":"image_url","image_url":"' || u || '"}}}}' AS ocr_body FROM d)
SELECT *, sha256(text_body) AS text_key, sha256(image_body) AS image_key, sha256(plain_body) AS plain_key, sha256(ocr_body) AS ocr_key FROM b"""


def _regions() -> str:
    names = ", ".join(f"'{z}'" for z in [*ZONES, "unknown"])
    clamp = lambda v: f"least(greatest({v}, 0.0::DOUBLE), 1.0::DOUBLE)"
    side = lambda m, d: f"((k % {m})::DOUBLE / {d}.0::DOUBLE)"
    return f"""
WITH a AS (SELECT l_orderkey, l_linenumber, l_orderkey * 7 + l_linenumber * 13 + l_partkey AS k FROM lineitem),
b AS (SELECT *, {clamp(side(101, 100))} AS x, {clamp(side(89, 100))} AS y, {clamp(side(97, 80))} AS r, {clamp(side(83, 70))} AS m, [{names}][(k % 10 + 1)::INT] AS zn FROM a),
c AS (SELECT *, r - x AS w, m - y AS h FROM b WHERE r - x >= 0.02::DOUBLE AND m - y >= 0.02::DOUBLE),
z AS (
  SELECT *, CASE WHEN zn IN ('unknown', 'middle-center') THEN 1.0 WHEN zn LIKE '%center' THEN 0.7 ELSE 0.4 END::DOUBLE AS iw,
    CASE WHEN zn IN ('unknown', 'middle-center') THEN 1.0 WHEN zn LIKE 'middle%' THEN 0.7 ELSE 0.4 END::DOUBLE AS ih FROM c),
i AS (
  SELECT *, CASE WHEN iw = 1 OR zn LIKE '%left' THEN 0.0::DOUBLE WHEN zn LIKE '%right' THEN 1 - iw ELSE (1 - iw) / 2 END AS ix,
    CASE WHEN ih = 1 OR zn LIKE 'top%' THEN 0.0::DOUBLE WHEN zn LIKE 'bottom%' THEN 1 - ih ELSE (1 - ih) / 2 END AS iy FROM z),
p AS (SELECT *, ix + x * iw AS px, iy + y * ih AS py, w * iw AS pw, h * ih AS ph FROM i),
g AS (SELECT *, greatest(0.02::DOUBLE, 0.05::DOUBLE * greatest(pw, ph)) AS mg FROM p),
t AS (SELECT *, {clamp("px - mg")} AS tx, {clamp("py - mg")} AS ty, {clamp("px + pw + mg")} - {clamp("px - mg")} AS tw, {clamp("py + ph + mg")} - {clamp("py - mg")} AS th FROM g),
f AS (SELECT *, tw * th <= CASE WHEN k % 2 = 0 THEN 0.35::DOUBLE ELSE 0.70::DOUBLE END AS fits FROM t)
SELECT l_orderkey, l_linenumber, floor(x * 1000000 + 0.5::DOUBLE)::BIGINT AS box_x, floor(y * 1000000 + 0.5::DOUBLE)::BIGINT AS box_y, floor(w * 1000000 + 0.5::DOUBLE)::BIGINT AS box_w, floor(h * 1000000 + 0.5::DOUBLE)::BIGINT AS box_h,
  CASE WHEN y + h / 2 < 1.0::DOUBLE / 3 THEN 'top' WHEN y + h / 2 > 2.0::DOUBLE / 3 THEN 'bottom' ELSE 'middle' END || '-' || CASE WHEN x + w / 2 < 1.0::DOUBLE / 3 THEN 'left' WHEN x + w / 2 > 2.0::DOUBLE / 3 THEN 'right' ELSE 'center' END AS zone,
  coalesce([NULL, 'top-left', NULL, 'bottom-center'][(l_linenumber % 4 + 1)::INT], CASE WHEN y + h / 2 < 1.0::DOUBLE / 3 THEN 'top' WHEN y + h / 2 > 2.0::DOUBLE / 3 THEN 'bottom' ELSE 'middle' END || '-' || CASE WHEN x + w / 2 < 1.0::DOUBLE / 3 THEN 'left' WHEN x + w / 2 > 2.0::DOUBLE / 3 THEN 'right' ELSE 'center' END) AS named,
  CASE WHEN fits THEN floor(tx * 1000000 + 0.5::DOUBLE)::BIGINT END AS target_x, CASE WHEN fits THEN floor(ty * 1000000 + 0.5::DOUBLE)::BIGINT END AS target_y, CASE WHEN fits THEN floor(tw * 1000000 + 0.5::DOUBLE)::BIGINT END AS target_w, CASE WHEN fits THEN floor(th * 1000000 + 0.5::DOUBLE)::BIGINT END AS target_h
FROM f"""


def _misses(least: int) -> str:
    return f"""
WITH RECURSIVE {_LINK.replace("WHERE score >= 80", f"WHERE score >= {least}")}
SELECT count(*) FROM (SELECT DISTINCT doc_id, target_idx FROM (SELECT * FROM pairs ANTI JOIN chosen USING (doc_id, pair_idx)) x JOIN best USING (label) WHERE score >= 80) y ANTI JOIN chosen USING (doc_id, target_idx)"""


def oracle_sql() -> dict[str, str]:
    registry = ", ".join("[" + ", ".join(f"'{s}'" for s in TARGETS[n]) + "]" for n in TARGETS)
    enrich_steps = "".join(
        f""",
e{i} AS (SELECT name, CASE WHEN EXISTS (SELECT 1 FROM near WHERE near.field = {i} AND list_contains(s, near.label)) THEN list_concat(s, list_filter(reg[{i}], lambda x: NOT list_contains(s, x))) ELSE s END AS s, reg FROM e{i - 1})"""
        for i in range(1, len(TARGETS) + 1)
    )
    clip = lambda v: f"least(greatest({v}, 0.0::DOUBLE), 1.0::DOUBLE)"
    return {
        "link_fields": f"""
WITH RECURSIVE {_LINK},
{_CODES},
seen AS (SELECT DISTINCT name, value, {_value_norm("value")} AS v FROM chosen JOIN targets USING (target_idx) WHERE trim(value) <> ''),
near AS (
  SELECT name, value, code, {_ratio("v", "c")} AS s, ord FROM seen JOIN (SELECT *, {_value_norm("code")} AS c FROM codes) k ON k.field = seen.name),
hit AS (SELECT * FROM near WHERE s >= 85 QUALIFY row_number() OVER (PARTITION BY name, value ORDER BY s DESC, ord) = 1)
SELECT d.doc_id, t.target_idx::INT AS target_idx, t.name, c.label, c.value, coalesce(c.score, 0)::INT AS score, c.synonym,
  CASE WHEN c.doc_id IS NULL THEN 'MISSING' WHEN hit.code IS NULL THEN 'TO_REVIEW' ELSE 'AUTO_VALIDATED' END AS status, hit.code, hit.s::INT AS code_score
FROM (SELECT DISTINCT doc_id FROM pairs) d CROSS JOIN targets t LEFT JOIN chosen c ON c.doc_id = d.doc_id AND c.target_idx = t.target_idx
LEFT JOIN hit ON hit.name = t.name AND hit.value = c.value""",
        "link_leftovers": f"WITH RECURSIVE {_LINK}\nSELECT doc_id, pair_idx::INT AS pair_idx, label, value FROM pairs ANTI JOIN chosen USING (doc_id, pair_idx)",
        "linkage_misses": f"""
SELECT 80 AS least, ({_misses(80)}) AS n_misses UNION ALL SELECT 100, ({_misses(100)})""",
        "link_proposals": f"""
WITH RECURSIVE {_PROPOSED},
taken AS (SELECT doc_id, target_idx, pair_idx, score FROM done UNION ALL SELECT doc_id, target_idx, pair_idx, score FROM chosen)
SELECT d.doc_id, t.target_idx::INT AS target_idx, t.name, p.label, p.value, coalesce(x.score, 0)::INT AS score, CASE WHEN x.doc_id IS NULL THEN 'MISSING' ELSE 'TO_REVIEW' END AS status
FROM (SELECT DISTINCT doc_id FROM pairs) d CROSS JOIN targets t LEFT JOIN taken x ON x.doc_id = d.doc_id AND x.target_idx = t.target_idx
LEFT JOIN pairs p ON p.doc_id = x.doc_id AND p.pair_idx = x.pair_idx""",
        "text_functions": f"""
WITH d AS (SELECT doc_id, text AS t, '00' || doc_id || ' :' AS v, CASE WHEN doc_id % 2 = 0 THEN text ELSE substr(text, 1, 400) END AS c FROM documents)
SELECT doc_id, {_norm("t")} AS label_form, {_value_norm("v")} AS value_form,
  coalesce(trim(regexp_replace(regexp_replace(lower(strip_accents(t)), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), '') AS simple_form, coalesce(lower(strip_accents(t)), '') AS folded,
  coalesce(len(regexp_extract_all(t, '[^ \t\n\x0b\f\r]+')), 0)::INT AS n_words, CASE WHEN length(c) > 500 THEN substr(c, 1, 500) || '…' ELSE c END AS cut,
  CASE WHEN length(trim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) >= 200 THEN t ELSE '' END AS readable, doc_id % 6 IN (2, 3, 4) AS retryable FROM d""",
        "value_predicates": f"""
WITH {_FORMS}
SELECT doc_id, pair_idx::INT AS pair_idx, {_SHORT} AS short_code, length(regexp_replace(value || ' ' || doc_id, '[^0-9]', '', 'g')) >= 7 AS phone,
  regexp_full_match('F ' || doc_id || ' X', '.*\\b[0-9]{{5}}\\b.*') AS postal, {_any(_FOLD.format("label"), ID_LABELS)} AS id_label FROM pairs""",
        "fuzzy_scores": f"""
WITH w AS (SELECT DISTINCT lower(n_name) AS a FROM nation UNION SELECT lower(r_name) FROM region UNION SELECT lower(p_type) FROM part),
pairs AS (SELECT a, lower('the ' || n_name) AS b FROM w, nation),
{_scores("pairs")}
SELECT a AS w, b AS x, ratio, token_set, similarity FROM scores""",
        "synonym_enrichment": f"""
WITH n AS (SELECT n_name AS name, [[{_LABELS}][(n_nationkey % 20 + 1)::INT]] AS s, [{registry}] AS reg FROM nation),
asked AS (SELECT DISTINCT {_norm("l")} AS a, {_norm("b")} AS b FROM (SELECT unnest([{_LABELS}, {", ".join(f"'{s}'" for n in TARGETS.values() for s in n)}]) AS l), (SELECT unnest(flatten([{registry}])) AS b)),
scored AS (SELECT a, b, {_ratio("a", "b")} AS r FROM asked),
near AS (
  SELECT DISTINCT l.l AS label, f.i AS field FROM (SELECT DISTINCT unnest([{_LABELS}, {", ".join(f"'{s}'" for n in TARGETS.values() for s in n)}]) AS l) l,
    (SELECT i, unnest([{registry}][i]) AS b FROM range(1, {len(TARGETS) + 1}) AS g(i)) f JOIN scored ON scored.b = {_norm("f.b")} WHERE scored.a = {_norm("l.l")} AND r >= 80),
e0 AS (SELECT * FROM n){enrich_steps}
SELECT name, array_to_string(s, '|') AS synonyms FROM e{len(TARGETS)}""",
        "document_scores": f"""
WITH {_FORMS},
s AS (
  SELECT doc_id, count(*) AS n_pairs, sum({_POINTS})::BIGINT AS score, count(*) FILTER (WHERE trim(value) <> '' AND {_count("label")} <= 6 AND {_count("value")} <= 6) AS n_short
  FROM pairs GROUP BY doc_id)
SELECT o_orderkey AS doc_id, coalesce(n_pairs, 0) AS n_pairs, coalesce(score, 0) AS score, o_orderkey % 11 <> 0 AND coalesce(n_pairs, 0) >= 3 AND coalesce(n_short, 0) >= 3 AS plausible
FROM orders LEFT JOIN s ON s.doc_id = o_orderkey""",
        "label_mentions": f"""
WITH {_FORMS},
labels AS (SELECT DISTINCT label, trim(regexp_replace(regexp_replace(lower(strip_accents(label)), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS a FROM pairs),
asked AS (SELECT a, b FROM labels, (VALUES ('country'), ('mkt')) AS t(b)),
{_scores("asked")},
near AS (SELECT DISTINCT label FROM labels JOIN scores USING (a) WHERE token_set >= 85)
SELECT o_orderkey AS doc_id, o_orderkey IN (SELECT doc_id FROM pairs JOIN near USING (label)) AS mentions FROM orders""",
        "extraction_consensus": f"""
WITH {_SAMPLES}
SELECT call_id, sample_idx, found, n_pairs FROM camp
QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY n_pairs, sample_idx) = (count(*) OVER (PARTITION BY call_id) - 1) // 2 + 1""",
        "location_consensus": f"""
WITH {_SAMPLES},
v AS (SELECT call_id, found, corner, count(*) AS n, min(sample_idx) AS sample_idx FROM camp GROUP BY ALL)
SELECT call_id, sample_idx, found, corner FROM v QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY n DESC, sample_idx) = 1""",
        "failed_calls": f"WITH {_SAMPLES}\nSELECT call_id FROM samples GROUP BY call_id HAVING NOT bool_or(ok)",
        "page_regions": _regions(),
        "extract_forms": f"WITH RECURSIVE {_extract()}\nSELECT * FROM fields",
        "extract_responses": f"""
WITH RECURSIVE {_extract()},
f AS (
  SELECT request_id, doc_id, any_value(found) AS found, any_value(mode) AS mode,
    list(struct_pack(name := name, value := value, status := status, rawLabel := label, matchScore := score, referenceCode := code, referenceLabel := code_label, referenceScore := code_score) ORDER BY target_idx) AS fields
  FROM fields GROUP BY request_id, doc_id),
u AS (SELECT doc_id, list(struct_pack(label := label, value := value) ORDER BY pair_idx) AS pairs FROM remaining GROUP BY doc_id)
SELECT request_id, doc_id, to_json(struct_pack(cartoucheFound := found, mode := mode, corner := NULL, qualityPassed := true, fields := fields, unclassifiedPairs := coalesce(pairs, [])))::VARCHAR AS response FROM f LEFT JOIN u USING (doc_id)""",
        "project_codes": """
WITH c AS (
  SELECT (c_custkey % 3)::VARCHAR AS project, c_custkey AS doc_id, c_mktsegment AS seg, c_custkey % 5 = 0 AS odd,
    CASE WHEN c_custkey % 5 = 0 THEN ' ' || lower(c_mktsegment) || 's' ELSE c_mktsegment END AS value FROM customer),
m AS (SELECT *, CASE WHEN project = '0' AND seg = 'BUILDING' THEN 'BUILDING' WHEN project = '1' AND seg = 'BUILDING' THEN 'building' WHEN project = '1' AND seg = 'MACHINERY' THEN 'MACHINERY' END AS code FROM c)
SELECT project, doc_id, value, CASE WHEN code IS NULL THEN 'TO_REVIEW' ELSE 'AUTO_VALIDATED' END AS status, code, CASE WHEN code IS NOT NULL THEN CASE project WHEN '0' THEN 'zero' ELSE 'one' END END AS code_label,
  CASE WHEN code IS NULL THEN NULL WHEN NOT odd THEN 100 WHEN seg = 'BUILDING' THEN 94 ELSE 95 END::INT AS code_score FROM m""",
        "registry_synonyms": f"""
WITH n AS (SELECT n_nationkey, {_list([*TARGETS, "EMPTY", "status"])}[(n_nationkey % 7 + 1)::INT] AS name FROM nation),
g AS (SELECT * FROM {_values([(n, x[0], "|".join(x)) for n, x in TARGETS.items()], "name", "confirmed", "both_lists")})
SELECT n_nationkey, n.name, hypotheses, CASE WHEN hypotheses THEN both_lists ELSE confirmed END AS synonyms FROM n CROSS JOIN (VALUES (false), (true)) AS h(hypotheses) LEFT JOIN g ON g.name = n.name""",
        "routing_switches": _switches(),
        "page_pixels": """
WITH p AS (SELECT DISTINCT l_suppkey % 20 AS img_id, l_orderkey % 24 AS x, l_partkey % 18 AS y, l_linenumber * 30 AS level FROM lineitem),
t AS (
  SELECT img_id, level, CASE img_id % 5 WHEN 1 THEN 17 - y WHEN 2 THEN 23 - x WHEN 3 THEN y ELSE x END AS x, CASE img_id % 5 WHEN 1 THEN x WHEN 2 THEN 17 - y WHEN 3 THEN 23 - x ELSE y END AS y,
    CASE WHEN img_id % 5 IN (1, 3) THEN 18 ELSE 24 END AS w, CASE WHEN img_id % 5 IN (1, 3) THEN 24 ELSE 18 END AS h FROM p),
b AS (SELECT *, floor(w * 0.25 + 0.5)::INT AS x0, h // 2 AS y0, w // 2 AS cw, h // 2 AS ch FROM t)
SELECT img_id, (x - x0)::INT AS x, (y - y0)::INT AS y, level FROM b WHERE x >= x0 AND x < x0 + cw AND y >= y0 AND y < y0 + ch""",
        "page_sizes": """
WITH a AS (
  SELECT o_orderkey, greatest((o_orderkey % 40 * 100 + 72)::DOUBLE, (o_orderkey % 25 * 72 + 144)::DOUBLE) / 72 * 25.4::DOUBLE AS mm, (o_orderkey % 5)::DOUBLE / 8 AS x, (o_orderkey % 3)::DOUBLE / 8 AS y, o_orderkey % 4 * 90 AS d FROM orders),
t AS (
  SELECT o_orderkey, mm, CASE d WHEN 90 THEN y WHEN 180 THEN 0.75::DOUBLE - x WHEN 270 THEN 0.5::DOUBLE - y ELSE x END AS tx, CASE d WHEN 90 THEN 0.75::DOUBLE - x WHEN 180 THEN 0.5::DOUBLE - y WHEN 270 THEN x ELSE y END AS ty,
    d IN (90, 270) AS side, least(greatest(least(2200::DOUBLE / (mm / 25.4::DOUBLE), 300::DOUBLE), 72::DOUBLE), 400::DOUBLE) AS dpi FROM a)
SELECT o_orderkey, floor(mm * 1000000 + 0.5::DOUBLE)::BIGINT AS long_side, mm > 430 AS large, floor(dpi * 1000000 + 0.5::DOUBLE)::BIGINT AS dpi, floor(tx * 1000000 + 0.5::DOUBLE)::BIGINT AS turned_x, floor(ty * 1000000 + 0.5::DOUBLE)::BIGINT AS turned_y,
  CASE WHEN side THEN 500000 ELSE 250000 END::BIGINT AS turned_w, CASE WHEN side THEN 250000 ELSE 500000 END::BIGINT AS turned_h FROM t""",
        "replay_counters": """
SELECT count(*) FILTER (WHERE k % 3 <> 0) AS hits, count(*) FILTER (WHERE k % 3 = 0) AS misses, count(*) FILTER (WHERE k % 3 <> 0 AND k % 2 = 0) AS n_usage,
  (sum(k) FILTER (WHERE k % 3 <> 0 AND k % 2 = 0))::BIGINT AS prompt, 7 * count(*) FILTER (WHERE k % 3 <> 0 AND k % 2 = 0) AS completion, 0::BIGINT AS reasoning FROM (SELECT o_orderkey AS k FROM orders)""",
        "reader_requests": _requests(),
        "code_files": """
SELECT 'p1' AS project, 'NATION' AS field, row_number() OVER (ORDER BY n_nationkey)::INT AS ord, n_name AS code, n_name || ', ' || n_nationkey AS libelle FROM nation
UNION ALL SELECT 'p2', 'REGION', row_number() OVER (ORDER BY r_regionkey)::INT, r_name, r_name || chr(10) || 'no. ' || r_regionkey FROM region""",
        "corner_routing": _route(),
        "ink_bounds": f"""
WITH p AS (
  SELECT DISTINCT l_suppkey % 50 AS img_id, l_orderkey % 40 + l_suppkey % 50 AS x, l_partkey % 30 + l_suppkey % 40 AS y, l_linenumber * 60 AS level FROM lineitem),
d AS (SELECT * FROM p WHERE level <= 240),
xs AS (SELECT img_id, min(x) AS a, max(x) + 1 AS b FROM (SELECT img_id, x FROM d GROUP BY ALL HAVING count(*) >= 3) GROUP BY img_id),
ys AS (SELECT img_id, min(y) AS c, max(y) + 1 AS e FROM (SELECT img_id, y FROM d GROUP BY ALL HAVING count(*) >= 3) GROUP BY img_id),
r AS (
  SELECT i AS img_id, {clip("a / 120::DOUBLE - 0.01::DOUBLE")} AS x, {clip("c / 100::DOUBLE - 0.01::DOUBLE")} AS y, {clip("b / 120::DOUBLE + 0.01::DOUBLE")} - {clip("a / 120::DOUBLE - 0.01::DOUBLE")} AS w,
    {clip("e / 100::DOUBLE + 0.01::DOUBLE")} - {clip("c / 100::DOUBLE - 0.01::DOUBLE")} AS h, a IS NOT NULL AND c IS NOT NULL AS ink
  FROM range(50) AS g(i) LEFT JOIN xs ON xs.img_id = i LEFT JOIN ys ON ys.img_id = i)
SELECT img_id, CASE WHEN ink AND w * h < 0.6 THEN floor(x * 1000000 + 0.5::DOUBLE)::BIGINT ELSE 0 END AS x, CASE WHEN ink AND w * h < 0.6 THEN floor(y * 1000000 + 0.5::DOUBLE)::BIGINT ELSE 0 END AS y,
  CASE WHEN ink AND w * h < 0.6 THEN floor(w * 1000000 + 0.5::DOUBLE)::BIGINT ELSE 1000000 END AS w, CASE WHEN ink AND w * h < 0.6 THEN floor(h * 1000000 + 0.5::DOUBLE)::BIGINT ELSE 1000000 END AS h FROM r""",
        "response_replay": """
SELECT o_orderkey AS doc_id, sha256('body ' || o_orderkey) AS key, o_orderkey % 3 <> 0 AS hit, o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AS found,
  CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 THEN o_orderstatus END AS value FROM orders""",
    }

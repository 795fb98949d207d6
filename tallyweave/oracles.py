"""The linkage queries in DuckDB SQL, written as common table expressions that build on one another."""

from __future__ import annotations

from tallyweave.functions import text as t

B = r"[^\p{L}\p{N}_]"


def _any(words) -> str:
    return r"\b(" + "|".join(words) + r")\b"


def _sub(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"


def _collapse(x: str) -> str:
    return f"trim({_sub(x, chr(92) + 's+', ' ')})"


def latin(x: str) -> str:
    out = f"strip_accents(lower(coalesce({x}, '')))"
    for letter, spelled in t.SPELLED.items():
        out = f"replace({out}, '{letter}', '{spelled}')"
    return out


def ascii_only(x: str) -> str:
    return _sub(f"strip_accents(lower(coalesce({x}, '')))", r"[^\x00-\x7F]")


def name_sql(x: str, rules: t.NameRules) -> str:
    s = {"latin": latin, "ascii": ascii_only, "lower": lambda y: f"lower(coalesce({y}, ''))"}[rules.fold](x)
    if rules.web:
        s = _sub(_sub(s, r"\b(https?://|www\.)"), r"\.(" + "|".join(t.DOMAINS) + r")\b")
    if rules.separators:
        cases = " ".join(f"WHEN contains(v, '{sep}') THEN string_split(v, '{sep}')[-1]" for sep in rules.separators)
        s = f"(SELECT CASE {cases} ELSE v END FROM (SELECT {s} AS v))"
    s = _sub(s, r"[^a-z0-9\s]", " ")
    if rules.honorifics:
        s = f"regexp_replace({s}, '^({'|'.join(t.HONORIFICS)})\\b\\s*', '')"
    return _collapse(_sub(s, _any(rules.legal), rules.gap))


def addr_sql(x: str, noise=t.ADDRESS_NOISE) -> str:
    """Uses the column ``country``."""
    base = _sub(_sub(latin(x), r"[^a-z0-9\s]", " "), _any(noise), " ")
    india, france = "v", "v"
    for word, name in t.INDIA:
        india = _sub(india, rf"\b{word}\b", name)
    for word, name in t.FRANCE:
        france = _sub(france, rf"\b{word}\b", name)
    return f"(SELECT {_collapse(f'CASE country WHEN $$FRANCE$$ THEN {france} WHEN $$INDIA$$ THEN {india} ELSE v END')} FROM (SELECT {base} AS v))"


def words_sql(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def prefix_sql(x: str, n: int, rue: bool) -> str:
    skip = " AND w <> 'rue'" if rue else ""
    return f"coalesce(list_filter({words_sql(x)}, lambda w: NOT regexp_matches(w, '^[0-9]+$') AND length(w) >= 3{skip})[1], '')[1:{n}]"


def slug_sql(x: str, words=t.SLUG_WORDS) -> str:
    return f"replace({_sub(x, _any(words))}, ' ', '')"


ENT = """ent AS (
  SELECT 'S' || (doc_id % 3 + 1) || '-' || doc_id AS entity_id, CAST(doc_id % 3 + 1 AS INTEGER) AS src, doc_id AS ord,
    array_to_string(ws[1:6], ' ') AS business_name,
    (n_chars % 97) || ' ' || array_to_string(ws[7:12], ' ') || ' ' || source || ' ' || CASE lang WHEN 'en' THEN 'tx' WHEN 'fr' THEN 'paris' WHEN 'es' THEN 'mh' ELSE 'berlin' END || ' ' ||
      CASE WHEN lang = 'es' THEN 400000 + n_chars % 100000 ELSE 10000 + n_chars % 80000 END AS business_address,
    CASE lang WHEN 'en' THEN 'US' WHEN 'fr' THEN 'France' WHEN 'es' THEN 'India' ELSE 'Germany' END AS country
  FROM (SELECT *, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM documents))"""

#: The entity view of parts.
PART_ENT = """ent AS (
  SELECT 'S' || (p_partkey % 3 + 1) || '-' || p_partkey AS entity_id, CAST(p_partkey % 3 + 1 AS INTEGER) AS src, p_partkey AS ord,
    CASE WHEN p_partkey % 2 = 1 THEN array_to_string(list_reverse(string_split(p_name, ' ')), ' ') ELSE p_name END AS business_name,
    p_size || ' ' || p_type AS business_address, p_brand AS country FROM part)"""

_STATES = ", ".join(f"'{s}'" for s in t.US_STATES)
_INDIA = " ".join(f"WHEN regexp_matches(raw, '(?i)(^|{B}){word}($|{B})') THEN '{name}'" for word, name in t.INDIA)


def records(rules: str = "v5") -> str:
    r = t.NAME_RULES[rules]
    slug = t.SLUG_WORDS_WIDE if rules in ("wide", "generic") else t.SLUG_WORDS
    return f"""rec1 AS (SELECT entity_id, src, ord, business_address AS raw, {name_sql("business_name", r)} AS name, {name_sql("business_address", r)} AS street, upper(trim(country)) AS country FROM ent),
rec2 AS (SELECT *, {addr_sql("raw")} AS addr FROM rec1),
rec3 AS (SELECT *, {slug_sql("name", slug)} AS slug, regexp_extract(raw, '\\b(\\d+)\\b', 1) AS street_num,
  list_distinct(regexp_extract_all(raw, '\\b\\d+\\b')) AS nums, {words_sql("name")} AS words, {words_sql("addr")} AS addr_words,
  CASE WHEN country = 'INDIA' THEN coalesce(regexp_extract_all(raw, '\\b[1-9]\\d{{5}}\\b')[-1], '') WHEN country IN ('US', 'FRANCE') THEN coalesce(regexp_extract_all(raw, '\\b\\d{{5}}\\b')[-1], '') ELSE '' END AS pin,
  coalesce(list_filter(regexp_extract_all(lower(raw), '\\b[a-z]{{2}}\\b'), lambda w: w IN ({_STATES}))[1], '') AS us_state,
  CASE {_INDIA} ELSE '' END AS in_state FROM rec2),
rec AS (SELECT *, CASE country WHEN 'US' THEN us_state WHEN 'INDIA' THEN in_state WHEN 'FRANCE' THEN CASE WHEN len(addr_words) >= 2 THEN addr_words[-1] ELSE '' END ELSE '' END AS state,
  coalesce(CASE country WHEN 'US' THEN CASE WHEN len(addr_words) >= 2 AND addr_words[-1] = us_state THEN addr_words[-2] ELSE addr_words[-1] END
    WHEN 'INDIA' THEN addr_words[-1] WHEN 'FRANCE' THEN CASE WHEN len(addr_words) >= 2 THEN addr_words[-2] ELSE addr_words[1] END ELSE '' END, '') AS city,
  {ngrams_sql("name", 3)} AS ngrams, {prefix_sql("street", 3, True)} AS street3, {prefix_sql("street", 2, False)} AS street2,
  list_filter(addr_words, lambda w: NOT regexp_matches(w, '^[0-9]+$') AND length(w) >= 4)[-3:] AS city_words FROM rec3)"""


def ngrams_sql(x: str, n: int, short: str = "whole") -> str:
    shorter = f"CASE WHEN {x} = '' THEN []::VARCHAR[] ELSE [{x}] END" if short == "whole" else "[]::VARCHAR[]"
    return f"CASE WHEN length({x}) >= {n} THEN list_distinct(list_transform(range(1, length({x}) - {n} + 2), lambda i: {x}[i:i + {n - 1}])) ELSE {shorter} END"


K = "chr(1)"


def _key(*parts: str) -> str:
    return "country || " + " || ".join(f"{K} || {p}" for p in parts)


_GENERIC = ", ".join(f"'{w}'" for w in t.GENERIC)

_SIGNIFICANT = "list_filter(words, lambda w: length(w) >= 3)"

#: tier: (score, limit, build guard and keys, probe keys or None); keys are one expression, or a list to be unnested.
TIERS = {
    "exact": (100, 350, "name <> ''", _key("name"), None),
    "slug": (95, 350, "length(slug) >= 4", _key("slug"), None),
    "fingerprint": (85, 350, "len(words) BETWEEN 2 AND 4", _key("array_to_string(list_sort(words), '|')"), None),
    "w12": (80, 350, "len(words) >= 2 AND length(words[1]) >= 3 AND length(words[2]) >= 3", _key("words[1]", "words[2]"), None),
    "first_last": (75, 350, "len(words) >= 2 AND length(words[1]) >= 3 AND length(words[-1]) >= 3", _key("words[1]", "words[-1]"), None),
    "w23": (70, 350, "len(words) >= 3 AND length(words[2]) >= 3 AND length(words[-1]) >= 3", _key("words[2]", "words[-1]"), None),
    "brand": (65, 60, "true", f"unnest(list_distinct(list_transform(list_filter(words, lambda w: length(w) >= 5 AND w NOT IN ({_GENERIC})), lambda w: {_key('w')})))", f"unnest(list_distinct(list_transform(list_filter(words, lambda w: length(w) >= 5), lambda w: {_key('w')})))"),
    "num_name": (65, 80, "street_num <> '' AND len(words) >= 1 AND length(words[1]) >= 3", _key("street_num", "words[1]"), None),
    "num_street": (60, 80, "street_num <> '' AND street3 <> ''", _key("street_num", "street3"), None),
    "num_street2": (58, 80, "street_num <> '' AND length(street2) >= 2", _key("street_num", "street2"), None),
    "num_word": (55, 80, "street_num <> ''", f"unnest(list_distinct(list_transform(list_filter(words[1:2], lambda w: length(w) >= 3), lambda w: {_key('street_num', 'w')})))", None),
    "city_pair": (55, 50, "len(city_words) >= 2", _key("city_words[1]", "city_words[2]"), None),
    "num_city": (50, 50, "street_num <> '' AND len(city_words) >= 1", _key("street_num", "city_words[1]"), None),
    "pin_word": (45, 150, "pin <> '' AND len(words) >= 1", _key("pin", "words[1][1:4]"), None),
    "first_token": (40, 350, "len(words) >= 1", _key("words[1]"), None),
    "prefix3": (35, 350, "name <> ''", _key("name[1:3]"), None),
    "first_last_sorted": (75, 350, f"len({_SIGNIFICANT}) >= 2", _key(f"least({_SIGNIFICANT}[1], {_SIGNIFICANT}[-1])", f"greatest({_SIGNIFICANT}[1], {_SIGNIFICANT}[-1])"), None),
    "bigram": (30, 350, "len(words) >= 2", f"unnest(list_distinct(list_transform(range(1, least(len(words) - 1, 3) + 1), lambda i: {_key(chr(40) + 'words[i] || chr(32) || words[i + 1]' + chr(41))})))", f"unnest(list_distinct(list_transform(range(1, least(len(words) - 1, 2) + 1), lambda i: {_key(chr(40) + 'words[i] || chr(32) || words[i + 1]' + chr(41))})))"),
}


def pairs(tiers, limit: int | None = None) -> str:
    """The best tier score of each pair, keys pruned by the limit."""
    a, b, few = [], [], []
    for name in tiers:
        score, most, guard, build, probe = TIERS[name]
        a.append(f"SELECT entity_id AS s1_id, '{name}' AS tier, {score} AS score, {build} AS key FROM rec WHERE src = 1 AND {guard}")
        b.append(f"SELECT entity_id AS cand_id, src, '{name}' AS tier, {probe or build} AS key FROM rec WHERE src <> 1 AND {guard}")
        few.append(f"WHEN '{name}' THEN {limit or most}")
    return f"""ka AS ({" UNION ALL ".join(a)}), kb AS ({" UNION ALL ".join(b)}),
few AS (SELECT tier, key FROM ka GROUP BY tier, key HAVING count(*) <= CASE tier {" ".join(few)} END),
pairs AS (SELECT s1_id, cand_id, src, max(score) AS score FROM ka JOIN few USING (tier, key) JOIN kb USING (tier, key) GROUP BY ALL)"""


def top(k: int) -> str:
    return f"topk AS (SELECT s1_id, cand_id, src, score FROM pairs QUALIFY row_number() OVER (PARTITION BY s1_id, src ORDER BY score DESC, cand_id) <= {k})"


TRUTH = """sh AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents)),
shr AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM sh),
truth AS (SELECT 'S1-' || a.doc_id AS s1_id, 'S' || (b.doc_id % 3 + 1) || '-' || b.doc_id AS cand_id
  FROM shr a JOIN shr b ON a.h = b.h AND a.doc_id % 3 = 0 AND b.doc_id % 3 <> 0 GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 2 * count(*) >= a.n + b.n - count(*)),
anchors AS (SELECT entity_id AS s1_id FROM ent WHERE src = 1)"""

FIELDS = "name slug addr street_num country nums words addr_words pin state city ngrams".split()
PAIRED = f"""paired AS (SELECT p.*, {", ".join(f"a.{f} AS a_{f}, b.{f} AS b_{f}" for f in FIELDS)} FROM topk p JOIN rec a ON a.entity_id = p.s1_id JOIN rec b ON b.entity_id = p.cand_id)"""


def same(f: str) -> str:
    return f"(a_{f} <> '' AND a_{f} = b_{f})"


def differ(f: str) -> str:
    return f"(a_{f} <> '' AND b_{f} <> '' AND a_{f} <> b_{f})"


def jaccard(a: str, b: str, empty: float = 1.0) -> str:
    union = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {union} = 0 THEN {empty} ELSE len(list_intersect({a}, {b})) / {union} END"


def _num(condition: str) -> str:
    return f"CAST(CASE WHEN {condition} THEN 1 ELSE 0 END AS DOUBLE)"


BOTH = "(a_addr <> '' AND b_addr <> '')"
NAMES = "(len(a_words) > 0 AND len(b_words) > 0)"
_LONG = "(length(a_name) >= 4 AND length(b_name) >= 4)"
NATIVE = {
    "exact_name": _num(same("name")),
    "exact_name_long": _num("a_name = b_name AND length(a_name) >= 5"),
    "exact_slug": _num("a_slug = b_slug AND length(a_slug) >= 4"),
    "name_starts": _num(f"{_LONG} AND (starts_with(a_name, b_name) OR starts_with(b_name, a_name))"),
    "name_contains": _num(f"{_LONG} AND (contains(a_name, b_name) OR contains(b_name, a_name))"),
    "name_jaccard": f"CASE WHEN {NAMES} THEN {jaccard('a_words', 'b_words')} ELSE 0.0 END",
    "name_len_diff": "abs(length(a_name) - length(b_name)) / greatest(length(a_name), length(b_name), 1)",
    "both_addr": _num(BOTH),
    "addr_missing": _num(f"NOT {BOTH}"),
    "exact_addr": _num(f"{BOTH} AND a_addr = b_addr"),
    "addr_jaccard": f"CASE WHEN {BOTH} THEN {jaccard('a_addr_words', 'b_addr_words')} ELSE 0.0 END",
    "addr_containment": f"CASE WHEN {BOTH} THEN len(list_intersect(a_addr_words, b_addr_words)) / greatest(least(len(list_distinct(a_addr_words)), len(list_distinct(b_addr_words))), 1) ELSE 0.5 END",
    "addr_shared": f"CAST(CASE WHEN {BOTH} THEN len(list_intersect(a_addr_words, b_addr_words)) ELSE 0 END AS DOUBLE)",
    "addr_len_diff": "abs(length(a_addr) - length(b_addr)) / greatest(length(a_addr), length(b_addr), 1)",
    "country_match": _num("a_country = b_country"),
    "city_match": _num(same("city")),
    "state_match": _num(same("state")),
    "city_or_state": _num(f"{same('city')} OR {same('state')} OR list_has_any(a_addr_words[-2:], b_addr_words[-2:])"),
    "pin_match": _num(same("pin")),
    "pin_conflict": _num(differ("pin")),
    "num_match": _num(same("street_num")),
    "num_conflict": _num(differ("street_num")),
    "shared_nums": "CAST(len(list_intersect(a_nums, b_nums)) AS DOUBLE)",
    "disjoint_nums": _num("len(a_nums) > 0 AND len(b_nums) > 0 AND len(list_intersect(a_nums, b_nums)) = 0"),
}
SCORED = f"""scored AS (SELECT *, round(greatest(0.0, 0.30 * {NATIVE["exact_name"]} + 0.15 * {NATIVE["exact_slug"]} + 0.20 * ({NATIVE["name_jaccard"]}) + 0.10 * ({NATIVE["addr_jaccard"]}) + 0.15 * {NATIVE["num_match"]} + 0.10 * {NATIVE["pin_match"]} - (0.10 * {NATIVE["num_conflict"]} + 0.05 * {NATIVE["pin_conflict"]})), 6) AS prob,
  a_name = b_name AND length(a_name) >= 5 AND a_country = b_country AND NOT {differ("street_num")} AS exact_brand, {differ("street_num")} OR {differ("pin")} AS has_conflict FROM paired)"""


def two_tier(primary: float, secondary: float) -> str:
    return f"""gated AS (SELECT *, row_number() OVER (PARTITION BY s1_id, src ORDER BY prob DESC, cand_id) AS r FROM scored WHERE prob >= CASE WHEN has_conflict THEN 0.88 WHEN exact_brand THEN {primary} - 0.08 ELSE {primary} END),
tier2 AS (SELECT * FROM gated WHERE r <= 3 AND prob >= CASE WHEN has_conflict THEN 0.88 WHEN r > 1 THEN {secondary} WHEN exact_brand THEN {primary} - 0.08 ELSE {primary} END),
chosen AS (SELECT * EXCLUDE (r) FROM tier2 QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY prob DESC, cand_id) <= 4)"""


def subsequence(a: str, b: str) -> str:
    """Length of the longest common subsequence of two columns, the shorter of 120 letters at most: a bit vector of the shorter is advanced by the letters of the longer."""
    full = "((1::HUGEINT << CAST(length(s) AS INTEGER)) - 1)"
    places = "list_sum(list_transform(range(length(s)), lambda i: CASE WHEN s[i + 1] = y THEN 1::HUGEINT << CAST(i AS INTEGER) ELSE 0::HUGEINT END))::HUGEINT"
    steps = f"list_reduce(list_prepend({full}, list_transform(string_split(l, ''), lambda y: {places})), lambda r, m: ((r + (r & m)) | (r - (r & m))) & {full})"
    return f"(SELECT CASE WHEN s = '' THEN 0 WHEN length(s) > 120 THEN error('too long') ELSE length(s) - bit_count({steps}) END FROM (SELECT CASE WHEN length({a}) <= length({b}) THEN {a} ELSE {b} END AS s, CASE WHEN length({a}) <= length({b}) THEN {b} ELSE {a} END AS l))"


def ratio(a: str, b: str) -> str:
    return f"(SELECT CASE WHEN length(u) + length(v) = 0 THEN 1.0 ELSE 2 * {subsequence('u', 'v')} / (length(u) + length(v)) END FROM (SELECT {a} AS u, {b} AS v))"


def sorted_words(x: str) -> str:
    return f"array_to_string(list_sort({words_sql(x)}), ' ')"


def token_set(a: str, b: str) -> str:
    """The best ratio among the common words, and these with either side's others."""

    def less(x: str, y: str) -> str:
        return f"array_to_string(list_sort(list_filter(list_distinct({x}), lambda w: NOT list_contains({y}, w))), ' ')"

    best = f"greatest({ratio('p', 'q')}, CASE WHEN co = '' THEN 0 ELSE {ratio('co', 'p')} END, CASE WHEN co = '' THEN 0 ELSE {ratio('co', 'q')} END)"
    return f"""(SELECT CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN 0.0 WHEN co <> '' AND (le = '' OR ri = '') THEN 1.0 ELSE {best} END
  FROM (SELECT *, trim(co || ' ' || le) AS p, trim(co || ' ' || ri) AS q FROM (SELECT wa, wb, array_to_string(list_sort(list_intersect(list_distinct(wa), list_distinct(wb))), ' ') AS co, {less('wa', 'wb')} AS le, {less('wb', 'wa')} AS ri FROM (SELECT {words_sql(a)} AS wa, {words_sql(b)} AS wb))))"""


def partial(a: str, b: str) -> str:
    """The best ratio of the shorter text with any window of its length, cut off at the ends, of the longer one; of equally long ones both ways."""

    def one(s: str, l: str) -> str:
        return f"(SELECT max({ratio('s1', 'wd')}) FROM (SELECT {s} AS s1, unnest(list_transform(range(1 - length({s}), length({l})), lambda i: {l}[greatest(0, i) + 1:i + length({s})])) AS wd))"

    return f"""(SELECT CASE WHEN u = '' OR v = '' THEN CAST(CAST(u = v AS INTEGER) AS DOUBLE) WHEN length(u) < length(v) THEN {one('u', 'v')} WHEN length(u) > length(v) THEN {one('v', 'u')} ELSE greatest({one('u', 'v')}, {one('v', 'u')}) END FROM (SELECT {a} AS u, {b} AS v))"""


def jaro_winkler(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE jaro_winkler_similarity({a}, {b}) END"


F05 = "CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0 WHEN n_true = 0 OR n_pred = 0 OR tp = 0 THEN 0.0 ELSE 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * (tp / n_pred) + tp / n_true) END"


def per_entity(predicted: str) -> str:
    return f"""ent_counts AS (SELECT s1_id, (SELECT count(*) FROM truth t WHERE t.s1_id = a.s1_id) AS n_true, (SELECT count(*) FROM {predicted} p WHERE p.s1_id = a.s1_id) AS n_pred,
  (SELECT count(*) FROM {predicted} p JOIN truth t USING (s1_id, cand_id) WHERE p.s1_id = a.s1_id) AS tp FROM anchors a),
per AS (SELECT *, {F05} AS f05 FROM ent_counts)"""


SUMMARY = """round(avg(f05), 6) AS macro_f05, round(CASE WHEN sum(n_pred) = 0 THEN 0 ELSE sum(tp) / sum(n_pred) END, 6) AS pair_precision, round(CASE WHEN sum(n_true) = 0 THEN 0 ELSE sum(tp) / sum(n_true) END, 6) AS pair_recall,
  round(avg(CASE WHEN n_pred = 0 THEN 1 ELSE tp / n_pred END), 6) AS macro_precision, round(avg(CASE WHEN n_true = 0 THEN 1 ELSE tp / n_true END), 6) AS macro_recall,
  CAST(sum(tp) AS BIGINT) AS total_tp, CAST(sum(n_pred - tp) AS BIGINT) AS total_fp, CAST(sum(n_true - tp) AS BIGINT) AS total_fn,
  count(*) FILTER (n_true = 0) AS singletons, count(*) FILTER (n_pred = 0) AS predicted_singletons, count(*) FILTER (n_true = 0 AND n_pred > 0) AS false_on_singletons, count(*) FILTER (n_true = 0 AND n_pred = 0) AS right_singletons"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"

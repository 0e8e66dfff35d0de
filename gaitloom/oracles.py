"""DuckDB statements the queries must agree with, written against the tables, not against the operators."""

from __future__ import annotations

import re
from collections import Counter

from .functions import lexicon as X

# requests of the query batch; fixed so that both sides run the same
QUERIES = (("q1", "walks along the taped line"), ("q2", "a dancer catches a soft ball"), ("q3", "深深鞠躬"), ("q4", "push a stiff door open, then sits quietly"), ("q5", "stair climb"), ("q6", "motionlab"))
CASES = tuple((key, said, lang, kind, pattern, forbidden) for key, said, lang, kind, pattern, forbidden in (
    ("q1", "walks along the taped line", "en", "locomotion", "taped line", "Heel_Tap"),
    ("q2", "a dancer catches a soft ball", "en", "sport", "ball[_ ]catch|soft ball", "Ring_Toss"),
    ("q3", "深深鞠躬", "zh", "short", "Deep[_ ]Bow|鞠躬", "Box_Squat"),
    ("q4", "push a stiff door open, then sits quietly", "en", "sequence", "door", "Chair_Rest"),
    ("q5", "stair climb", "en", "short", "stair", "Stair_Climb"),
))
WS = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: Base address, caption vectors whose objects are looked up, version and leaf prefix of the test tables.
BASE = "http://motions.test"
LOOKED_UP = (101, 202, 303)
VERSION, LEAVES = "2031.2", "action_"
LIB_FILTERS = {"dataset": "motionxpp", "space": "indoor", "action_category": "ground_travel"}

q = lambda s: "'" + s.replace("'", "''") + "'"
squeeze = lambda x: f"trim(regexp_replace(coalesce({x}, ''), '{WS}', ' ', 'g'))"
clean = lambda x: f"trim(regexp_replace({squeeze(x)}, '(?i)^(output|caption|description)\\s*:\\s*', ''))"
_REFUSED = " OR ".join(f"regexp_matches({{x}}, '(?i){r.replace(chr(39), chr(39) * 2)}')" for r in X.REFUSALS)
searchable = lambda x: f"(length({x}) > 0 AND NOT ({_REFUSED.replace('{x}', x)}))"
notake = lambda x: f"regexp_replace({x}, '(?i)(?:_clip[0-9]+|_[0-9]+)+$', '')"
series = lambda d, m: f"CASE WHEN lower({d}) = 'motionxpp' THEN trim(regexp_replace(lower({notake(m)}), '[^a-z0-9]+', ' ', 'g')) ELSE '' END"
title = lambda d, m: f"CASE WHEN lower({d}) = 'motionxpp' THEN {squeeze(f'replace({notake(f'regexp_replace({m}, {q('^[^/]*/')}, {q('')})')}, {q('_')}, {q(' ')})')} ELSE '' END"
ttoken = lambda w: (
    f"CASE WHEN length({w}) > 5 AND {w} LIKE '%ies' THEN left({w}, length({w}) - 3) || 'y' WHEN length({w}) > 5 AND {w} LIKE '%ing' THEN left({w}, length({w}) - 3) "
    f"WHEN length({w}) > 4 AND ({w} LIKE '%ed' OR {w} LIKE '%es') THEN left({w}, length({w}) - 2) WHEN length({w}) > 3 AND {w} LIKE '%s' THEN left({w}, length({w}) - 1) ELSE {w} END"
)
ttokens = lambda x: f"list_transform(list_transform(regexp_extract_all(lower({x}), '[a-z0-9]+(?:[-''][a-z0-9]+)?'), lambda w: replace(w, '-', ' ')), lambda w: {ttoken('w')})"
_stem = (
    "CASE WHEN length(raw) > 4 AND raw LIKE '%ies' THEN left(raw, length(raw) - 3) || 'y' WHEN length(raw) > 4 AND raw LIKE '%ing' THEN left(raw, length(raw) - 3) "
    "WHEN length(raw) > 3 AND raw LIKE '%ed' THEN left(raw, length(raw) - 2) WHEN length(raw) > 3 AND raw LIKE '%s' THEN left(raw, length(raw) - 1) ELSE raw END"
)

ENTRY = f"""
entry_row AS (
  SELECT record_id, lower({squeeze('dataset')}) AS dataset, {squeeze('motion_id')} AS motion_id, coalesce(source_motion, '') AS source_motion,
         list_filter(list_transform(coalesce(captions, []::VARCHAR[]), lambda c: {clean('c')}), lambda c: {searchable('c')}) AS captions,
         {squeeze('description')} AS told, {squeeze('object_id')} AS given, cache_glb, CASE WHEN frame_count > 0 THEN frame_count END AS frame_count
  FROM motion_index),
entry_all AS (
  SELECT *, CASE WHEN told <> '' THEN told ELSE {squeeze('captions[1]')} END AS description,
         CASE WHEN given <> '' THEN given WHEN dataset <> '' AND motion_id <> '' THEN sha256(dataset || ':' || motion_id || ':' || source_motion) ELSE '' END AS object_id
  FROM entry_row),
entry_kept AS (
  SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY record_id DESC) AS turn FROM entry_all WHERE dataset <> '' AND motion_id <> '' AND object_id <> ''),
entry AS (
  SELECT * EXCLUDE (told, given, turn), {title('dataset', 'motion_id')} AS source_title, {series('dataset', 'motion_id')} AS series_key,
         {squeeze(f"concat_ws(' ', dataset, motion_id, {title('dataset', 'motion_id')}, description, array_to_string(captions, ' '))")} AS search_text
  FROM entry_kept WHERE turn = 1)"""

_alias = ", ".join(f"({q(a)}, {q(b)})" for a, b in X.TOKEN_ALIASES.items() if a != b)
_han = ", ".join(f"({q(a)}, {k}, [{', '.join(map(q, t))}])" for k, (a, t) in enumerate(X.HAN_ALIASES))
_stop = ", ".join(map(q, X.STOP_WORDS))
POSTING = f"""
alias(said, mapped) AS (VALUES {_alias}),
han(alias, i, toks) AS (VALUES {_han}),
raws AS (SELECT object_id, unnest(regexp_extract_all(lower(search_text), '[A-Za-z0-9\\x{{4e00}}-\\x{{9fff}}]+')) AS raw FROM entry),
word AS (SELECT r.raw, mapped, {_stem} AS stem FROM (SELECT DISTINCT raw FROM raws) r LEFT JOIN alias a ON a.said = r.raw),
han_hit AS (SELECT w.raw, strpos(w.raw, h.alias) AS a, strpos(w.raw, h.alias) + length(h.alias) AS b, h.toks, row_number() OVER (PARTITION BY w.raw ORDER BY h.i) AS i
            FROM word w JOIN han h ON contains(w.raw, h.alias) WHERE w.mapped IS NULL AND w.stem = w.raw),
han_walk(raw, i, spans, toks) AS (
  SELECT DISTINCT raw, 0::BIGINT, []::STRUCT(a BIGINT, b BIGINT)[], []::VARCHAR[] FROM han_hit
  UNION ALL
  SELECT w.raw, h.i,
         CASE WHEN len(list_filter(w.spans, lambda s: greatest(s.a, h.a) < least(s.b, h.b))) > 0 THEN w.spans ELSE list_append(w.spans, {{'a': h.a, 'b': h.b}}) END,
         CASE WHEN len(list_filter(w.spans, lambda s: greatest(s.a, h.a) < least(s.b, h.b))) > 0 THEN w.toks ELSE list_concat(w.toks, list_filter(h.toks, lambda t: NOT list_contains(w.toks, t))) END
  FROM han_walk w JOIN han_hit h ON h.raw = w.raw AND h.i = w.i + 1),
han_done AS (SELECT raw, arg_max(toks, i) AS toks FROM han_walk GROUP BY raw),
spelled AS (SELECT w.raw, CASE WHEN mapped IS NOT NULL THEN string_split(mapped, ' ') WHEN d.toks IS NOT NULL AND len(d.toks) > 0 THEN d.toks ELSE [stem] END AS toks
            FROM word w LEFT JOIN han_done d ON d.raw = w.raw),
tok AS (SELECT r.object_id, unnest(s.toks) AS token FROM raws r JOIN spelled s ON s.raw = r.raw),
posting AS (SELECT object_id, token, count(*) AS tf FROM tok WHERE token NOT IN ({_stop}) AND length(token) > 0 GROUP BY ALL)"""


def query_values() -> str:
    rows = []
    for key, said in QUERIES:
        counts = Counter(X.query_tokens(said))
        rows += [f"({q(key)}, {q(' '.join(said.split()))}, {q(t)}, {n}, {len(counts)})" for t, n in counts.items()]
    return f"query_term(query_id, query, token, qc, terms) AS (VALUES {', '.join(rows)})"


LEXICAL = f"""
{query_values()},
dl AS (SELECT e.object_id, coalesce(sum(tf), 0) AS dl FROM entry e LEFT JOIN posting p ON p.object_id = e.object_id GROUP BY 1),
stat AS (SELECT count(*) AS n, greatest(avg(dl), 1) AS mean FROM dl),
dfs AS (SELECT token, count(*) AS df FROM posting GROUP BY 1),
raw_score AS (
  SELECT t.query_id, t.query, p.object_id, t.terms, count(*) AS matched,
         sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean)) * least(qc, 2)) AS raw
  FROM query_term t JOIN posting p ON p.token = t.token JOIN dl ON dl.object_id = p.object_id JOIN dfs ON dfs.token = t.token, stat GROUP BY ALL),
lexical AS (
  SELECT query_id, s.object_id, dataset, motion_id,
         round(raw * (0.65::DOUBLE + matched::DOUBLE / terms) + CASE WHEN contains(lower(search_text), lower(query)) THEN 3 ELSE 0 END
               + CASE WHEN lower(query) = lower(motion_id) THEN 4 ELSE 0 END + CASE WHEN lower(query) IN (lower(motion_id), lower(dataset)) THEN 1 ELSE 0 END, 6) AS score
  FROM raw_score s JOIN entry e ON e.object_id = s.object_id WHERE raw > 0),
lexical_rank AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dataset, motion_id, object_id) AS rank FROM lexical)"""

_FTS = """
fts AS (SELECT t.query_id, p.object_id, round(sum(greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))), 6) AS match
        FROM query_term t JOIN posting p ON p.token = t.token JOIN dl ON dl.object_id = p.object_id JOIN dfs ON dfs.token = t.token, stat GROUP BY ALL),
fts_rank AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY match DESC, object_id) AS place FROM fts)"""

# dense requests: vectors of stored captions stand for encoded texts (whole text, then clauses)
DENSE = {"q1": (101,), "q2": (202, 303), "q5": (404, 505, 606)}
_whole = ", ".join(f"({q(k)}, {v[0]})" for k, v in DENSE.items())
_part = ", ".join(f"({q(k)}, {c})" for k, v in DENSE.items() for c in v[1:])
DENSE_SQL = f"""
vec AS (SELECT vec_id, object_id, embedding::DOUBLE[] AS v FROM semantic_index WHERE embedding IS NOT NULL AND len(embedding) = 64),
whole AS (SELECT w.query_id, v FROM (VALUES {_whole}) w(query_id, vec_id) JOIN vec ON vec.vec_id = w.vec_id),
part AS (SELECT p.query_id, v FROM (VALUES {_part}) p(query_id, vec_id) JOIN vec ON vec.vec_id = p.vec_id),
dense_part AS (SELECT p.query_id, x.vec_id, max(list_dot_product(p.v, x.v)) AS s FROM part p, vec x GROUP BY ALL),
dense AS (SELECT w.query_id, x.vec_id, x.object_id, CASE WHEN d.s IS NULL THEN list_dot_product(w.v, x.v) ELSE 0.6::DOUBLE * list_dot_product(w.v, x.v) + 0.4::DOUBLE * d.s END AS score
          FROM whole w CROSS JOIN vec x LEFT JOIN dense_part d ON d.query_id = w.query_id AND d.vec_id = x.vec_id),
dense_rank AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM dense),
dense_best AS (SELECT query_id, object_id, min(rank) AS rank, arg_min(score, rank) AS score FROM dense_rank WHERE rank <= 1200 AND object_id IS NOT NULL GROUP BY ALL)"""

CLOSURE = """
up(node_id, ancestor_id, distance) AS (
  SELECT id, id, 0 FROM taxonomy_node
  UNION ALL SELECT u.node_id, n.parent_id, u.distance + 1 FROM up u JOIN taxonomy_node n ON n.id = u.ancestor_id WHERE n.parent_id IS NOT NULL)"""
FORCE = """
force AS (SELECT object_id, series_key, classification FROM (
  SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY classified_at DESC NULLS LAST, entry_no DESC) AS turn FROM motion_entry WHERE object_id IS NOT NULL) WHERE turn = 1)"""
LIBRARY = f"""{ENTRY},{FORCE},{CLOSURE},
ups AS (SELECT node_id, list(ancestor_id) AS a FROM up GROUP BY 1),
lib AS (SELECT e.object_id, e.dataset, e.motion_id, e.frame_count,
          CASE WHEN e.dataset IN ('interhuman', 'interx') THEN 'pair' WHEN e.dataset IN ('motionxpp', 'motionlab') THEN 'single' ELSE 'group_or_unknown' END AS participants,
          f.classification.taxonomy['space'] AS space, f.classification.taxonomy['action_category'] AS action_category, f.classification.taxonomy['action_tag'] AS action_tag,
          f.classification.taxonomy['activity_domain'] AS activity_domain
        FROM entry e LEFT JOIN force f ON f.object_id = e.object_id),
direct AS (SELECT DISTINCT object_id, n.id AS node_id FROM (SELECT object_id, unnest(classification.action_nodes) AS n FROM force WHERE object_id IN (SELECT object_id FROM entry))),
subtree AS (SELECT DISTINCT d.object_id, coalesce(u.ancestor_id, d.node_id) AS node_id FROM direct d LEFT JOIN up u ON u.node_id = d.node_id)"""
_ok = {"dataset": "l.dataset = 'motionxpp'", "space": "coalesce(l.space = 'indoor', false)", "action_category": "coalesce(l.action_category = 'ground_travel', false)"}


def facets_sql(filters: dict[str, str]) -> str:
    scope = lambda own: " AND ".join([c for f, c in filters.items() if f != own] or ["true"])
    parts = [f"SELECT '{f}' AS facet, l.{f} AS value, ({scope(f)}) AS ok FROM lib l" for f in ("dataset", *X.AXES)]
    parts.append(f"SELECT 'action_node', s.node_id, ({scope('action_node')}) FROM subtree s JOIN lib l ON l.object_id = s.object_id")
    parts.append(f"SELECT 'action_node_direct', s.node_id, ({scope('action_node')}) FROM direct s JOIN lib l ON l.object_id = s.object_id")
    return f"WITH RECURSIVE {LIBRARY}, facet AS ({' UNION ALL '.join(parts)}) SELECT facet, value, count(*) FILTER (WHERE ok) AS n FROM facet WHERE value IS NOT NULL GROUP BY ALL"


_SCORED = f"""{FORCE},
scored AS (SELECT object_id, round(classification.classification_model.score, 6) AS score, round(classification.classification_model.margin, 6) AS margin, coalesce(classification.rule_conflict, false) AS rule_conflict
           FROM force WHERE classification.classification_model.score IS NOT NULL AND classification.classification_model.margin IS NOT NULL),
cut AS (SELECT round(quantile_cont(score, 0.75), 6) AS hs, round(quantile_cont(margin, 0.75), 6) AS hm, round(quantile_cont(score, 0.25), 6) AS ms, round(quantile_cont(margin, 0.25), 6) AS mm FROM scored),
level AS (SELECT s.*, CASE WHEN score >= hs AND margin >= hm THEN 'high' WHEN score >= ms AND margin >= mm THEN 'medium' ELSE 'low' END AS level FROM scored s, cut)"""
_PHRASE = f"""
spoken AS (SELECT id AS node_id, unnest(list_concat([en], coalesce(aliases_en, []), coalesce(aliases_zh, []))) AS alias FROM taxonomy_node WHERE kind NOT IN ('domain', 'category') OR len(aliases_en) > 0),
phrase AS (SELECT DISTINCT node_id, {ttokens('alias')} AS p FROM spoken WHERE alias IS NOT NULL),
body AS (SELECT object_id, {ttokens("concat_ws(' ', dataset, motion_id, description, array_to_string(captions, ' '))")} AS t FROM entry),
joined AS (SELECT object_id, chr(1) || array_to_string(t, chr(1)) || chr(1) AS t FROM body)"""
_MATCHED = f"""{_PHRASE},
latin AS (SELECT object_id, node_id, array_to_string(p, ' ') AS phrase, len(p) AS n FROM joined JOIN phrase ON len(p) > 0 AND contains(t, chr(1) || array_to_string(p, chr(1)) || chr(1))),
zh AS (SELECT DISTINCT node_id, regexp_replace(lower(alias), '[^\\pL\\pN\\pM]+', '', 'g') AS alias FROM (
        SELECT id AS node_id, unnest(list_concat([zh_cn], coalesce(aliases_zh, []))) AS alias FROM taxonomy_node WHERE asset_taxonomy AND kind = 'action') WHERE regexp_matches(alias, '[\\x{{4e00}}-\\x{{9fff}}]')),
compact AS (SELECT object_id, regexp_replace(lower(s), '[^\\pL\\pN\\pM]+', '', 'g') AS s FROM (SELECT object_id, concat_ws(' ', dataset, motion_id, description, array_to_string(captions, ' ')) AS s FROM entry) WHERE regexp_matches(s, '[\\x{{4e00}}-\\x{{9fff}}]')),
han_node AS (SELECT object_id, node_id, alias AS phrase, length(alias) AS n FROM compact JOIN zh ON alias <> '' AND contains(s, alias)),
match AS (SELECT object_id, node_id, array_to_string(list_sort(list(DISTINCT phrase)), '|') AS matched, max(n) AS length FROM (SELECT * FROM latin UNION ALL SELECT * FROM han_node) GROUP BY ALL)"""
_CASE = f"cases(query_id, language, query_type, pattern, forbidden) AS (VALUES {', '.join(f'({q(k)}, {q(lang)}, {q(kind)}, {q(p)}, {q(f)})' for k, _, lang, kind, p, f in CASES)})"
_METRIC = f"""{ENTRY},{POSTING},{LEXICAL},{_CASE},
judged AS (SELECT c.*, l.rank, l.object_id, regexp_matches(e.dataset || '/' || e.motion_id || ' ' || e.description, '(?i)' || c.pattern) AS relevant, regexp_matches(e.dataset || '/' || e.motion_id, '(?i)' || c.forbidden) AS bad,
             CASE WHEN e.series_key <> '' THEN {series('e.dataset', 'lower(e.motion_id)')} ELSE e.dataset || '/' || lower(e.motion_id) END AS key
           FROM cases c JOIN lexical_rank l ON l.query_id = c.query_id AND l.rank <= 50 JOIN entry e ON e.object_id = l.object_id),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id, relevant ORDER BY rank) AS nth FROM judged),
metric AS (SELECT query_id, language, query_type,
    coalesce(min(rank) FILTER (WHERE relevant AND nth <= 10) <= 5, false) AS hit_at_5,
    coalesce(CASE WHEN min(rank) FILTER (WHERE relevant AND nth <= 10) <= 10 THEN 1.0::DOUBLE / min(rank) FILTER (WHERE relevant AND nth <= 10) END, 0) AS mrr_at_10,
    coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE relevant AND nth <= 10 AND rank <= 10), 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i)) AS ndcg_at_10,
    least(count(*) FILTER (WHERE relevant AND nth <= 10) / 10.0::DOUBLE, 1) AS recall_at_50,
    (count(*) FILTER (WHERE rank <= 10) - count(DISTINCT key) FILTER (WHERE rank <= 10)) / greatest(count(*) FILTER (WHERE rank <= 10), 1)::DOUBLE AS duplicate_rate_at_10,
    count(*) FILTER (WHERE rank <= 10 AND bad) AS forbidden_hits_at_10
  FROM hits GROUP BY ALL)"""
_MEANS = ", ".join(f"round(avg({c}::DOUBLE), 6) AS {c}" for c in ("hit_at_5", "mrr_at_10", "ndcg_at_10", "recall_at_50", "duplicate_rate_at_10"))
_CAPTION_ROWS = f"""
base AS (SELECT record_id, trim(object_id) AS object_id, coalesce(dataset, '') AS dataset, coalesce(motion_id, '') AS motion_id, CASE WHEN len(captions) > 0 THEN captions ELSE [coalesce(description, '')] END AS listed FROM motion_index WHERE trim(object_id) <> ''),
cap AS (SELECT record_id, object_id, unnest(list_transform(listed, lambda c: {clean('c')})) AS caption, generate_subscripts(listed, 1) - 1 AS k FROM base),
caption_row AS (
  SELECT record_id, object_id, {title('dataset', 'motion_id')} AS caption, -1 AS caption_rank, 'source_title' AS source_type FROM base WHERE {title('dataset', 'motion_id')} <> ''
  UNION ALL SELECT record_id, object_id, caption, min(k)::INTEGER, 'caption' FROM cap WHERE {searchable('caption')} GROUP BY record_id, object_id, caption)"""



def token_sql(source: str, head: str) -> str:
    """CTEs that give ``<head>_set(key, toks)``, the distinct search tokens of the texts of ``source`` (key, text)."""
    names = ("raws", "word", "han_hit", "han_walk", "han_done", "spelled", "tok", "posting")
    body = POSTING[POSTING.index("raws AS") :].replace("FROM entry)", f"FROM {source})").replace("object_id", "key").replace("search_text", "text")
    for n in names:
        body = re.sub(rf"\b{n}\b", f"{head}_{n}", body)
    return body + f",\n{head}_set AS (SELECT key, list(DISTINCT token) AS toks FROM {head}_posting GROUP BY 1)"


match_key = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]+', ' ', 'g'))"
_KEPT = f"list_filter(list_filter(list_concat([description], captions), lambda t, i: list_position(list_concat([description], captions), t) = i), lambda t: {searchable(clean('t'))})"


def rerank_sql(short: str) -> str:
    """``reranked`` over ``short`` (query_id, query, object_id, base_score)."""
    return f"""
short_row AS (SELECT s.query_id, s.query, s.base_score, e.*, left(array_to_string({_KEPT}, ' '), 3000) AS document FROM {short} s JOIN entry e ON e.object_id = s.object_id),
said AS (SELECT DISTINCT 'q' || query_id AS key, query AS text FROM short_row UNION ALL SELECT DISTINCT 't' || object_id, source_title FROM short_row UNION ALL SELECT DISTINCT 'd' || object_id, document FROM short_row),
{token_sql('said', 'rr')},
pair AS (SELECT s.*, coalesce(a.toks, []) AS qt, coalesce(t.toks, []) AS tt, coalesce(d.toks, []) AS dt FROM short_row s LEFT JOIN rr_set a ON a.key = 'q' || s.query_id LEFT JOIN rr_set t ON t.key = 't' || s.object_id LEFT JOIN rr_set d ON d.key = 'd' || s.object_id),
sides AS (SELECT *, 4.0::DOUBLE * len(list_intersect(qt, tt)) / greatest(len(qt), 1) - 2 AS by_title, 4.0::DOUBLE * len(list_intersect(qt, dt)) / greatest(len(qt), 1) - 2 AS caption_score,
            {match_key('query')} IN ({match_key('motion_id')}, {match_key('source_title')}) AS exact FROM pair),
reranked AS (SELECT *, CASE WHEN source_title <> '' THEN by_title END AS title_score,
               CASE WHEN source_title <> '' THEN greatest(by_title, least(caption_score, by_title + 1)) ELSE caption_score END + CASE WHEN exact THEN 100 ELSE 0 END + least(base_score, 1) * 0.01::DOUBLE AS reranker_score FROM sides)"""


def diversify_sql(source: str) -> str:
    """``placed`` (query_id, object_id, place) over ``source`` (query_id, object_id, score, motion_id, series_key, source_title, description)."""
    return f"""
about AS (SELECT DISTINCT object_id AS key, CASE WHEN source_title <> '' THEN source_title ELSE description END AS text FROM {source}),
{token_sql('about', 'dv')},
item AS (SELECT s.query_id, s.object_id, s.score, s.motion_id, s.series_key, coalesce(t.toks, []) AS w, min(score) OVER (PARTITION BY query_id) AS low, max(score) OVER (PARTITION BY query_id) AS high FROM {source} s LEFT JOIN dv_set t ON t.key = s.object_id),
alike AS (SELECT a.query_id, a.object_id, map(list(b.object_id), list(CASE WHEN a.series_key <> '' AND a.series_key = b.series_key THEN 1 WHEN len(list_distinct(list_concat(a.w, b.w))) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) END)) AS sims
          FROM item a JOIN item b ON a.query_id = b.query_id GROUP BY ALL),
worth AS (SELECT i.query_id, i.object_id, i.score, i.motion_id, (i.score - low) / greatest(high - low, 1e-6) AS norm, sims FROM item i JOIN alike a ON a.query_id = i.query_id AND a.object_id = i.object_id),
pick(query_id, k, acc) AS (
  SELECT DISTINCT query_id, 0, []::VARCHAR[] FROM worth
  UNION ALL
  SELECT query_id, max(k) + 1, list_append(any_value(acc), arg_max(object_id, {{'w': net, 's': score, 'm': motion_id}}))
  FROM (SELECT p.query_id, p.k, p.acc, w.object_id, w.score, w.motion_id, w.norm - least(0.75::DOUBLE, 0.15::DOUBLE * coalesce(list_sum(list_transform(p.acc, lambda c: w.sims[c])), 0)) AS net
        FROM pick p JOIN worth w ON w.query_id = p.query_id AND NOT list_contains(p.acc, w.object_id)) GROUP BY query_id),
placed AS (SELECT query_id, unnest(acc) AS object_id, generate_subscripts(acc, 1) AS place FROM (SELECT query_id, arg_max(acc, k) AS acc FROM pick GROUP BY 1))"""


def page_sql(ranked: str, query: str, k: int) -> str:
    """One page of a reranked and diversified search over ``ranked`` (object_id, dataset, motion_id, score, rank)."""
    return f"""
head0 AS (SELECT 'q' AS query_id, {q(query)} AS query, object_id, score AS base_score FROM {ranked} WHERE rank <= 20),
{rerank_sql('head0')},
headed AS (SELECT query_id, object_id, reranker_score AS score, motion_id, series_key, source_title, description FROM reranked),
{diversify_sql('headed')},
merged AS (SELECT r.object_id, r.dataset, r.motion_id, coalesce(h.score, r.score) AS score, p.place FROM {ranked} r LEFT JOIN headed h ON h.object_id = r.object_id LEFT JOIN placed p ON p.object_id = r.object_id),
turned AS (SELECT *, row_number() OVER (ORDER BY coalesce(place, 20), score DESC, dataset, motion_id, object_id) AS position, max(score) OVER () AS best FROM merged)
SELECT object_id, dataset, motion_id, round(score, 6) AS score, coalesce(round(score / nullif(best, 0), 6), 0) AS pooled_score, position::INTEGER AS position FROM turned WHERE position <= {k}"""


_SHORT = f"short AS (SELECT l.query_id, v.query, l.object_id, l.score AS base_score FROM lexical_rank l JOIN (VALUES {', '.join(f'({q(a)}, {q(b)})' for a, b in QUERIES)}) v(query_id, query) ON v.query_id = l.query_id WHERE rank <= 20)"
_SHORT_ROWS = "shorted AS (SELECT l.query_id, l.object_id, l.score, e.motion_id, e.series_key, e.source_title, e.description FROM lexical_rank l JOIN entry e ON e.object_id = l.object_id WHERE l.rank <= 20)"
_AXES = f"""
axis_root AS (SELECT node_id, arg_max(ancestor_id, distance) AS root_id FROM up GROUP BY 1),
axis0 AS (SELECT node_id, coalesce(legacy_category, 'special_actions') AS category, coalesce(legacy_tag, 'other') AS tag FROM axis_root JOIN taxonomy_node n ON n.id = root_id),
axis AS (SELECT node_id, category, tag, CASE WHEN tag = 'medical_care' THEN 'assist_care' {' '.join(f'WHEN category = {q(a)} THEN {q(b)}' for a, b in X.DOMAIN_OF_CATEGORY.items())} ELSE 'other' END AS domain FROM axis0),
label_path AS (SELECT node_id, list(n.zh_cn ORDER BY distance DESC) AS path FROM up JOIN taxonomy_node n ON n.id = up.ancestor_id GROUP BY 1)"""
_SPECIFIC = f"""
kin AS (SELECT node_id, list(ancestor_id) AS a FROM up GROUP BY 1),
hit AS (SELECT m.object_id, m.node_id, m.length, m.matched, k.a, row_number() OVER (PARTITION BY m.object_id ORDER BY coalesce(n.priority, 50) DESC, m.length DESC, m.node_id) AS i FROM match m JOIN taxonomy_node n ON n.id = m.node_id JOIN kin k ON k.node_id = m.node_id),
walk(object_id, i, acc, over) AS (
  SELECT DISTINCT object_id, 0::BIGINT, []::VARCHAR[], []::VARCHAR[] FROM hit
  UNION ALL
  SELECT w.object_id, h.i, CASE WHEN list_contains(w.over, h.node_id) OR list_has_any(h.a, w.acc) THEN w.acc ELSE list_append(w.acc, h.node_id) END,
         CASE WHEN list_contains(w.over, h.node_id) OR list_has_any(h.a, w.acc) THEN w.over ELSE list_concat(w.over, h.a) END
  FROM walk w JOIN hit h ON h.object_id = w.object_id AND h.i = w.i + 1),
picked AS (SELECT object_id, list_slice(arg_max(acc, i), 1, 8) AS ids FROM walk GROUP BY 1)"""
_SPACE = f"""
space_body AS (SELECT object_id, {ttokens("concat_ws(' ', dataset, motion_id, description, array_to_string(captions, ' '))")} AS t FROM entry),
space_key AS (SELECT object_id, list_has_any(t, [{', '.join(map(q, X.INDOOR))}]) AS i, list_has_any(t, [{', '.join(map(q, X.OUTDOOR))}]) AS o FROM space_body),
space_of AS (SELECT object_id, CASE WHEN i AND NOT o THEN 'indoor' WHEN o AND NOT i THEN 'outdoor' ELSE 'mixed_or_unspecified' END AS space FROM space_key)"""
_PARTICIPANTS = "CASE WHEN e.dataset IN ('interhuman', 'interx') THEN 'pair' WHEN e.dataset IN ('motionxpp', 'motionlab') THEN 'single' ELSE 'group_or_unknown' END"
_PROTO = f"""{FORCE},{CLOSURE},
root AS (SELECT node_id, arg_max(ancestor_id, distance) AS root_id FROM up GROUP BY 1),
emb AS (SELECT vec_id, object_id, embedding::DOUBLE[] AS v FROM semantic_index WHERE embedding IS NOT NULL AND len(embedding) > 0 AND object_id IS NOT NULL),
label AS (SELECT n.id AS node_id, n.parent_id, r.root_id FROM taxonomy_node n JOIN root r ON r.node_id = n.id WHERE asset_taxonomy AND NOT coalesce(legacy_only, false) AND kind = 'action'),
x AS (SELECT l.*, unnest(v) AS val, generate_subscripts(v, 1) AS k FROM emb JOIN force f ON f.object_id = emb.object_id JOIN label l ON l.node_id = f.classification.primary_action_node_id),
leaf AS (SELECT node_id, list(m ORDER BY k) AS v FROM (SELECT node_id, k, avg(val) AS m FROM x GROUP BY ALL) GROUP BY 1),
grp AS (SELECT parent_id, list(m ORDER BY k) AS v FROM (SELECT parent_id, k, avg(val) AS m FROM x GROUP BY ALL) GROUP BY 1),
major AS (SELECT root_id, list(m ORDER BY k) AS v FROM (SELECT root_id, k, avg(val) AS m FROM x GROUP BY ALL) GROUP BY 1),
proto AS (SELECT l.node_id, a.v AS lv, b.v AS gv, c.v AS mv FROM label l JOIN leaf a ON a.node_id = l.node_id JOIN grp b ON b.parent_id = l.parent_id JOIN major c ON c.root_id = l.root_id),
ruled AS (SELECT DISTINCT object_id, n.id AS node_id FROM (SELECT object_id, unnest(classification.action_nodes) AS n FROM force)),
s AS (SELECT e.object_id, e.vec_id, p.node_id, round(0.7::DOUBLE * list_dot_product(e.v, lv) + 0.2::DOUBLE * list_dot_product(e.v, gv) + 0.1::DOUBLE * list_dot_product(e.v, mv) + CASE WHEN r.node_id IS NOT NULL THEN 0.015::DOUBLE ELSE 0 END, 6) AS score, round(list_dot_product(e.v, lv), 6) AS leaf_score
      FROM emb e CROSS JOIN proto p LEFT JOIN ruled r ON r.object_id = e.object_id AND r.node_id = p.node_id),
five AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, node_id) AS turn FROM s) WHERE turn <= 5),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY object_id, node_id ORDER BY score DESC, vec_id) AS nth FROM five) WHERE nth = 1),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY score DESC, node_id) AS rank FROM best) WHERE rank <= 5)"""
_TOP = f"""{_PROTO},
expected AS (SELECT f.object_id, list_sort(list_distinct(list_filter(list_transform(coalesce(classification.action_nodes, []), lambda n: n.id), lambda i: starts_with(i, '{LEAVES}')))) AS leaves FROM force f),
top AS (SELECT c.object_id, min(CASE WHEN rank = 1 THEN c.node_id END) AS node_id, max(CASE WHEN rank = 1 THEN score END) AS score, round(max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 2 THEN score END), 6) AS margin,
          max(CASE WHEN rank = 1 THEN vec_id END) AS vec_id, array_to_string(list(c.node_id ORDER BY rank), '|') AS every FROM cand c GROUP BY 1 HAVING count(*) > 1),
judged AS (SELECT t.*, coalesce(e.leaves, []) AS expected, len(coalesce(e.leaves, [])) > 0 AND NOT list_contains(coalesce(e.leaves, []), t.node_id) AS rule_conflict FROM top t LEFT JOIN expected e ON e.object_id = t.object_id),
cut AS (SELECT round(quantile_cont(score, 0.75), 6) AS hs, round(quantile_cont(margin, 0.75), 6) AS hm, round(quantile_cont(score, 0.25), 6) AS ms, round(quantile_cont(margin, 0.25), 6) AS mm FROM judged),
level AS (SELECT s.*, CASE WHEN score >= hs AND margin >= hm THEN 'high' WHEN score >= ms AND margin >= mm THEN 'medium' ELSE 'low' END AS level FROM judged s, cut)"""


_glb = "CASE WHEN regexp_extract(motion_id, '([^/]+)/*$', 1) <> '' THEN regexp_extract(motion_id, '([^/]+)/*$', 1) ELSE object_id END || '.glb'"


def statements() -> dict[str, str]:
    e = f"WITH {ENTRY}"
    fused = f"""WITH RECURSIVE {ENTRY},{POSTING},{LEXICAL},{DENSE_SQL},
fused AS (SELECT coalesce(l.query_id, d.query_id) AS query_id, coalesce(l.object_id, d.object_id) AS object_id,
            coalesce(0.45::DOUBLE / (60 + l.rank), 0) + coalesce(0.55::DOUBLE / (60 + d.rank), 0) AS fused
          FROM (SELECT * FROM lexical_rank WHERE rank <= 300 AND query_id IN ({', '.join(map(q, DENSE))})) l FULL JOIN dense_best d ON d.query_id = l.query_id AND d.object_id = l.object_id)"""
    node_source = "SELECT unnest(source_refs) AS source, id FROM taxonomy_node"
    return {
        "asset_entries": f"{e} SELECT object_id, record_id, dataset, motion_id, source_title, series_key, description, len(captions)::INTEGER AS n_captions, frame_count FROM entry",
        "scan_filter_assets": f"{e} SELECT object_id, motion_id, frame_count FROM entry WHERE dataset = 'interx' AND frame_count IS NOT NULL",
        "normalize_caption": f"SELECT record_id, k, {clean('c')} AS caption, {searchable(clean('c'))} AS searchable FROM (SELECT record_id, unnest(captions) AS c, generate_subscripts(captions, 1) - 1 AS k FROM motion_index)",
        "explode_captions_dedup": f"WITH {_CAPTION_ROWS} SELECT * FROM caption_row",
        "tokenize_terms": f"WITH RECURSIVE {ENTRY},{POSTING} SELECT object_id, token, tf FROM posting",
        "doc_length": f"WITH RECURSIVE {ENTRY},{POSTING} SELECT e.object_id, coalesce(sum(tf), 0)::BIGINT AS dl FROM entry e LEFT JOIN posting p ON p.object_id = e.object_id GROUP BY 1",
        "idf_table": f"WITH RECURSIVE {ENTRY},{POSTING}, n AS (SELECT count(*) AS n FROM entry) SELECT token, count(*) AS df, round(ln(1 + (max(n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)), 6) AS idf FROM posting, n GROUP BY token",
        "bm25_search": f"WITH RECURSIVE {ENTRY},{POSTING},{LEXICAL} SELECT query_id, object_id, dataset, motion_id, score, rank::INTEGER AS rank FROM lexical_rank WHERE rank <= 50",
        "fts_candidates": f"WITH RECURSIVE {ENTRY},{POSTING},{query_values()} SELECT DISTINCT query_id, object_id FROM query_term t JOIN posting p ON p.token = t.token",
        "fts_limited": f"WITH RECURSIVE {ENTRY},{POSTING},{LEXICAL},{_FTS} SELECT query_id, object_id, match FROM fts_rank WHERE place <= 40",
        "limited_search": f"WITH RECURSIVE {ENTRY},{POSTING},{LEXICAL},{_FTS}, few AS (SELECT l.* EXCLUDE (rank), row_number() OVER (PARTITION BY l.query_id ORDER BY score DESC, dataset, motion_id, l.object_id) AS rank FROM lexical_rank l JOIN fts_rank f ON f.query_id = l.query_id AND f.object_id = l.object_id AND f.place <= 100) SELECT query_id, object_id, dataset, motion_id, score, rank::INTEGER AS rank FROM few WHERE rank <= 10",
        "entries_page": f"WITH RECURSIVE {ENTRY},{POSTING},{LEXICAL}, s AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM lexical), f AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS total, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dataset, motion_id, object_id) AS place FROM s WHERE dataset = 'motionxpp') SELECT query_id, object_id, score, coalesce(round(score / nullif(best, 0), 6), 0) AS pooled_score, total, place::INTEGER AS place FROM f WHERE place BETWEEN 21 AND 40",
        "dataset_summary": f"{e} SELECT dataset, count(*) AS n FROM entry GROUP BY 1",
        "sort_frame_count_desc": f"{e} SELECT object_id, dataset, motion_id, frame_count FROM entry ORDER BY coalesce(frame_count, 0) DESC, dataset, motion_id, object_id LIMIT 20 OFFSET 40",
        "page_counts": f"{e} SELECT dataset, greatest(1, ceil(count(*) / 20.0))::BIGINT AS pages FROM entry GROUP BY 1",
        "left_join_assignments": f"WITH {ENTRY},{FORCE} SELECT e.object_id, f.classification.primary_action_node_id AS node_id, f.classification.taxonomy_version AS version, round(f.classification.classification_confidence, 6) AS confidence FROM entry e LEFT JOIN force f ON f.object_id = e.object_id",
        "anti_unclassified": f"{e} SELECT object_id FROM entry WHERE object_id NOT IN (SELECT object_id FROM motion_entry WHERE object_id IS NOT NULL)",
        "semi_known_ids": f"{e} SELECT vec_id FROM semantic_index WHERE object_id IN (SELECT object_id FROM entry)",
        "unknown_ids": f"{e} SELECT DISTINCT object_id FROM semantic_index WHERE object_id IS NOT NULL AND object_id NOT IN (SELECT object_id FROM entry)",
        "dense_topk": f"WITH {DENSE_SQL} SELECT query_id, vec_id, round(score, 6) AS score, rank::INTEGER AS rank FROM dense_rank WHERE rank <= 50",
        "best_caption_per_object": f"WITH {DENSE_SQL} SELECT query_id, object_id, rank::INTEGER AS rank, round(score, 6) AS score FROM dense_best",
        "full_outer_fusion": f"{fused} SELECT query_id, f.object_id, round(fused, 9) AS fused FROM fused f JOIN entry e ON e.object_id = f.object_id",
        "running_weight": f"WITH RECURSIVE {ENTRY},{POSTING},{LEXICAL} SELECT query_id, object_id, round(sum(exp(score / 10.0::DOUBLE)) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING), 4) AS cumulative FROM lexical_rank WHERE rank <= 50",
        "hierarchy_closure": f"WITH RECURSIVE {CLOSURE} SELECT node_id, ancestor_id, distance FROM up",
        "hierarchy_roots": f"WITH RECURSIVE {CLOSURE} SELECT node_id, arg_max(ancestor_id, distance) AS root_id, max(distance) + 1 AS depth FROM up GROUP BY 1",
        "hierarchy_path": f"WITH RECURSIVE {CLOSURE} SELECT node_id, array_to_string(list(n.zh_cn ORDER BY distance DESC), ' > ') AS path FROM up JOIN taxonomy_node n ON n.id = up.ancestor_id GROUP BY 1",
        "hierarchy_lint": f"WITH RECURSIVE {CLOSURE} SELECT id, 'duplicate' AS problem FROM taxonomy_node GROUP BY id HAVING count(*) > 1 UNION ALL SELECT id, 'missing parent' FROM taxonomy_node WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM taxonomy_node) UNION ALL SELECT id, 'missing sources' FROM taxonomy_node WHERE coalesce(len(source_refs), 0) = 0 UNION ALL SELECT id, 'too deep' FROM taxonomy_node WHERE NOT coalesce(allow_depth, false) AND id IN (SELECT node_id FROM up GROUP BY 1 HAVING max(distance) + 1 > 2)",
        "legacy_axes": f"WITH RECURSIVE {CLOSURE}, root AS (SELECT node_id, arg_max(ancestor_id, distance) AS root_id FROM up GROUP BY 1), l AS (SELECT node_id, coalesce(legacy_category, 'special_actions') AS category, coalesce(legacy_tag, 'other') AS tag FROM root JOIN taxonomy_node n ON n.id = root_id) SELECT node_id, category, tag, CASE {' '.join(f'WHEN category = {q(a)} THEN {q(b)}' for a, b in X.DOMAIN_OF_CATEGORY.items())} ELSE 'other' END AS domain FROM l",
        "visible_leaves": "SELECT id, en FROM taxonomy_node WHERE asset_taxonomy AND NOT coalesce(legacy_only, false) AND kind = 'action'",
        "catalog_counts": "SELECT kind, count(*) AS n FROM taxonomy_node GROUP BY 1",
        "node_sources": f"SELECT source, count(DISTINCT id) AS n FROM ({node_source}) GROUP BY 1",
        "tree_text_filter": f"WITH RECURSIVE {CLOSURE} SELECT DISTINCT ancestor_id AS node_id FROM up WHERE node_id IN (SELECT id FROM taxonomy_node WHERE contains(lower(coalesce(zh_cn, '')), 'walk') OR contains(lower(coalesce(en, '')), 'walk'))",
        "subtree_counts": f"WITH RECURSIVE {LIBRARY} SELECT n.id AS node_id, (SELECT count(*) FROM subtree s WHERE s.node_id = n.id) AS n, (SELECT count(*) FROM direct s WHERE s.node_id = n.id) AS direct FROM taxonomy_node n",
        "library_filter_node": f"WITH RECURSIVE {LIBRARY} SELECT l.object_id, l.dataset, l.motion_id FROM lib l WHERE l.dataset = 'motionxpp' AND coalesce(l.space = 'indoor', false) AND EXISTS (SELECT 1 FROM subtree s JOIN taxonomy_node n ON n.id = s.node_id WHERE s.object_id = l.object_id AND n.en = 'Straight walks')",
        "facets_default": facets_sql({}),
        "facets_self_excluding": facets_sql(_ok),
        "facets_sparse": f"SELECT * FROM ({facets_sql(_ok)}) WHERE n > 0 AND (facet NOT LIKE 'action\\_node%' ESCAPE '\\' OR value IN (SELECT id FROM taxonomy_node WHERE asset_taxonomy AND NOT coalesce(legacy_only, false)))",
        "rule_phrase_match": f"WITH {ENTRY},{_MATCHED} SELECT object_id, node_id, matched, length::INTEGER AS length FROM match",
        "space_keyword_axis": f"WITH {ENTRY}, body AS (SELECT object_id, {ttokens("concat_ws(' ', dataset, motion_id, description, array_to_string(captions, ' '))")} AS t FROM entry), k AS (SELECT object_id, list_has_any(t, [{', '.join(map(q, X.INDOOR))}]) AS i, list_has_any(t, [{', '.join(map(q, X.OUTDOOR))}]) AS o FROM body) SELECT object_id, CASE WHEN i AND NOT o THEN 'indoor' WHEN o AND NOT i THEN 'outdoor' ELSE 'mixed_or_unspecified' END AS space FROM k",
        "confidence_thresholds": f"WITH {_SCORED} SELECT hs AS high_score, hm AS high_margin, ms AS medium_score, mm AS medium_margin FROM cut",
        "confidence_levels": f"WITH {_SCORED} SELECT object_id, level FROM level",
        "audit_sample": f"WITH {_SCORED} SELECT object_id, level FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY object_id) AS turn FROM level) WHERE turn <= 100",
        "review_queue": f"WITH {_SCORED}, r AS (SELECT object_id, list_filter([CASE WHEN level = 'low' THEN 'low_confidence' END, CASE WHEN rule_conflict THEN 'rule_model_conflict' END, CASE WHEN row_number() OVER (PARTITION BY level ORDER BY object_id) <= 100 THEN level || '_confidence_audit_sample' END], lambda x: x IS NOT NULL) AS reasons FROM level) SELECT object_id, reasons[1] AS reason, array_to_string(reasons, ',') AS reasons FROM r WHERE len(reasons) > 0",
        "assignment_report": f"WITH {ENTRY},{FORCE}, r AS (SELECT e.dataset, c.primary_action_node_id AS primary_node, c.taxonomy['action_tag'] AS action_tag, c.confidence_level, c.rule_conflict::VARCHAR AS rule_conflict FROM entry e LEFT JOIN (SELECT object_id, classification AS c FROM force) f ON f.object_id = e.object_id) "
        + " UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS n FROM r GROUP BY 2" for c in ("dataset", "primary_node", "action_tag", "confidence_level", "rule_conflict")),
        "prototype_texts": f"""WITH RECURSIVE {CLOSURE}, p AS (SELECT node_id, list(n.zh_cn ORDER BY distance DESC) AS path FROM up JOIN taxonomy_node n ON n.id = up.ancestor_id GROUP BY 1),
l AS (SELECT *, list_filter(list_concat(coalesce(aliases_en, []), coalesce(aliases_zh, [])), lambda a: length(a) > 0) AS every, list_filter(coalesce(aliases_en, []), lambda a: length(a) > 0) AS en_only FROM taxonomy_node WHERE asset_taxonomy AND NOT coalesce(legacy_only, false) AND kind = 'action'),
d AS (SELECT *, list_filter(every, lambda a, i: list_position(every, a) = i) AS all_a, list_filter(en_only, lambda a, i: list_position(en_only, a) = i) AS en_a FROM l)
SELECT id AS node_id, '动作分类：' || array_to_string(path, ' > ') || '。动作：' || zh_cn || '。' || CASE WHEN len(all_a) > 0 THEN '同义描述：' || array_to_string(all_a, ', ') || '。' ELSE '' END || CASE WHEN len(en_a) > 0 THEN ' English aliases: ' || array_to_string(en_a, ', ') || '.' ELSE '' END AS leaf_text,
 '动作类别：' || path[len(path) - 1] || '。所属领域：' || path[1] || '。' AS group_text, '动作领域：' || path[1] || '。' AS major_text FROM d JOIN p ON p.node_id = d.id""",
        "stable_ids": "SELECT record_id, sha256(coalesce(dataset, '') || ':' || coalesce(motion_id, '') || ':' || coalesce(source_motion, '')) AS object_hash, 'asset_tag_' || left(sha1(coalesce(dataset, '') || chr(31) || coalesce(motion_id, '')), 12) AS tag_id FROM motion_index",
        "series_dup_rate": f"{e} SELECT dataset, round((count(*) - count(DISTINCT CASE WHEN series_key <> '' THEN series_key ELSE dataset || '/' || lower(motion_id) END)) / greatest(count(*), 1)::DOUBLE, 6) AS duplicate_rate FROM entry GROUP BY 1",
        "eval_metrics": f"WITH RECURSIVE {_METRIC} SELECT query_id, hit_at_5, round(mrr_at_10, 6) AS mrr_at_10, round(ndcg_at_10, 6) AS ndcg_at_10, round(recall_at_50, 6) AS recall_at_50, round(duplicate_rate_at_10, 6) AS duplicate_rate_at_10, forbidden_hits_at_10 FROM metric",
        "eval_by_group": f"WITH RECURSIVE {_METRIC} SELECT CASE WHEN grouping(language) = 0 THEN 'language' WHEN grouping(query_type) = 0 THEN 'query_type' ELSE 'all' END AS grp, coalesce(language, query_type, 'all') AS value, count(*) AS query_count, {_MEANS}, sum(forbidden_hits_at_10)::BIGINT AS forbidden_hits_at_10 FROM metric GROUP BY GROUPING SETS ((), (language), (query_type))",
        "latency_percentiles": "SELECT event_type, list_sort(list(value))[(round_even((count(value) - 1) * 0.5::DOUBLE, 0) + 1)::BIGINT] AS p50, list_sort(list(value))[(round_even((count(value) - 1) * 0.95::DOUBLE, 0) + 1)::BIGINT] AS p95 FROM events WHERE value IS NOT NULL GROUP BY 1",
        "event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL",
        "preview_roll": """WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings), a AS (SELECT *, sqrt(x * x + y * y + z * z) AS g FROM v),
r AS (SELECT vec_id, -degrees(atan2(CASE WHEN g < 1e-8 THEN 0 ELSE -z / g * sin(g) + x / g * (y / g) * (1 - cos(g)) END, CASE WHEN g < 1e-8 THEN 0 ELSE x / g * sin(g) + z / g * (y / g) * (1 - cos(g)) END)) AS roll FROM a)
SELECT vec_id, CASE WHEN abs(roll) < 8 THEN 0 ELSE round(roll, 2) END AS roll FROM r""",
        "page_audit": f"{e}, b AS (SELECT ('0x' || left(md5(object_id), 4))::INTEGER AS h FROM entry) SELECT CASE WHEN h % 5 = 0 THEN 'missing' WHEN h % 5 = 1 THEN 'empty' WHEN h % 5 = 2 THEN 'invalid_format' WHEN h % 2 = 0 THEN 'ok' ELSE 'wrong_dimensions' END AS issue, count(*) AS n FROM b GROUP BY 1",
        "preview_resolve": f"{e}, b AS (SELECT *, ('0x' || left(md5(object_id), 4))::INTEGER AS h FROM entry) SELECT object_id, CASE WHEN h % 40 >= 16 AND h % 3 < 2 THEN '/previews/' || dataset || '/' || motion_id || CASE WHEN h % 3 = 0 THEN '.webp' ELSE '.png' END END AS preview_path FROM b",
        "shard_assign": "SELECT record_id FROM (SELECT record_id, row_number() OVER (ORDER BY dataset NULLS FIRST, motion_id NULLS FIRST, record_id) - 1 AS i FROM motion_index) WHERE i % 7 = 2",
        "union_builders": "WITH r AS (SELECT lower(trim(dataset)) AS dataset, coalesce(motion_id, '') AS motion_id, coalesce(source_motion, '') AS path, captions FROM motion_index) SELECT dataset, motion_id, sha256(dataset || ':' || motion_id || ':' || path) AS object_id, captions[1] AS description FROM r WHERE dataset IN ('interhuman', 'interx', 'motionxpp', 'motionlab')",
        "set_difference": f"WITH {FORCE} SELECT object_id FROM semantic_index WHERE object_id IS NOT NULL EXCEPT SELECT object_id FROM force WHERE classification IS NOT NULL",
        "set_intersection": f"{e} SELECT object_id FROM semantic_index WHERE object_id IS NOT NULL INTERSECT SELECT object_id FROM entry WHERE dataset = 'interx'",
        "alias_sets": "SELECT id, array_to_string(list_sort(list_distinct(list_concat(coalesce(aliases_en, []), coalesce(aliases_zh, [])))), '|') AS aliases FROM taxonomy_node",
        "label_fallthrough": f"WITH {FORCE} SELECT object_id, coalesce(classification.taxonomy_labels['action_category'], classification.taxonomy['action_category']) AS label, coalesce(classification.taxonomy_labels['action_tag'], classification.taxonomy['action_tag']) AS tag_label FROM force WHERE classification IS NOT NULL",
        "serialize_entries": f"{e} SELECT object_id, '/api/v1/models/' || object_id AS rest_download_path, CASE WHEN regexp_extract(motion_id, '([^/]+)$', 1) <> '' THEN regexp_extract(motion_id, '([^/]+)$', 1) ELSE object_id END || '.glb' AS filename, '/api/v1/previews/' || object_id || '.webp' AS preview_path FROM entry",
        "sample_seeded": f"""WITH RECURSIVE {ENTRY},{POSTING},{LEXICAL}, pool AS (SELECT *, max(CASE WHEN rank = 1 THEN score END) OVER (PARTITION BY query_id) AS first FROM lexical_rank WHERE rank <= 200),
keyed AS (SELECT *, score / greatest(first * 0.3::DOUBLE, 1e-6) - ln(-ln((('0x' || left(md5('seed7:' || query_id || ':' || object_id), 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)) AS key FROM pool)
SELECT query_id, object_id, place::INTEGER AS place FROM (SELECT query_id, object_id, row_number() OVER (PARTITION BY query_id ORDER BY key DESC, object_id) AS place FROM keyed) WHERE place <= 20""",
        "tag_texts": f"SELECT record_id, array_to_string({ttokens("concat_ws(' ', dataset, motion_id, description)")}, '|') AS tokens, {series("coalesce(dataset, '')", "coalesce(motion_id, '')")} AS series_key, {squeeze("regexp_replace(regexp_replace(replace(coalesce(motion_id, ''), '_', ' '), '\\s+([.,:;])', '\\1', 'g'), '([-/])', ' \\1 ', 'g')")} AS readable FROM motion_index",
        "library_page": f"WITH RECURSIVE {LIBRARY} SELECT object_id, dataset, motion_id, frame_count FROM lib WHERE dataset = 'motionxpp' AND coalesce(space = 'indoor', false) AND coalesce(action_category = 'ground_travel', false) ORDER BY dataset, motion_id, object_id LIMIT 20 OFFSET 20",
        "library_total": f"WITH RECURSIVE {LIBRARY} SELECT count(*) AS total FROM lib WHERE dataset = 'motionxpp' AND coalesce(space = 'indoor', false) AND coalesce(action_category = 'ground_travel', false)",
        "prototype_classify": f"WITH RECURSIVE {_PROTO} SELECT object_id, rank::INTEGER AS rank, node_id, score, leaf_score, vec_id AS matched_vec FROM cand",
        "rerank_combine": f"WITH RECURSIVE {ENTRY},{POSTING},{LEXICAL},{_SHORT},{rerank_sql('short')} SELECT query_id, object_id, round(title_score, 6) AS title_score, round(caption_score, 6) AS caption_score, exact AS exact_source_match, round(reranker_score, 6) AS reranker_score FROM reranked",
        "diversify_mmr": f"WITH RECURSIVE {ENTRY},{POSTING},{LEXICAL},{_SHORT_ROWS},{diversify_sql('shorted')} SELECT query_id, object_id, place::INTEGER AS place FROM placed",
        "library_rerank_merge": f"WITH RECURSIVE {ENTRY},{POSTING},{LEXICAL},{_SHORT_ROWS},{diversify_sql('shorted')}, turn AS (SELECT l.query_id, l.object_id, row_number() OVER (PARTITION BY l.query_id ORDER BY coalesce(place, 20), score DESC, dataset, motion_id, l.object_id) AS position FROM lexical_rank l LEFT JOIN placed p ON p.query_id = l.query_id AND p.object_id = l.object_id WHERE rank <= 300) SELECT query_id, object_id, position::INTEGER AS position FROM turn WHERE position <= 40",
        "search_page": f"WITH RECURSIVE {ENTRY},{POSTING},{LEXICAL},{_FTS}, ranked AS (SELECT * FROM (SELECT l.object_id, dataset, motion_id, score, row_number() OVER (ORDER BY score DESC, dataset, motion_id, l.object_id) AS rank FROM lexical_rank l JOIN fts_rank f ON f.query_id = l.query_id AND f.object_id = l.object_id AND place <= 1600 WHERE l.query_id = 'q2') WHERE rank <= 200),{page_sql('ranked', dict(QUERIES)['q2'], 20)}",
        "search_hybrid_page": f"""WITH RECURSIVE {ENTRY},{POSTING},{LEXICAL},{_FTS},
lex AS (SELECT * FROM (SELECT l.object_id, score, row_number() OVER (ORDER BY score DESC, dataset, motion_id, l.object_id) AS rank FROM lexical_rank l JOIN fts_rank f ON f.query_id = l.query_id AND f.object_id = l.object_id AND place <= 1600 WHERE l.query_id = 'q4') WHERE rank <= 200),
vec AS (SELECT vec_id, object_id, embedding::DOUBLE[] AS v FROM semantic_index WHERE embedding IS NOT NULL AND len(embedding) = 64),
near AS (SELECT x.vec_id, x.object_id, 0.6::DOUBLE * list_dot_product(a.v, x.v) + 0.4::DOUBLE * list_dot_product(b.v, x.v) AS score FROM vec x, (SELECT v FROM vec WHERE vec_id = 202) a, (SELECT v FROM vec WHERE vec_id = 303) b WHERE x.object_id IS NOT NULL),
den AS (SELECT object_id, min(rank) AS rank FROM (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, vec_id) AS rank FROM near) WHERE rank <= 800 GROUP BY 1),
mixed AS (SELECT coalesce(l.object_id, d.object_id) AS object_id, coalesce(0.45::DOUBLE / (60 + l.rank), 0) + coalesce(0.55::DOUBLE / (60 + d.rank), 0) AS score FROM lex l FULL JOIN den d ON d.object_id = l.object_id),
ranked AS (SELECT * FROM (SELECT m.object_id, dataset, motion_id, score, row_number() OVER (ORDER BY score DESC, dataset, motion_id, m.object_id) AS rank FROM mixed m JOIN entry e ON e.object_id = m.object_id) WHERE rank <= 200),{page_sql('ranked', dict(QUERIES)['q4'], 20)}""",
        "catalog_flatten": """WITH tag AS (SELECT DISTINCT m.zh_cn AS m, g.zh_cn AS g, t.zh_cn AS t, m.id AS mi, g.id AS gi, t.id AS ti FROM taxonomy_node m JOIN taxonomy_node g ON g.parent_id = m.id AND g.kind = 'tag_group' JOIN taxonomy_node t ON t.parent_id = g.id AND t.kind = 'action' WHERE m.kind = 'major')
SELECT 'asset_major_' || left(sha1(m), 12) AS id, NULL::VARCHAR AS parent_id, 'domain' AS kind, m AS zh_cn, 20 AS priority FROM (SELECT DISTINCT m, mi FROM tag)
UNION ALL SELECT 'asset_group_' || left(sha1(m || chr(31) || g), 12), 'asset_major_' || left(sha1(m), 12), 'category', g, 30 FROM (SELECT DISTINCT m, g, gi FROM tag)
UNION ALL SELECT 'asset_tag_' || left(sha1(m || chr(31) || g || chr(31) || t), 12), 'asset_group_' || left(sha1(m || chr(31) || g), 12), 'action', t, 40 FROM tag""",
        "specificity_select": f"WITH RECURSIVE {ENTRY},{_MATCHED},{CLOSURE},{_SPECIFIC} SELECT object_id, ids AS node_ids FROM picked",
        "rule_classification": f"""WITH RECURSIVE {ENTRY},{_MATCHED},{CLOSURE},{_SPECIFIC},{_AXES},{_SPACE}
SELECT e.object_id, p.ids[1] AS primary_action_node_id, coalesce(p.ids, []) AS node_ids, coalesce(a.category, 'special_actions') AS action_category, coalesce(a.tag, 'other') AS action_tag, coalesce(a.domain, 'other') AS activity_domain,
       {_PARTICIPANTS} AS participants, s.space, round(least(1, 0.45::DOUBLE + 0.12::DOUBLE * len(coalesce(p.ids, [])) + CASE WHEN h.length > 1 THEN 0.12::DOUBLE ELSE 0 END), 3) AS classification_confidence
FROM entry e LEFT JOIN picked p ON p.object_id = e.object_id LEFT JOIN axis a ON a.node_id = p.ids[1] LEFT JOIN hit h ON h.object_id = e.object_id AND h.node_id = p.ids[1] JOIN space_of s ON s.object_id = e.object_id""",
        "rule_records": f"""WITH RECURSIVE {ENTRY},{_MATCHED},{CLOSURE},{_SPECIFIC},{_AXES},
one AS (SELECT object_id, unnest(ids) AS node_id, generate_subscripts(ids, 1) AS pos FROM picked),
told AS (SELECT o.object_id, array_to_string(list(CASE WHEN pos = 1 THEN 'primary' ELSE 'secondary' END || '/' || o.node_id || '/' || array_to_string(path, '>') || '/' || replace(h.matched, '|', '+') ORDER BY pos), '|') AS nodes, max(CASE WHEN pos = 1 THEN replace(h.matched, '|', '+') END) AS tag, max(CASE WHEN pos = 1 THEN h.length END) AS length, count(*) AS n
         FROM one o JOIN label_path p ON p.node_id = o.node_id JOIN hit h ON h.object_id = o.object_id AND h.node_id = o.node_id GROUP BY 1)
SELECT e.object_id, coalesce(nodes, '') AS nodes, coalesce(tag, '') AS tag_keywords, CASE WHEN {_PARTICIPANTS} IN ('single', 'pair') THEN e.dataset ELSE '' END AS participant_keywords,
       round(least(1, 0.45::DOUBLE + 0.12::DOUBLE * coalesce(n, 0) + CASE WHEN length > 1 THEN 0.12::DOUBLE ELSE 0 END), 3) AS confidence FROM entry e LEFT JOIN told t ON t.object_id = e.object_id""",
        "reused_classification": f"WITH {ENTRY},{FORCE} SELECT e.object_id, coalesce(f.classification.taxonomy_version = '{VERSION}', false) AS cached, {_PARTICIPANTS} AS participants, CASE WHEN f.classification.taxonomy_version = '{VERSION}' THEN f.classification.primary_action_node_id END AS cached_node FROM entry e LEFT JOIN force f ON f.object_id = e.object_id",
        "rule_leaf_ids": f"WITH {FORCE} SELECT object_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(coalesce(classification.action_nodes, []), lambda n: n.id), lambda i: starts_with(i, '{LEAVES}')))), '|') AS leaves FROM force",
        "margins": f"WITH RECURSIVE {_TOP} SELECT object_id, node_id, score, margin FROM judged",
        "rule_conflicts": f"WITH RECURSIVE {_TOP} SELECT object_id, node_id, array_to_string(expected, '|') AS expected, rule_conflict FROM judged",
        "semantic_levels": f"WITH RECURSIVE {_TOP} SELECT object_id, level FROM level",
        "semantic_review": f"WITH RECURSIVE {_TOP}, r AS (SELECT object_id, list_filter([CASE WHEN level = 'low' THEN 'low_confidence' END, CASE WHEN rule_conflict THEN 'rule_model_conflict' END, CASE WHEN row_number() OVER (PARTITION BY level ORDER BY object_id) <= 100 THEN level || '_confidence_audit_sample' END], lambda x: x IS NOT NULL) AS reasons FROM level) SELECT object_id, reasons[1] AS reason, array_to_string(reasons, ',') AS reasons FROM r WHERE len(reasons) > 0",
        "apply_semantic": f"""WITH RECURSIVE {ENTRY},{_TOP},{_AXES},{_SPACE}
SELECT e.object_id, l.node_id, a.category AS action_category, a.tag AS action_tag, a.domain AS activity_domain, {_PARTICIPANTS} AS participants, s.space, array_to_string(p.path, ' > ') AS path, round(l.score, 3) AS confidence, l.margin, l.every AS candidates, l.level || '_confidence' AS status, coalesce(c.caption, '') AS matched_caption
FROM entry e JOIN level l ON l.object_id = e.object_id JOIN axis a ON a.node_id = l.node_id JOIN label_path p ON p.node_id = l.node_id JOIN space_of s ON s.object_id = e.object_id JOIN semantic_index c ON c.vec_id = l.vec_id WHERE starts_with(l.node_id, '{LEAVES}')""",
        "assignment_summary": f"""WITH {ENTRY},{FORCE}, c AS (SELECT count(*) AS n, count(f.classification.primary_action_node_id) AS k, count(DISTINCT f.classification.primary_action_node_id) AS u, count(*) FILTER (WHERE f.classification.rule_conflict) AS x FROM entry e LEFT JOIN force f ON f.object_id = e.object_id),
l AS (SELECT count(DISTINCT id) AS m FROM taxonomy_node WHERE asset_taxonomy AND NOT coalesce(legacy_only, false) AND kind = 'action')
SELECT unnest(['entry_count', 'classified_count', 'unclassified_count', 'unclassified_rate', 'leaf_label_count', 'used_leaf_label_count', 'empty_leaf_label_count', 'leaf_coverage_rate', 'rule_conflict_count']) AS measure,
       unnest([n::DOUBLE, k, n - k, round((n - k) / greatest(n, 1)::DOUBLE, 6), m, u, m - u, round(k / greatest(n, 1)::DOUBLE, 6), x]) AS value FROM c, l""",
        "ordered_counts": f"""WITH {ENTRY},{FORCE}, r AS (SELECT f.classification AS c FROM entry e JOIN force f ON f.object_id = e.object_id WHERE f.classification IS NOT NULL),
v AS (SELECT 'primary_node' AS dimension, c.primary_action_node_id AS value FROM r UNION ALL SELECT 'any_node', unnest(list_transform(c.action_nodes, lambda n: n.id)) FROM r UNION ALL SELECT 'tag', c.taxonomy['action_tag'] FROM r),
k AS (SELECT dimension, value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY ALL)
SELECT dimension, value, n, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, value) AS place FROM k) WHERE place <= 25""",
        "entry_lookup": f"{e} SELECT object_id, dataset, motion_id, description FROM entry WHERE object_id IN (SELECT object_id FROM semantic_index WHERE vec_id IN {LOOKED_UP})",
        "entry_full": f"{e} SELECT object_id, dataset AS animal, motion_id AS track_name, source_motion AS source_glb, '{BASE}/api/v1/previews/' || object_id || '.webp' AS preview_url, false AS available, '{BASE}/api/v1/entries/' || object_id AS self, '/models/' || object_id AS download_path, {_glb} AS filename, false AS has_icon FROM entry WHERE object_id IN (SELECT object_id FROM semantic_index WHERE vec_id IN {LOOKED_UP})",
        "entry_compact": f"{e} SELECT object_id, len(captions)::INTEGER AS n_captions, '/api/v1/previews/' || object_id || '.webp' AS preview_path, '/api/v1/models/' || object_id AS model_path, {_glb} AS filename, true AS lazy FROM entry",
        "search_items": f"WITH RECURSIVE {ENTRY},{POSTING},{LEXICAL}, t AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM lexical_rank WHERE rank <= 10) SELECT t.object_id, t.rank::INTEGER AS rank, t.score, CASE WHEN best <> 0 THEN round(t.score / best, 6) ELSE 0 END AS pooled_score, e.frame_count, '{BASE}/api/v1/models/' || t.object_id AS url, {_glb.replace('motion_id', 'e.motion_id').replace('object_id', 'e.object_id')} AS filename, 'model/gltf-binary' AS content_type, '{BASE}/api/v1/previews/' || t.object_id || '.webp' AS preview_url, '/api/v1/models/' || t.object_id AS model_path FROM t JOIN entry e ON e.object_id = t.object_id",
        "response_rows": f"WITH RECURSIVE {ENTRY},{POSTING},{LEXICAL} SELECT object_id, rank::INTEGER AS rank, '{BASE}/api/v1/models/' || object_id AS url FROM lexical_rank WHERE rank <= 5",
        "search_texts": f"""WITH RECURSIVE said0 AS (SELECT record_id, unnest(captions) AS c FROM motion_index), hans AS (SELECT row_number() OVER () AS i, record_id, c FROM said0 WHERE regexp_matches(c, '[\\x{{4e00}}-\\x{{9fff}}]')),
alias(said, mapped) AS (VALUES {_alias}), han(alias, i, toks) AS (VALUES {_han}),
parts AS (SELECT i, unnest(regexp_extract_all(lower(c), '[A-Za-z0-9\\x{{4e00}}-\\x{{9fff}}]+')) AS raw, generate_subscripts(regexp_extract_all(lower(c), '[A-Za-z0-9\\x{{4e00}}-\\x{{9fff}}]+'), 1) AS at FROM hans),
word AS (SELECT r.raw, mapped, {_stem} AS stem FROM (SELECT DISTINCT raw FROM parts) r LEFT JOIN alias a ON a.said = r.raw),
han_hit AS (SELECT w.raw, strpos(w.raw, h.alias) AS a, strpos(w.raw, h.alias) + length(h.alias) AS b, h.toks, row_number() OVER (PARTITION BY w.raw ORDER BY h.i) AS i FROM word w JOIN han h ON contains(w.raw, h.alias) WHERE w.mapped IS NULL AND w.stem = w.raw),
han_walk(raw, i, spans, toks) AS (SELECT DISTINCT raw, 0::BIGINT, []::STRUCT(a BIGINT, b BIGINT)[], []::VARCHAR[] FROM han_hit UNION ALL
  SELECT w.raw, h.i, CASE WHEN len(list_filter(w.spans, lambda s: greatest(s.a, h.a) < least(s.b, h.b))) > 0 THEN w.spans ELSE list_append(w.spans, {{'a': h.a, 'b': h.b}}) END,
         CASE WHEN len(list_filter(w.spans, lambda s: greatest(s.a, h.a) < least(s.b, h.b))) > 0 THEN w.toks ELSE list_concat(w.toks, list_filter(h.toks, lambda t: NOT list_contains(w.toks, t))) END FROM han_walk w JOIN han_hit h ON h.raw = w.raw AND h.i = w.i + 1),
han_done AS (SELECT raw, arg_max(toks, i) AS toks FROM han_walk GROUP BY raw),
spelled AS (SELECT w.raw, CASE WHEN mapped IS NOT NULL THEN string_split(mapped, ' ') WHEN d.toks IS NOT NULL AND len(d.toks) > 0 THEN d.toks ELSE [stem] END AS toks FROM word w LEFT JOIN han_done d ON d.raw = w.raw),
joined AS (SELECT i, array_to_string(list_filter(flatten(list(s.toks ORDER BY p.at)), lambda t: NOT list_contains([{_stop}], t) AND length(t) > 0), ' ') AS said FROM parts p JOIN spelled s ON s.raw = p.raw GROUP BY 1)
SELECT record_id, c, CASE WHEN coalesce(said, '') <> '' THEN said ELSE c END AS said FROM hans h LEFT JOIN joined j ON j.i = h.i""",
    }

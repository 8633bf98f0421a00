"""DuckDB SQL with the same results as the queries that SQL can express."""

from __future__ import annotations

from itertools import permutations

from slantree.llm.filter_audit import FILTERS
from slantree.llm.license_scan import CUE, TEMPLATES, THRESHOLD, WORD
from slantree.llm.quality_rules import POLICIES, mask
from slantree.llm.url_filter import BLOCKED_GLOBS, CONTRACT_RULES

WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def op4_license_scan() -> str:
    from slantree.llm.entries import PATH_SQL

    values = ", ".join(f"({k}, {_text(name)}, {_text(statement)})" for k, (name, statement) in enumerate(TEMPLATES))
    return f"""
with files as (select doc_id, text, {PATH_SQL.format(div="//", text="varchar")} as path from documents),
lines as (select doc_id, pos - 1 as line_no, line from (
    select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from files)
  where regexp_matches(line, '{CUE}')),
distinct_lines as (select line, count(*) as copies from lines group by line),
total as (select coalesce(sum(copies), 0) as headers from distinct_lines),
terms as (select line, copies, word, count(*) as n from (select line, copies, unnest(regexp_extract_all(lower(line), '{WORD}')) as word from distinct_lines) group by all),
template as (select template, license, word, count(*) as n_template from (
    select template, license, unnest(regexp_extract_all(lower(statement), '{WORD}')) as word from (values {values}) v(template, license, statement)) group by all),
vocabulary as (select distinct word from template),
held as (select word, sum(copies) as df from terms semi join vocabulary using (word) group by word),
idf as (select word, ln((1 + headers) / (1 + coalesce(df, 0))) + 1 as idf from vocabulary left join held using (word), total),
weighted as (select template, license, word, n_template * idf as w from template join idf using (word)),
sizes as (select template, sqrt(sum(w * w)) as t_norm from weighted group by template),
line_terms as (select line, word, n * coalesce(idf, ln(1.0 + headers) + 1) as w_line from terms left join idf using (word), total),
norms as (select line, sqrt(sum(w_line * w_line)) as l_norm from line_terms group by line),
dots as (select line, template, license, sum(w_line * w) as dot from line_terms join weighted using (word) group by all),
scored as (select line, license, round(dot / (l_norm * t_norm), 6) as score from dots join norms using (line) join sizes using (template)),
best as (select line, license, score from scored qualify row_number() over (partition by line order by score desc, license) = 1),
doc_best as (select doc_id, license, coalesce(score, 0.0) as score, row_number() over (partition by doc_id order by coalesce(score, 0.0) desc, license) as k,
    count(*) over (partition by doc_id) as n_headers from lines left join best using (line)),
known as (select doc_id, path, regexp_replace(path, '/[^/]*$', '') as dir, case when score >= {THRESHOLD} then license end as own_license,
    coalesce(score, 0.0) as own_score, coalesce(n_headers, 0) as n_headers from files left join (select * from doc_best where k = 1) using (doc_id)),
licensed as (select dir as ancestor, own_license as license from known where regexp_matches(path, '(?i)(^|/)licen[cs]e[^/]*$') and own_license is not null
    group by dir, own_license qualify row_number() over (partition by dir order by count(*) desc, own_license) = 1),
ancestors as (select dir, array_to_string(string_split(dir, '/')[1:k], '/') as ancestor from (
    select dir, unnest(range(1, len(string_split(dir, '/')) + 1)) as k from (select distinct dir from known))),
nearest as (select dir, ancestor, license from ancestors join licensed using (ancestor) qualify row_number() over (partition by dir order by length(ancestor) desc) = 1)
select doc_id, path, own_license, own_score, n_headers,
  case when own_license is null then nearest.license end as inherited_license,
  case when own_license is null then nearest.ancestor end as inherited_from,
  coalesce(own_license, nearest.license) as license
from known left join nearest using (dir)"""


def op5_rule_ledger() -> str:
    return rf"""
with docs as (select doc_id, coalesce(text, '') as text from documents),
words as (select doc_id, regexp_extract_all(text, '{WORD_PATTERN}') as w from docs),
spread as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from words),
grams as (select doc_id, i, list(word) over (partition by doc_id order by i rows between current row and 4 following) as g from spread),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from grams where len(g) = 5) where c >= 2),
covered as (select doc_id, count(distinct i + k) as n_repeat_words from twice, range(5) r(k) group by doc_id),
lines as (select doc_id, line, count(*) as c from (select doc_id, unnest(string_split(text, chr(10))) as line from docs) where regexp_matches(line, '{WORD_PATTERN}') group by all),
dups as (select doc_id, sum(c - 1) as n_dup_lines, sum(c) as n_lines from lines group by doc_id),
m as (select docs.doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols,
  coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lines, 0)::bigint as n_lines,
  len(regexp_extract_all(text, '[A-Z]')) as n_upper, len(regexp_extract_all(text, '[A-Za-z]')) as n_letters_ascii
  from docs join words using (doc_id) left join covered using (doc_id) left join dups using (doc_id)),
bits as (select *, (n_words < 10)::bigint + 2 * (100 * n_repeat_words > 20 * n_words)::bigint + 4 * (100 * n_symbols > 20 * n_words)::bigint
  + 8 * (n_words > 0 and (word_chars < 2 * n_words or word_chars > 25 * n_words))::bigint + 16 * (n_lines >= 4 and 100 * n_dup_lines > 60 * n_lines)::bigint
  + 32 * (n_letters_ascii >= 40 and 100 * n_upper > 60 * n_letters_ascii)::bigint as fail_bits from m)
select *, fail_bits & 3 <> 0 as base_failed, fail_bits & 63 = 0 as kept from bits"""


def rule_ablations() -> str:
    values = ", ".join(f"({_text(policy)}, {_text(rule)}, {mask([rule])}, {mask(names)})" for policy, names in POLICIES.items() for rule in names)
    return f"""
with book as ({op5_rule_ledger()}),
policies as (select * from (values {values}) v(policy, rule, bit, mask))
select policy, rule, count(*) filter (fail_bits & bit <> 0) as n_failed, count(*) filter (fail_bits & mask <> 0) as n_rejected,
  count(*) filter (fail_bits & mask = bit) as n_only_this
from policies left join book on true group by policy, rule"""


def op9_url_automaton() -> str:
    rules = ", ".join(f"({_text(r.host)}, {_text(r.path)}, {_text(r.verdict)})" for r in CONTRACT_RULES)
    blocked = " or ".join(f"contains(host, {_text(g.strip('*/'))})" for g in BLOCKED_GLOBS[::2])
    return rf"""
with parts as (select page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
rules as (select * from (values {rules}) v(rule_host, rule_path, rule_verdict)),
fits as (select distinct host, path, rule_host || rule_path as rule, rule_verdict from parts join rules
    on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)),
best as (select host, path, rule, rule_verdict from fits qualify row_number() over (partition by host, path order by length(rule) desc, rule_verdict, rule) = 1)
select page_id, host, path, rule, coalesce(rule_verdict, case when {blocked} then 'block' else 'allow' end) as verdict
from parts left join best using (host, path)"""


def op11_filter_audit() -> str:
    steps = ", ".join(f"('{''.join(p)}', {k + 1}, {1 << FILTERS.index(f)}, {sum(1 << FILTERS.index(e) for e in p[:k])})" for p in permutations(FILTERS) for k, f in enumerate(p))
    return rf"""
with words as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{WORD_PATTERN}') as w from documents),
masks as (select doc_id, part, (len(w) < 200)::int + 2 * (100 * list_unique(w) < 50 * len(w))::int
  + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text))::int + 8 * regexp_matches(text, '[#$%&*|]')::int
  + 16 * coalesce(doc_id > min(doc_id) over (partition by text), false)::int as mask from words),
known as (select doc_id, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as toxic from labels group by doc_id),
counters as (select part, mask, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from masks left join known using (doc_id) group by part, mask),
steps as (select * from (values {steps}) v(filter_order, step, bit, before))
select part, filter_order, step::int as step,
  coalesce(sum(n) filter (mask & (before | bit) = 0), 0)::bigint as kept,
  coalesce(sum(n) filter (mask & before = 0 and mask & bit <> 0), 0)::bigint as removed,
  coalesce(sum(n) filter (mask & before <> 0 and mask & bit <> 0), 0)::bigint as redundant,
  coalesce(sum(n) filter (mask = bit), 0)::bigint as unique_fails,
  coalesce(sum(good) filter (mask & before = 0 and mask & bit <> 0), 0)::bigint as good_lost,
  coalesce(sum(toxic) filter (mask & before = 0 and mask & bit <> 0), 0)::bigint as toxic_lost,
  coalesce(sum(n * (120 // greatest(1, bit_count(mask)))) filter (mask & bit <> 0), 0)::bigint as shapley
from counters, steps group by part, filter_order, step"""


def op13_hard_negatives() -> str:
    return """
with part as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
anchors as (select * from part where vec_id % 100 = 0),
pairs as (select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::bigint as score
  from anchors a join part b on a.vec_id <> b.vec_id),
positives as (select anchor_id, other_id as positive_id, score as positive_score from pairs where same qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5),
ranked as (select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, other_id)::int as rank, other_id as negative_id, positive_score, score as negative_score
  from positives p join pairs n on p.anchor_id = n.anchor_id and not n.same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select * from ranked where rank <= 10"""


def all_sql() -> dict[str, str]:
    return {f.__name__: f() for f in (op4_license_scan, op5_rule_ledger, rule_ablations, op9_url_automaton, op11_filter_audit, op13_hard_negatives)}

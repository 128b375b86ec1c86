"""SQL for the rows of the queries that SQL can express, and the rules both sides share."""

from __future__ import annotations

import re

from cohortweave.llm.license_scan import PHRASES, TEMPLATES, words_in
from cohortweave.llm.quality import BASE_RULES
from cohortweave.llm.quality import RULES as QUALITY_RULES

#: URL rules (verdict, host, path), fixed by the query's contract.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Globs of the method's own; what no rule judges and no glob matches is allowed.
SPAM = ("*spam*/**", "*cheap-pills*/**", "*casino*/**", "**/wp-login.php**")

WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE: dict[str, str] = {}

ORACLE["op1_minhash_near_dedup"] = rf"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}') as w
  from documents
), shingles as (
  select distinct doc_id, unnest(case
    when len(w) = 0 then []
    when len(w) < 2 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s
  from words
), sizes as (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as both_
  from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all
), links as (
  select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 100 * both_ >= 80 * (x.n + y.n - both_)
), edges as (select a, b from links union all select b, a from links),
reach as (
  select a as doc_id, a as other from edges
  union
  select reach.doc_id, edges.b from reach join edges on edges.a = reach.other
), groups as (select doc_id, min(other) as component_id from reach group by doc_id)
select d.doc_id, coalesce(s.n, 0) as n_shingles, coalesce(g.component_id, d.doc_id) as component_id,
  coalesce(g.component_id, d.doc_id) = d.doc_id as kept
from documents d left join sizes s using (doc_id) left join groups g using (doc_id)
"""

_globs = {
    g: "^" + "".join(
        ".*" if t == "**" else "[^/]*" if t == "*" else "." if t == "?" else re.escape(t)
        for t in re.findall(r"\*\*|\*|\?|[^*?]", g)
    ) + "$"
    for g in SPAM
}
_rule_rows = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
ORACLE["op3_url_filters"] = rf"""
with rules(verdict, rhost, rpath) as (values {_rule_rows}),
parts as (
  select page_id,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{UPPER.lower()}') as host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path
  from pages
), fits as (
  select page_id, arg_max(rhost || rpath, length(rhost || rpath)) as rule,
    arg_max(verdict, length(rhost || rpath)) as verdict
  from parts join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
  group by page_id
)
select page_id, host, path, f.rule, coalesce(f.verdict, case
  when {" or ".join(f"regexp_matches(host || path, '{g}', 's')" for g in _globs.values())}
  then 'block' else 'allow' end) as verdict
from parts left join fits f using (page_id)
"""


def _expression(markup: str) -> str:
    """A template as a regular expression over words that each end in a space."""
    out = []
    for token in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|\||[^\[\]{}|]+", markup):
        if token == "[[":
            out.append("(?:")
        elif token == "]]":
            out.append(")?")
        elif token == "|":
            out.append("|")
        elif token.startswith("{{"):
            out.append(f"(?:[^ ]+ ){{0,{token[2:-2]}}}")
        else:
            out.append("".join(w.decode() + " " for w in words_in(token.encode())))
    return "(^| )" + "".join(out)


_places = " + ".join(
    f"[i for i in range(1, len(w) + 1) if array_to_string(w[i:i + {len(p.split()) - 1}], ' ') = '{p}']" for p in PHRASES
).replace(" + [", " || [")
_base = ", ".join(
    f"case when contains(joined, ' {p} ') then '{label}' end" for p, label in PHRASES.items()
)
_own = ", ".join(
    f"case when regexp_matches(joined[2:], '{_expression(m)}') then '{label}' end" for label, m in TEMPLATES
)
ORACLE["op4_license_scan"] = rf"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), found as (
  select doc_id, len(w) as n_words, ' ' || array_to_string(w, ' ') || ' ' as joined, {_places} as places from words
), labelled as (
  select *, list_distinct([x for x in [{_base}] if x is not null]) as base,
    list_distinct([x for x in [{_own}] if x is not null]) as own
  from found
)
select doc_id, n_words, len(places) as n_base, list_min(places) - 1 as first_word, list_max(places) - 1 as last_word,
  array_to_string(list_sort(base), ',') as base_labels,
  array_to_string(list_sort(list_distinct(base || own)), ',') as labels,
  case when len(own) > 0 then 1.0::double when len(base) > 0 then 0.5::double else 0.0::double end as score
from labelled
"""

_fails = lambda rules: " or ".join(f"({r.fails})" for r in rules)
ORACLE["op6_quality_rules"] = rf"""
with texts as (select doc_id, coalesce(text, '') as text from documents),
words as (select doc_id, text, regexp_extract_all(text, '{WORD}') as w from texts),
lines as (
  select doc_id, [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] as l from texts
), runs as (
  select doc_id, unnest(range(1, len(w) - 1)) as i, w from words where len(w) > 2
), counted as (
  select doc_id, i, count(*) over (partition by doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) as n from runs
), covered as (
  select distinct doc_id, i + k as place from counted, (values (0), (1), (2)) t(k) where n > 1
), repeats as (select doc_id, count(*) as n from covered group by doc_id),
counts as (
  select doc_id, len(w) as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols,
    len(l) as n_lines, len(l) - len(list_distinct(l)) as n_dup_lines,
    len(regexp_extract_all(text, '\p{{L}}')) as n_letters, len(regexp_extract_all(text, '\p{{Lu}}')) as n_upper,
    coalesce(n, 0)::bigint as n_repeat_words
  from words join lines using (doc_id) left join repeats using (doc_id)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({_fails(BASE_RULES)}) as base_failed,
  not ({_fails(QUALITY_RULES)}) as kept
from counts
"""

ORACLE["op8_substring_dedup"] = rf"""
with words as (select doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') as w from documents),
runs as (
  select doc_id, unnest(range(1, len(w) - 11)) as i, w from words where len(w) > 12
), named as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as run from runs),
smallest as (select *, min(doc_id) over (partition by run) as least from named),
gone as (
  select distinct doc_id, i + k as place from smallest, range(0, 13) t(k) where least < doc_id
), places as (
  select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as place from words
), kept as (
  select doc_id, string_agg(word, ' ' order by place) as text, count(*) as n
  from places anti join gone using (doc_id, place) group by doc_id
)
select doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from words left join kept using (doc_id)
"""


def _clusters(k: int, size: int, scale: int, rounds: int, seed: int) -> str:
    """Rounds of assigning and moving as one chain of tables ``c0``, ``c1``, ..."""
    assigned = """
  select vec_id, v, c.cluster, d, c.u from (
    select vec_id, rid, v, arg_min(cluster, d * {k} + cluster) as cluster, min(d) as d from (
      select vec_id, rid, v, cluster, list_sum([(v[i] - u[i]) * (v[i] - u[i]) for i in range(1, {to})])::bigint as d
      from kept, c{r}
    ) group by vec_id, rid, v
  ) a join c{r} c using (cluster)"""
    tables = []
    for r in range(rounds):
        tables.append(f"a{r} as ({assigned.format(k=k, to=size + 1, r=r)})")
        tables.append(f"""m{r} as (
  select cluster, list((s - ((s % n) + n) % n) // n order by i) as w from (
    select cluster, i, sum(v[i]) as s, count(*) as n from a{r}, range(1, {size + 1}) t(i) group by cluster, i
  ) group by cluster
), c{r + 1} as (
  select cluster, coalesce(w, u)::bigint[] as u from c{r} left join m{r} using (cluster)
)""")
    return f"""
with kept as (
  select vec_id, row_number() over () as rid, [floor({scale} * x::double)::bigint for x in embedding] as v from embeddings
  where len(embedding) = {size} and len([x for x in embedding if x is not null and isfinite(x)]) = {size}
), c0 as (
  select row_number() over (order by sha256('{seed}:' || vec_id), v) - 1 as cluster, v as u from kept
  where vec_id is not null
  qualify cluster < {k}
), {", ".join(tables)}, a as ({assigned.format(k=k, to=size + 1, r=rounds)})
select vec_id, cluster::int as cluster, d as distance, (sum(d) over (partition by cluster))::bigint as cluster_inertia,
  (sum(d) over ())::bigint as inertia, sha256(array_to_string(u, ',')) as centroid_sha256
from a
"""


ORACLE["op11_centroid_clustering"] = _clusters(16, 64, 64, 3, 1)

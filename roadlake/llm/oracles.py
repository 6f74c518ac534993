"""DuckDB SQL for the queries whose rows SQL can say."""

from __future__ import annotations

from roadlake.llm.licenses import TEMPLATES
from roadlake.llm.secret_scan import LIMITS, WINDOW, _scaled

LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

DOCS = "with docs as (select doc_id, source, coalesce(text, '') as text, row_number() over () as rid from documents)"


def _found(kind: str, pattern: str, rank: int, text: str = "text") -> str:
    """Rows (rid, rank, kind, s, e, m) of the matches of a pattern, cut out between marks."""
    return f"""(with cut as (select rid, string_split(regexp_replace(translate({text}, chr(1), chr(2)), '({pattern})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) as parts from docs),
    rows as (select rid, unnest(parts) as m, unnest(range(len(parts))) as k from cut),
    placed as (select rid, k, m, sum(length(m)) over (partition by rid order by k) as e from rows)
    select rid, {rank} as rank, '{kind}' as kind, (e - length(m))::bigint as s, e::bigint as e, m from placed where k % 2 = 1)"""


ASSIGN_WORDS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = f"""(?:{ASSIGN_WORDS})["'']?\\x20*[:=]\\x20*["'']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = f"""^(?:{ASSIGN_WORDS})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)$"""

SECRETS = f"""{DOCS}, assign as (select * from {_found("assign", ASSIGN, 0)} where length(regexp_extract(m, '{ASSIGN_VALUE}', 1)) >= 12),
access as {_found("access", "AKIA[A-Z0-9]{14,}", 1)}, hex as {_found("hex", "[0-9a-f]{16,}", 2)},
base as (select * from assign union all select * from access union all select * from hex),
candidate as (select * from {_found("entropy", "[A-Za-z0-9+/_=-]{20,}", 3)}
  where regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Za-z]') and not regexp_matches(m, '(?i)example|sample|dummy|placeholder|changeme|redacted')
  and not regexp_full_match(m, '[A-Za-z]+([-_/=+][A-Za-z]+)*[-_/=+]*') and not regexp_full_match(m, '[0-9]+([-_/][0-9]+)*')
  and len(list_filter(list_distinct(string_split(m, '')), lambda c: contains(m, repeat(c, 8)))) = 0),
windows as (select *, unnest(list_transform(range(length(m) - {WINDOW} + 1), lambda k: substring(m, k + 1, {WINDOW}))) as w from candidate),
measured as (select *, list_sum(list_transform(list_distinct(string_split(w, '')), lambda c: ({[_scaled(c) for c in range(WINDOW + 1)]})[length(w) - length(replace(w, c, '')) + 1])) as total from windows),
lowest as (select rid, rank, kind, s, e, m, min(total)::bigint as low from measured group by all),
added as (select rid, rank, kind, s, e, m from lowest l where {_scaled(WINDOW) // WINDOW} - floor(low / {WINDOW}.0) >= case
  when regexp_full_match(m, '[0-9a-f]+|[0-9A-F]+') then {LIMITS["hex"]} when regexp_full_match(m, '[A-Za-z0-9]+') then {LIMITS["alnum"]} else {LIMITS["token"]} end
  and not exists (select 1 from base b where b.rid = l.rid and b.s < l.e and l.s < b.e)),
spans as (select * from base union all select * from added),
listed as (select rid, string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) as spans, string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) filter (where rank < 3) as base,
  count(*) filter (where rank = 0) as n_assign, count(*) filter (where rank = 1) as n_access, count(*) filter (where rank = 2) as n_hex from spans group by rid)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from docs left join listed using (rid)"""

REPEATS = f"""{DOCS}, coded as (select rid, doc_id, hex(encode(text)) as h from docs),
windows as (select rid, unnest(range(greatest(length(h) // 2 - 399, 0))) as k, h from coded),
named as (select rid, k, hash(substring(h, 2 * k + 1, 800)) as name from windows),
twice as (select name from named group by name having count(*) > 1),
hit as (select rid, k from named semi join twice using (name)),
runs as (select rid, k, k - row_number() over (partition by rid order by k) as island from hit),
spans as (select rid, min(k) as a, max(k) + 400 as b from runs group by rid, island),
steps as (select *, max(b) over (partition by rid order by a rows between unbounded preceding and 1 preceding) as before from spans),
groups as (select *, sum(case when before >= a then 0 else 1 end) over (partition by rid order by a) as g from steps),
removed as (select rid, g, min(a) as a, max(b) as b from groups group by rid, g),
gaps as (select rid, coalesce(lag(b) over (partition by rid order by a), 0) as f, a as t from removed union all select rid, max(b), 1000000000 from removed group by rid),
kept as (select c.rid, string_agg(substring(h, 2 * f + 1, 2 * (t - f)), '' order by f) as h from coded c join gaps using (rid) group by c.rid),
sizes as (select rid, sum(b - a)::bigint as n_removed, count(*) as n_spans from removed group by rid)
select doc_id, (length(c.h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(k.h, c.h))) as kept_sha256
from coded c left join kept k using (rid) left join sizes using (rid)"""

WORD = r"[^\x20\x09-\x0D]+"
RULES = f"""{DOCS}, worded as (select rid, doc_id, source, text, regexp_extract_all(text, '{WORD}') as w from docs),
windows as (select rid, unnest(range(greatest(len(w) - 7, 0))) as k, w from worded),
named as (select rid, k, array_to_string(w[k + 1:k + 8], ' ') as name from windows),
again as (select rid, name from named group by all having count(*) > 1),
covered as (select rid, count(distinct p) as n from (select rid, unnest(range(k, k + 8)) as p from named semi join again using (rid, name)) group by rid),
lines as (select rid, source, text, unnest(string_split(text, chr(10))) as line from docs),
full_lines as (select *, trim(regexp_replace(translate(line, {LOWER}), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') as norm, len(regexp_extract_all(line, '{WORD}')) as n from lines where regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dups as (select rid, count(*) - count(distinct line) as n from full_lines group by rid),
keyed as (select rid, source, coalesce('i' || doc_id, 't' || md5(text)) as key from docs),
hosts as (select source, count(distinct key) as n from keyed group by source),
frequent as (select f.source, norm from full_lines f join hosts h on f.source is not distinct from h.source join keyed k on k.rid = f.rid group by f.source, norm, h.n having count(distinct key) > 50 and count(distinct key) > 0.1 * h.n and count(distinct text) > 12),
gone as (select rid, sum(f.n) as n from full_lines f join frequent q on f.norm = q.norm and f.source is not distinct from q.source group by rid),
counts as (select doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
  coalesce(d.n, 0) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words, len(w) - coalesce(g.n, 0) as left_words from worded left join dups d using (rid) left join covered c using (rid) left join gone g using (rid)),
judged as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from counts)
select doc_id, n_words, word_chars, n_symbols::bigint as n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and left_words >= 20 and left_words >= 0.3 * n_words as kept from judged"""

TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAMINATION = f"""{DOCS}, worded as (select rid, doc_id, regexp_extract_all(translate(text, {LOWER}), '{TOKEN}') as w from docs),
items as (select item_id::varchar as item, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '{TOKEN}') as w from benchmark),
phrases as (select item, least(len(w), 10) as n, w, unnest(range(greatest(len(w) - 10, 0) + 1)) as k from items where len(w) > 0),
wanted as (select distinct item, n, array_to_string(w[k + 1:k + n], ' ') as name from phrases),
places as (select rid, n, w, unnest(range(greatest(len(w) - n + 1, 0))) as k from worded, (select distinct n from wanted)),
found as (select p.rid, p.k, p.n, q.item from (select rid, k, n, array_to_string(w[k + 1:k + n], ' ') as name from places) p join wanted q using (n, name)),
hit as (select rid, count(distinct p) as n_hit from (select distinct rid, unnest(range(k, k + n)) as p from found) group by rid),
listed as (select rid, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from found group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from worded left join hit using (rid) left join listed using (rid)"""

ORACLE = {"op4_secret_scan": SECRETS, "op6_repeated_strings": REPEATS, "op8_quality_rules": RULES, "op9_decontamination": CONTAMINATION}


def _licenses() -> str:
    """Weights are worked out from the templates' texts here too."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, {quoted(name)}, {quoted(text)})" for k, (name, text) in enumerate(TEMPLATES))
    term = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
    return f"""with templates(k, name, text) as (values {rows}),
template_terms as (select k, name, t, count(*) as c from (select k, name, unnest(regexp_extract_all(lower(text), '{term}')) as t from templates) group by all),
idfs as (select t, ln((1 + {len(TEMPLATES)}) / (1 + count(*))::double) as idf from template_terms group by t having count(*) < {len(TEMPLATES)}),
raw as (select k, name, t, (1 + ln(c)) * idf as w from template_terms join idfs using (t)),
weights as (select k, name, t, w / sqrt(sum(w * w) over (partition by k)) as w from raw),
docs as (select doc_id, coalesce(text, '') as text, concat_ws('/', coalesce(source, '-'), coalesce(lang, '-'), coalesce(doc_id::varchar, '-')) as path, row_number() over () as rid from documents),
parts as (select rid, text as p from docs union all select rid, unnest(string_split_regex(text, '\n[\x20\t]*\n')) from docs
  union all select rid, unnest(string_split(regexp_replace(text, '([.!?;])[\x20\t]+', '\1' || chr(10), 'g'), chr(10))) from docs),
units as (select rid, row_number() over () as nid, regexp_extract_all(lower(p), '{term}') as terms from parts),
counted as (select nid, t, count(*) as c from (select nid, unnest(terms) as t from units) group by all),
known as (select nid, t, c, (1 + ln(c)) * idf as w from counted join idfs using (t)),
norms as (select nid, sqrt(sum(w * w) + 4.0 * (any_value(len(terms)) - sum(c))) as norm from known join units using (nid) group by nid),
scores as (select a.nid, k, name, least(1.0, round(sum(a.w * b.w) / any_value(norm), 5)) as score from known a join weights b using (t) join norms n on n.nid = a.nid group by a.nid, k, name),
matched as (select rid, name, score, len(terms) as n from scores join units using (nid) where score >= 0.7),
own as (select rid, first(name order by score desc, name) as license, max(score)::double as score, max(n) as largest from matched group by rid),
rated as (select d.*, o.license as own_license, coalesce(o.score, 0.0)::double as score, regexp_replace(path, '/?[^/]*$', '') as dir,
  o.rid is not null and (regexp_matches(path, '(?i)(^|/)(licen[sc]e|copying|notice)(\\.[a-z]+)?$') or o.largest >= 0.3 * len(regexp_extract_all(lower(text), '{term}'))) as is_file from docs d left join own o using (rid)),
given as (select dir, own_license as license from rated where is_file group by dir, own_license qualify row_number() over (partition by dir order by count(*) desc, own_license) = 1),
chain as (select distinct dir, unnest(range(len(string_split(dir, '/')) + 1)) as depth from rated),
nearest as (select c.dir, g.dir as up, g.license from chain c join given g on g.dir = array_to_string(string_split(c.dir, '/')[1:c.depth], '/') qualify row_number() over (partition by c.dir order by c.depth desc) = 1)
select doc_id, path, own_license, score, is_file as is_license_file, coalesce(own_license, n.license) as license, case when own_license is null then n.up end as inherited_from from rated r left join nearest n using (dir)"""


ORACLE["op10_license_scan"] = _licenses()


def _rounds() -> str:
    """Six rounds over all pairs of points and entries, then the last assignment."""
    apart = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"
    steps = []
    for k in range(7):
        steps.append(f"""given{k} as materialized (select rid, p, x, e, d from (select rid, t.p, x, e, {apart} as d from points t join book{k} b on t.p = b.p) qualify row_number() over (partition by rid, p order by d, e) = 1)""")
        if k < 6:
            steps.append(f"""sums{k} as (select p, e, i, sum(x[i]) as s, count(*) as n from (select p, e, x, unnest(range(1, len(x) + 1)) as i from given{k}) group by all),
means{k} as (select p, e, list((s - ((s % n) + n) % n) // n order by i) as c from sums{k} group by p, e),
book{k + 1} as materialized (select b.p, b.e, coalesce(m.c, b.c) as c from book{k} b left join means{k} m using (p, e))""")
    return f"""with kept as materialized (select vec_id, label, row_number() over (order by vec_id) as rid, list_transform(embedding, lambda x: floor(4096 * x::double)::hugeint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
points as materialized (select rid, p, v[p * (len(v) // 8) + 1:(p + 1) * (len(v) // 8)] as x from kept, range(8) r(p)),
book0 as materialized (select p, rid - 1 as e, x as c from points where rid <= 16),
{", ".join(steps)},
digest as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as h from book6),
coded as (select rid, string_agg(printf('%02x', e), '' order by p) as code, sum(d)::bigint as error from given6 group by rid),
labelled as (select vec_id, label, code, error, sum(error) over (partition by label)::bigint as label_error from kept join coded using (rid))
select vec_id, code, error, label_error, h as codebooks_sha256 from labelled, digest"""


ORACLE["op11_vector_codes"] = _rounds()

ORACLE["op12_source_audit"] = rf"""with docs as (select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
occ as materialized (select rid, lang, source, unnest(regexp_extract_all(translate(text, {LOWER}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
kept as materialized (select lang, term from occ group by all having count(distinct rid) >= 3),
sizes as (select lang, count(*) as v from kept group by lang),
groups as (select distinct lang, source from docs),
counted as materialized (select lang, source, term, count(*) as n from occ semi join kept using (lang, term) group by all),
totals as (select g.lang, g.source, coalesce(sum(n), 0) as t from groups g left join counted c using (lang, source) group by all),
dense as materialized (select t.lang, t.source, k.term, coalesce(c.n, 0) as n, 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 1) // (t.t + s.v)::hugeint as p
  from totals t join kept k using (lang) join sizes s using (lang) left join counted c on c.lang = t.lang and c.source = t.source and c.term = k.term),
whole as (select lang, term, 1 + 1000000000::hugeint * (sum(n) + 1) // (any_value(a.t) + any_value(s.v))::hugeint as q from dense join (select lang, sum(t) as t from totals group by lang) a using (lang) join sizes s using (lang) group by lang, term),
apart as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p)::bigint as value from dense a join dense b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value from groups a join groups b on a.lang = b.lang and a.source <> b.source left join apart x on x.lang = a.lang and x.source = a.source and x.item = b.source),
terms as (select d.lang, d.source, 'term' as part, d.term as item, ((p - q) * (p - q) // q)::bigint as value from dense d join whole w using (lang, term) where n > 0 and p > q)
select lang, source, part, item, value, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from (select * from pairs union all select * from terms) qualify part = 'pair' or rank <= 200"""


def _personal() -> str:
    """The kinds one by one: matches between marks, their checks, and the words in the text around them."""
    luhn = "list_sum(list_transform(range(1, length(d) + 1), lambda i: case when i % 2 = 1 then reverse(d)[i]::int else 2 * reverse(d)[i]::int - case when reverse(d)[i]::int > 4 then 9 else 0 end end)) % 10 = 0"
    account = "list_reduce(list_prepend(0, list_transform(string_split(d[5:] || d[1:4], ''), lambda c: case when c between '0' and '9' then c::int else ascii(c) - 55 end)), lambda a, v: (case when v >= 10 then 100 * a else 10 * a end + v) % 97) = 1"
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", 90, 10, "mail|e-mail|email|contact|write"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 or coalesce(try_cast(ltrim(x, '0') as bigint), 0) > 255)) = 0", 50, 20, "ip|host|server|address"),
        ("card", r"[0-9]([\x20-]?[0-9])+", f"length(d) between 13 and 19 and {luhn}", 80, 10, "card|visa|mastercard|credit|payment"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) between 9 and 15", 60, 20, "phone|tel|call|mobile|fax"),
        ("iban", r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)\b", account, 90, 10, "iban|account|bank|transfer"),
        ("national_id", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "m[1:3] not in ('000', '666') and m[1:3] < '900' and m[5:6] <> '00' and m[8:11] <> '0000'", 40, 30, "ssn|social security|national id|insurance"),
        ("local_phone", r"\b[0-9]{2,4}[\x20.-][0-9]{3,4}[\x20.-][0-9]{4}\b", "true", 40, 30, "phone|tel|call|mobile|fax"),
    ]
    parts, taken = [], []
    for k, (kind, pattern, check, base, more, words) in enumerate(kinds):
        digits = "replace(m, ' ', '')" if kind == "iban" else "regexp_replace(m, '[^0-9]', '', 'g')"
        near = f"translate(substring(text, greatest(s - 40, 0) + 1, least(s, 40)) || chr(10) || substring(text, e + 1, 20), {LOWER})"
        points = rf"greatest(0, least(100, {base} + case when regexp_matches(near, '\b(?:{words})\b') then {more} else 0 end - case when regexp_matches(near, '\b(?:version|order|invoice|isbn|part no|page)\b') then 20 else 0 end))"
        added = k >= 4
        clear = "".join(f" and not exists (select 1 from {t} b where b.rid = g.rid and b.s < g.e and g.s < b.e)" for t in taken) if added else ""
        parts.append(f"""found_{kind} as (select *, {digits} as d from {_found(kind, pattern, k)}),
checked_{kind} as (select f.*, {near} as near from found_{kind} f join docs using (rid) where {check}),
{kind} as materialized (select * from (select rid, rank, kind, s, e, {points} as points from checked_{kind}) g where {"points >= 60" if added else "true"}{clear})""")
        taken.append(kind)
    every = " union all ".join(f"select * from {t}" for t in taken)
    line = "string_agg(kind || ':' || s || ':' || e, ',' order by rank, s)"
    counts = ", ".join(f"count(*) filter (where rank = {k}) as n_{t}" for k, t in enumerate(taken[:4]))
    return f"""{DOCS}, {", ".join(parts)}, spans as ({every}),
listed as (select rid, {line} as spans, {line} filter (where rank < 4) as base, string_agg(points::varchar, ',' order by rank, s) as scores, {counts} from spans group by rid)
select doc_id, {", ".join(f"coalesce(n_{t}, 0)::bigint as n_{t}" for t in taken[:4])}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(scores, '') as scores from docs left join listed using (rid)"""


ORACLE["op13_personal_data"] = _personal()

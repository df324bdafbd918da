"""SQL for DuckDB of the operators that SQL can express: plain counting and matching, not the operators' methods."""

PHRASES = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents
), spoken as (
  select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') as ws from pieces
), grams as (
  select lang, m, phrase, count(*) as f
  from (
    select lang, m, array_to_string(ws[i:i + m - 1], ' ') as phrase
    from (select lang, ws, m, unnest(range(1, len(ws) - m + 2)) as i from spoken, (values (1), (2), (3)) as sizes(m))
  ) group by lang, m, phrase
), totals as (
  select lang, sum(f)::bigint as n from grams where m = 1 group by lang
), longer as (
  select lang, phrase, max(f) as f from (
    select lang, array_to_string(string_split(phrase, ' ')[1:2], ' ') as phrase, f from grams where m = 3
    union all
    select lang, array_to_string(string_split(phrase, ' ')[2:3], ' ') as phrase, f from grams where m = 3
  ) group by lang, phrase
), cuts as (
  select c.lang, c.phrase, c.f as a, k, x.f as l, y.f as r, (1000000::hugeint * c.f * c.f) // (x.f::hugeint * y.f) as score
  from (select *, unnest(range(1, m)) as k from grams where m > 1 and f >= 10) c
  join grams x on x.lang = c.lang and x.phrase = array_to_string(string_split(c.phrase, ' ')[1:k], ' ')
  join grams y on y.lang = c.lang and y.phrase = array_to_string(string_split(c.phrase, ' ')[k + 1:c.m], ' ')
  left join longer g on c.m = 2 and g.lang = c.lang and g.phrase = c.phrase and g.f >= 10
  where g.f is null or 100 * g.f < 50 * c.f
), lowest as (
  select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1
), ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from lowest
)
select r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score::bigint as score
from ranked r join totals t using (lang) where r.rank <= 2000
"""


def _spans(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    """Each match's place, from the lengths of the matches and of what is between them."""
    return f"""
  select r, '{kind}' as kind, {order} as o, (coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda g: length(g))), 0))::bigint as s, length(whole[i]) as size
  from (
    select r, string_split_regex(text, '{pattern}') as gaps, regexp_extract_all(text, '{pattern}') as whole, regexp_extract_all(text, '{pattern}', {group}) as said, unnest(range(1, len(whole) + 1)) as i
    from docs
  ) where length(said[i]) >= {least}"""


_ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

SECRETS = rf"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
spans as ({_spans("assign", 0, _ASSIGN, 1, 12)}
  union all {_spans("access", 1, "AKIA[A-Z0-9]+", 0, 18)}
  union all {_spans("hex", 2, "[0-9a-f]{16,}", 0, 16)}
  union all {_spans("pem", 3, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----", 0, 1)}
  union all {_spans("login", 4, r"\b[a-z][a-z0-9+]{1,15}://[A-Za-z0-9._~%+-]{1,64}:([^\s:@/" + '"' + r"''<>]+)@[A-Za-z0-9.-]+", 1, 6)}
), told as (
  select r, count(*) filter (o = 0) as n_assign, count(*) filter (o = 1) as n_access, count(*) filter (o = 2) as n_hex,
    string_agg(kind || ':' || s || ':' || (s + size), ',' order by s, o) filter (o < 3) as base, string_agg(kind || ':' || s || ':' || (s + size), ',' order by s, o) as spans
  from spans group by r
)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(t.spans, '') as spans
from docs d left join told t using (r)
"""

"""Registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from pactlake.llm import (
    chats,
    decontaminate,
    lexical,
    licenses,
    lines,
    near_documents,
    packing,
    phrases,
    quality,
    secret_parts,
    spotsigs,
    substrings,
    urls,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


QUERIES["pipeline"] = corpus_pipeline.run


@query
def op1_chat_snapshots(spark, sf):
    return chats.formatted(spark, table(spark, sf, "conversations"))


ORACLE["op1_chat_snapshots"] = """
with turns as (select distinct conv_id, turn, role, text from conversations),
convs as (select conv_id, list({'role': role, 'text': text} order by turn) as said from turns group by conv_id),
shorter as (select distinct said[1:i] as said from (select said, unnest(range(1, len(said))) as i from convs)),
kept as (select min(conv_id) as conv_id, said from convs anti join shorter using (said) group by said),
lines as (select conv_id, len(said) as n, unnest(said) as turn, unnest(range(len(said))) as i from kept)
select conv_id, 0::bigint as part, n::bigint as n_turns, string_agg(
    '<|' || replace(coalesce(turn.role, ''), '<|', '< |') || '|>' || chr(10)
    || replace(coalesce(turn.text, ''), '<|', '< |') || '<|end|>' || chr(10), '' order by i) as text
from lines group by conv_id, n
"""


@query
def op2_best_fit_packing(spark, sf):
    return packing.packed(table(spark, sf, "documents"))


@query
def op3_positive_unlabelled(spark, sf):
    docs = table(spark, sf, "documents")
    return quality.scored(docs, quality.fit(docs, table(spark, sf, "labels")))


@query
def op4_diagonal_voting(spark, sf):
    return licenses.scan(spark, table(spark, sf, "documents")).drop("spans")


@query
def op5_fuzzy_lines(spark, sf):
    return lines.line_report(spark, table(spark, sf, "documents"))


@query
def op6_simhash_near_dedup(spark, sf):
    return near_documents.near_groups(spark, table(spark, sf, "documents"))


@query
def op7_suffix_subtrees(spark, sf):
    return substrings.report(table(spark, sf, "documents"))


#: The words of op6 and op7.
SPACED = r"[^\x20\x09-\x0D]+"

ORACLE["op7_suffix_subtrees"] = f"""
with doc as (select doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') as w from documents),
suffixes as (select doc_id, i, w[i : i + 19] as path from (select *, unnest(range(1, len(w) - 18)) as i from doc)),
again as (
    select doc_id, i from (
        select doc_id, i, row_number() over (partition by path order by doc_id, i) as nth from suffixes
    ) where nth > 1
),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as i from again),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from doc),
kept as (
    select doc_id, string_agg(word, ' ' order by i) as text, count(*) as n
    from words anti join gone using (doc_id, i) group by 1
)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed,
    sha256(coalesce(text, '')) as kept_sha256
from doc left join kept using (doc_id)
"""


@query
def op8_winnowing(spark, sf):
    return decontaminate.contamination_report(
        table(spark, sf, "documents"), table(spark, sf, "benchmark")
    )


def sql_words(column: str) -> str:
    """The words of op4 and op8: A-Z lower-cased, then runs of digits, letters and non-ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = f"translate(coalesce({column}, ''), '{upper}', '{upper.lower()}')"
    return f"regexp_extract_all({lowered}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


ORACLE["op8_winnowing"] = f"""
with doc as (select doc_id, {sql_words("text")} as w from documents),
item as (select item_id, {sql_words("text")} as w from benchmark),
windows as (
    select distinct item_id, w[i : i + least(13, len(w)) - 1] as win
    from (select *, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from item where len(w) > 0)
),
spans as (select distinct len(win) as l from windows),
places as (
    select doc_id, i, l, w[i : i + l - 1] as win
    from (select *, unnest(range(1, len(w) - l + 2)) as i from doc, spans)
),
hits as (select doc_id, i, l, item_id from places join windows using (win)),
covered as (
    select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + l)) as p from hits) group by 1
),
items as (
    select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids
    from (select distinct doc_id, item_id from hits) group by 1
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
    coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
    coalesce(n_hit, 0) > 0 and 20 * n_hit >= len(w) as contaminated
from doc left join covered using (doc_id) left join items using (doc_id)
"""


#: The rules of op9.
RULES = """
values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
"""


@query
def op9_url_rules(spark, sf):
    rules = spark.sql(f"select * from ({RULES}) as rules(host, path, verdict)")
    return urls.judged(spark, table(spark, sf, "pages"), rules)


ORACLE["op9_url_rules"] = f"""
with rules(rule_host, rule_path, verdict) as ({RULES}),
rests as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
parts as (
    select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
    from rests
),
fits as (
    select page_id, rule_host || rule_path as rule, verdict,
        row_number() over (partition by page_id order by length(rule_host || rule_path) desc) as nth
    from parts join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict
from parts left join (select * from fits where nth = 1) using (page_id)
"""


@query
def op10_spotsigs(spark, sf):
    return spotsigs.edited_likeness(table(spark, sf, "documents"))


@query
def op11_aho_corasick_search(spark, sf):
    return lexical.ranked(spark, table(spark, sf, "documents"), table(spark, sf, "benchmark"))


ORACLE["op11_aho_corasick_search"] = f"""
with doc as (select doc_id, {sql_words("text")} as w from documents),
item as (select item_id, unnest({sql_words("text")}) as term from benchmark),
wanted as (select item_id, term, count(*) as c from item group by all),
totals as (select count(*) as nn, sum(len(w))::bigint as ll from doc where len(w) > 0),
tfs as (
    select doc_id, term, count(*) as tf from (select doc_id, unnest(w) as term from doc)
    where term in (select term from wanted) group by all
),
weights as (
    select term, floor(1000 * ln((2 * any_value(nn) + 2)::double / (2 * count(*) + 1)::double))::bigint as weight
    from tfs, totals group by term
),
lengths as (select doc_id, 100 - 75 + (75 * len(w) * nn) // ll as m from doc, totals where len(w) > 0),
scores as (
    select item_id, doc_id, sum(c * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
    from tfs join wanted using (term) join weights using (term) join lengths using (doc_id) group by all
)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
from scores where score > 0 qualify rank <= 10
"""


@query
def op12_multipart_secrets(spark, sf):
    return secret_parts.report(spark, table(spark, sf, "documents"))


def sql_matches(kind: str, pattern: str) -> str:
    """(doc_id, kind, found, start, end) of the matches of a pattern; the pieces between them are split off by it."""
    quoted = pattern.replace("'", "''")
    return f"""
    select doc_id, '{kind}' as kind, found, past - length(found) as start, past as "end" from (
        select doc_id, found, sum(length(gap) + length(found)) over (partition by doc_id order by nth) as past from (
            select doc_id, unnest(m) as found, unnest(gaps[: len(m)]) as gap, unnest(range(len(m))) as nth from (
                select doc_id, regexp_extract_all(coalesce(text, ''), '{quoted}') as m,
                    string_split_regex(coalesce(text, ''), '{quoted}') as gaps
                from documents
            )
        )
    )"""


def sql_value(kind: str) -> str:
    """The length of the second group of a match."""
    quoted = secret_parts.PATTERNS[kind].replace("'", "''")
    return f"length(regexp_extract(found, '{quoted}', 2))"


_KINDS = ", ".join(f"'{kind}'" for kind in secret_parts.KINDS)
_MATCHES = {**secret_parts.PATTERNS, "blank": secret_parts.BLANK}

ORACLE["op12_multipart_secrets"] = f"""
with matches as ({" union all ".join(sql_matches(kind, pattern) for kind, pattern in _MATCHES.items())}),
kinds as (
    select doc_id, start, "end", case
        when kind = 'assign' then case when {sql_value("assign")} >= 12 then 'assign' when {sql_value("assign")} >= 6 then 'short' end
        when kind = 'user' then case when {sql_value("user")} >= 3 then 'user' end
        when kind = 'key' then case when length(found) = 40 and regexp_matches(found, '[A-Z]')
            and regexp_matches(found, '[a-z]') and regexp_matches(found, '[0-9]') then 'key' end
        else kind end as kind
    from matches
),
parts as (
    select *, list_position([{_KINDS}], kind) as nth, kind in ('assign', 'hex', 'short', 'key') as secret from (
        select *, count(*) filter (kind = 'blank') over (partition by doc_id order by start, "end" rows unbounded preceding) as scope
        from kinds where kind is not null
    ) where kind <> 'blank'
),
shown as (
    select * from parts where nth <= 3 union all
    select * from parts p where nth > 3 and exists (
        select 1 from parts q where q.doc_id = p.doc_id and q.scope = p.scope and q.secret <> p.secret
            and p.start <= q."end" + 200 and q.start <= p."end" + 200
    )
),
told as (
    select doc_id, count(*) filter (nth = 1) as n_assign, count(*) filter (nth = 2) as n_access,
        count(*) filter (nth = 3) as n_hex, string_agg(span, ',' order by start, nth) filter (nth <= 3) as base,
        string_agg(span, ',' order by start, nth) as spans
    from (select *, kind || ':' || start::bigint || ':' || "end"::bigint as span from shown) group by doc_id
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
    sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents left join told using (doc_id)
"""


@query
def op13_hat_trie_phrases(spark, sf):
    return phrases.collocations(spark, table(spark, sf, "documents"))


#: A-Z lower-cased, nothing else.
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE["op13_hat_trie_phrases"] = f"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({LOWERED}, '[.,;:!?\x0A-\x0D]')) as piece
    from documents
),
said as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
totals as (select lang, sum(len(w))::bigint as n from said group by lang),
grams as (
    select lang, w[i : i + k - 1] as p, count(*) as f
    from (select *, unnest(range(1, len(w) + 1)) as i from said), (select unnest([1, 2, 3, 4]) as k)
    where i + k - 1 <= len(w) group by all having count(*) >= 30
),
cuts as (select lang, p, f as a, unnest(range(1, len(p))) as k from grams),
scores as (
    select c.lang, c.p, a, k, x.f as l, y.f as r, (2000000::hugeint * a // (x.f + y.f))::bigint as score
    from cuts c join grams x on x.lang = c.lang and x.p = c.p[1 : k] join grams y on y.lang = c.lang and y.p = c.p[k + 1 :]
),
best as (select * from scores qualify row_number() over (partition by lang, p order by score, k) = 1),
inner_ones as (
    select lang, p[i : i + m - 1] as p, max(f) as around
    from (select *, unnest(range(1, len(p) + 1)) as i from grams where len(p) > 2), (select unnest([2, 3]) as m)
    where m < len(p) and i + m - 1 <= len(p) group by all
),
kept as (
    select lang, array_to_string(p, ' ') as phrase, a, l, r, score from best left join inner_ones using (lang, p)
    where around is null or 100::hugeint * around < 80::hugeint * a
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from kept join totals using (lang) qualify rank <= 2000
"""

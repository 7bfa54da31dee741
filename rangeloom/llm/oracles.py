"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from rangeloom.llm.quality import RULES, STOP_WORDS
from rangeloom.llm.queries import URL_RULES, listed_hosts

SPACE = r"[\x20\x09-\x0D]+"


def _letters() -> str:
    return "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def urls_sql() -> str:
    fits = lambda r: "(({h} = '{o}' or ends_with({h}, '.{o}')) and starts_with(path, '/{p}'))".format(h="host", o=r.partition("/")[0], p=r.partition("/")[2])
    order = sorted(URL_RULES, key=lambda r: (-len(r[0]), r[0]))
    rule = " ".join(f"when {fits(r)} then '{r}'" for r, _ in order)
    verdict = " ".join(f"when {fits(r)} then '{v}'" for r, v in order)
    hosts = ", ".join(f"'{x}'" for x in listed_hosts())
    return f"""
    with a as (select page_id, case when url is null or instr(url, '://') = 0 then '' else substr(url, instr(url, '://') + 3) end as rest from pages),
    b as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_letters()}) as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from a)
    select page_id, host, path, case {rule} end as rule,
      case {verdict} when host in ({hosts}) then 'block' else 'allow' end as verdict
    from b"""


def quality_kept(m: str = "") -> str:
    """The rule table as a SQL condition over the measures."""
    parts = []
    for r in RULES:
        ok = []
        if r.least is not None:
            ok.append(f"{m}{r.measure} >= {m}{r.per} * cast({r.least} as double)")
        if r.most is not None:
            ok.append(f"{m}{r.measure} <= {m}{r.per} * cast({r.most} as double)")
        parts.append(f"({m}n_words < {r.min_words} or ({' and '.join(ok)}))")
    return " and ".join(parts)


def quality_ctes(source: str, key: str = "doc_id") -> str:
    """CTEs that end in ``measured`` (key and all measures) over ``source`` (key, text)."""
    stops = ", ".join(f"'{s}'" for line in STOP_WORDS for s in line.split())
    return f"""
    q0 as (select {key}, coalesce(text, '') as t from {source}),
    q1 as (select {key}, t, list_filter(regexp_split_to_array(t, '{SPACE}'), lambda x: x <> '') as w,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from q0),
    q2 as (select *, len(w) as n, list_transform(range(0, greatest(len(w) - 4, 0)), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) as g from q1),
    q3 as (select {key}, unnest(g) as gram, generate_subscripts(g, 1) as i from q2),
    q4 as (select {key}, i, count(*) over (partition by {key}, gram) as c from q3),
    q5 as (select {key}, i, lead(i) over (partition by {key} order by i) as nxt from q4 where c > 1),
    q6 as (select {key}, sum(least(5, coalesce(nxt - i, 5))) as covered from q5 group by {key}),
    measured as (select q2.{key}, cast(n as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
      cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
      cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, cast(coalesce(covered, 0) as bigint) as n_repeat_words,
      cast(len(l) as bigint) as n_lines, cast(length(t) - length(regexp_replace(t, '!', '', 'g')) as bigint) as n_exclamations,
      cast(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as bigint) as n_capitals,
      cast(len(list_filter(w, lambda x: lower(x) in ({stops}))) as bigint) as n_stop_words
      from q2 left join q6 on q2.{key} = q6.{key})"""


BASE_FAILED = "(n_words < 10 or 100 * n_repeat_words > 20 * n_words)"


def quality_sql() -> str:
    return f"""with {quality_ctes('documents')}
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {BASE_FAILED} as base_failed,
      not {BASE_FAILED} and {quality_kept()} as kept from measured"""


def vector_codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Every assignment over all entries, rounds written out."""
    out = [
        f"""
    with kept as materialized (
      select vec_id, label, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v, row_number() over (order by vec_id nulls last, embedding) as id
      from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    flat as (select id, unnest(v) as x, unnest(range(len(v))) as pos, len(v) // {parts} as width from kept),
    u as materialized (select id, pos // width as part, pos % width as spot, x from flat),
    c0 as materialized (select part, id - 1 as entry, spot, x from u where id <= {entries})"""
    ]
    for r in range(rounds + 1):
        out.append(f"""
    d{r} as (select u.id, u.part, c.entry, sum((u.x - c.x) * (u.x - c.x)) as d from u join c{r} c on u.part = c.part and u.spot = c.spot group by all),
    a{r} as materialized (select id, part, entry, d from d{r} qualify row_number() over (partition by id, part order by d, entry) = 1)""")
        if r < rounds:
            out.append(f"""
    m{r} as (select a.part, a.entry, u.spot, sum(u.x) as s, count(*) as n from a{r} a join u on a.id = u.id and a.part = u.part group by all),
    c{r + 1} as materialized (select c.part, c.entry, c.spot, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.x) as x
      from c{r} c left join m{r} m on c.part = m.part and c.entry = m.entry and c.spot = m.spot)""")
    return (
        ",".join(out)
        + f""",
    codes as (select id, string_agg(printf('%02x', cast(entry as int)), '' order by part) as code, cast(sum(d) as bigint) as error from a{rounds} group by id),
    per_label as (select label, cast(sum(error) as bigint) as label_error from kept join codes using (id) group by label),
    books as (select sha256(string_agg(cast(x as varchar), ',' order by part, entry, spot)) as codebooks_sha256 from c{rounds})
    select vec_id, code, error, label_error, codebooks_sha256
    from kept join codes using (id) join per_label on kept.label is not distinct from per_label.label cross join books"""
    )


def divergence_sql(least: int = 3, top: int = 200) -> str:
    """Shares of every kept term in every source of a language, compared term by term."""
    return f"""
    with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, doc_id, translate(coalesce(text, ''), {_letters()}) as t from documents),
    o as materialized (select lang, source, doc_id, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
    k as materialized (select lang, term from o group by 1, 2 having count(distinct (source, doc_id)) >= {least}),
    v as (select lang, count(*) as kept from k group by 1),
    g as (select distinct lang, source from d),
    c as (select lang, source, term, count(*) as n from o semi join k using (lang, term) group by 1, 2, 3),
    n as materialized (select lang, source, term, kept, coalesce(n, 0) as n from g join v using (lang) join k using (lang) left join c using (lang, source, term)),
    sums as (select *, sum(n) over (partition by lang, source) as total, sum(n) over (partition by lang, term) as lang_n, sum(n) over (partition by lang) as lang_total from n),
    p as materialized (select lang, source, term, n, 1 + (cast(1000000000 as hugeint) * (n + 1)) // (total + kept) as p,
      1 + (cast(1000000000 as hugeint) * (lang_n + 1)) // (lang_total + kept) as q from sums),
    f as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
      from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
    every as (
      select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(f.value, 0) as bigint) as value
      from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
      union all
      select lang, source, 'term', term, cast(((p - q) * (p - q)) // q as bigint) from p where n > 0 and p > q)
    select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank from every
    qualify part = 'pair' or rank <= {top}"""


ORACLES = {"op1_urls": urls_sql(), "op2_quality": quality_sql(), "op12_vector_codes": vector_codes_sql(), "op13_divergence": divergence_sql()}

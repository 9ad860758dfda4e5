"""The queries as DuckDB SQL, written from what they should return and not from how they find it."""

from tillbook.llm import contamination, pii, secrets, urls
from tillbook.llm.text import BLANK_CLASS, UPPER

NOT_BLANK = f"[^{BLANK_CLASS}]+"
LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"

# The base patterns as plain as they can be put.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
CARD = r"[0-9](?:[\x20-]?[0-9])+"
# Apart from the patterns of the operators, so that a change there cannot hide here.
IBAN = r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
USER = r"(?:user|username|login|client_id|account_id|access_key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]+"
ENDPOINT = r"(?:https?|postgres|postgresql|mysql|mongodb|redis|amqp|ftp|s3)://[A-Za-z0-9@:._/-]+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def spans_cte(patterns: dict[str, str]) -> str:
    """``placed``: every match with its kind, start, end and the scraps around it."""
    cuts = " union all ".join(
        f"""select doc_id, {quoted(kind)} kind, regexp_extract_all(text, {quoted(p)}) f,
            regexp_split_to_array(text, {quoted(p)}) g from d"""
        for kind, p in patterns.items()
    )
    return f"""d as (select doc_id, coalesce(text, '') as text from documents),
        cuts as ({cuts}),
        parts as (select doc_id, kind, unnest(range(len(f))) i, unnest(f) m,
            unnest(g[1:len(f)]) gap, unnest(g[2:len(f) + 1]) nxt from cuts where len(f) > 0),
        placed as (select doc_id, kind, m, right(gap, 40) lft, left(nxt, 40) rgt,
            cast(sum(length(gap) + length(m)) over (partition by doc_id, kind order by i) as bigint) e,
            e - length(m) s from parts)"""


def ordered_list(condition: str, order: str, what: str = "kind || ':' || s || ':' || e") -> str:
    return f"coalesce(string_agg({what}, ',' order by {order}) filter ({condition}), '')"


DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
LUHN = f"""(select sum(case when k % 2 = 0 then v when v > 4 then 2 * v - 9 else 2 * v end) % 10 = 0
    from (select k, cast(substr({DIGITS}, length({DIGITS}) - cast(k as int), 1) as int) v
        from (select unnest(range(length({DIGITS}))) k)))"""
CODE = "replace(m, ' ', '')"
MOD97 = f"""(select try_cast(string_agg(case when c between '0' and '9' then c
        else cast(ascii(c) - 55 as varchar) end, '' order by k) as hugeint) % 97 = 1
    from (select k, substr(x, cast(k as int), 1) c from
        (select unnest(range(1, length({CODE}) + 1)) k, substr({CODE}, 5) || left({CODE}, 4) x)))"""
ALONE = "not regexp_matches(lft, '[A-Za-z0-9-]$') and not regexp_matches(rgt, '^[A-Za-z0-9-]')"


def personal() -> str:
    more = {"iban": IBAN, "ssn": SSN}
    rank = "list_position(['email', 'ip', 'card', 'phone', 'iban', 'ssn'], kind)"
    words = " ".join(f"when {quoted(k)} then {quoted(w)}" for k, w in pii.CONTEXT.items())
    points = " ".join(
        f"when {quoted(k)} then {v + 30 * (k in ('card', 'iban'))}"
        for k, v in pii.Scoring().starts
    )
    base = "kind not in ('iban', 'ssn')"
    return f"""with {spans_cte({"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, **more})},
        good as (select *, {rank} r, case kind {points} end + case when regexp_matches(
                lower(lft || ' ' || rgt), '(?:^|[^a-z])(?:' || case kind {words} end || ')')
                then 20 else 0 end score
            from placed where case kind when 'email' then true
            when 'ip' then len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) <= 3
                and cast('0' || right(p, 3) as int) <= 255)) = 4
            when 'card' then length({DIGITS}) between 16 and 19 and {LUHN}
            when 'phone' then length({DIGITS}) between 8 and 15
            when 'iban' then {ALONE} and {MOD97} else {ALONE} end)
        select d.doc_id, count(*) filter (kind = 'email') n_email, count(*) filter (kind = 'ip') n_ip,
            count(*) filter (kind = 'card') n_card, count(*) filter (kind = 'phone') n_phone,
            sha256({ordered_list(base, "r, s")}) base_sha256,
            {ordered_list(f"{base} or score >= 50", "r, s")} spans,
            {ordered_list(f"{base} or score >= 50", "r, s", "cast(score as varchar)")} scores
        from d left join good g on d.doc_id = g.doc_id group by d.doc_id"""


def credentials() -> str:
    keys = secrets.ASSIGN
    patterns = {
        "assign": keys + "[A-Za-z0-9+/_.=-]+",
        "access": "AKIA[A-Z0-9]+",
        "hex": "[0-9a-f]+",
        "user": USER,
        "blob": "[A-Za-z0-9+/_-]+",
        "endpoint": ENDPOINT,
    }
    return f"""with {spans_cte(patterns)},
        good as (select *, list_position(['assign', 'access', 'hex', 'user', 'blob', 'endpoint'], kind) r
            from placed where case kind
            when 'assign' then length(regexp_extract(m, {quoted("^" + keys + "(.*)$")}, 1)) >= 6
            when 'access' then length(m) >= 20 when 'hex' then length(m) >= 24
            when 'user' then length(m) >= 8
            when 'blob' then length(m) >= 20 and regexp_matches(m, '[a-z]')
                and regexp_matches(m, '[A-Z]') and regexp_matches(m, '[0-9]')
            else length(m) >= 10 end),
        told as (select * from good g where r <= 3 or exists (select 1 from good o
            where o.doc_id = g.doc_id and abs(o.s - g.s) <= 200 and (o.s >= g.e or o.e <= g.s)
            and (o.kind in ('assign', 'hex', 'blob')) <> (g.kind in ('assign', 'hex', 'blob'))))
        select d.doc_id, count(*) filter (kind = 'assign') n_assign,
            count(*) filter (kind = 'access') n_access, count(*) filter (kind = 'hex') n_hex,
            sha256({ordered_list("r <= 3", "s, r")}) base_sha256,
            {ordered_list("true", "s, r")} spans
        from d left join told g on d.doc_id = g.doc_id group by d.doc_id"""


def leaks() -> str:
    words = f"regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    n = contamination.WINDOW
    return f"""with d as (select doc_id, {words} w from documents),
        b as (select item_id, {words} w from benchmark),
        windows as (select distinct item_id, least(len(w), {n}) l,
            array_to_string(w[p:p + least(len(w), {n}) - 1], ' ') g
            from (select *, unnest(range(1, greatest(len(w) - {n - 1}, 1) + 1)) p from b where len(w) > 0)),
        grams as (select doc_id, p, l, array_to_string(w[p:p + l - 1], ' ') g from
            (select *, unnest(range(1, len(w) - l + 2)) p from d, (select distinct l from windows) where len(w) >= l)),
        hits as (select doc_id, p, l, item_id from grams join windows using (l, g)),
        covered as (select doc_id, count(distinct pos) n from
            (select doc_id, unnest(range(p, p + l)) pos from hits) group by doc_id),
        items as (select doc_id, count(*) n, string_agg(i, ',' order by i) ids from
            (select distinct doc_id, cast(item_id as varchar) i from hits) group by doc_id)
        select doc_id, cast(len(w) as bigint) n_words, coalesce(c.n, 0) n_hit, coalesce(i.n, 0) n_items,
            sha256(coalesce(ids, '')) items_sha256, coalesce(c.n, 0) > 0 contaminated
        from d left join covered c using (doc_id) left join items i using (doc_id)"""


LINES = f"""with l as (select doc_id, i, line, line is not null and regexp_matches(line, '{NOT_BLANK}') f from
        (select doc_id, unnest(range(len(x))) i, unnest(x) line from
            (select doc_id, string_split(coalesce(text, ''), chr(10)) x from documents))),
    f as (select *, row_number() over (partition by doc_id order by i) k,
        lead(line, 1) over (partition by doc_id order by i) l2,
        lead(line, 2) over (partition by doc_id order by i) l3 from l where f),
    w as (select *, row_number() over (partition by line, l2, l3 order by doc_id, k) o from f where l3 is not null),
    gone as (select distinct f.doc_id, f.i from w join f on f.doc_id = w.doc_id and f.k between w.k and w.k + 2 where o > 1)
    select l.doc_id, count(*) filter (l.f) n_lines, count(gone.i) n_removed,
        coalesce(string_agg(l.line, chr(10) order by l.i) filter (gone.i is null), '') as text
    from l left join gone on gone.doc_id = l.doc_id and gone.i = l.i group by l.doc_id"""

MIXING = f"""with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '{NOT_BLANK}')) as bigint) size,
        cast('0x' || substr(md5(cast(doc_id as varchar)), 1, 15) as bigint) h from documents),
    s as (select source, sum(size) z, case (row_number() over (order by source nulls last) - 1) % 3
        when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end w from d group by source),
    o as (select *, 3.0::double * z cap, row_number() over (order by 3.0::double * z / w, source) k from s),
    v as (select *, ((select sum(z) from s) - coalesce((select sum(p.cap) from o p where p.k < o.k), 0))
        / (select sum(p.w) from o p where p.k >= o.k) lev from o),
    t as (select source, cast(z as bigint) z, least(cap, w * (select lev from v where lev <= cap / w order by k limit 1)) target from o),
    c as (select d.*, z, target, case when z > 0 then cast(floor(target / z) as bigint) else 0 end n,
        target - case when z > 0 then floor(target / z) * z else 0 end rest,
        cast(sum(size) over (partition by d.source order by h) as bigint) upto
        from d join t on t.source is not distinct from d.source)
    select doc_id, size, z source_size, target, cast(size * (n + case when upto <= rest then 1
        when upto - size < rest and upto - rest < rest - (upto - size) then 1 else 0 end) as bigint) taken from c"""


def pages() -> str:
    rules = ", ".join(
        f"({quoted(r.name)}, {quoted(r.verdict)}, {quoted(r.pattern)}, {r.rank})" for r in urls.RULES
    )
    return f"""with p as (select page_id, url, translate(regexp_extract(coalesce(url, ''), {quoted(urls.URL)}, 1),
            '{UPPER}', '{UPPER.lower()}') host,
            regexp_extract(coalesce(url, ''), {quoted(urls.URL)}, 2) path from pages),
        rules as (select * from (values {rules}) r(name, verdict, pattern, rnk)),
        hits as (select page_id, arg_max(name, rnk * 1000 + length(name)) name,
            arg_max(verdict, rnk * 1000 + length(name)) verdict, max(rnk) rnk
            from p join rules on regexp_matches(host || path, pattern) group by page_id)
        select p.page_id, host, path, case when rnk = 1 then name end as rule,
            coalesce(verdict, 'allow') verdict, name as matched
        from p left join hits using (page_id)"""


NEGATIVES = """
    with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
            list_transform(embedding, lambda x: floor(256 * x::double)) v from embeddings
            where label is not null and embedding is not null
            and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
        positives as (select a.vec_id as anchor_id, a.label, a.v, p.vec_id as positive_id,
            cast(list_dot_product(a.v, p.v) as bigint) as positive_score
            from e a join e p on a.label = p.label and a.vec_id <> p.vec_id where a.vec_id % 100 = 0
            qualify row_number() over (partition by anchor_id order by positive_score desc, positive_id) <= 5),
        negatives as (select anchor_id, positive_id, n.vec_id as negative_id, positive_score,
            cast(list_dot_product(p.v, n.v) as bigint) as negative_score
            from positives p join e n on p.label <> n.label),
        ranked as (select *, row_number() over (partition by anchor_id, positive_id
            order by negative_score desc, negative_id) as place from negatives
            where 30 * positive_score <= 100 * negative_score
            and 100 * negative_score <= 90 * positive_score)
    select anchor_id, positive_id, cast(place as integer) as rank, negative_id, positive_score,
        negative_score from ranked where place <= 10"""


SQL = {
    "op2_pii": personal(),
    "op3_line_dedup": LINES,
    "op5_decontamination": leaks(),
    "op8_mixing": MIXING,
    "op9_secrets": credentials(),
    "op10_url_filters": pages(),
    "op12_hard_negatives": NEGATIVES,
}

"""The expected result of every query, as SQL for DuckDB on the same tables.

Written against the derived views of `views.py`, with SQL of its own: regular
expressions over raw HTML instead of nodes, joins and windows instead of
array expressions.
"""

from sitescan import lookups as L
from sitescan.functions import replies as R
from sitescan.functions.labels import HALF_SURE, KNOWN_PART, LEAST_LEAD
from sitescan.functions.languages import SCALE, SMOOTH
from sitescan.samples import LANGUAGES

from .views import duck_ctes

WS = L.WS
_WS_TEXT = "concat(" + ", ".join(f"chr({ord(c)})" for c in L.WS_CHARS) + ")"


def q(text):
    return "'" + str(text).replace("'", "''") + "'"


def in_list(values):
    return "(" + ", ".join(q(v) for v in values) + ")"


def sql_list(values):
    return "[" + ", ".join(q(v) for v in values) + "]"


def strip(x):
    return f"trim({x}, {_WS_TEXT})"


def squeeze(x):
    return strip(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def with_ctes(views, ctes, body):
    parts = duck_ctes(*views) + list(ctes)
    return (f"with recursive {', '.join(parts)} " if parts else "") + body


# ---------------------------------------------------------------- URLs

def normalize(x):
    t = strip(x)
    url = f"case when regexp_matches({t}, '^https?://') then {t} else concat('https://', {t}) end"
    authority = f"regexp_extract({url}, '^https?://([^/?#]*)', 1)"
    return (
        f"case when lower({t}) not in ('', 'nan', 'none', 'null') and contains({authority}, '.')"
        f" and contains({authority}, '[') = contains({authority}, ']') then {url} end"
    )


def origin(x):
    return (
        f"concat(lower(regexp_extract({x}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)), '://',"
        f" regexp_extract({x}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1))"
    )


NORMALIZED = f"normalized as (select pos, raw, {normalize('raw')} as url from raw_urls)"

# ---------------------------------------------------------------- discovery

PATTERNS = [
    """words as (select query_id, list_transform(list_filter(string_split(query, ' '), lambda w: length(w) > 3), lambda w: lower(w)) as w from queries)""",
    f"""raw_patterns as (
        select query_id, 1 as step, 0 as i, 0 as j, concat('*', array_to_string(w, '*'), '*') as p from words where len(w) > 0
        union all select query_id, 2, i, j, case j when 0 then concat('*.', w[i], w[i + 1], '.*') else concat('*', w[i], w[i + 1], '*') end
            from words, range(1, 12) r(i), range(0, 2) s(j) where i < len(w)
        union all select query_id, 3, i, j, case j when 0 then concat('*', w[i], '*blog*') else concat('*', w[i], '*') end
            from words, range(1, 12) r(i), range(0, 2) s(j) where i <= len(w) and w[i] not in {in_list(L.GENERIC_QUERY_WORDS)})""",
    """once as (select query_id, p, min(step * 1000 + i * 10 + j) as o from raw_patterns group by 1, 2)""",
    """patterns as (select query_id, cast(row_number() over (partition by query_id order by o) as int) as pattern_rank, p as pattern from once
        qualify row_number() over (partition by query_id order by o) <= 6)""",
]


def scan_ctes(n):
    return PATTERNS + [f"""scan as (
        select query_id, pattern_rank, pattern, crawl_index, index_rank,
            cast(row_number() over (partition by query_id, pattern_rank, crawl_index order by url) as int) as url_rank, url
        from patterns join url_index on status_code = 200
            and url like replace(replace(replace(pattern, '%', '!%'), '_', '!_'), '*', '%') escape '!'
        qualify row_number() over (partition by query_id, pattern_rank, crawl_index order by url) <= {n})"""]


def first_hit_ctes(n):
    return scan_ctes(n) + [
        "newest as (select query_id, pattern_rank, min(index_rank) as index_rank from scan group by 1, 2)",
        "kept as (select scan.* from scan join newest using (query_id, pattern_rank, index_rank))",
        """held as (select query_id, pattern_rank, coalesce(sum(count(*)) over (partition by query_id order by pattern_rank
            rows between unbounded preceding and 1 preceding), 0) as held from kept group by 1, 2)""",
        f"""first_hit as (select query_id, cast(held + url_rank as bigint) as rank, url from kept join held using (query_id, pattern_rank)
            where held < {2 * n} and held + url_rank <= {n})""",
    ]


def top_origins(source, n):
    return f"""select query_id, cast(row_number() over (partition by query_id order by r) as int) as rank, url from
        (select query_id, {origin('url')} as url, min(rank) as r from {source} group by 1, 2) o
        where url <> '://' qualify row_number() over (partition by query_id order by r) <= {n}"""


NOISE = "(" + " or ".join(f"contains(href, {q(d)})" for d in L.NOISE_DOMAINS) + ")"

# ---------------------------------------------------------------- crawl log

JUDGED = """judged as (select *, case when error_class = 'timeout' then 'timeout' when error_class is not null then 'request_error'
    when status_code in (403, 429) then 'blocked' when status_code between 400 and 499 then 'client_error'
    when status_code >= 500 then 'server_error' else 'ok' end as outcome from attempts)"""
OUTCOMES = [JUDGED, """outcomes as (select *, outcome in ('ok', 'blocked', 'client_error') as terminal,
    case outcome when 'timeout' then 'Request timed out' when 'request_error' then error_class
        when 'ok' then null else concat('HTTP ', status_code) end as error from judged)"""]
RESOLVED = OUTCOMES + ["""resolved as (select url, attempt, case when terminal then status_code end as status_code,
    case when outcome = 'ok' then 'OK' when outcome = 'blocked' then 'BLOCKED' when terminal then 'FAILED'
        when contains(lower(error), 'timed out') then 'TIMEOUT' else 'FAILED' end as fetch_status,
    case when outcome <> 'ok' then coalesce(nullif(error, ''), 'Unknown error after all retries') end as fetch_error
    from outcomes where attempt <= 3
    qualify row_number() over (partition by url order by terminal desc, case when terminal then attempt else -attempt end) = 1)"""]
# Attempts of any number: those beyond the third count where there are no others, those without a number last.
RESOLVED_ANY = [
    RESOLVED[0].replace("from attempts)", "from attempts_any)"), RESOLVED[1],
    RESOLVED[2].replace("from outcomes where attempt <= 3", "from outcomes").replace(
        "order by terminal desc,", "order by attempt is null, coalesce(attempt, 9) > 3, terminal desc,"
    ).replace("else -attempt end)", "else -attempt end, ts)"),
]
RENDERED_JUDGED = """rendered_judged as (select *, case when status_code in (403, 429) then 'BLOCKED' else 'OK' end as fetch_status,
    case when status_code in (403, 429) then concat('HTTP ', status_code, ' - blocked even when rendered') end as fetch_error,
    status_code >= 400 and status_code not in (403, 429) as http_error from rendered)"""
PLAIN_JUDGED = """plain_judged as (select *, case when status_code = 200 then 'OK' when status_code = 403 then 'BLOCKED' else 'FAILED' end as fetch_status,
    case when status_code <> 200 then concat('HTTP ', status_code) end as fetch_error from plain)"""
CHOSEN = [RENDERED_JUDGED, PLAIN_JUDGED, """chosen as (select p.url,
    case when p.fetch_status = 'BLOCKED' then case when r.url is null then 'none' else 'rendered' end
        when p.fetch_status = 'OK' and length(p.html) between 1 and 49999 and r.fetch_status = 'OK' and length(r.html) > 0 then 'rendered'
        else 'plain' end as source,
    p.status_code as p_code, r.status_code as r_code, p.fetch_status as p_status, r.fetch_status as r_status,
    p.fetch_error as p_error, r.fetch_error as r_error, length(p.html) as p_chars, length(r.html) as r_chars
    from plain_judged p left join rendered_judged r on p.url = r.url)""",
    """picked as (select url, source, case source when 'rendered' then r_code when 'plain' then p_code end as status_code,
    case source when 'rendered' then r_status when 'plain' then p_status else 'FAILED' end as fetch_status,
    case source when 'rendered' then r_error when 'plain' then p_error else 'Renderer not available' end as fetch_error,
    cast(case source when 'rendered' then r_chars when 'plain' then p_chars end as int) as html_chars from chosen)"""]

# ---------------------------------------------------------------- pages

ENTITIES = (("copy", "©"), ("middot", "·"), ("quot", '"'), ("amp", "&"))


def decode(x):
    # Without a semicolon first: what a decoded one leaves behind is not decoded again.
    for name, char in ENTITIES:
        x = f"regexp_replace({x}, '&{name}([^-.a-zA-Z0-9;]|$)', {q(char + chr(92) + '1')}, 'g')"
        x = f"replace({x}, {q('&' + name + ';')}, {q(char)})"
    return x


def between_tags(x):
    return f"regexp_replace({x}, '(?s)<!--.*?-->|<[^>]*>', ' ', 'g')"


def facts_ctes(source):
    """title, description, body, CMS, language and author of every row of `source`."""
    cms = " ".join(
        "when " + " or ".join(f"contains(html, {q(m)})" for m in marks) + f" then {q(name)}"
        for name, marks in L.CMS_SIGNATURES
    )
    return [
        f"""basics as (select page_id, url, html,
            coalesce(nullif({strip("regexp_extract(html, '<meta property=\"og:title\" content=\"([^\"]*)\"', 1)")}, ''),
                nullif({strip(decode("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))}, '')) as title,
            coalesce(nullif({strip("regexp_extract(html, '<meta property=\"og:description\" content=\"([^\"]*)\"', 1)")}, ''),
                nullif({strip("regexp_extract(html, '<meta name=\"description\" content=\"([^\"]*)\"', 1)")}, '')) as meta_description,
            {squeeze(decode(between_tags("regexp_extract(html, '(?s)<article>(.*?)</article>', 1)")))} as full_text,
            substr(full_text, 1, 3000) as body_text,
            case {cms} end as cms from {source})""",
        *language_ctes("basics", "full_text"),
        f"""authors as (select page_id,
            coalesce(nullif(regexp_replace(regexp_extract(html, '<script type="application/ld.json">.*?"author":(?:"|\\[?\\{{(?:"@type":"Person",)?"name":")([^"]+)"', 1), '^By ', ''), ''),
                nullif(regexp_extract(html, '<meta name="author" content="Written by ([^"]*)"', 1), ''),
                nullif(regexp_extract(html, '<span class="post-author">By ([^<]*)</span>', 1), '')) as author,
            case when contains(html, 'application/ld+json') then 'jsonld' when contains(html, 'name="author"') then 'meta'
                when contains(html, 'post-author') then 'byline' end as author_source from {source})""",
        """facts as (select b.*, l.label as detected_language, coalesce(l.confidence, 0) as language_confidence, a.author, a.author_source
            from basics b left join language l using (page_id) left join authors a using (page_id))""",
    ]


def percent(part, whole):
    return f"cast((200 * {part} + {whole}) // (2 * {whole}) as int)"


def label_ctes(name, source, text, table, key="page_id"):
    """Best label per row of `source`, by counting listed words: a join on a word table."""
    listed = ", ".join(
        f"({i}, {q(label)}, {q(word)})" for i, (label, words) in enumerate(table) for word in words
    )
    return [
        f"{name}_words as (select * from (values {listed}) as v(n, label, word))",
        f"""{name}_tokens as (select {key}, unnest(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+')) as word from {source})""",
        f"""{name}_hits as (select {key}, n, label, count(*) as hits from {name}_tokens join {name}_words using (word) group by 1, 2, 3)""",
        f"""{name} as (select {key}, arg_max(label, hits * 100 - n) as label, {percent('max(hits)', 'sum(hits)')} as confidence
            from {name}_hits group by 1)""",
    ]


def letters(x):
    return f"concat(' ', trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{M}}]+', ' ', 'g')), ' ')"


def runs(source, columns):
    """Runs of one to three characters of column `t`, none with a blank within."""
    return f"""(select {columns}, n, substr(t, cast(i as int), cast(n as int)) as run from (
        select {columns}, t, n, unnest(range(1, length(t) - n + 2)) as i from {source}, range(1, 4) r(n)) p
        where run <> ' ' and not (n = 3 and substr(run, 2, 1) = ' '))"""


def language_ctes(source, text, key="page_id"):
    """Language per row of `source`: by script, else by a join with profiles counted here from the samples."""
    samples = ", ".join(f"({i}, {q(code)}, {q(sample)})" for i, (code, (_, sample)) in enumerate(LANGUAGES.items()))
    scripts = ", ".join(f"({i}, {q(code)}, {q(found)})" for i, (code, found) in enumerate(L.LANGUAGE_SCRIPTS))
    return [
        f"samples as (select lang, code, {letters('sample')} as t from (values {samples}) as v(lang, code, sample))",
        f"sample_runs as materialized (select lang, n, run, count(*) as k from {runs('samples', 'lang')} s group by 1, 2, 3)",
        "sample_totals as (select lang, n, sum(k) as total from sample_runs group by 1, 2)",
        "sample_sizes as (select n, count(distinct run) as v from sample_runs group by 1)",
        f"""profiles as materialized (select d.n, d.run, t.lang,
            cast(floor({SCALE} * ln((coalesce(k, 0) / total + {SMOOTH}) / (1 + {SMOOTH} * v)) + 0.5) as bigint) as weight
            from (select distinct n, run from sample_runs) d join sample_totals t using (n) join sample_sizes using (n)
            left join sample_runs s on s.lang = t.lang and s.run = d.run)""",
        f"lettered as (select {key}, {letters(text)} as t from {source} where length({text}) >= 50)",
        f"""text_runs as materialized (select {key}, n, run, count(*) as k from {runs('lettered', key)} r
            where run in (select run from sample_runs) group by 1, 2, 3)""",
        f"""language_sums as (select {key}, lang, sum(k * weight) as score from text_runs join profiles using (run) group by 1, 2)""",
        f"""language_leads as (select {key}, arg_max(lang, score * 100 - lang) as lang, list(score order by score desc) as scores
            from language_sums group by 1)""",
        f"""language_runs as (select {key}, sum(k) as runs, coalesce(sum(k) filter (n = 3), 0) as longest from text_runs group by 1)""",
        f"""language_best as (select {key}, code as label, cast(100 * lead // (lead + {HALF_SURE} * runs) as int) as confidence
            from (select {key}, lang, scores[1] - scores[2] as lead from language_leads) a join language_runs using ({key})
            join samples using (lang) join lettered using ({key})
            where lead >= {LEAST_LEAD} * runs and longest * {KNOWN_PART} >= length(lettered.t))""",
        f"scripts as (select * from (values {scripts}) as v(n, code, found))",
        f"""script_hits as (select {key}, code, n, len(regexp_extract_all({text}, found)) as hits, length({text}) as chars
            from {source} cross join scripts where regexp_matches({text}, '[\\x{{370}}-\\x{{d7af}}]'))""",
        f"""script_best as (select {key}, arg_min(code, n) as label, arg_min({percent('hits', 'chars')}, n) as confidence
            from script_hits where hits * 4 >= chars and hits > 0 group by 1)""",
        f"""language as (select s.{key}, coalesce(x.label, b.label) as label, coalesce(x.confidence, b.confidence) as confidence
            from {source} s left join script_best x using ({key}) left join language_best b using ({key}) where length(s.{text}) >= 50)""",
    ]


ARTICLE = "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"
KEPT_TEXT = squeeze(decode(between_tags(
    "regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<nav.*?</nav>|<footer.*?</footer>|<!DOCTYPE[^>]*>', ' ', 'g')"
)))

NAME_RAW = """names as (select doc_id, case doc_id % 4 when 0 then concat('By ', w) when 1 then concat('author: ', w) else w end as raw
    from (select doc_id, trim(regexp_extract(text, '^[^ ]+ [^ ]+')) as w from documents) d)"""


def clean_name(x):
    bare = strip(f"regexp_replace({strip(x)}, '(?i){L.BYLINE_PREFIX}', '')")
    split = f"regexp_replace({bare}, '([a-z\\x{{c0}}-\\x{{24f}}])([A-Z\\x{{c0}}-\\x{{24f}}])', '\\1 \\2', 'g')"
    return squeeze(split)


# ---------------------------------------------------------------- e-mails

def deobfuscate(x):
    for mark, plain, spaced in L.OBFUSCATIONS:
        some = "+" if spaced else "*"
        x = f"regexp_replace({x}, '(?i){WS}{some}{mark}{WS}{some}', '{plain}', 'g')"
    return x


_ADDRESS = r"(?:\b[a-zA-Z0-9_]|\B[.%+\-])[a-zA-Z0-9._%+\-]*@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b"


def email_ctes(source, key="page_id", text="html"):
    """hits -> matches (offset by offset) -> scored -> ranked."""
    blocked = " or ".join(f"regexp_matches(email, {q('(?i)' + p)})" for p in L.EMAIL_BLOCKLIST)
    return [
        f"cleared as (select {key}, {deobfuscate(text)} as clear from {source})",
        f"hits as (select {key}, clear, regexp_extract_all(clear, {q(_ADDRESS)}) as h from cleared)",
        f"""walk as (select {key}, clear, h, 1 as i, cast(instr(clear, h[1]) - 1 as bigint) as start from hits where len(h) > 0
            union all select {key}, clear, h, i + 1,
                cast(start + length(h[i]) + instr(substr(clear, start + length(h[i]) + 1), h[i + 1]) - 1 as bigint) from walk where i < len(h))""",
        f"""matches as (select {key}, cast(start as int) as start, h[i] as raw, trim(lower(h[i]), '.') as email,
            substr(clear, greatest(start - 100, 0) + 1, start + length(h[i]) + 100 - greatest(start - 100, 0)) as context from walk)""",
        f"kept_matches as (select * from matches where not ({blocked}))",
        f"""scored as (select *, cast(case when split_part(email, '@', 1) in {in_list(L.CONTACT_LOCAL_PARTS)} then 20 else 0 end
            + case when regexp_matches(context, {q('(?i)' + '|'.join(L.CONTACT_KEYWORDS))}) then 15 else 0 end
            - case when length(split_part(email, '@', 1)) < 4 then 10 else 0 end as int) as score from kept_matches)""",
        f"""ranked as (select {key}, email, cast(greatest(0, max(score)) as int) as score,
            cast(row_number() over (partition by {key} order by greatest(0, max(score)) desc, email) as int) as rank
            from scored group by 1, 2)""",
        f"best as (select {key}, email from ranked where rank = 1)",
    ]


VERDICTS = [f"""verdicts as (select email, ok as format_valid, ok and coalesce(mx_count > 0, false) as mx_valid,
    ok and coalesce(mx_count > 0, false) as is_valid
    from (select distinct email, regexp_matches(email, {q(L.EMAIL_FORMAT)}) as ok from addresses) a
    left join mx_snapshot on domain = split_part(email, '@', 2))"""]
# Addresses as found in the documents, some of them spoilt.
ADDRESSES = [
    *email_ctes("documents", "doc_id", "text"),
    """addresses as (select email from ranked union select concat(email, '.') from ranked)""",
]

# ---------------------------------------------------------------- classification

BATCHED = "batched as (select page_id, url, cast(floor((row_number() over (order by url) - 1) / 10) as bigint) as batch_id from pages)"
REQUESTS = "requests as (select cast(floor(page_id / 10) as bigint) as batch_id, page_id, url from pages)"
ITEM_FACTS = """item_facts as (select cast(floor(page_id / 10) as bigint) as batch_id, page_id, url,
    case page_id % 3 when 0 then 'Personal Finance' when 1 then 'Travel Blog' else '' end as niche,
    case page_id % 4 when 0 then 'Blog' when 1 then 'E-commerce' when 2 then 'Unknown' else 'News' end as site_type,
    'English (en)' as language, case when page_id % 7 = 0 then 'Ida Wells' end as author,
    cast(case page_id % 5 when 0 then 85 when 1 then 100 when 2 then 0 when 3 then 72 else 0 end as int) as niche_score,
    cast(page_id % 100 as int) as author_score from pages where contains(html, '</html>'))"""
BATCH_ERROR = f"case r.batch_id % 5 when 1 then {q(R.INVALID_REPLY)} when 2 then {q(R.NOT_AN_ARRAY)} when 3 then {q(R.EMPTY_REPLY)} end"
CLASSIFIED = [REQUESTS, ITEM_FACTS, f"""answers as (select r.batch_id, r.url, r.page_id, i.url is not null and r.batch_id % 5 in (0, 4) as answered,
    case when b.batch_id is null then {q(R.NO_REPLY)} else {BATCH_ERROR} end as batch_error,
    i.niche, i.site_type, i.language, i.author, i.niche_score, i.author_score
    from requests r left join item_facts i on i.url = r.url left join (select distinct batch_id from item_facts) b on b.batch_id = r.batch_id)""",
    f"""classified as (select url, batch_id, case when answered then niche end as niche, case when answered then site_type else 'Unknown' end as site_type,
    case when answered then language end as language, case when answered then author end as author,
    case when answered then niche_score else 0 end as confidence_niche, case when answered then 90 else 0 end as confidence_type,
    case when answered then 95 else 0 end as confidence_language, case when answered then author_score else 0 end as confidence_author,
    coalesce(batch_error, case when not answered then {q(R.MISSING_ITEM)} end) as ai_error from answers)"""]
SCORE_TEXT = "scoring as (select page_id, concat_ws(' ', url, title, meta_description, full_text) as text from facts)"
_NAMES = " ".join(f"when {q(c)} then {q(f'{n} ({c})')}" for c, n in L.LANGUAGE_NAMES)


def scored_ctes(source):
    return [
        *facts_ctes(source), SCORE_TEXT,
        *label_ctes("types", "scoring", "text", L.SITE_TYPE_WORDS),
        *label_ctes("topics", "scoring", "text", L.NICHE_WORDS),
        f"""scorer as (select f.url, f.page_id, p.label as niche, coalesce(t.label, 'Unknown') as site_type,
            case f.detected_language {_NAMES} end as language, f.author,
            coalesce(p.confidence, 0) as confidence_niche, coalesce(t.confidence, 0) as confidence_type,
            f.language_confidence as confidence_language,
            case f.author_source when 'jsonld' then 95 when 'meta' then 85 when 'byline' then 60 else 0 end as confidence_author, f.cms
            from facts f left join types t using (page_id) left join topics p using (page_id))""",
    ]


# Pages with a crawl status, classified by the replies.
MERGED = [
    *facts_ctes("pages_decorated"), *email_ctes("pages_decorated"), *CLASSIFIED,
    """crawl as (select page_id, url, case page_id % 5 when 0 then 'FAILED' when 1 then 'TIMEOUT' else 'OK' end as fetch_status,
        case page_id % 5 when 0 then 'HTTP 500' when 1 then 'Request timed out' end as fetch_error from pages)""",
    """merged as (select f.url, c.niche, c.site_type, c.language,
        case when c.author <> '' then c.author when c.confidence_author < 50 then f.author else c.author end as author,
        b.email, nullif(c.confidence_niche, 0) as confidence_niche, nullif(c.confidence_type, 0) as confidence_type,
        nullif(c.confidence_author, 0) as confidence_author, f.cms,
        case when c.ai_error is not null then 'AI_ERROR' else 'OK' end as status, c.ai_error as error
        from facts f join crawl w using (page_id) left join best b using (page_id) left join classified c on c.url = f.url
        where w.fetch_status = 'OK')""",
    """results as (select * from merged union all
        select url, null, null, null, null, null, null, null, null, null, fetch_status, fetch_error from crawl where fetch_status <> 'OK')""",
    f"""checked as (select r.*, case when email is not null then regexp_matches(email, {q(L.EMAIL_FORMAT)}) and coalesce(mx_count > 0, false) end as email_valid
        from results r left join mx_snapshot on domain = split_part(email, '@', 2))""",
]
RESULT_FIELDS = "url, niche, site_type, language, author, email, email_valid, confidence_niche, confidence_type, confidence_author, cms, status, error"
_SHOWN = ", ".join(
    f"coalesce(cast({f} as varchar), '') as {q(h)}".replace(f"as {q(h)}", f'as "{h}"')
    if f != "email_valid"
    else f"coalesce(case email_valid when true then 'True' when false then 'False' end, '') as \"{h}\""
    for f, h in L.RESULT_COLUMNS
)

# ---------------------------------------------------------------- links

OUTLINKS = [
    """anchors as (select page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as href from pages)""",
    f"""resolved_links as (select page_id, case when regexp_matches(href, '^https?://') then {origin('href')}
        when href = '' or starts_with(href, '#') then null else {origin('url')} end as link_origin from anchors)""",
]

N = 10


def oracle_sql():
    deco, attempts = ["pages_decorated"], ["attempts"]
    email_html = email_ctes("pages_decorated")
    page = facts_ctes("pages_decorated")
    delay = 2_000_000
    return {
        "url_scan": "select page_id as pos, url from pages",
        "url_scan_mixed": """select page_id, url, case page_id % 3 when 0 then 'a;b' when 1 then concat('two', chr(10), 'lines ', url) else 'x,y' end as note,
            cast(null as varchar) as odd from pages""",
        "url_load": with_ctes(["raw_urls"], [NORMALIZED], """select url, min(pos) as pos, (select count(distinct url) from normalized) as unique_urls,
            (select count(*) - count(url) from normalized) as invalid, (select count(url) - count(distinct url) from normalized) as duplicates
            from normalized where url is not null group by url"""),
        "url_normalize": with_ctes(["raw_urls"], [NORMALIZED], "select pos, url from normalized where url is not null"),
        "url_dedupe": with_ctes(["raw_urls"], [NORMALIZED], "select url, min(pos) as pos from normalized where url is not null group by url"),
        "url_load_audit": with_ctes(["raw_urls"], [NORMALIZED], "select count(distinct url) as unique_urls, cast(count(*) - count(url) as bigint) as invalid, cast(count(url) - count(distinct url) as bigint) as duplicates from normalized"),
        "url_merge": with_ctes(
            ["raw_urls"],
            [NORMALIZED, "known as (select url, min(pos) as pos from normalized where url is not null group by url)",
             f"found as (select {origin('url')} as url, min(page_id) as pos from pages group by 1 union all select url, page_id from pages)",
             "fresh as (select url, min(pos) as pos from found where url not in (select url from known) group by url)"],
            "select url, pos from known union all select url, cast(pos + (select max(pos) + 1 from known) as bigint) from fresh"),
        "query_patterns": with_ctes(["queries"], PATTERNS, "select query_id, pattern_rank, pattern from patterns"),
        "index_pattern_scan": with_ctes(["queries", "url_index"], scan_ctes(N), "select * from scan"),
        "index_first_hit": with_ctes(["queries", "url_index"], first_hit_ctes(N), "select * from first_hit"),
        "noise_domain_filter": with_ctes(["links"], [], f"select * from links where not {NOISE}"),
        "url_origin": with_ctes(["links"], [], f"select query_id, rank, {origin('href')} as origin from links"),
        "origin_dedupe": f"select {origin('url')} as origin, min(page_id) as rank from pages group by 1",
        "index_pattern_scan_stored": with_ctes(["queries", "url_index"], scan_ctes(N), "select * from scan"),
        "search_results_explode": with_ctes(["links"], [], f"""select query_id, cast(row_number() over (partition by query_id order by rank) as int) as rank, href as url
            from links qualify row_number() over (partition by query_id order by rank) <= {2 * N}"""),
        "discover": with_ctes(["queries", "url_index"], first_hit_ctes(2 * N), top_origins("first_hit", N)),
        "discover_links": with_ctes(
            ["links"],
            [f"""clean as (select query_id, row_number() over (partition by query_id order by rank) as rank, href as url from links
                where not {NOISE} qualify row_number() over (partition by query_id order by rank) <= {2 * N})"""],
            top_origins("clean", N)),
        "attempt_outcome": with_ctes(attempts, OUTCOMES, "select url, attempt, outcome, terminal, error from outcomes"),
        "attempt_resolve": with_ctes(attempts, RESOLVED, "select * from resolved"),
        "retry_backoff": with_ctes(attempts, OUTCOMES, """select url, attempt, outcome, cast(w as bigint) as wait_s,
            cast(sum(w) over (partition by url order by attempt rows unbounded preceding) as bigint) as total_wait_s
            from (select *, case when not terminal and attempt < 3 then pow(2, attempt - 1) else 0 end as w from outcomes) o"""),
        "render_fallback": with_ctes(["plain", "rendered"], CHOSEN, "select * from picked"),
        "render_outcome": with_ctes(["rendered"], [RENDERED_JUDGED], "select url, fetch_status, fetch_error, http_error from rendered_judged"),
        "politeness_plan": with_ctes(
            attempts,
            ["r as (select host, url, attempt, epoch_us(ts) as arrival_us, dur_s * 1000000 as dur_us from attempts)",
             f"""p as (select *, coalesce(sum(dur_us + {delay}) over (partition by host order by arrival_us, url, attempt, dur_us
                rows between unbounded preceding and 1 preceding), 0) as busy from r)"""],
            """select host, url, attempt, arrival_us, dur_us, cast(busy + max(arrival_us - busy) over (partition by host
                order by arrival_us, url, attempt, dur_us rows unbounded preceding) as bigint) as start_us from p"""),
        "fetch_split": with_ctes(attempts, RESOLVED, "select case when fetch_status = 'OK' then 'good' else 'failed' end as side, fetch_status, count(*) as urls from resolved group by 1, 2"),
        "html_nodes": """select tag, cast(count(*) as bigint) as nodes from (select unnest(regexp_extract_all(
            regexp_replace(html, '(?s)<!--.*?-->|(<script[^>]*>).*?</script>', '\\1', 'g'), '<([a-z0-9]+)', 1)) as tag from pages) t group by 1""",
        "page_title": with_ctes(deco, page, "select page_id, title from facts"),
        "page_description": with_ctes(deco, page, "select page_id, meta_description from facts"),
        "quick_title": with_ctes(deco, page, "select page_id, title from facts"),
        "quick_body": f"select page_id, body_text from (select page_id, substr({squeeze(decode(between_tags(ARTICLE)))}, 1, 3000) as body_text from pages) b",
        "strip_boilerplate": f"select page_id, {KEPT_TEXT} as kept_text from pages",
        "content_root": "select page_id, case when not contains(html, '<article>') or page_id % 3 = 2 then 'body' when page_id % 3 = 1 then 'main' else 'article' end as tag from pages",
        "body_text": with_ctes(deco, page, "select page_id, body_text from facts"),
        "cms_fingerprint": with_ctes(deco, page, "select page_id, cms from facts"),
        "language_id": with_ctes([], language_ctes("documents", "text", "doc_id"),
            "select doc_id, label as detected_language from documents left join language using (doc_id)"),
        "language_accuracy": with_ctes([], language_ctes("documents", "text", "doc_id"),
            "select lang, label as detected_language, count(*) as docs from documents left join language using (doc_id) group by 1, 2"),
        "enrich_pages": with_ctes(deco, page, "select page_id, url, title, meta_description, body_text, cms, detected_language from facts"),
        "author_jsonld": with_ctes(deco, page, "select page_id, case when author_source = 'jsonld' then author end as author from facts"),
        "author_jsonld_odd": with_ctes(deco, page, "select page_id, case when author_source = 'jsonld' then author end as author from facts"),
        "author_meta": with_ctes(deco, page, "select page_id, case when author_source = 'meta' then author end as author from facts"),
        "author_byline": with_ctes(deco, page, "select page_id, case when author_source = 'byline' then author end as author from facts"),
        "page_author": with_ctes(deco, page, "select page_id, author from facts"),
        "clean_name": f"""with {NAME_RAW}, c as (select doc_id, {clean_name('raw')} as n from names)
            select doc_id, case when regexp_matches(n, {q(L.NAME_LETTERS)}) and len(string_split(n, ' ')) <= 4
                and len(list_filter(string_split(lower(n), ' '), lambda w: w in {in_list(L.NON_NAME_WORDS)})) = 0
                and regexp_matches(n, '(?:^| )\\p{{Lu}}') then n end as name from c""",
        "email_deobfuscate": f"select page_id, {deobfuscate('html')} as clear from pages",
        "email_matches": with_ctes(deco, email_html, "select page_id, start, raw, email, context from matches"),
        "email_matches_documents": with_ctes([], email_ctes("documents", "doc_id", "text"), "select doc_id, start, raw, email, context from matches"),
        "email_blocklist": with_ctes(deco, email_html, "select page_id, start, email from kept_matches"),
        "email_score": with_ctes(deco, email_html, "select page_id, start, email, score from scored"),
        "email_rank": with_ctes(deco, email_html, "select page_id, rank, email, score from ranked"),
        "email_rank_documents": with_ctes([], email_ctes("documents", "doc_id", "text"), "select doc_id, rank, email, score from ranked"),
        "best_email": with_ctes(deco, email_html, "select page_id, email from pages left join best using (page_id)"),
        "email_format": with_ctes([], ADDRESSES, f"select email, regexp_matches(email, {q(L.EMAIL_FORMAT)}) as format_valid from addresses"),
        "email_mx": with_ctes(["mx_snapshot"], ADDRESSES + VERDICTS, "select email, mx_valid from addresses join verdicts using (email)"),
        "email_verdict": with_ctes(["mx_snapshot"], ADDRESSES + VERDICTS, """select email, format_valid, mx_valid,
            mx_valid and length(email) % 3 = 0 as is_valid from verdicts"""),
        "email_validate_bulk": with_ctes(["mx_snapshot"], ADDRESSES + VERDICTS, "select * from verdicts"),
        "email_valid_backfill": with_ctes(["pages_decorated", "mx_snapshot"], [*email_html, "addresses as (select email from best)", *VERDICTS],
            "select url, email, is_valid as email_valid from pages left join best using (page_id) left join verdicts using (email)"),
        "batch_assign": with_ctes([], [BATCHED], "select page_id, url, batch_id from batched"),
        "request_context": with_ctes(deco, page, """select url, substr(coalesce(title, ''), 1, 200) as title, substr(coalesce(meta_description, ''), 1, 300) as description,
            substr(body_text, 1, 2500) as body_text, cms, detected_language as detected_language_hint, author as rule_based_author_hint from facts"""),
        "request_payload": with_ctes(deco, [*page, BATCHED], """select batch_id, count(*) as sites, sum(length(substr(coalesce(title, ''), 1, 200))) as title_chars,
            sum(length(substr(body_text, 1, 2500))) as body_chars, string_agg(f.url, ' ' order by f.url) as urls from facts f join batched using (page_id) group by 1"""
            .replace("sum(length(substr(coalesce(title, ''), 1, 200)))", "cast(sum(length(substr(coalesce(title, ''), 1, 200))) as bigint)")
            .replace("sum(length(substr(body_text, 1, 2500)))", "cast(sum(length(substr(body_text, 1, 2500))) as bigint)")),
        "reply_unfence": with_ctes(["replies"], [], """select batch_id, case when batch_id % 5 = 0
            then replace(replace(reply, concat('```json', chr(10)), ''), concat(chr(10), '```'), '') else reply end as reply from replies"""),
        "reply_explode": with_ctes([], [ITEM_FACTS], """select batch_id, cast(row_number() over (partition by batch_id order by page_id) - 1 as int) as pos, url, niche, site_type, language, author,
            niche_score as confidence_niche, cast(90 as int) as confidence_type, cast(95 as int) as confidence_language, author_score as confidence_author
            from item_facts where batch_id % 5 in (0, 4)"""),
        "site_type_coerce": with_ctes([], [ITEM_FACTS], "select page_id, site_type from item_facts"),
        "confidence_clamp": with_ctes([], [ITEM_FACTS], """select page_id, niche_score as niche, cast(90 as int) as site_type, cast(95 as int) as language, author_score as author from item_facts"""),
        "reply_gap_fill": with_ctes([], CLASSIFIED, f"""select batch_id, url, niche, site_type, language, author, confidence_niche, confidence_type, confidence_language, confidence_author,
            case when language is null then {q(R.MISSING_ITEM)} end as ai_error from classified"""),
        "batch_error_spread": with_ctes([], CLASSIFIED, "select batch_id, url, batch_error from answers"),
        "read_replies": with_ctes([], CLASSIFIED, "select url, niche, site_type, language, author, confidence_niche, confidence_type, confidence_language, confidence_author, ai_error from classified"),
        # Errors of the batch that was answered, or that nobody did, whichever batch is later.
        "read_replies_odd": with_ctes([], CLASSIFIED, f"""select url, niche, site_type, language, author, confidence_niche, confidence_type, confidence_language, confidence_author,
            case when ai_error is not null then {q(R.NO_REPLY)} end as ai_error from classified"""),
        "classify_sites": with_ctes(deco, scored_ctes("pages_decorated"), "select page_id, niche, site_type, language, author, confidence_niche, confidence_type, confidence_language, cast(confidence_author as int) as confidence_author from scorer"),
        "author_precedence": with_ctes(["pages_decorated"], MERGED, "select url, author from merged"),
        "result_merge": with_ctes(["pages_decorated"], MERGED[:-1], "select url, niche, site_type, language, author, email, confidence_niche, confidence_type, confidence_author, cms, status, error from merged"),
        "failed_rows": with_ctes(["pages_decorated"], MERGED[:-1], "select url, niche, site_type, language, author, email, confidence_niche, confidence_type, confidence_author, cms, status, error from results"),
        "site_results": with_ctes(["pages_decorated", "mx_snapshot"], MERGED, f"select {RESULT_FIELDS} from checked"),
        "result_format": with_ctes(["pages_decorated", "mx_snapshot"], MERGED, f"select {_SHOWN} from checked"),
        "csv_sink": with_ctes(["pages_decorated", "mx_snapshot"], MERGED, f"select {_SHOWN} from checked"),
        "result_rewrite": with_ctes(["pages_decorated", "mx_snapshot"], MERGED, f"select {RESULT_FIELDS} from checked"),
        "learned_classifier_report": """select count(*) as documents, count(*) as answered, count(*) as within, count(lang) as labelled,
            true as accurate, true as calibrated from documents""",
        "run_stamp": "select strftime(ts, 'crawl_%Y-%m-%d_%H%M%S') as run_id, count(*) as n from events group by 1",
        "json_archive": with_ctes(["pages_decorated"], MERGED[:-1], "select url, niche, site_type, language, author, email, confidence_niche, confidence_type, confidence_author, cms, status, error from results"),
        "run_summary": with_ctes(["pages_decorated"], MERGED[:-1], """select count(*) as total, count_if(status in ('OK', 'AI_ERROR')) as successful,
            count_if(status not in ('OK', 'AI_ERROR')) as failed from results""").replace("count_if(status in", "count(*) filter (status in").replace("count_if(status not in", "count(*) filter (status not in"),
        "status_counts": with_ctes(["pages_decorated"], MERGED[:-1], "select status, count(*) as sites from results group by 1"),
        "profile_sites": with_ctes(["pages_decorated", "raw_urls", "mx_snapshot"], [NORMALIZED, *scored_ctes("pages_decorated"), *email_html,
            f"""wanted as (select distinct url from normalized where url is not null)""",
            f"""rows as (select w.url, s.niche, s.site_type, s.language, s.author, b.email,
                case when b.email is not null then regexp_matches(b.email, {q(L.EMAIL_FORMAT)}) and coalesce(mx_count > 0, false) end as email_valid,
                nullif(s.confidence_niche, 0) as confidence_niche, nullif(s.confidence_type, 0) as confidence_type,
                cast(nullif(s.confidence_author, 0) as int) as confidence_author, s.cms,
                case when s.url is null then 'FAILED' else 'OK' end as status, case when s.url is null then 'no crawl result' end as error
                from wanted w left join scorer s on s.url = w.url left join best b using (page_id) left join mx_snapshot on domain = split_part(b.email, '@', 2))"""],
            f"select {RESULT_FIELDS} from rows"),
        "profile_crawl": with_ctes(
            ["plain", "rendered", "mx_snapshot"],
            [*CHOSEN,
             "chosen_pages as (select page_id, url, case when html_chars > 0 then html else '' end as html from picked join pages using (url))",
             *scored_ctes("chosen_pages"), *email_ctes("chosen_pages"),
             f"""rows as (select k.url, k.fetch_status, k.fetch_error, s.*, b.email, case when b.email is not null
                then regexp_matches(b.email, {q(L.EMAIL_FORMAT)}) and coalesce(mx_count > 0, false) end as email_valid
                from picked k join scorer s on s.url = k.url left join best b using (page_id) left join mx_snapshot on domain = split_part(b.email, '@', 2))"""],
            """select url, niche, site_type, language, author, email, email_valid, nullif(confidence_niche, 0) as confidence_niche,
                nullif(confidence_type, 0) as confidence_type, cast(nullif(confidence_author, 0) as int) as confidence_author,
                cms, fetch_status as status, null as error from rows where fetch_status = 'OK'
            union all select url, null, null, null, null, null, null, null, null, null, null, fetch_status, fetch_error from rows where fetch_status <> 'OK'"""),
        "outlink_totals": with_ctes([], OUTLINKS, "select link_origin, count(*) as links, count(distinct page_id) as pages from resolved_links where link_origin is not null group by 1"),
        "outlinks": with_ctes([], OUTLINKS, "select page_id, link_origin, count(*) as links from resolved_links where link_origin is not null group by 1, 2"),
        "stream_url_dedupe": "select distinct url from pages",
        "stream_progress": "select date_trunc('hour', ts) as hour, event_type, count(*) as n from events group by 1, 2",
        "stream_attempt_resolve": with_ctes(attempts, RESOLVED, "select url, attempt, status_code, fetch_status, fetch_error from resolved"),
        "attempt_resolve_any": with_ctes(["attempts_any"], RESOLVED_ANY, "select url, attempt, status_code, fetch_status, fetch_error from resolved"),
        "stream_attempt_resolve_any": with_ctes(["attempts_any"], RESOLVED_ANY, "select url, attempt, status_code, fetch_status, fetch_error from resolved"),
        "stream_enrich": with_ctes([], facts_ctes("pages"), "select page_id, title, body_text, detected_language from facts"),
    }

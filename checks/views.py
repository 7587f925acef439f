"""Test inputs derived from the given tables, by one SQL text for both engines.

`<<name>>` stands for a given table or for another view.
"""

import re

from sitescan.sources.tables import read_pages

VIEWS = {
    # Raw cells: missing schemes, padding, nan, upper-case schemes, junk, ftp; every URL twice.
    "raw_urls": """
        select page_id as pos, case page_id % 10
            when 0 then regexp_replace(url, '^https?://', '')
            when 1 then concat('  ', url, ' ')
            when 2 then 'nan'
            when 3 then replace(replace(url, 'https://', 'HTTPS://'), 'http://', 'HTTP://')
            when 4 then 'not a url'
            when 6 then concat('ftp://', cast(page_id as string), '.example.org')
            else url end as raw from <<pages>>
        union all select page_id + 1000000 as pos, url as raw from <<pages>>""",
    # Pages with og tags, JSON-LD in three shapes, meta authors, bylines, hidden and
    # blocked addresses, and marks of publishing systems.
    "pages_decorated": """
        select page_id, url, case page_id % 8
            when 0 then replace(html, '<head>', concat('<head><meta property="og:title" content=" OG title ', cast(page_id as string), ' "><meta name="description" content="Plain text ', cast(page_id as string), '">'))
            when 1 then replace(html, '<head>', '<head><script type="application/ld+json">{"@type":"Article","author":{"@type":"Person","name":"Jane Smith"}}</script>')
            when 2 then replace(html, '<head>', '<head><script type="application/ld+json">[{"@type":"WebSite"},{"@type":"BlogPosting","author":"By Bob Lee"}]</script>')
            when 3 then replace(html, '<head>', '<head><link href="/wp-content/x.css"><script type="application/ld+json">{"author":[{"name":"Ana Maria Cruz"},{"name":"Second Name"}]}</script>')
            when 4 then replace(html, '<head>', '<head><meta property="article:author" content="https://a.example.org/tom"><meta name="author" content="Written by Tom Hill"><meta property="og:description" content="OG text">')
            when 5 then replace(html, '<article>', '<article><span class="post-author">By Kim Novak</span>')
            when 6 then replace(html, '</article>', '<p>Contact: info [at] site7 [dot] org or tip@news.example.net, logo@2x.png, no-reply@site7.org</p><img src="https://cdn.shopify.com/a.png"></article>')
            else html end as html from <<pages>>""",
    # A crawl log: up to three attempts per URL.
    "attempts": """
        select concat('https://h', cast(user_id % 20 as string), '.example.org/u', cast(user_id as string), '/', cast(cast(floor((rn - 1) / 3) as bigint) as string)) as url,
            concat('h', cast(user_id % 20 as string), '.example.org') as host,
            cast((rn - 1) % 3 + 1 as int) as attempt,
            case event_type when 'view' then 200 when 'click' then 404 when 'purchase' then 403 when 'signup' then 503 end as status_code,
            case when event_type = 'error' then case when event_id % 2 = 0 then 'timeout' else 'request_error' end end as error_class,
            ts, cast(floor(value) as bigint) as dur_s
        from (select *, row_number() over (partition by user_id order by ts, event_id) as rn from <<events>>) e""",
    # The same with attempts of any number: none, zero, and beyond the allowed ones.
    "attempts_any": """
        select url, host, cast(case when dur_s % 7 = 0 then null when dur_s % 7 = 1 then 0 when dur_s % 7 < 4 then attempt + 3 else attempt end as int) as attempt,
            status_code, error_class, ts, dur_s from <<attempts>>""",
    "url_index": """
        select concat('idx-', cast(page_id % 3 as string)) as crawl_index, cast(page_id % 3 as int) as index_rank, url,
            case when page_id % 7 = 0 then 404 else 200 end as status_code from <<pages>>""",
    # The plain crawl, and a rendered one that lacks the mobile hosts.
    "plain": """
        select page_id, url, cast(case page_id % 5 when 0 then 403 when 1 then 404 else 200 end as int) as status_code,
            case when page_id % 5 > 1 then html end as html from <<pages>>""",
    "rendered": """
        select page_id, url, cast(case page_id % 6 when 0 then 403 when 1 then 404 else 200 end as int) as status_code,
            case when page_id % 6 = 2 then '' else concat(html, '<!-- rendered -->') end as html
        from <<pages>> where url not like '%://m.%'""",
    # One keyword query per host.
    "queries": """
        select min(page_id) as query_id, replace(host, '.', ' ') as query
        from (select page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) as host from <<pages>>) h
        group by host""",
    # Links as a search engine would rank them, forty per query, some of them noise.
    "links": """
        select cast(floor(page_id / 40) as int) as query_id, cast(page_id % 40 + 1 as int) as rank, case page_id % 6
            when 0 then concat('https://www.youtube.com/watch?v=', cast(page_id as string))
            when 1 then concat('https://netflix.com/', cast(page_id as string))
            when 2 then concat('https://blog.reddit.com/', cast(page_id as string))
            else url end as href from <<pages>>""",
    # Some domains are absent on purpose.
    "mx_snapshot": """
        select * from (values ('mail0.example.com', 1), ('mail1.example.com', 2), ('mail2.example.com', 0),
            ('mail3.example.com', 1), ('mail4.example.com', 1), ('mail5.example.com', 0),
            ('mail6.example.com', 3), ('mail8.example.com', 1), ('site7.org', 1)) as m(domain, mx_count)""",
    # Replies per site: text, out-of-range, negative, fractional and null scores, odd
    # site types. Truncated pages have none.
    "reply_items": """
        select cast(floor(page_id / 10) as bigint) as batch_id, page_id, concat('{"url":"', url, '","niche":"',
            case page_id % 3 when 0 then 'Personal Finance' when 1 then 'Travel Blog' else '' end, '","site_type":"',
            case page_id % 4 when 0 then 'blog' when 1 then 'E-COMMERCE' when 2 then 'Forum' else 'News' end,
            '","language":"English (en)","author":', case page_id % 7 when 0 then '"Ida Wells"' else 'null' end,
            ',"confidence":{"niche":',
            case page_id % 5 when 0 then '"85"' when 1 then '140' when 2 then '-3' when 3 then '72.9' else 'null' end,
            ',"site_type":90,"language":95,"author":', cast(page_id % 100 as string), '}}') as item
        from <<pages>> where html like '%</html>%'""",
    # Whole replies: fenced, invalid, not an array, empty, and with a stray number.
    "replies": """
        select batch_id, case batch_id % 5 when 1 then 'not json' when 2 then '{"a":1}' when 3 then ''
            when 0 then concat('```json', chr(10), '[', %AGG%, ']', chr(10), '```')
            else concat('[', %AGG%, ',5]') end as reply
        from <<reply_items>> group by batch_id""",
    # The same with a repeated key and a number that is none in every item, the last key being right.
    "replies_odd": """
        select batch_id, replace(reply, '{"url"', '{"niche":"stale","weight":NaN,"url"') as reply from <<replies>>""",
    "pages_odd": """
        select page_id, url, replace(html, '"author":', '"author":"Stale Name","rank":-Infinity,"author":') as html from <<pages_decorated>>""",
}
_SPARK_AGG = "listagg(item, ',') within group (order by page_id)"
_DUCK_AGG = "string_agg(item, ',' order by page_id)"
_REF = re.compile(r"<<([a-z_]+)>>")


def spark_view(spark, sf_dir, name):
    """A view, or a given table, as a Spark DataFrame."""
    if name not in VIEWS:
        return read_pages(spark, f"{sf_dir}/{name}.parquet")
    return spark.sql(_spark_text(spark, sf_dir, name))


def _spark_text(spark, sf_dir, name):
    def source(match):
        ref = match.group(1)
        if ref in VIEWS:
            return f"({_spark_text(spark, sf_dir, ref)})"
        spark_view(spark, sf_dir, ref).createOrReplaceTempView(f"given_{ref}")
        return f"given_{ref}"

    return _REF.sub(source, VIEWS[name].replace("%AGG%", _SPARK_AGG))


def duck_ctes(*names) -> list[str]:
    """The views (and those they need) as CTE definitions."""
    ordered = []

    def visit(name):
        if name not in VIEWS:
            return
        for ref in _REF.findall(VIEWS[name]):
            visit(ref)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return [f"{n} as ({_REF.sub(r'\1', VIEWS[n].replace('%AGG%', _DUCK_AGG))})" for n in ordered]

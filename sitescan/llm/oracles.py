"""SQL twins of the queries that SQL can express, for DuckDB."""

import re
from functools import reduce

from .chat_format import CLOSE, CODES, ESCAPE, OPEN
from .decontaminate import LEAST, MASKS, SHORTEST, TOLERANT, WINDOW
from .secrets import ACCESS, ASSIGN, ASSIGN_LEAST, CANDIDATE, ENCODINGS, HEX, KINDS, LEAST_P, LENGTHS


def _escaped(text):
    pairs = [(ESCAPE, ESCAPE + "e"), *((c, ESCAPE + x) for c, x in CODES.items())]
    return reduce(lambda sql, p: f"replace({sql}, '{p[0]}', '{p[1]}')", pairs, text)


def _seeds(tokens, at):
    # DuckDB's lists count from 1.
    keys = (
        f"CASE WHEN {at} + {m[-1]} < len({tokens}) THEN " + " || ' ' || ".join([f"'{i}'", *(f"{tokens}[{at} + {o + 1}]" for o in m)]) + " END"
        for i, m in enumerate(MASKS)
    )
    return f"unnest([{', '.join(keys)}])"


def _words(text):
    return f"regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{M}}\\p{{N}}]+')"


def _content(n_chars):
    values = ("doc_id", "source", "lang", n_chars, "text")
    return " || ".join(f"coalesce(strlen(({x})::VARCHAR) || ':' || ({x})::VARCHAR, '-')" for x in values)


# The bits of each character of a decimal number, most significant polynomial first.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda c, _: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""


def _matches(pattern):
    """(start, end, found) of all matches in `text`."""
    p = pattern.replace("'", "''")
    gaps, found = f"string_split_regex(text, '{p}')", f"regexp_extract_all(text, '{p}')"
    return f"""list_transform(range(1, len({found}) + 1), lambda i: struct_pack(
        "start" := list_sum(list_transform({gaps}[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform({found}[1:i - 1], lambda x: length(x))), 0)::BIGINT,
        "end" := list_sum(list_transform({gaps}[1:i], lambda x: length(x)))::BIGINT + list_sum(list_transform({found}[1:i], lambda x: length(x)))::BIGINT,
        "found" := {found}[i]))"""


def _spans(found, kind):
    return f"""list_transform({found}, lambda x: struct_pack("start" := x."start", kind := {kind}, "end" := x."end"))"""


def _listed(spans):
    return f"""array_to_string(list_transform({spans}, lambda x: ['assign', 'access', 'hex', 'random'][x.kind + 1] || ':' || x."start" || ':' || x."end"), ',')"""


def _by_encoding(of):
    return "CASE " + " ".join(f"WHEN code = {i} THEN {of(alphabet)}" for i, alphabet in enumerate(ENCODINGS.values())) + " END"


def _z(x, df):
    return f"((cbrt(({x}) / {df}) - {1 - 2 / (9 * df)!r}) / {(2 / (9 * df)) ** 0.5!r})"


def _uniform(alphabet):
    size = len(alphabet)
    shares = [(k, sum(bool(re.match(k, c)) for c in alphabet) / size) for k in KINDS]
    shares = [(k, s) for k, s in shares if s]
    kinds = " + ".join(f"(length(regexp_replace(token, '{k.replace('[', '[^', 1)}', '', 'g')) - n * {s!r}) ** 2 / (n * {s!r})" for k, s in shares)
    squares = " + ".join(f"(n - length(replace(token, '{c}', ''))) ** 2" for c in alphabet)
    return f"CASE WHEN n < {2 * size} THEN {_z(kinds, len(shares) - 1)} ELSE {_z(f'greatest(({squares}) * {size} / n - n, 0)', size - 1)} END"


def _tail(z):
    return f"(1 / (1 + exp(1.5976 * ({z}) + 0.07056 * ({z}) ** 3)))"


_CODE = " ".join(
    f"WHEN regexp_full_match(token, '[{a.replace('-', '')}{'-' if '-' in a else ''}]+') THEN {i}" for i, a in enumerate(ENCODINGS.values())
)
_CLASS = " + ".join(f"CASE WHEN n >= {n} THEN 1 ELSE 0 END" for n in LENGTHS[1:])
_LOGS = " + ".join(f"ln(least(greatest({p}, {LEAST_P}), 1))" for p in (_tail("uniform"), f"2 * {_tail('abs(runs)')}", f"2 * {_tail('abs(serial)')}"))


ORACLE_SQL = {
    "op1_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
            FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
        ), r AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
        )
        SELECT * FROM r WHERE rank <= 20
    """,
    "op5_decontaminate": f"""
        WITH items AS (
            SELECT * FROM (SELECT item_id, {_words("text")} AS item FROM benchmark) WHERE len(item) >= {SHORTEST}
        ), docs AS (
            SELECT doc_id, {_words("text")} AS doc FROM documents
        ), planted AS (
            SELECT item_id, spot AS item_at, {_seeds("item", "spot")} AS seed
            FROM (SELECT *, unnest(range(len(item))) AS spot FROM items)
        ), windows AS (
            SELECT doc_id, spot, {_seeds("doc", "spot")} AS seed FROM (SELECT *, unnest(range(len(doc))) AS spot FROM docs)
        ), hits AS (
            SELECT DISTINCT doc_id, item_id, spot - item_at AS shift FROM windows JOIN planted USING (seed)
        ), compared AS (
            SELECT doc_id, item_id, shift, least({WINDOW}, len(item)) AS n_words,
                list_transform(range(len(item)), lambda k:
                    CASE WHEN shift + k >= 0 AND doc[shift + k + 1] = item[k + 1] THEN 1 ELSE 0 END) AS equal
            FROM hits JOIN items USING (item_id) JOIN docs USING (doc_id)
        ), best AS (
            SELECT doc_id, item_id, shift, n_words, list_max(list_transform(range(len(equal) - n_words + 1), lambda s:
                list_sum(equal[s + 1 : s + n_words]))) AS n_equal FROM compared
        )
        SELECT doc_id, item_id, count(*) AS n_shifts, max(n_equal / n_words) AS best_share, min(shift)::INT AS first_shift
        FROM best WHERE n_equal >= CASE WHEN n_words < {TOLERANT} THEN n_words ELSE ceil(n_words * {LEAST}) END GROUP BY doc_id, item_id
    """,
    "op8_chat_format": f"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL
            SELECT -7, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(i, r)
        )
        SELECT
            conv_id,
            count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
            sum({len(OPEN) + len(CLOSE) + 1} + length(replace({_escaped("role")}, chr(10), '{ESCAPE}n')) + length({_escaped("text")}))::BIGINT AS formatted_chars
        FROM t GROUP BY conv_id
    """,
    "op12_merkle": f"""
        WITH RECURSIVE leaves AS (
            SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({_content("n_chars")}) AS leaf,
                sha256(CASE WHEN {_CRC32} % 7 = 0 THEN {_content("n_chars + 1")} ELSE {_content("n_chars")} END) AS claimed
            FROM documents
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n
            FROM leaves
        ), levels AS (
            SELECT tree, 0 AS level, pos, n, leaf AS node FROM placed
            UNION ALL
            SELECT tree, level + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(node, '' ORDER BY pos))
            FROM levels WHERE n > 1 GROUP BY tree, level, pos // 2
        ), subroots AS (
            SELECT tree, node AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM levels WHERE n = 1
        ), above AS (
            SELECT 0 AS level, pos, n, subroot AS node FROM subroots
            UNION ALL
            SELECT level + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(node, '' ORDER BY pos))
            FROM above WHERE n > 1 GROUP BY level, pos // 2
        ), siblings AS (
            SELECT p.tree, p.pos, l.level, l.node, l.pos % 2 = 0 AS is_left
            FROM placed AS p JOIN levels AS l ON l.tree = p.tree AND l.pos = xor(p.pos >> l.level, 1) AND l.n > 1
            UNION ALL
            SELECT p.tree, p.pos, 1000 + a.level, a.node, a.pos % 2 = 0
            FROM placed AS p JOIN subroots AS s ON s.tree = p.tree JOIN above AS a ON a.pos = xor(s.pos >> a.level, 1) AND a.n > 1
        ), proofs AS (
            SELECT tree, pos, string_agg(node, '' ORDER BY level) AS nodes FROM siblings GROUP BY tree, pos
        ), steps AS (
            SELECT DISTINCT tree, level FROM levels WHERE n > 1
            UNION ALL
            SELECT s.tree, 1000 + a.level FROM subroots AS s, (SELECT DISTINCT level FROM above WHERE n > 1) AS a
        ), numbered AS (
            SELECT *, row_number() OVER (PARTITION BY tree ORDER BY level) AS step FROM steps
        ), folds AS (
            SELECT tree, pos, 1 AS step, claimed AS node FROM placed
            UNION ALL
            SELECT f.tree, f.pos, f.step + 1, sha256(CASE WHEN s.is_left THEN s.node || f.node ELSE f.node || coalesce(s.node, '') END)
            FROM folds AS f JOIN numbered AS d ON d.tree = f.tree AND d.step = f.step
            LEFT JOIN siblings AS s ON s.tree = f.tree AND s.pos = f.pos AND s.level = d.level
        ), folded AS (
            SELECT tree, pos, arg_max(node, step) AS folded_root FROM folds GROUP BY tree, pos
        )
        SELECT doc_id, leaf, subroot, root, sha256(coalesce(nodes, '')) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM placed JOIN subroots USING (tree) JOIN folded ON folded.tree = placed.tree AND folded.pos = placed.pos
        LEFT JOIN proofs ON proofs.tree = placed.tree AND proofs.pos = placed.pos
        CROSS JOIN (SELECT node AS root FROM above WHERE n = 1)
    """,
    "op13_secrets": f"""
        WITH docs AS MATERIALIZED (
            SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents
        ), found AS MATERIALIZED (
            SELECT row_id, {_matches(ASSIGN)} AS assigns, {_matches(ACCESS)} AS accesses, {_matches(HEX)} AS hexes, {_matches(CANDIDATE)} AS runs
            FROM docs
        ), spans AS MATERIALIZED (
            SELECT row_id, runs, list_sort(list_concat(list_concat(
                {_spans(f"list_filter(assigns, lambda x: length(regexp_extract(x.found, '{ASSIGN.replace(chr(39), chr(39) * 2)}', 2)) >= {ASSIGN_LEAST})", 0)},
                {_spans("accesses", 1)}), {_spans("hexes", 2)})) AS base
            FROM found
        ), runs AS MATERIALIZED (
            SELECT row_id, base, unnest(runs) AS run FROM spans
        ), tokens AS MATERIALIZED (
            SELECT DISTINCT run.found AS token, length(run.found) AS n FROM runs
        ), coded AS MATERIALIZED (
            SELECT *, CASE WHEN regexp_full_match(token, '[0-9]*') THEN NULL {_CODE} END AS code FROM tokens
        ), valued AS MATERIALIZED (
            SELECT *, {_by_encoding(lambda a: len(a))} AS size, {_by_encoding(lambda a: f"list_transform(string_split(token, ''), lambda c: strpos('{a}', c) - 1 - {(len(a) - 1) / 2})")} AS v
            FROM coded WHERE code IS NOT NULL
        ), tested AS MATERIALIZED (
            SELECT *, {_by_encoding(_uniform)} AS uniform,
                (2 * len(list_filter(range(1, n), lambda i: v[i] * v[i + 1] < 0)) - (n - 1)) / sqrt(n - 1) AS runs,
                list_sum(list_transform(range(1, n), lambda i: v[i] * v[i + 1])) / ((size * size - 1) / 12 * sqrt(n - 1)) AS serial
            FROM valued
        ), scored AS MATERIALIZED (
            SELECT token, code * {len(LENGTHS)} + {_CLASS} AS stratum, exp({_LOGS}) * (1 - ({_LOGS}) + ({_LOGS}) ** 2 / 2) AS p FROM tested
        ), binned AS (
            SELECT stratum, least(floor(p * 100), 99)::INT AS bin, count(*) AS rows FROM scored GROUP BY ALL
        ), kept AS (
            SELECT stratum, edge, sum(rows) FILTER (bin >= edge) AS kept, sum(rows) FILTER (bin >= 50) AS half
            FROM binned, (SELECT unnest(range(1, 51)) AS edge) GROUP BY ALL
        ), least AS (
            SELECT stratum, min(edge) / 100 AS least FROM kept WHERE half > 0 AND 1 - (1 - edge / 100) * 2 * half / kept <= 0.1 GROUP BY stratum
        ), random AS (
            SELECT row_id, list(struct_pack("start" := run."start", kind := 3, "end" := run."end")) AS random
            FROM runs JOIN scored ON token = run.found JOIN least USING (stratum)
            WHERE p >= least AND len(list_filter(base, lambda b: b."start" < run."end" AND b."end" > run."start")) = 0 GROUP BY row_id
        )
        SELECT doc_id, len(list_filter(base, lambda x: x.kind = 0))::BIGINT AS n_assign, len(list_filter(base, lambda x: x.kind = 1))::BIGINT AS n_access,
            len(list_filter(base, lambda x: x.kind = 2))::BIGINT AS n_hex, sha256({_listed("base")}) AS base_sha256,
            {_listed("list_sort(list_concat(base, coalesce(random, [])))")} AS spans
        FROM docs JOIN spans USING (row_id) LEFT JOIN random USING (row_id)
    """,
}

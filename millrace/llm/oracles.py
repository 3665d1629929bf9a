"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from millrace.llm import mixing, secrets


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _op4() -> str:
    hits = []
    for rank, (_, pattern, group, _) in enumerate(secrets.KINDS):
        p = _quoted(pattern)
        hits.append(
            f"SELECT rid, {rank} AS rank, unnest(range(len(b))) AS pos, unnest(list_transform(a[1:len(b)], lambda x: length(x))) AS gap, unnest(list_transform(b, lambda x: length(x))) AS len, "
            f"unnest(list_transform(c, lambda x: length(x))) AS part, unnest(list_transform(b, lambda x: regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[a-z]') AND regexp_matches(x, '[0-9]'))) AS mixed "
            f"FROM (SELECT rid, string_split_regex(text, {p}) AS a, regexp_extract_all(text, {p}, 0) AS b, regexp_extract_all(text, {p}, {group}) AS c, ident, acc, ends FROM d) WHERE len(b) > 0"
            + (" AND (ident OR acc OR ends)" if rank == 4 else "")
        )
    enough = " OR ".join(f"(rank = {i} AND part >= {least})" for i, (_, _, _, least) in enumerate(secrets.KINDS))
    names = "[" + ", ".join(_quoted(k) for k, *_ in secrets.KINDS) + "]"
    before, behind = "(PARTITION BY rid ORDER BY start RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "(PARTITION BY rid ORDER BY start RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    near = lambda ranks: (  # noqa: E731  the gap to a span of these kinds that starts before, or behind, is within the scope
        f"CASE WHEN coalesce(max(CASE WHEN rank IN {ranks} THEN \"end\" END) OVER {before}, -{2**40}) >= start - {secrets.SCOPE} "
        f"OR coalesce(min(CASE WHEN rank IN {ranks} THEN start END) OVER {behind}, {2**40}) <= \"end\" + {secrets.SCOPE} THEN 1 ELSE 0 END"
    )
    show = f"concat_ws(':', {names}[rank + 1], start, \"end\")"
    idents = " OR ".join(f"contains(lower(text), '{x}')" for x in ("user", "login", "client_id", "clientid", "account", "access_key", "accesskey"))
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, ({idents}) AS ident, contains(text, 'AKIA') AS acc,
                      contains(text, '://') OR regexp_matches(text, '[0-9]\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]') AS ends FROM documents),
    h AS ({' UNION ALL '.join(hits)}),
    p AS (SELECT *, sum(gap + len) OVER (PARTITION BY rid, rank ORDER BY pos) AS "end" FROM h),
    s AS (SELECT rid, rank, CAST("end" - len AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end" FROM p WHERE ({enough}) AND (rank <> 4 OR mixed)),
    l AS (SELECT *, {near("(0, 2, 4)")} AS secret, {near("(1, 3, 5)")} AS other,
                 coalesce(max(CASE WHEN rank < 3 THEN "end" END) OVER {before}, -1) > start AS inside,
                 coalesce(min(CASE WHEN rank < 3 THEN start END) OVER {behind}, 4611686018427387904) < "end" AS across FROM s),
    k AS (SELECT * FROM l WHERE rank < 3 OR (NOT inside AND NOT across AND CASE WHEN rank = 4 THEN other ELSE secret END = 1)),
    g AS (SELECT rid, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS b, count(*) FILTER (rank = 2) AS c,
                 string_agg({show}, ',' ORDER BY start, rank, "end") FILTER (rank < 3) AS base, string_agg({show}, ',' ORDER BY start, rank, "end") AS spans FROM k GROUP BY rid)
    SELECT doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(b, 0) AS BIGINT) AS n_access, CAST(coalesce(c, 0) AS BIGINT) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)
    """


def _op6() -> str:
    seed, last = mixing.SEED, mixing.TABLE - 1
    number = lambda digits, expr: f"CAST('0x' || substr(md5({expr}), 1, {digits}) AS BIGINT)"
    name = "concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', md5(coalesce(text, '')))"
    return f"""
    WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
    r AS (SELECT source, pow(n, {mixing.POWER}) / (SELECT sum(pow(n, {mixing.POWER})) FROM c) * (SELECT sum(n) FROM c) / n AS rate FROM c),
    m AS (SELECT source, rate, greatest(1, CAST(ceil(rate / {mixing.CHUNK}) AS BIGINT)) AS chunks FROM r),
    t AS (SELECT source, k, sum(exp(-rate / chunks + k * ln(rate / chunks) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM m, range(0, {last + 1}) AS x(k)),
    e AS (SELECT source, list(cdf ORDER BY k) AS cdf FROM t GROUP BY source),
    d AS (SELECT d.*, m.rate, m.chunks, e.cdf FROM documents d JOIN m ON d.source IS NOT DISTINCT FROM m.source JOIN e ON d.source IS NOT DISTINCT FROM e.source),
    n AS (SELECT *, list_sum(list_transform(range(0, chunks), lambda j: len(list_filter(cdf, lambda x: x < ({number(13, f"concat('{seed}:poisson:', {name}, ':', j)")} + 0.5) / 4503599627370496.0)))) AS reps FROM d)
    SELECT doc_id, text, lang, source, n_chars, CAST(copy_no AS INTEGER) AS copy_no, round(rate, 6) AS rate,
           {number(15, f"concat('{seed}:shuffle:', {name}, ':', copy_no)")} AS shuffle_key
    FROM (SELECT *, unnest(range(1, CAST(reps AS BIGINT) + 1)) AS copy_no FROM n)
    """


def _op7() -> str:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    digit = f"substr('{letters}', ((CAST('0x' || substr(h, (5 * i) // 4 + 1, 2) AS INTEGER) >> CAST(3 - (5 * i) % 4 AS INTEGER)) & 31) + 1, 1)"
    return f"""
    WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
    o AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS owner FROM p)
    SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: {digit}), '') AS payload_digest,
           CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> owner THEN owner END AS refers_to, url, true AS intact FROM o
    """


def _op1() -> str:
    """The blocks below ``article``, cut at its headings and paragraphs.

    Right for the layout that all pages of the table share, which the operator
    doesn't know: it is trained on pages of its own.
    """
    decoded = "regexp_replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;?', '&', 'g')"
    block = f"regexp_replace(regexp_replace({decoded}, '\\s+', ' ', 'g'), '^ | $', '', 'g')"
    return f"""
    WITH a AS (SELECT page_id, url, replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?b>', '', 'g'), '<br>', ' ') AS inside FROM pages),
    b AS (SELECT page_id, url, list_filter(list_transform(string_split_regex(inside, '</?(h1|p)>'), lambda x: {block}), lambda x: x <> '') AS blocks FROM a),
    t AS (SELECT page_id, url, array_to_string(blocks, chr(10)) AS text, len(blocks) AS n_blocks FROM b)
    SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars, CAST(n_blocks AS INTEGER) AS n_blocks FROM t
    """


def oracle_sql() -> dict[str, str]:
    return {"op1_html_extraction": _op1(), "op4_secret_scan": _op4(), "op6_source_mixing": _op6(), "op7_warc": _op7()}

"""DuckDB SQL for each query of :mod:`siftmark.queries`, on the same tables.

Each query is written from shared pieces: `img` has payloads as blobs, `byt` a row a byte, and so on;
none of it shares a formula with the Spark code beyond the definitions themselves.
"""

from __future__ import annotations

IMG = "img AS (SELECT doc_id AS image_id, encode(coalesce(text, '')) AS data FROM documents), siz AS (SELECT image_id, octet_length(data) AS n FROM img), prs AS (SELECT a.image_id AS pair_id, a.image_id AS a_id, b.image_id AS b_id FROM img a JOIN img b ON b.image_id = a.image_id + 1)"
BYT = IMG + ", byt AS (SELECT image_id, i - 1 AS pos, ('0x' || h)::INTEGER AS b FROM (SELECT image_id, unnest(l) AS h, generate_subscripts(l, 1) AS i FROM (SELECT image_id, regexp_extract_all(hex(data), '..') AS l FROM img)))"
TWO64 = "18446744073709551616::UHUGEINT"
GEAR = f"""
    g0 AS (SELECT i, ((11400714819323198485::UHUGEINT + (i + 1)::UHUGEINT * 11400714819323198485::UHUGEINT) % {TWO64})::UBIGINT AS x FROM range(256) r(i)),
    g1 AS (SELECT i, ((xor(x, x >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT) % {TWO64})::UBIGINT AS x FROM g0),
    g2 AS (SELECT i, ((xor(x, x >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) % {TWO64})::UBIGINT AS x FROM g1),
    gear AS (SELECT i::INTEGER AS i, xor(x, x >> 31) AS x FROM g2)"""
# least 64, largest 256, six mask bits
CHUNKS = f"""RECURSIVE {BYT}, {GEAR},
    low AS (SELECT image_id, pos, (x & 63)::BIGINT AS g FROM byt JOIN gear ON b = i),
    hsh AS (SELECT image_id, pos, g + 2 * coalesce(lag(g, 1) OVER w, 0) + 4 * coalesce(lag(g, 2) OVER w, 0) + 8 * coalesce(lag(g, 3) OVER w, 0)
                   + 16 * coalesce(lag(g, 4) OVER w, 0) + 32 * coalesce(lag(g, 5) OVER w, 0) AS h FROM low WINDOW w AS (PARTITION BY image_id ORDER BY pos)),
    cnd AS (SELECT image_id, list(pos ORDER BY pos) AS c FROM hsh WHERE h % 64 = 0 GROUP BY image_id),
    src AS (SELECT image_id, n, coalesce(c, []) AS c FROM siz LEFT JOIN cnd USING (image_id) WHERE n > 0),
    cut AS (SELECT image_id, 0::BIGINT AS s, least(coalesce(list_min(list_filter(c, lambda x: x >= 63)), n), 255, n - 1)::BIGINT AS e FROM src
            UNION ALL
            SELECT cut.image_id, e + 1, least(coalesce(list_min(list_filter(c, lambda x: x >= e + 64)), n), e + 256, n - 1)::BIGINT
            FROM cut JOIN src USING (image_id) WHERE e + 1 < n),
    chk AS (SELECT image_id, s AS "offset", (e - s + 1)::INTEGER AS length, sha256(data[s + 1 : e + 1]) AS chunk_key FROM cut JOIN img USING (image_id))"""
SIDED = """
    sid AS (SELECT pair_id, 'a' AS side, "offset", length, chunk_key FROM prs JOIN chk ON a_id = image_id
            UNION ALL SELECT pair_id, 'b', "offset", length, chunk_key FROM prs JOIN chk ON b_id = image_id),
    spn AS (SELECT pair_id, side, "offset", length, chunk_key, bool_or(side = 'a') OVER w AND bool_or(side = 'b') OVER w AS shared
            FROM sid WINDOW w AS (PARTITION BY pair_id, chunk_key))"""
JACCARD = """
    key AS (SELECT pair_id, chunk_key, count_if(side = 'a') AS na, count_if(side = 'b') AS nb FROM sid GROUP BY ALL),
    jac AS (SELECT pair_id, count_if(na > 0 AND nb > 0)::BIGINT AS common, count_if(nb = 0)::BIGINT AS only_a, count_if(na = 0)::BIGINT AS only_b, sum(na)::BIGINT AS total_a, sum(nb)::BIGINT AS total_b
            FROM key GROUP BY pair_id),
    bdf AS (SELECT pair_id, coalesce(common, 0) AS common, coalesce(only_a, 0) AS only_a, coalesce(only_b, 0) AS only_b, coalesce(total_a, 0) AS total_a, coalesce(total_b, 0) AS total_b,
                   CASE WHEN common + only_a + only_b > 0 THEN 100.0::DOUBLE * common / (common + only_a + only_b) ELSE 100 END AS jaccard_percent
            FROM prs LEFT JOIN jac USING (pair_id))"""
HIST = "hst AS (SELECT image_id, b AS byte, count(*) AS cnt FROM byt GROUP BY ALL), nrm AS (SELECT image_id, sqrt(sum(cnt::DOUBLE * cnt)) AS norm FROM hst GROUP BY 1)"
COSINE = """
    dts AS (SELECT pair_id, sum(x.cnt::DOUBLE * y.cnt) AS d FROM prs JOIN hst x ON x.image_id = a_id JOIN hst y ON y.image_id = b_id AND y.byte = x.byte GROUP BY 1),
    cos AS (SELECT pair_id, CASE WHEN p.n = 0 AND q.n = 0 THEN 100.0 ELSE least(1.0, coalesce(d / (u.norm * v.norm), 0)) * 100 END AS cosine_percent
            FROM prs JOIN siz p ON p.image_id = a_id JOIN siz q ON q.image_id = b_id LEFT JOIN dts USING (pair_id) LEFT JOIN nrm u ON u.image_id = a_id LEFT JOIN nrm v ON v.image_id = b_id)"""


def _fnv_steps(k: int) -> str:
    """The FNV-1a fold over up to k bytes b, b1 .. as nested expressions."""
    h = "((xor(14695981039346656037::HUGEINT, b::HUGEINT) * 1099511628211) % 18446744073709551616::HUGEINT)"
    steps, columns = [f"h0 AS (SELECT *, {h} AS f FROM wnd)"], k
    for j in range(1, columns):
        steps.append(f"h{j} AS (SELECT * EXCLUDE (f), CASE WHEN b{j} IS NULL THEN f ELSE (xor(f, b{j}::HUGEINT) * 1099511628211) % 18446744073709551616::HUGEINT END AS f FROM h{j - 1})")
    return ", ".join(steps)


SKETCH = f"""{BYT},
    wnd AS (SELECT image_id, pos, b, {', '.join(f'lead(b, {j}) OVER w AS b{j}' for j in range(1, 8))} FROM byt WINDOW w AS (PARTITION BY image_id ORDER BY pos)),
    {_fnv_steps(8)},
    shg AS (SELECT DISTINCT image_id, f FROM h7 JOIN siz USING (image_id) WHERE pos = 0 OR pos <= n - 8),
    skt AS (SELECT image_id, f, lpad(lower(to_hex(f::UBIGINT)), 16, '0') AS hash FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY f) AS r FROM shg) WHERE r <= 128)"""
MINHASH = """
    uni AS (SELECT pair_id, f, bool_or(s = 'a') AND bool_or(s = 'b') AS bth
            FROM (SELECT pair_id, f, 'a' AS s FROM prs JOIN skt ON a_id = image_id UNION ALL SELECT pair_id, f, 'b' FROM prs JOIN skt ON b_id = image_id) GROUP BY ALL),
    top AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY f) AS r FROM uni),
    sim AS (SELECT pair_id, avg(bth::INTEGER) * 100 AS s FROM top WHERE r <= 128 GROUP BY 1),
    mnh AS (SELECT pair_id, CASE WHEN p.n = 0 AND q.n = 0 THEN 100.0 WHEN p.n = 0 OR q.n = 0 THEN 0 ELSE s END AS minhash_percent
            FROM prs JOIN siz p ON p.image_id = a_id JOIN siz q ON q.image_id = b_id LEFT JOIN sim USING (pair_id))"""
_LAGS = ", ".join(f"coalesce(lag(b, {a}) OVER w, 0)::BIGINT AS c{a}" for a in range(1, 7))
_ROLL = (
    "(" + " + ".join(["b", *[f"c{a}" for a in range(1, 7)]]) + ") + (" + " + ".join(["7 * b", *[f"{7 - a} * c{a}" for a in range(1, 7)]]) + ")"
)
_XOR = "b::BIGINT"
for _a in range(1, 7):
    _XOR = f"xor({_XOR}, (c{_a} << {5 * _a}) & 4294967295)"


def _digest(name: str, factor: int) -> str:
    return f"""
    t{name} AS (SELECT image_id, pos, b, (pos >= 6 AND roll % ({factor} * bs) = {factor} * bs - 1)::INTEGER AS hit FROM rol),
    p{name} AS (SELECT image_id, pos, b, coalesce(sum(hit) OVER (PARTITION BY image_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS piece FROM t{name}),
    l{name} AS (SELECT image_id, piece, list_reduce(list_prepend(37, list(b & 63 ORDER BY pos)), lambda t, x: (xor(t, x) * 51) & 63) AS v FROM p{name} WHERE piece < 64 GROUP BY ALL),
    d{name} AS (SELECT image_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/', v + 1, 1), '' ORDER BY piece) AS s FROM l{name} GROUP BY 1)"""


DIGEST = f"""{BYT},
    blk AS (SELECT image_id, n, 3 * (2 ** floor(log2(n // 64 + 1 + 0.000001)))::BIGINT AS bs FROM siz),
    lgs AS (SELECT image_id, pos, b, {_LAGS} FROM byt WINDOW w AS (PARTITION BY image_id ORDER BY pos)),
    rol AS (SELECT image_id, pos, b, bs, ({_ROLL} + {_XOR}) & 4294967295 AS roll FROM lgs JOIN blk USING (image_id)),
    {_digest('1', 1)}, {_digest('2', 2)},
    dig AS (SELECT image_id, CASE WHEN n = 0 THEN '0::' ELSE bs || ':' || coalesce(d1.s, '') || ':' || coalesce(d2.s, '') END AS digest,
                   CASE WHEN n = 0 THEN 0 ELSE bs END AS bs, coalesce(d1.s, '') AS x, coalesce(d2.s, '') AS y FROM blk LEFT JOIN d1 USING (image_id) LEFT JOIN d2 USING (image_id))"""
BLOCKS = f"""{BYT},
    cts AS (SELECT image_id, (pos // 256)::INTEGER AS block, b, count(*) AS c FROM byt GROUP BY ALL),
    ent AS (SELECT image_id, block, coalesce(sum(-(c / t) * log2(c / t)), 0) AS h FROM (SELECT *, sum(c) OVER (PARTITION BY image_id, block)::DOUBLE AS t FROM cts) GROUP BY ALL),
    prf AS (SELECT image_id, list(h ORDER BY block) AS p FROM ent GROUP BY 1),
    pro AS (SELECT image_id, coalesce(p, []) AS p FROM img LEFT JOIN prf USING (image_id))"""


def _resampled(p: str, k: str) -> str:
    start = f"least((floor(i * (len({p})::DOUBLE / {k})))::BIGINT, len({p}) - 1)"
    end = f"least(greatest((floor((i + 1) * (len({p})::DOUBLE / {k})))::BIGINT, {start} + 1), len({p}))"
    return f"CASE WHEN len({p}) = {k} THEN {p} ELSE list_transform(range({k}), lambda i: list_avg({p}[{start} + 1 : {end}])) END"


PROFILE = f"""
    two AS (SELECT pair_id, x.p AS p, y.p AS q, least(len(x.p), len(y.p), 512) AS k FROM prs JOIN pro x ON x.image_id = a_id JOIN pro y ON y.image_id = b_id),
    rsm AS (SELECT *, CASE WHEN k > 0 THEN {_resampled('p', 'k')} ELSE [] END AS u, CASE WHEN k > 0 THEN {_resampled('q', 'k')} ELSE [] END AS v FROM two),
    psm AS (SELECT pair_id, CASE WHEN len(p) = 0 AND len(q) = 0 THEN 100.0 WHEN k = 0 THEN 0
                   ELSE greatest(0, least(100, 100 * (1 - list_sum(list_transform(list_zip(u, v), lambda z: abs(z[1] - z[2]))) / k / 8))) END AS similarity FROM rsm)"""


def _grams(length: int) -> str:
    parts = " || ".join(["h", *[f"lead(h, {j}) OVER w" for j in range(1, length)]])
    return f"""{IMG},
    hxs AS (SELECT image_id, i - 1 AS pos, h FROM (SELECT image_id, unnest(l) AS h, generate_subscripts(l, 1) AS i FROM (SELECT image_id, regexp_extract_all(hex(data), '..') AS l FROM img))),
    win AS (SELECT image_id, pos, {parts} AS hex FROM hxs WINDOW w AS (PARTITION BY image_id ORDER BY pos)),
    grm AS (SELECT image_id, hex, count(*) AS cnt, min(pos) AS first_offset FROM win WHERE hex IS NOT NULL GROUP BY ALL)"""


GRAM_PAIRS = """
    ga AS (SELECT pair_id, hex, cnt, first_offset FROM prs JOIN grm ON a_id = image_id), gb AS (SELECT pair_id, hex, cnt, first_offset FROM prs JOIN grm ON b_id = image_id),
    met AS (SELECT coalesce(ga.pair_id, gb.pair_id) AS pair_id, coalesce(ga.hex, gb.hex) AS hex, ga.cnt AS ca, gb.cnt AS cb, ga.first_offset AS fa, gb.first_offset AS fb
            FROM ga FULL JOIN gb ON ga.pair_id = gb.pair_id AND ga.hex = gb.hex),
    gjc AS (SELECT pair_id, count_if(ca IS NOT NULL AND cb IS NOT NULL)::BIGINT AS common, count(*) AS n_union FROM met GROUP BY 1)"""
GRAM_SCORE = """
    gsc AS (SELECT pair_id, CASE WHEN x.n < {L} AND y.n < {L} THEN CASE WHEN u.data = v.data THEN 100.0 ELSE 0 END WHEN x.n < {L} OR y.n < {L} THEN 0
                   ELSE 100.0::DOUBLE * common / n_union END AS similarity
            FROM prs JOIN siz x ON x.image_id = a_id JOIN siz y ON y.image_id = b_id JOIN img u ON u.image_id = a_id JOIN img v ON v.image_id = b_id LEFT JOIN gjc USING (pair_id))"""


def _without_img(sql: str) -> str:
    return sql.removeprefix("RECURSIVE ").removeprefix(BYT).removeprefix(IMG).lstrip().removeprefix(",")


#: All modules of neighbouring documents; Format has no score for text.
MODULES = f"""{CHUNKS}, {SIDED}, {JACCARD}, {_without_img(SKETCH)}, {MINHASH}, {_without_img(BLOCKS)}, {PROFILE}, {_without_img(_grams(16))}, {GRAM_PAIRS}, {GRAM_SCORE.format(L=16)},
    mds AS (SELECT pair_id, jaccard_percent AS bd, minhash_percent AS fz, psm.similarity AS en, gsc.similarity AS pt
            FROM bdf JOIN mnh USING (pair_id) JOIN psm USING (pair_id) JOIN gsc USING (pair_id))"""

PE_HEAD = "4D5A" + "00" * 58 + "80000000" + "00" * 64 + "50450000" + "64860100" + "00105E5F" + "00" * 8 + "70002200" + "0B01" + "00" * 14 + "00100000" + "00" * 48 + "0300" + "00" * 42
PE_SECTION = "2E74657874000000" + "00020000" + "00100000" + "00020000" + "A0010000" + "00" * 12 + "20000060"
EXE = f"""exe AS (SELECT doc_id AS image_id, CASE WHEN doc_id % 5 = 0 THEN 'Unknown' WHEN doc_id % 2 = 0 THEN 'PE' ELSE 'ELF' END AS format,
                       (unhex('{PE_HEAD + PE_SECTION}') || encode(coalesce(text, '')))[417:928] AS body FROM documents),
    sec AS (SELECT image_id, body, CASE WHEN octet_length(body) > 0 THEN upper(sha256(body)) ELSE '' END AS sha FROM exe WHERE format = 'PE'),
    sby AS (SELECT image_id, h, count(*) AS c FROM (SELECT image_id, unnest(regexp_extract_all(hex(body), '..')) AS h FROM sec) GROUP BY ALL),
    sen AS (SELECT image_id, sum(-(c / t) * log2(c / t)) AS e, sqrt(any_value(q)) AS norm FROM (SELECT *, sum(c) OVER w::DOUBLE AS t, sum(c::DOUBLE * c) OVER w AS q FROM sby WINDOW w AS (PARTITION BY image_id)) GROUP BY 1),
    xpr AS (SELECT a.image_id AS pair_id, a.image_id AS a_id, b.image_id AS b_id, a.format AS fa, b.format AS fb FROM exe a JOIN exe b ON b.image_id = a.image_id + 4)"""


def _with(parts: str, select: str) -> str:
    return f"WITH {parts}\n{select}"


IMPORT_LISTS = "imp(k, imp) AS (VALUES (0, ['KERNEL32.DLL', 'USER32.DLL']), (1, ['WS2_32.DLL', 'KERNEL32.DLL', 'ADVAPI32.DLL']), (2, []::VARCHAR[]), (3, ['CRYPT32.DLL']))"
NUMBER = "regexp_replace(printf('%.3f', {0}), '\\.?0+$', '')"


def _stats(x: str) -> str:
    """A profile's mean, maximum and share of blocks of 7 bits or more, as text."""
    share = f"CASE WHEN len({x}) > 0 THEN len(list_filter({x}, lambda v: v >= 7)) / len({x}) ELSE 0 END * 100"
    return f"{NUMBER.format(f'coalesce(list_avg({x}), 0)')}, {NUMBER.format(f'coalesce(list_max({x}), 0)')}, {NUMBER.format(share)}"


ORACLES: dict[str, str] = {
    "s2_image_bytes": "SELECT page_id, octet_length(encode(coalesce(html, ''))) AS size, md5(encode(coalesce(html, ''))) AS md5 FROM pages",
    "s3_image_info": """SELECT doc_id AS image_id, 'doc/' || doc_id AS path, doc_id::VARCHAR AS name, octet_length(encode(coalesce(text, ''))) AS size,
        upper(sha256(encode(coalesce(text, '')))) AS sha256 FROM documents""",
    "s4_size_warning": _with(IMG, """SELECT pair_id, concat_ws('|',
        CASE WHEN x.n > 4000 THEN 'File A is large (' || format('{:,}', x.n) || ' bytes); analysis may take time.' END,
        CASE WHEN y.n > 4000 THEN 'File B is large (' || format('{:,}', y.n) || ' bytes); analysis may take time.' END) AS warnings
        FROM prs JOIN siz x ON x.image_id = a_id JOIN siz y ON y.image_id = b_id"""),
    "b1_gear_table": _with(GEAR, "SELECT i, lpad(lower(to_hex(x)), 16, '0') AS gear FROM gear"),
    "b2_chunks": _with(CHUNKS, 'SELECT image_id, "offset", length, chunk_key FROM chk'),
    "b5_chunk_jaccard": _with(f"{CHUNKS}, {SIDED}, {JACCARD}", "SELECT * REPLACE (round(jaccard_percent, 6) AS jaccard_percent) FROM bdf"),
    "b6_diff_map": _with(f"{CHUNKS}, {SIDED}", 'SELECT pair_id, side, "offset", length, shared FROM spn'),
    "b7_byte_hist": _with(f"{BYT}, {HIST}", "SELECT image_id, byte, cnt FROM hst"),
    "b8_hist_cosine": _with(f"{BYT}, {HIST}, {COSINE}", "SELECT pair_id, round(cosine_percent, 6) AS cosine_percent FROM cos"),
    "z3_sketch": _with(SKETCH, "SELECT image_id, hash FROM skt"),
    "z4_minhash": _with(f"{SKETCH}, {MINHASH}", "SELECT pair_id, round(minhash_percent, 6) AS minhash_percent FROM mnh"),
    "z5_block_size": _with(IMG, "SELECT image_id, 3 * list_max(list_filter(list_transform(range(0, 40), lambda k: 1::BIGINT << k), lambda p: p <= n // 64 + 1)) AS block_size FROM siz"),
    "z8_ctph_digest": _with(DIGEST, "SELECT image_id, digest FROM dig"),
    "z9_ctph_score": _with(DIGEST, """SELECT pair_id, round(CASE WHEN u.bs = 0 AND v.bs = 0 THEN 100 WHEN u.bs = 0 OR v.bs = 0 THEN 0 WHEN p IS NULL THEN 0
        WHEN greatest(length(p), length(q)) = 0 THEN 100 ELSE (1 - levenshtein(p, q) / greatest(length(p), length(q))) * 100 END, 6)::DOUBLE AS ctph_percent
        FROM (SELECT pair_id, u, v, CASE WHEN u.bs = v.bs OR u.bs = 2 * v.bs THEN u.x WHEN v.bs = 2 * u.bs THEN u.y END AS p,
                     CASE WHEN u.bs = v.bs OR v.bs = 2 * u.bs THEN v.x WHEN u.bs = 2 * v.bs THEN v.y END AS q
              FROM prs JOIN dig u ON u.image_id = a_id JOIN dig v ON v.image_id = b_id)"""),
    "e1_entropy": _with(f"{BYT}, {HIST}", """SELECT image_id, round(coalesce(e, 0), 6) AS entropy FROM img LEFT JOIN (
        SELECT image_id, sum(-(cnt / n) * log2(cnt / n)) AS e FROM hst JOIN siz USING (image_id) GROUP BY 1) USING (image_id)"""),
    "e2_block_entropy": _with(BLOCKS, "SELECT image_id, block, round(h, 6) AS entropy FROM ent"),
    "e3_downsample": _with(BLOCKS, f"""SELECT image_id, (generate_subscripts(r, 1) - 1)::INTEGER AS point, round(unnest(r), 6) AS value
        FROM (SELECT image_id, CASE WHEN len(p) > 11 THEN {_resampled('p', '11')} ELSE p END AS r FROM pro)"""),
    "e5_profile_stats": _with(BLOCKS, """SELECT image_id, round(coalesce(list_avg(p), 0), 6) AS mean, round(coalesce(list_max(p), 0), 6) AS max,
        round(CASE WHEN len(p) > 0 THEN len(list_filter(p, lambda x: x >= 4)) / len(p) ELSE 0 END, 6) AS high FROM pro"""),
    "e6_profile_similarity": _with(f"{BLOCKS}, {PROFILE}", "SELECT pair_id, round(similarity, 6) AS similarity FROM psm"),
    "p1_grams": _with(_grams(16), "SELECT image_id, hex, cnt, first_offset FROM grm"),
    "p4_gram_jaccard": _with(f"{_grams(16)}, {GRAM_PAIRS}", """SELECT pair_id, coalesce(common, 0) AS common, coalesce(n_union, 0) AS n_union,
        round(CASE WHEN n_union > 0 THEN 100.0::DOUBLE * common / n_union ELSE 100 END, 6) AS jaccard_percent FROM prs LEFT JOIN gjc USING (pair_id)"""),
    "p5_common_top": _with(f"{_grams(16)}, {GRAM_PAIRS}", """SELECT pair_id, rank::INTEGER AS rank, hex, ca AS count_a, cb AS count_b, fa AS first_offset_a, fb AS first_offset_b
        FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY least(ca, cb) DESC, hex) AS rank FROM met WHERE ca IS NOT NULL AND cb IS NOT NULL) WHERE rank <= 50"""),
    "p6_unique_top": _with(f"{_grams(16)}, {GRAM_PAIRS}", """SELECT pair_id, list, rank::INTEGER AS rank, hex, coalesce(ca, 0) AS count_a, coalesce(cb, 0) AS count_b,
        coalesce(fa, -1) AS first_offset_a, coalesce(fb, -1) AS first_offset_b
        FROM (SELECT *, CASE WHEN cb IS NULL THEN 'a' ELSE 'b' END AS list, row_number() OVER (PARTITION BY pair_id, cb IS NULL ORDER BY coalesce(ca, cb) DESC, hex) AS rank
              FROM met WHERE (ca IS NULL OR cb IS NULL) AND coalesce(ca, cb) >= 2) WHERE rank <= 50"""),
    "p7_pattern_score": _with(f"{_grams(64)}, {GRAM_PAIRS}, {GRAM_SCORE.format(L=64)}", "SELECT pair_id, round(similarity, 6) AS similarity FROM gsc"),
    "p11_hex_spaced": _with(IMG, "SELECT image_id, trim(regexp_replace(hex(data), '(..)', '\\1 ', 'g')) AS hex FROM img"),
    "f1_magic": _with(EXE, "SELECT image_id, format FROM exe"),
    "f2_headers": _with(EXE, """SELECT image_id, CASE format WHEN 'PE' THEN 'x64' WHEN 'ELF' THEN 'x86-64' ELSE '' END AS machine,
        CASE format WHEN 'PE' THEN strftime(to_timestamp(1600000000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') ELSE '' END AS time_stamp,
        CASE format WHEN 'PE' THEN 'Console' WHEN 'ELF' THEN 'EXEC' ELSE '' END AS subsystem,
        CASE format WHEN 'PE' THEN '0x1000' WHEN 'ELF' THEN '0x401000' ELSE '' END AS entry_point, CASE format WHEN 'PE' THEN 1 ELSE 0 END AS n_sections FROM exe"""),
    "f3_sections": _with(EXE, """SELECT image_id, 0 AS section_idx, '.text' AS name, 512::BIGINT AS virtual_size, 512::BIGINT AS raw_size,
        round(coalesce(e, 0), 6) AS entropy, sha AS sha256, 'R-X' AS flags FROM sec LEFT JOIN sen USING (image_id)"""),
    "f9_section_compare": _with(EXE, """, dts AS (SELECT pair_id, sum(x.c::DOUBLE * y.c) AS d FROM xpr JOIN sby x ON x.image_id = a_id JOIN sby y ON y.image_id = b_id AND y.h = x.h GROUP BY 1)
        SELECT pair_id, '.text' AS name, fa = 'PE' AS in_a, fb = 'PE' AS in_b, round(CASE WHEN fa = 'PE' AND fb = 'PE' THEN
            CASE WHEN s.sha <> '' AND s.sha = t.sha THEN 100 ELSE least(1, coalesce(d / (u.norm * v.norm), 0)) * 100 END END, 6)::DOUBLE AS similarity
        FROM xpr LEFT JOIN sec s ON s.image_id = a_id LEFT JOIN sec t ON t.image_id = b_id LEFT JOIN sen u ON u.image_id = a_id LEFT JOIN sen v ON v.image_id = b_id
        LEFT JOIN dts USING (pair_id) WHERE fa = 'PE' OR fb = 'PE'""").replace("\n, dts", ", dts"),
    "f5_imports": _with(IMPORT_LISTS, """SELECT doc_id AS image_id, 'PE' AS format, '0x1234' AS entry_point, array_to_string(imp, ',') AS imports FROM documents JOIN imp ON k = doc_id % 4"""),
    "f7_elf_sections": """WITH s(k, section_idx, name, kind, body) AS (VALUES
            (0, 0, '', 'NULL', ''::BLOB), (0, 1, '.text', 'PROGBITS', repeat('\\x90', 48)::BLOB), (0, 2, '.bss', 'NOBITS', repeat('\\x00', 100)::BLOB), (0, 3, '.shstrtab', 'STRTAB', '\\x00.text\\x00.bss\\x00.shstrtab\\x00'::BLOB),
            (1, 0, '', 'NULL', ''::BLOB), (1, 1, '.rodata', 'PROGBITS', 'const'::BLOB), (1, 2, '.symtab', 'SYMTAB', repeat('\\x00', 24)::BLOB), (1, 3, '.odd', '0x6FFFFFF6', 'x'::BLOB),
            (1, 4, '.shstrtab', 'STRTAB', '\\x00.rodata\\x00.symtab\\x00.odd\\x00.shstrtab\\x00'::BLOB))
        SELECT doc_id AS image_id, section_idx, name, octet_length(body) AS virtual_size, CASE kind WHEN 'NOBITS' THEN 0 ELSE octet_length(body) END AS raw_size,
               CASE WHEN kind = 'NOBITS' OR octet_length(body) = 0 THEN '' ELSE upper(sha256(body)) END AS sha256, kind AS flags FROM documents JOIN s ON k = doc_id % 2""",
    "f11_import_sets": _with(f"{IMG}, {IMPORT_LISTS}", """SELECT pair_id, array_to_string(list_sort(list_intersect(a.imp, b.imp)), ',') AS common,
               array_to_string(list_sort(list_filter(a.imp, lambda x: NOT list_contains(b.imp, x))), ',') AS only_a, array_to_string(list_sort(list_filter(b.imp, lambda x: NOT list_contains(a.imp, x))), ',') AS only_b,
               round((100 + 100 * len(list_intersect(a.imp, b.imp)) / len(list_distinct(list_concat(a.imp, b.imp)))) / 2, 6)::DOUBLE AS similarity
        FROM prs JOIN imp a ON a.k = a_id % 4 JOIN imp b ON b.k = b_id % 4"""),
    "f13_format_score": _with(EXE, """SELECT pair_id, CASE WHEN fa = 'Unknown' AND fb = 'Unknown' THEN NULL WHEN (fa = 'PE') = (fb = 'PE') THEN 100.0::DOUBLE ELSE 0 END AS similarity FROM xpr"""),
    "a2_module_scores": _with(MODULES, """SELECT pair_id, module, module_ord::INTEGER AS module_ord, kind, title, round(similarity, 6) AS similarity FROM mds, LATERAL (VALUES
        ('ByteDiff', 0, 'byteDiff', 'Byte-Diff', bd), ('FuzzyHash', 1, 'fuzzyHash', 'Fuzzy-Hash', fz), ('Format', 2, 'format', 'Format (PE/ELF)', NULL::DOUBLE),
        ('Entropy', 3, 'entropy', 'Entropy', en), ('Patterns', 4, 'patterns', 'Patterns / signatures', pt)) v(module, module_ord, kind, title, similarity)"""),
    "a5_overall": _with(MODULES, "SELECT pair_id, round((bd + fz + 0.5 * en + 0.5 * pt) / 3, 6) AS overall FROM mds"),
    "a5_weighted_mean": """WITH s AS (SELECT l_orderkey AS pair_id, ['ByteDiff', 'FuzzyHash', 'Format', 'Entropy', 'Patterns', 'Other'][l_linenumber % 6 + 1] AS module,
            CASE WHEN l_linenumber <> 4 THEN l_quantity::DOUBLE END AS s, l_returnflag = 'R' AS failed FROM lineitem),
        w AS (SELECT *, CASE module WHEN 'ByteDiff' THEN 1.0 WHEN 'FuzzyHash' THEN 2.0 WHEN 'Patterns' THEN 0.5 WHEN 'Other' THEN 1.0 END::DOUBLE AS w FROM s)
        SELECT pair_id, round(coalesce(sum(w * s) FILTER (NOT failed AND s IS NOT NULL AND w IS NOT NULL) / sum(w) FILTER (NOT failed AND s IS NOT NULL AND w IS NOT NULL), 0), 6) AS overall FROM w GROUP BY 1""",
    "r1_json_fields": _with(f"{CHUNKS}, {SIDED}, {JACCARD}", """SELECT pair_id, a_id::VARCHAR AS name_a, n AS size_b, 'byteDiff' AS kind0, 3 AS module1, round(jaccard_percent, 6) AS similarity0,
        total_a AS chunks_a, 256::BIGINT AS block_size FROM bdf JOIN prs USING (pair_id) JOIN siz ON image_id = b_id"""),
    "r3_svg_points": _with(BLOCKS, """SELECT image_id, block AS point, round(block / greatest(max(block) OVER (PARTITION BY image_id), 1) * 600, 6)::DOUBLE AS x,
        round(120 - least(8, greatest(0, h)) / 8 * 120, 6) AS y FROM ent"""),
    "r4_diff_bar": _with(f"{CHUNKS}, {SIDED}", """SELECT pair_id, side, "offset", round(100.0 * length / sum(length) OVER (PARTITION BY pair_id, side), 6)::DOUBLE AS width_percent, shared FROM spn"""),
    "r7_text_bar": _with(f"{BLOCKS}, {PROFILE}", """SELECT pair_id, '[' || repeat('#', k) || repeat('.', 40 - k) || ']' AS bar
        FROM (SELECT pair_id, round_even(similarity / 100 * 40, 0)::INTEGER AS k FROM psm)"""),
    "r2_html": _with(MODULES, """SELECT pair_id, '<!doctype html>' AS head, printf('%.2f %%', round((bd + fz + 0.5 * en + 0.5 * pt) / 3, 2)) AS score,
        'Byte-Diff|Fuzzy-Hash|Format (PE/ELF)|Entropy|Patterns / signatures' AS sections, a_id || '|' || b_id AS files, upper(sha256(u.data)) || '|' || upper(sha256(v.data)) AS sha256
        FROM mds JOIN prs USING (pair_id) JOIN img u ON u.image_id = a_id JOIN img v ON v.image_id = b_id"""),
    "r5_format_table": _with(EXE, """, dts AS (SELECT pair_id, sum(x.c::DOUBLE * y.c) AS d FROM xpr JOIN sby x ON x.image_id = a_id JOIN sby y ON y.image_id = b_id AND y.h = x.h GROUP BY 1)
        SELECT pair_id, CASE WHEN fa = 'PE' AND fb = 'PE' THEN '.text,yes,yes,' || printf('%.1f %%', CASE WHEN s.sha <> '' AND s.sha = t.sha THEN 100 ELSE least(1, coalesce(d / (u.norm * v.norm), 0)) * 100 END)
                             WHEN fa = 'PE' THEN '.text,yes,no,n/a' WHEN fb = 'PE' THEN '.text,no,yes,n/a' ELSE '' END AS rows
        FROM xpr LEFT JOIN sec s ON s.image_id = a_id LEFT JOIN sec t ON t.image_id = b_id LEFT JOIN sen u ON u.image_id = a_id LEFT JOIN sen v ON v.image_id = b_id
        LEFT JOIN dts USING (pair_id)""").replace("\n, dts", ", dts"),
    "r6_pattern_tables": _with(f"{_grams(16)}, {GRAM_PAIRS}", """SELECT pair_id, count(hex)::INTEGER AS n_rows, md5(coalesce(string_agg(hex, ',' ORDER BY list, rank), '')) AS digest FROM prs LEFT JOIN (
        SELECT *, row_number() OVER (PARTITION BY pair_id, list ORDER BY least(ca, cb) DESC, hex) AS rank FROM (
            SELECT *, CASE WHEN ca IS NOT NULL AND cb IS NOT NULL THEN 0 WHEN ca >= 2 THEN 1 WHEN cb >= 2 THEN 2 END AS list FROM met) WHERE list IS NOT NULL
        QUALIFY rank <= 25) USING (pair_id) GROUP BY 1"""),
    "r8_fuzzy": _with(f"{SKETCH}, {MINHASH}, {_without_img(DIGEST)}", """, ctp AS (SELECT pair_id, u.digest AS da, v.digest AS db,
               CASE WHEN u.bs = 0 AND v.bs = 0 THEN 100 WHEN u.bs = 0 OR v.bs = 0 OR p IS NULL THEN 0 WHEN greatest(length(p), length(q)) = 0 THEN 100 ELSE (1 - levenshtein(p, q) / greatest(length(p), length(q))) * 100 END AS c
        FROM (SELECT pair_id, u, v, CASE WHEN u.bs = v.bs OR u.bs = 2 * v.bs THEN u.x WHEN v.bs = 2 * u.bs THEN u.y END AS p,
                     CASE WHEN u.bs = v.bs OR v.bs = 2 * u.bs THEN v.x WHEN u.bs = 2 * v.bs THEN v.y END AS q
              FROM prs JOIN dig u ON u.image_id = a_id JOIN dig v ON v.image_id = b_id))
        SELECT pair_id, k::INTEGER AS k, label, value FROM mnh JOIN ctp USING (pair_id), LATERAL (VALUES (0, 'MinHash similarity', printf('%.2f %%', round(minhash_percent, 2))),
            (1, 'CTPH similarity', printf('%.2f %%', round(c, 2))), (2, 'Shingle-k', '8'), (3, 'CTPH-Digest A', da), (4, 'CTPH-Digest B', db)) t(k, label, value)""").replace("\n, ctp", ", ctp"),
    "r8_entropy": _with(f"{BLOCKS}, {PROFILE}", f""", sts AS (SELECT pair_id, similarity, [{_stats('p')}] AS x, [{_stats('q')}] AS y FROM two JOIN psm USING (pair_id))
        SELECT pair_id, k::INTEGER AS k, label, value FROM sts, LATERAL (VALUES (0, 'Profile similarity', printf('%.2f %%', round(similarity, 2))), (1, 'Block size', '256'),
            (2, 'Mean entropy A / B', x[1] || ' / ' || y[1] || ' bit'), (3, 'Maximum entropy A / B', x[2] || ' / ' || y[2] || ' bit'),
            (4, 'High-entropy share A / B', x[3] || ' % / ' || y[3] || ' %')) t(k, label, value)""").replace("\n, sts", ", sts"),
    "r8_patterns": _with(f"{_grams(16)}, {GRAM_PAIRS}, {GRAM_SCORE.format(L=16)}", """, cnt AS (SELECT pair_id, least(50, count_if(ca IS NOT NULL AND cb IS NOT NULL)) AS c, least(50, count_if(cb IS NULL AND ca >= 2)) AS a, least(50, count_if(ca IS NULL AND cb >= 2)) AS b FROM met GROUP BY 1)
        SELECT pair_id, k::INTEGER AS k, label, value FROM gsc LEFT JOIN cnt USING (pair_id), LATERAL (VALUES (0, 'Signature length (bytes)', '16'), (1, 'Pattern overlap', printf('%.2f %%', round(similarity, 2))),
            (2, 'Shared patterns', coalesce(c, 0)::VARCHAR), (3, 'Only in A (indicators)', coalesce(a, 0)::VARCHAR), (4, 'Only in B (indicators)', coalesce(b, 0)::VARCHAR)) t(k, label, value)""").replace("\n, cnt", ", cnt"),
    "r8_format": _with(EXE, """SELECT pair_id, k::INTEGER AS k, label, value FROM xpr, LATERAL (VALUES (0, 'Format A / B', fa || ' / ' || fb),
            (1, 'Structural similarity', CASE WHEN fa = 'Unknown' AND fb = 'Unknown' THEN 'n/a' WHEN (fa = 'PE') = (fb = 'PE') THEN '100.00 %' ELSE '0.00 %' END),
            (2, 'Sections A / B', (fa = 'PE')::INTEGER || ' / ' || (fb = 'PE')::INTEGER), (3, 'Shared imports', '0'), (4, 'Imports only in A / B', '0 / 0')) t(k, label, value)
        WHERE k < 2 OR fa <> 'Unknown' OR fb <> 'Unknown'"""),
    "a4_error_rows": _with(f"{CHUNKS}, {SIDED}, {JACCARD}", """, wrd AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r\\x1c-\\x1f]+')) AS w, regexp_matches(coalesce(text, ''), '[^\\x00-\\x7f]') AS odd FROM documents)
        SELECT pair_id, 'ByteDiff' AS module, 'byteDiff' AS kind, 'Byte-Diff' AS title, round(jaccard_percent, 6) AS similarity, false AS failed, 'Similarity (Jaccard)' AS first_metric FROM bdf
        UNION ALL SELECT pair_id, 'Words', CASE WHEN x.odd OR y.odd THEN 'error' ELSE 'Words' END, CASE WHEN x.odd OR y.odd THEN 'Words (Error)' ELSE 'Words' END,
               round(CASE WHEN NOT (x.odd OR y.odd) THEN CASE WHEN greatest(x.w, y.w) = 0 THEN 100 ELSE 100 * least(x.w, y.w) / greatest(x.w, y.w) END END, 6), x.odd OR y.odd, CASE WHEN x.odd OR y.odd THEN 'Error' ELSE 'Words' END
        FROM prs JOIN wrd x ON x.doc_id = a_id JOIN wrd y ON y.doc_id = b_id""").replace("\n, wrd", ", wrd"),
    "a7_section_lookup": _with(f"{CHUNKS}, {SIDED}, {JACCARD}, {_without_img(BLOCKS)}", """SELECT pair_id, total_a AS chunks_a, round(coalesce(list_avg(x.p), 0), 6) AS mean_a, round(coalesce(list_max(y.p), 0), 6) AS max_b
        FROM bdf JOIN prs USING (pair_id) JOIN pro x ON x.image_id = a_id JOIN pro y ON y.image_id = b_id"""),
    "b10_ranges": """SELECT x, list_min(list_filter(list_transform(range(0, 31), lambda k: 1::BIGINT << k), lambda p: p >= least(x, 1 << 30))) AS power, least(100, greatest(0, (x - 500) / 4))::DOUBLE AS clamped
        FROM (SELECT unnest(list_concat(range(-2, 1030), [65535, 65536, 65537, 1 << 30, 8589934592])) AS x)""",
    "edge_rules": """SELECT pair_id, module, similarity::DOUBLE AS similarity FROM (VALUES ('none', 100, 100, 100, 100), ('one', 0, 0, 0, 0), ('other', 0, 0, 0, 0), ('same', 100, 100, 100, 100), ('tiny', 0, 0, 100, 0), ('null', 100, 100, 100, 100)) t(pair_id, b, f, e, p),
        LATERAL (VALUES ('ByteDiff', b), ('FuzzyHash', f), ('Format', NULL), ('Entropy', e), ('Patterns', p)) m(module, similarity)""",
    "p3_distinct_cap": _with(_grams(16), "SELECT image_id, hex, cnt, first_offset FROM grm QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY first_offset) <= 20"),
    "r8_metrics": _with(f"{CHUNKS}, {SIDED}, {JACCARD}, {HIST}, {COSINE}", """SELECT pair_id, k::INTEGER AS k, label, value FROM bdf JOIN cos USING (pair_id), LATERAL (VALUES
        (0, 'Similarity (Jaccard)', format('{:.2f} %', jaccard_percent)), (1, 'Byte-histogram cosine', format('{:.2f} %', cosine_percent)), (2, 'Shared chunks', format('{:,}', common)),
        (3, 'Only in A', format('{:,}', only_a)), (4, 'Only in B', format('{:,}', only_b)), (5, 'Chunks A / B', format('{:,}', total_a) || ' / ' || format('{:,}', total_b))) v(k, label, value)"""),
}
ORACLES["p4_gram_join"] = ORACLES["p4_gram_jaccard"]
ORACLES["p4_gram_jaccard"] = _with(f"{_grams(16)}, {GRAM_PAIRS}, {GRAM_SCORE.format(L=16)}", """SELECT pair_id, coalesce(common, 0) AS common, coalesce(n_union, 0) AS n_union,
    round(similarity, 6) AS jaccard_percent FROM gsc LEFT JOIN gjc USING (pair_id)""")
ORACLES["p5_hits_by_join"] = _with(f"{_grams(16)}, {GRAM_PAIRS}", """SELECT pair_id, list, rank::INTEGER AS rank, hex, coalesce(ca, 0) AS count_a, coalesce(cb, 0) AS count_b FROM (
    SELECT *, row_number() OVER (PARTITION BY pair_id, list ORDER BY least(ca, cb) DESC, hex) AS rank FROM (
        SELECT *, CASE WHEN ca IS NOT NULL AND cb IS NOT NULL THEN 'common' WHEN ca >= 2 THEN 'a' WHEN cb >= 2 THEN 'b' END AS list FROM met) WHERE list IS NOT NULL) WHERE rank <= 50""")

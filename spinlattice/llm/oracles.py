"""DuckDB SQL for those of this subpackage's queries that SQL can express, written from the contracts with constants of its own."""

CAPITALS = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Macros for the checksum of a text's UTF-8 bytes: a table by eight steps a byte, then a fold over the bytes.
CRC = """bytes_table AS MATERIALIZED (SELECT list(e ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b::UBIGINT, range(8)::UBIGINT[]),
    lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::UBIGINT) ELSE r >> 1 END) AS e FROM range(256) AS x(b)))"""


def crc(text: str) -> str:
    """Needs ``t`` of bytes_table in scope."""
    spelled = f"list_transform(range(1, strlen({text}) + 1), lambda i: ('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::UBIGINT)"
    return f"xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, {spelled}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255)::BIGINT + 1])))"


IMPORTANCE = rf"""WITH {CRC},
texts AS (SELECT doc_id, 0 AS kind, {CAPITALS} AS text FROM documents UNION ALL SELECT NULL, 1, {CAPITALS} FROM benchmark),
split AS (SELECT doc_id, kind, coalesce(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM texts),
grams AS (SELECT doc_id, kind, len(w) AS n_words, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS gram FROM split),
bucket AS (SELECT gram, {crc('gram')} % 10000 AS b FROM (SELECT DISTINCT gram FROM grams), bytes_table),
counts AS (SELECT b, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM grams JOIN bucket USING (gram) GROUP BY b),
totals AS (SELECT sum(s) + 10000 AS s_all, sum(t) + 10000 AS t_all FROM counts),
gain AS (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * s_all::DOUBLE / ((s + 1)::DOUBLE * t_all::DOUBLE)))::BIGINT AS gain FROM counts, totals),
weights AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM grams JOIN bucket USING (gram) JOIN gain USING (b) WHERE kind = 0 GROUP BY doc_id),
scored AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296.0)))::BIGINT AS score
    FROM split LEFT JOIN weights USING (doc_id) WHERE kind = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= 25 * n // 100 THEN r END AS rank, n_words FROM ranked"""


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


def _tree(name: str, leaves: str) -> str:
    """CTEs of all levels of trees over ``leaves`` (g, idx, h, n) and of each node's siblings, where it has a level above."""
    return f"""{name}(g, level, idx, h, n) AS (SELECT g, 0, idx, h, n FROM {leaves}
    UNION ALL SELECT g, level + 1, idx // 16, sha256(string_agg(h, '' ORDER BY idx)), (n + 15) // 16 FROM {name} WHERE n > 1 GROUP BY g, level, idx // 16, n),
{name}_sides AS (SELECT a.g, a.level, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
    FROM {name} AS a JOIN {name} AS b ON a.g IS NOT DISTINCT FROM b.g AND a.level = b.level AND a.idx // 16 = b.idx // 16 WHERE a.n > 1 GROUP BY a.g, a.level, a.idx)"""


MERKLE = f"""WITH RECURSIVE {CRC},
hashed AS (SELECT doc_id, source, {_leaf('text')} AS leaf, CASE WHEN {crc("doc_id::VARCHAR")} % 5 = 0 THEN {_leaf(CAPITALS)} ELSE {_leaf('text')} END AS given FROM documents, bytes_table),
placed AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS FIRST, doc_id NULLS FIRST, leaf) AS row_id, source AS g, leaf AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM hashed),
{_tree('low', 'placed')},
subroots AS (SELECT g AS source, h AS subroot, 0 AS g, h, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
{_tree('high', 'subroots')},
walk(row_id, step, g, idx, level, upper, source, h, shown) AS (
    SELECT row_id, 0, source, idx, 0, false, source, given, '' FROM placed
    UNION ALL
    SELECT w.row_id, w.step + 1, w.g, CASE WHEN s.level IS NOT NULL THEN w.idx // 16 WHEN t.level IS NOT NULL THEN w.idx // 16 ELSE r.idx END,
        CASE WHEN s.level IS NULL AND t.level IS NULL THEN 0 ELSE w.level + 1 END, w.upper OR s.level IS NULL, w.source,
        CASE WHEN s.level IS NOT NULL THEN sha256(s.l || w.h || s.r) WHEN t.level IS NOT NULL THEN sha256(t.l || w.h || t.r) ELSE w.h END,
        w.shown || coalesce(s.l || s.r, t.l || t.r, '')
    FROM walk AS w LEFT JOIN low_sides AS s ON NOT w.upper AND s.g IS NOT DISTINCT FROM w.g AND s.level = w.level AND s.idx = w.idx
    LEFT JOIN high_sides AS t ON w.upper AND t.level = w.level AND t.idx = w.idx
    LEFT JOIN subroots AS r ON NOT w.upper AND r.source IS NOT DISTINCT FROM w.source
    WHERE NOT w.upper OR t.level IS NOT NULL),
ended AS (SELECT row_id, arg_max(h, step) AS folded_root, sha256(arg_max(shown, step)) AS proof_sha256 FROM walk GROUP BY row_id),
root AS (SELECT h AS root FROM high WHERE n = 1)
SELECT p.doc_id, p.leaf, s.subroot, root.root, e.proof_sha256, e.folded_root, e.folded_root = root.root AS verified
FROM placed AS p JOIN ended AS e USING (row_id) JOIN subroots AS s ON s.source IS NOT DISTINCT FROM p.source, root"""

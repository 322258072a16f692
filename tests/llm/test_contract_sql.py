"""The columns that SQL can express of queries that it cannot express whole, in DuckDB on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")

WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"
BASE = rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
placed AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, list_slice(w, i, i + 4)) AS n FROM placed),
again AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM windows, (SELECT unnest(range(0, 5)) AS k) WHERE n > 1 GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, length(list_aggregate(w, 'string_agg', ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
coalesce(lines.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words, len(w) < 10 OR 100 * coalesce(again.n, 0) > 20 * len(w) AS base_failed
FROM w LEFT JOIN again USING (doc_id) LEFT JOIN lines USING (doc_id)"""

EDITED = """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
b AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id), first(text) OVER (ORDER BY doc_id)) AS after FROM d)
SELECT doc_id, n AS n_chars, sha256(concat(left(text, (n - n // 2)::BIGINT), left(after, (n // 2)::BIGINT))) AS edited_sha256 FROM b"""

#: Base32 of 40 hexadecimal digits: five of them are four letters.
DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * k + 1, 5))::BIGINT >> {0}) & 31) + 1, 1)"
PAYLOADS = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
first AS (SELECT h, min(page_id) AS least FROM p GROUP BY h)
SELECT page_id, strlen(body) AS payload_bytes, array_to_string(list_transform(range(0, 8), lambda k: {' || '.join(DIGIT.format(s) for s in (15, 10, 5, 0))}), '') AS payload_digest,
CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to FROM p JOIN first USING (h)"""

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
SECRETS = f"""SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '{ASSIGN.replace("'", "''")}', 2), lambda x: length(x) >= 12))::BIGINT AS n_assign,
len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18))::BIGINT AS n_access, len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 16))::BIGINT AS n_hex FROM documents"""


def cases():
    from spinlattice.llm.order_minhash import op6_order_minhash
    from spinlattice.llm.quality import op2_quality
    from spinlattice.llm.secrets import op4_secrets
    from spinlattice.llm.warc import op7_warc

    return {"op2": (op2_quality, BASE), "op4": (op4_secrets, SECRETS), "op6": (op6_order_minhash, EDITED), "op7": (op7_warc, PAYLOADS)}


@pytest.mark.parametrize("name", ["op2", "op4", "op6", "op7", "op11", "op12"])
def test_against_duckdb(spark, name):
    import duckdb

    from spinlattice.llm.queries import QUERIES, SQL

    if name in ("op11", "op12"):
        (full,) = (n for n in SQL if n.startswith(f"{name}_"))
        run, sql = QUERIES[full], SQL[full]
    else:
        run, sql = cases()[name]
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    got = run(spark, SF).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(cursor.fetchall()) if name != "op11" else sorted(map(str, map(tuple, got))) == sorted(map(str, cursor.fetchall()))

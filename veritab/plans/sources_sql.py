"""Sources with faults, as SQL that Spark and DuckDB read alike; ``{name}`` is a test table or another source."""

TEST_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

SOURCES = {
    "people": """
        SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS balance, CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN '   ' ELSE c_name END AS name,
               CASE WHEN c_custkey % 5 = 0 THEN 'N/A' ELSE c_mktsegment END AS segment, c_nationkey AS nation,
               CASE WHEN c_custkey % 9 = 0 THEN 'user at example' ELSE concat('user', CAST(c_custkey AS VARCHAR(20)), '@example.com') END AS email,
               CASE WHEN c_custkey % 6 = 0 THEN '12-34' ELSE concat('+82 10-1234-', CAST(1000 + c_custkey % 9000 AS VARCHAR(20))) END AS phone,
               CASE WHEN c_custkey % 10 = 0 THEN 'ftp:/x' ELSE concat('https://example.com/', CAST(c_custkey AS VARCHAR(20))) END AS url,
               CASE WHEN c_custkey % 8 = 0 THEN '10.0.0.256' ELSE concat('10.0.', CAST(c_custkey % 200 AS VARCHAR(20)), '.1') END AS ip_address,
               CASE WHEN c_custkey % 4 = 0 THEN '2001:db8::zz' ELSE '2001:db8::1' END AS ip6,
               CASE WHEN c_custkey % 3 = 0 THEN '123e4567-e89b-12d3-a456-42661417400' ELSE '123e4567-e89b-12d3-a456-426614174000' END AS uuid,
               CASE WHEN c_custkey % 12 = 0 THEN '2024-13-01' ELSE '2024-05-17' END AS day,
               CASE WHEN c_custkey % 3 = 0 THEN '42' ELSE 'x42' END AS mixed,
               CASE WHEN c_custkey % 17 = 0 THEN CAST('NaN' AS DOUBLE) WHEN c_custkey % 19 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE c_acctbal END AS reading,
               CAST(c_custkey % 120 AS DOUBLE) - 10 AS age, CASE WHEN c_custkey % 15 = 0 THEN 'yes' WHEN c_custkey % 15 = 1 THEN 'no' ELSE NULL END AS consent
        FROM {customer}""",
    "rows3": """
        SELECT l_orderkey AS a, l_partkey AS b, l_suppkey AS c, CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE l_quantity END AS q, l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
               CASE WHEN l_orderkey % 10 = 0 THEN l_discount + l_tax + 1 ELSE l_discount + l_tax END AS total, l_linenumber AS line, l_returnflag AS flag, l_linestatus AS status,
               CASE WHEN l_linenumber = 1 THEN NULL ELSE l_returnflag END AS flag2
        FROM {lineitem}""",
    "children": """
        SELECT o_orderkey AS id, CASE WHEN o_orderkey % 50 = 0 THEN 99999999 WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_custkey END AS customer, o_totalprice AS price, o_orderstatus AS status FROM {orders}""",
    "tree": """
        SELECT CAST(c_custkey AS BIGINT) AS id, CASE WHEN c_custkey < 2 THEN NULL WHEN c_custkey % 100 = 50 THEN c_custkey + 1 WHEN c_custkey % 100 = 51 THEN c_custkey - 1 ELSE CAST(floor(c_custkey / 2) AS BIGINT) END AS parent FROM {customer}""",
    "series": """
        SELECT ts, event_id AS seq, CASE WHEN event_id % 20 = 0 THEN NULL ELSE value END AS value FROM {events}""",
    "daily": """
        SELECT date_trunc('day', o_orderdate) AS ts, sum(o_totalprice) AS value FROM {orders} GROUP BY 1""",
    "places": """
        SELECT event_id AS id, CASE WHEN event_id % 100 = 0 THEN 95.0 WHEN event_id % 100 = 1 THEN 0.0 ELSE CAST((event_id * 37) % 180 AS DOUBLE) - 90 END AS lat,
               CASE WHEN event_id % 100 = 0 THEN -190.0 WHEN event_id % 100 = 1 THEN 0.0 ELSE CAST((event_id * 53) % 360 AS DOUBLE) - 180 END AS lon,
               CAST((event_id * 11) % 180 AS DOUBLE) - 90 AS lat2, CAST((event_id * 17) % 360 AS DOUBLE) - 180 AS lon2
        FROM {events}""",
    "baseline": "SELECT * FROM {orders} WHERE o_orderkey % 2 = 0",
    "shifted": "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 6 = 1 THEN 'F' ELSE o_orderstatus END AS o_orderstatus, o_totalprice * 1.2 AS o_totalprice, o_orderdate, o_orderpriority FROM {orders} WHERE o_orderkey % 2 = 1",
    "flags": """
        SELECT user_id, CASE WHEN user_id % 5 = 0 THEN 'true' ELSE 'false' END AS deleted, CASE WHEN user_id % 4 = 0 THEN NULL ELSE concat('user', CAST(user_id AS VARCHAR(20)), '@example.com') END AS email, ts FROM {events}""",
    "codes": """
        SELECT p_partkey AS id,
               CASE p_partkey % 3 WHEN 0 THEN '4539 1488 0343 6467' WHEN 1 THEN '4539148803436468' ELSE NULL END AS card,
               CASE p_partkey % 4 WHEN 0 THEN '978-3-16-148410-0' WHEN 1 THEN '9783161484101' WHEN 2 THEN '0-306-40615-2' ELSE '080442957X' END AS isbn,
               CASE p_partkey % 3 WHEN 0 THEN 'DE89 3704 0044 0532 0130 00' WHEN 1 THEN 'GB82WEST12345698765432' ELSE 'DE89370400440532013001' END AS iban,
               CASE p_partkey % 3 WHEN 0 THEN 'DE123456789' WHEN 1 THEN 'GR123456789' ELSE 'XX1' END AS vat,
               CASE p_partkey % 3 WHEN 0 THEN 'DEUTDEFF' WHEN 1 THEN 'DEUTDEFF500' ELSE 'DEUT1' END AS swift,
               CASE p_partkey % 3 WHEN 0 THEN '11010519491231002X' WHEN 1 THEN '110105194912310021' ELSE '999' END AS chinese,
               CASE p_partkey % 2 WHEN 0 THEN '91350100M000100Y43' ELSE '91350100M000100Y44' END AS uscc,
               CASE p_partkey % 3 WHEN 0 THEN '100-0001' WHEN 1 THEN '1000001' ELSE '000-12' END AS postal,
               CASE p_partkey % 2 WHEN 0 THEN '123456789018' ELSE '123456789012' END AS mynumber,
               CASE p_partkey % 2 WHEN 0 THEN '220-81-62517' ELSE '220-81-62518' END AS business,
               CASE p_partkey % 3 WHEN 0 THEN '900101-1234568' WHEN 1 THEN '901301-1234567' ELSE '12' END AS rrn,
               CASE p_partkey % 3 WHEN 0 THEN '010-1234-5678' WHEN 1 THEN '02-123-4567' ELSE '1-2' END AS kphone,
               CASE p_partkey % 2 WHEN 0 THEN '123456789012' ELSE '12345' END AS account, CASE p_partkey % 2 WHEN 0 THEN 'kb' ELSE 'toss' END AS bank
        FROM {part}""",
}

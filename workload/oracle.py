"""DuckDB SQL for the registered queries, written from the definitions and not from the Spark code.

Common tables: ``lines`` derives the trades from the driver's tables, ``checked`` applies the record rules
to them, ``valid`` keeps what may claim a key and ``ranked`` numbers those in arrival order.
"""

from textwrap import dedent

from workload.inputs import AS_OF, CUT_DAY, DQ_AS_OF
from workload.queries import RUN_ENDS

LINES = """
lines AS (
  SELECT *,
    CAST(imo_base AS VARCHAR) || CAST((digit + CASE WHEN l_partkey % 7 = 0 THEN 1 ELSE 0 END) % 10 AS VARCHAR) AS imo,
    traded_at + to_seconds(1 + (l_partkey * 37 + l_suppkey * 11) % 90000) AS received_at,
    arrival_day * 68719476736 + arrival_tie AS arrival_seq,
    CASE dialect WHEN 0 THEN 'TR-' WHEN 1 THEN 'D-' ELSE 'TR-8' END || l_orderkey AS trade_reference,
    CASE WHEN dialect = 0 THEN CAST(tonnes AS VARCHAR) ELSE tonnes || '.00' END AS tonnes_text,
    source_system || ':' || source_record_id AS dedup_key
  FROM (
    SELECT *,
      ((imo_base // 100000) % 10 * 7 + (imo_base // 10000) % 10 * 6 + (imo_base // 1000) % 10 * 5
        + (imo_base // 100) % 10 * 4 + (imo_base // 10) % 10 * 3 + imo_base % 10 * 2) % 10 AS digit
    FROM (
      SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_shipdate,
        l_linenumber % 3 AS dialect,
        CASE l_linenumber % 3 WHEN 0 THEN 'trading-desk' WHEN 1 THEN 'erp' ELSE 'port-telemetry' END AS source_system,
        CASE l_suppkey % 3 WHEN 0 THEN 'Batch' WHEN 1 THEN 'Stream' ELSE 'Api' END AS channel,
        'LI-' || l_orderkey || '-' || l_linenumber AS source_record_id,
        CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS arrival_day,
        CAST('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,
          CAST(l_quantity AS INTEGER), CAST(round(l_extendedprice * 100) AS BIGINT),
          CAST(round(l_discount * 100) AS INTEGER), CAST(round(l_tax * 100) AS INTEGER),
          l_returnflag, l_linestatus)), 1, 9) AS BIGINT) AS arrival_tie,
        900000 + l_partkey % 99999 AS imo_base,
        l_shipdate + to_minutes(l_orderkey % 1440) AS traded_at,
        CASE WHEN s_nationkey % 11 = 3 THEN 'Fredericia'
          ELSE chr(65 + s_nationkey % 26) || chr(65 + (s_nationkey * 7) % 26) || chr(65 + (s_nationkey * 11) % 26)
            || 'P' || chr(65 + s_nationkey % 5) END AS locode,
        CASE p_type WHEN 'STANDARD' THEN 'VLSFO' WHEN 'SMALL' THEN 'HSFO' WHEN 'LARGE' THEN 'LSMGO'
          WHEN 'PROMO' THEN 'MGO' WHEN 'ECONOMY' THEN 'ULSFO' WHEN 'MEDIUM' THEN 'JETA1' END AS grade,
        CASE WHEN l_orderkey % 97 = 0 THEN 0 ELSE CAST(l_quantity * 25 AS BIGINT) END AS tonnes,
        450 + l_partkey % 250 AS dollars,
        lpad(CAST(l_suppkey % 100 AS VARCHAR), 2, '0') AS cents,
        CASE WHEN l_orderkey % 89 <> 0 THEN s_name END AS party
      FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    )
  )
)"""

# What the three systems call each field, for the texts of missing-field errors.
# The accepted spellings, as problem descriptions list them.
ALIAS_TEXT = {
    "tradedAtUtc": "tradedAtUtc, traded_at_utc, tradedAt, traded_at, timestamp, trade_date",
    "tradeReference": "tradeReference, trade_reference, trade_ref, TradeRef, deal_id, dealId",
    "vesselImo": "vesselImo, vessel_imo, imo, IMO, vessel",
    "port": "port, portCode, port_code, locode, unlocode, delivery_port",
    "product": "product, grade, fuel_grade, fuelGrade, productCode",
    "priceUsdPerMt": "priceUsdPerMt, price_usd_per_mt, price, unit_price, unitPrice",
    "counterparty": "counterparty, counter_party, supplier, seller",
}


def missing(field: str) -> str:
    return (
        f"'Record ''' || source_record_id || ''' from ''' || source_system || ''' is missing required field "
        f"''{field}'' (accepted aliases: {ALIAS_TEXT[field]}).'"
    )


def imo_ok(text: str) -> str:
    digits = " + ".join(f"(ascii(substr({text}, {i}, 1)) - 48) * {8 - i}" for i in range(1, 7))
    return f"(regexp_full_match({text}, '[0-9]{{7}}') AND ({digits}) % 10 = ascii(substr({text}, 7, 1)) - 48)"


GRADES = "('VLSFO', 'HSFO', 'LSMGO', 'MGO', 'ULSFO', 'LNG')"
GRADE_TEXT = "HSFO, LNG, LSMGO, MGO, ULSFO, VLSFO"
IMO_TEXT = "'''' || {0} || ''' is not a valid IMO number (7 digits, last one a check digit).'"
PORT_TEXT = "'''' || {0} || ''' is not a UN/LOCODE (5 letters, for example DKFRC).'"
PRODUCT_TEXT = "'''' || {0} || ''' is not one of " + GRADE_TEXT + ".'"

CHECKED = f"""
checked AS (
  SELECT *, no_party IS NULL AND summary = '' AS is_valid,
    CASE WHEN no_party IS NOT NULL THEN 'normalization_failed' WHEN summary <> '' THEN 'validation_failed' END AS bad_reason,
    coalesce(no_party, nullif(summary, '')) AS bad_detail
  FROM (
    SELECT *, CASE WHEN party IS NULL THEN {missing("counterparty")} END AS no_party,
      upper(locode) AS port,
      concat_ws('; ',
        CASE WHEN NOT {imo_ok("imo")} THEN 'vesselImo: ' || {IMO_TEXT.format("imo")} END,
        CASE WHEN NOT regexp_full_match(upper(locode), '[A-Z]{{5}}') THEN 'port: ' || {PORT_TEXT.format("upper(locode)")} END,
        CASE WHEN grade NOT IN {GRADES} THEN 'product: ' || {PRODUCT_TEXT.format("grade")} END,
        CASE WHEN tonnes <= 0 OR tonnes > 20000
          THEN 'quantityMt: Quantity must be greater than 0 and at most 20000 MT, got ' || tonnes_text || '.' END) AS summary,
      CAST(dollars || '.' || cents AS DECIMAL(18, 2)) AS price,
      CAST(tonnes AS DECIMAL(18, 0)) * CAST(dollars || '.' || cents AS DECIMAL(10, 2)) AS usd
    FROM lines
  )
)"""

HASH = "sha256(dedup_key)"
EVENT_ID = "concat_ws('-', " + ", ".join(
    "concat(" + ", ".join(f"substr({HASH}, {p}, 2)" for p in part) + ")" for part in ((7, 5, 3, 1), (11, 9), (15, 13))
) + f", substr({HASH}, 17, 4), substr({HASH}, 21, 12))"

VALID = f"valid AS (SELECT *, {EVENT_ID} AS event_id FROM checked WHERE is_valid)"
RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY arrival_seq) AS nth FROM valid)"
EVENTS = f"WITH {LINES}, {CHECKED}, {VALID}, {RANKED}, accepted AS (SELECT * FROM ranked WHERE nth = 1)"

OUTCOMES = EVENTS + """, outcomes AS (
  SELECT c.*, CASE WHEN NOT c.is_valid THEN 'Rejected' WHEN r.nth = 1 THEN 'Accepted' ELSE 'Duplicate' END AS outcome
  FROM checked c LEFT JOIN ranked r ON r.dedup_key = c.dedup_key AND r.arrival_seq = c.arrival_seq AND c.is_valid
)"""

GRID = (
    "grid AS (SELECT outcome, channel FROM (VALUES ('Accepted'), ('Duplicate'), ('Rejected'), ('Failed')) o(outcome), "
    "(VALUES ('Batch'), ('Stream'), ('Api')) c(channel))"
)

FAILING = """, failing AS (
  SELECT c.*, CASE l_partkey % 11 WHEN 0 THEN 'publish_transient' WHEN 1 THEN 'publish_permanent' END AS publish_error
  FROM checked c
), first_sent AS (
  SELECT dedup_key, min(arrival_seq) AS first_seq FROM failing WHERE is_valid AND publish_error IS NULL GROUP BY dedup_key
), released AS (
  SELECT f.*, s.first_seq,
    CASE WHEN NOT is_valid THEN 'Rejected'
      WHEN publish_error IS NULL AND arrival_seq = first_seq THEN 'Accepted'
      WHEN publish_error IS NOT NULL AND (first_seq IS NULL OR arrival_seq < first_seq) THEN 'Failed'
      ELSE 'Duplicate' END AS outcome
  FROM failing f LEFT JOIN first_sent s ON s.dedup_key = f.dedup_key
), released_reason AS (
  SELECT *, CASE outcome WHEN 'Rejected' THEN bad_reason WHEN 'Failed' THEN publish_error
    WHEN 'Duplicate' THEN 'duplicate' END AS reason FROM released
)"""

GOLD = """
  SELECT port, grade AS product, count(*) AS trades,
    CAST(CAST(sum(tonnes) AS DECIMAL(20, 1)) AS DOUBLE) AS total_mt,
    CAST(CAST(sum(total) AS DECIMAL(28, 2)) AS DOUBLE) AS total_usd,
    CAST((2 * CAST(sum(price * 10000) AS HUGEINT) + 100 * count(*)) // (200 * count(*)) AS DOUBLE) / 100 AS avg_price_usd_per_mt,
    count(DISTINCT imo) AS vessels
  FROM {} GROUP BY ALL"""

BRONZE = EVENTS + """, bronze AS (
  SELECT *, CASE WHEN l_orderkey % 31 = 0 THEN 2 ELSE 1 END AS schema_version, CAST(traded_at AS DATE) AS dt,
    round_even(usd, 2) AS total
  FROM valid
), silver AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY event_id
      ORDER BY received_at DESC, traded_at DESC, tonnes DESC, price DESC, imo DESC, port DESC, grade DESC, channel DESC) AS version
    FROM bronze WHERE schema_version = 1
  ) WHERE version = 1
), gold AS (
""" + GOLD.format("silver") + ")"

ISO = "'%Y-%m-%dT%H:%M:%S.%f'"


def iso(column: str) -> str:
    return f"strftime({column}, {ISO})"


def double(column: str) -> str:
    return f"CAST({column} AS DOUBLE)"


# Requests of suppliers: the main one and the rest.
REQUESTS = EVENTS + """, requested AS (
  SELECT c.*, 'REQ-' || l_suppkey || CASE WHEN l_linenumber <= 6 THEN '-main' ELSE '-rest' END AS request_id FROM checked c
), announced AS (
  SELECT 'REQ-' || s_suppkey || x AS request_id FROM supplier, (VALUES ('-main'), ('-rest'), ('-none')) v(x)
), admission AS (
  SELECT a.request_id, count(r.request_id) AS records FROM announced a LEFT JOIN requested r USING (request_id) GROUP BY 1
)"""

DAMAGE = f"""
SELECT source_record_id, arrival_seq, 'normalization_failed' AS reason, detail FROM (
  SELECT source_record_id, arrival_seq, CASE
    WHEN k IN (0, 10) THEN {missing("tradedAtUtc")}
    WHEN k = 1 THEN 'Field ''tradedAtUtc'' on record ''' || source_record_id || ''' is not a timestamp: ''not a date''.'
    WHEN k = 2 THEN {missing("tradeReference")}
    WHEN k = 3 THEN {missing("vesselImo")}
    WHEN k = 4 THEN {missing("port")}
    WHEN k = 5 THEN {missing("product")}
    WHEN k = 6 THEN 'Field ''quantityMt'' on record ''' || source_record_id || ''' is not a number: ''eight hundred''.'
    WHEN k = 7 THEN {missing("priceUsdPerMt")}
    WHEN k = 8 THEN 'Field ''priceUsdPerMt'' on record ''' || source_record_id || ''' is not a number: ''1.234,5''.'
    WHEN k = 9 OR party IS NULL THEN {missing("counterparty")} END AS detail
  FROM (SELECT *, l_orderkey % 13 AS k FROM lines)
) WHERE detail IS NOT NULL"""

DQ = f"""
WITH {LINES}, {CHECKED}, typed AS (
  SELECT *, CASE WHEN l_orderkey % 101 = 0 THEN 2 ELSE 1 END AS v,
    l_orderkey % 103 = 0 AS no_ref, l_orderkey % 107 = 0 AS blank_party,
    CASE WHEN l_orderkey % 109 = 0 THEN price * 10 ELSE price END AS p
  FROM checked WHERE party IS NOT NULL
), reports AS (
  SELECT source_record_id, arrival_seq, list_filter([
    CASE WHEN v <> 1 THEN {{'field': 'schemaVersion', 'code': 'unsupported_schema_version',
      'message': 'Expected schema version 1, got ' || v || '.'}} END,
    CASE WHEN no_ref THEN {{'field': 'tradeReference', 'code': 'required', 'message': 'Trade reference is empty.'}} END,
    CASE WHEN NOT {imo_ok("imo")} THEN {{'field': 'vesselImo', 'code': 'invalid_imo', 'message': {IMO_TEXT.format("imo")}}} END,
    CASE WHEN NOT regexp_full_match(port, '[A-Z]{{5}}')
      THEN {{'field': 'port', 'code': 'invalid_locode', 'message': {PORT_TEXT.format("port")}}} END,
    CASE WHEN grade NOT IN {GRADES}
      THEN {{'field': 'product', 'code': 'unknown_product', 'message': {PRODUCT_TEXT.format("grade")}}} END,
    CASE WHEN tonnes <= 0 OR tonnes > 20000 THEN {{'field': 'quantityMt', 'code': 'out_of_range',
      'message': 'Quantity must be greater than 0 and at most 20000 MT, got ' || tonnes || '.'}} END,
    CASE WHEN p <= 0 OR p > 5000 THEN {{'field': 'priceUsdPerMt', 'code': 'out_of_range',
      'message': 'Price must be greater than 0 and at most 5000 USD/MT, got '
        || regexp_replace(CAST(p AS VARCHAR), '\\.?0+$', '') || '.'}} END,
    CASE WHEN blank_party THEN {{'field': 'counterparty', 'code': 'required', 'message': 'Counterparty is empty.'}} END,
    CASE WHEN traded_at > TIMESTAMP '{DQ_AS_OF}' + INTERVAL 5 MINUTE THEN {{'field': 'tradedAtUtc', 'code': 'future_timestamp',
      'message': 'Trade timestamp ' || strftime(traded_at, '%Y-%m-%dT%H:%M:%S')
        || '.0000000+00:00 is more than 5 minutes ahead of now.'}} END
  ], lambda x: x IS NOT NULL) AS r FROM typed
), failures AS (
  SELECT source_record_id, arrival_seq, i - 1 AS ordinal, r[i].field AS field, r[i].code AS code, r[i].message AS message
  FROM (SELECT *, unnest(range(1, len(r) + 1)) AS i FROM reports)
)"""


def stream_sql() -> str:
    """Each run keeps the first valid message per id that no earlier run has landed."""
    cases = " ".join(f"WHEN arrival_day < {end} THEN {i}" for i, end in enumerate(RUN_ENDS)) + f" ELSE {len(RUN_ENDS)}"
    return f"""
WITH {LINES}, {CHECKED}, sent AS (
  SELECT * REPLACE ('port-telemetry:' || source_record_id AS dedup_key), CASE {cases} END AS run
  FROM checked WHERE is_valid AND l_partkey % 29 <> 0 AND l_partkey % 31 <> 0
), firsts AS (
  SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY run, arrival_seq) AS nth FROM sent
)
SELECT {EVENT_ID} AS event_id, source_record_id, trade_reference, {double("tonnes")} AS quantity_mt,
  {double("round_even(usd, 2)")} AS total_usd, strftime(traded_at, '%Y-%m-%d') AS dt, CAST(run AS BIGINT) AS batch_id
FROM firsts WHERE nth = 1"""


def oracle() -> dict[str, str]:
    half = "(CAST(l_quantity AS INTEGER) || '.5')"
    price = "(dollars || '.' || cents)"
    w = "(1000 + l_partkey % 5000)"
    full = f"CAST({w} AS DOUBLE) + CAST(cents AS DOUBLE) / 100"
    by_date = "SELECT strftime(dt, '%Y-%m-%d') AS dt, count(*) AS \"rows\", CAST(sum(tonnes) AS DOUBLE) AS mt FROM bronze GROUP BY 1"
    landed_columns = f"""
      event_id, 'bunker.trade.recorded' AS event_type, {{version}} AS schema_version, source_system, source_record_id,
      channel, {iso("traded_at")} AS occurred_at_utc, {iso("received_at")} AS ingested_at_utc, trade_reference,
      imo AS vessel_imo, port, grade AS product, {double("tonnes")} AS quantity_mt, {double("price")} AS price_usd_per_mt,
      {double("round_even(usd, 2)")} AS total_usd, party AS counterparty, {iso("traded_at")} AS traded_at_utc,
      strftime(traded_at, '%Y-%m-%d') AS dt"""
    page = f"""SELECT *, CAST(row_number() OVER (ORDER BY occurred_at_utc DESC, event_id) AS INTEGER) AS position FROM (
      SELECT event_id, {iso("traded_at")} AS occurred_at_utc, port, {double("tonnes")} AS quantity_mt FROM accepted
      WHERE grade = 'MGO' AND traded_at >= TIMESTAMP '1997-01-01' ORDER BY traded_at DESC, event_id LIMIT 500 OFFSET 25)"""
    k16 = "CASE l_partkey % 16"
    sql = {
        # sources
        "src_batch_records": f"""WITH {LINES} SELECT source_record_id, arrival_day AS pulled_at,
            CAST(arrival_tie AS VARCHAR) AS path, CAST(pos AS BIGINT) AS position, 'trading-desk' AS source_system, 'Batch' AS channel, CASE pos WHEN 0 THEN locode ELSE lower(locode) END AS port
            FROM lines, (VALUES (0), (3)) p(pos) WHERE l_partkey % 41 <> 0""",
        "src_missing_record_id": f"""WITH {LINES} SELECT source_system, count(*) AS pulled,
            count(*) FILTER (l_partkey % 19 < 4) AS skipped, count(*) FILTER (l_partkey % 19 >= 4) AS kept FROM lines GROUP BY 1""",
        "stream_decode": f"""WITH {LINES} SELECT arrival_tie AS "offset", CASE
            WHEN k IN (0, 1, 2, 5) OR (k = 7 AND l_suppkey % 2 = 0) THEN 'not_json'
            WHEN k IN (3, 4) THEN 'no_record_id' ELSE 'record' END AS verdict,
            CASE WHEN k = 6 OR (k = 7 AND l_suppkey % 2 = 1) THEN source_record_id WHEN k = 4 THEN ' ' END AS record_id,
            CASE WHEN k IN (3, 4, 6) OR (k = 7 AND l_suppkey % 2 = 1) THEN locode END AS port
            FROM (SELECT *, l_partkey % 8 AS k FROM lines)
            UNION ALL SELECT event_id, 'not_json', NULL, NULL FROM events""",
        "src_push_guard": f"""{REQUESTS} SELECT arrival_seq, request_id, CASE l_partkey % 17
            WHEN 0 THEN 'sourceSystem is required.' WHEN 4 THEN 'sourceSystem is required.'
            WHEN 1 THEN 'sourceRecordId is required.' WHEN 2 THEN 'fields is required and must not be empty.'
            WHEN 3 THEN 'fields is required and must not be empty.' END AS request_error FROM requested""",
        "src_batch_admission": f"""{REQUESTS} SELECT request_id, records,
            CASE WHEN records = 0 THEN 'invalid_request' WHEN records > 500 THEN 'batch_too_large' ELSE 'admitted' END AS verdict,
            CASE WHEN records = 0 THEN 'The batch is empty.' WHEN records > 500
              THEN 'A batch may contain at most 500 records, got ' || records || '.' END AS detail FROM admission""",
        "batch_summary": f"""{REQUESTS}, inside AS (
              SELECT r.*, l_partkey % 17 = 1 AS malformed FROM requested r JOIN admission a USING (request_id)
              WHERE a.records BETWEEN 1 AND 500
            ), numbered AS (
              SELECT *, CASE WHEN is_valid AND NOT malformed THEN row_number() OVER (
                PARTITION BY dedup_key, is_valid AND NOT malformed ORDER BY arrival_seq) END AS n FROM inside
            ) SELECT request_id, count(*) FILTER (n = 1) AS accepted, count(*) FILTER (n > 1) AS duplicate,
            count(*) FILTER (n IS NULL) AS rejected, CAST(0 AS BIGINT) AS failed FROM numbered GROUP BY 1""",
        "ingest_all_channels": f"""{EVENTS}, via AS (
              SELECT *, arrival_day * 86400000000 + arrival_tie AS instant,
                CASE source_system WHEN 'erp' THEN channel WHEN 'port-telemetry' THEN 'Stream' ELSE 'Api' END AS via FROM checked
            ), arrived AS (
              SELECT *, CASE via WHEN 'Stream' THEN max(instant - CASE WHEN l_partkey % 5 = 0 THEN 259200000000 ELSE 0 END) OVER (
                PARTITION BY source_system, via, l_orderkey % 4 ORDER BY arrival_seq) ELSE instant END AS arrived_at FROM via
            ), numbered AS (
              SELECT *, row_number() OVER (PARTITION BY dedup_key, is_valid ORDER BY arrived_at, arrival_seq) AS n FROM arrived
            ) SELECT source_system, via AS channel, count(*) FILTER (is_valid AND n = 1) AS accepted,
            count(*) FILTER (is_valid AND n > 1) AS duplicate, count(*) FILTER (NOT is_valid) AS rejected,
            CAST(0 AS BIGINT) AS failed FROM numbered GROUP BY ALL""",
        "publish_envelope": f"""{EVENTS} SELECT dedup_key AS correlation_id, event_id AS message_id,
            'bunker.trade.recorded' AS subject, 'application/json' AS content_type, 1 AS schema_version,
            event_id AS "eventId", 'bunker.trade.recorded' AS "eventType", '1' AS "schemaVersion", source_system AS "sourceSystem",
            source_record_id AS "sourceRecordId", channel, {iso("traded_at")} || '+00:00' AS "occurredAtUtc",
            {iso("received_at")} || '+00:00' AS "ingestedAtUtc", dedup_key AS "deduplicationKey",
            trade_reference AS "tradeReference", imo AS "vesselImo", port, grade AS product, party AS counterparty,
            {iso("traded_at")} || '+00:00' AS "tradedAtUtc", {double("tonnes")} AS "quantityMt",
            {double("price")} AS "priceUsdPerMt", {double("round_even(usd, 2)")} AS "totalUsd" FROM accepted""",
        "bus_schema_filter": f"""{EVENTS} SELECT source_system, channel, count(*) AS messages FROM accepted
            WHERE substr(event_id, 1, 1) <> 'a' GROUP BY ALL""",
        "bus_decode": f"""{EVENTS}, m AS (SELECT *, substr(event_id, 1, 1) AS k FROM accepted), d AS (
              SELECT *, CASE WHEN k = '1' THEN 'empty_payload' WHEN k IN ('0', '2', '5', '6') THEN 'deserialization_failed' END AS decode_error FROM m
            ) SELECT event_id AS message_id, decode_error, CASE WHEN decode_error IS NULL THEN event_id END AS event_id,
            CASE WHEN decode_error IS NULL THEN source_system END AS source_system,
            CASE WHEN decode_error IS NULL THEN channel END AS channel, CASE WHEN decode_error IS NULL THEN port END AS port,
            CASE WHEN decode_error IS NULL THEN {double("tonnes")} END AS quantity_mt,
            CASE WHEN decode_error IS NULL THEN {double("round_even(usd, 2)")} END AS total_usd,
            CASE WHEN decode_error IS NULL THEN {iso("traded_at")} END AS occurred_at_utc FROM d""",
        # normalization
        "normalize_aliases": f"""WITH {LINES} SELECT source_record_id, arrival_seq, trade_reference, imo AS vessel_imo,
            upper(locode) AS port, grade AS product, party AS counterparty FROM lines""",
        "normalize_decimals": f"""WITH {LINES} SELECT source_record_id, arrival_seq,
            l_partkey % 16 NOT BETWEEN 9 AND 13 AS is_number,
            {k16} WHEN 4 THEN CAST({w} AS DOUBLE) WHEN 5 THEN -({full}) WHEN 8 THEN CAST({w} AS DOUBLE) / 1000
              WHEN 9 THEN NULL WHEN 10 THEN NULL WHEN 11 THEN NULL WHEN 12 THEN NULL WHEN 13 THEN NULL
              WHEN 14 THEN CAST(cents AS DOUBLE) / 100 WHEN 15 THEN -CAST({w} AS DOUBLE) ELSE {full} END AS value FROM lines""",
        "normalize_timestamps": f"""WITH {LINES} SELECT source_record_id, arrival_seq, {iso('''CASE
            WHEN k IN (0, 1, 2, 6, 8) THEN traded_at WHEN k = 3 THEN traded_at + to_microseconds(123456)
            WHEN k IN (4, 7) THEN CAST(CAST(traded_at AS DATE) AS TIMESTAMP) WHEN k = 5 THEN traded_at END''')} AS parsed_at
            FROM (SELECT *, l_partkey % 12 AS k FROM lines)""",
        "normalize_errors": f"WITH {LINES} {DAMAGE}",
        "normalize_routable": f"WITH {LINES} SELECT source_record_id, arrival_seq, l_orderkey % 13 <> 2 AS routable FROM lines",
        "event_identity": f"WITH {LINES} SELECT source_record_id, arrival_seq, dedup_key, {EVENT_ID} AS event_id FROM lines",
        "trade_totals": f"""WITH {LINES} SELECT source_record_id, arrival_seq, CAST({half} AS DOUBLE) AS quantity_mt,
            CAST({price} AS DOUBLE) AS price_usd_per_mt,
            {double(f"round_even(CAST({half} AS DECIMAL(9, 1)) * CAST({price} AS DECIMAL(9, 2)), 2)")} AS total_usd FROM lines""",
        # data quality
        "dq_imo_check": f"""WITH {LINES}, shown AS (SELECT source_record_id, arrival_seq, CASE l_partkey % 13
            WHEN 0 THEN substr(imo, 1, 6) WHEN 1 THEN imo || '9' WHEN 2 THEN substr(imo, 1, 2) || 'A' || substr(imo, 4, 4)
            WHEN 3 THEN substr(imo, 1, 6) || '٣' ELSE imo END AS imo FROM lines)
            SELECT *, {imo_ok("imo")} AS valid FROM shown""",
        "dq_failures": f"{DQ} SELECT source_record_id, arrival_seq, CAST(ordinal AS INTEGER) AS ordinal, field, code, message FROM failures",
        "dq_rule_counts": f"{DQ} SELECT field, code, count(*) AS failures FROM failures GROUP BY ALL",
        # outcomes
        "classify_outcomes": f"""{OUTCOMES} SELECT source_record_id, arrival_seq, channel, outcome,
            coalesce(bad_reason, CASE outcome WHEN 'Duplicate' THEN 'duplicate' END) AS reason,
            coalesce(bad_detail, CASE outcome WHEN 'Duplicate'
              THEN 'Business key ''' || dedup_key || ''' has already been ingested.' END) AS detail FROM outcomes""",
        "outcome_counts": f"""{OUTCOMES}, {GRID} SELECT g.outcome, g.channel, count(o.outcome) AS records
            FROM grid g LEFT JOIN outcomes o ON o.outcome = g.outcome AND o.channel = g.channel GROUP BY ALL""",
        "outcome_totals": f"""{OUTCOMES}, {GRID} SELECT g.outcome, count(o.outcome) AS records
            FROM (SELECT DISTINCT outcome FROM grid) g LEFT JOIN outcomes o ON o.outcome = g.outcome GROUP BY ALL""",
        "pull_summary": f"""{OUTCOMES}, {GRID} SELECT s.source_system, s.outcome, count(o.outcome) AS records
            FROM (SELECT DISTINCT x.source_system, grid.outcome FROM lines x, grid) s
            LEFT JOIN outcomes o ON o.outcome = s.outcome AND o.source_system = s.source_system GROUP BY ALL""",
        "publish_retries": f"""{EVENTS} SELECT channel, CAST(sum(CAST(l_quantity AS BIGINT) % 4) AS BIGINT) AS retries
            FROM accepted GROUP BY ALL""",
        "dedupe_against_history": f"""{EVENTS}, taken AS (SELECT DISTINCT dedup_key FROM valid WHERE arrival_day < {CUT_DAY}),
            firsts AS (SELECT dedup_key, min(arrival_seq) AS first_seq FROM valid WHERE arrival_day >= {CUT_DAY} GROUP BY 1)
            SELECT source_record_id, arrival_seq, CASE WHEN NOT is_valid THEN 'Rejected'
              WHEN t.dedup_key IS NULL AND arrival_seq = first_seq THEN 'Accepted' ELSE 'Duplicate' END AS outcome
            FROM checked c LEFT JOIN taken t ON t.dedup_key = c.dedup_key LEFT JOIN firsts f ON f.dedup_key = c.dedup_key
            WHERE arrival_day >= {CUT_DAY}""",
        "dedupe_reserve_release": f"{EVENTS}{FAILING} SELECT source_record_id, arrival_seq, outcome, reason FROM released_reason",
        # dead letters
        "dead_letters": f"""{EVENTS} SELECT source_system, source_record_id, channel, arrival_seq,
            CASE WHEN dialect = 2 THEN 10 ELSE 9 END AS field_count, bad_reason AS reason, bad_detail AS detail,
            {iso(f"TIMESTAMP '{AS_OF}'")} AS dead_lettered_at_utc, dedup_key AS correlation_id FROM checked WHERE NOT is_valid""",
        "dead_letter_summary": f"""{EVENTS}{FAILING} SELECT reason, source_system, channel, count(*) AS records
            FROM released_reason WHERE outcome IN ('Rejected', 'Failed') GROUP BY ALL""",
        "dead_letter_replay": f"""{EVENTS}{FAILING}, fixable AS (
              SELECT DISTINCT dedup_key FROM released WHERE outcome = 'Rejected' AND party IS NOT NULL AND grade = 'JETA1'
            ), again AS (
              SELECT r.* REPLACE (CASE WHEN r.outcome = 'Rejected' THEN 'MGO' ELSE grade END AS grade), CASE WHEN r.outcome = 'Failed' THEN true
                ELSE party IS NOT NULL AND {imo_ok("imo")} AND regexp_full_match(upper(locode), '[A-Z]{{5}}') AND tonnes > 0 END AS ok
              FROM released r WHERE r.outcome = 'Failed'
                OR (r.outcome = 'Rejected' AND r.dedup_key IN (SELECT dedup_key FROM fixable))
            ), firsts AS (SELECT dedup_key, min(arrival_seq) AS seq FROM again WHERE ok GROUP BY 1)
            SELECT source_record_id, arrival_seq, CASE WHEN NOT ok THEN 'Rejected'
              WHEN s.first_seq IS NULL AND a.arrival_seq = f.seq THEN 'Accepted' ELSE 'Duplicate' END AS outcome, grade AS product
            FROM again a LEFT JOIN first_sent s ON s.dedup_key = a.dedup_key LEFT JOIN firsts f ON f.dedup_key = a.dedup_key""",
        "inbox_expiry": """SELECT event_id, CASE WHEN event_id % 8 >= 5 THEN 'MaxDeliveryCountExceeded' ELSE 'TTLExpiredException' END AS reason
            FROM events WHERE event_id % 8 >= 5 OR ts + INTERVAL 14 DAY < TIMESTAMP '2024-01-25'""",
        # landing
        "append_if_absent": f"""{EVENTS} SELECT event_id, source_record_id, arrival_seq FROM accepted
            WHERE dedup_key NOT IN (SELECT dedup_key FROM valid WHERE arrival_day < {CUT_DAY})""",
        "land_trade_rows": f"{EVENTS} SELECT {landed_columns.format(version='1')} FROM accepted",
        "query_store": f"""{EVENTS}, fine AS (
              SELECT *, CAST(CAST(l_quantity AS INTEGER) || '.0625' AS DECIMAL(12, 4)) AS q0,
                CAST(dollars || '.' || cents || '125' AS DECIMAL(12, 5)) AS p0
              FROM lines
            ), fit AS (
              SELECT *, CAST(round(q0, 3) AS DECIMAL(12, 3)) AS q, CAST(round(p0, 4) AS DECIMAL(12, 4)) AS p,
                party IS NOT NULL AND {imo_ok("imo")} AND regexp_full_match(upper(locode), '[A-Z]{{5}}') AND grade IN {GRADES} AS good
              FROM fine
            ), firsts AS (
              SELECT *, {EVENT_ID} AS event_id, row_number() OVER (PARTITION BY dedup_key ORDER BY arrival_seq) AS nth FROM fit WHERE good
            ) SELECT event_id, {double("q")} AS quantity_mt, {double("p")} AS price_usd_per_mt,
            {double("round_even(CAST(q AS DECIMAL(15, 3)) * p, 2)")} AS total_usd, {iso("received_at")} AS ingested_at_utc
            FROM firsts WHERE nth = 1""",
        "landed_count": f"{EVENTS} SELECT count(*) AS landed_events FROM accepted",
        "landed_by_date": f"""{EVENTS} SELECT strftime(traded_at, '%Y-%m-%d') AS dt, count(*) AS "rows" FROM accepted GROUP BY 1""",
        "bronze_scan": f"{BRONZE} {by_date}",
        "compact_partition": f"{BRONZE} SELECT * FROM (VALUES ('dates'), ('batches')) l(layout), ({by_date})",
        "landing_profile": f"""{BRONZE} SELECT 'channel' AS kind, channel AS label, count(*) AS "rows" FROM bronze GROUP BY 2
            UNION ALL SELECT 'source', source_system, count(*) FROM bronze GROUP BY 2
            UNION ALL SELECT 'total', 'rows', count(*) FROM bronze
            UNION ALL SELECT 'total', 'distinct event ids', count(DISTINCT event_id) FROM bronze""",
        # medallion
        "silver_rename": f"""{BRONZE} SELECT event_id, schema_version, imo AS vessel_imo, {iso("received_at")} AS ingested_at_utc,
            strftime(dt, '%Y-%m-%d') AS dt FROM bronze""",
        "silver_trades": f"""{BRONZE} SELECT {landed_columns.format(version='schema_version')},
            strftime(traded_at, '%Y-%m-%d') AS trade_date, date_diff('second', traded_at, received_at) AS ingest_lag_seconds FROM silver""",
        "silver_delta": f"""{BRONZE} SELECT count(*) AS bronze_rows, count(*) FILTER (schema_version <> 1) AS dropped_version,
            count(DISTINCT event_id) FILTER (schema_version = 1) AS silver_rows,
            count(*) FILTER (schema_version = 1) - count(DISTINCT event_id) FILTER (schema_version = 1) AS dropped_duplicate FROM bronze""",
        "ingest_lag": f"""{BRONZE}, lags AS (SELECT channel, date_diff('second', traded_at, received_at) AS lag FROM silver)
            SELECT channel, count(*) AS trades, min(lag) AS min_lag_seconds, max(lag) AS max_lag_seconds,
            CAST(sum(lag) AS BIGINT) AS sum_lag_seconds FROM lags GROUP BY 1""",
        "channel_summary": f"""{BRONZE} SELECT channel, source_system, count(*) AS trades, CAST(sum(tonnes) AS DOUBLE) AS total_mt
            FROM silver GROUP BY ALL""",
        "gold_port_product": f"{BRONZE} SELECT * FROM gold",
        "gold_top": f"""{BRONZE} SELECT *, CAST(row_number() OVER (ORDER BY total_usd DESC, port, product) AS INTEGER) AS "rank"
            FROM (SELECT * FROM gold ORDER BY total_usd DESC, port, product LIMIT 10)""",
        "gold_reconcile": f"""{BRONZE}, cells AS (
              SELECT port, product, unnest(['trades', 'total_mt', 'total_usd', 'avg_price_usd_per_mt', 'vessels']) AS measure,
                unnest([CAST(trades AS DOUBLE), total_mt, total_usd, avg_price_usd_per_mt, CAST(vessels AS DOUBLE)]) AS gold_value
              FROM gold
            ) SELECT *, gold_value AS bronze_value, true AS agrees FROM cells""",
        # event queries
        "events_filtered": f"""{EVENTS} SELECT event_id, source_system, port, grade AS product, {double("tonnes")} AS quantity_mt,
            {double("round_even(usd, 2)")} AS total_usd, {iso("traded_at")} AS occurred_at_utc, strftime(traded_at, '%Y-%m-%d') AS dt
            FROM accepted WHERE source_system = 'erp' AND grade = 'VLSFO'
            AND traded_at BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1998-09-30 12:00:00'""",
        "events_page": f"{EVENTS} {page}",
        "events_deep_page": f"""{EVENTS} SELECT *, CAST(row_number() OVER (ORDER BY occurred_at_utc DESC, event_id) AS INTEGER) AS position FROM (
            SELECT event_id, {iso("traded_at")} AS occurred_at_utc, port, {double("tonnes")} AS quantity_mt FROM accepted
            ORDER BY traded_at DESC, event_id LIMIT 200 OFFSET 2000)""",
        "events_page_after": f"""{EVENTS} SELECT *, CAST(row_number() OVER (ORDER BY occurred_at_utc DESC, event_id) AS INTEGER) AS position FROM (
            SELECT event_id, {iso("traded_at")} AS occurred_at_utc, port, {double("tonnes")} AS quantity_mt FROM accepted
            WHERE traded_at < TIMESTAMP '1997-06-01 07:30:00' OR (traded_at = TIMESTAMP '1997-06-01 07:30:00' AND event_id > '8')
            ORDER BY traded_at DESC, event_id LIMIT 100)""",
        "events_page_info": f"""{EVENTS} SELECT count(*) AS "count", 500 AS "limit", 25 AS "offset" FROM ({page})""",
        # streaming
        "stream_ingest": stream_sql(),
        "stream_dedupe_window": f"""WITH RECURSIVE log AS (
              SELECT DISTINCT user_id || '-' || event_type AS id, CAST(ts AS TIMESTAMP) AS sent FROM events
            ), kept(id, sent) AS (
              SELECT id, min(sent) FROM log GROUP BY id
              UNION ALL
              SELECT l.id, min(l.sent) FROM kept k JOIN log l ON l.id = k.id AND l.sent > k.sent + INTERVAL 10 MINUTE GROUP BY l.id
            ) SELECT id AS message_id, {iso("sent")} AS enqueued_at FROM kept""",
        "stream_counts": f"""WITH {LINES}, {CHECKED}, sent AS (
              SELECT *, CASE {" ".join(f"WHEN arrival_day < {end} THEN {i}" for i, end in enumerate(RUN_ENDS))} ELSE {len(RUN_ENDS)} END AS run,
                l_partkey % 29 <> 0 AND l_partkey % 31 <> 0 AS is_record FROM checked
            ), numbered AS (
              SELECT *, row_number() OVER (PARTITION BY source_record_id, is_record AND is_valid ORDER BY run, arrival_seq) AS nth FROM sent
            ), told AS (
              SELECT run, unnest(['arrived', CASE WHEN NOT is_record THEN 'discarded' WHEN NOT is_valid THEN 'rejected'
                WHEN nth = 1 THEN 'accepted' ELSE 'duplicate' END]) AS measure FROM numbered
            ) SELECT CAST(run AS BIGINT) AS batch_id, 'Stream' AS channel, measure, count(*) AS n FROM told GROUP BY ALL""",
        "stream_all_channels": f"""{EVENTS} SELECT event_id, source_system,
            CASE source_system WHEN 'erp' THEN 'Batch' WHEN 'port-telemetry' THEN 'Stream' ELSE 'Api' END AS channel,
            {double("tonnes")} AS quantity_mt, {double("price")} AS price_usd_per_mt, strftime(traded_at, '%Y-%m-%d') AS dt,
            CAST(arrival_day >= {CUT_DAY} AS BIGINT) AS batch_id FROM accepted""",
        "gold_refresh": f"""{BRONZE}, changed AS (
              SELECT * REPLACE (CASE WHEN l_orderkey % 5 = 0 THEN 'XXMOV' ELSE port END AS port) FROM silver WHERE l_orderkey % 7 <> 0
            ) {GOLD.format("changed")}""",
        "bus_landing": f"""{EVENTS} SELECT event_id, strftime(traded_at, '%Y-%m-%d') AS dt,
            CAST(CASE WHEN substr(event_id, 2, 1) < '8' THEN 0 ELSE 1 END AS BIGINT) AS landed_batch,
            CAST(CASE WHEN substr(event_id, 2, 1) < '8' THEN 0 ELSE 1 END AS BIGINT) AS batch_id, port,
            {double("tonnes")} AS quantity_mt, {double("round_even(usd, 2)")} AS total_usd,
            {iso(f"TIMESTAMP '{AS_OF}'")} AS landed_at_utc
            FROM accepted WHERE substr(event_id, 1, 1) NOT IN ('0', '1', '2', 'a', 'b')""",
        "bus_landing_letters": f"""{EVENTS}, m AS (
              SELECT event_id, CASE substr(event_id, 1, 1) WHEN '0' THEN 'deserialization_failed' WHEN '1' THEN 'empty_payload'
                WHEN '2' THEN 'deserialization_failed' WHEN 'b' THEN 'MaxDeliveryCountExceeded' END AS reason FROM accepted
            ) SELECT CAST(b AS BIGINT) AS batch_id, reason, count(*) AS letters FROM m, (VALUES (0), (1)) v(b)
            WHERE reason IS NOT NULL AND (b = 1 OR substr(event_id, 2, 1) < '8') GROUP BY ALL""",
    }
    sql["silver_upsert"] = sql["silver_trades"]
    return {name: dedent(text).strip() for name, text in sql.items()}

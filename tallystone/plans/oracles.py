"""The registered queries as plain SQL over the same tables (DuckDB dialect)."""

from __future__ import annotations

# Views: name -> (SQL, views it reads).
_VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "trade_raw": (
        """
        SELECT 'U' || (l_suppkey % 3) AS account_id, CAST(l_partkey AS VARCHAR) AS instrument_id, l_partkey,
          'run-' || year(l_shipdate) AS ingestion_run_id,
          md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS DECIMAL(18,2)),
            CAST(l_extendedprice AS DECIMAL(18,2)), CAST(l_discount AS DECIMAL(18,2)), CAST(l_tax AS DECIMAL(18,2)),
            l_returnflag, l_linestatus, CAST(l_shipdate AS DATE))) AS source_raw_record_id,
          l_orderkey || '-' || l_linenumber AS ib_exec_id, CAST(l_orderkey AS VARCHAR) AS transaction_id,
          l_shipdate AS trade_timestamp_utc, CAST(l_shipdate AS DATE) AS report_date_local,
          CASE WHEN (l_linenumber + l_partkey + l_orderkey) % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side,
          CAST(CAST(l_quantity AS DECIMAL(18,2)) AS DECIMAL(24,8)) AS quantity,
          CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(24,8)) AS price,
          CAST(CAST(l_quantity AS DECIMAL(18,2)) * CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(24,8)) AS cost,
          CAST(CAST(l_quantity AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2)) AS DECIMAL(24,8)) AS commission,
          CAST(CAST(l_quantity AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(18,2)) AS DECIMAL(24,8)) AS fees,
          CAST(CAST(l_quantity AS DECIMAL(18,2)) * (CAST(l_discount AS DECIMAL(18,2)) - CAST(l_tax AS DECIMAL(18,2))) AS DECIMAL(24,8)) AS realized_pnl,
          CAST(CASE WHEN l_returnflag <> 'A' THEN CASE WHEN (l_linenumber + l_partkey + l_orderkey) % 2 = 0 THEN -1 ELSE 1 END
            * CAST(l_quantity AS DECIMAL(18,2)) * CAST(l_extendedprice AS DECIMAL(18,2)) END AS DECIMAL(24,8)) AS net_cash,
          CAST(CASE WHEN l_returnflag <> 'A' THEN CASE WHEN (l_linenumber + l_partkey + l_orderkey) % 2 = 0 THEN -1 ELSE 1 END
            * CAST(l_quantity AS DECIMAL(18,2)) * CAST(l_extendedprice AS DECIMAL(18,2))
            * [1.00, 0.50, 0.25, 2.00][l_partkey % 4 + 1] END AS DECIMAL(24,8)) AS net_cash_in_base,
          CAST(CASE WHEN l_returnflag <> 'N' THEN [1.00, 0.50, 0.25, 2.00][l_partkey % 4 + 1] END AS DECIMAL(24,10)) AS fx_rate_to_base,
          ['USD', 'EUR', 'ILS', 'JPY'][l_partkey % 4 + 1] AS currency, 'USD' AS functional_currency,
          l_tax, l_discount
        FROM lineitem""",
        (),
    ),
    "firsts": (
        """
        SELECT * FROM trade_raw QUALIFY row_number() OVER (
          PARTITION BY account_id, ib_exec_id ORDER BY trade_timestamp_utc, source_raw_record_id) = 1""",
        ("trade_raw",),
    ),
    "fills": (
        """
        SELECT account_id, instrument_id, ib_exec_id AS fill_id, trade_timestamp_utc, source_raw_record_id, report_date_local,
          side, CAST(quantity AS DECIMAL(18,2)) AS q, CAST(price AS DECIMAL(18,2)) AS px,
          CAST(l_tax AS DECIMAL(18,2)) + CAST(l_discount AS DECIMAL(18,2)) AS unit_fee,
          CAST(fees + commission AS DECIMAL(18,4)) AS fee, functional_currency, transaction_id
        FROM firsts""",
        ("firsts",),
    ),
    "positions": (
        """
        SELECT *, CASE side WHEN 'BUY' THEN q ELSE -q END AS sq,
          coalesce(sum(CASE side WHEN 'BUY' THEN q ELSE -q END) OVER (PARTITION BY account_id, instrument_id
            ORDER BY trade_timestamp_utc, source_raw_record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
        FROM fills""",
        ("fills",),
    ),
    "legs": (
        """
        SELECT *, q - close_q AS open_q FROM (
          SELECT *, CASE WHEN sign(pos) * sign(sq) < 0 THEN least(abs(pos), q) ELSE 0 END AS close_q FROM positions)""",
        ("positions",),
    ),
    "opens": (
        """
        SELECT *, CASE side WHEN 'BUY' THEN 'long' ELSE 'short' END AS direction,
          sum(open_q) OVER w AS hi, sum(open_q) OVER w - open_q AS lo
        FROM legs WHERE open_q > 0
        WINDOW w AS (PARTITION BY account_id, instrument_id, side ORDER BY trade_timestamp_utc, source_raw_record_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        ("legs",),
    ),
    "closes": (
        """
        SELECT *, CASE side WHEN 'BUY' THEN 'short' ELSE 'long' END AS direction,
          sum(close_q) OVER w AS hi, sum(close_q) OVER w - close_q AS lo
        FROM legs WHERE close_q > 0
        WINDOW w AS (PARTITION BY account_id, instrument_id, side ORDER BY trade_timestamp_utc, source_raw_record_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        ("legs",),
    ),
    "matches": (
        """
        SELECT account_id, instrument_id, direction, o.fill_id AS open_fill_id, c.fill_id AS close_fill_id,
          least(o.hi, c.hi) - greatest(o.lo, c.lo) AS m, o.px AS open_price, c.px AS close_price, o.unit_fee AS open_unit_fee,
          c.unit_fee AS close_unit_fee, c.trade_timestamp_utc AS closed_at
        FROM opens o JOIN closes c USING (account_id, instrument_id, direction)
        WHERE o.lo < c.hi AND c.lo < o.hi""",
        ("opens", "closes"),
    ),
    "match_pnl": (
        """
        SELECT *, CASE direction WHEN 'long' THEN (close_price - open_price - open_unit_fee) * m
          ELSE (open_price - open_unit_fee - close_price) * m END AS pnl FROM matches""",
        ("matches",),
    ),
    "lots": (
        """
        SELECT o.account_id, o.instrument_id, o.direction, o.fill_id, o.trade_timestamp_utc AS opened_at_utc, o.open_q,
          o.open_q - coalesce(sum(p.m), 0) AS remaining, o.px, o.unit_fee, coalesce(sum(p.pnl), 0) AS realized, max(p.closed_at) AS last_close
        FROM opens o LEFT JOIN match_pnl p ON p.account_id = o.account_id AND p.instrument_id = o.instrument_id
          AND p.direction = o.direction AND p.open_fill_id = o.fill_id
        GROUP BY o.account_id, o.instrument_id, o.direction, o.fill_id, o.trade_timestamp_utc, o.open_q, o.px, o.unit_fee""",
        ("opens", "match_pnl"),
    ),
    "realized": (
        """
        SELECT account_id, instrument_id, sum(r) AS realized FROM (
          SELECT account_id, instrument_id, pnl - close_unit_fee * m AS r FROM match_pnl) GROUP BY ALL""",
        ("match_pnl",),
    ),
    "net": (
        "SELECT account_id, instrument_id, sum(sq) AS position, max(report_date_local) AS last_day FROM positions GROUP BY ALL",
        ("positions",),
    ),
    "last_fill": (
        """
        SELECT account_id, instrument_id, px AS last_price, functional_currency FROM fills QUALIFY row_number() OVER (
          PARTITION BY account_id, instrument_id ORDER BY trade_timestamp_utc DESC, source_raw_record_id DESC, fill_id DESC) = 1""",
        ("fills",),
    ),
    "instruments": (
        """
        SELECT CAST(p_partkey AS VARCHAR) AS instrument_id, CAST(p_partkey AS VARCHAR) AS conid, p_name AS symbol,
          ['USD', 'EUR', 'ILS', 'JPY'][p_partkey % 4 + 1] AS currency, p_type AS description, p_size > 10 AS active FROM part""",
        (),
    ),
    "labels": (
        """
        SELECT instrument_id, md5(label_name) AS label_id, label_name FROM (
          SELECT CAST(p_partkey AS VARCHAR) AS instrument_id, unnest(['brand:' || p_brand, 'type:' || p_type]) AS label_name FROM part)""",
        (),
    ),
    "cash_raw": (
        """
        SELECT 'U' || (user_id % 3) AS account_id,
          CASE WHEN event_id % 10 <> 0 THEN CAST(event_id % 200 AS VARCHAR) END AS instrument_id,
          'run-' || strftime(ts, '%Y%m') AS ingestion_run_id, lpad(CAST(event_id AS VARCHAR), 14, '0') AS source_raw_record_id,
          user_id || '-' || (event_id % 7) AS transaction_id, event_type AS cash_action,
          CAST(timezone('Asia/Jerusalem', timezone('UTC', ts)) AS DATE) AS report_date_local, ts AS effective_at_utc,
          CAST(CAST(value AS DECIMAL(18,2)) AS DECIMAL(24,8)) AS amount, CAST(NULL AS DECIMAL(24,8)) AS amount_in_base,
          ['USD', 'EUR', 'ILS', 'JPY'][user_id % 4 + 1] AS currency, 'USD' AS functional_currency,
          CAST(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) END AS DECIMAL(24,8)) AS withholding_tax,
          CAST(CASE WHEN event_type = 'click' THEN CAST(value AS DECIMAL(18,2)) END AS DECIMAL(24,8)) AS fees, event_id
        FROM events""",
        (),
    ),
    "cash_ranked": (
        """
        SELECT *, row_number() OVER w AS nr, count(*) OVER (PARTITION BY account_id, transaction_id, cash_action, currency) AS n,
          coalesce(lag(amount) OVER w <> amount OR lag(report_date_local) OVER w <> report_date_local, false) AS changed
        FROM cash_raw
        WINDOW w AS (PARTITION BY account_id, transaction_id, cash_action, currency ORDER BY effective_at_utc, source_raw_record_id)""",
        ("cash_raw",),
    ),
    "cash_merged": (
        """
        SELECT l.account_id, l.transaction_id, l.cash_action, l.currency, l.ingestion_run_id, l.source_raw_record_id,
          l.report_date_local, l.effective_at_utc, l.amount, l.amount_in_base, l.withholding_tax, l.fees, l.functional_currency,
          k.instrument_id, k.is_correction
        FROM (SELECT * FROM cash_ranked WHERE nr = n) l JOIN (
          SELECT account_id, transaction_id, cash_action, currency, bool_or(changed) AS is_correction,
            arg_max(instrument_id, nr) FILTER (instrument_id IS NOT NULL) AS instrument_id
          FROM cash_ranked GROUP BY ALL) k USING (account_id, transaction_id, cash_action, currency)""",
        ("cash_ranked",),
    ),
    "cash_totals": (
        """
        SELECT account_id, instrument_id, sum(coalesce(fees, 0)) AS cash_fees, sum(coalesce(withholding_tax, 0)) AS withholding_tax
        FROM cash_merged WHERE instrument_id IS NOT NULL GROUP BY ALL""",
        ("cash_merged",),
    ),
    "valuations": (
        """
        SELECT n.account_id, n.instrument_id,
          CAST(n.position + CASE WHEN p.p_partkey % 5 = 0 THEN 1 ELSE 0 END AS DECIMAL(24,8)) AS position_qty,
          CAST(CAST(p.p_retailprice AS DECIMAL(18,2)) AS DECIMAL(24,8)) AS mark_price,
          CAST(CAST(p.p_retailprice AS DECIMAL(18,2)) * 2 AS DECIMAL(24,8)) AS broker_unrealized_pnl,
          n.last_day AS report_date_local, n.account_id || '-' || n.instrument_id || '-2' AS raw_record_id
        FROM net n JOIN part p ON CAST(p.p_partkey AS VARCHAR) = n.instrument_id
        WHERE p.p_partkey % 7 <> 0 AND p.p_partkey % 11 <> 0""",
        ("net",),
    ),
    # All fills lie before the snapshot date, which snapshot_fits checks.
    "snapshot": (
        """
        WITH held AS (
          SELECT n.account_id, n.instrument_id, n.position, coalesce(r.realized, 0) AS realized, l.lots, l.long_cost, f.fee
          FROM net n LEFT JOIN realized r USING (account_id, instrument_id)
          LEFT JOIN (SELECT account_id, instrument_id, count(*) AS lots,
            sum(CASE WHEN direction = 'long' THEN (px + unit_fee) * remaining ELSE 0 END) AS long_cost
            FROM lots WHERE remaining > 0 GROUP BY ALL) l USING (account_id, instrument_id)
          LEFT JOIN (SELECT account_id, instrument_id, sum(fee) AS fee FROM fills GROUP BY ALL) f USING (account_id, instrument_id)),
        cash AS (
          SELECT account_id, instrument_id, sum(coalesce(fees, 0)) AS cash_fees, sum(coalesce(withholding_tax, 0)) AS tax
          FROM cash_merged WHERE instrument_id IS NOT NULL AND report_date_local <= DATE '{date}' GROUP BY ALL),
        valued AS (
          SELECT h.*, coalesce(c.cash_fees, 0) AS cash_fees, coalesce(c.tax, 0) AS tax, v.broker_unrealized_pnl,
            CASE WHEN h.position = 0 THEN 'solid_no_open_position' WHEN v.position_qty IS NULL THEN 'missing_solid_broker_openpositions'
              WHEN v.position_qty <> h.position THEN 'missing_solid_position_mismatch' ELSE 'openpositions_fifo_unrealized' END AS source
          FROM held h LEFT JOIN cash c USING (account_id, instrument_id) LEFT JOIN valuations v USING (account_id, instrument_id))
        SELECT account_id, DATE '{date}' AS report_date_local, instrument_id, CAST(position AS DECIMAL(24,8)) AS position_qty,
          CAST(CASE WHEN lots > 0 THEN long_cost END AS DECIMAL(24,8)) AS cost_basis,
          CAST(realized - cash_fees - tax AS DECIMAL(24,8)) AS realized_pnl,
          CAST(CASE WHEN source = 'openpositions_fifo_unrealized' THEN broker_unrealized_pnl ELSE 0 END AS DECIMAL(24,8)) AS unrealized_pnl,
          CAST(realized - cash_fees - tax + CASE WHEN source = 'openpositions_fifo_unrealized' THEN broker_unrealized_pnl ELSE 0 END AS DECIMAL(24,8)) AS total_pnl,
          CAST(fee + cash_fees AS DECIMAL(24,8)) AS fees, CAST(tax AS DECIMAL(24,8)) AS withholding_tax, 'USD' AS currency,
          source LIKE 'missing%' AS provisional, source AS valuation_source, 'event_fx_fallback' AS fx_source, 'run-1' AS ingestion_run_id
        FROM valued""".replace("{date}", "2001-12-31"),
        ("net", "realized", "lots", "fills", "cash_merged", "valuations"),
    ),
    "fx_raw": (
        """
        SELECT 'U' || (o_custkey % 3) AS account_id, 'run-' || strftime(o_orderdate, '%Y%m') AS ingestion_run_id,
          lpad(CAST(o_orderkey AS VARCHAR), 14, '0') AS source_raw_record_id, CAST(o_orderkey % 1000 AS VARCHAR) AS transaction_id,
          CAST(o_orderdate AS DATE) AS report_date_local, ['EUR', 'ILS', 'JPY'][o_custkey % 3 + 1] AS currency,
          'USD' AS functional_currency,
          CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.00001 AS DECIMAL(6,5)) AS DECIMAL(24,10)) END AS fx_rate,
          o_orderkey
        FROM orders""",
        (),
    ),
    "actions_raw": (
        """
        SELECT 'U' || (o_custkey % 3) AS account_id, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_custkey % 200 AS VARCHAR) END AS instrument_id,
          CAST(o_custkey % 200 AS VARCHAR) AS conid, 'run-' || strftime(o_orderdate, '%Y%m') AS ingestion_run_id,
          lpad(CAST(o_orderkey AS VARCHAR), 14, '0') AS source_raw_record_id,
          CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 700 AS VARCHAR) END AS action_id,
          CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 400 AS VARCHAR) END AS transaction_id,
          ['FS', 'RS', 'SD', 'CD', 'SO', 'TC', 'RI', 'CH', 'GV', 'ZZ', 'IC'][o_orderkey % 11 + 1] AS reorg_code,
          CAST(date_trunc('month', o_orderdate) AS DATE) AS report_date_local,
          CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS description, false AS requires_manual, false AS provisional,
          CASE WHEN o_orderkey % 6 = 1 THEN 'case-' || o_orderkey END AS manual_case_id, o_orderkey
        FROM orders""",
        (),
    ),
    "classified": (
        """
        SELECT *, class = 'manual' OR (class = 'auto_if_unambiguous' AND description IS NULL) AS manual FROM (
          SELECT *, CASE WHEN reorg_code IN ('FS', 'RS', 'SD', 'CD')
            THEN 'auto_if_unambiguous' ELSE 'manual' END AS class FROM actions_raw)""",
        ("actions_raw",),
    ),
    "salted": (
        """
        SELECT *, CAST('0x' || substr(source_raw_record_id, 1, 4) AS INTEGER) AS salt FROM trade_raw""",
        ("trade_raw",),
    ),
    # Trade rows with the faults the raw layer carries, each as the reason it is rejected.
    "trade_rows": (
        """
        SELECT *, salt % 31 <> 0 AND salt % 61 <> 0 AND salt % 37 <> 0 AS routed,
          CASE WHEN salt % 31 = 0 THEN 'Trades:Order:ibExecID=' WHEN salt % 61 = 0 THEN 'Other:Trade:ibExecID=' ELSE 'Trades:Trade:ibExecID=' END || ib_exec_id AS row_ref,
          [CASE WHEN salt % 41 = 0 THEN {'field': 'conid', 'reason': 'a value is required', 'value': NULL} END,
           CASE WHEN salt % 43 = 0 THEN {'field': 'quantity', 'reason': 'no decimal number', 'value': 'abc'} END,
           CASE WHEN salt % 47 = 0 THEN {'field': 'tradePrice', 'reason': 'no decimal number', 'value': '-'} END,
           CASE WHEN salt % 53 = 0 THEN {'field': 'dateTime', 'reason': 'no date and time', 'value': 'yesterday'} END,
           CASE WHEN salt % 59 = 0 THEN {'field': 'reportDate', 'reason': 'no date in a known form', 'value': '2026-13-40'}
             WHEN salt % 4 = 0 AND salt % 67 = 0 THEN {'field': 'reportDate', 'reason': 'neither row nor statement has a date', 'value': NULL} END] AS faults
        FROM salted""",
        ("salted",),
    ),
    "cash_rows": (
        """
        SELECT *, 'CashTransactions:CashTransaction:transactionID=' || transaction_id AS row_ref,
          [CASE WHEN event_id % 29 = 0 THEN {'field': 'transactionID', 'reason': 'a value is required', 'value': ' '} END,
           CASE WHEN event_id % 31 = 0 THEN {'field': 'amount', 'reason': 'no decimal number', 'value': 'NaN'} END,
           CASE WHEN event_id % 37 = 0 THEN {'field': 'dateTime', 'reason': 'no date and time', 'value': '2026/02/14 10:00:00'} END] AS faults
        FROM cash_raw""",
        ("cash_raw",),
    ),
    "fx_rows": (
        """
        SELECT *, 'ConversionRates:ConversionRate:idx=' || (o_orderkey % 50) AS row_ref,
          [CASE WHEN o_orderkey % 41 = 0 THEN {'field': 'fromCurrency', 'reason': 'a value is required', 'value': ''} END,
           CASE WHEN o_orderkey % 43 = 0 THEN {'field': 'rate', 'reason': 'no decimal number', 'value': 'Infinity'} END] AS faults
        FROM fx_raw""",
        ("fx_raw",),
    ),
    "action_rows": (
        """
        SELECT *, o_orderkey % 53 <> 0 AS routed,
          CASE WHEN o_orderkey % 53 = 0 THEN 'CorporateActions:Summary:idx=' ELSE 'CorporateActions:CorporateAction:idx=' END || (o_orderkey % 50) AS row_ref,
          [CASE WHEN o_orderkey % 47 = 0 THEN {'field': 'type', 'reason': 'a value is required', 'value': NULL} END,
           CASE WHEN action_id IS NULL AND transaction_id IS NULL THEN {'field': 'actionID', 'reason': 'an action or transaction id is required', 'value': NULL} END] AS faults
        FROM actions_raw""",
        ("actions_raw",),
    ),
    "good_trades": ("SELECT * FROM trade_rows WHERE routed AND len(list_filter(faults, lambda f: f IS NOT NULL)) = 0", ("trade_rows",)),
    "good_cash": ("SELECT * FROM cash_rows WHERE len(list_filter(faults, lambda f: f IS NOT NULL)) = 0", ("cash_rows",)),
    "good_fx": ("SELECT * FROM fx_rows WHERE len(list_filter(faults, lambda f: f IS NOT NULL)) = 0", ("fx_rows",)),
    "good_actions": ("SELECT * FROM action_rows WHERE routed AND len(list_filter(faults, lambda f: f IS NOT NULL)) = 0", ("action_rows",)),
    "run_events": (
        """
        SELECT 'r-' || user_id || '-' || strftime(ts, '%Y%m%d') AS run_id, 'U' || (user_id % 3) AS account_id,
          ['scheduled', 'manual', 'reprocess'][user_id % 3 + 1] AS run_type, event_type AS stage,
          CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status, ts AS at_utc, event_id,
          CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
        FROM events""",
        (),
    ),
    "runs": (
        """
        SELECT run_id, any_value(account_id) AS account_id, any_value(run_type) AS run_type, min(at_utc) AS started_at_utc,
          max(at_utc) AS ended_at_utc, arg_max(stage, (at_utc, event_id)) AS last_stage, count(*) AS event_count,
          count(*) FILTER (status = 'failed') AS failed_count,
          arg_min(stage, (at_utc, event_id)) FILTER (status = 'failed') AS first_failed_stage,
          CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 'failed' ELSE 'success' END AS status,
          (epoch_us(max(at_utc)) - epoch_us(min(at_utc)) + 500) // 1000 AS duration_ms
        FROM run_events GROUP BY run_id""",
        ("run_events",),
    ),
    "statement_rows": (
        """
        SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS payload_id, o_custkey, o_orderdate,
          CASE WHEN o_orderkey % 29 = 0 THEN 'the payload is not well-formed XML' WHEN o_orderkey % 31 = 0 THEN 'the payload holds no statement'
            WHEN o_orderkey % 17 = 0 THEN 'the statement count differs from the statements found'
            WHEN o_orderkey % 19 = 0 THEN 'the statement count is blank' END AS reason
        FROM orders""",
        (),
    ),
    "sections": (
        """
        SELECT payload_id, list_sort(list_filter(['Trades', 'CashTransactions',
          CASE WHEN o_orderkey % 3 <> 0 THEN 'OpenPositions' END, CASE WHEN o_orderkey % 4 <> 0 THEN 'CorporateActions' END,
          CASE WHEN o_orderkey % 4 <> 0 THEN 'ConversionRates' END, CASE WHEN o_orderkey % 5 <> 0 THEN 'SecuritiesInfo' END,
          CASE WHEN o_orderkey % 5 <> 0 THEN 'AccountInformation' END, CASE WHEN o_orderkey % 2 = 0 THEN 'MTMPerformanceSummaryInBase' END,
          CASE WHEN o_orderkey % 7 = 0 THEN 'FIFOPerformanceSummaryInBase' END], lambda s: s IS NOT NULL)) AS present
        FROM statement_rows WHERE reason IS NULL""",
        ("statement_rows",),
    ),
}


def _needed(names: tuple[str, ...], seen: list[str]) -> list[str]:
    for name in names:
        if name not in seen:
            _needed(_VIEWS[name][1], seen)
            seen.append(name)
    return seen


def _with(sql: str, *views: str) -> str:
    parts = [f"{name} AS ({_VIEWS[name][0]})" for name in _needed(views, [])]
    return f"WITH {', '.join(parts)} {sql}" if parts else sql


_UNEVEN = """
  SELECT account_id, instrument_id, fill_id, trade_timestamp_utc, source_raw_record_id, report_date_local, side,
    CASE kind WHEN 0 THEN 0 WHEN 2 THEN q * 10000000000 WHEN 1 THEN q ELSE q + 0.5 END::DECIMAL(18,2) AS q,
    CASE kind WHEN 2 THEN 0.25 ELSE px END::DECIMAL(18,2) AS px, 0 AS unit_fee, cents
  FROM (SELECT account_id, instrument_id, ib_exec_id AS fill_id, trade_timestamp_utc, source_raw_record_id, report_date_local,
      CASE WHEN (l_orderkey * 7 + l_linenumber) % 11 = 0 THEN 'HOLD' ELSE side END AS side, (l_orderkey * 7 + l_linenumber) % 11 AS kind,
      CAST(quantity AS DECIMAL(18,2)) AS q, CAST(price AS DECIMAL(18,2)) AS px, l_orderkey % 97 + 1 AS cents
    FROM (SELECT *, split_part(ib_exec_id, '-', 1)::BIGINT AS l_orderkey, split_part(ib_exec_id, '-', 2)::BIGINT AS l_linenumber FROM firsts))"""

# Shares of fees are divided in integers: cents x units x 1e8 gives 16 places, rounded half up.
_UNEVEN_FEES = """
  , used AS (SELECT account_id, open_fill_id AS fill_id, m FROM matches UNION ALL SELECT account_id, close_fill_id, m FROM matches),
  shares AS (
    SELECT f.account_id, f.instrument_id,
      (2 * f.cents::HUGEINT * (u.m * 100)::HUGEINT * 100000000000000 + (f.q * 100)::HUGEINT) // (2 * (f.q * 100)::HUGEINT) AS share
    FROM fills f JOIN (SELECT account_id, fill_id, sum(m) AS m FROM used GROUP BY ALL) u USING (account_id, fill_id)),
  gains AS (
    SELECT account_id, instrument_id, sum(CASE direction WHEN 'long' THEN 1 ELSE -1 END * ((close_price - open_price) * 100)::HUGEINT * (m * 100)::HUGEINT) AS gain
    FROM matches GROUP BY ALL),
  total AS (
    SELECT n.account_id, n.instrument_id, n.fill_count, coalesce(g.gain, 0)::HUGEINT * 1000000000000 - coalesce(s.share, 0)::HUGEINT AS t
    FROM (SELECT account_id, instrument_id, count(*) AS fill_count FROM fills GROUP BY ALL) n LEFT JOIN gains g USING (account_id, instrument_id)
      LEFT JOIN (SELECT account_id, instrument_id, sum(share) AS share FROM shares GROUP BY ALL) s USING (account_id, instrument_id)),
  rounded AS (SELECT *, (abs(t) + 50000000) // 100000000 AS r FROM total)
  SELECT account_id, instrument_id, fill_count,
    CAST(CASE WHEN t < 0 AND r > 0 THEN '-' ELSE '' END || CAST(r // 100000000 AS VARCHAR) || '.' || lpad(CAST(r % 100000000 AS VARCHAR), 8, '0') AS DECIMAL(24,8)) AS realized_pnl
  FROM rounded"""


def _uneven() -> str:
    parts = [f"{name} AS ({_UNEVEN if name == 'fills' else _VIEWS[name][0]})" for name in _needed(("fills", "matches"), [])]
    return f"WITH {', '.join(parts)} {_UNEVEN_FEES}"


_UUID = """lower(concat_ws('-', substr({h}, 1, 8), substr({h}, 9, 4), '5' || substr({h}, 14, 3),
  translate(substr({h}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({h}, 18, 3), substr({h}, 21, 12)))"""
_NAMED = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({name}))"


def _uuid_of(name: str) -> str:
    return _UUID.replace("{h}", _NAMED.replace("{name}", name))


D = "DECIMAL(24,8)"

_SNAPSHOT_ID = "'snapshot:' || account_id || ':' || CAST(report_date_local AS VARCHAR) || ':' || instrument_id"


def oracle_queries() -> dict[str, str]:
    sqls = {
        "fifo_uneven_fees": _uneven(),
        "fifo_realized": _with(
            f"SELECT n.account_id, n.instrument_id, CAST(coalesce(r.realized, 0) AS {D}) AS realized_pnl, n.fill_count FROM (SELECT account_id, instrument_id, count(*) AS fill_count FROM fills GROUP BY ALL) n LEFT JOIN realized r USING (account_id, instrument_id)",
            "fills", "realized",
        ),
        "fifo_position": _with(f"SELECT account_id, instrument_id, CAST(position AS {D}) AS position_qty FROM net", "net"),
        "fifo_open_lots": _with(
            f"""SELECT account_id, instrument_id, fill_id AS open_event_trade_fill_id, direction, opened_at_utc, CAST(open_q AS {D}) AS open_quantity,
            CAST(remaining AS {D}) AS remaining_quantity, CAST(px AS {D}) AS open_price,
            CAST(CASE direction WHEN 'long' THEN (px + unit_fee) * open_q ELSE -(px - unit_fee) * open_q END AS {D}) AS cost_basis_open,
            CAST(realized AS {D}) AS realized_pnl_to_date, 'open' AS status FROM lots WHERE remaining > 0""",
            "lots",
        ),
        "position_lots": _with(
            f"""SELECT account_id, instrument_id, fill_id AS open_event_trade_fill_id, CASE WHEN remaining = 0 THEN last_close END AS closed_at_utc,
            CAST(realized AS {D}) AS realized_pnl_to_date, CASE WHEN remaining > 0 THEN 'open' ELSE 'closed' END AS status FROM lots""",
            "lots",
        ),
        "fifo_matches": _with(
            f"SELECT account_id, instrument_id, direction, open_fill_id, close_fill_id, CAST(m AS {D}) AS matched_quantity, CAST(open_price AS {D}) AS open_price, CAST(close_price AS {D}) AS close_price, CAST(pnl AS {D}) AS match_pnl FROM match_pnl",
            "match_pnl",
        ),
        "lot_ids": _with(f"SELECT account_id, instrument_id, fill_id, {_uuid_of('concat_ws(chr(58), account_id, instrument_id, fill_id)')} AS position_lot_id FROM fills", "fills"),
        "last_price": _with(f"SELECT account_id, instrument_id, CAST(last_price AS {D}) AS last_price, functional_currency FROM last_fill", "last_fill"),
        "fifo_unrealized_at_mark": _with(
            f"""SELECT n.account_id, n.instrument_id, CAST(n.position AS {D}) AS position_qty, CAST(f.last_price AS {D}) AS mark_price,
            CAST(coalesce(u.unrealized, 0) AS {D}) AS unrealized_pnl FROM net n JOIN last_fill f USING (account_id, instrument_id) LEFT JOIN (
              SELECT account_id, instrument_id, sum(CASE direction WHEN 'long' THEN (last_price - px - unit_fee) * remaining ELSE (px - unit_fee - last_price) * remaining END) AS unrealized
              FROM lots JOIN last_fill USING (account_id, instrument_id) WHERE remaining > 0 GROUP BY ALL) u USING (account_id, instrument_id)""",
            "net", "last_fill", "lots",
        ),
        "open_cost_basis": _with(
            f"""SELECT n.account_id, n.instrument_id, coalesce(l.lots, 0) AS open_lot_count, CAST(l.cost AS {D}) AS cost_basis FROM net n LEFT JOIN (
            SELECT account_id, instrument_id, count(*) AS lots, sum(CASE direction WHEN 'long' THEN (px + unit_fee) * remaining ELSE 0 END) AS cost
            FROM lots WHERE remaining > 0 GROUP BY ALL) l USING (account_id, instrument_id)""",
            "net", "lots",
        ),
        "fees_by_instrument": _with(f"SELECT account_id, instrument_id, CAST(sum(fee) AS {D}) AS trade_fees FROM fills GROUP BY ALL", "fills"),
        "cash_totals": _with(f"SELECT account_id, instrument_id, CAST(cash_fees AS {D}) AS cash_fees, CAST(withholding_tax AS {D}) AS withholding_tax FROM cash_totals", "cash_totals"),
        "valuation_latest": _with("SELECT * FROM valuations", "valuations"),
        "snapshot_daily": _with("SELECT * FROM snapshot", "snapshot"),
        "snapshot_counters": _with(
            "SELECT s.account_id, snapshot_row_count, coalesce(position_lot_row_count, 0) AS position_lot_row_count, missing_solid_valuation_count FROM (SELECT account_id, count(*) AS snapshot_row_count, count(*) FILTER (provisional) AS missing_solid_valuation_count FROM snapshot GROUP BY ALL) s LEFT JOIN (SELECT account_id, count(*) AS position_lot_row_count FROM lots WHERE remaining > 0 GROUP BY ALL) l USING (account_id)",
            "snapshot", "lots",
        ),
        "trade_merge": _with(
            """SELECT f.account_id, f.ib_exec_id, f.instrument_id, f.ingestion_run_id, f.source_raw_record_id, f.transaction_id, f.trade_timestamp_utc,
            f.report_date_local, f.side, f.quantity, f.price, f.fees, f.net_cash_in_base, f.fx_rate_to_base, f.currency, f.functional_currency,
            l.commission, l.realized_pnl, l.net_cash, l.cost FROM firsts f JOIN (SELECT * FROM trade_raw QUALIFY row_number() OVER (
              PARTITION BY account_id, ib_exec_id ORDER BY trade_timestamp_utc DESC, source_raw_record_id DESC) = 1) l USING (account_id, ib_exec_id)""",
            "firsts", "trade_raw",
        ),
        # The two loads split at a business date, which orders like the instant.
        "cashflow_merge": _with("SELECT * FROM cash_merged", "cash_merged"),
        "fx_merge": _with(
            """SELECT f.account_id, f.transaction_id, f.currency, f.functional_currency, f.ingestion_run_id, f.source_raw_record_id, l.report_date_local, l.fx_rate,
            'conversion_rates' AS fx_source, l.fx_rate IS NULL AS provisional, CASE WHEN l.fx_rate IS NULL THEN 'FX_RATE_MISSING_ALL_SOURCES' END AS diagnostic_code
            FROM (SELECT * FROM fx_raw QUALIFY row_number() OVER (PARTITION BY account_id, transaction_id, currency ORDER BY report_date_local, source_raw_record_id) = 1) f
            JOIN (SELECT * FROM fx_raw QUALIFY row_number() OVER (PARTITION BY account_id, transaction_id, currency ORDER BY report_date_local DESC, source_raw_record_id DESC) = 1) l
            USING (account_id, transaction_id, currency)""",
            "fx_raw",
        ),
        "corp_action_merge": _with(
            """SELECT f.account_id, f.action_id, f.conid, f.ingestion_run_id, f.source_raw_record_id, l.reorg_code, l.report_date_local, false AS requires_manual, false AS provisional,
              k.instrument_id, k.transaction_id, k.description, k.manual_case_id
            FROM (SELECT * FROM ranked WHERE action_id IS NOT NULL AND nr = 1) f JOIN (SELECT * FROM ranked WHERE action_id IS NOT NULL AND rn = 1) l USING (account_id, action_id)
            JOIN (SELECT account_id, action_id, arg_max(instrument_id, nr) FILTER (instrument_id IS NOT NULL) AS instrument_id,
              arg_max(transaction_id, nr) FILTER (transaction_id IS NOT NULL) AS transaction_id, arg_max(description, nr) FILTER (description IS NOT NULL) AS description,
              arg_max(manual_case_id, nr) FILTER (manual_case_id IS NOT NULL) AS manual_case_id FROM ranked WHERE action_id IS NOT NULL GROUP BY ALL) k USING (account_id, action_id)
            UNION ALL
            SELECT account_id, NULL, conid, arg_min(ingestion_run_id, source_raw_record_id), min(source_raw_record_id), reorg_code, report_date_local, count(*) > 1, count(*) > 1,
              arg_min_null(instrument_id, source_raw_record_id), transaction_id, arg_max(description, source_raw_record_id) FILTER (description IS NOT NULL),
              arg_min(manual_case_id, source_raw_record_id) FILTER (manual_case_id IS NOT NULL)
            FROM actions_raw WHERE action_id IS NULL AND transaction_id IS NOT NULL GROUP BY account_id, transaction_id, conid, report_date_local, reorg_code""".replace(
                "FROM ranked",
                "FROM (SELECT *, row_number() OVER (PARTITION BY account_id, action_id ORDER BY report_date_local, source_raw_record_id) AS nr, row_number() OVER (PARTITION BY account_id, action_id ORDER BY report_date_local DESC, source_raw_record_id DESC) AS rn FROM actions_raw) ranked",
            ),
            "actions_raw",
        ),
        "instrument_merge": _with(
            """SELECT account_id, conid, arg_max(symbol, nr) AS symbol, 'STK' AS asset_category, arg_max(currency, nr) AS currency,
              arg_max(local_symbol, nr) FILTER (local_symbol IS NOT NULL) AS local_symbol, arg_max(isin, nr) FILTER (isin IS NOT NULL) AS isin,
              CAST(NULL AS VARCHAR) AS cusip, arg_max(figi, nr) FILTER (figi IS NOT NULL) AS figi, arg_max(description, nr) FILTER (description IS NOT NULL) AS description
            FROM (
              SELECT *, trade_timestamp_utc >= TIMESTAMP '1998-01-01' AS nr FROM (
                SELECT t.account_id, t.instrument_id AS conid, p_name || ' ' || side AS symbol, currency, trade_timestamp_utc,
                  CASE WHEN gap % 2 = 0 THEN p_brand END AS local_symbol, CASE WHEN gap % 3 = 0 THEN 'ISIN-' || source_raw_record_id END AS isin,
                  CASE WHEN gap % 5 = 0 THEN 'FIGI-' || ib_exec_id END AS figi, CASE WHEN gap % 7 <> 0 THEN p_type END AS description
                FROM (SELECT *, CAST('0x' || substr(source_raw_record_id, 1, 2) AS INTEGER) AS gap FROM trade_raw) t JOIN part ON p_partkey = t.l_partkey
                QUALIFY row_number() OVER (PARTITION BY t.account_id, t.instrument_id, trade_timestamp_utc >= TIMESTAMP '1998-01-01'
                  ORDER BY trade_timestamp_utc DESC, source_raw_record_id DESC) = 1))
            GROUP BY account_id, conid""",
            "trade_raw",
        ),
        "raw_dedupe_counts": _with(
            """SELECT section_name, count(*) FILTER (late AND nr = 1) AS inserted_count, count(*) FILTER (late AND nr > 1) AS deduplicated_count
            FROM (SELECT *, row_number() OVER (PARTITION BY account_id, section_name, row_ref ORDER BY late) AS nr FROM (
              SELECT account_id, 'Trades' AS section_name, row_ref, trade_timestamp_utc >= TIMESTAMP '1998-01-01' AS late FROM trade_rows
              UNION ALL SELECT account_id, 'CashTransactions', row_ref, effective_at_utc >= TIMESTAMP '1998-01-01' FROM cash_rows
              UNION ALL SELECT account_id, 'ConversionRates', row_ref, report_date_local >= DATE '1998-01-01' FROM fx_rows
              UNION ALL SELECT account_id, 'CorporateActions', row_ref, report_date_local >= DATE '1998-01-01' FROM action_rows)) GROUP BY section_name""",
            "trade_rows", "cash_rows", "fx_rows", "action_rows",
        ),
        "artifact_dedupe": f"""SELECT doc_id, {_uuid_of("concat_ws(chr(58), 'artifact', source, lang, 'q1', sha256(text))")} AS raw_artifact_id, sha256(text) AS payload_sha256,
            row_number() OVER (PARTITION BY source, lang, sha256(text) ORDER BY doc_id) > 1 AS deduplicated FROM documents""",
        "map_trades": _with(
            f"""SELECT source_raw_record_id, account_id, ib_exec_id, instrument_id AS conid, side, quantity, price, currency,
            CASE salt % 3 WHEN 1 THEN trade_timestamp_utc - INTERVAL 2 HOUR ELSE trade_timestamp_utc END AS trade_timestamp_utc, report_date_local,
            CASE WHEN salt % 5 <> 0 THEN commission END AS commission, fees, fx_rate_to_base,
            CASE WHEN salt % 7 = 0 THEN instrument_id ELSE 'S' || instrument_id END AS symbol, 'STK' AS asset_category,
            CASE WHEN salt % 2 = 0 THEN 'first' ELSE 'second' END AS instrument_description FROM good_trades""",
            "good_trades",
        ),
        "map_cashflows": _with(
            """SELECT 'c' || source_raw_record_id AS source_raw_record_id, account_id, transaction_id, cash_action, instrument_id AS conid, instrument_id AS symbol, amount, currency,
            date_trunc('second', effective_at_utc) AS effective_at_utc, report_date_local, withholding_tax, fees FROM good_cash""",
            "good_cash",
        ),
        "map_fx": _with(
            """SELECT 'f' || source_raw_record_id AS source_raw_record_id, account_id, CASE WHEN o_orderkey % 3 = 0 THEN row_ref ELSE transaction_id END AS transaction_id, report_date_local,
            currency, functional_currency, fx_rate, 'conversion_rates' AS fx_source, fx_rate IS NULL AS provisional,
            CASE WHEN fx_rate IS NULL THEN 'FX_RATE_MISSING_ALL_SOURCES' END AS diagnostic_code FROM good_fx""",
            "good_fx",
        ),
        "map_corp_actions": _with(
            "SELECT 'a' || source_raw_record_id AS source_raw_record_id, account_id, action_id, transaction_id, conid, reorg_code, report_date_local, 'USD' AS currency, description, false AS requires_manual FROM good_actions",
            "good_actions",
        ),
        "map_violations": _with(
            """SELECT raw_record_id, section_name, row_ref AS source_row_ref, fault.field AS field, fault.reason AS reason, fault.value AS value FROM (
              SELECT source_raw_record_id AS raw_record_id, 'Trades' AS section_name, row_ref, unnest(faults) AS fault FROM trade_rows WHERE routed
              UNION ALL SELECT 'c' || source_raw_record_id, 'CashTransactions', row_ref, unnest(faults) FROM cash_rows
              UNION ALL SELECT 'f' || source_raw_record_id, 'ConversionRates', row_ref, unnest(faults) FROM fx_rows
              UNION ALL SELECT 'a' || source_raw_record_id, 'CorporateActions', row_ref, unnest(faults) FROM action_rows WHERE routed) WHERE fault IS NOT NULL""",
            "trade_rows", "cash_rows", "fx_rows", "action_rows",
        ),
        "row_tag_route": _with(
            """SELECT section_name, destination, count(*) AS row_count FROM (
              SELECT 'Trades' AS section_name, CASE WHEN routed THEN 'trade' ELSE 'raw_only' END AS destination FROM trade_rows
              UNION ALL SELECT 'CashTransactions', 'cashflow' FROM cash_rows UNION ALL SELECT 'ConversionRates', 'fx' FROM fx_rows
              UNION ALL SELECT 'CorporateActions', CASE WHEN routed THEN 'corp_action' ELSE 'raw_only' END FROM action_rows) GROUP BY ALL""",
            "trade_rows", "cash_rows", "fx_rows", "action_rows",
        ),
        "batch_counters": _with(
            """SELECT 'trade_fill_count' AS counter, count(*) AS n FROM good_trades UNION ALL SELECT 'cashflow_count', count(*) FROM good_cash
            UNION ALL SELECT 'fx_count', count(*) FROM good_fx UNION ALL SELECT 'corp_action_count', count(*) FROM good_actions
            UNION ALL SELECT 'instrument_upsert_count', count(*) FROM (SELECT account_id, instrument_id FROM good_trades
              UNION SELECT account_id, instrument_id FROM good_cash WHERE instrument_id IS NOT NULL UNION SELECT account_id, conid FROM good_actions)""",
            "good_trades", "good_cash", "good_fx", "good_actions",
        ),
        "resolved_events": _with(
            """SELECT account_id, 'trade' AS kind, count(*) AS event_count, count(instrument_id) AS resolved_count FROM good_trades GROUP BY ALL
            UNION ALL SELECT account_id, 'cashflow', count(*), count(instrument_id) FROM good_cash GROUP BY ALL
            UNION ALL SELECT account_id, 'corp_action', count(*), count(conid) FROM good_actions GROUP BY ALL""",
            "good_trades", "good_cash", "good_actions",
        ),
        "xml_rows": _with(
            """SELECT payload_id, r.s AS section_name, r.ref AS source_row_ref, r.a AS attributes FROM (
              SELECT payload_id, unnest([
                {'s': 'Trades', 'ref': 'Trades:Trade:transactionID=' || o_orderkey, 'a': 'conid=' || o_custkey || ';currency=USD;transactionID=' || o_orderkey},
                {'s': 'Trades', 'ref': 'Trades:Lot:idx=2', 'a': 'currency=EUR;qty=1'},
                {'s': 'Trades', 'ref': 'Trades:Lot:idx=3', 'a': 'currency=ILS;qty=2'},
                {'s': 'CashTransactions', 'ref': 'CashTransactions:section:1', 'a': 'note=none'},
                CASE WHEN o_orderkey % 3 <> 0 THEN {'s': 'OpenPositions', 'ref': 'OpenPositions:OpenPosition:idx=1', 'a': 'conid=' || o_custkey} END,
                CASE WHEN o_orderkey % 4 <> 0 THEN {'s': 'CorporateActions', 'ref': 'CorporateActions:section:1', 'a': ''} END,
                CASE WHEN o_orderkey % 4 <> 0 THEN {'s': 'ConversionRates', 'ref': 'ConversionRates:section:1', 'a': ''} END,
                CASE WHEN o_orderkey % 5 <> 0 THEN {'s': 'SecuritiesInfo', 'ref': 'SecuritiesInfo:section:1', 'a': ''} END,
                CASE WHEN o_orderkey % 5 <> 0 THEN {'s': 'AccountInformation', 'ref': 'AccountInformation:section:1', 'a': ''} END,
                CASE WHEN o_orderkey % 2 = 0 THEN {'s': 'MTMPerformanceSummaryInBase', 'ref': 'MTMPerformanceSummaryInBase:section:1', 'a': ''} END,
                CASE WHEN o_orderkey % 7 = 0 THEN {'s': 'FIFOPerformanceSummaryInBase', 'ref': 'FIFOPerformanceSummaryInBase:section:1', 'a': ''} END]) AS r
              FROM statement_rows WHERE reason IS NULL) WHERE r IS NOT NULL""",
            "statement_rows",
        ),
        "xml_rejected": _with("SELECT payload_id, reason FROM statement_rows WHERE reason IS NOT NULL", "statement_rows"),
        "statement_dates": _with("SELECT payload_id, CAST(o_orderdate AS DATE) AS report_date_local FROM statement_rows WHERE reason IS NULL", "statement_rows"),
        "required_sections": _with(
            """SELECT payload_id, array_to_string(present, ',') AS detected_sections, array_to_string(hard, ',') AS missing_hard_required,
            array_to_string(recon, ',') AS missing_reconciliation_required, array_to_string(list_sort(hard || recon), ',') AS missing_sections, len(hard) + len(recon) = 0 AS is_valid
            FROM (SELECT *, list_filter(['AccountInformation', 'CashTransactions', 'ConversionRates', 'CorporateActions', 'OpenPositions', 'SecuritiesInfo', 'Trades'], lambda s: NOT list_contains(present, s)) AS hard,
              list_filter(['FIFOPerformanceSummaryInBase', 'MTMPerformanceSummaryInBase'], lambda s: NOT list_contains(present, s)) AS recon FROM sections)""",
            "sections",
        ),
        "parse_dates": "SELECT o_orderkey, CAST(o_orderkey % 11 AS INTEGER) AS form, CASE WHEN o_orderkey % 11 <> 7 THEN CAST(o_orderdate AS DATE) END AS parsed_date FROM orders",
        "parse_timestamps": """SELECT event_id, CAST(event_id % 10 AS INTEGER) AS form, CASE event_id % 10 WHEN 3 THEN date_trunc('second', ts) - INTERVAL 2 HOUR
            WHEN 4 THEN date_trunc('minute', ts) + INTERVAL 5 HOUR WHEN 5 THEN date_trunc('minute', ts) + INTERVAL 4 HOUR WHEN 6 THEN NULL
            WHEN 7 THEN ts WHEN 9 THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END AS parsed_at FROM events""",
        "parse_decimals": f"""SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 7 = 1 THEN -v WHEN o_orderkey % 7 IN (2, 3, 5) THEN NULL
            WHEN o_orderkey % 7 = 4 THEN v * 100 ELSE v END AS {D}) AS parsed_value FROM (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders)""",
        "optional_texts": """SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN o_orderpriority END AS normalized,
            CASE o_orderkey % 6 WHEN 0 THEN '-' WHEN 1 THEN '--' WHEN 2 THEN 'N/A' WHEN 5 THEN o_orderpriority END AS required FROM orders""",
        "business_date": "SELECT event_id, CAST(timezone('Asia/Jerusalem', timezone('UTC', ts)) AS DATE) AS report_date_local, strftime(ts, '%Y-%m-%d') AS period_key FROM events",
        "business_date_range": """SELECT event_type, count(*) AS event_count, min(event_id) AS first_id, max(event_id) AS last_id FROM events
            WHERE CAST(timezone('Asia/Jerusalem', timezone('UTC', ts)) AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-02-05' GROUP BY event_type""",
        "snapshot_list": _with(
            f"SELECT account_id, instrument_id, report_date_local, total_pnl, {_uuid_of(_SNAPSHOT_ID)} AS pnl_snapshot_daily_id FROM snapshot WHERE account_id = 'U1' ORDER BY total_pnl DESC, report_date_local DESC, instrument_id LIMIT 200 OFFSET 10",
            "snapshot",
        ),
        "snapshot_json": _with(
            """SELECT '{"instrument_id":"' || instrument_id || '","report_date_local":"' || report_date_local || '","position_qty":"' || position_qty || '","cost_basis":'
            || coalesce('"' || cost_basis || '"', 'null') || ',"provisional":' || provisional || ',"account_id":"' || account_id || '"}' AS item FROM snapshot""",
            "snapshot",
        ),
        "run_state": _with("SELECT * FROM runs", "runs"),
        "run_list": _with("SELECT run_id AS ingestion_run_id, status, started_at_utc, ended_at_utc, duration_ms FROM runs ORDER BY duration_ms DESC, run_id DESC LIMIT 100 OFFSET 5", "runs"),
        "run_filters": _with(
            """SELECT run_id AS ingestion_run_id, started_at_utc, run_type, status, count(*) OVER () AS total, count(*) OVER () > 50 AS has_more FROM runs
            WHERE status = 'success' AND run_type = 'manual' AND started_at_utc BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-02-20'
            ORDER BY started_at_utc DESC, run_id DESC LIMIT 50""",
            "runs",
        ),
        "instrument_list": _with(
            """SELECT instrument_id, conid, symbol, description FROM instruments WHERE active AND description = 'ECONOMY'
            AND (symbol ILIKE '%ring%' OR conid ILIKE '%ring%' OR description ILIKE '%ring%') ORDER BY symbol DESC, instrument_id DESC LIMIT 60""",
            "instruments",
        ),
        "note_list": """SELECT lpad(CAST(o_orderkey AS VARCHAR), 14, '0') AS note_id, CAST(o_custkey % 200 AS VARCHAR) AS instrument_id,
            CASE WHEN o_orderkey % 4 = 0 THEN md5('brand:Brand#' || (o_orderkey % 25 + 1)) END AS label_id, o_orderpriority AS content, o_orderdate AS created_at_utc, o_orderdate AS updated_at_utc
            FROM orders WHERE o_orderkey % 3 <> 0 AND o_custkey % 200 = 17 AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2001-06-30'
            ORDER BY created_at_utc DESC, note_id DESC LIMIT 120""",
        "timeline_last_stage": _with(
            "SELECT run_id, event_id, at_utc, k FROM run_events WHERE stage = 'purchase' AND status = 'completed' QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY at_utc DESC, event_id DESC) = 1",
            "run_events",
        ),
        "missing_sections": _with(
            """SELECT event_id, CASE WHEN k % 3 = 0 THEN 'Trades,' || k ELSE '' END AS missing_sections, CASE WHEN k % 3 = 0 THEN 'Trades' ELSE '' END AS missing_hard_required,
            CASE WHEN k % 6 = 0 THEN CAST(k AS VARCHAR) ELSE '' END AS missing_reconciliation_required FROM run_events""",
            "run_events",
        ),
        "canonical_details": _with(
            """SELECT event_id, CASE WHEN k % 5 = 0 THEN CAST(k + 1000 AS VARCHAR) WHEN k % 2 = 0 AND status = 'completed' THEN CAST(k AS VARCHAR) END AS canonical_input_row_count,
            CASE WHEN k = 0 THEN 'no_new_raw_rows_for_run' END AS canonical_skip_reason FROM run_events""",
            "run_events",
        ),
        "error_codes": _with(
            """SELECT event_id, CAST(1000 + k % 25 AS VARCHAR) AS status_code, coalesce(m.message, 'unknown') AS message,
            CASE WHEN 1000 + k % 25 IN (1009, 1018, 1019) THEN 'retryable' WHEN 1000 + k % 25 IN (1012, 1015) THEN 'token' WHEN m.code IS NOT NULL THEN 'fatal' END AS status_class,
            CASE WHEN 1000 + k % 25 = 1018 THEN 10 ELSE 5 END AS delay_seconds,
            ['INGESTION_TOKEN_EXPIRED_ERROR', 'INGESTION_TOKEN_INVALID_ERROR', 'INGESTION_REQUEST_ERROR', 'INGESTION_STATEMENT_ERROR', 'INGESTION_TIMEOUT_ERROR', 'INGESTION_CONNECTION_ERROR', 'INGESTION_CONTRACT_ERROR', 'INGESTION_UNEXPECTED_ERROR'][k % 8 + 1] AS ingest_code,
            ['REPROCESS_REQUEST_ERROR', 'REPROCESS_REQUEST_ERROR', 'REPROCESS_REQUEST_ERROR', 'REPROCESS_STATEMENT_ERROR', 'REPROCESS_TIMEOUT_ERROR', 'REPROCESS_CONNECTION_ERROR', 'REPROCESS_CONTRACT_ERROR', 'REPROCESS_UNEXPECTED_ERROR'][k % 8 + 1] AS replay_code
            FROM run_events LEFT JOIN (VALUES __MESSAGES__) m(code, message) ON m.code = CAST(1000 + k % 25 AS VARCHAR) WHERE status = 'failed'""",
            "run_events",
        ).replace("__MESSAGES__", _message_rows()),
        "latest_run": _with("SELECT run_id, started_at_utc, status FROM runs ORDER BY started_at_utc DESC, run_id DESC LIMIT 1", "runs"),
        "slo_success_rate": _with(
            """SELECT d.account_id, d.run_date, count(*) AS runs_30d, count(*) FILTER (r.status = 'success') AS successes_30d,
            count(*) FILTER (r.status = 'success') * 100 >= count(*) * 99 AS meets_target, count(*) FILTER (r.status = 'success') * 100 < count(*) * 98 AS is_breach
            FROM (SELECT DISTINCT account_id, CAST(started_at_utc AS DATE) AS run_date FROM runs) d
            JOIN runs r ON r.account_id = d.account_id AND CAST(r.started_at_utc AS DATE) BETWEEN d.run_date - 29 AND d.run_date GROUP BY d.account_id, d.run_date""",
            "runs",
        ),
        "slo_p95": _with(
            """SELECT d.account_id, d.run_date, count(*) AS runs_14d, CAST(quantile_cont(r.duration_ms, 0.95) AS DECIMAL(18,2)) AS p95_ms, max(r.duration_ms) AS max_ms,
            quantile_cont(r.duration_ms, 0.95) > 900000 AS misses_target, max(r.duration_ms) > 1800000 AS is_breach
            FROM (SELECT DISTINCT account_id, CAST(started_at_utc AS DATE) AS run_date FROM runs) d
            JOIN runs r ON r.account_id = d.account_id AND CAST(r.started_at_utc AS DATE) BETWEEN d.run_date - 13 AND d.run_date GROUP BY d.account_id, d.run_date""",
            "runs",
        ),
        "retention_split": _with(
            """SELECT CASE WHEN old THEN 'archive' ELSE 'hot' END AS retention_class, CASE WHEN old THEN strftime(at_utc, '%Y-%m') END AS archive_month,
            count(*) AS event_count, min(at_utc) AS first_at, max(at_utc) AS last_at FROM (SELECT *, CAST(at_utc AS DATE) < DATE '2024-04-01' - 60 AS old FROM run_events) GROUP BY ALL""",
            "run_events",
        ),
        "dq_rules": _with(
            """, lots_of_orders AS (SELECT CASE WHEN o_orderkey % 13 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE o_custkey || ':' || o_orderkey % 500 || ':' || strftime(o_orderdate, '%Y-%m-%d') END AS id, o_orderkey FROM orders),
            files AS (SELECT o_custkey % 3 AS a, CASE WHEN o_orderkey % 23 = 0 THEN '2026-02-30' WHEN o_orderkey % 29 = 0 THEN strftime(o_orderdate, '%Y%m%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS p,
              o_orderkey % 31 = 0 AS q, o_orderkey % 50 AS h, o_orderkey FROM orders),
            raw AS (SELECT account_id, ingestion_run_id, 'Trades' AS s, row_ref FROM trade_rows UNION ALL SELECT account_id, ingestion_run_id, 'CashTransactions', row_ref FROM cash_rows
              UNION ALL SELECT account_id, ingestion_run_id, 'ConversionRates', row_ref FROM fx_rows UNION ALL SELECT account_id, ingestion_run_id, 'CorporateActions', row_ref FROM action_rows)
            SELECT 'event_trade_fill' AS table_name, unnest(['side_allowed', 'account_id_not_blank', 'ib_exec_id_not_blank', 'quantity_in_range', 'price_in_range']) AS rule, 0 AS violation_count
            UNION ALL SELECT 'event_cashflow', unnest(['account_id_not_blank', 'transaction_id_not_blank', 'cash_action_not_blank', 'currency_not_blank']), 0
            UNION ALL SELECT 'event_fx', unnest(['account_id_not_blank', 'transaction_id_not_blank', 'currency_not_blank', 'functional_currency_not_blank']), 0
            UNION ALL SELECT 'instrument', unnest(['account_id_not_blank', 'conid_not_blank', 'asset_category_not_blank', 'currency_not_blank']), 0
            UNION ALL SELECT 'raw_record', unnest(['section_name_not_blank', 'source_row_ref_not_blank']), 0
            UNION ALL SELECT 'event_corp_action', 'action_id_or_transaction_id_present', count(*) FROM actions_raw WHERE action_id IS NULL AND transaction_id IS NULL
            UNION ALL SELECT 'note', 'instrument_id_or_label_id_present', count(*) FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0
            UNION ALL SELECT 'ingestion_run', unnest(['status_allowed', 'run_type_allowed']), 0
            UNION ALL SELECT 'position_lot', 'status_allowed', count(*) FROM lots_of_orders WHERE o_orderkey % 17 = 0
            UNION ALL SELECT 'position_lot', 'remaining_quantity_not_negative', count(*) FROM lots_of_orders WHERE o_orderkey % 19 = 0
            UNION ALL SELECT 'position_lot', 'position_lot_id_is_uuid', count(*) FROM lots_of_orders WHERE o_orderkey % 13 = 0
            UNION ALL SELECT 'raw_artifact', 'account_id_not_blank', 0
            UNION ALL SELECT 'raw_artifact', 'period_key_is_date', count(*) FROM files WHERE o_orderkey % 23 = 0 OR o_orderkey % 29 = 0
            UNION ALL SELECT 'raw_artifact', 'flex_query_id_not_blank', count(*) FROM files WHERE q
            UNION ALL SELECT 'raw_artifact', 'payload_sha256_not_blank', count(*) FROM files WHERE o_orderkey % 37 = 0
            UNION ALL SELECT 'raw_artifact', 'unique_account_id_period_key_flex_query_id_payload_sha256', count(*) - count(DISTINCT (a, p, q, h)) FROM files WHERE o_orderkey % 37 <> 0
            UNION ALL SELECT 'raw_record', 'unique_raw_artifact_id_section_name_source_row_ref_statement_index', count(*) - count(DISTINCT (account_id, ingestion_run_id, s, row_ref)) FROM raw
            UNION ALL SELECT 'instrument', 'unique_account_id_conid', count(*) - count(DISTINCT (account_id, instrument_id)) FROM trade_raw
            UNION ALL SELECT 'pnl_snapshot_daily', 'unique_account_id_report_date_local_instrument_id', count(*) - count(DISTINCT (account_id, report_date_local, instrument_id)) FROM trade_raw
            UNION ALL SELECT 'position_lot', 'unique_position_lot_id', count(*) - count(DISTINCT id) FROM lots_of_orders
            UNION ALL SELECT 'event_fx', 'unique_account_id_transaction_id_currency_functional_currency', count(*) - count(DISTINCT (account_id, transaction_id, currency)) FROM fx_raw
            UNION ALL SELECT 'event_cashflow', 'unique_account_id_transaction_id_cash_action_currency', count(*) - count(DISTINCT (account_id, transaction_id, cash_action, currency)) FROM cash_raw
            UNION ALL SELECT 'event_trade_fill', 'unique_account_id_ib_exec_id', count(*) - count(DISTINCT (account_id, ib_exec_id)) FROM trade_raw
            UNION ALL SELECT 'event_trade_fill', 'unique_account_id_source_raw_record_id', count(*) - count(DISTINCT (account_id, source_raw_record_id)) FROM trade_raw
            UNION ALL SELECT 'event_corp_action', 'unique_account_id_action_id', count(*) - count(DISTINCT (account_id, action_id)) FROM actions_raw WHERE action_id IS NOT NULL
            UNION ALL SELECT 'event_corp_action', 'unique_account_id_transaction_id', count(*) - count(DISTINCT (account_id, transaction_id)) FROM actions_raw WHERE transaction_id IS NOT NULL
            UNION ALL SELECT 'event_cashflow', 'instrument_id_exists', count(*) FROM cash_raw WHERE instrument_id IS NOT NULL AND instrument_id NOT IN (SELECT instrument_id FROM instruments WHERE active)
            UNION ALL SELECT 'event_trade_fill', 'instrument_id_exists', count(*) FROM trade_raw WHERE instrument_id NOT IN (SELECT instrument_id FROM instruments)""",
            "trade_raw", "actions_raw", "cash_raw", "instruments", "fx_raw", "trade_rows", "cash_rows", "fx_rows", "action_rows",
        ).replace(" , lots_of_orders", ", lots_of_orders", 1),
        "eod_mark": _with(
            f"""WITH asked AS (SELECT DISTINCT account_id, instrument_id, unnest([report_date_local, last_day(report_date_local), last_day(report_date_local) - 31]) AS report_date_local FROM firsts),
            ranked AS (SELECT account_id, instrument_id, report_date_local, price, CASE WHEN fx_rate_to_base IS NOT NULL AND net_cash IS NOT NULL THEN price + 1 END AS close_price,
              (trade_timestamp_utc, CAST(transaction_id AS BIGINT), source_raw_record_id) AS place FROM firsts)
            SELECT a.account_id, a.instrument_id, a.report_date_local, CAST(coalesce(v.mark_price, c.close_price, l.price) AS {D}) AS mark_price,
              CASE WHEN v.mark_price IS NOT NULL THEN 'open_position_mark' WHEN c.close_price IS NOT NULL THEN 'trade_close_price' WHEN l.price IS NOT NULL THEN 'last_trade_price' END AS mark_source,
              v.mark_price IS NULL AND c.close_price IS NULL AS provisional,
              CASE WHEN v.mark_price IS NOT NULL OR c.close_price IS NOT NULL THEN NULL WHEN l.price IS NOT NULL THEN 'EOD_MARK_FALLBACK_LAST_TRADE' ELSE 'EOD_MARK_MISSING_ALL_SOURCES' END AS diagnostic_code
            FROM asked a LEFT JOIN valuations v USING (account_id, instrument_id, report_date_local)
            LEFT JOIN (SELECT account_id, instrument_id, report_date_local, arg_max(close_price, place) AS close_price FROM ranked WHERE close_price IS NOT NULL GROUP BY ALL) c USING (account_id, instrument_id, report_date_local)
            LEFT JOIN (SELECT a.account_id, a.instrument_id, a.report_date_local, arg_max(r.price, r.place) AS price FROM asked a JOIN ranked r ON r.account_id = a.account_id AND r.instrument_id = a.instrument_id
              AND r.report_date_local <= a.report_date_local GROUP BY ALL) l USING (account_id, instrument_id, report_date_local)""".replace("WITH asked", ", asked", 1),
            "firsts", "valuations",
        ).replace(" , asked", ", asked", 1),
        "fx_fallback": _with(
            """SELECT account_id, ib_exec_id, t.currency, t.functional_currency, t.report_date_local, CAST(CASE source WHEN 'trade_fx_rate' THEN fx_rate_to_base
              WHEN 'net_cash_ratio' THEN [1.00, 0.50, 0.25, 2.00][l_partkey % 4 + 1] WHEN 'conversion_rate' THEN r_rate WHEN 'base_currency' THEN 1 END AS DECIMAL(24,10)) AS economic_fx_rate,
              source AS fx_source, CASE WHEN source = 'conversion_rate' THEN r_date END AS rate_date, source IS NULL AS provisional,
              CASE WHEN source IS NULL THEN 'FX_RATE_MISSING_ALL_SOURCES' END AS diagnostic_code
            FROM (SELECT f.*, r.fx_rate AS r_rate, r.report_date_local AS r_date, CASE WHEN f.fx_rate_to_base IS NOT NULL THEN 'trade_fx_rate' WHEN f.net_cash IS NOT NULL THEN 'net_cash_ratio'
              WHEN r.fx_rate IS NOT NULL THEN 'conversion_rate' WHEN f.currency = f.functional_currency THEN 'base_currency' END AS source
              FROM firsts f ASOF LEFT JOIN (SELECT * FROM fx_raw WHERE fx_rate IS NOT NULL QUALIFY row_number() OVER (PARTITION BY currency, report_date_local ORDER BY ingestion_run_id DESC, source_raw_record_id DESC) = 1) r
              ON f.currency = r.currency AND f.report_date_local >= r.report_date_local) t""",
            "firsts", "fx_raw",
        ),
        "corp_action_class": _with("SELECT source_raw_record_id, reorg_code, class AS action_class, manual AS requires_manual, manual AS provisional FROM classified", "classified"),
        "provisional_scope": _with(
            """SELECT s.account_id, s.instrument_id, s.provisional OR coalesce(u.n, 0) > 0 AS provisional, coalesce(u.n, 0) AS unresolved_case_count FROM snapshot s LEFT JOIN (
              SELECT account_id, instrument_id, count(*) AS n FROM classified c WHERE manual AND instrument_id IS NOT NULL AND NOT (reorg_code = 'TC' AND manual_case_id IS NOT NULL)
              GROUP BY ALL) u USING (account_id, instrument_id)""",
            "snapshot", "classified",
        ),
        "pnl_by_instrument": _with(
            "SELECT s.report_date_local, instrument_id, i.conid, i.symbol, s.currency, position_qty, cost_basis, realized_pnl, unrealized_pnl, total_pnl, provisional FROM snapshot s JOIN instruments i USING (instrument_id)",
            "snapshot", "instruments",
        ),
        "pnl_by_label": _with(
            f"""SELECT report_date_local, label_id, label_name, CAST(count(DISTINCT instrument_id) AS INTEGER) AS instrument_count, CAST(sum(realized_pnl) AS {D}) AS realized_pnl,
            CAST(sum(unrealized_pnl) AS {D}) AS unrealized_pnl, CAST(sum(total_pnl) AS {D}) AS total_pnl, CAST(sum(fees) AS {D}) AS fees, CAST(sum(withholding_tax) AS {D}) AS withholding_tax,
            bool_or(provisional) AS provisional FROM snapshot JOIN labels USING (instrument_id) GROUP BY ALL""",
            "snapshot", "labels",
        ),
        "group_summary": _with(f"SELECT account_id, CAST(sum(realized_pnl) AS {D}) AS realized_pnl, CAST(sum(unrealized_pnl) AS {D}) AS unrealized_pnl FROM snapshot GROUP BY account_id", "snapshot"),
        "recon_diff": _with(
            f"""SELECT report_date_local, instrument_id, i.conid, i.symbol, metric, broker_value, economic_value, abs_diff,
              CASE WHEN broker_value <> 0 THEN CAST((CAST(abs_diff * 100000000 AS HUGEINT) * 200000000 + CAST(abs(broker_value) * 100000000 AS HUGEINT)) // (2 * CAST(abs(broker_value) * 100000000 AS HUGEINT)) AS DECIMAL(38,0)) * CAST(0.00000001 AS DECIMAL(8,8)) END AS rel_diff,
              tol AS tolerance_abs, rel AS tolerance_rel, abs_diff <= tol OR (metric <> 'position_qty' AND broker_value <> 0 AND abs_diff <= abs(broker_value) * CAST(0.0001 AS DECIMAL(5,4))) AS within_tolerance,
              CASE WHEN metric = 'position_qty' THEN 'abs(a-b) <= 0.000001' ELSE 'abs(a-b) <= abs_tol OR abs(a-b)/max(abs(b),1e-9) <= rel_tol' END AS formula_context, source_raw_record_id, provisional
            FROM (SELECT s.report_date_local, s.instrument_id, s.provisional, b.source_raw_record_id, m.metric,
                CASE m.metric WHEN 'unrealized_pnl' THEN s.unrealized_pnl WHEN 'fees' THEN s.fees WHEN 'withholding_tax' THEN s.withholding_tax ELSE s.position_qty END AS economic_value,
                CASE m.metric WHEN 'unrealized_pnl' THEN v.broker_unrealized_pnl WHEN 'fees' THEN CAST(b.fees AS {D}) WHEN 'position_qty' THEN v.position_qty END AS broker_value,
                CAST(abs(economic_value - coalesce(broker_value, 0)) AS {D}) AS abs_diff,
                CAST(CASE m.metric WHEN 'position_qty' THEN 0.000001 ELSE 0.01 END AS {D}) AS tol, CAST(CASE m.metric WHEN 'position_qty' THEN 0 ELSE 0.0001 END AS {D}) AS rel
              FROM snapshot s JOIN (SELECT account_id, instrument_id, max(fee) AS fees, min(source_raw_record_id) AS source_raw_record_id FROM fills GROUP BY ALL) b USING (account_id, instrument_id)
              LEFT JOIN valuations v ON v.account_id = s.account_id AND v.instrument_id = s.instrument_id
              CROSS JOIN (VALUES ('unrealized_pnl'), ('fees'), ('withholding_tax'), ('position_qty')) m(metric)) JOIN instruments i USING (instrument_id)""",
            "snapshot", "fills", "valuations", "instruments",
        ),
        "provenance": _with(
            """SELECT account_id, ib_exec_id, source_raw_record_id, row_ref AS source_row_ref, account_id || '/' || ingestion_run_id AS raw_artifact_id,
            sha256(account_id || '/' || ingestion_run_id) AS payload_sha256, ingestion_run_id AS artifact_run_id, 'success' AS run_status
            FROM firsts JOIN (SELECT source_raw_record_id, row_ref FROM trade_rows) USING (source_raw_record_id)""",
            "firsts", "trade_rows",
        ),
        "report_lineage": _with(
            f"""SELECT e.*, section_name, row_ref AS source_row_ref, r.account_id || '/' || r.ingestion_run_id AS raw_artifact_id, r.ingestion_run_id AS artifact_run_id, 'success' AS run_status FROM (
              SELECT account_id, instrument_id, report_date_local, 'closed' AS role, fill_id AS event_id, source_raw_record_id, CAST(close_q AS {D}) AS quantity, CAST(-unit_fee * close_q AS {D}) AS amount FROM closes
              UNION ALL SELECT p.account_id, p.instrument_id, c.report_date_local, 'closed_lot', o.fill_id, o.source_raw_record_id, CAST(sum(p.m) AS {D}), CAST(sum(p.pnl) AS {D}) FROM match_pnl p
                JOIN closes c ON c.account_id = p.account_id AND c.fill_id = p.close_fill_id JOIN opens o ON o.account_id = p.account_id AND o.fill_id = p.open_fill_id GROUP BY ALL
              UNION ALL SELECT account_id, instrument_id, report_date_local, 'opened', fill_id, source_raw_record_id, CAST(open_q AS {D}), 0 FROM opens
              UNION ALL SELECT account_id, instrument_id, report_date_local, 'cash', concat_ws('|', transaction_id, cash_action, currency), 'c' || source_raw_record_id, NULL, CAST(-coalesce(fees, 0) - coalesce(withholding_tax, 0) AS {D}) FROM cash_merged WHERE instrument_id IS NOT NULL) e
            JOIN (SELECT source_raw_record_id AS id, account_id, ingestion_run_id, 'Trades' AS section_name, row_ref FROM trade_rows
              UNION ALL SELECT 'c' || source_raw_record_id, account_id, ingestion_run_id, 'CashTransactions', row_ref FROM cash_rows) r ON r.id = e.source_raw_record_id""",
            "opens", "closes", "match_pnl", "cash_merged", "trade_rows", "cash_rows",
        ),
        "drilldown": _with(
            f"SELECT label_name, symbol, account_id, count(*) AS event_count, CAST(sum(quantity) AS {D}) AS quantity FROM firsts f JOIN instruments i USING (instrument_id) JOIN labels USING (instrument_id) GROUP BY ALL",
            "firsts", "instruments", "labels",
        ),
        "label_rollup": _with(
            f"""SELECT report_date_local, label_id, g.total AS total_pnl, d.total AS instrument_total
            FROM (SELECT report_date_local, label_id, CAST(sum(total_pnl) AS {D}) AS total FROM snapshot JOIN labels USING (instrument_id) WHERE CAST(instrument_id AS INTEGER) % 7 <> 0 GROUP BY ALL) g
            FULL JOIN (SELECT report_date_local, label_id, CAST(sum(total_pnl) AS {D}) AS total FROM snapshot JOIN labels USING (instrument_id) GROUP BY ALL) d USING (report_date_local, label_id)
            WHERE g.total IS DISTINCT FROM d.total""",
            "snapshot", "labels",
        ),
        "stream_corrections": _with("SELECT * FROM cash_merged", "cash_merged"),
        "stream_dedupe": "SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events",
        "stream_stage_window": """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type AS stage,
            CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status, count(*) AS event_count FROM events GROUP BY ALL""",
        "stream_fifo": _with(
            f"""SELECT n.account_id, n.instrument_id, CAST(coalesce(r.realized, 0) AS {D}) AS realized_pnl, coalesce(l.lots, 0) AS open_lot_count, CAST(coalesce(l.q, 0) AS {D}) AS open_quantity
            FROM net n LEFT JOIN realized r USING (account_id, instrument_id) LEFT JOIN (
              SELECT account_id, instrument_id, count(*) AS lots, sum(remaining) AS q FROM lots WHERE remaining > 0 GROUP BY ALL) l USING (account_id, instrument_id)""",
            "net", "realized", "lots",
        ),
        "csv_contract": _with(
            """SELECT CAST(s.report_date_local AS VARCHAR) AS report_date_local, instrument_id, i.conid, i.symbol, s.currency, CAST(position_qty AS VARCHAR) AS position_qty,
            CAST(cost_basis AS VARCHAR) AS cost_basis, CAST(realized_pnl AS VARCHAR) AS realized_pnl, CAST(unrealized_pnl AS VARCHAR) AS unrealized_pnl, CAST(total_pnl AS VARCHAR) AS total_pnl,
            CAST(provisional AS VARCHAR) AS provisional FROM snapshot s JOIN instruments i USING (instrument_id)""",
            "snapshot", "instruments",
        ),
    }
    # broker rows are those of all fills, whatever the report date
    one = _with("SELECT * FROM snapshot", "snapshot").replace("FROM net n JOIN part", "FROM every_net n JOIN part")
    until = lambda day: one.replace("FROM firsts)", f"FROM firsts WHERE report_date_local <= DATE '{day}')", 1).replace("2001-12-31", day)
    days = ("1993-06-30", "1995-12-31", "1996-12-31", "1998-03-31", "2001-12-31")
    sqls["snapshot_series"] = f"WITH every_net AS ({_with('SELECT * FROM net', 'net')}) " + " UNION ALL ".join(f"SELECT * FROM ({until(day)})" for day in days)
    sqls["snapshot_series_split"] = sqls["snapshot_series"]
    sqls["snapshot_publish"] = f"SELECT * FROM ({sqls['snapshot_series']}) WHERE report_date_local BETWEEN DATE '1995-12-31' AND DATE '1998-03-31'"
    sqls["stream_fifo_state"] = sqls["fifo_uneven_fees"]
    for name in ("fifo_realized", "fifo_matches"):
        sqls[f"{name}_split"] = sqls[name]
    sqls["statement_files"] = """SELECT file_year, statement_index, r.c AS section_index, r.ref AS source_row_ref, r.a AS attributes FROM (
        SELECT year(o_orderdate)::INT AS file_year, (row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderkey) - 1)::INT AS statement_index, unnest([
            {'c': 0, 'ref': 'Trades:Trade:transactionID=' || o_orderkey, 'a': 'conid=' || o_custkey || ';currency=USD;transactionID=' || o_orderkey},
            {'c': 0, 'ref': 'Trades:Lot:idx=2', 'a': 'currency=EUR;qty=1'},
            {'c': 0, 'ref': 'Trades:Lot:idx=3', 'a': 'currency=ILS;qty=2'},
            {'c': 1, 'ref': 'CashTransactions:section:1', 'a': 'note=none'},
            CASE WHEN o_orderkey % 3 <> 0 THEN {'c': 2, 'ref': 'OpenPositions:OpenPosition:idx=1', 'a': 'conid=' || o_custkey} END]) AS r FROM orders) WHERE r IS NOT NULL"""
    xml = sqls["xml_rows"]
    views, body = xml.split(") SELECT payload_id, r.s", 1)
    sqls["stream_ingest"] = f"""{views}), rows AS (SELECT payload_id, r.s{body}) SELECT 'raw' AS kind, section_name AS name, count(*) AS row_count FROM rows GROUP BY ALL
        UNION ALL SELECT 'rejected', reason, count(*) FROM statement_rows WHERE reason IS NOT NULL GROUP BY ALL"""
    # A good statement has an empty section of cash rows, and most of rates: each is one row that breaks the contract.
    faulty = "1 + CASE WHEN o_orderkey % 4 <> 0 THEN 1 ELSE 0 END"
    hard = "['AccountInformation', 'CashTransactions', 'ConversionRates', 'CorporateActions', 'OpenPositions', 'SecuritiesInfo', 'Trades']"
    tables = f"""{views}), rows AS (SELECT payload_id, r.s{body}), good AS (SELECT *, {faulty} AS faulty FROM statement_rows WHERE reason IS NULL),
        total AS (SELECT (SELECT count(*) FROM rows) AS n, (SELECT count(*) FROM statement_rows WHERE reason IS NOT NULL) AS bad, (SELECT sum(faulty) FROM good)::BIGINT AS faulty)"""
    zeros = "0::BIGINT AS instrument_upsert_count, 0::BIGINT AS trade_fill_count, 0::BIGINT AS cashflow_count, 0::BIGINT AS fx_count, 0::BIGINT AS corp_action_count"
    no = "NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT"
    load = f"""'load' AS run_id, 'manual' AS run_type, 'success' AS status, NULL::VARCHAR AS error_code, bad AS rejected_count, n AS raw_record_count, 0::BIGINT AS raw_deduplicated_count,
        n AS canonical_input_row_count, faulty AS canonical_violation_row_count, {zeros}, NULL::VARCHAR AS canonical_skip_reason"""
    present = _VIEWS["sections"][0]
    sqls["ingest_job"] = f"""{tables}, present AS ({present}),
        lacking AS (SELECT payload_id, list_filter({hard}, lambda s: NOT list_contains(present, s)) AS missing FROM present),
        first_lacking AS (SELECT array_to_string(missing, ',') AS m FROM lacking WHERE len(missing) > 0 ORDER BY payload_id LIMIT 1)
        SELECT {load}, '' AS missing_sections, '' AS missing_hard_required FROM total
        UNION ALL SELECT 'again', 'manual', 'success', NULL, bad, 0, n, 0, NULL, {no}, 'no_new_raw_rows_for_run', '', '' FROM total
        UNION ALL SELECT 'strict', 'scheduled', 'failed', 'MISSING_REQUIRED_SECTION', NULL, NULL, NULL, NULL, NULL, {no}, NULL, m, m FROM first_lacking"""
    sqls["reprocess_job"] = f"""{tables}, filed AS (SELECT *, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS period, 'U' || (o_custkey % 3) AS account FROM good),
        one AS (SELECT account, period FROM filed ORDER BY period, account LIMIT 1), part AS (SELECT f.* FROM filed f JOIN one USING (account, period))
        SELECT NULL::VARCHAR AS account_id, {load} FROM total
        UNION ALL SELECT account, 'replay', 'reprocess', 'success', NULL, NULL, NULL, NULL, (SELECT count(*) FROM rows WHERE payload_id IN (SELECT payload_id FROM part)),
          (SELECT sum(faulty) FROM part)::BIGINT, 0, 0, 0, 0, 0, NULL FROM one
        UNION ALL SELECT account, 'no-month', 'reprocess', 'failed', 'REPROCESS_CONTRACT_ERROR', NULL, NULL, NULL, NULL, NULL, {no}, NULL FROM one"""
    return sqls


def _message_rows() -> str:
    from tallystone.operators.runs import STATUS_MESSAGES

    return ", ".join(f"('{code}', '{message}')" for code, message in STATUS_MESSAGES.items())

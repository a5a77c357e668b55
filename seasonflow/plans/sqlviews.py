"""The views of seasonflow.sources.views as DuckDB SQL, for the queries' counterparts."""

from __future__ import annotations

import re


def q(e: str, places: int = 6) -> str:
    return f"(floor(({e})::DOUBLE * 1e{places} + 0.5 + 1e-6) / 1e{places})"


KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
VIEWS = {
    "ticks": f"SELECT p_brand AS symbol, l_shipdate::DATE AS date, {q('l_extendedprice / l_quantity', 2)} AS px, l_quantity AS qty, {KEY}, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem JOIN part ON l_partkey = p_partkey",
    "bars": f"SELECT symbol, date, arg_min(px, [{KEY}]) AS open, max(px) AS high, min(px) AS low, arg_max(px, [{KEY}]) AS close, sum(qty) AS volume FROM ticks GROUP BY ALL",
    "sectors": "SELECT DISTINCT p_brand AS symbol, r_name AS sector FROM part JOIN region ON regexp_extract(p_brand, '(\\d+)', 1)::INT % 5 = r_regionkey WHERE p_brand <> 'Brand#25'",
    "index_series": f"""SELECT o_orderdate::DATE AS date, {q('avg(o_totalprice)', 4)} AS spx, {q("10 + 30 * avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)", 4)} AS vix,
  {q('avg(o_totalprice) / 1e5')} AS us10y, {q("avg(o_totalprice) FILTER (o_orderpriority = '2-HIGH') / 1e5")} AS us2y,
  {q("10 + avg(o_totalprice) FILTER (o_orderpriority = '3-MEDIUM') / 2e4", 4)} AS vix3m, {q("avg(o_totalprice) FILTER (o_orderpriority = '5-LOW') / 1e5")} AS irx,
  count(*) FILTER (o_orderstatus = 'F') AS advn, count(*) FILTER (o_orderstatus = 'O') AS decn FROM orders GROUP BY 1""",
    "earnings": "SELECT DISTINCT symbol, date FROM ticks WHERE l_returnflag = 'R' AND l_orderkey % 37 = 0",
    "opps0": f"""SELECT *, CASE WHEN k = 0 THEN 10 ELSE (5 + (l_partkey + 5 * k) % 31) END::INT AS year1, (l_linenumber + k) % 7 = 0 AS is_pe
  FROM ticks, (SELECT unnest(range(6))::INT AS k) WHERE year(date) = 2000 AND (l_suppkey + k) % 3 <> 0""",
    "opps1": "SELECT *, (CASE WHEN is_pe THEN year1 ELSE year1 - l_suppkey % (year1 - floor(year1 * 0.8::DOUBLE)::BIGINT + 1) END)::INT AS year2 FROM opps0",
    "opps2": f"""SELECT symbol, date, (10 + l_orderkey % 21)::INT AS days_out, CASE WHEN l_linestatus = 'F' THEN 'l' ELSE 's' END AS direction,
  year1 || '_' || year2 || CASE WHEN is_pe THEN '_PE2' ELSE '' END AS combo, year1, year2, is_pe, {q('20 * l_discount + 5 * l_tax + 0.1::DOUBLE * k', 4)} AS sharpe_ratio, {q('100 * l_tax', 4)} AS avg_profit,
  CASE WHEN l_linenumber <> 2 THEN {q('25 * l_tax', 4)} END AS sharpe_ratio2, CASE WHEN l_linenumber <> 1 THEN {q('100 * l_discount', 4)} END AS avg_profit2, {KEY} FROM opps1""",
    "opps": f"""SELECT symbol, date, days_out, direction, combo, year1, year2, is_pe, sharpe_ratio, avg_profit, sharpe_ratio2, avg_profit2 FROM opps2
  QUALIFY row_number() OVER (PARTITION BY symbol, date, days_out, direction, combo ORDER BY sharpe_ratio DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) = 1""",
    "cand0": f"""SELECT *, (10 + l_orderkey % 21)::INT AS holding_days, CASE WHEN l_linestatus = 'F' THEN 'l' ELSE 's' END AS direction FROM ticks
  QUALIFY row_number() OVER (PARTITION BY symbol, date, 10 + l_orderkey % 21, l_linestatus = 'F' ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) = 1""",
    "cand1": f"SELECT *, (l_orderkey * 7919 % 1001) / 10.0::DOUBLE AS ml_score, {q('100 * l_discount - 2', 4)} AS predicted_return FROM cand0",
    "cand2": f"SELECT *, {q('predicted_return + ((l_partkey * 31 + l_suppkey * 17) % 2001 - 1000) / 100.0::DOUBLE', 4)} AS actual_return FROM cand1",
    "candidates": f"""SELECT date, year(date)::INT AS year, symbol, coalesce(sector, 'Unknown') AS sector, direction, holding_days, ml_score, predicted_return, {q('predicted_return + 50 * l_tax', 4)} AS predicted_mfe,
  {q('0.5::DOUBLE + ml_score / 300', 4)} AS win_probability, {q('0.4::DOUBLE + l_discount', 4)} AS p_hit_return, {q('0.35::DOUBLE + l_tax', 4)} AS p_hit_mfe, actual_return,
  {q('greatest(actual_return, 0.0::DOUBLE) + (l_partkey % 500) / 100.0::DOUBLE', 4)} AS actual_mfe, {q('0.5::DOUBLE + (l_partkey % 100) / 50.0::DOUBLE', 4)} AS stock_volatility_20d,
  {q('0.01::DOUBLE + (l_suppkey % 40) / 1000.0::DOUBLE', 4)} AS atr_14d_pct FROM cand2 LEFT JOIN sectors USING (symbol)""",
    "equity0": "SELECT c_mktsegment AS strategy_id, o_orderdate::DATE AS date, sum((o_totalprice - 200000) / 100) AS pnl FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
    "equity": f"SELECT strategy_id, date, {q('pnl')} AS pnl, {q('100000 + sum(pnl) OVER (PARTITION BY strategy_id ORDER BY date)', 4)} AS equity FROM equity0",
    "trades": f"""SELECT 'S' || (holding_days % 5) AS strategy_id, symbol, sector, direction, date AS entry_date, (date + holding_days)::DATE AS exit_date, holding_days, floor(1 + holding_days * 5 / 7.0::DOUBLE)::INT AS days_held, ml_score,
  {q('0.004::DOUBLE * floor(1 + holding_days * 5 / 7.0::DOUBLE)')} AS theta, {q('greatest(actual_return / 100 * 12 - 0.004::DOUBLE * floor(1 + holding_days * 5 / 7.0::DOUBLE), -1.0::DOUBLE)')} AS option_return,
  {q('actual_return / 100')} AS exit_return, {q('actual_mfe / 100')} AS hwm, {q('actual_return * 50', 4)} AS pnl FROM candidates""",
}


def sql(body: str, extra: dict[str, str] | None = None) -> str:
    """body, headed by the views that it names, directly or through other views."""
    views = {**VIEWS, **(extra or {})}
    order: list[str] = []

    def need(text: str, own: str = "") -> None:
        words = set(re.findall(r"\w+", text))
        for name in views:
            if name in words and name != own and name not in order:
                need(views[name], name)
                if name not in order:
                    order.append(name)

    need(body)
    if not order:
        return body
    rest = body.lstrip()
    head = "WITH " + ",\n".join(f"{n} AS ({views[n]})" for n in order)
    return f"{head},\n{rest[5:]}" if rest[:5].upper() == "WITH " else f"{head}\n{rest}"
